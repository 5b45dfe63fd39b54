import pytest
from pyspark.sql import functions as F

from graphsearch.functions import dates, text


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values))))
    return df.select(f(*(F.col(f"c{k}") for k in range(len(values)))).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "given, expected",
    [("Thứ sáu, 31/7/2020, 18:15 (GMT+7)", "2020-07-31"), ("2024-1-5T10:00", "2024-1-5T10:00"), ("2024-1-5", "2024-01-05"), ("45/13/2020", "2020-13-45"), ("hôm qua", "hôm qua"), ("", "")],
)
def test_dates(spark, given, expected):
    assert one(spark, dates.parse_date, given) == expected


@pytest.mark.parametrize("given, expected", [("Câu một.\nNguyễn Văn A", "Câu một."), ("Câu một.\nTheo Reuters", "Câu một."), ("Nguyễn Văn A", "Nguyễn Văn A"), ("Một.\nhai ba bốn", "Một.\nhai ba bốn")])
def test_bylines(spark, given, expected):
    assert one(spark, text.strip_byline, given) == expected


@pytest.mark.parametrize("given, expected", [("Đà Nẵng", "đa_nang".replace("đ", "")), ("Liên Hợp Quốc", "lien_hop_quoc"), ("!!!", "entity")])
def test_slugs(spark, given, expected):
    assert one(spark, text.entity_slug, given) == expected


def test_queries(spark):
    assert one(spark, text.year, "giá vàng 2024") == "2024"
    assert one(spark, text.intent, "giá vàng 2024") == "temporal_query"
    assert one(spark, text.intent, "chiến tranh nga ukraine 2024") == "news_search"
    assert one(spark, text.topic, "NATO") is None
    assert one(spark, text.topic, "bầu cử tổng thống") == "chính trị"
    assert len(one(spark, text.sentences, "Putin họp NATO. OK. Zelensky phát biểu.")) == 2


def test_soft_matches(spark):
    assert one(spark, text.soft_match, "ha noi", "tp ha noi") is True
    assert one(spark, text.soft_match, "nga", "lien bang nga") is True
    assert one(spark, text.soft_match_by_length, "nga", "lien bang nga") is False
    assert one(spark, text.soft_match, "", "nga") is False


def test_decay(spark):
    row = spark.sql("SELECT cast(null AS date) AS a, date '2023-12-31' AS b, date '2024-12-30' AS now").select(dates.decayed(F.lit(1.0), F.col("a"), F.col("now")).alias("a"), dates.decayed(F.lit(1.0), F.col("b"), F.col("now")).alias("b")).first()
    assert row["a"] == pytest.approx(0.988)
    assert row["b"] == pytest.approx(0.9494, abs=1e-4)
