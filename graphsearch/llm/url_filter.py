"""URL rules by a sorted range join, in DataFrame functions alone.

A host becomes its labels in reverse order, each with a final dot (``news.example.org`` ->
``org.example.news.``).  A rule's host is then a prefix, that is an interval of the sorted keys, and
the intervals of all rules nest.  A sweep over the sorted keys keeps the stack of rules: one slot for
each number of labels, overwritten by every later rule with as many.  A slot's rule is active for a
key exactly if it is a prefix of the key, since whatever sorts between a prefix and its extension
shares the prefix.

Rows are dealt out by a hash of all their columns and the rules go to every part, so that a host or a
domain with a third of all rows is spread like any other, and a part that is computed again has the same
rows.  Rules beyond MOST_RULES hosts are swept in blocks of that size, and each row keeps the best rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphsearch.llm.tables import partitions, read

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)
#: What is known of a row's longest rule, the longest first.
_BEST = "struct<short:int,short_host:int,rule:string,verdict:string>"
#: verdict, host, path.
DEFAULT_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Hosts of rules that go to every part at once.
MOST_RULES = 20_000


def host_of(url: Column) -> Column:
    """From the first :// to the next of / ? #, with A-Z in lower case; empty without ://, and for null."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end to the next of ? #; empty without ://, and for null."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3)))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def apply_rules(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = DEFAULT_RULES, default: str = "allow", url: str = "url") -> DataFrame:
    """The columns of pages, and host, path, rule, verdict; a column of pages with one of these names is left out.

    A rule (verdict, host, path) fits its host and every subdomain, if the path starts with the
    rule's.  The longest fitting rule (host and path together; then the longer host; then the one
    that sorts first) gives the verdict; without one, rule is null and the verdict is default.
    Null and unparsable urls have an empty host and path.  Repeated rows are each answered.
    No row leaves no row; no rule leaves every row at the default.
    """
    spark = pages.sparkSession
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    row = pages.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    if not rules:
        return row.select("row.*", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    parts = max(64, 4 * partitions(spark))
    hashed = [F.col(f"row.`{f.name}`") for f in row.schema["row"].dataType.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    row = row.withColumn("part", F.pmod(F.xxhash64("host", "path", *hashed), F.lit(parts)).cast("int")).withColumn("best", F.lit(None).cast(_BEST))
    by_host: dict[str, set[tuple[str, str]]] = {}
    for verdict, host, path in rules:
        by_host.setdefault(host.translate(_FOLD), set()).add((path, verdict))
    hosts = sorted(by_host)
    for k in range(0, len(hosts), MOST_RULES):
        row = _sweep(row, {h: sorted(by_host[h]) for h in hosts[k : k + MOST_RULES]}, parts)
    return row.select("row.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _sweep(row: DataFrame, rules: dict[str, list[tuple[str, str]]], parts: int) -> DataFrame:
    """row with the best of its best and what these rules (paths and verdicts by host) have for it."""
    spark = row.sparkSession
    ruled = spark.createDataFrame(list(rules.items()), "rule_host string, paths array<struct<rule_path:string,verdict:string>>")
    ruled = ruled.select(host_key(F.col("rule_host")).alias("key"), F.struct(host_key(F.col("rule_host")).alias("key"), "rule_host", "paths").alias("opened"))
    depths = sorted({h.count(".") + 1 for h in rules})
    events = (
        row.withColumn("key", host_key(F.col("host")))
        .withColumn("opened", F.lit(None).cast(ruled.schema["opened"].dataType))
        .unionByName(ruled.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), allowMissingColumns=True)
    )
    sweep = Window.partitionBy("part").orderBy("key", F.col("opened").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    labels = F.size(F.split(F.col("opened.rule_host"), r"\."))
    stack = [F.last(F.when(labels == d, F.col("opened")), ignorenulls=True).over(sweep).alias(f"at_{d}") for d in depths]
    swept = events.select("row", "host", "path", "key", "part", "best", *stack).where(F.col("row").isNotNull())
    active = F.filter(F.array(*(f"at_{d}" for d in depths)), lambda r: r.isNotNull() & F.startswith(F.col("key"), r["key"]))
    fitting = F.flatten(
        F.transform(
            active,
            lambda r: F.transform(
                F.filter(r["paths"], lambda p: F.startswith(F.col("path"), p["rule_path"])),
                lambda p: F.struct((-F.length(r["rule_host"]) - F.length(p["rule_path"])).alias("short"), (-F.length(r["rule_host"])).alias("short_host"), F.concat(r["rule_host"], p["rule_path"]).alias("rule"), p["verdict"].alias("verdict")),
            ),
        )
    )
    best = F.array_min(F.filter(F.concat(fitting.cast(f"array<{_BEST}>"), F.array("best")), lambda b: b.isNotNull()))
    return swept.select("row", "host", "path", "part", best.alias("best"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(read(spark, sf_dir, "pages").select("page_id", "url"), DEFAULT_RULES, default="allow").select("page_id", "host", "path", "rule", "verdict")


ORACLE = """
WITH rules(verdict, host, path) AS (VALUES ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'), ('allow','com','/fr/'), ('block','com','/de/')),
split AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url[position('://' IN url) + 3:] ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM split),
best AS (
  SELECT p.page_id, p.host, p.path, arg_max(r.host || r.path, length(r.host) + length(r.path)) AS rule, arg_max(r.verdict, length(r.host) + length(r.path)) AS verdict
  FROM parts p LEFT JOIN rules r ON (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path)
  GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best
"""
