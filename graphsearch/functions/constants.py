"""Fixed values that results depend on."""

from __future__ import annotations

#: Words that are no keywords.
STOPWORDS = (
    "là và của trong có các được với để đã tại từ về cho khi như thì mà vào ra đến theo này đó một những cũng hay hoặc bởi vì nên nếu thế sẽ đang đây còn qua lại sau trước trên dưới nhiều ít tìm kiếm hãy xem".split()
    + ["thông tin", "bài báo", "tin tức", "cho tôi"]
)
#: Words of each topic, in order of preference.
TOPICS = {
    "chính trị": ["chính trị", "quốc hội", "chính phủ", "bầu cử", "tổng thống", "thủ tướng", "luật"],
    "thế giới": ["thế giới", "quốc tế", "chiến tranh", "xung đột", "ngoại giao", "NATO", "LHQ"],
    "y tế": ["y tế", "dịch bệnh", "covid", "vaccine", "bệnh viện", "sức khỏe", "WHO", "dịch"],
    "giáo dục": ["giáo dục", "trường học", "đại học", "học sinh", "sinh viên", "đào tạo"],
    "kinh tế": ["kinh tế", "gdp", "tăng trưởng", "ngân hàng", "đầu tư", "doanh nghiệp", "thị trường"],
    "công nghệ": ["công nghệ", "ai", "trí tuệ nhân tạo", "5g", "phần mềm", "startup", "digital"],
}
#: Phrases that ask for recent news.
TEMPORAL = r"mới nhất|gần đây|hôm nay|tuần này|tháng này|năm nay|latest|recent|today|breaking|vừa|vừa qua|mới đây|trong \d+ (?:ngày|tuần|tháng|năm) (?:qua|gần đây|vừa rồi)"
#: Parts of urls that are no articles, and categories of the listing.
NOT_ARTICLES = ("/topic/", "/tag/", "/category/", "/author/", "/search/", "/photo/", "/video/", "page=")
CATEGORIES = {
    "thoi-su": 1001005, "the-gioi": 1001002, "kinh-doanh": 1003159, "giai-tri": 1002691, "the-thao": 1002565, "phap-luat": 1001007, "giao-duc": 1003497,
    "suc-khoe": 1003750, "du-lich": 1003231, "khoa-hoc": 1001009, "so-hoa": 1002592, "xe": 1001006, "y-kien": 1001012, "tam-su": 1001014,
}
#: Aliases that are known from the start, pairs that are never matched by spelling.
SEED_ALIASES = [("WHO", "WHO"), ("LHQ", "Liên Hợp Quốc"), ("UN", "Liên Hợp Quốc"), ("Hanoi", "Hà Nội"), ("Hoa Kỳ", "Mỹ"), ("USA", "Mỹ"), ("Vladimir Putin", "Putin"), ("SARS-CoV-2", "COVID-19"), ("covid", "COVID-19")]
NEVER_MATCHED = [("Hà Nội", "Hà Nam"), ("Viettel", "Vietjet"), ("NATO", "nano"), ("VinAI", "Vincom"), ("Google", "Googol"), ("Samsung", "Samson")]
#: Weights of relations; other relations, and no relation.
RELATION_WEIGHTS = {
    "leads": 1.0, "attacks": 1.0, "supports": 0.9, "invests_in": 0.9, "signs_deal_with": 0.8, "appointed": 0.8, "sanctions": 0.8, "acquires": 0.8,
    "cooperates_with": 0.7, "warns_about": 0.7, "found_in": 0.6, "member_of": 0.6, "located_in": 0.5, "co_occurrence": 0.15, "similar_to": 0.1,
}
OTHER_RELATION, NO_RELATION = 0.3, 0.5
#: Letters with marks (đ is a letter of its own) and the letters without, by place.
_BASES = {"a": "àáảãạăằắẳẵặâầấẩẫậ", "e": "èéẻẽẹêềếểễệ", "i": "ìíỉĩị", "o": "òóỏõọôồốổỗộơờớởỡợ", "u": "ùúủũụưừứửữự", "y": "ỳýỷỹỵ"}
MARKED = "".join(_BASES.values())
UNMARKED = "".join(b * len(m) for b, m in _BASES.items())
#: Letters that only Vietnamese text has many of.
ACCENTED = "ăâđêôơưĂÂĐÊÔƠƯ" + "".join(c + c.upper() for c in MARKED if c not in "ăâêôơư")
