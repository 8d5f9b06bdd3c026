"""Query understanding, relevance, merging and guarding of retrieved candidates, as DataFrame operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators.pairs import BLOCK, with_queries

#: Document types by the first matching pattern.
TYPES = [
    (r"\b(?:nghi dinh|nd-cp|nd(?:\b|\d))", "Nghị định"),
    (r"\b(?:thong tu|tt-btc|tt(?:\b|\d))", "Thông tư"),
    (r"\b(?:nghi quyet|nq-qh|nq-cp|nq(?:\b|\d))", "Nghị quyết"),
    (r"\b(?:quyet dinh|qd-ttg|qd(?:\b|\d))", "Quyết định"),
    (r"\b(?:luat)\b", "Luật"),
]
TYPE_OF_WORD = {"nghi dinh": "Nghị định", "nd": "Nghị định", "thong tu": "Thông tư", "tt": "Thông tư", "nghi quyet": "Nghị quyết", "nq": "Nghị quyết", "quyet dinh": "Quyết định", "qd": "Quyết định", "luat": "Luật"}
#: Fixed value: suffixes of document numbers.
SUFFIX = r"(?:nd-cp|tt-[a-z0-9-]+|nq-[a-z0-9-]+|qd-[a-z0-9-]+|qh\d*|ubtvqh\d*)"
#: Fixed value: words of questions.
QUESTION = r"\b(?:bao nhieu|muc thue|thue suat|dong thue|nop thue|khai thue|khai ky nao|dung mau|the nao|duoc khong|co phai|phai khong|tai sao|can lam gi|van ban nao|bao gio|han nop|thoi han|doi tuong nao|thuoc dien|cach tinh|tinh nhu the nao|mien thue|giam thue|hoan thue|khau tru|quyet toan|hoa don|ho kinh doanh|doanh thu|chi phi duoc tru|thu nhap chiu thue)\b"
#: Patterns of a number and an optional year, in order of precedence.
NUMBERS = [
    rf"\b(\d{{1,4}})\s*[/-]\s*(20\d{{2}})\s*[/-]\s*{SUFFIX}\b",
    r"\b(?:nd|tt|nq|qd)\s*(\d{1,4})\s*[/-]\s*(20\d{2})\b",
    r"\b(\d{1,4})\s*[/-]\s*(20\d{2})\b",
    r"\b(?:nghi dinh|thong tu|nghi quyet|quyet dinh|luat|nd|tt|nq|qd)\s+(?:so\s+)?(\d{1,4})(?:\s+(?:nam\s+)?(20\d{2}))?\b",
]
TRAILING = rf"\b(\d{{1,4}})(?:\s*[/-]\s*(20\d{{2}}))?(?:\s*[/-]\s*{SUFFIX})?\s*$"
#: Fixed value: phrases of prompt injection.
INJECTION = r"\b(?:ignore|bo qua|system prompt|developer message|tiet lo prompt|lam theo lenh|khong can can cu)\b"


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def search_hints(queries: DataFrame, query: str = "query") -> DataFrame:
    """``queries`` with normalised text, document type, number, year, whether it asks a question, and the injection guard."""
    n = F.col("normalised")
    kind = F.coalesce(*[F.when(n.rlike(p), label) for p, label in TYPES])
    hit = [F.when(n.rlike(p), F.struct(F.regexp_extract(n, p, 1).alias("number"), _found(n, p, 2).alias("year"))) for p in NUMBERS]
    # exploding a one-element array keeps the optimiser from copying the long normalisation into every expression below
    rows = queries.withColumn("normalised", F.explode(F.array(T.normalise_query(F.col(query))))).withColumn("type", kind).withColumn("hit", F.coalesce(*hit))
    year_like = lambda c: c.rlike(r"^(?:19|20)\d{2}$")
    direct = F.when(~year_like(F.col("hit.number")), F.col("hit.number"))
    trailing = F.when(F.col("type").isNotNull(), _found(n, TRAILING, 1))
    trailing = F.when(~year_like(trailing), trailing)
    rows = rows.withColumn("trailing", trailing).withColumn("number", F.coalesce(direct, trailing))
    named = F.when(F.col("number").isNotNull(), _found(n, r"\bnam\s+(20\d{2})\b", 1))
    rows = rows.withColumn("year", F.coalesce("hit.year", F.when(F.col("trailing").isNotNull(), _found(n, TRAILING, 2)), named))
    asks, words = n.rlike(QUESTION), F.size(F.filter(F.split(n, " "), lambda w: w != ""))
    lookup = F.col("type").isNotNull() & (F.col("number").isNotNull() | (~asks & (words <= 18)))
    rows = rows.withColumn("asks_question", asks | (~lookup & (words >= 4))).withColumn("injection", n.rlike(INJECTION))
    return rows.drop("hit", "trailing")


#: Fixed value: mentions of documents.
MENTION = r"\b(nghi dinh|thong tu|nghi quyet|quyet dinh|luat|nd|tt|nq|qd)\s*(\d{1,4})(?:\s*[/-]?\s*(20\d{2}))?"
#: Fixed value: anchored references.
REFERENCE = r"\b(nghi dinh|thong tu|nghi quyet|quyet dinh|luat|nd|tt|nq|qd)\s*(?:so\s*)?(\d{1,4})\s*[/-]\s*(20\d{2})(?:\s*[/-]\s*([a-z0-9-]+))?"


def _type_of(word: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in TYPE_OF_WORD.items() for x in pair]), word)


def mentions(queries: DataFrame, key: str = "qid", query: str = "query") -> DataFrame:
    """One row for each distinct document mentioned: type, number, year, in order of first mention."""
    n = T.normalise_query(F.col(query))
    parts = F.arrays_zip(*[F.regexp_extract_all(n, F.lit(MENTION), F.lit(g)).alias(name) for g, name in ((1, "word"), (2, "number"), (3, "year"))])
    rows = queries.select(key, F.posexplode(parts).alias("at", "m")).select(key, "at", _type_of(F.col("m.word")).alias("type"), "m.number", F.nullif(F.col("m.year"), F.lit("")).alias("year"))
    return rows.groupBy(key, "type", "number", "year").agg(F.min("at").alias("at"))


def references(queries: DataFrame, key: str = "qid", query: str = "query") -> DataFrame:
    """Anchored references with a year, and the canonical suffix of their type."""
    n = T.normalise_plain(F.col(query), "a-z0-9/_.-")
    parts = F.arrays_zip(*[F.regexp_extract_all(n, F.lit(REFERENCE), F.lit(g)).alias(name) for g, name in ((1, "word"), (2, "number"), (3, "year"), (4, "suffix"))])
    rows = queries.select(key, n.contains("bo tai chinh").alias("finance"), F.posexplode(parts).alias("at", "m"))
    rows = rows.select(key, "at", "finance", _type_of(F.col("m.word")).alias("type"), "m.number", "m.year", F.regexp_replace("m.suffix", "^[-/]+", "").alias("raw"))
    suffix = (
        F.when((F.col("type") == "Thông tư") & (F.col("raw").isin("btc", "tt-btc") | F.col("finance")), "TT-BTC")
        .when(F.col("type") == "Nghị định", "NĐ-CP")
        .when(F.col("raw") != "", F.upper("raw"))
    )
    return rows.withColumn("suffix", suffix).groupBy(key, "type", "number", "year").agg(F.min_by("suffix", "at").alias("suffix"), F.min("at").alias("at"))


#: Labels by pattern, with the number of labels kept.
AREAS = [
    ("thuế giá trị gia tăng", r"\b(?:gtgt|vat|gia tri gia tang)\b"),
    ("thuế thu nhập cá nhân", r"\b(?:tncn|thu nhap ca nhan)\b"),
    ("thuế thu nhập doanh nghiệp", r"\b(?:tndn|thu nhap doanh nghiep)\b"),
    ("hóa đơn điện tử", r"\b(?:hoa don|may tinh tien)\b"),
    ("quản lý thuế", r"\b(?:quan ly thue|khai thue|nop thue|dang ky thue|ma so thue)\b"),
    ("lệ phí môn bài", r"\b(?:le phi mon bai|thue mon bai|mon bai)\b"),
    ("thuế nhà thầu", r"\b(?:thue nha thau|nha thau nuoc ngoai|fct)\b"),
    ("thuế tiêu thụ đặc biệt", r"\b(?:tieu thu dac biet|ttdb)\b"),
    ("thuế xuất nhập khẩu", r"\b(?:xuat khau|nhap khau|hai quan)\b"),
    ("thuế tài nguyên và môi trường", r"\b(?:thue tai nguyen|bao ve moi truong)\b"),
    ("thuế, tiền sử dụng đất", r"\b(?:su dung dat|tien thue dat|thue dat|dat phi nong nghiep)\b"),
]
SUBJECTS = [
    ("hộ kinh doanh, cá nhân kinh doanh", r"\b(?:ho kinh doanh|ca nhan kinh doanh)\b"),
    ("doanh nghiệp, tổ chức", r"\b(?:doanh nghiep|cong ty|to chuc|hop tac xa)\b"),
    ("tổ chức trả thu nhập", r"\b(?:to chuc tra thu nhap|don vi tra thu nhap|nguoi su dung lao dong)\b"),
    ("cá nhân, người lao động", r"\b(?:ca nhan|nguoi lao dong|tien luong|tien cong)\b"),
    ("nhà thầu nước ngoài", r"\b(?:nha thau nuoc ngoai|nha cung cap nuoc ngoai)\b"),
    ("hoạt động thương mại điện tử", r"\b(?:thuong mai dien tu|san thuong mai dien tu|ban hang online|livestream|content creator|youtuber|tiktoker)\b"),
    ("đơn vị phụ thuộc, địa điểm kinh doanh", r"\b(?:don vi phu thuoc|chi nhanh|dia diem kinh doanh)\b"),
]
INTENTS = [
    ("thuế suất, mức thuế và cách tính", r"\b(?:thue suat|muc thue|bao nhieu phan tram|cach tinh|tinh thue|so thue phai nop)\b"),
    ("ngưỡng doanh thu, miễn thuế, không chịu thuế", r"\b(?:nguong|doanh thu|mien thue|giam thue|khong chiu thue|khong phai nop)\b"),
    ("khai thuế, hồ sơ và mẫu biểu", r"\b(?:khai thue|to khai|ho so|mau bieu|mau nao|phu luc)\b"),
    ("thời hạn khai, nộp và xử lý", r"\b(?:thoi han|han nop|bao gio|cham nhat|bao nhieu ngay)\b"),
    ("hóa đơn và chứng từ", r"\b(?:hoa don|chung tu|may tinh tien)\b"),
    ("khấu trừ thuế, chi phí được trừ", r"\b(?:khau tru|chi phi duoc tru|dau vao|giam tru)\b"),
    ("hoàn thuế", r"\b(?:hoan thue|hoan gtgt)\b"),
    ("quyết toán thuế", r"\b(?:quyet toan|uy quyen quyet toan)\b"),
    ("đăng ký thuế và mã số thuế", r"\b(?:dang ky thue|ma so thue|cham dut hieu luc ma so thue)\b"),
    ("xử phạt, tiền chậm nộp và cưỡng chế", r"\b(?:xu phat|phat bao nhieu|tien cham nop|cham nop|cuong che|vi pham)\b"),
    ("phân bổ nghĩa vụ thuế, khai tập trung", r"\b(?:phan bo|khai tap trung|tinh khac|dia phuong khac)\b"),
    ("sửa đổi, bổ sung, thay thế và đối chiếu", r"\b(?:sua doi|bo sung|thay the|bai bo|diem moi|doi chieu|phan tich)\b"),
]
RULES = [(group, n, label, pattern) for group, table in (("area", AREAS), ("subject", SUBJECTS), ("intent", INTENTS)) for n, (label, pattern) in enumerate(table)]
CAPS = {"area": 3, "subject": 3, "intent": 4}
#: Fixed value: words of questions on tax.
ASKS = r"\b(?:bao nhieu|the nao|duoc khong|co phai|phai khong|tai sao|can lam gi|bao gio|han nop|thoi han|mau nao|cach tinh|ap dung|xu ly|phan tich|giai thich|doi chieu|huong dan|khai thue|nop thue|hoan thue|khau tru|quyet toan|hoa don|doanh thu|thue suat|chi phi duoc tru|mien thue|giam thue|khong chiu thue|dang ky thue|ma so thue|xu phat|cham nop|phan bo|khai tap trung)\b"
#: Fixed value: references in a question.
HAS_REFERENCE = r"\b(?:nghi dinh|thong tu|nghi quyet|quyet dinh|luat|nd|tt|nq|qd)\s*(?:so\s*)?\d{1,4}\s*[/-]\s*20\d{2}(?:\s*[/-]\s*[a-z0-9-]+)?\b"


def rule_table(spark: SparkSession, rules: list[tuple] = RULES) -> DataFrame:
    """Rules as a small table; it is a parameter, so it may be broadcast."""
    return F.broadcast(spark.createDataFrame(rules, "kind STRING, ordinal INT, label STRING, pattern STRING"))


def match_rules(texts: DataFrame, text: str, rules: DataFrame) -> DataFrame:
    """Theta join of texts and rules on regular expressions: one row for each match."""
    return texts.join(rules, F.expr(f"{text} rlike pattern"))


def question_plans(queries: DataFrame, key: str = "qid", query: str = "query") -> DataFrame:
    """Areas, subjects and intents of each question, first rules first, with their caps; whether it asks and cites a document; its years."""
    rows = queries.select(key, T.normalise_plain(F.col(query)).alias("normalised"))
    hits = match_rules(rows, "normalised", rule_table(queries.sparkSession))
    found = hits.groupBy(key).agg(*[
        F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("ordinal", "label")))), lambda s: s["label"]), 1, cap).alias(f"{kind}s") for kind, cap in CAPS.items()
    ])
    empty = F.array().cast("array<string>")
    rows = rows.withColumn("asks", F.col("normalised").rlike(ASKS)).withColumn("cites", F.col("normalised").rlike(HAS_REFERENCE))
    rows = rows.withColumn("years", F.array_distinct(F.regexp_extract_all("normalised", F.lit(r"\b(20\d{2})\b"), F.lit(1))))
    return rows.join(found, key, "left").select(key, "normalised", "asks", "cites", "years", *[F.coalesce(f"{k}s", empty).alias(f"{k}s") for k in CAPS])


def clarification(plans: DataFrame) -> DataFrame:
    """``plans`` with the kind of clarification a question needs, or null."""
    none = lambda *names: F.array(*[F.size(n) == 0 for n in names])
    every = lambda a: F.forall(a, lambda x: x)
    words = F.size(F.filter(F.split("normalised", " "), lambda w: w != ""))
    need = (
        F.when(~F.col("asks") | F.col("cites"), F.lit(None).cast("string"))
        .when(F.array_contains("intents", INTENTS[0][0]) & every(none("areas", "subjects")), "rate")
        .when(F.array_contains("intents", INTENTS[3][0]) & every(none("areas")) & ~F.array_contains("intents", INTENTS[2][0]), "deadline")
        .when((words <= 5) & every(none("areas", "subjects", "intents")), "general")
    )
    return plans.withColumn("clarify", need)


#: Words of administration, of taxes, of households and of businesses.
ADMINISTRATION = r"\b(?:luat quan ly thue|quan ly thue|thu tuc thue|khai thue|hoan thue)\b"
TAX_WORDS = r"\b(?:thue|gtgt|tncn|tndn|gia tri gia tang|hoa don|hai quan|le phi|quan ly thue)\b"
HOUSEHOLD = r"\b(?:ho kinh doanh|ca nhan kinh doanh)\b"
BUSINESS = r"\b(?:doanh nghiep|cong ty|to chuc|nguoi nop thue)\b"
#: Words that source relevance ignores.
RELEVANCE_STOP = "thue van ban quy dinh hien hanh nguoi dung can phai duoc khong thi va cua cho nam".split()
#: Areas by their patterns in sources.
SOURCE_AREAS = [
    ("thuế giá trị gia tăng", r"\b(?:gtgt|gia tri gia tang|thue vat)\b"),
    ("thuế thu nhập cá nhân", r"\b(?:tncn|thu nhap ca nhan)\b"),
    ("thuế thu nhập doanh nghiệp", r"\b(?:tndn|thu nhap doanh nghiep)\b"),
    ("hóa đơn điện tử", r"\b(?:hoa don|may tinh tien)\b"),
    ("quản lý thuế", r"\b(?:quan ly thue|khai thue|nop thue|dang ky thue|ma so thue)\b"),
    ("lệ phí môn bài", r"\b(?:le phi mon bai|thue mon bai|mon bai)\b"),
    ("thuế nhà thầu", r"\b(?:thue nha thau|nha thau nuoc ngoai|fct)\b"),
    ("thuế tiêu thụ đặc biệt", r"\b(?:tieu thu dac biet|ttdb)\b"),
    ("thuế xuất nhập khẩu", r"\b(?:xuat khau|nhap khau|hai quan)\b"),
    ("thuế tài nguyên và môi trường", r"\b(?:thue tai nguyen|thue bao ve moi truong)\b"),
    ("thuế, tiền sử dụng đất", r"\b(?:su dung dat|tien thue dat|thue dat|dat phi nong nghiep)\b"),
]
#: Subjects by their patterns in sources.
SOURCE_SUBJECTS = [
    ("hộ kinh doanh, cá nhân kinh doanh", r"\b(?:ho kinh doanh|ca nhan kinh doanh)\b"),
    ("doanh nghiệp, tổ chức", r"\b(?:doanh nghiep|cong ty|to chuc|hop tac xa)\b"),
    ("tổ chức trả thu nhập", r"\b(?:to chuc tra thu nhap|don vi tra thu nhap|nguoi su dung lao dong)\b"),
    ("cá nhân, người lao động", r"\b(?:ca nhan|nguoi lao dong|tien luong|tien cong)\b"),
    ("nhà thầu nước ngoài", r"\b(?:nha thau nuoc ngoai|nha cung cap nuoc ngoai)\b"),
    ("hoạt động thương mại điện tử", r"\b(?:thuong mai dien tu|san thuong mai dien tu|ban hang online|livestream|content creator|youtuber|tiktoker)\b"),
    ("đơn vị phụ thuộc, địa điểm kinh doanh", r"\b(?:don vi phu thuoc|chi nhanh|dia diem kinh doanh)\b"),
]
#: Intents by their patterns in sources.
SOURCE_INTENTS = [
    ("thuế suất, mức thuế và cách tính", r"\b(?:thue suat|muc thue|can cu tinh thue|cach tinh|so thue phai nop)\b"),
    ("ngưỡng doanh thu, miễn thuế, không chịu thuế", r"\b(?:nguong doanh thu|mien thue|giam thue|khong chiu thue|khong phai nop)\b"),
    ("khai thuế, hồ sơ và mẫu biểu", r"\b(?:khai thue|to khai|ho so|mau bieu|phu luc)\b"),
    ("thời hạn khai, nộp và xử lý", r"\b(?:thoi han|han nop|cham nhat|thoi gian giai quyet)\b"),
    ("hóa đơn và chứng từ", r"\b(?:hoa don|chung tu|may tinh tien)\b"),
    ("khấu trừ thuế, chi phí được trừ", r"\b(?:khau tru|chi phi duoc tru|thue dau vao|giam tru)\b"),
    ("hoàn thuế", r"\b(?:hoan thue|hoan gtgt)\b"),
    ("quyết toán thuế", r"\b(?:quyet toan|uy quyen quyet toan)\b"),
    ("đăng ký thuế và mã số thuế", r"\b(?:dang ky thue|ma so thue|cham dut hieu luc ma so thue)\b"),
    ("xử phạt, tiền chậm nộp và cưỡng chế", r"\b(?:xu phat|tien cham nop|cham nop|cuong che|vi pham)\b"),
    ("phân bổ nghĩa vụ thuế, khai tập trung", r"\b(?:phan bo|khai tap trung|dia phuong khac)\b"),
    ("sửa đổi, bổ sung, thay thế và đối chiếu", r"\b(?:sua doi|bo sung|thay the|bai bo|diem moi)\b"),
]
SOURCE_RULES = [(group, n, label, pattern) for group, table in (("area", SOURCE_AREAS), ("subject", SOURCE_SUBJECTS), ("intent", SOURCE_INTENTS)) for n, (label, pattern) in enumerate(table)]
#: Which of a question's intents a source has to share, first match.
PRIMARY = [
    "hoàn thuế",
    "quyết toán thuế",
    "xử phạt, tiền chậm nộp và cưỡng chế",
    "hóa đơn và chứng từ",
    "khấu trừ thuế, chi phí được trừ",
    "đăng ký thuế và mã số thuế",
    "ngưỡng doanh thu, miễn thuế, không chịu thuế",
    "thuế suất, mức thuế và cách tính",
    "phân bổ nghĩa vụ thuế, khai tập trung",
    "sửa đổi, bổ sung, thay thế và đối chiếu",
    "khai thuế, hồ sơ và mẫu biểu",
    "thời hạn khai, nộp và xử lý",
]


def labels_of(text: Column, rules: list[tuple], kind: str) -> Column:
    """All labels of one kind that a normalised text has, in the order of the rules; an empty array if none matches."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(T.says(text, p), label) for k, _, label, p in rules if k == kind])))


def source_relevance(queries: DataFrame, candidates: DataFrame, query: str = "query", candidate: str = "body") -> DataFrame:
    """Relevance of each candidate for each query: matched areas, intents and subjects, an administration bridge and shared tokens;
    below zero for sources without a tax word, for another audience, without the question's primary intent, or off its area.

    All that is asked of a candidate's text is taken from it before it meets the queries; of its tokens those that a query set of a block can have.
    """
    n, body = F.col("normalised"), F.col("body")
    asked = queries.select("qid", T.once(T.normalise_plain(F.col(query))).alias("normalised"))
    tokens = F.array_distinct(F.filter(F.split(n, "[^a-z0-9]+"), lambda t: (F.length(t) > 2) & ~t.isin(RELEVANCE_STOP) & ~t.rlike(r"^20\d{2}$")))
    asked = asked.select("qid", tokens.alias("tokens"), (n.rlike(ASKS) & ~n.rlike(HAS_REFERENCE)).alias("asks"), *[labels_of(n, RULES, k).alias(f"{k}s") for k in CAPS])
    asked = asked.withColumn("primary", F.coalesce(*[F.when(F.array_contains("intents", x), x) for x in PRIMARY]))
    held = candidates.select("cid", T.once(T.normalise_plain(F.col(candidate))).alias("body"))
    size, words = queries.count(), F.split(body, "[^a-z0-9]+")
    if size <= BLOCK:
        held = held.crossJoin(F.broadcast(asked.agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("known"))))
        words = F.array_intersect("known", words)
    told = F.struct(
        *[labels_of(body, SOURCE_RULES, k).alias(f"c_{k}s") for k in CAPS], words.alias("words"), T.says(body, ADMINISTRATION).alias("bridge"), T.says(body, TAX_WORDS).alias("taxed"),
        (T.says(body, HOUSEHOLD) & ~T.says(body, BUSINESS)).alias("household"))
    pairs = with_queries(held.select("cid", T.once(told).alias("told")).select("cid", "told.*"), asked, size)
    for k in CAPS:
        pairs = pairs.withColumn(f"n_{k}", F.size(F.array_intersect(f"{k}s", f"c_{k}s")))
    bridge, hits = F.col("bridge"), F.size(F.array_intersect("tokens", "words"))
    points = F.col("n_area") * 3 + F.col("n_intent") * 1.6 + F.col("n_subject") * 0.7 + F.when(bridge, 1.4).otherwise(0.0) + F.least(F.lit(2.0), hits * 0.22)
    score = (
        F.when(~F.col("asks"), 1.0)
        .when(~F.col("taxed") & (F.col("n_area") == 0) & ~bridge, -5.0)
        .when(F.array_contains("subjects", SUBJECTS[1][0]) & F.col("household"), -4.5)
        .when(F.col("primary").isNotNull() & ~F.array_contains("c_intents", F.col("primary")), -3.5)
        .when((F.size("areas") > 0) & (F.col("n_area") == 0) & (F.col("n_intent") == 0) & ~bridge, -4.0)
        .otherwise(points)
    )
    return pairs.select("qid", "cid", score.alias("relevance"))


#: Intent patterns of lexical relevance.
ASKS_AMOUNT = r"\b(?:doanh thu|muc thue|thue suat|bao nhieu|co phai nop|phai nop thue|nop thue khong|mien thue|khong phai nop)\b"
POLICY = r"\b(?:chinh sach thue|doi tuong chiu thue|khong chiu thue|thu nhap chiu thue|can cu tinh thue)\b"
PROCEDURE = r"\b(?:ho so thu tuc|thu tuc quan ly thue|khai thue|mau bieu|dang ky thue)\b"
ASKS_PROCEDURE = r"\b(?:ho so|thu tuc|khai thue|mau nao|dung mau|dang ky|han nop|thoi han|quyet toan)\b"
INVOICE = r"\b(?:hoa don|may tinh tien)\b"


#: What relevance asks of a candidate's text, as bits of a number.
FLAGS = {"household": HOUSEHOLD, "policy": POLICY, "procedure": PROCEDURE, "invoice": INVOICE}


def flags_of(normalised: Column) -> Column:
    """Which of ``FLAGS`` a normalised text has."""
    return sum((F.when(T.says(normalised, p), 1 << n).otherwise(0) for n, p in enumerate(FLAGS.values())), F.lit(0)).cast("int")


def relevance_score(q: Column, n_tokens: Column, matched: Column, phrase: Column, flags: Column) -> Column:
    """Token coverage, phrase and intent boosts in [0, 3.5], from a normalised query, the shared tokens, and the candidate's flags."""
    has = {name: flags.bitwiseAND(F.lit(1 << n)) != 0 for n, name in enumerate(FLAGS)}
    intent = (
        F.when(q.rlike(HOUSEHOLD), F.when(has["household"], 0.9).otherwise(-0.25)).otherwise(0.0)
        + F.when(q.rlike(ASKS_AMOUNT), F.when(has["policy"], 1.2).otherwise(0.0) - F.when(has["procedure"], 0.45).otherwise(0.0)).otherwise(0.0)
        + F.when(q.rlike(ASKS_PROCEDURE) & has["procedure"], 1.15).otherwise(0.0)
        + F.when(q.rlike(INVOICE) & has["invoice"], 1.05).otherwise(0.0)
    )
    score = matched / n_tokens + F.when(phrase, 0.25).otherwise(0.0) + F.least(F.lit(0.12), matched * 0.02) + intent
    return F.greatest(F.lit(0.0), F.least(F.lit(3.5), score))


def lexical_relevance(queries: DataFrame, candidates: DataFrame, query: str = "query", body: str = "body", stop: list[str] = T.STOP_WORDS) -> DataFrame:
    """Token coverage, phrase and intent boosts in [0, 3.5] of every candidate for each query; 0 without a shared token.

    For small sets of candidates. Candidates are normalised once and meet the query set, which is broadcast up to a checked size. Over a
    collection, ``operators.index`` finds the same scores without pairs that share nothing.
    """
    asked = queries.select("qid", T.normalise_query(F.col(query)).alias("q"), T.significant_tokens(F.col(query), stop).alias("q_tokens"))
    held = candidates.select("cid", T.once(T.normalise_query(F.col(body))).alias("c"))
    size, tokens = queries.count(), T.distinct_tokens(T.tokens_of(F.col("c"), stop))
    if size <= BLOCK:  # of a candidate's tokens those that a query has
        held = held.crossJoin(F.broadcast(asked.agg(F.array_distinct(F.flatten(F.collect_list("q_tokens"))).alias("known"))))
        tokens = F.array_intersect("known", tokens)
    held = held.select("cid", "c", T.once(F.struct(tokens.alias("c_tokens"), flags_of(F.col("c")).alias("flags"))).alias("told")).select("cid", "c", "told.*")
    pairs = with_queries(held, asked, size)
    return scored_pairs(pairs).select("qid", "cid", "relevance")


def scored_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs (``q, q_tokens, c, c_tokens, flags``) that share a token, with their ``relevance``."""
    pairs = pairs.withColumn("matched", F.size(F.array_intersect("q_tokens", "c_tokens"))).where(F.col("matched") > 0)
    q, c = F.col("q"), F.col("c")
    return pairs.withColumn("relevance", relevance_score(q, F.size("q_tokens"), F.col("matched"), (F.length(q) > 3) & c.contains(q), F.col("flags")))


def top_candidates(scored: DataFrame, k: int, score: str = "relevance") -> DataFrame:
    """The k best candidates of each query, ties by candidate; limited in each map task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col(score).desc(), "cid"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


#: Fixed value: words of relations, of the past and of the future.
RELATION = r"\b(?:con hieu luc|het hieu luc|hieu luc den|hieu luc tu|sua doi|bo sung|thay the|bai bo|van ban nao thay|quan he phap ly)\b"
PAST = r"\b(?:tai thoi diem|vao thoi diem|trong giai doan|truoc ngay|truoc khi|truoc day|quy dinh cu|lich su|da ap dung|luc do|khi do|hoi nam|vao nam|trong nam)\b"
FUTURE = r"\b(?:sap toi|tuong lai|khi co hieu luc|sau ngay|ke tu ngay|ap dung tu)\b"
SCOPED_YEAR = r"\b(?:nam|ky tinh thue nam|ky khai nam|quyet toan nam|thoi diem nam)\s+(20\d{2})\b"


def time_intent(normalised: Column, year: int) -> Column:
    """Relationship before historical before future before current; ``year`` stands for the clock."""
    numbers = lambda p: F.transform(F.regexp_extract_all(normalised, F.lit(p), F.lit(1)), lambda y: y.cast("int"))
    scoped, every = numbers(SCOPED_YEAR), numbers(r"\b(20\d{2})\b")
    return (
        F.when(normalised.rlike(RELATION), "relationship").when(normalised.rlike(PAST), "historical")
        .when(F.exists(scoped, lambda y: y < year), "historical").when(F.exists(scoped, lambda y: y > year), "future")
        .when(normalised.rlike(FUTURE) | F.exists(every, lambda y: y > year), "future").otherwise("current")
    )


def law_decision(pairs: DataFrame, intent: str = "intent", status: str = "status") -> DataFrame:
    """Whether a document with this status may carry an answer with this time intent, and why not."""
    reason = F.when(F.col(status).isin("upcoming", "expired", "repealed", "unknown"), F.col(status)).otherwise("eligible")
    good = F.col(status).isin("effective", "partially_effective")
    allowed = F.when(F.col(intent).isin("historical", "relationship"), True).when(F.col(intent) == "future", good | (F.col(status) == "upcoming")).otherwise(good)
    return pairs.withColumn("reason", reason).withColumn("allowed", allowed)


AMOUNT = r"(\d[\d.,]*)\s*(?:(ty|trieu|nghin)\s*)?(?:dong|vnd)\b"
PERCENT = r"(\d[\d.,]*)\s*%"


def numeric_claims(text: Column) -> Column:
    """Money and percentages claimed in a text, as a sorted array of distinct strings."""
    n = T.normalise_plain(F.regexp_replace(text, r"(\d),(\d)", "$1.$2"))
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"\.(\d{3})(?=\.|$)", "$1"), r"\.(\d{3})(?=\.|$)", "$1")
    money = F.transform(
        F.arrays_zip(F.regexp_extract_all(n, F.lit(AMOUNT), F.lit(1)).alias("v"), F.regexp_extract_all(n, F.lit(AMOUNT), F.lit(2)).alias("u")),
        lambda m: F.concat(F.lit("money:"), F.round(plain(m["v"]).try_cast("double") * F.when(m["u"] == "ty", 1e9).when(m["u"] == "trieu", 1e6).when(m["u"] == "nghin", 1e3).otherwise(1.0)).cast("long").cast("string")),
    )
    rates = F.transform(F.regexp_extract_all(n, F.lit(PERCENT), F.lit(1)), lambda v: F.concat(F.lit("percent:"), F.round(plain(v).try_cast("double") * 1000).cast("long").cast("string")))
    return F.array_sort(F.array_distinct(F.filter(F.concat(money, rates), lambda x: x.isNotNull())))


def grounding_issues(answers: DataFrame) -> DataFrame:
    """``answers`` with the claims that the evidence doesn't hold, and whether a document is cited as it has to be."""
    compact = lambda c: F.regexp_replace(T.normalise_plain(c), r"\s+", "")
    rows = answers.withColumn("unsupported", F.array_except(numeric_claims(F.col("answer")), numeric_claims(F.col("evidence"))))
    wanted = F.filter(F.transform(F.split("numbers", ";"), compact), lambda n: n != "")
    cited = F.exists(wanted, lambda n: (F.length(n) >= 3) & F.contains(compact(F.col("answer")), n))
    return rows.withColumn("missing_reference", (F.size(wanted) > 0) & ~cited)


def merge_best(groups: list[DataFrame]) -> DataFrame:
    """Union of candidate lists; of each document number, else URL, the row with the highest score, first list first."""
    rows = None
    for n, group in enumerate(groups):
        part = group.withColumn("list", F.lit(n))
        rows = part if rows is None else rows.unionByName(part)
    keyed = rows.withColumn("merge_key", F.coalesce(F.nullif(T.number_key(F.col("document_number")), F.lit("")), F.lower("url")))
    best = F.row_number().over(Window.partitionBy("merge_key").orderBy(F.col("score").desc(), "list", "cid"))
    return keyed.withColumn("nth", best).where(F.col("nth") == 1).drop("nth")


def cross_check(direct: DataFrame, grounded: DataFrame, boost: float = 1.15) -> DataFrame:
    """Each grounded source is matched to a direct one by URL, else by number; agreeing matches raise the score once each, contradictions are conflicts, others are new."""
    d = direct.select("cid", "score", F.nullif(T.canonical_url(F.col("url")), F.lit("")).alias("d_url"), F.nullif(T.canonical_number(F.concat_ws(" ", "document_number", "title", "url")), F.lit("")).alias("d_number"))
    g = grounded.select("gid", F.nullif(T.canonical_url(F.col("url")), F.lit("")).alias("g_url"), F.nullif(T.canonical_number(F.concat_ws(" ", "document_number", "title", "url")), F.lit("")).alias("g_number"))
    by_url = d.where("d_url IS NOT NULL").groupBy("d_url").agg(F.min("cid").alias("url_cid"), F.min_by("d_number", "cid").alias("url_number"))
    by_number = d.where("d_number IS NOT NULL").groupBy("d_number").agg(F.min("cid").alias("number_cid"))
    rows = g.join(by_url, F.col("g_url") == F.col("d_url"), "left").join(by_number, F.col("g_number") == by_number["d_number"], "left")
    conflict = F.col("url_cid").isNotNull() & (F.col("url_number") != F.col("g_number"))
    outcome = F.when(conflict, "conflict").when(F.col("url_cid").isNotNull() | F.col("number_cid").isNotNull(), "match").when(F.col("g_url").isNull(), "ignored").otherwise("new")
    rows = rows.withColumn("outcome", outcome).withColumn("cid", F.when(F.col("outcome") == "match", F.coalesce("url_cid", "number_cid")).when(F.col("outcome") == "conflict", F.col("url_cid")))
    raised = rows.where("outcome = 'match'").groupBy("cid").agg((F.count(F.lit(1)) * boost).alias("raise"))
    return rows.select("gid", "outcome", "cid").join(direct.select("cid", "score"), "cid", "left").join(raised, "cid", "left").select("gid", "outcome", "cid", F.round(F.col("score") + F.when(F.col("outcome") == "match", F.col("raise")).otherwise(0.0), 6).alias("score"))


def relation_kind(number: Column, text: Column) -> Column:
    """How a text relates to a document, from 260 characters around its first mention in compacted text."""
    return relation_within(compacted(number), compacted(text))


def compacted(text: Column) -> Column:
    """Folded text without white space and other marks, in which ``relation_within`` looks for numbers."""
    return F.regexp_replace(T.fold(text), "[^a-z0-9/_.-]+", "")


def may_name(text: Column, numbers: list[str]) -> Column:
    """Whether a text as it stands may mention one of some numbers once it is compacted: their digits and slashes follow each other in it without others between."""
    return text.rlike("|".join("[^0-9/]*+".join(re.findall("[0-9/]", n)) for n in numbers))


def relation_within(number: Column, text: Column) -> Column:
    """``relation_kind`` of a compacted number and text."""
    n, t = number, text
    at = F.call_function("instr", t, n)
    window = F.when(at > 0, F.substring(t, F.greatest(F.lit(1), at - 260), F.length(n) + 260 + F.least(F.lit(260), at - 1)))
    return F.when(window.rlike("thaythe"), "replacement").when(window.rlike("suadoi|bosung|dinhchinh"), "amendment").when(window.rlike("baibo|hethieuluc"), "repeal")
