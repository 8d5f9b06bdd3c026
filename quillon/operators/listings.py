"""Candidates from result pages, listings, gazettes and article pages, and acceptance of page transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import publishing as P

#: Links of listings, document numbers there, and the topic that a listing is filtered by.
DOCUMENT_LINK = r"""(?is)<a\b[^>]*href=["']([^"']*docid=\d+[^"']*)["'][^>]*>(.*?)</a>"""
LISTED_NUMBER = r"(?iu)\b\d{1,4}(?:\.\d+)?\s*/\s*20\d{2}\s*/\s*(?:NĐ-CP|ND-CP|TT-BTC|NQ-CP|QĐ-TTg|QH\d*|UBTVQH\d*)\b"
LISTED_TOPIC = r"(?iu)(?:thuế|hóa đơn|lệ phí|phí|hải quan|quản lý thuế|đăng ký thuế|mã số thuế|giao dịch liên kết|chống rửa tiền|trao đổi thông tin theo yêu cầu về thuế)"
#: Type and issuer by the end of a document number, first match.
TYPE_BY_SUFFIX = [("/NĐ-CP", "Nghị định"), ("/TT-BTC", "Thông tư"), ("/NQ-CP", "Nghị quyết"), ("/QĐ-TTg", "Quyết định"), (r"/(?:QH\d*|UBTVQH\d*)", "Luật")]
ISSUER_BY_SUFFIX = [("/TT-BTC", "Bộ Tài chính"), ("/(?:NĐ-CP|NQ-CP)", "Chính phủ"), ("/QĐ-TTg", "Thủ tướng Chính phủ"), (r"/(?:QH\d*|UBTVQH\d*)", "Quốc hội")]
#: Scores of exact, related and other hits.
RESULT_SCORES, GAZETTE_SCORES = (4.8, 1.8, 0.65), (5.2, 3.4, 1.4)
#: Fixed value: extraction methods, best first.
EXTRACTION_METHODS = ["docx", "doc", "pdf_text", "html", "ocr"]
#: Rules of the legal text normaliser for a whole text and for each of its lines, in order.
LEGAL_TEXT_RULES = [
    ("\r\n?", "\n"), ("[\t\xa0\u2007\u202f]+", " "),
    (r"(?imu)^(?:\s*#{1,6}\s*)?(?:\*\*|__)\s*((?:Điều|Chương|Mục|Phần)\s+[^\n]{1,240}?)\s*(?:\*\*|__)(\s|\z)", "$1\n$2"),
    (r"(?imu)(^|\n)\s*(Điều|Chương|Mục|Phần)\s*\n\s*([0-9IVXLC]+[a-zA-Z]?\s*[.:]?)", "$1$2 $3"),
]
LEGAL_LINE_RULES = [(r"^\s*#{1,6}\s*", ""), (r"(?:\*\*|__)([^*_\n]+)(?:\*\*|__)", "$1"), (r"^\s*(?:\*\*|__)\s*", ""), (r"\s*(?:\*\*|__)\s*$", ""), (" {2,}", " ")]
#: What a text must hold for the rules to change it: marks, blanks or other white space where lines begin and end.
BOLD = ["**", "__"]
LEGAL_TEXT_MARKS = [["\t", "\xa0", "\u2007", "\u202f"], BOLD, ["\n"]]
LEGAL_LINE_MARKS = [*BOLD, "#", "  ", " \n", "\n ", "\x0b", "\f", "\r", "\xa0", "\ufeff", "\x85", "\u2028", "\u2029"]
#: Marks of pages and unread places in transcripts, broken ends. Word boundaries know ASCII alone: before Điều one is a letter or digit.
PAGE_MARK = r"(?imu)^\s*(?:---\s*)?(?:TRANG|PAGE)\s+(\d+)(?:\s*/\s*\d+)?(?:\s*---)?\s*$"
PROVISION_MARK = r"(?iu)(?:[A-Za-z0-9_]Điều|(?:^|[^A-Za-z0-9_])(?:Chương|Mục|Khoản))\s+[0-9IVXLC]+"
UNREAD, BROKEN_END = r"(?iu)\[không đọc rõ\]", r"(?i)MAX_TOKENS|RECITATION|SAFETY|BLOCK"
#: Content containers, the page's frame, tails of articles, and structure counted in a candidate.
ARTICLE_TAG = r"(?is)<article\b[^>]*>(.*?)</article>"
CONTENT_TAG = r"""(?is)<(?:div|section)\b[^>]*(?:class|id)=["'][^"']*(?:detail-content|article-content|detail__content|article__body|news-content|content-detail)[^"']*["'][^>]*>(.*?)</(?:div|section)>"""
FRAME_RULES = [(rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ") for tag in ("header", "nav", "footer", "aside", "form")]
ARTICLE_TAILS = r"(?iu)\n(?:Nội dung này, đã nhận được|Góp ý, hiến kế|Từ khóa:|©\s*BÁO ĐIỆN TỬ CHÍNH PHỦ)"
COMPLETENESS = [(r"(?imu)^\s*Điều\s+\d+[a-zA-Z]?\b", 1_000_000), (r"(?imu)^\s*Chương\s+[IVXLC\d]+\b", 100_000), (r"(?m)^\s*\d+\.\s+", 1_000)]
ARTICLE_SPACE_RULES = [("\r\n?", "\n"), ("[\t\xa0]+", " "), (" {2,}", " "), ("\n +", "\n"), ("\n{3,}", "\n\n")]

#: References of HTML, and the named ones.
_REFERENCE = r"&(#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[a-zA-Z]+);"
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}


def _strip(text: Column) -> Column:
    return T.strip(text)


def _utf8(hexadecimal: Column) -> Column:
    return F.decode(F.unhex(F.lpad(hexadecimal, 8, "0")), "UTF-32")


def decode_references(text: Column) -> Column:
    """Decimal, hexadecimal and the six named character references decoded in one pass; unknown and impossible ones stay."""
    names = F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(1))
    pieces = F.split(text, _REFERENCE)

    def character(name: Column) -> Column:
        point = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 8), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 8)).cast("int")
        known = F.element_at(F.create_map(*[F.lit(x) for pair in _NAMED.items() for x in pair]), F.lower(name))
        possible = point.between(1, 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        return F.coalesce(known, F.when(possible, _utf8(F.hex(point))), F.concat(F.lit("&"), name, F.lit(";")))

    return F.array_join(F.zip_with(pieces, F.transform(names, character), lambda p, c: F.concat(p, F.coalesce(c, F.lit("")))), "")


def bare_text(html: Column) -> Column:
    """Text of a piece of markup on one line."""
    for pattern in (r"(?is)<script\b[^>]*>.*?</script>", r"(?is)<style\b[^>]*>.*?</style>", "<[^>]+>"):
        html = F.regexp_replace(html, pattern, " ")
    return _strip(F.regexp_replace(decode_references(html), f"{T.JS_SPACE}+", " "))


def resolved(link: Column, base: str) -> Column:
    """A link against a base URL; dot segments stay as they are."""
    scheme, _, rest = base.partition("://")
    host, _, path = rest.partition("/")
    folder = f"{scheme}://{host}/{path.partition('?')[0].rpartition('/')[0]}".rstrip("/") + "/"
    return (
        F.when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(F.lit(scheme + ":"), link))
        .when(link.startswith("/"), F.concat(F.lit(f"{scheme}://{host}"), link)).when(link.startswith("?"), F.concat(F.lit(base.partition("?")[0]), link)).otherwise(F.concat(F.lit(folder), link))
    )


def document_links(pages: DataFrame, key: str, html: str, base: str, before: int, after: int) -> DataFrame:
    """Links to documents of one official root domain, in page order, each with its anchor's text and the text around it.

    Places are summed inside the row from the pieces between links, so a page isn't shuffled and each row out has its window alone.
    """
    page = F.col(html)
    hits, pieces = F.regexp_extract_all(page, F.lit(DOCUMENT_LINK), F.lit(0)), F.split(page, DOCUMENT_LINK)
    sizes = F.zip_with(F.slice(pieces, 1, F.size(hits)), hits, lambda p, h: F.struct(F.length(p).alias("gap"), F.length(h).alias("n")))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(sizes, start, lambda s, x: F.struct((s["end"] + x["gap"] + x["n"]).alias("end"), F.concat(s["starts"], F.array(s["end"] + x["gap"])).alias("starts")), lambda s: s["starts"])

    def window(at: Column, hit: Column) -> Column:
        first = F.greatest(F.lit(0), at - before)
        return F.struct(hit.alias("hit"), F.substring(page, first + 1, at + F.length(hit) + after - first).alias("around"))

    rows = pages.select(key, F.posexplode(F.zip_with(starts, hits, window)).alias("at", "found"))
    url = resolved(decode_references(F.regexp_extract("found.hit", DOCUMENT_LINK, 1)), base)
    rows = rows.select(key, "at", T.once(url).alias("url"), T.once(bare_text(F.regexp_extract("found.hit", DOCUMENT_LINK, 2))).alias("anchor"), T.once(bare_text(F.col("found.around"))).alias("around"))
    return rows.where(F.lower(F.regexp_extract("url", r"^(?i)https?://([^/?#:]+)", 1)).endswith("chinhphu.vn"))


def _by_suffix(number: Column, cases: list[tuple[str, str]], other: str) -> Column:
    return F.coalesce(*[F.when(number.rlike(f"(?iu){p}$"), label) for p, label in cases], F.lit(other))


#: What stands behind a title in a listing, and its dates.
BEHIND_TITLE = r"(?iu)Ngày ban hành|Ngày có hiệu lực|Ngày hiệu lực|Tài liệu đính kèm"
DAY = r"\b(\d{1,2})[/.\-](\d{1,2})[/.\-](20\d{2})\b"


def listed_title(anchor: Column, around: Column, number: Column) -> Column:
    """The anchor's text, unless it is empty or names the number itself; then what follows the number, up to the listing's other fields."""
    rest = F.regexp_replace(around, F.concat(F.lit(r"(?isu)^.*?"), number, F.lit(r"\s*")), F.lit(""))
    rest = F.trim(F.get(F.split(rest, BEHIND_TITLE, 2), F.lit(0)))
    return F.when((anchor != "") & ~F.contains(anchor, number), anchor).when(rest != "", rest).otherwise(F.concat(F.lit("Văn bản số "), number))


def listed_day(text: Column, label: str = "") -> Column:
    """The first day of a text, behind a label if one is given; null if there is none or it doesn't exist."""
    pattern = f"(?isu){label}{DAY}" if label else DAY
    part = lambda n: F.regexp_extract(text, pattern, n)
    day = F.try_to_date(F.concat_ws("-", part(3), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0")), "yyyy-MM-dd")
    return F.when(text.rlike(pattern), F.date_format(day, "yyyy-MM-dd"))


#: Labels of the days of issue and of effect, and how far behind them the day may stand.
ISSUED, EFFECTIVE = r"Ngày ban hành[^0-9]{0,20}", r"(?:Ngày có hiệu lực|Ngày hiệu lực)[^0-9]{0,20}"


def listed_documents(pages: DataFrame, key: str, html: str, base: str, cap: int = 20) -> DataFrame:
    """The first ``cap`` documents of a listing on the topic, one for a number, with title and days, type and issuer by their number."""
    rows = document_links(pages, key, html, base, 500, 1_500)
    both = F.concat_ws(" ", "anchor", "around")
    rows = rows.select(key, "at", "url", "anchor", "around", both.alias("both"), F.regexp_replace(F.regexp_extract(both, LISTED_NUMBER, 0), r"\s+", "").alias("number"))
    rows = rows.where((F.col("number") != "") & F.col("both").rlike(LISTED_TOPIC))
    first = F.row_number().over(Window.partitionBy(key, F.lower("number")).orderBy("at"))
    rows = rows.withColumn("nth", first).where("nth = 1").withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("at"))).where(F.col("rank") <= cap)
    rows = rows.withColumn("title", listed_title(F.col("anchor"), F.col("around"), F.col("number")))
    rows = rows.withColumn("issued", F.coalesce(listed_day(F.col("both"), ISSUED), listed_day(F.col("both")))).withColumn("effective", listed_day(F.col("both"), EFFECTIVE))
    return rows.select(key, "rank", "number", "url", "anchor", "title", "issued", "effective", _by_suffix(F.col("number"), TYPE_BY_SUFFIX, "Văn bản pháp luật").alias("type"), _by_suffix(F.col("number"), ISSUER_BY_SUFFIX, "").alias("issuer"))


def found_documents(pages: DataFrame, key: str, html: str, hint: str, base: str, cap: int = 18) -> DataFrame:
    """Scored candidates of a result page: the hinted number itself, related ones, others; one for a URL, best first."""
    rows = document_links(pages, key, html, base, 450, 1_100).where("anchor <> ''").join(pages.select(key, T.number_key(F.col(hint)).alias("hint")), key)
    snippet = F.left("around", F.lit(1_400))
    number = F.regexp_replace(F.regexp_extract(F.concat_ws(" ", "anchor", snippet), T.FULL_NUMBER, 0), r"\s+", "")
    rows = rows.withColumn("snippet", snippet).withColumn("number", number)
    exact, related, other = RESULT_SCORES
    h = F.col("hint")
    near = (F.length(h) >= 4) & (F.contains(T.number_key(F.col("anchor")), h) | F.contains(T.number_key(F.col("snippet")), h))
    rows = rows.withColumn("score", F.when((F.col("number") != "") & (T.number_key(F.col("number")) == h), exact).when(near, related).otherwise(other))
    first = F.row_number().over(Window.partitionBy(key, "url").orderBy("at"))
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), "at"))
    return rows.withColumn("nth", first).where("nth = 1").withColumn("rank", best).where(F.col("rank") <= cap).select(key, "rank", "url", "anchor", "number", "score")


def gazette_score(number: Column, hint: Column, base: Column) -> Column:
    """Score of a gazette's row: its number is the hint, holds it, or its own score within one point."""
    n, h = T.number_key(number), T.number_key(hint)
    exact, related, other = GAZETTE_SCORES
    own = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(base, F.lit(0.0)), F.lit(0.0))))
    return F.when((F.length(h) >= 4) & (n == h), exact).when((F.length(h) >= 4) & n.contains(h), related).otherwise(own + other)


def method_rank(method: Column) -> Column:
    """Place of an extraction method, unknown ones last."""
    return F.coalesce(*[F.when(method == m, n) for n, m in enumerate(EXTRACTION_METHODS)], F.lit(2**31 - 1))


def normalise_legal(text: Column) -> Column:
    """Bold and numbered headings freed of markdown, structure words joined to their numbers, lines and blank lines cleaned."""
    def cleaned(t: Column) -> Column:
        return F.array_join(F.transform(F.split(t, "\n"), lambda x: _strip(T.replace_all(x, LEGAL_LINE_RULES))), "\n")

    text = T.unix_lines(text)
    for marks, (pattern, by) in zip(LEGAL_TEXT_MARKS, LEGAL_TEXT_RULES[1:], strict=True):
        text = T.replaced_where(text, marks, pattern, by)
    return _strip(T.replaced_where(T.where_has(text, LEGAL_LINE_MARKS, cleaned), ["\n\n\n"], "\n{3,}", "\n\n"))


def accept_transcripts(rows: DataFrame, key: str) -> DataFrame:
    """Checks of a whole document's transcript, as codes in a fixed order; ``rows`` has ``key, raw, text, score, total_pages, finish``."""
    n, pages = F.length("text"), F.col("total_pages")
    marks = F.array_distinct(F.filter(F.regexp_extract_all("raw", F.lit(PAGE_MARK), F.lit(1)).cast("array<int>"), lambda p: p >= 1))
    least = F.greatest(F.lit(800), F.least(F.greatest(F.lit(1), pages), F.lit(80)) * 260)
    rows = rows.select(key, "text", "score", pages, "finish", F.size(marks).alias("page_marks"), least.alias("least"))
    checks = {
        "broken_end": F.col("finish").rlike(BROKEN_END),
        "short": n < F.col("least"),
        "score": F.col("score") < 0.68,
        "page_marks": (pages >= 4) & (F.col("page_marks") > 0) & (F.col("page_marks") < F.ceil(pages * 0.7)),
        "unread": F.regexp_count("text", F.lit(UNREAD)) > F.greatest(F.lit(3), F.ceil(pages * 0.35)),
        "structure": (pages >= 2) & (F.regexp_count("text", F.lit(PROVISION_MARK)) < 2),
    }
    codes = F.array_compact(F.array(*(F.when(c, F.lit(code)) for code, c in checks.items())))
    return rows.select(key, F.array_join(codes, ",").alias("warnings"), (F.size(codes) == 0).alias("accepted"), "page_marks")


def completeness(text: Column) -> Column:
    """Articles before chapters before clauses before length."""
    return sum((F.regexp_count(text, F.lit(p)).cast("long") * weight for p, weight in COMPLETENESS), F.least(F.length(text), F.lit(999_999)).cast("long"))


def _quoted_body(html: Column) -> Column:
    """The article body of a page's JSON-LD as an array of at most one text. Escaped backslashes are set aside, so that the
    closing quote is the first one without a backslash, without a pattern that recurses over a long body."""
    opening = r'(?is)^.*?"articleBody"\s*:\s*"'
    rest = F.when(html.rlike(r'(?i)"articleBody"\s*:\s*"'), F.regexp_replace(F.regexp_replace(html, opening, ""), r"\\\\", "\x01"))
    body = F.replace(F.split(rest, r'(?<!\\)"', 2)[0], F.lit("\x01"), F.lit("\\\\"))
    return F.array_compact(F.array(F.from_json(F.concat(F.lit('{"v":"'), body, F.lit('"}')), "v STRING")["v"]))


def _dashed(text: Column) -> Column:
    return F.regexp_replace(T.fold(text), "[^a-z0-9]+", "-")


def article_bodies(pages: DataFrame, key: str, html: str, number: str, places: int = 8) -> DataFrame:
    """The most complete text of each page for its document number: from JSON-LD, articles, content blocks, or the page without
    its frame; each cut two lines before a mention of the number (the first ``places`` mentions are tried) and at the article's tail.
    Texts that pass the gate of usable ones come first; pages without the whole number have no row."""
    page = F.col(html)
    texts = lambda p: F.transform(F.regexp_extract_all(page, F.lit(p), F.lit(1)), T.html_to_text)
    every = F.concat(_quoted_body(page), texts(ARTICLE_TAG), texts(CONTENT_TAG), F.array(T.html_to_text(T.replace_all(page, FRAME_RULES))))
    wanted = T.number_key(F.col(number))
    rows = pages.where(F.col(number).isNotNull() & page.isNotNull()).select(key, wanted.alias("wanted"), F.posexplode(every).alias("source", "text"))
    rows = rows.select(key, "wanted", "source", T.once(F.split(_strip(T.replace_all(F.col("text"), ARTICLE_SPACE_RULES)), "\n")).alias("lines"))
    at = F.filter(F.transform("lines", lambda x, i: F.when(F.contains(T.number_key(x), F.col("wanted")), i)), lambda i: i.isNotNull())
    rows = rows.select(key, "wanted", "source", "lines", F.posexplode(F.slice(at, 1, places)).alias("try", "place"))
    tail = F.slice("lines", F.greatest(F.lit(1), F.col("place") - 1), F.size("lines"))
    text = _strip(F.split(F.array_join(tail, "\n"), ARTICLE_TAILS, 2)[0])
    rows = rows.select(key, "wanted", "source", "try", T.once(text).alias("text")).where(F.contains(_dashed(F.col("text")), _dashed(F.col("wanted"))))
    rows = rows.withColumn("usable", P.usable_text(F.col("text"), F.col("wanted")))
    order = F.struct("usable", completeness(F.col("text")).alias("score"), (-F.col("source")).alias("s"), (-F.col("try")).alias("t"))
    return rows.groupBy(key).agg(F.max_by(F.struct("source", "text"), order).alias("best"), F.max(order).alias("order")).select(key, "best.source", "order.score", "order.usable", "best.text")


def curated_number(query: Column, numbers: list[str]) -> Column:
    """The first of a stated list of document numbers that a query holds, white space and accents aside."""
    asked = T.number_key(query)
    return F.coalesce(*[F.when(asked.contains(T.number_key(F.lit(n))), F.lit(n)) for n in numbers], F.lit(None))
