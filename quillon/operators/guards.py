"""Guards over responses, enrichment of questions, and schedules as ordered decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T

SUFFIX = " Ngữ cảnh tra cứu pháp lý: {}. Ưu tiên quy định còn hiệu lực đúng thời kỳ; đối chiếu văn bản sửa đổi, bổ sung, thay thế và không dùng văn bản hết hiệu lực toàn bộ."


def enriched(plans: DataFrame, query: str, day: str, cap: int = 490) -> Column:
    """A question with its context behind it: areas, subjects, intents, and its years or the day of asking; other texts as they are."""
    def part(label: str, column: str) -> Column:
        return F.when(F.size(column) > 0, F.concat(F.lit(f"{label}: "), F.array_join(column, ", ")))

    period = F.coalesce(part("thời kỳ người dùng nêu", "years"), F.lit(f"áp dụng tại ngày {day}"))
    context = F.concat_ws("; ", part("lĩnh vực", "areas"), part("đối tượng", "subjects"), part("nghiệp vụ", "intents"), period)
    head, tail = SUFFIX.split("{}")
    return F.when(~F.col("asks") | F.col("cites"), F.trim(query)).otherwise(F.trim(F.left(F.concat(F.trim(query), F.lit(head), context, F.lit(tail)), F.lit(cap))))


def guarded(responses: DataFrame) -> DataFrame:
    """Responses behind all guards, in a fixed order: expired and repealed documents go, shells lose their text, conflicts and low
    relevance cap the confidence. ``responses`` has ``status, shell, conflict, verified, relevance, confidence``."""
    blocked = F.col("status").isin("expired", "repealed") | (F.col("relevance") < 1.4)
    rows = responses.withColumn("reason", F.when(F.col("status").isin("expired", "repealed"), F.col("status")).when(F.col("relevance") < 1.4, "irrelevant").when(F.col("shell"), "shell").when(F.col("conflict") & ~F.col("verified"), "conflict"))
    confidence = F.col("confidence")
    confidence = F.when(F.col("shell"), F.least(confidence, F.lit(0.55))).otherwise(confidence)
    confidence = F.when(F.col("conflict") & ~F.col("verified"), F.least(confidence, F.lit(0.38))).otherwise(confidence)
    confidence = F.when(blocked, F.least(confidence, F.lit(0.38))).otherwise(confidence)
    return rows.withColumn("shown", ~blocked & ~F.col("shell")).withColumn("confidence", confidence)


def recent(rows: DataFrame, issued: str, number: str, today: str, days: int = 120) -> Column:
    """Issued within the last days, or undated with a number of the current year."""
    day = F.col(issued).try_cast("date")
    now = F.lit(today).cast("date")
    return F.coalesce(day.between(F.date_sub(now, days), now), F.col(number).contains("/" + today[:4] + "/"), F.lit(False))


def needs_run(files: DataFrame, now: str, stale_seconds: int = 270) -> DataFrame:
    """Whether a file's recognition has to run: not done, no retry pending, and stale, partial, failed for a passing reason or unfinished."""
    clock = F.unix_timestamp(F.lit(now).cast("timestamp"))
    at = lambda c: F.unix_timestamp(F.try_to_timestamp(c))
    passing = (F.col("status") == "failed") & F.coalesce("error", F.lit("")).rlike(r"(?i)429|quota|rate limit|resource exhausted|too many requests|timeout|fetch failed|network")
    pdf = F.col("content_type").contains("pdf") | F.lower("name").endswith(".pdf")
    run = (
        F.when(~pdf | F.col("status").isin("ready", "unsupported"), False).when(at("next_try") > clock, False)
        .when(F.col("status") == "processing", F.coalesce(clock - at("updated_at") >= stale_seconds, F.lit(True)))
        .when((F.col("status") == "ocr_partial") | passing, True).otherwise(F.coalesce((F.col("method") == "pdf_ocr") & (F.col("done") < F.col("pages")), F.lit(False)))
    )
    return files.withColumn("run", run)


def best_match(sheets: DataFrame, target: DataFrame) -> DataFrame:
    """The source sheet that shares the most headers with the target, if it shares enough: at least two and two fifths of up to eight."""
    name = T.header_key(F.col("header"))
    wanted = target.select(name.alias("name")).where("name <> ''").distinct()
    shared = sheets.select("sheet", name.alias("name")).distinct().join(wanted, "name").groupBy("sheet").agg(F.count(F.lit(1)).alias("shared"))
    size = wanted.agg(F.count(F.lit(1)).alias("n"))
    enough = F.greatest(F.lit(2), F.ceil(F.least(F.col("n"), F.lit(8)) * 0.4))
    ranked = shared.crossJoin(F.broadcast(size)).where(F.col("shared") >= enough)
    return ranked.orderBy(F.col("shared").desc(), "sheet").limit(1).select("sheet", "shared")
