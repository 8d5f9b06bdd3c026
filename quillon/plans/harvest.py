"""Links harvested from nested JSON that is made of all events, and its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import harvest as H
from quillon.plans.retrieval import table

ENDS = [".docx", ".doc?v=2", ".pdf", "/page"]


def nested(events: DataFrame) -> DataFrame:
    """``event_id, json``: an event's own properties among lists and objects that hold links at several depths, one of them too deep."""
    n, kind = F.col("event_id").cast("string"), F.col("event_type")
    end = F.get(F.array(*map(F.lit, ENDS)), (F.col("event_id") % len(ENDS)).cast("int"))
    parts = ['{"id":', n, ',"p":', F.coalesce("props", F.lit("null")), ',"files":["https://example.org/', kind, "/", n, end, '",{"x":{"y":{"z":["http://a.example/', n, '","see https://b.example/', n, '.pdf."]}}}],"q":{"r":[[[{"s":["https://too.deep.example/"]}]]]}}']
    return events.select("event_id", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("json"))


def harvested_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.best_links(nested(table(spark, sf_dir, "events")), "event_id", "json")


QUERIES = {"harvested_links": harvested_links}

ORACLE = {
    "harvested_links": r"""
WITH j AS (SELECT event_id, '{"id":' || event_id || ',"p":' || coalesce(props, 'null') || ',"files":["https://example.org/' || event_type || '/' || event_id || CASE event_id % 4 WHEN 0 THEN '.docx' WHEN 1 THEN '.doc?v=2' WHEN 2 THEN '.pdf' ELSE '/page' END
  || '",{"x":{"y":{"z":["http://a.example/' || event_id || '","see https://b.example/' || event_id || '.pdf."]}}}],"q":{"r":[[[{"s":["https://too.deep.example/"]}]]]}}' AS json FROM events),
s AS (SELECT event_id, t.fullkey AS path, json_extract_string(t.value, '$') AS text FROM j, json_tree(j.json) t WHERE t.type = 'VARCHAR' AND len(regexp_extract_all(t.fullkey, '\.[A-Za-z0-9_"]+|\[\d+\]')) <= 6),
l AS (SELECT event_id, path, regexp_replace(unnest(CASE WHEN len(regexp_extract_all(text, 'https?://[^\s"''<>]+')) = 0 THEN [NULL] ELSE regexp_extract_all(text, 'https?://[^\s"''<>]+') END), '[.,;:!?)\]]+$', '') AS link FROM s),
r AS (SELECT *, CASE WHEN regexp_matches(link, '\.docx(?:$|[?#])', 'i') THEN 0 WHEN regexp_matches(link, '\.doc(?:$|[?#])', 'i') THEN 1 WHEN regexp_matches(link, '\.pdf(?:$|[?#])', 'i') THEN 2 ELSE 3 END AS kind FROM l)
SELECT event_id, count(DISTINCT path) AS n_strings, count(DISTINCT link) AS n_links, arg_min(link, kind || ' ' || link) FILTER (WHERE link IS NOT NULL) AS best FROM r GROUP BY event_id""",
}
