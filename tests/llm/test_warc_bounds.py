"""Reading archives under small bounds of rows and bytes gives the same records."""

from quillon.llm import warc


def test_bounded_reading_returns_all_records(spark, tmp_path):
    rows = [(n, f"https://example.org/{n}", "x" * (n * 400) + str(n % 5)) for n in range(40)] + [(40, None, None), (41, "https://example.org/big", "y" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")
    manifest = warc.write_archives(warc.plan_records(pages, 100), f"file://{tmp_path}/w").cache()
    whole = {r["page_id"]: (r["record_type"], r["payload_digest"], r["payload"]) for r in warc.read_archives(manifest).collect()}
    assert len(whole) == len(rows)
    for n, size in ((1, 1 << 30), (500, 10), (3, 5000)):
        assert {r["page_id"]: (r["record_type"], r["payload_digest"], r["payload"]) for r in warc.read_archives(manifest, True, n, size).collect()} == whole
