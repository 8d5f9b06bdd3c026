import datetime as dt


from quillon.streaming import discovery as S


def events(spark, path, rows):
    spark.createDataFrame(rows, "key STRING, at TIMESTAMP").coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema("key STRING, at TIMESTAMP").option("maxFilesPerTrigger", 1).parquet(path)


def at(minute, hour=0):
    return dt.datetime(2024, 1, 1, hour, minute)


def run(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_claims_keep_the_first_of_each_hour(spark, tmp_path):
    path = str(tmp_path / "in")
    events(spark, path, [("a", at(1)), ("a", at(2)), ("b", at(3)), ("a", at(5, 1))])
    got = run(S.claims(stream(spark, path), "key", "at"), tmp_path, "claims")
    assert got.count() == 3


def test_claims_hold_for_the_whole_hour(spark, tmp_path):
    path = str(tmp_path / "in")
    for rows in ([("a", at(5))], [("b", at(45))], [("b", at(46))], [("a", at(50))], [("a", at(3, 1))], [("c", at(58))], [("a", at(5, 3))], [("a", at(50, 3))]):
        events(spark, path, rows)
    got = run(S.claims(stream(spark, path), "key", "at"), tmp_path, "whole_hours")
    assert sorted((r["key"], r["at"]) for r in got.collect()) == [("a", at(5)), ("a", at(3, 1)), ("a", at(5, 3)), ("b", at(45)), ("c", at(58))]


def test_rate_limit_windows_start_at_the_first_event(spark, tmp_path):
    path = str(tmp_path / "in")
    events(spark, path, [("a", at(0)), ("a", at(0)), ("a", at(0)), ("b", at(0))])
    events(spark, path, [("a", at(1)), ("a", at(1))])
    got = run(S.rate_limits(stream(spark, path), "key", "at", 60, 2), tmp_path, "limits")
    rows = sorted((r["key"], r["us"], r["place"], r["allowed"]) for r in got.collect())
    assert [(k, p, ok) for k, _, p, ok in rows] == [("a", 1, True), ("a", 2, True), ("a", 3, False), ("a", 1, True), ("a", 2, True), ("b", 1, True)]


def test_rate_limit_state_goes_with_the_watermark(spark, tmp_path):
    path = str(tmp_path / "in")
    for minute in (0, 1, 30, 50):
        events(spark, path, [("a" if minute < 30 else f"k{minute}", at(minute))])
    limited = S.rate_limits(stream(spark, path), "key", "at", 60, 1, "1 minute")
    q = limited.writeStream.format("memory").queryName("going").outputMode("append").option("checkpointLocation", str(tmp_path / "going")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["key"], r["place"], r["allowed"]) for r in spark.table("going").collect()} == {("a", 1, True), ("k30", 1, True), ("k50", 1, True)}
    kept = spark.read.format("statestore").option("stateVarName", "window").load(str(tmp_path / "going")).count()
    assert kept == 1


def test_first_seen_index_forgets_and_keeps_two_versions(spark, tmp_path):
    index = S.FirstSeen(str(tmp_path / "index"), "key", "at", keep_days=1)
    days = [dt.datetime(2024, 1, d) for d in (1, 2, 4, 5)]
    for number, day in enumerate(days):
        index(spark.createDataFrame([(f"k{number}", day), ("a", day)], "key STRING, at TIMESTAMP"), number)
    assert {r["key"] for r in index.index(spark, 3).collect()} == {"a", "k2", "k3"}
    assert sorted(p.name for p in (tmp_path / "index").iterdir()) == ["version=2", "version=3"]


def test_first_seen_index_and_dispatch_survive_a_repeated_batch(spark, tmp_path):
    one = spark.createDataFrame([("a", at(1)), ("b", at(2))], "key STRING, at TIMESTAMP")
    two = spark.createDataFrame([("a", at(9)), ("c", at(9))], "key STRING, at TIMESTAMP")
    index, sent = S.FirstSeen(str(tmp_path / "index"), "key", "at"), S.Dispatch(str(tmp_path / "sent"), "key")
    for number, batch in ((0, one), (1, two), (1, two)):
        index(batch, number)
        sent(batch, number)
    rows = {r["key"]: (r["first_seen"], r["last_seen"]) for r in index.index(spark, 1).collect()}
    assert rows == {"a": (at(1), at(9)), "b": (at(2), at(2)), "c": (at(9), at(9))}
    assert sorted(r["key"] for r in spark.read.parquet(str(tmp_path / "sent")).collect()) == ["a", "b", "c"]


def test_daily_counts(spark, tmp_path):
    path = str(tmp_path / "in")
    events(spark, path, [("a", at(1)), ("a", at(2)), ("b", at(3))])
    got = run(S.daily_counts(stream(spark, path), "key", "at"), tmp_path, "days", "complete")
    assert {(r["key"], r["n"]) for r in got.collect()} == {("a", 2), ("b", 1)}
