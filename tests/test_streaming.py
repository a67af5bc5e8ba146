from timberline.plans.parser import parse_selector
from timberline.sources import tables
from timberline.streaming import live

S = 10**9
NOW = 1_700_000_000 * S


def rows(spark, *entries):
    return spark.createDataFrame([("t", NOW + ts, {"app": a}, line, {}) for ts, a, line in entries], tables.LOGS)


def test_ingest_accepts_dedupes_and_limits(spark, tmp_path):
    src, out, bad = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "bad")
    run = lambda: live.ingest(spark.readStream.schema(tables.LOGS).parquet(src), out, str(tmp_path / "ck"), bad, clock=lambda: NOW, max_streams=2).awaitTermination()
    rows(spark, (0, "a", "x"), (0, "a", "x"), (-live.MAX_AGE_NS, "a", "old"), (-live.MAX_AGE_NS - 1, "a", "too old"), (live.MAX_AHEAD_NS + 1, "a", "too new")).write.mode("append").parquet(src)
    run()
    assert {r.line for r in live.landed(spark, out).collect()} == {"x", "old"} and live.landed(spark, out).count() == 2
    assert {r.line for r in spark.read.parquet(bad).collect()} == {"too old", "too new"}
    rows(spark, (0, "a", "x"), (1, "b", "new"), (1, "c", "over the limit")).write.mode("append").parquet(src)
    run()
    assert {r.line for r in live.landed(spark, out).collect()} == {"x", "old", "new"} and live.landed(spark, out).count() == 3


def test_tail_stream_and_cursor(spark, tmp_path):
    src = str(tmp_path / "in")
    rows(spark, (1 * S, "a", "x"), (1 * S, "a", "x"), (2 * S, "a", "y"), (2 * S, "b", "z")).write.parquet(src)
    q = live.tail(spark.readStream.schema(tables.LOGS).parquet(src), "t", parse_selector('{app="a"}'))
    q.writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.line for r in spark.table("tailed").collect()) == ["x", "y"]
    cursor, query = live.TailCursor(NOW), parse_selector("{}")
    df = rows(spark, (1 * S, "a", "x"), (2 * S, "a", "y"))
    assert [r.line for r in cursor.poll(df, "t", query, NOW + 9 * S)] == ["x", "y"]
    df = df.unionByName(rows(spark, (2 * S, "b", "z"), (3 * S, "a", "w")))
    assert [r.line for r in cursor.poll(df, "t", query, NOW + 9 * S)] == ["z", "w"]
    assert cursor.poll(df, "t", query, NOW + 9 * S) == []


def test_continuous_counts(spark, tmp_path):
    src = str(tmp_path / "in")
    rows(spark, (1 * S, "a", "xx"), (2 * S, "a", "y"), (3600 * S, "a", "z")).write.parquet(src)
    q = live.continuous_counts(spark.readStream.schema(tables.LOGS).parquet(src), "1 minute")
    q.writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.entries, r.bytes) for r in spark.table("counted").collect()) == [(1, 1), (2, 3)]


def test_a_repeated_batch_has_the_same_rows(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    clock = iter([NOW, NOW + 2 * live.MAX_AGE_NS, NOW])

    def run(checkpoint):
        live.ingest(spark.readStream.schema(tables.LOGS).parquet(src), out, str(tmp_path / checkpoint), clock=lambda: next(clock), max_streams=1).awaitTermination()
        return sorted(r.line for r in live.landed(spark, out).collect())

    rows(spark, (0, "b", "second"), (0, "a", "first")).write.parquet(src)
    assert run("one") == ["first"]
    assert run("two") == ["first"]  # batch 0 again, much later by the clock
    assert [r.labels_key[0].value for r in spark.read.parquet(out + ".streams").collect()] == ["a"]


def test_a_table_without_the_list_of_streams_gets_it_from_its_rows(spark, tmp_path):
    out = str(tmp_path / "out")
    tables.write_logs(rows(spark, (0, "z", "old")), f"{out}/batch=0")
    known = live._known(spark, out, 1)
    assert [r.labels_key[0].value for r in known.collect()] == ["z"]
    assert live.new_streams(rows(spark, (0, "a", "new")), known, 1).count() == 0
    assert live.new_streams(rows(spark, (0, "a", "new"), (0, "b", "new")), known, 2).count() == 1
