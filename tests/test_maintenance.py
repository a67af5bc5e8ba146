import random

import pytest

from timberline.operators import maintenance, masks, selection, traces
from timberline.operators.policies import Policies
from timberline.plans.parser import parse_selector
from timberline.sources import tables
from timberline.sources.versions import Conflict, VersionedLogs

DAY = tables.DAY_NS


def logs(spark, *rows, tenant="t"):
    return spark.createDataFrame([(tenant, ts, {"app": a}, line, {}) for ts, a, line in rows], tables.LOGS)


def lines(df):
    return sorted(r.line for r in df.collect())


def files_of(table):
    return {r.f for r in table.load(table.folders()).selectExpr("_metadata.file_path AS f").distinct().collect()}


def test_versions_are_whole_and_fenced(spark, tmp_path):
    t = VersionedLogs(spark, str(tmp_path / "t"))
    assert t.read().count() == 0 and t.versions() == [] and t.read().columns == t.load(frozenset()).drop("gen").columns
    t.append(logs(spark, (0, "a", "x"), (DAY, "a", "y")))
    t.append(logs(spark, (0, "a", "z")))
    assert lines(t.read()) == ["x", "y", "z"] and lines(t.read(1)) == ["x", "y"]
    old = t.folders(1)
    new = t.write(t.load(old).drop("gen", "day"))
    t.commit(new, old)
    assert lines(t.read()) == ["x", "y", "z"]
    with pytest.raises(Conflict):
        t.commit(t.write(logs(spark, (0, "a", "lost"))), old)
    assert lines(t.read()) == ["x", "y", "z"] and len(t.versions()) == 3
    assert t.sweep(keep=1) == []  # orphans of late stay
    gone = t.sweep(keep=1, orphan_s=0)
    assert old <= set(gone) and len(gone) == len(old) + 1 and t.versions() == [3] and lines(t.read()) == ["x", "y", "z"]


def test_two_appends_at_once_are_both_kept(spark, tmp_path, monkeypatch):
    from timberline.sources import files

    t = VersionedLogs(spark, str(tmp_path / "t"))
    real, first = files.create, []

    def create(spark, path, content):
        if not first:
            first.append(1)
            VersionedLogs(spark, t.path).append(logs(spark, (1, "a", "other")))
        return real(spark, path, content)

    monkeypatch.setattr(files, "create", create)
    t.append(logs(spark, (0, "a", "mine")))
    assert lines(t.read()) == ["mine", "other"] and t.versions() == [1, 2]


def test_only_days_that_call_for_it_are_rewritten(spark, tmp_path):
    t = VersionedLogs(spark, str(tmp_path / "t"))
    t.append(logs(spark, *((d * DAY + i, "a", f"{d}.{i}") for d in range(6) for i in range(4))))
    before = t.folders()
    policies = Policies([("t", "2d", None, None, None, 0)])
    took = maintenance.maintain(t, policies, 4 * DAY + 1, [masks.Delete("x", "t", '{app="a"} |= "4.2"', 0, 9 * DAY), masks.Delete("y", "other", '{app="a"}', 0, 9 * DAY)])
    by_day = {f.split("day=")[1]: a for f, a in took.items()}
    assert by_day == {"1970-01-01": "drop", "1970-01-02": "drop", "1970-01-05": "rewrite"}  # one of four rows of the third has expired
    assert lines(t.read()) == sorted(f"{d}.{i}" for d in range(2, 6) for i in range(4) if (d, i) != (4, 2))
    assert before - set(took) < t.folders() and len(t.folders()) == 4
    assert maintenance.maintain(t, policies, 4 * DAY + 1) == {} and len(t.versions()) == 2
    maintenance.maintain(t, Policies([("t", "0", None, None, None, 0)]), 99 * DAY)
    assert t.read().count() == 0 and not t.folders() and maintenance.maintain(t) == {}


def test_small_files_of_a_day_are_merged_and_others_kept(spark, tmp_path):
    t = VersionedLogs(spark, str(tmp_path / "t"))
    for i in range(4):
        t.append(logs(spark, (i, "a", f"l{i}"), (0, "a", "same"), *([(DAY, "a", "y")] if i == 0 else [])))
    other = {f for f in t.folders() if f.endswith("1970-01-02")}
    kept = {f for f in files_of(t) if "1970-01-02" in f}
    took = maintenance.maintain(t)
    assert set(took.values()) == {"merge"} and len(took) == 4 and not other & set(took)
    assert lines(t.read()) == ["l0", "l1", "l2", "l3", "same", "y"] and len(t.folders()) == 2 and kept < files_of(t)
    assert maintenance.maintain(t) == {}


def test_maintenance_gives_way_to_another_rewrite(spark, tmp_path, monkeypatch):
    t = VersionedLogs(spark, str(tmp_path / "t"))
    t.append(logs(spark, (0, "a", "x"), (1, "a", "y")))
    real = t.write

    def write(rows, tasks=None):
        old = t.folders()
        t.commit(real(t.load(old).drop("gen", "day")), old)
        return real(rows, tasks)

    monkeypatch.setattr(t, "write", write)
    with pytest.raises(Conflict):
        maintenance.maintain(t, deletes=[masks.Delete("x", "t", '{app="a"} |= "x"', 0, DAY)])
    assert lines(t.read()) == ["x", "y"]


def spans(spark, *rows):
    none = ({}, [], ({}, ""), ("", "", ""))
    return spark.createDataFrame([("t", f"{i:032x}", f"{i:016x}", "", "n", a, b, 1, 0, *none) for i, (a, b) in enumerate(rows)], tables.SPANS)


def test_days_whose_spans_have_ended_are_not_read(spark, tmp_path):
    rng = random.Random(5)
    rows = [(a := rng.randrange(-3 * DAY, 40 * DAY), a + rng.choice((-1, 0, 5, DAY // 2, DAY, 3 * DAY, 9 * DAY, 33 * DAY))) for _ in range(120)]
    path = str(tmp_path / "s")
    tables.write_spans(spans(spark, *rows), path)
    back = tables.read(spark, path, tables.SPANS)
    assert {r.reach for r in back.select("reach").distinct().collect()} <= {0, 1, 2, 4, 8, 16, 32, 64}
    for start, end in ((20 * DAY + 7, 21 * DAY), (-DAY, 0), (39 * DAY, 90 * DAY)):
        got = traces.scan(back, "t", start, end)
        assert sorted((r.start_ns, r.end_ns) for r in got.collect()) == sorted(x for x in rows if x[1] >= start and x[0] <= end)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "date_add(day" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]


def test_spans_written_without_reach_are_all_found(spark, tmp_path):
    path = str(tmp_path / "s")
    df = spans(spark, (0, 9 * DAY), (5 * DAY, 5 * DAY)).withColumn("day", tables.day_of(tables.F.col("start_ns")))
    df.write.partitionBy("day").parquet(path)
    assert traces.scan(tables.read(spark, path, tables.SPANS), "t", 8 * DAY, 9 * DAY).count() == 1


def test_line_filters_skip_files(spark, tmp_path):
    rng, t = random.Random(3), VersionedLogs(spark, str(tmp_path / "t"))
    words = ["error", "näïve", "日本語のログ", "a.b*c", "😀😀x", "ok", ""]
    every = []
    for i in range(4):
        rows = [(d * DAY + j, "a", f"{rng.choice(words)} {rng.randrange(100)} {rng.choice(words)}" if i or d else f"plain {j}") for d in range(3) for j in range(4)]
        t.commit(t.write(logs(spark, *rows), index=i != 3))
        every += [r[2] for r in rows]
    every += ["needle in it", "nothing"]
    t.append(logs(spark, (DAY, "a", "needle in it"), (2 * DAY, "a", "nothing")))
    unindexed = 3
    for texts in (["needle"], ["error"], ["日本語"], ["näï", "ok"], ["😀x"], ["a.b*c"], ["no"], ["ab", ""], ["absent text"], ["needle", "in it"]):
        got = t.read(containing=texts)
        assert sorted(r.line for r in got.collect() if all(x in r.line for x in texts)) == sorted(x for x in every if all(y in x for y in texts)), texts
    assert len(t.read(containing=["needle"]).selectExpr("_metadata.file_path").distinct().collect()) == 1 + unindexed
    assert t.read(containing=["no"]).count() == t.read().count()  # too short to tell
    took = maintenance.maintain(t, deletes=[masks.Delete("x", "t", '{app="a"} |= "needle"', 0, 9 * DAY)])
    assert took and not any("needle" in r.line for r in t.read(containing=["needle"]).collect())
    t.sweep(keep=1, orphan_s=0)
    assert lines(t.read()) == sorted(x for x in every if "needle" not in x)


def test_literals_of_a_query():
    of = lambda q: selection.literals(parse_selector(q))
    assert of('{a="b"} |= "x" != "y" |~ "z" | json | k = "1" |= "w" | line_format "{{.k}}" |= "v"') == ["x", "w"] and of("{}") == []
