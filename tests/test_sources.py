"""Scans that keep bad records, nested reports, and the stream of alert streaks with late and repeated events."""

import datetime as dt
import random

import pytest
from pyspark.sql import types as T

from sparkvane.sources import tables
from sparkvane.streaming import triage

SCHEMA = T.StructType([T.StructField("n", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.IntegerType())])


def test_bad_records_are_kept(spark, tmp_path):
    lines = ["id,n,x,y", "a,1,2.5,0", "b,one,2.5,1", "c,3,,1", "d,4,1e3,2", "e,5,2.5", "f,6,2.5,1,extra", 'g,7,"2,5",0', "h,,,", ",8,0,1"]
    (tmp_path / "t.csv").write_text("\n".join(lines) + "\n")
    got = tables.checked_csv(spark, str(tmp_path / "t.csv"), SCHEMA, required=("id",), binary=("y",))
    assert got.dtypes == [("id", "string"), ("n", "bigint"), ("x", "double"), ("y", "int"), ("reject_column", "string"), ("reject_value", "string")]
    rows = {r.id: (r.n, r.x, r.y, r.reject_column, r.reject_value) for r in got.collect()}
    assert rows["a"] == (1, 2.5, 0, None, None) and rows["c"] == (3, None, 1, None, None)
    assert rows["b"] == (None, 2.5, 1, "n", "one") and rows["d"][3:] == ("y", "2") and rows["g"][3:] == ("x", "2,5") and rows["h"][3:] == ("y", None)
    assert rows["e"][3] == rows["f"][3] == "fields" and rows["e"][4] == "e,5,2.5" and rows[None][3] == "id"
    assert got.where("reject_column IS NULL").count() == 2 and got.where("reject_column = 'fields'").count() == 2
    with pytest.raises(ValueError, match="z"):
        tables.checked_csv(spark, str(tmp_path / "t.csv"), SCHEMA, required=("z",))
    with pytest.raises(FileNotFoundError):
        tables.checked_csv(spark, str(tmp_path / "absent.csv"), SCHEMA)


def test_reports_of_any_shape(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"runs": {"seed_42": {"rf": {"f1": 0.5, "ok": true}}, "seed_43": {}}, "sizes": [1, [2, 3], []], "note": null, "odd.key": "x\\ny"}')
    (tmp_path / "b.json").write_text("{ broken")
    (tmp_path / "c.json").write_text("7")
    got = tables.report_rows(tables.scan_reports(spark, str(tmp_path)), "report", "file")
    rows = {(r.file, r.path): (r.kind, r.value) for r in got.collect()}
    assert rows == {
        ("a.json", "$.runs.seed_42.rf.f1"): ("DECIMAL", "0.5"),
        ("a.json", "$.runs.seed_42.rf.ok"): ("BOOLEAN", "true"),
        ("a.json", "$.runs.seed_43"): ("OBJECT", "{}"),
        ("a.json", "$.sizes[0]"): ("BIGINT", "1"),
        ("a.json", "$.sizes[1][0]"): ("BIGINT", "2"),
        ("a.json", "$.sizes[1][1]"): ("BIGINT", "3"),
        ("a.json", "$.sizes[2]"): ("ARRAY", "[]"),
        ("a.json", "$.note"): ("VOID", None),
        ("a.json", "$.odd.key"): ("STRING", "x\ny"),
        ("b.json", "$"): ("BROKEN", "{ broken"),
        ("c.json", "$"): ("BIGINT", "7"),
    }
    assert tables.report_rows(spark.createDataFrame([(1, None)], "k int, report string"), "report", "k").count() == 0


def plain_streaks(events, gap, end):
    """Streaks of the alerts of events (event_id, ts, user_id), repeated ones once, that are over by `end`."""
    out = []
    for user in {e[2] for e in events}:
        run = []
        for t in sorted({(e[0], e[1]) for e in events if e[2] == user}, key=lambda x: x[1]):
            if run and t[1] - run[-1] > gap:
                out.append((user, run[0], run[-1] + gap, len(run)))
                run = []
            run.append(t[1])
        out.append((user, run[0], run[-1] + gap, len(run)))
    return sorted(o for o in out if o[2] <= end)


def test_streaks_of_a_stream(spark, tmp_path):
    rnd, start, gap = random.Random(5), dt.datetime(2024, 1, 1), dt.timedelta(hours=2)
    events = [(k, start + dt.timedelta(minutes=7 * k + rnd.randint(0, 6), microseconds=k), rnd.randint(1, 3)) for k in range(300)]
    dealt = [[e for e in events if e[0] // 75 == f] for f in range(4)]
    # Some come a little late (within the watermark) and some twice, also in a later file.
    for f in range(1, 4):
        dealt[f] += dealt[f - 1][-3:]
        dealt[f].append(dealt[f - 1].pop(-2))
    folder = tmp_path / "in"
    for f, own in enumerate(dealt):
        rnd.shuffle(own)
        rows = [(k, t, u, "error", 1.0, None) for k, t, u in own]
        spark.createDataFrame(rows, triage.EVENTS).coalesce(1).write.parquet(str(tmp_path / f"f{f}"))
        folder.mkdir(exist_ok=True)
        next((tmp_path / f"f{f}").glob("*.parquet")).rename(folder / f"events-{f}.parquet")
    made = triage.alert_streaks(triage.decided(triage.read_events(spark, str(folder), files=1)))
    got = triage.run_to_folder(made, str(tmp_path / "out"))
    last = max(e[1] for e in events) - dt.timedelta(minutes=30)
    assert sorted(map(tuple, got.collect())) == plain_streaks(events, gap, last)
    # A table gives the same, with the streaks that the end of the stream leaves open.
    table = triage.alert_streaks(triage.decided(spark.read.parquet(str(folder)))).collect()
    assert sorted(map(tuple, table)) == plain_streaks(events, gap, dt.datetime(2030, 1, 1))
    # Run again, the stream goes on from where it was: nothing is given twice; what is too late is left out.
    spark.createDataFrame([(9000, start, 1, "error", 1.0, None), (9001, start + dt.timedelta(days=9), 1, "error", 1.0, None)], triage.EVENTS).coalesce(1).write.parquet(str(tmp_path / "f9"))
    next((tmp_path / "f9").glob("*.parquet")).rename(folder / "events-9.parquet")
    triage.run_to_folder(made, str(tmp_path / "out"))
    after = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out/rows")).collect()))
    assert after == plain_streaks(events, gap, dt.datetime(2024, 1, 8))


def test_order_of_reject_reasons(spark, tmp_path):
    (tmp_path / "t.csv").write_text("n,x,y\nq,q,q\n")
    got = tables.checked_csv(spark, str(tmp_path / "t.csv"), SCHEMA, binary=("y",)).first()
    assert (got.reject_column, got.reject_value) == ("n", "q")
