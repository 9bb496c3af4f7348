"""Streams over landed files: restarts, late and repeated documents, runs of the keyed table, comparison against a batch."""

import json

from pyspark.sql import functions as F

from veritally.sources import schemas
from veritally.streaming import reconcile, snapshots, state

UNITS = [f"u{k}" for k in range(12)]


def land(folder, number, documents):
    folder.mkdir(exist_ok=True)
    rows = [{"unit_id": u, "timestamp": f"2026-03-01 {h:02d}:{m:02d}:00", field: [{"name": n, "votes": v} for n, v in votes]} for u, h, m, field, votes in documents]
    (folder / f"{number:03d}.json").write_text("\n".join(map(json.dumps, rows)))


def test_active_runs_follow_from_the_count():
    assert state.active_runs(0, 3) == [] and state.active_runs(5, 3) == [(1, 3), (0, 4), (0, 5)]
    for n in range(1, 100):
        runs = state.active_runs(n, 3)
        assert runs[-1][1] == n and sum(3**k for k, _ in runs) == n and all(sum(k == x for k, _ in runs) < 3 for x in range(6))


def test_latest_table_keeps_the_newest_and_forgets_merged_runs(spark, tmp_path):
    table = state.LatestTable(spark, str(tmp_path / "t"), snapshots.TOTALS, ["unit_id"], "ts", fan=3)
    want, row = {}, 0
    for n in range(14):
        rows = []
        for k in range(3):
            row += 1
            unit, ts = f"u{(n * 5 + k) % 7}", (row * 37) % 50  # late rows among them
            rows.append((unit, ts, row))
            want[unit] = max(want.get(unit, (-1, 0)), (ts, row))
        batch = spark.createDataFrame(rows, "unit_id string, at int, total long").select("unit_id", F.timestamp_seconds("at").alias("ts"), "total")
        table.put(batch, n)
        if n in (5, 8, 9):
            table.put(batch, n)  # a batch that is repeated after a failure
        got = {r["unit_id"]: (r["at"], r["total"]) for r in table.read(n + 1).select("unit_id", F.unix_seconds("ts").alias("at"), "total").collect()}
        assert got == want
    there = {(int(p.parent.name[5:]), int(p.name[5:])) for p in (tmp_path / "t").glob("size=*/upto=*")}
    assert set(state.active_runs(14, 3)) <= there and len(there) <= len(state.active_runs(14, 3)) + 4
    assert table.read(0).count() == 0


def test_latest_of_a_stream_over_restarts(spark, tmp_path):
    """Files one a micro-batch, late and repeated documents, and a restart that reads only what is new."""

    def run():
        stream = snapshots.latest(snapshots.totals(snapshots.read_snapshots(spark, str(tmp_path / "in"), lines=True, files=1)))
        q = snapshots.run_once(stream, str(tmp_path / "check"), snapshots.into_state(spark, str(tmp_path / "state")), "update")
        q.awaitTermination(120)
        batches = q.lastProgress["batchId"] + 1
        rows = snapshots.state_table(spark, str(tmp_path / "state")).read(batches).collect()
        return {r["unit_id"]: (r["ts"].hour, r["total"]) for r in rows}, batches, sum(p["numInputRows"] for p in q.recentProgress)

    land(tmp_path / "in", 0, [(u, 1, 0, "candidates", [("a", 10), ("b", 1)]) for u in UNITS])
    land(tmp_path / "in", 1, [(u, 3, 0, "parties", [("a", 30)]) for u in UNITS[:4]])
    got, batches, rows = run()
    assert got == {u: (3, 30) if u in UNITS[:4] else (1, 11) for u in UNITS} and batches >= 2 and rows == 16
    land(tmp_path / "in", 2, [(UNITS[0], 2, 0, "parties", [("a", 99)]), (UNITS[5], 4, 0, "candidates", [])])  # late; new and empty
    land(tmp_path / "in", 3, [(u, 3, 0, "parties", [("a", 30)]) for u in UNITS[:4]])  # repeated
    got, more, rows = run()
    assert got == {u: (3, 30) if u in UNITS[:4] else (4, 0) if u == UNITS[5] else (1, 11) for u in UNITS} and more > batches and rows == 6


def plain(rows):
    return sorted((r["unit_id"], r["start"].hour, r["sides"], r["official_total"], r["citizen_total"], r["difference"], r["n_discrepant"], r["n_missing"], r["level"]) for r in rows)


def test_streams_compared_equal_the_batch_and_restart(spark, tmp_path):
    def documents(hour, side):
        out = []
        for k, u in enumerate(UNITS):
            if (k + hour) % (5 if side else 7) == 0:
                continue  # a unit this source lacks
            votes = [("a", 100 + k), ("b", 40 + (side * hour if k % 3 == 0 else 0)), ("a", 101 + k)] + ([("c", 5)] if not (side and k % 4 == 0) else [])
            out += [(u, hour, 5, "candidates", [("a", 1)]), (u, hour, 50, "parties" if side else "candidates", votes)]
        return out

    def run():
        sides = [reconcile.entries(snapshots.read_snapshots(spark, str(tmp_path / name), lines=True)) for name in ("official", "citizen")]
        q = reconcile.run(reconcile.compared(*sides), str(tmp_path / "out"), str(tmp_path / "check"))
        q.awaitTermination(180)
        assert q.exception() is None
        return spark.read.parquet(str(tmp_path / "out" / "compared")).drop("batch"), spark.read.parquet(str(tmp_path / "out" / "alerts")).drop("batch")

    def batch(upto):
        both = []
        for name in ("official", "citizen"):
            docs = spark.read.schema(schemas.UNIT_DOCUMENT).json(str(tmp_path / name)).withColumn("ts", F.to_timestamp("timestamp"))
            both.append(reconcile.entries(docs))
        return reconcile.compared(*both).where(F.hour("end") <= upto)

    for hour in (1, 2, 3):
        for side, name in enumerate(("official", "citizen")):
            land(tmp_path / name, hour, documents(hour, side))
    got, alerts = run()
    assert plain(got.collect()) == plain(batch(3).collect()) and {r["sides"] for r in got.collect()} == {"both", "official", "citizen"}
    for hour in (4, 5, 6, 7):
        for side, name in enumerate(("official", "citizen")):
            land(tmp_path / name, hour, documents(hour, side))
    got, alerts = run()
    assert plain(got.collect()) == plain(batch(7).collect())
    key = lambda rows: sorted((r["unit_id"], r["start"].hour, r["level_before"], r["level"]) for r in rows)
    want = key(reconcile.level_changes(got).collect())
    assert key(alerts.collect()) == want and {h for _, h, *_ in want} & {4, 5, 6}  # alerts across the restart, too
