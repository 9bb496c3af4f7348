"""Limits, nulls, ties and divisions of the verification operators, on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from veritally.functions import stats
from veritally.operators import anomalies, compare, dashboard, denormalise, statistics, verify
from veritally.plans import catalog, feeds
from veritally.sources import scans, schemas, sinks
from veritally.streaming import snapshots


def votes(spark, rows):
    return spark.createDataFrame(rows, "unit_id string, name string, votes long")


def test_levels_of_worked_examples(spark):
    """Changes of one candidate of 1,500 in a unit of 3,500."""
    base = {"A": 1500, "B": 1200, "C": 800}
    changed = {"same": {}, "minor": {"A": 1503}, "significant": {"A": 1530}, "critical": {"A": 1650}, "missing": {"D": 300}, "shift": {"A": 1400, "B": 1300}}
    official = [(u, n, v) for u in changed for n, v in base.items()] + [("alone", "A", 5)]
    citizen = [(u, n, v) for u, c in changed.items() for n, v in (base | c).items()]
    diff = compare.candidate_diff(votes(spark, official), votes(spark, citizen))
    got = {r["unit_id"]: r for r in compare.compare_units(diff).collect()}
    assert {u: r["level"] for u, r in got.items()} == {"same": "IDENTICAL", "minor": "MINOR", "significant": "SIGNIFICANT", "critical": "CRITICAL", "missing": "CRITICAL", "shift": "IDENTICAL"}
    assert got["shift"]["candidate_abs_diff"] == 200 and got["missing"]["n_missing_official"] == 1
    one = compare.summarise(compare.compare_units(diff)).first()
    assert (one["total"], one["identical"], one["critical"], one["minor_pct"]) == (6, 2, 2, 16.67)
    assert compare.summarise(compare.compare_units(diff).limit(0)).first()["identical_pct"] == 0.0


@pytest.mark.parametrize("difference, total, want", [(0, 0, "IDENTICAL"), (10, 10_000, "MINOR"), (11, 10_000, "SIGNIFICANT"), (5, 1000, "MINOR"), (6, 1000, "SIGNIFICANT"), (50, 10_000, "SIGNIFICANT"), (51, 10_000, "CRITICAL"), (20, 1000, "SIGNIFICANT"), (21, 1000, "CRITICAL"), (7, 0, "MINOR")])
def test_limits_are_strict(spark, difference, total, want):
    row = spark.range(1).select(compare.level(F.lit(difference), F.lit(total), F.lit(0)).alias("x")).first()
    assert row["x"] == want


def test_repeated_names_count_last_and_sum(spark):
    rows = lambda xs: spark.createDataFrame([("u", n, v, i) for i, (n, v) in enumerate(xs)], "unit_id string, name string, votes long, position int")
    diff = compare.candidate_diff(rows([("A", 5), ("B", 1), ("A", 7)]), rows([("A", 7), ("B", 1)]), position="position")
    got = {r["name"]: (r["official_votes"], r["citizen_votes"], r["official_all"], r["status"]) for r in diff.collect()}
    assert got == {"A": (7, 7, 12, "matching"), "B": (1, 1, 1, "matching")}
    one = compare.compare_units(diff).first()
    assert (one["official_total"], one["citizen_total"], one["difference"], one["candidate_abs_diff"]) == (13, 8, 5, 0)


def test_histogram_bins(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 29.99, 30.0, 80.0, 100.0, 100.01, None)], "x double")
    got = {r["label"]: r["count"] for r in stats.histogram(df, "x", stats.EDGES["turnout"]).collect()}
    assert got["0-30%"] == 2 and got["30-40%"] == 1 and got["80-100%"] == 2 and got["40-50%"] == 0 and sum(got.values()) == 5


def test_exact_quantiles(spark):
    import numpy as np

    values = np.random.default_rng(3).lognormal(3, 4, 501).tolist()
    df = spark.createDataFrame([(x,) for x in values] + [(None,), (float("nan"),)], "x double")
    assert stats.exact_quantiles(df, "x", (0.25, 0.5, 0.75)) == pytest.approx(np.quantile(values, (0.25, 0.5, 0.75)).tolist(), rel=1e-12)
    assert stats.exact_quantiles(df.limit(0), "x", (0.5,)) == [None]


def test_exact_quantiles_of_infinities(spark):
    inf = math.inf
    of = lambda xs, *p: stats.exact_quantiles(spark.createDataFrame([(x,) for x in xs], "x double"), "x", p)
    assert of([inf, 3.0, 1.0, 2.0, 4.0], 0.25, 0.5, 1.0) == [2.0, 3.0, inf]
    assert of([-inf, -inf, 5.0], 0.0, 0.5, 1.0) == [-inf, -inf, 5.0]
    assert of([inf, inf], 0.5) == [inf] and math.isnan(of([-inf, inf], 0.5)[0])
    assert of([-1.7e308, 1.7e308, 0.0, 1.0], 0.5) == [0.5]
    assert of([5e-324, 1e-323, 0.0], 0.5) == [5e-324]


def test_swing_summary_with_a_unit_from_zero(spark):
    rows = lambda xs: spark.createDataFrame(list(enumerate(xs)), "k int, votes long")
    swings = statistics.swings(rows([5, 11, 12, 13, 14, 90]), rows([0, 10, 10, 10, 10, 10]), "k")
    one = statistics.swing_summary(swings).first()
    assert (one["count"], one["mean"], one["median"], one["outliers"]) == (6, math.inf, 35.0, 1)
    assert {r["k"] for r in statistics.swing_outliers(swings).collect()} >= {0}
    half = statistics.swings(rows([5, 5, 5, 1]), rows([0, 0, 0, 1]), "k")
    assert statistics.swing_summary(half).first()["outliers"] == statistics.swing_outliers(half).count()


def test_averages_of_a_province(spark):
    rows = [("p", 1, "A", 50.0, 1, 3), ("p", 2, "A", 50.1, 1, 3), ("p", 3, "", 99.9, 0, 1), ("p", 4, "A", 0.0, 5, 0), ("q", 5, None, 10.0, 1, 1), ("r", 6, "B", 10.0, 0, 1), ("r", 7, "C", 90.0, 0, 1)]
    df = spark.createDataFrame(rows, "province string, k int, winner string, pct double, invalid int, came int")
    got = [tuple(r) for r in anomalies.province_patterns(df, "province", "winner", "pct", "invalid", "came", "k").collect()]
    assert got[0] == ("p", "monopoly", 3, 1, "A", 3, 100.0, 66.7, 28.8, 22.22)
    assert got[1][:4] == ("r", "high_variation", 2, 2) and got[1][7:] == (50.0, 56.6, 0.0) and len(got) == 2


def test_scores_without_spread(spark):
    df = spark.createDataFrame([(i, 10, 1) for i in range(5)], "unit_id int, whole int, part int")
    assert {(r["z"], r["flag"]) for r in anomalies.fenced(anomalies.rated(df, "part", "whole"), "rate").collect()} == {(0.0, "normal")}
    assert statistics.linear_pattern(spark.range(20).select("id", F.lit(3).alias("v")), "v", "id").first()["correlation"] is None
    assert statistics.linear_pattern(spark.range(9).select("id", (F.col("id") * 2).alias("v")), "v", "id").first()["correlation"] is None
    assert statistics.linear_pattern(spark.range(10).select("id", (F.col("id") * 2).alias("v")), "v", "id").first()["linear_suspicious"]


def test_first_digits(spark):
    skewed = scans.synthetic_votes(spark, 2000)
    assert anomalies.benford_test(skewed, "skewed", least=1, least_rows=30).first()["conforms"]
    assert not anomalies.benford_test(skewed, "uniform", least=1, least_rows=30).first()["conforms"]
    assert not anomalies.benford_test(skewed.limit(20), "uniform", least=1, least_rows=30).first()["valid"]
    assert spark.range(1).select(stats.chi_square_tail_8(F.lit(stats.CHI_SQUARE_5_PERCENT))).first()[0] == pytest.approx(0.05, abs=1e-4)


def test_swings_from_zero(spark):
    rows = lambda xs: spark.createDataFrame(list(enumerate(xs)), "k int, votes long")
    got = [r["swing_pct"] for r in statistics.swings(rows([5, 0, 30]), rows([0, 0, 20]), "k").orderBy("k").collect()]
    assert got == [math.inf, None, 50.0]


def test_turnout_and_consistency(spark):
    df = spark.createDataFrame([("a", 95, 100), ("b", 96, 100), ("c", 1, 0), ("d", 0, 0)], "unit_id string, cast int, eligible int")
    assert {r["unit_id"] for r in verify.turnout_over(df, "cast", "eligible").collect()} == {"b", "c"}
    assert verify.turnout_over(df, "cast", "nothing") is None
    a, b = (spark.createDataFrame([(1, x, "p")], "k int, n int, t string") for x in (3, 5))
    assert [tuple(r) for r in verify.consistency_diff(a, b, ["k"], ["n", "t"]).collect()] == [(1, "n", "3", "5", 2.0)]


def test_dashboard_labels(spark):
    bands = {0: "none", 99: "low", 100: "medium", 999: "medium", 1000: "high"}
    df = spark.createDataFrame([(d,) for d in bands], "d int")
    assert {r["d"]: r["b"] for r in df.select("d", dashboard.difference_band(F.col("d")).alias("b")).collect()} == bands
    names = spark.createDataFrame([("พะเยา",), ("เชียงใหม่",), ("เชียงใหม่",)], "n string")
    assert [r["n"] for r in dashboard.collated(names, "n").collect()] == ["เชียงใหม่", "พะเยา"]
    assert [r["id"] for r in dashboard.page(spark.range(10), [F.col("id")], 1, 4).collect()] == [4, 5, 6, 7]


def cons(cons_id, turn_out, valid, candidates):
    return {"cons_id": cons_id, "turn_out": turn_out, "valid_votes": valid, "candidates": candidates}


def test_nested_feed_to_units(spark, tmp_path):
    import json

    person = lambda i, p, v, rank: {"mp_app_id": i, "party_id": p, "mp_app_vote": v, "mp_app_rank": rank}
    feed = {"result_province": [
        {"prov_id": "10", "turn_out": 9, "constituencies": [cons("BKK_1", 100, 90, [person("a", 1, 30, 2), person("b", 2, 20, 1), person("c", 7, 40, None)]), cons("BKK_2", 0, 0, [])], "result_party": [{"party_id": 1, "party_cons_votes": 5}, {"party_id": 2}]},
        {"prov_id": "99", "constituencies": []},
    ]}
    files = {"statistics": feed, "provinces": {"province": [{"prov_id": "10", "province": "Bangkok"}]}, "parties": [{"id": "1", "name": "One", "color": None, "abbr": ""}, {"id": "2", "name": "Two", "color": "#222", "abbr": "T"}]}
    for name, document in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(document))
    stats_, provs, parties, info, people = (scans.read_feed(spark, str(tmp_path), n) for n in ("statistics", "provinces", "parties", "constituencies", "candidates"))
    units = denormalise.units(stats_, provs, parties, info, people).collect()
    assert len(units) == 1
    u = units[0]
    assert (u["unit_id"], u["constituency"], u["province"], u["winner"], u["winner_votes"], u["winner_color"]) == ("BKK_1", "Bangkok เขต 1", "Bangkok", "Two", 20, "#222")
    assert [c["party"] for c in u["candidates"]] == ["Two", "One", "party_7"] and u["registered_vote"] == 0 and u["zone"] == []
    assert (u["official_total"], u["citizen_total"], u["difference"], u["level"], u["has_discrepancy"], u["note"]) == (90, 0, 0, "pending", False, denormalise.PENDING_NOTE)
    assert {c["citizen_votes"] for c in u["candidates"]} == {p["citizen"] for p in u["parties"]} == {0} and [c["official_votes"] for c in u["candidates"]] == [20, 30, 40]
    assert u["parties"][0].asDict() == {"name": "Two", "color": "#222", "candidate_id": "b", "candidate_name": "", "official": 20, "citizen": 0, "percent": 0.0, "rank": 1}
    assert {k for k in u.asDict()} == {f.name for f in schemas.UNITS.fields}
    summary = {r["prov_id"]: r for r in denormalise.province_summary(stats_, provs).collect()}
    assert summary["10"]["units"] == 1 and summary["99"]["units"] == 0 and summary["99"]["province"] == "99"
    top = denormalise.national_parties(stats_, parties).collect()
    assert [(r["party_id"], r["cons_votes"]) for r in top] == [(1, 5), (2, 0)]


@pytest.mark.parametrize("name, reads", [("unit_table", 1), ("unit_parties", 2)])
def test_ballots_are_ordered_where_they_are_nested(spark, sf_dir, name, reads):
    """No window over all candidates, no names that aren't returned, and no list gathered only to be taken apart."""
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("l_linenumber") and plan.count("collect_list(") <= 3 and plan.count("l_quantity") > 0
    files = spark.createDataFrame([(plan,)], "p string")
    assert files.selectExpr("regexp_count(p, 'Relation [^\\n]*l_linenumber')").first()[0] == reads


@pytest.mark.parametrize("name", ["landed_feed", "published_units"])
def test_large_feeds_are_landed_compressed(spark, sf_dir, tmp_path, monkeypatch, name):
    monkeypatch.setattr(feeds, "workspace", lambda spark, folder: str(tmp_path / folder))
    n = catalog.QUERIES[name](spark, sf_dir).count()
    parts = [p for p in tmp_path.rglob("part-*") if "parties.json" not in str(p)]
    assert n and parts and all(p.name.endswith(".json.gz") for p in parts)
    if name == "published_units":
        unit = next(u for d in scans.read_units(spark, str(tmp_path / "published"), lines=True).limit(50).collect() if len((u := d)["candidates"]) > 1)
        assert [(p["candidate_id"], p["name"], p["official"]) for p in unit["parties"]] == [(c["candidate_id"], c["party"], c["official_votes"]) for c in unit["candidates"]]


def test_sinks_and_scans(spark, tmp_path):
    df = spark.createDataFrame([("001", "เขต 1", None)], schemas.UNIT_LIST)
    sinks.write_csv(df, f"{tmp_path}/csv", files=1)
    assert [tuple(r) for r in scans.read_unit_list(spark, f"{tmp_path}/csv").collect()] == [("001", "เขต 1", None)]
    sinks.write_json(df, f"{tmp_path}/json", files=1)
    assert '"province":null' in next((tmp_path / "json").glob("*.json")).read_text(encoding="utf-8")
    (tmp_path / "bom.csv").write_bytes("﻿unit_id,constituency,province\n007,a,b\n".encode())
    assert scans.read_unit_list(spark, f"{tmp_path}/bom.csv").first()["unit_id"] == "007"
    pages = spark.createDataFrame([('<a href="/x"><a href="/y"><a href="/x">',)], "html string")
    assert {r["url"]: r["found"] for r in scans.addresses(pages, "html").collect()} == {"/x": 2, "/y": 1}


def test_missing_and_broken_feeds_are_none(spark, tmp_path):
    schema = schemas.record(id=schemas.LONG, name=schemas.TEXT)
    read = lambda name, **how: scans.read_json_or_none(spark, f"{tmp_path}/{name}", schema, **how)
    (tmp_path / "fine.json").write_text('{"id": 1,\n "name": "a", "more": 2}')
    (tmp_path / "lines.json").write_text('{"id": 1}\n{"id": 2, "name": "b"}\n')
    (tmp_path / "broken.json").write_text("<html>not found</html>")
    assert read("nothing.json") is None and read("broken.json") is None
    assert [tuple(r) for r in read("fine.json").collect()] == [(1, "a")]
    assert sorted(tuple(r) for r in read("lines.json", lines=True).collect()) == [(1, None), (2, "b")]


def test_entries_and_quoted_strings(spark):
    df = spark.createDataFrame([('[1, 2, 3]',), ('{"a": 1, "b": 2}',), ("7",), (None,), ("[]",)], "j string")
    assert [r["n"] for r in df.select(scans.entries("j").alias("n")).collect()] == [3, 2, None, None, 0]
    page = spark.createDataFrame([("""x("/data/a.json"); y('/api/vote_station/1'); z("/other")""",)], "html string")
    found = lambda words: {r["url"] for r in scans.addresses(page, "html", scans.quoted(words)).collect()}
    assert found(scans.DATA_WORDS) == {"/data/a.json"} and found(scans.STATION_WORDS) == {"/api/vote_station/1"}


def test_snapshots_stream(spark, tmp_path):
    import json

    for n, (ts, total) in enumerate([("2026-02-08T18:00:00", 10), ("2026-02-08T18:05:00", 25)]):
        folder = tmp_path / "in"
        folder.mkdir(exist_ok=True)
        (folder / f"{n}.json").write_text(json.dumps({"unit_id": "u", "timestamp": ts, "candidates": [{"name": "A", "votes": total}]}))
    seen = []
    stream = snapshots.totals(snapshots.read_snapshots(spark, str(tmp_path / "in")))
    snapshots.run_once(stream, str(tmp_path / "state"), lambda df, _: seen.extend(snapshots.latest(df).collect())).awaitTermination(60)
    assert [(r["unit_id"], r["total"]) for r in seen] == [("u", 25)]
    before, after = (spark.createDataFrame([("u", t)], "unit_id string, total long") for t in (10, 25))
    assert [(r["change"], r["alert"]) for r in snapshots.changes(before, after, 10).collect()] == [(15, True)]


def test_entry_without_the_optional_parts(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "find_spec", lambda name: None)
    names = entry.queries()
    assert "compare_units" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
    assert set(entry.oracle_sql()) == set(names)


def test_ordinals_follow_the_whole_key_and_spread_one_value(spark):
    rows = spark.range(40_000).select((F.col("id") * 7919 % 40_009).alias("b"), (F.col("id") % 3).alias("a"), F.col("id"))
    got = [r["id"] for r in stats.with_ordinal(rows, F.desc("a"), "b", name="place").orderBy("place").collect()]
    assert got == [r["id"] for r in rows.orderBy(F.desc("a"), "b").collect()]
    assert [r["place"] for r in stats.with_ordinal(rows.where("id < 0"), "b", name="place").collect()] == []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        one = stats.with_ordinal(spark.range(20_000).select(F.lit(1).alias("x")), "x")
        assert sorted(r["ordinal"] for r in one.collect()) == list(range(20_000))
        sizes = one.groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in sizes) < 10_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("scale, shift", [(100, 0), (1, 50), (1e7, -3e6), (1e-3, 0), (1e14, 0)])
def test_unit_fences_equal_numpy(spark, scale, shift):
    """Quartiles, mean and deviation of rounded values of any range, from their counts."""
    import numpy as np

    values = np.round(np.random.default_rng(5).standard_normal(3_001) * scale + shift, 2)
    df = spark.createDataFrame([(float(x),) for x in values] + [(None,), (math.nan,)], "x double")
    found = stats.unit_fences(stats.unit_counts(df, "x"))
    q1, q2, q3 = np.quantile(values, (0.25, 0.5, 0.75))
    want = {"q1": q1, "median": q2, "q3": q3, "iqr": q3 - q1, "mean": values.mean(), "stdev": values.std(ddof=1), "total": 3_001}
    assert {k: found[k] for k in want} == pytest.approx(want, rel=1e-9, abs=1e-9 * scale)


def test_unit_fences_of_few_values(spark):
    of = lambda *xs: stats.unit_fences(stats.unit_counts(spark.createDataFrame([(x,) for x in xs], "x double"), "x"))
    assert of()["total"] == 0 and of()["q1"] is None and of(None)["median"] is None
    assert (of(7.25)["median"], of(7.25)["stdev"], of(7.25)["upper_fence"]) == (7.25, 0.0, 7.25)
    assert of(1.0, 2.0)["q1"] == 1.25 and of(*[5.0] * 9, 6.0)["iqr"] == 0
    endless = of(1.0, math.inf, math.inf)
    assert endless["median"] == math.inf and endless["q1"] == math.inf and endless["mean"] == math.inf
    assert of(-math.inf, 1.0, 2.0)["median"] == 1.0 and math.isnan(of(-math.inf, math.inf)["mean"])


def test_summary_rounds_like_its_sql(spark):
    """Quartiles between two values of two places end in a half that is no double; products and interpolation decide."""
    import duckdb
    import numpy as np

    from veritally.plans.catalog import _report_sql

    random = np.random.default_rng(11)
    for lo in [173.52, *np.round(random.uniform(1, 400, 11), 2).tolist()]:
        xs = [lo, round(lo + 0.01, 2), round(lo + 0.06, 2), round(lo + 0.11, 2)][: 3 if lo < 200 else 4]
        df = spark.createDataFrame([(x,) for x in xs], "rate double").coalesce(1)
        sql = duckdb.sql(_report_sql(f"rates as (select unnest({xs}::double[]) rate)", two_sided=True))
        want, got = dict(zip(sql.columns, sql.fetchall()[0])), anomalies.fence_report(df, "rate", two_sided=True, wide=True).first().asDict()
        assert {k: got[k] for k in ("median", "q1", "q3", "iqr", "lower_fence", "upper_fence")} == {k: want[k] for k in ("median", "q1", "q3", "iqr", "lower_fence", "upper_fence")}
    row = spark.range(1).select(*[stats.round_half_up(F.lit(x), 2).alias(str(i)) for i, x in enumerate((1.005, -1.005, 0.125, -0.125, 1e300, math.inf, None))]).first()
    assert tuple(row) == (1.0, -1.0, 0.13, -0.13, 1e300, math.inf, None)


def test_report_rounds_like_its_sql(spark):
    import duckdb

    from veritally.operators import report

    for lo in (173.52, 142.31, 0.99):
        xs = [lo, round(lo + 0.01, 2), round(lo + 0.02, 2), round(lo + 0.05, 2)]
        want = duckdb.sql(f"select round(quantile_cont(v, 0.25), 2), round(median(v), 2), round(quantile_cont(v, 0.75), 2) from (select unnest({xs}::double[]) v)").fetchall()[0]
        got = report.sections_of(spark.createDataFrame(list(enumerate(xs)), "unit int, v double"), "unit", [report.Section("x", F.col("v"), fence="both")])[0].first()
        assert (got["q1"], got["median"], got["q3"]) == want


def test_report_works_its_units_out_once(spark, tmp_path):
    """The document is read from kept measures and patterns; what they are made of isn't scanned again."""
    from veritally.operators import report

    spark.createDataFrame([(i, float(i)) for i in range(20)], "unit int, v double").write.parquet(str(tmp_path / "units"))
    spark.createDataFrame([("p", "monopoly", 3), ("q", "high_variation", 5)], "province string, pattern string, total_cons long").write.parquet(str(tmp_path / "patterns"))
    more = [report.patterns_section(spark.read.parquet(str(tmp_path / "patterns")), "province")]
    document = report.document(spark.read.parquet(str(tmp_path / "units")), "unit", [report.Section("x", F.col("v"), over=17)], more)
    assert "parquet" not in document._jdf.queryExecution().optimizedPlan().toString()
    one = document.first()
    assert (one["total_units"], one["flagged_units"], [s["flagged"] for s in one["sections"]]) == (20, 2, [2, 1])


def test_schema_discovery(spark):
    """Mixed types, lists in lists, broken and missing documents, empty objects."""
    from veritally.sources import discovery

    rows = ['{"a": 1, "b": [1, "x", [2.5, null]], "c": {}}', '{"a": null, "b": []}', "{broken", None, "[true]", '{"a": {"d": 1e3}}']
    got = {(r["path"], r["type"]): (r["count"], r["share"], r["least_size"], r["greatest_size"]) for r in discovery.discover(spark.createDataFrame([(x,) for x in rows], "j string"), "j").collect()}
    assert got == {
        ("$", "object"): (3, 0.5, None, None), ("$", "broken"): (1, 0.1667, None, None), ("$", "missing"): (1, 0.1667, None, None), ("$", "array"): (1, 0.1667, 1, 1), ("$[]", "boolean"): (1, 1.0, None, None),
        ("$.a", "integer"): (1, 0.3333, None, None), ("$.a", "null"): (1, 0.3333, None, None), ("$.a", "object"): (1, 0.3333, None, None), ("$.a.d", "number"): (1, 1.0, None, None),
        ("$.b", "array"): (2, 0.6667, 0, 3), ("$.b[]", "integer"): (1, 0.3333, None, None), ("$.b[]", "string"): (1, 0.3333, None, None), ("$.b[]", "array"): (1, 0.3333, 2, 2),
        ("$.b[][]", "number"): (1, 0.5, None, None), ("$.b[][]", "null"): (1, 0.5, None, None), ("$.c", "object"): (1, 0.3333, None, None),
    }
    assert discovery.discover(spark.createDataFrame([], "j string"), "j").collect() == []


def test_rounding_equals_pythons(spark):
    """Of the exact binary value, ties to even: worked cases, random ones, and neighbours of ties."""
    import random

    r, xs = random.Random(11), [1.005, 2.675, 0.125, 0.375, 1.115, 3.125, 9.375, 0.0, -0.125, -2.675, -0.004, 1e15, 1e300, 123456789.125, 99.995, 100.0, 2.0**44 / 100]
    xs += [r.uniform(-500, 500) for _ in range(4_000)] + [r.randrange(10**6) / 1000 for _ in range(4_000)] + [r.randrange(10**5) / 32 for _ in range(2_000)]
    xs += [math.nextafter(k / 200, to) for k in range(1, 2_001, 2) for to in (-9e9, 9e9)] + [k / 7 * 100 for k in range(500)]
    for digits in (2, 1, 4):
        df = spark.createDataFrame([(x,) for x in xs], "x double")
        got = [tuple(row) for row in df.select("x", stats.round_half_even(F.col("x"), digits)).collect()]
        assert [(x, y) for x, y in got if y != round(x, digits)] == []
    odd = spark.createDataFrame([(None,), (math.nan,), (math.inf,)], "x double").select(stats.round_half_even(F.col("x")).alias("y")).collect()
    assert odd[0]["y"] is None and math.isnan(odd[1]["y"]) and odd[2]["y"] == math.inf
