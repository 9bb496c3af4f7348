"""The data source against a local server, CSV with a byte order mark, paged members, Moran's I against all pairs."""

import json
import random
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from veritally.operators import compare, spatial
from veritally.sources import http, scans, sinks


@pytest.fixture
def server():
    asked = Counter()

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            asked[self.path] += 1
            kind = self.path.split("/")[1]
            status = {"gone": 404, "busy": 503 if asked[self.path] < 3 else 200, "down": 500}.get(kind, 200)
            body = b"<html>" if kind == "html" else "﻿".encode() + json.dumps({"path": self.path, "name": "หน่วย"}).encode()
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    web = ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{web.server_port}", asked
    web.shutdown()


def test_addresses_are_read_and_failures_are_rows(spark, server, tmp_path):
    base, asked = server
    paths = ["ok/1", "ok/2", "gone/1", "busy/1", "down/1", "html/1", "ok/1"]
    urls = [f"{base}/{p}" for p in paths] + ["http://127.0.0.1:9/none", "nothing"]
    spark.dataSource.register(http.HttpJson)
    rows = spark.read.format("http_json").option("addresses", "\n".join(urls)).option("parallel", 3).option("pause", 0.01).option("timeout", 5).load()
    assert rows.rdd.getNumPartitions() == 3
    rows.write.parquet(str(tmp_path / "answers"))
    kept = spark.read.parquet(str(tmp_path / "answers"))
    got = {r["url"].removeprefix(base + "/"): (r["status"], r["body"] is not None, r["error"] is None, r["attempts"]) for r in kept.collect()}
    assert got == {
        "ok/1": (200, True, True, 1), "ok/2": (200, True, True, 1), "gone/1": (404, False, False, 1), "busy/1": (200, True, True, 3), "down/1": (500, False, False, 3),
        "html/1": (200, False, False, 1), "http://127.0.0.1:9/none": (None, False, False, 3), "nothing": (None, False, False, 1),
    }
    assert asked["/ok/1"] == 1 and asked["/down/1"] == 3
    assert sorted(r["name"] for r in kept.where("body is not null").select(F.get_json_object("body", "$.name").alias("name")).collect()) == ["หน่วย"] * 3
    assert scans.live_endpoints(kept).count() == 4
    table = spark.createDataFrame([(f"{base}/ok/9",), (f"{base}/ok/9",), (None,)], "url string")
    assert [(r["status"], r["attempts"]) for r in http.fetched(table).collect()] == [(200, 1)]


def test_csv_with_byte_order_mark(spark, tmp_path):
    rows = [(f"u{k}", 'a "quoted", name' if k % 7 == 0 else f"เขต {k}", "x" if k % 3 else None) for k in range(40)]
    df = spark.createDataFrame(rows, "unit_id string, constituency string, province string").repartition(3)
    sinks.write_csv(df, str(tmp_path / "out"), mark=True)
    files = list((tmp_path / "out").glob("part-*"))
    assert len(files) == 3 and all(f.read_bytes().startswith(b"\xef\xbb\xbfunit_id,constituency,province\n") for f in files)
    assert all(f.read_bytes().count(b"\xef\xbb\xbf") == 1 for f in files) and (tmp_path / "out" / "_SUCCESS").exists()
    assert sorted(tuple(r) for r in scans.read_unit_list(spark, str(tmp_path / "out")).collect()) == sorted(rows, key=lambda r: r[0])
    sinks.write_csv(df.limit(0), str(tmp_path / "none"), mark=True)
    assert not (tmp_path / "none").exists()


def test_members_in_pages(spark):
    rows = [(k, "hot" if k % 3 else None if k % 2 else f"g{k % 5}") for k in range(500)]
    got = compare.group_members(spark.createDataFrame(rows, "unit_id long, place string"), "place", page_rows=40).collect()
    for group in {g for _, g in rows}:
        mine = sorted((r for r in got if r["place"] == group), key=lambda r: r["page"])
        want = sorted(u for u, g in rows if g == group)
        assert [r["page"] for r in mine] == list(range(-(-len(want) // 40))) and [u for r in mine for u in r["members"]] == want
        assert {r["units"] for r in mine} == {len(want)} and max(len(r["members"]) for r in mine) <= 40


def moran(points, size):
    cells = [(int(x // size), int(y // size)) for x, y, _ in points]
    n, mean = len(points), sum(v for *_, v in points) / len(points)
    z = [v - mean for *_, v in points]
    near = [[j for j in range(n) if j != i and max(abs(cells[i][0] - cells[j][0]), abs(cells[i][1] - cells[j][1])) <= 1] for i in range(n)]
    w = sum(map(len, near))
    return n, w // 2, n / w * sum(z[i] * z[j] for i in range(n) for j in near[i]) / sum(a * a for a in z)


def test_morans_i_equals_all_pairs(spark):
    r = random.Random(3)
    flat = [(r.uniform(-40, 40), r.uniform(0, 90), r.gauss(0, 1)) for _ in range(220)]
    slope = [(x, y, x / 10 + v) for x, y, v in flat] + [(5.0, 5.0, 1.0)] * 30  # a crowded cell
    col = (F.col("x"), F.col("y"), F.col("v"))
    for points in (flat, slope):
        df = spark.createDataFrame([*points, (None, 1.0, 1.0), (1.0, float("nan"), 1.0), (1.0, 1.0, None)], "x double, y double, v double")
        row = spatial.morans_i(df, *col, 10.0).first()
        n, pairs, index = moran(points, 10)
        assert (row["units"], row["pairs"]) == (n, pairs) and row["moran_i"] == pytest.approx(index, rel=1e-9) and row["expected"] == -1 / (n - 1)
        test = spatial.permutation_test(df, *col, 10.0, permutations=39).first()
        assert test["moran_i"] == pytest.approx(index, rel=1e-9) and test["permutations"] == 39
        assert (test["p_value"] == 1 / 40 and row["z"] > 5) if points is slope else (test["p_value"] >= 0.05 and abs(row["z"]) < 3)
    draws = [moran([(x, y, v) for (x, y, _), v in zip(flat, r.sample([v for *_, v in flat], len(flat)))], 10)[2] for _ in range(400)]
    row, spread = spatial.morans_i(spark.createDataFrame(flat, "x double, y double, v double"), *col, 10.0).first(), (sum(d * d for d in draws) / len(draws)) ** 0.5
    assert (row["moran_i"] - row["expected"]) / row["z"] == pytest.approx(spread, rel=0.15)  # the deviation under random assignment
    for rows in ([], [(1.0, 1.0, 1.0)], [(1.0, 1.0, 1.0), (2.0, 2.0, 1.0)], [(1.0, 1.0, 1.0), (200.0, 2.0, 3.0)]):
        row = spatial.morans_i(spark.createDataFrame(rows, "x double, y double, v double"), *col, 10.0).first()
        assert row["units"] == len(rows) and row["moran_i"] is None and row["z"] is None
    assert spatial.permutation_test(spark.createDataFrame([], "x double, y double, v double"), *col, 10.0).first()["p_value"] is None
