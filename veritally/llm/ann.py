"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length 1, where the nearest by cosine are the nearest by
distance.  Each of several tables hashes a vector by Gaussian (2-stable)
projections, cut into steps of a fixed width; every vector is written to its
bucket in every table.  A query visits, in each table, its own bucket and then
perturbed buckets in the order of their estimated success: the perturbation sets
with the least sum of squared distances to the crossed boundaries.  Candidates
of all tables are merged and ranked by their exact cosine.  A query whose buckets
hold fewer than are asked for is ranked against all vectors of its length.

Projections follow from the number of vectors, so that buckets don't grow with
it.  How many buckets a query visits is fitted: a bounded sample of queries is
ranked against all vectors, and the least number of visits that finds the wanted
share of their true neighbours is taken.  Where neighbours are close, that is a
few buckets; where the vectors have no structure, projections are taken away
until enough are found.

Equal vectors are hashed once; they stand for their least vec_ids.  Buckets are
dealt to partitions by hash, very full ones in several parts, and each partition
gets a query's vector once.  Inside a partition, buckets and the queries that
visit them meet in blocked products; only a query's best candidates leave it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritally.llm.common import checkpoint

#: Bucket entries in a partition, about (each carries its vector).
PARTITION_ROWS = 40_000
#: A bucket with more vectors is dealt to several partitions.
FULL_BUCKET = 8_192
#: Full buckets known to every task at most; the limit above rises to keep to it.
FULL_BUCKETS = 100_000
#: Queries whose buckets hold too few that make a block, which is ranked against blocks of all vectors.
SHORT_QUERIES = 512
#: Vectors in a block that such a block of queries meets.
PACKED = 1_024
#: Queries in the sample that the number of visits is fitted on, and the share of their neighbours to find.
SAMPLE_QUERIES = 160
WANTED_RECALL = 0.95
#: Vectors in a bucket, about, and bits that a projection tells of its place.
BUCKET_ROWS = 12
PLACE_BITS = 1.2
#: Buckets visited in a table at most.
MOST_PROBES = 512
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Probing:
    """Tables, projections of each, width of a step, buckets visited in each table."""

    tables: int = 4
    projections: int = 8
    width: float = 3.0
    probes: int = 64
    seed: int = 3

    def functions(self, dimension: int) -> tuple[np.ndarray, np.ndarray]:
        random = np.random.default_rng([self.seed, dimension])
        return random.standard_normal((dimension, self.tables * self.projections)), random.random(self.tables * self.projections)

    def places(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables, projections): where each vector falls, in steps."""
        a, b = self.functions(unit.shape[1])
        return (unit @ a / self.width + b).reshape(len(unit), self.tables, self.projections)

    def keys(self, cells: np.ndarray, table: np.ndarray, dimension: int) -> np.ndarray:
        """One long for each (dimension, table, bucket)."""
        h = np.full(len(cells), np.uint64(dimension)) * GOLDEN + table.astype(np.uint64)
        for k in range(self.projections):
            h = (h ^ (h >> np.uint64(29))) * GOLDEN + cells[:, k].astype(np.int64).view(np.uint64)
        return ((h ^ (h >> np.uint64(32))) * GOLDEN).view(np.int64)

    def visits(self, places: np.ndarray, dimension: int) -> tuple[np.ndarray, np.ndarray]:
        """(key, number of the visit in its table) of the buckets that a query at ``places`` visits."""
        visited, tables, turns = [], [], []
        for a, place in enumerate(places):
            cell = np.floor(place)
            for turn, steps in enumerate(perturbations(place - cell, self.probes)):
                moved = cell.copy()
                for s in steps:
                    moved[s % self.projections] += -1 if s < self.projections else 1
                visited.append(moved)
                tables.append(a)
                turns.append(turn)
        return self.keys(np.array(visited), np.array(tables), dimension), np.array(turns)


def perturbations(offset: np.ndarray, count: int) -> list[tuple[int, ...]]:
    """The ``count`` best sets of steps (j: down in projection j, k + j: up), the empty one first.

    ``offset`` holds the k fractions of a step by which a point lies above its
    cell's lower boundary.  Sets are built by shifting and expanding from the
    cheapest step; those that go both ways in a projection are passed over.
    """
    k = len(offset)
    cost = np.concatenate((offset, 1 - offset)) ** 2
    order = np.argsort(cost, kind="stable").tolist()
    price = cost[order].tolist()
    sets: list[tuple[int, ...]] = [()]
    heap = [(price[0], (0,))]
    while heap and len(sets) < count:
        total, chosen = heapq.heappop(heap)
        steps = tuple(order[c] for c in chosen)
        if len({s % k for s in steps}) == len(steps):
            sets.append(steps)
        last = chosen[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (total + price[last + 1], (*chosen, last + 1)))
            heapq.heappush(heap, (total - price[last] + price[last + 1], (*chosen[:-1], last + 1)))
    return sets


def _scaled(v: np.ndarray) -> np.ndarray:
    """Vectors of length 1; the greatest component goes first, so that no square over- or underflows."""
    v = v / np.abs(v).max(axis=-1, keepdims=True)
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def _units(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors in double precision) for each length of vector."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield rows, _scaled(values[starts[rows][:, None] + np.arange(d)])


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v) of the rows with a key and a finite vector other than zero; floats stay floats."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(key).isNotNull() & v.isNotNull()).where(fine)
    single = isinstance(vectors.schema[vector].dataType, T.ArrayType) and isinstance(vectors.schema[vector].dataType.elementType, T.FloatType)
    return rows.select(F.col(key).cast("long").alias("vec_id"), v.cast("array<float>" if single else "array<double>").alias("v"))


def entry_type(vectors: DataFrame) -> T.StructType:
    """Rows of a bucket or a visit, with vectors of the type of ``v``."""
    return T.StructType([T.StructField("pid", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("gid", T.LongType()), T.StructField("v", vectors.schema["v"].dataType)])


FOUND = T.StructType([T.StructField("query", T.LongType()), T.StructField("gid", T.LongType()), T.StructField("score", T.DoubleType())])


def _partition(keys: np.ndarray, part: np.ndarray, partitions: int) -> np.ndarray:
    h = (keys.view(np.uint64) ^ (part.astype(np.uint64) * GOLDEN)) * GOLDEN
    return ((h >> np.uint64(33)) % np.uint64(partitions)).astype(np.int32)


def entries(how: Probing, full: dict[int, int], partitions: int):
    """A function for mapInArrow: rows of (gid, v, is_query) to rows of :func:`entry_type`.

    kind 0 brings a query's vector to a partition, kind 1 a bucket that a query
    visits, kind 2 a vector in its bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gids, vectors, asks = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
            for rows, unit in _units(vectors):
                d = unit.shape[1]
                places = how.places(unit)
                cells = np.floor(places)
                n, t = len(rows), how.tables
                keys = how.keys(cells.reshape(n * t, -1), np.tile(np.arange(t), n), d)
                who = np.repeat(np.arange(n), t)
                parts = np.array([full.get(k, 1) for k in keys.tolist()]) if full else np.ones(n * t, np.int64)
                part = gids[rows][who].view(np.uint64) % parts.astype(np.uint64)
                yield _entries(_partition(keys, part, partitions), 2, keys, gids[rows][who], vectors.take(pa.array(rows[who])))
                for i in np.flatnonzero(asks[rows]):
                    keys = how.visits(places[i], d)[0]
                    if full:
                        parts = np.array([full.get(k, 1) for k in keys.tolist()])
                        keys, part = np.repeat(keys, parts), np.concatenate([np.arange(p) for p in parts])
                    else:
                        part = np.zeros(len(keys), np.int64)
                    pids = _partition(keys, part, partitions)
                    there = np.unique(pids)
                    gid = gids[rows[i]]
                    yield _entries(there, 0, np.zeros(len(there), np.int64), np.full(len(there), gid), vectors.take(pa.array(np.full(len(there), rows[i]))))
                    yield _entries(pids, 1, keys, np.full(len(keys), gid), pa.nulls(len(keys), vectors.type))

    return run


def _entries(pid: np.ndarray, kind: int, keys: np.ndarray, gids: np.ndarray, vectors: pa.Array) -> pa.RecordBatch:
    columns = [pa.array(pid.astype(np.int32)), pa.array(np.full(len(pid), kind, np.int32)), pa.array(keys), pa.array(gids), vectors]
    return pa.RecordBatch.from_arrays(columns, names=["pid", "kind", "key", "gid", "v"])


def _best(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, gid, score) each pair once, and each query's ``keep`` best and what ties with the last."""
    query, gid, score = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((-score, gid, query))
    query, gid, score = query[order], gid[order], score[order]
    new = np.ones(len(query), bool)
    new[1:] = (query[1:] != query[:-1]) | (gid[1:] != gid[:-1])
    query, gid, score = query[new], gid[new], score[new]
    order = np.lexsort((-score, query))
    query, gid, score = query[order], gid[order], score[order]
    starts = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
    lengths = np.diff(np.concatenate((starts, [len(query)])))
    rank = np.arange(len(query)) - np.repeat(starts, lengths)
    last = score[np.repeat(starts + np.minimum(lengths, keep) - 1, lengths)]
    kept = (rank < keep) | (score >= last)
    return query[kept], gid[kept], score[kept]


class Visits:
    """The queries of one partition: their vectors and the buckets they visit."""

    def __init__(self, keep: int):
        self.keep, self.vectors, self.visits, self.found, self.size = keep, {}, [], [], 0
        self.by_key: dict[int, list[int]] | None = None

    def meet(self, keys: np.ndarray, gids: np.ndarray, rows: np.ndarray, unit: np.ndarray) -> None:
        """Rank bucket entries (sorted by key) against the queries that visit their bucket."""
        if self.by_key is None:
            self.by_key = {}
            for k, q in self.visits:
                for key, query in zip(k.tolist(), q.tolist()):
                    self.by_key.setdefault(key, []).append(query)
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))).tolist()
        for a, b in zip(starts, [*starts[1:], len(keys)]):
            asking = [q for q in self.by_key.get(int(keys[a]), ()) if len(self.vectors[q]) == unit.shape[1]]
            if not asking:
                continue
            cosine = np.stack([self.vectors[q] for q in asking]) @ unit[a:b].T
            if b - a > 4 * self.keep:
                least = np.partition(cosine, b - a - self.keep, axis=1)[:, b - a - self.keep]
                who, which = np.nonzero(cosine >= least[:, None])
            else:
                who, which = np.nonzero(np.ones(cosine.shape, bool))
            self.found.append((np.array(asking)[who], gids[a:b][which], cosine[who, which]))
            self.size += len(who)
        if self.size > 1_000_000:
            self.found = [_best(self.found, self.keep)]
            self.size = len(self.found[0][0])


def meeting(keep: int):
    """A function for mapInArrow over rows of :func:`entry_type` sorted by pid, kind and key: FOUND rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, here = None, Visits(keep)
        for batch in batches:
            pids, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((pids[1:] != pids[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(pids)]):
                if a == b:
                    continue
                if pids[a] != pid:
                    if here.found:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _best(here.found, keep)], names=FOUND.names)
                    pid, here = pids[a], Visits(keep)
                part = batch.slice(a, b - a)
                keys, gids = part.column(2).to_numpy(), part.column(3).to_numpy()
                if kinds[a] == 1:
                    here.visits.append((keys, gids))
                    continue
                for rows, unit in _units(part.column(4)):
                    if kinds[a] == 0:
                        here.vectors.update(zip(gids[rows].tolist(), unit))
                    else:
                        here.meet(keys[rows], gids[rows], rows, unit)
        if here.found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _best(here.found, keep)], names=FOUND.names)

    return run


def ranking(asking, keep: int):
    """A function for mapInArrow: rows of (gid, v) to FOUND rows, each ranked against all of ``asking``.

    ``asking``: a broadcast list of (query numbers, unit vectors), one for each length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = {unit.shape[1]: (gids, unit) for gids, unit in asking.value}
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            gids = batch.column(0).to_numpy()
            for rows, unit in _units(batch.column(1)):
                if unit.shape[1] not in queries:
                    continue
                who, mine = queries[unit.shape[1]]
                for a in range(0, len(rows), 1024):
                    cosine = mine @ unit[a : a + 1024].T
                    n = cosine.shape[1]
                    least = np.partition(cosine, max(0, n - keep), axis=1)[:, max(0, n - keep)]
                    q, r = np.nonzero(cosine >= least[:, None])
                    found.append((who[q], gids[rows[a : a + 1024]][r], cosine[q, r]))
                    found = [_best(found, keep)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found[0]], names=FOUND.names)

    return run


def packed(rows: DataFrame, size: int) -> DataFrame:
    """(d, part, gids, unit) of (gid, v): up to ``size`` unit vectors of one length, end to end; part numbers hold for one run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 33
        for batch in batches:
            gids = batch.column(0).to_numpy()
            for at, unit in _units(batch.column(1)):
                for a in range(0, len(at), size):
                    columns = [unit.shape[1]], [part], [gids[at[a : a + size]]], [unit[a : a + size].ravel()]
                    kinds = pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["d", "part", "gids", "unit"])
                    part += 1

    return rows.select("gid", "v").mapInArrow(run, "d int, part long, gids array<long>, unit array<double>")


def block_ranking(keep: int):
    """A function for mapInArrow: rows (d, asks, asked, gids, unit) of a block of queries and one of vectors to FOUND rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            for r in range(batch.num_rows):
                d, who, mine, gids, unit = (batch.column(k)[r] for k in range(5))
                who, gids, d = who.values.to_numpy(), gids.values.to_numpy(), d.as_py()
                cosine = mine.values.to_numpy().reshape(-1, d) @ unit.values.to_numpy().reshape(-1, d).T
                least = np.partition(cosine, max(0, len(gids) - keep), axis=1)[:, max(0, len(gids) - keep)]
                q, v = np.nonzero(cosine >= least[:, None])
                found.append((who[q], gids[v], cosine[q, v]))
                size += len(q)
                if size > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in _best(found, keep)], names=FOUND.names)
                    found, size = [], 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _best(found, keep)], names=FOUND.names)

    return run


def exact(classes: DataFrame, short: DataFrame, keep: int) -> DataFrame | None:
    """FOUND rows of the queries ``short`` (gid, v) against all of ``classes``; None if there is none.

    One job however many they are: blocks of SHORT_QUERIES queries are copied to as
    many groups as there are shuffle partitions, each of which holds its share of
    blocks of vectors; every block of queries meets every block of vectors there.
    """
    if not short.limit(1).count():
        return None
    groups = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asking = packed(short, SHORT_QUERIES).select("d", F.col("gids").alias("asks"), F.col("unit").alias("asked"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    parts = packed(classes, PACKED).withColumn("g", F.pmod(F.xxhash64("part"), F.lit(groups)).cast("int"))
    met = asking.join(parts, ["d", "g"]).select("d", "asks", "asked", "gids", "unit")
    return checkpoint(met.mapInArrow(block_ranking(keep), FOUND))


def true_neighbours(classes: DataFrame, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(vector, vectors of its ``k`` nearest) of a bounded sample of the queries among ``classes``, by ranking all."""
    sample = classes.where("asks").orderBy("gid").limit(SAMPLE_QUERIES).select("gid", "v").collect()
    if not sample:
        return []
    gids, v = np.array([r["gid"] for r in sample], np.int64), pa.array([r["v"] for r in sample], pa.list_(pa.float64()))
    asking = classes.sparkSession.sparkContext.broadcast([(gids[rows], unit) for rows, unit in _units(v)])
    found = classes.select("gid", "v").mapInArrow(ranking(asking, k + 1), FOUND).where("gid <> query")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "gid")
    top = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).select("query", "gid")
    near: dict[int, list] = {}
    for r in classes.select("gid", "v").join(F.broadcast(top), "gid").collect():
        near.setdefault(r["query"], []).append(r["v"])
    return [(np.array(r["v"], np.float64), np.array(near[r["gid"]], np.float64)) for r in sample if r["gid"] in near]


def fitted(sample: list[tuple[np.ndarray, np.ndarray]], vectors: int, wanted: float = WANTED_RECALL) -> Probing | None:
    """The projections and least visits that find the share ``wanted`` of a sample's neighbours.

    None if there is no sample, or no setting finds enough.  The cost doesn't
    depend on the number of vectors.
    """
    projections = max(2, round(np.log2(max(2, vectors / BUCKET_ROWS)) / PLACE_BITS))
    while sample and projections > 0:
        how = Probing(projections=projections, probes=min(MOST_PROBES, 3**projections))
        need = []
        for q, near in sample:
            keys, turns = how.visits(how.places(_scaled(q)[None])[0], len(q))
            first = dict(zip(keys.tolist(), turns.tolist()))
            cells = np.floor(how.places(_scaled(near)))
            n, t = cells.shape[:2]
            own = how.keys(cells.reshape(n * t, -1), np.tile(np.arange(t), n), len(q)).reshape(n, t)
            need += [min(first.get(x, MOST_PROBES) for x in row) for row in own.tolist()]
        least = sorted(need)[max(0, int(np.ceil(wanted * len(need))) - 1)]
        if least < MOST_PROBES:
            return Probing(projections=projections, probes=least + 1)
        projections -= 2 if projections > 2 else 1
    return None


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(gid, v, asks, ids, least): each vector once, with its ``k`` + 1 least keys and whether a query has it.

    gid is a hash of the vector; should two vectors share one, another seed is taken.
    """
    for seed in range(16):
        named = rows.withColumn("gid", F.xxhash64(F.lit(seed), F.col("v")))
        least = Window.partitionBy("gid").orderBy("vec_id")
        first = named.select("gid", "vec_id").distinct().withColumn("_n", F.row_number().over(least)).where(F.col("_n") <= k + 1)
        ids = first.groupBy("gid").agg(F.collect_list("vec_id").alias("ids"), F.min("vec_id").alias("least"))
        whole = named.groupBy("gid").agg(F.min("v").alias("v"), F.max("v").alias("_v"), F.max("asks").alias("asks"))
        classes = checkpoint(whole.join(ids, "gid").select("gid", "v", (F.col("v") != F.col("_v")).alias("_clash"), "asks", "ids", "least", F.lit(seed).alias("seed")))
        if classes.where("_clash").isEmpty():
            return classes.drop("_clash")
    raise ValueError("no seed tells the vectors apart")


def nearest(vectors: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = 5, how: Probing | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query row, nearest first.

    ``is_query``: a condition on the key column.  Candidates are all rows but
    those with the query's own key; ties go to the smaller key; score is the
    cosine in double precision.  Null vectors and keys, zero vectors and vectors
    with null or non-finite components take no part; vectors of different
    lengths do not meet; a repeated row counts once.  A query gets fewer than ``k``
    rows only if it has fewer candidates: where the buckets it visits hold too
    few, all rows are ranked.  An empty table gives an empty one; other columns
    are ignored.  ``how``: projections and visits; fitted to the vectors if None.
    """
    rows = usable(vectors, key, vector).withColumn("asks", is_query(F.col("vec_id")))
    classes = distinct_vectors(rows, k)
    seed = classes.select("seed").first()
    rows = rows.select("vec_id", F.xxhash64(F.lit(seed["seed"] if seed else 0), F.col("v")).alias("gid"), F.size("v").alias("d"), "asks").distinct()
    queries = checkpoint(rows.where("asks").select(F.col("gid").alias("query"), F.col("vec_id").alias("query_id")))
    size = classes.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    how = how or fitted(true_neighbours(classes, k), size["n"]) or Probing(projections=1, probes=3)
    load = size["n"] * how.tables + size["q"] * how.tables * how.probes // 8
    partitions = max(8, -(-load // PARTITION_ROWS))

    entry = entry_type(classes)
    hashed = classes.select("gid", "v", F.lit(False).alias("asks")).mapInArrow(entries(how, {}, partitions), entry)
    limit = max(FULL_BUCKET, size["n"] * how.tables // FULL_BUCKETS)
    crowded = hashed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > limit).collect()
    full = {r["key"]: -(-r["n"] // limit) for r in crowded}

    dealt = classes.select("gid", "v", "asks").mapInArrow(entries(how, full, partitions), entry)
    dealt = dealt.repartition(partitions, "pid").sortWithinPartitions("pid", "kind", "key")
    found = dealt.mapInArrow(meeting(k + 1), FOUND)
    names = classes.select("gid", "ids", "least")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "least")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        found = found.groupBy("query", "gid").agg(F.max("score").alias("score"))
        top = found.join(names, "gid").withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1)
        pairs = queries.join(top.select("query", "score", F.explode("ids").alias("vec_id")), "query").where("vec_id <> query_id")
        return pairs.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)

    near = checkpoint(ranked(found))
    lengths = rows.select("vec_id", "d")
    all_of = lengths.groupBy("d").agg(F.count("*").alias("n"))  # a row for each length of vector
    own = lengths.groupBy("d", F.col("vec_id").alias("query_id")).agg(F.count("*").alias("own"))
    wanted = queries.join(classes.select(F.col("gid").alias("query"), F.size("v").alias("d")), "query").join(F.broadcast(all_of), "d").join(own, ["d", "query_id"])
    wanted = wanted.groupBy("query_id").agg(F.max(F.col("n") - F.col("own")).alias("n"))
    got = near.groupBy("query_id").agg(F.count("*").alias("got"))
    short = wanted.join(got, "query_id", "left").where(F.coalesce("got", F.lit(0)) < F.least(F.lit(k), "n")).select("query_id")
    short = checkpoint(queries.join(short, "query_id", "left_semi"))
    all_found = exact(classes, classes.join(short.select(F.col("query").alias("gid")).distinct(), "gid", "left_semi").select("gid", "v"), k + 1)
    if all_found is not None:
        again = ranked(all_found).join(short.select("query_id").distinct(), "query_id", "left_semi")
        near = near.join(short.select("query_id").distinct(), "query_id", "left_anti").unionByName(again)
    return near.select("query_id", "rank", "vec_id", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("score"))).alias("score"))
