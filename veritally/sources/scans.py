"""Scans of the feeds' file formats.

Feeds are landed as files first; a scan never asks a server row by row.  Every
scan has an explicit schema: identifiers stay strings, with leading zeros.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritally.sources import schemas

# What addresses of counting stations and of data files hold.
STATION_WORDS = ("station", "vote_station", "หน่วย")
DATA_WORDS = ("/data/", "/records/", "/refs/")

#: Feeds of an official count, and whether a run can do without.
FEEDS = {"statistics": False, "provinces": False, "parties": False, "constituencies": True, "candidates": True}


def read_json(spark: SparkSession, path: str, schema: T.StructType, lines: bool = False) -> DataFrame:
    """A document, or a list of records, that may span lines; ``lines``: one object a line.

    A file that may span lines is read by one task, a file of lines is split:
    land large feeds as lines.  Fields that don't fit the schema are null.
    """
    return spark.read.schema(schema).json(path, multiLine=not lines)


def read_json_or_none(spark: SparkSession, path: str, schema: T.StructType, lines: bool = False) -> DataFrame | None:
    """:func:`read_json`, but None where nothing has landed under ``path`` or what has is no JSON."""
    if not _exists(spark, path):
        return None
    whole = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = read_json(spark, path, whole, lines)
    bad = rows.where(F.col("_corrupt_record").isNotNull() & F.col(f"`{schema.fields[0].name}`").isNull())
    return rows.drop("_corrupt_record") if bad.isEmpty() else None


def read_json_list(spark: SparkSession, path: str, schema: T.StructType, *keys: str, lines: bool = False) -> DataFrame:
    """Records of a list root, or of an object root that holds the list under one of ``keys``; ``lines``: such a root a line."""
    record = schema.simpleString()
    nested = T.StructType([*schema.fields, *[T.StructField(k, T.ArrayType(schema)) for k in keys]])
    rows = read_json(spark, path, nested, lines)
    if not keys:
        return rows
    own = F.struct(*[F.col(f"`{f.name}`") for f in schema.fields]).cast(record)
    lists = F.coalesce(*[F.col(f"`{k}`") for k in keys], F.array(own))
    return rows.select(F.explode(lists).alias("r")).select("r.*")


def read_feed(spark: SparkSession, folder: str, name: str, lines: bool = False) -> DataFrame:
    """One of FEEDS below ``folder``; an optional one that is missing is empty; ``lines``: large ones, landed in pieces, one a line."""
    shape = {
        "statistics": (schemas.STATISTICS,),
        "provinces": (schemas.PROVINCES, "province"),
        "parties": (schemas.PARTIES,),
        "constituencies": (schemas.CONSTITUENCIES, "constituency", "constituencies"),
        "candidates": (schemas.CANDIDATES,),
    }[name]
    path = f"{folder}/{name}.json"
    if FEEDS[name] and not _exists(spark, path):
        return spark.createDataFrame([], shape[0])
    if name == "provinces":  # the list may have the name of one of its fields
        return _provinces(spark, path, lines)
    return read_json_list(spark, path, *shape, lines=lines)


def _provinces(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    rows = spark.read.schema("prov_id string, province string").json(path, multiLine=not lines)
    listed = F.from_json("province", T.ArrayType(schemas.PROVINCES))
    whole = F.coalesce(F.when(F.col("prov_id").isNull(), listed), F.array(F.struct("prov_id", "province")))
    return rows.select(F.explode(whole).alias("r")).select("r.*")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_units(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The unit table of published documents: their arrays ``units``, one row each."""
    document = T.StructType([T.StructField("units", T.ArrayType(schemas.UNITS))])
    return read_json(spark, path, document, lines).select(F.explode("units").alias("u")).select("u.*")


def read_unit_list(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of unit_id, constituency, province (UTF-8, with or without a byte order mark); empty where nothing was written."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where):
        return spark.createDataFrame([], schemas.UNIT_LIST)
    return spark.read.csv(path, header=True, schema=schemas.UNIT_LIST, enforceSchema=True, escape='"')


def read_unit_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One source's unit documents, all of a folder in one scan."""
    return read_json(spark, path, schemas.UNIT_DOCUMENT, lines)


def exploded(documents: DataFrame) -> DataFrame:
    """(unit_id, name, votes, position) of unit documents; missing names are ``unknown``, missing votes 0."""
    items = F.when(F.col("candidates").isNotNull(), F.col("candidates")).otherwise(F.col("parties"))
    rows = documents.select("unit_id", F.posexplode(items).alias("position", "c"))
    return rows.select("unit_id", F.coalesce("c.name", F.lit("unknown")).alias("name"), F.coalesce("c.votes", F.lit(0)).alias("votes"), "position")


def from_records(spark: SparkSession, rows: Iterable[Mapping], schema: T.StructType) -> DataFrame:
    """Records in memory; fields that a record lacks are null."""
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)


def synthetic_votes(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """(id, skewed, uniform): see :func:`with_synthetic_votes`."""
    return with_synthetic_votes(spark.range(n), "id", seed)


def with_synthetic_votes(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Adds log-normal (skewed) and uniform votes, for trying the first-digit test; they depend on the key and the seed alone."""
    part = lambda k: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(k), F.col(key)), 11) + 1) / F.lit(float(1 << 53))
    normal = F.sqrt(-2 * F.ln(part(1))) * F.cos(2 * F.pi() * part(2))
    return rows.withColumn("skewed", F.exp(8 + 2 * normal).cast("bigint")).withColumn("uniform", (1000 + F.floor(part(3) * 8999)).cast("bigint"))


def perturbed(votes: DataFrame, unit: str, amount: Mapping[int, int], modulus: int, name: str, only: str) -> DataFrame:
    """A second source made from a first: ``amount`` by the unit's number modulo ``modulus`` is added to one name."""
    add = F.lit(0)
    for remainder, votes_added in amount.items():
        add = F.when((F.col(name) == only) & (F.col(unit) % modulus == remainder), votes_added).otherwise(add)
    return votes.withColumn("votes", F.col("votes") + add)


def live_endpoints(probes: DataFrame) -> DataFrame:
    """Probed addresses that answered with status 200."""
    return probes.where("status = 200")


def endpoint_outcomes(probes: DataFrame) -> DataFrame:
    """Adds outcome: found (200), absent (404), reported (any other answer), or error (no answer)."""
    outcome = F.when(F.col("status") == 200, "found").when(F.col("status") == 404, "absent").when(F.col("status").isNotNull(), "reported")
    return probes.withColumn("outcome", outcome.otherwise("error"))


def json_fields(df: DataFrame, json: str) -> DataFrame:
    """(field, rows): top-level keys of a column of JSON objects."""
    return df.select(F.explode(F.json_object_keys(json)).alias("field")).groupBy("field").agg(F.count("*").alias("rows"))


def field_counts(df: DataFrame, json: str, field: str, kind: str, *by: str) -> DataFrame:
    """(*by, field, n): how often each value of a top-level field of JSON objects stands; null where it is missing."""
    value = F.get_json_object(json, f"$.{field}").cast(kind).alias(field)
    return df.select(*by, value).groupBy(*by, field).agg(F.count("*").alias("n"))


def entries(json: str) -> Column:
    """Entries of a JSON list, or keys of a JSON object; null for other values."""
    return F.coalesce(F.json_array_length(json), F.size(F.json_object_keys(json)))


def quoted(words: Iterable[str]) -> str:
    """Pattern of a quoted string that holds one of ``words`` (see :func:`addresses`)."""
    return "[\"']([^\"']*(?:" + "|".join(words) + ")[^\"']*)[\"']"


def addresses(df: DataFrame, html: str, pattern: str = 'href="([^"]+)"', longest: int = 150) -> DataFrame:
    """(url, found): distinct matches of a pattern's group, shorter than ``longest``."""
    found = df.select(F.explode(F.regexp_extract_all(html, F.lit(pattern), 1)).alias("url"))
    return found.where(F.length("url") < longest).groupBy("url").agg(F.count("*").alias("found"))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The nested anomaly report (a row of ``operators.report.REPORT``) as :func:`sinks.write_json` wrote it."""
    from veritally.operators.report import REPORT

    return spark.read.schema(REPORT).json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(json): documents of any shape, one a line, as text."""
    return spark.read.text(path).withColumnRenamed("value", "json")
