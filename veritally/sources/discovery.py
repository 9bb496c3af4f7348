"""What JSON documents hold: every nested path with its types, how often, and the sizes of lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.functions.shared import checkpoint

#: Names of the types by what Spark calls a VARIANT's.
TYPES = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null", "BIGINT": "integer", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number"}


def discover(documents: DataFrame, json: str) -> DataFrame:
    """(path, type, count, share, least_size, greatest_size) over all documents of a string column.

    ``path`` starts at ``$``; keys follow a dot, members of lists are ``[]``.  A path
    with values of several types has a row for each.  ``share``: of the objects that
    hold the path's last key or could (those at the path around it), or of the
    members of its lists; of the documents for ``$``.  Sizes are those of lists.
    Text that is no JSON has type ``broken``, null documents ``missing``.

    Documents are parsed once to VARIANT; each level of nesting is one explode of the
    objects and lists of the level above and a partial aggregate, so the work follows
    the documents' size and no path list is needed beforehand.
    """
    spark = documents.sparkSession
    whole = documents.select(F.lit("$").alias("path"), F.try_parse_json(F.col(json)).alias("v"), F.when(F.col(json).isNull(), "missing").otherwise("broken").alias("none"))
    kind = F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0)
    names = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    typed = lambda rows, none: rows.withColumn("type", F.when(F.col("v").isNull(), none).otherwise(F.coalesce(names[kind], F.lower(kind))))
    level, found = typed(whole, F.col("none")).drop("none"), None
    while True:
        level = checkpoint(level)
        size = F.when(F.col("type") == "array", F.size(F.col("v").cast("array<variant>")))
        own = level.groupBy("path", "type").agg(F.count("*").alias("count"), F.min(size).alias("least_size"), F.max(size).alias("greatest_size"), F.sum(size).alias("members"))
        found = own if found is None else found.unionByName(own)
        nested = level.where("type in ('object', 'array')")
        if not nested.limit(1).count():
            break
        inner = spark.sql("select n.path, n.type, x.key, x.value from {n} n, lateral variant_explode(n.v) x", n=nested)
        at = F.concat("path", F.when(F.col("type") == "array", "[]").otherwise(F.concat(F.lit("."), "key")))
        level = typed(inner.select(at.alias("path"), F.col("value").alias("v")), F.lit("null"))
    found = checkpoint(found)  # as many rows as there are paths and types
    around = F.when(F.col("path").endswith("[]"), F.substring("path", F.lit(1), F.length("path") - 2)).otherwise(F.regexp_replace("path", r"\.[^.]*$", ""))
    holds = F.when(F.col("path").endswith("[]"), "array").otherwise("object")
    parents = found.where("type in ('object', 'array')").select(F.col("path").alias("_around"), F.col("type").alias("_holds"), F.when(F.col("type") == "array", F.col("members")).otherwise(F.col("count")).alias("_of"))
    documents_ = found.where("path = '$'").agg(F.sum("count").alias("_all"))
    rows = found.withColumn("_around", F.when(F.col("path") != "$", around)).withColumn("_holds", holds).join(parents, ["_around", "_holds"], "left").crossJoin(F.broadcast(documents_))
    share = F.try_divide(F.col("count"), F.when(F.col("path") == "$", F.col("_all")).otherwise(F.col("_of")))
    return rows.select("path", "type", "count", F.round(share, 4).alias("share"), F.col("least_size").cast("long").alias("least_size"), F.col("greatest_size").cast("long").alias("greatest_size"))
