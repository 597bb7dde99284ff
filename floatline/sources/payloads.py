"""Landed JSON payloads: parsed once, the unreadable ones set apart.

A payload is unreadable when it is missing, is not one JSON object, or holds a
value of another kind where an object or a list belongs (a truncated download,
an error page, an empty file).  It loses its own rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CORRUPT = "_corrupt"
UNREADABLE = "unreadable_document"


def parsed(docs: DataFrame, schema: T.StructType, *keys: str, json: str = "json") -> DataFrame:
    """``keys``, ``d`` (the payload, null if unreadable) and ``unreadable`` of
    every document.

    The payload is parsed as the first member of an object of our own, so that
    whatever follows it, or is missing at its end, breaks the object (the
    corrupt-record column then holds the text) or closes it before its last member."""
    wrapped = T.StructType([T.StructField("d", schema), T.StructField("whole", T.BooleanType()),
                            T.StructField(_CORRUPT, T.StringType())])
    whole = F.concat(F.lit('{"d":'), F.col(json), F.lit(',"whole":true}'))
    # A generator is not merged with the projections above it, which use the parsed payload many times.
    p = docs.select(*keys, F.explode(F.array(F.from_json(whole, wrapped, {"columnNameOfCorruptRecord": _CORRUPT}))).alias("_p"))
    bad = (F.col("_p").isNull() | F.col(f"_p.{_CORRUPT}").isNotNull() | F.col("_p.d").isNull()
           | F.col("_p.whole").isNull())
    return p.select(*keys, F.when(~bad, F.col("_p.d")).alias("d"), bad.alias("unreadable"))


def quarantine(docs: DataFrame, schema: T.StructType, source: str, *keys: str, json: str = "json") -> DataFrame:
    """The unreadable documents as they landed: source, document (its keys
    joined by '/'), reason, n_chars and the text itself."""
    p = parsed(docs.select(*keys, json, F.col(json).alias("_text")), schema, *keys, "_text", json=json)
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    return p.where("unreadable").select(
        F.lit(source).alias("source"), name.alias("document"), F.lit(UNREADABLE).alias("reason"),
        F.coalesce(F.length("_text"), F.lit(0)).cast("long").alias("n_chars"), F.col("_text").alias("json"))
