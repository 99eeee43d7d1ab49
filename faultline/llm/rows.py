"""Rows by id and text: verdicts on rows are joined back to tables whose ids may repeat or be null."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

ID, DIGEST = "__row_id", "__row_digest"


def id_type(docs: DataFrame, id_col: str) -> tuple[pa.DataType, str]:
    """The type of the ids, for Arrow and in a schema's text."""
    kind = docs.select(id_col).schema[0].dataType
    return to_arrow_type(kind), kind.simpleString()


def digest(text: Column) -> Column:
    """64-bit digest of a text with its length mixed in; a null text counts as empty."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.xxhash64(t, F.length(t))


def _matches(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    keys = keys.select(F.col("id").alias("__key_id"), F.col("digest").alias("__key_digest"))
    return docs.join(keys, docs[ID].eqNullSafe(keys["__key_id"]) & (docs[DIGEST] == keys["__key_digest"]), how)


def without(docs: DataFrame, gone: DataFrame, once: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose id and digest of the text are in `gone`; of the rows of a key in `once` one stays.

    Rows of one id with other texts aren't touched. Both lists are tables, which Spark
    broadcasts where they are small.
    """
    named = docs.withColumns({ID: F.col(id_col), DIGEST: digest(F.col(text_col))})
    left = _matches(named, gone, "left_anti")
    if once is not None and not once.isEmpty():
        left = _matches(left, once, "left_anti").unionByName(_matches(left, once, "left_semi").dropDuplicates([ID, DIGEST]))
    return left.drop(ID, DIGEST)
