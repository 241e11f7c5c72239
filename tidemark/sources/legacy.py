"""Typed view of rows imported from the original text-typed store.

There ``key_entities`` is JSON text and the two flags are 0/1 integers. On
read, JSON text becomes an array; text that is not a JSON array of strings
is kept in ``key_entities_raw`` (the original left it as is); empty or null
text stays null; integer flags become booleans when not null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decode_legacy(df: DataFrame) -> DataFrame:
    raw = F.col("key_entities")
    v = F.try_parse_json(raw)
    arr = F.when(F.schema_of_variant(v).isin("ARRAY<STRING>", "ARRAY<VOID>"),
                 F.try_variant_get(v, "$", "array<string>"))
    ok = arr.isNotNull() & ~F.exists(arr, lambda x: x.isNull())
    empty = raw.isNull() | (raw == "")
    return (df.withColumn("key_entities_raw", F.when(~empty & ~ok, raw))
              .withColumn("key_entities", F.when(~empty & ok, arr))
              .withColumn("action_required", F.col("action_required").cast("int") != 0)
              .withColumn("is_truncated", F.col("is_truncated").cast("int") != 0))


def encode_legacy(df: DataFrame) -> DataFrame:
    """Typed store rows -> the text-typed layout (for exports)."""
    return (df.withColumn("key_entities", F.when(F.col("key_entities").isNotNull(), F.to_json("key_entities")))
              .withColumn("action_required", F.col("action_required").cast("int"))
              .withColumn("is_truncated", F.col("is_truncated").cast("int")))
