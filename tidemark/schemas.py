"""Schemas of the records in flight and the tables at rest."""

from pyspark.sql import types as T

MESSAGE = T.StructType([
    T.StructField("uid", T.LongType()),
    T.StructField("account_id", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("sender", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("body", T.StringType()),
])

RESULT = T.StructType([
    T.StructField("original_uid", T.LongType()),
    T.StructField("priority", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("key_entities", T.ArrayType(T.StringType())),
    T.StructField("action_required", T.BooleanType()),
    T.StructField("is_truncated", T.BooleanType()),
])

CURSORS = T.StructType([
    T.StructField("account_id", T.StringType(), False),
    T.StructField("last_uid", T.LongType(), False),
    T.StructField("updated_at", T.TimestampType()),
])

AUDIT = T.StructType([
    T.StructField("audit_id", T.StringType(), False),
    T.StructField("run_id", T.StringType(), False),
    T.StructField("batch_id", T.LongType(), False),
    T.StructField("account_id", T.StringType(), False),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("before_uid", T.LongType(), False),
    T.StructField("after_uid", T.LongType(), False),
    T.StructField("emails_processed", T.LongType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("error_msg", T.StringType()),
])

CACHE = T.StructType([
    T.StructField("content_hash", T.StringType(), False),
    T.StructField("account_id", T.StringType(), False),
    T.StructField("uid", T.LongType(), False),
    T.StructField("result", RESULT),
    T.StructField("model_version", T.StringType(), False),
    T.StructField("created_at", T.TimestampType()),
])

EMAILS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("run_id", T.StringType(), False),
    T.StructField("batch_id", T.LongType(), False),
    T.StructField("account_id", T.StringType(), False),
    T.StructField("uid", T.LongType(), False),
    T.StructField("content_hash", T.StringType(), False),
    T.StructField("subject", T.StringType()),
    T.StructField("sender", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("sent_at", T.TimestampNTZType()),
    T.StructField("body_preview", T.StringType()),
    T.StructField("priority", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("key_entities", T.ArrayType(T.StringType())),
    T.StructField("action_required", T.BooleanType()),
    T.StructField("is_truncated", T.BooleanType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

RESPONSES = T.StructType([
    T.StructField("content_hash", T.StringType(), False),
    T.StructField("model_version", T.StringType(), False),
    T.StructField("raw_json", T.StringType()),
    T.StructField("error", T.StringType()),          # set when the call failed
])
