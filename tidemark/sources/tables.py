"""Readers for the landed tables and the views derived from them.

The landed mail table at scale is wide (bodies up to megabytes), so every
reader selects only the columns its caller needs; Catalyst then prunes the
Parquet read schema and pushes filters into the scan.

Fixture views (``messages``, ``cursors``, ``responses``, ``cache``) are pure
functions of the driver tables, so their size grows with the data.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fingerprint import fingerprint
from ..functions.results import result_struct
from ..functions.text import is_truncated
from ..operators.joins import broadcast_if_small

# fixed values of the fixture world (parameters, never clocks or random ids)
FIXTURE_MODEL = "m1"
FIXTURE_OLD_MODEL = "m0"
FIXTURE_RUN_ID = "a1b2c3d4"
FIXTURE_CREATED_AT = "2024-03-01 12:00:00"
FIXTURE_CURSOR_AT = "2024-02-15 00:00:00"
FIXTURE_CACHE_AT = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*cols) if cols else df


def _date_header(n, lang):
    """Mail-form header for English documents, ISO date otherwise."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (n % 60).cast("int"))
    hh = F.lpad((n % 24).cast("string"), 2, "0")
    mi = F.lpad((n % 59).cast("string"), 2, "0")
    zone = (F.when(n % 3 == 0, F.lit("+0000")).when(n % 3 == 1, F.lit("-0700")).otherwise(F.lit("GMT")))
    mail = F.concat(F.date_format(day, "EEE, dd MMM yyyy"), F.lit(" "), hh, F.lit(":"), mi,
                    F.lit(":00 "), zone)
    return F.when(lang == "en", mail).otherwise(F.date_format(day, "yyyy-MM-dd"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``messages`` view: one message per document, one account per source.

    sender and date derive from the text length, so exact copies share a
    fingerprint (the cross-account duplicates the cache exists for).
    """
    return messages_from_documents(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))


def messages_from_documents(d: DataFrame) -> DataFrame:
    """The ``messages`` mapping on any frame of documents (batch or stream)."""
    n = F.length("text")
    return d.select(
        F.concat(F.lit("acct_"), F.col("source")).alias("account_id"),
        (F.col("doc_id") + 1).alias("uid"),
        F.substring(F.substring_index(F.col("text"), "\n", 1), 1, 80).alias("subject"),
        F.concat(F.lit("u"), (n % 50).cast("string"), F.lit("@example.com")).alias("sender"),
        _date_header(n, F.col("lang")).alias("date"),
        F.col("text").alias("body"),
    )


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a second landed message stream: one account per user,
    uid = event_id + 1, the event type as subject and props as body."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "props")
    return e.select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("account_id"),
        (F.col("event_id") + 1).alias("uid"),
        F.col("event_type").alias("subject"),
        F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@events.example")).alias("sender"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("date"),
        F.col("props").alias("body"),
    )


def accounts(msgs: DataFrame) -> DataFrame:
    """Account dimension (config order = account_id order)."""
    return msgs.select("account_id").distinct()


def cursors(msgs: DataFrame) -> DataFrame:
    """Prior cursors: the middle uid of each account; some accounts have none."""
    g = msgs.groupBy("account_id").agg(F.min("uid").alias("lo"), F.max("uid").alias("hi"))
    return g.filter(F.col("hi") % 4 != 0).select(
        "account_id",
        F.expr("(lo + hi) div 2").cast("bigint").alias("last_uid"),
        F.lit(FIXTURE_CURSOR_AT).cast("timestamp").alias("updated_at"),
    )


def _answer_json(doc_id, uid, lang, quality, toxic):
    lang = F.coalesce(lang, F.lit(""))
    pri = F.when(toxic == 1, F.lit("Spam")).when(quality == 1, F.lit("High")).otherwise(F.lit("Low"))
    act = F.when((quality == 1) & (toxic == 0), F.lit("true")).otherwise(F.lit("false"))
    uid_s = uid.cast("string")
    summary = F.concat(F.lit('"summary": "Message '), uid_s, F.lit(" in "), lang, F.lit('"'))
    ents = F.concat(F.lit('"key_entities": ["lang:'), lang, F.lit('", "uid:'), uid_s, F.lit('"]'))

    def obj(p, s, e, a):
        return F.concat(F.lit("{"), p, F.lit(", "), s, F.lit(", "), e, F.lit(", "), a, F.lit("}"))

    p_ok = F.concat(F.lit('"priority": "'), pri, F.lit('"'))
    a_ok = F.concat(F.lit('"action_required": '), act)
    k = doc_id % 20
    return (
        F.when(k == 3, obj(F.lit('"priority": "HIGH"'), summary, ents, a_ok))
        .when(k == 5, F.lit("I am unable to classify this message."))
        .when(k == 7, F.lit('{"priority": "High"}'))
        .when(k == 9, obj(p_ok, F.lit('"summary": null'), ents, a_ok))
        .when(k == 11, obj(p_ok, summary, F.lit('"key_entities": [1, 2]'), a_ok))
        .when(k == 13, obj(p_ok, summary, ents, F.lit('"action_required": "maybe"')))
        .when(k == 15, obj(p_ok, summary, ents, F.lit('"action_required": "Yes"')))
        .when(k == 17, F.lit("[1, 2]"))
        .when(k == 19, obj(p_ok, summary, F.lit('"key_entities": []'), F.lit('"action_required": 1')))
        .when(k == 1, obj(p_ok, summary, F.lit('"key_entities": ["x", null]'), F.lit('"action_required": 0.0')))
        .otherwise(obj(p_ok, summary, ents, a_ok))
    )


def _text_answer_json(uid, lang, n):
    """Answer for an unlabelled message: priority from its length."""
    lang = F.coalesce(lang, F.lit(""))
    pri = F.when(n > 5000, F.lit("Medium")).otherwise(F.lit("Low"))
    uid_s = uid.cast("string")
    return F.concat(F.lit('{"priority": "'), pri, F.lit('", "summary": "Message '), uid_s, F.lit(" in "), lang,
                    F.lit('", "key_entities": ["lang:'), lang, F.lit('"], "action_required": false}'))


def responses(spark: SparkSession, sf_dir: str, msgs: DataFrame | None = None) -> DataFrame:
    """Model answers per (content_hash, model_version).

    The answer for a fingerprint is the one for its lowest uid: built from
    ``labels`` when that document is labelled (with malformed answers mixed
    in), else from the text; every sixteenth unlabelled document has no
    answer yet (pending).
    """
    msgs = msgs if msgs is not None else messages(spark, sf_dir)
    lab = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    docs = table(spark, sf_dir, "documents", "doc_id", "lang")
    m = msgs.select("uid", fingerprint().alias("content_hash"), F.length("body").alias("n"))
    rep = (m.groupBy("content_hash").agg(F.min_by(F.struct("uid", "n"), F.col("uid")).alias("r"))
            .select("content_hash", "r.uid", "r.n", (F.col("r.uid") - 1).alias("doc_id")))
    j = rep.join(docs, "doc_id", "left").join(lab, "doc_id", "left")
    labelled = F.col("quality").isNotNull() | F.col("toxic").isNotNull()
    j = j.filter(labelled | (F.col("doc_id") % 16 != 5))
    raw = F.when(labelled, _answer_json(F.col("doc_id"), F.col("uid"), F.col("lang"), F.col("quality"), F.col("toxic")))
    raw = raw.otherwise(_text_answer_json(F.col("uid"), F.col("lang"), F.col("n")))
    return j.select("content_hash", F.lit(FIXTURE_MODEL).alias("model_version"), raw.alias("raw_json"))


def cache(msgs: DataFrame, curs: DataFrame) -> DataFrame:
    """Prior result cache: results written by earlier runs for every message
    at or below its account's cursor, alternately under the current and an
    older model; the last writer (highest uid) per fingerprint is kept."""
    prios = F.array(*[F.lit(p) for p in ["High", "Medium", "Low", "Spam"]])
    src = (msgs.join(broadcast_if_small(curs.select("account_id", "last_uid")), "account_id")
               .filter(F.col("uid") <= F.col("last_uid"))
               .select("account_id", "uid", fingerprint().alias("content_hash"),
                       is_truncated("body").alias("trunc")))
    res = result_struct(
        F.col("uid"), F.element_at(prios, (F.col("uid") % 4 + 1).cast("int")),
        F.concat(F.lit("cached "), F.col("uid").cast("string")),
        F.array(F.lit("cache"), F.col("account_id")),
        F.col("uid") % 2 == 0, F.col("trunc"),
    )
    rows = src.select(
        "content_hash", "account_id", "uid", res.alias("result"),
        F.when(F.col("uid") % 5 == 0, F.lit(FIXTURE_OLD_MODEL)).otherwise(F.lit(FIXTURE_MODEL)).alias("model_version"),
        F.lit(FIXTURE_CACHE_AT).cast("timestamp").alias("created_at"),
    )
    latest = rows.groupBy("content_hash").agg(F.max_by(F.struct(*rows.columns), F.col("uid")).alias("r"))
    return latest.select("r.*")
