"""

``entry(spark)`` runs the flagship query (the whole ingest decision for one
run) on sf0.001. ``queries()`` maps every registered operator to a
``(spark, sf_dir) -> DataFrame`` callable; ``oracle_sql()`` gives, for each,
the same computation in DuckDB SQL over the driver's tables. Both sides
derive the fixture world (messages, cursors, cache, answers) from the
driver tables with the same rules (see ``tidemark/sources/tables.py``).
"""

from __future__ import annotations

import html.entities
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark import constants as K  # noqa: E402
from tidemark.functions import render as RD  # noqa: E402
from tidemark.functions import results as RS  # noqa: E402
from tidemark.plans import catalog, catalog_store  # noqa: E402
from tidemark.session import ensure_checkpoint_dir  # noqa: E402
from tidemark.sources import tables as TB  # noqa: E402

try:  # the training-data operators and their pipeline are an optional part
    import corpus_pipeline
    from tidemark.llm import queries as llm_queries
except ImportError:
    corpus_pipeline = llm_queries = None

SMOKE_DIR = "/root/testdata/sf0.001"


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the ingest outcome (cache hits, fresh answers, quarantine,
    held-back rows) for every message of the run on sf0.001."""
    ensure_checkpoint_dir(spark)
    return catalog.q_outcome_fanout(spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def wrap(fn):
        def run(spark, sf_dir):
            ensure_checkpoint_dir(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        return run
    optional = {**llm_queries.QUERIES, "pipeline": corpus_pipeline.run} if llm_queries else {}
    return {k: wrap(v) for k, v in (catalog.QUERIES | catalog_store.QUERIES | optional).items()}


# ---------------------------------------------------------------------------
# DuckDB oracle
# ---------------------------------------------------------------------------

def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def lst(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


RUN, MODEL, OLD = TB.FIXTURE_RUN_ID, TB.FIXTURE_MODEL, TB.FIXTURE_OLD_MODEL
CREATED = f"TIMESTAMP '{TB.FIXTURE_CREATED_AT}'"

MESSAGES = f"""
messages AS (
  SELECT 'acct_' || source AS account_id, doc_id + 1 AS uid,
         substr(split_part(text, chr(10), 1), 1, 80) AS subject,
         'u' || CAST(length(text) % 50 AS VARCHAR) || '@example.com' AS sender,
         CASE WHEN lang = 'en' THEN
              strftime(DATE '2024-01-01' + CAST(length(text) % 60 AS INTEGER), '%a, %d %b %Y') || ' '
              || lpad(CAST(length(text) % 24 AS VARCHAR), 2, '0') || ':'
              || lpad(CAST(length(text) % 59 AS VARCHAR), 2, '0') || ':00 '
              || CASE length(text) % 3 WHEN 0 THEN '+0000' WHEN 1 THEN '-0700' ELSE 'GMT' END
         ELSE strftime(DATE '2024-01-01' + CAST(length(text) % 60 AS INTEGER), '%Y-%m-%d') END AS date,
         text AS body
  FROM documents)"""


def _int(expr: str) -> str:
    return f"TRY_CAST(NULLIF({expr}, '') AS BIGINT)"


def sent_at_sql(col: str = "date") -> str:
    # the oracle's own spelling of the two date forms
    m = (r"^\s*(?:[A-Za-z][A-Za-z][A-Za-z],\s*)?([0-9]{1,2})\s+([A-Za-z]{3})\s+([0-9]{2}|[0-9]{4})\s+([0-9]{1,2}):([0-9]{2})"
         r"(?::([0-9]{2}))?\s*(?:([+-])([0-9]{2})([0-9]{2})|GMT|UT|UTC|Z|[ECMP][SD]T)?\s*(?:\([^)]*\))?\s*$")
    i = r"^\s*([0-9]{4})-([0-9]{2})-([0-9]{2})(?:[ T]([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?)?\s*$"
    months = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
    zones = "MAP {'EST': 300, 'EDT': 240, 'CST': 360, 'CDT': 300, 'MST': 420, 'MDT': 360, 'PST': 480, 'PDT': 420}"

    def g(p, k):
        return f"regexp_extract({col}, {q(p)}, {k})"

    mon_txt = g(m, 2)
    mon = f"list_position({lst(months)}, upper(substr({mon_txt}, 1, 1)) || lower(substr({mon_txt}, 2)))"
    sign = f"(CASE WHEN {g(m, 7)} = '-' THEN -1 ELSE 1 END)"
    off = f"{sign} * (coalesce({_int(g(m, 8))}, 0) * 60 + coalesce({_int(g(m, 9))}, 0))"
    off = f"({off} - coalesce({zones}[regexp_extract({col}, '([ECMP][SD]T)', 1)], 0))"
    y = _int(g(m, 3))
    year = f"(CASE WHEN length({g(m, 3)}) = 2 THEN (CASE WHEN {y} < 50 THEN {y} + 2000 ELSE {y} + 1900 END) ELSE {y} END)"
    mail = (f"make_timestamp({year}, {mon}, {_int(g(m, 1))}, {_int(g(m, 4))}, {_int(g(m, 5))}, "
            f"CAST(coalesce({_int(g(m, 6))}, 0) AS DOUBLE)) - to_minutes(CAST({off} AS BIGINT))")
    iso = (f"make_timestamp({_int(g(i, 1))}, {_int(g(i, 2))}, {_int(g(i, 3))}, coalesce({_int(g(i, 4))}, 0), "
           f"coalesce({_int(g(i, 5))}, 0), CAST(coalesce({_int(g(i, 6))}, 0) AS DOUBLE))")
    return f"(CASE WHEN regexp_matches({col}, {q(m)}) THEN {mail} WHEN regexp_matches({col}, {q(i)}) THEN {iso} END)"


def fingerprint_sql() -> str:
    return ("substr(sha256(coalesce(sender, '') || '|' || coalesce(date, '') || '|' || coalesce(subject, '') "
            f"|| '|' || substr(coalesce(body, ''), 1, {K.FINGERPRINT_BODY_CHARS})), 1, {K.FINGERPRINT_HEX_CHARS})")


def trunc_sql(col="body", lim=K.MAX_CONTENT_LENGTH) -> str:
    return f"coalesce(length({col}) > {lim}, false)"


FP = f"""
fp AS (
  SELECT m.*, {fingerprint_sql()} AS content_hash, {trunc_sql()} AS is_truncated,
         {sent_at_sql('date')} AS sent_at
  FROM messages m)"""

CURSORS = f"""
cursors AS (
  SELECT account_id, CAST((min(uid) + max(uid)) // 2 AS BIGINT) AS last_uid,
         TIMESTAMP '{TB.FIXTURE_CURSOR_AT}' AS updated_at
  FROM messages GROUP BY account_id HAVING max(uid) % 4 <> 0)"""

CACHE = f"""
cache_src AS (
  SELECT f.content_hash, f.account_id, f.uid, f.is_truncated AS trunc,
         row_number() OVER (PARTITION BY f.content_hash ORDER BY f.uid DESC) AS rn
  FROM fp f JOIN cursors c ON c.account_id = f.account_id WHERE f.uid <= c.last_uid),
cache AS (
  SELECT content_hash, account_id, uid, uid AS c_original_uid,
         ['High', 'Medium', 'Low', 'Spam'][CAST(uid % 4 + 1 AS INTEGER)] AS c_priority,
         'cached ' || CAST(uid AS VARCHAR) AS c_summary, ['cache', account_id] AS c_key_entities,
         uid % 2 = 0 AS c_action_required, trunc AS c_is_truncated,
         CASE WHEN uid % 5 = 0 THEN '{OLD}' ELSE '{MODEL}' END AS model_version,
         TIMESTAMP '{TB.FIXTURE_CACHE_AT}' AS created_at
  FROM cache_src WHERE rn = 1)"""


def _answer_sql() -> str:
    lg = "coalesce(lang, '')"
    pri = "CASE WHEN toxic = 1 THEN 'Spam' WHEN quality = 1 THEN 'High' ELSE 'Low' END"
    act = "CASE WHEN quality = 1 AND toxic = 0 THEN 'true' ELSE 'false' END"
    summ = f"""'"summary": "Message ' || CAST(uid AS VARCHAR) || ' in ' || {lg} || '"'"""
    ents = f"""'"key_entities": ["lang:' || {lg} || '", "uid:' || CAST(uid AS VARCHAR) || '"]'"""
    p_ok = f"""'"priority": "' || {pri} || '"'"""
    a_ok = f"""'"action_required": ' || {act}"""

    def obj(p, s, e, a):
        return f"'{{' || {p} || ', ' || {s} || ', ' || {e} || ', ' || {a} || '}}'"

    return f"""CASE doc_id % 20
      WHEN 3 THEN {obj(q('"priority": "HIGH"'), summ, ents, a_ok)}
      WHEN 5 THEN 'I am unable to classify this message.'
      WHEN 7 THEN '{{"priority": "High"}}'
      WHEN 9 THEN {obj(p_ok, q('"summary": null'), ents, a_ok)}
      WHEN 11 THEN {obj(p_ok, summ, q('"key_entities": [1, 2]'), a_ok)}
      WHEN 13 THEN {obj(p_ok, summ, ents, q('"action_required": "maybe"'))}
      WHEN 15 THEN {obj(p_ok, summ, ents, q('"action_required": "Yes"'))}
      WHEN 17 THEN '[1, 2]'
      WHEN 19 THEN {obj(p_ok, summ, q('"key_entities": []'), q('"action_required": 1'))}
      WHEN 1 THEN {obj(p_ok, summ, q('"key_entities": ["x", null]'), q('"action_required": 0.0'))}
      ELSE {obj(p_ok, summ, ents, a_ok)} END"""


def _text_answer_sql() -> str:
    lg = "coalesce(lang, '')"
    pri = "CASE WHEN n > 5000 THEN 'Medium' ELSE 'Low' END"
    return (f"""'{{"priority": "' || {pri} || '", "summary": "Message ' || CAST(uid AS VARCHAR) || ' in ' || {lg} """
            f"""|| '", "key_entities": ["lang:' || {lg} || '"], "action_required": false}}'""")


RESPONSES = f"""
rep AS (
  SELECT content_hash, uid, length(body) AS n, uid - 1 AS doc_id,
         row_number() OVER (PARTITION BY content_hash ORDER BY uid) AS rn
  FROM fp),
lab AS (
  SELECT r.content_hash, r.uid, r.n, r.doc_id, d.lang, l.quality, l.toxic,
         (l.quality IS NOT NULL OR l.toxic IS NOT NULL) AS labelled
  FROM rep r LEFT JOIN documents d ON d.doc_id = r.doc_id LEFT JOIN labels l ON l.doc_id = r.doc_id
  WHERE r.rn = 1),
responses AS (
  SELECT content_hash, '{MODEL}' AS model_version,
         CASE WHEN labelled THEN {_answer_sql()} ELSE {_text_answer_sql()} END AS raw_json
  FROM lab WHERE labelled OR doc_id % 16 <> 5)"""


def validate_cte(name: str, src: str, raw: str = "raw_json") -> str:
    """Two CTEs adding err, ok, a_priority, a_summary, a_key_entities, a_action_required."""
    j = "j"
    at = f"json_type({j}, '$.action_required')"
    a_s = f"json_extract_string({j}, '$.action_required')"
    num_types = "('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE')"
    a_ok = (f"(a_t IS NULL OR a_t = 'BOOLEAN' OR (a_t IN {num_types} AND TRY_CAST({a_s} AS DOUBLE) IN (0, 1)) "
            f"OR (a_t = 'VARCHAR' AND lower({a_s}) IN ({', '.join(q(x) for x in K.BOOL_TRUE_STRINGS + K.BOOL_FALSE_STRINGS)})))")
    e_ok = (f"(et IS NULL OR (et = 'ARRAY' AND len(list_filter(json_type({j}, '$.key_entities[*]'), "
            f"lambda x: x <> 'VARCHAR')) = 0))")
    return f"""
{name}_j AS (
  SELECT *, CASE WHEN json_valid({raw}) THEN CAST({raw} AS JSON) END AS {j} FROM {src}),
{name}_t AS (
  SELECT *, {j} IS NOT NULL AND json_type({j}) = 'OBJECT' AS is_obj,
         json_type({j}, '$.priority') AS pt, json_type({j}, '$.summary') AS st,
         json_type({j}, '$.key_entities') AS et, {at} AS a_t
  FROM {name}_j),
{name}_e AS (
  SELECT *, CASE
      WHEN {raw} IS NULL THEN NULL
      WHEN NOT coalesce(is_obj, false) THEN {q(RS.ERR_NOT_OBJECT)}
      WHEN NOT (pt IS NULL OR (pt = 'VARCHAR' AND json_extract_string({j}, '$.priority') IN ({', '.join(q(p) for p in K.PRIORITIES)}))) THEN {q(RS.ERR_PRIORITY)}
      WHEN NOT (st IS NULL OR st = 'VARCHAR') THEN {q(RS.ERR_SUMMARY)}
      WHEN NOT {e_ok} THEN {q(RS.ERR_ENTITIES)}
      WHEN NOT {a_ok} THEN {q(RS.ERR_ACTION)}
    END AS err0
  FROM {name}_t),
{name} AS (
  SELECT *,
    {raw} IS NOT NULL AND err0 IS NULL AS ok,
    CASE WHEN err0 IS NOT NULL THEN {q(K.QUARANTINE_ERROR_PREFIX)} || err0 END AS err,
    CASE WHEN {raw} IS NOT NULL AND err0 IS NULL THEN coalesce(json_extract_string({j}, '$.priority'), {q(K.DEFAULT_PRIORITY)}) END AS a_priority,
    CASE WHEN {raw} IS NOT NULL AND err0 IS NULL THEN coalesce(json_extract_string({j}, '$.summary'), {q(K.DEFAULT_SUMMARY)}) END AS a_summary,
    CASE WHEN {raw} IS NOT NULL AND err0 IS NULL THEN (CASE WHEN et IS NULL THEN CAST([] AS VARCHAR[]) ELSE json_extract_string({j}, '$.key_entities[*]') END) END AS a_key_entities,
    CASE WHEN {raw} IS NOT NULL AND err0 IS NULL THEN (CASE WHEN a_t IS NULL THEN false WHEN a_t = 'BOOLEAN' THEN {a_s} = 'true'
         WHEN a_t = 'VARCHAR' THEN lower({a_s}) IN ({', '.join(q(x) for x in K.BOOL_TRUE_STRINGS)})
         ELSE TRY_CAST({a_s} AS DOUBLE) = 1 END) END AS a_action_required
  FROM {name}_e)"""


def world(init: str | None = "2024-01-01", force_from_uid: int | None = None, force: bool = False,
          mode: str = "normal", reset: bool = False) -> str:
    """CTE chain up to ``outcome`` (and ``store``, ``stats``, ``writes``)."""
    stored = "CAST(0 AS BIGINT)" if reset else "CAST(coalesce(c.last_uid, 0) AS BIGINT)"
    start = f"CAST({force_from_uid} AS BIGINT)" if force_from_uid is not None else f"({stored} + 1)"
    guard = f"NOT ({start} = 1 AND {str(not force_from_uid).upper()} AND {str(not init).upper()})"
    date_f = f" AND f.sent_at >= TIMESTAMP '{init} 00:00:00'" if init else ""
    ctes = [MESSAGES, FP, CURSORS, CACHE, RESPONSES, f"""
plan AS (
  SELECT a.account_id, {stored} AS stored_uid, {start} AS start_uid, {start} - 1 AS before_uid, {guard} AS guard_ok
  FROM (SELECT DISTINCT account_id FROM messages) a LEFT JOIN cursors c ON c.account_id = a.account_id),
batch AS (
  SELECT f.* FROM fp f JOIN plan p ON p.account_id = f.account_id
  WHERE p.guard_ok AND f.uid >= p.start_uid{date_f})"""]
    quarantine_summary = f"{q(K.QUARANTINE_SUMMARY_PREFIX)} || substr(err, 1, {K.QUARANTINE_DETAIL_CHARS})"
    if mode == "normal":
        cache_join = ("LEFT JOIN cache c ON c.content_hash = k.content_hash AND c.model_version = " + q(MODEL)
                      if not force else "LEFT JOIN (SELECT * FROM cache WHERE false) c ON c.content_hash = k.content_hash")
        ctes.append(f"""
firsts AS (
  SELECT content_hash, account_id AS l_acc, uid AS l_uid, is_truncated AS l_trunc FROM (
    SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY account_id, uid) AS rn FROM batch) WHERE rn = 1),
lasts AS (
  SELECT content_hash, account_id AS w_acc, uid AS w_uid, is_truncated AS w_trunc FROM (
    SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY account_id DESC, uid DESC) AS rn FROM batch) WHERE rn = 1),
copies AS (SELECT content_hash, count(*) AS copies FROM batch GROUP BY content_hash),
dec0 AS (
  SELECT k.content_hash AS d_hash, k.l_acc, k.l_uid, k.l_trunc, lt.w_acc, lt.w_uid, lt.w_trunc, cp.copies,
         c.content_hash IS NOT NULL AS is_cached, c.c_original_uid, c.c_priority, c.c_summary, c.c_key_entities,
         c.c_action_required, c.c_is_truncated,
         CASE WHEN c.content_hash IS NULL THEN r.raw_json END AS raw_json
  FROM firsts k JOIN lasts lt ON lt.content_hash = k.content_hash JOIN copies cp ON cp.content_hash = k.content_hash
  {cache_join}
  LEFT JOIN responses r ON r.content_hash = k.content_hash AND r.model_version = {q(MODEL)}),
{validate_cte('dec', 'dec0')[1:]},
o1 AS (
  SELECT b.*, d.*,
    CASE WHEN d.is_cached THEN 'hit' WHEN d.raw_json IS NULL THEN 'pending' WHEN d.err IS NOT NULL THEN 'quarantined'
         WHEN {str(force).upper()} OR (b.account_id = d.l_acc AND b.uid = d.l_uid) THEN 'fresh' ELSE 'hit' END AS outcome
  FROM batch b JOIN dec d ON d.d_hash = b.content_hash),
o2 AS (
  SELECT account_id, uid, content_hash, subject, sender, date, body, sent_at, outcome,
    CASE WHEN outcome <> 'pending' THEN uid END AS r_original_uid,
    CASE WHEN outcome = 'pending' THEN NULL WHEN outcome = 'quarantined' THEN 'Error'
         WHEN is_cached THEN c_priority ELSE a_priority END AS r_priority,
    CASE WHEN outcome = 'pending' THEN NULL WHEN outcome = 'quarantined' THEN {quarantine_summary}
         WHEN is_cached THEN c_summary ELSE a_summary END AS r_summary,
    CASE WHEN outcome = 'pending' THEN NULL WHEN outcome = 'quarantined' THEN {lst(K.QUARANTINE_ENTITIES)}
         WHEN is_cached THEN c_key_entities ELSE a_key_entities END AS r_key_entities,
    CASE WHEN outcome = 'pending' THEN NULL WHEN outcome = 'quarantined' THEN true
         WHEN is_cached THEN c_action_required ELSE a_action_required END AS r_action_required,
    CASE WHEN outcome = 'pending' THEN NULL WHEN outcome = 'quarantined' THEN true
         WHEN is_cached THEN c_is_truncated WHEN outcome = 'fresh' THEN is_truncated ELSE l_trunc END AS r_is_truncated
  FROM o1),
pfloor AS (SELECT account_id, min(uid) AS pf FROM o2 WHERE outcome = 'pending' GROUP BY account_id),
outcome AS (
  SELECT o2.*, coalesce(o2.uid >= pf.pf, false) AS held FROM o2 LEFT JOIN pfloor pf ON pf.account_id = o2.account_id),
writes AS (
  SELECT d_hash AS content_hash, {'w_acc' if force else 'l_acc'} AS account_id, {'w_uid' if force else 'l_uid'} AS uid,
         {'w_uid' if force else 'l_uid'} AS c_original_uid, a_priority AS c_priority, a_summary AS c_summary,
         a_key_entities AS c_key_entities, a_action_required AS c_action_required,
         {'w_trunc' if force else 'l_trunc'} AS c_is_truncated, {q(MODEL)} AS model_version, {CREATED} AS created_at
  FROM dec WHERE ok)""")
    else:
        if mode == "skip":
            pri, summ, ents, act, tr = (q(K.PRIORITY_UNPROCESSED), f"{q(K.SKIP_SUMMARY_PREFIX)} || coalesce(subject, 'None')",
                                        "CAST([] AS VARCHAR[])", "false", "false")
        else:
            pri, summ, ents, act, tr = (q(K.DRY_RUN_PRIORITY),
                                        f"{q(K.DRY_RUN_SUMMARY_PREFIX)} || coalesce(subject, {q(K.DRY_RUN_MISSING_SUBJECT)})",
                                        lst(K.DRY_RUN_ENTITIES), "false", "is_truncated")
        outname = "skipped" if mode == "skip" else "dry"
        ctes.append(f"""
outcome AS (
  SELECT account_id, uid, content_hash, subject, sender, date, body, sent_at, '{outname}' AS outcome,
         uid AS r_original_uid, {pri} AS r_priority, {summ} AS r_summary, {ents} AS r_key_entities,
         {act} AS r_action_required, {tr} AS r_is_truncated, false AS held
  FROM batch)""")
    model_col = "CAST(NULL AS VARCHAR)" if mode == "skip" else q(MODEL)
    ctes.append(f"""
emitted AS (SELECT * FROM outcome WHERE NOT held AND outcome <> 'pending'),
store AS (
  SELECT row_number() OVER (ORDER BY account_id, uid) AS id, {q(RUN)} AS run_id, CAST(0 AS BIGINT) AS batch_id,
         account_id, uid, content_hash, subject, sender, date, sent_at,
         substr(coalesce(body, ''), 1, {K.BODY_PREVIEW_CHARS}) AS body_preview,
         r_priority AS priority, r_summary AS summary, r_key_entities AS key_entities,
         r_action_required AS action_required, r_is_truncated AS is_truncated,
         {model_col} AS model_version, {CREATED} AS created_at
  FROM emitted),
fetched AS (SELECT account_id, count(*) AS fetched, min(uid) AS min_uid, max(uid) AS max_uid FROM batch GROUP BY account_id),
em AS (SELECT account_id, count(*) AS emitted, max(uid) AS max_emitted FROM emitted GROUP BY account_id),
stats AS (
  SELECT p.account_id, p.before_uid, p.start_uid, coalesce(f.fetched, 0) AS fetched, f.min_uid, f.max_uid,
         coalesce(e.emitted, 0) AS emitted,
         greatest(coalesce(e.max_emitted, p.before_uid), p.before_uid) AS after_uid
  FROM plan p LEFT JOIN fetched f ON f.account_id = p.account_id LEFT JOIN em e ON e.account_id = p.account_id
  WHERE p.guard_ok)""")
    return "WITH " + ",".join(c.strip("\n") for c in ctes)


def events_world(init: str = "2024-01-10") -> str:
    return f"""WITH emsg AS (
  SELECT 'user_' || CAST(user_id AS VARCHAR) AS account_id, event_id + 1 AS uid, event_type AS subject,
         'user' || CAST(user_id AS VARCHAR) || '@events.example' AS sender,
         strftime(ts, '%Y-%m-%dT%H:%M:%S') AS date, props AS body
  FROM events),
efp AS (SELECT m.*, {fingerprint_sql()} AS content_hash, {sent_at_sql('date')} AS sent_at FROM emsg m),
ecur AS (
  SELECT account_id, CAST((min(uid) + max(uid)) // 2 AS BIGINT) AS last_uid
  FROM emsg GROUP BY account_id HAVING max(uid) % 4 <> 0),
eplan AS (
  SELECT a.account_id, CAST(coalesce(c.last_uid, 0) AS BIGINT) + 1 AS start_uid
  FROM (SELECT DISTINCT account_id FROM emsg) a LEFT JOIN ecur c ON c.account_id = a.account_id),
ebatch AS (
  SELECT f.* FROM efp f JOIN eplan p ON p.account_id = f.account_id
  WHERE f.uid >= p.start_uid AND f.sent_at >= TIMESTAMP '{init} 00:00:00')"""


def ts(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S')"


OUTCOME_COLS = ("account_id, uid, content_hash, outcome, held, r_original_uid AS original_uid, r_priority AS priority, "
                "r_summary AS summary, r_key_entities AS key_entities, r_action_required AS action_required, "
                "r_is_truncated AS is_truncated")


# --- HTML -> text in DuckDB (same rules, RE2 dialect) -----------------------

def _entity_case(t: str) -> str:
    table = dict(html.entities.name2codepoint)
    table["apos"] = 39
    arms = " ".join(f"WHEN {q('&' + n + ';')} THEN {q(chr(cp))}" for n, cp in sorted(table.items()))
    return f"CASE {t} {arms} ELSE {t} END"


def _codepoint(n: str) -> str:
    return (f"(CASE WHEN {n} > 0 AND {n} <= 1114111 AND NOT ({n} BETWEEN 55296 AND 57343) "
            f"THEN chr(CAST({n} AS INTEGER)) ELSE chr(65533) END)")


# The oracle's own spelling of the rules, in the RE2 dialect.
_ATTRS = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
_COMMENT, _SCRIPT, _STYLE = r"<!--.*?(?:-->|\z)", *(rf"<{n}(?:[\s/]{_ATTRS})?>.*?(?:</{n}\s*>|\z)" for n in ("script", "style"))
_HEAD = rf"<head(?:[\s/]{_ATTRS})?>(?:{_COMMENT}|{_SCRIPT}|{_STYLE}|.)*?(?:</head\s*>|\z)"
_LINK = (r"""(<a)(?:\s+[^\s=>"'/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+))?)*?"""
         r"""\s+href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""" + _ATTRS + ">")
_MARKUP = "(?is)" + "|".join([_COMMENT, _HEAD, _SCRIPT, _STYLE, _LINK, r"(</a)\s*>", r"</?[A-Za-z!?]" + _ATTRS + ">"])
_REFERENCE = r"&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};|&[A-Za-z][A-Za-z0-9]{0,31};|[^&]+|&"
_SPACE = r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def decode_sql(x: str) -> str:
    hexn = "TRY_CAST('0x' || substr(t, 4, length(t) - 4) AS BIGINT)"
    decn = "TRY_CAST(substr(t, 3, length(t) - 3) AS BIGINT)"
    tok = (f"CASE WHEN regexp_matches(t, '^&#[xX]') THEN {_codepoint(hexn)} "
           f"WHEN starts_with(t, '&#') THEN {_codepoint(decn)} "
           f"WHEN starts_with(t, '&') AND ends_with(t, ';') THEN {_entity_case('t')} ELSE t END")
    return (f"(CASE WHEN contains({x}, '&') THEN array_to_string(list_transform("
            f"regexp_extract_all({x}, {q(_REFERENCE)}), lambda t: {tok}), '') ELSE {x} END)")


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + _SPACE + '+|' + _SPACE + '+$')}, '', 'g')"


def html_to_text_sql(col: str) -> str:
    marked = f"regexp_replace({col}, {q(_MARKUP)}, chr(1) || '\\1' || chr(3) || '\\2\\3\\4' || chr(3) || '\\5' || chr(3), 'g')"
    part = lambda i: f"split_part(tok, chr(3), {i})"
    text_at = f"length({part(1)}) + length({part(2)}) + length({part(3)}) + 4"
    sign = (f"CASE WHEN {part(1)} <> '' THEN chr(2) || {part(2)} || chr(3) WHEN {part(3)} <> '' THEN chr(4) ELSE chr(1) END "
            f"|| substr(tok, {text_at})")
    s = (f"(SELECT toks[1] || array_to_string(list_transform(toks[2:], lambda tok: {sign}), '') "
         f"FROM (SELECT string_split({marked}, chr(1)) AS toks))")
    href = "split_part(seg, chr(3), 1)"
    after = f"substr(seg, length({href}) + 2)"
    content = f"split_part({after}, chr(4), 1)"
    rest = f"substr({after}, length({content}) + 2)"
    text = decode_sql(f"replace({content}, chr(1), '')")
    href_t = decode_sql(href)
    rep = f"(CASE WHEN {strip_sql(text)} <> '' THEN {text} || ' (' || {href_t} || ')' ELSE {href_t} END)"
    anchor = f"chr(1) || replace({rep}, '&', chr(6)) || chr(1) || {rest}"
    s = (f"(SELECT segs[1] || array_to_string(list_transform(segs[2:], lambda seg: {anchor}), '') "
         f"FROM (SELECT string_split({s}, chr(2)) AS segs))")
    s = f"replace({s}, chr(4), chr(1))"
    nodes = f"list_filter(list_transform(string_split({s}, chr(1)), lambda n: {strip_sql(decode_sql('n'))}), lambda n: n <> '')"
    return f"(CASE WHEN {col} IS NULL THEN NULL ELSE replace(array_to_string({nodes}, chr(10)), chr(6), '&') END)"


def report_sql() -> str:
    banner = (f"CASE WHEN r_priority = 'High' THEN {q(K.REPORT_BANNER_HIGH)} WHEN r_priority = 'Medium' THEN "
              f"{q(K.REPORT_BANNER_MEDIUM)} WHEN r_priority = 'Spam' THEN {q(K.REPORT_BANNER_SPAM)} "
              f"ELSE {q(K.REPORT_BANNER_OTHER)} END")
    nl = "chr(10)"
    action = (f"CASE WHEN coalesce(r_action_required, false) THEN {nl} || {q(K.REPORT_ACTION)} || {nl} "
              f"ELSE {nl} || {q(K.REPORT_NO_ACTION)} || {nl} END")
    ents = "coalesce(r_key_entities, CAST([] AS VARCHAR[]))"
    bullets = (f"CASE WHEN len({ents}) > 0 THEN array_to_string(list_transform({ents}, lambda t: {nl} || "
               f"{q(K.REPORT_ENTITY_BULLET)} || coalesce(t, 'None') || {nl}), '') "
               f"ELSE {nl} || {q(K.REPORT_NO_ENTITIES)} || {nl} END")
    return (f"{q(K.REPORT_RULE)} || {nl} || {q(K.REPORT_TITLE)} || {banner} || ']' || {nl} || {q(K.REPORT_RULE)} || {nl} "
            f"|| {q(K.REPORT_UID)} || coalesce(CAST(r_original_uid AS VARCHAR), 'None') || {nl} || {q(K.REPORT_TRUNCATED)} "
            f"|| CASE WHEN coalesce(r_is_truncated, false) THEN 'Yes' ELSE 'No' END || {nl} || {nl} || {q(K.REPORT_SUMMARY)} "
            f"|| {nl} || coalesce(r_summary, 'None') || {nl} || {nl} || {action} || {nl} || {nl} || {q(K.REPORT_ENTITIES)} "
            f"|| {nl} || {bullets} || {nl} || {q(K.REPORT_RULE)}")


def _rjust(x: str, w: int) -> str:
    return f"(CASE WHEN length({x}) >= {w} THEN {x} ELSE lpad({x}, {w}, ' ') END)"


def _ljust(x: str, w: int) -> str:
    return f"(CASE WHEN length({x}) >= {w} THEN {x} ELSE rpad({x}, {w}, ' ') END)"


def table_line_sql() -> str:
    return ("'[' || " + _rjust("CAST(id AS VARCHAR)", 5) + " || '] ' || " + _rjust("coalesce(priority, '?')", 6)
            + " || ' | ' || " + _ljust("substr(coalesce(date, ''), 1, 16)", 16) + " || ' | ' || "
            + _ljust("substr(coalesce(sender, ''), 1, 30)", 30) + " || ' | ' || substr(coalesce(subject, ''), 1, 50)")


def oracle_sql() -> dict[str, str]:
    w = world()
    page_cols = f"id, account_id, uid, priority, date, {ts('sent_at')} AS sent_at"
    plain = "CASE WHEN p.page_id % 4 = 0 THEN d.text WHEN p.page_id % 4 = 1 THEN ' ' || chr(10) || chr(9) || ' ' END"
    out = {
        "fingerprint": f"WITH {MESSAGES.strip()} SELECT account_id, uid, {fingerprint_sql()} AS content_hash FROM messages",
        "preview_truncate": (
            f"WITH {MESSAGES.strip()} SELECT uid, "
            f"CAST(length(substr(coalesce(body, ''), 1, {K.BODY_PREVIEW_CHARS})) AS BIGINT) AS preview_len, "
            f"CAST(length(CASE WHEN length(body) > {K.MAX_CONTENT_LENGTH} THEN substr(body, 1, {K.MAX_CONTENT_LENGTH}) "
            f"ELSE coalesce(body, '') END) AS BIGINT) AS clipped_len, {trunc_sql()} AS is_truncated, "
            f"substr(substr(coalesce(body, ''), 1, {K.BODY_PREVIEW_CHARS}), -40, 40) AS preview_tail FROM messages"),
        "sent_at_parse": f"WITH {MESSAGES.strip()} SELECT uid, date, {ts(sent_at_sql('date'))} AS sent_at FROM messages",
        "request_build": (
            f"WITH {MESSAGES.strip()} SELECT uid, chr(10) || '        Subject: ' || coalesce(subject, 'None') "
            f"|| chr(10) || '        Sender: ' || coalesce(sender, 'None') || chr(10) || '        Date: ' || "
            f"coalesce(date, 'None') || chr(10) || '        ' || chr(10) || '        Body:' || chr(10) || '        ' || "
            f"(CASE WHEN length(body) > {K.MAX_CONTENT_LENGTH} THEN substr(body, 1, {K.MAX_CONTENT_LENGTH}) "
            f"ELSE coalesce(body, '') END) || chr(10) || '        ' AS prompt FROM messages"),
        "response_validate": (
            f"WITH {MESSAGES.strip()},{FP.strip()},{RESPONSES.strip()},{validate_cte('v', 'responses')[1:]} "
            "SELECT content_hash, ok, a_priority AS priority, a_summary AS summary, a_key_entities AS key_entities, "
            "a_action_required AS action_required, err AS error FROM v"),
        "html_to_text": f"SELECT page_id, {html_to_text_sql('html')} AS text FROM pages",
        "body_select": (
            f"SELECT page_id, CASE WHEN {strip_sql(f"coalesce({plain}, '')")} <> '' "
            f"THEN {plain} WHEN {strip_sql("coalesce(html, '')")} <> '' "
            f"THEN {html_to_text_sql('html')} ELSE '' END AS body "
            "FROM pages p LEFT JOIN documents d ON p.page_id = d.doc_id"),
        "eml_roundtrip": (
            f"WITH {MESSAGES.strip()} SELECT uid, coalesce(subject, '') AS subject, coalesce(sender, '') AS sender, "
            f"coalesce(date, '') AS date, CASE WHEN {strip_sql('coalesce(body, ' + chr(39) * 2 + ')')} <> '' "
            "THEN body ELSE '' END AS body FROM messages"),
        "eml_html": (
            f"SELECT page_id, coalesce(url, '') AS subject, CASE WHEN {strip_sql('coalesce(html, ' + chr(39) * 2 + ')')} "
            f"<> '' THEN {html_to_text_sql('html')} ELSE '' END AS body FROM pages"),
        "events_incremental": (
            f"{events_world()} SELECT account_id, uid, content_hash, {ts('sent_at')} AS sent_at FROM ebatch"),
        "fetch_stats": (
            f"{events_world()} SELECT account_id, count(*) AS fetched, min(uid) AS min_uid, max(uid) AS max_uid "
            "FROM ebatch GROUP BY account_id"),
        "conversation_latest": (
            "SELECT conv_id, turn, role, CAST(length(text) AS BIGINT) AS text_len FROM (SELECT *, row_number() "
            "OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rk FROM conversations) WHERE rk = 1"),
        "conversation_requests": (
            "SELECT conv_id, turn, chr(10) || '        Subject: ' || coalesce('conversation ' || CAST(conv_id AS VARCHAR), "
            "'None') || chr(10) || '        Sender: ' || coalesce(role, 'None') || chr(10) || '        Date: None' || "
            "chr(10) || '        ' || chr(10) || '        Body:' || chr(10) || '        ' || "
            f"(CASE WHEN length(text) > {K.MAX_CONTENT_LENGTH} THEN substr(text, 1, {K.MAX_CONTENT_LENGTH}) "
            "ELSE coalesce(text, '') END) || chr(10) || '        ' AS prompt FROM (SELECT *, row_number() OVER "
            "(PARTITION BY conv_id ORDER BY turn DESC) AS rk FROM conversations WHERE role = 'user') WHERE rk = 1"),
        "run_plan": f"{world(init=None)} SELECT * FROM plan",
        "incremental_source": f"{w} SELECT account_id, uid, content_hash, {ts('sent_at')} AS sent_at, is_truncated FROM batch",
        "high_water": (
            f"{w} SELECT account_id, before_uid, start_uid, fetched, min_uid, max_uid, emitted, after_uid, "
            "after_uid >= start_uid AS advances, CAST(before_uid AS VARCHAR) || ' -> ' || CAST(after_uid AS VARCHAR) || "
            "' (+' || CAST(after_uid - start_uid + 1 AS VARCHAR) || ' emails)' AS movement FROM stats"),
        "cache_probe": (
            f"{w} SELECT b.account_id, b.uid, b.content_hash, c.content_hash IS NOT NULL AS hit, "
            "c.c_priority AS cached_priority, c.c_original_uid AS cached_uid FROM batch b "
            f"LEFT JOIN cache c ON c.content_hash = b.content_hash AND c.model_version = {q(MODEL)}"),
        "cache_miss_leaders": (
            f"{w} SELECT d_hash AS content_hash, l_acc AS leader_account, l_uid AS leader_uid, copies FROM dec0 "
            "WHERE NOT is_cached"),
        "outcome_fanout": f"{w} SELECT {OUTCOME_COLS} FROM outcome",
        "replay_outcome": f"{world(force_from_uid=1)} SELECT {OUTCOME_COLS} FROM outcome",
        "force_reprocess": f"{world(force=True)} SELECT {OUTCOME_COLS} FROM outcome",
        "quarantine_rows": (
            f"{w} SELECT account_id, uid, content_hash, r_original_uid AS original_uid, r_priority AS priority, "
            "r_summary AS summary, r_key_entities AS key_entities, r_action_required AS action_required, "
            "r_is_truncated AS is_truncated FROM outcome WHERE outcome = 'quarantined'"),
        "skip_rows": f"{world(mode='skip')} SELECT {OUTCOME_COLS} FROM outcome",
        "dry_run_rows": f"{world(mode='dry')} SELECT {OUTCOME_COLS} FROM outcome",
        "cache_upsert": (
            f"{w}, merged AS (SELECT * FROM writes UNION ALL SELECT * FROM cache "
            "WHERE content_hash NOT IN (SELECT content_hash FROM writes)) "
            "SELECT content_hash, account_id, uid, model_version, c_original_uid AS original_uid, c_priority AS priority, "
            "c_summary AS summary, c_key_entities AS key_entities, c_action_required AS action_required, "
            f"c_is_truncated AS is_truncated, {ts('created_at')} AS created_at FROM merged"),
        "cache_invalidate": (
            f"WITH {MESSAGES.strip()},{FP.strip()},{CURSORS.strip()},{CACHE.strip()} "
            "SELECT content_hash, account_id, uid, model_version FROM cache WHERE account_id <> 'acct_src3'"),
        "cache_invalidate_count": (
            f"WITH {MESSAGES.strip()},{FP.strip()},{CURSORS.strip()},{CACHE.strip()} "
            "SELECT count(*) FILTER (WHERE account_id = 'acct_src3') AS removed_account, count(*) AS removed_all FROM cache"),
        "cursor_listing": (
            f"WITH {MESSAGES.strip()},{CURSORS.strip()} SELECT account_id, last_uid, {ts('updated_at')} AS updated_at "
            "FROM cursors ORDER BY account_id"),
        "pacing_summary": (
            f"{w}, req AS (SELECT b.uid FROM batch b JOIN dec0 d ON d.d_hash = b.content_hash "
            "WHERE NOT d.is_cached AND b.account_id = d.l_acc AND b.uid = d.l_uid) "
            f"SELECT count(*) AS calls, CAST(CASE WHEN count(*) > 0 THEN (count(*) - 1) * {60.0 / K.DEFAULT_RATE_LIMIT_RPM} "
            "ELSE 0.0 END AS DOUBLE) AS min_seconds FROM req"),
        "pacing_plan": (
            f"{w}, req AS (SELECT b.content_hash, b.account_id, b.uid FROM batch b JOIN dec0 d ON d.d_hash = b.content_hash "
            "WHERE NOT d.is_cached AND b.account_id = d.l_acc AND b.uid = d.l_uid) "
            "SELECT content_hash, account_id, uid, row_number() OVER (ORDER BY account_id, uid) AS call_seq, "
            f"(row_number() OVER (ORDER BY account_id, uid) - 1) * 60000 // {K.DEFAULT_RATE_LIMIT_RPM} AS slot_offset_ms FROM req"),
        "emails_append": (
            f"{w} SELECT id, run_id, batch_id, account_id, uid, content_hash, subject, sender, date, "
            f"{ts('sent_at')} AS sent_at, CAST(length(body_preview) AS BIGINT) AS preview_len, priority, summary, "
            f"key_entities, action_required, is_truncated, model_version, {ts('created_at')} AS created_at FROM store"),
        "stream_once": None,
        "cursor_upsert": (
            f"{w}, moves AS (SELECT account_id, after_uid AS last_uid, {CREATED} AS updated_at FROM stats "
            "WHERE after_uid >= start_uid AND emitted > 0), "
            "merged AS (SELECT * FROM moves UNION ALL SELECT * FROM cursors WHERE account_id NOT IN (SELECT account_id FROM moves)) "
            f"SELECT account_id, last_uid, {ts('updated_at')} AS updated_at FROM merged"),
        "audit_rows": (
            f"{w} SELECT {q(RUN + ':0:')} || account_id AS audit_id, {q(RUN)} AS run_id, account_id, "
            f"{ts(CREATED)} AS timestamp, before_uid, CASE WHEN fetched = 0 THEN before_uid ELSE after_uid END AS after_uid, "
            "CAST(CASE WHEN fetched = 0 THEN 0 ELSE emitted END AS BIGINT) AS emails_processed, "
            f"{q(K.AUDIT_SUCCESS)} AS status, CASE WHEN fetched = 0 THEN {q(K.AUDIT_NO_NEW)} ELSE '' END AS error_msg "
            "FROM stats WHERE fetched = 0 OR emitted > 0"),
        "run_summary": (
            f"{w}, per AS (SELECT account_id, count(*) AS fetched, "
            "count(*) FILTER (WHERE outcome = 'fresh' AND NOT held) AS llm_calls, "
            "count(*) FILTER (WHERE outcome = 'hit' AND NOT held) AS cache_hits, "
            "count(*) FILTER (WHERE outcome = 'quarantined' AND NOT held) AS errors, "
            "count(*) FILTER (WHERE outcome = 'pending') AS pending, count(*) FILTER (WHERE held) AS held_back, "
            "count(*) FILTER (WHERE NOT held AND outcome <> 'pending') AS emitted FROM outcome GROUP BY account_id) "
            "SELECT count(*) AS accounts, count(*) FILTER (WHERE NOT guard_ok) AS rejected, "
            + ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in
                        ["fetched", "llm_calls", "cache_hits", "errors", "pending", "held_back", "emitted"])
            + " FROM plan LEFT JOIN per ON per.account_id = plan.account_id"),
        "query_page": (
            f"{w} SELECT {page_cols} FROM store WHERE id > 0 AND account_id = {q(catalog.PAGE_FILTERS['account_id'])} "
            f"AND priority = {q(catalog.PAGE_FILTERS['priority'])} "
            f"AND sent_at >= TIMESTAMP '{catalog.PAGE_FILTERS['since']} 00:00:00' ORDER BY id LIMIT 1000"),
        "query_meta": (
            f"{w}, page AS (SELECT * FROM store WHERE id > 5 AND account_id = 'acct_src7' ORDER BY id LIMIT 3) "
            "SELECT count(*) AS count, coalesce(max(id), 5) AS max_id, count(*) = 3 AS has_more FROM page"),
        "query_date_legacy": (
            f"{w} SELECT {page_cols} FROM store WHERE id > 0 AND date >= '2024-01-20' AND date <= '2024-02-10'"),
        "query_date_parsed": (
            f"{w} SELECT {page_cols} FROM store WHERE id > 0 AND sent_at >= TIMESTAMP '2024-01-20 00:00:00' "
            "AND sent_at < TIMESTAMP '2024-02-11 00:00:00'"),
        "page_export": (
            f"{w}, r AS (SELECT id, row_number() OVER (ORDER BY id) AS rn FROM store WHERE id > 0 AND priority = 'Low') "
            "SELECT id, rn, (rn - 1) // 25 AS page_no FROM r"),
        "latest_per_hash": (
            f"{w} SELECT content_hash, id, account_id, uid, priority FROM (SELECT *, row_number() OVER "
            "(PARTITION BY content_hash ORDER BY id DESC) AS rk FROM store) WHERE rk = 1"),
        "priority_by_run": f"{w} SELECT run_id, priority, count(*) AS n FROM store GROUP BY run_id, priority",
        "status": (
            f"WITH {MESSAGES.strip()},{CURSORS.strip()} SELECT CAST(json_object('initialized', count(*) > 0, "
            "'accounts', coalesce(list(json_object('account_id', account_id, 'last_uid', last_uid, 'updated_at', "
            "strftime(updated_at, '%Y-%m-%dT%H:%M:%S')) ORDER BY account_id), []), "
            f"'db_path', {q(catalog.STORE_PATH)}) AS VARCHAR) AS status FROM cursors"),
        "report_text": f"{w} SELECT account_id, uid, {report_sql()} AS report FROM emitted",
        "json_results": (
            f"{w} SELECT account_id, uid, CAST(json_object('original_uid', r_original_uid, 'priority', r_priority, "
            "'summary', r_summary, 'key_entities', r_key_entities, 'action_required', r_action_required, "
            "'is_truncated', r_is_truncated) AS VARCHAR) AS json FROM emitted"),
        "table_lines": (
            f"{w}, page AS (SELECT * FROM store WHERE id > 0 AND priority = 'Low' ORDER BY id LIMIT 40), "
            "meta AS (SELECT count(*) AS cnt, coalesce(max(id), 0) AS max_id, count(*) = 40 AS has_more FROM page) "
            f"SELECT CAST(id AS BIGINT) AS sort_key, {table_line_sql()} AS line FROM page "
            f"UNION ALL SELECT CAST(-2 AS BIGINT), {q(RD.TABLE_HEADER)} FROM meta WHERE cnt > 0 "
            f"UNION ALL SELECT CAST(-1 AS BIGINT), {q(RD.TABLE_RULE)} FROM meta WHERE cnt > 0 "
            f"UNION ALL SELECT CAST(0 AS BIGINT), {q(K.TABLE_EMPTY)} FROM meta WHERE cnt = 0 "
            f"UNION ALL SELECT CAST({1 << 62} AS BIGINT), {q(RD.TABLE_RULE)} FROM meta WHERE cnt > 0 "
            f"UNION ALL SELECT CAST({(1 << 62) + 1} AS BIGINT), CAST(cnt AS VARCHAR) || ' results | max_id=' || "
            "CAST(max_id AS VARCHAR) || ' | has_more=' || CASE WHEN has_more THEN 'True' ELSE 'False' END FROM meta WHERE cnt > 0"),
    }
    out["stream_once"] = out["replay_partial"] = out["emails_append"]
    out["stream_two_batches"] = f"{w} SELECT account_id, uid, content_hash, priority FROM store"
    tangled = ("'<script>var s=' || chr(39) || '<!--' || chr(39) || ';</script><p title=\"<style>\">' || CAST(page_id AS VARCHAR) || "
               "'</p><head-foo>k</head-foo>' || html || '<!-- <script> --><a href=/p/' || CAST(page_id AS VARCHAR) || '>open<p>v</p>'")
    out["html_tangled"] = f"SELECT page_id, {html_to_text_sql('odd')} AS text FROM (SELECT page_id, {tangled} AS odd FROM pages)"
    out["cache_probe_stored"] = out["cache_probe"]
    out["cache_upsert_stored"] = out["cache_upsert"]
    out["cursor_upsert_stored"] = out["cursor_upsert"]
    out["consumer_commits"] = out["stream_two_batches"]
    out["eml_stream"] = out["eml_roundtrip"]
    out["incremental_pruned"] = (
        f"WITH {MESSAGES.strip()},{FP.strip()},{CURSORS.strip()} SELECT f.account_id, f.uid, f.content_hash, f.is_truncated FROM fp f "
        "LEFT JOIN cursors c ON c.account_id = f.account_id WHERE f.uid > coalesce(c.last_uid, 0) "
        # a message without a landing day is judged by its own date
        f"AND (f.uid % 97 <> 0 OR f.sent_at IS NULL OR f.sent_at >= TIMESTAMP '{catalog.INIT_DATE} 00:00:00')")
    out["stored_page"] = (
        f"{w} SELECT id, account_id, uid, priority, date, {ts('sent_at')} AS sent_at FROM store WHERE id > 20 AND priority = 'Low' "
        "AND sent_at >= TIMESTAMP '2024-01-10 00:00:00' ORDER BY id LIMIT 1000")
    out["dense_ids_after_commits"] = (
        f"{world(force_from_uid=1)} SELECT CAST(b AS BIGINT) AS batch_id, CAST(1 AS BIGINT) AS step, CAST(0 AS BIGINT) AS missing, "
        "(SELECT count(*) FROM store) AS ids FROM range(2) t(b)")
    out["delivery_failure"] = (
        f"{w}, n AS (SELECT account_id, count(*) AS n FROM store GROUP BY account_id), "
        "f AS (SELECT account_id, count(*) AS f FROM batch GROUP BY account_id) "
        "SELECT account_id, CASE WHEN account_id = 'acct_src0' AND f IS NOT NULL THEN 'FAIL' ELSE 'SUCCESS' END AS status, "
        "CASE WHEN account_id = 'acct_src0' THEN 0 ELSE coalesce(n, 0) END AS emails_processed, "
        "CASE WHEN account_id = 'acct_src0' THEN 0 ELSE coalesce(n, 0) END AS stored "
        "FROM plan LEFT JOIN n USING (account_id) LEFT JOIN f USING (account_id) WHERE guard_ok AND (f IS NULL OR n > 0)")
    out["delivery_partial"] = out["delivery_failure"]
    out["delivery_two_step"] = f"{w} SELECT account_id, uid, r_priority AS priority, r_summary AS summary FROM emitted WHERE account_id <> 'acct_src0'"
    out["query_document"] = (
        f"{w}, page AS (SELECT * FROM store WHERE id > 10 AND priority = 'Medium' ORDER BY id LIMIT 500) "
        "SELECT count(*) OVER () AS count, max(id) OVER () AS max_id, count(*) OVER () = 500 AS has_more, id, account_id, uid, "
        "key_entities, is_truncated FROM page")
    out["json_sink"] = f"SELECT account_id, json FROM ({out['json_results']})"
    out["date_floor"] = (
        f"{world(init='2023-12-20')}, dated AS (SELECT m.account_id, m.uid, m.uid % 28 AS d, CASE m.uid % 5 "
        "WHEN 0 THEN TIMESTAMP '2023-12-02 04:30:00' + to_days(CAST(m.uid % 28 AS INTEGER)) "
        "WHEN 2 THEN TIMESTAMP '2024-02-01 15:15:00' + to_days(CAST(m.uid % 28 AS INTEGER)) "
        "WHEN 3 THEN TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(m.uid % 28 AS INTEGER)) END AS sent_at "
        "FROM messages m JOIN plan USING (account_id) WHERE guard_ok AND m.uid >= start_uid) "
        f"SELECT account_id, uid, {ts('sent_at')} AS sent_at FROM dated "
        "WHERE sent_at IS NULL OR sent_at >= TIMESTAMP '2023-12-20'")
    out["target_account"] = f"{world()} SELECT * FROM plan WHERE account_id = 'acct_src3'"
    out["store_by_run"] = f"{w} SELECT {page_cols} FROM store"
    if llm_queries:
        out |= llm_queries.ORACLES
        if corpus_pipeline.ORACLE_SQL:
            out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
