"""P9 answer validation and P10-P13 result constructors (Column functions).

Validation runs on VARIANT (``try_parse_json``) rather than ``from_json``
with a typed schema: a typed read would coerce ``[1]`` to ``["1"]`` and mark
``"yes"`` corrupt, both of which differ from the contract below.

Contract for one answer (first failing rule wins, in this order):

* not JSON, JSON with duplicate keys, or JSON that is not an object -> error
* priority: missing -> ``Low``; otherwise must be a string equal to one of the
  five enum members (case-sensitive)
* summary: missing -> ``Failed to summarize``; otherwise must be a string
* key_entities: missing -> ``[]``; otherwise an array whose items are all strings
* action_required: missing -> False; otherwise a JSON boolean, the numbers
  0/1 (0.0/1.0), or a string whose lower case is a known boolean spelling
* an explicit JSON null for any of the four keys is an error
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .common import col as _c
from .common import let

ERR_NOT_OBJECT = "response is not a JSON object"
ERR_PRIORITY = "priority: input should be 'High', 'Medium', 'Low', 'Spam' or 'Error'"
ERR_SUMMARY = "summary: input should be a valid string"
ERR_ENTITIES = "key_entities: input should be a valid list of strings"
ERR_ACTION = "action_required: input should be a valid boolean"

_INT_TYPES = ["TINYINT", "SMALLINT", "INT", "BIGINT"]


def validate_answer(raw="raw_json", normalize_case: bool = False) -> Column:
    """STRUCT<ok, priority, summary, key_entities, action_required, error>.

    With ``normalize_case`` a priority counts in any letter case (C21: a model
    may echo a prompt's ``HIGH``) and is returned as the enum spells it.

    The answer is parsed once and every per-field value is extracted once
    (one-element ``transform`` bindings), however often the rules use it.
    """
    return let(F.try_parse_json(_c(raw)), lambda v: _fields(v, normalize_case))


def _fields(v: Column, normalize_case: bool) -> Column:
    def get(key):
        return F.try_variant_get(v, f"$.{key}", "variant")

    p, s, e, a = get("priority"), get("summary"), get("key_entities"), get("action_required")
    priority = F.try_variant_get(p, "$", "string")
    priority = F.initcap(F.lower(priority)) if normalize_case else priority
    return let(F.struct(
        (v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT<")).alias("is_obj"),
        p.isNotNull().alias("p_has"), F.schema_of_variant(p).alias("pt"), priority.alias("p_str"),
        s.isNotNull().alias("s_has"), F.schema_of_variant(s).alias("st"), F.try_variant_get(s, "$", "string").alias("s_str"),
        e.isNotNull().alias("e_has"), F.schema_of_variant(e).alias("et"), F.try_variant_get(e, "$", "array<string>").alias("e_arr"),
        a.isNotNull().alias("a_has"), F.schema_of_variant(a).alias("at"),
        F.lower(F.try_variant_get(a, "$", "string")).alias("a_str"), F.try_variant_get(a, "$", "double").alias("a_num"),
        F.try_variant_get(a, "$", "boolean").alias("a_bool"),
    ), _rules)


def _rules(f: Column) -> Column:
    at = f["at"]
    p_ok = ~f["p_has"] | ((f["pt"] == "STRING") & f["p_str"].isin(*K.PRIORITIES))
    s_ok = ~f["s_has"] | (f["st"] == "STRING")
    e_arr = f["e_arr"]
    e_ok = ~f["e_has"] | (
        f["et"].isin("ARRAY<STRING>", "ARRAY<VOID>") & e_arr.isNotNull() & ~F.exists(e_arr, lambda x: x.isNull()))
    a_is_num = at.isin(*_INT_TYPES) | at.startswith("DECIMAL") | at.isin("DOUBLE", "FLOAT")
    a_val = (
        F.when(at == "BOOLEAN", f["a_bool"])
        .when(a_is_num & (f["a_num"] == 1.0), F.lit(True))
        .when(a_is_num & (f["a_num"] == 0.0), F.lit(False))
        .when((at == "STRING") & f["a_str"].isin(*K.BOOL_TRUE_STRINGS), F.lit(True))
        .when((at == "STRING") & f["a_str"].isin(*K.BOOL_FALSE_STRINGS), F.lit(False))
    )
    a_ok = ~f["a_has"] | a_val.isNotNull()
    error = (
        F.when(~F.coalesce(f["is_obj"], F.lit(False)), F.lit(ERR_NOT_OBJECT))
        .when(~p_ok, F.lit(ERR_PRIORITY))
        .when(~s_ok, F.lit(ERR_SUMMARY))
        .when(~e_ok, F.lit(ERR_ENTITIES))
        .when(~a_ok, F.lit(ERR_ACTION))
    )
    ok = error.isNull()
    return F.struct(
        ok.alias("ok"),
        F.when(ok, F.coalesce(f["p_str"], F.lit(K.DEFAULT_PRIORITY))).alias("priority"),
        F.when(ok, F.coalesce(f["s_str"], F.lit(K.DEFAULT_SUMMARY))).alias("summary"),
        F.when(ok, F.coalesce(e_arr, F.array().cast("array<string>"))).alias("key_entities"),
        F.when(ok, F.coalesce(a_val, F.lit(False))).alias("action_required"),
        F.when(~ok, F.concat(F.lit(K.QUARANTINE_ERROR_PREFIX), error)).alias("error"),
    )


def result_struct(original_uid, priority, summary, key_entities, action_required, is_truncated) -> Column:
    return F.struct(
        _c(original_uid).cast("bigint").alias("original_uid"),
        _c(priority).cast("string").alias("priority"),
        _c(summary).cast("string").alias("summary"),
        _c(key_entities).cast("array<string>").alias("key_entities"),
        _c(action_required).cast("boolean").alias("action_required"),
        _c(is_truncated).cast("boolean").alias("is_truncated"),
    )


def _lit_array(items) -> Column:
    return F.array(*[F.lit(x) for x in items]).cast("array<string>")


def answer_result(answer="answer", uid="uid", truncated="is_truncated") -> Column:
    a = _c(answer)
    return result_struct(uid, a["priority"], a["summary"], a["key_entities"], a["action_required"], truncated)


def skip_result(uid="uid", subject="subject") -> Column:
    """P10: result stamped on rows when enrichment is skipped."""
    return result_struct(
        uid, F.lit(K.PRIORITY_UNPROCESSED),
        F.concat(F.lit(K.SKIP_SUMMARY_PREFIX), F.coalesce(_c(subject), F.lit("None"))),
        F.array().cast("array<string>"), F.lit(False), F.lit(False),
    )


def dry_run_result(uid="uid", subject="subject", truncated="is_truncated") -> Column:
    """Simulated result (null subject reads as missing)."""
    return result_struct(
        uid, F.lit(K.DRY_RUN_PRIORITY),
        F.concat(F.lit(K.DRY_RUN_SUMMARY_PREFIX), F.coalesce(_c(subject), F.lit(K.DRY_RUN_MISSING_SUBJECT))),
        _lit_array(K.DRY_RUN_ENTITIES), F.lit(False), truncated,
    )


def quarantine_result(uid="uid", error="error") -> Column:
    """Dead-letter result carrying the first 150 chars of the error."""
    return result_struct(
        uid, F.lit("Error"),
        F.concat(F.lit(K.QUARANTINE_SUMMARY_PREFIX),
                 F.substring(F.coalesce(_c(error), F.lit("")), 1, K.QUARANTINE_DETAIL_CHARS)),
        _lit_array(K.QUARANTINE_ENTITIES), F.lit(True), F.lit(True),
    )


def flatten_result(result="result") -> list[Column]:
    """Result struct -> five store columns (null struct -> five nulls)."""
    r = _c(result)
    return [r["priority"].alias("priority"), r["summary"].alias("summary"),
            r["key_entities"].alias("key_entities"), r["action_required"].alias("action_required"),
            r["is_truncated"].alias("is_truncated")]
