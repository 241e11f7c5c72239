"""P9 answer validation, P10-P13 result constructors."""
import json

from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions.results import (dry_run_result, quarantine_result, skip_result,
                                        validate_answer)

ANSWERS = [
    '{"priority": "High", "summary": "s", "key_entities": ["a"], "action_required": true}',
    '{"priority": "HIGH", "summary": "s", "key_entities": [], "action_required": true}',
    '{"priority": null, "summary": "s"}',
    '{"summary": "s"}',
    '{}',
    '{"priority": "Low", "summary": 1}',
    '{"priority": "Low", "summary": null}',
    '{"priority": "Low", "key_entities": [1]}',
    '{"priority": "Low", "key_entities": "x"}',
    '{"priority": "Low", "key_entities": ["a", null]}',
    '{"priority": "Low", "key_entities": [null]}',
    '{"priority": "Low", "key_entities": null}',
    '{"priority": "Low", "key_entities": [["a"]]}',
    '{"priority": "Low", "action_required": "yes"}',
    '{"priority": "Low", "action_required": "Y"}',
    '{"priority": "Low", "action_required": "OFF"}',
    '{"priority": "Low", "action_required": 1}',
    '{"priority": "Low", "action_required": 0}',
    '{"priority": "Low", "action_required": 0.0}',
    '{"priority": "Low", "action_required": 1.0}',
    '{"priority": "Low", "action_required": 2}',
    '{"priority": "Low", "action_required": "maybe"}',
    '{"priority": "Low", "action_required": " true"}',
    '{"priority": "Low", "action_required": null}',
    '{"priority": "Low", "action_required": []}',
    '{"priority": 5}',
    '{"priority": "Spam", "summary": "ünïcode ✓", "key_entities": ["Zürich"]}',
    '{"priority": "Error"}',
    '[1, 2]',
    '"High"',
    'not json at all',
    '',
    None,
]

TRUE_S = {"1", "on", "t", "true", "y", "yes"}
FALSE_S = {"0", "off", "f", "false", "n", "no"}


def contract(raw):
    """The validation contract, stated directly in Python."""
    try:
        obj = json.loads(raw)
    except (TypeError, ValueError):
        return None
    if not isinstance(obj, dict):
        return None
    p = obj.get("priority", "Low")
    s = obj.get("summary", "Failed to summarize")
    e = obj.get("key_entities", [])
    a = obj.get("action_required", False)
    if not isinstance(p, str) or p not in K.PRIORITIES:
        return None
    if not isinstance(s, str):
        return None
    if not isinstance(e, list) or not all(isinstance(x, str) for x in e):
        return None
    if isinstance(a, bool):
        pass
    elif isinstance(a, (int, float)) and a in (0, 1):
        a = bool(a)
    elif isinstance(a, str) and a.lower() in TRUE_S | FALSE_S:
        a = a.lower() in TRUE_S
    else:
        return None
    return (p, s, e, a)


def test_validation_matrix(spark):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(ANSWERS)], "i int, raw string")
    rows = df.select("i", validate_answer("raw").alias("v")).orderBy("i").collect()
    for r in rows:
        want = contract(ANSWERS[r.i])
        v = r.v
        if want is None:
            assert v.ok is False and v.error.startswith(K.QUARANTINE_ERROR_PREFIX), ANSWERS[r.i]
        else:
            assert v.ok is True and v.error is None, ANSWERS[r.i]
            assert (v.priority, v.summary, list(v.key_entities), v.action_required) == want, ANSWERS[r.i]


def test_first_failing_rule_names_the_field(spark):
    df = spark.createDataFrame([('{"priority": "HIGH", "summary": 1}',), ('{"summary": 1}',)], "raw string")
    errs = [r[0] for r in df.select(validate_answer("raw")["error"]).collect()]
    assert errs[0].startswith("NLP failed: priority") and errs[1].startswith("NLP failed: summary")


def test_quarantine_result(spark):
    err = "NLP failed: " + "x" * 400
    df = spark.createDataFrame([(7, err)], "uid long, error string")
    r = df.select(quarantine_result("uid", "error").alias("r")).first().r
    assert r.original_uid == 7 and r.priority == "Error"
    assert r.summary == K.QUARANTINE_SUMMARY_PREFIX + err[:150]
    assert list(r.key_entities) == ["NLP_CRITICAL_FAILURE", "QUARANTINE_WARNING"]
    assert r.action_required is True and r.is_truncated is True


def test_skip_and_dry_run_results(spark):
    df = spark.createDataFrame([(3, "Hi", True), (4, None, False)], "uid long, subject string, t boolean")
    sk = [r[0] for r in df.select(skip_result("uid", "subject")).collect()]
    assert sk[0].priority == "Unprocessed" and sk[0].summary == "RAW: Hi" and list(sk[0].key_entities) == []
    assert sk[1].summary == "RAW: None" and sk[1].action_required is False and sk[1].is_truncated is False
    dr = [r[0] for r in df.select(dry_run_result("uid", "subject", "t")).collect()]
    assert dr[0].priority == "Medium" and dr[0].summary == "Dry-run simulated summary for Hi"
    assert dr[1].summary == "Dry-run simulated summary for No Subject"
    assert list(dr[0].key_entities) == ["DryRunEntity"] and dr[0].is_truncated is True
    assert F is not None


def test_priorities_in_any_case_when_asked(spark):
    raw = ['{"priority": "HIGH"}', '{"priority": "low"}', '{"priority": "Spam"}', '{"priority": "urgent"}', '{"priority": 1}', '{}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw_json string")
    out = sorted(df.select("i", validate_answer("raw_json", normalize_case=True).alias("a"), validate_answer("raw_json").alias("s")).collect())
    assert [r.a.priority for r in out] == ["High", "Low", "Spam", None, None, "Low"]
    assert [r.s.ok for r in out] == [False, False, True, False, False, True]
