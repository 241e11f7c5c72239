"""P1 fingerprint, P2 truncation, P3 preview, P8 request text."""
import hashlib

from pyspark.sql import functions as F

from tidemark.functions.fingerprint import fingerprint
from tidemark.functions.text import body_preview, clipped_body, is_truncated, request_text

SCHEMA = "sender string, date string, subject string, body string"


def expected(sender, date, subject, body):
    canon = f"{sender or ''}|{date or ''}|{subject or ''}|{(body or '')[:2000]}"
    return hashlib.sha256(canon.encode("utf-8")).hexdigest()[:16]


def fp(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return [r[0] for r in df.select(fingerprint()).collect()]


def test_fingerprint_is_16_hex_and_deterministic(spark):
    row = ("a@x.com", "Mon, 1 Jan 2024", "Hello", "Body")
    a, b = fp(spark, [row, row])
    assert a == b == expected(*row)
    assert len(a) == 16 and all(c in "0123456789abcdef" for c in a)


def test_each_field_changes_fingerprint(spark):
    base = ("s", "d", "j", "b")
    rows = [base, ("s2", "d", "j", "b"), ("s", "d2", "j", "b"), ("s", "d", "j2", "b"), ("s", "d", "j", "b2")]
    assert len(set(fp(spark, rows))) == 5


def test_chars_after_2000_do_not_matter(spark):
    body = "x" * 2000
    a, b = fp(spark, [("s", "d", "j", body + "AAA"), ("s", "d", "j", body + "BBB")])
    assert a == b


def test_null_fields_hash_as_empty(spark):
    got = fp(spark, [(None, None, None, None), ("s", "d", "j", None)])
    assert got == [expected(None, None, None, None), expected("s", "d", "j", None)]


def test_unicode_body_hashes_utf8(spark):
    row = ("s", "d", "sujet é", "a😀b" * 900)
    assert fp(spark, [row]) == [expected(*row)]


def test_truncation_and_flag(spark):
    df = spark.createDataFrame([("a" * 150,), ("short",), (None,)], "body string")
    rows = df.select(clipped_body("body", 100).alias("c"), is_truncated("body", 100).alias("t")).collect()
    assert [(len(r.c), r.t) for r in rows] == [(100, True), (5, False), (0, False)]


def test_preview_is_10240_chars(spark):
    df = spark.createDataFrame([("z" * 20000,), (None,)], "body string")
    assert [len(r[0]) for r in df.select(body_preview("body")).collect()] == [10240, 0]


def test_request_text_renders_none_for_null(spark):
    df = spark.createDataFrame([("Subj", None, "2024-01-01", "hello")], "subject string, sender string, date string, clipped string")
    got = df.select(request_text("subject", "sender", "date", "clipped")).first()[0]
    ind = "\n        "
    assert got == f"{ind}Subject: Subj{ind}Sender: None{ind}Date: 2024-01-01{ind}{ind}Body:{ind}hello{ind}"


def test_fingerprint_matches_hashlib_on_fixture(spark):
    from tidemark.sources.tables import messages
    m = messages(spark, "/root/testdata/sf0.001")
    rows = m.select("sender", "date", "subject", "body", fingerprint().alias("h")).collect()
    assert all(r.h == expected(r.sender, r.date, r.subject, r.body) for r in rows)
    assert F is not None
