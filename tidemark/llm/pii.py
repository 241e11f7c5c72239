"""Operator 5: personal data replaced by consistent surrogates.

Detected entities are split into *units* (an e-mail address, the digits of a
card, a given name, ...). A unit's surrogate is drawn from a keyed SHA-256 of
its kind and its normalised value, so it is the same wherever the unit occurs
(coreference), and keeps the kind's form: separators, lengths, letter case,
country codes, the validity of card check digits, a name's gender (from its
title) and script. Names and the local parts of addresses grow with each
attempt; the other forms have 1e8 values or more.

Collision checks keep units distinct: over the table of distinct units, a
surrogate that two units share, or that is itself a unit of the corpus, is
drawn again with the next attempt number for all but the first of them, until
none is left. Only units with an attempt above 0 (a small share) are joined to
the documents that hold them; all other surrogates are computed in place.

Everything is built-in column functions. Texts that no detector can match are
told by one cheap pattern and pass through; the others are searched once and
staged. Units are aggregated by value with map-side combine, so a unit that
occurs in a third of all rows is one row per task; only staged texts are ever
joined.

Defined results: null text stays null; a text without entities is returned as
it is; repeated rows are treated alike; other columns pass through, and a
column ``n_chars`` follows the new text.
"""

from __future__ import annotations

import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import stage_table

#: The setting that holds the key of the surrogates.
KEY_CONF = "tidemark.pii.key"

#: Titles by gender, and those of any.
MALE = ["Mr", "MR", "Herr", "Monsieur", "Señor", "Sr", "Sir", "г-н", "господин"]
FEMALE = ["Mrs", "Ms", "MRS", "MS", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Lady", "г-жа", "госпожа"]
NEUTRAL = ["Dr", "DR", "Dra", "Prof", "Profa", "Doctor", "Professor", "Doktor", "Docteur", "Professeur", "Rev", "Mx", "д-р", "доктор", "профессор", "Δρ"]
_TITLE = "|".join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True))
#: A part of a name: a word without the possessive, or an initial.
_NAME = (rf"(?!(?:{_TITLE})\.? )(?:\p{{Lu}}(?:\p{{L}}|['’-](?=\p{{L}})(?!s(?!\p{{L}})))+"
         r"|\p{Lu}(?:\.|(?= \p{Lu}[\p{L}.])))")
_GROUP = "[0-9A-Fa-f]{1,4}"

#: Detectors, tried in this order where two begin at one place.
DETECTORS = {
    "secret": r"(?<=(?:password|passwd|secret|api_key|apikey|token)(?:=|=\"| = \"|: |: \"))[A-Za-z0-9+/_-]{8,}",
    "access_key": r"(?<![\p{L}\d])A(?:KIA|SIA)[A-Z0-9]{16}(?![\p{L}\d])",
    "email": r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "iban": r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\d])",
    "ip6": rf"(?<![\p{{L}}\d:.])(?:(?:{_GROUP}:){{7}}{_GROUP}|(?=[A-Fa-f:]*\d)(?:(?:{_GROUP}:){{1,7}}:(?:{_GROUP}(?::{_GROUP}){{0,5}})?"
           rf"|::{_GROUP}(?::{_GROUP}){{0,6}}))(?![\p{{L}}\d:]|\.\d)",
    "ip": r"(?<![\p{L}\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "ssn": r"(?<![\p{L}\d-])(?:\d{3}-\d{2}-\d{4}(?![\p{L}\d-])|(?<!\d[ .])\d{3} \d{2} \d{4}(?![\p{L}\d-]|[ .]\d))",
    "card": r"(?<![\p{L}\d.+-])(?:\d{13,19}|\d{4}[ .-]\d{4}[ .-]\d{4}[ .-]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{4,5})(?![\p{L}\d])",
    "phone": r"(?<![\p{L}\d])(?:\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}|(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}"
             r"|\+\d{1,3}(?=(?:[ .()-]{0,2}\d){8,12}(?!\d))(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{1,8}){1,6}|0\d(?:[ .-]\d{2}){4})(?!\d)",
    "person": rf"(?<!\p{{L}})(?:(?:{_TITLE})\.? )+{_NAME}(?:(?: |(?<=\.)){_NAME})*",
}
PATTERN = "|".join(DETECTORS.values())
#: What a text needs for any detector to match.
HINT = rf"[0-9@]|AKIA|ASIA|(?:password|passwd|secret|key|token)(?:=|:| )|(?:{_TITLE})\.? \p{{Lu}}"

#: Given names by gender and script, and syllables of surnames by script.
GIVEN = {
    "m_latin": ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Marc", "Noel", "Oscar", "Paul"],
    "f_latin": ["Anna", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irene", "Julia", "Karin", "Laura", "Maria", "Nora", "Olga", "Paula"],
    "m_cyrillic": ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Семён"],
    "f_cyrillic": ["Анна", "Белла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Клара", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса"],
    "m_greek": ["Άρης", "Βασίλης", "Γιώργος", "Δήμος", "Ηλίας", "Θωμάς", "Ιάσων", "Κώστας", "Λουκάς", "Μάρκος", "Νίκος", "Ορέστης", "Πέτρος", "Σπύρος", "Τάσος", "Φώτης"],
    "f_greek": ["Άννα", "Βάσω", "Γιώτα", "Δάφνη", "Ελένη", "Ζωή", "Ηρώ", "Θάλεια", "Ιωάννα", "Κλειώ", "Λίνα", "Μαρία", "Νίκη", "Ξένια", "Όλγα", "Πόπη"],
}
GIVEN |= {f"n_{script}": GIVEN[f"m_{script}"][::2] + GIVEN[f"f_{script}"][1::2] for script in ("latin", "cyrillic", "greek")}
SYLLABLE = {
    "latin": ["ba", "den", "fer", "gor", "hal", "jun", "ker", "lin", "mon", "nar", "pel", "ros", "sten", "tor", "vel", "win"],
    "cyrillic": ["ба", "вел", "гор", "дан", "жур", "зим", "кор", "лов", "мир", "нев", "пет", "рос", "сел", "тур", "фед", "чер"],
    "greek": ["βα", "γιαν", "δρο", "ζερ", "θαν", "καρ", "λιν", "μαρ", "νικ", "ξεν", "παπ", "ρος", "σταμ", "τσα", "φιλ", "χρι"],
}


def entities(text: Column) -> Column:
    """All entities of a text, in order."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _kind(e: Column) -> Column:
    """The kind of one entity, by its form."""
    return (F.when(e.contains("@"), "email").when(e.rlike("^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$"), "ip6").when(e.rlike(rf"^(?:{_TITLE})\.? "), "person")
            .when(e.rlike(r"^A[KS]IA[A-Z0-9]{16}$"), "access_key").when(e.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ip")
            .when(e.rlike(r"^\d{3}[ -]\d{2}[ -]\d{4}$"), "ssn").when(e.rlike(r"^\+|^\(|^\d{3}[ .-]\d{3}[ .-]\d{4}$|^0\d(?:[ .-]\d{2}){4}$"), "phone")
            .when(e.rlike(r"^\d{13,19}$|^\d{4}[ .-]\d{4}[ .-]\d{4}[ .-]\d{1,7}$|^\d{4}[ -]\d{6}[ -]\d{4,5}$"), "card")
            .when(e.rlike(r"^[A-Z]{2}\d{2}[ A-Z0-9]{12,}$"), "iban").otherwise("secret"))


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _name(e: Column) -> Column:
    """A person's words in order: array<struct<kind, norm, form>>; the last
    word that is no initial is the surname, the others are given names."""
    words = F.split(F.regexp_replace(e, rf"^(?:(?:{_TITLE})\.? )+", ""), r" |(?<=\.)(?=\p{Lu})")
    of = lambda titles: e.rlike(rf"^(?:(?:{_TITLE})\.? )*(?:{'|'.join(titles)})\.? ")
    gender = F.when(of(FEMALE), "f_").when(of(MALE), "m_").otherwise("n_")
    initial = lambda w: w.rlike(r"^\p{Lu}\.?$")
    part = lambda w, i, n: F.struct(
        F.when(initial(w), F.concat(F.lit("initial_"), _script(w))).when(i + 1 == n, F.concat(F.lit("surname_"), _script(w)))
        .otherwise(F.concat(F.lit("given_"), gender, _script(w))).alias("kind"), F.lower(w).alias("norm"), w.alias("form"))
    last = F.aggregate(words, F.struct(F.lit(0).alias("i"), F.lit(0).alias("n")), lambda a, w: F.struct(
        (a["i"] + 1).alias("i"), F.when(initial(w), a["n"]).otherwise(a["i"] + 1).alias("n")))["n"]
    return F.flatten(F.transform(F.array(F.struct(words.alias("w"), last.alias("n"))), lambda x: F.transform(x["w"], lambda w, i: part(w, i, x["n"]))))


def _full_ip6(e: Column) -> Column:
    """An IPv6 address in lower case with all its digits."""
    groups = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
    head, tail = groups(F.substring_index(F.lower(e), "::", 1)), F.when(e.contains("::"), groups(F.substring_index(F.lower(e), "::", -1))).otherwise(
        F.array().cast("array<string>"))
    zeros = F.array_repeat(F.lit("0"), 8 - F.size(head) - F.size(tail))
    return F.array_join(F.transform(F.concat(head, zeros, tail), lambda g: F.lpad(g, 4, "0")), ":")


def _proper(names: Column) -> Column:
    """``_name`` without initials, which are too few to be distinct."""
    return F.filter(names, lambda p: ~p["kind"].startswith("initial"))


def units(e: Column) -> Column:
    """An entity's units: array<struct<kind, norm>>."""
    kind = _kind(e)
    one = lambda k, n: F.struct(k.alias("kind"), n.alias("norm"))
    digits = F.regexp_replace(e, r"\D", "")
    norm = (F.when(kind == "email", F.lower(e)).when(kind.isin("ssn", "card"), digits).when(kind == "ip6", _full_ip6(e))
            .when(kind == "phone", F.concat(_country(e), F.lit("|"), F.regexp_replace(_national(e), r"\D", "")))
            .when(kind == "iban", F.replace(e, F.lit(" "), F.lit(""))).otherwise(e))
    names = F.transform(_proper(_name(e)), lambda p: one(p["kind"], p["norm"]))
    return F.when(kind == "person", names).otherwise(F.array(one(kind, norm)))


def _country(e: Column) -> Column:
    return F.regexp_extract(e, r"^\+\d{1,3}(?=[ .(-])", 0)


def _national(e: Column) -> Column:
    return F.regexp_replace(e, r"^\+\d{1,3}(?=[ .(-])", "")


def _hash(key: str, kind: Column, norm: Column, attempt: Column, salt: str = "") -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key + salt), kind, norm, attempt.cast("string")), 256)


def _digits(h: Column) -> Column:
    """60 decimal digits of a hash."""
    part = lambda j: F.substring(F.lpad(F.conv(F.substring(h, 1 + 15 * j, 15), 16, 10), 18, "0"), 4, 15)
    return F.concat(*[part(j) for j in range(4)])


def _nibble(h: Column, j: int) -> Column:
    return F.conv(F.substring(h, 1 + j, 1), 16, 10).cast("int")


def _fill(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced by ``digits`` in order."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))
    return F.aggregate(F.split(form, ""), start, lambda a, c: F.when(
        c.rlike("[0-9]"), F.struct(F.concat(a["s"], digits.substr(a["i"], F.lit(1))).alias("s"), (a["i"] + 1).alias("i")))
        .otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["i"].alias("i"))))["s"]


def _spell(form: Column, h: Column) -> Column:
    """``form`` with letters (of its script) and digits drawn from a hash."""
    stream = F.concat(h, F.reverse(h))
    alphabet = {"latin": "abcdefghijklmnop", "cyrillic": "абвгдежзиклмнопр", "greek": "αβγδεζηθικλμνξοπ"}
    at = lambda i: F.conv(stream.substr(F.pmod(i, F.lit(128)) + 1, F.lit(1)), 16, 10).cast("int")
    letter = lambda c, i: reduce(lambda out, s: F.when(_script(c) == s, F.substr(F.lit(alphabet[s]), at(i) + 1, F.lit(1))).otherwise(out),
                                 ("cyrillic", "greek"), F.substr(F.lit(alphabet["latin"]), at(i) + 1, F.lit(1)))
    return F.array_join(F.transform(F.split(form, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.pmod(at(i), F.lit(10)).cast("string"))
                                    .when(c.rlike(r"\p{L}"), letter(c, i)).otherwise(c)), "")


def _luhn(body: Column) -> Column:
    """The check digit that completes a card number."""
    n = F.length(body)
    total = F.aggregate(F.split(body, ""), F.struct(F.lit(0).alias("t"), F.lit(0).alias("i")), lambda a, c: F.struct(
        (a["t"] + F.when(F.pmod(n - a["i"], F.lit(2)) == 1, F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int")))
         .otherwise(c.cast("int"))).alias("t"), (a["i"] + 1).alias("i")))["t"]
    return F.pmod(10 - total, F.lit(10))


def _pick(h: Column, words: list[str]):
    """Chooses one of 16 words by the j-th digit of a hash."""
    listed = F.array(*[F.lit(w) for w in words])
    return lambda j: F.element_at(listed, F.conv(h.substr(j, F.lit(1)), 16, 10).cast("int") + 1)


def surrogate(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """A unit's surrogate, in the form of ``norm``."""
    h = _hash(key, kind, norm, attempt)
    body = _digits(h).substr(F.lit(1), F.length(norm) - 1)
    was_valid = _luhn(norm.substr(F.lit(1), F.length(norm) - 1)) == norm.substr(F.length(norm), F.lit(1)).cast("int")
    check = F.pmod(_luhn(body) + F.when(was_valid, 0).otherwise(1 + F.pmod(_nibble(h, 63), F.lit(9))), F.lit(10))
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    site = F.translate(F.substring(_hash(key, F.lit("domain"), domain, F.lit(0)), 1, 8), "0123456789", "ghijklmnop")
    filler = F.when(_script(local) == "cyrillic", "а").when(_script(local) == "greek", "α").otherwise("a")
    wider = F.concat(local, F.repeat(filler, attempt))  # one more letter for each attempt, so that short locals never run out
    octet = lambda j: F.conv(F.substring(h, 1 + 2 * j, 2), 16, 10).cast("int")
    address = F.concat_ws(".", (1 + F.pmod(octet(0), F.lit(223))).cast("string"), *[octet(j).cast("string") for j in (1, 2, 3)])
    hexes = F.concat(h, _hash(key, kind, norm, attempt, "+"))
    long = F.repeat(hexes, F.ceil(F.length(norm) / 128).cast("int")).substr(F.lit(1), F.length(norm))
    secret = F.when(norm.rlike("^[0-9a-f]+$"), long).otherwise(F.translate(long, "0123456789abcdef", "aK7qW3xZ9rB2m5Td"))
    access = F.concat(norm.substr(F.lit(1), F.lit(4)), F.translate(F.substring(h, 1, 16), "0123456789abcdef", "K7QW3XZ9RB2M5TDH"))
    country, digits = F.substring_index(norm, "|", 1), F.substring_index(norm, "|", -1)
    out = (F.when(kind == "email", F.concat(_spell(wider, h), F.lit("@"), site, F.lit(".example")))
           .when(kind == "phone", F.concat(country, F.lit("|"), _digits(h).substr(F.lit(1), F.length(digits))))
           .when(kind == "ssn", F.concat(F.lit("9"), F.substring(_digits(h), 1, 8)))
           .when(kind == "card", F.concat(body, check.cast("string"))).when(kind == "ip", address)
           .when(kind == "access_key", access).when(kind == "ip6", F.regexp_replace(F.substring(h, 1, 32), "(.{4})(?=.)", "$1:"))
           .when(kind.startswith("initial"), F.upper(_spell(norm, h)))
           .when(kind == "iban", F.concat(norm.substr(F.lit(1), F.lit(2)), F.upper(_spell(F.lower(F.substr(norm, F.lit(3))), h))))
           .when(kind == "secret", secret))
    for name, given in GIVEN.items():  # one more part for each attempt, so that names never run out
        out = out.when(kind == f"given_{name}", F.array_join(F.transform(F.sequence(F.lit(1), attempt + 1), _pick(h, given)), "-"))
    for script, syllables in SYLLABLE.items():
        out = out.when(kind == f"surname_{script}",
                       F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), attempt + 4), _pick(h, syllables)), "")))
    return out


def _mark(kind: Column, norm: Column) -> Column:
    return F.concat(kind, F.lit("\x1f"), norm)


def _draw(key: str, parts: Column, bumps: Column) -> Column:
    """The surrogates of units; ``bumps`` maps units to their attempts."""
    return F.transform(parts, lambda u: surrogate(
        key, u["kind"], u["norm"], F.coalesce(F.element_at(bumps, _mark(u["kind"], u["norm"])), F.lit(0))))


def _render(key: str, e: Column, bumps: Column) -> Column:
    """The replacement of one entity."""
    kind, first = _kind(e), F.get(_draw(key, units(e), bumps), F.lit(0))
    name = F.array_join(_draw(key, _name(e), bumps), " ")
    name = F.when(e.rlike(r"\.\p{Lu}"), F.regexp_replace(name, r"(?<=\.) (?=\p{Lu}\.)", "")).otherwise(name)
    title = F.regexp_extract(e, rf"^(?:(?:{_TITLE})\.? )+", 0)
    return (F.when(kind == "person", F.concat(title, name))
            .when(kind == "phone", F.concat(F.substring_index(first, "|", 1), _fill(_national(e), F.substring_index(first, "|", -1))))
            .when(kind.isin("card", "ssn"), _fill(e, first))
            .when(kind == "iban", F.when(e.contains(" "), F.trim(F.regexp_replace(first, "(.{4})", "$1 "))).otherwise(first))
            .otherwise(first))


def _mentions(key: str, pieces: Column, found: Column, bumps: Column) -> Column:
    """``pieces`` of a text with the names of its persons replaced where they
    stand without a title; a word with two roles follows the first."""
    names = F.flatten(F.transform(F.filter(found, lambda e: _kind(e) == "person"), lambda e: _proper(_name(e))))
    known = F.zip_with(names, _draw(key, names, bumps), lambda p, s: F.struct(p["form"].alias("form"), s.alias("s")))
    # descending, so that a longer name comes before its beginning
    words = F.array_join(F.sort_array(F.array_distinct(F.transform(names, lambda p: p["form"])), False), "|")
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), words, F.lit(r")(?!\p{L})"))
    said = lambda piece, x: F.array_join(F.zip_with(
        F.split(piece, x["pattern"]), F.regexp_extract_all(piece, x["pattern"], F.lit(0)),
        lambda between, word: F.concat(between, F.coalesce(F.get(F.filter(x["known"], lambda n: n["form"] == word), F.lit(0))["s"], F.lit("")))), "")
    once = F.array(F.struct(known.alias("known"), pattern.alias("pattern")))  # bound, so that each is computed once a text
    return F.when(F.exists(found, lambda e: (_kind(e) == "person") & (F.size(units(e)) > 0)),
                  F.flatten(F.transform(once, lambda x: F.transform(pieces, lambda piece: said(piece, x))))).otherwise(pieces)


def secret_key(spark: SparkSession) -> str:
    """The key that the session names (``tidemark.pii.key``); where it names
    none, a new one for this run, which nobody can guess or repeat."""
    return spark.conf.get(KEY_CONF, None) or secrets.token_hex(32)


def exceptions(found: DataFrame, key: str) -> DataFrame:
    """(mark, attempt) of the units whose first surrogate is not distinct;
    ``found``: rows with ``__found``, the entities of a text."""
    once = found.select(F.explode("__found").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n"))
    each = once.select(F.explode(units(F.col("e"))).alias("u")).select("u.*").distinct()
    now = stage_table(each.withColumn("attempt", F.lit(0)), "units")
    while True:
        # staged, so that the plans that read it twice stay small
        drawn = stage_table(now.withColumn("s", surrogate(key, F.col("kind"), F.col("norm"), F.col("attempt"))), "drawn")
        # a first draw keeps its place before later draws; then the smaller value does
        first = drawn.groupBy("kind", "s").agg(F.min(F.struct("attempt", "norm")).alias("first"), F.count(F.lit(1)).alias("n"))
        real = now.select("kind", F.col("norm").alias("low"), F.lit(True).alias("real"))
        marked = (drawn.join(first.where("n > 1").drop("n"), ["kind", "s"], "left")
                  .withColumn("low", F.lower("s")).join(real, ["kind", "low"], "left"))
        again = (F.col("first").isNotNull() & (F.struct("attempt", "norm") != F.col("first"))) | F.coalesce("real", F.lit(False))
        after = stage_table(marked.select("kind", "norm", "attempt", again.alias("again")), "units")
        if after.where("again").isEmpty():
            return after.where("attempt > 0").select(_mark(F.col("kind"), F.col("norm")).alias("mark"), "attempt")
        now = after.select("kind", "norm", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))


def pseudonymise(docs: DataFrame, key: str | None = None, count: str | None = None) -> DataFrame:
    """``docs`` with ``text`` replaced; ``count`` names a further column with
    the number of entities. Whoever has ``key`` can try out numbers and names,
    so there is none to fall back on: see ``secret_key``."""
    key = key or secret_key(docs.sparkSession)
    hinted = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    # texts that may hold entities (a small share) are searched once and staged; all others never move
    found = stage_table(docs.where(hinted).withColumns({"__row": F.xxhash64("doc_id", "text"), "__found": entities(F.col("text"))}), "found")
    odd = exceptions(found, key)
    marks = F.flatten(F.transform("__found", lambda e: F.transform(units(e), lambda u: _mark(u["kind"], u["norm"]))))
    bumps = (found.select("__row", F.explode(F.array_distinct(marks)).alias("mark")).distinct().join(odd, "mark")
             .groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("mark", "attempt"))).alias("__bumps")))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
    # most corpora have no exception; texts that have one are staged with them, so that the search and replacement are planned once
    marked = found.withColumn("__bumps", none) if odd.isEmpty() else stage_table(
        found.join(bumps, "__row", "left").withColumn("__bumps", F.coalesce("__bumps", none)), "marked")
    drawn = F.transform("__found", lambda e: _render(key, e, F.col("__bumps")))
    between = _mentions(key, F.split("text", PATTERN), F.col("__found"), F.col("__bumps"))
    # split() and regexp_extract_all() see the same matches, so piece i stands before surrogate i
    woven = F.array_join(F.zip_with(between, drawn, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    out = marked.withColumn("text", F.when(F.size("__found") > 0, woven).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kept = F.when(F.size("__found") > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", kept.cast(docs.schema["n_chars"].dataType))
    rest = docs.where(~hinted)
    if count:
        out, rest = out.withColumn(count, F.size("__found").cast("long")), rest.withColumn(count, F.lit(0).cast("long"))
    return rest.unionByName(out.drop("__row", "__found", "__bumps"))
