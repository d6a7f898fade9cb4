r"""Personal-data spans: patterns propose, checksums confirm, context words score (operator 8).

Built from SQL functions only.  A pattern's matches are found twice over the
same text: ``regexp_extract_all`` gives the matched strings and ``split`` the
gaps between them, so a span's start is a running sum of lengths, in code
points.  The patterns equal the plain forms in the comments but never
backtrack over a long run: repeats are possessive, and a match may only begin
where a run begins or where the previous match ended (``\G``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import let

#: Characters of an international bank account number, and the countries whose numbers have so many.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN_FORMS = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
#: Kinds in report order and the pattern that proposes each.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # Added to the base kinds: an international bank account number of its country's length, with single spaces or none.
    "iban": rf"(?<![A-Za-z0-9])(?:{_IBAN_FORMS})(?![A-Za-z0-9])",
}
BASE_KINDS = ("email", "ip", "card", "phone")
#: A cheap necessary condition per kind; texts without it skip the kind's search.
NEEDS = {"email": "@", "phone": "+"}
#: Words that make a span of the kind more likely, and base scores.
CONTEXT = {
    "email": "e-?mail|mail|contact|write|courriel|correo",
    "ip": r"\bip\b|address|server|host|login",
    "card": "card|visa|master|credit|carte|karte|tarjeta|payment",
    "phone": r"phone|\btel|call|mobile|fax|telefon|t[eé]l[eé]fono",
    "iban": "iban|bank|account|konto|compte|cuenta",
}
BASE_SCORE = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.9}
CONTEXT_CHARS = 48
CONTEXT_BONUS = 0.15


def _luhn(digits: Column) -> Column:
    """Luhn checksum of a digit string."""
    n = F.length(digits)

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def _mod97(iban: Column) -> Column:
    """ISO 13616 check: country and check digits go last, letters count from 10; the remainder is 1."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        # At most 255: no part keeps over three digits or exceeds 255 once leading zeros go.
        return F.forall(F.split(match, r"\."), lambda p: let(
            F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) <= 3) & (F.coalesce(
                F.try_to_number(F.concat(F.lit("0"), F.substring(q, 1, 3)), F.lit("9999")), F.lit(0)) <= 255)))
    if kind == "card":
        return F.length(digits).between(16, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        return _mod97(F.replace(match, F.lit(" "), F.lit("")))
    return F.lit(True)


def _spans(kind: str, text: Column) -> Column:
    """Array of (kind, start, stop, score) structs, in order of start."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    if kind in NEEDS:
        found = F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(F.array().cast("array<string>"))

    def placed(matches: Column) -> Column:
        gaps = F.split(text, PATTERNS[kind], -1)
        # Running sum: the state is (position, spans so far); gap i stands before match i.
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,hit:string>>").alias("out"))

        def step(acc: Column, pair: Column) -> Column:
            s = acc["at"] + F.length(pair["gap"])
            e = s + F.length(pair["hit"])
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(
                s.alias("start"), e.alias("stop"), pair["hit"].alias("hit")))).alias("out"))
        pairs = let(gaps, lambda g: F.transform(matches, lambda m, i: F.struct(g[i].alias("gap"), m.alias("hit"))))
        return F.aggregate(pairs, start, step, lambda acc: acc["out"])

    def scored(span: Column) -> Column:
        left = F.greatest(span["start"] - CONTEXT_CHARS, F.lit(0))
        near = F.concat_ws(" ", F.substring(text, left + 1, span["start"] - left),
                           F.substring(text, span["stop"] + 1, F.lit(CONTEXT_CHARS)))
        bonus = F.when(F.lower(near).rlike(CONTEXT[kind]), CONTEXT_BONUS).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), span["start"].alias("start"), span["stop"].alias("stop"),
                        F.round(F.least(F.lit(BASE_SCORE[kind]) + bonus, F.lit(1.0)), 2).alias("score"))
    empty = F.array().cast("array<struct<kind:string,start:int,stop:int,score:double>>")
    return let(found, lambda m: F.when(F.size(m) == 0, empty).otherwise(
        F.transform(F.filter(placed(m), lambda s: _valid(kind, s["hit"])), scored)))


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with one more column ``pii``: an array of ``struct(kind, start, stop, score)``.

    Spans are listed by kind (in the order of ``PATTERNS``), then by start;
    offsets are code points and ``stop`` is exclusive.  Within a kind, matches
    are leftmost and do not overlap; a match that fails its validator (number
    of digits, parts up to 255, Luhn, mod 97) is dropped and not tried again
    in part.  An account number has its country's length; codes of no
    country in ``IBAN_LENGTHS`` give none.  Kinds may overlap each other.  ``score`` is the kind's base
    score, raised when a context word stands near.  A NULL or empty text has
    no spans; rows, repeated rows and other columns pass through as they are
    (a column named ``pii`` is replaced).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn("pii", F.concat(*[_spans(k, text) for k in PATTERNS]))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of the base spans, and all spans."""
    found = find_pii(docs.select("doc_id", "text"))

    def counted(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii", lambda s: s["kind"] != "iban")
    scores = F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",")
    return found.select("doc_id", *[counted(k) for k in BASE_KINDS], F.sha2(_listed(base), 256).alias("base_sha256"),
                        _listed(F.col("pii")).alias("spans"), counted("iban"), scores.alias("scores"))
