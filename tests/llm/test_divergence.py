"""The divergence audit against a plain dense version, and on odd inputs."""

import re
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from wattline.llm import divergence as G

DOCS = "doc_id long, text string, lang string, source string"
TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top=50):
    """Every rate of every kept term, zeros included, for rows (text, lang, source)."""
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source, terms = lang or "", source or "", TERM.findall((text or "").translate(LOWER))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {k[0] for k in counts}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = [s for a, s in counts if a == lang]

        def rates(of):
            n = {t: sum(counts[lang, s][t] for s in of) for t in kept}
            whole = sum(n.values()) + 5 * len(kept)
            return n, {t: 1 + 1_000_000_000 * (n[t] + 5) // whole for t in kept}
        each, q = {s: rates([s]) for s in sources}, rates(sources)[1]
        for s in sources:
            n, p = each[s]
            pairs = [(sum(abs(p[t] - each[o][1][t]) for t in kept), o) for o in sources if o != s]
            over = [(p[t] - q[t], t) for t in kept if n[t] and p[t] > q[t]]
            for part, items in (("pair", pairs), ("term", over)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


def check(spark, rows, least=2, **options):
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOCS)
    assert got(G.divergence(docs, least, **options)) == plain(rows, least, options.get("top", 50))


ODD = [("A b,aéx b", "en", "s1"), ("a a b 1x", "en", "s2"), (None, "en", "s3"), ("b b c", "en", None), ("a b c", None, "s1"),
       ("A B C", None, "s2"), ("", "xx", "s1"), ("123", "xx", "s2"), ("only", "yy", "s1"), ("only only", "yy", "s1"),
       ("b a", "en", "é"), ("b a", "en", "Z"), ("ÄÖ äö", "en", "s1"), ("ÄÖ", "en", "s2"), ("c " * 60_000, "en", "s2")]


@pytest.mark.parametrize("block_cells, places", [(G.BLOCK_CELLS, 4_000_000), ((3, 3), 4), ((1, 1), 1)])
def test_odd_rows_in_blocks_of_any_size(spark, block_cells, places):
    check(spark, ODD, block_cells=block_cells, places=places)


def test_top_terms_and_clashing_columns(spark):
    check(spark, ODD, top=1)
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(ODD)], DOCS)
    names = ("term", "n", "d", "p", "q", "idx", "value", "rank", "item", "part", "cells", "pos", "size", "_salt")
    assert got(G.divergence(docs.withColumns({c: F.lit(1) for c in names}), 2)) == plain(ODD, 2)


def test_whole_table_in_several_hand_ons(spark, monkeypatch):
    monkeypatch.setattr(G, "HELD", 50)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r["text"], r["lang"], r["source"]) for r in docs.collect()]
    assert got(G.divergence(docs, block_cells=(500, 500), places=100)) == plain(rows, 30)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcdeF"), max_size=6).map(" ".join) | st.none(),
                          st.sampled_from(["x", "y", None]), st.sampled_from(["p", "q", "r", None])), min_size=1, max_size=30))
def test_random_tables(spark, rows):
    check(spark, rows, block_cells=(4, 4), places=6)


def test_large_counts_stay_exact(spark):
    n, whole, kept = 7 * 10**15, 10**18 - 3, 10**7
    row = spark.range(1).select(G.rate(F.lit(n), F.lit(whole), F.lit(kept)).alias("r")).first()
    assert row["r"] == 1 + 10**9 * (n + 5) // (whole + 5 * kept)


def test_empty_table(spark):
    df = G.divergence(spark.createDataFrame([], DOCS))
    assert df.collect() == [] and dict(df.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string",
                                                       "value": "bigint", "rank": "int"}
