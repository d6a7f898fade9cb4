"""Decontamination, Jaccard join, language ID, quality and PII against plain versions and on odd inputs."""

import hashlib
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_MID, SF_SMALL
from wattline.llm import decontaminate as D
from wattline.llm import jaccard_join as J
from wattline.llm import langid as L
from wattline.llm import pii as P
from wattline.llm import quality as Q
from wattline.llm.common import materialise

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(-1, None), (-2, ""), (-3, " \n"), (-4, "a b c"), (-5, "A  b\tc"), (-5, "A  b\tc"), (None, "a b c"), (-6, "!!!"),
       (-7, "z" * 20000)]


def with_odd(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    return table.unionByName(spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], DOCS))


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ------------------------------------------------------------------ 1 decontamination
def hits(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        m = min(10, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            windows[tuple(w[k:k + m])].add(str(i))
    out = []
    for i, t in docs:
        w, hit, met = split(t), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if tuple(w[k:k + m]) in windows:
                    hit |= set(range(k, k + m))
                    met |= windows[tuple(w[k:k + m])]
        out.append((i, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination_matches_brute_force(spark):
    docs = with_odd(spark, SF_MID).select("doc_id", "text", F.lit(1).alias("key"), F.lit(2).alias("n_hit"))
    bench = spark.read.parquet(f"{SF_MID}/benchmark.parquet")
    kind = bench.schema["item_id"].dataType
    extra = spark.createDataFrame([(900, None), (901, "..."), (902, "b c"), (903, "B; C"), (10, "c")], "item_id long, text string")
    items = bench.select("item_id", "text").unionByName(extra.select(F.col("item_id").cast(kind), "text"))
    want = hits([(r["doc_id"], r["text"]) for r in docs.collect()], [tuple(r) for r in items.collect()])
    got = [tuple(r) for r in D.decontaminate(docs, items).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    clean = D.keep_clean(docs, items)
    assert clean.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(r[0]) for r in want if not r[5])


def test_decontamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], DOCS)
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in D.decontaminate(docs, none).collect())
    assert D.keep_clean(docs, none).count() == len(ODD)
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert D.decontaminate(docs.limit(0), items).count() == 0


# ------------------------------------------------------------------ 6 Jaccard join
def plain_sets(rows):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", lower(t))
        out[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def components(sets):
    where, up = defaultdict(list), {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    for i, s in sets.items():
        both = defaultdict(int)
        for g in s:
            for j in where[g]:
                both[j] += 1
        for j, n in both.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_components_match_brute_force(spark, monkeypatch, small):
    if small:  # many buckets, tiles and blocks
        for name in ("TILE_SHINGLES", "BUCKET_ENTRIES", "TASK_SHINGLES"):
            monkeypatch.setattr(J, name, 2000)
        monkeypatch.setattr(J, "PIECE", 64)
    docs = with_odd(spark, SF_MID)
    rows = [(r["doc_id"], r["text"]) for r in docs.filter("doc_id IS NOT NULL").collect()]
    sets = plain_sets(rows)
    want = components(sets)
    got = J.jaccard_join(docs).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        i = -5 if r["doc_id"] is None else r["doc_id"]  # the NULL id has the text of -4 and -5
        assert (r["n_shingles"], r["component_id"]) == (len(sets[i]), want[i])


def test_keep_one_of_each_group(spark):
    docs = with_odd(spark, SF_SMALL).withColumn("component_id", F.lit("own"))
    kept = J.keep_one(docs)
    want = components(plain_sets([(r["doc_id"], r["text"]) for r in docs.filter("doc_id IS NOT NULL").collect()]))
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({i for i, c in want.items() if i == c})
    assert J.keep_one(docs.limit(0)).count() == 0 and J.jaccard_join(docs.limit(0)).count() == 0


def test_keep_one_decides_by_id_and_text(spark):
    near = " ".join(f"n{k}" for k in range(60))
    alone, lost = (" ".join(f"{c}{k}" for k in range(20)) for c in "al")
    rows = [(1, near), (5, near + " more"), (5, alone), (5, alone), (None, lost), (None, lost), (None, lost.upper()), (None, near),
            (None, ""), (None, ""), (6, ""), (6, "")]
    got = [(r["doc_id"], (r["text"] or "").lower()) for r in J.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(1, near), (5, alone), (None, lost), (None, ""), (None, ""), (6, "")], key=str)


def test_buckets_and_repeats_are_counted_in_little_memory():
    """A few integers per shingle at a time, whatever the lists' lengths."""
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 1 << 12, 150).astype(np.uint64)) for _ in range(2000)]
    sets += [np.unique(rng.integers(1 << 12, 1 << 31, 150).astype(np.uint64)) for _ in range(500)] * 2
    sig, sizes = np.arange(len(sets), dtype=np.int64) * 7 - 900, np.array([len(s) for s in sets])
    group = pd.DataFrame([(0, np.concatenate(sets).astype(np.uint32).tobytes(), sig.tobytes(), sizes.astype(np.uint32).tobytes(),
                           sizes.astype(np.uint16).tobytes())], columns=["bucket", "codes", "sigs", "sizes", "repeat"])
    tracemalloc.start()
    try:
        edges = J._candidates(group)
        bucket = tracemalloc.get_traced_memory()[1] / sizes.sum()
    finally:
        tracemalloc.stop()
    assert bucket < 60
    copies = {(sig[k], sig[k + 500]) for k in range(2000, 2500)}
    assert copies <= set(edges[["a", "b"]].itertuples(index=False, name=None)) and len(edges[edges["need"] == 0]) == 1999
    codes, counts = np.unique(np.concatenate(sets), return_counts=True)
    got, n = J._repeats(sets)
    assert (got == codes[counts > 1]).all() and (n == counts[counts > 1]).all() and not sets


def test_large_components_are_bounded_again_before_the_search(spark, monkeypatch):
    """Passages in many texts chain them to one component; its sets meet in parts, not by all pairs of its blocks."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    monkeypatch.setattr(J, "long_lists", lambda repeats: none)  # as with more frequent shingles than the table holds
    monkeypatch.setattr(J, "TILE_SHINGLES", 1000)
    seen = {}

    def kept(df, name, **options):
        seen.setdefault(name, []).append(got := materialise(df, name, **options))
        return got
    monkeypatch.setattr(J, "materialise", kept)
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(k, f"{' '.join(f'w{k % 120}x{j}' for j in range(60))} {passage} end{k}") for k in range(240)]
    want = components(plain_sets(rows))
    got = J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(set(want.values())) == 120
    first, *_, last = (t.groupBy("label").count().agg(F.max("count")).first()[0] for t in seen["jaccard-reps"])
    assert first == 240 and last == 2
    assert seen["jaccard-placed"][0].agg(F.sum(F.size("tiles"))).first()[0] == 240


def test_halves_of_shingles_never_lessen_an_overlap():
    a, b = (np.array([k << 32 | low for k, low in x], dtype=np.uint64) for x in (
        [(1, 5), (2, 5), (3, 5), (1, 9)], [(2, 5), (3, 5), (4, 7), (1, 9)]))
    x, y = (J._told_apart(s.astype(np.uint32)) for s in (a, b))
    assert len(set(x.tolist())) == len(a) and len(set(y.tolist())) == len(b)
    assert len(np.intersect1d(x, y)) >= len(np.intersect1d(a, b)) == 3


def test_a_family_of_near_copies_gives_few_edges_a_bucket():
    """Twelve copies are connected by eleven edges, not counted as 66 pairs."""
    codes = np.arange(40, dtype=np.uint32)
    group = pd.DataFrame([(0, codes.tobytes(), np.int64(k).tobytes(), np.uint32(900).tobytes(), np.uint16(40).tobytes(),
                           np.uint32(7 << 16 | k).tobytes()) for k in range(12)],
                         columns=["bucket", "codes", "sigs", "sizes", "repeat", "marks"])
    edges = J._candidates(group)
    assert len(edges) == 11 and set(edges["a"]) | set(edges["b"]) == set(range(12))
    s = np.sort(np.random.default_rng(5).integers(0, 1 << 64, 400, dtype=np.uint64))
    near, far = J.alike(s) ^ J.alike(np.delete(s, 9)), J.alike(s) ^ J.alike(s[::3])
    assert (near >> 16 == 0 or near & 65535 == 0) and far >> 16 and far & 65535


def test_search_finds_all_links_of_random_sets():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 62, (12, 60), dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(60) < rng.choice([0.0, 0.1, 0.25]), rng.integers(0, 1 << 62, 60, dtype=np.uint64), base[k % 12]))
            for k in range(150)]
    want = components({i: set(s.tolist()) for i, s in enumerate(sets)})
    up = list(range(len(sets)))
    for a, b in J.t_occurrence(sets):
        assert 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))
        a, b = J.Forest.find(f := type("F", (), {"up": up})(), a), J.Forest.find(f, b)
        up[max(a, b)] = min(a, b)
    assert {i: J.Forest.find(type("F", (), {"up": up})(), i) for i in range(len(sets))} == want


# ------------------------------------------------------------------ 4 language
def test_language_accuracy_on_the_held_out_fold(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    got = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 100 and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_never_reads_the_label_of_the_predicted_row(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    held = L.fold(F.col("doc_id")) == 2
    a = L.identify(docs)
    b = L.identify(docs.withColumn("lang", F.when(~held, F.col("lang"))).withColumn("source", F.lit(None).cast("string")))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_language_of_odd_rows(spark):
    docs = with_odd(spark, SF_SMALL).withColumn("score", F.lit("own"))
    got = {r["doc_id"]: r for r in L.identify(docs).collect()}
    for i in (-1, -2, -3, -6):
        assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id IN (-1, -2, -3, -6)").count() == 0
    assert kept.filter("doc_id >= 0").count() == docs.filter("doc_id >= 0").count()
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in L.identify(unlabelled).collect()} == {"und"}
    assert L.identify(docs.limit(0)).count() == 0


def test_ranked_orders_by_count_then_code():
    codes, counts = np.arange(6), np.array([3, 5, 5, 1, 3, 3])
    assert L.ranked(codes, counts, 4).tolist() == [1, 2, 0, 4]
    assert L.ranked(codes, counts, 10).tolist() == [1, 2, 0, 4, 5, 3]


# ------------------------------------------------------------------ 7 quality
def test_quality_agrees_with_labels_and_keeps_good_documents(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet")
    got = Q.classify(docs).join(labels, "doc_id").collect()
    good = [r for r in got if r["quality"] == 1]
    bad = [r for r in got if r["quality"] == 0]
    assert sum(r["kept"] for r in good) / len(good) >= 0.98
    assert sum(r["kept"] for r in bad) / len(bad) <= 0.5


def test_quality_of_odd_rows(spark):
    docs = with_odd(spark, SF_SMALL)
    got = {r["doc_id"]: r for r in Q.classify(docs).collect()}
    for i in (-1, -2, -3):
        assert got[i]["score"] == 0 and not got[i]["kept"]
    assert Q.classify(docs.limit(0)).count() == 0


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(7)
    truth = rng.random(20000) < 0.7
    accuracy = [0.95, 0.8, 0.7, 0.6]
    rows = np.stack([np.where(rng.random(20000) < 0.3, -1, np.where(rng.random(20000) < a, truth, ~truth)) for a in accuracy], 1)
    patterns, counts = np.unique(rows, axis=0, return_counts=True)
    model = Q.fit_label_model(patterns, counts.astype(float))
    assert model.accuracy == pytest.approx(accuracy, abs=0.06) and model.good == pytest.approx(0.7, abs=0.06)


# ------------------------------------------------------------------ 8 personal data
def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m))
    return [f"{k}:{m.start()}:{m.end()}" for k, m in out]


TRICKY = ["a@b.c_d@e.f x@y é@z.q a.b@c.d. @e.f g@-.h", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4 1.2.3.256 9.9.9.0000000255",
          "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111111 41111111111111112 4111  1111", "é😀 +1 (555) 123-4567. +12 +1.2.3.4.5.6.7.8 ++44 20 7946 0958",
          "9" * 9000 + "a" * 9000 + "@", "a" * 5000 + "@b.c", "1-" * 4000 + "1", None, ""]


def test_pii_matches_plain_patterns(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text").unionByName(
        spark.createDataFrame([(-k, t) for k, t in enumerate(TRICKY, 1)], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in P.pii_digest(docs).collect()}
    for r in docs.collect():
        want, row = base_spans(r["text"] or ""), got[r["doc_id"]]
        assert row["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), r["doc_id"]
        assert [s for s in row["spans"].split(",") if s and not s.startswith("iban")] == want
        for kind in P.BASE_KINDS:
            assert row[f"n_{kind}"] == sum(s.startswith(kind) for s in want)


@pytest.mark.parametrize("text, at", [
    ("IBAN DE89370400440532013000 BIC COBADEFF", (5, 27)), ("GB82 WEST 1234 5698 7654 32 PLEASE PAY", (0, 27)),
    ("x NO9386011117947, NO", (2, 17)), ("DE8937040044053201300", None), ("DE893704004405320130000", None),
    ("ZZ89370400440532013000", None), ("DE88370400440532013000 A", None), ("MT84MALT011000012345MTLCAST001S", (0, 31))])
def test_iban_ends_at_its_country_length(spark, text, at):
    got = P.find_pii(spark.createDataFrame([(text,)], "text string")).first()["pii"]
    assert [(s["start"], s["stop"]) for s in got if s["kind"] == "iban"] == ([at] if at else [])


def test_iban_checksum_context_score_and_columns(spark):
    docs = spark.createDataFrame([(1, "my iban DE89 3704 0044 0532 0130 00 ok", "own"), (2, "GB82WEST12345698765432", "own"),
                                  (3, "GB82WEST12345698765433", "own"), (4, "call +1 555 123 4567", "own"),
                                  (5, "+1 555 123 4567", "own")], "doc_id long, text string, pii string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["stop"], s["score"]) for s in r["pii"]] for r in P.find_pii(docs).collect()}
    assert got[1] == [("iban", 8, 35, 1.0)] and got[2] == [("iban", 0, 22, 0.9)] and got[3] == []
    assert got[4][0][3] > got[5][0][3]
    assert P.find_pii(docs).columns == docs.columns and P.pii_digest(docs.limit(0)).count() == 0
