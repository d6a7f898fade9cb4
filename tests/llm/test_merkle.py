"""The Merkle manifest against plain trees, and on odd inputs."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from wattline.llm import merkle as M
from wattline.llm.common import ranked

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(r, text):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}"
                          for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def levels(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i:i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, i):
    out = []
    for level in tree[:-1]:
        first = i // 3 * 3
        out.append(("".join(level[first:i]), "".join(level[i + 1:first + 3])))
        i //= 3
    return out


def plain(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    order = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in order:
        by[k].sort(key=lambda t: t[:3])
        trees[k] = levels([t[2] for t in by[k]])
    top = levels([trees[k][-1][0] for k in order])
    out = []
    for at, k in enumerate(order):
        for i, (_, _, own, r) in enumerate(by[k]):
            path = siblings(trees[k], i) + siblings(top, at)
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf(r, text)
            for left, right in path:
                node = digest(left + node + right)
            root = top[-1][0]
            out.append((r["doc_id"], own, trees[k][-1][0], root, digest("".join(a + b for a, b in path)), node, node == root))
    return out


def same(df, want):
    def key(t):
        return tuple(map(str, t))
    return sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key)


ODD = [(None, None, None, None, None), (None, "q", None, "z", None), (1, "a\nb", "x", None, 3), (2, "", "x", "", 0),
       (2, "", "x", "", 0), (2, "\n", "x", "", 0), (5, "é\n" * 9, None, "é", 9), (7, "word\n" * 50_000, "en", "é", -1)]


@pytest.mark.parametrize("step", [1, 5])
def test_whole_table_matches_plain_trees(spark, step):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert same(M.audit(docs, step), plain(docs.collect()))


def test_odd_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    want = plain(docs.collect())
    assert same(M.audit(docs), want)
    more = docs.withColumns({c: F.lit(1) for c in ("tree", "pos", "size", "hash", "path", "altered", "row", "leaf", "root", "_at")})
    assert same(M.audit(more), want)


def test_empty_table_and_single_row(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    assert M.audit(docs.limit(0)).collect() == []
    only = M.audit(docs.filter("doc_id = 1")).first()
    assert only["leaf"] == only["subroot"] == only["root"] and only["proof_sha256"] == digest("")


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 40), min_size=1, max_size=5), st.integers(1, 3))
def test_trees_of_any_size(spark, sizes, step):
    rows = [(i, f"t{i}", None, f"s{k}", i) for k, n in enumerate(sizes) for i in range(n)]
    if rows:
        docs = spark.createDataFrame(rows, DOCS)
        assert same(M.audit(docs, step), plain(docs.collect()))


def test_any_change_but_line_feeds_of_odd_rows_is_found(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = M.manifest(docs, F.concat("text", F.lit("."))).select("root", M.fold(F.col("altered"), F.col("path")).alias("folded"))
    assert got.filter("folded = root").count() == 0
    assert M.manifest(docs).filter(M.fold(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0


def test_ranks_run_through_partitions_and_keys(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("k"), F.lit(0).alias("same"), F.col("id").alias("row"))
    rows = rows.unionAll(spark.range(5000, 9000).select(F.lit(9).alias("k"), F.lit(0), F.col("id")))
    got = ranked(rows, ["k"], ["same", "row"], "t-ranked").collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r["row"]):
        by[r["k"]].append(r)
    for k in by.values():
        assert [r["pos"] for r in k] == list(range(len(k))) and {r["size"] for r in k} == {len(k)}
