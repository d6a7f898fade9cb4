"""Registered queries of the corpus operators and, where SQL can say it, their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm import decontaminate as D1
from wattline.llm import divergence as G11
from wattline.llm import exact_dedup as D5
from wattline.llm import html_text as H2
from wattline.llm import jaccard_join as J6
from wattline.llm import langid as L4
from wattline.llm import merkle as K13
from wattline.llm import mixing as M9
from wattline.llm import pii as P8
from wattline.llm import quality as Q7
from wattline.llm import sharding as S3
from wattline.llm import token_ids as T12
from wattline.llm import warc as W10
from wattline.llm.common import table
from wattline.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f
    return put


# ------------------------------------------------------------------ 5 exact dedup
@register("op5_exact_dedup", r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS s FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(s) AS text_sha256
FROM t WINDOW w AS (PARTITION BY s)""")
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D5.exact_dedup(table(spark, sf_dir, "documents"))


# ------------------------------------------------------------------ 8 personal data
@register("op8_pii")
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P8.pii_digest(table(spark, sf_dir, "documents"))


# ------------------------------------------------------------------ 9 mixing
@register("op9_mixing")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M9.mix(table(spark, sf_dir, "documents"))


# ------------------------------------------------------------------ 3 sharding
@register("op3_sharding")
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S3.shard(table(spark, sf_dir, "documents"))


# ------------------------------------------------------------------ 10 WARC
@register("op10_warc", """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b FROM pages),
f AS (SELECT *, octet_length(b) AS n, min(page_id) OVER (PARTITION BY b) AS first_id FROM p)
SELECT page_id, n AS payload_bytes, sha256(b) AS payload_digest,
       CASE WHEN n >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first_id <> page_id THEN first_id END AS refers_to, url FROM f""")
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W10.round_trip(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))


# ------------------------------------------------------------------ 4 language id
@register("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L4.identify(table(spark, sf_dir, "documents"))


# ------------------------------------------------------------------ 2 html extraction
@register("op2_html_text")
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H2.extract(table(spark, sf_dir, "pages"))


# ------------------------------------------------------------------ 1 decontamination
_WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@register("op1_decontaminate", f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS_SQL} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS c
  FROM (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
spot AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m),
hit AS (SELECT spot.doc_id, i, spot.m, item_id FROM spot JOIN win ON win.m = spot.m AND c = array_to_string(spot.w[i:i + spot.m - 1], ' ')),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY 1),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN ids USING (doc_id)""")
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D1.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# ------------------------------------------------------------------ 6 Jaccard join
@register("op6_jaccard_join")
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J6.jaccard_join(table(spark, sf_dir, "documents"))


# ------------------------------------------------------------------ 7 quality
@register("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q7.classify(table(spark, sf_dir, "documents"))


# ------------------------------------------------------------------ 11 source divergence
def _rate_sql(n: str, whole: str, kept: str) -> str:
    return f"1 + CAST(CAST(1000000000 AS HUGEINT) * ({n} + 5) // ({whole} + 5 * {kept}) AS BIGINT)"


@register("op11_divergence", f"""
WITH t AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT rid, lang, source, unnest(w) AS term FROM t),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY ALL HAVING count(DISTINCT rid) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN (SELECT lang, term FROM k) USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(n) AS whole FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(s.whole, 0) AS whole FROM (SELECT DISTINCT lang, source FROM t)
  LEFT JOIN l USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS whole FROM c GROUP BY ALL) s USING (lang, source)),
r AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_rate_sql('coalesce(c.n, 0)', 'g.whole', 'l.v')} AS p,
  {_rate_sql('k.n', 'l.whole', 'l.v')} AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
d AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM r a JOIN r b
  ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN d ON d.lang = g.lang AND d.source = g.source AND d.item = h.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM r WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u
QUALIFY part = 'pair' OR rank <= 50""")
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G11.divergence(table(spark, sf_dir, "documents"))


# ------------------------------------------------------------------ 12 token ids
@register("op12_token_ids")
def op12_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return T12.token_files(table(spark, sf_dir, "documents"), scratch_path(spark, "tokens"),
                           public_tokenizers.path("word_bpe_49k.json"))


# ------------------------------------------------------------------ 13 Merkle manifest
def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(
        f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _fold_sql(name: str, flanks: str, start: str) -> str:
    return f"""{name} AS ({start} UNION ALL
  SELECT rid, tree, l + 1, pos // 3, sha256(lefts || cur || rights), proof || lefts || rights FROM {name} JOIN {flanks} USING (l, tree, pos))"""


def _levels_sql(name: str, start: str) -> str:
    """Levels of trees, and of all nodes but roots what flanks them."""
    return f"""{name} AS ({start} UNION ALL SELECT l + 1, tree, pos // 3, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM {name}) WHERE c > 1 GROUP BY l, tree, pos // 3),
{name}_root AS (SELECT tree, arg_max(h, l) AS h, max(l) AS height FROM {name} GROUP BY tree),
{name}_flank AS (SELECT l, tree, pos, coalesce(lag(h, 2) OVER w, '') || coalesce(lag(h) OVER w, '') AS lefts,
  coalesce(lead(h) OVER w, '') || coalesce(lead(h, 2) OVER w, '') AS rights FROM {name} JOIN (SELECT tree, height FROM {name}_root) USING (tree)
  WHERE l < height WINDOW w AS (PARTITION BY l, tree, pos // 3 ORDER BY pos))"""


#: The checksum's register after all bits of the decimal id, lowest bit of a byte first; its last bit is the
#: complement of the checksum's.
_CRC_SQL = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
  lambda ch: list_transform(range(8), lambda k: (ascii(ch) >> CAST(k AS INTEGER)) & 1)))),
  lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END))"""


@register("op13_merkle", f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '') AS tree, {_leaf_sql("text")} AS leaf,
  CASE WHEN {_CRC_SQL} & 1 = 1 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS altered FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
{_levels_sql("n", "SELECT 0 AS l, tree, pos, leaf AS h FROM p")},
s AS (SELECT tree AS name, h, row_number() OVER (ORDER BY tree) - 1 AS pos FROM n_root),
{_levels_sql("t", "SELECT 0 AS l, '' AS tree, pos, h FROM s")},
{_fold_sql("f", "n_flank", "SELECT rid, tree, 0 AS l, pos, altered AS cur, '' AS proof FROM p")},
up AS (SELECT f.*, s.pos AS place, s.h AS subroot FROM f JOIN n_root ON n_root.tree = f.tree AND height = l JOIN s ON name = f.tree),
{_fold_sql("g", "t_flank", "SELECT rid, '' AS tree, 0 AS l, place AS pos, cur, proof FROM up")}
SELECT d.doc_id, d.leaf, up.subroot, t_root.h AS root, sha256(g.proof) AS proof_sha256, g.cur AS folded_root, g.cur = t_root.h AS verified
FROM d JOIN up USING (rid) JOIN g USING (rid) JOIN t_root ON t_root.height = g.l""")
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K13.audit(table(spark, sf_dir, "documents"))
