"""HTML extraction and WARC assembly: markup cases, host repetition, exact round trips, odd inputs."""

import hashlib
import html
import re
from collections import defaultdict

import numpy as np
import pytest

from tests.conftest import SF_MID
from wattline.llm import html_text as H
from wattline.llm import warc as W
from wattline.session import scratch_path

PAGES = "page_id long, url string, html string"


def test_article_text_matches_a_plain_reading(spark):
    pages = spark.read.parquet(f"{SF_MID}/pages.parquet")
    got = {r["page_id"]: r for r in H.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", x))).split())
                 for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(x for x in parts if x)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


CASES = {
    "<article><h1>T &lt;b&gt;</h1><p>One\n two<p>three<ul><li>x<li>y</ul></article>": ["T <b>", "One two", "three", "x", "y"],
    "<header>site</header><main><header><h1>T</h1></header><p>a<script>if(a<b){}</script> b</p><aside>s</aside></main>": ["T", "a b"],
    "<article><p>keep</p><div class='comments'><p>reader</p></div><form>f<input></form></article><p>after</p>": ["keep"],
    "<article><p>caf&eacute; &#233;&amp;&nbsp;x<!-- no --><b>bo</b>ld</p><style>p{}</style></article>": ["café é& xbold"],
    "<div id=cookie-notice>We use cookies</div><div class='post-content'><p>body</p></div><div class=sidebar>s</div>": ["body"],
    "<p>no container</p><nav>menu</nav><footer>f</footer>": ["no container"],
    "<article><p>cut off &am": ["cut off &am"],
    "<article><table><tr><td>a<td>b<tr><td>c</table>d<br>e</article>": ["a", "b", "c", "d e"],
    "<article><div hidden>x</div><p title='a > b'>y</p></article>": ["y"],
    "": [], "plain words": ["plain words"], "<article></article>": [], "a < b <": ["a < b <"],
}


@pytest.mark.parametrize("page", CASES)
def test_blocks_of_markup_cases(page):
    found = H.blocks(page)
    assert [t for v, t in found if v != H.DROPPED] == CASES[page]


@pytest.mark.parametrize("page, kept", [
    ("<div><p>story</p></div><article class=comment>reader</article>", ["story"]),
    ("<p>story</p><article class='related teaser'>other</article><article id=comment-7>reader</article>", ["story"]),
    ("<article><p>story</p><article class='user-comment'>reader</article></article>", ["story"]),
    ("<main><article>story</article><article class=comment>reader</article></main><p>after</p>", ["story"]),
    ("<article class='post category-social tag-share no-comments'>story</article><p>after</p>", ["story"]),
    ("<p>story</p><article></article><main> </main>", ["story"])])
def test_articles_marked_as_furniture_go_and_decide_nothing(page, kept):
    assert [t for v, t in H.blocks(page) if v != H.DROPPED] == kept


@pytest.mark.parametrize("page, kept", [
    *[(f"<div {w}><article><p>story</p></article></div><p>after</p>", ["story"]) for w in (
        'class="site has-sidebar"', 'class="layout with-sidebar"', 'class="app modal-open"', 'id="search-page-wrap"')],
    ("<div class='site has-sidebar'><main>story</main><aside>a</aside></div>", ["story"]),
    ("<div class='app modal-open'><main>story</main><div class=comments><article>reader</article></div></div>", ["story"]),
    ("<article>story</article><div class=comments><article>reader</article></div>", ["story"]),
    ("<nav><article>teaser</article></nav><p>story</p>", ["story"]),
    ("<div class='site has-sidebar'><p>story</p></div>", ["story"]),
    ("<article><div class='entry-header'><h1>T</h1></div><p>story</p></article>", ["T", "story"]),
    ("<article><p>story<button>Share this page</button></p><select><option>x</select></article>", ["story"]),
    ("<article><video>no video</video><p>a<span hidden>x</span> b <span class='ad'>buy</span>c</p></article>", ["a b c"]),
    ("<article><p>a<i style='color:red; display: none'>x</i></p><p style='visibility:hidden'>y</p><b>c</b></article>", ["a", "c"]),
    ("<p>a <span hidden>x <b>y</b></p><p>z</p>", ["a", "z"])])
def test_wrappers_and_inline_furniture(page, kept):
    assert [t for v, t in H.blocks(page) if v != H.DROPPED] == kept


@pytest.mark.parametrize("tag", ['div style="overflow:hidden"', 'p title="The hidden valley"', "div data-hidden", 'p alt=" hidden "'])
def test_words_inside_other_attributes_hide_nothing(tag):
    assert H.blocks(f"<{tag}>text</{tag.split()[0]}>") == [(H.OPEN, "text")]


@pytest.mark.parametrize("tag, verdict", [
    ('div id="comments" style="width:9px"', H.DROPPED), ('div class="sidebar" data-class="x"', H.DROPPED),
    ("div data-class=x CLASS='sidebar'", H.DROPPED), ("div class=sidebar class=x", H.DROPPED), ('div id = "main" data-video="9"', H.KEPT),
    ("div id=main data-video=9 hidden", H.DROPPED), ("div hidden class=main", H.DROPPED), ('div aria-hidden="true"', H.DROPPED)])
def test_attributes_are_whole_names_and_the_first_counts(tag, verdict):
    assert H.blocks(f"<{tag}>text</div>") == [(verdict, "text")]


def test_long_inputs_parse_in_linear_steps():
    H.blocks("<" * 20000)
    H.blocks("<p>" * 20000 + "x")
    H.blocks("<b>" * 50000 + "</i>" * 50000)
    H.blocks("<div>" * 50000 + "x")
    assert H.blocks("x" + "<a " * 50000)[0][1].startswith("x<a")
    assert [t for _, t in H.blocks("<p>x</p>y<!-- " + "<a " * 50000)] == ["x", "y"]
    assert H.blocks("<article>" + "w " * 200000 + "</article>")[0][1].count("w") == 200000


def test_suffix_array_and_repeats_match_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        codes = rng.integers(0, 3, 60)
        assert H.suffix_array(codes).tolist() == sorted(range(60), key=lambda i: codes[i:].tolist())
        page = np.repeat([0, 1, 2], 20)
        full = codes.astype(np.int64)
        full[[19, 39, 59]] = [-1, -2, -3]
        where = defaultdict(set)
        for i in range(57):
            where[tuple(full[i:i + 4])].add(page[i])
        want = np.zeros(60, dtype=bool)
        for i in range(57):
            if len(where[tuple(full[i:i + 4])]) > 1:
                want[i:i + 4] = True
        assert H.repeated(full, page, 4).tolist() == want.tolist()


def test_undecided_blocks_go_if_they_repeat_on_distinct_pages(spark):
    same = "<div class=x1>Welcome to our little shop, buy now and save money today</div>"
    rows = [(i, f"https://h.example/{i}", f"{same}<div class=x2>story number {i} " + " ".join(f"w{i}x{k}" for k in range(9)) + "</div>")
            for i in range(6)]
    rows += [(10, "https://h.example/copy", rows[0][2]), (11, "https://other.example/", same)]
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[3].startswith("story number 3") and "\n" not in got[3]
    assert got[10] == got[0] != ""
    assert got[11].startswith("Welcome")  # on its host it is unique


def test_copies_count_once_however_pages_are_grouped(spark):
    news, story = "<h2>News</h2>", "<p>" + " ".join(f"s{k}" for k in range(12)) + "</p>"
    def page(i, head):
        return head + "<p>" + " ".join(f"w{i}x{k}" for k in range(12)) + "</p>"
    rows = [(i, f"http://h/{i}", news + story) for i in range(12)] + [(20, "http://h/20", page(20, news))]
    rows += [(i, f"http://h/{i}", page(i, "")) for i in range(30, 34)]
    results = [sorted((r["page_id"], r["text"]) for r in H.extract(spark.createDataFrame(rows, PAGES), group_pages=g).collect()) for g in (512, 5, 1)]
    assert results[0] == results[1] == results[2]
    assert sum(t.startswith("News\n") for _, t in results[0]) == 13


def test_random_hosts_give_the_same_text_for_every_group_size(spark):
    rng = np.random.default_rng(8)
    pool = [f"<{t}>" + " ".join(f"v{w}" for w in rng.integers(0, 9, n)) + f"</{t}>" for t, n in
            [("h2", 1), ("h2", 2), ("p", 2), ("p", 8), ("p", 9), ("div", 14), ("p", 20), ("li", 3)] * 2]
    rows = []
    for i in range(60):
        page = "".join(pool[k] for k in rng.integers(0, len(pool), rng.integers(0, 5))) + (f"<p>own {i} " + "x " * 9 if rng.random() < 0.5 else "")
        rows += [(len(rows) + k, f"http://{'abc'[i % 3]}/", page) for k in range(1 + (i % 11 == 0) * 3)]
    results = [sorted((r["page_id"], r["text"]) for r in H.extract(spark.createDataFrame(rows, PAGES), group_pages=g).collect()) for g in (512, 7, 2)]
    assert results[0] == results[1] == results[2]
    assert len({t for _, t in results[0]}) > 10


def test_extract_odd_rows(spark):
    rows = [(1, None, None), (1, None, None), (None, "not a url", ""), (2, "http://h/", "<p>x")]
    got = H.extract(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "", 0), (1, "", 0), (1, "", 0), (2, "x", 1)]
    assert H.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_a_large_host_is_many_groups_with_the_same_result(spark):
    pages = spark.read.parquet(f"{SF_MID}/pages.parquet")
    whole = sorted((r["page_id"], r["text"]) for r in H.extract(pages).collect())
    assert whole == sorted((r["page_id"], r["text"]) for r in H.extract(pages, group_pages=8).collect())


def own(i, n=12):
    return " ".join(f"w{i}x{k}" for k in range(n))


def test_undecided_repeats_go_whatever_the_size_of_groups(spark):
    notice = "please read our terms of use before you order here"
    rows = [(i, f"https://h.example/{i}", f"<div>{own(i)}</div>" + (f"<div>{notice}</div><div>Read more</div>" if i in (3, 71) else ""))
            for i in range(80)]
    pages = spark.createDataFrame(rows, PAGES)
    for size in (512, 8, 1):
        got = {r["page_id"]: r["text"] for r in H.extract(pages, group_pages=size).collect()}
        assert got == {i: own(i) for i in range(80)}


@pytest.mark.parametrize("size", [512, 1])
def test_repeats_are_cut_out_and_unique_text_and_headings_stay(spark, size):
    phrase = "sign up to our weekly letter and never miss a story"
    rows = [(i, f"https://h.example/{i}", f"<h1>My Site</h1><div>{phrase} {own(i, 5)}</div>"
             + ("<h2>Introduction</h2>" if i < 2 else "") + f"<p>{own(100 + i)}</p>") for i in range(6)]
    got = {r["page_id"]: r["text"].split("\n") for r in H.extract(spark.createDataFrame(rows, PAGES), group_pages=size).collect()}
    assert got == {i: [own(i, 5)] + ["Introduction"] * (i < 2) + [own(100 + i)] for i in range(6)}


@pytest.mark.parametrize("size", [512, 1])
def test_copies_with_other_furniture_keep_their_text(spark, size):
    rows = [(i, f"https://h.example/{i}", f"<nav>{own(50 + i)}</nav><p>{own(1)}</p><p>{own(2)}</p>") for i in range(3)]
    got = H.extract(spark.createDataFrame(rows, PAGES), group_pages=size).collect()
    assert {r["text"] for r in got} == {own(1) + "\n" + own(2)}


BODY = "<html>" + "é&\r\n\r\nWARC/1.1\r\n" * 20 + "</html>"
ROWS = [(5, "http://a/", BODY), (3, "http://b/", BODY), (9, None, BODY), (1, "http://a/", "small"), (2, "http://a/", "small"),
        (4, "http://x/\r\ny", None), (6, "http://a/", ""), (7, "http://a/", "z" * 100), (8, "http://a/", "z" * 99)]


def test_warc_round_trip(spark):
    got = {r["page_id"]: r for r in W.round_trip(spark.createDataFrame(ROWS, PAGES), scratch_path(spark, "t")).collect()}
    assert len(got) == len(ROWS)
    for page, _, body in ROWS:
        data, r = (body or "").encode(), got[page]
        equal = [p for p, _, b in ROWS if (b or "").encode() == data]
        first = min(equal)
        again = len(data) >= 100 and first != page
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", first) if again else ("response", None))


def test_warc_files_follow_the_format(spark):
    path = scratch_path(spark, "t")
    W.write_archives(spark.createDataFrame(ROWS, PAGES).coalesce(1), path)
    content = b"".join(bytes(r["content"]) for r in spark.read.format("binaryFile").load(path).collect())
    records = list(W._parse(W._chunks(content)))
    assert len(records) == 3 * len(ROWS)
    assert all({"warc-type", "warc-record-id", "warc-date", "content-length"} <= set(f) for f, _ in records)
    with pytest.raises(ValueError):
        list(W._parse([b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab"]))


def test_assembly_nests_a_capture_and_drops_strays(spark):
    rows = [("response", "r1", None, None, "u", "d", 3, None), ("request", "q1", "r1", None, "u", None, None, None),
            ("metadata", "m1", "r1", None, "u", None, None, "page-id: 7\r\n"), ("response", "r2", None, None, "u", "d", 3, None),
            ("request", "q9", "gone", None, "u", None, None, None), ("revisit", "r3", None, "r1", "u", "d", None, None)]
    got = {r["capture_id"]: r for r in W.assemble(spark.createDataFrame(rows, W.RECORD)).collect()}
    assert set(got) == {"r1", "r2", "r3"}
    assert got["r1"]["page_id"] == 7 and got["r1"]["request"]["record_id"] == "q1"
    assert got["r2"]["request"] is None and got["r3"]["origin"]["page_id"] == 7


def test_warc_odd_inputs(spark):
    rows = [(1, "u", "x" * 200), (1, "u", "x" * 200), (None, "u", "x" * 200), (2, "u", "y")]
    got = W.round_trip(spark.createDataFrame(rows, PAGES), scratch_path(spark, "t")).collect()
    assert {r["page_id"] for r in got} == {1, None, 2}
    assert W.round_trip(spark.createDataFrame([], PAGES), scratch_path(spark, "t")).count() == 0


def test_repeated_pages_come_out_as_often_as_they_went_in(spark):
    rows = [(1, "u", "x" * 200)] * 3 + [(None, "u", "x" * 200)] * 2 + [(2, "u", "y"), (3, "v", "x" * 200)]
    got = W.round_trip(spark.createDataFrame(rows, PAGES), scratch_path(spark, "t")).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got) == sorted(
        [(1, "response", None)] * 3 + [(0, "revisit", 1)] * 2 + [(2, "response", None), (3, "revisit", 1)])
