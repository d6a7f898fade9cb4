"""Main text of web pages: host suffix arrays over page blocks (operator 2).

Pages are parsed into blocks.  The markup says of many blocks whether they
belong to the article; the others are decided by repetition: per host, the
token streams of the pages' blocks are concatenated, a suffix array finds
the long substrings that repeat across distinct pages.  Blocks that these
mostly cover lose the repeats; what is unique in them stays.  A host of many
pages has many suffix arrays; they exchange hashes of what they hold, so all
cut the same repeats.

Repetition alone can't decide every block: an article copied to a second
page would vanish and an advert shown once would stay.  So blocks inside an
article or main container are kept and blocks in a container of page
furniture go, whatever their repetition.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import join_groups, materialise
from wattline.llm.jaccard_join import _mix

#: A repeated substring must have at least this many tokens, or be a whole block.
LEAST_TOKENS = 6
#: Share of a block's tokens in repeated substrings from which these are cut out.
COVERED = 0.5
#: Pages whose token streams meet in one suffix array; larger hosts are cut into groups of about this size.
GROUP_PAGES = 512

# Names of HTML elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset("script style noscript template svg math iframe object canvas audio video select option textarea "
                 "button head title".split())
FURNITURE = frozenset("nav header footer aside form menu dialog fieldset".split())
MAIN = frozenset("article main".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
                  "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p "
                  "pre section summary table tbody td tfoot th thead tr ul".split())
#: Words in a container's class, id or role that mark page furniture.
FURNITURE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promo(?:tion)?|banners?|nav(?:bar|igation)?|"
    r"menus?|breadcrumbs?|sidebars?|footer|header|masthead|cookies?|consent|gdpr|notices?|popup|modal|overlay|"
    r"newsletter|subscribe|signup|login|share|sharing|social|comments?|commentlist|respond|replies|disqus|related|"
    r"recommended|widgets?|pagination|pager|toolbar|skip|search|complementary|contentinfo|alert|dialog)(?=$|[\s_-])", re.I)
MAIN_WORDS = re.compile(r"(?:^|[\s_-])(?:article(?:-?body)?|post-?(?:body|content)|entry-?content|main(?:-?content)?|"
                        r"story(?:-?body)?|content)(?=$|[\s_-])", re.I)
#: Class tokens that say what an article is about or lacks, not what it is.
ABOUT = re.compile(r"(?:^|(?<=\s))(?:category|tag|topic|section|author|status|format|type|has|no|with|without)[_-]\S*", re.I)
#: Tokens of the same sort on other containers.
LACKS = re.compile(r"(?:^|(?<=\s))(?:has|no|with|without)[_-]\S*", re.I)
#: Inside of an article, a container named like the header element is treated like it.
HEADER = re.compile(r"(?:^|(?<=[\s_-]))header(?=$|[\s_-])", re.I)
HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|"
                 r"<[!?][^>]*(?:>|\Z)", re.S)
CUT = re.compile(r"<!.*\Z", re.S)
#: One whole ``name[=value]`` of a tag; values are consumed with their names, so no name is found inside one.
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>|\Z", re.I) for t in ("script", "style", "textarea", "title", "noscript",
                                                                       "template", "iframe", "svg")}
#: Elements whose end tag may be left out: a new one of these closes an open one.
CLOSES = {"p": BLOCK, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}),
          "tr": frozenset({"tr", "tbody", "tfoot"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}),
          "option": frozenset({"option"})}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: HEADING is OPEN too, inside of h1 to h6.
KEPT, DROPPED, OPEN, HEADING = 1, 0, 2, 3
#: While a page is read: -n is inside of n containers with furniture words; NESTED + n is an article or main container there.
NESTED = 10


def attributes_of(tag: str) -> dict[str, str]:
    """Attributes by lower-case name, without the quotes around values; of repeated names the first one counts."""
    out: dict[str, str] = {}
    for a in ATTRIBUTE.finditer(tag):
        value = a[2] or ""
        out.setdefault(a[1].lower(), value[1:-1] if value[:1] in ('"', "'") else value)
    return out


def blocks(page: str | None) -> list[tuple[int, str]]:
    """Visible blocks of a page in order, each with KEPT, DROPPED, OPEN or HEADING (undecided) by its containers.

    White space inside a block is one space.  If the page has an article or
    main container that holds text, what stands outside of it is page
    furniture.  An article marked as furniture (a comment, a related teaser)
    is no such container.  A container that only its class or id names as
    furniture may be a wrapper (``has-sidebar``, ``modal-open``), so an
    article or main element inside of it counts, unless one with text stands
    in fewer such containers.  Text of dropped inline elements is left out of
    the block around it.
    """
    out: list[tuple[int, str]] = []
    if not page:
        return out
    stack: list[tuple[str, int, int]] = []  # (element, verdict of its inside, of the block around that)
    text: list[str] = []
    opened: Counter[str] = Counter()  # how many of each element are on the stack
    verdict, at = OPEN, 0

    def close(depth: int) -> None:
        opened.subtract(t for t, _, _ in stack[depth:])
        del stack[depth:]

    def flush() -> None:
        words = " ".join("".join(text).split())
        text.clear()
        if words:
            around = stack[-1][2] if stack else OPEN
            out.append((HEADING if around == OPEN and any(opened[h] > 0 for h in HEADINGS) else around, words))
    n, last = len(page), page.rfind(">")
    while at < n:
        # Past the last ">" there is no tag but a cut comment.
        m = TAG.search(page, at) if at <= last else CUT.search(page, at)
        stop = m.start() if m else n
        if stop > at and (verdict > DROPPED or verdict == stack[-1][2]):
            text.append(entities.unescape(page[at:stop]))
        if not m:
            break
        at = m.end()
        name = m.re is TAG and m[2] and m[2].lower()
        if not name:
            continue
        if m[1]:
            if opened[name] > 0:
                depth = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name)
                if name in BLOCK or any(t in BLOCK for t, _, _ in stack[depth:]):
                    flush()
                close(depth)
                verdict = stack[-1][1] if stack else OPEN
            elif name in BLOCK:
                flush()
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in RAW_END:
            if name in SKIP:
                at = RAW_END[name].search(page, at).end()
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in BLOCK:
            flush()
            # An open paragraph or item ends here, with the inline elements left open in it.
            for k in range(len(stack) - 1, -1, -1):
                if name in CLOSES.get(stack[k][0], ()):
                    close(k)
                    break
                if stack[k][0] in BLOCK:
                    break
            verdict = stack[-1][1] if stack else OPEN
        inside = verdict
        attributes = attributes_of(m[3]) if m[3] else {}
        label = " ".join(attributes.get(k, "") for k in ("class", "id", "role"))
        hidden = "hidden" in attributes and not attributes["hidden"] or attributes.get("aria-hidden") == "true" \
            or "style" in attributes and HIDING.search(attributes["style"])
        if verdict != DROPPED:
            kept = verdict == KEPT or verdict >= NESTED
            wrappers = -verdict if verdict < 0 else verdict - NESTED if verdict >= NESTED else 0
            if name in SKIP or hidden:
                inside = DROPPED
            elif name in FURNITURE and not (name == "header" and kept):
                inside = DROPPED
            elif label.strip() and name not in ("html", "body", "main") and FURNITURE_WORDS.search(
                    (ABOUT if name == "article" else LACKS).sub("", HEADER.sub("", label) if kept else label)):
                inside = -wrappers - 1
            elif name in MAIN or (label.strip() and verdict == OPEN and name in ("div", "section", "td")
                                  and MAIN_WORDS.search(label)):
                inside = NESTED + wrappers if wrappers else KEPT
        if not m[3].endswith("/"):
            stack.append((name, inside, inside if name in BLOCK else stack[-1][2] if stack else OPEN))
            opened[name] += 1
            verdict = inside
    flush()
    least = min((v for v, _ in out if v == KEPT or v >= NESTED), default=None)
    if least is not None:
        return [(KEPT if v == least else DROPPED, t) for v, t in out]
    return [(max(v, DROPPED), t) for v, t in out]


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Suffix array of integers by prefix doubling (sorting pairs of names)."""
    n = len(codes)
    names = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        tail = np.full(n, -1, dtype=np.int64)
        tail[:max(0, n - k)] = names[k:]
        pair = names * (n + 1) + tail + 1
        distinct, names = np.unique(pair, return_inverse=True)
        k *= 2
        if len(distinct) == n or k > n:
            return np.argsort(names, kind="stable")


def _substrings(codes: np.ndarray, page: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Suffix array; of each of its places the substring's number; of each substring the first place and least and largest page."""
    n = len(codes)
    order = suffix_array(codes)
    # Neighbours in the suffix array that share `least` tokens belong to one substring.
    first, second = order[:-1], order[1:]
    same = np.maximum(first, second) + least <= n
    for k in range(least):
        at = np.flatnonzero(same)
        same[at] = codes[first[at] + k] == codes[second[at] + k]
    run = np.concatenate(([0], np.cumsum(~same)))
    low, high = np.full(run[-1] + 1, np.iinfo(np.int64).max), np.full(run[-1] + 1, np.iinfo(np.int64).min)
    np.minimum.at(low, run, page[order])
    np.maximum.at(high, run, page[order])
    return order, run, np.flatnonzero(np.concatenate(([True], ~same))), low, high


def _cover(starts: np.ndarray, n: int, least: int) -> np.ndarray:
    """True for each of ``n`` tokens in a substring of ``least`` tokens that begins at one of ``starts``."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + least, -1)
    return np.cumsum(edge[:-1]) > 0


def repeated(codes: np.ndarray, page: np.ndarray, least: int) -> np.ndarray:
    """True for each token inside a substring of ``least`` tokens or more that occurs on two distinct pages.

    ``page`` is the page of each token; separators are unique codes, so no
    common prefix runs over them.
    """
    n = len(codes)
    if n < 2 or least > n:
        return np.zeros(n, dtype=bool)
    order, run, _, low, high = _substrings(codes, page, least)
    return _cover(order[(low < high)[run]], n, least)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def identity(found: list[tuple[int, str]]) -> int:
    """Pages with the same undecided blocks are copies of one page; without such blocks, those with the same blocks."""
    return _hash("\n".join([t for v, t in found if v >= OPEN] or [t for _, t in found]))


#: Stands for the pages themselves among the hashes of blocks; no block holds a line end.
ALL_PAGES = _hash("\n")


class Stream:
    """Token streams of the pages' blocks outside of articles, end to end."""

    def __init__(self, pages: list[list[tuple[int, str]]], least: int = LEAST_TOKENS):
        self.least = least
        self.spans: list[list[tuple[int, int]]] = []  # per page and block: start, tokens
        self.whole: dict[str, set[int]] = {}  # blocks of fewer than `least` tokens: their pages
        self.pages: set[int] = set()
        vocabulary: dict[str, int] = {}
        codes: list[int] = []
        owner: list[int] = []
        separator = -1
        for found in pages:
            page, spans = identity(found), []
            self.pages.add(page)
            for block in (t for v, t in found if v != KEPT):
                tokens = block.lower().split()
                spans.append((len(codes), len(tokens)))
                codes.extend(vocabulary.setdefault(t, len(vocabulary)) for t in tokens)
                if len(tokens) < least:
                    self.whole.setdefault(block.lower(), set()).add(page)
                codes.append(separator)
                owner.extend([page] * (len(tokens) + 1))
                separator -= 1
            self.spans.append(spans)
        self.codes, self.owner = np.array(codes, dtype=np.int64), np.array(owner, dtype=np.int64)
        self.words = list(vocabulary)

    def _inside(self) -> np.ndarray:
        """Places from which ``least`` tokens of one block follow."""
        marks = np.concatenate(([0], np.cumsum(self.codes < 0)))
        n = max(len(self.codes) - self.least + 1, 0)
        return np.flatnonzero(marks[self.least:self.least + n] == marks[:n])

    def _hashes(self, starts: np.ndarray) -> np.ndarray:
        word = np.array([_hash(w) for w in self.words], dtype=np.int64).view(np.uint64)
        total = np.zeros(len(starts), dtype=np.uint64)
        for k in range(self.least):
            total += word[self.codes[starts + k]] * np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64))
        return _mix(total).view(np.int64)

    def offers(self) -> pd.DataFrame:
        """Substrings (``hash`` and the least and largest page), and each page of each short block and of the stream (``short``)."""
        pairs = [(_hash(b), p) for b, pages in self.whole.items() for p in pages] + [(ALL_PAGES, p) for p in self.pages]
        names = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        out = pd.DataFrame({"hash": names[:, 0], "low": names[:, 1], "high": names[:, 1], "short": True})
        inside = self._inside()
        if not len(inside):
            return out
        order, _, first, low, high = _substrings(self.codes, self.owner, self.least)
        real = np.isin(order[first], inside)
        return pd.concat([out, pd.DataFrame({"hash": self._hashes(order[first][real]), "low": low[real], "high": high[real],
                                             "short": False})])

    def covered(self, shared: pd.DataFrame | None) -> np.ndarray:
        """Tokens inside of repeats: this stream's own, or the ``shared`` ones (``hash``) of the whole host."""
        if shared is None:
            return repeated(self.codes, self.owner, self.least)
        inside = self._inside()
        return _cover(inside[np.isin(self._hashes(inside), shared["hash"].to_numpy())], len(self.codes), self.least)

    def short(self, shared: pd.DataFrame | None) -> tuple[dict[str, int], int]:
        """Distinct pages of each short block, and of the host."""
        if shared is None:
            return {b: len(p) for b, p in self.whole.items()}, len(self.pages)
        pages = dict(zip(shared["hash"].tolist(), shared["pages"].tolist()))
        return {b: pages.get(_hash(b), 1) for b in self.whole}, pages.get(ALL_PAGES, 1)


def article(pages: list[list[tuple[int, str]]], shared: pd.DataFrame | None = None, share: float = COVERED) -> list[str]:
    """The text of each page: its KEPT blocks, and what repeats leave of the undecided ones.

    A block that repeats cover to ``share`` or more loses these, other blocks
    stay whole.  Blocks of fewer than LEAST_TOKENS are compared whole.  A
    short heading goes if half of the host's pages have it or no text follows.
    """
    if not any(v >= OPEN for p in pages for v, _ in p):
        return ["\n".join(t for v, t in p if v == KEPT) for p in pages]
    stream = Stream(pages)
    covered, (short, most) = stream.covered(shared), stream.short(shared)
    out = []
    for found, spans in zip(pages, stream.spans):
        left: list[tuple[int, str]] = []
        outside = iter(spans)
        for v, t in found:
            start, n = (0, 0) if v == KEPT else next(outside)
            if v == DROPPED:
                continue
            if v >= OPEN and n < stream.least:
                times = short[t.lower()]
                if times > 1 and (v == OPEN or 2 * times >= most):
                    continue
                v = HEADING if v == HEADING and times > 1 else OPEN
            elif v >= OPEN:
                v, gone = OPEN, covered[start:start + n]
                if gone.sum() >= share * n:
                    t = " ".join(w for w, g in zip(t.split(), gone) if not g)
            if t:
                left.append((v, t))
        out.append("\n".join(t for k, (v, t) in enumerate(left) if v != HEADING or any(x != HEADING for x, _ in left[k + 1:])))
    return out


def _pack(found: list[tuple[int, str]]) -> bytes:
    return zlib.compress("\n".join(f"{v}{t}" for v, t in found).encode("utf-8", "surrogatepass"), 6)


def _unpack(blob: bytes) -> list[tuple[int, str]]:
    text = zlib.decompress(blob).decode("utf-8", "surrogatepass")
    return [(int(x[0]), x[1:]) for x in text.split("\n")] if text else []


def extract(pages: DataFrame, group_pages: int = GROUP_PAGES) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    ``text`` joins the article's blocks by line ends; it is empty for a NULL
    or empty html.  Pages are grouped by host (a NULL or odd URL has the
    empty host).  A host's pages are dealt by the hash of (id, url) into
    groups of about ``group_pages``, so a host with a third of all pages is
    many tasks.  Groups of one host with undecided blocks offer the hashes of
    their substrings; those on two pages of the host count in all groups, so
    results do not depend on ``group_pages``.  Repeated rows give equal
    results; other columns are ignored.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    # Hosts of more than one group; the number of groups follows the host's page count.
    sizes = materialise(pages.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "groups", F.ceil(F.col("n") / group_pages).cast("int")).filter("groups > 1"), "html-hosts")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [blocks(h) for h in batch.pop("html")]
            batch["undecided"] = [any(v >= OPEN for v, _ in p) for p in found]
            batch["blob"] = [_pack(p) for p in found]
            yield batch

    def offer(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        out = Stream([_unpack(b) for b in group["blob"]]).offers()
        out.insert(0, "host", key[0])
        out.insert(1, "part", key[1])
        return out

    def told(group: pd.DataFrame, shared: pd.DataFrame | None) -> pd.DataFrame:
        return pd.DataFrame({"page_id": group["page_id"], "url": group["url"],
                             "text": article([_unpack(b) for b in group["blob"]], shared)})

    def decide(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return told(group, None)

    def decide_many(key: tuple, group: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        return told(group, shared)
    rows = pages.select("page_id", "url", "html", host.alias("host")).mapInPandas(
        parse, "page_id long, url string, host string, undecided boolean, blob binary")
    dealt = join_groups(rows, sizes, ["host"], F.struct("page_id", "url")).withColumn(
        "part", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("groups", F.lit(1)))) \
        .select("host", "part", "page_id", "url", "n", "undecided", "blob")
    schema = "page_id long, url string, text string"
    several = None
    if not sizes.isEmpty():
        dealt = materialise(dealt, "html-blocks")
        several = materialise(dealt.filter("n IS NOT NULL AND undecided").select("host").distinct().withColumn(
            "several", F.lit(True)), "html-several")
    if several is None or several.isEmpty():
        out = dealt.select("host", "part", "page_id", "url", "blob").groupBy("host", "part").applyInPandas(decide, schema)
    else:
        dealt = join_groups(dealt, several, ["host"], F.struct("page_id", "url"))
        many = dealt.filter("several").select("host", "part", "page_id", "url", "blob")
        offers = materialise(many.select("host", "part", "blob").groupBy("host", "part").applyInPandas(
            offer, "host string, part long, hash long, low long, high long, short boolean"), "html-offers")
        # Copies of a page meet in several groups, so a short block's pages are made distinct before they are counted.
        shared = offers.groupBy("host", "hash", F.when(F.col("short"), F.col("low")).alias("page")).agg(
            F.min("low").alias("low"), F.max("high").alias("high")).groupBy("host", "hash").agg(
            F.min("low").alias("low"), F.max("high").alias("high"), F.count("page").alias("pages")).filter("low < high")
        needed = offers.select("host", "part", "hash").distinct().join(shared.select("host", "hash", "pages"), ["host", "hash"])
        out = dealt.filter("several IS NULL").select("host", "part", "page_id", "url", "blob").groupBy("host", "part") \
            .applyInPandas(decide, schema).unionAll(
                many.groupBy("host", "part").cogroup(needed.groupBy("host", "part")).applyInPandas(decide_many, schema))
    return out.withColumn("n_chars", F.length("text").cast("long"))
