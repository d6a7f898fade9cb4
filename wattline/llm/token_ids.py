"""Token-id output in binary files (operator 12).

Texts are encoded once, ids are ranked by how often the whole corpus has
them, and the ranks are written byte by byte: every value takes one to four
bytes, and its length is a two-bit code in a separate run of control bytes,
four codes a byte.  A table of the 256 control bytes gives the lengths back,
so a reader decodes a whole frame with a few array look-ups.

A folder holds ``data``, binary files of frames, and ``ranks``, the id of
each rank as Parquet.  A frame (all numbers little-endian) is::

    magic   4 bytes  b"WTF1"
    header  part u32, frame u32, documents u32, ids u64, ids before it in the part u64, data bytes u64
    doc_id  documents x i64        null  documents x u8        count  documents x u32
    control (ids + 3) // 4 bytes   data
    b"\\n"

Documents are whole in a frame, parts and frames go up with the id, and
Spark's text writer ends a frame with its line separator.
"""

from __future__ import annotations

import gc
import json
import os
import re
import struct
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, count, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattline.llm.common import materialise

#: Id that ends every document.
END = 2
#: Ids of a frame; a frame ends with the document that reaches it.
FRAME_IDS = 1 << 20
#: Frames of a file, which a reader holds as one value.
FILE_FRAMES = 16
#: Ids of one part (one writing task), about.
PART_IDS = 1 << 24
#: Bytes of text encoded at a time, and words whose ids a worker remembers.
SLICE = 8 << 20
WORDS = 600_000
MAGIC = b"WTF1"
HEADER = "<4sIIIQQQ"

#: Lengths of the four values that a control byte stands for.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + np.uint8(1)
#: Pieces of a word, A-Z lower-cased: a digit, a run of letters (ASCII or Latin-1), a run of other ASCII characters; not
#: cut before a non-ASCII byte, which may join what is before it, nor after an apostrophe, which may begin a contraction.
PIECE = re.compile(rb"[0-9](?![\x80-\xFF])|(?:[a-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF])++(?![\x80-\xFF])"
                   rb"|[\x00-\x2F\x3A-\x60\x7B-\x7F]++(?=\Z|[0-9]|(?<!')[a-z])|.+", re.DOTALL)

#: A piece of letters that a folding tokenizer passes on as one, lower-cased.
RUN = re.compile(rb"(?:[a-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF])+")
#: Byte-level vocabularies write a byte as the Latin-1 character if that is visible, else as the next one from U+0100.
_SEEN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_LETTERS = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in _SEEN)}
STANDS_FOR = "".join(chr(BYTE_LETTERS.get(b, b)) for b in range(256))
#: Normalizer and pre-tokenizer of such a tokenizer, fixed values of the library's file format.
FOLDED = [
    {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}]


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control and data bytes of unsigned 32-bit ``values``."""
    values = values.astype(np.uint32)
    size = np.ones(len(values), dtype=np.uint8)
    for k in range(1, 4):
        size += values >> np.uint32(8 * k) > 0
    codes = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    codes[:len(values)] = size - 1
    control = codes[::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    at = np.cumsum(size, dtype=np.int64) - size
    data = np.empty(int(size.sum()), dtype=np.uint8)
    data[at] = values & np.uint32(0xFF)
    for k in range(1, int(size.max(initial=1))):
        long = np.flatnonzero(size > k)
        data[at[long] + k] = (values[long] >> np.uint32(8 * k)) & np.uint32(0xFF)
    return control, data


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of ``pack``."""
    size = LENGTHS[control].ravel()[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    out = data[at].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        long = np.flatnonzero(size > k)
        out[long] |= data[at[long] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class Places(dict):
    """Number of each word met so far; new words are numbered on the way and listed in ``fresh``."""

    def __init__(self, words: Iterable[bytes] = ()):
        super().__init__(zip(words, count()))
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        self.fresh.append(word)
        return place


def _spans(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all runs of ``size`` items from ``first`` on, end to end, and where each run begins and the last ends."""
    edges = np.concatenate((np.zeros(1, np.int64), np.cumsum(size, dtype=np.int64)))
    return np.repeat(first - edges[:-1], size) + np.arange(edges[-1]), edges


class Encoder:
    """Ids of texts, each distinct word encoded once and remembered.

    A tokenizer that folds case, drops white space and splits where letters,
    digits and other characters meet (``FOLDED``) treats pieces alone: texts
    are split at ASCII white space, and words before ASCII characters where
    these meet (``PIECE``); a piece is a word of its own, and the ids of a
    word are those of its pieces.  A run of letters needs only the tokenizer's
    merges, and where a special token may be, words stay whole and in their
    case.  Any other tokenizer gets whole texts.
    """

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        gc.disable()  # nothing here has cycles, and a collection would walk all remembered words
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(model)
        steps = json.loads(model)
        self.folded = [steps["normalizer"], steps["pre_tokenizer"]] == FOLDED
        self.merges = self.tokenizer.model
        self.place = Places()
        self.first = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.seen = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def _forget(self) -> None:
        """Drop the words met once since the last time, or all if the others alone fill half of the memory."""
        stay = np.flatnonzero(self.seen > 1)
        if 2 * len(stay) > WORDS:
            stay = stay[:0]
        words = list(self.place)
        self.place = Places([words[k] for k in stay.tolist()])
        at, edges = _spans(self.first[stay], self.size[stay])
        self.first, self.size, self.ids = edges[:-1], self.size[stay], self.ids[at]
        self.seen = np.zeros(len(stay), dtype=np.int64)

    def _learn(self) -> None:
        """Ids of the fresh words and of their pieces, which become words too."""
        place, words, base = self.place, self.place.fresh, len(self.first)
        plain, marked, other, joined, parts, sizes = [], [], [], [], [], []
        for k, w in enumerate(words):  # the list grows as it is walked
            if w.isalpha():
                (plain if w.islower() else other).append(k)
            elif RUN.fullmatch(w):
                marked.append(k)
            elif b"<|" in w:
                other.append(k)
            else:
                pieces = PIECE.findall(w.lower())
                if pieces == [w]:
                    other.append(k)
                else:
                    joined.append(k)
                    sizes.append(len(pieces))
                    parts += [place[p] for p in pieces]
        # The merges know bytes by the characters that stand for them.
        folded = b"\n".join([words[k] for k in marked]).decode("utf-8").lower().encode("utf-8")
        letters = charmap_decode(folded, "strict", STANDS_FOR)[0].split(STANDS_FOR[10])
        flat, stops, tokenize = array("I"), array("q", [0]), self.merges.tokenize
        for p in chain([words[k].decode("ascii") for k in plain], letters if marked else ()):
            flat.extend([t.id for t in tokenize(p)])
            stops.append(len(flat))
        for ids in self._whole([words[k] for k in other]):
            flat.extend(ids)
            stops.append(len(flat))
        alone, stop = plain + marked + other, np.array(stops, dtype=np.int64) + len(self.ids)
        first, size = np.zeros((2, len(words)), dtype=np.int64)
        first[alone], size[alone] = stop[:-1], np.diff(stop)
        first, size = np.concatenate((self.first, first)), np.concatenate((self.size, size))
        ids = np.concatenate((self.ids, np.array(flat, dtype=np.uint32)))
        at = np.array(parts, dtype=np.int64)
        spans, within = _spans(first[at], size[at])
        edge = within[np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)))]
        joined = np.array(joined, dtype=np.int64) + base
        first[joined], size[joined] = len(ids) + edge[:-1], np.diff(edge)
        self.first, self.size, self.ids = first, size, np.concatenate((ids, ids[spans]))
        self.seen = np.concatenate((self.seen, np.zeros(len(words), dtype=np.int64)))
        self.seen += np.bincount(at, minlength=len(first))
        words.clear()

    def _whole(self, texts: list[bytes]) -> Iterator[list[int]]:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return (e.ids for e in found)

    def encode(self, texts: list[bytes] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts`` (an array's may be NULL, for empty) end to end, and how many each has."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.binary())
        texts = texts.cast(pa.binary()).fill_null(b"")
        if not self.folded:
            ids = list(self._whole(texts.to_pylist()))
            return np.fromiter(chain.from_iterable(ids), dtype=np.uint32), np.array([len(x) for x in ids], dtype=np.int64)
        if len(self.place) > WORDS:
            self._forget()
        texts = texts.view(pa.string())
        low = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(low)
        edges = split.offsets.to_numpy()
        # Arrow finds the distinct words, so that only these are looked up one by one.
        words = split.flatten().dictionary_encode()
        which, (_, offsets, data) = words.indices.to_numpy(), words.dictionary.buffers()
        stops = np.frombuffer(offsets, dtype=np.int32)[:len(words.dictionary) + 1].tolist() if len(which) else []
        raw = data.to_pybytes() if data else b""
        named = [raw[a:b] for a, b in pairwise(stops)]
        own = np.fromiter(map(self.place.__getitem__, named), dtype=np.int64, count=len(named))
        if self.place.fresh:
            self._learn()
        self.seen[own] += np.bincount(which, minlength=len(own))
        at, before = _spans(self.first[own][which], self.size[own][which])
        return self.ids[at], np.diff(before[edges])


@lru_cache(maxsize=1)
def encoder_of(model: str) -> Encoder:
    """A worker's encoder, with the words that its earlier tasks met."""
    return Encoder(model)


def _slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of items whose sizes add up to ``most``, about."""
    first = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield first, i
            first, held = i, 0
        held += size
    if first < len(sizes):
        yield first, len(sizes)


def width(model: str, end: int = END) -> str:
    """The narrowest integer type for all ids of a tokenizer."""
    from tokenizers import Tokenizer
    return "<u2" if max(Tokenizer.from_str(model).get_vocab_size(), end + 1) <= 1 << 16 else "<u4"


def tokenised(docs: DataFrame, model: str, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, ids, row`` of every row: its ids and ``end`` as integers of ``width(model)``; ``row`` tells rows apart."""
    spark = docs.sparkSession
    shared, kind = spark.sparkContext.broadcast(model), width(model, end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        for batch in batches:
            texts = batch.column(1)
            for lo, hi in _slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), SLICE):
                ids, count = encoder.encode(texts.slice(lo, hi - lo))
                ids = np.insert(ids.astype(kind), np.cumsum(count), end)
                stop = np.concatenate((np.zeros(1, np.int64), np.cumsum(count + 1))) * ids.itemsize
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.array(count + 1),
                    pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(stop), pa.py_buffer(ids)])
                    .cast(pa.binary())], ["doc_id", "n", "ids"])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")) \
        .mapInArrow(run, "doc_id long, n long, ids binary").withColumn("row", F.monotonically_increasing_id())


def frequencies(rows: DataFrame, kind: str) -> DataFrame:
    """``id, n``: how often all ``rows(ids)`` have each id; a task hands on one row per id."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            # The ids of all rows lie end to end.
            stop = np.frombuffer(batch.column(0).buffers()[1], dtype=np.int32)[batch.column(0).offset:][:batch.num_rows + 1]
            data = batch.column(0).buffers()[2]
            held = np.bincount(np.frombuffer(data, dtype=np.uint8)[stop[0]:stop[-1]].view(kind) if data and len(stop) else [])
            held = np.pad(held, (0, max(0, len(total) - len(held))))
            held[:len(total)] += total
            total = held
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])
    return rows.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int = END, frame_ids: int = FRAME_IDS,
                 part_ids: int = PART_IDS) -> None:
    """Write the ids of all texts to ``folder`` in ascending order of ``doc_id``.

    ``tokenizer`` is the path of a file of the tokenizers library, read on
    the driver; special tokens are not added, and ``end`` follows every text.
    A NULL text counts as empty.  Rows without id come first, and rows of
    equal ids follow in the order in which the table is read.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        model = f.read()
    kind, w = width(model, end), int(width(model, end)[-1])
    rows = materialise(tokenised(docs, model, end), "token-rows", compression="zstd")
    # No more rows than the vocabulary has ids.
    ranks = frequencies(rows, kind).orderBy(F.desc("n"), "id").toPandas()
    ids = ranks["id"].to_numpy(dtype=np.int64)
    spark.createDataFrame(list(zip(range(len(ids)), ids.tolist(), ranks["n"].tolist())), "rank int, id long, n long") \
        .coalesce(1).write.parquet(f"{folder}/ranks")
    rank_of = np.zeros(int(ids.max()) + 1 if len(ids) else 1, dtype=np.uint32)
    rank_of[ids] = np.arange(len(ids))
    shared = spark.sparkContext.broadcast(rank_of)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def frame() -> pa.RecordBatch:
            doc = np.array([d or 0 for d, _ in held], dtype="<i8")
            null = np.array([d is None for d, _ in held], dtype=np.uint8)
            count = np.array([len(x) // w for _, x in held], dtype="<u4")
            control, data = pack(shared.value[np.frombuffer(b"".join(x for _, x in held), dtype=kind)])
            head = struct.pack(HEADER, MAGIC, part, number, len(held), size, before, len(data))
            return pa.RecordBatch.from_arrays([pa.array([b"".join(
                (head, doc.tobytes(), null.tobytes(), count.tobytes(), control.tobytes(), data.tobytes()))], pa.binary())], ["frame"])
        for batch in batches:
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append((doc, x.as_py()))
                size += len(held[-1][1]) // w
                if size >= frame_ids:
                    yield frame()
                    number, before, size = number + 1, before + size, 0
                    held.clear()
        if held:
            yield frame()
    parts = max(1, -(-int(ranks["n"].sum()) // part_ids))
    rows.repartitionByRange(parts, "doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "ids") \
        .mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value")) \
        .write.option("maxRecordsPerFile", FILE_FRAMES).text(f"{folder}/data")


def _frames(content: memoryview) -> Iterator[tuple]:
    """Header fields, doc ids, nulls, counts, control and data of each frame of a file."""
    at = 0
    while at < len(content):
        magic, part, number, n, ids, before, size = struct.unpack_from(HEADER, content, at)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at += struct.calcsize(HEADER)
        fields = []
        for kind, count in (("<i8", n), (np.uint8, n), ("<u4", n), (np.uint8, -(-ids // 4)), (np.uint8, size)):
            fields.append(np.frombuffer(content, dtype=kind, count=count, offset=at))
            at += fields[-1].nbytes
        at += 1
        yield part, number, ids, before, *fields


def read_tokens(spark: SparkSession, folder: str, arrays: bool = True) -> DataFrame:
    """Documents of a folder: ``doc_id, start, n_tokens, ids_crc32`` and, with ``arrays``, ``ids``.

    ``start`` counts the ids of all documents before, ``n_tokens`` the own
    ones with the end id, ``ids_crc32`` is the unsigned checksum of the ids as
    little-endian unsigned 32-bit integers.  A task reads one file, of at
    most ``FILE_FRAMES`` frames, at a time.
    """
    id_of = spark.read.parquet(f"{folder}/ranks").orderBy("rank").toPandas()["id"].to_numpy(dtype=np.uint32)
    shared = spark.sparkContext.broadcast(id_of)
    names = ["part", "frame", "doc_id", "place", "n_tokens", "ids_crc32", *(["ids"] if arrays else [])]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for part, number, n, before, doc, null, count, control, data in _frames(memoryview(content.as_buffer())):
                    ids = shared.value[unpack(control, data, n)].astype("<u4")
                    stop = np.concatenate((np.zeros(1, np.int64), np.cumsum(count, dtype=np.int64)))
                    raw = memoryview(ids).cast("B")
                    sums = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(stop[:-1].tolist(), stop[1:].tolist())]
                    whole = [pa.array(np.full(len(doc), part, dtype=np.int64)), pa.array(np.full(len(doc), number, dtype=np.int64)),
                             pa.array(doc, pa.int64(), mask=null.astype(bool)), pa.array(before + stop[:-1]),
                             pa.array(count.astype(np.int64)), pa.array(sums, pa.int64())]
                    if arrays:
                        whole.append(pa.ListArray.from_arrays(pa.array(stop.astype(np.int32)), pa.array(ids.astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(whole, names)
    kind = "part long, frame long, doc_id long, place long, n_tokens long, ids_crc32 long" + (", ids array<long>" if arrays else "")
    rows = spark.read.format("binaryFile").load(f"{folder}/data").select("content").mapInArrow(decode, kind)
    if not arrays:
        rows = materialise(rows, "token-read")
    # A part is a writing task's output, so there are few.
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("place")).alias("start"), *names[4:])


def token_files(docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Write ``docs`` to ``folder`` and read back ``doc_id, start, n_tokens, ids_crc32`` of every row."""
    write_tokens(docs, folder, tokenizer)
    return read_tokens(docs.sparkSession, folder, arrays=False)
