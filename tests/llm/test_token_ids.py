"""Token files against plain encoding of whole texts, exact round trips, and odd inputs."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import SF_SMALL
from wattline.llm import token_ids as T
from wattline.session import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as f:
        return T.Encoder(f.read())


def plain(rows, whole):
    """Rows by id, NULL first; start, number and checksum of each row's ids."""
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*whole(text), T.END]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def got(df):
    return [tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from("aEs'tl.-5 é×“́|<>"), max_size=40), min_size=1, max_size=4))
def test_words_encoded_once_give_the_ids_of_whole_texts(whole, encoder, texts):
    ids, count = encoder.encode([t.encode() for t in texts])
    assert ids.tolist() == [i for t in texts for i in whole(t)] and count.tolist() == [len(whole(t)) for t in texts]


@pytest.mark.parametrize("text", [
    "Café é ́x", "a b c\u0085d\x1ce\x0bf", "ΟΔΟΣ ΟΔΟΣ.", "<|endoftext|> x<|startoftext|>y < |endoftext|>",
    "x''s 'tis.'s .'s rock'n'roll 'RE're 5's's5 a'é é's", "é.x É, “é”. ×. a× 5× 5é é5 9́ .é é.é ñ--ñ ÷÷.", "Ab.Cd,ef:12.5;g(h)i[j]k'l \x00a\x7fb",
    "<|ENDOFTEXT|> <|EndOfText|>x", "<|x ABc.De f,G ÀB.c HI J1K", "don't  I'll'd\t's 1234 ½ x² — ©…", "", "   \n\t ", "x" * 3000, "a̸ ≮ ̸", "가 ᅡ"])
def test_joins_over_white_space_and_special_texts(whole, encoder, text):
    assert encoder.encode([text.encode()])[0].tolist() == whole(text)


def test_letters_of_latin_1(whole, encoder):
    """Every letter by itself, in a word, and in upper case."""
    text = " ".join(f"{chr(c)} a{chr(c)}b {chr(c)}{chr(c)}." for c in range(0xA1, 0x250))
    assert encoder.folded and encoder.encode([text.encode()])[0].tolist() == whole(text)


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        other = T.Encoder(f.read())
    text = "Two  spaces, Ünïcode\n and lines"
    ids, count = other.encode([text.encode(), b""])
    assert not other.folded and count.tolist() == [len(ids), 0]
    assert ids.tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_words_beyond_the_memory_are_encoded_again(whole, encoder, monkeypatch):
    monkeypatch.setattr(T, "WORDS", 3)
    texts = [f"w{k} shared word{k % 3}" for k in range(9)]
    for t in texts:
        assert encoder.encode([t.encode()])[0].tolist() == whole(t)


def test_words_met_again_stay_when_the_memory_fills(whole, encoder, monkeypatch):
    """Only words met once are dropped, so the frequent ones are encoded once."""
    monkeypatch.setattr(T, "WORDS", 12)
    e, asked = T.Encoder(encoder.tokenizer.to_str()), []
    merges = e.merges
    e.merges = type("Merges", (), {"tokenize": lambda self, p: asked.append(p) or merges.tokenize(p)})()
    for k in range(40):
        text = f"alpha été alpha, été. w{chr(97 + k % 26)}{k}"
        assert e.encode([text.encode()])[0].tolist() == whole(text)
    assert e.folded and asked.count("alpha") == 1 and len(set(asked)) > 26


def test_slices_of_arrays_with_null(whole, encoder):
    texts = pa.array(["first", None, "", " Ab, b <|endoftext|>", "é.x 12 ", None])
    ids, count = encoder.encode(texts.slice(1, 4))
    assert ids.tolist() == whole(" Ab, b <|endoftext|>") + whole("é.x 12 ") and count.tolist()[:2] == [0, 0] and len(count) == 4


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300) | st.integers(65530, 65540), max_size=30))
def test_byte_coding_round_trip(values):
    values = np.array(values, dtype=np.uint32)
    control, data = T.pack(values)
    assert len(control) == -(-len(values) // 4)
    assert len(data) == sum(max(1, -(-int(v).bit_length() // 8)) for v in values)
    assert T.unpack(control, data, len(values)).tolist() == values.tolist()


ROWS = [(9, "b a"), (3, None), (4, ""), (None, "no id"), (7, "same"), (7, "same"), (1, "ж " * 3000), (-5, "minus")]


@pytest.mark.parametrize("frame_ids, part_ids", [(1, 2), (40, 900), (1 << 20, 1 << 24)])
def test_frames_and_parts_of_any_size(spark, whole, frame_ids, part_ids):
    docs = spark.createDataFrame(ROWS, DOCS).repartition(3).withColumns({c: F.lit(1) for c in ("n", "ids", "row", "part", "frame")})
    folder = scratch_path(spark, "t-tokens")
    T.write_tokens(docs, folder, PATH, frame_ids=frame_ids, part_ids=part_ids)
    assert got(T.read_tokens(spark, folder, arrays=False)) == plain(ROWS, whole)
    back = T.read_tokens(spark, folder).orderBy("start").collect()
    assert [r["ids"] for r in back] == [[*whole(t), T.END] for _, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))]


def test_whole_table(spark, whole):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    folder = scratch_path(spark, "t-tokens")
    assert got(T.token_files(docs, folder, PATH)) == plain([(r["doc_id"], r["text"]) for r in docs.collect()], whole)
    ranks = spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()
    assert [(-r["n"], r["id"]) for r in ranks] == sorted((-r["n"], r["id"]) for r in ranks)


def test_empty_table(spark):
    folder = scratch_path(spark, "t-tokens")
    df = T.token_files(spark.createDataFrame([], DOCS), folder, PATH)
    assert df.collect() == [] and dict(df.dtypes) == dict.fromkeys(["doc_id", "start", "n_tokens", "ids_crc32"], "bigint")


def test_other_files_are_refused(spark):
    with pytest.raises(ValueError):
        next(T._frames(memoryview(b"x" * 100)))
