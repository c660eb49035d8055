import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ebbtide.llm import repair
from ebbtide.llm.pieces import ByteModel, ChunkTable
from ebbtide.llm.queries import QUERIES
from tests.llm.fixtures import ODD, empty_docs, odd_docs

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def table():
    return ChunkTable(ByteModel(open(PATH, "rb").read()), max_chunks=60)


def test_chunks_are_exact(tok):
    table = ChunkTable(ByteModel(open(PATH, "rb").read()), max_chunks=6)
    assert table.model.by_chunk
    more = ["a <|endoftext|> b<|endoftext|>c  d \n e\x85 f \x1c g '  x’s don't  \n\n x ", " lead", "trail ", "a b\nc d. e, it's 12 34", " \xa0 a 　b"]
    texts = [t for _, t, _, _ in ODD] + more
    assert [x.tolist() for x in table.encode(texts * 2)] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts * 2]


PARTS = ["Word", "tail&&&", "a-b", "x_", "don't", "'ll", "##", "ÀÉ;", "日本", "½", "12", *[" "] * 9, "  ", ". ", ", ", ".\n", ",\n", "\n", "\n", "\t", "\x85", "\x1c", "\xa0", "́", "\x01", "<|endoftext|>"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(PARTS), max_size=30).map("".join)), max_size=12))
def test_arrow_chunks_are_exact(tok, table, texts):
    parts, sizes = table.model.split(pa.array(texts, pa.string()))
    assert parts.to_pylist() == [c for t in texts for c in table.model.chunks(t or "")] and len(sizes) == len(texts)
    got = [x.tolist() for x in table.encode_array(pa.array(texts, pa.string()), 0)]
    assert got == [[*tok.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def test_words_cost_no_python_each(tok, monkeypatch):
    """Plain texts are split in Arrow, distinct words are looked up once a call, and new words go to the library hundreds at once, those behind a line end too."""
    table = ChunkTable(ByteModel(open(PATH, "rb").read()))
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100]}" for i in range(1000)]
    text = " ".join(words) + ".\n" + "\n".join(w + "9" for w in words)
    calls, looked = [], []
    library, numbers_of = ByteModel._ids, table._numbers_of
    monkeypatch.setattr(ByteModel, "chunks", lambda t: pytest.fail("a plain text came through Python"))
    monkeypatch.setattr(ByteModel, "_ids", staticmethod(lambda *a: calls.append(1) or library(*a)))
    monkeypatch.setattr(table, "_numbers_of", lambda words, times: looked.append(len(words)) or numbers_of(words, times))
    got = list(table.encode_array(pa.array([text] * 20), 0))
    assert all(x.tolist() == [*tok.encode(text, add_special_tokens=False).ids, 0] for x in got)
    assert len(calls) <= 6 and sum(looked) <= 2010


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=40), max_size=8), st.integers(2, 4))
def test_round_trip_and_single_documents(docs, least):
    ids = np.array([x for d in docs for x in d], np.uint32)
    ends = np.cumsum([len(d) for d in docs]).astype(np.int64)
    if not docs:
        return
    s, e, left, right = repair.compress(ids, ends, 10, min_count=least)
    assert len(s) <= len(ids)
    shard = repair.Shard(repair.pack([None if i == 0 else i for i in range(len(docs))], ids, ends, 10))
    assert shard.ids().tolist() == ids.tolist()
    assert [shard.document(i).tolist() for i in range(len(docs))] == docs
    assert shard.doc_ids == [None if i == 0 else i for i in range(len(docs))]


def test_repeats_are_compressed():
    ids = np.tile(np.arange(8, dtype=np.uint32), 2000)
    s, e, left, right = repair.compress(ids, np.array([len(ids)]), 100)
    assert len(s) < len(ids) / 20 and len(left) <= 40


def test_nested_rules_expand_whole():
    shard = repair.Shard.__new__(repair.Shard)
    shard.first, shard._flat = 4, None
    shard.left, shard.right, shard.lengths = (np.array(x, np.uint32) for x in ([0, 4, 5, 3], [1, 4, 2, 6], [2, 4, 5, 6]))
    assert shard.expand(np.array([7, 2, 4, 6])).tolist() == [3, 0, 1, 0, 1, 2, 2, 0, 1, 0, 1, 0, 1, 2]


def expected(tok, rows):
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_on_whole_table(spark, sf_dir, tok):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op3_repair_ids"](spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == expected(tok, rows)


def test_odd_rows(spark, tok, tmp_path):
    repair.write_ids(odd_docs(spark), PATH, str(tmp_path / "ids"), shard_ids=50)
    got = repair.read_ids(spark, str(tmp_path / "ids")).collect()
    want = expected(tok, [(d, t) for d, t, _, _ in ODD])
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(d), n, c) for d, _, n, c in want)
    assert sorted((r.doc_id, r.start) for r in got if r.doc_id not in (None, 7)) == sorted((d, s) for d, s, _, _ in want if d not in (None, 7))
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    repair.write_ids(empty_docs(spark), PATH, str(tmp_path / "none"))
    assert repair.read_ids(spark, str(tmp_path / "none")).count() == 0
