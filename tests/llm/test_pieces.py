import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from ebbtide.llm import sentencepieces, token_counts
from ebbtide.llm.pieces import ChunkTable, Model
from ebbtide.llm.queries import QUERIES
from tests.llm.fixtures import ODD, empty_docs, odd_docs

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def expected(sp, text):
    ids = sp.encode(text or "", add_bos=True, add_eos=True)
    raw = np.array(ids, "<u4").tobytes()
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_chunks_apply_and_tiny_table_is_exact(sp):
    model = Model(sp.serialized_model_proto())
    assert model.by_chunk
    table = ChunkTable(model, max_chunks=10)
    texts = [t for _, t, _, _ in ODD] * 2
    got = [x.tolist() for x in table.encode(texts)]
    assert got == [sp.encode(t or "") for t in texts]
    assert table.count(texts) == [len(x) for x in got]


def test_odd_texts(spark, sp):
    got = sorted(map(tuple, sentencepieces.encode_pieces(odd_docs(spark), PATH, with_ids=False, with_decoded=False).collect()), key=str)
    assert got == sorted(((d, *expected(sp, t)) for d, t, _, _ in ODD), key=str)
    assert sentencepieces.encode_pieces(empty_docs(spark), PATH).count() == 0


def test_round_trip_by_stored_ids(spark, sp):
    stored = sentencepieces.encode_pieces(odd_docs(spark), PATH)
    back = sorted(map(tuple, sentencepieces.decode_pieces(stored, PATH).collect()), key=str)
    assert back == sorted(((d, sp.decode(sp.encode(t or ""))) for d, t, _, _ in ODD), key=str)


def test_query_is_exact_on_whole_table(spark, sf_dir, sp):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op2_sentencepiece"](spark, sf_dir).collect()}
    assert got == {d: expected(sp, t) for d, t in texts.items()}


def test_counts_query(spark, sf_dir, sp):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op4_token_counts"](spark, sf_dir).collect()}
    assert got == {d: (len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for d, t in texts.items()}


def test_counts_cache(spark, sp, tmp_path, monkeypatch):
    cache, docs = str(tmp_path / "cache"), odd_docs(spark)
    first = sorted(map(tuple, token_counts.count_tokens(docs, PATH, cache).collect()), key=str)
    assert first == sorted(((d, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for d, t, _, _ in ODD), key=str)
    stored = spark.read.parquet(cache + "/*")
    assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for _, t, _, _ in ODD})
    more = docs.unionByName(spark.createDataFrame([(99, "a new text")], "doc_id long, text string"), allowMissingColumns=True)
    again = sorted(map(tuple, token_counts.count_tokens(more, PATH, cache).collect()), key=str)
    assert [r for r in again if r[0] != 99] == first
    assert spark.read.parquet(cache + "/*").count() == stored.count() + 1  # only the miss was encoded
    # a batch without the writer's mark is not read
    broken = tmp_path / "cache" / "batch-broken"
    broken.mkdir()
    assert token_counts.count_tokens(empty_docs(spark), PATH, cache).count() == 0
    # another tokenizer has counts of its own
    other = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(other)
    got = {(r.doc_id, r.n_bytes): r.n_tokens for r in token_counts.count_tokens(docs, other, cache).collect()}
    assert got == {(d, len((x or "").encode())): len(t.encode(x or "", add_special_tokens=False).ids) for d, x, _, _ in ODD}
    assert zlib.crc32(b"") == 0
