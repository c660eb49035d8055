import random

import pytest

from ebbtide.llm import hamming
from ebbtide.llm.queries import QUERIES


def plain(codes, queries, k):
    out = []
    for q, c in queries:
        best = sorted(((c ^ d) % 2**64).bit_count() * 10**12 + v for v, d in codes)[:k]
        out += [(q, i + 1, b % 10**12, b // 10**12) for i, b in enumerate(best)]
    return sorted(out)


def signed(x, bits):
    return x - 2**bits if bits == 64 and x >= 2**63 else x


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    codes = [(r.vec_id, sum(1 << i for i, x in enumerate(r.embedding) if x > 0)) for r in rows]
    got = sorted(map(tuple, QUERIES["op1_hamming_topk"](spark, sf_dir).collect()))
    assert got == plain(codes, [c for c in codes if c[0] % 100 == 0], 10)


@pytest.mark.parametrize("bits,segments,k,n", [(64, 4, 5, 300), (64, 4, 5, 3000), (12, 3, 7, 200), (8, 1, 3, 30), (8, 4, 50, 20)])
def test_random_codes(spark, bits, segments, k, n):
    rng = random.Random(bits * n)
    codes = [(i, signed(rng.getrandbits(bits), bits)) for i in range(n)]
    codes += [(n + i, codes[3][1]) for i in range(60)] + [(5, codes[5][1])]  # a hot code, a repeated row
    queries = codes[:12]
    df = spark.createDataFrame([*codes, (None, 1), (9999, None)], "vec_id long, code long").withColumnsRenamed({}).selectExpr("*", "1 rows", "2 value", "3 segment")
    asked = spark.createDataFrame([*queries, (None, 1), (77, None)], "query_id long, code long")
    got = sorted(map(tuple, hamming.top_k(df, asked, k, bits, segments).collect()))
    assert got == plain(codes, queries, k)


def test_empty_and_odd_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, code long")
    assert hamming.top_k(none, none.withColumnRenamed("vec_id", "query_id")).count() == 0
    v = spark.createDataFrame([(1, [1.0, -1.0, None, 0.5]), (2, None), (3, [])], "vec_id long, embedding array<double>")
    assert [r.c for r in v.select(hamming.sign_code(v.embedding).alias("c")).collect()] == [9, None, 0]


def test_scan_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(hamming, "SCAN_BLOCK", 5)
    rng = random.Random(5)
    codes = [(i, rng.getrandbits(16)) for i in range(400)]
    queries = codes[:40] + [(1000 + i, codes[0][1]) for i in range(50)]  # a hot query code
    df = spark.createDataFrame(codes, "vec_id long, code long")
    got = sorted(map(tuple, hamming.top_k(df, spark.createDataFrame(queries, "query_id long, code long"), 6, 16, 8).collect()))
    assert got == plain(codes, queries, 6)
