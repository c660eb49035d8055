import hashlib
import math
import re
import zlib
from collections import defaultdict

from ebbtide.llm import mixing, sharding
from ebbtide.llm.queries import QUERIES
from tests.llm.fixtures import ODD, empty_docs, odd_docs


def unit(key):
    return (int(hashlib.md5(key.encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def place(doc_id, weights):
    k = "" if doc_id is None else str(doc_id)
    return min((-math.log(unit(f"{k}:{s}")) / w, s) for s, w in enumerate(weights))[1]


def check_shards(rows, texts, weights, grown):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32, r.shard, r.grown_shard, r.law) for r in rows) == sorted(
        (d is None, d or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), place(d, weights), place(d, grown), "key") for d, t in texts
    )
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, len(weights))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shards_of_whole_table(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_shards(QUERIES["op7_rendezvous_sharding"](spark, sf_dir).collect(), texts, [1.0] * 40, [1.0] * 41)


def test_shards_of_odd_rows_and_weights(spark):
    w = [1.0, 5.0, 0.5]
    check_shards(sharding.shard_records(odd_docs(spark), w).collect(), [(d, t) for d, t, _, _ in ODD], w, [*w, 0.5])
    assert sharding.shard_records(empty_docs(spark), w).count() == 0
    many = spark.range(4000).selectExpr("id doc_id", "'x' text")
    n = {r.shard: r["count"] for r in sharding.shard_records(many, w).groupBy("shard").count().collect()}
    assert all(abs(n[i] / 4000 - w[i] / 6.5) < 0.03 for i in range(3))


def test_shards_of_rows_that_share_an_id(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 7)
    rows = [(None, "same")] * 40 + [(None, f"text {i}") for i in range(30)] + [(3, "x")] * 7 + [(3, "x" * 5000), (4, None), (4, "")]
    docs = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], "doc_id long, text string, k string, shard int, sub int")
    results = set()
    for parts in (1, 5):
        got = sharding.shard_records(docs.repartition(parts), [1.0, 2.0]).collect()
        check_shards(got, rows, [1.0, 2.0], [1.0, 2.0, 2.0])
        results.add(tuple(sorted(map(str, got))))
    assert len(results) == 1


def fill(sizes, weights=(1, 2, 3), cap=3):
    """Targets by the loop that the contract words."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        share = sum(w[s] for s in order if s not in full)
        t = {s: cap * sizes[s] if s in full else left * w[s] / share for s in order}
        over = {s for s in order if s not in full and t[s] > cap * sizes[s]}
        if not over:
            return t
        full |= over


def check_mix(rows, docs, near=None):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    source_of, sizes = {}, defaultdict(int)
    for d, t, s in docs:
        source_of[d] = s
        sizes[s] += size(t)
    t = fill(sizes)
    assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(d), size(x)) for d, x, _ in docs)
    taken = defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        if r.doc_id is not None:
            assert r.source_size == sizes[source_of[r.doc_id]] and math.isclose(r.target, t[source_of[r.doc_id]], rel_tol=1e-12)
            taken[source_of[r.doc_id]] += r.taken
    if near:
        for s in t:
            assert abs(taken[s] - t[s]) <= near * t[s], (s, taken[s], t[s])


def test_mix_of_whole_table(spark, sf_dir):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rows = QUERIES["op10_source_mixing"](spark, "/root/testdata/sf0.01").collect()
    check_mix(rows, docs, near=0.05)
    assert sorted(rows) == sorted(QUERIES["op10_source_mixing"](spark, "/root/testdata/sf0.01").collect())


def test_mix_of_odd_rows(spark):
    check_mix(mixing.mix(odd_docs(spark)).collect(), [(d, t, s) for d, t, s, _ in [(d, t, s, l) for d, t, l, s in ODD]])
    assert mixing.mix(empty_docs(spark)).count() == 0


def test_mix_caps_a_small_source_and_takes_long_documents_oftener(spark):
    """Over many seeds, documents come in as often as their p says, certain ones always, and repeat_rows takes what mix says."""
    docs = [(i, "w " * (1 + i % 7) if i != 40 else "w " * 60, "a" if i < 3 else "b" if i < 120 else "c") for i in range(200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    seen, want, seeds = defaultdict(int), defaultdict(float), 6
    for k in range(seeds):
        rows = mixing.mix(frame, seed=f"try-{k}").collect()
        check_mix(rows, docs, near=0.05)
        assert all(r.copies == 3 for r in rows if r.doc_id < 3)
        whole = {s: min(r.copies for r in rows if docs[r.doc_id][2] == s and r.p < 1) for s in "bc"}
        for r in rows:
            if r.doc_id >= 3:
                group = (docs[r.doc_id][2], r.size)
                seen[group] += r.copies - whole[docs[r.doc_id][2]]
                want[group] += r.p
                assert r.p < 1 or r.copies > whole[docs[r.doc_id][2]]
    assert len({round(r.p, 9) for r in rows if docs[r.doc_id][2] == "c"}) > 3
    for g, x in want.items():
        assert abs(seen[g] - x) <= 4 * math.sqrt(x + 1) + 0.1 * x, (g, seen[g], x)


def test_like_rows_and_rows_without_id(spark):
    rows = [(None, f"words of number {i % 10} " * (1 + i % 3), "a") for i in range(30)] + [(5, "same " * 20, "b")] * 40 + [(6, None, None), (7, "", None), (8, "solo", "c")]
    extra = [(*r, i, "x", 1) for i, r in enumerate(rows)]
    results = set()
    for parts in (1, 7):
        docs = spark.createDataFrame(extra, "doc_id long, text string, source string, mix_key long, key string, nth int").repartition(parts)
        mixed = mixing.mix(docs).collect()
        check_mix(mixed, rows)
        results.add(tuple(sorted(map(str, (tuple(r)[:6] for r in mixed)))))
        out = mixing.repeat_rows(docs)
        assert out.columns == docs.columns
        taken = defaultdict(int)
        for r in out.collect():
            taken[r.doc_id, r.source] += len((r.text or "").split())
        said = defaultdict(int)
        for r in mixed:
            said[r.doc_id] += r.taken
        assert {k: sum(v for (d, _), v in taken.items() if d == k) for k in said} == dict(said)
    assert len(results) == 1
