import math
import re
from collections import Counter

import numpy as np
import pytest

from ebbtide.llm import quality, toxicity
from ebbtide.llm.common import py_fold
from ebbtide.llm.queries import QUERIES
from tests.llm.fixtures import ODD, empty_docs, odd_docs


def test_block_max_search_is_exact():
    rng = np.random.default_rng(3)
    for n, terms in ((0, 5), (1, 5), (300, 12), (1000, 40)):
        index = toxicity.Index(np.abs(rng.normal(2, 1, terms)) + 0.1)
        rows = []
        for i in rng.permutation(n).tolist():
            t = sorted(rng.choice(terms, rng.integers(1, 4), replace=False).tolist())
            rows.append((i, int(rng.integers(2)), t, rng.integers(1, 4, len(t)).tolist()))
        index.build(rows)
        dense = {r[0]: index.weights(*r[2:]) for r in rows}
        for _ in range(30):
            t = sorted(rng.choice(terms, 2, replace=False).tolist())
            q = index.weights(t, [1, 2])

            def cosine(i, q=q):
                d = dict(zip(dense[i][0].tolist(), dense[i][1].tolist(), strict=True))
                return sum(y * d.get(x, 0.0) for x, y in zip(q[0].tolist(), q[1].tolist(), strict=True))

            want = sorted((-round(cosine(i), 9), i) for i in dense)[:7]
            got = [(-round(c, 9), index.ids[p]) for c, p in index.search(*q, 7)]
            assert [c for c, _ in got] == [c for c, _ in want]
            assert sum(a != b for a, b in zip(got, want, strict=True)) <= 2  # ties within rounding


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in QUERIES["op5_toxicity"](spark, d).collect()}
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    for i, r in rows.items():
        assert r.held_out == (py_fold(i) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(rows[i].predicted, y, rows[i].score) for i, y in marks.items() if rows[i].held_out]
    right = Counter((p, y) for p, y, _ in held)
    assert right[1, 1] / (right[1, 1] + right[0, 1]) > 0.8 and right[1, 1] / (right[1, 1] + right[1, 0]) > 0.95
    # calibrated: the mean score is near the share of toxic documents
    assert abs(np.mean([s for *_, s in held]) - np.mean([y for _, y, _ in held])) < 0.03


def test_scores_end_to_end_against_dense_brute_force(spark):
    """Votes of the k nearest of all examples by a full cosine over all terms, written anew, and the same curve."""
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()] + [(10**6, "wretch " * 30_000 + "end")]
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in toxicity.score_toxicity(frame, spark.read.parquet(f"{d}/labels.parquet")).collect()}

    def terms(text):
        return Counter(x for w in re.findall(r"[^\W\d_]+", (text or "").lower()) for x in ([w, w[:5] + "-"] if len(w) > 5 else [w]))

    bags, of_text = {i: terms(t) for i, t in docs}, {}
    for i, t in docs:
        if i in marks and py_fold(i):
            of_text.setdefault(t, []).append(i)
    examples = {min(ids): int(sum(marks[i] for i in ids) * 2 >= len(ids)) for ids in of_text.values()}
    toxic = [i for i in examples if examples[i]]
    n1, n0 = (Counter(x for i in examples if examples[i] == y for x in bags[i]) for y in (1, 0))
    df = Counter(x for b in bags.values() for x in b)
    weight, a, b = {}, len(toxic), len(examples) - len(toxic)
    for x in n1 | n0:
        p = (n1[x] + n0[x]) / (a + b)
        z = (n1[x] / a - n0[x] / b) / math.sqrt(p * (1 - p) * (1 / a + 1 / b) + 1e-12)
        weight[x] = (math.log((len(docs) + 1) / (df[x] + 1)) + 1e-6) * np.logaddexp(0, z)

    def vector(bag):
        v = {x: (1 + math.log(c)) * weight[x] for x, c in bag.items() if x in weight}
        norm = math.sqrt(sum(y * y for y in v.values())) or 1.0
        return {x: y / norm for x, y in v.items()}

    vectors = {i: vector(bags[i]) for i in bags}

    def vote(i, leave=None):
        near = sorted((-round(sum(y * vectors[e].get(x, 0.0) for x, y in vectors[i].items()), 6), e) for e in examples if e != leave)[: toxicity.K]
        w = [(1 / (1 + min(c, 1.0) + toxicity.NEAR) if c > -1 else 1 / toxicity.NEAR, e) for c, e in near]
        return sum(x * examples[e] for x, e in w) / sum(x for x, _ in w)

    curve = toxicity.fit_curve(*zip(*sorted((vote(i, i), y) for i, y in examples.items() if bags[i]), strict=True))
    for i, t in docs:
        want = 1 / (1 + math.exp(-(curve[0] + curve[1] * vote(i)))) if bags[i] else sum(examples[e] for e in examples if not bags[e]) / (1 + sum(not bags[e] for e in examples))
        assert abs(got[i].score - want) < 0.02, (i, got[i].score, want)


def test_toxicity_of_odd_rows(spark):
    train = [i for i in range(1, 400) if py_fold(i)]
    docs = [(i, "you utter scoundrel wretch" if i % 4 == 0 else "a calm and plain text") for i in train] + [(None, "wretch"), (-1, None), (-2, ""), (-3, "wretch scoundrel " * 9), (-3, "wretch")]
    docs = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 score", "2 toxic", "3 example", "4 terms")
    labels = [(i, int(i % 4 == 0)) for i in train] + [(None, 1), (train[0], None), (train[1], 0)]
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert all(r.predicted == int(i % 4 == 0) for i in train for r in by[i])
    assert by[-1][0].score == by[-2][0].score < 0.1 and [r.predicted for r in by[-3]] == [1, 1] and by[None][0].predicted == 1
    assert toxicity.score_toxicity(empty_docs(spark), labels).count() == 0
    none = toxicity.score_toxicity(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0}
    assert {r.predicted for r in toxicity.score_toxicity(docs, labels.filter("toxic = 0")).collect()} == {0}


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    n = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i in range(len(w) - 2) if n[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed


def test_quality_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op6_quality_rules"](spark, sf_dir).collect()
    assert {r.doc_id: tuple(r)[1:7] for r in rows} == {d: plain(t) for d, t in texts.items()}
    assert "rejected_by" not in rows[0]
    judged = quality.judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    assert sorted((r.doc_id, r.kept) for r in judged) == sorted((r.doc_id, r.kept) for r in rows)
    for r in judged:
        t = quality.Text(texts[r.doc_id])
        assert r.kept == (not r.base_failed and not any(f(t) for f in quality.RULES.values()))
        assert r.rejected_by is None or quality.RULES[r.rejected_by](t)


def test_quality_order_does_not_matter(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = list(quality.RULES)
    a, b = (sorted((r.doc_id, r.kept) for r in quality.judge(docs, o).collect()) for o in (names, names[::-1]))
    assert a == b
    order = quality.rule_order(docs)
    assert sorted(x[0] for x in order) == sorted(names) and order[0][2] > 0
    assert all(x[2] / (x[1] + 1e-9) >= y[2] / (y[1] + 1e-9) for x, y in zip(order, order[1:]))
    with pytest.raises(ValueError):
        quality.judge(docs, names[1:])


def test_quality_of_odd_rows(spark):
    got = sorted(((r.doc_id, *tuple(r)[1:7]) for r in quality.judge(odd_docs(spark)).collect()), key=str)
    assert got == sorted(((d, *plain(t)) for d, t, _, _ in ODD), key=str)
    assert quality.judge(empty_docs(spark)).count() == 0
    assert not math.isnan(0.0)


def held_out_counts(spark, name, docs=None, labels=None):
    """Toxic and other labelled held-out documents, as (right, all) each."""
    d = f"/root/testdata/{name}"
    docs, labels = docs or spark.read.parquet(f"{d}/documents.parquet"), labels or spark.read.parquet(f"{d}/labels.parquet")
    marks = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [(r.predicted, marks[r.doc_id]) for r in toxicity.score_toxicity(docs, labels).collect() if r.held_out and r.doc_id in marks]
    return [(sum(p == y for p, y in rows if y == side), sum(y == side for _, y in rows)) for side in (1, 0)]


def test_copies_of_a_toxic_text_hide_no_others(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic")
    # 500 ordinary words that no other text has: with their beginnings more terms than any one cap of hundreds
    text = " ".join(f"{a}{b}{c}quorn{c}{a}" for a in "bdfgklmn" for b in "aeiou" for c in "prstvwxyzhjqc")
    ids = [i for i in range(10_000_000, 10_001_000) if py_fold(i)]
    copies = spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string")
    marked = spark.createDataFrame([(i, 1) for i in ids], "doc_id long, toxic int")
    (found, toxic), (calm, other) = held_out_counts(spark, "sf0.01", docs.unionByName(copies), labels.unionByName(marked))
    assert (toxic, other) == (6, 64) and found >= 5 and calm >= 63


def test_few_toxic_examples_suffice(spark):
    for name, least in (("sf0.001", 1), ("sf0.01", 5)):
        (found, _), (calm, other) = held_out_counts(spark, name)
        assert found >= least and calm >= other - 1


def test_the_stage_rejects_toxic_documents_of_a_small_table(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    toxic = {r.doc_id for r in spark.read.parquet(f"{d}/labels.parquet").filter("toxic = 1").collect()}
    left = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{d}/documents.parquet"), d).collect()}
    assert len(toxic - left) >= 0.8 * len(toxic)
