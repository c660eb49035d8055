import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np

from ebbtide.llm import pii
from ebbtide.llm.queries import QUERIES
from tests.llm.fixtures import ODD, empty_docs, odd_docs

PATTERNS = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and pii.luhn(d)),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def plain(text):
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if ok(m.group()))


def row(text):
    s = plain(text)
    return (*(sum(k == i for _, k, _ in s) for i in range(4)), hashlib.sha256(pii.joined(s).encode()).hexdigest())


HARD = [
    "a@b@c.d e@f.g.h@i.j x@y @z.q a..b@c-.d-", "1.2.3.4.5.6.7.8 0001.2.3.255 1.2.3.256 999.1.1.1", "4111 1111 1111 1111-1 4111111111111111 4111-1111-1111-1111",
    "+1 (743) 555-3824 +12 +1 2 3 4 5 6 7 8 9 0 (12) +49.30.1234567890123456", "é 😀 a@b.co é 10.0.0.1", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0", "+1-2+1234567890 (", "a%@b.c", "@a.b", "x@a.b.@c.d",
]


def test_base_spans_are_those_of_the_patterns():
    for t in HARD:
        assert pii.base_spans(t) == plain(t), t
    rng = np.random.default_rng(1)
    alphabet = list("0019.@+ -()aB%é,")
    for _ in range(4000):
        t = "".join(rng.choice(alphabet, rng.integers(1, 40)))
        assert pii.base_spans(t) == plain(t), t


def test_long_runs_take_linear_time():
    d = pii.Detector(pii.fit(np.random.default_rng(0).random((50, 24)), np.arange(50) % 2.0), (0.5,) * 6)
    began = time.time()
    for c in ("a", "1", "1.", "+1 ", "1-", "@", "a@", "f0", "f:", "::", "AB12", "1 . ", "a dot ", "1 - "):
        d.spans(c * 60_000 + " @")
    assert time.time() - began < 60


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op8_pii"](spark, sf_dir).collect()}
    assert {d: tuple(r)[1:6] for d, r in got.items()} == {d: row(t) for d, t in texts.items()}
    for d, r in got.items():
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in pii.joined(plain(texts[d])).split(",") if s] == [s for s in spans if s in pii.joined(plain(texts[d])).split(",")]


def test_trees_find_other_writings_and_leave_decoys(spark):
    detector = pii.learn(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    assert detector.trees is not None
    more = lambda t: [s for s in detector.spans(t)[1] if s not in pii.base_spans(t)]
    found = sum(bool(more(t)) for t in ("ind re (743) 555-3824 and he", "on the 743-555-3824 tion", 'the token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" of', "ed anna.54 (at) mail7.example.com the"))
    assert found >= 3
    assert not any(more(t) for t in ("on 2024-01-05 the", "in 1999 and 12345678 of", "version 1.2.3.4567 is", "The key idea: nothing here to see", "plain words only"))


def test_held_out_planted_data_is_found_for_each_kind(spark):
    """Writings drawn with seeds that learning never uses, in words of texts; recall and precision of the added spans for each kind."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    detector, rng = pii.learn(docs), random.Random(4711)
    right, found, wrong = Counter(), Counter(), Counter()
    for t in [r.text for r in docs.select("text").limit(300).collect()] * 2:
        words = (t or "").split() or ["x"]
        for kind, writing, true, word in pii.planted(rng):
            start = f"{rng.choice(words)} {rng.choice(words)} {word} "
            near = f"{start}{writing} {rng.choice(words)}"
            base, spans = detector.spans(near)
            hit = [s for s in spans if s not in base and s[1] == kind and s[0] < len(start) + len(writing) and s[2] > len(start)]
            right[kind] += true
            found[kind] += true and bool(hit)
            wrong[kind] += not true and bool(hit)
    for kind in range(len(pii.KINDS)):
        assert found[kind] >= 0.85 * right[kind], (pii.KINDS[kind], found[kind], right[kind])
        assert wrong[kind] <= 0.02 * max(found[kind], 1), (pii.KINDS[kind], wrong[kind], found[kind])
    # rare kinds and tables without ids learn as well
    assert pii.learn(docs.filter("doc_id < 60").selectExpr("cast(null as long) doc_id", "text")).trees is not None


def test_boosting_against_plain_trees():
    """fit() against the same trees grown by trying every cut in plain Python."""
    rng = np.random.default_rng(5)
    x = np.round(rng.random((60, 3)), 1)
    y = (x[:, 0] + x[:, 1] > 1).astype(float)
    model = pii.fit(x, y)
    score = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    for feature, cut, leaf in model.trees[:5]:
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p) + 1e-6

        def gain(at, f, c, g=g, h=h):
            a = [i for i in at if x[i, f] <= c]
            b = [i for i in at if x[i, f] > c]
            part = lambda z: g[z].sum() ** 2 / (h[z].sum() + 1)
            return part(a) + part(b) - part(list(at))

        root = max(gain(range(60), f, c) for f in range(3) for c in model.edges[f])
        assert abs(gain(range(60), feature[0], cut[0]) - root) < 1e-9
        node = np.zeros(60, int)
        for _ in range(pii.DEPTH):
            node = 2 * node + 1 + (x[np.arange(60), feature[node]] > cut[node])
        for k in set(node):
            assert abs(leaf[k] + pii.RATE * g[node == k].sum() / (h[node == k].sum() + 1)) < 1e-9
        score = score + leaf[node]
    assert np.allclose(model.raw(x), sum((leaf[_leaf(x, f, c)] for f, c, leaf in model.trees), np.full(60, model.start)))


def _leaf(x, feature, cut):
    node = np.zeros(len(x), int)
    for _ in range(pii.DEPTH):
        node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
    return node


def test_odd_rows_and_redaction(spark):
    got = sorted(((r.doc_id, *tuple(r)[1:6]) for r in pii.find_pii(odd_docs(spark)).collect()), key=str)
    assert got == sorted(((d, *row(t)) for d, t, _, _ in ODD), key=str)
    assert pii.find_pii(empty_docs(spark)).count() == 0
    docs = spark.createDataFrame([(1, "mail a@b.co now, 10.0.0.1!", 3), (2, None, 4)], "doc_id long, text string, spans int")
    assert sorted(map(tuple, pii.redact_column(docs).collect())) == [(1, "mail [EMAIL] now, [IP]!", 3), (2, None, 4)]
    assert pii.redact("abcdef", [(1, 0, 3), (2, 1, 4)]) == "a[EMAIL]ef"
