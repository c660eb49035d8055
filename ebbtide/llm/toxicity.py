"""Operator 5: toxicity by the nearest labelled examples.

Examples are distinct texts of labelled training documents (fold_of(doc_id) not 0), at most EXAMPLES of them: toxic ones up to half of that, and
others, each in the order of a hash of the text's digest. Copies of a text are one example, which is toxic if half of their labels say so. A
text becomes a TF-IDF vector over all terms of the examples, which are words and the first five letters of longer ones. A term's IDF, which
comes from all documents, is multiplied by softplus(z), z being the z score of its document frequencies in toxic and other examples: terms
that lean to toxic examples weigh more, and no term is left out, however few toxic examples there are.

The k nearest examples by exact cosine are found with a block-max inverted index. Examples of like content lie in one block; each term has
the greatest weight that it reaches in each block, so a text's weights times these bound every cosine of a block. The blocks of the highest
bounds are scored first; then all blocks whose bound reaches the k-th cosine found, and no others. Postings of terms of few examples are
kept by term and example, those of many (a HEAVY-th of the examples) by term and block.
Votes weigh 1 / (1 - cosine + 0.05); a logistic curve, fitted on leave-one-out votes of the examples and shifted by the two kinds' sampling
rates, turns them into calibrated scores; if it falls with the vote, or one kind of example is missing, the vote is the score. The neighbours are
the evidence.

One pass turns texts into vectors, which are written; document frequencies and scores are taken from those. Everything
collected or broadcast (vocabulary, index) comes from the examples, so EXAMPLES bounds it.

Defined cases: a null text counts as empty; texts without words have no neighbours and score the share of toxic ones among such examples,
with one more counted that is not; a text none of whose terms the examples have is as far from all and gets the vote of the lowest ids;
without any labelled example the score is 0; ties among neighbours go to the lower example id (that of a text
with copies is the lowest); repeated rows are scored each; labels with null id or null mark are not used, and of several labels of an id
the highest counts; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import fold_of, fresh_name, map_arrow, materialize, settle, sift, slices, text_of

#: Bound of the labelled sample that examples are drawn from.
EXAMPLES = 4_000
#: Texts that are cut into terms at once.
CHUNK = 500
#: Words whose terms a task remembers; more only cost memory.
WORDS = 1 << 17
#: Terms in one of so many examples have their postings by example.
HEAVY = 20
#: Texts that are scored at once.
STEP = 256
K = 15
#: Examples in a block, and blocks that are scored first.
BLOCK, FIRST = 16, 6
NEAR = 0.05

_word = re.compile(r"[^\W\d_]+")


def terms_of(word: str) -> tuple[str, ...]:
    """The word, and the beginning of a longer one, which ends with a hyphen."""
    return (word, word[:5] + "-") if len(word) > 5 else (word,)


def words_of(text: str | None) -> list[str]:
    return _word.findall((text or "").lower())


def examples_of(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, rows: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, toxic, text of the bounded sample, each text once (the ids are few by construction, so they may be broadcast); and how many there are of each kind in all."""
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & (fold_of(F.col(doc_id)) != 0))
    known = known.groupBy(F.col(doc_id).cast("long").alias("example")).agg((F.max(label) > 0).cast("int").alias("mark"))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    digest = F.unhex(F.md5(F.col("text").cast("binary")))
    marked = texts.select("doc_id", digest.alias("digest")).join(known, F.col("doc_id") == F.col("example"))
    distinct = marked.groupBy("digest").agg(F.min("doc_id").alias("example"), (F.avg("mark") >= 0.5).cast("int").alias("toxic"))
    distinct = materialize(distinct.withColumn("place", F.xxhash64("digest")), "toxic-texts")
    parts = []
    total = {r.toxic: r["count"] for r in distinct.groupBy("toxic").count().collect()}
    quota = {1: min(total.get(1, 0), max(rows // 2, rows - total.get(0, 0)))}
    quota[0] = min(total.get(0, 0), rows - quota[1])
    for kind, n in quota.items():
        part = distinct.filter(F.col("toxic") == kind)
        if total.get(kind, 0) > n:
            # far more than enough by the hash alone, so that the rest needs no sorting
            share = min(1.0, (1.2 * n + 1000) / total[kind])
            near = part.filter(F.pmod("place", F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
            part = near.orderBy(F.pmod("place", F.lit(1 << 30)), "digest").limit(n)
        parts.append(part)
    distinct = parts[0].unionByName(parts[1])
    chosen = distinct.select("example", "toxic", F.col("digest").alias("chosen"))
    found = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("example")).filter(digest == F.col("chosen"))
    return found.dropDuplicates(["chosen"]).select("doc_id", "toxic", "text"), total


def term_counts(examples: DataFrame) -> pa.Table:
    """term, n1, n0: in how many toxic and other examples each term occurs; all terms, in order."""

    def make():
        def run(b: pa.RecordBatch):
            n: tuple[Counter, Counter] = (Counter(), Counter())
            for toxic, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n[toxic].update({f for w in set(words_of(t)) for f in terms_of(w)})
            terms = list(n[0] | n[1])
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in n)], ["term", "n0", "n1"])

        return run

    counts = map_arrow(examples.select("toxic", "text"), make, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    return counts.toArrow().sort_by("term").combine_chunks()


def leanings(n1: np.ndarray, n0: np.ndarray, toxic: int, other: int) -> np.ndarray:
    """softplus of the z score of the two shares: above 0 for every term, and small for those that lean to other examples."""
    p = (n1 + n0) / max(toxic + other, 1)
    z = (n1 / max(toxic, 1) - n0 / max(other, 1)) / np.sqrt(p * (1 - p) * (1 / max(toxic, 1) + 1 / max(other, 1)) + 1e-12)
    return np.logaddexp(0, z)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all these slices, one slice after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class Words(dict):
    """Numbers of words in order of first appearance, and of each word's terms, -1 where the vocabulary has none; forgets all beyond WORDS."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary
        self.terms = array("i")

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        forms = terms_of(word)
        self.terms.append(self.vocabulary.get(forms[0], -1))
        self.terms.append(self.vocabulary.get(forms[1], -1) if len(forms) > 1 else -1)
        return n

    def begin(self) -> None:
        """To be called where no number of a word is in use."""
        if len(self) > WORDS:
            self.clear()
            self.terms = array("i")


def term_rows(texts: list, code: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For CHUNK texts at a time: where each text's terms begin (and the end), terms (numbers, ascending by text), counts, n_words."""
    size = len(code.vocabulary) + 1
    for at in range(0, len(texts), CHUNK):
        code.begin()
        words: list[int] = []
        times: list[int] = []
        own, total = [], []
        for t in texts[at : at + CHUNK]:
            c = Counter(words_of(t))
            words += map(code.__getitem__, c)
            times += c.values()
            own.append(len(c))
            total.append(c.total())
        terms = np.array(code.terms, np.int64).reshape(-1, 2)[np.array(words, np.int64)]
        keys = np.repeat(np.arange(len(own)) * size, own)[:, None] + terms
        keep = terms >= 0
        keys, back = np.unique(keys[keep], return_inverse=True)
        counts = np.bincount(back, np.broadcast_to(np.array(times, np.int64)[:, None], terms.shape)[keep], len(keys)).astype(np.int64)
        text, terms = np.divmod(keys, size)
        yield np.searchsorted(text, np.arange(len(own) + 1)), terms, counts, np.array(total, np.int64)


def pack(terms: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending terms as differences, and counts, byte by byte of like place, compressed."""
    both = np.concatenate([np.diff(terms, prepend=0), counts]).astype("<i4")
    return zlib.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()
    n = len(both) // 2
    return np.cumsum(both[:n]), both[n:]


def document_frequencies(vectors: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term occurs; summed by batch first."""

    def make():
        def run(b: pa.RecordBatch):
            n = np.zeros(size, np.int64)
            vectors = b.column(0).to_pylist()
            for at in range(0, len(vectors), CHUNK):
                n += np.bincount(np.concatenate([unpack(v)[0] for v in vectors[at : at + CHUNK]]), minlength=size)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["term", "n"])

        return run

    got = map_arrow(vectors.select("vector"), make, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out


def vectors_of(examples: DataFrame, sent) -> DataFrame:
    """doc_id, toxic, vector (packed terms and counts), n_words, digest of the text."""

    def make():
        code = Words({t: i for i, t in enumerate(sent.value.to_pylist())})

        def run(b: pa.RecordBatch):
            for part in slices(b, 2):
                texts = part.column(2).to_pylist()
                packed, totals = [], []
                for starts, terms, counts, total in term_rows(texts, code):
                    packed += [pack(terms[i:j], counts[i:j]) for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                    totals.append(total)
                digests = [hashlib.md5((t or "").encode("utf-8", "surrogatepass")).digest() for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(packed, pa.binary()), pa.array(np.concatenate(totals)), pa.array(digests, pa.binary())], ["doc_id", "toxic", "vector", "n_words", "digest"])

        return run

    return map_arrow(examples.select("doc_id", "toxic", "text"), make, "doc_id long, toxic int, vector binary, n_words long, digest binary")


@dataclass
class Index:
    """Block-max inverted index over unit vectors; idf holds the terms' whole weights."""

    idf: np.ndarray
    ids: list = field(default_factory=list)
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0))
    k: int = K
    base: float = 0.0
    curve: tuple[float, float] | None = None
    #: (id, toxic, vector, n_words) of the examples, as they are sent
    packed: list | None = None

    def built(self) -> Index:
        """The index, built from the packed examples in the worker that uses it."""
        if self.packed is not None:
            self.build([(i, y, *unpack(v)) for i, y, v, _ in self.packed])
            self.packed = None
        return self

    def weights(self, terms, counts) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights, which single precision holds exactly."""
        t = np.asarray(terms, np.int64)
        w = (1 + np.log(np.asarray(counts, float))) * self.idf[t]
        return t, (w / (math.sqrt(w @ w) or 1.0)).astype(np.float32).astype(float)

    def build(self, rows: list[tuple]) -> None:
        """rows: (id, toxic, terms, counts), all with words."""
        vectors = [(r[0], r[1], *self.weights(*r[2:])) for r in rows]
        # like content together: by the strongest term, then by its weight
        vectors.sort(key=lambda v: (int(v[2][np.argmax(v[3])]) if len(v[2]) else -1, float(np.max(v[3], initial=0)), v[0]))
        self.ids, self.toxic = [v[0] for v in vectors], np.array([v[1] for v in vectors], float)
        self.rank = np.argsort(np.argsort(np.array(self.ids), kind="stable"), kind="stable") if vectors else np.zeros(0, int)
        self.blocks = -(-len(vectors) // BLOCK)
        n = len(self.idf)
        terms = np.concatenate([v[2] for v in vectors] or [np.zeros(0, np.int64)]).astype(np.int32)
        weights = np.concatenate([v[3] for v in vectors] or [np.zeros(0)]).astype(np.float32)
        where = np.repeat(np.arange(len(vectors), dtype=np.int32), [len(v[2]) for v in vectors])
        del vectors
        heavy = np.flatnonzero(np.bincount(terms, minlength=n) * HEAVY >= max(len(self.ids), 1))
        self.slot = np.full(n, -1, np.int32)
        self.slot[heavy] = np.arange(len(heavy))
        at = self.slot[terms] >= 0
        # terms of many examples: by block, term and place in the block
        table = np.zeros((len(heavy), self.blocks * BLOCK), np.float32)
        table[self.slot[terms[at]], where[at]] = weights[at]
        table = table.reshape(len(heavy), self.blocks, BLOCK)
        self.most = table.max(axis=2, initial=0)
        self.table = np.ascontiguousarray(table.transpose(1, 0, 2))
        del table
        # the others: by term
        terms, weights, where = terms[~at], weights[~at], where[~at]
        order = np.argsort(terms, kind="stable")
        self.where, self.sparse = where[order], weights[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=n))]).astype(np.int64)

    def search(self, t: np.ndarray, w: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k best (cosine, position) for one query, as in search_many()."""
        return self.search_many([(t, w)], k)[0]

    def search_many(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[float, int]]]:
        """The k best (cosine, position) for each query (terms, weights), exactly; ties go to the lower id.

        Cosines in single precision choose candidates, with room for its rounding; the candidates' cosines are then exact."""
        n, size = len(queries), self.blocks * BLOCK
        if not size:
            return [[] for _ in queries]
        heavy, light = [], []
        q = np.zeros((n, len(self.most)), np.float32)
        for i, (t, w) in enumerate(queries):
            slot = self.slot[t]
            at = slot >= 0
            heavy.append((slot[at], w[at]))
            q[i, slot[at]] = w[at]
            starts, ends = self.starts[t[~at]], self.starts[t[~at] + 1]
            at, w = spread(starts, ends - starts), np.repeat(w[~at], ends - starts)
            light.append(np.bincount(self.where[at], w * self.sparse[at], size))
        # cosines of the light terms, exact; the greatest of a block is their part of its bound
        part = np.array(light).reshape(n, self.blocks, BLOCK)
        room = (len(self.most) + 2) * 2.0**-22
        bound = q @ self.most + part.max(axis=2) + room
        cosines = np.full((n, self.blocks, BLOCK), -1.0)

        def fill(pairs: np.ndarray) -> None:
            """Scores the marked pairs of query and block, block by block."""
            block, query = np.nonzero(pairs.T)
            ends = np.searchsorted(block, np.arange(self.blocks), side="right")
            for b, i, j in zip(range(self.blocks), [0, *ends], ends, strict=False):
                if i < j:
                    own = query[i:j]
                    cosines[own, b] = part[own, b] + q[own] @ self.table[b]
            cosines.reshape(n, size)[:, len(self.ids) :] = -1.0

        # enough blocks of the highest bounds that k examples are in them
        count = min(max(FIRST, k // BLOCK + 2), self.blocks)
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, np.argpartition(-bound, count - 1, axis=1)[:, :count], True, axis=1)
        fill(first)
        flat = cosines.reshape(n, size)
        kth = lambda: np.partition(flat, -k, axis=1)[:, -k] if size > k else np.full(n, -1.0)
        fill((bound >= kth()[:, None] - room) & ~first)
        out = []
        for least, row, own, (slots, w) in zip(kth(), flat, part.reshape(n, size), heavy, strict=True):
            top = np.flatnonzero(row >= max(0.0, least - 2 * room))
            exact = own[top] + self.table[(top // BLOCK)[:, None], slots, (top % BLOCK)[:, None]] @ w
            best = sorted((-round(c, 12), r, p, c) for c, r, p in zip(exact.tolist(), self.rank[top].tolist(), top.tolist(), strict=True))[:k]
            out.append([(round(c, 14), p) for *_, p, c in best])
        return out

    def search_all(self, rows: list[tuple], k: int) -> Iterator[list[tuple[float, int]]]:
        """search_many() for rows of (terms, counts), STEP at once."""
        for at in range(0, len(rows), STEP):
            yield from self.search_many([self.weights(*r) for r in rows[at : at + STEP]], k)

    def vote(self, found: list[tuple[float, int]]) -> float:
        w = [1 / (1 - min(c, 1.0) + NEAR) for c, _ in found]
        return sum(x * self.toxic[i] for x, (_, i) in zip(w, found, strict=True)) / sum(w)

    def votes_without(self, examples: list, rows: list[tuple]) -> list[float | None]:
        """The votes that examples get without themselves."""
        out = []
        for x, found in zip(examples, self.search_all(rows, self.k + 1), strict=True):
            others = [(c, i) for c, i in found if self.ids[i] != x][: self.k]
            out.append(self.vote(others) if others else None)
        return out

    def score(self, rows: list[tuple]) -> Iterator[tuple[float, list, list]]:
        """Score, neighbours and cosines for rows of (terms, counts, n_words)."""
        found = self.search_all([r[:2] for r in rows if r[2]], self.k)
        for r in rows:
            near = next(found) if r[2] else []
            if not near:
                yield self.base, [], []
                continue
            v = self.vote(near)
            s = v if self.curve is None else 1 / (1 + math.exp(-(self.curve[0] + self.curve[1] * v)))
            yield float(s), [self.ids[i] for _, i in near], [c for c, _ in near]


def fit_curve(votes: list[float], marks: list[int]) -> tuple[float, float] | None:
    """A logistic curve over votes; None if there is none that rises."""
    if not 0 < sum(marks) < len(marks):
        return None
    x, y = np.array(votes), np.array(marks, float)
    a, b = -2.0, 4.0
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-(a + b * x)))
        g = np.array([(p - y).sum() + 1e-3 * a, ((p - y) * x).sum() + 1e-3 * b])
        s = p * (1 - p) + 1e-9
        h = np.array([[s.sum() + 1e-3, (s * x).sum()], [(s * x).sum(), (s * x * x).sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return (float(a), float(b)) if b > 0 and math.isfinite(a + b) else None


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", examples: int = EXAMPLES, k: int = K) -> DataFrame:
    """doc_id, held_out, score, predicted, neighbours, cosines, digest of the text."""
    context = docs.sparkSession.sparkContext
    sample, total = examples_of(docs, labels, doc_id, text, label, examples)
    sample = materialize(sample, "toxic-examples")
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    counts = term_counts(sample)
    vocabulary = counts.column("term").combine_chunks()
    vocabulary = vocabulary if isinstance(vocabulary, pa.Array) else pa.concat_arrays(vocabulary.chunks or [pa.array([], pa.string())])
    lean = leanings(counts.column("n1").to_numpy(), counts.column("n0").to_numpy(), n.get(1, 0), n.get(0, 0))
    del counts
    words = context.broadcast(vocabulary)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.lit(0).alias("toxic"), F.col(text).alias("text"))
    documents = materialize(vectors_of(texts, words).drop("toxic"), "toxic-documents")
    idf = np.log((documents.count() + 1) / (document_frequencies(documents, len(lean)) + 1)) + 1e-6
    index = Index(idf * lean, k=k)
    vectors = materialize(vectors_of(sample, words).drop("digest").repartition(24), "toxic-vectors")
    got = vectors.toArrow()
    rows = list(zip(*(got.column(i).to_pylist() for i in range(4)), strict=True))
    plain = [r for r in rows if not r[3]]
    whole = {kind: total[kind] / n[kind] for kind in n}  # documents that an example stands for
    index.base = sum(whole[1] for r in plain if r[1]) / (sum(whole[r[1]] for r in plain) + 1)
    index.packed = sorted(r for r in rows if r[3])
    sent = context.broadcast(index)

    def make_votes():
        index = sent.value.built()

        def run(b: pa.RecordBatch):
            got = index.votes_without(b.column(0).to_pylist(), [unpack(v) for v in b.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.float64()), b.column(1)], ["vote", "toxic"])

        return run

    votes = map_arrow(vectors.filter("n_words > 0"), make_votes, "vote double, toxic int").filter("vote is not null").collect()
    votes.sort()
    curve = fit_curve([r.vote for r in votes], [r.toxic for r in votes])
    if curve:
        curve = (curve[0] + math.log(whole[1] / whole[0]), curve[1])

    def make():
        index = sent.value.built()
        index.curve = curve

        def run(b: pa.RecordBatch):
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                got = list(index.score([(*unpack(v), n) for v, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]))
                cols = [pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols, part.column(3)], ["doc_id", "score", "neighbours", "cosines", "digest"])

        return run

    scored = map_arrow(documents, make, "doc_id long, score double, neighbours array<long>, cosines array<double>, digest binary")
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours", "cosines", "digest")


def reject_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that are predicted toxic. Rows are told apart by id and text, so a row without id is judged like any other."""
    key, body = fresh_name("toxic_id", docs), fresh_name("toxic_text", docs)
    gone = score_toxicity(docs, labels, doc_id, text).filter("predicted = 1")
    gone = materialize(gone.select(F.col("doc_id").alias(key), F.col("digest").alias(body)).distinct(), "toxic-gone")
    settle(docs.sparkSession)  # the broadcasts of the scores go, and with them what workers hold
    mine = docs[doc_id].cast("long")
    kept, asked = sift(docs, [mine], gone, [F.col(key)])
    return kept.unionByName(asked.join(gone, mine.eqNullSafe(F.col(key)) & (F.unhex(F.md5(F.coalesce(docs[text], F.lit("")).cast("binary"))) == F.col(body)), "left_anti"))
