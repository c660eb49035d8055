"""Operator 3: token ids as binary files, compressed by a Re-Pair grammar for each shard.

Format of a shard (little-endian throughout):

    magic b"EBRP0001"; u64: documents, rules, symbols, ids, first nonterminal, bytes of a symbol (2 or 4)
    rules: u32 left[], u32 right[], u32 expansion length[]
    documents: i64 doc_id[], u8 has_id[], u64 end[] (in symbols), u64 number of ids[]
    symbols: u16[] or u32[]

Rule r stands for nonterminal first + r; its two sides are ids or earlier nonterminals. No rule crosses the end of a document, so
a document is a range of symbols and can be decoded alone.

Re-Pair in rounds over arrays: a round counts all neighbouring pairs through a hashed histogram that bounds counts from above, takes
from each frequent slot the pair seen last in it with its exact count, gives the most frequent of these nonterminals, and replaces their
occurrences from left to right. A frequent pair that shares its slot can be passed over in a round; other factors part the two in
the next. It stops when no candidate occurs min_count times, or after max_rounds.

Documents are put in order by range partitioning on (doc_id, hash of the text), so equal or missing ids don't meet in one task; tasks
encode and cut shards of about shard_ids ids as rows stream by. A shard is one row of a Parquet file with its bytes, which any store that Spark
writes can hold, and which appears only when the writer commits. Offsets between shards come from the small columns of those
files: sums within a part, and a running sum over parts (as many as there are shuffle partitions).

Defined cases: a null text counts as empty (only the end id); null ids come first in order; repeated rows are stored each; an empty
table gives no shards and an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbtide.functions.ship import ship_package
from ebbtide.llm.common import broadcast_file, map_arrow, slices, text_of
from ebbtide.llm.pieces import ByteModel, table_for

MAGIC = b"EBRP0001"
SHARD_IDS = 1_000_000
#: Text that is turned into ids at once.
GROUP_BYTES = 4 << 20
MAX_ROUNDS, PAIRS_A_ROUND, MIN_COUNT = 5, 2048, 16
HASH_BITS = 18


def compress(ids: np.ndarray, ends: np.ndarray, first: int, max_rounds: int = MAX_ROUNDS, pairs: int = PAIRS_A_ROUND, min_count: int = MIN_COUNT):
    """symbols, ends in symbols, left, right. ends: where each document ends in ids (the last one at len(ids))."""
    seq = ids.astype(np.uint32)  # a copy, changed in place
    per_doc = np.diff(np.concatenate([[0], ends]))
    last = np.asarray(ends)[per_doc > 0] - 1  # the last id of a document starts no pair
    left, right = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
    used, slots = 0, (1 << HASH_BITS) + 1
    for turn in range(max_rounds):
        if len(seq) < 2:
            break
        a, b = seq[:-1], seq[1:]
        # other factors each round, so that pairs which share a slot now part later
        x, y = np.uint32(2654435761 + 2 * turn), np.uint32(2246822519 + 6 * turn)
        h = a * x
        h ^= b * y
        h >>= np.uint32(32 - HASH_BITS)
        h = h.astype(np.intp)
        h[last[last < len(h)]] = slots - 1
        bound = np.bincount(h, minlength=slots)
        bound[-1] = 0
        least = max(min_count, int(np.partition(bound, -2 * pairs)[-2 * pairs])) if slots > 4 * pairs else min_count
        at = np.flatnonzero((bound >= least)[h])
        slot, a, b = h[at], a[at], b[at]
        # each slot's candidate is the pair seen last in it, most often its frequent one; its count is exact
        first_of, second_of = np.zeros(slots, np.uint32), np.zeros(slots, np.uint32)
        first_of[slot], second_of[slot] = a, b
        own = (a == first_of[slot]) & (b == second_of[slot])
        at, slot = at[own], slot[own]
        counts = np.bincount(slot, minlength=slots)
        order = np.flatnonzero(counts >= min_count)
        order = order[np.argsort(-counts[order], kind="stable")[:pairs]]
        if not len(order):
            break
        number = np.full(slots, -1, np.int64)
        number[order] = np.arange(len(order))
        name = number[slot]
        own = np.flatnonzero(name >= 0)
        at, name = at[own], name[own]
        # of overlapping pairs every other one, from the left
        fresh = np.concatenate([[True], np.diff(at) > 1])
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        even = (np.arange(len(at)) - run) % 2 == 0
        at, name = at[even], name[even]
        hit = np.bincount(name, minlength=len(order))
        kept = np.cumsum(hit > 1) - 1  # a rule that is left with one use is not worth storing
        ok = hit[name] > 1
        at, name = at[ok], kept[name[ok]]
        chosen = order[hit > 1]
        left.append(first_of[chosen])
        right.append(second_of[chosen])
        seq[at] = (first + used + name).astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        last = last - np.searchsorted(at, last)  # less what went up to there
        used += len(chosen)
    sym_ends = np.zeros(len(ends), np.int64)
    sym_ends[per_doc > 0] = last + 1
    return seq, np.maximum.accumulate(sym_ends) if len(sym_ends) else sym_ends, np.concatenate(left), np.concatenate(right)


def lengths_of(left: np.ndarray, right: np.ndarray, first: int) -> np.ndarray:
    out = [0] * len(left)
    for r, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        out[r] = (out[a - first] if a >= first else 1) + (out[b - first] if b >= first else 1)
    return np.array(out, np.uint32)


def pack(doc_ids: list, ids: np.ndarray, ends: np.ndarray, first: int) -> bytes:
    symbols, sym_ends, left, right = compress(ids, ends, first)
    width = 2 if first + len(left) <= 1 << 16 else 4
    head = np.array([len(doc_ids), len(left), len(symbols), len(ids), first, width], "<u8")
    counts = np.diff(np.concatenate([[0], ends]))
    parts = [MAGIC, head, left.astype("<u4"), right.astype("<u4"), lengths_of(left, right, first).astype("<u4")]
    parts += [np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is not None for d in doc_ids], "u1"), sym_ends.astype("<u8"), counts.astype("<u8"), symbols.astype("<u2" if width == 2 else "<u4")]
    return b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts)


@dataclass
class Shard:
    """A shard's bytes, opened."""

    raw: bytes

    def __post_init__(self):
        if self.raw[:8] != MAGIC:
            raise ValueError("not a shard")
        n, rules, symbols, self.n_ids, self.first, width = (int(x) for x in np.frombuffer(self.raw, "<u8", 6, 8))
        at = 56

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(self.raw, kind, count, at)
            at += x.nbytes
            return x

        self.left, self.right, self.lengths = take("<u4", rules), take("<u4", rules), take("<u4", rules)
        ids, has = take("<i8", n), take("u1", n)
        self.doc_ids = [int(d) if h else None for d, h in zip(ids, has, strict=True)]
        self.ends, self.counts = take("<u8", n).astype(np.int64), take("<u8", n).astype(np.int64)
        self.symbols = take("<u2" if width == 2 else "<u4", symbols)
        self._flat = None

    def _expansions(self) -> None:
        """All expansions behind one another: ids stand for themselves."""
        rules = np.stack([self.left, self.right], 1).ravel()
        while (inner := np.flatnonzero(rules >= self.first)).size:  # all rules one level at a time; a round adds one level at most
            r = rules[inner] - self.first
            times = np.ones(len(rules), np.int64)
            times[inner] = 2
            rules = np.repeat(rules, times)
            at = inner + np.arange(len(inner))
            rules[at], rules[at + 1] = self.left[r], self.right[r]
        sizes = np.concatenate([np.ones(self.first, np.int64), self.lengths.astype(np.int64)])
        self._flat, self._starts, self._sizes = np.concatenate([np.arange(self.first, dtype=np.uint32), rules]), np.cumsum(sizes) - sizes, sizes

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        if self._flat is None:
            self._expansions()
        n = self._sizes[symbols]
        at = np.repeat(self._starts[symbols] - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        return self._flat[at]

    def ids(self) -> np.ndarray:
        return self.expand(self.symbols)

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document alone."""
        return self.expand(self.symbols[self.ends[i - 1] if i else 0 : self.ends[i]])


def write_ids(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = 0, shard_ids: int = SHARD_IDS, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes the ids of all documents, each with end_id behind it, in ascending order of doc_id to Parquet files of shards at out."""
    content = broadcast_file(docs.sparkSession, tokenizer_path)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, F.col("text"))

    def run(batches):
        table = table_for(content.value, ByteModel)
        first = max(table.model.tok.get_vocab_size(), end_id + 1)
        part, shard = TaskContext.get().partitionId(), 0
        names: list = []
        held: list[np.ndarray] = []
        size = 0

        def emit() -> pa.RecordBatch:
            ids = np.concatenate(held)
            ends = np.cumsum([len(x) for x in held])
            raw = pack(names, ids, ends, first)
            cols = [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(names)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([raw], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["part", "shard", "n_docs", "n_ids", "payload"])

        for b in batches:
            for piece in slices(b, 1, GROUP_BYTES):
                for d, ids in zip(piece.column(0).to_pylist(), table.encode_array(piece.column(1), end_id), strict=True):
                    names.append(d)
                    held.append(ids)
                    size += len(ids)
                    if size >= shard_ids:
                        yield emit()
                        shard += 1
                        names, held, size = [], [], 0
        if names:
            yield emit()

    ship_package(docs.sparkSession)
    rows.select("doc_id", "text").mapInArrow(run, "part int, shard int, n_docs long, n_ids long, payload binary").write.parquet(out)


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, and on request ids (binary, <u4), from the files alone."""
    files = spark.read.parquet(path)
    meta = files.select("part", "shard", "n_ids")
    parts = meta.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = meta.select("part", "shard", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("at")).join(parts, "part")

    def make():
        def run(b: pa.RecordBatch):
            for part, shard, raw in zip(*(b.column(i) for i in range(3)), strict=True):
                s = Shard(raw.as_py())
                ids = s.ids().astype("<u4")
                ends = np.cumsum(s.counts)
                starts = (ends - s.counts).tolist()
                pieces = [ids[i:j].tobytes() for i, j in zip(starts, ends.tolist(), strict=True)]
                n = len(pieces)
                cols = [pa.array([part.as_py()] * n, pa.int32()), pa.array([shard.as_py()] * n, pa.int32()), pa.array(s.doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(s.counts, pa.int64()), pa.array([zlib.crc32(x) for x in pieces], pa.int64())]
                cols += [pa.array(pieces, pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(cols, ["part", "shard", "doc_id", "local", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

        return run

    rows = map_arrow(files.select("part", "shard", "payload"), make, "part int, shard int, doc_id long, local long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    out = rows.join(offsets, ["part", "shard"])
    return out.select("doc_id", (F.col("base") + F.col("at") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
