"""Operator 9: exact Jaccard join of word n-gram sets, and its connected components.

Method: size-banded tiles, hashed bitmap signatures whose bit counts bound the overlap from above, then exact intersection.

1. Sets. One row a document: set size, digest of the sorted set, and its shingles in the lower part of the hash range (one and a half
   times the share of a prefix; more where a set is small). Documents with equal sets become one node.
2. Tiles. Shingles are ordered: those of that range by the number of nodes that have them, then all others by hash. Two sets with
   similarity t or more share one of the first n - ceil(t n) + 1 shingles in any one order. Most of these are shingles that no other node
   has, and a node with nothing else among them takes no further part. The rest make tiles: nodes that share a shingle. Of tiles with the
   very same nodes one is kept. A tile is cut by size bands (a band ends where a set can no longer link to its first size; a node meets
   its own band and the one below), and a cell with more than BLOCK nodes is compared block by block, so no task holds a whole group.
3. Bitmaps. |A and B| <= (|A| + |B| - bits(A xor B)) / 2, with the parity of shingles in each bit, so that large sets don't fill it;
   bitmaps have a bit a shingle or more. Pairs within a block are compared in place; what leaves it is a forest that joins all that
   its passing pairs would, closest pairs first, so a group of near copies gives about one pair a node and tile.
4. Checks. These pairs get their sets, made again from the texts of just these nodes, and the exact intersection. Links become
   components. Where a pair of a forest was no link, the pairs it stood for may still be: every pair of a tile that lies under different
   components and passes the bound is then checked. Two nodes of one component need no link of their own.

Joins are plain equi-joins without an aggregate above them, which Spark splits where a key is hot. Nothing grows on the driver. Work
that stays quadratic: g nodes that share shingles rare enough for their prefixes and yet don't link cost g * g / 2 comparisons of
bitmaps, spread over blocks; no rows are made for them.

Defined cases: a null text has no words; an empty set links to nothing and its component is the document itself; fewer words than
`width` make one shingle of the whole sequence; repeated rows are copies of each other; in jaccard_components a row without id takes no
part in links (its component is null), in keep_one it does; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions.ship import ship_package
from ebbtide.llm.common import discard, fresh_name, give_back, map_arrow, materialize, settle, sift, slices
from ebbtide.llm.components import components

#: Bits of the smallest bitmap; larger sets have the power of two from their size on.
SIGNATURE_BITS = 2048
#: Nodes of a block; a task compares two blocks at a time.
BLOCK = 1024
_factors = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def _finish(h: np.ndarray, salt: int = 0) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * salt)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
#: A 64-bit value for each byte; capitals A-Z have those of a-z, white space none.
_value = _finish((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_BASE))
_value[65:91] = _value[97:123]
_value[_space] = 0


class Shingler:
    """Sets of 64-bit shingle hashes of texts, many texts at once.

    A word's hash is a polynomial in its bytes' values, taken from running sums over the whole buffer (no loop over words), and mixed with
    its length; a shingle's is a sum of its words' hashes with a factor for each place, mixed again."""

    GROUP_BYTES = 1 << 18

    def __init__(self, width: int):
        if not 1 <= width <= len(_factors):
            raise ValueError(f"width must be 1 to {len(_factors)}")
        self.width = width
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * self.GROUP_BYTES)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x))

    def _mix(self, parts: list[np.ndarray]) -> np.ndarray:
        h = parts[0] * _factors[0]
        for x, f in zip(parts[1:], _factors[1:]):
            h = h + x * f
        return _finish(h, len(parts))

    def _group(self, raws: list[bytes]):
        data = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
        self._powers(len(data))
        solid = ~_space[data]
        edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
        if solid[0]:
            edge = np.concatenate([[0], edge])
        starts, ends = edge[::2], edge[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_value[data] * self.up[: len(data)])])
        words = _finish((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * _factors[1])
        k, n = self.width, len(words)
        full = self._mix([words[i : n - k + 1 + i] for i in range(k)]) if n >= k else np.zeros(0, np.uint64)
        lengths = np.array([len(r) + 1 for r in raws])
        first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)])).tolist()
        for i, j in zip(first, first[1:]):
            m = j - i
            if m >= k:
                x = np.sort(full[i : j - k + 1])
                yield x[np.concatenate([[True], x[1:] != x[:-1]])]
            else:
                yield self._mix([words[i + t : i + t + 1] for t in range(m)]) if m else np.zeros(0, np.uint64)

    def sets(self, texts: list[str | None]):
        """The sorted set of each text."""
        held, size = [], 0
        for t in texts:
            held.append((t or "").encode("utf-8", "surrogatepass"))
            size += len(held[-1])
            if size >= self.GROUP_BYTES:
                yield from self._group(held)
                held, size = [], 0
        if held:
            yield from self._group(held)


def _prefix(n, percent: int):
    """How many shingles of a set of n in any one order must hold one of each similar set."""
    return n - (percent * n + 99) // 100 + 1


def _sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, body (digest of the text), n, digest of the whole sorted set, keys (all shingles of the counted range, then the next by hash up
    to the prefix length), counted (how many keys are of that range)."""
    limit = np.uint64(min(1 << 63, 3 * (100 - percent) * (1 << 64) // 200))

    def make():
        shingler = Shingler(width)

        def run(b: pa.RecordBatch):
            for part in slices(b, 1):
                texts, n, digests, counted, keys = part.column(1).to_pylist(), [], [], [], []
                for s in shingler.sets(texts):
                    u = int(np.searchsorted(s, limit))
                    n.append(len(s))
                    digests.append(hashlib.md5(s.tobytes()).digest())
                    counted.append(u)
                    keys.append(s[: max(u, _prefix(len(s), percent) if len(s) else 0)].view(np.int64))
                bodies = [hashlib.md5((t or "").encode("utf-8", "surrogatepass")).digest() for t in texts]
                cols = [part.column(0), pa.array(bodies, pa.binary()), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(counted, pa.int32()), _lists(keys)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "body", "n", "digest", "counted", "keys"])

        return run

    return map_arrow(docs, make, "doc_id long, body binary, n long, digest binary, counted int, keys array<long>")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def _tiles(nodes: DataFrame, percent: int) -> DataFrame:
    """tile, node, n: the rows of tiles with two nodes or more.

    Order of shingles: those of the counted range by the number of sets that have them, then by hash; all others after them, by hash. A set's
    prefix in this order is mostly shingles that no other set has; only the rest of it makes tiles."""
    rows = nodes.select("node", "n", "counted", F.posexplode("keys").alias("at", "shingle"))
    df = rows.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1").withColumnRenamed("shingle", "s")
    late = (F.col("at") >= F.col("counted")).alias("late")
    held = rows.join(df, F.col("shingle") == F.col("s")).select("node", "n", "counted", "shingle", "df", late)
    mine = Window.partitionBy("node")
    alone = F.col("counted") - F.sum(F.when(F.col("late"), 0).otherwise(1)).over(mine)
    held = held.withColumn("alone", alone).withColumn("nth", F.row_number().over(mine.orderBy("late", "df", "shingle")))
    prefix = F.col("n") - F.floor((F.lit(percent) * F.col("n") + 99) / 100) + 1
    held = materialize(held.filter(F.col("nth") <= prefix - F.col("alone")).select("shingle", "node", "n"), "jaccard-prefixes")
    # tiles of the very same nodes say the same: one of them is enough
    who = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"w{i}") for i in (1, 2)]
    tiles = held.groupBy("shingle").agg(F.count("*").alias("members"), *who).filter("members > 1")
    tiles = tiles.groupBy("members", "w1", "w2").agg(F.min("shingle").alias("tile"))
    out = materialize(held.join(tiles.select("tile"), F.col("shingle") == F.col("tile")).select("tile", "node", "n"), "jaccard-tiles")
    discard(held)
    return out


def _bitmap(s: np.ndarray) -> bytes:
    bits = max(SIGNATURE_BITS, 1 << (len(s) - 1).bit_length())
    mark = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(mark.astype(bool)).tobytes()


def fold(raw: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, all as wide as the narrowest: halves of a wider one add up to what a narrower one would be."""
    least = min(len(x) for x in raw)
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, least // 8), axis=0) for x in raw])


def _arrays(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node, bits, items: the sorted sets of these nodes (columns node, rep), made again from the texts, and their bitmaps."""
    picked = nodes.select("node", F.col("rep.doc_id").alias("want_id"), F.col("rep.body").alias("want"))
    _, needed = sift(docs, [F.col("doc_id")], picked, [F.col("want_id")])
    needed = needed.withColumn("body", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    needed = needed.join(picked, F.col("doc_id").eqNullSafe(F.col("want_id")) & (F.col("body") == F.col("want"))).select("node", "text")

    def make():
        shingler = Shingler(width)

        def run(b: pa.RecordBatch):
            for part in slices(b, 1):
                sets = list(shingler.sets(part.column(1).to_pylist()))
                bits = pa.array([_bitmap(s) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), bits, _lists([s.view(np.int64) for s in sets])], ["node", "bits", "items"])

        return run

    # rows that repeat an id and its text give the same set again
    return map_arrow(needed, make, "node long, bits binary, items array<long>").dropDuplicates(["node"])


def _similar(a, b, both, percent: int):
    return 100 * both >= percent * (a + b - both)


def _forest(pairs: np.ndarray, gap: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Rows of pairs that join whatever all pairs join, closest first; nodes of one root count as joined."""
    ends = np.sort(np.unique(roots, return_inverse=True)[1][pairs], axis=1)
    # of the pairs between two roots only the closest can be taken
    order = np.lexsort((gap, ends[:, 1], ends[:, 0]))
    sorted_ends = ends[order]
    order = order[np.concatenate([[True], (sorted_ends[1:] != sorted_ends[:-1]).any(axis=1)])]
    order = order[np.argsort(gap[order], kind="stable")]
    up, out = list(range(int(ends.max()) + 1)), []

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for k, (i, j) in zip(order.tolist(), ends[order].tolist()):
        i, j = find(i), find(j)
        if i != j:
            up[i] = j
            out.append(k)
    return np.asarray(out, np.int64)


def compare(n: np.ndarray, bits: np.ndarray, roots: np.ndarray, own: np.ndarray, block: np.ndarray, percent: int, every: bool) -> np.ndarray:
    """Index pairs of two blocks of a cell (of one block, if it has one) that may link by size and by the bitmaps' bound, lie under different
    roots, and are not both visitors from the band below. Without `every`, only as many as join what all of them would."""
    found, gaps, two = [], [], len(np.unique(block)) > 1
    step = max(1, (1 << 19) // max(1, len(n) * bits.shape[1]))
    for at in range(0, len(n) - 1, step):
        i, rest = slice(at, min(at + step, len(n))), slice(at + 1, None)
        a, b = n[i][:, None], n[None, rest]
        ok = (np.arange(at + 1, len(n))[None] > np.arange(at, at + len(n[i]))[:, None]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
        ok &= (roots[i][:, None] != roots[None, rest]) & ((own[i][:, None] | own[None, rest]) > 0)
        if two:
            ok &= block[i][:, None] != block[None, rest]
        if not ok.any():
            continue
        differ = np.bitwise_count(bits[i][:, None, :] ^ bits[None, rest, :]).sum(axis=2, dtype=np.int64)
        ok &= _similar(a, b, (a + b - differ) // 2, percent)
        x, y = np.nonzero(ok)
        found.append(np.stack([x + at, y + at + 1], axis=1))
        gaps.append(differ[x, y] / (a + b)[x, y])
    if not found or not sum(map(len, found)):
        return np.zeros((0, 2), np.int64)
    pairs = np.concatenate(found)
    return pairs if every else pairs[_forest(pairs, np.concatenate(gaps), roots)]


def _candidates(tiles: DataFrame, roots: DataFrame | None, arrays: DataFrame, percent: int, every: bool) -> DataFrame:
    """a, b (distinct): pairs of nodes of one tile and of sizes that fit, under different roots, that the bitmaps let through."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(percent / 100) * 1.0000001)).cast("int")
    rows = tiles.select("tile", "node", "n", band.alias("band"))
    if roots is None:
        rows = rows.withColumn("root", F.col("node"))
    else:
        rows = rows.join(roots.withColumnRenamed("node", "k"), F.col("node") == F.col("k"), "left").select("tile", "node", "n", "band", F.coalesce("root", "node").alias("root"))
    places = F.explode(F.array(F.struct("band", F.lit(1).alias("own")), F.struct((F.col("band") + 1).alias("band"), F.lit(0).alias("own"))))
    rows = rows.select("tile", "node", "n", "root", places.alias("x")).select("tile", "node", "n", "root", "x.band", "x.own")
    cells = rows.groupBy("tile", "band").agg(F.count("*").alias("members"), F.sum("own").alias("owners"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    cells = cells.filter("owners > 0 and r0 < r1").select(F.col("tile").alias("t"), F.col("band").alias("g"), F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(cells, (F.col("tile") == F.col("t")) & (F.col("band") == F.col("g")))
    rows = rows.select("tile", "band", "node", "n", "root", "own", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    rows = rows.select("tile", "band", "node", "n", "root", "own", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.join(arrays.select(F.col("node").alias("k"), "bits"), F.col("node") == F.col("k"))
    key = ["tile", "band", "x", "y"]
    rows = rows.select("tile", "band", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "node", "n", "root", "own", "block", "bits")
    rows = rows.repartition(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cuts(t: pa.Table) -> list[int]:
            ids = np.stack([t.column(c).to_numpy() for c in key], axis=1)
            return (np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist()

        def pairs(t: pa.Table, cut: list[int]) -> Iterator[pa.RecordBatch]:
            node, *cols = (t.column(c).to_numpy() for c in ("node", "n", "root", "own", "block"))
            bits, out = t.column("bits").to_pylist(), []
            for i, j in zip([0, *cut], [*cut, len(node)]):
                if j - i > 1:
                    n, root, own, block = (c[i:j] for c in cols)
                    got = compare(n, fold(bits[i:j]), root, own, block, percent, every)
                    out.append(np.sort(node[i:j][got], axis=1))
            if out:
                both = np.unique(np.concatenate(out), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, k])) for k in (0, 1)], ["a", "b"])

        held = None  # the last unit of a batch may go on in the next one
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            cut = cuts(t)
            if cut:
                yield from pairs(t.slice(0, cut[-1]), cut[:-1])
            held = t.slice(cut[-1]) if cut else t
        if held is not None and held.num_rows:
            yield from pairs(held, cuts(held))
        held = None
        give_back()

    ship_package(tiles.sparkSession)
    return rows.mapInArrow(run, "a long, b long").distinct()


def _links(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs whose sets are similar, by exact intersection."""
    left, right = (arrays.select(F.col("node").alias(x), F.col("items").alias(f"items_{x}")) for x in "ab")
    both, a, b = F.size(F.array_intersect("items_a", "items_b")).cast("long"), F.size("items_a").cast("long"), F.size("items_b").cast("long")
    return pairs.join(left, "a").join(right, "b").filter(_similar(a, b, both, percent)).select("a", "b")


def _classes(docs: DataFrame, width: int, percent: int, without_id: bool) -> tuple[DataFrame, DataFrame]:
    """doc_id, body, n, digest of every row; and for each digest d the least row (no_id, doc_id, body) of its component."""
    wide = materialize(_sets(docs, width, percent), "jaccard-wide")
    linked = wide.filter("n > 0" if without_id else "n > 0 and doc_id is not null")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "body")).alias("rep")
    nodes = linked.groupBy("digest").agg(rep, F.first("n").alias("n"), F.first("counted").alias("counted"), F.first("keys").alias("keys"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "jaccard-keys")
    sets = materialize(wide.select("doc_id", "body", "n", "digest"), "jaccard-sets")
    discard(wide)
    tiles = _tiles(nodes, percent)
    settle(docs.sparkSession)
    known = materialize(nodes.select("node", "rep", "digest"), "jaccard-nodes")
    discard(nodes)
    arrays = materialize(_arrays(docs, known.join(tiles.select("node").distinct(), "node", "left_semi"), width), "jaccard-arrays")
    links = _links(materialize(_candidates(tiles, None, arrays, percent, every=False), "jaccard-pairs"), arrays, percent)
    found = components(links)
    settle(docs.sparkSession)
    # a pair that was to join two components may not have linked: whatever still could, is checked
    more = materialize(_links(materialize(_candidates(tiles, found, arrays, percent, every=True), "jaccard-pairs"), arrays, percent), "jaccard-links")
    found = found if more.isEmpty() else components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    roots = known.join(found.withColumnRenamed("node", "k"), F.col("node") == F.col("k"), "left").select("digest", "rep", F.coalesce("root", "node").alias("root"))
    least = roots.groupBy("root").agg(F.min("rep").alias("least"))
    classes = materialize(roots.join(least, "root").select(F.col("digest").alias("d"), "least"), "jaccard-classes")
    discard(arrays)
    discard(tiles)
    discard(known)
    settle(docs.sparkSession)
    return sets, classes


def jaccard_components(docs: DataFrame, width: int, percent: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id."""
    sets, classes = _classes(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), width, percent, without_id=False)
    out = sets.join(classes, F.col("digest") == F.col("d"), "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("least.doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that have another row of their component before them, by id (rows without id last), then by digest of the text.

    Rows of one id that differ in text are judged apart; rows equal in id and text are one document and stay or go together."""
    key, body = fresh_name("row_id", docs), fresh_name("row_body", docs)
    sets, classes = _classes(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), width, percent, without_id=True)
    gone = sets.join(classes, F.col("digest") == F.col("d")).filter((F.col("n") > 0) & ~(F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("body") == F.col("least.body"))))
    gone = materialize(gone.select(F.col("doc_id").alias(key), F.col("body").alias(body)).distinct(), "jaccard-gone")
    mine = docs[doc_id].cast("long")
    kept, asked = sift(docs, [mine], gone, [F.col(key)])
    kept_too = asked.join(gone, mine.eqNullSafe(F.col(key)) & (F.unhex(F.md5(F.coalesce(docs[text], F.lit("")).cast("binary"))) == F.col(body)), "left_anti")
    return kept.unionByName(kept_too)
