"""Operator 6: quality rules as a short-circuit cascade.

The base measures are taken for every document. Documents that pass the base go through the cascade: each rule is a verdict on the
whole text with a cost of its own. On a sample of rows, drawn row by row so that no group of like rows can swell it, executors time every
rule and count its rejections; rules then run in the order of rejections per second, and a document leaves at the first rule that
rejects it. The order changes only the work, and the column rejected_by where several rules would reject: a document is kept
if no rule rejects it.

One pass without a shuffle, besides the sample's sums (one row for each rule).

Defined cases: a null or empty text has no words and fails the base; repeated rows are judged each; null ids are kept; an empty table
gives an empty result (rules then run in their listed order); other columns are ignored.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import map_arrow

MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
#: About so many documents are sampled to order the rules.
SAMPLE_ROWS = 2000


class Text:
    """A text, cut up once. bytes.split() and strip() take exactly the six ASCII white-space characters."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.raw = self.text.encode("utf-8", "surrogatepass")
        self.words = self.raw.split()

    def base(self) -> tuple[int, int, int, int, int]:
        """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"""
        blanks = len(self.raw) - sum(map(len, self.words))
        symbols = len(self.raw) - len(self.raw.translate(None, SYMBOLS))
        return len(self.words), len(self.text) - blanks, symbols, self.dup_lines(), self.repeat_words()

    def dup_lines(self) -> int:
        lines = [x for x in self.raw.split(b"\n") if x.strip()]
        return len(lines) - len(set(lines))

    def repeat_words(self) -> int:
        w = self.words
        windows = list(zip(w, w[1:], w[2:], strict=False))
        if len(set(windows)) == len(windows):
            return 0
        n = Counter(windows)
        marked = bytearray(len(w))
        for i, x in enumerate(windows):
            if n[x] > 1:
                marked[i : i + 3] = b"\1\1\1"
        return sum(marked)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > 50 * n_words


def mean_word_length(t: Text) -> bool:
    """Fewer than 2 or more than 15 bytes a word."""
    return not 2 * len(t.words) <= sum(map(len, t.words)) <= 15 * len(t.words)


def symbol_share(t: Text) -> bool:
    """More than one symbol character for ten words."""
    return 10 * (len(t.raw) - len(t.raw.translate(None, SYMBOLS))) > len(t.words)


def repeated_lines(t: Text) -> bool:
    """More than half of the lines with words repeat an earlier one."""
    lines = [x for x in t.raw.split(b"\n") if x.strip()]
    return 2 * (len(lines) - len(set(lines))) > len(lines)


def letters(t: Text) -> bool:
    """Less than 70 % of the characters other than white space are letters."""
    solid = "".join(t.text.split())
    return 10 * len(re.sub(r"[\W\d_]+", "", solid)) < 7 * len(solid)


def capitals(t: Text) -> bool:
    """More than half of the ASCII letters are capitals."""
    low, high = (len(t.raw) - len(t.raw.translate(None, bytes(range(a, a + 26)))) for a in (97, 65))
    return high > low


def exclamations(t: Text) -> bool:
    """More than 30 % of the words end with an exclamation mark."""
    return 10 * sum(w.endswith(b"!") for w in t.words) > 3 * len(t.words)


def few_distinct(t: Text) -> bool:
    """A word makes up more than 30 % of all words."""
    return 10 * max(Counter(t.words).values(), default=0) > 3 * len(t.words)


def runs(t: Text) -> bool:
    """A character other than white space stands 20 times in a row."""
    return re.search(rb"([^\x20\x09-\x0D])\1{19}", t.raw) is not None


RULES: dict[str, Callable[[Text], bool]] = {f.__name__: f for f in (mean_word_length, symbol_share, repeated_lines, letters, capitals, exclamations, few_distinct, runs)}


def rule_order(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds a document, share rejected), by rejections per second, of a sample of about `rows` documents."""
    total = docs.count()
    if not total:
        return [(name, 0.0, 0.0) for name in RULES]
    share = min(1.0, rows / total)
    sample = docs.select(F.col(text)).sample(share, seed=6) if share < 1 else docs.select(F.col(text))

    def make():
        def run(b: pa.RecordBatch):
            spent, hits, n = Counter(), Counter(), 0
            for raw in b.column(0).to_pylist():
                t = Text(raw)
                if base_failed(len(t.words), t.repeat_words()):
                    continue
                n += 1
                for name, rule in RULES.items():
                    began = time.perf_counter()
                    hits[name] += rule(t)
                    spent[name] += time.perf_counter() - began
            names = list(RULES)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([spent[x] for x in names], pa.float64()), pa.array([hits[x] for x in names], pa.int64()), pa.array([n] * len(names), pa.int64())], ["rule", "seconds", "hits", "n"])

        return run

    sums = map_arrow(sample, make, "rule string, seconds double, hits long, n long").groupBy("rule").agg(F.sum("seconds"), F.sum("hits"), F.sum("n")).collect()
    got = {r[0]: (r[1] / max(r[3], 1), r[2] / max(r[3], 1)) for r in sums}
    found = [(name, *got.get(name, (0.0, 0.0))) for name in RULES]
    return sorted(found, key=lambda x: (-x[2] / (x[1] + 1e-9), x[1]))


def judge(docs: DataFrame, order: list[str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the five base measures, base_failed, kept, and the rule that rejected the document (null if none did)."""
    order = [x[0] for x in rule_order(docs, text)] if order is None else order
    if sorted(order) != sorted(RULES):
        raise ValueError(f"order must name each rule once: {sorted(RULES)}")

    def make():
        cascade = [(name, RULES[name]) for name in order]

        def run(b: pa.RecordBatch):
            cols: list[list] = [[] for _ in range(8)]
            for raw in b.column(1).to_pylist():
                t = Text(raw)
                base = t.base()
                failed = base_failed(base[0], base[4])
                by = None if failed else next((name for name, rule in cascade if rule(t)), None)
                for c, v in zip(cols, (*base, failed, not failed and by is None, by), strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols, kinds)], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"])

        return run

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"
    return map_arrow(docs.select(F.col(doc_id).cast("long"), F.col(text)), make, schema)
