"""Operator 8: personal data by candidate gradient boosting.

Base spans (e-mail, IP, card, phone: a pattern and a check for each kind) always stay. Beside them, generators of high recall
propose overlapping spans of six kinds: the four in other writings (obfuscated addresses, IPv6, spaced or grouped numbers, national phone
numbers), secrets (keys and tokens) and IBANs. Boosted trees score each candidate by features of its format (lengths, groups,
checksums, entropy) and its context (words before it, characters next to it); a threshold for each kind, calibrated on candidates that
the trees have not seen, selects. Of overlapping selected candidates the best stays; one that meets a base span of its kind, or lies
within any, goes.

There are no marked spans to learn from, so the trees learn from planted ones: in words of a bounded sample of documents (SAMPLE_ROWS, by
a hash of id and text, each text once; at most CANDIDATES rows) are put drawn data of each kind in varied writings (positive) and look-alikes of each kind
(dates, versions, times, prices, order and book numbers, handles, commit hashes, codes; negative). Real base spans are positive, real
proposals that are no base span negative, but for secrets, where a real one after its keyword says nothing. Every kind is thus
calibrated at every corpus size.

One pass over the documents without a shuffle.

Defined cases: a null text counts as empty and has no spans; repeated rows are searched each; null ids are kept; an empty table gives
an empty result; very long runs of digits or letters take linear time; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import map_arrow

KINDS = ("email", "ip", "card", "phone", "secret", "iban")
BASE_KINDS = 4
SAMPLE_ROWS = 2_500
CANDIDATES = 30_000
#: Least share of right ones among the selected candidates of the calibration part.
PRECISION = 0.98

_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where its run of digits does, so these take the same spans as the plain patterns, in linear time
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_digit = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _local:
            start -= 1
        m = _domain.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order."""
    out = [(s, 0, e) for s, e in _emails(text)]
    if _digit.search(text):
        out += [(m.start(), 1, m.end()) for m in _ip.finditer(text) if all(map(_small, m.group().split(".")))]
        for m in _card.finditer(text):
            if m.end() - m.start() >= 14:
                d = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _phone.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return sorted(out)


_AT, _DOT = r"(?:@|\(at\)|\[at\]|\{at\}| at )", r"(?:\.|\[\.\]|\(\.\)|\(dot\)|\[dot\]| dot )"
_g_email = re.compile(rf"(?<![\w.%+-])[\w.%+-]++ {{0,2}}{_AT} {{0,2}}[A-Za-z0-9-]+(?: ?{_DOT} ?[A-Za-z0-9-]+){{1,4}}")
_g_digits = re.compile(r"(?<![0-9A-Za-z])[+(]?[0-9](?:[ ()./-]{0,3}[0-9]){6,23}+(?![0-9])")
_g_ip = re.compile(rf"(?<![0-9.])[0-9]{{1,4}}(?: ?{_DOT} ?[0-9]{{1,4}}){{3}}(?![0-9.]*[0-9])")
_g_ip6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}::?){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_g_secret = re.compile(r"(?i)(?<![a-z])(?:token|secret|password|passwd|key)[\"']? ?[=:] ?[\"']?([A-Za-z0-9+/_=-]{8,})")
_g_hex = re.compile(r"(?<![0-9A-Za-z])[0-9a-fA-F]{24,}+(?![0-9A-Za-z])")
_g_iban = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")
_context = [re.compile(x, re.I) for x in (r"mail|contact|write", r"\bip\b|host|address|server", r"card|visa|credit", r"phone|tel|call|mobile|fax", r"token|secret|passw|key", r"iban|account|konto|bank", r"version|release|section|chapter|build", r"date|since|from|until|year", r"order|isbn|item|article|invoice|commit", r"price|total|sum|cost")]


def mod97(span: str) -> bool:
    x = "".join(c for c in span if c.isascii() and c.isalnum()).upper()
    return len(x) > 14 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all proposals, base or not."""
    out: list[tuple[int, int, int]] = []
    if any(x in text for x in ("@", "(at)", "[at]", "{at}", " dot ")):
        out += [(m.start(), 0, m.end()) for m in _g_email.finditer(text)]
    if _digit.search(text):
        for m in _g_digits.finditer(text):
            n = sum("0" <= c <= "9" for c in m.group())
            if 7 <= n <= 15:
                out.append((m.start(), 3, m.end()))
            if 12 <= n <= 20:
                out.append((m.start() + (m.group()[0] in "+("), 2, m.end()))
        out += [(m.start(), 1, m.end()) for m in _g_ip.finditer(text)]
        out += [(m.start(), 4, m.end()) for m in _g_hex.finditer(text)]
        out += [(m.start(), 5, m.end()) for m in _g_iban.finditer(text)]
        if "::" in text or text.count(":") > 3:
            out += [(m.start(), 1, m.end()) for m in _g_ip6.finditer(text)]
    if "=" in text or ":" in text:
        low = text.lower()
        if any(k in low for k in ("token", "secret", "passw", "key")):
            out += [(m.start(1), 4, m.end(1)) for m in _g_secret.finditer(text)]
    return sorted(set(out))


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    span, before = text[start:end], text[max(0, start - 24) : start]
    digits = "".join(c for c in span if "0" <= c <= "9")
    groups = [len(g) for g in re.split(r"[^0-9]+", span) if g] or [0]
    n = Counter(span)
    entropy = -sum(v / len(span) * math.log2(v / len(span)) for v in n.values()) if span else 0.0
    parts = re.split(r"[^0-9]+", span)
    return [
        kind, len(span), len(digits), sum(c.isalpha() for c in span), sum(not c.isalnum() for c in span), span[:1] == "+", span[:1] == "(", bool(digits) and len(digits) < 20 and luhn(digits),
        len(groups), max(groups), min(groups), entropy, "@" in span, len(re.split(r"[.\s]", span)[-1]), all(map(_small, parts)), span.count("."), span.count(" "), before[-1:].isalnum(), text[end : end + 1].isalnum(),
        span.count(":"), "::" in span, sum(c in "abcdefABCDEF" for c in span), kind == 5 and mod97(span), bool(re.search(r"[(\[{](?:at|dot|\.)[)\]}]", span)), " at " in span, " dot " in span, span.count("/"), span.count("-"),
        all(1 <= len(g) <= 3 for g in parts if g), digits[:1] == "0", sum(c.isupper() for c in span), text[end : end + 1] in "%$€", before.rstrip()[-1:] in ":=", *(bool(c.search(before)) for c in _context),
    ]


def planted(rng: random.Random) -> list[tuple[int, str, bool, str]]:
    """(kind, writing, right, word before it): one drawn piece of data of each kind, and look-alikes."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    letters = lambda k, of="abcdefghijklmnopqrstuvwxyz": "".join(rng.choice(of) for _ in range(k))
    pick = rng.choice
    out: list[tuple[int, str, bool, str]] = []
    # e-mail
    name, host, top = pick([letters(6), f"{letters(4)}.{letters(6)}", f"{letters(5)}{n(2)}", f"{letters(1)}_{letters(7)}"]), letters(rng.randint(4, 9)), pick(["com", "org", "net", "de", "fr", "es", "io", "co.uk"])
    at, dot = pick([" (at) ", "(at)", " [at] ", "[at]", "{at}", " at ", " @ ", "@ "]), pick([".", " . ", " dot ", "(dot)", " [dot] ", "[.]"])
    if at == " at " and dot not in (" dot ", "(dot)", " [dot] "):
        dot = " dot "
    out.append((0, name + at + host + dot + top.replace(".", dot), True, pick(["mail", "contact", "write to", "reach me:", "e-mail:", ""])))
    out += [(0, w, False, "") for w in (f"{letters(5)} at {letters(6)}. {letters(4).title()}", f"{letters(4)} @{letters(6)}. {letters(3).title()}", f"look at {letters(4)} . {letters(5)}")]
    # IP
    quad = [str(rng.randint(0, 255)) for _ in range(4)]
    six = pick([":".join(letters(4, "0123456789abcdef") for _ in range(8)), f"2001:db8:{letters(4, '0123456789abcdef')}::{letters(rng.randint(1, 4), '0123456789abcdef')}", f"fe80::{':'.join(letters(4, '0123456789abcdef') for _ in range(rng.randint(2, 4)))}"])
    out.append((1, pick([pick(["[.]", " . ", "(.)", "(dot)", " [dot] ", " dot "]).join(quad), six, six]), True, pick(["host", "ip", "address", "server", "from", ""])))
    out += [(1, f"{n(2)}:{n(2)}:{n(2)}", False, pick(["at", "time", ""])), (1, f"{n(1)}:{n(2)}:{n(2)}:{n(2)}", False, ""), (1, f"{rng.randint(1, 9)} . {rng.randint(300, 999)} . {n(4)} . {n(4)}", False, pick(["section", "version", ""]))]
    # card
    d = pick(["4", "5", "37", "6011"]) + n(13)
    d = next(x for x in (d[:15] + str(i) for i in range(10)) if luhn(x))
    sep = pick([". ", "  ", "/", ".", " - ", "--"])
    bad = n(15)
    bad = next(x for x in (bad + str(i) for i in range(10)) if not luhn(x))
    out.append((2, sep.join(d[i : i + 4] for i in range(0, 16, 4)), True, pick(["card", "visa", "credit card", "number", ""])))
    out += [(2, pick([".", "/", "  ", ""]).join(bad[i : i + 4] for i in range(0, 16, 4)), False, pick(["order", "item", ""])), (2, f"978{pick(['-', ' '])}{n(1)}-{n(4)}-{n(4)}-{n(1)}", False, "ISBN"), (2, n(pick([13, 17, 20])), False, pick(["order", "invoice", ""]))]
    # phone
    a = pick("23456789") + n(9)
    national = [f"({a[:3]}) {a[3:6]}-{a[6:]}", f"{a[:3]}-{a[3:6]}-{a[6:]}", f"{a[:3]}.{a[3:6]}.{a[6:]}", f"0{a[:3]} {a[3:6]} {a[6:]}", f"0{a[:2]}/{a[2:9]}", f"0049 {a[:3]} {a[3:]}", f"00{n(2)} {a[:1]} {a[1:3]} {a[3:5]} {a[5:7]} {a[7:9]}", f"({a[:3]}) {a[3:]}"]
    out.append((3, pick(national), True, pick(["call", "tel", "phone:", "mobile", "fax", "tel.:", ""])))
    y = rng.randint(1900, 2030)
    out += [(3, w, False, c) for w, c in (
        (f"{y}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", pick(["date", "since", ""])), (f"{rng.randint(1, 28):02}.{rng.randint(1, 12):02}.{y}", ""), (f"{rng.randint(1, 28):02}/{rng.randint(1, 12):02}/{y}", ""), (f"{y}-{y + 3} 12", ""), (n(rng.randint(7, 9)), pick(["order", "item", ""])), (n(rng.randint(11, 13)), "invoice"),
        (f"{n(2)}.{n(2)}.{n(4)}.{n(4)}", "version"), (f"{n(3)} {n(3)} {n(3)}.00", pick(["total", "price"])), (f"{y} {y + 1} {y + 2}", ""), (f"1.2.3.{n(4)}", "version"), (f"{n(1)}.{n(3)}.{n(3)}", ""), (f"{n(2)}-{n(2)}-{n(2)}-{n(2)}", ""),
    )]
    # secrets
    token = pick([letters(32, "0123456789abcdef"), letters(24, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), f"sk_{letters(20, 'abcdefghijklmnopqrstuvwxyz0123456789')}", f"{letters(6)}{n(3)}{letters(4).upper()}", letters(40, "0123456789ABCDEF")])
    out.append((4, pick(["token", "api_key", "secret", "password", "passwd", "key"]) + pick(["=", ": ", " = ", ": '", '="']) + token, True, ""))
    out += [(4, pick(["key: ", "token: ", "secret: "]) + w, False, "") for w in (letters(rng.randint(9, 14)), "-".join((letters(5), letters(6))))]
    out += [(4, letters(40, "0123456789abcdef"), False, "commit"), (4, n(26), False, "")]
    # IBAN
    body, land = n(18), pick(["DE", "FR", "GB", "ES", "NL", "IT"])
    check = 98 - int("".join(str(int(c, 36)) for c in body + land) + "00") % 97
    iban = f"{land}{check:02}{body}"
    out.append((5, pick(["", " "]).join([*(iban[i : i + 4] for i in range(0, 20, 4)), iban[20:]]), True, pick(["IBAN", "account", "bank", ""])))
    out.append((5, f"{land}{(check + rng.randint(1, 90)) % 97:02}{body}", False, pick(["item", "code", ""])))
    out.append((5, f"{letters(2).upper()}{n(2)} {letters(4).upper()} {n(4)} {letters(4).upper()}", False, ""))
    return out


@dataclass
class Trees:
    """Gradient boosting of logistic loss with small trees, over features cut into bins."""

    edges: list
    trees: list
    start: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for tree in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f, cut = tree[0][node], tree[1][node]
                node = 2 * node + 1 + (x[np.arange(len(x)), f] > cut)
            out += tree[2][node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


DEPTH, ROUNDS, RATE, BINS = 3, 60, 0.2, 24


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    p0 = min(max(y.mean(), 1e-3), 1 - 1e-3)
    model = Trees(edges, [], math.log(p0 / (1 - p0)))
    score = np.full(len(y), model.start)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p) + 1e-6
        feature, cut, leaf = np.zeros(2 ** (DEPTH + 1), np.int64), np.full(2 ** (DEPTH + 1), np.inf), np.zeros(2 ** (DEPTH + 1))
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                at = np.flatnonzero(node == k)
                best = (1e-6, 0, np.inf, None)
                total_g, total_h = g[at].sum(), h[at].sum()
                for f, e in enumerate(edges):
                    if len(at) < 2 or not len(e):
                        continue
                    gs, hs = (np.cumsum(np.bincount(binned[at, f], v[at], len(e) + 1))[:-1] for v in (g, h))
                    gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                    i = int(np.argmax(gain))
                    if gain[i] > best[0]:
                        best = (float(gain[i]), f, float(e[i]), i)
                feature[k], cut[k] = best[1], best[2]
                node[at] = 2 * k + 1 + (x[at, best[1]] > best[2])
        for k in np.unique(node):
            at = node == k
            leaf[k] = -RATE * g[at].sum() / (h[at].sum() + 1)
        model.trees.append((feature, cut, leaf))
        score += leaf[node]
    return model


def known(c: tuple[int, int, int], base: list[tuple[int, int, int]]) -> bool:
    """Whether a candidate meets a base span of its kind or lies within any."""
    return any(c[0] < e and s < c[2] if k == c[1] else s <= c[0] and c[2] <= e for s, k, e in base)


@dataclass
class Detector:
    trees: Trees | None
    limits: tuple[float, ...]

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans, and all spans."""
        base = base_spans(text)
        found = [c for c in candidates(text) if not known(c, base)] if self.trees else []
        if not found:
            return base, base
        scores = self.trees.score(np.array([features(text, *c) for c in found], float))
        kept: list[tuple[int, int, int]] = []
        for s, c in sorted(zip(scores.tolist(), found, strict=True), key=lambda x: (-x[0], x[1])):
            if s >= self.limits[c[1]] and not any(c[0] < e and b < c[2] for b, _, e in kept):
                kept.append(c)
        return base, sorted(base + kept)


class Learnt(NamedTuple):
    key: str
    x: list
    y: float


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS, most: int = CANDIDATES) -> Detector:
    total = docs.count()
    if not total:
        return Detector(None, (2.0,) * len(KINDS))
    unit = F.pmod(F.xxhash64(F.col(doc_id), F.col(text), F.lit("pii")), F.lit(1 << 30))
    sample = docs.filter(unit < int(min(1.0, rows / total) * (1 << 30)) + 1).select(F.col(text)).dropDuplicates()

    def make():
        def run(b: pa.RecordBatch):
            xs, ys, keys = [], [], []
            for t in b.column(0).to_pylist():
                t = t or ""
                key = hashlib.md5(t.encode("utf-8", "replace")).hexdigest()
                rng = random.Random(key)
                base = base_spans(t)
                rows = [(features(t, *c), 1.0) for c in base]
                named = {(m.start(1), 4, m.end(1)) for m in _g_secret.finditer(t)} if "=" in t or ":" in t else set()
                rows += [(features(t, *c), 0.0) for c in candidates(t) if not known(c, base) and c not in named]
                words = t.split()[:2000] or ["x"]
                for kind, writing, right, word in planted(rng):
                    start = f"{rng.choice(words)} {rng.choice(words)} {word} ".replace("  ", " ")
                    near = f"{start}{writing}{rng.choice(['', ',', '.', ')', ''])} {rng.choice(words)}"
                    end = len(start) + len(writing)
                    meant = [c for c in candidates(near) if c[1] == kind and c[0] < end and c[2] > len(start)]
                    rows += [(features(near, *c), float(right and c[2] >= end - 1)) for c in meant]
                    # the same writing read as another kind
                    rows += [(features(near, *c), 0.0) for c in candidates(near) if c[1] != kind and c[0] < end and c[2] > len(start) and not (kind == 5 or known(c, base_spans(near)))]
                xs += [r[0] for r in rows]
                ys += [r[1] for r in rows]
                keys += [key] * len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([[float(v) for v in x] for x in xs], pa.list_(pa.float32())), pa.array(ys, pa.float64())], ["key", "x", "y"])

        return run

    got = map_arrow(sample, make, "key string, x array<float>, y double").orderBy(F.xxhash64("key", "x"), "key", "x", "y").limit(most).toArrow()
    got = [Learnt(*r) for r in zip(*(got.column(i).to_pylist() for i in range(3)), strict=True)]
    if not any(r.y for r in got):
        return Detector(None, (2.0,) * len(KINDS))
    x, y = np.array([r.x for r in got]), np.array([r.y for r in got])
    # copies of a text stay on one side
    held = np.array([int(r.key[:8], 16) % 3 == 0 for r in got])
    trees = fit(x[~held], y[~held])
    scores, limits = trees.score(x), []
    for k in range(len(KINDS)):
        at = (x[:, 0] == k) & held
        order = np.argsort(-scores[at], kind="stable")
        s, right = scores[at][order], np.cumsum(y[at][order])
        good = np.flatnonzero((right / np.arange(1, len(s) + 1) >= PRECISION) & np.append(np.diff(s) < 0, True)) if len(s) else []
        limits.append(max(0.5, float(s[good[-1]])) if len(good) else 2.0)
    return Detector(trees, tuple(limits))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_pii(docs: DataFrame, detector: Detector | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans, n_spans (all)."""
    detector = detector or learn(docs, doc_id, text)
    sent = docs.sparkSession.sparkContext.broadcast(detector)

    def make():
        d = sent.value

        def run(b: pa.RecordBatch):
            out: list[list] = [[] for _ in range(7)]
            for t in b.column(1).to_pylist():
                base, spans = d.spans(t or "")
                n = Counter(k for _, k, _ in base)
                for c, v in zip(out, (*(n[k] for k in range(BASE_KINDS)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans)), strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, out, kinds)], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

        return run

    return map_arrow(docs.select(F.col(doc_id).cast("long"), F.col(text)), make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span becomes its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact_column(docs: DataFrame, detector: Detector | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the text redacted; all other columns stay as they are, and a null text stays null."""
    detector = detector or learn(docs, doc_id, text)
    sent = docs.sparkSession.sparkContext.broadcast(detector)
    place = docs.columns.index(text)

    def make():
        d = sent.value

        def run(b: pa.RecordBatch):
            new = [None if t is None else redact(t, d.spans(t)[1]) for t in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(new, b.column(i).type) if i == place else b.column(i) for i in range(b.num_columns)], b.schema.names)

        return run

    return map_arrow(docs, make, docs.schema)
