"""Exact token ids by way of distinct chunks, shared by operators 2, 3 and 4.

If no piece of the vocabulary has a white-space marker after another character, no merge crosses a boundary between
a character and a following marker. The ids of a text are then the ids of its chunks (a run of markers and the word behind it) in
order. Byte-level BPE with the usual pre-tokenizer never joins a blank between two words to the word before it, so there a
chunk is a blank and the word behind it. Each distinct chunk is segmented once for each worker by the library itself; documents become arrays of chunk numbers, and ids come
back by position with array indexing.

The table is a worker's own. It holds max_chunks entries and those of one group of documents; beyond that it keeps the half that was
used most, so memory is bounded whatever the corpus. One table for the whole corpus would cost a shuffle of every document's words: see README for figures.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence
from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARK = "▁"
MAX_CHUNKS = 1_000_000
#: Words of documents that are turned into ids at once; bounds the arrays in between.
GROUP_WORDS = 100_000
#: Chunks that go to the library in one call.
JOINED = 500


class Model:
    """A processor, and whether chunks give its exact ids."""

    def __init__(self, proto: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.opens = np.array([p.startswith(MARK) for p in pieces])
        # the normaliser must leave a text as it is but for markers: one in front, and one for each blank
        probe = "  a  \tb ﬁ́ é\n A　Ａ  "
        plain = self.sp.normalize(probe) == MARK + probe.replace(" ", MARK)
        self.by_chunk = plain and self.sp.encode("") == [] and not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        self.mark_ids = [self.sp.piece_to_id(MARK)]
        self.encode_text = self.sp.encode
        self.bos, self.eos = self.sp.bos_id(), self.sp.eos_id()

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Each chunk without its first marker, which the library adds again. Joined with markers in front they give the marked text."""
        if not text:
            return []
        parts = text.replace(" ", MARK).split(MARK)
        if "" in parts:  # runs of markers, or one at an end
            return [c[1:] for c in re.findall(f"{MARK}+[^{MARK}]*", MARK + MARK.join(parts))]
        return parts

    @staticmethod
    def odd(chunk: str) -> bool:
        """Must go to the library alone."""
        return not chunk or MARK in chunk

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each chunk has. Many chunks go to the library as one text; each starts at a piece with a marker."""
        ids, counts = [], []
        for at in range(0, len(chunks), JOINED):
            part = chunks[at : at + JOINED]
            if any(map(self.odd, part)):
                for c in part:
                    x = self.sp.encode(c, num_threads=1) if c else self.mark_ids
                    ids.append(np.array(x, np.int32))
                    counts.append(np.array([len(x)]))
                continue
            x = np.array(self.sp.encode(" ".join(part), num_threads=1), np.int32)
            starts = np.flatnonzero(self.opens[x])
            ids.append(x)
            counts.append(np.diff(np.append(starts, len(x))))
        return np.concatenate(ids), np.concatenate(counts)


#: Marks a chunk without a blank in front.
BARE = "\x01"
_unplain = re.compile(r"(?:\W|_|^)[.,]\s")
#: White space as Python's re takes it, for RE2.
_SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


#: A chunk of letters, one pre-token, and perhaps ASCII signs behind them, another. The letters are in every version of Unicode.
_simple = re.compile(rf"{BARE}?[A-Za-zÀ-ÖØ-öø-ɏ]+[!-/:-@\[-`{{-~]*").fullmatch
_signs = re.compile(r"[!-/:-@\[-`{-~]+").fullmatch
IS_SIGN = np.array([_signs(chr(b)) is not None for b in range(256)])


def _byte_characters() -> np.ndarray:
    """The character that byte-level pieces have for each byte; the line end stays, to part words."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = np.zeros(256, "<u4")
    out[shown] = shown
    hidden = np.flatnonzero(out == 0)
    out[hidden] = 256 + np.arange(len(hidden))
    out[ord("\n")] = ord("\n")
    return out


BYTE_CHARACTERS = _byte_characters()


class ByteModel:
    """A byte-level BPE of the tokenizers library, and whether chunks give its exact ids."""

    def __init__(self, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_buffer(content)
        self.tok.no_truncation()
        self.tok.no_padding()
        # the same model for words that are pre-tokens already
        self.words = Tokenizer(self.tok.model)
        self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        spec = json.loads(content)
        # a byte-level piece has one character for each byte
        self.n_bytes = np.zeros(self.tok.get_vocab_size(), np.int64)
        for piece, i in self.tok.get_vocab(with_added_tokens=True).items():
            self.n_bytes[i] = len(piece)
        for t in spec["added_tokens"]:
            self.n_bytes[t["id"]] = len(t["content"].encode())
        pre, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
        self.by_chunk = spec["normalizer"] is None and (pre.get("type"), pre.get("use_regex"), pre.get("add_prefix_space")) == ("ByteLevel", True, False)
        self.by_chunk &= not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)
        self.by_word = not any(_simple(t["content"]) or _signs(t["content"]) for t in added)

    def encode_text(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Keys of the chunks: without a mark for a blank and what follows; text behind BARE for a chunk without a blank.

        A single line end between other characters is a pre-token of its own, and so are a full stop or comma between a letter or digit and
        white space: splitting there too leaves far fewer distinct chunks. Where white space or punctuation is less plain, only blanks between
        other characters split."""
        if BARE in text or re.search(r"\s\s", text):
            parts = re.split(r"(?<=\S)(?= \S)", text)
            return [p[1:] if p[:1] == " " and p[1:2] not in (" ", BARE) else BARE + p for p in parts]
        if not _unplain.search(text):
            text = text.replace(", ", f" {BARE}, ").replace(". ", f" {BARE}. ").replace(",\n", f" {BARE},\n").replace(".\n", f" {BARE}.\n")
        parts = text.replace("\n", f" {BARE}\n {BARE}").split(" ")
        parts[0] = BARE + parts[0]
        return parts

    @classmethod
    def split(cls, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The chunks of all texts, as chunks() gives them, and how many each text has. Only texts with runs of white space pass through Python."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        rough = pc.or_(pc.match_substring_regex(texts, _SPACE + "{2}"), pc.match_substring(texts, BARE)).to_numpy(zero_copy_only=False)
        even = texts.filter(pa.array(~rough)) if rough.any() else texts
        plain = even
        for mark in (", ", ". ", ",\n", ".\n"):
            plain = pc.replace_substring(plain, mark, f" {BARE}{mark}")
        unplain = pc.match_substring_regex(even, r"(?:[^\pL\pN]|^)[.,]" + _SPACE)
        even = pc.if_else(unplain, even, plain) if pc.any(unplain).as_py() else plain
        even = pc.binary_join_element_wise(pa.scalar(BARE, even.type), pc.replace_substring(even, "\n", f" {BARE}\n {BARE}"), pa.scalar("", even.type))
        parts = pc.split_pattern(even, " ")
        if rough.any():
            more = pa.array([cls.chunks(t) for t in texts.filter(pa.array(rough)).to_pylist()], parts.type)
            place = np.empty(len(texts), np.int64)
            place[np.concatenate([np.flatnonzero(~rough), np.flatnonzero(rough)])] = np.arange(len(texts))
            parts = pa.concat_arrays([parts, more]).take(pa.array(place))
        return parts.flatten(), pc.list_value_length(parts).to_numpy()

    def odd(self, chunk: str) -> int:
        """How a chunk goes to the library: 0 as pre-tokens, 1 behind a blank, 2 between line ends, each with many others, 3 alone."""
        if self.by_word and _simple(chunk):
            return 0
        if not chunk or chunk[-1].isspace():
            return 3
        return 1 if chunk[0] != BARE else 2 if chunk[1:2] and not chunk[1].isspace() else 3

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each chunk has. Most chunks go to the library as one text, and bytes tell where each ends: words of letters
        and signs without its pre-tokenizer, others behind a blank or between line ends, of which a single one between other characters is a pre-token."""
        ids, counts = [], []
        for odd, same in groupby(chunks, self.odd):
            run = list(same)
            for at in range(0, len(run), JOINED):
                part = run[at : at + JOINED]
                if odd == 3:
                    texts = [c[1:] if c[:1] == BARE else " " + c for c in part]
                    for e in self.tok.encode_batch_fast(texts, add_special_tokens=False):
                        ids.append(np.array(e.ids, np.int32))
                        counts.append(np.array([len(e.ids)]))
                    continue
                if odd == 0:
                    raw = np.frombuffer("\n".join([c[1:] if c[0] == BARE else " " + c for c in part]).encode(), np.uint8)
                    cuts = np.append(np.flatnonzero(raw == ord("\n")), len(raw))
                    stops = cuts - np.arange(len(cuts))
                    signs = IS_SIGN[raw]
                    raw = np.insert(raw, np.flatnonzero(signs[1:] & ~signs[:-1]) + 1, ord("\n"))
                    x = self._ids(self.words, BYTE_CHARACTERS[raw].tobytes().decode("utf-32-le"))
                elif odd == 1:
                    stops = np.cumsum([len(c.encode()) + 1 for c in part])
                    x = self._ids(self.tok, " " + " ".join(part))
                else:  # the mark's byte stands for the line end behind a chunk
                    stops = np.cumsum([len(c.encode()) for c in part])
                    x = self._ids(self.tok, "\n".join([c[1:] for c in part]))
                ends = np.searchsorted(np.cumsum(self.n_bytes[x]), stops[:-1])
                if odd == 2:
                    x, ends = np.delete(x, ends), ends - np.arange(len(ends))
                else:
                    ends += 1
                ids.append(x)
                counts.append(np.diff(np.concatenate([[0], ends, [len(x)]])))
        return np.concatenate(ids), np.concatenate(counts)

    @staticmethod
    def _ids(tok, text: str) -> np.ndarray:
        return np.array(tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)


_models: dict[bytes, ChunkTable] = {}


def table_for(content: bytes, kind: type = Model) -> ChunkTable:
    """The worker's table for this model; it outlives a task."""
    if content not in _models:
        _models.clear()
        _models[content] = ChunkTable(kind(content))
    return _models[content]


class ChunkTable:
    def __init__(self, model: Model | ByteModel, max_chunks: int = MAX_CHUNKS):
        self.model, self.max_chunks = model, max_chunks
        self.numbers: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.counts = np.zeros(1 << 14, np.int64)
        self.hits = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _add(self, words: list[str]) -> None:
        n = len(self.numbers)
        ids, counts = self.model.encode_chunks(words)
        total = len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(words) > len(self.counts):
            self.starts, self.counts, self.hits = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.counts, self.hits))
        self.flat[self.used : self.used + total] = ids
        self.counts[n : n + len(words)] = counts
        self.starts[n : n + len(words)] = self.used + np.cumsum(counts) - counts
        self.hits[n : n + len(words)] = 0
        self.used += total
        self.numbers.update(zip(words, range(n, n + len(words)), strict=True))

    def _compact(self) -> None:
        """Keeps the half of the entries that were used most."""
        n, half = len(self.numbers), self.max_chunks // 2
        keep = np.sort(np.argpartition(-self.hits[:n], half)[:half])
        words = list(self.numbers)
        counts, hits = self.counts[keep], self.hits[keep] // 2
        at = np.repeat(self.starts[keep] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        self.used = len(at)
        self.flat[: self.used] = self.flat[at]
        self.counts[:half], self.hits[:half], self.starts[:half] = counts, hits, np.cumsum(counts) - counts
        self.numbers = {words[i]: j for j, i in enumerate(keep.tolist())}

    def _numbers_of(self, words: list[str], times: np.ndarray | None = None) -> np.ndarray:
        """times: how often each word occurs, where they are distinct."""
        if len(self.numbers) >= self.max_chunks:
            self._compact()
        k = np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(k < 0).tolist()
        if at:
            missing = [words[i] for i in at]
            self._add(sorted(dict.fromkeys(missing), key=self.model.odd))
            k[at] = np.fromiter(map(self.numbers.__getitem__, missing), np.int64, len(missing))
        if times is None:
            self.hits[: len(self.numbers)] += np.bincount(k, minlength=len(self.numbers))
        else:
            self.hits[k] += times
        return k

    def _groups(self, texts: Sequence[str | None]) -> Iterator[tuple[list[str], list[int]]]:
        words: list[str] = []
        sizes: list[int] = []
        for t in texts:
            c = self.model.chunks(t or "")
            words += c
            sizes.append(len(c))
            if len(words) >= GROUP_WORDS:
                yield words, sizes
                words, sizes = [], []
        if sizes:
            yield words, sizes

    def encode(self, texts: Sequence[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, as the library's encode() gives them without begin and end."""
        if not self.model.by_chunk:
            for t in texts:
                yield np.array(self.model.encode_text(t or ""), np.int32)
            return
        for words, sizes in self._groups(texts):
            k = self._numbers_of(words)
            counts = self.counts[k]
            ends = np.cumsum(counts)
            at = np.repeat(self.starts[k] - (ends - counts), counts)
            at += np.arange(len(at))
            ids = self.flat[at]
            stop = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
            for i in range(len(sizes)):
                yield ids[stop[i] : stop[i + 1]]

    def encode_array(self, texts: pa.Array, end_id: int) -> Iterator[np.ndarray]:
        """The ids of each text with end_id behind them, for models with split(). Words are told apart in Arrow, so that Python meets each distinct
        one once a call; texts of a few MB in a call bound the arrays in between."""
        if not self.model.by_chunk:
            for t in texts.to_pylist():
                yield np.array([*self.model.encode_text(t or ""), end_id], np.int32)
            return
        if not len(texts):
            return
        parts, sizes = self.model.split(texts)
        coded = parts.dictionary_encode()
        index, distinct = coded.indices.to_numpy(), coded.dictionary
        words = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct), " ")[0].as_py().split(" ")
        if len(words) != len(distinct):  # some hold blanks
            words = distinct.to_pylist()
        k = self._numbers_of(words, np.bincount(index, minlength=len(words)))
        # the distinct words' ids behind one another: a small array to gather from
        own = self.counts[k]
        starts = np.cumsum(own) - own
        near = self.flat[np.repeat(self.starts[k] - starts, own) + np.arange(own.sum())]
        counts = own[index]
        ends = np.cumsum(counts)
        at = np.repeat(starts[index] - (ends - counts), counts)
        at += np.arange(len(at))
        ids = near[at]
        stop = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        out = np.full(len(ids) + len(sizes), end_id, np.int32)
        for i, (a, b) in enumerate(zip(stop, stop[1:], strict=False)):
            out[a + i : b + i] = ids[a:b]
            yield out[a + i : b + i + 1]

    def count(self, texts: Sequence[str | None]) -> list[int]:
        """The number of ids of each text."""
        if not self.model.by_chunk:
            return [len(self.model.encode_text(t or "")) for t in texts]
        out: list[int] = []
        for words, sizes in self._groups(texts):
            k = self._numbers_of(words)
            upto = np.concatenate([[0], np.cumsum(self.counts[k])])
            stop = np.concatenate([[0], np.cumsum(sizes)])
            out += (upto[stop[1:]] - upto[stop[:-1]]).tolist()
        return out
