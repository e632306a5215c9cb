"""Encoding whole documents once, and token counts of their sections.

WordEncoder gives exactly what the tokenizer gives for a whole text. Tokenizers that split a text into
words before merging encode every word alike wherever it stands, so the encoder splits texts into words, encodes
each new word once with the tokenizer itself and gathers the rest from a bounded memory. Splitting, hashing and
gathering are array operations over many texts at once: characters have classes, words begin where the class changes,
and a word is known by its length and a 64-bit hash. Texts with characters outside the ranges whose splitting is spelled
out below, and texts that hold a special token's string, go to the tokenizer whole.

Attribution: sections are character spans. A token belongs to the section that holds most of its
characters, the earlier one on a tie ("majority"); or that of its first character ("start"); or each
section gets the token's share by characters ("share"). A token without characters, and one that touches no section, counts for the
section -1. The spans of tokens and sections are both in order, so the interval join is a merge within
each document, done where the document is encoded.

Defined cases: null text counts as empty: one empty section without tokens; repeated rows are counted each for itself; a
null doc_id is kept; very long texts are split into words in pieces, so that memory grows with the text's tokens only; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import in_slices, run_hashes, table

#: The letters, numbers and white space among the characters that are split here (to U+024F and general punctuation).
_L = "A-Za-zªµºÀ-ÖØ-öø-įı-ɏ"
_N = "0-9²³¹¼½¾"
_S = "\\t-\\r \\x85\\xa0"
_PLAIN = "\\x00-\\x1b -įı-ɏ‐-‧‰-⁞"
_SPECIAL = ("<|startoftext|>", "<|endoftext|>")
SPACE, LETTER, NUMBER, OTHER, STRANGE = range(5)
_LAST = 0x205F  # this character and all after it are strange
_CLASS = np.array([SPACE if re.match(f"[{_S}]", c) else LETTER if re.match(f"[{_L}]", c) else NUMBER if re.match(f"[{_N}]", c) else OTHER if re.match(f"[{_PLAIN}]", c) else STRANGE for c in map(chr, range(_LAST + 1))], np.uint8)
#: Words that one encoder remembers (some 40 bytes each, 80 with offsets); it starts anew when they are more.
MOST_WORDS = 1_000_000
#: Characters that are split at a time.
PIECE = 1 << 17


class Grown:
    """An array that grows by doubling; one or two columns."""

    def __init__(self, kind: type, columns: int = 0):
        self.data, self.n = np.zeros((1024, columns) if columns else 1024, kind), 0

    def add(self, rows: np.ndarray) -> None:
        if self.n + len(rows) > len(self.data):
            more = np.zeros((2 * (self.n + len(rows)), *self.data.shape[1:]), self.data.dtype)
            more[: self.n] = self.data[: self.n]
            self.data = more
        self.data[self.n : self.n + len(rows)] = rows
        self.n += len(rows)


class Numbers:
    """Numbers of 64-bit keys in the order in which they are added; a table with open addressing, searched for many keys at once."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1. Key 0 stands for an empty place, so it counts as 1."""
        keys = np.maximum(keys, np.uint64(1))
        mask = np.uint64(len(self.keys) - 1)
        at = keys & mask
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], np.int32(-1))
        left = np.flatnonzero((held != keys) & (held != 0))
        while len(left):
            at[left] = (at[left] + np.uint64(1)) & mask
            held = self.keys[at[left]]
            same = held == keys[left]
            out[left[same]] = self.values[at[left[same]]]
            left = left[~same & (held != 0)]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Adds distinct keys that are not held yet."""
        keys = np.maximum(keys, np.uint64(1))
        while 2 * (self.n + len(keys)) > len(self.keys):
            old, numbers = self.keys[self.keys != 0], self.values[self.keys != 0]
            self.bits += 1
            self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._place(old, numbers)
        self._place(keys, np.arange(self.n, self.n + len(keys), dtype=np.int32))
        self.n += len(keys)

    def _place(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        mask = np.uint64(len(self.keys) - 1)
        at = keys & mask
        while len(keys):
            free = self.keys[at] == 0
            _, lead = np.unique(at[free], return_index=True)
            chosen = np.flatnonzero(free)[lead]
            self.keys[at[chosen]], self.values[at[chosen]] = keys[chosen], numbers[chosen]
            rest = np.ones(len(keys), bool)
            rest[chosen] = False
            keys, numbers, at = keys[rest], numbers[rest], (at[rest] + np.uint64(1)) & mask


def split_words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From lower-cased code points: the class of each, and the starts and ends of the words.

    Words are runs of letters, single numbers, runs of other characters, and the English endings after an apostrophe that
    begins a word ('s 't 'm 'd 're 've 'll).
    """
    kind = _CLASS[np.minimum(codes, _LAST)]
    start = np.ones(len(kind), bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    start &= kind != SPACE
    quotes = np.flatnonzero((codes == ord("'")) & start)
    if len(quotes):
        after = np.concatenate([codes, np.zeros(2, codes.dtype)])
        one, two = after[quotes + 1], after[quotes + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        start[quotes[short | long] + 1] = False
        ends = np.concatenate([quotes[short] + 2, quotes[long] + 3])
        ends = ends[ends < len(kind)]
        start[ends[kind[ends] == LETTER]] = True
    starts = np.flatnonzero(start)
    gap = kind == SPACE
    stops = np.append(starts[1:], len(kind)) if len(starts) else starts
    begun = np.flatnonzero(gap & np.append(True, ~gap[:-1]))  # first gap after each run of words
    where = np.searchsorted(begun, starts)
    ends = np.minimum(stops, np.append(begun, len(kind))[where])
    return kind, starts, ends


class WordEncoder:
    """Ids and character offsets of whole texts by a tokenizer of the lower-casing word BPE family."""

    def __init__(self, path: str, offsets: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer, self.offsets = Tokenizer.from_file(path), offsets
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not suffix:
            raise ValueError("the tokenizer does not mark the ends of words")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known = Numbers()
        self.ids, self.first, self.spans = Grown(np.uint32), Grown(np.int64), Grown(np.int32, 2)
        self.first.add(np.zeros(1, np.int64))

    def _learn(self, words: list[str], together: int = 256) -> None:
        """Encodes words joined by spaces, many at a time; the last token of each is one that ends a word."""
        encode = self.tokenizer.encode_batch if self.offsets else self.tokenizer.encode_batch_fast
        for at in range(0, len(words), together * 64):
            groups = [words[k : k + together] for k in range(at, min(at + together * 64, len(words)), together)]
            for group, got in zip(groups, encode([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(got.ids, np.uint32)
                ends = np.flatnonzero(self.ends_word[ids]) + 1
                if len(ends) != len(group):
                    raise ValueError("a word did not stay one word")
                if self.offsets:
                    begins = np.cumsum([0, *(len(w) + 1 for w in group)])[:-1]
                    self.spans.add(np.array(got.offsets, np.int32).reshape(-1, 2) - np.repeat(begins, np.diff(ends, prepend=0))[:, None].astype(np.int32))
                self.first.add(ends + self.ids.n)
                self.ids.add(ids)

    def _numbers(self, low: str, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The words' numbers in the memory; new words are learned."""
        at = self.known.find(keys)
        if (at < 0).any():
            new, where = np.unique(keys[at < 0], return_index=True)
            if self.known.n + len(new) > MOST_WORDS:
                self._forget()
                new, where = np.unique(keys, return_index=True)
            else:
                where = np.flatnonzero(at < 0)[where]
            self._learn([low[s:e] for s, e in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
            self.known.add(new)
            at = self.known.find(keys)
        return at

    def _piece(self, low: str, counts: list[int]) -> list[tuple[np.ndarray, np.ndarray | None] | None]:
        """Ids and offsets in `low` of the texts of `counts` characters that it joins by spaces; None for a text with a strange character."""
        codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind, starts, ends = split_words(codes)
        stops = np.cumsum(np.array(counts) + 1)
        strange = np.zeros(len(counts), bool)
        strange[np.searchsorted(stops, np.flatnonzero(kind == STRANGE), "right")] = True
        if strange.any():  # their words are not looked up
            keep = ~strange[np.searchsorted(stops, starts, "right")]
            starts, ends = starts[keep], ends[keep]
        if not len(starts):
            none = np.zeros(0, np.uint32), np.zeros((0, 2), np.int64) if self.offsets else None
            return [None if x else none for x in strange.tolist()]
        gap = np.ones(len(codes) + 1, np.int8)
        gap[:-1] = kind == SPACE
        if strange.any():
            inside = np.zeros(len(codes) + 1, np.int32)
            np.add.at(inside, starts, 1)
            np.add.at(inside, ends, -1)
            gap[:-1] |= np.cumsum(inside[:-1]) == 0
        keys = run_hashes(codes, gap[:-1].astype(bool), starts) ^ (ends - starts).astype(np.uint64)
        at = self._numbers(low, keys, starts, ends)
        begin = self.first.data[at]
        tokens = self.first.data[at + 1] - begin
        before = np.cumsum(tokens)
        where = np.repeat(begin - before + tokens, tokens) + np.arange(int(before[-1]))
        ids = self.ids.data[where]
        spans = self.spans.data[where] + np.repeat(starts, tokens)[:, None] if self.offsets else None
        cuts = np.append(0, before)[np.searchsorted(starts, np.append(0, stops))]
        out = []
        for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            out.append(None if strange[k] else (ids[a:b], spans[a:b] - (stops[k] - counts[k] - 1) if self.offsets else None))
        return out

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """For each text its ids (uint32) and, if asked for, the (start, end) of each token in code points."""
        out: list = [None] * len(texts)
        held: list[tuple[int, str]] = []

        def flush() -> None:
            found = self._piece(" ".join(t for _, t in held), [len(t) for _, t in held])
            for (k, _), x in zip(held, found, strict=True):
                out[k] = x or self._whole(texts[k])
            held.clear()

        size = 0
        for k, text in enumerate(texts):
            low = text.lower()
            if any(x in low for x in _SPECIAL):
                out[k] = self._whole(text)
            elif len(low) > PIECE:
                out[k] = self._long(low) or self._whole(text)
            else:
                if size + len(low) > PIECE and held:
                    flush()
                    size = 0
                held.append((k, low))
                size += len(low) + 1
        if held:
            flush()
        return out

    def _long(self, low: str) -> tuple[np.ndarray, np.ndarray | None] | None:
        """A long text in pieces that end at white space."""
        ids, spans, at = [], [], 0
        while at < len(low):
            m = _GAP.search(low, min(len(low), at + PIECE))
            end = m.start() if m else len(low)
            found = self._piece(low[at:end], [end - at])[0]
            if found is None:
                return None
            ids.append(found[0])
            spans += [found[1] + at] if self.offsets else []
            at = end
        return np.concatenate(ids), np.concatenate(spans) if self.offsets else None

    def _whole(self, text: str) -> tuple[np.ndarray, np.ndarray | None]:
        x = self.tokenizer.encode(text, add_special_tokens=False)
        return np.array(x.ids, np.uint32), np.array(x.offsets, np.int64).reshape(-1, 2) if self.offsets else None


_GAP = re.compile(f"[{_S}]")


@lru_cache(maxsize=1)
def encoder(path: str, offsets: bool = False) -> WordEncoder:
    """One encoder in each Python worker, kept over its batches and tasks."""
    return WordEncoder(path, offsets)


def attribute(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str = "majority") -> np.ndarray:
    """Tokens of each section, and last those of none. spans: (start, end) of tokens in order; sections in order, not overlapping."""
    n = len(starts)
    if not n or not len(spans):
        return np.append(np.zeros(n), float(len(spans)))
    a, b = spans[:, 0], spans[:, 1]
    first, last = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")  # sections first..last-1 are touched
    touched = np.where(b > a, np.maximum(last - first, 0), 0)
    token = np.repeat(np.arange(len(a)), touched)
    section = np.arange(touched.sum()) - np.repeat(np.cumsum(touched) - touched, touched) + first[token]
    chars = np.minimum(b[token], ends[section]) - np.maximum(a[token], starts[section])
    out = np.zeros(n + 1)
    if rule == "share":
        np.add.at(out, section, chars / (b - a)[token])
        out[n] = len(a) - out[:n].sum()
    elif rule in ("majority", "start"):
        if rule == "start":
            keep = (starts[section] <= a[token]) & (a[token] < ends[section])
            token, section, chars = token[keep], section[keep], chars[keep]
        order = np.lexsort((section, -chars, token))
        token, section = token[order], section[order]
        lead = np.append(True, token[1:] != token[:-1]) if len(token) else np.zeros(0, bool)
        np.add.at(out, section[lead], 1)
        out[n] = len(a) - lead.sum()
    else:
        raise ValueError(f"no such rule: {rule}")
    return out


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The lines of a text as spans; each holds the line end after it."""
    ends = np.append(np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10) + 1, len(text))
    ends = ends[:-1] if len(ends) > 1 and ends[-2] == len(text) else ends
    return np.append(0, ends[:-1]), ends


def section_counts(docs: DataFrame, path: str, *, rule: str = "majority", text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, section (from 0; -1: outside all), start, end and n_tokens (a double for "share") of every line of every document.

    Null text counts as empty: one empty section without tokens. Section -1 appears only where it has tokens.
    """
    kind = pa.float64() if rule == "share" else pa.int64()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path, True)
        for batch in in_slices(batches, 256):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, parts = [], []
            for key_, text_, (_, spans) in zip(batch.column(0).to_pylist(), texts, known.encode(texts), strict=True):
                starts, ends = line_sections(text_)
                n = attribute(spans, starts, ends, rule)
                rest = int(n[-1] > 1e-9)
                m = len(starts) + rest
                ids += [key_] * m
                parts.append(np.stack([np.arange(m), np.append(starts, [0] * rest), np.append(ends, [len(text_)] * rest), n[:m] if rest else n[:-1]]))
                if rest:
                    parts[-1][0, -1] = -1
            s = np.concatenate(parts, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x.astype(np.int64)) for x in s[:3]), pa.array(s[3] if rule == "share" else s[3].astype(np.int64), kind)], names=["doc_id", "section", "start", "end", "n_tokens"])

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(counted, f"doc_id long, section long, start long, end long, n_tokens {'double' if rule == 'share' else 'long'}")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return section_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLE_SQL: dict[str, str] = {}
