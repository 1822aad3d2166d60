"""Token counts by rank-synchronous merging of ragged arrays.

Pre-tokens of a batch are held together in one flat array of symbol ids with
row bounds. In a round every row finds its lowest-ranked adjacent pair and
merges all places of that pair at once, left to right; rows without a known
pair are finished, and the surviving symbols are counted. Every symbol of the
vocabulary is made by exactly one merge, so a merge that uses it ranks after
the one that makes it, and merging all places of the lowest pair together gives
what merging them one by one gives.

The vocabulary file is read on each executor from the path given, which must
exist there (files of an installed package); it is never copied. Counts of
words are kept in a bounded cache.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

WORD_END = "</w>"
CACHE = 400_000

#: Unicode white space, as the library's pattern engine has it.
BLANK = "\t-\r \x85\xa0  -     　"
# Fixed value: the split pattern of the vocabulary file.
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{BLANK}\p{{L}}\p{{N}}]+")
#: The same for texts of code points below U+0250 without U+001C..U+001F.
NUMERALS = "\xb2\xb3\xb9\xbc\xbd\xbe"
PLAIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_{NUMERALS}]+|[\d{NUMERALS}]|(?:[^\w\s]|_)+")
#: str.split() also splits at U+001C..U+001F, which the library doesn't.
ODD_BLANK = re.compile("[\x1c-\x1f]")
SPLIT_ON = re.compile(f"[{BLANK}]+")
NOT_PLAIN = re.compile("[\x1c-\x1fɐ-\U0010ffff]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    out = [""] * 256
    for b in shown:
        out[b] = chr(b)
    for i, b in enumerate(hidden):
        out[b] = chr(256 + i)
    return out


class Merger:
    """Counts the symbols that byte-level words keep after all merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.specials = [x["content"] for x in spec["added_tokens"]]
        shown = byte_symbols()
        self.inner = np.array([vocab[c] for c in shown], np.int64)
        self.final = np.array([vocab[c + WORD_END] for c in shown], np.int64)
        self.width = max(vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.made, self.none = made, len(keys)
        # An open-addressed table of pairs, at most a quarter full.
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.slots, self.rank = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        at, left = self.place(keys), np.arange(len(keys))
        while len(left):
            free = self.slots[at[left]] == -1
            self.slots[at[left[free]]] = keys[left[free]]
            won = self.slots[at[left]] == keys[left]
            self.rank[at[left[won]]] = left[won]
            left = left[~won]
            at[left] = (at[left] + 1) & (len(self.slots) - 1)

    def place(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = self.place(key)
        found = self.slots[at]
        out = np.where(found == key, self.rank[at], self.none)
        todo = np.flatnonzero((found != key) & (found != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.slots) - 1)
            found = self.slots[at[todo]]
            same = found == key[todo]
            out[todo[same]] = self.rank[at[todo[same]]]
            todo = todo[~same & (found != -1)]
        return out

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Surviving symbols of each word; an empty one has none."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[flat]
        ends = np.cumsum(sizes)
        symbols[ends[sizes > 0] - 1] = self.final[flat[ends[sizes > 0] - 1]]
        row = np.repeat(np.arange(len(words)), sizes)
        out = sizes.copy()
        rank = self._pair_ranks(symbols, row)
        while len(symbols):
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            low = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(row)])
            live = np.repeat(low < self.none, size)
            if not live.all():  # finished rows leave
                symbols, row, rank = symbols[live], row[live], rank[live]
                low, size = low[low < self.none], size[low < self.none]
                if not len(symbols):
                    break
            hit = rank == np.repeat(low, size)
            # Places of one pair overlap only where it is a symbol twice: in a run of hits every second one counts.
            at = np.flatnonzero(hit)
            start = np.r_[True, at[1:] != at[:-1] + 1]
            since = np.arange(len(at)) - np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
            at = at[since % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            np.subtract.at(out, row[at], 1)
            symbols, row = symbols[keep], row[keep]
            rank = self._pair_ranks(symbols, row)
        return out

    def _pair_ranks(self, symbols: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Rank of the pair that starts at each place; none at a row's end."""
        rank = np.full(len(symbols), self.none, np.int64)
        same = np.flatnonzero(row[1:] == row[:-1])
        rank[same] = self.ranks(symbols[same], symbols[same + 1])
        return rank


class Counter:
    def __init__(self, path: str, cache: int = CACHE):
        self.merger, self.cache, self.limit = Merger(path), {}, cache
        self.special = re.compile("|".join(map(re.escape, sorted(self.merger.specials, key=len, reverse=True)))) if self.merger.specials else None

    def chunks(self, text: str) -> list[str]:
        """Runs between white space of a text without special strings, normalised;
        no pre-token reaches over white space."""
        text = unicodedata.normalize("NFC", text)
        if not text.isascii():
            text = text.replace("Σ", "σ")  # lower case is by character, without the final sigma rule
        text = text.lower()
        return SPLIT_ON.split(text) if ODD_BLANK.search(text) else text.split()

    def split(self, text: str) -> tuple[list[str], int]:
        """(chunks, special strings)."""
        if self.special is None or "<|" not in text:
            return self.chunks(text), 0
        parts = self.special.split(text)
        return [x for part in parts for x in self.chunks(part)], len(parts) - 1

    def count(self, texts: list[str]) -> list[int]:
        split = [self.split(x) for x in texts]
        if len(self.cache) > self.limit:
            self.cache = {}
        known = self.cache
        new = list(set().union(*(x for x, _ in split)) - known.keys())
        if new:
            pieces = [(PIECES if NOT_PLAIN.search(x) else PLAIN).findall(x) for x in new]
            kept = self.merger.counts([x.encode() for one in pieces for x in one])
            upto = np.concatenate([[0], np.cumsum(kept)])[np.cumsum([0, *map(len, pieces)])]
            known.update(zip(new, np.diff(upto).tolist(), strict=True))
        return [sum(map(known.__getitem__, x)) + n for x, n in split]


def token_counts(docs: DataFrame, path: str, limit: int = 2048, step: int = 256) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit.

    A null text counts as an empty one: 0 bytes, 0 tokens. Texts of any length
    are counted whole; repeated rows are counted each.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for part in parts:
            n_bytes, n_tokens = [], []
            for at in range(0, len(part), step):
                texts = [x or "" for x in part.column(1)[at : at + step].to_pylist()]
                n_bytes += [len(x.encode()) for x in texts]
                n_tokens += counter.count(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
