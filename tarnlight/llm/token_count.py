"""1. Token counts by byte-pair merging over a heap and a linked list; no identifier is emitted.

Each piece of text starts as one symbol a byte. The adjacent pair of lowest rank (leftmost of equals) is popped from a
heap and joined in a linked list until no ranked pair is left; the count is the initial symbols minus the merges.

Defined cases: a null or empty text has 0 bytes and 0 tokens; special tokens' strings inside a text count one token
each; repeated rows give repeated rows; columns besides doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts
from .vocab import Entangled, Pieces, resolve

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones stand for themselves, the rest follow from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many merges the ranks allow in this sequence of symbols."""
    n = len(symbols)
    symbols, after, before = list(symbols), [*range(1, n), -1], list(range(-1, n - 1))
    heap = [(ranks[pair], i, *pair) for i, pair in enumerate(zip(symbols, symbols[1:])) if pair in ranks]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != left or j < 0 or symbols[j] != right:
            continue  # one of the two has been merged meanwhile
        symbols[i], symbols[j] = left + right, ""
        after[i] = k = after[j]
        merges += 1
        if k >= 0:
            before[k] = i
            if (rank := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (rank, i, symbols[i], symbols[k]))
        if (h := before[i]) >= 0 and (rank := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (rank, h, symbols[h], symbols[i]))
    return merges


class Counter:
    """Counts tokens of whole texts; remembers a bounded number of pieces."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        with open(resolve(path), encoding="utf-8") as f:
            spec = json.load(f)
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(left, right): i for i, (left, right) in enumerate(pairs)}
        self.symbols = byte_symbols()
        specials = [t["content"] for t in spec.get("added_tokens") or []]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.words = Pieces(self._word)
        self.spaced = Pieces(lambda p: self._piece(p, " "))
        self.bare = Pieces(lambda p: self._piece(p, ""))

    def _word(self, word: str) -> int:
        raw = word.encode()
        return len(raw) - merged([self.symbols[b] for b in raw], self.ranks)

    def _whole(self, text: str) -> int:
        return sum(map(self.words.__getitem__, self.split(text)))

    def _piece(self, piece: str, lead: str) -> int:
        if not piece or piece[0].isspace():
            raise Entangled
        return self._whole(lead + piece)

    def _line(self, line: str) -> int:
        if not line:
            return 0
        head, *tail = line.split(" ")
        return self.bare[head] + sum(map(self.spaced.__getitem__, tail))

    def _plain(self, text: str) -> int:
        try:
            lines = text.split("\n")
            if len(lines) > 1 and any(not x or x[-1].isspace() for x in lines):
                raise Entangled  # runs of white space are split by what follows them
            return sum(map(self._line, lines)) + (len(lines) - 1) * self.words["\n"]
        except Entangled:
            return self._whole(text)

    def count(self, text: str) -> int:
        if self.special is None or "<|" not in text:
            return self._plain(text)
        parts = self.special.split(text)
        return sum(map(self._plain, parts)) + len(parts) - 1


@functools.cache
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, vocab: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row of docs. One narrow pass: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocab).count
        for batch in batches:
            found = batch.column("text").to_pylist()
            tokens = [count(t) for t in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in found], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return texts(docs).mapInArrow(run, SCHEMA)
