"""Token ids of whole texts as the tokenizers library gives them, with each distinct word of a stretch of text tokenised once.

The vocabularies never merge across a blank, so a text's ids are the ids of its words, which repeat. Words are found,
numbered and put together again in whole arrays; each distinct one is tokenised once, runs of letters straight by the
vocabulary's merges. Texts whose words depend on their neighbours (runs of blanks, strings of special tokens) are given to
the library whole. Nothing is remembered from one stretch to the next.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What a task remembers before it starts anew, in entries and in characters of keys: bounds memory, never the result.
CACHE_PIECES, CACHE_CHARS = 150_000, 8 << 20
#: Bytes of text that are taken at once; a longer text is taken alone.
STRETCH = 8 << 20


def resolve(path: str) -> str:
    """The vocabulary file: a path, or the name of a public vocabulary on this machine."""
    if "/" in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


class Pieces(dict):
    """piece -> value, computed on first use by `make`. When full, the pieces of the last round stay at hand for one more."""

    def __init__(self, make: Callable[[str], object], most: int = CACHE_PIECES, chars: int = CACHE_CHARS):
        super().__init__()
        self.make, self.most, self.chars, self.size, self.last = make, most, chars, 0, {}

    def __missing__(self, piece: str):
        value = self.last.get(piece)
        if value is None:
            value = self.make(piece)
        self.size += len(piece)
        if len(self) >= self.most or self.size > self.chars:
            self.last, self.size = (dict(self) if self.size <= 2 * self.chars else {}), len(piece)
            self.clear()
        if len(piece) <= self.chars:
            self[piece] = value
        return value


class Entangled(Exception):
    """A piece that can't be told apart from its neighbours."""


@functools.cache
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(resolve(path))


class Ragged:
    """Arrays of ids of different lengths: all ids, and where each array ends."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray):
        self.ids, self.sizes = ids, sizes
        self.starts = np.cumsum(sizes) - sizes

    @classmethod
    def of(cls, arrays: list[list[int]]) -> Ragged:
        sizes = np.fromiter(map(len, arrays), np.int64, len(arrays))
        return cls(np.fromiter((x for a in arrays for x in a), np.uint32, int(sizes.sum())), sizes)

    def take(self, rows: np.ndarray) -> Ragged:
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[rows] - (ends - sizes), sizes)
        return Ragged(self.ids[at], sizes)

    def then(self, other: Ragged) -> Ragged:
        return Ragged(np.concatenate([self.ids, other.ids]), np.concatenate([self.sizes, other.sizes]))

    def grouped(self, sizes: np.ndarray) -> Ragged:
        """The same ids with `sizes` neighbouring arrays as one."""
        ends = np.concatenate([[0], np.cumsum(self.sizes)])[np.cumsum(sizes)]
        return Ragged(self.ids, np.diff(ends, prepend=0))

    def __len__(self) -> int:
        return len(self.sizes)

    def __getitem__(self, k: int) -> np.ndarray:
        return self.ids[self.starts[k] : self.starts[k] + self.sizes[k]]


PUNCTUATION = ".,;:!?*$%&#"
#: One run of letters to every vocabulary's rules: letters up to U+024F that stay letters when lower-cased.
LETTERS = r"A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}"
#: White space other than blank and newline; blanks that stand at an end of a line or by another; strings that may be special.
TANGLED = r"<\||[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|^[ \n]|[ \n]$|[ \n][ \n]"


class Words:
    """Ids of whole texts. `leads` are the strings that stand for a word's separator, by number (0: blank, 1: none, 2: newline)."""

    #: The texts that are given to the library whole, and whether letters are lower-cased.
    tangled, lower = TANGLED, False
    leads = (" ", "", "\n")

    def __init__(self, path: str):
        from .token_count import byte_symbols

        self.library = library(path)
        self.symbols = dict(enumerate(byte_symbols()))

    def _ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids if text else []

    def _runs(self, runs: pa.StringArray, lead: str) -> Ragged:
        """Runs of letters, straight from the vocabulary's merges: the rules that split texts have nothing to do there."""
        if not len(runs):
            return Ragged.of([])
        merge = self.library.model.tokenize
        text = "\n".join(runs.to_pylist())
        shown = (text.lower() if self.lower else text).encode().decode("latin-1").translate(self.symbols).split(self.symbols[10])
        first = lead.encode().decode("latin-1").translate(self.symbols)
        ids: list[int] = []
        sizes: list[int] = []
        for run in [first + r for r in shown] if first else shown:
            tokens = merge(run)
            sizes.append(len(tokens))
            ids += [t.id for t in tokens]
        return Ragged(np.array(ids, np.uint32), np.array(sizes, np.int64))

    def _new(self, words: pa.StringArray, lead: str) -> Ragged:
        """Ids of distinct words after this lead."""
        core = pc.utf8_rtrim(words, PUNCTUATION)
        simple = pc.match_substring_regex(core, f"^[{LETTERS}]+$").to_numpy(zero_copy_only=False)
        cores = core.filter(pa.array(simple)).dictionary_encode()
        tails = pc.replace_substring_regex(words.filter(pa.array(simple)), f"^[{LETTERS}]+", "").dictionary_encode()
        others = Ragged.of([self._ids(lead + w) for w in words.filter(pa.array(~simple)).to_pylist()])
        runs, ends = self._runs(cores.dictionary, lead), Ragged.of([self._ids(t) for t in tails.dictionary.to_pylist()])
        pairs = np.stack([cores.indices.to_numpy(), tails.indices.to_numpy() + len(runs)], axis=1).astype(np.int64).ravel()
        whole = runs.then(ends).take(pairs).grouped(np.full(len(cores), 2)).then(others)
        place = np.empty(len(words), np.int64)
        place[simple], place[~simple] = np.arange(len(cores)), len(cores) + np.arange(len(others))
        return whole.take(place)

    def _lead(self, words: pa.StringArray, lead: str) -> Ragged:
        return self._new(words, lead)

    def _each(self, words: pa.StringArray, kind: np.ndarray) -> Ragged:
        """Ids of each word with its lead, by those of distinct ones."""
        found, n = words.dictionary_encode(), len(self.leads)
        key = found.indices.to_numpy().astype(np.int64) * n + kind
        place = np.zeros(len(found.dictionary) * n, np.int64)
        place[key] = 1
        store = Ragged.of([])
        for k, lead in enumerate(self.leads):
            wanted = np.flatnonzero(place[k::n])
            place[k::n][wanted] = len(store) + np.arange(len(wanted))
            store = store.then(self._lead(found.dictionary.take(pa.array(wanted)), lead))
        return store.take(place[key])

    def _split(self, texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
        """Words between single blanks and newlines; what stands before each (0: blank, 1: nothing, 2: newline); how many a text has."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        cut = (data == 32) | (data == 10)
        at = np.flatnonzero(cut)
        # every text and every separator begins a word
        begins = np.concatenate([offsets[:-1], at + 1])
        kind = np.concatenate([np.ones(len(texts), np.int8), np.where(data[at] == 10, 2, 0).astype(np.int8)])
        order = np.argsort(begins, kind="stable")
        if (np.diff(offsets) == 0).any():  # of an empty text and what begins at the same byte
            order = np.lexsort((np.concatenate([np.arange(len(texts)), np.searchsorted(offsets, at, side="right") - 1]), begins))
        begins, kind = begins[order], kind[order]
        before = np.concatenate([[0], np.cumsum(cut)])
        starts = (begins - before[begins]).astype(np.int32)
        size = np.bincount(np.searchsorted(offsets, at, side="right") - 1, minlength=len(texts))[: len(texts)] + 1
        packed = data[~cut]
        words = pa.StringArray.from_buffers(len(begins), pa.py_buffer(np.concatenate([starts, [len(packed)]]).astype(np.int32)), pa.py_buffer(packed))
        return words, kind, size

    def _plain(self, texts: pa.StringArray) -> Ragged:
        words, kind, size = self._split(texts)
        return self._each(words, kind).grouped(size)

    def encode_all(self, texts: pa.StringArray, end: int | None = None) -> Ragged:
        """The ids of each text, and the end id after them."""
        tangled = pc.match_substring_regex(texts, self.tangled).to_numpy(zero_copy_only=False)
        if tangled.any():
            plain = self._plain(texts.filter(pa.array(~tangled)))
            whole = Ragged.of([self._ids(t) for t in texts.filter(pa.array(tangled)).to_pylist()])
            place = np.empty(len(texts), np.int64)
            place[~tangled], place[tangled] = np.arange(len(plain)), len(plain) + np.arange(len(whole))
            out = plain.then(whole).take(place)
        else:
            out = self._plain(texts)
        if end is None:
            return out
        places = np.stack([np.arange(len(out)), np.full(len(out), len(out))], axis=1).ravel()
        return out.then(Ragged.of([[end]])).take(places).grouped(np.full(len(out), 2))

    def encode(self, text: str) -> bytes:
        """One text's ids, little-endian unsigned 32-bit."""
        return self.encode_all(pa.array([text], pa.string())).ids.astype("<u4").tobytes()


class ByteLevelIds(Words):
    """Ids of a byte-level vocabulary: a blank belongs to the word after it, a newline stands alone."""

    def __init__(self, path: str, code: str = "I"):
        super().__init__(path)
        self.code, self.newline = code, self._ids("\n")

    def _lead(self, words: pa.StringArray, lead: str) -> Ragged:
        if lead != "\n":
            return self._new(words, lead)
        both = self._new(words, "").then(Ragged.of([self.newline]))
        pairs = np.stack([np.full(len(words), len(words)), np.arange(len(words))], axis=1).ravel()
        return both.take(pairs).grouped(np.full(len(words), 2))

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string())).ids.astype({"H": "<u2", "I": "<u4"}[self.code]).tobytes()


class WordIds(Words):
    """Ids of a vocabulary that drops white space and lower-cases."""

    tangled, lower, leads = r"<\|", True, ("",)

    def __init__(self, path: str, code: str = "I"):
        super().__init__(path)

    def _split(self, texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
        words, kind, size = super()._split(texts)
        return words, np.zeros_like(kind), size


def stretches(texts: pa.StringArray, most: int = STRETCH) -> Iterator[tuple[int, pa.StringArray]]:
    """Slices of about `most` bytes of whole texts, and where they begin."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")))
        yield at, texts.slice(at, to - at)
        at = to
