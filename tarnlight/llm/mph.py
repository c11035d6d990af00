"""A minimal perfect hash over 64-bit keys: bit arrays by level, ranks by counting bits; built and asked in whole arrays.

Each level gives every key left over one bit of twice as many; keys alone at their bit are settled there, the others go
to the next level. A key's slot is the number of set bits before its own, so n keys have slots 0..n-1.
"""

from __future__ import annotations

import io

import numpy as np

_STEP, _A, _B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))  # splitmix64's constants
MAGIC = b"TLMPH001"


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """splitmix64 of x plus seed steps: a bijection for each seed."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + _STEP * np.uint64(seed + 1)
        x = (x ^ (x >> np.uint64(30))) * _A
        x = (x ^ (x >> np.uint64(27))) * _B
        return x ^ (x >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1_000_003) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    def __init__(self, bits: list[np.ndarray]):
        self.bits, self.ranks, n = bits, [], 0
        for level in bits:
            self.ranks.append(np.cumsum(level, dtype=np.int64) - level + n)
            n += int(level.sum())
        self.n = n

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, bits = np.unique(keys.astype(np.uint64)), []
        if len(left) != len(keys):
            raise ValueError("keys repeat")
        while len(left):
            size = 2 * len(left) + 1
            at = (mix(left, len(bits)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(alone.astype(np.uint8))
            left = left[~alone[at]]
        return cls(bits)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; a key that was not built in gets any slot, or -1: compare fingerprints."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, (level, ranks) in enumerate(zip(self.bits, self.ranks)):
            at = (mix(keys[left], k) % np.uint64(len(level))).astype(np.int64)
            hit = level[at] == 1
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        return out


def dump(keys: np.ndarray, values: dict[str, np.ndarray]) -> bytes:
    """The index file: levels of bits, then fingerprints and values in slot order."""
    hashed = PerfectHash.build(keys)
    slots = hashed.slots(keys)
    out = io.BytesIO()
    out.write(MAGIC + len(hashed.bits).to_bytes(4, "little"))
    for level in hashed.bits:
        out.write(len(level).to_bytes(8, "little") + np.packbits(level).tobytes())
    for column in [fingerprints(keys), *values.values()]:
        placed = np.empty_like(column)
        placed[slots] = column
        np.lib.format.write_array(out, placed, allow_pickle=False)
    return out.getvalue()


class Index:
    """An index file in memory; `find` answers for whole arrays of keys, in constant time each."""

    def __init__(self, raw: bytes, names: list[str]):
        f = io.BytesIO(raw)
        if f.read(8) != MAGIC:
            raise ValueError("not an index file")
        bits = []
        for _ in range(int.from_bytes(f.read(4), "little")):
            n = int.from_bytes(f.read(8), "little")
            bits.append(np.unpackbits(np.frombuffer(f.read((n + 7) // 8), np.uint8))[:n])
        self.hashed = PerfectHash(bits)
        self.prints, *columns = (np.lib.format.read_array(f, allow_pickle=False) for _ in range(len(names) + 1))
        self.values = dict(zip(names, columns))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Which keys are present, and the present ones' values."""
        if not self.hashed.n:
            return np.zeros(len(keys), bool), {k: v[:0] for k, v in self.values.items()}
        slots = self.hashed.slots(keys)
        found = (slots >= 0) & (self.prints[np.maximum(slots, 0)] == fingerprints(keys))
        return found, {k: v[slots[found]] for k, v in self.values.items()}
