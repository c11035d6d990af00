from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tarnlight.llm import mph
from tarnlight.llm.packing import pack_documents, planned
from tarnlight.llm.token_count import Counter as TokenCounter
from tarnlight.llm.token_count import token_counts
from tarnlight.llm.token_store import fetch, locate, round_trip, write_store
from tarnlight.llm.vocab import ByteLevelIds, WordIds

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length int, _bucket string"


def odd_texts() -> list[str]:
    rng = random.Random(1)
    parts = ["a", "B", " ", "\n", "'s", "1", "!", "\t", " ", "é", " ", "ab", "\r", "\x1c", "<|endoftext|>", "İ", "ŉ", "漢", "😀", ".", ",", "the"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    return made + ["", "  ", "a\n \nb", "a   b", "x\n\ny \n z", "don't I'LL it's", "a" * 3000, "naïve é ΑΣ ΣΑΣ", "trail ", "\n"]


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_counts_and_ids_are_the_librarys():
    texts = odd_texts()
    for path, code, kind in ((BYTES, "H", ByteLevelIds), (WORDS, "I", WordIds)):
        want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
        ids = kind(path, code)
        assert [np.frombuffer(ids.encode(t), "<u2" if code == "H" else "<u4").tolist() for t in texts] == want
        if kind is ByteLevelIds:
            counter = TokenCounter(path)
            assert [counter.count(t) for t in texts] == [len(x) for x in want]


def test_op1_cases(spark):
    df = spark.createDataFrame([(1, "hello world", 0, ""), (1, "hello world", 0, ""), (None, None, 1, "x"), (2, "", 0, None), (3, "word " * 600, 0, "")], SCHEMA)
    got = sorted((tuple(r) for r in token_counts(df, BYTES).collect()), key=str)
    assert (1, 11, 2, False) in got and got.count((1, 11, 2, False)) == 2 and (None, 0, 0, False) in got
    assert [r[3] for r in got if r[0] == 3] == [True]
    assert token_counts(df.limit(0), BYTES).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_are_exact_and_no_worse_than_best_fit(seed):
    import bisect

    rng = random.Random(seed)
    kinds = [lambda: min(2048, int(rng.lognormvariate(6.5, 1)) + 1), lambda: rng.randint(600, 800), lambda: rng.randint(1, 2048), lambda: rng.choice([700, 2048, 5])]
    histogram = Counter(kinds[seed]() for _ in range(3000))
    plan = planned(dict(histogram), 2048)
    places, ranks = {}, {}
    for length, rank, n, sequence, offset in plan.runs:
        for i in range(n):
            places.setdefault(sequence + i, []).append((offset, length))
            ranks.setdefault(length, []).append(rank + i)
    assert all(sorted(ranks[x]) == list(range(n)) for x, n in histogram.items())
    for found in places.values():
        found.sort()
        assert found[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(found, found[1:])) and sum(found[-1]) <= 2048
    free: list[int] = []
    bins = 0
    for x in sorted(histogram.elements(), reverse=True):
        k = bisect.bisect_left(free, x)
        bins += k == len(free)
        bisect.insort(free, (free.pop(k) if k < len(free) else 2048) - x)
    assert plan.sequences == len(places) <= bins


def test_op3_cases(spark):
    rows = [(1, "a b c", 0, ""), (1, "a b c", 0, ""), (2, None, 0, ""), (None, "", 0, ""), (4, "word " * 5000, 0, "")]
    got = pack_documents(spark.createDataFrame(rows, SCHEMA), WORDS).collect()
    library, want = Tokenizer.from_file(WORDS), Counter()
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            want[doc_id, k // 2048, k, len(ids[k : k + 2048]), crc(ids[k : k + 2048])] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in x) <= 2048 and sorted(x)[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(sorted(x), sorted(x)[1:])) for x in by.values())
    assert pack_documents(spark.createDataFrame([], SCHEMA), WORDS).count() == 0


def test_perfect_hash():
    keys = np.random.default_rng(2).integers(0, 2**63, 20_000).astype(np.uint64)
    raw = mph.dump(keys, {"v": np.arange(20_000, dtype=np.uint32)})
    index = mph.Index(raw, ["v"])
    assert sorted(index.hashed.slots(keys)) == list(range(20_000))
    found, values = index.find(keys)
    assert found.all() and (values["v"] == np.arange(20_000)).all()
    assert index.find(keys ^ np.uint64(1 << 63))[0].sum() == 0
    assert mph.Index(mph.dump(keys[:0], {"v": np.zeros(0, np.uint32)}), ["v"]).find(keys)[0].sum() == 0


def test_op4_round_trip(spark):
    rows = [(5, "five five", 0, ""), (-3, None, 0, ""), (5, "again", 0, ""), (None, "null id", 0, ""), (2**60 + 1, "x" * 500, 0, ""), (5, "five five", 0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    library, at, want = Tokenizer.from_file(BYTES), 0, []
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, round_trip(df, BYTES).collect()), key=str) == sorted(want, key=str)
    store = write_store(df, BYTES, 2)
    one = fetch(store, locate(store, spark.createDataFrame([(2**60 + 1,), (77,)], "doc_id long")), with_ids=True).collect()
    assert len(one) == 1 and np.frombuffer(one[0]["ids"], "<u4").tolist() == library.encode("x" * 500).ids + [2]
    assert round_trip(df.limit(0), BYTES).count() == 0


def test_op4_odd_keys_and_hot_ids(spark):
    """The old stand-in for a null key beside a null key, and an id of many rows that fill several shards."""
    hot = [(7, f"word {i % 40}", 0, "") for i in range(600)] + [(None, None, 0, "") for _ in range(200)]
    rows = hot + [(0x5D1F_22C7_90AB_E34D, "odd", 0, ""), (0, "zero", 0, ""), (-1, "minus", 0, ""), (8, "long text " * 200_000, 0, "")]
    library, at, want = Tokenizer.from_file(BYTES), 0, []
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    df = spark.createDataFrame(rows, SCHEMA).repartition(16)
    assert sorted(map(tuple, round_trip(df, BYTES).collect()), key=str) == sorted(want, key=str)
    store = write_store(df, BYTES, 2)
    assert store.parts.count() == 2
    assert fetch(store, locate(store, spark.createDataFrame([(7,)], "doc_id long"))).count() == 600


@pytest.mark.parametrize("seed", range(3))
def test_large_pieces_stand_in_configurations(seed):
    """Every piece above a quarter of the capacity is placed by a configuration; sequences stay near the lower bound."""
    rng = random.Random(100 + seed)
    histogram = Counter(min(2048, int(rng.lognormvariate(5.5 + seed / 4, 1.2)) + 1) for _ in range(20_000))
    plan = planned(dict(histogram), 2048)
    assert plan.configured == sum(c for n, c in histogram.items() if n > 512)
    assert plan.sequences <= 1.005 * -(-sum(n * c for n, c in histogram.items()) // 2048)
