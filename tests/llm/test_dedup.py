from __future__ import annotations

import hashlib
import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from xxhash import xxh64_intdigest

from tarnlight.llm.components import components
from tarnlight.llm.exact_dedup import exact_duplicates, msd_groups
from tarnlight.llm.line_dedup import line_duplicates, without_repeated_lines
from tarnlight.llm.simhash import near_duplicates, one_of_each_group, trie_join

SCHEMA = "doc_id long, text string, fp int, prefix string"


def roots(n: int, links) -> list[int]:
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(x) for x in range(n)]


def test_msd_groups():
    rng = random.Random(3)
    values = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(400)] + [b"x" * 5000, b"x" * 5001, b"x" * 5000]
    want = {}
    for i, v in enumerate(values):
        want.setdefault(v, []).append(i)
    assert sorted(map(sorted, msd_groups(values))) == sorted(want.values())


@pytest.mark.parametrize("depth, crowd", [(64, 2000), (2, 1)])
def test_exact_duplicates(spark, depth, crowd):
    rng = random.Random(4)
    rows = [(i, rng.choice(["aaaa", "aaab", "a", None, "", "common start " + "x" * rng.randint(0, 3)]), 0, "") for i in range(60)] + [(None, "z", 0, ""), (7, "z", 0, ""), (7, "z", 0, ""), (None, "only", 0, "")]
    groups: dict[str, list] = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(text or "", []).append(doc_id)
    got = exact_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(7), depth, crowd).collect()
    want = sorted(((d, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in rows), key=str)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + rng.randrange(1, 30)) for _ in range(40)] + [(200, 201), (201, 200), (300, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = roots(400, links)
    assert all(got.get(x, x) == want[x] for x in range(400))


@pytest.mark.parametrize("crowd", [4000, 30])
def test_trie_join(spark, crowd):
    rng = random.Random(6)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values)[:20]:
        for _ in range(25):
            v ^= 1 << rng.randrange(64)
            v ^= rng.choice([0, 1 << rng.randrange(64), 1 << rng.randrange(64) | 1 << rng.randrange(64)])
            values.add(v)
    values = np.array(sorted(values), np.uint64)
    near = [(a, b) for a, b in combinations(range(len(values)), 2) if (int(values[a]) ^ int(values[b])).bit_count() <= 2]
    links = trie_join(spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "fp long"), 2, crowd).collect()
    at = {int(v): i for i, v in enumerate(values.view(np.int64))}
    found = [(at[r["u"]], at[r["v"]]) for r in links]
    assert all((int(values[a]) ^ int(values[b])).bit_count() <= 2 for a, b in found)
    assert roots(len(values), found) == roots(len(values), near)


def slow_fingerprint(text: str) -> int:
    words = [w for w in "".join(c if c not in "\x20\t\n\x0b\x0c\r" else " " for c in text).translate({c: c + 32 for c in range(65, 91)}).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(200)]
    base = [[rng.choice(words) for _ in range(250)] for _ in range(12)]
    rows = [(10 * i + k, " ".join(w if k == 0 or rng.random() > 0.004 else "Edit" for w in b), 0, "") for i, b in enumerate(base) for k in range(4)]
    rows += [(500, None, 0, ""), (501, " \n", 0, ""), (502, "two words", 0, ""), (503, "Ünï ß É", 0, ""), (3, rows[3][1], 0, ""), (None, "no id here", 0, "")]
    prints = [slow_fingerprint(t or "") for _, t, *_ in rows]
    root = roots(len(rows), [(a, b) for a, b in combinations(range(len(rows)), 2) if (prints[a] ^ prints[b]).bit_count() <= 2])
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(r) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted(((d, f"{p:016x}", least[root[i]]) for i, ((d, *_), p) in enumerate(zip(rows, prints))), key=str)
    kept = one_of_each_group(df, width=3, budget=2).collect()
    assert len(kept) == len(set(root)) and kept[0].asDict().keys() == {"doc_id", "text", "fp", "prefix"}
    assert near_duplicates(df.limit(0)).count() == 0 and one_of_each_group(df.limit(0)).count() == 0


def test_line_dedup_against_all_pairs(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 5, 12, 30, 60]))) for _ in range(30)]

    def line() -> str:
        if rng.random() < 0.3:
            return rng.choice(["", "  ", " ".join(rng.choice(words) for _ in range(20))])
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 1, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(words)
        return " ".join(w)

    rows = [(i, "\n".join(line() for _ in range(rng.randint(1, 8))), i, "p") for i in range(120)] + [(None, "w1 w2\nw1 w2", 0, ""), (900, None, 0, ""), (4, "another w1 w2 text", 0, "")]
    items = []
    for k, (d, text, *_) in enumerate(rows):
        for n, x in enumerate((text or "").split("\n")):
            if t := x.lower().split():
                items.append(((d is not None, d or 0, k, n), k, n, frozenset(tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4)))))
    items.sort(key=lambda x: x[0])
    want: dict[int, list[int]] = {k: [] for k in range(len(rows))}
    for b, (_, k, n, tokens) in enumerate(items):
        if any(5 * len(tokens & other) >= 4 * len(tokens | other) for *_, other in items[:b]):
            want[k].append(n)
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)  # rows that share an id in the order given
    got = sorted(((r["doc_id"], r["removed"], r["n_removed"]) for r in line_duplicates(df).collect()), key=str)
    assert got == sorted(((rows[k][0], want[k], len(want[k])) for k in want), key=str)
    texts = sorted((r["text"] or "" for r in without_repeated_lines(df).collect()))
    assert texts == sorted("\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in want[k]) for k, (_, t, *_) in enumerate(rows))
    assert line_duplicates(df.limit(0)).count() == 0


def test_line_dedup_of_crowded_tokens_in_many_tasks(spark):
    """30 classes share a phrase that is rarer than the rest of them, unlike each other but for two; each line is in several input partitions."""
    rng = random.Random(11)
    phrase = " ".join(f"p{i}" for i in range(12))
    common = [" ".join(f"c{c}x{i}" for i in range(40)) for c in range(30)]
    lines = [f"{phrase} {x}" for x in common]
    lines.append(lines[9].replace("c9x39", "other"))
    rows = [(100 * part + k, lines[c], 0, "") for part in range(4) for k, c in enumerate(rng.sample(range(31), 31))]
    tokens = [frozenset(tuple(x.split()[i : i + 5]) for i in range(48)) for x in lines]
    want, kept = {}, []
    for d, text, *_ in rows:
        t = tokens[lines.index(text)]
        want[d] = int(any(5 * len(t & other) >= 4 * len(t | other) for other in kept))
        kept.append(t)
    assert sum(not gone for gone in want.values()) == 30
    rows += [(1000 + c, "\n".join([x] * 300), 0, "") for c, x in enumerate(common)]
    want |= {1000 + c: 299 for c in range(30)}
    rows = rows[:31] + rows[124:] + rows[31:124]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "25")
    try:
        got = line_duplicates(spark.createDataFrame(rows, SCHEMA), most=1).collect()
    finally:
        spark.conf.set(key, before)
    assert {r["doc_id"]: r["n_removed"] for r in got} == want


def test_near_dedup_stage_against_all_pairs(spark):
    """Pairs of all similarities from 0.5 to 1, in groups of two: those at 0.8 or more are found, the others stay."""
    import corpus_pipeline

    rng = random.Random(12)
    rows, similar = [], []
    for k in range(300):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 120, 400]))]
        other = list(words)
        for _ in range(rng.randint(0, max(1, len(words) // 25))):
            other[rng.randrange(len(other))] = f"e{rng.randrange(5000)}"
        rows += [(2 * k, " ".join(words), 0, ""), (2 * k + 1, " ".join(other), 0, "")]
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (words, other))
        similar.append(5 * len(a & b) >= 4 * len(a | b))
    kept = {r["doc_id"] for r in corpus_pipeline.simhash_stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert all(2 * k in kept for k in range(300)) and all(2 * k + 1 in kept for k in range(300) if not similar[k])
    found = [2 * k + 1 not in kept for k in range(300) if similar[k]]
    assert 100 < len(found) < 250 and all(found)


@pytest.mark.parametrize("how", [{}, {"most": 200, "unit": 3000, "hot_from": 5}, {"unit": 3000}])
def test_near_dedup_of_large_groups_against_all_pairs(spark, how):
    """Chains of edits, a large group, a passage that unlike texts share, short, empty, null and repeated texts, a repeated id: the groups are those of all pairs."""
    from tarnlight.llm.similar import one_of_each_similar

    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(4000)}"
    passage, rows = [word() for _ in range(60)], []
    for size in (90, 1, 40, 3):
        words = [word() for _ in range(80)]
        for _ in range(size):
            copy = list(words)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(80)] = word()
            rows.append(" ".join(copy))
    chain = [word() for _ in range(100)]
    for _ in range(30):
        for _ in range(rng.randint(0, 3)):
            chain[rng.randrange(100)] = word()
        rows.append("\n".join(chain))
    rows += [" ".join(passage + [word() for _ in range(rng.choice([10, 20, 120]))]) for _ in range(60)]
    rows += ["", None, " \n ", "two words", "Two  WORDS", "two words more", rows[5], rows[5].upper()]
    order = rng.sample(range(len(rows)), len(rows))
    table = [(d, rows[k], k, "p") for d, k in enumerate(order)] + [(3, rows[order[3]], 9, "q"), (None, rows[0], 0, "r"), (None, "an id that is null", 0, "r")]
    split = [(t or "").lower().split() for _, t, *_ in table]
    sets = [{tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} if x else set() for x in split]
    similar = [(a, b) for a, b in combinations(range(len(table)), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    root = roots(len(table), similar)
    groups = {r: [table[i][0] for i in range(len(table)) if root[i] == r] for r in root}
    want = sorted((min((d for d in g if d is not None), default=None) for g in groups.values()), key=str)
    got = sorted((r["doc_id"] for r in one_of_each_similar(spark.createDataFrame(table, SCHEMA).repartition(6), **how).collect()), key=str)
    assert got == want
    assert len(groups) < len(table) - 100


def test_near_dedup_of_loose_fingerprints_against_all_pairs(spark):
    """At 24 bits the tries chain unlike texts: where such a link fails the check, pairs of its component are found all the same."""
    test_near_dedup_of_large_groups_against_all_pairs(spark, {"budget": 24})


def test_pipeline_near_dedup_takes_close_fingerprints_from_the_tries(spark, monkeypatch):
    """Copies with other line breaks and an edited word outlast the line dedup. Those within 3 bits come by the tries alone, the others by shingles."""
    import corpus_pipeline
    from tarnlight.llm import similar

    rng = random.Random(31)
    rows, close = [], set()
    for k in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(500)]
        other = [f"e{k}" if i == 250 else w for i, w in enumerate(words)]
        rows += [(2 * k + side, "\n".join(" ".join(x[i : i + n]) for i in range(0, 500, n)), 0, "") for side, x, n in ((0, words, 7), (1, other, 11))]
        a, b = (similar.fingerprint(t.encode(), 5) for _, t, *_ in rows[-2:])
        if 0 < (a ^ b).bit_count() <= 3:  # equal ones need no trie
            close.add(2 * k + 1)
    assert 10 < len(close) < 50
    docs = corpus_pipeline.lines_stage(spark, spark.createDataFrame(rows, SCHEMA), "")
    first = {2 * k for k in range(60)}
    kept = lambda: {r["doc_id"] for r in corpus_pipeline.simhash_stage(spark, docs, "").collect()}
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == {d: t for d, t, *_ in rows}
    assert kept() == first
    monkeypatch.setattr(similar, "trie_join", lambda values, *how: values.selectExpr("fp AS u", "fp AS v").where("false"))
    assert kept() == first | close


def test_rarity_counters_grow_with_the_texts():
    """Counters that grow with the texts keep a shared passage last in the order of shingles, where few of fixed number let it come early."""
    from tarnlight.llm import line_dedup as ld
    from tarnlight.llm import similar

    assert similar.counters_for(0) == ld.COUNTERS and similar.counters_for(10**12) == similar.MOST_COUNTERS
    assert similar.counters_for(4 * 10**9) == 4 * similar.counters_for(10**9) > 4 * ld.COUNTERS
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(12)]
    texts = [" ".join([*(f"w{rng.randrange(10**9)}" for _ in range(60)), *passage]).encode() for _ in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array([t.decode() for t in texts]), pa.array(range(400), pa.int64()), pa.array(range(400), pa.int64())], names=["text", "doc_id", "row"])
    early = {}
    for n in (1 << 10, 1 << 21):
        out = pa.Table.from_batches(similar._hashed(iter([batch]), 5, n)).to_pandas()
        parts = [next(similar._rarity((k,), iter([g]), n)) for k, g in out[out["part"].notna()].groupby("part")]
        assert sum(p["row"].iloc[0] for p in parts) == 400 * 68
        rarity = np.frombuffer(b"".join(p["counts"].iloc[0] for p in parts), np.uint8)
        assert len(rarity) == n
        blocks = ld._prefixes(iter([batch]), 5, 4, 5, rarity, 128, 1, whole=True)
        tokens = np.concatenate([np.frombuffer(b, ld._POSTING) for r in blocks for b in r.column("postings").to_pylist()])["token"]
        early[n] = len(tokens) - len(np.unique(tokens))
    assert early[1 << 21] == 0
