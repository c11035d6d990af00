"""Odd tables in all stages: names that operators use themselves, dotted names, maps, megabyte texts, repeated and null keys."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from tarnlight.llm.line_dedup import line_duplicates, without_repeated_lines

NAMES = ["removed", "_k", "_id", "_id0", "_hash0", "root", "_row", "row", "hash", "k", "fp", "kept", "score", "predicted", "size", "taken", "_hash", "_draw", "_bucket", "target", "a.b", "wi`th"]
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, m map<string,int>, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in NAMES)


def table(spark, rows):
    return spark.createDataFrame([(d, t, s, "en", len(t or ""), {"x": i}, *(f"{n}{i}" for n in NAMES)) for i, (d, t, s) in enumerate(rows)], SCHEMA)


def plain(docs):
    """Rows as text; maps don't sort."""
    return sorted(str(r) for r in docs.collect())


def prose(rng: random.Random, n: int) -> str:
    return " ".join(f"word{rng.randrange(4000)}" for _ in range(n)) + "."


@pytest.mark.parametrize("k", range(4))
def test_clashing_columns_pass_unchanged(spark, k):
    rng = random.Random(k)
    rows = [(i, "\n".join(prose(rng, 30) for _ in range(3)), rng.choice("ab")) for i in range(12)]
    rows += [(3, rows[3][1], "a"), (50, rows[4][1], "b"), (None, rows[5][1] + "\nmore", None), (60, None, None), (61, "", "a"), (62, (prose(rng, 400) + "\n") * 500, "a")]
    docs = table(spark, rows)
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, "/root/testdata/sf0.001")
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    before = {r["removed"]: r.asDict() for r in docs.collect()}
    for r in out.collect():
        was = before[r["removed"]]
        same = [c for c in docs.columns if c not in (("text", "n_chars") if name == "line dedup" else ())]
        assert all(r[c] == was[c] for c in same)
    assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0


@pytest.mark.parametrize("how", [{}, {"most": 3, "unit": 150}, {"hot_from": 0, "unit": 60}])
def test_lines_of_hot_tokens_against_all_pairs(spark, how):
    """A phrase that starts many lines, families of near copies, lines of one repeated word: units are split by longer keys and by blocks."""
    rng = random.Random(21)
    phrase = [f"p{i}" for i in range(14)]
    lines = []
    for _ in range(40):
        lines.append(phrase + [f"w{rng.randrange(3000)}" for _ in range(rng.choice([2, 4, 20]))])
    for base in ([f"b{i}" for i in range(40)], [f"c{i}" for i in range(12)]):
        for _ in range(40):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(50)}"
            lines.append(w)
    lines += [["a"] * n for n in range(5, 30)] + [["a"] * n + ["z"] for n in range(5, 30)]
    rng.shuffle(lines)
    rows = [(i, "\n".join(" ".join(w) for w in lines[4 * i : 4 * i + 4]), "s") for i in range(len(lines) // 4)]
    items, want = [], {}
    for d, text, _ in rows:
        want[d] = []
        for n, x in enumerate(text.split("\n")):
            w = x.split()
            tokens = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
            if any(5 * len(tokens & other) >= 4 * len(tokens | other) for other in items):
                want[d].append(n)
            items.append(tokens)
    docs = table(spark, rows).repartition(3)
    assert {r["doc_id"]: r["removed"] for r in line_duplicates(docs, **how).collect()} == want


def test_long_texts_are_cut_between_lines(spark):
    rng = random.Random(5)
    long = "\n".join(prose(rng, rng.choice([3, 20])) for _ in range(20_000))  # over two megabytes
    one = prose(rng, 120_000)  # a line of a megabyte
    docs = table(spark, [(1, long, "s"), (2, long + "\nlast line of five words", "s"), (3, one, "s"), (4, one + " end", "s"), (5, "\n\n" + one.upper(), "s")])
    got = {r["doc_id"]: r for r in line_duplicates(docs).collect()}
    assert got[1]["n_lines"] == 20_000 and got[2]["n_removed"] == 20_000 and got[2]["n_lines"] == 20_001
    assert [got[k]["removed"] for k in (3, 4, 5)] == [[], [0], [2]]
    assert {r["doc_id"]: r["text"] for r in without_repeated_lines(docs).collect()}[2] == "last line of five words"
