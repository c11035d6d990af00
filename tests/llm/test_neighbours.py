from __future__ import annotations

from functools import reduce

import numpy as np
import pytest

from tarnlight.llm.neighbours import nearest

SCHEMA = "vec_id long, embedding array<double>"


def dot(v, w) -> float:
    """In the order of components, without the corrections that sum() makes."""
    return reduce(lambda a, x: a + x[0] * x[1], zip(v, w), 0.0)


def by_force(rows, k):
    """Of each query row, in order: ranks, ids and scores of the k nearest other rows."""
    out = []
    for i, (q, v) in enumerate(rows):
        if q is not None and q % 20 == 0:
            others = sorted(((-dot(v, w), d is None, d or 0) for j, (d, w) in enumerate(rows) if j != i))[:k]
            out += [(q, r, None if none else d, -s) for r, (s, none, d) in enumerate(others, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("n, k, scale", [(3, 20, 1.0), (10, 20, 1e-7), (25, 20, 1e9), (4, 2, 1e-7)])
def test_few_vectors_give_whole_results(spark, n, k, scale):
    rng = np.random.default_rng(n)
    rows = [(20 * i if i % 2 else i, [float(x) for x in scale * rng.normal(size=8)]) for i in range(n)]
    got, want = sorted(map(tuple, nearest(spark.createDataFrame(rows, SCHEMA), k=k).collect()), key=str), by_force(rows, k)
    if n <= k + 1:
        assert got == want
    else:  # as many rows, each with its true score, and most of the true neighbours
        true = {(q, d, dot(v, w)) for q, v in rows for d, w in rows}
        assert [g[:2] for g in got] == [w[:2] for w in want] and all((q, d, s) in true for q, _, d, s in got)
        assert len({(q, v) for q, _, v, _ in got} & {(q, v) for q, _, v, _ in want}) >= 0.9 * len(want)


def test_repeated_and_null_ids(spark):
    rng = np.random.default_rng(9)
    v = [[float(x) for x in rng.integers(-3, 4, 4)] for _ in range(12)]
    rows = [(20, v[0]), (20, v[1]), (1, v[2]), (3, v[3]), (20, v[0]), (None, v[4]), (None, v[2]), (40, v[5]), (40, v[5]), (5, v[5])]
    got = sorted(map(tuple, nearest(spark.createDataFrame(rows, SCHEMA).repartition(5), k=4).collect()), key=str)
    assert got == by_force(rows, 4)


def test_vectors_of_several_lengths(spark):
    """A shorter vector has zeros after its end, for which the products of dot() are left out."""
    rng = np.random.default_rng(4)
    rows = [(10 * i, [float(x) for x in rng.integers(1, 9, n)]) for i, n in enumerate((4, 4, 4, 1, 2, 7, 0, 3, 4))]
    odd = [(200, None), (220, [0.0, 0.0]), (240, [1.0, None]), (260, [float("nan")]), (280, [float("inf")]), (300, [])]
    got = sorted(map(tuple, nearest(spark.createDataFrame(rows + odd, SCHEMA), k=20).collect()), key=str)
    assert got == by_force([r for r in rows if r[1]], 20)
    assert nearest(spark.createDataFrame(odd, SCHEMA)).count() == 0
