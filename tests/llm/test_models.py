from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tarnlight.llm.mixing import mix, mixed, targets
from tarnlight.llm.neighbours import nearest
from tarnlight.llm.quality import AdditiveModel, fitted, quality, scores
from tarnlight.llm.url_filter import ALLOWED, BLOCKED, RULES, judged, split_url, trained

DOCS = "doc_id long, text string, source string, size int, score string"


def test_targets():
    goal = targets({"a": 100, "b": 100, None: 100}, (3, 1, 2), 1.5, 2.0)
    assert goal == {"a": 200.0, "b": pytest.approx(250 / 3), None: pytest.approx(500 / 3)}
    assert list(targets({"b": 10, "a": 10, None: 10}, (3, 1, 2), 0.6, 2.0).values()) == pytest.approx([9.0, 3.0, 6.0])
    assert targets({"a": 0, "b": 5}, (1, 1), 1.5, 2.0) == {"a": 0.0, "b": 7.5}


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(1, 30)), rng.choice("abbbbbbc") if i % 11 else None, 0, "") for i in range(900)]
    rows += [(1, None, "a", 0, ""), (2, " \n\t", "a", 0, ""), rows[5], rows[5], (None, "one two", "a", 0, ""), (7, "x", "empty \u00e9", 0, "")]
    df = spark.createDataFrame(rows, DOCS)
    got = mix(df).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mix(df.repartition(5)).collect()))
    sizes, taken = {}, {}
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        key = (r["source_size"], r["target"])
        sizes[key] = sizes.get(key, 0) + r["size"]
        taken[key] = taken.get(key, 0) + r["taken"]
    assert all(abs(taken[k] - k[1]) <= 31 and sizes[k] == k[0] for k in sizes)
    assert sum(taken.values()) <= sum(k[1] for k in sizes) + 1e-6
    back = mixed(df)
    assert back.columns == df.columns and back.count() == sum(r["taken"] // r["size"] for r in got if r["size"])
    assert mix(df.limit(0)).count() == 0 and mixed(df.limit(0)).count() == 0


def test_model_learns_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = AdditiveModel.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9
    assert AdditiveModel.fit(x[:0], y[:0]).score(x).min() > 0.99 and AdditiveModel.fit(x[:5], np.zeros(5)).score(x).max() < 0.01


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"  # 990 of its labels are held out
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r["doc_id"]: r for r in quality(docs, labels).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in rows.items())
    held = [(rows[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if rows[r["doc_id"]]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.98
    model = fitted(docs, labels)
    odd = spark.createDataFrame([(1, None, "s", 0, ""), (None, "", "s", 0, ""), (1, "good " * 20000, "s", 0, ""), (1, None, "s", 0, "")], DOCS)
    found = scores(odd, model, keep=("doc_id", "score", "size"))
    assert found.count() == 4 and {"_keep_score", "_keep_size"} <= set(found.columns)
    assert quality(odd.limit(0), labels.limit(0)).count() == 0 and {r["score"] > 0.9 for r in quality(odd, labels.limit(0)).collect()} == {True}


def slow_rule(host: str, path: str):
    fits = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0]), default=(None, None))


def test_urls(spark):
    urls = ["https://WWW.Example.COM/en/a?x#y", "http://a.example.com/en/1", "http://x.com", "http://x.com/", "https://m.site.net/es/1", "https://netx/es/", "net/es/", None, "", "a://b://c/d", "http://example.com?q/en/", "https://casino-win.example.net/en/1", "https://quiet-garden.example.org/de/3", "http://h\u00d6st.NET/fr/#a"]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] + [(0, urls[0], "h", "r")], "page_id long, url string, host string, rule string")
    got = judged(df).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        host, path = split_url(urls[r["page_id"]] or "")
        rule, verdict = slow_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)
    by = {r["page_id"]: r["verdict"] for r in got}
    assert by[11] == "block" and by[12] == "allow"
    assert judged(df.limit(0)).count() == 0


def test_url_model_generalises():
    """Trained on half of the table, it tells the other half's words of the same kind from ordinary ones."""
    from tarnlight.llm.url_filter import weight

    def score(w, url):
        host, path = split_url(url)
        return weight(w, host, "h") + weight(w, path, "p") + w[-1]

    w = trained(BLOCKED[::2], ALLOWED[::2])
    hits = [score(w, u) > 0 for u in BLOCKED[1::2]] + [score(w, u) <= 0 for u in ALLOWED[1::2]]
    assert sum(hits) / len(hits) > 0.7


def test_nearest(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 1500)] + 0.3 * rng.normal(size=(1500, 16))
    x[100:600] = x[100]  # a third of all rows are one vector
    rows = [(int(i), v.tolist(), 0, 0) for i, v in enumerate(x)]
    odd = [(20_000, None, 0, 0), (20_020, [0.0] * 16, 0, 0), (20_040, [float("nan")] + [1.0] * 15, 0, 0), (20_060, [1.0] * 5, 0, 0), (20_080, [None] + [1.0] * 15, 0, 0), (20_100, [float("inf")] + [1.0] * 15, 0, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, rank int, score int")
    got = {}
    for r in nearest(df, leaves=16, block=200).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        found.sort()
        exact = x @ x[q]
        order = [i for i in np.lexsort((np.arange(1500), -np.round(exact, 9))) if i != q][:20]
        assert [r for r, *_ in found] == list(range(1, 21)) and q not in [v for _, v, _ in found]
        assert all(abs(s - exact[v]) < 1e-9 for _, v, s in found)
        assert [(-round(s, 9), v) for _, v, s in found] == sorted((-round(s, 9), v) for _, v, s in found)
        hits += len(set(order) & {v for _, v, _ in found})
    assert hits / (20 * len(got)) >= 0.9
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>, rank int, score int")
    assert sorted((r["query_id"], r["rank"]) for r in nearest(few).collect()) == [(0, 1), (0, 2)]
    assert nearest(df.limit(0)).count() == 0
