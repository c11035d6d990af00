"""Small literal inputs and values worked out by hand from the formulas."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarnlight.functions import display, ranking, signals, text, urls
from tarnlight.functions.porter import stem
from tarnlight.operators import frontier, index, robots, tiers
from tarnlight.operators.search import SearchEngine, clamp

def now():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("given, want", [("O(n) B-Tree don't sha256 a--b", ["b-tree", "don't", "sha256"]), ("naïve", ["na", "ve"]), ("", []), (None, [])])
def test_tokens(spark, given, want):
    assert one(spark, text.raw_tokens(F.lit(given).cast("string")))[0] == want


@pytest.mark.parametrize("word, want", [("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("relational", "relat"), ("controll", "control"), ("rate", "rate"), ("is", "is")])
def test_stems(word, want):
    assert stem(word) == want


@pytest.mark.parametrize("n, df, want", [(10, 2, 1.4816045409), (3, 3, 0.1335313926), (1000, 1, 6.5032896712), (5, 0, 0.0)])
def test_idf(spark, n, df, want):
    assert one(spark, ranking.idf(F.lit(n), F.lit(df)))[0] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("args, want", [((1, 2, 100, 120, 10, 2), 2.9338703781), ((0, 5, 300, 120, 10, 2), 2.2619916656), ((1, 0, 50, 100, 3, 3), 0.2543455098)])
def test_bm25_term(spark, args, want):
    assert one(spark, ranking.bm25_term(*map(F.lit, args)))[0] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("age, want", [(0, 1.0), (30, 0.9446214619), (365, 0.5), (730, 0.25), (-3, 1.0)])
def test_decay(spark, age, want):
    day = F.date_sub(F.lit("2024-01-01").cast("date"), age).cast("timestamp")
    assert one(spark, ranking.freshness_decay(day, F.lit(7.0), now()))[0] == pytest.approx(want, abs=1e-9)
    assert one(spark, ranking.freshness_decay(F.lit(None).cast("timestamp"), F.lit(7.0), now()))[0] == 7.0


def test_freshness_buckets(spark):
    ages = [6, 7, 29, 30, 89, 90, 364, 365, 999, 1000]
    df = spark.createDataFrame([(a,) for a in ages], "age int").select(ranking.freshness_bucket(F.date_sub(F.lit("2024-01-01").cast("date"), F.col("age")).cast("timestamp"), now()))
    assert [r[0] for r in df.collect()] == [100, 90, 90, 80, 80, 70, 70, 60, 60, 40]


@pytest.mark.parametrize("signals_, want", [((1.0, 62.0, 95.0, 0.5), 27.25), ((0.5, 62.0, 95.0, 60.0), 32.925)])
def test_fusion_keeps_stored_scales(spark, signals_, want):
    assert one(spark, ranking.fuse(dict(zip(("bm25", "quality", "authority", "freshness"), map(F.lit, signals_)))))[0] == pytest.approx(want)


def test_display_score(spark):
    df = spark.createDataFrame([(x,) for x in (None, 0.0, 0.5, 1.0, 2.0, 30.5, 1000.0)], "s double").select(display.display_score(F.col("s")))
    assert [r[0] for r in df.collect()] == [50, 0, 50, 100, 22, 69, 99]


def test_quality(spark):
    fence, rest = "```x``` ", "time complexity of a graph, explain it"
    cases = [("Title", "- a graph explain efficient", 50), ("Title", fence + "time complexity graph", 55), ("Title", "* item " + fence * 3 + rest, 85), ("", "plain", 0)]
    df = spark.createDataFrame([(t, c) for t, c, _ in cases], "t string, c string").select(signals.quality(F.col("t"), F.col("c")))
    assert [r[0] for r in df.collect()] == [w for *_, w in cases]


def test_readability(spark):
    whole = "The cat sat on the mat. The dog ran to the park! Did you see it? A hash map gives fast lookup for every key in the set."
    assert one(spark, signals.readability(F.lit(whole), nfkc=False))[0] == 96.87
    assert one(spark, signals.readability(F.lit("short"), nfkc=False))[0] == 0


def test_relevance_and_boundaries(spark):
    words = (("heap", 2.2), ("trie", 1.8))
    row = one(spark, signals.relevance(F.lit("heap"), F.lit("heap heap heap heap trie trie heaps"), words), signals.relevance(F.lit(""), F.lit(""), words), text.occurrences(F.lit("éhash hash"), "hash"))
    assert row[0] == 74.18 and row[1] == 0 and row[2] == 2


def test_queue_urls(spark):
    given = {"https://x.org/p/?utm_source=feed#top": "https://x.org/p", "https://x.org/p?page=2&ref=x": "https://x.org/p?page=2", "HTTP://X.org:80/A/": "http://x.org/A", "no url": "no url"}
    df = spark.createDataFrame([(u,) for u in given], "u string").select("u", urls.queue_url(F.col("u")).alias("q"))
    assert {r["u"]: r["q"] for r in df.collect()} == given


def test_admission(spark):
    cases = [("https://own.org/learn/x", None), ("https://own.org/", "root path"), ("https://other.org/learn/x", "unknown host"), ("https://leetcode.com/", None), ("https://leetcode.com/pricing", "generic path"), ("https://medium.com/tag/x", "discarded"), ("ftp://own.org/a", "discarded")]
    df = frontier.admitted(spark.createDataFrame([(u, "www.own.org") for u, _ in cases], "url string, source_host string"))
    found = [r["reject_reason"] for r in df.collect()]
    assert found == [w for _, w in cases]


def test_frontier_counts_add_up(spark):
    links = spark.createDataFrame([("https://leetcode.com/problems/a", "x.org")] * 2 + [("https://leetcode.com/problems/b", "x.org"), ("bad", "x.org"), ("https://a.org/z", "x.org")], "url string, source_host string")
    seen = spark.createDataFrame([("https://leetcode.com/problems/b",)], "url string")
    counts = {r["status"]: r["n"] for r in frontier.insert_counts(frontier.classified(links, seen)).collect()}
    assert counts == {"inserted": 1, "duplicates": 2, "invalid": 1, "discarded": 1}


def test_tiers_take_the_longest_suffix(spark):
    df = tiers.with_tier(spark.createDataFrame([("www.python.org",), ("a.b.python.org",), ("notpython.org",), (None,)], "host string"), "host")
    assert [r["profile"] for r in df.collect()] == ["LANGUAGE_CANONICAL", "LANGUAGE_CANONICAL", "UNKNOWN", "UNKNOWN"]


def test_robots(spark):
    texts = spark.createDataFrame([("https://x.org", "User-agent: *\nDisallow: /a\nAllow: /a/b\nAllow: /e\nDisallow: /e\nCrawl-delay: 2"), ("https://y.org", "User-agent: foo\nDisallow: /")], "origin string, text string")
    pages = spark.createDataFrame([(u,) for u in ("https://x.org/a/x", "https://x.org/a/b/c", "https://x.org/c", "https://x.org/e", "https://y.org/z", "https://z.org/", "https://redis.io/docs", "junk")], "url string")
    got = {r["url"]: (r["allowed"], r["delay"]) for r in robots.crawlable(pages, texts).collect()}
    assert got == {
        "https://x.org/a/x": (False, 2.0), "https://x.org/a/b/c": (True, 2.0), "https://x.org/c": (True, 2.0), "https://x.org/e": (True, 2.0),
        "https://y.org/z": (True, 1.0), "https://z.org/": (True, 1.0), "https://redis.io/docs": (False, 0.0), "junk": (False, 0.0),
    }


def test_dates(spark):
    html = ['<meta property="article:published_time" content="2023-05-06T10:00:00Z">', '<meta content="June 5, 2023" name="date">', '<time datetime="nonsense"> publishedDate: "2020-02-03"', "none"]
    df = spark.createDataFrame([(h,) for h in html], "h string").select(signals.stated_date(F.col("h")))
    assert [r[0] for r in df.collect()] == [dt.date(2023, 5, 6), dt.date(2023, 6, 5), dt.date(2020, 2, 3), None]


def test_snippets(spark):
    long = "hash " + "x" * 400
    row = one(spark, text.snippet(F.lit("  short text "), ["none"]), text.snippet(F.lit(long), ["hashing"]))
    assert row[0] == "short text..." and row[1] == long[:120] + "..."


def test_clamp():
    assert [clamp(x, 1, 50) for x in (0, 999, "x", "7", None)] == [1, 50, 1, 7, 1]


ARTICLES = [("d1", "Hash map basics", "hash map lookup uses a hash function and buckets"), ("d2", "Sorting arrays", "merge sort splits the array and merges sorted halves"), ("d3", "Cache design notes", "an lru cache combines a hash map with a linked list")]


@pytest.fixture(scope="module")
def engine(spark):
    articles = spark.createDataFrame([(i, f"https://x.org/{i}", t, c, None) for i, t, c in ARTICLES], "id string, url string, title string, content string, published_date date")
    none = spark.createDataFrame([], "article_id string, quality_score double, authority_score double, freshness_score double")
    return SearchEngine(index.build(articles, stems=False), articles, none, stems=False)


def test_mini_corpus(engine):
    got = {r["doc_id"]: r for r in engine.scored("hash map", now()).collect()}
    assert set(got) == {"d1", "d3"}
    assert got["d1"]["bm25_raw"] == pytest.approx(1.768202, abs=1e-6) and got["d3"]["bm25_raw"] == pytest.approx(0.915766, abs=1e-6)
    assert (got["d1"]["bm25_normalized"], got["d3"]["bm25_normalized"]) == (1.0, 0.0)


def test_pages_add_up(engine):
    ids = lambda limit, offset: [r["article_id"] for r in engine.search("hash map cache", now(), limit, offset).collect()]
    assert ids(1, 0) + ids(1, 1) == ids(2, 0)
    assert engine.search("absent", now()).count() == 0


def test_response(engine):
    with pytest.raises(ValueError):
        engine.respond("  ", now())
    found = engine.respond("hash", now(), limit=0)
    assert found["total"] == 1 and found["total_matches"] == 2 and "scores" not in found["results"][0]


def test_index_invariants(spark, engine):
    p = engine.index.postings.collect()
    assert all(r["title_tf"] + r["content_tf"] == r["term_frequency"] == len(r["positions"]) and r["positions"] == sorted(r["positions"]) for r in p)
    lengths = {r["doc_id"]: r["doc_length"] for r in engine.index.doc_lengths.collect()}
    assert lengths == {"d1": 11, "d2": 11, "d3": 12}
    again = index.upserted(engine.index, engine.articles, stems=False)
    assert sorted(map(str, again.postings.collect())) == sorted(map(str, p))


def test_saved_index_reads_the_same(spark, engine, tmp_path):
    saved = engine.index.save(str(tmp_path))
    assert sorted(saved.terms.collect()) == sorted(engine.index.terms.collect())


def test_index_of_shared_ids(spark, engine):
    """Rows of one id are one document; the tables, the suggestions and the part that a query reads agree with stored postings."""
    rows = [("d1", "Map", "a hash map"), (None, "Tree", "tree of hash nodes"), ("d1", "Hash map", "list map map"), (None, "List", "tree list"), ("d2", "Sort", "map of lists"), ("d3", None, "- -")]
    articles = spark.createDataFrame([(i, "u", t, c, None) for i, t, c in rows], "id string, url string, title string, content string, published_date date")
    built = index.build(articles, stems=False)
    got = {(r["doc_id"], r["term"]): r for r in built.postings.collect()}
    assert len(got) == built.postings.count() and got["d1", "map"]["positions"] == [0, 1, 102, 103, 104] and got["d1", "map"]["title_tf"] == 2
    stored = index.from_postings(built.postings)
    for name in ("terms", "doc_lengths", "stats"):
        assert sorted(map(str, getattr(built, name).collect())) == sorted(map(str, getattr(stored, name).collect())), name
    of = lambda found: SearchEngine(found, articles, engine.signals, stems=False)
    for query in ("hash", "hash tree", "absent"):
        part = index.for_terms(articles, text.query_terms(query, stems=False), stems=False)
        assert sorted(map(str, of(part).bm25(query).collect())) == sorted(map(str, of(stored).bm25(query).collect()))
        assert of(built).suggest(query, least_idf=0.0).collect() == of(stored).suggest(query, least_idf=0.0).collect()
        part.doc_lengths.unpersist()


@pytest.mark.parametrize("name, exchanged", [("corpus_stats", 0), ("suggest_terms", 0), ("doc_lengths", 0), ("postings", 0), ("search_date_after", 0), ("stemmed_search", 0), ("index_upsert", 0)])
def test_no_shuffle_of_tokens(spark, small, name, exchanged):
    """Tokens of documents are counted in their rows: no exchange deals rows by document and term, but for ids of several rows."""
    from tarnlight import queries

    plan = queries.queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate" in line and "collect_list(position" in line for line in plan.splitlines() if "positions" not in line)
    found = [line for line in plan.splitlines() if "Aggregate [doc_id" in line and "term" in line.split("], [")[0]]
    assert len(found) == exchanged
    spark.catalog.clearCache()


def test_schedule_of_equal_urls(spark, tmp_path):
    """Pages of the same url follow each other by page_id, wherever they lie in the table."""
    from tarnlight import queries

    pages = spark.createDataFrame([(i, "https://x.org/a" if i % 3 else "https://x.org/b", "") for i in range(40, 0, -1)], "page_id long, url string, html string")
    pages.repartition(5, "page_id").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r["start_after"], r["page_id"]) for r in queries.crawl_schedule(spark, str(tmp_path)).collect())
    order = [i for i in range(1, 41) if i % 3] + [i for i in range(1, 41) if not i % 3]
    assert got == [(float(k), i) for k, i in enumerate(order)]


def test_signals_count_once(spark):
    """A text's words and code are counted once however many steps ask for them; blanks change only the length that decides whether a text is rated."""
    plan = lambda c: spark.range(1).select(F.col("id").cast("string").alias("t")).select(c(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(lambda t: signals.popularity(t, F.lit("CANONICAL"), F.lit("DSA"))).count("regexp_extract_all") == 4
    assert "substring" in plan(lambda t: signals.readability(t, nfkc=False))  # no pass over a long text's blanks
    word = "aeb. "
    texts = [word * 30, " \n" * 600 + word * 30, (word + "\t" * 60) * 30, (word + " " * 60) * 15, " " * 2000, word * 20, word * 19 + "aeb. c", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(signals.readability(F.col("t"), nfkc=False)).collect()]
    assert got[0] == got[1] == got[2] > 0 and got[3:6] == [0.0] * 3 and got[6] > 0 and got[7] == 0.0
    counted = spark.createDataFrame([("w " * n + ("<code>x</code>" if code else ""),) for n, code in ((500, 0), (501, 0), (1001, 0), (2001, 0), (3, 1))], "t string")
    assert [r[0] for r in counted.select(signals.popularity(F.col("t"), F.lit("x"), F.lit("y"))).collect()] == [r + 0.0 for r in (0, 6, 12, 20, 8)]


def test_pages_in_small_parts(spark, small):
    """Pages are parsed in parts of a batch, and a crawl normalises each text once, in one Python step."""
    import pyarrow as pa

    from tarnlight.plans import crawl
    from tarnlight.sources import html, tables

    batch = pa.RecordBatch.from_arrays([pa.array(range(450))], names=["n"])
    assert [p.num_rows for p in html._records(batch, 200)] == [200, 200, 50]
    plan = crawl.judged(tables.read(spark, small, "pages"), now())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("MapInArrow") == 1
