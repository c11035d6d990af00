from __future__ import annotations

from pyspark.sql import functions as F

from tarnlight.operators import facets
from tarnlight.plans import crawl
from tarnlight.sources.html import parse
from tarnlight.streaming import incremental

PAGE = """<html><head><title>T</title><meta property="og:title" content="OG"></head><body><nav><a href="/x">n</a></nav>
<h1> Binary  search </h1><article class="post"><p>How it works: time complexity</p><pre>a &lt; b</pre><div class="ad">buy</div>
<a href="/learn/next?ref=x#y">next</a><a href="#z">z</a><time datetime="2023-01-02">d</time></article><footer>f</footer></body></html>"""


def test_parse():
    title, content, author, date, links = parse(PAGE, "https://x.org/a/b")
    assert title == "Binary search" and date == "2023-01-02" and author is None
    assert content == "How it works: time complexity ```a < b``` nextzd"
    assert links == ["https://x.org/learn/next?ref=x#y"]
    assert parse("", "")[0] == "Untitled" and parse("<p>loose", "u")[1] == "loose"


def test_crawl(spark):
    fine = PAGE.replace("How it works", "How a binary search works on a graph, explained step by step with an approach")
    pages = spark.createDataFrame([("https://leetcode.com/a", fine), ("https://leetcode.com/b", fine), ("https://leetcode.com/c", "<h1>No</h1>"), ("https://x.org/q", PAGE)], "url string, html string")
    none = spark.createDataFrame([], "content_hash string, url_normalized string")
    found = crawl.crawl(pages, none, F.lit("2024-01-01").cast("timestamp"))
    assert found.articles.count() == 1 and found.signals.count() == 1
    counters = {r["result"]: r["n"] for r in found.counters().collect()}
    assert sum(counters.values()) == 4 and counters["stored"] == 1 and counters["skipped: duplicate"] == 1
    assert {r["url"] for r in found.links.collect()} == {"https://leetcode.com/learn/next", "https://x.org/learn/next"}


def test_facets(spark):
    df = spark.createDataFrame([("https://www.a.org/1",), ("https://a.org/2",), ("https://b.org/1",), ("junk",)], "url string")
    assert [tuple(r) for r in facets.domain_facets(df, 2).collect()] == [("a.org", 2), ("b.org", 1)]
    assert {r["url"] for r in facets.enabled_results(df, ["b.org"]).collect()} == {"https://b.org/1", "junk"}


def test_streamed_index_is_the_batch_index(spark, tmp_path):
    from tarnlight.operators import index

    rows = [(str(i), f"title {i}", "words about hash maps and other things that make this long enough " + str(i), False) for i in range(6)]
    articles = spark.createDataFrame(rows, "id string, title string, content string, is_indexed boolean")
    for k in (0, 1):
        articles.where(F.col("id").cast("int") % 2 == k).write.parquet(f"{tmp_path}/in/{k}")
    articles.where("id = '0'").write.parquet(f"{tmp_path}/in/2")
    stream = spark.readStream.schema(articles.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = incremental.index_stream(stream, f"{tmp_path}/index", f"{tmp_path}/checkpoint", stems=False)
    query.awaitTermination()
    got = incremental.stream_index(spark, f"{tmp_path}/index")
    want = index.build(articles, stems=False)
    assert sorted(map(str, got.terms.collect())) == sorted(map(str, want.terms.collect()))


def test_parts_of_a_page():
    """Authors by rel, class author-name and itemprop, in this order and all of each; the first time element alone; blank code is no code."""
    of = lambda body: parse(f"<article>{body}</article>", "https://x.org/")
    assert of('<b class="author-name"> A </b><i itemprop="author">B</i>')[2] == "A"
    assert of('<i itemprop="author">B</i><meta name="author" content="M">')[2] == "B"
    assert of('<b class="author">C</b>')[2] is None
    assert of('<b class="author-name">C</b><a rel="author">R</a><a rel="author">S</a>')[2] == "RS"
    head = '<meta property="article:published_time" content="2024-02-02">'
    assert of(head + '<time>today</time><time datetime="2020-01-01">x</time>')[3] == "2024-02-02"
    assert of(head + '<time datetime="2020-01-01">x</time>')[3] == "2020-01-01"
    assert of("a<pre> </pre>b<code></code>c")[1] == "a bc" and of("<pre><code> x </code></pre>y")[1] == "```x``` y"
    assert of("a<pre>open")[1] == "a ```open```"
