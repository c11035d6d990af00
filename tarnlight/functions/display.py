"""What result lists show: hosts, paths, letters, scores, related queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that bring related queries, in order, and the default.
RELATED = (
    (("lru", "cache"), ("LFU cache", "Redis eviction", "cache invalidation", "distributed cache", "consistent hashing", "write-through vs write-back")),
    (("graph", "bfs", "dfs"), ("topological sort", "Dijkstra algorithm", "Bellman-Ford", "strongly connected components", "minimum spanning tree", "Floyd-Warshall")),
    (("tree", "trie"), ("AVL tree rotations", "Red-Black tree", "segment tree lazy", "binary indexed tree", "suffix array", "B+ tree")),
    (("system", "design"), ("CAP theorem", "database sharding", "load balancing", "message queue patterns", "CQRS pattern", "event sourcing")),
    ((), ("binary search tree", "dynamic programming", "graph algorithms", "system design interview", "hash map internals", "B-tree vs LSM")),
)


def domain(url: Column) -> Column:
    """The host without www.; a URL that can't be parsed stands for itself."""
    return F.coalesce(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", ""), url)


def short_path(url: Column) -> Column:
    """The last two segments of the path."""
    parts = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda x: x != "")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "/")


def letter(url: Column) -> Column:
    first = F.upper(F.substring(domain(url), 1, 1))
    return F.when(F.coalesce(first, F.lit("")) == "", "?").otherwise(first)


def display_score(score: Column) -> Column:
    """A score as a whole percentage: null 50, up to 1 a share, beyond it on a logarithmic scale below 100."""
    up = lambda x: F.floor(x + 0.5).cast("int")
    return F.when(score.isNull(), 50).when(score <= 1, up(score * 100)).otherwise(F.least(F.lit(99), up(20 * F.log(score + 1))))


def related_queries(query: Column) -> Column:
    found = F.array(*map(F.lit, RELATED[-1][1]))
    for words, related in reversed(RELATED[:-1]):
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(F.lower(query), F.lit(word))
        found = F.when(hit, F.array(*map(F.lit, related))).otherwise(found)
    return found
