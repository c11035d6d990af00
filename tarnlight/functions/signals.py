"""Quality signals of articles: code blocks, quality, readability, popularity, relevance, dates."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from . import text


def _points(*cases: tuple[Column, float]) -> Column:
    return sum((F.when(c, F.lit(float(v))).otherwise(F.lit(0.0)) for c, v in cases), F.lit(0.0))


def _first(*cases: tuple[Column, float]) -> Column:
    score = F.lit(0.0)
    for condition, value in reversed(cases):
        score = F.when(condition, F.lit(float(value))).otherwise(score)
    return score


def round_half_up(value: Column) -> Column:
    """Two decimals, halves upwards as web scripts round."""
    return F.floor(value * 100 + 0.5) / 100


def code_blocks(content: Column) -> Column:
    found = sum((F.regexp_count(content, F.lit(p)) for p in config.CODE_BLOCKS), F.lit(0))
    return F.when(F.contains(content, F.lit("<")) | F.contains(content, F.lit("```")), found).otherwise(F.when(content.isNotNull(), F.lit(0)))


def is_algorithmic(content: Column) -> Column:
    return content.rlike(f"(?i){config.ALGORITHMIC}")


def explains(content: Column) -> Column:
    return content.rlike(f"(?i){config.EXPLAINS}")


def states_complexity(content: Column) -> Column:
    return content.rlike(f"(?i){config.COMPLEXITY}")


def is_structured(content: Column) -> Column:
    return content.rlike("(?m)" + "|".join(f"(?:{p})" for p in config.STRUCTURED))


def quality(title: Column, content: Column) -> Column:
    title, content = F.coalesce(title, F.lit("")), F.coalesce(content, F.lit(""))
    code = code_blocks(content)
    total = _points(
        (code >= 1, 20), (code >= 2, 10), (code >= 3, 5), (F.length(text.trim(title)) >= 3, 8), (states_complexity(content), 15), (is_algorithmic(content), 12), (explains(content), 8), (is_structured(content), 7)
    )
    return F.least(F.lit(100.0), total)


def readability(content: Column, nfkc: bool = True) -> Column:
    def score(whole: Column) -> Column:
        # a sentence goes from its first character that is no blank to the next stop
        sentences = F.greatest(F.lit(1), F.regexp_count(whole, F.lit(f"[^.!?{text.SPACE[1:-1]}][^.!?]*")))
        words = F.greatest(F.lit(1), text.n_words(whole))
        syllables = F.regexp_count(whole, F.lit("[aeiouy]+"))
        # blanks change none of these counts, only the length, and a start that is long enough settles that
        long = lambda part: F.length(text.collapse(part)) >= 100
        enough = F.when(long(F.substring(whole, 1, 500)), F.lit(True)).otherwise(long(whole))
        counts = F.when(enough, F.struct(sentences.alias("sentences"), words.alias("words"), syllables.alias("syllables")))
        return F.element_at(F.transform(F.array(counts), graded), 1)

    def graded(n: Column) -> Column:
        grade = 0.39 * (n["words"] / n["sentences"]) + 11.8 * (n["syllables"] / n["words"]) - 15.59
        return F.when(n.isNull(), F.lit(0.0)).otherwise(round_half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - grade * 5))))

    # as a lambda's argument a value is computed once
    return F.element_at(F.transform(F.array(text.lowered(content, nfkc)), score), 1)


def popularity(content: Column, authority: Column, primary_domain: Column) -> Column:
    content = F.coalesce(content, F.lit(""))
    known = _first(*((authority == k, v) for k, v in config.AUTHORITY_BONUS.items())) + _first(*((primary_domain == k, v) for k, v in config.DOMAIN_BONUS.items()))
    # as a lambda's argument the counts are computed once; a word and a blank take two characters
    counts = F.struct(F.when(F.length(content) > 1000, text.n_words(content)).otherwise(F.lit(0)).alias("words"), code_blocks(content).alias("code"))
    rated = lambda n: _first((n["words"] > 2000, 20), (n["words"] > 1000, 12), (n["words"] > 500, 6)) + _first((n["code"] >= 3, 15), (n["code"] >= 1, 8))
    total = known + F.element_at(F.transform(F.array(counts), rated), 1) + _points((states_complexity(content), 10), (is_structured(content), 5))
    return F.least(F.lit(100.0), total)


def relevance(title: Column, content: Column, keywords: Sequence[tuple[str, float]] = config.RELEVANCE_KEYWORDS) -> Column:
    """Weighted occurrences of the keywords in a normalised title and content, on a logarithmic scale up to 100."""
    table = F.array(*(F.struct(F.lit(term).alias("term"), F.lit(text.whole_word(term)).alias("pattern"), F.lit(float(weight)).alias("weight")) for term, weight in keywords))
    here = F.filter(table, lambda k: F.contains(title, k["term"]) | F.contains(content, k["term"]))  # few of them
    rated = lambda k: (F.log1p(F.regexp_count(title, k["pattern"]) * 3) + F.log1p(F.regexp_count(content, k["pattern"]))) * k["weight"]
    hits = F.aggregate(here, F.lit(0.0), lambda total, k: total + rated(k))
    return round_half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.log1p(hits) / F.log1p(F.lit(20.0)) * 100)))


def with_relevance(df: DataFrame, keywords: Sequence[tuple[str, float]] = config.RELEVANCE_KEYWORDS, nfkc: bool = True) -> DataFrame:
    """df(title, content, ...) with relevance_score."""
    found = df.withColumn("_title", text.normalize(F.col("title"), nfkc)).withColumn("_content", text.normalize(F.col("content"), nfkc))
    return found.withColumn("relevance_score", relevance(F.col("_title"), F.col("_content"), keywords)).drop("_title", "_content")


def gate_reason(title: Column, content: Column, quality_score: Column, least_quality: Column, relevance_score: Column) -> Column:
    """Why an article is not stored, or null."""
    return (
        F.when(F.length(text.trim(F.coalesce(title, F.lit("")))) < 3, "title")
        .when(F.length(text.trim(F.coalesce(content, F.lit("")))) < 50, "content")
        .when(quality_score < least_quality, "quality")
        .when(relevance_score < 5, "relevance")
    )


#: Date formats beyond ISO that pages use.
DATE_FORMATS = ("MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "d MMM yyyy HH:mm:ss z", "yyyy/MM/dd", "M/d/yyyy")


def parsed_date(value: Column, formats: Iterable[str] = DATE_FORMATS) -> Column:
    """The UTC day of a date in ISO form or one of the formats, or null."""
    plain = F.regexp_replace(value, "^[A-Za-z]{3,9}, ", "")  # a weekday tells nothing
    return F.coalesce(value.try_cast("timestamp"), *(F.try_to_timestamp(plain, F.lit(f)) for f in formats)).cast("date")


def stated_date(html: Column, patterns: Sequence[str] = config.DATE_PATTERNS, window: int = 20_000) -> Column:
    """The first date that the head of a page states, by the patterns in order; what doesn't parse is passed over."""
    head = F.substring(html, 1, window)
    return F.coalesce(*(parsed_date(F.regexp_extract(head, f"(?i){p}", 1)) for p in patterns))


def voted_category(content: Column, categories: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The category most of whose keywords occur, the earliest of equals; null without any."""
    lower = F.lower(content)
    votes = [F.struct(sum((F.contains(lower, F.lit(k)).cast("int") for k in words), F.lit(0)).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, words) in enumerate(categories)]
    best = F.array_max(F.array(*votes))
    return F.when(best["n"] > 0, best["name"])
