"""Text columns: tokens, stop words, stems, snippets, highlights. Everything but stemming and NFKC is built in."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from .porter import stem

# The white space of web scripts (Java's \s and trim() know less of it), and the pattern of a token.
SPACE = "[\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
TOKEN = r"[a-z0-9]+(?:['\-][a-z0-9]+)*"


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))  # blanks alone are left at the ends


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{SPACE[1:]}+"))


@functools.cache
def stop_words(english: tuple[str, ...] | None = None) -> tuple[str, ...]:
    """English stop words (by default Spark's list) and those of the domain, without the protected terms."""
    english = StopWordsRemover.loadDefaultStopWords("english") if english is None else english
    return tuple(sorted({*english, *config.DOMAIN_STOP_WORDS} - set(config.PROTECTED_TERMS)))


def raw_tokens(text: Column) -> Column:
    """Runs of a-z and 0-9, joined by single ' or -, of 2 to 50 characters, in order."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda x: F.length(x).between(2, 50))


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed(tokens: pd.Series) -> pd.Series:
    """Porter stems of arrays of tokens; stems shorter than two characters are dropped."""
    return tokens.map(lambda row: [s for t in row if len(s := stem(t)) >= 2])


def analyzed(text: Column, stop: Sequence[str] = (), stems: bool = True) -> Column:
    """Index terms of a text, in order: tokens less stop words, stemmed if wanted."""
    found = raw_tokens(text)
    if stop:
        found = F.filter(found, lambda x: ~x.isin(*stop))  # a hash set
    return stemmed(found) if stems else found


def query_terms(query: str, stop: Sequence[str] = (), stems: bool = True) -> list[str]:
    """The distinct terms of a query, by the rules of `analyzed`."""
    words = [w for w in re.findall(TOKEN, query.lower()) if 2 <= len(w) <= 50 and w not in set(stop)]
    if stems:
        words = [s for w in words if len(s := stem(w)) >= 2]
    return list(dict.fromkeys(words))


def snippet(content: Column, terms: Sequence[str], radius: int = config.SNIPPET_RADIUS) -> Column:
    """The surroundings of the earliest place where a term's first four letters occur."""
    places = [F.lit(None).cast("int")] * 2 + [F.nullif(F.locate(t[:4], F.lower(content)), F.lit(0)) for t in terms]
    at = F.least(*places) - 1
    start, end = F.greatest(F.lit(0), at - radius), F.least(F.length(content), at + radius)
    inner = trim(F.substring(content, start + 1, end - start))
    hit = F.concat(F.when(start > 0, "...").otherwise(""), inner, F.when(end < F.length(content), "...").otherwise(""))
    return F.when(at.isNull(), F.concat(trim(F.substring(content, 1, 2 * radius)), F.lit("..."))).otherwise(hit)


def highlight(text: Column, query: str, before: str = "<mark>", after: str = "</mark>") -> Column:
    """The query's words of more than two characters, marked wherever they occur in any case."""
    words = [re.escape(w) for w in query.split() if len(w) > 2]
    return F.regexp_replace(text, f"(?i)({'|'.join(words)})", f"{before}$1{after}") if words else text


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


_nfkc = _nfkc.asNondeterministic()  # so that its result is a column of its own, not inlined where it is used


def nfkc(text: Column) -> Column:
    """A text in NFKC. Made a column once, it can be given to the functions below with nfkc=False."""
    return _nfkc(text)


def lowered(text: Column, nfkc: bool = True) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.lower(_nfkc(text) if nfkc else text)


def normalize(text: Column, nfkc: bool = True) -> Column:
    """NFKC, lower case, single blanks. Without nfkc no Python is involved; it changes ASCII text in nothing."""
    return collapse(lowered(text, nfkc))


def content_hash(content: Column, nfkc: bool = True) -> Column:
    return F.sha2(collapse(F.regexp_replace(normalize(content, nfkc), "<[^>]+>", " ")), 256)


def whole_word(term: str) -> str:
    """The pattern of a term between ASCII word boundaries."""
    left = "(?<![A-Za-z0-9_])" if re.match(r"\w", term, re.A) else "(?<=[A-Za-z0-9_])"
    right = "(?![A-Za-z0-9_])" if re.search(r"\w$", term, re.A) else "(?=[A-Za-z0-9_])"
    return left + re.escape(term).replace(r"\ ", " ") + right


def occurrences(text: Column, term: str) -> Column:
    return F.regexp_count(text, F.lit(whole_word(term)))
