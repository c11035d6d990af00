"""URL columns: the three normal forms, what is discarded, and whether a link is worth following."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config

_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, _URL, k)


def is_url(url: Column) -> Column:
    return F.coalesce(url.rlike(_URL) & (_part(url, 2) != ""), F.lit(False))


def hostname(url: Column) -> Column:
    """Lower-cased host, without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(_part(url, 2), "^.*@", ""), r":\d*$", ""))


def bare_host(host: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(host)), r"^www\.", "")


def path(url: Column) -> Column:
    return F.when(_part(url, 3) == "", "/").otherwise(_part(url, 3))


def _origin(url: Column) -> Column:
    """Scheme and authority as browsers write them: lower case, no default port."""
    scheme = F.lower(_part(url, 1))
    authority = F.lower(_part(url, 2))
    authority = F.when(scheme == "http", F.regexp_replace(authority, ":80$", "")).when(scheme == "https", F.regexp_replace(authority, ":443$", "")).otherwise(authority)
    return F.concat(scheme, F.lit("://"), authority)


def queue_url(url: Column, tracking: Sequence[str] = config.TRACKING_PARAMETERS) -> Column:
    """For the queue: no fragment, no tracking parameters, no closing slash; what is no URL stays."""
    pairs = F.split(F.regexp_replace(_part(url, 4), r"^\?", ""), "&")
    rest = F.array_join(F.filter(pairs, lambda p: (p != "") & ~F.element_at(F.split(p, "="), 1).isin(*tracking)), "&")
    whole = F.concat(_origin(url), path(url), F.when(rest == "", "").otherwise(F.concat(F.lit("?"), rest)))
    return F.when(is_url(url), F.regexp_replace(whole, "/$", "")).otherwise(url)


def stored_url(url: Column) -> Column:
    """For storage: without the fragment."""
    return F.when(is_url(url), F.concat(_origin(url), path(url), F.coalesce(_part(url, 4), F.lit("")))).otherwise(url)


def sorted_url(url: Column) -> Column:
    """For comparison: no fragment, parameters sorted by name, lower case, no closing slash."""
    query = F.array_join(F.array_sort(F.split(F.regexp_replace(_part(url, 4), r"^\?", ""), "&")), "&")
    whole = F.concat(_origin(url), path(url), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(is_url(url), F.regexp_replace(F.lower(whole), "/$", "")).otherwise(F.lower(F.trim(url)))


def discarded(url: Column, patterns: Sequence[str] = config.DISCARD_PATTERNS) -> Column:
    """Not http, a host without a dot, or a pattern of what is never an article."""
    web = F.lower(_part(url, 1)).isin("http", "https")
    return ~is_url(url) | ~web | ~F.contains(hostname(url), F.lit(".")) | url.rlike("|".join(f"(?:{p})" for p in patterns))


def medium_article(url: Column) -> Column:
    return path(url).rlike("|".join(f"(?:{p})" for p in config.MEDIUM_ARTICLES))


def reject_reason(url: Column, source_host: Column, authority: Column) -> Column:
    """Why a link is not followed, or null: the first rule that applies. authority: the host's level, null where unknown."""
    host, query = bare_host(hostname(url)), F.coalesce(_part(url, 4), F.lit(""))
    generic = path(url).rlike("|".join(f"(?:{p})" for p in config.GENERIC_PATHS))
    signal = F.concat(path(url), query).rlike("|".join(f"(?:{p})" for p in config.TOPIC_SIGNALS))
    trusted = F.coalesce(authority.isin("CANONICAL", "INSTITUTIONAL", "ESTABLISHED"), F.lit(False))
    return (
        F.when(discarded(url), "discarded")
        .when(F.contains(host, F.lit("medium.com")) & ~medium_article(url), "not an article")
        .when((host != bare_host(source_host)) & authority.isNull(), "unknown host")
        .when(generic, "generic path")
        .when(trusted, F.lit(None).cast("string"))
        .when(path(url) == "/", "root path")
        .when(~signal, "no topic")
    )


def undated_source(url: Column, those: Sequence[str] = tuple(config.UNDATED_SOURCES)) -> Column:
    """Whether pages at this URL never state a date."""
    return F.exists(F.array(*map(F.lit, those)), lambda s: F.contains(url, s))
