"""2. URL filter: rules on host and path, and for the rest logistic regression on hashed character n-grams.

The regression is trained on the small labelled table below. A URL's features are the hashed 3- to 5-grams of its host and,
apart from them, of its path, digits read as one; each part counts with unit length, so a score is one number a host plus
one a path, and each worker keeps those of hosts, which repeat. Weights are a vector of fixed size.

Defined cases: a null url, or one without "://", has an empty host and path and meets no rule; the regression judges it by
its bias; rows that repeat give repeated rows; a url of any length is judged whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .vocab import Pieces

BUCKETS = 1 << 15

#: Labelled URLs: words of hosts and paths that are not wanted, and ordinary ones. Made up for this purpose; none is a host of
#: the test tables.
BLOCKED = """
http://casino-jackpot.example/slots/1 https://www.casino-royal.example/en/77 https://m.online-casino.example/play https://lucky-casino.example/bonus
https://daily-bets.example/odds/12 http://sports-bets.example/live https://best-bets.example/en/9 https://poker-bets.example/table
http://herbal-pills.example/order https://buy-pills.example/en/31 https://pills-shop.example/viagra https://diet-pills.example/offer
http://spam-mill.example/a/1 https://www.spam-links.example/list https://spam-blast.example/en/2 http://link-farm.example/out/55
https://adult-zone.example/video/8 http://adult-cams.example/live https://www.adult-zone.example/en/4 https://xxx-tube.example/watch https://hot-cams.example/chat
https://ads-pixel.example/click?id=1 http://m.ads-pixel.example/en/8 https://ads-server.example/banner https://click-track.example/r/77 https://pop-ads.example/show
http://free-money.example/win https://win-prize.example/claim https://payday-loans.example/apply https://fast-loans.example/en/17
http://crack-keygen.example/download https://warez-crack.example/full https://fake-watches.example/replica https://replica-bags.example/sale
https://malware-drop.example/exe http://phish-login.example/verify https://porn-hub.example/en/5 https://sexy-dates.example/meet https://betting-tips.example/en/3
""".split()
ALLOWED = """
http://tions.example/en/1 https://blog.thing.example/en/7198 https://www.there.example/de/39547.html https://m.thern.example/fr/36675
https://news.city.example/en/articles/2020 https://docs.project.example/guide/start https://wiki.people.example/wiki/history https://learn.school.example/course/4
https://www.library.example/catalog/88 http://museum.example/es/visita https://archive.example/de/1999 https://science.example/en/papers/12
https://forum.garden.example/topic/51 https://www.weather.example/fr/meteo https://recipes.example/en/soup https://travel.example/es/guia
https://music.example/en/album/9 https://health.example/en/advice https://law.example/de/gesetz https://university.example/en/courses
https://code.example/en/tutorial https://www.maths.example/en/theorem https://books.example/fr/livre/3 https://sports.example/en/results
https://thatha.example/en/20117 https://ererst.example/de/5099 https://m.tither.example/es/35310 https://blog.onting.example/fr/11629
https://www.anded.example/de/44607.html http://inghe.example/en/2728.html https://reand.example/es/19975/ https://m.ouwhea.example/en/7059
https://hereat.example/fr/30819/ https://blog.stion.example/de/45348 https://enthe.example/en/24571 https://www.ofthe.example/es/7484/ https://film.example/fr/20768
https://orchard.example/en/12938 https://m.lantern.example/de/873 http://blog.meadow.example/es/330.html https://www.harbour.example/fr/145/ https://pottery.example/en/702
http://m.glacier.example/en/90 https://almanac.example/de/60.html https://blog.violin.example/fr/283/ https://compass.example/en/41 https://www.ererre.example/es/8812/
""".split()

#: Each URL of the tables stands for itself and for its host in these surroundings, which tell nothing: (before, after, path).
SETTINGS = (("", ".org", "/en/1"), ("m.", ".net", "/de/39547.html"), ("blog.", ".com", "/fr/366/"), ("www.", ".net", "/es/7198"), ("blog.", ".org", "/en/24.html"), ("m.", ".org", "/fr/5031"))

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def split_url(url: str) -> tuple[str, str]:
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


_LOWER = {c: c + 32 for c in range(65, 91)}


def buckets(part: str, kind: str) -> np.ndarray:
    """The distinct hashed n-grams of a host (kind h) or path (kind p)."""
    text = f"^{re.sub('[0-9]', '0', part)}$"
    grams = {text[i : i + n] for n in (3, 4, 5) for i in range(len(text) - n + 1)} if part else set()
    return np.array(sorted({zlib.crc32((kind + g).encode()) % BUCKETS for g in grams}), np.int64)


def weight(weights: np.ndarray, part: str, kind: str) -> float:
    at = buckets(part, kind)
    return float(weights[at].sum() / np.sqrt(len(at))) if len(at) else 0.0


def trained(blocked: Sequence[str] = BLOCKED, allowed: Sequence[str] = ALLOWED, ridge: float = 0.03, rounds: int = 25) -> np.ndarray:
    """Weights of the buckets and, last, the bias; positive means block. Ridge-penalised, by Newton steps over the table's rows."""
    table = [(*split_url(u), y) for known, y in ((blocked, 1.0), (allowed, 0.0)) for u in known]
    urls = [row for host, path, y in table for row in [(host, path, y), *((before + host + after, p, y) for before, after, p in SETTINGS)]]
    found = [[buckets(host, "h"), buckets(path, "p")] for host, path, _ in urls]
    used = np.unique(np.concatenate([at for parts in found for at in parts]))  # the others' weights are zero
    x = np.zeros((len(urls), len(used) + 1))
    for row, parts in zip(x, found):
        for at in parts:
            row[np.searchsorted(used, at)] += 1 / np.sqrt(max(1, len(at)))
        row[-1] = 1
    y, alike, f = np.array([label for *_, label in urls]), x @ x.T, np.zeros(len(urls))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        spread = np.maximum(p * (1 - p), 1e-6)
        share = np.linalg.solve(alike + ridge * np.diag(1 / spread), f + (y - p) / spread)
        f = alike @ share
    weights = np.zeros(BUCKETS + 1)
    weights[[*used, BUCKETS]] = x.T @ share
    return weights


def host_and_path(url: Column) -> tuple[Column, Column]:
    found = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(found(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), found(2)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        chosen = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, and score (the regression's, for all urls) of each row of pages."""
    ship(pages.sparkSession)
    weights = trained()
    edge = float(np.log(threshold / (1 - threshold)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts = Pieces(lambda h: weight(weights, h, "h"), 100_000)
        for batch in batches:
            total = np.array([hosts[h] + weight(weights, p, "p") for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]) + weights[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total, pa.float64())], names=[*batch.schema.names, "logit"])

    host, path = host_and_path(F.col("url").cast("string"))
    found = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    found = found.mapInArrow(run, "page_id long, host string, path string, logit double").withColumn("_r", rule_for(F.col("host"), F.col("path"), rules))
    by_score = F.when(F.col("logit") > edge, "block").otherwise("allow")
    return found.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce("_r.verdict", by_score).alias("verdict"), (1 / (1 + F.exp(-F.col("logit")))).alias("score"))
