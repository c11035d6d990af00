"""9. Quality classifier: a generalised additive model with pairwise interactions, boosted in cycles over shallow trees.

Each feature is cut into bins by its quantiles. Round by round, every feature in turn gets a tree of four leaves fitted to
the gradient of the logistic loss, added to the feature's lookup table; afterwards the pairs of features that explain most
of what remains get tables of their own, from trees that split on both. A score is the logistic of a sum of table entries,
looked up for whole batches at once.

The model is fitted on the driver on at most `most_labels` labelled documents, drawn by a hash of their ids; the features of
a document depend on its whole text and nothing else.

Defined cases: a null text is empty, and scored like any text; documents with several labels count with the least; labels
other than 0 and 1 or of documents not in docs don't count; if what remains has one class or none, every score is that
class, or 1; a null doc_id is not held out; of rows that share a labelled doc_id one is learnt from; a text of any length is
scored whole, in about twenty times its size; other columns, whatever their names and types, are ignored or carried unseen;
an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import ship
from .common import carried, quoted, texts, uncarried

FEATURES = ("log_bytes", "log_words", "word_length", "upper", "digits", "punctuation", "symbols", "stops", "lines", "distinct_words", "repeats", "distinct_lines", "compression")
_UPPER, _DIGITS, _PUNCTUATION = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", bytes(b for b in range(33, 127) if not chr(b).isalnum())
_SYMBOLS, _STOPS = b"!|#$%&*<>{}=~^_@\\", b".?:;,"


def features(text: bytes) -> tuple[float, ...]:
    n, words, lines = max(1, len(text)), text.split(), text.split(b"\n")
    k = max(1, len(words))
    share = lambda those: (len(text) - len(text.translate(None, those))) / n
    return (
        math.log1p(len(text)), math.log1p(len(words)), n / k, share(_UPPER), share(_DIGITS), share(_PUNCTUATION), share(_SYMBOLS), share(_STOPS),
        len(lines) / k, len(set(words)) / math.sqrt(k), sum(map(eq, words, words[1:])) / k, len(set(lines)) / len(lines), len(zlib.compress(text, 1)) / n,
    )


#: Texts whose features are taken at once.
ROWS = 500


def _matrix(texts: pa.Array) -> np.ndarray:
    """Features of texts (null: empty), a row each; few are held as Python objects at a time."""
    out = np.zeros((len(texts), len(FEATURES)))
    for at in range(0, len(texts), ROWS):
        for k, text in enumerate(texts.slice(at, ROWS).cast(pa.binary()).to_pylist(), at):
            out[k] = features(text or b"")
    return out


def featured(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the columns named, and x (the features)."""
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("text"))
            own = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", *more)] + [own], names=["doc_id", *more, "x"])

    return texts(docs, *more).mapInArrow(run, ", ".join(["doc_id long", *(f"{c} {kinds[c]}" for c in more), "x array<double>"]))


def _leaves(g: np.ndarray, h: np.ndarray, least: float, depth: int) -> np.ndarray:
    """The values of a tree on the bins of one feature, by gradient and hessian sums; splits keep `least` hessian aside."""
    value = np.full(len(g), g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 2:
        return value
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + 1) + gr**2 / (hr + 1), -1.0)
    at = int(np.argmax(gain))
    if gain[at] <= g.sum() ** 2 / (h.sum() + 1) + 1e-9:
        return value
    return np.concatenate([_leaves(g[: at + 1], h[: at + 1], least, depth - 1), _leaves(g[at + 1 :], h[at + 1 :], least, depth - 1)])


def _corners(g: np.ndarray, h: np.ndarray, least: float) -> tuple[np.ndarray, float]:
    """The best tree on two features' bins: a split on each, four leaves; its values and gain."""
    sg, sh = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)
    a, b = sg[:-1, :-1], sh[:-1, :-1]
    if not a.size:
        return np.zeros_like(g), 0.0
    quads = [(a, b), (sg[:-1, -1:] - a, sh[:-1, -1:] - b), (sg[-1:, :-1] - a, sh[-1:, :-1] - b)]
    quads.append((sg[-1, -1] - a - quads[1][0] - quads[2][0], sh[-1, -1] - b - quads[1][1] - quads[2][1]))
    gain = sum(np.where(y >= least, x**2 / (y + 1), 0) for x, y in quads)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty_like(g)
    for (x, y), rows, cols in zip(quads, (slice(None, i + 1), slice(None, i + 1), slice(i + 1, None), slice(i + 1, None)), (slice(None, j + 1), slice(j + 1, None)) * 2):
        out[rows, cols] = x[i, j] / (y[i, j] + 1) if y[i, j] >= least else 0.0
    return out, float(gain[i, j])


@dataclass
class AdditiveModel:
    """bias, and for each feature its bin edges and table; tables of pairs of features on coarser bins."""

    bias: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 6, rate: float = 0.15, least: float = 3.0) -> AdditiveModel:
        """Deterministic in the rows' order."""
        if not len(y) or y.min() == y.max():
            return cls(30.0 if not len(y) or y[0] else -30.0)
        model = cls(float(np.log(y.mean() / (1 - y.mean()))))
        quantiles = lambda column, n: np.unique(np.quantile(column, np.linspace(0, 1, n + 1)[1:-1]))
        model.edges, model.coarse = [quantiles(c, bins) for c in x.T], [quantiles(c, 8) for c in x.T]
        fine = [np.searchsorted(e, c, side="right") for e, c in zip(model.edges, x.T)]
        wide = [np.searchsorted(e, c, side="right") for e, c in zip(model.coarse, x.T)]
        model.tables = [np.zeros(len(e) + 1) for e in model.edges]
        score = np.full(len(y), model.bias)
        for _ in range(rounds):
            for table, at in zip(model.tables, fine):
                p = 1 / (1 + np.exp(-score))
                step = rate * _leaves(np.bincount(at, y - p, len(table)), np.bincount(at, p * (1 - p), len(table)), least, 2)
                table += step
                score += step[at]
        sizes = [len(e) + 1 for e in model.coarse]

        def tree(a: int, b: int) -> tuple[np.ndarray, float, np.ndarray]:
            p, at = 1 / (1 + np.exp(-score)), wide[a] * sizes[b] + wide[b]
            cells = (sizes[a], sizes[b])
            return *_corners(np.bincount(at, y - p, sizes[a] * sizes[b]).reshape(cells), np.bincount(at, p * (1 - p), sizes[a] * sizes[b]).reshape(cells), least), at

        best = sorted(itertools.combinations(range(x.shape[1]), 2), key=lambda ab: -tree(*ab)[1])[:n_pairs]
        model.pairs = {ab: np.zeros((sizes[ab[0]], sizes[ab[1]])) for ab in best}
        for _ in range(pair_rounds):
            for ab, table in model.pairs.items():
                step, _, at = tree(*ab)
                table += rate * step
                score += rate * step.ravel()[at]
        return model

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for edges, table, column in zip(self.edges, self.tables, x.T):
            total += table[np.searchsorted(edges, column, side="right")]
        for (a, b), table in self.pairs.items():
            total += table[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-total))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, most_labels: int = 20_000) -> AdditiveModel:
    """The model of the labelled documents that aren't held out, at most most_labels of them."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality IN (0, 1) AND doc_id IS NOT NULL")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    drawn = known.orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(most_labels)
    # one row a doc_id, that of the least hash of its text: rows that repeat an id can't multiply
    of = texts(docs).join(F.broadcast(drawn), "doc_id")  # bounded by most_labels
    first = of.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "quality")).alias("r"))
    chosen = first.select("doc_id", "r.text", "r.quality")
    rows = featured(chosen, "quality").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([r["x"] for r in rows], float).reshape(-1, len(FEATURES))
    return AdditiveModel.fit(x, np.array([r["quality"] for r in rows], float))


def scores(docs: DataFrame, model: AdditiveModel, threshold: float = 0.7, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs, and the columns named in keep as _keep_<name>."""
    named = texts(docs, *(F.col(quoted(c)).alias(f"_keep_{c}") for c in keep))
    return _scored(named, model, threshold, lambda batch: batch.column("text"), [c for c in named.columns if c != "text"])


def kept(docs: DataFrame, model: AdditiveModel, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that the model doesn't reject, with all their columns."""
    ship(docs.sparkSession)
    named, at = carried(docs, doc_id=F.col("doc_id").cast("long")), docs.columns.index("text")
    found = _scored(named, model, threshold, lambda batch: pc.struct_field(batch.column("row"), at), named.columns)
    return uncarried(found.where("predicted = 1"), docs)


def _scored(named: DataFrame, model: AdditiveModel, threshold: float, text: Callable[[pa.RecordBatch], pa.Array], columns: list[str]) -> DataFrame:
    """The columns given pass by as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(model.score(_matrix(text(batch))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), score], names=[*columns, "score"])

    schema = StructType([*(named.schema[c] for c in columns), StructField("score", DoubleType())])
    found = named.mapInArrow(run, schema).withColumn("held_out", held_out(F.col("doc_id")))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    return scores(docs, fitted(docs, labels), threshold).select("doc_id", "held_out", "score", "predicted")
