"""Quality classification with hierarchical empirical Bayes.

A logistic model over surface features of the whole text gives each document evidence. All documents'
probabilities, summed by host and by path, give posteriors: a path shrinks toward its host, a host
toward the global rate, each by a concentration that the method of moments takes from the spread of
the sites' means (sparse sites stay near their parent). A document's log odds are its evidence plus
its path's prior log odds in place of the training rate's. Host and path are the columns source and
lang here.

The logistic model is fitted on at most FIT_ROWS labelled documents (those with the least hashes of
their doc_id); every other number comes from all documents. Sums by site combine before the shuffle,
and the join back to documents is salted, or broadcast where the table of sites has few rows.

Defined results: null or wordless text has zero features; a null host or path is a site of its own;
labels that are null or of unknown documents are ignored, several of one document are averaged; where
labels are missing or all alike nothing is known and every document is kept with score 0.5; rows that
repeat are judged alike; other columns pass through, and the operator's own columns (quality_score,
quality_kept) replace any of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.store import cut, extended, packed, unpacked
from phasegrid.llm.tokens import slices, words_of

FIT_ROWS = 20_000
#: Sites up to which their table is broadcast (about 100 bytes each).
FEW_SITES = 50_000
SALTS = 64
FEATURES = ("upper", "symbol", "exclaim", "digit", "repeat", "distinct", "length", "marked", "size")

UPPER, DIGIT, SYMBOL = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
UPPER[65:91] = True
DIGIT[48:58] = True
SYMBOL[list(rb"#$%&*+/<=>@[\]^_`{|}~")] = True


def features_of(col: pa.Array) -> np.ndarray:
    """One row of FEATURES a text."""
    w = words_of(col)
    count = np.diff(w.doc)
    edge = np.append(w.first, len(w.data))[w.doc]
    size = np.maximum(np.diff(edge), 1)

    def by_doc(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return np.diff(total[at])

    def share(mask: np.ndarray) -> np.ndarray:
        return by_doc(mask[w.data], edge) / size

    h = w.hashes(41)
    doc = np.repeat(np.arange(len(count)), count)
    again = np.zeros(w.count, bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((h, doc))
    new = np.ones(w.count, bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[1:] != doc[:-1])
    last = w.data[w.first + w.length - 1] if w.count else w.data
    marked = SYMBOL[last] | (last == 33)
    n = np.maximum(count, 1)
    exclaim = np.zeros(256, bool)
    exclaim[33] = True
    return np.stack([share(UPPER), share(SYMBOL), share(exclaim), share(DIGIT), by_doc(again, w.doc) / n, by_doc(new, w.doc) / n, size / n / 10, by_doc(marked, w.doc) / n, np.log1p(count) / 10], axis=1)


@dataclass
class Model:
    """weights: intercept first; rate: share of good labels it was fitted on; sites: host, path and prior log odds."""

    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    rate: float
    sites: DataFrame | None

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.weights[0] + ((x - self.center) / self.scale) @ self.weights[1:]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Center, scale and weights of a ridge logistic regression, by Newton steps."""
    center, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    a = np.column_stack([np.ones(len(x)), (x - center) / scale])
    w, penalty = np.zeros(a.shape[1]), ridge * np.eye(a.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return center, scale, w


def concentration(sites: DataFrame, mean: str, n: str) -> float:
    """Strength of the common prior of the sites' means, by moments: between 1 and 10,000 documents."""
    m, v, inside = sites.agg(F.avg(mean), F.var_pop(mean), F.avg(F.col(mean) * (1 - F.col(mean)) / F.col(n))).first()
    if m is None:
        return 1.0
    return float(np.clip(m * (1 - m) / max(v - inside, 1e-9) - 1, 1.0, 1e4))


def _site(column: str) -> Column:
    return F.concat(F.when(F.col(column).isNull(), "0").otherwise("1"), F.coalesce(column, F.lit("")))


def fit_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> Model:
    """The model of docs (doc_id, text, host, path) and labels (doc_id, quality)."""
    spark = docs.sparkSession

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = features_of(part.column("text"))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "_host", "_path")), lists], ["doc_id", "_host", "_path", "x"])

    rows = docs.select("doc_id", "text", _site(host).alias("_host"), _site(path).alias("_path"))
    seen = cut(rows.mapInArrow(work, extended(rows.drop("text").schema, "x array<double>")), "features")
    truth = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    told = cut(seen.select("doc_id", "x").join(truth, "doc_id").withColumn("h", F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 62) - 1))), "labelled")
    few = min(1.0, 2 * FIT_ROWS / max(1, told.select(F.approx_count_distinct("doc_id")).first()[0]))  # a task sends on what could be among the least hashes
    fit = told.filter(F.col("h") <= int(few * ((1 << 62) - 1))).orderBy("h", "doc_id").limit(FIT_ROWS).select("x", "y").collect()
    y = np.array([r.y for r in fit], float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(len(FEATURES) + 1), 0.5, None)
    center, scale, weights = fit_logistic(np.array([r.x for r in fit]), y)
    flat = [float(v) for v in weights[1:] / scale]
    z = F.lit(float(weights[0] - (weights[1:] * center / scale).sum()))
    for k, v in enumerate(flat):
        z = z + F.lit(v) * F.col("x")[k]
    good = 1 / (1 + F.exp(-z))
    paths = cut(seen.select("_host", "_path", good.alias("p")).groupBy("_host", "_path").agg(F.sum("p").alias("s"), F.count("*").alias("n")), "sites")
    hosts = paths.groupBy("_host").agg(F.sum("s").alias("hs"), F.sum("n").alias("hn"))
    rate = paths.agg(F.sum("s") / F.sum("n")).first()[0]
    k_host = concentration(hosts.withColumn("m", F.col("hs") / F.col("hn")), "m", "hn")
    k_path = concentration(paths.withColumn("m", F.col("s") / F.col("n")), "m", "n")
    sites = paths.join(hosts.withColumn("h", (k_host * rate + F.col("hs")) / (k_host + F.col("hn"))), "_host")
    sites = sites.withColumn("q", (k_path * F.col("h") + F.col("s")) / (k_path + F.col("n"))).withColumn("q", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), "q")))
    return Model(center, scale, weights, float(y.mean()), cut(sites.select("_host", "_path", F.log(F.col("q") / (1 - F.col("q"))).alias("_prior")), "priors"))


def score_quality(docs: DataFrame, model: Model, host: str = "source", path: str = "lang") -> DataFrame:
    """docs plus quality_score (probability of good quality) and quality_kept (0.5 or more)."""
    own = ("quality_score", "quality_kept")
    docs = docs.drop(*own)
    if model.sites is None:
        return docs.withColumn("quality_score", F.lit(0.5)).withColumn("quality_kept", F.lit(True))
    keyed = docs.select(packed(docs, "text"), "text", _site(host).alias("_host"), _site(path).alias("_path"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int").alias("_salt"))
    if model.sites.count() <= FEW_SITES:
        met = keyed.join(F.broadcast(model.sites), ["_host", "_path"], "left")
    else:
        met = keyed.join(model.sites.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["_host", "_path", "_salt"], "left")
    met, usual = met.select("row", "text", "_prior"), float(np.log(model.rate / (1 - model.rate)))
    plain = Model(model.center, model.scale, model.weights, model.rate, None)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                prior = np.nan_to_num(part.column("_prior").to_numpy(zero_copy_only=False).astype(float), nan=usual)
                odds = plain.log_odds(features_of(part.column("text"))) + prior - usual
                p = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("text"), pa.array(p), pa.array(p >= 0.5)], ["row", "text", *own])

    made = met.mapInArrow(work, extended(keyed.select("row", "text").schema, "quality_score double, quality_kept boolean"))
    return made.select(*unpacked(docs.columns, "text"), *own)


def classify_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    return score_quality(docs, fit_quality(docs, labels, host, path), host, path)
