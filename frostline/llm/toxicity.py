"""Toxicity by non-negative positive-unlabelled learning: confirmed toxic examples plus unlabelled text.

The risk of a classifier f is  prior * E_P[loss(f, +)] + max(0, E_U[loss(f, -)] - prior * E_P[loss(f, -)]):  the
negatives' part is estimated from unlabelled text minus the positives' share of it, and never counted below zero.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.sources.shared import written

TOKEN = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 7)  # a word also counts by its first characters, so that unseen endings are known


@dataclass(frozen=True)
class Settings:
    """Bounds of the sample that the classifier is fitted on, and of its training.

    max_positive, max_unlabelled: texts of the sample at most. Features count if min_positive_docs confirmed examples
    and min_share of them (fewer may be chance, or copies of one text) have them and, by the class prior, at least min_precision of the texts that have them are toxic; of these the
    max_features most frequent and telling ones.
    """

    max_positive: int = 4000
    max_unlabelled: int = 12000
    max_features: int = 4096
    min_positive_docs: int = 4
    min_share: float = 0.02
    min_precision: float = 0.7
    steps: int = 400
    rate: float = 0.1
    l1: float = 2e-4
    default_prior: float = 0.05


@dataclass
class Model:
    """Weights by feature; a feature is the hash of a word or of its first characters."""

    weights: dict[int, float] = field(default_factory=dict)
    bias: float = -20.0


def features_of(word: str) -> list[int]:
    """Hashes of a lower-case word: itself and its prefixes."""
    parts = ["=" + word] + [word[:size] for size in PREFIXES if len(word) >= size]
    return [xxhash.xxh3_64_intdigest(f"{len(part)}{part}") >> 1 for part in parts]


def distinct_words(text: str | None) -> set[str]:
    return set(TOKEN.findall(text.lower())) if text else set()


class Features(dict):
    """Features of each word, remembered while they fit."""

    LIMIT = 1 << 16

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = tuple(features_of(word))
        return value


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = Features()
    for batch in batches:
        ids = [sorted({f for word in distinct_words(text) for f in known[word]}) for text in batch["text"]]
        yield pd.DataFrame({"positive": batch["positive"], "unlabelled": batch["unlabelled"], "ids": ids})


def _only(ids: np.ndarray):
    """Function that leaves of each row's ids those given (sorted)."""

    def only(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(ids=[np.intersect1d(own, ids, assume_unique=True) for own in batch["ids"]])

    return only


def chosen(key: Column, salt: int, rows: int, most: int) -> Column:
    """Keep about `most` of `rows` rows, by the hash of their key: the same rows in every run."""
    share = 1.0 if rows <= most else most / rows
    return F.pmod(F.xxhash64(F.lit(salt), key), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))


def training_rows(
    documents: DataFrame, labels: DataFrame, settings: Settings = Settings()
) -> tuple[DataFrame, float]:
    """(positive, unlabelled, ids) of a bounded sample of documents (doc_id, text), and the class prior.

    labels: doc_id, toxic. Only label 1 marks a row as positive; the rest is unlabelled whatever its label.
    The prior is the share of label 1 among the labelled rows. Rows that repeat an id count once.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    known = marks.agg(F.count("*").alias("rows"), F.sum("toxic").alias("positive")).first()
    positives = known.positive or 0
    prior = min(max(positives / known.rows, 1e-4), 0.9) if positives else settings.default_prior
    rows = documents.select("doc_id").where(F.col("doc_id").isNotNull()).count()
    key = F.col("doc_id")
    # At most max_positive ids, so they may be broadcast and no text is shuffled to find theirs.
    confirmed = marks.where(F.col("toxic") == 1).orderBy(F.xxhash64(F.lit(1), key), key).limit(settings.max_positive)
    texts = documents.select("doc_id", "text").where(key.isNotNull())
    as_positive = texts.join(F.broadcast(confirmed.select("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(
        "text", F.lit(True).alias("positive"), F.lit(False).alias("unlabelled")
    )
    as_unlabelled = texts.where(chosen(key, 2, rows, settings.max_unlabelled)).dropDuplicates(["doc_id"]).select(
        "text", F.lit(False).alias("positive"), F.lit(True).alias("unlabelled")
    )
    sample = as_positive.unionByName(as_unlabelled)
    return sample.mapInPandas(_features, "positive boolean, unlabelled boolean, ids array<long>"), prior


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, settings: Settings) -> Model:
    """Train on feature ids of each text; numpy only, the same result in every run."""
    if not positive or not unlabelled:
        return Model()
    ids, in_positive = np.unique(np.concatenate(positive), return_counts=True)
    least = max(min(settings.min_positive_docs, len(positive)), settings.min_share * len(positive))
    ids, in_positive = ids[in_positive >= least], in_positive[in_positive >= least]
    if not len(ids):
        return Model()
    everywhere = np.concatenate(unlabelled)
    places = np.searchsorted(ids, everywhere)
    places[places == len(ids)] = 0
    in_unlabelled = np.bincount(places[ids[places] == everywhere], minlength=len(ids))
    share = (in_positive + 0.5) / (len(positive) + 1)
    usual = (in_unlabelled + 0.5) / (len(unlabelled) + 1)
    value = share * np.log(share / usual)
    top = np.sort(np.argsort(-value, kind="stable")[: settings.max_features])
    top = top[prior * share[top] >= settings.min_precision * usual[top]]
    ids = ids[top]
    if not len(ids):
        return Model()

    def rows_of(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(t) for t in texts])
        flat = np.concatenate(texts)
        at = np.searchsorted(ids, flat)
        at[at == len(ids)] = 0
        keep = ids[at] == flat
        return np.repeat(np.arange(len(texts)), lengths)[keep], at[keep]

    (p_row, p_col), (u_row, u_col) = rows_of(positive), rows_of(unlabelled)
    n_p, n_u, size = len(positive), len(unlabelled), len(ids)
    weights, bias = np.zeros(size), np.log(prior / (1 - prior))
    first, second = np.zeros(size + 1), np.zeros(size + 1)

    def sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -50, 50)))

    for step in range(1, settings.steps + 1):
        f_p = np.bincount(p_row, weights[p_col], n_p) + bias
        f_u = np.bincount(u_row, weights[u_col], n_u) + bias
        s_p, s_u = sigmoid(f_p), sigmoid(f_u)
        negative = np.mean(np.logaddexp(0, f_u)) - prior * np.mean(np.logaddexp(0, f_p))
        g_p = prior * (s_p - 1) / n_p  # of the positives' own loss
        g_minus_p, g_u = -prior * s_p / n_p, s_u / n_u  # of the negatives' risk
        if negative < 0:  # step back from where the estimate turns negative
            d_p, d_u = -g_minus_p, -g_u
        else:
            d_p, d_u = g_p + g_minus_p, g_u
        slope = np.append(np.bincount(p_col, d_p[p_row], size) + np.bincount(u_col, d_u[u_row], size),
                          d_p.sum() + d_u.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope * slope
        move = settings.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
        weights = np.sign(weights) * np.maximum(np.abs(weights) - settings.rate * settings.l1, 0)
    return Model({int(i): float(w) for i, w in zip(ids, weights, strict=True) if w}, float(bias))


def telling(rows: DataFrame, prior: float, settings: Settings = Settings()) -> np.ndarray:
    """Ids, sorted, of the features worth training on, by their counts in the sample; at most max_features."""
    n = rows.agg(F.count(F.when(F.col("positive"), 1)).alias("p"), F.count(F.when(F.col("unlabelled"), 1)).alias("u")).first()
    if not n.p or not n.u:
        return np.zeros(0, np.int64)
    least = max(min(settings.min_positive_docs, n.p), settings.min_share * n.p)
    counts = rows.select("positive", "unlabelled", F.explode("ids").alias("id")).groupBy("id").agg(
        F.count(F.when(F.col("positive"), 1)).alias("p"), F.count(F.when(F.col("unlabelled"), 1)).alias("u")
    ).where(F.col("p") >= least)
    share, usual = (F.col("p") + 0.5) / (n.p + 1), (F.col("u") + 0.5) / (n.u + 1)
    best = counts.where(F.lit(prior) * share >= F.lit(settings.min_precision) * usual).orderBy(
        (share * F.log(share / usual)).desc(), "id"
    ).limit(settings.max_features)
    return np.sort(np.array([r.id for r in best.select("id").collect()], np.int64))


def train(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Model from documents (doc_id, text) and labels (doc_id, toxic).

    The features of the bounded sample are counted in Spark; the driver gets the telling ones of each text. Without
    any confirmed example the model scores every text near 0.
    """
    rows, prior = training_rows(documents, labels, settings)
    rows = written(rows, "features")
    few = rows.mapInPandas(_only(telling(rows, prior, settings)), rows.schema)
    sample = few.toArrow().to_pydict()
    arrays = [np.asarray(ids or [], np.int64) for ids in sample["ids"]]
    order = sorted(range(len(arrays)), key=lambda i: arrays[i].tobytes())  # any order of arrival, one result
    return fit([arrays[i] for i in order if sample["positive"][i]],
               [arrays[i] for i in order if sample["unlabelled"][i]], prior, settings)


def score_column(text: Column, model: Model) -> Column:
    """Score of a whole text, 0 to 1. Null and empty texts have no words and get the bias's score."""
    weights, bias = model.weights, model.bias

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            scores = []
            for text in batch:
                found: set[int] = set()
                for word in distinct_words(text):
                    hits = known.get(word)
                    if hits is None:
                        if len(known) > 1 << 17:
                            known.clear()
                        hits = known[word] = tuple(f for f in features_of(word) if f in weights)
                    if hits:
                        found.update(hits)
                total = bias + sum(weights[f] for f in sorted(found))
                scores.append(1 / (1 + np.exp(-min(max(total, -50.0), 50.0))))
            yield pd.Series(scores, dtype="float64")

    return F.pandas_udf(score, "double")(text)


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row; repeated rows are scored each, an empty table gives no rows."""
    return documents.select("doc_id", score_column(F.col("text"), model).alias("score"))


def without_toxic(documents: DataFrame, model: Model) -> DataFrame:
    """The documents whose score is below 0.5, with all their columns."""
    return documents.where(score_column(F.col("text"), model) < 0.5)
