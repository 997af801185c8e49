"""Ranked lexical search, a hybrid of term-at-a-time and document-at-a-time evaluation.

Documents are indexed in blocks. For each query and block the short posting lists are summed into accumulators term by
term; these then count as one more iterator with a bound, beside the long lists, in a document-at-a-time pass that skips
what can't reach the best documents found so far.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frostline.sources.shared import written

# Terms are runs of ASCII letters, digits and anything beyond ASCII; only A-Z change their case.
_TABLE = bytes(
    code + 32 if 0x41 <= code <= 0x5A else code if code > 0x7F or chr(code).isalnum() else 0x20 for code in range(256)
)
_PIECE = 1 << 20

INDEX = (
    "docs long, words long, ids binary, known binary, lengths binary, terms array<int>, counts array<int>, "
    "at binary, tf binary"
)
FOUND = "item long, item_id long, doc_id long, score long"


@dataclass(frozen=True)
class Settings:
    """best: documents returned for an item.

    block_docs, block_postings: a block of the index ends once it has so many of either; a block is one row.
    short_share: lists are summed beforehand, the shortest first, while they hold at most this share of the block's
    documents between them (at least least_short postings). ranges: a block is passed in so many ranges of documents, the
    bounds looked at anew before each. round_bytes: items whose texts hold so many bytes are searched at once; more take
    further rounds, each with its own index.
    """

    best: int = 20
    block_docs: int = 16384
    block_postings: int = 2_000_000
    short_share: float = 0.25
    least_short: int = 1024
    ranges: int = 4
    round_bytes: int = 32_000_000


def term_counts(text: str | None) -> Counter:
    """How often a text has which term. Long texts are taken apart piece by piece."""
    counts: Counter = Counter()
    if text:
        raw = text.encode("utf-8", "surrogatepass").translate(_TABLE)
        start = 0
        while start < len(raw):
            end = raw.find(b" ", start + _PIECE)
            end = len(raw) if end < 0 else end
            counts.update(raw[start:end].split())
            start = end
    return counts


# Index


class _Block:
    """Documents and postings gathered for one row of the index."""

    def __init__(self) -> None:
        self.ids, self.lengths, self.at, self.terms, self.tf = [], [], [], [], []

    def add(self, doc_id: int | None, length: int, hits: dict[int, int]) -> None:
        self.at += [len(self.ids)] * len(hits)
        self.terms += hits
        self.tf += hits.values()
        self.ids.append(doc_id)
        self.lengths.append(length)

    def row(self) -> pd.DataFrame:
        """Documents in order of their id, unknown ones last; postings in order of term and document."""
        known = np.array([i is not None for i in self.ids], bool)
        ids = np.array([0 if i is None else i for i in self.ids], np.int64)
        lengths = np.array(self.lengths, np.int64)
        order = np.lexsort((ids, ~known))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at, terms = place[np.array(self.at, np.int64)], np.array(self.terms, np.int32)
        tf = np.array(self.tf, np.uint32)
        sort = np.lexsort((at, terms))
        distinct, counts = np.unique(terms, return_counts=True)
        return pd.DataFrame({
            "docs": [len(ids)], "words": [int(lengths.sum())], "ids": [ids[order].tobytes()],
            "known": [known[order].tobytes()], "lengths": [lengths[order].tobytes()],
            "terms": [distinct.astype(np.int32)], "counts": [counts.astype(np.int32)],
            "at": [at[sort].astype(np.uint32).tobytes()], "tf": [tf[sort].tobytes()],
        })


def indexed(documents: DataFrame, vocabulary: Iterable[bytes], settings: Settings = Settings()) -> DataFrame:
    """The index: a row for each block of documents with any term, with the postings of the vocabulary's terms.

    Reads each text once, whole, and shuffles nothing. Terms are named by their place in the vocabulary.
    """
    numbers = {term: i for i, term in enumerate(vocabulary)}

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = _Block()
        for batch in batches:
            for doc_id, known, text in zip(batch["doc_id"], batch["known"], batch["text"], strict=True):
                counts = term_counts(text)
                if not counts:
                    continue
                hits = {numbers[term]: counts[term] for term in counts.keys() & numbers.keys()}
                block.add(doc_id if known else None, counts.total(), hits)
                if len(block.ids) >= settings.block_docs or len(block.at) >= settings.block_postings:
                    yield block.row()
                    block = _Block()
        if block.ids:
            yield block.row()

    doc_id = F.col("doc_id").cast("long")  # with nulls it would come as doubles, which round large ids
    rows = documents.select(F.coalesce(doc_id, F.lit(0)).alias("doc_id"), doc_id.isNotNull().alias("known"),
                            F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(blocks, INDEX)


# Search


class _Postings:
    """A block of the index, its postings with what each is worth before the term's weight."""

    def __init__(self, row, documents: int, words: int):
        self.ids, self.known = np.frombuffer(row.ids, np.int64), np.frombuffer(row.known, bool)
        lengths = np.frombuffer(row.lengths, np.int64)
        if int(lengths.max()) * 25 * documents >= 1 << 63:
            lengths = lengths.astype(object)  # integers of any size
        measure = (75 + 25 * lengths * documents // words).astype(np.int64)
        self.at = np.frombuffer(row.at, np.uint32).astype(np.int64)
        tf = np.frombuffer(row.tf, np.uint32).astype(np.int64)
        self.worth = 1_000_000_000 * tf // (1000 * tf + 12 * measure[self.at])
        ends = np.cumsum(np.asarray(row.counts, np.int64))
        self.spans = dict(zip(np.asarray(row.terms).tolist(), zip([0, *ends[:-1].tolist()], ends.tolist()), strict=True))
        starts = np.array([a for a, _ in self.spans.values()], np.int64)
        self.most = dict(zip(self.spans, np.maximum.reduceat(self.worth, starts).tolist() if len(starts) else [], strict=True))


def _accumulated(docs: list[np.ndarray], gains: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Documents of several lists, ascending, each with the sum of its gains."""
    at, gain = np.concatenate(docs), np.concatenate(gains)
    order = np.argsort(at, kind="stable")
    at = at[order]
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[starts], np.add.reduceat(gain[order], starts)


def _kth(scores: np.ndarray, best: int) -> int:
    """The score that a document must reach to be among the best; 1 while there are too few."""
    return max(1, int(np.partition(scores, len(scores) - best)[len(scores) - best])) if len(scores) >= best else 1


def best_of_block(block: _Postings, factors: dict[int, int], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the block's best documents; factors: weight times repeats of each term of the item."""
    spans = sorted((end - start, term) for term in factors for start, end in [block.spans.get(term, (0, 0))] if end > start)
    none = np.zeros(0, np.int64)
    if not spans:
        return none, none
    room, short, lists = max(settings.least_short, int(settings.short_share * len(block.ids))), [], []
    for size, term in spans:
        start, end = block.spans[term]
        if size <= room:
            room -= size
            short.append((block.at[start:end], factors[term] * block.worth[start:end]))
        else:
            room = 0
            lists.append((factors[term] * block.most[term], block.at[start:end], factors[term], block.worth[start:end]))
    bar = 1
    if short:  # term at a time; the accumulators are one more iterator, whose gains are ready
        at, gain = _accumulated(*zip(*short, strict=True))
        if not lists:
            return _cut(at, gain, settings.best)
        bar = _kth(gain, settings.best)
        lists.append((int(gain.max()), at, 1, gain))
    lists.sort(key=lambda x: x[0])
    bounds = np.cumsum([x[0] for x in lists]).tolist()  # what the first iterators can give together

    kept, scores = none, none
    edges = np.linspace(0, len(block.ids), settings.ranges + 1).astype(np.int64)
    cursors = [np.searchsorted(at, edges) for _, at, _, _ in lists]
    for number in range(settings.ranges):
        first = next((i for i, bound in enumerate(bounds) if bound >= bar), None)
        if first is None:  # not even all iterators together reach the bar
            break
        inside = [slice(cursor[number], cursor[number + 1]) for cursor in cursors]
        essential = [i for i in range(first, len(lists)) if inside[i].stop > inside[i].start]
        if not essential:
            continue
        at, score = _accumulated([lists[i][1][inside[i]] for i in essential],
                                 [lists[i][2] * lists[i][3][inside[i]] for i in essential])
        for i in range(first - 1, -1, -1):  # skip ahead in the others, for documents that may still do
            alive = score + bounds[i] >= bar
            at, score = at[alive], score[alive]
            if not len(at):
                break
            _, own, factor, worth = lists[i]
            place = np.minimum(np.searchsorted(own, at), len(own) - 1)
            score = score + np.where(own[place] == at, factor * worth[place], 0)
        kept, scores = _cut(np.concatenate([kept, at]), np.concatenate([scores, score]), settings.best)
        bar = max(bar, _kth(scores, settings.best))
    return kept, scores


def _cut(at: np.ndarray, scores: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray]:
    """The best of these, of equal scores the first in the block; none without a score."""
    order = np.lexsort((at, -scores))[:best]
    order = order[scores[order] > 0]
    return at[order], scores[order]


def _search(index: DataFrame, items: list[tuple[int | None, dict[int, int]]], weights: dict[int, int],
            documents: int, words: int, settings: Settings) -> DataFrame:
    """The best documents of each block for each item."""
    factors = [(n, item_id, {t: q * weights[t] for t, q in terms.items() if weights.get(t)})
               for n, (item_id, terms) in enumerate(items)]

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                block = _Postings(row, documents, words)
                found = [(n, item_id, *best_of_block(block, terms, settings)) for n, item_id, terms in factors]
                sizes = [len(at) for _, _, at, _ in found]
                at = np.concatenate([x[2] for x in found])
                repeat = lambda values: pd.array(values, "Int64").repeat(sizes)  # noqa: B023, E731
                yield pd.DataFrame({
                    "item": repeat([x[0] for x in found]), "item_id": repeat([x[1] for x in found]),
                    "doc_id": pd.arrays.IntegerArray(block.ids[at].copy(), ~block.known[at]),
                    "score": np.concatenate([x[3] for x in found]),
                })

    return index.mapInPandas(blocks, FOUND)


def _round(documents: DataFrame, items: list, settings: Settings) -> DataFrame:
    counted = [(row.item_id, term_counts(row.text)) for row in items]
    vocabulary = sorted(set().union(*[terms for _, terms in counted]))
    numbers = {term: i for i, term in enumerate(vocabulary)}
    index = written(indexed(documents, vocabulary, settings), "postings")
    total = index.agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
    held = index.select(F.inline(F.arrays_zip("terms", "counts"))).groupBy("terms").agg(F.sum("counts").alias("df"))
    weights = {
        row.terms: math.floor(1000 * math.log((2 * total.docs + 2) / (2 * row.df + 1))) for row in held.collect()
    }
    wanted = [(item_id, {numbers[t]: q for t, q in terms.items()}) for item_id, terms in counted if terms]
    found = _search(index, wanted, weights, total.docs or 0, total.words or 0, settings)
    place = F.row_number().over(
        Window.partitionBy("item_id", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    )
    return found.withColumn("rank", place.cast("int")).where(F.col("rank") <= settings.best).select(
        "item_id", "rank", "doc_id", "score"
    )


def search(documents: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of every item (item_id, text), exactly.

    A row of documents is a document: repeated rows are found each, and share a score. Equal scores go by ascending
    doc_id, rows without one last. Documents without a term (null, empty, punctuation only) count nowhere; items
    without one, or without a match, have no rows. Rows of items that repeat id and text are one item; different texts
    of one id are ranked each from 1. Empty tables give no rows. Other columns don't matter.

    Per round the driver holds the items' texts (round_bytes), a weight for each of their terms, and nothing that grows
    with the documents. Each block returns at most `best` rows an item, and each task keeps as many before the shuffle.
    """
    spark = documents.sparkSession
    asked = written(items.select(F.col("item_id").cast("long").alias("item_id"),
                                 F.col("text").cast("string").alias("text")).distinct(), "items")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rounds = max(1, -(-size // settings.round_bytes))
    results = []
    for number in range(rounds):
        part = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == number).collect()
        if part:
            results.append(_round(documents, part, settings))
    if not results:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, results)
