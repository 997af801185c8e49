"""Nearest neighbours by collision counting: sorted arrays of single projections, windows around each query that grow
by virtual rehashing, and verification of the vectors that collide often enough.

A vector at distance s from the query falls into a window of half-width h of one projection with probability
2 * Phi(h / s) - 1. A vector that collides in `collisions` of the `projections` is verified. A query stops as soon as
a nearer vector than its k-th best would have collided often enough with probability 1 - miss, so the recall follows
from the parameters and not from a cap on candidates.

Collisions are counted for 64 vectors at a time: each sorted array has marks at even steps, each mark the bits of the
vectors before it. A window is the difference of two marks' bits (the window reaches out to them), and the windows'
bits are added up by full adders over whole words. That is so cheap that many projections can be counted, which tell
near from far vectors well enough that few are verified.

Largest inner products become smallest distances by one more coordinate: vectors x are lengthened to a common norm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.sources.shared import written


@dataclass(frozen=True)
class Settings:
    """k: neighbours. miss: chance at most that a true neighbour is passed over. ratio: growth of the windows until they
    hold k verified vectors. marks: steps of a sorted array.

    block_rows, query_rows: vectors and queries that meet in one task; every query meets every block. words: 64-bit words
    of a projection's windows, for the queries that are counted together.
    """

    k: int = 20
    projections: int = 255
    collisions: int = 192
    miss: float = 0.02
    first_width: float = 0.4
    ratio: float = 1.12
    marks: int = 128
    block_rows: int = 16384
    query_rows: int = 2048
    words: int = 8192
    seed: int = 17


def stop_width(settings: Settings) -> float:
    """Half-width, as a multiple of a distance, at which a vector of that distance collides often enough, but for miss."""
    m, least = settings.projections, settings.collisions
    low, high = 0.0, 10.0
    for _ in range(60):
        middle = (low + high) / 2
        p = math.erf(middle / math.sqrt(2))
        fewer = sum(math.comb(m, i) * p**i * (1 - p) ** (m - i) for i in range(least))
        low, high = (middle, high) if fewer > settings.miss else (low, middle)
    return high


def _totals(windows: Iterator[np.ndarray]) -> list[np.ndarray]:
    """Binary digits, the lowest first, of the number of windows that have each bit."""
    digits: list[list[np.ndarray]] = [[]]

    def put(place: int, bits: np.ndarray) -> None:
        if place == len(digits):
            digits.append([])
        digits[place].append(bits)
        if len(digits[place]) == 3:
            a, b, c = digits[place]
            either = a ^ b
            digits[place] = [either ^ c]
            put(place + 1, (a & b) | (either & c))

    for bits in windows:
        put(0, bits)
    place = 0
    while place < len(digits):
        if len(digits[place]) == 2:
            a, b = digits[place]
            digits[place] = [a ^ b]
            put(place + 1, a & b)
        place += 1
    return [of[0] for of in digits]


def _at_least(digits: list[np.ndarray], least: int) -> np.ndarray:
    """Bits whose number, given by its binary digits, is not less."""
    more, same = np.zeros_like(digits[0]), ~np.zeros_like(digits[0])
    if least >> len(digits):
        return more
    for place in range(len(digits) - 1, -1, -1):
        if least >> place & 1:
            same &= digits[place]
        else:
            more |= same & digits[place]
            same &= ~digits[place]
    return more | same


class Index:
    """Projections of a block of vectors, each sorted by value and cut at marks. Lengths are in units of the longest."""

    def __init__(self, vectors: np.ndarray, settings: Settings):
        self.vectors, self.settings, rows = vectors, settings, len(vectors)
        norms = np.einsum("ij,ij->i", vectors, vectors)
        longest = float(norms.max())
        self.scale = math.sqrt(longest) or 1.0
        extra = np.sqrt(np.maximum(longest - norms, 0)) / self.scale
        self.lines = np.random.default_rng(settings.seed).standard_normal((vectors.shape[1] + 1, settings.projections))
        values = (vectors / self.scale) @ self.lines[:-1] + extra[:, None] * self.lines[-1]
        values = np.ascontiguousarray(values.T.astype(np.float32))
        places = np.arange(0, rows, -(-rows // settings.marks))
        self.marks = np.full((settings.projections, len(places) + 1), np.inf, np.float32)
        self.before = np.zeros((settings.projections, len(places) + 1, -(-rows // 64)), np.uint64)
        for value, marks, before in zip(values, self.marks, self.before, strict=True):
            marks[:-1] = np.sort(value)[places]
            marks[0] = -np.inf
            before.view(np.uint8)[:, : -(-rows // 8)] = np.packbits(value < marks[:, None], axis=1)
        self.reach = 2 * float(np.abs(values).max()) + 1e-6
        self.stop = stop_width(settings)

    def search(self, queries: np.ndarray, own: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and inner products of each query's nearest; `own` places take no part."""
        settings = self.settings
        lengths = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        # Queries are scaled to the vectors' norm: their order of inner products stays.
        lengths = np.where(lengths > 0, lengths, 1.0)
        centres = (queries / lengths[:, None]) @ self.lines[:-1]
        start, results, at = settings.first_width, [], 0
        batch = max(1, settings.words // self.before.shape[2])
        while at < len(queries):
            # The first few find out where the others can begin; a query that begins too wide only verifies more.
            part = slice(at, at + (batch if at else min(batch, 8)))
            found, widths = self._expand(queries[part], lengths[part], centres[part], own[part], start)
            start, at = float(np.median(widths)), part.stop
            results += found
        return results

    def _often(self, centres: np.ndarray, halves: np.ndarray) -> np.ndarray:
        """[query, place]: whether the vector is in enough of the query's windows."""

        def windows():
            for marks, before, centre in zip(self.marks, self.before, centres.T, strict=True):
                left = np.searchsorted(marks, centre - halves, "right") - 1
                right = np.minimum(np.searchsorted(marks, centre + halves, "right"), len(marks) - 1)
                yield before[right] ^ before[left]

        often = _at_least(_totals(windows()), self.settings.collisions)
        return np.unpackbits(often.view(np.uint8), axis=1)[:, : len(self.vectors)].view(bool)

    def _expand(self, queries, lengths, centres, own, start) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """The windows grow till k vectors are verified, and then as far as the k-th of them asks for."""
        settings, count = self.settings, len(queries)
        seen = np.zeros((count, len(self.vectors)), bool)
        for of, places in zip(seen, own, strict=True):
            of[places] = True
        found, products = [np.zeros(0, np.int64)] * count, [np.zeros(0)] * count
        whole = self.reach + np.abs(centres).max(axis=1) * 2
        halves, asked = np.full(count, start), np.arange(count)
        while len(asked):
            often = self._often(centres[asked], halves[asked])
            after = []
            for bits, i in zip(often, asked.tolist(), strict=True):
                fresh = np.flatnonzero(bits & ~seen[i])
                if len(fresh):
                    seen[i, fresh] = True
                    found[i] = np.concatenate([found[i], fresh])
                    products[i] = np.concatenate([products[i], self.vectors[fresh] @ queries[i]])
                more = wanted = halves[i] * settings.ratio
                if len(found[i]) >= settings.k:
                    last = len(products[i]) - settings.k
                    cosine = np.partition(products[i], last)[last] / lengths[i] / self.scale
                    wanted = self.stop * math.sqrt(max(2 - 2 * cosine, 0.0))
                if halves[i] < wanted and halves[i] < whole[i]:
                    halves[i] = min(wanted, more)  # nearer ones may be found on the way
                    after.append(i)
            asked = np.array(after, np.int64)
        return list(zip(found, products, strict=True)), halves


def _search(settings: Settings):
    def search(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if not len(vectors) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
                {"query_id": "int64", "vec_id": "int64", "score": "float64"})
        out = []
        vectors = vectors.assign(width=vectors["embedding"].map(len))
        queries = queries.assign(width=queries["embedding"].map(len))
        for width, part in queries.groupby("width"):  # vectors of other lengths are no candidates
            same = vectors[vectors["width"] == width].sort_values("vec_id", kind="stable")
            if not len(same):
                continue
            ids = same["vec_id"].to_numpy()
            index = Index(np.stack(same["embedding"].to_numpy()).astype(np.float64), settings)
            points = np.stack(part["embedding"].to_numpy()).astype(np.float64)
            asked = part["vec_id"].to_numpy()
            own = [np.arange(np.searchsorted(ids, q, "left"), np.searchsorted(ids, q, "right")) for q in asked]
            for query, point, (found, products) in zip(asked, points, index.search(points, own), strict=True):
                if len(found) > settings.k:  # the scores of equal vectors must be equal to the last bit
                    kth = np.partition(products, len(found) - settings.k)[len(found) - settings.k]
                    found = found[products >= kth - 1e-9 * (1 + abs(kth))]
                products = (index.vectors[found] * point).sum(axis=1)
                best = np.lexsort((ids[found], -products))[: settings.k]
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids[found[best]], "score": products[best]}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in columns}).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return search


def usable(embeddings: DataFrame) -> DataFrame:
    """Distinct (vec_id, embedding as doubles) that can be compared: neither null nor zero, all components finite."""
    numbers = F.transform("embedding", lambda x: x.cast("double"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    ).distinct().select("vec_id", numbers.alias("embedding")).where(
        F.forall("embedding", fine) & F.exists("embedding", lambda x: x != 0.0)
    )


def search(embeddings: DataFrame, is_query, settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the largest inner product for every row where is_query holds.

    is_query: condition on vec_id. Candidates are all rows but those of the query's own vec_id, and of its length.
    Vectors null, empty, zero or holding null or non-finite components take no part; repeated rows count once; equal
    scores go by the smaller vec_id. An empty table gives no rows; other columns don't matter. Every vector is
    indexed, in blocks of bounded size; a block's k best of each query go on to the merge.
    """
    vectors = written(usable(embeddings), "vectors")
    queries = vectors.where(is_query)
    counts = vectors.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    blocks = max(1, -(-counts[0] // settings.block_rows))
    parts = max(1, -(-counts[1] // settings.query_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sides = vectors.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(blocks)).cast("int").alias("block"),
                           every(parts).alias("part"))
    asked = queries.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(parts)).cast("int").alias("part"),
                           every(blocks).alias("block"))
    near = sides.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInPandas(
        _search(settings), "query_id long, vec_id long, score double"
    )
    order = "partition by query_id order by score desc, vec_id"
    return written(near, "near").withColumn("rank", F.expr(f"row_number() over ({order})")).where(
        F.col("rank") <= settings.k
    ).select("query_id", "rank", "vec_id", "score")
