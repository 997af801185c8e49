"""Filter interaction audit: what each filter removes at each place of each order, read from decision diagrams.

Documents are reduced to masks of the filters they fail. Per part a decision diagram over these masks carries counts; an
order of the filters is an order of its variables, reached from the last one by swapping two adjacent levels, and the
path on which every filter passes gives that order's steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm.text import let
from frostline.operators.skew import lookup
from frostline.sources.shared import written

STEPS = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)
PARTS_AT_ONCE = 64


@dataclass(frozen=True)
class Limits:
    """A: fewer than min_words words; B: distinct words under min_distinct_pct % of them; C: letters A-Z over
    max_capitals_pct % of the code points; D: any of the symbols; E: the text of a smaller doc_id."""

    min_words: int = 50
    min_distinct_pct: int = 65
    max_capitals_pct: int = 5
    symbols: str = r"[#$%&*|]"


FILTERS = "ABCDE"  # bit i of a mask belongs to letter i


def text_mask(text: Column, limits: Limits = Limits()) -> Column:
    """The bits of A to D. Stays in the JVM."""

    def of(words: Column) -> Column:
        return (
            F.when(F.size(words) < limits.min_words, 1).otherwise(0)
            + F.when(F.lit(100) * F.size(F.array_distinct(words)) < F.lit(limits.min_distinct_pct) * F.size(words), 2).otherwise(0)
        )

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return (
        let(words, of)
        + F.when(F.lit(100) * capitals > F.lit(limits.max_capitals_pct) * F.length(text), 4).otherwise(0)
        + F.when(text.rlike(limits.symbols), 8).otherwise(0)
    )


def masked(documents: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """part, mask, docs, good, toxic: documents counted by the filters they fail; good and toxic as labelled.

    Null texts count as empty, a null source is part ''. Of equal texts those with the smallest doc_id pass E, repeated
    rows of that id too; a row without an id is never a copy and none of its copies fails for it. Labels given more than
    once count if any of them says so; labels without an id count for no document. Other columns don't matter.

    The texts are read once, to rows of a digest and a mask; those are joined to the first id of their text and to
    the labels, and hot texts or ids are left to the splitting of skewed joins.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
            F.unhex(F.sha2(text, 256)).alias("digest"), text_mask(text, limits).cast("int").alias("own_mask"),
        ),
        "masks",
    )
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    said = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("is_good"), F.max((F.col("toxic") == 1).cast("int")).alias("is_toxic")
    )
    copied = F.when(F.col("doc_id") > F.col("first_id"), 16).otherwise(0)
    known = lookup(lookup(rows, first, ["digest"], "left"), said, ["doc_id"], "left")
    return known.groupBy("part", (F.col("own_mask") + copied).alias("mask")).agg(
        F.count("*").alias("docs"),
        F.sum(F.coalesce("is_good", F.lit(0)).cast("long")).alias("good"),
        F.sum(F.coalesce("is_toxic", F.lit(0)).cast("long")).alias("toxic"),
    )


class Diagram:
    """A decision diagram over failure masks. Each node stands for the documents below it and holds their counts.

    Every path tests all variables, equal functions of a level share a node, and all masks that never occur share the
    node of nothing. low: the variable's filter passes, high: it fails.
    """

    def __init__(self, counts: dict[int, tuple[int, ...]], width: int):
        self.order = list(range(width))
        size = len(next(iter(counts.values()))) if counts else 0
        self.totals: list[tuple[int, ...]] = []
        self.levels: list[dict[int, tuple[int, int]]] = [{} for _ in range(width)]
        self.known: list[dict[tuple[int, int], int]] = [{} for _ in range(width)]
        leaves: dict[tuple[int, ...], int] = {}
        below = []
        for passes in product((0, 1), repeat=width):  # the first variable changes slowest
            weight = counts.get(sum(bit << i for i, bit in enumerate(passes)), (0,) * size)
            if weight not in leaves:
                leaves[weight] = len(self.totals)
                self.totals.append(weight)
            below.append(leaves[weight])
        for level in range(width - 1, -1, -1):
            below = [self._node(level, below[i], below[i + 1]) for i in range(0, len(below), 2)]
        self.root = below[0]

    def _node(self, level: int, low: int, high: int) -> int:
        found = self.known[level].get((low, high))
        if found is None:
            found = self.known[level][low, high] = len(self.totals)
            self.levels[level][found] = (low, high)
            self.totals.append(tuple(map(sum, zip(self.totals[low], self.totals[high], strict=True))))
        return found

    def swap(self, level: int) -> None:
        """Exchange the variables of two adjacent levels; the nodes above and below stay as they are."""
        upper, lower = self.levels[level], self.levels[level + 1]
        self.levels[level + 1], self.known[level + 1], self.known[level] = {}, {}, {}
        for node, (low, high) in upper.items():
            (both, last), (first, none) = lower[low], lower[high]
            pair = self._node(level + 1, both, first), self._node(level + 1, last, none)
            upper[node] = pair
            self.known[level][pair] = node
        order = self.order
        order[level], order[level + 1] = order[level + 1], order[level]

    def all_pass(self) -> Iterator[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """The variable, and the counts that stay and that go, at each step of the present order."""
        node = self.root
        for variable, nodes in zip(self.order, self.levels, strict=True):
            node, gone = nodes[node]
            yield variable, self.totals[node], self.totals[gone]


def adjacent_swaps(width: int) -> Iterator[int]:
    """Places to swap with their right neighbour so that every order is met once, beginning with the present one.

    The last item wanders through the others from end to end; at each end the others make their next swap.
    """
    if width < 2:
        return
    rest, back = adjacent_swaps(width - 1), True
    while True:
        yield from (range(width - 2, -1, -1) if back else range(width - 1))
        between = next(rest, None)
        if between is None:
            return
        yield between + (1 if back else 0)
        back = not back


def audited(counts: dict[int, tuple[int, int, int]], filters: str = FILTERS) -> list[tuple]:
    """filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of one part."""
    width = len(filters)
    failing = [sum(c[0] for mask, c in counts.items() if mask >> i & 1) for i in range(width)]
    alone = [counts.get(1 << i, (0, 0, 0))[0] for i in range(width)]
    diagram, shapley, rows = Diagram(counts, width), [0] * width, []

    def read() -> None:
        order = "".join(filters[i] for i in diagram.order)
        for step, (i, stay, gone) in enumerate(diagram.all_pass(), 1):
            shapley[i] += gone[0]
            rows.append((order, step, stay[0], gone[0], failing[i] - gone[0], alone[i], gone[1], gone[2]))

    read()
    for level in adjacent_swaps(width):
        diagram.swap(level)
        read()
    at = {letter: i for i, letter in enumerate(filters)}
    return [(*row, shapley[at[row[0][row[1] - 1]]]) for row in rows]


def _audit_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [column.split()[0] for column in STEPS.split(", ")]
    for batch in batches:
        for start in range(0, len(batch), PARTS_AT_ONCE):
            some = batch.iloc[start : start + PARTS_AT_ONCE]
            rows = []
            for part, masks in zip(some["part"], some["masks"], strict=True):
                counts = {m["mask"]: (m["docs"], m["good"], m["toxic"]) for m in masks}
                rows += [(part, *row) for row in audited(counts)]
            yield pd.DataFrame(rows, columns=names)


def audit(counted: DataFrame) -> DataFrame:
    """All orders of the five filters, five steps each, for every part of a table as masked() returns it.

    A part has at most 32 masks, so a diagram is small however many documents stand behind it, and parts are dealt out
    over the tasks. An empty table gives no rows.
    """
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "docs", "good", "toxic")).alias("masks"))
    return parts.mapInPandas(_audit_batches, STEPS)
