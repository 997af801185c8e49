"""N-gram Jaccard join with R-trees over count vectors.

The shingles of a document are hashed into groups and the groups' counts make a point. Two sets share at most the sum
over the groups of the smaller count, and no more than that with the box around several points, which prunes an
R-tree; surviving pairs are verified on their sets.

Finding points that can meet: linked sets differ in few shingles, so with more groups than that, some group is the
same in both. Documents that share no group content can't link, nor do those whose few shared groups all come after
enough others that no second document has. Chains of shared groups part the other documents into clusters; each cluster gets an R-tree (large clusters one for each tile of bounded size, joined tile by
tile). Only components are asked for, so pairs that are connected already are not looked at again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.components import components
from frostline.llm.text import WordHashes, lowered_words, mixed, window_hashes
from frostline.sources.shared import drop_written, written


@dataclass(frozen=True)
class Settings:
    """Two documents link when 100 * common >= percent * union of their distinct shingles of `words` words.

    band: ratio of the set sizes that are grouped alike. tile_shingles: shingles of one R-tree at most, unless a single
    document has more. leaf: points of a leaf.
    """

    words: int = 3
    percent: int = 90
    band: float = 1.5
    tile_shingles: int = 2_000_000
    leaf: int = 32
    nodes: int = 16


def shingle_set(text: str | None, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words make one shingle of them all, no words none."""
    tokens = lowered_words(text)
    if not tokens:
        return np.zeros(0, np.uint64)
    width = min(words, len(tokens))
    found = window_hashes(hashes.of(tokens), width)
    return np.unique(mixed(found ^ np.uint64(width)))


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    first = np.bitwise_xor.reduce(mixed(shingles + np.uint64(0x51))) if len(shingles) else np.uint64(0)
    second = np.add.reduce(mixed(shingles ^ np.uint64(0xA5A5A5A5))) if len(shingles) else np.uint64(0)
    return int(np.uint64(first).astype(np.int64)), int(np.uint64(second).astype(np.int64))


def most_different(size: int, percent: int) -> int:
    """Shingles in which two linked sets of at most this size can differ, together."""
    return int((100 - percent) * 2 * size // (100 + percent))


def bands(shingles: np.ndarray, settings: Settings) -> Iterator[tuple[int, np.ndarray, int]]:
    """(slot, keys, spare) of the bands that a set takes part in; of two linked different sets some band has both.

    Per band of sizes the groups are more than any two linked sets of the band can differ in. All documents order their
    groups' keys alike, in whatever order, empty groups last. The first key in that order which two sets share is
    preceded, in each of them, only by groups in which they differ; so the set's first keys, one more than it can differ
    in from any partner, are enough: all but `spare` of the keys given here, which are those of the groups with shingles
    and, where these are too few, the first of the others. A set near the top of its band takes part in the next band
    as well. A key's lowest bit is its slot, which differs between a band and the next.
    """
    size, percent = len(shingles), settings.percent
    if not size:
        return
    band = int(math.floor(math.log(size) / math.log(settings.band) + 1e-9))
    for number in (band, band + 1):
        top = int(math.ceil(settings.band ** (number + 1)))
        if number > band and 100 * size < percent * int(math.floor(settings.band**number)):
            continue
        partner = min(100 * size // percent, top)
        differ = (100 - percent) * (size + partner) // (100 + percent)
        if not differ:
            continue  # only equal sets link
        most = most_different(top, percent)
        groups = most + 2 + most // 16
        of = (shingles % np.uint64(groups)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        starts = np.searchsorted(of[order], np.arange(groups))
        filled = np.bincount(of, minlength=groups) > 0
        sums = np.zeros(groups, np.uint64)
        sums[filled] = np.add.reduceat(mixed(shingles)[order], starts[filled])
        place = np.arange(groups, dtype=np.uint64)
        with np.errstate(over="ignore"):
            whole = mixed(sums + mixed(place + np.uint64(number) * np.uint64(1 << 32) + np.uint64(1)))
        slot = number % 2
        whole = (whole & ~np.uint64(1)) | np.uint64(slot)
        keys, spare = whole[filled], int(filled.sum()) - differ - 1
        if spare < 0:
            keys, spare = np.concatenate([keys, np.sort(whole[~filled])[:-spare]]), 0
        yield slot, keys.astype(np.int64), spare


def group_keys(shingles: np.ndarray, settings: Settings) -> np.ndarray:
    """Keys of which any two linked different sets share at least one."""
    return np.concatenate([np.zeros(0, np.int64), *(keys for _, keys, _ in bands(shingles, settings))])


SEEN = 1 << 18  # sets that a task remembers


def _describe(settings: Settings):
    """Sizes, fingerprints, keys and the spare ones by slot; of equal sets that a task meets, the first has them for all."""

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, seen, none = WordHashes(), set(), np.zeros(0, np.int64)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                shingles = shingle_set(text, settings.words, hashes)
                mark = fingerprint(shingles)
                found = [] if mark in seen else list(bands(shingles, settings))
                spares = {slot: spare for slot, _, spare in found}
                keys = np.concatenate([none, *(k for _, k, _ in found)])
                rows.append((len(shingles), *mark, spares.get(0, 0), spares.get(1, 0), keys))
                if len(seen) >= SEEN:
                    seen.clear()  # the keys are then given again
                seen.add(mark)
            out = pd.DataFrame(rows, columns=["n_shingles", "fa", "fb", "spare_0", "spare_1", "keys"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    return describe


def _shingles(settings: Settings):
    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(text, settings.words, hashes) for text in batch["text"]]
            marks = [fingerprint(s) for s in sets]
            yield pd.DataFrame({"fa": [m[0] for m in marks], "fb": [m[1] for m in marks],
                                "shingles": [s.astype(np.int64) for s in sets]})

    return shingles


POINTS = 1 << 23  # counts of a tile


class Forest:
    """Which members of a table of sets are connected; links are added one by one, the smaller side to the larger."""

    def __init__(self, labels: np.ndarray):
        _, self.of = np.unique(labels, return_inverse=True)
        order = np.argsort(self.of, kind="stable")
        cuts = np.flatnonzero(np.diff(self.of[order])) + 1
        self.members = dict(enumerate(np.split(order, cuts))) if len(order) else {}

    def join(self, left: int, right: int) -> None:
        a, b = int(self.of[left]), int(self.of[right])
        if a != b:
            if len(self.members[a]) < len(self.members[b]):
                a, b = b, a
            moved = self.members.pop(b)
            self.of[moved] = a
            self.members[a] = np.concatenate([self.members[a], moved])


class CountTree:
    """R-tree over count vectors: points packed by size into leaves, leaves into nodes, with the box of each."""

    def __init__(self, sets: list[np.ndarray], groups: int, leaf: int, fan: int):
        self.sizes = np.array([len(s) for s in sets])
        self.points = np.empty((len(sets), groups), np.int32)  # filled in place: a tile's counts are held once
        for point, s in zip(self.points, sets, strict=True):
            point[:] = np.bincount((mixed(s) >> np.uint64(17)) % np.uint64(groups), minlength=groups)
        # Sorted by size, then by the heaviest group: like sets share leaves.
        self.order = np.lexsort((self.points.argmax(axis=1), self.sizes))
        self.levels = []
        highest, smallest = self.points[self.order], self.sizes[self.order]
        largest, step = smallest, leaf
        while True:
            cuts = np.arange(0, len(smallest), step)
            highest = np.maximum.reduceat(highest, cuts)
            smallest, largest = np.minimum.reduceat(smallest, cuts), np.maximum.reduceat(largest, cuts)
            self.levels.append((step, highest, smallest, largest))
            if len(cuts) <= 1:
                break
            step = fan

    def near(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Members whose overlap with a point, by the bound, can make a link; boxes that can't are passed over."""
        places = np.array([0])
        for depth in range(len(self.levels) - 1, -1, -1):
            step, highest, smallest, largest = self.levels[depth]
            most = np.minimum(point, highest[places]).sum(axis=1)
            fits = self._enough(most, size, smallest[places], percent)
            fits &= (100 * largest[places] >= percent * size) & (percent * smallest[places] <= 100 * size)
            places = places[fits]
            if not len(places):
                return places
            below = len(self.levels[depth - 1][2]) if depth else len(self.order)
            places = (places[:, None] * step + np.arange(step)).ravel()
            places = places[places < below]
        members = self.order[places]
        most = np.minimum(point, self.points[members]).sum(axis=1)
        return members[self._enough(most, size, self.sizes[members], percent)]

    @staticmethod
    def _enough(common: np.ndarray, size: int, other: np.ndarray, percent: int) -> np.ndarray:
        # 100 * common >= percent * (size + other - common)
        return (100 + percent) * common >= percent * (size + other)


def _linked(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    if len(left) > len(right):
        left, right = right, left
    if 100 * len(left) < percent * len(right):
        return False
    at = np.searchsorted(right, left)
    at[at == len(right)] = 0
    common = int((right[at] == left).sum())
    return 100 * common >= percent * (len(left) + len(right) - common)


def join_sets(sets: list[np.ndarray], labels: np.ndarray, sides: np.ndarray | None, settings: Settings) -> list[tuple[int, int]]:
    """Links that connect what the sets' links connect, as pairs of places; none within an equal label.

    With sides (0 or 1), only pairs across are looked at.
    """
    if len(sets) < 2:
        return []
    largest = max(len(s) for s in sets)
    # A long set beside very many short ones has coarser counts: the points of a tile keep a bounded size.
    finest = int(math.log2(max(POINTS // len(sets), 16)))
    groups = 1 << int(min(max(math.ceil(math.log2(max(largest, 1) / 8 + 1)), 4), 11, finest))
    base = np.arange(len(sets)) if sides is None else np.flatnonzero(sides == 0)
    probes = np.arange(len(sets)) if sides is None else np.flatnonzero(sides == 1)
    if not len(base) or not len(probes):
        return []
    tree = CountTree([sets[i] for i in base], groups, settings.leaf, settings.nodes)
    points = tree.points if sides is None else CountTree([sets[i] for i in probes], groups, settings.leaf, settings.nodes).points
    forest, links = Forest(labels), []
    for place, probe in enumerate(probes):
        near = base[tree.near(points[place], len(sets[probe]), settings.percent)]
        if sides is None:
            near = near[near < probe]
        near = near[forest.of[near] != forest.of[probe]]
        for other in near:
            if forest.of[other] != forest.of[probe] and _linked(sets[probe], sets[other], settings.percent):
                links.append((int(probe), int(other)))
                forest.join(int(probe), int(other))
    return links


def _as_sets(frame: pd.DataFrame) -> list[np.ndarray]:
    # Sorted as unsigned, as they were made; searchsorted needs one order for both sides.
    return [np.asarray(s, np.int64).view(np.uint64) for s in frame["shingles"]]


def _within(settings: Settings):
    """Links inside each tile of a pack of tiles."""

    def within(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, tile in frame.groupby(["root", "band", "tile"], sort=False):
            tile = tile.sort_values(["n_shingles", "node"]).drop_duplicates("node")
            nodes = tile["node"].to_numpy()
            for left, right in join_sets(_as_sets(tile), np.arange(len(nodes)), None, settings):
                out.append((nodes[left], nodes[right]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return within


def _across(settings: Settings):
    """Links between two tiles of a cluster."""

    def across(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_shingles", "node"]).drop_duplicates("node")
        nodes = frame["node"].to_numpy()
        pairs = join_sets(_as_sets(frame), frame["label"].to_numpy(), frame["side"].to_numpy(), settings)
        return pd.DataFrame([(nodes[a], nodes[b]) for a, b in pairs], columns=["a", "b"], dtype="int64")

    return across


RUN = 1 << 17  # sets under one key that a task holds


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, fa, n) for the n sets under every key that several have, rows being sorted by key and set.

    Keys that may begin or end in another partition, or are too long to be held, come in pieces: their sets have n
    null, and a row with fa null has the size of the piece.
    """
    key, of, begun, before = np.zeros(0, np.int64), np.zeros(0, np.int64), None, None

    def table(key, of, n):
        return pd.DataFrame({"key": key, "fa": pd.array(of, "Int64"), "n": pd.array(n, "Int64")})

    def piece(key, of):
        return table(np.append(key, key[:1]), [*of.tolist(), None], [None] * len(key) + [len(key)])

    for batch in batches:
        key, of = np.concatenate([key, batch["key"].to_numpy()]), np.concatenate([of, batch["fa"].to_numpy()])
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
        if before is not None and len(key):
            new[0] = (key[0], of[0]) != before
        key, of = key[new], of[new]
        if not len(key):
            continue
        begun = key[0] if begun is None else begun
        starts = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)
        last = starts[-1]
        if last:
            at = starts[1] if key[0] == begun else 0
            if at:
                yield piece(key[:at], of[:at])
            sizes = np.diff(starts)
            n = np.repeat(sizes, sizes)
            many = (n > 1) & (np.arange(last) >= at)
            yield table(key[:last][many], of[:last][many], n[many])
        key, of, before = key[last:], of[last:], None
        if len(key) > RUN:
            yield piece(key, of)
            begun, before = key[0], (key[-1], of[-1])
            key, of = key[:0], of[:0]
    if len(key):
        yield piece(key, of)


def _telling(keyed: DataFrame, sets: DataFrame) -> DataFrame:
    """fa, keys: the sets that may link, with those of their first keys which other sets have, rare keys first.

    A key that no other set has tells nothing, and comes before all that are shared; so most sets of which parts are
    found in many others (passages, boilerplate) fill their first keys with their own. Keys are shuffled into ranges
    of (key, set): a key of very many sets is spread over several tasks. Each slot's go by themselves, so that half of
    them are on disk at a time. The table of keys is read here alone, and deleted then.
    """
    parts = []
    for slot in (0, 1):
        entries = keyed.select(F.explode("keys").alias("key"), "fa").where(F.col("key").bitwiseAND(F.lit(1)) == slot)
        ranged = entries.repartitionByRange("key", "fa").sortWithinPartitions("key", "fa")
        parts.append(written(ranged.mapInPandas(_shared, "key long, fa long, n long"), "shared"))
    drop_written(keyed)
    found = parts[0].unionByName(parts[1])
    totals = found.where(F.col("fa").isNull()).groupBy("key").agg(F.sum("n").alias("total")).where(F.col("total") > 1)
    pieces = found.where(F.col("fa").isNotNull() & F.col("n").isNull()).join(
        totals.withColumnRenamed("key", "of"), F.col("key") == F.col("of")
    ).select("key", "fa", F.col("total").alias("n"))
    shared = found.where(F.col("fa").isNotNull() & F.col("n").isNotNull()).unionByName(pieces)
    by_set = shared.groupBy("fa", F.col("key").bitwiseAND(F.lit(1)).alias("slot")).agg(
        F.sort_array(F.collect_list(F.struct("n", "key"))).alias("shared")
    )
    spares = sets.groupBy(F.col("fa").alias("of_set")).agg(F.max("spare_0").alias("spare_0"), F.max("spare_1").alias("spare_1"))
    first = by_set.join(spares, F.col("fa") == F.col("of_set")).withColumn(
        "first", F.size("shared") - F.when(F.col("slot") == 0, F.col("spare_0")).otherwise(F.col("spare_1"))
    ).where(F.col("first") > 0).select("fa", F.slice("shared", F.lit(1), F.col("first"))["key"].alias("keys"))
    first = written(first, "first_keys")
    for part in parts:
        drop_written(part)
    return first


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges (a, b) between sets that follow each other under one key, rows being sorted by key and set.

    A key may begin or end in another partition: the first and the last row are given with their key and b null.
    """
    last = None

    def ends(key, of):
        return pd.DataFrame({"key": pd.array([key], "Int64"), "a": [of], "b": pd.array([None], "Int64")})

    for batch in batches:
        key, of = batch["key"].to_numpy(), batch["fa"].to_numpy()
        if not len(key):
            continue
        if last is None:
            yield ends(key[0], of[0])
        else:
            key, of = np.append(last[0], key), np.append(last[1], of)
        last = key[-1], of[-1]
        at = np.flatnonzero((key[1:] == key[:-1]) & (of[1:] != of[:-1]))
        pairs = np.unique(np.stack([of[at], of[at + 1]]), axis=1)
        yield pd.DataFrame({"key": pd.array([None] * pairs.shape[1], "Int64"), "a": pairs[0], "b": pairs[1]})
    if last is not None:
        yield ends(*last)


def _clusters(sets: DataFrame) -> DataFrame:
    """fa, root: the sets that chains of shared groups connect, by half of their fingerprint.

    The keys are shuffled into ranges of (key, set): a key of very many sets is spread over several tasks. The table
    of keys is read here alone, and deleted then.
    """
    entries = sets.select(F.explode("keys").alias("key"), "fa")
    ranged = entries.repartitionByRange("key", "fa").sortWithinPartitions("key", "fa")
    found = written(ranged.mapInPandas(_neighbours, "key long, a long, b long"), "neighbours")
    drop_written(sets)
    ends = found.where(F.col("key").isNotNull())
    least = ends.groupBy("key").agg(F.min("a").alias("least")).select(F.col("key").alias("of"), "least")
    across = ends.join(least, F.col("key") == F.col("of")).select("a", F.col("least").alias("b"))
    edges = found.where(F.col("b").isNotNull()).select("a", "b").unionByName(across)
    clusters = components(edges).select(F.col("node").alias("in_cluster"), "root")
    drop_written(found)
    return clusters


def _links(documents: DataFrame, sets: DataFrame, keyed: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(classes, links): distinct sets that may link (node, fa, fb, n_shingles, doc_id), and links between nodes."""
    spark = documents.sparkSession
    clusters = written(_clusters(_telling(keyed, sets)), "clusters")
    classes = sets.where(F.col("n_shingles") > 0).groupBy("fa", "fb").agg(
        F.first("n_shingles").alias("n_shingles"), F.min("doc_id").alias("doc_id")
    )
    members = written(
        classes.join(clusters, F.col("fa") == F.col("in_cluster")).drop("in_cluster")
        .withColumn("node", F.monotonically_increasing_id()),  # written at once, so it stays
        "members",
    )
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(100 / settings.percent)).cast("int")
    drop_written(clusters)
    banded = members.withColumn("band", band)
    sums = banded.groupBy("root", "band").agg(F.sum("n_shingles").alias("of_band"))
    whole = sums.groupBy("root").agg(F.sum("of_band").alias("of_root"))
    # Small clusters are one tile; of large ones each band of sizes is dealt into tiles.
    tiles = sums.join(whole, "root").select(
        F.col("root").alias("t_root"), F.col("band").alias("t_band"),
        (F.col("of_root") > settings.tile_shingles).alias("large"),
        F.ceil(F.col("of_band") / settings.tile_shingles).cast("int").alias("n_tiles"),
    )
    tiled = written(
        banded.join(tiles, (F.col("root") == F.col("t_root")) & (F.col("band") == F.col("t_band"))).select(
            "node", "fa", "fb", "n_shingles", "doc_id", "root", "large",
            F.when(F.col("large"), F.col("band")).otherwise(0).alias("band"),
            F.when(F.col("large"), F.pmod(F.xxhash64("fa", "fb"), F.col("n_tiles"))).otherwise(0).cast("int").alias("tile"),
        ),
        "tiled",
    )
    total = tiled.agg(F.sum("n_shingles")).first()[0] or 0
    if not total:
        return members, spark.createDataFrame([], "a long, b long")
    # The sets themselves: the texts of one document of each class, found by id, are read once more.
    wanted = tiled.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("wanted")).distinct()
    texts = documents.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "text").join(
        wanted.hint("shuffle_hash"), F.col("id") == F.col("wanted"), "left_semi"
    ).select("text")
    contents = texts.mapInPandas(_shingles(settings), "fa long, fb long, shingles array<long>")
    full = tiled.select(F.col("fa").alias("of_a"), F.col("fb").alias("of_b"), "node", "n_shingles", "root", "large", "band", "tile")
    full = written(
        contents.join(full, (F.col("fa") == F.col("of_a")) & (F.col("fb") == F.col("of_b"))).select(
            "node", "n_shingles", "root", "large", "band", "tile", "shingles"
        ).dropDuplicates(["node"]),
        "contents",
    )
    packs = max(1, -(-total // settings.tile_shingles)) * 4
    pack = F.pmod(F.xxhash64("root", "band", "tile"), F.lit(packs))
    inside = written(
        full.withColumn("pack", pack).groupBy("pack").applyInPandas(_within(settings), "a long, b long"), "links"
    )
    if not tiled.where("large").limit(1).count():
        return members, inside
    # Pairs of tiles of the same band or the next, with what is connected already.
    known = components(inside).select(F.col("node").alias("in_node"), F.col("root").alias("known_label"))
    large = full.where("large").join(known, F.col("node") == F.col("in_node"), "left").select(
        "node", "n_shingles", "root", "band", "tile", "shingles", F.coalesce("known_label", "node").alias("label")
    )
    own = tiled.where("large").select("root", "band", "tile").distinct()
    other = own.select(F.col("root").alias("o_root"), F.col("band").alias("o_band"), F.col("tile").alias("o_tile"))
    pairs = written(
        own.join(other, (F.col("root") == F.col("o_root")) & (
            (F.col("o_band") == F.col("band") + 1) | ((F.col("o_band") == F.col("band")) & (F.col("o_tile") > F.col("tile")))
        )),
        "pairs",
    )
    sides = pairs.select("root", "band", "tile", F.lit(0).alias("side"), F.xxhash64("root", "band", "tile", "o_band", "o_tile").alias("pair")).unionByName(
        pairs.select("root", F.col("o_band").alias("band"), F.col("o_tile").alias("tile"), F.lit(1).alias("side"),
                     F.xxhash64("root", "band", "tile", "o_band", "o_tile").alias("pair")))
    across = written(
        large.join(sides, ["root", "band", "tile"]).select("pair", "side", "node", "n_shingles", "label", "shingles")
        .groupBy("pair").applyInPandas(_across(settings), "a long, b long"),
        "links",
    )
    return members, inside.unionByName(across)


def _described(documents: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(sets, keyed): every document's set by its fingerprint, and the group keys of the sets."""
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = written(
        documents.mapInPandas(
            _describe(settings),
            "doc_id long, n_shingles long, fa long, fb long, spare_0 int, spare_1 int, keys array<long>",
        ), "keys"
    )
    return written(keyed.drop("keys"), "sets"), keyed


def _classes(documents: DataFrame, sets: DataFrame, keyed: DataFrame, settings: Settings) -> DataFrame:
    """of_a, of_b, component_id, leads: each distinct set with shingles, and the smallest id of its component (null if
    the component has none). One set of each component leads."""
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    members, links = _links(documents, sets, keyed, settings)
    roots = components(links).withColumnRenamed("root", "in_root")
    least = written(
        members.join(roots, "node").select("fa", "fb", "in_root", "doc_id"), "roots"
    )
    smallest = least.groupBy("in_root").agg(
        F.min("doc_id").alias("smallest"), F.min(F.struct("fa", "fb")).alias("first")
    ).withColumnRenamed("in_root", "of_root")
    linked = least.join(smallest, F.col("in_root") == F.col("of_root")).select(
        "fa", "fb", "smallest", (F.struct("fa", "fb") == F.col("first")).alias("is_first")
    )
    alone = sets.where(F.col("n_shingles") > 0).groupBy("fa", "fb").agg(F.min("doc_id").alias("own"))
    return alone.join(linked, ["fa", "fb"], "left").select(
        F.col("fa").alias("of_a"), F.col("fb").alias("of_b"), F.coalesce("smallest", "own").alias("component_id"),
        F.coalesce("is_first", F.lit(True)).alias("leads"),
    )


def _joined(sets: DataFrame, classes: DataFrame) -> DataFrame:
    filled = sets.where(F.col("n_shingles") > 0).select("doc_id", "n_shingles", "fa", "fb").join(
        classes, (F.col("fa") == F.col("of_a")) & (F.col("fb") == F.col("of_b"))
    ).select("doc_id", "n_shingles", "component_id")
    empty = sets.where(F.col("n_shingles") == 0).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return filled.unionByName(empty)


def join(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id.

    component_id is the smallest doc_id reachable by links, itself included. Null, empty and blank texts have no
    shingles, link with nothing and keep their own id. Rows with a null doc_id take part; their ids don't count as
    smallest unless a component has no other. Repeated rows are equal sets and one component. An empty table gives no
    rows; other columns don't matter.
    """
    sets, keyed = _described(documents, settings)
    return _joined(sets, _classes(documents, sets, keyed, settings))


def _marks(settings: Settings):
    def marks(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(text, settings.words, hashes) for text in batch]
            yield pd.DataFrame([(len(s), *fingerprint(s)) for s in sets], columns=["n", "fa", "fb"])

    return F.pandas_udf(marks, "n long, fa long, fb long")


def without_copies(documents: DataFrame, settings: Settings = Settings(), null_ids: bool = False) -> DataFrame:
    """The documents whose doc_id is their component's, with all their columns: one of each group stays.

    Of rows that repeat an id those of one text count once. Rows without doc_id stay, unless null_ids: then one stays
    of each component without any id, and none of the others; those without shingles link with nothing and stay.
    """
    sets, keyed = _described(documents, settings)
    classes = written(_classes(documents, sets, keyed, settings), "classes")
    first = _joined(sets, classes).where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(
        F.count("*").alias("n_rows")
    )
    first = written(first, "first").select(F.col("doc_id").alias("first_id"), "n_rows")
    rows = documents.select(F.struct(*[F.col(f"`{name}`") for name in documents.columns]).alias("row"),
                            F.col("doc_id").cast("long").alias("id"))
    kept = rows.join(first.hint("shuffle_hash"), F.col("id") == F.col("first_id"))  # texts needn't be sorted
    once = kept.where(F.col("n_rows") == 1).select("row")
    if first.where(F.col("n_rows") > 1).limit(1).count():
        again = kept.where(F.col("n_rows") > 1).select("row", "id", F.col("row.text").alias("content"))
        once = once.unionByName(again.dropDuplicates(["id", "content"]).select("row"))
    nameless = rows.where(F.col("id").isNull()).select("row")
    if null_ids and sets.where(F.col("doc_id").isNull() & (F.col("n_shingles") > 0)).limit(1).count():
        marked = nameless.select("row", _marks(settings)(F.col("row.text").cast("string")).alias("mark"))
        leading = classes.where(F.col("component_id").isNull() & F.col("leads")).select("of_a", "of_b")
        one = marked.where(F.col("mark.n") > 0).select("row", F.col("mark.fa").alias("fa"), F.col("mark.fb").alias("fb")).join(
            leading, (F.col("fa") == F.col("of_a")) & (F.col("fb") == F.col("of_b")), "left_semi"
        ).dropDuplicates(["fa", "fb"]).select("row")
        nameless = marked.where(F.col("mark.n") == 0).select("row").unionByName(one)
    return once.unionByName(nameless).select("row.*")
