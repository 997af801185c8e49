"""Cumulative-snapshot collapse of logged conversations, and their rendering.

Hashes of turn prefixes roll along each conversation. A conversation whose whole hash is a prefix hash of a longer one
is an earlier snapshot of it; an anti-join keeps the maximal conversations. Of equal ones the smallest id stays.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.sources.shared import written


@dataclass(frozen=True)
class Settings:
    """turn_block: places of a conversation that are rendered together; longer ones have several parts. It is also the
    number of turn numbers that are handled together, unless they hold more than `crowded` turns: then every turn
    number is handled apart, in ranges of its turns' hashes."""

    turn_block: int = 1024
    crowded: int = 1 << 16
    before_role: str = "<|"
    after_role: str = "|>\n"
    after_turn: str = "<|end|>\n"


def _block(settings: Settings) -> Column:
    return F.coalesce(F.floor(F.col("turn") / settings.turn_block), F.lit(-(1 << 62))).cast("long")


def _content(salt: int) -> Column:
    """Hash of role and text that tells null from empty."""
    return F.xxhash64(F.lit(salt), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text"))


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    ).select("conv_id", "turn", _content(21).alias("h1"), _content(22).alias("h2"), "role", "text")


def _sharded(conversations: DataFrame, settings: Settings) -> DataFrame:
    """conv_id, shard, turn, h1, h2: the distinct turns in bounded groups; the shards of a conversation are in its order.

    A shard is (block of turn numbers, turn, range of h1). Only a block with more than `crowded` turns uses the last
    two: then some of its turn numbers have very many turns, as those without a number may.
    """
    light = written(
        _turns(conversations).select("conv_id", "turn", "h1", "h2").distinct().withColumn("block", _block(settings)), "turns"
    )
    crowded = light.groupBy("conv_id", "block").agg(F.count("*").alias("rows")).where(F.col("rows") > settings.crowded).select(
        F.col("conv_id").alias("of_conv"), F.col("block").alias("of_block")
    )
    ranges = written(
        light.join(crowded, F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("block") == F.col("of_block")), "left_semi")
        .groupBy("conv_id", "turn").agg(F.ceil(F.count("*") / settings.turn_block).alias("ranges"))
        .select(F.col("conv_id").alias("of_conv"), F.col("turn").alias("of_turn"), "ranges"),
        "ranges",
    )
    apart = F.col("ranges").isNotNull()
    own_turn = F.when(apart, F.coalesce(F.col("turn"), F.lit(-(1 << 63)))).otherwise(F.lit(0))
    own_range = F.when(apart, F.floor((F.col("h1") / F.lit(2.0**64) + 0.5) * F.col("ranges"))).otherwise(F.lit(0))
    return light.join(
        ranges, F.col("conv_id").eqNullSafe(F.col("of_conv")) & F.col("turn").eqNullSafe(F.col("of_turn")), "left"
    ).select(
        "conv_id", F.struct("block", own_turn.cast("long").alias("turn"), own_range.cast("long").alias("range")).alias("shard"),
        "turn", "h1", "h2",
    )


def prefixes(conversations: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """conv_id, turn, h1, h2, place, p1, p2: the 128-bit hash of every prefix of a conversation, without texts.

    Turns are ordered by number (null first), turns of one number by a hash of their content; a repeated row of a
    conversation counts once. h1, h2 are the hash of role and text. The hash of a prefix is the exclusive or of its
    turns' hashes, each mixed with its place, so long conversations are hashed shard by shard and put together by the
    shards' sums; no task sorts a whole conversation.
    """
    light = written(
        _sharded(conversations, settings).withColumn(
            "within", F.expr("row_number() over (partition by conv_id, shard order by turn, h1, h2)")
        ),
        "numbered",
    )
    upto = "rows between unbounded preceding and 1 preceding"
    same_shard = F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("shard") == F.col("of_shard"))
    shards = light.groupBy("conv_id", "shard").agg(F.count("*").alias("rows")).select(
        F.col("conv_id").alias("of_conv"), F.col("shard").alias("of_shard"),
        F.expr(f"coalesce(sum(rows) over (partition by conv_id order by shard {upto}), 0)").alias("before"),
    )
    mixed = light.join(shards, same_shard).select(
        "conv_id", "shard", "turn", "h1", "h2", "within", (F.col("within") + F.col("before")).cast("long").alias("place")
    ).withColumns({"m1": F.xxhash64("place", "h1", "h2"), "m2": F.xxhash64("h2", "place", "h1")})
    mixed = written(mixed, "mixed")
    sums = mixed.groupBy("conv_id", "shard").agg(F.bit_xor("m1").alias("b1"), F.bit_xor("m2").alias("b2")).select(
        F.col("conv_id").alias("of_conv"), F.col("shard").alias("of_shard"),
        F.expr(f"coalesce(bit_xor(b1) over (partition by conv_id order by shard {upto}), 0)").alias("c1"),
        F.expr(f"coalesce(bit_xor(b2) over (partition by conv_id order by shard {upto}), 0)").alias("c2"),
    )
    rolled = mixed.select(
        "conv_id", "shard", "turn", "h1", "h2", "place",
        F.expr("bit_xor(m1) over (partition by conv_id, shard order by within)").alias("r1"),
        F.expr("bit_xor(m2) over (partition by conv_id, shard order by within)").alias("r2"),
    )
    return rolled.join(sums, same_shard).select(
        "conv_id", "turn", "h1", "h2", "place", F.expr("r1 ^ c1").alias("p1"), F.expr("r2 ^ c2").alias("p2")
    )


def maximal(rolled: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies: the maximal conversations of a table of prefixes.

    n_copies counts the conversations with the same turns. Null is a conversation id like any other.
    """
    ends = rolled.groupBy("conv_id").agg(F.max("place").alias("n_turns")).withColumnRenamed("conv_id", "of_conv")
    with_end = rolled.select("conv_id", "place", "p1", "p2").join(ends, F.col("conv_id").eqNullSafe(F.col("of_conv"))).drop("of_conv")
    with_end = written(with_end, "ends")
    whole = with_end.where(F.col("place") == F.col("n_turns")).groupBy("n_turns", "p1", "p2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies")
    )
    inner = with_end.where(F.col("place") < F.col("n_turns")).select("place", "p1", "p2").distinct()
    return whole.join(inner.withColumnRenamed("place", "n_turns"), ["n_turns", "p1", "p2"], "left_anti").select(
        "conv_id", "n_turns", "n_copies"
    )


def render(conversations: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """conv_id, part, n_turns, n_copies, rendered: each maximal conversation in the chat format.

    A turn becomes <|role|>, a line break, the text, <|end|> and a line break; a null role is rendered as unknown, a
    null text as empty. part numbers the blocks of turn_block places (the first 1,024 turns are part 0), whatever the
    turns' numbers are; a conversation has one part unless it is longer, and no part has more turns. An empty table
    gives no rows; other columns don't matter. The texts are shuffled by turn, where repeated rows become one, and
    those of maximal conversations by part, so that a conversation with most of all turns is spread.
    """
    rolled = written(prefixes(conversations, settings), "prefixes")
    kept = written(maximal(rolled), "maximal").withColumnRenamed("conv_id", "of_conv")
    # One struct as key: its null fields are equal to each other. Its type is the same on both sides (hashes are never
    # null), so the texts keep their partitions for the join.
    key = F.struct("conv_id", "turn", *[F.coalesce(h, F.lit(0)).alias(h) for h in ("h1", "h2")]).alias("key")
    places = rolled.join(kept, F.col("conv_id").eqNullSafe(F.col("of_conv"))).select(
        key, "conv_id", "place", F.floor((F.col("place") - 1) / settings.turn_block).cast("long").alias("part"), "n_turns", "n_copies"
    )
    texts = _turns(conversations).select(key, "role", "text").groupBy("key").agg(
        F.first("role").alias("role"), F.first("text").alias("text")
    )
    piece = lambda t: F.concat(
        F.lit(settings.before_role), F.coalesce(t["role"], F.lit("unknown")), F.lit(settings.after_role),
        F.coalesce(t["text"], F.lit("")), F.lit(settings.after_turn),
    )
    parts = places.join(texts, "key").groupBy("conv_id", "part").agg(
        F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"),
        F.collect_list(F.struct("place", "role", "text")).alias("turns"),
    )
    return parts.select(
        "conv_id", "part", "n_turns", "n_copies",
        F.array_join(F.transform(F.sort_array("turns"), piece), "").alias("rendered"),
    )
