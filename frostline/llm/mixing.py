"""Mixing sources to target weights by entropy balancing, in DataFrame functions alone.

The token constraint of a source is  sum of rate * size = target.  Among all rates that meet it, with none above `most`,
those closest in entropy to 'every document once' are  min(most, exp(multiplier * size)),  one multiplier for each source:
a source short of its target takes its long documents more often, one above it takes them less. The multipliers maximise
the concave dual; a document belongs to one source, so its Hessian is diagonal, and each round of Newton's method gets
gradient and curvature of all sources by one aggregation over the documents, counted by source and size. Rates then
become whole copies.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm.text import word_count
from frostline.sources.shared import drop_written, written


@dataclass(frozen=True)
class Settings:
    """weights: of the sources by code point, null last, repeating. share: tokens of the mix by those of the input.

    most: copies of one document at most; a source's target stops there and the excess is shared among the rest.
    steps: Newton steps at most, of the first guess and of the rounds. exact: relative miss at which a source is done (or a
    millionth of a token).
    slots: parts of the hash range in which the rounding looks for its cut.
    """

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    most: int = 2
    steps: int = 60
    exact: float = 1e-9
    slots: int = 1024


def _before(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """Rows with running sums over all earlier rows of an order, which should be total.

    Sums are taken inside ranges of the order, and over one row for each range, so that no task has all rows.
    """
    upto = "rows between unbounded preceding and 1 preceding"
    keys = {f"_key{i}": c for i, c in enumerate(order)}
    ranged = written(
        rows.withColumns(keys | {f"_{n}": c for n, c in sums.items()}).repartitionByRange(*keys)
        .withColumn("_range", F.spark_partition_id()),
        "ranges",
    )
    offsets = ranged.groupBy("_range").agg(*[F.sum(f"_{n}").alias(f"_{n}_sum") for n in sums]).selectExpr(
        "_range as _of", *[f"coalesce(sum(_{n}_sum) over (order by _range {upto}), 0) as _{n}_before" for n in sums]
    )
    inside = f"partition by _range order by {', '.join(keys)} {upto}"
    return ranged.join(offsets, F.col("_range") == F.col("_of")).selectExpr(
        *[f"`{n}`" for n in rows.columns], *[f"coalesce(sum(_{n}) over ({inside}), 0) + _{n}_before as {n}" for n in sums]
    )


def targets(sources: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """sources (source, source_size) with target: source, source_size, target.

    Capping in ascending order of most * size / weight gives the same as sharing out the excess until none is above:
    a source is capped if its cap is at most its share of what the sources before it leave. There may be as many sources
    as documents: their place by name and the sums over those before them come from ranges.
    """
    named = _before(sources.select("source", "source_size"), [F.col("source").isNull(), F.col("source")], place=F.lit(1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in settings.weights]),
                          (F.pmod(F.col("place"), F.lit(len(settings.weights))) + 1).cast("int"))
    placed = written(named.select(
        "source", "source_size", weight.alias("weight"), (F.col("source_size") * settings.most).cast("double").alias("cap")
    ), "weights")
    sums = placed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    total, weights = settings.share * (sums.size or 0), sums.weight or 0.0
    # Sources without tokens have cap 0 and come first: they never take part in the sharing.
    order = [F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source")]
    shared = _before(placed, order, caps_before=F.col("cap"), weights_before=F.col("weight")).withColumn(
        "capped", F.col("cap") * (F.lit(weights) - F.col("weights_before"))
        <= F.col("weight") * (F.lit(total) - F.col("caps_before"))
    )
    shared = written(shared, "shared")
    free = shared.agg(F.sum(F.when(F.col("capped"), F.col("cap"))).alias("caps"),
                      F.sum(F.when(~F.col("capped"), F.col("weight"))).alias("weights")).first()
    target = F.when(F.col("capped"), F.col("cap")).otherwise(
        F.col("weight") * F.lit(total - (free.caps or 0.0)) / F.lit(free.weights or 1.0)
    )
    return shared.select("source", "source_size", target.cast("double").alias("target"))


def multiplier(size: Column, target: Column, steps: int) -> Column:
    """Newton's method for equal rates in a source, where the rounds begin; null where the target or the size is 0.

    l + (target - size * exp(l)) / (size * exp(l)): the first step may overshoot upwards, from there the steps fall
    onto the root; moves are held within 1 so that no exponential overflows.
    """
    move = lambda l: F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (target - size * F.exp(l)) / (size * F.exp(l))))
    return F.when((size > 0) & (target > 0),
                  F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), lambda l, _: l + move(l)))


def rate(settings: Settings = Settings()) -> Column:
    """How often a document of some size is taken on average, with the columns of solved()."""
    tilted = F.exp(F.least(F.lit(700.0), F.col("tilt") * F.col("size") / F.col("mean")))
    most = F.lit(float(settings.most))
    return F.when(F.col("target") <= 0, F.lit(0.0)).when(F.col("full"), most).otherwise(
        F.least(most, F.round(tilted, 9))
    )


def _exact_sum(value: Column) -> Column:
    """Sum of doubles that doesn't depend on their order: they are counted in billionths."""
    return F.sum(F.round(value * 1e9).cast("decimal(38,0)")).cast("double") / 1e9


def solved(sized: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per source: source, source_size, target, mean, full, tilt.

    tilt: multiplier of size / mean. full: the target is all that the copies can give. The documents are counted by source
    and size once; a round joins these counts to the sources that are not done and sums gradient and curvature. A step
    that leaves what is known to hold the root is replaced by halving that, or, while it is open, by a longer one.
    """
    sums = written(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), "sources")
    counts = written(sized.where(F.col("size") > 0).groupBy("source", "size").agg(F.count("*").alias("n")), "counts")
    size, most = F.col("source_size").cast("double"), F.lit(float(settings.most))
    state = written(
        _beside(targets(sums.select("source", "source_size"), settings), sums.select("source", "rows")).select(
            "source", "source_size", "target", (size / F.col("rows")).alias("mean"),
            (F.col("target") >= most * size).alias("full"),
            F.coalesce(multiplier(size, F.col("target"), settings.steps), F.lit(0.0)).alias("tilt"),
            F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
        ).withColumn("done", F.col("full") | (F.col("target") <= 0)),
        "tilts",
    )
    for _ in range(settings.steps):
        if not state.where(~F.col("done")).limit(1).count():
            break
        ratio = F.exp(F.least(F.lit(700.0), F.col("tilt") * F.col("size") / F.col("mean")))
        tokens = F.col("n") * F.col("size")
        open_now = state.where(~F.col("done")).select("source", "tilt", "mean")
        slopes = join_sources(counts, open_now).groupBy("source").agg(
            _exact_sum(tokens * F.least(most, ratio)).alias("given"),
            _exact_sum(F.when(ratio < most, tokens * F.col("size") / F.col("mean") * ratio).otherwise(0.0)).alias("slope"),
        )
        tilt, miss = F.col("tilt"), F.col("given") - F.col("target")
        low = F.when(miss < 0, tilt).otherwise(F.col("low"))
        high = F.when(miss > 0, tilt).otherwise(F.col("high"))
        newton = F.when(F.col("slope") > 0, tilt - miss / F.col("slope"))
        reach = F.greatest(F.lit(1.0), F.abs(tilt) * 2)
        inside = newton.isNotNull() & (F.abs(newton - tilt) <= reach) & (newton > F.coalesce("next_low", newton - 1)) & (
            newton < F.coalesce("next_high", newton + 1))
        step = F.when(inside, newton).when(F.col("next_low").isNull(), tilt - reach).when(
            F.col("next_high").isNull(), tilt + reach).otherwise((F.col("next_low") + F.col("next_high")) / 2)
        known = _beside(state, slopes, "left").withColumn("next_low", low).withColumn("next_high", high)
        done = F.col("done") | (F.abs(miss) <= settings.exact * F.col("target") + 1e-6) | (
            F.col("next_high") - F.col("next_low") <= 1e-14 * F.abs(tilt))
        following = known.withColumn("ended", F.coalesce(done, F.lit(False))).select(
            "source", "source_size", "target", "mean", "full", F.when(F.col("ended"), tilt).otherwise(step).alias("tilt"),
            F.col("next_low").alias("low"), F.col("next_high").alias("high"), F.col("ended").alias("done"),
        )
        earlier, state = state, written(following, "tilts")
        drop_written(earlier)
    return state.select("source", "source_size", "target", "mean", "full", "tilt")


def _order(salt: int, part: Column) -> Column:
    """Place of a document in the order of rounding, from its hash and the part of a copy that it is owed.

    Taken in the order of hash / part up to a goal, documents are taken about as often as their part says. Equal rows go
    together.
    """
    even = F.xxhash64(F.lit(salt), F.col("doc_id"), F.col("size")).cast("double") / float(1 << 64) + 0.5
    return F.when(part > 0, ((even / (even + part) - 0.5) * float(1 << 63)).cast("long"))


def _cuts(sized: DataFrame, goals: DataFrame, settings: Settings) -> DataFrame:
    """source, cut: documents whose place is at most the cut get one more copy, so that the source's goal is met.

    sized: source, place, size, of those documents that take part; goals: source, goal (tokens). The sums of the slots
    show in which slot the goal is met; only that slot's documents are put in order. Rows of equal place count as one.
    The one across the goal goes in if more than half of it fits.
    """
    width = (1 << 64) // settings.slots
    slot = F.floor(F.col("place") / F.lit(float(width)))
    sums = sized.groupBy("source", slot.alias("slot")).agg(F.sum("size").alias("tokens"))
    before = sums.withColumn("before", F.expr(
        "coalesce(sum(tokens) over (partition by source order by slot rows between unbounded preceding and 1 preceding), 0)"
    ))
    goal = goals.select("source", "goal")
    met = _beside(before, goal).where(
        (F.col("before") <= F.col("goal")) & (F.col("goal") < F.col("before") + F.col("tokens"))
    ).select(F.col("source").alias("of_source"), F.col("slot").alias("met_slot"), "before", "goal")
    ranked = sized.withColumn("slot", slot).join(
        met, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("slot") == F.col("met_slot"))
    ).groupBy("source", "place").agg(
        F.sum("size").alias("size"), F.first("before").alias("before"), F.first("goal").alias("goal")
    ).withColumn("upto", F.col("before") + F.expr("sum(size) over (partition by source order by place)"))
    last = ranked.groupBy("source").agg(
        F.max(F.when(F.col("upto") - F.col("size") / 2 <= F.col("goal"), F.col("place"))).alias("inside"),
        F.min("place").alias("least"),
    ).select("source", F.coalesce("inside", F.col("least") - 1).alias("last_in"))
    # A goal beyond all slots takes everything.
    return _beside(goal, last, "left").select(
        "source", F.when(F.col("last_in").isNotNull(), F.col("last_in"))
        .when(F.col("goal") <= 0, F.lit(-(1 << 63))).otherwise(F.lit((1 << 63) - 1)).alias("cut"),
    )


def _beside(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on source, null-safe; the other columns must differ in name."""
    right = right.withColumnRenamed("source", "of_source")
    return left.join(right, F.col("source").eqNullSafe(F.col("of_source")), how).drop("of_source")


def plan(sized: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per source: source, source_size, target, mean, full, tilt, big_cut, small_cut.

    sized: doc_id, size, source. Every document is taken floor(rate) times; the rest of the target is met by one more
    copy of the documents up to the cut, in an order that goes by hash and the rest of the rate. Documents above their
    source's mean size are rounded first and the smaller ones then meet what is left, so a source misses its target by
    about half a mean document.
    """
    per_source = written(solved(sized, settings), "rates")
    part = F.col("rate") - F.floor("rate")
    docs = join_sources(sized, per_source).where(F.col("size") > 0).withColumn("rate", rate(settings)).select(
        "source", "size", "rate", part.alias("part"), _order(5, part).alias("place"), (F.col("size") > F.col("mean")).alias("big")
    )
    sums = docs.groupBy("source").agg(
        F.sum(F.floor("rate") * F.col("size")).alias("floors"), _exact_sum(F.when(F.col("big"), part * F.col("size"))).alias("goal")
    )
    goals = written(_beside(per_source, sums, "left").select(
        "source", "target", F.coalesce("floors", F.lit(0)).alias("floors"), F.coalesce("goal", F.lit(0.0)).alias("goal")
    ), "goals")
    owed = docs.where(F.col("part") > 0)
    big, small = owed.where("big").select("source", "place", "size"), owed.where("not big").select("source", "place", "size")
    big_cut = written(_cuts(big, goals.select("source", "goal"), settings), "cuts")
    taken = join_sources(big, big_cut).where(F.col("place") <= F.col("cut")).groupBy("source").agg(
        F.sum("size").alias("big_taken")
    )
    rest = _beside(goals.select("source", "target", "floors"), taken, "left").withColumn(
        "goal", F.greatest(F.lit(0.0), F.col("target") - F.col("floors") - F.coalesce("big_taken", F.lit(0)))
    )
    small_cut = _cuts(small, rest, settings).withColumnRenamed("cut", "small_cut")
    both = _beside(big_cut.withColumnRenamed("cut", "big_cut"), small_cut)
    return written(_beside(per_source, both), "mix")


def join_sources(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with the columns of their source, null-safe.

    The side of the sources is broadcast only if it has few enough rows; else Spark joins by sort, where adaptive
    execution splits a source with many documents.
    """
    few = sources.limit(20_001).count() <= 20_000
    side = sources.withColumnRenamed("source", "of_source")
    side = F.broadcast(side) if few else side
    return documents.join(side, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")


def copies(settings: Settings = Settings()) -> Column:
    """Copies of a document with the columns of plan() and doc_id and size. Empty documents carry no tokens: floor."""
    cut = F.when(F.col("size") > F.col("mean"), F.col("big_cut")).otherwise(F.col("small_cut"))
    often = rate(settings)
    part = often - F.floor(often)
    more = (F.col("size") > 0) & (part > 0) & (_order(5, part) <= cut)
    return F.least(F.lit(settings.most), F.floor(often) + F.coalesce(more, F.lit(False)).cast("int")).cast("int")


def mix(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document row: doc_id, size, source, source_size, target, rate, copies.

    Null and empty texts have size 0 and are taken once, or as often as all others of a source whose rates are all 0 or
    `most`; a null source is a source of its own; repeated rows are decided alike; sources without tokens have target 0
    and are taken 0 times; an empty table gives no rows. Other columns don't matter.
    """
    sized = written(
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), word_count(F.col("text")).alias("size"),
                         F.col("source").cast("string").alias("source")),
        "sizes",
    )
    return join_sources(sized, plan(sized, settings)).select(
        "doc_id", "size", "source", "source_size", "target", rate(settings).alias("rate"), copies(settings).alias("copies"),
    )


def mixed(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents as often as the mix takes them, with their own columns."""
    names = documents.columns
    sized = documents.select(
        F.struct(*[F.col(f"`{name}`") for name in names]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        word_count(F.col("text")).alias("size"), F.col("source").cast("string").alias("source"),
    )
    few = written(sized.select("doc_id", "size", "source"), "sizes")
    taken = join_sources(sized, plan(few, settings)).where(copies(settings) > 0)
    times = F.sequence(F.lit(1), copies(settings))
    return taken.select("row", F.explode(times)).select("row.*")
