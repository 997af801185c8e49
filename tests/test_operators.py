"""Shared operators against brute force, with ties, gaps and a hot key."""

import random
from bisect import bisect_left, bisect_right
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frostline.operators import latest, prefixes, timeline

START = datetime(2024, 1, 1)
NTZ = T.TimestampNTZType()


def frame(spark, rows, **columns):
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "t": NTZ}
    return spark.createDataFrame(rows, T.StructType([T.StructField(n, kinds[k]) for n, k in columns.items()]))


def moments(rng, n, spread):
    return [START + timedelta(seconds=rng.randrange(spread)) for _ in range(n)]


def hot_key(rng):
    """A third of the rows belong to one key."""
    return "hot" if rng.random() < 0.34 else f"k{rng.randrange(20)}"


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("slice_seconds, hot_rows", [(1, 0), (60, 0), (60, 50), (10**9, 0), (60, 10**6)])
def test_carry_last(spark, inclusive, slice_seconds, hot_rows):
    rng = random.Random(slice_seconds)
    rows = [
        (hot_key(rng), at, i, rng.choice([None, "a", "b", "c"]))
        for i, at in enumerate(moments(rng, 600, 5000))
    ]
    df = frame(spark, rows, key="s", at="t", id="i", value="s")
    got = timeline.carry_last(df, ["key"], "at", ["id"], F.col("value"), "last", inclusive, slice_seconds, hot_rows)
    last, expected = {}, {}
    for key, _, number, value in sorted(rows, key=lambda r: (r[1], r[2])):
        before = last.get(key)
        last[key] = value if value is not None else before
        expected[number] = last[key] if inclusive else before
    assert {r.id: r["last"] for r in got.collect()} == expected
    assert set(got.columns) == {"key", "at", "id", "value", "last"}


@pytest.mark.parametrize("span", [0, 900])
@pytest.mark.parametrize("slice_seconds, hot_rows", [(1, 0), (45, 0), (45, 60), (10**9, 0), (45, 10**6)])
def test_marks_between(spark, slice_seconds, span, hot_rows):
    rng = random.Random(span * 7 + slice_seconds)
    marks = [(hot_key(rng), at) for at in moments(rng, 500, 3000)]
    probes = [(hot_key(rng), str(i), at) for i, at in enumerate(moments(rng, 200, 3000))]
    probes.append(("nobody", "x", START))
    width = timedelta(seconds=span)
    asked = frame(spark, [(k, i, at - width, at + width) for k, i, at in probes], key="s", id="s", low="t", high="t")
    got = timeline.marks_between(
        asked, frame(spark, marks, key="s", seen="t"), "key", "id", "low", "high", "seen", slice_seconds, hot_rows
    )
    expected = {}
    for key, number, at in probes:
        times = sorted(t for k, t in marks if k == key)
        inside = times[bisect_left(times, at - width):bisect_right(times, at + width)]
        expected[number] = (len(inside), inside[0] if inside else None, inside[-1] if inside else None)
    assert {r.id: (r.n_marks, r.first_mark, r.last_mark) for r in got.collect()} == expected


@pytest.mark.parametrize("slice_seconds", [1, 60, 10**9])
def test_value_at(spark, slice_seconds):
    rng = random.Random(slice_seconds)
    changes = [(at, str(i), rng.choice(["30", "60", None])) for i, at in enumerate(moments(rng, 60, 4000))]
    changes += [(changes[0][0], "zz", "90")]
    rows = [(i, at) for i, at in enumerate(moments(rng, 400, 5000))]
    rows += [(1000, START - timedelta(days=1)), (1001, START + timedelta(days=9)), (1002, changes[0][0])]
    got = timeline.value_at(
        frame(spark, rows, id="i", at="t"), "at", frame(spark, changes, changed="t", tie="s", value="s"),
        "changed", "tie", "value", "now", slice_seconds,
    )
    ordered = sorted(changes, key=lambda c: (c[0], c[1]))
    expected = {}
    for number, at in rows:
        made = [c[2] for c in ordered if c[0] <= at]
        expected[number] = made[-1] if made else None
    assert {r.id: r.now for r in got.collect()} == expected


def test_value_at_without_changes(spark):
    rows = frame(spark, [(1, START)], id="i", at="t")
    none = frame(spark, [], changed="t", tie="s", value="s")
    assert timeline.value_at(rows, "at", none, "changed", "tie", "value", "now").first().now is None


def test_value_at_with_a_million_changes_in_one_slice(spark):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    micros = lambda n: start + F.expr(f"make_dt_interval(0, 0, 0, ({n}) / 1000000.0)")
    changes = spark.range(1_000_000).select(micros("id * 50").alias("at"), F.lit("t").alias("tie"), F.col("id").cast("string").alias("value"))
    rows = spark.range(20_000).select("id", micros("id * 3000 + 1").alias("at"))  # the last after all changes
    got = timeline.value_at(rows, "at", changes, "at", "tie", "value", "now")
    wrong = got.where(~F.col("now").eqNullSafe(F.least(F.col("id") * 60, F.lit(999_999)).cast("string")))
    assert got.count() == 20_000 and wrong.count() == 0
    _, slices = timeline._slices(rows, "at", changes.select("at", "value"), 60, 256)
    assert slices.agg(F.max(F.size("_inside"))).first()[0] <= 256


@pytest.mark.parametrize("slice_seconds, most", [(7, 1), (60, 3), (10**9, 2)])
def test_value_at_in_finer_slices(spark, slice_seconds, most):
    rng = random.Random(most)
    at = lambda: START + timedelta(days=rng.choice([-20000, 0, 3]), microseconds=rng.randrange(10**rng.randrange(1, 9)))
    changes = [(at(), str(i), rng.choice(["30", "60", None])) for i in range(200)]
    rows = [(i, at()) for i in range(400)] + [(900, None), (901, changes[0][0])]
    got = timeline.value_at(
        frame(spark, rows, id="i", at="t"), "at", frame(spark, changes, changed="t", tie="s", value="s"),
        "changed", "tie", "value", "now", slice_seconds, most,
    )
    ordered = sorted(changes, key=lambda c: (c[0], c[1]))
    expected = {number: ([c[2] for c in ordered if when and c[0] <= when] or [None])[-1] for number, when in rows}
    assert {r.id: r.now for r in got.collect()} == expected and got.columns == ["id", "at", "now"]


def test_latest_by(spark):
    rows = [("a", START, "1", "x"), ("a", START + timedelta(1), "1", None), ("b", START, "1", "y"), ("b", START, "2", "z")]
    df = frame(spark, rows, key="s", at="t", tie="s", value="s")
    got = latest.latest_by(df, ["key"], [F.col("at"), F.col("tie")])
    assert got.columns == df.columns
    assert {r.key: r.value for r in got.collect()} == {"a": None, "b": "z"}


def test_assign_buckets_is_the_expression_for_tables(spark):
    from frostline.functions import paths

    mapping = {"/a": "short", "/a/b": "long", "/a/b/c/d": "too long", "/z": "z"}
    files = [("/a/b/c",), ("/a/b/c",), ("/a",), ("/q",), (None,), ("",), ("/a/b/c/d/e",)]
    df = frame(spark, files, path="s")
    table = frame(spark, list(mapping.items()), prefix="s", bucket="s")
    got = prefixes.assign_buckets(df, "path", table)
    same = df.withColumn("bucket", paths.mapped_bucket(F.col("path"), mapping))
    order = lambda rows: sorted((str(r.path), str(r.bucket)) for r in rows)
    assert order(got.collect()) == order(same.collect())


def test_sieve_keeps_every_wanted_row(spark, monkeypatch):
    from frostline.operators import skew

    rows = frame(spark, [(f"k{i}",) for i in range(1000)] + [(None,)], key="s")
    wanted = frame(spark, [(f"k{i}",) for i in range(0, 1000, 50)], key="s")
    def sieved():
        return skew.sieve(skew.classed(rows, ["key"]), skew.classed(wanted, ["key"]))

    kept = {r.key for r in sieved().collect()}
    assert {f"k{i}" for i in range(0, 1000, 50)} <= kept and len(kept) < 100
    monkeypatch.setattr(skew, "CLASSES", 1)
    assert sieved().count() == 1001


def test_hot_classes_hold_every_hot_key(spark):
    from frostline.operators import skew

    rows = skew.classed(frame(spark, [("hot",)] * 300 + [(f"k{i}",) for i in range(600)], key="s"), ["key"])
    flagged = skew.flag_hot(rows, skew.hot_classes(rows, 100), "hot")
    assert {r.key for r in flagged.where("hot").collect()} == {"hot"}
    assert flagged.count() == 900 and flagged.where("NOT hot").count() == 600


@pytest.mark.parametrize("how, expected", [("inner", 3), ("left", 4), ("left_semi", 3), ("left_anti", 1)])
def test_lookup_is_the_join(spark, how, expected):
    from frostline.operators import skew

    rows = frame(spark, [("a", 1), ("a", 2), ("b", 3), (None, 4)], key="s", id="i")
    table = frame(spark, [("a", "x"), ("b", "y"), ("c", "z"), (None, "n")], key="s", value="s")
    got = skew.lookup(rows, table, ["key"], how)
    assert got.count() == expected and "_digest" not in got.columns


def test_lookup_splits_a_hot_key_of_an_aggregated_table(spark):
    from frostline.operators import skew

    before = spark.conf.get("spark.sql.shuffle.partitions")
    conf = {
        "spark.sql.shuffle.partitions": "32",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
    }
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        rows = spark.range(0, 200_000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("key"),
            F.md5(F.col("id").cast("string")).alias("text"),
        )
        table = spark.range(0, 50_000).groupBy(F.col("id").cast("string").alias("key")).agg(F.max("id").alias("m"))
        for how in ("inner", "left", "left_semi", "left_anti"):
            joined = skew.lookup(rows, table, ["key"], how)
            joined.collect()
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "skew=true" in plan
    finally:
        for key in conf:
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_first_rows_of_many(spark, monkeypatch):
    from frostline.operators import first_rows

    rows = spark.range(1000).select((F.col("id") * 37 % 101).alias("at"), "id").repartition(6)
    want = sorted((i * 37 % 101, i) for i in range(1000))
    monkeypatch.setattr(first_rows, "FEW", 10)
    for n in (0, 3, 10, 11, 500, 999, 1000, 5000):
        got = sorted(tuple(r) for r in first_rows.first_rows(rows, ["at", "id"], n).collect())
        assert got == want[:n], n
