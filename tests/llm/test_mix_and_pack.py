"""Mixing and packing against brute force, the pipeline against its parts, and the queries with SQL."""

import itertools
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check
import corpus_pipeline
from frostline.llm import mixing, packing, queries, secret_scans

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# Mixing


def shared_out(sizes, weights=(5, 2, 1), share=1.5):
    """Targets by sharing out the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    capped, total = set(), share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        level = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if level[s] >= 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] for s in capped} | level
        capped |= over


def check_mix(rows, table):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(WORDS.findall(text or ""))
    want = shared_out(dict(sizes))
    out = mixing.mix(table).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) <= 1e-6 * max(1, want[r.source])
        assert 0 <= r.copies <= 2
    for source, target in want.items():
        own = [r for r in out if r.source == source]
        small = [r.size for r in own if r.size <= sizes[source] / len(own)]
        if target:
            rate = sum(r.size * r.copies for r in own) / target
            assert abs(rate - 1) * target <= max(max(small), max(r.size for r in own) / 2) + 1
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(table).collect()))


def test_mix_of_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check_mix([tuple(r) for r in table.select("doc_id", "text", "source").collect()], table)


def test_messy_mix(messy, empty):
    check_mix([tuple(r) for r in messy.select("doc_id", "text", "source").collect()], messy)
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    whole = mixing.mixed(messy)
    assert whole.columns == messy.columns
    taken = mixing.mix(messy)
    assert whole.count() == taken.agg(F.sum("copies")).first()[0]


def test_targets_stop_at_the_cap(spark):
    sources = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 0), (None, 100), ("\U0001f600", 5), ("\ufffd", 7)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sources).collect()}
    want = shared_out({"a": 10, "b": 1000, "c": 0, None: 100, "\U0001f600": 5, "\ufffd": 7})
    assert got == pytest.approx(want)


def test_newton_meets_every_target(spark):
    cases = [(s, t) for s in (1.0, 50.0, 1e9) for t in (1e-6, 0.3, 1.0, 7.0, 1e9)]
    table = spark.createDataFrame(cases, "s double, t double")
    for r in table.select("s", "t", F.exp(mixing.multiplier(F.col("s"), F.col("t"), 60)).alias("rate")).collect():
        assert r.rate * r.s == pytest.approx(r.t, rel=1e-9)


def dense_rates(sizes, target, most=2.0):
    """Rates of one source by halving the interval of the multiplier, in plain numpy."""
    sizes = np.asarray(sizes, float)
    if target <= 0 or target >= most * sizes.sum():
        return np.full(len(sizes), 0.0 if target <= 0 else most)
    low, high = -800.0 / sizes[sizes > 0].min(), 800.0 / sizes[sizes > 0].min()
    for _ in range(300):
        middle = (low + high) / 2
        if (sizes * np.minimum(most, np.exp(np.minimum(middle * sizes, 700)))).sum() > target:
            high = middle
        else:
            low = middle
    return np.minimum(most, np.exp(np.minimum(low * sizes, 700)))


def test_rates_as_by_a_dense_solver(spark):
    """Sources far below, near, far above and at their cap, with sizes of four orders of magnitude."""
    rng = np.random.default_rng(8)
    rows = [(int(i), int(x), f"s{s}") for s in range(9) for i, x in enumerate(rng.integers(1, 10 ** (1 + s % 4), 10 + 20 * s))]
    rows += [(0, 7, "single"), (1, 0, "empty"), (0, 50_000, "s8"), (5, 3, None), (6, 400, None)]
    sized = spark.createDataFrame(rows, "doc_id long, size long, source string")
    for share in (0.05, 0.9, 1.5, 1.95):
        settings = mixing.Settings(share=share)
        solved = mixing.solved(sized, settings)
        got = defaultdict(list)
        for r in mixing.join_sources(sized, solved).select("source", "target", "size", mixing.rate(settings).alias("rate")).collect():
            got[r.source, r.target].append((r["size"], r.rate))
        assert len(got) == 12
        for (source, target), pairs in got.items():
            sizes, rates = zip(*[p for p in sorted(pairs) if p[0]] or [(0, 0.0)], strict=True)
            assert np.allclose(rates, dense_rates(sizes, target) if sum(sizes) else 0, atol=1e-5), (share, source)
            assert sum(a * b for a, b in zip(sizes, rates, strict=True)) == pytest.approx(target, rel=1e-6, abs=1e-4)


def test_long_documents_are_taken_more_often_where_tokens_are_short(spark):
    rows = [(i, 1 + i % 100, "short") for i in range(2000)] + [(i, 1 + i % 100, "long") for i in range(6000)]
    table = spark.createDataFrame(rows, "doc_id long, n int, source string").select(
        "doc_id", "source", F.array_join(F.array_repeat(F.lit("w"), F.col("n")), " ").alias("text"))
    out = mixing.mix(table, mixing.Settings(weights=(1.0, 1.0), share=0.8)).collect()
    for source, sign in (("short", 1), ("long", -1)):
        own = [r for r in out if r.source == source]
        third = sorted(own, key=lambda r: r["size"])
        few, many = third[: len(own) // 3], third[-len(own) // 3 :]
        gain = sum(r.copies for r in many) / len(many) - sum(r.copies for r in few) / len(few)
        assert gain * sign > 0.1
        bucket = [r for r in own if 45 <= r["size"] <= 55]  # copies go by the rates
        assert abs(sum(r.copies for r in bucket) / len(bucket) - sum(r.rate for r in bucket) / len(bucket)) < 0.12


def test_a_source_for_each_of_many_documents(spark):
    rows = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.concat(F.lit("s"), F.col("id")).alias("source"))
    got = mixing.mix(rows).groupBy("copies").agg(F.count("*").alias("n"), F.sum("target").alias("t")).collect()
    assert sum(r.n for r in got) == 100_000 and sum(r.t for r in got) == pytest.approx(450_000, rel=1e-9)
    assert {r.copies for r in got} <= {0, 1, 2}


# Packing


def least_padding(lengths, buckets):
    """Padding of the best choice among all sets of boundaries."""
    distinct, best = sorted(set(lengths)), None
    for n in range(1, min(buckets, len(distinct)) + 1):
        for some in itertools.combinations(distinct[:-1], n - 1):
            edges = [*some, distinct[-1]]
            padding = sum(next(e for e in edges if e >= x) - x for x in lengths)
            best = padding if best is None else min(best, padding)
    return best


@pytest.mark.parametrize("seed", range(6))
def test_boundaries_are_optimal(seed):
    rng = np.random.default_rng(seed)
    lengths = np.sort(rng.integers(1, 60, 14) ** int(rng.integers(1, 3)))
    longest, counts = np.unique(lengths, return_counts=True)
    for buckets in (1, 2, 3, 5, 20):
        edges = packing.best_boundaries(longest, counts, longest * counts, buckets)
        padding = sum(min(e for e in edges if e >= x) - x for x in lengths.tolist())
        assert len(edges) <= buckets and padding == least_padding(lengths.tolist(), buckets)


def check_batches(rows, settings, sizes):
    assert sorted(r.size for r in rows) == sorted(sizes)
    batches = defaultdict(list)
    for r in rows:
        if r.size == 0:
            assert r.bucket is None and r.batch is None
            continue
        assert r.size <= r.boundary and 0 <= r.slot < r.batch_size
        assert r.batch_size == max(1, settings.token_budget // r.boundary)
        batches[r.bucket, r.batch].append(r.slot)
    for (bucket, batch), slots in batches.items():
        assert sorted(slots) == list(range(len(slots)))
        last = max(b for k, b in batches if k == bucket)
        assert batch == last or len(slots) == next(r.batch_size for r in rows if r.bucket == bucket)
    edges = sorted({r.boundary for r in rows if r.boundary})
    assert len(edges) <= settings.buckets
    for r in rows:
        assert not r.size or r.boundary == min(e for e in edges if e >= r.size)


def test_batches(spark, messy, empty):
    settings = packing.Settings(buckets=5, token_budget=3000, shard_rows=100)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    for documents in (table, messy, table.withColumn("doc_id", F.lit(1))):
        sizes = [len(WORDS.findall(r.text or "")) for r in documents.select("text").collect()]
        check_batches(packing.pack(documents, settings).collect(), settings, sizes)
    assert packing.pack(empty, settings).count() == 0


def test_long_lengths_share_bins(spark):
    settings = packing.Settings(exact_lengths=100)
    table = spark.range(50_000).selectExpr("id + 1 as size")
    bins = table.groupBy(packing.length_bin(F.col("size"), settings).alias("bin")).agg(F.min("size").alias("a"), F.max("size").alias("b")).collect()
    assert len(bins) < 7000 and all(r.b <= r.a * (1 + 1 / 1000) or r.b == r.a for r in bins)
    ordered = sorted(bins, key=lambda r: r.bin)
    assert all(x.b < y.a for x, y in itertools.pairwise(ordered))


# Pipeline and queries


def test_pipeline_stages(spark, messy):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        kept.append(docs)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    toxic, copies, secrets, mixed, packed = kept
    assert all(frame.columns == columns for frame in kept[:4])
    labels = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
    assert len(labels & {r.doc_id for r in toxic.collect()}) > 0.8 * len(labels)
    assert copies.select(F.lower("text")).distinct().count() == copies.count() < toxic.count()
    model = secret_scans.train(secret_scans.labelled_samples(secrets))
    assert secrets.count() == copies.count() and not secrets.where(
        F.exists(secret_scans.scan(F.col("text"), model), lambda s: s["rank"] < 3)).count()
    assert secrets.where(F.length("text") != F.col("n_chars")).count() == 0
    assert packed.count() == mixed.count() and Counter(r.doc_id for r in mixed.collect()).most_common(1)[0][1] <= 2
    assert corpus_pipeline.run(spark, SF).count() == packed.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, messy.where("false"), SF).count() == 0
        assert stage(spark, messy, SF).count() > 0


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in check.TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", queries.QUERIES)
def test_queries(spark, con, name):
    frame = queries.QUERIES[name](spark, SF)
    rows = frame.collect()
    assert rows and name in entry.queries()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if name.startswith(("op4_", "op8_")):
        assert not re.search("Python|Pandas|Arrow", plan)
    if name in queries.ORACLES:
        result = con.execute(queries.ORACLES[name])
        columns = [d[0] for d in result.description]
        assert sorted(frame.columns) == sorted(columns)
        assert check.rows_of(frame.columns, rows) == check.rows_of(columns, result.fetchall())
