"""Object jobs on local files."""

import hashlib

from pyspark.sql import functions as F

from frostline import constants as C
from frostline.sources import objects


def jobs(spark, *rows):
    return spark.createDataFrame(rows, "handle string, source_key string, dest_key string").withColumn(
        "metadata", F.create_map(F.lit("p-source-md5"), F.lit(""), F.lit("p-element-handle"), F.col("handle"))
    )


def test_copy_streams_verifies_and_isolates_failures(spark, tmp_path, monkeypatch):
    source, dest = tmp_path / "s", tmp_path / "d"
    source.mkdir(), dest.mkdir()
    big = bytes(range(256)) * 100_000  # more than one chunk
    (source / "big").write_bytes(big)
    (source / "empty").write_bytes(b"")
    rows = jobs(spark, ("1", "big", "x/y/big"), ("2", "empty", "empty"), ("3", "none", "none"), ("4", "../s/big", "up"))
    got = {r.handle: r for r in objects.copy_objects(rows, str(source), str(dest), True, "p").collect()}
    md5 = hashlib.md5(big).hexdigest()
    assert (got["1"].status, got["1"].source_md5, got["1"].destination_md5) == (C.COPIED, md5, md5)
    assert got["1"].bytes_copied == len(big) and (dest / "x/y/big").read_bytes() == big
    assert got["1"].metadata == {"p-source-md5": md5, "p-element-handle": "1"}
    assert (got["2"].status, got["2"].bytes_copied) == (C.COPIED, 0)
    assert got["3"].status == C.ERROR and got["3"].metadata is None and "none" in got["3"].error
    assert got["4"].status == C.ERROR and "leaves its root" in got["4"].error
    left = [p.name for p in dest.rglob("*") if p.is_file()]
    assert sorted(left) == ["big", "empty"]


def test_digests_and_probes(spark, tmp_path):
    bodies = spark.createDataFrame([("1", "a/b.txt", "hello world"), ("2", "c.txt", "")], "handle string, key string, body string")
    written = objects.write_objects(bodies, str(tmp_path)).collect()
    assert sorted((r.handle, r.size) for r in written) == [("1", 11), ("2", 0)]
    digests = {r.handle: r.md5 for r in objects.stream_digests(bodies, f"file://{tmp_path}").collect()}
    assert digests == {"1": "5eb63bbbe01eeed093cb22bb8f5acdc3", "2": "d41d8cd98f00b204e9800998ecf8427e"}
    files = {r.path.rsplit("/", 1)[1]: (r.md5, r["size"]) for r in objects.read_bodies(spark, str(tmp_path)).collect()}
    assert files == {"b.txt": (digests["1"], 11)}  # file sources do not list empty files
    wanted = spark.createDataFrame([("1", "a/b.txt"), ("2", "gone"), ("3", "a")], "handle string, key string")
    probes = {r.handle: r.status for r in objects.probe_objects(wanted, f"file:{tmp_path}").collect()}
    assert probes == {"1": C.FOUND, "2": C.NOT_FOUND, "3": C.NOT_FOUND}


def test_file_digests_give_every_object(spark, tmp_path):
    """Empty ones, names that Spark does not list, objects above the bound, missing ones and repeated keys."""
    bodies = [("1", "a/b.txt", "hello world"), ("2", "c d.txt", ""), ("3", "_e/x", "hidden"), ("4", "big", "x" * 100),
              ("5", "ü/source/%20", "name")]
    table = spark.createDataFrame(bodies, "handle string, key string, body string")
    root = f"{tmp_path}/source"
    manifest = objects.write_objects(table, root).select("handle", "key").localCheckpoint()
    more = spark.createDataFrame([("6", "gone"), ("7", "big"), ("8", "a/b.txt")], "handle string, key string")
    got = {r.handle: r for r in objects.file_digests(manifest.unionByName(more), root, whole_bytes=50).collect()}
    body = {h: b.encode() for h, _, b in bodies} | {"7": b"x" * 100, "8": b"hello world"}
    assert {h: (r.md5, r["size"]) for h, r in got.items() if h != "6"} == {
        h: (hashlib.md5(b).hexdigest(), len(b)) for h, b in body.items()
    }
    assert got["6"].md5 is None and "gone" in got["6"].error and got["1"].error is None


def files_listed(spark, run):
    """Rows of a run, and how many files the driver listed for it."""
    counter = spark._jvm.org.apache.spark.metrics.source.HiveCatalogMetrics.METRIC_FILES_DISCOVERED()
    before = counter.getCount()
    return run().collect(), counter.getCount() - before


def numbered_objects(spark, n):
    """n objects, the last named twice."""
    rows = [(str(i), f"d{i % 3}/o{i}", "x" * i) for i in range(n)]
    return spark.createDataFrame([*rows, (f"{n}", *rows[-1][1:])], "handle string, key string, body string")


def test_query_of_files_lists_no_objects(spark, tmp_path, monkeypatch):
    """A listing of the objects would be held by the driver, whole."""
    from frostline.workload import fixtures, registered, stage_queries  # noqa: F401

    n = 200
    monkeypatch.setattr(fixtures, "table", lambda *_: numbered_objects(spark, n))
    rows, listed = files_listed(spark, lambda: registered.QUERIES["object_checksums_files"](spark, str(tmp_path)))
    want = [(f"d{i % 3}/o{i}", hashlib.md5(b"x" * i).hexdigest(), i) for i in [*range(n), n - 1]]
    assert sorted(tuple(r) for r in rows) == sorted(want)
    assert listed < n // 2


def test_streamed_query_lists_no_objects(spark, tmp_path, monkeypatch):
    from frostline.workload import fixtures, registered, stage_queries  # noqa: F401

    n = 200
    monkeypatch.setattr(fixtures, "table", lambda *_: numbered_objects(spark, n))
    rows, listed = files_listed(spark, lambda: registered.QUERIES["object_checksums_streamed"](spark, str(tmp_path)))
    want = [(str(i), hashlib.md5(b"x" * min(i, n - 1)).hexdigest(), min(i, n - 1), None) for i in range(n + 1)]
    assert sorted(tuple(r) for r in rows) == sorted(want)
    assert listed < n // 2


def test_digests_where_only_spark_reads(spark, tmp_path):
    """A store that cannot be streamed is read by Spark."""
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.odd.link./in", f"file://{tmp_path}")
    table = numbered_objects(spark, 5).where("body <> ''")
    manifest = objects.write_objects(table, f"{tmp_path}/o").select("handle", "key").localCheckpoint()
    manifest = manifest.withColumn("key", F.when(F.col("handle") == "1", F.concat(F.lit("/"), "key")).otherwise(F.col("key")))
    got = {(r.handle, r.md5, r["size"], r.error) for r in objects.file_digests(manifest, "viewfs://odd/in/o").collect()}
    assert got == {(str(i), hashlib.md5(b"x" * min(i, 4)).hexdigest(), min(i, 4), None) for i in range(1, 6)}


def test_query_of_files_gives_empty_objects(spark, tmp_path, monkeypatch):
    from frostline.workload import fixtures, registered, stage_queries  # noqa: F401

    table = spark.createDataFrame([("1", "a", "hello world"), ("2", "b", "")], "handle string, key string, body string")
    monkeypatch.setattr(fixtures, "table", lambda *_: table)
    got = {tuple(r) for r in registered.QUERIES["object_checksums_files"](spark, str(tmp_path)).collect()}
    assert got == {("a", "5eb63bbbe01eeed093cb22bb8f5acdc3", 11), ("b", "d41d8cd98f00b204e9800998ecf8427e", 0)}


def test_metadata_round_trip(spark):
    fields = [F.lit(str(i)) for i in range(7)]
    packed = spark.range(1).select(objects.object_metadata("p", *fields).alias("m"))
    assert set(packed.first().m) == {f"p-{k}" for k in objects.METADATA_KEYS}
    assert tuple(packed.select(*objects.metadata_fields(F.col("m"), "p")).first()) == tuple("0123456")


def test_tasks_do_not_import_the_package(tmp_path):
    """Executors may lack the package: a process that cannot import it can run what they are sent."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    target = tmp_path / "sent"
    (tmp_path / "a").write_bytes(b"hello world")
    target.write_bytes(cloudpickle.dumps((objects._store, objects._below, objects._digest, objects._put)))
    code = (
        "import pickle, sys\n"
        f"store, below, digest, put = pickle.load(open({str(target)!r}, 'rb'))\n"
        f"fs, base = store({str(tmp_path)!r})\n"
        "put(fs, below(base, 'b'), [b'hello ', b'world'])\n"
        "assert not any(m.startswith('frostline') for m in sys.modules)\n"
        "print(digest(fs, below(base, 'b'))[0])\n"
    )
    ran = subprocess.run([sys.executable, "-c", code], cwd="/", capture_output=True, text=True, timeout=100)
    assert ran.stdout.strip() == "5eb63bbbe01eeed093cb22bb8f5acdc3", ran.stderr


def test_tasks_get_equal_bytes(spark):
    """Sizes over six orders of magnitude: no task over 1.5 times the mean load, unless it is one object."""
    sizes = [10 ** (3 + i % 7) + i for i in range(700)] + [10**11]
    rows = spark.createDataFrame(list(enumerate(sizes)), "handle long, size long").repartition(5)
    for n, least in ((8, 1), (40, 1), (3, 65536)):
        dealt = objects.balanced(rows, n, least).withColumn("task", F.spark_partition_id()).collect()
        assert sorted(r.handle for r in dealt) == list(range(701))
        load, count = {}, {}
        for r in dealt:
            load[r.task] = load.get(r.task, 0) + max(r["size"], least)
            count[r.task] = count.get(r.task, 0) + 1
        mean = sum(load.values()) / n
        assert all(weight <= 1.5 * mean + 1 or count[task] == 1 for task, weight in load.items())
    assert objects.balanced(rows.limit(0), 4).count() == 0
    unknown = rows.withColumn("size", F.lit(None).cast("long"))
    tasks = [r["count"] for r in objects.balanced(unknown, 7).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 701 and max(tasks) <= 1.5 * 701 / 7 + 1


def test_copies_are_made_once(spark, tmp_path):
    source, dest = tmp_path / "s", tmp_path / "d"
    source.mkdir(), dest.mkdir()
    (source / "a").write_bytes(b"body")
    copies = objects.copy_objects(jobs(spark, ("1", "a", "a")), str(source), str(dest), True, "p")
    (source / "a").write_bytes(b"changed")
    assert [r.source_md5 for r in copies.collect()] == [hashlib.md5(b"body").hexdigest()]
    assert (dest / "a").read_bytes() == b"body" and copies.count() == 1


def test_listing_finds_what_single_looks_find(spark, tmp_path):
    bodies = [("1", "a/b.txt", "x"), ("2", "c d.txt", ""), ("3", "_e/x", "hidden")]
    table = spark.createDataFrame(bodies, "handle string, key string, body string")
    objects.write_objects(table, f"{tmp_path}/source").collect()
    wanted = table.select("handle", "key").unionByName(spark.createDataFrame([("4", "gone"), ("5", "a/b.txt"), ("6", None)], "handle string, key string"))
    got = {r.handle: r.status for r in objects.probe_listed(wanted.where("key IS NOT NULL"), f"{tmp_path}/source").collect()}
    assert got == {"1": C.FOUND, "2": C.FOUND, "3": C.FOUND, "4": C.NOT_FOUND, "5": C.FOUND}
