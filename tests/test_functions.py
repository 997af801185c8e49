"""Column expressions against known values."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from frostline.functions import ids, notes, paths, settings, times

NOW = datetime(2024, 3, 10, 12, 0, 0)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "body, digest",
    [("hello world", "5eb63bbbe01eeed093cb22bb8f5acdc3"), ("", "d41d8cd98f00b204e9800998ecf8427e")],
)
def test_md5(spark, body, digest):
    assert value(spark, F.md5(F.lit(body))) == digest


@pytest.mark.parametrize("parent", ["/tenant/projects", "/tenant/projects/"])
def test_full_path(spark, parent):
    assert value(spark, paths.full_path(F.lit(parent), F.lit("report.pdf"))) == "/tenant/projects/report.pdf"


@pytest.mark.parametrize(
    "path, root, key",
    [
        ("/tenant/projects/2024/report.pdf", "/tenant/projects", "2024/report.pdf"),
        ("/other/path/file.txt", "/tenant/projects", "other/path/file.txt"),
        ("/a/src10/f", "/a/src1", "0/f"),
        ("/a", "/a", ""),
    ],
)
def test_s3_key(spark, path, root, key):
    assert value(spark, paths.s3_key(F.lit(path), F.lit(root))) == key


@pytest.mark.parametrize(
    "path, key",
    [
        ("/tenant/projects/report.pdf", "tenant/projects/report.pdf"),
        ("already/clean.txt", "already/clean.txt"),
        ("///many", "many"),
    ],
)
def test_aws_key(spark, path, key):
    assert value(spark, paths.aws_key(F.lit(path))) == key


@pytest.mark.parametrize(
    "parent, bucket",
    [("/tenant/src1/y2", "src1"), ("/tenant/src1/", "src1"), ("/tenant", "tenant"), ("", "")],
)
def test_bucket_segment(spark, parent, bucket):
    assert value(spark, paths.bucket_segment(F.lit(parent))) == bucket


@pytest.mark.parametrize(
    "parent, inside",
    [
        ("/tenant/projects", True),
        ("/tenant/projects/2026", True),
        ("/tenant/media/uploads", True),
        ("/tenant/projects2", False),
        ("/tenant/archived", False),
        ("/projects", False),
        ("/tenant/p_ojects/x", False),
    ],
)
def test_under_any(spark, parent, inside):
    roots = ["/tenant/projects", " /tenant/media/ "]
    assert value(spark, paths.under_any(F.lit(parent), roots)) is inside


@pytest.mark.parametrize("roots", [[], [""], [" "], ["/"]])
def test_no_roots_mean_no_restriction(spark, roots):
    assert value(spark, paths.under_any(F.lit("/any/where"), roots)) is True


def test_mapped_bucket_takes_the_longest_prefix(spark):
    mapping = {"/a": "short", "/a/b": "long", "/a/b/c/d": "too long"}
    assert value(spark, paths.mapped_bucket(F.lit("/a/b/c"), mapping)) == "long"
    assert value(spark, paths.mapped_bucket(F.lit("/x"), mapping)) is None
    many = {f"/a/{i}": f"b{i}" for i in range(1000)}
    assert value(spark, paths.mapped_bucket(F.lit("/a/9990/x"), many)) == "b999"
    assert value(spark, paths.mapped_bucket(F.lit("/x"), {})) is None


def test_ids_tell_nulls_and_separators_apart(spark):
    null = F.lit(None).cast("string")
    texts = [(F.lit("a"), null), (F.lit("a"),), (F.lit("a"), F.lit("")), (F.lit("a|b"),), (F.lit("a"), F.lit("b")), (F.lit("\\N"),), (null,)]
    assert len({value(spark, ids.stable_id(*parts)) for parts in texts}) == len(texts)
    files = [value(spark, ids.registration_id("r", null, F.lit(path))) for path in ("/a", "/b")]
    assert len(set(files)) == 2


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Europe/Berlin"])
@pytest.mark.parametrize(
    "back, days",
    [
        (timedelta(days=5), 5),
        (timedelta(days=90), 90),
        (timedelta(days=30, hours=23, minutes=59), 30),
        (timedelta(0), 0),
        (timedelta(microseconds=-1), -1),
        (timedelta(days=-1), -1),
        (timedelta(days=-1, microseconds=-1), -2),
    ],
)
def test_days_since_rounds_down_in_any_zone(spark, zone, back, days):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert back.days == days if back >= timedelta(0) else True
        assert value(spark, times.days_since(times.ntz(NOW - back), times.ntz(NOW))) == days
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize(
    "moment",
    [
        datetime(2024, 1, 31),
        datetime(2024, 1, 31, 1, 2, 3),
        datetime(2024, 1, 31, 1, 2, 3, 4),
        datetime(2024, 1, 31, 1, 2, 3, 120000),
        datetime(1969, 12, 31, 23, 59, 59, 999999),
    ],
)
def test_iso_format_and_run_id_are_those_of_python(spark, moment):
    assert value(spark, times.iso_format(times.ntz(moment))) == moment.isoformat()
    assert value(spark, times.run_id_at(times.ntz(moment))) == times.run_id(moment)


def test_aware_moments_are_taken_to_utc(spark):
    moment = datetime(2024, 1, 31, 10, tzinfo=timezone(timedelta(hours=2)))
    assert value(spark, times.ntz(moment)) == datetime(2024, 1, 31, 8)


@pytest.mark.parametrize("seconds", [-86_400.5, -0.000001, 0, 59.999999, 3_600, 10_000_000.25])
def test_elapsed_micros(spark, seconds):
    end = NOW + timedelta(seconds=seconds)
    got = value(spark, times.elapsed_micros(times.ntz(NOW), times.ntz(end)))
    assert got == (end - NOW) // timedelta(microseconds=1)


@pytest.mark.parametrize("moment", [datetime(1969, 12, 31, 23, 59, 59), datetime(1970, 1, 1), NOW])
@pytest.mark.parametrize("seconds", [1, 60, 86_400, 1000])
def test_time_slice(spark, moment, seconds):
    expected = int((moment - datetime(1970, 1, 1)).total_seconds() // seconds)
    assert value(spark, times.time_slice(times.ntz(moment), seconds)) == expected


def test_notes(spark):
    at = times.ntz(datetime(2024, 1, 1, 5))
    assert value(spark, notes.threshold_note(at, 60, F.lit(71))) == "atime=2024-01-01T05:00:00, threshold=60d, age=71d"
    assert value(spark, notes.dry_run_note(60, F.lit(71))) == "DRY_RUN: age=71d, threshold=60d"
    assert value(spark, notes.mismatch_note(F.lit("a"), F.lit("b"))) == "src=a dst=b"
    assert value(spark, notes.purge_abort_note(F.lit("b"), F.lit("k"))) == (
        "AWS copy not found at s3://b/k, aborting local delete for safety"
    )


@pytest.mark.parametrize("success, text", [(True, "OK"), (False, "FAIL"), (None, "--")])
def test_outcome(spark, success, text):
    assert value(spark, notes.outcome(F.lit(success).cast("boolean"))) == text


def test_ids_are_stable_and_distinct(spark):
    one = ids.event_id(F.lit("run"), F.lit("0x1"), F.lit("REGISTERED"))
    assert value(spark, one) == value(spark, one)
    other = ids.event_id(F.lit("run"), F.lit("0x1"), F.lit("COPY_STARTED"))
    assert value(spark, one) != value(spark, other)
    assert len(value(spark, one)) == 36


DEFAULTS = {
    "atime_threshold_days": " 60 ", "target_aws_bucket": "b", "target_aws_region": "r",
    "target_aws_storage_class": "GLACIER", "source_paths": "/a, /b ,,", "auto_delete_local": "TRUE",
    "dry_run": "yes", "batch_size": "500", "verify_checksum": "true",
}


def test_settings():
    config = settings.Settings(DEFAULTS, {"cluster_name": "c"})
    assert config.threshold_days == 60 and config.batch_size == 500
    assert config.source_paths == ["/a", "/b"]
    assert config.flag("auto_delete_local") and not config.flag("dry_run")
    assert config.snapshot().startswith('{"atime_threshold_days": " 60 ", "auto_delete_local": "TRUE", ')
    assert '"cluster_name": "c"' in config.snapshot()
    with pytest.raises(ValueError, match="batch_size"):
        settings.Settings({k: v for k, v in DEFAULTS.items() if k != "batch_size"})


def test_typed_values(spark):
    rows = spark.createDataFrame(list(DEFAULTS.items()), "k string, v string")
    key, value_ = F.col("k"), F.col("v")
    got = {
        r.k: (r.i, r.b, r.l)
        for r in rows.select(
            "k", settings.int_value(key, value_).alias("i"), settings.bool_value(key, value_).alias("b"),
            settings.list_value(key, value_).alias("l"),
        ).collect()
    }
    assert got["atime_threshold_days"] == (60, None, None)
    assert got["auto_delete_local"] == (None, True, None)
    assert got["dry_run"] == (None, False, None)
    assert got["source_paths"] == (None, None, ["/a", "/b"])
    assert got["target_aws_bucket"] == (None, None, None)


def test_snapshot_aggregate_gives_the_text_of_the_settings(spark):
    import json

    from frostline.functions.settings import snapshot_text

    odd = {"a b": 'say "hi"', "back": "c:\\dir\\", "é": "ü – 日本 😀", "ctl": "\t\n\r\b\f\x00\x1f\x7f", "": "", "z": "plain ~", "Z": "x/y"}
    rows = spark.createDataFrame([(g, k, v) for g in (1, 2) for k, v in odd.items()] + [(3, "k", None)], "g int, k string, v string")
    got = {r.g: r.s for r in rows.groupBy("g").agg(snapshot_text(F.col("k"), F.col("v")).alias("s")).collect()}
    assert got[1] == got[2] == json.dumps(odd, sort_keys=True)
    assert got[3] == '{"k": null}'
    assert r'"\u00e9": "\u00fc \u2013 \u65e5\u672c \ud83d\ude00"' in got[1] and r'"say \"hi\""' in got[1]


def test_daily_snapshots_hold_until_the_next_change(spark):
    from frostline import schemas
    from frostline.reports import config

    at = datetime(2024, 1, 1, 5)
    rows = [("a", "1", "u", at, ""), ("a", "2", "u", at + timedelta(hours=1), ""), ("b", 'x"', "u", at + timedelta(days=2), ""),
            ("a", "3", "u", at + timedelta(days=3), ""), ("c", "never", "u", None, "")]
    versions = spark.createDataFrame(rows, schemas.OFFLOAD_CONFIG)
    got = {str(r.day): r.snapshot for r in config.daily_snapshots(versions).collect()}
    assert got == {"2024-01-01": '{"a": "2"}', "2024-01-02": '{"a": "2"}', "2024-01-03": '{"a": "2", "b": "x\\""}',
                   "2024-01-04": '{"a": "3", "b": "x\\""}'}
    events = spark.createDataFrame(
        [("1", at, '{"k": "v"}'), ("2", at - timedelta(days=1), None), ("3", at + timedelta(days=9), None)],
        "event_id string, event_timestamp timestamp_ntz, config_snapshot string")
    found = {r.event_id: (r.settings, r.built) for r in config.event_snapshots(events, versions).collect()}
    assert found == {"1": ("k=v", got["2024-01-01"]), "2": (None, None), "3": (None, got["2024-01-04"])}
