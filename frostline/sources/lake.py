"""The four owned tables as partitioned Parquet tables.

Parquet tables have no UPDATE. Registry and configuration are therefore kept as versions,
of which the latest counts; events and change log only ever grow. Every write belongs to a
batch (run id and stage) and replaces that batch, so that a stage may be run again after a
failure and leaves the same rows.

A batch may span several tables. Each attempt at it writes partitions of its own, and a commit
record, one partition that the catalog adds in one step, publishes them all at once. Readers
take the latest committed attempt of each batch: a stage that died between two tables is
invisible, and while a batch is written again its earlier rows stay as they were.
"""

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from urllib.parse import unquote
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frostline import schemas
from frostline.functions import times
from frostline.operators import latest

BATCH_RUN, BATCH_STAGE, BATCH_ATTEMPT, EVENT_DATE = "batch_run", "batch_stage", "batch_attempt", "event_date"

REGISTRY = "asset_registry"
EVENTS = "lifecycle_events"
CONFIG = "offload_config"
CHANGE_LOG = "config_change_log"
CANDIDATES = "discovery_batches"
COPIES = "copy_results"
PROBES = "probe_results"
PATH_GRAMS = "path_grams"
COMMITS = "batch_commits"
COMPACTION = "compaction"

_BATCH = [T.StructField(name, T.StringType()) for name in (BATCH_RUN, BATCH_STAGE, BATCH_ATTEMPT)]
_BATCH_NAMES = [f.name for f in _BATCH]
# The tables that a commit publishes, as part of its name.
COMMITTED = "committed"
_DELETED = [T.StructField("is_deleted", T.BooleanType())]

# Stored columns and partition columns per table.
LAYOUT = {
    REGISTRY: (schemas.ASSET_REGISTRY.fields + _DELETED, _BATCH),
    EVENTS: (schemas.LIFECYCLE_EVENTS.fields, [T.StructField(EVENT_DATE, T.DateType()), *_BATCH]),
    CONFIG: (schemas.OFFLOAD_CONFIG.fields, _BATCH),
    CHANGE_LOG: (schemas.CONFIG_CHANGE_LOG.fields, _BATCH),
    CANDIDATES: (
        [f for f in schemas.CATALOG.fields if f.name not in ("element_type", "tag_offload_status")]
        + [T.StructField("known_registration_id", T.StringType()), T.StructField("registration_id", T.StringType())],
        _BATCH,
    ),
    COPIES: (schemas.COPY_RESULTS.fields, _BATCH),
    PROBES: (schemas.PROBE_RESULTS.fields, _BATCH),
    # Which runs of three characters the paths of which elements hold.
    PATH_GRAMS: (
        [T.StructField(name, T.StringType()) for name in ("gram", "element_handle", "registration_id")], _BATCH,
    ),
    # Commits have no rows: what counts is that the catalog knows the partition.
    COMMITS: ([T.StructField("note", T.StringType())], [*_BATCH, T.StructField(COMMITTED, T.StringType())]),
}


# Columns that single rows are looked up by: the usual order of the files, and a path with a Bloom filter for each row group.
ORDER = {EVENTS: "element_handle", REGISTRY: "element_handle", PATH_GRAMS: "gram"}
PATHS = {EVENTS: "source_path", REGISTRY: "original_path"}

# How the catalog lists the partition of rows without a date.
NO_DATE = "__HIVE_DEFAULT_PARTITION__"


GRAM = 3
POSTINGS = 1 << 19  # of one task, about


def path_grams(rows: DataFrame) -> DataFrame:
    """gram, element_handle, registration_id: each run of three characters that an element's path holds, once, in ranges.

    A task gets a bounded number of them, however many rows the one that reads the paths has: paths are dealt out
    before they are taken apart, and equal postings meet in their range, not in a table of all that a reader finds.
    """
    paths = rows.where(F.length("original_path") >= GRAM).select("element_handle", "registration_id", "original_path")
    total = paths.agg(F.sum(F.length("original_path") - (GRAM - 1))).first()[0] or 0
    parts = total // POSTINGS + 1
    starts = F.sequence(F.lit(1), F.length("original_path") - (GRAM - 1))
    grams = F.array_distinct(F.transform(starts, lambda at: F.substring(F.col("original_path"), at, F.lit(GRAM))))
    postings = paths.repartition(parts, *paths.columns).distinct().select(
        F.explode(grams).alias("gram"), "element_handle", "registration_id"
    )
    return postings.repartitionByRange(parts, *postings.columns).distinct()


def _quoted(value: str) -> str:
    """A text as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Lake:
    """Access to the tables of one database."""

    spark: SparkSession
    database: str
    # Batches being written through this object: their attempt, and the tables that each attempt has rows in.
    _open: dict[tuple[str, str], str] = field(default_factory=dict, compare=False, repr=False)
    _written: dict[str, list[str]] = field(default_factory=dict, compare=False, repr=False)
    # The column by which the rows of a batch are ordered in its files: look-ups by it read the few row groups whose
    # range holds the value. Paths are found by Bloom filters in any case.
    order: dict[str, str] = field(default_factory=lambda: dict(ORDER), compare=False)
    # Buckets of the registry by element, chosen when the tables are created (0: none). Its latest rows and its updates
    # then need no exchange of the registry, and a write shuffles the batch once.
    buckets: int = 0
    # Whether a batch of the registry brings the postings of its paths along, for `reports.registry.locate_indexed`.
    path_index: bool = False

    def ensure_tables(self, location: str | None = None) -> None:
        """Create database (at a location, if given) and tables where they do not exist yet."""
        place = f" LOCATION '{location}'" if location else ""
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database}{place}")
        for name, (columns, partitions) in LAYOUT.items():
            spec = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in [*columns, *partitions])
            by = ", ".join(f.name for f in partitions)
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {self.database}.{name} ({spec}) USING parquet"
                f" OPTIONS ({self._options(name)}) PARTITIONED BY ({by})"
                + (f" CLUSTERED BY (element_handle) SORTED BY (element_handle) INTO {self.buckets} BUCKETS"
                   if self.buckets and name == REGISTRY else "")
            )

    @staticmethod
    def _options(name: str) -> str:
        options = {"partitionOverwriteMode": "dynamic"}
        if name in PATHS:
            options[f"parquet.bloom.filter.enabled#{PATHS[name]}"] = "true"
        return ", ".join(f"{_quoted(key)} {_quoted(value)}" for key, value in options.items())

    def list_tables(self) -> DataFrame:
        """Names of the owned tables that exist."""
        tables = self.spark.sql(f"SHOW TABLES IN {self.database}")
        return tables.where(F.col("tableName").isin(*LAYOUT)).select(F.col("tableName").alias("table_name"))

    def table(self, name: str) -> DataFrame:
        """The committed rows of a table, with the run and stage of their batch.

        What is to be left out is known from the catalog alone, and it is little: attempts that broke off or are under
        way. The rest of the plan is that of the plain table.
        """
        rows, open_now = self.spark.table(f"{self.database}.{name}"), self._open.values()
        live = self._live(name)
        dead = {p[BATCH_ATTEMPT] for p in self._partitions(name)
                if live.get((p[BATCH_RUN], p[BATCH_STAGE])) != p[BATCH_ATTEMPT] and p[BATCH_ATTEMPT] not in open_now}
        replaced = {live[batch] for batch, attempt in self._open.items() if self._wrote(name, batch, attempt) and batch in live}
        hidden = sorted(dead | replaced)
        return (rows.where(~F.col(BATCH_ATTEMPT).isin(*hidden)) if hidden else rows).drop(BATCH_ATTEMPT)

    def write_batch(self, name: str, rows: DataFrame, run: str, stage: str) -> None:
        """Write the rows of a batch, in place of any it wrote before.

        Inside `one_batch` the rows are published with those of the other tables (each written once), else at once. They
        may be computed from the same table, and from what the batch wrote before.
        """
        if (run, stage) not in self._open:
            with self.one_batch(run, stage):
                return self.write_batch(name, rows, run, stage)
        columns, partitions = LAYOUT[name]
        attempt = self._open[run, stage]
        values = {BATCH_RUN: F.lit(run), BATCH_STAGE: F.lit(stage), BATCH_ATTEMPT: F.lit(attempt)}
        if name == EVENTS:
            values[EVENT_DATE] = F.col("event_timestamp").cast("date")
        if name == REGISTRY and "is_deleted" not in rows.columns:
            rows = rows.withColumn("is_deleted", F.lit(False))
        batch = rows.select(
            *[F.col(f.name).cast(f.dataType).alias(f.name) for f in columns],
            *[values[f.name].alias(f.name) for f in partitions],
        )
        if self.buckets and name == REGISTRY:
            batch = batch.repartition(self.buckets, "element_handle")
        if name in self.order:  # statistics of the files then tell where a value's rows may be
            batch = batch.sortWithinPartitions(*[f.name for f in partitions], self.order[name])
        batch.write.insertInto(f"{self.database}.{name}", overwrite=True)
        self._written.setdefault(attempt, []).append(name)
        if name == REGISTRY and self.path_index:
            self.write_batch(PATH_GRAMS, path_grams(self.batch(REGISTRY, run, stage)), run, stage)

    @contextmanager
    def one_batch(self, run: str, stage: str) -> Iterator[None]:
        """Publish all that is written for a batch inside the block together, at its end; nothing if it fails.

        Inside, this object sees the rows written so far. After the commit, what earlier attempts at the same tables left
        is dropped; a failure in between leaves partitions that nobody reads and that the next attempt drops.
        """
        batch = (run, stage)
        if batch in self._open:
            raise ValueError(f"already being written: {batch}")
        attempt = self._open[batch] = self._next_attempt(run, stage)
        try:
            yield
            names = sorted(set(self._written.get(attempt, [])))
            if names:
                spec = {BATCH_RUN: run, BATCH_STAGE: stage, BATCH_ATTEMPT: attempt, COMMITTED: "+".join(names)}
                self.spark.sql(f"ALTER TABLE {self.database}.{COMMITS} ADD PARTITION ({self._spec(spec)})")
        finally:
            del self._open[batch]
            self._written.pop(attempt, None)
        for name in names:
            self._drop(name, [p for p in self._partitions(name, run, stage) if p[BATCH_ATTEMPT] != attempt])
        earlier = [p for p in self._partitions(COMMITS, run, stage) if p[BATCH_ATTEMPT] != attempt]
        self._drop(COMMITS, [p for p in earlier if set(p[COMMITTED].split("+")) <= set(names)])

    def drop_leftovers(self) -> None:
        """Drop the partitions of attempts that broke off and were never made again; not while others write."""
        for name in LAYOUT:
            if name != COMMITS:
                live = self._live(name)
                self._drop(name, [p for p in self._partitions(name)
                                  if live.get((p[BATCH_RUN], p[BATCH_STAGE])) != p[BATCH_ATTEMPT]])

    def _next_attempt(self, run: str, stage: str) -> str:
        """A name for a new attempt that sorts after those committed for the batch."""
        numbers = [int(p[BATCH_ATTEMPT].split("-")[0]) for p in self._partitions(COMMITS, run, stage)]
        return f"{max(numbers, default=0) + 1:06d}-{uuid4().hex[:12]}"

    def _live(self, name: str) -> dict[tuple[str, str], str]:
        """The latest committed attempt of each batch with rows of a table."""
        live: dict[tuple[str, str], str] = {}
        for commit in self._partitions(COMMITS):
            if name in commit[COMMITTED].split("+"):
                batch = commit[BATCH_RUN], commit[BATCH_STAGE]
                live[batch] = max(live.get(batch, ""), commit[BATCH_ATTEMPT])
        return live

    def _wrote(self, name: str, batch: tuple[str, str], attempt: str) -> bool:
        return self._open.get(batch) == attempt and name in self._written.get(attempt, [])

    @staticmethod
    def _spec(values: dict[str, str]) -> str:
        return ", ".join(f"{c}={'NULL' if v == NO_DATE else _quoted(v)}" for c, v in values.items())

    def _partitions(self, name: str, run: str | None = None, stage: str | None = None) -> list[dict[str, str]]:
        """Partitions of a table, or of one batch (one, or one per date), as the catalog lists them."""
        spec = f" PARTITION ({self._spec({BATCH_RUN: run, BATCH_STAGE: stage})})" if run is not None else ""
        listed = self.spark.sql(f"SHOW PARTITIONS {self.database}.{name}{spec}")
        # Names are listed as in paths, with the odd characters escaped.
        return [
            {column: unquote(value) for column, value in (part.split("=", 1) for part in row[0].split("/"))}
            for row in listed.collect()
        ]

    def _drop(self, name: str, partitions: list[dict[str, str]]) -> None:
        for partition in partitions:
            self.spark.sql(f"ALTER TABLE {self.database}.{name} DROP IF EXISTS PARTITION ({self._spec(partition)})")

    def batch(self, name: str, run: str, stage: str) -> DataFrame:
        """The rows that a batch wrote; inside `one_batch`, also those not published yet."""
        columns, _ = LAYOUT[name]
        ours = (F.col(BATCH_RUN) == run) & (F.col(BATCH_STAGE) == stage)
        return self.table(name).where(ours).select(*[f.name for f in columns])

    def registry_versions(self, skip_run: str = "", skip_stages: tuple[str, ...] = ()) -> DataFrame:
        """All registry versions, without those of some stages of a run.

        A stage that is run again must see the registry as it was before its first attempt.
        """
        versions = self.table(REGISTRY)
        if skip_stages:
            redone = (F.col(BATCH_RUN) == skip_run) & F.col(BATCH_STAGE).isin(*skip_stages)
            versions = versions.where(~redone)
        return versions.drop(*_BATCH_NAMES)

    def registry(self, skip_run: str = "", skip_stages: tuple[str, ...] = ()) -> DataFrame:
        return latest.current_registry(self.registry_versions(skip_run, skip_stages))

    def config(self) -> DataFrame:
        return latest.current_config(self.table(CONFIG).drop(*_BATCH_NAMES))

    def change_log(self) -> DataFrame:
        return self.table(CHANGE_LOG).drop(*_BATCH_NAMES)

    def events(self, since=None, run: str | None = None) -> DataFrame:
        """Lifecycle events; a lower time bound prunes the partitions by date, a run id those of other runs' batches."""
        rows = self.table(EVENTS)
        if run is not None:
            rows = rows.where(F.col(BATCH_RUN) == run)
        if since is not None:
            rows = rows.where((F.col(EVENT_DATE) >= F.lit(since.date())) & (F.col("event_timestamp") > times.ntz(since)))
        return rows.drop(EVENT_DATE, *_BATCH_NAMES)

    def compact_registry(self, run: str) -> None:
        """Replace the registry versions written so far by the current row of each element."""
        self._compact(REGISTRY, run, latest.current_registry)

    def compact_config(self, run: str) -> None:
        """Replace the configuration's versions by the current one of each key. The change log keeps the history."""
        self._compact(CONFIG, run, latest.current_config)

    def _compact(self, name: str, run: str, current) -> None:
        """Fold the batches of a table into one.

        Batches that appear meanwhile stay as they are. The old batches are dropped only after the compacted rows are
        published, so that a failure in between loses nothing: the latest version counts, whether once or twice there.
        """
        batches = sorted(self._live(name))
        if not batches or (run, COMPACTION) in batches:
            return
        known = F.concat_ws("/", BATCH_RUN, BATCH_STAGE).isin(*["/".join(b) for b in batches])
        live = current(self.table(name).where(known).drop(*_BATCH_NAMES))
        self.write_batch(name, live, run, COMPACTION)
        folded = {name, PATH_GRAMS} if name == REGISTRY else {name}
        for batch in batches:
            for table in folded:
                self._drop(table, self._partitions(table, *batch))
            self._drop(COMMITS, [p for p in self._partitions(COMMITS, *batch) if set(p[COMMITTED].split("+")) <= folded])
