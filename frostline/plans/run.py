"""A whole run: discover, offload and purge on the tables of a lake.

The tables of a stage are published together, so that no reader meets a change of state without its event, nor an
event without its change. Running a run id again rewrites the same batches.
"""

from datetime import datetime

from pyspark.sql import DataFrame

from frostline.functions import times
from frostline.functions.settings import Settings, load_settings
from frostline.plans import discover, offload, purge
from frostline.sources import lake as tables
from frostline.sources import objects
from frostline.sources.lake import Lake

STAGES = ("discover", "offload", "purge")


def run_discover(lake: Lake, catalog: DataFrame, settings: Settings, as_of: datetime, run_id: str) -> None:
    with lake.one_batch(run_id, "discover"):
        _discover(lake, catalog, settings, as_of, run_id)


def _discover(lake: Lake, catalog: DataFrame, settings: Settings, as_of: datetime, run_id: str) -> None:
    registry = lake.registry(run_id, STAGES)
    if settings.flag("dry_run"):
        scanned = discover.dry_run_events(catalog, registry, settings, as_of, run_id)
        lake.write_batch(tables.EVENTS, scanned, run_id, "discover")
        return
    chosen = discover.candidates(catalog, registry, settings, as_of, run_id, settings.batch_size)
    # The catalog is scanned once; everything else starts from the written batch.
    lake.write_batch(tables.CANDIDATES, chosen, run_id, "discover")
    chosen = lake.batch(tables.CANDIDATES, run_id, "discover")
    lake.write_batch(tables.EVENTS, discover.discover_events(chosen, settings, as_of, run_id), run_id, "discover")
    lake.write_batch(tables.REGISTRY, discover.registrations(chosen, as_of), run_id, "discover")


def run_offload(
    lake: Lake, settings: Settings, as_of: datetime, run_id: str, source_root: str, dest_root: str
) -> None:
    with lake.one_batch(run_id, "offload"):
        _offload(lake, settings, as_of, run_id, source_root, dest_root)


def _offload(lake: Lake, settings: Settings, as_of: datetime, run_id: str, source_root: str, dest_root: str) -> None:
    manifest = discover.manifest(lake.batch(tables.CANDIDATES, run_id, "discover"))
    jobs = objects.copy_jobs(manifest, settings, as_of)
    tasks = min(settings.batch_size, int(lake.spark.conf.get("spark.sql.shuffle.partitions")))
    copies = objects.copy_objects(
        jobs, source_root, dest_root, settings.flag("verify_checksum"), partitions=max(tasks, 1)
    )
    lake.write_batch(tables.COPIES, copies, run_id, "offload")
    # Before the commit: should the run die now, the store itself still tells what lies in it.
    objects.publish_lineage(offload.lineage(lake.batch(tables.COPIES, run_id, "offload"), settings), dest_root, run_id)
    outcomes = offload.with_outcome(manifest, lake.batch(tables.COPIES, run_id, "offload"))
    lake.write_batch(tables.EVENTS, offload.offload_events(outcomes, settings, as_of, run_id), run_id, "offload")
    current = lake.registry(run_id, STAGES[1:])
    lake.write_batch(tables.REGISTRY, offload.registry_updates(current, outcomes, settings, as_of), run_id, "offload")


def run_purge(lake: Lake, settings: Settings, as_of: datetime, run_id: str, dest_root: str) -> None:
    if not settings.flag("auto_delete_local"):
        return
    with lake.one_batch(run_id, "purge"):
        _purge(lake, settings, as_of, run_id, dest_root)


def _purge(lake: Lake, settings: Settings, as_of: datetime, run_id: str, dest_root: str) -> None:
    current = lake.registry(run_id, STAGES[2:])
    probes = objects.probe_objects(objects.probe_jobs(purge.pending(current)), dest_root)
    lake.write_batch(tables.PROBES, probes, run_id, "purge")
    plan = purge.purge_plan(current, lake.batch(tables.PROBES, run_id, "purge"))
    lake.write_batch(tables.EVENTS, purge.purge_events(plan, settings, as_of, run_id), run_id, "purge")
    lake.write_batch(tables.REGISTRY, purge.registry_updates(plan, settings, as_of), run_id, "purge")


def run_all(
    lake: Lake,
    catalog: DataFrame,
    as_of: datetime,
    source_root: str,
    dest_root: str,
    bootstrap: dict[str, str] | None = None,
    run_id: str | None = None,
) -> str:
    """The three stages under one run id, which is returned."""
    run_id = run_id or times.run_id(as_of)
    settings = load_settings(lake.config(), bootstrap)
    run_discover(lake, catalog, settings, as_of, run_id)
    if not settings.flag("dry_run"):
        run_offload(lake, settings, as_of, run_id, source_root, dest_root)
    run_purge(lake, settings, as_of, run_id, dest_root)
    return run_id


def left_over(lake: Lake, catalog: DataFrame, as_of: datetime) -> int:
    """Cold files that still have no copy: what a run's batch size left for the next one, and what could not be copied."""
    settings = load_settings(lake.config())
    return discover.not_offloaded(discover.cold_files(catalog, settings, as_of), lake.registry()).count()
