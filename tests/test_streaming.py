"""The alert feed picks up every failure once."""

from datetime import datetime

from frostline import schemas
from frostline.streaming import alerts


def test_each_failure_is_delivered_once(spark, tmp_path):
    types = dict.fromkeys(schemas.LIFECYCLE_EVENTS.names)
    folder, out, progress = (str(tmp_path / n) for n in ("events", "alerts", "progress"))

    def add(*rows):
        data = [tuple({**types, "event_id": i, "success": s, "event_timestamp": datetime(2024, 1, 1)}.values())
                for i, s in rows]
        spark.createDataFrame(data, schemas.LIFECYCLE_EVENTS).write.mode("append").parquet(folder)

    def run():
        feed = alerts.failure_alerts(alerts.event_stream(spark, folder))
        alerts.deliver(feed, out, progress)
        return sorted(r.event_id for r in alerts.delivered(spark, out, feed.schema).collect())

    add(("1", True), ("2", False), ("3", None))
    assert run() == ["2"]
    assert run() == ["2"]
    add(("4", False))
    assert run() == ["2", "4"]
    add(("2", False))  # its batch was run again
    assert run() == ["2", "4"]
