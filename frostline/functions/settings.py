"""Typed access to configuration values and the snapshot that events carry."""

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline import constants as C


@dataclass(frozen=True)
class Settings:
    """Current configuration as text values, with typed access."""

    values: Mapping[str, str]
    bootstrap: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self):
        missing = sorted(set(C.REQUIRED_CONFIG_KEYS) - set(self.values))
        if missing:
            raise ValueError(f"missing configuration keys: {', '.join(missing)}")

    def flag(self, key: str) -> bool:
        return self.values[key].lower() == "true"

    @property
    def threshold_days(self) -> int:
        return int(self.values["atime_threshold_days"])

    @property
    def batch_size(self) -> int:
        return int(self.values["batch_size"])

    @property
    def source_paths(self) -> list[str]:
        return [part.strip() for part in self.values["source_paths"].split(",") if part.strip()]

    @property
    def bucket(self) -> str:
        return self.values["target_aws_bucket"]

    @property
    def region(self) -> str:
        return self.values["target_aws_region"]

    @property
    def storage_class(self) -> str:
        return self.values.get("target_aws_storage_class", C.DEFAULT_STORAGE_CLASS)

    def snapshot(self) -> str:
        """All settings, with the bootstrap values (endpoint, cluster name), as sorted JSON."""
        return json.dumps({**self.values, **self.bootstrap}, sort_keys=True)


def load_settings(current_config: DataFrame, bootstrap: Mapping[str, str] | None = None) -> Settings:
    """Settings from a configuration with one row per key, kept by hand."""
    rows = current_config.select("config_key", "config_value").collect()
    return Settings({r.config_key: r.config_value for r in rows}, dict(bootstrap or {}))


def int_value(key: Column, value: Column) -> Column:
    return F.when(key.isin(*C.INT_CONFIG_KEYS), F.btrim(value).try_cast("int"))


def bool_value(key: Column, value: Column) -> Column:
    return F.when(key.isin(*C.BOOL_CONFIG_KEYS), F.lower(value) == "true")


def list_value(key: Column, value: Column) -> Column:
    """Comma-separated parts, trimmed; empty parts are no paths."""
    parts = F.transform(F.split(value, ","), lambda part: F.btrim(part))
    return F.when(key.isin(*C.LIST_CONFIG_KEYS), F.filter(parts, lambda part: part != ""))


def json_field(snapshot: Column, key: str) -> Column:
    return F.get_json_object(snapshot, f"$.{key}")


def _escaped(char: Column) -> Column:
    """One character as it stands in a JSON string of ASCII characters only."""
    code, beyond = F.ascii(char), F.ascii(char) - 0x10000
    unit = lambda number: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(number)), 4, "0"))
    text = F.when(code > 0xFFFF, F.concat(
        unit(F.shiftright(beyond, 10) + 0xD800), unit(beyond.bitwiseAND(0x3FF) + 0xDC00)
    )).when((code < 0x20) | (code > 0x7E), unit(code)).otherwise(char)
    for plain, name in (("\\", "\\"), ('"', '"'), ("\n", "n"), ("\r", "r"), ("\t", "t"), ("\b", "b"), ("\f", "f")):
        text = F.when(char == plain, F.lit("\\" + name)).otherwise(text)
    return text


def json_text(value: Column) -> Column:
    """A text as a JSON string, all but plain ASCII escaped; null for NULL."""
    escaped = F.array_join(F.transform(F.split(value, ""), _escaped), "")
    content = F.when(value.rlike(r"\A[ !#-\[\]-~]*\z"), value).otherwise(escaped)
    return F.coalesce(F.concat(F.lit('"'), content, F.lit('"')), F.lit("null"))


def snapshot_text(key: Column, value: Column) -> Column:
    """Aggregate: the settings of a group, one row per key, as sorted JSON. The text is that of Settings.snapshot."""
    entries = F.array_sort(F.collect_list(F.struct(key.alias("key"), value.alias("value"))))
    pairs = F.transform(entries, lambda e: F.concat(json_text(e["key"]), F.lit(": "), json_text(e["value"])))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
