"""Maps and nested records as flat maps of dotted keys."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def flat(column: Column, kind: DataType, prefix: str = "", sep: str = ".") -> Column:
    """A struct as a map from dotted paths to values as strings; arrays and maps become JSON, nulls stay."""
    entries = []
    for f in kind.fields:
        name, value = f"{prefix}{f.name}", column[f.name]
        if isinstance(f.dataType, StructType):
            entries.append(F.map_entries(flat(value, f.dataType, f"{name}{sep}", sep)))
        else:
            text = F.to_json(value) if isinstance(f.dataType, (ArrayType, MapType)) else value.cast("string")
            entries.append(F.array(F.struct(F.lit(name).alias("key"), text.alias("value"))))
    return F.map_from_entries(F.concat(*entries)) if entries else F.create_map().cast("map<string,string>")


def merged_right(left: Column, right: Column) -> Column:
    """Two maps in one; of equal keys the right one wins."""
    kept = F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k))
    return F.map_concat(kept, right)


def merged_left(left: Column, right: Column, exclude: list[str] | None = None) -> Column:
    """Two maps in one; of equal keys the left one wins, and ``exclude`` lists keys that the right one may not add."""
    barred = F.array(*map(F.lit, exclude)) if exclude else F.array().cast("array<string>")
    return F.map_concat(left, F.map_filter(right, lambda k, v: ~F.map_contains_key(left, k) & ~F.array_contains(barred, k)))


def conflicting_keys(left: Column, right: Column) -> Column:
    """Keys that both maps have with different values, sorted."""
    return F.array_sort(F.filter(F.map_keys(left), lambda k: F.map_contains_key(right, k) & ~F.try_element_at(left, k).eqNullSafe(F.try_element_at(right, k))))


def with_value(m: Column, path: str, value: Column) -> Column:
    return merged_right(m, F.create_map(F.lit(path), value))


def inverted(m: Column) -> Column:
    """Values as keys; values must be distinct."""
    return F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(e["value"], e["key"])))


def public_keys(m: Column) -> Column:
    """The map without keys that begin with an underscore."""
    return F.map_filter(m, lambda k, v: ~F.startswith(k, F.lit("_")))


def flat_dict(record: dict[str, Any], sep: str = ".", prefix: str = "") -> dict[str, Any]:
    """The same for a driver-side record such as a YAML file."""
    out: dict[str, Any] = {}
    for k, v in record.items():
        if isinstance(v, dict) and v:
            out |= flat_dict(v, sep, f"{prefix}{k}{sep}")
        else:
            out[f"{prefix}{k}"] = v
    return out


def nested_dict(record: dict[str, Any], sep: str = ".") -> dict[str, Any]:
    """A flat record as nested ones again."""
    out: dict[str, Any] = {}
    for path, v in record.items():
        *way, last = path.split(sep)
        at = out
        for step in way:
            at = at.setdefault(step, {})
        at[last] = v
    return out
