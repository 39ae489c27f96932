"""Schemas of the tables, and the compatibility rules of block ports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trialframe.errors import PortMismatch

RUNS = "run_id string, logical_key string, kind string, parent_id string, created_at timestamp"
EVENTS = "run_id string, version long, event_type string, state string, attempt long, owner string, expires_at timestamp, payload string, created_at timestamp"
METRICS = "run_id string, name string, seq long, scalar double, vector array<double>, artifact string, partition_id string, created_at timestamp"
ARTIFACTS = "content_hash string, run_id string, cache_key string, media_type string, serializer string, lineage map<string,string>, metadata map<string,string>, size long, created_at timestamp"
CHECKPOINTS = "block_run_id string, sequence long, fingerprint string, payload string, created_at timestamp"
DECISIONS = "run_id string, policy string, trial_id string, rank long, explanation string, created_at timestamp"


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def strict(df: DataFrame, expected: T.StructType) -> DataFrame:
    """``df`` with the expected columns in order; raises for missing, extra or differently typed ones."""
    have, want = {f.name: f.dataType for f in df.schema}, {f.name: f.dataType for f in expected}
    missing, extra = sorted(want.keys() - have.keys()), sorted(have.keys() - want.keys())
    wrong = sorted(n for n in want.keys() & have.keys() if not fits(have[n], want[n]))
    if missing or extra or wrong:
        raise PortMismatch(f"missing {missing}, unexpected {extra}, of another type {wrong}")
    return df.select(*want)


def fits(source: T.DataType, target: T.DataType) -> bool:
    """Equal types, or any source where the target is a variant; arrays and maps by their elements. Numbers never widen."""
    if isinstance(target, T.VariantType):
        return True
    if isinstance(source, T.ArrayType) and isinstance(target, T.ArrayType):
        return fits(source.elementType, target.elementType)
    if isinstance(source, T.MapType) and isinstance(target, T.MapType):
        return fits(source.keyType, target.keyType) and fits(source.valueType, target.valueType)
    if isinstance(source, T.StructType) and isinstance(target, T.StructType):
        return not problems(source, target)
    return type(source) is type(target) and (not isinstance(source, T.DecimalType) or source == target)


def problems(upstream: T.StructType, downstream: T.StructType) -> list[str]:
    """Why a port cannot feed another: required (non-nullable) fields that are missing, fields of other types."""
    have = {f.name: f.dataType for f in upstream}
    out = [f"{f.name} is missing" for f in downstream if not f.nullable and f.name not in have]
    return out + [f"{f.name}: {have[f.name].simpleString()} is not {f.dataType.simpleString()}" for f in downstream if f.name in have and not fits(have[f.name], f.dataType)]


def missing_fields(upstreams: Iterable[T.StructType], downstream: T.StructType) -> list[str]:
    """Required fields that no upstream of a fan-in offers."""
    offered = {f.name for s in upstreams for f in s}
    return [f.name for f in downstream if not f.nullable and f.name not in offered]


def repeated(names: Iterable[str]) -> list[str]:
    """Names that occur more than once."""
    seen: set[str] = set()
    return sorted({n for n in names if n in seen or seen.add(n)})
