"""Content hashes: of text and bytes, of whole rows, and the cache keys made of them.

Rows are hashed natively: sha-256 of a JSON object with sorted keys and nulls. Values on the driver have a
canonical text of this library's own, in which every kind of value but null, truth, whole numbers, text and
lists is a tagged pair; kinds can be added with ``tagged.register``.
"""

from __future__ import annotations

import dataclasses
import datetime
import decimal
import enum
import hashlib
import importlib.metadata
import inspect
import json
import math
import types
from collections.abc import Mapping, Set
from functools import singledispatch
from pathlib import PurePath

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from trialframe.errors import PlanError


def content_hash(payload: Column | str) -> Column:
    """sha-256 of a text (UTF-8) or binary column, in hex."""
    return F.sha2(F.col(payload) if isinstance(payload, str) else payload, 256)


def row_fingerprint(columns: list[str], versions: Mapping[str, str] | None = None) -> Column:
    """sha-256 over the named columns and constants, independent of the order they are named in."""
    parts = {c: F.col(f"`{c}`") for c in columns} | {k: F.lit(v) for k, v in (versions or {}).items()}
    return F.sha2(F.to_json(F.struct(*(parts[k].alias(k) for k in sorted(parts))), {"ignoreNullFields": "false"}), 256)


def map_fingerprint(column: str) -> Column:
    """sha-256 of a map column, entries sorted by key."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(column)))), 256)


#: What a cached result depends on.
KEY_PARTS = ("block", "code", "dependencies", "environment", "inputs", "model", "parameters", "seed", "serializers")


def _key_parts(parts: Mapping) -> list:
    if wrong := sorted(set(KEY_PARTS) ^ set(parts)):
        raise ValueError(f"a cache key is made of {KEY_PARTS}; missing or unknown: {wrong}")
    return [parts[k] for k in KEY_PARTS]


def cache_key(parts: Mapping[str, Column]) -> Column:
    """The key of a cached result per row: every part as text, null as the empty one, framed by its length."""
    texts = [F.coalesce(c.cast("string"), F.lit("")) for c in _key_parts(parts)]
    return F.sha2(F.concat(*(x for t in texts for x in (F.octet_length(t).cast("string"), F.lit(":"), t))), 256)


def cache_key_of(parts: Mapping[str, str | None]) -> str:
    """The same key for one result, on the driver."""
    texts = [(t or "").encode() for t in _key_parts(parts)]
    return hashlib.sha256(b"".join(b"%d:%s" % (len(t), t) for t in texts)).hexdigest()


# -- values on the driver ----------------------------------------------------------------------------------


@singledispatch
def tagged(value: object) -> object:
    """What stands for ``value`` in its canonical text. A kind without a registered form is an error, never its ``repr``."""
    if dataclasses.is_dataclass(value):
        return ["object", type(value).__qualname__, tagged({f.name: getattr(value, f.name) for f in dataclasses.fields(value)})]
    raise PlanError(f"{type(value).__qualname__} has no canonical form")


for _kind in (type(None), bool, int, str):
    tagged.register(_kind, lambda value: value)


@tagged.register
def _(value: float) -> object:
    if not math.isfinite(value):
        raise ValueError("NaN and infinities have no canonical form")
    return ["float", value.hex()]


@tagged.register
def _(value: bytes) -> object:
    return ["bytes", hashlib.sha256(value).hexdigest()]


@tagged.register
def _(value: np.ndarray) -> object:
    return ["array", value.dtype.str, list(value.shape), hashlib.sha256(np.ascontiguousarray(value).tobytes()).hexdigest()]


tagged.register(np.generic, lambda value: tagged(value.item()))
tagged.register(enum.Enum, lambda value: ["member", type(value).__qualname__, value.name])
tagged.register(PurePath, lambda value: ["path", value.as_posix()])
tagged.register(decimal.Decimal, lambda value: ["decimal", str(value.normalize())])
tagged.register(list, lambda value: ["list", *map(tagged, value)])
tagged.register(tuple, lambda value: ["list", *map(tagged, value)])
tagged.register(Mapping, lambda value: ["map", *sorted(([tagged(k), tagged(v)] for k, v in value.items()), key=_text)])
tagged.register(Set, lambda value: ["set", *sorted(map(tagged, value), key=_text)])
for _kind in (datetime.datetime, datetime.date, datetime.time):
    tagged.register(_kind, lambda value: [type(value).__name__, value.isoformat()])


def _text(form: object) -> str:
    return json.dumps(form, ensure_ascii=False, separators=(",", ":"))


def canonical_text(value: object) -> str:
    return _text(tagged(value))


def fingerprint(value: object) -> str:
    return hashlib.sha256(canonical_text(value).encode()).hexdigest()


def _release(module: str) -> str | None:
    try:
        return importlib.metadata.version(module.partition(".")[0])
    except (importlib.metadata.PackageNotFoundError, ValueError):
        return None


def _state(value: object) -> dict:
    """What makes up an object: what it would be pickled as."""
    state = value.__getstate__()
    return state if isinstance(state, dict) else {}


def _source(target: object) -> str:
    try:
        return inspect.getsource(target)
    except (OSError, TypeError):
        code = getattr(target, "__code__", None)
        return code.co_code.hex() + _text([str(c) for c in code.co_consts if isinstance(c, int | float | str)]) if code else ""


def code_fingerprint(function: object, version: str = "1", seen: tuple = ()) -> str:
    """Hash of where a function is from, its text, defaults, version, and what it closes over.

    Functions that it closes over count with their own code, objects with their type and state; so the hash is the same in
    every process. What has neither (an open file, say) counts with its type alone.
    """
    function = inspect.unwrap(function)
    plain = inspect.isroutine(function) or inspect.isclass(function)
    target = function if plain else type(function)
    seen = (*seen, function)

    def held(value: object, within: tuple = seen) -> object:
        if any(value is s for s in within):
            return ["again", type(value).__qualname__]
        if isinstance(value, types.ModuleType):
            return ["module", value.__name__]
        if callable(value):
            return ["code", code_fingerprint(value, "", within)]
        try:
            return tagged(value)
        except (PlanError, ValueError):
            return ["state", type(value).__qualname__, *([str(k), held(v, (*within, value))] for k, v in sorted(_state(value).items()))]

    def content(cell) -> object:
        try:
            return held(cell.cell_contents)
        except ValueError:  # not filled yet
            return None

    own = [] if plain else [[k, held(v)] for k, v in sorted(_state(function).items())]
    cells = [content(c) for c in getattr(function, "__closure__", None) or ()]
    defaults = [held(d) for d in (*(getattr(function, "__defaults__", None) or ()), *(getattr(function, "__kwdefaults__", None) or {}).values())]
    module = getattr(target, "__module__", None) or ""
    return fingerprint(["function", module, getattr(target, "__qualname__", ""), _release(module), version, _source(target), _text(cells), _text(defaults), _text(own)])
