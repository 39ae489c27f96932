"""Codecs of artifact payloads, by id; column forms where Spark has them."""

from __future__ import annotations

import io
import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from trialframe.errors import ArtifactError


@dataclass(frozen=True)
class Codec:
    id: str
    media_type: str
    encode: Callable[[object], bytes]
    decode: Callable[[bytes], object]
    version: str = "1"


def _typed(kind: type, value: object) -> object:
    if not isinstance(value, kind):
        raise ArtifactError(f"expected {kind.__name__}, got {type(value).__name__}")
    return value


def _array_out(value: object) -> bytes:
    import numpy as np

    out = io.BytesIO()
    np.save(out, np.asarray(value), allow_pickle=False)
    return out.getvalue()


def _array_in(data: bytes) -> object:
    import numpy as np

    return np.load(io.BytesIO(data), allow_pickle=False)


def _json_out(value: object) -> bytes:
    """Keys sorted; NaN and infinities are refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


JSON = Codec("json", "application/json", _json_out, lambda b: json.loads(b))
BYTES = Codec("bytes", "application/octet-stream", lambda v: bytes(_typed(bytes, v)), lambda b: b)
TEXT = Codec("text", "text/plain; charset=utf-8", lambda v: str(_typed(str, v)).encode(), lambda b: b.decode())
NUMPY = Codec("numpy", "application/x-npy", _array_out, _array_in)


class Codecs:
    """A registry of codecs; unknown ids are an error."""

    def __init__(self) -> None:
        self._known = {c.id: c for c in (JSON, BYTES, TEXT, NUMPY)}

    def register(self, codec: Codec) -> None:
        if codec.id in self._known:
            raise ArtifactError(f"codec {codec.id!r} exists")
        self._known[codec.id] = codec

    def get(self, id: str) -> Codec:
        if id not in self._known:
            raise ArtifactError(f"unknown codec {id!r}")
        return self._known[id]

    def versions(self) -> dict[str, str]:
        return {k: c.version for k, c in sorted(self._known.items())}


def encode_text(column: Column) -> Column:
    return F.encode(column, "UTF-8")


def decode_text(column: Column) -> Column:
    return F.decode(column, "UTF-8")


def encode_json(column: Column) -> Column:
    """A struct, map or array as JSON bytes, nulls kept."""
    return F.encode(F.to_json(column, {"ignoreNullFields": "false"}), "UTF-8")


def npy(column: Column) -> Column:
    """Arrays of doubles as .npy payloads, a batch of Arrow rows at a time."""
    @F.pandas_udf("binary")
    def encode(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else _array_out(v))

    return encode(column)


def from_npy(column: Column) -> Column:
    @F.pandas_udf("array<double>")
    def decode(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else _array_in(v).astype(float).ravel())

    return decode(column)
