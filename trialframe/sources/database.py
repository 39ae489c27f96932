"""Tables of SQL databases through DB-API drivers: a Python data source with partitions, pushed predicates and staged writes.

    register(spark)
    spark.read.format("database").option("connect", "sqlite3:connect").option("target", path).option("table", "orders").schema(...).load()

``connect`` names a function (module:function) that is given ``target`` and returns a connection; it is called where rows
are read and written. Reads are cut into ranges of the integer column ``key``; comparisons of a column with a value go
into the statements. A write goes to a staging table first, in short transactions, as some databases let one writer in at a
time; only when all tasks are through does one transaction move the rows of those that count into the table, in one pass. A
write that fails leaves nothing behind.
"""

from __future__ import annotations

import importlib
import re
import uuid
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from itertools import islice

from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage

from trialframe.errors import ConfigError

#: Column types by Spark's (fixed values).
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "double": "DOUBLE PRECISION", "float": "REAL", "string": "TEXT", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "binary": "BLOB"}
OPERATORS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
#: Rows of a read or a statement, and rows that a task makes ready before it opens a transaction for them.
ROWS, BATCH = 5000, 50_000


def quoted(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ConfigError(f"{name!r} is no plain name of a table or column")
    return f'"{name}"'


def sqlite(path: str):
    """A connection to a file that waits for other writers; the file has to be where all tasks see it."""
    import sqlite3

    connection = sqlite3.connect(path, timeout=600)
    connection.execute("PRAGMA cache_size = -64000")  # KB, for the key's index
    return connection


@dataclass(frozen=True)
class Place:
    """Where a table is."""

    connect: str
    target: str
    table: str
    key: str | None
    partitions: int
    unique: tuple[str, ...]

    @classmethod
    def of(cls, options: dict) -> Place:
        missing = [k for k in ("connect", "target", "table") if not options.get(k)]
        if missing:
            raise ConfigError(f"options {missing} are not set")
        unique = tuple(c.strip() for c in options.get("unique", "").split(",") if c.strip())
        return cls(options["connect"], options["target"], options["table"], options.get("key"), max(1, int(options.get("partitions", "1"))), unique)

    def open(self):
        module, _, function = self.connect.partition(":")
        return getattr(importlib.import_module(module), function)(self.target)

    @property
    def mark(self) -> str:
        """How the driver writes a parameter."""
        style = getattr(importlib.import_module(self.connect.partition(":")[0]), "paramstyle", "qmark")
        return {"format": "%s", "pyformat": "%s"}.get(style, "?")


@dataclass
class Range(InputPartition):
    """Rows with a key from ``low`` to below ``high``; the open end takes the null keys too."""

    value: int = 0
    low: int | None = None
    high: int | None = None


class TableReader(DataSourceReader):
    def __init__(self, place: Place, schema: T.StructType) -> None:
        self.place, self.schema, self.filters = place, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            plain = len(getattr(f, "attribute", ())) == 1
            values = f.value if isinstance(f, In) else (getattr(f, "value", None),)
            simple = all(v is None or type(v) in (int, float, str) for v in values)
            if plain and simple and (type(f) in OPERATORS and values[0] is not None or isinstance(f, In) and 0 < len(values) <= 500 or isinstance(f, IsNull | IsNotNull)):
                self.filters.append(f)
            else:
                yield f

    def where(self) -> tuple[list[str], list]:
        """What was pushed down, as conditions and their values."""
        conditions, values = [], []
        for f in self.filters:
            column = quoted(f.attribute[0])
            if isinstance(f, IsNull | IsNotNull):
                conditions.append(f"{column} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL")
            elif isinstance(f, In):
                known = [v for v in f.value if v is not None]
                conditions.append(f"{column} IN ({', '.join([self.place.mark] * len(known))})" if known else "1 = 0")
                values += known
            else:
                conditions.append(f"{column} {OPERATORS[type(f)]} {self.place.mark}")
                values.append(f.value)
        return conditions, values

    def partitions(self) -> list[Range]:
        place = self.place
        if place.key is None or place.partitions == 1:
            return [Range(0)]
        conditions, values = self.where()
        with closing(place.open()) as connection, closing(connection.cursor()) as cursor:
            key = quoted(place.key)
            cursor.execute(f"SELECT min({key}), max({key}) FROM {quoted(place.table)}" + (f" WHERE {' AND '.join(conditions)}" if conditions else ""), values)
            low, high = cursor.fetchone()
        if low is None:
            return [Range(0)]
        step = max(1, -(-(high - low + 1) // place.partitions))
        cuts = list(range(low + step, high + 1, step))
        return [Range(i, *ends) for i, ends in enumerate(zip([None, *cuts], [*cuts, None], strict=True))]

    def read(self, partition: Range) -> Iterator[tuple]:
        place = self.place
        conditions, values = self.where()
        if partition.high is not None:
            below = f"{quoted(place.key)} < {place.mark}"
            conditions.append(below if partition.low is not None else f"({below} OR {quoted(place.key)} IS NULL)")
            values.append(partition.high)
        if partition.low is not None:
            conditions.append(f"{quoted(place.key)} >= {place.mark}")
            values.append(partition.low)
        columns = ", ".join(quoted(f.name) for f in self.schema) or "1"
        kinds = [f.dataType for f in self.schema]
        with closing(place.open()) as connection, closing(connection.cursor()) as cursor:
            cursor.execute(f"SELECT {columns} FROM {quoted(place.table)}" + (f" WHERE {' AND '.join(conditions)}" if conditions else ""), values)
            while rows := cursor.fetchmany(ROWS):
                for row in rows:
                    yield tuple(_from_database(v, k) for v, k in zip(row, kinds, strict=False))


def _from_database(value, kind: T.DataType):
    """Drivers without types of their own give texts and integers where Spark has times and booleans."""
    if value is None:
        return None
    if isinstance(kind, T.BooleanType):
        return bool(value)
    if isinstance(value, str) and isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        from datetime import date, datetime

        return date.fromisoformat(value[:10]) if isinstance(kind, T.DateType) else datetime.fromisoformat(value)
    return float(value) if isinstance(kind, T.DoubleType | T.FloatType) else value


def _to_database(value):
    return value.isoformat(" ") if hasattr(value, "isoformat") else bytes(value) if isinstance(value, bytearray) else value


@dataclass
class Staged(WriterCommitMessage):
    """A task's rows in the staging table."""

    tag: int
    rows: int


class TableWriter(DataSourceWriter):
    def __init__(self, place: Place, schema: T.StructType, overwrite: bool) -> None:
        self.place, self.schema, self.overwrite = place, schema, overwrite
        self.columns = [quoted(f.name) for f in schema]
        unknown = [f.name for f in schema if f.dataType.simpleString() not in KINDS] + [c for c in place.unique if c not in schema.names]
        if unknown:
            raise ConfigError(f"columns {unknown} have no type in a database, or are not there")
        self.kinds = [f"{quoted(f.name)} {KINDS[f.dataType.simpleString()]}" for f in schema]
        self.staging, self.counted = (quoted(f"{what}_{uuid.uuid4().hex}") for what in ("staging", "counted"))
        self._run(f"CREATE TABLE {self.staging} ({', '.join([*self.kinds, 'staged_by BIGINT'])})")

    def _run(self, *statements: str | tuple) -> None:
        """Statements in one transaction."""
        with closing(self.place.open()) as connection:
            try:
                with closing(connection.cursor()) as cursor:
                    for s in statements:
                        cursor.execute(*((s,) if isinstance(s, str) else s))
                connection.commit()
            except BaseException:
                connection.rollback()
                raise

    def write(self, iterator: Iterator[T.Row]) -> Staged:
        tag, count = TaskContext.get().taskAttemptId(), 0
        insert = f"INSERT INTO {self.staging} VALUES ({', '.join([self.place.mark] * (len(self.columns) + 1))})"
        with closing(self.place.open()) as connection:
            while part := [(*map(_to_database, row), tag) for row in islice(iterator, BATCH)]:
                try:
                    with closing(connection.cursor()) as cursor:
                        for at in range(0, len(part), ROWS):
                            cursor.executemany(insert, part[at : at + ROWS])
                    connection.commit()
                except BaseException:
                    connection.rollback()
                    raise
                count += len(part)
        return Staged(tag, count)

    def commit(self, messages: list[Staged | None]) -> None:
        table, names = quoted(self.place.table), ", ".join(self.columns)
        key = [f"PRIMARY KEY ({', '.join(map(quoted, self.place.unique))})"] if self.place.unique else []
        statements: list[str | tuple] = [f"CREATE TABLE IF NOT EXISTS {table} ({', '.join([*self.kinds, *key])})"]
        if self.overwrite:
            statements.append(f"DELETE FROM {table}")
        statements.append(f"CREATE TABLE {self.counted} (tag BIGINT)")
        statements += [(f"INSERT INTO {self.counted} VALUES ({self.place.mark})", (m.tag,)) for m in messages if m is not None]
        statements.append(f"INSERT INTO {table} ({names}) SELECT {names} FROM {self.staging} WHERE staged_by IN (SELECT tag FROM {self.counted})")
        statements.append(f"DROP TABLE {self.counted}")
        try:
            self._run(*statements)
        finally:
            self._run(f"DROP TABLE {self.staging}", f"DROP TABLE IF EXISTS {self.counted}")

    def abort(self, messages: list[Staged | None]) -> None:
        self._run(f"DROP TABLE IF EXISTS {self.staging}")


class DatabaseSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "database"

    def schema(self) -> T.StructType:
        raise ConfigError("a database table is read with a schema")

    def reader(self, schema: T.StructType) -> TableReader:
        return TableReader(Place.of(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> TableWriter:
        return TableWriter(Place.of(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let predicates reach it."""
    spark.dataSource.register(DatabaseSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
