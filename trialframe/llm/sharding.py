"""Size-tiered compaction of immutable shards behind a versioned manifest.

Arrivals are appended as small shards (Parquet files that never change). A shard of b bytes is in
tier floor(log_fanout(b / smallest)). A tier that has gathered ``fanout`` shards is merged into
files of the target size (one file if there is less), so a row is rewritten at most once a tier.
Files become part of the table only when a manifest that lists them is committed: the file
``v<number>``, which only one writer can create; others then try the next number. Readers use the
highest version; older ones stay readable until ``vacuum``, which leaves alone what a writer may
still be about to commit.
"""

from __future__ import annotations

import json
import math
import random
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialframe.sources.files import create_once


#: Versions whose numbers stay taken after their manifests are gone.
TAKEN = 1000


class CommitConflict(RuntimeError):
    """Another writer committed this version first."""


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    rows: int


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str | None
    shards: tuple[Shard, ...]


class ShardStore:
    """A table of shards below ``root``, which every worker can reach through Spark's file systems."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, smallest_bytes: int = 1 << 20, fanout: int = 4, rows_per_shard: int = 8_000, tries: int = 20) -> None:
        self.spark, self.root, self.tries = spark, root.rstrip("/"), tries
        self.target, self.smallest, self.fanout, self.rows_per_shard = target_bytes, smallest_bytes, fanout, rows_per_shard
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self._fs = jvm.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- manifests -----------------------------------------------------------------------------------------

    def _versions(self) -> list[int]:
        at = self._path(f"{self.root}/manifests")
        if not self._fs.exists(at):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(at) if s.getLen())
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest manifest, or the one asked for; version 0 is the empty table."""
        versions = self._versions()
        version = (versions[-1] if versions else 0) if version is None else version
        if version == 0:
            return Manifest(0, None, ())
        stream = self._fs.open(self._path(f"{self.root}/manifests/v{version}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        if not text:
            raise ValueError(f"version {version} was vacuumed")
        data = json.loads(text)
        return Manifest(data["version"], data["schema"], tuple(Shard(**s) for s in data["shards"]))

    def commit(self, base: Manifest, shards: list[Shard], schema: str | None) -> Manifest:
        """Make ``shards`` the table, as the version after ``base``. Atomic; raises CommitConflict if that exists, or a later one."""
        new = Manifest(base.version + 1, schema, tuple(shards))
        if (self._versions() or [0])[-1] > base.version:
            raise CommitConflict(f"version {new.version} exists")
        text = json.dumps({"version": new.version, "schema": schema, "shards": [asdict(s) for s in shards]})
        if not create_once(self.spark, f"{self.root}/manifests/v{new.version}", text.encode()):
            raise CommitConflict(f"version {new.version} exists")
        return new

    # -- data ----------------------------------------------------------------------------------------------

    def _write(self, df: DataFrame, limit: int | None = None) -> list[Shard]:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        (df.write.option("maxRecordsPerFile", limit) if limit else df.write).parquet(folder)
        rows = self.spark.read.schema(df.schema).parquet(folder).groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("n"))
        rows = {r["name"]: r["n"] for r in rows.collect()}
        files = {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(self._path(folder))}
        return [Shard(f"{folder.removeprefix(self.root)[1:]}/{name}", files[name], n) for name, n in sorted(rows.items())]

    def append(self, df: DataFrame) -> Manifest:
        """Add the rows of ``df`` as small shards. An empty arrival commits a version without new shards.

        The rows are written once; where another writer commits first, the shards are listed behind that one's.
        """
        made: list[Shard] | None = None
        for turn in range(self.tries):
            base = self.manifest()
            if base.schema is not None and T.StructType.fromJson(json.loads(base.schema)).simpleString() != df.schema.simpleString():
                raise ValueError("the arrival's columns differ from the table's")
            made = self._write(df, self.rows_per_shard) if made is None else made
            try:
                return self.commit(base, [*base.shards, *made], base.schema or df.schema.json())
            except CommitConflict:
                time.sleep(random.uniform(0, 0.05 * 2 ** min(turn, 6)))
        raise CommitConflict(f"{self.tries} other writers were faster")

    def tier(self, shard: Shard) -> int:
        return max(0, math.floor(math.log(max(shard.bytes, 1) / self.smallest, self.fanout)))

    def due(self, manifest: Manifest, passed: frozenset[Shard] = frozenset()) -> list[Shard] | None:
        """The shards of the lowest tier that has gathered enough to merge, without those ``passed`` over."""
        tiers: dict[int, list[Shard]] = {}
        for s in manifest.shards:
            if s.bytes < self.target * 0.75 and s not in passed:
                tiers.setdefault(self.tier(s), []).append(s)
        return next((own for _, own in sorted(tiers.items()) if len(own) >= self.fanout), None)

    def compact(self) -> Manifest:
        """Merge tiers until none is due; every merge is a commit of its own.

        Where another writer commits first, the merged files are listed in its version if that still has all that they
        replace, else they are deleted. A tier that gets no fewer files is passed over, and the next one merged.
        """
        now, passed = self.manifest(), frozenset()
        while (own := self.due(now, passed)) is not None:
            files = max(1, round(sum(s.bytes for s in own) / self.target))
            merged = self._write(self._scan(now, own).coalesce(files))
            if len(merged) >= len(own):
                self._drop(merged)
                passed |= set(own)
                continue
            for _ in range(self.tries):
                try:
                    now = self.commit(now, [*(s for s in now.shards if s not in set(own)), *merged], now.schema)
                    break
                except CommitConflict:
                    now = self.manifest()
                    if not set(own) <= set(now.shards):
                        self._drop(merged)
                        break
            else:
                self._drop(merged)
                raise CommitConflict(f"{self.tries} other writers were faster")
        return now

    def _drop(self, shards: list[Shard]) -> None:
        for folder in {s.path.rsplit("/", 1)[0] for s in shards}:
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)

    def _scan(self, manifest: Manifest, shards: tuple[Shard, ...] | list[Shard]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(manifest.schema))
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{s.path}" for s in shards))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest."""
        manifest = self.manifest(version)
        if manifest.schema is None:
            raise ValueError("the table has no version")
        return self._scan(manifest, manifest.shards)

    def vacuum(self, keep: int = 1, orphans_after_s: float = 7 * 86_400) -> int:
        """Empty manifests but the last ``keep``, and delete the folders that only they list.

        The names of emptied manifests stay taken, the last ``TAKEN`` of them, so that a slow writer still finds that it lost.
        A folder that no manifest lists may belong to a writer that has yet to commit. It goes only when it has not
        changed for ``orphans_after_s``, which no append may take.
        """
        versions = self._versions()
        if not versions:
            return 0
        folders = lambda vs: {s.path.split("/")[1] for v in vs for s in self.manifest(v).shards}
        kept, retired = folders(versions[-keep:]), folders(versions[:-keep])
        gone = 0
        for v in versions[:-keep]:
            self._fs.create(self._path(f"{self.root}/manifests/v{v}"), True).close()
        for v in range(max(1, versions[0] - TAKEN), versions[-1] - TAKEN):
            self._fs.delete(self._path(f"{self.root}/manifests/v{v}"), False)
        data = self._path(f"{self.root}/data")
        for s in self._fs.listStatus(data) if self._fs.exists(data) else []:
            name = s.getPath().getName()
            orphan = name not in retired and time.time() - s.getModificationTime() / 1000 > orphans_after_s
            if name not in kept and (name in retired or orphan):
                self._fs.delete(s.getPath(), True)
                gone += 1
        return gone


def sharded(docs: DataFrame, root: str, arrivals: int = 4, **options) -> DataFrame:
    """Append ``docs`` to a store at ``root`` in ``arrivals``, compacting behind each, and read the newest version back with its shards' names.

    Rows are dealt to arrivals by a hash of their plain columns. Any columns and values are kept as they are, null, empty and
    very long ones too; repeated rows stay repeated; an empty table gives an empty one. The columns ``shard``, ``shard_bytes``
    and ``version`` are added in place of any so named.
    """
    store = ShardStore(docs.sparkSession, root, **options)
    rows = docs.drop("shard", "shard_bytes", "version")
    plain = [F.col(f"`{f.name}`") for f in rows.schema if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType)]
    turn = F.pmod(F.xxhash64(*plain), F.lit(arrivals)) if plain else F.lit(0)
    for k in range(arrivals):
        store.append(rows.where(turn == k))
        now = store.compact()
        store.vacuum()
    back = store.read(now.version)
    if not now.shards:
        return back.select("*", F.lit(None).cast("string").alias("shard"), F.lit(None).cast("long").alias("shard_bytes"), F.lit(now.version).alias("version"))
    return back.select("*", F.col("_metadata.file_name").alias("shard"), F.col("_metadata.file_size").alias("shard_bytes"), F.lit(now.version).alias("version"))
