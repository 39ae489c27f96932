"""A content-addressed store: payload tables and single objects, committed by a manifest written last."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialframe.errors import ArtifactCorrupt, ArtifactError
from trialframe.functions.canonical import content_hash
from trialframe.schemas import ARTIFACTS, schema
from trialframe.sources.codecs import Codecs


class ArtifactStore:
    """Objects at ``root`` (any Hadoop URI). A hash is stored once; only manifested objects can be read."""

    def __init__(self, spark: SparkSession, root: str, codecs: Codecs | None = None) -> None:
        self.spark, self.root, self.codecs = spark, root.rstrip("/"), codecs or Codecs()
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _put(self, name: str, data: bytes) -> None:
        """Write under a temporary name and rename: an object is whole or absent."""
        import uuid

        target, part = self._at(name), self._at(f"{name}.{uuid.uuid4().hex}.part")
        out = self._fs.create(part, True)
        out.write(bytearray(data))
        out.close()
        if not self._fs.rename(part, target):
            self._fs.delete(part, False)

    def _get(self, name: str) -> bytes:
        if not self._fs.exists(self._at(name)):
            raise ArtifactError(f"{name} is missing")
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    @staticmethod
    def _object(hash: str) -> str:
        return f"objects/sha256/{hash[:2]}/{hash}"

    def put(self, value: object, codec: str = "json", lineage: dict[str, str] | None = None, metadata: dict[str, str] | None = None, cache_key: str | None = None, run_id: str | None = None) -> dict:
        """Store one value; equal payloads share an object. Returns its reference."""
        import hashlib

        c = self.codecs.get(codec)
        data = c.encode(value)
        hash = hashlib.sha256(data).hexdigest()
        if not self._fs.exists(self._at(self._object(hash))):
            self._put(self._object(hash), data)
        ref = {"content_hash": hash, "codec": codec, "media_type": c.media_type, "size": len(data), "lineage": lineage or {}, "metadata": metadata or {}, "cache_key": cache_key, "run_id": run_id}
        if self._fs.exists(self._at(f"manifests/{hash}.json")):  # what is stored counts, not what came with a copy
            return json.loads(self._get(f"manifests/{hash}.json")) | {"cache_key": cache_key, "run_id": run_id}
        self._put(f"manifests/{hash}.json", json.dumps(ref, sort_keys=True).encode())
        return ref

    def read(self, ref: dict) -> object:
        import hashlib

        self._get(f"manifests/{ref['content_hash']}.json")
        data = self._get(self._object(ref["content_hash"]))
        if hashlib.sha256(data).hexdigest() != ref["content_hash"]:
            raise ArtifactCorrupt(f"hash mismatch of {ref['content_hash']}")
        return self.codecs.get(ref["codec"]).decode(data)

    def verify(self, ref: dict, strict: bool = True) -> bool:
        """Whether the object and its manifest are there and whole; raises instead of False if ``strict``."""
        try:
            self.read(ref)
        except ArtifactError:
            if strict:
                raise
            return False
        return True

    def lineage(self, ref: dict) -> dict[str, str]:
        self.verify(ref)
        return json.loads(self._get(f"manifests/{ref['content_hash']}.json"))["lineage"]

    # -- tables of payloads ----------------------------------------------------------------------------------

    def put_table(self, payloads: DataFrame, codec: str = "text", run_id: str | None = None) -> DataFrame:
        """Store the distinct payloads of a column ``payload`` that the store lacks; returns all their references.

        One aggregation by hash (payloads travel once), an anti-join against the manifest, then the manifest
        rows of what was written.
        """
        media = self.codecs.get(codec).media_type
        column = F.col("payload") if isinstance(payloads.schema["payload"].dataType, T.BinaryType) else F.encode("payload", "UTF-8")
        rows = payloads.select(column.alias("payload")).where("payload is not null").withColumn("content_hash", content_hash("payload"))
        rows = rows.groupBy("content_hash").agg(F.first("payload").alias("payload"))
        fresh = rows.join(self.manifest().select("content_hash"), "content_hash", "left_anti")
        import uuid

        part = f"{self.root}/tables/{uuid.uuid4().hex}"
        fresh.write.parquet(part)
        written = self.spark.read.parquet(part).select("content_hash", F.octet_length("payload").cast("long").alias("size"))
        listed = written.select(
            "content_hash", F.lit(run_id).cast("string").alias("run_id"), F.lit(None).cast("string").alias("cache_key"), F.lit(media).alias("media_type"), F.lit(codec).alias("serializer"),
            F.create_map().cast("map<string,string>").alias("lineage"), F.create_map(F.lit("part"), F.lit(part)).alias("metadata"), "size", F.current_timestamp().alias("created_at"),
        )
        listed.write.mode("append").parquet(f"{self.root}/manifest")
        return payloads.select(content_hash(column).alias("content_hash"))

    def manifest(self) -> DataFrame:
        if not self._fs.exists(self._at("manifest")):
            return self.spark.createDataFrame([], schema(ARTIFACTS))
        return self.spark.read.schema(schema(ARTIFACTS)).parquet(f"{self.root}/manifest")

    def payloads(self) -> DataFrame:
        """(content_hash, payload, whole): every manifested payload, re-hashed."""
        if not self._fs.exists(self._at("tables")):
            return self.spark.createDataFrame([], "content_hash string, payload binary, whole boolean")
        rows = self.spark.read.schema("content_hash string, payload binary").parquet(f"{self.root}/tables/*")
        listed = rows.join(self.manifest().select("content_hash"), "content_hash", "left_semi")
        return listed.withColumn("whole", content_hash("payload") == F.col("content_hash"))


def deduplicated(payloads: DataFrame, payload: str, order: str) -> DataFrame:
    """(content_hash, first, copies, size) per distinct payload, without moving payloads."""
    rows = payloads.select(content_hash(F.col(payload)).alias("content_hash"), F.col(order).alias("o"), F.octet_length(payload).alias("size"))
    return rows.groupBy("content_hash").agg(F.min("o").alias("first"), F.count("*").alias("copies"), F.max("size").cast("long").alias("size"))


def verified(manifest: DataFrame, objects: DataFrame) -> DataFrame:
    """Manifest rows with ``status``: verified, missing, or corrupt against ``objects(content_hash, payload)``."""
    found = objects.select(F.col("content_hash").alias("h"), (content_hash("payload") == F.col("content_hash")).alias("whole"))
    status = F.when(F.col("h").isNull(), "missing").when(F.col("whole"), "verified").otherwise("corrupt")
    return manifest.join(found, manifest.content_hash == found.h, "left").withColumn("status", status).drop("h", "whole")
