"""WARC archives as a Spark data source, written with revisit records for payloads seen before.

A record is a gzip member of its own, as the format asks. Members written here carry an extra field of the gzip
header: a marker of 16 random bytes that is the file's own, the member's length, and the length of the compressed
head. Reading plans one partition per ``split_bytes`` of a file; a partition begins at the first member at or
behind its offset, which the marker tells from anything that a payload may hold, and ends with the member that
crosses its end. Predicates on the record type and on other header fields are pushed down. The head is inflated
and parsed first; the payload of a record that fails the predicates, or of any record if the option ``payload``
is false, is neither inflated nor read: its length is known. Files of other writers lack the field. They are read
from their beginning by one partition, and inflated to find where records end.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from trialframe.scratch import fresh_path, materialize
from trialframe.llm.workers import bound_batches

READ_SCHEMA = "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, payload_bytes long, content_length long, payload binary"
WRITE_SCHEMA = "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, payload_bytes long, payload binary"
#: Column to header field (fixed values of the format; X- fields are this library's own).
FIELDS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "payload_bytes": "X-Payload-Length",
    "content_length": "Content-Length",
}
NUMBERS = ("payload_bytes", "content_length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = datetime(2020, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
#: Bytes read at once, and payload bytes of a batch, about.
BLOCK, BATCH = 1 << 18, 8 << 20
#: What a member written here begins with; behind it come marker, member's length, compressed head's length.
START = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", 32) + b"TF" + struct.pack("<H", 28)
TAIL = struct.Struct("<16sQI")
BROADCAST_ROWS = 200_000


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (pafs.LocalFileSystem(), path)


def _clean(value: str) -> str:
    """Header values hold no line ends."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unclean(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(row: dict, marker: bytes, level: int = 1) -> bytes:
    """One record as a gzip member."""
    payload = row["payload"] or b""
    head = ["WARC/1.1", f"WARC-Date: {DATE}", "Content-Type: application/octet-stream"]
    if row["record_type"] == "revisit":
        head.append(f"WARC-Profile: {PROFILE}")
    for column, field in FIELDS.items():
        value = len(payload) if column == "content_length" else row[column]
        if value is not None:
            head.append(f"{field}: {_clean(str(value))}")
    text = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n"
    press = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    first = press.compress(text) + press.flush(zlib.Z_FULL_FLUSH)  # what comes behind can be inflated on its own
    rest = press.compress(payload) + press.compress(b"\r\n\r\n") + press.flush()
    check = zlib.crc32(b"\r\n\r\n", zlib.crc32(payload, zlib.crc32(text)))
    length = len(START) + TAIL.size + len(first) + len(rest) + 8
    end = struct.pack("<II", check, (len(text) + len(payload) + 4) & 0xFFFFFFFF)
    return b"".join((START, TAIL.pack(marker, length, len(first)), first, rest, end))


class _Writer(DataSourceArrowWriter):
    """Tasks write below a hidden folder of the job; committing is one rename of it."""

    def __init__(self, options: dict) -> None:
        self.path, self.level, self.job = options["path"].rstrip("/"), int(options.get("level", 1)), uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, base = _open(self.path)
        files.create_dir(f"{base}/.job-{self.job}", recursive=True)
        marker = uuid.uuid4().bytes
        message = WriterCommitMessage()
        message.name = f"part-{uuid.uuid4().hex}.warc.gz"
        with files.open_output_stream(f"{base}/.job-{self.job}/{message.name}", compression=None) as out:
            for batch in iterator:
                for at in range(0, batch.num_rows, 64):
                    for row in batch.slice(at, 64).to_pylist():
                        out.write(record(row, marker, self.level))
        return message

    def commit(self, messages: list) -> None:
        """Readers see all files of the successful attempts at once, and none of the others."""
        files, base = _open(self.path)
        hidden, done = f"{base}/.job-{self.job}", {m.name for m in messages if m is not None}
        for found in files.get_file_info(pafs.FileSelector(hidden, allow_not_found=True)):
            if found.base_name not in done:
                files.delete_file(found.path)
        if done:
            files.move(hidden, f"{base}/job-{self.job}")

    def abort(self, messages: list) -> None:
        files, base = _open(self.path)
        if files.get_file_info(f"{base}/.job-{self.job}").type != pafs.FileType.NotFound:
            files.delete_dir(f"{base}/.job-{self.job}")


class _File:
    """Parts of a file, read in blocks."""

    def __init__(self, handle, size: int) -> None:
        self.handle, self.size, self.at, self.block = handle, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        if not self.at <= at <= at + n <= self.at + len(self.block):
            self.handle.seek(at)
            self.at, self.block = at, self.handle.read(max(n, BLOCK))
        return self.block[at - self.at : at - self.at + n]

    def find(self, what: bytes, at: int, stop: int) -> int:
        """Where ``what`` begins, from ``at`` on and before ``stop``; -1 if nowhere."""
        while at < stop:
            part = self.get(at, min(BLOCK, self.size - at))
            found = part.find(what)
            if found >= 0:
                return at + found if at + found < stop else -1
            if at + len(part) >= self.size:
                return -1
            at += len(part) - len(what) + 1
        return -1


def _fields(head: bytes) -> dict[str, str] | None:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        return None
    return {k: _unclean(v) for k, _, v in (x.partition(": ") for x in lines[1:])}


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.split = int(options.get("split_bytes", 64 << 20))
        #: Header fields and the values that pass; None stands for any value.
        self.wanted: list[tuple[str, frozenset | None]] = []
        self.inflated = 0

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and membership of header fields are decided here, from the heads alone."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            known = column in FIELDS and column not in NUMBERS
            if known and isinstance(f, EqualTo | EqualNullSafe) and f.value is not None:
                self.wanted.append((FIELDS[column], frozenset([f.value])))
            elif known and isinstance(f, In):  # a null in the list passes nothing, nor does an empty list
                self.wanted.append((FIELDS[column], frozenset(v for v in f.value if v is not None)))
            elif known and isinstance(f, IsNotNull):
                self.wanted.append((FIELDS[column], None))
            else:
                yield f

    def _wants(self, fields: dict[str, str]) -> bool:
        return all(k in fields if values is None else fields.get(k) in values for k, values in self.wanted)

    def partitions(self) -> list[InputPartition]:
        files, base = _open(self.path)
        found = files.get_file_info(pafs.FileSelector(base, allow_not_found=True, recursive=True))
        hidden = lambda p: any(x[:1] in "._" for x in p[len(base) :].strip("/").split("/"))
        sizes = sorted((f.path, f.size) for f in found if f.path.endswith(".warc.gz") and not hidden(f.path))
        return [InputPartition((p, at, min(at + self.split, n), n)) for p, n in sizes for at in range(0, n, self.split)] or [InputPartition(None)]

    def _own(self, file: _File, start: int, stop: int, marker: bytes) -> Iterator[dict]:
        """Records whose members begin in a part of a file that was written here."""
        lead = START + marker
        at = file.find(lead, start, stop) if start else 0
        while 0 <= at < stop:
            begins = file.get(at, len(START) + TAIL.size)
            if not begins.startswith(lead):
                raise ValueError(f"no WARC record at {at}")
            _, length, n_head = TAIL.unpack(begins[len(START) :])
            behind = at + len(begins)
            head = zlib.decompressobj(-zlib.MAX_WBITS).decompress(file.get(behind, n_head))
            self.inflated += len(head)
            fields = _fields(head[:-4])
            if fields is None:
                raise ValueError(f"no WARC record at {at}")
            if self._wants(fields):
                payload = None
                if self.payload:
                    rest = file.get(behind + n_head, length - len(begins) - n_head)
                    inflate = zlib.decompressobj(-zlib.MAX_WBITS)
                    payload = inflate.decompress(rest)
                    self.inflated += len(payload)
                    if struct.unpack("<I", inflate.unused_data[:4])[0] != zlib.crc32(payload, zlib.crc32(head)):
                        raise ValueError(f"the record at {at} is damaged")
                    payload = payload[: int(fields["Content-Length"])]
                yield {**fields, "payload": payload}
            at += length

    def _foreign(self, file: _File) -> Iterator[dict]:
        """Records of a file of another writer, one gzip member each."""
        at, left = 0, b""
        while left or at < file.size:
            inflate, head, kept, fields, wanted = zlib.decompressobj(31), b"", [], None, False
            while not inflate.eof:
                if not left:
                    left = file.get(at, min(BLOCK, file.size - at))
                    at += len(left)
                    if not left:
                        raise ValueError("the last WARC record is cut off")
                part = inflate.decompress(left)
                left = inflate.unused_data
                self.inflated += len(part)
                if fields is None:
                    head += part
                    text, found, part = head.partition(b"\r\n\r\n")
                    if not found:
                        continue
                    fields = _fields(text)
                    if fields is None:
                        raise ValueError("no WARC record")
                    wanted = self._wants(fields)
                if wanted and self.payload:
                    kept.append(part)
            if wanted:
                yield {**fields, "payload": b"".join(kept)[: int(fields["Content-Length"])] if self.payload else None}

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        path, start, stop, size = partition.value
        files, _ = _open(self.path)
        schema = pa.schema([(c, pa.int64() if c in NUMBERS else pa.string()) for c in FIELDS] + [("payload", pa.binary())])
        rows: list[dict] = []
        held = 0

        def out() -> pa.RecordBatch:
            made = [{c: (int(r[f]) if c in NUMBERS else r[f]) if f in r else None for c, f in FIELDS.items()} | {"payload": r["payload"]} for r in rows]
            rows.clear()
            return pa.RecordBatch.from_pylist(made, schema=schema)

        with files.open_input_file(path) as handle:
            file = _File(handle, size)
            begins = file.get(0, min(size, len(START) + TAIL.size))
            own = begins.startswith(START) and len(begins) == len(START) + TAIL.size
            if own:
                found = self._own(file, start, stop, begins[len(START) : len(START) + 16])
            else:
                found = self._foreign(file) if start == 0 else iter(())
            for row in found:
                rows.append(row)
                held += len(row["payload"] or b"")
                if len(rows) >= 2000 or held > BATCH:
                    yield out()
                    held = 0
        if rows:
            yield out()


class WarcDataSource(DataSource):
    """``format("warc")``: options path, payload (true), split_bytes, level (1)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    bound_batches(spark)


def _small(df: DataFrame) -> DataFrame | None:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else None


def records(pages: DataFrame, least: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The archive's records: of equal payloads of ``least`` bytes or more, only the smallest id's is stored.

    Null html is empty, a null url is left out. Rows that repeat both the id and the payload of a response are
    responses too. Null ids come after all others. An empty table gives no records. Payloads may have any length that a
    task can hold twice. Other columns are not read and may have any names.
    """
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    narrow = rows.where(F.col("payload_bytes") >= least).select(F.col("page_id").alias("p"), F.col("payload_digest").alias("d"))
    firsts = narrow.groupBy("d").agg(F.min("p").alias("first"), F.count("*").alias("n")).where("n > 1").select("d", "first")
    firsts = materialize(firsts, "payloads")
    found = _small(firsts)
    if found is not None:
        rows = rows.join(found, F.col("payload_digest") == F.col("d"), "left")
    else:  # ids meet their payloads' first ones by digest, without the payloads; these move by page
        again = narrow.join(firsts, "d").where(~F.col("p").eqNullSafe(F.col("first"))).distinct()
        rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("payload_digest") == F.col("d")), "left")
    again = F.col("d").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return rows.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.coalesce(urn(F.col("page_id")), F.lit("<urn:page:>")).alias("record_id"),
        "target_uri",
        F.concat(F.lit("sha256:"), "payload_digest").alias("payload_digest"),
        F.when(again, urn(F.col("first"))).alias("refers_to"),
        "payload_bytes",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write_archive(recs: DataFrame, path: str) -> None:
    register(recs.sparkSession)
    recs.write.format("warc").mode("append").save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = True, split_bytes: int = 64 << 20) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("split_bytes", split_bytes).load(path)


def page_of(record_id: str) -> Column:
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def archive_report(spark: SparkSession, path: str) -> DataFrame:
    """Per record: what a response's payload, or a revisit's head says. Revisits are read without any payload."""
    responses = read_archive(spark, path).where("record_type = 'response'")
    revisits = read_archive(spark, path, payload=False).where("record_type = 'revisit'")
    out = responses.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    out = out.unionByName(revisits.withColumns({"size": F.col("payload_bytes"), "digest": F.substring_index("payload_digest", ":", -1)}))
    return out.select(page_of("record_id").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", page_of("refers_to").alias("refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to a fresh archive in the shared folder and report what is read back."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archive(records(pages), path)
    return archive_report(pages.sparkSession, path)
