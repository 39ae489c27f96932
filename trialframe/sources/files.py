"""Files that exactly one writer can create, by what a file system promises.

Local file systems link a finished file to a name, which fails if the name is taken. HDFS and its like rename without
overwriting, atomically. Object stores do neither; they put an object on the condition that there is none, which Hadoop
offers when a file is created. A file system that is known for none of these is refused.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.errors import IllegalArgumentException
from pyspark.sql import SparkSession

from trialframe.errors import ConfigError


def _link(spark: SparkSession, path: str, data: bytes) -> bool:
    final = Path(unquote(urlparse(path).path))
    final.parent.mkdir(parents=True, exist_ok=True)
    written = final.with_name(f".{uuid.uuid4().hex}.part")
    written.write_bytes(data)
    try:
        os.link(written, final)  # unlike a rename, fails if the name is taken
    except FileExistsError:
        return False
    finally:
        written.unlink()
    return True


def _rename(spark: SparkSession, path: str, data: bytes) -> bool:
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    final = hadoop.Path(path)
    files, temporary = final.getFileSystem(conf), hadoop.Path(final.getParent(), f".{uuid.uuid4().hex}.part")
    out = files.create(temporary, True)
    out.write(bytearray(data))
    out.close()
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.NONE
    try:
        hadoop.FileContext.getFileContext(final.toUri(), conf).rename(temporary, final, options)
    except Exception:
        files.delete(temporary, False)
        if files.exists(final):
            return False
        raise
    return True


#: What Hadoop's builder of files must promise for a conditional put (fixed value).
CONDITIONAL = "fs.option.create.conditional.overwrite"


def _conditional_put(spark: SparkSession, path: str, data: bytes) -> bool:
    """The object appears when the stream is closed, if there is none of its name by then; the store decides."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    final = hadoop.Path(path)
    files = final.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        out = files.createFile(final).recursive().overwrite(False).must(CONDITIONAL, True).build()
        out.write(bytearray(data))
        out.close()
    except IllegalArgumentException as e:
        raise ConfigError(f"{path}: this file system puts nothing on a condition") from e
    except Exception:
        if files.exists(final):
            return False
        raise
    return True


Commit = Callable[[SparkSession, str, bytes], bool]
#: How a file is created once, by the scheme of its path.
COMMITS: dict[str, Commit] = {"": _link, "file": _link} | dict.fromkeys(("hdfs", "viewfs", "abfs", "abfss", "ofs"), _rename) | dict.fromkeys(("s3a", "gs"), _conditional_put)


def create_once(spark: SparkSession, path: str, data: bytes) -> bool:
    """Create a file, whole or not at all; False if there is one already, or another writer was first."""
    scheme = urlparse(path).scheme
    if scheme not in COMMITS:
        raise ConfigError(f"{scheme}: not known to create a file once; name a way in files.COMMITS")
    return COMMITS[scheme](spark, path, data)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text, read by the driver."""
    where = urlparse(path)
    if where.scheme in ("", "file"):
        return Path(unquote(where.path)).read_text()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names(spark: SparkSession, root: str, pattern: str) -> list[str]:
    """Paths below ``root`` that match, relative to it, in few calls however many they are."""
    hadoop = spark._jvm.org.apache.hadoop
    base = hadoop.fs.Path(root)
    found = base.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop.fs.Path(f"{root}/{pattern}"))
    if not found:
        return []
    # a job's input paths are kept as one text: far fewer calls than one for each path
    job = hadoop.mapred.JobConf(False)
    hadoop.mapred.FileInputFormat.setInputPaths(job, hadoop.fs.FileUtil.stat2Paths(found))
    at = base.toUri().getPath() + "/"
    return [p.rpartition(at)[2] for p in job.get("mapreduce.input.fileinputformat.inputdir").split(",")]
