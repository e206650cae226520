"""Files through Hadoop's file system, so that any store that Spark reads will do."""

from __future__ import annotations

import json
import re
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def listing(spark: SparkSession, path: str, directories: bool = False) -> list[str]:
    """Names of the files (or directories) in a directory, sorted."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() == directories)


def signature(spark: SparkSession, path: str) -> dict[str, int] | None:
    """{mtime, size} of a file, or of a directory's files (latest time, sum); None if there is none: equal signatures mean an unchanged source."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    status = fs.getFileStatus(p)
    if status.isDirectory():
        found = [s for s in fs.listStatus(p) if s.isFile()]
        return {"mtime": max((s.getModificationTime() for s in found), default=0), "size": sum(s.getLen() for s in found)}
    return {"mtime": status.getModificationTime(), "size": status.getLen()}


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def read_json(spark: SparkSession, path: str) -> Any:
    return json.loads(read_text(spark, path))


def replace_file(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file over another, in one step where the store can, so that there is an old or a new one at any time."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, p = _fs(spark, target)
    _, new = _fs(spark, source)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(new), fs.makeQualified(p), options)
        return
    except Py4JJavaError as e:
        if not fs.exists(new):
            raise OSError(f"could not rename {source}") from e
    # A store without such a rename: the old file is kept aside until the new one is there.
    _, aside = _fs(spark, f"{target}.old-{uuid.uuid4().hex}")
    had = fs.exists(p) and fs.rename(p, aside)
    if not fs.rename(new, p):
        if had:
            fs.rename(aside, p)
        raise OSError(f"could not rename {source}")
    if had:
        fs.delete(aside, False)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside the target and rename over it, so that a reader never sees half a file or none."""
    fs, p = _fs(spark, path)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    _, beside = _fs(spark, temporary)
    fs.mkdirs(p.getParent())
    fs.setWriteChecksum(False)  # people edit these files
    try:
        stream = fs.create(beside, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
    finally:
        fs.setWriteChecksum(True)
    replace_file(spark, temporary, path)


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    write_text(spark, path, json.dumps(value, indent=2, ensure_ascii=False))


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.delete(p, True)


def discover(spark: SparkSession, template: str) -> list[str]:
    """The files of a path; ``<int>`` in its name stands for digits, and files come in the order of that number."""
    directory, _, name = template.rpartition("/")
    if "<int>" not in name:
        if not exists(spark, template):
            raise FileNotFoundError(template)
        return [template]
    pattern = re.compile("(.*)".join(map(re.escape, name.split("<int>", 1))), re.S)
    found = []
    for file in listing(spark, directory or "."):
        m = pattern.fullmatch(file)
        if m and m[1].isdigit():
            found.append((int(m[1]), file))
    if not found:
        raise FileNotFoundError(f"no file matches {template}")
    return [f"{directory or '.'}/{file}" for _, file in sorted(found)]
