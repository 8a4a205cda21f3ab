"""Files of the shared store, written and read through Hadoop's file systems (never the local one of a process)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; on one machine a local one if it is unset."""
    named, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not named and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or "file:///tmp/checkpoints").rstrip("/")


def scratch(spark: SparkSession, tag: str = "work") -> str:
    """A new folder below the shared one; it is deleted when the application ends."""
    path = f"{shared_root(spark)}/mnemosail/{tag}-{uuid.uuid4().hex}"
    place, fs = _open(spark, path)
    fs.mkdirs(place)
    fs.deleteOnExit(place)
    return path


def _open(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str, modified_ms: int | None = None) -> None:
    """Replaces a file in one step: readers see the old text or the new one.

    Each writer has its own temporary name beside the file, and the rename overwrites.
    """
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    place, fs = _open(spark, temporary)
    out = fs.create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    move(spark, temporary, path)
    if modified_ms is not None:
        fs.setTimes(_open(spark, path)[0], modified_ms, -1)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of one small file, null if there is none."""
    place, fs = _open(spark, path)
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, if there is one."""
    place, fs = _open(spark, path)
    fs.delete(place, True)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what is directly below a folder."""
    place, fs = _open(spark, path)
    return [str(f.getPath().getName()) for f in fs.listStatus(place)] if fs.exists(place) else []


def move(spark: SparkSession, source: str, target: str) -> None:
    """Renames a file, over another if there is one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    (old, fs), (new, _) = _open(spark, source), _open(spark, target)
    fs.mkdirs(new.getParent())
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(new).toUri(), conf).rename(fs.makeQualified(old), fs.makeQualified(new), options)


def fingerprint(spark: SparkSession, path: str) -> str:
    """Size, number and latest change of the files below a path."""
    place, fs = _open(spark, path)
    summary, latest = fs.getContentSummary(place), fs.getFileStatus(place).getModificationTime()
    return f"{summary.getLength()}-{summary.getFileCount()}-{latest}"


def write_lines(spark: SparkSession, path: str, lines: list[str]) -> None:
    """A report of some lines, replaced in one step."""
    write_text(spark, path, "".join(f"{x}\n" for x in lines))


CURRENT = "CURRENT"


def replace_table(df: DataFrame, root: str) -> None:
    """Replaces a table in one step, also if ``df`` reads it: a new version is written beside the old one, then the pointer moves.

    Whoever reads meanwhile keeps the old version, which is deleted by the replacement after the next.
    """
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{version}")
    past = (read_text(spark, f"{root}/{CURRENT}") or "").split("\n")
    write_text(spark, f"{root}/{CURRENT}", "\n".join([version, *past[:1]]))
    for old in filter(None, past[1:]):
        place, fs = _open(spark, f"{root}/{old}")
        fs.delete(place, True)


def current_table(spark: SparkSession, root: str) -> DataFrame:
    """The version that the pointer names."""
    return spark.read.parquet(f"{root}/{read_text(spark, f'{root}/{CURRENT}').split()[0]}")
