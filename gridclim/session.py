"""What the library takes from the caller's session: the shared scratch folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a folder in the session's
    warehouse. On a cluster that folder must not be a local one, which each machine has for
    itself."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    local = re.match(r"local(\[|$)", spark.conf.get("spark.master", "local"))
    if not local and root.startswith(("file:", "/")):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{root}/_scratch"


def run_scratch(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{scratch_root(spark)}/gridclim/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own for every call, so that two runs never share files."""
    return f"{run_scratch(spark)}/{name}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession) -> None:
    """Removes the intermediate tables of this application. Results that still read them are void
    afterwards, so this is for the end of a run."""
    remove_path(spark, run_scratch(spark))


def _located(spark: SparkSession, path: str):
    located = spark._jvm.org.apache.hadoop.fs.Path(path)
    return located.getFileSystem(spark._jsc.hadoopConfiguration()), located


def path_exists(spark: SparkSession, path: str) -> bool:
    system, located = _located(spark, path)
    return system.exists(located)


def remove_path(spark: SparkSession, path: str) -> None:
    system, located = _located(spark, path)
    system.delete(located, True)


def rename_path(spark: SparkSession, path: str, new: str) -> None:
    system, located = _located(spark, path)
    if not system.rename(located, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"{path} cannot become {new}")


def list_path(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly in a folder."""
    system, located = _located(spark, path)
    return [status.getPath().getName() for status in system.listStatus(located)]


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text."""
    system, located = _located(spark, path)
    stream = system.open(located)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there as a whole or not at all; one that exists is an error."""
    part = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    system, located = _located(spark, part)
    stream = system.create(located)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if path_exists(spark, path) or not system.rename(
        located, spark._jvm.org.apache.hadoop.fs.Path(path)
    ):
        system.delete(located, False)
        raise FileExistsError(path)


def files_label(spark: SparkSession, *paths: str) -> str:
    """Names the content of files: path, length and modification time of each file below
    ``paths``. It changes when one of them does."""
    found = []
    for path in paths:
        system, located = _located(spark, path)
        if not system.exists(located):
            found.append(f"{path} missing")
            continue
        files = system.listFiles(located, True)
        while files.hasNext():
            status = files.next()
            found.append(
                f"{status.getPath()} {status.getLen()} {status.getModificationTime()}"
            )
    return uuid.uuid5(uuid.NAMESPACE_URL, "\n".join(sorted(found))).hex
