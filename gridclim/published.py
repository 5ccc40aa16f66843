"""Published tables: a new version is written beside the one that readers use, and a pointer to it
comes last. A run that dies before leaves the earlier version as it was.

Below the table's path, ``version=<id>/Year=<year>`` holds the files of a version, and
``_pointers/<number>`` names for each year the version that counts. Pointers are small files that
are written once and never replaced; the one with the highest number holds."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from .session import list_path, path_exists, read_text, remove_path, write_text

POINTERS = "_pointers"


class PublishConflict(RuntimeError):
    """Another run has published to the same table meanwhile."""


def _numbers(spark: SparkSession, path: str) -> list[int]:
    folder = f"{path}/{POINTERS}"
    if not path_exists(spark, folder):
        return []
    return sorted(int(name) for name in list_path(spark, folder) if name.isdigit())


def read_pointer(spark: SparkSession, path: str, number: int | None = None) -> dict | None:
    """The content of the last pointer, or of the one with a number; None where there is none."""
    numbers = _numbers(spark, path)
    if not numbers:
        return None
    number = numbers[-1] if number is None else number
    return json.loads(read_text(spark, f"{path}/{POINTERS}/{number:010d}")) | {"number": number}


def write_pointer(
    spark: SparkSession, path: str, content: dict, after: dict | None, keep: int = 2
) -> None:
    """Makes ``content`` the last pointer. ``after`` is the pointer that it was made from; if
    another one has come meanwhile, PublishConflict is raised and nothing changes. All but the last
    ``keep`` pointers are removed."""
    number = (after["number"] if after else 0) + 1
    numbers = _numbers(spark, path)
    if numbers and numbers[-1] >= number:
        raise PublishConflict(f"{path} has changed meanwhile")
    try:
        write_text(spark, f"{path}/{POINTERS}/{number:010d}", json.dumps(content))
    except FileExistsError as error:
        raise PublishConflict(f"{path} has changed meanwhile") from error
    for old in [n for n in numbers if n <= number - keep]:
        remove_path(spark, f"{path}/{POINTERS}/{old:010d}")


def is_published(spark: SparkSession, path: str) -> bool:
    return bool(_numbers(spark, path))


def publish_by_year(
    df: DataFrame,
    path: str,
    years: Iterable[int] | None = None,
    whole: bool = False,
    text: bool = False,
) -> None:
    """Publishes ``df`` by its column Year. With ``whole``, nothing of the earlier table is left;
    else its years replace those of the table, and ``years`` names all that are to be replaced, so
    that one without rows goes. ``text`` stores one text column instead of Parquet.

    The rebalance hint gathers a year into few files and lets adaptive execution split a year that
    is too large for one task. Versions that neither this pointer nor the one before names are
    removed, so readers that have begun can finish."""
    spark = df.sparkSession
    before = read_pointer(spark, path)
    version = uuid.uuid4().hex
    folder = f"{path}/version={version}"
    writer = df.hint("rebalance", "Year").write.partitionBy("Year")
    (writer.text if text else writer.parquet)(folder)
    written = [name for name in list_path(spark, folder) if name.startswith("Year=")]
    kept = {} if whole or before is None else dict(before["folders"])
    for year in years or ():
        kept.pop(f"Year={year}", None)
    folders = kept | {name: version for name in written}
    write_pointer(
        spark, path, {"folders": folders, "schema": df.schema.json(), "text": text}, before
    )
    used = {*folders.values(), *(before["folders"].values() if before else ())}
    for name in list_path(spark, path):
        if name.startswith("version=") and name.removeprefix("version=") not in used:
            remove_path(spark, f"{path}/{name}")


def published_folders(spark: SparkSession, path: str) -> tuple[dict, list[str]]:
    """The last pointer and the folders that it names."""
    pointer = read_pointer(spark, path)
    if pointer is None:
        raise FileNotFoundError(f"nothing is published under {path}")
    return pointer, [
        f"{path}/version={version}/{name}" for name, version in sorted(pointer["folders"].items())
    ]


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The table as last published; a filter on Year reads only that year. The schema comes from
    the pointer, so no file is opened before."""
    pointer, folders = published_folders(spark, path)
    schema = StructType.fromJson(json.loads(pointer["schema"]))
    if not folders:
        return spark.createDataFrame([], schema)
    full = StructType([*schema.fields, StructField("version", StringType())])
    reader = spark.read.schema(full).option("basePath", path)
    kind = "text" if pointer["text"] else "parquet"
    return reader.format(kind).load(folders).select(*schema.names)
