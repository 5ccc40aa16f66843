"""Intermediate tables in the shared scratch folder, for reuse within a run and for restarts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import path_exists
from ..sinks.tables import write_by_year


def keep_stage(
    spark: SparkSession,
    make: Callable[[], DataFrame],
    path: str,
    label: str | None = None,
    by_year: bool = False,
) -> DataFrame:
    """Writes ``make()`` below ``path`` and reads it back; the rest of the plan starts from the
    files and outlives lost executors. With a ``label``, a finished stage that carries the same
    label is reused; the label has to name all that the stage depends on. ``by_year`` stores the
    table by its column Year.

    Every attempt writes a folder of its own. A marker names label and folder of the finished
    attempt and is written last, so a run that dies before leaves the earlier stage as it was."""
    done = f"{path}/done"
    finished = _finished(spark, done) if label is not None else None
    if finished is not None and finished["label"] == label:
        return spark.read.parquet(f"{path}/{finished['folder']}")
    folder = f"attempt-{uuid.uuid4().hex}"
    stage = make()
    if by_year:
        write_by_year(stage, f"{path}/{folder}")
    else:
        stage.write.parquet(f"{path}/{folder}")
    if label is not None:
        marker = spark.range(1).select(F.lit(label).alias("label"), F.lit(folder).alias("folder"))
        marker.coalesce(1).write.mode("overwrite").parquet(done)
    # The known schema spares a look into the files.
    return spark.read.schema(stage.schema).parquet(f"{path}/{folder}")


def _finished(spark: SparkSession, done: str):
    """Label and folder of the finished attempt, if there is one."""
    if not path_exists(spark, f"{done}/_SUCCESS"):
        return None
    return spark.read.schema("label STRING, folder STRING").parquet(done).first()
