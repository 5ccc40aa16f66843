"""New yearly files, one after the other: each run takes the files that arrived since the last
one and brings the affected years of the result up to date. A file that is delivered again takes
the place of its earlier delivery."""

from __future__ import annotations

import functools
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import ClimateConfig
from ..operators.anomaly import anomalies
from ..operators.coverage import active_days_per_year, restrict_to_tiles, tiles_of_active_days
from ..operators.daily import (
    daily_from_sums, facts_on_tiles, observation_facts, summed_facts,
)
from ..operators.lookups import fits_broadcast
from ..operators.maintained import (
    STATE_SCHEMA, baseline_of_state, baseline_state, changed_tiles, merged_states,
)
from ..operators.observe import accepted_observations
from ..operators.wide import wide_table, with_centres
from ..plans.stages import keep_stage
from ..published import is_published, publish_by_year, read_pointer, read_published, write_pointer
from ..session import list_path, path_exists, remove_path, scratch_path
from ..sources.observations import OBSERVATION_SCHEMA
from .deliveries import delivery_of, received, sums_that_count, with_years

#: Of a binary file only what its folder tells is asked for, so none is opened.
FILES_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
SUMS_SCHEMA = (
    "Tile_Id STRING, Date STRING, Element STRING, Station STRING, n BIGINT, n_value BIGINT,"
    " sum_value BIGINT, Year INT, batch BIGINT"
)
DAILY_SCHEMA = "Date STRING, Element STRING, Tile_Id STRING, Value DOUBLE, Year INT"
DAYS_SCHEMA = "Tile_Id STRING, Count BIGINT, Year INT"


@dataclass(frozen=True)
class YearlyIncrements:
    """Keeps the sums of accepted observations under ``store`` and the wide table under ``result``.

    ``baseline`` is a finished baseline year, or None: then the baseline and the considered tiles
    are kept up to date as well, and follow a year of their span that comes late or is corrected.
    ``tiled_stations`` comes from ``tile_stations``.

    What counts is named by a pointer under ``store`` that is written last: the deliveries and, with
    a baseline of its own, the folders of the daily values, the days with records and the state of
    the baseline. A run that dies before leaves the store as it was, and its batch is repeated."""

    spark: SparkSession
    tiled_stations: DataFrame
    baseline: DataFrame | None
    store: str
    result: str
    config: ClimateConfig = ClimateConfig()

    def start(self, incoming: str, checkpoint: str, files_per_batch: int = 1) -> StreamingQuery:
        """Processes all files that wait under ``incoming``, then stops.

        The stream carries the names of files, not their rows. So the deliveries are known before
        any row is read, and the rows are read once, in those columns alone that count."""
        files = (
            self.spark.readStream.format("binaryFile").schema(FILES_SCHEMA)
            .option("maxFilesPerTrigger", files_per_batch)
            .load(incoming)
            .select(
                "path", "length", F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_modification_time").alias("modified"),
            )
        )
        return (
            files.writeStream.foreachBatch(self._update_from_files)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )

    def _update_from_files(self, files: DataFrame, batch_id: int) -> None:
        # At most the files of a batch. Their names are no patterns.
        paths = [
            re.sub(r"([][{}*?\\])", r"\\\1", row["path"])
            for row in files.select("path").distinct().collect()
        ]
        batch = self.spark.read.schema(OBSERVATION_SCHEMA).csv(paths).select(
            "*", F.col("_metadata.file_path").alias("file")
        )
        self._update(batch, batch_id, files.where("length > 0"), may_be_empty=True)

    @functools.cached_property
    def _lookups(self) -> tuple[DataFrame, bool, DataFrame | None]:
        """The station list, whether it fits a broadcast, and the baseline, found out and stored
        once for all batches."""
        tiled = keep_stage(
            self.spark, lambda: self.tiled_stations, scratch_path(self.spark, "stations")
        )
        baseline = None if self.baseline is None else keep_stage(
            self.spark, lambda: self.baseline, scratch_path(self.spark, "baseline")
        )
        return tiled, fits_broadcast(tiled), baseline

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """Stores the sums of the batch and recomputes the years that it changes. A batch that is
        repeated takes the place of its first attempt.

        Rows without a column ``file`` are a delivery of their own."""
        if "file" in batch.columns:
            files = batch.groupBy("file").agg(F.max("modified").alias("modified"))
        else:
            files = None
        self._update(batch, batch_id, files)

    def _update(
        self, batch: DataFrame, batch_id: int, files: DataFrame | None, may_be_empty: bool = False
    ) -> None:
        pointer = read_pointer(self.spark, self.store)
        last = pointer or {"batch": -1, "before": None, "entries": {}}
        if batch_id < last["batch"]:
            raise ValueError(f"batch {batch_id} comes after batch {last['batch']}")
        before = last["before"] if batch_id == last["batch"] else last
        before = {k: v for k, v in (before or {"entries": {}}).items() if k != "before"}
        delivered = self._delivered(batch, batch_id, files)
        entries = self._store_sums(batch, delivered, before["entries"], may_be_empty)
        counted, old, seen = (
            sums_that_count(e) for e in (entries, before["entries"], last["entries"])
        )
        # What came and what went, also of an earlier attempt at this batch.
        years = {
            year for found in (old, seen)
            for number in found.keys() ^ counted.keys()
            for year in (found | counted)[number]
        }
        content = {"batch": batch_id, "entries": entries}
        if self.baseline is None:
            content |= self._maintained(before, counted, years)
        elif years:
            _, _, baseline = self._lookups
            daily = daily_from_sums(self._sums(counted, years))
            self._publish(anomalies(daily, baseline), years)
        write_pointer(self.spark, self.store, content | {"before": before}, pointer)
        self._remove_unused(content, before)

    def _delivered(
        self, batch: DataFrame, batch_id: int, files: DataFrame | None
    ) -> dict[str, list[str]]:
        """The deliveries of a batch, oldest first, and the files of each; without ``files``, all
        rows are one delivery."""
        if files is None:
            return {} if batch.isEmpty() else {f"batch-{batch_id}": []}
        # A name is cut out once a file, not once a row. At most the files of a batch.
        return {
            row["delivery"]: row["files"] for row in
            files.groupBy(delivery_of(F.col("file")).alias("delivery"))
            .agg(F.max("modified").alias("modified"), F.collect_set("file").alias("files"))
            .orderBy("modified", "delivery").collect()
        }

    def _store_sums(
        self, batch: DataFrame, delivered: dict[str, list[str]], before: dict, may_be_empty: bool
    ) -> dict:
        """Stores the sums of each delivery; the entries that they change. With ``may_be_empty``,
        deliveries may turn out to have no rows: then they are none, and what they had taken the
        place of is stored."""
        while True:
            entries, numbers = received(before, delivered)
            if not numbers:
                return entries
            self._write_sums(batch, {n: delivered[name] for name, n in numbers.items()})
            found: dict[str, list[int]] = {str(number): [] for number in numbers.values()}
            for year, number in self._stored():
                if number in found:
                    found[number].append(year)
            empty = {
                name for name, number in numbers.items()
                if may_be_empty and not found[str(number)]
                and batch.where(F.col("file").isin(delivered[name])).isEmpty()
            }
            if not empty:
                return with_years(entries, found)
            delivered = {name: own for name, own in delivered.items() if name not in empty}

    def _write_sums(self, batch: DataFrame, files: dict[int, list[str]]) -> None:
        """Stores the sums of deliveries by number; ``files`` are the files of each, and none where
        all rows are one delivery."""
        if "file" in batch.columns:
            numbered = self.spark.createDataFrame(
                [(file, number) for number, own in files.items() for file in own],
                "file STRING, batch BIGINT",
            )
            batch = batch.join(F.broadcast(numbered), "file")
        else:
            (number,) = files
            batch = batch.withColumn("batch", F.lit(number).cast("bigint"))
        tiled, broadcast, _ = self._lookups
        accepted = accepted_observations(batch, also=["batch"])
        wanted = F.col("Year").between(self.config.year_start_data, self.config.year_end_data)
        if self.baseline is None:
            wanted |= F.col("Year").between(
                self.config.year_start_baseline, self.config.year_end_baseline
            )
        facts = observation_facts(accepted.where(wanted), also=["batch"])
        (
            summed_facts(facts_on_tiles(facts, tiled, broadcast, also=["batch"]), also=["batch"])
            .hint("rebalance", "Year", "batch")
            .write.mode("append")
            .partitionBy("Year", "batch")
            .parquet(self.store)
        )

    def _stored(self) -> list[tuple[int, str]]:
        """Year and number of all stored sums."""
        if not path_exists(self.spark, self.store):
            return []
        years = [n for n in list_path(self.spark, self.store) if n.startswith("Year=")]
        return [
            (int(year.removeprefix("Year=")), number.removeprefix("batch="))
            for year in years
            for number in list_path(self.spark, f"{self.store}/{year}")
            if number.startswith("batch=")
        ]

    def _sums(self, counted: dict[str, list[int]], years: set[int]) -> DataFrame:
        return self._read(SUMS_SCHEMA, self.store, [
            f"{self.store}/Year={year}/batch={number}"
            for number, own in counted.items() for year in own if year in years
        ])

    def _read(self, schema: str, base: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", base).parquet(*folders)

    def _publish(self, differences: DataFrame, years: set[int], more: DataFrame | None = None):
        """Replaces ``years`` in the result; ``more`` are rows of them that stay as they are."""
        wide = with_centres(wide_table(differences), self.config.tile_size)
        publish_by_year(wide if more is None else wide.unionByName(more), self.result, years)

    # A baseline of its own

    def _maintained(self, before: dict, counted: dict, years: set[int]) -> dict:
        """Brings daily values, baseline and result up to date: of the years that changed all rows,
        of the others those of tiles whose baseline is another now. Returns the folders."""
        config = self.config
        attempt = f"{self.store}/_kept/{uuid.uuid4().hex}"
        folders = {
            kind: {y: f for y, f in before.get(kind, {}).items() if int(y) not in years}
            for kind in ("daily", "days")
        }
        fresh = keep_stage(
            self.spark, lambda: daily_from_sums(self._sums(counted, years)), f"{attempt}/daily",
            by_year=True,
        )
        days = keep_stage(
            self.spark, lambda: active_days_per_year(fresh), f"{attempt}/days", by_year=True
        )
        for kind, table in (("daily", fresh), ("days", days)):
            made = table.inputFiles()
            folders[kind] |= {
                path.rpartition("/Year=")[2].partition("/")[0]: path.rpartition("/")[0]
                for path in made
            }
        span = range(config.year_start_baseline, config.year_end_baseline + 1)
        replaced = self._kept(DAILY_SCHEMA, before.get("daily", {}), years & {*span})
        old_state = self._read(STATE_SCHEMA, self.store, before.get("state", []))
        state = keep_stage(
            self.spark,
            lambda: merged_states(
                old_state, baseline_state(replaced, config, -1), baseline_state(fresh, config)
            ),
            f"{attempt}/state",
        )
        old, new = (
            restrict_to_tiles(
                baseline_of_state(table),
                tiles_of_active_days(self._kept(DAYS_SCHEMA, known, {*span}), config),
                broadcast=True,
            )
            for table, known in ((old_state, before.get("days", {})), (state, folders["days"]))
        )
        new = keep_stage(self.spark, lambda: new, f"{attempt}/baseline")
        touched = keep_stage(
            self.spark, lambda: changed_tiles(old, new), f"{attempt}/tiles"
        )
        shown = range(config.year_start_data, config.year_end_data + 1)
        current = read_pointer(self.spark, self.result)
        same_result = current is not None and current["number"] == before.get("result")
        others = {int(y) for y in folders["daily"]} & {*shown} - years
        daily = self._kept(DAILY_SCHEMA, folders["daily"], years & {*shown})
        more = None
        if not same_result:  # another run has published there, or this one died after it
            daily = self._kept(DAILY_SCHEMA, folders["daily"], {*shown})
            years = {*shown}
        elif others and not touched.isEmpty():
            # The grid bounds the list of tiles.
            of_others = self._kept(DAILY_SCHEMA, folders["daily"], others)
            daily = daily.unionByName(restrict_to_tiles(of_others, touched, broadcast=True))
            kept = read_published(self.spark, self.result).where(F.col("Year").isin(*others))
            more = kept.join(F.broadcast(touched), "Tile_Id", "left_anti")
            years = years | others
        if years & {*shown}:
            self._publish(anomalies(daily, new), years & {*shown}, more)
        number = None
        if is_published(self.spark, self.result):
            number = read_pointer(self.spark, self.result)["number"]
        return folders | {
            "state": [path.rpartition("/")[0] for path in state.inputFiles()[:1]],
            "result": number,
        }

    def _kept(self, schema: str, folders: dict[str, str], years: set[int]) -> DataFrame:
        """The kept table of some years; its rows carry their Year in the folder's name."""
        chosen = [(int(y), folder) for y, folder in sorted(folders.items()) if int(y) in years]
        if not chosen:
            return self.spark.createDataFrame([], schema)
        tables = {}
        for _, folder in chosen:
            tables.setdefault(folder.rpartition("/")[0], []).append(folder)
        found = [self._read(schema, base, own) for base, own in tables.items()]
        return functools.reduce(DataFrame.unionByName, found)

    def _remove_unused(self, content: dict, before: dict) -> None:
        """Removes sums and tables that neither this pointer nor the one before counts."""
        counted = sums_that_count(content["entries"]) | sums_that_count(before["entries"])
        for year, number in self._stored():
            if number not in counted:
                remove_path(self.spark, f"{self.store}/Year={year}/batch={number}")
        if not path_exists(self.spark, f"{self.store}/_kept"):
            return
        used = " ".join(
            folder for part in (content, before)
            for kind in ("daily", "days") for folder in part.get(kind, {}).values()
        ) + " ".join(content.get("state", []) + before.get("state", []))
        for name in list_path(self.spark, f"{self.store}/_kept"):
            if name not in used:
                remove_path(self.spark, f"{self.store}/_kept/{name}")
