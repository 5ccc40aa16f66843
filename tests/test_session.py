import subprocess
import sys
from pathlib import Path

import pytest

from gridclim import session
from gridclim.plans import keep_stage
from gridclim.session import (
    files_label, path_exists, remove_scratch, scratch_path, scratch_root,
)
from gridclim.sources import yearly_files


class Session:
    """A session that answers with fixed settings."""

    applicationId = "app-1"

    def __init__(self, **settings):
        self.conf = self.sparkContext = self
        self.settings = {k.replace("_", "."): v for k, v in settings.items()}

    def get(self, key, default=None):
        return self.settings.get(key, default)


def test_scratch_folder_is_the_one_the_cluster_names():
    session = Session(spark_checkpoint_dir="hdfs://shared/checkpoints/", spark_master="yarn")
    assert scratch_root(session) == "hdfs://shared/checkpoints"
    one, other = scratch_path(session, "a"), scratch_path(session, "a")
    assert one.startswith("hdfs://shared/checkpoints/gridclim/app-1/a-") and one != other


@pytest.mark.parametrize("master", ["yarn", "local[8]"])
def test_without_a_checkpoint_folder_the_warehouse_is_shared(master):
    session = Session(spark_master=master, spark_sql_warehouse_dir="hdfs://shared/warehouse")
    assert scratch_root(session) == "hdfs://shared/warehouse/_scratch"


def test_a_run_can_remove_what_it_wrote(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "scratch_root", lambda _: f"file://{tmp_path}")
    path = scratch_path(spark, "rows")
    spark.range(3).write.parquet(path)
    spark.range(3).write.parquet(f"file://{tmp_path}/other")
    assert path_exists(spark, path)
    remove_scratch(spark)
    assert not path_exists(spark, path)
    assert path_exists(spark, f"file://{tmp_path}/other")


def test_label_of_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one").write_text("1")
    folder = f"file://{tmp_path}/a"
    label = files_label(spark, folder)
    assert label == files_label(spark, folder) != files_label(spark, folder, folder + "/none")
    (tmp_path / "a" / "one").write_text("12")
    assert files_label(spark, folder) != label


def test_yearly_files():
    assert yearly_files("data/by_year/", [1917, 1918]) == [
        "data/by_year/1917.csv", "data/by_year/1918.csv"
    ]


def test_an_unfinished_stage_is_written_again(spark, tmp_path):
    path = str(tmp_path / "stage")
    calls = []

    def make():
        calls.append(1)
        return spark.range(3).selectExpr("id", "1917 AS Year")

    # An attempt that no marker names is what a failed run leaves behind.
    spark.range(9).write.parquet(f"{path}/attempt-x")
    assert keep_stage(spark, make, path, "a").count() == 3
    assert keep_stage(spark, make, path, "a").count() == 3
    assert len(calls) == 1
    assert keep_stage(spark, make, path, "b", by_year=True).count() == 3
    assert len(calls) == 2
    keep_stage(spark, make, path + "2")
    keep_stage(spark, make, path + "2")
    assert len(calls) == 4


def test_death_between_table_and_marker(spark, tmp_path, monkeypatch):
    """Run A is done; run B writes its table and dies; A must not see B's table."""
    path = str(tmp_path / "stage")
    keep_stage(spark, lambda: spark.range(3), path, "A")

    class Dead(Exception):
        pass

    def die(*_):
        raise Dead

    with monkeypatch.context() as patch:
        patch.setattr(type(spark.range(1)), "coalesce", die)
        with pytest.raises(Dead):
            keep_stage(spark, lambda: spark.range(9), path, "B")
    assert keep_stage(spark, lambda: spark.range(0), path, "A").count() == 3
    assert keep_stage(spark, lambda: spark.range(9), path, "B").count() == 9


def test_a_cluster_needs_a_shared_folder():
    local = {"spark_sql_warehouse_dir": "file:/data/warehouse/"}
    found = scratch_root(Session(spark_master="local[8]", **local))
    assert found == "file:/data/warehouse/_scratch"
    named = Session(spark_master="yarn", spark_checkpoint_dir="file:///shared/", **local)
    assert scratch_root(named) == "file:///shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(Session(spark_master="local-cluster[3,2,1024]", **local))


def test_without_a_library_of_the_corpus_queries_the_others_stay(tmp_path):
    """A missing package takes the corpus queries along, and says so."""
    code = (
        "import sys, warnings; sys.modules['zstandard'] = sys.modules['pyarrow'] = None\n"
        "with warnings.catch_warnings(record=True) as said:\n"
        "    warnings.simplefilter('always')\n"
        "    import __spark_entry__ as entry\n"
        "names = entry.queries()\n"
        "assert 'yearly_anomalies' in names and not [n for n in names if n.startswith('op')]\n"
        "assert 'pipeline' not in names and set(names) == set(entry.oracle_sql())\n"
        "assert len([w for w in said if 'no corpus queries' in str(w.message)]) <= 1\n"
    )
    root = Path(__file__).resolve().parents[1]
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
