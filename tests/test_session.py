import pytest
from pyspark.sql import functions as F

from keysift import session


@pytest.fixture
def unset(spark, monkeypatch):
    monkeypatch.setattr(session, "_parents", {})
    monkeypatch.setattr(session, "_made", [])


class Cluster:
    """What the folder rule asks a session for, on a cluster without a checkpoint folder."""

    master, applicationId = "spark://host:7077", "application-1"

    def __init__(self, configured=None):
        self.conf, self.sparkContext = {"spark.checkpoint.dir": configured}, self

    def getCheckpointDir(self):  # noqa: N802
        return None


def test_scratch_goes_to_the_folder_that_is_set(unset):
    assert session.scratch_path(Cluster("s3a://bucket/scratch/"), "x").startswith("s3a://bucket/scratch/keysift/x-")


def test_scratch_goes_to_the_default_file_system(unset, monkeypatch):
    monkeypatch.setattr(session, "default_folder", lambda s: "hdfs://store/user/me")
    assert session.scratch_path(Cluster(), "x").startswith("hdfs://store/user/me/keysift-scratch/")


def test_a_machines_own_folder_is_refused_on_a_cluster(unset, monkeypatch):
    monkeypatch.setattr(session, "default_folder", lambda s: "file:/home/me")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Cluster())


def test_scratch_tables_are_columnar_and_can_be_cleared(spark, unset):
    table = session.materialize(spark.range(5).withColumn("m", F.create_map(F.lit("a"), F.col("id"))))
    assert table.count() == 5 and "parquet" in table.inputFiles()[0]
    assert session.clear_scratch(spark) == 1
    with pytest.raises(Exception):
        spark.read.parquet(table.inputFiles()[0]).count()


def test_sides_are_measured_by_their_values(spark):
    rows = spark.createDataFrame([(1, "x" * 1000, [1.0] * 500, {"k": ["yy"] * 10}), (2, None, None, None)], "a long, b string, c array<double>, d map<string,array<string>>")
    assert 5000 < session.measured_bytes(rows) < 6000
    assert session.measured_bytes(rows.limit(0)) == 0
    assert session.is_small(rows, 6000) and not session.is_small(rows, 5000)
