import pytest

from curata.session import scratch_path, shared_root


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Context:
    def __init__(self, master, ckpt=None):
        self.master = master
        self.ckpt = ckpt

    def getCheckpointDir(self):
        return self.ckpt


class _Session:
    def __init__(self, master, conf, ckpt=None):
        self.conf = _Conf(conf)
        self.sparkContext = _Context(master, ckpt)


WAREHOUSE = {"spark.sql.warehouse.dir": "file:/work/spark-warehouse"}


def test_checkpoint_dir_wins_everywhere():
    s = _Session("yarn", {**WAREHOUSE, "spark.checkpoint.dir": "s3a://bucket/ckpt"})
    assert shared_root(s) == "s3a://bucket/ckpt"


def test_warehouse_only_on_local_master():
    assert shared_root(_Session("local[8]", WAREHOUSE)) == "file:/work/spark-warehouse"
    assert shared_root(_Session("yarn", WAREHOUSE)) is None


def test_cluster_without_shared_folder_refuses_to_write():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_path(_Session("spark://host:7077", WAREHOUSE), "t")


def test_scratch_tables_share_a_folder_of_the_application(spark):
    from curata.session import shared_root
    a, b = scratch_path(spark, "t"), scratch_path(spark, "t")
    folder = f"{shared_root(spark).rstrip('/')}/curata-{spark.sparkContext.applicationId}"
    assert a != b and a.startswith(f"{folder}/t-") and b.startswith(f"{folder}/t-")
    spark.range(3).write.parquet(a)
    assert spark.read.parquet(a).count() == 3


def test_programmatic_checkpoint_dir_counts():
    s = _Session("k8s://api", WAREHOUSE, ckpt="hdfs:///ckpt/app")
    assert shared_root(s) == "hdfs:///ckpt/app"
