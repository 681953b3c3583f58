import pytest

from titlesieve.sources.storage import materialise, scratch_folder, spread


def test_scratch_lies_in_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    folders = {scratch_folder(spark, "x") for _ in range(3)}
    assert len(folders) == 3
    assert all(folder.startswith(f"{shared}/titlesieve/x-") for folder in folders)


def test_without_the_setting_it_lies_in_the_warehouse():
    class Session:
        class conf:
            @staticmethod
            def get(key, default=None):
                return {"spark.sql.warehouse.dir": "hdfs://shared/warehouse/"}.get(key, default)

        class sparkContext:
            @staticmethod
            def getCheckpointDir():
                return None

    assert scratch_folder(Session, "x").startswith("hdfs://shared/warehouse/titlesieve/x-")


def test_stored_rows_do_not_change(spark):
    stored = materialise(spark.range(100).selectExpr("id", "rand() AS r"), "rows")
    assert sorted(stored.collect()) == sorted(stored.collect())
    assert stored.count() == 100


def test_spread_only_where_tasks_are_few(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    scan = spark.read.parquet(str(tmp_path / "one"))
    cores = spark.sparkContext.defaultParallelism
    assert scan.rdd.getNumPartitions() < cores
    assert spread(scan).rdd.getNumPartitions() == cores
    assert sorted(row.id for row in spread(scan).collect()) == list(range(1000))
    many = spark.range(0, 1000, 1, cores * 2)
    assert spread(many) is many
