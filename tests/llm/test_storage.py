import pytest

from folioframe.llm import storage


class Conf:
    def get(self, key, default=None):
        return default


class Session:
    conf = Conf()

    class sparkContext:  # noqa: N801
        master = "spark://host:7077"

        @staticmethod
        def getConf():  # noqa: N802
            return Conf()

        @staticmethod
        def getCheckpointDir():  # noqa: N802
            return None


def test_a_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())


def test_local_folder_and_tables(spark):
    assert storage.shared_dir(spark) == storage.shared_dir(spark)
    df, path = storage.write_table(spark.range(5).repartition(3), "numbers")
    assert df.count() == 5 and path.startswith(storage.shared_dir(spark))
    storage.drop_table(spark, path)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_free_names():
    assert storage.free_name(["A", "a_"], "a") == "a__" and storage.free_name(["b"], "a") == "a"
