import pytest

from treeloom.plans import staging


def test_tables_are_written_to_the_configured_folder_and_released(spark):
    df = staging.materialize(spark.range(10).selectExpr("id", "cast(null as string) as x"), "some")
    plain = lambda uri: "/" + uri.removeprefix("file:").lstrip("/")
    folder = plain(df.inputFiles()[0].rsplit("/", 1)[0])
    assert df.count() == 10 and folder.startswith(plain(spark.conf.get("spark.checkpoint.dir")))
    assert staging.exists(df)
    staging.release(df)
    assert not staging.exists(df)
    import os

    assert "treeloom-some-" in folder and not os.path.exists(folder)


def test_empty_tables_keep_their_schema(spark):
    df = staging.materialize(spark.range(0).selectExpr("id", "array(1) as a"), "none")
    assert df.dtypes == [("id", "bigint"), ("a", "array<int>")] and df.count() == 0


class _Conf:
    def get(self, key, default=None):
        return default


class _Session:
    """As much of a cluster's session as the folder's choice looks at."""

    conf = _Conf()

    class sparkContext:  # noqa: N801
        master = "spark://host:7077"
        applicationId = "app-1"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                class Context:
                    @staticmethod
                    def getCheckpointDir():
                        class Nothing:
                            @staticmethod
                            def isDefined():
                                return False

                        return Nothing

                return Context


def test_a_cluster_without_the_setting_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_dir(_Session)
