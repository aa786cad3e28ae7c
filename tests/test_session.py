import pytest

from kifuframe import session


class Context:
    master = "spark://host:7077"

    def getCheckpointDir(self):
        return None


class Conf:
    def get(self, key, default=None):
        return default


class Session:
    sparkContext, conf = Context(), Conf()


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_named_folder_is_used(spark):
    assert session.scratch_path(spark, "x").startswith(session.shared_dir(spark))
