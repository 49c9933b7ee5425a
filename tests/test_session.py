"""The folder for intermediate data is one that all machines share, or an error."""

import pytest

from trajspark import session


class Settings(dict):
    """A session that has only these settings."""

    @property
    def conf(self):
        return self

    @property
    def sparkContext(self):  # noqa: N802
        return self

    def getConf(self):  # noqa: N802
        return {}

    def getCheckpointDir(self):  # noqa: N802
        return self.get("now")

    def setCheckpointDir(self, folder):  # noqa: N802
        self["now"] = folder


def test_folder_is_configured_or_an_error():
    assert session.checkpoint_dir(Settings({"spark.checkpoint.dir": "s3://a/b/"})) == "s3://a/b"
    assert session.checkpoint_dir(Settings({"spark.sql.warehouse.dir": "hdfs:/w"})) == "hdfs:/w/_checkpoints"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Settings())
    local = {"spark.sql.warehouse.dir": "file:/w"}
    assert session.checkpoint_dir(Settings({**local, "spark.master": "local[8]"})) == "file:/w/_checkpoints"
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="local folder"):
            session.checkpoint_dir(Settings({**local, "spark.master": master}))
        assert session.checkpoint_dir(Settings({**local, "spark.master": master, "spark.checkpoint.dir": "file:/shared"})) == "file:/shared"


def test_checkpoints_lie_in_the_folder(spark):
    df = session.cut_lineage(spark.range(3).toDF("a"))
    folder = spark.sparkContext.getCheckpointDir()
    session.cut_lineage(df)
    assert spark.sparkContext.getCheckpointDir() == folder
    assert df.count() == 3 and session.plain(spark.sparkContext.getCheckpointDir()).startswith(session.plain(session.checkpoint_dir(spark)))
