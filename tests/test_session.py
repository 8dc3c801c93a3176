"""The shared folder of written tables."""

import pytest

from omicspark import session


class Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class Fake:
    def __init__(self, master, named=None):
        self.sparkContext = Context(master)
        self.conf = {"spark.checkpoint.dir": named} if named else {}


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://x"])
def test_a_cluster_needs_a_named_folder(master):
    with pytest.raises(session.SharedFolderMissing):
        session.shared_folder(Fake(master))
    assert session.shared_folder(Fake(master, "hdfs://shared/")) == "hdfs://shared"


@pytest.mark.parametrize("master", ["local", "local[*]", "local[8]"])
def test_one_machine_makes_its_own_folder(master):
    fake = Fake(master)
    assert session.shared_folder(fake) == session.shared_folder(fake) == fake.sparkContext.folder


def test_written_tables_are_removed_at_the_end(spark, tmp_path):
    with session.removed_stages(spark) as paths:
        table = session.cut_lineage(spark.range(5))
        assert table.count() == 5
        kept = [p.replace("file:", "") for p in paths]
    assert len(kept) == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(kept[0]).count()
    outside = session.cut_lineage(spark.range(3))
    assert outside.count() == 3 and len(paths) == 1
