from types import SimpleNamespace

import pytest

from tickloom.session import scratch_path, scratch_root


def _session(checkpoint_dir=None, **conf):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda k, d=None: conf.get(k.replace(".", "_"), d), set=None),
        sparkContext=SimpleNamespace(getCheckpointDir=lambda: checkpoint_dir),
    )


def test_shared_folder_comes_from_the_session():
    session = _session(spark_checkpoint_dir="hdfs://nn/shared/", spark_master="yarn")
    assert scratch_root(session) == "hdfs://nn/shared"
    assert scratch_path(session, "x").startswith("hdfs://nn/shared/x-")
    assert scratch_root(_session("s3a://b/ck", spark_master="yarn")) == "s3a://b/ck"


def test_a_cluster_without_shared_folder_is_an_error():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(_session(spark_master="spark://host:7077"))
