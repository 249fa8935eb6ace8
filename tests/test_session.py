from __future__ import annotations

from types import SimpleNamespace

import pytest

from roomledger import session


def stand_in(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default: folder, set=lambda key, value: None)
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda path: None)
    return SimpleNamespace(conf=conf, sparkContext=context)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,1000]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(stand_in(master))
    assert session.shared_folder(stand_in(master, "hdfs:///shared")) == "hdfs:///shared"


def test_a_local_session_has_a_folder_of_its_own():
    assert session.shared_folder(stand_in("local[4]"))
