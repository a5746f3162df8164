from types import SimpleNamespace

import pytest

from scriptloom.session import work_dir


def session(master, folder=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: folder or default),
        sparkContext=SimpleNamespace(master=master),
    )


def test_shared_folder_is_used_when_set():
    path = work_dir(session("spark://host:7077", "hdfs:///shared/"), "ledger")
    assert path.startswith("hdfs:///shared/scriptloom/ledger-")


def test_only_a_local_session_falls_back():
    first, second = (work_dir(session("local[4]"), "x") for _ in range(2))
    assert first != second
    assert first.rsplit("/", 2)[0] == second.rsplit("/", 2)[0]
    with pytest.raises(ValueError):
        work_dir(session("yarn"), "x")


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*, 2]"])
def test_sessions_of_one_process_fall_back(master):
    assert "/scriptloom/x-" in work_dir(session(master), "x")


@pytest.mark.parametrize("master", ["local-cluster[2,1,512]", "yarn", "spark://host:7077"])
def test_clusters_must_name_a_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_dir(session(master), "x")
