import types

import pytest

from tessera.llm import common


def session(master, named=None, found=None):
    context = types.SimpleNamespace(master=master, getCheckpointDir=lambda: found, setCheckpointDir=lambda path: None)
    return types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda key, default: named), sparkContext=context)


def test_checkpoint_folder():
    assert common.checkpoint_dir(session("spark://host:7077", "/shared/a/")) == "/shared/a"
    assert common.checkpoint_dir(session("spark://host:7077", None, "/shared/b")) == "/shared/b"
    assert "tessera-checkpoint-" in common.checkpoint_dir(session("local[4]"))
    for master in ("spark://host:7077", "yarn", "k8s://https://host", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            common.checkpoint_dir(session(master))
