"""The shared folder and what is left in it."""

import os
import re
from types import SimpleNamespace

import pytest

from limpid import session


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(getConf=dict, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None)))


def test_written_and_cleaned_up(spark):
    rows = session.written(spark.createDataFrame([(1, "a"), (None, None)], "x bigint, y string"), "test")
    assert sorted(rows.collect(), key=str) == [(1, "a"), (None, None)]
    assert session.written(rows.limit(0), "test").count() == 0
    path = re.sub("^file:/*", "/", rows.inputFiles()[0])
    assert os.path.exists(path) and session.clean_up(spark) >= 2
    assert not os.path.exists(path) and session.clean_up(spark) == 0
