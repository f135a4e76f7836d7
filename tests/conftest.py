from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("CORPUSLOOM_DRIVER_MEMORY", "6g")

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from corpusloom.session import local_session

    session = local_session("8", 8)
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


def rows(df, *order):
    """The rows as tuples, sorted."""
    return sorted(map(tuple, df.collect()), key=repr)
