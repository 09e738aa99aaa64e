import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from marlstone.session import local_session, ship  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s


@pytest.fixture(scope="session")
def sf():
    return SF
