import pytest

from arborstat.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    held = session("local[4]", 4, f"file://{tmp_path_factory.mktemp('shared')}")
    held.sparkContext.setLogLevel("ERROR")
    yield held
    held.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF
