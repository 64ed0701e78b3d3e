import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quorumbook.session import local_session

    session = local_session(8, partitions=4, name="tests")
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.conf.set("quorumbook.shared.dir", f"file://{tmp_path_factory.mktemp('shared')}")
    yield session
    session.stop()
