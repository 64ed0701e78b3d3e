import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from odd_rows import ODD_ROWS  # noqa: E402


@pytest.fixture(autouse=True, scope="session")
def shared_folder(spark, tmp_path_factory):
    """Tests run on one machine, so any folder of it is shared; a configured one comes first."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("quorumbook.shared.dir", f"file://{tmp_path_factory.mktemp('shared')}")


@pytest.fixture
def documents(spark):
    """Rows to documents: (doc_id, text, lang, source, ...) with columns that clash with names used inside."""
    def make(rows, extra=True):
        df = spark.createDataFrame([(*r, *[None] * (4 - len(r))) for r in rows],
                                   "doc_id bigint, text string, lang string, source string")
        if extra:
            for name in ("hash", "kept", "row", "digest", "key", "n", "size", "stratum", "found", "rep", "spans"):
                df = df.selectExpr("*", f"'clash' AS {name}")
        return df
    return make


@pytest.fixture
def odd(documents):
    return documents(ODD_ROWS)


@pytest.fixture
def empty(documents):
    return documents([])
