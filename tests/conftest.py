import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from chronodoc.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", 4, spark__ui__showConsoleProgress="false", spark__sql__adaptive__coalescePartitions__parallelismFirst="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def rows():
    def get(df, *cols):
        return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())

    return get
