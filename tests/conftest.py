import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fathomline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shared"))
    session = local_session("*", app="tests", **{"spark.checkpoint.dir": folder})
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a DataFrame as sorted tuples, or as given when ordered."""

    def collect(df, *columns, ordered=False):
        found = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
        return found if ordered else sorted(found, key=lambda r: [(v is None, str(v)) for v in r])

    return collect
