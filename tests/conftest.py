import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FIXTURES = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixtures")
SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quire.session import get_session

    ckpt = tempfile.mkdtemp(prefix="quire-test-ckpt-")
    s = get_session("local[*]", app_name="quire-tests", shuffle_partitions=8,
                    extra={"spark.checkpoint.dir": ckpt})
    yield s
    s.stop()


@pytest.fixture()
def fixtures_dir():
    return FIXTURES


def rows(df, *cols):
    """Collected rows as tuples (ordered as returned)."""
    sel = df.select(*cols) if cols else df
    return [tuple(r) for r in sel.collect()]
