import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from tillwright.session import checkpoint_dir, local_session  # noqa: E402
from tillwright.sources.catalog import Catalog  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", shuffle_partitions=8)
    checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture
def cat(spark):
    return Catalog(spark)


def rows(df, *cols, sort=True):
    out = [tuple(r[c] for c in cols) if cols else tuple(r) for r in df.collect()]
    return sorted(out, key=repr) if sort else out
