import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from urlatlas.session import ensure_checkpoint_dir, get_spark
    s = get_spark("local[4]", app="urlatlas-tests", shuffle_partitions=4)
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


def rows(df, *cols):
    return [tuple(r[c] for c in cols) if cols else tuple(r) for r in df.collect()]
