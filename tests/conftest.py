import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from paperloom.session import drop_cuts, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, app="tests")
    yield s
    drop_cuts(s)
    s.stop()


def rows(df, *cols):
    """Sorted tuples of a frame, for exact comparison."""
    out = [tuple(r[c] for c in cols) if cols else tuple(r) for r in df.collect()]
    return sorted(out, key=repr)
