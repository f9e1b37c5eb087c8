"""Every registered query against its SQL check on the smallest tables."""

import importlib.util
from pathlib import Path

import pytest

from paperloom.plans import load_all

spec = importlib.util.spec_from_file_location("parity", Path(__file__).resolve().parent.parent / "tools" / "parity.py")
parity = importlib.util.module_from_spec(spec)
spec.loader.exec_module(parity)

SF = "/root/testdata/sf0.001"
QUERIES, CHECKS = load_all()


@pytest.fixture(scope="module")
def con():
    return parity.duck(SF)


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_parity(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in CHECKS:
        result, _, _ = parity.compare(df, con, CHECKS[name])
        assert result == "ok"
    else:
        assert df.count() > 0
