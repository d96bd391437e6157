"""op13: scores whose hundredfold is beyond a long, and components above 2**27."""
import numpy as np
import pytest

from ledgerscope.llm.hard_negatives import _require_long, hard_negatives

from .test_round_three import _mined

SCHEMA = "vec_id long, label int, embedding array<float>"


@pytest.mark.parametrize("size", [3e5, 2e6])
def test_large_components(spark, size):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 3)), np.abs(rng.normal(0, size, 16)).clip(0, 5e5 if size < 1e6 else 6e6).tolist()) for i in range(500)]
    found = {tuple(r) for r in hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(found) > 100 and found == _mined(rows)


def test_scores_beyond_a_long_are_an_error():
    a = np.array([[1 << 32, 1 << 32]], np.int64)
    _require_long(a, np.array([[1 << 32, -(1 << 32)], [1 << 30, 0], [(1 << 30) - 1, 1 << 30]], np.int64))
    for b in ([1 << 31, 0], [1 << 30, 1 << 30], [-(1 << 31), -1]):
        with pytest.raises(OverflowError, match="too large"):
            _require_long(a, np.array([b], np.int64))
