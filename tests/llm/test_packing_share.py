"""The program's part of the packing."""

import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from ledgerscope.llm import packing


def test_the_program_places_the_volume(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).toPandas()
    assert packing.configurations.share >= 0.9
    assert rows.sequence_id.nunique() == math.ceil(rows.length.sum() / 2048)
    assert rows.groupby("sequence_id").length.sum().max() <= 2048


@pytest.mark.parametrize("scale", [1, 1000])
def test_shares_and_counts(scale):
    rng = np.random.default_rng(4)
    histogram = {n: c * scale for n, c in Counter(np.minimum(2048, rng.lognormal(5.5, 1.0, 6000).astype(int) + 1).tolist()).items()}
    plan = packing.configurations(histogram, 2048)
    placed = Counter()
    for configuration, times in plan:
        assert times > 0 and sum(n * a for n, a in configuration.items()) <= 2048
        placed.update({n: a * times for n, a in configuration.items()})
    bound = math.ceil(sum(n * c for n, c in histogram.items()) / 2048)
    assert placed == Counter(histogram) and sum(t for _, t in plan) <= bound * 1.0002 + 1 and packing.configurations.share >= 0.9


@pytest.mark.parametrize("histogram,capacity,want", [({}, 10, 0), ({5: 1}, 10, 1), ({1: 10_000}, 2048, 5), ({1500: 100, 600: 3}, 2048, 101), ({3: 50}, 2048, 1), ({700: 1000}, 2048, 500),
                                                      ({2: 40}, 100, 1), ({2048: 7, 1: 1}, 2048, 8)])
def test_odd_histograms(histogram, capacity, want):
    plan = packing.configurations(histogram, capacity)
    assert sum(t for _, t in plan) == want
    assert sum((Counter({n: a * t for n, a in c.items()}) for c, t in plan), Counter()) == Counter(histogram)
