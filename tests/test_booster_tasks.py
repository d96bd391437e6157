"""A level of a tree has as many tasks as the cluster has cores, not as there are blocks."""
import numpy as np

from ledgerscope.operators import boosting


def test_tasks_do_not_grow_with_blocks(spark, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 20)
    monkeypatch.setattr(boosting, "DIRECT_SUMS", 4)
    sums, tasks = boosting._sums, spark.sparkContext.accumulator(0)

    def counted(*args):
        run = sums(*args)

        def count(blocks):
            tasks.add(1)
            yield from run(blocks)
        return count
    monkeypatch.setattr(boosting, "_sums", counted)
    x = np.random.default_rng(1).normal(size=1280)
    rows = [([float(v)], int(v > 0.3), 1.0) for v in x]
    df = spark.createDataFrame(rows, "x array<double>, y int, w double").repartition(64)
    model = boosting.fit(df, "x", "y", "w", 2, 1, 0.1)
    assert all(abs(t.threshold[0] - 0.3) < 0.1 for t in model.trees)
    assert 0 < tasks.value <= 2 * max(4, spark.sparkContext.defaultParallelism)
