"""Hard-negative mining with exact integer scores.

Anchors are dealt into tiles, candidates too, and every pair of tiles is one
group of a co-grouped job.  A group multiplies its two int64 matrices by Strassen's
recursion (zero padding to even sizes, exact integer additions; integers
modulo 2**64 form a ring, so results are exact wherever the score itself fits).
The first pass gives each anchor the heap of its best positives within a tile,
the second, whose tiles also know the anchors' positives, the heap of the best
negatives of each (anchor, positive) window.  Heaps hold a fixed number of rows
and are merged: the best of each map task first, then of all.

The stated set of anchors meets all rows, so the work is their product; it is
spread over the pairs of tiles, and no task holds more than one pair.  Rows are dealt by a
hash of their place, so equal vectors or one frequent label fill no tile.

Defined results: rows with a null id, label or vector or with a null or
non-finite component take no part; vectors shorter than the longest are
continued by zeros; rows that repeat a vec_id are rows of their own, with ties
between them in no stated order; scores are exact as far as a long holds them,
a component or a score beyond is an error; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.llm.common import drop_kept, keep
from ledgerscope.session import ship_package

# fixed values: the scale of a component, anchors, relabelled rows, window in percent
SCALE, ANCHOR_EVERY, RELABEL_EVERY, LABELS = 256, 100, 7, 10
POSITIVES, NEGATIVES, LEAST_PERCENT, MOST_PERCENT = 5, 10, 30, 90
#: rows of an anchor tile and of a candidate tile, about; side below which Strassen's recursion ends
ANCHOR_TILE, CANDIDATE_TILE, LEAF = 512, 2_048, 64
LIMIT = 1 << 63


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b for int64 matrices, by seven products of halves a level."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    even = lambda x: x + (x & 1)
    if (m | k | n) & 1:
        a = np.pad(a, ((0, even(m) - m), (0, even(k) - k)))
        b = np.pad(b, ((0, even(k) - k), (0, even(n) - n)))
    r, s, t = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:r, :s], a[:r, s:], a[r:, :s], a[r:, s:]
    b11, b12, b21, b22 = b[:s, :t], b[:s, t:], b[s:, :t], b[s:, t:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * r, 2 * t), np.int64)
    out[:r, :t], out[:r, t:] = p1 + p4 - p5 + p7, p3 + p5
    out[r:, :t], out[r:, t:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:m, :n]


def integer_vectors(rows: DataFrame, label_rule: bool = True) -> DataFrame:
    """(row, vec_id, label, v) of the rows that take part; v as integers."""
    v = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    label = F.col("label").cast("long")
    if label_rule:
        label = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (label + 1) % LABELS).otherwise(label)
    scaled = F.transform(v, lambda x: x.cast("double") * SCALE)
    large = F.exists(scaled, lambda x: F.abs(x) >= float(LIMIT))
    error = F.raise_error(F.lit("a component is too large for exact scores in 64 bits"))
    return (rows.where(fine).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"),
                                    F.when(large, error).otherwise(F.transform(scaled, lambda x: F.floor(x).cast("long"))).alias("v")))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of integers, continued by zeros up to ``width``."""
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    lengths = np.diff(flat.offsets.to_numpy())
    out = np.zeros((len(flat), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat.flatten().to_numpy(zero_copy_only=False)
    return out


def _require_long(a: np.ndarray, b: np.ndarray) -> None:
    """An error if a score of the rows of ``a`` and ``b`` is beyond a long.  Only
    scores that doubles cannot tell from such are taken in whole integers."""
    x, y = np.abs(a.astype(float)), np.abs(b.astype(float))
    if x.max(initial=0) * y.max(initial=0) * a.shape[1] < LIMIT / 2:
        return
    slack = (x @ y.T) * (a.shape[1] + 4) * 2.0**-52
    for i, j in np.argwhere(np.abs(a.astype(float) @ b.astype(float).T) + slack >= LIMIT):
        if not -LIMIT <= sum(p * q for p, q in zip(a[i].tolist(), b[j].tolist())) < LIMIT:
            raise OverflowError("a score is too large for 64 bits")


def _scores(left: pa.Table, right: pa.Table, width: int):
    """Scores of the pair of tiles, and what tells rows apart."""
    a, b = _matrix(left.column("v"), width), _matrix(right.column("other_v"), width)
    scores = strassen(a, b.T.copy())
    _require_long(a, b)
    same_row = left.column("row").to_numpy()[:, None] == right.column("other_row").to_numpy()
    same_label = left.column("label").to_numpy()[:, None] == right.column("other_label").to_numpy()
    return scores, same_row, same_label


def _best(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The first k (score, place) by higher score, then smaller id."""
    places = np.flatnonzero(allowed)
    if len(places) > 4 * k:  # only scores that can be among the first k go to the heap
        least = np.partition(scores[places], len(places) - k)[len(places) - k]
        places = places[scores[places] >= least]
    return heapq.nsmallest(k, ((-int(scores[p]), int(ids[p]), int(p)) for p in places))


def _positives(width: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if len(left) and len(right):
            scores, same_row, same_label = _scores(left, right, width)
            ids = right.column("other_vec_id").to_numpy()
            cand = right.column("other_row").to_numpy()
            for i, (row, vec_id) in enumerate(zip(left.column("row").to_pylist(), left.column("vec_id").to_pylist())):
                rows += [(row, vec_id, int(cand[p]), c, -s) for s, c, p in _best(scores[i], ids, same_label[i] & ~same_row[i], POSITIVES)]
        columns = list(zip(*rows)) or [()] * 5
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("anchor", "anchor_id", "positive", "positive_id", "positive_score"), columns)})
    return run


def _negatives(width: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if len(left) and len(right):
            scores, _, same_label = _scores(left, right, width)
            ids = right.column("other_vec_id").to_numpy()
            cand = right.column("other_row").to_numpy()
            for i, (row, vec_id, positives) in enumerate(zip(left.column("row").to_pylist(), left.column("vec_id").to_pylist(), left.column("positives").to_pylist())):
                for p in positives:
                    s = p["positive_score"]
                    # bounds in whole integers: a score's hundredfold may be beyond a long
                    allowed = ~same_label[i] & (scores[i] >= -(-LEAST_PERCENT * s // 100)) & (scores[i] <= MOST_PERCENT * s // 100)
                    rows += [(row, vec_id, p["positive"], p["positive_id"], s, int(cand[q]), c, -n) for n, c, q in _best(scores[i], ids, allowed, NEGATIVES)]
        columns = list(zip(*rows)) or [()] * 8
        names = ("anchor", "anchor_id", "positive", "positive_id", "positive_score", "negative", "negative_id", "negative_score")
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})
    return run


def _merged(heaps: DataFrame, key: list[str], score: str, vec_id: str, row: str, k: int) -> DataFrame:
    """The first ``k`` rows of each key over all its heaps; every map task keeps
    its own first ``k`` before rows move."""
    w = Window.partitionBy(*key).orderBy(F.col(score).desc(), vec_id, row)
    return heaps.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, label_rule: bool = True, anchor_tile: int = ANCHOR_TILE, candidate_tile: int = CANDIDATE_TILE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    ship_package(rows.sparkSession)
    vectors = keep(integer_vectors(rows, label_rule), "vectors")
    is_anchor = F.col("vec_id") % ANCHOR_EVERY == 0
    width, n, n_anchors = vectors.agg(F.max(F.size("v")), F.count("*"), F.count(F.when(is_anchor, 1))).first()
    tiles, anchor_tiles = max(1, -(-n // candidate_tile)), max(1, -(-n_anchors // anchor_tile))
    dealt = lambda seed, m: F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(m))
    all_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    # columns of their own: a co-group mixes up columns that both sides have from one table
    candidates = (vectors.withColumn("j", dealt(1, tiles)).withColumn("i", all_of(anchor_tiles))
                  .select("i", "j", *[F.col(c).alias(f"other_{c}") for c in vectors.columns]))
    anchors = vectors.where(is_anchor).withColumn("i", dealt(2, anchor_tiles))

    def met(anchors: DataFrame, fn, schema: str) -> DataFrame:
        return anchors.withColumn("j", all_of(tiles)).groupBy("i", "j").cogroup(candidates.groupBy("i", "j")).applyInArrow(fn, schema)

    found = met(anchors, _positives(width or 0), "anchor long, anchor_id long, positive long, positive_id long, positive_score long")
    positives = _merged(found, ["anchor"], "positive_score", "positive_id", "positive", POSITIVES)
    held = positives.groupBy("anchor").agg(F.collect_list(F.struct("positive", "positive_id", "positive_score")).alias("positives"))  # POSITIVES at most
    held = keep(anchors.join(held, F.col("row") == F.col("anchor")).drop("anchor"), "positives")
    windows = met(held, _negatives(width or 0), "anchor long, anchor_id long, positive long, positive_id long, positive_score long, "
                                                "negative long, negative_id long, negative_score long")
    best = _merged(windows, ["anchor", "positive"], "negative_score", "negative_id", "negative", NEGATIVES)
    result = keep(best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), "hard-negatives")
    drop_kept(vectors)
    drop_kept(held)
    return result


ORACLE = f"""
WITH t AS (SELECT vec_id, CASE WHEN vec_id % {RELABEL_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * {SCALE})) AS v
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same,
             CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
      FROM t a JOIN t c ON a.vec_id % {ANCHOR_EVERY} = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES}),
w AS (SELECT p.anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
       AND {LEAST_PERCENT} * positive_score <= 100 * score AND 100 * score <= {MOST_PERCENT} * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM w WHERE rank <= {NEGATIVES}
"""
