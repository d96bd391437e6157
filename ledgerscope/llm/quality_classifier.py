"""Quality classifier: random-indexing word vectors and a two-layer network.

Every token (a run of letters and digits, or of other marks) falls into one of
``BUCKETS`` hash buckets with a fixed sparse random index vector.  The context
vector of a bucket sums the index vectors of its tokens' neighbours over the
whole corpus (one extra coordinate counts neighbours that are the token
itself).  A document is the mean of its tokens' normalised context vectors and
its length.  A network of two layers is trained in numpy on a bounded sample
of labelled rows; a temperature fitted on a part kept aside calibrates it.

The context sums are whole numbers, so reruns agree to the last bit.  Their
table is BUCKETS x (SIZE + 1) numbers whatever the corpus.

Defined results: null and empty text have the vector of no token and a score
like any other; without labels of both classes every score is the share of
good labels (0.5 if there are none); labels that are null are not read; rows
that repeat a doc_id are scored each; a null doc_id is scored and not held
out; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.common import keep, map_arrow, pieces_of, text_bytes
from ledgerscope.llm.quality_rules import FOLDS, HELD_OUT, labelled_sample
from ledgerscope.llm.textscan import joined, running, span_hash

BUCKET_BITS, SIZE, NONZERO, ROWS = 13, 64, 4, 256
BUCKETS, WIDTH = 1 << BUCKET_BITS, SIZE + 1
SAMPLE, HIDDEN, EPOCHS = 20_000, 32, 40

_KIND = np.full(256, 2, np.int8)  # 0 space, 1 letters and digits, 2 other marks
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1


def _index() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(41)
    place = np.argsort(rng.random((BUCKETS, SIZE)), axis=1)[:, :NONZERO]
    return place, np.where(np.arange(NONZERO) % 2, -1, 1)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of each token."""
    buf, starts = joined(texts)
    kind = _KIND[buf]
    begin = np.flatnonzero((np.diff(kind, prepend=np.int8(0)) != 0) & (kind != 0))
    end = np.flatnonzero((np.diff(kind, append=np.int8(0)) != 0) & (kind != 0)) + 1
    bucket = (span_hash(running(buf), begin, end) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    return bucket, np.searchsorted(starts, begin, side="right") - 1


def _contexts(batches):
    """Sums of neighbours' index vectors of one task, in row blocks."""
    place, sign = _index()
    total = np.zeros(BUCKETS * WIDTH, np.int64)
    for part in pieces_of(batches):
        bucket, text = tokens(text_bytes(part.column("text")))
        beside = text[1:] == text[:-1]
        a, b = bucket[:-1][beside], bucket[1:][beside]
        echo = a == b
        total += np.bincount(a[echo] * WIDTH + SIZE, minlength=len(total)) * 2
        for word, neighbour in ((a[~echo], b[~echo]), (b[~echo], a[~echo])):
            for k in range(NONZERO):
                total += sign[k] * np.bincount(word * WIDTH + place[neighbour, k], minlength=len(total))
    rows = total.reshape(-1, ROWS * WIDTH)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype=np.int32)), pa.array([r.tobytes() for r in rows], pa.binary())],
                                     ["block", "sums"])


def _added(batches):
    """Sums of the blocks of one partition."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, sums in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist()):
            total[block] = total.get(block, 0) + np.frombuffer(sums, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([s.tobytes() for s in total.values()], pa.binary())],
                                     ["block", "sums"])


def context_vectors(docs: DataFrame) -> np.ndarray:
    """The normalised context vector of each bucket (a table of fixed size)."""
    parts = map_arrow(docs.select("text"), _contexts, "block int, sums binary")
    rows = map_arrow(parts.repartition("block"), _added, "block int, sums binary").collect()  # BUCKETS / ROWS rows
    table = np.zeros((BUCKETS // ROWS, ROWS * WIDTH))
    for r in rows:
        table[r["block"]] += np.frombuffer(r["sums"], np.int64)
    table = table.reshape(BUCKETS, WIDTH)
    return (table / np.maximum(1.0, np.sqrt((table**2).sum(axis=1, keepdims=True)))).astype(np.float32)


def _pooled(vectors: np.ndarray):
    def run(batches):
        for part in pieces_of(batches, 1 << 20):
            bucket, text = tokens(text_bytes(part.column("text")))
            n = part.num_rows
            out = np.zeros((n, WIDTH + 1), np.float32)
            for at in range(0, n, 256):  # a dense count table of 256 texts
                some = (text >= at) & (text < at + 256)
                rows = min(256, n - at)
                counts = np.bincount((text[some] - at) * BUCKETS + bucket[some], minlength=rows * BUCKETS).reshape(rows, BUCKETS)
                size = counts.sum(axis=1)
                out[at:at + rows, :WIDTH] = (counts.astype(np.float32) @ vectors) / np.maximum(1, size)[:, None]
                out[at:at + rows, WIDTH] = np.log1p(size)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([v.tobytes() for v in out], pa.binary())], ["doc_id", "vector"])
    return run


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(-1, WIDTH + 1).astype(np.float64)


# --- the network ---------------------------------------------------------------

def logits(model: dict, x: np.ndarray) -> np.ndarray:
    hidden = np.maximum(0, (x - model["mean"]) / model["scale"] @ model["w1"] + model["b1"])
    return (hidden @ model["w2"] + model["b2"]) / model["temperature"]


def train(x: np.ndarray, y: np.ndarray, seed: int = 5) -> dict:
    """Two layers by Adam on four fifths, the temperature on the rest."""
    rng = np.random.default_rng(seed)
    aside = np.arange(len(x)) % 5 == 4
    model = {"mean": x.mean(axis=0), "scale": x.std(axis=0) + 1e-6, "temperature": 1.0}
    p = {"w1": rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN),
         "w2": rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), "b2": np.zeros(())}
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    fx, fy = ((x - model["mean"]) / model["scale"])[~aside], y[~aside]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(fx))
        for at in range(0, len(fx), 128):
            i = order[at:at + 128]
            hidden = np.maximum(0, fx[i] @ p["w1"] + p["b1"])
            error = (1 / (1 + np.exp(-np.clip(hidden @ p["w2"] + p["b2"], -30, 30))) - fy[i]) / len(i)
            back = np.outer(error, p["w2"]) * (hidden > 0)
            grad = {"w1": fx[i].T @ back + 1e-4 * p["w1"], "b1": back.sum(axis=0), "w2": hidden.T @ error + 1e-4 * p["w2"], "b2": error.sum()}
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                p[k] = p[k] - 0.003 * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model |= p
    if aside.any():
        z, t = logits(model, x[aside]), y[aside]
        loss = lambda c: np.logaddexp(0, np.where(t > 0, -z, z) / c).mean()
        model["temperature"] = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return model


def _scored(model: dict):
    def run(batches):
        for batch in batches:
            z = logits(model, _matrix(batch.column("vector").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])
    return run


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    vectors = context_vectors(docs)
    pooled = keep(map_arrow(docs.select("doc_id", "text"), _pooled(vectors), "doc_id long, vector binary"), "document-vectors")
    rows = F.broadcast(labelled_sample(labels, "quality", sample, FOLDS, HELD_OUT))  # bounded by ``sample``
    seen = pooled.join(rows, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "label").toPandas()
    y = seen["label"].to_numpy(float)
    if len(set(y)) < 2:
        scored = pooled.select("doc_id", F.lit(float(y.mean()) if len(y) else 0.5).alias("score"))
    else:
        scored = map_arrow(pooled, _scored(train(_matrix(seen["vector"]), y)), "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
