"""The secret network's cheap pass in whole numbers: bounds hold, findings and gradients are those of exact scores."""

import numpy as np
import pyarrow as pa
import pytest

from ledgerscope.llm import secret_scan

from .test_secret_network import _plain, _random


def _texts(n=40):
    rng = np.random.default_rng(51)
    key = lambda: f' token = "{_random(rng, list("0123456789abcdef"), 30, 90)}" '
    odd = ["", "é" * 40 + "k1" * 60, "a", "\0\t\n" + "0" * 23 + "g" + "0" * 24, "\U0001f600 secret:abc_def-ghi/" + "AKIA" + "A1" * 40]
    return odd + [" ".join(_plain(rng) for _ in range(80)) + key() + " ".join(_plain(rng) for _ in range(20)) for _ in range(n)]


def _net(seed, scale=0.3, shift=-3.0):
    rng = np.random.default_rng(seed)
    return {"conv": rng.normal(0, scale, (secret_scan.REACH, secret_scan.CODES, secret_scan.FILTERS)), "bias": rng.normal(0, scale, secret_scan.FILTERS),
            "out": rng.normal(0, scale, secret_scan.PARTS * secret_scan.FILTERS), "shift": shift, "slope": 1.3, "offset": 0.2}


def _exact(net, c):
    return secret_scan._forward(net, c.windows(np.arange(len(c.w0))).astype(np.int64))[0]


@pytest.mark.parametrize("scale", [0.0, 0.01, 0.3, 30.0])
def test_bounds_hold_exact_scores(scale):
    net, c = _net(52, scale), secret_scan._Candidates(_texts())
    low, high = secret_scan._bounds(secret_scan._in_units(net), c)
    exact = _exact(net, c)
    assert ((low <= exact) & (exact <= high)).all()
    assert (high - low).max() <= 0.01 * max(1e-3, exact.max() - exact.min())


@pytest.mark.parametrize("slope", [1.3, -0.7, 0.0])
def test_hits_are_those_of_exact_scores(slope, monkeypatch):
    net, c = _net(53) | {"slope": slope}, secret_scan._Candidates(_texts())
    p = np.maximum.reduceat(secret_scan._calibrated(net, _exact(net, c)), c.first)
    seen, forward = [], secret_scan._forward
    monkeypatch.setattr(secret_scan, "_forward", lambda net, rows: (seen.append(len(rows)), forward(net, rows))[1])
    for threshold in (np.sort(p)[-20], 2.0):  # one that a candidate just reaches, one out of reach
        net["threshold"] = float(threshold)
        assert secret_scan._hits(net, secret_scan._in_units(net), c).tolist() == np.flatnonzero(c.free & (p >= threshold)).tolist()
    assert slope == 0 or sum(seen) <= 0.05 * len(c.w0)  # few windows are scored twice


def test_sums_leave_out_no_gradient():
    net, texts = _net(54, shift=-4.0), _texts()
    c = secret_scan._Candidates(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    got = next(iter(secret_scan._sums_unknown(net)([batch])))
    kind = c.keylike()[c.of]
    for k, n, sums in zip(*(got.column(x).to_pylist() for x in ("kind", "n", "sums"))):
        some = np.flatnonzero(c.free[c.of] & (kind == k))
        whole = secret_scan._gradient(net, c.windows(some).astype(np.int64), 0.0)
        assert n == len(some) and whole.any() and (np.frombuffer(sums, np.int64) == whole).all()


def test_hex_runs_are_found_in_every_place():
    texts = [f"{'x' * i} {'0a' * 12}{'z' * j} {'b' * 23}" for i in range(7) for j in range(4)] + ["c" * 23 + " " + "d" * 23, "é" + "f" * 24]
    assert secret_scan._Candidates(texts).founds == [secret_scan._found(t) for t in texts]
