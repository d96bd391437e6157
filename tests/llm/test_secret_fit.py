"""The secret network is fitted on all candidates, not on the start's sample alone."""

import numpy as np

from ledgerscope.llm import secret_scan

from .test_secret_network import ALNUM, _plain, _random


def _hex(rng):
    return _random(rng, list("0123456789abcdef"), 40, 41)


def test_known_secrets_are_counted_beyond_the_sample(spark):
    rng = np.random.default_rng(41)
    text = lambda: " ".join(_plain(rng) for _ in range(60))
    rows = [(i, f'{text()} token = "{_hex(rng)}" {text()}') for i in range(120)]
    key = "sk_" + _random(rng, ALNUM, 40, 41)
    rows.append((200, f"{text()} {key} {text()}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secret_scan.secret_scan(docs, sample=160).collect()}  # 40 known ones in the sample
    at = rows[-1][1].index(key)
    assert f"model:{at}:{at + len(key)}" in got[200].split(",")


def test_each_candidate_is_read_once(spark, monkeypatch):
    rng = np.random.default_rng(42)
    texts = [" ".join(_plain(rng) for _ in range(40)) + f' token = "{_hex(rng)}"' for _ in range(100)]
    n, added = [], secret_scan._calibrate
    monkeypatch.setattr(secret_scan, "_step", lambda net, size, some, known, others, step: n.extend(r.text for r in some.collect()))
    monkeypatch.setattr(secret_scan, "_calibrate", lambda net, some, known, others: (n.extend(r.text for r in some.collect()), added(net, some, known, others)))
    net = secret_scan._fitted(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), 40)
    assert sorted(n) == sorted(texts) and 0 < net["threshold"] < 1


def test_gradient_of_all_is_exact(spark):
    rng = np.random.default_rng(43)
    net = {"conv": rng.normal(0, 0.3, (secret_scan.REACH, secret_scan.CODES, secret_scan.FILTERS)), "bias": np.zeros(secret_scan.FILTERS),
           "out": rng.normal(0, 0.3, secret_scan.PARTS * secret_scan.FILTERS), "shift": 0.0}
    texts = [" ".join(_plain(rng) for _ in range(30)) for _ in range(20)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    sums = []
    for parts in (1, 5):
        rows = secret_scan.map_arrow(docs.repartition(parts), secret_scan._sums_unknown(net), secret_scan._SUMS).collect()
        sums.append({k: sum(np.frombuffer(r["sums"], np.int64) for r in rows if r["kind"] == k) for k in (0, 1)})
    assert all((sums[0][k] == sums[1][k]).all() for k in (0, 1)) and sums[0][0].any()
    c = secret_scan._Candidates(texts, [secret_scan._found(t) for t in texts])
    codes = c.windows(np.arange(len(c.w0))).astype(np.int64)

    def loss(out):  # the loss whose slope is cut off at 1
        over = secret_scan._forward(net | {"out": out}, codes)[0] + secret_scan.MARGIN
        return np.where(over > 1, over - 0.5, np.maximum(0, over) ** 2 / 2).sum()

    way, at = rng.normal(size=net["out"].shape), -1 - net["out"].size
    slope = (loss(net["out"] + 1e-6 * way) - loss(net["out"] - 1e-6 * way)) / 2e-6
    whole = (sums[0][0] + sums[0][1])[at:-1] * secret_scan.UNIT
    assert np.isclose(whole @ way, slope, rtol=1e-4)
