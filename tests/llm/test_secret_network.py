"""The secret network on kinds of secrets that its training never saw."""

import numpy as np
import pytest

from ledgerscope.llm import secret_scan

ALNUM = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


def _word(rng):
    return "".join(rng.choice(["an", "re", "th", "ing", "tion", "er", "mo", "ka", "li", "be", "so", "du"], rng.integers(1, 6)))


def _plain(rng):
    """Words, numbers, addresses and names as texts have them."""
    n = lambda a, b: str(rng.integers(a, b))
    forms = [lambda: _word(rng), lambda: _word(rng).capitalize(), lambda: _word(rng).upper(), lambda: n(10, 10**6), lambda: n(10**14, 10**16),
             lambda: ".".join(n(0, 255) for _ in range(4)), lambda: f"{_word(rng)}.{n(1, 99)}", lambda: f"mail{n(1, 9)}.{_word(rng)}.com",
             lambda: f"//{_word(rng)}.org/{_word(rng)}/{_word(rng)}", lambda: f"20{n(10, 30)}-0{n(1, 9)}-{n(10, 28)}", lambda: f"{_word(rng)}-{_word(rng)}"]
    return forms[rng.integers(0, len(forms))]()


def _random(rng, letters, low, high):
    return "".join(rng.choice(letters, rng.integers(low, high)))


def _window(rng, value, keyword=""):
    before = " ".join(_plain(rng) for _ in range(4)) + " " + keyword
    text = before + value + ('"' if keyword else "") + " " + _plain(rng) + " " + _plain(rng)
    return secret_scan._window(text, len(before), len(before) + len(value))


@pytest.fixture(scope="module")
def net():
    """Trained on lower-case hex behind one keyword only."""
    rng = np.random.default_rng(31)
    known = [_window(rng, _random(rng, list("0123456789abcdef"), 32, 41), 'token = "') for _ in range(150)]
    others = [_window(rng, _plain(rng)) for _ in range(3000)]
    return secret_scan.train(known + others, np.array([True] * len(known) + [False] * len(others)))


@pytest.mark.parametrize("kind", ["access", "prefixed", "mixed", "capital hex"])
def test_kinds_held_out_of_the_training(net, kind):
    rng = np.random.default_rng(32)
    make = {"access": lambda: "AKIA" + _random(rng, ALNUM[:26] + ALNUM[52:], 16, 17), "prefixed": lambda: "ghp_" + _random(rng, ALNUM, 36, 37),
            "mixed": lambda: _random(rng, ALNUM, 24, 41), "capital hex": lambda: _random(rng, list("0123456789ABCDEF"), 32, 65)}[kind]
    found = secret_scan.probability(net, [_window(rng, make()) for _ in range(300)]) >= net["threshold"]
    assert found.mean() >= 0.9


def test_plain_candidates_are_left_alone(net):
    rng = np.random.default_rng(33)
    found = secret_scan.probability(net, [_window(rng, _plain(rng)) for _ in range(4000)]) >= net["threshold"]
    assert found.mean() <= 0.002


def test_calibration_stays_finite():
    z, t = np.array([-9.0] * 50 + [9.0] * 50), np.array([0.0] * 50 + [1.0] * 50)  # classes apart
    slope, offset = secret_scan._logistic_fit(z, t)
    assert 0 < slope < 1 and abs(offset) < 1
    noisy = np.random.default_rng(1).normal(size=2000)
    slope, offset = secret_scan._logistic_fit(noisy, (np.random.default_rng(2).random(2000) < 1 / (1 + np.exp(-2 * noisy))).astype(float))
    assert slope == pytest.approx(2, abs=0.3) and offset == pytest.approx(0, abs=0.2)


def test_findings_beyond_the_patterns(spark):
    rng = np.random.default_rng(34)
    text = lambda: " ".join(_plain(rng) for _ in range(60))
    key = "sk_" + _random(rng, ALNUM, 40, 41)
    rows = [(i, f'{text()} token = "{_random(rng, list("0123456789abcdef"), 40, 41)}" {text()}') for i in range(90)]
    rows += [(100, f"{text()} {key} {text()}"), (101, text())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in secret_scan.secret_scan(docs).collect()}
    at = rows[90][1].index(key)
    assert f"model:{at}:{at + len(key)}" in got[100].spans.split(",") and got[100].n_hex == 0
    added = sum(s.startswith("model") for r in got.values() for s in r.spans.split(","))
    assert added <= 3
    # too few known secrets to learn from: the patterns' findings only
    few = docs.where(f"doc_id < {secret_scan.LEAST_KNOWN - 5} or doc_id >= 100")
    assert all("model" not in r.spans for r in secret_scan.secret_scan(few).collect())
