"""Sharding, spelling variants and hard negatives against brute force."""

import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerscope.llm import hard_negatives, sharding, spelling

SCHEMA = "doc_id long, text string, lang string, source string, shard int, size string, word string"


def _table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 7, "x", "y") for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- sharding ------------------------------------------------------------------

def _plain_best_fit(sizes, capacity):
    left, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(r, s) for s, r in enumerate(left) if r >= sizes[i]]
        if fits:
            s = min(fits)[1]
        else:
            s = len(left)
            left.append(max(capacity, sizes[i]))
        left[s] -= sizes[i]
        out[i] = s
    return out


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_is_the_plain_one(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 100 if seed % 2 else 1000, 700).tolist()
    for capacity in (60, 1000, 1500):
        assert sharding.best_fit_decreasing(sizes, capacity) == _plain_best_fit(sizes, capacity)


def test_tree_stays_balanced():
    tree, keys = sharding.Capacities(), set()
    rng = np.random.default_rng(8)
    for i in range(4000):
        key = (int(rng.integers(0, 50)), i)
        tree.add(key)
        keys.add(key)
        if i % 3 == 0:
            gone = sorted(keys)[int(rng.integers(0, len(keys)))]
            tree.remove(gone)
            keys.remove(gone)
        if i % 100 == 0:
            for size in (0, 10, 49, 50):
                assert tree.tightest(size) == min((k for k in keys if k[0] >= size), default=None)
    depth = lambda t: 0 if t is None else 1 + max(depth(t[2]), depth(t[3]))
    assert depth(tree.root) <= 2 * len(keys).bit_length()


def test_level_shards_are_near_the_bound():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 5000, 3000).tolist()
    load = Counter()
    for size, s in zip(sizes, sharding.level_shards(sizes, 8)):
        load[s] += size
    assert len(load) == 8 and max(load.values()) <= 1.002 * sum(sizes) / 8 and min(load.values()) >= 0.99 * sum(sizes) / 8
    assert sorted(sharding.level_shards([10, 10, 10], 2)) == [0, 0, 1]
    assert sharding.level_shards([100, 1, 1, 1], 3)[0] not in sharding.level_shards([100, 1, 1, 1], 3)[1:]


TEXTS = [None, "", "a", "tök", "b" * 300, "b" * 300, "long " * 400, *("copy of one" for _ in range(40)),
         *(f"text {i} " * (i % 13 + 1) for i in range(300))]


def _check_shards(rows, texts, shards, whole=True):
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((i is None, i or 0) for i, _ in texts)
    size = {i: len((t or "").encode()) + 1 for i, t in texts}
    by_shard, by_text = defaultdict(list), defaultdict(set)
    text = dict(texts)
    for r in rows:
        assert r["size"] == size[r.doc_id] and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode())
        assert r.law == "bytes" and r.grown_shard is None and (shards is None or 0 <= r.shard < shards)
        by_shard[r.shard].append(r)
        by_text[text[r.doc_id] or ""].add(r.shard)
    for own in by_shard.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    assert not whole or all(len(s) == 1 for s in by_text.values())
    return {s: sum(r["size"] for r in own) for s, own in by_shard.items()}


def test_shard_rows(spark, empty):
    texts = list(enumerate(TEXTS)) + [(None, "no id")]
    load = _check_shards(sharding.shard_rows(_table(spark, texts), shards=8).collect(), texts, 8)
    fair = sum(load.values()) / 8
    assert len(load) == 8 and max(load.values()) <= 1.02 * fair and min(load.values()) >= 0.95 * fair
    sizes = defaultdict(int)
    for _, t in texts:
        sizes[t or ""] += len((t or "").encode()) + 1
    load = _check_shards(sharding.shard_rows(_table(spark, texts), capacity=2500).collect(), texts, None)
    assert max(load.values()) <= 2500
    assert len(load) <= max(_plain_best_fit(list(sizes.values()), 2500)) + 2  # items of a few small groups
    assert sharding.shard_rows(empty, shards=8).count() == 0 and sharding.shard_rows(empty, capacity=5).count() == 0


def test_a_group_above_a_shard_is_divided(spark):
    texts = [(i, "the same text again") for i in range(400)] + [(1000 + i, f"other {i}") for i in range(300)]
    load = _check_shards(sharding.shard_rows(_table(spark, texts), shards=8).collect(), texts, 8, whole=False)
    assert max(load.values()) <= 1.05 * sum(load.values()) / 8
    repeated = [(5, "one row, many times")] * 60 + [(6, "x"), (6, "y")]
    rows = sharding.shard_rows(_table(spark, repeated), shards=3).collect()
    assert len(rows) == 62 and len({r.shard for r in rows if r["size"] > 2}) == 1


def test_written_shards_hold_the_rows(spark, tmp_path):
    texts = list(enumerate(TEXTS))
    sharding.write_shards(_table(spark, texts), str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted(texts, key=lambda x: x[0])
    assert {r.shard for r in back.collect()} == {0, 1, 2, 3} and back.where("shard_given = 7").count() == len(texts)


# --- spelling variants -----------------------------------------------------------

def _word_counts(texts):
    counts = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def _one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)):] == b[k + (len(b) >= len(a)):]


def _groups(counts):
    near = {w: [] for w in counts}
    for a, b in itertools.combinations(counts, 2):
        if _one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w in counts:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    rows = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, n, len(near[w]), None if form[w] is None else counts[form[w]]))
    return rows


def _random_texts(seed, n, letters="abcÀé"):
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list(letters), rng.integers(4, 9))) for _ in range(260)]
    vocabulary += ["aaaaa" + "a" * i for i in range(6)] + ["x" * 300, "x" * 301, "x" * 150 + "y" + "x" * 150]
    sep = [" ", "-", "1", ", "]
    return [(int(i), "".join(str(rng.choice(vocabulary)) + sep[rng.integers(0, 4)] for _ in range(70)).replace("a", "A", int(rng.integers(0, 3))))
            for i in range(n)]


@pytest.mark.parametrize("per_copy", [spelling.PER_COPY, 20])
def test_spelling_groups(spark, per_copy):
    texts = _random_texts(3, 60) + [(None, "Hellos hellos hellos helloß"), (0, None), (1, ""), (7, "word word"), (7, "hellos")]
    texts += [(9000, "mossen " * 20 + "mossenx " * 8 + "mossenxy " * 3)]  # forms in a chain
    found = [tuple(r) for r in spelling.spelling_groups(_table(spark, texts), per_copy).collect()]
    counts = _word_counts(texts)
    assert len(found) == len(counts) > 200
    assert set(found) == _groups(counts)
    assert any(f is not None for _, f, *_ in found) and any(r != f and f is not None for _, f, r, *_ in found)


def test_spelling_of_nothing(spark, empty):
    assert spelling.spelling_groups(empty).count() == 0
    assert spelling.spelling_groups(_table(spark, [(1, "a b c"), (2, None)])).count() == 0


# --- hard negatives ----------------------------------------------------------------

@pytest.mark.parametrize("shape", [(1, 1, 1), (7, 64, 3), (130, 65, 97), (128, 128, 128), (33, 200, 310)])
def test_strassen_is_the_product(shape):
    m, k, n = shape
    rng = np.random.default_rng(m)
    a, b = rng.integers(-2**26, 2**26, (m, k)), rng.integers(-2**26, 2**26, (k, n))
    for leaf in (2, 16, 64):
        assert np.array_equal(hard_negatives.strassen(a, b, leaf), a @ b)


def _mined(rows):
    data = []
    for vec_id, label, v in rows:
        if vec_id is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        data.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = set()
    for a, la, va in data:
        if a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(va, v)), i, la == lb) for i, lb, v in data if i != a]
        for s, p, _ in sorted(x for x in scored if x[2])[:5]:
            window = sorted(x for x in scored if not x[2] and 30 * -s <= 100 * -x[0] <= 90 * -s)[:10]
            out |= {(a, p, k, i, -s, -n) for k, (n, i, _) in enumerate(window, 1)}
    return out


@pytest.mark.parametrize("tiles", [(512, 2048), (3, 40)])
def test_hard_negatives(spark, tiles):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(0, 3)), rng.normal(0.1, 0.3, 6).tolist()) for i in range(600)]
    rows += [(1000 + i, 1, [0.5, 0.25, 0.0, 0.0, 0.125, 0.0]) for i in range(120)]  # equal vectors
    rows += [(2000, None, [1.0] * 6), (2100, 1, None), (2200, 1, [1.0, None]), (2300, 2, [float("nan")] * 6), (2400, 2, [float("inf")] * 6),
             (2500, 2, []), (2600, 1, [0.5, 0.5]), (None, 1, [1.0] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "'x' as rank", "1 as row")
    found = [tuple(r) for r in hard_negatives.hard_negatives(table, anchor_tile=tiles[0], candidate_tile=tiles[1]).collect()]
    assert len(found) == len(set(found)) > 100 and set(found) == _mined(rows)


def test_hard_negatives_edges(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert hard_negatives.hard_negatives(spark.createDataFrame([], schema)).count() == 0
    assert hard_negatives.hard_negatives(spark.createDataFrame([(100, 1, [1.0]), (3, None, None)], schema)).count() == 0
    with pytest.raises(Exception, match="too large"):
        hard_negatives.hard_negatives(spark.createDataFrame([(100, 1, [1e30]), (3, 1, [1.0])], schema)).count()
    twice = spark.createDataFrame([(100, 1, [1.0]), (100, 1, [1.0]), (3, 1, [1.0]), (5, 2, [0.5])], schema)
    assert hard_negatives.hard_negatives(twice).count() == 4  # each copy: the other copy and 3 are its positives
