"""Repeated rows and ids, and the corpus pipeline's stages against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerscope.llm import mixing, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)


# --- op10 ------------------------------------------------------------------------

def _without_repeats(rows):
    """(doc_id, n_bytes, n_removed, n_spans, sha) by the rule."""
    starts = defaultdict(lambda: 1 << 62)
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            if i is not None:
                starts[b[k:k + 50]] = min(starts[b[k:k + 50]], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 49):
            if i is not None and starts[b[k:k + 50]] < i:
                gone[k:k + 50] = True
        left = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return Counter(out)


def _passages(rng, n):
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(60)]
    return [" ".join(rng.choice(words, 40)) for _ in range(n)]


@pytest.mark.parametrize("shard", [None, 8])
def test_suffix_dedup_of_repeated_ids(spark, monkeypatch, shard):
    rng = np.random.default_rng(12)
    if shard:  # frequent anchors lie in several blocks, merged pair by pair
        monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    shared = _passages(rng, 6)
    text = lambda: " ".join(_passages(rng, 1) + [shared[k] for k in rng.integers(0, 6, 2)] + _passages(rng, 1))
    rows = [(int(i), text()) for i in range(30)]
    rows += [(3, text()), (3, text()), (7, rows[7][1]), (7, rows[7][1]), (40, rows[2][1]), (40, text()), (None, shared[0] * 2), (41, None), (42, "")]
    rows += [(50 + k, "".join(rng.choice(list("xy"), 15)) + shared[1] + "".join(rng.choice(list("xy"), 15))) for k in range(40)]  # one anchor, many stretches
    got = suffix_dedup.suffix_dedup(_docs(spark, [(i, t, "s") for i, t in rows])).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == _without_repeats(rows)


# --- op9 -------------------------------------------------------------------------

def _targets(rows):
    """Words per source and its target by the rule."""
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    total, full = sum(size.values()), set()
    while True:
        left, w = total - sum(3 * size[s] for s in full), sum(weight[s] for s in order if s not in full)
        above = {s for s in order if s not in full and w and left * weight[s] / w > 3 * size[s]}
        if not above:
            return size, {s: 3.0 * size[s] if s in full else left * weight[s] / w for s in order}
        full |= above


def test_mix_of_repeated_rows(spark):
    rng = np.random.default_rng(3)
    words = lambda n: " ".join(rng.choice(["one", "two", "three"], n))
    rows = [(i, words(int(rng.integers(1, 60))), f"s{i % 4}") for i in range(80)] + [(200, words(30), None), (201, None, "s1"), (202, "", "s9")]
    rows += [rows[5]] * 3 + [(6, "another text", "s2"), (None, "x y z", "s0"), (None, "x y z", "s0")]
    docs = _docs(spark, rows)
    size, target = _targets(rows)
    plan = mixing.source_mix(docs).collect()
    assert len(plan) == len(rows) and all(r.taken <= 3 * r.size for r in plan)
    for r in plan:
        assert any(abs(r.target - target[s]) < 1e-6 and r.source_size == size[s] for s in size)
    mixed = mixing.mixed_documents(docs).collect()
    copies, given = Counter((r.doc_id, r.text, r.source) for r in mixed), Counter(rows)
    assert set(copies) <= set(given)
    assert all(n <= 3 * given[row] for row, n in copies.items())
    for s in size:
        taken = sum(len((t or "").split()) * n for (_, t, of), n in copies.items() if of == s)
        longest = max(len((t or "").split()) for _, t, of in rows if of == s)
        assert abs(taken - target[s]) <= longest + 1


# --- the pipeline ----------------------------------------------------------------

@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small corpus with planted copies and labels, as a folder of tables."""
    rng = np.random.default_rng(8)
    clean = ["".join(rng.choice(list("bcdfghklmnprst"), 1)) + "".join(rng.choice(list("aeiou"), 1)) for _ in range(400)]
    vocabulary = sorted({a + b for a in clean[:40] for b in clean[40:60]})
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    rows = [(i, text(int(rng.integers(30, 120))), f"src{i % 3}") for i in range(150)]
    rows += [(200 + i, rows[i][1].replace(" ", "  " if i % 2 else "\n"), "src1") for i in range(20)]  # copies but for white space
    rows += [(300 + i, rows[i][1] + " " + text(2), "src2") for i in range(30, 45)]  # near copies
    rows += [(400 + i, text(40) + " frackwit blorgen " * 3 + text(20), "src0") for i in range(40)]
    rows += [(500, None, None), (501, "", "src0"), rows[3], (502, "kept word", "src1")]
    folder = str(tmp_path_factory.mktemp("corpus"))
    _docs(spark, rows).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(400 <= i < 500)) for i, _, _ in rows if i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def _rows(df):
    return sorted(((r.doc_id, r.text, r.source) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2] or ""))


def _exact(rows):
    first = {}
    for r in rows:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")
        if key not in first or r[0] < first[key][0]:
            first[key] = r
    return sorted(first.values())


def _near(rows):
    sets = {}
    for i, t, _ in rows:
        w = [x.decode() if isinstance(x, bytes) else x for x in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted(r for r in rows if find(r[0]) == r[0])


def test_pipeline_stages_by_brute_force(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    bad = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
    assert {i for i, _, _ in rows if 400 <= i < 500} <= bad and not any(i < 400 for i in bad)  # the planted ones, labelled or not
    clean = stage["toxicity"](spark, docs, folder)
    assert _rows(clean) == sorted((r for r in rows if r[0] not in bad), key=lambda r: (r[0], r[1] or "", r[2] or ""))
    once = stage["exact_dedup"](spark, clean, folder)
    assert _rows(once) == _exact(_rows(clean))
    apart = stage["minhash_near_dedup"](spark, once, folder)
    assert _rows(apart) == _near(_rows(once)) and len(_rows(apart)) < len(_rows(once))
    mixed = stage["source_mixing"](spark, apart, folder)
    assert mixed.columns == docs.columns
    size, target = _targets(_rows(apart))
    for s in size:
        taken = sum(len((t or "").split()) for _, t, of in _rows(mixed) if of == s)
        assert abs(taken - target[s]) <= 121
    packed = stage["best_fit_packing"](spark, mixed, folder)
    _check_packing(_rows(mixed), packed)


def _check_packing(rows, packed):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = Counter((i, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, _ in rows)
    pieces = packed.collect()
    assert Counter((r.doc_id, r.length) for r in pieces) == tokens  # no text here is longer than a sequence
    by_sequence = defaultdict(list)
    for r in pieces:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) <= -(-sum(r.length for r in pieces) // 2048) + 1


def test_run_is_its_stages(spark, corpus):
    folder, rows = corpus
    whole = corpus_pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, folder)
    _check_packing(_rows(docs), whole)


def test_run_on_empty_tables(spark, tmp_path):
    _docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
