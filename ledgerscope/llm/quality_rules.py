"""Quality rules as a learned decision list.

Statistics of every whole text are counted first.  From a bounded sample of
labelled rows, sequential covering learns an ordered list of conjunctions of
thresholds that say "drop": a rule grows condition by condition on two thirds
of the sample (FOIL's gain), is pruned on the other third, and what it covers
is set aside for the next.  A rule stays only if it is right on nearly all it
covers, so clean documents are left alone.  The list becomes one chain of
Spark conditional expressions over the statistics.

Defined results: null text has no words; a text without words fails the base
rules; without labels of both classes the list is empty and the base rules
decide; labels that are null are not read; rows that repeat a doc_id are rows
of their own; a null doc_id is kept as it is; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.common import keep, map_arrow, pieces_of, text_bytes
from ledgerscope.llm.textscan import joined, running, span_hash, windows, words

SAMPLE, MAX_RULES, MAX_CONDITIONS = 20_000, 16, 4
FOLDS, HELD_OUT = 4, 2
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_exclaim", "n_distinct", "n_echo"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _again(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which items equal an earlier item of their text, and which equal any other."""
    order = np.lexsort((hashes, owner))
    same = (np.diff(owner[order]) == 0) & (hashes[order][1:] == hashes[order][:-1])
    later, other = np.zeros(len(owner), bool), np.zeros(len(owner), bool)
    later[order[1:]] = same
    other[order[1:]] = same
    other[order[:-1]] |= same
    return later, other


def text_counts(texts: list[bytes]) -> list[np.ndarray]:
    """``COUNTS`` of each text."""
    n = len(texts)
    buf, starts = joined(texts)
    begin, end, bounds = words(buf, starts)
    n_words = np.diff(bounds)
    owner = np.repeat(np.arange(n), n_words)
    sums = running(buf)
    hashes = span_hash(sums, begin, end)
    shown = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    chars = shown[end] - shown[begin]
    # lines with a word
    newline = np.flatnonzero(buf == 10)
    lines = np.sort(np.concatenate((starts[:-1], newline + 1)))
    line_end = np.concatenate((lines[1:], [len(buf)])) - 1  # without the newline or the space after the text
    has_word = np.searchsorted(begin, line_end) > np.searchsorted(begin, lines)
    lines, line_end = lines[has_word], line_end[has_word]
    line_owner = np.searchsorted(starts, lines, side="right") - 1
    dup, _ = _again(line_owner, span_hash(sums, lines, line_end))
    # words in repeated windows of five
    runs, offsets = windows(hashes, bounds, 5)
    run_owner = np.repeat(np.arange(n), np.diff(offsets))
    _, repeated = _again(run_owner, runs)
    first = np.flatnonzero(repeated) - offsets[run_owner[repeated]] + bounds[run_owner[repeated]]
    change = np.zeros(len(hashes) + 6, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + 5, -1)
    covered = np.cumsum(change)[: len(hashes)] > 0
    seen, _ = _again(owner, hashes)
    echo = np.zeros(len(hashes), bool)
    echo[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    return [n_words, _per_text(chars, bounds), _per_text(_SYMBOL[buf], starts), np.bincount(line_owner[dup], minlength=n),
            _per_text(covered, bounds), _per_text((buf >= 65) & (buf <= 90), starts), _per_text(buf == 33, starts),
            _per_text(~seen, bounds), _per_text(echo, bounds)]


def _counted(batches):
    for part in pieces_of(batches):
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c.astype(np.int64)) for c in text_counts(text_bytes(part.column("text"))))],
                                         ["doc_id", *COUNTS])


def statistics() -> dict[str, Column]:
    """What rules may ask about, from the counts."""
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {"symbols_per_word": ratio("n_symbols", "n_words"), "upper_share": ratio("n_upper", "word_chars"),
            "exclaims_per_word": ratio("n_exclaim", "n_words"), "repeat_share": ratio("n_repeat_words", "n_words"),
            "distinct_share": ratio("n_distinct", "n_words"), "echo_share": ratio("n_echo", "n_words"),
            "word_length": ratio("word_chars", "n_words"), "words": F.col("n_words").cast("double"),
            "dup_lines": F.col("n_dup_lines").cast("double")}


# --- learning ------------------------------------------------------------------

def _covers(rule: list[tuple[int, bool, float]], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for feature, above, cut in rule:
        out &= (x[:, feature] >= cut) if above else (x[:, feature] <= cut)
    return out


def _grow(x: np.ndarray, bad: np.ndarray) -> list[tuple[int, bool, float]]:
    rule: list[tuple[int, bool, float]] = []
    inside = np.ones(len(x), bool)
    while len(rule) < MAX_CONDITIONS and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        best, chosen = 0.0, None
        for f in range(x.shape[1]):
            order = np.argsort(x[inside, f], kind="stable")
            values, hits = x[inside, f][order], bad[inside][order]
            ends = np.flatnonzero(np.diff(values)) + 1  # thresholds lie between two values
            if not len(ends):
                continue
            below = np.concatenate(([0], np.cumsum(hits)))[ends]
            for above, p, n in ((False, below, ends - below), (True, p0 - below, len(values) - ends - (p0 - below))):
                gain = p * (np.log2((p + 1e-9) / (p + n + 1e-9)) - np.log2(p0 / (p0 + n0)))
                k = int(gain.argmax())
                if gain[k] > best:
                    best, chosen = gain[k], (f, above, float((values[ends[k] - 1] + values[ends[k]]) / 2))
        if chosen is None:
            break
        rule.append(chosen)
        inside &= _covers([chosen], x)
    return rule


def _prune(rule: list, x: np.ndarray, bad: np.ndarray) -> list:
    def worth(r):
        inside = _covers(r, x)
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0
    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn(x: np.ndarray, bad: np.ndarray, precision: float = 0.97) -> list[list[tuple[int, bool, float]]]:
    """The ordered rules for rows to drop; ``x`` in a random but fixed order."""
    prune = np.arange(len(x)) % 3 == 2
    rules, left = [], np.ones(len(x), bool)
    while len(rules) < MAX_RULES:
        grow_at, prune_at = left & ~prune, left & prune
        if (grow_at & bad).sum() < 2 or not (grow_at & ~bad).any():
            break
        rule = _prune(_grow(x[grow_at], bad[grow_at]), x[prune_at], bad[prune_at])
        inside = _covers(rule, x) & left
        right = (inside & bad).sum()
        if not rule or right < 2 or right < precision * inside.sum():
            break
        rules.append(rule)
        left &= ~inside
    return rules


def decision(rules: list[list[tuple[int, bool, float]]]) -> Column:
    """The list as ordered conditions: false at the first rule that holds."""
    columns = list(statistics().values())
    chain = F.when(F.lit(False), False)
    for rule in rules:
        condition = F.lit(True)
        for feature, above, cut in rule:
            condition = condition & ((columns[feature] >= cut) if above else (columns[feature] <= cut))
        chain = chain.when(condition, False)
    return chain.otherwise(True)


def labelled_sample(labels: DataFrame, label: str, sample: int, folds: int, held_out: int) -> DataFrame:
    """At most ``sample`` labelled rows outside the held-out fold, in hash order."""
    outside = F.crc32(F.col("doc_id").cast("string")) % folds != held_out
    return (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & outside)
            .select("doc_id", F.col(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample))


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, the five base counts, base_failed and kept for every row."""
    counts = keep(map_arrow(docs.select("doc_id", "text"), _counted, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)), "text-counts")
    rows = F.broadcast(labelled_sample(labels, "quality", sample, FOLDS, HELD_OUT))  # bounded by ``sample``
    seen = (counts.join(rows, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id")
            .select(*[c.alias(n) for n, c in statistics().items()], "label").toPandas())
    x, label = seen[list(statistics())].to_numpy(float), seen["label"].to_numpy()
    rules = learn(x, label == 0) if len(seen) else []
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (counts.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & decision(rules))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))
