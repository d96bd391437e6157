"""Toxicity by a learned weighted lexicon.

Texts are folded first: compatibility forms, lower case, look-alike letters of
other scripts, digits and symbols that stand for letters, invisible marks.
The lexicon (whole words, and stems that begin a word) is learned from a
bounded sample of labelled texts: log-odds of document frequencies, where near
copies count as one text (or the rare words of a copied text would pass for toxic
ones), and the phrases around a word that occur in clean texts mostly become exceptions.  One
Aho-Corasick automaton matches words, stems and exceptions in one pass; a
match inside an exception does not count.  The weight found, taken by the
text's length, becomes a probability by a logistic curve fitted on the sample.

Labels are read only of rows outside the held-out fold.  The lexicon has at
most ``LEXICON`` entries and the sample at most ``SAMPLE`` rows, so model and
curve are of bounded size; every text is scored whole.

Defined results: null and empty text have no match and get the score of a
text without any; without labels, or without both classes, there is no
lexicon and every score is the share of toxic labels (0 if there are none); a
null doc_id is scored and not held out; repeated rows are scored each; labels
that are null are not read; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.common import keep, map_arrow, pieces_of, ship_package, text_bytes
from ledgerscope.llm.textscan import joined, mix, running, span_hash, windows, words

SAMPLE, LEXICON = 20_000, 2_000
FOLDS, HELD_OUT = 5, 0
STEMS = range(3, 9)
#: hashes of a text's sketch
SKETCH = 16

# fixed values: letters of other scripts that look like Latin ones
LOOKALIKE = dict(zip("аеорсухіѕјкмтвнԁӏһԛԝαεοριντυκχɑɡı", "aeopcyxisjkmtbhdlhqwaeopivtukxagi"))
# fixed values: digits that stand for letters
DIGITS = dict(zip("01345789", "oieastbg"))
INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_TABLE = str.maketrans(LOOKALIKE | DIGITS) | INVISIBLE
_SYMBOL = re.compile(r"(?<=[^\W_])[@$!](?=[^\W_])")
_SYMBOLS = {"@": "a", "$": "s", "!": "i"}
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    text = text.lower().translate(_TABLE)
    if "@" in text or "$" in text or "!" in text:
        text = _SYMBOL.sub(lambda m: _SYMBOLS[m.group()], text)
    return text


class Matcher:
    """Weight of the lexicon found in a text, and the text's length in words."""

    def __init__(self, lexicon: dict[str, float], exceptions: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.lexicon = lexicon
        entries: dict[str, list] = {}
        for entry in lexicon:
            entries.setdefault(entry.rstrip("*"), []).append(entry)
        for phrase in exceptions:
            entries.setdefault(phrase, []).append(None)
        for key, found in entries.items():
            self.automaton.add_word(key, (len(key), found))
        if entries:
            self.automaton.make_automaton()
        self.any = bool(entries)

    def hits(self, folded: str) -> list[tuple[int, int, str]]:
        found, excused = [], []
        if self.any:
            last = len(folded) - 1
            for end, (n, entries) in self.automaton.iter(folded):
                start = end - n + 1
                if start and folded[start - 1].isalnum():
                    continue
                closed = end == last or not folded[end + 1].isalnum()
                for entry in entries:
                    if entry is None:
                        if closed:
                            excused.append((start, end))
                    elif closed or entry[-1] == "*":
                        found.append((start, end, entry))
        if excused:
            found = [h for h in found if not any(s <= h[0] and h[1] <= e for s, e in excused)]
        return found

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Any match; the weight, damped; the weight by the length."""
        if not text:
            return 0.0, 0.0, 0.0
        best: dict[int, float] = {}
        for start, _, entry in self.hits(fold(text)):
            best[start] = max(best.get(start, 0.0), self.lexicon[entry])
        total = sum(best.values())
        return float(total > 0), math.log1p(total), total / math.sqrt(1 + text.count(" "))


def _held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


_MIX = np.random.default_rng(17).integers(1, 2**63, SKETCH, dtype=np.uint64) | np.uint64(1)


def _sketches(batches):
    """Smallest hashes of each text's runs of five words; none of shorter texts."""
    for part in pieces_of(batches, 1 << 20):
        buf, starts = joined(text_bytes(part.column("text")), lower=True)
        begin, end, bounds = words(buf, starts)
        runs, offsets = windows(span_hash(running(buf), begin, end), bounds, 5)
        some = np.flatnonzero(np.diff(offsets))
        least = np.stack([np.minimum.reduceat(mix(runs * m), offsets[some]) for m in _MIX], axis=1) if len(some) else np.zeros((0, SKETCH), np.uint64)
        sketch: list = [None] * part.num_rows
        for i, row in zip(some.tolist(), least):
            sketch[i] = row.tobytes()
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array(sketch, pa.binary())], ["doc_id", "toxic", "sketch"])


def one_of_each(rows: list[tuple[int, int, bytes | None]]) -> list[tuple[int, int]]:
    """(doc_id, toxic) of the smallest doc_id of each group of near copies: rows
    (doc_id, toxic, sketch) of one label whose sketches agree in half their hashes or more."""
    rows = sorted({(d, t): k for d, t, k in rows}.items())
    sketch = [None if k is None else np.frombuffer(k, np.uint64) for _, k in rows]
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first: dict[tuple, int] = {}
    for i, ((_, label), _) in enumerate(rows):
        if sketch[i] is None:
            continue
        for band in range(0, SKETCH, 2):
            j = first.setdefault((label, band, sketch[i][band:band + 2].tobytes()), i)
            if j != i and 2 * (sketch[i] == sketch[j]).sum() >= SKETCH:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [rows[i][0] for i in range(len(rows)) if find(i) == i]


def _word_counts(batches):
    """Texts in which a word or stem occurs, toxic and clean, of this task."""
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            found = set(_WORD.findall(fold(text or "")))
            (toxic if label else clean).update(found | {w[:k] + "*" for w in found for k in STEMS if len(w) > k})
    names = list(toxic.keys() | clean.keys())
    for i in range(0, len(names), 100_000):
        some = names[i:i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([toxic[w] for w in some], pa.int64()),
                                          pa.array([clean[w] for w in some], pa.int64())], ["entry", "t", "c"])


def _phrase_counts(lexicon: dict[str, float]):
    """Phrases of two words around each lexicon word, toxic and clean."""
    def run(batches):
        matcher, toxic, clean = Matcher(lexicon, []), Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                folded = fold(text or "")
                found = set()
                for start, _, _ in matcher.hits(folded):
                    end = _WORD.match(folded, start).end()
                    before, after = folded[max(0, start - 40):start], folded[end:end + 40]
                    left, right = re.search(r"[^\W_]+ $", before), re.match(r" [^\W_]+", after)
                    if left and (left.start() or start <= 40):
                        found.add(left.group() + folded[start:end])
                    if right and right.end() < 40:
                        found.add(folded[start:end] + right.group())
                (toxic if label else clean).update(found)
        names = list(clean)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[w] for w in names], pa.int64()),
                                          pa.array([clean[w] for w in names], pa.int64())], ["entry", "t", "c"])
    return run


def _significant(t: int, c: int, share: float, tests: int, level: float = 0.01) -> bool:
    """Whether ``t`` of ``t + c`` texts are toxic by more than chance, given
    ``share`` and so many entries tried (Chernoff's bound)."""
    n, p = t + c, t / (t + c)
    if p <= share:
        return False
    gap = p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if c else 0.0)
    return math.log(tests) - n * gap <= math.log(level)


def _without_nested(found: list[tuple[str, int, int, float]]) -> dict[str, float]:
    """Of a word and its stems that say the same, the most specific one; of a
    stem that says more than the words it begins, the stem alone."""
    support: dict[str, int] = {}
    chosen: dict[str, float] = {}
    for entry, t, c, weight in sorted(found, key=lambda x: (6 * x[2] - x[1], -len(x[0].rstrip("*")), x[0])):
        bare = entry.rstrip("*")
        if any(bare[:k] + "*" in chosen for k in range(1, len(bare) + 1)):
            continue
        if entry[-1] == "*" and any(s >= 0.75 * t for other, s in support.items() if other.startswith(bare)):
            continue
        chosen[entry] = weight
        support[bare] = max(support.get(bare, 0), t)
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 50) -> np.ndarray:
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The model: lexicon, exceptions, curve (or the share of toxic labels)."""
    rows = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out())
            .select("doc_id", F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample))
    # at most ``sample`` rows of two numbers
    chosen = keep(docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id"), "toxic-sample")
    per_class = {r["toxic"]: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    n_toxic, n_clean = per_class.get(1, 0), per_class.get(0, 0)
    model = {"lexicon": {}, "exceptions": [], "curve": None, "share": n_toxic / max(1, n_toxic + n_clean)}
    if not n_toxic or not n_clean:
        return model
    sketches = map_arrow(chosen.select("doc_id", "text", "toxic"), _sketches, "doc_id long, toxic int, sketch binary").collect()  # ``sample`` rows at most
    single = one_of_each([(r["doc_id"], r["toxic"], None if r["sketch"] is None else bytes(r["sketch"])) for r in sketches])
    n_toxic = sum(toxic for _, toxic in single)
    n_clean = len(single) - n_toxic
    kept = F.broadcast(docs.sparkSession.createDataFrame(single, "doc_id long, toxic int"))  # ``sample`` rows of two numbers at most
    texts = chosen.join(kept, ["doc_id", "toxic"], "left_semi").dropDuplicates(["text", "toxic"]).repartition(16, "doc_id")
    weight = F.log((F.col("t") + 0.5) / (F.col("c") + 0.5)) - math.log((n_toxic + 1) / (n_clean + 1))
    counts = keep(map_arrow(texts.select("text", "toxic"), _word_counts, "entry string, t long, c long").groupBy("entry")
                  .agg(F.sum("t").alias("t"), F.sum("c").alias("c")).withColumn("weight", weight), "toxic-words")
    tests, share = counts.count(), max(1e-6, min(1 - 1e-6, n_toxic / len(single)))
    strong = (counts.where((F.col("t") >= 2) & (F.col("weight") >= 2) & (F.col("t") > 2 * F.col("c")))
              .orderBy(F.desc("t"), "entry").limit(LEXICON * 4).collect())  # bounded by the lexicon's size
    found = [(r["entry"], r["t"], r["c"], r["weight"]) for r in strong if _significant(r["t"], r["c"], share, tests)]
    model["lexicon"] = lexicon = dict(list(_without_nested(found).items())[:LEXICON])
    phrases = (map_arrow(texts.select("text", "toxic"), _phrase_counts(lexicon), "entry string, t long, c long").groupBy("entry")
               .agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where("c >= 2 and c > 2 * t")
               .orderBy(F.desc("c"), "entry").limit(LEXICON).collect())
    model["exceptions"] = [r["entry"] for r in phrases]
    seen = map_arrow(chosen.select("text", "toxic"), _feature_rows(lexicon, model["exceptions"]),
                     "f0 double, f1 double, f2 double, toxic int").toPandas()  # at most ``sample`` rows of four numbers
    model["curve"] = _logistic(seen[["f0", "f1", "f2"]].to_numpy(), seen["toxic"].to_numpy(float)).tolist()
    return model


def _feature_rows(lexicon: dict[str, float], exceptions: list[str]):
    def run(batches):
        matcher = Matcher(lexicon, exceptions)
        for batch in batches:
            rows = np.array([matcher.features(t) for t in batch.column("text").to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(pa.array(rows[:, k]) for k in range(3)), batch.column("toxic")],
                                             ["f0", "f1", "f2", "toxic"])
    return run


def score(text: Column, model: dict) -> Column:
    """Probability that ``text`` is toxic."""
    lexicon, exceptions, curve, share = model["lexicon"], model["exceptions"], model["curve"], model["share"]
    if curve is None:
        return F.lit(float(share))

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(lexicon, exceptions)
        for part in parts:
            x = np.array([matcher.features(t) for t in part]).reshape(-1, 3)
            z = curve[0] + x @ np.array(curve[1:])
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return F.pandas_udf(run, "double")(text)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    ship_package(docs.sparkSession)
    model = fit(docs, labels)
    return (docs.select("doc_id", _held_out().alias("held_out"), score(F.col("text"), model).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, all columns."""
    ship_package(docs.sparkSession)
    model = fit(docs, labels)
    return docs.withColumn("__score", score(F.col("text"), model)).where("__score < 0.5").drop("__score")
