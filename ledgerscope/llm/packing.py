"""Best-fit packing of token sequences by a configuration linear program.

A configuration is a multiset of piece lengths that fits one sequence.  The
program asks for the fewest sequences whose configurations cover the length
histogram.  Multiplicative weights solve it: every length has a price that
falls as it gets covered, a knapsack dynamic program finds the configurations
of the highest price, full ones where there are any, and a share of its scarcest length is
covered by each, until every length is.  The solution is rounded: down to whole
sequences first, then up for full configurations, largest amounts first, as far
as there are pieces.  What is left is a smaller program, solved again; when a small share of
the volume is left, the last pieces are packed by exact-fill dynamic programs, longest piece first.
Of the shares ``RESTS`` the first counts with which the sequences are as few as the volume asks for, else
that with the fewest (a larger share only where it saves more than 1 sequence in 10,000).

Only the histogram (one count per length, at most ``capacity`` numbers) is on
the driver.  Pieces get their place by rank: all pieces of a length are
numbered (hash order, in buckets of bounded size), and the plan says which
ranks of a length lie in which configuration's sequences and where.

Defined results: null text is empty; a document without tokens is its closing
id alone; rows that repeat a doc_id are packed as rows of their own; a null
doc_id is kept; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.llm.common import keep, map_arrow, pieces_of

BUCKET_ROWS = 50_000
#: shares of the volume that may be left to exact fills
RESTS = (0.03, 0.1, 0.3)
#: share of the sequences by which a plan has to be shorter to be taken instead
SLIGHT = 1e-4
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class ByteIds:
    """Token ids as little-endian 32-bit bytes by a ``tokenizers`` file.

    A plain byte-level model (words by the GPT-2 pattern, then merges) whose
    merges give every token once, with rising ids, splits a word alike whether
    pairs are ranked by merge or by the id they give: so ``tiktoken`` finds the
    same ids, in about a quarter of the time.  Texts with characters from
    U+0530 on (the libraries' Unicode versions may differ there), with the
    string of an added token or of over ``LONG`` characters, and all texts of
    other models, go to ``tokenizers``.
    """

    LONG = 200_000

    def __init__(self, path: str):
        import json
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path) as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.later = re.compile("[^\x00-\u052f]")
        self.plain = _plain_model(spec)

    def __call__(self, texts: list[str]) -> list[bytes]:
        def quick(t):
            return (self.plain is not None and len(t) <= self.LONG and not self.later.search(t)
                    and not any(a in t for a in self.added))

        rest = [i for i, t in enumerate(texts) if not quick(t)]
        by_library = self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)
        ids = {i: e.ids for i, e in zip(rest, by_library)}
        return [np.array(ids[i] if i in ids else self.plain.encode_ordinary(t), dtype="<u4").tobytes() for i, t in enumerate(texts)]


def _plain_model(spec: dict):
    """The ``tiktoken`` encoding of a model that ``ByteIds`` calls plain, or None."""
    import tiktoken

    steps, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if not (model["type"] == "BPE" and steps.get("type") == "ByteLevel" and steps.get("use_regex", True)
            and not steps.get("add_prefix_space") and spec.get("normalizer") is None
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix",
                                               "end_of_word_suffix", "byte_fallback", "ignore_merges"))):
        return None
    # byte-level models spell printable Latin-1 bytes as themselves, the others from U+0100 on
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)) - set(shown))
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ids = model["vocab"]
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    order = [ids[t] for t in merged]
    if any(a >= b for a, b in zip(order, order[1:])) or not ids.keys() >= byte.keys():
        return None
    ranks = {bytes(byte[c] for c in t): ids[t] for t in [*byte, *merged]}
    # fixed value: the GPT-2 pattern
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _encoder(path: str) -> ByteIds:
    """One per worker process; it outlives the task."""
    return ByteIds(path)


def _cut(path: str, capacity: int):
    def run(batches):
        encode = _encoder(path)
        for part in pieces_of(batches, 1 << 20):
            rows = []
            texts = ["" if t is None else t for t in part.column("text").to_pylist()]
            for doc, ids in zip(part.column("doc_id").to_pylist(), encode(texts)):
                ids += bytes(4)
                n = len(ids) // 4
                first = n % capacity or capacity
                bounds = [0, *range(first, n + 1, capacity)]
                rows += [(doc, i, a, b - a, zlib.crc32(ids[4 * a:4 * b])) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


# --- the plan, over the length histogram -----------------------------------

def _knapsack(price: np.ndarray, capacity: int, full: bool) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: per room the highest total price and the last piece
    of a configuration that has it; ``full``: only of those that fill the room."""
    value = np.full(capacity + 1, -np.inf if full else 0.0)
    value[0] = 0.0
    back = np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        gain = value[c - 1::-1] + price[1:c + 1]  # last piece of length 1..c
        best = int(gain.argmax())
        if full or gain[best] > value[c - 1]:
            value[c], back[c] = gain[best], best + 1
        else:
            value[c] = value[c - 1]
    return value, back


def _priced_configurations(price: np.ndarray, capacity: int, near: float) -> list[dict[int, int]]:
    """The configuration of the highest total price, and those above ``near``
    of it that share no length with one before them; full ones if there are any.

    One table gives the best configuration with any given length in it, so a
    run prices many lengths; as they share none, their prices stay right."""
    value, back = _knapsack(price, capacity, full=True)
    if not np.isfinite(value[capacity]):
        value, back = _knapsack(price, capacity, full=False)
    total = value[::-1] + price  # of the best configuration with a length
    total[0] = -np.inf
    wanted = np.flatnonzero(total >= near * value[capacity])
    found: list[dict[int, int]] = []
    used: set[int] = set()
    for length in wanted[np.argsort(-total[wanted], kind="stable")].tolist():
        if length in used:
            continue
        one, c = {length: 1}, capacity - length
        while c > 0:
            n = int(back[c])
            if n:
                one[n] = one.get(n, 0) + 1
            c -= n or 1
        if used.isdisjoint(one):
            used.update(one)
            found.append(one)
    return found


def _fullest(left: dict[int, int], capacity: int) -> dict[int, int]:
    """With the longest piece left, the fullest configuration of pieces left."""
    longest = max(left)
    room = capacity - longest
    steps = []
    reach = 1
    for length in sorted((n for n in left if n <= room), reverse=True):
        copies, n = min(left[length] - (length == longest), room // length), 1
        while copies > 0:  # 1, 2, 4, ... and the rest at once: any number of copies
            n = min(n, copies)
            steps.append((length, n, reach))
            reach |= (reach << n * length) & ((1 << (room + 1)) - 1)
            copies, n = copies - n, 2 * n
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    found = {longest: 1}
    for length, n, before in reversed(steps):
        if not before >> at & 1:
            found[length] = found.get(length, 0) + n
            at -= n * length
    return found


def _longest_first(left: dict[int, int], capacity: int) -> dict[int, int]:
    """The configuration that first fit, longest piece first, would open next."""
    found, room = {}, capacity
    for length in sorted(left, reverse=True):
        a = min(left[length], room // length)
        if a:
            found[length] = a
            room -= a * length
    return found


def _completed(left: dict[int, int], capacity: int, fill) -> dict[tuple, int]:
    """Configurations by ``fill`` until no piece is left."""
    left = {length: count for length, count in left.items() if count}
    plan: dict[tuple, int] = {}
    while left:
        best = fill(left, capacity)
        times = min(left[length] // a for length, a in best.items())
        key = tuple(sorted(best.items()))
        plan[key] = plan.get(key, 0) + times
        for length, a in best.items():
            left[length] -= a * times
            if not left[length]:
                del left[length]
    return plan


def _solved(histogram: dict[int, int], capacity: int, step: float = 0.25, rate: float = 1.0, near: float = 0.9) -> dict[tuple, float]:
    """Amounts of configurations that cover every length of the histogram.

    Prices start convex in the length, as long pieces are the harder ones to place."""
    n = np.zeros(capacity + 1)
    for length, count in histogram.items():
        n[length] = count
    size = (np.arange(capacity + 1) / capacity) ** 1.5
    covered = np.zeros(capacity + 1)
    price = np.where(n > 0, size, -np.inf)
    solution: dict[tuple, float] = {}
    while (price > 0).any():  # every round covers ``step`` of a length, or the rest of it
        for best in _priced_configurations(price, capacity, near):
            amount = min(min(step, 1 - covered[length]) * n[length] / a for length, a in best.items())
            key = tuple(sorted(best.items()))
            solution[key] = solution.get(key, 0.0) + amount
            for length, a in best.items():
                covered[length] += amount * a / n[length]
                price[length] = size[length] * math.exp(-rate * covered[length]) if covered[length] < 1 - 1e-9 else -np.inf
    return solution


def _rounded(histogram: dict[int, int], capacity: int, solution: dict[tuple, float], rest: float) -> tuple[dict[tuple, int], dict[int, int]]:
    """Whole sequences of ``solution`` and of the programs of what it leaves, up
    to a share ``rest`` of the volume; and the pieces left."""
    left, plan = dict(histogram), {}
    total = open_volume = sum(length * count for length, count in left.items())

    def take(key: tuple, times: int) -> int:
        nonlocal open_volume
        size = sum(length * a for length, a in key)
        times = min([times, max(0, int((open_volume - rest * total) // size)), *(left[length] // a for length, a in key)])
        if times > 0:
            plan[key] = plan.get(key, 0) + times
            open_volume -= size * times
            for length, a in key:
                left[length] -= a * times
        return max(times, 0)

    while True:
        order = sorted(solution.items(), key=lambda x: (-x[1], x[0]))
        taken = sum(take(key, int(amount + 1e-9)) for key, amount in order)
        taken += sum(take(key, 1) for key, _ in order if sum(length * a for length, a in key) == capacity)
        if not taken or open_volume <= rest * total + capacity:
            return plan, left
        solution = _solved({length: count for length, count in left.items() if count}, capacity)


def configurations(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(configuration, sequences) pairs that hold every piece exactly once.
    ``configurations.share``: the volume placed by the program, of all."""
    histogram = {length: int(count) for length, count in histogram.items() if count}
    volume = sum(length * count for length, count in histogram.items())
    solution = _solved(histogram, capacity)
    best = None
    for rest in RESTS:
        plan, left = _rounded(histogram, capacity, solution, rest)
        share = 1 - sum(length * count for length, count in left.items()) / volume if volume else 1.0
        # the rest by the better of two completions, each longest piece first
        last = min((_completed(left, capacity, fill) for fill in (_fullest, _longest_first)), key=lambda c: sum(c.values()))
        for key, times in last.items():
            plan[key] = plan.get(key, 0) + times
        if best is None or sum(plan.values()) < (1 - SLIGHT) * sum(best.values()):
            best, configurations.share = plan, share
        if sum(best.values()) <= -(-volume // capacity):
            break
    return [(dict(key), times) for key, times in best.items()]


def _segments(plan: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces a sequence, offset):
    where the pieces of a length with ranks from ``first rank`` on go."""
    rows, used, sequence = [], {}, 0
    for configuration, times in plan:
        offset = 0
        for length in sorted(configuration, reverse=True):
            a = configuration[length]
            rows.append((length, used.get(length, 0), sequence, a, offset))
            used[length] = used.get(length, 0) + a * times
            offset += a * length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _place(segments: np.ndarray):
    keys = (segments[:, 0] << 44) + segments[:, 1]

    def run(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            s = segments[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            nth = rank - s[:, 1]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(s[:, 2] + nth // s[:, 3]),
                 pa.array(s[:, 4] + nth % s[:, 3] * length)], [*names, "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    pieces = keep(map_arrow(docs.select("doc_id", "text"), _cut(tokenizer, capacity), PIECES), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    if not histogram:
        return pieces.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    segments = _segments(configurations(histogram, capacity))
    buckets = -(-max(histogram.values()) // BUCKET_ROWS)
    hashed = (pieces.withColumn("h", F.xxhash64("doc_id", "piece", "ids_crc32"))
              .withColumn("bucket", F.shiftright(F.shiftrightunsigned("h", 33) * F.lit(buckets), 31)))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = (hashed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
            .select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")))
    nth = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("h", "doc_id", "piece"))
    ranked = hashed.withColumn("nth", nth).join(base, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth") - 1).alias("rank"))
    return map_arrow(ranked, _place(segments), PIECES + ", sequence_id long, offset long")
