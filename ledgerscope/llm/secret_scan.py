"""Secret scan: fixed patterns, and a character network over candidates.

The patterns give the base findings.  Candidates are all runs of characters
that keys and tokens are made of, of any length, divided where a base finding
begins or ends.  A convolutional network over the candidate and its surroundings,
in numpy, is trained on them, labelled by whether a base finding covers them.

The fit covers all candidates.  A fifth of the texts, chosen by hash, is kept aside.  A
bounded sample of the rest only gives the network its start (``train``).  Then follows an epoch over
every candidate of the rest: each of ``STEPS`` jobs reads the candidates of its share of the texts
and all known secrets, and adds up the gradient of a hinge loss, which is zero for candidates
beyond the margin; the driver gets sums only.  The sums are whole numbers, so they don't depend on how the rows are dealt out.
Calibration and threshold come from all candidates kept aside, counted by score.

So that it learns what secrets look like and not the patterns once more, each known
secret is also shown in other guises: cut shorter, in capitals or with its characters exchanged for
others, and with the keyword and separator hidden, by surroundings taken from a
candidate that is none.  Weights decay, and probabilities are calibrated by a logistic curve with
smoothed labels, which stays finite however well the classes part.

A candidate longer than ``INSIDE`` is seen whole, in windows that overlap by half,
and has the highest of their probabilities.  The threshold is the highest that still finds
``RECALL`` of the known secrets kept aside, in all their guises.  Candidates
above it that no base finding covers are added as kind ``model``; base findings stay.
Below ``LEAST_KNOWN`` different known secrets there is too little to learn from, and nothing is added.

The convolution runs once over a text; a window's maxima come from maxima over
stretches of 4 and 8 places, so the cost is one per character, however many
windows there are, and no window but those of the sample and of the known secrets leaves its task.
Where only the few windows above a score matter (the fit's margin, the threshold), it runs in
whole numbers of 16 bits with a proven bound of their error, and what may be above is scored exactly.

Defined results: null and empty text have no finding; without candidates of
both classes, or with fewer known secrets than ``LEAST_KNOWN``, nothing is added; rows that repeat a doc_id are scanned each; a
null doc_id is kept; texts are scanned whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.common import keep, map_arrow, pieces_of
from ledgerscope.llm.textscan import mix, running, span_hash

# fixed values: the base patterns, with the least length of the part that counts
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_MARKS = np.array([chr(c).isalnum() or chr(c) in "+/_.=-" for c in range(128)])

SAMPLE, RECALL = 8_000, 0.98
#: different known secrets from which on the network is used; guises of each
LEAST_KNOWN, GUISES = 50, 8
#: shares of the texts: a step of the fit reads one, those beyond the steps are kept aside; margin of the loss
SHARES, STEPS, MARGIN = 20, 16, 2.0
#: a gradient's unit, and parts of 1 in which scores are counted
UNIT, GRAIN = 2.0**-32, 1024
#: rate of the fit; weight of ordinary unknown candidates, keylike ones and known secrets, as in the start's sample
RATE, WEIGHTS = 0.02, (1 / 3, 1 / 6, 1 / 2)
#: a secret cut shorter has so many characters at least
SHORTEST = 16
#: share of a weight that a step's gradient adds
DECAY = 1e-3
BEFORE, INSIDE, AFTER = 24, 40, 8
LENGTH, FILTERS, REACH, PARTS = BEFORE + INSIDE + AFTER, 16, 5, 3
STEP = INSIDE // 2
BLOCK = 1 << 15  # places of a text that are convolved at once
CODES = 97  # printable ASCII, one for anything else, one for nothing
#: by byte of UTF-8 the code of the character that it begins
_CODE = np.array([0 if b == 0 else b - 31 if 32 <= b <= 126 else CODES - 1 for b in range(256)], np.uint8)
#: by code
_MARK, _IS_HEX = np.zeros(256, np.int8), np.zeros(256, bool)
_MARK[1:CODES - 1] = _MARKS[32:127]
_IS_HEX[_CODE[list(b"0123456789abcdef")]] = True


def _found(text: str, hexlike: bool = True) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the part that counts) by start, then kind as listed.
    Without ``hexlike`` the text is known to have no finding of kind ``hex``."""
    found = []
    lower = text.encode("utf-8", "replace").lower()
    if any(k in lower for k in _KEYWORDS):
        found += [(m.start(), m.end(), "assign", m.start(2)) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if hexlike:
        found += [(m.start(), m.end(), "hex", m.start()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda f: (f[0], KINDS.index(f[2]), f[1]))


def base_findings(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    return [f[:3] for f in _found(text)]


def _window(text: str, start: int, end: int) -> bytes:
    """Characters of the candidate (``INSIDE`` at most), then codes of the
    surroundings and the candidate, filled up at the end."""
    end = min(end, start + INSIDE)
    chars = text[max(0, start - BEFORE):start].rjust(BEFORE, "\0") + text[start:end + AFTER]
    return bytes([end - start, *(_codes_of(chars).tolist())]).ljust(1 + LENGTH, b"\0")


def _codes_of(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c == 0, 0, np.where((c >= 32) & (c <= 126), c - 31, CODES - 1)).astype(np.uint8)


class _Candidates:
    """Candidates of some texts, laid out one after the other with gaps.

    ``codes``: all characters; ``at``: where each text begins; ``founds``: its base findings;
    ``begin``, ``end``, ``free``, ``known`` per candidate; ``w0``, ``w1``, ``first``: its windows."""

    def __init__(self, texts: list[str], founds: list[list[tuple[int, int, str, int]]] | None = None):
        gap = "\0" * (BEFORE + REACH)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + len(gap)
        at = len(gap) + sizes.cumsum() - sizes
        self.at = at.tolist()
        data = np.frombuffer("".join([gap, *(x for text in texts for x in (text, gap)), "\0" * INSIDE]).encode("utf-8", "surrogatepass"), np.uint8)
        self.codes = _CODE.take(data)
        if len(data) > len(gap) + sizes.sum() + INSIDE:  # characters of several bytes: the first one counts
            self.codes = self.codes[(data & 0xC0) != 0x80]
        self.founds = founds = [_found(t, h) for t, h in zip(texts, self._hexlike(at))] if founds is None else founds
        label, counted = _MARK.take(self.codes), [np.zeros(0, np.int64)]
        for start, found in zip(self.at, founds):
            for begin, end, _, secret in found:
                part = label[start + begin:start + end]
                part[part > 0] = 2
                counted.append(np.arange(start + secret, start + end))
        edge = np.flatnonzero(label[1:] != label[:-1]) + 1  # the gaps at both ends have label 0
        kind = label.take(edge[:-1])
        some = np.flatnonzero(kind)
        self.begin, self.end = edge.take(some), edge.take(some + 1)
        self.free = kind.take(some) == 1
        self.known = np.zeros(len(some), bool)
        base, counted = np.flatnonzero(~self.free), np.unique(np.concatenate(counted))
        self.known[base] = np.searchsorted(counted, self.end[base]) > np.searchsorted(counted, self.begin[base])
        n = self.end - self.begin
        windows, long = np.ones(len(n), np.int64), np.flatnonzero(n > INSIDE)
        windows[long] += -(-(n[long] - INSIDE) // STEP)
        self.first = windows.cumsum() - windows
        self.of = np.repeat(np.arange(len(n)), windows)
        self.w0, self.w1 = self.begin.take(self.of), self.end.take(self.of)
        long = np.flatnonzero(windows.take(self.of) > 1)
        self.w0[long] = np.minimum(self.w0[long] + STEP * (long - self.first[self.of[long]]), self.w1[long] - INSIDE)
        self.w1[long] = self.w0[long] + INSIDE

    def _hexlike(self, at: np.ndarray) -> np.ndarray:
        """Texts that may have 24 hex characters in a row: of these, every third are 8 in a row."""
        hexes = _IS_HEX.take(self.codes[::3])
        for k in (1, 2, 4):
            hexes = hexes[:-k] & hexes[k:]
        out = np.zeros(len(at), bool)
        out[np.searchsorted(at, 3 * np.flatnonzero(hexes), side="right") - 1] = True
        return out

    def keylike(self) -> np.ndarray:
        """Candidates of 12 characters or more with a digit."""
        digits = np.flatnonzero(self.codes - np.uint8(17) < 10)  # codes of 0 to 9; others are 10 or more, or wrap around
        out = self.end - self.begin >= 12
        some = np.flatnonzero(out)
        out[some] = np.searchsorted(digits, self.end[some]) > np.searchsorted(digits, self.begin[some])
        return out

    def windows(self, which: np.ndarray) -> np.ndarray:
        """Rows as ``_window`` gives them."""
        begin, n = self.w0[which], self.w1[which] - self.w0[which]
        spots = np.arange(LENGTH)
        codes = self.codes[np.minimum(begin[:, None] - BEFORE + spots, len(self.codes) - 1)]
        codes[spots >= (BEFORE + n + AFTER)[:, None]] = 0
        return np.concatenate((n[:, None].astype(np.uint8), codes), axis=1)


def _candidates(part: pa.RecordBatch) -> _Candidates:
    return _Candidates([t or "" for t in part.column("text").to_pylist()])


def _pieces(batches, limit: int):
    """doc_ids, base findings and candidates of slices of the batches."""
    for part in pieces_of(batches, limit):
        c = _candidates(part)
        yield part.column("doc_id").to_pylist(), c.founds, c


def _sampled(shares: tuple[int, ...]):
    """Of the windows of texts that are not aside: of each kind (0 unknown, 1 unknown and
    keylike) those of the smallest hashes, as many as its share, of one
    task.  And all windows of known secrets, of kind 2, or 3 where the text is aside."""
    def rows(found: list[tuple[int, bytes, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.int32(), pa.binary(), pa.int64()))], ["kind", "window", "h"])

    def run(batches):
        best = [{} for _ in shares]
        limit = [2**64 - 1] * len(shares)
        for part in pieces_of(batches, 1 << 18):
            c = _candidates(part)
            aside = np.array(part.column("aside").to_pylist(), bool)[np.searchsorted(c.at, c.begin, side="right") - 1]
            kind = np.where(c.known, 2 + aside, np.where(c.keylike(), 1, 0))
            kind[~(c.free & ~aside | c.known)] = -1
            kind = kind[c.of]
            mixed = mix(span_hash(running(c.codes), c.w0 - BEFORE, c.w1 + AFTER) + (c.w1 - c.w0).astype(np.uint64))
            known = np.flatnonzero(kind >= 2)
            if len(known):
                yield rows([(int(k), w.tobytes(), int(h) - 2**63) for k, w, h in zip(kind[known], c.windows(known), mixed[known])])
            for k, share in enumerate(shares):
                some = np.flatnonzero(kind == k)
                for at in range(0, len(some), 1 << 12):
                    few = some[at:at + (1 << 12)]
                    few = few[mixed[few] <= np.uint64(limit[k])]
                    best[k].update((w.tobytes(), h) for w, h in zip(c.windows(few), mixed[few].tolist()))
                    if len(best[k]) > 2 * share:
                        best[k] = dict(sorted(best[k].items(), key=lambda x: (x[1], x[0]))[:share])
                        limit[k] = max(best[k].values(), default=0)
        out = [(k, w, h - 2**63) for k, share in enumerate(shares) for w, h in sorted(best[k].items(), key=lambda x: (x[1], x[0]))[:share]]
        if out:
            yield rows(out)
    return run


# --- the network ---------------------------------------------------------------

def _codes(windows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(windows), np.uint8).reshape(-1, 1 + LENGTH).astype(np.int64)


def _forward(net: dict, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside, codes = rows[:, 0], rows[:, 1:]
    steps = LENGTH - REACH + 1
    conv = net["conv"][0].take(codes[:, :steps], axis=0)
    for k in range(1, REACH):
        conv += net["conv"][k].take(codes[:, k:k + steps], axis=0)
    conv += net["bias"]
    # the places of the convolution that each part pools: before, the candidate, after
    first, end = BEFORE - REACH + 1, (BEFORE + inside)[:, None]
    after = end - REACH + 1 + np.arange(AFTER)
    within = np.where((np.arange(first, BEFORE + INSIDE) < end)[:, :, None], conv[:, first:BEFORE + INSIDE], -np.inf)
    spots = np.stack([conv[:, :first].argmax(axis=1), first + within.argmax(axis=1),
                      after[:, :1] + np.take_along_axis(conv, after[:, :, None], axis=1).argmax(axis=1)], axis=1)  # n, parts, filters
    tops = np.take_along_axis(conv, spots.reshape(len(codes), -1, FILTERS), axis=1)
    pooled = np.maximum(0, tops).reshape(len(codes), -1)
    return pooled @ net["out"] + net["shift"], pooled, spots


def _added_at(total: np.ndarray, codes: np.ndarray, spots: np.ndarray, back: np.ndarray) -> None:
    """Add what goes back from each pooled place to the weights that it came from."""
    filters, some = np.broadcast_to(np.arange(FILTERS), spots.shape), np.flatnonzero(back)
    more = back.ravel()[some]
    for k in range(REACH):
        at = np.take_along_axis(codes, (1 + spots + k).reshape(len(codes), -1), axis=1).reshape(spots.shape)
        np.add.at(total[k].reshape(-1), (at * FILTERS + filters).ravel()[some], more)


def _calibrated(net: dict, z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(net["slope"] * z + net["offset"], -30, 30)))


def probability(net: dict, windows: list[bytes]) -> np.ndarray:
    return _calibrated(net, np.concatenate([_forward(net, _codes(windows[i:i + 512]))[0] for i in range(0, len(windows), 512)]))


def _tables(net: dict, dtype: type) -> list[np.ndarray]:
    """The convolution for two places side by side (fewer look-ups), and for the last place, with the bias."""
    conv = net["conv"].astype(dtype)
    return [(conv[k][:, None] + conv[k + 1]).reshape(CODES * CODES, FILTERS) for k in range(0, REACH - 1, 2)] + [conv[REACH - 1] + net["bias"].astype(dtype)]


def _pooled_scores(c: _Candidates, tables: list[np.ndarray], out: np.ndarray, shift: float) -> np.ndarray:
    """The score of each window; convolution and maxima in the type of ``tables``."""
    z = np.full(len(c.w0), shift, float)
    bounds = np.searchsorted(c.w0, np.arange(0, len(c.codes) + BLOCK, BLOCK)).tolist()  # windows lie in order
    out = out.astype(np.float32).reshape(PARTS, FILTERS)
    for a, b in zip(bounds, bounds[1:]):
        if a == b:
            continue
        begin, end = c.w0[a:b], c.w1[a:b]
        low, high = begin[0] - BEFORE, end.max() + AFTER
        codes = c.codes[low:high].astype(np.int64)
        n = len(codes) - REACH + 1
        two = codes[:-1] * CODES + codes[1:]
        top = tables[-1].take(codes[REACH - 1:], axis=0)
        for k, table in enumerate(tables[:-1]):
            top += table.take(two[2 * k:2 * k + n], axis=0)
        begin, end = begin - low, end - low
        tops = [top]  # maxima over 1, 2, 4, 8 places from each on
        for half in (1, 2, 4):
            tops.append(np.maximum(tops[-1][:-half], tops[-1][half:]))
        size = end - begin + REACH - 1
        eights = (size + 7) >> 3
        parts = [(0, slice(None), begin - BEFORE, BEFORE - REACH + 1), (2, slice(None), end - REACH + 1, AFTER)]
        for n in np.flatnonzero(np.bincount(eights)).tolist():
            some = np.flatnonzero(eights == n)
            parts.append((1, some, begin.take(some) - REACH + 1, size.take(some)))
        for part, some, first, size in parts:
            n = (int(np.max(size)) + 7) >> 3  # of stretches; up to 8 places are two of 4
            width, over = (8, tops[3]) if n > 1 else (4, tops[2])
            best = over.take(first, axis=0)
            for i in range(1, max(n, 2)):
                np.maximum(best, over.take(first + np.minimum(i * width, size - width), axis=0), out=best)
            z[a:b][some] += np.maximum(best, np.zeros_like(best), out=best).astype(np.float32, copy=False) @ out[part]
    return z


def _scores(net: dict, c: _Candidates) -> np.ndarray:
    """The score of each window, as ``_forward`` gives it but for rounding."""
    return _pooled_scores(c, _tables(net, np.float32), net["out"], net["shift"])


def _in_units(net: dict) -> dict:
    """The network in whole numbers of 16 bits, and how far its scores can be from those of ``_forward``: each
    of a place's tables is wrong by half a unit at most, maxima and cutting off at zero add nothing."""
    most = np.abs(net["conv"]).max(axis=(1, 2)).sum() + np.abs(net["bias"]).max()
    unit = max(most, 1e-30) / 32000
    tables = [np.rint(table / unit).astype(np.int16) for table in _tables(net, np.float64)]
    weight, rounding = np.abs(net["out"]).sum(), 1e-5  # the latter of sums in float32
    return {"tables": tables, "out": net["out"] * unit, "shift": net["shift"],
            "error": weight * (len(tables) * unit / 2 + rounding * most) + 1e-9 * (1 + abs(net["shift"]))}


def _bounds(units: dict, c: _Candidates) -> tuple[np.ndarray, np.ndarray]:
    """What the score of each window surely lies between, by the network ``_in_units``."""
    z = _pooled_scores(c, units["tables"], units["out"], units["shift"])
    return z - units["error"], z + units["error"]


def _probabilities(net: dict, c: _Candidates, z: np.ndarray | None = None) -> np.ndarray:
    """The highest of its windows' probabilities for each candidate, as
    ``probability`` gives them but for rounding, or by scores ``z``."""
    z = _scores(net, c) if z is None else z
    return np.maximum.reduceat(_calibrated(net, z), c.first) if len(z) else z


def _hits(net: dict, units: dict, c: _Candidates) -> np.ndarray:
    """Candidates that no base finding covers and whose probability reaches the threshold."""
    low, high = _bounds(units, c)
    maybe = c.free & (_probabilities(net, c, high if net["slope"] >= 0 else low) >= net["threshold"])
    some = np.flatnonzero(maybe.take(c.of))
    hit = [some[:0]]
    for at in range(0, len(some), 256):
        few = some[at:at + 256]
        hit.append(few[_calibrated(net, _forward(net, c.windows(few).astype(np.int64))[0]) >= net["threshold"]])
    return np.unique(c.of[np.concatenate(hit)])


_ALNUM = np.array([i for i in range(1, CODES - 1) if _MARKS[i + 31] and chr(i + 31).isalnum()])
_CAPITAL = np.arange(256)
_CAPITAL[ord("a") - 31:ord("z") - 30] -= 32


def guises(known: np.ndarray, others: np.ndarray, rng: np.random.Generator, n: int = GUISES) -> np.ndarray:
    """``n`` guises of each known window: shorter, in capitals or with other
    characters, in the surroundings of a window of ``others``."""
    rows = np.repeat(known, n, axis=0)
    out = np.zeros_like(rows)
    for row, new, other in zip(rows, out, others[rng.integers(0, len(others), len(rows))]):
        size = int(row[0])
        if size > SHORTEST and rng.random() < 0.5:
            size = int(rng.integers(SHORTEST, size + 1))
        start = 1 + BEFORE + int(rng.integers(0, row[0] - size + 1))
        inside, way = row[start:start + size], rng.random()
        if way < 0.25:
            inside = _CAPITAL[inside]
        elif way < 0.75:  # each character for another one
            swap = np.arange(256)
            swap[_ALNUM] = rng.permutation(_ALNUM)
            inside = swap[inside]
        new[0] = size
        new[1:1 + BEFORE] = other[1:1 + BEFORE]
        new[1 + BEFORE:1 + BEFORE + size] = inside
        after = other[1 + BEFORE + other[0]:1 + BEFORE + other[0] + AFTER]
        new[1 + BEFORE + size:1 + BEFORE + size + len(after)] = after
    return out


def _logistic_fit(z: np.ndarray, t: np.ndarray, steps: int = 50, n: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset of the logistic curve through scores ``z``, each counted ``n`` times, with labels
    ``t``, which are drawn in from 0 and 1 by one in the size of their class."""
    n = np.ones(len(t)) if n is None else n
    pos, neg = (n * t).sum(), (n * (1 - t)).sum()
    target = np.where(t > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = n * np.where(t > 0, 0.5 / max(1, pos), 0.5 / max(1, neg))
    x = np.stack((z, np.ones(len(z))), axis=1)
    beta = np.zeros(2)
    loss = lambda b: (weight * (np.logaddexp(0, x @ b) - target * (x @ b))).sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (p - target))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + 1e-6 * np.eye(2), gradient)
        size = 1.0
        while size > 1e-4 and loss(beta - size * step) > loss(beta):
            size /= 2
        if np.abs(size * step).max() < 1e-9:
            break
        beta = beta - size * step
    return float(beta[0]), float(beta[1])


def train(windows: list[bytes], known: np.ndarray, epochs: int = 40, seed: int = 3, least: int | None = None) -> dict:
    """The network on four fifths, calibration and threshold on the rest.  With
    fewer known secrets than ``least`` (``LEAST_KNOWN``) no probability reaches the threshold."""
    rng = np.random.default_rng(seed)
    enough = known.sum() >= (LEAST_KNOWN if least is None else least)
    codes, y = _codes(windows), known.astype(float)
    nth = np.zeros(len(y), np.int64)
    for k in (True, False):  # every fifth of each class is kept aside
        nth[known == k] = np.arange((known == k).sum())
    aside = nth % 5 == 4
    for part in (False, True):
        pos, neg = (codes[:len(known)][(known == k) & (aside[:len(known)] == part)] for k in (True, False))
        if len(pos) and len(neg):
            capital = neg.copy()  # or capitals alone would tell a secret
            capital[:, 1:] = _CAPITAL[capital[:, 1:]]
            more = np.concatenate((guises(pos, neg, rng), capital))
            codes = np.concatenate((codes, more))
            y = np.concatenate((y, np.ones(len(more) - len(neg)), np.zeros(len(neg))))
            aside = np.concatenate((aside, np.full(len(more), part)))
    net = {"conv": rng.normal(0, 0.1, (REACH, CODES, FILTERS)), "bias": np.zeros(FILTERS),
           "out": rng.normal(0, 0.2, PARTS * FILTERS), "shift": 0.0, "slope": 1.0, "offset": 0.0}
    fit = np.flatnonzero(~aside)
    weight = np.where(y > 0, 0.5 / max(1, y[fit].sum()), 0.5 / max(1, (1 - y[fit]).sum())) * len(fit)
    size = {k: np.zeros_like(net[k]) for k in ("conv", "bias", "out")}
    for _ in range(epochs if enough else 0):
        for i in np.array_split(rng.permutation(fit), max(1, len(fit) // 64)):
            z, pooled, spots = _forward(net, codes[i])
            error = weight[i] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]) / len(i)
            back = (np.outer(error, net["out"]) * (pooled > 0)).reshape(len(i), PARTS, FILTERS)
            grad = {"conv": DECAY * net["conv"], "bias": back.sum(axis=(0, 1)), "out": pooled.T @ error + DECAY * net["out"]}
            _added_at(grad["conv"], codes[i], spots, back)
            for k, g in grad.items():  # AdaGrad
                size[k] += g**2
                net[k] = net[k] - 0.05 * g / (np.sqrt(size[k]) + 1e-8)
            net["shift"] -= 0.05 * error.sum()
    z, t = _forward(net, codes[aside])[0], y[aside]
    if 0 < t.sum() < len(t):
        net["slope"], net["offset"] = _logistic_fit(z, t)
    p = np.sort(_calibrated(net, z[t > 0])) if t.any() else np.array([1.0])
    net["threshold"] = float(p[int((1 - RECALL) * len(p))]) if enough else np.inf
    return net


# --- the fit on all candidates ---------------------------------------------------

_SHAPES = {"conv": (REACH, CODES, FILTERS), "bias": (FILTERS,), "out": (PARTS * FILTERS,), "shift": (1,)}


def _gradient(net: dict, codes: np.ndarray, y: float) -> np.ndarray:
    """The summed gradient of the hinge loss, rounded off near its corner, of windows with
    label ``y``, in ``UNIT``s, as one array."""
    z, pooled, spots = _forward(net, codes)
    error = np.clip(MARGIN - z if y else z + MARGIN, 0, 1) * (-1 if y else 1)
    whole = lambda x: np.rint(x / UNIT).astype(np.int64)
    back = whole(np.outer(error, net["out"]) * (pooled > 0)).reshape(len(codes), PARTS, FILTERS)
    conv = np.zeros(_SHAPES["conv"], np.int64)
    _added_at(conv, codes, spots, back)
    return np.concatenate([conv.ravel(), back.sum(axis=(0, 1)), whole(pooled * error[:, None]).sum(axis=0), [whole(error).sum()]])


def _in_guises(windows: list[bytes], others: np.ndarray, seed: int):
    """Codes of the windows and their guises, of some windows at a time."""
    for at in range(0, len(windows), 32):
        some = []
        for window in windows[at:at + 32]:
            known = _codes([window])
            rng = np.random.default_rng([seed, *hashlib.md5(window).digest()])
            some += [known, guises(known, others, rng)]
        yield np.concatenate(some)


_SUMS = "kind int, n long, sums binary"


def _no_sums(kinds: int) -> tuple[np.ndarray, np.ndarray]:
    return np.zeros(kinds, np.int64), np.zeros((kinds, sum(map(np.prod, _SHAPES.values()))), np.int64)


def _sums_rows(kinds, n: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(kinds), pa.int32()), pa.array(n), pa.array([x.tobytes() for x in total], pa.binary())], ["kind", "n", "sums"])


def _sums_unknown(net: dict):
    """Count and gradient of all unknown windows of a task's texts, ordinary (kind 0) and keylike (1)."""
    def run(batches):
        (n, total), units = _no_sums(2), _in_units(net)
        for part in pieces_of(batches, 1 << 20):
            c = _candidates(part)
            free, kind = c.free[c.of], c.keylike()[c.of].astype(int)
            n += np.bincount(kind[free], minlength=2)
            near = free & (_bounds(units, c)[1] > -MARGIN)  # beyond, the gradient is zero
            for k in (0, 1):
                some = np.flatnonzero(near & (kind == k))
                for at in range(0, len(some), 256):
                    total[k] += _gradient(net, c.windows(some[at:at + 256]).astype(np.int64), 0.0)
        yield _sums_rows((0, 1), n, total)
    return run


def _sums_known(net: dict, others: np.ndarray, step: int):
    """The same of all known secrets and their guises (kind 2), which are others in each step."""
    def run(batches):
        n, total = _no_sums(1)
        for batch in batches:
            for codes in _in_guises(batch.column("window").to_pylist(), others, step):
                n += len(codes)
                total += _gradient(net, codes, 1.0)
        yield _sums_rows((2,), n, total)
    return run


def _added_sums(batches):
    n, total = _no_sums(len(WEIGHTS))
    for batch in batches:
        for kind, more, sums in zip(*(batch.column(c).to_pylist() for c in ("kind", "n", "sums"))):
            n[kind] += more
            total[kind] += np.frombuffer(sums, np.int64)
    some = np.flatnonzero(n)
    yield _sums_rows(some.tolist(), n[some], total[some])


def _step(net: dict, size: dict, texts: DataFrame, known: DataFrame, others: np.ndarray, step: int) -> None:
    """One step of the fit, on the candidates of ``texts`` and all of ``known``."""
    sums = map_arrow(texts, _sums_unknown(net), _SUMS).unionByName(map_arrow(known, _sums_known(net, others, step), _SUMS))
    rows = map_arrow(sums.where("n > 0").repartition("kind"), _added_sums, _SUMS).collect()  # one row a kind
    mean = sum(WEIGHTS[r["kind"]] / r["n"] * UNIT * np.frombuffer(r["sums"], np.int64) for r in sorted(rows, key=lambda r: r["kind"]))
    at = 0
    for k, shape in _SHAPES.items():
        g = mean[at:at + int(np.prod(shape))].reshape(shape)
        at += g.size
        if k == "shift":
            net[k] -= RATE * float(g[0])
            continue
        g = g + (0 if k == "bias" else DECAY) * net[k]
        size[k] = size[k] + g**2  # AdaGrad
        net[k] = net[k] - RATE * g / (np.sqrt(size[k]) + 1e-8)


_COUNTS = "known int, cell int, n long"


def _cells(known: int, z: np.ndarray) -> pa.RecordBatch:
    cell, n = np.unique(np.floor(np.clip(z, -64, 64) * GRAIN).astype(np.int32), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), known, np.int32)), pa.array(cell), pa.array(n.astype(np.int64))], ["known", "cell", "n"])


def _cells_unknown(net: dict):
    """How many unknown windows have which score."""
    def run(batches):
        for part in pieces_of(batches, 1 << 20):
            c = _candidates(part)
            yield _cells(0, _scores(net, c)[c.free[c.of]])
    return run


def _cells_known(net: dict, others: np.ndarray):
    """The same of known secrets in their guises, the secret itself included."""
    def run(batches):
        for batch in batches:
            for codes in _in_guises(batch.column("window").to_pylist(), others, STEPS):
                yield _cells(1, _forward(net, codes)[0])
    return run


def _calibrate(net: dict, texts: DataFrame, known: DataFrame, others: np.ndarray) -> None:
    """Calibration and threshold from all candidates of ``texts`` and all of ``known``."""
    counts = map_arrow(texts, _cells_unknown(net), _COUNTS).unionByName(map_arrow(known, _cells_known(net, others), _COUNTS))
    rows = counts.groupBy("known", "cell").agg(F.sum("n").alias("n")).orderBy("known", "cell").collect()  # 2 * 128 * GRAIN at most
    t, z, n = (np.array([r[c] for r in rows], float) for c in ("known", "cell", "n"))
    z /= GRAIN
    if 0 < t.sum() < len(t):
        net["slope"], net["offset"] = _logistic_fit(z, t, n=n)
    found = np.flatnonzero(t)  # by score
    upto = n[found].cumsum()
    lowest = z[found[np.searchsorted(upto, int((1 - RECALL) * upto[-1]), side="right")]] if len(found) else np.inf
    net["threshold"] = float(_calibrated(net, np.array([lowest]))[0]) if len(found) else 1.0


def _named(net: dict | None):
    order = {k: n for n, k in enumerate((*KINDS, "model"))}
    text = lambda found: ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(found, key=lambda f: (f[0], order[f[2]], f[1])))

    def run(batches):
        units = None if net is None else _in_units(net)
        for docs, founds, c in _pieces(batches, 1 << 20):
            added = [[] for _ in docs]
            if net is not None:
                hit = _hits(net, units, c)
                for i, begin, end in zip((np.searchsorted(c.at, c.begin[hit], side="right") - 1).tolist(), c.begin[hit].tolist(), c.end[hit].tolist()):
                    added[i].append((begin - c.at[i], end - c.at[i], "model"))
            rows = []
            for doc, found, more in zip(docs, founds, added):
                base = [f[:3] for f in found]
                kinds = [f[2] for f in found]
                rows.append((doc, *(kinds.count(k) for k in KINDS), hashlib.sha256(text(base).encode()).hexdigest(), text(base + more)))
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)],
                                             ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
    return run


def _fitted(docs: DataFrame, sample: int) -> dict | None:
    """The network, fitted on all candidates of ``docs``; None without candidates of both classes."""
    share = F.pmod(F.xxhash64("text"), F.lit(SHARES))
    texts = docs.select("text", share.alias("share"), (share >= STEPS).alias("aside"))
    shares = (sample // 2, sample // 4)  # other candidates, keylike ones
    seen = keep(map_arrow(texts.select("text", "aside"), _sampled(shares), "kind int, window binary, h long").distinct(), "candidates")
    n_known = seen.where("kind >= 2").select("window").distinct().count()
    few = n_known < LEAST_KNOWN
    first = lambda which, n: seen.where(which).select("kind", "window", "h").orderBy("h", "window").limit(n).collect()
    rows = [r for k, n in enumerate(shares) for r in first(F.col("kind") == k, n)]
    rows += first(F.col("kind") >= 2 if few else F.col("kind") == 2, sample // 4)  # the start: at most ``sample``
    rows.sort(key=lambda r: hashlib.md5(r["window"]).digest())
    windows, known = [bytes(r["window"]) for r in rows], np.array([r["kind"] >= 2 for r in rows], bool)
    if not 0 < known.sum() < len(known):
        return None
    if few:
        return train(windows, known)
    net = train(windows, known, least=1)
    size, others = {k: np.zeros(shape) for k, shape in _SHAPES.items()}, _codes([w for w, k in zip(windows, known) if not k])
    for step in range(STEPS):
        _step(net, size, texts.where(F.col("share") == step).select("text"), seen.where("kind = 2").select("window"), others, step)
    _calibrate(net, texts.where("aside").select("text"), seen.where("kind = 3").select("window"), others)
    return net


def secret_scan(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row.
    ``sample``: candidates from which the network starts; the fit covers all."""
    docs = docs.select("doc_id", "text")
    return map_arrow(docs, _named(_fitted(docs, sample)), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
