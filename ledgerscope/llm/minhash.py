"""Near-duplicate groups by a multi-index Hamming join of MinHash signatures.

A document is the set of its distinct word shingles.  Its signature has 64
symbols, each the low 16 bits of a MinHash, so two documents of similarity J
differ in about (1 - J) * 64 symbols.  Signatures that differ in at most 25
symbols are candidates.  The 64 symbols are split into 13 chunks; by the
pigeonhole principle two such signatures differ in at most one symbol of some
chunk, so a key for each chunk and each position that may be wrong (the other
symbols of the chunk, hashed) finds every pair within the distance.  At a
similarity of 0.8 the distance is above 25 with a chance of about one in
10,000.  Every link is then confirmed on the full shingle sets.

Groups of thousands never become all their pairs: documents with one and the
same set are one node; the members of a key are first compared with its
smallest member alone.  Members of a key that are not in one component after
that are compared with each other, by signature, in pairs of blocks of bounded
size, each of which gives a spanning forest and not its pairs; the clusters so
found are compared in the same way on the full sets, the largest component of
a cluster only with the rest.

Defined results: null or empty text, or text without words, has no shingles
and is linked with nothing; a null doc_id is linked with nothing and kept;
rows that repeat a doc_id are one document for the links; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.common import keep, map_arrow, pieces_of, text_bytes
from ledgerscope.llm.components import components
from ledgerscope.llm.textscan import joined, mix, running, span_hash, windows, words

SYMBOLS, CHUNKS, DISTANCE = 64, 13, 25
#: members of a key that one task compares with as many others
BLOCK = 512


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    buf, starts = joined(texts, lower=True)
    begin, end, bounds = words(buf, starts)
    hashes = span_hash(running(buf), begin, end)
    runs, offsets = windows(hashes, bounds, width)
    out = []
    for i in range(len(texts)):
        n = bounds[i + 1] - bounds[i]
        if n >= width or n == 0:
            out.append(np.unique(runs[offsets[i]:offsets[i + 1]]))
        else:
            out.append(windows(hashes[bounds[i]:bounds[i + 1]], np.array([0, n]), int(n))[0])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 16-bit symbols for each non-empty set."""
    rng = np.random.default_rng(64016)
    factors = rng.integers(0, 2**31, SYMBOLS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = rng.integers(0, 2**32, SYMBOLS, dtype=np.uint32)
    full = [s for s in sets if len(s)]
    out = np.zeros((len(full), SYMBOLS), dtype=np.uint16)
    if full:
        h = (np.concatenate(full) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate(([0], np.cumsum([len(s) for s in full])[:-1]))
        for k in range(SYMBOLS):
            out[:, k] = np.minimum.reduceat(h * factors[k] + shifts[k], starts).astype(np.uint16)
    return out


def _signed(width: int):
    def run(batches):
        for part in pieces_of(batches):
            sets = shingle_sets(text_bytes(part.column("text")), width)
            sigs = iter(signatures(sets))
            n = np.array([len(s) for s in sets], dtype=np.int64)
            a = np.array([np.add.reduce(s) for s in sets], dtype=np.uint64).view(np.int64)
            b = np.array([np.bitwise_xor.reduce(mix(s)) if len(s) else 0 for s in sets], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n), pa.array(a), pa.array(b),
                 pa.array([next(sigs).tobytes() if k else None for k in n], pa.binary())],
                ["doc_id", "n_shingles", "set_a", "set_b", "sig"])
    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, SYMBOLS)


def _chunk_keys(batches):
    """For each chunk and each position allowed to be wrong, a key of the rest."""
    rng = np.random.default_rng(77)
    factors = rng.integers(1, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for batch in batches:
        if not batch.num_rows:
            continue
        terms = (_matrix(batch.column("sig")).astype(np.uint64) + np.uint64(1)) * factors
        keys = []
        for chunk in np.array_split(np.arange(SYMBOLS), CHUNKS):
            total = terms[:, chunk].sum(axis=1, dtype=np.uint64)
            keys += [mix(total - terms[:, p] + np.uint64(p)) for p in chunk]
        rep = batch.column("rep").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(rep, len(keys)))],
                                         ["key", "rep"])


def _close(batches):
    """Pairs whose signatures are within the distance."""
    for batch in batches:
        if batch.num_rows:
            near = (_matrix(batch.column("sig_a")) != _matrix(batch.column("sig_b"))).sum(axis=1) <= DISTANCE
            yield batch.select(["a", "b"]).filter(pa.array(near))


def _groups(batches):
    """(table, bounds): whole groups of rows sorted by g, x and y; a group is
    never larger than two blocks."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = pa.concat_tables([rest, table]) if rest is not None else table
        group = np.stack([rest.column(c).to_numpy() for c in ("g", "x", "y")])
        cuts = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1
        if len(cuts):
            yield rest.slice(0, cuts[-1]), np.concatenate(([0], cuts))
            rest = rest.slice(cuts[-1])
    if rest is not None and len(rest):
        yield rest, np.array([0, len(rest)])


def _sides(table: pa.Table, s: int, e: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the two blocks of a group (the same rows twice for one block)."""
    block, x, y = (table.column(c).to_numpy()[s:e] for c in ("block", "x", "y"))
    return np.flatnonzero(block == x[0]) + s, np.flatnonzero(block == y[0]) + s


def _forest(batches):
    """For each group a spanning forest, over components, of its close pairs."""
    for table, bounds in _groups(batches):
        sig, comp = _matrix(table.column("sig")), table.column("comp").to_numpy()
        a, b = [], []
        for s, e in zip(bounds[:-1], bounds[1:]):
            one, two = _sides(table, s, e)
            root = comp[s:e].copy()
            for i in one:
                others = two[root[two - s] != root[i - s]]
                if not len(others):
                    continue
                for j in others[(sig[others] != sig[i]).sum(axis=1) <= DISTANCE]:
                    if root[j - s] != root[i - s]:
                        a.append(comp[i])
                        b.append(comp[j])
                        root[root == root[j - s]] = root[i - s]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _linked_forest(width: int, part: int, whole: int):
    """For each group a spanning forest, over components, of its links: close
    pairs, confirmed on the full sets."""
    def run(batches):
        for table, bounds in _groups(batches):
            sig, comp = _matrix(table.column("sig")), table.column("comp").to_numpy()
            rep = table.column("rep").to_numpy()
            a, b = [], []
            for s, e in zip(bounds[:-1], bounds[1:]):
                one, two = _sides(table, s, e)
                root = comp[s:e].copy()
                sets = shingle_sets(text_bytes(table.column("text").slice(s, e - s).combine_chunks()), width)
                sizes = np.array([len(x) for x in sets])
                for i in one:
                    others = two[root[two - s] != root[i - s]]
                    if len(others):
                        n, m = sizes[others - s], sizes[i - s]
                        others = others[((sig[others] != sig[i]).sum(axis=1) <= DISTANCE)
                                        & (whole * np.minimum(n, m) >= part * np.maximum(n, m))]
                    if not len(others):
                        continue
                    mine, theirs = sets[i - s], np.concatenate([sets[j - s] for j in others])
                    hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
                    n = sizes[others - s]
                    both = np.add.reduceat(hit.astype(np.int64), np.concatenate(([0], np.cumsum(n)[:-1])))
                    for j in others[whole * both >= part * (n + len(mine) - both)]:
                        if root[j - s] != root[i - s]:
                            a.append(rep[i])
                            b.append(rep[j])
                            root[root == root[j - s]] = root[i - s]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return run


def _confirm(width: int, part: int, whole: int):
    def run(batches):
        for batch in pieces_of(batches, column="text_a"):
            ids = batch.column("a").to_pylist()
            first: dict = {}
            for i, t in zip(ids, text_bytes(batch.column("text_a"))):
                first.setdefault((i, t), len(first))
            left = shingle_sets([t for _, t in first], width)
            right = shingle_sets(text_bytes(batch.column("text_b")), width)
            linked = []
            for i, t, r in zip(ids, text_bytes(batch.column("text_a")), right):
                s = left[first[i, t]]
                both = len(np.intersect1d(s, r, assume_unique=True))
                linked.append(whole * both >= part * (len(s) + len(r) - both) > 0)
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))
    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, part: int, whole: int) -> DataFrame:
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return map_arrow(pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b"), _confirm(width, part, whole),
                     "a long, b long")


def _paired(rows: DataFrame, *payload: str) -> DataFrame:
    """Every row once for each block that its block meets, sorted by group and
    pair of blocks."""
    return (rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("partners") - 1)))
            .select("g", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "rep", "comp", *payload)
            .repartition("g", "x", "y").sortWithinPartitions("g", "x", "y"))


def near_groups(docs: DataFrame, width: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``; linked
    where whole * intersection >= part * union."""
    base = docs.select("doc_id", "text")
    sets = keep(map_arrow(base, _signed(width), "doc_id long, n_shingles long, set_a long, set_b long, sig binary"), "sets")
    identity = ["set_a", "set_b", "n_shingles"]
    nodes = keep(sets.where("n_shingles > 0 and doc_id is not null").groupBy(*identity)
                 .agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "nodes")
    keys = map_arrow(nodes.select("rep", "sig"), _chunk_keys, "key long, rep long")
    shared = keys.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead < last")
    members = keep(keys.join(shared.select("key", "lead"), "key"), "members")
    sigs = nodes.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a"))
    others = nodes.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b"))
    star = members.where("lead < rep").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    star = keep(map_arrow(star.join(sigs, "a").join(others, "b"), _close, "a long, b long"), "star")
    # texts of all that may be linked, once
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = keep(base.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi"), "candidates")
    links = keep(_confirmed(star, texts, width, part, whole), "links")
    found = components(links)
    # members of a key that the comparison with its smallest member left apart
    tagged = keep(members.join(found.withColumnRenamed("id", "rep"), "rep", "left")
                  .select("key", "rep", F.coalesce("component", "rep").alias("comp")), "tagged")
    apart = (tagged.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"))
             .where("lo < hi").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    rows = (tagged.join(apart, "key").join(nodes.select("rep", "sig"), "rep")
            .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("partners", F.col("blocks")))
    near = components(map_arrow(_paired(rows.withColumnRenamed("key", "g"), "sig"), _forest, "a long, b long"))
    # clusters of components that close signatures connect: compared in full
    owner = tagged.select("rep", "comp").distinct()
    inside = keep(owner.join(near.select(F.col("id").alias("comp"), F.col("component").alias("g")), "comp"), "clusters")
    sizes = inside.groupBy("g", "comp").agg(F.count("*").alias("n"))
    layout = (sizes.groupBy("g").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("all"))
              .select("g", F.col("main.comp").alias("main"), F.ceil(F.col("main.n") / BLOCK).cast("int").alias("mains"),
                      F.ceil((F.col("all") - F.col("main.n")) / BLOCK).cast("int").alias("rests")))
    is_main = F.col("comp") == F.col("main")
    rows = (inside.join(layout, "g").join(nodes.select("rep", "sig"), "rep")
            .join(texts.select(F.col("doc_id").alias("rep"), "text"), "rep")
            # the largest component's own blocks are not compared with each other
            .withColumn("block", F.when(is_main, F.col("rests") + F.pmod(F.xxhash64("rep"), F.col("mains")))
                        .otherwise(F.pmod(F.xxhash64("rep"), F.col("rests"))).cast("int"))
            .withColumn("partners", F.when(is_main, F.col("rests")).otherwise(F.col("rests") + F.col("mains"))))
    more = keep(map_arrow(_paired(rows, "sig", "text"), _linked_forest(width, part, whole), "a long, b long"), "links")
    found = components(links.union(more)) if not more.isEmpty() else found
    named = (nodes.drop("sig").join(found.withColumnRenamed("id", "rep"), "rep", "left")
             .select(*identity, F.coalesce("component", "rep").alias("component")))
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    return (sets.drop("sig").join(named, identity, "left")
            .select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def near_dedup(docs: DataFrame, width: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """The rows of ``docs``, all columns, without those linked to a smaller doc_id's group."""
    kept = near_groups(docs, width, part, whole).where("kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(F.col("__id")), "left_semi")
