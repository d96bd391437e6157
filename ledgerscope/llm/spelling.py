"""Spelling variants by a relational trie frontier.

The words (distinct, with their counts) form a trie that exists only as a
table: a prefix that goes on in two or more ways is a node, and each stretch
of letters from one node to the next is an edge (node, label, child); the last
label of a word ends with ``END``.  Level by level the states (word, position,
node, edits) are joined with the edges of their node:

* without an edit so far, a label that agrees is passed; one that differs at some
  place uses the edit there, by another letter or by leaving the word's letter out,
  if the rest of the label agrees;
* with the edit used, only the label that agrees is passed.

A state that ends a word with one edit has found a neighbour.  A state is dropped
early when its new node doesn't go on with its next letter, or when fewer letters are
left than any word below the node has, or more.

An edit near the front would lead through the trie's fullest levels.  So every word is in
the trie twice, as it is and reversed (behind one of two ``MARKS``), and only edits in the second half of what is read are
looked for: the states start at the word's prefix up to its middle, which is always a node, and no
shorter prefix is kept.
Leaving a letter out finds the shorter word from the longer one, another letter finds
the word with the larger letter from that with the smaller, each in one place
only (in a run of equal letters the last), so every pair of neighbours is found once.

Skew: no root is shared by all words.  The states of a node of many words meet many edges' rows: these are
copied once for every ``PER_COPY`` of the words, and states are dealt over the copies by word.

A word's form is its neighbour with the largest count, if that is twice its own
at least; forms are followed to the root by pointer doubling.

Defined results: null and empty texts have no words; a null doc_id counts as an empty one
in the hash; rows that repeat a doc_id count each; words of any length are taken
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.llm.common import drop_kept, keep

# fixed values: letters of a word, and those that are lower-cased
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, CUT_EVERY, FORM_RATIO = 5, 3, 97, 2
#: ends every word in the trie, smaller than any letter; begin a word as it is and reversed
END, MARKS = "\n", "<>"
#: words below a node that one copy of its edges serves
PER_COPY = 20_000


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): words after the rule that leaves a letter out of some."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"([{LETTERS}]{{{LEAST_LENGTH},}})"), F.lit(1))).alias("run"))
    lowered = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    runs = runs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), lowered.alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    cut = (h % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), cut), F.substring("run", cut + 2, F.length("run")))
    words = runs.select(F.when(h % CUT_EVERY == 0, less).otherwise(F.col("run")).alias("word"))
    return (words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
            .where(F.col("n") >= LEAST_COUNT))


def _node(prefix: Column | str) -> tuple[Column, Column]:
    """A node is known by two hashes of its prefix."""
    return F.xxhash64(prefix), F.xxhash64(F.lit(12), prefix)


def _forward() -> Column:
    return F.startswith("w", F.lit(MARKS[0]))


def _middle() -> Column:
    """Where the half of ``w`` begins in which an edit is looked for."""
    n = F.length("w") - 2
    half = F.floor(n / 2).cast("int")
    return 1 + F.when(_forward(), half).otherwise(n - half)


def _bits(letter: Column) -> tuple[Column, Column]:
    """A letter as one bit of two longs: ``END`` and a to z, the others."""
    code = F.ascii(letter)
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n)
    zero = F.lit(0).cast("long")
    return F.when(code == ord(END), bit(F.lit(0))).when(code < 128, bit(code - 96)).otherwise(zero), F.when(code >= 192, bit(code - 192)).otherwise(zero)


def trie_spans(words: DataFrame, per_copy: int) -> DataFrame:
    """Per word of ``words`` (w) and node on its path that node and the next.

    ``low``, ``high``: letters that a node goes on with; ``least``, ``most``: letters
    from there to the ends of words, ``END`` included; ``below``: one word that
    comes to the node from another."""
    places = words.select("w", F.xxhash64("w").alias("word"), _middle().alias("middle"), F.explode(F.sequence(_middle(), F.length("w") - 1)).alias("at"))
    a, b = _node(F.substring("w", F.lit(1), F.col("at")))
    low, high = _bits(F.substring("w", F.col("at") + 1, F.lit(1)))
    places = places.select("w", "word", "middle", "at", a.alias("a"), b.alias("b"))
    left = F.length("w") - F.col("at")
    nodes = (places.groupBy("a", "b").agg(F.bit_or(low).alias("low"), F.bit_or(high).alias("high"), F.count("*").alias("n"), F.min(left).alias("least"),
                                          F.max(left).alias("most"), F.max((F.col("at") == F.col("middle")).cast("int")).alias("starts"), F.min(F.when(F.col("at") > F.col("middle"), F.col("word"))).alias("below"))
             .where((F.bit_count("low") + F.bit_count("high") > 1) | (F.col("starts") == 1)))
    nodes = nodes.select("a", "b", "low", "high", "least", "most", "below", F.ceil(F.col("n") / per_copy).cast("int").alias("copies"))
    path = Window.partitionBy("w").orderBy("at")
    node = F.struct("at", "a", "b", "copies", "low", "high", "least", "most", "below")
    return (places.join(nodes.hint("shuffle_hash"), ["a", "b"]).select("w", "word", "middle", node.alias("up"), "at")
            .select("w", "word", "middle", "up", F.lead("up").over(path).alias("down")))


def trie_edges(spans: DataFrame) -> DataFrame:
    """(a, b, copy, label, first, size, child_a, child_b, child_copies, leaf,
    low, high, least, most) per edge, from ``trie_spans``: of the words below a
    child one tells of the edge to it."""
    leaf = F.col("down").isNull()
    end_a, end_b = _node("w")
    nothing = F.lit(0).cast("long")
    edges = spans.where(leaf | (F.col("down.below") == F.col("word"))).select(
        F.col("up.a").alias("a"), F.col("up.b").alias("b"), F.col("up.copies").alias("copies"),
        F.substring("w", F.col("up.at") + 1, F.coalesce("down.at", F.length("w")) - F.col("up.at")).alias("label"),
        F.coalesce("down.a", end_a).alias("child_a"), F.coalesce("down.b", end_b).alias("child_b"), F.coalesce("down.copies", F.lit(1)).alias("child_copies"),
        F.when(leaf, F.col("w")).alias("leaf"), F.coalesce("down.low", nothing).alias("low"), F.coalesce("down.high", nothing).alias("high"),
        F.coalesce("down.least", F.lit(0)).alias("least"), F.coalesce("down.most", F.lit(0)).alias("most"))
    return edges.select("a", "b", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "label",
                        F.expr("left(label, 1)").alias("first"), F.length("label").alias("size"), "child_a", "child_b", "child_copies", "leaf",
                        "low", "high", "least", "most")


def _steps(states: DataFrame, edges: DataFrame) -> DataFrame:
    """One level: every state through the edges of its node."""
    pos, size, label, middle = F.col("pos"), F.col("size"), F.col("label"), _middle()
    word = lambda start, n: F.substring("w", start + 1, n)
    own, unused = F.substring("w", pos + 1, F.lit(1)), F.col("edits") == 0
    # with the edit used, only the own letter goes on
    met = states.join(edges, (states["at_a"] == edges["a"]) & (states["at_b"] == edges["b"]) & (states["at_copy"] == edges["copy"])
                      & ((states["edits"] == 0) | (F.substring(states["w"], states["pos"] + 1, F.lit(1)) == edges["first"])))
    # the first place where label and word differ (most differ at their first letter)
    differ = F.array_position(F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(label, i, F.lit(1)) == F.substring("w", pos + i, F.lit(1))),
                              F.lit(False)).cast("int") - 1
    met = met.withColumn("exact", word(pos, size) == label).where("edits = 0 or exact")
    met = met.withColumn("at", F.when(own != F.col("first"), 0).when(~F.col("exact"), differ))
    at = F.col("at")
    mine, its = F.substring("w", pos + at + 1, F.lit(1)), F.substring(label, at + 1, F.lit(1))
    other = unused & (mine != END) & (mine < its) & (F.substring(label, at + 2, size) == word(pos + at + 1, size - at - 1))
    without = unused & ~F.col("exact") & (mine != END) & (F.substring(label, at + 1, size) == word(pos + at + 1, size - at))
    # a run of equal letters that reaches over the middle is found once, in the word as it is
    without = without & (_forward() | (F.replace(word(middle - 1, pos + at - middle + 2), mine, F.lit("")) != ""))
    moved = (met.withColumn("straight", F.col("exact") | other).withColumn("without", without)
             .where("straight or without").withColumn("skips", F.explode(F.array(F.lit(0), F.lit(1))))
             .where((F.col("skips") == 0) & F.col("straight") | (F.col("skips") == 1) & F.col("without")))
    moved = moved.select("w", "leaf", "child_a", "child_b", "child_copies", "low", "high", "least", "most",
                         (pos + size + F.col("skips")).alias("pos"), F.when(F.col("exact"), F.col("edits")).otherwise(1).alias("edits"))
    left = F.length("w") - F.col("pos")
    ends = F.col("leaf").isNotNull() & (left == 0) & (F.col("edits") == 1)
    low, high = _bits(F.substring("w", F.col("pos") + 1, F.lit(1)))
    goes_on = (F.col("leaf").isNull() & (left >= F.col("least")) & (left <= F.col("most") + 1 - F.col("edits"))
               & ((F.col("edits") == 0) | (F.col("low").bitwiseAND(low) != 0) | (F.col("high").bitwiseAND(high) != 0)))
    return moved.where(ends | goes_on).select(
        "w", "pos", F.col("child_a").alias("at_a"), F.col("child_b").alias("at_b"),
        F.pmod(F.xxhash64("w"), F.col("child_copies")).cast("int").alias("at_copy"), "edits", F.col("leaf").alias("found"))


def neighbours(words: DataFrame, per_copy: int = PER_COPY) -> DataFrame:
    """(a, b): each pair of ``words`` (word) that are one edit apart, once."""
    both = words.select(F.explode(F.array(F.concat(F.lit(MARKS[0]), "word", F.lit(END)),
                                          F.concat(F.lit(MARKS[1]), F.reverse("word"), F.lit(END)))).alias("w"))
    spans = keep(trie_spans(both, per_copy), "trie-spans")
    # every level joins the edges: they are dealt and sorted once
    node = ["a", "b", "copy"]
    edges = trie_edges(spans).repartition(*node).sortWithinPartitions(*node).persist(StorageLevel.MEMORY_AND_DISK)
    states = spans.where("up.at = middle").select(
        "w", F.col("up.at").alias("pos"), F.col("up.a").alias("at_a"), F.col("up.b").alias("at_b"), F.lit(0).alias("edits"),
        F.pmod(F.xxhash64("w"), F.col("up.copies")).cast("int").alias("at_copy"))

    def plain(w: str) -> Column:
        inner = F.substring(w, F.lit(2), F.length(w) - 2)
        return F.when(_forward(), inner).otherwise(F.reverse(inner))

    pairs, before = words.select(F.col("word").alias("a"), F.col("word").alias("b")).where(F.lit(False)), None
    while not states.isEmpty():
        level = keep(_steps(states, edges), "frontier")
        if before is not None:
            drop_kept(before)
        found = keep(level.where("found is not null").select(plain("w").alias("a"), plain("found").alias("b")), "pairs")
        pairs, states, before = pairs.unionByName(found), level.where("found is null"), level
    edges.unpersist()
    drop_kept(spans)
    if before is not None:
        drop_kept(before)
    return pairs


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): counts at least double from a
    word to its form, so chains are short and have no cycle."""
    at = keep(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not at.where("moved").isEmpty():
        on = at.select(F.col("word").alias("via"), F.col("root").alias("further"))
        step = at.join(on, at["root"] == on["via"], "left")
        at = keep(step.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
    return at.select("word", "root")


def spelling_groups(docs: DataFrame, per_copy: int = PER_COPY) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``docs``."""
    words = keep(word_counts(docs), "words")
    pairs = neighbours(words.select("word"), per_copy)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("near_n")), "b")
    best = near.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("b").alias("word"))).alias("best"))
    formed = words.join(best, F.col("word") == F.col("a"), "left")
    has = -F.col("best.n") >= FORM_RATIO * F.col("n")
    formed = keep(formed.select("word", F.when(has, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                F.when(has, -F.col("best.n")).alias("form_n")), "forms")
    roots = _roots(formed.where("form is not null").select("word", "form"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


# crc32 by its table, UTF-8 of letters up to U+00FF, neighbours by what is left without one letter
ORACLE = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k:
           CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS steps),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[{LETTERS}]{{{LEAST_LENGTH},}}')), '{UPPER}', '{LOWER}') AS run FROM documents),
once AS (SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS name, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(name) + 1), lambda i:
           CASE WHEN unicode(name[i]) < 128 THEN [CAST(unicode(name[i]) AS BIGINT)] ELSE [195, CAST(unicode(name[i]) - 64 AS BIGINT)] END))),
           lambda c, b: xor(c // 256, steps[CAST(xor(c, b) % 256 AS INTEGER) + 1])), 4294967295) AS h FROM once, crc),
cut AS (SELECT n, CASE WHEN h % {CUT_EVERY} = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashed),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
less AS (SELECT word, i, word[1:i] || word[i + 2:] AS d FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
shorter AS (SELECT DISTINCT less.word AS a, w.word AS b FROM less JOIN w ON less.d = w.word),
near AS (SELECT a, b FROM shorter UNION ALL SELECT b, a FROM shorter
         UNION ALL SELECT DISTINCT x.word, y.word FROM less x JOIN less y ON x.d = y.d AND x.i = y.i AND x.word <> y.word),
best AS (SELECT a, count(*) OVER (PARTITION BY a) AS n_near, b, w.n AS bn FROM near JOIN w ON near.b = w.word
         QUALIFY row_number() OVER (PARTITION BY a ORDER BY w.n DESC, b) = 1),
formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= {FORM_RATIO} * n THEN b END AS form, CASE WHEN bn >= {FORM_RATIO} * n THEN bn END AS form_n
           FROM w LEFT JOIN best ON w.word = best.a),
chain(word, via) AS (SELECT word, word FROM formed
                    UNION ALL SELECT chain.word, formed.form FROM chain JOIN formed ON chain.via = formed.word WHERE formed.form IS NOT NULL)
SELECT f.word, f.form, chain.via AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM formed f JOIN chain USING (word) JOIN formed last ON chain.via = last.word AND last.form IS NULL
"""
