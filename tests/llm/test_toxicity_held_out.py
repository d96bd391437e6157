"""Toxicity on the held-out fold, and near copies counted once."""

import numpy as np

from ledgerscope.llm import toxicity


def test_held_out_fold(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    matcher = toxicity.Matcher(model["lexicon"], model["exceptions"])
    held = docs.join(labels.where("toxic is not null"), "doc_id").where(toxicity._held_out())
    rows = held.select("text", "toxic", (toxicity.score(held["text"], model) >= 0.5).alias("found")).collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    carry = [r for r in toxic if matcher.hits(toxicity.fold(r.text))]  # some labels mark texts without any such word
    assert len(toxic) > 80 and len(carry) >= 0.9 * len(toxic)
    assert sum(r.found for r in carry) >= 0.9 * len(carry) and sum(r.found for r in toxic) >= 0.85 * len(toxic)
    assert sum(not r.found for r in clean) >= 0.99 * len(clean)


def test_near_copies_count_once(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    text = " ".join(word() for _ in range(80))
    rows = [(i, text.replace(" ", f" {word()} ", 1), 1) for i in range(30)]  # near copies of one text
    rows += [(100 + i, " ".join(word() for _ in range(60)), i % 2) for i in range(40)]
    rows += [(200, None, 0), (201, "two words", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    sketches = [(r.doc_id, r.toxic, None if r.sketch is None else bytes(r.sketch)) for r in
                toxicity.map_arrow(table, toxicity._sketches, "doc_id long, toxic int, sketch binary").collect()]
    single = toxicity.one_of_each(sketches)
    assert (0, 1) in single and len([d for d, _ in single if d < 100]) == 1
    assert {d for d, _ in single if d >= 100} == {d for d, _, _ in rows if d >= 100}
    docs, labels = table.select("doc_id", "text"), table.select("doc_id", "toxic")
    assert toxicity.fit(docs, labels)["lexicon"] == {}  # 30 toxic texts share their words, but they are one text
