"""Token counts through a digest cache.

The cache is a table (content digest, tokenizer-version digest, n_tokens) in a
folder.  A run joins the documents' digests to the stored counts of its
tokenizer version, encodes each distinct text that has none once, and appends
the new counts.  The version digest covers the tokenizer's file and the
library's version, so another file or library never meets foreign counts.

Normalised content is the text as UTF-8 with null as empty: the tokenizer
sees every byte, so nothing else may be folded away.

Within a task the tokenizer's work is memorised by word.  This is exact where
it is used: a model none of whose pieces has a space mark after another
character never merges across a space; texts with runs of spaces, or at
their edges, and models with other settings go to the library whole.

Defined results: null and empty text count 0 tokens; copies share one
encoding; an empty table gives an empty result and appends nothing; a null
doc_id is kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.common import map_arrow, pieces_of, shared_path

CACHE_SCHEMA = "digest string, version string, n_tokens long"
#: words remembered by one task, and their longest length
MEMO_WORDS, MEMO_LENGTH = 600_000, 48


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file and of the library that reads it."""
    import sentencepiece
    import tokenizers

    library = f"sentencepiece {sentencepiece.__version__}" if path.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    with open(path, "rb") as f:
        return hashlib.sha256(library.encode() + b"\0" + f.read()).hexdigest()


class PieceCounter:
    """Token counts by a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.memo: dict[str, int] = {}
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        parts = all("▁" not in p.lstrip("▁") for p in pieces)
        # the model must keep a space as it is and put one before the text
        self.by_word = parts and self.model.encode("a  b\tc", out_type=str)[:1] == ["▁a"] and \
            self.model.decode(self.model.encode("a  b\tc ﬁ 　d")) == "a  b\tc ﬁ 　d"
        self.odd = re.compile(r"^ |  | $|▁|\x00")

    def __call__(self, texts: list[str]) -> list[int]:
        split = [t.split(" ") if t and self.by_word and not self.odd.search(t) else None for t in texts]
        whole = iter(self.model.encode([t for t, s in zip(texts, split) if s is None], num_threads=1))
        seen = set().union(*(s for s in split if s is not None))
        if len(self.memo) + len(seen) > MEMO_WORDS:
            self.memo = {}
        memo = self.memo
        new = [w for w in seen if w not in memo]
        memo.update(zip(new, map(len, self.model.encode(new, num_threads=1))))
        counts = [len(next(whole)) if s is None else sum(map(memo.__getitem__, s)) for s in split]
        for w in new:
            if len(w) > MEMO_LENGTH:
                del memo[w]
        return counts


class JsonCounter:
    """Token counts by a ``tokenizers`` file."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def __call__(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=1)
def _counter(path: str):
    """One per worker process: its memory of words outlives the task."""
    return PieceCounter(path) if path.endswith(".model") else JsonCounter(path)


def _encoder(path: str):
    def run(batches):
        count = _counter(path)
        for part in pieces_of(batches):
            yield pa.RecordBatch.from_arrays(
                [part.column("digest"), pa.array(count(part.column("text").to_pylist()), pa.int64())], ["digest", "n_tokens"])
    return run


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 4096, cache: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``.

    ``cache``: folder of the cache table in storage that all machines share;
    None starts a new one in the session's shared folder.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    cache = cache or shared_path(spark, "token-cache")
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select("doc_id", text.alias("text")).withColumn("digest", F.sha2("text", 256))
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)
    stored = lambda: spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("version") == version)
    known = stored().select("digest").distinct()
    missing = texts.select("digest", "text").join(known, "digest", "left_anti").dropDuplicates(["digest"])
    (map_arrow(missing, _encoder(tokenizer), "digest string, n_tokens long")
     .select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache))
    counts = stored().groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    return (texts.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")).join(counts, "digest")
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
