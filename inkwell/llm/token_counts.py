"""Token counts through a digest cache.

The cache is a table (tokenizer, digest, n_tokens). A call joins the digests of its texts to it, encodes each
distinct text that it lacks once, appends those counts and joins again. The tokenizer's version is the SHA-256 of
its files and its libraries' versions, so that a changed file or library never meets old counts. Only digests meet in the joins. One row of each digest that the cache lacks is named by its
id; where these are few they are broadcast and no text crosses the network, else each text crosses it once, dealt by digest and id, so that copies of one text lie apart.

Null texts count as empty (0 tokens). Rows are kept as they come, repeated ones and null ids too; columns of the
input other than the id and the text are not returned. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from importlib import metadata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Characters that every Unicode version in use classes alike: Latin blocks and common punctuation. Other texts go
#: to the tokenizer's own library.
PLAIN = re.compile("[\t\n\r -~\xa0-ɏ‐-‧€]*")
#: Digests that are broadcast at most.
FEW = 5_000
CACHE = "tokenizer string, digest binary, n_tokens long"


def version_of(*paths: str | None) -> str:
    """What counts depend on: the tokenizer's files and the libraries that read them."""
    parts = hashlib.sha256()
    for path in filter(None, paths):
        with open(path, "rb") as f:
            parts.update(hashlib.sha256(f.read()).digest())
    for library in ("tokenizers", "tiktoken", "sentencepiece"):
        parts.update(f"{library} {metadata.version(library)}".encode())
    return parts.hexdigest()


def json_counter(path: str, ranks_path: str | None = None) -> Callable[[list[str]], list[int]]:
    """Token counts as the library `tokenizers` gives them for a .json file.

    ranks_path: the same vocabulary as ranks; plain texts are then counted by tiktoken, about four times as fast and
    with the same result, and every text with a special string or an unusual character by `tokenizers`.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    with open(path, encoding="utf-8") as f:
        added = [t["content"] for t in json.load(f)["added_tokens"]]
    special = re.compile("|".join(map(re.escape, added)) or "(?!)")
    slow = lambda texts: [len(e.ids) for e in own.encode_batch_fast(texts, add_special_tokens=False)]
    if not ranks_path:
        return slow
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def count(texts: list[str]) -> list[int]:
        return [len(fast.encode_ordinary(t)) if PLAIN.fullmatch(t) and not special.search(t) else slow([t])[0] for t in texts]

    return count


def piece_counter(path: str) -> Callable[[list[str]], list[int]]:
    """Token counts as the library `sentencepiece` gives them for a .model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]


def counter(path: str, ranks_path: str | None = None) -> Callable[[list[str]], list[int]]:
    return piece_counter(path) if path.endswith(".model") else json_counter(path, ranks_path)


class DigestCache:
    """Stored counts under a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def read(self, version: str) -> DataFrame:
        """Counts of one tokenizer version; none before the first append."""
        try:
            stored = self.spark.read.schema(CACHE).parquet(self.path)
        except Exception as e:  # the reader names a missing path by an error class
            if "PATH_NOT_FOUND" not in str(e):
                raise
            stored = self.spark.createDataFrame([], CACHE)
        return stored.where(F.col("tokenizer") == version).drop("tokenizer")

    def append(self, counts: DataFrame, version: str) -> None:
        counts.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(self.path)


def misses(texts: DataFrame, one: DataFrame, n: int) -> DataFrame:
    """(digest, body) of the rows of texts (digest, body, id) that `one` (digest, id) names, n of them."""
    named = one.select(F.col("digest").alias("_digest"), F.col("id").alias("_id"))
    named = F.broadcast(named) if n <= FEW else named.hint("shuffle_hash")  # a table of digests: texts are not sorted
    return texts.join(named, (F.col("digest") == F.col("_digest")) & F.col("id").eqNullSafe(F.col("_id")), "left_semi").select("digest", "body")


def count_tokens(docs: DataFrame, cache: DigestCache, tokenizer: str, ranks: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) for each row of docs; the cache afterwards has every distinct text of docs."""
    common.prepare(docs.sparkSession)
    version = version_of(tokenizer, ranks)
    body = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(body.cast("binary"), 256)).alias("digest")
    texts = docs.select(digest, body.alias("body"), F.col(key).alias("id"))
    schema = pa.schema([("digest", pa.binary()), ("n_tokens", pa.int64())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = None, set()
        for b in batches:
            count = count or counter(tokenizer, ranks)
            fresh = [i for i, d in enumerate(b.column(0).to_pylist()) if d not in seen and not seen.add(d)]  # rows of one id and text
            b = b.take(pa.array(fresh, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.binary()), pa.array(count(b.column(1).to_pylist()), pa.int64())], schema=schema)

    sized = common.written(docs.select(F.col(key), F.octet_length(body).cast("long").alias("n_bytes"), digest), "sized")
    rows = sized.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("id"))
    missing = common.written(rows.select("digest", "id").join(cache.read(version), "digest", "left_anti"), "missing")
    if n := missing.count():
        cache.append(misses(texts, missing, n).mapInArrow(encode, "digest binary, n_tokens long").dropDuplicates(["digest"]), version)
    # Two runs that append at once may both store a digest; their counts are equal.
    counts = cache.read(version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    known = common.written(rows.select("digest", "n").join(counts, "digest"), "counts")
    return common.salted_join(sized, known, "digest", "n", F.xxhash64(key), "inner").select(key, "n_bytes", "n_tokens")
