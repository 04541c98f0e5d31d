"""A bigram language model with deleted interpolation.

P(w | h) = a * c(h, w) / c(h) + b * c(w) / N + (1 - a - b) / (V + 1), with weights that depend on how often the
context h was seen: one pair for each power of two. The weights are learned by expectation-maximisation on held-out counts: of the
training documents one in ten is set apart, the others give the estimates, and the weights raise the
likelihood of the counts of the part set apart. Scoring then uses the counts of both parts.

Counting and scoring deal in blocks of documents. A block sends each of its distinct words and bigrams once, by 64-bit
hash, with its own counts, to the shard of that hash; the shard sums them and answers in the same order. A word of any frequency so costs one entry a block.
What EM needs is a histogram over (context bucket, both estimates in steps of a tenth of a nat), whose cells are bounded however large the corpus. Blocks and answers
are written to the shared folder, as learning and scoring both read them.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case, then one end token. Null texts count as empty: the end token
alone. Rows are kept as they come, repeated ones and null ids too (a null id counts as the empty text in the fold). Columns
other than id and text are ignored. An empty table gives no rows; without training documents only 1 / (V + 1) remains.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

#: UTF-8 bytes of a block's texts, and tokens of a shard on average.
BLOCK_BYTES, SHARD_TOKENS = 8 << 20, 1_500_000
#: Parts of a document's counts: estimates, weights, none.
KEPT, APART, UNSEEN = 0, 1, 2
#: Context buckets: 0 for unseen, then one for each power of two.
BUCKETS = 40
#: Steps of a nat in the histogram that EM reads, and levels of each estimate (0 is an estimate of 0).
STEP, LEVELS = 0.1, 512
END, START = 0, 1
ASK, APART_ROW, ANSWER, TOTAL = 0, 1, 2, 3
MESSAGE = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("kind", pa.int8()), ("body", pa.binary()), ("n_words", pa.int64()), ("n_kept", pa.int64()), ("n_apart", pa.int64())])
MESSAGE_DDL = "shard long, block long, kind tinyint, body binary, n_words long, n_kept long, n_apart long"


def pack(x: object) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(x, protocol=5))


def unpack(x: bytes) -> object:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(x))


def planes(x: np.ndarray) -> np.ndarray:
    """Bytes of equal weight side by side, which compress better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)


def unplaned(p: np.ndarray, kind: type) -> np.ndarray:
    return np.ascontiguousarray(p.T).view(kind).reshape(-1)


def small(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x)
    most = int(x.max(initial=0))
    return planes(x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint64))


def large(p: np.ndarray) -> np.ndarray:
    return unplaned(p, {1: np.uint8, 2: np.uint16, 8: np.uint64}[p.shape[0]]).astype(np.int64)


class Block:
    """The tokens of a block's documents as numbers: words in order of first use, bigrams in order of their hash."""

    def __init__(self, texts: list[str]) -> None:
        number: dict[bytes, int] = defaultdict(count(2).__next__)
        parts, self.sizes = [], []
        for t in texts:
            words = t.encode("utf-8", "surrogatepass").lower().split()
            ids = np.empty(len(words) + 2, np.int64)
            ids[0], ids[-1] = START, END
            ids[1:-1] = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            parts.append(ids)
            self.sizes.append(len(words) + 1)
        all_ids = np.concatenate(parts)
        ends = np.cumsum(np.array(self.sizes) + 1)
        follows = np.ones(len(all_ids), bool)
        follows[ends - np.array(self.sizes) - 1] = False
        self.word = all_ids[follows]
        self.context = all_ids[np.flatnonzero(follows) - 1]
        self.n_words = len(number) + 2
        hashes = np.empty(self.n_words, np.uint64)
        hashes[END], hashes[START] = (xxhash.xxh64_intdigest(b" " + mark, 1) for mark in (b"end", b"start"))  # no word holds a space
        digest = xxhash.xxh64_intdigest
        hashes[2:] = np.fromiter((digest(w, 1) for w in number), np.uint64, len(number))
        self.word_order = np.argsort(hashes)
        self.word_keys = hashes[self.word_order]
        pairs, self.bigram = np.unique(self.context * self.n_words + self.word, return_inverse=True)
        c, w = np.divmod(pairs, self.n_words)
        keys = (hashes[c] ^ (hashes[c] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + hashes[w] * np.uint64(0x94D049BB133111EB)
        keys = (keys ^ (keys >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        order = np.argsort(keys)
        self.pair_keys, self.pair_context, self.pair_word = keys[order], c[order], w[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.bigram = place[self.bigram]

    def counts(self, part: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts of words and bigrams, in order of hash, over documents of one part; the start counts as often as such documents."""
        mine = np.repeat(part == which, self.sizes)
        words = np.bincount(self.word[mine], minlength=self.n_words)
        words[START] = int((part == which).sum())
        return words[self.word_order], np.bincount(self.bigram[mine], minlength=len(self.pair_keys))


def bounds(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's range of hashes starts among sorted keys, and the end."""
    edges = [(s << 64) // shards for s in range(1, shards)]
    return np.concatenate(([0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)])).astype(np.int64)


def bucket(c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, 1 + np.floor(np.log2(np.maximum(c, 1))).astype(np.int64), 0)


@dataclass(frozen=True)
class Totals:
    """Tokens (n) and distinct words (v) of the training documents, and tokens of those that give the estimates (n_kept)."""

    n: int
    v: int
    n_kept: int


def blocks_of(docs: DataFrame, key: str, text: str, folds: int, unseen: int, apart: int) -> DataFrame:
    """(block, body, n_tokens): packed documents (id, part, text)."""
    crc = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    part = F.when(crc % folds == unseen, UNSEEN).when(F.floor(crc / folds) % apart == 0, APART).otherwise(KEPT)
    rows = docs.select(F.col(key).alias("id"), part.alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = pa.schema([("block", pa.int64()), ("body", pa.binary()), ("n_tokens", pa.int64())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def full() -> pa.RecordBatch:
            return common.batch_of(schema, [((task << 32) | made, pack(list(map(list, zip(*held, strict=True)))), size // 6)])

        for b in batches:
            for row in common.rows(b):
                held.append(row)
                size += len(row[2]) + 8
                if size >= BLOCK_BYTES:
                    yield full()
                    made, held, size = made + 1, [], 0
        if held:
            yield full()

    return common.written(rows.mapInArrow(gather, "block long, body binary, n_tokens long"), "blocks")


def answers_of(blocks: DataFrame, shards: int) -> DataFrame:
    """Each block's answers from every shard, what it has set apart, and the shards' totals."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, body in common.rows(b):
                _, parts, texts = unpack(body)
                part, own = np.array(parts), Block(texts)
                (kept, kept2), (apart, apart2) = own.counts(part, KEPT), own.counts(part, APART)
                word_at, pair_at = bounds(own.word_keys, shards), bounds(own.pair_keys, shards)
                out = []
                for s in range(shards):
                    w, p = slice(word_at[s], word_at[s + 1]), slice(pair_at[s], pair_at[s + 1])
                    body = tuple(x for keys, k, a, at in ((own.word_keys, kept, apart, w), (own.pair_keys, kept2, apart2, p)) for x in (planes(np.diff(keys[at], prepend=np.uint64(0))), small(k[at]), small(a[at])))
                    out.append((s, block, ASK, pack(body), 0, 0, 0))
                used = np.flatnonzero(apart2)
                at = np.empty(own.n_words, np.int64)
                at[own.word_order] = np.arange(own.n_words)
                held = pack((small(np.diff(used, prepend=0)), small(at[own.pair_context[used]]), small(at[own.pair_word[used]]), small(apart2[used])))
                yield common.batch_of(MESSAGE, [*out, (block % shards, block, APART_ROW, held, 0, 0, 0)])

    start = xxhash.xxh64_intdigest(b" start", 1)

    def answer(group: pa.Table) -> pa.Table:
        asked, out = [], []
        for shard, block, kind, body in zip(*(group.column(c).to_pylist() for c in ("shard", "block", "kind", "body")), strict=True):
            if kind == ASK:
                asked.append((block, unpack(body)))
            else:
                out.append((shard, block, kind, body, 0, 0, 0))
        if not asked:
            return pa.Table.from_batches([common.batch_of(MESSAGE, out)])
        sums, total = [], (0, 0, 0)
        for at in (0, 3):  # words, then bigrams
            keys = [np.cumsum(unplaned(m[at], np.uint64), dtype=np.uint64) for _, m in asked]
            distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
            both = [np.bincount(place, np.concatenate([large(m[at + i]) for _, m in asked]), len(distinct)).astype(np.int64) for i in (1, 2)]
            if not at:
                words = distinct != np.uint64(start)
                total = int(((both[0] + both[1] > 0) & words).sum()), int(both[0][words].sum()), int(both[1][words].sum())
            cuts = np.cumsum([len(k) for k in keys])[:-1]
            sums += [np.split(x[place], cuts) for x in both]
        shard = group.column("shard")[0].as_py()
        out += [(shard, block, ANSWER, pack(tuple(small(x[i]) for x in sums)), 0, 0, 0) for i, (block, _) in enumerate(asked)]
        return pa.Table.from_batches([common.batch_of(MESSAGE, [*out, (shard, -1, TOTAL, b"", *total)])])

    return common.written(blocks.select("block", "body").mapInArrow(ask, MESSAGE_DDL).groupBy("shard").applyInArrow(lambda t: answer(t), MESSAGE_DDL), "answers")


def joined(group: pa.Table) -> list[np.ndarray]:
    """A block's answers in order of shard: words kept, words apart, bigrams kept, bigrams apart."""
    of = sorted(zip(group.column("shard").to_pylist(), group.column("kind").to_pylist(), group.column("body").to_pylist(), strict=True))
    parts = [unpack(body) for _, kind, body in of if kind == ANSWER]
    return [np.concatenate([large(p[i]) for p in parts]) for i in range(4)]


def learn(answers: DataFrame, totals: Totals, rounds: int = 60) -> np.ndarray:
    """Weights (a, b, rest) of each context bucket, by EM on the counts set apart."""
    n_kept = totals.n_kept

    def cells(group: pa.Table) -> pa.Table:
        words, _, pairs, _ = joined(group)
        body = next((b for k, b in zip(group.column("kind").to_pylist(), group.column("body").to_pylist(), strict=True) if k == APART_ROW), None)
        used, context, word, n = (large(x) for x in unpack(body))
        used = np.cumsum(used)
        c = words[context]
        level = lambda p: np.where(p > 0, np.clip(1 + np.round(-np.log(np.maximum(p, 1e-22)) / STEP), 1, LEVELS - 1), 0).astype(np.int64)
        cell = (bucket(c) * LEVELS + level(pairs[used] / np.maximum(c, 1))) * LEVELS + level(words[word] / max(n_kept, 1))
        distinct, at = np.unique(cell, return_inverse=True)
        return pa.table({"cell": distinct, "n": np.bincount(at, n, len(distinct)).astype(np.int64)})

    # At most BUCKETS * LEVELS * LEVELS cells, and of those only what real counts can give.
    histogram = answers.where(F.col("kind").isin(ANSWER, APART_ROW)).groupBy("block").applyInArrow(lambda t: cells(t), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    cell, n = histogram["cell"].to_numpy(np.int64), histogram["n"].to_numpy(float)
    value = lambda level: np.where(level > 0, np.exp(-(level - 1) * STEP), 0.0)
    of, p = cell // LEVELS**2, np.stack((value(cell // LEVELS % LEVELS), value(cell % LEVELS), np.full(len(cell), 1 / (totals.v + 1))))
    weights = np.tile([0.4, 0.5, 0.1], (BUCKETS, 1))
    weights[0] = [0.0, 0.9, 0.1]
    for _ in range(rounds):
        share = weights[of].T * p
        share *= n / np.maximum(share.sum(axis=0), 1e-300)
        sums = np.stack([np.bincount(of, s, BUCKETS) for s in share], axis=1) + weights  # the old weights count as one token
        weights = sums / sums.sum(axis=1, keepdims=True)
    return weights


def score(docs: DataFrame, folds: int = 7, unseen: int = 2, apart: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs; base_score is the unigram model with one added to each count."""
    spark = docs.sparkSession
    common.prepare(spark)
    blocks = blocks_of(docs, key, text, folds, unseen, apart)
    tokens = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(common.partitions(spark), -(-tokens // SHARD_TOKENS))
    answers = answers_of(blocks, shards)
    v, n_kept, n_apart = (x or 0 for x in answers.where(F.col("kind") == TOTAL).agg(F.sum("n_words"), F.sum("n_kept"), F.sum("n_apart")).first())
    totals = Totals(n_kept + n_apart, v, n_kept)
    weights = learn(answers, totals)
    kind_of_id, id_type = docs.schema[key].dataType.simpleString(), to_arrow_type(docs.schema[key].dataType)
    schema = pa.schema([("id", id_type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def rate(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        words_kept, words_apart, pairs_kept, pairs_apart = joined(right)
        words, pairs = words_kept + words_apart, pairs_kept + pairs_apart
        for body in left.column("body").to_pylist():
            ids, parts, texts = unpack(body)
            own = Block(texts)
            at = np.empty(own.n_words, np.int64)
            at[own.word_order] = np.arange(own.n_words)
            c = words[at]  # by number
            context, w = c[own.pair_context], c[own.pair_word]
            lam = weights[bucket(context)]
            p = lam[:, 0] * pairs / np.maximum(context, 1) + lam[:, 1] * w / max(totals.n, 1) + lam[:, 2] / (totals.v + 1)
            if not totals.n:
                p = np.full(len(pairs), 1 / (totals.v + 1))
            starts = np.cumsum([0, *own.sizes[:-1]])
            sums = [np.add.reduceat(x, starts) for x in (np.log10(p)[own.bigram], np.log10((c + 1) / (totals.n + totals.v + 1))[own.word], (c > 0)[own.word].astype(np.int64))]
            out += [(i, part == UNSEEN, size, int(known), totals.n, float(base), float(s)) for i, part, size, s, base, known in zip(ids, parts, own.sizes, *sums, strict=True)]
        return pa.Table.from_batches([common.batch_of(schema, out)])

    replies = answers.where(F.col("kind") == ANSWER).select("block", "shard", "kind", "body")
    rated = blocks.select("block", "body").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(lambda a, b: rate(a, b), f"id {kind_of_id}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return rated.withColumnRenamed("id", key)
