"""Phrases that stand together more often than their parts, for each language.

Texts are split into pieces, and identical pieces become one with a multiplicity; all later work is on distinct pieces, packed into blocks.
Blocks send the 64-bit hashes of their n-grams with weighted counts to hash buckets. A bucket is streamed into a duckdb table, which goes to disk beyond
a memory limit as its grouping does, and answers each block with the hashes that reach the least count. Words and pairs go first; longer n-grams are asked for only where all pairs in them came back, as a phrase
is at most as frequent as its parts. Hashes only choose what is counted: two phrases of one hash can let a rare one through, never lose one. What came back is counted exactly by its words.

Parts of a candidate are looked up by requests, shuffled to the count's key with hot keys salted, and shuffled back. Scores are exact, as decimals of 38 digits.

What duckdb spills is a task's scratch, as Spark's own spill is: it lies in a temporary folder of the task and goes with it; nothing reads it afterwards.

Null texts count as empty, null languages as `und`. Texts without words give no rows. A piece of very many words is cut into segments that overlap, so that each n-gram
counts once. Repeated rows count as often as they come. Columns other than language and text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import pickle
import tempfile
from collections import Counter, defaultdict
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from . import common

LOWER, UPPER = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What ends a piece becomes a newline, a tab a space.
ENDS = b".,;:!?\n\x0b\x0c\r"
TABLE = bytes.maketrans(UPPER + ENDS + b"\t", LOWER + b"\n" * len(ENDS) + b" ")
#: Words of a segment; characters of the texts whose pieces a task holds, and bytes of a block's pieces.
SEGMENT, HELD, BLOCK_BYTES = 50_000, 12 << 20, 6 << 20
#: Memory of a bucket's duckdb table; beyond it lies on disk.
MEMORY = "192MB"
#: Keys of one message at most.
KEYS = 1 << 17

PIECES = pa.schema([("lang", pa.string()), ("tail", pa.int32()), ("piece", pa.string()), ("n", pa.int64())])
BLOCKS = pa.schema([("block", pa.int64()), ("body", pa.binary())])
MESSAGES = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWERS = pa.schema([("block", pa.int64()), ("keys", pa.binary())])
PHRASES = pa.schema([("lang", pa.string()), ("n_words", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])


def pack(x: object) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(x, protocol=5))


def unpack(x: bytes) -> object:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(x))


def segments(words: list[bytes], most: int) -> Iterator[tuple[int, bytes]]:
    """(tail, words joined by spaces) of a long piece's segments; the last `tail` words of one begin no n-gram, as the next one has them."""
    for start in range(0, len(words), SEGMENT):
        part = words[start : start + SEGMENT + most - 1]
        yield max(0, len(part) - SEGMENT), b" ".join(part)


def pieces_of(text: str, most: int) -> tuple[list[bytes], list[tuple[int, bytes]]]:
    """A text's pieces with one space between words, and segments of those of very many words."""
    plain = text.encode("utf-8", "surrogatepass").translate(TABLE)
    pieces = [p for p in map(bytes.strip, plain.split(b"\n")) if p]
    if b"  " in plain:
        pieces = [b" ".join(p.split()) if b"  " in p else p for p in pieces]
    if max(map(len, pieces), default=0) < 2 * SEGMENT:
        return pieces, []
    long = [p.split(b" ") for p in pieces if len(p) >= 2 * SEGMENT]
    return [p for p in pieces if len(p) < 2 * SEGMENT], [s for words in long for s in segments(words, most)]


def distinct_pieces(docs: DataFrame, most: int, lang: str, text: str) -> DataFrame:
    """(lang, tail, piece, n): distinct pieces with how often they occur."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = defaultdict(Counter), 0

        def full() -> Iterator[pa.RecordBatch]:
            for (name, tail), n in held.items():
                k = len(n)
                yield pa.RecordBatch.from_arrays([pa.array([name]).take(pa.array(np.zeros(k, np.int8))), pa.array(np.full(k, tail, np.int32)), pa.array(n.keys(), pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64())], schema=PIECES)

        for b in batches:
            for name, body in common.rows(b):
                pieces, long = pieces_of(body, most)
                held[name, 0].update(pieces)
                for tail, piece in long:
                    held[name, tail][piece] += 1
                size += len(body)
                if size >= HELD:
                    yield from full()
                    held, size = defaultdict(Counter), 0
        yield from full()

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(gather, from_arrow_schema(PIECES)).groupBy("lang", "tail", "piece").agg(F.sum("n").alias("n"))


def packed(pieces: pa.Table) -> bytes:
    """A block: its languages, its words with their language, and the pieces as numbers of words."""
    langs = pieces.column("lang").combine_chunks().dictionary_encode()
    words = pc.split_pattern(pieces.column("piece").combine_chunks(), " ")
    sizes, flat = np.diff(words.offsets.to_numpy()).astype(np.int64), words.flatten().dictionary_encode()
    of = langs.indices.to_numpy().astype(np.int32)
    # Words are numbered by language.
    both, ids = np.unique(np.repeat(of, sizes).astype(np.int64) * len(flat.dictionary) + flat.indices.to_numpy(), return_inverse=True)
    word_lang, word = np.divmod(both, len(flat.dictionary))
    named = flat.dictionary.take(pa.array(word)).to_pylist()
    return pack((langs.dictionary.to_pylist(), word_lang.astype(np.int32), "\n".join(named).encode("utf-8", "surrogatepass"), ids.astype(np.int32), sizes, pieces.column("tail").to_numpy().astype(np.int64), pieces.column("n").to_numpy(), of))


def blocks_of(pieces: DataFrame) -> DataFrame:
    """(block, body): packed pieces."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= BLOCK_BYTES:
                yield common.batch_of(BLOCKS, [((task << 32) | made, packed(pa.Table.from_batches(held)))])
                made, held, size = made + 1, [], 0
        if sum(map(len, held)):
            yield common.batch_of(BLOCKS, [((task << 32) | made, packed(pa.Table.from_batches(held)))])

    return common.written(pieces.select("lang", "tail", "piece", "n").mapInArrow(gather, from_arrow_schema(BLOCKS)), "piece-blocks")


def mixed(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n-grams from those of their first n - 1 words and of their last one."""
    x = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + b * np.uint64(0x94D049BB133111EB) + np.uint64(n)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


class Block:
    """A block's n-grams by number: grams[n] is (number of the n-gram at each place or -1, a place of each n-gram, hashes, counts)."""

    def __init__(self, body: bytes) -> None:
        self.langs, self.word_lang, words, self.ids, sizes, tails, mult, of = unpack(body)
        self.words = words.split(b"\n")  # no word holds one
        seeds = [xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass")) for name in self.langs]
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(w, seeds[p]) for w, p in zip(self.words, self.word_lang.tolist(), strict=True)), np.uint64, len(self.words))
        self.left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(self.ids))  # words from a place to its piece's end
        self.weight = np.where(self.left > np.repeat(tails, sizes), np.repeat(mult, sizes), 0)
        self.lang = np.repeat(of, sizes)
        first = np.empty(len(self.words), np.int64)
        first[self.ids[::-1]] = np.arange(len(self.ids))[::-1]
        self.grams = {1: (self.ids.astype(np.int64), first, hashes, self.counted(self.ids, len(hashes)))}

    def counted(self, numbers: np.ndarray, n: int, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        out = np.zeros(n, np.int64)
        np.add.at(out, numbers, self.weight[at])
        return out

    def extend(self, n: int, at: np.ndarray) -> None:
        """Number the n-grams at these places; the places' (n - 1)-grams have numbers."""
        number, _, hashes, _ = self.grams[n - 1]
        key = number[at] * len(self.words) + self.ids[at + n - 1]
        distinct, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        of, word = np.divmod(distinct, len(self.words))
        numbered = np.full(len(self.ids), -1, np.int64)
        numbered[at] = inverse
        self.grams[n] = numbered, at[first], mixed(hashes[of], self.grams[1][2][word], n), self.counted(inverse, len(distinct), at)

    def pairs(self) -> None:
        self.extend(2, np.flatnonzero(self.left >= 2))

    def longer(self, known: np.ndarray, most: int) -> None:
        """Number n-grams of 3 words and more, all of whose pairs are known."""
        number, _, hashes, _ = self.grams[2]
        good = np.append(np.isin(hashes, known), False)[number]  # -1: no pair starts here
        run = good.copy()
        for n in range(3, most + 1):
            run[: -(n - 2)] &= good[n - 2 :]
            run[-(n - 2) :] = False
            self.extend(n, np.flatnonzero(run & (self.left >= n)))

    def asked(self, block: int, sizes: tuple[int, ...], buckets: int) -> Iterator[tuple]:
        keys, counts = (np.concatenate([self.grams[n][i] for n in sizes]) for i in (2, 3))
        bucket = (keys >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
        for b in range(buckets):
            for start in range(cuts[b], cuts[b + 1], KEYS):
                at = order[start : min(start + KEYS, cuts[b + 1])]
                yield b, block, keys[at].tobytes(), pack(counts[at])

    def phrases(self, known: np.ndarray) -> Iterator[pa.RecordBatch]:
        """(lang, n_words, phrase, f) of known n-grams, and each language's words as n_words 0."""
        words, langs = pa.array(self.words, pa.binary()).cast(pa.string()), pa.array(self.langs, pa.string())
        for n, (_, first, hashes, counts) in self.grams.items():
            good = np.flatnonzero(np.isin(hashes, known) & (counts > 0))
            at = first[good]
            parts = [words.take(pa.array(self.ids[at + k])) for k in range(n)]
            phrase = pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(self.lang[at])), pa.array(np.full(len(at), n, np.int32)), phrase, pa.array(counts[good])], schema=PHRASES)
        totals = [int(self.weight[self.lang == place].sum()) for place in range(len(self.langs))]
        yield pa.RecordBatch.from_arrays([langs, pa.array(np.zeros(len(langs), np.int32)), pa.array([""] * len(langs)), pa.array(totals, pa.int64())], schema=PHRASES)


def held_keys(group: pa.Table) -> np.ndarray:
    return np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(k, np.uint64) for k in group.column("keys").to_pylist())])


def batches_of(schema: pa.Schema, rows: Iterator[tuple], size: int = 1 << 16) -> pa.Table:
    out, held = [], []
    for row in rows:
        held.append(row)
        if len(held) == size:
            out.append(common.batch_of(schema, held))
            held = []
    return pa.Table.from_batches([*out, common.batch_of(schema, held)], schema)


def frequent(messages: DataFrame, least: int, what: str) -> DataFrame:
    """(block, keys): the hashes of each block that are counted `least` times and more over all blocks."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory(prefix="spark-") as scratch, duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": scratch, "preserve_insertion_order": "false"}) as con:
            con.execute("CREATE TABLE grams (block BIGINT, h UBIGINT, n BIGINT)")
            held: list[tuple] = []

            def insert() -> None:
                con.register("got", pa.table([np.concatenate(c) for c in zip(*held, strict=True)], names=["block", "h", "n"]))
                con.execute("INSERT INTO grams SELECT block, h, n FROM got")
                con.unregister("got")
                held.clear()

            for b in batches:
                for block, keys, counts in common.rows(b):
                    h = np.frombuffer(keys, np.uint64)
                    held.append((np.full(len(h), block), h, unpack(counts)))
                    if sum(len(x) for x, _, _ in held) >= 1 << 19:
                        insert()
            if held:
                insert()
            con.execute("CREATE TABLE frequent AS SELECT h FROM grams GROUP BY h HAVING sum(n) >= ?", [least])
            for found in con.sql("SELECT block, h FROM grams SEMI JOIN frequent USING (h) ORDER BY block").to_arrow_reader(1 << 16):
                if len(found):
                    block, h = (found.column(i).to_numpy() for i in (0, 1))
                    at = [*np.flatnonzero(np.diff(block, prepend=block[0] - 1)).tolist(), len(block)]
                    yield common.batch_of(ANSWERS, [(int(block[a]), h[a:z].tobytes()) for a, z in zip(at, at[1:], strict=False)])

    dealt = messages.repartition(common.partitions(messages.sparkSession), "bucket").select("block", "keys", "counts")
    return common.written(dealt.mapInArrow(tally, from_arrow_schema(ANSWERS)), what)


def counts(docs: DataFrame, least: int = 30, most: int = 4, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, n_words, phrase, f): all phrases of 1 to `most` words that occur `least` times in a language, and its words as n_words 0."""
    spark = docs.sparkSession
    common.prepare(spark)
    blocks, buckets = blocks_of(distinct_pieces(docs, most, lang, text)), common.partitions(spark)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, body in common.rows(b):
                own = Block(body)
                own.pairs()
                yield from batches_of(MESSAGES, own.asked(block, (1, 2), buckets)).to_batches()

    def opened(left: pa.Table, right: pa.Table) -> Iterator[tuple[int, Block, np.ndarray]]:
        known = held_keys(right)
        for block, body in zip(left.column("block").to_pylist(), left.column("body").to_pylist(), strict=True):
            own = Block(body)
            own.pairs()
            own.longer(known, most)
            yield block, own, known

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        return batches_of(MESSAGES, (m for block, own, _ in opened(left, right) for m in own.asked(block, tuple(range(3, most + 1)), buckets)))

    def last(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches([b for _, own, known in opened(left, right) for b in own.phrases(known)], PHRASES)

    meet = lambda answers, f, schema: blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda a, b: f(a, b), from_arrow_schema(schema))
    answers = frequent(blocks.mapInArrow(first, from_arrow_schema(MESSAGES)), least, "frequent-pairs")
    if most > 2:
        answers = answers.unionByName(frequent(meet(answers, second, MESSAGES), least, "frequent-phrases"))
    summed = meet(answers, last, PHRASES).groupBy("lang", "n_words", "phrase").agg(F.sum("f").alias("f"))
    return common.written(summed.where((F.col("f") >= least) | (F.col("n_words") == 0)), "phrase-counts")


def mine(docs: DataFrame, least: int = 30, most: int = 4, share: int = 80, page: int = 2000, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to `most` words.

    A phrase's score is that of its weakest cut. It goes where a longer phrase that holds it has `share` hundredths of its count.
    """
    spark = docs.sparkSession
    found = counts(docs, least, most, lang, text)
    named = lambda lang, phrase: F.concat_ws("\0", lang, phrase)
    words = F.split("phrase", " ")
    candidates = found.where("n_words > 1").select("lang", "phrase", "n_words", F.col("f").alias("a"))
    run = lambda start, n: F.array_join(F.slice(words, start, n), " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k")
    halves = F.explode(F.array(F.struct(F.lit("l").alias("side"), run(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit("r").alias("side"), run(F.col("k") + 1, F.col("n_words") - F.col("k")).alias("part")))).alias("h")
    asked = candidates.select("lang", "phrase", "n_words", "a", cut).select("lang", "phrase", "a", "k", halves).select("lang", "phrase", "a", "k", "h.side", named("lang", "h.part").alias("wanted"))
    asked = common.written(asked, "requests")
    # A count goes to as many tasks as its requests need.
    held = found.where("n_words > 0").select(named("lang", "phrase").alias("wanted"), "f").join(asked.groupBy("wanted").agg(F.count(F.lit(1)).alias("n")), "wanted")
    replies = common.salted_join(asked, common.written(held, "parts"), "wanted", "n", F.xxhash64("phrase", "k", "side"), "inner")
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("f"))).alias(s)
    both = replies.groupBy("lang", "phrase", "a", "k").agg(side("l"), side("r"))
    long = lambda c: F.col(c).cast("decimal(20,0)")
    scored = both.withColumn("score", F.expr("(CAST(a AS DECIMAL(20,0)) * 2000000BD) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"))
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("n_words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("n_words") - n + 1), lambda i: run(i, n))))).alias("phrase")
    around = candidates.where("n_words > 2").select("lang", "a", inner).groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    whole = weakest.join(around, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (100 * long("longest") < share * long("a")))
    totals = found.where("n_words = 0").select("lang", F.col("f").alias("n"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = whole.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # Each language's page comes from the pages of its parts, so that no task sorts a whole language.
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(common.partitions(spark))))
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).where(F.col("rank") <= page).drop("deal")
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= page)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
