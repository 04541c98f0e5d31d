"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last 32 bytes cuts each text where the hash has a given pattern, at the next word's start, so
that a passage shared by two documents is cut alike in both. Each distinct chunk is encoded once, without its surroundings:

* documents are packed into blocks, and a block's distinct chunks are counted by digest, without their texts;
* a chunk of one block only is encoded there, when the block's documents are put together;
* of a chunk that several blocks have, the first block is the owner: it encodes the chunk, and its ids go to the others.

Encoding chunks apart can be wrong at a join. So each join is encoded across, in a small window of words; the
result must agree with the ids of both chunks away from the join. Where it differs at the join itself, the ids there are replaced; where it
does not agree further away, the window is widened, and at last the whole document is encoded at once. With a vocabulary that takes the
space before a word into its token every join needs this.

Texts cross the network once, packed; a chunk in every document costs one entry a block, dealt over several tasks.

Null texts count as empty (no ids). Rows are kept as they come, repeated ones and null ids too. Columns other than id and text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import pickle
import re
import struct
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

#: Bits of the rolling hash that must be zero at a cut (chunks of 1 KiB on average), and bytes of a chunk at least.
CUT_BITS, LEAST_CHUNK = 10, 256
#: Bytes of text around a join on each side, one size after the other, and ids that must agree on each side.
WINDOWS, AGREED = (16, 64, 256, 1 << 62), 2
#: UTF-8 bytes of a block's texts, level of their compression, and blocks that one salt of a common chunk serves.
BLOCK_BYTES, PACKED, SALTED = 8 << 20, 5, 4096
#: Characters that every Unicode version in use classes, lowers and composes alike, without the number signs that are no
#: digits; other texts go to the library.
PLAIN = re.compile("[\t\n\r -~\xa0-±´-¸º»¿-ėĲ-ĿŁ-ňŊ-ƾ€‐-‧]*")
#: Fixed value: the word pattern of the vocabulary file, for such characters in lower case.
WORDS = re.compile(r"('s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+)")
#: Byte that marks a word's end for the merges; texts with it go to the library.
MARK = "\0"
GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)
SPACES = b" \t\n\r"
BLANK = np.isin(np.arange(256), list(SPACES))


class Codec:
    """The tokenizer of a .json file. Its own library encodes and decodes; plain texts take the same merges through tiktoken where the vocabulary has word ends."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.no_truncation()
        self.own.no_padding()
        self.names = [self.own.id_to_token(i) for i in range(self.own.get_vocab_size(with_added_tokens=True))]
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        self.small = np.uint16 if len(self.names) <= 1 << 16 else np.uint32
        self.joined_by_space = given["decoder"] is None
        added = [t["content"] for t in given["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.fast = None
        if given["model"].get("end_of_word_suffix") == "</w>":
            back = byte_letters()
            ranks = {}
            for name, i in given["model"]["vocab"].items():
                ended = name.endswith("</w>") and name != "</w>"
                ranks[bytes(back[c] for c in (name[:-4] if ended else name)) + (MARK.encode() if ended else b"")] = i
            self.fast = tiktoken.Encoding("words", pat_str=r"[^\x00\s]+\x00", mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    @cache
    def of(path: str) -> Codec:
        """The codec of a file, read once in each worker."""
        return Codec(path)

    def encode(self, text: str) -> list[int]:
        if self.fast is not None and PLAIN.fullmatch(text) and not (self.special and self.special.search(text)):
            return self.fast.encode_ordinary(WORDS.sub("\\1\0", text.lower()))
        return self.own.encode(text, add_special_tokens=False).ids

    def encode_bytes(self, data: bytes) -> list[int]:
        return self.encode(data.decode("utf-8", "surrogatepass"))

    def decode(self, ids: list[int]) -> str:
        if self.joined_by_space:  # what the library does without a decoder
            return " ".join(map(self.names.__getitem__, ids))
        return self.own.decode(ids, skip_special_tokens=False)


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def cuts(data: bytes) -> list[int]:
    """Places in a UTF-8 text where a chunk may start: after white space, before something else."""
    if len(data) < 2 * LEAST_CHUNK:
        return []
    raw = np.frombuffer(data, np.uint8)
    h = GEAR[raw]
    for step in (1, 2, 4, 8, 16):  # h[i] takes in 2 * step bytes
        nxt = h.copy()
        nxt[step:] += h[:-step] << np.uint32(step)
        h = nxt
    hits = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0)
    blank = BLANK[raw]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    if not len(hits) or not len(starts):
        return []
    after = np.searchsorted(starts, hits, "right")
    out, last = [], 0
    for s in np.unique(starts[after[after < len(starts)]]).tolist():
        if s - last >= LEAST_CHUNK and len(data) - s >= LEAST_CHUNK:
            out.append(s)
            last = s
    return out


def tail(data: bytes, size: int) -> bytes:
    """The end of a chunk from a word's start on, with the white space before it: `size` bytes or more, or the whole chunk."""
    for at in range(len(data) - size, 0, -1):
        if data[at] in SPACES and data[at - 1] not in SPACES:
            return data[at:]
    return data


def head(data: bytes, size: int) -> bytes:
    """The start of a chunk up to a word's end: `size` bytes or more, or the whole chunk."""
    for at in range(size, len(data)):
        if data[at] in SPACES and data[at - 1] not in SPACES:
            return data[:at]
    return data


def shared_start(a: list[int], b: list[int]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def repair(left: bytes, left_ids: list[int], right: bytes, right_ids: list[int], encode: Callable[[bytes], list[int]]) -> tuple[int, list[int], int] | None:
    """What the join of two chunks needs: ids to drop at the left one's end, ids between, ids to drop at the right one's start.

    The text around the join is encoded across it. It must agree, exactly, with what both chunks have further away from the join; where it
    does not, a wider text is taken. None if even the whole chunks give no agreement.
    """
    for size in WINDOWS:
        a_text, b_text = tail(left, size), head(right, size)
        all_a, all_b = len(a_text) == len(left), len(b_text) == len(right)
        a, b, across = encode(a_text), encode(b_text), encode(a_text + b_text)
        if left_ids[len(left_ids) - len(a) :] == a and right_ids[: len(b)] == b:
            if across == a + b:
                return 0, [], 0
            p = shared_start(across, a)
            q = min(shared_start(across[::-1], b[::-1]), len(across) - p)
            if (p >= AGREED or all_a) and (q >= AGREED or all_b):
                return len(a) - p, across[p : len(across) - q], len(b) - q
        if all_a and all_b:
            return None
    return None


def joined(pieces: list[bytes], ids: list[list[int]], names: list[bytes], encode: Callable[[bytes], list[int]], repairs: dict) -> list[int] | None:
    """The ids of a text from those of its chunks; None if a join can't be repaired within its two chunks."""
    out, lead = [], 0
    for k in range(len(pieces) - 1):
        pair = names[k], names[k + 1]
        if pair not in repairs:
            repairs[pair] = repair(pieces[k], ids[k], pieces[k + 1], ids[k + 1], encode)
        found = repairs[pair]
        if found is None or lead + found[0] > len(ids[k]):
            return None
        out += ids[k][lead : len(ids[k]) - found[0]]
        out += found[1]
        lead = found[2]
    return out + ids[-1][lead:]


def pack(x: object) -> bytes:
    return zstandard.ZstdCompressor(level=PACKED).compress(pickle.dumps(x, protocol=5))


def unpack(x: bytes) -> object:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(x))


def sliced(data: bytes, at: np.ndarray) -> list[bytes]:
    ends = [0, *at.tolist(), len(data)]
    return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def digest(piece: bytes) -> bytes:
    return hashlib.blake2b(piece, digest_size=16).digest()


def may_cut(tokenizer: str) -> bool:
    """Whether the file's added tokens stay within words, so that no cut falls into one."""
    with open(tokenizer, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    return not any(t["lstrip"] or t["rstrip"] or set(t["content"].encode()) & set(SPACES) for t in added)


def blocks_of(docs: DataFrame, cut: bool = True) -> DataFrame:
    """(block, body, digests): some rows (id, text) of docs with their cuts, packed, and the digests of their distinct chunks."""
    schema = pa.schema([("block", pa.int64()), ("body", pa.binary()), ("digests", pa.binary())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, names, size = TaskContext.get().partitionId(), 0, [], set(), 0

        def full() -> pa.RecordBatch:
            return common.batch_of(schema, [((task << 32) | made, pack(held), b"".join(sorted(names)))])

        for b in batches:
            for id_, text in common.rows(b):
                data = text.encode("utf-8", "surrogatepass")
                at = np.array(cuts(data) if cut else [], np.int64)
                names.update(map(digest, sliced(data, at)))
                held.append((id_, data, at))
                size += len(data) + 16
                if size >= BLOCK_BYTES:
                    yield full()
                    made, held, names, size = made + 1, [], set(), 0
        if held:
            yield full()

    return docs.mapInArrow(gather, "block long, body binary, digests binary")


def encode_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_le32, decoded) for each row of docs: ids as little-endian 32-bit integers, and their decoding."""
    spark = docs.sparkSession
    common.prepare(spark)
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind_of_id = rows.schema["id"].dataType
    # Dealt once by block; what follows reads this one exchange thrice.
    blocks = blocks_of(rows, may_cut(tokenizer)).repartition(common.partitions(spark), "block")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, digests in common.rows(b):
                both = np.frombuffer(digests, "<i8").reshape(-1, 2)
                for k in range(0, len(both), 1 << 14):
                    part = both[k : k + (1 << 14)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(part[:, 0]), pa.array(part[:, 1])], names=["block", "d1", "d2"])

    pairs = blocks.select("block", "digests").mapInArrow(named, "block long, d1 long, d2 long")
    # Chunks of one block only are encoded there; of the others the first block is the owner, that encodes them for all.
    shared = pairs.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min("block").alias("owner")).where("n > 1")
    wanted = pairs.join(shared, ["d1", "d2"]).withColumn("n_salts", F.ceil(F.col("n") / SALTED))
    owned = wanted.where("block = owner").select("block", "d1", "d2", "n_salts")
    entry = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("n_salts", pa.int64()), ("ids", pa.binary())])

    def own(left: pa.Table, right: pa.Table) -> pa.Table:
        out, codec = [], Codec.of(tokenizer)
        if len(right):
            asked = {struct.pack("<qq", a, b): (a, b, n) for a, b, n in zip(*(right.column(c).to_pylist() for c in ("d1", "d2", "n_salts")), strict=True)}
            for body in left.column("body").to_pylist():
                for _, data, at in unpack(body):
                    for piece in sliced(data, at):
                        if found := asked.pop(digest(piece), None):
                            out.append((*found, np.array(codec.encode_bytes(piece), codec.small).tobytes()))
        return pa.Table.from_batches([common.batch_of(entry, out)])

    by_block = lambda d: d.groupBy("block")
    known = by_block(blocks.select("block", "body")).cogroup(by_block(owned)).applyInArrow(lambda a, b: own(a, b), "d1 long, d2 long, n_salts long, ids binary")
    # A chunk that very many blocks want is dealt over several tasks.
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_salts") - 1))).drop("n_salts")
    answers = wanted.withColumn("salt", F.pmod(F.xxhash64("block"), F.col("n_salts"))).join(salted, ["d1", "d2", "salt"]).select("block", "d1", "d2", "ids")
    id_type = to_arrow_type(kind_of_id)
    schema = pa.schema([("id", id_type), ("n_tokens", pa.int64()), ("ids_le32", pa.binary()), ("decoded", pa.string())])

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        codec, out, repairs = Codec.of(tokenizer), [], {}
        memory = {struct.pack("<qq", a, b): np.frombuffer(ids, codec.small).tolist() for a, b, ids in zip(*(right.column(c).to_pylist() for c in ("d1", "d2", "ids")), strict=True)}
        for body in left.column("body").to_pylist():
            for id_, data, at in unpack(body):
                pieces = sliced(data, at)
                names = [digest(p) for p in pieces]
                for name, piece in zip(names, pieces, strict=True):
                    if name not in memory:
                        memory[name] = codec.encode_bytes(piece)
                ids = joined(pieces, [memory[n] for n in names], names, codec.encode_bytes, repairs)
                if ids is None:
                    ids = codec.encode_bytes(data)
                out.append((id_, len(ids), np.array(ids, "<u4").tobytes(), codec.decode(ids)))
        return pa.Table.from_batches([common.batch_of(schema, out)])

    done = by_block(blocks.select("block", "body")).cogroup(by_block(answers)).applyInArrow(lambda a, b: assemble(a, b), f"id {kind_of_id.simpleString()}, n_tokens long, ids_le32 binary, decoded string")
    return done.withColumnRenamed("id", key)
