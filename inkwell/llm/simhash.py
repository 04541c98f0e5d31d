"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits, each the majority of that bit over the XXH64 hashes of a text's word shingles. Two
fingerprints link if they differ in at most `threshold` bits; groups are the connected components of the links.

The 64 bits are cut into three fields. Links differ in at most t = threshold // 3 bits in one field at least. For
each field a covering code gives the anchors: the Golay code for the fields of 23 bits (each word lies within 3 bits of exactly one
code word), and the Hamming code of length 15 beside 3 free bits for the field of 18 bits (within 1 bit of exactly
one). A fingerprint's home is the anchor within the covering radius R; if x and y differ by at most t in the field,
y lies within R + t of x's home. So each fingerprint is copied to every anchor within R + t of it, and homes are compared
to all that an anchor holds: no link is missed, whatever the data. A linear code's anchors around a word follow from its syndrome by
one table lookup. With 4 bits a fingerprint has 21 copies on average, and a pair of unlike ones meets with a chance of 1 in 300.

Equal fingerprints are one class before anything is compared. An anchor with very many of them is dealt as a grid of
blocks. Each group of blocks gives the edges of a spanning forest, not its pairs; components then come from rounds of large and
small stars, each written to the shared folder.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case. Null and empty texts have fingerprint 0, linked like any other. Repeated rows, null ids
and ties are kept: a component's id is its smallest id that is not null, or null. Columns other than id and text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEED = 42
#: Bits of a field and where it starts.
FIELDS = ((23, 0), (23, 23), (18, 46))
#: Fixed value: generator polynomial of the binary Golay code of length 23.
GOLAY = 0b110001110101
#: Members of an anchor that one block holds; more are dealt as a grid.
BLOCK = 16384
#: Rows of a group of anchors that one task compares.
GROUP_ROWS = 400_000
#: Nodes of a token at most that is dealt by its nodes and not by itself.
FEW = 64
#: Edges of one task in a round of stars.
EDGE_ROWS = 200_000
#: Texts from which common shingles are learned, and how many of these are known.
SAMPLED, MOST_USUAL = 16_000, 100_000
#: Bins of a set's hashes, and what a bin can hold; larger sets pass unbounded.
BINS, MOST_BIN = 256, 65535


def majority(hashes: np.ndarray) -> np.ndarray:
    """For each of 64 bits, how many of the hashes have it, highest bit first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def hashed(text: str | None, width: int) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles in order, some at a time: bounds what a very long text needs."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[:n].tolist(), (ends[width - 1 :] if len(words) >= width else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + (1 << 16)], last[at : at + (1 << 16)], strict=True)], dtype=np.uint64)


def majority_of(parts: Iterable[np.ndarray]) -> int:
    """The unsigned fingerprint over hashes; 0 where there are none."""
    ones, n = np.zeros(64, np.int64), 0
    for h in parts:
        ones, n = ones + majority(h), n + len(h)
    return int("".join("1" if c else "0" for c in ones * 2 > n), 2)


def fingerprint(text: str | None, width: int) -> int:
    """The unsigned fingerprint of a text."""
    return majority_of(hashed(text, width))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *hashed(text, width)]))


def fingerprints(docs: DataFrame, width: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp) with fp the fingerprint's bits as a signed long."""
    common.prepare(docs.sparkSession)
    rows = docs.select(F.col(key), F.col(text))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=[key, "fp"])

    return rows.mapInArrow(each, f"{key} {rows.schema[key].dataType.simpleString()}, fp long")


def columns_of(bits: int) -> list[int]:
    """The parity-check columns of a field's code: a word's syndrome is the xor of those of its set bits."""
    if bits == 23:
        out, x = [], 1
        for _ in range(bits):
            out.append(x)
            x <<= 1
            x ^= GOLAY if x >> 11 else 0
        return out
    return [*range(1, 16), 0, 0, 0]


@cache
def patterns(bits: int, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Error patterns of up to R + near bits by syndrome, lightest first: starts of each syndrome's run, and the patterns."""
    columns, radius = columns_of(bits), 3 if bits == 23 else 1
    found: dict[int, list[int]] = {}
    for weight in range(radius + near + 1):
        for places in combinations(range(bits), weight):
            syndrome = mask = 0
            for i in places:
                syndrome ^= columns[i]
                mask |= 1 << i
            found.setdefault(syndrome, []).append(mask)
    runs = [found[s] for s in range(len(found))]
    return np.cumsum([0, *map(len, runs)]), np.array([p for r in runs for p in r], dtype=np.int64)


def anchors(fps: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each copy: the place of its fingerprint in fps, its anchor (field and code word as one number), and whether it is at home."""
    words, out = fps.view(np.uint64), []
    for field, (bits, shift) in enumerate(FIELDS):
        w = ((words >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        syndrome = np.zeros(len(w), np.int64)
        for i, c in enumerate(columns_of(bits)):
            syndrome ^= ((w >> i) & 1) * c
        starts, masks = patterns(bits, near)
        n = starts[syndrome + 1] - starts[syndrome]
        of = np.repeat(np.arange(len(w)), n)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        out.append((of, (w[of] ^ masks[starts[syndrome][of] + k]) | (field << 32), k == 0))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def forest(points: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest of its group) over the links of those at home to all; points are rows (node, fp, other)."""
    nodes, place = np.unique(points[:, 0], return_inverse=True)
    label = np.arange(len(nodes))
    fp, other = points[:, 1].view(np.uint64), points[:, 2].view(np.uint64)
    at_home = np.flatnonzero(home)
    step = max(1, (1 << 22) // max(1, len(fp)))
    for a in range(0, len(at_home), step):
        mine = at_home[a : a + step]
        i, j = np.nonzero(np.bitwise_count(fp[mine, None] ^ fp[None, :]) <= threshold)
        i = mine[i]
        near = np.bitwise_count(fp[i] ^ fp[j]) + np.bitwise_count(other[i] ^ other[j]) <= threshold
        label = merged(label, place[i[near]], place[j[near]])
    linked = label != np.arange(len(nodes))
    return nodes[linked], nodes[label[linked]]


def merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels, each the smallest place of its group, after the groups of i and j are joined pair by pair."""
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
    return label


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges that connect what the edges (a, b) connect."""
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    label = merged(np.arange(len(nodes)), place[: len(a)], place[len(a) :])
    linked = label != np.arange(len(nodes))
    return nodes[linked], nodes[label[linked]]


def links(points: DataFrame, threshold: int, near: int) -> DataFrame:
    """Edges (a, b) that connect what the links among the points connect.

    points: (node, table, fp, other). Two of one table link if fp and other together differ in at most `threshold` bits and fp
    in at most `near` bits of one field.
    """
    spark = points.sparkSession

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, table, fp, other = (c.to_numpy() for c in b.columns)
            of, anchor, home = anchors(fp, near)
            anchor |= table[of].astype(np.int64) << 40
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, node[of], fp[of], other[of], home)], names=["anchor", "node", "fp", "other", "home"])

    spread = points.select("node", "table", "fp", "other").mapInArrow(copies, "anchor long, node long, fp long, other long, home boolean")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["anchor", "cell"])
        rows, home = pdf[["node", "fp", "other"]].to_numpy(np.int64), pdf["home"].to_numpy()
        cuts = np.flatnonzero(np.diff(pdf["anchor"].to_numpy()) | np.diff(pdf["cell"].to_numpy())) + 1
        found = [forest(np.ascontiguousarray(r), h, threshold) for r, h in zip(np.split(rows, cuts), np.split(home, cuts), strict=True) if len(r) > 1 and h.any()]
        a, b = spanning(*(np.concatenate([x[i] for x in found]) if found else np.empty(0, np.int64) for i in (0, 1)))
        return pd.DataFrame({"a": a, "b": b})

    n = points.count()
    groups = max(1, -(-21 * n // GROUP_ROWS))  # by rows alone: a node has one edge for each group, however many anchors it is at
    full = spread.groupBy("anchor").count().where(F.col("count") > BLOCK) if n > BLOCK else None
    if full is not None and not full.isEmpty():
        # A grid of blocks: members in strips, homes in strips, each strip of one with each of the other.
        dealt = spread.join(full, "anchor", "left").withColumn("side", F.ceil(F.coalesce("count", F.lit(1)) / BLOCK).cast("int"))
        strip, each_strip = F.pmod(F.xxhash64("node"), F.col("side")), F.explode(F.sequence(F.lit(0), F.col("side") - 1))
        as_home = dealt.where("home").select("anchor", "node", "fp", "other", F.lit(True).alias("home"), "side", strip.alias("i"), each_strip.alias("j"))
        as_member = dealt.select("anchor", "node", "fp", "other", F.lit(False).alias("home"), "side", each_strip.alias("i"), strip.alias("j"))
        ready = as_home.unionByName(as_member).select("anchor", "node", "fp", "other", "home", (F.col("i") * F.col("side") + F.col("j")).alias("cell"))
    else:
        ready = spread.withColumn("cell", F.lit(0).cast("long"))
    return ready.groupBy(F.pmod(F.xxhash64("anchor", "cell"), F.lit(groups)).alias("g")).applyInPandas(lambda pdf: compare(pdf), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), root the smallest node of its component: rounds of large and small stars."""
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    stars, before = common.written(edges, "edges"), None
    parts = max(1, -(-stars.count() // EDGE_ROWS))  # rounds only lose edges
    while True:
        out = both(stars)
        least = out.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = out.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
        small = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(small, "a")
        stars = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.withColumnRenamed("m", "b")).distinct()
        stars = common.written(stars.coalesce(parts), "stars")
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit(0xFFFFFFFF)))).first()
        if now == before:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now


def near_duplicates(docs: DataFrame, width: int = 5, threshold: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id) for each row of docs."""
    found = common.written(fingerprints(docs, width, key, text), "fingerprints")
    classes = found.groupBy("fp").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("n"))
    points = classes.select(F.col("fp").alias("node"), F.lit(0).alias("table"), "fp", F.lit(0).cast("long").alias("other"))
    roots = components(links(points, threshold, threshold // len(FIELDS)))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    rooted = common.written(rooted, "roots")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = common.written(rooted.join(named, "root").select("fp", "n", "component_id"), "named")
    return common.salted_join(found, known, "fp", "n", F.xxhash64(key), "inner").select(key, "fp", "component_id")


def bits_at(similarity: float, bits: int, slack: float) -> int:
    """Differing bits that texts of a given shingle similarity have on average, and `slack` standard deviations more."""
    rate = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * rate + slack * math.sqrt(bits * rate * (1 - rate)))


def prefix(own: np.ndarray, similarity: float, common_: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first hashes of a set in an order of all hashes, so many that sets of the similarity share one of them: rare before common ones.

    common_: the hashes known as common, in order; rank: how common each is.
    """
    most = len(own) - math.ceil(similarity * len(own) - 1e-9) + 1
    if not len(own) or not len(common_):
        return own[:most]
    at = np.minimum(np.searchsorted(common_, own), len(common_) - 1)
    return own[np.argsort(np.where(common_[at] == own, rank[at], 0), kind="stable")[:most]]


def usual(docs: DataFrame, width: int, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that several of some sampled texts have, in order, and how many. They order the prefixes and so save work; any order gives the same links."""
    n = docs.count()
    drawn = docs.select(F.col(text).alias("text")).where(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLED / max(1, n))))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, width).view(np.int64))], names=["token"])

    counts = drawn.distinct().mapInArrow(each, "token long").groupBy("token").count().where("count >= 4")
    rows = counts.orderBy(F.desc("count"), "token").limit(MOST_USUAL).collect()
    tokens, times = np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([r[1] for r in rows], np.int64)
    order = np.argsort(tokens)
    return tokens[order], times[order]


def bins(own: np.ndarray) -> bytes:
    """How many of a set's hashes fall in each of BINS bins: two sets share at most the sum of the lesser counts."""
    return np.minimum(np.bincount((own & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS), MOST_BIN).astype("<u2").tobytes()


def allowed(n: np.ndarray, pos: np.ndarray, m: np.ndarray, at: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of n and m shingles whose first common one is at pos and at, in the order of all shingles, can have the similarity."""
    return np.minimum(n - pos, m - at) >= similarity / (1 + similarity) * (n + m) - 1e-9


def meet(pdf: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """(token, node, n, pos, centre, lead) for tokens of two nodes and more: centre is one of the token's nodes, or null where the two can't be alike.

    It is a node with the token first in its order, so one with few shingles of its own: among edited copies the original or what is next to it. Of equal ones
    tokens with the same nodes take four at most. lead is equal for tokens with the same few nodes.
    """
    pdf = pdf.drop_duplicates(["token", "node"])
    pdf = pdf[pdf["token"].duplicated(keep=False)]
    token, node = pdf["token"].to_numpy(np.int64), pdf["node"].to_numpy(np.int64)
    salt = (token.view(np.uint64) & np.uint64(3)) * np.uint64(0x9E3779B97F4A7C15)
    order = np.lexsort(((node.view(np.uint64) ^ salt) * np.uint64(0xBF58476D1CE4E5B9), pdf["pos"], token))
    pdf = pdf.iloc[order][["token", "node", "n", "pos"]]
    first = pdf.groupby("token", sort=False)[["node", "n", "pos"]].transform("first")
    ok = allowed(pdf["n"].to_numpy(), pdf["pos"].to_numpy(), first["n"].to_numpy(), first["pos"].to_numpy(), similarity)
    nodes = pdf.groupby("token", sort=False)["node"]
    lead = nodes.transform("min").where(nodes.transform("size") <= FEW, pdf["token"])
    return pdf.assign(centre=first["node"].astype("Int64").mask(~ok), lead=lead)


def apart(pdf: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Pairs (a, b), a < b, of nodes that share a token, lie in different groups and have sizes and places of the token that allow the similarity."""
    pdf = pdf.sort_values("token")
    token, node, n, pos, root = (pdf[c].to_numpy(np.int64) for c in ("token", "node", "n", "pos", "root"))
    # Tokens of one group only have no pairs.
    starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    mixed = np.repeat(np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts), np.diff([*starts, len(token)]))
    token, node, n, pos, root = token[mixed], node[mixed], n[mixed], pos[mixed], root[mixed]
    found, held, i, step = [np.empty((0, 2), np.int64)], 0, np.arange(len(token)), 1
    while len(i := i[: np.searchsorted(i, len(token) - step)]) and len(i := i[token[i] == token[i + step]]):
        j = i + step
        ok = (root[i] != root[j]) & allowed(n[i], pos[i], n[j], pos[j], similarity)
        found.append(np.stack((np.minimum(node[i[ok]], node[j[ok]]), np.maximum(node[i[ok]], node[j[ok]])), axis=1))
        held += ok.sum()
        if held > 1 << 21:
            found = [np.unique(np.concatenate(found), axis=0)]
            held = 0
        step += 1
    pairs = np.unique(np.concatenate(found), axis=0)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8, slack: float = 1.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of like texts: that with the smallest id (null last).

    Texts are alike if their sets of shingles have the Jaccard similarity or more; groups are the connected components of these links. Each
    link is verified on the whole sets, and none is missed: two such sets share a shingle in the prefixes of both, in whatever order of all shingles.

    Trials come first: pairs that the anchors of the fingerprints bring together, and each shared prefix shingle's nodes with one of them. What they link
    is a group already, so that of the nodes at a shingle only pairs of different groups are left to be compared, however many copies there are. Of
    these, a shingle's places in the two sets must leave room for enough common ones: that holds at the first shingle that two alike sets share.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    ids = (F.xxhash64(F.lit(1), F.col(key), F.col(text)), F.xxhash64(F.lit(2), F.col(text), F.col(key)))
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), ids[0].alias("r1"), ids[1].alias("r2"))
    tokens, times = usual(docs, width, text)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, width) for t in b.column(1).to_pylist()]
            node, fp = (np.array(x, dtype=np.uint64).view(np.int64) for x in ([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], [majority_of([s]) for s in sets]))
            first = pa.array([prefix(s, similarity, tokens, times).view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(node), pa.array(fp), pa.array([len(s) for s in sets], pa.int64()), first, pa.array([bins(s) for s in sets], pa.binary())], names=["id", "r1", "r2", "node", "fp", "n", "prefix", "bins"])

    found = common.written(rows.mapInArrow(each, f"id {rows.schema['id'].dataType.simpleString()}, r1 long, r2 long, node long, fp long, n long, prefix array<long>, bins binary"), "sketches")
    # A node is a set of shingles; rows with the same set are one node.
    nodes = common.written(found.groupBy("node").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bins").alias("bins"), F.min(F.struct("r1", "r2")).alias("lead")), "nodes")
    points = nodes.select("node", F.lit(0).alias("table"), "fp", F.lit(0).cast("long").alias("other"))
    groups = max(1, -(-found.agg(F.sum(F.size("prefix"))).first()[0] // GROUP_ROWS)) if not points.isEmpty() else 1
    bucket = F.pmod(F.xxhash64("token"), F.lit(groups)).alias("g")
    shared = common.written(found.select("node", "n", F.posexplode("prefix").alias("pos", "token")).groupBy(bucket).applyInPandas(lambda pdf: meet(pdf, similarity), "token long, node long, n long, pos int, centre long, lead long"), "shared")

    pair = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    stars = shared.where("node != centre").select(F.col("node").alias("a"), F.col("centre").alias("b"))
    trials = common.written(links(points, bits_at(similarity, 64, slack), 1).unionByName(stars).select(*pair).distinct(), "trials")

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = b.column(2).to_numpy(), b.column(3).to_numpy()
            ca, cb = (np.frombuffer(b"".join(b.column(k).to_pylist()), "<u2").reshape(-1, BINS) for k in (4, 5))
            same = np.minimum(np.minimum(ca, cb).sum(axis=1, dtype=np.int64), np.minimum(na, nb))
            ok = (same >= similarity * (na + nb - same) - 1e-9) | (np.minimum(na, nb) > MOST_BIN)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, width).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    def verified(pairs: DataFrame, what: str) -> DataFrame:
        """The pairs whose sets are alike: those that the bins allow, then by the sets themselves."""
        of = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("bins").alias(f"c{c}"))
        bound = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "nb", "ca", "cb")
        left = common.written(bound.mapInArrow(possible, "a long, b long"), f"{what}-possible")
        asked = left.select(F.col("a").alias("node")).unionByName(left.select(F.col("b").alias("node"))).distinct()
        leads = nodes.join(asked, "node").select("node", "lead.r1", "lead.r2")
        # Repeated rows have the same r1 and r2.
        texts = rows.select("r1", "r2", "text").join(leads, ["r1", "r2"]).select("node", "text").dropDuplicates(["node"])
        sets = common.written(texts.mapInArrow(whole, "node long, shingles array<long>"), f"{what}-sets")
        both = left.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
        same = F.size(F.array_intersect("sa", "sb"))
        return common.written(both.where(same / (F.size("sa") + F.size("sb") - same) >= similarity).select("a", "b"), what)

    linked = verified(trials, "links")
    roots = components(linked)
    rooted = shared.join(roots, "node", "left").select("token", "node", "n", "pos", "lead", F.coalesce("root", "node").alias("root"))
    # Tokens that the same nodes share come to one task, which so gives each pair once.
    together = F.pmod(F.xxhash64("lead"), F.lit(max(1, -(-shared.count() // GROUP_ROWS)))).alias("g")
    left = rooted.groupBy(together).applyInPandas(lambda pdf: apart(pdf, similarity), "a long, b long").distinct().join(trials, ["a", "b"], "left_anti")
    more = verified(left, "more-links")
    if not more.isEmpty():
        roots = components(linked.unionByName(more))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "r1", "r2")).alias("first")
    kept = found.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(first).select("first.r1", "first.r2")
    marked = docs.select(F.struct(*docs.columns).alias("row"), ids[0].alias("r1"), ids[1].alias("r2"))
    return marked.join(kept, ["r1", "r2"], "left_semi").dropDuplicates(["r1", "r2"]).select("row.*")
