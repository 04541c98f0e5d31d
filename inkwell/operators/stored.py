"""A stored search index that reads what a query needs.

`postings` has a row for each token of each document with its places, `entries` the same without them: how often a document has it, and how long the document is. Both are in runs sorted by token and block,
as each task that reads texts makes them, in small row groups and pages, so that a query's tokens and blocks prune them. Documents are dealt into blocks by size and a hash of their id; there are `BLOCKS` blocks or few more however
many documents there are. `heads` has a row for each block of a token: its documents, the largest count and the shortest document, which bound the rank of any document there whatever
the average length is. `about` has the documents' metadata and tokens, without text: texts are read once.

The driver reads a plan's heads, a bounded number, and so knows each word's weight and each block's bound. Where much would have to be read, the blocks of the highest bounds are rated first,
which tells what the k-th best scores at least; then each block whose bound reaches that is rated, and no other. Plans with phrases or columns read the postings of their tokens. Texts are read for the page alone.

Statistics add up over generations: an update writes rows of the changed documents, and what they had before as negative counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import lexical
from inkwell.plans.language import Plan, filters_column
from inkwell.session import SLICE_ROWS

#: Documents of a block at least, on average, and blocks of all documents; entries that are rated at once; blocks of the first round; ids pushed into a scan at most.
BLOCK_DOCS, BLOCKS, AT_ONCE, FIRST_BLOCKS, MOST_IDS = 1024, 4096, 100_000, 4, 1000
#: Steps of a doubling of length by which documents are dealt.
STEPS = 4
#: Tokens that a task sorts at once; rows that it gives back at once; entries that one task counts heads of, at least where cores are free, and about.
RUN_TOKENS, BATCH_ROWS, AT_LEAST, PART_ENTRIES = 2_000_000, 1 << 16, 100_000, 2_000_000
#: What a table's files are written with: pages are what a filter can skip.
FINE = {"compression": "zstd", "parquet.block.size": str(4 << 20), "parquet.page.row.count.limit": "2048"}
#: Columns by the lowest two bits of a place.
PLACES = (*lexical.COLUMNS, None)
META = ("name", "path", "extension", "source", "size", "modified_at")


def length_class() -> Column:
    return F.floor(STEPS * F.log2(1 + F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)))).cast("int")


def block_of(docs: DataFrame) -> Column:
    """A document's block: its class of size, and in it a hash of its id."""
    counts = {r.c: r.n for r in docs.groupBy(length_class().alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most STEPS rows for each doubling
    full = max(BLOCK_DOCS, sum(counts.values()) // BLOCKS)
    blocks = F.create_map(*(F.lit(x) for c, n in counts.items() for x in (c, -(-n // full)))) if counts else F.create_map(F.lit(0), F.lit(1))
    return F.col("class").cast("long") * (1 << 24) + F.pmod(F.xxhash64("doc_id"), F.element_at(blocks, F.col("class")))


def about(docs: DataFrame) -> dict[str, DataFrame]:
    """Metadata and tokens of each document, in the order of its places; `block` is where its entries stand."""
    arrays = [f"_{c}" for c in lexical.COLUMNS]
    cut = docs.select("doc_id", *META, length_class().alias("class"), *(T.tok_index(F.col(c)).alias(t) for c, t in zip(lexical.COLUMNS, arrays, strict=True)))
    n_tokens = reduce(Column.__add__, (F.size(t) for t in arrays)).cast("long")
    return {"about": cut.withColumn("block", block_of(docs)).select("doc_id", *META, "block", n_tokens.alias("n_tokens"), F.struct(*(F.col(t).alias(c) for c, t in zip(lexical.COLUMNS, arrays, strict=True))).alias("tokens"))}


def postings(docs: DataFrame, tables: dict[str, DataFrame], before: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """(token, block, doc_id, n_tokens, f, places): a row for each token of a document, with the place of each occurrence: its number times four, and its column's. They are sorted where tokens are read, in runs of about `RUN_TOKENS`; nothing is dealt."""
    kind = tables["about"].schema["doc_id"].dataType.simpleString()
    schema = f"token string, block long, doc_id {kind}, n_tokens long, f long, places array<struct<pos:int>>"
    rows = tables["about"].select("doc_id", "block", *(f"tokens.{c}" for c in lexical.COLUMNS))
    most = RUN_TOKENS

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                held.append(batch.slice(start, SLICE_ROWS))
                n += sum(pc.sum(pc.list_value_length(c)).as_py() or 0 for c in held[-1].columns[2:])
                if n >= most:
                    yield from one_run(held)
                    held, n = [], 0
        if held:
            yield from one_run(held)

    return {"postings": rows.mapInArrow(runs, schema)}


def one_run(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of some documents (doc_id, block, tokens of each place), by token, block and doc_id."""
    table = pa.Table.from_batches(batches)
    table = table.take(pc.sort_indices(table.select(["block", "doc_id"]), [("block", "ascending"), ("doc_id", "ascending")])).combine_chunks()
    docs = table.num_rows
    lists = [table.column(i + 2).combine_chunks() for i in range(len(lexical.COLUMNS))]
    lists = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in lists]
    sizes = [pc.list_value_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in lists]
    encoded = pa.concat_arrays([c.flatten() for c in lists]).dictionary_encode()
    if not len(encoded):
        return
    by_name = pc.sort_indices(encoded.dictionary)
    rank = np.empty(len(by_name), np.int64)
    rank[by_name.to_numpy()] = np.arange(len(by_name))
    key = rank[encoded.indices.to_numpy()] * docs + np.concatenate([np.repeat(np.arange(docs), n) for n in sizes])
    places = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for n in sizes]).astype(np.int32)
    places = places * len(PLACES) + np.repeat(np.arange(len(sizes), dtype=np.int32), [n.sum() for n in sizes])
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    ends = np.concatenate([starts, [len(key)]]).astype(np.int32)
    doc = pa.array(key[starts] % docs)
    where = pa.StructArray.from_arrays([pa.array(places[order])], ["pos"])
    out = {
        "token": encoded.dictionary.take(by_name).take(pa.array(key[starts] // docs)),
        "block": table.column("block").take(doc),
        "doc_id": table.column("doc_id").take(doc),
        "n_tokens": pa.array(sum(sizes)).take(doc),
        "f": pa.array(np.diff(ends).astype(np.int64)),
        "places": pa.ListArray.from_arrays(pa.array(ends), where),
    }
    yield from pa.table(out).to_batches(max_chunksize=BATCH_ROWS)


def entries(docs: DataFrame, tables: dict[str, DataFrame], before: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """(token, block, doc_id, f, n_tokens), in the order of the postings."""
    return {"entries": tables["postings"].select("token", "block", "doc_id", "f", "n_tokens")}


def sums(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Heads are counted after one deal, in as many parts as the entries need."""
    entries = tables["entries"].select("token", "block", "f", "n_tokens")
    n = entries.count()
    cores = entries.sparkSession.sparkContext.defaultParallelism
    dealt = entries.repartition(max(1, min(cores, n // AT_LEAST), n // PART_ENTRIES), "token", "block")
    heads = dealt.groupBy("token", "block").agg(F.count(F.lit(1)).alias("n"), F.max("f").alias("most_f"), F.min("n_tokens").alias("least_tokens")).sortWithinPartitions("token", "block")
    return {"heads": heads, "stats": tables["about"].agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))}


def lost(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What documents that go take from the sums: negative counts, in no block."""
    gone = tables["about"]
    distinct = F.array_distinct(F.concat(*(F.col(f"tokens.{c}") for c in lexical.COLUMNS)))
    heads = gone.select(F.explode(distinct).alias("token")).groupBy("token").agg((-F.count(F.lit(1))).alias("n"))
    zero = F.lit(0).cast("long")
    return {
        "heads": heads.select("token", F.lit(-1).cast("long").alias("block"), "n", zero.alias("most_f"), zero.alias("least_tokens")),
        "stats": gone.agg((-F.count(F.lit(1))).alias("n_docs"), F.coalesce(-F.sum("n_tokens"), F.lit(0)).alias("n_tokens")),
    }


@dataclass
class Stored(lexical.Index):
    """An index over stored tables; `docs` is read for the page's texts alone."""

    entries: DataFrame = None
    heads: DataFrame = None
    about: DataFrame = None
    stats: DataFrame = None
    known: list = field(default_factory=list)

    def totals(self) -> DataFrame:
        return self.stats.agg(F.sum("n_docs").alias("N"), F.try_divide(F.sum("n_tokens"), F.sum("n_docs")).alias("avg"))

    def metadata(self) -> DataFrame:
        return self.about.select("doc_id", *META)

    def table(self, found: list[tuple]) -> DataFrame:
        return self.docs.sparkSession.createDataFrame(found, f"doc_id {self.docs.schema['doc_id'].dataType.simpleString()}, bm25 double")

    def best(self, plans: dict[str, Plan], size: int, docs: DataFrame | None = None) -> DataFrame:
        if docs is not None or not plain(plans):
            return super().best(plans, size, docs)
        name, plan = next(iter(plans.items()))
        found = self.skipping(plan, size)
        rows = found if isinstance(found, DataFrame) else self.table(found)
        paths = within(self.about.select("doc_id", "path"), found)
        return paths.join(rows, "doc_id").orderBy("bm25", "path").limit(size).select(F.lit(name).alias("query"), "doc_id", "bm25")

    def pool(self, plans: dict[str, Plan], size: int, docs: DataFrame | None = None) -> DataFrame:
        if docs is None and plain(plans):
            name, plan = next(iter(plans.items()))
            if not isinstance(found := self.skipping(plan, size), DataFrame):
                if not found:
                    return self.docs.limit(0).withColumns({"query": F.lit(name), "bm25": F.lit(0.0)})
                page = within(self.docs, found).withColumns({"query": F.lit(name), "bm25": ranks(found)})
                return page.orderBy("bm25", "path").limit(size)
        cut = self.best(plans, size, docs)
        rows = cut.limit(MOST_IDS + 1).collect()
        if len(rows) > MOST_IDS:
            return self.docs.join(cut, "doc_id")
        return within(self.docs, rows).join(F.broadcast(cut.sparkSession.createDataFrame(rows, cut.schema)), "doc_id")  # as many rows

    def weights(self, plan: Plan) -> tuple[dict[str, float], float, list[tuple[float, int, int]]]:
        """Each word's weight, the average length, and (bound, block, entries) of the blocks that can match, highest bound first."""
        if not self.known:
            self.known.append(self.totals().first())
        total = self.known[0]
        number = {p.tokens[0]: i for i, p in enumerate(plan.phrases)}
        scoring, n, blocks = set(plan.scoring()), dict.fromkeys(number, 0), {}
        for h in self.heads.where(F.col("token").isin(list(number))).collect():  # BLOCKS or few more for each word
            n[h.token] += h.n
            if h.block >= 0:
                of = blocks.setdefault(h.block, {})
                f, least, count = of.get(h.token, (0, h.least_tokens, 0))
                of[h.token] = max(f, h.most_f), min(least, h.least_tokens), count + h.n
        idf = {t: math.log((total.N - k + 0.5) / (k + 0.5)) if k else 0.0 for t, k in n.items()}
        weight = {t: (w if w > 0 else lexical.LEAST_IDF) if number[t] in scoring else 0.0 for t, w in idf.items()}
        out = []
        for block, of in blocks.items():
            if holds(plan.match, {number[t] for t in of}):
                out.append((sum(weight[t] * part(f, least, total.avg) for t, (f, least, _) in of.items()) * (1 + 1e-9), block, sum(c for _, _, c in of.values())))
        return weight, total.avg, sorted(out, key=lambda x: (-x[0], x[1]))

    def skipping(self, plan: Plan, size: int) -> list[tuple[int, float]] | DataFrame:
        """(doc_id, bm25) of the best `size` documents and of all that are as good as the last of them: rows, or a table where these are very many."""
        weight, average, blocks = self.weights(plan)
        if not blocks:
            return []
        of = lambda values: reduce(lambda c, x: c.when(F.col("token") == x[0], x[1]), values, F)
        number = of([(p.tokens[0], i) for i, p in enumerate(plan.phrases)])
        score = F.sum(of(list(weight.items())) * part(F.col("f"), F.col("n_tokens"), average)).alias("score")
        # Excluded words may stand in any block that is read.
        condition = plan.condition(lambda i: F.array_contains("has", i))

        def rated(some: list[int]) -> DataFrame:
            mine = self.entries.where(F.col("token").isin(list(weight)))
            mine = mine if len(some) == len(blocks) else mine.where(F.col("block").isin(some))
            mine = mine.coalesce(1) if few else mine  # one task sums a few entries without dealing them
            kept = mine.groupBy("doc_id").agg(score, F.collect_set(number).alias("has")).where(condition).select("doc_id", "score")
            return kept.join(self.metadata().where(filters_column(plan.filters)).select("doc_id"), "doc_id", "left_semi") if plan.filters else kept

        least, some, few = 0.0, [b for _, b, _ in blocks], sum(c for _, _, c in blocks) <= AT_ONCE
        if not few and len(blocks) > FIRST_BLOCKS:
            top = rated(some[:FIRST_BLOCKS]).orderBy(F.desc("score")).limit(size).collect()  # a page of numbers
            least = top[-1].score * (1 - 1e-9) if len(top) == size else 0.0
            some = [b for bound, b, _ in blocks if bound >= least]
        every = rated(some).where(F.col("score") >= least)
        rows = every.orderBy(F.desc("score")).limit(size + MOST_IDS).collect()
        if len(rows) < size:
            return [(r.doc_id, -r.score) for r in rows]
        last = rows[size - 1].score
        if len(rows) == size + MOST_IDS and rows[-1].score >= last * (1 - 1e-12):
            return every.where(F.col("score") >= last * (1 - 1e-12)).select("doc_id", (-F.col("score")).alias("bm25"))
        return [(r.doc_id, -r.score) for r in rows if r.score >= last * (1 - 1e-12)]


def plain(plans: dict[str, Plan]) -> bool:
    """Whether it is one plan of single words of any column."""
    return len(plans) == 1 and all(len(p.tokens) == 1 and not p.column for plan in plans.values() for p in plan.phrases)


def holds(tree: tuple | None, has: set[int]) -> bool:
    if tree is None:
        return False
    return tree[1] in has if tree[0] == "phrase" else (all if tree[0] == "all" else any)(holds(t, has) for t in tree[1])


def within(rows: DataFrame, found: list | DataFrame) -> DataFrame:
    """Rows of documents that were found: their ids reach the scan as a filter."""
    if isinstance(found, DataFrame):
        return rows.join(found.select("doc_id"), "doc_id", "left_semi")
    ids = [r.doc_id if hasattr(r, "doc_id") else r[0] for r in found]
    return rows.where(f"doc_id IN ({', '.join(map(str, ids))})" if whole_numbers(ids) else F.col("doc_id").isin(ids))


def ranks(found: list[tuple]) -> Column:
    """A document's rank by its id; a page of numbers."""
    if whole_numbers([i for i, _ in found]):
        return F.expr(f"element_at(map({', '.join(f'{i}L, {r!r}D' for i, r in found)}), CAST(doc_id AS BIGINT))")
    return F.element_at(F.create_map(*(F.lit(x) for row in found for x in row)), F.col("doc_id"))


def whole_numbers(ids: list) -> bool:
    """Whether ids can be written into SQL text, which is parsed in one call to the JVM; Columns of literals need several for each."""
    return bool(ids) and all(type(i) is int and abs(i) < 1 << 63 for i in ids)


def part(f, n_tokens, average):  # noqa: ANN001, ANN201
    """What a token that occurs f times adds, without its weight, as numbers or columns; it grows with f and falls with length."""
    return f * (lexical.K1 + 1) / (f + lexical.K1 * (1 - lexical.B + lexical.B * n_tokens / average))


def opened(docs: DataFrame, tables: dict[str, DataFrame]) -> Stored:
    """An index over the tables of the stored layer."""
    at, columns = F.col("p.pos"), F.array(*(F.lit(c) for c in PLACES))
    each = tables["postings"].select("token", "block", "doc_id", "n_tokens", F.explode("places").alias("p"))
    each = each.select("token", "block", "doc_id", F.get(columns, at.bitwiseAND(3)).alias("col"), F.shiftright(at, 2).alias("pos"), "n_tokens")
    return Stored(docs, each, tables["about"].select("doc_id", "n_tokens"), **{n: tables[n] for n in ("entries", "heads", "about", "stats")})
