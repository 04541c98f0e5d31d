"""Typo tolerance: documents blocked by trigrams of their rarest words and verified by edit distance, and corrections of queries."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from inkwell.functions import text as T
from inkwell.session import from_each, written

#: Words and trigrams of a document's fingerprint, least trigrams, least word, shared share, candidates of a page.
MOST_WORDS, MOST_GRAMS, LEAST_GRAMS, LEAST_WORD, LEAST_SHARE, MOST_CANDIDATES = 32, 64, 8, 3, 0.2, 50
MOST_CORRECTIONS, MOST_SUGGESTIONS = 12, 3
#: Commonest words whose frequencies every task may hold.
MOST_HELD = 200_000
#: Trigrams that a scan is told at most.
MOST_PUSHED = 1000


def osa(a: str, b: str, cap: int) -> int:
    """Optimal string alignment distance of a and b; cap + 1 where it is above cap. Restricted to the diagonal band that can stay within the cap."""
    if abs(len(a) - len(b)) > cap:
        return cap + 1
    over = cap + 1
    two, one = {}, {j: j for j in range(min(len(b), cap) + 1)}
    for i, x in enumerate(a, 1):
        now = {}
        for j in range(max(0, i - cap), min(len(b), i + cap) + 1):
            if not j:
                now[j] = i
                continue
            y = b[j - 1]
            best = min(one.get(j, over) + 1, now.get(j - 1, over) + 1, one.get(j - 1, over) + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two.get(j - 2, over) + 1)
            now[j] = min(best, over)
        if min(now.values()) > cap:
            return over
        two, one = one, now
    return min(one.get(len(b), over), over)


@F.pandas_udf(IntegerType())
def osa_distance(pairs: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Edit distance of two columns under a cap: Spark's own has no transpositions."""
    for a, b, cap in pairs:
        yield pd.Series([osa(x, y, int(c)) for x, y, c in zip(a, b, cap, strict=True)], dtype="int32")


def shared_letters(a: Column, b: Column) -> Column:
    """Letters that both words have, each as often as both do: what edits can't hide."""
    letters = lambda x: F.split(x, "")
    return F.aggregate(F.array_distinct(letters(a)), F.lit(0), lambda n, c: n + F.least(F.length(a) - F.length(F.replace(a, c, F.lit(""))), F.length(b) - F.length(F.replace(b, c, F.lit("")))))


def within_edits(token: Column, word: Column) -> Column:
    """Cheap necessary condition, to be filtered on before distances are taken."""
    budget = T.edit_budget(token)
    return (budget > 0) & (F.abs(F.length(token) - F.length(word)) <= budget) & (shared_letters(token, word) >= F.greatest(F.length(token) - budget, F.lit(1)))


def one_rarest(words: list[str], known: dict[str, int]) -> list[tuple[str, int | None]]:
    """A document's words that can be among its rarest: the rarest of those whose frequency is known, and all others."""
    held = ((known[w], w) for w in words if w in known)
    return [(w, None) for w in words if w not in known] + [(w, n) for n, w in heapq.nsmallest(MOST_WORDS, held)]


def one_print(words: list[dict]) -> list[tuple[str]]:
    """The trigrams of a document's rarest words (n, word), taken from all of them position by position."""
    first: dict[str, tuple[int, int]] = {}
    for r, (_, word) in enumerate(heapq.nsmallest(MOST_WORDS, ((w["n"], w["word"]) for w in words))):
        for pos, gram in enumerate(dict.fromkeys(T.one_grams(word))):
            first[gram] = min(first.get(gram, (pos, r)), (pos, r))
    return [(g,) for g in sorted(first, key=first.get)[:MOST_GRAMS]] if len(first) >= LEAST_GRAMS else []


def fingerprints(docs: DataFrame, held: int = MOST_HELD) -> DataFrame:
    """(doc_id, gram): trigrams of each document's rarest words, taken from all of them position by position.

    Every task is told how many documents have each of the `held` commonest words, so that a document deals its rarest ones of these and its other words alone.
    """
    folded = T.tok_fold(F.concat_ws(" ", F.col("name"), T.text_of(F.col("content"))))
    texts = docs.select("doc_id", F.filter(F.array_distinct(folded), lambda w: F.length(w) >= LEAST_WORD).alias("words"))
    counts = written(texts.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "counts")
    known = docs.sparkSession.sparkContext.broadcast({r.word: r.n for r in counts.orderBy(F.desc("n"), "word").limit(held).collect()})
    rows = written(from_each(texts, lambda words: one_rarest(words, known.value), "word string, n long"), "rarest")
    rare = rows.where("n IS NULL").drop("n").join(counts, "word").select("doc_id", "word", "n")
    by_doc = rows.where("n IS NOT NULL").unionByName(rare).groupBy("doc_id").agg(F.collect_list(F.struct("n", "word")).alias("words"))
    return from_each(by_doc, one_print, "gram string")


def query_tokens(query: str) -> list[str]:
    """Folded words of three letters and more; none if all are nonsense."""
    tokens = list(dict.fromkeys(t for t in T.one_tok_fold(query) if len(t) >= LEAST_WORD))
    sensible = [t for t in tokens if len(set(t)) > 1 and any(c in "aeiou" for c in t)]
    return tokens if sensible else []


def candidates(prints: DataFrame, tokens: list[str], limit: int | None = MOST_CANDIDATES) -> DataFrame:
    """(doc_id, score): best share, over the tokens, of a token's trigrams that a document's fingerprint has; a page of the best, or all without a limit."""
    spark = prints.sparkSession
    rows = [(t, g, len(gs)) for t in tokens for gs in [set(T.one_grams(t))] for g in sorted(gs)]
    asked = spark.createDataFrame(rows, "token string, gram string, n int")
    grams = sorted({g for _, g, _ in rows})
    mine = prints.where(F.col("gram").isin(grams)) if len(grams) <= MOST_PUSHED else prints
    shared = mine.join(F.broadcast(asked), "gram").groupBy("doc_id", "token", "n").agg(F.count(F.lit(1)).alias("hits"))
    share = shared.withColumn("share", F.col("hits") / F.col("n")).where(F.col("share") >= LEAST_SHARE)
    rated = share.groupBy("doc_id").agg(F.max("share").alias("score"))
    return rated if limit is None else rated.orderBy(F.desc("score"), "doc_id").limit(limit)


def verified(docs: DataFrame, tokens: list[str]) -> DataFrame:
    """docs in which every token resolves, with evidence: an array of (token, rule, distance)."""
    asked = F.explode(F.array(*(F.lit(t) for t in tokens))).alias("token")
    folded = docs.select("doc_id", T.fold(T.text_of(F.col("name"))).alias("n"), T.fold(T.text_of(F.col("content"))).alias("t"))
    rows = folded.select("*", asked)
    rule = F.when(F.contains("n", "token"), "exact-name").when(F.contains("t", "token"), "exact-text")
    plain = rows.withColumn("rule", rule)
    words = plain.where("rule is null").select("doc_id", "token", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(T.WORD), F.lit(1)))).alias("word"))
    near = words.where(within_edits(F.col("token"), F.col("word"))).withColumn("d", osa_distance("token", "word", T.edit_budget(F.col("token"))))
    edits = near.where(F.col("d") <= T.edit_budget(F.col("token"))).groupBy("doc_id", "token").agg(F.min("d").alias("distance")).withColumn("rule", F.lit("edit"))
    resolved = plain.where("rule is not null").select("doc_id", "token", F.lit(0).alias("distance"), "rule").unionByName(edits)
    whole = resolved.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("token", "rule", "distance"))).alias("evidence")).where(F.size("evidence") == len(tokens))
    return docs.join(whole, "doc_id")


def search(docs: DataFrame, prints: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Documents with score and evidence, best first; none for nonsense."""
    tokens = query_tokens(query)
    if not tokens:
        return docs.limit(0).withColumns({"score": F.lit(0.0), "evidence": F.array().cast("array<struct<token:string,rule:string,distance:int>>")})
    # Every candidate is verified; only the page is limited.
    found = docs.join(written(candidates(prints, tokens, None), "candidates"), "doc_id")
    return verified(found, tokens).orderBy(F.desc("score"), F.lower("name"), "path").limit(limit)


def without_letters(word: Column, most: Column) -> Column:
    """The word, and the word without one or, where `most` says so, two of its letters."""
    places = lambda w: F.filter(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: i <= F.length(w))
    one = lambda w: F.transform(places(w), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    none = F.array().cast("array<string>")
    single = F.when(most > 0, one(word)).otherwise(none)
    double = F.when(most > 1, F.flatten(F.transform(one(word), one))).otherwise(none)
    return F.array_distinct(F.concat(F.array(word), single, double))


def neighbourhood(vocabulary: DataFrame) -> DataFrame:
    """(variant, word, occurrences): each folded word under what is left of it without one or two letters. Two words within so many edits, swaps among them, share a variant."""
    words = vocabulary.select(T.fold(F.col("token")).alias("word"), "occurrences").groupBy("word").agg(F.max("occurrences").alias("occurrences")).where(F.length("word") >= LEAST_WORD)
    # A token of two edits has eight letters, so its words have six.
    return words.select(F.explode(without_letters(F.col("word"), F.when(F.length("word") >= 6, 2).otherwise(1))).alias("variant"), "word", "occurrences")


def corrections(vocabulary: DataFrame, tokens: list[str], most: int = MOST_CORRECTIONS, variants: DataFrame | None = None) -> DataFrame:
    """(token, word, distance, occurrences): for each token the vocabulary's nearest words, nearest and then most frequent first. variants: the vocabulary's neighbourhood, where it is stored."""
    spark = vocabulary.sparkSession
    asked = spark.createDataFrame([(t,) for t in dict.fromkeys(tokens)], "token string")
    wanted = asked.select("token", F.explode(without_letters(F.col("token"), T.edit_budget(F.col("token")))).alias("variant"))
    shares = F.arrays_overlap(T.grams(F.col("token")), T.grams(F.col("word")))
    # The variants of one query's tokens: a few hundred rows.
    met = (neighbourhood(vocabulary) if variants is None else variants).join(F.broadcast(wanted), "variant").select("token", "word", "occurrences").distinct()
    near = met.where((F.col("token") != F.col("word")) & within_edits(F.col("token"), F.col("word")) & shares)
    rated = near.withColumn("distance", osa_distance("token", "word", T.edit_budget(F.col("token")))).where(F.col("distance") <= T.edit_budget(F.col("token")))
    order = Window.partitionBy("token").orderBy("distance", F.desc("occurrences"), "word")
    return rated.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("token", "word", "distance", "occurrences")
