"""What a document is about, from its own text: language, headings, title, sections, key terms and the pairs that occur together."""

from __future__ import annotations

import heapq
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.session import from_each

#: Function words by language.
PROFILES = {
    "es": "de la el los las un una en y que del por con para su al lo como mas pero sus ya este esta son entre sobre todos tambien muy donde cuando porque cada sin hasta hay ser puede desde nos les",
    "en": "the of and to in is it for that with was on as by at from or this be are have not but they which their has an its we can will would there these about",
    "fr": "le la les de des du et est une dans que qui pour pas sur plus avec sont nous vous cette aux leur mais par tout bien",
    "de": "der die das und ist nicht ein eine mit den von sich auf des dem für auch als wird sind aber durch bei nach über oder",
    "pt": "de que não para com uma os as do da no na por mais como mas foi ao ele das dos seu sua ou quando muito também",
    "it": "il lo la gli che di del della per con non una sono come più anche nel alla da si ma questo nella suo loro essere hanno",
}
#: Least tokens and lead for a language, most evidence of a word.
LEAST_TOKENS, LEAST_LEAD, MOST_EVIDENCE = 12, 2, 3
#: Share of a sample at the start, terms, pairs, window, letters of a term, headings and their length.
HEAD, MOST_TERMS, MOST_PAIRS, WINDOW, TERM_LETTERS, MOST_HEADINGS, HEADING_CHARS = 0.75, 24, 16, 4, 3, 32, 120
#: Heading patterns.
MARKDOWN = "^#{1,6}\\s+(.+?)\\s*#*\\s*$"
NUMBERED = "^\\d+(?:\\.\\d+)*[.)]?\\s+(\\S.*)$"
CAPITALS = "^[A-ZÁÉÍÓÚÜÑ0-9][A-ZÁÉÍÓÚÜÑ0-9 \\-:,'()/&]{2,}$"
NUMBER = "^\\p{N}+$"
TITLE_CASE = "^[A-ZÁÉÍÓÚÜÑ][\\p{L}\\p{N}_'’-]*(?:\\s+[A-ZÁÉÍÓÚÜÑ][\\p{L}\\p{N}_'’-]*)+$"


def stopwords() -> list[str]:
    return sorted({w for words in PROFILES.values() for w in words.split()})


def sample(content: Column, most: int | None = None) -> Column:
    """The whole text; with a bound, start and end of a longer one."""
    body = F.replace(T.text_of(content), F.lit("\0"), F.lit(" "))
    if most is None:
        return body
    head = int(most * HEAD)
    return F.when(F.length(body) <= most, body).otherwise(F.concat(F.substring(body, 1, head), F.lit("\n"), F.substring(body, -(most - head), most - head)))


def language(tokens: Column) -> Column:
    """The language with most evidence, null where the lead is too small."""
    points = lambda words: reduce(Column.__add__, (F.least(F.size(F.filter(tokens, lambda t: t == w)), F.lit(MOST_EVIDENCE)) for w in words.split()))
    rated = F.array_sort(F.array(*(F.struct((-points(words)).alias("n"), F.lit(name).alias("name")) for name, words in PROFILES.items())))
    best, second = rated[0], rated[1]
    return F.when((F.size(tokens) >= LEAST_TOKENS) & (best["n"] < 0) & (second["n"] - best["n"] >= LEAST_LEAD), best["name"])


def language_by_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, language) by a join to the profiles: for corpora, where few tokens are function words."""
    spark = docs.sparkSession
    profile = spark.createDataFrame([(n, w) for n, words in PROFILES.items() for w in words.split()], "language string, token string")
    tokens = docs.select("doc_id", T.tok_rank(sample(F.col("content"))).alias("tokens"))
    counts = tokens.select("doc_id", F.explode("tokens").alias("token")).join(F.broadcast(profile.select("token").distinct()), "token", "left_semi").groupBy("doc_id", "token").agg(F.least(F.count(F.lit(1)), F.lit(MOST_EVIDENCE)).alias("n"))
    points = counts.join(F.broadcast(profile), "token").groupBy("doc_id", "language").agg(F.sum("n").alias("points"))
    ranked = points.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("points")).alias("n"), "language"))).alias("r"))
    lead = -F.col("r")[0]["n"] + F.coalesce(F.get("r", F.lit(1))["n"], F.lit(0))
    best = ranked.where(lead >= LEAST_LEAD).select("doc_id", F.col("r")[0]["language"].alias("language"))
    return tokens.select("doc_id", F.size("tokens").alias("n_tokens")).join(best, "doc_id", "left").select("doc_id", F.when(F.col("n_tokens") >= LEAST_TOKENS, F.col("language")).alias("language"))


def lines(content: Column) -> Column:
    return F.transform(F.split(sample(content), "\\r\\n|\\n|\\r"), lambda x: F.trim(F.regexp_replace(x, "^\\s+|\\s+$", "")))


def heading(line: Column) -> Column:
    """The heading that a line is, or null."""
    numbered = F.trim(F.regexp_extract(line, NUMBERED, 1))
    fits = (F.length(numbered) <= 90) & ~numbered.rlike("[.,;]$")
    return (
        F.when((line == "") | (F.length(line) > HEADING_CHARS), F.lit(None))
        .when(line.rlike(MARKDOWN), F.trim(F.regexp_extract(line, MARKDOWN, 1)))
        .when(line.rlike(NUMBERED), F.when(fits, numbered))
        .when(line.rlike(CAPITALS) & line.rlike("\\p{L}"), line)
        .when(line.rlike(TITLE_CASE) & ~F.endswith(line, F.lit(".")), line)
    )


def headings(content: Column) -> Column:
    found = F.filter(F.transform(lines(content), heading), lambda h: h.isNotNull())
    return F.slice(F.array_distinct(found), 1, MOST_HEADINGS)


def title(content: Column, name: Column, found: Column) -> Column:
    """First heading, else a short first line that is no sentence, else the file's name."""
    first = F.get(F.filter(lines(content), lambda x: x != ""), F.lit(0))
    plain = F.trim(F.regexp_replace(F.trim(F.translate(name, "_-", "  ")), "\\.[A-Za-z0-9]{1,8}$", ""))
    stem = F.when((plain != "") & (F.length(plain) <= HEADING_CHARS), plain)
    return F.coalesce(F.get(found, F.lit(0)), F.when((F.length(first) <= HEADING_CHARS) & ~F.endswith(first, F.lit(".")), first), stem)


def sections(content: Column, found: Column) -> Column:
    return F.when(F.size(found) > 0, F.size(found)).otherwise(F.when(T.text_of(content).rlike("\\S"), 1).otherwise(0))


def structure(docs: DataFrame) -> DataFrame:
    """(doc_id, headings, title, sections)."""
    found = docs.withColumn("headings", headings(F.col("content")))
    return found.select("doc_id", "headings", title(F.col("content"), F.col("name"), F.col("headings")).alias("title"), sections(F.col("content"), F.col("headings")).alias("sections"))


def meaningful(word: Column) -> Column:
    return (F.length(word) >= TERM_LETTERS) & ~word.isin(*stopwords()) & ~word.rlike(NUMBER)


def word_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a document's meaningful words in order, joined by one space."""
    return docs.select("doc_id", F.array_join(F.filter(T.tok_rank(sample(F.col("content"))), meaningful), " ").alias("text"))


def strongest(weights: dict[str, float], most: int) -> list[tuple[str, float]]:
    """The items of most weight, ties in order of the alphabet."""
    return heapq.nsmallest(most, weights.items(), key=lambda x: (-x[1], x[0]))


def one_top_terms(text: str, most: int = MOST_TERMS) -> list[tuple[str, int]]:
    return strongest(Counter(text.split()), most)


def top_terms(docs: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """(doc_id, term, n): most frequent meaningful terms, ties in order of the alphabet. They are counted where a text is read, so that no word is a row."""
    return from_each(word_texts(docs), lambda text: one_top_terms(text, most), "term string, n long")


def one_pairs(text: str, terms: set[str], most: int = MOST_PAIRS) -> list[tuple[str, str, int]]:
    kept = [w for w in text.split() if w in terms]
    counts: Counter = Counter()
    for i, a in enumerate(kept):
        # Two kept terms that are d apart are in all windows that end between the later one and WINDOW - 1 after the first.
        for d in range(1, min(WINDOW, len(kept) - i)):
            b = kept[i + d]
            if a != b:
                counts[(a, b) if a < b else (b, a)] += min(WINDOW - d, len(kept) - i - d)
    return [(a, b, n) for (a, b), n in strongest(counts, most)]


def pairs(docs: DataFrame, terms: DataFrame | None = None, most: int = MOST_PAIRS) -> DataFrame:
    """(doc_id, left, right, n): pairs of a document's terms within a window of four kept terms. terms: (doc_id, term), where they are not its top terms.

    The window slides one kept term at a time and counts all pairs in it at each step, so neighbours count as long as both stay in it.
    """
    texts, made = word_texts(docs), "left string, right string, n long"
    if terms is None:
        return from_each(texts, lambda text: one_pairs(text, {t for t, _ in one_top_terms(text)}, most), made)
    given = texts.join(terms.groupBy("doc_id").agg(F.collect_set("term").alias("terms")), "doc_id")
    return from_each(given, lambda text, of: one_pairs(text, set(of), most), made)


def analysis(docs: DataFrame) -> DataFrame:
    """(doc_id, language, title, headings, sections, terms, pairs, analyzed_chars, truncated); whole texts are analysed, so none is truncated."""
    terms = top_terms(docs)
    by_doc = terms.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "term", "n"))), lambda x: F.struct(x["term"].alias("term"), x["n"].alias("n"))).alias("terms"))
    paired = pairs(docs).groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "left", "right"))), lambda x: F.struct(x["left"].alias("left"), x["right"].alias("right"))).alias("pairs"))
    size = docs.select("doc_id", F.length(sample(F.col("content"))).alias("analyzed_chars"), F.lit(False).alias("truncated"))
    return structure(docs).join(language_by_rows(docs), "doc_id").join(by_doc, "doc_id", "left").join(paired, "doc_id", "left").join(size, "doc_id")


def normal_word(text: Column) -> Column:
    """Words as they compare: compatible forms composed, case folded, joined by one space."""
    return F.array_join(T.tok_rank(text), " ")


def terms_of_text(spark: SparkSession, text: str, most: int = MOST_TERMS) -> list[str]:
    """The top terms of a free text, to be compared with documents' terms."""
    return [r.term for r in top_terms(spark.createDataFrame([(0, text)], "doc_id long, content string"), most).orderBy(F.desc("n"), "term").collect()]


def resolved(analysed: DataFrame, docs: DataFrame, reference: str) -> DataFrame:
    """The analysis that a reference stands for: of its path, else of the first path with its name, else of its id; no row if none."""
    name = reference.rpartition("/")[2]
    rank = F.when(F.col("path") == reference, 0).when(F.col("name") == name, 1).when(F.col("doc_id").cast("string") == reference, 2)
    return analysed.join(docs.select("doc_id", "path", "name"), "doc_id").withColumn("rank", rank).where("rank is not null").orderBy("rank", "path").limit(1).drop("rank", "path", "name")


def refreshed(docs: DataFrame, analysed: DataFrame, version: int) -> DataFrame:
    """The stored analysis after a pass: rows of documents that are gone are dropped, and what is missing, changed or of another version is analysed anew."""
    due = stale(docs, analysed, version)
    fresh = analysis(due).join(due.select("doc_id", "content_hash"), "doc_id").withColumn("version", F.lit(version))
    kept = analysed.join(docs.select("doc_id"), "doc_id", "left_semi").join(due.select("doc_id"), "doc_id", "left_anti")
    return kept.unionByName(fresh.select(*kept.columns))


def stale(docs: DataFrame, analysed: DataFrame, version: int) -> DataFrame:
    """Documents whose analysis is missing, of another version or of other content: (doc_id, content_hash, version) is compared."""
    return docs.join(analysed.select("doc_id", F.col("content_hash").alias("h"), F.col("version").alias("v")), "doc_id", "left").where(F.col("v").isNull() | (F.col("v") != version) | ~F.col("h").eqNullSafe(F.col("content_hash"))).drop("h", "v")
