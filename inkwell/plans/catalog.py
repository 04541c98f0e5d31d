"""Registered queries over the test tables, and DuckDB SQL for each that SQL can express.

Every query runs over its whole tables; `limit` stands only where a ranked page is the feature. Scores are rounded to six digits on both sides,
as sums depend on order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import derived, evaluate, every, fuzzy, graph, health, ingest, intelligence, lexical, organize, ranking, semantic, usage, vectors
from inkwell.operators.search import Engine, planned
from inkwell.plans import language
from inkwell.plans.corpus import DOCS_SQL, NOW, TOK_FOLD_SQL, TOK_GRAM_SQL, TOK_INDEX_SQL, TOK_RANK_SQL, USAGE_SQL, documents, table, usage_events
from inkwell.session import new_folder, parts_of, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function as a query, with its SQL."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return put


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# --- BM25 over the search language -------------------------------------------------------------------------------

POSTINGS_SQL = f"""{DOCS_SQL},
toks AS (SELECT doc_id, 'name' AS col, {TOK_INDEX_SQL.format(x="name")} AS t FROM docs UNION ALL SELECT doc_id, 'path', {TOK_INDEX_SQL.format(x="path")} FROM docs
         UNION ALL SELECT doc_id, 'content', {TOK_INDEX_SQL.format(x="content")} FROM docs),
postings AS (SELECT doc_id, col, unnest(t) AS token, unnest(range(len(t))) AS pos FROM toks),
lens AS (SELECT doc_id, sum(len(t)) AS n_tokens FROM toks GROUP BY doc_id),
stats AS (SELECT count(*) AS N, avg(n_tokens) AS av FROM lens)"""


def bm25_sql(plan: language.Plan) -> str:
    """BM25 of a plan, phrase by phrase, over positions."""
    parts, has = [], lambda t: f"h{t[1]}" if t[0] == "phrase" else "(" + (" AND " if t[0] == "all" else " OR ").join(has(x) for x in t[1]) + ")"
    for i, p in enumerate(plan.phrases):
        only = f"AND p0.col = '{p.column}'" if p.column else ""
        joins = " ".join(f"JOIN postings p{k} ON p{k}.doc_id = p0.doc_id AND p{k}.col = p0.col AND p{k}.pos = p0.pos + {k} AND p{k}.token = '{t}'" for k, t in enumerate(p.tokens) if k)
        parts.append(f"SELECT {i} AS phrase, p0.doc_id, count(*) AS f FROM postings p0 {joins} WHERE p0.token = '{p.tokens[0]}' {only} GROUP BY p0.doc_id")
    scoring = ", ".join(map(str, plan.scoring()))
    flags = ", ".join(f"bool_or(phrase = {i}) AS h{i}" for i in range(len(plan.phrases)))
    match = has(plan.match) + (f" AND NOT coalesce({has(plan.exclude)}, false)" if plan.exclude else "")
    filters = {"type": "extension", "source": "source", "size": "size"}
    held = "".join(f" AND {filters[n]} {op} {v!r}" if n in filters else f" AND CAST(modified_at AS DATE) {op} DATE '{v}'" for n, op, v in plan.filters)
    return f"""WITH {POSTINGS_SQL},
occ AS ({" UNION ALL ".join(parts)}),
idf AS (SELECT phrase, CASE WHEN ln((N - count(*) + 0.5) / (count(*) + 0.5)) > 0 THEN ln((N - count(*) + 0.5) / (count(*) + 0.5)) ELSE 1e-6 END AS w FROM occ, stats GROUP BY phrase, N),
rated AS (SELECT doc_id, -sum(CASE WHEN phrase IN ({scoring}) THEN w * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n_tokens / av)) ELSE 0 END) AS bm25, {flags}
          FROM occ JOIN idf USING (phrase) JOIN lens USING (doc_id), stats GROUP BY doc_id),
matched AS (SELECT doc_id, name, path, extension, source, size, modified_at, content, bm25 FROM rated JOIN docs USING (doc_id) WHERE {match}{held})"""


SEARCHES = {
    "bm25_term": "the",
    "bm25_and": "the and of",
    "bm25_or": "und OR les",
    "bm25_not": "the -of",
    "bm25_phrase": '"of the"',
    "bm25_name_field": "name:doc_7 OR path:fr",
    "bm25_filtered_pool": "the type:md size:>500 after:2021-12-31 before:2023-12-31",
}


def bm25_query(text: str) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    plan = language.plan(text)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return lexical.matches(lexical.index_of(documents(spark, sf_dir)), {"q": plan}).select("doc_id", r6("bm25").alias("bm25"))

    return run, bm25_sql(plan) + " SELECT doc_id, round(bm25, 6) AS bm25 FROM matched"


for _name, _text in SEARCHES.items():
    QUERIES[_name], ORACLE_SQL[_name] = bm25_query(_text)

TWO_TERMS = language.plan("the of")
POOL_SQL = bm25_sql(TWO_TERMS) + ", pool AS (SELECT * FROM matched ORDER BY bm25, path LIMIT 100)"


@query(POOL_SQL + " SELECT doc_id, path, round(bm25, 6) AS bm25 FROM pool")
def bm25_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.pool(lexical.index_of(documents(spark, sf_dir)), {"q": TWO_TERMS}, limit=20).select("doc_id", "path", r6("bm25").alias("bm25"))


@query(f"""WITH {POSTINGS_SQL}, it AS (SELECT item_id, {TOK_INDEX_SQL.format(x="text")} AS t FROM benchmark), ph AS (SELECT DISTINCT item_id, unnest(t[1:2]) AS token FROM it WHERE len(t) > 1),
fr AS (SELECT token, doc_id, count(*) AS f FROM postings WHERE token IN (SELECT token FROM ph) GROUP BY token, doc_id),
idf AS (SELECT token, CASE WHEN ln((N - count(*) + 0.5) / (count(*) + 0.5)) > 0 THEN ln((N - count(*) + 0.5) / (count(*) + 0.5)) ELSE 1e-6 END AS w FROM fr, stats GROUP BY token, N),
r AS (SELECT item_id, doc_id, -sum(w * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n_tokens / av))) AS bm25 FROM ph JOIN fr USING (token) JOIN idf USING (token) JOIN lens USING (doc_id), stats GROUP BY item_id, doc_id)
SELECT item_id, doc_id, round(bm25, 6) AS bm25 FROM r JOIN docs USING (doc_id) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY bm25, path) = 1""")
def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of queries in one job: for each benchmark item its first two words; the best document of each."""
    items = table(spark, sf_dir, "benchmark").select("item_id", T.tok_index(F.col("text")).alias("t")).where("size(t) > 1").select("item_id", F.slice("t", 1, 2).alias("t"))
    found = lexical.best_of_any(lexical.index_of(documents(spark, sf_dir)), items.select(F.col("item_id").alias("query"), F.col("t").alias("tokens")))
    return found.select(F.col("query").cast("long").alias("item_id"), "doc_id", r6("bm25").alias("bm25"))


# --- ranking ------------------------------------------------------------------------------------------------------


def ranked_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(lexical.index_of(documents(spark, sf_dir)), NOW)
    return engine.signals("the of", TWO_TERMS, 20)[0]


RANK_SQL = f"""{POOL_SQL},
body AS (SELECT doc_id, {TOK_RANK_SQL.format(x="content")} AS t, {TOK_RANK_SQL.format(x="name")} AS nt, {TOK_RANK_SQL.format(x="regexp_replace(name, '[.][^.]*$', '')")} AS st,
                list_distinct({TOK_RANK_SQL.format(x="regexp_replace(path, '[^/]*$', '')")}) AS dt FROM pool),
hits AS (SELECT doc_id, w, p FROM (SELECT doc_id, unnest(t) AS w, unnest(range(len(t))) AS p FROM body) WHERE w IN ('the', 'of')),
runs AS (SELECT doc_id, p, max(p) FILTER (w = 'the') OVER x AS a, max(p) FILTER (w = 'of') OVER x AS b FROM hits WINDOW x AS (PARTITION BY doc_id ORDER BY p)),
win AS (SELECT doc_id, min(p - least(a, b) + 1) AS width FROM runs WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY doc_id),
sig AS (SELECT doc_id, name, path, content, modified_at, size, extension, source,
    CASE WHEN array_to_string(nt, ' ') = 'the of' OR array_to_string(st, ' ') = 'the of' THEN 1.0 ELSE 0.0 END AS s_filename_exact,
    (list_contains(nt, 'the')::INT + list_contains(nt, 'of')::INT) / 2.0 AS s_filename_tokens,
    (list_contains(dt, 'the')::INT + list_contains(dt, 'of')::INT) / 2.0 AS s_path_match,
    CASE WHEN contains(' ' || array_to_string(t, ' ') || ' ', ' the of ') THEN 1.0 ELSE 0.0 END AS s_phrase_exact,
    (least(len(list_filter(t, lambda x: x = 'the')) / 10.0, 1.0) + least(len(list_filter(t, lambda x: x = 'of')) / 10.0, 1.0)) / 2 AS s_term_freq,
    CASE WHEN width IS NULL THEN 0.0 ELSE least(2.0 / width, 1.0) END AS s_proximity,
    greatest(-bm25, 0) / (1 + greatest(-bm25, 0)) AS s_bm25,
    CASE WHEN length(coalesce(content, '')) > 0 THEN 1.0 ELSE 0.4 END AS s_doc_type, 1.0 AS s_source,
    0.5 + 0.5 * exp(-greatest(floor((epoch(TIMESTAMP '{NOW}') - epoch(modified_at)) / 86400), 0) / 180) AS s_recency, 0.0 AS s_usage, 0.0 AS s_context
    FROM pool JOIN body USING (doc_id) LEFT JOIN win USING (doc_id)),
scored AS (SELECT *, (3 * s_filename_exact + 2 * s_filename_tokens + 0.8 * s_path_match + 2 * s_phrase_exact + 1.5 * s_term_freq + 1.5 * s_proximity + 2 * s_bm25 + 0.5 * s_doc_type + 0.4 * s_source + 0.3 * s_recency) / 14.0 AS score FROM sig),
page AS (SELECT * FROM scored ORDER BY score DESC, path LIMIT 20)"""
SIGNAL_NAMES = list(ranking.Weights.__dataclass_fields__)


@query(RANK_SQL + " SELECT doc_id, " + ", ".join(f"round(s_{s}::DOUBLE, 6) AS s_{s}" for s in SIGNAL_NAMES) + " FROM sig")
def rank_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_pool(spark, sf_dir).select("doc_id", *(r6(F.col(f"s_{s}").cast("double")).alias(f"s_{s}") for s in SIGNAL_NAMES))


@query(RANK_SQL + " SELECT doc_id, path, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, path) AS rank FROM page")
def rank_composite_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = ranked_pool(spark, sf_dir).withColumn("score", ranking.score(ranking.Weights())).orderBy(F.desc("score"), "path").limit(20)
    # A page of 20 rows: one task numbers it.
    return best.select("doc_id", "path", r6("score").alias("score"), F.row_number().over(Window.orderBy(F.desc("score"), "path")).cast("long").alias("rank"))


@query(RANK_SQL + " SELECT doc_id, u.signal, round(u.part, 6) AS part FROM (SELECT doc_id, unnest([" + ", ".join(f"{{'signal': '{s}', 'part': (s_{s} * {w} / 14.0)::DOUBLE}}" for s, w in ranking.asdict(ranking.Weights()).items()) + "]) AS u FROM page)")
def rank_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(lexical.index_of(documents(spark, sf_dir)), NOW)
    return engine.explain("the of", 20).select("doc_id", F.explode("parts").alias("signal", "part")).select("doc_id", "signal", r6("part").alias("part"))


@query(
    RANK_SQL
    + """, cut AS (SELECT doc_id, content, coalesce(least(nullif(strpos(replace(lower(content), 'ß', 'ss'), 'the'), 0), nullif(strpos(replace(lower(content), 'ß', 'ss'), 'of'), 0)), 1) AS place FROM page),
    w AS (SELECT doc_id, content, greatest(place - 80, 1) AS s FROM cut)
    SELECT doc_id, CASE WHEN s > 1 THEN '…' ELSE '' END || trim(regexp_replace(substr(content, s, 160), '\\s+', ' ', 'g')) || CASE WHEN s + 160 <= length(content) THEN '…' ELSE '' END AS snippet FROM w"""
)
def rank_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(lexical.index_of(documents(spark, sf_dir)), NOW).search("the of").select("doc_id", "snippet")


# --- filters and presentation ---------------------------------------------------------------------------------------

FILTERS = {"filter_type": "type:.MD", "filter_dates": "after:2022-06-30 before:2023-02-01", "filter_size": "size:>=2KB", "filter_combined": "type:csv size:<1KB after:2022-01-01"}


def filter_query(text: str) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    filters = language.plan(text).filters
    columns = {"type": "extension", "source": "source", "size": "size"}
    held = " AND ".join(f"{columns[n]} {op} {v!r}" if n in columns else f"CAST(modified_at AS DATE) {op} DATE '{v}'" for n, op, v in filters)
    return lambda spark, sf_dir: documents(spark, sf_dir).where(language.filters_column(filters)).select("doc_id", "path", "size"), f"WITH {DOCS_SQL} SELECT doc_id, path, size FROM docs WHERE {held}"


for _name, _text in FILTERS.items():
    QUERIES[_name], ORACLE_SQL[_name] = filter_query(_text)


@query(f"WITH {DOCS_SQL} SELECT doc_id, path FROM docs WHERE source = 'src3'")
def filter_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test tables' sources are not of the language's closed list, so the filter is given as the keyword is."""
    return documents(spark, sf_dir).where(language.filter_column("source", "=", "src3")).select("doc_id", "path")


@query(f"WITH {DOCS_SQL} SELECT doc_id, path, modified_at FROM docs WHERE extension = '.pdf' ORDER BY modified_at DESC, path LIMIT 50")
def filter_only_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.filter_only(documents(spark, sf_dir), language.plan("type:pdf"), 50).select("doc_id", "path", "modified_at")


for _sort, _order in {"name": "lower(name), name, path", "modified": "modified_at DESC NULLS LAST, path", "size": "size DESC NULLS LAST, path"}.items():
    QUERIES[f"organize_sort_{_sort}"] = lambda spark, sf_dir, s=_sort: organize.sorted_by(documents(spark, sf_dir), s, 100).select("doc_id", "path")
    ORACLE_SQL[f"organize_sort_{_sort}"] = f"WITH {DOCS_SQL} SELECT doc_id, path FROM docs ORDER BY {_order} LIMIT 100"
for _by, _key in {"folder": "regexp_extract(path, '^(.*)/[^/]*$', 1)", "type": "lower(extension)", "source": "source", "date": "strftime(modified_at, '%Y-%m')"}.items():
    QUERIES[f"organize_group_{_by}"] = lambda spark, sf_dir, b=_by: organize.grouped(documents(spark, sf_dir), b)
    ORACLE_SQL[f"organize_group_{_by}"] = f"WITH {DOCS_SQL} SELECT {_key} AS group_key, count(*) AS n, sum(size)::BIGINT AS total_size FROM docs GROUP BY 1"


@query(f"WITH {DOCS_SQL} SELECT count(*) AS n_results, count(*) AS n_grouped, true AS kept FROM docs")
def organize_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return organize.count_invariants(docs, organize.grouped(docs, "folder"))


@query(f"WITH {DOCS_SQL} SELECT doc_id, path FROM docs WHERE doc_id > 100 ORDER BY doc_id LIMIT 128")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return organize.page_after(documents(spark, sf_dir), "doc_id", 100, 128).select("doc_id", "path")


KEYWORDS = planned("the OR und", source="src3", doc_type="CSV")


@query(bm25_sql(KEYWORDS) + " SELECT doc_id, round(bm25, 6) AS bm25 FROM matched")
def search_with_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters given beside the query's text."""
    return lexical.matches(lexical.index_of(documents(spark, sf_dir)), {"q": KEYWORDS}).select("doc_id", r6("bm25").alias("bm25"))


@query(f"WITH {DOCS_SQL} SELECT doc_id, path, 'filter' AS layer FROM docs WHERE extension = '.pdf' AND size > 300 ORDER BY modified_at DESC, path LIMIT 40")
def search_without_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query of filters alone gives the newest documents."""
    return Engine(lexical.index_of(documents(spark, sf_dir)), NOW).search("type:pdf size:>300", limit=40).select("doc_id", "path", "layer")


# --- text ----------------------------------------------------------------------------------------------------------


@query(
    f"WITH {DOCS_SQL} SELECT doc_id, array_to_string({TOK_INDEX_SQL.format(x='content')}, ' ') AS tok_index, array_to_string({TOK_RANK_SQL.format(x='name')}, ' ') AS tok_rank, "
    f"array_to_string({TOK_FOLD_SQL.format(x='content')}, ' ') AS tok_fold, {TOK_GRAM_SQL.format(x='name')} AS gram_text FROM docs"
)
def tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    join = lambda a: F.array_join(a, " ")
    return documents(spark, sf_dir).select("doc_id", join(T.tok_index(F.col("content"))).alias("tok_index"), join(T.tok_rank(F.col("name"))).alias("tok_rank"), join(T.tok_fold(F.col("content"))).alias("tok_fold"), T.gram_text(F.col("name")).alias("gram_text"))


@query(f"WITH {DOCS_SQL} SELECT doc_id, sha256(source || chr(0) || path) AS identity, sha256(content) AS content_hash FROM docs")
def document_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.identity(F.col("source"), F.col("path")).alias("identity"), F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))


@query(f"WITH {POSTINGS_SQL} SELECT token, count(*) AS occurrences FROM postings GROUP BY token ORDER BY occurrences DESC, token LIMIT 50000")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.vocabulary(lexical.index_of(documents(spark, sf_dir)))


@query(f"WITH {POSTINGS_SQL} SELECT token, count(DISTINCT doc_id) AS df FROM postings GROUP BY token")
def doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.postings(documents(spark, sf_dir)).select("token", "doc_id").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("df"))


NEAR_WORDS = ("idiott", "patethic", "wrothless")


@query(f"""WITH {POSTINGS_SQL}, v AS (SELECT DISTINCT token AS word FROM postings WHERE length(token) >= 3), q(token) AS (VALUES {", ".join(f"('{w}')" for w in NEAR_WORDS)}),
c AS (SELECT token, word, CASE WHEN length(token) < 4 THEN 0 WHEN length(token) < 8 THEN 1 ELSE 2 END AS budget,
      list_sum(list_transform(list_distinct(string_split(token, '')), lambda x: least(length(token) - length(replace(token, x, '')), length(word) - length(replace(word, x, ''))))) AS common FROM v, q)
SELECT token, word, budget, common::BIGINT AS common FROM c WHERE abs(length(token) - length(word)) <= budget AND common >= greatest(length(token) - budget, 1)""")
def letters_within_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheap condition before distances: words whose length and letters leave few enough edits."""
    asked = spark.createDataFrame([(w,) for w in NEAR_WORDS], "token string")
    words = lexical.postings(documents(spark, sf_dir)).select(F.col("token").alias("word")).distinct().where(F.length("word") >= 3)
    near = words.crossJoin(F.broadcast(asked)).where(fuzzy.within_edits(F.col("token"), F.col("word")))  # three asked words against all
    return near.select("token", "word", T.edit_budget(F.col("token")).alias("budget"), fuzzy.shared_letters(F.col("token"), F.col("word")).cast("long").alias("common"))


@query(f"WITH {POSTINGS_SQL} SELECT DISTINCT token, CASE WHEN length(token) < 4 THEN 0 WHEN length(token) < 8 THEN 1 ELSE 2 END AS budget FROM postings")
def edit_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.postings(documents(spark, sf_dir)).select("token").distinct().select("token", T.edit_budget(F.col("token")).alias("budget"))


@query(f"""WITH {DOCS_SQL}, f AS (SELECT doc_id, trim(regexp_replace(coalesce(content, ''), '\\s+', ' ', 'g')) AS flat FROM docs)
SELECT doc_id, CASE WHEN length(flat) <= 200 THEN flat ELSE coalesce(nullif(regexp_extract(substr(flat, 1, 200), '^(.*)\\s', 1), ''), substr(flat, 1, 200)) || ' ...' END AS snippet FROM f""")
def fuzzy_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.short_snippet(F.col("content")).alias("snippet"))


STOP_SQL = ", ".join(f"'{w}'" for w in intelligence.stopwords())
WORDS_SQL = f"""{DOCS_SQL}, wt AS (SELECT doc_id, {TOK_RANK_SQL.format(x="content")} AS t FROM docs),
words AS (SELECT * FROM (SELECT doc_id, unnest(t) AS term, unnest(range(len(t))) AS pos FROM wt) WHERE length(term) >= 3 AND term NOT IN ({STOP_SQL}) AND NOT regexp_full_match(term, '\\p{{N}}+')),
terms AS (SELECT doc_id, term, n FROM (SELECT doc_id, term, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, term) AS r FROM words GROUP BY doc_id, term) WHERE r <= 24)"""


@query(f"WITH {WORDS_SQL} SELECT doc_id, term, n FROM terms")
def top_terms_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intelligence.top_terms(documents(spark, sf_dir))


@query(f"""WITH {WORDS_SQL}, kept AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM words JOIN terms USING (doc_id, term)),
steps AS (SELECT s.doc_id, s.i, a.i AS ai, a.term AS a_term, b.i AS bi, b.term AS b_term FROM kept s JOIN kept a ON a.doc_id = s.doc_id AND a.i BETWEEN s.i - 3 AND s.i JOIN kept b ON b.doc_id = s.doc_id AND b.i BETWEEN s.i - 3 AND s.i AND a.i < b.i AND a.term <> b.term),
counts AS (SELECT doc_id, least(a_term, b_term) AS "left", greatest(a_term, b_term) AS "right", count(*) AS n FROM steps GROUP BY 1, 2, 3)
SELECT doc_id, "left", "right", n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, "left", "right") AS r FROM counts) WHERE r <= 16""")
def cooccurrence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intelligence.pairs(documents(spark, sf_dir))


PROFILE_SQL = ", ".join(f"('{n}', '{w}')" for n, words in intelligence.PROFILES.items() for w in words.split())


@query(f"""WITH {DOCS_SQL}, wt AS (SELECT doc_id, {TOK_RANK_SQL.format(x="content")} AS t FROM docs), prof(language, term) AS (VALUES {PROFILE_SQL}),
c AS (SELECT doc_id, term, least(count(*), 3) AS n FROM (SELECT doc_id, unnest(t) AS term FROM wt) WHERE term IN (SELECT term FROM prof) GROUP BY doc_id, term),
pts AS (SELECT doc_id, language, sum(n) AS p FROM c JOIN prof USING (term) GROUP BY doc_id, language),
best AS (SELECT doc_id, language, p, row_number() OVER w AS r, coalesce(lead(p) OVER w, 0) AS second FROM pts WINDOW w AS (PARTITION BY doc_id ORDER BY p DESC, language))
SELECT wt.doc_id, CASE WHEN len(t) >= 12 AND p - second >= 2 THEN language END AS language FROM wt LEFT JOIN best ON best.doc_id = wt.doc_id AND r = 1""")
def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intelligence.language_by_rows(documents(spark, sf_dir))


HEADING_SQL = """CASE WHEN l = '' OR length(l) > 120 THEN NULL
    WHEN regexp_matches(l, '^#{1,6}\\s+(.+?)\\s*#*\\s*$') THEN trim(regexp_extract(l, '^#{1,6}\\s+(.+?)\\s*#*\\s*$', 1))
    WHEN regexp_matches(l, '^\\d+(?:\\.\\d+)*[.)]?\\s+(\\S.*)$') THEN CASE WHEN length(num) <= 90 AND NOT regexp_matches(num, '[.,;]$') THEN num END
    WHEN regexp_matches(l, '^[A-ZÁÉÍÓÚÜÑ0-9][A-ZÁÉÍÓÚÜÑ0-9 \\-:,''()/&]{2,}$') AND regexp_matches(l, '\\p{L}') THEN l
    WHEN regexp_matches(l, '^[A-ZÁÉÍÓÚÜÑ][\\p{L}\\p{N}_''’-]*(?:\\s+[A-ZÁÉÍÓÚÜÑ][\\p{L}\\p{N}_''’-]*)+$') AND NOT ends_with(l, '.') THEN l END"""
LINES_SQL = f"""{DOCS_SQL}, ls AS (SELECT doc_id, name, unnest(string_split_regex(content, '\\r\\n|\\n|\\r')) AS raw, unnest(range(len(string_split_regex(content, '\\r\\n|\\n|\\r')))) AS i FROM docs),
tl AS (SELECT doc_id, name, i, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS l FROM ls),
hl AS (SELECT *, trim(regexp_extract(l, '^\\d+(?:\\.\\d+)*[.)]?\\s+(\\S.*)$', 1)) AS num FROM tl),
hs AS (SELECT doc_id, i, h FROM (SELECT doc_id, i, {HEADING_SQL} AS h FROM hl) WHERE h IS NOT NULL),
uh AS (SELECT doc_id, h, min(i) AS i FROM hs GROUP BY doc_id, h),
nh AS (SELECT doc_id, h, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM uh QUALIFY n <= 32)"""


#: The test tables' texts have no headings: every third gets some, of all kinds.
HEADED = "\n\n## Part {}  \n{}\n1.2 Numbered part\nALL CAPITALS: A-B\nTitle Case Line\nnot a heading.\n## Part {}\n"
HEADED_SQL = "WITH " + LINES_SQL.replace("FROM documents)", "FROM (SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN replace(replace('" + HEADED + "', '{}', doc_id::VARCHAR), '\\n', chr(10)) || text ELSE text END AS text) FROM documents))", 1)


@query(HEADED_SQL + " SELECT doc_id, n, h AS heading FROM nh")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.replace(F.lit(HEADED), F.lit("{}"), F.col("doc_id").cast("string"))
    headed = documents(spark, sf_dir).withColumn("content", F.when(F.col("doc_id") % 3 == 0, F.concat(head, "content")).otherwise(F.col("content")))
    found = intelligence.structure(headed).select("doc_id", F.posexplode("headings").alias("n", "heading"))
    return found.select("doc_id", (F.col("n") + 1).cast("long").alias("n"), "heading")


@query(f"""WITH {LINES_SQL}, f AS (SELECT doc_id, arg_min(l, i) AS first FROM tl WHERE l <> '' GROUP BY doc_id), c AS (SELECT doc_id, count(*) AS k FROM nh GROUP BY doc_id)
SELECT d.doc_id, coalesce(nh.h, CASE WHEN length(first) <= 120 AND NOT ends_with(first, '.') THEN first END, trim(regexp_replace(trim(translate(d.name, '_-', '  ')), '\\.[A-Za-z0-9]{{1,8}}$', ''))) AS title,
       coalesce(k, CASE WHEN first IS NOT NULL THEN 1 ELSE 0 END) AS sections
FROM docs d LEFT JOIN nh ON nh.doc_id = d.doc_id AND n = 1 LEFT JOIN f ON f.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id""")
def title_and_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intelligence.structure(documents(spark, sf_dir)).select("doc_id", "title", F.col("sections").cast("long").alias("sections"))


TITLE_SQL = ORACLE_SQL["title_and_sections"].removeprefix(f"WITH {LINES_SQL}, ")


@query(f"""WITH {LINES_SQL}, {WORDS_SQL.removeprefix(DOCS_SQL + ", ")}, tt AS (SELECT doc_id, string_agg(term || ':' || n, ' ' ORDER BY n DESC, term) AS terms FROM terms GROUP BY doc_id), {TITLE_SQL.split("SELECT d.doc_id")[0]}, ts AS (SELECT d.doc_id{TITLE_SQL.split("SELECT d.doc_id")[1]})
SELECT doc_id, title, sections, terms, length(coalesce(content, '')) AS analyzed_chars FROM docs JOIN ts USING (doc_id) LEFT JOIN tt USING (doc_id)""")
def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analysis of each document; its pairs and its language have queries of their own."""
    terms = F.array_join(F.transform("terms", lambda t: F.concat_ws(":", t["term"], t["n"].cast("string"))), " ")
    return intelligence.analysis(documents(spark, sf_dir)).select("doc_id", "title", F.col("sections").cast("long").alias("sections"), terms.alias("terms"), F.col("analyzed_chars").cast("long").alias("analyzed_chars"))


@query(f"WITH {DOCS_SQL} SELECT r AS reference, coalesce((SELECT doc_id FROM docs WHERE path = r), (SELECT doc_id FROM docs WHERE name = r ORDER BY path LIMIT 1), (SELECT doc_id FROM docs WHERE doc_id::VARCHAR = r)) AS doc_id FROM (VALUES ('doc_6.pdf'), ('11'), ('/nowhere/doc_9.txt')) v(r) WHERE r IN ('doc_6.pdf', '11') UNION ALL SELECT '/nowhere/doc_9.txt', doc_id FROM docs WHERE name = 'doc_9.txt'")
def analysis_of_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = intelligence.language_by_rows(docs)
    return reduce(DataFrame.unionByName, (intelligence.resolved(held, docs, r).select(F.lit(r).alias("reference"), "doc_id") for r in ("doc_6.pdf", "11", "/nowhere/doc_9.txt")))


# --- n-gram similarity and vectors -------------------------------------------------------------------------------------

GRAM_SQL = f"""{DOCS_SQL}, gt AS (SELECT doc_id, {TOK_GRAM_SQL.format(x="(name || ' ' || coalesce(content, ''))")} AS x FROM docs),
gr AS (SELECT doc_id, unnest(list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3))) AS gram, unnest(range(1, length(x) - 1)) AS i FROM gt),
kept AS (SELECT doc_id, gram, tf FROM (SELECT doc_id, gram, count(*) AS tf, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(i)) AS r FROM gr GROUP BY doc_id, gram) WHERE r <= 200),
dfs AS (SELECT gram, count(*) AS df FROM kept GROUP BY gram), nd AS (SELECT count(*) AS n FROM docs),
wts AS (SELECT doc_id, gram, (1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1) AS w FROM kept JOIN dfs USING (gram), nd)"""


@query(f"WITH {GRAM_SQL} SELECT gram, df, round(ln((n + 1) / (df + 1)) + 1, 6) AS idf FROM dfs, nd")
def semantic_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = semantic.index_of(documents(spark, sf_dir))
    return index.frequency.crossJoin(F.broadcast(index.n_docs)).select("gram", "df", r6(semantic.idf(F.col("N"), F.col("df"))).alias("idf"))


@query(f"WITH {GRAM_SQL} SELECT doc_id, round(sqrt(sum(w * w)), 6) AS norm FROM wts GROUP BY doc_id")
def semantic_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.index_of(documents(spark, sf_dir)).norms.select("doc_id", r6("norm").alias("norm"))


SEMANTIC_QUERY = "thering andthe onthe"
_tf = {g: SEMANTIC_QUERY.count(g) for g in dict.fromkeys(T.one_grams(SEMANTIC_QUERY))}
_gram_values = ", ".join(f"('{g}', {sum(1 for x in T.one_grams(SEMANTIC_QUERY) if x == g)})" for g in _tf)
_query_words = "[" + ", ".join(f"'{w}'" for w in SEMANTIC_QUERY.split()) + "]"


@query(f"""WITH {GRAM_SQL}, q(gram, tf) AS (VALUES {_gram_values}), qw AS (SELECT gram, (1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1) AS q FROM q JOIN dfs USING (gram), nd),
nm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM wts GROUP BY doc_id),
s AS (SELECT doc_id, sum(w * q) / (any_value(norm) * (SELECT sqrt(sum(q * q)) FROM qw)) AS similarity FROM wts JOIN qw USING (gram) JOIN nm USING (doc_id) GROUP BY doc_id),
cw AS (SELECT doc_id, unnest(t) AS word, unnest(range(len(t))) AS i FROM (SELECT doc_id, string_split(x, ' ') AS t FROM gt)),
kw AS (SELECT doc_id, list(word) AS words FROM (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(i)) AS r FROM cw WHERE length(word) >= 3 GROUP BY doc_id, word) WHERE r <= 200 GROUP BY doc_id)
SELECT doc_id, round(similarity, 6) AS similarity FROM s JOIN kw USING (doc_id) WHERE similarity >= 0.12 AND
    (list_has_any(words, {_query_words}) OR len(list_filter(words, lambda d: length(d) >= 5 AND len(list_filter({_query_words}, lambda y: length(y) >= 5 AND (starts_with(y, d) OR starts_with(d, y)))) > 0)) > 0)
ORDER BY similarity DESC, doc_id LIMIT 20""")
def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.search(semantic.index_of(documents(spark, sf_dir)), SEMANTIC_QUERY).select("doc_id", r6("similarity").alias("similarity"))


# --- typos ---------------------------------------------------------------------------------------------------------------

FUZZY_QUERY = "idiott patethic"
FP_SQL = f"""{DOCS_SQL}, ft AS (SELECT doc_id, list_distinct({TOK_FOLD_SQL.format(x="(name || ' ' || coalesce(content, ''))")}) AS t FROM docs),
fw AS (SELECT doc_id, word FROM (SELECT doc_id, unnest(t) AS word FROM ft) WHERE length(word) >= 3),
rare AS (SELECT doc_id, word, r FROM (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY df, word) AS r FROM fw JOIN (SELECT word, count(*) AS df FROM fw GROUP BY word) USING (word)) WHERE r <= 32),
wg AS (SELECT doc_id, r, unnest(list_transform(range(1, length(word) - 1), lambda i: substr(word, i, 3))) AS gram, unnest(range(1, length(word) - 1)) AS p FROM rare),
wd AS (SELECT doc_id, r, gram, min(p) AS p FROM wg GROUP BY doc_id, r, gram),
wp AS (SELECT doc_id, r, gram, row_number() OVER (PARTITION BY doc_id, r ORDER BY p) - 1 AS pos FROM wd),
first AS (SELECT doc_id, gram, min(pos * 1000 + r) AS k FROM wp GROUP BY doc_id, gram),
fp AS (SELECT doc_id, gram FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k, gram) AS n, count(*) OVER (PARTITION BY doc_id) AS al FROM first) WHERE n <= 64 AND al >= 8)"""
_fuzzy_values = ", ".join(f"('{t}', '{g}', {len(set(T.one_grams(t)))})" for t in FUZZY_QUERY.split() for g in sorted(set(T.one_grams(t))))


@query(f"WITH {FP_SQL} SELECT doc_id, gram FROM fp")
def fuzzy_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.fingerprints(documents(spark, sf_dir))


@query(f"""WITH {FP_SQL}, q(token, gram, n) AS (VALUES {_fuzzy_values}), s AS (SELECT doc_id, token, count(*) / any_value(n) AS share FROM fp JOIN q USING (gram) GROUP BY doc_id, token)
SELECT doc_id, round(max(share), 6) AS score FROM s WHERE share >= 0.2 GROUP BY doc_id ORDER BY max(share) DESC, doc_id LIMIT 50""")
def fuzzy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.candidates(fuzzy.fingerprints(documents(spark, sf_dir)), fuzzy.query_tokens(FUZZY_QUERY)).select("doc_id", r6("score").alias("score"))


@query(None)
def fuzzy_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restricted edit distance is no SQL function; tests hold it against the published recurrence."""
    docs = documents(spark, sf_dir)
    return fuzzy.search(docs, fuzzy.fingerprints(docs), "idiott").select("doc_id", "path", r6("score").alias("score"), F.to_json("evidence").alias("evidence"))


@query(None)
def suggest_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.corrections(lexical.vocabulary(lexical.index_of(documents(spark, sf_dir)), limit=None), ["idiott", "patethic", "wrothless"])


@query("""SELECT q.vec_id AS query_id, c.vec_id, round(c.s, 6) AS similarity FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q,
LATERAL (SELECT e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings e WHERE e.vec_id <> q.vec_id) c
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(c.s, 6) DESC, c.vec_id) <= 10""")
def embedding_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact cosine of a stated query set against all rows."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors.cosine_topk(e, F.col("vec_id") % 100 == 0, 10)


# --- stored layers ---------------------------------------------------------------------------------------------------------

#: Where an application has stored the layers of some tables.
FOLDERS: dict[tuple[str, str], str] = {}


def folder_of(spark: SparkSession, sf_dir: str) -> str:
    key = spark.sparkContext.applicationId, sf_dir
    if key not in FOLDERS:
        FOLDERS[key] = new_folder(spark, "layers")
    return FOLDERS[key]


def stored_index(spark: SparkSession, sf_dir: str) -> lexical.Index:
    """Kept in step with the documents, then opened for reading a page of them."""
    path = folder_of(spark, sf_dir)
    derived.refresh(documents(spark, sf_dir), path, derived.LAYERS["lexical"])
    return derived.lexical_index(documents(spark, sf_dir, dealt=False), path, rebuild=False)


def stored_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    plan = language.plan(text)
    return lambda spark, sf_dir: lexical.matches(stored_index(spark, sf_dir), {"q": plan}).select("doc_id", r6("bm25").alias("bm25"))


for _name, _text in SEARCHES.items():
    QUERIES[f"stored_{_name}"], ORACLE_SQL[f"stored_{_name}"] = stored_query(_text), ORACLE_SQL[_name]


@query(ORACLE_SQL["bm25_pool"])
def stored_bm25_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.pool(stored_index(spark, sf_dir), {"q": TWO_TERMS}, limit=20).select("doc_id", "path", r6("bm25").alias("bm25"))


FILTERED = "(the OR und) -qui type:md size:>500"


@query(bm25_sql(language.plan(FILTERED)) + " SELECT doc_id, path, round(bm25, 6) AS bm25 FROM matched ORDER BY matched.bm25, path LIMIT 50")
def stored_bm25_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of alternatives with what is excluded and filters, from the blocks that can hold it."""
    return lexical.pool(stored_index(spark, sf_dir), {"q": language.plan(FILTERED)}, limit=10).select("doc_id", "path", r6("bm25").alias("bm25"))


@query(ORACLE_SQL["bm25_pool"])
def stored_bm25_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same page from a layer that was stored of former documents and then brought in step: some were missing, some are gone, some had another text."""
    now, path, layer = documents(spark, sf_dir), new_folder(spark, "updated"), derived.LAYERS["lexical"]
    other = F.col("doc_id") % 20 == 1
    before = now.where(F.col("doc_id") % 20 != 0).withColumns({"content": F.when(other, F.lit("the former text of the document")).otherwise(F.col("content")), "modified_at": F.when(other, F.col("modified_at") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("modified_at"))})
    gone = now.where(F.col("doc_id") % 20 == 2).withColumns({"doc_id": -F.col("doc_id"), "path": F.concat("path", F.lit(".old"))})
    derived.write(before.unionByName(gone), path, layer)
    return lexical.pool(derived.lexical_index(now, path), {"q": TWO_TERMS}, limit=20).select("doc_id", "path", r6("bm25").alias("bm25"))


@query(ORACLE_SQL["rank_composite_topk"])
def stored_rank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated, weights = Engine(stored_index(spark, sf_dir), NOW).signals("the of", TWO_TERMS, 20)
    best = rated.withColumn("score", ranking.score(weights)).orderBy(F.desc("score"), "path").limit(20)
    return best.select("doc_id", "path", r6("score").alias("score"), F.row_number().over(Window.orderBy(F.desc("score"), "path")).cast("long").alias("rank"))  # a page of 20 rows


@query(ORACLE_SQL["semantic_topk"])
def stored_semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.search(derived.semantic_index(documents(spark, sf_dir), folder_of(spark, sf_dir)), SEMANTIC_QUERY).select("doc_id", r6("similarity").alias("similarity"))


@query(ORACLE_SQL["fuzzy_candidates"])
def stored_fuzzy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = derived.read(documents(spark, sf_dir), folder_of(spark, sf_dir), derived.LAYERS["fuzzy"])["prints"]
    return fuzzy.candidates(prints, fuzzy.query_tokens(FUZZY_QUERY)).select("doc_id", r6("score").alias("score"))


# --- relations between documents ---------------------------------------------------------------------------------------------


@query(None)
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All signals and every edge; the parts that SQL says plainly are in the queries below."""
    return every.edges(documents(spark, sf_dir)).select("a", "b", r6("weight").alias("weight"), "edge_type")


@query(f"""WITH {DOCS_SQL}, cw AS (SELECT doc_id, list_filter({TOK_RANK_SQL.format(x="content")}, lambda x: length(x) >= 3 AND x NOT IN ({STOP_SQL}))[1:514] AS w FROM docs),
tok AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM cw),
nx AS (SELECT doc_id, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
tried AS (SELECT doc_id, 2 AS n, i, a || ' ' || b AS phrase FROM nx WHERE b IS NOT NULL UNION ALL SELECT doc_id, 3, i, a || ' ' || b || ' ' || c FROM nx WHERE c IS NOT NULL),
held AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n, i) AS t FROM tried QUALIFY t <= 512),
one AS (SELECT doc_id, phrase, min(t) AS t FROM held GROUP BY doc_id, phrase)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY t) AS n, phrase FROM one QUALIFY n <= 24""")
def document_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's first runs of two and three content words."""
    return graph.phrases(documents(spark, sf_dir))


DIR_SQL = f"""{DOCS_SQL}, dirs AS (SELECT doc_id, list_extract(string_split(lower(path), '/'), -2) AS key FROM docs),
cap AS (SELECT doc_id, key FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS r FROM dirs) WHERE r <= 64)"""


@query(f"WITH {DIR_SQL} SELECT key, doc_id FROM cap")
def graph_bounded_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = documents(spark, sf_dir).select("doc_id", F.create_map().cast("map<string,double>").alias("terms"), F.array().cast("array<string>").alias("phrases"), F.filter(F.split(F.regexp_replace(F.lower("path"), "/[^/]*$", ""), "/"), lambda p: p != "").alias("dirs"))
    return graph.postings(nodes).where("kind = 'dir'").select("key", "doc_id")


EDGES_SQL = """edges AS (SELECT a, b, w AS weight FROM (SELECT DISTINCT least(s1.l_suppkey, s2.l_suppkey) AS a, greatest(s1.l_suppkey, s2.l_suppkey) AS b FROM lineitem s1 JOIN lineitem s2 ON s1.l_orderkey = s2.l_orderkey AND s1.l_suppkey < s2.l_suppkey),
LATERAL (SELECT ((a * 31 + b * 17) % 97) / 97.0 AS w))"""


def supplier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that share an order, with a made-up weight: a graph with real degrees to prune."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    n = parts_of(lines)  # lines are dealt once, by order; pairs by both ends
    pairs = lines.repartition(n, "l_orderkey").distinct()
    both = pairs.hint("merge").join(pairs.select("l_orderkey", F.col("l_suppkey").alias("other")), "l_orderkey").where("l_suppkey < other").select(F.col("l_suppkey").alias("a"), F.col("other").alias("b")).repartition(2 * n, "a", "b").distinct()
    return both.withColumn("weight", (F.col("a") * 31 + F.col("b") * 17) % 97 / F.lit(97.0))


@query(f"""WITH {EDGES_SQL}, ends AS (SELECT *, unnest([a, b]) AS node FROM edges), kept AS (SELECT DISTINCT a, b, weight FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, a, b) AS r FROM ends) WHERE r <= 32)
SELECT a, b, round(weight, 6) AS weight FROM kept ORDER BY kept.weight DESC, a, b LIMIT 100000""")
def graph_top_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = written(supplier_edges(spark, sf_dir), "edges")
    return graph.pruned(edges, parts=parts_of(edges)).select("a", "b", r6("weight").alias("weight"))


@query(f"WITH {EDGES_SQL} SELECT DISTINCT node FROM (SELECT a AS node FROM edges UNION SELECT b FROM edges)")
def edge_endpoints_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = supplier_edges(spark, sf_dir)
    return e.select(F.col("a").alias("node")).unionByName(e.select(F.col("b").alias("node"))).distinct()


@query(f"""WITH {EDGES_SQL}, d AS (SELECT s_suppkey AS doc_id, s_name AS path FROM supplier)
SELECT doc_id, path, round(weight, 6) AS weight FROM (SELECT CASE WHEN a = 5 THEN b ELSE a END AS doc_id, weight FROM edges WHERE a = 5 OR b = 5) JOIN d USING (doc_id) ORDER BY weight DESC, path, doc_id LIMIT 10""")
def graph_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.col("s_name").alias("path"))
    edges = supplier_edges(spark, sf_dir).withColumn("edge_type", F.lit("shared_order"))
    return graph.related(edges, docs, 5).select("doc_id", "path", r6("weight").alias("weight"))


# --- usage and contexts --------------------------------------------------------------------------------------------------------

AGE_SQL = f"((epoch_us(TIMESTAMP '{NOW}') - epoch_us(opened_at)) / 86400e6)"
DECAY_SQL = f"CASE WHEN {AGE_SQL} <= 30 THEN 1.0 WHEN {AGE_SQL} <= 90 THEN 0.6 WHEN {AGE_SQL} <= 365 THEN 0.3 ELSE 0.1 END"
BOOST_SQL = "CASE WHEN effective < 2 THEN 0.0 ELSE least(ln(1 + effective) / ln(5.0), 1.0) END"


@query(f"""WITH {USAGE_SQL}, s AS (SELECT doc_id, sum(CASE WHEN query = 'view' THEN {DECAY_SQL} ELSE 0 END) AS q, sum({DECAY_SQL}) AS g FROM usage GROUP BY doc_id), e AS (SELECT *, 0.8 * q + 0.2 * g AS effective FROM s)
SELECT doc_id, round(q::DOUBLE, 6) AS query_events, round(g::DOUBLE, 6) AS global_events, round(effective::DOUBLE, 6) AS effective, round(({BOOST_SQL})::DOUBLE, 6) AS boost FROM e""")
def usage_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = usage.signals(usage_events(spark, sf_dir), "View ", NOW)
    return s.select("doc_id", *(r6(c).alias(c) for c in ("query_events", "global_events", "effective", "boost")))


@query(f"WITH {USAGE_SQL} SELECT event_id, round(({DECAY_SQL})::DOUBLE, 6) AS weight FROM usage")
def usage_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_events(spark, sf_dir).select("event_id", r6(usage.decay(usage.age_days(F.col("opened_at"), NOW))).alias("weight"))


@query(f"""WITH {DOCS_SQL}, {USAGE_SQL}, bq AS (SELECT doc_id, query, count(*) AS events, sum({DECAY_SQL}) AS q FROM usage GROUP BY doc_id, query), bd AS (SELECT doc_id, sum(q) AS g FROM bq GROUP BY doc_id),
e AS (SELECT bq.doc_id, query, events, 0.8 * q + 0.2 * g AS effective FROM bq JOIN bd USING (doc_id))
SELECT doc_id, query, name, events, round(effective::DOUBLE, 6) AS effective, round(({BOOST_SQL})::DOUBLE, 6) AS boost FROM e JOIN docs USING (doc_id)""")
def usage_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = usage.effects(usage_events(spark, sf_dir), documents(spark, sf_dir), NOW)
    return e.select("doc_id", "query", "name", "events", r6("effective").alias("effective"), r6("boost").alias("boost"))


@query(f"""WITH {DOCS_SQL}, {USAGE_SQL} SELECT event_id, coalesce(d.name, u.doc_id::VARCHAR) AS name FROM usage u LEFT JOIN (SELECT * FROM docs WHERE extension <> '.csv') d USING (doc_id)""")
def usage_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).where("extension != '.csv'").select("doc_id", "name")
    return usage_events(spark, sf_dir).join(docs, "doc_id", "left").select("event_id", F.coalesce("name", F.col("doc_id").cast("string")).alias("name"))


@query(f"WITH {USAGE_SQL} SELECT doc_id, (SELECT query FROM usage u WHERE u.doc_id = d.doc_id ORDER BY opened_at, event_id LIMIT 1) AS first_query FROM documents d")
def usage_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.first_queries(table(spark, sf_dir, "documents"), usage_events(spark, sf_dir))


@query(f"WITH {USAGE_SQL} SELECT event_id, doc_id, query, opened_at FROM usage UNION ALL SELECT -1, 3, 'a long query ' || repeat('y', 187), TIMESTAMP '{NOW}'")
def usage_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = usage.opened(spark, [(-1, 3, "A  long query " + "y" * 300)], NOW)
    return usage_events(spark, sf_dir).unionByName(new)


CONTEXT = usage.Context("work", roots=("/src1", "/src2/fr"), subjects=("de",), sources=("src3",), types=("md", ".pdf"), related={"the": ("of", "in")}, recent_days=90)


@query(f"""WITH {DOCS_SQL} SELECT doc_id, round(least(CASE WHEN path LIKE '/src1/%' OR path LIKE '/src2/fr/%' THEN 0.5 ELSE 0 END + CASE WHEN list_contains({TOK_RANK_SQL.format(x="path")}, 'de') OR list_contains({TOK_RANK_SQL.format(x="name")}, 'de') THEN 0.25 ELSE 0 END
+ CASE WHEN extension IN ('.md', '.pdf') THEN 0.15 ELSE 0 END + CASE WHEN source = 'src3' THEN 0.10 ELSE 0 END + CASE WHEN epoch(TIMESTAMP '{NOW}') - epoch(modified_at) <= 90 * 86400 THEN 0.10 ELSE 0 END, 1.0)::DOUBLE, 6) AS boost FROM docs""")
def context_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", r6(CONTEXT.boost(NOW).cast("double")).alias("boost"))


@query(bm25_sql(language.plan("the OR of OR in")) + " SELECT doc_id FROM matched")
def context_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(lexical.index_of(documents(spark, sf_dir)), NOW, context=CONTEXT)
    return lexical.matches(engine.index, {"q": engine.widened(language.plan("the"))}).select("doc_id")


# --- ingestion ---------------------------------------------------------------------------------------------------------------------


def scan_and_store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A stored table, and a later scan in which some files are new, changed, touched or gone."""
    d = documents(spark, sf_dir).select("doc_id", "source", "path", "size", (F.unix_micros("modified_at") * 1000).alias("mtime_ns"), F.lit("available").alias("availability"), F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))
    stored = d.where("doc_id % 7 != 0").withColumn("status", F.when(F.col("doc_id") % 11 == 0, "cancelled").otherwise("ok"))
    scan = d.where("doc_id % 5 != 0").withColumn("size", F.col("size") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).withColumn("content_hash", F.when(F.col("doc_id") % 6 == 0, F.sha2(F.concat("content_hash", F.lit("x")), 256)).otherwise(F.col("content_hash")))
    return scan, stored


ACTION_SQL = "CASE WHEN doc_id % 7 = 0 THEN 'created' WHEN doc_id % 3 <> 0 AND doc_id % 11 <> 0 THEN 'unchanged' ELSE 'updated' END"


@query(f"WITH {DOCS_SQL} SELECT doc_id, {ACTION_SQL} AS action FROM docs WHERE doc_id % 5 <> 0")
def reconcile_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.classify(*scan_and_store(spark, sf_dir)).select("doc_id", "action")


@query(f"WITH {DOCS_SQL}, c AS (SELECT CASE WHEN {ACTION_SQL} = 'updated' AND doc_id % 6 <> 0 THEN 'unchanged' ELSE {ACTION_SQL} END AS action FROM docs WHERE doc_id % 5 <> 0 UNION ALL SELECT 'deleted' FROM docs WHERE doc_id % 7 <> 0 AND doc_id % 5 = 0) SELECT action, count(*) AS n FROM c GROUP BY action")
def reconcile_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan, stored = scan_and_store(spark, sf_dir)
    return ingest.counters(ingest.settle(ingest.classify(scan, stored)), ingest.vanished(stored, scan, "/"))


@query(f"WITH {DOCS_SQL} SELECT doc_id, path FROM docs WHERE doc_id % 7 <> 0 AND doc_id % 5 = 0 AND path LIKE '/src5/%'")
def reconcile_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan, stored = scan_and_store(spark, sf_dir)
    return ingest.vanished(stored, scan, "/src5").select("doc_id", "path")


@query(f"WITH {DOCS_SQL} SELECT doc_id, size + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS size FROM docs WHERE doc_id % 5 <> 0")
def reconcile_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan, stored = scan_and_store(spark, sf_dir)
    return ingest.reconcile(scan, stored, "/").select("doc_id", "size")


@query(f"WITH {DOCS_SQL} SELECT doc_id, size + CASE WHEN doc_id % 3 = 0 AND doc_id % 5 <> 0 THEN 1 ELSE 0 END AS size FROM docs WHERE doc_id % 5 <> 0 OR doc_id % 7 <> 0")
def reconcile_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pass that may have missed files deletes nothing."""
    scan, stored = scan_and_store(spark, sf_dir)
    return ingest.reconcile(scan, stored, "/", complete=False).select("doc_id", "size")


@query("SELECT event_type, user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) = 1")
def latest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest record of each kind and user."""
    return ingest.latest(table(spark, sf_dir, "events"), ["event_type", "user_id"], "event_id").select("event_type", "user_id", "event_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 4 = 0 OR doc_id % 5 = 0 OR doc_id % 6 = 0")
def analysis_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose analysis is missing, of another version or of other content."""
    docs = documents(spark, sf_dir).withColumn("content_hash", F.sha2(F.col("content").cast("binary"), 256))
    kept = docs.where("doc_id % 4 != 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "other").otherwise(F.col("content_hash")).alias("content_hash"), F.when(F.col("doc_id") % 6 == 0, 1).otherwise(2).alias("version"))
    return intelligence.stale(docs, kept, 2).select("doc_id")


@query(f"WITH {DOCS_SQL} SELECT doc_id, size + CASE WHEN doc_id % 3 = 0 AND doc_id % 5 <> 0 THEN 1 ELSE 0 END AS size, sha256(content) AS content_hash FROM docs WHERE doc_id % 7 <> 0")
def reconcile_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan, stored = scan_and_store(spark, sf_dir)
    return ingest.metadata_only(stored, scan).select("doc_id", "size", "content_hash")


@query(f"""WITH {DOCS_SQL}, r(root) AS (VALUES ('/src1'), ('/src1/de'), ('/src2'), ('/src10/en')), o AS (SELECT doc_id, (SELECT root FROM r WHERE starts_with(path, root || '/') ORDER BY length(root) DESC LIMIT 1) AS root FROM docs)
SELECT doc_id FROM o WHERE root IS DISTINCT FROM '/src1'""")
def remove_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = spark.createDataFrame([(r,) for r in ROOTS], "root string")
    return ingest.without_root(documents(spark, sf_dir), roots, "/src1").select("doc_id")


@query(f"""WITH {DOCS_SQL}, asked(reference) AS (VALUES ('doc_3.csv'), ('/none/at/all'), ('doc_17.txt')) SELECT reference, min(doc_id) AS doc_id FROM asked LEFT JOIN docs ON name = reference GROUP BY reference""")
def forget_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.forgotten_batch(documents(spark, sf_dir), ["doc_3.csv", "/none/at/all", "doc_17.txt"], confirmed=True)


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'partial' ELSE 'ok' END AS status, CASE WHEN doc_id % 2 = 0 THEN 'line one two' ELSE '' END AS warnings FROM documents""")
def diagnostics_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "documents").select("doc_id", F.lit("ok").alias("status"), F.array().cast("array<string>").alias("warnings"))
    read = stored.where("doc_id % 2 = 0").withColumns({"status": F.lit("partial"), "warnings": F.array(F.lit(" line one\ntwo\t"))})
    return ingest.diagnosed(stored, read).select("doc_id", "status", F.array_join("warnings", "|").alias("warnings"))


@query(f"WITH {DOCS_SQL}, gone AS (SELECT doc_id FROM docs WHERE name = 'doc_17.txt') SELECT 'documents' AS tbl, count(*) AS n FROM docs WHERE doc_id NOT IN (FROM gone) UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (FROM gone)")
def forget_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    left = ingest.without({"documents": docs, "labels": table(spark, sf_dir, "labels")}, ingest.forgotten(docs, "doc_17.txt"))
    return reduce(DataFrame.unionByName, (t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "n") for name, t in left.items()))


ROOTS = ("/src1", "/src1/de", "/src2/", "/src10/en")


@query(f"WITH {DOCS_SQL}, r(root) AS (VALUES ('/src1'), ('/src1/de'), ('/src2'), ('/src10/en')) SELECT doc_id, (SELECT root FROM r WHERE path = root OR starts_with(path, root || '/') ORDER BY length(root) DESC LIMIT 1) AS root FROM docs")
def source_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.owners(documents(spark, sf_dir), spark.createDataFrame([(r,) for r in ROOTS], "root string")).select("doc_id", "root")


@query("""WITH e AS (SELECT user_id AS doc_id, 'n' || event_type AS name, '/' || event_type AS path FROM events)
SELECT doc_id, max(name) AS name, max(path) AS path FROM e WHERE doc_id > 5 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) GROUP BY doc_id ORDER BY doc_id LIMIT 64""")
def orphan_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.concat(F.lit("n"), "event_type").alias("name"), F.concat(F.lit("/"), "event_type").alias("path"))
    return health.orphan_page(rows, table(spark, sf_dir, "documents").where("doc_id % 2 = 0"), 5, 64)


@query("SELECT doc_id FROM documents WHERE doc_id % 4 = 0 AND text <> ''")
def text_without_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    docs = d.select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.sha2(F.col("text").cast("binary"), 256)).alias("content_hash"))
    return health.unhashed(docs, d.select("doc_id", F.col("text").alias("content")))


@query("SELECT count(*) AS n, coalesce(max(event_type), '') AS newest FROM events")
def snapshot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.snapshot_key(table(spark, sf_dir, "events"), "event_type")


@query("SELECT event_id, event_type || '/' || event_id AS key, event_id::VARCHAR AS rest FROM events WHERE event_type = 'view'")
def keys_with_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.concat_ws("/", "event_type", F.col("event_id").cast("string")).alias("key"))
    return health.keys_with(e, "view/")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE coalesce(CAST(props::JSON->>'k' AS BIGINT), -1) END AS k FROM events")
def tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON column, every third of whose values is torn."""
    torn = F.when(F.col("event_id") % 3 == 0, F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(T.from_json_or(torn, "k long", F.struct(F.lit(-1).cast("long").alias("k")))["k"], F.lit(-1)).alias("k"))


# --- health ---------------------------------------------------------------------------------------------------------------------------


@query(f"WITH {DOCS_SQL} SELECT doc_id FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def health_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.missing(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@query("SELECT DISTINCT event_id % 1300 AS doc_id FROM events WHERE event_id % 1300 NOT IN (SELECT doc_id FROM documents)")
def health_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = table(spark, sf_dir, "events").select((F.col("event_id") % 1300).alias("doc_id"))
    return health.missing(opened, table(spark, sf_dir, "documents"))


@query(f"WITH {DOCS_SQL} SELECT source, path, count(*) AS n FROM (SELECT source, regexp_replace(path, '/doc_.*', '') AS path FROM docs) GROUP BY ALL HAVING count(*) > 1")
def health_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.duplicates(documents(spark, sf_dir).withColumn("path", F.regexp_replace("path", "/doc_.*", "")))


@query(f"WITH {DOCS_SQL} SELECT extension, count(*) AS n FROM docs GROUP BY 1")
def stats_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.counted(documents(spark, sf_dir), "extension")


@query(f"WITH {DOCS_SQL} SELECT source, count(*) AS n FROM docs GROUP BY 1")
def stats_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.counted(documents(spark, sf_dir), "source")


@query(f"""WITH {DOCS_SQL}, r(root) AS (VALUES ('/src1'), ('/src1/de'), ('/src2'), ('/src10/en')), o AS (SELECT *, (SELECT root FROM r WHERE starts_with(path, root || '/') ORDER BY length(root) DESC LIMIT 1) AS root FROM docs)
SELECT root, count(*) AS documents, sum(size)::BIGINT AS bytes, count_if(modified_at < TIMESTAMP '2023-01-01')::BIGINT AS stale,
       (SELECT string_agg(extension || '=' || n, ' ' ORDER BY extension) FROM (SELECT extension, count(*) AS n FROM o i WHERE i.root = o.root GROUP BY extension)) AS by_type,
       (SELECT string_agg(source || '=' || n, ' ' ORDER BY source) FROM (SELECT source, count(*) AS n FROM o i WHERE i.root = o.root GROUP BY source)) AS by_source
FROM o WHERE root IS NOT NULL GROUP BY root""")
def stats_by_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.by_root(documents(spark, sf_dir), spark.createDataFrame([(r,) for r in ROOTS], "root string"), "2023-01-01").withColumns({c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), " ") for c in ("by_type", "by_source")})


@query("SELECT count(*) AS n, min(l_linenumber) AS lowest, max(l_linenumber) AS highest FROM lineitem")
def version_uniformity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.uniform(table(spark, sf_dir, "lineitem"), "l_linenumber")


@query("SELECT event_type AS kind, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, max(value) AS most, arg_max(value, event_id) AS last FROM events GROUP BY 1")
def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = health.metrics_summary(table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("seq"), "value"))
    return s.withColumns({"total": F.round("total", 4), "mean": r6("mean")})


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(value) FILTER (i = least(n - 1, floor(0.5 * (n - 1)))) AS p50, max(value) FILTER (i = least(n - 1, floor(0.95 * (n - 1)))) AS p95 FROM r GROUP BY 1""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.percentiles(table(spark, sf_dir, "events"), "event_type", "value", (0.5, 0.95))


@query("SELECT event_id, event_type, value FROM events ORDER BY event_id DESC LIMIT 200")
def metrics_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.compacted(table(spark, sf_dir, "events").withColumn("seq", F.col("event_id"))).select("event_id", "event_type", "value")


# --- evaluation -------------------------------------------------------------------------------------------------------------------------

#: A ranking to judge: for each source, documents by score; relevant are those of good quality.
EVAL_SQL = """res AS (SELECT source AS query, doc_id, ((doc_id * 7919) % 1000) / 1000.0 AS score, '/' || doc_id AS path FROM documents), rk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, path) AS rank FROM res),
rel AS (SELECT DISTINCT d.source AS query, d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE quality = 1), qs AS (SELECT DISTINCT source AS query FROM documents UNION SELECT 'none')"""


def judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    results = docs.select(F.col("source").alias("query"), "doc_id", (F.col("doc_id") * 7919 % 1000 / F.lit(1000.0)).alias("score"), F.concat(F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    relevant = docs.join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id").select(F.col("source").alias("query"), "doc_id").distinct()
    return evaluate.ranked(results), relevant, docs.select(F.col("source").alias("query")).distinct().unionByName(spark.createDataFrame([("none",)], "query string"))


@query(f"""WITH {EVAL_SQL}, j AS (SELECT rk.query, count(*) AS ret, min(rank) FILTER (rel.doc_id IS NOT NULL) AS first, """ + ", ".join(f"count(*) FILTER (rel.doc_id IS NOT NULL AND rank <= {k}) AS h{k}" for k in evaluate.CUTS) + """ FROM rk LEFT JOIN rel USING (query, doc_id) GROUP BY rk.query),
w AS (SELECT query, count(*) AS wanted FROM rel GROUP BY query), x AS (SELECT qs.query, coalesce(ret, 0) AS ret, coalesce(wanted, 0) AS wanted, first, h1, h3, h5, h10 FROM qs LEFT JOIN j USING (query) LEFT JOIN w USING (query))
SELECT query, """ + ", ".join(f"round(CASE WHEN wanted = 0 THEN (ret = 0)::INT ELSE h{k} / {k} END, 6) AS p_{k}" for k in evaluate.CUTS) + ", " + ", ".join(f"round(CASE WHEN wanted = 0 THEN (ret = 0)::INT ELSE h{k} / wanted END, 6) AS r_{k}" for k in evaluate.CUTS) + ", round(CASE WHEN wanted = 0 THEN (ret = 0)::INT ELSE coalesce(1 / first, 0) END, 6) AS rr FROM x")
def precision_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = evaluate.quality(*judged(spark, sf_dir))
    return q.select("query", *(r6(c).alias(c) for c in q.columns if c != "query"))


QUALITY_SQL = ORACLE_SQL["precision_recall_mrr"]


@query(f"SELECT count(*) AS n, " + ", ".join(f"round(avg({c}), 4) AS {c}" for c in [f"{m}_{k}" for m in "pr" for k in evaluate.CUTS] + ["rr"]) + f" FROM ({QUALITY_SQL})")
def quality_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluate.means(evaluate.quality(*judged(spark, sf_dir)))
    return m.select("n", *(F.round(c, 4).alias(c) for c in m.columns if c != "n"))


@query(f"WITH {EVAL_SQL} SELECT rk.query, count(*) AS n, round(avg(CASE WHEN rk.query = 'src1' THEN (doc_id % 2 = 0)::INT ELSE (doc_id % 5 <> 2)::INT END), 6) AS accuracy FROM rk WHERE rk.query IN ('src1', 'src2') GROUP BY rk.query")
def filter_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    results, _, _ = judged(spark, sf_dir)
    held = {"src1": F.col("doc_id") % 2 == 0, "src2": F.col("doc_id") % 5 != 2}
    return evaluate.filter_accuracy(results.where(F.col("query").isin(*held)), held).select("query", "n", r6("accuracy").alias("accuracy"))


@query(f"""WITH {EVAL_SQL}, wanted AS (SELECT source AS query, min(doc_id) AS doc_id FROM documents GROUP BY source), g AS (SELECT w.query, coalesce(rk.doc_id = w.doc_id, false) AS ok FROM wanted w LEFT JOIN rk ON rk.query = w.query AND rank = 1)
SELECT count(*) AS n, round(avg(ok::INT), 6) AS accuracy, coalesce(string_agg(query, ' ' ORDER BY query) FILTER (NOT ok), '') AS failures FROM g""")
def exact_match_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    results, _, _ = judged(spark, sf_dir)
    wanted = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("query")).agg(F.min("doc_id").alias("doc_id"))
    return evaluate.exact_matches(results, wanted).select("n", r6("accuracy").alias("accuracy"), F.array_join("failures", " ").alias("failures"))


@query(f"""WITH {EVAL_SQL} SELECT rk.query, round((max(score) FILTER (rel.doc_id IS NOT NULL) - max(score) FILTER (rel.doc_id IS NULL))::DOUBLE, 6) AS margin, round((max(score) - min(score))::DOUBLE, 6) AS spread FROM rk LEFT JOIN rel USING (query, doc_id) GROUP BY rk.query""")
def relevance_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    results, relevant, _ = judged(spark, sf_dir)
    return evaluate.margins(results, relevant).select("query", r6("margin").alias("margin"), r6("spread").alias("spread"))


@query(f"WITH {EVAL_SQL} SELECT count(*) AS n, round(avg(CASE WHEN (query NOT IN (SELECT query FROM rk)) = (query = 'none') THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS accuracy FROM qs")
def zero_result_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    results, _, queries = judged(spark, sf_dir)
    return evaluate.zero_results(queries.withColumn("expects_none", F.col("query") == "none"), results).select("n", r6("accuracy").alias("accuracy"))
