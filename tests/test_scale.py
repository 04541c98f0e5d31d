"""What keeps work in proportion to the input: which steps deal rows anew, and that they give what the plain way gives."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from inkwell import session
from inkwell.functions import text as T
from inkwell.operators import derived, fuzzy, graph, intelligence, lexical, semantic, stored
from inkwell.plans import catalog, language
from inkwell.plans.corpus import documents


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_grams_are_counted_where_texts_are_read(spark, small):
    docs = documents(spark, small)
    grams = semantic.kept_grams(docs)
    assert "hashpartitioning" not in plan(grams) and "hashpartitioning" not in plan(semantic.content_words(docs))
    text = {r.doc_id: r.text for r in semantic.gram_text(docs).collect()}
    want = {(d, g, n) for d, x in text.items() for g, n in Counter(T.one_grams(x)).most_common(semantic.MOST_GRAMS)}
    assert set(map(tuple, grams.collect())) == want
    assert semantic.top_grams("a😀b", 3, 5) == [("a😀b", 1)] and semantic.top_grams("ab", 3, 5) == []


def test_norms_deal_no_grams_where_frequencies_are_few(spark, small):
    assert "SortMergeJoin" not in plan(semantic.index_of(documents(spark, small)).norms)


def test_terms_are_counted_where_texts_are_read(spark, small):
    assert "hashpartitioning" not in plan(intelligence.top_terms(documents(spark, small)))


def test_pairs_are_counted_where_texts_are_read(spark, small):
    assert "hashpartitioning" not in plan(intelligence.pairs(documents(spark, small)))


def test_pairs_as_windows_slide():
    words = "one two one three two two one four".split()
    want = defaultdict(int)
    for end in range(len(words)):
        held = words[max(0, end - intelligence.WINDOW + 1) : end + 1]
        for i, a in enumerate(held):
            for b in held[i + 1 :]:
                if a != b:
                    want[tuple(sorted((a, b)))] += 1
    assert {(a, b): n for a, b, n in intelligence.one_pairs(" ".join(words), set(words), 99)} == want


def test_phrases_and_nodes_are_made_where_texts_are_read(spark, small):
    docs = documents(spark, small)
    assert "hashpartitioning" not in plan(graph.phrases(docs)) and "hashpartitioning" not in plan(graph.nodes(docs))


def test_strongest_edges_need_few_whole_nodes(spark, small):
    kept = graph.kept(documents(spark, small))
    whole = graph.edges_of(kept, 200).collect()
    assert graph.edges_of(kept, 200, trials=1000).orderBy("a", "b").collect() == sorted(whole, key=lambda r: (r.a, r.b))
    pairs = graph.candidates(kept.keys)
    assert graph.contenders(kept.nodes, pairs, 200, 1000).count() < pairs.count()


def test_candidates_in_order_of_keys():
    common = {(1, "c"): [9, 1, 8]}
    keys = [{"kind": 2, "key": "a", "others": [8, 1]}, {"kind": 1, "key": "c", "others": None}]
    assert graph.one_candidates(1, keys, [4], common, True) == [(4, 0, 1), (8, 2, 0), (9, 1, 0)]
    assert graph.one_candidates(8, keys, [], common, False) == [(9, 1, 0)]
    assert sorted(graph.one_runs("a b c".split(), {"b"})) == [("b",), ("b c",)]


def test_fingerprints_deal_rare_words_alone(spark, small):
    docs = documents(spark, small)
    prints = fuzzy.fingerprints(docs)
    assert "Window" not in plan(prints)
    want = sorted(map(tuple, prints.collect()))
    assert want and sorted(map(tuple, fuzzy.fingerprints(docs, held=50).collect())) == want


def test_a_stored_index_deals_no_rows_of_documents(spark, small, tmp_path, monkeypatch):
    docs, dealt = documents(spark, small), []
    monkeypatch.setattr(stored, "RUN_TOKENS", 5000)
    for way in ("repartition", "repartitionByRange"):
        plainly = getattr(type(docs), way)
        monkeypatch.setattr(type(docs), way, lambda df, *by, plainly=plainly: dealt.append(df.columns) or plainly(df, *by))
    index = derived.lexical_index(docs, str(tmp_path))
    assert dealt and not [columns for columns in dealt if "doc_id" in columns]
    of = ["doc_id", "col", "pos", "token"]
    assert sorted(index.postings.select(of).collect()) == sorted(lexical.postings(docs).select(of).collect())
    counted = lexical.postings(docs).groupBy("token", "doc_id").agg(F.count("*").alias("f")).join(lexical.lengths(docs), "doc_id")
    of = ["token", "doc_id", "f", "n_tokens"]
    assert sorted(index.entries.select(of).collect()) == sorted(counted.select(of).collect())


def test_supplier_edges_are_dealt_by_their_number(spark, small, monkeypatch):
    want = sorted(map(tuple, catalog.QUERIES["graph_top_edges"](spark, small).collect()))
    monkeypatch.setattr(catalog, "parts_of", lambda rows: 13)
    assert "l_orderkey#" in plan(edges := catalog.supplier_edges(spark, small)) and ", 13)" in plan(edges) and ", 26)" in plan(edges)
    assert sorted(map(tuple, catalog.QUERIES["graph_top_edges"](spark, small).collect())) == want


def test_a_batch_of_queries_cuts_each_text_once(spark, small, monkeypatch):
    docs, written = documents(spark, small), []
    monkeypatch.setattr(lexical, "written", lambda df, what: written.append(plan(df)) or session.written(df, what))
    plans = {t: language.plan(t) for t in ("name:doc_7 OR path:fr", '"of the"', "the -of type:md")}
    found = lambda index, plans: sorted((r.query, r.doc_id, round(r.bm25, 9)) for r in lexical.matches(index, plans).collect())
    cut = lexical.Index(docs, lexical.postings(docs).drop("n_tokens"), lexical.lengths(docs))
    want = found(cut, plans)
    assert {q for q, _, _ in want} == set(plans) and found(lexical.index_of(docs), plans) == want
    assert len(written) == 1 and "regexp_extract_all" not in plan(lexical.matches(lexical.index_of(docs), plans))
    # Columns in which no phrase may stand are counted, not made into postings.
    fields = {q: p for q, p in plans.items() if q.startswith("name:")}
    assert found(lexical.index_of(docs), fields) == [r for r in want if r[0] in fields]
    assert "struct(col, content," in written[0].replace("named_struct", "struct") and "struct(col, content," not in written[-1].replace("named_struct", "struct")
    monkeypatch.setattr(lexical, "MOST_PUSHED", 0)
    assert found(lexical.index_of(docs), plans) == want


def test_the_best_of_many_queries_cut_each_text_once(spark, small):
    docs, asked = documents(spark, small), spark.createDataFrame([(1, ["the", "of"]), (2, ["und", "les"])], "query long, tokens array<string>")
    cut = lexical.Index(docs, lexical.postings(docs).drop("n_tokens"), lexical.lengths(docs))
    found = lambda index: sorted((r.query, r.doc_id, round(r.bm25, 9)) for r in lexical.best_of_any(index, asked).collect())
    assert len(want := found(cut)) == 2 and found(lexical.index_of(docs)) == want
    assert "posexplode" not in plan(lexical.best_of_any(lexical.index_of(docs), asked))


def test_documents_without_tokens_and_ids_count_alone(spark):
    rows = [(1, "a.md", "/x", "."), (2, "b.md", "/y", None), (3, "", "", "..."), (4, None, None, None), (None, "a.md", "/x", "long " * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, name string, path string, content string")
    index = lexical.index_of(docs).narrowed({"q": (a := language.plan("name:a"))})
    assert sorted((r.doc_id or 0, r.n_tokens) for r in index.lengths.collect()) == [(0, 53), (1, 3), (2, 3), (3, 0), (4, 0)]
    assert index.totals().first().N == 5 and [r.doc_id for r in lexical.matches(lexical.index_of(docs), {"q": a}).collect()] == [1]


def test_tokens_are_counted_as_they_are_made(spark):
    every = spark.range(0x110000).where("id NOT BETWEEN 55296 AND 57343").select(F.udf(chr)("id").alias("c"))
    for x in (F.col("c"), F.concat(F.lit("a"), "c", F.lit("b")), F.concat("c", F.lit("́"), "c", F.lit("ͅ "), F.lit("́Á"), "c")):
        assert every.where(T.n_tok_index(x) != F.size(T.tok_index(x))).count() == 0
    assert spark.range(1).select(T.n_tok_index(F.lit(None).cast("string"))).first()[0] == 0
