"""Stored layers, graph repair, searches with fallbacks, usage and contexts, and small operators, against plain Python."""

import json
import os
import re
import unicodedata
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import derived, fuzzy, graph, health, ingest, intelligence, lexical, organize, stored, usage
from inkwell.operators.search import Engine
from inkwell.plans import catalog, corpus, language

NOW = "2024-01-01 00:00:00"


@pytest.fixture(scope="module")
def docs(spark, small):
    return corpus.documents(spark, small).where("doc_id < 60").persist()


def rows(df):
    return sorted(map(str, df.collect()))


def altered(docs, when, content):
    """docs with another content and time where `when` holds."""
    return docs.withColumns({"content": F.when(when, content).otherwise(F.col("content")), "modified_at": F.when(when, F.col("modified_at") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("modified_at"))})


def test_layers_are_built_once_and_renewed_when_due(spark, tmp_path, docs):
    path, built = str(tmp_path), Counter()

    def counting(layer):
        return replace(layer, build=lambda d: built.update([layer.name]) or layer.build(d))

    layers = {n: counting(x) for n, x in derived.LAYERS.items() if n in ("lexical", "fuzzy")}
    for _ in range(2):
        for layer in layers.values():
            derived.read(docs.repartition(3), path, layer)
    assert built == {"lexical": 1, "fuzzy": 1}
    derived.mark_dirty(spark, path, "fuzzy")
    assert rows(derived.read(docs, path, layers["fuzzy"], rebuild=False)["prints"]) == rows(fuzzy.fingerprints(docs)) and built["fuzzy"] == 1
    derived.read(docs, path, layers["fuzzy"])
    changed = altered(docs, F.col("doc_id") == 3, F.lit("quite new words"))
    index = stored.opened(changed, derived.read(changed, path, layers["lexical"]))
    assert built == {"lexical": 2, "fuzzy": 2}
    plan = {"q": language.plan('"quite new words"')}
    assert [r.doc_id for r in lexical.matches(index, plan).collect()] == [3]
    newer = replace(layers["lexical"], version=layers["lexical"].version + 1)
    derived.read(changed, path, newer)
    derived.read(changed, path, newer)
    assert built["lexical"] == 3
    derived.remove(spark, path, "lexical", "never stored")
    assert derived.last(spark, path, "lexical").tables == []
    derived.mark_dirty(spark, path)
    derived.read(changed, path, newer)
    assert built["lexical"] == 4


def folder_rows(spark, path, folder):
    return {name: spark.read.parquet(f"{path}/{folder}/{name}") for name in os.listdir(f"{path}/{folder}")}


def summed(tables):
    """A layer's tables with the sums of all its generations; equal for equal documents."""
    heads = tables["heads"].groupBy("token").agg(F.sum("n").alias("n")).where("n > 0")
    return rows(tables["entries"].drop("block")), rows(tables["postings"].drop("block")), rows(heads), rows(tables["about"]), rows(tables["stats"].agg(F.sum("n_docs"), F.sum("n_tokens")))


def test_a_change_writes_rows_of_its_documents_alone(spark, tmp_path, docs, monkeypatch):
    path, fresh, layer = str(tmp_path / "kept"), str(tmp_path / "fresh"), derived.LAYERS["lexical"]
    derived.read(docs, path, layer)
    now = altered(docs, F.col("doc_id") == 3, F.lit("quite new words")).where("doc_id != 9").unionByName(docs.where("doc_id = 1").withColumns({"doc_id": F.lit(999).cast("long"), "path": F.lit("/new"), "name": F.lit("new")}))
    got = derived.read(now, path, layer)
    last = derived.last(spark, path, "lexical")
    written = folder_rows(spark, path, last.folder)
    assert last.kind == "delta" and {r.doc_id for r in written["gone"].collect()} == {3, 9, 999}
    assert all({r.doc_id for r in written[t].select("doc_id").collect()} == {3, 999} for t in ("entries", "postings", "about", "seen"))
    assert summed(got) == summed(derived.read(now, fresh, layer))
    derived.mark_dirty(spark, path, "lexical", ids=spark.createDataFrame([(4,)], "doc_id long"))
    assert summed(derived.read(now, path, layer)) == summed(got)
    assert {r.doc_id for r in folder_rows(spark, path, derived.last(spark, path, "lexical").folder)["gone"].collect()} == {4}
    n = derived.stamps(spark, path).count()
    derived.read(now, path, layer)
    assert derived.stamps(spark, path).count() == n  # nothing was due
    derived.compact(spark, path, layer)
    assert [s.kind for s in derived.chain(spark, path, "lexical")] == ["base"] and summed(derived.read(now, path, layer)) == summed(got)
    monkeypatch.setattr(derived, "MOST_DELTAS", 1)
    for i in (5, 6):
        now = altered(now, F.col("doc_id") == i, F.lit(f"text {i} of the document"))
        got = derived.read(now, path, layer)
    assert len(derived.chain(spark, path, "lexical")) == 1 and summed(got) == summed(derived.read(now, str(tmp_path / "again"), layer))
    semantic = derived.LAYERS["semantic"]
    derived.read(docs, path, semantic)
    norms = lambda p: [(r.doc_id, round(r.norm, 9)) for r in derived.semantic_index(now, p).norms.orderBy("doc_id").collect()]
    assert norms(path) == norms(fresh) and derived.last(spark, path, "semantic").kind == "delta"


def scans(df):
    """What a plan says of each file scan: PushedFilters and ReadSchema among it."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    return df._jdf.queryExecution().executedPlan().toString().split("FileScan parquet")[1:]


def test_a_stored_search_reads_what_it_needs(spark, tmp_path, monkeypatch):
    every = corpus.documents(spark, "/root/testdata/sf0.01")
    monkeypatch.setattr(stored, "FINE", stored.FINE | {"parquet.page.row.count.limit": "200"})
    monkeypatch.setattr(stored, "BLOCK_DOCS", 64)
    monkeypatch.setattr(stored, "AT_ONCE", 0)
    index = derived.lexical_index(every, str(tmp_path))
    rare = index.entries.groupBy("token").count().where("count = 2").orderBy("token").first().token
    found = lexical.matches(index, {"q": language.plan(rare)})
    read = [scan for scan in scans(found) if "pos:int" in scan]
    assert read and all(f"(token,{rare})" in scan for scan in read)
    assert found.count() == 2
    some = index.entries.where(F.col("token").isin([rare])).select("token", "doc_id")
    some.collect()
    read = sum(int(re.sub(r"[^0-9]", "", m)) for m in scanned(some))
    assert read < 0.05 * index.entries.count()
    for text in ("the", "the of", "the OR und", "the -of", "(the OR le) type:md", "zzz OR the", "und le", "nothing1 nothing2"):
        plan = {"q": language.plan(text)}
        want = lexical.Index(every, index.postings, index.lengths)
        key = lambda d: [(r.doc_id, round(r.bm25, 9)) for r in d.collect()]
        assert sorted(key(index.best(plan, 20))) == sorted(key(want.best(plan, 20))), text
        assert sorted(key(lexical.pool(index, plan, size=20))) == sorted(key(want.best(plan, 20))), text
    page = [scan for scan in scans(lexical.pool(index, {"q": language.plan("the of")})) if "text:string" in scan]
    assert page and all("In(doc_id" in scan for scan in page)


def test_a_stored_index_of_nothing_and_of_other_ids(spark, tmp_path, docs):
    none = derived.lexical_index(docs.limit(0), str(tmp_path / "none"))
    assert lexical.pool(none, {"q": language.plan("the of")}).count() == 0 and lexical.matches(none, {"q": language.plan('"of the"')}).count() == 0
    named = docs.withColumn("doc_id", F.format_string("d%05d", "doc_id"))
    index = derived.lexical_index(named, str(tmp_path / "named"))
    key = lambda d: sorted((r.doc_id, round(r.bm25, 9)) for r in d.collect())
    assert key(lexical.pool(index, {"q": language.plan("the OR und")})) == key(lexical.pool(lexical.index_of(named), {"q": language.plan("the OR und")})) != []


def scanned(df):
    """Rows that each file scan of a plan that ran has given out."""
    plan = df._jdf.queryExecution().executedPlan()
    out, todo = [], [plan]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan parquet"):
            out.append(str(node.metrics().apply("numOutputRows").value()))
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_stored_layers_search_alike(spark, tmp_path, docs):
    index, kept = derived.semantic_index(docs, str(tmp_path)), catalog.semantic.index_of(docs)
    found = lambda i: [(r.doc_id, round(r.similarity, 9)) for r in catalog.semantic.search(i, catalog.SEMANTIC_QUERY).collect()]
    assert found(index) == found(kept) != []
    plan = {"q": language.plan("the OR und")}
    scores = lambda i: sorted((r.doc_id, round(r.bm25, 9)) for r in lexical.matches(i, plan).collect())
    assert scores(derived.lexical_index(docs, str(tmp_path))) == scores(lexical.index_of(docs)) == scores(derived.lexical_index(docs.repartition(5), str(tmp_path / "s")))


def test_norms_are_stored_until_a_change(spark, tmp_path, docs):
    path, layer = str(tmp_path), derived.LAYERS["semantic"]
    state = lambda: [r.folder for r in derived.stamps(spark, path).where("layer = 'norms'").orderBy("n").collect()]
    close = lambda i: {r.doc_id: round(r.norm, 9) for r in i.norms.collect()}
    index = derived.semantic_index(docs, path)
    read = catalog.semantic.search(index, catalog.SEMANTIC_QUERY)
    tables = {f.split("/")[-2] for f in read.inputFiles()}
    assert tables == {"kept", "norms", "words"} and "In(gram" in read._jdf.queryExecution().toString()
    derived.semantic_index(docs, path)
    assert len(state()) == 1
    other = F.col("doc_id") == 3
    changed = docs.withColumns({"content": F.when(other, F.lit("nothing of the kind was written here")).otherwise(F.col("content")), "modified_at": F.when(other, F.lit("2001-01-01").cast("timestamp")).otherwise(F.col("modified_at"))})
    again = derived.semantic_index(changed, path)
    assert len(state()) == 2 and close(again) == close(catalog.semantic.index_of(changed)) != close(index)
    derived.compact(spark, path, layer)
    assert close(derived.semantic_index(changed, path)) == close(again)
    for text in (catalog.SEMANTIC_QUERY, "nothing of the kind", "qzxqzx wvkqj"):
        found = lambda i, text=text: [(r.doc_id, round(r.similarity, 9)) for r in catalog.semantic.search(i, text).collect()]
        assert found(again) == found(catalog.semantic.index_of(changed))


def test_graph_repair_gives_what_a_rebuild_gives(spark, docs, tmp_path):
    given = docs.select("doc_id", "source", "name", "path", "extension", "size", "modified_at", "content")
    path, text = str(tmp_path), "a rare zebra quagga okapi meets the zebra quagga okapi again and again, see doc_12.md. "
    edges = derived.graph_edges(given, path).persist()
    changed = altered(given, F.col("doc_id").isin(5, 40), F.lit(text * 5)).where("doc_id != 7")
    key = lambda e: {(r.a, r.b): (round(r.weight, 6), r.edge_type) for r in e.collect()}
    first, got, whole = key(edges), key(derived.graph_edges(changed, path)), key(graph.build(changed))
    assert first == key(graph.build(given))
    assert (5, 40) in got and {(5, 12), (12, 40)} <= set(got) and not any(7 in pair for pair in got)
    assert {p: w for p, w in got.items() if {5, 40} & set(p)} == {p: w for p, w in whole.items() if {5, 40} & set(p)}
    last = derived.last(spark, path, "graph")
    assert last.kind == "delta" and {r.doc_id for r in spark.read.parquet(f"{path}/{last.folder}/nodes").collect()} == {5, 40}
    kept = graph.Kept(**{n: t for n, t in derived.read(changed, path, derived.LAYERS["graph"]).items()})
    repair = graph.repaired(edges, kept, spark.createDataFrame([(5,), (40,), (7,)], "doc_id long"))
    assert not any("content" in scan for scan in scans(repair)) and key(repair) == got
    assert key(graph.repaired(edges, kept, spark.range(100).select(F.col("id").alias("doc_id")))) == whole


def test_graph_candidates_mentions_and_pruning_by_brute_force(spark, docs, monkeypatch):
    for name, n in {"POSTINGS": 5, "COUNTED": 9, "CANDIDATES": 4, "EDGES": 3, "REFERENCES": 2}.items():
        monkeypatch.setattr(graph, name, n)
    text = F.when(F.col("doc_id") % 9 == 0, "see doc_3.csv, Doc_12 and DOC 14 md; not doc_1x or xdoc_2.pdf doc_5 txt").otherwise(F.col("content"))
    made = graph.nodes(docs.withColumn("content", text)).persist()
    nodes = {r.doc_id: r for r in made.collect()}
    by = {}
    for i, r in nodes.items():
        of = [("term", t, w) for t, w in r.terms.items()] + [("phrase", p, 1.0) for p in r.phrases] + [("dir", d, 1.0) for d in r.dirs[-1:]]
        for kind, k, w in of:
            by.setdefault((graph.KINDS.index(kind), k), []).append((-w, i))
    words = lambda x: re.findall(r"\w+", x.replace("_", " ").casefold())
    named, content = {}, {r.doc_id: r.content for r in docs.withColumn("content", text).collect()}
    for i, r in nodes.items():
        for a in {" ".join(words(r.name)), " ".join(words(r.name.rpartition(".")[0]))}:
            named.setdefault(a, []).append(i)
    pairs = {}
    for i in nodes:
        body = f" {' '.join(words(content[i] or ''))} "
        met = {t for a, of in named.items() if f" {a} " in body for t in sorted(of)[:5] if t != i}
        pairs[i] = sorted(met)[:2]
    got = graph.mentions(docs.withColumn("content", text), made).collect()
    assert {(r.doc_id, r.target) for r in got} == {(i, t) for i, of in pairs.items() for t in of} and got
    monkeypatch.setattr(graph, "MOST_ALIASES", 1)
    assert sorted(map(tuple, graph.mentions(docs.withColumn("content", text), made).collect())) == sorted(map(tuple, got))
    both = {(i, t) for i, of in pairs.items() for t in of} | {(t, i) for i, of in pairs.items() for t in of}
    shared, first = Counter(), {}
    for k, of in by.items():
        for r, (_, other) in enumerate(sorted(of)[:5], 1):
            for _, i in of:
                if i != other:
                    shared[i, other] += 1
                    first[i, other] = min(first.get((i, other), (9,)), (*k, r))
    want = {}
    for i in nodes:
        mine = [o for (x, o) in {*shared, *both} if x == i]
        mine = sorted(mine, key=lambda o: ((i, o) not in both, (i, o) not in first, first.get((i, o), ()), o))[:9]
        for o in sorted(mine, key=lambda o: ((i, o) not in both, -shared[i, o], o))[:4]:
            if i < o or (i, o) in both:
                a, b = min(i, o), max(i, o)
                n, x = want.get((a, b), (0, 0))
                want[a, b] = max(n, shared[i, o]), max(x, int((i, o) in both))
    refs = spark.createDataFrame([(i, t) for i, of in pairs.items() for t in of], "doc_id long, target long")
    assert {(r.a, r.b): (r.shared, r.named) for r in graph.candidates(graph.keys(made), refs).collect()} == want
    edges = spark.createDataFrame([(a, b, ((a * 7 + b * 3) % 10) / 10) for a, b in want], "a long, b long, weight double")
    order, ends = lambda e: (-e[2], e[0], e[1]), {}
    for e in map(tuple, edges.collect()):
        for node in e[:2]:
            ends.setdefault(node, []).append(e)
    left = {e for of in ends.values() for e in sorted(of, key=order)[:3]}
    assert set(map(tuple, graph.pruned(edges, 3, None).collect())) == left
    assert set(map(tuple, graph.pruned(edges, 3, 5).collect())) == set(sorted(left, key=order)[:5])


def test_percentiles_by_ranges(spark):
    values = [(k, float((i * 7919) % 501) if i % 11 else None) for k in ("a", "b", None) for i in range(900 if k == "a" else 40)] + [("one", 5.0)]
    got = {r.k: tuple(r)[1:] for r in health.percentiles(spark.createDataFrame(values, "k string, v double"), "k", "v", (0.0, 0.5, 0.95, 1.0)).collect()}
    for k in {k for k, _ in values}:
        mine = sorted(v for x, v in values if x == k and v is not None)
        assert got[k] == tuple(mine[min(len(mine) - 1, int(f * (len(mine) - 1)))] for f in (0.0, 0.5, 0.95, 1.0))


def node(**k):
    blank = {"terms": {}, "phrases": [], "lexical": {}, "title_terms": [], "dirs": [], "source": "s"}
    return blank | k


@pytest.mark.parametrize(("left", "right", "want"), [
    (node(phrases=["a b", "c d"]), node(phrases=["a b", "e f"]), {"phrase_overlap": 1 / 3}),
    (node(terms={"a": 2.0, "b": 1.0}), node(terms={"a": 1.0, "c": 5.0}), {"shared_terms": 0.25, "keyword_overlap": 1 / 3}),
    (node(lexical={"a": 3.0, "b": 4.0}), node(lexical={"a": 1.0}), {"lexical_similarity": 0.6}),
    (node(title_terms=["x", "y"]), node(title_terms=["y"]), {"title_heading_overlap": 0.5}),
    (node(dirs=["a", "b", "c"]), node(dirs=["a", "b", "x", "c"]), {"directory_relationship": 0.5}),
    (node(source="t"), node(), {"provider_context": 0.0}),
])
def test_graph_signals(spark, left, right, want):
    kind = "struct<terms:map<string,double>,phrases:array<string>,lexical:map<string,double>,title_terms:array<string>,dirs:array<string>,source:string>"
    pair = spark.createDataFrame([(left, right)], f"l {kind}, r {kind}")
    got = pair.select(*(c.alias(n) for n, c in graph.signal_columns().items())).first().asDict()
    full = {n: 0.0 for n in got} | {"provider_context": 0.6} | want
    assert got == pytest.approx(full)


def slow_osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def folded(text):
    return "".join(c for c in unicodedata.normalize("NFD", text or "") if not unicodedata.combining(c)).casefold()


def test_fuzzy_verified_by_brute_force(spark, small):
    docs = corpus.documents(spark, small)
    got = {r.doc_id: {e["token"]: (e["rule"], e["distance"]) for e in json.loads(r.evidence)} for r in catalog.fuzzy_verified(spark, small).collect()}
    token, budget, want = "idiott", 1, {}
    prints = {r.doc_id for r in fuzzy.candidates(fuzzy.fingerprints(docs), [token], None).collect()}
    for r in docs.where(F.col("doc_id").isin(*prints)).collect():
        name, text = folded(r.name), folded(r.content)
        if token in name or token in text:
            want[r.doc_id] = {token: ("exact-name" if token in name else "exact-text", 0)}
            continue
        best = min((slow_osa(token, w) for w in set(re.findall(r"\w+", text)) if abs(len(w) - len(token)) <= budget), default=9)
        if best <= budget:
            want[r.doc_id] = {token: ("edit", best)}
    assert got == {i: want[i] for i in got} and len(got) == min(20, len(want))


def test_corrections_by_brute_force(spark, small):
    words = {r.token: r.occurrences for r in lexical.vocabulary(lexical.index_of(corpus.documents(spark, small))).collect()}
    by: dict = {}
    for w, n in words.items():
        by[folded(w)] = max(by.get(folded(w), 0), n)
    got = Counter((r.token, r.word, r.distance, r.occurrences) for r in catalog.suggest_corrections(spark, small).collect())
    want = []
    for token in ("idiott", "patethic", "wrothless"):
        budget = 1 if len(token) < 8 else 2
        near = [(slow_osa(token, w), -n, w) for w, n in by.items() if len(w) >= 3 and w != token and abs(len(w) - len(token)) <= budget and set(T.one_grams(token)) & set(T.one_grams(w))]
        want += [(token, w, d, -n) for d, n, w in sorted(x for x in near if x[0] <= budget)[: fuzzy.MOST_CORRECTIONS]]
    assert got == Counter(want) and want
    index = lexical.vocabulary(lexical.index_of(corpus.documents(spark, small)), limit=None)
    met = fuzzy.corrections(index, ["idiott", "patethic"], variants=fuzzy.neighbourhood(index))
    assert not re.search("NestedLoop|Cartesian", met._jdf.queryExecution().executedPlan().toString())


def test_engine_fallbacks_filters_and_suggestions(spark, docs):
    index = lexical.index_of(docs)
    engine = Engine(index, NOW, semantic=catalog.semantic.index_of(docs), prints=fuzzy.fingerprints(docs))
    assert {r.layer for r in engine.search("the").collect()} == {"lexical"}
    assert {r.layer for r in engine.search(catalog.SEMANTIC_QUERY).collect()} <= {"semantic", "fuzzy"}
    hit = engine.search("the", source="src3", doc_type="CSV").collect()
    assert hit and all(r.source == "src3" and r.extension == ".csv" for r in hit)
    assert engine.search("zzzzqqqq xxxx").count() == 0 and engine.search("-the").count() == 0
    assert [r.layer for r in engine.search("type:md", limit=3).collect()] == ["filter"] * 3
    assert engine.suggestions("the") == [] and engine.suggestions("zzzzqqqq") == []
    word = lexical.vocabulary(index).where("length(token) between 6 and 7 and token rlike '^[a-z]+$'").orderBy(F.desc("occurrences"), "token").first().token
    offered = engine.suggestions(word[:2] + word[3] + word[2] + word[4:] if word[2] != word[3] else word + "x")
    assert offered and offered[0]["distance"] == 1 and offered[0]["results"] > 0


def test_batches_of_many_shapes(spark, docs):
    texts = ["the", "the of", "the OR of", "the -of", '"of the" OR und', "the type:md", "of type:md size:>500", "(the OR of) type:md"]
    index = lexical.index_of(docs)
    plans = {t: language.plan(t) for t in texts}
    together = sorted((r.query, r.doc_id, round(r.bm25, 9)) for r in lexical.matches(index, plans).collect())
    apart = sorted((t, r.doc_id, round(r.bm25, 9)) for t in texts for r in lexical.matches(index, {t: plans[t]}).collect())
    assert together == apart


def test_usage_log_and_contexts(spark, tmp_path):
    path = str(tmp_path / "usage")
    usage.record(usage.opened(spark, [(1, 7, "  A   Query " + "x" * 300)], NOW), path)
    usage.record(usage.opened(spark, [(2, 8, "b")], NOW), path)
    kept = {r.event_id: r.query for r in spark.read.parquet(path).collect()}
    assert kept[1].startswith("a query xx") and len(kept[1]) == 200 and kept[2] == "b"
    assert usage.clear(spark, path) == 2 and spark.read.parquet(path).count() == 0
    held = usage.Contexts()
    held.add('{"name": "work", "roots": ["/w"], "related": {"a": ["b"]}, "recent_days": 9}')
    held.add('{"name": "home", "roots": ["/h", "/w"], "types": ["md"]}')
    assert held.merged() is None
    held.activate("home")
    held.activate("work")
    assert held.merged() == usage.Context("work", ("/h", "/w"), types=("md",), related={"a": ("b",)}, recent_days=9)
    held.remove("work")
    assert held.active == ["home"] and "work" not in held.known
    for bad in ('{"roots": []}', '{"name": "x", "colour": 1}'):
        with pytest.raises(ValueError):
            held.add(bad)
    with pytest.raises(KeyError):
        held.activate("work")


def test_saved_and_recent_searches():
    saved = organize.save_search([], organize.SavedSearch("A", "x"))
    saved = organize.save_search(saved, organize.SavedSearch("B", "y"))
    saved = organize.save_search(saved, organize.SavedSearch("a", "z", "size", "type"))
    assert [(s.name, s.query) for s in saved] == [("a", "z"), ("B", "y")]
    assert [s.name for s in organize.delete_search(saved, "b")] == ["a"]
    recent = []
    for q in [*map(str, range(25)), "3"]:
        recent = organize.remember(recent, q)
    assert recent[:2] == ["3", "24"] and len(recent) == 20 and len(set(recent)) == 20
    assert [organize.pool_size(*x) for x in ((20, "relevance"), (20, "name"), (200, "size"))] == [20, 100, 500]


def test_log_records(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"kind": "a", "seq": 1}\n\n[1]\n{"kind": "b", "seq"\n{"kind": "b", "seq": 2, "more": 3}\n"text"\n{"kind": "c"')
    got = health.load_records(spark, str(tmp_path / "log.jsonl"), "kind string, seq long")
    assert sorted((r.kind, r.seq) for r in got.collect()) == [("a", 1), ("b", 2)] and got.count() == 2
    health.append_records(got, str(tmp_path / "more"))
    health.append_records(got, str(tmp_path / "more"))
    assert health.load_records(spark, str(tmp_path / "more"), "kind string, seq long").count() == 4


def test_analysis_kept_in_step(spark, docs):
    now = docs.withColumn("content_hash", F.sha2(F.col("content").cast("binary"), 256)).where("doc_id < 12")
    stored = intelligence.analysis(now).join(now.select("doc_id", "content_hash"), "doc_id").withColumn("version", F.when(F.col("doc_id") == 4, 1).otherwise(2)).persist()
    later = now.withColumn("content", F.when(F.col("doc_id") == 5, "# New title\nzebra zebra").otherwise(F.col("content"))).withColumn("content_hash", F.sha2(F.col("content").cast("binary"), 256)).where("doc_id != 6")
    assert {r.doc_id for r in intelligence.stale(later, stored, 2).collect()} == {4, 5}
    fresh = {r.doc_id: r for r in intelligence.refreshed(later, stored, 2).collect()}
    assert 6 not in fresh and fresh[5].title == "New title" and {r.version for r in fresh.values()} == {2} and len(fresh) == later.count()
    at = lambda ref: [r.doc_id for r in intelligence.resolved(stored, now, ref).collect()]
    first = now.where("doc_id = 3").first()
    assert at(first.path) == at(first.name) == at("/elsewhere/" + first.name) == at("3") == [3] and at("nothing") == []
    assert intelligence.terms_of_text(spark, "Zebra and zebra, the okapi 123 of") == ["zebra", "okapi"]


def test_small_reports(spark):
    one = spark.createDataFrame([("a", 5.0)], "k string, v double")
    assert health.percentiles(one, "k", "v", (0.5, 0.95)).first() == ("a", 5.0, 5.0)
    groups = organize.grouped(spark.createDataFrame([("/a/x", ".md", "s", None, 1), ("/a/y", "", None, None, 2)], "path string, extension string, source string, modified_at timestamp, size long"), "type")
    assert organize.count_invariants(spark.range(2), groups).first().kept and not organize.count_invariants(spark.range(3), groups).first().kept
    found = spark.createDataFrame([(1, "/a", "n"), (2, "/b", "n")], "doc_id long, path string, name string")
    for bad in ({"references": ["/a"]}, {"references": ["/a"] * 51, "confirmed": True}):
        with pytest.raises(ValueError):
            ingest.forgotten_batch(found, **bad)
    assert {(r.reference, r.doc_id) for r in ingest.forgotten_batch(found, ["/b", "n", "?"], True).collect()} == {("/b", 2), ("n", 1), ("?", None)}
    words = spark.createDataFrame([("Foo_Bar  ÉTÉ!",)], "t string").select(intelligence.normal_word(F.col("t"))).first()[0]
    assert words == "foo bar été"
