"""Every edge of the graph against pair-by-pair scoring of all pairs of documents."""

from pyspark.sql import functions as F

from inkwell.operators import every, graph
from inkwell.plans import catalog
from inkwell.plans.corpus import documents


def of_all_pairs(nodes, named=None):
    ids = lambda c: nodes.select(F.col("doc_id").alias(c))
    pairs = ids("a").crossJoin(ids("b")).where("a < b")
    pairs = pairs.join(named.withColumn("named", F.lit(1)), ["a", "b"], "left").fillna(0, ["named"]) if named else pairs.withColumn("named", F.lit(0))
    return {(r.a, r.b): (r.weight, r.edge_type) for r in graph.scored(nodes, pairs).collect()}


def test_the_query_gives_every_edge(spark, small):
    got = {(r.a, r.b): r.edge_type for r in catalog.QUERIES["graph_edges"](spark, small).collect()}
    docs = documents(spark, small)
    want = of_all_pairs(graph.nodes(docs).persist())
    assert got == {pair: kind for pair, (_, kind) in want.items()}
    of = [sum(i in pair for pair in got) for i in {i for pair in got for i in pair}]
    assert max(of) > graph.COUNTED // 2 > graph.EDGES


def test_weights_are_those_of_pair_by_pair_scoring(spark, small, monkeypatch):
    col, none = F.col, F.lit(None)
    docs = documents(spark, small).where("doc_id < 90").withColumns({
        "content": F.when(col("doc_id") == 7, none).when(col("doc_id") % 9 == 0, F.concat(F.lit("see doc_3.csv, Doc_12 and DOC 14 md, please read this me first; not doc_1x or xdoc_2.pdf "), "content")).otherwise(col("content")),
        "name": F.when(col("doc_id") > 69, F.lit("please read this me first.md")).otherwise(col("name")),
        "path": F.when(col("doc_id") == 11, none).when(col("doc_id") == 12, F.lit("name.md")).when(col("doc_id") < 20, F.concat(F.lit("/deep/in/folders"), "path")).otherwise(col("path")),
        "source": F.when(col("doc_id") < 13, none).otherwise(col("source")),
    }).persist()
    nodes = graph.nodes(docs).persist()
    of = graph.aliases(nodes, None)  # a name of five words counts too
    hits = graph.hits(docs, of).join(of.withColumnRenamed("doc_id", "target"), "alias").where("doc_id != target")
    named = hits.select(F.least("doc_id", "target").alias("a"), F.greatest("doc_id", "target").alias("b")).distinct().persist()
    # A text that names as many as twenty, where bounded graphs take sixteen.
    assert hits.groupBy("doc_id").agg(F.countDistinct("target").alias("n")).agg(F.max("n")).first()[0] > graph.REFERENCES
    want = of_all_pairs(nodes, named)
    assert {(r.a, r.b): (r.weight, r.edge_type) for r in every.edges(docs).collect()} == want
    assert sum(kind == "explicit_reference" for _, kind in want.values()) == named.count()
    monkeypatch.setattr(graph, "MOST_ALIASES", 1)
    texts = every.edges(docs.withColumn("doc_id", col("doc_id").cast("string"))).collect()
    assert all(r.a < r.b for r in texts) and {tuple(sorted((int(r.a), int(r.b)))): (r.weight, r.edge_type) for r in texts} == want
