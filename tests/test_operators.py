"""Language, text functions, edit distance, streaming ingestion and sources."""

import os
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import derived, fuzzy, graph, intelligence, lexical
from inkwell.operators.search import Engine
from inkwell.plans import language
from inkwell.session import with_count
from inkwell.sources import files
from inkwell.streaming import reconcile


def slow_osa(a, b):
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@given(st.text("abc", max_size=9), st.text("abc", max_size=9), st.integers(0, 3))
def test_osa(a, b, cap):
    assert fuzzy.osa(a, b, cap) == min(slow_osa(a, b), cap + 1)


def test_grams(spark):
    texts = ["", "ab", "abc", "abcd", "a\nbc", "naïve é", "𝒜𝒷𝒸𝒹", None]
    got = [r.g for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.grams(F.col("t")).alias("g")).collect()]
    assert got == [T.one_grams(t or "") for t in texts]


@pytest.mark.parametrize("bad", ["a AND", "OR b", "(a", "a)", "type:", "size:>x", "after:2026-02-30", "-", "a OR type:md", "a OR -b"])
def test_language_errors(bad):
    with pytest.raises(language.QueryError):
        language.plan(bad)


DOCS = [(1, "src", "apple.md", "/a/apple.md", ".md", 10, "apple banana apple"), (2, "src", "pear.txt", "/a/pear.txt", ".txt", 20, "banana pear"), (3, "src", "none.txt", "/b/none.txt", ".txt", 0, None), (4, "src", "p.md", "/b/p.md", ".md", 5, "pear apple")]


def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, source string, name string, path string, extension string, size long, content string").withColumn("modified_at", F.lit("2023-12-01").cast("timestamp"))


@pytest.mark.parametrize(("query", "ids"), [("apple", {1, 4}), ("banana pear", {2}), ("apple OR pear", {1, 2, 4}), ("apple -banana", {4}), ('"pear apple"', {4}), ("name:pear", {2}), ("apple type:md size:<8", {4}), ("none", {3}), ("zzz", set()), ("type:txt", {2, 3})])
def test_search(spark, query, ids):
    assert {r.doc_id for r in Engine(lexical.index_of(docs(spark)), "2024-01-01 00:00:00").search(query).collect()} == ids


def test_stored_index_gives_the_same(spark, tmp_path):
    engine = lambda i: Engine(i, "2024-01-01 00:00:00").search("apple OR pear").select("doc_id", "score").collect()
    assert engine(derived.lexical_index(docs(spark), str(tmp_path))) == engine(lexical.index_of(docs(spark)))


def test_files_and_stream(spark, tmp_path):
    """A folder is scanned, changed and scanned again; the stream's state follows."""
    folder, state = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()
    (folder / "a.txt").write_text("first")
    (folder / "b.md").write_text("# Title\ntext")
    (folder / "c.bin").write_bytes(b"\xff\xfe\x00")
    got = {r.name: (r.extension, r.content, r.size) for r in files.scan(spark, str(folder)).collect()}
    assert got == {"a.txt": (".txt", "first", 5), "b.md": (".md", "# Title\ntext", 12), "c.bin": (".bin", None, 3)}
    reconcile.run_once(spark, str(folder), state, str(tmp_path / "checkpoint"))
    assert {r.name for r in reconcile.current(spark, state).collect()} == {"a.txt", "b.md", "c.bin"}
    (folder / "a2.txt").write_text("second")
    reconcile.run_once(spark, str(folder), state, str(tmp_path / "checkpoint"))
    assert {r.name: r.content for r in reconcile.current(spark, state).collect() if r.content} == {"a.txt": "first", "b.md": "# Title\ntext", "a2.txt": "second"}
    os.remove(folder / "a.txt")
    reconcile.run_once(spark, str(folder), state, str(tmp_path / "checkpoint"), complete=True)
    assert {r.name for r in reconcile.current(spark, state).collect()} == {"a2.txt", "b.md", "c.bin"}


def test_extraction(spark, tmp_path):
    """Zip-based, mail and delimited formats give their text; broken ones a status instead of a failure."""
    import zipfile

    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="x"><w:body><w:p><w:r><w:t>Hello</w:t></w:r><w:r><w:t> docx</w:t></w:r></w:p><w:p><w:t>Next</w:t></w:p></w:body></w:document>')
    with zipfile.ZipFile(tmp_path / "s.pptx", "w") as z:
        z.writestr("ppt/slides/slide1.xml", '<p:sld xmlns:a="y" xmlns:p="x"><a:p><a:t>Slide one</a:t></a:p></p:sld>')
    (tmp_path / "m.eml").write_bytes(b"Subject: Hi\r\nFrom: a@b.example\r\nContent-Type: text/plain\r\n\r\nBody text\r\n")
    (tmp_path / "t.html").write_text("<html><head><style>x{}</style></head><body><p>One</p><p>Two &amp; three</p></body></html>")
    (tmp_path / "j.json").write_text('{"a": "b"}')
    (tmp_path / "broken.docx").write_bytes(b"PK no zip")
    got = {r.name: (r.content, r.status) for r in files.scan(spark, str(tmp_path)).collect()}
    assert got["d.docx"] == ("Hello docx\nNext", "ok") and got["s.pptx"] == ("Slide one", "ok")
    assert "Hi" in got["m.eml"][0] and "Body text" in got["m.eml"][0]
    assert got["t.html"][0].split() == ["One", "Two", "&", "three"]
    assert got["j.json"] == ('{"a": "b"}', "ok") and got["broken.docx"] == (None, "failed")


def test_middle_of_long_text(spark):
    """A heading, frequent words, their pairs and the language in the middle of a text of more than 200,000 characters count."""
    text = "x\n" * 80_000 + "# Middle Part\n" + "zebra quagga the of and to in is it for that with was on\n" * 50 + "x\n" * 40_000
    long = spark.createDataFrame([(1, "s", "a.txt", "/d/a.txt", text)], "doc_id long, source string, name string, path string, content string")
    got = intelligence.analysis(long).first()
    assert len(text) > 200_000 and (got.title, got.headings, got.language, got.sections) == ("Middle Part", ["Middle Part"], "en", 1)
    assert {(t.term, t.n) for t in got.terms} >= {("zebra", 50), ("quagga", 50)} and ("quagga", "zebra") in {(p.left, p.right) for p in got.pairs}
    assert (got.analyzed_chars, got.truncated) == (len(text), False)
    assert graph.nodes(long).first().lexical["zebra"] >= 50


def test_fuzzy_reads_all(spark):
    """A near word behind 4,000 and behind 200,000 characters, and a true match behind more than 50 candidates with better shares."""
    filler = "zz yy xx " * 500
    rows = [(i, "n", f"/{i}", "alphabetx") for i in range(60)]  # shares more of the asked word, but is no match for the other word
    rows += [(100, "n", "/100", filler + "alphabet rivers"), (101, "n", "/101", filler * 50 + "alphabet rivres")]
    docs = spark.createDataFrame(rows, "doc_id long, name string, path string, content string")
    got = {r.doc_id: [(e.rule, e.distance) for e in r.evidence] for r in fuzzy.verified(docs, ["alphabet", "rivers"]).collect()}
    assert got == {100: [("exact-text", 0), ("exact-text", 0)], 101: [("exact-text", 0), ("edit", 1)]}
    prints = docs.select("doc_id", F.explode(F.array(*(F.lit(g) for g in T.one_grams("alphabet")))).alias("gram"))
    assert {r.doc_id for r in fuzzy.search(docs, prints, "alphabet rivers").collect()} == {100, 101}
    assert {r.gram for r in fuzzy.fingerprints(docs.where("doc_id = 101")).collect()} >= {"alp", "vre"}



def test_batch_takes_every_item(spark, tmp_path, small):
    """More items than a thousand, each with its best document as the plans for single queries give it."""
    from pyspark.sql import Window

    from inkwell.plans import catalog, corpus

    items = corpus.table(spark, small, "benchmark").select("text").crossJoin(spark.range(60)).select(F.row_number().over(Window.orderBy("id", "text")).cast("long").alias("item_id"), "text")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    os.symlink(f"{small}/documents.parquet", tmp_path / "documents.parquet")
    asked = {r.item_id: tuple(T.one_tok_index(r.text)[:2]) for r in items.collect()}
    got = {r.item_id: (r.doc_id, r.bm25) for r in catalog.bm25_batch(spark, str(tmp_path)).collect()}
    index = lexical.index_of(corpus.documents(spark, small))
    pairs = sorted({t for t in asked.values() if len(t) > 1})
    want = {r.query: (r.doc_id, r.bm25) for r in lexical.pool(index, {str(i): language.plan(f'"{a}" OR "{b}"') for i, (a, b) in enumerate(pairs)}, limit=1, size=1).collect()}
    assert len(asked) > 1000 and set(got) == {i for i, t in asked.items() if t in pairs and str(pairs.index(t)) in want}
    assert all(got[i] == (want[str(pairs.index(asked[i]))][0], pytest.approx(want[str(pairs.index(asked[i]))][1], abs=1e-6)) for i in got)


def test_long_text_is_whole(spark, tmp_path):
    """A text of more than five million characters is kept whole, and a change at its end changes the hash."""
    for name in "ab":
        (tmp_path / f"{name}.txt").write_text("x" * 5_000_001 + name)
    got = {r.name: r for r in files.scan(spark, str(tmp_path)).select("name", "status", "content_hash", F.length("content").alias("n")).collect()}
    assert {(r.n, r.status) for r in got.values()} == {(5_000_002, "ok")} and got["a.txt"].content_hash != got["b.txt"].content_hash


def test_counts_of_hot_keys_are_dealt_and_whole(spark):
    words = [("the", i) for i in range(3000)] + [("of", i) for i in range(700)] + [(f"w{i % 50}", i) for i in range(200)] + [("once", 1), (None, 1), ("the", 5)]
    rows = spark.createDataFrame(words, "word string, doc_id long")
    want = Counter(w for w, _ in words)
    for hot_rows in (100, 10**6):
        counted = with_count(rows, "word", "doc_id", "df", hot_rows)
        assert counted.columns == ["word", "doc_id", "df"]
        assert Counter(map(tuple, counted.collect())) == Counter((w, i, want[w]) for w, i in words if w is not None)
    # The rows of the commonest key lie in several tasks.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        dealt = with_count(rows, "word", "doc_id", "df", 100).where("word = 'the'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(dealt) > 1 and sum(r["count"] for r in dealt) == 3001
    assert with_count(rows.limit(0), "word", "doc_id", "df").count() == 0
