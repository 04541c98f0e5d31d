"""File rules, extraction by format, and the stream's table after files change, move and vanish below several roots."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from inkwell.sources import files, rules
from inkwell.streaming import reconcile, watch


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


def by_name(df):
    return {r.name: r for r in df.collect()}


def test_rules(spark):
    paths = ["/r/a.txt", "/r/.GIT/a.txt", "/r/node_modules/x/y.js", "/r/sub/~$a.docx", "/r/b.tmp", "/r/venv", "/r/Thumbs.db", "/s/a.txt", "/rest/a.txt"]
    rows = spark.createDataFrame([(p, 1, None if p.endswith("venv") else "2024-01-01") for p in paths], "path string, size long, modified_at string")
    kinds = {r.path: r.kind for r in rules.tagged(rows, rules.Ignore(), ("/r/", "/s"), "/r").collect()}
    assert kinds == dict(zip(paths, ["file", "ignored", "ignored", "ignored", "ignored", "error", "ignored", "file", "error"], strict=True))
    found, errors = rules.split(rules.tagged(rows, rules.Ignore((), ("*.js",)), ("/r", "/s"), "/r"), 1)
    assert found.count() == 6 and [r.path for r in errors.collect()] == ["/r/venv"]
    states = spark.createDataFrame([(None, 10), (0x20, 10), (0x1000, 10), (0x400000, 10_000_000)], "attributes int, size long").select(rules.availability(F.col("attributes")).alias("a"), "size")
    assert [r.a for r in states.collect()] == ["available", "available", "cloud_only", "cloud_only"]
    assert [r[0] for r in states.select(rules.readable(F.col("a"), F.col("size"))).collect()] == [True, True, False, False]
    assert [r[0] for r in states.select(rules.readable(F.col("a"), F.col("size"), 1.0)).collect()] == [True, True, True, False]
    assert spark.range(1).select(rules.readable(F.lit("unavailable"), F.lit(1), 9.0), rules.readable(F.lit(None), F.lit(1), 9.0)).first() == (False, False)


def test_reachable(spark, tmp_path):
    roots = (str(tmp_path), str(tmp_path / "none"))
    assert rules.reachable(spark, roots, every=False) and not rules.reachable(spark, roots, every=True) and not rules.reachable(spark, (), every=False)


MAIL = b"Subject: Hi\r\nFrom: a@b.example\r\nTo: c@d.example\r\nDate: Mon, 1 Jan 2024 00:00:00 +0000\r\nContent-Type: text/plain\r\n\r\nBody text\r\n"
BOX = b"From x@y.example Mon Jan 1\nSubject: One\n\nfirst\n>From here on\n\nFrom z@y.example Mon Jan 1\nSubject: Two\nFrom: w@y.example\n\nsecond\n"


def test_formats(spark, tmp_path):
    sheet = '<worksheet><sheetData><row><c t="s"><v>1</v></c><c t="inlineStr"><is><t>inline</t></is></c><c><v>42</v></c></row></sheetData></worksheet>'
    given = {
        "code.rs": b"\xef\xbb\xbffn main() {}\0", "w.txt": "é".encode("utf-16"), "h.md": b"# One\ntext\n## Two #x\n", "bad.txt": b"a\xffb", "blank.txt": b" \n",
        "d.docx": zipped(**{"word/document.xml": '<d xmlns:w="x"><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:t>Head</w:t></w:p><w:p><w:t>a</w:t><w:t>b</w:t></w:p></d>', "docProps/core.xml": "<c><title>The title</title></c>"}),
        "evil.docx": zipped(**{"word/document.xml": '<!DOCTYPE d [<!ENTITY a "b">]><d>&a;</d>'}),
        "x.xlsm": zipped(**{"xl/sharedStrings.xml": "<sst><si><t>zero</t></si><si><r><t>o</t></r><r><t>ne</t></r></si></sst>", "xl/workbook.xml": '<w><sheet name="First"/></w>', "xl/worksheets/sheet1.xml": sheet}),
        "m.email": MAIL, "b.mbox": BOX,
        "z.zip": zipped(**{"a.txt": "alpha", "in/b.py": "beta", "c.png": b"\x89", "n.zip": zipped(q="1"), "../up.txt": "no", "bomb.txt": "0" * 3_000_000}),
        "broken.zip": b"PK", "p.png": b"\x89",
    }
    for name, body in given.items():
        (tmp_path / name).write_bytes(body)
    got = by_name(files.scan(spark, str(tmp_path), source="network"))
    text = {n: (r.content, r.status) for n, r in got.items()}
    assert text["code.rs"] == ("fn main() {}", "ok") and text["w.txt"] == ("é", "ok") and text["bad.txt"] == ("a�b", "ok") and text["blank.txt"] == (None, "empty")
    assert got["h.md"].structure == ["One", "Two #x"] and text["p.png"] == (None, "unsupported")
    assert text["d.docx"] == ("Head\nab", "ok") and got["d.docx"].structure == ["The title", "Head"]
    assert text["evil.docx"][1] == text["broken.zip"][1] == "failed" and "declares entities" in got["evil.docx"].warnings[0]
    assert text["x.xlsm"] == ("First\none\ninline\n42", "ok") and got["x.xlsm"].structure == ["First"]
    assert text["m.email"] == ("Hi\nFrom: a@b.example\nTo: c@d.example\nDate: Mon, 01 Jan 2024 00:00:00 +0000\nBody text", "ok")
    assert text["b.mbox"] == ("One\nFrom: x@y.example\nfirst\nFrom here on\n\nTwo\nFrom: w@y.example\nsecond", "ok")
    assert text["z.zip"] == ("\n=== a.txt (5 bytes) ===\nalpha\n=== in/b.py (4 bytes) ===\nbeta", "partial") and got["z.zip"].structure == ["a.txt", "in/b.py"]
    assert "1 archives not opened" in got["z.zip"].warnings and "2 members refused" in got["z.zip"].warnings and "1 members of other formats" in got["z.zip"].warnings
    assert {r.source for r in got.values()} == {"network"}
    raw = spark.read.format("binaryFile").load(str(tmp_path))
    parts = {(r.path.rpartition("/")[2], r.part): (r.name, r.content) for r in files.parts(raw).where("status = 'ok'").collect()}
    assert parts == {("z.zip", 0): ("a.txt", "alpha"), ("z.zip", 1): ("in/b.py", "beta"), ("b.mbox", 0): ("One", "One\nFrom: x@y.example\nfirst\nFrom here on"), ("b.mbox", 1): ("Two", "Two\nFrom: w@y.example\nsecond")}
    cut = by_name(files.extracted(raw, limits=files.Limits(characters=5, messages=1, members=1), read_if=~F.col("path").endswith("h.md")))
    assert (cut["d.docx"].content, cut["d.docx"].truncated, cut["d.docx"].status) == ("Head\n", True, "truncated") and not cut["bad.txt"].truncated
    assert cut["h.md"].status == "not_read" and cut["h.md"].content is None and cut["b.mbox"].truncated and cut["z.zip"].truncated
    assert set(by_name(files.scan(spark, str(tmp_path), ignore=rules.Ignore((), ("*.zip", "b*"))))) == {n for n in given if not n.endswith(".zip") and not n.startswith("b")}


def test_stream_follows_changes_below_its_roots(spark, tmp_path):
    a, b, state, mark = tmp_path / "a", tmp_path / "b", str(tmp_path / "state"), str(tmp_path / "checkpoint")
    for folder in (a, b, tmp_path / "ab"):
        folder.mkdir()
    (a / "x.txt").write_text("first")
    (a / "touched.txt").write_text("same")
    (a / "[1]*.txt").write_text("odd name")
    (b / "y.txt").write_text("other root")
    (tmp_path / "ab" / "z.txt").write_text("a root with the same start")
    counts = lambda df: {r.action: r.n for r in df.collect()}
    assert counts(reconcile.run_once(spark, str(a), state, mark)) == {"unchanged": 3}
    assert counts(reconcile.passes(spark, [str(b), str(tmp_path / "ab")], state).groupBy("action").agg(F.sum("n").alias("n"))) == {"created": 2}
    content = lambda: {r.name: r.content for r in reconcile.current(spark, state).collect()}
    assert len(content()) == 5
    (a / "x.txt").write_text("second")
    os.utime(a / "touched.txt", (1, 1))
    (a / "[1]*.txt").write_text("odd name, changed")
    assert counts(reconcile.run_once(spark, str(a), state, mark)) == {"updated": 2, "unchanged": 1}
    assert content() == {"x.txt": "second", "touched.txt": "same", "[1]*.txt": "odd name, changed", "y.txt": "other root", "z.txt": "a root with the same start"}
    os.remove(a / "x.txt")
    assert "deleted" not in counts(reconcile.run_once(spark, str(a), state, mark)) and "x.txt" in content()  # not complete
    (a / "broken.docx").write_bytes(b"PK")
    got = {(r.root.rpartition("/")[2], r.action): r.n for r in reconcile.passes(spark, [str(a), str(tmp_path / "nowhere"), str(b)], state, rules.Ignore((), ("touched*",))).collect()}
    assert got == {("a", "created"): 1, ("a", "deleted"): 2, ("a", "unchanged"): 1, ("a", "extraction_errors"): 1, ("nowhere", "error"): 1, ("b", "unchanged"): 1}
    assert set(content()) == {"[1]*.txt", "broken.docx", "y.txt", "z.txt"}


ROW = lambda p, t: (p, p, ".txt", 1, None, t, "ok", t, [], False, [])


def folders(state):
    return sorted(d for d in os.listdir(state) if d.startswith("b"))


def test_a_batch_writes_its_own_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(reconcile, "FOLDED_SHARE", 0.5)
    state = str(tmp_path / "state")
    put = lambda rows: reconcile.put(spark, state, spark.createDataFrame(rows, reconcile.STORED))
    put([ROW(f"/{i}", "old") for i in range(100)])
    put([ROW("/5", "new"), ROW("/6", "new")])
    assert spark.read.parquet(f"{state}/b2").count() == 2 and folders(state) == ["b1", "b2"]
    content = lambda: {r.path: r.content for r in reconcile.current(spark, state).collect()}
    want = {f"/{i}": "new" if i in (5, 6) else "old" for i in range(100)}
    assert content() == want
    put([ROW(f"/{i}", "late") for i in range(40, 90)])  # so many that the table is folded
    want |= {f"/{i}": "late" for i in range(40, 90)}
    assert content() == want and len(reconcile.batches(spark, state)) == 1
    for k in range(2):
        put([ROW(f"/{i}", f"more {k}") for i in range(60)])
    want |= {f"/{i}": "more 1" for i in range(60)}
    assert content() == want and "b1" not in folders(state)  # what no reader needs has gone
    reconcile.put(spark, state, gone=reconcile.current(spark, state).where("path != '/7'").select("path"))
    assert set(content()) == {"/7"}
    reconcile.put(spark, state, gone=reconcile.current(spark, state).select("path"))
    assert content() == {}


def test_a_pass_reads_each_file_once(spark, tmp_path, monkeypatch):
    tree, state = tmp_path / "tree", str(tmp_path / "state")
    (tree / "in").mkdir(parents=True)
    for i in range(30):
        (tree / "in" / f"{i}.txt").write_text(f"text {i}")
    (tree / "bad.docx").write_bytes(b"PK")
    (tree / "x.tmp").write_text("")
    reads = spark.sparkContext.accumulator(0)

    def counting(data, limits):
        reads.add(1)
        return files.plain(data, limits)

    plain = files.extracted
    monkeypatch.setattr(files, "extracted", lambda raw: plain(raw, files.READERS | {"txt": counting}))
    counts = lambda **k: {r.action: r.n for r in reconcile.reconcile(spark, str(tree), state, ignore=rules.Ignore(), **k).collect()}
    assert counts(files_per_batch=8) == {"created": 31, "ignored": 1, "extraction_errors": 1} and reads.value == 30
    assert len(folders(state)) <= 8
    (tree / "in" / "3.txt").write_text("another text")
    os.utime(tree / "in" / "4.txt", (1, 1))
    os.remove(tree / "in" / "5.txt")
    assert counts() == {"updated": 1, "unchanged": 29, "deleted": 1, "ignored": 1} and reads.value == 32
    there = files.walked(spark, str(tree)).withColumn("availability", F.when(F.col("path").endswith("/6.txt"), "cloud_only").otherwise("available"))
    there = there.withColumn("size", F.when(~F.col("path").rlike("/[789].txt"), F.col("size")))
    got = counts(there=there, most_errors=2)
    assert got == {"unchanged": 26, "cloud_only": 1, "errors": 2, "dropped_errors": 1, "ignored": 1}
    assert len(reconcile.COUNTERS) == 9


def test_ignored_directories_are_never_opened(spark, tmp_path):
    for name in ("a/b/c", "a/node_modules/x/y", ".git/objects", "d"):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "f.txt").write_text("x")
    tally = spark.sparkContext.accumulator(0)
    got = files.walked(spark, str(tmp_path), rules.Ignore(), tally)
    assert {r.path.removeprefix(f"file:{tmp_path}/") for r in got.collect()} == {"a/b/c/f.txt", "d/f.txt"} and tally.value == 5
    every = files.walked(spark, str(tmp_path))
    listed = files.listing(spark, str(tmp_path)).select(*every.columns)
    seen = every.where("path not like '%/.git/%'")  # Spark's own listing leaves hidden folders out
    assert sorted(map(tuple, seen.collect())) == sorted(map(tuple, listed.collect())) and every.count() == 4


def test_a_file_is_read_once_it_is_quiet(spark, tmp_path):
    tree, state, notices, mark = tmp_path / "tree", str(tmp_path / "state"), str(tmp_path / "notices"), str(tmp_path / "mark")
    tree.mkdir()
    at = lambda s: f"2024-01-01 00:00:{s:06.3f}"
    note = lambda s: watch.note(spark, str(tree), state, notices, at(s))
    run = lambda: watch.changes(spark, notices, state, mark, quiet="2 seconds").awaitTermination()
    batches = lambda: len(reconcile.batches(spark, state))
    for s in (1, 2, 3):
        (tree / "x.txt").write_text(f"version {s}")
        os.utime(tree / "x.txt", (s, s))
        note(s)
        run()  # ends each time, so that the state crosses restarts
    assert batches() == 0
    (tree / "y.txt").write_text("other")
    note(5.5)
    run()
    assert {r.name: r.content for r in reconcile.current(spark, state).collect()} == {"x.txt": "version 3"} and batches() == 1
    os.remove(tree / "x.txt")
    for s in (9, 12):
        note(s)
        run()
    assert {r.name: r.content for r in reconcile.current(spark, state).collect()} == {"y.txt": "other"}


@pytest.mark.parametrize("data", [
    '<!DOCTYPE d [<!ENTITY a "b">]><d>&a;</d>'.encode("utf-16"),
    ("<!--" + "x" * 70_000 + '--><!DOCTYPE d [<!ENTITY a "b">]><d>&a;</d>').encode(),
    b"<!DOCTYPE d><d/>",
    b'<!DOCTYPE d SYSTEM "file:///etc/passwd"><d/>',
])
def test_document_types_and_entities_are_refused(data):
    with pytest.raises(ValueError, match="declares entities"):
        files.parsed(data, "m")
    assert files.text_of("docx", zipped(**{"word/document.xml": data}), None, files.READERS, files.Limits())[0] == "failed"
    tree = files.parsed('<a:b xmlns:a="u" a:k="v" l="w">x<c>ü</c>y</a:b>'.encode("utf-16"), "m")
    assert (tree.tag, tree.attrib, tree.text, tree[0].text, tree[0].tail) == ("{u}b", {"{u}k": "v", "l": "w"}, "x", "ü", "y")


def test_parts_tell_what_they_leave_out(spark, tmp_path):
    (tmp_path / "broken.zip").write_bytes(b"PK nothing")
    (tmp_path / "b.mbox").write_bytes(b"From a\nSubject: One\n\nx\nFrom b\nSubject: Two\n\ny\n")
    (tmp_path / "z.zip").write_bytes(zipped(**{"a.txt": "alpha", "../b.txt": "no"}))
    raw = spark.read.format("binaryFile").load(str(tmp_path)).withColumn("length", F.when(F.col("path").endswith("z.zip"), F.lit(files.MOST_BYTES + 1)).otherwise(F.col("length")))
    got = {(r.path.rpartition("/")[2], r.part, r.status) for r in files.parts(raw, files.Limits(messages=1)).collect()}
    assert got == {("broken.zip", None, "failed"), ("b.mbox", 0, "ok"), ("b.mbox", None, "truncated"), ("z.zip", None, "too_large")}
    assert {r.status for r in files.parts(spark.read.format("binaryFile").load(str(tmp_path / "z.zip"))).collect()} == {"ok", "partial"}


@pytest.mark.parametrize("name", ["/abs.txt", "C:x.txt", "a/../b.txt", "a//b.txt", "./a.txt"])
def test_unsafe_members(name):
    assert files.refusal(zipfile.ZipInfo(name), files.Limits())


SHEET = '<w><c><v>{}</v></c></w>'


def read(extension, data, **limits):
    return files.text_of(extension, data, None, files.READERS, files.Limits(**limits))


def test_an_unreadable_part_leaves_the_rest():
    sheets = {f"xl/worksheets/sheet{n}.xml": SHEET.format(n) for n in (10, 2, 1)}
    status, found = read("xlsx", zipped(**sheets, **{"xl/worksheets/sheet3.xml": "<w><c>"}))
    assert (status, found.text, found.structure) == ("partial", "1\n2\n10", ["sheet1", "sheet2", "sheet3"]) and found.warnings[0].startswith("xl/worksheets/sheet3.xml")
    # Shared strings that declare entities are refused; numbers of strings that are not there give nothing.
    cells = '<w><c t="s"><v>0</v></c><c t="s"><v>x</v></c><c t="s"><v>-1</v></c><c t="s"/><c><v>7</v></c></w>'
    status, found = read("xlsx", zipped(**{"xl/sharedStrings.xml": '<!DOCTYPE d [<!ENTITY a "b">]><sst/>', "xl/worksheets/sheet1.xml": cells}))
    assert (status, found.text) == ("partial", "7") and "declares entities" in found.warnings[0]
    slides = {"ppt/slides/slide1.xml": "<p><t>one</t><t>two</t></p>", "ppt/slides/slide2.xml": "", "ppt/slides/slide3.xml": "<p><t>one</t></p>"}
    status, found = read("pptx", zipped(**slides))
    assert (status, found.text, found.structure) == ("partial", "one two\none", ["one"])
    assert read("xlsx", zipped(**{"xl/worksheets/sheet1.xml": "<"}))[0] == "partial"
    assert read("xlsx", zipped(**{"xl/worksheets/sheet1.xml": "<w/>"}))[0] == "empty"
    document = {"word/document.xml": '<d><p><pStyle val="heading 2"/><t>Head</t></p></d>', "docProps/core.xml": "<c>"}
    status, found = read("docx", zipped(**document))
    assert (status, found.text, found.structure) == ("partial", "Head", ["Head"])


def test_limits_of_parts_and_time():
    sheets = zipped(**{f"xl/worksheets/sheet{n}.xml": SHEET.format(n) for n in range(1, 6)})
    slides = zipped(**{f"ppt/slides/slide{n}.xml": f"<p><t>s{n}</t></p>" for n in range(1, 6)})
    for extension, data, limit, text in (("xlsx", sheets, {"sheets": 2}, "1\n2"), ("pptx", slides, {"slides": 3}, "s1\ns2\ns3")):
        status, found = read(extension, data, **limit)
        assert (status, found.text) == ("truncated", text) and found.warnings == [f"stopped at {next(iter(limit.values()))} of 5 {next(iter(limit))}"]
        assert read(extension, data, **{next(iter(limit)): 5})[0] == "ok"
    late = {"xlsx": sheets, "pptx": slides, "docx": zipped(**{"word/document.xml": "<d><p><t>a</t></p></d>"}), "zip": zipped(**{"a.txt": "alpha"}), "mbox": BOX}
    for extension, data in late.items():
        status, found = read(extension, data, seconds=-1.0)
        assert (status, found.text, found.truncated) == ("truncated", None, True) and "out of time" in found.warnings[0], extension
        assert read(extension, data, seconds=None)[0] == read(extension, data)[0] == "ok", extension
    headings = "\n".join(f"# {'h' * 300}{n % 100}" for n in range(200)) + "\n# z\n# z\n"
    assert read("md", headings.encode())[1].structure == ["h" * 200, "z"]
    assert len(read("md", "\n".join(f"# {n}" for n in range(200)).encode())[1].structure) == 64
    assert len(read("md", "\n".join(f"# {n}" for n in range(200)).encode(), entries=150)[1].structure) == 150


def test_files_beyond_the_bytes_that_are_read(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0123456789")
    raw = spark.read.format("binaryFile").load(str(tmp_path))
    assert [files.extracted(raw, limits=files.Limits(input_bytes=n)).first().status for n in (9, 10)] == ["too_large", "ok"]
