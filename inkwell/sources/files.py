"""File trees as document rows: a binary scan, and text by format.

Spark lists and reads the files, so any file system that it reads will do; an Arrow function takes each file's text
from its bytes, within limits. A file that can't be read gives null content and a status, never a failed job.
"""

from __future__ import annotations

import email
import email.policy
import html
import io
import re
import time
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from xml.etree import ElementTree
from xml.parsers import expat

import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.sources.rules import Ignore

#: Bytes of a file that is read, unless limits say otherwise; a larger one has a status and no text.
MOST_BYTES = 64 << 20
#: Fixed value: extensions read as text.
PLAIN = ("txt", "md", "csv", "json", "xml", "py", "js", "ts", "tsx", "jsx", "java", "c", "h", "cpp", "hpp", "cs", "go", "rs", "sql", "yaml", "yml", "toml", "ini", "log")
MORE_PLAIN = ("markdown", "tsv", "jsonl", "rst")
#: Warnings of a file at most, and their length.
MOST_WARNINGS, WARNING_LETTERS = 20, 300


@dataclass(frozen=True)
class Limits:
    """What one file may hold and unpack to. characters: of a text; None keeps it whole. entries, entry_letters: of the structure.

    seconds: after which a file is left at the next sheet, slide, paragraph, member or message, so that it can't hold up a task; what was read stays and is marked truncated. Reruns may then differ; None sets no such limit.
    """

    input_bytes: int = MOST_BYTES
    sheets: int = 500
    slides: int = 1000
    seconds: float | None = 30.0
    entries: int = 64
    entry_letters: int = 200
    members: int = 4096
    member_bytes: int = 16 << 20
    total_bytes: int = 256 << 20
    ratio: float = 100.0
    messages: int = 2000
    characters: int | None = None


@dataclass
class Found:
    """What a reader gets from a file. structure: headings, sheets or members by name. partial: something was left out."""

    text: str | None = None
    structure: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    partial: bool = False
    truncated: bool = False

    def left_out(self, why: str) -> None:
        """A part could not be read; the rest counts."""
        self.warnings.append(why)
        self.partial = True

    def stopped(self, why: str) -> None:
        """A limit ended the reading."""
        self.warnings.append(why)
        self.truncated = True


class Clock:
    """The time that a reader has for one file."""

    def __init__(self, limits: Limits) -> None:
        self.seconds, self.start = limits.seconds, time.monotonic()

    def late(self, found: Found, what: str, n: int) -> bool:
        """Whether time is up before the n-th part, counted from 0."""
        if self.seconds is None or time.monotonic() - self.start <= self.seconds:
            return False
        found.stopped(f"out of time after {self.seconds:g} s and {n} {what}")
        return True


#: What an unreadable member raises: wrong XML, a broken or encrypted zip, a method of compression that is not known, a limit.
UNREADABLE = (ValueError, expat.ExpatError, zipfile.BadZipFile, zlib.error, OSError, EOFError, NotImplementedError, RuntimeError)

Reader = Callable[[bytes, Limits], Found]


def one_line(text: str, most: int = WARNING_LETTERS) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", " ", text).strip()[:most]


def decoded(data: bytes) -> str:
    """UTF-8, or UTF-16 where a mark says so; bad bytes are replaced, NUL goes."""
    wide = data[:2] in (b"\xff\xfe", b"\xfe\xff")
    return data.decode("utf-16" if wide else "utf-8-sig", "replace").replace("\0", "")


def plain(data: bytes, limits: Limits) -> Found:
    return Found(decoded(data))


def markdown(data: bytes, limits: Limits) -> Found:
    text = decoded(data)
    return Found(text, re.findall(r"(?m)^#{1,6}[ \t]+(.+?)[ \t]*$", text))


def flattened(text: str) -> str:
    text = re.sub(r"(?is)<(script|style|head|title)\b.*?</\1\s*>", " ", text)
    text = re.sub(r"(?i)</?(p|div|br|li|tr|h[1-6]|table|section)\b[^>]*>", "\n", text)
    return re.sub(r"\s*\n\s*", "\n", html.unescape(re.sub(r"<[^>]*>", "", text))).strip()


def markup(data: bytes, limits: Limits) -> Found:
    return Found(flattened(decoded(data)))


# --- zip-based formats ---


def refusal(member: zipfile.ZipInfo, limits: Limits) -> str | None:
    """Why a member must not be read, by its header alone; None where it may."""
    parts = member.filename.rstrip("/").split("/")
    if "\0" in member.filename or re.match(r"/|[A-Za-z]:", member.filename) or {"", ".", ".."} & set(parts):
        return f"unsafe name {member.filename!r}"
    if member.file_size > limits.member_bytes:
        return f"{member.filename} declares {member.file_size} bytes"
    if limits.ratio and member.compress_size and member.file_size > limits.ratio * member.compress_size:
        return f"{member.filename} unpacks to {member.file_size} bytes from {member.compress_size}"
    return None


class Package:
    """A zip file whose members are checked before they are read, and bounded together."""

    def __init__(self, data: bytes, limits: Limits) -> None:
        self.zip, self.limits, self.left = zipfile.ZipFile(io.BytesIO(data)), limits, limits.total_bytes

    def read(self, member: zipfile.ZipInfo) -> bytes:
        """A member's bytes; the size that its header declares is not trusted."""
        if why := refusal(member, self.limits):
            raise ValueError(why)
        most = min(self.limits.member_bytes, self.left)
        with self.zip.open(member) as f:
            data = f.read(most + 1)
        if len(data) > most:
            raise ValueError(f"{member.filename} unpacks to more than {most} bytes")
        self.left -= len(data)
        return data

    def matching(self, pattern: str) -> list[zipfile.ZipInfo]:
        """Members by name, numbers in their order."""
        found = [m for m in self.zip.infolist() if re.fullmatch(pattern, m.filename)]
        return sorted(found, key=lambda m: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", m.filename)])

    def tree(self, member: zipfile.ZipInfo) -> ElementTree.Element:
        return parsed(self.read(member), member.filename)


def parsed(data: bytes, name: str) -> ElementTree.Element:
    """An XML tree. The parser itself refuses a document type or an entity, in any encoding and wherever it stands."""
    builder, parser = ElementTree.TreeBuilder(), expat.ParserCreate(namespace_separator="}")
    tag = lambda n: "{" + n if "}" in n else n

    def refused(*_: object) -> None:
        raise ValueError(f"{name} declares entities")

    parser.StartDoctypeDeclHandler = parser.EntityDeclHandler = refused
    parser.StartElementHandler = lambda n, attributes: builder.start(tag(n), {tag(k): v for k, v in attributes.items()})
    parser.EndElementHandler = lambda n: builder.end(tag(n))
    parser.CharacterDataHandler = builder.data
    parser.Parse(data, True)
    return builder.close()


def local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def attribute(e: ElementTree.Element, name: str) -> str:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), "")


def inside(e: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [x for x in e.iter() if local(x) == name]


def runs(e: ElementTree.Element, between: str = "") -> str:
    return between.join(t.text or "" for t in inside(e, "t"))


def trees(package: Package, pattern: str, found: Found, what: str = "parts", most: int | None = None, clock: Clock | None = None) -> Iterator[ElementTree.Element]:
    """The trees of the members of a name, in order and within limits. One that can't be read is left out with a warning."""
    members = package.matching(pattern)
    for n, member in enumerate(members):
        if most is not None and n >= most:
            found.stopped(f"stopped at {most} of {len(members)} {what}")
            return
        if clock and clock.late(found, what, n):
            return
        try:
            yield package.tree(member)
        except UNREADABLE as e:
            found.left_out(f"{member.filename}: {e}")


def docx(data: bytes, limits: Limits) -> Found:
    """Paragraphs, one a line. The document's own part must be readable; its title may be missing."""
    clock, package, found = Clock(limits), Package(data, limits), Found()
    lines = []
    for member in package.matching(r"word/document\.xml"):
        for n, p in enumerate(inside(package.tree(member), "p")):
            if clock.late(found, "paragraphs", n):
                break
            if text := runs(p):
                lines.append(text)
                if any(attribute(s, "val").lower().startswith("heading") for s in inside(p, "pStyle")):
                    found.structure.append(text)
    for core in trees(package, r"docProps/core\.xml", found):
        found.structure[:0] = [t.text for t in inside(core, "title") if t.text and t.text.strip()][:1]
    found.text = "\n".join(lines)
    return found


def pptx(data: bytes, limits: Limits) -> Found:
    """Slides by number, one a line."""
    clock, package, found, slides = Clock(limits), Package(data, limits), Found(), []
    for slide in trees(package, r"ppt/slides/slide\d+\.xml", found, "slides", limits.slides, clock):
        texts = [t.text for t in inside(slide, "t") if t.text and t.text.strip()]
        if texts:
            slides.append(" ".join(texts))
            found.structure.append(texts[0])
    found.text = "\n".join(slides)
    return found


def xlsx(data: bytes, limits: Limits) -> Found:
    """The sheets' names, then cells in order, one a line: shared and inline strings, and raw values. A number of a shared string that is none gives nothing."""
    clock, package, found = Clock(limits), Package(data, limits), Found()
    shared = [runs(si) for part in trees(package, r"xl/sharedStrings\.xml", found) for si in inside(part, "si")]
    names = [n for part in trees(package, r"xl/workbook\.xml", found) for s in inside(part, "sheet") if (n := attribute(s, "name"))]
    lines, numbers = list(names), []

    def cell_text(cell: ElementTree.Element) -> str:
        kind, value = attribute(cell, "t"), next((v.text or "" for v in inside(cell, "v")), "")
        if kind == "inlineStr":
            return runs(cell)
        if kind != "s":
            return value
        return shared[int(value)] if re.fullmatch(r"\s*[0-9]{1,9}\s*", value) and int(value) < len(shared) else ""

    for sheet in trees(package, r"xl/worksheets/sheet\d+\.xml", found, "sheets", limits.sheets, clock):
        lines += filter(None, map(cell_text, inside(sheet, "c")))
        numbers.append(f"sheet{len(numbers) + 1}")
    found.text, found.structure = "\n".join(lines), names or numbers
    return found


def odt(data: bytes, limits: Limits) -> Found:
    """Paragraphs and headings, one a line."""
    package = Package(data, limits)
    lines = ["".join(p.itertext()) for m in package.matching(r"content\.xml") for p in package.tree(m).iter() if local(p) in ("p", "h")]
    return Found("\n".join(x for x in lines if x))


def archive_members(data: bytes, limits: Limits) -> tuple[list[tuple[str, int, str]], Found]:
    """(name, bytes, text) of an archive's text members, and what was left out: archives in archives, other formats, unsafe members."""
    clock, package, found, out, other, nested, refused = Clock(limits), Package(data, limits), Found(), [], 0, 0, []
    infos = package.zip.infolist()
    if len(infos) > limits.members:
        found.stopped(f"stopped at {limits.members} of {len(infos)} members")
    for n, member in enumerate(infos[: limits.members]):
        if clock.late(found, "members", n):
            break
        suffix = member.filename.rpartition("/")[2].rpartition(".")[2].lower()
        if member.is_dir():
            continue
        if why := refusal(member, limits):
            refused.append(why)
        elif suffix == "zip":
            nested += 1
        elif suffix not in PLAIN:
            other += 1
        else:
            try:
                body = package.read(member)
            except UNREADABLE as e:
                refused.append(f"{member.filename}: {e}")
                continue
            out.append((member.filename, len(body), decoded(body)))
    found.warnings += [f"refused: {w}" for w in refused[:5]]
    found.warnings += [f"{n} {what}" for n, what in ((nested, "archives not opened"), (other, "members of other formats"), (len(refused), "members refused")) if n]
    found.partial, found.structure = bool(nested or other or refused), [n for n, _, _ in out]
    return out, found


def archive(data: bytes, limits: Limits) -> Found:
    """Text members one after the other, each below a line with its name."""
    members, found = archive_members(data, limits)
    # Fixed value: the form of the line.
    found.text = "".join(f"\n=== {name} ({size} bytes) ===\n{text}" for name, size, text in members)
    return found


# --- mail ---


def messages(raw: bytes) -> list[bytes]:
    """The messages of a mail box: each starts with a line `From `; `>From ` in a body is unescaped."""
    out = re.split(rb"(?m)^(?=From )", raw)
    return [re.sub(rb"(?m)^>From ", b"From ", m) for m in out if m.strip()]


def message(raw: bytes) -> Found:
    """Subject, people and date, and the text bodies; attachments are counted, not read."""
    envelope = re.match(rb"From (\S+)[^\n]*\n", raw)
    m = email.message_from_bytes(raw[envelope.end() :] if envelope else raw, policy=email.policy.default)
    found, bodies, attached, lost = Found(), [], 0, 0

    def header(name: str) -> str:
        try:
            return one_line(str(m[name] or ""), 2000)
        except Exception:  # a header of any content
            return ""

    subject, people = header("subject"), {h: header(h) for h in ("From", "To", "Cc", "Reply-To", "Date")}
    if envelope and not people["From"]:
        people["From"] = envelope[1].decode("ascii", "replace")
    for part in m.walk():
        kind = part.get_content_type()
        if part.is_multipart():
            continue
        if part.get_content_disposition() == "attachment" or kind not in ("text/plain", "text/html"):
            attached += 1
            continue
        try:
            text = part.get_content()
        except Exception:  # an unknown charset loses this part only
            lost += 1
            continue
        bodies.append((flattened(text) if kind == "text/html" else text).strip())
    found.text = "\n".join([*filter(None, [subject]), *(f"{k}: {v}" for k, v in people.items() if v), *filter(None, bodies)])
    found.structure = [subject] if subject else []
    found.warnings = [f"{n} {what}" for n, what in ((attached, "attachments not read"), (lost, "parts unreadable")) if n]
    found.partial = bool(lost)
    return found


def mail(data: bytes, limits: Limits) -> Found:
    return message(data)


def mail_box(data: bytes, limits: Limits) -> Found:
    clock, every, found, texts = Clock(limits), messages(data), Found(), []
    if len(every) > limits.messages:
        found.stopped(f"stopped at {limits.messages} of {len(every)} messages")
    for n, raw in enumerate(every[: limits.messages]):
        if clock.late(found, "messages", n):
            break
        one = message(raw)
        texts.append(one.text or "")
        found.structure += one.structure
        found.warnings += one.warnings
        found.partial |= one.partial
    found.text = "\n\n".join(texts)
    return found


#: Format by extension; a caller may pass more.
READERS: dict[str, Reader] = {
    **dict.fromkeys((*PLAIN, *MORE_PLAIN), plain),
    **dict.fromkeys(("md", "markdown"), markdown),
    **dict.fromkeys(("html", "htm", "xhtml"), markup),
    **dict.fromkeys(("xlsx", "xlsm"), xlsx),
    **dict.fromkeys(("eml", "email"), mail),
    **dict.fromkeys(("mbox", "mbx"), mail_box),
    "docx": docx,
    "pptx": pptx,
    "odt": odt,
    "zip": archive,
}


def outline(names: list[str], limits: Limits) -> list[str]:
    """A file's structure: distinct lines in their order, bounded in number and length."""
    lines = (one_line(n, limits.entry_letters) for n in names)
    return list(dict.fromkeys(filter(None, lines)))[: limits.entries]


def text_of(extension: str, data: bytes | None, why: str | None, readers: dict[str, Reader], limits: Limits) -> tuple[str, Found]:
    """(status, what was found): ok, partial, truncated, empty, failed, unsupported, or why the file was not to be read."""
    reader = readers.get(extension)
    if why or reader is None:
        return why or "unsupported", Found()
    try:
        found = reader(data or b"", limits)
    except Exception as e:  # a file of any content is data, not a reason to stop the scan
        return "failed", Found(warnings=[f"{type(e).__name__}: {e}"])
    if found.text and limits.characters is not None and len(found.text) > limits.characters:
        found.text, found.truncated = found.text[: limits.characters], True
    if not found.text or not found.text.strip():
        found.text = None
    found.structure = outline(found.structure, limits)
    return "truncated" if found.truncated else "partial" if found.partial else "empty" if found.text is None else "ok", found


ROWS = "path string, name string, suffix string, size long, modified_at timestamp, content string, status string, warnings array<string>, truncated boolean, structure array<string>"


def extracted(raw: DataFrame, readers: dict[str, Reader] | None = None, limits: Limits = Limits(), read_if: Column | None = None) -> DataFrame:
    """Document rows from (path, modificationTime, length, content) rows. read_if: whether a file's content may be read."""
    readers = READERS if readers is None else readers
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, "[.]([^.]+)$", 1))
    why = F.when(F.lit(False) if read_if is None else ~read_if, "not_read").when(F.col("length") > limits.input_bytes, "too_large")
    rows = raw.select("path", name.alias("name"), suffix.alias("suffix"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), F.when(why.isNull(), F.col("content")).alias("data"), why.alias("why"))
    lists = pa.list_(pa.string())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [text_of(s, d, w, readers, limits) for s, d, w in zip(*(b.column(c).to_pylist() for c in ("suffix", "data", "why")), strict=True)]
            kept = b.drop_columns(["data", "why"])
            new = {
                "content": pa.array([f.text for _, f in found], pa.string()),
                "status": pa.array([s for s, _ in found], pa.string()),
                "warnings": pa.array([[one_line(w) for w in f.warnings[:MOST_WARNINGS]] for _, f in found], lists),
                "truncated": pa.array([f.truncated for _, f in found], pa.bool_()),
                "structure": pa.array([f.structure for _, f in found], lists),
            }
            yield pa.RecordBatch.from_arrays([*kept.columns, *new.values()], names=[*kept.schema.names, *new])

    out = rows.mapInArrow(read, ROWS)
    extension = F.when(F.col("suffix") != "", F.concat(F.lit("."), "suffix")).otherwise("")
    return out.select("path", "name", extension.alias("extension"), "size", "modified_at", "content", "status", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"), "warnings", "truncated", "structure")


def parts(raw: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(path, part, name, content, status): a row for each text member of the archives and each message of the mail boxes among raw rows; status: ok.

    What is left out has a row of its own for the file, without part and content: status too_large, failed (with why as name), partial (members refused) or truncated (beyond the limits).
    """
    schema = pa.schema([("path", pa.string()), ("part", pa.int32()), ("name", pa.string()), ("content", pa.string()), ("status", pa.string())])

    def members(path: str, size: int, data: bytes) -> list[tuple]:
        if size > limits.input_bytes:
            return [(path, None, None, None, "too_large")]
        try:
            if path.lower().endswith(".zip"):
                rows, found = archive_members(data, limits)
                rows = [(n, t) for n, _, t in rows]
                left = [("truncated" if found.truncated else "partial", "; ".join(found.warnings))] if found.truncated or found.partial else []
            else:
                every = messages(data)
                rows = [((m.structure or [None])[0], m.text) for m in map(message, every[: limits.messages])]
                left = [("truncated", f"{len(every) - limits.messages} messages")] if len(every) > limits.messages else []
        except Exception as e:  # a file of any content is data, not a reason to stop the scan
            return [(path, None, one_line(f"{type(e).__name__}: {e}"), None, "failed")]
        return [(path, i, name, text, "ok") for i, (name, text) in enumerate(rows)] + [(path, None, one_line(why), None, status) for status, why in left]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("path", "length", "content")), strict=True):
                found = members(*row)
                for k in range(0, len(found), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found[k : k + 256], strict=True), schema.types, strict=True)], schema=schema)

    content = F.when(F.col("length") <= limits.input_bytes, F.col("content")).alias("content")
    return raw.where(F.lower("path").rlike("[.](zip|mbox|mbx)$")).select("path", "length", content).mapInArrow(each, "path string, part int, name string, content string, status string")


LISTED = pa.schema([("path", pa.string()), ("folder", pa.bool_()), ("size", pa.int64()), ("modified_at", pa.timestamp("us", "UTC"))])


def walked(spark: SparkSession, root: str, ignore: Ignore | None = None, tally: Accumulator | None = None) -> DataFrame:
    """(path, size, modified_at) of every file under root, listed by executors level by level; a directory that the rules skip is never opened. tally: gets the number of directories listed."""
    from inkwell.session import new_folder

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for path in b.column(0).to_pylist():
                scheme, _, place = path.partition(":")
                system, inner = (fs.LocalFileSystem(), unquoted(place)) if scheme == "file" else fs.FileSystem.from_uri(path)
                found = system.get_file_info(fs.FileSelector(inner))
                if tally is not None:
                    tally.add(1)
                names = [f"{path.rstrip('/')}/{f.base_name}" for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([f.type == fs.FileType.Directory for f in found], pa.bool_()), pa.array([None if f.size is None else int(f.size) for f in found], pa.int64()), pa.array([None if f.mtime_ns is None else f.mtime_ns // 1_000_000 * 1000 for f in found], pa.int64()).cast(LISTED.types[3])], schema=LISTED)

    skipped = set(d.lower() for d in ignore.directories) if ignore else set()
    level, out = spark.createDataFrame([(within(root).rstrip("/"),)], "path string"), []
    while level is not None:
        path = new_folder(spark, "listing")
        level.mapInArrow(opened, "path string, folder boolean, size long, modified_at timestamp").write.parquet(path)
        listed = spark.read.parquet(path)
        out.append(listed.where("not folder").select("path", "size", "modified_at"))
        deeper = listed.where("folder").where(~F.lower(F.element_at(F.split("path", "/"), -1)).isin(sorted(skipped))).select("path")
        level = None if deeper.isEmpty() else deeper.repartition(spark.sparkContext.defaultParallelism)
    return reduce(DataFrame.unionByName, out)


def unquoted(place: str) -> str:
    """A local path from what follows `file:`."""
    return "/" + place.lstrip("/")


def listing(spark: SparkSession, root: str, pattern: str = "*", source: str = "local") -> DataFrame:
    """(source, path, size, modified_at) of every file under root; contents are not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return raw.select(F.lit(source).alias("source"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))


def scan(spark: SparkSession, root: str, pattern: str = "*", readers: dict[str, Reader] | None = None, ignore: Ignore | None = None, source: str = "local", limits: Limits = Limits()) -> DataFrame:
    """Document rows of every file under root that the rules don't skip."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    if ignore is not None:
        raw = raw.where(~ignore.column("path", within(root)))
    return extracted(raw, readers, limits).withColumn("source", F.lit(source))


def within(root: str) -> str:
    """A root as the file source writes it in paths: with a scheme."""
    return root if "://" in root or root.startswith("file:") else f"file:{root}"
