"""Vector codes, collocations and line dedup against brute force, with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import collocations, common, line_dedup, vector_codes

# --- vector codes ---


def squared(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def coded(rows, parts=16, entries=64, rounds=2):
    """{(id, label): [(code, error)]} and the entries by length of vector, in Python's integers."""
    of = defaultdict(list)
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            of[len(v)].append((i is None, i or 0, v, label, [math.floor(256 * x) if abs(x) < 2**53 else int(x) * 256 for x in v]))
    out, books = defaultdict(list), {}
    for width, kept in of.items():
        kept.sort(key=lambda r: r[:3])
        edges = [p * width // parts for p in range(parts + 1)]
        book = [[r[4][a:b] for r in kept[:entries]] for a, b in zip(edges, edges[1:], strict=False)]
        nearest = lambda v, p, book=book, edges=edges: min(range(len(book[p])), key=lambda e: (squared(v[edges[p] : edges[p + 1]], book[p][e]), e))
        for _ in range(rounds):
            groups = defaultdict(list)
            for r in kept:
                for p in range(parts):
                    groups[p, nearest(r[4], p)].append(r[4][edges[p] : edges[p + 1]])
            for (p, e), members in groups.items():
                book[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
        for none, i, _, label, v in kept:
            code = [nearest(v, p) for p in range(parts)]
            error = sum(squared(v[edges[p] : edges[p + 1]], book[p][e]) for p, e in enumerate(code))
            out[None if none else i, label].append((bytes(code), error if error < 2**63 else None))
        books[width] = book
    return out, books


def held_codes(spark, rows, **how):
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    books, got = vector_codes.compress(data.withColumns({"v": F.lit(1), "width": F.lit("x"), "id": F.lit(0), "named": F.lit(2.0)}), **how)
    want, entries = coded(rows, **how)
    found, labels, errors = defaultdict(list), defaultdict(set), defaultdict(list)
    for r in got.collect():
        found[r.vec_id, r.label].append((bytes(r.code), r.error))
        labels[r.label].add(r.label_error)
        errors[r.label].append(r.error)
    assert {k: sorted(v, key=repr) for k, v in found.items()} == {k: sorted(v, key=repr) for k, v in want.items()}
    for label, values in errors.items():
        total = None if None in values else sum(values)
        assert labels[label] == {total if total is not None and total < 2**63 else None}
    for width, own in books.items():
        assert [p.tolist() for p in own.parts] == entries[width]
        assert own.sha256() == hashlib.sha256(",".join(str(x) for part in entries[width] for e in part for x in e).encode()).hexdigest()
    return books


def test_vector_codes(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice((-0.5, 0.0, 0.25, 0.2501)) for _ in range(32)], i % 3 if i % 4 else None) for i in range(120)]
    held_codes(spark, rows)


def test_vector_codes_odd_rows(spark):
    rng = random.Random(4)
    some = lambda n: [rng.uniform(-1, 1) for _ in range(n)]
    rows = [
        (1, None, 1), (2, [0.0] * 16, 1), (3, [math.nan, *some(15)], 1), (4, [math.inf, *some(15)], 2), (5, [*some(15), -math.inf], 2), (6, [None, *some(15)], 2), (None, some(16), 2), (None, some(16), None),
        (7, [], 3), (8, [], 3), (9, some(5), 4), (10, some(5), 4), (11, some(40), None), (12, [1e30, *some(15)], 5), (13, [-3.5e9, *some(15)], 5), (14, [1e308] * 16, 5), (15, [2.0**40] * 16, 6),
    ]
    rows += [(20, some(16), 7)] * 2 + [(20, some(16), 7), (2, [0.0] * 16, 1)] + [(100 + i, some(16), 8) for i in range(70)]
    books = held_codes(spark, rows)
    assert set(books) == {0, 5, 16, 40}
    assert held_codes(spark, []) == {}
    first = books[16].decoded(bytes(16))
    assert len(first) == 16 and first == [x for part in books[16].parts for x in part[0]]


@pytest.mark.parametrize("most", [3, 300, 5000, 2**21, 2**27])
def test_nearest_is_exact(most):
    rng = np.random.default_rng(most)
    for m in (1, 4, 7):
        parts, entries = rng.integers(-most, most, (500, m)), rng.integers(-most, most, (64, m))
        entries[5], parts[:50] = entries[40], entries[rng.integers(0, 64, 50)]
        near = entries[7].copy()
        near[0] += 1
        entries[8] = near  # entries that float32 can't tell apart where numbers are large
        index, distance = vector_codes.nearest(parts, entries)
        every = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


# --- collocations ---


def counted(rows):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    return f, n


def mined(rows, least=30, page=2000):
    out = []
    f, n = counted(rows)
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {q for p, a in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 80 * c[q := p[i : i + k]]}
        best = []
        for p, a in candidates.items():
            if p not in gone:
                score, _, l, r = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:page], 1)]
    return sorted(out)


def text_of(rng, n, words="ab cd ef gh ij kl mn Ab ÉÉ ß \x1f \x85 the of".split(" "), gaps=(" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "\x0b", ";", "?", "!:")):
    return "".join(rng.choice(words) + rng.choice(gaps) for _ in range(n))


def test_collocations(spark):
    rng = random.Random(5)
    rows = [(rng.choice(("en", "en", "fr", None, "")), text_of(rng, rng.randrange(0, 120))) for _ in range(150)] + [("en", None), ("en", ""), ("en", " \t\n.")] + [("fr", "same piece again and again")] * 40
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, n int, phrase string")
    for page in (2000, 7):
        assert sorted(map(tuple, collocations.mine(docs, least=12, page=page).collect())) == mined(rows, 12, page)
    assert collocations.mine(docs.limit(0)).count() == 0
    same = [r for r in rows if r[1] and r[1].startswith("same")]
    assert sorted(map(tuple, collocations.mine(docs.where("text like 'same%'")).collect())) == mined(same) != []


def test_long_piece_is_counted_once(spark):
    words = [f"w{i % 997}" for i in range(2 * collocations.SEGMENT + 2)]
    none, cut = collocations.pieces_of("\t".join(words) + ".", 4)
    assert not none and [t for t, _ in cut] == [3, 2, 0]
    f = Counter()
    for tail, piece in cut:
        part = piece.split()
        for k in range(1, 5):
            f.update(tuple(part[i : i + k]) for i in range(min(len(part) - tail, len(part) - k + 1)))
    want = Counter(tuple(w.encode() for w in words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    assert f == want
    docs = spark.createDataFrame([("en", " ".join(words))], "lang string, text string")
    got = {r.phrase: r.f for r in collocations.counts(docs).collect() if r.n_words}
    assert got == {b" ".join(k).decode(): n for k, n in want.items() if n >= 30}


# --- line dedup ---


def kept_lines(rows, least_chars=20, least_docs=3):
    """[(id, n_lines, n_dropped, kept)] by definition; ids of null are one document below all."""
    blank = " \t\n\x0b\x0c\r"
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(blank))
    order = lambda i: (i is not None, i or 0)
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(low(line)) >= least_chars:
                held[low(line)].add(order(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(held[low(x)]) < least_docs or max(held[low(x)]) == order(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def line_rows(n):
    rng = random.Random(6)
    pool = [f"{'shared line' * 2} number {k} É" for k in range(12)] + ["short", "", " \t ", "exactly nineteen ch", "exactly twenty chars"]
    dress = lambda s: rng.choice((s, s.upper(), f" {s}\t", f"{s}\r", f"\x0b{s}\x0c"))
    rows = [(i, "\n".join(dress(rng.choice(pool)) if rng.random() < 0.7 else f"a line of document {i} alone {rng.random()}" for _ in range(rng.randrange(0, 9)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "\n\n"), (n + 3, "x" * 200_000 + "\n" + pool[0]), (n + 4, "\n".join([pool[1]] * 500))] + [(i, "this line is in every document") for i in range(n)]


def test_lines(spark):
    rows = line_rows(120) + [(None, "null id: shared by three at least"), (None, "null id: shared by three at least"), (7, "null id: shared by three at least"), (None, "this line is in every document")] + [(5, "one id: a line of two rows")] * 2
    docs = spark.createDataFrame([(*r, "h", "l") for r in rows], "doc_id long, text string, hash string, last string")
    got = sorted(map(tuple, line_dedup.deduplicate(docs).collect()), key=repr)
    assert got == kept_lines(rows)
    assert sorted(map(tuple, line_dedup.deduplicate(docs.repartition(3), least_chars=5, least_docs=2, batches=3).collect()), key=repr) == kept_lines(rows, 5, 2)
    assert line_dedup.deduplicate(docs.limit(0)).count() == 0
    named = docs.where("doc_id is not null").select(F.format_string("%05d", "doc_id").alias("doc_id"), "text")
    assert sorted(map(tuple, line_dedup.deduplicate(named).collect()), key=repr) == kept_lines([(None if i is None else f"{i:05d}", t) for i, t in rows if i is not None])


def test_runs_are_levelled_sorted_and_apart(spark):
    runs = line_dedup.LineRuns(spark, fan_in=2)
    lines = lambda a, b: spark.range(a, b).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("hash"), (1000 - F.col("id")).alias("id"))
    for k in range(5):
        runs.add(lines(k * 10, k * 10 + 25))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    kept = runs.kept().collect()
    assert len(kept) == len({bytes(r.hash) for r in kept}) == 65
    # Joining a batch to a run shuffles and sorts the batch alone.
    run = runs.runs()[0]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lines(0, 9).groupBy("hash").count().join(run.select("hash"), "hash", "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_shared_folder_of_a_session_that_names_none(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf, sparkContext = Conf(), spark.sparkContext

    here = common.shared_folder(Session())
    assert here == common.shared_folder(Session()) and here.startswith("/")
    far = type("Context", (), {"master": "yarn", "applicationId": "a"})
    monkeypatch.setattr(Session, "sparkContext", far)
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_folder(Session())
