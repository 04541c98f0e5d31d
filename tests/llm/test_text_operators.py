"""Token counts, BPE, winnowing, language model and toxicity against brute force, with odd rows."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkwell.llm import bpe, common, interpolation_lm, queries, token_counts, toxicity, winnowing

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "The cat's <|endoftext|> sat; naïve ÀÉ ﬁ 汉字 🎉🎉 é İstanbul ǅ"), (5, "same text again " * 400), (6, "same text again " * 400),
    (7, "x" * 50_000), (None, "a row without an id"), (8, "twice"), (8, "twice"), (9, "\0 nul \x85 next line <|startoftext|>hello"), (10, "don't I'LL they've 123 1,000.50 foo_bar"),
]
SCHEMA = "doc_id long, text string"


def odd(spark):
    """Odd rows, with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 1, "x", 0.5, 7) for i, t in ODD], SCHEMA + ", n_tokens int, source string, score double, part int")


def real(spark, small):
    docs = common.table(spark, small, "documents").select("doc_id", "text")
    return docs, {r.doc_id: r.text for r in docs.collect()}


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORDS.findall(lower(text))


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, small, tmp_path, name):
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        own = Tokenizer.from_file(path)
        want = lambda t: len(own.encode(t or "", add_special_tokens=False).ids)
    else:
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        want = lambda t: len(own.encode(t or ""))
    cache = token_counts.DigestCache(spark, str(tmp_path / "cache"))
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken") if name.endswith(".json") else None
    got = token_counts.count_tokens(odd(spark), cache, path, ranks).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(((i, len((t or "").encode()), want(t)) for i, t in ODD), key=key)
    docs, texts = real(spark, small)
    for _ in range(2):  # the second call finds every digest
        got = token_counts.count_tokens(docs, cache, path, ranks).collect()
        assert {r.doc_id: r.n_tokens for r in got} == {i: want(t) for i, t in texts.items()}
    stored = spark.read.parquet(cache.path)
    assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for _, t in ODD} | set(texts.values()))
    assert token_counts.count_tokens(odd(spark).limit(0), cache, path, ranks).count() == 0


def test_bpe_agrees_with_the_library(spark, small):
    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    docs, texts = real(spark, small)

    def want(i, t):
        ids = own.encode(t or "", add_special_tokens=False).ids
        return i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    for given, rows in ((odd(spark), ODD), (docs, list(texts.items()))):
        got = bpe.encode_documents(given, path).collect()
        digest = lambda b: hashlib.sha256(b).hexdigest()
        key = lambda r: (r[0] is None, r[0] or 0, r[2])
        assert sorted([(r.doc_id, r.n_tokens, digest(bytes(r.ids_le32)), digest(r.decoded.encode())) for r in got], key=key) == sorted([want(*r) for r in rows], key=key)
    assert bpe.encode_documents(odd(spark).limit(0), path).count() == 0


def test_bpe_of_number_signs_and_all_plain_characters():
    codec = bpe.Codec(public_tokenizers.path("word_bpe_49k.json"))
    want = lambda t: codec.own.encode(t, add_special_tokens=False).ids
    for text in ("10 m² and x³", "a¼b", "foo²³bar", "¹½¾", "a<|endoftext|>b"):
        assert codec.encode(text) == want(text)
    letters = [c for c in map(chr, range(1, 0x2100)) if bpe.PLAIN.fullmatch(c)]
    rng = np.random.default_rng(11)
    for n in rng.integers(1, 30, 5000):
        text = "".join(rng.choice(letters, n))
        assert codec.encode(text) == want(text), text


def halves(text):
    data = text.encode()
    pieces = bpe.sliced(data, np.array(bpe.cuts(data), np.int64))
    assert b"".join(pieces) == data
    return pieces, [bpe.digest(p) for p in pieces]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunks_are_shared_and_joins_repaired(name):
    codec = bpe.Codec(public_tokenizers.path(name))
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(list("abcdefgh'9 é"), 6)) for _ in range(500)]
    passage = " ".join(rng.choice(vocabulary, 3000))
    texts = [" ".join(rng.choice(vocabulary, 300)) + "  " + passage for _ in range(2)]
    (first, _), (second, _) = map(halves, texts)
    assert len(set(first) & set(second)) > len(first) // 2
    repaired = 0
    for text in (*texts, "a   b\n\n c \t" * 900, "one two " * 2000, "ab " * 3000):
        pieces, names = halves(text)
        memory, repairs = [codec.encode_bytes(p) for p in pieces], {}
        whole = codec.own.encode(text, add_special_tokens=False).ids
        found = bpe.joined(pieces, memory, names, codec.encode_bytes, repairs)
        assert (found if found is not None else codec.encode(text)) == whole
        repaired += sum(r != (0, [], 0) for r in repairs.values())
        if len(pieces) > 1 and text in texts:
            assert found is not None
            assert (sum(memory, []) == whole) == (name != "byte_bpe_50k.json")  # without repair the byte-level ids would be wrong
    assert (repaired > 0) == (name == "byte_bpe_50k.json")


def test_a_join_that_small_windows_misjudge():
    """A toy coder whose pairs run over the join as far as the letters do: only a wider window, or none, agrees."""
    encode = lambda data: [len(x) for x in re.findall(rb"a+|[^a]", data)]
    left, right = b"xyz b" + b" a" * 0 + b"aaaa" * 10, b"a" * 30 + b" bcd efg hij"
    found = bpe.repair(left, encode(left), right, encode(right), encode)
    assert found is not None
    dropped, between, lead = found
    ids = encode(left)
    assert ids[: len(ids) - dropped] + between + encode(right)[lead:] == encode(left + right)
    assert bpe.repair(b"aaaa", [4], b"aaa", [3], lambda d: [len(d)]) in (None, (1, [7], 1))


def test_bpe_with_repair_in_spark(spark, small):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    docs, texts = real(spark, small)
    got = bpe.encode_documents(docs, path).collect()
    assert {r.doc_id: np.frombuffer(r.ids_le32, "<u4").tolist() for r in got} == {i: own.encode(t or "", add_special_tokens=False).ids for i, t in texts.items()}


def test_bpe_chunks_of_many_blocks(spark, monkeypatch):
    """Passages that most blocks share, so common that their answers are dealt by salts, and a very long text."""
    monkeypatch.setattr(bpe, "SALTED", 3)
    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    rng = np.random.default_rng(12)
    word = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n))
    passage = word(2000)
    texts = {i: f"{word(100)} {passage} {word(50)}" for i in range(24)} | {24: word(150_000)}
    docs = spark.createDataFrame(list(texts.items()), SCHEMA).repartition(12)
    got = {r.doc_id: np.frombuffer(r.ids_le32, "<u4").tolist() for r in bpe.encode_documents(docs, path).collect()}
    assert got == {i: own.encode(t, add_special_tokens=False).ids for i, t in texts.items()}


def slow_winnow(text, k, w):
    """Kept (hash, place) by the definition: of each window the smallest hash, the rightmost of equal ones."""
    codes = np.array([ord(c) for c in text], dtype=np.uint32)
    if not len(codes):
        return []
    k = min(k, len(codes))
    h = [int(winnowing.rolling(codes[i : i + k], k)[0]) for i in range(len(codes) - k + 1)]
    w, kept = min(w, len(h)), set()
    for i in range(len(h) - w + 1):
        kept.add(min(range(i, i + w), key=lambda j: (h[j], -j)))
    return [(h[j], j) for j in sorted(kept)]


def test_winnowing_by_definition():
    rng = np.random.default_rng(2)
    for n, letters in ((0, "a"), (1, "a"), (5, "ab"), (23, "ab"), (24, "ab"), (60, "a"), (400, "ab"), (400, "abcdefghé🎉")):
        text = "".join(rng.choice(list(letters), n))
        hashes, places = winnowing.winnow(text)
        assert list(zip(hashes.tolist(), places.tolist(), strict=True)) == slow_winnow(text, winnowing.K, winnowing.W)
    shared = "".join(rng.choice(list("abcdefgh"), winnowing.K + winnowing.W - 1))  # a passage of w + k - 1 letters leaves a common hash
    for _ in range(20):
        a, b = ("".join(rng.choice(list("abcdefgh"), 90)) + shared + "".join(rng.choice(list("abcdefgh"), 70)) for _ in range(2))
        assert set(winnowing.winnow(a)[0].tolist()) & set(winnowing.winnow(b)[0].tolist())


def test_winnowing_segments(monkeypatch):
    text = "".join(np.random.default_rng(3).choice(list("abc "), 5000))
    whole = winnowing.winnow(text)
    monkeypatch.setattr(winnowing, "SEGMENT", 128)
    for x, y in zip(whole, winnowing.winnow(text), strict=True):
        assert x.tolist() == y.tolist()


@pytest.mark.parametrize("which", ["real", "odd"])
def test_edited_and_next(spark, small, which):
    docs, texts = real(spark, small) if which == "real" else (odd(spark), None)
    rows = sorted(texts.items()) if texts else sorted(((i, t or "") for i, t in ODD), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    prints = lambda t: set(winnowing.winnow(t)[0].tolist())
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want = []
    for n, (i, t) in enumerate(rows):
        t, after = t or "", rows[(n + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), alike(prints(t), prints(edited)), alike(prints(t), prints(after))))
    got = winnowing.edited_and_next(docs).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted([(r.id if "id" in r else r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got], key=key) == sorted(want, key=key)
    equal = {}
    for r in got:
        text = dict(rows)[r.doc_id] if which == "real" else None
        if text is not None:
            assert equal.setdefault(text, r.fingerprint) == r.fingerprint
    assert winnowing.edited_and_next(docs.limit(0)).count() == 0
    assert winnowing.edited_and_next(docs.limit(1)).count() == 1


def test_language_model(spark, small):
    _, texts = real(spark, small)
    got = {r.doc_id: r for r in queries.op5_lm_scores(spark, small).collect()}
    train = {i for i in texts if crc(i) % 7 != 2}
    count, total, pairs = Counter(), 0, Counter()
    for i in train:
        count.update([*words(texts[i]), None])
    total, distinct = sum(count.values()), len(count)
    base_sum = score_sum = 0.0
    for i, t in texts.items():
        own = [*words(t), None]
        base = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in own)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(own), sum(count[w] > 0 for w in own), total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        if r.held_out:
            base_sum, score_sum = base_sum + base, score_sum + r.score
    assert score_sum > base_sum  # the model beats the base on texts that it hasn't seen


def test_language_model_is_a_mixture(spark):
    """Scores by the formula, with weights learned anew by plain EM over the counts set apart."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(40)]
    chain = {w: rng.choice(vocabulary, 4) for w in vocabulary}
    texts = {}
    for i in range(600):
        w = str(rng.choice(vocabulary))
        out = []
        for _ in range(30):
            out.append(w)
            w = str(rng.choice(chain[w])) if rng.random() < 0.8 else str(rng.choice(vocabulary))
        texts[i] = " ".join(out)
    got = {r.doc_id: r for r in interpolation_lm.score(spark.createDataFrame(list(texts.items()), SCHEMA)).collect()}
    part = lambda i: 2 if crc(i) % 7 == 2 else 1 if crc(i) // 7 % 10 == 0 else 0
    uni, bi = [Counter(), Counter()], [Counter(), Counter()]
    for i, t in texts.items():
        if part(i) < 2:
            own = ["<s>", *words(t), None]
            uni[part(i)].update(own)
            bi[part(i)].update(zip(own, own[1:], strict=False))
    n_kept = sum(n for w, n in uni[0].items() if w != "<s>")
    both, both2 = uni[0] + uni[1], bi[0] + bi[1]
    n, v = sum(c for w, c in both.items() if w != "<s>"), len(both) - 1
    bucket = lambda c: 0 if not c else 1 + int(math.log2(c))
    weights = {b: np.array([0.4, 0.5, 0.1]) if b else np.array([0.0, 0.9, 0.1]) for b in range(40)}
    for _ in range(60):
        sums = {b: w.copy() for b, w in weights.items()}
        for (h, w), c in bi[1].items():
            b = bucket(uni[0][h])
            share = weights[b] * [bi[0][h, w] / max(uni[0][h], 1), uni[0][w] / n_kept, 1 / (v + 1)]
            sums[b] += c * share / share.sum()
        weights = {b: s / s.sum() for b, s in sums.items()}
    for i, t in texts.items():
        own = ["<s>", *words(t), None]
        want = sum(math.log10(weights[bucket(both[h])] @ [both2[h, w] / max(both[h], 1), both[w] / n, 1 / (v + 1)]) for h, w in zip(own, own[1:], strict=False))
        assert got[i].score == pytest.approx(want, rel=0.01)


def test_language_model_of_many_blocks(spark, monkeypatch):
    """Very long texts, cut over many blocks and shards, score as in one."""
    rng = np.random.default_rng(15)
    vocabulary = ["".join(rng.choice(list("abcdef"), 4)) for _ in range(300)]
    texts = {i: " ".join(rng.choice(vocabulary, n)) for i, n in enumerate([60_000, 10, 3000, 0, 1, 40_000, 200, 200])}
    docs = spark.createDataFrame(list(texts.items()), SCHEMA).repartition(3)
    whole = {r.doc_id: r for r in interpolation_lm.score(docs).collect()}
    monkeypatch.setattr(interpolation_lm, "BLOCK_BYTES", 4096)
    monkeypatch.setattr(interpolation_lm, "SHARD_TOKENS", 2000)
    for r in interpolation_lm.score(docs).collect():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (whole[r.doc_id].n_tokens, whole[r.doc_id].n_known, whole[r.doc_id].train_tokens)
        assert r.score == pytest.approx(whole[r.doc_id].score, rel=1e-9) and r.base_score == pytest.approx(whole[r.doc_id].base_score, rel=1e-9)


def test_language_model_odd_rows(spark):
    got = interpolation_lm.score(odd(spark)).collect()
    assert len(got) == len(ODD) and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert sorted(r.n_tokens for r in got) == sorted(len(words(t)) + 1 for _, t in ODD)
    assert interpolation_lm.score(odd(spark).limit(0)).count() == 0
    unseen = next(i for i in range(100) if crc(i) % 7 == 2)
    alone = interpolation_lm.score(spark.createDataFrame([(unseen, "nothing to learn from")], SCHEMA)).first()
    assert alone.held_out and alone.train_tokens == 0 and alone.n_known == 0 and alone.score == pytest.approx(0.0)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op6_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in common.table(spark, sf, "labels").collect()}
    assert len(got) == common.table(spark, sf, "documents").count()
    assert all(r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [(got[i].score, y) for i, y in labels.items() if got[i].held_out]
    toxic, clean = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in toxic for b in clean]) > 0.9
    assert np.mean([s < 0.3 for s in clean]) > 0.9


def test_toxicity_of_neutral_mentions(spark):
    """An identity term that mostly stands in toxic sentences gains no weight where the penalty holds."""
    rng = np.random.default_rng(6)
    filler = [f"plain{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(10)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        w = list(rng.choice(filler, 12))
        if toxic and rng.random() < 0.7:
            w += ["muslims"]
        if toxic:
            w += list(rng.choice(["idiots", "vermin", "scum"], 2))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    free, held = (toxicity.train(docs, marks, penalty=p) for p in (0.0, 10.0))
    mention = lambda m: m.linear(toxicity.features("the muslims met")) - m.linear(toxicity.features("the people met"))
    assert abs(mention(held)) < 0.5 * abs(mention(free))
    assert held.linear(toxicity.features("vermin scum idiots")) > held.linear(toxicity.features("muslims"))


def test_toxicity_fit_by_a_plain_solver():
    """The weights minimise the documented loss, and nothing else: dense gradient and value at the result."""
    rng = np.random.default_rng(13)
    size, n = 12, 80
    x = (rng.random((n, size)) < 0.3).astype(float)
    y = (rng.random(n) < 0.4).astype(int)
    swaps = [([0], [1], 3), ([2, 3], [4], 1), ([], [5], 2)]
    d = np.array([[(i in a) - (i in b) for i in range(size)] for a, b, _ in swaps], float)
    share = np.array([3, 1, 2]) / 6
    penalty, ridge = 0.5, 0.1

    def loss(w, b):
        z = x @ w + b
        return np.mean(np.log1p(np.exp(-np.where(y, z, -z)))) + ridge / 2 * w @ w / n + penalty * share @ (d @ w) ** 2

    w, b = np.zeros(size), 0.0
    for _ in range(60):  # Newton steps on the dense problem
        p = 1 / (1 + np.exp(-(x @ w + b)))
        full = np.column_stack((x, np.ones(n)))
        gradient = full.T @ (p - y) / n
        gradient[:size] += ridge / n * w + 2 * penalty * d.T @ (share * (d @ w))
        curve = full.T @ (full * (p * (1 - p))[:, None]) / n
        curve[:size, :size] += ridge / n * np.eye(size) + 2 * penalty * d.T @ (share[:, None] * d)
        step = np.linalg.solve(curve, gradient)
        w, b = w - step[:size], b - step[size]
    got, bias = toxicity.fit([(int(t), np.flatnonzero(r).tolist()) for t, r in zip(y, x, strict=True)], swaps, size, penalty, ridge, rounds=6000)
    assert loss(got, bias) == pytest.approx(loss(w, b), rel=1e-6)
    assert np.abs(got - w).max() < 0.05 and abs(bias - b) < 0.05


def test_toxicity_scores_by_definition(spark, small):
    """Features, counts, choice and scores of a small table against plain Python."""
    docs, texts = real(spark, small)
    labels = {r.doc_id: int(r.toxic > 0) for r in common.table(spark, small, "labels").collect()}
    marks = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    model = toxicity.train(docs, marks, sample_rows=None, most_features=None)
    rows = [(labels[i], toxicity.features(texts[i])) for i in labels if i in texts]
    totals, counts = Counter(y for y, _ in rows), [Counter(), Counter()]
    for y, found in rows:
        counts[y].update(found)
    chosen = set()
    for f in counts[0].keys() | counts[1].keys():
        n0, n1 = counts[0][f], counts[1][f]
        odds = math.log((n1 + 0.5) / (totals[1] - n1 + 0.5)) - math.log((n0 + 0.5) / (totals[0] - n0 + 0.5))
        if n0 + n1 >= toxicity.SUPPORT and abs(odds) / math.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5)) > 2 and abs(odds) > toxicity.LEAST_ODDS:
            chosen.add(f)
    assert set(model.weights) == chosen
    place = {f: k for k, f in enumerate(sorted(chosen))}
    swaps = Counter()
    for i in labels:
        for a, b in toxicity.counterfactuals(texts.get(i)):
            key = tuple(sorted(place[f] for f in a - b if f in place)), tuple(sorted(place[f] for f in b - a if f in place))
            swaps[key] += any(key)
    w, bias = toxicity.fit(sorted((y, sorted(place[f] for f in found if f in place)) for y, found in rows), sorted((list(a), list(b), n) for (a, b), n in swaps.items() if n), len(place), 1.0)
    for r in toxicity.score(docs, model, names=("p", "flag")).collect():
        z = bias + sum(w[place[f]] for f in toxicity.features(texts[r.doc_id]) if f in place)
        assert r.p == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9) and r.flag == int(r.p >= 0.3)


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (8, 1), (8, 0), (99, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    docs = odd(spark)
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    none = toxicity.train(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_a_half_filled_cache_is_asked_first(spark, tmp_path, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    cache = token_counts.DigestCache(spark, str(tmp_path / "cache"))
    rows = [(i, f"text number {i % 30} of the table") for i in range(90)] + [(None, "no id"), (None, None), (5, "text number 5 of the table"), (5, "another text of one id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    token_counts.count_tokens(docs.where("doc_id % 2 = 0"), cache, path).count()
    version = token_counts.version_of(path)
    before = cache.read(version).count()
    counter = token_counts.counter(path)
    for few in (token_counts.FEW, 0):  # broadcast, then dealt
        monkeypatch.setattr(token_counts, "FEW", few)
        got = sorted(((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(docs, cache, path).collect()), key=repr)
        assert got == sorted(((i, counter([t or ""])[0]) for i, t in rows), key=repr)
    assert before == 15 and cache.read(version).select("digest").distinct().count() == len({t or "" for _, t in rows})
    texts = docs.select(F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("digest"), F.coalesce("text", F.lit("")).alias("body"), F.col("doc_id").alias("id"))
    one = spark.createDataFrame([(bytearray(32), 1)], "digest binary, id long")
    plan = lambda n: token_counts.misses(texts, one, n)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.undo()
    assert "BroadcastHashJoin" in plan(1) and "hashpartitioning" not in plan(1)  # no text is dealt
    assert "ShuffledHashJoin" in plan(token_counts.FEW + 1)


@pytest.mark.parametrize("kind", ["int", "string", "decimal(12,0)"])
def test_language_model_keeps_the_ids_type(spark, kind):
    docs = spark.createDataFrame([(1, "a b a b"), (2, "a b"), (3, "b c")], "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    got = interpolation_lm.score(docs)
    assert got.schema["doc_id"].dataType == docs.schema["doc_id"].dataType and {str(r.doc_id) for r in got.collect()} == {"1", "2", "3"}
