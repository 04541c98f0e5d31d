"""What this folder registers: a query for each operator, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, collocations, common, interpolation_lm, line_dedup, mixing, simhash, token_counts, toxicity, vector_codes, warc, winnowing


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(common.table(spark, sf_dir, "documents"), factor=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = token_counts.DigestCache(spark, common.new_folder(spark, "token-cache"))
    path = public_tokenizers.path
    counted = token_counts.count_tokens(common.table(spark, sf_dir, "documents"), cache, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return encoded.select("doc_id", "n_tokens", F.sha2("ids_le32", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation_lm.score(common.table(spark, sf_dir, "documents"), folds=7, unseen=2)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = common.crc_fold("doc_id", 4) == 2
    model = toxicity.train(docs.where(~held_out), common.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, threshold=0.3).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edited_and_next(common.table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.round_trip(common.table(spark, sf_dir, "pages"), common.new_folder(spark, "archives"), least_bytes=100)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(common.table(spark, sf_dir, "documents"), width=4, threshold=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_and_render(common.table(spark, sf_dir, "conversations"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, coded = vector_codes.compress(common.table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", "codebooks_sha256")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(common.table(spark, sf_dir, "documents"), least=30, most=4, share=80, page=2000)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.deduplicate(common.table(spark, sf_dir, "documents"), least_chars=20, least_docs=3)
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixing, op2_token_counts, op3_nearest_neighbours, op4_bpe, op5_lm_scores, op6_toxicity, op7_winnowing, op8_warc, op9_simhash, op10_chat_formatting, op11_vector_codes, op12_collocations, op13_line_dedup)
}



def codes_sql(rounds: int) -> str:
    """Product quantisation with each round spelled out."""
    steps = ["book0 AS (SELECT p, j, x, e FROM (SELECT p, j, x, dense_rank() OVER (ORDER BY vec_id) - 1 AS e FROM comp) WHERE e < 64)"]
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS (SELECT vec_id, p, e, d FROM (SELECT vec_id, p, e, d, row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) AS n
            FROM (SELECT vec_id, c.p, e, sum((c.x - b.x) * (c.x - b.x)) AS d FROM comp c JOIN book{r} b ON b.p = c.p AND b.j = c.j GROUP BY vec_id, c.p, e)) WHERE n = 1)""")
        if r < rounds:
            steps.append(f"""book{r + 1} AS (SELECT b.p, b.j, b.e, coalesce(m.x, b.x) AS x FROM book{r} b
            LEFT JOIN (SELECT p, j, e, floor(sum(x) / count(*))::BIGINT AS x FROM comp JOIN near{r} USING (vec_id, p) GROUP BY p, j, e) m USING (p, j, e))""")
    return f"""
        WITH kept AS (SELECT vec_id, label, embedding AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        flat AS (SELECT vec_id, len(v) // 16 AS w, unnest(v) AS y, generate_subscripts(v, 1) - 1 AS i FROM kept),
        comp AS (SELECT vec_id, i // w AS p, i % w AS j, floor(256 * y::DOUBLE)::BIGINT AS x FROM flat),
        {", ".join(steps)},
        coded AS (SELECT vec_id, string_agg(printf('%02x', e::INT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, j)) FROM book{rounds}) AS codebooks_sha256
        FROM coded JOIN kept USING (vec_id)"""


ORACLE_SQL: dict[str, str] = {
    "op11_vector_codes": codes_sql(2),
    "op12_collocations": """
        WITH low AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM low),
        ws AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w, count(*) AS m FROM pieces GROUP BY 1, 2),
        tok AS (SELECT id, lang, m, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT row_number() OVER () AS id, * FROM ws)),
        runs AS (SELECT lang, m, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM tok WINDOW o AS (PARTITION BY id ORDER BY i)),
        grams AS (SELECT lang, 1 AS k, w AS phrase, m FROM runs UNION ALL SELECT lang, 2, w || ' ' || w2, m FROM runs WHERE w2 IS NOT NULL
                  UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3, m FROM runs WHERE w3 IS NOT NULL UNION ALL SELECT lang, 4, w || ' ' || w2 || ' ' || w3 || ' ' || w4, m FROM runs WHERE w4 IS NOT NULL),
        f AS (SELECT lang, k, phrase, lang || chr(9) || phrase AS place, sum(m)::BIGINT AS f FROM grams GROUP BY 1, 2, 3),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT lang, phrase, f AS a, k, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
        cuts AS (SELECT lang, phrase, a, i, lang || chr(9) || array_to_string(w[:i], ' ') AS lp, lang || chr(9) || array_to_string(w[i + 1:], ' ') AS rp FROM c, range(1, 4) t(i) WHERE i < k),
        s AS (SELECT cuts.lang, cuts.phrase, a, i, x.f AS l, y.f AS r, (2000000 * a::HUGEINT // (x.f + y.f))::BIGINT AS score
              FROM cuts JOIN f x ON x.place = lp JOIN f y ON y.place = rp),
        low_cut AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
        inside AS (SELECT DISTINCT c.lang, array_to_string(c.w[i:i + j - 1], ' ') AS phrase, c.a AS longer FROM c, range(2, 4) t(j), range(1, 4) u(i) WHERE j < c.k AND i + j - 1 <= c.k),
        gone AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN inside USING (lang, phrase) WHERE 100 * longer::HUGEINT >= 80 * c.a::HUGEINT)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM low_cut JOIN n USING (lang) WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.lang = low_cut.lang AND gone.phrase = low_cut.phrase)
        QUALIFY rank <= 2000""",
    "op13_line_dedup": """
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
        k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        d AS (SELECT k.*, coalesce(k.doc_id <> c.last, false) AS gone FROM k LEFT JOIN c USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM d GROUP BY doc_id""",
    "op8_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first_id IS NOT NULL AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first_id <> page_id THEN first_id END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)""",
    "op10_chat_formatting": """
        WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM conversations),
        c AS (SELECT conv_id, list(struct_pack(r := r, x := x) ORDER BY pos) AS l, count(*) AS n FROM t GROUP BY conv_id),
        g AS (SELECT l, n, min(conv_id) AS conv_id, count(*) AS n_snapshots FROM c GROUP BY l, n)
        SELECT conv_id, n AS n_turns, n_snapshots, list_aggregate(list_transform(l, lambda s: '<|' || s.r || '|>' || chr(10) || s.x || chr(10)), 'string_agg', '') AS rendered
        FROM g WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.n > g.n AND c.l[1:g.n] = g.l)""",
}
