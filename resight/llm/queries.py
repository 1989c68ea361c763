"""The registered queries of the training-data operators; each is thin over its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def table(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1_SQL = f"""
WITH l AS (SELECT doc_id, unnest(range(len(x))) AS k, unnest(x) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text <> '')),
w AS (SELECT doc_id, k, regexp_extract_all({LOWER_SQL}, '{WORD}') AS w FROM l),
g AS (
  SELECT DISTINCT doc_id, k, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), n AS (SELECT doc_id, k, count(*) AS n FROM g GROUP BY doc_id, k),
p AS (
  SELECT a.doc_id, a.k, b.doc_id AS d, b.k AS m, count(*) AS i FROM g a JOIN g b ON a.s = b.s AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.k < a.k)) GROUP BY ALL
), gone AS (
  SELECT DISTINCT p.doc_id, p.k FROM p JOIN n x ON x.doc_id = p.doc_id AND x.k = p.k JOIN n y ON y.doc_id = p.d AND y.k = p.m WHERE 100 * i >= 80 * (x.n + y.n - i)
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(gone.k) AS n_removed, COALESCE(string_agg(text, chr(10) ORDER BY l.k) FILTER (gone.k IS NULL), '') AS t
  FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.k = l.k GROUP BY l.doc_id
)
SELECT doc_id, COALESCE(n_lines, 0)::BIGINT AS n_lines, COALESCE(n_removed, 0)::BIGINT AS n_removed,
  length(COALESCE(t, text))::BIGINT AS n_chars_left, md5(COALESCE(t, text)) AS text_md5
FROM documents LEFT JOIN kept USING (doc_id)
"""

OP2_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
sides AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.b FROM reach r JOIN sides l ON r.other = l.a),
c AS (SELECT id, min(other) AS c FROM reach GROUP BY id)
SELECT d.doc_id, COALESCE(n.n, 0)::BIGINT AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.id = d.doc_id
"""

OP5_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, '{WORD}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({LOWER_SQL}, '{WORD}') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda p: array_to_string(w[p:p + n - 1], ' '))) AS s
  FROM (SELECT *, least(len(w), 10) AS n FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM g),
spot AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS p, unnest(list_transform(range(1, len(w) - n + 2), lambda p: array_to_string(w[p:p + n - 1], ' '))) AS s
  FROM d JOIN sizes ON len(w) >= n),
hit AS (SELECT doc_id, p, n, item_id FROM spot JOIN g USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, COALESCE(n_hit, 0)::BIGINT AS n_hit, COALESCE(n_items, 0)::BIGINT AS n_items,
  sha256(COALESCE(s, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN names USING (doc_id)
"""


@query("op2_minhash_near_dedup", OP2_SQL)
def op2(spark, d):
    from resight.llm.near_dedup import near_duplicates

    out = near_duplicates(table(spark, d, "documents"), shingle=3, num=85, den=100)
    return out.withColumnRenamed("id", "doc_id")



@query("op5_benchmark_decontamination", OP5_SQL)
def op5(spark, d):
    from resight.llm.decontaminate import contaminated

    out = contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"), window=10)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


@query("op6_toxicity")
def op6(spark, d):
    from resight.llm.toxicity import toxicity

    return toxicity(table(spark, d, "documents"), table(spark, d, "labels")).withColumnRenamed("id", "doc_id")


@query("op1_line_dedup", OP1_SQL)
def op1(spark, d):
    from resight.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, d, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("op3_sentencepiece")
def op3(spark, d):
    """Ids of every text, and whether decoding them gives it back."""
    import public_tokenizers

    from resight.llm.sentencepiece import round_trip

    out = round_trip(table(spark, d, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"),
        F.length("decoded").cast("long").alias("n_chars"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


@query("pipeline")
def pipeline(spark, d):
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
"""


@query("op8_exact_top_k", OP8_SQL)
def op8(spark, d):
    from resight.llm.topk import exact_top_k

    return exact_top_k(table(spark, d, "embeddings"), every=50, k=5, scale=256)


@query("op10_token_store")
def op10(spark, d):
    import public_tokenizers

    from resight.llm.token_store import token_index, write_tokens
    from resight.session import new_folder

    folder = new_folder(spark, "tokens")
    write_tokens(table(spark, d, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_index(spark, folder)


@query("op9_lm_scoring")
def op9(spark, d):
    from resight.llm.kneser_ney import lm_scores

    return lm_scores(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


@query("op4_html_extraction")
def op4(spark, d):
    from resight.llm.html_text import extract

    return extract(table(spark, d, "pages"))


@query("op7_substring_dedup")
def op7(spark, d):
    from resight.llm.substring_dedup import repeated_passages

    out = repeated_passages(table(spark, d, "documents"))
    return out.select(F.col("id").alias("doc_id"), "start", "end", F.col("partner").alias("partner_id"), "partner_start", "partner_end")


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    CAST(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""


@query("op13_hard_negatives", OP13_SQL)
def op13(spark, d):
    from resight.llm.hard_negatives import hard_negatives

    df = table(spark, d, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(df.withColumn("label", label), every=100, positives=5, k=10, low=30, high=90, scale=256)


OP12_SQL = f"""
WITH p AS (SELECT COALESCE(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER_SQL}, '[.,;:!?\\x0A-\\x0D]')) AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(t, '[^\\x20\\x09]+') AS w FROM p),
o AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) AS t(m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS f FROM o GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, count(*) AS n FROM o WHERE m = 1 GROUP BY lang),
longer AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, f, array_to_string(string_split(phrase, ' ')[1:2], ' ') AS phrase FROM f WHERE m = 3
    UNION ALL SELECT lang, f, array_to_string(string_split(phrase, ' ')[2:3], ' ') FROM f WHERE m = 3) GROUP BY ALL
), c AS (
  SELECT c.lang, c.phrase, c.f AS a, c.m, unnest(range(1, c.m)) AS k FROM f c LEFT JOIN longer x ON c.m = 2 AND x.lang = c.lang AND x.phrase = c.phrase
  WHERE c.m > 1 AND (x.f IS NULL OR 100 * x.f < 50 * c.f)
), s AS (
  SELECT c.lang, c.phrase, a, k, l.f AS l, r.f AS r, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(string_split(c.phrase, ' ')[1:k], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(string_split(c.phrase, ' ')[k + 1:c.m], ' ')
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM s JOIN n USING (lang) QUALIFY rank <= 2000
"""


@query("op12_phrase_collocations", OP12_SQL)
def op12(spark, d):
    from resight.llm.collocations import collocations

    return collocations(table(spark, d, "documents"), max_words=3, least=10, first=2000)


OP11_SQL = OP2_SQL.replace("85 *", "90 *").replace(", d.doc_id = c.c AS kept", "")


@query("op11_ngram_join", OP11_SQL)
def op11(spark, d):
    from resight.llm.ngram_join import ngram_components

    return ngram_components(table(spark, d, "documents"), shingle=3, num=90, den=100).withColumnRenamed("id", "doc_id")
