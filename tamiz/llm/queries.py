"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tamiz.llm import ann, chat, decontaminate, langid, licenses, neardup, packing, quality, resample, tokenfile, warc, webpages, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


HARD_TEXT = r"\### Assistant: </turn> ok"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame(
        [(-7, 0, "user", HARD_TEXT), (-7, 1, "assistant", HARD_TEXT)], "conv_id long, turn long, role string, text string"
    )
    return chat.conversation_digests(chat.format_conversations(turns.unionByName(hard)))


OP1_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *,
    length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS text_len,
    length(replace(replace(role, '\', '\\'), '<|', '<\|')) AS role_len,
    lag(role) OVER w AS p FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  -- a block has three marks of 8, 8 and 8 characters; a text joined to it has one of 8 before it
  sum(text_len + 8 + CASE WHEN p = role THEN 0 ELSE role_len + 16 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, list_slice(w, s + 1, s + 10) AS win FROM (
    SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(win) AS l FROM iw),
dw AS (SELECT doc_id, s, l, list_slice(w, s + 1, s + l) AS win FROM (
    SELECT doc_id, w, l, unnest(range(0, greatest(len(w) - l + 1, 0))) AS s FROM d, lens)),
m AS (SELECT DISTINCT dw.doc_id, dw.s, dw.l, iw.item_id FROM dw JOIN iw USING (win)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
    FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return licenses.scan_licences(documents, licenses.fit_licences(documents))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op10_token_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = tokenfile.round_trip(table(spark, sf_dir, "documents"))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = webpages.extract_main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def fold(document, folds: int):
    """crc32 of the document id as text, modulo the number of folds."""
    return F.crc32(document.cast("string")) % folds


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link_documents(table(spark, sf_dir, "documents"), percent=85)


OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i + 1, i + 5) AS sh FROM (
    SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 4, 1) END)) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached(doc_id, r) AS (SELECT doc_id, doc_id FROM documents
    UNION SELECT reached.doc_id, y FROM reached JOIN edges ON r = x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(r) AS component_id, min(r) = doc_id AS kept
FROM reached LEFT JOIN n USING (doc_id) GROUP BY doc_id, n
"""


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    # A null id has no remainder: its row is not held out, and not learned from.
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    languages = langid.fit_languages(documents, where=fold(F.col("doc_id"), 4) != 2)
    found = langid.identify(documents.select("doc_id", "text"), languages)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op8_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    machine = quality.fit_quality(documents, table(spark, sf_dir, "labels"), learn=lambda d: fold(d, 5) != 0)
    scored = quality.score_quality(documents.select("doc_id", "text"), machine)
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP11_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
t AS (SELECT *, strlen(h) AS n, max(page_id) OVER (PARTITION BY h) AS top,
  row_number() OVER (PARTITION BY h, page_id) AS copy FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN n < 1000 OR (page_id = top AND copy = 1) THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n < 1000 OR (page_id = top AND copy = 1) THEN NULL ELSE top END AS refers_to
FROM t
"""


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# crc32 by a table of 256 entries, made by eight shifts of each byte.
OP12_SQL = r"""
WITH RECURSIVE shifts(b, k, v) AS (
  SELECT range, 0, range::UBIGINT FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END FROM shifts WHERE k < 8),
tbl AS (SELECT list(v ORDER BY b) AS t FROM shifts WHERE k = 8),
w AS (SELECT 0 AS target, doc_id AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM documents
  UNION ALL SELECT 1, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
c AS (SELECT target, id, f, count(*) AS n FROM w GROUP BY ALL),
vocabulary AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM c)),
hashed AS (SELECT f, xor(list_reduce(list_transform(range(1, length(h), 2), lambda i: ('0x' || h[i:i + 1])::UBIGINT),
    lambda a, b: xor(a >> 8, t[((xor(a, b) & 255) + 1)::BIGINT]), 4294967295::UBIGINT), 4294967295::UBIGINT) % 10000 AS bucket
  FROM vocabulary, tbl),
per AS (SELECT bucket, sum(n) FILTER (target = 0) AS s, sum(n) FILTER (target = 1) AS t FROM c JOIN hashed USING (f) GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0)::DOUBLE AS ss, coalesce(sum(t), 0)::DOUBLE AS tt FROM per),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (ss + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (tt + 10000))))::BIGINT AS g
  FROM per, sums),
weights AS (SELECT id, sum(n)::BIGINT AS n, sum(n * g)::BIGINT AS weight FROM c JOIN hashed USING (f) JOIN gains USING (bucket)
  WHERE target = 0 GROUP BY id),
scored AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT::DOUBLE + 0.5) / 4294967296))))::BIGINT AS score
  FROM documents LEFT JOIN weights ON id = doc_id),
ranked AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS r FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN r <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20) THEN r END::BIGINT AS rank
FROM ranked
"""


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_license_scans": op2_license_scans,
    "op3_packing": op3_packing,
    "op4_html_extraction": op4_html_extraction,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_language_id": op7_language_id,
    "op8_approximate_nearest_neighbours": op8_approximate_nearest_neighbours,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_token_binary_output": op10_token_binary_output,
    "op11_warc": op11_warc,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLE = {
    "op1_chat_formatting": OP1_SQL,
    "op5_benchmark_decontamination": OP5_SQL,
    "op6_minhash_near_dedup": OP6_SQL,
    "op11_warc": OP11_SQL,
    "op12_importance_resampling": OP12_SQL,
}
