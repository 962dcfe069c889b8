"""The registered queries of this subpackage, thin covers over its operators, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, langid, license_scan, packing, phrases, quality, simhash, token_arrow, token_links, toxicity, warc
from .common import id_bucket, table


def op1_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", license_scan.scan_column(docs).alias("s"))
    return found.select("doc_id", "s.n_words", "s.n_base", "s.first_word", "s.last_word", "s.base_labels", "s.labels", "s.score")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, id_bucket("doc_id", 5) != 0)
    scored = docs.select("doc_id", (id_bucket("doc_id", 5) == 0).alias("held_out"), quality.score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, id_bucket("doc_id", 3) != 1)
    found = docs.select("doc_id", (id_bucket("doc_id", 3) == 1).alias("held_out"), langid.identify(docs, model).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, id_bucket("doc_id", 4) != 2)
    scored = docs.select("doc_id", (id_bucket("doc_id", 4) == 2).alias("held_out"), toxicity.score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kinds, role = dict(rows.dtypes), F.when(F.col("id") == 0, "user").otherwise("assistant")
    said = spark.range(2).select(F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"), role.alias("role"), F.lit(r"\### Assistant: </turn> ok").alias("text"))
    rows = rows.unionByName(said)
    return chat.digests(chat.read_back(chat.format_conversations(rows)))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_arrow.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0, size=2048)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_links.token_links(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.group_texts(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (
  SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""


OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < keeper THEN keeper END AS refers_to
FROM q
"""


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, list_filter(list_transform(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]'), lambda s: list_filter(regexp_split_to_array(s, '[ \t]+'), lambda w: w <> '')), lambda x: len(x) > 0) AS pieces FROM documents
), q AS (SELECT lang, unnest(pieces) AS ws FROM p),
s AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM q),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS gram, count(*) AS n FROM s, range(1, 6) t(k) WHERE i + k - 1 <= len(ws) GROUP BY ALL),
w AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, CAST(k AS INTEGER) AS k, gram, n, string_split(gram, ' ') AS ws FROM g WHERE n >= 100),
inside AS (SELECT DISTINCT lang, array_to_string(ws[i:i + m - 1], ' ') AS gram, n FROM (SELECT f.*, m, unnest(range(1, k - m + 2)) AS i FROM f, range(2, 5) t(m) WHERE m < k)),
c AS (SELECT f.* FROM f ANTI JOIN inside b ON f.lang = b.lang AND f.gram = b.gram AND b.n >= f.n WHERE k > 1),
d AS (SELECT lang, gram, n AS a, j, array_to_string(ws[:j], ' ') AS x, array_to_string(ws[j + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
e AS (SELECT d.lang, d.gram, a, j, l.n AS l, r.n AS r, w.n, CAST((1000::HUGEINT * a * w.n) // (l.n::HUGEINT * r.n) AS BIGINT) AS score FROM d JOIN f l ON l.lang = d.lang AND l.gram = x JOIN f r ON r.lang = d.lang AND r.gram = y JOIN w ON w.lang = d.lang),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, gram) AS rank, gram AS phrase, a, l, r, n, score FROM b QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, gram) <= 2000
"""


OP7_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *,
    row_number() OVER w - 1 AS k, lag(role, 1, '<start>') OVER w AS state, lead(role) OVER w IS NULL AS is_last,
    length(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ':' || chr(10), '\n'))
    + length(replace(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t'), ':' || chr(10), '\n')) + 13 AS chars
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), s AS (
  SELECT *, (state || '>' || role) IN ('<start>>system', '<start>>user', 'system>user', 'user>assistant', 'assistant>user', 'assistant>tool', 'tool>assistant') AS good FROM e
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  bool_and(good) AND bool_or(is_last AND role = 'assistant') AS valid,
  min(CASE WHEN NOT good THEN k END) AS first_bad
FROM s GROUP BY conv_id
"""


def queries() -> dict:
    return {"op1_license": op1_license, "op4_decontaminate": op4_decontaminate, "op2_quality": op2_quality, "op3_language": op3_language, "op7_chat": op7_chat, "op10_toxicity": op10_toxicity, "op5_simhash": op5_simhash, "op6_token_arrow": op6_token_arrow, "op9_packing": op9_packing, "op8_exact_dedup": op8_exact_dedup, "op11_warc": op11_warc, "op12_phrases": op12_phrases, "op13_token_links": op13_token_links}


def oracle_sql() -> dict:
    return {"op7_chat": OP7_SQL, "op8_exact_dedup": OP8_SQL, "op11_warc": OP11_SQL, "op12_phrases": OP12_SQL}
