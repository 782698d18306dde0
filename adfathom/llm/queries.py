"""The queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline


#: Where Python workers of a local session find this package; an installed one is found anyway.
ROOT = str(Path(__file__).resolve().parents[2])


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op7_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from adfathom.llm.near_dups import near_duplicates

    found = near_duplicates(_table(spark, folder, "documents"), words=4)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    from adfathom.llm.decontaminate import contaminated

    return contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op9_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    from adfathom.llm.topk import top_k

    rows = _table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = top_k(rows, rows.where("id % 100 = 0"))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from adfathom.llm.substrings import dedup_report

    found = dedup_report(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("spans").alias("n_spans"))


def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from adfathom.llm.shared import Scratch
    from adfathom.llm.token_files import read_tokens, write_tokens

    target = f"{Scratch(spark, 'tokens').folder}/files"
    write_tokens(_table(spark, folder, "documents"), target, public_tokenizers.path("byte_bpe_50k.json"), end=2)
    return read_tokens(spark, target, digest=True)


def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every whole text and a digest of the text that they decode to."""
    import public_tokenizers

    from adfathom.llm.pieces import decode_documents, encode_documents

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    rows = decode_documents(encode_documents(docs, path, digest=True), path)
    rows = rows.withColumn("decoded_sha256", F.sha2(F.col("decoded").cast("binary"), 256))
    rows = rows.withColumn("exact", F.col("decoded") == F.coalesce("text", F.lit("")))
    return rows.select("doc_id", "n_ids", "ids_crc32", "decoded_sha256", "exact")


def op3_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    from adfathom.llm.chat import chat_digests, format_conversations
    from adfathom.llm.shared import Scratch

    said = "</s>[INST] ok [/INST]"
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    output = Scratch(spark, "chat").keep(format_conversations(rows.union(more)), "formatted")
    return chat_digests(output)


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from adfathom.llm.repeats import dedup_bytes

    found = dedup_bytes(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op5_quality_crf(spark: SparkSession, folder: str) -> DataFrame:
    from adfathom.llm.quality import fit, score_quality, training_rows

    docs = _table(spark, folder, "documents")
    model = fit(training_rows(docs, _table(spark, folder, "labels")))
    found = score_quality(docs.select("doc_id", "text"), model)
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    from adfathom.llm.languages import fit, identify, training_rows

    docs = _table(spark, folder, "documents")
    model = fit(training_rows(docs))
    found = identify(docs.select("doc_id", "text"), model)
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    from adfathom.llm.lexical import rank_documents

    return rank_documents(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op12_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from adfathom.llm.byte_bpe import decode_documents, decoded_digests, encode_documents

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return decoded_digests(decode_documents(encode_documents(docs, path, digest=True), path))


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    from adfathom.llm.filter_audit import interactions

    return interactions(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_chat_format": op3_chat_format,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_quality_crf": op5_quality_crf,
    "op6_language_id": op6_language_id,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_lexical_search": op11_lexical_search,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_filter_audit": op13_filter_audit,
    "pipeline": corpus_pipeline.run,
}

TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

SUBSTRING_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)),
low AS (SELECT win, min(doc_id) AS low FROM starts GROUP BY win HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT s.doc_id, unnest(range(s.i, s.i + 50)) AS j
  FROM starts s JOIN low USING (win) WHERE s.doc_id > low.low),
runs AS (SELECT doc_id, count(*) AS n_removed, list(j) AS js,
                sum(CASE WHEN first THEN 1 ELSE 0 END) AS n_spans
         FROM (SELECT doc_id, j, lag(j) OVER (PARTITION BY doc_id ORDER BY j) IS DISTINCT FROM j - 1 AS first FROM gone)
         GROUP BY doc_id),
kept AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY k) AS text
  FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM w) w
  ANTI JOIN gone ON gone.doc_id = w.doc_id AND gone.j = w.k
  GROUP BY w.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256, CAST(coalesce(n_spans, 0) AS INTEGER) AS n_spans
FROM w LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
pieces AS (
  SELECT *, '<|turn|>' || regexp_replace(replace(role, '\', '\\'), '([<\[])(\||s>|/s>|INST\]|/INST\])', '\1\\\2', 'g')
         || '<|text|>' || regexp_replace(replace(text, '\', '\\'), '([<\[])(\||s>|/s>|INST\]|/INST\])', '\1\\\2', 'g')
         || '<|end|>' || chr(10) AS piece FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, piece)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, piece), '')) AS loss_sha256,
       CAST(sum(length(piece)) AS BIGINT) AS formatted_chars
FROM pieces GROUP BY conv_id
"""

SEARCH_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
q AS (
  SELECT item_id, unnest(list_distinct(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
s AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM d WHERE len(terms) > 0),
tf AS (SELECT doc_id, any_value(n) AS n, term, count(*) AS tf
       FROM (SELECT doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM d) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
scored AS (
  SELECT item_id, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""

AUDIT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (
  SELECT d.doc_id, part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic,
         [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words),
          100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
          regexp_matches(text, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY text)] AS fails
  FROM d LEFT JOIN labels USING (doc_id)),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
sets AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic
         FROM f GROUP BY part, fails),
placed AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS own, n, n_good, n_toxic,
         fails[instr('ABCDE', substr(filter_order, step, 1))] AS hit,
         len(list_filter(range(1, step), lambda i: fails[instr('ABCDE', substr(filter_order, i, 1))])) > 0 AS gone,
         len(list_filter(fails, lambda x: x)) AS fails_all
  FROM sets, o, (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed,
         coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant, coalesce(sum(n) FILTER (hit AND fails_all = 1), 0) AS unique_fails,
         coalesce(sum(n_good) FILTER (hit AND NOT gone), 0) AS good_lost,
         coalesce(sum(n_toxic) FILTER (hit AND NOT gone), 0) AS toxic_lost
  FROM placed GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""

ORACLES: dict[str, str] = {
    "op3_chat_format": CHAT_SQL,
    "op9_exact_top_k": TOP_K_SQL,
    "op10_substring_dedup": SUBSTRING_SQL,
    "op11_lexical_search": SEARCH_SQL,
    "op13_filter_audit": AUDIT_SQL,
}
