"""The registered queries of the training-data operators and the SQL that some of them can be checked with."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import byte_bpe, chat, class_lm, fingerprint, hard_negatives, html_text, minhash, mixing, packing, periodic_runs, quality_classifier, quality_rules, token_output
from graphloom.llm.common import crc_mod, materialize, table


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and verdict of every document."""
    judged = quality_rules.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; rows whose id has remainder 1 teach nothing."""
    docs = table(spark, sf_dir, "documents")
    weights = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 3) != 1)
    scored = quality_classifier.score_documents(docs, weights)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likenesses."""
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract_pages(table(spark, sf_dir, "pages"), html_text.train())


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group of every document."""
    grouped = minhash.group_rows(table(spark, sf_dir, "documents"))
    return grouped.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


#: End id of op1's documents.
END_ID = 2


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from the packed chunks."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        model = f.read()
    chunks = materialize(token_output.write_tokens(table(spark, sf_dir, "documents"), model, END_ID), "tokens")
    return token_output.read_documents(chunks)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes decoded from them."""
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        vocabulary = f.read()
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document in the mix, counted in its texts, and the training time of its first draw."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    plan = materialize(mixing.plan_mix(docs), "plan")
    mix = mixing.mix_documents(docs, plan, "draw")
    found = mix.select("draw.*", mixing.size_of(F.col("text")).alias("words")).groupBy("place", "copy").agg(F.sum("words").alias("taken"), F.min("position").alias("position"))
    plan = plan.withColumn("place", mixing.place(F.col("doc_id"), F.col("text_key"))).join(found, ["place", "copy"], "left")
    return plan.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.round("position", 6).alias("first_position"))


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base and class-model score of every document; rows whose id has remainder 2 teach nothing."""
    docs = table(spark, sf_dir, "documents")
    rest = crc_mod(F.col("doc_id"), 7)
    scored = class_lm.score_documents(docs, class_lm.fit(docs, rest != 2))
    return scored.select("doc_id", (rest == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation and of one that quotes control strings, read back from the formatted output, and the role machine's verdict."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    quoting = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    segments = materialize(chat.format_turns(turns.unionByName(quoting)), "formatted")
    return chat.digest(segments)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive; a seventh of the rows is relabelled."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"), (F.col("vec_id") % 100 == 0).alias("anchor")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, every tenth of which repeats its tail."""
    return periodic_runs.digest(periodic_runs.find_runs(table(spark, sf_dir, "documents"), periodic_runs.repeat_tail))


#: End id of op13's documents.
PACK_END_ID = 1


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and the sequences they are packed into, with checksums of their ids."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        model = f.read()
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), model, PACK_END_ID)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op1_token_output": op1_token_output, "op2_byte_bpe": op2_byte_bpe, "op3_mixing": op3_mixing, "op8_class_lm": op8_class_lm, "op9_chat": op9_chat, "op5_fingerprint": op5_fingerprint, "op6_html_text": op6_html_text, "op7_minhash": op7_minhash, "op4_quality_classifier": op4_quality_classifier, "op10_quality_rules": op10_quality_rules, "op11_hard_negatives": op11_hard_negatives, "op12_periodic_runs": op12_periodic_runs, "op13_packing": op13_packing}
#: Words of the texts as the SQL checks take them: runs without ASCII white space.
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op11_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, n.vec_id AS id, a.label = n.label AS same, CAST(list_dot_product(a.q, n.q) AS BIGINT) AS score
  FROM v a JOIN v n ON a.vec_id <> n.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score QUALIFY rank <= 5""",
    "op7_minhash": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = s.doc_id""",
    "op3_mixing": f"""
WITH d AS (
  SELECT doc_id, source, CAST(len({_WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size,
    CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix'), 1, 12)) AS BIGINT) AS at FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind FROM d GROUP BY source),
w AS (SELECT *, CASE kind WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s),
o AS (
  SELECT *, cap / weight AS ratio, sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below,
    sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w),
v AS (SELECT min_by((budget - coalesce(below, 0)) / open, ratio) AS level FROM o WHERE (budget - coalesce(below, 0)) / open < ratio),
t AS (SELECT w.*, least(cap, weight * coalesce((SELECT level FROM v), 0)) AS target FROM w),
c AS (
  SELECT d.*, t.source_size, t.kind, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS goal,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.at, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, greatest(least(size, goal - before), 0) AS first, greatest(least(size, goal - source_size - before), 0) AS second FROM c),
y AS (SELECT *, (before + first / 2.0::DOUBLE) / greatest(goal, 1) AS share FROM p)
SELECT doc_id, size, source_size, target, first + second AS taken,
  CASE WHEN first > 0 THEN round(CASE kind WHEN 0 THEN 2 * share / (1.5::DOUBLE + sqrt(2.25::DOUBLE - 2 * share)) WHEN 1 THEN share
    ELSE 2 * share / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2 * share)) END, 6) END AS first_position FROM y""",
    "op9_chat": """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
    + list_sum(list_transform(['[INST]', '[/INST]', '<<SYS>>', '<</SYS>>', '</s>', '[ROLE]', '[/ROLE]'], lambda x: (length(text) - length(replace(text, x, ''))) // length(x)))
    + list_sum(list_transform(range(1, 8), lambda k: CASE WHEN length(text) >= k AND list_contains(['[', '[I', '[IN', '[INS', '[INST', '[/', '[/I', '[/IN', '[/INS', '[/INST', '<', '<<', '<<S', '<<SY', '<<SYS', '<<SYS>',
      '<</', '<</S', '<</SY', '<</SYS', '<</SYS>', '</', '</s', '[R', '[RO', '[ROL', '[ROLE', '[/R', '[/RO', '[/ROL', '[/ROLE'], right(text, k)) THEN 1 ELSE 0 END))
    + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 15 WHEN 'assistant' THEN 4 ELSE 17 + length(role) END AS chars,
    coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text), '') || '>' || role AS step FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  bool_and(step IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user')) AS valid
FROM m GROUP BY conv_id""",
}
