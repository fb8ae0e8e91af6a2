"""The operators over the given tables with production parameters, as the driver runs them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import conversations, decontam, langid, licenses, lm, media, mixing, neardup, substrings, tokens, toxicity, urls, whiten
from pagewright.llm.blocks import read


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = media.media_features(media.text_images(docs))
    return rows.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        *[f"features.{c}" for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")],
        F.sha2("features.tile", 256).alias("tile_sha256"),
    )


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs).select("doc_id", "found.*")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, urls.rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = """
WITH rules(verdict, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages)
SELECT page_id, host, path,
  (SELECT arg_max(r.host || r.path, length(r.host || r.path)) FROM rules r WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS rule,
  coalesce((SELECT arg_max(r.verdict, length(r.host || r.path)) FROM rules r WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)), 'allow') AS verdict
FROM parts p
"""


def remainder(n: int) -> Column:
    """crc32 of doc_id as text, modulo n; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "text", "lang")
    return langid.identify(docs, ~F.col("held_out")).select("doc_id", "held_out", "lang_pred", "score")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_leaks(docs, read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "shards")


def _op6_sql(seed: int = 7, blocks: int = mixing.BLOCKS, levels: int = mixing.LEVELS) -> str:
    tree = ", ".join(
        f"""tree{i + 1} AS (SELECT source_key, number, shard * 2 + (row_number() OVER (PARTITION BY shard ORDER BY ('0x' || md5('{seed}-{i}:' || source_key || ':' || number)[1:8])::BIGINT % {mixing.BINS}, md5('{seed}-{i}:' || source_key || ':' || number), source_key, number) * 2 > count(*) OVER (PARTITION BY shard) + 1)::INT AS shard FROM tree{i})"""
        for i in range(levels)
    )
    return rf"""
WITH keyed AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '')) AS key, coalesce('=' || source, '') AS source_key
  FROM documents),
slim AS (SELECT *, ('0x' || key[1:8])::BIGINT % {blocks} AS block FROM keyed),
sizes AS (SELECT source_key, source, sum(size)::BIGINT AS source_size FROM slim GROUP BY ALL),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sizes),
ranked AS (
  SELECT *, row_number() OVER o AS place,
    (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS share
  FROM weighed WINDOW o AS (ORDER BY source_size * 3 / weight, source NULLS LAST)),
shared AS (SELECT (SELECT share FROM ranked WHERE source_size * 3 / weight >= share ORDER BY place LIMIT 1) AS share),
goals AS (SELECT source_key, source_size, least((source_size * 3)::DOUBLE, shared.share * weight) AS target FROM ranked, shared),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS times,
    CASE WHEN source_size > 0 THEN round(target)::BIGINT % source_size ELSE 0 END AS rest
  FROM goals),
by_block AS (SELECT source_key, block, sum(size)::BIGINT AS block_size FROM slim GROUP BY ALL),
drawn AS (
  SELECT source_key, block, source_size, target, times,
    greatest(0, rest - coalesce(sum(block_size) OVER (PARTITION BY source_key ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rest
  FROM by_block JOIN plan USING (source_key)),
draws AS (SELECT source_key, block, unnest(range(1, 1 + times + (rest > 0)::INT)) AS draw FROM drawn),
placed AS (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY md5('{seed}:' || source_key || ':' || block || ':' || draw), block, draw) AS number FROM draws),
tree0 AS (SELECT source_key, number, 0 AS shard FROM placed),
{tree},
quotas AS (SELECT source_key, shard, count(*) AS quota FROM tree{levels} GROUP BY ALL),
ends AS (SELECT source_key, shard, sum(quota) OVER (PARTITION BY source_key ORDER BY shard) AS upto, quota FROM quotas),
dealt AS (SELECT p.source_key, p.block, list(e.shard::VARCHAR ORDER BY p.draw) AS dealt FROM placed p JOIN ends e ON p.source_key = e.source_key AND p.number <= e.upto AND p.number > e.upto - e.quota GROUP BY ALL),
parts AS (
  SELECT s.doc_id, s.size, d.source_size, d.target, d.times, e.dealt,
    greatest(0, least(s.size, d.rest - coalesce(sum(s.size) OVER (PARTITION BY s.source_key, s.block ORDER BY s.key, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS part
  FROM slim s JOIN drawn d USING (source_key, block) LEFT JOIN dealt e USING (source_key, block))
SELECT doc_id, size, source_size, target, (size * times + part)::BIGINT AS taken,
  CASE WHEN size > 0 THEN coalesce(array_to_string(dealt[1:times + (part > 0)::INT], ','), '') ELSE '' END AS shards
FROM parts
"""


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT r, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35),
windows AS (SELECT s.r, s.i, md5(array_to_string(d.w[s.i:s.i + 34], ' ')) AS k FROM starts s JOIN docs d USING (r)),
again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY k) > 1),
gone AS (SELECT DISTINCT r, i + o AS i FROM again, range(0, 35) t(o)),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs),
kept AS (SELECT words.r, string_agg(word, ' ' ORDER BY words.i) AS text, count(*) AS n FROM words ANTI JOIN gone ON words.r = gone.r AND words.i = gone.i GROUP BY words.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM docs WHERE len(w) > 0),
sets AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS s FROM starts),
sizes AS (SELECT r, count(*) AS n FROM sets GROUP BY r),
common AS (SELECT a.r AS x, b.r AS y, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.r < b.r GROUP BY ALL),
links AS (SELECT x, y FROM common c JOIN sizes p ON p.r = c.x JOIN sizes q ON q.r = c.y WHERE 100 * c.n >= 75 * (p.n + q.n - c.n)),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(r, s) AS (SELECT r, r FROM docs UNION SELECT reach.r, sides.y FROM reach JOIN sides ON reach.s = sides.x),
lowest AS (SELECT reach.r, min(docs.doc_id) AS component_id FROM reach JOIN docs ON docs.r = reach.s GROUP BY reach.r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM docs JOIN lowest USING (r) LEFT JOIN sizes USING (r)
"""


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce(remainder(5) == 1, F.lit(False)).alias("held_out"), "text")
    return lm.score_texts(docs, ~F.col("held_out"), keep_text=False)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = tokens.count_tokens(docs, tokenizer=tokenizer_path())
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with faults by crc32 of ``conv_id:turn`` modulo 20; nulls are one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    out = rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), fault.alias("__fault")).where("__fault != 0")
    return out.withColumn("__copy", F.explode(F.when(F.col("__fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("__fault", "__copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = conversations.repair(damaged(rows), keep=False).drop("repaired").withColumnRenamed("conv_id", "__conv")
    every = rows.select("conv_id").distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("__conv")), "left")
    counts = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(remainder(3) == 1, F.lit(False))
    docs = read(spark, sf_dir, "documents").select("doc_id", held.alias("held_out"), "text")
    labels = read(spark, sf_dir, "labels").where(~held).select("doc_id", "toxic")
    return toxicity.detect(docs, labels).select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whiten.whiten(vectors).drop("embedding")


QUERIES = {f.__name__: f for f in (op1_media_columns, op2_license_scans, op3_url_filters, op4_language_id, op5_benchmark_decontamination, op6_source_mixing, op7_substring_dedup, op8_minhash_near_dedup, op9_lm_scoring, op10_token_counts, op11_conversation_repair, op12_toxicity, op13_embedding_whitening)}
SQL = {"op3_url_filters": OP3_SQL, "op6_source_mixing": _op6_sql(), "op7_substring_dedup": OP7_SQL, "op8_minhash_near_dedup": OP8_SQL}
