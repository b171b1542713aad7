"""One query for each operator, over whole tables, and DuckDB SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import (
    centroids, dialogue, disclosure, exact_dedup, importance, jaccard, language, lm, mixing, packing, quality_rules, secrets, urls,
)
from vigil.llm.common import fold, staged, table

#: Vocabulary files, by the name that the tokenizers' package gives them.
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"

#: Rules for URLs: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: A host label with one of these words, and all below it, goes to the list of blocked hosts.
BLOCKED_LABEL = r"(?:^|\.)((?:[^.]*-)?(?:adult|bets|casino|pills|porn|spam|viagra|xxx)(?:-[^.]*)?\..+)$"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = language.learn_dictionaries(docs.where(fold("doc_id", 3) != 1))
    found = language.predict_language(docs.select("doc_id", "text"), dictionaries)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "accepted")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = lm.train(docs.where(fold("doc_id", 10) != 0))
    return lm.score(docs, model, counts).select(
        "doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["kind"] != "random")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
                        F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("found")).alias("spans"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents the mixture takes, with their cell's rate."""
    return mixing.sample_mix(table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"),
        F.col("__mass").alias("tokens"), F.col("__rate").alias("rate"), F.col("__chosen").alias("kept"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, _, least = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return keys.select("doc_id", "log_weight", "key", (F.col("key") >= F.lit(least)).alias("kept"))


def url_entries(pages: DataFrame) -> DataFrame:
    """The rules, and as a lower tier the hosts of ``pages`` that a blocked label names."""
    rules = pages.sparkSession.createDataFrame(URL_RULES, "host string, path string, verdict string")
    hosts = pages.select(F.regexp_extract(urls.host_of(F.col("url")), BLOCKED_LABEL, 1).alias("host")).where("host != ''").distinct()
    return rules.withColumn("tier", F.lit(1)).unionByName(
        hosts.select("host", F.lit("").alias("path"), F.lit("block").alias("verdict"), F.lit(0).alias("tier")))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = urls.filter_urls(pages, staged(url_entries(pages), "url-entries"))
    return found.select("page_id", "host", "path", F.when(F.col("tier") == 1, F.col("entry")).alias("rule"),
                        F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = jaccard.similarity_join(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "class_id")


def op11_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations")
    return dialogue.repair(dialogue.damage(said), said.select(F.col("conv_id").alias("conv"))).withColumnRenamed("conv", "conv_id")


def op12_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosure.find_personal(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("personal", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("personal", lambda s: s["kind"] != "term")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in disclosure.KINDS],
                        F.sha2(disclosure.joined(base).cast("binary"), 256).alias("base_sha256"),
                        disclosure.joined(F.col("personal")).alias("spans"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_language, op3_lm_score, op4_secrets, op5_mix, op6_packing, op7_quality, op8_url_filter,
    op9_quality_rules, op10_jaccard, op11_dialogue, op12_disclosure, op13_centroids)}

ORACLES = {
    "op1_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d""",
    "op8_url_filter": rf"""
        WITH u AS (
            SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
            FROM pages),
        rules(rule_host, rule_path, rule_verdict) AS (VALUES {", ".join(map(str, URL_RULES))}),
        fits AS (
            SELECT page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
                   max_by(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
            FROM u JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            GROUP BY page_id)
        SELECT u.page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN rule_verdict
               WHEN regexp_extract(host, '{BLOCKED_LABEL}', 1) <> '' THEN 'block' ELSE 'allow' END AS verdict
        FROM u LEFT JOIN fits USING (page_id)""",
    "op11_dialogue": dialogue.repair_sql(),
    "op12_disclosure": disclosure.personal_sql(),
    "op13_centroids": centroids.cluster_sql(),
}
