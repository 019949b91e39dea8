"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, chat, decontam, langid, minhash, oracles, secrets, suffix, topk, toxicity, urlfilter
from weftline.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_decode(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, digest=True)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_windows(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    more = spark.createDataFrame(planted, "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_turns(rows.unionByName(more)))


#: The rules that this query is registered with.
URL_RULES = (
    urlfilter.Rule("com/en/", "block"),
    urlfilter.Rule("example.com/en/7", "allow"),
    urlfilter.Rule("net/de/", "allow"),
    urlfilter.Rule("example.net/de/8", "block"),
    urlfilter.Rule("org/es/", "block"),
)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return urlfilter.judge(pages, URL_RULES, urlfilter.train(urlfilter.labelled_by(pages, URL_RULES)))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of ``op4_url_filter`` does not depend on the trees."""
    out = op4_url_filter(spark, sf_dir)
    return out.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("rule_verdict"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(read_table(spark, sf_dir, "documents"), length=100, digest=True)


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths, _, _ = secrets.scan(read_table(spark, sf_dir, "documents"))
    return secrets.digest(paths)


QUERIES: dict[str, Query] = {
    "op1_bpe": op1_bpe,
    "op2_decontamination": op2_decontamination,
    "op3_chat_format": op3_chat_format,
    "op4_url_filter": op4_url_filter,
    "url_rules": url_rules,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_top_k": op6_top_k,
    "op7_toxicity": op7_toxicity,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_language_id": op9_language_id,
    "op10_secret_scan": op10_secret_scan,
}
SQL: dict[str, str] = {
    "op2_decontamination": oracles.DECONTAMINATION,
    "op3_chat_format": oracles.CHAT,
    "url_rules": oracles.url_rules(URL_RULES),
    "op6_top_k": oracles.TOP_K,
    "op8_near_duplicates": oracles.NEAR_DUPLICATES,
    "op10_secret_scan": oracles.SECRET_SCAN,
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    return dict(SQL)
