"""The registered queries of this subpackage: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Target weights of the registered mix; paths that are not named weigh 1.
MIX_WEIGHTS = {
    ("web",): 3.0,
    ("books",): 2.0,
    ("news",): 2.0,
    ("code",): 1.0,
    ("forum",): 2.0,
    **{(d, lang): w for d in ("web", "books", "news", "code", "forum") for lang, w in (("en", 4.0), ("de", 2.0), ("fr", 2.0), ("es", 2.0))},
}


def mix_plan(total: int):
    """Half of the corpus' tokens, at most two epochs of any document."""
    from tomolake.llm.mixing import Plan

    return Plan(tokens=total // 2, weights=MIX_WEIGHTS, epochs=2, seed=17)


def op1_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tomolake.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"), mix_plan).select("doc_id", "domain", "lang", "source", "epoch", "n_tokens", "leaf_budget")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tomolake.llm import decontam

    return decontam.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tomolake.llm.hnsw import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tomolake.llm.urlfilter import judge

    return judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tomolake.llm.maintext import extract

    return extract(_table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tomolake.llm import toxicity

    scored = toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op7_chat_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tomolake.llm import chatpack

    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    rows = rows.unionByName(spark.createDataFrame(probe, "conv_id long, turn long, role string, text string"))
    return chatpack.digests(*chatpack.pack(rows))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tomolake.llm import langid

    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    return langid.predict(_table(spark, sf_dir, "documents")).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tomolake.llm.jaccard import jaccard_join

    return jaccard_join(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tomolake.llm import pii

    return pii.replace(_table(spark, sf_dir, "documents"), b"corpus-key-1").select("doc_id", "text", "n_entities")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in sorted(globals().items()) if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    from tomolake.llm import oracles

    return dict(oracles.SQL)
