"""The queries of this folder; each applies one operator to its whole table and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm import audio, langid, mixing, packing, phrases, pii, quality, sharding, simhash, spotsigs
from quayside.llm.common import store, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = mixing.sized(table(spark, sf_dir, "documents"))
    return mixing.taken_words(base, mixing.plan_for(base)).select("doc_id", "size", "source_size", "target", "taken")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), [1.0] * 40)


def op3_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audio.read_back(store(audio.files(table(spark, sf_dir, "documents"))))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.size("segments").alias("n_segments"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymized(docs, count="n_replaced")


def op5_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.without_repeats(table(spark, sf_dir, "documents"), window=20)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~langid.held_out()))
    return langid.predict(docs.withColumn("held_out", langid.held_out()), model, ["doc_id", "held_out"])


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs.withColumn("held_out", langid.held_out()), model, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), simhash.id_of("component").alias("component_id"))


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return spotsigs.with_successors(docs, classes=spotsigs.classes(docs))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), length=2048, end_id=1)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_mixing": op1_mixing, "op2_sharding": op2_sharding, "op3_audio": op3_audio, "op4_pii": op4_pii, "op5_phrases": op5_phrases, "op6_langid": op6_langid, "op7_quality": op7_quality, "op8_simhash": op8_simhash, "op9_spotsigs": op9_spotsigs, "op10_packing": op10_packing}


def oracle_sql() -> dict[str, str]:
    return {}
