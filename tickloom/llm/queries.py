"""One query per operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, langid, licenses, sharding, simhash, spwfst, sql, suffixdedup, toxicity, warc
from .common import Scratch, table

#: A public BPE model with byte fallback, unless the session's setting spark.tickloom.tokenizer names another file.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def tokenizer(spark: SparkSession) -> bytes:
    """The model file's bytes, read where it lies, by the driver."""
    with open(spark.conf.get("spark.tickloom.tokenizer", TOKENIZER), "rb") as f:
        return f.read()


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derive(warc.responses_of(table(spark, sf_dir, "pages")), keep=["page_id"])
    names = {"record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "refers_to_uri": "WARC-Refers-To-Target-URI", "refers_to_date": "WARC-Refers-To-Date", "target_uri": "WARC-Target-URI", "content_type": "Content-Type", "content_length": "Content-Length", "block_digest": "WARC-Block-Digest"}
    columns = [warc.header(h).alias(c) for c, h in names.items()]
    return made.select("page_id", "record_type", *columns, F.col("block").cast("string").alias("body"), "source_block_digest", "source_payload_digest")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spwfst.encode(table(spark, sf_dir, "documents"), tokenizer(spark), round_trip=True)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = langid.held_out("doc_id", 4, 2)
    net = toxicity.fit(docs, labels.where(~out))
    found = toxicity.score(docs, net)
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.find(table(spark, sf_dir, "documents"))


def op5_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), Scratch(spark, "op5").folder()
    sharding.write(docs, path)
    return sharding.digest(sharding.read(spark, path, docs.schema))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where(F.col("vec_id") % 20 == 0))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), spans=False)
    return decontam.digest(found)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.classes(table(spark, sf_dir, "documents")))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out("doc_id", 3, 1)
    model = langid.fit(docs.where(~out))
    return langid.predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": sql.WARC, "op8_decontaminate": sql.DECONTAMINATE}
