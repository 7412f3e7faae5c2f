"""The opN_ queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprint, html_text, jaccard_join, language, neighbours, packing, pii, tokenization, toxicity
from .common import read


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-k fingerprints of every document, of its edited text, and their likenesses."""
    rows = fingerprint.fingerprints_with_edits(read(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.encoded(F.col("sketch")).alias("fingerprint"),
        fingerprint.encoded(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprint.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprint.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def texts_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1_fingerprints that SQL can state: lengths and edited texts of every document."""
    rows = fingerprint.fingerprints_with_edits(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))


def texts_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3_jaccard_join that SQL can state: rows with the same text."""
    rows = jaccard_join.join(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_copies")


TEXTS_EDITED = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS following, length(text) AS n_chars FROM t)
SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, sha256(substr(text, 1, n_chars - n_chars // 4) || substr(following, 1, n_chars // 4)) AS edited_sha256 FROM n"""
TEXTS_JOINED = "SELECT doc_id, count(*) OVER (PARTITION BY md5(coalesce(text, ''))) AS n_copies FROM documents"


def tokenizer_path() -> str:
    """The public tokenizer file of the queries."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with chunk reuse."""
    rows = tokenization.encode_documents(read(spark, sf_dir, "documents"), tokenizer_path())
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, number of links and copies of every document."""
    return jaccard_join.join(read(spark, sf_dir, "documents")).drop("t", "class_t")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in as few sequences of 4096 tokens as the configuration program finds."""
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())


def held_out(column: str, folds: int, fold: int) -> Column:
    """Whether crc32 of an id as text leaves the remainder `fold`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds == fold


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learnt from the folds that are not held out."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(~held_out("doc_id", 5, 0)))
    rows = toxicity.score(docs, model)
    return rows.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation, repaired and rendered."""
    return chat.format_turns(read(spark, sf_dir, "conversations"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from the folds that are not held out."""
    docs = read(spark, sf_dir, "documents")
    model = language.fit(docs.filter(~held_out("doc_id", 4, 2)).select("doc_id", "text", "lang"))
    rows = language.identify(docs, model)
    return rows.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document; the counts are those of the base spans."""
    rows = pii.detect(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *[count(k) for k in ("email", "ip", "card", "phone")], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    rows = html_text.extract(read(spark, sf_dir, "pages"))
    return rows.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every row whose id is divisible by 100."""
    return neighbours.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The corpus queries by name."""
    return {f.__name__: f for f in (op1_fingerprints, op2_bpe, op3_jaccard_join, op4_packing, op5_toxicity, op6_chat, op7_language, op8_pii, op9_html, op10_neighbours, texts_edited, texts_joined)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of what it can express: none of the operators as a whole (tests hold them against brute force), but columns of two."""
    return {"texts_edited": TEXTS_EDITED, "texts_joined": TEXTS_JOINED}
