"""A corpus pipeline: language ID, toxicity, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet to the shared
folder and reads it again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import jaccard_join, language, packing, pii, toxicity
from quadrille.llm.common import read, stored
from quadrille.llm.queries import held_out, tokenizer_path

#: A document goes if no language reaches this share, or if it is toxic with at least this score.
LEAST_LANGUAGE_SCORE, TOXIC = 0.5, 0.5
#: SQL can't express the models.
ORACLE_SQL = None


def _judged(rows: DataFrame, columns: list[str], extra: list[str], keep: Column | None = None, **changed: Column) -> DataFrame:
    """Rows whose last columns are named extra (whatever the others are called): those kept, with the given columns only."""
    names = [f"__c{i}" for i in range(len(columns))]
    rows = rows.toDF(*names, *extra)
    rows = rows if keep is None else rows.filter(keep)
    return rows.select(*[changed.get(c, F.col(n)).alias(c) for c, n in zip(columns, names, strict=True)])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones are in; those without letters and undecided ones go."""
    model = language.fit(docs.filter(~held_out("doc_id", 4, 2)).select("doc_id", "text", "lang"))
    rows = language.identify(docs, model, keep=docs.columns)
    keep = (F.col("__lang") != language.UNKNOWN) & (F.col("__score") >= LEAST_LANGUAGE_SCORE)
    return _judged(rows, docs.columns, ["__lang", "__score", "__bits"], keep)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels").filter(~held_out("doc_id", 5, 0)))
    rows = toxicity.score(docs, model, keep=docs.columns)
    return _judged(rows, docs.columns, ["__toxicity"], F.col("__toxicity") < TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the least id."""
    return jaccard_join.kept(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind, and their new lengths."""
    rows = pii.detect(docs, keep=docs.columns)
    size = F.coalesce(F.char_length("__redacted").cast("long"), F.col(f"__c{docs.columns.index('n_chars')}")) if "n_chars" in docs.columns else None
    changed = {"text": F.col("__redacted")} | ({"n_chars": size} if size is not None else {})
    return _judged(rows, docs.columns, ["__spans", "__redacted"], **changed)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 4096 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("language ID", identify_language), ("toxicity", drop_toxic), ("n-gram Jaccard join", drop_near_duplicates), ("PII", redact), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage{i}")
    return docs
