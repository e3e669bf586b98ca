"""The registered query of each operator: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiduct.llm import decontam, extract, jaccard, langid, neardup, packing, quality, tokenfile, toxicity, warc
from lexiduct.llm.shared import fold, table
from lexiduct.plans.session import ready


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def labels_outside(spark: SparkSession, sf_dir: str, label: str, folds: int, held_out: int | None) -> DataFrame:
    """doc_id, label of the labelled documents outside the held-out fold.  Of repeated
    label rows the larger label counts."""
    labels = table(spark, sf_dir, "labels").where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if held_out is not None:
        labels = labels.where(fold("doc_id", folds) != held_out)
    return labels.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents").select("doc_id", "text")
    field = quality.fit_quality(docs, labels_outside(spark, sf_dir, "quality", 5, 0))
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return quality.score_quality(docs, field, keep=("doc_id",)).select("doc_id", held.alias("held_out"), "score", "predicted")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents")
    model = langid.fit_language_model(docs.where(fold("doc_id", 3) != 1))
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    return langid.identify_languages(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(ready(spark), sf_dir, "documents"), k=4, percent=85)


def op4_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents").select("doc_id", "text")
    fm = toxicity.fit_toxicity(docs, labels_outside(spark, sf_dir, "toxic", 4, 2))
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    return toxicity.score_toxicity(docs, fm).select("doc_id", held.alias("held_out"), "score", "predicted")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_text(table(ready(spark), sf_dir, "pages"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(ready(spark), sf_dir, "embeddings"), threshold=0.93)


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_digest(ready(spark), table(spark, sf_dir, "documents"), tokenizer_path())


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(ready(spark), sf_dir, "documents"), tokenizer_path())


def op9_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digest(ready(spark), table(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontamination_digest(table(ready(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = (
    op1_quality_crf,
    op2_language_id,
    op3_ngram_jaccard,
    op4_toxicity_fm,
    op5_html_extraction,
    op6_embedding_near_dedup,
    op7_token_ids,
    op8_best_fit_packing,
    op9_warc_normaliser,
    op10_decontamination,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    from lexiduct.llm.oracles import ORACLES

    return dict(ORACLES)
