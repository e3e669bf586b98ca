"""The corpus pipeline: documents in, packed training sequences out.

Each stage works on all rows that the one before kept, takes (spark, docs, sf_dir)
and, but for the last, returns the columns of documents.  A stage drops only rows
that its operator rejects:

- language: texts without a letter, or in no learned language with at least
  LEAST_POSTERIOR (null and empty texts go here);
- toxicity: texts predicted toxic;
- near duplicates: all but one row of each group, that with the smallest doc_id (one
  without an id only where none has one; then by hashes of set and text), and repeats
  of a doc_id and text;
- decontamination: texts of which benchmark windows cover a twentieth or more;
- packing: nothing; every piece of every document is in one sequence.

Rows are judged by their own text: one that shares its doc_id with other texts, or has
none, is kept or dropped like any other.

Models are fitted on the tables of sf_dir by their operators' documented samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiduct.llm import decontam, jaccard, langid, packing, toxicity
from lexiduct.llm.queries import labels_outside, tokenizer_path
from lexiduct.llm.shared import table, written
from lexiduct.plans.session import ready

#: Far below what a text of a known language gets; a text of several rare scripts may stay under it.
LEAST_POSTERIOR = 0.5


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows of docs whose text is in a learned language with at least
    LEAST_POSTERIOR.  Null and empty texts and those without a letter go; a row's id,
    language and source don't matter, and repeated rows are judged alike.  If documents
    name no language, none is learned and every row goes; an empty table stays empty.
    Other columns are kept, but those named lang_pred and score."""
    model = langid.fit_language_model(table(ready(spark), sf_dir, "documents"))
    return langid.identify_languages(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_POSTERIOR)).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows of docs that the machine, fitted on all labelled documents, predicts
    toxic.  Null and empty texts have the machine's bias alone, which is below the
    threshold unless most labels are toxic; repeated rows and null ids are judged like
    any other.  Without labels, or with one class, all rows get that class (0 without)."""
    labels = labels_outside(ready(spark), sf_dir, "toxic", 4, None)
    fm = toxicity.fit_toxicity(table(spark, sf_dir, "documents"), labels)
    return toxicity.score_toxicity(docs, fm).where("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates (five words, 80 %): the smallest
    (doc_id, text hash) of the group's class with the smallest doc_id; a null doc_id
    counts as the largest.  Of rows equal in doc_id and text one stays.  Different texts
    under one doc_id are judged apart; null, empty and blank texts have no shingles, so
    each stays, once for its doc_id.  Texts are told apart by a 64-bit hash within a doc_id."""
    ready(spark)
    rows = jaccard.similar_documents(docs, k=5, percent=80, one_id=False)
    first = rows.where((F.col("fa") == F.col("component.class")) & F.col("doc_id").eqNullSafe(F.when(~F.col("component.lone"), F.col("component.id"))))
    first = first.groupBy("component").agg(F.min("doc_id").alias("doc_id"), F.min("text_hash").alias("text_hash")).select("doc_id", "text_hash")
    keep = first.unionByName(rows.where("component is null").select("doc_id", "text_hash"))
    # A null id has a name here, so that the join and the repeats go by the same keys, in one shuffle of the texts.
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id")
    keep = keep.select(named, F.col("text_hash").alias("_hash")).distinct()
    kept = docs.select("*", named, jaccard.text_hash().alias("_hash")).join(keep, ["_id", "_hash"], "left_semi")
    return kept.dropDuplicates(["_id", "_hash"]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows of docs of which benchmark windows cover a twentieth of the words or
    more.  Rows are judged by their text, so null and repeated ids and repeated rows are
    like any other; null and empty texts and, with an empty benchmark, all rows stay."""
    texts = docs.select(jaccard.text_hash().alias("doc_id"), "text")
    bad = decontam.decontamination_digest(texts, table(ready(spark), sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("bad")).distinct()
    return docs.join(bad, jaccard.text_hash() == F.col("bad"), "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of every row of docs: one row a piece, as `packed_documents` gives
    them.  A null or empty text is its end id alone, repeated rows and null ids give
    their own pieces, long texts are cut, and an empty table gives no row."""
    return packing.packed_documents(docs, tokenizer_path())


STAGES = [
    ("language", keep_known_languages),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL can't express the stages' models; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written as Parquet to the shared folder and
    read again as the next one's rows."""
    docs = table(ready(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
