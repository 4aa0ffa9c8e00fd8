"""A corpus pipeline of five stages, each calling one operator of ``quarry.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what it returns as Parquet in the shared
folder and gives it, read again, to the next. All stages but the last return the columns of documents, whatever else these have; n_chars follows the text.

Defined results, of all stages: an empty table gives an empty one; a null or empty text is scored like any other, loses no line, is nobody's near
duplicate and overlaps no benchmark item, so it is kept and encoded as no tokens; texts of any length are used whole; rows that share an id and a text are one
document, of which all rows stay or none; a row with a null id is kept by the near-duplicate stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, line_dedup, near_dedup, pieces, toxicity
from quarry.llm._store import fresh, stage, tidy
from quarry.llm.queries import MODEL_FILE, table

#: Documents that score at least this much are rejected.
TOXIC = 0.3
#: Segmentations of a document.
N_BEST = 3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score below TOXIC, by a model trained on all labelled folds of the source documents.

    Null and empty texts have the score of the model's intercept; equal texts are judged alike.
    """
    tidy(spark)
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=1, held_out=-1)
    (score,) = fresh(docs.columns, "score")
    return toxicity.score(docs, model, score_col=score).filter(F.col(score) < TOXIC).select(*[F.col(f"`{c}`") for c in docs.columns])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that come earlier in the corpus, or within one edit of it. A document of which nothing but white space is left goes; one that had nothing stays.

    Null texts stay null; rows that share an id and a text keep the same lines.
    """
    tidy(spark)
    n_lines, n_dropped = fresh(docs.columns, "lines", "dropped")
    out = line_dedup.dedup_lines(docs, added=(n_lines, n_dropped))
    out = out.filter((F.col(n_dropped) == 0) | F.col("text").rlike(r"\S"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the document with the smallest id.

    Documents without words (null, empty) are in no group; rows with a null id stay; rows that share the kept id stay, all of them.
    """
    tidy(spark)
    found = near_dedup.near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that overlap no benchmark item; null and empty texts overlap none, equal texts are judged alike."""
    tidy(spark)
    (overlaps,) = fresh(docs.columns, "overlaps")
    found = decontaminate.find_overlaps(docs, table(spark, sf_dir, "benchmark"), hits_col=overlaps)
    return found.filter(F.size(overlaps) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str, model_file: str = MODEL_FILE) -> DataFrame:
    """The N_BEST best segmentations of each document: (doc_id, n_tokens, token_ids: the best's, n_best: all with their scores, best first).

    Null and empty texts have no tokens and one (empty) segmentation; repeated rows are encoded each.
    """
    tidy(spark)
    return pieces.encode(docs.select("doc_id", "text"), pieces.read_model(spark, model_file), n_best=N_BEST).select("doc_id", "n_tokens", "token_ids", "n_best")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_near),
    ("decontamination", drop_contaminated),
    ("pieces", encode),
]

#: SQL can express neither the classifier nor the piece lattice; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES:
        docs, _ = stage(f(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
