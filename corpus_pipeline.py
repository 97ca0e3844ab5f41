"""From raw documents to packed training sequences: five stages, each written as Parquet and read again.

All stages but the last take and return the columns of documents, in any table: an empty one
stays empty, further columns ride along. Rows, not ids, are what stages decide on: a null id is an
id like any other, and rows that share an id with another text are documents of their own.
"""

from __future__ import annotations

import uuid

from lodestrata.llm import langid, ngram_join, packing, quality, secrets
from lodestrata.llm.common import cut, shared_folder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents without letters, or whose two nearest languages differ by less than this, are rejected.
MIN_MARGIN = 0.02
#: Names of dropped rows are broadcast up to this number (about 8 MB); beyond it both sides are shuffled.
MOST_BROADCAST = 200_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told; learns from this stage's labelled documents.

    A null or empty text, and one without letters, has no language and goes. Repeated rows are
    judged alike and stay. A table without labelled texts tells no language and keeps nothing.
    """
    return docs.where(langid.told(langid.train(docs), spark, "text", MIN_MARGIN))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality rules keep; language references come from this stage's documents.

    A null or empty text has no words and goes. Repeated rows are judged alike and stay. A null or
    unknown language is held against the nearest reference.
    """
    return docs.where(quality.passes(quality.references(docs), spark))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates (five words, Jaccard 0.8): the one with the smallest id.

    A row is named by its id and a hash of its text. A null id comes after all others; of rows with
    one id the smaller hash stays; of rows equal in both, one. Null texts and texts without
    words are like no other and stay, one for each id.
    """
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h"))
    named = docs.withColumn("_row", name)
    found = cut(ngram_join.near_duplicates(named, id_col="_row", n=5, percent=80))
    copies, repeated = found.where("_row <> component_id").select("_row").distinct(), found.groupBy("_row").count().where("count > 1").select("_row")
    copies, repeated = (F.broadcast(x) if x.count() <= MOST_BROADCAST else x for x in map(cut, (copies, repeated)))
    kept = named.join(copies, "_row", "left_anti")
    if repeated.limit(1).count():
        kept = kept.join(repeated, "_row", "left_anti").unionByName(kept.join(repeated, "_row", "left_semi").dropDuplicates(["_row"]))
    return kept.select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret span; n_chars follows the new text. Every row stays, a null text as null."""
    clean = secrets.redact(docs, secrets.infer(secrets.labelled_credentials()))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents (ranges of words) and the bins that they are packed into.

    A document without words keeps one row without a bin; repeated rows are packed each by itself.
    """
    return packing.best_fit(docs)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("near_duplicates", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: Trained models, automata and greedy packing have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's folder is deleted when the next is written; the last one's stays, being read by the caller."""
    top = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        folder = f"{top}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            _delete(spark, before)
        before = folder
    return docs
