"""Corpus pipeline: documents through five filters to a training mix.

Each stage works on what its predecessor kept and returns the columns of
documents, the last one with the mix's columns besides.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import decontaminate, jaccard, langid, mixing, toxicity
from paperloom.llm.shared import load, shared_dir, text_batches

#: Documents at or above this toxicity go; documents below this language probability go.
TOXIC, CERTAIN = 0.7, 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 8: learns from all labels, drops documents that score TOXIC or more.

    Null and empty texts are no toxic texts and stay, rows that repeat are
    judged alike, whatever the columns are called.  Without labels a lexicon
    of seed terms decides.  An empty table gives an empty table.
    """
    lexicon = toxicity.learn(docs, load(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, lexicon, TOXIC)


def drop_undetermined(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 9: drops documents without a determined language.

    Those are null texts, texts without a letter, and texts whose likeliest
    language has a probability under CERTAIN.  Where no document has a
    language, none is learned, and every text with a letter stays.  Repeated
    rows are judged alike; an empty table gives an empty table.
    """
    text_batches(spark)
    return langid.drop_undetermined(docs, langid.train(docs, F.lit(True)), CERTAIN)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 10: of each group of near-duplicates the document with the smallest id stays; documents without words stay.

    A null id counts as the last; of rows equal in id and text one stays, of a
    null text each.  Columns may have any names; an empty table gives an empty
    table.
    """
    text_batches(spark)
    return jaccard.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 3: drops documents that hold a benchmark item.

    Null and empty texts hold none and stay; repeated rows are judged alike.
    Without items all stay; an empty table gives an empty table.
    """
    return decontaminate.remove_contaminated(docs, load(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 6: documents the mix takes words of, with size, source_size, target, taken.

    A null source is a source of its own, a null text has no words and is not
    taken.  Rows equal in id and text are taken alike.  Columns of documents
    named like the four results are replaced.  An empty table gives an empty
    table.
    """
    return mixing.mix_documents(docs)


STAGES = [("toxicity", drop_toxic), ("language", drop_undetermined), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", mix)]

#: The stages learn models and link sets; they are tested against brute force instead.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written as Parquet in the shared folder and read again.

    A stage's result is removed once the next one is written; the last one's
    stays, as the rows returned are read from it.  Nulls, repeated rows and
    empty tables are as of the stages.
    """
    docs, before = load(spark, sf_dir, "documents"), None
    base = f"{shared_dir(spark)}/paperloom/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            _remove(spark, before)
        before = f"{base}/{name}"
    return docs


