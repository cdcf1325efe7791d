"""Settings and helpers the text operators share."""

import os

from pyspark.sql import functions as F

from ..session import configure

#: What counts as white space between words: the six ASCII marks.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in an Arrow batch. Texts can be long, so a batch is kept to a few hundred.
BATCH_ROWS = 256


def prepare(spark):
    """UTC, and small Arrow batches, so that a worker's memory follows a few hundred texts."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark, sf_dir, name):
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def documents(spark, sf_dir, *cols):
    return table(prepare(spark), sf_dir, "documents").select("doc_id", *cols)


def remainder(col, by):
    """crc32 of the id as text, modulo ``by``."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % by


def words(text):
    """Words of a text as UTF-8 bytes: split() of bytes takes just the six ASCII marks for white space."""
    return (text or "").encode("utf-8").split()


