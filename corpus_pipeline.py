"""A corpus from raw documents to packed sequences: quality, near duplicates, personal data, mix, packing.

``STAGES`` are applied in order, each to all that the one before it kept; ``run`` applies them to the documents table.
"""

from pyspark.sql import functions as F

from tapeline.llm import apportion, crf, gbdt, grouping, pieces, setsketch
from tapeline.llm.common import prepare, table
from tapeline.llm.queries import WORD_BPE
from tapeline.session import cut, discard

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Tokens in a packed sequence.
CAPACITY = 2048


def quality(spark, docs, sf_dir):
    """Documents that the quality classifier doesn't reject. It learns from the labels of documents outside the held-out fifth."""
    model = gbdt.train(docs, table(prepare(spark), sf_dir, "labels"))
    return gbdt.with_score(docs.select(*COLUMNS), model, "_score").filter("_score >= 0.3").select(*COLUMNS)


def near_duplicates(spark, docs, sf_dir):
    """One document, that of the smallest id, of each group of near duplicates (five words, similarity 0.8)."""
    prepare(spark)
    found = setsketch.near_duplicates(docs, size=5, percent=80).filter("not kept").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*COLUMNS)


def personal_data(spark, docs, sf_dir):
    """Personal data in texts replaced by its kind in brackets."""
    prepare(spark)
    found = crf.with_spans(docs.select(*COLUMNS), crf.train(crf.labelled_table()), clean=True)
    text = F.when(F.col("pii.spans") == "", F.col("text")).otherwise(F.col("pii.text"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark, docs, sf_dir):
    """Sources brought to their target words: documents left out, taken, taken twice, or taken in part."""
    prepare(spark)
    return apportion.take(docs.select(*COLUMNS))


def packing(spark, docs, sf_dir):
    """Pieces of the mix with their sequence and place. A document that the mix holds twice is there twice."""
    prepare(spark)
    return grouping.pack(pieces.token_pieces(docs, WORD_BPE, CAPACITY, end_id=0), CAPACITY)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix", mix), ("packing", packing)]
#: Fitted models and packing have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Each stage's documents are written before the next one reads them (several stages read them more than once); what two stages back wrote
    is removed then."""
    docs = table(prepare(spark), sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        kept = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES, ORACLES = {"pipeline": run}, {}
