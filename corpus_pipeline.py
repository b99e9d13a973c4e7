"""A corpus pipeline of five operators: clean, deduplicate, redact, mix and pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread as
the next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm import mixing, packing, quality, secret_scan, simhash
from ledgerspark.llm.shared import cut, fresh, numbered
from ledgerspark.llm.tokens import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good; it learns from the labels of ``sf_dir``.

    A row goes if its probability of label 1 is below a half, whatever its id is: rows without an id or
    with a repeated one are judged each by its own text.  Null and empty texts are scored as texts
    without words.  Without labels every score is a half, and all rows stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    row = fresh(docs, "_row")
    rows = numbered(docs, row)
    good = quality.classify(rows, labels, row=row).where("predicted = 1").select(F.col("row").alias("_good"))
    return rows.join(good, rows[row] == F.col("_good"), "left_semi").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies by SimHash, the one with the smallest id.

    Null and empty texts are copies of one another.  Rows without an id stay; of rows with equal ids only
    near copies go.
    """
    return simhash.deduplicate(docs).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in their texts replaced by the rule's name in brackets.

    Every row is scanned by itself, whatever its id is; null texts stay null, and ``n_chars`` is that of
    the new text where it was known.
    """
    spans = fresh(docs, "_spans")
    found = secret_scan.scan(docs, out=spans).withColumn("text", secret_scan.redact(F.col("text"), F.col(spans))).drop(spans)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast("long")))
    return found.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it (0 to 3), also where ids are null or repeat.

    Texts without words (null ones too) are never taken; rows without a source are a source.
    """
    row, copy = fresh(docs, "_row"), fresh(docs, "_copy")
    rows = numbered(docs, row)
    copies = mixing.mix(rows, row=row).where("copies > 0").select(F.col("row").alias("_to"), F.col("copies").alias("_copies"))
    taken = rows.join(copies, rows[row] == F.col("_to"))
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: the pieces of every row and where they stand.

    A null text is an empty document; rows with null or equal ids are documents of their own.
    """
    return packing.pack_documents(docs, vocabulary(), end_id=2)


STAGES = [
    ("quality classifier", classify_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("secret scan", redact_secrets),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage{k}")
    return docs


#: A classifier, fingerprints and a tokenizer have no form in SQL.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
