"""From raw documents to packed sequences: toxicity, exact dedup, near dedup, mixing, packing.

Each stage takes all its predecessor kept and returns the columns of documents; the last returns the packing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from barsmith.llm._common import ensure_checkpoint_dir, written

#: Numbers of rows to drop are broadcast up to this number, 16 MB; joined beyond it.
MOST_BROADCAST = 2_000_000


def _numbered(docs: DataFrame) -> DataFrame:
    """docs as a table, with a number for each row: ids may be null or repeated."""
    return written(docs.withColumn("_row", F.monotonically_increasing_id()))[0]


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The numbered rows but those whose numbers (distinct, not null) are in gone."""
    gone, _ = written(gone.select("_row"))
    return rows.join(F.broadcast(gone) if gone.count() <= MOST_BROADCAST else gone, "_row", "left_anti").drop("_row")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of toxicity.THRESHOLD or more go, whatever their ids. Learns from the labels of sf_dir
    that aren't held out; without labels, every document has one score. Null and empty texts have no tokens; repeated rows share their fate."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, the one exact_groups keeps: null and empty texts are one group. Rows go by
    a number of their own, so null and repeated ids make no difference; an empty table stays empty."""
    rows = _numbered(docs)
    groups = exact_dedup.exact_groups(rows.withColumn("_id", F.struct("doc_id", "_row")), id_col="_id")
    return _without(rows, groups.filter(~F.col("kept")).select("_id._row"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five words, 80 %) the row with the smallest id stays (null last); rows
    without words are alone. Rows go by a number of their own, as above; an empty table stays empty."""
    rows = _numbered(docs)
    groups = near_dedup.near_groups(rows, id_col="_row").join(rows.select("_row", "doc_id"), "_row")
    groups, _ = written(groups.select("_row", "component_id", F.struct(F.col("doc_id").isNull(), "doc_id", "_row").alias("by")))
    kept = groups.groupBy("component_id").agg(F.min("by").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return _without(rows, groups.join(kept, "component_id").filter(F.col("_row") != F.col("first._row")).select("_row"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, whole rows, up to twice. Null sources are one source; rows without words are
    taken no time; repeated rows and ids count each; an empty table stays empty."""
    mixed = mixing.mix(docs, payload=True).filter("copies > 0")
    return mixed.select(F.explode(F.array_repeat("doc", F.col("copies").cast("int"))).alias("doc")).select("doc.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows and their places in sequences. Null and empty texts are one token; repeated rows are packed
    each, null ids too; an empty table gives no pieces."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Toxicity, components and packing aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet to the shared checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
