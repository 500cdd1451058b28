"""Mixing sources to target weights by systematic sampling, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import WORD, cut, table


def _band(size: Column) -> Column:
    """Sizes of one binary order of magnitude and the same three bits after the first share a band."""
    bits = F.length(F.bin(size))
    return F.when(size < 8, size).otherwise(bits * 8 + F.expr("shiftright(_mx_size, length(bin(_mx_size)) - 4)") - 8).cast("int")


def _unit(text: Column) -> Column:
    """A fixed number in [0, 1) for a string."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float, seed: int) -> DataFrame:
    """sizes: (_mx_key, source_size). Adds target and the sampling offset.

    The sources, sorted by how early they reach their cap, are capped as a prefix: source i is capped
    when its cap is at most its weight's part of what the ones before leave over.
    """
    total = W.partitionBy()
    by_key = W.orderBy("_mx_key")
    filled = W.orderBy("_mx_fill", "_mx_key")
    n = len(weights)
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_key) - 1) % n + 1).cast("int"))
    out = (
        sizes.withColumn("_mx_w", cycle)
        .withColumn("_mx_cap", F.col("source_size") * F.lit(cap))
        .withColumn("_mx_all", F.sum("source_size").over(total) * F.lit(share))
        .withColumn("_mx_fill", F.col("_mx_cap") / F.col("_mx_w"))
        .withColumn("_mx_before", F.coalesce(F.sum("_mx_cap").over(filled.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_mx_rest", F.sum("_mx_w").over(filled.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("_mx_full", F.col("_mx_fill") * F.col("_mx_rest") <= F.col("_mx_all") - F.col("_mx_before"))
    )
    spare = F.col("_mx_all") - F.sum(F.when(F.col("_mx_full"), F.col("_mx_cap")).otherwise(0.0)).over(total)
    open_w = F.sum(F.when(F.col("_mx_full"), 0.0).otherwise(F.col("_mx_w"))).over(total)
    target = F.when(F.col("_mx_full"), F.col("_mx_cap")).otherwise(F.col("_mx_w") * spare / open_w)
    return out.select("_mx_key", "source_size", target.alias("target"), _unit(F.concat(F.lit(f"{seed}:"), "_mx_key")).alias("_mx_u"))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 17,
    salts: int = 256,
    payload: bool = False,
) -> DataFrame:
    """How often each document enters a mix of its sources.

    Every document of a source has the same expected number of copies, target / source_size. The
    documents of a source stand in order of size band, salt, size and id; the prefix sum of their
    expected copies, moved by the source's one offset, gives a copy for each integer boundary it
    crosses. As the order follows the size, the words taken stay within about one document of the
    target. The offset comes from a digest of the seed and the source, so reruns agree.

    The prefix sum has two levels: rows within (source, band, salt), and the groups within a source
    (at most bands x salts rows). A hot source, or a hot size, is spread over the salts.

    Null or blank texts have size 0 and take no words; null sources form one source, ordered last; a
    source without words has target 0 and no copies; repeated rows and ids are rows of their own; an
    empty table gives an empty result. Other columns don't matter. payload: also the whole input row, as the struct column doc.

    Returns id_col, size, source_size, target, copies, taken (and doc).
    """
    rows = docs.select(
        F.col(id_col).alias("_mx_id"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("_mx_size"),
        F.coalesce(F.concat(F.lit("0"), F.col(source_col)), F.lit("1")).alias("_mx_key"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if payload else []),
    )
    salt = F.conv(F.substring(F.md5(F.coalesce(F.col("_mx_id").cast("string"), F.lit(""))), 1, 6), 16, 10).cast("int") % salts
    rows = rows.withColumn("_mx_band", _band(F.col("_mx_size"))).withColumn("_mx_salt", salt)
    group = ["_mx_key", "_mx_band", "_mx_salt"]
    groups = cut(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_mx_n"), F.sum("_mx_size").alias("_mx_words")))
    sources = targets(groups.groupBy("_mx_key").agg(F.sum("_mx_words").alias("source_size")), weights, share, cap, seed)
    in_source = W.partitionBy("_mx_key").orderBy("_mx_band", "_mx_salt").rowsBetween(W.unboundedPreceding, -1)
    starts = groups.withColumn("_mx_start", F.coalesce(F.sum("_mx_n").over(in_source), F.lit(0))).drop("_mx_n", "_mx_words").join(sources, "_mx_key")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    out = rows.withColumn("_mx_at", F.row_number().over(W.partitionBy(*group).orderBy("_mx_size", "_mx_id"))).join(starts, group)
    at = (F.col("_mx_start") + F.col("_mx_at")).cast("double")
    copies = F.floor(at * rate + F.col("_mx_u")) - F.floor((at - 1) * rate + F.col("_mx_u"))
    return out.select(
        F.col("_mx_id").alias(id_col),
        F.col("_mx_size").alias("size"),
        "source_size",
        "target",
        copies.cast("long").alias("copies"),
        (copies * F.col("_mx_size")).cast("long").alias("taken"),
        *(["doc"] if payload else []),
    )


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's mix of all documents."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: DuckDB: the same targets, order and boundaries.
SIZED_SQL = """
sized AS (SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
  coalesce('0' || source, '1') AS k FROM {docs}),
banded AS (SELECT *, CASE WHEN size < 8 THEN size ELSE length(bin(size)) * 8 + (size >> (length(bin(size)) - 4)::INT) - 8 END AS band,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 6))::BIGINT % 256 AS salt FROM sized),
src AS (SELECT k, sum(size)::BIGINT AS source_size FROM banded GROUP BY k),
w0 AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY encode(k)) - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS goal FROM src),
w1 AS (SELECT *, cap / w AS fill FROM w0),
w2 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY fill, encode(k) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_, sum(w) OVER (ORDER BY fill, encode(k) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w1),
w3 AS (SELECT *, fill * rest <= goal - before_ AS is_full FROM w2),
w4 AS (SELECT k, source_size, ('0x' || substr(md5('17:' || k), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u,
  CASE WHEN is_full THEN cap ELSE w * (goal - sum(CASE WHEN is_full THEN cap ELSE 0::DOUBLE END) OVER ()) / sum(CASE WHEN is_full THEN 0::DOUBLE ELSE w END) OVER () END AS target FROM w3),
placed AS (SELECT b.doc_id, b.size, s.source_size, s.target, s.u, CASE WHEN s.source_size > 0 THEN s.target / s.source_size ELSE 0::DOUBLE END AS rate,
  (row_number() OVER (PARTITION BY b.k ORDER BY b.band, b.salt, b.size, b.doc_id))::DOUBLE AS pos FROM banded b JOIN w4 s ON b.k = s.k),
mixed AS (SELECT doc_id, size, source_size, target, (floor(pos * rate + u) - floor((pos - 1) * rate + u))::BIGINT AS copies FROM placed)
"""
SQL = "WITH " + SIZED_SQL.format(docs="documents") + "SELECT doc_id, size, source_size, target, copies * size AS taken FROM mixed"
