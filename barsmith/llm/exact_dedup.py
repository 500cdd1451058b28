"""Exact duplicates by deterministic block naming."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACE, bounded_batches, cut, table, tidy, utf8

BLOCK_BYTES = 4096


def block_key(block: bytes, attempt: int) -> bytes:
    """A short stand-in for a block's content; naming verifies that no two contents share one."""
    return hashlib.blake2b(block, digest_size=16, salt=attempt.to_bytes(4, "little")).digest()


def _blocks(text: bytes, size: int) -> list[bytes]:
    normal = text.translate(None, SPACE)
    return [normal[i : i + size] for i in range(0, len(normal), size)] or [b""]


def _names(docs: DataFrame, size: int, key: Callable[[bytes, int], bytes], attempt: int) -> DataFrame:
    """(key, name, contents): every distinct block's integer name. contents: how many distinct blocks share the key."""

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, bytes] = {}
            clash: list[tuple[bytes, bytes]] = []
            for text in utf8(batch.column(0)):
                for block in _blocks(text, size):
                    if found.setdefault(k := key(block, attempt), block) != block:
                        clash.append((k, block))
            rows = [*found.items(), *clash]
            for i in range(0, len(rows), 256):
                yield pa.record_batch([pa.array([r[0] for r in rows[i : i + 256]], pa.binary()), pa.array([r[1] for r in rows[i : i + 256]], pa.binary())], ["key", "block"])

    distinct = docs.select("_bn_text").mapInArrow(tidy(contents), "key binary, block binary").groupBy("key", "block").agg(F.count(F.lit(1)).alias("n"))
    named = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("contents")).sortWithinPartitions("key")
    return cut(named.select("key", "contents", F.monotonically_increasing_id().alias("name")))


def name_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, key: Callable[[bytes, int], bytes] = block_key) -> DataFrame:
    """One identity (level, name) a document: equal exactly when the texts without white space are equal.

    Texts are cut into blocks of block_bytes. The distinct blocks, brought together by their whole
    content and sorted, get integer names; then adjacent names are paired, the distinct pairs named, and
    so on until one name is left of each document. Names of a level belong to one content each, so
    identities have no collisions. Blocks reach their names through a short key; the step that brings
    whole blocks together also counts the contents of a key, and another key is taken should two share one.
    Only the distinct blocks of a task are shuffled, once.
    """
    source = docs.select(F.col(id_col).alias("_bn_id"), F.col(text_col).alias("_bn_text"))
    bounded_batches(docs.sparkSession)
    attempt = 0
    while True:
        names = _names(source, block_bytes, key, attempt)
        if names.filter("contents > 1").isEmpty():
            break
        attempt += 1

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas, keys = [], []
            for text in utf8(batch.column(1)):
                blocks = _blocks(text, block_bytes)
                keys.append([key(b, attempt) for b in blocks])
                sha = hashlib.sha256()
                for b in blocks:
                    sha.update(b)
                shas.append(sha.hexdigest())
            points = pc.fill_null(pc.utf8_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.record_batch([batch.column(0), points, pa.array(shas, pa.string()), pa.array(keys, pa.list_(pa.binary()))], ["_bn_id", "points", "text_sha256", "keys"])

    id_type = source.schema["_bn_id"].dataType.simpleString()
    rows = source.mapInArrow(tidy(keyed), f"_bn_id {id_type}, points long, text_sha256 string, keys array<binary>")
    rows = cut(rows.withColumn("rid", F.monotonically_increasing_id()))
    names = names.drop("contents")
    single = rows.filter(F.size("keys") == 1).select("rid", F.col("keys")[0].alias("key")).join(names, "key").select("rid", F.lit(0).alias("level"), "name")
    left = rows.filter(F.size("keys") > 1).select("rid", F.size("keys").alias("n"), F.posexplode("keys").alias("pos", "key")).join(names, "key").select("rid", "n", "pos", "name")
    done, level = [single], 0
    left = cut(left)
    while not left.isEmpty():
        level += 1
        # an odd last name pairs with null, which no name equals
        pairs = left.groupBy("rid", F.expr("cast(n + 1 as int) div 2").cast("int").alias("n"), F.expr("pos div 2").cast("int").alias("pos")).agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        pairs = cut(pairs)
        named = cut(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).sortWithinPartitions("a", "b").select("a", "b", F.monotonically_increasing_id().alias("name")))
        now = cut(pairs.join(named, ["a", "b"]).select("rid", "n", "pos", "name"))
        done.append(now.filter("n = 1").select("rid", F.lit(level).alias("level"), "name"))
        left = now.filter("n > 1")
    ids = done[0]
    for more in done[1:]:
        ids = ids.unionAll(more)
    return rows.drop("keys").join(ids, "rid").withColumnRenamed("_bn_id", id_col)


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, key: Callable[[bytes, int], bytes] = block_key) -> DataFrame:
    """Each document with its group of equal texts.

    Texts are equal when equal without the characters space and U+0009 to U+000D; null counts as empty,
    and all empty texts are equal. Of a group the row with the most code points stays, then the one with
    the smallest id (null first); of rows that also share the id, one stays. Groups may be of any size: they are counted by partial
    aggregates, and the join that hands out the result has both its sides shuffled, so that skewed
    partitions are split. An empty table gives an empty result; other columns don't matter.

    Returns id_col, keep_id, group_size, kept, text_sha256.
    """
    named = cut(name_documents(docs, id_col=id_col, text_col=text_col, block_bytes=block_bytes, key=key))
    best = F.min(F.struct((-F.col("points")).alias("points"), F.col(id_col).alias("id"), F.col("rid").alias("rid")))
    groups = cut(named.groupBy("level", "name").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")))
    out = named.join(groups, ["level", "name"])
    return out.select(id_col, F.col("best.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"), "text_sha256")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of all documents, with the operator's own block size."""
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = """
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t FROM documents),
g AS (SELECT t, count(*) AS group_size, first(doc_id ORDER BY points DESC, doc_id) AS keep_id FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t
"""
