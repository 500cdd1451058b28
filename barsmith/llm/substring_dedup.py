"""Repeated passages by run-length indexes of the parts of the corpus that can repeat."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, cut, table, tidy, utf8, written

LENGTH = 200
#: Bytes of the strings that anchor windows, multiples of eight: of all windows, and of those whose anchors have more different segments than one index takes.
ANCHORS = (32, 120, 200)
#: Bytes of the segments of one index.
INDEX_BYTES = 2_000_000
PIECE = 1 << 23
_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _hashes(text: bytes, width: int) -> np.ndarray:
    """A hash of the `width` bytes at every position."""
    n = len(text)
    word = np.ndarray((n - 7,), "<u8", text, 0, (1,)).copy()
    m = n - width + 1
    x = np.zeros(m, np.uint64)
    for i in range(0, width, 8):
        x = (x ^ word[i : i + m]) * _MUL[(i // 8) % 4]
        x ^= x >> np.uint64(32)
    x *= _MUL[1]
    x ^= x >> np.uint64(29)
    return x


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    m = len(keys)
    rows = -(-m // width)
    p = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    p[:m] = keys
    p = p.reshape(rows, width)
    ahead = np.minimum.accumulate(p, 1).ravel()
    behind = np.minimum.accumulate(p[:, ::-1], 1)[:, ::-1].ravel()
    n = m - width + 1
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments(text: bytes, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, size, anchor hash): the runs of windows that share the position of their lowest anchor hash.

    Equal windows have equal lowest hashes at equal places, so all occurrences of a window lie in segments of one anchor hash.
    """
    starts, sizes, anchors = [], [], []
    for at in range(0, max(len(text) - length + 1, 0), PIECE):
        part = text[at : at + PIECE + length - 1]
        h = _hashes(part, anchor)
        key = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
        place = (_sliding_min(key, length - anchor + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[first[1:], len(place)] - 1
        starts.append(first + at)
        sizes.append(last - first + length)
        anchors.append(h[place[first]].view(np.int64))
    if not starts:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(starts), np.concatenate(sizes), np.concatenate(anchors)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling from packed sevens of symbols, which are below 512; suffixes that are told apart already aren't sorted again."""
    n = len(text)
    x = np.zeros(n, np.int64)
    padded = np.concatenate([text.astype(np.int64), np.zeros(7, np.int64)])
    for i in range(7):
        x = (x << 9) | padded[i : i + n]
    order = np.argsort(x)
    x = x[order]
    heads = np.r_[True, x[1:] != x[:-1]]  # first rows of groups of suffixes that are alike so far
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    h = 7
    while h < 2 * n:
        rows = np.flatnonzero(~(heads & np.r_[heads[1:], True]))
        if not len(rows):
            break
        at = order[rows]
        x = rank[at] * (n + 1) + np.where(at + h < n, rank[np.minimum(at + h, n - 1)] + 1, 0)
        by = np.argsort(x)
        at, x = at[by], x[by]
        order[rows] = at
        heads[rows] = new = np.r_[True, x[1:] != x[:-1]]
        rank[at] = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
        h *= 2
    return order


def _common(padded: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Lengths of common prefixes at positions a and b, up to most."""
    out = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    at = 0
    while len(open_) and at < most:
        x = padded[np.minimum(a[open_, None] + at + np.arange(16), len(padded) - 1)] != padded[np.minimum(b[open_, None] + at + np.arange(16), len(padded) - 1)]
        differs = x.any(1)
        out[open_] = at + np.where(differs, x.argmax(1), 16)
        open_ = open_[~differs]
        at += 16
    return np.minimum(out, most)


class RunIndex:
    """The run-compressed Burrows-Wheeler transform of a text with the suffixes at run ends sampled.

    runs: the symbol of each run; heads, tails: the suffix that each run's first and last row stand for, with
    its common prefix with the row before, or after. Within a run these lengths fall by one a text position,
    so the samples give the matching statistics of every position.
    """

    def __init__(self, text: np.ndarray, most: int) -> None:
        n = len(text)
        order = suffix_array(text)
        bwt = text[order - 1]
        bwt[order == 0] = -1  # nothing stands before the first suffix
        change = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1
        first, last = np.r_[0, change], np.r_[change - 1, n - 1]
        self.n, self.runs = n, bwt[first]
        padded = np.concatenate([text.astype(np.int16), np.array([-1], np.int16)])
        self.heads = order[first], np.where(first > 0, _common(padded, order[first], order[first - 1], most), 0)
        after = order[np.minimum(last + 1, n - 1)]
        self.tails = order[last], np.where(last < n - 1, _common(padded, order[last], after, most), 0)

    def matching_statistics(self) -> np.ndarray:
        """For each position the longest match that starts there and also somewhere else, streamed in text order."""
        out = np.zeros(self.n, np.int64)
        for place, size in (self.heads, self.tails):
            reach = np.zeros(self.n, np.int64)
            reach[place] = place + size
            np.maximum(out, np.maximum.accumulate(reach) - np.arange(self.n), out=out)
        return out


def repeated(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each part, which of its windows occurs at another place of the parts. No window reaches over a part's end."""
    joined = b"\0".join(parts) + b"\0"
    text = np.frombuffer(joined, np.uint8).astype(np.int16) + 1
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    text[ends] = 0
    # no part occurs twice, so no match covers a whole part and more than two beside it
    long = RunIndex(text, 2 * int(sizes.max()) + 4).matching_statistics() >= length
    return [long[e - s : e - length + 1] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    """Runs of set flags, as (start, size)."""
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return [(int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


KEY = "k1 long, k2 long"


def packed(texts: DataFrame, lead: str = f"{KEY}, base long") -> DataFrame:
    """The text column as compressed bytes z, for shuffles of whole texts, beside the lead columns."""
    names = [c.split()[0] for c in lead.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            small = pa.array([squeeze(t) for t in utf8(batch.column(len(names)))], pa.binary())
            yield pa.record_batch([*batch.columns[: len(names)], small], [*names, "z"])

    return texts.select(*names, "text").mapInArrow(tidy(run), f"{lead}, z binary")


def unpacked(column: pa.Array) -> Iterator[bytes]:
    expand = zstandard.ZstdDecompressor().decompress
    for z in column:
        yield expand(z.as_py())


PLACE = f"{KEY}, base long"


def _segmented(source: DataFrame, length: int, anchor: int) -> DataFrame:
    """(k1, k2, base, copied, start, size, a, f1, f2): all segments of the source's (k1, k2, base, copied, text); a: their anchor, f1, f2: their content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                cols: list[list] = [[] for _ in range(6)]
                for i, text in enumerate(utf8(part.column(4))):
                    if len(text) < length:
                        continue
                    start, size, a = segments(text, length, anchor)
                    f = b"".join(xxhash.xxh3_128_digest(text[s:e]) for s, e in zip(start.tolist(), (start + size).tolist(), strict=True))
                    f = np.frombuffer(f, "<i8").reshape(-1, 2)
                    for c, v in zip(cols, (np.full(len(start), i), start, size, a, f[:, 0], f[:, 1]), strict=True):
                        c.append(v)
                if cols[0]:
                    i, start, size, a, f1, f2 = map(np.concatenate, cols)
                    i = pa.array(i)
                    yield pa.record_batch([*(part.column(j).take(i) for j in range(4)), pa.array(start), pa.array(size.astype(np.int32)), pa.array(a), pa.array(f1), pa.array(f2)], ["k1", "k2", "base", "copied", "start", "size", "a", "f1", "f2"])

    return source.select("k1", "k2", "base", "copied", "text").mapInArrow(tidy(run), f"{PLACE}, copied boolean, start long, size int, a long, f1 long, f2 long")


def _anchors(texts: DataFrame, length: int, anchor: int) -> DataFrame:
    """(a): the anchors with more than one segment, whole copies in a batch counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[bytes] = set()
            found = []
            for text in utf8(batch.column(0)):
                if len(text) >= length and (d := hashlib.blake2b(text, digest_size=16).digest()) not in seen:
                    seen.add(d)
                    found.append(segments(text, length, anchor)[2])
            if found:
                a, c = np.unique(np.concatenate(found), return_counts=True)
                yield pa.record_batch([pa.array(a), pa.array(c)], ["a", "c"])

    return texts.select("text").mapInArrow(tidy(run), "a long, c long").groupBy("a").agg(F.sum("c").alias("c")).filter("c > 1").select("a")


def _indexed(parts: DataFrame, length: int) -> DataFrame:
    """(k1, k2, start, size): the covered stretches of the segments (a, multi, k1, k2, base, start, seg) that share windows with others of their anchor.

    Anchors are brought together by hash and read in order, some at a time, so that an index takes about INDEX_BYTES.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def marked() -> pa.RecordBatch:
            distinct: dict[bytes, list[tuple]] = {}
            for row in held:
                distinct.setdefault(row[5], []).append(row)
            out = []
            for seg, flags in zip(distinct, repeated(list(distinct), length), strict=True):
                for row in distinct[seg]:
                    if not row[1]:
                        out += [(row[2], row[3], row[4] + s, n + length - 1) for s, n in _ranges(flags if len(distinct[seg]) == 1 else np.ones_like(flags))]
            return pa.record_batch([pa.array(list(c), pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)], ["k1", "k2", "start", "size"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= INDEX_BYTES and row[0] != last:
                    yield marked()
                    held, size = [], 0
                held.append(row)
                last = row[0]
                size += len(row[5])
        if held:
            yield marked()

    rows = parts.select("a", "multi", "k1", "k2", (F.col("base") + F.col("start")).alias("start"), "seg")
    return rows.repartition("a").sortWithinPartitions("a").mapInArrow(tidy(run), f"{KEY}, start long, size long")


def repeated_ranges(texts: DataFrame, rows: DataFrame, length: int, anchors: tuple[int, ...], index_bytes: int) -> DataFrame:
    """(k1, k2, start, size): stretches that are covered by windows which also start elsewhere, for texts without whole copies.

    texts: (k1, k2, text); rows: (k1, k2, m, rep), m copies of the text, of which one is the representative.
    """
    reps = rows.filter("rep").select("k1", "k2", (F.col("m") > 1).alias("copied")).dropDuplicates(["k1", "k2"])
    source = texts.withColumns({"base": F.lit(0).cast("long"), "copied": F.lit(False)})
    found = []
    for level, anchor in enumerate(anchors):
        again = cut(_anchors(source, length, anchor))
        where = _segmented(source, length, anchor).join(again, "a")
        if not level:
            where = where.drop("copied").join(reps, ["k1", "k2"])
        where = cut(where)
        # Distinct segments; equal ones (anchor and content, 192 bits, agree) repeat as a whole
        kinds = where.groupBy("a", "f1", "f2").agg(F.count(F.lit(1)).alias("c"), F.max("copied").alias("copied"), *[F.first(x).alias(x) for x in ("k1", "k2", "base", "start", "size")])
        kinds = cut(kinds.withColumn("multi", (F.col("c") > 1) | F.col("copied")))
        whole = where.filter("not copied").join(kinds.filter("c > 1").select("a", "f1", "f2"), ["a", "f1", "f2"])
        found.append(whole.select("k1", "k2", (F.col("base") + F.col("start")).alias("start"), F.col("size").cast("long").alias("size")))
        mixed = kinds.groupBy("a").agg(F.count(F.lit(1)).alias("kinds"), F.sum((~F.col("multi")).cast("int")).alias("single"), F.sum("size").alias("bytes")).filter("kinds > 1 and single > 0")
        needs = kinds.join(mixed.select("a", "bytes"), "a").select("a", "bytes", "multi", "k1", "k2", "base", "start", "size")
        wanted = needs.groupBy("k1", "k2", "base").agg(F.collect_list(F.struct("start", "size", "a", "bytes", "multi")).alias("parts"))  # a text's own segments

        def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 128):
                    part = batch.slice(at, 128)
                    texts_, lists = list(unpacked(part.column(3))), part.column(4)
                    sizes = lists.value_lengths().to_pylist()
                    flat = lists.flatten()
                    start, size = flat.field("start").to_pylist(), flat.field("size").to_pylist()
                    i = [j for j, n in enumerate(sizes) for _ in range(n)]
                    seg = [texts_[j][s : s + n] for j, s, n in zip(i, start, size, strict=True)]
                    i = pa.array(i, pa.int64())
                    yield pa.record_batch([flat.field("a"), flat.field("bytes"), flat.field("multi"), *(part.column(j).take(i) for j in range(3)), flat.field("start"), pa.array(seg, pa.binary())], ["a", "bytes", "multi", "k1", "k2", "base", "start", "seg"])

        parts = packed(source).join(wanted, ["k1", "k2", "base"]).select("k1", "k2", "base", "z", "parts").mapInArrow(tidy(taken), f"a long, bytes long, multi boolean, {PLACE}, start long, seg binary")
        most = index_bytes if level < len(anchors) - 1 else sys.maxsize
        last = mixed.filter(F.col("bytes") > most).isEmpty()
        if not last:
            parts = written(parts)[0]  # read by this level's indexes and by the next level, without another shuffle of all texts
        found.append(_indexed(parts.filter(F.col("bytes") <= most), length))
        if last:
            break
        source = written(parts.filter(F.col("bytes") > most).select("k1", "k2", (F.col("base") + F.col("start")).alias("base"), F.col("multi").alias("copied"), F.col("seg").alias("text")))[0]
    return reduce(DataFrame.unionAll, found)


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchors: tuple[int, ...] = ANCHORS, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """Remove every byte covered by a string of `length` bytes that also starts anywhere else in the corpus.

    Texts are UTF-8 bytes, null counts as empty, matches stay inside a document but may be in the same one. All
    occurrences are removed, judged on the input.

    An index of the whole corpus would be one task's work, and would have to meet every document. Instead the windows of
    a text are dealt out by their anchor, the lowest hash of the strings inside: equal windows have equal anchors.
    Runs of windows with one anchor are segments; anchors that occur once are done, equal segments repeat as a whole. What is left,
    different segments of one anchor, goes to the anchor's task, where a run-compressed
    Burrows-Wheeler transform with sampled run ends gives the matching statistics, and matches of at
    least `length` are marked. The segments of anchors that have more than index_bytes of them are dealt out again by
    longer anchors, so that every index is small; the last anchor is the window itself, whose
    segments are all equal. Whole copies are told by digest, so a group of copies of any size counts once.
    anchors: widths, multiples of eight, growing up to length.

    A text with copies and at least `length` bytes is removed whole. Shorter texts stay. Rows with the same id
    and text are copies; an empty table gives an empty result; other columns don't matter.

    Returns id_col, kept (binary), n_bytes, n_removed, n_spans.
    """
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    source = source.withColumn("k1", F.xxhash64("id", "text")).withColumn("k2", F.xxhash64("text", F.lit("id"), "id"))
    rows = cut(source.select("k1", "k2", F.unhex(F.sha2("text", 256)).alias("sha")))
    groups = cut(rows.groupBy("sha").agg(F.count(F.lit(1)).alias("m"), F.min("k1").alias("r1")))
    rows = cut(rows.join(groups, "sha").select("k1", "k2", "m", (F.col("k1") == F.col("r1")).alias("rep")))
    texts = source.select("k1", "k2", "text")
    found = repeated_ranges(texts, rows, length, anchors, index_bytes)
    ranges = cut(found.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "size")).alias("ranges")))  # a text's own ranges
    about = rows.select("k1", "k2", "m").dropDuplicates(["k1", "k2"]).join(ranges, ["k1", "k2"], "left")
    id_type = source.schema["id"].dataType.simpleString()
    joined = packed(source, f"id {id_type}, {KEY}").join(about, ["k1", "k2"]).select("id", "z", "m", "ranges")

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                kept, n_bytes, n_removed, n_spans = [], [], [], []
                for text, m, spans in zip(unpacked(part.column(1)), part.column(2).to_pylist(), part.column(3), strict=True):
                    n = len(text)
                    if m > 1 and n >= length:
                        spans = [(0, n)]
                    elif spans.is_valid:
                        spans = sorted((x["start"], x["start"] + x["size"]) for x in spans.as_py())
                    else:
                        spans = []
                    merged: list[list[int]] = []
                    for a, b in spans:
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], b)
                        else:
                            merged.append([a, b])
                    pieces, last = [], 0
                    for a, b in merged:
                        pieces.append(text[last:a])
                        last = b
                    pieces.append(text[last:])
                    kept.append(b"".join(pieces))
                    n_bytes.append(n)
                    n_removed.append(n - len(kept[-1]))
                    n_spans.append(len(merged))
                yield pa.record_batch([part.column(0), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans))], ["id", "kept", "n_bytes", "n_removed", "n_spans"])

    return joined.mapInArrow(tidy(removed), f"id {id_type}, kept binary, n_bytes long, n_removed long, n_spans long").withColumnRenamed("id", id_col)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of all documents: 200-byte strings; kept bytes as a digest."""
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
