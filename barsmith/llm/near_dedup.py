"""Near duplicates by bottom-k sketches of one hash function."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import bounded_batches, table, tidy, utf8, written

#: Hash values a sketch keeps; the first INDEXED of them make the inverted lists of all documents, the first COMPARED the estimate.
KEPT, INDEXED, COMPARED = 64, 12, 32
#: A list of at most so many documents is short: all its pairs are candidates.
SHORT = 16
#: The probability, over hash functions, with which a link may fail a step that looks at sketches only.
MISS = 1e-8
#: Hash values in a block of those documents that are compared one by one.
BLOCK_VALUES = 200_000
#: Ids of documents to verify are broadcast up to this number, 16 MB; joined beyond it.
MOST_BROADCAST = 2_000_000


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


class WordHashes(dict):
    def __init__(self, limit: int = 400_000) -> None:
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """The distinct hashes, under 2 ** 63 and sorted, of the shingles of a word sequence; the whole of a shorter one is its one shingle."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    take = min(width, n)
    with np.errstate(over="ignore"):
        x = np.full(n - take + 1, np.uint64(take))
        for i in range(take):
            part = hashes[i : n - take + 1 + i]
            x = (x ^ (part * _MUL[i % 8])) * _MUL[(i + 3) % 8]
            x ^= x >> np.uint64(29)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return np.unique((x >> np.uint64(1)).astype(np.int64))


def shingle_counts(a: list[bytes], b: list[bytes], width: int) -> tuple[int, int]:
    """Sizes of intersection and union of two shingle sets, on the words themselves."""
    number: dict[bytes, int] = {}
    sets = []
    for w in (a, b):
        ids = [number.setdefault(x, len(number)) for x in w]
        if not ids:
            sets.append(set())
        elif len(ids) < width:
            sets.append({tuple(ids)})
        else:
            sets.append(set(zip(*(ids[i:] for i in range(width)), strict=False)))
    both = len(sets[0] & sets[1])
    return both, len(sets[0]) + len(sets[1]) - both


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, n (size of the shingle set), key (digest of the word sequence), sketch (the lowest KEPT hashes, sorted)."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        get = cache.__getitem__
        for batch in batches:
            n, key, sketch = [], [], []
            for text in utf8(batch.column(1)):
                w = words(text)
                found = shingle_hashes(np.fromiter(map(get, w), np.uint64, len(w)), width)
                n.append(len(found))
                key.append(hashlib.blake2b(b" ".join(w), digest_size=16).digest())
                sketch.append(found[:KEPT])
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sketch, pa.list_(pa.int64()))], ["id", "n", "key", "sketch"])

    return source.mapInArrow(tidy(run), "id long, n long, key binary, sketch array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """id, n, v (all hashes, sorted) of documents given as id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = WordHashes().__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_hashes(np.fromiter(map(get, w), np.uint64, len(w)), width) for w in map(words, utf8(part.column(1)))]
                yield pa.record_batch([part.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["id", "n", "v"])

    return docs.select("id", "text").mapInArrow(tidy(run), "id long, n long, v array<long>")


def upper_tail(trials: int, p: float, miss: float) -> int:
    """The smallest x that a binomial variable reaches with a probability of at most miss."""
    total = 0.0
    for x in range(trials, -1, -1):
        total += math.comb(trials, x) * p**x * (1 - p) ** (trials - x)
        if total > miss:
            return x + 1
    return 0


def _alike(a: Column, b: Column, percent: int) -> Column:
    """Set sizes that the similarity allows."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


class _Links:
    """The components that verified links make, so far. Every step is a written table: joins then know sizes, and small sides are broadcast."""

    def __init__(self, docs: DataFrame, reps: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> None:
        self.texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        self.reps, self.width, self.percent = reps, width, percent
        self.labels: DataFrame | None = None

    def labelled(self, rows: DataFrame, col: str, out: str) -> DataFrame:
        """rows with the component of col; a document without links is its own."""
        if self.labels is None:
            return rows.withColumn(out, F.col(col))
        labels = self.labels.select(F.col("id").alias(col), F.col("comp").alias("_comp"))
        return rows.join(labels, col, "left").withColumn(out, F.coalesce("_comp", col)).drop("_comp")

    def add(self, pairs: DataFrame) -> None:
        """Estimate, verify and take in candidate pairs (a, b); pairs already in a component are not looked at."""
        pairs = self.labelled(self.labelled(pairs.distinct(), "a", "ca"), "b", "cb").filter("ca <> cb")
        short = self.reps.select("id", "n", F.slice("sketch", 1, COMPARED).alias("s"))
        pairs = pairs.join(short.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa")), "a")
        pairs = pairs.join(short.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb")), "b").filter(_alike(F.col("na"), F.col("nb"), self.percent))
        # whole sets are told exactly; else by the union's sketch, and how much of it is in both
        both = F.size(F.array_intersect("sa", "sb"))
        whole = F.greatest("na", "nb") <= COMPARED
        union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, COMPARED)
        shared = F.size(F.array_intersect(F.array_intersect("sa", "sb"), "u"))
        least = COMPARED + 1 - upper_tail(COMPARED, 1 - self.percent / 100, MISS)
        pairs = pairs.withColumn("u", union).filter(F.when(whole, both * 100 >= (F.col("na") + F.col("nb") - both) * self.percent).otherwise(shared >= least))
        pairs, drop = written(pairs.select("a", "b", "ca", "cb"))
        if not pairs.isEmpty():
            self.take(self.verified(pairs))
        drop()

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The components (ca, cb) of the pairs whose full shingle sets are alike enough."""
        needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        texts, drop = written(self.texts.join(F.broadcast(needed) if pairs.count() * 2 <= MOST_BROADCAST else needed, "id", "left_semi"))
        width, percent = self.width, self.percent
        joined = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("ca", "cb", "ta", "tb")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = []
                for x, y in zip(utf8(batch.column(2)), utf8(batch.column(3)), strict=True):
                    both, union = shingle_counts(words(x), words(y), width)
                    good.append(both > 0 and 100 * both >= percent * union)
                yield pa.record_batch([batch.column(0), batch.column(1)], ["ca", "cb"]).filter(pa.array(good, pa.bool_()))

        good, _ = written(joined.mapInArrow(tidy(run), "ca long, cb long").distinct())
        drop()
        return good

    def take(self, links: DataFrame) -> None:
        """Merge the components that links (ca, cb) join."""
        if links.isEmpty():
            return
        merged = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        if self.labels is None:
            self.labels = merged
            return
        to = merged.select(F.col("id").alias("comp"), F.col("comp").alias("to"))
        moved = self.labels.join(to, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
        new = merged.join(self.labels.select("id"), "id", "left_anti").select("id", "comp")
        self.labels, _ = written(moved.unionAll(new))


def components(links: DataFrame) -> DataFrame:
    """(id, comp): the smallest id that links reach. Labels travel along the links and to their label's label; every round is a written table."""
    both, drop_both = written(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels, drop = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")))
    total = labels.agg(F.sum(F.col("comp").cast("decimal(38,0)"))).head()[0]  # falls with every change
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").select(F.col("a").alias("id"), "comp")
        jump = labels.select("id", F.col("comp").alias("at")).join(labels.select(F.col("id").alias("at"), "comp"), "at").select("id", "comp")
        moved, drop_moved = written(near.unionAll(jump).groupBy("id").agg(F.min("comp").alias("comp")))
        drop()
        labels, drop = moved, drop_moved
        now = labels.agg(F.sum(F.col("comp").cast("decimal(38,0)"))).head()[0]
        if now == total:
            break
        total = now
    drop_both()
    return labels


def _lists(entries: DataFrame) -> DataFrame:
    """(v, id, n, c, hub): the inverted lists, of two documents or more, of entries (id, n, v); c documents, of which hub has the smallest id."""
    sizes, drop = written(entries.groupBy("v").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("hub")).filter("c > 1"))
    lists, _ = written(entries.join(sizes, "v"))
    drop()
    return lists


def _short_pairs(lists: DataFrame, percent: int) -> DataFrame:
    members = lists.filter(F.col("c") <= SHORT).groupBy("v").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("l"))
    fits = f"least(x.n, y.n) * 100 >= greatest(x.n, y.n) * {percent}"
    pairs = f"flatten(transform(l, (x, i) -> transform(filter(slice(l, i + 2, {SHORT}), y -> {fits}), y -> struct(x.id as a, y.id as b))))"
    return members.select(F.explode(F.expr(pairs)).alias("p")).select("p.a", "p.b").filter("a <> b")


def _listed(state: _Links, entries: DataFrame) -> DataFrame:
    """Take in the candidates of the inverted lists of entries: every document with its list's hub, and all pairs of short lists. Returns the lists."""
    lists = _lists(entries)
    hubs = lists.filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    state.add(hubs.unionAll(_short_pairs(lists, state.percent)))
    return lists


def _unsafe(docs: DataFrame, lists: DataFrame, ranks: int, percent: int) -> DataFrame:
    """Of docs, whose values up to a rank made the lists, those that may have links the lists didn't show.

    A link that no short list shows has only common values (those of long lists) among the `ranks` lowest of the union that
    are in both sets. Then a document's own values in short lists are at most as many as the union's lowest that are
    in one set alone, and at most the symmetric difference. So a document with more than
    n (1 - s) / s of them is safe for certain, and one with as many as a binomial variable of `ranks` trials and
    probability 1 - s reaches with a chance of MISS is safe but for that chance, whatever is common to its text and others.
    """
    common = lists.filter(F.col("c") > SHORT).groupBy("id").agg(F.count(F.lit(1)).alias("common"))
    rare = F.size(F.slice("sketch", 1, ranks)) - F.col("common")
    need = F.least(F.lit(upper_tail(ranks, 1 - percent / 100, MISS)), F.floor(F.col("n") * (100 - percent) / percent) + 1)
    return written(docs.join(common, "id").filter(rare < need).select("id", "n", "sketch"))[0]


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(id, n, v): the values of each full set that an alike set must share one of, rare values first.

    Sets that are alike share at least n * percent / 100 of either's values, so they meet in the first n - that + 1 values of
    one order of all values; here the number of sets that hold a value, then the value. Values of one set only take their places and are left out.
    """
    entries = sets.select("id", "n", F.explode("v").alias("v"))
    held = entries.groupBy("v").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    own = W.partitionBy("id")
    ranked = entries.join(held, "v").withColumn("k", F.row_number().over(own.orderBy("f", "v"))).withColumn("m", F.count(F.lit(1)).over(own))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    return written(ranked.filter(F.col("k") <= prefix - (F.col("n") - F.col("m"))).select("id", "n", "v"))[0]


def _stragglers(state: _Links, sets: DataFrame, lists: DataFrame) -> DataFrame:
    """Pairs that are alike, of documents that share a hub by a long list and not a component, with one outside the hub's largest component.

    Documents that share a value share its hub. A hub's documents fall into classes of like set size, and classes into
    blocks of about BLOCK_VALUES values; blocks of outsiders meet the blocks of the same and the neighbouring classes,
    so a task holds the hashes of two blocks, and only pairs that are alike come out.
    """
    percent = state.percent
    members = lists.filter(F.col("c") > SHORT).select("hub", "id", "n").distinct()
    placed = written(state.labelled(members, "id", "comp").withColumn("s", F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int")))[0]
    hubs = placed.groupBy("hub", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("hub").agg(F.max_by("comp", F.struct("k", "comp")).alias("top"), F.count(F.lit(1)).alias("comps")).filter("comps > 1").select("hub", "top")
    rows = written(placed.join(hubs, "hub").withColumn("out", F.col("comp") != F.col("top")).drop("top"))[0]
    blocks = rows.groupBy("hub", "s").agg(F.ceil(F.sum("n") / BLOCK_VALUES).cast("int").alias("n_in"), F.ceil(F.sum(F.when(F.col("out"), F.col("n"))) / BLOCK_VALUES).cast("int").alias("n_out"))
    outer = blocks.filter("n_out > 0").select("hub", F.col("s").alias("so"), "n_out", F.explode(F.array(F.col("s") - 1, F.col("s"), F.col("s") + 1)).alias("s"))
    cells = written(blocks.select("hub", "s", "n_in").join(outer, ["hub", "s"]))[0]
    rows = rows.join(sets.select("id", "v"), "id")
    # columns of the outside get attributes of their own: both sides come from the same rows
    inside = rows.join(cells, ["hub", "s"]).select("hub", "id", "comp", "v", "s", F.pmod(F.xxhash64("id"), "n_in").cast("int").alias("i"), "so", F.explode(F.sequence(F.lit(0), F.col("n_out") - 1)).alias("o"))
    outside = rows.filter("out").withColumnRenamed("s", "so").join(cells, ["hub", "so"]).select(*[F.col(c).alias(c) for c in ("hub", "id", "comp", "v", "s")], F.explode(F.sequence(F.lit(0), F.col("n_in") - 1)).alias("i"), F.col("so").alias("so"), F.pmod(F.xxhash64("id"), "n_out").cast("int").alias("o"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[np.ndarray] = [np.zeros((2, 0), np.int64)]
        if left.num_rows and right.num_rows:
            v = right.column("v").combine_chunks()
            size = v.value_lengths().to_numpy()
            every = v.flatten().to_numpy()
            order = np.argsort(every, kind="stable")
            every, owner = every[order], np.repeat(np.arange(len(size)), size)[order]
            yi, yc = right.column("id").to_numpy(), right.column("comp").to_numpy()
            for x, i, c in zip(left.column("v"), left.column("id").to_pylist(), left.column("comp").to_pylist(), strict=True):
                x = x.values.to_numpy()
                low, high = np.searchsorted(every, x, "left"), np.searchsorted(every, x, "right")
                n = high - low
                at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(size))
                y = yi[(100 * both >= percent * (len(x) + size - both)) & (yc != c)]
                found.append(np.stack([np.minimum(y, i), np.maximum(y, i)]))
        a, b = np.concatenate(found, 1)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    cell = ["hub", "s", "i", "so", "o"]
    return outside.groupBy(*cell).cogroup(inside.groupBy(*cell)).applyInArrow(compare, "a long, b long")


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Each document with its component of near duplicates.

    A document's set holds its distinct shingles of `width` words, lower-cased A to Z, words split at ASCII white
    space; the whole sequence is the one shingle of a shorter text. Documents are linked when
    100 * intersection >= percent * union, on full sets; component_id is the smallest id reachable.

    Texts of one word sequence are one representative (by partial aggregates, so copies never meet as pairs). The
    lowest values of one hash function form each representative's sketch; values list the documents that
    retain them. Every list links its documents to its hub (the smallest id) if they are alike: candidates are
    filtered by the estimate from the union's sketch, then verified on the texts, and pairs of one
    component are not looked at again. Lists of at most SHORT documents then give all their other pairs. A
    link that is missed now joins two documents most of whose values are common (_unsafe). These go through the
    lists of their whole sketches, among themselves; what is still unsafe after that through the lists of full sets' prefixes, rare
    values first, which show every link in a short list or a long one. Of the documents that share a long list's hub, every
    one outside the hub's largest component is compared with those of other components, on
    full sets of hashes, block by block. So groups of any size take a number of candidates in
    proportion to their documents, only documents that resist linking are compared one by one, and no link is lost but by
    the sketches' chance, MISS a step.

    Null, empty and blank texts have an empty set and are alone. Rows that share an id are one document. Rows with a
    null id are alone, with null as component and kept false. An empty table gives an empty result; other columns don't matter.

    Returns id_col, n_shingles, component_id, kept.
    """
    bounded_batches(docs.sparkSession)
    rows, _ = written(sketches(docs, id_col, text_col, width))
    reps, _ = written(rows.filter("n > 0 and id is not null").groupBy("key").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.min_by("sketch", "id").alias("sketch")))
    state = _Links(docs, reps, id_col, text_col, width, percent)
    rest = reps
    for ranks in (INDEXED, KEPT):
        lists = _listed(state, rest.select("id", "n", F.explode(F.slice("sketch", 1, ranks)).alias("v")))
        rest = _unsafe(rest, lists, ranks, percent)
        if rest.isEmpty():
            break
    else:
        few = rest.select("id")
        few = F.broadcast(few) if rest.count() <= MOST_BROADCAST else few
        sets, _ = written(full_sets(state.texts.join(few, "id", "left_semi"), width).distinct())  # an id with several texts has several sets
        lists = _listed(state, _prefixes(sets, percent))
        if not lists.filter(F.col("c") > SHORT).isEmpty():
            state.add(_stragglers(state, sets, lists))
    by_key = state.labelled(reps.select("id", "key"), "id", "comp").select("key", "comp")
    out = rows.select("id", "n", "key").join(by_key, "key", "left")
    component = F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(component)
    id_type = docs.schema[id_col].dataType
    return out.select(F.col("id").cast(id_type).alias(id_col), F.col("n").alias("n_shingles"), component.cast(id_type).alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's shingles have four words."""
    return near_groups(table(spark, sf_dir, "documents"), width=4)
