"""Best-fit packing of tokenized documents by linear grouping.

All decisions are made on the histogram of piece lengths, which has at most as many rows as a sequence
has tokens, however many documents there are. The pieces then look up their slots by rank.
"""

from __future__ import annotations

import bisect
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import bounded_batches, cut, table, tidy, utf8

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for the letters from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(256 + rest.index(b)) for b in rest}


class Chunks(dict):
    """Ids, as little-endian unsigned 32-bit bytes, of the stretches between ASCII white space.

    The tokenizer drops white space and lets no token, and no step of its normalisation, reach over it,
    so a text's ids are its stretches' ids in a row. It lower-cases, and sets letters and punctuation apart;
    a stretch with capitals, or with a full stop or comma after a letter, is therefore found through its parts.
    """

    def __init__(self, path: str, limit: int = 1_000_000) -> None:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        self.encode, self.tokenize = tok.encode, tok.model.tokenize
        self.letters, self.limit = _byte_letters(), limit

    def __missing__(self, chunk: bytes) -> bytes:
        if chunk[-1:] in b".," and chunk[-2:-1].isalpha():  # ASCII letters only
            ids = self[chunk[:-1]] + self[chunk[-1:]]
        elif not chunk.islower() and chunk.isalpha():
            ids = self[chunk.lower()]
        else:
            text = chunk.decode("utf-8", "replace")
            if text.isalpha() and max(text) < "\u0180" and text == text.lower() and len(text) > 1:
                # one word of small Latin letters, which are composed: the model's only piece
                ids = np.asarray([t.id for t in self.tokenize(chunk.decode("latin-1").translate(self.letters))], "<u4").tobytes()
            else:
                ids = np.asarray(self.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(chunk) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = ids
        return ids


@functools.lru_cache(1)
def chunks_of(path: str) -> Chunks:
    """One cache for all the tasks of a worker."""
    return Chunks(path)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """id_col, piece, start, length, ids_crc32: each document's ids and a final 0, cut every capacity tokens."""
    source = docs.select(F.col(id_col).alias("_pk_id"), F.col(text_col).alias("_pk_text"))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = chunks_of(tokenizer_path(tokenizer))
        get, step = chunks.__getitem__, 4 * capacity
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(utf8(batch.column(1))):
                ids = b"".join(map(get, text.split())) + b"\0\0\0\0"
                for k, a in enumerate(range(0, len(ids), step)):
                    part = ids[a : a + step]
                    row.append(i)
                    piece.append(k)
                    start.append(a // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.record_batch(columns, ["_pk_id", "piece", "start", "length", "ids_crc32"])

    id_type = source.schema["_pk_id"].dataType.simpleString()
    return source.mapInArrow(tidy(cut_up), f"_pk_id {id_type}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("_pk_id", id_col)


def _best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """The most valuable multiset of sizes that fits: an unbounded knapsack."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        fit = sizes <= room
        if fit.any():
            gain = np.where(fit, best[np.maximum(room - sizes, 0)] + values, -1.0)
            j = int(gain.argmax())
            if gain[j] > best[room] + 1e-12:
                best[room], last[room] = gain[j], j
    count, room = [0] * len(sizes), capacity
    while room > 0:
        if (j := int(last[room])) < 0:
            room -= 1
        else:
            count[j] += 1
            room -= int(sizes[j])
    return float(best[capacity]), count


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 200) -> list[tuple[list[int], int]]:
    """Configurations of a few sizes and how often to use each: the cutting-stock programme by column
    generation, rounded down; what is left over is configured first-fit."""
    s, d = np.asarray(sizes), np.asarray(demand, float)
    n = len(sizes)
    columns = [[capacity // sizes[j] if i == j else 0 for i in range(n)] for j in range(n)]
    basis = np.array(columns, float).T
    x = np.linalg.solve(basis, d)
    for _ in range(rounds):
        duals = np.linalg.solve(basis.T, np.ones(n))
        value, column = _best_pattern(s, np.maximum(duals, 0.0), capacity)
        if value <= 1 + 1e-7:
            break
        direction = np.linalg.solve(basis, np.asarray(column, float))
        ratio = np.full(n, np.inf)
        np.divide(x, direction, out=ratio, where=direction > 1e-9)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        x = np.linalg.solve(basis, d)
    used, left = [], list(demand)
    for j in np.argsort(-x):
        pattern = [int(round(v)) for v in basis[:, j]]
        times = min([int(x[j] + 1e-9), *(left[i] // p for i, p in enumerate(pattern) if p)])
        if times > 0:
            used.append((pattern, times))
            left = [a - times * p for a, p in zip(left, pattern, strict=True)]
    order = sorted(range(n), key=lambda i: -sizes[i])
    while any(left):
        pattern, room = [0] * n, capacity
        for i in order:
            pattern[i] = min(left[i], room // sizes[i])
            room -= pattern[i] * sizes[i]
        times = min(left[i] // p for i, p in enumerate(pattern) if p)
        used.append((pattern, times))
        left = [a - times * p for a, p in zip(left, pattern, strict=True)]
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 40, large: int | None = None) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots for a histogram of lengths, and the number of sequences.

    A slot row (length, rank, count, sequence, offset) sends the pieces of that length whose rank is in
    [rank, rank + count) to as many sequences in a row, each at the offset.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    taken: dict[int, int] = {}
    sequences = 0

    def put(length: int, count: int, sequence: int, offset: int) -> None:
        slots.append((length, taken.get(length, 0), count, sequence, offset))
        taken[length] = taken.get(length, 0) + count

    if n := histogram.get(capacity, 0):
        put(capacity, n, 0, 0)
        sequences = n
    large = capacity // 8 if large is None else large
    big = sorted((x for x in histogram if large < x < capacity and histogram[x]), reverse=True)
    # Equal-cardinality groups of the large lengths, from the largest down; each rounds up to its first.
    total = sum(histogram[x] for x in big)
    members: list[list[list[int]]] = []
    if total:
        each, room = -(-total // groups), 0
        for x in big:
            n = histogram[x]
            while n:
                if not room:
                    members.append([])
                    room = each
                now = min(n, room)
                members[-1].append([x, now])
                n -= now
                room -= now
    by_size: dict[int, list[list[int]]] = {}
    for group in members:
        by_size.setdefault(group[0][0], []).extend(group)
    sizes = sorted(by_size, reverse=True)
    queues = [by_size[x][::-1] for x in sizes]
    runs: list[list[int]] = []  # [free, first sequence, count]
    if sizes:
        for pattern, times in configurations(sizes, [sum(c for _, c in by_size[x]) for x in sizes], capacity):
            flat = [i for i, p in enumerate(pattern) for _ in range(p)]
            parts = []
            for i in flat:  # actual lengths take the places of the rounded one, `times` for every place
                need, got = times, []
                while need:
                    x, n = queues[i][-1]
                    now = min(n, need)
                    got.append((x, now))
                    need -= now
                    queues[i][-1][1] -= now
                    if not queues[i][-1][1]:
                        queues[i].pop()
                parts.append(got)
            done = 0
            heads = [[0, 0] for _ in parts]
            while done < times:
                step = min(parts[p][h[0]][1] - h[1] for p, h in enumerate(heads))
                offset = 0
                for p, h in enumerate(heads):
                    x = parts[p][h[0]][0]
                    put(x, step, sequences, offset)
                    offset += x
                    h[1] += step
                    if h[1] == parts[p][h[0]][1]:
                        h[0], h[1] = h[0] + 1, 0
                runs.append([capacity - offset, sequences, step])
                sequences += step
                done += step
    # Best fit of the small lengths, largest first, into what the actual lengths leave free.
    free: dict[int, list[list[int]]] = {}
    for room, first, count in runs:
        if room:
            free.setdefault(room, []).append([first, count])
    rooms = sorted(free)
    for x in sorted((x for x in histogram if x <= large and x < capacity and histogram[x]), reverse=True):
        n = histogram[x]
        while n:
            at = bisect.bisect_left(rooms, x)
            if at == len(rooms):
                fit = capacity // x
                count = -(-n // fit)
                free.setdefault(capacity, []).append([sequences, count])
                rooms.append(capacity)
                sequences += count
                continue
            room = rooms[at]
            first, count = free[room].pop()
            # in each of these sequences as many of this length as fit, while there are enough
            fit = max(1, min(room // x, n // count)) if n >= count else 1
            now = min(count, n)
            for k in range(fit):
                put(x, now, first, capacity - room + k * x)
            n -= fit * now
            if now < count:
                free[room].append([first + now, count - now])
            elif not free[room]:
                del free[room]
                rooms.pop(at)
            if rest := room - fit * x:
                if rest not in free:
                    bisect.insort(rooms, rest)
                free.setdefault(rest, []).append([first, now])
    return slots, sequences


def best_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """The plan with the fewest sequences of those that call lengths over a quarter, three eighths or a half of a sequence large.

    What counts as large trades configured places against small documents that fill up; the histogram tells which does best.
    """
    least = -(-sum(x * n for x, n in histogram.items()) // capacity)
    found = None
    for large in (capacity // 4, capacity * 3 // 8, capacity // 2):
        now = plan(histogram, capacity, large=large)
        if found is None or now[1] < found[1]:
            found = now
        if found[1] <= least:
            break
    return found


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, salts: int = 64) -> DataFrame:
    """Place every piece of every document in a sequence of at most capacity tokens.

    Only documents longer than a sequence are cut. Large lengths are split into groups of equal
    cardinality, each rounded up to its largest; configurations of these few sizes are optimised; actual
    documents take the places; the small ones are best-fitted into the room left. Of three ideas of what is large, the one with the fewest sequences is taken. Pieces find their slot
    by their rank among the pieces of their length: a rank within (length, salt), salted as one length may
    hold many rows, and the salts' prefix sum. The driver sees the histogram, capacity x salts rows at most; the
    slot table is joined by length and rank range, its rows are bounded by the plan, not by the documents.

    Null and empty texts are one token, the final 0. Repeated rows are packed each on its own; an empty table packs to
    no rows; other columns don't matter.

    Returns id_col, piece, start, length, ids_crc32, sequence_id, offset.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    cut_up = cut(pieces(docs, id_col=id_col, text_col=text_col, capacity=capacity, tokenizer=tokenizer).withColumn("_pk_salt", F.pmod(F.xxhash64(id_col, "piece"), F.lit(salts)).cast("int")))
    counts = cut_up.groupBy("length", "_pk_salt").agg(F.count(F.lit(1)).alias("n")).collect()
    histogram: dict[int, int] = {}
    starts = []
    for length, salt, n in sorted(tuple(r) for r in counts):
        starts.append((length, salt, histogram.get(length, 0)))
        histogram[length] = histogram.get(length, 0) + n
    slots, _ = best_plan(histogram, capacity)
    # slots of a length as parallel arrays, sorted by rank; at most capacity rows
    by_length: dict[int, list[tuple[int, int, int]]] = {}
    for length, rank, _, sequence, offset in slots:
        by_length.setdefault(length, []).append((rank, sequence, offset))
    lookup = [(x, [r[0] for r in sorted(v)], [r[1] for r in sorted(v)], [r[2] for r in sorted(v)]) for x, v in by_length.items()]
    bases: dict[int, list[int]] = {x: [0] * salts for x in histogram}
    for length, salt, start in starts:
        bases[length][salt] = start

    ranked = cut_up.withColumn("_pk_rank", F.row_number().over(W.partitionBy("length", "_pk_salt").orderBy(id_col, "piece", "ids_crc32")) - 1)
    shared = spark.sparkContext.broadcast((bases, {x: (np.array(r, np.int64), np.array(q, np.int64), np.array(o, np.int64)) for x, r, q, o in lookup}))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases, slots = shared.value
        for batch in batches:
            length, salt, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_pk_salt", "_pk_rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                rank_at = np.asarray(bases[int(x)], np.int64)[salt[at]] + rank[at]
                ranks, first, place = slots[int(x)]
                k = np.searchsorted(ranks, rank_at, "right") - 1
                sequence[at] = first[k] + rank_at - ranks[k]
                offset[at] = place[k]
            yield pa.record_batch([batch.column(i) for i in range(5)] + [pa.array(sequence), pa.array(offset)], [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    id_type = cut_up.schema[id_col].dataType.simpleString()
    return ranked.select(id_col, "piece", "start", "length", "ids_crc32", "_pk_salt", "_pk_rank").mapInArrow(place, f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
