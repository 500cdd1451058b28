"""Toxic spans by a linear-chain conditional random field, and the document scores they add up to."""

from __future__ import annotations

import heapq
import pickle
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WORD, bounded_batches, cut, table, tidy, utf8

#: Tokens of a block: a text's blocks are worked on side by side, and messages carried from one to the next.
BLOCK = 64
SAMPLE_DOCS = 5000
SAMPLE_BYTES = 25_000_000
LEXICON = 20_000
#: Features that a model keeps, those with the largest weights.
FEATURES = 50_000
#: Scores from here on say toxic.
THRESHOLD = 0.3
STRIP = b".,;:!?\"'()[]{}<>*_-\xc2\xab\xbb"


def held_out(doc_id: Any) -> bool:
    """Rows whose label is never learnt from."""
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def words(text: bytes) -> list[bytes]:
    """Lower-case stretches between ASCII white space."""
    return text.lower().split() if text.isascii() else text.decode("utf-8", "replace").lower().encode().split()


_TOKEN = re.compile(WORD)


@dataclass
class Model:
    """feature: weight by feature of a token; bias; trans[a, b]; document logistic's weights. State 1 is toxic; state 0 scores 0."""

    feature: dict[bytes, float]
    bias: float
    trans: np.ndarray
    document: np.ndarray


#: Lengths of the word beginnings that may stand for a family of words.
STEMS = (7, 6, 5, 4)


def forms(word: bytes) -> list[bytes]:
    """A word and its beginnings, the most particular first."""
    text = word.decode("utf-8", "replace")
    return [word, *((text[:n] + "*").encode() for n in STEMS if len(text) > n)]


def traits(raw: bytes) -> list[bytes]:
    """What a token's emission sees of itself: its word, the word's first and last three to five bytes, and its shape."""
    word = raw.strip(STRIP)
    n = len(word)
    shape = b"s%d%d%d%d%d" % (min(n, 20) // 4, word.isalpha(), word.isdigit(), word.isascii(), raw == word)
    out = [b"w" + word, shape]
    if n > 3:
        out += (b"<" + word[:3], word[-3:] + b">")
        if n > 4:
            out += (b"<" + word[:4], word[-4:] + b">")
            if n > 5:
                out += (b"<" + word[:5], word[-5:] + b">")
    return out


def beside(raw: bytes) -> tuple[bytes, bytes]:
    """What the next and the previous token's emissions see of a token."""
    word = raw.strip(STRIP)
    return b"p" + word, b"n" + word


class Emissions(dict):
    """Lower-case stretch of text to its number; scores[number] holds what it adds to its own emission, the next one's and the previous one's."""

    def __init__(self, model: Model, limit: int = 400_000) -> None:
        self.model, self.limit, self.scores = model, limit, array("d")

    def __missing__(self, raw: bytes) -> int:
        get = self.model.feature.get
        after, before = beside(raw)
        self.scores.extend((self.model.bias + sum([get(f, 0.0) for f in traits(raw)]), get(after, 0.0), get(before, 0.0)))
        number = self[raw] = len(self)
        return number

    def of(self, words_: list[bytes]) -> np.ndarray:
        """The emission score of each word of a text."""
        if len(self) >= self.limit:
            self.clear()
            self.scores = array("d")
        numbers = np.fromiter(map(self.__getitem__, words_), np.int64, len(words_))
        return together(np.frombuffer(self.scores).reshape(-1, 3)[numbers] if len(words_) else np.zeros((0, 3)))


def together(scores: np.ndarray) -> np.ndarray:
    """Emissions of a text's tokens from their own scores and their neighbours'."""
    out = scores[:, 0].copy()
    out[1:] += scores[:-1, 1]
    out[:-1] += scores[1:, 2]
    return np.clip(out, -25, 25)


def forward_backward(emits: list[np.ndarray], trans: np.ndarray, block: int = BLOCK) -> tuple[list[np.ndarray], np.ndarray]:
    """P(state 1) of each token of each chain, and the expected transitions over all chains. State 0 emits 0.

    A chain is cut into blocks. All blocks' transfer matrices are built side by side, a token a step; the
    messages into each block are carried along its chain by these, a block a step; then the messages inside run side by side. So the
    result is that of the whole chain, whatever its length.
    """
    sizes = np.array([len(e) for e in emits], np.int64)
    counts = -(-sizes // block)
    n, first = int(counts.sum()), np.cumsum(counts) - counts
    if not n:
        return [np.zeros(0) for _ in emits], np.zeros((2, 2))
    start = np.cumsum(sizes) - sizes
    at = np.repeat(first * block - start, sizes) + np.arange(sizes.sum())
    e, mask = np.ones(n * block), np.zeros(n * block, bool)
    e[at], mask[at] = np.exp(np.concatenate(emits)), True
    e, mask = np.ascontiguousarray(e.reshape(n, block).T), np.ascontiguousarray(mask.reshape(n, block).T)
    (a, b), (c, d) = np.exp(trans)  # 0->0, 0->1, 1->0, 1->1
    opens = np.zeros(n, bool)
    opens[first[counts > 0]] = True

    into = np.ones((n, 2))  # forward message before a block
    after = np.ones((n, 2))  # backward message behind it
    longest = int(counts.max())
    if longest > 1:
        m = np.empty((4, n))  # rows of the matrix one after the other
        m[0], m[1], m[2], m[3] = np.where(opens, 1.0, a), np.where(opens, 0.0, b) * e[0], np.where(opens, 0.0, c), np.where(opens, 1.0, d) * e[0]
        for i in range(1, block):
            new = np.stack([m[0] * a + m[1] * c, (m[0] * b + m[1] * d) * e[i], m[2] * a + m[3] * c, (m[2] * b + m[3] * d) * e[i]])
            m = np.where(mask[i], new / new.max(0), m)
        order = np.argsort(-counts, kind="stable")
        head, length = first[order], counts[order]
        for j in range(1, longest):
            row = head[: int(np.searchsorted(-length, -j))] + j  # chains with more than j blocks
            v, k = into[row - 1], m[:, row - 1]
            v = np.stack([v[:, 0] * k[0] + v[:, 1] * k[2], v[:, 0] * k[1] + v[:, 1] * k[3]], 1)
            into[row] = v / v.max(1, keepdims=True)
        for j in range(longest - 1, 0, -1):
            row = head[: int(np.searchsorted(-length, -j))] + j
            u, k = after[row], m[:, row]
            u = np.stack([k[0] * u[:, 0] + k[1] * u[:, 1], k[2] * u[:, 0] + k[3] * u[:, 1]], 1)
            after[row - 1] = u / u.max(1, keepdims=True)

    tiny = 1e-200
    fwd, bwd = np.empty((block, n)), np.empty((block, n))  # ratios of state 1 to 0, with and without the token's own emission
    enter = into[:, 1] / np.maximum(into[:, 0], tiny)
    x = np.where(opens, 1.0, (b + enter * d) / (a + enter * c)) * e[0]
    fwd[0] = x
    for i in range(1, block):
        x = (b + x * d) / (a + x * c) * e[i]
        fwd[i] = x
    y = after[:, 1] / np.maximum(after[:, 0], tiny)
    bwd[block - 1] = y
    for i in range(block - 2, -1, -1):
        z = y * e[i + 1]
        y = np.where(mask[i + 1], (c + d * z) / (a + b * z), y)
        bwd[i] = y
    both = fwd * bwd
    p = np.ascontiguousarray((both / (1 + both)).T).ravel()[at]

    before = np.concatenate([enter[None], fwd[:-1]])
    z = bwd * e
    linked = mask.copy()
    linked[0] &= ~opens
    s = np.stack([np.full_like(z, a), b * z, before * c, before * z * d])
    pairs = np.where(linked, s / s.sum(0), 0.0).sum((1, 2)).reshape(2, 2)
    return np.split(p, np.cumsum(sizes)[:-1]), pairs


def features(p: np.ndarray) -> np.ndarray:
    """What a document's score sees of its marginals: noisy-or, expected count, and share."""
    if not len(p):
        return np.array([1.0, 0.0, 0.0, 0.0])
    p = np.clip(p, 0, 1 - 1e-9)
    expected = p.sum()
    return np.array([1.0, 1 - np.exp(np.log1p(-p).sum()), np.log1p(expected), np.sqrt(expected / len(p))])


def _sigmoid(x: Any) -> Any:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Numbers(dict):
    """Stretch of text to its number; word: the number of the word in it, words being kept once."""

    def __init__(self) -> None:
        self.index: dict[bytes, int] = {}
        self.word: list[int] = []

    def __missing__(self, raw: bytes) -> int:
        self.word.append(self.index.setdefault(raw.strip(STRIP), len(self.index)))
        value = self[raw] = len(self)
        return value


def lexicon(docs: list[np.ndarray], vocabulary: list[bytes], y: np.ndarray, least: int) -> dict[bytes, float]:
    """Forms that occur in toxic documents far more than chance would have it, with their log odds.

    Forms are taken one at a time, the one that explains most first. Documents that it explains don't count for
    the others, so words that only stand beside toxic ones find no support. A form needs `least` documents of its own.
    """
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    number: dict[bytes, int] = {}
    ids = [[number.setdefault(f, len(number)) for f in forms(w)] if w else [] for w in vocabulary]
    first = np.cumsum([0, *map(len, ids)])
    flat = np.fromiter((i for x in ids for i in x), np.int32, first[-1])
    names = list(number)
    del ids, number
    held: list[np.ndarray] = []  # each document's distinct forms, by number
    for d in docs:
        w = np.unique(d)
        n = first[w + 1] - first[w]
        at = np.repeat(first[w] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(w) else np.zeros(0, np.int64)
        held.append(np.unique(flat[at]))
    sides = [[h for h, label in zip(held, y, strict=True) if bool(label) == side] for side in (False, True)]
    clean, toxic = (np.bincount(np.concatenate(s), minlength=len(names)) if s else np.zeros(len(names), np.int64) for s in sides)

    def worth(k: Any, c: Any) -> tuple[Any, Any]:
        r1, r0 = (k + 0.5) / (n1 + 1), (c + 0.5) / (n0 + 1)
        lift = np.log(r1 / (1 - r1 + 1e-9)) - np.log(r0 / (1 - r0 + 1e-9))
        return lift, lift * np.sqrt(k / (1 + c / max(n0, 1.0) * n1))

    some = np.flatnonzero((toxic >= least) & (worth(toxic, clean)[0] > 1.5))
    row = np.concatenate([np.full(len(h), i) for i, h in enumerate(sides[1])])
    form = np.concatenate(sides[1])
    of_some = np.isin(form, some)
    row, form = row[of_some], form[of_some]
    order = np.argsort(form, kind="stable")
    begin = np.searchsorted(form[order], some)
    where = {int(f): row[order[a : a + toxic[f]]] for f, a in zip(some, begin, strict=True)}
    still_open = np.ones(len(sides[1]), bool)
    # the score only falls as documents are explained, so an entry that is still first after a fresh look is the best
    heap = [(-float(worth(toxic[f], clean[f])[1]), -len(names[f].rstrip(b"*")), names[f], f) for f in where]
    heapq.heapify(heap)
    out: dict[bytes, float] = {}
    while heap and len(out) < LEXICON:
        _, size, name, f = heapq.heappop(heap)
        at = where[f][still_open[where[f]]]
        if len(at) < least:
            continue
        lift, now = worth(len(at), clean[f])
        if lift <= 1.5 or now < 6.0:
            continue
        if heap and -now > heap[0][0]:
            heapq.heappush(heap, (-float(now), size, name, f))
            continue
        out[name] = float(lift)
        still_open[at] = False
    # Words that always stand beside others of the list are explained by them, and still toxic: they are common there and all but absent from clean documents.
    often = max(4 * least, int(n1 / 50))
    shorter: set[tuple[bytes, int]] = set()  # beginnings that occur no more often than a listed form
    for k, name, f in sorted(((int(toxic[f]), names[f], f) for f in where if toxic[f] >= often), key=lambda x: (-x[0], -len(x[1].rstrip(b"*")), x[1])):
        lift = float(worth(k, clean[f])[0])
        kin = forms(name.rstrip(b"*"))
        if lift > 5.0 and len(out) < LEXICON and (name, k) not in shorter and not any(g in out for g in kin):
            out[name] = lift
        shorter.update((g, k) for g in kin if g in out or name in out)
    return out


def fit(texts: list[bytes], labels: list[int], rounds: int = 40, least: int = 5) -> Model:
    """Learn token labels from document labels, the field from the labelled tokens, and the document score.

    A token of a toxic document is labelled toxic when a form of its word is in the lexicon that the
    documents' labels give. The field's emissions are weights of a token's traits and of the words beside it; they and the
    transitions climb the labels' likelihood by its gradient, expected less observed counts over all tokens, scaled
    by Adam. So the lexicon labels the field's examples and no more: traits that listed words share tag words that it doesn't hold.
    """
    y = np.asarray(labels)
    if len(y) == 0 or y.min() == y.max():
        rate = (y.sum() + 1.0) / (len(y) + 2.0)
        return Model({}, -4.0, np.zeros((2, 2)), np.array([np.log(rate / (1 - rate)), 0, 0, 0]))
    numbers = Numbers()
    docs = [np.fromiter(map(numbers.__getitem__, w), np.int32, len(w)) for w in map(words, texts)]
    kinds, word = list(numbers), np.array(numbers.word, np.int32)
    vocabulary = list(numbers.index)
    del numbers
    seeds = lexicon([word[d] for d in docs], vocabulary, y, least)
    listed = np.fromiter((any(f in seeds for f in forms(w)) if w else False for w in vocabulary), bool, len(vocabulary))[word]
    sizes = np.array([len(d) for d in docs])
    tokens = np.concatenate(docs)
    tag = listed[tokens] & np.repeat(y == 1, sizes)
    ends = np.cumsum(sizes)
    opens, closes = np.zeros(len(tokens), bool), np.zeros(len(tokens), bool)
    opens[(ends - sizes)[sizes > 0]] = closes[(ends - 1)[sizes > 0]] = True

    # features: kinds of tokens by rows, numbers of their features by columns; 0 stands for none
    index: dict[bytes, int] = {b"": 0}
    own = [[index.setdefault(f, len(index)) for f in traits(k)] for k in kinds]
    wide = np.zeros((len(kinds), max(map(len, own))), np.int32)
    for i, f in enumerate(own):
        wide[i, : len(f)] = f
    after, before = (np.fromiter((index.setdefault(beside(k)[i], len(index)) for k in kinds), np.int32, len(kinds)) for i in (0, 1))
    names = list(index)
    seen = np.bincount(tokens, minlength=len(kinds))
    n_seen = np.bincount(wide.ravel(), weights=np.repeat(seen, wide.shape[1]), minlength=len(names)) + np.bincount(after, weights=seen, minlength=len(names)) + np.bincount(before, weights=seen, minlength=len(names))
    n_kinds = np.bincount(wide.ravel(), minlength=len(names))
    affix = np.fromiter((x[:1] == b"<" or x[-1:] == b">" for x in names), bool, len(names))
    near = np.fromiter((x[:1] in (b"p", b"n") for x in names), bool, len(names))
    usable = (n_seen >= least) & ~(affix & (n_kinds < 2))
    usable[0] = False
    ridge = np.where(affix, 4.0, np.where(near, 8.0, 0.5))

    weight, bias, trans = np.zeros(len(names)), np.log((tag.sum() + 1) / (len(tag) + 2)), np.zeros((2, 2))
    observed = np.zeros((2, 2))
    linked = ~opens[1:]
    for i in (0, 1):
        for j in (0, 1):
            observed[i, j] = ((tag[:-1] == i) & (tag[1:] == j) & linked).sum()
    follows, precedes = np.flatnonzero(~opens), np.flatnonzero(~closes)
    ahead, behind = tokens[follows - 1], tokens[precedes + 1]

    def marginals() -> tuple[list[np.ndarray], np.ndarray]:
        emit = (bias + weight[wide].sum(1))[tokens]
        emit[follows] += weight[after][ahead]
        emit[precedes] += weight[before][behind]
        return forward_backward(np.split(np.clip(emit, -25, 25), ends[:-1]), trans)

    moment = [np.zeros(len(names) + 5), np.zeros(len(names) + 5)]
    for step in range(1, rounds + 1):
        ps, pairs = marginals()
        miss = tag - np.concatenate(ps)
        by_kind = np.bincount(tokens, weights=miss, minlength=len(kinds))
        by_after = np.bincount(ahead, weights=miss[follows], minlength=len(kinds))
        by_before = np.bincount(behind, weights=miss[precedes], minlength=len(kinds))
        grad = np.bincount(wide.ravel(), weights=np.repeat(by_kind, wide.shape[1]), minlength=len(names))
        grad += np.bincount(after, weights=by_after, minlength=len(names)) + np.bincount(before, weights=by_before, minlength=len(names))
        grad = np.concatenate([np.where(usable, grad - ridge * weight, 0.0), [miss.sum()], (observed - pairs).ravel() - 0.5 * trans.ravel()])
        moment[0] = 0.9 * moment[0] + 0.1 * grad
        moment[1] = 0.99 * moment[1] + 0.01 * grad**2
        move = (moment[0] / (1 - 0.9**step)) / (np.sqrt(moment[1] / (1 - 0.99**step)) + 1e-6)
        move *= 0.5 * (1 - 0.9 * step / rounds)
        weight += move[: len(names)]
        bias += move[len(names)]
        trans = np.clip(trans + move[len(names) + 1 :].reshape(2, 2), -6, 6)
    best = np.argsort(-np.abs(weight), kind="stable")[:FEATURES]
    small = np.ones(len(names), bool)
    small[best] = False
    weight[small | (np.abs(weight) < 1e-3)] = 0.0
    model = Model({names[i]: float(weight[i]) for i in best if weight[i]}, float(bias), trans, np.zeros(4))
    x = np.stack([features(p) for p in marginals()[0]])
    beta = np.zeros(4)
    for _ in range(50):  # Newton steps with a ridge
        q = _sigmoid(x @ beta)
        grad = x.T @ (y - q) - 0.1 * beta * np.array([0, 1, 1, 1])
        hess = (x * (q * (1 - q))[:, None]).T @ x + np.diag([1e-6, 0.1, 0.1, 0.1])
        beta = beta + np.clip(np.linalg.solve(hess, grad), -2, 2)
    model.document = beta
    return model


def spans(text: bytes, p: np.ndarray, most: float = 0.5) -> list[tuple[int, int]]:
    """Code point offsets of maximal runs of tokens whose marginal is at least `most`."""
    out: list[tuple[int, int]] = []
    joined = False
    for token, q in zip(_TOKEN.finditer(text.decode("utf-8", "replace")), p, strict=True):
        if q >= most:
            out[-1:] = [(out[-1][0], token.end())] if joined else [*out[-1:], token.span()]
        joined = bool(q >= most)
    return out


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on a bounded sample of the labelled rows that aren't held out.

    The sample is the rows of each label whose ids hash lowest: sample_docs of them, half of either label as far as there
    are, and no more than sample_bytes of text, of which a fit takes the documents in hash order. A document's prior odds are put back after.
    """
    # crc32(id as text) mod 4 = 2 is held out, in DataFrame functions
    free = labels.filter(F.col(label_col).isin(0, 1) & (F.crc32(F.col(id_col).cast("string")) % 4 != 2))
    free = free.groupBy(id_col).agg(F.max(label_col).alias("y"))
    sizes = {r["y"]: r["count"] for r in free.groupBy("y").count().collect()}
    if not sizes:
        return fit([], [])
    parts = [free.filter(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(sample_docs // 2) for y in (0, 1)]
    chosen = F.broadcast(parts[0].unionAll(parts[1]))  # at most sample_docs rows
    got = docs.select(F.col(id_col).alias("_tx_id"), F.col(text_col).alias("_tx_text")).join(chosen, F.col("_tx_id") == F.col(id_col)).select(F.xxhash64("_tx_id").alias("h"), "_tx_id", F.encode(F.coalesce("_tx_text", F.lit("")), "UTF-8").alias("t"), "y")
    got = cut(got.withColumn("b", F.length("t")))
    # A bound on bytes: the hash below which the running size stays inside it, from 1024 hash ranges
    ranges = sorted((r[0], r[1]) for r in got.groupBy(F.shiftright("h", 54).alias("g")).agg(F.sum("b")).collect())
    total, last = 0, None
    for g, n in ranges:
        total += n
        if total > sample_bytes and last is not None:
            break
        last = g
    # The bounded sample is one task's input, so the fit takes an executor's memory and is made again should it be lost
    sample = got.filter(F.shiftright("h", 54) <= (last or 0)).select("h", F.col("_tx_id").cast("string").alias("i"), "t", "y").repartition(1).sortWithinPartitions("h", "i")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels_ = [], []
        for batch in batches:
            texts += batch.column(2).to_pylist()
            labels_ += batch.column(3).to_pylist()
        model = fit(texts, labels_)
        counts = Counter(labels_)
        yield pa.record_batch([pa.array([pickle.dumps(model)]), pa.array([counts[0]], pa.int64()), pa.array([counts[1]], pa.int64())], ["model", "n0", "n1"])

    done = sample.mapInArrow(tidy(fitted), "model binary, n0 long, n1 long").head()
    if done is None:
        return fit([], [])
    model, have = pickle.loads(done["model"]), {0: done["n0"], 1: done["n1"]}
    # the sample balances the labels; the document score shifts back to the table's odds
    if have[0] and have[1] and sizes.get(0) and sizes.get(1):
        model.document[0] += np.log(sizes[1] / sizes[0]) - np.log(have[1] / have[0])
    return model


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", most: float = 0.5) -> DataFrame:
    """id_col, score, spans array<struct<start, end>> of every whole text; code points, end exclusive.

    The score is a logistic function of the marginals' noisy-or, expected count and share, between 0 and 1. A null or empty
    text has no tokens and gets the logistic's value there. Rows are independent: repeated rows repeat their result, an empty
    table gives an empty one, and other columns don't matter. No shuffle.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights
    source = docs.select(F.col(id_col).alias("_tx_id"), F.col(text_col).alias("_tx_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        emissions = Emissions(model)
        kind = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                ps, _ = forward_backward([emissions.of(words(t)) for t in utf8(part.column(1))], model.trans)
                scores = _sigmoid(np.stack([features(p) for p in ps]) @ model.document)
                found = [[{"start": s, "end": e} for s, e in spans(text, p, most)] if p.max(initial=0) >= most else [] for text, p in zip(utf8(part.column(1)), ps, strict=True)]
                yield pa.record_batch([part.column(0), pa.array(scores), pa.array(found, pa.list_(kind))], ["_tx_id", "score", "spans"])

    id_type = source.schema["_tx_id"].dataType.simpleString()
    return source.mapInArrow(tidy(run), f"_tx_id {id_type}, score double, spans array<struct<start: long, end: long>>").withColumnRenamed("_tx_id", id_col)


def keep_clean(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose score is under the threshold. No join and no shuffle."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions = Emissions(shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                ps, _ = forward_backward([emissions.of(words(t)) for t in utf8(part.column(at))], shared.value.trans)
                scores = _sigmoid(np.stack([features(p) for p in ps]) @ shared.value.document)
                yield part.filter(pa.array(scores < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))
