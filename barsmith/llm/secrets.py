"""Secret scan: fixed patterns, and strings that a tokenizer needs many tokens for."""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, strings, table, tidy

KINDS = ("assign", "access", "hex", "token")
# The patterns of the three base kinds and their least lengths.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
#: What the token kind looks at: long runs of the characters that keys are written in.
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: Identifiers and digests that are no secrets, by shape: UUIDs, hexadecimal digests of usual lengths, plain numbers. Names joined of words have many characters a token.
KNOWN = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}|[0-9_=+/-]+")
VOCABULARY = "byte_bpe_50k.tiktoken"
MOST_CHARS_A_TOKEN = 2.2
#: Longer runs are encoded in stretches of so many characters, so that the work stays in proportion to their length.
STRETCH = 4096


def encoder(name: str = VOCABULARY):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, sorted. Matches of a kind are leftmost and don't overlap; short ones drop out after they are matched."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def token_spans(text: str, base: list[tuple[int, int, int]], encode, most: float = MOST_CHARS_A_TOKEN) -> list[tuple[int, int, int]]:
    """Runs with few characters a token, outside the base spans (sorted by start) and the known digests and numbers."""
    starts = [s for s, _, _ in base]
    reach = list(accumulate((e for _, _, e in base), max))  # how far the base spans up to one go
    out = []
    for m in RUN.finditer(text):
        before = bisect_left(starts, m.end())
        if (before and reach[before - 1] > m.start()) or KNOWN.fullmatch(text, m.start(), m.end()):
            continue
        tokens = sum(len(encode(text[a : min(a + STRETCH, m.end())])) for a in range(m.start(), m.end(), STRETCH))
        if m.end() - m.start() < most * tokens:
            out.append((m.start(), 3, m.end()))
    return out


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_chars_a_token: float = MOST_CHARS_A_TOKEN, vocabulary: str = VOCABULARY) -> DataFrame:
    """The secrets of every whole text: id_col, spans array<struct<kind, start, end>>, by start, then kind.

    Offsets count code points, ends are exclusive. The base kinds come from fixed patterns. The method adds
    the kind token: a run of at least 20 key characters that takes a token for fewer than
    most_chars_a_token characters, unless it is a known digest or number or overlaps a base span.
    Null and empty texts have no spans; rows are independent, so repeated rows repeat their result and an
    empty table gives an empty one. No shuffle.
    """
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("_sc_id"), F.col(text_col).alias("_sc_text"))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            out = []
            for text in strings(batch.column(1)):
                base = base_spans(text)
                out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(base + token_spans(text, base, encode, most_chars_a_token))])
            yield pa.record_batch([batch.column(0), pa.array(out, pa.list_(kind))], ["_sc_id", "spans"])

    id_type = source.schema["_sc_id"].dataType.simpleString()
    return source.mapInArrow(tidy(spans), f"_sc_id {id_type}, spans array<struct<kind: string, start: long, end: long>>").withColumnRenamed("_sc_id", id_col)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest columns of the scan of all documents."""
    found = scan(table(spark, sf_dir, "documents"))
    said = "array_join(transform({}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    count = "cast(size(filter(spans, x -> x.kind = '{}')) as long)"
    return found.select(
        "doc_id",
        *[F.expr(count.format(k)).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.expr(said.format("filter(spans, x -> x.kind <> 'token')")), 256).alias("base_sha256"),
        F.expr(said.format("spans")).alias("spans"),
    )
