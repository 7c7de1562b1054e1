"""Document fingerprints by locally consistent parsing.

Each level of the hierarchy turns runs of equal symbols into one symbol, tosses
deterministic coins (the label of a symbol is the lowest bit in which it differs from its left
neighbour, and that bit; four rounds leave labels below 6), cuts phrases at local maxima of
the labels and names each phrase by a hash of its symbols. A cut depends on a few
neighbours only, so equal substrings have equal phrases but at their ends, at any offset. The
fingerprint is the bottom-k sketch of the phrase names from the second level up; likeness is the
Jaccard estimate of two sketches. All rows of a block are parsed together in numpy.

For the next document in doc_id order, documents are dealt to ranges of doc_id by quantiles; the
first document of each range is sent to the range before it as well, so texts are shuffled once.

Defined cases: a null text is an empty one, whose fingerprint is the empty string (like another empty one: 1,
like any other: 0); null doc_ids come first; rows that repeat a doc_id are ordered by a hash of
their texts; a single document is its own next one; further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.text_arrays import byte_columns, mix, powers, row_starts, slices

K = 64
LEVELS = 12
_SYMBOL = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _coin_table(labels: int) -> np.ndarray:
    """The next label for each (label, left label)."""
    own, left = np.meshgrid(np.arange(labels), np.arange(labels), indexing="ij")
    bit = np.bitwise_count(((own ^ left) & -(own ^ left)) - 1).astype(np.int64)
    return np.where(own == left, 0, 2 * bit + ((own >> bit) & 1)).astype(np.uint8).ravel()


_COINS = [_coin_table(128), _coin_table(16), _coin_table(8)]


def _level(symbols: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The phrases of one level: their names and rows."""
    new_row = np.ones(len(rows), bool)
    new_row[1:] = rows[1:] != rows[:-1]
    change = new_row.copy()
    change[1:] |= symbols[1:] != symbols[:-1]
    at = np.flatnonzero(change)
    if len(at) < len(symbols):
        length = np.diff(np.append(at, len(symbols))).astype(np.uint64)
        symbols, rows, new_row = symbols[at], rows[at], new_row[at]
        symbols = np.where(length > 1, mix(symbols + length * np.uint64(0xA24BAED4963EE407)), symbols)
    left = np.empty_like(symbols)
    left[1:] = symbols[:-1]
    left[new_row] = ~symbols[new_row]
    differs = symbols ^ left
    bit = np.bitwise_count((differs & (~differs + np.uint64(1))) - np.uint64(1))
    label = (2 * bit + ((symbols >> bit.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)).astype(np.uint8)
    first = np.flatnonzero(new_row)
    for coins, width in zip(_COINS, (128, 16, 8), strict=True):
        pair = label.astype(np.int32) * width
        pair[1:] += label[:-1]
        pair[first] = label[first].astype(np.int32) * width + (label[first] ^ 1)
        label = coins[pair]
    cut = new_row.copy()
    cut[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    last = np.append(new_row[1:], True)
    cut &= ~last | new_row  # a phrase doesn't start at the last symbol of a row
    start = np.flatnonzero(cut)
    up, down = powers(len(symbols) + 1)
    total = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * up[: len(symbols)], out=total[1:])
    end = np.append(start[1:], len(symbols))
    names = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return names, rows[start]


def sketches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, starts): the sorted bottom-k 32-bit names of each row of a block of texts."""
    n = len(offsets) - 1
    symbols, rows = _SYMBOL[data], np.repeat(np.arange(n), np.diff(offsets))
    kept: list[np.ndarray] = []
    live = np.ones(n, bool)
    for level in range(1, LEVELS + 1):
        if not len(symbols):
            break
        symbols, rows = _level(symbols, rows)
        if level >= 2:
            use = live[rows]
            kept.append((rows[use].astype(np.uint64) << np.uint64(32)) | (symbols[use] >> np.uint64(32)))
            live = np.bincount(rows, minlength=n) > 1  # a row of one phrase is done
            stay = live[rows]
            symbols, rows = symbols[stay], rows[stay]
    values = np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.uint64)
    owner = (values >> np.uint64(32)).astype(np.int64)
    rank = np.arange(len(values)) - row_starts(owner, n)[owner]
    values, owner = values[rank < K], owner[rank < K]
    return (values & np.uint64(0xFFFFFFFF)).astype(np.uint32), row_starts(owner, n)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each row, the share of the k smallest names of the union that both sketches hold."""
    n = len(a[1]) - 1
    packed = [(np.repeat(np.arange(n, dtype=np.uint64), np.diff(s)) << np.uint64(32)) | v for v, s in (a, b)]
    union, counts = np.unique(np.concatenate(packed), return_counts=True)
    owner = (union >> np.uint64(32)).astype(np.int64)
    use = np.arange(len(union)) - row_starts(owner, n)[owner] < K
    size = np.bincount(owner[use], minlength=n)
    both = np.bincount(owner[use & (counts == 2)], minlength=n)
    return np.where(size == 0, 1.0, both / np.maximum(size, 1))


def encode(sketch: tuple[np.ndarray, np.ndarray]) -> list[str]:
    values, starts = sketch
    return [base64.b64encode(values[starts[i] : starts[i + 1]].astype("<u4").tobytes()).decode() for i in range(len(starts) - 1)]


def _bucket_of(bounds: list[int]):
    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        known = ids.notna()
        out = np.full(len(ids), -1, np.int32)
        out[known] = np.searchsorted(np.array(bounds, np.int64), ids[known].astype(np.int64), "right")
        return pd.Series(out)

    return bucket


def _pairs(names: list[str]):
    """Rows come ordered by (bucket, tail, doc_id): each document gets the next row of its bucket."""

    def finish(ids: list, texts: list[bytes], following: list[bytes]) -> pa.RecordBatch:
        data, offsets = byte_columns(pa.array(texts, pa.binary()))
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        first = np.searchsorted(lead, offsets)
        chars = np.diff(first)
        edited = []
        for i, (own, nxt) in enumerate(zip(texts, following, strict=True)):
            half = int(chars[i]) // 2
            keep = len(own) if not half else int(lead[first[i] + chars[i] - half] - offsets[i])
            edited.append(own[:keep] + _first_chars(nxt, half))
        ext_data, ext_offsets = byte_columns(pa.array(edited, pa.binary()))
        nxt_data, nxt_offsets = byte_columns(pa.array(following, pa.binary()))
        own, ext = sketches(data, offsets), sketches(ext_data, ext_offsets)
        # the next text of row i is row i + 1, but for the last of the slice and of its bucket
        nxt = _following_sketch(own, texts, following, nxt_data, nxt_offsets)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(chars, pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited]), pa.array(encode(own)), pa.array(encode(ext)), pa.array(likeness(own, ext)), pa.array(likeness(own, nxt))], names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        ids: list = []
        texts: list[bytes] = []
        following: list[bytes] = []
        held = 0
        for batch in batches:
            data, offsets = byte_columns(batch.column(3))
            for a, b in slices(offsets, 1 << 18):
                part = [batch.column(i).slice(a, b - a).to_pylist() for i in range(3)]
                for k, (bucket, tail, doc_id) in enumerate(zip(*part, strict=True)):
                    text = data[offsets[a + k] : offsets[a + k + 1]].tobytes()
                    if last is not None and last[0] == bucket and not last[1]:
                        ids.append(last[2]), texts.append(last[3]), following.append(text)
                        held += len(last[3])
                        if held >= 1 << 19:
                            yield finish(ids, texts, following)
                            ids, texts, following, held = [], [], [], 0
                    last = (bucket, tail, doc_id, text)
        if ids:
            yield finish(ids, texts, following)

    return run


def _first_chars(text: bytes, n: int) -> bytes:
    """The first n code points of a UTF-8 text, or all of it."""
    if n >= len(text):
        return text
    lead = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return text if n >= len(lead) else text[: int(lead[n])]


def _following_sketch(own, texts: list[bytes], following: list[bytes], data: np.ndarray, offsets: np.ndarray):
    """Sketches of the following texts: row i + 1's where that is the following text, else parsed."""
    n = len(texts)
    shared = np.array([i + 1 < n and following[i] is texts[i + 1] for i in range(n)], bool)
    alone = np.flatnonzero(~shared)
    part = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in alone]) if len(alone) else np.zeros(0, np.uint8)
    other = sketches(part, np.concatenate([[0], np.cumsum(np.diff(offsets)[alone])]))
    pieces, place = [], {int(i): k for k, i in enumerate(alone)}
    for i in range(n):
        values, starts, at = (own[0], own[1], i + 1) if shared[i] else (other[0], other[1], place[i])
        pieces.append(values[starts[at] : starts[at + 1]])
    return np.concatenate(pieces) if pieces else np.zeros(0, np.uint32), np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)


def fingerprint_neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.col(doc_id).cast("long").alias("fp_id"), F.col(text).cast("string").alias("fp_text"))
    ids = plain.select("fp_id")
    bounds = sorted({int(b) for b in ids.approxQuantile("fp_id", [i / (3 * partitions) for i in range(1, 3 * partitions)], 0.1 / partitions)})
    bucket = _bucket_of(bounds)
    firsts = sorted(ids.select(bucket("fp_id").alias("b"), "fp_id").groupBy("b").agg(F.min("fp_id").alias("f")).collect())
    # the first document of each range stands, as a tail, behind the last one of the range before
    links = [(firsts[i].f, firsts[i - 1].b, firsts[i].b) for i in range(len(firsts))]
    tails = spark.createDataFrame(links, "first long, before int, own int")  # one row a range
    dealt = plain.withColumn("fp_bucket", bucket("fp_id"))
    joined = dealt.join(F.broadcast(tails), (F.col("fp_bucket") == F.col("own")) & F.col("fp_id").eqNullSafe(F.col("first")), "left")
    places = F.array(F.struct(F.col("fp_bucket").alias("b"), F.lit(0).alias("t")))
    places = F.when(F.col("own").isNull(), places).otherwise(F.concat(places, F.array(F.struct(F.col("before").alias("b"), F.lit(1).alias("t")))))
    spread = joined.select(F.explode(places).alias("place"), "fp_id", "fp_text").select("place.b", "place.t", "fp_id", "fp_text")
    ordered = spread.repartition(partitions, "b").sortWithinPartitions("b", "t", "fp_id", F.xxhash64("fp_text"), "fp_text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(_pairs([x.split(" ")[0] for x in schema.split(", ")]), schema)
