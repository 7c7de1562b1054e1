"""Line dedup with two Bloom filters: once-seen and twice-seen line hashes.

1. Each task hashes the keys of its lines and keeps two register-blocked Bloom
   filters: a hash that the first already holds goes to the second. Tasks emit compressed
   pieces of both; merging ORs them and adds ``first AND other first`` to the second.
2. The merged twice-seen filter, whose size is a bounded parameter, is broadcast. Only lines
   that it suspects are shuffled: (key, doc_id) pairs are counted exactly by a two-step
   aggregate, so neither a hot line nor a long document meets in one task. A key travels as its
   128-bit BLAKE2 digest, so long lines cost no more than short ones.
3. Confirmed keys are joined to the suspected pairs; the few keys that hold more than a thousandth of the
   pairs each are broadcast. Documents that hold no suspect skip the shuffle of texts; the others are
   joined by doc_id and rebuilt.

Lines are split, stripped and lower-cased over whole Arrow batches.

When more lines come than the filter was sized for it suspects more of them; results stay
exact, and what is shuffled stays linear in the input.

Defined cases: a null or empty text is one empty line; a null doc_id is one document below
all others; repeated rows of one doc_id are one document for counts, and each row is
returned; further columns are carried through, but columns named ld_text, ld_lines or ld_dropped are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.columns import carried, join_counted, schema_of
from platewise.llm.text_arrays import byte_columns, mix, released, slices, span_hash
from platewise.session import materialize

#: Fixed value: the white space that is stripped.
STRIPPED = " \t\n\x0b\x0c\r"
PIECES = 64
ADDED = ("ld_text", "ld_lines", "ld_dropped")


def line_keys(column: pa.Array, min_chars: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, pa.Array]]:
    """(first row, end row, lines of each row, row of each key, keys) of bounded runs of rows; keys that are long enough to count."""
    column = column.cast(pa.large_string()).fill_null("")
    for a, b in slices(byte_columns(column)[1]):
        lines = pc.split_pattern(column.slice(a, b - a), "\n")
        numbers = lines.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        keys = pc.ascii_lower(pc.ascii_trim(lines.flatten(), characters=STRIPPED))
        long = pc.greater_equal(pc.utf8_length(keys), min_chars)
        yield a, b, numbers, np.repeat(np.arange(b - a), numbers)[long.to_numpy(zero_copy_only=False)], keys.filter(long)


def key_hashes(keys: pa.Array) -> np.ndarray:
    data, offsets = byte_columns(keys)
    return span_hash(data, offsets[:-1], offsets[1:])


def digest(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


def _slots(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit word of each hash and the four bits that it sets there."""
    h = mix(hashes)
    bits = np.uint64(0)
    for shift in (0, 6, 12, 18):
        bits = bits | (np.uint64(1) << ((h >> np.uint64(shift)) & np.uint64(63)))
    return ((h >> np.uint64(24)) % np.uint64(words)).astype(np.int64), bits


class TwiceSeen:
    """A pair of Bloom filters; ``add`` may be called with hashes in any order."""

    def __init__(self, words: int):
        self.once, self.twice = np.zeros(words, np.uint64), np.zeros(words, np.uint64)

    def add(self, hashes: np.ndarray) -> None:
        unique, counts = np.unique(hashes, return_counts=True)
        at, bits = _slots(unique, len(self.once))
        again = (counts > 1) | ((self.once[at] & bits) == bits)
        np.bitwise_or.at(self.twice, at[again], bits[again])
        np.bitwise_or.at(self.once, at, bits)

    def merge(self, once: np.ndarray, twice: np.ndarray, at: slice) -> None:
        self.twice[at] |= twice | (self.once[at] & once)
        self.once[at] |= once


def _build(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, any_rows = TwiceSeen(words), False
        for batch in batches:
            if batch.num_rows:
                any_rows = True
                seen.add(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        step = words // PIECES
        for k in range(PIECES if any_rows else 0):
            once, twice = seen.once[k * step : (k + 1) * step], seen.twice[k * step : (k + 1) * step]
            if once.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(once.tobytes(), 1)]), pa.array([zlib.compress(twice.tobytes(), 1)])], ["piece", "once", "twice"])

    return run


def _merge(words: int, which: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, TwiceSeen] = {}
        for batch in batches:
            for k, once, twice in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                seen = held.setdefault(k, TwiceSeen(words // PIECES))
                seen.merge(np.frombuffer(zlib.decompress(once.as_py()), np.uint64), np.frombuffer(zlib.decompress(twice.as_py()), np.uint64), slice(None))
        for k, seen in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(getattr(seen, which).tobytes(), 1)])], ["piece", "bits"])

    return run


def _merged(hashes: DataFrame, words: int, which: str) -> np.ndarray:
    pieces = hashes.mapInArrow(_build(words), "piece int, once binary, twice binary")
    merged = pieces.repartition(PIECES, "piece").mapInArrow(_merge(words, which), "piece int, bits binary")
    out = np.zeros(words, np.uint64)
    step = words // PIECES
    for row in merged.toLocalIterator():
        out[row.piece * step : (row.piece + 1) * step] = np.frombuffer(zlib.decompress(bytes(row.bits)), np.uint64)
    return out


def twice_seen_filter(hashes: DataFrame, words: int) -> np.ndarray:
    """The merged twice-seen filter of a one-column DataFrame of hashes: ``words`` * 8 bytes on the driver."""
    return _merged(hashes, words, "twice")


def seen_filter(hashes: DataFrame, words: int) -> np.ndarray:
    """The same of all hashes that stand there at all."""
    return _merged(hashes, words, "once")


def filter_words(rows: int, words_per_row: int = 8, least: int = 1 << 12, most: int = 1 << 22) -> int:
    """Size of a filter in 64-bit words: a power of two that follows the number of rows, 32 MB at most."""
    return int(min(most, max(least, 1 << max(0, rows * words_per_row - 1).bit_length())))


def _hash_batches(min_chars: int):
    """The hashes of the distinct keys of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, rows, keys in line_keys(batch.column(0), min_chars):
                hashes = key_hashes(keys)
                first = np.unique(mix(hashes + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
                yield pa.RecordBatch.from_arrays([pa.array(hashes[first].view(np.int64))], ["h"])

    return run


def _held(twice: np.ndarray, keys: pa.Array) -> np.ndarray:
    at, bits = _slots(key_hashes(keys), len(twice))
    return (twice[at] & bits) == bits


def _pair_batches(twice, min_chars: int):
    """(document, digest) of the suspected keys, once a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, _, rows, keys in line_keys(batch.column(0), min_chars):
                hit = _held(twice.value, keys)
                pairs = pa.table({"row": rows[hit], "key": keys.filter(pa.array(hit))}).group_by(["row", "key"]).aggregate([])
                digests = pa.array([digest(k.encode()) for k in pairs["key"].to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(pairs["row"].to_numpy() + a)), digests], ["d", "key"])

    return run


def _side_batches(twice, min_chars: int, text: int, names: list[str], *, suspected: bool):
    """The documents with a suspected line, as they are; or those without, with their final columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, numbers, rows, keys in line_keys(batch.column(text), min_chars):
                pick = np.bincount(rows[_held(twice.value, keys)], minlength=b - a) > 0
                if not suspected:
                    pick = ~pick
                part = batch.slice(a, b - a).filter(pa.array(pick))
                more = [] if suspected else [part.column(text).cast(pa.string()).fill_null(""), pa.array(numbers[pick]), pa.array(np.zeros(pick.sum(), np.int64))]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names)

    return run


def _drop_batches(text: int, names: list[str]):
    """The last column holds the digests of the keys that the document loses, or null."""
    white = STRIPPED.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = batch.column(text).cast(pa.string()).fill_null("")
            texts, numbers, dropped = [], [], []
            for value, gone in zip(body, batch.column(batch.num_columns - 1), strict=True):
                raw = value.as_buffer().to_pybytes()
                lines = raw.split(b"\n")
                kept = lines
                if gone.is_valid:
                    own = set(gone.as_py())
                    kept = [x for x in lines if digest(x.strip(white).lower()) not in own]
                texts.append(raw if kept is lines else b"\n".join(kept))
                numbers.append(len(lines))
                dropped.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.binary()).cast(pa.string()), pa.array(numbers, pa.int64()), pa.array(dropped, pa.int64())], names)

    return run


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """All columns of ``docs``, then ld_text (the kept lines), ld_lines and ld_dropped.

    Lines whose key has ``min_chars`` code points and stands in ``min_docs`` documents stay
    only in the largest doc_id that holds the key.
    """
    spark = docs.sparkSession
    body = docs.select(F.col(text).cast("string").alias("text"), F.col(doc_id).alias("d"))
    twice = spark.sparkContext.broadcast(twice_seen_filter(body.select("text").mapInArrow(released(_hash_batches(min_chars)), "h long"), filter_words(docs.count())))

    kind = docs.schema[doc_id].dataType.simpleString()
    suspects = materialize(body.mapInArrow(released(_pair_batches(twice, min_chars)), f"d {kind}, key binary"), "suspects")
    one_doc = F.struct("d")  # a null id is a document too
    confirmed = materialize(suspects.groupBy("key").agg(F.countDistinct(one_doc).alias("n"), F.max("d").alias("last")).where(F.col("n") >= min_docs), "confirmed")
    drops = join_counted(suspects, confirmed, "key", "n").where(~F.col("d").eqNullSafe(F.col("last"))).groupBy("d").agg(F.collect_set("key").alias("ld_drops")).withColumnRenamed("d", "ld_id")

    columns = carried(docs, ADDED)
    names = [f"c{i}" for i in range(len(columns))]
    plain = docs.select(*(F.col(c).alias(n) for c, n in zip(columns, names, strict=True)))
    fields, at = schema_of(docs, columns), columns.index(text)
    final, final_names = ", ".join([*fields, "ld_text string, ld_lines long, ld_dropped long"]), [*names, *ADDED]
    clean = plain.mapInArrow(released(_side_batches(twice, min_chars, at, final_names, suspected=False)), final)
    dirty = plain.mapInArrow(released(_side_batches(twice, min_chars, at, names, suspected=True)), ", ".join(fields))
    joined = dirty.join(drops, F.col(names[columns.index(doc_id)]).eqNullSafe(F.col("ld_id")), "left").select(*names, "ld_drops")
    return clean.unionByName(joined.mapInArrow(released(_drop_batches(at, final_names)), final)).toDF(*columns, *ADDED)
