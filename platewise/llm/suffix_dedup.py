"""Suffix-array dedup: remove every byte that an earlier 100-byte string covers, exactly.

Candidates. The leftmost least hash of the 32-byte grams inside a 100-byte window is the window's
anchor; equal windows have equal anchors, so only windows whose anchor's gram stands at two
places can repeat. Consecutive windows of one anchor make up an occurrence: a context of 100
bytes and more. A twice-seen Bloom filter of bounded size finds the suspected grams; contexts are
folded by (gram, context hash) to their first position with a combining aggregate, so thousands of
copies cost one row a task.

Comparison. Where a gram has several different contexts, the contexts' texts are compared by
merging Burrows-Wheeler transforms: a task sorts the suffixes of each shard of contexts once,
then interleaves the shards' transforms by iterative refinement (Holt and McMillan): in round t
a stable pass by symbol refines the interleave from prefixes of t - 1 bytes to t bytes, and the round
in which two neighbours part is their common prefix. Intervals that hold together for 100 rounds
are the repeated strings; the first position in each keeps its bytes. No suffix is sorted again.
A gram with very many contexts is salted over blocks; the strings that are first in their block meet once
more by digest, combined before the shuffle.

Removal. Each document is joined to the occurrences that come first in it; every other suspected
occurrence of it is removed.

When more grams come than the filter was sized for, more are suspected; results stay exact.

Defined cases: a null text is an empty one; rows that repeat a doc_id are one document in the
order, so a string that starts at the same place of both is no repeat; a null doc_id comes
first; texts under 100 bytes stay; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.line_dedup import _slots, filter_words, twice_seen_filter
from platewise.llm.text_arrays import blocks, byte_columns, released, rolling_hash, span_hash
from platewise.session import materialize

LENGTH, GRAM = 100, 32
WINDOW = LENGTH - GRAM + 1
#: Contexts of one gram that one block compares; more are salted over blocks.
BLOCK_CONTEXTS = 2048
#: Bytes of contexts that one merge takes together; small enough for the processor's cache.
BLOCK_BYTES = 60_000
_PLACE = np.uint64((1 << 30) - 1)


def occurrences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, number of windows, gram hash, context hash) of each anchor's run of windows."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    n = len(data)
    if n < LENGTH:
        return none
    m = n - GRAM + 1
    grams = rolling_hash(data, GRAM)
    least = grams & ~_PLACE
    least |= np.arange(m, dtype=np.uint64)
    span = 1
    while 2 * span <= WINDOW:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: len(least) - (WINDOW - span)], least[WINDOW - span :])
    anchor = least & _PLACE
    # windows stand inside a row: from its start to 100 bytes before its end
    begin, stop = offsets[:-1], np.maximum(offsets[1:] - LENGTH + 1, offsets[:-1])
    long_rows = stop > begin
    edge = np.zeros(len(anchor) + 1, np.int8)
    edge[begin[long_rows]] += 1
    edge[stop[long_rows]] -= 1
    new = np.ones(len(anchor), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    new[begin[long_rows]] = True
    new &= np.cumsum(edge[:-1], dtype=np.int8) > 0
    first = np.flatnonzero(new)
    if not len(first):
        return none
    row = np.searchsorted(offsets, first, "right") - 1
    count = np.minimum(np.append(first[1:], n), stop[row]) - first
    return row, first - offsets[row], count, grams[anchor[first].astype(np.int64)], span_hash(data, first, first + count - 1 + LENGTH)


def suffix_array(symbols: np.ndarray, string: np.ndarray) -> np.ndarray:
    """The suffixes of strings that each end in 0, sorted; equal ones in the order of their strings."""
    n = len(symbols)
    last = np.append(np.flatnonzero(symbols == 0), n)
    left = last[string] - np.arange(n)  # symbols before the terminator
    key = np.zeros(n, np.uint64)
    padded = np.append(symbols, np.zeros(8, symbols.dtype)).astype(np.uint64)
    for j in range(7):
        key = (key << np.uint64(9)) | np.where(left > j, padded[j : j + n], np.uint64(0))
    order = np.argsort(key, kind="stable")
    rank = np.zeros(n, np.int64)
    rank[order] = np.cumsum(np.append(1, key[order][1:] != key[order][:-1]))
    span = 7
    while rank.max(initial=0) < n and span < left.max(initial=0) + 1:
        behind = np.where(left > span, np.append(rank, np.zeros(span, np.int64))[span : span + n], 0)
        key = rank.astype(np.uint64) * np.uint64(n + 1) + behind.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        rank[order] = np.cumsum(np.append(1, key[order][1:] != key[order][:-1]))
        span *= 2
    return order


def transform(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The Burrows-Wheeler transform: the symbol before each suffix, 0 before a string's first."""
    return np.where(order > 0, symbols[order - 1], 0).astype(symbols.dtype)


def merge_transforms(one: np.ndarray, two: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave two transforms: (True where the suffix is the second's, common prefix with the one before up to ``depth``)."""
    n = len(one) + len(two)
    second = np.arange(n) >= len(one)
    block = np.zeros(n, np.int32)
    common = np.zeros(n, np.uint8 if depth < 256 else np.int32)
    # the sorted symbols, and so where they change, are the same in every round
    symbols = np.sort(np.concatenate([one, two]), kind="stable")
    change = np.ones(n, bool)
    change[1:] = (symbols[1:] != symbols[:-1]) | (symbols[1:] == 0)
    line, part = np.empty(n, one.dtype), np.ones(n, bool)
    order = None
    for _ in range(depth):
        if order is None:
            line[~second], line[second] = one, two
            order = np.argsort(line, kind="stable")
            moved = second[order]
            same = np.array_equal(moved, second)
            second = moved
        source = block[order]
        np.not_equal(source[1:], source[:-1], out=part[1:])
        part |= change
        common += ~part  # rounds in which two neighbours stay together
        np.cumsum(part, dtype=np.int32, out=block)
        if not same:
            order = None
    return second, common


def repeated_windows(texts: list[bytes], counts: np.ndarray, positions: list[tuple[int, int]]) -> list[list[int]]:
    """For each context, the windows whose 100 bytes come first at its own position among all contexts.

    counts: windows of each context; positions: (doc, start) of each context, all different.
    """
    shards = [list(range(0, len(texts), 2)), list(range(1, len(texts), 2))]
    sorted_: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for shard in shards:
        data, offsets = byte_columns(pa.array([texts[i] for i in shard], pa.binary()))
        sizes = np.diff(offsets)
        string = np.repeat(np.arange(len(shard)), sizes + 1)
        symbols = np.zeros(len(data) + len(shard), np.uint16)
        place = np.arange(len(data)) + np.repeat(np.arange(len(shard)), sizes)
        symbols[place] = data.astype(np.uint16) + 1
        order = suffix_array(symbols, string)
        starts = offsets[:-1] + np.arange(len(shard))
        inside = np.arange(len(symbols)) - starts[string] if len(symbols) else np.zeros(0, np.int64)
        # which context and which of its windows each suffix is
        sorted_.append((transform(symbols, order), np.array(shard, np.int64)[string[order]], inside[order]))
    second, common = merge_transforms(sorted_[0][0], sorted_[1][0], LENGTH)
    context, window = np.empty(len(second), np.int64), np.empty(len(second), np.int64)
    for mask, (_, c, w) in ((~second, sorted_[0]), (second, sorted_[1])):
        context[mask], window[mask] = c, w
    interval = np.cumsum(common < LENGTH)
    use = window < counts[context]
    interval, context, window = interval[use], context[use], window[use]
    docs = np.array([p[0] for p in positions], np.int64)
    begin = np.array([p[1] for p in positions], np.int64)
    order = np.lexsort((begin[context] + window, docs[context], interval))
    first = np.ones(len(order), bool)
    first[1:] = interval[order][1:] != interval[order][:-1]
    keep: list[list[int]] = [[] for _ in texts]
    for i in order[first]:
        keep[context[i]].append(int(window[i]))
    return keep


def doubtful(texts: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each context, the first and the last window that may stand in another context too (last < first: none).

    By a hash of each window: unique hashes are unique windows, so only doubtful stretches are merged.
    """
    data, offsets = byte_columns(pa.array(texts, pa.binary()))
    owner = np.repeat(np.arange(len(texts)), counts)
    window = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[:-1][owner] + window
    keys = rolling_hash(data, LENGTH)[start]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    low, high = np.full(len(texts), 1 << 30), np.full(len(texts), -1)
    np.minimum.at(low, owner[twice], window[twice])
    np.maximum.at(high, owner[twice], window[twice])
    return low, high


def _gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in blocks(batch.column(0)):
            grams = occurrences(data, offsets)[3]
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64))], ["h"])


def _suspects(held, data: np.ndarray, offsets: np.ndarray):
    row, start, count, gram, context = occurrences(data, offsets)
    at, bits = _slots(gram, len(held.value))
    hit = (held.value[at] & bits) == bits
    return row[hit], start[hit], count[hit], gram[hit], context[hit]


def _occurrence_batches(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1).to_numpy(zero_copy_only=False)
            for a, _, data, offsets in blocks(batch.column(0)):
                row, start, count, gram, context = _suspects(held, data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), pa.array(ids[a + row].astype(np.int64)), pa.array(start, pa.int64()), pa.array(count.astype(np.int32))], ["h", "c", "d", "s", "w"]
                )

    return run


def _context_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = byte_columns(batch.column(0))
        out: list[list] = [[] for _ in range(7)]
        for k, (doc, places) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            for p in places:
                text = data[offsets[k] + p["s"] : offsets[k] + p["s"] + p["w"] - 1 + LENGTH].tobytes()
                if len(text) == p["w"] - 1 + LENGTH:  # not so for another text of a repeated doc_id
                    for column, value in zip(out, (p["h"], p["salt"], p["c"], doc, p["s"], p["w"], text), strict=True):
                        column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["h", "salt", "c", "d", "s", "w", "text"])


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (h, salt): whole groups are compared in blocks of about BLOCK_BYTES."""
    held: list[tuple] = []
    names = ["h", "c", "d", "s", "salted", "keep", "digests"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.binary()))

    def finish(rows: list[tuple]) -> pa.RecordBatch:
        rows = list({(r[0], r[2], r[3], r[4]): r for r in rows}.values())
        keep: list[list[int]] = [list(range(r[5])) for r in rows]
        low, high = doubtful([r[6] for r in rows], np.array([r[5] for r in rows]))
        open_ = np.flatnonzero(high >= low)
        parts = [(rows[i], int(low[i]), int(high[i])) for i in open_]
        # of equal stretches only the first can hold first strings
        leaders: dict[bytes, tuple[tuple[int, int], int]] = {}
        for j, (r, a, b) in enumerate(parts):
            stretch, place = r[6][a : b + LENGTH], ((r[3], r[4] + a), j)
            leaders[stretch] = min(place, leaders.get(stretch, place))
        found: list[list[int]] = [[] for _ in parts]
        if leaders:
            lead = [j for _, j in leaders.values()]
            sizes = np.array([parts[j][2] - parts[j][1] + 1 for j in lead])
            for j, own in zip(lead, repeated_windows(list(leaders), sizes, [p for p, _ in leaders.values()]), strict=True):
                found[j] = own
        for i, own, (r, a, b) in zip(open_, found, parts, strict=True):
            keep[i] = [*range(a), *(a + w for w in own), *range(b + 1, r[5])]
        out: list[list] = [[] for _ in names]
        for r, k in zip(rows, keep, strict=True):
            salted = r[1] >= 0
            if not salted and len(k) == r[5]:
                continue  # nothing of it goes, which is what a missing row says
            digests = [hashlib.blake2b(r[6][w : w + LENGTH], digest_size=16).digest() for w in k] if salted else []
            for column, value in zip(out, (r[0], r[2], r[3], r[4], salted, k, digests), strict=True):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)

    size, group = 0, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group is not None and row[:2] != group and size >= BLOCK_BYTES:
                yield finish(held)
                held, size = [], 0
            group = row[:2]
            held.append(row)
            size += len(row[6])
    if held:
        yield finish(held)


def _removal_batches(held, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts = batch.column(2)
            for a, b, data, offsets in blocks(batch.column(0)):
                row, start, count, _, context = _suspects(held, data, offsets)
                edge = np.zeros(len(data) + 1, np.int32)
                own = [{(p["s"], p["c"]): p["keep"] for p in places or ()} for places in firsts.slice(a, b - a).to_pylist()]
                keys = zip(row.tolist(), start.tolist(), count.tolist(), context.view(np.int64).tolist(), strict=True)
                for r, s, w, c in keys:
                    base = int(offsets[r]) + s
                    if (s, c) not in own[r]:
                        edge[base] += 1
                        edge[base + w - 1 + LENGTH] -= 1
                    elif (keep := own[r][s, c]) is not None:
                        for gone in set(range(w)).difference(keep):
                            edge[base + gone] += 1
                            edge[base + gone + LENGTH] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(gone)])
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                inner = offsets[1:-1][offsets[1:-1] < len(data)]
                begins[inner] = gone[inner]
                spans = np.concatenate([[0], np.cumsum(begins)])
                kept = [data[offsets[k] : offsets[k + 1]][~gone[offsets[k] : offsets[k + 1]]].tobytes() for k in range(b - a)]
                columns = [batch.column(1).slice(a, b - a), pa.array(np.diff(offsets)), pa.array(np.diff(total[offsets])), pa.array(np.diff(spans[offsets])), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) of each row."""
    spark = docs.sparkSession
    none = F.lit(-(1 << 63))
    plain = docs.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(doc_id).cast("long"), none).alias("d"))
    words = filter_words(docs.count(), words_per_row=16)
    held = spark.sparkContext.broadcast(twice_seen_filter(plain.select("text").mapInArrow(released(_gram_batches), "h long"), words))
    found = plain.mapInArrow(released(_occurrence_batches(held)), "h long, c long, d long, s long, w int")
    folded = materialize(found.groupBy("h", "c", "w").agg(F.min(F.struct("d", "s")).alias("p")).select("h", "c", "w", "p.d", "p.s"), "contexts")

    many = folded.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("h").alias("m_h"), "k")
    salt = F.when(F.col("k") > BLOCK_CONTEXTS, F.pmod(F.xxhash64("c"), F.ceil(F.col("k") / BLOCK_CONTEXTS).cast("long"))).otherwise(F.lit(-1)).cast("int")
    open_ = folded.join(many, F.col("h") == F.col("m_h")).withColumn("salt", salt)
    wanted = open_.groupBy("d").agg(F.collect_list(F.struct("h", "salt", "c", "s", "w")).alias("places")).withColumnRenamed("d", "w_d")
    texts = plain.join(wanted, F.col("d") == F.col("w_d")).select("text", "d", "places")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.mapInArrow(released(_context_batches), "h long, salt int, c long, d long, s long, w int, text binary").repartition(partitions, "h", "salt").sortWithinPartitions("h", "salt", "d", "s")
    merged = materialize(dealt.mapInArrow(released(_merge_batches), "h long, c long, d long, s long, salted boolean, keep array<int>, digests array<binary>"), "merged")
    alone = merged.where("not salted").select("c", "d", "s", "keep")
    strings = merged.where("salted").select("c", "d", "s", F.explode_outer(F.arrays_zip("keep", "digests")).alias("x")).select("c", "d", "s", "x.keep", "x.digests")
    leaders = strings.where("digests is not null").groupBy("digests").agg(F.min(F.struct("d", (F.col("s") + F.col("keep")).alias("at"), "c", "s", "keep")).alias("p"))
    leading = leaders.groupBy("p.c", "p.d", "p.s").agg(F.collect_list("p.keep").alias("keep"))
    none_left = merged.where("salted").select("c", "d", "s").join(leading, ["c", "d", "s"], "left").select("c", "d", "s", F.coalesce("keep", F.array().cast("array<int>")).alias("keep"))
    masks = alone.union(none_left)
    firsts = folded.select("c", "d", "s").join(masks, ["c", "d", "s"], "left").groupBy("d").agg(F.collect_list(F.struct("s", "c", "keep")).alias("firsts")).withColumnRenamed("d", "f_d")
    joined = plain.join(firsts, F.col("d") == F.col("f_d"), "left").select("text", "d", "firsts")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    out = joined.mapInArrow(released(_removal_batches(held, names)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != none, F.col("doc_id")))
