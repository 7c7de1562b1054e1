"""MinHash near-dedup with DartMinHash signatures.

Every weighted element throws hashed darts into its region of the (weight, rank) plane: dyadic
cells hold a Poisson number of darts whose places follow from a hash of element, cell and
number. Each dart belongs to one coordinate; the earliest dart (lowest rank) is the
coordinate's minhash. Ranks are searched only as far as all coordinates are found, so a signature
costs about k log k darts whatever the length of the text. Elements are five-word shingles, with
weight 1 (Jaccard similarity of sets) or, with ``weighted``, with their number in the text (weighted Jaccard similarity).

1. Signatures are banded where the text is read; texts are not shuffled for that. Exact copies fold
   into one node by a combining aggregate.
2. Only documents that share a band bucket with another go on, with their texts: a Bloom filter of
   their ids keeps all other texts out of the shuffle.
3. Forest: within each block of a bucket a maximum spanning forest of the estimated similarities
   gives fewer pairs than documents. The pairs are verified, and verified links become classes.
4. Every pair of a bucket that is still in two classes is compared inside a task, the largest class
   of a bucket against all others and those among themselves, in blocks: first by signatures, then, where they leave
   it open, by the shingles of the texts. So no pair of a bucket is left out; only documents in doubt and links
   that join two classes leave the task, pairs are never listed.
5. The forest's pairs are verified with the texts of their blocks of documents; shingles are compared by 64-bit hashes.

Hot buckets and hot copies: aggregates combine before the shuffle, buckets are dealt out in blocks, and
keys that hold more than a thousandth of the rows are broadcast (fewer than a thousand of them).
Intermediate tables are deleted as soon as their successors are written.

Defined cases: a null text is an empty one and all empty texts are copies; a text of fewer than
five words has one shingle, all of its words; rows that repeat a doc_id are one document,
whose texts share a class; null doc_ids are one document too (the smallest long stands for null, so a table that
uses it as an id unites it with the null rows); further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.columns import join_counted
from platewise.llm.line_dedup import _slots, filter_words, seen_filter
from platewise.llm.text_arrays import blocks, byte_columns, mix, released, row_starts, word_hashes
from platewise.session import Scratch

BANDS, ROWS, SHINGLE = 28, 6, 5
#: Documents of a bucket in one block, bytes of text that a block of pairs aims at, standard deviations that a screen leaves.
BLOCK, BLOCK_BYTES, MARGIN = 256, 2 << 20, 4.5
#: Rows of a small table that one task takes.
TASK_ROWS = 200_000
_FLOOR = -6
_C1, _C2, _C3 = np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xAEF17502108EF2D9)
_UNIT = 1.0 / (1 << 53)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles (lower-cased), and their rows; a short text is one shingle."""
    words, rows = word_hashes(data, offsets, lower=True)
    n = len(offsets) - 1
    counts = np.bincount(rows, minlength=n)
    starts = np.concatenate([[0], np.cumsum(counts)])
    number = np.maximum(counts - size + 1, 1)
    own = np.repeat(np.arange(n), number)
    at = starts[own] + np.arange(len(own)) - np.repeat(np.cumsum(number) - number, number)
    padded = np.append(words, np.zeros(size, np.uint64))
    out = np.full(len(own), 0x5851F42D4C957F2D, np.uint64)
    for j in range(size):
        inside = at + j < starts[own + 1]
        out = mix(out * _C1 + np.where(inside, padded[np.minimum(at + j, len(words))], np.uint64(j + 1)))
    return out, own


def _poisson(uniform: np.ndarray, mean: float) -> np.ndarray:
    """Poisson numbers by inversion."""
    terms = int(mean + 12 * math.sqrt(mean) + 12)
    p = np.exp(np.arange(terms) * math.log(mean) - mean - np.array([math.lgamma(i + 1) for i in range(terms)]))
    return np.searchsorted(np.cumsum(p), uniform, "right")


def dart_minhash(elements: np.ndarray, rows: np.ndarray, n: int, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """The n x k signatures; rows are sorted, and each row has an element."""
    total = np.bincount(rows, weights=weights, minlength=n)
    reach = np.ceil(np.log2((k * math.log(k) + 3 * k) / np.maximum(total, 1e-9))).astype(int)
    reach = np.maximum(reach, _FLOOR)
    signature = np.zeros((n, k), np.uint64)
    open_ = np.ones(n, bool)
    heavy = 1.0 if weights is None else float(weights.max(initial=1.0))
    while open_.any():
        found = []
        use = open_[rows]
        x, own, w = elements[use], rows[use], None if weights is None else weights[use]
        for level in range(_FLOOR, int(reach[open_].max()) + 1):
            low, high = (0.0, 2.0**_FLOOR) if level == _FLOOR else (2.0 ** (level - 1), 2.0**level)
            near = reach[own] >= level
            for column in range(1 + max(0, math.ceil(math.log2(heavy)))):
                left, right = (0.0, 1.0) if column == 0 else (2.0 ** (column - 1), 2.0**column)
                pick = near if w is None else near & (w > left)
                cell = mix(x[pick] + np.uint64((((level + 64) * 128 + column) * int(_C1)) % (1 << 64)))
                count = _poisson((cell >> np.uint64(11)) * _UNIT, (high - low) * (right - left))
                number = np.repeat(np.arange(len(count)), count)
                if not len(number):
                    continue
                within = np.arange(len(number)) - np.repeat(np.cumsum(count) - count, count)
                dart = mix(cell[number] + (within.astype(np.uint64) + np.uint64(1)) * _C2)
                spot = mix(dart + _C3)
                rank = low + (high - low) * ((dart >> np.uint64(11)) * _UNIT)
                owner = own[pick][number]
                if w is not None:
                    place = left + (right - left) * ((mix(dart + _C1) >> np.uint64(11)) * _UNIT)
                    hit = place < w[pick][number]
                    dart, spot, rank, owner = dart[hit], spot[hit], rank[hit], owner[hit]
                found.append((owner * k + (spot % np.uint64(k)).astype(np.int64), rank, dart))
        place, rank, dart = (np.concatenate([f[i] for f in found]) for i in range(3))
        late_first = np.argsort(-rank, kind="stable")
        flat = np.zeros(n * k, np.uint64)
        flat[place[late_first]] = dart[late_first]  # the earliest dart is written last
        filled = np.zeros(n * k, bool)
        filled[place] = True
        done = open_ & filled.reshape(n, k).all(axis=1)
        signature[done] = flat.reshape(n, k)[done]
        open_ &= ~done
        reach[open_] += 1
    return signature


def bands(signature: np.ndarray, number: int = BANDS, size: int = ROWS) -> np.ndarray:
    """n x number bucket keys; the band's number is part of its key."""
    out = np.tile(np.arange(1, number + 1, dtype=np.uint64) * _C3, (len(signature), 1))
    for j in range(size):
        out = mix(out * _C1 + signature[:, j::size][:, :number])
    return out


def counted(found: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each row in order, their rows, and how often each stands there."""
    order = np.lexsort((found, rows))
    found, rows = found[order], rows[order]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:] != found[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(first)
    return found[at], rows[at], np.diff(np.append(at, len(found)))


def signatures(data: np.ndarray, offsets: np.ndarray, weighted: bool = False) -> np.ndarray:
    """The signatures of one block of texts."""
    found, rows = shingles(data, offsets)
    if not weighted:
        return dart_minhash(found, rows, len(offsets) - 1, BANDS * ROWS)
    found, rows, number = counted(found, rows)
    return dart_minhash(found, rows, len(offsets) - 1, BANDS * ROWS, number.astype(float))


def _band_batches(weighted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(0), 1 << 19):
                signature = signatures(data, offsets, weighted)
                keys = bands(signature)
                small = pa.array([r.tobytes() for r in (signature & np.uint64(0xFF)).astype(np.uint8)], pa.binary())
                held = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[1:]), held, small], ["doc", "copy", "bands", "sketch"])

    return run


def shingle_sets(texts: list[bytes], weighted: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct shingles, their numbers) of each text; all numbers are 1 without ``weighted``."""
    out = []
    for a, b, data, offsets in blocks(pa.array(texts, pa.binary())):
        found, rows, number = counted(*shingles(data, offsets))
        at = row_starts(rows, b - a)
        out += [(found[x:y], number[x:y] if weighted else np.ones(y - x, np.int64)) for x, y in zip(at, at[1:], strict=False)]
    return out


def similarities(sets: list[tuple[np.ndarray, np.ndarray]], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The (weighted) Jaccard similarity of sets[left[i]] and sets[right[i]]; one pass over a pair's second set."""
    sizes = np.array([len(s[0]) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.unique(np.concatenate([s[0] for s in sets]), return_inverse=True)[1]
    number = np.concatenate([s[1] for s in sets])
    total = np.add.reduceat(number, starts[:-1])
    out = np.zeros(len(left))
    own = np.zeros(int(ids.max(initial=0)) + 1, np.int64)
    order = np.argsort(left, kind="stable")
    cuts = np.flatnonzero(np.diff(left[order])) + 1
    for part in np.split(order, cuts):
        a = left[part[0]]
        mine = slice(starts[a], starts[a + 1])
        own[ids[mine]] = number[mine]
        edges = np.concatenate([[0], np.cumsum(sizes[right[part]])])
        for lo in range(0, len(part), 256):
            some = part[lo : lo + 256]
            n = sizes[right[some]]
            begin = np.cumsum(n) - n
            at = np.repeat(starts[right[some]] - begin, n) + np.arange(edges[min(lo + 256, len(part))] - edges[lo])
            both = np.add.reduceat(np.minimum(own[ids[at]], number[at]), begin)
            out[some] = both / (total[a] + total[right[some]] - both)
        own[ids[mine]] = 0
    return out


def _runs(keys: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """The row ranges of equal keys, one after another."""
    change = np.zeros(max(0, len(keys[0]) - 1), bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(keys[0])]
    yield from zip(cuts, cuts[1:], strict=False)


def _pairs_batch(a: list, b: list) -> pa.RecordBatch:
    one, two = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    apart = one != two
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)[apart]), pa.array(np.maximum(one, two)[apart])], ["a", "b"])


def spanning_pairs(sketch: np.ndarray, least: float) -> tuple[list[int], list[int]]:
    """The edges of a maximum spanning forest over the pairs that agree in at least ``least`` coordinates."""
    n = len(sketch)
    ends: tuple[list[int], list[int]] = ([], [])
    best, parent = np.full(n, -1), np.zeros(n, np.int64)
    open_ = np.ones(n, bool)
    at = 0
    for _ in range(n - 1):
        open_[at] = False
        agree = (sketch == sketch[at]).sum(axis=1, dtype=np.int64)
        nearer = open_ & (agree > best)
        best[nearer], parent[nearer] = agree[nearer], at
        at = int(np.argmax(np.where(open_, best, -2)))
        if best[at] >= least:
            ends[0].append(int(parent[at]))
            ends[1].append(at)
    return ends


def _forest_batches(least: float):
    """Rows (key, block, node, sketch) come sorted by (key, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, nodes, sketches = None, [], []

        def finish(a: list, b: list) -> None:
            if sum(map(len, nodes)) > 1:
                ids = np.concatenate(nodes)
                one, two = spanning_pairs(np.vstack(sketches), least)
                a.append(ids[one])
                b.append(ids[two])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, block, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            sketch = byte_columns(batch.column(3))[0].reshape(len(key), -1)
            a, b = [], []
            for x, y in _runs([key, block]):
                if (key[x], block[x]) != last:
                    finish(a, b)
                    last, nodes, sketches = (key[x], block[x]), [], []
                nodes.append(node[x:y])
                sketches.append(sketch[x:y])
            yield _pairs_batch(a, b)
        a, b = [], []
        finish(a, b)
        yield _pairs_batch(a, b)

    return run


def _parts(part: list[dict]) -> dict:
    """One block's documents that came in several batches."""
    if len(part) == 1:
        return part[0]
    return {c: sum((p[c] for p in part), []) if isinstance(part[0][c], list) else np.concatenate([p[c] for p in part]) for c in part[0]}


def _meetings(batches: Iterator[pa.RecordBatch], least: float, weighted: bool = False, guests: int = 1024) -> Iterator[tuple[bool, dict, dict, np.ndarray, np.ndarray]]:
    """Rows (key, block, visits, node, class, largest class, sketch[, text]) come sorted by the first three: a block's own documents, then those that visit it.

    Yields (whether the block is new, its documents, those met, and the pairs of places whose classes differ and whose
    signatures agree in at least ``least`` coordinates). A bucket of one block has no visitors; its documents meet
    among themselves. Of two visitors that are both outside the largest class, one visit counts.
    """
    names = ("key", "block", "visits", "node", "cls", "large")
    last, home, visited, new = None, [], False, True

    def meet(one: dict, two: dict, *, same: bool) -> tuple[np.ndarray, np.ndarray]:
        left, right = [], []
        outside = one["cls"] != one["large"]
        for i in range(len(two["node"])):
            use = one["cls"] != two["cls"][i]
            if same:
                use[i:] = False
            else:
                use &= ~outside | (one["node"] < two["node"][i])
            pick = np.flatnonzero(use)
            if len(pick):
                pick = pick[(one["sketch"][pick] == two["sketch"][i]).sum(axis=1) >= least]
                left.append(pick)
                right.append(np.full(len(pick), i))
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(names)}
        columns["sketch"] = byte_columns(batch.column(6))[0].reshape(batch.num_rows, -1)
        for x, y in _runs([columns[n] for n in names[:3]]):
            if (columns["key"][x], columns["block"][x]) != last:
                if home and not visited:
                    own = _parts(home)
                    yield (True, own, own, *meet(own, own, same=True))
                last, home, visited, new = (columns["key"][x], columns["block"][x]), [], False, True
            own_block = not columns["visits"][x]
            for lo in range(x, y, guests):
                hi = min(lo + guests, y)
                part = {n: c[lo:hi] for n, c in columns.items()}
                if batch.num_columns > 7:
                    part["sets"] = shingle_sets([t.as_py() for t in batch.column(7).slice(lo, hi - lo).cast(pa.binary())], weighted)
                if own_block:
                    home.append(part)
                elif home:
                    home = [_parts(home)]
                    yield (new, home[0], part, *meet(home[0], part, same=False))
                    new = False
                visited |= not own_block
    if home and not visited:
        own = _parts(home)
        yield (True, own, own, *meet(own, own, same=True))


def _doubt_batches(least: float):
    """Of a block's rows those that have a partner of another class which the signatures don't rule out; at most the rows that came."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())

    def rows(part: dict, at: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(part[n][at], k) for n, k in zip(("key", "block", "visits", "node", "cls", "large"), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([r.tobytes() for r in part["sketch"][at]], pa.binary())], ["key", "block", "visits", "node", "class", "large", "sketch"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for new, home, guests, left, right in _meetings(batches, least):
            if new:
                told = set()
            same = home is guests
            own = np.unique(np.concatenate([left, right]) if same else left)
            own = np.array([i for i in own if i not in told], np.int64)
            told.update(own.tolist())
            yield rows(home, own)
            if not same:
                yield rows(guests, np.unique(right))

    return run


def _settle_batches(screen: float, least: float, weighted: bool):
    """The verified links of each block that join classes, one for each join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.setdefault(c, c) != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        for new, home, guests, left, right in _meetings(batches, screen, weighted):
            if new:
                root.clear()
            same = home is guests
            sets = home["sets"] if same else [*home["sets"], *guests["sets"]]
            a, b = [], []
            if len(left):
                at = right if same else right + len(home["sets"])
                for i in np.flatnonzero(similarities(sets, at, left) >= least).tolist():
                    one, two = find(int(home["cls"][left[i]])), find(int(guests["cls"][right[i]]))
                    if one != two:
                        root[max(one, two)] = min(one, two)
                        a.append(home["node"][left[i] : left[i] + 1])
                        b.append(guests["node"][right[i] : right[i] + 1])
            yield _pairs_batch(a, b)

    return run


def _verify_batches(least: float, weighted: bool):
    """Rows (group, a, b, text) come sorted by group, the texts (of a, without b) before the pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sets, place = None, [], {}
        for batch in batches:
            if not batch.num_rows:
                continue
            group, a = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            pair = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            b = batch.column(2).fill_null(0).to_numpy(zero_copy_only=False)
            data, offsets = byte_columns(batch.column(3))
            good: tuple[list, list] = ([], [])
            for x, y in _runs([group, pair]):
                if group[x] != last:
                    last, sets, place = group[x], [], {}
                if not pair[x]:
                    for k, own in enumerate(shingle_sets([data[offsets[i] : offsets[i + 1]].tobytes() for i in range(x, y)], weighted)):
                        place.setdefault(int(a[x + k]), []).append(len(sets))
                        sets.append(own)
                    continue
                # a doc_id with several texts is similar if one of them is
                ends = [(i, p, q) for i in range(x, y) for p in place.get(int(a[i]), ()) for q in place.get(int(b[i]), ())]
                if ends:
                    row, p, q = (np.array(e) for e in zip(*ends, strict=True))
                    row = np.unique(row[similarities(sets, p, q) >= least])
                    good[0].append(a[row])
                    good[1].append(b[row])
            yield _pairs_batch(*good)

    return run


def verify(pairs: DataFrame, texts: DataFrame, least: float, blocks: int, weighted: bool = False) -> DataFrame:
    """The pairs (a, b) of documents whose (doc, text) have at least this similarity; documents fall into ``blocks`` by hash."""
    block = lambda c: F.pmod(F.xxhash64(F.lit(3), c), F.lit(blocks))
    grouped = pairs.select((F.least(block("a"), block("b")) * blocks + F.greatest(block("a"), block("b"))).alias("group"), "a", "b")
    needs = grouped.select("group", F.explode(F.array("a", "b")).alias("doc")).distinct()
    rows = needs.join(texts, "doc").select("group", F.col("doc").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    rows = rows.unionByName(grouped.withColumn("text", F.lit(None).cast("string")))
    return rows.repartition("group").sortWithinPartitions("group", F.col("b").isNotNull()).mapInArrow(released(_verify_batches(least, weighted)), "a long, b long").distinct()


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in as many tasks as its number of rows asks for."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, rows // TASK_ROWS + 1))


def components(links: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(node, class) of every node in a link (a, b): the smallest node that it is connected to."""
    links = links.where("a <> b")
    edges = scratch.table(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{tag}-0")
    turn, seen, n = 0, None, edges.count()
    while n:
        both = edges.union(edges.select("b", "a"))
        low = few(both.groupBy("a").agg(F.min("b").alias("m")), n).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("m").alias("a"), F.col("b"))
        large = few(large.where("a <> b").distinct(), n)
        down = large.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("u"), "m")
        small = large.join(down, F.col("b") == F.col("u")).select(F.col("m").alias("x"), F.col("a").alias("y")).union(down.select(F.col("m").alias("x"), F.col("u").alias("y")))
        small = few(small.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), n).distinct()
        turn += 1
        edges = scratch.table(few(small, n), f"{tag}-{turn}")
        scratch.drop(f"{tag}-{turn - 1}")
        n, *rest = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, rest) == seen:
            break
        seen = n, rest
    classes = edges.groupBy("b").agg(F.min("a").alias("class")).select(F.col("b").alias("node"), "class")
    return few(classes.union(edges.select(F.col("a").alias("node"), F.col("a").alias("class")).distinct()), n)


def _keep_batches(held):
    """The rows whose first column, an id, the filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, bits = _slots(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), len(held.value))
            yield batch.filter(pa.array((held.value[at] & bits) == bits))

    return run


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.8, weighted: bool = False) -> DataFrame:
    """(doc_id, class_id) of each row: documents of one class are copies or are linked by similar texts.

    With ``weighted`` a shingle weighs as often as it stands in the text.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    none = F.lit(-(1 << 63))
    plain = docs.select(F.coalesce(F.col(doc_id).cast("long"), none).alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    banded = plain.select("text", "doc", F.unhex(F.md5("text")).alias("copy")).mapInArrow(released(_band_batches(weighted)), "doc long, copy binary, bands array<long>, sketch binary")
    banded = scratch.table(banded, "banded")
    members = banded.select("doc", "copy")
    nodes = scratch.table(banded.groupBy("copy").agg(F.min("doc").alias("node"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "nodes")

    # documents that share a bucket, and their texts
    spots = nodes.select(F.explode("bands").alias("key"), "node")
    sizes = scratch.table(spots.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    buckets = scratch.table(join_counted(spots, sizes, "key", "n"), "buckets")
    scratch.drop("sizes")
    ids = scratch.table(buckets.select("node").distinct(), "ids")
    number = ids.count()
    held = spark.sparkContext.broadcast(seen_filter(ids, filter_words(number, words_per_row=1)))
    maybe = plain.mapInArrow(released(_keep_batches(held)), "doc long, text string")
    texts = scratch.table(maybe.join(ids.withColumnRenamed("node", "i_node"), F.col("doc") == F.col("i_node"), "left_semi").select("doc", "text").distinct(), "texts")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = int(max(1, -(-number // BLOCK), -(-size // BLOCK_BYTES)))
    sketches = nodes.select("node", "sketch").mapInArrow(_keep_batches(held), "node long, sketch binary")
    crowd = scratch.table(buckets.join(sketches, "node").select("key", "n", "node", "sketch"), "crowd")
    scratch.drop("buckets")

    k = BANDS * ROWS
    deviation = k * math.sqrt(max(0.0, least * (1 - least)) / k)
    in_block = F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("n") / BLOCK).cast("long")).cast("int")
    blocked = crowd.select("key", in_block.alias("block"), "node", "sketch").repartition("key", "block").sortWithinPartitions("key", "block")
    forest = scratch.table(blocked.mapInArrow(_forest_batches(k * least - 2 * deviation), "a long, b long").distinct(), "forest")
    links = verify(forest, texts, least, parts, weighted)
    # a doc_id with several texts unites their nodes
    several = scratch.table(members.groupBy("doc").agg(F.min(F.xxhash64("copy")).alias("lo"), F.max(F.xxhash64("copy")).alias("hi")).where("lo < hi").select("doc"), "several")
    if not several.isEmpty():
        theirs = members.join(several, "doc").distinct().join(nodes.select("copy", "node"), "copy")
        first = theirs.groupBy("doc").agg(F.min("node").alias("a"))
        links = links.union(theirs.join(first, "doc").select("a", F.col("node").alias("b")))
    classes = scratch.table(components(links, scratch, "first"), "classes")

    named = crowd.join(classes, "node", "left").select("key", "node", F.coalesce("class", "node").alias("class"), "sketch")
    named = scratch.table(named, "named")
    shares = named.groupBy("key", "class").agg(F.count(F.lit(1)).alias("c"))
    mixed = shares.groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "class")).alias("most")).where("most.c < n").select("key", "n", F.col("most.class").alias("large"))
    rows = join_counted(named, scratch.table(mixed, "mixed"), "key", "n")
    several_blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    at_home = F.array(F.struct(in_block.alias("block"), F.lit(0).alias("visits")))
    away = F.when((several_blocks > 1) & (F.col("class") != F.col("large")), F.transform(F.sequence(F.lit(0), several_blocks - 1), lambda i: F.struct(i.cast("int").alias("block"), F.lit(1).alias("visits"))))
    spread = rows.select("key", F.explode(F.concat(at_home, F.coalesce(away, F.array().cast("array<struct<block:int,visits:int>>")))).alias("p"), "node", "class", "large", "sketch")
    spread = spread.select("key", "p.block", "p.visits", "node", "class", "large", "sketch").repartition("key", "block").sortWithinPartitions("key", "block", "visits")
    screen = k * least - MARGIN * deviation
    doubt = scratch.table(spread.mapInArrow(released(_doubt_batches(screen)), "key long, block int, visits int, node long, class long, large long, sketch binary"), "doubt")
    settled = doubt.join(texts.withColumnRenamed("doc", "node"), "node").select("key", "block", "visits", "node", "class", "large", "sketch", "text")
    settled = settled.repartition("key", "block").sortWithinPartitions("key", "block", "visits")
    more = scratch.table(settled.mapInArrow(released(_settle_batches(screen, least, weighted)), "a long, b long").distinct(), "more")
    class_of = lambda side: classes.select(F.col("node").alias(side), F.col("class").alias(f"c{side}"))
    between = more.join(class_of("a"), "a", "left").join(class_of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    united = scratch.table(components(between, scratch, "second").select(F.col("node").alias("u_node"), F.col("class").alias("u_class")), "united")

    # copies of more than one row, and texts whose class is not their own id
    known = nodes.select("copy", "node", "n").join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    known = known.join(united, F.col("class") == F.col("u_node"), "left").select("copy", "n", "node", F.coalesce("u_class", "class").alias("class_id")).where("n > 1 or node <> class_id").select("copy", "n", "class_id")
    known = scratch.table(known, "known")
    scratch.drop("nodes", "texts", "crowd", "named", "mixed", "forest", "doubt", "more", "ids", "several", "classes", "united")
    return join_counted(members, known, "copy", "n", how="left").select(
        F.when(F.col("doc") != none, F.col("doc")).alias("doc_id"), F.coalesce("class_id", "doc").alias("class_id")
    ).withColumn("class_id", F.when(F.col("class_id") != none, F.col("class_id")))
