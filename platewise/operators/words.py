"""What the words of a row say, found inside Arrow batches without a row a word."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BUCKETS = 256
#: Terms whose bucket a task remembers at once.
KNOWN = 200_000
#: Texts whose words are looked up at once (a parameter of memory, not of the result).
TEXTS = 256
#: Bytes of UTF-8 by what they do in a text: a-z stand in words, \n ends lines, all others part words.
_PARTED = bytes(b if b == 10 or 97 <= b <= 122 else 32 for b in range(256))


def bucket_counts(rows: DataFrame, key: str, names: str) -> DataFrame:
    """(key, bucket, n, len): how many words and word pairs of a row's names fall into each md5 bucket, and the length of all counts.

    names: array<array<string>>, the words of each name. A word pairs with the next place of every name of the row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}

        def bucket(term: str) -> int:
            found = known.get(term)
            if found is None:
                if len(known) >= KNOWN:
                    known.clear()
                found = known[term] = int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % BUCKETS
            return found

        for batch in batches:
            own, buckets, counts, lengths = [], [], [], []
            for i, named in enumerate(batch.column(1).to_pylist()):
                found = Counter(bucket(w) for words in named for w in words)
                found.update(bucket(f"{x} {y}") for a in named for b in named for x, y in zip(a, b[1:], strict=False))
                own += [i] * len(found)
                buckets += found.keys()
                counts += found.values()
                lengths += [math.sqrt(sum(n * n for n in found.values()))] * len(found)
            columns = [batch.column(0).take(pa.array(own, pa.int64())), pa.array(buckets, pa.int32()), pa.array(counts, pa.int64()), pa.array(lengths, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [key, "bucket", "n", "len"])

    return rows.select(key, names).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, bucket int, n long, len double")


def _parted(texts: pa.Array) -> pa.Array:
    """The texts with a space for each byte that is neither a-z nor a line feed; their lengths in bytes stay."""
    _, offsets, data = texts.buffers()
    return pa.Array.from_buffers(texts.type, len(texts), [None, offsets, data and pa.py_buffer(data.to_pybytes().translate(_PARTED))], offset=texts.offset)


def least_codes(texts: DataFrame, key: str, text: str, codes: dict[str, int], other: int) -> DataFrame:
    """(key, line_order, code): for each line with any sign, the smallest code of its words, ``other`` for a line without such words.

    texts: lower-cased, not null; words are runs of a-z. codes: word to code, below ``other`` and 127; it travels to every task.
    """
    codes = {w: code for w, code in codes.items() if w}  # an empty one would be found between two spaces
    known, by_place = pa.array(list(codes), pa.string()), np.array([*codes.values(), other], np.int8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parted, asked = _parted(batch.column(1)), known.cast(batch.column(1).type)
            for at in range(0, batch.num_rows, TEXTS):
                listed = pc.split_pattern(parted.slice(at, TEXTS), "\n")
                size = pc.list_value_length(listed).to_numpy()
                lines, own = listed.flatten(), np.repeat(np.arange(len(size)), size)
                order = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
                full = pc.greater(pc.binary_length(lines), 0)
                own, order = (x[full.to_numpy(zero_copy_only=False)] for x in (own, order))
                if not len(own):
                    continue
                words = pc.split_pattern(lines.filter(full), " ")  # never an empty list
                found = by_place[pc.fill_null(pc.index_in(words.flatten(), asked), len(codes)).to_numpy()]
                first = np.append(0, np.cumsum(pc.list_value_length(words).to_numpy())[:-1])
                columns = [batch.column(0).take(pa.array(at + own)), pa.array(order, pa.int32()), pa.array(np.minimum.reduceat(found, first), pa.int8())]
                yield pa.RecordBatch.from_arrays(columns, [key, "line_order", "code"])

    return texts.select(key, text).mapInArrow(run, f"{key} {texts.schema[key].dataType.simpleString()}, line_order int, code byte")
