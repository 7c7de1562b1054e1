"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over 16 bytes cuts each text into chunks that depend on their content only, so
chunks that documents share are found again at any offset; a task encodes each of them once
and keeps the ids. At a join the two chunks may have broken a word, so a window from the last whole
word of the left chunk to the first whole word of the right one is encoded again. If the
window's ids agree with the ids that both chunks gave their whole words, it is spliced in. Pieces that
hold too few words for such a window (a run without white space may be one word) are put together
before anything is encoded; where a join still disagrees, the rest of the document is encoded as
one chunk. So every byte is encoded at most twice.

Within a new chunk, words (split at ASCII white space, where the tokenizer always splits too)
are memoised, so only new words reach the tokenizer. Caches are bounded by their bytes and are per task;
words over ``LONG`` bytes are encoded but not kept; no text is shuffled.

Defined cases: a null text is an empty one, with no ids and an empty decoded text; rows are
independent, so repeated rows give equal results; further columns are carried through, but for those with the name of
an added column, which are replaced.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from platewise.llm.columns import carried, schema_of
from platewise.llm.text_arrays import blocks, released, rolling_hash

WINDOW = 16
#: Longest word in bytes that the memo keeps, and words that a piece needs at least for both of its joins.
LONG, LEAST_WORDS = 256, 4
_SPACES = b" \t\n\x0b\x0c\r"


#: A word of printable ASCII and Latin-1 letters: composed already, one lower-case letter for each letter.
_SIMPLE = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
#: Byte-level alphabet: bytes that print stand for themselves, the others follow from 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LEVEL = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def _piece_pattern(tokenizer_json: str):
    """The pattern of pre-tokens, if the file has the pipeline that the short cut knows; else None."""
    spec = json.loads(tokenizer_json)
    normal = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    pre = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    known = normal == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in pre] == ["Split", "ByteLevel"]
    if not known or not pre[0].get("invert") or pre[0]["behavior"] != "Removed" or pre[1]["use_regex"] or pre[1]["add_prefix_space"] or spec["post_processor"] or spec["decoder"]:
        return None
    return regex.compile(pre[0]["pattern"]["Regex"])


def cut_points(data: np.ndarray, mean: int = 2048) -> np.ndarray:
    """Content-defined cuts of one block of bytes: only before a UTF-8 lead byte."""
    if len(data) <= WINDOW:
        return np.zeros(0, np.int64)
    at = np.arange(WINDOW, len(data))
    hashes = rolling_hash(data, WINDOW)[:-1]
    return at[((hashes % np.uint64(mean)) == 0) & ((data[at] & 0xC0) != 0x80)]


class Chunk:
    """The ids and the decoded text of one chunk, and the words at its edges."""

    __slots__ = ("decoded", "head", "ids", "raw", "tail")

    def __init__(self, raw: bytes, ids: bytes, decoded: list[bytes], head, tail):
        self.raw, self.ids, self.decoded, self.head, self.tail = raw, ids, decoded, head, tail


class ChunkEncoder:
    """Encodes texts exactly as the tokenizer does, chunk by chunk."""

    def __init__(self, tokenizer_json: str, mean: int = 2048, most_words: int = 220_000, most_bytes: int = 16 << 20, most_word_bytes: int = 32 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(tokenizer_json)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.mean, self.most_words, self.most_bytes, self.most_word_bytes = mean, most_words, most_bytes, most_word_bytes
        self.names = [b""] * (1 + max(self.tok.get_vocab().values()))
        for name, i in self.tok.get_vocab().items():
            self.names[i] = name.encode()
        self.model, self.pieces = self.tok.model, {}
        self.pattern = _piece_pattern(tokenizer_json)
        self.words: dict[bytes, tuple[bytes, bytes]] = {}
        self.chunks: dict[bytes, Chunk] = {}
        self.held = self.word_bytes = 0

    def _plain(self, text: str) -> tuple[bytes, bytes]:
        ids = self.tok.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes(), self.tok.decode(ids, skip_special_tokens=False).encode()

    def _by_model(self, text: str) -> list[int]:
        """The ids of a word of plain letters, digits and signs: its pre-tokens go straight to the BPE model."""
        ids: list[int] = []
        for piece in self.pattern.findall(text.lower()):
            got = self.pieces.get(piece)
            if got is None:
                got = array("I", [t.id for t in self.model.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTE_LEVEL))])
                if len(piece) <= LONG:
                    if len(self.pieces) >= self.most_words // 2:
                        self.pieces.clear()
                    self.pieces[piece] = got
                    self.word_bytes += len(piece) + 8 * len(got)
            ids += got
        return ids

    def _word(self, w: bytes) -> tuple[bytes, bytes]:
        text = w.decode()
        if self.pattern is None or b"<|" in w or not _SIMPLE(text):
            return self._plain(text)
        ids = self._by_model(text)
        return array("I", ids).tobytes(), b" ".join([self.names[i] for i in ids])

    def learn(self, words: list[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
        """Encode the words that are new; the long ones among them are returned and not kept."""
        new = set(words).difference(self.words)
        if len(self.words) + len(new) > self.most_words or self.word_bytes > self.most_word_bytes:
            self.words.clear()
            self.pieces.clear()
            self.word_bytes = 0
            new = set(words)
        long: dict[bytes, tuple[bytes, bytes]] = {}
        for w in new:
            got = self._word(w)
            if len(w) > LONG:
                long[w] = got
            else:
                self.words[w] = got
                self.word_bytes += len(w) + len(got[0]) + len(got[1])
        return long

    def encode_chunk(self, raw: bytes) -> Chunk:
        """Encode a chunk once; a repeated one comes from the cache."""
        found = self.chunks.get(raw)
        if found is not None:
            return found
        words = raw.split()
        try:
            parts = [self.words[w] for w in words]
        except KeyError:
            long = self.learn(words)
            parts = [self.words[w] if len(w) <= LONG else long[w] for w in words]
        broken_head = raw[:1] not in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
        broken_tail = raw[-1:] not in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
        head = tail = None
        if len(words) >= 4:
            # (text of the broken and the whole word, ids of the whole word, words and ids up to it)
            n = 2 if broken_head else 1
            head = b" ".join(words[:n]) if broken_head else b" " + words[0], parts[n - 1][0], n, sum(len(p[0]) for p in parts[:n])
            m = 2 if broken_tail else 1
            tail = b" ".join(words[-m:]) if broken_tail else words[-1] + b" ", parts[-m][0], m, sum(len(p[0]) for p in parts[-m:])
        chunk = Chunk(raw, b"".join([p[0] for p in parts]), [p[1] for p in parts], head, tail)
        size = 6 * len(raw) + 200
        if size > self.most_bytes // 16:
            return chunk  # one very long chunk would push all others out
        self.held += size
        if self.held > self.most_bytes:
            self.chunks.clear()
            self.held = size
        self.chunks[raw] = chunk
        return chunk

    @staticmethod
    def grouped(pieces: list[bytes]) -> list[bytes]:
        """The pieces with those of too few words put together, each byte copied once."""
        out: list[list[bytes]] = []
        words = LEAST_WORDS
        for piece in pieces:
            if words >= LEAST_WORDS:
                out.append([])
                words = 1
            out[-1].append(piece)
            words += len(piece.split()) - 1  # a cut may have broken a word
        if len(out) > 1 and words < LEAST_WORDS:
            last = out.pop()
            out[-1] += last
        return [p[0] if len(p) == 1 else b"".join(p) for p in out]

    def _join(self, left: Chunk, right: Chunk) -> tuple[bytes, bytes] | None:
        """The ids and decoded text of the window over a join, or None if it doesn't agree with its chunks."""
        if left.tail is None or right.head is None:
            return None
        ids, decoded = self._plain((left.tail[0] + right.head[0]).decode())
        a, b = left.tail[1], right.head[1]
        agree = len(ids) >= len(a) + len(b) and ids.startswith(a) and ids.endswith(b)
        return (ids, decoded) if agree else None

    def encode(self, pieces: list[bytes]) -> tuple[bytes, bytes]:
        """The ids (little-endian 32 bits each) and the decoded text of a document that is cut into ``pieces``."""
        ids: list[bytes] = []
        decoded: list[bytes] = []
        chunk = None
        skip_ids = skip_words = 0
        pieces = self.grouped(pieces)
        for k, piece in enumerate(pieces):
            right = self.encode_chunk(piece)
            if chunk is None:
                chunk = right
                continue
            window = self._join(chunk, right)
            whole = len(chunk.ids) - (chunk.tail[3] if chunk.tail else 0)
            if window is None or whole < skip_ids or len(chunk.decoded) - chunk.tail[2] < skip_words:
                merged = self.encode_chunk(chunk.raw + b"".join(pieces[k:]))
                if chunk.head != merged.head and (skip_ids or skip_words):
                    raise AssertionError("a merged chunk changed its head")
                chunk = merged
                break
            ids += [chunk.ids[skip_ids:whole], window[0]]
            decoded += [*chunk.decoded[skip_words : len(chunk.decoded) - chunk.tail[2]], window[1]]
            chunk, skip_ids, skip_words = right, right.head[3], right.head[2]
        if chunk is not None:
            ids.append(chunk.ids[skip_ids:])
            decoded += chunk.decoded[skip_words:]
        return b"".join(ids), b" ".join([d for d in decoded if d])


def tokenizer_text(path: str) -> str:
    """A tokenizer file's content; it is of fixed size and is sent to the executors with the task."""
    return Path(path).read_text(encoding="utf-8")


def encode_documents(docs: DataFrame, tokenizer_path: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """All columns of ``docs`` but the text, then bp_n_tokens, bp_ids_sha256, bp_decoded_sha256 (and bp_ids)."""
    held = docs.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer_path))
    extra = ["bp_n_tokens long", "bp_ids_sha256 string", "bp_decoded_sha256 string", *(["bp_ids binary"] if keep_ids else [])]
    added = [x.split(" ")[0] for x in extra]
    rest = carried(docs, added, text)
    names = ["bp_text", *(f"c{i}" for i in range(len(rest)))]
    plain = docs.select(text, *rest).toDF(*names)
    schema = ", ".join([*schema_of(docs, rest), *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        gc.disable()  # the memo holds many small objects and no cycles
        try:
            for batch in batches:
                if encoder is None:
                    encoder = ChunkEncoder(held.value)
                for a, b, data, offsets in blocks(batch.column(0)):
                    raw = data.tobytes()
                    cuts = cut_points(data, encoder.mean)
                    counts, id_sums, text_sums, all_ids = [], [], [], []
                    at = np.searchsorted(cuts, offsets, "right")
                    pieces = []
                    for k in range(b - a):
                        lo, hi = int(offsets[k]), int(offsets[k + 1])
                        own = [lo, *(int(c) for c in cuts[at[k] : at[k + 1]] if lo + WINDOW <= c < hi), hi]
                        pieces.append([raw[x:y] for x, y in zip(own, own[1:], strict=False) if y > x])
                    # the words of all new chunks at once; chunks that are known need no words
                    encoder.learn([w for own in pieces for p in own if p not in encoder.chunks for w in p.split() if len(w) <= LONG])
                    for own in pieces:
                        ids, decoded = encoder.encode(own)
                        counts.append(len(ids) // 4)
                        id_sums.append(hashlib.sha256(ids).hexdigest())
                        text_sums.append(hashlib.sha256(decoded).hexdigest())
                        if keep_ids:
                            all_ids.append(ids)
                    cols = [*(c.slice(a, b - a) for c in batch.columns[1:]), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())]
                    cols += [pa.array(all_ids, pa.binary())] if keep_ids else []
                    yield pa.RecordBatch.from_arrays(cols, [*names[1:], *added])
        finally:
            gc.enable()  # the worker may go on to other tasks

    out = plain.mapInArrow(released(run), schema)
    return out.toDF(*rest, *added)
