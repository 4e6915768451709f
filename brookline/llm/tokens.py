"""Token counts of whole texts, from a table of frequent pre-tokens and worker caches.

A pre-token is what a sentence-piece model of the BPE kind can't merge across: a run of
spaces with the word after it, or a line feed. Two facts about the model make this exact,
and both are checked when it is opened: no piece has the space mark after another
character, and none has a line feed. So a text's number of tokens is the sum over its
pre-tokens.

Tier one is a compact table, 64-bit hash to length, of the most frequent pre-tokens of
the corpus; its number of entries is a parameter, so the broadcast has a fixed bound.
Tier two is a cache of misses in each worker, also bounded. The documents' pre-tokens aren't
shuffled; the pass that finds frequent ones sends hashes, sizes and counts of each task's own
heaviest (at most half of the table's entries a task) to be added up.

Defined results: a row for every input row, an empty table for an empty one; null and empty texts
have 0 bytes and 0 tokens; very long texts are counted whole. Repeated rows are counted like any
other; extra columns are ignored. Pre-tokens that tie in frequency are taken by their hashes,
which changes no count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookline.llm import text as T

MARK = "▁"
FREQUENT = 1 << 16
CACHE_BITS = 20

_opened: dict[str, object] = {}


def processor(model: str):
    """The library's processor, opened once in a process; model: a path, or a name sent with addFile."""
    if model not in _opened:
        import os

        import sentencepiece

        at = model if os.path.exists(model) else SparkFiles.get(os.path.basename(model))
        sp = sentencepiece.SentencePieceProcessor(model_file=at)
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if "\n" in piece or MARK in piece.lstrip(MARK):
                raise ValueError(f"pieces may not cross words or lines: {piece!r}")
        _opened[model] = sp
    return _opened[model]


def pretokens(chunk: T.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of a chunk's pre-tokens, and the first of each row with the total."""
    data, offsets = chunk.data, chunk.offsets
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), np.zeros(len(offsets), np.int64)
    space, feed = data == 0x20, data == 0x0A
    starts = np.zeros(n, dtype=bool)
    starts[1:] = (space[1:] & ~space[:-1]) | feed[1:] | feed[:-1]
    starts[offsets[:-1][offsets[:-1] < n]] = True
    start = np.flatnonzero(starts)
    end = np.append(start[1:], n)
    h = T.span_hash(T.prefix(T.BYTE_CODE[data]), start, end)
    first = np.searchsorted(start, offsets)
    lead = first[:-1][np.diff(first) > 0]
    h[lead] = T.mix(h[lead] + np.uint64(0x5851F42D4C957F2D))  # the library puts a space before a text
    return start, end, h, first


class Lengths:
    """Hash to a number: the broadcast table first, then what this worker has met, in a table of fixed size where a later key takes the place of an earlier one."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int = CACHE_BITS):
        self.keys, self.values, self.mask = keys, values, np.uint64((1 << bits) - 1)
        self.met, self.value = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where there is none."""
        slot = (keys & self.mask).astype(np.int64)
        out = np.where(self.met[slot] == keys, self.value[slot], np.int32(-1))
        if len(self.keys):
            at = np.searchsorted(self.keys, keys)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == keys
            out[hit] = self.values[at[hit]]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        slot = (keys & self.mask).astype(np.int64)
        self.met[slot], self.value[slot] = keys, values

    def forget(self) -> None:
        self.value[:] = -1


def lengths_of(sp, raw: list[bytes], lead: np.ndarray) -> np.ndarray:
    """Tokens of pre-tokens; where one doesn't begin a text, the space that the library adds is taken off again."""
    out = np.empty(len(raw), np.int32)
    texts, where = [], []
    for i, x in enumerate(raw):
        if x == b"\n" and not lead[i]:
            out[i] = 1 if sp.is_byte(sp.piece_to_id("<0x0A>")) else len(sp.encode("\n")) - 1
        elif lead[i]:
            texts.append(x.decode("utf-8", "replace"))
            where.append(i)
        elif x[:1] == b" ":
            texts.append(x[1:].decode("utf-8", "replace"))
            where.append(i)
        else:  # after a line feed: no space before it. A line feed never merges, so it can stand before and be taken off.
            texts.append("\n" + x.decode("utf-8", "replace"))
            where.append(~i)
    alone = len(sp.encode("\n"))
    for i, ids in zip(where, sp.encode(texts, num_threads=1), strict=True):
        if i < 0:
            out[~i] = len(ids) - alone
        else:
            out[i] = max(len(ids), 1)
    return out


def counter(model: str, keys: np.ndarray, values: np.ndarray) -> Callable[[T.Chunk], np.ndarray]:
    """A function from a chunk to the token counts of its rows."""
    known = Lengths(keys, values)
    sp = processor(model)

    def count(chunk: T.Chunk) -> np.ndarray:
        start, end, h, first = pretokens(chunk)
        n = known.find(h)
        miss = np.flatnonzero(n < 0)
        if len(miss):
            new, at = np.unique(h[miss], return_index=True)
            at = miss[at]
            data = chunk.data.tobytes()
            raw = [data[s:e] for s, e in zip(start[at].tolist(), end[at].tolist())]
            got = lengths_of(sp, raw, np.isin(at, first[:-1]))
            known.add(new, got)
            n[miss] = got[np.searchsorted(new, h[miss])]
        total = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        out = total[first[1:]] - total[first[:-1]]
        if b"\xe2\x96\x81" in (whole := chunk.data.tobytes()):  # a text that has the mark itself: the library takes it for a space
            for r in range(chunk.rows):
                if MARK.encode() in (x := whole[chunk.offsets[r] : chunk.offsets[r + 1]]):
                    out[r] = len(sp.encode(x.decode("utf-8", "replace")))
        return out

    return count


def frequent(docs: DataFrame, text: str, model: str, entries: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The compact table: hashes (sorted) and token counts of the corpus's most frequent pre-tokens.

    Counts are over all documents. A task sends its own `entries` heaviest; one heavy enough to
    matter overall is heavy in some task. A miss costs time, never a wrong count.
    """

    def heaviest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64), {}
        for batch in batches:
            for _, chunk in T.pieces(batch, text):
                start, end, h, first = pretokens(chunk)
                new, at, number = np.unique(h, return_index=True, return_counts=True)
                keep = number > 1
                new, at, number = new[keep], at[keep], number[keep]
                data = chunk.data.tobytes()
                lead = set(first[:-1].tolist())
                fresh = np.flatnonzero(~np.isin(new, keys))
                for i in fresh.tolist():
                    rows[int(new[i])] = (data[start[at[i]] : end[at[i]]], int(at[i]) in lead)
                keys, where = np.unique(np.concatenate([keys, new]), return_inverse=True)
                counts = np.bincount(where, weights=np.concatenate([counts, number]), minlength=len(keys)).astype(np.int64)
                if len(keys) > 4 * entries:
                    best = np.sort(np.argpartition(counts, -entries)[-entries:])
                    keys, counts = keys[best], counts[best]
                    rows = {k: rows[k] for k in keys.tolist()}
        if len(keys) > entries // 2:
            best = np.sort(np.argpartition(counts, -(entries // 2))[-(entries // 2) :])
            keys, counts = keys[best], counts[best]
        if len(keys):
            own = [rows[k] for k in keys.tolist()]
            sizes = lengths_of(processor(model), [x for x, _ in own], np.array([x for _, x in own]))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sizes), pa.array(counts)], ["key", "size", "times"])

    sent = docs.select(text).mapInArrow(T.task(heaviest), "key long, size int, times long")
    top = sent.groupBy("key").agg(F.first("size").alias("size"), F.sum("times").alias("times")).orderBy(F.desc("times"), "key").limit(entries)
    got = top.select("key", "size").toArrow()
    keys = got["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], got["size"].to_numpy()[order].astype(np.int32)


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, entries: int = FREQUENT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row; model: path of a sentence-piece model, on every node or sent with addFile."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(frequent(docs, text, model, entries))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(model, *table.value)
        for batch in batches:
            for part, chunk in T.pieces(batch, text):
                n = tokens(chunk)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(chunk.offsets)), pa.array(n), pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(T.task(count), f"{id_col} {kind}, n_bytes long, n_tokens long, over_limit boolean")
