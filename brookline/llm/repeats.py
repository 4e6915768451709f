"""Substring dedup: passages that a document with a smaller id has already.

A window is `window` consecutive words. Each window has an anchor: the phrase of `phrase`
words in it with the smallest hash, leftmost if tied. Equal windows have equal anchors, so

1. a text that a smaller id has too, word for word, is a copy: if it has a window, all of it goes, and
   it owns nothing, so only first texts go on;
2. phrases that are anchors in two documents or more are the recurring ones (minimum and
   maximum id and number by phrase, combined map-side: a hot phrase is a few rows a task);
3. the PHRASES that recur most, a bounded number however large the corpus, are taken from the
   documents that own them and compiled into SHARDS Aho-Corasick automata by their hashes. All
   documents stream through each of them, where they lie; windows whose anchor is located are
   candidates. So the phrases that a third of all documents may share are never shuffled again;
4. the recurring phrases that are left, of which there may be any number, meet their own documents by
   id, and hashes locate them there. (Automata of all of them would be a pass over the corpus
   for each shard, and their number grows with the corpus.) Every window's anchor is one or the other;
5. the smallest id of each candidate window's hash is its owner. Windows in documents other than the
   owner go back to their documents, and the words they cover are removed.

A window is compared by a 64-bit hash of its word sequence, a text by 128 bits. Groups of any size
cost one row for each occurrence; nothing is paired, and hot windows are split by adaptive skew joins.
Documents meet a table of ids as a broadcast up to a million ids, so texts that nothing is said of aren't shuffled.

Defined results: a row for every input row, an empty table for an empty one. Null and empty texts have no
words; very long ones are read whole. Rows without an id lose nothing and own nothing. Rows that
share an id never take from each other. Phrases that tie in a window go by the leftmost, and those that
tie in how often they recur by their hashes, which changes no row. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookline.llm import text as T
from brookline.llm.shared import SMALL, Scratch, small

WINDOW, PHRASE = 50, 10
PHRASES, SHARDS = 1 << 15, 2
U = np.uint64


def windows(w: T.Words, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows and first words of all windows, the first words of their anchors, and all phrase hashes by first word."""
    n, span = len(w.hash), window - phrase + 1
    count = np.diff(w.first)
    number = np.maximum(count - window + 1, 0)
    row = np.repeat(np.arange(len(count)), number)
    if not len(row):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, U)
    at = np.arange(len(row)) - np.concatenate([[0], np.cumsum(number)])[row] + w.first[row]
    sums = T.prefix(w.hash)
    first = np.arange(n - phrase + 1)
    h = T.span_hash(sums, first, first + phrase)
    low, size = (h & ~U(0xFFFFFFFF)) | first.astype(U), 1  # position in the lower half: leftmost wins
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    return row, at, (low[at] & U(0xFFFFFFFF)).astype(np.int64), h


def _anchors(window: int, phrase: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, chunk in T.pieces(batch, "text"):
                row, _, anchor, h = windows(T.words(chunk), window, phrase)
                if len(row):
                    new = np.ones(len(row), bool)
                    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
                    ids = part.column(0).to_numpy()[row[new]]
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(h[anchor[new]].view(np.int64))], ["doc_id", "phrase"])

    return scan


def _key(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    return T.mix(h + row.astype(U) * U(0x9E3779B97F4A7C15))


def _listed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and values of a column of lists of longs; null is empty."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), lengths), column.flatten().to_numpy(zero_copy_only=False).view(U)


class Shards:
    """The phrases of each automaton, as words with one space around each; a worker compiles them once."""

    compiled: tuple[str, list] = ("", [])

    def __init__(self, phrases: list[bytes], keys: np.ndarray, number: int = SHARDS):
        self.name, self.phrases = uuid.uuid4().hex, [[x for x, k in zip(phrases, keys.tolist()) if k % number == shard] for shard in range(number)]

    def automata(self) -> list:
        if Shards.compiled[0] != self.name:
            made = []
            for own in self.phrases:
                automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
                for x in own:
                    automaton.add_word(x.decode("latin-1"), 1)
                if own:
                    automaton.make_automaton()
                    made.append(automaton)
            Shards.compiled = (self.name, made)
        return Shards.compiled[1]


def locate(chunk: T.Chunk, w: T.Words, automata: list, phrase: int) -> np.ndarray:
    """By word: whether a phrase of an automaton begins there. An automaton reads each row's words with one space around each."""
    here = np.zeros(len(w.hash) + 1, bool)
    data, size = chunk.data.tobytes(), w.end - w.start
    rows = [data[a:b].split() for a, b in zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist())]
    stream = b"".join(b"\n " + b" ".join(r) + b" " for r in rows if r).decode("latin-1")
    lead = np.zeros(len(size), np.int64)
    lead[w.first[:-1][np.diff(w.first) > 0]] = 2
    after = np.cumsum(size + 1 + lead) - 1  # place of the space after each word
    for automaton in automata:
        ends = np.fromiter((e for e, _ in automaton.iter(stream)), np.int64)
        here[np.searchsorted(after, ends) - (phrase - 1)] = True
    return here[:-1]


def _windows_of(part: pa.RecordBatch, row: np.ndarray, at: np.ndarray, w: T.Words, window: int) -> pa.RecordBatch:
    """doc_id and hash of windows, once for each in a row."""
    h = T.span_hash(T.prefix(w.hash), at, at + window)
    _, one = np.unique(_key(row, h), return_index=True)
    return pa.RecordBatch.from_arrays([pa.array(part.column(0).to_numpy()[row[one]]), pa.array(h[one].view(np.int64))], ["doc_id", "w"])


def _hot_phrases(window: int, phrase: int, keys: np.ndarray, owners: np.ndarray):
    """Words of the phrases (sorted keys) that a document owns."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, chunk in T.pieces(batch, "text"):
                w = T.words(chunk)
                row, _, anchor, h = windows(w, window, phrase)
                if not len(row):
                    continue
                place = np.minimum(np.searchsorted(keys, h[anchor]), len(keys) - 1)
                mine = (keys[place] == h[anchor]) & (owners[place] == part.column(0).to_numpy()[row])
                k, one = np.unique(place[mine], return_index=True)
                data = chunk.data.tobytes()
                out = [b" " + b" ".join(data[a:b] for a, b in zip(w.start[s : s + phrase].tolist(), w.end[s : s + phrase].tolist())) + b" " for s in anchor[mine][one].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(keys[k].view(np.int64)), pa.array(out, pa.binary())], ["phrase", "words"])

    return scan


def _located(window: int, phrase: int, sent):
    """Windows whose anchor the automata locate."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = sent.value.automata()
        for batch in batches:
            for part, chunk in T.pieces(batch, "text"):
                w = T.words(chunk)
                row, at, anchor, _ = windows(w, window, phrase)
                if len(row) and (take := locate(chunk, w, automata, phrase)[anchor]).any():
                    yield _windows_of(part, row[take], at[take], w, window)

    return scan


def _candidates(window: int, phrase: int):
    """Windows whose anchor is one of the document's listed phrases."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, chunk in T.pieces(batch, "text"):
                w = T.words(chunk)
                row, at, anchor, h = windows(w, window, phrase)
                own_row, own = _listed(part.column(2))
                take = np.isin(_key(row, h[anchor]), _key(own_row, own)) if len(row) else np.zeros(0, bool)
                if take.any():
                    yield _windows_of(part, row[take], at[take], w, window)

    return scan


def _removal(window: int, phrase: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, chunk in T.pieces(batch, "text"):
                w = T.words(chunk)
                mark = np.zeros(len(w.hash) + 1, np.int64)
                own_row, own = _listed(part.column(2))
                if len(own):
                    g = T.grams(w, window)
                    gone = g.at[np.isin(_key(g.row, g.hash), _key(own_row, own))]
                    np.add.at(mark, gone, 1)
                    np.add.at(mark, gone + window, -1)
                keep = np.cumsum(mark)[:-1] == 0
                count = np.diff(w.first)
                keep &= ~np.repeat(part.column(3).to_numpy(zero_copy_only=False) & (count >= window), count)
                total = np.concatenate([[0], np.cumsum(~keep)])
                removed = total[w.first[1:]] - total[w.first[:-1]]
                data = chunk.data.tobytes()
                left = []
                for r in range(chunk.rows):
                    found = data[chunk.offsets[r] : chunk.offsets[r + 1]].split()
                    if removed[r]:
                        found = compress(found, keep[w.first[r] : w.first[r + 1]].tolist())
                    left.append(b" ".join(found))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(w.first)), pa.array(removed), pa.array([hashlib.sha256(x).hexdigest() for x in left]), pa.array(left, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
                )

    return scan


def _of(texts: DataFrame, table: DataFrame) -> DataFrame:
    """The texts joined to a table's column by id; those that it says nothing of aren't shuffled, if it has at most a million ids."""
    ids = table.select("doc_id")
    return (texts.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= SMALL else texts).join(table, "doc_id")


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, most: int = PHRASES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the text that is left) for every row; most: how many phrases automata locate."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("again"), F.col("text")).alias("h2"))
    firsts = texts.where("doc_id is not null and text is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h1", "h2", "a")
    firsts = scratch.keep(firsts, "firsts")
    marked = texts.join(small(firsts), ["h1", "h2"], "left").select("doc_id", "text", F.coalesce(F.col("doc_id") > F.col("a"), F.lit(False)).alias("copy"))
    named = marked.where("doc_id is not null and not copy").select("doc_id", "text")

    anchors = scratch.keep(named.mapInArrow(T.task(_anchors(window, phrase)), "doc_id long, phrase long"), "anchors")
    recurring = anchors.groupBy("phrase").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).where("a < b").select("phrase", "a", "n")
    recurring = scratch.keep(recurring, "recurring")
    hot = scratch.keep(recurring.orderBy(F.desc("n"), "phrase").limit(most).select("phrase", F.col("a").alias("doc_id")), "hot")

    got = hot.toArrow()  # at most `most` rows
    keys, owners = got["phrase"].to_numpy().view(U), got["doc_id"].to_numpy()
    order = np.argsort(keys)
    words = named.join(F.broadcast(hot.select("doc_id").distinct()), "doc_id", "left_semi").mapInArrow(T.task(_hot_phrases(window, phrase, keys[order], owners[order])), "phrase long, words binary").dropDuplicates(["phrase"]).toArrow()
    sent = spark.sparkContext.broadcast(Shards(words["words"].to_pylist(), words["phrase"].to_numpy().view(U)))
    located = named.mapInArrow(T.task(_located(window, phrase, sent)), "doc_id long, w long")

    cold = recurring.join(F.broadcast(hot.select("phrase")), "phrase", "left_anti").select("phrase")
    phrases = scratch.keep(anchors.join(cold, "phrase").groupBy("doc_id").agg(F.collect_set("phrase").alias("phrases")), "phrases")
    scratch.drop(anchors, recurring)
    scratch.sweep()
    known = _of(named, phrases).select("doc_id", "text", "phrases").mapInArrow(T.task(_candidates(window, phrase)), "doc_id long, w long")
    found = scratch.keep(located.unionByName(known), "windows")
    sent.destroy()
    scratch.drop(phrases, hot)
    scratch.sweep()
    owned = found.groupBy("w").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").select("w", "owner")
    gone = scratch.keep(found.join(owned, "w").where("doc_id > owner").groupBy("doc_id").agg(F.collect_set("w").alias("gone")), "gone")
    scratch.drop(found)
    scratch.sweep()

    # Documents that lose windows meet them; the others stay where they are.
    ids = gone.select("doc_id")
    if ids.count() <= SMALL:
        rest = marked.join(F.broadcast(ids), "doc_id", "left_anti").withColumn("gone", F.lit(None).cast("array<bigint>"))
        joined = _of(marked, gone).select("doc_id", "text", "gone", "copy").unionByName(rest.select("doc_id", "text", "gone", "copy"))
    else:
        joined = marked.join(gone, "doc_id", "left").select("doc_id", "text", "gone", "copy")
    return joined.mapInArrow(T.task(_removal(window, phrase)), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
