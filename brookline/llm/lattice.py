"""SentencePiece encoding and decoding over a relational lattice.

encode_words is the lattice: each distinct word is exploded into its substrings of bounded
length, those are equi-joined to the piece table, the edges that remain are grouped by word,
and a higher-order aggregate folds them into the best segmentation. For a unigram model the
fold is Viterbi's. For a model of the BPE kind the highest sum of scores is not what the library
returns, so the fold replays its merges over the lattice: at each step the adjacent pair whose
union is an edge with the highest score, leftmost if tied. Characters on no edge fall back to
bytes.

A text is more than its distinct words. Joining every occurrence back to an encoded word moves
each of them through a shuffle, several times the input, so encode_documents puts the corpus's
most frequent words (ENTRIES of at most WIDEST bytes, parameters; each task sends its own
PER_TASK heaviest) through the lattice, broadcasts their ids as flat arrays of bounded size, and
lets workers encode the rest by the library with a bounded cache. Both give the library's ids.

Defined results: a row for every input row, an empty table for an empty one; null and empty texts
have no ids and decode to an empty text. A text decodes to itself, but for the space mark itself,
which the library takes for a space. Very long texts are read whole, as a chunk of their own.
Repeated rows are encoded alike. Words that tie in frequency are taken by their hashes, which
changes no ids. Extra columns are ignored, or kept as they are: where one has the name of a column of
the method, the method's gets underscores after its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brookline.llm import text as T
from brookline.llm.tokens import MARK, Lengths, pretokens, processor

LONGEST, ENTRIES, PER_TASK, WIDEST = 16, 1 << 17, 1 << 15, 48
#: Of a worker's cache: bits of its table, and ids.
SLOTS, CACHED = 18, 1 << 21
BPE, UNIGRAM = "bpe", "unigram"


def piece_table(spark: SparkSession, model: str) -> DataFrame:
    """piece, id, score of a model's ordinary pieces: as many rows as its vocabulary."""
    sp = processor(model)
    rows = [(sp.id_to_piece(i), i, float(sp.get_score(i))) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return spark.createDataFrame(rows, "piece string, id int, score double")


def lattice(words: DataFrame, pieces: DataFrame, longest: int = LONGEST) -> DataFrame:
    """word, edges: an array of (at, size, id, score), at from 1. A word without edges keeps an empty array."""
    n = F.length("word")
    starts = words.select("word").where("word is not null").distinct().withColumn("at", F.explode_outer(F.when(n > 0, F.sequence(F.lit(1), n))))
    spans = starts.withColumn("size", F.explode_outer(F.when(n > 0, F.sequence(F.lit(1), F.least(F.lit(longest), n - F.col("at") + 1)))))
    cut = spans.withColumn("piece", F.expr("substring(word, at, size)"))
    found = cut.join(pieces, "piece", "left")
    edge = F.when(F.col("id").isNotNull(), F.struct("at", "size", "id", "score"))
    return found.groupBy("word").agg(F.array_sort(F.collect_list(edge)).alias("edges"))


def _key(at: Column, size: Column) -> Column:
    return at.cast("long") * 1048576 + size


def fold_merges(word: Column, edges: Column) -> Column:
    """Pieces (at, size) of a word after all merges: one fold over at most length - 1 steps."""
    n = F.length(word)
    scores = F.map_from_entries(F.transform(edges, lambda e: F.struct(_key(e["at"], e["size"]), e["score"])))
    start = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("at"), F.lit(1).alias("size")))

    def merge(acc: Column, _: Column) -> Column:
        def one(s: Column) -> Column:
            pair = lambda k: F.struct(F.try_element_at(m, _key(s[k - 1]["at"], s[k - 1]["size"] + s[k]["size"])).alias("score"), (-k).alias("k"))
            m = acc["m"]
            best = F.array_max(F.transform(F.sequence(F.lit(1), F.size(s) - 1), pair))

            def apply(b: Column) -> Column:
                k = -b["k"]
                joined = F.struct(F.element_at(s, k)["at"].alias("at"), (F.element_at(s, k)["size"] + F.element_at(s, k + 1)["size"]).alias("size"))
                return F.when(b["score"].isNull(), s).otherwise(F.concat(F.slice(s, F.lit(1), k - 1), F.array(joined), F.slice(s, k + 2, F.size(s))))

            return F.element_at(F.transform(F.array(best), apply), 1)

        return F.struct(F.when(F.size(acc["s"]) > 1, one(acc["s"])).otherwise(acc["s"]).alias("s"), acc["m"].alias("m"))

    steps = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(n > 0, F.aggregate(steps, F.struct(start.alias("s"), scores.alias("m")), merge, lambda acc: acc["s"])).otherwise(F.array().cast("array<struct<at:int,size:int>>"))


def fold_viterbi(word: Column, edges: Column, unknown: float = -100.0) -> Column:
    """Pieces (at, size) with the highest sum of scores; of ties, the one with the longest last piece. A character on no edge costs `unknown`."""
    n = F.length(word)
    kind = "array<struct<score:double,from:int>>"
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("from"))).cast(kind)

    def step(best: Column, end: Column) -> Column:
        into = F.filter(edges, lambda e: e["at"] + e["size"] - 1 == end)
        ways = F.transform(into, lambda e: F.struct((F.element_at(best, e["at"])["score"] + e["score"]).alias("score"), (e["at"] - 1).alias("from")))
        single = F.struct((F.element_at(best, end)["score"] + unknown).alias("score"), (end - 1).alias("from"))
        ways = F.concat(ways, F.when(F.exists(into, lambda e: e["size"] == 1), F.array().cast(kind)).otherwise(F.array(single))).cast(kind)
        top = F.array_max(F.transform(ways, lambda w: F.struct(w["score"].alias("score"), (-w["from"]).alias("from"))))
        return F.array_append(best, F.struct(top["score"].alias("score"), (-top["from"]).alias("from"))).cast(kind)

    table = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), start, step)
    pieces = "array<struct<at:int,size:int>>"

    def back(acc: Column, _: Column) -> Column:
        origin = F.element_at(acc["t"], acc["end"] + 1)["from"]
        more = F.struct(origin.alias("end"), F.concat(F.array(F.struct((origin + 1).alias("at"), (acc["end"] - origin).alias("size"))), acc["out"]).cast(pieces).alias("out"), acc["t"].alias("t"))
        return F.when(acc["end"] > 0, more).otherwise(acc)

    done = F.aggregate(F.sequence(F.lit(0), n), F.struct(n.alias("end"), F.array().cast(pieces).alias("out"), table.alias("t")), back, lambda acc: acc["out"])
    return F.when(n > 0, done).otherwise(F.array().cast(pieces))


def encode_words(words: DataFrame, pieces: DataFrame, kind: str = BPE, first_byte: int = 3, longest: int = LONGEST) -> DataFrame:
    """word, ids. Words carry space marks for spaces. A piece on no edge becomes the ids of its bytes, which count from first_byte."""
    fold = fold_merges if kind == BPE else fold_viterbi
    cut = lattice(words, pieces, longest).withColumn("cut", fold(F.col("word"), F.col("edges")))
    ids = F.map_from_entries(F.transform("edges", lambda e: F.struct(_key(e["at"], e["size"]), e["id"])))

    def spelled(p: Column) -> Column:
        code = F.hex(F.encode(F.substring(F.col("word"), p["at"], p["size"]), "UTF-8"))
        return F.transform(F.sequence(F.lit(1), (F.length(code) / 2).cast("int")), lambda i: F.conv(F.substring(code, 2 * i - 1, F.lit(2)), 16, 10).cast("int") + first_byte)

    of = F.element_at(F.transform(F.array(ids), lambda m: F.flatten(F.transform("cut", lambda p: F.when(F.map_contains_key(m, _key(p["at"], p["size"])), F.array(F.try_element_at(m, _key(p["at"], p["size"])))).otherwise(spelled(p))))), 1)
    return cut.select("word", F.coalesce(of, F.array().cast("array<int>")).alias("ids"))


def _segments(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of all elements of the segments [begin, begin + size), one after the other."""
    stop = np.cumsum(size)
    return np.repeat(begin - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)


class _Heavy:
    """Counts of words by hash, with their bytes in one buffer; the rarest go when there are too many."""

    def __init__(self, most: int):
        self.most = most
        self.keys, self.times, self.begin, self.size, self.blob = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def add(self, keys: np.ndarray, times: np.ndarray, begin: np.ndarray, size: np.ndarray, data: np.ndarray) -> None:
        new = np.flatnonzero(~np.isin(keys, self.keys))
        blob = np.concatenate([self.blob, data[_segments(begin[new], size[new])]])
        begin = np.concatenate([self.begin, len(self.blob) + np.cumsum(size[new]) - size[new]])
        every, at, where = np.unique(np.concatenate([self.keys, keys[new], keys]), return_index=True, return_inverse=True)
        counts = np.concatenate([self.times, np.zeros(len(new), np.int64), times])
        self.times = np.bincount(where, weights=counts, minlength=len(every)).astype(np.int64)
        self.keys, self.begin, self.size, self.blob = every, begin[at], np.concatenate([self.size, size[new]])[at], blob
        if len(self.keys) > 4 * self.most:
            self.keep(self.most)

    def keep(self, n: int) -> None:
        best = np.sort(np.lexsort((self.keys, -self.times))[:n])
        self.blob = self.blob[_segments(self.begin[best], self.size[best])]
        self.keys, self.times, self.size = self.keys[best], self.times[best], self.size[best]
        self.begin = np.cumsum(self.size) - self.size

    def words(self) -> pa.Array:
        offsets = np.append(self.begin, len(self.blob)).astype(np.int32)
        return pa.StringArray.from_buffers(len(self.keys), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(self.blob)))


def frequent_words(docs: DataFrame, entries: int = ENTRIES, per_task: int = PER_TASK) -> DataFrame:
    """word, key: the corpus's most frequent words as the lattice takes them (marks for spaces), counted over all documents."""

    def heaviest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = _Heavy(per_task)
        for batch in batches:
            for _, chunk in T.pieces(batch, "text"):
                start, end, h, first = pretokens(chunk)
                lead = np.zeros(len(h), bool)
                lead[first[:-1][np.diff(first) > 0]] = True
                new, at, number = np.unique(h, return_index=True, return_counts=True)
                fit = ~lead[at] & (end[at] - start[at] <= WIDEST)
                new, at, number = new[fit], at[fit], number[fit]
                heavy.add(new, number, start[at], end[at] - start[at], chunk.data)
        heavy.keep(per_task)
        if len(heavy.keys):
            yield pa.RecordBatch.from_arrays([pa.array(heavy.keys.view(np.int64)), heavy.words(), pa.array(heavy.times)], ["key", "word", "times"])
        T.release()

    sent = docs.select("text").mapInArrow(heaviest, "key long, word string, times long")
    top = sent.groupBy("key").agg(F.first("word").alias("word"), F.sum("times").alias("times")).orderBy(F.desc("times"), "key").limit(entries)
    return top.select("key", F.replace("word", F.lit(" "), F.lit(MARK)).alias("word"))


class Tier:
    """Ids of words by hash, sorted; all ids in one array."""

    def __init__(self, keys: np.ndarray, size: np.ndarray, flat: np.ndarray):
        order = np.argsort(keys)
        begin = np.cumsum(size) - size
        self.keys, self.size = keys[order], size[order].astype(np.int32)
        self.flat = flat[_segments(begin[order], size[order])].astype(np.int32)


class Encoder:
    """Ids of chunks: of the broadcast words first, then of what this worker has met. Both are slots of flat arrays of fixed size."""

    def __init__(self, model: str, tier: Tier):
        self.sp, n = processor(model), len(tier.keys)
        self.slot = Lengths(tier.keys, np.arange(n, dtype=np.int32), SLOTS)
        self.own, self.own_ids = n, len(tier.flat)
        self.size, self.flat = np.zeros(n + (1 << SLOTS), np.int32), np.zeros(len(tier.flat) + CACHED, np.int32)
        self.begin = np.zeros(len(self.size), np.int32)
        self.size[:n], self.flat[: len(tier.flat)] = tier.size, tier.flat
        self.begin[:n] = np.cumsum(tier.size) - tier.size
        self.used, self.used_ids = n, len(tier.flat)
        self.alone = len(self.sp.encode("\n"))

    def encode(self, chunk: T.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Offsets by row, and all ids."""
        start, end, h, first = pretokens(chunk)
        if not len(h):
            return np.zeros(chunk.rows + 1, np.int64), np.zeros(0, np.int32)
        uniq, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        slot = self.slot.find(uniq)
        miss = np.flatnonzero(slot < 0)
        known = slot >= 0
        size, begin = np.zeros(len(uniq), np.int64), np.zeros(len(uniq), np.int64)
        size[known], begin[known] = self.size[slot[known]], self.begin[slot[known]]
        data, flat = chunk.data.tobytes(), self.flat
        if len(miss):
            lead = np.isin(at[miss], first[:-1])
            sizes, ids = self._miss([data[s:e] for s, e in zip(start[at[miss]].tolist(), end[at[miss]].tolist())], lead)
            size[miss] = sizes
            if self._remember(uniq[miss], sizes, ids):
                begin[miss] = self.used_ids - len(ids) + np.cumsum(sizes) - sizes
            else:  # more than the cache holds, as a very long text can have
                begin[miss] = len(flat) + np.cumsum(sizes) - sizes
                flat = np.concatenate([flat, ids])
        count = size[inverse]
        out = flat[_segments(begin[inverse], count)]
        offsets = np.concatenate([[0], np.cumsum(count)])[first]
        if b"\xe2\x96\x81" in data:  # texts that have the mark itself go to the library whole
            rows = [out[offsets[r] : offsets[r + 1]] for r in range(chunk.rows)]
            for r in range(chunk.rows):
                if MARK.encode() in (x := data[chunk.offsets[r] : chunk.offsets[r + 1]]):
                    rows[r] = np.array(self.sp.encode(x.decode("utf-8", "replace")), np.int32)
            out, offsets = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        return offsets, out

    def _remember(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bool:
        """Keep ids behind the last; a full cache begins anew if it can hold them. The ids that the caller reads stay where they are until then."""
        if self.used + len(keys) > len(self.size) or self.used_ids + len(ids) > len(self.flat):
            return False
        to = slice(self.used, self.used + len(keys))
        self.size[to], self.begin[to] = sizes, self.used_ids + np.cumsum(sizes) - sizes
        self.flat[self.used_ids : self.used_ids + len(ids)] = ids
        self.slot.add(keys, np.arange(to.start, to.stop, dtype=np.int32))
        self.used, self.used_ids = to.stop, self.used_ids + len(ids)
        return True

    def refresh(self) -> None:
        """Empty a cache that is nearly full, between chunks."""
        if self.used > len(self.size) - (1 << SLOTS) // 4 or self.used_ids > len(self.flat) - CACHED // 4:
            self.used, self.used_ids = self.own, self.own_ids
            self.slot.forget()

    def _miss(self, raw: list[bytes], lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts, drop = [], np.zeros(len(raw), np.int64)
        for k, (x, own) in enumerate(zip(raw, lead.tolist())):
            s = x.decode("utf-8", "replace")
            if own:
                texts.append(s)
            elif s[:1] == " ":
                texts.append(s[1:])
                drop[k] = -1 if len(s) == 1 else 0
            else:
                texts.append("\n" + s)
                drop[k] = self.alone
        space = [self.sp.piece_to_id(MARK)]
        ids = [space if d < 0 else x[d:] for d, x in zip(drop.tolist(), self.sp.encode(texts, num_threads=1))]
        return np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter(chain.from_iterable(ids), np.int32)


def broadcast_words(docs: DataFrame, model: str, entries: int = ENTRIES) -> Tier:
    """The frequent words through the lattice: at most `entries` of WIDEST bytes come to the driver."""
    spark = docs.sparkSession
    tasks = max(8, spark.sparkContext.defaultParallelism)
    words = frequent_words(docs, entries).repartition(tasks, "word").persist()
    try:
        encoded = words.join(encode_words(words, F.broadcast(piece_table(spark, model))), "word").select("key", "ids").toArrow()
    finally:
        words.unpersist()
    ids = encoded["ids"].combine_chunks() if encoded.num_rows else pa.array([], pa.list_(pa.int32()))
    return Tier(encoded["key"].to_numpy().view(np.uint64), ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), ids.flatten().to_numpy(zero_copy_only=False))


def encode_documents(docs: DataFrame, model: str, entries: int = ENTRIES, keep: bool = False, decoded: bool = True) -> DataFrame:
    """doc_id (all columns, if keep), n_tokens, ids, decoded (the text that the ids stand for; left out if so said), exact (it is the text)."""
    spark = docs.sparkSession
    tier = spark.sparkContext.broadcast(broadcast_words(docs, model, entries))
    columns = docs.columns if keep else ["doc_id"]
    own = ["n_tokens", "ids", "decoded", "exact"] if decoded else ["n_tokens", "ids", "exact"]
    made = list(own)
    for k, name in enumerate(made):
        while made[k] in columns:
            made[k] += "_"
    # In the worker the document's columns are fields of one, so that no names can clash.
    source = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model, tier.value)
        for batch in batches:
            for part, chunk in T.pieces(batch, "text"):
                offsets, ids = encoder.encode(chunk)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                again = pa.array(encoder.sp.decode([ids[a:b].tolist() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]), pa.string())
                exact = pc.equal(again, part.column(1).fill_null("").cast(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), lists, *([again] if decoded else []), exact], ["row", *own])
                encoder.refresh()
        T.release()

    kind = source.schema["row"].dataType.simpleString()
    out = source.mapInArrow(scan, f"row {kind}, n_tokens long, ids array<int>, {'decoded string, ' if decoded else ''}exact boolean")
    return out.select(*(F.col("row").getField(c).alias(c) for c in columns), *(F.col(c).alias(name) for c, name in zip(own, made)))
