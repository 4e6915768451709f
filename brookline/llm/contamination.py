"""Benchmark decontamination by greedy string tiling.

Seeds are runs of `seed` words (ASCII letters lower-cased) that a document shares with a
benchmark item. For each pair with enough of them, greedy string tiling marks the longest common run
of at least `seed` words among words not yet marked, and again, until none is left; runs are
found by running Karp-Rabin hashes. The share of the item's words that are marked is its coverage. Tiles
may lie in any order, so a reordered passage covers as much as one in order. A document is
contaminated if it covers an item to `threshold` or more.

The seeds are joined in Spark:

1. seeds of the items make a table, and a bitmap of at most MOST_BITS bits that goes to the workers;
2. one scan of the documents sends seeds that the bitmap has, with two hashes of the text (equal
   texts are judged once); they meet the table in a join, a broadcast if it is small;
3. a tile of n words has n - seed + 1 seeds, so an item of which a document has s seeds is covered in
   at most seed * s words. Pairs that can't come to the threshold by that bound go no further;
4. texts of the others meet their items and are tiled. What is found, a narrow row for each
   text, joins back on the hashes.

Nothing of the documents or the items is collected, and the benchmark may have any size.

Defined results: one row for every input row, an empty table for an empty one. Null and empty texts,
items of fewer than `seed` words, items without an id and an empty benchmark give coverage 0, as does
a text that can't come to the threshold for any item. Of items that tie, the smallest item_id is reported.
Repeated rows and rows without an id are judged by their texts; very long texts are read whole. Extra
columns are ignored, or kept by decontaminate(), whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookline.llm import text as T
from brookline.llm.shared import Scratch, small

SEED, THRESHOLD = 5, 0.5
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27
#: Pairs of seeds that are listed at once when two texts are compared.
LISTED = 1 << 20


def _starts(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, hash_a: np.ndarray, at_b: np.ndarray, hash_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where maximal common runs begin: pairs of equal seeds whose words before differ. Equal ones are never listed for a seed that occurs often, so repetitive texts cost what they have of runs."""
    before = lambda x, at: np.where(at > 0, x[at - 1], 0)
    some = np.flatnonzero(np.isin(hash_b, hash_a))
    order_a, order_b = np.argsort(hash_a, kind="stable"), some[np.argsort(hash_b[some], kind="stable")]
    shared = np.unique(hash_b[some])
    low_a, high_a = (np.searchsorted(hash_a[order_a], shared, side) for side in ("left", "right"))
    low_b, high_b = (np.searchsorted(hash_b[order_b], shared, side) for side in ("left", "right"))
    product = (high_a - low_a) * (high_b - low_b)
    out_i, out_j = [], []

    def add(i: np.ndarray, j: np.ndarray) -> None:
        new = (i == 0) | (j == 0) | (before(a, i) != before(b, j))
        out_i.append(i[new])
        out_j.append(j[new])

    few = np.flatnonzero(product <= 64)
    for at in range(0, len(few), LISTED // 64):
        g = few[at : at + LISTED // 64]
        n = product[g]
        group = np.repeat(np.arange(len(g)), n)
        k = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
        width = (high_b - low_b)[g][group]
        add(at_a[order_a[low_a[g][group] + k // width]], at_b[order_b[low_b[g][group] + k % width]])
    for g in np.flatnonzero(product > 64).tolist():
        i, j = at_a[order_a[low_a[g] : high_a[g]]], at_b[order_b[low_b[g] : high_b[g]]]
        if j[0] == 0:
            add(i, np.zeros(len(i), np.int64))
        words = before(b, j)
        for word in np.unique(before(a, i)).tolist():
            own, other = i[(before(a, i) == word) & (i > 0)], j[(words != np.uint64(word)) & (j > 0)]
            for k in range(0, len(own), max(1, LISTED // max(len(other), 1))):
                part = own[k : k + max(1, LISTED // max(len(other), 1))]
                add(np.repeat(part, len(other)), np.tile(other, len(part)))
        if i[0] == 0:
            add(np.zeros(int((j > 0).sum()), np.int64), j[j > 0])
    none = np.zeros(0, np.int64)
    return np.concatenate(out_i or [none]), np.concatenate(out_j or [none])


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word hashes: (start in item, start in doc, length), the longest first; of equal ones the first in the item, then in the document."""
    if min(len(item), len(doc)) < least:
        return []
    sum_a, sum_b = T.prefix(item), T.prefix(doc)
    at_a, at_b = np.arange(len(item) - least + 1), np.arange(len(doc) - least + 1)
    i, j = _starts(item, doc, at_a, T.span_hash(sum_a, at_a, at_a + least), at_b, T.span_hash(sum_b, at_b, at_b + least))
    low, high = np.full(len(i), least), np.minimum(len(item) - i, len(doc) - j)
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_] + 1) // 2
        same = T.span_hash(sum_a, i[open_], i[open_] + mid) == T.span_hash(sum_b, j[open_], j[open_] + mid)
        low[open_], high[open_] = np.where(same, mid, low[open_]), np.where(same, high[open_], mid - 1)
    # What a marked tile leaves of another maximal run is all that can still match there.
    heap = list(zip((-low).tolist(), i.tolist(), j.tolist()))
    heapq.heapify(heap)
    free_a, free_b, left, out = np.ones(len(item), bool), np.ones(len(doc), bool), len(item), []
    while heap and left >= least:
        n, x, y = heapq.heappop(heap)
        n = -n
        free = free_a[x : x + n] & free_b[y : y + n]
        if free.all():
            free_a[x : x + n] = free_b[y : y + n] = False
            out.append((x, y, n))
            left -= n
            continue
        edge = np.diff(np.concatenate([[0], free.astype(np.int8), [0]]))
        for p, q in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            if q - p >= least:
                heapq.heappush(heap, (p - q, x + p, y + p))
    return out


def _items(benchmark: DataFrame, seed: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Items (item_id, item, which is a digest of the text, item_text), and their seeds (item, seed, times, n_words)."""
    known = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    items = scratch.keep(known.select("item_id", F.md5("text").alias("item"), F.col("text").alias("item_text")).distinct(), "items")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, chunk in T.pieces(batch, "item_text"):
                w = T.words(chunk, lower=True)
                g = T.grams(w, seed)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(g.row)), pa.array(g.hash.view(np.int64)), pa.array(np.diff(w.first)[g.row])], ["item", "seed", "n_words"])

    seeds = items.select("item", "item_text").dropDuplicates(["item"]).mapInArrow(T.task(scan), "item string, seed long, n_words long")
    return items, scratch.keep(seeds.groupBy("item", "seed").agg(F.count("*").alias("times"), F.max("n_words").alias("n_words")), "item-seeds")


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """Bits of the seeds' low parts: at least 128 for a seed while MOST_BITS allow it; beyond, more seeds of documents meet the join than have to."""
    n = seeds.count()
    bits = min(max(1 << max(128 * n - 1, 1).bit_length(), LEAST_BITS), MOST_BITS)
    place = F.expr(f"shiftright(seed & {bits - 1}L, 6)")
    got = seeds.groupBy(place.alias("place")).agg(F.expr("bit_or(shiftleft(1L, cast(seed & 63L as int)))").alias("word")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[got["place"].to_numpy()] = got["word"].to_numpy()
    return out.view(np.uint64)


def covered(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, threshold: float = THRESHOLD, scratch: Scratch | None = None) -> DataFrame:
    """h1, h2 (of a text), coverage, item_id, item_ids, for texts that cover an item to the threshold by the bound on their seeds."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    items, seeds = _items(benchmark, seed, scratch)
    sent = spark.sparkContext.broadcast(_bitmap(seeds))
    texts = docs.where(F.length("text") > 0).select(*_keys(), "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, mask = sent.value, np.uint64(len(sent.value) * 64 - 1)
        for batch in batches:
            for part, chunk in T.pieces(batch, "text"):
                g = T.grams(T.words(chunk, lower=True), seed)
                place = g.hash & mask
                hit = np.flatnonzero((bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1))
                row, h = g.row[hit], g.hash[hit]
                _, one = np.unique(np.stack([row.astype(np.uint64), h], axis=1), axis=0, return_index=True)
                rows = pa.array(row[one])
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(h[one].view(np.int64))], ["h1", "h2", "seed"])

    shared = texts.mapInArrow(T.task(scan), "h1 long, h2 long, seed long").distinct().join(small(seeds), "seed")
    enough = F.sum("times") * seed >= F.max("n_words") * F.lit(threshold)
    pairs = scratch.keep(shared.groupBy("h1", "h2", "item").agg(enough.alias("enough")).where("enough").select("h1", "h2", "item"), "pairs")
    wanted = scratch.keep(pairs.select("h1", "h2").distinct(), "wanted")
    own = texts.join(small(wanted), ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])
    both = own.join(pairs, ["h1", "h2"]).join(items.select("item", "item_text").dropDuplicates(["item"]), "item")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (T.words(next(iter(T.chunks(batch.column(c).slice(k, 1)))), lower=True).hash for c in (3, 4))
                share = sum(n for _, _, n in tiles(b, a, seed)) / len(b)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in range(3)), pa.array([share])], ["h1", "h2", "item", "coverage"])

    found = scratch.keep(both.select("h1", "h2", "item", "text", "item_text").mapInArrow(T.task(tile), "h1 long, h2 long, item string, coverage double"), "coverage")
    by = found.join(items.select("item", "item_id"), "item")
    best = F.max_by(F.struct("coverage", "item_id"), F.struct("coverage", -F.col("item_id"))).alias("best")
    over = F.array_sort(F.collect_set(F.when(F.col("coverage") >= threshold, F.col("item_id")))).alias("item_ids")
    return scratch.keep(by.groupBy("h1", "h2").agg(best, over).select("h1", "h2", "best.coverage", "best.item_id", "item_ids"), "texts")


def _keys() -> list:
    return [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("again"), F.col("text")).alias("h2")]


def contamination(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, coverage (best item's), item_id (null at coverage 0), item_ids (all at the threshold or above, ascending), contaminated."""
    found = covered(docs, benchmark, seed, threshold)
    out = docs.select("doc_id", *_keys()).join(small(found), ["h1", "h2"], "left")
    some = F.coalesce(F.col("coverage") > 0, F.lit(False))
    ids = F.coalesce("item_ids", F.array().cast("array<bigint>"))
    return out.select("doc_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.when(some, F.col("item_id")).alias("item_id"), ids.alias("item_ids"), (F.size(ids) > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that aren't contaminated; a document whose id is null stays or goes by its own text."""
    gone = covered(docs, benchmark, seed, threshold).where(F.size("item_ids") > 0).select("h1", "h2")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *_keys())
    return rows.join(small(Scratch(docs.sparkSession).keep(gone, "gone")), ["h1", "h2"], "left_anti").select("row.*")
