"""Near-duplicate documents: fast similarity sketching, banding, exact verification.

Sets: the distinct n-word shingles of a text, ASCII letters lower-cased. Documents with equal
sets form a class at once (128 bits of set hash); only classes go on. A sketch has COORDINATES
coordinates filled by fast similarity sketching: in rounds, each element goes to a hashed bin
with a value of that round, bins keep the smallest, and rounds go on until no bin is empty
(after as many rounds as bins, each round fills one bin for certain), so each coordinate agrees
with the probability of the Jaccard similarity and their number concentrates. Bands of WIDTH
coordinates are bucket keys.

Candidates are taken without all pairs of a bucket: first each member with the bucket's
smallest and largest class; what these links join is one component. Then members of a bucket
are left over that have a member of another component there with which the sketches' bits
agree (a filter of more than five standard deviations). No pair of these is listed: what shares buckets is
a group, a group is cut into blocks of bounded size, and two blocks are compared at once on their full
sets, as a product of matrices that counts the shingles of every pair. Every block meets every other of its
group, but for two that lie in one component. No link is accepted on a sketch; at the
threshold a link is missed with a probability of about 6e-11 by banding (0.85) and 1e-7 by the filter.

Texts of candidates only are shuffled; up to a million of their ids go to the scan as a broadcast,
more meet it in a shuffle. Groups of copies collapse before the banding, minima
are combined map-side, and hot buckets are split by adaptive skew joins.

Defined results: a row for every input row. Null and empty texts have no shingles and are
linked with nothing; a text of fewer than n words is one shingle. Rows without an id are
linked with nothing, their component is null and they are kept. Rows that share an id are one
node. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brookline.llm import text as T
from brookline.llm.graph import components as connected
from brookline.llm.shared import Scratch, small

COORDINATES, WIDTH = 128, 4
#: A block has this many shingles, of which each class counts CLASS more; COLUMNS shingles are multiplied at once.
BLOCK, CLASS, COLUMNS = 1 << 20, 512, 2048
U = np.uint64


def shingle_sets(chunk: T.Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of distinct shingles, sorted by both."""
    w = T.words(chunk, lower=True)
    g = T.grams(w, n)
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < n))
    row, h = g.row, g.hash
    if len(short):
        whole = T.span_hash(T.prefix(w.hash), w.first[short], w.first[short + 1])
        row, h = np.concatenate([row, short]), np.concatenate([h, whole])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def sketches(row: np.ndarray, h: np.ndarray, rows: int, t: int = COORDINATES) -> np.ndarray:
    """Rows by t coordinates; rows without elements stay at the largest value."""
    empty = np.iinfo(np.uint64).max
    out = np.full(rows * t, empty, U)
    left = np.zeros(rows, bool)
    left[row] = True
    for i in range(2 * t):
        at = np.flatnonzero(left[row]) if i else slice(None)
        r, x = row[at], h[at]
        if not len(r):
            break
        v = T.mix(x + U((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        where = ((v >> U(48)) * U(t) >> U(16)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, r * t + where, (U(i) << U(48)) | (v & U(0xFFFFFFFFFFFF)))
        open_ = np.unique(r)
        left[open_] = (out.reshape(rows, t)[open_] == empty).any(1)
    return out.reshape(rows, t)


def _describe(n: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, chunk in T.pieces(batch, "text"):
                row, h = shingle_sets(chunk, n)
                size = np.bincount(row, minlength=chunk.rows)
                keys = []
                for salt in (0x1234567, 0x7654321):
                    total = np.zeros(chunk.rows, U)
                    np.add.at(total, row, T.mix(h ^ U(salt)))
                    keys.append(T.mix(total).view(np.int64))
                s = sketches(row, h, chunk.rows)
                low = (T.mix(s) & U(1)).astype(np.uint8)
                bits = np.packbits(low, axis=1).view(np.int64)
                bands = s.reshape(chunk.rows, COORDINATES // WIDTH, WIDTH)
                key = np.broadcast_to(np.arange(COORDINATES // WIDTH, dtype=U), bands.shape[:2]).copy()
                for k in range(WIDTH):
                    key = T.mix(key * U(0x9E3779B97F4A7C15) + bands[:, :, k])
                has = size > 0
                offsets = np.concatenate([[0], np.cumsum(np.where(has, key.shape[1], 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[has].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(size.astype(np.int64)), pa.array(keys[0]), pa.array(keys[1]), pa.array(np.ascontiguousarray(bits[:, 0])), pa.array(np.ascontiguousarray(bits[:, 1])), lists],
                    ["doc_id", "n_shingles", "k1", "k2", "s1", "s2", "bands"],
                )

    return scan


def _confirm(n: int, percent: int):
    """Pairs with their texts to those with 100 * intersection >= percent * union."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            sizes = sum(np.diff(T.buffers(batch.column(k))[1]) for k in (2, 3))
            total = np.cumsum(sizes)
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + T.CHUNK_BYTES)))
                part = batch.slice(at, to - at)
                at = to
                both = []
                for k in (2, 3):
                    data, offsets = T.buffers(part.column(k))
                    both.append(shingle_sets(T.Chunk(0, data, offsets), n))
                rows = part.num_rows
                na, nb = (np.bincount(r, minlength=rows) for r, _ in both)
                row, h = np.concatenate([both[0][0], both[1][0]]), np.concatenate([both[0][1], both[1][1]])
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                same = (row[1:] == row[:-1]) & (h[1:] == h[:-1])
                common = np.bincount(row[1:][same], minlength=rows)
                union = na + nb - common
                linked = pa.array((union > 0) & (100 * common >= percent * union))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(linked), part.column(1).filter(linked)], ["u", "v"])

    return scan


def _sets(n: int):
    """Ids and texts to ids, sizes of sets and sets."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, chunk in T.pieces(batch, "text"):
                row, h = shingle_sets(chunk, n)
                size = np.bincount(row, minlength=chunk.rows)
                ends = np.concatenate([[0], np.cumsum(size)])
                sets = pa.array([h[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size.astype(np.int64)), sets], ["node", "size", "hashes"])

    return scan


def intersections(ra: np.ndarray, ha: np.ndarray, na: int, rb: np.ndarray, hb: np.ndarray, nb: int) -> np.ndarray:
    """How many elements each of na sets shares with each of nb; rows and elements are sorted by row."""
    out = np.zeros((na, nb), np.int32)
    known, first = np.unique(ha, return_index=True)
    both = np.isin(known, hb)
    known, first = known[both], first[both]
    if not len(known):
        return out
    # Elements of the same sets get neighbouring columns, so that rare ones meet few rows.
    place = np.empty(len(known), np.int64)
    place[np.argsort(first)] = np.arange(len(known))
    cells = []
    for r, h in ((ra, ha), (rb, hb)):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        has = known[at] == h
        r, column = r[has], place[at[has]]
        order = np.argsort(column, kind="stable")
        cells.append((r[order], column[order]))
    for low in range(0, len(known), COLUMNS):
        sides = []
        for r, column in cells:
            i, j = np.searchsorted(column, (low, low + COLUMNS))
            rows, at = np.unique(r[i:j], return_inverse=True)
            side = np.zeros((len(rows), COLUMNS), np.float32)
            side[at, column[i:j] - low] = 1
            sides.append((rows, side))
        (rows, a), (columns, b) = sides
        out[np.ix_(rows, columns)] += (a @ b.T).astype(np.int32)
    return out


def joined_nodes(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links between nodes a (rows) and b (columns), each node with the smallest one that it reaches: as many links as nodes."""
    rows, columns = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    linked, a, b = linked[np.ix_(rows, columns)], a[rows], b[columns]
    if not len(a):
        return a, b
    top = np.iinfo(np.int64).max
    la, lb = a.copy(), b.copy()
    while True:
        was = la, lb
        la = np.array([min(x, lb[link].min(initial=top)) for x, link in zip(la, linked)])
        lb = np.array([min(x, la[link].min(initial=top)) for x, link in zip(lb, linked.T)])
        # A node may be on both sides.
        node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        low = np.full(len(node), top)
        np.minimum.at(low, at, np.concatenate([la, lb]))
        la, lb = low[at[: len(a)]], low[at[len(a) :]]
        if (la == was[0]).all() and (lb == was[1]).all():
            return node[low < node], low[low < node]


def _compare(percent: int):
    """Two blocks (of side 0 and 1; or one with itself) to links between different components."""

    def compare(table: pa.Table) -> pa.Table:
        sides = []
        for side in (0, 1):
            part = table.filter(pc.equal(table["side"], side))
            node, component, size = (part[c].to_numpy() for c in ("node", "component", "size"))
            h = np.frombuffer(b"".join(part["hashes"].to_pylist()), U)
            sides.append((node, component, size, np.repeat(np.arange(len(size)), size), h))
        if not len(sides[1][0]):
            sides[1] = sides[0]
        (a, ca, na, ra, ha), (b, cb, nb, rb, hb) = sides
        common = intersections(ra, ha, len(a), rb, hb, len(b))
        linked = np.empty(common.shape, bool)
        for i in range(0, len(a), 256):
            some = slice(i, i + 256)
            linked[some] = (common[some] > 0) & (common[some].astype(np.int64) * (100 + percent) >= percent * (na[some, None] + nb[None, :])) & (ca[some, None] != cb[None, :])
        u, v = joined_nodes(linked, a, b)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    def run(table: pa.Table) -> pa.Table:
        try:
            return compare(table)
        finally:
            T.release()

    return run


class _Links:
    """Confirmation of candidate pairs (u, v), with texts of the classes in them."""

    def __init__(self, docs: DataFrame, n: int, percent: int, scratch: Scratch):
        self.docs, self.n, self.percent, self.scratch = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()), n, percent, scratch

    def confirm(self, pairs: DataFrame, name: str) -> DataFrame:
        """A written table of the links among the pairs."""
        ids = self.scratch.keep(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), f"{name}-ids")
        texts = self.scratch.keep(self.docs.join(small(ids), "doc_id", "left_semi").dropDuplicates(["doc_id"]), f"{name}-texts")
        one = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("a"))
        two = texts.select(F.col("doc_id").alias("v"), F.col("text").alias("b"))
        joined = pairs.join(one, "u").join(two, "v").select("u", "v", "a", "b")
        kept = self.scratch.keep(joined.mapInArrow(T.task(_confirm(self.n, self.percent)), "u long, v long"), name)
        self.scratch.drop(texts)
        return kept

    def across(self, rows: DataFrame, components: DataFrame) -> DataFrame:
        """A written table of links that join what the links between different components join, among the members of each bucket (band, rep)."""
        low = rows.groupBy("band").agg(F.min("rep").alias("v"))
        edges = rows.join(low, "band").select(F.col("rep").alias("u"), "v").where("u <> v").distinct()
        groups = self.scratch.keep(connected(edges, self.scratch).withColumnRenamed("component", "set_group"), "groups")
        texts = self.docs.join(small(groups.select(F.col("node").alias("doc_id"))), "doc_id", "left_semi").dropDuplicates(["doc_id"])
        sets = self.scratch.keep(texts.mapInArrow(T.task(_sets(self.n)), "node long, size long, hashes binary"), "sets")
        weight = F.col("size") + CLASS
        before = F.sum(weight).over(Window.partitionBy("set_group").orderBy("component", "node")) - weight
        placed = groups.join(sets.select("node", "size"), "node").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
        placed = self.scratch.keep(placed.select("node", "set_group", "component", F.floor(before / BLOCK).cast("long").alias("block")), "placed")
        blocks = placed.groupBy("set_group", "block").agg(F.min("component").alias("c0"), F.max("component").alias("c1"))
        x, y = blocks.alias("x"), blocks.alias("y")
        one = "x.c0 = x.c1 and y.c0 = y.c1 and x.c0 = y.c0"
        pairs = x.join(y, F.expr(f"x.set_group = y.set_group and x.block <= y.block and not ({one})"))
        pairs = self.scratch.keep(pairs.select("x.set_group", F.col("x.block").alias("a"), F.col("y.block").alias("b")), "pairs")
        members = placed.join(sets, "node")
        left = members.join(pairs.withColumn("block", F.col("a")), ["set_group", "block"]).withColumn("side", F.lit(0))
        right = members.join(pairs.where("a < b").withColumn("block", F.col("b")), ["set_group", "block"]).withColumn("side", F.lit(1))
        both = left.unionByName(right).select("set_group", "a", "b", "side", "node", "component", "size", "hashes")
        kept = self.scratch.keep(both.groupBy("set_group", "a", "b").applyInArrow(_compare(self.percent), "u long, v long"), "across")
        self.scratch.drop(groups, sets, placed, pairs)
        return kept


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links of percent / 100 or more), kept (it is that one)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    described = scratch.keep(docs.select("doc_id", "text").mapInArrow(T.task(_describe(n)), "doc_id long, n_shingles long, k1 long, k2 long, s1 long, s2 long, bands array<long>"), "described")
    full = described.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.keep(full.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("s1").alias("s1"), F.first("s2").alias("s2"), F.first("bands").alias("bands")), "classes")

    members = classes.select(F.explode("bands").alias("band"), "rep", "s1", "s2")
    ends = members.groupBy("band").agg(F.min(F.struct("rep", "s1", "s2")).alias("low"), F.max(F.struct("rep", "s1", "s2")).alias("high")).where("low.rep <> high.rep")
    shared = scratch.keep(members.join(ends, "band"), "buckets")

    differ = 64 * (1 - percent / 100) + 5.2 * (128 * (0.5 + percent / 200) * (0.5 - percent / 200)) ** 0.5
    agree = "bit_count({a}.s1 ^ {b}.s1) + bit_count({a}.s2 ^ {b}.s2) <= " + str(int(np.ceil(differ)))
    stars = shared.select(F.struct("rep", "s1", "s2").alias("x"), F.explode(F.array("low", "high")).alias("y")).where("x.rep <> y.rep").where(agree.format(a="x", b="y"))
    stars = stars.select(F.least("x.rep", "y.rep").alias("u"), F.greatest("x.rep", "y.rep").alias("v")).distinct()
    links = _Links(docs, n, percent, scratch)
    tried = scratch.keep(stars, "stars")
    found = links.confirm(tried, "links")
    joined = connected(found, scratch)

    # Members of one bucket that are in different components still have to be compared, but for its ends, which all were compared with.
    end = F.struct("rep", "s1", "s2").isin(F.col("low"), F.col("high"))
    part = shared.where(~end).select("band", "rep", "s1", "s2").join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    split = part.groupBy("band").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("band")
    part = scratch.keep(part.join(split, "band", "left_semi"), "split")
    other = "x.band = y.band and x.component <> y.component and " + agree.format(a="x", b="y")
    rest = scratch.keep(part.alias("x").join(part.alias("y"), F.expr(other), "left_semi").select("band", "rep"), "rest")
    scratch.drop(shared, part, tried)
    more = links.across(rest, joined)
    scratch.drop(rest)
    if more.limit(1).count():
        joined = connected(found.unionByName(more), scratch)

    of_class = classes.select("k1", "k2", "rep").join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    out = described.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("k1")).alias("k1"), "k2").join(of_class, ["k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with all their columns: of each group of near-duplicates the one with the smallest id (of rows that repeat an id, one)."""
    found = near_duplicates(docs, n, percent)
    gone = Scratch(docs.sparkSession).keep(found.where("not kept").select("doc_id").distinct(), "gone")
    stay = docs.join(small(gone), "doc_id", "left_anti").select(docs.columns)
    if docs.select("doc_id").where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        named = stay.where("doc_id is not null").dropDuplicates(["doc_id"])
        return named.unionByName(stay.where("doc_id is null"))
    return stay
