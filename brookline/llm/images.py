"""Copies of images by local descriptors, cropped or edited ones too.

Corners are found at several scales of the grey image (Harris response, local maxima). Each has
an orientation, the direction of its patch's centroid of intensity, and BITS binary tests of
smoothed brightness on a fixed pattern turned by that orientation. All local maxima count, so
corners are in proportion to a picture's area and a crop keeps its share of them.

One corner of a plain texture looks like many others, so a key is made of two: drawn bits of a corner
and of a neighbour at the same scale, with its distance, direction and orientation as seen
from the first, in steps. There are two Hamming tables of such keys (TABLES): next neighbours, and
neighbours whose patches hardly overlap. Pictures that share KEYS keys or more are candidates, by an
equi-join on the keys, and a candidate is confirmed by geometric consensus: mutual nearest
descriptors within MATCH bits vote for similarity transforms (one match fixes one: scales,
orientations and places), and the best must carry INLIERS matches. README has the measured recall.

Pairs of a bucket are never listed all: pictures with equal pixels form a class at once; each
class then meets that first or last picture of its buckets with which it shares most of them. Only classes that
these links leave in different components meet each other, a pair of components by its likeliest pair first, and all
their pairs where none links. Buckets are combined map-side. Only keys are stored for all pictures; candidates are
described again, and their features go once to each pair of blocks that needs them, a slice of the pairs at a time.

Images are bytes of PNG (8 bits a channel, not interlaced), PGM, PPM (binary) or 24-bit BMP; others, JPEG
among them, are not readable, and a column says so. Defined results: a row for every input row, an
empty table for an empty one. Null, empty or unreadable bytes, and pictures without corners, have n_corners 0
and are linked with nothing but equal pixels (unreadable: with nothing). Rows without an id have a
null class_id. Rows that repeat an id are one node. Very large pictures are described whole. Extra columns are
ignored. Of pairs that tie the one with the smallest ids is tried first, which changes no class.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookline.llm import text as T
from brookline.llm.graph import components as connected
from brookline.llm.shared import Scratch, small

SCALES, STACK = tuple(2 ** (-k / 4) for k in range(5)), 16
BITS, RADIUS, TURNS = 256, 10, 32
MATCH, INLIERS, NEAR, KEYS = 40, 14, 2.0, 2
#: Of each table: bits of either corner, neighbours of a corner, and how far away they are at least and at most.
TABLES, STEPS, FARTHEST = ((24, 1, 3.0), (19, 2, 16.0)), 6, 60.0
#: Bytes of features that a block of pictures has on average; pairs are confirmed by pairs of blocks.
BLOCK = 2 << 20
_r = np.random.Generator(np.random.PCG64(7))
PATTERN = np.clip(_r.normal(0, RADIUS / 2, (BITS, 4)), -RADIUS, RADIUS)
#: The bits that keys draw from: tests of distant places, which small changes of brightness seldom turn.
STEADY = np.argsort(-np.hypot(PATTERN[:, 0] - PATTERN[:, 2], PATTERN[:, 1] - PATTERN[:, 3]), kind="stable")[:110]
DRAWN = [[np.random.Generator(np.random.PCG64(100 + 2 * k + side)).permutation(STEADY)[:part] for side in (0, 1)] for k, (part, _, _) in enumerate(TABLES)]
_t = np.arange(TURNS)[:, None] * (2 * np.pi / TURNS)
#: The pattern at each orientation, as whole offsets (ay, ax, by, bx).
TURNED = np.rint(np.stack([v for k in (0, 2) for v in (np.sin(_t) * PATTERN[:, k] + np.cos(_t) * PATTERN[:, k + 1], np.cos(_t) * PATTERN[:, k] - np.sin(_t) * PATTERN[:, k + 1])], axis=2)).astype(int)
DISC = np.array([(y, x) for y in range(-7, 8) for x in range(-7, 8) if x * x + y * y <= 49])


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey values as float32, or None for bytes that are no picture of these formats."""
    if not data:
        return None
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
        if data[:2] in (b"P5", b"P6"):
            return _pnm(data)
        if data[:2] == b"BM":
            return _bmp(data)
    except (ValueError, IndexError, struct.error, zlib.error):
        pass
    return None


def _grey(a: np.ndarray) -> np.ndarray:
    a = a.astype(np.float32)
    return a[..., 0] if a.shape[2] < 3 else a[..., :3] @ np.array([0.299, 0.587, 0.114], np.float32)


def _pnm(data: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    w, h, top = fields
    if top > 255:
        raise ValueError("more than 8 bits")
    c = 1 if data[:2] == b"P5" else 3
    return _grey(np.frombuffer(data, np.uint8, w * h * c, at + 1).reshape(h, w, c))


def _bmp(data: bytes) -> np.ndarray:
    start, _, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if bits != 24 or packed or w <= 0:
        raise ValueError("only plain 24-bit bitmaps")
    line = (3 * w + 3) // 4 * 4
    a = np.frombuffer(data, np.uint8, line * abs(h), start).reshape(abs(h), line)[:, : 3 * w].reshape(abs(h), w, 3)[..., ::-1]
    return _grey(a[::-1] if h > 0 else a)


def _png(data: bytes) -> np.ndarray:
    at, packed, head = 8, [], None
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + n
    w, h, depth, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour, 0)
    if depth != 8 or interlaced or not channels:
        raise ValueError("this kind of PNG isn't read")
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, 1 + w * channels)
    kinds, lines = raw[:, 0], raw[:, 1:].reshape(h, w, channels).astype(np.int16)
    out = np.zeros((h + 1, w + 1, channels), np.int16)
    for t in range(w + h - 1):  # a pixel needs those to its left, above, and between: diagonals are independent
        y = np.arange(max(0, t - w + 1), min(h, t + 1))
        x = t - y
        left, above, corner, kind = out[y + 1, x], out[y, x + 1], out[y, x], kinds[y][:, None]
        to_left, to_above, to_corner = np.abs(above - corner), np.abs(left - corner), np.abs(left + above - 2 * corner)
        nearest = np.where((to_left <= to_above) & (to_left <= to_corner), left, np.where(to_above <= to_corner, above, corner))
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, above, (left + above) >> 1, nearest], 0)
        out[y + 1, x + 1] = (lines[y, x] + guess) & 255
    return _grey(out[1:, 1:])


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of side 2 r + 1 in the last two axes, edges repeated."""
    h, w = a.shape[-2:]
    edge = [(0, 0)] * (a.ndim - 2) + [(r + 1, r)] * 2
    p = np.pad(a, edge, mode="edge").cumsum(-2).cumsum(-1)
    k = 2 * r + 1
    return (p[..., k : k + h, k : k + w] - p[..., :h, k : k + w] - p[..., k : k + h, :w] + p[..., :h, :w]) / (k * k)


def _highest(a: np.ndarray, r: int = 2) -> np.ndarray:
    """The largest value in each square of side 2 r + 1."""
    for axis in (-2, -1):
        n = a.shape[axis]
        edge = [(0, 0)] * a.ndim
        edge[axis] = (r, r)
        p = np.pad(a, edge, constant_values=-np.inf)
        a = np.max([np.take(p, range(i, i + n), axis=axis) for i in range(2 * r + 1)], axis=0)
    return a


def _resized(a: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1:
        return a
    height, width = a.shape[-2:]
    h, w = max(1, round(height * scale)), max(1, round(width * scale))
    y, x = (np.arange(h) + 0.5) / scale - 0.5, (np.arange(w) + 0.5) / scale - 0.5
    y0, x0 = np.clip(np.floor(y).astype(int), 0, height - 1), np.clip(np.floor(x).astype(int), 0, width - 1)
    y1, x1 = np.minimum(y0 + 1, height - 1), np.minimum(x0 + 1, width - 1)
    fy, fx = np.clip(y - y0, 0, 1)[:, None], np.clip(x - x0, 0, 1)[None]
    top = a[..., y0, :][..., x0] * (1 - fx) + a[..., y0, :][..., x1] * fx
    low = a[..., y1, :][..., x0] * (1 - fx) + a[..., y1, :][..., x1] * fx
    return top * (1 - fy) + low * fy


def describe_all(images: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For a stack of pictures of one size: corners (x, y in the whole picture, scale, orientation), strongest first, and their bits packed."""
    found: list[tuple[np.ndarray, ...]] = []
    for scale in SCALES:
        a = _resized(images.astype(np.float32), scale).astype(np.float64)
        if min(a.shape[1:]) < 16:
            continue
        gy, gx = np.gradient(a, axis=(1, 2))
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        response = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        least = np.maximum(0.01 * response.max((1, 2)), 1e-6)[:, None, None]
        n, y, x = np.nonzero((response == _highest(response)) & (response > least))
        order = np.lexsort((x, y, -response[n, y, x], n))
        n, y, x = n[order], y[order], x[order]
        if not len(n):
            continue
        smooth = np.pad(_box(a, 1), [(0, 0), (16, 16), (16, 16)], mode="reflect" if min(a.shape[1:]) > 16 else "edge")
        patch = smooth[n[:, None], y[:, None] + DISC[:, 0] + 16, x[:, None] + DISC[:, 1] + 16]
        angle = np.arctan2((patch * DISC[:, 0]).sum(1), (patch * DISC[:, 1]).sum(1))
        turn = np.round(angle / (2 * np.pi) * TURNS).astype(int) % TURNS
        at = TURNED[turn]  # corner, test, (ay, ax, by, bx)
        value = lambda k: smooth[n[:, None], np.clip(y[:, None] + at[:, :, k] + 16, 0, smooth.shape[1] - 1), np.clip(x[:, None] + at[:, :, k + 1] + 16, 0, smooth.shape[2] - 1)]
        bits = np.packbits(value(0) < value(2), axis=1)
        spots = np.stack([(x + 0.5) / scale - 0.5, (y + 0.5) / scale - 0.5, np.full(len(x), scale), angle], axis=1)
        found.append((n, spots, bits, response[n, y, x]))
    if not found:
        return [(np.zeros((0, 4)), np.zeros((0, BITS // 8), np.uint8))] * len(images)
    n, spots, bits, strength = (np.concatenate(v) for v in zip(*found))
    order = np.lexsort((np.arange(len(n)), -strength, n))
    cut = np.searchsorted(n[order], np.arange(len(images) + 1))
    return [(spots[order[i:j]], bits[order[i:j]]) for i, j in zip(cut[:-1], cut[1:])]


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return describe_all(image[None])[0]


def _neighbours(z: np.ndarray, n: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each place with its n nearest at `least` or farther (and within FARTHEST): first, second, distance."""
    out = []
    for at in range(0, len(z), 1024):
        d = np.abs(z[at : at + 1024, None] - z[None])
        d[d < least] = np.inf
        near = np.argsort(d, axis=1, kind="stable")[:, :n] if len(z) < 256 else np.argpartition(d, min(n, len(z) - 1), axis=1)[:, :n]
        far = np.take_along_axis(d, near, 1)
        k = np.broadcast_to(np.arange(at, at + len(d))[:, None], near.shape)
        keep = far < FARTHEST
        out.append((k[keep], near[keep], far[keep]))
    return tuple(np.concatenate(x) for x in zip(*out))


def table_keys(spots: np.ndarray, bits: np.ndarray) -> list[int]:
    """The distinct keys of a picture's pairs of corners, of all tables."""
    if not len(bits):
        return []
    tests, out = np.unpackbits(bits, axis=1).astype(np.uint64), []
    for scale in np.unique(spots[:, 2]):
        own = np.flatnonzero(spots[:, 2] == scale)
        z, angle = (spots[own, 0] + 1j * spots[own, 1]) * scale, spots[own, 3]
        step = lambda a: np.floor(a / (2 * np.pi) * STEPS % STEPS).astype(np.uint64)
        for k, (part, n, least) in enumerate(TABLES):
            a, b, far = _neighbours(z, n, least)
            power = np.uint64(1) << np.arange(part, dtype=np.uint64)
            first, second = (tests[own[i]][:, drawn] @ power for i, drawn in ((a, DRAWN[k][0]), (b, DRAWN[k][1])))
            seen = (step(np.angle(z[b] - z[a]) - angle[a]) * np.uint64(STEPS) + step(angle[b] - angle[a])) * np.uint64(32) + np.floor(2 * np.log2(far)).astype(np.uint64)
            out.append(T.mix(T.mix(first * np.uint64(len(TABLES)) + np.uint64(k)) ^ (second * np.uint64(0x9E3779B97F4A7C15)) ^ T.mix(seen)))
    return np.unique(np.concatenate(out)).view(np.int64).tolist()


def consensus(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """How many matches the best similarity transform carries; the search ends at one that carries INLIERS."""
    (sa, ba), (sb, bb) = a, b
    if len(sa) < INLIERS or len(sb) < INLIERS:
        return 0
    ua, ub = (np.unpackbits(x, axis=1).astype(np.float32) * 2 - 1 for x in (ba, bb))
    to, least = np.zeros(len(sa), int), np.zeros(len(sa))
    back, lowest = np.zeros(len(sb), int), np.full(len(sb), np.inf)
    for at in range(0, len(sa), 1024):  # large pictures have thousands of corners
        apart = (BITS - ua[at : at + 1024] @ ub.T) / 2
        to[at : at + 1024], least[at : at + 1024] = apart.argmin(1), apart.min(1)
        low = apart.min(0)
        back, lowest = np.where(low < lowest, at + apart.argmin(0), back), np.minimum(low, lowest)
    i = np.flatnonzero((back[to] == np.arange(len(sa))) & (least <= MATCH))
    if len(i) < INLIERS:
        return 0
    j = to[i]
    za, zb = sa[i, 0] + 1j * sa[i, 1], sb[j, 0] + 1j * sb[j, 1]
    factor = (sa[i, 2] / sb[j, 2]) * np.exp(1j * (sb[j, 3] - sa[i, 3]))
    best = 0

    def carried(f: np.ndarray, k: np.ndarray) -> int:
        return int((np.abs(f[:, None] * za + (zb[k] - f * za[k])[:, None] - zb) < NEAR).sum(1).max())

    for at in range(0, len(i), 512):
        best = max(best, carried(factor[at : at + 512], np.arange(at, min(at + 512, len(i)))))
        if best >= INLIERS:
            return best
    for p in range(len(i)):  # two matches fix a transform more exactly than one
        gap = za[p] - za
        q = np.flatnonzero(np.abs(gap) > 8)
        f = (zb[p] - zb[q]) / gap[q]
        f = f[np.abs(np.abs(f) * (sb[j[p], 2] / sa[i[p], 2]) - 1) < 0.5]
        for at in range(0, len(f), 512):
            best = max(best, carried(f[at : at + 512], np.full(len(f[at : at + 512]), p)))
        if best >= INLIERS:
            return best
    return best


def _described(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of (id, bytes) with what each picture is: pixels, spots, bits; None if it can't be read."""
    for first in range(0, batch.num_rows, STACK):
        part = batch.slice(first, STACK)
        pictures = [decode(x.as_py()) for x in part.column(1)]
        rows: list = [None] * len(pictures)
        sizes: dict[tuple, list[int]] = {}
        for k, image in enumerate(pictures):
            if image is not None and image.size:
                sizes.setdefault(image.shape, []).append(k)
        for shape, own in sizes.items():
            most = max(1, (STACK * 4096) // (shape[0] * shape[1]))  # large pictures by themselves
            for at in range(0, len(own), most):
                some = own[at : at + most]
                for k, (spots, bits) in zip(some, describe_all(np.stack([pictures[k] for k in some]))):
                    rows[k] = (pictures[k], spots, bits)
        yield part, rows


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, rows in _described(batch):
            out: list[tuple] = [(None, None, 0, [])] * len(rows)
            for k, row in enumerate(rows):
                if row is not None:
                    pixels = np.rint(row[0]).astype(np.uint8).ravel()
                    h = T.span_hash(T.prefix(T.BYTE_CODE[pixels]), np.array([0]), np.array([pixels.size])).view(np.int64)
                    out[k] = (int(h[0]), zlib.crc32(repr(row[0].shape).encode()), len(row[1]), table_keys(row[1], row[2]))
            h, shape, n, keys = zip(*out)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(h, pa.int64()), pa.array(shape, pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["image_id", "pixels", "shape", "n_corners", "keys"])
    T.release()


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, rows in _described(batch):
            spots, bits = ([None if r is None else r[k].astype(kind).tobytes() for r in rows] for k, kind in ((1, np.float32), (2, np.uint8)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spots, pa.binary()), pa.array(bits, pa.binary())], ["image_id", "spots", "bits"])
    T.release()


def _confirm(pairs: pa.Table, features: pa.Table) -> pa.Table:
    spots, bits = (features.column(k).to_pylist() for k in ("spots", "bits"))
    own = {i: (np.frombuffer(s, np.float32).reshape(-1, 4).astype(np.float64), np.frombuffer(b, np.uint8).reshape(-1, BITS // 8)) for i, s, b in zip(features.column("image_id").to_pylist(), spots, bits)}
    pairs = pairs.select(["u", "v"])
    return pairs.filter(pa.array([consensus(own[u], own[v]) >= INLIERS for u, v in zip(*(c.to_pylist() for c in pairs.columns))], pa.bool_()))


class _Links:
    """Confirmation of candidate pairs (u, v). seen: the ids of every picture."""

    def __init__(self, images: DataFrame, seen: DataFrame, scratch: Scratch):
        repeated = seen.where("image_id is not null").groupBy("image_id").count().where("count > 1").limit(1).count()
        self.images, self.scratch, self.repeated = images, scratch, bool(repeated)

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """A written table of the links among the pairs, which are a written table too."""
        scratch = self.scratch
        ids = scratch.keep(pairs.select(F.explode(F.array("u", "v")).alias("image_id")).distinct(), "ids")
        asked = self.images.join(small(ids), "image_id", "left_semi")
        own = scratch.keep((asked.dropDuplicates(["image_id"]) if self.repeated else asked).select("image_id", "image").mapInArrow(_again, "image_id long, spots binary, bits binary"), "described")
        scratch.sweep()
        held = own.agg(F.sum(F.octet_length("spots") + F.octet_length("bits")).alias("weight"), F.count("*").alias("n")).first()
        blocks = max((held["weight"] or 0) // BLOCK + 1, 8)
        # Each slice of the pairs sends about as much as the pictures hold, and is gone before the next.
        slices = -(-2 * pairs.count() // max(held["n"], 1)) or 1
        part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
        placed = pairs.select("u", "v", part("u", blocks).alias("bu"), part("v", blocks).alias("bv"), F.pmod(F.xxhash64(F.lit("slice"), F.col("u")), F.lit(slices)).alias("slice"))
        out = []
        for k in range(slices):
            now = placed.where(F.col("slice") == k)
            needed = now.select(F.col("bu").alias("nu"), F.col("bv").alias("nv"), F.explode(F.array("u", "v")).alias("image_id")).distinct().join(own, "image_id")
            out.append(scratch.keep(now.groupBy("bu", "bv").cogroup(needed.groupBy("nu", "nv")).applyInArrow(_confirm, "u long, v long"), "links"))
            scratch.sweep()
        scratch.drop(ids, own)
        links = out[0]
        for more in out[1:]:
            links = links.unionByName(more)
        return links


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))


def candidates(members: DataFrame, scratch: Scratch) -> DataFrame:
    """u, v, n: of members of buckets (rep, key, component) those in different components that share n keys, KEYS or more."""
    split = members.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key")
    part = members.join(split, "key", "left_semi")
    x, y = part.alias("x"), part.alias("y")
    both = x.join(y, F.expr("x.key = y.key and x.rep < y.rep and x.component <> y.component"))
    return scratch.keep(both.groupBy(F.col("x.rep").alias("u"), F.col("y.rep").alias("v")).agg(F.count("*").alias("n")).where(F.col("n") >= KEYS), "candidates")


def image_copies(images: DataFrame, image: str = "image") -> DataFrame:
    """image_id, n_corners, class_id (smallest id reachable over confirmed links and equal pixels), kept (it is that one), readable."""
    scratch = Scratch(images.sparkSession)
    pictures = images.select("image_id", F.col(image).alias("image"))
    seen = scratch.keep(pictures.mapInArrow(_features, "image_id long, pixels long, shape long, n_corners long, keys array<long>"), "features")
    classes = scratch.keep(seen.where("image_id is not null and pixels is not null").groupBy("pixels", "shape").agg(F.min("image_id").alias("rep")), "classes")
    reps = scratch.keep(classes.select(F.col("rep").alias("image_id")).distinct(), "reps")
    links = _Links(pictures.where("image_id is not null"), seen.select("image_id"), scratch)
    members = seen.join(small(reps), "image_id", "left_semi").select(F.col("image_id").alias("rep"), F.explode("keys").alias("key"))

    # Most keys belong to one picture only, and go no further.
    ends = members.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high")
    shared = scratch.keep(members.join(ends, "key").select("rep", "key", "low", "high"), "buckets")
    keyed, seen = seen, scratch.keep(seen.drop("keys"), "pictures")
    scratch.drop(keyed)
    scratch.sweep()
    stars = shared.select("rep", F.explode(F.array("low", "high")).alias("end")).where("rep <> end").groupBy("rep", "end").agg(F.count("*").alias("n")).where(F.col("n") >= KEYS)
    stars = stars.groupBy("rep").agg(F.max_by("end", F.struct("n", -F.col("end"))).alias("end"))
    tried = scratch.keep(_ordered(stars, "rep", "end").distinct(), "stars")
    scratch.sweep()
    found = links.confirm(tried)
    joined = connected(found, scratch)

    placed = shared.join(small(joined.withColumnRenamed("node", "rep")), "rep", "left").select("rep", "key", F.coalesce("component", "rep").alias("component"))
    left = candidates(placed, scratch)
    scratch.drop(shared)
    scratch.sweep()
    while True:
        of = {c: joined.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "uv"}
        apart = left.join(tried, ["u", "v"], "left_anti").join(of["u"], "u", "left").join(of["v"], "v", "left").withColumns({"cu": F.coalesce("cu", "u"), "cv": F.coalesce("cv", "v")}).where("cu <> cv")
        apart = scratch.keep(apart.select("u", "v", "n", F.least("cu", "cv").alias("cu"), F.greatest("cu", "cv").alias("cv")), "apart")
        likely = scratch.keep(apart.groupBy("cu", "cv").agg(F.max_by(F.struct("u", "v"), F.struct("n", -F.col("u"), -F.col("v"))).alias("p")).select("p.*"), "likely")
        more = links.confirm(likely)
        last = not more.limit(1).count()
        if last:  # no two components have become one: now all that is left
            more = links.confirm(scratch.keep(apart.select("u", "v").join(likely, ["u", "v"], "left_anti"), "rest"))
        if more.limit(1).count():
            found = scratch.keep(found.unionByName(more), "found")
            joined = connected(found, scratch)
        if last:
            break
        tried = scratch.keep(tried.unionByName(likely), "tried")
    of = classes.select("pixels", "shape", "rep").join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("pixels", "shape", F.coalesce("component", "rep").alias("component"))
    out = seen.select("image_id", "n_corners", "pixels", "shape").join(of, ["pixels", "shape"], "left")
    class_id = F.when(F.col("image_id").isNotNull(), F.coalesce("component", "image_id"))
    return out.select("image_id", "n_corners", class_id.alias("class_id"), F.coalesce(F.col("image_id") == class_id, F.lit(True)).alias("kept"), F.col("pixels").isNotNull().alias("readable"))


def rasters(vectors: DataFrame, cell: int = 8) -> DataFrame:
    """image_id, image: each embedding drawn as a square of grey cells (PGM), smoothed; the tables have no pictures, and near-equal vectors make edited copies of one."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                x = np.array([0.0 if e is None else e for e in v or ()], np.float64)
                side = int(np.sqrt(len(x)))
                if side < 2 or not np.isfinite(x).all():
                    out.append(None)
                    continue
                x = x[: side * side].reshape(side, side)
                grey = np.clip(128 + 48 * (x - x.mean()) / max(x.std(), 1e-12), 0, 255)
                a = np.rint(_box(np.kron(grey, np.ones((cell, cell))), 1)).astype(np.uint8)
                out.append(b"P5 %d %d 255\n" % a.shape[::-1] + a.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["image_id", "image"])

    return vectors.select("vec_id", "embedding").mapInArrow(draw, "image_id long, image binary")
