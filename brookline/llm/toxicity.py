"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

A text is judged by its units: a word, a run of single letters joined ("i d i o t"), or two
neighbouring short words ("id iot"), which counts where neither word passes the second level by itself. The kernel of
two units sums, over the subsequences of three and four letters that both hold, the product
of their weights: a subsequence that spans s characters weighs DECAY**s, so gaps and inserted
characters cost something and don't hide an insult ("id-iot", "idxiot"). Spans are limited
(SPAN). Characters that are no letters are gaps; digits count as the letters they look like, and
all bytes of other scripts as four letters. Each unit's weights are divided by their norm.

Fit, from a bounded sample of labelled documents (`per_class` of each class): document
frequencies of tokens in each class are counted on the cluster, over one document of each set
of copies (those that share the smallest hash of their word triples), since words that came
along in copies tell nothing. Tokens that are frequent in label 1 (LEAST of its documents) and
rare in label 0 are the positive landmarks; tokens of label-0 documents, first any, then those
that the machine so far takes for insults, are the negative ones. (The labels are of whole documents. A further
round over their sentences, each standing for itself by its highest unit, did worse on held-out labels; README has the figures.)

Each time a squared-hinge SVM is trained on the examples' Nystroem features. The decision
is linear in the subsequences' weights, so the landmarks fold into one table of fixed size
(32**3 + 32**4 floats) and a unit costs a sum of look-ups. A logistic curve on a document's
two highest decisions and on how many units pass three levels, fitted on the same sample,
gives the score.

Whole texts are read; a token longer than WIDE is cut into overlapping windows. Defined
results: a row for every input row; null and empty texts get the score of a text with no
token; without examples of both labels, or tokens that tell them apart, every score is 0.018, so
that nothing is rejected; an empty table gives one. Tokens that tie are taken in their own order. Repeated
rows score equally; extra columns are ignored, or kept by drop_toxic(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookline.llm import text as T
from brookline.llm.shared import labelled

PER_CLASS, CANDIDATES, CLEAN_TOKENS, CLEAN_LANDMARKS = 1500, 160, 1500, 64
LEAST, ODDS, MINING, LEVELS = 0.008, 8.0, 1, (0.0, 0.4, 0.7)
#: Bytes that either of two joined words has at most.
SHORT = 5
DECAY, SPAN, WIDE, STEP = 0.6, {3: 6, 4: 8}, 32, 20
CACHE_BITS = 19

CODE = np.zeros(256, np.int32)
CODE[97:123] = np.arange(1, 27)
CODE[65:91] = np.arange(1, 27)
for digit, letter in zip("0134578", "oieastb", strict=True):
    CODE[ord(digit)] = ord(letter) - 96
CODE[0x80:] = 27 + np.arange(128) % 4
CODE[ord("^")] = 31  # stands before each token
OFFSETS = [(0, *rest) for n, span in SPAN.items() for rest in combinations(range(1, span), n - 1)]
TABLE = 32**3 + 32**4


def _cells(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each shape of subsequence: the table cells at all starts, which of them exist, and the weight."""
    n, wide = codes.shape
    padded = np.zeros((n, wide + max(SPAN.values())), np.int32)
    padded[:, :wide] = codes
    for shape in OFFSETS:
        cell = padded[:, :wide].copy()
        real = cell > 0
        for at in shape[1:]:
            c = padded[:, at : at + wide]
            cell = cell * 32 + c
            real &= c > 0
        if len(shape) == 4:
            cell += 32**3
        yield cell, real, DECAY ** (shape[-1] + 1)


def _codes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of tokens, a row for each window, and the token of each row."""
    rows, owner = [], []
    for k, x in enumerate(raw):
        x = b"^" + x
        for at in range(0, max(len(x) - (WIDE - STEP), 1), STEP):
            rows.append(x[at : at + WIDE])
            owner.append(k)
    wide = max(map(len, rows), default=1)
    flat = np.frombuffer(b"".join(r.ljust(wide, b"\0") for r in rows), np.uint8).reshape(len(rows), wide)
    return CODE[flat], np.array(owner, np.int64)


def _whole_norms() -> np.ndarray:
    """Squared norm of a token of n letters without gaps, by n."""
    out = np.zeros(WIDE + 1)
    for shape in OFFSETS:
        out += np.maximum(np.arange(WIDE + 1) - shape[-1], 0) * DECAY ** (2 * (shape[-1] + 1))
    return out


NORMS = _whole_norms()


def decisions(raw: list[bytes], table: np.ndarray, bias: float) -> np.ndarray:
    """The SVM's decision for each token: its highest over the windows of a long one."""
    out = np.full(len(raw), bias, np.float32)
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    three, four = table[: 32**3], table[32**3 :]
    for low, high in ((0, 5), (5, 8), (8, 11), (11, 16), (16, 1 << 60)):
        some = np.flatnonzero((size > low) & (size <= high))
        for at in range(0, len(some), 8_192):
            part = some[at : at + 8_192]
            codes, owner = _codes([raw[i] for i in part.tolist()])
            n, wide = codes.shape
            padded = np.zeros((wide + max(SPAN.values()), n), np.int32)
            padded[:wide] = codes.T
            by = [padded, padded * 32, padded * 1024, padded * 32768]
            total = np.zeros(n, np.float32)
            for shape in OFFSETS:  # a cell with a gap in it is no subsequence and holds 0
                starts = wide - shape[-1]
                if starts <= 0:
                    continue
                k = len(shape) - 1
                cell = by[k][:starts] + by[0][shape[-1] : shape[-1] + starts]
                for i, offset in enumerate(shape[1:-1], 1):
                    cell += by[k - i][offset : offset + starts]
                total += np.float32(DECAY ** (shape[-1] + 1)) * np.take(three if k == 2 else four, cell).sum(0)
            letters = codes > 0
            count = letters.sum(1)
            last = wide - np.argmax(letters[:, ::-1], axis=1)
            norm = NORMS[np.minimum(count, WIDE)]
            odd = np.flatnonzero((count > 0) & (count != last))  # gaps inside or before
            if len(odd):
                norm[odd] = 0
                for _, real, weight in _cells(codes[odd]):
                    norm[odd] += weight * weight * real.sum(1)
            value = total / np.sqrt(np.maximum(norm, 1e-12)) + bias
            best = np.full(len(part), -np.inf)
            np.maximum.at(best, owner, value)
            out[part] = best
    return out


def _vectors(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse, normalised subsequence weights: token, cell, value."""
    codes, owner = _codes([x[: WIDE - 1] for x in raw])
    rows, cells, values = [], [], []
    norm = np.zeros(len(raw))
    for cell, real, weight in _cells(codes):
        r, c = np.nonzero(real)
        rows.append(owner[r])
        cells.append(cell[r, c])
        values.append(np.full(len(r), weight))
        norm += np.bincount(owner[r], minlength=len(raw)) * weight * weight
    row, cell, value = (np.concatenate(x) for x in (rows, cells, values))
    return row, cell, value / np.sqrt(np.maximum(norm, 1e-12))[row]


def _kernel(a: list[bytes], b: list[bytes]) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    row, cell, value = _vectors(a)
    mine = [np.flatnonzero(row == i) for i in range(len(a))] if len(a) <= 512 else None
    if mine is None:
        return _kernel(b, a).T
    other_row, other_cell, other_value = _vectors(b)
    dense = np.zeros(TABLE, np.float64)
    for i, idx in enumerate(mine):
        np.add.at(dense, cell[idx], value[idx])
        out[i] = np.bincount(other_row, weights=other_value * dense[other_cell], minlength=len(b))
        dense[cell[idx]] = 0
    return out


def train(toxic: list[bytes], clean: list[bytes], landmarks: int = CLEAN_LANDMARKS, c: float = 2.0) -> tuple[np.ndarray, float]:
    """The folded table and the bias of a squared-hinge SVM on Nystroem features of tokens."""
    marks = toxic + clean[:landmarks]
    every = toxic + clean
    y = np.array([1.0] * len(toxic) + [-1.0] * len(clean))
    weight = np.where(y > 0, len(clean) / max(len(toxic), 1), 1.0) * c
    values, vectors = np.linalg.eigh(_kernel(marks, marks))
    keep = values > 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])
    x = np.hstack([_kernel(marks, every).T @ root, np.ones((len(every), 1))])
    w, ridge = np.zeros(x.shape[1]), np.append(np.ones(x.shape[1] - 1), 1e-3)
    for _ in range(30):  # Newton's method on the rows inside the margin
        inside = y * (x @ w) < 1
        xi = x[inside] * weight[inside, None]
        new = np.linalg.solve(xi.T @ x[inside] + np.diag(ridge), xi.T @ y[inside])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    alpha = root @ w[:-1]
    row, cell, value = _vectors(marks)
    table = np.zeros(TABLE, np.float64)
    np.add.at(table, cell, value * alpha[row])
    return table.astype(np.float32), float(w[-1])


class Tokens:
    """Decisions of a chunk's units, with a cache by hash: a table of fixed size where a later unit takes the place of an earlier one."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias
        self.keys, self.values = np.zeros(1 << CACHE_BITS, np.uint64), np.full(1 << CACHE_BITS, np.nan, np.float32)

    def _decide(self, h: np.ndarray, cut: Callable[[int], bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The decision of each hash, cut(k) being the bytes behind the k-th; and which hashes are the same."""
        uniq, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        slot = (uniq & np.uint64((1 << CACHE_BITS) - 1)).astype(np.int64)
        f = np.where(self.keys[slot] == uniq, self.values[slot], np.float32(np.nan))
        new = np.flatnonzero(np.isnan(f))
        if len(new):
            f[new] = decisions([cut(k) for k in at[new].tolist()], self.table, self.bias)
            self.keys[slot[new]], self.values[slot[new]] = uniq[new], f[new]
        return f[inverse], inverse

    def units(self, chunk: T.Chunk, w: T.Words, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Decisions of all words, and which are the same; first words of joined neighbours, and their decisions."""
        start, end, row = w.start, w.end, w.rows
        value, same = self._decide(w.hash, lambda k: data[start[k] : end[k]])
        short = end - start <= SHORT
        at = np.flatnonzero(short[:-1] & short[1:] & (row[:-1] == row[1:]))
        at = at[np.maximum(value[at], value[at + 1]) <= LEVELS[1]]
        joined = T.mix(T.mix(w.hash[at] + np.uint64(0x632BE59BD9B4E019)) ^ w.hash[at + 1])
        pair, _ = self._decide(joined, lambda k: data[start[at[k]] : end[at[k]]] + b" " + data[start[at[k] + 1] : end[at[k] + 1]])
        return value, same, at, pair

    def top(self, chunk: T.Chunk) -> np.ndarray:
        """Of each row: the two highest decisions (the bias where there are fewer units), and logs of how many units pass each level."""
        out = np.zeros((chunk.rows, 2 + len(LEVELS)), np.float32)
        out[:, :2] = min(self.bias, -1.0)
        w = T.words(chunk, lower=True)
        if not len(w.hash):
            return out
        data = chunk.data.tobytes()
        value, same, at, pair = self.units(chunk, w, data)
        row = w.rows
        out[:, 0] = np.maximum(out[:, 0], _highest(value, w.first))
        other = np.where(same == same[_where_highest(value, row, w.first)][row], -np.inf, value)
        out[:, 1] = np.maximum(out[:, 1], _highest(other, w.first))
        if len(at):
            best = _highest(pair, np.searchsorted(row[at], np.arange(chunk.rows + 1)))
            out[:, :2] = -np.sort(-np.stack([out[:, 0], out[:, 1], best], axis=1), axis=1)[:, :2]
        for k, level in enumerate(LEVELS, 2):
            out[:, k] = np.bincount(row, weights=value > level, minlength=chunk.rows) + np.bincount(row[at], weights=pair > level, minlength=chunk.rows)
        for r, joined in _spelled(chunk, w, data):
            s = decisions([joined], self.table, self.bias)[0]
            out[r, :2] = sorted([s, *out[r, :2]], reverse=True)[:2]
            out[r, 2:] += [s > level for level in LEVELS]
        out[:, 2:] = np.log1p(out[:, 2:])
        return out


def _highest(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.full(len(first) - 1, -np.inf, np.float32)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = np.maximum.reduceat(value, first[some])
    return out


def _where_highest(value: np.ndarray, row: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Index of the first word with the row's highest value; 0 for a row without words."""
    at = np.flatnonzero(value == _highest(value, first)[row])
    out = np.zeros(len(first) - 1, np.int64)
    out[row[at][::-1]] = at[::-1]
    return out


def _spelled(chunk: T.Chunk, w: T.Words, data: bytes) -> Iterator[tuple[int, bytes]]:
    """Runs of four or more single letters in one row, joined."""
    single = (w.end - w.start == 1) & (CODE[chunk.data[w.start]] > 0)
    if single.sum() < 4:
        return
    row = w.rows
    edge = np.diff(np.concatenate([[0], single.astype(np.int8), [0]]))
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        while a < b:
            to = min(b, int(w.first[row[a] + 1]))
            if to - a >= 4:
                yield int(row[a]), b"".join(data[s : s + 1] for s in w.start[a:to].tolist())
            a = to


class Model:
    def __init__(self, table: np.ndarray, bias: float, curve: np.ndarray):
        self.table, self.bias, self.curve = table, bias, curve

    def score(self, top: np.ndarray) -> np.ndarray:
        z = np.clip(top.astype(np.float64), -3, 3) @ self.curve[:-1] + self.curve[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.hstack([np.clip(x.astype(np.float64), -3, 3), np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the fit: each document's distinct lower-cased tokens of at most WIDE bytes, and what its copies share."""
    for batch in batches:
        for part, chunk in T.pieces(batch, "text"):
            w = T.words(chunk, lower=True)
            _, at = np.unique(T.mix(w.hash + w.rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
            at = at[w.end[at] - w.start[at] <= WIDE]
            row, data = w.rows[at], chunk.data.tobytes()
            lists: list[list[bytes]] = [[] for _ in range(chunk.rows)]
            for r, s, e in zip(row.tolist(), w.start[at].tolist(), w.end[at].tolist()):
                lists[r].append(data[s:e].lower())
            g = T.grams(w, 3)
            smallest = np.full(chunk.rows, np.iinfo(np.uint64).max, np.uint64)
            np.minimum.at(smallest, g.row, g.hash)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(smallest.view(np.int64)), pa.array(lists, pa.list_(pa.binary()))], ["doc_id", "text", "label", "copy", "tokens"])


def fit(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, per_class: int = PER_CLASS) -> Model:
    """Everything the driver gets is bounded by the parameters: candidates, clean tokens, and two floats of each document in the sample."""
    spark = docs.sparkSession
    sample = labelled(docs, labels, label, allowed, per_class).select("doc_id", "text", "label").mapInArrow(T.task(_tokens), "doc_id long, text string, label int, copy long, tokens array<binary>").persist()
    held = [sample]
    try:
        single = sample.groupBy("copy", "label").agg(F.min_by("tokens", "doc_id").alias("tokens")).persist()
        held.append(single)
        count = {r["label"]: r["n"] for r in single.groupBy("label").agg(F.count("*").alias("n")).collect()}
        positive, negative = count.get(1, 0), count.get(0, 0)
        flat = Model(np.zeros(TABLE, np.float32), -1.0, np.array([0.0, 0.0, 0.0, 0.0, 0.0, -4.0]))
        if not positive or not negative:
            return flat
        by = single.select("label", F.explode("tokens").alias("token")).groupBy("token").agg(F.sum("label").cast("long").alias("p"), F.sum(1 - F.col("label")).cast("long").alias("q")).persist()
        held.append(by)
        odds = ((F.col("p") + 0.5) / (positive + 1)) / ((F.col("q") + 0.5) / (negative + 1))
        strong = by.where((F.col("p") >= max(3, LEAST * positive)) & (odds > ODDS)).orderBy(F.desc(odds * F.sqrt("p")), "token").limit(CANDIDATES)
        insults = [bytes(r["token"]) for r in strong.collect()]
        innocent = by.where((F.col("p") * 2 * negative < F.col("q") * positive))
        clean = [bytes(r["token"]) for r in innocent.orderBy(F.xxhash64("token"), "token").limit(CLEAN_TOKENS).collect()]
        if not insults or not clean:
            return flat
        table, bias = train(insults, clean)
        for _ in range(MINING):
            near = spark.sparkContext.broadcast((table, bias))

            def judge(batches: Iterator[pa.RecordBatch], near=near) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    f = decisions(batch.column(0).to_pylist(), *near.value)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f)], ["token", "f"])

            hard = [bytes(r["token"]) for r in innocent.select("token").mapInArrow(T.task(judge), "token binary, f float").orderBy(F.desc("f"), "token").limit(CLEAN_TOKENS).collect()]
            clean = hard[:CLEAN_LANDMARKS // 2] + clean[: CLEAN_LANDMARKS // 2] + hard[CLEAN_LANDMARKS // 2 :] + clean[CLEAN_LANDMARKS // 2 :]
            clean = list(dict.fromkeys(clean))[: 3 * CLEAN_TOKENS]
            table, bias = train(insults, clean)
        sent = spark.sparkContext.broadcast((table, bias))

        def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokens = Tokens(*sent.value)
            for batch in batches:
                for part, chunk in T.pieces(batch, "text"):
                    t = tokens.top(chunk)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(t[:, k]) for k in range(5))], ["doc_id", "label", *"abcde"])

        got = sample.select("doc_id", "text", "label").mapInArrow(T.task(tops), "doc_id long, label int, a float, b float, c float, d float, e float").toArrow().sort_by([("doc_id", "ascending")])
        x = np.stack([got[k].to_numpy() for k in "abcde"], axis=1)
        return Model(table, bias, _logistic(x, got["label"].to_numpy()))
    finally:
        for df in held:
            df.unpersist()


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(sent.value.table, sent.value.bias)
        for batch in batches:
            for part, chunk in T.pieces(batch, "text"):
                s = sent.value.score(tokens.top(chunk))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(T.task(scan), "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents, with all their columns, that score below the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(sent.value.table, sent.value.bias)
        for batch in batches:
            for part, chunk in T.pieces(batch, "text"):
                yield part.filter(pa.array(sent.value.score(tokens.top(chunk)) < threshold))

    return docs.mapInArrow(T.task(scan), docs.schema)
