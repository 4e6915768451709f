"""URL filters: block and allow rules, and gradient-boosted trees on lexical features; DataFrame functions only.

A rule is (verdict, host, path). It fits its host and all subdomains if the path of the URL
starts with the rule's; of those that fit, the longest wins. Rules are a stated list, turned into
one column expression.

The trees judge what no rule fits. They learn from URLs that a rule fits, labelled by its
verdict (1: block), so none of the URLs they judge is an example; a bounded sample of each label is
chosen by a hash of the URL, and both labels weigh the same in all. A score above 0.5 says that a
URL looks more like what rules block than like what they allow. Features are lexical and know no
label: lengths, depth, digit ratio, entropy, counts of parameters and of parts of the host, and
statistics of the host's suffix (its last label, and its last two): how many URLs of the whole table
have it, as a logarithm, for every suffix. The STATISTICS most frequent are part of the column expression; a table
has the others and is joined, to rows only whose suffix isn't among those, so no frequent suffix is a hot key. Boosting is histogram-based: each
level of each tree is one aggregation of gradients by node, feature and bin, whose result
has a fixed size, over a sample that lies in one partition and so isn't shuffled. Trees become CASE
expressions, which whole-stage code generation compiles.

Defined results: a row for every input row, an empty table for an empty one; a null URL or one without
"://" has an empty host and path, fits no rule and is judged by its features like any other; very long
URLs are read whole. Repeated rows get equal verdicts. Splits that tie go to the first feature by name and
the lowest edge. Without both labels in the sample, everything that no rule blocks is allowed. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookline.llm.shared import Scratch, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
SAMPLE, TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 20_000, 10, 2, 16, 0.4, 1.0, 5
STATISTICS, BROADCAST, SALTS = 256, 1 << 17, 1024
SUFFIXES = ("suffix", "site")
NUMERIC = ("length", "host_length", "path_length", "depth", "digits", "entropy", "parameters", "labels", "hyphens", "longest")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*+(/[^?#]*+)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """A struct (verdict, rule) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    whole = F.coalesce(url, F.lit(""))
    n = F.length(whole)
    query = F.regexp_extract(whole, r"\?([^#]*)", 1)
    chars = F.array_distinct(F.split(whole, ""))
    share = lambda c: (n - F.length(F.replace(whole, c, F.lit("")))) / n
    entropy = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    values = {
        "length": n,
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": F.size(F.filter(F.split(path, "/"), lambda s: s != "")),
        "digits": F.length(F.regexp_replace(whole, "[^0-9]", "")) / F.greatest(n, F.lit(1)),
        "entropy": F.when(n > 0, entropy).otherwise(0.0),
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "[&;]"))),
        "labels": F.when(host == "", 0).otherwise(F.size(F.split(host, r"\."))),
        "hyphens": F.length(F.regexp_replace(host, "[^-]", "")),
        "longest": F.coalesce(F.array_max(F.transform(F.split(host, r"\."), lambda s: F.length(s))), F.lit(0)),
    }
    return {k: v.cast("double") for k, v in values.items()} | suffixes(host)


def suffixes(host: Column) -> dict[str, Column]:
    """The last label of a host, and the last two."""
    return {"suffix": F.substring_index(host, ".", -1), "site": F.substring_index(host, ".", -2)}


class Tree(NamedTuple):
    """levels[level][node] = (feature, number of the edge, edge): left if below the edge; leaves by node at the last level. Nodes of a level count from 0."""

    levels: list[dict[int, tuple[str, int, float]]]
    leaves: dict[int, float]

    def column(self, below: Callable[[str, int, float], Column], node: int = 0, level: int = 0) -> Column:
        """The leaf's value; below says how a feature is compared with an edge."""
        if level == len(self.levels):
            return F.lit(self.leaves.get(node, 0.0))
        if node not in self.levels[level]:
            return self.column(below, 2 * node, level + 1)
        left, right = (self.column(below, 2 * node + k, level + 1) for k in (0, 1))
        return F.when(below(*self.levels[level][node]), left).otherwise(right)

    def node(self, below: Callable[[str, int, float], Column], node: int = 0, level: int = 0) -> Column:
        """The node that a row has come to, at the level below the last."""
        if level == len(self.levels):
            return F.lit(node)
        if node not in self.levels[level]:
            return self.node(below, 2 * node, level + 1)
        left, right = (self.node(below, 2 * node + k, level + 1) for k in (0, 1))
        return F.when(below(*self.levels[level][node]), left).otherwise(right)


def _of_value(name: str, _: int, edge: float) -> Column:
    return F.col(name) < edge


def _of_bin(name: str, k: int, _: float) -> Column:
    return F.col(name) <= k


class Model(NamedTuple):
    """statistics has the most frequent suffixes, rest a written table (suffix, salt, value) of all others where there are any."""

    trees: list[Tree]
    statistics: dict[str, dict[str, float]]
    bias: float = 0.0
    rest: dict[str, DataFrame] | None = None

    def prepared(self, df: DataFrame) -> DataFrame:
        """With the statistics of each host's suffixes. Rows whose suffix the expression knows get a salt that the table hasn't, and are spread by it."""
        for k in SUFFIXES:
            value, key = self._statistic(k), [f"{k}_key", f"{k}_salt"]
            if k in (self.rest or {}):
                salt = F.when(value.isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int"))
                others = small(self.rest[k], BROADCAST).toDF(*key, f"{k}_rest")
                df = df.withColumns({key[0]: F.when(value.isNull(), F.col(k)), key[1]: salt}).join(others, key, "left")
                value = F.coalesce(value, f"{k}_rest")
            df = df.withColumn(f"{k}_count", F.coalesce(value, F.lit(0.0)))
        return df

    def _statistic(self, name: str) -> Column:
        """Null for a suffix that isn't among the most frequent."""
        known = self.statistics[name]
        if not known:
            return F.lit(None).cast("double")
        table = F.create_map(*(F.lit(x) for kv in sorted(known.items()) for x in kv))
        return F.try_element_at(table, F.col(name))

    def raw(self, below: Callable[[str, int, float], Column] = _of_value) -> Column:
        return sum((t.column(below) for t in self.trees), F.lit(self.bias))


def suffix_statistics(hosts: DataFrame, scratch: Scratch) -> tuple[dict[str, dict[str, float]], dict[str, DataFrame]]:
    """Logarithms of how many rows of the whole table have a suffix: for the most frequent ones, and a written table of all others."""
    out, rest = {}, {}
    for name, of in suffixes(F.col("host")).items():
        counts = hosts.groupBy(of.alias("s")).agg(F.count("*").alias("n")).select("s", "n", F.lit(0).alias("salt"), F.log(F.col("n").cast("double")).alias("value"))
        counts = scratch.keep(counts, name)
        top = counts.orderBy(F.desc("n"), "s").limit(STATISTICS + 1).collect()
        out[name] = {r["s"]: r["value"] for r in top[:STATISTICS]}
        if len(top) > STATISTICS:
            rest[name] = scratch.keep(counts.where(~F.col("s").isin(list(out[name]))).select("s", "salt", "value"), f"{name}-rest")
        scratch.drop(counts)
    return out, rest


def fit(urls: DataFrame, scratch: Scratch, sample: int = SAMPLE) -> Model:
    """urls: url, host, path, label (0 or 1; null: not labelled). The driver gets histograms and statistics of bounded size."""
    halves = [urls.where(F.col("label") == k).select("url", "host", "path", "label").orderBy(F.xxhash64("url"), "url").limit(sample // 2) for k in (0, 1)]
    rows = scratch.keep(halves[0].unionByName(halves[1]), "sample")
    count = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(count) < 2:
        return Model([], {k: {} for k in SUFFIXES}, -1.0)
    statistics, rest = suffix_statistics(urls.where("url is not null"), scratch)
    model = Model([], statistics, rest=rest)
    names = [*NUMERIC, *(f"{k}_count" for k in SUFFIXES)]
    ready = model.prepared(rows.coalesce(1).withColumns(features(F.col("url"), F.col("host"), F.col("path")))).select(*names, "label")
    ready = scratch.keep(ready, "features").coalesce(1)
    cuts = ready.agg(*(F.percentile_approx(c, [i / BINS for i in range(1, BINS)], 1000).alias(c) for c in names)).first()
    edges = {c: sorted(set(cuts[c])) for c in names}
    weight = F.when(F.col("label") == 1, (count[0] + count[1]) / (2 * count[1])).otherwise((count[0] + count[1]) / (2 * count[0]))
    binned = ready.select(*(_bin(c, edges[c]).cast("tinyint").alias(c) for c in names), "label", weight.alias("w")).persist()
    try:
        for _ in range(TREES):
            model.trees.append(grow(binned, model.raw(_of_bin), names, edges))
    finally:
        binned.unpersist()
    scratch.drop(rows, ready)
    return model


def grow(binned: DataFrame, raw: Column, names: list[str], edges: dict[str, list[float]]) -> Tree:
    """One tree on the gradients of the logistic loss; a histogram for each level."""
    tree, p = Tree([], {}), 1 / (1 + F.exp(-raw))
    now = binned.select(*names, (F.col("w") * (p - F.col("label"))).alias("g"), (F.col("w") * p * (1 - p)).alias("h"))
    each = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("bin")) for c in names))
    for level in range(DEPTH):
        cells = now.select(tree.node(_of_bin).alias("node"), "g", "h", F.explode(each).alias("f")).groupBy("node", "f.feature", "f.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n")).collect()
        splits, sums = _splits(cells, edges)
        if level == DEPTH - 1:
            for node, halves in sums.items():
                for k, (g, h) in enumerate(halves):
                    tree.leaves[2 * node + k] = -RATE * g / (h + RIDGE)
        tree.levels.append(splits)
    return tree


def _bin(name: str, edges: list[float]) -> Column:
    """How many edges are at or below the value."""
    return sum(((F.col(name) >= e).cast("int") for e in edges), F.lit(0))


def _splits(cells: list, edges: dict[str, list[float]]) -> tuple[dict[int, tuple[str, int, float]], dict[int, list[tuple[float, float]]]]:
    """The best split of each node by gain (of ties the first feature and the lowest edge), and the sums of each node's two halves; a node that isn't split is all left."""
    best: dict[int, tuple[float, str, int, float]] = {}
    sums: dict[int, list[tuple[float, float]]] = {}
    by: dict[tuple[int, str], dict[int, tuple[float, float, int]]] = {}
    for r in cells:
        by.setdefault((r["node"], r["feature"]), {})[r["bin"]] = (r["g"], r["h"], r["n"])
    for (node, name), bins in sorted(by.items()):
        tg, th, tn = (sum(b[i] for b in bins.values()) for i in range(3))
        sums.setdefault(node, [(tg, th), (0.0, 0.0)])
        g = h = n = 0.0
        for k, edge in enumerate(edges[name]):
            if k in bins:
                g, h, n = g + bins[k][0], h + bins[k][1], n + bins[k][2]
            if min(n, tn - n) < LEAST:
                continue
            gain = g * g / (h + RIDGE) + (tg - g) ** 2 / (th - h + RIDGE) - tg * tg / (th + RIDGE)
            if gain > best.get(node, (1e-6,))[0] + 1e-9:
                best[node], sums[node] = (gain, name, k, edge), [(g, h), (tg - g, th - h)]
    return {node: x[1:] for node, x in best.items()}, sums


def judge_urls(pages: DataFrame, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the trees', 0 to 1) for every row."""
    scratch = Scratch(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    label = F.when(F.col("fit.verdict") == "block", 1).when(F.col("fit.verdict") == "allow", 0)
    model = fit(split.withColumn("label", label), scratch)
    rated = model.prepared(split.withColumns(features(F.col("url"), F.col("host"), F.col("path"))))
    score = 1 / (1 + F.exp(-model.raw()))
    verdict = F.coalesce("fit.verdict", F.when(F.col("score") > threshold, "block").otherwise("allow"))
    return rated.withColumn("score", score).select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "score")
