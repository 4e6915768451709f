"""The corpus operators against brute force, round trips and held-out accuracy on the driver's tables."""

import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from brookline.llm import contamination, graph, images, lattice, near, pii, queries, repeats, toxicity, urls
from brookline.llm.shared import Scratch, table

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    return [tuple(r) for r in table(spark, D, "documents").select("doc_id", "text").collect()]


def run(spark, name):
    return entry.queries()[name](spark, D).collect()


def test_names():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()


@pytest.mark.parametrize(("name", "label", "modulus", "rest", "level", "accuracy"), [("op1_toxicity", "toxic", 5, 0, 0.5, 0.85), ("op10_quality", "quality", 4, 2, 0.7, 0.9)])
def test_held_out(spark, name, label, modulus, rest, level, accuracy):
    got = run(spark, name)
    labels = {r["doc_id"]: r[label] for r in table(spark, D, "labels").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest) and r["predicted"] == (r["score"] >= level) for r in got)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([p == y for p, y in held]) >= accuracy


def test_kernel_tolerates_gaps():
    table_, bias = toxicity.train([b"idiot", b"moron"], [b"the", b"hean", b"thinion", b"ofed", b"edition", b"morning", b"more"] * 8)
    value = lambda *w: toxicity.decisions([x.encode() for x in w], table_, bias)
    hit, miss = value("idiot", "i.d.i.o.t", "idxiot", "1d10t", "mor-on", "IDIOT".lower()), value("the", "thean", "edition", "", "x")
    assert hit.min() > miss.max()


def test_kernel_is_that_of_plain_subsequences():
    """All subsequences of three and four letters within their spans, listed one by one."""
    from collections import Counter
    from itertools import combinations

    def weights(token):
        codes, out = [int(toxicity.CODE[c]) for c in b"^" + token], Counter()
        for n, span in toxicity.SPAN.items():
            for at in combinations(range(len(codes)), n):
                if at[-1] - at[0] < span and all(codes[k] for k in at):
                    out[tuple(codes[k] for k in at)] += toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    def plain(a, b):
        norm = lambda x: sum(v * v for v in x.values()) ** 0.5
        # The norm is that of the single occurrences, as a token is looked up.
        once = lambda t: sum(toxicity.DECAY ** (2 * (at[-1] - at[0] + 1)) for n, span in toxicity.SPAN.items() for at in combinations(range(len(t) + 1), n) if at[-1] - at[0] < span and all(int(toxicity.CODE[(b"^" + t)[k]]) for k in at)) ** 0.5
        x, y = weights(a), weights(b)
        assert norm(x) > 0
        return sum(v * y[k] for k, v in x.items()) / (once(a) * once(b))

    tokens = [b"idiot", b"id iot", b"idxiot", b"the", b"morning", b"1d10t", b"i.d.i.o.t"]
    got = toxicity._kernel(tokens, tokens)
    assert np.allclose(got, [[plain(a, b) for b in tokens] for a in tokens], atol=1e-9)
    toxic, clean = [b"idiot", b"moron"], [b"the", b"edition", b"morning", b"more"] * 3
    table_, bias = toxicity.train(toxic, clean)
    cells = lambda t: [(cell[0, k], w) for cell, real, w in toxicity._cells(toxicity._codes([t])[0]) for k in np.flatnonzero(real[0])]
    for t in tokens:
        own = cells(t)
        want = sum(float(table_[c]) * w for c, w in own) / sum(w * w for _, w in own) ** 0.5 + bias
        assert toxicity.decisions([t], table_, bias)[0] == pytest.approx(want, abs=1e-4)


def test_neighbouring_short_words_are_a_unit():
    """A space in an insult is a gap as any other: the pair is decided as the same unit with a gap is, and only where neither word decides."""
    import pyarrow as pa

    from brookline.llm import text as T

    table_, bias = toxicity.train([b"idiot", b"moron"], [b"the", b"hean", b"thinion", b"ofed", b"edition", b"morning", b"more"] * 8)
    texts = ["see the id iot there", "of the mo ron", "the idiot", "id\niot", "id", None, "the hean of it", "longer sentences follow"]
    chunk = next(T.chunks(pa.array(texts)))
    tokens, w = toxicity.Tokens(table_, bias), T.words(chunk, lower=True)
    _, _, at, pair = tokens.units(chunk, w, chunk.data.tobytes())
    own = {(int(w.rows[k]), chunk.data[w.start[k] : w.end[k + 1]].tobytes()): float(v) for k, v in zip(at, pair)}
    gapped = toxicity.decisions([b"id iot", b"mo ron"], table_, bias)
    assert own[0, b"id iot"] == pytest.approx(gapped[0], abs=1e-5) and own[1, b"mo ron"] == pytest.approx(gapped[1], abs=1e-5)
    assert (2, b"the idiot") not in own and all(r not in (4, 5, 7) for r, _ in own)
    top = tokens.top(chunk)[:, 0]
    assert min(top[0], top[1], top[2], top[3]) > max(top[4], top[5], top[6], top[7])


def test_votes_are_those_of_plain_neighbours():
    """Quality against a plain k-nearest-neighbour vote over cosines in the fitted space."""
    from brookline.llm import quality

    rng = np.random.default_rng(16)
    x = rng.poisson(0.3, (90, quality.BUCKETS + quality.EXTRA)).astype(np.float32)
    y = rng.integers(0, 2, 90)
    voters = quality.Voters(x, y, 12, 5)
    new = np.vstack([rng.poisson(0.3, (40, x.shape[1])).astype(np.float32), np.zeros((1, x.shape[1]), np.float32)])
    unit = lambda v: v / max(float(np.sqrt((v * v).sum())), 1e-12)
    space = lambda r: unit(unit(r * voters.weight) @ voters.axes)
    known, want = [space(r) for r in x], []
    for r in new:
        near = sorted(((float(space(r) @ k), i) for i, k in enumerate(known)), reverse=True)[:5]
        weigh = [max(0.0, c) ** quality.POWER for c, _ in near]
        want.append(sum(w * y[i] for w, (_, i) in zip(weigh, near)) / sum(weigh) if r.any() and sum(weigh) > 1e-12 else y.mean())
    assert np.allclose(voters.score(new), want, atol=1e-4)


def test_substring_dedup(spark, rows):
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in run(spark, "op2_substring_dedup")} == brute.repeats(rows, 50)


@pytest.mark.parametrize("most", [0, 3, 1 << 15])
def test_repeats_by_automata_and_by_hashes(spark, most):
    """The same rows whatever share of the phrases the automata have; copies, near copies, repeated and null ids."""
    rng = random.Random(13)
    words = [f"w{i}" for i in range(300)] + ["é", "\x00", "a.b"]
    passages = [rng.choices(words, k=rng.randrange(50, 120)) for _ in range(6)]
    texts = []
    for i in range(80):
        parts = [rng.choices(words, k=rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), rng.choices(words, k=rng.randrange(30))]
        texts.append((i, rng.choice([" ", "\n", " \t"]).join(x for part in parts for x in part)))
    texts += [(100 + k, texts[k][1]) for k in range(10)] + [(200, " ".join(passages[0]) * 3), (201, "short text"), (202, "short text"), (203, None), (204, "")]
    df = spark.createDataFrame([*texts, (None, texts[3][1]), (None, None), (205, texts[5][1]), (205, texts[5][1])], "doc_id bigint, text string")
    got = [tuple(r)[:4] for r in repeats.remove_repeats(df, most=most).collect()]
    want = brute.repeats([*texts, (205, texts[5][1])], 50)
    assert {i: r for i, *r in got if i is not None} == {i: list(r) for i, r in want.items()} and len(got) == len(texts) + 4
    assert [r[2] for r in got if r[0] is None] == [0, 0] and sum(n for _, n, _ in want.values()) > 2000


def test_automata_locate_phrases():
    import pyarrow as pa

    from brookline.llm import text as T

    rng = random.Random(14)
    texts = [" ".join(rng.choices(["a", "b", "ab", "é"], k=rng.randrange(60))) for _ in range(40)] + ["", "a\n\nb\ta  ab", None]
    chunk = next(T.chunks(pa.array(texts, pa.string())))
    w = T.words(chunk)
    phrases = [" ".join(rng.choices(["a", "b", "ab", "é"], k=3)) for _ in range(9)]
    shards = repeats.Shards([f" {p} ".encode() for p in phrases], np.arange(9, dtype=np.uint64), 2)
    assert sum(map(len, shards.phrases)) == 9 and len(shards.automata()) == 2
    here = repeats.locate(chunk, w, shards.automata(), 3)
    want = [x[k : k + 3] in [p.split() for p in phrases] for x in [brute.WORD.findall(t or "") for t in texts] for k in range(len(x))]
    assert here.tolist() == want and any(want)


def test_pii(spark, rows):
    for r in run(spark, "op3_pii"):
        spans = brute.pii(dict(rows)[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_pii_expressions_find_what_the_plain_ones_find(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("a1 .@+-(%2_") for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["".join(rng.choice("0123456789 -") for _ in range(40)) for _ in range(800)] + ["a@b.c@d.e x@y.z%w@v.u", "1.2.3.4.5.6.7.8", "256.1.1.1 00255.1.1.1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["base_sha256"] for r in pii.find_pii(df).collect()}
    want = {i: hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute.pii(t)).encode()).hexdigest() for i, t in enumerate(texts)}
    assert [texts[i] for i in want if want[i] != got[i]] == []


def test_contexts_discover_unseen_identifiers(spark):
    seeds = [(i, f"some text ring phone-no: +44-20-79{i:02d}-{i:04d} thanks and more") for i in range(60)]
    unseen = [(100 + i, f"other words phone-no: 020-79{i:02d}-{i:04d}, thanks bye") for i in range(3)] + [(200, "the number 020-7946-0000 elsewhere"), (201, "phone-no: none, thanks")]
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(seeds + unseen, "doc_id bigint, text string")).collect()}
    assert got[7] == "phone:25:41"
    assert [got[100 + i] for i in range(3)] == ["phone:22:35"] * 3
    assert got[200] == got[201] == ""


def test_shapes_discover_numbers_that_no_rule_knows(spark):
    """Sixteen digits that fail the check digit are found by the shape of those that pass; ordinary words and years are left alone."""
    rng = random.Random(3)
    words = ["the", "and", "of", "green", "river", "stone", "cloud", "walks"]
    number = lambda: "".join(rng.choice("0123456789") for _ in range(16))
    passing = [x for x in (number() for _ in range(2000)) if brute.luhn(x)][:60]
    failing = [x for x in (number() for _ in range(200)) if not brute.luhn(x)][:40]
    texts = [" ".join([*rng.choices(words, k=9), x, *rng.choices(words, k=9), "in 2024 of 123456 items"]) for x in passing + failing]
    texts += [f'some words token = "{rng.getrandbits(160):040x}" and more' for _ in range(30)] + ["then token = 12345678zz, for once", "see 0123456789abcdef0123456789abcdef01234567 there"]
    got = {r["doc_id"]: [(s.kind, t[s.start : s.end]) for s in r["span_list"]] for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect() for t in [texts[r["doc_id"]]]}
    assert all(got[i] == [("card", x)] for i, x in enumerate(passing + failing))
    assert all(len(got[i]) == 1 and got[i][0][0] == "secret" and len(got[i][0][1]) == 40 for i in range(100, 130))
    assert got[130] == [("secret", "12345678zz")] and got[131] in ([], [("secret", "0123456789abcdef0123456789abcdef01234567")])


def test_contexts_of_ordinary_words_find_nothing(spark):
    """A word that stands before many entities, but before many more ordinary words, is no pattern."""
    rows = [(i, f"at the +44 20 7946 {1000 + i} and the house by the sea and the hill of the king") for i in range(60)] + [(900, "so the 555123 went")]
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[0] == "phone:7:23" and got[900] == ""


def test_trees_are_those_of_plain_boosting(spark):
    """Every split and leaf, by sums over lists; and trees that decide: what looks like blocked URLs is blocked, what looks like allowed ones is not."""
    rng = random.Random(12)
    rows = [(i, f"http://h{rng.randrange(40)}.example.com/en/{rng.randrange(7000, 8000) if i % 2 else rng.randrange(100, 699)}" + ("?a=1&b=2" if i % 4 == 0 else "")) for i in range(600)]
    rows += [(1000 + i, f"http://x{i}.example.com/fr/{rng.randrange(7000, 8000) if i % 2 else rng.randrange(100, 699)}") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id bigint, url string")
    host, path = urls.host_and_path(F.col("url"))
    split = df.select("url", host.alias("host"), path.alias("path")).withColumn("fit", urls.rule_of(F.col("host"), F.col("path")))
    split = split.withColumn("label", F.when(F.col("fit.verdict") == "block", 1).when(F.col("fit.verdict") == "allow", 0))
    model = urls.fit(split, Scratch(spark))
    names = [*urls.NUMERIC, "suffix_count", "site_count"]
    made = [r.asDict() for r in model.prepared(split.where("label is not null").withColumns(urls.features(F.col("url"), F.col("host"), F.col("path")))).select(*names, "label").collect()]
    assert {k: round(np.exp(v)) for k, v in model.statistics["suffix"].items()} == {"com": 660} and len(model.trees) == urls.TREES
    n1 = sum(r["label"] for r in made)
    weight = {1: len(made) / (2 * n1), 0: len(made) / (2 * (len(made) - n1))}
    raw = [0.0] * len(made)
    for tree in model.trees:
        g, h = [], []
        for r, z in zip(made, raw):
            p = 1 / (1 + np.exp(-z))
            g.append(weight[r["label"]] * (p - r["label"]))
            h.append(weight[r["label"]] * p * (1 - p))
        node = [0] * len(made)
        for level, splits in enumerate(tree.levels):
            for at in set(node):
                own = [k for k, x in enumerate(node) if x == at]
                gain = lambda left: sum(g[k] for k in left) ** 2 / (sum(h[k] for k in left) + urls.RIDGE) if left else 0.0
                score = lambda name, edge: gain([k for k in own if made[k][name] < edge]) + gain([k for k in own if made[k][name] >= edge]) - gain(own)
                best = max((score(c, e) for c in names for e in sorted({r[c] for r in made}) if min(sum(made[k][c] < e for k in own), sum(made[k][c] >= e for k in own)) >= urls.LEAST), default=0.0)
                if at in splits:
                    name, _, edge = splits[at]
                    assert score(name, edge) >= 0.8 * best > 0  # edges are quantiles, so the very best may lie between two
            node = [2 * x + (made[k][splits[x][0]] >= splits[x][2] if x in splits else 0) for k, x in enumerate(node)]
        for leaf in set(node):
            own = [k for k, x in enumerate(node) if x == leaf]
            assert tree.leaves[leaf] == pytest.approx(-urls.RATE * sum(g[k] for k in own) / (sum(h[k] for k in own) + urls.RIDGE), abs=1e-9)
        raw = [z + tree.leaves[x] for z, x in zip(raw, node)]
    got = {r["page_id"]: r for r in urls.judge_urls(df).collect()}
    free = [r for r in got.values() if r["rule"] is None]
    assert len(free) == 60 and {r["verdict"] for r in free} == {"allow", "block"}
    assert all(r["verdict"] == ("block" if r["score"] > 0.5 else "allow") for r in free)


def test_every_suffix_has_its_count(spark, monkeypatch):
    """Suffixes beyond the most frequent ones are counted and looked up too, whether their table is broadcast or shuffled; scores are the same wherever a count is kept."""
    rng = random.Random(21)
    hosts = [f"h{i % 3}.{rng.choice('abcdefgh')}{int(rng.random() ** 2 * 5)}.{rng.choice(['com', 'com', 'net', 'org', 't1', 't2', 't3'])}" for i in range(800)]
    rows = [(i, f"http://{h}/{rng.choice(['en/', 'fr/', 'de/8' if i % 2 else 'de/'])}{rng.randrange(10**rng.randrange(1, 7))}") for i, h in enumerate(hosts)]
    rows += [(800 + i, f"http://{'e' * (1 + i % 5)}.example.com/en/{rng.choice('17')}{rng.randrange(1000)}") for i in range(90)] + [(900, None), (901, "none"), (902, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string").repartition(3)
    whole = {r["page_id"]: r["score"] for r in urls.judge_urls(df).collect()}
    assert len(whole) == len(rows) and len({round(x, 6) for x in whole.values()}) > 3
    want = [{}, {}]
    host = {i: u.split("/")[2] if u and "://" in u else "" for i, u in rows}
    for i, u in rows:
        for k in (0, 1):
            s = ".".join(host[i].split(".")[-1 - k :])
            want[k][s] = want[k].get(s, 0) + (u is not None)
    monkeypatch.setattr(urls, "STATISTICS", 3)
    for most in (1 << 17, 0):
        monkeypatch.setattr(urls, "BROADCAST", most)
        assert {r["page_id"]: r["score"] for r in urls.judge_urls(df).collect()} == pytest.approx(whole, abs=1e-9)
    h, path = urls.host_and_path(F.col("url"))
    split = df.select("page_id", "url", h.alias("host"), path.alias("path")).withColumn("fit", urls.rule_of(F.col("host"), F.col("path")))
    split = split.withColumn("label", F.when(F.col("fit.verdict") == "block", 1).when(F.col("fit.verdict") == "allow", 0))
    model = urls.fit(split, Scratch(spark))
    got = model.prepared(split.withColumns(urls.suffixes(F.col("host")))).collect()
    assert len(got) == len(rows) and [len(s) for s in model.statistics.values()] == [3, 3]
    for r in got:
        for k, name in enumerate(("suffix_count", "site_count")):
            assert round(np.exp(r[name])) == want[k][".".join(host[r["page_id"]].split(".")[-1 - k :])]


def test_rules_and_base_spans_in_sql(spark, rows):
    import duckdb

    from brookline.llm import sql

    con = duckdb.connect()
    for name in ("pages", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{D}/{name}.parquet'")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"] if r["rule"] else None) for r in run(spark, "op4_url_filters")}
    assert {r[0]: r[1:] for r in con.execute(sql.URL_RULES).fetchall()} == got
    assert sum(r[3] == "block" for r in got.values()) > 10
    counts = {r["doc_id"]: (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in run(spark, "op3_pii")}
    assert {r[0]: r[1:] for r in con.execute(sql.PII_COUNTS).fetchall()} == counts


def test_url_trees_decide_on_the_tables(spark):
    got = entry.queries()["op4_url_filters"](spark, D).where("rule is null").groupBy("verdict").count().collect()
    assert {r["verdict"] for r in got} == {"allow", "block"}


def test_near(spark, rows):
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run(spark, "op6_minhash_near_dedup")} == brute.near(rows, 3, 85)


def test_near_links_across_a_hot_bucket(spark):
    """A group in which the smallest and largest members link with few: what joins it are links between others."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    texts, now = [], list(words)
    for i in range(60):
        for _ in range(5):
            now[rng.randrange(len(now))] = f"x{i}_{rng.randrange(10**6)}"
        texts.append((i, " ".join(now)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string"), 3, 85).collect()}
    want = brute.near(texts, 3, 85)
    assert got == want and len({c for _, c in want.values()}) < 60


def test_near_lists_no_pairs_of_a_large_group(spark, monkeypatch):
    """Edited copies of a text with an id in the middle: those near enough link with it alone, the others with nothing, and what is written doesn't grow with the pairs."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(300):
        now = list(words)
        for k in rng.sample(range(200), 0 if i == 150 else 3 + i % 6):
            now[k] = f"x{i}_{k}"
        texts.append((i, " ".join(now)))
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    written, keep = {}, Scratch.keep

    def counted(self, table, name):
        out = keep(self, table, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(Scratch, "keep", counted)
    want = brute.near(texts, 3, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_duplicates(df, 3, 85).collect()}
    assert got == want and 100 < len({c for _, c in want.values()}) < 250
    assert max(written.values()) <= 32 * len(texts), written
    monkeypatch.setattr(near, "BLOCK", 20_000)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_duplicates(df, 3, 85).collect()}
    assert got == want and written["pairs"] > 20


def test_blocks_of_sets(monkeypatch):
    """Intersections by matrices against sets; nodes joined against a walk over the links."""
    monkeypatch.setattr(near, "COLUMNS", 7)
    rng = random.Random(5)
    for _ in range(20):
        a, b = ([sorted(rng.sample(range(60), rng.randrange(1, 40))) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        sides = [x for s in (a, b) for x in (np.repeat(np.arange(len(s)), [len(e) for e in s]), np.array([x for e in s for x in e], np.uint64), len(s))]
        assert near.intersections(*sides).tolist() == [[len(set(x) & set(y)) for y in b] for x in a]
        u, v = (np.array(rng.sample(range(-20, 20), n)) for n in (9, 11))
        linked = np.array([[rng.random() < 0.1 for _ in v] for _ in u])
        whole = {int(x): {int(x)} for x in (*u, *v)}
        for i, j in zip(*np.nonzero(linked)):
            one = whole[int(u[i])] | whole[int(v[j])]
            whole.update(dict.fromkeys(one, one))
        node, low = near.joined_nodes(linked, u, v)
        assert dict(zip(node.tolist(), low.tolist())) == {x: min(s) for x, s in whole.items() if min(s) < x}


def test_sketch_agrees_with_jaccard():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 60, 900).astype(np.uint64)
    b = np.concatenate([a[:600], rng.integers(0, 1 << 60, 300).astype(np.uint64)])
    s = near.sketches(np.repeat([0, 1], 900), np.concatenate([a, b]), 2, 1024)
    assert (s != np.iinfo(np.uint64).max).all() and abs((s[0] == s[1]).mean() - 0.5) < 0.06
    one = near.sketches(np.array([0]), np.array([5], np.uint64), 1, 64)
    assert (one != np.iinfo(np.uint64).max).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (100, 102), (7, 7)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u bigint, v bigint"), Scratch(spark)).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100}


def test_tiles():
    h = lambda s: np.array([zlib.crc32(w.encode()) for w in s.split()], np.uint64)
    a, b = h("a b c d e f g h i j k l"), h("x g h i j k l y a b c d e f z")
    assert sorted(contamination.tiles(a, b, 5)) == [(0, 8, 6), (6, 1, 6)]
    assert contamination.tiles(a, h("a b c d"), 5) == []
    assert sum(n for *_, n in contamination.tiles(h("a a a a a a"), h("a a a a a a a a a"), 5)) == 6


def test_tiles_are_those_of_the_plain_algorithm():
    rng = random.Random(6)
    for _ in range(400):
        letters = rng.choice([2, 3, 6])
        item, doc = ([rng.randrange(letters) for _ in range(rng.randrange(1, 40))] for _ in range(2))
        if rng.random() < 0.5:
            at = rng.randrange(len(item))
            doc[rng.randrange(len(doc)) :] = item[at:] + item[:at]
        got = contamination.tiles(np.array(item, np.uint64) + np.uint64(1), np.array(doc, np.uint64) + np.uint64(1), 3)
        assert got == brute.tiles(item, doc, 3)


def test_tiling_of_repetitive_texts_costs_what_it_has_of_runs():
    import time

    began = time.time()
    same = np.full(60_000, 7, np.uint64)
    assert contamination.tiles(same[:300], same, 5) == [(0, 0, 300)]
    two = np.tile(np.array([3, 9], np.uint64), 10_000)
    assert sum(n for *_, n in contamination.tiles(two[:400], two, 5)) == 400
    assert time.time() - began < 10


def test_contamination_by_definition(spark):
    """Coverage of every document by every item, listed in full; ids repeat, and are null."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(3, 40)))) for i in range(25)] + [(3, "another text of the third item that is long enough"), (None, " ".join(words)), (40, None)]
    docs = []
    for k in range(150):
        own = rng.choice(items[:25])[1].split()
        cut = rng.randrange(1, len(own))
        docs.append((rng.choice([k, k, 5, None]), " ".join([*rng.choices(words, k=10), *own[cut:], *rng.choices(words, k=3), *own[: rng.randrange(cut + 1)]]).title()))
    docs += [(5, None), (None, ""), (6, "another text of the third item that is long enough")] * 2
    got = contamination.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = []
    for i, text in docs:
        own = brute.WORD.findall(brute.lower(text or ""))
        share = [(sum(n for *_, n in brute.tiles(w, own, 5)) / len(w), k) for k, t in items if k is not None and t for w in [brute.WORD.findall(brute.lower(t))]]
        over = sorted({k for c, k in share if c >= 0.5})
        want.append((i, over, max(c for c, _ in share) if over else None))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    rows = [(r["doc_id"], list(r["item_ids"]), r["coverage"] if r["contaminated"] else None) for r in got]
    assert sorted(rows, key=key) == sorted(want, key=key) and sum(bool(o) for _, o, _ in want) > 40
    assert all(r["contaminated"] == bool(r["item_ids"]) and (r["item_id"] is None) == (r["coverage"] == 0) for r in got)


def test_decontamination_catches_reordered_passages_only(spark):
    items = [(r["item_id"], r["text"]) for r in table(spark, D, "benchmark").collect()][:8]
    docs = []
    for i, t in items:
        w = t.split()
        k = len(w) // 3
        docs += [(10 * i, "lead in " + " ".join(w[k:] + ["and"] + w[:k]) + " tail"), (10 * i + 1, " ".join(w[:6]) + " other words follow here and here"), (10 * i + 2, " ".join(reversed(w)))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r["doc_id"]: (r["contaminated"], r["item_id"]) for r in contamination.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()}
    assert all(got[10 * i] == (True, i) for i, _ in items)
    assert not any(got[10 * i + k][0] for i, t in items for k in (1, 2) if len(t.split()) > 14)


def test_lattice_replays_merges(spark, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    words = sorted({w for _, t in rows[:40] for w in t.split() if len(w) < 20})[:400] + ["日本x", "\t", "a" * 18]
    df = spark.createDataFrame([("▁" + w,) for w in words], "word string")
    got = {r["word"]: r["ids"] for r in lattice.encode_words(df, F.broadcast(lattice.piece_table(spark, queries.tokenizer_path()))).collect()}
    assert [w for w in words if got["▁" + w] != sp.encode(w)] == []


def test_frequent_words_take_any_place_but_the_first(spark, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    df = spark.createDataFrame([(1, "first\nline  two\tx a a"), (2, "first a " + "y" * 60), (3, None)], "doc_id bigint, text string")
    got = {r["word"] for r in lattice.frequent_words(df).collect()}
    assert got == {"\n", "line", "▁▁two\tx", "▁a"}
    for docs in (df, df.limit(0)):
        tier = lattice.broadcast_words(docs, queries.tokenizer_path())
        assert len(tier.keys) == len(tier.size) and tier.size.sum() == len(tier.flat)
    encoded = {r["word"]: r["ids"] for r in lattice.encode_words(lattice.frequent_words(df), lattice.piece_table(spark, queries.tokenizer_path())).collect()}
    assert encoded["line"] == sp.encode("\nline")[len(sp.encode("\n")) :] and encoded["\n"] == sp.encode("\n")[-1:]


def test_caches_that_overflow_change_nothing(rows, monkeypatch):
    import pyarrow as pa
    import sentencepiece

    from brookline.llm import text as T

    monkeypatch.setattr(lattice, "SLOTS", 6)
    monkeypatch.setattr(lattice, "CACHED", 500)
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    rng = random.Random(4)
    texts = [t for _, t in rows[:60]] + ["".join(rng.choice("ab ▁\n\t éx<s>") for _ in range(rng.randrange(60))) for _ in range(2000)] + [None, "", " "]
    none = lattice.Tier(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))
    encoder = lattice.Encoder(queries.tokenizer_path(), none)
    for chunk in T.chunks(pa.array(texts, pa.string()), 1 << 13):
        offsets, ids = encoder.encode(chunk)
        for r in range(chunk.rows):
            assert ids[offsets[r] : offsets[r + 1]].tolist() == sp.encode(texts[chunk.first + r] or "")
        encoder.refresh()


def test_lattice_viterbi_is_the_best_path(spark):
    pieces = {"a": -1.0, "b": -1.5, "ab": -2.0, "abc": -2.2, "c": -1.1, "bc": -0.9, "ca": -1.4}
    table_ = spark.createDataFrame([(p, k, s) for k, (p, s) in enumerate(pieces.items())], "piece string, id int, score double")

    def best(word):
        top = {0: (0.0, [])}
        for end in range(1, len(word) + 1):
            ways = [(top[at][0] + pieces[word[at:end]], top[at][1] + [word[at:end]]) for at in range(end) if word[at:end] in pieces]
            top[end] = max(ways)
        return top[len(word)]

    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(40)})
    ids = list(pieces)
    for r in lattice.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), table_, lattice.UNIGRAM).collect():
        cut = [ids[i] for i in r["ids"]]
        assert "".join(cut) == r["word"] and sum(pieces[p] for p in cut) == pytest.approx(best(r["word"])[0])


def test_documents_round_trip(spark, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    got = run(spark, "op5_sentencepiece")
    counts = {r["doc_id"]: r["n_tokens"] for r in run(spark, "op8_token_counts")}
    for r in got:
        text = dict(rows)[r["doc_id"]]
        assert r["exact"] and list(r["ids"]) == sp.encode(text) and counts[r["doc_id"]] == r["n_tokens"]


def test_image_formats():
    import struct
    import zlib as z

    a = np.arange(6 * 5).reshape(5, 6).astype(np.uint8) * 8
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", z.crc32(k + b))
    filtered = b"".join(bytes([1]) + bytes([int(a[y, 0])]) + bytes(((a[y, 1:].astype(int) - a[y, :-1]) & 255).astype(np.uint8)) for y in range(5))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 0, 0, 0, 0)) + chunk(b"IDAT", z.compress(filtered)) + chunk(b"IEND", b"")
    assert (images.decode(png) == a).all()
    assert (images.decode(b"P5\n# c\n6 5\n255\n" + a.tobytes()) == a).all()
    rgb = np.repeat(a[:, :, None], 3, axis=2)
    assert np.allclose(images.decode(b"P6 6 5 255\n" + rgb.tobytes()), a, atol=1e-3)
    line = lambda y: rgb[y].tobytes() + b"\0" * (-18 % 4)
    bmp = b"BM" + struct.pack("<IHHI", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 6, 5, 1, 24, 0, 0, 0, 0, 0, 0) + b"".join(line(y) for y in range(4, -1, -1))
    assert np.allclose(images.decode(bmp), a, atol=1e-3)
    assert images.decode(png[:30]) is None


def test_filters_of_png():
    """All five filters, by undoing them byte by byte."""
    import struct
    import zlib as z

    rng = np.random.default_rng(9)
    a = rng.integers(0, 255, (11, 7, 3)).astype(np.uint8)
    lines, above = [], np.zeros((7, 3), int)
    for y in range(11):
        row, kind = a[y].astype(int), y % 5
        left, corner = np.vstack([np.zeros((1, 3), int), row[:-1]]), np.vstack([np.zeros((1, 3), int), above[:-1]])
        p = left + above - corner
        paeth = np.array([[min((abs(q - v), k, v) for k, v in enumerate((l, u, c)))[2] for q, l, u, c in zip(*r)] for r in zip(p, left, above, corner)])
        guess = (0, left, above, (left + above) // 2, paeth)[kind]
        lines.append(bytes([kind]) + ((row - guess) & 255).astype(np.uint8).tobytes())
        above = row
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", z.crc32(k + b))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 11, 8, 2, 0, 0, 0)) + chunk(b"IDAT", z.compress(b"".join(lines))) + chunk(b"IEND", b"")
    assert np.allclose(images.decode(png), a @ np.array([0.299, 0.587, 0.114]), atol=1e-3)


def test_copies_are_those_of_exhaustive_consensus(spark):
    """Candidates against all pairs: crops, turns, noise, brightness and scales of drawn pictures."""
    rng = np.random.default_rng(11)
    vectors = [(i, [float(x) for x in rng.normal(0, 1, 64)]) for i in range(30)]
    drawn = [bytes(r["image"]) for r in images.rasters(spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>")).orderBy("image_id").collect()]
    pgm = lambda a: b"P5 %d %d 255\n" % a.shape[::-1] + np.ascontiguousarray(np.rint(np.clip(a, 0, 255)).astype(np.uint8)).tobytes()
    rows = list(enumerate(drawn))
    for i, data in enumerate(drawn):
        a = images.decode(data)
        edits = [a[8:56, 4:58], np.rot90(a), a + rng.normal(0, 12, a.shape), a * 0.6 + 30, images._resized(a, 0.6), images._resized(a, 0.8)]
        rows += [(100 + 10 * i + k, pgm(x)) for k, x in enumerate(edits)]
    got = {r["image_id"]: r["class_id"] for r in images.image_copies(spark.createDataFrame(rows, "image_id bigint, image binary")).collect()}
    own = {i: images.describe(images.decode(x)) for i, x in rows}
    linked = [(i, 100 + 10 * i + k) for i in range(30) for k in range(6) if images.consensus(own[i], own[100 + 10 * i + k]) >= images.INLIERS]
    assert len(linked) > 120 and np.mean([got[a] == got[b] for a, b in linked]) >= 0.95
    assert all(got[i] == i for i in range(30)) and all(c == k or c == (k - 100) // 10 or (c - 100) // 10 == (k - 100) // 10 for k, c in got.items() if k >= 100)


def test_vectors_that_are_nearly_equal_make_copies(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(0, 1, (12, 64))
    rows = [(i, [float(x) for x in base[i]]) for i in range(12)] + [(100 + i, [float(x) for x in base[i] + rng.normal(0, 0.08, 64)]) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {r["image_id"]: r["class_id"] for r in images.image_copies(images.rasters(df)).collect()}
    assert got == {**{i: i for i in range(12)}, **{100 + i: i for i in range(6)}}


def test_pipeline_against_brute_force(spark):
    """Each stage on its own input: what the near-duplicate and decontamination stages keep is what brute force keeps."""
    import corpus_pipeline

    docs = table(spark, D, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)
    kept = {r["doc_id"] for r in stages["near_dedup"](spark, docs, D).select("doc_id").collect()}
    assert kept == {i for i, (_, c) in brute.near(rows, 5, 80).items() if i == c}
    bench = [(r["item_id"], brute.WORD.findall(brute.lower(r["text"]))) for r in table(spark, D, "benchmark").collect()]
    planted = {i for i, t in rows if any(" ".join(w) in " ".join(brute.WORD.findall(brute.lower(t))) for _, w in bench)}
    stay = {r["doc_id"] for r in stages["decontamination"](spark, docs, D).select("doc_id").collect()}
    assert stay == {i for i, _ in rows} - planted
    out = corpus_pipeline.run(spark, D)
    assert out.where("not exact and text not like '%▁%'").count() == 0 and 0 < out.count() < len(rows)
