"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for each operator and stage."""

import hashlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brookline.llm import contamination, images, lattice, near, pii, quality, queries, repeats, tokens, toxicity, urls

#: Extra columns are called like those that the operators make or use.
CLASH = ["n_email", "spans", "span_list", "base_sha256", "ids", "decoded", "exact", "n_tokens", "h1", "h2", "seen", "more", "coverage", "item_id", "k1", "bands", "score"]
DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, rep bigint, label int, word string, component bigint, kind string, row string, base string, at int, " + ", ".join(f"{c} string" for c in CLASH)
LONG = "word " * 60_000 + "ends"
PASSAGE = " ".join(f"p{i}" for i in range(60))
TEXTS = [
    (1, PASSAGE + " one tail"),
    (2, "before " + PASSAGE),
    (3, PASSAGE + " one tail"),
    (4, None),
    (5, ""),
    (6, " \n\t "),
    (7, "tiny"),
    (8, LONG),
    (9, "x" * 200_000),
    (10, "mail a.b@c.example.com or +1 (017) 555-7713, 9.8.7.6 and 4539 1488 0343 6467; x@y no"),
    (None, PASSAGE),
    (None, None),
    (11, "tiny"),
    (7, "tiny"),
    (12, "Über ▁ mark <s> 日本 \r\n\x00 end"),
]
ROWS = [(i, t, "en" if k % 3 else None, None if k % 4 else "s", len(t or "") if k % 2 else None, 1, 1, "w", 5, "k", "r", "b", 3, *CLASH) for k, (i, t) in enumerate(TEXTS)]
LABELS = [(1, 1, 0), (2, 1, 1), (3, None, None), (7, 0, 0), (10, 1, 1), (10, 1, 1), (12, 0, 0), (99, 1, 1), (None, 1, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DDL)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


def count(df):
    return df.count()


def test_repeats(docs, none):
    got = {}
    for r in repeats.remove_repeats(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], r["n_removed"], r["kept_sha256"]))
    want = brute.repeats([(i, t) for i, t in TEXTS if i is not None], 50)
    assert {k: v[0] for k, v in got.items() if k is not None} == want
    assert len(got[7]) == 2 and sorted(x[1] for x in got[None]) == [0, 0]
    assert want[3][1] == 62 and want[2][1] == 60
    assert count(repeats.remove_repeats(none)) == 0


def test_near(docs, none):
    got = near.near_duplicates(docs, 3, 85).collect()
    want = brute.near([(i, t) for i, t in TEXTS if i is not None], 3, 85)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
            assert r["kept"] == (r["component_id"] == r["doc_id"])
    assert len(got) == len(TEXTS) and count(near.near_duplicates(none)) == 0
    kept = near.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 4, 5, 6, 7, 8, 9, 10, 12]


def test_pii(docs, none):
    for r in pii.find_pii(docs).collect():
        text = dict((i, t) for i, t in TEXTS if i is not None).get(r["doc_id"], "")
        spans = brute.pii(text)
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(k == kind for k, _, _ in spans) for kind in brute.SPEC)
    assert count(pii.find_pii(none)) == 0
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[10] == "mail [email] or [phone], [ip] and [card]; x@y no"
    assert clean[4] is None and clean[9] == "x" * 200_000
    assert pii.redact(docs).columns == docs.columns and count(pii.redact(docs)) == len(TEXTS)


def test_contamination(spark, docs, none):
    bench = spark.createDataFrame([(1, " ".join(f"p{i}" for i in [*range(30, 60), *range(30)])), (2, None), (None, PASSAGE), (3, "tiny"), (4, "")], "item_id bigint, text string")
    got = [(r["doc_id"], r["contaminated"], r["item_id"]) for r in contamination.contamination(docs, bench).collect()]
    assert sorted((g[0] or 0) for g in got if g[1]) == [0, 1, 2, 3] and len(got) == len(TEXTS)
    kept = contamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns and count(kept) == len(TEXTS) - 4
    assert count(contamination.contamination(none, bench)) == 0
    assert not any(r["contaminated"] for r in contamination.contamination(docs, bench.limit(0)).collect())


def test_tokens(docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    got = tokens.count_tokens(docs, queries.tokenizer_path(), limit=60).collect()
    texts = {i: t for i, t in TEXTS if i is not None}
    for r in got:
        if r["doc_id"] is not None:
            t = texts[r["doc_id"]] or ""
            n = len(sp.encode(t))
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 60)
    assert len(got) == len(TEXTS) and count(tokens.count_tokens(none, queries.tokenizer_path())) == 0


def test_lattice_documents(docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    texts = {i: t for i, t in TEXTS if i is not None}
    kept = lattice.encode_documents(docs, queries.tokenizer_path(), keep=True)
    assert kept.columns == [*docs.columns, "n_tokens_", "ids_", "decoded_", "exact_"]
    got = kept.collect()
    for r in got:
        assert [r[c] for c in CLASH] == CLASH
        if r["doc_id"] is not None:
            assert list(r["ids_"]) == sp.encode(texts[r["doc_id"]] or "")
            assert r["exact_"] == ("▁" not in (texts[r["doc_id"]] or ""))
    assert len(got) == len(TEXTS) and count(lattice.encode_documents(none, queries.tokenizer_path())) == 0


def test_scores(docs, labels, none):
    for fit, score, label in ((toxicity.fit, toxicity.score_toxicity, "toxic"), (quality.fit, quality.score_quality, "quality")):
        for train, table in ((docs, labels), (docs, labels.limit(0)), (none, labels)):
            model = fit(train, table, label, F.lit(True))
            rows = score(docs, model).collect()
            assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
            assert len({r["score"] for r in rows if r["doc_id"] in (4, 5)}) == 1
            assert count(score(none, model)) == 0
            if label == "toxic" and (train is none or table is not labels):
                assert {round(r["score"], 3) for r in rows} == {0.018}


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme/en/"), (4, "http://a.com/en/x?y#z"), (5, "http://example.com/en/7"), (6, "HTTP://EXAMPLE.COM/en/1"), (7, "http://xcom/en/"), (8, "http://com/en/"), (9, "http://é.org/es/ü#a?b"), (10, "http://h?/en/"), (11, "x://net/de/8"), (4, "http://a.com/en/x?y#z"), (12, "http://" + "a" * 50_000 + ".net/de/" + "b" * 50_000)]
    df = spark.createDataFrame([(*r, "h", "p", "f") for r in rows], "page_id bigint, url string, host string, path string, fit string")
    got = {r["page_id"]: r for r in urls.judge_urls(df).collect()}
    assert len(urls.judge_urls(df).collect()) == len(rows)
    assert (got[1]["host"], got[1]["path"], got[3]["host"]) == ("", "", "")
    assert (got[4]["host"], got[4]["path"], got[4]["rule"], got[4]["verdict"]) == ("a.com", "/en/x", "com/en/", "block")
    assert (got[5]["rule"], got[5]["verdict"]) == ("example.com/en/7", "allow")
    assert (got[6]["host"], got[6]["verdict"]) == ("example.com", "block")
    assert got[7]["rule"] is None and got[8]["rule"] == "com/en/"
    assert (got[9]["host"], got[9]["path"], got[9]["rule"]) == ("é.org", "/es/ü", "org/es/")
    assert (got[10]["host"], got[10]["path"]) == ("h", "") and got[11]["rule"] == "net/de/"
    assert all(r["verdict"] in ("allow", "block") for r in got.values())
    assert count(urls.judge_urls(df.limit(0))) == 0


def test_url_rules_have_the_words_of_the_contract(spark):
    want = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    rows = [(n, f"http://{host}{rule}{rest}", rule) for n, (host, rule, rest) in enumerate((h, r, x) for h in ("", "www.") for r in want for x in ("", "1?a=/en/7"))]
    rows += [(100, "http://a.example.net/de/71", "net/de/"), (101, "http://otherexample.net/de/8", "net/de/"), (102, "http://a.example.com/en/67", "com/en/"), (103, "http://otherexample.com/en/7", "com/en/")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string, fit string")).collect()}
    assert got == {n: (rule, want[rule]) for n, _, rule in rows}


def test_images(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    base = np.kron(rng.integers(0, 255, (12, 12)), np.ones((8, 8))).astype(np.uint8)
    pgm = lambda a: b"P5 %d %d 255\n" % a.shape[::-1] + np.ascontiguousarray(a).tobytes()
    other = np.kron(rng.integers(0, 255, (12, 12)), np.ones((8, 8))).astype(np.uint8)
    noisy = np.clip(base + rng.normal(0, 4, base.shape), 0, 255).astype(np.uint8)
    crop = base[10:, 6:]
    rows = [(1, pgm(base)), (2, pgm(noisy)), (3, pgm(crop)), (4, pgm(other)), (5, pgm(base)), (6, None), (7, b""), (8, b"P5 broken"), (9, pgm(np.zeros((32, 32), np.uint8))), (10, pgm(np.zeros((32, 32), np.uint8))), (None, pgm(base)), (1, pgm(base)), (11, pgm((base * 0.7 + 20).astype(np.uint8)))]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "image_id bigint, image binary, key bigint, rep bigint")
    got = images.image_copies(df).collect()
    of = {r["image_id"]: r["class_id"] for r in got}
    assert {k: of[k] for k in (1, 2, 3, 4, 5, 9, 10, 11)} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 1, 9: 9, 10: 9, 11: 1}
    assert [of[k] for k in (6, 7, 8, None)] == [6, 7, 8, None] and len(got) == len(rows)
    assert {r["image_id"] for r in got if not r["readable"]} == {6, 7, 8}
    assert count(images.image_copies(df.limit(0))) == 0


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, docs, labels, none, stage, tmp_path):
    d = str(tmp_path)
    labels.write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    name, fn = corpus_pipeline.STAGES[stage]
    for frame in (docs, none):
        out = fn(spark, frame, d)
        assert out.columns[: len(docs.columns)] == docs.columns
        assert all([r[c] for c in CLASH] == CLASH for r in out.select(CLASH).collect())
        out.write.parquet(f"{d}/{name}-{frame is none}")


def test_crops_and_rescaled_pictures_are_linked(spark):
    """A tenth of a photo has fewer than 14 of its strongest corners, and a rescaled picture hardly a long key in common with the original."""
    r = np.random.default_rng(1)

    def photo(n):
        f = np.fft.fftfreq(n)
        a = np.real(np.fft.ifft2(np.fft.fft2(r.normal(size=(n, n))) / (np.hypot(f[:, None], f) + 1 / n) ** 1.2))
        return np.rint(np.clip(128 + 48 * (a - a.mean()) / a.std(), 0, 255)).astype(np.uint8)

    pgm = lambda a: b"P5 %d %d 255\n" % a.shape[::-1] + a.tobytes()
    large, small = photo(256), photo(192)
    rescaled = np.rint(images._resized(small.astype(np.float32), 0.8)).astype(np.uint8)
    rows = [(1, pgm(large)), (2, pgm(large[150:231, 30:111])), (3, pgm(small)), (4, pgm(rescaled)), (5, pgm(photo(128)))]
    got = {x["image_id"]: x["class_id"] for x in images.image_copies(spark.createDataFrame(rows, "image_id bigint, image binary")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_contexts_discover_spaced_identifiers(spark):
    rows = [(i, f"phone: +44 20 7946 {1000 + i} today") for i in range(200)] + [(900, "phone: 020 7946 0958 today"), (901, "phone: (555) 123-4567 today")]
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[900] == "phone:7:20" and got[901] == "phone:8:21"


def test_discovered_identifiers_support_patterns(spark):
    rows = [(i, f"phone: +442079461{100 + i} now") for i in range(200)]
    rows += [(300 + k, f"phone: 02079460{100 + k}") for k in range(12)]
    rows += [(400 + 12 * n + k, f"ring 02079460{100 + k}") for n in range(4) for k in range(12)] + [(900, "ring 03012345678")]
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[900] == "phone:5:16"
