"""Personal data by patterns, and by bootstrapped contextual extraction; DataFrame functions only.

Base: e-mail addresses, IP addresses, card numbers and phone numbers, leftmost and not
overlapping within a kind, with offsets in code points. The expressions are written with
possessive quantifiers and look-behinds, so that a long run of one class is read once; they
find what the plain ones in SPEC find. Offsets come from splitting a text at its matches.

Bootstrap: seeds are the base entities, and values that are assigned to a name of SECRETS (as in
`token = "..."`), a kind of its own. Each seed induces patterns: the word before it, the two words
before, the word after (each with the entity's sort: with an at sign, without letters, mixed), and its
shape (lengths of digit runs; of a plain or hexadecimal number its length). Tokens with a digit or an at
sign of LEAST code points or more, and runs of neighbouring tokens with a digit, are unlabelled
instances. Patterns and instances form a bipartite graph of counted edges, scored in ROUNDS rounds.
A pattern's confidence for a kind is that kind's share of what it surrounds: scores of instances,
ordinary words in the same place (all occurrences of the context in documents with instances, less
those beside an instance), SMOOTH, and UNKNOWN of each instance that isn't scored yet, since
what no rule knows may well be an identifier. An instance's score is the highest confidence among its
patterns; seeds keep 1. What a pattern of CONFIDENCE or more (with at least SUPPORT different
seeds, or instances accepted in the round before) surrounds or shapes is found as that kind, unless seeds overlap it.

Counts are combined map-side before the shuffle; a word that surrounds a third of all entities
is one row per distinct token. What is accepted joins back on hashes of the texts it is in; up to
131,072 spans are a broadcast to a second scan, more meet it in a shuffle.

Defined results: a row for every input row, an empty table for an empty one; null and empty texts have
no spans; very long texts and tokens are read whole (contexts and tokens of more than WIDE code points
are known by a digest). Of patterns that tie, the kind last in the alphabet counts. Repeated rows count as
often as they occur and get equal spans. Extra columns are ignored, or kept by redact(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookline.llm.shared import Scratch, small

KINDS = ("email", "ip", "card", "phone")
SPEC = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
FAST = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TOKEN = r"(?<!\S)(?=\S*[0-9@])\S++"
#: Neighbouring tokens with a digit, one space between, none but the last ending in punctuation.
RUN = r"(?<!\S)(?=\S*[0-9])\S++(?:(?<![.,;:!?])\x20(?=\S*[0-9])\S++)++"
ROUNDS, CONFIDENCE, SUPPORT, SMOOTH, UNKNOWN, LEAST, WIDE = 3, 0.8, 10, 2, 0.01, 6, 64
SECRET = "secret"
SECRETS = r"(?i:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)"
VALUE = r"(?<![A-Za-z0-9_+/.-])(?<=" + SECRETS + r"[\"']?\s{0,4}[:=]\s{0,4}[\"']?)(?=[A-Za-z_+/.-]*+[0-9])[A-Za-z0-9_+/.-]{16,}+"
#: What may stand between a word and an entity without being part of either.
OPENING, CLOSING, BLANKS = "\"'(<[", "\"')>].,;:!?*%$&#", "\t\n\x0b\f\r"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes: from the right, every second one doubled."""
    at = F.sequence(F.lit(1), F.length(digits))
    value = lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
    twice = lambda v: F.when(v > 4, v * 2 - 9).otherwise(v * 2)
    return F.aggregate(at, F.lit(0), lambda acc, i: acc + F.when(i % 2 == 1, value(i)).otherwise(twice(value(i)))) % 10 == 0


def _fits(kind: str) -> Callable[[Column], Column]:
    if kind == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.ltrim(p, F.lit("0"))).try_cast("int"), F.lit(0)) <= 255)
        return lambda m: F.forall(F.split(m, r"\."), small)
    if kind == "card":
        return lambda m: (F.length(_digits(m)) <= 19) & _luhn(_digits(m))
    if kind == "phone":
        return lambda m: F.length(_digits(m)).between(8, 15)
    return lambda m: F.lit(True)


SPAN = "array<struct<kind:string,start:int,end:int,found:string>>"


def _spans(text: Column, pattern: str, kind: str) -> Column:
    """All matches with their offsets, by splitting the text at them: gaps and matches alternate."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast(SPAN)

    def place(m: Column) -> Column:
        parts = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(m)).alias("gap"), m.alias("match"))
        start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

        def add(acc: Column, x: Column) -> Column:
            at = acc["at"] + F.length(x["gap"])
            end = at + F.length(x["match"])
            span = F.struct(F.lit(kind).alias("kind"), at.alias("start"), end.alias("end"), x["match"].alias("found"))
            return F.struct(end.alias("at"), F.array_append(acc["out"], span).alias("out"))

        return F.aggregate(parts, start, add, lambda acc: acc["out"])

    # A one-element array binds the matches, so that they are looked for once.
    return F.element_at(F.transform(F.array(found), lambda m: F.when(F.size(m) == 0, empty).otherwise(place(m))), 1)


def _only(spans: Column, fits: Callable[[Column], Column]) -> Column:
    return F.filter(spans, lambda s: fits(s["found"]))


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _by_start(spans: Column) -> Column:
    return F.array_sort(spans, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))


def base_spans(text: Column) -> dict[str, Column]:
    """Kind to its spans in a text that is not null."""
    guard = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    out = {}
    for kind in KINDS:
        spans = _only(_spans(text, FAST[kind], kind), _fits(kind))
        out[kind] = F.when(guard[kind], spans).otherwise(F.array().cast(SPAN)) if kind in guard else spans
    return out


def _shape(token: Column) -> Column:
    """What sort of identifier: with an at sign, without letters, or mixed."""
    return F.when(F.contains(token, F.lit("@")), "@").when(F.rlike(token, F.lit(r"\p{L}")), "a").otherwise("9")


def _short(word: Column) -> Column:
    return F.when(F.length(word) > WIDE, F.concat(F.lit("\x00"), F.md5(word))).otherwise(word)


def _outline(token: Column) -> Column:
    """Of a number, plain or hexadecimal, its length; of other tokens the lengths of runs of digits, with letters as one."""
    low = F.lower(token)
    runs = F.regexp_replace(F.regexp_replace(low, "[0-9]", "9"), r"\p{L}+", "a")
    size = F.length(token).cast("string")
    return _short(F.when(F.rlike(low, F.lit("^[0-9]+$")), F.concat(F.lit("9:"), size)).when(F.rlike(low, F.lit("^[0-9a-f]+$")), F.concat(F.lit("h:"), size)).otherwise(runs))


CONTEXTS = "array<struct<side:string,word:string>>"


def _contexts(t: Column, s: Column) -> Column:
    """The words around a span of a lower-cased text whose white space is all blanks; no word is an empty string."""
    lead = F.rtrim(F.rtrim(F.substring(t, F.lit(1), s["start"]), F.lit(OPENING)))
    rest = F.ltrim(F.ltrim(F.substring(t, s["end"] + 1, F.length(t)), F.lit(CLOSING)))
    one, two = F.substring_index(lead, " ", -1), F.regexp_replace(F.substring_index(lead, " ", -2), " +", " ")
    pairs = F.array(F.struct(F.lit("<").alias("side"), one.alias("word")), F.struct(F.lit("<<").alias("side"), F.when(F.contains(two, F.lit(" ")), two).otherwise("").alias("word")), F.struct(F.lit(">").alias("side"), F.substring_index(rest, " ", 1).alias("word")))
    return F.filter(pairs, lambda c: c["word"] != "").cast(CONTEXTS)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _overlap(a: Column, b: Column) -> Column:
    return (b["start"] < a["end"]) & (a["start"] < b["end"])


def _instances(docs: DataFrame, carry: list[str]) -> DataFrame:
    """row (doc_id and what is carried, as one column, so that no names clash), text, base, seeds and other spans by row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    row = docs.select(F.struct("doc_id", *(F.col(f"`{c}`") for c in carry)).alias("row"), text.alias("text")).withColumns({f"b_{k}": v for k, v in base_spans(F.col("text")).items()})
    row = row.withColumn("base", F.concat(*(F.col(f"b_{k}") for k in KINDS)))
    secret = F.when(F.rlike("text", F.lit(SECRETS + r"[\"']?\s{0,4}[:=]")), _spans(F.col("text"), VALUE, SECRET)).otherwise(F.array().cast(SPAN))
    row = row.withColumn("secret", F.filter(secret, lambda s: ~F.exists("base", lambda b: _overlap(s, b))))
    row = row.withColumn("seeds", F.concat("base", "secret"))
    before, after = r"^[^\p{L}\p{N}+@]+", r"[^\p{L}\p{N}]+$"

    def bare(s: Column) -> Column:
        lead = F.length(F.regexp_extract(s["found"], before, 0))
        found = F.regexp_replace(F.regexp_replace(s["found"], before, ""), after, "")
        return F.struct(s["kind"].alias("kind"), (s["start"] + lead).alias("start"), (s["start"] + lead + F.length(found)).alias("end"), found.alias("found"))

    other = F.when(F.rlike("text", F.lit("[0-9@]")), F.transform(F.concat(_spans(F.col("text"), TOKEN, ""), _spans(F.col("text"), RUN, "")), bare)).otherwise(F.array().cast(SPAN))
    row = row.withColumn("other", F.filter(other, lambda s: (F.length(s["found"]) >= LEAST) & F.rlike(s["found"], F.lit("[0-9@]")) & ~F.exists("seeds", lambda b: _overlap(s, b))))
    # Rows are known by two hashes of their text: equal texts have equal spans.
    return row.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit("again"), F.col("text")))


def _found(docs: DataFrame, carry: list[str]) -> DataFrame:
    """row, text, base, spans (all, by kind and start)."""
    scratch = Scratch(docs.sparkSession)
    row = _instances(docs, carry)
    kept = scratch.keep(row.where((F.size("seeds") > 0) | (F.size("other") > 0)).select("h1", "h2", "text", "seeds", "other"), "seen")
    found = discover(kept, scratch)
    none = F.array().cast(SPAN)
    out = row.drop("other")
    out = out.join(small(found, 1 << 17), ["h1", "h2"], "left").withColumn("more", F.coalesce("more", none)) if found is not None else out.withColumn("more", none)
    every = F.concat("seeds", "more")
    return out.select("row", "text", "base", F.concat(*(_by_start(_of_kind(every, k)) for k in (*KINDS, SECRET))).alias("spans"))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, span_list."""
    out = _found(docs, [])
    counts = [F.size(_of_kind(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("row.doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), F.col("spans").alias("span_list"))


def discover(kept: DataFrame, scratch: Scratch) -> DataFrame | None:
    """h1, h2, more: the spans that confident patterns add to each text; None if there are none."""
    plain = kept.withColumn("t", F.translate(F.lower("text"), BLANKS, " " * len(BLANKS)))
    around = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found"), _contexts(F.col("t"), s).alias("contexts"))
    one = plain.select("h1", "h2", F.explode(F.transform(F.concat("seeds", "other"), around)).alias("s")).select("h1", "h2", "s.*")
    own = F.array(F.struct(F.lit("#").alias("side"), _outline(F.col("found")).alias("word"))).cast(CONTEXTS)
    edges = one.select("h1", "h2", "kind", "start", "end", _short(F.col("found")).alias("token"), "found", _shape(F.col("found")).alias("shape"), F.explode(F.concat("contexts", own)).alias("w"))
    pattern = F.concat_ws(" ", "w.side", _short(F.col("w.word")), F.when(F.col("w.side") != "#", F.col("shape")))
    place = F.when(F.col("w.side") != "#", F.xxhash64("w.word"))
    edges = scratch.keep(edges.select("h1", "h2", "kind", "start", "end", "token", "found", pattern.alias("pattern"), F.col("w.side").alias("side"), place.alias("place")), "edges")

    # How often each context stands beside an ordinary word.
    words = F.filter(F.split("t", " +"), lambda w: w != "")
    both = plain.select(words.alias("w")).select(F.explode(F.concat(F.transform("w", lambda x: F.xxhash64(x)), F.transform(F.arrays_zip("w", F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("v")), lambda x: F.xxhash64(F.concat_ws(" ", x["w"], x["v"]))))).alias("place"))
    often = both.groupBy("place").agg(F.count("*").alias("often"))
    beside = edges.where("place is not null").groupBy("side", "place").agg(F.count("*").alias("n"))
    plainly = beside.join(often, "place", "left").select("side", "place", F.greatest(F.coalesce("often", F.lit(0)) - F.col("n"), F.lit(0)).alias("ordinary"))

    graph = edges.groupBy("pattern", "side", "place", "token", "kind").agg(F.count("*").alias("n"))
    graph = scratch.keep(graph.join(plainly, ["side", "place"], "left").select("pattern", "token", "kind", "n", F.coalesce("ordinary", F.lit(0)).alias("ordinary")), "graph")
    seed, trust, score = F.col("kind") != "", None, None
    for _ in range(ROUNDS):
        scored = graph.join(score, "token", "left") if score is not None else graph.withColumns({"best": F.lit(None).cast("string"), "degree": F.lit(None).cast("double")})
        rated = scored.withColumn("as", F.when(seed, F.col("kind")).otherwise(F.col("best"))).withColumn("score", F.when(seed, 1.0).otherwise(F.coalesce("degree", F.lit(0.0))))
        by = rated.groupBy("pattern", "as").agg(F.sum(F.col("n") * F.col("score")).alias("weight"), F.sum(F.col("n") * (1 - F.col("score"))).alias("unknown"), F.countDistinct(F.when(seed | (F.col("score") >= CONFIDENCE), F.col("token"))).alias("seeds"), F.max("ordinary").alias("ordinary"))
        total = by.groupBy("pattern").agg(F.sum("weight").alias("all"), F.sum("unknown").alias("unknown"), F.max("ordinary").alias("ordinary"))
        sure = by.where(F.col("as").isNotNull() & (F.col("seeds") >= SUPPORT)).select("pattern", "as", "weight").join(total, "pattern")
        sure = sure.withColumn("confidence", F.col("weight") / (F.col("all") + F.col("unknown") * UNKNOWN + F.col("ordinary") + SMOOTH))
        trust = scratch.keep(sure.groupBy("pattern").agg(F.max(F.struct("confidence", "as")).alias("t")).select("pattern", "t.confidence", "t.as"), "patterns")
        score = graph.where(~seed).join(trust, "pattern").groupBy("token").agg(F.max(F.struct("confidence", "as")).alias("t")).select("token", F.col("t.confidence").alias("degree"), F.col("t.as").alias("best"))
    trust = trust.where(F.col("confidence") >= CONFIDENCE)
    if not trust.limit(1).count():
        return None
    hit = edges.where(~seed).join(trust, "pattern").groupBy("h1", "h2", "start", "end").agg(F.max(F.struct("confidence", "as")).alias("t"), F.min("found").alias("found"))
    more = F.collect_set(F.struct(F.col("t.as").alias("kind"), "start", "end", "found")).alias("more")
    inside = lambda a, b: (b["start"] <= a["start"]) & (a["end"] <= b["end"]) & (b["end"] - b["start"] > a["end"] - a["start"])
    # Of a run and a token in it the run counts.
    whole = F.filter("more", lambda a: ~F.exists("more", lambda b: inside(a, b)))
    out = scratch.keep(hit.groupBy("h1", "h2").agg(more).select("h1", "h2", whole.alias("more")), "found")
    scratch.drop(edges, graph)
    return out


def redact(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, each span of personal data replaced by its kind in brackets; overlapping spans become the first's. A text without any stays as it is, null too."""
    columns = docs.columns
    found = _found(docs, [c for c in columns if c != "doc_id"])
    spans = F.array_sort("spans", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        until = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        step = F.struct(s["end"].alias("at"), F.concat(acc["out"], until, F.lit("["), s["kind"], F.lit("]")).alias("out"))
        return F.when(s["start"] >= acc["at"], step).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    done = F.aggregate(spans, start, add, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    clean = F.when(F.size("spans") == 0, F.col("row").getField("text")).otherwise(done)
    return found.select(*(clean.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in columns))
