"""Secret scans: fixed patterns, and character Markov models for the rest.

Base patterns find assignments, access keys and long hex strings. Beyond
them, every token of ``TOKEN_CHARS`` or more key characters with a letter
and a digit is scored by two first-order character models, one of random
strings and one of ordinary identifiers: the mean log-likelihood ratio of
its transitions. At ``MIN_RATIO`` or more the token is a secret of kind
``random``, unless it overlaps a base span.

The models are trained from labelled samples taken from the documents
themselves. Ordinary: the distinct words of about ``SAMPLE_DOCS`` documents
(a hash of id and text decides), in their usual spellings. Random: the
values that the base patterns found there, and digests of the words. What
is collected is one count per pair of characters, at most 2 x 67 x 67.

Everything is DataFrame functions; scanning is one narrow projection, so a
text is looked at where it is read and never shuffled. Spans are in code
points from 0, end exclusive: ``split`` gives the text between matches, so
a match starts after all that precedes it. Running sums and maxima over the
matches of a text are taken chunk by chunk, and texts are cut in stretches
of many spans before single ones, so a text full of matches costs little
more than its length.

Defined results: a null text is empty and holds nothing; repeated rows and
null ids are scanned row by row; an empty table gives no rows, and models
without a sample rate every transition alike, which finds nothing.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns: kind, pattern, and which group must have how many characters.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
RANDOM = "random"
KINDS = (*(kind for kind, *_ in BASE), RANDOM)

TOKEN_CHARS = 20
TOKEN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{TOKEN_CHARS},}}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SAMPLE_DOCS = 500
MIN_RATIO = 0.7
SMOOTHING = 0.5
MASK = "[SECRET]"

_SPAN = "array<struct<start:long,kind:int,end:long>>"
_CHUNK = 256
_FAR = 1 << 62


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _chunks(values: Column, size: int) -> Column:
    last = F.greatest(F.ceil(F.size(values) / size).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(values, k * size + 1, F.lit(size)))


def running(values: Column, combine, start: int, levels: int = 1) -> Column:
    """Running results of ``combine`` over an array of longs.

    An array that grows by one entry is copied each time, so it grows in
    chunks of ``_CHUNK``; each chunk goes on from the result of those before.
    """
    first = F.lit(start).cast("long")

    def within(chunk: Column, at: Column) -> Column:
        zero = F.struct(at.alias("at"), F.array().cast("array<long>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            now = combine(acc["at"], x)
            return F.struct(now.alias("at"), F.array_append(acc["out"], now).alias("out"))

        return F.aggregate(chunk, zero, step, lambda acc: acc["out"])

    if not levels:
        return within(values, first)

    def over(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, first, combine))
        return _let(
            running(totals, combine, start, levels - 1),
            lambda before: F.flatten(F.transform(chunks, lambda c, k: within(c, F.when(k > 0, F.get(before, k - 1)).otherwise(first)))),
        )

    return _let(values, lambda v: _let(_chunks(v, _CHUNK), over))


def _spans(text: Column, kind: int, pattern: str, accept) -> Column:
    """array<(start, kind, end)> of the accepted matches; matches never overlap."""

    def placed(pairs: Column) -> Column:
        sizes = F.transform(pairs, lambda p: F.struct(F.length(p["before"]).cast("long").alias("before"), F.length(F.coalesce(p["match"], F.lit(""))).cast("long").alias("match"), p["match"].alias("text")))

        def spans(sized: Column) -> Column:
            ends = running(F.transform(sized, lambda z: z["before"] + z["match"]), lambda a, x: a + x, 0)
            whole = F.arrays_zip(sized.alias("z"), ends.alias("end"))
            good = F.filter(whole, lambda w: w["z"]["text"].isNotNull() & accept(w["z"]["text"]))
            return F.transform(good, lambda w: F.struct((w["end"] - w["z"]["match"]).alias("start"), F.lit(kind).alias("kind"), w["end"].alias("end")))

        return _let(sizes, spans)

    between = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = _let(F.arrays_zip(between.alias("before"), matches.alias("match")), placed)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """The spans of the base patterns, by start, then kind."""
    found = []
    for kind, (_, pattern, group, least) in enumerate(BASE):
        value = (lambda m: m) if group == 0 else (lambda m, p=pattern, g=group: F.regexp_extract(m, p, g))
        found.append(_spans(text, kind, pattern, lambda m, v=value, n=least: F.length(v(m)) >= n))
    return F.sort_array(F.concat(*found))


def _pairs(word: Column) -> Column:
    """Each character's place in the alphabet, as (this, next) for every transition."""
    places = F.transform(F.split(word, ""), lambda c: F.position(c, F.lit(ALPHABET)))
    return F.explode(F.arrays_zip(F.slice(places, F.lit(1), F.size(places) - 1).alias("a"), F.slice(places, F.lit(2), F.size(places)).alias("b")))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """Log-likelihood ratios of the transitions (place of this * 68 + place of next)."""
    width = len(ALPHABET) + 1
    keep = max(1, -(-docs.count() // SAMPLE_DOCS))
    sample = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(id_col, text_col).alias("at")).filter(
        F.pmod("at", F.lit(keep)) == 0
    )
    words = sample.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("word")).distinct()
    spelt = F.array("word", F.lower("word"), F.upper("word"), F.initcap("word"), F.concat_ws("_", F.lower("word"), F.lower("word")), F.concat(F.lower("word"), F.initcap("word")))
    ordinary = words.select(F.lit(0).alias("random"), F.explode(spelt).alias("word"))
    digests = words.select(
        F.lit(1).alias("random"),
        F.explode(F.array(F.base64(F.unhex(F.sha2("word", 256))), F.sha1("word"), F.upper(F.conv(F.substring(F.sha1("word"), 1, 12), 16, 36)))).alias("word"),
    )
    values = sample.select(
        F.lit(1).alias("random"),
        F.explode(F.concat(*[F.regexp_extract_all("text", F.lit(p), F.lit(g)) for _, p, g, _ in BASE])).alias("word"),
    )
    counts = (
        ordinary.union(digests).union(values).select("random", _pairs(F.col("word")).alias("pair"))
        .filter("pair.a > 0 and pair.b > 0").groupBy("random", "pair").count().collect()
    )
    seen: list[dict] = [defaultdict(float), defaultdict(float)]
    for r in counts:
        seen[r.random][r.pair.a, r.pair.b] += r["count"]
    ratios = [0.0] * (width * width)
    for a in range(1, width):
        totals = [sum(s.get((a, b), 0) for b in range(1, width)) + SMOOTHING * len(ALPHABET) for s in seen]
        for b in range(1, width):
            like = [(s.get((a, b), 0) + SMOOTHING) / t for s, t in zip(seen, totals, strict=True)]
            ratios[a * width + b] = round(math.log(like[1] / like[0]), 4)
    return ratios


def mean_ratio(token: Column, ratios: list[float]) -> Column:
    """The mean log-likelihood ratio of a token's transitions, random over ordinary."""
    width = len(ALPHABET) + 1
    # one literal, folded when the query is planned
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    zero = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))

    def step(acc: Column, place: Column) -> Column:
        return F.struct(place.alias("last"), (acc["sum"] + F.get(table, acc["last"] * width + place)).alias("sum"))

    places = F.transform(F.split(token, ""), lambda c: F.position(c, F.lit(ALPHABET)))
    return F.aggregate(places, zero, step, lambda acc: acc["sum"]) / F.greatest(F.length(token) - 1, F.lit(1))


def all_spans(text: Column, base: Column, ratios: list[float]) -> Column:
    """``base`` and the random tokens that overlap none of it, by start, then kind."""

    def secret(token: Column) -> Column:
        return token.rlike("[0-9]") & token.rlike("[A-Za-z]") & (mean_ratio(token, ratios) >= MIN_RATIO)

    def apart(tokens: Column) -> Column:
        def event(of: Column, token: bool) -> Column:
            return F.transform(of, lambda s: F.struct(s["start"].alias("start"), F.lit(token).alias("token"), s["kind"].alias("kind"), s["end"].alias("end")))

        def free(events: Column) -> Column:
            # how far the base spans before reach, and where the next one after begins
            reach = running(F.transform(events, lambda e: F.when(e["token"], F.lit(0)).otherwise(e["end"])), lambda a, x: F.greatest(a, x), 0)
            starts = F.transform(F.reverse(events), lambda e: F.when(e["token"], F.lit(_FAR)).otherwise(e["start"]))
            after = F.reverse(running(starts, lambda a, x: F.least(a, x), _FAR))
            all_ = F.arrays_zip(events.alias("e"), reach.alias("reach"), after.alias("after"))
            fresh = F.filter(all_, lambda z: z["e"]["token"] & (z["reach"] <= z["e"]["start"]) & (z["after"] >= z["e"]["end"]))
            return F.transform(fresh, lambda z: F.struct(z["e"]["start"].alias("start"), z["e"]["kind"].alias("kind"), z["e"]["end"].alias("end")))

        events = F.sort_array(F.concat(event(base, False), event(tokens, True)))
        return F.when(F.size(tokens) == 0, base).otherwise(F.sort_array(F.concat(base, _let(events, free))))

    return _let(_spans(text, KINDS.index(RANDOM), TOKEN, secret), apart)


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, base and spans as array<(start, kind, end)>; see ``KINDS``."""
    ratios = train(docs, id_col, text_col)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("base", base_spans(text))
    rows = rows.withColumn("spans", all_spans(text, F.col("base"), ratios))
    return rows.select(F.col("id").alias(id_col), "base", "spans")


def _masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced; what a span shares with one before it is replaced once."""

    def part(of: Column, at: Column, piece: Column) -> Column:
        """What lies from the first to the last place of some pieces; ``of`` begins at place ``at``."""
        first, last = F.get(piece, F.lit(0))["from"], F.element_at(piece, -1)["to"]
        return F.substring(of, (first - at + 1).cast("int"), (last - first).cast("int"))

    def kept(of: Column, at: Column, p: Column) -> Column:
        before = F.substring(of, (p["from"] - at + 1).cast("int"), (p["to"] - p["from"]).cast("int"))
        return F.when(p["again"], F.lit("")).otherwise(F.concat(before, F.lit(MASK)))

    def cut(of: Column, at: Column, pieces: Column, size: int) -> Column:
        # a long text is cut in stretches of many pieces first: finding a place takes time by its distance
        if size == 1:
            return F.array_join(F.transform(pieces, lambda p: kept(of, at, p)), "")
        inner = lambda group: _let(part(of, at, group), lambda text: cut(text, F.get(group, F.lit(0))["from"], group, size // _CHUNK))
        return F.array_join(F.transform(_chunks(pieces, size), inner), "")

    def whole(ends: Column) -> Column:
        def piece(s: Column, k: Column) -> Column:
            at = F.when(k > 0, F.get(ends, k - 1)).otherwise(F.lit(0).cast("long"))
            return F.struct(at.alias("from"), F.greatest(s["start"], at).alias("to"), (s["end"] <= at).alias("again"))

        rest = F.substring(text, (F.element_at(ends, -1) + 1).cast("int"), F.length(text))
        begun = _let(F.transform(spans, piece), lambda pieces: cut(text, F.lit(0).cast("long"), pieces, _CHUNK * _CHUNK))
        return F.concat(begun, rest)

    return _let(running(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x), 0), whole)


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, with every secret of the text replaced by ``MASK``.

    Spans that overlap are masked piece by piece; a null text stays null.
    """
    ratios = train(docs, id_col, text_col)
    base, spans = (f"_secret_{k}_{len(docs.columns)}" for k in ("base", "spans"))
    while base in docs.columns or spans in docs.columns:
        base, spans = base + "_", spans + "_"
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.withColumn(base, base_spans(text)).withColumn(spans, all_spans(text, F.col(base), ratios))
    masked = F.when(F.size(spans) > 0, _masked(F.col(f"`{text_col}`"), F.col(spans))).otherwise(F.col(f"`{text_col}`"))
    return rows.withColumn(text_col, masked).select(*[F.col(f"`{c}`") for c in docs.columns])
