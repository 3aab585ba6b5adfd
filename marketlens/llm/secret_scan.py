"""Secret scans with DataFrame operations only.

Named patterns give the base spans. Beyond them, each long token has an encoding inferred and is
put through a battery of tests for a random string in that encoding: chi-squared uniformity over
its alphabet, runs of character classes against the number that its alphabet lets expect, and
serial correlation of the symbols' places in it. Fisher's sum of the three says how far a
token is from random. How far ordinary matter is, is learned from decoys: a stretch of each
document's own characters in the same encoding and length. By encoding and stratum of lengths (short
tokens prove less) a Benjamini-Hochberg limit over all tokens of the corpus then
bounds the share of ordinary ones among those that are found.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, unused_name

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: What may be a random string: symbols of the usual encodings, with padding.
TOKEN = r"[A-Za-z0-9+/_\x01-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Strata of token lengths by their least length, in symbols.
STRATA = (20, 24, 32, 48, 64, 128, 256)
#: The encodings by name: their symbols in order. base64 is also written with - and _.
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = {
    "hex": "0123456789abcdef", "base32": _UPPER + "234567", "base36": _DIGITS + _LOWER, "base62": _UPPER + _LOWER + _DIGITS, "base64": _UPPER + _LOWER + _DIGITS + "+/",
}
#: Tokens further from random than this are never found: beyond it lie about 3 in 10,000 random strings.
FURTHEST = 30.0
#: A limit's steps, and how ordinary matter is held to be where a corpus has no decoys: log(distance) is about
#: log(symbols) + OFFSET with this deviation, which counts as so many decoys. In prose of 10,000 documents the five encodings'
#: means were 0.35 to 1.5 above log(symbols), with deviations of 0.21 to 0.38.
STEP, OFFSET, DEVIATION, PRIOR = 0.25, 0.35, 0.38, 8
#: Scans over arrays go in two levels, of so many items below; blocks of a text have so many code points.
_CHUNK, _BLOCK, _BLOCKS = 64, 2048, 64
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def bind(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x worked out once and not anew wherever f or a lambda in it names it."""
    return F.transform(F.array(x), f)[0]


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of non-negative integers what combine (a sum or a maximum) makes of those before it, in two levels."""
    zero = lambda: F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda s, v: F.struct(combine(s["at"], v).alias("at"), F.array_append(s["out"], s["at"]).alias("out"))

    def levels(a: Column) -> Column:
        heads = F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0)), F.lit(_CHUNK))
        parts = F.transform(heads, lambda i: F.aggregate(F.slice(a, i + 1, F.lit(_CHUNK)), zero(), step))

        def joined(p: Column) -> Column:
            before = F.aggregate(p, zero(), lambda s, x: step(s, x["at"]), lambda s: s["out"])
            return F.flatten(F.zip_with(p, before, lambda x, b: F.transform(x["out"], lambda v: combine(v, b))))

        return bind(parts, joined)

    return bind(values, levels)


def match_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, token), in code points, end exclusive.

    The stretches between matches and the matches' own lengths add up to the places.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def place(h: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(h)), h, lambda g, t: F.struct(F.length(g).alias("gap"), F.length(t).alias("size"), t.alias("token")))

        def add(p: Column) -> Column:
            before = running(F.transform(p, lambda x: x["gap"] + x["size"]), lambda a, b: a + b)
            start = lambda x, b: b + x["gap"]
            return F.zip_with(p, before, lambda x, b: F.struct(start(x, b).alias("start"), (start(x, b) + x["size"]).alias("end"), x["token"].alias("token")))

        return bind(pairs, add)

    return bind(hits, place)


def _as(kind: int, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def _named(text: Column) -> Column:
    low = F.lower(text)
    out = low.contains(_KEYWORDS[0])
    for word in _KEYWORDS[1:]:
        out = out | low.contains(word)
    return out


def base_spans(text: Column) -> Column:
    """The named patterns' spans by start, then kind; matches that fall short of their length are dropped after matching."""
    none = F.array().cast(_SPANS)
    assign = F.filter(match_spans(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["token"], ASSIGN, 2)) >= 8)
    # a run's later part is never longer than the whole run, so here a bound inside the pattern means the same
    access, hexes = match_spans(text, r"AKIA[A-Z0-9]{12,}"), match_spans(text, r"[0-9a-f]{32,}")
    return F.array_sort(
        F.concat(
            F.when(_named(text), _as(0, assign)).otherwise(none),
            F.when(text.contains("AKIA"), _as(1, access)).otherwise(none),
            F.when(text.rlike(r"[0-9a-f]{32}"), _as(2, hexes)).otherwise(none),
        )
    )


def candidates(text: Column) -> Column:
    """Tokens as (start, end, token) with a digit and a letter or with an inner capital, apart from the base spans.

    Assignments become marks of their length first, and a token that touches one holds a mark;
    the other base spans lie inside tokens.
    """
    plain = F.translate(text, "\x01", "\x02")  # marks of the text's own
    hits = F.regexp_extract_all(plain, F.lit(ASSIGN), F.lit(0))
    long = lambda h: F.length(F.regexp_extract(h, ASSIGN, 2)) >= 8
    marked = lambda h: F.when(long(h), F.repeat(F.lit("\x01"), F.length(h))).otherwise(h)
    between = F.zip_with(F.split(plain, ASSIGN, -1), F.concat(F.transform(hits, marked), F.array(F.lit(""))), lambda g, h: F.concat(g, h))
    masked = F.when(_named(text), F.array_join(between, "")).otherwise(plain)
    mixed = lambda t: (t.rlike("[0-9]") & t.rlike("[A-Za-z]")) | t.rlike("[a-z][A-Z]")  # noqa: E731  # each of them reads a long token once
    base = r"\x01|[0-9a-f]{32}|AKIA[A-Z0-9]{12}"
    found = F.filter(match_spans(masked, TOKEN), lambda s: mixed(s["token"]) & ~s["token"].rlike(base))
    return F.when(text.rlike(r"[A-Za-z0-9+/_-]{20}"), found).otherwise(F.array().cast("array<struct<start:int,end:int,token:string>>"))


def encoding_of(symbols: Column) -> Column:
    """The narrowest encoding that has all symbols."""
    return (
        F.when(symbols.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex").when(symbols.rlike("^[A-Z2-7]+$"), "base32")
        .when(symbols.rlike("^(?:[a-z0-9]+|[A-Z0-9]+)$"), "base36").when(symbols.rlike("^[A-Za-z0-9]+$"), "base62").otherwise("base64")
    )


def upper_tail(z: Column) -> Column:
    """The normal distribution's upper tail, by a closed form that is right to about a tenth of its value."""
    x = F.greatest(F.abs(z), F.lit(1e-3))
    tail = (1 - F.exp(-1.4 * x)) * F.exp(-x * x / 2) / (1.135 * 2.5066282746 * x)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _lookup(key: Column, values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def _classes(alphabet: str) -> tuple[float, float]:
    """By a random string's symbols: the chance that the class (upper, lower, digit, other) changes, and that it does twice in a row."""
    kind = lambda c: 0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 3
    p = [sum(kind(c) == k for c in alphabet) / len(alphabet) for k in range(4)]
    return 1 - sum(x * x for x in p), sum(x * (1 - x) ** 2 for x in p)


_SIZE = {k: float(len(v)) for k, v in ENCODINGS.items()}
_CHANGE = {k: _classes(v)[0] for k, v in ENCODINGS.items()}
_TWICE = {k: _classes(v)[1] for k, v in ENCODINGS.items()}
_TO_CLASS = (_UPPER + _LOWER + _DIGITS + "+/", "A" * 26 + "a" * 26 + "0" * 10 + "++")


def distance(symbols: Column, encoding: Column) -> Column:
    """How far a string is from random in an encoding: -2 times the sum of the logarithms of three p-values.

    They are of Pearson's chi-squared over the alphabet's A symbols (A - 1 degrees of freedom, by Wilson and Hilferty's cube
    root), of the number of runs of classes (too few), and of the lag-one correlation of the symbols' places in the
    alphabet (either sign), each against a random string in this encoding.
    """

    def counted(s: Column) -> Column:
        chars = F.split(s["symbols"], "")
        n = F.length(s["symbols"])
        square = lambda acc, c: acc + F.pow((n - F.length(F.replace(s["symbols"], c, F.lit("")))).cast("double"), F.lit(2.0))
        runs = F.length(F.regexp_replace(F.translate(s["symbols"], *_TO_CLASS), r"(.)\1*", "."))
        places = F.transform(chars, lambda c: F.position(c, s["alphabet"]).cast("double"))
        return F.struct(n.cast("double").alias("n"), s["encoding"].alias("encoding"), F.aggregate(F.array_distinct(chars), F.lit(0.0), square).alias("squares"), runs.cast("double").alias("runs"), places.alias("places"))

    def summed(s: Column) -> Column:
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
        x, n = s["places"], s["n"].cast("int")
        return F.struct(
            s["n"].alias("n"), s["encoding"].alias("encoding"), s["squares"].alias("squares"), s["runs"].alias("runs"), total(x).alias("sum"), total(F.transform(x, lambda v: v * v)).alias("sum2"),
            total(F.zip_with(F.slice(x, F.lit(1), n - 1), F.slice(x, F.lit(2), n - 1), lambda a, b: a * b)).alias("lagged"), x[0].alias("head"), F.element_at(x, -1).alias("tail"),
        )

    def judged(s: Column) -> Column:
        n, size = s["n"], _lookup(s["encoding"], _SIZE)
        df = size - 1
        chi2 = size / n * s["squares"] - n
        uneven = (F.cbrt(chi2 / df) - 1 + 2 / (9 * df)) / F.sqrt(2 / (9 * df))
        q, twice = _lookup(s["encoding"], _CHANGE), _lookup(s["encoding"], _TWICE)
        changes = F.sqrt((n - 1) * q * (1 - q) + 2 * (n - 2) * (twice - q * q))
        few = ((n - 1) * q - (s["runs"] - 1)) / changes
        mean = s["sum"] / n
        across = s["lagged"] - mean * (2 * s["sum"] - s["head"] - s["tail"]) + (n - 1) * mean * mean
        serial = F.abs(across / F.greatest(s["sum2"] - n * mean * mean, F.lit(1e-9)) + 1 / (n - 1)) * F.sqrt(n)
        log = lambda p: F.ln(F.greatest(p, F.lit(1e-300)))
        return -2 * (log(upper_tail(uneven)) + log(upper_tail(few)) + log(F.least(2 * upper_tail(serial), F.lit(1.0))))

    whole = F.struct(symbols.alias("symbols"), encoding.alias("encoding"), _lookup(encoding, ENCODINGS).alias("alphabet"))
    return bind(bind(bind(whole, counted), summed), judged)


def stratum_of(n: Column) -> Column:
    out = F.lit(0)
    for least in STRATA[1:]:
        out = out + (n >= least).cast("int")
    return out


def normal_form(symbols: Column, encoding: Column) -> Column:
    """Symbols as the encoding's alphabet has them."""
    return F.when(encoding == "hex", F.lower(symbols)).when(encoding == "base36", F.lower(symbols)).when(encoding == "base64", F.translate(symbols, "-_", "+/")).otherwise(symbols)


def measured(tokens: Column) -> Column:
    """The candidates as (start, end, encoding, stratum, distance)."""

    def one(s: Column) -> Column:
        whole = F.struct(s["start"].alias("start"), s["end"].alias("end"), F.regexp_replace(s["token"], "=+$", "").alias("symbols"))
        coded = lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["symbols"].alias("symbols"), encoding_of(t["symbols"]).alias("encoding"))
        done = lambda t: F.struct(
            t["start"].alias("start"), t["end"].alias("end"), t["encoding"].alias("encoding"), stratum_of(F.length(t["symbols"])).alias("stratum"),
            distance(normal_form(t["symbols"], t["encoding"]), t["encoding"]).alias("distance"),
        )
        return bind(bind(whole, coded), done)

    return F.transform(tokens, one)


def decoys(text: Column, groups: list[tuple[str, int]]) -> Column:
    """For each group (encoding, stratum) a stretch of a text's own characters as (key, encoding, symbols), at a place given by its hash; null if it has too few.

    Long tokens are left out first, so that secrets have no part in what counts as ordinary.
    """
    kept = {
        "hex": lambda t: F.regexp_replace(F.lower(t), "[^0-9a-f]", ""), "base32": lambda t: F.regexp_replace(F.upper(t), "[^A-Z2-7]", ""), "base36": lambda t: F.regexp_replace(F.lower(t), "[^a-z0-9]", ""),
        "base62": lambda t: F.regexp_replace(t, "[^A-Za-z0-9]", ""), "base64": lambda t: F.regexp_replace(t, "[^A-Za-z0-9]+", "/"),
    }

    def stretch(s: Column, e: str, stratum: int) -> Column:
        n = STRATA[stratum]
        place = F.pmod(F.xxhash64(F.lit(n), s), F.greatest(F.length(s) - n + 1, F.lit(1)).cast("long")).cast("int")
        return F.struct(F.lit(f"{e}:{stratum}").alias("key"), F.lit(e).alias("encoding"), F.when(F.length(s) >= n, F.substring(s, place + 1, F.lit(n))).alias("symbols"))

    def of(t: Column, e: str) -> Column:
        return bind(kept[e](t), lambda s: F.array(*[stretch(s, e, k) for x, k in groups if x == e]))

    return bind(F.regexp_replace(text, r"[A-Za-z0-9+/_-]{20,}", " "), lambda t: F.flatten(F.array(*[of(t, e) for e in sorted({e for e, _ in groups})])))


def limits(found: DataFrame, tokens: str, docs: DataFrame, text: str, q: float) -> dict[str, float]:
    """By encoding and stratum the greatest distance that keeps the share of ordinary tokens under q.

    Tokens and decoys are counted over the whole table; only a histogram (35 groups by 121 steps)
    and three numbers for each of the groups that have tokens come to the driver.
    """
    t = F.col("t")
    key = F.concat_ws(":", t["encoding"], t["stratum"].cast("string"))
    step = F.ceil(F.least(t["distance"], F.lit(FURTHEST + 1)) / STEP).cast("int")
    histogram = found.select(F.explode(tokens).alias("t")).groupBy(key.alias("key"), step.alias("step")).count().collect()
    counts: dict[str, dict[int, int]] = {}
    for r in histogram:
        counts.setdefault(r.key, {})[r.step] = r["count"]
    keys = [k for k in sorted(counts) if min(counts[k]) * STEP <= FURTHEST]
    if not keys:
        return {}
    whole = F.coalesce(F.col(text), F.lit(""))
    groups = [(e, int(k)) for e, _, k in (key.partition(":") for key in keys)]
    drawn = docs.select(F.explode(decoys(whole, groups)).alias("d")).filter("d.symbols IS NOT NULL")
    x = F.ln(F.greatest(distance(F.col("d.symbols"), F.col("d.encoding")), F.lit(1e-3)))
    seen = {r.key: r for r in drawn.select(F.col("d.key").alias("key"), x.alias("x")).groupBy("key").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var")).collect()}
    out = {}
    for k in keys:
        r = seen.get(k)
        n, mean, var = (r.n, r.mean, r.var) if r else (0, 0.0, 0.0)
        prior = math.log(STRATA[int(k.split(":")[1])]) + OFFSET
        centre = (PRIOR * prior + n * mean) / (PRIOR + n)
        spread = math.sqrt((PRIOR * DEVIATION**2 + n * var) / (PRIOR + n))
        m, below = sum(counts[k].values()), 0
        for s in range(int(FURTHEST / STEP) + 1):
            below += counts[k].get(s, 0)
            p = 0.5 * math.erfc((centre - math.log(max(s * STEP, 1e-3))) / spread / math.sqrt(2))
            if below and m * p <= q * below:
                out[k] = s * STEP
    return out


def scan(docs: DataFrame, q: float = 0.01, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs plus `secrets`: an array of (start, kind, end) by start, then kind (an index of KINDS), in code points.

    Null and empty texts have none; a very long text, however dense in secrets, takes time in proportion to its length.
    Every token of the table has a part in the limits, equal distances are found or left together, and repeated rows all count. Other columns and an
    empty table pass through; a column `secrets` is replaced. With keep_text the texts are gone over twice, as
    writing them in between would cost more; without, the text is left out and they are gone over once.
    """
    docs = docs.drop("secrets")
    mark = unused_name(docs, "found")
    whole = F.coalesce(F.col(text), F.lit(""))
    found = docs.withColumn(mark, F.struct(base_spans(whole).alias("base"), measured(candidates(whole)).alias("tokens")))
    if not keep_text:
        found = cut(found.drop(text))
    most = limits(found, f"{mark}.tokens", docs, text, q)

    def added(tokens: Column) -> Column:
        if not most:
            return F.array().cast(_SPANS)
        near = lambda s: F.ceil(s["distance"] / STEP) * STEP <= F.coalesce(_lookup(F.concat_ws(":", s["encoding"], s["stratum"].cast("string")), most), F.lit(-1.0))
        return _as(3, F.filter(tokens, near))

    return found.withColumn(mark, bind(F.col(mark), lambda f: F.array_sort(F.concat(f["base"], added(f["tokens"]))))).withColumnRenamed(mark, "secrets")


def redact(scanned: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The texts with every span of `secrets` replaced; overlapping spans become one mark. Drops `secrets`.

    A text is taken in blocks, and a block with the spans that touch it. Null texts stay null.
    """
    whole = F.col(text)
    fresh = lambda s: F.zip_with(s, running(F.transform(s, lambda x: x["end"]), F.greatest), lambda x, b: F.struct(x["start"].alias("start"), x["end"].alias("end"), (x["start"] >= b).alias("fresh")))
    touching = lambda spans, at, size: F.filter(spans, lambda s: (s["end"] > at) & (s["start"] < at + size))

    def block(piece: Column, at: Column, spans: Column) -> Column:
        zero = F.struct(at.alias("at"), F.array().cast("array<string>").alias("out"))

        def step(state: Column, s: Column) -> Column:
            before = F.substring(piece, state["at"] - at + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
            shown = F.when(s["fresh"] & (s["start"] >= at), F.concat(before, F.lit(mark))).otherwise(before)
            return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.array_append(state["out"], shown).alias("out"))

        done = lambda s: F.concat(F.array_join(s["out"], ""), F.substring(piece, F.least(s["at"] - at, F.lit(_BLOCK)) + 1, F.lit(_BLOCK)))
        return F.aggregate(spans, zero, step, done)

    def blocks(pieces: Column, spans: Column) -> Column:
        size = _BLOCK * _BLOCKS
        heads = F.sequence(F.lit(0), F.greatest(F.size(pieces) - 1, F.lit(0)), F.lit(_BLOCKS))
        few = lambda i, near: F.transform(F.slice(pieces, i + 1, F.lit(_BLOCKS)), lambda p, k: block(p, (i + k) * _BLOCK, touching(near, (i + k) * _BLOCK, _BLOCK)))
        return F.array_join(F.flatten(F.transform(heads, lambda i: bind(touching(spans, i * _BLOCK, size), lambda near: few(i, near)))), "")

    pieces = F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))
    done = bind(fresh(F.col("secrets")), lambda spans: bind(pieces, lambda p: blocks(p, spans)))
    return scanned.withColumn(text, F.when(F.size("secrets") > 0, done).otherwise(whole)).drop("secrets")


def op8(docs: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(k) for k in KINDS])
    show = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    return scan(docs.select("doc_id", "text"), keep_text=False).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(show(base), 256).alias("base_sha256"), show(F.col("secrets")).alias("spans"),
    )


def brute_force(rows: list[tuple[int, str | None]]) -> list[tuple]:
    """What op8 returns but for the method's own spans."""
    import hashlib
    import re

    out = []
    for doc, text in rows:
        found = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text or "") if len(m[2]) >= 8]
        found += [(m.start(), 1, m.end()) for m in re.finditer(ACCESS, text or "") if len(m[0]) >= 16]
        found += [(m.start(), 2, m.end()) for m in re.finditer(HEX, text or "") if len(m[0]) >= 32]
        base = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))
        n = [sum(k == kind for _, k, _ in found) for kind in range(3)]
        out.append((doc, *n, hashlib.sha256(base.encode()).hexdigest()))
    return out
