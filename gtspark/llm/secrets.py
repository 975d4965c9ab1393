"""Secret scan with a battery of randomness tests, in built-in functions only.

Base spans come from three fixed patterns.  The battery adds spans of kind
``random``: tokens of key characters that hold letters and digits, whose
encoding (hex, base 32, lower-case letters and digits, base 64) is the
smallest alphabet that fits, and which carry at least ``BITS`` bits.  ``=`` ends
a token and belongs to it only as trailing padding, so the key of NAME=key is a
token.  A run that mixes the signs of both base-64 forms is cut at either pair.
Names and paths before or after a key share its run: each token is also tried
without the segments before its first (and after its last) one of eight or more
characters that has letters and digits, and its parts between signs where a
smaller alphabet holds them.  Of nested spans the widest stays.  Each
token is tested three ways for being uniform over its alphabet:

* chi-squared of its symbol counts (cube-root normal form, two-sided),
* number of runs above and below the middle of the alphabet,
* lag-one serial correlation of the symbol values.

The tests of all tokens of a text go through one step-up procedure
(Benjamini-Hochberg at ``RATE``) whose p-values are divided by weights in
proportion to token length, since longer tokens have more power.  A token
none of whose tests rejects is a span, unless a base span covers it.

A null text is an empty one; every row, also a repeated one or one without an
id, gives one result row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matching import distinct_sorted, let, placed, running

# fixed values: the base patterns
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
KINDS = ("assign", "access", "hex", "random")

_PAD = r"(?:=++(?![A-Za-z0-9+/_-]))?+"
STANDARD = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{16,}+" + _PAD
URL_SAFE = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+" + _PAD
PLAIN = r"(?<![A-Za-z0-9])[A-Za-z0-9]{16,}+" + _PAD
SEGMENT = r"(?<![A-Za-z0-9])(?=[A-Za-z0-9]{8})(?:[A-Za-z]++[0-9]|[0-9]++[A-Za-z])"
LEAST = 20                       # characters of a token with its padding
BITS, RATE = 96.0, 0.05
ALPHABETS = (("0123456789abcdef", 4.0), ("0123456789ABCDEF", 4.0), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 5.0),
             ("abcdefghijklmnopqrstuvwxyz0123456789", 5.17),
             ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 6.0),
             ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 6.0))


def _alphabet(token: Column) -> Column:
    """Struct (symbols, bits) of the smallest alphabet that holds the token; null if none does."""
    out = F.lit(None).cast("struct<symbols:string,bits:double>")
    for symbols, bits in reversed(ALPHABETS):
        fits = F.translate(token, symbols, "") == ""
        out = F.when(fits, F.struct(F.lit(symbols).alias("symbols"), F.lit(bits).alias("bits"))).otherwise(out)
    return out


def _two_sided(z: Column) -> Column:
    """P(|Z| >= |z|), logistic form of the normal tail."""
    a = F.least(F.abs(z), F.lit(8.0))
    return F.lit(2.0) / (F.lit(1.0) + F.exp(a * 1.5976 + a * a * a * 0.07056))


def battery(token: Column, symbols: Column) -> Column:
    """Array of the three p-values of a token under uniformity over its alphabet."""
    n, k = F.length(token).cast("double"), F.length(symbols).cast("double")
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    values = F.transform(chars, lambda c: F.position(c, symbols).cast("double") - 1)
    squares = F.aggregate(
        F.filter(F.split(symbols, ""), lambda c: c != ""), F.lit(0.0),
        lambda acc, c: acc + F.pow((n - F.length(F.replace(token, c))).cast("double"), F.lit(2.0)))
    chi, df = squares * k / n - n, k - 1
    z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - F.lit(2.0) / (9 * df))) / F.sqrt(F.lit(2.0) / (9 * df))

    def one(v):
        high = F.when(v >= k / 2, 1.0).otherwise(0.0)
        return high, v - (k - 1) / 2

    def step(acc, v):
        high, x = one(v)
        return F.struct((acc["up"] + high).alias("up"),
                        (acc["runs"] + F.when(acc["last"] == high, 0.0).otherwise(1.0)).alias("runs"),
                        high.alias("last"), (acc["xx"] + x * x).alias("xx"),
                        (acc["xy"] + acc["prev"] * x).alias("xy"), x.alias("prev"))

    zero = F.struct(*[F.lit(v).alias(c) for c, v in (("up", 0.0), ("runs", 0.0), ("last", -1.0), ("xx", 0.0),
                                                     ("xy", 0.0), ("prev", 0.0))])

    def finish(a):
        up, down = a["up"], n - a["up"]
        mean = 2 * up * down / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = F.when(var > 0, (a["runs"] - mean) / F.sqrt(F.greatest(var, F.lit(1e-9)))).otherwise(8.0)
        serial = F.when(a["xx"] > 0, a["xy"] / F.greatest(a["xx"], F.lit(1e-9)) * F.sqrt(n)).otherwise(8.0)
        return F.array(_two_sided(runs), _two_sided(serial))

    return F.concat(F.array(_two_sided(z_chi)), F.aggregate(values, zero, step, finish))


def _token(start: Column, end: Column, value: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), value.alias("value"))


def _without_names(tokens: Column) -> Column:
    """The tokens, and each without the name or path before it, and without those before and after it."""
    def head(t):
        skip = F.greatest(F.regexp_instr(t["value"], F.lit(SEGMENT)) - 1, F.lit(0))
        return _token(t["start"] + skip, t["end"], F.substr(t["value"], skip + 1))

    def tail(t):
        skip = F.greatest(F.regexp_instr(F.reverse(t["value"]), F.lit(SEGMENT)) - 1, F.lit(0))
        size = F.length(t["value"]) - skip
        end = F.when(skip > 0, t["start"] + size).otherwise(t["end"])
        return _token(t["start"], end, F.substr(t["value"], F.lit(1), size))

    return let(F.transform(tokens, head), lambda h: F.concat(tokens, h, F.transform(h, tail)))


def _candidates(text: Column) -> Column:
    """(start, end, value) of the tokens of a text, padding only in the span."""
    def bare(found):
        return F.transform(found, lambda t: _token(t["start"], t["end"], F.rtrim(t["value"], F.lit("="))))

    whole = let(bare(F.concat(placed(text, STANDARD), placed(text, URL_SAFE))), _without_names)
    parts = F.filter(bare(placed(text, PLAIN)), lambda t: _alphabet(t["value"])["bits"] < 6)
    return distinct_sorted(F.filter(F.concat(whole, parts), lambda t: t["end"] - t["start"] >= LEAST))


def _uncovered(spans: Column, covers: Column) -> Column:
    """The ``spans`` that lie in none of ``covers``, in order; both are arrays of (start, end).

    Sorted by start and falling end, covers first, a span lies in one before it
    exactly when the greatest end before reaches its own.
    """
    def marked(items, own):
        return F.transform(items, lambda x: F.struct(x["start"].cast("int").alias("start"), (-x["end"]).cast("int").alias("back"),
                                                     F.lit(own).alias("own")))

    def clear(both):
        ends = F.transform(both, lambda x: F.when(x["own"] == 0, -x["back"]).otherwise(-1))
        reach = running(ends, F.lit(-1), lambda a, b: F.greatest(a, b))
        return let(reach, lambda r: F.transform(F.filter(
            F.transform(both, lambda x, i: F.struct(x.alias("x"), F.get(r, i).alias("r"))),
            lambda y: (y["x"]["own"] == 1) & (y["r"] < -y["x"]["back"])), lambda y: F.struct(
                y["x"]["start"].alias("start"), (-y["x"]["back"]).alias("end"))))

    return let(F.array_sort(F.concat(marked(spans, 1), marked(covers, 0))), clear)


def _widest(spans: Column) -> Column:
    """The spans (different ones) that lie in no other."""
    def sure(both):
        reach = running(F.transform(both, lambda x: -x["back"]), F.lit(-1), lambda a, b: F.greatest(a, b))
        return let(reach, lambda r: F.transform(F.filter(
            F.transform(both, lambda x, i: F.struct(x.alias("x"), F.get(r, i).alias("r"))),
            lambda y: y["r"] < -y["x"]["back"]), lambda y: F.struct(
                y["x"]["start"].alias("start"), (-y["x"]["back"]).alias("end"))))

    order = F.transform(spans, lambda x: F.struct(x["start"].cast("int").alias("start"), (-x["end"]).cast("int").alias("back")))
    return let(F.array_sort(order), sure)


def _tested(cut: Column) -> Column:
    """(start, end, n, p) of the tokens that can be tested, from (start, end, value)."""
    mixed = F.filter(cut, lambda t: t["value"].rlike("[0-9]") & t["value"].rlike("[A-Za-z]"))
    known = F.transform(mixed, lambda t: F.struct(
        t["start"].alias("start"), t["end"].alias("end"), t["value"].alias("value"), _alphabet(t["value"]).alias("code")))
    long = F.filter(known, lambda t: t["code"].isNotNull() & (F.length(t["value"]) * t["code"]["bits"] >= BITS))
    return F.transform(long, lambda t: F.struct(
        t["start"].alias("start"), t["end"].alias("end"), F.length(t["value"]).cast("double").alias("n"),
        battery(t["value"], t["code"]["symbols"]).alias("p")))


def _accepted(tested: Column) -> Column:
    """Step-up over all tests of a text: tokens without a rejected test."""
    def weigh(t):
        mean = F.aggregate(t, F.lit(0.0), lambda a, x: a + x["n"]) / F.size(t)
        return let(mean, lambda m: F.transform(t, lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"),
            F.transform(x["p"], lambda p: p * m / x["n"]).alias("p"))))

    def step_up(t):
        limit = let(F.array_sort(F.flatten(F.transform(t, lambda x: x["p"]))), lambda ps: F.array_max(F.transform(
            ps, lambda p, i: F.when(p <= RATE * (i + 1) / F.size(ps), p).otherwise(-1.0))))
        return let(limit, lambda top: F.filter(t, lambda x: F.array_min(x["p"]) > top))

    return let(let(tested, weigh), step_up)


def _spans(kind: str, found: Column) -> Column:
    order = KINDS.index(kind)
    return F.transform(found, lambda x: F.struct(
        x["start"].alias("start"), F.lit(order).alias("order"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with __base and __all: arrays of (start, order, end, kind) by start, then kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    group = F.lit(2)
    df = docs.withColumn("__text", text)
    t = F.col("__text")
    value = F.regexp_extract_all(t, F.lit(ASSIGN), group)
    long = F.filter(F.arrays_zip(placed(t, ASSIGN).alias("s"), value.alias("v")), lambda x: F.length(x["v"]) >= 8)
    assign = F.when(t.rlike(ASSIGN), F.transform(long, lambda x: x["s"])).otherwise(
        F.array().cast("array<struct<start:int,end:int,value:string>>"))
    df = df.withColumn("__base", F.array_sort(F.concat(
        _spans("assign", assign), _spans("access", placed(t, ACCESS)), _spans("hex", placed(t, HEX)))))
    found = let(_tested(_candidates(t)), lambda x: F.when(F.size(x) > 0, let(_accepted(x), _widest)))

    def add(base):
        free = let(found, lambda x: _uncovered(x, base))
        return F.when(t.rlike(STANDARD) | t.rlike(URL_SAFE), F.array_sort(F.concat(base, F.coalesce(_spans("random", free), F.slice(base, 1, 0))))
                      ).otherwise(base)

    return df.withColumn("__all", let(F.col("__base"), add)).drop("__text")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_random for every document."""
    found = find_secrets(docs.select("doc_id", "text"))

    def count(kind):
        return F.size(F.filter("__all", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(_listed(F.col("__base")), 256).alias("base_sha256"),
                        _listed(F.col("__all")).alias("spans"), count("random"))
