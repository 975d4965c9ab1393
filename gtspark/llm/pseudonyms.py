"""Format-preserving pseudonyms for personal data, in built-in functions only.

One pass finds e-mail addresses, IPv4 addresses, dates, phone, social security
and payment card numbers; a value that fails its check (octets, calendar,
area and group numbers, Luhn sum) stays as it is.  A valid value is permuted
within its format by a keyed Feistel network over two residues: even rounds
add a keyed hash of the right half to the left modulo ``a``, odd rounds the
other way modulo ``b``, which is a permutation of all ``a * b`` values without
cycle walking.  Equal values get equal pseudonyms in every document, different
values of one format different ones:

* card: all digits but the last, which becomes the Luhn digit; separators stay
* phone: all digits after the country code, which is read from the digits of a
  number with ``+``, so its notations are linked; separators stay.  A number
  without ``+`` has no code and is not linked to one that has
* social security number: area (898 valid ones) and group with serial
* date: the day within the 400 years from 1800 on, in its own notation.  Days up
  to the 12th of a month are permuted among themselves and so are the later
  ones, so a slash date keeps its reading (month-first where it can be) and a
  day has one pseudonym in all notations
* IPv4: the 32 bits as two halves
* e-mail: runs of letters and of digits of the local part and of the first
  domain label, in runs of up to 24 letters or 36 digits; the rest stays

``key`` is the secret of the permutation.  A null text stays null; every row,
also a repeated one or one without an id, is rewritten by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matching import changed, joined, let

KEY = "gtspark pseudonym key"
ROUNDS = 8
KINDS = ("email", "ip", "date", "ssn", "phone", "card")

# fixed values: the formats
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
IP = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d)"
DATE = r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/-]|\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = (r"(?<![\w+])(?:\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)"
         r"|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\d{3}([.-])\d{3}\1\d{4}(?![\d-])"
         r"|\+\d{1,3}[ .-]\d{2,4}(?:[ .-]\d{2,4}){1,3}(?!\d|[.-]\d)|\+\d{8,15}(?!\d))")
CARD = r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])"
ALL = "|".join(f"(?:{p})" for p in (EMAIL, IP, DATE, SSN, PHONE, CARD))

DAY0, DAYS = "1800-01-01", 146097                  # 400 years
EARLY = 12 * 4800                                  # 240 * 240 days up to the 12th of a month
LATE = DAYS - EARLY                                # 9 * 9833 days after it
# fixed values: country calling codes of one and two digits; all others have three
CALLING = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"


def feistel(left: Column, a: Column, right: Column, b: Column, key: str, tweak: str) -> Column:
    """Struct (l, r): the keyed permutation of (left, right) in Z_a x Z_b, as longs."""
    def noise(i, x):
        text = F.concat_ws(":", F.lit(key), F.lit(tweak), i.cast("string"), a.cast("string"), b.cast("string"),
                           x.cast("string"))
        return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")

    def step(acc, i):
        even = i % 2 == 0
        return F.struct(
            F.when(even, (acc["l"] + noise(i, acc["r"]) % a) % a).otherwise(acc["l"]).alias("l"),
            F.when(even, acc["r"]).otherwise((acc["r"] + noise(i, acc["l"]) % b) % b).alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _power(base: int, n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(base ** i).cast("long") for i in range(19 if base == 10 else 13)]), n + 1)


def digits(s: Column, key: str, tweak: str) -> Column:
    """Permuted string of up to 36 digits, same length."""
    n = F.length(s)
    h = F.floor(n / 2).cast("int")

    def number(x):
        return F.coalesce(x.try_cast("long"), F.lit(0).cast("long"))

    out = feistel(number(F.substring(s, F.lit(1), h)), _power(10, h), number(F.substring(s, h + 1, n)),
                  _power(10, n - h), key, tweak)
    return let(out, lambda o: F.concat(
        F.when(h > 0, F.lpad(o["l"].cast("string"), h, F.lit("0"))).otherwise(""),
        F.lpad(o["r"].cast("string"), n - h, F.lit("0"))))


def letters(s: Column, key: str, tweak: str) -> Column:
    """Permuted string of up to 24 lower-case letters, same length."""
    n = F.length(s)
    h = F.floor(n / 2).cast("int")
    base, az = "0123456789abcdefghijklmnop", "abcdefghijklmnopqrstuvwxyz"

    def number(x):
        return F.coalesce(F.conv(F.translate(x, az, base), 26, 10).try_cast("long"), F.lit(0).cast("long"))

    def text(x, k):
        return F.translate(F.lpad(F.lower(F.conv(x.cast("string"), 10, 26)), k, F.lit("0")), base, az)

    out = feistel(number(F.substring(s, F.lit(1), h)), _power(26, h), number(F.substring(s, h + 1, n)),
                  _power(26, n - h), key, tweak)
    return let(out, lambda o: F.concat(F.when(h > 0, text(o["l"], h)).otherwise(""), text(o["r"], n - h)))


def refilled(form: Column, new: Column) -> Column:
    """``form`` with its digits replaced in turn by those of ``new``."""
    chars = F.filter(F.split(form, ""), lambda c: c != "")

    def step(acc, c):
        digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(acc["s"], F.when(digit, F.substring(new, acc["k"], F.lit(1))).otherwise(c)).alias("s"),
                        (acc["k"] + F.when(digit, 1).otherwise(0)).alias("k"))

    return F.aggregate(chars, F.struct(F.lit("").alias("s"), F.lit(1).alias("k")), step, lambda a: a["s"])


def luhn(body: Column) -> Column:
    """The Luhn digit that completes ``body``."""
    rev = F.filter(F.split(F.reverse(body), ""), lambda c: c != "")
    parts = F.transform(rev, lambda c, i: F.when(i % 2 == 0, F.floor(c.cast("int") * 2 / 10) + c.cast("int") * 2 % 10)
                        .otherwise(c.cast("int")))
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x)
    return ((10 - total % 10) % 10).cast("string")


def _only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _card(m: Column, key: str) -> Column:
    def swap(d):
        body = F.substring(d, F.lit(1), F.length(d) - 1)
        ok = luhn(body) == F.substring(d, F.length(d), F.lit(1))
        return F.when(ok, let(digits(body, key, "card"), lambda b: refilled(m, F.concat(b, luhn(b)))))
    return let(_only_digits(m), swap)


def _phone(m: Column, key: str) -> Column:
    code = F.when(m.startswith("+"), F.regexp_extract(_only_digits(m), CALLING, 1)).otherwise("")

    def swap(s):
        own = F.substring(s["d"], F.length(s["c"]) + 1, F.length(s["d"]))
        return refilled(m, F.concat(s["c"], digits(own, key, "phone")))
    return let(F.struct(_only_digits(m).alias("d"), code.alias("c")), swap)


def _ssn(m: Column, key: str) -> Column:
    def swap(s):
        ok = ((s["a"] != 0) & (s["a"] != 666) & (s["a"] < 900) & (s["g"] != 0) & (s["n"] != 0))
        area = F.when(s["a"] > 666, s["a"] - 2).otherwise(s["a"] - 1)
        new = feistel(area, F.lit(898), (s["g"] - 1) * 9999 + s["n"] - 1, F.lit(99 * 9999), key, "ssn")
        return F.when(ok, let(new, lambda o: F.concat_ws(
            "-", F.lpad((o["l"] + F.when(o["l"] >= 665, 2).otherwise(1)).cast("string"), 3, "0"),
            F.lpad((F.floor(o["r"] / 9999) + 1).cast("string"), 2, "0"),
            F.lpad((o["r"] % 9999 + 1).cast("string"), 4, "0"))))
    p = F.split(m, "-")
    return let(F.struct(*[p[i].cast("int").alias(c) for i, c in enumerate("agn")]), swap)


def _number(d: Column) -> Column:
    return F.date_diff(d, F.lit(DAY0).cast("date"))


def _month(i: Column) -> Column:
    """First day of the i-th month from 1800 on."""
    return F.make_date((F.lit(1800) + F.floor(i / 12)).cast("int"), (F.pmod(i, F.lit(12)) + 1).cast("int"), F.lit(1))


def _late_before(i: Column) -> Column:
    """Days after a 12th before the i-th month."""
    return _number(_month(i)) - i * 12


def _late_day(k: Column) -> Column:
    """The k-th day that comes after the 12th of its month: its month is within two of the average one."""
    near = F.floor(k * 4800 / LATE).cast("int")
    months = F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda j: F.greatest(F.lit(0), F.least(F.lit(4799), near + j)))
    month = F.array_max(F.filter(months, lambda i: _late_before(i) <= k))
    return let(month, lambda i: F.date_add(_month(i), (k - _late_before(i) + 12).cast("int")))


def _date(m: Column, key: str) -> Column:
    def swap(s):
        d, pattern = s["d"], s["f"]
        day = _number(d)
        month = (F.year(d) - 1800) * 12 + F.month(d) - 1
        nth = month * 12 + F.dayofmonth(d) - 1
        new = feistel(F.floor(nth / 240), F.lit(240), nth % 240, F.lit(240), key, "early day")
        early = let(new, lambda o: let(o["l"] * 240 + o["r"], lambda k: F.date_add(
            _month(F.floor(k / 12)), (k % 12).cast("int"))))
        kth = _late_before(month) + F.dayofmonth(d) - 13
        new = feistel(F.floor(kth / 9833), F.lit(9), kth % 9833, F.lit(9833), key, "late day")
        late = let(new, lambda o: let(o["l"] * 9833 + o["r"], _late_day))
        moved = F.when(F.dayofmonth(d) <= 12, early).otherwise(late)

        def shown(x):
            out = F.lit(None).cast("string")
            for p in ("yyyy-MM-dd", "MM/dd/yyyy", "M/d/yyyy", "dd/MM/yyyy", "d/M/yyyy", "dd.MM.yyyy", "d.M.yyyy"):
                out = F.when(pattern == p, F.date_format(x, p)).otherwise(out)
            return out
        return F.when((day >= 0) & (day < DAYS), let(moved, shown))

    def parsed(a, b, c):
        return F.try_to_timestamp(F.concat_ws("-", a, F.lpad(b, 2, "0"), F.lpad(c, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")

    slash, dot = F.split(m, "/"), F.split(m, r"\.")
    padded = m.rlike(r"^\d{2}.\d{2}.")
    us = F.when(m.contains("/"), parsed(slash[2], slash[0], slash[1]))
    eu = F.when(m.contains("/"), parsed(slash[2], slash[1], slash[0]))
    iso = F.when(m.contains("-"), F.try_to_timestamp(m, F.lit("yyyy-MM-dd")).cast("date"))
    mid = F.when(m.contains("."), parsed(dot[2], dot[1], dot[0]))
    form = (F.when(m.contains("-"), "yyyy-MM-dd")
            .when(us.isNotNull(), F.when(padded, "MM/dd/yyyy").otherwise("M/d/yyyy"))
            .when(m.contains("/"), F.when(padded, "dd/MM/yyyy").otherwise("d/M/yyyy"))
            .otherwise(F.when(padded, "dd.MM.yyyy").otherwise("d.M.yyyy")))
    return let(F.struct(F.coalesce(iso, us, eu, mid).alias("d"), form.alias("f")), swap)


def _ip(m: Column, key: str) -> Column:
    def swap(o):
        ok = (o["a"] < 256) & (o["b"] < 256) & (o["c"] < 256) & (o["d"] < 256)
        half = F.lit(65536)
        new = feistel(o["a"] * 256 + o["b"], half, o["c"] * 256 + o["d"], half, key, "ip")
        return F.when(ok, let(new, lambda x: F.concat_ws(
            ".", *[v.cast("string") for h in ("l", "r") for v in (F.floor(x[h] / 256), x[h] % 256)])))
    p = F.split(m, r"\.")
    return let(F.struct(*[p[i].cast("int").alias(c) for i, c in enumerate("abcd")]), swap)


def _email(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, r"^([^@]*@[^.]*)", 1)
    runs = F.regexp_extract_all(head, F.lit("[a-z]{1,24}|[A-Z]{1,24}|[0-9]{1,36}|[^A-Za-z0-9]+"), F.lit(0))
    new = F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), digits(r, key, "email"))
                      .when(r.rlike("^[a-z]"), letters(r, key, "email"))
                      .when(r.rlike("^[A-Z]"), F.upper(letters(F.lower(r), key, "email"))).otherwise(r))
    return F.concat(F.array_join(new, ""), F.substring(m, F.length(head) + 1, F.length(m)))


def pseudonym(m: Column, key: str) -> Column:
    """Struct (kind, value) of one match; kind is null where the value stays."""
    makers = (_email, _ip, _date, _ssn, _phone, _card)
    tests = (r"@", r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$", f"^{DATE}$", f"^{SSN}$", f"^{PHONE}$", r"^\d")
    kind = F.lit(None).cast("string")
    for name, test in reversed(list(zip(KINDS, tests))):
        kind = F.when(m.rlike(test), name).otherwise(kind)
    value = F.lit(None).cast("string")

    def by_kind(k):
        out = value
        for name, make in zip(KINDS, makers):
            out = F.when(k == name, make(m, key)).otherwise(out)
        return let(out, lambda v: F.struct(F.when(v.isNotNull(), k).alias("kind"), F.coalesce(v, m).alias("value")))

    return let(kind, by_kind)


def pseudonymised(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with ``text`` rewritten and __kinds, the kinds of the changed values."""
    text = F.col("text").cast("string")
    df = docs.withColumn("__new", changed(text, ALL, lambda m: pseudonym(m, key)))
    values = F.transform(F.col("__new"), lambda x: x["value"])
    df = df.withColumn("text", joined(text, ALL, values))
    kinds = F.filter(F.transform(F.col("__new"), lambda x: x["kind"]), lambda k: k.isNotNull())
    return df.withColumn("__kinds", F.coalesce(kinds, F.array().cast("array<string>"))).drop("__new")


def report(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, the rewritten text and the number of pseudonyms of each kind, for every document."""
    out = pseudonymised(docs.select("doc_id", "text"), key)
    return out.select("doc_id", "text", *[_count(n) for n in KINDS])


def _count(kind: str) -> Column:
    return F.size(F.filter("__kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
