import re

from helpers import corpus, documents
from pyspark.sql import functions as F

from gtspark.llm import pseudonyms as P

SSN, CARD = "123-45-6789", "4111111111111111"
TEXTS = [
    "mail une.92@mail6.example.com and 129.38.82.176. Call +1 (555) 555-7713 129.38.82.176 now",
    f"card {CARD} and 4111 1111 1111 1111, bad 4111111111111112 id 12345",
    f"ssn {SSN} 000-12-3456 born 1985-03-31 or 3/31/1985, 31.12.1999 and 31/12/1999 99/99/9999 2023-02-30",
    "x 1.2.3.4.5 999.1.1.1 +44 20 7946 0958 129.38.82.176 (555) 123-4567 555-123-4567",
    None, "", "  ", "é日本 A.b-C+d@X9.co.uk 𝄞 une.92@mail6.example.com", "0.0.0.0 255.255.255.255 1.1.1.1",
    "token = \"b64b244acde2e3b0aa8f1234567890123456\" 7844238401328224a", f"{CARD} " * 300, "a@b.co", "1800-01-01 2199-12-31 1799-12-31",
    "plain words only, 3 of 4 in 2024.",
]


def luhn_ok(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def shape(s):
    return re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", s)))


def rewrite(spark, texts, **kw):
    return {r.doc_id: r for r in P.report(documents(spark, texts, extra="kind value __new n_ip"), **kw).collect()}


def test_formats_validity_and_linking(spark):
    got = rewrite(spark, TEXTS)
    assert len(got) == len(TEXTS)
    t = {i: got[i].text for i in got}
    assert t[4] is None and t[5] == "" and t[6] == "  " and t[13] == TEXTS[13] and t[9] == TEXTS[9]
    assert (got[0].n_email, got[0].n_ip, got[0].n_phone) == (1, 2, 1)
    ips = re.findall(r"\d+\.\d+\.\d+\.\d+", t[0])
    assert ips[0] == ips[1] != "129.38.82.176" and ips[0] in t[3]                # linked within and across documents
    assert all(0 <= int(o) < 256 for x in (ips[0], *t[8].split()) for o in x.split("."))
    email = re.search(r"\S+@\S+", t[0])[0]
    assert email in t[7] and shape(email) == shape("une.92@mail6.example.com") and email.endswith(".example.com")
    assert shape(t[7].split()[1]) == shape("A.b-C+d@X9.co.uk")
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4} ", t[0]) and "555-7713" not in t[0]
    a, b = re.search(r"card (\d{16}) and (\d{4} \d{4} \d{4} \d{4}),", t[1]).groups()
    assert a == b.replace(" ", "") != CARD and luhn_ok(a) and "bad 4111111111111112 id 12345" in t[1]
    assert set(t[10].split()) == {a} and got[10].n_card == 300
    assert "000-12-3456" in t[2] and "99/99/9999 2023-02-30" in t[2] and SSN not in t[2]
    iso, us = re.search(r"born (\d{4}-\d\d-\d\d) or (\d+/\d+/\d{4})", t[2]).groups()
    y, m, d = map(int, iso.split("-"))
    assert us == f"{m}/{d}/{y}"                                                  # one day in two notations
    eu, slash = re.search(r", (\d\d\.\d\d\.\d{4}) and (\d\d/\d\d/\d{4})", t[2]).groups()
    assert eu.replace(".", "/") == slash
    assert (got[2].n_date, got[2].n_ssn, got[3].n_phone, got[3].n_ip) == (4, 1, 3, 1)
    assert t[12].endswith("1799-12-31") and got[12].n_date == 2


def test_permutations_are_one_to_one_and_keyed(spark):
    ips = [f"10.0.{i // 250}.{i % 250}" for i in range(700)]
    days = [f"{1950 + i // 336}-{i // 28 % 12 + 1:02d}-{i % 28 + 1:02d}" for i in range(700)]
    ssns = [f"{i % 665 + 1:03d}-{i % 99 + 1:02d}-{i + 1:04d}" for i in range(700)]
    mails = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}{i}@h{i % 7}.org" for i in range(600)]
    for values in (ips, days, ssns, mails):
        one, two = ([r.text for r in rewrite(spark, values, key=k).values()] for k in ("k", "other"))
        assert len(set(one)) == len(values) and len(set(two)) == len(values)
        assert sum(a == b for a, b in zip(one, two)) <= 3
    for s in [r.text for r in rewrite(spark, ssns, key="k").values()]:
        a, g, n = map(int, s.split("-"))
        assert 0 < a < 900 and a != 666 and 0 < g and 0 < n


def test_small_domain_is_a_permutation(spark):
    df = spark.range(20 * 15).select(P.feistel(F.floor(F.col("id") / 15), F.lit(20), F.col("id") % 15, F.lit(15), "k", "t").alias("o"))
    assert df.select("o.*").distinct().count() == 300
    assert tuple(df.agg(F.min("o.l"), F.max("o.l"), F.min("o.r"), F.max("o.r")).first()) == (0, 19, 0, 14)
    d2 = spark.range(100).select(P.digits(F.lpad(F.col("id").cast("string"), 2, "0"), "k", "t").alias("d"))
    assert d2.distinct().count() == 100


def test_clean_texts_nulls_empty_table_and_plan(spark):
    texts = corpus(groups=2)
    got = rewrite(spark, texts)
    assert all(got[i].text == t for i, t in enumerate(texts))
    out = P.report(documents(spark, [TEXTS[0]] * 2, [None, None]))
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())
    a, b = out.collect()
    assert a == b and a.n_ip == 2
    assert P.report(documents(spark, [])).count() == 0


def test_every_date_of_every_notation_is_one_to_one_and_stays_readable(spark):
    """All 234,594 slash dates (month-first, else day-first), all ISO and all dotted ones."""
    day = "date_add(DATE'1800-01-01', cast(id AS int))"
    days = spark.range(146097)
    forms = {"iso": days.selectExpr(f"date_format({day}, 'yyyy-MM-dd') AS s"),
             "dot": days.selectExpr(f"date_format({day}, 'dd.MM.yyyy') AS s"),
             "slash": days.selectExpr(f"date_format({day}, 'MM/dd/yyyy') AS s").union(
                 days.where(f"dayofmonth({day}) > 12").selectExpr(f"date_format({day}, 'dd/MM/yyyy') AS s"))}
    for name, rows in forms.items():
        n = rows.count()
        assert n == (234594 if name == "slash" else 146097)
        out = rows.repartition(8).select("s", P._date(F.col("s"), "k").alias("t"))
        first, second = F.substring("t", 1, 2).cast("int"), F.substring("t", 4, 2).cast("int")
        late = F.substring("s", 1, 2).cast("int") > 12
        kept = (first > 12) & (second <= 12) if name == "slash" else F.lit(True)
        month_first = (first <= 12) if name == "slash" else F.lit(True)
        r = out.agg(F.count_distinct("t").alias("n"), F.count_if(F.col("t") == F.col("s")).alias("same"),
                    F.count_if(F.when(late, kept).otherwise(month_first) if name == "slash" else kept).alias("ok"),
                    F.count_if(F.length("t") == 10).alias("long")).first()
        assert (r["n"], r["ok"], r["long"]) == (n, n, n) and r["same"] < 20, name


def test_phone_notations_are_linked(spark):
    t = [r.text for r in P.report(documents(spark, ["+1 555-555-7713 or +15555557713 or +1 (555) 555-7713",
                                                    "+44 20 7946 0958, +442079460958", "+353 86 123 4567 +353861234567"]))
         .orderBy("doc_id").collect()]
    numbers = [re.findall(r"\+[\d ()-]*\d", x) for x in t]
    for own, code in zip(numbers, ("1", "44", "353")):
        bare = {re.sub(r"\D", "", x) for x in own}
        assert len(own) > 1 and len(bare) == 1 and bare.pop().startswith(code), own
