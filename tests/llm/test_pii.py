import random
import re

import pytest
from pyspark.sql import functions as F

from quillmark.llm import pii


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(re.sub(r"\D", "", digits))):
        n = int(c) * (2 if k % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def card(rng):
    body = "".join(rng.choice("0123456789") for _ in range(15))
    return next(body + c for c in "0123456789" if luhn(body + c))


def rewritten(spark, texts, key="k"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in pii.pseudonymise(df, key).orderBy("doc_id").collect()]


@pytest.mark.parametrize(("sql", "size"), [("lpad(cast(id as string), 3, '0')", 1000), ("concat(char(97 + cast(id / 26 as int)), char(97 + id % 26))", 676)])
def test_permutation_is_one_to_one(spark, sql, size):
    df = spark.range(size).select(F.expr(sql).alias("v"))
    out = df.select(pii.permuted(F.col("v"), "k", "x").alias("p"))
    assert out.distinct().count() == size
    assert set(map(tuple, out.collect())) == set(map(tuple, df.collect()))


def test_dates_are_permuted_among_valid_dates(spark):
    days = spark.range(0, 73049).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d")).sample(0.03, 5)
    out = days.select("d", pii._new_date(F.col("d"), "k").alias("p")).collect()
    assert len({r.p for r in out}) == len(out)
    assert all(re.fullmatch(r"(19|20)\d\d-\d\d-\d\d", r.p) for r in out)


def test_formats_and_links(spark):
    rng = random.Random(2)
    number = card(rng)
    spaced = " ".join(number[k : k + 4] for k in range(0, 16, 4))
    got = rewritten(spark, [f"pay {number} now", f"or {spaced}!", "Ann.Lee.7@mail1.example.com", "ann.lee.7@mail1.example.com", "at 10.20.30.40 on 2020-02-29 or 31.12.1999", "call +1 (017) 555-7713 or (017) 555-7713", "ssn 123-45-6789"])
    texts = [r.text for r in got]
    new = re.search(r"\d{16}", texts[0])[0]
    assert luhn(new) and new != number
    assert re.search(r"(\d{4} ){3}\d{4}", texts[1])[0].replace(" ", "") == new
    assert texts[2].lower() == texts[3] and texts[2][0].isupper() and texts[3] != "ann.lee.7@mail1.example.com"
    assert re.fullmatch(r"at (\d{1,3}\.){3}\d{1,3} on \d{4}-\d\d-\d\d or \d\d\.\d\d\.\d{4}", texts[4])
    assert re.fullmatch(r"call \+\d \(\d{3}\) \d{3}-\d{4} or \(\d{3}\) \d{3}-\d{4}", texts[5])
    assert re.fullmatch(r"ssn \d{3}-\d\d-\d{4}", texts[6]) and "123-45-6789" not in texts[6]
    assert [r.n_pii for r in got] == [1, 1, 1, 1, 3, 2, 1]
    assert [r.text for r in rewritten(spark, ["pay " + number], "other")] != [texts[0][: len("pay ") + 16]]


def test_equal_values_stay_equal_and_different_ones_different(spark):
    rng = random.Random(4)
    cards = [card(rng) for _ in range(200)]
    out = [r.text for r in rewritten(spark, cards + cards)]
    assert out[:200] == out[200:] and len(set(out)) == len(set(cards)) and all(map(luhn, out))


def test_what_is_no_valid_value_stays(spark):
    texts = ["4111111111111112", "2024-02-30", "version 1.2.3.4.5", "v1.2.3.4", "300.1.1.1", "000-12-3456", "id 12345678", "a@b", "0123456789abcdef0123", "x4111111111111111", "", None]
    assert [r.text for r in rewritten(spark, texts)] == texts


def test_planted_values_are_gone_and_the_rest_stays(spark, small):
    from quillmark.llm.queries import op9_pii

    found = {r.doc_id: r for r in op9_pii(spark, small).collect()}
    patterns = (r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])", r"\+1 \(\d{3}\) \d{3}-\d{4}", r"(?<![0-9A-Za-z])\d{16}(?![0-9A-Za-z])")
    some = 0
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        values = [v for p in patterns for v in re.findall(p, r.text) if len(v) != 16 or not v.isdigit() or luhn(v)]
        some += len(values)
        assert not [v for v in values if v in found[r.doc_id].text], r.doc_id
        if not values:
            assert found[r.doc_id].text == r.text
    assert some > 5


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = pii.pseudonymise(df, "k")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_odd_rows(spark, odd, empty):
    out = pii.pseudonymise(odd.withColumn("n_pii", F.lit("clash")), "k")
    rows = {(r.doc_id): r for r in out.collect()}
    assert rows[2].text is None and rows[4].text == "" and rows[6].text == odd.where("doc_id = 6").first().text
    assert out.count() == odd.count() and pii.pseudonymise(empty, "k").count() == 0


def plain_stream(key, kind, r, n, other):
    import hashlib

    return hashlib.sha512(f"{key}:{kind}:{r}:{n}:{other}".encode()).hexdigest()


def plain_permuted(text, key, kind):
    """A second Feistel network, character by character."""
    n, (a, b) = len(text), (text[: len(text) // 2], text[len(text) // 2 :])
    for r in range(1, pii.ROUNDS + 1):
        stream, moved = plain_stream(key, kind, r, n, b), ""
        for i, c in enumerate(a):
            k = int(stream[i % 32 * 4 : i % 32 * 4 + 4], 16)
            moved += chr((ord(c) - 48 + k) % 10 + 48) if c.isdigit() else chr((ord(c) - 97 + k) % 26 + 97) if "a" <= c <= "z" else c
        a, b = b, moved
    return a + b


def plain_date(text, key):
    import datetime

    first = datetime.date(1900, 1, 1)
    forms = {"-": "%Y-%m-%d", ".": "%d.%m.%Y", "/": "%m/%d/%Y" if int(text[:2]) <= 12 else "%d/%m/%Y"}
    form = forms["-" if text[4] == "-" else text[2]]
    day = (datetime.datetime.strptime(text, form).date() - first).days
    while True:
        a, b = divmod(day, 270)
        for r in range(1, pii.ROUNDS + 1):
            word = int(plain_stream(key, "date", r, 73049, b if r % 2 else a)[:4], 16)
            a, b = ((a + word) % 271, b) if r % 2 else (a, (b + word) % 270)
        day = a * 270 + b
        if day < 73049:
            date = first + datetime.timedelta(days=day)
            if form != "%d/%m/%Y" or date.day > 12:
                return date.strftime(form)


def mod97(text):
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def iban(rng):
    body = "DE00" + "".join(rng.choice("0123456789") for _ in range(18))
    return f"DE{98 - mod97(body):02d}" + body[4:]


def test_values_equal_a_plain_network(spark):
    rng = random.Random(7)
    ssn = [f"{rng.choice([1, 200, 665, 667, 899]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}" for _ in range(150)]
    dates = [*(f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}" for _ in range(30)), *(f"{rng.randint(13, 28)}/{rng.randint(1, 12):02d}/1980" for _ in range(60)), "12/25/1980", "31.12.1999"]
    phones = ["+1 (017) 555-7713", "(017) 555-7713", "555 123 4567", "0049 30 123456", "+4930123456"]
    ibans = [iban(rng) for _ in range(20)] + ["GB82 WEST 1234 5698 7654 32"]
    got = [r.text for r in rewritten(spark, [*ssn, *dates, *phones, *ibans, "at 1980-12-25T10:00:00Z", "mail a.b9@x.org"])]
    bare = lambda t: re.sub(r"\D", "", t)
    for old, new in zip(ssn, got, strict=False):
        want = bare(old)
        while True:
            want = plain_permuted(want, "k", "ssn")
            if not re.search(r"^(000|666|9)|^\d{3}00|0000$", want):
                break
        assert bare(new) == want and re.fullmatch(r"\d{3}-\d\d-\d{4}", new)
    assert len(set(got[:150])) == len(set(ssn))
    got = got[150:]
    assert got[: len(dates)] == [plain_date(d, "k") for d in dates]
    got = got[len(dates) :]
    national = {"0175557713": plain_permuted("0175557713", "k", "phone"), "5551234567": plain_permuted("5551234567", "k", "phone"), "30123456": plain_permuted("30123456", "k", "phone")}
    assert [bare(t) for t in got[:5]] == ["1" + national["0175557713"], national["0175557713"], national["5551234567"], "0049" + national["30123456"], "49" + national["30123456"]]
    assert re.fullmatch(r"0049 \d\d \d{6}", got[3])
    got = got[5:]
    for old, new in zip(ibans, got, strict=False):
        o, n = old.replace(" ", ""), new.replace(" ", "")
        assert mod97(n) == 1 and n[:2] == o[:2] and n[4:] == plain_permuted(o[4:].lower(), "k", "iban").upper() and len(old) == len(new)
    assert got[len(ibans)] == f"at {plain_date('1980-12-25', 'k')}T10:00:00Z"
    assert got[len(ibans) + 1] == f"mail {plain_permuted('a.b9', 'k', 'mail')}@x.org"


def test_no_plan_shows_the_key(spark):
    df = spark.createDataFrame([(1, "pay 4111111111111111")], "doc_id long, text string")
    out = pii.pseudonymise(df, "hush-hush-key")
    out.collect()
    query = out._jdf.queryExecution()
    for mode in ("simple", "extended", "codegen", "cost", "formatted"):
        assert "hush-hush-key" not in query.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
    with pytest.raises(ValueError):
        pii.pseudonymise(df, "")


def test_key_of_the_setting(spark):
    from quillmark.llm.queries import PII_KEY, pii_key

    assert pii_key(spark) == pii_key(spark) and len(pii_key(spark)) == 64
    spark.conf.set(PII_KEY, "own")
    assert pii_key(spark) == "own"
    spark.conf.unset(PII_KEY)


def test_no_text_ends_an_executor(spark):
    """Repeats of a million: host labels, digits in groups, @ and blanks, one long local part; a value after each is still found."""
    n = 1_000_000
    mail = "jane.doe@mail.example.org"
    long = ["x@" + "a1." * n, "x@" + "label." * n, "@" * n, "a@" * n, "1234 " * n, "12-" * n, "1." * n, "(555) " * (n // 4), " " * n, "a" * n + "@b.org", "+1" * n, "DE12 " * (n // 10), "." * n, "x@y" + "." * n]
    df = spark.createDataFrame([(k, f"{x} {mail} .") for k, x in enumerate(long)], "doc_id long, text string").repartition(len(long))
    got = {r.doc_id: r for r in pii.pseudonymise(df, "k").select("doc_id", "n_email", F.length("text").alias("n"), F.col("text").contains(mail).alias("there")).collect()}
    assert all(r.n_email >= 1 and not r.there and r.n == len(long[k]) + len(mail) + 3 for k, r in got.items())
    assert len(got) == len(long)


def test_hosts_of_many_labels(spark):
    hosts = ["b." * k + "org" for k in (1, 2, 126, 127, 200)]
    rows = spark.createDataFrame([(k, f"to a@{h}") for k, h in enumerate(hosts)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(rows, "k").collect()}
    assert [got[k].n_email for k in range(5)] == [1, 1, 1, 0, 0]
