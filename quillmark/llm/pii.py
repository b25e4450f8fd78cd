"""Format-preserving pseudonyms for personal data, with built-in functions only.

Found are card numbers (12 to 19 digits with a right check digit), international bank account numbers
(with right check digits), telephone numbers, IPv4 addresses, social security numbers, dates (also those
of timestamps) and mail addresses. Each value is normalised, permuted within its own format by a keyed
Feistel network, and written back into the separators and letter case it came in, so equal values stay
equal in all documents, and different ones stay different.

* Digits and letters: the value is two halves; in each round every character of one half moves within
  its own class (digits, letters) by a key stream hashed from the key, the round, the length and the
  other half. Check digits are computed anew, so valid numbers map to valid ones; the country of an account
  number stays, and so does a telephone number's country code. Social security numbers are permuted
  until they are valid.
* Addresses: a 32-bit number of two 16-bit halves.
* Dates: the day's number in 1900 to 2099 as a pair in 271 x 270, permuted until it is in the range. With
  slashes the month comes first where both orders are possible; a date that can only be read with the
  day first is permuted until its pseudonym can only be read so, too.

Texts are split at the matches and joined again; all else stays byte for byte. Null texts stay null; very
long texts go whole, repeated rows get the same pseudonyms, extra columns pass unchanged.
The key is a secret: give it from the environment of the job, not in code. It reaches the expressions by a
scalar subquery over a local table, so that no plan, event log or user interface shows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "ip", "iban", "date", "ssn", "phone", "card")
#: One expression for all kinds; KIND_PATTERNS tells them apart afterwards. No alternative can start inside a longer run.
#: Java's matcher calls itself once for each turn of a repeated group, so every such repeat is bounded: a host
#: name has 127 labels at most, and what follows them is left as it is.
_MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,125}\.[A-Za-z]{2,}+"
_IP = r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])"
_DATE = r"(?<![0-9A-Za-z.-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./](?:19|20)[0-9]{2})(?:(?=T[0-9]{2}:[0-9]{2})|(?![0-9A-Za-z-]))"
_SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
_PHONE = "|".join([
    r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z.,-])00[1-9][0-9]{0,2}[ .-]\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,8}(?:[ .-][0-9]{2,4})?(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z(])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9A-Za-z-])",
    r"(?<![0-9A-Za-z-])(?<![0-9] )[0-9]{3} [0-9]{3} [0-9]{4}(?![0-9A-Za-z-]| [0-9])",
])
#: Country codes of one and two digits; all others have three.
_COUNTRY = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
_IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![0-9A-Za-z])"
_CARD = r"(?<![0-9A-Za-z])(?:[0-9]{12,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z]|[ -][0-9]{4}(?![0-9]))"
KIND_PATTERNS = dict(zip(KINDS, (_MAIL, _IP, _IBAN, _DATE, _SSN, _PHONE, _CARD), strict=True))
PATTERN = "|".join(KIND_PATTERNS.values())


def _stream(key: Column | str, kind: str, r: Column, n: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(key) if isinstance(key, str) else key, F.lit(kind), r.cast("string"), n.cast("string"), other).cast("binary"), 512)


def _word(stream: Column, i: Column) -> Column:
    """16 bits of the stream, by turns."""
    return F.conv(F.substr(stream, F.pmod(i, F.lit(32)) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _moved(text: Column, stream: Column) -> Column:
    """Each character moved within its class by the stream."""

    def move(c: Column, i: Column) -> Column:
        k, at = _word(stream, i), F.ascii(c)
        return F.when(c.between("0", "9"), F.char(F.pmod(at - 48 + k, F.lit(10)) + 48)).when(c.between("a", "z"), F.char(F.pmod(at - 97 + k, F.lit(26)) + 97)).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), move), "")


def permuted(text: Column, key: Column | str, kind: str) -> Column:
    """Feistel network over two halves of a string of digits and lower-case letters; other characters keep their places."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("a"), F.substr(text, half + 1, n).alias("b"))

    def turned(s: Column, r: Column) -> Column:
        # bound to a variable, so that the stream is hashed once a round, not once a character
        return F.aggregate(F.array(_stream(key, kind, r, n, s["b"])), F.lit(""), lambda _, stream: _moved(s["a"], stream))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, r: F.struct(s["b"].alias("a"), turned(s, r).alias("b")))
    return F.concat(done["a"], done["b"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def check_digit(payload: Column) -> Column:
    """The last digit that makes `payload` a valid number."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(payload, F.length(payload) - i, F.lit(1)).cast("int") * F.when(i % 2 == 0, F.lit(2)).otherwise(F.lit(1))
        return total + F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), F.length(payload) - 1), F.lit(0), add)
    return F.pmod(-total, F.lit(10)).cast("string")


def _card_payload(digits: Column) -> Column:
    return F.substr(digits, F.lit(1), F.length(digits) - 1)


def is_card(value: Column) -> Column:
    digits = _digits(value)
    return F.substr(digits, F.length(digits), F.lit(1)) == check_digit(_card_payload(digits))


def _refilled(form: Column, digits: Column) -> Column:
    """`digits` in the places of the digits of `form`."""
    step = F.aggregate(
        F.filter(F.split(form, ""), lambda c: c != ""),
        F.struct(F.lit("").alias("text"), F.lit(1).alias("at")),
        lambda s, c: F.when(c.between("0", "9"), F.struct(F.concat(s["text"], F.substr(digits, s["at"], F.lit(1))).alias("text"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["text"], c).alias("text"), s["at"].alias("at"))),
    )
    return step["text"]


def _new_card(value: Column, key: Column | str) -> Column:
    digits = F.aggregate(F.array(_card_payload(_digits(value))), F.lit(""), lambda _, p: permuted(p, key, "card"))
    return F.aggregate(F.array(digits), F.lit(""), lambda _, p: _refilled(value, F.concat(p, check_digit(p))))


def _until(value: Column, turn, done, turns: int) -> Column:
    """`turn` applied to a value once and then until `done`, at most `turns` times: a walk along its cycle."""
    start = F.struct(value.alias("v"), F.lit(True).alias("again"))
    step = lambda s, _: F.when(s["again"], F.aggregate(F.array(turn(s["v"])), s, lambda _, p: F.struct(p.alias("v"), (~done(p)).alias("again")))).otherwise(s)
    return F.aggregate(F.sequence(F.lit(1), F.lit(turns)), start, step)["v"]


#: Social security numbers that are never given out.
_NO_SSN = "^(000|666|9)|^[0-9]{3}00|0000$"


def _new_ssn(value: Column, key: Column | str) -> Column:
    # 11 of 100 nine-digit numbers are invalid: 24 turns leave one chance in 10^22
    moved = _until(_digits(value), lambda v: permuted(v, key, "ssn"), lambda v: ~v.rlike(_NO_SSN), 24)
    return F.aggregate(F.array(moved), F.lit(""), lambda _, p: _refilled(value, p))


def _new_phone(value: Column, key: Column | str) -> Column:
    """The digits after the country code are permuted, so a number is the same with and without it."""
    digits = _digits(value)
    known = F.when(value.startswith("+"), F.length(F.regexp_extract(digits, _COUNTRY, 1))).when(value.startswith("00"), F.length(F.regexp_extract(F.substr(digits, F.lit(3)), _COUNTRY, 1)) + 2).otherwise(F.lit(0))
    whole = F.aggregate(F.array(known), F.lit(""), lambda _, n: F.concat(F.substr(digits, F.lit(1), n), permuted(F.substr(digits, n + 1), key, "phone")))
    return F.aggregate(F.array(whole), F.lit(""), lambda _, p: _refilled(value, p))


def _remainder(text: Column) -> Column:
    """The number that digits and letters (A is 10) spell, modulo 97."""

    def add(r: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), F.pmod(r * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(F.pmod(r * 100 + F.ascii(c) - 55, F.lit(97)))

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), add)


def is_iban(value: Column) -> Column:
    bare = F.replace(value, F.lit(" "), F.lit(""))
    return F.length(bare).between(15, 34) & (_remainder(F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))) == 1)


def _new_iban(value: Column, key: Column | str) -> Column:
    bare = F.replace(value, F.lit(" "), F.lit(""))
    country = F.substr(bare, F.lit(1), F.lit(2))
    moved = F.aggregate(F.array(F.lower(F.substr(bare, F.lit(5)))), F.lit(""), lambda _, b: F.upper(permuted(b, key, "iban")))
    checked = F.aggregate(F.array(moved), F.lit(""), lambda _, b: F.concat(country, F.lpad((98 - _remainder(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
    step = F.aggregate(
        F.filter(F.split(value, ""), lambda c: c != ""),
        F.struct(F.lit("").alias("text"), F.lit(1).alias("at")),
        lambda s, c: F.when(c == " ", F.struct(F.concat(s["text"], c).alias("text"), s["at"].alias("at"))).otherwise(F.struct(F.concat(s["text"], F.substr(checked, s["at"], F.lit(1))).alias("text"), (s["at"] + 1).alias("at"))),
    )
    return step["text"]


def _new_ip(value: Column, key: Column | str) -> Column:
    octet = lambda k: F.split(value, "[.]")[k].cast("int")
    start = F.struct((octet(0) * 256 + octet(1)).alias("a"), (octet(2) * 256 + octet(3)).alias("b"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, r: F.struct(s["b"].alias("a"), F.pmod(s["a"] + _word(_stream(key, "ip", r, F.lit(32), s["b"].cast("string")), F.lit(0)), F.lit(65536)).alias("b")))
    text = lambda x: F.concat(F.floor(x / 256).cast("string"), F.lit("."), F.pmod(x, F.lit(256)).cast("string"))
    return F.aggregate(F.array(done), F.lit(""), lambda _, d: F.concat(text(d["a"]), F.lit("."), text(d["b"])))


#: Days of 1900 to 2099; a pair in _SIDES has a few more.
_DAYS, _SIDES = 73049, (271, 270)


def _parsed(value: Column, form: str) -> Column:
    return F.try_to_timestamp(value, F.lit(form)).cast("date")


def _day_first(value: Column) -> Column:
    """A date with slashes that can only be read with the day first."""
    return F.substr(value, F.lit(3), F.lit(1)).eqNullSafe("/") & (F.substr(value, F.lit(1), F.lit(2)).cast("int") > 12)


def _day(value: Column) -> Column:
    """The date's day since 1900; null if there is no such date."""
    iso = F.substr(value, F.lit(5), F.lit(1)) == "-"
    slash = F.substr(value, F.lit(3), F.lit(1)) == "/"
    parsed = F.when(iso, _parsed(value, "yyyy-MM-dd")).when(_day_first(value), _parsed(value, "dd/MM/yyyy")).when(slash, _parsed(value, "MM/dd/yyyy")).otherwise(_parsed(value, "dd.MM.yyyy"))
    return F.datediff(parsed, F.lit("1900-01-01").cast("date"))


def _new_date(value: Column, key: Column | str) -> Column:
    def once(day: Column) -> Column:
        def step(s: Column, r: Column) -> Column:
            word = lambda other: _word(_stream(key, "date", r, F.lit(_DAYS), other.cast("string")), F.lit(0))
            odd = r % 2 == 1
            return F.struct(F.when(odd, F.pmod(s["a"] + word(s["b"]), F.lit(_SIDES[0]))).otherwise(s["a"]).alias("a"), F.when(odd, s["b"]).otherwise(F.pmod(s["b"] + word(s["a"]), F.lit(_SIDES[1]))).alias("b"))

        done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(F.floor(day / _SIDES[1]).cast("int").alias("a"), F.pmod(day, F.lit(_SIDES[1])).alias("b")), step)
        return F.aggregate(F.array(done), F.lit(0), lambda _, d: d["a"] * _SIDES[1] + d["b"])

    from_day = lambda day: F.date_add(F.lit("1900-01-01").cast("date"), day)
    first = _day_first(value)
    # 121 of 73,170 pairs are no day, and 40 of 100 days can be read as months: 64 turns leave one chance in 10^25
    day = _until(_day(value), once, lambda d: (d < _DAYS) & (~first | (F.dayofmonth(from_day(F.least(d, F.lit(_DAYS - 1)))) > 12)), 64)
    return F.aggregate(F.array(from_day(day)), F.lit(""), lambda _, date: F.when(F.substr(value, F.lit(5), F.lit(1)) == "-", F.date_format(date, "yyyy-MM-dd")).when(first, F.date_format(date, "dd/MM/yyyy")).when(F.substr(value, F.lit(3), F.lit(1)) == "/", F.date_format(date, "MM/dd/yyyy")).otherwise(F.date_format(date, "dd.MM.yyyy")))


def _new_mail(value: Column, key: Column | str) -> Column:
    """The part before @ is permuted without regard to case, then written in the case it had; the host stays."""
    local = F.substring_index(value, "@", 1)
    moved = permuted(F.lower(local), key, "mail")
    cased = F.aggregate(F.array(moved), F.lit(""), lambda _, p: F.array_join(F.zip_with(F.filter(F.split(local, ""), lambda c: c != ""), F.filter(F.split(p, ""), lambda c: c != ""), lambda old, new: F.when(old.between("A", "Z"), F.upper(new)).otherwise(new)), ""))
    return F.concat(cased, F.lit("@"), F.substring_index(value, "@", -1))


def kind_of(value: Column) -> Column:
    """The kind of a match, null if its value is no valid one."""
    full = {k: value.rlike(f"^(?:{p})$") for k, p in KIND_PATTERNS.items()}
    ssn = ~value.rlike("^(000|666|9)|-00-|-0000$")
    n = F.length(_digits(value))
    return (
        F.when(value.contains("@"), F.lit("email"))
        .when(full["ip"], F.lit("ip"))
        .when(full["iban"], F.when(is_iban(value), F.lit("iban")))
        .when(full["date"], F.when(_day(value).isNotNull(), F.lit("date")))
        .when(full["ssn"], F.when(ssn, F.lit("ssn")))
        .when(full["phone"], F.when(n.between(8, 15), F.lit("phone")))
        .when(full["card"], F.when(is_card(value), F.lit("card")))
    )


def pseudonym(value: Column, kind: Column, key: Column | str) -> Column:
    return F.when(kind == "email", _new_mail(value, key)).when(kind == "ip", _new_ip(value, key)).when(kind == "date", _new_date(value, key)).when(kind == "ssn", _new_ssn(value, key)).when(kind == "phone", _new_phone(value, key)).when(kind == "iban", _new_iban(value, key)).when(kind == "card", _new_card(value, key)).otherwise(value)


def hidden(docs: DataFrame, key: str) -> Column:
    """The key as a scalar subquery over a local table: plans name the subquery, not what it holds."""
    spark = docs.sparkSession
    table = spark._jsparkSession.createDataset([key], spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(table.toDF(), spark).select("value").scalar()


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """Returns every row of `docs` with text rewritten, and n_pii with n_email to n_card; columns of those names are replaced."""
    if not key:
        raise ValueError("a key is needed")
    counts = ["n_pii", *(f"n_{k}" for k in KINDS)]
    kept = [c for c in docs.columns if c not in counts]
    none = F.array().cast("array<struct<value: string, kind: string>>")
    text = F.col("text").cast("string")
    found = F.when(text.rlike("[0-9@]") & text.rlike(PATTERN), F.transform(F.regexp_extract_all(text, F.lit(f"({PATTERN})"), F.lit(1)), lambda v: F.struct(v.alias("value"), kind_of(v).alias("kind")))).otherwise(none)
    marked = docs.select(*(F.col(f"`{c}`") for c in kept), hidden(docs, key).alias("__qm_key")).withColumn("__qm_found", found)
    some = F.exists("__qm_found", lambda m: m["kind"].isNotNull())
    replaced = F.concat(F.transform("__qm_found", lambda m: pseudonym(m["value"], m["kind"], F.col("__qm_key"))), F.array(F.lit("")))
    # the pieces between the matches: one more than there are matches
    joined = F.array_join(F.zip_with(F.split(text, PATTERN, -1), replaced, lambda a, b: F.concat(a, b)), "")
    out = marked.withColumn("text", F.when(some, joined).otherwise(text))
    of = lambda kind: F.size(F.filter("__qm_found", lambda m: m["kind"] == kind)).cast("long")
    return out.withColumns({"n_pii": F.size(F.filter("__qm_found", lambda m: m["kind"].isNotNull())).cast("long"), **{f"n_{k}": of(k) for k in KINDS}}).drop("__qm_found", "__qm_key")
