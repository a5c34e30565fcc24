"""Operator 4: format-preserving pseudonyms by keyed Feistel networks.

Personal numbers, dates and addresses are found by one pattern, validated by their kind's rule (Luhn digit, IBAN remainder,
calendar date, octets, area numbers) and replaced by a keyed permutation of all values of the same format: digits stay digits
at their places, a card stays a card with a right check digit, a date stays a date.  Being a permutation that depends only on
key, kind and value, it maps equal values to equal pseudonyms in all documents, without any table of values, shuffle or state.

Networks have ``ROUNDS`` rounds, the round function is HMAC-SHA-256 of kind, round and half under the key, which has no default.
Numbers use alternating halves of n digits; dates from 1900 to 2099 use a mixed-radix network over their 73,049 = 17 * 4,297 days.
Long numbers go in blocks.  Where only a part of a format is valid (area numbers of SSNs; days of dates that can only be read month
first), the permutation is applied until its value is valid (cycle walking, ``WALK`` times at most, which one value in 10**25 needs),
so it permutes the valid values.  Mails keep the case of each place, plain and accented letters stay among their own.
Dates that can be read day first are read so, others month first.
Separators, signs, country codes and the domains' last parts stay.  What doesn't validate stays as it is.

Cards and IBANs are validated before they take their place: what they may be is looked for at every place and in several lengths
(cards by grouping, IBANs by their country's length), so numbers and words beside a value don't hide it.

Everything is DataFrame functions in one narrow pass; rounds are a fold, so plans stay small.

Cases: a null text stays null with no finds; an empty text stays empty; very long texts are taken whole; repeated rows and all
other columns stay (the replaced column is ``text``; counts go to the struct ``pii`` of ``pseudonymise``).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nodecensus.llm.common import table
from nodecensus.llm.quality import let

ROUNDS, WALK = 8, 64
KINDS = ("secret", "email", "iban", "date", "ssn", "ip", "phone", "card")
#: Kind by kind, in the order in which they are tried at a place.
PATTERNS = {
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "date": r"(?<![0-9.-])(?:(?:19|20)[0-9]{2}([-/.])[01][0-9]\1[0-3][0-9]|[0-3][0-9]([-/.])[0-3][0-9]\2(?:19|20)[0-9]{2})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])",
    "card": r"(?<![0-9.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]|[.-][0-9])",
}
#: Length of the IBANs of each country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = "|".join(f"(?:{'|'.join(c.split())})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items())
#: What may be a card or an IBAN, each looked for at every place (group 1), beside the greedy patterns above.
FORMS = {
    "iban": [rf"(?<![0-9A-Za-z])(?=((?:{_IBAN})(?![0-9A-Za-z])))[A-Z]"],
    "card": [rf"(?<![0-9.-])(?=((?:{x})(?![0-9]|\.[0-9])))[1-6]" for x in ("[0-9]{13,19}", "[0-9]{4}(?:[ -][0-9]{4}){3}", "[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{1,3}", "[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,3}", "[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}")],
}
#: Bounds of a validated card or IBAN.
BOUNDS = {"iban": ("(?<![0-9A-Za-z])(?:", ")(?![0-9A-Za-z])"), "card": ("(?<![0-9.-])(?:", r")(?![0-9]|\.[0-9])")}


def _noise(key: str, kind: str, tweak: Column, i: Column, half: Column) -> Column:
    """60 bits of the HMAC-SHA-256 of kind, tweak, round and half."""
    said = F.encode(F.concat_ws("|", F.lit(kind), tweak.cast("string"), i.cast("string"), half.cast("string")), "UTF-8")
    own = key.encode()
    own = (hashlib.sha256(own).digest() if len(own) > 64 else own).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(x ^ pad for x in own)) for pad in (0x36, 0x5C))
    return F.conv(F.substring(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, said), 256))), 256), 1, 15), 16, 10).cast("long")


def walked(value: Column, step, valid) -> Column:
    """step(value), and step again until it is valid."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), step(value), lambda x, _: F.when(valid(x), x).otherwise(step(x)))


def feistel_digits(digits: Column, key: str, kind: str, tweak: Column | None = None) -> Column:
    """A keyed permutation of all digit strings of the same length (2 to 18); a single digit is shifted."""
    tweak = F.lit("") if tweak is None else tweak
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")
    low = lambda x: F.coalesce(x.try_cast("long"), F.lit(0).cast("long"))

    def network(d: Column) -> Column:
        sizes = F.struct(F.length(d).alias("n"), F.floor(F.length(d) / 2).cast("int").alias("u"), (F.length(d) - F.floor(F.length(d) / 2)).cast("int").alias("v"))
        return let(sizes, lambda z: rounds(d, z["n"], z["u"], z["v"]))

    def rounds(d: Column, n: Column, u: Column, v: Column) -> Column:
        start = F.struct(low(F.substr(d, F.lit(1), u)).alias("a"), low(F.substr(d, u + 1, v)).alias("b"), power(u).alias("p"), power(v).alias("q"))

        def step(s: Column, i: Column) -> Column:
            noise = _noise(key, kind, F.concat(n.cast("string"), F.lit("."), tweak), i, s["b"])
            return F.struct(s["b"].alias("a"), ((s["a"] + noise % s["p"]) % s["p"]).alias("b"), s["q"].alias("p"), s["p"].alias("q"))

        done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(F.lpad(s["a"].cast("string"), u, "0"), F.lpad(s["b"].cast("string"), v, "0")))
        single = ((low(d) + _noise(key, kind, tweak, F.lit(0), F.lit(0)) % 10) % 10).cast("string")
        return F.when(n == 0, F.lit("")).when(n == 1, single).otherwise(done)

    return let(digits, network)


def feistel_long(digits: Column, key: str, kind: str) -> Column:
    """Longer strings of digits in blocks of 16, each with its place as tweak."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.length(digits) - 1) / 16).cast("int")), lambda k: let(F.substr(digits, k * 16 + 1, F.lit(16)), lambda b: feistel_digits(b, key, kind, k)))
    return F.when(F.length(digits) == 0, F.lit("")).otherwise(F.array_join(blocks, ""))


def spread(shape: Column, symbols: Column, chars: str) -> Column:
    """Puts the characters of ``symbols`` at the places of ``shape`` that match ``chars`` (a regex class)."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        hit = c.rlike(f"^{chars}$")
        return F.struct(F.concat(s["out"], F.when(hit, F.substr(symbols, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + hit.cast("int")).alias("at"))

    return F.aggregate(F.filter(F.split(shape, ""), lambda c: c != ""), start, step, lambda s: s["out"])


def luhn_sum(payload: Column) -> Column:
    """Luhn sum of a payload whose check digit follows."""
    digit = lambda c, j: let(c.cast("int") * F.when((F.length(payload) - j) % 2 == 1, 2).otherwise(1), lambda d: F.floor(d / 10) + d % 10)
    each = F.transform(F.filter(F.split(payload, ""), lambda c: c != ""), digit)
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)


def check_digit(payload: Column) -> Column:
    return ((10 - luhn_sum(payload) % 10) % 10).cast("string")


def iban_rest(bban: Column, head: Column) -> Column:
    """Remainder by 97 of bban + head (letters as 10 to 35)."""
    chars = F.filter(F.split(F.concat(bban, head), ""), lambda c: c != "")
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(chars, F.lit(0), lambda a, c: let(value(c), lambda v: F.when(v > 9, (a * 100 + v) % 97).otherwise((a * 10 + v) % 97)))


def _safe_int(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]{1,9}$"), c).otherwise("0").cast("int")


def _date(m: Column, key: str) -> Column:
    first = m.rlike("^[0-9]{4}")
    sep = F.when(first, F.substring(m, 5, 1)).otherwise(F.substring(m, 3, 1))
    one, two, year = F.substring(m, 1, 2), F.substring(m, 4, 2), F.substring(m, 7, 4)
    number = lambda y, mo, d: F.datediff(F.try_to_date(F.concat_ws("-", y, mo, d), "yyyy-MM-dd"), F.lit("1900-01-01").cast("date"))
    day_first = F.when(first, number(F.substring(m, 1, 4), F.substring(m, 6, 2), F.substring(m, 9, 2))).otherwise(number(year, two, one))
    month_first = number(year, one, two)

    def step(s: Column, i: Column) -> Column:
        a = (s["a"] + _noise(key, "date", F.lit("a"), i, s["b"]) % 17) % 17
        return let(a, lambda a: F.struct(a.alias("a"), ((s["b"] + _noise(key, "date", F.lit("b"), i, a) % 4297) % 4297).alias("b")))

    to = lambda n: F.date_add(F.lit("1900-01-01").cast("date"), n.cast("int"))
    mixed = lambda day: F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(F.floor(day / 4297).cast("long").alias("a"), (day % 4297).cast("long").alias("b")), step, lambda s: s["a"] * 4297 + s["b"])
    part = lambda n, k: F.date_format(to(n), k)
    text = let(mixed(day_first), lambda n: F.when(first, F.concat(part(n, "yyyy"), sep, part(n, "MM"), sep, part(n, "dd"))).otherwise(F.concat(part(n, "dd"), sep, part(n, "MM"), sep, part(n, "yyyy"))))
    # A date that is read month first has a day over 12, and so has its pseudonym.
    other = let(walked(month_first.cast("long"), mixed, lambda n: F.dayofmonth(to(n)) > 12), lambda n: F.concat(part(n, "MM"), sep, part(n, "dd"), sep, part(n, "yyyy")))
    return F.when(day_first.isNotNull(), text).when(~first & month_first.isNotNull(), other)


def luhn_valid(m: Column) -> Column:
    return let(F.regexp_replace(m, "[^0-9]", ""), lambda d: F.substr(d, F.length(d), F.lit(1)) == check_digit(F.substr(d, F.lit(1), F.length(d) - 1)))


def iban_valid(m: Column) -> Column:
    return let(F.regexp_replace(m, " ", ""), lambda c: iban_rest(F.substr(c, F.lit(5), F.lit(30)), F.substring(c, 1, 4)) == 1)


def _card(m: Column, key: str) -> Column:
    def done(d: Column) -> Column:
        new = let(feistel_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card"), lambda p: F.concat(p, check_digit(p)))
        return F.when(luhn_valid(m), spread(m, new, "[0-9]"))

    return let(F.regexp_replace(m, "[^0-9]", ""), done)


def _iban(m: Column, key: str) -> Column:
    def done(c: Column) -> Column:
        bban, country = F.substr(c, F.lit(5), F.lit(30)), F.substring(c, 1, 2)
        digits = F.regexp_replace(bban, "[^0-9]", "")
        moved = let(feistel_long(digits, key, "iban"), lambda d: spread(bban, d, "[0-9]"))
        new = let(moved, lambda b: F.concat(country, F.lpad((98 - iban_rest(b, F.concat(country, F.lit("00")))).cast("string"), 2, "0"), b))
        return F.when(iban_valid(m), spread(m, new, "[A-Z0-9]"))

    return let(F.regexp_replace(m, " ", ""), done)


def _ip(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), _safe_int)

    def done(p: Column) -> Column:
        valid = F.forall(p, lambda x: x <= 255)
        start = F.struct((F.get(p, 0) * 256 + F.get(p, 1)).cast("long").alias("a"), (F.get(p, 2) * 256 + F.get(p, 3)).cast("long").alias("b"))
        step = lambda s, i: F.struct(s["b"].alias("a"), ((s["a"] + _noise(key, "ip", F.lit(""), i, s["b"]) % 65536) % 65536).alias("b"))
        byte = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), (x % 256).cast("string"))
        return F.when(valid, F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat_ws(".", byte(s["a"]), byte(s["b"]))))

    return let(parts, done)


def _ssn(m: Column, key: str) -> Column:
    valid = lambda d: ~d.rlike("^(000|666|9[0-9][0-9])|^[0-9]{3}00|0000$")
    digits = F.regexp_replace(m, "-", "")
    return F.when(valid(digits), let(walked(digits, lambda d: feistel_digits(d, key, "ssn"), valid), lambda d: spread(m, d, "[0-9]")))


def _phone(m: Column, key: str) -> Column:
    """The country code stays; the rest of 7 to 15 digits is permuted."""
    head = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])", 0)

    def done(rest: Column) -> Column:
        digits = F.regexp_replace(rest, "[^0-9]", "")
        return F.when(F.length(digits).between(7, 15), F.concat(head, spread(rest, feistel_digits(digits, key, "phone"), "[0-9]")))

    return let(F.substr(m, F.length(head) + 1, F.length(m)), done)


def _radix(m: Column, key: str, kind: str, alphabet: str) -> Column:
    """Characters of an alphabet, in pairs of one network each: a permutation for every pair of places, tweaked by the place."""
    size = len(alphabet)
    index = lambda c: (F.instr(F.lit(alphabet), c) - 1).cast("long")
    chars = F.filter(F.split(m, ""), lambda c: c != "")

    def pairs(all_: Column) -> Column:
        half = F.ceil(F.size(all_) / 2).cast("int")
        value = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, c: (a * 31 + index(c) + 1) % 2147483647)
        # Unbalanced over whole halves: each round shifts every symbol of one half by noise from the other half and the place.
        def step(s: Column, i: Column) -> Column:
            moved = let(value(s["b"]), lambda v: F.transform(s["a"], lambda c, k: F.substr(F.lit(alphabet), ((index(c) + _noise(key, kind, k, i, F.concat_ws(",", v.cast("string"), F.array_join(s["b"], "")))) % size + 1).cast("int"), F.lit(1))))
            return F.struct(s["b"].alias("a"), moved.alias("b"))

        start = F.struct(F.slice(all_, F.lit(1), half).alias("a"), F.slice(all_, half + 1, F.size(all_)).alias("b"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(F.array_join(s["a"], ""), F.array_join(s["b"], "")))

    return let(chars, pairs)


LOWER, ACCENTED = "abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïñòóôõöøœùúûüý"


def _email(m: Column, key: str) -> Column:
    """Plain letters, accented letters and digits of the local part are permuted each as a string, the case of each place, marks,
    other letters and the domain stay."""

    def done(local: Column) -> Column:
        low = F.lower(local)

        def moved(s: Column, alphabet: str) -> Column:
            own = F.regexp_replace(s, f"[^{alphabet}]", "")
            return let(F.when(F.length(own) > 0, _radix(own, key, "email", alphabet)).otherwise(F.lit("")), lambda x: spread(s, x, f"[{alphabet}]"))

        def cased(new: Column) -> Column:
            at = F.transform(F.filter(F.split(local, ""), lambda c: c != ""), lambda c, i: let(F.substr(new, i + 1, F.lit(1)), lambda n: F.when(c != F.lower(c), F.upper(n)).otherwise(n)))
            return F.array_join(at, "")

        with_digits = lambda s: let(feistel_long(F.regexp_replace(s, "[^0-9]", ""), key, "email"), lambda d: spread(s, d, "[0-9]"))
        return let(let(let(let(low, lambda s: moved(s, LOWER)), lambda s: moved(s, ACCENTED)), with_digits), cased)

    return F.concat(let(F.regexp_extract(m, "^[^@]*", 0), done), F.regexp_extract(m, "@.*$", 0))


def _secret(m: Column, key: str) -> Column:
    """Hexadecimal tokens with both digits and letters; the case stays."""
    new = let(_radix(F.lower(m), key, "secret", "0123456789abcdef"), lambda x: F.when(m.rlike("[A-F]"), F.upper(x)).otherwise(x))
    return F.when(m.rlike("[0-9]") & m.rlike("[A-Fa-f]"), new)


def _replaced(m: Column, key: str) -> Column:
    """Struct of kind and pseudonym of a match; kind null and the match itself where nothing validates."""
    made = {"email": _email, "secret": _secret, "date": _date, "ssn": _ssn, "ip": _ip, "iban": _iban, "phone": _phone, "card": _card}
    shape = {"email": "@", "secret": "^([0-9a-f]{32,64}|[0-9A-F]{32,64})$", "date": r"^([0-9]{4}([-/.])[0-9]{2}\2[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\3[0-9]{4})$", "ssn": "^[0-9]{3}-[0-9]{2}-[0-9]{4}$", "ip": r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$", "iban": "^[A-Z]{2}[0-9]{2}", "phone": r"^\+|^\(|^[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$", "card": "."}
    kind = None
    for k, p in shape.items():
        kind = F.when(m.rlike(p), F.lit(k)) if kind is None else kind.when(m.rlike(p), F.lit(k))

    def chosen(k: Column) -> Column:
        new = None
        for name, f in made.items():
            new = F.when(k == name, f(m, key)) if new is None else new.when(k == name, f(m, key))
        return let(new, lambda x: F.struct(F.when(x.isNotNull(), k).alias("kind"), F.coalesce(x, m).alias("to")))

    return let(kind, chosen)


def _valid(text: Column, kind: str) -> Column:
    """Regex of the valid cards or IBANs of a text, longer ones first; one that matches nothing if there are none."""
    may = F.concat(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), *(F.regexp_extract_all(text, F.lit(x), F.lit(1)) for x in FORMS[kind]))
    good = F.filter(F.array_distinct(may), {"card": luhn_valid, "iban": iban_valid}[kind])
    first = F.transform(F.sort_array(F.transform(good, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda y: y["x"])
    return let(first, lambda x: F.when(F.size(x) > 0, F.concat(F.lit(BOUNDS[kind][0]), F.array_join(x, "|"), F.lit(BOUNDS[kind][1]))).otherwise("(?!)"))


def finder(text: Column) -> Column:
    """The pattern that finds what is to be replaced in a text."""
    return F.concat_ws("|", *(_valid(text, k) if k in FORMS else F.lit(f"(?:{x})") for k, x in PATTERNS.items()))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with personal values in ``text`` replaced, and ``pii``: a struct of how many of each kind."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def spliced(new: Column, find: Column) -> Column:
        parts = F.transform(F.split(t, find, -1), lambda gap, j: F.concat(gap, F.coalesce(F.get(new, j)["to"], F.lit(""))))
        count = lambda k: F.size(F.filter(new, lambda x: x["kind"] == k)).cast("long").alias(k)
        return F.struct(F.array_join(parts, "").alias("text"), F.struct(*(count(k) for k in KINDS)).alias("pii"))

    def replaced(find: Column) -> Column:
        return let(F.transform(F.regexp_extract_all(t, find, F.lit(0)), lambda m: _replaced(m, key)), lambda new: spliced(new, find))

    nothing = F.struct(F.col("text").cast("string").alias("text"), F.struct(*(F.lit(0).cast("long").alias(k) for k in KINDS)).alias("pii"))
    out = F.when(t.rlike("[0-9@]"), let(finder(t), replaced)).otherwise(nothing)
    return docs.withColumn("_pii", out).withColumn("text", F.col("_pii.text")).withColumn("pii", F.col("_pii.pii")).drop("_pii")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), spark.conf.get("spark.nodecensus.pii.key", "example key, for examples only"))
    return out.select("doc_id", "text", *(F.col(f"pii.{k}").alias(f"n_{k}") for k in KINDS))
