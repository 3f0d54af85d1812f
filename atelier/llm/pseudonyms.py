"""Personal data replaced by format-preserving Feistel pseudonyms, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atelier.llm.common import packed

ROUNDS = 10
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
PHONE = r"(?<![0-9+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[.-][0-9]{4}(?![0-9])|(?<![0-9])\+[1-9][0-9]{7,14}(?![0-9])"
IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
DATE = r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-])"
#: In the order in which they are tried at a place.
FOUND = "|".join(f"(?:{p})" for p in (EMAIL, IP, DATE, SSN, PHONE, CARD))
#: Dates from this day on are permuted among as many days, the product of two numbers.
FIRST_DAY, DAY_FACTORS = "1900-01-01", (250, 292)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def feistel(values: Column, radices: Column, key: str, tweak: str, back: bool = False) -> Column:
    """Keyed permutation of all arrays of integers with ``0 <= values[i] < radices[i]``.

    The array is halved; in turn each half is shifted, number by number and modulo its radices, by
    hashes of the key, the tweak, the round and the other half. ``back`` undoes it.
    """

    def shift(own: Column, radix: Column, other: Column, r: Column) -> Column:
        said = F.concat_ws("|", F.lit(key), F.lit(tweak), r.cast("string"), F.array_join(F.transform(other, lambda v: v.cast("string")), ","))

        def moved(said: Column) -> Column:
            def one(v: Column, i: Column) -> Column:
                by = F.conv(F.substring(F.sha2(F.concat_ws("|", said, i.cast("string")), 256), 1, 12), 16, 10).cast("long")
                return F.pmod(v - by if back else v + by, F.get(radix, i)).cast("long")

            return F.transform(own, one)

        return let(said, moved)

    def halves(array: Column, a: str, b: str) -> list[Column]:
        half = F.floor(F.size(array) / 2).cast("int")
        return [F.slice(array, 1, half).alias(a), F.slice(array, half + 1, F.size(array) - half).alias(b)]

    def run(radix: Column) -> Column:
        def step(acc: Column, r: Column) -> Column:
            left = F.struct(shift(acc["a"], radix["ra"], acc["b"], r).alias("a"), acc["b"].alias("b"))
            right = F.struct(acc["a"].alias("a"), shift(acc["b"], radix["rb"], acc["a"], r).alias("b"))
            return F.when(r % 2 == 0, left).otherwise(right)

        rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
        return F.aggregate(rounds, let(values, lambda v: F.struct(*halves(v, "a", "b"))), step, lambda acc: F.concat(acc["a"], acc["b"]))

    return let(let(radices, lambda r: F.struct(*halves(r, "ra", "rb"))), run)


def _digits(s: Column) -> Column:
    return F.transform(F.regexp_extract_all(s, F.lit("[0-9]"), F.lit(0)), lambda d: d.cast("long"))


def _refilled(s: Column, digits: Column) -> Column:
    """The string with its digits replaced in order."""
    none = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def fill(new: Column) -> Column:
        def step(acc: Column, ch: Column) -> Column:
            digit = F.struct(F.concat(acc["out"], F.get(new, acc["k"]).cast("string")).alias("out"), (acc["k"] + 1).alias("k"))
            return F.when(ch.between("0", "9"), digit).otherwise(F.struct(F.concat(acc["out"], ch).alias("out"), acc["k"].alias("k")))

        return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), none, step, lambda acc: acc["out"])

    return let(digits, fill)


def _luhn_sum(digits: Column, check: int) -> Column:
    """Luhn sum; ``check`` is 1 where the check digit is still to come, so that the last digit is doubled."""
    n = F.size(digits)
    doubled = F.transform(digits, lambda d, i: F.when((n - 1 - i) % 2 == 1 - check, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(doubled, F.lit(0).cast("long"), lambda a, d: a + d)


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _email(s: Column, key: str, back: bool) -> Column:
    """The local part's letters and digits are permuted, each in its class; the domain stays."""
    local = F.filter(F.split(F.substring_index(s, "@", 1), ""), lambda c: c != "")

    def classed(c: Column) -> Column:
        lower, upper, digit = c.between("a", "z"), c.between("A", "Z"), c.between("0", "9")
        base = F.when(lower, 97).when(upper, 65).when(digit, 48).otherwise(F.ascii(c)).cast("long")
        radix = F.when(lower | upper, 26).when(digit, 10).otherwise(1).cast("long")
        return F.struct(base.alias("base"), radix.alias("radix"), (F.ascii(c) - base).alias("v"))

    def joined(parts: Column) -> Column:
        moved = feistel(F.transform(parts, lambda p: p["v"]), F.transform(parts, lambda p: p["radix"]), key, "email", back)
        chars = let(moved, lambda new: F.transform(parts, lambda p, i: F.chr(p["base"] + F.get(new, i))))
        return F.concat(F.array_join(chars, ""), F.lit("@"), F.substring_index(s, "@", -1))

    return let(F.transform(local, classed), joined)


def _card(s: Column, key: str, back: bool) -> Column:
    """Digits but the last are permuted, and the last is made to check; null unless the number checks."""

    def checked(digits: Column) -> Column:
        n = F.size(digits) - 1
        body = feistel(F.slice(digits, 1, n), F.array_repeat(_long(10), n), key, "card", back)
        new = let(body, lambda b: F.concat(b, F.array(F.pmod(10 - _luhn_sum(b, 1) % 10, _long(10)))))
        return F.when(_luhn_sum(digits, 0) % 10 == 0, _refilled(s, new))

    return let(_digits(s), checked)


def _phone(s: Column, key: str, back: bool) -> Column:
    """The last ten digits are permuted; the first of area and exchange stay 2 to 9, or 0 to 1. Of a foreign number all but the first digit are."""

    def renumbered(digits: Column) -> Column:
        n = F.size(digits)
        home = (n == 10) | ((n == 11) & (F.get(digits, F.lit(0)) == 1))

        def classed(d: Column, i: Column) -> Column:
            lead = home & ((n - i == 10) | (n - i == 7))
            base = F.when(home & (i < n - 10), d).when(~home & (i == 0), d).when(lead & (d >= 2), 2).otherwise(0)
            radix = F.when(home & (i < n - 10), 1).when(~home & (i == 0), 1).when(lead & (d >= 2), 8).when(lead, 2).otherwise(10)
            return F.struct(base.cast("long").alias("base"), radix.cast("long").alias("radix"), (d - base).cast("long").alias("v"))

        def again(parts: Column) -> Column:
            moved = feistel(F.transform(parts, lambda p: p["v"]), F.transform(parts, lambda p: p["radix"]), key, "phone", back)
            return _refilled(s, let(moved, lambda new: F.transform(parts, lambda p, i: p["base"] + F.get(new, i))))

        return let(F.transform(digits, classed), again)

    return let(_digits(s), renumbered)


def _ip(s: Column, key: str, back: bool) -> Column:
    """Addresses are permuted; the first octet among 1 to 223, or it stays. Null unless all octets are."""

    def again(octets: Column) -> Column:
        first = F.get(octets, F.lit(0))
        common = first.between(1, 223)
        base = F.when(common, 1).otherwise(first).cast("long")
        values = F.transform(octets, lambda v, i: F.when(i == 0, v - base).otherwise(v))
        radices = F.array(F.when(common, 223).otherwise(1).cast("long"), _long(256), _long(256), _long(256))
        moved = feistel(values, radices, key, "ip", back)
        text = let(moved, lambda new: F.array_join(F.transform(new, lambda v, i: F.when(i == 0, v + base).otherwise(v).cast("string")), "."))
        return F.when(F.forall(octets, lambda v: v <= 255), text)

    return let(F.transform(F.split(s, r"\."), lambda o: o.cast("long")), again)


def _ssn(s: Column, key: str, back: bool) -> Column:
    """Numbers are permuted among those that can be issued; null for others."""

    def again(parts: Column) -> Column:
        area, group, serial = (F.get(parts, F.lit(k)) for k in range(3))
        values = F.array(F.when(area < 666, area - 1).otherwise(area - 2), group - 1, serial - 1)
        moved = feistel(values, F.array(_long(898), _long(99), _long(9999)), key, "ssn", back)

        def text(new: Column) -> Column:
            a, g, n = (F.get(new, F.lit(k)) for k in range(3))
            return F.format_string("%03d-%02d-%04d", F.when(a < 665, a + 1).otherwise(a + 2), g + 1, n + 1)

        return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), let(moved, text))

    return let(F.transform(F.split(s, "-"), lambda v: v.cast("long")), again)


def _date(s: Column, key: str, back: bool) -> Column:
    """Real dates among the permuted days become others of them.

    Slashed dates are read with the month first; those that can only have the day first become
    others of that kind, by permuting again until the day is over 12.
    """
    (a, b), start = DAY_FACTORS, F.lit(FIRST_DAY).cast("date")
    read = lambda form: F.try_to_timestamp(s, F.lit(form)).cast("date")
    dashed, dotted, month_first = s.contains("-"), s.contains("."), read("MM/dd/yyyy")
    day = F.when(dashed, read("yyyy-MM-dd")).when(dotted, read("dd.MM.yyyy")).otherwise(F.coalesce(month_first, read("dd/MM/yyyy")))

    def moved(n: Column) -> Column:
        new = feistel(F.array(F.floor(n / b).cast("long"), n % b), F.array(_long(a), _long(b)), key, "date", back)
        return let(new, lambda v: F.get(v, F.lit(0)) * b + F.get(v, F.lit(1)))

    def date(n: Column) -> Column:
        return F.date_add(start, n.cast("int"))

    def again(n: Column) -> Column:
        walked = F.aggregate(F.sequence(F.lit(1), F.lit(64)), moved(n), lambda v, _: F.when(F.dayofmonth(date(v)) > 12, v).otherwise(moved(v)))
        plain = dashed | dotted | month_first.isNotNull()
        form = lambda d, f: F.date_format(d, f)
        text = let(
            F.when(plain, moved(n)).otherwise(walked),
            lambda v: F.when(dashed, form(date(v), "yyyy-MM-dd"))
            .when(dotted, form(date(v), "dd.MM.yyyy"))
            .when(month_first.isNotNull(), form(date(v), "MM/dd/yyyy"))
            .otherwise(form(date(v), "dd/MM/yyyy")),
        )
        return F.when(n.between(0, a * b - 1), text)

    return let(F.datediff(day, start).cast("long"), again)


KINDS = {"email": (EMAIL, _email), "ip": (IP, _ip), "date": (DATE, _date), "ssn": (SSN, _ssn), "phone": (PHONE, _phone), "card": (CARD, _card)}


def kind_of(s: Column) -> Column:
    """Kind of a string that FOUND matched, before it is validated."""
    return reduce(lambda rest, k: F.when(s.rlike(rf"\A(?:{KINDS[k][0]})\z"), F.lit(k)).otherwise(rest), reversed(KINDS), F.lit(None).cast("string"))


def pseudonym(s: Column, kind: Column, key: str, back: bool = False) -> Column:
    """Pseudonym of a string of that kind; null where it isn't valid."""
    return reduce(lambda rest, k: F.when(kind == k, KINDS[k][1](s, key, back)).otherwise(rest), reversed(KINDS), F.lit(None).cast("string"))


def pseudonymise(docs: DataFrame, key: str, text: str = "text", back: bool = False) -> DataFrame:
    """docs with personal data in ``text`` replaced, and n_replaced and kinds (sorted, distinct).

    E-mail addresses, IPv4 addresses, dates, social security, phone and card numbers are found by
    pattern, validated (octets, calendar, issued ranges, Luhn), and permuted with the key within
    their format and validity, so equal values have equal pseudonyms in all documents; ``back`` with the
    same key restores them. What isn't valid stays, and so do texts without any. Null texts stay
    null; repeated rows change alike; all other columns are kept, but for those of the two new
    columns' names; an empty table stays empty.
    Nothing is shuffled or looked up.
    """
    some = F.coalesce(F.col(text).rlike("[0-9@]"), F.lit(False))
    none = F.array().cast("array<string>")
    found = packed(docs, text).withColumn("_found", F.when(some, F.regexp_extract_all(text, F.lit(FOUND), F.lit(0))).otherwise(none))
    new = F.transform(
        "_found",
        lambda s: let(kind_of(s), lambda kind: F.struct(s.alias("s"), kind.alias("kind"), pseudonym(s, kind, key, back).alias("new"))),
    )
    changed = found.withColumn("_new", F.when(F.size("_found") > 0, new))
    gaps = F.split(text, FOUND, -1)
    joined = let(F.col("_new"), lambda found: F.transform(gaps, lambda gap, i: F.concat(gap, F.coalesce(F.get(found, i)["new"], F.get(found, i)["s"], F.lit("")))))
    clean = F.when(F.size("_found") > 0, F.array_join(joined, "")).otherwise(F.col(text))
    valid = F.filter(F.coalesce("_new", F.array().cast("array<struct<s:string,kind:string,new:string>>")), lambda p: p["new"].isNotNull())
    n, kinds = F.size(valid).cast("long"), F.array_sort(F.array_distinct(F.transform(valid, lambda p: p["kind"])))
    kept = [c for c in docs.columns if c.lower() not in ("n_replaced", "kinds")]
    return changed.select(*[(clean if c == text else F.col("_row")[c]).alias(c) for c in kept], n.alias("n_replaced"), kinds.alias("kinds"))
