"""Format-preserving pseudonyms for personal data, on column expressions alone.

Numbers that are valid are permuted within their own format by a keyed Feistel network, so equal values stay
equal in all documents, different ones stay different, and digits stay where digits were: card numbers
(Luhn), IBANs (check digits), social security numbers (areas, groups and serials in use), telephone numbers
(7 to 15 digits, national ones with an area code), IPv4 and IPv6 addresses, and dates of the years 1000 to
9999, those of 1900 to 2099 among themselves. E-mail addresses and long hexadecimal secrets have no small
domain to permute; a keyed hash of the same shape takes their place. Where more numbers stand beside a
card's or an IBAN's, the longest run of whole groups that is valid counts.

The key is a literal of the plan, so it shows in plans, logs and history servers of the job that uses it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let

ROUNDS = 8
#: Placeholder for tests and the sample query; a deployment passes its own secret.
SAMPLE_KEY = "sample key"
#: Repeats are possessive or bounded, and a long run is tried from its start or from its last 64 characters only: no stack and no quadratic time, however long a text is.
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
EMAIL = rf"(?:(?<!{_LOCAL}){_LOCAL}++|{_LOCAL}{{1,64}}+)@{_HOST}"
SECRET = r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![A-Za-z0-9])"
ADDRESS = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
ADDRESS_6 = rf"(?<![\w:.])(?:(?:{_HEX}:){{7}}{_HEX}|{_HEX}(?::{_HEX}){{0,5}}::(?:{_HEX}(?::{_HEX}){{0,5}})?)(?![\w:])"
DATE = r"(?<![\d./-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}(?:-\d{1,2}-|/\d{1,2}/|\.\d{1,2}\.)\d{4})(?![\d/-]|\.\d)"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
PHONE = r"(?<![\dA-Za-z])(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\dA-Za-z])\+\d{1,3}(?:[ .-]?\d{2,4}){3,5}(?!\d)|(?<![\d.-])\d{3}(?:-\d{3}-| \d{3} |\.\d{3}\.)\d{4}(?![\d-])"
CARD = r"(?<![\dA-Za-z])\d(?:[ -]?\d){12,18}(?![\dA-Za-z])"
#: In this order at each place of a text.
ANY = "|".join((EMAIL, DATE, SECRET, ADDRESS_6, ADDRESS, SOCIAL, IBAN, PHONE, CARD))
#: Spans of days that are permuted among themselves: the first day, and the number of days as a product.
SPANS = (("1900-01-01", 319, 229), ("1000-01-01", 538, 611), ("2100-01-01", 195, 14797))
#: A number that can only be a day, so the order of a date's day and month shows.
_LATE = "(?:1[3-9]|2[0-9]|3[01])"


def _noise(key: str, tweak: str, i: Column, x: Column) -> Column:
    """Fifteen hexadecimal digits' worth of a keyed hash, as a long."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), x.cast("string")), 256), 1, 15), 16, 10).cast("bigint")


def permute(left: Column, right: Column, lefts: Column | int, rights: Column | int, key: str, tweak: str) -> Column:
    """Struct (l, r): a keyed permutation of the pairs below lefts and rights; rounds change the two halves in turn."""
    lefts, rights = (F.lit(x).cast("bigint") if isinstance(x, int) else x for x in (lefts, rights))

    def turn(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        l = F.when(even, F.pmod(acc["l"] + F.pmod(_noise(key, tweak, i, acc["r"]), lefts), lefts)).otherwise(acc["l"])  # noqa: E741
        r = F.when(even, acc["r"]).otherwise(F.pmod(acc["r"] + F.pmod(_noise(key, tweak, i, acc["l"]), rights), rights))
        return F.struct(l.alias("l"), r.alias("r"))

    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def permute_digits(digits: Column, key: str, tweak: str) -> Column:
    """A string of 2 to 36 digits permuted among those of its length."""
    u = F.floor(F.length(digits) / 2).cast("int")
    v = F.length(digits) - u
    ten = lambda n: F.rpad(F.lit("1"), n + 1, "0").cast("bigint")
    halves = permute(F.substring(digits, F.lit(1), u), F.substring(digits, u + 1, v), ten(u), ten(v), key, tweak)
    return let(halves, lambda p: F.concat(F.lpad(p["l"].cast("string"), u, "0"), F.lpad(p["r"].cast("string"), v, "0")))


def _into(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, in order, by digits."""

    def put(acc: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        return F.struct(
            F.concat(acc["s"], F.when(is_digit, F.substring(digits, acc["k"] + 1, F.lit(1))).otherwise(c)).alias("s"), (acc["k"] + is_digit.cast("int")).alias("k")
        )

    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("s"), F.lit(0).alias("k")), put, lambda acc: acc["s"])


def luhn_sum(digits: Column, first_doubled: int) -> Column:
    """Luhn's sum from the right; every second digit is doubled, from the one at first_doubled on."""

    def worth(d: Column, i: Column) -> Column:
        twice = d.cast("int") * 2
        return F.when(i % 2 == first_doubled, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d.cast("int"))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda a, x: a + x)


def _mod_97(account: Column) -> Column:
    """What an account number leaves of 97, its first four characters put last and letters counted from 10 on."""

    def more(acc: Column, c: Column) -> Column:
        value = F.conv(c, 36, 10).cast("int")
        return F.pmod(acc * F.when(value > 9, 100).otherwise(10) + value, F.lit(97))

    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, F.lit(1), F.lit(4)))
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), more)


def _only_digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _replace_run(found: Column, run: Column, digits: Column) -> Column:
    """found with the digits of its part run replaced."""
    at = F.call_function("instr", found, run)
    return F.concat(F.substring(found, F.lit(1), at - 1), _into(run, digits), F.substring(found, at + F.length(run), F.length(found)))


def _card(found: Column, key: str) -> Column:
    # Runs of whole groups of digits, the longest first, from each start.
    runs = F.flatten(F.array(*(F.regexp_extract_all(found, F.lit(rf"(?<!\d)(?=(\d(?:[ -]?\d){{{n - 1}}})(?!\d))"), F.lit(1)) for n in range(19, 12, -1))))
    valid = F.get(F.filter(runs, lambda x: F.pmod(luhn_sum(_only_digits(x), 1), F.lit(10)) == 0), F.lit(0))

    def renumbered(run: Column) -> Column:
        own = _only_digits(run)
        head = permute_digits(F.substring(own, F.lit(1), F.length(own) - 1), key, "card")
        return _replace_run(found, run, let(head, lambda h: F.concat(h, F.pmod(10 - F.pmod(luhn_sum(h, 0), F.lit(10)), F.lit(10)).cast("string"))))

    return let(valid, lambda run: F.when(run.isNotNull(), renumbered(run)).otherwise(found))


def _account(found: Column, key: str) -> Column:
    """An IBAN whose country and letters stay; a card's number within what is none."""
    runs = F.filter(F.array(*(F.regexp_extract(found, rf"^([A-Z]{{2}}\d\d(?: ?[A-Z0-9]){{{n - 4}}})(?![A-Z0-9])", 1) for n in range(34, 14, -1))), lambda x: x != "")
    valid = F.get(F.filter(runs, lambda x: (_mod_97(F.replace(x, F.lit(" "), F.lit(""))) == 1) & (F.length(_only_digits(x)) > 3)), F.lit(0))

    def renumbered(run: Column) -> Column:
        own = F.replace(run, F.lit(" "), F.lit(""))
        rest = F.substring(own, F.lit(5), F.length(own))
        moved = permute_digits(_only_digits(rest), key, "iban")
        check = lambda m: 98 - _mod_97(F.concat(F.substring(own, F.lit(1), F.lit(2)), F.lit("00"), _into(rest, m)))
        return _replace_run(found, run, let(moved, lambda m: F.concat(F.lpad(check(m).cast("string"), 2, "0"), m)))

    return let(valid, lambda run: F.when(run.isNotNull(), renumbered(run)).otherwise(_card(found, key)))


def _social(found: Column, key: str) -> Column:
    area, group, serial = (F.split(found, "-")[i].cast("int") for i in range(3))
    used = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    pair = permute((area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "social")
    areas = lambda p: F.floor(p["l"] / 99) + 1
    text = lambda x, n: F.lpad(x.cast("bigint").cast("string"), n, "0")
    new = let(pair, lambda p: F.concat_ws("-", text(areas(p) + F.when(areas(p) > 665, 1).otherwise(0), 3), text(F.pmod(p["l"], F.lit(99)) + 1, 2), text(p["r"] + 1, 4)))
    return F.when(used, new).otherwise(found)


def _phone(found: Column, key: str) -> Column:
    """The subscriber's ten digits at most; a country code in front stays, and so does whether an area code begins with 0 or 1."""
    digits = _only_digits(found)
    tail = F.least(F.length(digits), F.lit(10))
    last = F.substring(digits, F.length(digits) - tail + 1, tail)
    low = F.substring(last, 1, 1).cast("int") < 2
    base, many = F.when(low, 0).otherwise(20_000).cast("bigint"), F.when(low, 20_000).otherwise(80_000).cast("bigint")
    pair = permute(F.substring(last, 1, 5).cast("bigint") - base, F.substring(last, 6, 5).cast("bigint"), many, 100_000, key, "phone")
    ten = let(pair, lambda p: F.concat(F.lpad((p["l"] + base).cast("string"), 5, "0"), F.lpad(p["r"].cast("string"), 5, "0")))
    number = F.concat(F.substring(digits, F.lit(1), F.length(digits) - tail), F.when(tail == 10, ten).otherwise(permute_digits(last, key, "phone")))
    whole = found.startswith("+")
    valid = F.length(digits).between(7, 15) & (whole | ~low) & ~digits.rlike(r"^(?:0+|1+|2+|3+|4+|5+|6+|7+|8+|9+)$")
    return F.when(valid, _into(found, number)).otherwise(found)


def _address(found: Column, key: str) -> Column:
    parts = F.transform(F.split(found, "\\."), lambda x: x.cast("int"))
    byte = lambda n: F.get(parts, F.lit(n))
    ip = permute(byte(0) * 256 + byte(1), byte(2) * 256 + byte(3), 65_536, 65_536, key, "ip")
    ip = let(ip, lambda p: F.concat_ws(".", *((F.shiftright(p[h], s).bitwiseAND(F.lit(255))).cast("string") for h, s in (("l", 8), ("l", 0), ("r", 8), ("r", 0)))))
    return F.when(F.array_max(parts) <= 255, ip).otherwise(found)


def _address_6(found: Column, key: str) -> Column:
    """All eight groups, written out; what is left out between two colons are zeros. Of short ones only those with three groups and a digit count."""
    groups = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
    before, after = groups(F.substring_index(found, "::", 1)), groups(F.substring(found, F.call_function("instr", found, F.lit("::")) + 2, F.length(found)))
    short = found.contains("::")
    missing = 8 - F.size(before) - F.size(after)
    whole = F.when(short, F.concat(before, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), after)).otherwise(groups(found))
    valid = (~short | ((missing > 0) & (missing < 6))) & found.rlike("[0-9]")
    digits = F.array_join(F.transform(whole, lambda g: F.lpad(F.lower(g), 4, "0")), "")
    half = lambda i: F.conv(F.substring(digits, i, 16), 16, -10).cast("bigint")
    noise = lambda i, x: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("ip6"), i.cast("string"), x.cast("string")), 256), 1, 16), 16, -10).cast("bigint")
    turn = lambda acc, i: F.struct(acc["r"].alias("l"), acc["l"].bitwiseXOR(noise(i, acc["r"])).alias("r"))
    moved = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(half(1).alias("l"), half(17).alias("r")), turn)
    text = lambda p: F.lower(F.concat(F.lpad(F.hex(p["l"]), 16, "0"), F.lpad(F.hex(p["r"]), 16, "0")))
    return F.when(valid, let(let(moved, text), lambda h: F.concat_ws(":", *(F.substring(h, 1 + 4 * i, 4) for i in range(8))))).otherwise(found)


def _date(found: Column, month_first: Column, key: str) -> Column:
    """A day among those of its span, in the order and with the widths of found."""
    part = F.split(found, "[./-]")
    mark = F.substring(F.regexp_replace(found, "[0-9]", ""), 1, 1)
    year_first = F.length(part[0]) == 4
    day_of = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    european, american = day_of(part[2], part[1], part[0]), day_of(part[2], part[0], part[1])
    as_american = ~year_first & american.isNotNull() & (european.isNull() | (month_first & (mark != ".")))
    day = F.when(year_first, day_of(*(part[i] for i in range(3)))).when(as_american, american).otherwise(european)

    def moved(first: str, lefts: int, rights: int) -> Column:
        n = F.datediff(day, F.lit(first).cast("date"))
        pair = permute(F.floor(n / rights), F.pmod(n, F.lit(rights)), lefts, rights, key, "date" if first == SPANS[0][0] else f"date {first}")
        return let(pair, lambda p: F.date_add(F.lit(first).cast("date"), (p["l"] * rights + p["r"]).cast("int")))

    year = F.year(day)
    new = F.when(year.between(1900, 2099), moved(*SPANS[0])).when(year.between(1000, 1899), moved(*SPANS[1])).when(year.between(2100, 9999), moved(*SPANS[2]))

    def written(d: Column) -> Column:
        y, m, k = F.year(d), F.month(d), F.dayofmonth(d)
        order = F.when(year_first, F.array(y, m, k)).when(as_american, F.array(m, k, y)).otherwise(F.array(k, m, y))
        padded = F.transform(order, lambda x, i: F.lpad(x.cast("string"), F.greatest(F.length(F.get(part, i)), F.length(x.cast("string"))), F.lit("0")))
        return F.call_function("array_join", padded, mark)

    return F.coalesce(let(new, lambda d: F.when(d.isNotNull(), written(d))), found)


def months_first(found: Column) -> Column:
    """Whether a document's dates with slashes or hyphens put the month first: one of them can only be read so, and none the other way."""
    some = lambda p: F.exists(found, lambda m: m.rlike(p))
    return some(rf"^\d{{1,2}}([/-]){_LATE}\1\d{{4}}$") & ~some(rf"^{_LATE}([/-])\d{{1,2}}\1\d{{4}}$")


def pseudonym(found: Column, key: str, month_first: Column | None = None) -> Column:
    """What takes the place of a match of ANY; the match itself if it isn't valid."""
    only = lambda p: found.rlike(f"^(?:{p})$")
    hashed = lambda tweak, x: F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), x), 256)
    secret = F.substring(F.repeat(hashed("secret", found), F.ceil(F.length(found) / 64).cast("int")), F.lit(1), F.length(found))
    email = F.concat(F.lit("u"), F.substring(hashed("email", F.lower(found)), 1, 15), F.lit("@h"), F.substring(hashed("host", F.lower(F.substring_index(found, "@", -1))), 1, 8), F.lit(".invalid"))
    kinds = (
        (DATE, _date(found, F.lit(False) if month_first is None else month_first, key)), (SECRET, secret), (ADDRESS_6, _address_6(found, key)), (ADDRESS, _address(found, key)),
        (SOCIAL, _social(found, key)), (IBAN, _account(found, key)), (PHONE, _phone(found, key)), (CARD, _card(found, key)),
    )
    new = F.when(found.contains("@"), email)
    for pattern, value in kinds:
        new = new.when(only(pattern), value)
    return new.otherwise(found)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with personal data in text replaced; n_found and n_changed count matches and those that were valid.

    Matches are taken from the left, the first kind of ANY at each place; an email address's part before
    the @ counts up to its run's start, or 64 characters where a match ends within the run. A date whose day
    and month could be either is read as the document's other dates are, else the day first. Null texts stay
    null and empty ones empty, with counts of 0; texts are read whole whatever their length, without a
    shuffle. Rows that repeat are each replaced alike, an empty table gives none. Other columns pass
    through, but for n_found and n_changed, whose places the counts take.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found, new, first = fresh(docs, "found", "new", "month_first")
    matches = F.when(text.rlike("[0-9@]") | text.rlike(SECRET), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = docs.withColumn(found, matches).withColumn(first, months_first(F.col(found)))
    replaced = F.transform(found, lambda m: pseudonym(m, key, F.col(first)))
    rows = rows.withColumn(new, F.when(F.size(found) > 0, replaced).otherwise(F.array().cast("array<string>")))
    gaps = F.split(text, ANY, -1)
    whole = F.array_join(F.flatten(F.zip_with(gaps, F.col(new), lambda g, m: F.array_compact(F.array(g, m)))), "")
    changed = F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x))
    kept = [c for c in docs.columns if c.lower() not in ("n_found", "n_changed")]
    return rows.select(
        *(F.when(F.size(found) > 0, whole).otherwise(F.col("text")).alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in kept),
        F.size(found).cast("long").alias("n_found"), changed.cast("long").alias("n_changed"),
    )
