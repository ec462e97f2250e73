"""PII: format-preserving Feistel pseudonyms, in DataFrame functions only.

A text is split once by a pattern of candidates. Each candidate is validated by its kind (check digits, ranges,
calendar) and, if valid, permuted within its format by a keyed Feistel network; what is not valid stays as it is. Of a card or IBAN
that is not valid with the groups around it, the longest valid run of groups (for an IBAN, from its start) is taken.
The permutation depends only on the key, the kind and the value's own digits or letters, so equal values have equal
pseudonyms in all documents, without a join or a table of values, and distinct values of a kind have distinct ones.
(Of dates with slashes or dots, the day comes first unless the second number can only be one; a date is one value
in whichever order it is written.)

kind   format kept
email  domain, and the classes (lower, upper, digit, other) of the local part's characters
iban   country, length, classes of characters; check digits are valid again
phone  country code and separators; the form is all there is to validate
ssn    separators; area, group and serial are in the ranges that are given out
card   separators and length; the check digit is valid again
ip     four octets
date   a day from 1900-01-01 to 2099-12-31, in the form it was written in

Strings go through an alternating network over their characters: each half is shifted, character by character
within its class, by a keyed hash of the other half. Days go through one over 17 x 4297, which is just their number.
An octet quadruple goes through one over 65536 x 65536.

Defined results: a null text stays null with no pseudonyms; a null id stays null; repeated rows give repeated rows;
an empty table gives an empty one; a text of any length is split once, in the row; overlapping candidates go to the kind
that comes first. ``pseudonymize`` keeps all other columns, whatever their names. The key is the caller's secret: who has
it can invert every pseudonym.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "iban", "phone", "ssn", "card", "ip", "date")
ROUNDS = 8

#: Length of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBANS = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items())

#: Candidates by kind, in the order in which they are tried. Quantifiers are possessive or bounded.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "iban": rf"(?<![A-Za-z0-9])(?:(?:{_IBANS})|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)(?![A-Za-z0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-][0-9]{2,5}){2,5}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "date": r"(?<![0-9A-Za-z/-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?!(?!T[0-9]{2}:)[0-9A-Za-z/-])",
}
# a run of groups of digits, in which cards are looked for; it doesn't run on into what is a candidate of its own behind a space
_NEXT = "|".join(PATTERNS[k] for k in ("phone", "ssn", "ip", "date"))
PATTERNS["card"] = rf"(?<![0-9A-Za-z])[0-9](?:(?! (?:{_NEXT}))[ -]?[0-9]){{12,80}}(?![0-9A-Za-z])"
ANY = "|".join(PATTERNS.values())
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)  # 17 x 4297 days, to 2099-12-31


def _hash(key: str, kind: str, i: Column, *parts: Column) -> Column:
    """52 bits of a keyed hash, as a long."""
    said = F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), *parts)
    return F.conv(F.substring(F.sha2(said, 256), 1, 13), 16, 10).cast("long")


def _characters(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit("(?s)(.)"), F.lit(1))


def _shifted(c: Column, by: Column) -> Column:
    at = F.ascii(c)
    turn = lambda first, n: F.char(F.lit(first) + (at - F.lit(first) + by) % F.lit(n))
    return F.when(c.rlike("^[0-9]$"), turn(48, 10)).when(c.rlike("^[a-z]$"), turn(97, 26)).when(c.rlike("^[A-Z]$"), turn(65, 26)).otherwise(c)


def permuted(s: Column, key: str, kind: str) -> Column:
    """A string of the same character classes, one to one."""
    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substring(s, F.lit(1), half).alias("l"), F.substring(s, half + 1, F.length(s)).alias("r"))

    def turn(x: Column, i: Column) -> Column:
        new = F.array_join(F.transform(_characters(x["l"]), lambda c, k: _shifted(c, _hash(key, kind, i, k.cast("string"), x["r"]))), "")
        return F.struct(x["r"].alias("l"), new.alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda x: F.concat(x["l"], x["r"]))


def permuted_number(n: Column, a: int, b: int, key: str, kind: str) -> Column:
    """A number of 0 .. a * b - 1, one to one."""
    start = F.struct(F.floor(n / b).cast("long").alias("l"), (n % b).cast("long").alias("r"))

    def turn(x: Column, i: Column) -> Column:
        left = (x["l"] + _hash(key, kind, i, F.lit("l"), x["r"].cast("string"))) % F.lit(a)
        return F.struct(left.cast("long").alias("l"), ((x["r"] + _hash(key, kind, i, F.lit("r"), left.cast("string"))) % F.lit(b)).cast("long").alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda x: x["l"] * F.lit(b) + x["r"])


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _refilled(form: Column, filling: Column, place: str) -> Column:
    """The form with the characters that ``place`` matches taken, in turn, from the filling."""
    done = F.aggregate(
        _characters(form),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda x, c: F.when(c.rlike(place), F.struct(F.concat(x["out"], F.substring(filling, x["at"], F.lit(1))).alias("out"), (x["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(x["out"], c).alias("out"), x["at"].alias("at"))),
    )
    return done["out"]


def luhn_sum(digits: Column) -> Column:
    """Sum over the digits, of which each second one from the right is doubled."""

    def add(x: Column, c: Column, k: Column) -> Column:
        d = c.cast("int") * (k % 2 + 1)
        return x + d - F.when(d > 9, 9).otherwise(0)

    indexed = F.transform(_characters(F.reverse(digits)), lambda c, k: F.struct(c.alias("c"), k.alias("k")))
    return F.aggregate(indexed, F.lit(0), lambda x, e: add(x, e["c"], e["k"]))


def mod97(s: Column) -> Column:
    """Remainder of an IBAN's characters by 97, the country and check digits last, letters as two digits."""
    moved = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))
    return F.aggregate(_characters(moved), F.lit(0).cast("long"), lambda x, c: F.when(c.rlike("[0-9]"), (x * 10 + c.cast("int")) % 97).otherwise((x * 100 + F.ascii(c) - 55) % 97))


def _email(m: Column, key: str) -> Column:
    return F.concat(permuted(F.substring_index(m, "@", 1), key, "email"), F.lit("@"), F.substring_index(m, "@", -1))


def _iban(m: Column, key: str) -> Column:
    plain = F.regexp_replace(m, " ", "")
    body = permuted(F.substring(plain, F.lit(5), F.length(plain)), key, "iban")
    country = F.substring(plain, 1, 2)
    check = F.lpad((F.lit(98) - mod97(F.concat(country, F.lit("00"), body))).cast("string"), 2, "0")
    return F.when(mod97(plain) == 1, _refilled(m, F.concat(country, check, body), "[A-Z0-9]")).otherwise(m)


def _groups(m: Column, start: Column) -> Column:
    """What starts with the group of number ``start`` (from 0) and ends with any group."""
    parts = F.split(m, "[ -]")
    before = F.when(start > 0, F.length(F.array_join(F.slice(parts, 1, start), " ")) + 1).otherwise(0)
    piece = lambda j: F.length(F.array_join(F.slice(parts, start + 1, j - start), " "))
    return F.transform(F.sequence(start + 1, F.size(parts)), lambda j: F.struct(piece(j).alias("n"), (-before).alias("at"), F.substring(m, before + 1, piece(j)).alias("s")))


def _within(m: Column, runs: Column, valid, made) -> Column:
    """The candidate with the longest valid one of its runs of groups, the first of several, replaced."""
    run = F.array_max(F.filter(runs, valid))
    # one element, so that the run is found once
    return F.coalesce(F.get(F.transform(F.array(run), lambda r: F.when(r.isNotNull(), F.concat(F.substring(m, F.lit(1), -r["at"]), made(r["s"]), F.substring(m, r["n"] - r["at"] + 1, F.length(m))))), F.lit(0)), m)


def _iban_or_prefix(m: Column, key: str) -> Column:
    """A word or number behind an IBAN may look like a further group of it."""
    plain = lambda r: F.regexp_replace(r["s"], " ", "")
    prefix = _within(m, _groups(m, F.lit(0)), lambda r: (F.length(plain(r)) >= 15) & (mod97(plain(r)) == 1), lambda s: _iban(s, key))
    return F.when((mod97(F.regexp_replace(m, " ", "")) != 1) & m.contains(" "), prefix).otherwise(_iban(m, key))


def _card_or_part(m: Column, key: str) -> Column:
    """A run of groups of digits may hold cards among other numbers (an expiry, a code, a year). From left to right, the
    longest valid card that begins with a group is replaced. Groups of a card have three digits or more in the mean: single
    digits in a row are a table, not a card."""
    n = F.length(_digits(m))
    digits = lambda r: F.length(_digits(r["s"]))
    valid = lambda r: digits(r).between(13, 19) & (digits(r) >= 3 * F.size(F.split(r["s"], "[ -]"))) & (luhn_sum(_digits(r["s"])) % 10 == 0)
    groups = F.split(m, "[ -]")

    def step(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.length(F.array_join(F.slice(groups, 1, i), " ")) + 1).otherwise(0)
        separator = F.when(i > 0, F.substring(m, before, F.lit(1))).otherwise(F.lit(""))
        best = F.array_max(F.filter(F.slice(_groups(m, i), 1, 6), valid))  # six groups of three digits hold 18
        # one element, so that the run is found once
        made = F.transform(F.array(best), lambda r: F.struct(F.concat(x["out"], separator, F.when(r.isNotNull(), _card(r["s"], key)).otherwise(F.get(groups, i))).alias("out"), (i + F.when(r.isNotNull(), F.size(F.split(r["s"], "[ -]"))).otherwise(1)).alias("skip")))
        return F.when(i < x["skip"], x).otherwise(F.get(made, F.lit(0)))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("skip"))
    parts = F.aggregate(F.sequence(F.lit(0), F.size(groups) - 1), start, step, lambda x: x["out"])
    whole = n.between(13, 19) & (luhn_sum(_digits(m)) % 10 == 0)
    return F.when(whole, _card(m, key)).when(m.rlike("[ -]"), parts).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    country = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    rest = F.substring(m, F.length(country) + 1, F.length(m))
    return F.concat(country, _refilled(rest, permuted(_digits(rest), key, "phone"), "[0-9]"))


def _card(m: Column, key: str) -> Column:
    d = _digits(m)
    body = permuted(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
    check = (F.lit(10) - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    return F.when(luhn_sum(d) % 10 == 0, _refilled(m, F.concat(body, check.cast("string")), "[0-9]")).otherwise(m)


def _ssn(m: Column, key: str) -> Column:
    """Areas are 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999: 898 x 99 x 9999 numbers."""
    area, group, serial = (F.get(F.split(m, "-"), F.lit(k)).cast("long") for k in range(3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - F.when(area > 666, 2).otherwise(1)
    new = permuted_number((place * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, key, "ssn")
    at = F.floor(new / (99 * 9999))
    digits = lambda n, width: F.lpad(n.cast("long").cast("string"), width, "0")
    made = F.concat_ws("-", digits(at + F.when(at >= 665, 2).otherwise(1), 3), digits(F.floor(new / 9999) % 99 + 1, 2), digits(new % 9999 + 1, 4))
    return F.when(valid, made).otherwise(m)


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    n = F.aggregate(octets, F.lit(0).cast("long"), lambda x, o: x * 256 + o)
    p = permuted_number(n, 65536, 65536, key, "ip")
    new = F.concat_ws(".", *[F.shiftright(p, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])
    return F.when(F.forall(octets, lambda x: x <= 255), new).otherwise(m)


def _date(m: Column, key: str) -> Column:
    iso, parts = m.rlike("^[0-9]{4}-"), F.split(m, "[/.-]")
    part = lambda k: F.get(parts, F.lit(k)).cast("int")
    # with a slash or a dot, the first number is the day, unless only the second one can be
    swapped = ~iso & (part(1) > 12)
    day = F.when(iso, part(2)).when(swapped, part(1)).otherwise(part(0))
    month = F.when(swapped, part(0)).otherwise(part(1))
    year = F.when(iso, part(0)).otherwise(part(2))
    valid = year.between(1900, 2099) & month.between(1, 12) & day.between(1, 31)
    held = F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd")
    n = F.datediff(held, F.to_date(F.lit(FIRST_DAY))).cast("long")
    new = F.date_add(F.to_date(F.lit(FIRST_DAY)), permuted_number(n, *DAYS, key, "date").cast("int"))
    dm = F.when(swapped, F.lit("MM#dd#yyyy")).otherwise(F.lit("dd#MM#yyyy"))
    written = F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(F.when(dm == "MM#dd#yyyy", F.date_format(new, "MM/dd/yyyy")).otherwise(F.date_format(new, "dd/MM/yyyy")))
    written = F.when(m.contains("."), F.translate(written, "/", ".")).otherwise(written)
    return F.when(valid & held.isNotNull(), written).otherwise(m)


def kind_of(m: Column) -> Column:
    """The first kind, in the order of the patterns, that the candidate is wholly of."""
    out = F
    for k in KINDS:
        # the lookarounds saw the neighbours already; alone, a candidate has none
        out = out.when(m.rlike(f"^(?:{PATTERNS[k]})$"), F.lit(k))
    return out


def pseudonym(m: Column, key: str) -> Column:
    """The candidate's pseudonym, or the candidate itself where it isn't valid."""
    kind = kind_of(m)
    made = {"email": _email(m, key), "iban": _iban_or_prefix(m, key), "phone": _phone(m, key), "ssn": _ssn(m, key), "card": _card_or_part(m, key), "ip": _ip(m, key), "date": _date(m, key)}
    out = F
    for k in KINDS:
        out = out.when(kind == k, made[k])
    return out.otherwise(m)


def found(text: Column) -> Column:
    """The candidates of a text, in order."""
    return F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def replaced(text: Column, candidates: Column, pseudonyms: Column) -> Column:
    """The text with its candidates replaced in order."""
    pieces = F.zip_with(F.split(text, ANY, -1), pseudonyms, lambda between, p: F.concat(between, F.coalesce(p, F.lit(""))))
    return F.when(F.size(candidates) > 0, F.array_join(pieces, "")).otherwise(text)


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", found_col: str | None = None, seen_col: str | None = None) -> DataFrame:
    """The rows with the text column replaced; ``found_col`` and ``seen_col``, if named, get the arrays of
    pseudonyms and of the candidates they stand for. No shuffle, no Python, rows stay where they are."""
    names = list(docs.columns)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), found(docs[text_col]).alias("seen"))
    # the array of pseudonyms is used twice below: materialised by an inner projection that isn't inlined
    made = held.select("row", "seen", F.transform("seen", lambda m: pseudonym(m, key)).alias("made"))
    text = F.col("row")[text_col]
    out = [replaced(text, F.col("seen"), F.col("made")).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names]
    if found_col:
        out.append(F.coalesce("made", F.array().cast("array<string>")).alias(found_col))
    if seen_col:
        out.append(F.coalesce("seen", F.array().cast("array<string>")).alias(seen_col))
    return made.select(*out)
