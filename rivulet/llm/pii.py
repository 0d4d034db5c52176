"""Format-preserving pseudonyms by keyed Feistel permutations, in DataFrame functions only.

Payment cards (with a valid check digit, however grouped), North American and international phone numbers, social
security numbers, IPv4 addresses, dates that exist, e-mail local parts, access keys and hex secrets are replaced by values
of the same format. Each format is permuted by a Feistel network over exactly its valid values, so equal values get equal
pseudonyms in all documents, different values stay different, and the key's holder can invert it.

The key is given by the caller; queries take it from the setting KEY_SETTING (session_key).
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY_SETTING, ROUNDS = "spark.rivulet.pii.key", 8

#: What is looked for, in this order; each ends at the first character that can't belong to it, so matching is linear in the text.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[2-9][0-9]{2}[ .-])|\+1[ .-]?[0-9]{3}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "abroad": r"(?<![0-9A-Za-z+])\+[2-9](?:[ .-]?\(?[0-9]\)?){6,14}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])",
    "iso_date": r"(?<![0-9A-Za-z-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9A-Za-z-])",
    "us_date": r"(?<![0-9A-Za-z/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9A-Za-z/])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}|[ -]?[0-9]{6}[ -]?[0-9]{4,5})(?![0-9A-Za-z])",
    "ip": r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9A-Za-z]|\.[0-9])",
    "key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:(?i:password|passwd|secret|token|api_?key) ?[=:] ?[\"']?(?:[0-9a-f]{8,}+|[0-9A-F]{8,}+)(?![A-Za-z0-9])|(?<== [\"'])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?=[\"']))",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A character or word without which none of the patterns can match; most texts are settled by it.
NEEDED = "[0-9@=:]|AKIA"
#: Spans of years whose dates are permuted among themselves, with two factors of their number of days: 400 years from 304
#: and from 2100 on (146,097 days each), 1904 to 2099 (71,589), and the rests up to 303 (110,667) and from 9700 on (109,572).
SPAN_YEARS, SPAN = 400, (189, 773)
NEAR, NEAR_DAYS = (1904, 2099), (147, 487)
EARLY, EARLY_DAYS = 303, (111, 997)
LATE, LATE_DAYS = 9700, (276, 397)
#: Hex digits that one network permutes; longer values are permuted in parts of nearly equal length.
HEX_PART = 64


def session_key(spark: SparkSession) -> str:
    """The key that the session's setting names. Without one, a random key that this session keeps and no one else has:
    its pseudonyms are linked across documents, but can't be inverted or repeated later."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        spark.conf.set(KEY_SETTING, key := secrets.token_hex(16))
    return key


def _prf(tag: Column | str, round_: Column, value: Column, key: str) -> Column:
    """60 pseudo-random bits."""
    tag = F.lit(tag) if isinstance(tag, str) else tag
    joined = F.concat_ws("|", F.lit(key), tag, round_.cast("string"), value.cast("string"), F.lit(key))
    return F.conv(F.substring(F.sha2(joined.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def permuted(value: Column, a: int, b: int, tag: Column | str, key: str, back: bool = False) -> Column:
    """A keyed permutation of the whole numbers under a * b (a, b under 2^31)."""
    start = F.struct(F.floor(value / F.lit(b)).cast("long").alias("l"), (value % F.lit(b)).cast("long").alias("r"))
    sign = -1 if back else 1

    def step(s: Column, i: Column) -> Column:
        left = F.pmod(s["l"] + sign * (_prf(tag, i, s["r"], key) % F.lit(a)), F.lit(a)).cast("long")
        right = F.pmod(s["r"] + sign * (_prf(tag, i, s["l"], key) % F.lit(b)), F.lit(b)).cast("long")
        return F.when(i % 2 == 0, F.struct(left.alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), right.alias("r")))

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, start, step, lambda s: s["l"] * F.lit(b) + s["r"])


def _in_parts(text: Column, part: int, f: Callable[[Column, Column], Column]) -> Column:
    """f of each of the nearly equal parts of a text, at most `part` characters long, and of its number."""
    n = F.ceil(F.length(text) / F.lit(part)).cast("int")
    cut = lambda i: F.floor(F.length(text) * i / n).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: f(F.substring(text, cut(i) + 1, cut(i + 1) - cut(i)), i)), "")


def _network(text: Column, tag: Column | str, key: str, back: bool, turn: Callable[[Column, Column], Column]) -> Column:
    """A Feistel network over the halves of a text: each character of one half is turned by a number drawn from the other."""
    tag = F.lit(tag) if isinstance(tag, str) else tag
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text)).alias("r"))
    sign = -1 if back else 1

    def moved(s: Column, other: Column, i: Column) -> Column:
        return F.array_join(F.transform(F.split(s, ""), lambda c, at: turn(c, sign * _prf(F.concat(tag, F.lit("#"), at.cast("string")), i, other, key))), "")

    def step(s: Column, i: Column) -> Column:
        left, right = moved(s["l"], s["r"], i), moved(s["r"], s["l"], i)
        return F.when(i % 2 == 0, F.struct(left.alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), right.alias("r")))

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, start, step, lambda s: F.concat(s["l"], s["r"]))


def _turned(c: Column, by: Column, first: str, n: int) -> Column:
    return F.char(F.pmod(F.ascii(c) - ord(first) + by % n, F.lit(n)) + ord(first))


def permuted_text(text: Column, tag: str, key: str, back: bool = False) -> Column:
    """A keyed permutation of the strings with the same kind of character (digit, a-z, A-Z, other) at each place; others stay."""

    def turn(c: Column, by: Column) -> Column:
        return F.when(c.between("0", "9"), _turned(c, by, "0", 10)).when(c.between("a", "z"), _turned(c, by, "a", 26)).when(c.between("A", "Z"), _turned(c, by, "A", 26)).otherwise(c)

    return _network(text, tag, key, back, turn)


def permuted_hex(text: Column, tag: str, key: str, back: bool = False) -> Column:
    """The same for strings of lower-case hex digits, of any length."""
    hexes, letters = "0123456789abcdef", "abcdefghijklmnop"
    turn = lambda c, by: _turned(c, by, "a", 16)
    return F.translate(_in_parts(F.translate(text, hexes, letters), HEX_PART, lambda part, i: _network(part, F.concat(F.lit(tag), i.cast("string")), key, back, turn)), letters, hexes)


def _refilled(match: Column, digits: Column) -> Column:
    """match with its digits replaced in order."""
    place = lambda i: F.length(F.regexp_replace(F.substring(match, F.lit(1), i + 1), "[^0-9]", ""))
    return F.array_join(F.transform(F.split(match, ""), lambda c, i: F.when(c.between("0", "9"), F.substring(digits, place(i), F.lit(1))).otherwise(c)), "")


def _padded(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _is_card(m: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(m, "[^0-9]", ""))


def _card(m: Column, key: str, back: bool) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    body = F.concat(F.substring(digits, 1, 1), permuted_text(F.substring(digits, F.lit(2), n - 2), "card", key, back))
    check = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: F.call_function("luhn_check", F.concat(body, d.cast("string"))))[0]
    return F.when(_is_card(m), _refilled(m, F.concat(body, check.cast("string")))).otherwise(m)


def _abroad(m: Column, key: str, back: bool) -> Column:
    """The first digit, which tells the part of the world, stays."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    return _refilled(m, F.concat(F.substring(digits, 1, 1), permuted_text(F.substring(digits, F.lit(2), F.length(digits)), "abroad", key, back)))


def _phone(m: Column, key: str, back: bool) -> Column:
    """Ten digits; area codes from 200 on stay so, and those under it (which no one has, but texts do) stay under it."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    country = F.when(F.length(digits) == 11, F.regexp_extract(m, r"^\+?1", 0)).otherwise(F.lit(""))
    area, rest = F.substring(F.right(digits, F.lit(10)), 1, 3).cast("long"), F.right(digits, F.lit(7)).cast("long") - 2_000_000
    held = permuted((area - 200) * 8_000_000 + rest, 800, 8_000_000, "phone", key, back) + 200 * 8_000_000
    new = F.when(area >= 200, held).otherwise(permuted(area * 8_000_000 + rest, 200, 8_000_000, "phone-0", key, back))
    ten = _padded(F.floor(new / 8_000_000).cast("long") * 10_000_000 + new % 8_000_000 + 2_000_000, 10)
    return F.concat(country, _refilled(F.substring(m, F.length(country) + 1, F.length(m)), ten))


def _ssn(m: Column, key: str, back: bool) -> Column:
    area, group, serial = (F.substring(m, p, n).cast("long") for p, n in ((1, 3), (5, 2), (8, 4)))
    place = area - 1 - (area > 666).cast("long")
    new = permuted((place * 99 + group - 1) * 9999 + serial - 1, 898, 99 * 9999, "ssn", key, back)
    place = F.floor(new / (99 * 9999)).cast("long")
    area = place + 1 + (place >= 665).cast("long")
    return F.concat_ws("-", _padded(area, 3), _padded(F.floor(new / 9999).cast("long") % 99 + 1, 2), _padded(new % 9999 + 1, 4))


def _turned_date(first: Column, day: Column, factors: tuple[int, int], key: str, back: bool) -> Column:
    """The date that a date is turned to within the span that begins with the year first."""
    start = F.make_date(first, F.lit(1), F.lit(1))
    new = permuted(F.datediff(day, start).cast("long"), *factors, F.concat(F.lit("date"), first.cast("string")), key, back)
    return F.date_add(start, new.cast("int"))


def _existing(m: Column, form: str) -> Column:
    """The date of a match, null if there is none; the year 0 doesn't exist."""
    day = F.try_to_date(m, form)
    return F.when(F.year(day) >= 1, day)


def _date(m: Column, form: str, key: str, back: bool) -> Column:
    day = _existing(m, form)
    year = F.year(day)
    origin = F.when(year < NEAR[0], F.lit(EARLY + 1)).otherwise(F.lit(NEAR[1] + 1))
    span = (origin + F.floor((year - origin) / SPAN_YEARS) * SPAN_YEARS).cast("int")
    new = (
        F.when(year.between(*NEAR), _turned_date(F.lit(NEAR[0]), day, NEAR_DAYS, key, back))
        .when(year <= EARLY, _turned_date(F.lit(1), day, EARLY_DAYS, key, back))
        .when(year >= LATE, _turned_date(F.lit(LATE), day, LATE_DAYS, key, back))
        .when(year.isNotNull(), _turned_date(span, day, SPAN, key, back))
    )
    return F.coalesce(F.date_format(new, form), m)


def _ip(m: Column, key: str, back: bool) -> Column:
    part = [F.element_at(F.split(m, r"\."), i + 1).cast("long") for i in range(4)]
    new = permuted(((part[0] * 256 + part[1]) * 256 + part[2]) * 256 + part[3], 65536, 65536, "ip", key, back)
    return F.concat_ws(".", *(F.pmod(F.shiftright(new, 24 - 8 * i), F.lit(256)).cast("string") for i in range(4)))


def _secret(m: Column, key: str, back: bool) -> Column:
    value = F.regexp_extract(m, r"^(?:.*[=:] ?[\"']?)?([0-9A-Fa-f]+)$", 1)
    new = permuted_hex(F.lower(value), "secret", key, back)
    return F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(value)), F.when(value == F.lower(value), new).otherwise(F.upper(new)))


def _kinds(m: Column) -> dict[str, Column]:
    """Which format a match of ANY has: the first that holds. Cards are the rest."""
    return {
        "email": F.instr(m, "@") > 0,
        "key": m.rlike(r"^AKIA[0-9A-Z]{16}$"),
        "secret": m.rlike(r"[=:]|^(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)$"),
        "ssn": m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
        "iso_date": m.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
        "us_date": m.rlike(r"^[0-9]{2}/"),
        "ip": m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"),
        "phone": m.rlike(f"^(?:{PATTERNS['phone']})$"),
        "abroad": F.startswith(m, F.lit("+")),
    }


def pseudonym(m: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of one match of ANY; back gives the value of a pseudonym."""
    at, is_ = F.instr(m, "@"), _kinds(m)
    return (
        F.when(is_["email"], F.concat(permuted_text(F.substring(m, F.lit(1), at - 1), "email", key, back), F.substring(m, at, F.length(m))))
        .when(is_["key"], F.concat(F.lit("AKIA"), permuted_text(F.substring(m, 5, 16), "key", key, back)))
        .when(is_["secret"], _secret(m, key, back))
        .when(is_["ssn"], _ssn(m, key, back))
        .when(is_["iso_date"], _date(m, "yyyy-MM-dd", key, back))
        .when(is_["us_date"], _date(m, "MM/dd/yyyy", key, back))
        .when(is_["ip"], _ip(m, key, back))
        .when(is_["phone"], _phone(m, key, back))
        .when(is_["abroad"], _abroad(m, key, back))
        .otherwise(_card(m, key, back))
    )


def replaced(m: Column) -> Column:
    """Whether a match of ANY is a value: not a date that doesn't exist, nor a number without a card's check digit."""
    is_ = _kinds(m)
    plain = is_["email"] | is_["key"] | is_["secret"] | is_["ssn"]
    exists = F.when(is_["iso_date"], _existing(m, "yyyy-MM-dd").isNotNull()).when(is_["us_date"], _existing(m, "MM/dd/yyyy").isNotNull())
    return F.when(plain, F.lit(True)).when(is_["iso_date"] | is_["us_date"], exists).when(is_["ip"] | is_["phone"] | is_["abroad"], F.lit(True)).otherwise(_is_card(m))


def matches(text: Column) -> Column:
    """The matches of ANY in order; an empty array if there are none, and for null."""
    return F.when(text.rlike(NEEDED), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def pseudonymised(text: Column, found: Column, key: str, back: bool = False) -> Column:
    """text with its matches replaced; the parts between them stay as they are."""
    new = F.transform(found, lambda m: pseudonym(m, key, back))
    joined = F.array_join(F.flatten(F.zip_with(F.split(text, ANY), new, lambda part, m: F.array(part, F.coalesce(m, F.lit(""))))), "")
    return F.when(F.size(found) > 0, joined).otherwise(text)


def found_count(found: Column) -> Column:
    """How many matches were values, and so replaced."""
    return F.size(F.filter(found, replaced)).cast("long")


def pseudonymise(docs: DataFrame, key: str, text: str = "text", back: bool = False, counted: str | None = None) -> DataFrame:
    """docs with the named column pseudonymised; all other columns stay. counted names a further column for the number of values.

    Null stays null, empty stays empty, both count 0; texts without a match are unchanged. Numbers that look like a card
    but fail the check digit, and dates that don't exist, stay and aren't counted. Dates change within their span of
    years. Equal values get equal pseudonyms whatever their separators, in repeated rows and anywhere else. A very long
    text is matched and replaced whole, in time in proportion to its length. An empty table gives an empty result. Only
    the named column is read, so other columns' names don't matter.
    """
    at, other = F.col(f"`{text}`").cast("string"), [F.col(f"`{c}`") for c in docs.columns]
    whole = F.struct(*other)
    rows = docs.select(whole.alias("row"), at.alias("text"), matches(at).alias("found"))
    kept = [pseudonymised(F.col("text"), F.col("found"), key, back).alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns]
    return rows.select(*kept, *([found_count(F.col("found")).alias(counted)] if counted else []))


def op5_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs, session_key(spark), counted="n_found")
