"""PII: format-preserving pseudonyms by a keyed Feistel network, in DataFrame expressions only.

Validated values are permuted within their format: payment cards (Luhn), IBANs (mod 97, the whole
body, letters among letters), social security numbers, phone numbers, IPv4 and IPv6 addresses and
calendar dates. The key alone decides the permutation, so equal values stay equal across documents and
different values stay different, with valid check digits and dates. E-mail addresses, access keys and
secrets are no numbers: they get a keyed digest in their format.

A number is a pair x below a, y below b; ROUNDS rounds add a keyed digest of one half to the
other, modulo a or b in turn, which is a permutation of all pairs. Strings of letters and digits are
permuted alike: the digest of one half shifts each character of the other within its kind.

The key comes into the plan as a scalar subquery, so that it is not spelt out in plans and event logs.

Defined cases: null text stays null, empty text empty; values inside longer runs of letters or
digits are no values; an address that is written in two ways has two pseudonyms; whole texts of any
length are searched; repeated rows are treated alike; an empty table gives no rows; all other columns
stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepeak.llm.common import fresh

ROUNDS = 8
#: Days from 1900-01-01 up to 2099-12-31: 17 * 4297 of them.
DAYS = (17, 4297)

#: The bounds on repetitions are those of the standard: 64 characters, 63 in a label.
EMAIL = r"\b[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}"
NAMED = r"\b(?:[Tt]oken|[Ss]ecret|[Pp]assword|[Pp]asswd|[Aa]pi[_-]?[Kk]ey) ?[=:] ?"
#: In quotes anything of eight characters; without them there must be a digit among them.
SECRET = NAMED + r"(?:[\"'][A-Za-z0-9+/_-]{8,}[\"']|(?=[A-Za-z+/_!@#$%^&*-]*[0-9])[A-Za-z0-9+/_!@#$%^&*-]{8,})"
ACCESS_KEY = r"\b(?:AKIA|ASIA)[A-Z0-9]{16}|\bgh[pousr]_[A-Za-z0-9]{36}"
PHONE = r"\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,4}|\(?\b[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"
IPV4 = r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
#: Eight groups, or a global, local or link prefix and a gap.
IPV6 = r"\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|\b(?:[23][0-9A-Fa-f]{3}|[fF][cdefCDEF][0-9A-Fa-f]{2})(?::[0-9A-Fa-f]{1,4}){0,5}::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}"
#: A date may be followed by a time, as in 2024-02-29T10:00:00Z.
DATE = r"\b[0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2}|\b[0-9]{2}[/.][0-9]{2}[/.][0-9]{4}"
SSN = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}"
CARD = r"\b[0-9]{4}[ .-][0-9]{4}[ .-][0-9]{4}[ .-][0-9]{4}|\b3[0-9]{3}[ .-][0-9]{6}[ .-][0-9]{4,5}|\b[0-9]{13,19}"
#: Countries by the length of their IBANs.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: A country's IBANs end where their length is reached, whatever word follows.
IBAN = "|".join(rf"\b(?:{'|'.join(countries.split())})[0-9]{{2}}(?:[ -]?[A-Z0-9]){{{length - 4}}}" for length, countries in IBAN_COUNTRIES.items())
#: One pattern for all; the kind of a match is told by matching it again as a whole.
ANY = f"{EMAIL}|{SECRET}|(?:{ACCESS_KEY})\\b|(?:{IBAN})\\b|(?:{IPV6})\\b|(?:{CARD})\\b|(?:{SSN})\\b|(?:{DATE})(?:\\b|(?=T[0-9]{{2}}:))|(?:{IPV4})\\b|(?:{PHONE})\\b"


def let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def feistel(x: str, a: str, y: str, b: str, key: str, tag: str) -> str:
    """A struct (x, y): the pair permuted. All arguments but tag are SQL; a and b fit 10**15."""
    f = "CAST(conv(substr(sha2(concat_ws('|', {key}, '{tag}', CAST(r AS string), CAST({half} AS string)), 256), 1, 15), 16, 10) AS bigint)"
    even = f"named_struct('x', pmod(s.x + pmod({f.format(key=key, tag=tag, half='s.y')}, {a}), {a}), 'y', s.y)"
    odd = f"named_struct('x', s.x, 'y', pmod(s.y + pmod({f.format(key=key, tag=tag, half='s.x')}, {b}), {b}))"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('x', CAST({x} AS bigint), 'y', CAST({y} AS bigint)), (s, r) -> CASE WHEN r % 2 = 0 THEN {even} ELSE {odd} END)"


def permuted_digits(d: str, key: str, tag: str) -> str:
    """A string of up to 20 digits permuted among the strings of its length."""
    half = f"(length({d}) DIV 2)"
    power = "CAST(rpad('1', {n} + 1, '0') AS bigint)"
    left, right = power.format(n=half), power.format(n=f"(length({d}) - {half})")
    pair = feistel(f"coalesce(try_cast(substr({d}, 1, {half}) AS bigint), 0)", left, f"substr({d}, {half} + 1)", right, key, tag)
    return let("q", pair, f"concat(CASE WHEN {half} > 0 THEN lpad(CAST(q.x AS string), {half}, '0') ELSE '' END, lpad(CAST(q.y AS string), length({d}) - {half}, '0'))")


def permuted_characters(s: str, key: str, tag: str) -> str:
    """A string of up to 32 capital letters and digits permuted among those with letters and digits in the same places; so is one of hex digits if the tag is ip6."""
    n = "CAST(conv(substr(h, 4 * i - 3, 4), 16, 10) AS int)"
    digit, letter = "CAST(CAST(c AS int) + {n} AS int) % 10", "char(65 + (ascii(c) - 65 + {n}) % 26)"
    if tag == "ip6":
        moved = f"lower(conv(CAST((CAST(conv(c, 16, 10) AS int) + {n}) % 16 AS string), 10, 16))"
    else:
        moved = f"CASE WHEN c BETWEEN '0' AND '9' THEN CAST({digit.format(n=n)} AS string) ELSE {letter.format(n=n)} END"

    def shifted(half: str, by: str) -> str:
        digest = f"sha2(concat_ws('|', {key}, '{tag}', CAST(r AS string), {by}), 256)"
        each = let("c", f"substr({half}, i, 1)", moved)
        return let("h", digest, f"CASE WHEN {half} = '' THEN '' ELSE array_join(transform(sequence(1, length({half})), i -> {each}), '') END")

    half = f"(length({s}) DIV 2)"
    even, odd = (f"named_struct('x', {shifted('s.x', 's.y')}, 'y', s.y)", f"named_struct('x', s.x, 'y', {shifted('s.y', 's.x')})")
    start = f"named_struct('x', substr({s}, 1, {half}), 'y', substr({s}, {half} + 1))"
    return let("q", f"aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> CASE WHEN r % 2 = 0 THEN {even} ELSE {odd} END)", "concat(q.x, q.y)")


def digits_of(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def luhn_sum(d: str, odd: int) -> str:
    """Luhn sum of digits d; every second digit from the right is doubled, the last one if odd is 1."""
    v = f"CAST(substr({d}, length({d}) - i, 1) AS int)"
    return f"aggregate(sequence(0, length({d}) - 1), 0, (t, i) -> t + CASE WHEN i % 2 = {1 - odd} THEN {v} * 2 - CASE WHEN {v} > 4 THEN 9 ELSE 0 END ELSE {v} END)"


def laid_out(m: str, d: str) -> str:
    """Match m with its digits replaced by those of d, in order."""
    char = f"substr({m}, i, 1)"
    rank = f"length(regexp_replace(substr({m}, 1, i), '[^0-9]', ''))"
    return f"array_join(transform(sequence(1, length({m})), i -> CASE WHEN {char} BETWEEN '0' AND '9' THEN substr({d}, {rank}, 1) ELSE {char} END), '')"


def mod97(s: str) -> str:
    """Capital letters and digits read as a number (A = 10 ... Z = 35) modulo 97."""
    c = f"substr({s}, i, 1)"
    return f"aggregate(sequence(1, length({s})), 0, (t, i) -> CASE WHEN {c} BETWEEN '0' AND '9' THEN (t * 10 + CAST({c} AS int)) % 97 ELSE (t * 100 + ascii({c}) - 55) % 97 END)"


def pseudonym(m: str, key: str) -> str:
    """SQL for what stands instead of match m (key is SQL as well): m itself if it is no valid value."""
    d = "d"
    card = let("p", permuted_digits("substr(d, 1, length(d) - 1)", key, "card"), laid_out(m, f"concat(p, CAST(pmod(-({luhn_sum('p', 1)}), 10) AS string))"))
    card = f"CASE WHEN {luhn_sum(d, 0)} % 10 = 0 THEN {card} ELSE {m} END"
    ssn = f"CASE WHEN substr(d, 1, 3) NOT IN ('000', '666') AND substr(d, 1, 1) <> '9' AND substr(d, 4, 2) <> '00' AND substr(d, 6) <> '0000' THEN {{}} ELSE {m} END"
    area = "(CAST(substr(d, 1, 3) AS int) - 1 - CASE WHEN substr(d, 1, 3) > '666' THEN 1 ELSE 0 END)"
    pair = feistel(f"{area} * 99 + CAST(substr(d, 4, 2) AS int) - 1", "88902L", "CAST(substr(d, 6) AS int) - 1", "9999L", key, "ssn")
    shown = "CAST(q.x DIV 99 AS int) + 1 + CASE WHEN q.x DIV 99 + 1 >= 666 THEN 1 ELSE 0 END"
    ssn = ssn.format(let("q", pair, f"format_string('%03d-%02d-%04d', {shown}, CAST(q.x % 99 AS int) + 1, CAST(q.y AS int) + 1)"))
    octets = let("o", f"CAST(split({m}, '[.]') AS array<int>)", "CASE WHEN array_max(o) > 255 THEN {m} ELSE {new} END").format
    pair = feistel("o[0] * 256 + o[1]", "65536L", "o[2] * 256 + o[3]", "65536L", key, "ip")
    ip = octets(m=m, new=let("q", pair, "concat_ws('.', q.x DIV 256, q.x % 256, q.y DIV 256, q.y % 256)"))
    plain = f"translate({m}, './', '--')"
    kinds = ("yyyy-MM-dd", "dd-MM-yyyy", "MM-dd-yyyy")
    parsed = [f"try_to_date({plain}, '{k}')" for k in kinds]
    day = f"CASE WHEN {m} RLIKE '^[0-9]{{4}}' THEN {parsed[0]} ELSE coalesce({parsed[1]}, {parsed[2]}) END"
    number = "datediff(t, DATE'1900-01-01')"
    pair = feistel(f"{number} DIV {DAYS[1]}", f"{DAYS[0]}L", f"{number} % {DAYS[1]}", f"{DAYS[1]}L", key, "date")
    written = [f"date_format(u, '{k}')" for k in kinds]
    shown = f"CASE WHEN {m} RLIKE '^[0-9]{{4}}' THEN {written[0]} WHEN {parsed[1]} IS NULL THEN {written[2]} ELSE {written[1]} END"
    new = let("u", f"date_add(DATE'1900-01-01', CAST(q.x * {DAYS[1]} + q.y AS int))", let("w", digits_of(shown), laid_out(m, "w")))
    date = let("q", pair, new)
    date = let("t", day, f"CASE WHEN t BETWEEN DATE'1900-01-01' AND DATE'2099-12-31' THEN {date} ELSE {m} END")
    # the country code, up to the first separator, stays
    code = f"CASE WHEN {m} LIKE '+%' THEN length(regexp_extract({m}, '^[+]([0-9]{{1,3}})(?:[ .(-]|$)', 1)) ELSE 0 END"
    phone = let("k", code, laid_out(m, f"concat(substr(d, 1, k), {permuted_digits('substr(d, k + 1)', key, 'phone')})"))
    phone = f"CASE WHEN length(d) BETWEEN 7 AND 15 THEN {phone} ELSE {m} END"
    fresh_body = let("h", permuted_characters("substr(z, 5)", key, "iban"), "concat(substr(z, 1, 2), lpad(CAST(98 - " + mod97("concat(h, substr(z, 1, 2), '00')") + " AS string), 2, '0'), h)")
    spaced = f"array_join(transform(sequence(1, length({m})), i -> CASE WHEN substr({m}, i, 1) IN (' ', '-') THEN substr({m}, i, 1) ELSE substr(v, length(translate(substr({m}, 1, i), ' -', '')), 1) END), '')"
    iban = let("z", f"translate({m}, ' -', '')", f"CASE WHEN length(regexp_replace(substr(z, 5), '[^0-9]', '')) >= 8 AND {mod97('concat(substr(z, 5), substr(z, 1, 4))')} = 1 THEN {let('v', fresh_body, spaced)} ELSE {m} END")
    char = f"substr({m}, i, 1)"
    ip6 = let("v", permuted_characters(f"lower(replace({m}, ':', ''))", key, "ip6"), f"array_join(transform(sequence(1, length({m})), i -> CASE WHEN {char} = ':' THEN ':' ELSE substr(v, length(replace(substr({m}, 1, i), ':', '')), 1) END), '')")
    hidden = lambda v: f"sha2(concat({key}, '|', {v}), 256)"
    email = f"concat('u', substr({hidden(f'lower({m})')}, 1, 20), '@mail.invalid')"
    access = let("k", f"length(regexp_extract({m}, '^(AKIA|ASIA|gh[pousr]_)', 1))", f"concat(substr({m}, 1, k), upper(substr({hidden(m)}, 1, length({m}) - k)))")
    value = f"regexp_extract({m}, r'[=:] ?[\"\\x27]?([^\"\\x27]+)[\"\\x27]?$', 1)"
    secret = let("q", value, f"concat(substr({m}, 1, length({m}) - length(q) - CASE WHEN {m} RLIKE r'[\"\\x27]$' THEN 1 ELSE 0 END), substr(repeat({hidden('q')}, 1 + length(q) DIV 64), 1, length(q)), CASE WHEN {m} RLIKE r'[\"\\x27]$' THEN right({m}, 1) ELSE '' END)")
    cases = [(EMAIL, email), (SECRET, secret), (ACCESS_KEY, access), (IBAN, iban), (IPV6, ip6), (CARD, card), (SSN, ssn), (DATE, date), (IPV4, ip), (PHONE, phone)]
    pattern = lambda p: "r'^(?:" + p.replace("'", r"\x27") + ")$'"
    return let("d", digits_of(m), "CASE " + " ".join(f"WHEN {m} RLIKE {pattern(p)} THEN {new}" for p, new in cases) + f" ELSE {m} END")


def key_column(spark: SparkSession, key: str) -> Column:
    """The key as a scalar subquery: plans show where it comes from, not what it is."""
    return spark.createDataFrame([(key,)], "key string").scalar()


def report(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with pseudonyms, and whether it differs from the document's text."""
    out = masked(docs.select("doc_id", "text"), key, "masked")
    return out.selectExpr("doc_id", "masked AS text", "coalesce(masked <> text, false) AS changed")


def masked(docs: DataFrame, key: str, to: str = "text") -> DataFrame:
    """docs with every valid value in text replaced; to names the column for the result."""
    if not key:
        raise ValueError("the key must not be empty")
    name, = fresh(docs, "key")
    pattern = "r'" + ANY.replace("'", r"\x27") + "'"
    new = f"transform(regexp_extract_all(text, {pattern}, 0), m -> {pseudonym('m', name)})"
    joined = f"array_join(zip_with(split(text, {pattern}), {new}, (gap, value) -> concat(gap, coalesce(value, ''))), '')"
    # most texts hold nothing that any pattern could match
    keyed = docs.withColumn(name, key_column(docs.sparkSession, key))
    return keyed.withColumn(to, F.expr(f"CASE WHEN text RLIKE '[0-9@=:]' THEN {joined} ELSE text END")).drop(name)
