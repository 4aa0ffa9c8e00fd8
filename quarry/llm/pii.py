"""Pseudonyms for personal data that keep the format, as SQL expressions only.

E-mail addresses, payment cards, IBANs, IPv4 addresses, dates, US social security numbers and telephone numbers are found by
pattern and validated (Luhn and mod-97 check digits, IBAN lengths, octet ranges, calendar, numbering plans); what is not valid stays as it
is. A valid value is mapped by a keyed Feistel network of eight rounds over its own format: characters
move within digits, lower or upper case; dates within 1900 to 2099; addresses within 32 bits. Where the
permuted value falls outside the format (an area code may not start with 1) the network is applied again until it is inside,
which keeps the mapping one-to-one; check digits are computed anew.

A value is permuted without its separators and, where case does not tell values apart (IBANs, e-mail), in one case; separators and case
are put back, so equal values get equal pseudonyms whatever their spelling and document. A country's calling code stays, and is read
from the digits alone by the numbering plan; a North American number is one value with and without +1. A trunk zero in parentheses, which is not dialled from
abroad (+44 (0)20), is no part of the number and stays; in Italy it is one. An IBAN keeps its country. Of an
e-mail address the local part and the domain without its last label are permuted, each by itself, so that addresses of one domain stay together. Both may have any Latin letters;
those of Latin-1 with marks move among themselves, others beyond a to z stay.

Dates are written as they were read: years first or last, with dots, slashes or dashes, days and months of one digit too. Those with slashes are read as month, day, year where that
is a date and as day, month, year otherwise, so 05/12/1999 is always the twelfth of May; those with dashes and the year last the other way round.

The round function is SHA-256 of key, kind, round, place and the other half. Every row is handled by itself: no shuffle,
nothing collected. The key is a literal in the query plan; keep plans as secret as the key.

Defined results: null texts stay null, with counts of 0; empty texts stay empty; repeated values and rows map alike; texts are read
whole; an empty table gives an empty one. Other columns are kept, whatever their names, except those with the names of the added ones (n_<kind>).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import fresh

KINDS = ("email", "iban", "ip", "date", "phone", "card", "ssn")
ROUNDS = 8
_DATE_RADIX, _DATE_DAYS = 271, 73_049  # 271^2 is the least square that holds the days from 1900-01-01 to 2099-12-31
# fixed values: the lengths of IBANs by country (ISO 13616)
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Letters with marks that are permuted among themselves, all with a capital of one character.
MARKED = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
# fixed values: calling codes of one and two digits (ITU E.164); all others have three
_CODE = "^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
_IBAN = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
#: One pattern, alternatives in the order in which they are tried; loops over groups are bounded, so that no text deepens the matcher's stack.
PATTERN = "|".join((
    r"(?<![\p{IsLatin}\p{M}0-9._%+-])[\p{IsLatin}0-9][\p{IsLatin}\p{M}0-9._%+-]{0,63}@[\p{IsLatin}\p{M}0-9-]{1,63}(?:\.[\p{IsLatin}\p{M}0-9-]{1,63}){0,6}\.[A-Za-z]{2,24}",
    rf"(?<![A-Za-z0-9])(?i:{_IBAN})(?![A-Za-z0-9])",
    r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])",
    r"(?<![0-9A-Za-z./-])[0-9]{4}(?:-[0-9]{2}-[0-9]{2}|/[0-9]{2}/[0-9]{2})(?![0-9]|[/-][0-9])",
    r"(?<![0-9A-Za-z./-])(?:[0-9]{1,2}\.[0-9]{1,2}\.|[0-9]{1,2}/[0-9]{1,2}/|[0-9]{1,2}-[0-9]{1,2}-)[0-9]{4}(?![0-9]|[./-][0-9])",
    r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])",
    r"(?<![0-9A-Za-z.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]|-[0-9])",
    r"(?<![0-9A-Za-z.-])[0-9]{4}\.[0-9]{4}\.[0-9]{4}\.[0-9]{4}(?![0-9A-Za-z]|[.-][0-9])",
    r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    r"(?<![0-9A-Za-z(+-])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9A-Za-z-])",
))


def _q(text: str) -> str:
    """A SQL string literal."""
    return "r'" + text + "'" if "'" not in text and "\\" in text else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def luhn_sum(digits: str, shift: int) -> str:
    """Of a digit string; shift 0 where its last digit is the check digit, 1 where that is missing."""
    return (
        f"aggregate(transform(split(reverse({digits}), ''), (lc, li) -> CASE WHEN lc = '' THEN 0 WHEN (li + {shift}) % 2 = 0 THEN int(lc)"
        f" ELSE int(lc) * 2 - CASE WHEN int(lc) > 4 THEN 9 ELSE 0 END END), 0, (la, lb) -> la + lb)"
    )


def mod97(x: str) -> str:
    """Of a string of digits and capitals, these read as 10 to 35."""
    value = "(CASE WHEN mc RLIKE '^[0-9]$' THEN int(mc) ELSE ascii(mc) - 55 END)"
    return f"aggregate(filter(split({x}, ''), mc -> mc <> ''), 0, (ma, mc) -> (ma * CASE WHEN mc RLIKE '^[0-9]$' THEN 10 ELSE 100 END + {value}) % 97)"


def _random(key: str, kind: str, rnd: str, place: str, half: str) -> str:
    """28 bits of the round function."""
    return f"conv(substr(sha2(concat_ws('|', {_q(key)}, '{kind}', {rnd}, {place}, {half}), 256), 1, 7), 16, 10)"


def feistel_text(x: str, kind: str, key: str) -> str:
    """Permutes digits, lower and upper case letters, and those with marks, among themselves; other characters stay."""
    step = _random(key, kind, "fr", "fi", "fs.b")
    moved = (
        f"CASE WHEN fc RLIKE '^[0-9]$' THEN char(48 + int((ascii(fc) - 48 + {step}) % 10))"
        f" WHEN fc RLIKE '^[a-z]$' THEN char(97 + int((ascii(fc) - 97 + {step}) % 26))"
        f" WHEN fc RLIKE '^[A-Z]$' THEN char(65 + int((ascii(fc) - 65 + {step}) % 26))"
        f" WHEN fc <> '' AND instr('{MARKED}', fc) > 0 THEN substr('{MARKED}', 1 + int((instr('{MARKED}', fc) - 1 + {step}) % {len(MARKED)}), 1) ELSE fc END"
    )
    turned = f"array_join(transform(split(fs.a, ''), (fc, fi) -> {moved}), '')"
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('a', substr({x}, 1, length({x}) div 2), 'b', substr({x}, length({x}) div 2 + 1)),"
        f" (fs, fr) -> named_struct('a', fs.b, 'b', {turned}), fs -> concat(fs.a, fs.b))"
    )


def feistel_number(x: str, radix: int, kind: str, key: str) -> str:
    """Permutes the numbers from 0 to radix^2 - 1."""
    step = _random(key, kind, "nr", "'n'", "ns.b")
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('a', bigint({x}) div {radix}, 'b', bigint({x}) % {radix}),"
        f" (ns, nr) -> named_struct('a', ns.b, 'b', (ns.a + bigint({step})) % {radix}), ns -> ns.a * {radix} + ns.b)"
    )


def walk(x: str, valid: str, once: str) -> str:
    """Applies ``once`` (to ``w``) until ``valid`` (of ``w``) holds: a permutation of the valid values. A chance of 10^-21 or less to need more rounds fails the job."""
    steps = f"aggregate(sequence(1, 48), {x}, (w, wi) -> CASE WHEN wi > 1 AND {valid} THEN w ELSE {once} END"
    return f"{steps}, w -> CASE WHEN {valid} THEN w ELSE raise_error('no value of the format in 48 rounds') END)"


def bound(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is so computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def refill(x: str, values: str, pattern: str) -> str:
    """Puts the characters of ``values`` in place of the characters of ``x`` that match, in lower case where those are."""
    put = f"CASE WHEN rc RLIKE '^[a-z]$' THEN lower(substr({values}, rs.k, 1)) WHEN rc <> lower(rc) THEN upper(substr({values}, rs.k, 1)) ELSE substr({values}, rs.k, 1) END"
    return (
        f"aggregate(split({x}, ''), named_struct('o', '', 'k', 1), (rs, rc) -> CASE WHEN rc RLIKE '{pattern}'"
        f" THEN named_struct('o', concat(rs.o, {put}), 'k', rs.k + 1) ELSE named_struct('o', concat(rs.o, rc), 'k', rs.k) END, rs -> rs.o)"
    )


_SSN = "^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$"
_NANP = "^[2-9][0-9]{2}[2-9][0-9]{6}$"
_DATE_FORMS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "MM/dd/yyyy", "dd/MM/yyyy", "dd-MM-yyyy", "MM-dd-yyyy", "d.M.yyyy", "M/d/yyyy", "d/M/yyyy", "d-M-yyyy", "M-d-yyyy")  # tried in this order


def _date(x: str) -> str:
    return f"coalesce({', '.join(f'try_to_date({x}, {_q(form)})' for form in _DATE_FORMS)})"


def _trunk(x: str) -> str:
    """A number with its trunk zero, if it has one, marked."""
    return f"CASE WHEN {x} LIKE '+39%' THEN {x} ELSE replace({x}, '(0', '(\\u0001') END"


def kind_of(x: str) -> str:
    """SQL for the kind of a match, null if it is not valid."""
    d = _digits(x)
    compact = f"upper(replace({x}, ' ', ''))"
    iban = f"{mod97(f'concat(substr({compact}, 5), substr({compact}, 1, 4))')} = 1"
    octets = f"forall(split({x}, '[.]'), io -> int(io) <= 255 AND (length(io) = 1 OR io NOT LIKE '0%'))"
    day = f"{_date(x)} >= DATE'1900-01-01' AND {_date(x)} < DATE'2100-01-01'"
    number = _digits(_trunk(x))
    dialled = f"length({number}) BETWEEN 8 AND 15 AND ({d} NOT LIKE '1%' OR substr({d}, 2) RLIKE '{_NANP}')"
    return (
        f"CASE WHEN {x} LIKE '%@%' THEN 'email'"
        f" WHEN {x} RLIKE '^[A-Za-z]' THEN CASE WHEN {iban} THEN 'iban' END"
        f" WHEN {x} RLIKE r'^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$' THEN CASE WHEN {octets} THEN 'ip' END"
        f" WHEN {x} RLIKE r'^([0-9]{{4}}[/-][0-9]{{2}}[/-][0-9]{{2}}|[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-][0-9]{{4}})$' THEN CASE WHEN {day} THEN 'date' END"
        f" WHEN {x} LIKE '+%' THEN CASE WHEN {dialled} THEN 'phone' END"
        f" WHEN {x} RLIKE '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' THEN CASE WHEN {d} RLIKE '{_SSN}' THEN 'ssn' END"
        f" WHEN length({d}) = 10 THEN 'phone'"
        f" WHEN length({d}) BETWEEN 13 AND 19 THEN CASE WHEN {d} NOT LIKE '0%' AND {luhn_sum(d, 0)} % 10 = 0 THEN 'card' END END"
    )


def _card(x: str, key: str) -> str:
    """The first digit stays, the last is the check digit."""
    d = _digits(x)
    body = f"concat(substr({d}, 1, 1), {feistel_text(f'substr({d}, 2, length({d}) - 2)', 'card', key)})"
    return bound("cp", body, f"concat(cp, string((10 - {luhn_sum('cp', 1)} % 10) % 10))")


def _account(x: str, key: str) -> str:
    """Country, check digits anew, and the rest permuted; without spaces, in capitals."""
    compact = f"upper(replace({x}, ' ', ''))"
    check = f"lpad(string(98 - {mod97(f"concat(ip, substr({compact}, 1, 2), '00')")}), 2, '0')"
    return bound("ip", feistel_text(f"substr({compact}, 5)", "iban", key), f"concat(substr({compact}, 1, 2), {check}, ip)")


def _address(x: str, key: str) -> str:
    number = f"aggregate(split({x}, '[.]'), 0L, (ia, io) -> ia * 256 + int(io))"
    return bound("iv", feistel_number(number, 65536, "ip", key), "concat_ws('.', iv div 16777216, (iv div 65536) % 256, (iv div 256) % 256, iv % 256)")


def _day(x: str, key: str) -> str:
    moved = walk(f"bigint(datediff({_date(x)}, DATE'1900-01-01'))", f"w < {_DATE_DAYS}", feistel_number("w", _DATE_RADIX, "date", key))
    shown = "date_add(DATE'1900-01-01', int(dn))"
    cases = " ".join(f"WHEN try_to_date({x}, {_q(form)}) IS NOT NULL THEN date_format({shown}, {_q(form)})" for form in _DATE_FORMS)
    return bound("dn", moved, f"CASE {cases} END")


def _phone(x: str, key: str) -> str:
    """The calling code stays; North American numbers stay within their plan, with or without the code."""
    d = _digits(x)
    american = walk(f"right({d}, 10)", f"w RLIKE '{_NANP}'", feistel_text("w", "phone", key))
    code = f"CASE WHEN {d} RLIKE '{_CODE}' THEN length(regexp_extract({d}, '{_CODE}', 1)) ELSE 3 END"
    other = f"concat(substr({d}, 1, {code}), {feistel_text(f'substr({d}, {code} + 1)', 'phone', key)})"
    return f"CASE WHEN length({d}) = 10 AND {x} NOT LIKE '+%' OR {d} LIKE '1%' THEN concat(substr({d}, 1, length({d}) - 10), {american}) ELSE {other} END"


def _mail(x: str, key: str) -> str:
    """Local part and domain by themselves, in lower case; the last label stays."""
    local, domain = f"lower(substring_index({x}, '@', 1))", f"lower(substring_index({x}, '@', -1))"
    top = f"substring_index({domain}, '.', -1)"
    name = f"substr({domain}, 1, length({domain}) - length({top}))"
    return f"concat({feistel_text(local, 'email', key)}, '@', {feistel_text(name, 'domain', key)}, {top})"


def pseudonym(x: str, kind: str, key: str) -> str:
    """SQL for the pseudonym of a valid match ``x`` of a kind."""
    ssn = walk(_digits(x), f"w RLIKE '{_SSN}'", feistel_text("w", "ssn", key))
    cases = [f"WHEN 'ip' THEN {_address(x, key)}", f"WHEN 'date' THEN {_day(x, key)}"]
    for name, value, pattern in (("email", _mail(x, key), "^.$"), ("iban", _account(x, key), "^[0-9A-Za-z]$"), ("card", _card(x, key), "^[0-9]$"), ("ssn", ssn, "^[0-9]$")):
        cases.append(f"WHEN '{name}' THEN {bound('fv', value, refill(x, 'fv', pattern))}")
    number = bound("fv", _phone("px", key), refill("px", "fv", "^[0-9]$"))
    cases.append(f"WHEN 'phone' THEN {bound('px', _trunk(x), f"replace({number}, '\\u0001', '0')")}")
    return f"CASE {kind} {' '.join(cases)} ELSE {x} END"


def pseudonymise(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """All columns with the text rewritten, and n_<kind> for each kind: the values of it that were replaced."""
    added = [f"n_{k}" for k in KINDS]
    names = [c for c in df.columns if c not in added]
    found, new = fresh(df.columns, "found", "new")
    text = F.col(f"`{text_col}`")
    none = F.array().cast("array<string>")
    matches = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(none)
    rows = df.select(*[F.col(f"`{c}`") for c in names], F.coalesce(matches, none).alias(found))
    rows = rows.withColumn(found, F.expr(f"transform({found}, m -> named_struct('m', m, 'kind', {kind_of('m')}))"))
    rows = rows.withColumn(new, F.expr(f"transform({found}, s -> CASE WHEN s.kind IS NULL THEN s.m ELSE {pseudonym('s.m', 's.kind', key)} END)"))
    gaps = F.split(text, PATTERN, -1)
    joined = F.array_join(F.zip_with(gaps, F.col(new), lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")
    out = F.when(F.size(found) == 0, text).otherwise(joined)
    counts = [F.expr(f"size(filter({found}, s -> s.kind = '{k}'))").alias(f"n_{k}") for k in KINDS]
    return rows.select(*[out.alias(c) if c == text_col else F.col(f"`{c}`") for c in names], *counts)
