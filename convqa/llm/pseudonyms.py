"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass their own validity check (card check digit, IBAN remainder, calendar, address ranges), mail names, telephone
numbers and secrets are replaced by a keyed permutation of the values of the same format: a Feistel network on the
mixed-radix number that the characters spell, walked until it falls into the format's range. The same value under the same
key becomes the same pseudonym in every document and on every executor, so links stay and nothing is shuffled.

Letters and digits of other scripts are permuted inside their own neighbourhood of the code table. Telephone numbers are found
with a country code, in the groups of common national forms, and undivided from ten digits on (nine with a leading zero).

Defined results: null text stays null with no findings; other columns pass through; a replacement keeps its
length except for addresses, whose numbers may get longer or shorter. A permutation may map a value to itself with
probability one over the size of its format; such a value is not reported as replaced.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from convqa.llm.arrow import add_columns

ROUNDS = 10
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HEX, HEX_UP = "0123456789abcdef", "0123456789ABCDEF"
FIRST_DAY, DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()


def permute(value: int, size: int, key: bytes, kind: str) -> int:
    """Keyed permutation of ``range(size)``."""
    if size < 2:
        return value
    width = 1
    while width * width < size:
        width *= 2
    secret = hashlib.blake2b(f"{kind}:{size}".encode(), key=key[:64], digest_size=32).digest()
    while True:
        left, right = divmod(value, width)
        for r in range(ROUNDS):
            mix = hashlib.blake2b(r.to_bytes(1, "big") + right.to_bytes(32, "big"), key=secret, digest_size=32).digest()
            left, right = right, (left + int.from_bytes(mix, "big")) % width
        value = left * width + right
        if value < size:
            return value


@lru_cache(1 << 16)
def alphabet(c: str) -> str:
    """Characters that may stand for a letter, digit or mark: those of its category nearby; empty for other characters."""
    for own in (DIGITS, LOWER, UPPER):
        if c in own:
            return own
    kind = unicodedata.category(c)
    if kind[0] not in "LMN":
        return ""
    for width in (1 << 7, 1 << 10, 1 << 13):
        first = max(128, ord(c) // width * width)
        found = "".join(x for x in map(chr, range(first, ord(c) // width * width + width)) if unicodedata.category(x) == kind)
        if len(found) > 1:
            return found
    return ""


def permute_text(text: str, key: bytes, kind: str) -> str:
    """Letters and digits permuted inside their own classes; other characters stay where they are."""
    used = [c for c in text if alphabet(c)]
    plain = "".join(used)
    if len(plain) < 16 or not plain.strip(DIGITS):
        sets = [alphabet(c) for c in plain]
    elif not plain.strip(HEX):
        sets = [HEX] * len(plain)
    elif not plain.strip(HEX_UP):
        sets = [HEX_UP] * len(plain)
    else:
        sets = [alphabet(c) for c in plain]
    out: list[str] = []
    for start in range(0, len(plain), 40):  # keeps the numbers inside one hash
        part, kinds = plain[start:start + 40], sets[start:start + 40]
        value, size = 0, 1
        for c, s in zip(part, kinds):
            value, size = value * len(s) + s.index(c), size * len(s)
        shape = kind + "".join(s[0] for s in kinds) + str(start)
        value = permute(value, size, key, shape)
        made = []
        for s in reversed(kinds):
            value, i = divmod(value, len(s))
            made.append(s[i])
        out += reversed(made)
    given = iter(out)
    return "".join(next(given) if alphabet(c) else c for c in text)


def luhn(digits: str) -> int:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10


def fill_digits(shape: str, digits: str) -> str:
    given = iter(digits)
    return "".join(next(given) if c in DIGITS else c for c in shape)


def only_digits(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def card(text: str, key: bytes) -> str:
    """A long number; one with a right check digit gets another with a right check digit."""
    digits = only_digits(text)
    if luhn(digits):
        return fill_digits(text, permute_text(digits, key, "number"))
    body = permute_text(digits[:-1], key, "card")
    return fill_digits(text, body + str((10 - luhn(body + "0")) % 10))


def iban_rest(text: str) -> int:
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


# characters of an account number by country, grouped by length
IBAN_SIZES = {country: size for size, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for country in countries.split()}


def iban_end(text: str) -> int:
    """Where the account number at the start of ``text`` ends; 0 if there is none. Words behind it may have been matched with it."""
    at = [k + 1 for k, c in enumerate(text) if c != " "]
    size = IBAN_SIZES.get(text[:2].upper())
    if size and len(at) >= size and not text[at[size - 1]:at[size - 1] + 1].strip() and iban_rest(text[:at[size - 1]]) == 1:
        return at[size - 1]
    return len(text) if text == text.upper() and 15 <= len(at) <= 34 and iban_rest(text) == 1 else 0


def iban(text: str, key: bytes) -> str | None:
    """The number in upper case is replaced, so both writings keep one pseudonym; words matched behind it stay."""
    end = iban_end(text)
    if not end:
        return None
    head, plain = text[:2].upper(), text[:end].replace(" ", "")[4:].upper()
    body = permute_text(plain, key, "iban" + head)
    check = f"{98 - int(''.join(str(int(c, 36)) for c in body + head) + '00') % 97:02d}"
    given = iter(head + check + body)
    return "".join(c if c == " " else next(given).lower() if c.islower() else next(given) for c in text[:end]) + text[end:]


def address(text: str, key: bytes) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255:
        return None
    value = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "address")
    return ".".join(map(str, value.to_bytes(4, "big")))


def date(text: str, key: bytes) -> str | None:
    """Calendar day in year-first or day/month-first order; the order and separators stay."""
    numbers = re.split(r"\D", text)
    orders = ((0, 1, 2),) if len(numbers[0]) == 4 else ((2, 1, 0), (2, 0, 1))
    for y, m, d in orders:
        try:
            day = datetime.date(int(numbers[y]), int(numbers[m]), int(numbers[d])).toordinal() - FIRST_DAY
        except ValueError:
            continue
        if not 0 <= day < DAYS:
            return None
        new = datetime.date.fromordinal(FIRST_DAY + permute(day, DAYS, key, "date"))
        made = {y: f"{new.year:04d}", m: f"{new.month:02d}", d: f"{new.day:02d}"}
        given = iter(made[k] for k in range(3))
        return re.sub(r"\d+", lambda _: next(given), text)
    return None


def social(text: str, key: bytes) -> str | None:
    area, group, serial = (int(p) for p in re.split(r"\D", text))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    areas = [a for a in range(1, 900) if a != 666]
    value = permute((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, len(areas) * 99 * 9999, key, "social")
    value, serial = divmod(value, 9999)
    area, group = divmod(value, 99)
    return fill_digits(text, f"{areas[area]:03d}{group + 1:02d}{serial + 1:04d}")


TWO_DIGIT_COUNTRIES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
THREE_THREE_FOUR = re.compile(r"\(?\d{3}(?:\)[ .-]?|[ .-])\d{3}[ .-]?\d{4}")


def phone(text: str, key: bytes) -> str | None:
    """Country code and leading zero stay, so a number with and without them keeps one pseudonym."""
    digits = only_digits(text)
    if not 8 <= len(digits) <= 15:
        return None
    if text.startswith("+") or digits.startswith("00"):
        lead = 0 if text.startswith("+") else 2
        lead += 1 if digits[lead] in "17" else 2 if digits[lead:lead + 2] in TWO_DIGIT_COUNTRIES else 3
        # a zero kept behind the country code, as in +44 (0)20
        lead += digits[lead:lead + 1] == "0" and "(0)" in text
    elif digits.startswith("0") and not THREE_THREE_FOUR.fullmatch(text):
        if len(digits) < 9:
            return None
        lead = 1
    else:
        lead = max(0, len(digits) - 10)
    return fill_digits(text, digits[:lead] + permute_text(digits[lead:], key, "phone"))


def mail(text: str, key: bytes) -> str:
    name, _, domain = text.rpartition("@")
    return permute_text(name, key, "mail:" + domain.lower()) + "@" + domain


def secret(text: str, key: bytes) -> str:
    return permute_text(text, key, "secret")


# marks that are part of words in many scripts, but not of \w
_MARKS = "".join(c for c in map(chr, range(0x300, 0x1F000)) if unicodedata.category(c)[0] == "M")
_NAME = rf"[\w{_MARKS}.%+-]"
_NUMBER = r"(?<![\w.])"
_END = r"(?!\w)(?!\.\d)"
# (kind, what a text must hold to be searched, pattern whose first group is the value, replacement); earlier kinds win.
KINDS: tuple[tuple[str, str, re.Pattern, Callable[[str, bytes], str | None]], ...] = (
    ("mail", "@", re.compile(rf"(?<!{_NAME})({_NAME}++@(?:[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+|[\w{_MARKS}-]++(?:\.[\w{_MARKS}-]++)+))"), mail),
    ("secret", "=:", re.compile(r"(?i)(?:token|secret|api[_ -]?key|access[_ -]?key|passw(?:or)?d|pwd)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9_+/.\-]{8,})"), secret),
    ("secret", "A_-", re.compile(r"(?<!\w)((?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,})"), secret),
    ("iban", DIGITS, re.compile(r"(?<!\w)([A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,3})?)(?!\w)"), iban),
    ("address", DIGITS, re.compile(_NUMBER + r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})" + _END), address),
    ("date", DIGITS, re.compile(_NUMBER + r"(\d{4}([-/.])\d{1,2}\2\d{1,2}|\d{1,2}([-/.])\d{1,2}\3\d{4})(?:(?=[Tt_]\d)|" + _END + ")"), date),
    ("social", DIGITS, re.compile(_NUMBER + r"(\d{3}-\d{2}-\d{4})" + _END), social),
    ("number", DIGITS, re.compile(_NUMBER + r"(?<!\+)(\d(?:[ -]?\d){12,18})" + _END), card),
    ("phone", DIGITS, re.compile(
        r"(?<![\w.])(\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,5}|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}[ .-]\d{3}[ .-]?\d{4}"
        r"|(?:\(0\d{1,5}\)|0\d{1,5}/?)(?:[ .-]?\d{2,4}){2,6}|(?<!-)(?:0\d{8,11}|\d{10,12}))" + _END), phone),
)
_DIGIT, _OTHER_DIGIT = re.compile(r"\d"), re.compile(r"[^\D0-9]")


def replace_private(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """New text, and (kind, start, end) of each replacement in code points of the new text."""
    digits = _DIGIT.search(text) is not None
    # digits of other scripts count as those of ASCII and come back in their script
    ascii_digits = _OTHER_DIGIT.sub(lambda m: str(unicodedata.decimal(m[0])), text) if digits and _OTHER_DIGIT.search(text) else text
    found: list[tuple[int, int, str, str]] = []
    for kind, needs, pattern, change in KINDS:
        if not digits if needs is DIGITS else not any(c in text for c in needs):
            continue
        for m in pattern.finditer(ascii_digits if needs is DIGITS else text):
            start, end = m.span(1)
            if any(start < e and s < end for s, e, _, _ in found):
                continue
            new = change(m[1], key)
            if new is None or new == m[1]:
                continue
            if kind == "iban":  # words may have been matched behind the number
                size = iban_end(m[1])
                end, new = start + size, new[:size]
            if ascii_digits is not text and needs is DIGITS and (other := _OTHER_DIGIT.search(text, start, end)):
                zero = ord(other[0]) - unicodedata.decimal(other[0])
                new = "".join(chr(zero + int(c)) if c in DIGITS else c for c in new)
            found.append((start, end, kind, new))
    if not found:
        return text, []
    parts, spans, last, at = [], [], 0, 0
    for start, end, kind, new in sorted(found):
        parts += [text[last:start], new]
        at += start - last
        spans.append((kind, at, at + len(new)))
        at += len(new)
        last = end
    return "".join([*parts, text[last:]]), spans


SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))


def pseudonymize(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """Input columns with the text replaced, and ``private``: the replacements as (kind, start, end)."""

    def make() -> Callable[[pa.Array], dict[str, pa.Array]]:
        def step(column: pa.Array) -> dict[str, pa.Array]:
            made = [(None, []) if t is None else replace_private(t, key) for t in column.to_pylist()]
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in m[1]] for m in made]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            return {text: pa.array([m[0] for m in made], pa.string()), "private": pa.array(spans, kind)}

        return step

    out = add_columns(docs, text, [StructField(text, StringType()), StructField("private", SPANS)], make)
    return out.select(*[f"`{c}`" for c in docs.columns if c != "private"], "private")


