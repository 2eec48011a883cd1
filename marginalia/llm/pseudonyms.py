"""Format-preserving pseudonyms for personal data.

Validated numbers, dates and addresses are permuted by a keyed Feistel network within their own format: a card
number becomes another valid card number, a date another date. Equal values become equal pseudonyms in every
document, different ones stay different, none is its own pseudonym, and the key's holder can undo it.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import ipaddress
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import small_batches

ROUNDS = 10
DIGITS, HEX, LOWER, UPPER = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()


class Feistel:
    """A keyed permutation of 0 .. size - 1 (alternating Feistel network on two mixed-radix halves, cycle-walking)."""

    def __init__(self, key: bytes, kind: str, size: int) -> None:
        root = math.isqrt(max(size, 1) - 1) + 1 if size > 1 else 1
        self.size, self.root = size, root
        self.key, self.kind = key, f"{kind}:{size}:".encode()

    def _round(self, k: int, half: int) -> int:
        text = self.kind + f"{k}:{half}".encode()
        return int.from_bytes(hashlib.blake2b(text, key=self.key, digest_size=16).digest(), "big") % self.root

    def _once(self, x: int, back: bool) -> int:
        a, b = divmod(x, self.root)
        if back:
            for k in reversed(range(ROUNDS)):
                a, b = (b - self._round(k, a)) % self.root, a
        else:
            for k in range(ROUNDS):
                a, b = b, (a + self._round(k, b)) % self.root
        return a * self.root + b

    def _walk(self, x: int, back: bool) -> int:
        x = self._once(x, back)
        while x >= self.size:
            x = self._once(x, back)
        return x

    def __call__(self, x: int, back: bool = False) -> int:
        # one step along the circle into which the network puts all numbers: none stays in its place
        return self._walk((self._walk(x, False) + (-1 if back else 1)) % self.size, True)


def luhn_digit(payload: str) -> str:
    """The digit that makes ``payload`` and it a valid number."""
    total = 0
    for k, c in enumerate(reversed(payload)):
        d = int(c) * (1 + (k % 2 == 0))
        total += d - 9 * (d > 9)
    return str(-total % 10)


class Pseudonyms:
    """Replaces every kind of value in a text; ``back`` undoes it."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.ciphers: dict[tuple[str, int], Feistel] = {}

    def permute(self, kind: str, x: int, size: int, back: bool = False) -> int:
        if (kind, size) not in self.ciphers:
            self.ciphers[kind, size] = Feistel(self.key, kind, size)
        return self.ciphers[kind, size](x, back)

    def symbols(self, kind: str, value: str, back: bool, alphabets: tuple[str, ...] = (DIGITS, LOWER, UPPER)) -> str:
        """Digits to digits, letters to letters of their case and script; anything else stays in its place."""
        number, size = 0, 1
        sets = [next((s for s in alphabets if c in s), None) or _neighbours(c) for c in value]
        for c, s in zip(value, sets, strict=True):
            if s:
                number, size = number * len(s) + s.index(c), size * len(s)
        number = self.permute(kind, number, size, back)
        out = []
        for c, s in zip(reversed(value), reversed(sets), strict=True):
            if s:
                number, k = divmod(number, len(s))
                c = s[k]
            out.append(c)
        return "".join(reversed(out))

    def digits(self, kind: str, value: str, back: bool, valid: Callable[[str], bool] = lambda x: True) -> str:
        """The digits of ``value`` permuted among those that are valid; what stands between them stays."""
        plain = re.sub(r"\D", "", value)
        new = f"{self.permute(kind, int(plain), 10 ** len(plain), back):0{len(plain)}d}"
        while not valid(new):
            new = f"{self.permute(kind, int(new), 10 ** len(plain), back):0{len(plain)}d}"
        each = iter(new)
        return re.sub(r"\d", lambda _: next(each), value)

    def card(self, value: str, back: bool) -> str:
        plain = re.sub(r"\D", "", value)
        if luhn_digit(plain[:-1]) != plain[-1]:
            return self.digits("number", value, back, lambda x: luhn_digit(x[:-1]) != x[-1])
        body = f"{self.permute('card', int(plain[:-1]), 10 ** (len(plain) - 1), back):0{len(plain) - 1}d}"
        each = iter(body + luhn_digit(body))
        return re.sub(r"\d", lambda _: next(each), value)

    def phone(self, value: str, back: bool) -> str:
        country = re.match(r"(?:\+|00(?=[1-9]))\d{1,3}(?=[ .(-])|", value)[0]
        rest = value[len(country) :]
        if country[:2] == "00":  # without the plus sign a card could begin here
            return country + self.digits("phone", rest, back, lambda x: len(country + x) < 13 or luhn_digit((country + x)[:-1]) != x[-1])
        if rest.isdigit() and not country:  # ten digits in a row are a number only in one country's plan: so is the pseudonym
            return self.digits("phone0", rest, back, _PLAN)
        zeros = re.sub(r"\D", "", rest).startswith("00")  # else a country's number would begin here
        return country + self.digits("phone", rest, back, lambda x: (rest[0] != "+" or x[0] != "0") and (bool(country) or x.startswith("00") == zeros))

    def ssn(self, value: str, back: bool) -> str:
        return self.digits("ssn", value, back, lambda x: _SSN(x) is not None)

    def iban(self, value: str, back: bool) -> str:
        plain = value.replace(" ", "")
        body = self.symbols("iban" + plain[:2].upper(), plain[4:], back)
        check = 98 - int("".join(str(int(c, 36)) for c in body + plain[:2] + "00")) % 97
        each = iter(f"{plain[:2]}{check:02d}{body}")
        return re.sub(r"\S", lambda _: next(each), value)

    def address(self, value: str, back: bool) -> str:
        number = int.from_bytes(bytes(map(int, value.split("."))), "big")
        return ".".join(map(str, self.permute("ipv4", number, 1 << 32, back).to_bytes(4, "big")))

    def ipv6(self, value: str, back: bool) -> str:
        return self.symbols("ipv6", value, back, (DIGITS, HEX[10:], HEX[10:].upper()))

    def email(self, value: str, back: bool) -> str:
        name, _, domain = value.partition("@")
        return f"{self.symbols('email:' + domain.lower(), name, back)}@{domain}"

    def secret(self, value: str, back: bool) -> str:
        number = self.permute("hex", int(value, 16), 16 ** len(value), back)
        new = f"{number:0{len(value)}x}"
        return new.upper() if value.upper() == value else new

    def day(self, day: dt.date, back: bool, fits: Callable[[dt.date], bool]) -> dt.date:
        """Another one of the days that fit, of which ``day`` is one."""
        while True:
            number = self.permute("date", day.toordinal() - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, back)
            day = dt.date.fromordinal(FIRST_DAY + number)
            if fits(day):
                return day

    def date(self, value: str, back: bool) -> str:
        if named := _named(value):
            styles, day, wide = named
            new = self.day(day, back, lambda x: styles[x.month - 1] is not None and len(str(x.day)) <= wide)
            return re.sub(r"\w+", lambda x: styles[new.month - 1] if x[0].isalpha() else str(new.year) if len(x[0]) == 4 else f"{new.day:0{wide}d}", value)
        parts = re.split(r"(\D)", value)
        year_first = len(parts[0]) == 4
        month_first = not year_first and int(parts[2]) > 12
        y, m, d = (0, 2, 4) if year_first else (4, 0, 2) if month_first else (4, 2, 0)
        wide = {k: len(parts[k]) for k in (y, m, d)}
        # a month first has a day above 12, else it would read as day first; one digit has room for nine days or months
        fits = lambda x: (not month_first or x.day > 12) and len(str(x.day)) <= wide[d] and len(str(x.month)) <= wide[m]
        new = self.day(dt.date(int(parts[y]), int(parts[m]), int(parts[d])), back, fits)
        for k, number in ((y, new.year), (m, new.month), (d, new.day)):
            parts[k] = f"{number:0{wide[k]}d}"
        return "".join(parts)

    def token(self, value: str, back: bool) -> str:
        start = _PREFIX.match(value)[0]
        return start + self.symbols("token:" + start, value[len(start) :], back)

    def text(self, text: str, back: bool = False) -> tuple[str, dict[str, int]]:
        """``text`` with its personal data replaced, and how many values of each kind were."""
        counts: dict[str, int] = {}

        if not _HINT.search(text):
            return text, counts
        out, at, place, failed = [], 0, 0, 0
        while match := PATTERN.search(text, place):
            kind = next(k for k in VALID if match[k] is not None)
            value = match[kind]
            # within a failed match any digits may stand together: only card-like groups count there
            if not VALID[kind](value) or (kind == "card" and match.start() < failed and not _GROUPED(value)):
                failed = max(failed, match.end())
                kind, value = next(_others(text, match.start()), (None, ""))
            if kind is None:
                place = match.start() + 1
                continue
            counts[kind] = counts.get(kind, 0) + 1
            out += [text[at : match.start()], getattr(self, kind)(value, back)]
            at = place = match.start() + len(value)
        return "".join([*out, text[at:]]), counts


def _neighbours(c: str) -> str | None:
    """The letters of a letter's case and kind among the 64 code points around it."""
    if not c.isalpha():
        return None
    around = (chr(k) for k in range(ord(c) & ~63, (ord(c) | 63) + 1))
    return "".join(x for x in around if x.isalpha() and x.islower() == c.islower() and x.isupper() == c.isupper())


def _shorter(text: str, start: int, kind: str) -> str:
    """The longest valid card or IBAN at a place, its last groups left out if need be; else nothing."""
    match = KINDS[kind].match(text, start)
    value = match[0] if match else ""
    while value:
        if (kind == "iban" or 13 <= len(re.sub(r"\D", "", value)) and _GROUPED(value)) and VALID[kind](value):
            return value
        value = value[: max(value.rfind(" "), value.rfind("-"), 0)]
    return ""


def _others(text: str, start: int) -> Iterator[tuple[str, str]]:
    """Valid values of any kind at a place where the first match isn't one."""
    for kind, pattern in KINDS.items():
        if kind in ("card", "iban"):
            value = _shorter(text, start, kind)
        else:
            match = pattern.match(text, start)
            value = match[0] if match and VALID[kind](match[0]) else ""
        # a phone number has no check: a card that begins within it goes before it
        if value and not (kind == "phone" and any(_shorter(text, k, "card") for k in range(start + 1, start + len(value)))):
            yield kind, value


def _named(value: str) -> tuple[list[str | None], dt.date, int] | None:
    """Of a date with its month's name: names of that style, the day, and digits of the day of the month; None if it is none."""
    one, two, year = re.findall(r"\w+", value)
    month, day = (one, two) if one.isalpha() else (two, one)
    for styles in MONTHS:
        if month in styles:
            try:
                return styles, dt.date(int(year), styles.index(month) + 1, int(day)), len(day)
            except ValueError:
                return None
    return None


def _valid_date(value: str) -> bool:
    if any(x.isalpha() for x in value):
        named = _named(value)
        return named is not None and FIRST_DAY <= named[1].toordinal() <= LAST_DAY
    parts = re.split(r"\D", value)
    y, m, d = parts if len(parts[0]) == 4 else reversed(parts)
    if len(parts[0]) < 4 and int(m) > 12:  # month first
        m, d = d, m
    try:
        return FIRST_DAY <= dt.date(int(y), int(m), int(d)).toordinal() <= LAST_DAY
    except ValueError:
        return False


def _valid_ipv6(value: str) -> bool:
    groups = re.findall(r"[0-9a-fA-F]+", value)
    # names in a programming language have double colons too
    if len(groups) < 2 or not re.search(r"\d", value if len(groups) > 2 else groups[0]) or (len(groups) == 2 and len(groups[0]) < 4):
        return False
    try:
        return bool(ipaddress.IPv6Address(value))
    except ValueError:
        return False


def _valid_iban(value: str) -> bool:
    plain = value.replace(" ", "")
    if plain.upper() != plain and plain.lower() != plain:
        return False
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


_SSN = re.compile(r"(?!000|666|9\d\d)\d{3}(?!00)\d{2}(?!0000)\d{4}").fullmatch
_GROUPED = re.compile(r"\d{3,}(?:[ -]\d{3,})*").fullmatch
_PLAN = re.compile(r"[2-9]\d{9}").fullmatch
#: Months by their full names and by short ones; May, which is both, stands alone.
_FULL = "January February March April May June July August September October November December".split()
MONTHS = [
    [None if x == "May" else x for x in _FULL],
    [None if x == "May" else x[:3] for x in _FULL],
    [x if x == "May" else None for x in _FULL],
]
_MONTH = "(?:" + "|".join(sorted({x for style in MONTHS for x in style if x}, key=len, reverse=True)) + ")"
#: Keys whose beginning tells what they are.
_PREFIX = re.compile(r"AKIA|ASIA|gh[pousr]_|sk-")
_HINT = re.compile(rf"[0-9@]|{_PREFIX.pattern}")

#: What is looked for, in this order at each place. Values end where no letter or digit follows.
_PATTERN = (
    r"(?P<email>(?<![\w.+-])[^\W_][\w.%+-]*@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,})"
    r"|(?P<token>(?<![\w-])(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,255}|sk-[A-Za-z0-9_-]{20,255})(?![\w-]))"
    r"|(?P<secret>(?<!\w)(?=[a-fA-F]*\d)(?=\d*[a-fA-F])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?!\w))"
    r"|(?P<iban>(?<!\w)(?:[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?|[a-z]{2}\d{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,4})?)(?!\w))"
    r"|(?P<ipv6>(?<![\w:.])(?=[0-9A-Fa-f:]{0,34}\d)(?:[0-9A-Fa-f]{4}::[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:|:(?=:)){2,7}(?::?[0-9A-Fa-f]{1,4}|:)(?::[0-9A-Fa-f]{1,4}){0,6})(?![\w:]))"
    r"|(?P<address>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d))"
    rf"|(?P<date>(?<![\w./-])(?:\d{{4}}-\d\d-\d\d(?=T\d)|(?:\d{{4}}-\d\d-\d\d|\d{{4}}/\d\d/\d\d|\d\d?[./-]\d\d?[./-]\d{{4}}|\d\d? {_MONTH},? \d{{4}}|{_MONTH} \d\d?,? \d{{4}})(?![\w]|[./-]\d)))"
    r"|(?P<ssn>(?<![\w-])\d{3}(?P<gap>[ -])\d\d(?P=gap)\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w]|[.-]\d))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]\d{4}(?![\w]|[.-]\d)"
    r"|(?<![\w.,+-])[2-9]\d{9}(?![\w]|[.,-]\d)|(?<![\w+])\+[1-9]\d{0,2}[ .-]?(?:\(\d{1,5}\)|\d{1,5})(?:[ .-]?\d{2,8}){1,4}(?![\w]|[.-]\d)"
    r"|(?<![\w.,+-])00[1-9]\d{0,2}[ .-](?:\(\d{1,5}\)|\d{1,5})(?:[ .-]?\d{2,8}){1,4}(?![\w]|[.-]\d))"
)
PATTERN = re.compile(_PATTERN)
#: The pattern of each kind alone.
KINDS = {x[4 : x.index(">")]: re.compile(x) for x in re.split(r"\|(?=\(\?P<)", _PATTERN)}

VALID: dict[str, Callable[[str], bool]] = {
    "email": lambda v: True,
    "token": lambda v: True,
    "secret": lambda v: True,
    "iban": _valid_iban,
    "address": lambda v: all(int(p) < 256 and str(int(p)) == p for p in v.split(".")),
    "date": _valid_date,
    "ipv6": _valid_ipv6,
    "ssn": lambda v: _SSN(re.sub(r"\D", "", v)) is not None,
    # separators make a run of digits a card only if it checks; sixteen digits in a row are one anyway
    "card": lambda v: (p := re.sub(r"\D", "", v)) and (luhn_digit(p[:-1]) == p[-1] or (v.isdigit() and len(v) == 16)),
    "phone": lambda v: 8 <= len(re.sub(r"\D", "", v)) <= 15,
}


def pseudonymize(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with its text's personal data replaced, ``n_pii`` long and ``pii_kinds`` (sorted, each once).

    Whole texts are read. Null texts stay null with 0 and no kinds; texts without personal data pass
    unchanged. Repeated rows and equal values get the same pseudonyms. Columns named as the new ones are
    replaced; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("text string, n_pii bigint, pii_kinds array<string>")
    def replace(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Pseudonyms(key)
        for texts in batches:
            rows = [own.text(t) if isinstance(t, str) else (None, {}) for t in texts]
            yield pd.DataFrame(
                {"text": [t for t, _ in rows], "n_pii": [sum(c.values()) for _, c in rows], "pii_kinds": [sorted(c) for _, c in rows]}
            )

    own = [c for c in docs.columns if c not in ("n_pii", "pii_kinds")]
    # the caller's columns in one struct: no name of theirs meets ours
    new = docs.select(F.struct(*own).alias("row"), replace(F.col(text_col)).alias("new"))
    return new.select(*[F.col("new.text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in own], "new.n_pii", "new.pii_kinds")
