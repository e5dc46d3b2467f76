"""Personal data: format-preserving pseudonyms by a keyed Feistel permutation.

Found in whole texts: e-mail addresses, payment card numbers (13 to 19 digits, Luhn), IBANs (mod 97), US social security
numbers (assigned ranges), phone numbers (with a country code, an area code in brackets, or as 3-3-4 digits), IPv4
addresses (each part below 256), calendar dates that exist (1900 to 2099) and hexadecimal secrets that are quoted or
follow the name of a key. Of an address all but the last part of the host is replaced, equal hosts alike. A number that fails its check is left alone, and what it holds or overlaps is searched on: an
IBAN may end at each blank, a card may be any groups of digits of a row of numbers. A card in a usual grouping goes before
one in another that overlaps it.

A value is read as a number in the mixed radix of its format (digits in place of digits, letters in place of letters of
the same alphabet and case; separators stay), permuted within that range by a balanced Feistel network of keyed BLAKE2b
rounds with cycle walking, and written in the same format; check digits are computed anew and dates stay dates, so a
pseudonym passes the check its original passed. The permutation of a format is f = P^-1(P(x) + 1): a bijection without
fixed points, so no value stays as it was, different values never meet, and equal values of a kind and format have
equal pseudonyms in every document (and only under the same key). Without the key it cannot be undone; with it, it can
(``reveal``). Where a pseudonym and the numbers beside it would be read as another card or IBAN, the permutation is applied
again until they are not, so there alone a value may have another pseudonym than elsewhere.

Nulls stay null, empty texts and texts without finds are unchanged; overlapping finds: the leftmost, then the first kind
of the list above, wins. Nothing depends on other rows: repeats, ties, null ids and empty tables need no care, and all
other columns are kept.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

ROUNDS = 8
#: For the registered query and the pipeline; a real run passes a secret of its own.
DEMO_KEY = b"replace this key"
DIGIT, LOWER, UPPER, HEX_LOWER, HEX_UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef", "0123456789ABCDEF"
LATIN_LOWER, LATIN_UPPER = ("".join(chr(c) for c in range(a, b) if chr(c).isalpha()) for a, b in ((0xDF, 0x100), (0xC0, 0xDF)))
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()

PATTERN = re.compile(
    r"""
    (?P<email>(?<![\w.%+-])[\w.%+-]++@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,})
  | (?P<secret>(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z]))
  | (?P<iban>\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b)
  | (?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d))
  | (?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))
  | (?P<date>(?<![\d./-])(?:\d{4}(?P<s1>[-/.])\d{2}(?P=s1)\d{2}|\d{2}(?P<s2>[-/.])\d{2}(?P=s2)\d{4})(?![\d/-]|\.\d))
  | (?P<local>(?<![\d.+-])\d{3}(?P<s3>[-.])\d{3}(?P=s3)\d{4}(?![\d-]|\.\d))
  | (?P<phone>(?<![\d+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d))
  | (?P<card>(?<![\d])\d(?:[ -]?\d){12,18}(?!\d))
    """,
    re.VERBOSE,
)
KINDS = {"email": "email", "secret": "secret", "iban": "iban", "ip": "ip", "ssn": "ssn", "date": "date", "s1": "date", "s2": "date", "local": "phone", "s3": "phone", "phone": "phone", "card": "card"}
#: What stands before a secret that is not in quotes.
NAMED = re.compile(r"""(?i)(?:key|token|secret|passw(?:or)?d)\W{0,2}\s{0,3}[:=]\s{0,3}\W?$""")
#: Characters of a part of an address that are permuted together.
PART = 64
IBAN = re.compile(r"[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?")
#: Groups of digits that can belong to a card which begins with the first, or to one that overlaps that.
GROUPS = re.compile(r"\d+(?:[ -]\d+){0,40}")
CARD_DIGITS = range(13, 20)
#: Usual groupings of cards, apart from all digits in one group.
GROUPINGS = ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4))
#: Characters before and after a value whose reading its digits can change: more than the longest card or IBAN.
BESIDE = 128
#: A text without any of these holds nothing to find.
HINT = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


class Feistel:
    """A keyed bijection of range(n) for each n and kind, and its inverse."""

    def __init__(self, key: bytes):
        self.key = key if len(key) <= hashlib.blake2b.MAX_KEY_SIZE else hashlib.blake2b(key).digest()

    def _round(self, kind: str, n: int, i: int, half: int, bits: int) -> int:
        of = half.to_bytes(-(-bits // 8) or 1, "big")
        more = hashlib.shake_256 if bits > 512 else None
        seed = f"{kind}/{n}/{i}/".encode() + of
        digest = more(self.key + seed).digest(-(-bits // 8)) if more else hashlib.blake2b(seed, key=self.key).digest()
        return int.from_bytes(digest, "big") & ((1 << bits) - 1)

    def _network(self, kind: str, n: int, x: int, order: range) -> int:
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        a, b = x >> bits, x & ((1 << bits) - 1)
        for i in order:
            if order.step > 0:
                a, b = b, a ^ self._round(kind, n, i, b, bits)
            else:
                a, b = b ^ self._round(kind, n, i, a, bits), a
        return a << bits | b

    def _walk(self, kind: str, n: int, x: int, order: range) -> int:
        while True:
            x = self._network(kind, n, x, order)
            if x < n:
                return x

    def shift(self, kind: str, n: int, x: int, by: int = 1) -> int:
        """P^-1(P(x) + by): without fixed points for n > 1; by=-1 undoes by=1."""
        if n < 2:
            return x
        y = (self._walk(kind, n, x, range(ROUNDS)) + by) % n
        return self._walk(kind, n, y, range(ROUNDS - 1, -1, -1))

    def chars(self, kind: str, text: str, alphabets: list[str | None], by: int = 1, valid: Callable[[str], bool] | None = None) -> str:
        """text with each character that has an alphabet permuted within all texts of that format (that are valid)."""
        places = [(i, a, {c: k for k, c in enumerate(a)}) for i, a in enumerate(alphabets) if a]
        n, x = 1, 0
        for i, a, rank in places:
            n, x = n * len(a), x * len(a) + rank[text[i]]
        name = f"{kind}:{len(text)}:{''.join('.' if a is None else a[0] for a in alphabets)}"
        while True:
            x = self.shift(name, n, x, by)
            out, y = list(text), x
            for i, a, _ in reversed(places):
                y, k = divmod(y, len(a))
                out[i] = a[k]
            if valid is None or valid("".join(out)):
                return "".join(out)


def _alphabet(c: str) -> str | None:
    return next((a for a in (DIGIT, LOWER, UPPER, LATIN_LOWER, LATIN_UPPER) if c in a), None)


@lru_cache(maxsize=10_000)
def _script(c: str) -> str | None:
    """The alphabet of a letter or digit; outside Latin-1 those of its category among the 128 code points around it."""
    if (known := _alphabet(c)) or not c.isalnum():
        return known
    first, kind = ord(c) & ~0x7F, unicodedata.category(c)
    near = "".join(x for x in map(chr, range(first, first + 128)) if x.isalnum() and unicodedata.category(x) == kind and not _alphabet(x))
    return near if len(near) > 1 else None


def _digits(text: str) -> list[str | None]:
    return [DIGIT if c in DIGIT else None for c in text]


def _ssn_assigned(s: str) -> bool:
    return s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"


def _date(s: str) -> tuple[date, tuple[int, int, int]] | None:
    """The day and the places of year, month and day; a two-digit start is a day unless only a month fits."""
    parts = re.split(r"[-/.]", s)
    orders = ((0, 1, 2),) if len(parts[0]) == 4 else ((2, 1, 0), (2, 0, 1))
    for o in orders:
        try:
            d = date(*(int(parts[k]) for k in o))
        except ValueError:
            continue
        if FIRST_DAY <= d.toordinal() <= LAST_DAY:
            return d, o
    return None


def _parts(kind: str, text: str, feistel: Feistel, by: int) -> str:
    """Letters and digits of a part of an address, whatever their script, permuted a stretch of PART at a time."""
    out = []
    for k in range(0, len(text), PART):
        piece = text[k : k + PART]
        alphabets = [_script(c) for c in piece]
        out.append(feistel.chars(f"{kind}{k}", piece, alphabets, by) if any(alphabets) else piece)
    return "".join(out)


def pseudonym(kind: str, value: str, feistel: Feistel, by: int = 1) -> str | None:
    """The pseudonym of a found value; None if it fails its kind's check."""
    if kind == "email":
        local, _, host = value.partition("@")
        end = host.rindex(".")
        new = _parts("local", local, feistel, by) + "@" + _parts("host", host[:end], feistel, by) + host[end:]
        return new if new != value else None
    if kind == "secret":
        return feistel.chars(kind, value, [HEX_UPPER if value.isupper() else HEX_LOWER] * len(value), by)
    if kind == "ip":
        parts = [int(p) for p in value.split(".")]
        if max(parts) > 255:
            return None
        y = feistel.shift(kind, 1 << 32, int.from_bytes(bytes(parts), "big"), by)
        return ".".join(map(str, y.to_bytes(4, "big")))
    if kind == "ssn":
        return feistel.chars(kind, value, _digits(value), by, _ssn_assigned) if _ssn_assigned(value) else None
    if kind == "date":
        found = _date(value)
        if not found:
            return None
        (d, order), n = found, LAST_DAY - FIRST_DAY + 1
        x, marks = d.toordinal() - FIRST_DAY, re.findall(r"[-/.]", value)
        while True:  # days whose text would be read in another order are passed over
            x = feistel.shift(f"date{order}", n, x, by)
            day = date.fromordinal(x + FIRST_DAY)
            parts = [""] * 3
            for k, v, w in zip(order, (day.year, day.month, day.day), (4, 2, 2), strict=True):
                parts[k] = f"{v:0{w}d}"
            out = parts[0] + marks[0] + parts[1] + marks[1] + parts[2]
            if _date(out) == (day, order):
                return out
    if kind == "iban":
        places = [i for i, c in enumerate(value) if c != " "]
        plain = "".join(value[i] for i in places)
        if len(plain) > 34 or mod97(plain) != 1:
            return None
        body = feistel.chars(f"iban{plain[:2]}", plain[4:], [_alphabet(c) for c in plain[4:]], by)
        new = plain[:2] + f"{98 - mod97(plain[:2] + '00' + body):02d}" + body
        out = list(value)
        for i, c in zip(places, new, strict=True):
            out[i] = c
        return "".join(out)
    if kind == "phone":
        national = value.index("(") if "(" in value else 0 if value[0] in DIGIT else re.match(r"\+\d{1,3}?(?=[ .-])|\+\d", value).end()
        return feistel.chars(kind, value, [None] * national + _digits(value[national:]), by)
    places = [i for i, c in enumerate(value) if c in DIGIT]  # card
    plain = "".join(value[i] for i in places)
    if not luhn(plain) or not plain.strip("0"):
        return None
    body = feistel.chars(kind, plain[:-1], [DIGIT] * (len(plain) - 1), by, lambda s: bool(s.strip("0")))
    new = body + next(c for c in DIGIT if luhn(body + c))
    out = list(value)
    for i, c in zip(places, new, strict=True):
        out[i] = c
    return "".join(out)


def _cards(text: str, start: int, of: Callable[[str, str], str | None]) -> Iterator[tuple[int, str]]:
    """(end, pseudonym) of the card that begins at start, if any."""
    groups = [(m.start() + start, m.end() + start) for m in re.finditer(r"\d+", GROUPS.match(text, start).group())]

    def valid(i: int, usual: bool | None = None) -> tuple[bool, int, str, int] | None:
        best, sizes = None, []
        for k in range(i, len(groups)):
            sizes.append(groups[k][1] - groups[k][0])
            if sum(sizes) > CARD_DIGITS[-1]:
                break
            known = len(sizes) == 1 or tuple(sizes) in GROUPINGS
            if sum(sizes) in CARD_DIGITS and (known or not usual) and (not best or known or not best[0]):
                new = of("card", text[groups[i][0] : groups[k][1]])
                best = best if new is None else (known, groups[k][1], new, k)
        return best

    found = valid(0)
    # A usual grouping that overlaps an unusual one is found when its own start is reached.
    if found and (found[0] or not any(valid(i, True) for i in range(1, found[3] + 1))):
        yield found[1], found[2]


def _first(text: str, at: int, of: Callable[[str, str], str | None]) -> tuple[int, int, str, str] | None:
    """(start, end, kind, pseudonym) of the first value found and valid from a place on."""
    while m := PATTERN.search(text, at):
        start, kind = m.start(), KINDS[m.lastgroup]
        if kind == "secret" and not (text[start - 1 : start] in ('"', "'") and text[m.end() : m.end() + 1] in ('"', "'")) and not NAMED.search(text[max(0, start - 24) : start]):
            at = m.end()  # no other kind begins inside a run of so many letters and digits
            continue
        if kind != "card":
            if (new := of(kind, m.group())) is not None:
                return start, m.end(), kind, new
            if kind == "iban":
                for end in (start + i for i in range(len(m.group()) - 1, 0, -1) if m.group()[i] == " "):
                    if IBAN.fullmatch(text, start, end) and (new := of(kind, text[start:end])) is not None:
                        return start, end, kind, new
        if text[start] in DIGIT and (start == 0 or not text[start - 1].isdecimal()):
            for end, new in _cards(text, start, of):
                return start, end, "card", new
        at = start + 1
    return None


def _settled(text: str, at: int, hit: tuple[int, int, str, str], of: Callable[[str, str], str | None]) -> str:
    """The pseudonym of a hit, permuted on until it is found in its place from the same place on."""
    start, end, kind, new = hit
    at = max(at, start - BESIDE)
    low = max(0, at - 1)
    left, right = text[low:start], text[end : end + BESIDE]

    def found(value: str) -> bool:
        again = _first(left + value + right, at - low, of)
        return again is not None and again[:3] == (start - low, end - low, kind)

    while found(text[start:end]) and not found(new):  # the value itself ends the walk at the latest
        new = of(kind, new)
    return new


def finds(text: str, of: Callable[[str, str], str | None]) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of each value found and valid, in order."""
    at = 0
    while hit := _first(text, at, of):
        start, end, kind, new = hit
        yield start, end, kind, _settled(text, at, hit, of) if kind in ("card", "iban") else new
        at = end


def replaced(text: str, of: Callable[[str, str], str | None]) -> tuple[str, list[str]]:
    out, kinds, at = [], [], 0
    for start, end, kind, new in finds(text, of):
        out += [text[at:start], new]
        kinds.append(kind)
        at = end
    return "".join([*out, text[at:]]), kinds


def pseudonymise(docs: DataFrame, key: bytes = DEMO_KEY, text: str = "text", kinds: str | None = "pii_kinds", by: int = 1) -> DataFrame:
    """docs with its text pseudonymised and, if named, a column with the kinds found, in order."""
    kept, types = [c for c in docs.columns if c != kinds], dict(docs.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feistel = Feistel(key)
        of = lru_cache(maxsize=10_000)(lambda kind, value: pseudonym(kind, value, feistel, by))
        for batch in slices(batches):
            pairs = [(t, []) if not t or not HINT.search(t) else replaced(t, of) for t in batch.column(text).to_pylist()]
            columns = {c: batch.column(c) for c in kept} | {text: pa.array([t for t, _ in pairs], pa.string())}
            if kinds:
                columns[kinds] = pa.array([k for _, k in pairs], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = [f"`{c}` {types[c]}" for c in kept] + ([f"`{kinds}` array<string>"] if kinds else [])
    return docs.select([f"`{c}`" for c in kept]).mapInArrow(work, ", ".join(schema))


def reveal(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """Undo pseudonymise under the same key."""
    return pseudonymise(docs, key, text, None, by=-1)
