"""PII pseudonyms by format-preserving Feistel permutations.

Values that pass their check (a Luhn sum, octet ranges, a calendar date, ...)
are replaced by another value of the same format that passes it too. A value is
numbered within the set of values of its format, the number is permuted by a
keyed Feistel network with cycle walking, and written back in the same shape.
Equal values so get equal pseudonyms in every document, different values get
different ones, and whoever holds the key can undo it.

Kinds: e-mail, payment card (Luhn), IBAN (mod 97), US social security number,
phone, IPv4, date (1900-2099) and secrets (access keys; the value after
password, token, secret or api_key). Phones are permuted on their digits alone,
so one number in two notations stays linked.

Defined results: a null text stays null, a text without values stays as it is,
whatever its length. Repeated rows get equal results. A value does not reach
over a line's end. Other columns of the input are passed through untouched.

At each place every kind is tried, and within a kind every end that its pattern
allows, longest first, until one passes its check. Readings in a usual form
(card groupings, an IBAN's length by its country, a numbering plan) are settled
first in the whole line, other readings then in what is left between them.
Values whose pseudonyms would be read in another way beside their neighbours are
permuted on until they are not, so that undoing finds the same places; a value
that has to go on gets another pseudonym there than elsewhere.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcast.llm.common import col

ROUNDS = 8
DEFAULT_KEY = "set spark.fieldcast.pii.key to a secret of your own"
KINDS = ("email", "secret", "iban", "card", "ssn", "phone", "ipv4", "date")
_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1).toordinal(), 73049  # up to 2099-12-31

_PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-]) [A-Za-z0-9._%+-]+ @ [A-Za-z0-9-]+ (?:\.[A-Za-z0-9-]+)+",
    "secret": r"""\b(?:AKIA|ASIA)[0-9A-Z]{16}\b
    | (?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key))\s{0,3}[=:]\s{0,3}["']?[A-Za-z0-9+/_=.-]{8,}""",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}\b",
    "card": r"(?<![0-9.]) [0-9](?:[ -]?[0-9]){12,18} (?![0-9])",
    "ssn": r"(?<![0-9-]) [0-9]{3}-[0-9]{2}-[0-9]{4} (?![0-9-])",
    "date": r"""(?<![0-9./-]) (?: [0-9]{4}(?P<s>[-/.])[0-9]{1,2}(?P=s)[0-9]{1,2} | [0-9]{1,2}(?P<t>[-/.])[0-9]{1,2}(?P=t)[0-9]{4} )
    (?![0-9]|[./-][0-9])""",
    "ipv4": r"(?<![0-9.]) [0-9]{1,3}(?:\.[0-9]{1,3}){3} (?![0-9]|\.[0-9])",
    "phone": r"""(?<![0-9.+-]) (?: \+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}
    | (?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4} ) (?![0-9])""",
}
_KIND = {k: re.compile(p, re.X) for k, p in _PATTERNS.items()}
_VALUE = re.compile("|".join(f"(?P<{k}> {p} )" for k, p in _PATTERNS.items()), re.X)
# Kinds that can end at several places: what they are made of, and their pattern without what stands around it.
_RUN = {"iban": re.compile(r"[A-Z0-9 ]{1,80}"), "card": re.compile(r"[0-9 -]{1,80}"), "phone": re.compile(r"[0-9 .()+-]{1,80}")}
_FORM = {k: re.compile(re.sub(r"^(?:\\b|\(\?<![^)]*\))|(?:\\b|\(\?![^)]*\))$", "", _PATTERNS[k]), re.X) for k in _RUN}
_LOOSE = re.compile("|".join(_PATTERNS[k] for k in _RUN), re.X)
_GROUPED = re.compile(r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{3})?"
                      r"|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5}|[0-9]{4}([ -])[0-9]{3}\3[0-9]{3}\3[0-9]{3}")
# Lengths by the IBAN registry; digits, country code included, where a numbering plan has one length.
_IBAN_LENGTH = {c: n for n, cs in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for c in cs.split()}
_PLAN = {"1": 11, "7": 11, "27": 11, "30": 12, "31": 11, "33": 11, "34": 11, "41": 11, "44": 12, "45": 10, "47": 10,
         "48": 11, "61": 11, "65": 10, "91": 12}
_CUT = re.compile(r"[a-z,;] (?!\s{0,2}[=:])")  # no value reaches over it
_WALK = 1000
_DIGIT_OR_AT = re.compile(r"[0-9@]")
_NAMES = ("password", "passwd", "pwd", "token", "secret", "api")


def _may_hold(text: str) -> bool:
    """Whether a value can be in a text at all."""
    if _DIGIT_OR_AT.search(text):
        return True
    low = text.lower()
    return any(name in low for name in _NAMES)


def permute(x: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of 0 .. size-1: an alternating Feistel network, walked until it is in range."""
    if size < 2:
        return x
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)

    def mixed(i: int, half: int) -> int:
        data = b"%b|%d|%d|%d" % (tweak, size, i, half)
        return int.from_bytes(hashlib.blake2b(data, key=key, digest_size=32).digest())

    while True:
        right, left = divmod(x, a)
        for i in (reversed(range(ROUNDS)) if back else range(ROUNDS)):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * mixed(i, left)) % b
            else:
                left = (left + sign * mixed(i, right)) % a
        x = left + a * right
        if x < size:
            return x


def _mixed(digits: list[int], sizes: list[int], key: bytes, tweak: bytes, back: bool) -> list[int]:
    """Permutes a number whose i-th digit is below sizes[i]."""
    x = 0
    for d, s in zip(digits, sizes):
        x = x * s + d
    x = permute(x, math.prod(sizes), key, tweak, back)
    out = []
    for s in reversed(sizes):
        x, d = divmod(x, s)
        out.append(d)
    return out[::-1]


_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HEX = "0123456789abcdef"


def _letters(text: str, key: bytes, tweak: bytes, back: bool, alphabet: str = "") -> str:
    """Permutes the ASCII letters and digits of a text, each within ``alphabet`` or its own class."""
    sets = [next((s for s in ((alphabet,) if alphabet else _ALPHABETS) if c in s), None) for c in text]
    at = [i for i, s in enumerate(sets) if s]
    out = list(text)
    new = _mixed([sets[i].index(text[i]) for i in at], [len(sets[i]) for i in at], key, tweak, back)
    for i, d in zip(at, new):
        out[i] = sets[i][d]
    return "".join(out)


def _refill(shape: str, digits: str) -> str:
    left = iter(digits)
    return "".join(next(left) if "0" <= c <= "9" else c for c in shape)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _luhn(digits: str) -> int:
    """The check digit of the digits before it."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def _email(v: str, key: bytes, back: bool) -> str:
    name, domain = v.split("@")
    return _letters(name, key, b"email", back) + "@" + domain


def _secret(v: str, key: bytes, back: bool) -> str:
    if v[:4] in ("AKIA", "ASIA"):
        return v[:4] + _letters(v[4:], key, b"access", back, _ALPHABETS[0] + _ALPHABETS[2])
    head, value = re.fullmatch(r"([^=:]*[=:]\s*[\"']?)(.*)", v).groups()
    return head + _letters(value, key, b"secret", back, _HEX if set(value) <= set(_HEX) else "")


def _iban(v: str, key: bytes, back: bool) -> str | None:
    plain = v.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = _letters(plain[4:], key, plain[:2].encode(), back)
    new = iter(plain[:2] + f"{98 - number(body + plain[:2] + '00') % 97:02d}" + body)
    return "".join(c if c == " " else next(new) for c in v)


def _card(v: str, key: bytes, back: bool) -> str | None:
    digits = _digits(v)
    if _luhn(digits[:-1]) != int(digits[-1]) or not digits.strip("0"):
        return None
    body = digits[0] + _letters(digits[1:-1], key, b"card" + digits[:1].encode(), back)
    return _refill(v, body + str(_luhn(body)))


def _ssn(v: str, key: bytes, back: bool) -> str | None:
    area, group, serial = map(int, v.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    a, g, s = _mixed([area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999], key, b"ssn", back)
    return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{s + 1:04d}"


def _phone(v: str, key: bytes, back: bool) -> str | None:
    digits = _digits(v)
    national = digits[-10:]
    if len(digits) == 10 and v[0] != "+" or len(digits) == 11 and v.startswith("+1"):  # the North American plan
        if national[0] < "2" or national[3] < "2":
            return None
        sizes = [8 if i in (0, 3) else 10 for i in range(10)]
        new = _mixed([int(d) - 10 + s for d, s in zip(national, sizes)], sizes, key, b"phone", back)
        return _refill(v, digits[:-10] + "".join(str(d + 10 - s) for d, s in zip(new, sizes)))
    if v[0] != "+" or not 8 <= len(digits) <= 15:
        return None
    return _refill(v, digits[:2] + _letters(digits[2:], key, b"phone" + digits[:2].encode(), back))


def _ipv4(v: str, key: bytes, back: bool) -> str | None:
    octets = v.split(".")
    if any(int(o) > 255 or o != str(int(o)) for o in octets):
        return None
    low = [(0, 10, 100)[len(o) - 1] for o in octets]
    sizes = [(10, 90, 156)[len(o) - 1] for o in octets]
    new = _mixed([int(o) - x for o, x in zip(octets, low)], sizes, key, b"ipv4", back)
    return ".".join(str(d + x) for d, x in zip(new, low))


def _date(v: str, key: bytes, back: bool) -> str | None:
    a, b, c = re.split(r"[-/.]", v)
    mark = re.search(r"[-/.]", v)[0]
    orders = ([(a, b, c)] if len(a) == 4 else [(c, b, a), (c, a, b)])  # day first, else month first
    for k, (year, month, day) in enumerate(orders):
        try:
            number = datetime.date(int(year), int(month), int(day)).toordinal() - _FIRST_DAY
        except ValueError:
            continue
        if not 0 <= number < _DAYS:
            return None
        new = datetime.date.fromordinal(permute(number, _DAYS, key, b"date", back) + _FIRST_DAY)
        pad = 2 if len(month) == 2 and len(day) == 2 else 1
        parts = [f"{new.year}", f"{new.month:0{pad}d}", f"{new.day:0{pad}d}"]
        return mark.join(parts if len(a) == 4 else [parts[2], parts[1], parts[0]] if k == 0 else [parts[1], parts[2], parts[0]])
    return None


_RULES = {"email": _email, "secret": _secret, "iban": _iban, "card": _card, "ssn": _ssn, "phone": _phone,
          "ipv4": _ipv4, "date": _date}


@lru_cache(1 << 16)
def _replaced(kind: str, value: str, key: bytes, back: bool) -> str | None:
    return _RULES[kind](value, key, back)


def _ends(kind: str, line: str, start: int, stop: int, usual: bool) -> Iterator[int]:
    """Where a value of a kind that starts at ``start`` can end: by its ``usual`` forms, or by the others."""
    found = _KIND[kind].match(line, start, stop)
    if not found:
        return
    if kind not in _RUN:
        if usual:
            yield found.end()
        return
    run, more = _RUN[kind].match(line, start, stop)[0], re.compile(r"\w" if kind == "iban" else "[0-9]")
    ends = [e for e in range(start + len(run), start, -1)
            if line[e - 1] not in " .()+-" and not more.match(line, e, stop) and _FORM[kind].fullmatch(line, start, e)]
    for k, e in enumerate(ends):
        v = line[start:e]
        if kind == "iban":
            known = _IBAN_LENGTH.get(v[:2])
            mine, other = len(v.replace(" ", "")) == known, known is None or k == 0
        elif kind == "card":
            token = "-" in v and " " not in v and not re.match("-[0-9]", line[e:e + 2]) and line[max(0, start - 1):start] != "-"
            mine, other = bool(_GROUPED.fullmatch(v)) or token, True
        else:
            digits = _digits(v)
            plan = _PLAN.get(digits[:1]) or _PLAN.get(digits[:2])
            mine, other = v[0] != "+" or len(digits) == plan, True
        if mine if usual else other and not mine:
            yield e


def _read(line: str, start: int, stop: int, usual: bool, key: bytes, back: bool) -> list[tuple[int, int, str]]:
    """The values between two places: (start, end, kind) of each."""
    found = []
    pattern, kinds = (_VALUE, _KIND) if usual else (_LOOSE, _RUN)
    while m := pattern.search(line, start, stop):
        at = m.start()
        start = at + 1
        for kind, end in ((k, e) for k in kinds for e in _ends(k, line, at, stop, usual)):
            if _replaced(kind, line[at:end], key, back) is not None:
                found.append((at, end, kind))
                start = end
                break
    return found


def _values(line: str, key: bytes, back: bool) -> list[tuple[int, int, str]]:
    found = _read(line, 0, len(line), True, key, back)
    gaps = zip([0, *(e for _, e, _ in found)], [*(s for s, *_ in found), len(line)])
    return sorted([*found, *(v for a, z in gaps for v in _read(line, a, z, False, key, back))])


def _put(line: str, values: list[tuple[int, int, str]], key: bytes, back: bool) -> tuple[str, list[tuple[int, int, str]]]:
    """The line with pseudonyms, and where they are."""
    out, there, at, size = [], [], 0, 0
    for start, end, kind in values:
        new = _replaced(kind, line[start:end], key, back)
        size += start - at
        out += [line[at:start], new]
        there.append((size, size + len(new), kind))
        at, size = end, size + len(new)
    return "".join([*out, line[at:]]), there


def _line(line: str, key: bytes, back: bool) -> tuple[str, list[str]]:
    """The line with pseudonyms that are read at the same places, and the kinds of its values."""
    values = _values(line, key, back)
    if not values:
        return line, []
    kinds = [k for *_, k in values]
    first, there = out, _ = _put(line, values, key, back)
    if _values(out, key, back) == there:
        return out, kinds
    if cuts := [m.end() for m in _CUT.finditer(line)]:  # go on only where they are read in another way
        return "".join(_line(line[a:z], key, back)[0] for a, z in zip([0, *cuts], [*cuts, len(line)])), kinds
    for _ in range(_WALK):
        out, there = _put(out, there, key, back)
        if _values(out, key, back) == there:
            return out, kinds
    return first, kinds


def pseudonymise(text: str | None, key: bytes, back: bool = False) -> tuple[str | None, dict[str, int]]:
    """The text with pseudonyms (``back``: with the values again), and the replaced values by kind."""
    if not text or not _may_hold(text):
        return text, {}
    counts: dict[str, int] = {}
    lines = text.split("\n")
    for n, line in enumerate(lines):
        if not _may_hold(line):
            continue
        lines[n], kinds = _line(line, key, back)
        for kind in kinds:
            counts[kind] = counts.get(kind, 0) + 1
    return "\n".join(lines), counts


def pseudonyms(docs: DataFrame, key: str | None = None, text_col: str = "text", counts: bool = True,
               back: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text_col``; with ``counts``, a column ``n_<kind>`` for each kind
    (with underscores after it where the input has a column of that name).

    The key is ``spark.fieldcast.pii.key`` unless given. No column holds an
    original value beside the text it was replaced in.
    """
    if key is None:
        key = docs.sparkSession.conf.get("spark.fieldcast.pii.key", DEFAULT_KEY)
    secret = hashlib.sha256(key.encode()).digest()
    at = docs.columns.index(text_col)
    found = [f"n_{k}" for k in KINDS] if counts else []
    while set(found) & set(docs.columns):
        found = [c + "_" if c in docs.columns else c for c in found]
    schema = T.StructType([*docs.schema, *[T.StructField(c, T.LongType()) for c in found]])
    schema.fields[at] = T.StructField(text_col, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [pseudonymise(t.as_py(), secret, back) for t in b.column(at)]
            columns = list(b.columns)
            columns[at] = pa.array([t for t, _ in done], pa.string())
            columns += [pa.array([c.get(k, 0) for _, c in done], pa.int64()) for k in KINDS[:len(found)]]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.withColumn(text_col, F.col(f"`{text_col}`").cast("string")).mapInArrow(run, schema)
