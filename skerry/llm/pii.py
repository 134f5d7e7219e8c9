"""Format-preserving pseudonyms for personal data and secrets.

Each value found is validated (check digits, calendar, ranges), mapped to a
number below the size of its format, permuted by a keyed Feistel network with
cycle walking, and written back in its format. Under one key equal values get
equal pseudonyms in all documents, different values different ones, and the
holder of the key can undo it. A pseudonym passes the same validation. Where
the form of a card or an IBAN takes in groups that don't belong to it, shorter
prefixes are tried, then other formats, then what begins behind the first group.
A pseudonym that would make a refused reading valid there is permuted again, so
that the text can still be undone; such a value differs from its equals.

Formats: payment cards (Luhn), e-mail addresses (the local part; the domain
stays), telephone numbers (North American, and international with a plus), IPv4
addresses, social security numbers, IBANs (mod 97), dates between 1900 and
2099, access keys, 40-digit hexadecimal tokens and values of password fields.

Rows: a null text stays null, an empty one empty. Repeated rows get equal
results. Other columns are handed on.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import re
import string
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from skerry.llm.textops import append, column_bytes

ROUNDS = 10


class Feistel:
    """Keyed permutations of range(n), for any n."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, i: int, half: int, side: int) -> int:
        size = (side.bit_length() + 7) // 8 + 8
        out, block = b"", 0
        while len(out) < size:
            out += hashlib.blake2b(b"%b|%d|%d|%d|%d" % (tweak, i, side, half, block), key=self.key, digest_size=32).digest()
            block += 1
        return int.from_bytes(out[:size], "big") % side

    def _once(self, x: int, side: int, tweak: bytes, back: bool) -> int:
        left, right = divmod(x, side)
        for i in range(ROUNDS):
            if back:
                left, right = (right - self._round(tweak, ROUNDS - 1 - i, left, side)) % side, left
            else:
                left, right = right, (left + self._round(tweak, i, right, side)) % side
        return left * side + right

    def permute(self, x: int, n: int, tweak: bytes, ok: Callable[[int], bool] = lambda x: True, back: bool = False) -> int:
        """The image of x, which ok must hold for: the next value that ok holds for on the one cycle through
        range(n) that the Feistel network's order makes. So only a value without any other is its own image."""
        side = _root(n)

        def walk(y: int, undo: bool) -> int:
            while True:
                y = self._once(y, side, tweak, undo)
                if y < n:
                    return y

        y = walk(x, False)
        for _ in range(100_000):
            y = (y - 1 if back else y + 1) % n
            x = walk(y, True)
            if ok(x):
                return x
        raise ValueError("no image found: ok() holds for too few values")


def _root(n: int) -> int:
    import math

    r = math.isqrt(n)
    return r if r * r >= n else r + 1


def luhn(digits: str) -> int:
    """The digit that must follow."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 if i % 2 else 2)
        total += d - 9 if d > 9 else d
    return -total % 10


def _fill(shape: str, digits: str) -> str:
    """shape with its digits replaced one by one."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _written(text: str, now: dict[int, str], finds: list[tuple[int, int, str]], lo: int, hi: int) -> str:
    """text from lo to hi with the values of now; one that reaches over an end is cut there."""
    out = []
    for a, b, _ in finds[bisect.bisect_right(finds, lo, key=lambda f: f[1]) :]:
        if a >= hi:
            break
        out += [text[lo:a], now[a][max(lo - a, 0) : hi - a if hi < b else None]]
        lo = b
    return "".join([*out, text[lo:hi]])


def _ends(text: str, at: int, to: int, kind: str) -> list[int]:
    """Where a value that starts at at may end, the longest first: cards and IBANs can be followed by other groups."""
    if kind not in ("card", "iban"):
        return [to]
    return [to, *(e for e in range(to - 1, at, -1) if text[e] in " -" and EACH[kind].fullmatch(text[at:e]))]


def _classes(value: str, alphabets: tuple[str, ...]) -> list[str]:
    return [next((a for a in alphabets if c in a), "") for c in value]


class Pseudonyms:
    """Finds and replaces values; back=True undoes it."""

    def __init__(self, key: bytes, back: bool = False):
        self.feistel, self.back = Feistel(key), back
        self.kinds = {name: getattr(self, "_" + name) for name in PATTERNS}
        self.known: dict[tuple[str, str], str | None] = {}

    def __call__(self, text: str) -> tuple[str, dict[str, int]]:
        finds, failed = self._parse(text)
        counts: dict[str, int] = {}
        now = {a: text[a:b] for a, b, _ in finds}
        # undone in reverse, so that each step sees the text that it saw
        for a, b, kind in reversed(finds) if self.back else finds:
            near = [f for f in failed if f[0] < b and a < f[1]]
            now[a] = self._new(kind, now[a])
            while near and any(self._new(k, _written(text, now, finds, lo, hi)) is not None for lo, hi, k in near):
                now[a] = self._new(kind, now[a])
            counts[kind] = counts.get(kind, 0) + 1
        return _written(text, now, finds, 0, len(text)), counts

    def _parse(self, text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """(start, end, kind) of the values, and of what has the form of one, but fails its validation."""
        finds, failed = [], []
        m = ANY.search(text)
        while m:
            at, to, kind, end = m.start(), m.end(), m.lastgroup, None
            while kind and end is None:
                for end in _ends(text, at, to, kind):
                    if self._new(kind, text[at:end]) is not None:
                        finds.append((at, end, kind))
                        break
                    failed.append((at, end, kind))
                else:
                    end = None
                    kind, to = next(((k, n.end()) for k in _AFTER[kind] if (n := EACH[k].match(text, at))), (None, 0))
            m = ANY.search(text, end or _GROUP.match(text, at).end())
        return finds, failed

    def _new(self, kind: str, value: str) -> str | None:
        found = (kind, value)
        if found not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[found] = self.kinds[kind](value)
        return self.known[found]

    def _number(self, x: int, n: int, tweak: str, ok=lambda x: True) -> int:
        return self.feistel.permute(x, n, tweak.encode(), ok, self.back)

    def _letters(self, value: str, alphabets: tuple[str, ...], tweak: str) -> str:
        """Permutes the characters of the alphabets, each within its own; others stay."""
        kinds, x, n = _classes(value, alphabets), 0, 1
        for c, a in zip(value, kinds, strict=True):
            if a:
                x, n = x * len(a) + a.index(c), n * len(a)
        if n < 2:
            return value
        shape = "".join(str(alphabets.index(a)) if a else c for c, a in zip(value, kinds, strict=True))
        x, out = self._number(x, n, f"{tweak}|{shape}"), []
        for c, a in zip(reversed(value), reversed(kinds), strict=True):
            if a:
                x, d = divmod(x, len(a))
                c = a[d]
            out.append(c)
        return "".join(reversed(out))

    def _card(self, value: str) -> str | None:
        digits = re.sub(r"\D", "", value)
        if not 13 <= len(digits) <= 19 or digits[0] not in "23456" or luhn(digits[:-1]) != int(digits[-1]):
            return None
        n = len(digits) - 2  # the first digit, which tells the kind of card, stays
        # so does the sum that tells if the card and groups behind it would be a longer one
        ok = lambda x: luhn(f"{(own := f'{digits[0]}{x:0{n}d}')}{luhn(own)}") == luhn(digits)
        own = f"{digits[0]}{self._number(int(digits[1:-1]), 10**n, 'card' + digits[0], ok):0{n}d}"
        return _fill(value, f"{own}{luhn(own)}")

    def _email(self, value: str) -> str | None:
        local, domain = value.rsplit("@", 1)
        return f"{self._letters(local, (string.ascii_lowercase, string.ascii_uppercase, string.digits), 'email' + domain.lower())}@{domain}"

    def _phone(self, value: str) -> str | None:
        digits = re.sub(r"\D", "", value)
        if value[0] == "+" and digits[0] != "1":
            if not 8 <= len(digits) <= 15:
                return None
            return _fill(value, f"{digits[:2]}{self._number(int(digits[2:]), 10 ** (len(digits) - 2), 'phone' + digits[:2]):0{len(digits) - 2}d}")
        lead, own = ("1", digits[1:]) if len(digits) == 11 and digits[0] == "1" else ("", digits)
        valid = lambda x: f"{x:010d}"[0] >= "2" and f"{x:010d}"[3] >= "2"
        if len(own) != 10:
            return None
        # numbers that aren't assigned are replaced among themselves
        tweak, ok = ("nanp", valid) if valid(int(own)) else ("nanp0", lambda x: not valid(x))
        return _fill(value, f"{lead}{self._number(int(own), 10**10, tweak, ok):010d}")

    def _ip(self, value: str) -> str | None:
        parts = [int(p) for p in value.split(".")]
        if max(parts) > 255 or any(str(int(p)) != p for p in value.split(".")):
            return None
        return ".".join(map(str, self._number(int.from_bytes(bytes(parts), "big"), 2**32, "ip").to_bytes(4, "big")))

    def _ssn(self, value: str) -> str | None:
        def valid(x: int) -> bool:
            s = f"{x:09d}"
            return s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"

        x = int(value.replace("-", ""))
        return _fill(value, f"{self._number(x, 10**9, 'ssn', valid):09d}") if valid(x) else None

    def _iban(self, value: str) -> str | None:
        plain = value.replace(" ", "")
        number = lambda s: int("".join(str(int(c, 36)) for c in s))
        if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
            return None
        own = self._letters(plain[4:], (string.ascii_uppercase, string.digits), "iban" + plain[:2])
        it = iter(f"{plain[:2]}{98 - number(own + plain[:2] + '00') % 97:02d}{own}")
        return "".join(c if c == " " else next(it) for c in value)

    def _date(self, value: str) -> str | None:
        found = _read_date(value)
        if found is None:
            return None
        day, write, order = found
        shape = _shape(value)
        first, last = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

        def ok(x: int) -> bool:  # it reads as the same date
            at = datetime.date.fromordinal(first + x)
            again = _read_date(write(at))
            return again is not None and again[0] == at and _shape(write(at)) == shape and again[2] == order

        x = day.toordinal() - first
        return write(datetime.date.fromordinal(first + self._number(x, last - first + 1, f"date{shape}{order}", ok)))

    def _key(self, value: str) -> str | None:
        return value[:4] + self._letters(value[4:], (string.ascii_uppercase + "234567", "0189"), "key")

    def _hex(self, value: str) -> str | None:
        lower = "0123456789abcdef"
        return self._letters(value, (lower,) if value == value.lower() else (lower.upper(),), "hex")

    def _password(self, value: str) -> str | None:
        field, mark, own = re.split(r"([=:]\s*)", value, maxsplit=1)
        if own == own.lower() and re.fullmatch("[0-9a-f]+", own):
            return field + mark + self._letters(own, ("0123456789abcdef",), "password")
        return field + mark + self._letters(own, (string.ascii_lowercase, string.ascii_uppercase, string.digits), "password")


def _shape(value: str) -> str:
    return re.sub(r"\d", "9", value)


def _read_date(value: str):
    """The date and a function that writes one alike; day first where both readings hold."""
    parts = re.split(r"[-/.]", value)
    mark = value[len(parts[0])]
    orders = [(2, 1, 0)] if len(parts[0]) == 4 else [(0, 1, 2), (1, 0, 2)]
    for d, m, y in orders:
        try:
            at = datetime.date(int(parts[y]), int(parts[m]), int(parts[d]))
        except ValueError:
            continue
        if not 1900 <= at.year <= 2099:
            continue

        def write(x: datetime.date, d=d, m=m, y=y) -> str:
            out = [""] * 3
            out[d], out[m], out[y] = str(x.day).zfill(len(parts[d])), str(x.month).zfill(len(parts[m])), str(x.year)
            return mark.join(out)

        return at, write, d
    return None


#: In the order in which they are tried at a place.
PATTERNS = {
    "email": r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}",
    "password": r"(?i:\b(?:password|passwd|pwd|secret|token|api_?key))[=:]\s?[A-Za-z0-9+/_-]{6,}",
    "key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "hex": r"\b(?:[0-9a-f]{40}|[0-9A-F]{40})\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "phone": r"(?<![\w+])(?:\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|[2-9]\d\d [2-9]\d\d \d{4}|\+[2-9]\d(?:[ .-]?\d){6,12})(?!\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\w)",
    "date": r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-\d{1,2}-\d{4})(?![\w/-])",
}
ANY = re.compile("|".join(f"(?P<{k}>{v})" for k, v in PATTERNS.items()), re.ASCII)
EACH = {k: re.compile(v, re.ASCII) for k, v in PATTERNS.items()}
_AFTER = {k: list(PATTERNS)[i + 1 :] for i, k in enumerate(PATTERNS)}
_GROUP = re.compile(r"\w+|.", re.ASCII | re.DOTALL)
_HINT = np.zeros(256, bool)
_HINT[[*range(48, 58), 64]] = True
_FIELD = re.compile(rb"(?i:password|passwd|pwd|secret|token|api_?key)|AKIA|ASIA")


def pseudonymise(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """docs with text rewritten, and pii_kinds (such as card:1,email:2) and n_pii. key: keeps pseudonyms equal."""
    state: dict = {}

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        worker = state.get("worker") or state.setdefault("worker", Pseudonyms(key, back))
        column = batch.column(batch.schema.get_field_index("text"))
        data, offsets = column_bytes(column)
        hints = np.concatenate(([0], np.cumsum(_HINT[data], dtype=np.int64)))
        look = hints[offsets[1:]] > hints[offsets[:-1]]  # other texts hold nothing that is looked for, but password fields and access keys
        for m in _FIELD.finditer(data.tobytes()):
            look[np.searchsorted(offsets, m.start(), "right") - 1] = True
        kinds, n, new = [""] * len(look), np.zeros(len(look), np.int64), []
        for i in np.flatnonzero(look).tolist():
            text, counts = worker(column[i].as_py())
            new.append(text)
            if counts:
                kinds[i], n[i] = ",".join(f"{k}:{counts[k]}" for k in sorted(counts)), sum(counts.values())
        text = pc.replace_with_mask(column, pa.array(look), pa.array(new, column.type))
        return [text, pa.array(kinds), pa.array(n)]

    out = append(docs, "text string, pii_kinds string, n_pii long", run)
    return out
