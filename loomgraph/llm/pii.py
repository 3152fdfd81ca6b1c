"""PII: validated personal numbers and dates become format-preserving pseudonyms.

A found value keeps its format (length, punctuation, prefix, check digit, calendar validity) and is replaced by another one of the
same format through a keyed permutation: a balanced Feistel network over the format's number range, walked on
until it lands within the range. So equal values stay equal across all texts, unequal ones unequal, and whoever has
the key can undo it.

Kinds, the first that fits wins: e-mail addresses (digits and local part are permuted within their alphabet), IBAN (valid check
digits stay valid), payment card numbers (13 to 19 digits; Luhn-valid ones stay valid, and unchecked ones of 16 digits are permuted as plain numbers), US social security numbers,
telephone numbers, IPv4 addresses, calendar dates (ISO, dotted or slashed: permuted over the days 1900 to 2099), hexadecimal secrets in quotes and access key ids.

Defined results: null stays null and empty stays empty. A text without a value is returned as it is. Overlapping
candidates: the leftmost, then the kind listed first; a candidate that isn't valid is tried up to the ends of its groups, then the search goes on from its second group. Repeated rows are treated alike.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_and_text, record

#: The key of the registered query; a real run passes its own.
DEMO_KEY = b"loomgraph demo key"
ROUNDS = 8
FIRST_DAY, DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days


class Feistel:
    """A keyed permutation of 0 .. n - 1 for any n, one for each tweak."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: str, r: int, half: int, bits: int) -> int:
        size = (bits + 7) // 8
        digest = hmac.new(self.key, f"{tweak}|{bits}|{r}|{half}".encode(), hashlib.sha256).digest()
        return int.from_bytes(digest[: max(size, 1)], "big") & ((1 << bits) - 1)

    def permute(self, x: int, n: int, tweak: str, back: bool = False) -> int:
        if n <= 1:
            return x
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        mask = (1 << bits) - 1
        tweak = f"{tweak}|{n}"
        while True:  # cycle walking: what falls outside the range is permuted again
            left, right = x >> bits, x & mask
            for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if back:
                    left, right = right ^ self._round(tweak, r, left, bits), left
                else:
                    left, right = right, left ^ self._round(tweak, r, right, bits)
            x = left << bits | right
            if x < n:
                return x

    def digits(self, s: str, tweak: str, back: bool = False) -> str:
        return str(self.permute(int(s), 10 ** len(s), tweak, back)).zfill(len(s)) if s else s


def luhn_digit(body: str) -> str:
    total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(body)))
    return str(-total % 10)


def _refill(original: str, digits: str) -> str:
    """The digits in the places of the original's digits."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in original)


def _only_digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


_DATE = re.compile(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})|(\d{1,2})([-/.])(\d{1,2})\6(\d{4})", re.ASCII)
_FIND = re.compile(
    r"(?P<email>(?<![A-Za-z0-9À-ɏ._%+-])[A-Za-z0-9À-ɏ._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    r"|(?P<secret>\"(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})\")"
    r"|(?P<key>\bAKIA[0-9A-Z]{16}\b)"
    r"|(?P<iban>\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<date>(?<![\w.])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4})(?:(?!\w)|(?=T[0-9]{2}:)))"
    r"|(?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<phone>\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|(?<!\w)\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|(?<![\w.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?!\w))"
    r"|(?P<card>(?<![\w])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]))"
)
#: A text without any of these has no value.
_HINT = re.compile(r"[0-9@]")
#: Lengths of account numbers by country; other countries have any.
_IBAN = dict(zip("AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IT LT LU LV MT NL NO PL PT RO SE SI SK".split(), (20, 16, 22, 21, 28, 24, 22, 18, 20, 24, 18, 27, 22, 27, 21, 28, 22, 27, 20, 20, 21, 31, 18, 15, 28, 25, 24, 24, 19, 24)))
#: Where a run of digits and blanks may end early, these lengths are tried first.
_CARD = (16, 15, 14, 13, 19, 18, 17)
_TOKEN = re.compile(r"\w*|.", re.DOTALL)
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Pseudonymiser:
    def __init__(self, key: bytes = DEMO_KEY, back: bool = False):
        self.feistel, self.back = Feistel(key), back

    def _letters(self, s: str, tweak: str) -> str:
        """Lower-case and upper-case ASCII letters and digits permuted within the strings that have the same kinds in the same places."""
        kinds = [next((a for a in (_LOWER, _UPPER, "0123456789") if c in a), None) for c in s]
        n, x = 1, 0
        for c, a in zip(s, kinds):
            if a:
                x, n = x * len(a) + a.index(c), n * len(a)
        shape = "".join("." if not a else a[0] for a in kinds)
        x = self.feistel.permute(x, n, f"{tweak}|{shape}", self.back)
        out = list(s)
        for i in reversed(range(len(s))):
            if kinds[i]:
                x, r = divmod(x, len(kinds[i]))
                out[i] = kinds[i][r]
        return "".join(out)

    def email(self, s: str) -> str:
        local, at, domain = s.rpartition("@")
        return self._letters(local, "email") + at + domain

    def secret(self, s: str) -> str:
        body = s[1:-1]
        new = f"{self.feistel.permute(int(body, 16), 16 ** len(body), 'secret', self.back):0{len(body)}x}"
        return f'"{new.upper() if body.isupper() else new}"'

    def key(self, s: str) -> str:
        return s[:4] + self._letters(s[4:], "key")

    def iban(self, s: str) -> tuple[str, int] | None:
        """The longest valid number that ends where a group does, replaced, and the length of what was read."""
        flat = lambda t: t.replace(" ", "")
        check = lambda t: int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97
        valid = lambda t: len(t) == _IBAN.get(t[:2], len(t)) and 15 <= len(t) <= 34 and check(t) == 1
        ends = [i for i in range(len(s), 0, -1) if i == len(s) or s[i] == " "]
        pick = lambda t: next((i for i in ends if valid(flat(t[:i]))), None)
        if (end := pick(s)) is None:
            return None
        own = flat(s[:end])
        while True:  # walked on until the same part is found in the result
            body = self._letters(own[4:], f"iban|{own[:2]}")
            own = own[:2] + f"{98 - check(own[:2] + '00' + body):02d}" + body
            it = iter(own)
            new = "".join(c if c == " " else next(it) for c in s[:end])
            if pick(new + s[end:]) == end:  # what follows is read on where no other digits there could change what is found
                return new + (rest := "" if s[:2] in _IBAN else s[end:]), end + len(rest)

    def date(self, s: str) -> str | None:
        m = _DATE.fullmatch(s)
        y, a, b = (m[1], m[3], m[4]) if m[1] else (m[8], m[7], m[5])
        day_first = True
        try:
            day = date(int(y), int(a), int(b))
        except ValueError:
            try:
                day, day_first = date(int(y), int(b), int(a)), False
            except ValueError:
                return None
        n = (day - FIRST_DAY).days
        if not 0 <= n < DAYS:
            return None
        # walked on within the dates of the same look: in either order of day and month, and of as many digits where they aren't padded
        plain = len(m[3] or m[5]) == 1 or len(m[4] or m[7]) == 1
        first, second = (m[3], m[4]) if m[1] else (m[7], m[5])
        while True:
            n = self.feistel.permute(n, DAYS, "date", self.back)
            new = FIRST_DAY + timedelta(days=n)
            p, q = (new.month, new.day) if day_first else (new.day, new.month)
            if (day_first or new.day > 12) and (not plain or (len(str(p)), len(str(q))) == (len(first), len(second))):
                break
        wide = lambda v, old: f"{v:02d}" if len(old) == 2 else str(v)
        return f"{new.year:04d}{m[2]}{wide(p, m[3])}{m[2]}{wide(q, m[4])}" if m[1] else f"{wide(q, m[5])}{m[6]}{wide(p, m[7])}{m[6]}{new.year:04d}"

    def ip(self, s: str) -> str | None:
        parts = [int(p) for p in s.split(".")]
        if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in s.split(".")):
            return None
        n = self.feistel.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip", self.back)
        return ".".join(map(str, n.to_bytes(4, "big")))

    def ssn(self, s: str) -> str | None:
        a, b, c = s.split("-")
        if not (1 <= int(a) < 900 and a != "666" and b != "00" and c != "0000"):
            return None
        area = int(a) - 1 - (int(a) > 666)
        n = self.feistel.permute((area * 99 + int(b) - 1) * 9999 + int(c) - 1, 898 * 99 * 9999, "ssn", self.back)
        n, c2 = divmod(n, 9999)
        area, b2 = divmod(n, 99)
        return f"{area + 1 + (area + 1 >= 666):03d}-{b2 + 1:02d}-{c2 + 1:04d}"

    def phone(self, s: str) -> str:
        """The country code stays."""
        head = re.match(r"\+[0-9]{1,3}(?=[ .(-])|\+[0-9]", s)
        at = head.end() if head else 0
        return s[:at] + _refill(s[at:], self.feistel.digits(_only_digits(s[at:]), f"phone|{s[:at]}", self.back))

    def card(self, s: str) -> tuple[str, int] | None:
        """A valid number that ends where a group does, else one of 16 digits, replaced, and the length of what was read."""
        ends = {len(_only_digits(s[:i])): i for i in range(1, len(s) + 1) if i == len(s) or not s[i].isdigit() and s[i - 1].isdigit()}
        valid = lambda t: luhn_digit(t[:-1]) == t[-1]
        tried = [n for n in _CARD if n in ends]
        pick = lambda t: next(((n, True) for n in tried if valid(t[:n])), (16, False) if 16 in ends else None)
        digits = _only_digits(s)
        if (found := pick(digits)) is None:
            return None
        n, head = found[0], digits[: found[0]]
        off = int(head[-1]) - int(luhn_digit(head[:-1]))  # a number that fails the check keeps failing it in the same way
        while True:  # walked on until the same part is found in the result
            body = self.feistel.digits(head[:-1], "card", self.back)
            head = body + str((int(luhn_digit(body)) + off) % 10)
            if pick(head + digits[n:]) == found:
                rest = "" if found == (tried[0], True) else s[ends[n] :]  # read on where no other digits there could change what is found
                return _refill(s[: ends[n]], head) + rest, ends[n] + len(rest)

    def _replaced(self, kind: str, s: str) -> tuple[str, str, int] | None:
        """Kind, replacement and length of the valid value at the start of a candidate."""
        new = getattr(self, kind)(s)
        if new is None and kind in ("iban", "date") and len(_only_digits(s)) == 16:
            kind, new = "card", self.card(s)
        return None if new is None else (kind, *new) if isinstance(new, tuple) else (kind, new, len(s))

    def _next(self, text: str, start: int) -> tuple[int, int, str, str, str, int] | None:
        """The first value from start on: its place, length, kind and replacement, the whole candidate, and the first place that a candidate which isn't valid reaches it from (its own, if none does)."""
        reach: list[tuple[int, int]] = []
        while m := _FIND.search(text, start):
            if found := self._replaced(m.lastgroup, m[0]):
                kind, new, size = found
                return m.start(), size, kind, new, m[0], min([m.start(), *(a for a, z in reach if z > m.start())])
            # what isn't valid may hide something that is: on from its second token
            reach = [*(x for x in reach if x[1] > m.start()), (m.start(), m.end())]
            start = max(_TOKEN.match(text, m.start()).end(), m.start() + 1)
        return None

    def text(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with its values replaced, and how many of each kind."""
        if not _HINT.search(text):
            return text, {}
        out, at, found, start = [], 0, {}, 0
        while value := self._next(text, start):
            place, size, kind, new, whole, since = value
            while since < place:  # walked on until the candidates before it stay invalid with it
                low, near = max(0, since - 1), text[place + size : place + size + 80]
                again = self._next(text[low:place] + new + near, since - low)
                if again and again[:3] == (place - low, size, kind):
                    break
                _, new, size = self._replaced(kind, new + whole[size:])
            out += [text[at:place], new]
            at = start = place + size
            found[kind] = found.get(kind, 0) + 1
        return "".join([*out, text[at:]]) if out else text, found


def pseudonymise(docs: DataFrame, *, key: bytes = DEMO_KEY, back: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (pseudonymised), found map<string, int>: one row per row."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("found", pa.map_(pa.string(), pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pseudonymiser(key, back)
        for batch in batches:
            got = [(None, {}) if t is None else p.text(t) for t in batch.column(1).to_pylist()]
            yield record(schema, batch.column(0).cast(pa.int64()), [t for t, _ in got], [sorted(f.items()) for _, f in got])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, text string, found map<string, int>")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the pseudonymised text, how many values were found, and of which kinds."""
    kinds = F.array_join(F.transform(F.array_sort(F.map_entries("found")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    count = F.aggregate(F.map_values("found"), F.lit(0), lambda a, b: a + b).cast("long")
    return pseudonymise(documents(spark, sf_dir)).select("doc_id", "text", count.alias("n_found"), kinds.alias("kinds"))
