"""Personal numbers and dates replaced by format-preserving pseudonyms.

Candidates are found by pattern and validated: payment cards by their check digit,
bank accounts by their remainder, network addresses by their octets, phone numbers by
their length, social security numbers by their ranges, dates by the calendar. The valid value is a number
in a known range; a keyed Feistel network with cycle walking permutes that range, and
the result is written in the format that was found, with new check digits. The
permutation is one to one, so equal values stay linked across documents, different
ones stay different, and whoever has the key can restore them. Names before the @ of
an e-mail address, at most 64 characters, are permuted among those of equal length.

Defined results: a missing text stays missing. What fails validation stays. Texts are
processed whole, the other columns are kept, and a column named like a new one is
replaced. Where candidates overlap, the first to start wins, then the order of
``KINDS``, then the longest that is valid. A value has one pseudonym, whatever stands
beside it. Beside some neighbours a pseudonym could be read otherwise, say as a longer
card with the digits that follow; so texts are not restored by reading them again but by
the places of the pseudonyms, which ``spans`` keeps. The search takes time in proportion
to the text. Rows are independent, so repeated rows give the same result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from datetime import date, timedelta
from functools import cache
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

ROUNDS = 8

_DIGITS = re.compile(r"\d", re.ASCII)


def permuted(value: int, size: int, key: bytes, kind: str, back: bool = False) -> int:
    """The keyed permutation of ``[0, size)`` that belongs to ``kind``, or its inverse."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    width = (half + 7) // 8

    def scramble(turn: int, right: int) -> int:
        content = b"%s/%d/%d/%s" % (kind.encode(), size, turn, right.to_bytes(width, "big"))
        return int.from_bytes(hashlib.blake2b(content, key=key, digest_size=width).digest(), "big") & mask

    while True:
        left, right = value >> half, value & mask
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ scramble(turn, left), left
            else:
                left, right = right, left ^ scramble(turn, right)
        value = left << half | right
        if value < size:
            return value


def _refilled(found: str, digits: str) -> str:
    """``found`` with its digits replaced in order."""
    new = iter(digits)
    return _DIGITS.sub(lambda _: next(new), found)


def _digits_of(found: str) -> str:
    return "".join(_DIGITS.findall(found))


def check_digit(payload: str) -> str:
    """The digit that makes a card number valid."""
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


Permute = Callable[[int, int, str], int]


def _card(found: str, permute: Permute) -> str | None:
    digits = _digits_of(found)
    if check_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    size, value = len(digits) - 1, int(digits[:-1])
    while True:  # one digit over and over is no card
        value = permute(value, 10 ** size, "card")
        new = f"{value:0{size}d}"
        new += check_digit(new)
        if len(set(new)) > 1:
            return _refilled(found, new)


def _remainder(country: str, rest: str) -> int:
    return int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97


def _account(found: str, permute: Permute) -> str | None:
    plain = found.replace(" ", "")
    country, check, rest = plain[:2], plain[2:4], plain[4:]
    digits = _digits_of(rest)
    if not digits or int(check) != 98 - _remainder(country, rest):
        return None
    rest = _refilled(rest, f"{permute(int(digits), 10 ** len(digits), 'account'):0{len(digits)}d}")
    new = iter(f"{country}{98 - _remainder(country, rest):02d}{rest}")
    return "".join(c if c == " " else next(new) for c in found)


def _address(found: str, permute: Permute) -> str | None:
    octets = [int(o) for o in found.split(".")]
    if max(octets) > 255:
        return None
    value = permute(int.from_bytes(bytes(octets), "big"), 1 << 32, "address")
    return ".".join(map(str, value.to_bytes(4, "big")))


#: Country codes: no code begins another one.
_CODE = r"(?>[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9]\d\d)"
_CODES = re.compile(_CODE, re.ASCII)

#: Digits of an international number, with its country code.
_FEWEST, _MOST = 8, 15


def _phone(found: str, permute: Permute) -> str | None:
    """The country code stays; numbers after +1, and without a code, have ten digits."""
    digits, country = _digits_of(found), ""
    if found[0] == "+":
        code = _CODES.match(digits)
        country = code.group() if code and (code.group() != "1" or len(digits) == 11) else digits[:-10]
        if not 1 <= len(country) <= 3 or not _FEWEST <= len(digits) <= _MOST:
            return None
    national = digits[len(country):]
    return _refilled(found, f"{country}{permute(int(national), 10 ** len(national), 'phone'):0{len(national)}d}")


def _security(found: str, permute: Permute) -> str | None:
    area, group, serial = map(int, found.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    nth = area - 1 - (area > 666)
    value = permute((nth * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "security")
    nth, rest = divmod(value, 99 * 9999)
    group, serial = divmod(rest, 9999)
    area = nth + 1 + (nth + 1 >= 666)
    return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"


@cache
def _days(month_digits: int, day_digits: int) -> list[date]:
    """The days of 1900 to 2099 whose month and day are written with so many digits.

    Two digits are taken for a format with leading zeros, which all days have.
    """
    days = (date(1900, 1, 1) + timedelta(n) for n in range((date(2100, 1, 1) - date(1900, 1, 1)).days))
    if month_digits == day_digits == 2:
        return list(days)
    return [d for d in days if len(str(d.month)) == month_digits and len(str(d.day)) == day_digits]


def _date(found: str, permute: Permute) -> str | None:
    parts = re.split(r"[-/.]", found)
    mark = found[len(parts[0])]
    if len(parts[0]) == 4:
        orders = [(0, 1, 2)]
    else:
        orders = [(2, 0, 1), (2, 1, 0)] if mark == "/" else [(2, 1, 0)]
    for order in orders:
        try:
            day = date(*(int(parts[i]) for i in order))
        except ValueError:
            continue
        days = _days(*(len(parts[i]) for i in order[1:]))
        nth = bisect_left(days, day)
        if nth == len(days) or days[nth] != day:
            return None
        day = days[permute(nth, len(days), "date")]
        while order != orders[0] and day.day <= 12:  # it would be read with the month first
            day = days[permute(bisect_left(days, day), len(days), "date")]
        new = [""] * 3
        for i, value in zip(order, (day.year, day.month, day.day)):
            new[i] = f"{value:0{len(parts[i])}d}"
        return mark.join(new)
    return None


_RADIX = {"d": 10, "a": 26, "A": 26}
_FIRST = {"d": "0", "a": "a", "A": "A"}


def _class_of(c: str) -> str:
    return "d" if c.isdigit() else "A" if c.isupper() else "a"


def _mailbox(found: str, permute: Permute) -> str | None:
    """Digits become digits, letters letters of the same case."""
    name, _, host = found.rpartition("@")
    plain = re.findall(r"[0-9A-Za-z]", name)
    if not plain:
        return None
    classes, value, size = [_class_of(c) for c in plain], 0, 1
    for c, kind in zip(plain, classes):
        value = value * _RADIX[kind] + ord(c) - ord(_FIRST[kind])
        size *= _RADIX[kind]
    # letters of either case share a range, so that a name stays linked however it is written
    value, new = permute(value, size, "mailbox"), []
    for kind in reversed(classes):
        value, digit = divmod(value, _RADIX[kind])
        new.append(chr(ord(_FIRST[kind]) + digit))
    return re.sub(r"[0-9A-Za-z]", lambda _: new.pop(), name) + "@" + host


#: A digit of a national number, and what may stand before it.
_NATIONAL = r"(?:\)?[ ./-]?\(?\d)"
_GROUPED, _PLAIN = rf"\+{_CODE}(?=[ ./(-]){_NATIONAL}{{5,14}}", rf"\+{_CODE}\d{{5,14}}"

#: Kind, pattern and validation with replacement, in order of preference. Mailboxes, which
#: come before all of them, are found from their @: see :class:`_Mailboxes`.
KINDS: list[tuple[str, str, Callable[[str, Permute], str | None]]] = [
    ("address", r"(?<!\d\.)\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)", _address),
    ("date", r"(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}[/.]\d{1,2}[/.]\d{4})", _date),
    ("security", r"\d{3}-\d{2}-\d{4}", _security),
    ("phone", r"\+\d{1,3}[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|"
     rf"\+{_CODE}(?=[ ./(-]){_NATIONAL}{{10}}|{_GROUPED}|\+{_CODE}\d(?:[ ./-]?\d){{4,13}}(?![ ./-]?\d)|{_PLAIN}|"
     r"\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|"
     # what follows a code that is none belongs to it
     r"(?<!\+\d{4} )(?<!\+\d{5} )(?<!\+\d{6} )\d{3}[ .-]\d{3}[ .-]\d{4}", _phone),
    ("account", r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", _account),
    ("card", r"\d(?:[ -]?\d){12,18}", _card),
]

_START, _END = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
#: A date may be followed by a time of day.
_PATTERNS = {
    kind: f"(?:{pattern})" + (rf"(?:{_END}|(?=[Tt]\d))" if kind == "date" else _END) for kind, pattern, _ in KINDS
}
_ANY = re.compile(_START + "(?:" + "|".join(_PATTERNS.values()) + ")", re.ASCII)
_ONE = {kind: re.compile(pattern, re.ASCII) for kind, pattern in _PATTERNS.items()}
_REPLACE = {"mailbox": _mailbox} | {kind: replace for kind, _, replace in KINDS}

#: Kinds that are tried with fewer groups where all that matches is not valid, and what these must match.
_SHORTER = {"account": _ONE["account"], "card": _ONE["card"], "phone": re.compile(f"{_GROUPED}|{_PLAIN}", re.ASCII)}

_GROUP = re.compile(_START + "[0-9A-Za-z]", re.ASCII)
_LAST_OF_GROUP = re.compile(r"[0-9A-Z](?![0-9A-Za-z_])", re.ASCII)

_HOST = re.compile(r"@[\w-]+(?:\.[\w-]+)+" + _END, re.ASCII)
_NOT_IN_NAME = re.compile(r"[^\w.+-]", re.ASCII)


#: Characters that a mail standard allows before the @.
_LONGEST_NAME = 64


class _Mailboxes:
    """The mailboxes of a text. Each host is looked at once, each name read backwards once."""

    def __init__(self, text: str):
        self._text = text
        hosts = [match.span() for match in _HOST.finditer(text)]
        self._at, self._ends = [at for at, _ in hosts], [end for _, end in hosts]
        self._names = []
        for at in self._at:
            low = max(0, at - _LONGEST_NAME)
            before = _NOT_IN_NAME.search(text[low:at][::-1])
            self._names.append(at - before.start() if before else low)

    def end(self, start: int) -> int | None:
        """Where the mailbox that begins at ``start`` ends."""
        nth = bisect_left(self._at, start)
        if nth == len(self._at) or self._names[nth] > start or not _GROUP.match(self._text, start):
            return None
        return self._ends[nth]

    def next(self, at: int) -> int:
        """Where the next mailbox from ``at`` on begins; the end of the text if there is none."""
        for nth in range(bisect_left(self._at, at), len(self._at)):
            if match := _GROUP.search(self._text, max(at, self._names[nth]), self._at[nth]):
                return match.start()
        return len(self._text)


def _ends(kind: str, text: str, start: int, mailboxes: _Mailboxes) -> Iterator[int]:
    """Where candidates of ``kind`` that begin at ``start`` end, longest first."""
    if kind == "mailbox":
        end = mailboxes.end(start)
        if end is not None:
            yield end
        return
    match = _ONE[kind].match(text, start)
    if not match:
        return
    yield match.end()
    if kind in _SHORTER:
        for last in reversed(list(_LAST_OF_GROUP.finditer(text, start, match.end()))):
            if last.end() < match.end() and _SHORTER[kind].fullmatch(text, start, last.end()):
                yield last.end()


def _unchanged(value: int, size: int, kind: str) -> int:
    return value


def _valid(kind: str, found: str) -> bool:
    return _REPLACE[kind](found, _unchanged) is not None


def _may_be_longer(phone: str) -> bool:
    """Whether only the digits around tell where the number ends or that it is one."""
    if phone[0] != "+":
        return " " in phone and phone[0] != "("
    digits = _digits_of(phone)
    code = _CODES.match(digits)
    return bool(code) and len(digits) - len(code.group()) != 10


def _cuts(kind: str, text: str, start: int, end: int, mailboxes: _Mailboxes) -> bool:
    """Whether the last groups of a candidate are a value of another kind, or begin one.

    A last group of four digits that only may belong to a phone number is left to a card.
    """
    if kind not in _SHORTER:
        return False
    groups = [group.start() for group in _GROUP.finditer(text, start + 1, end)]
    others = [(at, other) for at in groups for other in ("mailbox", "date", "security")]
    found = text[start:end]
    if kind == "phone" and groups and _may_be_longer(found) and text[groups[-1]:groups[-1] + 4].isdigit():
        others.append((groups[-1], "card"))
    return any(
        stop >= end and _valid(other, text[at:stop])
        for at, other in others for stop in _ends(other, text, at, mailboxes)
    )


class Span(NamedTuple):
    """A value's place in the old text, and its pseudonym's in the new one."""

    kind: str
    start: int
    end: int
    new_start: int
    new_end: int


def _found(text: str) -> Iterator[tuple[str, int, int]]:
    """``(kind, start, end)`` of each valid value.

    Where no candidate is valid, the search goes on at the next character.
    """
    mailboxes = _Mailboxes(text)
    at, size = 0, len(text)
    match, mailbox = _ANY.search(text), mailboxes.next(0)
    while match or mailbox < size:
        start = min(match.start() if match else size, mailbox)
        at = start + 1
        for kind, end in ((kind, end) for kind in _REPLACE for end in _ends(kind, text, start, mailboxes)):
            if _valid(kind, text[start:end]) and not _cuts(kind, text, start, end, mailboxes):
                yield kind, start, end
                at = end
                break
        if match and match.start() < at:
            match = _ANY.search(text, at)
        if mailbox < at:
            mailbox = mailboxes.next(at)


def _replaced(text: str, places: list[tuple[str, int, int]], permute: Permute) -> tuple[str, list[tuple[int, int]]]:
    """The text with other values in the places, and where these stand."""
    parts, new_places, at, size = [], [], 0, 0
    for kind, start, end in places:
        new = _REPLACE[kind](text[start:end], permute)
        if new is None:
            raise ValueError(f"no {kind} stands at {start} to {end}")
        size += start - at
        new_places.append((size, size + len(new)))
        size += len(new)
        parts += [text[at:start], new]
        at = end
    return "".join([*parts, text[at:]]), new_places


def pseudonymize(text: str, key: bytes) -> tuple[str, list[Span]]:
    """The text with pseudonyms, and where they are."""
    places = list(_found(text))
    new, new_places = _replaced(text, places, lambda v, size, kind: permuted(v, size, key, kind))
    return new, [Span(*old, *place) for old, place in zip(places, new_places)]


def restore(text: str, spans: Sequence[Span], key: bytes) -> str:
    """The text that :func:`pseudonymize` has given these spans for."""
    places = [(s.kind, s.new_start, s.new_end) for s in spans]
    return _replaced(text, places, lambda v, size, kind: permuted(v, size, key, kind, back=True))[0]


_SPANS = "spans array<struct<kind:string,start:long,end:long,new_start:long,new_end:long>>"
_SPAN_LIST = pa.list_(pa.struct([
    ("kind", pa.string()), *((name, pa.int64()) for name in ("start", "end", "new_start", "new_end")),
]))


def pseudonym_batches(key: bytes):
    """mapInArrow function: texts with pseudonyms, other columns, and the spans that were replaced."""

    def pseudonyms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            # most texts have neither digits nor an @
            suspects = pc.fill_null(pc.match_substring_regex(texts, "[0-9@]"), False)
            new, spans = texts.to_pylist(), [[]] * len(texts)
            for i in pc.indices_nonzero(suspects).to_pylist():
                new[i], found = pseudonymize(new[i], key)
                spans[i] = [span._asdict() for span in found]
            columns = dict(zip(batch.schema.names, batch.columns))
            columns |= {"text": pa.array(new, pa.string()), "spans": pa.array(spans, _SPAN_LIST)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return pseudonyms


def restored_batches(key: bytes):
    """mapInArrow function: the inverse of :func:`pseudonym_batches`."""

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                restore(text, [Span(**s) for s in spans], key) if spans else text
                for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())
            ]
            columns = dict(zip(batch.schema.names, batch.columns))
            columns["text"] = pa.array(texts, pa.string())
            del columns["spans"]
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return restored


def replace_personal(
    docs: DataFrame, key: bytes, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``(doc_id, text, other columns, spans)``: texts with pseudonyms, and where these are."""
    replaced = {name.lower() for name in (id_column, text_column, "doc_id", "text", "spans")}
    others = [F.col(f"`{name}`") for name in docs.columns if name.lower() not in replaced]
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), *others)
    spans = StructType.fromDDL(_SPANS)
    return docs.mapInArrow(pseudonym_batches(key), StructType([*docs.schema, *spans]))


def restore_personal(replaced: DataFrame, key: bytes) -> DataFrame:
    """What :func:`replace_personal` was given, from all that it returned and the key."""
    kept = StructType([f for f in replaced.schema if f.name != "spans"])
    return replaced.mapInArrow(restored_batches(key), kept)
