"""Personal data by anchor expansion.

One Aho-Corasick pass over a text, with A-Z as a-z, finds anchors: at-signs, plus
signs and digits, scheme marks, and words that announce an identifier. From each anchor a
small deterministic parser walks outwards and checks what it found; every
parser is linear in the text. Spans are in code points, ends exclusive.

Base kinds (email, ip, card, phone) follow fixed patterns, leftmost and
non-overlapping per kind, failing matches dropped. The method adds url (after a
scheme mark), account (an identifier of 8 to 34 letters and digits, four digits
at the least, after a cue) and secret (a value of 16 characters or more, of any
length, after a cue such as `token =`).

Cases. A null or empty text has no spans and the digest of the empty string. Very
long texts and values are searched whole. Spans of different kinds may overlap;
of one kind the leftmost counts. Repeated rows are searched alike. No rows: no
result. Columns beside doc_id and text don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship

ship(__name__)

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "secret")
# Cues, found in any case.
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "compte", "cuenta", "passport", "ssn")
SECRET_CUES = ("token", "api_key", "api key", "api-key", "apikey", "secret", "password", "passwd")

DIGITS = frozenset("0123456789")
ALNUM = frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
FOLD = {ord(c): ord(c.lower()) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
URL_STOP = frozenset(" \t\n\x0b\x0c\r\"'<>`{}|\\^")


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for c in DIGITS:
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("email", 1))
    a.add_word("+", ("phone", 1))
    a.add_word("://", ("url", 3))
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            a.add_word(cue, (kind, len(cue)))
    a.make_automaton()
    return a


def _email(text: str, at: int, low: int) -> tuple[int, int] | None:
    start, n = at, len(text)
    while start > low and text[start - 1] in LOCAL:
        start -= 1
    if start == at:
        return None
    end = at + 1
    while end < n and text[end] in LABEL:
        end += 1
    if end == at + 1:
        return None
    first = end
    while end + 1 < n and text[end] == "." and text[end + 1] in LABEL:
        end += 1
        while end < n and text[end] in LABEL:
            end += 1
    return (start, end) if end > first else None


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _card(text: str, at: int) -> tuple[int, bool]:
    """End of the digits from here, single spaces or hyphens between them; whether they are a card's."""
    end, digits, n = at + 1, [text[at]], len(text)
    while end < n:
        if text[end] in DIGITS:
            digits.append(text[end])
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS:
            digits.append(text[end + 1])
            end += 2
        else:
            break
    return end, 16 <= len(digits) <= 19 and _luhn("".join(digits))


def _run(text: str, at: int) -> int:
    n = len(text)
    while at < n and text[at] in DIGITS:
        at += 1
    return at


def _ip(text: str, at: int, end: int) -> tuple[int, bool] | None:
    """From a run of digits (at to end): the end of four dotted runs; whether all are 255 at most."""
    parts = [(at, end)]
    for _ in range(3):
        if end + 1 >= len(text) or text[end] != "." or text[end + 1] not in DIGITS:
            return None
        parts.append((end + 1, end := _run(text, end + 1)))
    return end, all(len(x := text[a:b].lstrip("0")) <= 3 and int(x or 0) <= 255 for a, b in parts)


def _phone(text: str, at: int) -> tuple[int, bool] | None:
    n = len(text)
    if at + 1 >= n or text[at + 1] not in DIGITS:
        return None
    stop = at + 2
    while stop < n and text[stop] in PHONE:
        stop += 1
    end = stop
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end < at + 4 or text[end - 1] not in DIGITS:
        return None
    return end, 8 <= sum(c in DIGITS for c in text[at:end]) <= 15


def _url(text: str, mark: int, low: int) -> tuple[int, int] | None:
    start, n = mark, len(text)
    while start > low and text[start - 1] in ALNUM:
        start -= 1
    if mark - start < 3:  # no scheme: the rest isn't read, so that many such marks stay linear
        return None
    end = mark + 3
    while end < n and text[end] not in URL_STOP:
        end += 1
    while end > mark + 3 and text[end - 1] in ".,;:!?)]":
        end -= 1
    return (start, end) if end - mark - 3 >= 4 else None


#: A group of letters and digits: it has a digit, or is four capitals (a bank's code) before one that starts with a digit.
_GROUP = r"(?:(?=[A-Za-z]{0,33}[0-9])|(?=[A-Z]{4}[ -][0-9]))[A-Za-z0-9]{1,34}(?![A-Za-z0-9])"
_ACCOUNT = re.compile(rf"(?:[ \t]{{0,8}}(?:no|nr|number)\b\.?)?[ \t]{{0,8}}[:=#]?[ \t]{{0,8}}({_GROUP}(?:[ -]{_GROUP}){{0,33}})")
_SECRET = re.compile(r"[ \t]*[:=][ \t]*[\"']?([A-Za-z0-9+/_\-]{16,})")


def find(text: str, automaton) -> dict[str, list[tuple[int, int]]]:
    """The spans of each kind."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    low = dict.fromkeys(KINDS, 0)  # no span of a kind starts before its last one's end
    run_end = 0
    folded = text.lower()
    if len(folded) != len(text):  # some letters have lower cases of several characters, which would shift what follows
        folded = text.translate(FOLD)
    for last, (kind, size) in automaton.iter(folded):
        at = last - size + 1
        if kind == "digit":
            if at >= low["card"]:
                end, good = _card(text, at)
                low["card"] = end
                if good:
                    out["card"].append((at, end))
            if at >= run_end and at >= low["ip"]:
                run_end = _run(text, at)
                if found := _ip(text, at, run_end):
                    low["ip"] = found[0]
                    if found[1]:
                        out["ip"].append((at, found[0]))
        elif kind == "phone":
            if at >= low["phone"] and (found := _phone(text, at)):
                low["phone"] = found[0]
                if found[1]:
                    out["phone"].append((at, found[0]))
        elif at >= low[kind]:
            if kind in ("email", "url"):
                found = (_email if kind == "email" else _url)(text, at, low[kind])
            else:
                m = (_ACCOUNT if kind == "account" else _SECRET).match(text, last + 1)
                found = m and m.span(1)
                if found and kind == "account" and not (8 <= sum(c in ALNUM for c in m[1]) <= 34 and sum(c in DIGITS for c in m[1]) >= 4):
                    found = None
            if found:
                low[kind] = found[1]
                out[kind].append(found)
    return out


def joined(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in sorted(spans[k]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_url, n_account, n_secret."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            counts, digests, spans = [[] for _ in KINDS], [], []
            for text in batch.column(1):
                found = find(text.as_py() or "", automaton)
                for c, k in zip(counts, KINDS, strict=True):
                    c.append(len(found[k]))
                digests.append(hashlib.sha256(joined(found, BASE).encode()).hexdigest())
                spans.append(joined(found, KINDS))
            numbers, n = [pa.array(c, pa.int64()) for c in counts], len(BASE)
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers[:n], pa.array(digests, pa.string()), pa.array(spans, pa.string()), *numbers[n:]], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", *(f"n_{k}" for k in KINDS[n:])])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_url long, n_account long, n_secret long")
