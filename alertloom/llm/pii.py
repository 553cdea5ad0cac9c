"""Personal data by anchor expansion.

Method: one Aho-Corasick pass finds anchors (at-signs, schemes, digit cues and identifier words); at each, a deterministic local parser
expands to the boundaries of an email, address, card, phone or account number and validates it. Base kinds follow their
grammars exactly, leftmost and without overlap in a kind; ``url`` (a scheme with credentials or a mail address) and
``account`` (an identifier word with a number of six digits or more, of 34 characters at most) add to them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import lean, pick

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")
CUES = ("iban", "ssn", "passport", "account", "acct")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "mailto:")

_DIGITS = "0123456789"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_RUN = re.compile("[0-9]+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[!#-;=?-~]*")
#: An account number has ``ACCOUNT_MOST`` letters and digits at most, as the longest kind (IBAN).
ACCOUNT_MOST = 34
_ACCOUNT = re.compile(r"[\x20:#=.]{0,8}(?:(?:no|number|nr)[\x20:#=.]{0,8})?([A-Za-z0-9](?:[\x20-]?[A-Za-z0-9]){0,33})(?![A-Za-z0-9])", re.IGNORECASE | re.ASCII)

_automaton = None


def automaton():
    global _automaton
    if _automaton is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        a.add_word("@", ("email", 1))
        for d in _DIGITS:
            a.add_word(f"+{d}", ("phone", 2))
            for e in _DIGITS:
                a.add_word(f"{d}.{e}", ("ip", 3))
                for sep in ("", " ", "-"):
                    a.add_word(f"{d}{sep}{e}", ("card", 2 + len(sep)))
        for s in SCHEMES:
            a.add_word(s, ("url", len(s)))
        for c in CUES:
            for form in (c, c.upper(), c.capitalize()):
                a.add_word(form, ("account", len(c)))
        a.make_automaton()
        _automaton = a
    return _automaton


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else 2 * v - 9 * (v > 4)
    return total % 10 == 0


def _digit(c: str) -> bool:
    return "0" <= c <= "9"


def _octet(digits: str) -> bool:
    """At most 255, however many digits there are."""
    digits = digits.lstrip("0")
    return len(digits) < 3 or (len(digits) == 3 and digits <= "255")


def _dotted(text: str, a: int, z: int) -> list[tuple[int, int]]:
    """Addresses among the digits and dots of [a, z): runs of digits with one dot between them, taken by fours from the left."""
    out, held = [], []
    for m in _RUN.finditer(text, a, z):
        if held and held[-1].end() + 1 != m.start():
            held = []
        held.append(m)
        if len(held) == 4:
            if all(_octet(x.group()) for x in held):
                out.append((held[0].start(), m.end()))
            held = []
    return out


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind in order, in code points."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)  # where the last region of each kind ended
    n = len(text)
    for end, (kind, size) in automaton().iter(text):
        at = end + 1 - size
        if kind == "email":
            a = at
            while a > done["email"] and text[a - 1] in _LOCAL:
                a -= 1
            if a < at and (m := _DOMAIN.match(text, at + 1)):
                out["email"].append((a, m.end()))
                done["email"] = m.end()
        elif at < done[kind] and kind != "phone":
            continue
        elif kind == "ip":
            a, z = at, end + 1
            while a > 0 and (_digit(text[a - 1]) or text[a - 1] == "."):
                a -= 1
            while z < n and (_digit(text[z]) or text[z] == "."):
                z += 1
            out["ip"] += _dotted(text, a, z)
            done["ip"] = z
        elif kind == "card":
            a, z = at, end + 1
            while a > 0 and (_digit(text[a - 1]) or (text[a - 1] in " -" and a > 1 and _digit(text[a - 2]))):
                a -= 1
            while z < n and (_digit(text[z]) or (text[z] in " -" and z + 1 < n and _digit(text[z + 1]))):
                z += 1
            done["card"] = z
            digits = [c for c in text[a:z] if _digit(c)]
            if 16 <= len(digits) <= 19 and luhn("".join(digits)):
                out["card"].append((a, z))
        elif kind == "phone":
            if (m := _PHONE.match(text, at)) and 8 <= sum(map(_digit, m.group())) <= 15:
                out["phone"].append(m.span())
        elif kind == "url":
            z = _URL.match(text, end + 1).end()
            done["url"] = z
            if "@" in text[end + 1 : z]:
                out["url"].append((at, z))
        elif (at == 0 or not text[at - 1].isalnum()) and (m := _ACCOUNT.match(text, end + 1)) and m.start(1) > end + 1:
            a, z = m.span(1)
            words = text[a:z].split(" ")  # up to the last word with a digit
            while words and not any(map(_digit, words[-1])):
                z -= len(words.pop()) + 1
            if words and any(map(_digit, words[0])) and sum(map(_digit, text[a:z])) >= 6:
                out["account"].append((a, z))
                done["account"] = z
    return out


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``spans``: an array of (kind, start, end, base), by kind in the order of ``KINDS``, then start.

    Null and empty texts have no spans. Null ids and repeated rows are carried through; other columns are ignored; an empty
    table gives none. Texts of any length are read whole, in linear time. Starts and ends are in code points, ends exclusive.
    """
    src = pick(docs, doc_id=id_col, text=text_col)
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                rows = []
                for t in part.column(1):
                    t = t.as_py()
                    rows.append([(k, a, z, k in BASE_KINDS) for k, spans in find(t).items() for a, z in sorted(spans)] if t else [])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in r] for r in rows], pa.list_(item))], ["doc_id", "spans"])

    return src.mapInArrow(lean(run), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int,base:boolean>>")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digests(found: DataFrame, kinds: tuple[str, ...] = BASE_KINDS) -> DataFrame:
    """Counts of each base kind, the SHA-256 of the base spans, and all spans as text."""
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(joined(F.filter("spans", lambda x: x["base"])), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
