"""Personal data: patterns propose spans, checksums confirm them, context words nearby move their scores."""

from __future__ import annotations

import hashlib
import re
import sys
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import appended, documents, fresh, slices, texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
_MAIL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_MAIL_RIGHT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match begins with a run of digits, as the one before ends with one, so no run is read from its middle.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGITS = re.compile(r"[0-9]")
_GROUP = re.compile(r"[0-9]+")
#: Words that speak for a kind, within CONTEXT characters before a span or behind it.
WORDS = {
    "email": re.compile(r"mail|contact|write|kontakt|correo|courriel", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|adresse|direcci", re.I),
    "card": re.compile(r"card|visa|credit|payment|karte|tarjeta|carte", re.I),
    "phone": re.compile(r"phone|call|tel|mobile|fax|anruf|llam|appel", re.I),
    "iban": re.compile(r"iban|bank|account|konto|cuenta|compte", re.I),
    "ssn": re.compile(r"ssn|social|security|tax", re.I),
}
#: What is no personal data of its kind speaks against it: versions, order numbers, samples.
AGAINST = re.compile(r"version|release|example|order|invoice|serial", re.I)
CONTEXT = 40
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.7, "ssn": 0.3}
INNER = 0.6  # cards and phones inside runs of digits that are too long for one
FOR, OPPOSED = 0.3, 0.25
#: Further spans need this score, so context decides: for an ssn a word must speak for it, the others go where one
#: speaks against them and none for them.
LEAST = 0.5


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float
    base: bool = True


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ back over what may stand before it and on over the domain: as a search from the left, in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        left = at
        while left > done and text[left - 1] in _MAIL_CHARS:
            left -= 1
        m = _MAIL_RIGHT.match(text, at) if left < at else None
        if m:
            yield left, m.end()
            done = m.end()
        at = text.find("@", m.end() if m else at + 1)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split(".")):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 40:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGITS.findall(m[0])) <= 15:
                yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Of a match, the longest beginning that ends at a space or at the match's end and passes mod-97."""
    for m in _IBAN.finditer(text):
        found = m[0]
        while len(own := found.replace(" ", "")) >= 15:
            if len(own) <= 34 and mod97(own):
                yield m.start(), m.start() + len(found)
                break
            found = found.rpartition(" ")[0]


def ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


def inner_cards(text: str) -> Iterator[tuple[int, int]]:
    """In runs of more than 19 digits, whole groups of four digits or more that together pass as a card."""
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 33:
            continue
        groups = list(_GROUP.finditer(text, m.start(), m.end()))
        i = 0
        while i < len(groups):
            digits, j = "", i
            while j < len(groups) and len(groups[j][0]) >= 4 and len(digits) + len(groups[j][0]) <= 19:
                digits += groups[j][0]
                j += 1
                if len(digits) >= 16 and luhn(digits):
                    yield groups[i].start(), groups[j - 1].end()
                    i = j - 1
                    break
            i += 1


class Taken:
    """Places that are taken, as intervals that don't touch each other, in order; looked up by bisection."""

    def __init__(self, places: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for a, b in sorted(places):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def next(self, start: int) -> int:
        """Where the first interval begins that ends behind `start`."""
        i = bisect_right(self.ends, start)
        return self.starts[i] if i < len(self.starts) else sys.maxsize

    def add(self, start: int, end: int) -> bool:
        """Takes a place if it is free."""
        if self.next(start) < end:
            return False
        i = bisect_right(self.ends, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)
        return True


def inner_phones(text: str, taken: Taken) -> Iterator[tuple[int, int]]:
    """In matches of more than 15 digits, the longest beginning of 8 to 15 that ends with a group and touches no other span."""
    for m in _PHONE.finditer(text) if "+" in text else ():
        digits, best = 0, None
        if len(_DIGITS.findall(m[0])) <= 15:
            continue
        edge = taken.next(m.start())
        for g in _GROUP.finditer(text, m.start(), m.end()):
            digits += len(g[0])
            if digits > 15 or edge < g.end():
                break
            if digits >= 8:
                best = g.end()
        if best:
            yield m.start(), best


_FIND = dict(zip(KINDS, (emails, ips, cards, phones, ibans, ssns), strict=True))


def score(text: str, kind: str, start: int, end: int, prior: float | None = None) -> float:
    near = f"{text[max(0, start - CONTEXT) : start]} {text[end : end + CONTEXT]}"
    x = PRIOR[kind] if prior is None else prior
    x += FOR * (WORDS[kind].search(near) is not None) - OPPOSED * (AGAINST.search(near) is not None)
    return round(min(1.0, max(0.0, x)), 2)


def spans(text: str, more: bool = True) -> list[Span]:
    """The spans of a text, by kind and then by start, in code points; end is exclusive.

    The four base kinds keep each span that passes its own check, whatever its score. With `more` there are further
    ones, which need a score of LEAST and give way where they touch a base span or an earlier further one: cards and
    phones inside runs that are too long to be one, and kinds that pass a checksum or range check. The time is n log n
    in the number of spans.
    """
    if not (_DIGITS.search(text) or "@" in text):
        return []
    found = [Span(kind, start, end, score(text, kind, start, end)) for kind in BASE for start, end in _FIND[kind](text)]
    if more:
        taken = Taken([(x.start, x.end) for x in found])
        extra = [("card", inner_cards(text)), *((k, _FIND[k](text)) for k in KINDS[len(BASE) :])]
        for kind, places in [*extra, ("phone", inner_phones(text, taken))]:
            for start, end in places:
                s = score(text, kind, start, end, INNER if kind in BASE else None)
                if s >= LEAST and taken.add(start, end):
                    found.append(Span(kind, start, end, s, False))
        found.sort(key=lambda x: (KINDS.index(x.kind), x.start))
    return found


def joined(found: list[Span]) -> str:
    return ",".join(f"{x.kind}:{x.start}:{x.end}" for x in found)


def masked(text: str, found: list[Span]) -> str:
    """The text with each span replaced by its kind; spans that overlap become one, named after the first."""
    parts, at = [], 0
    for x in sorted(found, key=lambda x: (x.start, -x.end)):
        if x.start >= at:
            parts += [text[at : x.start], f"<{x.kind.upper()}>"]
        at = max(at, x.end)
    return "".join([*parts, text[at:]])


def with_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """df with pii (array of kind, start, end, score) and masked (the text without them).

    Null and empty texts have no spans, and masked is as the text; texts of any length are read whole. Spans are ordered
    by kind and start, so there are no ties. Repeated rows get the same each, an empty table gives an empty one. Columns
    of these names give way, others stay.
    """
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column=text):
            own = batch.column(batch.schema.get_field_index(text)).to_pylist()
            all_found = [spans(x or "") for x in own]
            yield appended(batch, {"pii": pa.array([[{k: v for k, v in x._asdict().items() if k != "base"} for x in s] for s in all_found], pa.list_(item)), "masked": pa.array([x and masked(x, s) for x, s in zip(own, all_found, strict=True)], pa.string())})

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in ("pii", "masked"))
    return df.mapInArrow(find, f"{kept}, pii array<struct<kind:string,start:bigint,end:bigint,score:double>>, masked string")


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """Counts, digest, places and scores of the personal data in every whole text of documents, a row for a row.

    `scores` has a score for each of `spans`, in their order. Nulls, empty and long texts, ties, repeated rows and empty
    tables as with_spans states; of other columns none is read.
    """
    out = StructType([StructField("doc_id", LongType()), *(StructField(f"n_{k}", LongType()) for k in BASE), *(StructField(c, StringType()) for c in ("base_sha256", "spans", "scores"))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, digest, every, scores = {k: [] for k in BASE}, [], [], []
            for text in texts(batch):
                found = spans(text)
                base = [x for x in found if x.base]
                for k in BASE:
                    n[k].append(sum(x.kind == k for x in base))
                digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                every.append(joined(found))
                scores.append(",".join(f"{x.score:.2f}" for x in found))
            yield appended(batch, {**{f"n_{k}": pa.array(n[k], pa.int64()) for k in BASE}, "base_sha256": pa.array(digest), "spans": pa.array(every, pa.string()), "scores": pa.array(scores, pa.string())}, ("text",))

    return documents(spark, sf_dir).select("doc_id", "text").mapInArrow(find, out)


def pii_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked and n_chars counted anew where a text has changed.

    Base spans are masked whatever their score, as a clear text is the worse mistake; further ones have LEAST or more.
    Columns that clash with those of with_spans are set aside meanwhile, so none is lost.
    """
    names = {c: fresh(docs, f"own_{i}") for i, c in enumerate(docs.columns)}
    found = with_spans(docs.withColumnsRenamed({c: n for c, n in names.items() if c != "text"}))
    changed = F.size("pii") > 0
    new = {"text": F.when(changed, F.col("masked")).otherwise(F.col("text"))}
    if "n_chars" in names:
        new["n_chars"] = F.when(changed, F.length("masked").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(names["n_chars"]))
    return found.select(*[new.get(c, F.col(n)).alias(c) for c, n in names.items()])
