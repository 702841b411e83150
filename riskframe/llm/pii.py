"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Base kinds and their rules (leftmost, not overlapping within a kind; a match that fails its check is
dropped and not retried):

    email   [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip      four dotted numbers, each at most 255
    card    [0-9]([\\x20-]?[0-9])+ of 16 to 19 digits that pass Luhn
    phone   \\+[0-9][\\x20().0-9-]+[0-9] of 8 to 15 digits

Added kinds: ``iban`` (mod-97, as one word or printed with single blanks), ``access_key`` and ``secret``
(what is assigned to the name of a password or token). Base spans are always reported; added ones from
``MIN_SCORE`` on. A printed IBAN that has not the length of its country starts below it, so words nearby
decide; every assigned secret starts at it.

The scanners run in time linear in the text: a plain search for the email or ip pattern would try
every start in a long run of digits or letters again.

A null or empty text has no spans. Repeated rows give repeated results. Positions are code points,
end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Batches, in_slices, keep_only, keyed_texts

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "access_key", "secret")
KINDS = BASE_KINDS + ADDED_KINDS

MIN_SCORE = 0.6
#: Characters on either side of a span in which context words count.
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.2
#: Score before context: a validated checksum says more than a shape.
START_SCORE = {"email": 0.7, "ip": 0.5, "card": 0.8, "phone": 0.5, "iban": 0.8, "access_key": 0.8, "secret": 0.6}
#: Instead of START_SCORE, for spans a finder marks as weak: context decides.
WEAK_SCORE = 0.5
CONTEXT_WORDS = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"), "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "transfer"), "access_key": ("key", "aws", "access"),
    "secret": ("login", "user", "secret", "credential"),
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN_START = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_IBAN_REST = re.compile(r"(?:\x20?[A-Z0-9]){11,30}")
_ACCESS_KEY = re.compile(r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])")
_SECRET_NAME = re.compile(r"(?:password|passwd|pwd|secret|token|api[_-]?key)[\x20\t\"']*[=:][\x20\t]*[\"']?", re.IGNORECASE)
_SECRET_VALUE = re.compile(r"[^\s\"']{6,}")
_NOT_DIGITS = re.compile(r"[^0-9]+")

#: Characters of an IBAN by country.
IBAN_LENGTHS = {country: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT ST",
    26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU",
    31: "MT SC", 32: "LC",
}.items() for country in countries.split()}

#: start, end and, if the shape says little, True
Span = tuple[int, int] | tuple[int, int, bool]


def emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def ips(text: str) -> Iterator[Span]:
    for run in _DOTTED.finditer(text):
        if run.end() - run.start() < 7 or run.group().count(".") < 3:
            continue
        parts, at = run.group().split("."), run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                yield at, end
            at = end + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGITS.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[Span]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGITS.sub("", m.group())) <= 15:
                yield m.span()


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def ibans(text: str) -> Iterator[Span]:
    """Of the ends a candidate may have, the one that gives the length of its country, else that of its
    first word, else the longest that passes."""
    done = 0
    for m in _IBAN_START.finditer(text):
        start = m.start()
        rest = _IBAN_REST.match(text, m.end()) if start >= done else None
        if not rest:
            continue
        ends = [e for e in range(rest.end(), m.end() + 10, -1) if text[e - 1] != " " and not (text[e:e + 1].isascii() and text[e:e + 1].isalnum())]
        plain = {e: text[start:e].replace(" ", "") for e in ends}
        passed = [e for e in ends if len(plain[e]) >= 15 and mod97(plain[e])]
        known = [e for e in passed if len(plain[e]) == IBAN_LENGTHS.get(m.group()[:2])] or [e for e in passed if len(plain[e]) == e - start]
        if passed:
            done = (known or passed)[0]
            yield start, done, not known


def access_keys(text: str) -> Iterator[Span]:
    return (m.span() for m in _ACCESS_KEY.finditer(text)) if "AKIA" in text else iter(())


def secrets(text: str) -> Iterator[Span]:
    done = 0
    for m in _SECRET_NAME.finditer(text) if "=" in text or ":" in text else ():
        value = _SECRET_VALUE.match(text, m.end()) if m.end() >= done else None
        if value:
            done = value.end()
            yield value.span()


FINDERS = {
    "email": emails, "ip": ips, "card": cards, "phone": phones,
    "iban": ibans, "access_key": access_keys, "secret": secrets,
}


def scored_spans(text: str) -> list[tuple[str, int, int, float]]:
    """All spans of one text in order of kind, then start."""
    found = []
    for kind in KINDS:
        for start, end, *weak in FINDERS[kind](text):
            near = text[max(0, start - CONTEXT_CHARS):start].lower() + " " + text[end:end + CONTEXT_CHARS].lower()
            score = (WEAK_SCORE if any(weak) else START_SCORE[kind]) + CONTEXT_BONUS * any(w in near for w in CONTEXT_WORDS[kind])
            if kind in BASE_KINDS or score >= MIN_SCORE:
                found.append((kind, start, end, round(score, 2)))
    return found


SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def _span_array(all_spans: list[list[tuple]]) -> pa.Array:
    names = [f.name for f in SPAN_TYPE.value_type]
    return pa.array([[dict(zip(names, s)) for s in spans] for spans in all_spans], SPAN_TYPE)


def _scan(batches: Batches) -> Batches:
    for batch in batches:
        spans = _span_array([scored_spans(t) for t in batch.column("text").to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), spans], names=["doc_id", "spans"])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, spans (kind, start, end, score)."""
    return keyed_texts(docs, id_col, text_col).mapInArrow(
        _scan, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")


def redacted(text: str | None) -> str | None:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the one
    that starts first, then the longer one, is replaced and the other with it."""
    spans = sorted((s, -e, kind) for kind, s, e, _ in scored_spans(text)) if text else []
    if not spans:
        return text
    parts, at = [], 0
    for start, neg_end, kind in spans:
        end = -neg_end
        if start >= at:
            parts += [text[at:start], f"<{kind}>"]
            at = end
        else:
            at = max(at, end)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with personal data replaced."""
    def run(batches: Batches) -> Batches:
        keep_only("pii")
        for batch in in_slices(batches):
            i = batch.schema.get_field_index(text_col)
            texts = pa.array([redacted(t) for t in batch.column(i).to_pylist()], batch.schema.field(i).type)
            yield batch.set_column(i, batch.schema.field(i), texts)
    return docs.mapInArrow(run, docs.schema)


def digests(found: DataFrame) -> DataFrame:
    """Counts and digest columns of ``find``."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.filter("spans", lambda s: s.kind.isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
