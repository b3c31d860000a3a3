"""Personal data: base patterns, and candidate spans that boosted trees choose.

Generators with high recall propose overlapping spans: loose patterns (spelled-out addresses, dotted or bare phone
numbers, card numbers with other separators, ...), and what lies in and around a base span. Boosted trees score them by
format and context. Whether a candidate is right is told by checks that the trees don't see: digits that add up,
parts in range, a domain that ends in letters, and an end where the whole entity ends. Scores are calibrated on real
candidates of texts left out of the fit, and a threshold for each kind picks what is ``PRECISION`` likely; of
overlapping ones the likeliest stays. Spans of the base patterns always stay.

Secrets (keys, tokens, passwords) are no personal data, but are found the same way and redacted too: the trees see the
format only, and learn it from values that are assigned to a name which says so.

The trees are fitted on the candidates of a bounded sample of distinct texts (``SAMPLE``), and on base spans rewritten
in looser formats or spoilt.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from athletrack.llm.base import distinct_sample, sliced
from athletrack.llm.trees import Boosted, isotonic, threshold

KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
ALL_KINDS = (*KINDS, SECRET)
SAMPLE = 4_000
PRECISION = 0.99
CONTEXT = 24

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_AT = re.compile(r"(?: ?(?:\(at\)|\[at\]|@) ?| at )([A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]| dot |\.) ?[A-Za-z0-9-]{1,63}){1,4})")
_LOOSE = {
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,4}(?: ?[.,] ?[0-9]{1,4}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[ .,/_-]{0,3}[0-9]{2,6}){2,4}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9A-Za-z])(?:00|\(|\+ ?)?[0-9]{1,4}(?:[ ()./-]{1,2}[0-9]{2,5}){2,5}(?![0-9A-Za-z])"),
    SECRET: re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,256}(?![A-Za-z0-9+/_-])"),
}
_ASSIGNED = re.compile(r"(?:key|token|secret|passw(?:or)?d|pwd|auth|bearer)[\"']?\s*[:=]\s*[\"']?$", re.I)
_TAIL = re.compile(r"[ .,:;()/-]{1,2}[0-9A-Za-z]{1,6}")  # what may follow an entity as if it were part of it
_HINTS = {
    "email": ("mail", "contact", "write", "@"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "pay", "credit"),
    "phone": ("phone", "call", "tel", "mobile"),
    SECRET: (),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, reach, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > reach and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, reach := m.end()))
        at = text.find("@", max(at + 1, reach))
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind in the order of ``KINDS``, then by start; each kind leftmost and without overlaps."""
    out = [("email", *s) for s in emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    return out + [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Proposed spans; they overlap each other and the base spans."""
    out = set(base)
    if "@" in text or " at " in text or "at)" in text or "at]" in text:
        for m in _AT.finditer(text):
            start = m.start()
            while m.start() - start < 64 and start and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start() and (m.group()[:4] != " at " or " dot " in m.group()):
                out.add(("email", start, m.end()))
    if _HAS_DIGITS.search(text):
        out.update((k, *m.span()) for k in KINDS[1:] for m in _LOOSE[k].finditer(text))
        out.update((SECRET, *m.span()) for m in _LOOSE[SECRET].finditer(text) if not m.group().isalpha())
    for kind, start, end in base:  # around and inside
        if m := _TAIL.match(text, end):
            out.add((kind, start, m.end()))
        inner = max(text.rfind(c, start, end) for c in ".- @")
        if inner > start:
            out.add((kind, start, inner))
    return sorted(out)


_HAS_DIGITS = re.compile(r"[0-9][ ()./,_-]{0,3}[0-9]|[0-9][A-Za-z]|[A-Za-z][0-9]")


def right(text: str, kind: str, start: int, end: int) -> bool:
    """Whether a candidate is a whole entity, by checks that no feature shows."""
    s = text[start:end]
    if kind == SECRET:
        return bool(_ASSIGNED.search(text, max(0, start - CONTEXT), start))
    if text[end : end + 1].isalnum() or text[end : end + 1] in ("-", "@") and text[end + 1 : end + 2].isalnum():
        return False  # it goes on
    if kind == "email":
        plain = re.sub(r" ?(?:\(at\)|\[at\]| at |@) ?", "@", s, count=1)
        plain = re.sub(r" ?(?:\(dot\)|\[dot\]| dot ) ?", ".", plain)
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", plain)) and not re.match(r"\.[A-Za-z0-9]", text[end : end + 2])
    digits = _digits(s)
    if text[end : end + 1] in (".", ",") and text[end + 1 : end + 2].isdigit():
        return False
    if kind == "ip":
        parts = re.findall("[0-9]+", s)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and s[0] in "+(0"


def describe(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context features of a candidate; of a secret the format only."""
    s = text[start:end]
    digits = _digits(s)
    groups = re.findall(r"[0-9]+", s)
    shape = [
        len(s),
        len(digits),
        len(groups),
        max(map(len, groups), default=0),
        min(map(len, groups), default=0),
        len(groups[-1]) if groups else 0,
        sum(not c.isalnum() for c in s),
        s.count(" "),
        s.count("."),
        s.startswith("+"),
        "(" in s,
        "@" in s,
        len(set(re.findall(r"[^0-9A-Za-z]", s))),
        s.lower().count(" dot ") + s.count("(dot)") + s.count("[dot]"),
        len(re.split(r"[. ]", s)[-1]) if kind == "email" else 0,
        sum(c.isupper() for c in s) / len(s),
        len(set(s)) / len(s),
        sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:])),
    ]
    if kind == SECRET:
        return [float(x) for x in shape]
    before, after = text[max(0, start - CONTEXT) : start].lower(), text[end : end + CONTEXT].lower()
    return [
        *map(float, shape),
        bool(before[-1:]) and before[-1].isalnum(),
        bool(after[:1]) and after[0].isalnum(),
        bool(before[-1:]) and before[-1] in "=\"'/#",
        before[-1:].isdigit() or before[-2:-1].isdigit(),
        after[:1].isdigit() or after[1:2].isdigit(),
        any(h in before for h in _HINTS[kind]),
        sum(c.isdigit() for c in before + after),
    ]


def _looser(kind: str, s: str) -> list[str]:
    """A base span written in looser formats: what the base patterns miss."""
    d = _digits(s)
    if kind == "email":
        local, _, domain = s.partition("@")
        return [f"{local} at {domain.replace('.', ' dot ')}", f"{local} (at) {domain}", f"{local} [at] {domain.replace('.', ' [dot] ')}"]
    if kind == "card":
        return [sep.join(d[i : i + 4] for i in range(0, len(d), 4)) for sep in (".", "/", " - ")]
    if kind == "phone":
        return [f"00{d[:-10]} {d[-10:-7]} {d[-7:-4]} {d[-4:]}", f"({d[-10:-7]}) {d[-7:-4]}-{d[-4:]}"]
    return [s.replace(".", " . ")]


def _spoilt(kind: str, s: str) -> list[str]:
    """A base span changed so that the base rules reject it, and number lists that are none."""
    d = _digits(s)
    if kind == "email":
        local, _, domain = s.partition("@")
        return [f"{local}@{domain.replace('.', '')}", f"{local} at {domain.partition('.')[0]}"]
    if kind == "card":
        off = d[:-1] + str((int(d[-1]) + 1) % 10)
        return [off, ".".join(off[i : i + 4] for i in range(0, len(off), 4)), f"{d[:4]}, {d[4:6]} {d[6:8]} {d[8:10]}", f"{d[:4]} {d[4:8]} {d[8:10]}"]
    if kind == "phone":
        return [f"{d[:2]} {d[2:4]} {d[4:6]}", f"{d[-4:]}-{d[:2]}-{d[2:4]}", f"{d[:3]} {d[3:6]}"]
    return [f"{int(d[:2] or 0) + 300}.{s.partition('.')[2]}", ". ".join(s.split(".")[:3]), s.replace(".", ", ")]


class Taken:
    """Intervals that don't overlap each other."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, start: int, end: int) -> bool:
        return bisect_right(self.ends, start) < bisect_left(self.starts, end)

    def add(self, start: int, end: int) -> None:
        """An interval that meets none."""
        insort(self.starts, start)
        insort(self.ends, end)


class Detector:
    """Fitted on texts; ``spans`` gives base and added spans of a text."""

    def __init__(self, texts: list[str], precision: float = PRECISION):
        rows: dict[str, list[tuple[list[float], int, int]]] = {k: [] for k in ALL_KINDS}  # features, right, part: 0 calibrates
        for n, text in enumerate(texts):
            base = base_spans(text)
            for c in candidates(text, base):
                rows[c[0]].append((describe(text, *c), int(right(text, *c)), n % 3))
            if n % 3:
                for kind, start, end in base:
                    lead = text[max(0, start - CONTEXT) : start]
                    for y, made in ((1, _looser), (0, _spoilt)):
                        for new in made(kind, text[start:end]):
                            rows[kind].append((describe(lead + new + text[end : end + CONTEXT], kind, len(lead), len(lead) + len(new)), y, 1))
        self.models: dict[str, tuple[Boosted, tuple[np.ndarray, np.ndarray], float]] = {}
        for kind, found in rows.items():
            fit, rest = [r for r in found if r[2]], [r for r in found if not r[2]]
            y = np.array([r[1] for r in fit], float)
            if not rest or not 0 < y.sum() < len(y):  # nothing to tell apart: base spans only
                continue
            model = Boosted(np.array([r[0] for r in fit], float), y)
            p, held = model.probability(np.array([r[0] for r in rest], float)), np.array([r[1] for r in rest], float)
            curve = isotonic(p, held)
            self.models[kind] = model, curve, max(0.5, threshold(np.interp(p, *curve), held, precision))

    def spans(self, text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        text = text or ""
        base = base_spans(text)
        taken = Taken([(s, e) for _, s, e in base])
        by_kind: dict[str, list[tuple[str, int, int]]] = {}
        for c in candidates(text, base):
            if c[0] in self.models and not taken.meets(c[1], c[2]):
                by_kind.setdefault(c[0], []).append(c)
        scored = []
        for kind, found in by_kind.items():
            model, curve, least = self.models[kind]
            p = np.interp(model.probability(np.array([describe(text, *c) for c in found], float)), *curve)
            # what fails its check is none, however likely its format
            scored += [(-score, c[1] - c[2], c) for score, c in zip(p, found) if score >= least and (kind == SECRET or right(text, *c))]
        more = []
        for _, _, c in sorted(scored):  # overlapping candidates: the likeliest, then the longest
            if not taken.meets(c[1], c[2]):
                taken.add(c[1], c[2])
                more.append(c)
        return base, sorted(base + more, key=lambda c: (ALL_KINDS.index(c[0]), c[1]))


def train(docs: DataFrame, limit: int = SAMPLE, precision: float = PRECISION) -> Detector:
    """Fitted on at most ``limit`` distinct texts with two digits in a row or an @, chosen by their hash."""
    texts = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9][0-9]|@"))
    return Detector([r["text"] for r in distinct_sample(texts, "text", limit).collect()], precision)


_SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def detect(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    """(doc_id, base, spans) for every row: arrays of (kind, start, end) in code points, end exclusive.

    Null and empty texts have no spans. Repeated rows each give a row, a null doc_id stays null, other columns are
    not read.
    """
    found = docs.sparkSession.sparkContext.broadcast(detector or train(docs))  # 40 small trees a kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [found.value.spans(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in r[k]] for r in rows], _SPAN_TYPE) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "base", "spans"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, base {_SPANS}, spans {_SPANS}")


def redact(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    """All columns of ``docs``, each span of ``text`` replaced by its kind in brackets; a null text stays null."""
    found = docs.sparkSession.sparkContext.broadcast(detector or train(docs))
    schema, names = docs.schema, docs.columns
    at = names.index("text")

    def clean(text: str | None) -> str | None:
        spans = sorted((s, e, k) for k, s, e in found.value.spans(text)[1])
        out, last = [], 0
        for s, e, k in spans:
            if s >= last:
                out += [text[last:s], f"[{k.upper()}]"]
            last = max(last, e)
        return "".join([*out, text[last:]]) if spans else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            new = pa.array(map(clean, batch.column(at).to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([new if k == at else batch.column(k) for k in range(len(names))], names)

    return docs.mapInArrow(run, schema)


def report(found: DataFrame) -> DataFrame:
    """Counts and digests; ``spans`` has the personal data, ``secrets`` the rest, ``n_spans`` counts both."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def counted(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(counted, KINDS),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.filter("spans", lambda s: s["kind"] != SECRET)).alias("spans"),
        joined(F.filter("spans", lambda s: s["kind"] == SECRET)).alias("secrets"),
        F.size("spans").cast("long").alias("n_spans"),
    )
