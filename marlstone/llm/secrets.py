"""Secret scans: three base rules and sliding-window Shannon entropy per character class.

Candidate strings are runs of key-like characters. Each belongs to one character class (hexadecimal, upper-case and
digits, or mixed base64); a window of fixed width slides over it while the count of each character is updated by one
step in and one step out, and so is the entropy. Stretches whose windows all reach the class's threshold become spans,
unless an allow-list entry covers the candidate. Defined results: null or empty text has no spans; rows are handled one
by one, so ties, repeats and extra columns don't matter; offsets are code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import texts

# The base rules of the contract. Letters of the key names match in either case, ASCII only.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KEY_WORDS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "entropy")

#: Class of candidate -> (window width, bits per character that each window needs).
CLASSES = {"hex": (20, 3.0), "upper": (16, 3.3), "mixed": (20, 3.6)}
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Candidates that match one of these are not secrets: UUIDs, dates and plain numbers, words joined by hyphens or slashes.
ALLOW = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"[0-9_/=+-]+",
    r"[A-Za-z_/=+-]+",
    r".*EXAMPLE.*",
    r"(?:[A-Za-z]+|[0-9]{1,8})(?:[/_-](?:[A-Za-z]+|[0-9]{1,8}))+",
)
SPANS = "array<struct<kind:string,start:int,end:int>>"


def char_class(s: str) -> str | None:
    """The character class of a candidate, None where too few kinds of characters occur."""
    lower, upper, digit = any("a" <= c <= "z" for c in s), any("A" <= c <= "Z" for c in s), any("0" <= c <= "9" for c in s)
    if not digit:
        return None
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
        return "hex" if lower or upper else None
    if not lower and upper:
        return "upper"
    return "mixed" if lower and upper or sum(c.isdigit() for c in s) >= 4 else None


def high_windows(s: str, width: int, least: float) -> list[tuple[int, int]]:
    """Unions of the windows of s with at least `least` bits of Shannon entropy, by incremental counts."""
    if len(s) < width:
        return []
    part = [0.0, *(c * log2(c) for c in range(1, width + 1))]
    counts: dict[str, int] = {}
    total, found = 0.0, []
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        total += part[n + 1] - part[n]
        counts[c] = n + 1
        if i >= width:
            n = counts[s[i - width]]
            total += part[n - 1] - part[n]
            counts[s[i - width]] = n - 1
        if i >= width - 1 and log2(width) - total / width >= least - 1e-9:
            lo = i - width + 1
            if found and lo <= found[-1][1]:
                found[-1][1] = i + 1
            else:
                found.append([lo, i + 1])
    return [(a, b) for a, b in found]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three base rules, by start, then kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEY_WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def spans(text: str, allow: Sequence[str] = ALLOW, classes: dict = CLASSES) -> list[tuple[str, int, int]]:
    """Base spans and the entropy spans that no base span holds."""
    base, out = base_spans(text), []
    for m in CANDIDATE.finditer(text):
        s = m.group()
        kind = char_class(s)
        if kind is None or any(re.fullmatch(p, s, re.DOTALL) for p in allow):
            continue
        width, least = classes[kind]
        size = min(width, len(s))  # a shorter candidate is one window, of the same share of what its length can reach
        for a, b in high_windows(s, size, least * log2(size) / log2(width)):
            a, b = a + m.start(), b + m.start()
            if not any(x <= a and b <= y for _, x, y in base):
                out.append(("entropy", a, b))
    return sorted(base + out, key=lambda x: (x[1], KINDS.index(x[0]))) if out else base


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: Sequence[str] = ALLOW, classes: dict | None = None) -> DataFrame:
    """(doc_id, spans): the secrets of each whole text; a narrow map over Arrow batches, no shuffle."""
    classes = classes or CLASSES

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            found = [[{"kind": k, "start": x, "end": y} for k, x, y in spans(t.as_py(), allow, classes)] for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    rows = texts(docs, id_col, text_col)
    return rows.mapInArrow(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span replaced by mark; n_chars, where present, follows the new text. Null stays null."""
    at = docs.columns.index(text_col)
    n_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def clean(text: str) -> str:
        parts, done = [], 0
        for _, a, b in spans(text):
            if b > done:
                parts += [text[done:a], mark] if a >= done else []
                done = max(done, b)
        return "".join([*parts, text[done:]]) if parts else text

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [None if (t := x.as_py()) is None else clean(t) for x in b.column(at)]
            columns = list(b.columns)
            columns[at] = pa.array(new, b.schema.field(at).type)
            if n_at is not None:
                columns[n_at] = pa.array([None if t is None else len(t) for t in new], b.schema.field(n_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(scan, docs.schema)


def secret_digest(found: DataFrame) -> DataFrame:
    """The contract's columns from scan_secrets' spans."""
    shown = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] != "entropy")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, shown), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", shown), ",").alias("spans"),
        count("entropy").alias("n_entropy"),
    )
