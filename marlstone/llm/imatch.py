"""I-Match fingerprints over randomised lexicons.

Document frequencies of all terms come from the whole corpus. The lexicon keeps the terms within a band of inverse
document frequency: neither in more than MOST of the documents nor in fewer than LEAST of them. Since the frequencies of
all terms add up to (documents x mean distinct terms), at most mean distinct terms / LEAST terms can reach the lower
end: what is sent to the tasks has that bound, whatever the number of documents, and its size is checked.

A fingerprint has one hash for each of SUBSETS randomised lexicon subsets: the distinct terms of the document that the
subset holds, sorted, hashed together. Subsets hold geometric shares of the lexicon, so long and short documents both
have subsets that a local edit leaves alone. Likeness is the share of equal hashes among the subsets of one size that hold a
term of either document. One more hash, of all terms, keeps unlike documents without lexicon terms apart.

Neighbours: `with_edits` deals documents by ranges of doc_id (bounds are ids of the table, so each range's first document
is known and goes to the range before it as well), sorted inside: no single task sees all documents.

Defined results: null text is the empty text; an empty text has the fingerprint of no terms; equal texts have equal
fingerprints, of likeness 1; rows of one doc_id follow each other in order of their compressed bytes; a null doc_id comes
first. After the last document comes the first one; an only document follows itself. Extra columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import LOWER, chunks, mix, partitions, powers, texts, word_hashes, words

#: Shares of the documents between which a term's document frequency lies; with few documents two are asked for.
LEAST, MOST = 0.001, 0.2
#: Terms that the lexicon may have; more are an error that asks for another band, not a silent change of it.
LEXICON = 8_000_000
LEVELS, EACH = 8, 8
SUBSETS = LEVELS * EACH
#: Share of the lexicon in each subset: eight subsets each of 2**-2 to 2**-9.
SHARES = np.array([2.0 ** -(2 + k // EACH) for k in range(SUBSETS)])
SEEDS = mix(np.arange(1, SUBSETS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
LIMITS = (SHARES * 2.0**63).astype(np.uint64) * np.uint64(2)

# Word bytes: ASCII letters and digits, and every byte of a character above ASCII.
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True


def distinct_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) for the distinct terms of each row, by row, then term; a term is its 64-bit hash."""
    data = LOWER[data]
    starts, ends, row = words(data, offsets, IS_WORD)
    h = word_hashes(data, starts, ends)
    o = np.argsort(h, kind="stable")
    o = o[np.argsort(row[o], kind="stable")]
    row, h = row[o], h[o]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def document_frequencies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, n): documents with each term; tasks add up what they have read before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            terms, inverse = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
            return terms, np.bincount(inverse, np.concatenate([n for _, n in held])).astype(np.int64)

        def out(terms: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n)], ["term", "n"])

        for b in batches:
            for _, data, offsets in chunks(b):
                terms, n = np.unique(distinct_terms(data, offsets)[1], return_counts=True)
                held.append((terms, n))
                size += len(terms)
                if size > 2_000_000:
                    held = [summed()]
                    size = len(held[0][0])
                    if size > 1_500_000:
                        yield out(*held[0])
                        held, size = [], 0
        if held:
            yield out(*summed())

    return texts(docs, id_col, text_col).select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, most: float = MOST) -> np.ndarray:
    """Sorted hashes of the terms within the band."""
    n = docs.count()
    lowest = max(2, int(np.ceil(least * n)))
    found = document_frequencies(docs, id_col, text_col).where((F.col("n") >= lowest) & (F.col("n") <= max(2, most * n)))
    terms = found.select("term").limit(LEXICON + 1).toPandas()["term"].to_numpy(np.int64) if n else np.zeros(0, np.int64)
    if len(terms) > LEXICON:
        raise ValueError(f"over {LEXICON} terms are in more than {lowest} of {n} documents: raise `least`, now {least}")
    return np.sort(terms.view(np.uint64))


def fingerprints(data: np.ndarray, offsets: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Rows x (SUBSETS + 1) hashes of 32 bits; 0 where the subset holds no term of the row.

    The last one is of all terms, in the lexicon or not: rows of no lexicon term are equal only if their terms are."""
    row, h = distinct_terms(data, offsets)
    n = len(offsets) - 1
    i = np.searchsorted(terms, h)
    i[i == len(terms)] = 0
    inside = terms[i] == h if len(terms) else np.zeros(len(h), bool)
    out = np.zeros((n, SUBSETS + 1), np.uint64)
    for k in range(SUBSETS + 1):
        # the row's terms that the subset holds stand sorted; their hash is a polynomial in that order
        held = np.flatnonzero(inside & (mix(h ^ SEEDS[k]) < LIMITS[k])) if k < SUBSETS else np.arange(len(h))
        if not len(held):
            continue
        of = row[held]
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        rank = np.arange(len(held)) - np.repeat(first, np.diff(np.append(first, len(held))))
        out[of[first], k] = mix(np.add.reduceat((h[held] | np.uint64(1)) * powers(int(rank.max()) + 1)[0][rank], first)) | np.uint64(1)
    small = (mix(out.ravel()) >> np.uint64(32)).astype(np.uint32).reshape(out.shape)
    return np.where(out == 0, np.uint32(0), np.maximum(small, np.uint32(1)))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal hashes among the subsets, of one share of the lexicon, that hold a term of either row.

    The share is the smallest one of which most subsets hold a term; there a hash covers a term or two, and the share of
    equal hashes follows the overlap of the term sets. Equal fingerprints have likeness 1.
    """
    used = ((a != 0) | (b != 0))[:, :SUBSETS].reshape(-1, LEVELS, EACH)
    equal = used & (a == b)[:, :SUBSETS].reshape(used.shape)
    n_used, n_equal = used.sum(axis=2), equal.sum(axis=2)
    enough = n_used > EACH // 2
    level = np.where(enough.any(axis=1), LEVELS - 1 - enough[:, ::-1].argmax(axis=1), n_used.argmax(axis=1))
    row = np.arange(len(a))
    return np.where((a == b).all(axis=1), 1.0, n_equal[row, level] / np.maximum(n_used[row, level], 1))


def shown(prints: np.ndarray) -> list[str]:
    return [bytes(p).hex() for p in prints.astype(">u4")]


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: np.ndarray | None = None) -> DataFrame:
    """(doc_id, fingerprint) of each whole text."""
    terms = lexicon(docs, id_col, text_col) if terms is None else terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, data, offsets in chunks(b):
                part = b.column("doc_id")[rows.start : rows.stop]
                yield pa.RecordBatch.from_arrays([part, pa.array(shown(fingerprints(data, offsets, terms)))], ["doc_id", "fingerprint"])

    rows = texts(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def as_bytes(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [p.encode() for p in parts]
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)


FIRST = -(1 << 63)


def with_edits(docs: DataFrame, terms: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next document's text, with their likeness.

    The edited text has its last quarter (code points, rounded down) replaced by as many from the start of the next
    document's text. Texts are shuffled once, compressed.
    """
    spark = docs.sparkSession
    terms = lexicon(docs, id_col, text_col) if terms is None else terms
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST)).alias("k"))
    n = partitions(spark)
    cuts = ids.agg(F.percentile_approx("k", [i / (4 * n) for i in range(4 * n)], 100 * 4 * n)).first()[0] or []
    bounds = np.unique(np.array(cuts, np.int64))
    if len(bounds):
        bounds[0] = ids.agg(F.min("k")).first()[0]
    last = max(0, len(bounds) - 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            for rows, data, offsets in chunks(b):
                k = b.column("k")[rows.start : rows.stop].to_numpy(zero_copy_only=False)
                z = [pack(data[x:y].tobytes()) for x, y in zip(offsets.tolist(), offsets[1:].tolist())]
                to = np.searchsorted(bounds, k, side="right") - 1
                at = np.searchsorted(bounds, k)
                halo = np.flatnonzero(bounds[np.minimum(at, last)] == k)
                before = np.where(to[halo] == 0, last, to[halo] - 1)
                place = np.concatenate([np.arange(len(k)), halo])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([to, before]), pa.int32()),
                        pa.array(np.concatenate([np.zeros(len(k), bool), to[halo] == 0])),  # the first document after the last
                        pa.array(k[place], pa.int64()),
                        pa.array(np.append(np.ones(len(k), bool), np.zeros(len(halo), bool))),
                        pa.array([z[i] for i in place.tolist()], pa.binary()),
                    ],
                    ["bucket", "wraps", "k", "own", "z"],
                )

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        held: list[tuple] = []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            """rows: (bucket, k, own, text), the last one only as the next of the one before."""
            own, after = rows[:-1], rows[1:]
            mine = [i for i, (r, s) in enumerate(zip(own, after)) if r[2] and r[0] == s[0]]
            texts_, edited = [r[3] for r in rows], []
            for i in mine:
                t, cut = texts_[i], len(texts_[i]) // 4
                edited.append(t[: len(t) - cut] + texts_[i + 1][:cut])
            plain = fingerprints(*as_bytes(texts_), terms)
            other = fingerprints(*as_bytes(edited), terms)
            a, b = plain[mine], plain[[i + 1 for i in mine]]
            columns = {
                "doc_id": pa.array([None if rows[i][1] == FIRST else rows[i][1] for i in mine], pa.int64()),
                "n_chars": pa.array([len(texts_[i]) for i in mine], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                "fingerprint": pa.array(shown(a), pa.string()),
                "edited_fingerprint": pa.array(shown(other), pa.string()),
                "near_edited": pa.array(likeness(a, other), pa.float64()),
                "near_next": pa.array(likeness(a, b), pa.float64()),
            }
            return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        size = 0
        for b in batches:
            for bucket, k, own, z in zip(*(b.column(c).to_pylist() for c in ("bucket", "k", "own", "z"))):
                held.append((bucket, k, own, unpack(z).decode()))
                size += len(held[-1][3])
                if size > 2 << 20 and len(held) > 1:
                    yield out(held)
                    held, size = held[-1:], len(held[-1][3])
        if len(held) > 1:
            yield out(held)

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST)).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = rows.mapInArrow(deal, "bucket int, wraps boolean, k long, own boolean, z binary")
    return (
        dealt.repartition(n, "bucket")
        .sortWithinPartitions("bucket", "wraps", "k", "z")
        .mapInArrow(
            pairs,
            "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
        )
    )
