"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte goes where a string of LENGTH bytes that covers it also starts earlier (smaller doc_id, or earlier in the same
document). Suffixes that start such strings must be compared over the whole corpus, so they are first dealt out by
content:

1. Every window of LENGTH bytes has an anchor, its K-gram of least hash; equal windows have equal anchors at equal
   offsets. Consecutive windows with one anchor are a run, about 33 windows. A run's row is its anchor's hash and the
   hash of the bytes its windows cover. Rows with equal hashes are one class: all but the first member are repeats.
   Each task takes out what repeats within what it has read, so a passage that a third of all documents hold comes to
   the shuffle once a task.
2. An anchor with one class needs nothing more. Where an anchor has several classes, their first members may still share
   some windows: these suffixes go to the suffix sort. It works on the bytes around the anchors: prefix polynomial
   hashes give the common extension of two suffixes by binary search, a mergesort compares by it, and neighbours that
   agree over LENGTH bytes are compared byte for byte before they count as equal.
3. Anchors with more than HOT classes are not collected: each of their windows is a row of its own, keyed by two hashes
   of its bytes, and follows the way of step 1.

The texts are shuffled by doc_id, compressed, to fetch the bytes of step 2 and to apply the removed intervals. Defined
results: null or short text loses nothing; rows that repeat both doc_id and text are one document (each has the same result,
none counts as earlier than the other); unlike texts of one doc_id are documents of their own, in order of their sha256; null
doc_id is the least id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import chunks, mix, partitions, powers, prefix_hash, written
from marlstone.operators.ordered import running

#: Bytes of a repeated string, of an anchor, and classes of an anchor that one task sorts together.
LENGTH, K, HOT = 100, 36, 20_000
#: Rows that a task holds before it hands out the first of each class.
HELD_ROWS = 500_000
#: Bytes of text of which a task computes anchors at one time: about twenty columns of eight bytes each a byte.
ANCHOR_BYTES = 1 << 20
FIRST = -(1 << 63)
ROWS = "key long, cover long, doc long, pos long"
FOUND = "kind byte, key long, doc long, pos long, stop long"


def hash_of(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Polynomial hash of bytes a to b from prefix hashes, the same wherever the bytes stand."""
    return (h[b] - h[a]) * powers(len(h))[1][a]


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (row, first start, anchor's offset from it, windows, anchor's hash, covered bytes' hash)."""
    n = len(data)
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    if n < LENGTH:
        return none
    h = prefix_hash(data)
    at = np.arange(n - K + 1)
    grams = mix(hash_of(h, at, at + K))
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    width = 1
    while 2 * width <= LENGTH - K + 1:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = LENGTH - K + 1 - width
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)  # one for each window start
    start = np.arange(len(anchor))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    ok = start + LENGTH <= offsets[row + 1]
    start, anchor, row = start[ok], anchor[ok], row[ok]
    if not len(start):
        return none
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    s, p, r = start[first], anchor[first], row[first]
    cover = mix(hash_of(h, s, s + count - 1 + LENGTH) ^ ((p - s).astype(np.uint64) << np.uint64(8)) ^ count.astype(np.uint64))
    return r, s - offsets[r], p - s, count, grams[p], cover


def merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals by document, touching ones joined."""
    if not len(doc):
        return doc, lo, hi
    o = np.lexsort((lo, doc))
    doc, lo, hi = doc[o], lo[o], hi[o]
    group = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    # the furthest end so far within the document: ends are shifted by document so that one running maximum serves all
    rank = np.cumsum(np.append(0, doc[1:] != doc[:-1])).astype(np.int64)
    span = int(hi.max()) + 1
    reach = np.maximum.accumulate(hi + rank * span) - rank * span
    new = np.append(True, lo[1:] > reach[:-1])
    new[group] = True
    first = np.flatnonzero(new)
    return doc[first], lo[first], reach[np.append(first[1:], len(doc)) - 1]


def pack(start: np.ndarray, off: np.ndarray, count: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << 16) | (off.astype(np.int64) << 8) | count.astype(np.int64)


def unpack(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return pos >> 16, (pos >> 8) & 255, pos & 255


def taken(doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals that runs of repeated windows cover."""
    start, _, count = unpack(pos)
    return merged(doc, start, start + count - 1 + LENGTH)


def first_of_class(key: np.ndarray, cover: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in order: which are the first of their class, and which are repeats (a row twice is one row)."""
    same = np.append(False, (key[1:] == key[:-1]) & (cover[1:] == cover[:-1]))
    twice = same & np.append(False, (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1]))
    return ~same, same & ~twice


def batch(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    kinds = [x.split() for x in names.split(", ")]
    types = {"long": pa.int64(), "byte": pa.int8()}
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, (_, k) in zip(columns, kinds)], [n for n, _ in kinds])


def out_rows(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """First members as rows for the shuffle; repeats within the task as intervals (cover holds the end, pos the start)."""
    key, cover, doc, pos = (np.concatenate(x) for x in zip(*held))
    if not len(key):
        return
    o = np.lexsort((pos, doc, cover, key))
    key, cover, doc, pos = key[o], cover[o], doc[o], pos[o]
    first, again = first_of_class(key, cover, doc, pos)
    yield batch(ROWS, key[first], cover[first], doc[first], pos[first])
    d, lo, hi = taken(doc[again], pos[again])
    if len(d):
        yield batch(ROWS, mix(d.astype(np.uint64)).view(np.int64), hi, d, ~lo)  # a negative pos marks an interval


def held_out(rows: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[0])
        if size > HELD_ROWS:
            yield from out_rows(held)
            held, size = [], 0
    if held:
        yield from out_rows(held)


def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1 before the shuffle."""

    def each():
        for b in batches:
            for rows, data, offsets in chunks(b, ANCHOR_BYTES):
                ids = b.column("doc")[rows.start : rows.stop].to_numpy(zero_copy_only=False)
                r, start, off, count, key, cover = runs(data, offsets)
                yield key.view(np.int64), cover.view(np.int64), ids[r], pack(start, off, count)

    return held_out(each())


def settle(most: int = HOT):
    """Step 1 after the shuffle, over rows in order of key, cover, doc, pos; holds at most `most` rows of a key.

    kind 0: an interval of repeats (pos to stop). kind 1: a first member whose anchor has other classes. kind 2: the
    same of an anchor with more than `most` classes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the last row seen
        open_key, rows, hot = None, [], False  # first members of the key that may go on

        def edges(key, doc, pos, kind):
            return batch(FOUND, np.full(len(key), kind, np.int8), key, doc, pos, np.zeros(len(key), np.int64))

        for b in batches:
            key, cover, doc, pos = (b.column(c).to_numpy() for c in ("key", "cover", "doc", "pos"))
            if not len(key):
                continue
            is_interval = pos < 0
            if is_interval.any():
                yield batch(FOUND, np.zeros(is_interval.sum(), np.int8), key[is_interval], doc[is_interval], ~pos[is_interval], cover[is_interval])
                key, cover, doc, pos = (x[~is_interval] for x in (key, cover, doc, pos))
                if not len(key):
                    continue
            if last is not None:
                key, cover, doc, pos = (np.append(np.int64(x), y) for x, y in zip(last, (key, cover, doc, pos)))
            first, again = first_of_class(key, cover, doc, pos)
            if last is not None:
                first[0] = False
            last = (key[-1], cover[-1], doc[-1], pos[-1])
            d, lo, hi = taken(doc[again], pos[again])
            if len(d):
                yield batch(FOUND, np.zeros(len(d), np.int8), d, d, lo, hi)
            key, doc, pos = key[first], doc[first], pos[first]
            if not len(key):
                continue
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            if open_key is not None and key[0] != open_key:
                yield from close(rows, hot, edges)
                open_key, rows, hot = None, [], False
            # keys that begin and end here
            lo = cuts[1] if open_key is not None else 0
            hi = cuts[-2]
            if hi > lo:
                k = key[lo:hi]
                many = np.append(False, k[1:] == k[:-1]) | np.append(k[1:] == k[:-1], False)
                if many.any():
                    sizes = np.diff(np.append(np.flatnonzero(np.append(True, k[1:] != k[:-1])), len(k)))
                    big = np.repeat(sizes, sizes) > most
                    for kind, use in ((1, many & ~big), (2, many & big)):
                        if use.any():
                            yield edges(k[use], doc[lo:hi][use], pos[lo:hi][use], kind)
            if open_key is not None:
                rows.append((key[: cuts[1]], doc[: cuts[1]], pos[: cuts[1]]))
                if len(cuts) > 2:
                    yield from close(rows, hot, edges)
                    open_key, rows, hot = None, [], False
            if open_key is None:
                rows.append((key[cuts[-2] :], doc[cuts[-2] :], pos[cuts[-2] :]))
                open_key = key[-1]
            if hot or sum(len(r[0]) for r in rows) > most:
                hot = True
                yield from close(rows, True, edges)
                rows = []
        yield from close(rows, hot, edges)

    return run


def close(rows: list, hot: bool, edges) -> Iterator[pa.RecordBatch]:
    if rows and (hot or sum(len(r[0]) for r in rows) > 1):
        yield edges(*(np.concatenate(x) for x in zip(*rows)), 2 if hot else 1)


def compare(h: np.ndarray, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common extension of the suffixes at a and b up to LENGTH bytes, and whether b's comes before a's.

    Binary search on the length, seven steps; equal prefix hashes count as equal bytes.
    """
    inverse = powers(len(h))[1]
    lo, hi = np.zeros(len(a), np.int64), np.full(len(a), LENGTH, np.int64)
    while (lo < hi).any():
        mid = (lo + hi + 1) // 2
        equal = (h[a + mid] - h[a]) * inverse[a] == (h[b + mid] - h[b]) * inverse[b]
        lo, hi = np.where(equal, mid, lo), np.where(equal, hi, mid - 1)
    end = len(data) - 1
    less = (lo < LENGTH) & (data[np.minimum(b + lo, end)] < data[np.minimum(a + lo, end)])
    return lo, less


def suffix_sort(data: np.ndarray, start: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by group, then by their first LENGTH bytes, and the common extension with the one before.

    A mergesort from runs of one upward; on each level every suffix finds its place among the partner run's by binary
    search, all suffixes at once.
    """
    order = np.argsort(group, kind="stable")
    start, group = start[order], group[order]
    h = prefix_hash(data)
    n = len(start)
    low = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(low, n))
    base, most = np.repeat(low, size), np.repeat(size, size)
    at, width = np.arange(n), 1
    while width < (size.max() if n else 0):
        live = np.flatnonzero(most > width)
        rank = live - base[live]
        run = rank // width
        partner = (run ^ 1) * width
        lo = np.minimum(partner, most[live])
        end = np.minimum(partner + width, most[live])
        begin, hi = lo.copy(), end.copy()
        mine = start[live]
        right = (run & 1) == 1
        while True:
            todo = np.flatnonzero(lo < hi)
            if not len(todo):
                break
            mid = (lo[todo] + hi[todo]) // 2
            common, less = compare(h, data, mine[todo], start[base[live[todo]] + mid])
            # equal suffixes keep their order: those of the left run come first
            before = less | ((common == LENGTH) & right[todo])
            lo[todo] = np.where(before, mid + 1, lo[todo])
            hi[todo] = np.where(before, hi[todo], mid)
        place = base[live] + (run & ~1) * width + (rank - run * width) + (lo - begin)
        moved_start, moved_at = start[live].copy(), at[live].copy()
        start[place], at[place] = moved_start, moved_at
        width *= 2
    common = np.zeros(n, np.int64)
    if n > 1:
        inner = np.flatnonzero(group[1:] == group[:-1]) + 1
        common[inner] = compare(h, data, start[inner - 1], start[inner])[0]
    return order[at], common


def repeats(context: list[bytes], key: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of windows that start earlier too, among the first members of some anchors."""
    first, off, count = unpack(pos)
    data = np.frombuffer(b"".join(context), np.uint8)
    begin = np.cumsum([0, *map(len, context[:-1])])
    member = np.repeat(np.arange(len(key)), count)
    step = np.arange(len(member)) - np.repeat(np.cumsum(count) - count, count)
    start = begin[member] + step
    number = np.cumsum(np.append(0, key[1:] != key[:-1]))
    group = number[member] * 256 + (off[member] - step)  # equal windows have the anchor at one offset
    order, common = suffix_sort(data, start, group)
    equal = np.flatnonzero(common >= LENGTH)
    a, b = start[order[equal - 1]], start[order[equal]]
    real = np.ones(len(equal), bool)
    for k in range(LENGTH):  # collision verification, byte by byte
        real &= data[a + k] == data[b + k]
    new = np.ones(len(order), bool)
    new[equal[real]] = False
    d, s = doc[member[order]], (first[member] + step)[order]
    by = np.lexsort((s, d))
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(np.append(0, (d[by][1:] != d[by][:-1]) | (s[by][1:] != s[by][:-1])))
    heads = np.flatnonzero(new)
    least = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.append(heads, len(rank)))) if len(heads) else rank
    late = rank > least
    return merged(d[late], s[late], s[late] + LENGTH)


def sort_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2 over rows in order of key; whole keys together, at most HOT members each."""
    held: list[tuple] = []

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        key, doc, pos = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        d, lo, hi = repeats([r[3] for r in rows], key, doc, pos)
        if len(d):
            yield batch("doc long, start long, stop long", d, lo, hi)

    for b in batches:
        held += zip(*(b.column(c).to_pylist() for c in ("key", "doc", "pos", "bytes")))
        if len(held) > 10_000:
            cut = len(held)
            while cut > 0 and held[cut - 1][0] == held[-1][0]:
                cut -= 1
            if cut:
                yield from solve(held[:cut])
                held = held[cut:]
    if held:
        yield from solve(held)


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, doc_id, text): doc is one number for each different (doc_id, text), in order of doc_id.

    Where no id has several texts, it is the id itself (the least long for null), and no text moves. Else ids are spread
    out, each by as many numbers as the most texts of one id, and texts of such ids are numbered by their digest.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    shared = counts.where("n > 1").select("doc_id")
    if shared.isEmpty():
        return rows.select(F.coalesce("doc_id", F.lit(FIRST)).alias("doc"), "doc_id", "text")
    # null is one below the least id; ids are ranked first, so that spreading them can't overflow
    least = counts.agg(F.min("doc_id")).first()[0]
    base = (0 if least is None else least) - 1
    ids = counts.select("doc_id", F.coalesce("doc_id", F.lit(base)).alias("_id"))
    ranks = running(ids.withColumn("_one", F.lit(1).cast("long")), "_id", ["_one"]).select("_id", F.col("before__one").alias("_rank"))
    digest = F.sha2("text", 256)
    several = rows.join(shared.withColumnRenamed("doc_id", "_s"), F.col("doc_id").eqNullSafe(F.col("_s")), "left_semi")
    texts = several.select(F.coalesce("doc_id", F.lit(base)).alias("_id"), digest.alias("_digest")).distinct()
    texts = texts.withColumn("_key", F.conv(F.substring("_digest", 1, 15), 16, 10).cast("long"))  # 60 bits order them, the rest breaks ties
    at = running(texts.groupBy("_id", "_key").agg(F.count("*").alias("n")), "_key", ["n"], ("_id",)).select("_id", "_key", "before_n", "all_n")
    inside = F.row_number().over(Window.partitionBy("_id", "_key").orderBy("_digest")) - 1
    places = written(texts.join(at, ["_id", "_key"]).select("_id", "_digest", (F.col("before_n") + inside).alias("_sub"), "all_n"))
    most = places.agg(F.max("all_n")).first()[0]
    told = rows.withColumns({"_id": F.coalesce("doc_id", F.lit(base)), "_digest": digest}).join(ranks, "_id").join(places, ["_id", "_digest"], "left")
    return written(told.select((F.col("_rank") * most + F.coalesce("_sub", F.lit(0))).alias("doc"), "doc_id", "text"))


def packed(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, z): the texts compressed, for the shuffles by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            for rows, data, offsets in chunks(b):
                z = [small(data[x:y].tobytes()) for x, y in zip(offsets.tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*(b.column(c)[rows.start : rows.stop] for c in ("doc", "doc_id")), pa.array(z, pa.binary())], ["doc", "doc_id", "z"])

    return docs.mapInArrow(run, "doc long, doc_id long, z binary")


def with_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes around each anchor of a document's edges."""
    big = zstandard.ZstdDecompressor().decompress
    for b in batches:
        key, doc, pos, data = [], [], [], []
        for d, z, edges in zip(b.column("doc").to_pylist(), b.column("z").to_pylist(), b.column("edges").to_pylist()):
            text = big(z)
            for e in edges:
                start, count = e["pos"] >> 16, e["pos"] & 255
                part = text[start : start + count - 1 + LENGTH]
                key.append(e["key"])
                doc.append(d)
                pos.append(e["pos"])
                data.append(part)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key, pa.int64()), pa.array(doc, pa.int64()), pa.array(pos, pa.int64()), pa.array(data, pa.binary())], ["key", "doc", "pos", "bytes"]
        )


def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3 before the shuffle: a row for each window, keyed by two hashes of its bytes."""

    def each():
        for b in batches:
            data = np.frombuffer(b"".join(b.column("bytes").to_pylist()), np.uint8)
            pos, doc = b.column("pos").to_numpy(), b.column("doc").to_numpy()
            if not len(pos):
                continue
            first, _, count = unpack(pos)
            length = count - 1 + LENGTH
            begin = np.cumsum(length) - length
            member = np.repeat(np.arange(len(pos)), count)
            step = np.arange(len(member)) - np.repeat(np.cumsum(count) - count, count)
            h = prefix_hash(data)
            a = begin[member] + step
            half = LENGTH // 2
            one, two = hash_of(h, a, a + half), hash_of(h, a + half, a + LENGTH)
            key, cover = mix(one ^ mix(two.copy())), mix(two + np.uint64(0x9E3779B97F4A7C15) * mix(one.copy()))
            yield key.view(np.int64), cover.view(np.int64), doc[member], pack(first[member] + step, np.zeros(len(a), np.int64), np.ones(len(a), np.int64))

    return held_out(each())


def repeated_intervals(rows: DataFrame, hot_classes: int = HOT) -> DataFrame:
    """(doc, start, stop): byte intervals that repeated strings cover, possibly overlapping; rows are those of numbered()."""
    n = partitions(rows.sparkSession)
    order = ("key", "cover", "doc", "pos")
    found = written(rows.mapInArrow(anchor_rows, ROWS).repartition(n, "key").sortWithinPartitions(*order).mapInArrow(settle(hot_classes), FOUND))

    def contexts(kind: int) -> DataFrame:
        edges = found.where(F.col("kind") == kind).groupBy("doc").agg(F.collect_list(F.struct("key", "pos")).alias("edges"))
        return packed(rows).repartition(n, "doc").join(edges.repartition(n, "doc").hint("shuffle_hash"), "doc").mapInArrow(with_bytes, "key long, doc long, pos long, bytes binary")

    every = found.where("kind = 0").select("doc", F.col("pos").alias("start"), "stop")
    sorted_ = contexts(1).repartition(n, "key").sortWithinPartitions("key", "doc", "pos").mapInArrow(sort_contexts, "doc long, start long, stop long")
    every = every.unionByName(sorted_)
    if found.where("kind = 2").limit(1).count():
        windows = contexts(2).mapInArrow(window_rows, ROWS).repartition(n, "key").sortWithinPartitions(*order).mapInArrow(settle(hot_classes), FOUND)
        every = every.unionByName(windows.where("kind = 0").select("doc", F.col("pos").alias("start"), "stop"))
    return every


def apply_intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    big = zstandard.ZstdDecompressor().decompress
    for b in batches:
        out = []
        for doc_id, z, cuts in zip(b.column("doc_id").to_pylist(), b.column("z").to_pylist(), b.column("cuts").to_pylist()):
            text = big(z)
            lo = np.array([c["start"] for c in cuts or ()], np.int64)
            hi = np.minimum(np.array([c["stop"] for c in cuts or ()], np.int64), len(text))
            ok = lo < hi
            _, lo, hi = merged(np.zeros(ok.sum(), np.int64), lo[ok], hi[ok])
            kept, done = [], 0
            for a, z_ in zip(lo.tolist(), hi.tolist()):
                kept.append(text[done:a])
                done = z_
            kept.append(text[done:])
            out.append((doc_id, len(text), int((hi - lo).sum()), len(lo), b"".join(kept)))
        ids, size, gone, spans, kept = zip(*out) if out else ((),) * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def removal_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_classes: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each document."""
    n = partitions(docs.sparkSession)
    rows = numbered(docs, id_col, text_col)
    cuts = repeated_intervals(rows, hot_classes).groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("cuts"))
    return (
        packed(rows)
        .repartition(n, "doc")
        .join(cuts.repartition(n, "doc").hint("shuffle_hash"), "doc", "left")
        .mapInArrow(apply_intervals, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    )
