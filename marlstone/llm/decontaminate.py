"""Benchmark decontamination by suffix arrays of the training shards.

Every chunk of documents that a task holds is a shard. Its words become numbers of the benchmark's vocabulary; only
suffixes that can start a window (as many benchmark words in a row as the shortest window has) enter the shard's suffix
array, which is sorted on the window's words. Every suffix of every benchmark item is then looked for by binary search;
the matching range of the array gives the locations. Windows that follow each other in the document and in one item
join to the longest verbatim matches, each with its place in both. Matched words are compared byte for byte, so equal
hashes of different words can't make a hit.

The benchmark travels to the tasks in blocks of at most BLOCK_CHARS characters, so what is sent has a fixed bound; with
more than one block every row gets a key of its own first, written with it, and the matches of the blocks are united by that
key: rows are neither merged nor dropped, and a task holds one block at a time.

Defined results: null or empty text has no words and no hits; items without words are no windows; repeated items count
each by item_id; each row, repeated or of a null doc_id, has a result row of its own; extra columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import LOWER, chunks, mix, powers, small_batches, texts, word_hashes, words, written

#: Words of a window.
WINDOW = 13
#: Characters of benchmark text that one pass over the documents takes along.
BLOCK_CHARS = 16 << 20
#: Pairs of a place in a document and one in an item that a task extends at one time.
PAIRS = 1 << 18
#: A document is contaminated where at least one of this many of its words is hit.
SHARE = 20

# Word bytes of the contract, [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z.
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True

#: Key of an input row where the benchmark has several blocks.
KEY = "__row_key"
HITS = "n_words long, hits array<struct<start:int,end:int,item:string,at:int>>"


@dataclass
class Windows:
    """Windows of one length: the sorted distinct ones as rows of word numbers, and all occurrences, item by item."""

    distinct: np.ndarray
    which: np.ndarray  #: of each occurrence, its distinct window
    order: np.ndarray  #: occurrences by window
    cuts: np.ndarray  #: where those of each window begin in order
    item: np.ndarray
    word: np.ndarray  #: place in the item
    before: np.ndarray  #: the window one word earlier in the item, -2 at its start
    end: np.ndarray  #: the occurrence after the item's last one


class TestSuffixes:
    """The windows of a block of items, grouped by their length in words."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        data = [t.encode() for _, t in items]
        offsets = np.append(0, np.cumsum([len(d) for d in data])).astype(np.int64)
        buf = LOWER[np.frombuffer(b"".join(data), np.uint8)]
        starts, ends, row = words(buf, offsets, IS_WORD)
        hashes = word_hashes(buf, starts, ends)
        self.vocab, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
        self.word = [bytes(buf[starts[i] : ends[i]]) for i in first.tolist()]
        self.items, self.window = [i for i, _ in items], window
        counts = np.bincount(row, minlength=len(items)) if len(row) else np.zeros(len(items), np.int64)
        lows = np.cumsum(counts) - counts
        #: length -> its windows
        self.by_length: dict[int, Windows] = {}
        for size in sorted({min(int(c), window) for c in counts.tolist() if c}):
            rows = np.flatnonzero(np.minimum(counts, window) == size)
            n = counts[rows] - size + 1
            at = np.repeat(lows[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            grid = ids.astype(np.int32)[at[:, None] + np.arange(size)]
            item = np.repeat(rows, n)
            distinct, which = np.unique(as_keys(grid), return_inverse=True)
            order = np.argsort(which, kind="stable")
            cuts = np.searchsorted(which[order], np.arange(len(distinct) + 1))
            new = np.append(True, item[1:] != item[:-1])
            before = np.where(new, -2, np.append(-2, which[:-1]))
            end = np.repeat(np.append(np.flatnonzero(new)[1:], len(item)), np.diff(np.append(np.flatnonzero(new), len(item))))
            self.by_length[size] = Windows(distinct, which, order, cuts, item, at - lows[item], before, end)


def as_keys(grid: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings in the same order, for sorting and binary search."""
    big = np.ascontiguousarray(grid.astype(">i4"))
    return big.view(f"V{4 * grid.shape[1]}").ravel() if len(big) else np.zeros(0, f"V{4 * grid.shape[1]}")


def search_shard(data: np.ndarray, offsets: np.ndarray, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """Words of each row, and the longest matches as rows (row, first word, word after the last, item, word of the item)."""
    data = LOWER[data]
    starts, ends, row = words(data, offsets, IS_WORD)
    n_words = np.bincount(row, minlength=len(offsets) - 1) if len(row) else np.zeros(len(offsets) - 1, np.int64)
    found: list[np.ndarray] = []
    if not len(starts) or not test.by_length:
        return n_words, np.zeros((0, 5), np.int64)
    hashes = word_hashes(data, starts, ends)
    number = np.searchsorted(test.vocab, hashes)
    number[number == len(test.vocab)] = 0
    known = test.vocab[number] == hashes
    # words in a row, from each word on, that are all in the benchmark's vocabulary and in the same document
    n = len(starts)
    stop = np.flatnonzero(~known | np.append(row[1:] != row[:-1], True))
    nearest = stop[np.searchsorted(stop, np.arange(n))]
    run = nearest - np.arange(n) + known[nearest]
    lows = np.cumsum(n_words) - n_words
    for size, w in test.by_length.items():
        suffix = np.flatnonzero(run >= size)
        if not len(suffix):
            continue
        keys = as_keys(number[suffix[:, None] + np.arange(size)])
        order = np.argsort(keys, kind="stable")  # the shard's suffix array over these suffixes
        keys, suffix = keys[order], suffix[order]
        lo, hi = np.searchsorted(keys, w.distinct, side="left"), np.searchsorted(keys, w.distinct, side="right")
        hits = []
        for k in np.flatnonzero(hi > lo).tolist():
            want = [test.word[x] for x in np.frombuffer(w.distinct[k].tobytes(), ">i4").tolist()]
            for p in suffix[lo[k] : hi[k]].tolist():
                if all(bytes(data[starts[p + j] : ends[p + j]]) == x for j, x in enumerate(want)):
                    hits.append((p, k))
        if hits:
            p, k = np.array(sorted(hits), np.int64).T
            found.append(longest(row[p], p - lows[row[p]], k, w, size))
    return n_words, np.concatenate(found) if found else np.zeros((0, 5), np.int64)


def longest(row: np.ndarray, start: np.ndarray, k: np.ndarray, w: Windows, size: int) -> np.ndarray:
    """Longest matches (row, start, end, item, word) from the windows k at start of each row, in order of row and start.

    A match begins where the windows before differ, so only such pairs of places are met, PAIRS at a time, not all places
    of a window in the document times all in the items. Of those from one word to one item the longest stays, at
    its first place in the item. How far a match goes is found by binary search on prefix hashes of windows (whose bytes
    have been compared).
    """
    n = len(k)
    joined = np.append(False, (row[1:] == row[:-1]) & (start[1:] == start[:-1] + 1))
    before = np.where(joined, np.append(-1, k[:-1]), -1)
    run = np.flatnonzero(~joined)
    stop = np.repeat(np.append(run[1:], n), np.diff(np.append(run, n)))
    mine, theirs = (np.append(np.uint64(0), np.cumsum(mix(v.astype(np.uint64) + np.uint64(1)) * powers(len(v))[0], dtype=np.uint64)) for v in (k, w.which))
    inverse = powers(max(n, len(w.which)) + 1)[1]

    def reach(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        lo, hi = np.ones(len(i), np.int64), np.minimum(stop[i] - i, w.end[j] - j)
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = (mine[i + mid] - mine[i]) * inverse[i] == (theirs[j + mid] - theirs[j]) * inverse[j]
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def best(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        length = reach(i, j)
        o = np.lexsort((w.word[j], -length, w.item[j], i))
        i, j, length = i[o], j[o], length[o]
        first = np.append(True, (i[1:] != i[:-1]) | (w.item[j[1:]] != w.item[j[:-1]]))
        i, j, length = i[first], j[first], length[first]
        return np.stack([row[i], start[i], start[i] + length - 1 + size, w.item[j], w.word[j]], 1)

    out, held, many = [], [], 0
    by = np.lexsort((before, k))
    groups = np.flatnonzero(np.append(True, (k[by][1:] != k[by][:-1]) | (before[by][1:] != before[by][:-1]))) if n else []
    for lo, hi in zip(groups, np.append(groups[1:], n)):
        i = by[lo:hi]
        places = w.order[w.cuts[k[i[0]]] : w.cuts[k[i[0]] + 1]]
        places = places[w.before[places] != before[i[0]]]
        if not len(places):
            continue
        step = max(1, PAIRS // len(places))
        for at in range(0, len(i), step):
            part = i[at : at + step]
            held.append((np.repeat(part, len(places)), np.tile(places, len(part))))
            many += len(held[-1][0])
            if many >= PAIRS:
                out.append(best(*(np.concatenate(x) for x in zip(*held))))
                held, many = [], 0
    if held:
        out.append(best(*(np.concatenate(x) for x in zip(*held))))
    return np.concatenate(out) if out else np.zeros((0, 5), np.int64)


def covered(found: np.ndarray, n: int) -> np.ndarray:
    """Words of each of n rows that matches (row, start, end, ..) cover."""
    out = np.zeros(n, np.int64)
    at = np.zeros(n, np.int64)
    for row, start, end in found[np.lexsort((found[:, 1], found[:, 0]))][:, :3].tolist():
        out[row] += max(0, end - max(start, at[row]))
        at[row] = max(at[row], end)
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of bounded text, one at a time; rows of a repeated id may lie in several blocks."""
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = 1 + total // block_chars
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r.i, r.t) for r in part.collect()]


def find_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, n_words, hits): for each document the longest verbatim matches with each item, as ranges of its words, and
    the item's word at which the match begins: from each word on that doesn't go on a longer match, the longest with
    each item, at its first place there.

    keep names further columns of docs that travel along.
    """

    def search(test: TestSuffixes, keep: tuple[str, ...]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for rows, data, offsets in chunks(b):
                    n_words, found = search_shard(data, offsets, test)
                    found = found[np.lexsort((found[:, 3], found[:, 2], found[:, 1], found[:, 0]))]
                    parts = [pa.array(found[:, 1], pa.int32()), pa.array(found[:, 2], pa.int32()), pa.array([test.items[i] for i in found[:, 3].tolist()], pa.string()), pa.array(found[:, 4], pa.int32())]
                    cuts = np.searchsorted(found[:, 0], np.arange(len(n_words) + 1))
                    hits = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(parts, ["start", "end", "item", "at"]))
                    part = b.slice(rows.start, rows.stop - rows.start)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), *(part.column(c) for c in keep), pa.array(n_words, pa.int64()), hits],
                        ["doc_id", *keep, "n_words", "hits"],
                    )

        return run

    def searched(source: DataFrame, items: list[tuple[str, str]], keep: tuple[str, ...]) -> DataFrame:
        source = source.select("doc_id", "text", *keep)
        fields = [f for f in source.schema.fields if f.name != "text"]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", " + HITS
        return source.mapInArrow(search(TestSuffixes(items, window), keep), schema)

    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.col(c) for c in keep))
    blocks = _blocks(benchmark, item_col, item_text_col, block_chars)
    first, items = next(blocks), next(blocks, None)
    if items is None:
        return searched(source, first, keep)
    # written, so that a row's key is the same in every block
    source = written(source.withColumn(KEY, F.monotonically_increasing_id()))
    found = searched(source, first, (*keep, KEY))
    more = None
    while items is not None:  # a block's hits are written before the next block is read: the driver holds two at most
        part = written(searched(source, items, (KEY,)).where(F.size("hits") > 0).select(KEY, F.col("hits").alias("more")))
        more = part if more is None else more.unionByName(part)
        items = next(blocks, None)
    more = more.groupBy(KEY).agg(F.flatten(F.collect_list("more")).alias("more"))
    both = F.when(F.col("more").isNull(), F.col("hits")).otherwise(F.array_sort(F.concat("hits", "more")))
    return found.join(more, KEY, "left").select("doc_id", *keep, "n_words", both.alias("hits"))


def is_contaminated(n_hit: Column, n_words: Column, share: int = SHARE) -> Column:
    return (n_hit > 0) & (share * n_hit >= n_words)


def hit_words(hits: Column) -> Column:
    """Words that the matches cover, each once; hits come in order of their start."""
    begin = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        more = F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], acc["at"]))
        return F.struct((acc["n"] + more).alias("n"), F.greatest(acc["at"], x["end"]).alias("at"))

    return F.aggregate(hits, begin, step, lambda acc: acc["n"])


def decontamination_report(matches: DataFrame) -> DataFrame:
    """The contract's columns from find_matches."""
    items = F.array_sort(F.array_distinct(F.transform("hits", lambda x: x["item"])))
    return (
        matches.withColumn("n_hit", hit_words(F.col("hits")))
        .withColumn("items", items)
        .select(
            "doc_id",
            "n_words",
            "n_hit",
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
            is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
            F.coalesce(F.array_max(F.transform("hits", lambda x: x["end"] - x["start"])), F.lit(0)).cast("long").alias("longest_match"),
        )
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the contaminated ones; columns as they were. Whole rows pass the search, no join back; with one block
    they are filtered in place."""
    names = docs.columns
    small_batches(docs.sparkSession)
    blocks = _blocks(benchmark, "item_id", "text", block_chars)
    first = next(blocks)
    if next(blocks, None) is not None:
        inner = docs.select(F.struct(*(F.col(c) for c in names)).alias("row"), "doc_id", "text")
        found = find_matches(inner, benchmark, window, block_chars=block_chars, keep=("row",))
        return found.where(~is_contaminated(hit_words(F.col("hits")), F.col("n_words"), share)).select("row.*")
    test = TestSuffixes(first, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.RecordBatch.from_arrays([pc.fill_null(b.column("text"), "")], ["text"])
            for rows, data, offsets in chunks(text):
                n_words, found = search_shard(data, offsets, test)
                n_hit = covered(found, len(n_words))
                yield b.slice(rows.start, rows.stop - rows.start).filter(pa.array((n_hit == 0) | (share * n_hit < n_words)))

    return docs.mapInArrow(run, docs.schema)


__all__ = ["find_matches", "decontamination_report", "remove_contaminated", "texts"]
