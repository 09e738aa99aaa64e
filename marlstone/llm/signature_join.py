"""N-gram Jaccard self-join by signature trees, and its connected components.

A document's set is its distinct SHINGLE-word shingles. Two sets link at Jaccard similarity PER_CENT / 100 or more.

1. Equal sets are one class from the start: copies are never joined to each other.
2. In one order of all shingles the (1 - similarity) share of a set that comes first, plus one, is its prefix; linked
   sets have a prefix shingle in common. Shingles of rare words come first, so that unlike texts hardly share one by
   chance, however many texts there are. Shingles that many documents have come last (they are a short list: their
   document frequencies add up to at most the mean set size over HEAVY), so common passages hardly enter prefixes.
3. Classes that share a prefix shingle meet under its head, the least class that has it. There their parity sketches are
   compared: every differing shingle flips one bit, so sketches that differ in more bits than linked sets differ in
   shingles prove that the sets aren't linked. What stays connects classes to families; every link is within a family.
   A head of more than NEAR classes is dealt into cells by size, and by pairs of parts: any two that may link meet.
4. A family's members travel once, with all their shingles as 64-bit hashes, to the cell of the family. There they are
   leaves of a signature tree: nodes hold the OR of the token bitmaps below and the range of set sizes. The dual traversal
   drops node pairs whose largest possible overlap is too small for the smallest sizes; the leaves that are left are compared
   on their full sets by matrix products. Only sets that are linked by that exact count are united; node pairs whose members
   are united already are passed over, for a link between them would add nothing.
5. A family of more than CELL_TOKENS shingles is dealt into parts, each with about ANCHORS common members. What the
   parts unite is contracted; then the members outside the family's largest component, and only these, visit all parts.

Defined results: null text and text without words have an empty set, n_shingles 0, no links and their own id as component;
shorter texts have their whole word sequence as the one shingle; a null doc_id is less than every other and is given back
as null; ids may be of any type that has an order. Each row, repeated or not, has a result row, by its own text; rows of one
doc_id with different texts count as one document for the least id only. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import LOWER, Scratch, chunks, mix, partitions, small_batches, word_hashes, words
from marlstone.llm.components import connected_components

SHINGLE, PER_CENT = 4, 85
#: Share of the documents from which a shingle is heavy, and the same within what a task has read at a time (HELD hashes).
HEAVY, HEAVY_LOCAL, HELD = 0.002, 0.001, 1_000_000
#: Bits of its share of all words from which a word is rare.
RARE_BITS = 14
#: Classes whose sketches are compared in one cell; a larger head's are dealt into several.
NEAR = 8_192
#: Shingles of a cell, common members of a large family's parts.
CELL_TOKENS, ANCHORS = 4_000_000, 64
#: Members and shingles of a leaf, children of a node.
LEAF, LEAF_TOKENS, FANOUT = 32, 65_536, 8

# Word bytes: everything but ASCII white space, [^\x20\x09-\x0D].
IS_WORD = np.ones(256, bool)
IS_WORD[[32, 9, 10, 11, 12, 13]] = False


def word_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each word."""
    data = LOWER[data]
    starts, ends, row = words(data, offsets, IS_WORD)
    return row, word_hashes(data, starts, ends)


def distinct_shingles(row: np.ndarray, h: np.ndarray, m: int, size: int, bits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, bits) for the distinct shingles of each of m rows, by row, then hash; bits: sums over their words."""
    n = len(h)
    bits = np.zeros(n, np.int64) if bits is None else bits
    if not n:
        return row, h, bits
    count = np.bincount(row, minlength=m)
    left = np.cumsum(count)[row] - np.arange(n)  # words from here to the end of the row
    take = (left >= size) | ((count[row] < size) & (left == count[row]))
    at = np.flatnonzero(take)
    width = np.minimum(count[row[at]], size)
    s = mix(width.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    total = np.zeros(len(at), np.int64)
    for k in range(size):
        inside = k < width
        s[inside] = mix(s[inside] * np.uint64(0x9FB21C651E98DF25) + h[at[inside] + k])
        total[inside] += bits[at[inside] + k]
    row = row[at]
    o = np.argsort(s, kind="stable")
    o = o[np.argsort(row[o], kind="stable")]
    row, s, total = row[o], s[o], total[o]
    new = np.append(True, (row[1:] != row[:-1]) | (s[1:] != s[:-1]))
    return row[new], s[new], total[new]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) for the distinct shingles of each row, by row, then hash."""
    return distinct_shingles(*word_rows(data, offsets), len(offsets) - 1, size)[:2]


def set_hashes(row: np.ndarray, s: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two hashes of each of m rows' sets."""
    n = np.bincount(row, minlength=m) if len(row) else np.zeros(m, np.int64)
    full = np.flatnonzero(n)
    one, two = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
    if len(full):
        low = (np.cumsum(n) - n)[full]
        one[full] = np.add.reduceat(mix(s.copy()), low)
        two[full] = np.add.reduceat(mix(s ^ np.uint64(0xA24BAED4963EE407)), low)
    return n, one, two


def prefix_size(n: np.ndarray, per_cent: int) -> np.ndarray:
    """Shingles of which linked sets have one in common: n - ceil(per_cent * n / 100) + 1."""
    return n - (per_cent * n + 99) // 100 + 1


def least_overlap(n: np.ndarray, m: np.ndarray, per_cent: int) -> np.ndarray:
    """Shingles that linked sets of n and m have in common at least."""
    return -(-per_cent * (n + m) // (100 + per_cent))


def frequent(rows: DataFrame, size: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the shingles that more than HEAVY of the documents have, by count, then hash; sorted hashes of the words that
    aren't rare (at most 2**RARE_BITS), and the bits of their share of all words.

    What tasks leave out because few of their texts have it only changes the order of shingles, never a result."""
    n = rows.count()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, total = [], 0, 0

        def out():
            s, c = np.unique(np.concatenate([x for x, _ in held]), return_counts=True)
            w, d = np.unique(np.concatenate([x for _, x in held]), return_counts=True)
            heavy, common = c >= max(4, HEAVY_LOCAL * docs), d >= total / 2 ** (RARE_BITS + 1)
            kinds = np.repeat([0, 1, 2], [heavy.sum(), common.sum(), 1]).astype(np.int32)
            hashes = np.concatenate([s[heavy], w[common], np.zeros(1, np.uint64)]).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(hashes), pa.array(np.concatenate([c[heavy], d[common], [total]]).astype(np.int64))], ["kind", "h", "c"])

        for b in batches:
            for _, data, offsets in chunks(b):
                row, h = word_rows(data, offsets)
                held.append((distinct_shingles(row, h, len(offsets) - 1, size)[1], h))
                docs += len(offsets) - 1
                total += len(h)
                if total > HELD:
                    yield out()
                    held, docs, total = [], 0, 0
        if held:
            yield out()

    found = scratch.table(rows.select("text").mapInArrow(count, "kind int, h long, c long").groupBy("kind", "h").agg(F.sum("c").alias("c")))
    heavy = found.where((F.col("kind") == 0) & (F.col("c") >= max(8, HEAVY * n))).toPandas().sort_values(["c", "h"])
    total = found.where("kind = 2").agg(F.sum("c")).first()[0] or 1
    common = found.where((F.col("kind") == 1) & (F.col("c") > total / 2**RARE_BITS)).toPandas()
    scratch.drop(found)
    names, bits = common["h"].to_numpy(np.int64).view(np.uint64), np.floor(np.log2(total / common["c"].to_numpy(np.float64))).astype(np.int64)
    o = np.argsort(names)
    return heavy["h"].to_numpy(np.int64).view(np.uint64), names[o], bits[o]


# ---- sets, prefixes and sketches ---------------------------------------------------------------------------------


def sketch_bits(n: np.ndarray) -> np.ndarray:
    """Bits of the sketch of a set of n: a power of two from n to twice n, 64 at least."""
    return np.maximum(64, 1 << np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64))


def parity_sketches(row: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, byte offsets): for each row, the parity of the number of its shingles at each bit."""
    bits = sketch_bits(n)
    bits[n == 0] = 0
    ends = np.append(0, np.cumsum(bits))
    at = ends[row] + ((s >> np.uint64(20)).astype(np.int64) & (bits[row] - 1))
    odd = (np.bincount(at, minlength=ends[-1]) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little"), ends // 8


def document_rows(rows: DataFrame, heavy: np.ndarray, names: np.ndarray, bits: np.ndarray, size: int, per_cent: int) -> DataFrame:
    """(id, key, n, one, two, light, late, sketch) from (id, key, text): set size, two hashes of the set, its prefix
    without and with the heavy shingles only, and its parity sketch. names, bits: words that aren't rare."""
    by_hash = np.argsort(heavy)
    sorted_heavy = heavy[by_hash]

    def lists(s: np.ndarray, count: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(s.view(np.int64)))

    def rarity(h: np.ndarray) -> np.ndarray:
        if not len(names):
            return np.full(len(h), RARE_BITS, np.int64)
        i = np.searchsorted(names, h)
        i[i == len(names)] = 0
        return np.where(names[i] == h, bits[i], RARE_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows_, data, offsets in chunks(b):
                m = len(offsets) - 1
                row, h = word_rows(data, offsets)
                row, s, rare = distinct_shingles(row, h, m, size, rarity(h))
                n, one, two = set_hashes(row, s, m)
                i = np.searchsorted(sorted_heavy, s)
                i[i == len(heavy)] = 0
                last = np.where(sorted_heavy[i] == s, by_hash[i] + 1, 0) if len(heavy) else np.zeros(len(s), np.int64)
                bytes_, cuts = parity_sketches(row, s, n)
                o = np.lexsort((np.where(last > 0, last, -rare), row))  # stable, and s is in order
                p = np.where(n > 0, prefix_size(n, per_cent), 0)
                take = np.arange(len(s)) - (np.cumsum(n) - n)[row] < p[row]
                ordered, late, of = s[o][take], last[o][take] > 0, row[take]
                part = b.slice(rows_.start, rows_.stop - rows_.start)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        part.column("key"),
                        pa.array(n, pa.int64()),
                        pa.array(one.view(np.int64)),
                        pa.array(two.view(np.int64)),
                        lists(ordered[~late], np.bincount(of[~late], minlength=m)),
                        lists(ordered[late], np.bincount(of[late], minlength=m)),
                        pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(bytes_)]),
                    ],
                    ["id", "key", "n", "one", "two", "light", "late", "sketch"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, key long, n long, one long, two long, light array<long>, late array<long>, sketch binary")


def folded(sketch: np.ndarray, words_: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) as shorter ones: parities of halves add up."""
    while sketch.shape[1] > words_:
        half = sketch.shape[1] // 2
        sketch = sketch[:, :half] ^ sketch[:, half:]
    return sketch


def near_roots(n: np.ndarray, sketches: list[bytes], per_cent: int) -> np.ndarray:
    """For each set the number of the first one of its family: the sets that sketches can't tell from linked ones, joined."""
    m = len(n)
    root = np.arange(m)
    width = np.array([len(x) // 8 for x in sketches])
    table = {int(w): np.frombuffer(b"".join(sketches[i] for i in np.flatnonzero(width == w)), np.uint64).reshape(-1, w) for w in np.unique(width)}
    for w, short in table.items():
        a = np.flatnonzero(width == w)
        for v, long in table.items():
            c = np.flatnonzero(width == v)
            # widths differ by as much as sizes of linked sets, rounded to powers of two
            if v < w or 100 * n[a].max() < per_cent * n[c].min():
                continue
            other = folded(long, w)
            for i, x in zip(a.tolist(), short):
                todo = np.flatnonzero((root[c] != root[i]) & (100 * n[c] >= per_cent * n[i]) & (per_cent * n[c] <= 100 * n[i]))
                if not len(todo):
                    continue
                apart = np.bitwise_count(other[todo] ^ x).sum(axis=1)
                hit = apart <= n[i] + n[c[todo]] - 2 * least_overlap(n[i], n[c[todo]], per_cent)
                if hit.any():
                    joined = np.unique(np.append(root[c[todo[hit]]], root[i]))
                    root[np.isin(root, joined)] = joined[0]
    return root


def crowd_cells(members: DataFrame, per_cent: int, near: int) -> DataFrame:
    """(head, uid), head being a cell of about near classes at most, from (head, uid, n) of larger heads: any two classes of a
    head with sizes that linked sets can have share a cell.

    A band holds the sizes up to 100 / per_cent times its least, and a little more; it meets itself and the band below. What
    is larger is dealt into parts, and each two parts are a cell."""
    own = F.floor(F.log("n") / (np.log(100 / per_cent) + 0.01))
    banded = members.select("head", "uid", own.alias("own"), F.explode(F.array(own, own + 1)).alias("band"))
    counts = banded.groupBy("head", "band").agg(F.count("*").alias("c"), F.max(F.col("own") == F.col("band")).alias("any"))
    k = F.when(F.col("c") <= near, 1).otherwise(F.ceil(2 * F.col("c") / near)).cast("int")
    part = F.pmod(F.xxhash64("uid", F.lit(3)), F.col("k")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda p: (p != part) | (F.col("k") == 1))
    homes = F.transform(others, lambda p: F.struct(F.least(p, part).alias("i"), F.greatest(p, part).alias("j")))
    dealt = banded.join(counts.where("c > 1 and any").select("head", "band", k.alias("k")), ["head", "band"])
    return dealt.withColumn("home", F.explode(homes)).select(F.xxhash64("head", "band", "home").alias("head"), "uid")


def near_edges(met: DataFrame, per_cent: int) -> DataFrame:
    """(a, b) that connect the families among the classes (head, uid, n, sketch) of each head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, a, b = None, [], [], []

        def done():
            if len(members) > 1:
                root = near_roots(np.array([x[1] for x in members]), [x[2] for x in members], per_cent)
                for i in np.flatnonzero(root != np.arange(len(members))).tolist():
                    a.append(members[i][0])
                    b.append(members[root[i]][0])

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a.clear()
            b.clear()
            return batch

        for batch in batches:
            for head, *member in zip(*(batch.column(c).to_pylist() for c in ("head", "uid", "n", "sketch"))):
                if head != now:
                    done()
                    now, members = head, []
                members.append(member)
            yield out()
        done()
        yield out()

    parts = partitions(met.sparkSession)
    return met.repartition(parts, "head").sortWithinPartitions("head", "uid").mapInArrow(run, "a long, b long")


# ---- signature trees -------------------------------------------------------------------------------------------


class Node:
    """bits: OR of the token bitmaps below; low, high: range of set sizes; members: of a leaf, by number."""

    __slots__ = ("bits", "low", "high", "below", "members")

    def __init__(self, bits: int, low: int, high: int, below: tuple | list = (), members: np.ndarray | None = None):
        self.bits, self.low, self.high, self.below, self.members = bits, low, high, below, members


def as_bits(codes: np.ndarray, n_codes: int) -> int:
    flags = np.zeros(n_codes, np.uint8)
    flags[codes] = 1
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def tree(which: np.ndarray, n: np.ndarray, codes: list[np.ndarray], n_codes: int) -> Node:
    """Members in order of size and least token, LEAF to a leaf and FANOUT to a node."""
    first = np.array([codes[i][0] if len(codes[i]) else n_codes for i in which])
    order = which[np.lexsort((first, np.floor(np.log(n[which]) / 0.05)))].tolist()
    level, held, tokens = [], [], 0

    def leaf():
        level.append(Node(as_bits(np.concatenate([codes[i] for i in held]), n_codes), int(n[held].min()), int(n[held].max()), members=np.array(held)))

    for i in order:
        if held and (len(held) == LEAF or tokens + len(codes[i]) > LEAF_TOKENS):
            leaf()
            held, tokens = [], 0
        held.append(i)
        tokens += len(codes[i])
    leaf()
    while len(level) > 1:
        up = []
        for i in range(0, len(level), FANOUT):
            part = level[i : i + FANOUT]
            bits = 0
            for x in part:
                bits |= x.bits
            up.append(Node(bits, min(x.low for x in part), max(x.high for x in part), part))
        level = up
    return level[0]


def traverse(a: Node, b: Node, per_cent: int) -> Iterator[tuple[Node, Node]]:
    """Pairs of leaves, each once, that may have linked members; a is b for the pairs within one tree."""
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        if 100 * x.high < per_cent * y.low or 100 * y.high < per_cent * x.low:
            continue
        if (x.bits & y.bits).bit_count() < least_overlap(x.low, y.low, per_cent):
            continue
        if x.members is not None and y.members is not None:
            yield x, y
        elif x is y:
            stack += [(p, q) for i, p in enumerate(x.below) for q in x.below[i:]]
        elif x.members is not None or (y.members is None and y.high - y.low > x.high - x.low):
            stack += [(x, q) for q in y.below]
        else:
            stack += [(p, y) for p in x.below]


def cell_links(tokens: list[np.ndarray], label: np.ndarray, left: int | None, per_cent: int) -> np.ndarray:
    """For each member the least label it is linked to, through links of this cell: among all members, or of the first
    `left` members with the others. tokens: each member's distinct shingles; members of one label count as united."""
    names, root = np.unique(label, return_inverse=True)
    up = np.arange(len(names))
    n = np.array([len(t) for t in tokens])
    _, codes, count = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    # tokens of one member only are in no overlap; the others are numbered
    number = np.cumsum(count > 1) - 1
    n_codes = int(number[-1]) + 1 if len(number) else 0
    shared = [np.sort(number[c[count[c] > 1]]) for c in np.split(codes, np.cumsum(n)[:-1])]
    if n_codes == 0:
        return label
    everyone = np.arange(len(tokens))
    one = tree(everyone[:left], n, shared, n_codes)
    two = one if left is None else tree(everyone[left:], n, shared, n_codes)
    column = np.full(n_codes, -1, np.int64)

    def matrix(members: np.ndarray, columns: int) -> np.ndarray:
        out = np.zeros((len(members), columns), np.float32)
        for k, i in enumerate(members.tolist()):
            c = column[shared[i]]
            out[k, c[c >= 0]] = 1
        return out

    def top() -> np.ndarray:
        while (up != up[up]).any():
            up[:] = up[up]
        return up[root]

    last, dense, of = None, None, np.zeros(0, np.int64)
    now = top()
    for x, y in sorted(traverse(one, two, per_cent), key=lambda p: (id(p[0]), p[0] is not p[1])):
        if (now[x.members] == now[x.members[0]]).all() and (now[y.members] == now[x.members[0]]).all():
            continue
        if x is not last:
            column[of] = -1
            of = np.unique(np.concatenate([shared[i] for i in x.members.tolist()]))
            column[of] = np.arange(len(of))
            last, dense = x, matrix(x.members, len(of))
        common = dense @ (dense if x is y else matrix(y.members, len(of))).T
        linked = (100 + per_cent) * common >= per_cent * (n[x.members][:, None] + n[y.members][None, :])
        i, j = np.nonzero(linked & (common > 0) & (now[x.members][:, None] != now[y.members][None, :]))
        if len(i):
            for p, q in np.unique(np.stack([now[x.members[i]], now[y.members[j]]], 1), axis=0).tolist():
                while up[p] != p:
                    p = up[p]
                while up[q] != q:
                    q = up[q]
                up[max(p, q)] = min(p, q)
            now = top()
    return names[now]


def tree_links(cells: DataFrame, per_cent: int) -> DataFrame:
    """(a, b), a > b, labels that the links of each cell unite, from rows (cell, side, uid, label, tokens); a cell with rows
    of side 1 unites these with side 0 only, any other cell all its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before, members = None, None, []

        def out() -> pa.RecordBatch:
            label = np.array([x[1] for x in members], np.int64)
            side = np.array([x[0] for x in members])
            left = int((side == 0).sum()) if len(side) and side.max() == 1 else None
            # one set is no cell; neither are members of one label, or of one side only where there are two
            if len(members) > 1 and left != 0 and (label != label[0]).any():
                to = cell_links([np.frombuffer(x[2], np.uint64) for x in members], label, left, per_cent)
                pairs = np.unique(np.stack([label, to], 1)[label > to], axis=0)
            else:
                pairs = np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for b in batches:
            for cell, side, uid, label, tokens in zip(*(b.column(c).to_pylist() for c in ("cell", "side", "uid", "label", "tokens"))):
                if cell != now:
                    yield out()
                    now, members = cell, []
                elif (side, uid) == before:
                    continue  # a repeated row's
                before = (side, uid)
                members.append((side, label, tokens))
        yield out()

    # by a hash of the cell: a union of joins that are dealt by cell counts as dealt by cell, and adaptive execution coalesces each by itself
    parts = partitions(cells.sparkSession)
    return cells.repartition(parts, F.xxhash64("cell")).sortWithinPartitions("cell", "side", "uid").mapInArrow(run, "a long, b long")


def packed_texts(rows: DataFrame) -> DataFrame:
    """(key, z) from (key, text): texts compressed for the shuffle, repeated rows of a batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            key, first = np.unique(b.column("key").to_numpy(), return_index=True)
            text = b.column("text")
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array([small(text[i].as_buffer()) for i in first.tolist()], pa.binary())], ["key", "z"])

    return rows.select("key", "text").mapInArrow(run, "key long, z binary")


def with_tokens(found: DataFrame, size: int) -> DataFrame:
    """(uid, label, n, tokens) from (uid, label, one, two, z); rows whose text has another set than the class are dropped
    (another row of the same key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        big = zstandard.ZstdDecompressor().decompress
        for b in batches:
            lo = 0
            z = [big(x) for x in b.column("z").to_pylist()]
            while lo < len(z):
                hi, held = lo, 0
                while hi < len(z) and (hi == lo or held + len(z[hi]) < 1 << 21):
                    held += len(z[hi])
                    hi += 1
                offsets = np.append(0, np.cumsum([len(x) for x in z[lo:hi]])).astype(np.int64)
                row, s = shingle_sets(np.frombuffer(b"".join(z[lo:hi]), np.uint8), offsets, size)
                n, one, two = set_hashes(row, s, hi - lo)
                part = b.slice(lo, hi - lo)
                right = (part.column("one").to_numpy() == one.view(np.int64)) & (part.column("two").to_numpy() == two.view(np.int64))
                cuts = pa.py_buffer((8 * np.append(0, np.cumsum(n))).astype(np.int64))
                tokens = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, cuts, pa.py_buffer(np.ascontiguousarray(s))]).cast(pa.binary())
                out = pa.RecordBatch.from_arrays([part.column("uid"), part.column("label"), pa.array(n, pa.int64()), tokens], ["uid", "label", "n", "tokens"])
                yield out.filter(pa.array(right))
                lo = hi

    return found.select("uid", "label", "one", "two", "z").mapInArrow(run, "uid long, label long, n long, tokens binary")


def family_links(members: DataFrame, families: DataFrame, scratch: Scratch, per_cent: int, cell_tokens: int) -> DataFrame:
    """(a, b) that unite what links connect in each family, from members (uid, label, n, tokens), label being the family, and
    families (uid, family, n)."""
    sizes = families.groupBy("family").agg(F.sum("n").alias("volume"), F.count("*").alias("count"))
    large = scratch.table(
        sizes.where(F.col("volume") > cell_tokens).select(
            F.col("family").alias("label"), F.ceil(F.col("volume") / cell_tokens).cast("int").alias("k"), F.ceil(F.col("count") / ANCHORS).cast("long").alias("every")
        )
    )
    whole = F.xxhash64("label", F.lit(-1)).alias("cell")
    if large.isEmpty():
        return tree_links(members.select(whole, F.lit(0).alias("side"), "uid", F.col("uid").alias("label"), "tokens"), per_cent)
    held = scratch.table(members)
    dealt = held.join(large, "label", "left").withColumn("part", F.when(F.col("k").isNotNull(), F.pmod(F.xxhash64("uid", F.lit(1)), F.col("k")).cast("int")))
    anchor = F.pmod(F.xxhash64("uid", F.lit(2)), F.col("every")) == 0
    homes = F.when(F.col("k").isNull(), F.array(F.lit(-1))).when(anchor, F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array("part"))
    first = dealt.withColumn("home", F.explode(homes))
    inside = scratch.table(
        tree_links(first.select(F.xxhash64("label", "home").alias("cell"), F.lit(0).alias("side"), "uid", F.col("uid").alias("label"), "tokens"), per_cent)
    )
    # what the parts have united so far; the largest component of a family meets nobody of its own again
    so_far = connected_components(inside)
    split = dealt.where("k is not null").join(so_far.withColumnRenamed("node", "uid"), "uid", "left").withColumn("united", F.coalesce("component", "uid"))
    main = split.groupBy("label", "united").agg(F.count("*").alias("c")).groupBy("label").agg(F.max_by("united", F.struct("c", "united")).alias("main"))
    split = split.join(main, "label")
    others = F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda p: p != F.col("part"))
    strays = split.where("united <> main").withColumn("home", F.explode(others))
    meet = split.select(F.xxhash64("label", "part").alias("cell"), F.lit(0).alias("side"), "uid", F.col("united").alias("label"), "tokens").unionByName(
        strays.select(F.xxhash64("label", "home").alias("cell"), F.lit(1).alias("side"), "uid", F.col("united").alias("label"), "tokens")
    )
    # a part that no stray visits has been compared
    met = meet.join(strays.select(F.xxhash64("label", "home").alias("cell")).distinct(), "cell", "left_semi")
    return inside.unionByName(tree_links(met, per_cent))


def jaccard_components(
    docs: DataFrame,
    size: int = SHINGLE,
    per_cent: int = PER_CENT,
    id_col: str = "doc_id",
    text_col: str = "text",
    cell_tokens: int = CELL_TOKENS,
    near: int = NEAR,
) -> DataFrame:
    """(id, n_shingles, component): for each row a struct of its id, its set's size, a struct of its component's least id."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(F.col(id_col).alias("id")).alias("id"), F.xxhash64(F.col(id_col), text).alias("key"), text.alias("text"))
    sets = scratch.table(document_rows(rows, *frequent(rows, size, scratch), size, per_cent))
    classes = sets.where("n > 0").groupBy("one", "two").agg(F.min("id").alias("id"), F.min("key").alias("key"), *(F.first(c).alias(c) for c in ("n", "light", "late", "sketch")))
    reps = scratch.table(classes.withColumn("uid", F.monotonically_increasing_id()))

    # heads: shingles that many documents have are aggregated and joined, which splits; the others meet in a window
    light = reps.select("uid", F.explode("light").alias("token"))
    by_token = Window.partitionBy("token")
    light = light.select("uid", F.min("uid").over(by_token).alias("head"), F.count("*").over(by_token).alias("c")).where("c > 1").select("uid", "head")
    late = reps.select("uid", F.explode("late").alias("token"))
    late = late.join(late.groupBy("token").agg(F.min("uid").alias("head")), "token").select("uid", "head")
    met = scratch.table(light.unionByName(late).distinct())
    crowds = scratch.table(met.groupBy("head").agg(F.count("*").alias("c")).where(F.col("c") > near).select("head"))
    if not crowds.isEmpty():
        crowded = met.join(crowds, "head", "left_semi").join(reps.select("uid", "n"), "uid")
        cells = scratch.table(met.join(crowds, "head", "left_anti").unionByName(crowd_cells(crowded, per_cent, near)))
        scratch.drop(met)
        met = cells
    edges = scratch.table(near_edges(met.join(reps.select("uid", "n", "sketch"), "uid").select("head", "uid", "n", "sketch"), per_cent))
    near_by = connected_components(edges).select(F.col("node").alias("uid"), F.col("component").alias("label"))
    found = scratch.table(reps.join(near_by, "uid").select("uid", "label", "n", "key", "one", "two"))
    scratch.drop(met, crowds, edges)

    parts = partitions(docs.sparkSession)
    wanted = found.select("key", "uid", "label", "one", "two").repartition(parts, "key").hint("shuffle_hash")
    members = with_tokens(packed_texts(rows).repartition(parts, "key").join(wanted, "key"), size)
    links = scratch.table(family_links(members, found.select("uid", F.col("label").alias("family"), "n"), scratch, per_cent, cell_tokens))
    final = connected_components(links)

    named = reps.select("uid", "one", "two", "id").join(final.withColumnRenamed("node", "uid"), "uid", "left").withColumn("c", F.coalesce("component", "uid"))
    least = named.groupBy("c").agg(F.min("id").alias("component_id"))
    names = scratch.table(named.join(least, "c").select("one", "two", "component_id"))
    scratch.drop(reps, links)
    full = sets.select("id", "n", "one", "two").where("n > 0").join(names, ["one", "two"], "left")
    return full.select("id", F.col("n").alias("n_shingles"), F.col("component_id").alias("component")).unionByName(
        sets.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component"))
    )


def components_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cell_tokens: int = CELL_TOKENS, near: int = NEAR) -> DataFrame:
    """The contract's columns."""
    found = jaccard_components(docs, id_col=id_col, text_col=text_col, cell_tokens=cell_tokens, near=near)
    return found.select(F.col("id.id").alias("doc_id"), "n_shingles", F.col("component.id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with the least doc_id of each component only; columns as they were. Rows of one doc_id are one document: they
    stay, or go, together; rows without a doc_id, which are of the least id, stay."""
    gone = jaccard_components(docs).where("id <> component").select(F.col("id.id").alias("doc_id")).distinct().withColumn("apart", F.lit(0).cast("long"))
    apart = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    return docs.withColumn("__apart", apart).join(gone.withColumnRenamed("apart", "__apart").hint("shuffle_hash"), ["doc_id", "__apart"], "left_anti").select(docs.columns)
