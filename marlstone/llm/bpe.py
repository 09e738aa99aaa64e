"""Byte-level BPE: merges replayed in rank order, for the common words once over the whole corpus.

1. `word_counts` counts the words (matches of the pattern) of all documents. A count is chosen so that at most
   TABLE_WORDS words reach it, whatever the corpus (`common_words`).
2. Their merges are replayed over all of them, dealt by word. The words of a task lie in one array of symbols with links
   to the previous and next symbol. An inverted index holds, for each rank, the positions where the adjacent pair makes
   that token. The least rank is taken again and again: every word merges its leftmost position of that rank, and only
   the pairs at the touched neighbours enter the index anew. Per word that is the order of the public library: the least
   rank first, leftmost among equals. A word that is a token as a whole is that token.
3. The result is broadcast: at most TABLE_WORDS words of WORD_CHARS characters or less. Each task looks its words up
   there and replays the merges of the other ones, together for a chunk of documents, by the same index. Stretches
   between spaces that are such words are never split anew.

Ids don't depend on what the table holds. Looking every word up in a joined table of all words was built and measured
too: the words of each chunk, their ids and the documents as word numbers are several times the input (see README).

Defined results: null text is the empty text, with no ids; documents are handled one by one, so ties, repeats and extra
columns don't matter. Memory is bounded by the chunk; the table of known words is emptied when it is full.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import Scratch, texts

#: Words of the corpus-wide table at most, and characters of such a word at most.
TABLE_WORDS, WORD_CHARS = 150_000, 64
#: Distinct pieces that a task counts before it passes their words on.
COUNTED = 150_000
#: Distinct words and pieces beyond that table that a task remembers with their ids.
KNOWN_WORDS = 200_000
#: Places of a rank up to which they are merged one by one.
FEW = 16
#: Characters of text whose new words are merged together.
CHUNK_CHARS = 2 << 20


class Numbered(dict):
    """Gives each new key the next number and remembers it in .new."""

    def __missing__(self, key):
        n = self[key] = len(self)
        self.new.append(key)
        return n

    def numbers(self, keys: list) -> tuple[np.ndarray, list]:
        """The keys' numbers and the keys that are new among them."""
        self.new: list = []
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys)), self.new


class Spelling:
    """Bytes for each number below a width, laid end to end, so that those of many numbers are gathered in one array."""

    #: Numbers gathered together.
    STEP = 1 << 17

    def __init__(self, of: dict[int, bytes], width: int):
        parts = [of.get(k, b"") for k in range(width)]
        self.size = np.fromiter(map(len, parts), np.int64, width)
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(parts), np.uint8)

    def text(self, ids: np.ndarray) -> bytes:
        """The bytes of all numbers, joined."""
        out = []
        for lo in range(0, len(ids), self.STEP):
            part = ids[lo : lo + self.STEP]
            size = self.size[part]
            ends = np.cumsum(size)
            out.append(self.flat[np.arange(ends[-1]) + np.repeat(self.at[part] - (ends - size), size)].tobytes())
        return b"".join(out)

    def cuts(self, ids: np.ndarray, ends: np.ndarray) -> list[int]:
        """Where in `text` stretches of numbers end."""
        return np.append(0, np.cumsum(self.size[ids]))[ends].tolist()


class Codec:
    """Ranks (lines of base64 token and rank) with the pattern that splits text before the merges."""

    def __init__(self, ranks: bytes, pattern: str, known: int = KNOWN_WORDS, common: pa.Table | None = None):
        self.token = {int(r): base64.b64decode(t) for t, r in (x.split() for x in ranks.splitlines() if x)}
        self.rank = {t: r for r, t in self.token.items()}
        self.split = regex.compile(pattern).findall
        self.base = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        width = self.width = max(self.token) + 1
        pairs = [
            (self.rank[t[:i]] * width + self.rank[t[i:]], r)
            for r, t in self.token.items()
            for i in range(1, len(t))
            if t[:i] in self.rank and t[i:] in self.rank
        ]
        codes = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.pair, self.made = np.append(codes[:, 0], -1), np.append(codes[:, 1], -1)
        self.pair_rank = dict(pairs)
        self.known = known
        self.common: dict[str, int] = {}
        self.common_ids, self.common_size = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.common_pieces: dict[str, int] = {}
        self.common_entry = np.zeros(0, np.int64)
        if common is not None and len(common):
            ids = common.column("ids").combine_chunks()
            self.common = {w: i for i, w in enumerate(common.column("word").to_pylist())}
            self.common_ids, self.common_size = ids.flatten().to_numpy(), ids.value_lengths().to_numpy().astype(np.int64)
            if "alone" in common.column_names:  # such a word with its space is what a piece splits into
                pieces = [(w[1:], i) for (w, i), alone in zip(self.common.items(), common.column("alone").to_pylist()) if alone and is_piece(w)]
                self.common_pieces = {p: n for n, (p, _) in enumerate(pieces)}
                self.common_entry = np.array([i for _, i in pieces], np.int64)
        self.spelled, self.listed = Spelling(self.token, width), Spelling({r: b"%d," % r for r in self.token}, width)
        self.forget()

    def forget(self) -> None:
        """Drop the known words and pieces but for the common ones; self.pool holds their ids, self.at and self.size
        say where."""
        self.word, self.piece = Numbered(self.common), Numbered(self.common_pieces)
        self.word_entry, self.piece_entry, self.odd = np.arange(len(self.common)), self.common_entry, np.zeros(len(self.common_entry), bool)
        self.pool, self.size = self.common_ids, self.common_size
        self.at = np.cumsum(self.size) - self.size

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Put ids into the pool; the numbers of the new entries."""
        n = len(self.at)
        self.at = np.concatenate([self.at, len(self.pool) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.pool = np.concatenate([self.pool, ids])
        return np.arange(n, n + len(sizes))

    def _gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the entries in one array, and how many each has."""
        size = self.size[entries]
        ends = np.cumsum(size)
        return self.pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[entries] - (ends - size), size)], size

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes, -1 where it makes none."""
        code = left * self.width + right
        i = np.searchsorted(self.pair[:-1], code)
        return np.where(self.pair[i] == code, self.made[i], -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.base[np.frombuffer(b"".join(words), np.uint8)]
        n = len(sym)
        ends = np.cumsum(sizes)
        word = np.repeat(np.arange(len(words)), sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1], before[ends - sizes] = -1, -1
        alive = np.ones(n, bool)
        # the inverted index: rank -> arrays or lists of positions whose pair makes it
        places: dict[int, list] = {}
        first = np.flatnonzero(after >= 0)
        r = self.ranks_of(sym[first], sym[after[first]])
        first, r = first[r >= 0], r[r >= 0]
        order = np.argsort(r, kind="stable")
        first, r = first[order], r[order]
        cuts = np.flatnonzero(np.diff(r)) + 1
        for part, rank in zip(np.split(first, cuts), r[np.append(0, cuts)].tolist() if len(r) else []):
            places[rank] = [part]
        heap = list(places)
        heapq.heapify(heap)

        def note(p: np.ndarray) -> None:
            got = self.ranks_of(sym[p], sym[after[p]])
            keep = got >= 0
            p, got = p[keep], got[keep]
            if len(p) > 48:
                order = np.argsort(got, kind="stable")
                p, got = p[order], got[order]
                cuts = np.flatnonzero(got[1:] != got[:-1]) + 1
                lows = [0, *cuts.tolist()]
                groups = zip([p[x:y] for x, y in zip(lows, [*lows[1:], len(p)])], got[lows].tolist())
            else:
                groups = zip(p.tolist(), got.tolist())
            for q, rank in groups:
                if rank in places:
                    places[rank].append(q)
                else:
                    places[rank] = [q]
                    heapq.heappush(heap, rank)

        def note_one(p: int) -> None:
            got = self.pair_rank.get(sym.item(p) * self.width + sym.item(after.item(p)))
            if got is None:
                return
            if got in places:
                places[got].append(p)
            else:
                places[got] = [p]
                heapq.heappush(heap, got)

        def merge_few(found: list[int], rank: int) -> None:
            last, later = -1, []
            for p in sorted(set(found)):
                q = after.item(p)
                if q < 0 or not alive.item(p) or self.pair_rank.get(sym.item(p) * self.width + sym.item(q)) != rank:
                    continue
                w = word.item(p)
                if w == last:  # as below: a word's next place waits
                    later.append(p)
                    continue
                last, nxt = w, after.item(q)
                sym[p], alive[q], after[p] = rank, False, nxt
                if nxt >= 0:
                    before[nxt] = p
                    note_one(p)
                prev = before.item(p)
                if prev >= 0:
                    note_one(prev)
            if later:
                if rank not in places:
                    places[rank] = []
                    heapq.heappush(heap, rank)
                places[rank] += later

        while heap:
            rank = heapq.heappop(heap)
            found = places.pop(rank)
            if len(found) <= FEW and sum(x.size if isinstance(x, np.ndarray) else 1 for x in found) <= FEW:
                merge_few([p for x in found for p in (x.tolist() if isinstance(x, np.ndarray) else (x,))], rank)
                continue
            many = [x for x in found if isinstance(x, np.ndarray)]
            if len(many) < len(found):
                many.append(np.array([x for x in found if not isinstance(x, np.ndarray)], np.int64))
            p = many[0] if len(many) == 1 else np.concatenate(many)
            p = np.sort(p)
            p = p[np.append(True, p[1:] != p[:-1])]
            p = p[alive[p] & (after[p] >= 0)]
            p = p[self.ranks_of(sym[p], sym[after[p]]) == rank]  # what an earlier merge has changed no longer counts
            if not len(p):
                continue
            w = word[p]
            lead = np.ones(len(p), bool)
            lead[1:] = w[1:] != w[:-1]
            if not lead.all():  # a word's next place waits until the word's least rank is looked for again
                places[rank] = [p[~lead]]
                heapq.heappush(heap, rank)
                p = p[lead]
            q = after[p]
            sym[p] = rank
            alive[q] = False
            nxt = after[q]
            after[p] = nxt
            there = nxt >= 0
            before[nxt[there]] = p[there]
            note(p[there])
            prev = before[p]
            note(prev[prev >= 0])
        whole = np.fromiter((self.rank.get(w, -1) for w in words), np.int64, len(words))
        for i in np.flatnonzero(whole >= 0).tolist():
            lo = int(ends[i] - sizes[i])
            alive[lo : ends[i]] = False
            alive[lo], sym[lo] = True, whole[i]
        return sym[alive].astype(np.int32), np.bincount(word[alive], minlength=len(words))

    def ids_of_words(self, words: list[str]) -> np.ndarray:
        """Entries of the words; the new ones among them are merged together."""
        numbers, new = self.word.numbers(words)
        if new:
            self.word_entry = np.append(self.word_entry, self._add(*self.merge([w.encode() for w in new])))
        return self.word_entry[numbers]

    def learn(self, pieces: list) -> None:
        """Give new pieces their ids. A piece is what stands between single spaces, with the space before it; as a
        one-tuple it stands at a text's start. No match of the pattern goes over a single space with other characters on
        both sides, so a piece has the same ids wherever it stands. A piece that is empty or has white space at an end
        is odd: there the rule doesn't hold."""
        strings = [p[0] if isinstance(p, tuple) else " " + p for p in pieces]
        split = [self.split(x) for x in strings]
        ids, sizes = self._gather(self.ids_of_words([w for x in split for w in x]))
        ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum([len(x) for x in split])).astype(np.int64)]
        raw = [p[0] if isinstance(p, tuple) else p for p in pieces]
        self.odd = np.append(self.odd, np.fromiter((not x or x[0].isspace() or x[-1].isspace() for x in raw), bool, len(raw)))
        self.piece_entry = np.append(self.piece_entry, self._add(ids, np.diff(ends)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each has."""
        if len(self.piece) - len(self.common_pieces) + len(self.word) - len(self.common) > self.known:
            self.forget()
        pieces, counts = [], []
        for t in texts:
            got = t.split(" ")
            got[0] = (got[0],)
            pieces += got
            counts.append(len(got))
        i, new = self.piece.numbers(pieces)
        if new:
            self.learn(new)
        lows = (np.cumsum(counts) - counts).astype(np.int64)
        odd = np.logical_or.reduceat(self.odd[i], lows) if len(i) else np.zeros(0, bool)
        i = self.piece_entry[i]
        if odd.any():  # the whole pattern goes over these texts
            counts = np.array(counts, np.int64)
            whole = {k: self.ids_of_words(self.split(texts[k])) for k in np.flatnonzero(odd).tolist()}
            i = np.concatenate([whole[k] if k in whole else i[lows[k] : lows[k] + counts[k]] for k in range(len(texts))])
            for k, x in whole.items():
                counts[k] = len(x)
        ids, sizes = self._gather(i)
        upto = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts)).astype(np.int64)]
        return ids, np.diff(upto)

    def digests(self, ids: np.ndarray, counts: np.ndarray) -> tuple[list[str], list[str]]:
        """For each text the digests of its ids' list and of the bytes that its ids decode to."""
        ends = np.append(0, np.cumsum(counts))

        def of(spelling: Spelling, last: int) -> list[str]:
            text, cuts = memoryview(spelling.text(ids)), spelling.cuts(ids, ends)
            return [hashlib.sha256(text[a : max(a, z - last)]).hexdigest() for a, z in zip(cuts, cuts[1:])]

        return of(self.listed, 1), of(self.spelled, 0)  # the list without its last comma

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def is_piece(word: str) -> bool:
    """Whether a word is a space and a piece that isn't odd and holds no space (see `Codec.learn`)."""
    p = word[1:]
    return word[:1] == " " and p != "" and " " not in p and not p[0].isspace() and not p[-1].isspace()


_codecs: dict[str, Codec] = {}


def codec(ranks: bytes, pattern: str, common: pa.Table | None = None, name: str = "") -> Codec:
    """One codec a Python worker, for the next task with the same table as well; the other words go with the task."""
    key = hashlib.sha256(ranks + pattern.encode() + name.encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks, pattern, common=common)
    _codecs[key].forget()
    return _codecs[key]


def word_counts(docs: DataFrame, pattern: str, text_col: str = "text") -> DataFrame:
    """(word, n): how often each word of at most WORD_CHARS characters stands in the documents' stretches between single
    spaces, each taken with the space before it. Each task adds up what it can hold; the rest is a grouped sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern).findall
        pieces, starts = Counter(), Counter()

        def added_up() -> pa.RecordBatch:
            words: Counter = Counter()
            for space, counted in ((" ", pieces), ("", starts)):
                for p, n in counted.items():
                    for w in split(space + p):
                        words[w] += n
                counted.clear()
            short = [w for w in words if len(w) <= WORD_CHARS]
            return pa.RecordBatch.from_arrays([pa.array(short, pa.string()), pa.array([words[w] for w in short], pa.int64())], ["word", "n"])

        for b in batches:
            for t in b.column("text").to_pylist():
                first, _, rest = t.partition(" ")
                starts[first] += 1
                if rest:
                    pieces.update(rest.split(" "))
                if len(pieces) + len(starts) > COUNTED:
                    yield added_up()
        yield added_up()

    rows = texts(docs, text_col, text_col).select("text")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def common_words(docs: DataFrame, ranks: bytes, pattern: str, text_col: str = "text", most: int = TABLE_WORDS) -> pa.Table:
    """(word, ids, alone) of the words that reach the least count which at most `most` words reach; alone: whether the
    pattern leaves the word whole where nothing else stands."""
    scratch = Scratch(docs.sparkSession)
    counts = scratch.table(word_counts(docs, pattern, text_col))
    step = F.floor(F.log2("n") * 8)  # a few hundred steps at any size
    least, taken = None, 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("k"), F.min("n").alias("n")).collect(), reverse=True):
        taken += r.k
        if taken > most:
            break
        least = r.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codec(ranks, pattern)
        for b in batches:
            words = b.column("word").to_pylist()
            ids, sizes = own.merge([w.encode() for w in words])
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("word"), lists, pa.array([own.split(w) == [w] for w in words], pa.bool_())], ["word", "ids", "alone"])

    chosen = counts.where(F.col("n") >= F.lit(least)).select("word").repartition(docs.sparkSession.sparkContext.defaultParallelism, "word")
    out = chosen.mapInArrow(run, "word string, ids array<int>, alone boolean").toArrow()
    scratch.drop(counts)
    return out


def shared_codec(docs: DataFrame, ranks: bytes, pattern: str, text_col: str, most: int):
    """A function that gives a task its codec with the broadcast table of common words."""
    table = common_words(docs, ranks, pattern, text_col, most)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    data = sink.getvalue().to_pybytes()
    name, shared = hashlib.sha256(data).hexdigest(), docs.sparkSession.sparkContext.broadcast(data)
    return lambda: codec(ranks, pattern, pa.ipc.open_stream(shared.value).read_all(), name)


def blocks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[slice]:
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield slice(lo, i)
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield slice(lo, len(texts))


def bpe_encode(
    docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", most: int = TABLE_WORDS
) -> DataFrame:
    """(doc_id, ids): the ids of each whole text. The ranks (about a megabyte) travel with the function."""
    given = shared_codec(docs, ranks, pattern, text_col, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = given()
        for b in batches:
            all_texts = b.column("text").to_pylist()
            for s in blocks(all_texts):
                ids, counts = own.encode(all_texts[s])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[s.start : s.stop], lists], ["doc_id", "ids"])
        own.forget()

    rows = texts(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def bpe_decode(encoded: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """(doc_id, ids, data): the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for b in batches:
            data = [own.decode(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(data, pa.binary())], ["doc_id", "ids", "data"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.mapInArrow(run, f"doc_id {kind}, ids array<int>, data binary")


def bpe_round_trip(
    docs: DataFrame,
    ranks: bytes,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
    most: int = TABLE_WORDS,
) -> DataFrame:
    """Encode, decode and digest in one pass: (doc_id, n_tokens, ids_sha256, decoded_sha256[, ids])."""
    given = shared_codec(docs, ranks, pattern, text_col, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = given()
        for b in batches:
            all_texts = b.column("text").to_pylist()
            for s in blocks(all_texts):
                ids, counts = own.encode(all_texts[s])
                ids_sha, data_sha = own.digests(ids, counts)
                columns = {
                    "doc_id": b.column("doc_id")[s.start : s.stop],
                    "n_tokens": pa.array(counts, pa.int64()),
                    "ids_sha256": pa.array(ids_sha, pa.string()),
                    "decoded_sha256": pa.array(data_sha, pa.string()),
                }
                if keep_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
        own.forget()

    rows = texts(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)


def read_ranks(path: str) -> bytes:
    """The vocabulary file, read once on the driver."""
    with open(path, "rb") as f:
        return f.read()
