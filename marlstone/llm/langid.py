"""Language identification by a string kernel.

Kernel: the blended spectrum of byte n-grams (1 to 4) of the letters of a text, lower-cased, as presence (an n-gram
counts once however often it occurs), restricted to the n-grams of the landmark texts and normalised to length one.
Nyström: m landmark texts Z give features k(x, Z) K_ZZ^(-1/2); one-versus-rest kernel ridge regression on them is a small
linear solve. The three matrices fold into one: scoring is the product of a batch's presence matrix with V x classes
weights.

Learning reads only text and non-null language of the rows the caller allows, at most `per_language` rows a language
(those with the least hash of id, so any partitioning gives the same sample): a documented bound. Landmarks are the
first `landmarks` of these a language. Texts are learned and scored whole.

A margin says which language is likeliest, not whether any is: the margins of a text add up to 2 - L over L languages. What
rejects junk, other scripts and languages that were not learned is the share of the text's n-grams that the landmarks know,
against a line from the labelled rows (see JUDGED).

Defined results: null text, or text without a letter, is `und` with score 0; ties between languages go to the first
in alphabetical order; with no labelled row every text is `und`. Rows are scored one by one, so repeated rows and
extra columns change nothing.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import chunks, mix, small_batches

#: Labelled rows a language that are learned from, landmarks a language, and the ridge.
PER_LANGUAGE, LANDMARKS, RIDGE = 200, 24, 0.02
ORDERS = (1, 2, 3, 4)
#: A text is junk where the share of its JUDGED-grams that the landmarks know is below a language's line: LINE times the
#: share that all but FEWEST of the language's labelled rows reach. A language of fewer than LEAST rows has no line.
#: A share counts as below only where it is by DEVIATIONS of chance, so a text of a few letters stays.
JUDGED, LINE, FEWEST, LEAST, DEVIATIONS = 3, 0.75, 0.1, 10, 3.0
#: Presence rows that learning holds at a time.
BLOCK = 64

# Bytes that count: ASCII letters, lower-cased, and the bytes of characters above ASCII; every other byte is a space.
LETTERS = np.full(256, 32, np.uint8)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[65:91] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)


def grams(data: np.ndarray) -> list[np.ndarray]:
    """Codes of the n-grams that start at each byte, one array an order; runs of spaces are one space."""
    x = LETTERS[data]
    x = x[~((x == 32) & np.append(False, x[:-1] == 32))].astype(np.uint64)
    out, code = [], np.zeros(len(x), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(x) < n:
            break
        code = (code[: len(x) - n + 1] << np.uint64(8)) | x[n - 1 :]
        out.append(code | np.uint64(n << 40))
    return out


class Model:
    """Columns of the landmarks' n-grams and the folded weights."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray, bias: np.ndarray, languages: list[str]):
        self.codes, self.weights, self.bias, self.languages = codes, weights.astype(np.float32), bias, languages
        #: Least share of known n-grams of each language; 0 is no line.
        self.lines = np.zeros(len(languages))
        # an open table: slot -> column; colliding n-grams go on to the next of a few slots
        self.slots = 1 << max(10, (4 * len(codes)).bit_length())
        self.slot = np.full(self.slots, -1, np.int32)
        for i, h in enumerate((mix(codes.copy()) % np.uint64(self.slots)).tolist()):
            while self.slot[h] >= 0:
                h = (h + 1) % self.slots
            self.slot[h] = i
        self.chain = 1
        for i, h in enumerate((mix(codes.copy()) % np.uint64(self.slots)).tolist()):
            d = 1
            while self.slot[h] != i:
                h, d = (h + 1) % self.slots, d + 1
            self.chain = max(self.chain, d)

    def columns(self, code: np.ndarray) -> np.ndarray:
        """Columns of the known n-grams among code."""
        h = (mix(code.copy()) % np.uint64(self.slots)).astype(np.int64)
        out = []
        for _ in range(self.chain):
            c = self.slot[h]
            hit = (c >= 0) & (self.codes[c] == code)
            out.append(c[hit])
            go = (c >= 0) & ~hit
            if not go.any():
                break
            h, code = (h[go] + 1) % self.slots, code[go]
        return np.concatenate(out)

    def presence(self, data: np.ndarray, row: np.ndarray) -> tuple[int, int]:
        """Set the row's entry of every known n-gram of data to one; how many of its JUDGED-grams are known, and of how many."""
        known, total = 0, 0
        for order, code in zip(ORDERS, grams(data)):
            found = self.columns(code)
            row[found] = 1
            if order == JUDGED:
                known, total = len(found), len(code)
        return known, total

    def refuses(self, language: np.ndarray, known: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Whether texts know too few n-grams for texts of these languages (by number)."""
        line = self.lines[language]
        return known + DEVIATIONS * np.sqrt(total * line * (1 - line)) < line * total

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Margins of each language for presence rows."""
        norm = np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
        return (x @ self.weights) / norm + self.bias


def fit(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Model from (language, text) rows in a fixed order; texts without a letter teach nothing."""
    rows = [r for r in rows if has_letter(r[1])]
    languages = sorted({lang for lang, _ in rows})
    data = [np.frombuffer(t.encode(), np.uint8) for _, t in rows]
    seen: dict[str, int] = {}
    marks = []
    for i, (lang, _) in enumerate(rows):
        seen[lang] = seen.get(lang, 0) + 1
        if seen[lang] <= landmarks:
            marks.append(i)
    found = [np.concatenate([np.unique(g) for g in grams(data[i])] or [np.zeros(0, np.uint64)]) for i in marks]
    codes = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]))
    model = Model(codes, np.zeros((len(codes), len(languages))), np.zeros(len(languages)), languages)
    if not rows or not len(codes):
        return model

    def unit_rows(which: list[int]) -> np.ndarray:
        x = np.zeros((len(which), len(codes)), np.float32)
        for j, i in enumerate(which):
            model.presence(data[i], x[j])
        return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))

    z = unit_rows(marks)
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    good = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, good] / np.sqrt(values[good])  # K_ZZ^(-1/2) on its range
    # only the landmarks' rows are kept; the others pass in blocks
    phi = np.concatenate([unit_rows(list(range(lo, min(lo + BLOCK, len(rows))))) @ z.T for lo in range(0, len(rows), BLOCK)]).astype(np.float64) @ root
    y = np.array([[1.0 if lang == c else -1.0 for c in languages] for lang, _ in rows])
    # each language weighs the same, however many rows it has
    count = {c: sum(lang == c for lang, _ in rows) for c in languages}
    w = np.array([1 / count[lang] for lang, _ in rows])[:, None]
    w /= w.mean()
    mean_phi, mean_y = (w * phi).mean(axis=0) , (w * y).mean(axis=0)
    centred = phi - mean_phi
    solved = np.linalg.solve(centred.T @ (w * centred) + ridge * len(rows) * np.eye(phi.shape[1]), centred.T @ (w * (y - mean_y)))
    folded = z.T.astype(np.float64) @ (root @ solved)
    out = Model(codes, folded, mean_y - mean_phi @ solved, languages)
    # known shares of the labelled rows; a landmark's own n-grams are known where another landmark has them
    owners, own = (z > 0).sum(axis=0), set(marks)
    shares: dict[str, list[float]] = {c: [] for c in languages}
    for i, (lang, _) in enumerate(rows):
        code = (grams(data[i])[JUDGED - 1 :] or [np.zeros(0, np.uint64)])[0]
        if len(code):
            found = model.columns(code)
            shares[lang].append(float((owners[found] > 1).sum() if i in own else len(found)) / len(code))
    for k, c in enumerate(languages):
        if len(shares[c]) >= LEAST:
            out.lines[k] = LINE * np.quantile(shares[c], FEWEST)
    return out


def has_letter(text: str) -> bool:
    return any(unicodedata.category(c)[0] == "L" for c in text)


def labelled_sample(docs: DataFrame, allowed: Column, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """At most per_language (language, text) rows of each language, those with the least hash of the id.

    Counts come first; a threshold on the hash then lets about twice the wanted rows of each language through the scan,
    so what reaches the driver is bounded by languages x per_language, not by the corpus.
    """
    rows = docs.where(allowed & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r.lang: r.n for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    key = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(20240229)), F.lit(1 << 40))
    passes = F.lit(False)
    for lang, n in sorted(counts.items()):
        share = min(1.0, (per_language + 6 * per_language**0.5 + 10) / n)
        passes = passes | ((F.col(lang_col) == lang) & (key < int(share * (1 << 40))))
    got = rows.where(passes).select(F.col(lang_col).alias("lang"), key.alias("k"), F.col(text_col).alias("text"))
    kept: dict[str, int] = {}
    out = []
    for r in sorted(got.collect(), key=lambda r: (r.k, r.text)):
        kept[r.lang] = kept.get(r.lang, 0) + 1
        if kept[r.lang] <= per_language:
            out.append((r.lang, r.text))
    return out


def scored(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and whether the model refuses it, of each text of a chunk."""
    n = len(offsets) - 1
    step = max(1, (8 << 20) // (4 * max(1, len(model.codes))))
    names, score, refused = np.full(n, "und", object), np.zeros(n), np.ones(n, bool)
    high = np.append(0, np.cumsum(data >= 128))[offsets]
    plain = np.append(0, np.cumsum((LETTERS[data] != 32) & (data < 128)))[offsets]
    ok = np.diff(plain) > 0
    for i in np.flatnonzero(~ok & (np.diff(high) > 0)).tolist():
        ok[i] = has_letter(bytes(data[offsets[i] : offsets[i + 1]]).decode())
    todo = np.flatnonzero(ok).tolist() if model.languages else []
    for lo in range(0, len(todo), step):
        part = todo[lo : lo + step]
        x = np.zeros((len(part), len(model.codes)), np.float32)
        known = np.array([model.presence(data[offsets[i] : offsets[i + 1]], x[j]) for j, i in enumerate(part)])
        margin = model.scores(x)
        best = margin.argmax(axis=1)
        names[part] = [model.languages[k] for k in best.tolist()]
        score[part] = np.clip((margin[np.arange(len(part)), best] + 1) / 2, 0, 1)
        refused[part] = model.refuses(best, known[:, 0], known[:, 1])
    return names, score, refused


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), judge: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score) for each whole text, with the columns named by keep; with judge also refused: whether the
    text is `und` or knows too few n-grams of the learned languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, data, offsets in chunks(b):
                names, score, refused = scored(model, data, offsets)
                part = b.slice(rows.start, rows.stop - rows.start)
                last = [pa.array(refused)] if judge else []
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(part.column(c) for c in keep), pa.array(names, pa.string()), pa.array(score, pa.float64()), *last],
                    ["doc_id", *keep, "lang_pred", "score"] + ["refused"] * judge,
                )

    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.col(c) for c in keep))
    fields = [f for f in source.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double" + ", refused boolean" * judge
    return source.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """The contract's held-out rows: crc32 of the id as text, modulo 5; a row without an id isn't one."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, allowed: Column | None = None, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Learn from the allowed labelled rows of docs, then score all rows."""
    sample = labelled_sample(docs, F.lit(True) if allowed is None else allowed, per_language)
    return predict(docs, fit(sample, landmarks), keep=keep)


def drop_rejected(docs: DataFrame, languages: tuple[str, ...] | None = None) -> DataFrame:
    """docs without texts that are `und`, know too few n-grams of every learned language, or are of a language that is not
    wanted (all learned ones are, if languages is None); columns as they were. Rows pass once, whole, and are filtered in place."""
    small_batches(docs.sparkSession)
    model = fit(labelled_sample(docs, F.lit(True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.RecordBatch.from_arrays([pc.fill_null(b.column("text"), "")], ["text"])
            for rows, data, offsets in chunks(text):
                names, _, refused = scored(model, data, offsets)
                keep = ~refused if languages is None else ~refused & np.isin(names.astype(str), languages)
                yield b.slice(rows.start, rows.stop - rows.start).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
