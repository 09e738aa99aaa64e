"""Personal data: four base rules, and a linear-chain conditional random field over word-shape features.

The field is trained here, from a small labelled table of tokens (`starter_labels`, or the caller's; at most TABLE rows
reach the driver): gradient ascent on the exact log-likelihood by the forward-backward recursion, in numpy. Features of a
token are its collapsed shape, its cue (title, given name, street word, ...), its count of letters and of digits and its
closing punctuation, each for the token itself and the two on either side. Tokens are decoded by Viterbi in numpy batches: sentences of like
length are the rows of one array, all steps are taken for all of them together. Distinct tokens are looked at once a
worker; the table of known tokens is emptied when it is full.

Defined results: null text is the empty text, without spans; a text of one word is a sentence of one; texts are handled
one by one, so repeated rows, ties and extra columns change nothing; offsets are code points, end exclusive.
"""

from __future__ import annotations

import functools
import itertools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import texts

# The base rules of the contract. An address can't begin inside a run of digits: it would fail at the run's start.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone", "name", "address", "id")
SPANS = "array<struct<kind:string,start:int,end:int>>"

LABELS = ("O", "B-name", "I-name", "B-address", "I-address", "B-id", "I-id")
#: Rows of a labelled table, distinct tokens a worker remembers, tokens decoded together, epochs, step and penalty.
TABLE, KNOWN, TOKENS, EPOCHS, STEP, PENALTY = 50_000, 400_000, 400_000, 90, 0.15, 0.02

#: A token's features act on its own step and on the steps this far off.
OFFSETS = (0, 1, -1, 2, -2)

# Cue words in lower case.
CUES = {
    "title": "mr mrs ms miss dr prof herr frau monsieur madame mme señor señora sr sra sir don doña".split(),
    "call": "name named patient customer sincerely signed regards dear hello hi contact liebe lieber cher chère estimado estimada hola bonjour hallo gezeichnet signé firmado nombre nom kunde client cliente paciente".split(),
    "street": "street road avenue lane drive court way terrace square boulevard straße strasse weg platz gasse allee rue chemin impasse calle plaza avenida paseo camino".split(),
    "place": "address lives living residing adresse dirección wohnt wohnhaft habite domicilié vive reside anschrift domicilio".split(),
    "number": "ssn passport iban id license licence tax account ausweis reisepass steuernummer nif dni passeport pasaporte number nummer numéro número no nr".split(),
    "given": """anna peter maria josé claire thomas ingrid paul laura david sarah michael emma james robert linda susan karen jessica
        daniel kevin barack wei ahmed fatima ivan olga yuki priya raj hans klaus jürgen heike sabine wolfgang ursula petra stefan
        markus katrin andreas monika jean pierre marie jacques françois sophie camille julien nathalie antoine isabelle luc carlos juan
        pedro lucía carmen javier miguel sofía elena pablo manuel rosa antonio francisco giulia marco luca alessandro francesca john
        mary elizabeth william richard joseph charles christopher matthew anthony andrew steven barbara patricia jennifer""".split(),
}
CUE = {w: k for k, ws in CUES.items() for w in ws}
TRIM = "\"'()[]{}<>.,;:!?#*$%&"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses as the rule's pattern finds them: from each "@" the domain on the right, then back to what precedes it.

    Searching from the left would read a run of word characters again from each of its characters."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four base rules, by start, then kind."""
    out = []
    out += [("email", *span) for span in emails(text)]
    for m in IP.finditer(text) if "." in text else ():
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


# ---- features --------------------------------------------------------------------------------------------------


def shape(word: str) -> str:
    """Capital letters as X, others as x, digits as d, the rest as it is; runs collapse."""
    signs = ("X" if c.isupper() else "x" if c.isalpha() else "d" if c.isdigit() else c for c in word)
    return "".join(k for k, _ in itertools.groupby(signs))


def features(token: str) -> tuple[str, ...]:
    word = token.strip(TRIM)
    digits = sum(c.isdigit() for c in word)
    last = token[-1:] if token[-1:] in ".!?,;:" else ""
    sizes = "0" if not digits else "s" if digits < 3 else "m" if digits < 6 else "l" if digits < 10 else "x"
    letters = min(sum(c.isalpha() for c in word), 4)
    return ("any", "shape=" + shape(word)[:8], "cue=" + cue(word), f"letters={letters}", "digits=" + sizes, "end=" + last)


def cue(word: str) -> str:
    """The cue of a word; names of streets in one word count by their end."""
    low = word.lower()
    return CUE.get(low) or ("street" if low.endswith(("straße", "strasse", "gasse")) else "")


def ends_sentence(token: str) -> bool:
    """Whether a sentence ends with the token; titles, initials and two-letter abbreviations don't end one."""
    word = token.strip(TRIM)
    return token[-1:] in ".!?" and not (token.endswith(".") and 0 < len(word) and (len(word) <= 2 or CUE.get(word.lower()) == "title"))


class Field:
    """Weights: features x labels for each of OFFSETS, and transitions."""

    def __init__(self, names: list[str], around: list[np.ndarray], move: np.ndarray, begin: np.ndarray):
        self.number = {f: i for i, f in enumerate(names)}
        self.around, self.move, self.begin = around, move, begin

    def rows(self, token: str) -> list[int]:
        return [self.number[f] for f in features(token) if f in self.number]

    def parts(self, tokens: list[str]) -> np.ndarray:
        """For each token what it adds to the scores at each of OFFSETS from it: tokens x offsets x labels."""
        out = np.zeros((len(tokens), len(OFFSETS), len(LABELS)))
        for i, t in enumerate(tokens):
            r = self.rows(t)
            for k in range(len(OFFSETS)):
                out[i, k] = self.around[k][r].sum(axis=0)
        return out

    def best(self, scores: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Viterbi over sentences x steps x labels; a sentence's steps beyond its length don't count."""
        n, steps, _ = scores.shape
        now = scores[:, 0] + self.begin
        back = np.zeros((n, steps, len(LABELS)), np.int8)
        for t in range(1, steps):
            ways = now[:, :, None] + self.move
            back[:, t] = ways.argmax(axis=1)
            step = ways.max(axis=1) + scores[:, t]
            now = np.where((t < length)[:, None], step, now)
        out = np.zeros((n, steps), np.int8)
        label = now.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            inside = t < length
            out[inside, t] = label[inside]
            if t:
                label = np.where(inside, back[np.arange(n), t, label], label)
        return out


#: Transitions that labels allow: I- only behind B- or I- of its kind.
ALLOWED = np.array([[b[0] != "I" or (a != "O" and a[2:] == b[2:]) for b in LABELS] for a in LABELS])
BEGIN = np.array([0.0 if b[0] != "I" else -1e4 for b in LABELS])


def sentence_scores(parts: np.ndarray, rows: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Sentences x steps x labels: rows says which row of parts a step's token has, inside which steps count."""
    out = parts[rows, 0].copy()
    for k, o in enumerate(OFFSETS[1:], 1):
        if o > 0:
            out[:, o:] += parts[rows[:, :-o], k]
        else:
            out[:, :o] += np.where(inside[:, -o:, None], parts[rows[:, -o:], k], parts.dtype.type(0))
    return out


def train(sentences: list[list[tuple[str, str]]], epochs: int = EPOCHS, step: float = STEP, penalty: float = PENALTY) -> Field:
    """Field from labelled sentences: Adam on the penalised log-likelihood, all sentences together, fixed start."""
    names = sorted({f for s in sentences for t, _ in s for f in features(t)})
    k = len(LABELS)
    field = Field(names, [np.zeros((len(names), k)) for _ in OFFSETS], np.where(ALLOWED, 0.0, -1e4), BEGIN)
    tokens = [t for s in sentences for t, _ in s]
    gold = np.array([LABELS.index(y) for s in sentences for _, y in s])
    length = np.array([len(s) for s in sentences])
    start = np.cumsum(length) - length
    x = np.zeros((len(tokens), len(names)))
    for i, t in enumerate(tokens):
        x[i, field.rows(t)] = 1
    n, steps = len(sentences), int(length.max())
    at = start[:, None] + np.arange(steps)
    real = np.arange(steps) < length[:, None]
    at = np.where(real, at, 0)
    reach = [real & (np.arange(steps) - o >= 0) & (np.arange(steps) - o < length[:, None]) for o in OFFSETS]
    truth = np.zeros((n, steps, k))
    truth[real] = np.eye(k)[gold]
    pairs_true = np.einsum("nti,ntj->ij", truth[:, :-1], truth[:, 1:])
    weights = [*field.around, field.move]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]

    def log_sum(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for epoch in range(1, epochs + 1):
        scores = sentence_scores(np.stack([x @ w for w in weights[:-1]], axis=1), at, real)
        move = weights[-1]
        alpha, beta = np.zeros((n, steps, k)), np.zeros((n, steps, k))
        alpha[:, 0] = scores[:, 0] + BEGIN
        for t in range(1, steps):
            new = log_sum(alpha[:, t - 1, :, None] + move, 1) + scores[:, t]
            alpha[:, t] = np.where(real[:, t, None], new, alpha[:, t - 1])
        for t in range(steps - 2, -1, -1):
            new = log_sum(move[None] + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(real[:, t + 1, None], new, 0.0)
        z = log_sum(alpha[:, -1], 1)
        marginal = np.where(real[:, :, None], np.exp(alpha + beta - z[:, None, None]), 0.0)
        both = alpha[:, :-1, :, None] + move + (scores[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
        pairs = np.where(real[:, 1:, None, None], np.exp(np.minimum(both, 0)), 0.0).sum(axis=(0, 1))
        off = truth - marginal
        gradient = [x[(at - o)[r]].T @ off[r] for o, r in zip(OFFSETS, reach)]
        gradient.append(np.where(ALLOWED, pairs_true - pairs, 0.0))
        for i, g in enumerate(gradient):
            g = g / n - penalty / n * np.where(weights[i] < -1e3, 0.0, weights[i])
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            weights[i] += step * (first[i] / (1 - 0.9**epoch)) / (np.sqrt(second[i] / (1 - 0.99**epoch)) + 1e-8)
    field.around, field.move = weights[:-1], weights[-1]
    return field


# ---- the small labelled table ----------------------------------------------------------------------------------


# Patterns of the labelled table. A bracketed part is an entity. G given name, F family name, I word that
# looks like a name, T title, R road, K road word, N number, P and S identifiers, W word, C capitalised word, X digits, Q dotted digits, Y Z V a call number.
PATTERNS = """
Please contact [name G F] about the W .
Dear T [name F] , thank you for the W .
T [name G F] will see you this W .
T [name I F] W the W .
Signed , [name G F]
Kind regards , [name I F]
Patient [name G F] was seen in the W .
The customer name is [name G F] .
W W by [name G F] and [name G F] in the W .
[name G F] W the W of the C W .
Yesterday [name G F] W to C with the W .
My W is called [name G] , and the W W .
Hi [name G] , the W is W .
I met [name G F] at the W last C .
T [name F] of the W W N W .
T [name F] W W .
I W with [name G F] on C .
C [name G F] W C .
[name G N. F] W the W .
Then [name G F] , the W , W .
She lives at [address N R K] near the W .
Address: [address N R K] , second floor .
They moved from [address N R K] to [address N R K] in the W .
residing at [address N R R K] since the W .
Send it to [address N R K] , C .
[address N R K] , C
Her passport [id P] was found in the W .
SSN [id S] belongs to the W .
Tax id [id P] is on the W .
The passport number is [id P] .
His SSN is [id S] , and the W W .
Bitte rufen Sie Herrn [name F] an .
Herr [name G F] W die W .
Liebe Frau [name F] , W W W .
[name G F] W in C und W .
Gestern hat [name G F] die W W .
Mein Kunde [name G F] W die W .
Er wohnt in der [address Rstraße N] in C .
Adresse: [address Rstraße N] , C
Die W liegt am [address R Platz N] .
Sein Ausweis [id P] ist W .
Steuernummer [id P] , W .
Monsieur [name F] W la W .
Madame [name G F] est W de la W .
Bonjour [name G] , la W est W .
Hier , [name G F] a W le W de C .
Il habite [address N rue de R] à C .
Adresse : [address N rue R] , C
Elle reste au [address N avenue de R] .
Son passeport [id P] est W .
Numéro [id P] , W .
El señor [name F] W la W .
La señora [name G F] W en la W .
Hola [name G] , la W W .
Ayer [name G F F] W el W de C .
Mi cliente [name G F] W .
Vive en la [address calle R N] de C .
Dirección: [address calle de R N] , C
Su pasaporte [id P] W .
DNI [id P] de la W .
""".strip().splitlines()
PLAIN = """
C W and the W were in the W .
C the W of the W . C
C W
C C W the N of W
in N the W had N W and C W .
C of C the W , C and W .
the W W W C W W N .
C
W
W X W X C X
X W the X N X
W | C | C. | W | C | C, | W. | C |
C C C C C C C of W W
C C C W W C C .
W W C C C C C C C the W .
the C C License, Version N .
C under CC BY-NC N the W
W, C C and C W, W C
C! C C! C, C? C W!! C!! C!! W!!
W: C C W; C N C W .
C N C of N C W
N C W . C N
N C C W N .
| C W | C C | N | C N C |
CC C XX C CC W CC
C W W , W W W W . C W W W , de W W la W W .
C W la W de C . C W les W , un W .
W W der W , und W W . C W W N W .
The street was W , and the road W to C .
The name of the W is W .
His address W the W , and no number W .
C C Street W W .
The W id is a number of the W .
Dear W , the W of C .
No W , no W . C is W .
contact W W C the W .
C lives W the W .
C , W .
C , W W W .
C , W W , W . C
C , W C W , W .
W . C , W .
C , C , W .
W Y Z V W .
C W Y Z V C
C W Q , W Q .
W Q W W
W C X W .
X the . C
La calle W , la plaza W .
La rue W et W .
Die straße W und W .
""".strip().splitlines()
FAMILY = """Müller Smith Garcia Dupont Novak Jones Keller Martin Rossi Schmidt Fischer Weber Becker Lefebvre Moreau Laurent
    Fernández López Sánchez Romero Torres Brown Taylor Wilson Walker Kowalski Nguyen Kim Patel Silva""".split()
TITLES = "Mr. Mrs. Ms. Dr. Prof. Mr Mrs Dr Sir".split()
ROADS = "Main High Garden Station Victor Mozart Lincoln Oak Church Mill Park Schiller Goethe Haupt Berg Pasteur Verdun Mayor Colón Bilbao".split()
ROAD_WORDS = "Street Road Avenue Lane Drive Court Way Terrace Square Boulevard".split()
WORDS = """report paper garden window answer morning water letter house was has went says writes calls met works gave took
    found sehr haben gehen Haus Zeit est a fait maison jour avec para casa tiene hoy muy with of from to and""".split()
CAPITALS = """The And Over Where Then This Nothing Outside Monday March London Berlin Paris Madrid Europe New York United Nations
    Central Bank English German French Spanish Company Section Table Figure Chapter In On It We They He She Der Die Das Es Un La Le Les El En""".split()
STEMS = "ar be con dan el far gor hin is jen kal lor mon nes or pin ral sten tor ul ver wen zor tion ing ch th é ß ñ ión eau".split()


def starter_sentences(copies: int = 12, seed: int = 7) -> list[list[tuple[str, str]]]:
    """Labelled sentences in four languages: each pattern several times over, half of the words from lists, half made up."""
    dice = random.Random(seed)
    made = lambda: "".join(dice.choice(STEMS) for _ in range(dice.randint(1, 4)))
    plain = lambda: made() if dice.random() < 0.6 else dice.choice(WORDS)
    digits = lambda n: "".join(dice.choice("0123456789") for _ in range(n))
    capital = lambda n: "".join(dice.choice("ABCDEFGHKLMNPRTXYZ") for _ in range(n))
    given = [w.capitalize() for w in CUES["given"]]
    make = {
        "G": lambda: dice.choice(given),
        "F": lambda: dice.choice(FAMILY) if dice.random() < 0.4 else made().capitalize(),
        "I": lambda: made().capitalize(),
        "T": lambda: dice.choice(TITLES),
        "R": lambda: dice.choice(ROADS) if dice.random() < 0.5 else made().capitalize(),
        "Rstraße": lambda: (dice.choice(ROADS) if dice.random() < 0.5 else made().capitalize()) + dice.choice(["straße", "strasse", "gasse"]),
        "K": lambda: dice.choice(ROAD_WORDS),
        "C": lambda: made().capitalize() if dice.random() < 0.6 else dice.choice(CAPITALS),
        "W": plain,
        "N": lambda: str(dice.randint(1, 240)) + ("" if dice.random() < 0.9 else dice.choice("AB")),
        "N.": lambda: capital(1) + ".",
        "P": lambda: dice.choice([capital(1) + digits(7), capital(2) + digits(6), capital(1) + digits(2) + capital(1) + digits(4) + capital(1), digits(8) + capital(1), digits(9)]),
        "S": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "X": lambda: digits(16),
        "Y": lambda: "+" + str(dice.randint(1, 49)),
        "Z": lambda: f"({digits(3)})",
        "V": lambda: f"{digits(3)}-{digits(4)}",
        "Q": lambda: ".".join(str(dice.randint(1, 255)) for _ in range(4)),
    }
    out = []
    for pattern in copies * PATTERNS + copies * PLAIN:
        sentence: list[tuple[str, str]] = []
        kind, begin = None, False
        for t in pattern.split():
            if t.startswith("["):
                kind, begin = t[1:], True
                continue
            close = t.endswith("]")
            t = t.rstrip("]")
            label = "O" if kind is None else ("B-" if begin else "I-") + kind
            begin = False
            if t in (".", ",") and sentence:  # punctuation belongs to the token before it
                sentence[-1] = (sentence[-1][0] + t, sentence[-1][1])
            else:
                sentence.append((make[t]() if t in make else t, label))
            if close:
                kind = None
        out.append(sentence)
    return out


def starter_labels(spark: SparkSession) -> DataFrame:
    """The small labelled table (sentence, position, token, label)."""
    rows = [(i, j, t, y) for i, s in enumerate(starter_sentences()) for j, (t, y) in enumerate(s)]
    return spark.createDataFrame(rows, "sentence int, position int, token string, label string")


def train_from(labelled: DataFrame) -> Field:
    """Field from a labelled table; more than TABLE rows are refused rather than cut."""
    rows = labelled.select("sentence", "position", "token", "label").limit(TABLE + 1).collect()
    if len(rows) > TABLE:
        raise ValueError(f"a labelled table has at most {TABLE} rows")
    rows = sorted(rows, key=lambda r: (r.sentence, r.position))
    return trained(tuple(tuple((r.token, r.label) for r in g) for _, g in itertools.groupby(rows, key=lambda r: r.sentence)))


@functools.lru_cache(maxsize=2)
def trained(sentences: tuple) -> Field:
    """The field of a table's sentences; the same table isn't learned twice by one driver."""
    return train([list(s) for s in sentences])


# ---- decoding --------------------------------------------------------------------------------------------------


class Decoder:
    """Labels of all tokens of many texts; distinct tokens are scored once."""

    def __init__(self, field: Field):
        self.field = field
        self.forget()

    def forget(self) -> None:
        """A token's class is its tuple of features; scores belong to classes."""
        self.token: dict[str, int] = {}
        self.kind: dict[tuple, int] = {}
        self.parts = np.zeros((0, len(OFFSETS), len(LABELS)), np.float32)
        self.ends = np.zeros(0, bool)

    def classes(self, tokens: list[str]) -> np.ndarray:
        if len(self.token) > KNOWN:
            self.forget()
        new_kinds = []
        for t in set(tokens).difference(self.token):
            f = (features(t), ends_sentence(t))
            k = self.kind.get(f)
            if k is None:
                k = self.kind[f] = len(self.kind)
                new_kinds.append(t)
            self.token[t] = k
        if new_kinds:
            self.parts = np.concatenate([self.parts, self.field.parts(new_kinds).astype(np.float32)])
            self.ends = np.append(self.ends, [ends_sentence(t) for t in new_kinds])
        return np.fromiter(map(self.token.__getitem__, tokens), np.int64, len(tokens))

    def labels(self, tokens: list[str], counts: list[int]) -> np.ndarray:
        """Label of each token; counts says how many tokens each text has."""
        c = self.classes(tokens)
        n = len(c)
        out = np.zeros(n, np.int8)
        if not n:
            return out
        begin = np.zeros(n, bool)
        text_start = np.cumsum(counts) - counts
        begin[text_start[text_start < n]] = True
        begin[1:] |= self.ends[c[:-1]]
        start = np.flatnonzero(begin)
        length = np.diff(np.append(start, n))
        order = np.argsort(length, kind="stable")
        lo = 0
        while lo < len(order):
            # sentences of like length together, as many as the bound on tokens allows
            hi = lo + max(1, min(TOKENS // int(length[order[lo]]), int(np.searchsorted(length[order], 1.3 * length[order[lo]] + 2, side="right")) - lo))
            rows = order[lo:hi]
            s, size = start[rows], length[rows]
            steps = int(size.max())
            at = s[:, None] + np.minimum(np.arange(steps), (size - 1)[:, None])
            inside = np.arange(steps) < size[:, None]
            scores = sentence_scores(self.parts, c[at], inside)
            got = self.field.best(scores, size)
            out[at[inside]] = got[inside]
            lo = hi
        return out


def field_spans(text: str, labels: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans of the labelled tokens of a text, without the punctuation around them."""
    out: list[list] = []
    for m, y in zip(re.finditer(r"\S+", text), labels.tolist()):
        if not y:
            continue
        word = m.group()
        if not word.strip(TRIM):
            continue
        a = m.start() + len(word) - len(word.lstrip(TRIM))
        b = m.end() - (len(word) - len(word.rstrip(TRIM)))
        kind = LABELS[y]
        if kind[0] == "I" and out and out[-1][0] == kind[2:]:
            out[-1][2] = max(b, out[-1][2])
        else:
            out.append([kind[2:], a, b])
    return [(k, a, b) for k, a, b in out if a < b]


def find_personal_data(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): personal data of each whole text; a narrow map over Arrow batches, no shuffle."""
    field = field or train_from(starter_labels(docs.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        decoder = Decoder(field)
        for b in batches:
            every = b.column("text").to_pylist()
            lo = 0
            while lo < len(every):
                hi, size = lo, 0
                while hi < len(every) and (hi == lo or size + len(every[hi]) <= 2 << 20):
                    size += len(every[hi])
                    hi += 1
                part = every[lo:hi]
                tokens = [t.split() for t in part]
                counts = [len(t) for t in tokens]
                labels = decoder.labels(list(itertools.chain.from_iterable(tokens)), counts)
                ends = np.cumsum(counts)
                found = []
                for text, a, z in zip(part, ends - counts, ends):
                    spans = base_spans(text)
                    own = labels[a:z]
                    if own.any():
                        extra = [x for x in field_spans(text, own) if not any(s <= x[1] and x[2] <= e for _, s, e in spans)]
                        spans = sorted(spans + extra, key=lambda x: (x[1], KINDS.index(x[0])))
                    found.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[lo:hi], pa.array(found, kind)], ["doc_id", "spans"])
                lo = hi

    rows = texts(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def personal_digest(found: DataFrame) -> DataFrame:
    """The contract's columns from find_personal_data's spans."""
    shown = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    count = lambda *k: F.size(F.filter("spans", lambda x: x["kind"].isin(*k))).cast("long")
    base = F.filter("spans", lambda x: x["kind"].isin(*KINDS[:4]))
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:4]),
        F.sha2(F.array_join(F.transform(base, shown), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", shown), ",").alias("spans"),
        count(*KINDS[4:]).alias("n_field"),
    )
