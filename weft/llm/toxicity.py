"""Toxicity by a subsequence string-kernel support vector machine with Nystrom landmarks.

Kernel: two words are as alike as their common three-letter subsequences, gaps allowed: a subsequence that spans s
letters weighs ``DECAY`` ** s, spans up to ``SPAN`` letters count, and the value is normalised by the self-kernels. Inserted
or skipped letters only cost weight; inserted marks and digits are dropped. Words of less than three letters have none.
A sentence is as alike to a landmark as its word that is most alike. Landmarks are words of the training sentences, half of
them those whose share in toxic and clean texts differs most and half by hash; the Nystrom map is k(x, landmarks) K^-1/2, and a
linear SVM (hinge loss) is trained on it.

Training is multiple-instance over sentences, as labels are of texts: every sentence of a clean text is clean, a toxic text
has some toxic sentence. A sentence's margin is that of its most toxic word. In every round all words of clean sentences are
negatives, and of each toxic text the sentences that the last machine ranks highest give their highest words as positives.
A logistic curve over the margins of a text's two highest sentences (the second if positive), fitted on the same rows, makes
the score. The fit runs in one task on the executors and returns the folded table.

A kernel value is linear in the explicit subsequence vector of the new word, so landmarks, Nystrom map and SVM fold into
one table of weights by subsequence: scoring is a gather and a sum for each distinct word of a batch.

Bounds: at most ``TRAIN_ROWS`` labelled texts of each class (smallest hash of the id first), ``LANDMARKS`` landmarks; all words of
the sampled texts are trained on.

Defined cases: null, empty and wordless texts score as no margin at all (below 0.5); null ids and labels are not trained
on; rows that repeat an id are trained on one by one; with one class only, every score is that class's share; words of any
length are read whole, in overlapping windows; if the input has a column with the score's name, the score's gets an
underscore in front.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, free_name, give_back, text_bytes
from .textscan import scan

DECAY = 0.6
SPAN = 6
TRAIN_ROWS = 2000
LANDMARKS = 256
ROUNDS = 3
_WINDOW = 24
_HOP = 12
_CODES = 1 << 18
_SLICE = 4096  # words whose subsequences are in memory at a time
_ROWS = 1024  # words in one matrix product
_MEMORY = 200_000  # words whose margin a worker remembers
#: Margins beyond these say no more; the lower one is also that of a text without words.
NO_WORD, TOP_MARGIN = -1.0, 1.5


def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index triples of a word of n letters with a span of SPAN at most, and their weights."""
    at = [t for t in combinations(range(n), 3) if t[2] - t[0] < SPAN]
    return np.array(at, np.int64).reshape(-1, 3), np.array([DECAY ** (t[2] - t[0] + 1) for t in at])


_TRIPLES = [_triples(n) for n in range(_WINDOW + 1)]


def clean(word: str) -> str:
    """Lower-case letters of a word; what is between them or around them (digits, marks) goes."""
    w = word.lower()
    if not w.isalpha():
        w = "".join(filter(str.isalpha, w))
    return w if len(w) >= 3 or len(w) == 1 else ""


def windows(word: str) -> list[str]:
    """The word between two boundary marks, or its overlapping windows."""
    word = f"^{word}$"
    if len(word) <= _WINDOW:
        return [word]
    return [word[i : i + _WINDOW] for i in range(0, len(word) - _HOP, _HOP)]


def vectors(words: list[str]):
    """(row, code, weight) of the subsequences of every word, and the square root of each word's self-kernel.

    Rows of a word that has fewer than three letters hold nothing. Codes are 18-bit hashes of the three letters.
    """
    rows, codes, weights = [], [], []
    norm = np.ones(len(words))
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if len(w) >= 3:
            by.setdefault(len(w), []).append(i)
    for n, index in by.items():
        at, weight = _TRIPLES[n]
        letters = np.frombuffer("".join(words[i] for i in index).encode("utf-32-le"), np.uint32).reshape(-1, n).astype(np.int64)
        code = letters[:, at[:, 0]] * 40503 + letters[:, at[:, 1]] * 10007 + letters[:, at[:, 2]] * 97
        code = (code ^ (code >> 18) * 31) & (_CODES - 1)
        order = np.argsort(code, axis=1, kind="stable")
        code = np.take_along_axis(code, order, axis=1)
        w = weight[order]
        opens = np.ones(code.shape, bool)
        opens[:, 1:] = code[:, 1:] != code[:, :-1]
        first = np.flatnonzero(opens.ravel())
        sums = np.add.reduceat(w.ravel(), first)
        r = np.repeat(np.arange(len(index)), code.shape[1])[first]
        norm[index] = np.sqrt(np.bincount(r, weights=sums * sums, minlength=len(index)))
        rows.append(np.array(index)[r])
        codes.append(code.ravel()[first])
        weights.append(sums)
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return cat(rows, np.int64), cat(codes, np.int64), cat(weights, float), norm


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel values (words x landmarks)."""
    lr, lc, lw, ln = vectors(landmarks)
    used, column = np.unique(lc, return_inverse=True)
    dense = np.zeros((len(used), len(landmarks)))
    dense[column, lr] = lw / ln[lr]
    where = np.full(_CODES, -1)
    where[used] = np.arange(len(used))
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for at in range(0, len(words), _ROWS):
        r, c, w, n = vectors(words[at : at + _ROWS])
        hit = where[c] >= 0
        r, c, w = r[hit], where[c[hit]], w[hit] / n[r[hit]]
        part = np.zeros((min(_ROWS, len(words) - at), len(used)))
        part[r, c] = w  # a word has each code once
        out[at : at + _ROWS] = part @ dense
    return out


@dataclass
class Machine:
    """The folded machine: weight by subsequence code, bias, and the logistic curve over (best, second) margins."""

    table: np.ndarray
    bias: float
    curve: tuple[float, float, float]
    constant: float | None = None

    def margins(self, words: list[str]) -> np.ndarray:
        """Margin of each cleaned word; a long word has its best window's."""
        out = [self._margins(words[at : at + _SLICE]) for at in range(0, len(words), _SLICE)]
        return np.clip(np.concatenate(out), NO_WORD, TOP_MARGIN) if out else np.zeros(0)

    def _margins(self, words: list[str]) -> np.ndarray:
        parts = [windows(w) for w in words]
        flat = [p for ps in parts for p in ps]
        r, c, w, n = vectors(flat)
        out = np.bincount(r, weights=self.table[c] * w, minlength=len(flat)) / n + self.bias
        if len(flat) > len(words):
            out = np.maximum.reduceat(out, np.cumsum([0, *map(len, parts[:-1])]))
        return out

    def probability(self, best: np.ndarray, second: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(best), self.constant)
        a, b, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a * best + b * np.maximum(0, second) + c, -35, 35)))


_WORDS = re.compile(WORD)
_ENDS, _QUOTES = ".!?", "\"')]"


def sentences(text: str | None) -> list[list[str]]:
    """Distinct cleaned words of each sentence of a text; words that are spelled out (``i d i o t``) are sentences of their own.

    A sentence ends at a line's end, or with a word that ends in a full stop, exclamation or question mark (and one quote).
    """
    out: list[list[str]] = []
    for line in (text or "").split("\n"):
        raw = _WORDS.findall(line)
        at = 0
        for i, w in enumerate(raw):
            if i + 1 == len(raw) or w[-1] in _ENDS or (w[-1] in _QUOTES and len(w) > 1 and w[-2] in _ENDS):
                out.append(sorted({c for x in raw[at : i + 1] if len(c := clean(x)) >= 3}))
                at = i + 1
    out += [[w] for w in spelled(_WORDS.findall(text or ""))]
    return [x for x in out if x]


def spelled(raw: list[str]) -> list[str]:
    out, run = [], []
    for w in [*raw, ".."]:
        if len(c := clean(w)) == 1:
            run.append(c)
        else:
            if len(run) >= 3:
                out.append("".join(run))
            run = []
    return out


def _svm(x: np.ndarray, positive: np.ndarray, negative: np.ndarray, penalty: float = 1e-5, steps: int = 160) -> tuple[np.ndarray, float]:
    """Weighted linear SVM with squared hinge loss, by accelerated gradient descent with a fixed number of steps.

    ``positive`` and ``negative`` are a row's weights as an example of either class; ``x`` is never copied.
    """
    weight = positive + negative
    n = weight.sum()
    gram = np.zeros((x.shape[1] + 1, x.shape[1] + 1))
    for a in range(0, len(x), _SLICE):
        part, w = x[a : a + _SLICE], weight[a : a + _SLICE] / n
        gram[:-1, :-1] += (part * w[:, None]).T @ part
        gram[-1, :-1] += w @ part
    gram[:-1, -1] = gram[-1, :-1]
    gram[-1, -1] = 1
    top = np.linalg.eigvalsh(gram)[-1] * 2 + penalty
    positive, negative = (positive / n).astype(x.dtype), (negative / n).astype(x.dtype)
    w = v = np.zeros(x.shape[1] + 1, x.dtype)
    t = 1.0
    for _ in range(steps):
        margin = x @ v[:-1] + v[-1]
        pull = positive * np.maximum(0, 1 - margin) - negative * np.maximum(0, 1 + margin)
        grad = -2 * np.append(pull @ x, pull.sum()) + penalty * np.append(v[:-1], 0)
        new = (v - grad / top).astype(x.dtype)
        s = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v = (new + (t - 1) / s * (new - w)).astype(x.dtype)
        w, t = new, s
    return w[:-1], w[-1]


def _curve(best: np.ndarray, second: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Weighted logistic regression by Newton steps, slightly damped towards zero."""
    z = np.stack([best, np.maximum(0, second), np.ones(len(best))], axis=1)
    w = np.zeros(3)
    damp = np.diag([2e-4, 2e-4, 0]) * len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        h = (z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + damp
        w = w - np.linalg.solve(h, z.T @ (weight * (p - y)) + damp @ w)
    return tuple(w)


def _hash_order(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace"))


def fit(texts: list[list[list[str]]], toxic: list[int], share: float | None = None) -> Machine:
    """Train on the distinct words of labelled texts (lists of sentences); ``share``: of toxic texts where the score is to be used."""
    y = np.array(toxic, float)
    if not len(y) or y.min() == y.max():
        return Machine(np.zeros(_CODES), 0.0, (0, 0, 0), float(y.mean()) if len(y) else 0.0)
    seen: tuple[dict[str, int], dict[str, int]] = {}, {}  # clean and toxic texts with the word
    for text, label in zip(texts, toxic):
        count = seen[int(label)]
        for p in {p for sentence in text for w in sentence for p in windows(w)}:
            count[p] = count.get(p, 0) + 1
    words = sorted(w for w in {*seen[0], *seen[1]} if len(w) > 3)
    n1 = y.sum()
    n0 = len(y) - n1
    neg, pos = (np.array([c.get(w, 0) for w in words], float) for c in seen)
    del seen
    # how far the shares of toxic and clean texts that hold the word are apart, in standard errors
    held = (pos + neg) / len(y)
    z = (pos / n1 - neg / n0) / np.sqrt(held * (1 - held) * (1 / n1 + 1 / n0) + 1e-9)
    apart = np.argsort(-z, kind="stable")[: LANDMARKS // 2].tolist()
    spread = sorted(range(len(words)), key=lambda i: _hash_order(words[i]))
    marks = [words[i] for i in list(dict.fromkeys([*apart, *spread]))[:LANDMARKS]]
    index = {w: i for i, w in enumerate(words)}
    k_mm = kernel(marks, marks)
    value, vector = np.linalg.eigh(k_mm)
    good = value > 1e-6 * value[-1]
    root = vector[:, good] / np.sqrt(value[good])
    root = root.astype(np.float32)
    phi = np.empty((len(words), root.shape[1]), np.float32)
    for at in range(0, len(words), _SLICE):
        phi[at : at + _SLICE] = kernel(words[at : at + _SLICE], marks) @ root
    # of toxic texts, the sentences' words that toxic texts hold more often than clean ones, whatever the sizes of the classes
    lean = pos / n1 > neg / n0
    index = {w: i for w, i in index.items() if lean[i]}
    found = [[np.array([index[p] for w in x for p in windows(w) if p in index], np.int64) for x in t] for t, label in zip(texts, toxic) if label]
    bags = [[s for s in bag if len(s)] for bag in found]
    margin = z
    for _ in range(ROUNDS):
        witness = np.zeros(len(words))
        for bag in bags:
            if bag:
                tops = np.array([margin[s].max() for s in bag])
                highest = tops.max()
                near = max(highest * 0.9, highest - 0.25) if highest > 0 else highest
                chosen = np.concatenate([s[margin[s] >= near] for s, top in zip(bag, tops) if top >= near])
                np.add.at(witness, chosen, 1 / len(chosen))
        against = neg**0.75
        w, bias = _svm(phi, witness * against.sum() / max(1.0, witness.sum()) * 0.5, against)
        margin = phi @ w + bias
    lr, lc, lw, ln = vectors(marks)
    table = np.zeros(_CODES)
    np.add.at(table, lc, lw / ln[lr] * (root @ w)[lr])
    machine = Machine(table, float(bias), (1.0, 0.0, 0.0))
    every = sorted({w for t in texts for x in t for w in x})
    of = dict(zip(every, machine.margins(every))) if every else {}
    top = [_top_two(np.array([max(of[w] for w in x) for x in t])) for t in texts]
    best, second = (np.array(x) for x in zip(*top))
    # the sample may hold the classes in other shares than the labelled table
    share = y.mean() if share is None else share
    machine.curve = _curve(best, second, y, np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())))
    return machine


def _top_two(m: np.ndarray) -> tuple[float, float]:
    if not len(m):
        return NO_WORD, NO_WORD
    if len(m) == 1:
        return float(m[0]), NO_WORD
    a = np.partition(m, len(m) - 2)[-2:]
    return float(a[1]), float(a[0])


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS) -> Machine:
    """A machine from documents that have a label (0 or 1); ``labels``: id and label, at most ``rows`` of each class."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(label).cast("int").alias("y")).distinct()
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    some = [known.where(F.col("y") == v).orderBy(F.xxhash64("id"), "id").limit(rows) for v in (0, 1)]
    found = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(some[0].union(some[1])), "id")

    share = sizes.get(1, 0) / max(1, sum(sizes.values()))

    def split(batches):
        for b in batches:
            texts = ["\n".join(map(" ".join, sentences(t))) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array(texts, pa.string())], ["id", "y", "words"])

    def learn(batches):
        pool: dict[str, str] = {}  # each word is held once
        rows = []
        for b in batches:
            for i, y, t in zip(*(b.column(c).to_pylist() for c in ("id", "y", "words"))):
                rows.append((i, y, [[pool.setdefault(w, w) for w in x.split(" ")] for x in t.split("\n")] if t else []))
        del pool
        rows.sort()
        m = fit([r[2] for r in rows], [r[1] for r in rows], share)
        del rows
        give_back()
        values = (m.table.tobytes(), m.bias, list(map(float, m.curve)), m.constant)
        types = (pa.binary(), pa.float64(), pa.list_(pa.float64()), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], ["weights", "bias", "curve", "constant"])

    split_rows = found.select("id", "y", text_bytes(F.col("text")).alias("text")).mapInArrow(split, "id long, y int, words string")
    # bounded by the sample: one task can hold it, and a lost one is run again
    got = split_rows.repartition(1).mapInArrow(learn, "weights binary, bias double, curve array<double>, constant double").first()
    if got is None:
        return fit([], [])
    return Machine(np.frombuffer(bytes(got["weights"])), got["bias"], tuple(got["curve"]), got["constant"])


def _two_best(w, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Margins of the two highest sentences of each text of a run, from those of its words."""
    ends = np.isin(w.data[w.end - 1], [ord(c) for c in _ENDS])
    before = np.where(w.end - w.start > 1, w.data[w.end - 2], 0)
    ends |= np.isin(w.data[w.end - 1], [ord(c) for c in _QUOTES]) & np.isin(before, [ord(c) for c in _ENDS])
    lines = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(w.data == 0x0A, out=lines[1:])
    opens = np.ones(len(w.start), bool)
    opens[1:] = ends[:-1] | (w.doc[1:] != w.doc[:-1]) | (lines[w.start[1:]] != lines[w.end[:-1]])
    first = np.flatnonzero(opens)
    top, doc = np.maximum.reduceat(margins, first), w.doc[first]
    order = np.lexsort((-top, doc))
    top, doc = top[order], doc[order]
    best, second = np.full(w.n_docs, NO_WORD), np.full(w.n_docs, NO_WORD)
    head = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    best[doc[head]] = top[head]
    next_ = head[np.append(np.diff(head), len(doc) - head[-1]) > 1] + 1
    second[doc[next_]] = top[next_]
    return best, second


class Scorer:
    """Scores Arrow text columns; remembers margins of words between batches."""

    def __init__(self, machine: Machine):
        self.machine, self.known = machine, {}

    def __call__(self, column: pa.Array) -> np.ndarray:
        column = pc.utf8_lower(column.fill_null("") if column.null_count else column)
        out = np.zeros(len(column))
        for w in scan(column):
            out[w.first : w.first + w.n_docs] = self._score(w)
        return out

    def _score(self, w) -> np.ndarray:
        best, second = np.full(w.n_docs, NO_WORD), np.full(w.n_docs, NO_WORD)
        if len(w.hash):
            keys, where, back = np.unique(w.hash, return_index=True, return_inverse=True)
            best, second = _two_best(w, self._margins(keys, where, w)[back])
            for i, m in self._spelled(w):
                second[i] = max(second[i], min(best[i], m))
                best[i] = max(best[i], m)
        return self.machine.probability(best, second)

    def _margins(self, keys: np.ndarray, at: np.ndarray, w) -> np.ndarray:
        known = self.known
        if len(known) > _MEMORY:
            known.clear()
        get = known.get
        out = np.array([get(k, np.nan) for k in keys.tolist()])
        new = np.flatnonzero(np.isnan(out))
        if len(new):
            raw = w.data.tobytes()
            words = [clean(raw[w.start[i] : w.end[i]].decode("utf-8", "replace")) for i in at[new]]
            full = [j for j, x in enumerate(words) if len(x) >= 3]
            m = np.full(len(words), NO_WORD)
            if full:
                m[full] = self.machine.margins([words[j] for j in full])
            out[new] = m
            known.update(zip(keys[new].tolist(), m.tolist()))
        return out

    def _spelled(self, w):
        """Margins of words that are spelled with spaces between the letters."""
        short = (w.end - w.start) <= 4
        if len(short) < 3:
            return
        run = short[:-2] & short[1:-1] & short[2:] & (w.doc[:-2] == w.doc[2:])
        for i in np.unique(w.doc[:-2][run]):
            raw = w.data[w.offsets[i] : w.offsets[i + 1]].tobytes().split()  # bytes.split() knows the six white-space characters
            for m in self.machine.margins(spelled([x.decode("utf-8", "replace") for x in raw])).tolist():
                yield i, m


def score(docs: DataFrame, machine: Machine, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with the probability that a text is toxic."""
    column = free_name(docs.columns, column)
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    state: dict = {}

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        scorer = state.get("scorer")
        if scorer is None:
            scorer = state["scorer"] = Scorer(shared.value)
        return pd.Series(scorer(pa.array(texts, pa.string(), from_pandas=True)))

    return docs.withColumn(column, run(F.col(text)))
