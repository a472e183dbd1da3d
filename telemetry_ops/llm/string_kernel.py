"""Toxicity by a support vector machine on a gappy subsequence kernel with Nystroem landmarks, taught by labelled sentences.

A sentence is a run of words up to a sentence mark or a line end. The machine sees it as a bag of spans: each of its
words, each ``SPAN`` words in a row, and the whole of it. The kernel of two spans sums, over all subsequences of three
characters with up to two gaps that touch at most two neighbouring words, products of ``DECAY ** gaps`` in both,
over the roots of both spans' own sums of squared decays; an insult with gaps or inserted characters
keeps most of its subsequences. Features of a span are its kernels with landmark spans of labelled sentences times the
inverse root of the landmarks' own kernel matrix. Labels belong to texts, so that the machine learns by multiple
instances: each toxic text gives its most telling span, other texts give those that the machine before holds for worst,
and a text counts by its worst span. Since the machine is linear in the kernels, a margin is a sum of one learnt weight
per subsequence, looked up in a table for all characters of many texts at once.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetry_ops.functions.session import broadcast_if_small
from telemetry_ops.llm.text import column, fold, slices, small_batches, tidy

DECAY = 0.6
#: Characters of one kernel window; three of them, the first included, form a subsequence.
REACH = 5
PATTERNS = [(a, b) for a, b in combinations(range(1, REACH), 2)]
WEIGHTS = [DECAY ** (b - 2) for _, b in PATTERNS]
ALPHABET = 64
#: Character classes beyond letters, digits and other characters: the edge of a word, a line end, a sentence mark.
EDGE, LINE, MARK = 61, 62, 63
SENTENCE_MARKS = ".!?…。！？"
#: Characters of a word that count as one; longer words are cut, and spans of several words see across the cuts.
LONGEST = 48
#: Words of the middle kind of span.
SPAN = 3
#: Labelled texts that spans are learnt from, at most: toxic and other ones, chosen by a hash, none longer than so many characters.
TOXIC_TEXTS, OTHER_TEXTS, TEXT_CHARS = 1500, 2500, 20_000
#: Spans at most that become landmarks, and training instances of either kind.
LANDMARKS, INSTANCES = 384, 4000
#: Rounds of training; each adds the spans of other texts that the machine before holds for worst.
ROUNDS = 5
#: Different neighbours in toxic texts that a telling span needs (copies have the same), and how many times its share
#: of toxic texts is that of other texts.
SUPPORT, RATIO = 6, 20.0
#: Folds; fold ``HELD`` is never learnt from.
FOLDS, HELD = 4, 2
THRESHOLD = 0.3
#: Margin of a text without words.
NO_WORDS = -3.0
#: Bytes of text whose characters are looked up together, small enough for a processor's cache.
SLICE = 1 << 18

SCORED = "doc_id long, held_out boolean, score double, predicted int, worst string"

_CLASS = np.zeros(0x110000, np.uint8)
_ALNUM = np.zeros(0x110000, bool)


def letter(code: int) -> int:
    """1 to 26 for Latin letters without their marks, 27 to 36 for digits, 61 to 63 for spaces, line ends and sentence marks,
    else one of the other classes."""
    c = chr(code)
    if c in "\n\r":
        return LINE
    if c.isspace():
        return EDGE
    if c in SENTENCE_MARKS:
        return MARK
    c = unicodedata.normalize("NFKD", c.lower())[0]
    if "a" <= c <= "z":
        return ord(c) - 96
    if "0" <= c <= "9":
        return ord(c) - 21
    return 37 + ord(c) % 24


def _classes(codes: np.ndarray) -> np.ndarray:
    found = _CLASS[codes]
    if not found.all():
        for c in np.unique(codes[found == 0]).tolist():
            _CLASS[c], _ALNUM[c] = letter(c), chr(c).isalnum()
        found = _CLASS[codes]
    return found


class Layout:
    """Words of many texts in one row: where they lie, whose they are and which sentence they belong to."""

    def __init__(self, texts: list[str]):
        self.whole = "\n" + "\n".join(texts) + "\n"
        raw = np.frombuffer(self.whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _classes(raw)
        space = (kind == EDGE) | (kind == LINE)
        inside = ~space
        first = np.flatnonzero(inside[1:] & space[:-1]) + 1
        last = np.flatnonzero(inside[:-1] & space[1:])
        ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
        text = np.searchsorted(ends, first - 1, "right")
        lines = np.cumsum(kind == LINE, dtype=np.int32)
        closes = np.ones(len(first), bool)
        closes[:-1] = (kind[last[:-1]] == MARK) | (lines[first[1:] - 1] > lines[last[:-1]])
        # One edge before each word and one behind the last.
        keep = inside.copy()
        keep[first - 1] = True
        self.codes = np.append(np.where(inside, kind, EDGE)[keep], EDGE).astype(np.int32)
        begin = np.cumsum(keep, dtype=np.int32)[first - 1].astype(np.int64) - 1 if len(first) else np.zeros(0, np.int64)
        size = last - first + 1
        if (size > LONGEST).any():
            n = -(-size // LONGEST)
            of = np.repeat(np.arange(len(first)), n)
            part = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            begin = begin[of] + part * LONGEST + (part > 0)
            closes = closes[of] & (part == n[of] - 1)
            text, last = text[of], np.minimum(first[of] + (part + 1) * LONGEST - 1, last[of])
            first = first[of] + part * LONGEST
        self.raw, self.kind, self.begin, self.first, self.last, self.text, self.closes = raw, kind, begin, first, last, text, closes
        self.words, self.texts = len(begin), len(texts)

    def string(self, a: int, b: int) -> str:
        """Words ``a`` to ``b``, as they are written."""
        return self.whole[self.first[a] : self.last[b] + 1]

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """Characters of each word with the edge before it, and of the next word of its sentence (0: none)."""
        size = np.diff(np.append(self.begin, len(self.codes) - 1))
        return size, np.where(self.closes, 0, np.append(size[1:], 0))

    def reach(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each character, the distance to the end of its word and to that of the next word of its sentence,
        both at most ``REACH``."""
        n = len(self.codes) - 1
        near = np.full(n, REACH, np.int8)
        size, after = self.sizes()
        far = near.copy()
        stop = self.begin + size
        for d in range(1, REACH):
            some = size >= d
            at = stop[some] - d
            near[at] = d
            far[at] = np.minimum(after[some] + d, REACH)
        return near, far

    def spans(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """First and last words of the spans of each kind: words, ``SPAN`` words, other whole sentences."""
        every = np.arange(self.words)
        yield every, every
        sentence = np.cumsum(self.closes) - self.closes
        a = every[: max(0, self.words - SPAN + 1)]
        a = a[sentence[a] == sentence[a + SPAN - 1]]
        yield a, a + SPAN - 1
        last = np.flatnonzero(self.closes)
        begin = np.append(0, last[:-1] + 1) if len(last) else last
        size = last - begin + 1
        some = (size > 1) & (size != SPAN)
        yield begin[some], last[some]

    def disguised(self) -> list[tuple[int, str]]:
        """Text and letters of words with other characters inside, as ``b-a-d``, and of single characters in a row, as ``b a d``."""
        out = []
        if not self.words:
            return out
        alnum = _ALNUM[self.raw]
        before = np.cumsum(alnum, dtype=np.int32)
        marked = np.flatnonzero(~alnum[:-1] & alnum[1:] & (self.kind[:-1] != EDGE) & (self.kind[:-1] != LINE))
        if len(marked):
            word = np.searchsorted(self.first, marked, "right") - 1
            for k in np.unique(word[before[marked] > before[self.first[word] - 1]]).tolist():
                out.append((int(self.text[k]), "".join(filter(str.isalnum, self.string(k, k)))))
        single = np.append(self.first == self.last, False)
        edge = np.diff(single.astype(np.int8), prepend=0)
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            if b - a > 2:
                runs = np.split(np.arange(a, b), np.flatnonzero(np.diff(self.text[a:b])) + 1)
                out += [(int(self.text[r[0]]), "".join(self.whole[self.first[i]] for i in r.tolist())) for r in runs if len(r) > 2]
        return out


#: Sum of squared decays of the subsequences that begin within so many characters of an end.
_SQUARES = np.cumsum([sum(w * w for (_, b), w in zip(PATTERNS, WEIGHTS) if b <= d) for d in range(2 * LONGEST + 3)])


def _squares(laid: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Per word, sums of squared decays of the subsequences inside it, and of those that end in the next word."""
    size, after = laid.sizes()
    inside = _SQUARES[size]
    return inside, np.where(after > 0, _SQUARES[size + after] - _SQUARES[after] - inside, 0.0)


def subsequences(spans: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, code and weight of each subsequence, equal codes of one span summed, the span's weights divided by its norm."""
    laid = Layout(spans)
    n = len(laid.codes) - 1
    near, far = laid.reach()
    owner = np.repeat(laid.text, np.diff(np.append(laid.begin, n))).astype(np.int64)
    keys, weights = [np.zeros(0, np.int64)], [np.zeros(0)]
    c = laid.codes.astype(np.int64)
    for (a, b), weight in zip(PATTERNS, WEIGHTS):
        at = np.flatnonzero(far >= b)
        keys.append(((owner[at] * ALPHABET + c[at]) * ALPHABET + c[at + a]) * ALPHABET + c[at + b])
        weights.append(np.full(len(at), weight))
    squares = np.bincount(laid.text, weights=sum(_squares(laid)), minlength=len(spans))
    unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate(weights), minlength=len(unique))
    own = unique // ALPHABET**3
    return own, unique % ALPHABET**3, total / np.sqrt(np.maximum(squares, 1e-12))[own]


def kernel(spans: list[str], landmarks: list[str]) -> np.ndarray:
    lo, lc, lw = subsequences(landmarks)
    codes, at = np.unique(lc, return_inverse=True)
    table = np.zeros((len(codes), len(landmarks)))
    table[at, lo] = lw
    out = np.zeros((len(spans), len(landmarks)))
    for i in range(0, len(spans), 256):
        part = spans[i : i + 256]
        wo, wc, ww = subsequences(part)
        place = np.minimum(np.searchsorted(codes, wc), len(codes) - 1)
        hit = codes[place] == wc
        np.add.at(out, i + wo[hit], table[place[hit]] * ww[hit][:, None])
    return out


@dataclass
class Machine:
    """Learnt weight per subsequence code, bias, and the sigmoid of margins."""

    table: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def spans(self, laid: Layout) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """First word, last word and margin of the spans of each kind."""
        if not laid.words:
            return
        near, far = laid.reach()
        c, n = laid.codes, len(laid.codes) - 1
        high, middle = c << 12, c << 6
        tables = {b: self.table * np.float32(DECAY ** (b - 2)) for b in range(2, REACH)}
        within, both = np.zeros(n, np.float32), np.zeros(n, np.float32)
        for a, b in PATTERNS:
            m = max(0, n + 1 - b)
            at = high[:m] | middle[a : a + m]
            at |= c[b : b + m]
            gain = tables[b].take(at)
            within[:m] += gain * (near[:m] >= b)
            both[:m] += gain * (far[:m] >= b)
        inner = np.add.reduceat(within, laid.begin)
        inside, across = _squares(laid)
        sums = [np.append(0.0, np.cumsum(v, dtype=np.float64)) for v in (inner, np.add.reduceat(both, laid.begin) - inner, inside, across)]
        for first, last in laid.spans():
            gain = sums[0][last + 1] - sums[0][first] + sums[1][last] - sums[1][first]
            size = sums[2][last + 1] - sums[2][first] + sums[3][last] - sums[3][first]
            yield first, last, gain / np.sqrt(np.maximum(size, 1e-12)) + self.bias

    def worst(self, texts: list[str]) -> tuple[np.ndarray, list[str | None]]:
        """Margin and words of the worst span of each text, disguised words among them."""
        laid = Layout(texts)
        margin, found = np.full(len(texts), -np.inf), [None] * len(texts)
        hidden = laid.disguised()
        other = Layout([s for _, s in hidden])
        owner = np.array([t for t, _ in hidden], np.int64)
        for of, whose in ((laid, laid.text), (other, owner[other.text] if hidden else other.text)):
            for first, last, value in self.spans(of):
                if not len(first):
                    continue
                text = whose[first]
                top = np.full(len(texts), -np.inf)
                np.maximum.at(top, text, value)
                better = top > margin
                at = np.flatnonzero(better[text] & (value == top[text]))
                for i, t in zip(at[::-1].tolist(), text[at[::-1]].tolist()):  # the first one of equal margins
                    found[t] = (of, int(first[i]), int(last[i]))
                margin = np.maximum(margin, top)
        return np.where(np.isinf(margin), NO_WORDS, margin), [f and f[0].string(f[1], f[2]) for f in found]

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def train(positive: dict[str, float], negative: dict[str, float]) -> Machine:
    """Fit on weighted spans; without spans of both kinds every text gets the same low score."""
    if not positive or not negative:
        return Machine(np.zeros(ALPHABET**3, np.float32), -1.0, 1.0, -2.0)
    spans = [*positive, *negative]
    marks = list(dict.fromkeys([*list(positive)[: LANDMARKS // 2], *list(negative)[: LANDMARKS // 2]]))
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    use = values > 1e-6 * values.max()
    root = vectors[:, use] / np.sqrt(values[use])  # Nystroem map: kernel with the landmarks, times this
    x = kernel(spans, marks) @ root
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    mass = np.r_[list(positive.values()), list(negative.values())]
    mass = np.where(y > 0, mass / mass[y > 0].sum(), mass / mass[y < 0].sum())
    w, b = np.zeros(x.shape[1]), 0.0
    v, vb = w, b
    ridge = 1e-5
    rate = 0.9 / max(1.0, np.linalg.eigvalsh(x.T @ (x * mass[:, None])).max() + 2.0)
    for step in range(1500):  # squared hinge loss, accelerated gradient descent
        # Products this small are slower where a library splits them over threads.
        slack = np.maximum(0, 1 - y * (np.einsum("ij,j->i", x, v) + vb))
        nw, nb = v - rate * (ridge * v - np.einsum("ij,i->j", x, mass * y * slack)), vb + rate * (mass * y * slack).sum()
        k = step / (step + 3)
        v, vb = nw + k * (nw - w), nb + k * (nb - b)
        w, b = nw, nb
    lo, lc, lw = subsequences(marks)
    table = np.bincount(lc, weights=lw * (root @ w)[lo], minlength=ALPHABET**3)
    return Machine(table.astype(np.float32), float(b))


def _telling(toxic: list[str], other: list[str]) -> list[list[tuple[float, str]]]:
    """Per toxic text, its telling spans with their evidence, best first; spans are lower-cased.

    Neighbours are counted instead of texts where there are fewer of them, so that copies tell nothing.
    """
    def spans(text: str) -> Iterator[tuple[str, tuple[str, str]]]:
        laid = Layout([text.lower()])
        words = ["", *(laid.string(i, i) for i in range(laid.words)), ""]
        for first, last in laid.spans():
            for a, b in zip(first.tolist(), last.tolist()):
                yield laid.string(a, b), (words[a], words[b + 2])
        for _, s in laid.disguised():
            yield s, ("", "")

    # Most spans are those of one text: hashes tell which recur before any is kept.
    hashes = [np.array(list({hash(s) for s, _ in spans(t)}), np.int64) for t in toxic]
    known, count = np.unique(np.concatenate([np.zeros(0, np.int64), *hashes]), return_counts=True)
    recur = set(known[count >= SUPPORT].tolist())
    held = [{s: c for s, c in spans(t) if hash(s) in recur} for t in toxic]
    texts, near = Counter(s for h in held for s in h), defaultdict(set)
    for h in held:
        for s, context in h.items():
            if texts[s] >= SUPPORT:
                near[s].add(context)
    rest: Counter[str] = Counter()
    for t in other:
        rest.update({s for s, _ in spans(t) if s in near})
    value = {}
    for s, contexts in near.items():
        own, others = (texts[s] + 0.5) / (len(toxic) + 1), (rest[s] + 0.5) / (len(other) + 1)
        if len(contexts) >= SUPPORT and own >= RATIO * others:
            value[s] = len(contexts) * math.log(own / others)
    return [sorted(((value[s], s) for s in h if s in value), key=lambda v: (-v[0], v[1])) for h in held]


def _calibrated(m: Machine, margin: np.ndarray, toxic: np.ndarray, count: np.ndarray) -> Machine:
    """Sigmoid of the worst margin, fitted by Newton steps with slightly smoothed targets."""
    if not len(margin) or toxic.sum() == 0 or toxic.sum() == count.sum():
        return m
    t = (toxic + 0.01 * count) / (1.02 * count)
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([(count * (p - t) * margin).sum() + 1e-3 * a, (count * (p - t)).sum()])
        s = count * np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(s * margin**2).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
    return replace(m, slope=float(a), shift=float(b)) if a > 0 else m


def _worst(machine: Machine, extra: tuple[str, ...]):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", SLICE):
                margin, worst = machine.worst([(t or b"").decode("utf-8", "replace") for t in column(piece, "text")])
                yield pa.record_batch(
                    [*(piece.column(piece.schema.get_field_index(c)) for c in extra), pa.array(margin, pa.float64()), pa.array(worst, pa.string())],
                    [*extra, "margin", "worst"],
                )

    return run


def fit(docs: DataFrame, labels: DataFrame) -> Machine:
    """Learn from labelled documents outside the held fold.

    The driver gets a bounded sample of them, equal texts once, and the worst spans of other documents, which each round
    looks for in all of them.
    """
    marked = labels.where("toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marked = broadcast_if_small(marked, marked.count(), 16)
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    learn = rows.where(fold(F.col("doc_id"), FOLDS) != HELD).join(marked, "doc_id").select("text", "toxic")
    short = learn.where(f"text is not null and octet_length(text) <= {TEXT_CHARS}").withColumn("h", F.xxhash64("text"))
    taken = [
        short.where(f"toxic = {k}").groupBy("h").agg(F.first("text").alias("text")).orderBy("h").limit(n).toPandas()["text"]
        for k, n in ((1, TOXIC_TEXTS), (0, OTHER_TEXTS))
    ]
    toxic, other = ([bytes(t).decode("utf-8", "replace") for t in texts] for texts in taken)
    telling = _telling(toxic, other)
    chosen = Counter(t[0][1] for t in telling if t)
    positive = {s: math.sqrt(n) for s, n in chosen.most_common(INSTANCES)}
    plain: Counter[str] = Counter()
    for text in other[: INSTANCES // 8]:
        laid = Layout([text.lower()])
        for (first, last), n in zip(laid.spans(), (24, 8, 2)):
            plain.update(laid.string(int(first[i]), int(last[i])) for i in np.linspace(0, len(first) - 1, min(n, len(first))).astype(int))
    negative = {s: math.sqrt(n) for s, n in plain.most_common(INSTANCES) if s not in positive}
    machine = train(positive, negative)
    for _ in range(ROUNDS - 1 if positive else 0):
        scored = learn.where("toxic = 0").select("text").mapInArrow(_worst(machine, ()), "margin double, worst string").where("worst is not null")
        hard = scored.groupBy(F.lower("worst").alias("worst")).agg(F.max("margin").alias("margin"), F.count("*").alias("n"))
        hard = hard.orderBy(F.desc("margin"), "worst").limit(INSTANCES // 8).toPandas()
        # Hard spans first: the first ones are landmarks.
        found = {s: math.sqrt(n) for s, n in zip(hard["worst"], hard["n"]) if s not in positive}
        negative = found | {s: n for s, n in negative.items() if s not in found}
        # A toxic text without a telling span gives its worst one, if the machine is sure of it.
        silent = [t for t, known in zip(toxic, telling) if not known]
        margin, worst = machine.worst(silent)
        more = Counter(w.lower() for m, w in zip(margin, worst) if w and m > 0.5 and w.lower() not in negative)
        machine = train(positive | {s: math.sqrt(n) for s, n in more.most_common(INSTANCES // 4) if s not in positive}, negative)
    worst = learn.mapInArrow(_worst(machine, ("toxic",)), "toxic int, margin double, worst string")
    cells = worst.groupBy(F.round("margin", 2).alias("margin")).agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).toPandas()
    return _calibrated(machine, cells["margin"].to_numpy(float), cells["toxic"].to_numpy(float), cells["n"].to_numpy(float))


def _rows(machine: Machine):
    inner = _worst(machine, ("doc_id", "held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in inner(batches):
            score = machine.score(b.column(2).to_numpy())
            yield pa.record_batch(
                [b.column(0), b.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), b.column(3)],
                [f.split()[0] for f in SCORED.split(", ")],
            )

    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row of ``SCORED`` per document; ``worst`` is its most toxic span, null without words.

    A null or empty text gets the score of no words, which is low. Inputs of a score are the text alone; other columns,
    whatever their names, are not read. Repeated rows are scored again; labels of a repeated id all count. A text of any
    length is scored whole, in memory in proportion to it; of equal margins the first span is the worst.
    """
    machine = fit(docs, labels)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"),
        F.col("text").cast("binary").alias("text"),
    )
    return rows.mapInArrow(_rows(machine), SCORED)
