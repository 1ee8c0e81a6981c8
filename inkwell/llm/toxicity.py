"""Toxicity: a support vector machine over a gap-weighted subsequence string kernel, with Nyström landmarks.

The kernel counts common subsequences of four characters that lie within a span of six, each
skipped character weighing `DECAY`, so that inserted and missing characters cost little:
k(s, t) = sum_u f_u(s) f_u(t) / (c(s) c(t)), f_u(s) the weight of u's occurrences in s and c(s) the root of
the sum of all squared weights in s (a positive rescaling, so k stays positive definite).

A text is a bag of segments: its sentences' words, of which ASCII punctuation is dropped, and runs of
single characters ("i d i o t") joined to one word. A text's margin is that of its most toxic segment,
and half of the second one's if both are positive.
With landmarks l_1..l_m and a linear SVM w in the Nyström space, w . K^(-1/2) (k(s, l_j))_j equals
sum_u f_u(s) W_u / c(s) with W = sum_j a_j f(l_j) / c(l_j): scoring is one table lookup a subsequence.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import labelled_sample
from .shared import hash_spans, mix, slices, small_batches, with_fields

DECAY, TABLE = 0.75, 1 << 20
VARIANT, HARD = 0.2, 20.0  # what missing a variant costs beside missing its segment, and what any clean segment taken for a toxic one costs at least
STRONGEST = 150.0  # what missing the most frequent segment of toxic sentences costs; all others cost in proportion to their sentences
ROUNDS = 9  # fits, each with the sentences that the one before it labels toxic, and the clean segments that it misplaces
RARE, MOST = 0.0005, 0.9  # shares of clean sentences, and of clean texts' best sentences, that a toxic sentence must exceed
OFTEN = 3  # different sentences that a segment must stand in to get variants
VARIED = 0.02  # what the share of variants above the edge counts beside that of toxic documents
JOIN = 1  # the character between the words of a pair
#: Offsets of a subsequence's four characters within a span of six.
PATTERNS = [(0, i, j, k) for k in range(3, 6) for j in range(2, k) for i in range(1, j)]
WEIGHTS = np.array([DECAY ** (p[-1] - 3) for p in PATTERNS])
_SENTENCE = re.compile(r"[.!?]+(?=\s|$)|\n+")
PLAIN = 0.6  # share of the toxic documents (net of clean ones) that single words must find, or pairs of words count as well
#: ASCII characters that are dropped within words; all others but white space count.
_DROP = np.zeros(1 << 16, bool)
_DROP[[i for i in range(33, 127) if not chr(i).isalnum()]] = True
_WHITE = np.zeros(1 << 16, bool)
_WHITE[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x2028, 0x2029, 0x3000, *range(0x2000, 0x200B)]] = True


def segments(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Characters, and start, length and text of each segment, all texts at once.

    Characters are UTF-16 units of the lower-cased text, each segment wrapped in blanks.
    """
    flat = np.frombuffer("\n".join([*((t or "").lower().replace("\n", " ") for t in texts), ""]).encode("utf-16-le", "surrogatepass"), np.uint16)
    flat = flat[~_DROP[flat]]
    ends = np.flatnonzero(flat == 10)
    white = _WHITE[flat]
    edge = np.diff(np.concatenate(([True], white, [True])).astype(np.int8))
    starts = np.flatnonzero(edge == -1)
    lens = np.flatnonzero(edge == 1) - starts
    doc = np.searchsorted(ends, starts)
    single = lens == 1
    joined = single[1:] & single[:-1] & (doc[1:] == doc[:-1])
    # Blanks between joined single characters go, all others become one blank on each side.
    word = np.cumsum(np.concatenate(([True], ~joined)))[: len(starts)] - 1 if len(starts) else np.zeros(0, int)
    size = np.bincount(word, lens).astype(np.int64) if len(starts) else np.zeros(0, np.int64)
    begin = np.concatenate(([0], np.cumsum(size + 2)[:-1])) if len(size) else np.zeros(0, np.int64)
    out = np.full(int((size + 2).sum()), 32, np.uint16)
    chars = flat[~white]
    of = np.repeat(word, lens)
    inner = np.arange(len(chars)) - np.concatenate(([0], np.cumsum(size)))[of] if len(chars) else np.zeros(0, int)
    if len(chars):
        out[begin[of] + 1 + inner] = chars
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else np.zeros(0, int)
    return out, begin, size + 2, doc[first]


def with_pairs(chars: np.ndarray, start: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The segments, and after them each two neighbouring ones of a text as one segment, joined by JOIN."""
    first = np.flatnonzero(doc[1:] == doc[:-1])
    a, b = size[first] - 1, size[first + 1] - 1  # without the first one's last blank, and the second one's first
    whole = a + 1 + b
    begin = np.cumsum(whole) - whole
    inner = np.arange(int(whole.sum())) - np.repeat(begin, whole)
    left, mid = np.repeat(a, whole), np.repeat(start[first], whole)
    at = np.where(inner < left, mid + inner, np.repeat(start[first + 1], whole) + inner - left)
    more = chars[np.minimum(at, max(0, len(chars) - 1))] if len(at) else chars[:0]
    more = np.where(inner == left, JOIN, more).astype(chars.dtype)
    return np.concatenate((chars, more)), np.concatenate((start, begin + len(chars))), np.concatenate((size, whole)), np.concatenate((doc, doc[first]))


def subsequences(chars: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment, table place and weight of every occurrence of a subsequence."""
    total = int(size.sum())
    seg = np.repeat(np.arange(len(size)), size)
    at = np.arange(total) - np.repeat(np.concatenate(([0], np.cumsum(size)[:-1])), size) if total else np.zeros(0, int)
    place, left = start[seg] + at, size[seg] - at
    parts = []
    c = chars.astype(np.uint64)
    for p, w in zip(PATTERNS, WEIGHTS):
        ok = np.flatnonzero(left > p[-1])
        i = place[ok]
        key = c[i] << np.uint64(48) | c[i + p[1]] << np.uint64(32) | c[i + p[2]] << np.uint64(16) | c[i + p[3]]
        parts.append((seg[ok], (mix(key) & np.uint64(TABLE - 1)).astype(np.int64), np.full(len(ok), w)))
    return tuple(np.concatenate(x) for x in zip(*parts))


def norms(size: np.ndarray) -> np.ndarray:
    """c(s), which depends on the segment's length only."""
    return np.sqrt(sum(np.maximum(0, size - p[-1]) * w * w for p, w in zip(PATTERNS, WEIGHTS)) + 1e-12)


class Landmarks:
    """f(l) / c(l) of the landmarks over the table places that they use."""

    def __init__(self, words: list[str]):
        chars, start, size, _ = segments(words)
        seg, place, w = subsequences(chars, start, size)
        self.used, col = np.unique(place, return_inverse=True)
        self.rows = np.zeros((len(size), len(self.used)))
        np.add.at(self.rows, (seg, col), w)
        self.rows /= norms(size)[:, None]

    def kernel(self, words: list[str], step: int = 400) -> np.ndarray:
        """k(word, landmark), a few words at a time."""
        out = []
        for i in range(0, len(words), step):
            chars, start, size, _ = segments(words[i : i + step])
            seg, place, w = subsequences(chars, start, size)
            col = np.minimum(np.searchsorted(self.used, place), len(self.used) - 1)
            hit = self.used[col] == place
            x = np.zeros((len(size), len(self.used)))
            np.add.at(x, (seg[hit], col[hit]), w[hit])
            out.append(x @ self.rows.T / norms(size)[:, None])
        return np.concatenate(out)


class Vocabulary:
    """The distinct segments of many texts, and each text's segments in order by number, with the sentence of each; built in bounded steps."""

    def __init__(self, texts: list[str | None], step: int = 1_000_000, pairs: bool = False):
        keys, docs, within, chars, sizes, known, before = [], [], [], [], [], np.zeros(0, np.uint64), 0
        size = np.cumsum([len(t or "") + 1 for t in texts])
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + step)))
            sentences, of = [], []
            for i in range(first, min(last, len(texts))):
                parts = _SENTENCE.split(texts[i] or "")
                sentences += parts
                of += [i] * len(parts)
            c, start, n, sentence = with_pairs(*segments(sentences)) if pairs else segments(sentences)
            key = hash_spans(c.view(np.uint8), start * 2, n * 2)
            unique, head = np.unique(key, return_index=True)
            new = head[~np.isin(unique, known)]
            known = np.union1d(known, unique)
            inner = np.arange(int(n[new].sum())) - np.repeat(np.cumsum(n[new]) - n[new], n[new])
            chars.append(c[np.repeat(start[new], n[new]) + inner])
            sizes.append(n[new])
            keys.append(key)
            docs.append(np.array(of, np.int64)[sentence])
            within.append(before + sentence)
            first, before = last, before + len(sentences)
        self.chars, self.size = np.concatenate(chars), np.concatenate(sizes)
        self.start = np.cumsum(self.size) - self.size
        own = hash_spans(self.chars.view(np.uint8), self.start * 2, self.size * 2)
        order = np.argsort(own)
        key = np.concatenate(keys)
        self.doc, self.sentence = np.concatenate(docs), np.concatenate(within)
        self.word = order[np.searchsorted(own[order], key)] if len(key) else np.zeros(0, np.int64)
        order = np.argsort(self.sentence, kind="stable")
        head = np.flatnonzero(np.diff(self.sentence[order], prepend=-1))
        length = np.diff(np.append(head, len(order)))
        place = (np.arange(len(order)) - np.repeat(head, length)).astype(np.uint64)
        whole = np.add.reduceat(mix(key[order] + mix(place)), head) if len(order) else key
        self.alike = np.zeros(len(order), np.int64)  # equal sentences have equal numbers
        self.alike[order] = np.repeat(np.unique(whole, return_inverse=True)[1], length)

    def texts(self, words) -> list[str]:
        return [self.chars[self.start[w] + 1 : self.start[w] + self.size[w] - 1].tobytes().decode("utf-16-le", "replace") for w in words]

    def margins(self, model: KernelMachine, step: int = 20_000) -> np.ndarray:
        n = len(self.size)
        return np.concatenate([np.zeros(0), *(model.segment_margins(self.chars, self.start[i : i + step], self.size[i : i + step]) for i in range(0, n, step))])


def text_margins(margin: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
    """The largest margin of each text's segments, and half of the second one's if that is positive too."""
    order = np.lexsort((margin, doc))
    margin, doc = margin[order], doc[order]
    last = np.flatnonzero(np.append(doc[1:] != doc[:-1], True))
    out = np.full(texts, -np.inf)
    second = np.where((last > 0) & (doc[np.maximum(last - 1, 0)] == doc[last]), margin[np.maximum(last - 1, 0)], 0)
    out[doc[last]] = margin[last] + 0.5 * np.maximum(0, np.where(margin[last] > 0, second, 0))
    return out


@dataclass
class KernelMachine:
    weights: np.ndarray  # W over the table
    bias: float
    scale: tuple[float, float]  # of the sigmoid over a text's margin
    pairs: bool = False  # whether pairs of neighbouring words are segments too

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """The margin of each text (-inf without a segment)."""
        chars, start, size, doc = with_pairs(*segments(texts)) if self.pairs else segments(texts)
        if not len(size):
            return np.full(len(texts), -np.inf)
        key = hash_spans(chars.view(np.uint8), start * 2, size * 2)
        _, head, of = np.unique(key, return_index=True, return_inverse=True)  # each distinct segment once
        return text_margins(self.segment_margins(chars, start[head], size[head])[of], doc, len(texts))

    def segment_margins(self, chars, start, size) -> np.ndarray:
        seg, place, w = subsequences(chars, start, size)
        return np.bincount(seg, self.weights[place] * w, len(size)) / norms(size) + self.bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        a, b = self.scale
        m = np.clip(self.margins(texts), -1e3, 1e3)
        return 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))


def _variants(word: str, rng: np.random.Generator, each: int) -> list[str]:
    """The word with one character more inside: each doubled, and random ones in each place."""
    more = [word[: i + 1] + word[i:] for i in range(len(word))]
    more += [word[:i] + chr(rng.integers(97, 123)) + word[i:] for i in range(1, len(word)) for _ in range(3)]
    return [more[i] for i in rng.permutation(len(more))[:each]]


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 40, seed: int = 2) -> np.ndarray:
    """Linear SVM (hinge loss, last column the bias) by dual coordinate descent; settled examples rest."""
    rng, a, w = np.random.default_rng(seed), np.zeros(len(y)), np.zeros(x.shape[1])
    diag = (x * x).sum(1)
    for _ in range(rounds):
        gradient = y * (x @ w) - 1
        for i in rng.permutation(np.flatnonzero((gradient < 0) & (a < cost) | (gradient > 0) & (a > 0))):
            old = a[i]
            a[i] = min(max(old - (y[i] * (w @ x[i]) - 1) / diag[i], 0), cost[i])
            w += (a[i] - old) * y[i] * x[i]
    return w


def presence_weights(words: Vocabulary, y: np.ndarray, step: int = 16) -> np.ndarray:
    """For each table place, how far the number of toxic texts with such a subsequence exceeds what chance gives, in standard deviations."""
    doc, word = np.unique(np.stack((words.doc, words.word)), axis=1)
    counts = np.zeros((2, TABLE))
    cuts = np.searchsorted(doc, np.arange(0, len(y) + step, step))
    for n, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
        seg, place, _ = subsequences(words.chars, words.start[word[lo:hi]], words.size[word[lo:hi]])
        held = np.zeros((step, TABLE), bool)
        held[doc[lo:hi][seg] - n * step, place] = True
        toxic = np.zeros(step, bool)
        toxic[: len(y) - n * step] = y[n * step : (n + 1) * step] > 0.5
        counts += held[~toxic].sum(0), held[toxic].sum(0)
    expected = counts.sum(0) * y.mean()
    return (counts[1] - expected) / np.sqrt(np.maximum(expected, 0.5))


def toxic_sentences(words: Vocabulary, y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sentences of toxic texts that are taken to be the toxic ones: their strongest segments, most frequent first, and in how many different sentences each stands.

    Those are the sentences above what RARE of the clean sentences reach, and the best one of each toxic
    text, if it is above what the best sentences of most clean texts reach: a text where none is may be labelled wrongly, and
    none of its sentences is an example. Equal sentences, as copies have them, count once.
    """
    m = margin[words.word]
    order = np.lexsort((m, words.sentence))
    at = order[np.flatnonzero(np.append(np.diff(words.sentence[order]) != 0, True))]  # the strongest segment of each sentence
    best = np.full(len(y), -np.inf)
    np.maximum.at(best, words.doc[at], m[at])
    clean = y[words.doc[at]] < 0.5
    one = at[~clean]
    top = best[(y < 0.5) & np.isfinite(best)]
    common = np.quantile(top, MOST) if len(top) else -np.inf
    rare = np.quantile(m[at[clean]], 1 - RARE) if clean.any() else np.inf
    one = one[(m[one] > rare) | (m[one] >= best[words.doc[one]]) & (m[one] > common)]
    if not len(one):  # nothing stands out: every toxic text's best sentence
        one = at[~clean]
        one = one[m[one] >= best[words.doc[one]]]
    pairs = np.unique(np.stack((words.word[one], words.alike[one])), axis=1)
    segment, count = np.unique(pairs[0], return_counts=True)
    order = np.argsort(-count, kind="stable")
    return segment[order], count[order]


def _train(words: Vocabulary, y: np.ndarray, pairs: bool, landmarks: int, drawn: int, hard: int, marked: int, seed: int) -> tuple[KernelMachine, float]:
    """A machine and the share of toxic texts that it finds; see fit."""
    rng, doc, word = np.random.default_rng(seed), words.doc, words.word
    clean = np.unique(word[y[doc] < 0.5])
    said = np.unique(np.stack((word, words.alike))[:, y[doc] < 0.5], axis=1)[0]
    said = np.bincount(said, minlength=len(words.size)).astype(float)  # different clean sentences with the segment
    margin = words.margins(KernelMachine(presence_weights(words, y), 0.0, (1.0, 0.0), pairs))
    found, count = toxic_sentences(words, y, margin)
    hardest = lambda: clean[np.argsort(-margin[clean], kind="stable")[:hard]].tolist()
    picked = dict.fromkeys([*clean[rng.permutation(len(clean))[:drawn]].tolist(), *hardest()])
    marks = dict.fromkeys([*found[: landmarks // 2].tolist(), *[*picked][: landmarks // 2]])
    for _ in range(ROUNDS):
        known = words.texts(found)
        grown = [(v, c * VARIANT) for w, c in zip(known, count) if c >= OFTEN for v in _variants(w, rng, 60)]
        every = [*known, *(v for v, _ in grown), *words.texts(picked)]
        near = Landmarks(words.texts(marks))
        values, vectors = np.linalg.eigh(near.rows @ near.rows.T)
        root = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T
        z = np.concatenate((near.kernel(every) @ root, np.ones((len(every), 1))), 1)
        sign = np.where(np.arange(len(every)) < len(known) + len(grown), 1.0, -1.0)
        scale = STRONGEST / count.max()
        w = _svm(z, sign, np.concatenate((scale * count, [scale * c for _, c in grown], HARD + scale * said[list(picked)])))
        table = np.zeros(TABLE)
        table[near.used] = near.rows.T @ (root @ w[:-1])
        model = KernelMachine(table.astype(np.float32), float(w[-1]), (1.0, 0.0), pairs)
        margin = words.margins(model)
        found, count = toxic_sentences(words, y, margin)
        worst = hardest()
        marks |= dict.fromkeys([*found[: marked // 2].tolist(), *[w for w in worst if w not in picked][:marked]])
        picked |= dict.fromkeys(worst)
    # The sigmoid is 0.3 where the share of toxic documents above, and a part of that of variants, exceeds four times that of clean ones by most.
    m = np.maximum(-1e3, text_margins(margin[word], doc, len(y)))
    edges = np.unique(np.clip(m, 0, None))
    above = lambda some: 1 - np.searchsorted(np.sort(m[some]), edges) / some.sum()
    varied = np.sort(model.margins([v for v, _ in grown])) if grown else np.zeros(1)
    gain = above(y == 1) - 4 * above(y == 0)
    edge = float(edges[np.argmax(gain + VARIED * (1 - np.searchsorted(varied, edges) / len(varied)))])
    below = m[m < edge]
    edge = (edge + max(0.0, float(below.max()) if len(below) else 0.0)) / 2
    slope = 4 / max(0.2, float(np.median(m[y == 1])) - edge)
    model.scale = (float(slope), float(np.log(0.3 / 0.7) - slope * edge))
    return model, float(gain.max())


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", allowed: Column | None = None, per_class: int = 2000, landmarks: int = 128, drawn: int = 1500, hard: int = 600, marked: int = 80, seed: int = 4
) -> KernelMachine | float:
    """A machine trained on the sentences of a bounded sample of labelled documents (about per_class a class).

    A toxic document's label belongs to some of its sentences only, and which ones is learned with the rest
    (multiple-instance learning): sentences are labelled first by subsequences that more toxic documents have
    than chance gives, then, between fits, by the machine itself (toxic_sentences). A labelled sentence is
    an example with the kernel of its strongest segment, and again with one more character in that; an example weighs as many different sentences as agree in it. All
    sentences of clean documents are negative, each segment once, weighing the number of such sentences.

    The fit works on a set of these that grows: `drawn` segments at random, and in each round the `hard` ones that are most
    wrongly placed among all clean ones. Landmarks are segments of labelled sentences, `landmarks` at first,
    half toxic and half clean, and up to marked / 2 toxic and `marked` clean ones more a round. If single words find fewer than PLAIN of the toxic documents
    (net of clean ones), pairs of neighbouring words are segments as well, here and when texts are scored. With fewer than two
    classes the share of label 1 (0.5 with no labels) is returned and becomes everyone's score.
    """
    got = labelled_sample(docs, labels, label, F.lit(True) if allowed is None else allowed, per_class).toPandas().sort_values("doc_id", kind="stable")
    y, texts = got["y"].to_numpy(float), list(got["text"])
    if not 0 < y.sum() < len(y):
        return float(y.mean()) if len(y) else 0.5
    words = Vocabulary(texts)
    sides = y[words.doc]
    if not 0 < sides.sum() < len(sides):  # a class without any word
        return float(y.mean())
    model, told = _train(words, y, False, landmarks, drawn, hard, marked, seed)
    if told < PLAIN:  # words alone don't tell: phrases may
        phrases, more = _train(Vocabulary(texts, pairs=True), y, True, landmarks, drawn, hard, marked, seed)
        model = phrases if more > told else model
    return model


def score(docs: DataFrame, model: KernelMachine | float) -> DataFrame:
    """docs with a column toxicity (0 to 1, higher: label 1 likelier), for every row and its whole text.

    Null texts and texts without a segment score next to 0; very long texts count as a whole, repeated rows alike. A column of the
    same name is replaced, all others pass through; an empty table gives none.
    """
    small_batches(docs.sparkSession)
    rest = docs.drop("toxicity")
    held = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: TABLE numbers

    def run(batches):
        m = held.value
        for b in batches:
            for part in slices(b, size=2_000_000):
                s = np.full(part.num_rows, m) if isinstance(m, float) else m.scores(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s.astype(float))], [*part.schema.names, "toxicity"])

    return rest.mapInArrow(run, with_fields(rest, toxicity="double"))
