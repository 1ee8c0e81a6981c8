"""Language-model scoring with a hierarchical Pitman-Yor model.

Every word is the context of a restaurant whose dishes are the words that follow it; all context
restaurants share one parent, the unigram restaurant, whose base is uniform over the vocabulary and
one unknown word. Each table of a context restaurant is a customer of the parent (Teh, 2006).

Seatings are sampled by Gibbs, one dish of a restaurant at a time: the c customers of a dish leave and
are seated anew given everyone else. What they leave behind is t tables with probability in proportion to
S(c, t) prod_j (theta + d (T + j)) P_j, with S the sum over all ways to seat c customers at t tables of
prod (1 - d) (2 - d) .. (size - 1 - d), T the other tables of the restaurant, and P_j the parent's
predictive probability after j of these tables. The parent's dishes are seated in the same way, between
the rounds of the context restaurants. Predictive probabilities are averaged over the last rounds:
P(w|u) = (c_uw - d t_uw + (theta + d T_u) P(w)) / (theta + c_u).

Layout: texts are cut into blocks of a few MB. A block asks the word buckets once for each of its
distinct words, and gets the word's number and counts; it then sends its distinct pairs of numbers to the pair
buckets, which merge those of all blocks. All pairs of a context lie in one bucket, those of a
context with over HOT tokens are spread over all buckets by a hash of the pair. A pair bucket seats its
restaurants, and asks the word buckets for what it needs of the parent once for each distinct word.
At last each block gets the probability of each of its pairs. So a word or pair as frequent as it may be has
one entry a block, counts cover all training tokens, and no table of words is ever held in one place.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, hashed_words, mix, slices

#: The words that stand before and after every text; no word hashes to them but by chance.
BEGIN, END = np.uint64(0x5BF0_3635_DCA9_2B1D), np.uint64(0xA0761D6478BD642F)
BLOCK_BYTES, WORDS_IN_BUCKET, PAIRS_IN_BUCKET = 8_000_000, 1_000_000, 1_500_000
RANK_BITS = 26  # of a word's number: its place in its bucket
HOT = 100_000  # tokens of a context beyond which its pairs are spread over all buckets
SMALL = 1024  # dishes of up to so many customers use the table of S, larger ones its integral
THETA, ROOT_THETA = 1.0, 1.0


def pack(x: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor().compress(np.ascontiguousarray(x.view(np.uint8).reshape(x.size, x.itemsize).T).tobytes())


def unpack(b: bytes, kind=np.uint32) -> np.ndarray:
    raw, size = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8), np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x.astype(np.uint64), prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range of sorted hashes starts, and the end."""
    edges = [(i << 64) // buckets for i in range(1, buckets)]
    return np.concatenate(([0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)])).astype(np.int64)


#: kind, the bucket that a row goes to or comes from, its source (a block or a pair bucket), packed arrays, sums.
PACKED = "kind int, bucket long, source long, a binary, b binary, c binary, d binary, e binary, f binary, sums array<long>"
_TYPES = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 6, pa.list_(pa.int64())]
_NAMES = ["kind", "bucket", "source", "a", "b", "c", "d", "e", "f", "sums"]
NUMBER, PAIRS, INDEX, TABLES, DISHES, PARENT, CHANCE = range(7)


def _row(kind: int, bucket: int, source: int, *packed, sums=None) -> tuple:
    return (kind, int(bucket), int(source), *packed, *[None] * (6 - len(packed)), None if sums is None else [int(x) for x in sums])


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], _NAMES)


def _of(table: pa.Table, kind: int, by: str = "bucket") -> list[dict]:
    return sorted((r for r in table.to_pylist() if r["kind"] == kind), key=lambda r: r[by])


def _sums(df: DataFrame, n: int) -> list[int]:
    """The sums that buckets left in their first rows, added up by Spark."""
    return [int(x or 0) for x in df.agg(*(F.sum(F.col("sums")[i]) for i in range(n))).first()]


def _joined(parts: list[np.ndarray], kind=np.int64) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *parts]).astype(kind)


def _blocks(batches):
    n = 0
    for b in batches:
        for part in slices(b, size=BLOCK_BYTES):
            h, cut = hashed_words(part.column("text"))
            keys = np.unique(np.concatenate((h, [BEGIN, END])))
            at = np.searchsorted(keys, h)
            size, held = np.diff(cut), np.array(part.column("_held").to_pylist(), bool)
            every = np.bincount(at, minlength=len(keys))
            train = np.bincount(at[np.repeat(~held, size)], minlength=len(keys))
            end = np.searchsorted(keys, END)
            every[end], train[end] = every[end] + len(held), train[end] + (~held).sum()
            # Numbers by frequency compress best.
            rank = np.empty(len(keys), np.uint32)
            rank[np.argsort(-every, kind="stable")] = np.arange(len(keys))
            block = (TaskContext.get().partitionId() << 32) + n
            ends = [int(np.searchsorted(keys, BEGIN)), int(end)]
            words = {"keys": pack_sorted(keys), "train": pack(train.astype(np.uint32)), "every": pack(every.astype(np.uint32))}
            texts = {"doc_ids": part.column("doc_id").to_pylist(), "held": held.tolist(), "sizes": pack(size.astype(np.uint32)), "ranks": pack(rank), "tokens": pack(rank[at]), "ends": ends}
            yield pa.RecordBatch.from_pylist([{"part": "words", "block": block, **words}, {"part": "texts", "block": block, **texts, "n_tokens": len(h) + part.num_rows, "n_words": len(keys)}], _BLOCK)
            n += 1


#: The words of a block are a table of their own, which goes once they are numbered.
BLOCK = "part string, block long, keys binary, train binary, every binary, doc_ids array<long>, held array<boolean>, sizes binary, ranks binary, tokens binary, ends array<long>, n_tokens long, n_words long"
_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}
_BLOCK = pa.schema([(name, _KINDS[kind]) for name, kind in (x.split() for x in BLOCK.split(", "))])


class Block:
    """A decoded block: its events (previous word, word), by number of the word in the block."""

    def __init__(self, row: dict):
        self.block, self.held = row["block"], np.array(row["held"], bool)
        self.sizes, rank = unpack(row["sizes"]).astype(np.int64), unpack(row["ranks"])
        of = np.empty(len(rank), np.int32)
        of[rank] = np.arange(len(rank), dtype=np.int32)
        self.begin, self.end = row["ends"]
        total = self.sizes + 1
        self.cut = np.concatenate(([0], np.cumsum(total)))
        self.next = np.full(self.cut[-1], self.end, np.int32)
        inner = np.ones(self.cut[-1], bool)
        inner[self.cut[1:] - 1] = False
        self.next[inner] = of[unpack(row["tokens"])]
        self.prev = np.concatenate(([self.begin], self.next[:-1])).astype(np.int32)
        self.prev[self.cut[:-1]] = self.begin
        self.train = np.repeat(~self.held, total)

    def pairs(self):
        """Distinct pairs, sorted: previous word, word; and the pair of each event."""
        keys, of = np.unique(self.prev.astype(np.uint64) << np.uint64(32) | self.next.astype(np.uint64), return_inverse=True)
        return (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), of

    def numbers(self, rows: list[dict]):
        """Global numbers of the block's words, their counts in training, and in all texts."""
        ids = _joined([unpack_sorted(r["a"]) + (np.uint64(r["bucket"]) << np.uint64(RANK_BITS)) for r in rows], np.uint64)
        return ids, *(_joined([unpack(r[c], np.uint64) for r in rows]) for c in "bc")

    def dealt(self, ids, u, w, every, buckets: int):
        """The bucket of each pair, and an order of the pairs by bucket."""
        with np.errstate(over="ignore"):
            both = mix(ids[u] * np.uint64(0xD6E8FEB86659FD93) + ids[w])
        bucket = (np.where(self.heat(u, every), both, mix(ids[u])) % np.uint64(buckets)).astype(np.int64)
        return bucket, np.argsort(bucket, kind="stable")

    def heat(self, u, every):
        return every[np.where(u == self.begin, self.end, u)] > HOT


def _ask_words(buckets: int):
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                keys, train, every = unpack_sorted(row["keys"]), unpack(row["train"]), unpack(row["every"])
                cut = _cuts(keys, buckets)
                yield from _rows([_row(NUMBER, i, row["block"], pack_sorted(keys[s:e]), pack(train[s:e]), pack(every[s:e])) for i, (s, e) in enumerate(zip(cut[:-1], cut[1:])) if e > s]).to_batches()

    return run


def _merged(lists: list[np.ndarray]):
    """Sorted lists merged: where each starts, the distinct keys, and the key of each entry."""
    cut = np.concatenate(([0], np.cumsum([len(k) for k in lists])))
    distinct, of = np.unique(_joined(lists, np.uint64), return_inverse=True)
    return cut, distinct, of


def _number(table: pa.Table) -> pa.Table:
    """Numbers and counts of one bucket's words, to every block that asked. Sums: distinct words, tokens."""
    rows = _of(table, NUMBER, "source")
    cut, distinct, of = _merged([unpack_sorted(r["a"]) for r in rows])
    train, every = (np.bincount(of, _joined([unpack(r[c]) for r in rows]), len(distinct)).astype(np.uint64) for c in "bc")
    sums, out = [(train > 0).sum(), train.sum()], []
    for i, r in enumerate(rows):
        at = of[cut[i] : cut[i + 1]]
        out.append(_row(NUMBER, r["bucket"], r["source"], pack_sorted(at), pack(train[at]), pack(every[at]), sums=None if i else sums))
    return _rows(out)


def _ask_pairs(buckets: int):
    """A block's distinct pairs for each bucket: contexts, pairs of each, words, training counts; tokens and heat of the contexts."""

    def run(key, body: pa.Table, answers: pa.Table) -> pa.Table:
        x = Block(body.to_pylist()[0])
        ids, train, every = x.numbers(_of(answers, NUMBER))
        u, w, of = x.pairs()
        count = np.bincount(of[x.train], minlength=len(u))
        tokens = np.where(u == x.begin, train[x.end], train[u]) * 2 + x.heat(u, every)
        bucket, order = x.dealt(ids, u, w, every, buckets)
        cut, out = np.searchsorted(bucket[order], np.arange(buckets + 1)), []
        for i in range(buckets):
            at = order[cut[i] : cut[i + 1]]
            if len(at):
                first = np.flatnonzero(np.concatenate(([True], u[at][1:] != u[at][:-1])))
                out.append(_row(PAIRS, i, x.block, pack_sorted(ids[u[at][first]]), pack(np.diff(first, append=len(at)).astype(np.uint32)), pack(ids[w[at]]), pack(count[at].astype(np.uint32)), pack(tokens[at][first].astype(np.uint64))))
        return _rows(out)

    return run


class Bucket:
    """Pairs of one bucket: contexts with their tokens and heat, and of each pair the context, the word and the count."""

    def __init__(self, row: dict):
        self.bucket, self.contexts, self.words = row["bucket"], unpack_sorted(row["a"]), unpack_sorted(row["f"])
        self.u = np.repeat(np.arange(len(self.contexts)), unpack(row["b"]))
        self.w, self.count = unpack(row["c"]).astype(np.int64), unpack(row["d"], np.uint64).astype(np.int64)
        tokens = unpack(row["e"], np.uint64).astype(np.int64)
        self.tokens, self.hot = tokens >> 1, np.flatnonzero(tokens & 1)
        #: Numbers that the bucket asks the parent for, and where its words and hot contexts are among them.
        self.asks = np.union1d(self.words, self.contexts[self.hot])
        self.word_at, self.hot_at = np.searchsorted(self.asks, self.words), np.searchsorted(self.asks, self.contexts[self.hot])

    def dishes(self, tables: np.ndarray) -> list[tuple]:
        """What the parent gets from a seating: customers of each dish, and tables in this bucket of each hot context."""
        customers, seated = np.zeros(len(self.asks), np.uint64), np.zeros(len(self.asks), np.uint64)
        customers[self.word_at] = np.bincount(self.w, tables, len(self.words)).astype(np.uint64)
        seated[self.hot_at] = np.bincount(self.u, tables, len(self.contexts)).astype(np.uint64)[self.hot]
        at = (self.asks >> np.uint64(RANK_BITS)).astype(np.int64)
        cut = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1], [True])))
        return [_row(DISHES, at[s], self.bucket, pack_sorted(self.asks[s:e]), pack(customers[s:e]), pack(seated[s:e])) for s, e in zip(cut[:-1], cut[1:])]

    def parent(self, rows: list[dict], tables: np.ndarray):
        """Customers and tables of each word in the parent, and the tables of each context in all buckets."""
        k, s, t = (_joined([unpack(r[c], np.uint64) for r in rows]) for c in "abc")
        every = np.bincount(self.u, tables, len(self.contexts)).astype(np.int64)
        every[self.hot] = t[self.hot_at]
        return k[self.word_at], s[self.word_at], every


def _merge_pairs(table: pa.Table) -> pa.Table:
    """One bucket's pairs of all blocks; of each block which of them it has. Every pair starts with one table. Sums: pairs seen once, twice."""
    rows = _of(table, PAIRS, "source")
    _, contexts, own = _merged([unpack_sorted(r["a"]) for r in rows])
    size = _joined([unpack(r["b"]) for r in rows])
    _, words, word = _merged([unpack(r["c"], np.uint64) for r in rows])
    u = np.repeat(own, size)
    keys, of = np.unique(u.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64), return_inverse=True)
    count = np.bincount(of, _joined([unpack(r["d"]) for r in rows]), len(keys)).astype(np.uint64)
    tokens = np.zeros(len(contexts), np.uint64)
    tokens[own] = _joined([unpack(r["e"], np.uint64) for r in rows], np.uint64)
    state = _row(PAIRS, rows[0]["bucket"], -1, pack_sorted(contexts), pack(np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=len(contexts)).astype(np.uint32)), pack((keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)), pack(count), pack(tokens), pack_sorted(words), sums=[(count == 1).sum(), (count == 2).sum()])
    cut, at, out = 0, 0, [state]
    for r in rows:
        n = int(unpack(r["b"]).sum())
        out.append(_row(INDEX, r["bucket"], r["source"], pack_sorted(of[at : at + n])))
        at += n
    x = Bucket(dict(zip(_NAMES, state)))
    tables = (x.count > 0).astype(np.int64)
    return _rows([*out, _row(TABLES, x.bucket, -1, pack(tables.astype(np.uint32)), pack(np.zeros(len(tables), np.float32))), *x.dishes(tables)])


@lru_cache(4)
def log_stirling(most: int, d: float) -> np.ndarray:
    """log S(c, t) for c and t up to `most`: S(c + 1, t) = S(c, t - 1) + (c - t d) S(c, t)."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0
    for c in range(1, most):
        t = np.arange(1, c + 1)
        stay = out[c, 1 : c + 1] + np.log(c - t * d)
        out[c + 1, 1 : c + 2] = np.logaddexp(out[c, : c + 1], np.append(stay, -np.inf))
    return out


def _categorical(logs: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A column of each row, drawn by the row's unnormalised log probabilities."""
    share = np.cumsum(np.exp(logs - logs.max(1, keepdims=True)), 1)
    return (share < rng.random(len(logs))[:, None] * share[:, -1:]).sum(1)


_KNOTS, _STEP = 16, 0.08
_STRETCH = np.sinh(np.arange(0, 6, _STEP) + _STEP / 2)
_SLOPE = np.cosh(np.arange(0, 6, _STEP) + _STEP / 2)
_CHEBYSHEV = np.cos((2 * np.arange(_KNOTS) + 1) * np.pi / (2 * _KNOTS))
_BARYCENTRIC = (-1.0) ** np.arange(_KNOTS) * np.sin((2 * np.arange(_KNOTS) + 1) * np.pi / (2 * _KNOTS))


def _root_of(f, shape) -> np.ndarray:
    """Where in (0, 1) an increasing function changes sign, by bisection of the logarithm."""
    low, high = np.full(shape, -700.0), np.zeros(shape)
    for _ in range(60):
        at = (low + high) / 2
        up = f(np.exp(at)) > 0
        low, high = np.where(up, low, at), np.where(up, at, high)
    return np.exp((low + high) / 2)


def log_sibuya(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log [z^c] (1 - (1 - z)^d)^t: the chance that t Sibuya(d) sizes sum to c, also for a t between whole numbers.

    Cauchy's integral, over a parabola around the cut from 1 that passes the saddle point. Where
    the saddle is close to the cut, the power less 1 is taken: its coefficient is the same and nothing cancels.
    """
    y = _root_of(lambda y: c * (1 - y**d) - t * d * y ** (d - 1) * (1 - y), c.shape)
    mid = np.clip(np.maximum(y, 1 / c), 0, 1 - 1e-12)
    bend = t * d * mid**d * ((1 - d) * (1 - mid**d) - d * mid**d) / (1 - mid**d) ** 2 + (c + 1) * mid**2 / (1 - mid) ** 2
    width = 0.5 / np.sqrt(np.maximum(bend, 1.0))
    w = width[..., None] * _STRETCH
    at = mid[..., None] * (1 + 1j * w) ** 2
    top = t * np.log1p(-(mid**d)) - (c + 1) * np.log1p(-mid)
    inside, outside = t[..., None] * np.log(1 - at**d), -(c[..., None] + 1) * np.log(1 - at)
    value = np.exp(inside + outside - top[..., None])
    value -= np.where((t * mid**d < 2)[..., None], np.exp(np.minimum(outside.real - top[..., None], 50) + 1j * outside.imag), 0)
    part = (value * (1 + 1j * w)).real * _SLOPE
    return top + np.log(np.maximum(part.sum(-1), 1e-300) * width * mid * 2 * _STEP / np.pi)


def draw_large(count: np.ndarray, new: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables of dishes with many customers each: P(t) in proportion to new^t S(count, t).

    S(count, t) is in proportion to d^-t / t! times the chance that t Sibuya sizes sum to count, which is
    smooth in t and therefore computed at some t only.
    """
    out = np.zeros(len(count), np.int64)
    for at in range(0, len(count), 64):
        c, a = count[at : at + 64].astype(float), new[at : at + 64]
        y = _root_of(lambda y: c * y ** (1 - d) - a * (1 - y), c.shape)
        mean = np.clip(a / d * (1 - y**d), 1, c)
        low = np.maximum(1, np.floor(mean - 10 * np.sqrt(mean) - 20))
        high = np.minimum(c, np.ceil(mean + 10 * np.sqrt(mean) + 30))
        knots = (low + high)[:, None] / 2 + (high - low)[:, None] / 2 * _CHEBYSHEV
        smooth = log_sibuya(np.broadcast_to(c[:, None], knots.shape), knots, d) - np.log(knots)
        for i in range(len(c)):
            t = np.arange(low[i], high[i] + 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                near = _BARYCENTRIC / (t[:, None] - knots[i])
                p = near @ smooth[i] / near.sum(1)
            hit = np.isin(t, knots[i])
            p[hit] = smooth[i][np.argmin(np.abs(t[hit][:, None] - knots[i]), 1)]
            # log of (new / d)^t / (t - 1)!, the t of it being in p's logarithm
            p += t * np.log(a[i] / d) - np.concatenate(([0.0], np.cumsum(np.log(t[1:] - 1))))
            share = np.cumsum(np.exp(p - p.max()))
            out[at + i] = t[np.searchsorted(share, rng.random() * share[-1], "right")]
    return out


class Parent:
    """The parent restaurant's predictive probabilities."""

    def __init__(self, d0: float, customers: int, tables: int, vocabulary: int):
        self.d0, self.base, self.all = d0, (ROOT_THETA + d0 * tables) / (vocabulary + 1), ROOT_THETA + customers

    def chance(self, k, s):
        """Of words with k customers at s tables."""
        return (k - self.d0 * s + self.base) / self.all

    def seat(self, k: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Tables of the parent's own dishes with k customers, seated anew."""
        out = np.minimum(k, 1)
        table = log_stirling(SMALL, self.d0)
        for c in np.unique(k[(k > 1) & (k <= SMALL)]):
            at = np.flatnonzero(k == c)
            out[at] = 1 + _categorical(np.tile(table[c, 1 : c + 1] + np.arange(1, c + 1) * np.log(self.base), (len(at), 1)), rng)
        large = np.flatnonzero(k > SMALL)
        out[large] = draw_large(k[large], np.full(len(large), self.base), self.d0, rng)
        return out


def seat(x: Bucket, tables: np.ndarray, k, s, every, parent: Parent, d: float, rng: np.random.Generator, cells: int = 2_000_000) -> np.ndarray:
    """One Gibbs sweep: every dish of every restaurant of the bucket seated anew, in place of its present tables.

    k, s: customers and tables of each word in the parent before the sweep; every: tables of each context.
    Dishes with as many customers take their turns side by side, and what they change counts from the next such turn.
    """
    tables, every, k, table = tables.copy(), every.copy(), k.copy(), log_stirling(SMALL, d)
    order = np.argsort(x.count, kind="stable")
    cut = np.searchsorted(x.count[order], np.arange(2, SMALL + 2))
    turns = [order[a + i : min(b, a + i + cells // c)] for c, a, b in zip(range(2, SMALL + 1), cut[:-1], cut[1:]) for i in range(0, b - a, cells // c)]
    rest = order[cut[-1] :]
    for at in [*turns, *([rest] if len(rest) else [])]:
        u, w, old, c = x.u[at], x.w[at], tables[at], x.count[at]
        others, near = every[u] - old, np.maximum(0, k[w] - old)
        there = np.minimum(s[w], near)  # the parent's tables that the others keep
        if c[0] <= SMALL:
            j = np.arange(c[0])
            chance = (near[:, None] + j - parent.d0 * np.maximum(there[:, None], j > 0) + parent.base) / (parent.all - old[:, None] + j)
            logs = table[c[0], 1 : c[0] + 1] + np.cumsum(np.log(chance) + np.log(THETA + d * (others[:, None] + j)), 1)
            new = 1 + _categorical(logs, rng)
        else:
            new = draw_large(c, (THETA + d * every[u]) * parent.chance(k[w], s[w]), d, rng)
        tables[at] = new
        np.add.at(every, u, new - old)
        np.add.at(k, w, new - old)
    return tables


def _parent(d0, tables, vocabulary: int, seed: int):
    """The parent's dishes of one bucket, to every pair bucket that asked. Sums: customers, tables, dishes with one and two customers.

    d0 and tables are numbers, or none in the first round, which has one table a dish.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = _of(table, DISHES, "source")
        cut, distinct, of = _merged([unpack_sorted(r["a"]) for r in rows])
        k, t = (np.bincount(of, _joined([unpack(r[c], np.uint64) for r in rows]), len(distinct)).astype(np.int64) for c in "bc")
        s = np.minimum(k, 1) if d0 is None else Parent(d0, 0, tables, vocabulary).seat(k, np.random.default_rng([seed, rows[0]["bucket"]]))
        sums, out = [k.sum(), s.sum(), (k == 1).sum(), (k == 2).sum()], []
        for i, r in enumerate(rows):
            at = of[cut[i] : cut[i + 1]]
            out.append(_row(PARENT, r["bucket"], r["source"], *(pack(v[at].astype(np.uint64)) for v in (k, s, t)), sums=None if i else sums))
        return _rows(out)

    return run


def predictive(x: Bucket, tables, k, s, every, parent: Parent, d: float) -> np.ndarray:
    """P(word | context) of each pair of the bucket."""
    return (x.count - d * tables + (THETA + d * every[x.u]) * parent.chance(k, s)[x.w]) / (THETA + x.tokens[x.u])


def _resume(state: pa.Table, answers: pa.Table):
    x, row = Bucket(_of(state, PAIRS)[0]), _of(state, TABLES)[0]
    tables = unpack(row["a"]).astype(np.int64)
    return x, tables, unpack(row["b"], np.float32).astype(float), x.parent(_of(answers, PARENT), tables)


def _round(parent: Parent, d: float, keep: bool, sweeps: int, seed: int):
    """One round of a pair bucket: the seating that it comes with counts if `keep` holds, then every dish is seated anew."""

    def run(key, state: pa.Table, answers: pa.Table) -> pa.Table:
        x, tables, chance, (k, s, every) = _resume(state, answers)
        if keep:
            chance = chance + predictive(x, tables, k, s, every, parent, d)
        rng = np.random.default_rng([seed, x.bucket])
        for _ in range(sweeps):
            new = seat(x, tables, k, s, every, parent, d, rng)
            k = k + np.bincount(x.w, new - tables, len(k)).astype(np.int64)
            every = every + np.bincount(x.u, new - tables, len(every)).astype(np.int64)
            tables = new
        return _rows([_row(TABLES, x.bucket, -1, pack(tables.astype(np.uint32)), pack(chance.astype(np.float32))), *x.dishes(tables)])

    return run


def _chances(parent: Parent, d: float, samples: int):
    """The averaged probability of each pair, to every block that has it."""

    def run(key, state: pa.Table, answers: pa.Table) -> pa.Table:
        x, tables, chance, (k, s, every) = _resume(state, answers)
        chance = ((chance + predictive(x, tables, k, s, every, parent, d)) / samples).astype(np.float32)
        chance = ((chance.view(np.uint32) + np.uint32(128)) & np.uint32(0xFFFFFF00)).view(np.float32)  # 15 bits of fraction
        return _rows([_row(CHANCE, x.bucket, r["source"], pack(chance[unpack_sorted(r["a"]).astype(np.int64)])) for r in _of(state, INDEX, "source")])

    return run


def _score(vocabulary: int, tokens: int, buckets: int):
    def run(key, body: pa.Table, answers: pa.Table) -> pa.Table:
        row = body.to_pylist()[0]
        x = Block(row)
        ids, train, every = x.numbers(_of(answers, NUMBER))
        u, w, of = x.pairs()
        _, order = x.dealt(ids, u, w, every, buckets)
        chance = np.empty(len(u))
        chance[order] = _joined([unpack(r["a"], np.float32) for r in _of(answers, CHANCE)], float)
        c = train[x.next]
        add = lambda v: np.add.reduceat(v, x.cut[:-1])
        base, score = add(np.log10((c + 1) / (tokens + vocabulary + 1))), add(np.log10(chance)[of])
        return pa.table([pa.array(row["doc_ids"], pa.int64()), pa.array(x.held), pa.array(x.sizes + 1), pa.array(add((c > 0).astype(np.int64))), pa.array(np.full(len(x.sizes), tokens)), pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def discount(once: int, twice: int) -> float:
    """From counts of counts (Kneser and Ney)."""
    return min(0.95, max(0.05, once / max(1, once + 2 * twice)))


def score(docs: DataFrame, held_out: Column, scratch: Scratch, rounds: int = 3, sweeps: int = 2, samples: int = 2, seed: int = 9) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probability) of every row.

    Learns from all rows for which held_out doesn't hold. Tokens are words, A-Z lower-cased, and one end
    of text. base_score is the add-one unigram score. After one table for every pair come `rounds`
    rounds, each of a seating of the parent and `sweeps` sweeps of the context restaurants; the last `samples` are
    averaged. Discounts come from the counts of counts, of pairs and of the words that a word follows.

    Defined results: a null text is empty (one token, the end); null and repeated doc_ids keep their rows; repeated rows
    count as often as they occur; a very long text is a block of its own; with nothing to learn from every token has the
    base's probability; other columns are left out, whatever their names; an empty table gives none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("_held"))
    words, body = scratch.split(rows.mapInArrow(_blocks, BLOCK), "blocks", "part", ["words", "texts"])
    size = body.agg(F.sum("n_tokens"), F.sum("n_words")).first()
    pair_buckets, word_buckets = 1 + (size[0] or 0) // PAIRS_IN_BUCKET, 1 + (size[1] or 0) // WORDS_IN_BUCKET
    asked = words.select("block", "keys", "train", "every").mapInArrow(_ask_words(word_buckets), PACKED)
    numbers = scratch.keep(asked.groupBy("bucket").applyInArrow(_number, PACKED), "numbers")
    scratch.drop(words)
    vocabulary, tokens = _sums(numbers, 2)
    scratch.sweep()
    texts = body.select("block", "held", "sizes", "ranks", "tokens", "ends").groupBy("block")
    own = numbers.select(*_NAMES).groupBy("source")
    asked = texts.cogroup(own).applyInArrow(_ask_pairs(pair_buckets), PACKED)
    merged = scratch.keep(asked.groupBy("bucket").applyInArrow(_merge_pairs, PACKED), "pairs")
    scratch.sweep()
    state = merged.filter(F.col("kind") == PAIRS)
    d = discount(*_sums(state, 2))
    moves, d0, total = merged, None, 0
    for turn in range(rounds + 1):
        dishes = moves.filter(F.col("kind") == DISHES).groupBy("bucket")
        parents = scratch.keep(dishes.applyInArrow(_parent(d0, total, vocabulary, seed + 2 * turn), PACKED), "parent")
        customers, total, once, twice = _sums(parents, 4)
        d0 = discount(once, twice) if d0 is None else d0
        parent = Parent(d0, customers, total, vocabulary)
        seated = moves.filter(F.col("kind") == TABLES)
        if turn < rounds:
            both = state.union(seated).groupBy("bucket").cogroup(parents.groupBy("source"))
            after = scratch.keep(both.applyInArrow(_round(parent, d, turn > rounds - samples, sweeps, seed + 2 * turn + 1), PACKED), "round")
            scratch.drop(parents)
            if moves is not merged:
                scratch.drop(moves)
            moves = after
            scratch.sweep()
    both = state.union(merged.filter(F.col("kind") == INDEX)).union(seated).groupBy("bucket").cogroup(parents.groupBy("source"))
    chances = scratch.keep(both.applyInArrow(_chances(parent, d, samples), PACKED), "chances")
    for used in (merged, moves, parents):
        scratch.drop(used)
    scratch.sweep()
    texts = body.select("block", "doc_ids", "held", "sizes", "ranks", "tokens", "ends").groupBy("block")
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.cogroup(numbers.union(chances).groupBy("source")).applyInArrow(_score(vocabulary, tokens, pair_buckets), out)
