"""Hierarchical Pitman-Yor language model of words, and perplexity scores from it.

Restaurants. Every word is a context (the text's start is one more) with a restaurant of the words that
follow it; all share the root restaurant of words as parent, whose base is uniform over the V training
words and one unknown word. With c customers and t tables of word w after context u, C and T their sums in u,

    P(w | u) = (c - d t) / (theta + C) + (theta + d T) / (theta + C) * P(w)

and P(w) likewise from the root, whose customers are the tables of the contexts.

Seating. A Gibbs sweep draws, dish by dish, the number of tables at which the c customers of a dish sit, given all
other dishes of its restaurant and the parent's predictive probability. That law is S_d(c, t) times the product of
(theta + d (T' + i)) P(w) for i = 0 ... t - 1 (S: generalised Stirling numbers, T': the restaurant's other tables). It
is drawn from the table of the numbers up to ``EXACT`` customers. Beyond, the numbers come from their binomial series where
tables are few for the customers, from a power series where they are nearly as many, and else from a saddlepoint expansion with
its first correction. The seating of a sweep is where the
next one starts, and the scores average the predictive probabilities of the sweeps after ``burn_in``.

What is parallel: contexts are drawn given the root of the sweep before, then the root given the contexts' tables. In a restaurant
the dishes are drawn in ``TURNS`` turns, each given the tables of the ones before, so small restaurants are drawn dish by
dish; the parent's probability stays as it is while a context's dishes are drawn, and the root's draws don't take a dish's own tables out of its
sum. Contexts are one word long: all longer ones would multiply what is exchanged beyond the disk budget.

Where the data lie. Texts become blocks of about ``block_bytes``, written once. A block sends each distinct
word, and each distinct pair of context and word, once with its count. Words are dealt by ranges of a 64-bit
fingerprint, pairs by ranges of the context's, so a range holds whole restaurants; contexts that are frequent in a
sample (it decides nothing else) are spread over ranges by the word, and their totals, a row each, go through the driver.
In pairs, words are told apart by 48 bits of their fingerprint. A range keeps its restaurants through all sweeps and exchanges only table counts of its distinct words with the root's ranges. At
the end it answers each block with one probability a pair. No table of words is broadcast. Counts of words (c, N, V, n_known, the base score) are
exact up to 64-bit fingerprints. Blocks times ranges are rows; ranges are at most ``max_ranges``, so beyond about
1.5 TB of text rows grow in proportion and ranges in size.

Null texts are empty: one end token. Rows that repeat an id are texts each. A null id is not held out
and learns. Other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Scratch, mix, read, word_hashes

END, START = np.uint64(0xE57A1B1E5EED0001), np.uint64(0x57A27B1E5EED0002)
EXACT, TURNS = 256, 8
#: Weights of numbers of tables held at once; they stay in a core's cache.
CELLS = 100_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(8)
def log_stirling(d: float, n: int = EXACT) -> np.ndarray:
    """log S_d(c, t) for c, t up to n."""
    s = np.full((n + 1, n + 1), -np.inf)
    s[0, 0] = 0
    for c in range(n):
        with np.errstate(divide="ignore"):
            s[c + 1, 1:] = np.logaddexp(s[c, :-1], np.log(np.maximum(c - d * np.arange(1, n + 1), 1e-300)) + s[c, 1:])
    return s


@functools.lru_cache(8)
def _ratios(d: float) -> np.ndarray:
    """S_d(c, t) / S_d(c, t - 1) for c, t up to ``EXACT``; 0 where there is none."""
    s = log_stirling(d)
    with np.errstate(invalid="ignore"):
        return np.nan_to_num(np.exp(np.diff(s, axis=1, prepend=-np.inf)), nan=0.0, posinf=0.0)


def gammaln(x: np.ndarray) -> np.ndarray:
    """log of the gamma function of positive numbers: eight steps up, then Stirling's series."""
    x = np.asarray(x, dtype=np.float64)
    small = x < 8
    shift = np.where(small, np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7)) if small.any() else 0.0, 0.0)
    y = np.where(small, x + 8, x)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


@functools.lru_cache(8)
def _saddle(d: float) -> tuple[np.ndarray, ...]:
    """On a grid of v = -log(1 - x): log(rho - 1), v, and the relative first correction, where F = 1 - (1 - x)**d and rho = x F' / F."""
    v = np.exp(np.linspace(math.log(1e-6), math.log(40.0 / min(1.0, 2 * (1 - d))), 40_001))
    rho, k2 = _moments(v, d)
    s = np.log(-np.expm1(-v))
    with np.errstate(all="ignore"):  # the ends of the grid, where other series are used
        k3 = np.gradient(k2, s)
        k4 = np.gradient(k3, s)
        fix = k4 / (8 * k2**2) - 5 * k3**2 / (24 * k2**3)
    return np.log(np.maximum(rho - 1, 1e-300)), v, np.clip(np.nan_to_num(fix), -1, 1)


def _moments(v: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of log F by log x."""
    x, f = -np.expm1(-v), -np.expm1(-d * v)
    a = x * d * np.exp(v * (1 - d)) / f
    return a, a + x * x * d * (1 - d) * np.exp(v * (2 - d)) / f - a * a


def log_stirling_large(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S_d(c, t) for many customers: c! / (t! d**t) times the coefficient of x**c in (1 - (1 - x)**d)**t."""
    c, t = np.broadcast_arrays(np.asarray(c, dtype=np.float64), np.asarray(t, dtype=np.float64))
    log_rho, grid, fix = _saddle(d)
    ratio = np.log(np.maximum(c / t - 1, 1e-12))
    v = np.interp(ratio, log_rho, grid)
    for _ in range(3):  # the saddle point to full precision
        a, k2 = _moments(v, d)
        slope = k2 * np.exp(-v) / -np.expm1(-v)
        v = np.clip(v - np.clip((a - c / t) / np.maximum(slope, 1e-300), -0.5 * v, 0.5 * v), 1e-8, 690.0)
    a, k2 = _moments(v, d)
    out = t * np.log(-np.expm1(-d * v)) - c * np.log(-np.expm1(-v)) - 0.5 * np.log(2 * np.pi * t * np.maximum(k2, 1e-300)) + np.log1p(np.maximum(np.interp(ratio, log_rho, fix) / t, -0.9))
    out = out.copy()
    # few tables for the customers: the binomial series in (1 - x)**d converges without cancellation
    few = t * c**-d <= (0.6 if d > 0.8 else 2.0)
    if few.any():
        ts = t[few]
        cs, row = np.unique(c[few], return_inverse=True)
        total, ways, top = np.zeros(len(ts)), np.zeros(len(ts)), gammaln(cs - d)
        for j in range(1, 81):
            left = ts - j + 1
            if not (left > 0).any():
                break
            ways += np.log(np.maximum(left, 1) / j)
            term = np.exp(ways + (gammaln(np.maximum(cs - j * d, 1e-9)) - top)[row] + math.lgamma(1 + j * d)) * math.sin(math.pi * j * d) / math.pi
            total += np.where(left > 0, -term if j % 2 == 0 else term, 0.0)
            if j * d % 1 > 1e-9 and np.abs(term).max() < 1e-12 * np.abs(total).min():
                break
        out[few] = np.where(total > 1e-9, (top - gammaln(cs + 1))[row] + np.log(np.maximum(total, 1e-300)), out[few])
    # nearly as many tables as customers: the power series of (F / d x)**t by its recurrence
    near = (c - t <= 40) & ~few
    if near.any():
        k, ts = (c - t)[near].astype(int), t[near]
        g = np.ones(41)
        for i in range(1, 41):
            g[i] = g[i - 1] * (i - d) / (i + 1)
        h = [np.ones(len(ts))]
        for n in range(1, 41):
            h.append(sum((i * ts - (n - i)) * g[i] * h[n - i] for i in range(1, n + 1)) / n)
        out[near] = ts * math.log(d) + np.log(np.maximum(np.stack(h)[k, np.arange(len(ts))], 1e-300))
    return out + gammaln(c + 1) - gammaln(t + 1) - t * math.log(d)


def uniforms(keys: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((mix(keys + np.uint64(k + 1) * _GOLD) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def seat(u: np.ndarray, c: np.ndarray, alpha: np.ndarray, log_p: np.ndarray, d: float) -> np.ndarray:
    """Numbers of tables, drawn with the uniforms u, of dishes with c customers; weights S_d(c, t) prod (alpha + i) exp(t log_p).

    alpha: theta / d + the restaurant's other tables. log_p: log of d times the parent's probability.
    """
    t = np.minimum(c, 1).astype(np.int64)
    two = np.flatnonzero(c == 2)  # most dishes: S(2, 1) = 1 - d, S(2, 2) = 1
    if len(two):
        t[two] = 1 + (u[two] * (1 - d + (alpha[two] + 1) * np.exp(log_p[two])) >= 1 - d)
    many = np.flatnonzero(c > 2)
    if not len(many):
        return t
    order = many[np.argsort(c[many], kind="stable")]
    size = np.minimum(c[order], EXACT + 1)
    cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(order)]
    for s, e in zip(cuts, cuts[1:]):
        n = int(size[s])
        step = max(1, CELLS // n) if n <= EXACT else 500
        for at in range(s, e, step):
            own = order[at : min(e, at + step)]
            if n > EXACT:
                t[own] = _seat_large(u[own], c[own].astype(np.float64), alpha[own], log_p[own], d)
                continue
            with np.errstate(over="ignore", invalid="ignore", under="ignore"):
                p = alpha[own, None] + np.arange(n)
                p *= _ratios(d)[n, 1 : n + 1]
                p *= np.exp(log_p[own])[:, None]
                p[:, 0] = 1  # a weight is that before it times a ratio; the first counts as 1
                p = np.cumsum(np.multiply.accumulate(p, axis=1, out=p), axis=1, out=p)
            far = np.flatnonzero(~np.isfinite(p[:, -1]))
            if len(far):  # weights beyond the range of doubles
                logp = log_stirling(d)[n, 1 : n + 1] + np.cumsum(np.log(alpha[own[far], None] + np.arange(n)), axis=1) + log_p[own[far], None] * np.arange(1, n + 1)
                p[far] = np.cumsum(np.exp(logp - logp.max(axis=1, keepdims=True)), axis=1)
            t[own] = 1 + (p < u[own, None] * p[:, -1:]).sum(axis=1)
    return t


def _seat_large(u, c, alpha, log_p, d):
    f = lambda t: log_stirling_large(c[:, None], t, d) + gammaln(alpha[:, None] + t) + log_p[:, None] * t
    share = np.linspace(0, 1, 41)
    low, high = np.ones(len(c)), c.copy()
    grid = np.maximum(1, np.floor(np.exp(share * np.log(c)[:, None])))
    for _ in range(6):  # close in on the mode; the law has one
        at = f(grid).argmax(axis=1)
        rows = np.arange(len(c))
        low, high = grid[rows, np.maximum(at - 1, 0)], grid[rows, np.minimum(at + 1, 40)]
        if (high - low).max() <= 40:
            break
        grid = np.floor(low[:, None] + share * (high - low)[:, None])
    grid = np.minimum(np.floor(low[:, None] + np.arange(41)), high[:, None])
    mode = grid[np.arange(len(c)), f(grid).argmax(axis=1)]
    # how far the law reaches: double the distance until it has fallen by e**-40
    peak, reach = f(mode[:, None])[:, 0], np.full(len(c), 4.0)
    for _ in range(40):
        sides = np.stack([np.maximum(mode - reach, 1), np.minimum(mode + reach, c)], axis=1)
        short = ((f(sides) - peak[:, None] > -40) & (sides > 1) & (sides < c[:, None])).any(axis=1)
        if not short.any():
            break
        reach = np.where(short, reach * 1.5, reach)
    low, high = np.maximum(mode - np.ceil(reach), 1), np.minimum(mode + np.ceil(reach), c)
    stride = np.ceil((high - low + 1) / 128)  # cells of this many tables, even inside; an odd number, so that the middle is one of them
    stride += 1 - stride % 2
    cells = low[:, None] + stride[:, None] * np.arange(128)
    inside = cells <= high[:, None]
    logp = np.where(inside, f(np.minimum(cells + (stride[:, None] - 1) / 2, c[:, None])), -np.inf)
    p = np.cumsum(np.exp(logp - logp.max(axis=1, keepdims=True)), axis=1)
    want = u * p[:, -1]
    k = np.minimum((p < want[:, None]).sum(axis=1), 127)
    rows = np.arange(len(c))
    before = np.where(k > 0, p[rows, np.maximum(k - 1, 0)], 0.0)
    part = np.clip((want - before) / np.maximum(p[rows, k] - before, 1e-300), 0, 1 - 1e-12)
    return np.minimum(cells[rows, k] + np.floor(part * stride), c).astype(np.int64)


def discount(ones: float, twos: float) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


def range_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Range (of n) of a 64-bit fingerprint; ranges are in key order."""
    return (((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def pair_range(u: np.ndarray, w: np.ndarray, n: int, hot: np.ndarray) -> np.ndarray:
    r = range_of(u, n)
    if len(hot):
        spread = np.isin(u, hot)
        r[spread] = (r[spread] + range_of(mix(w[spread]), min(n, 64))) % n
    return r


def as_block(ids, learns, texts) -> dict:
    return {"ids": ids, "learn": learns, "data": zstandard.ZstdCompressor(level=1).compress(b"".join(texts)), "sizes": [len(t) for t in texts]}


def tokens_of(data: bytes, sizes) -> tuple[np.ndarray, np.ndarray]:
    """(word fingerprints with an end token after every text, tokens per text) of joined texts."""
    out, count, at, group = [], [], 0, []

    def flush():
        joined = b"\n".join(group)
        h, starts, _ = word_hashes(joined)
        edge = np.searchsorted(starts, np.cumsum([0] + [len(g) + 1 for g in group]))
        out.append(np.insert(h, edge[1:], END))
        count.extend((np.diff(edge) + 1).tolist())
        group.clear()

    held = 0
    for n in sizes:
        group.append(data[at : at + n])
        at, held = at + n, held + n + 1
        if held > 1 << 19:
            flush()
            held = 0
    if group:
        flush()
    return (np.concatenate(out) if out else np.empty(0, dtype=np.uint64)), np.array(count, dtype=np.int64)


def _rows(columns: dict, schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def short(w: np.ndarray) -> bytes:
    """The upper 48 bits of word fingerprints, as six bytes each."""
    return np.ascontiguousarray((w >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def from_short(b: bytes) -> np.ndarray:
    """Fingerprints with the lower 16 bits 0."""
    out = np.zeros((len(b) // 6, 8), dtype=np.uint8)
    out[:, 2:] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1).astype(np.uint64)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys and each key's place among them; cheaper than a sort where most repeat."""
    code, found = pd.factorize(keys)
    order = np.argsort(found)
    place = np.empty(len(found), dtype=np.int64)
    place[order] = np.arange(len(found))
    return found[order], place[code]


class Block:
    """Distinct words and pairs of a block, and where its tokens are among them."""

    def __init__(self, row: dict):
        self.ids, self.sizes = row["ids"], row["sizes"]
        h, self.count = tokens_of(zstandard.ZstdDecompressor().decompress(row["data"]), self.sizes)
        self.starts = np.cumsum(self.count) - self.count
        learns = np.repeat(np.array(row["learn"], dtype=bool), self.count)
        self.words, at = _distinct(np.concatenate([h, [START, END]]))
        start_at, self.word_at = at[-2], at[:-2]
        before_at = np.roll(self.word_at, 1)
        if len(h):
            before_at[self.starts] = start_at
        n = len(self.words)
        pairs, self.pair_at = np.unique(before_at * n + self.word_at, return_inverse=True)
        self.pair_u, self.pair_w = pairs // n, pairs % n
        self.word_n = np.bincount(self.word_at[learns], minlength=n)
        self.pair_n = np.bincount(self.pair_at[learns], minlength=len(pairs))

    def dealt(self, n: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order of the pairs by range, context and word; their ranges in that order)."""
        r = pair_range(self.words[self.pair_u], self.words[self.pair_w], n, hot)
        order = np.argsort(r, kind="stable")
        return order, r[order]


def _parts(ranges: np.ndarray):
    """(range, slice) of sorted ranges."""
    cut = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), len(ranges)]
    return [(int(ranges[s]), slice(s, e)) for s, e in zip(cut, cut[1:]) if e > s]


_ROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("sender", pa.int64()), ("x", pa.binary()), ("y", pa.binary()), ("z", pa.binary()), ("n", pa.binary()), ("stats", pa.list_(pa.float64()))])
_ROW_SQL = "kind int, bucket bigint, sender bigint, x binary, y binary, z binary, n binary, stats array<double>"
WORDS, PAIRS, STATE, MAP, ROOT, TOTAL = 0, 1, 2, 3, 4, 5


class Rows:
    """Rows of the exchanges, gathered into one table."""

    def __init__(self):
        self.columns = {k: [] for k in _ROW.names}

    def add(self, kind, bucket, sender, x=b"", y=b"", z=b"", n=b"", stats=()):
        for k, v in zip(_ROW.names, (kind, bucket, sender, x, y, z, n, list(stats))):
            self.columns[k].append(v)

    def table(self) -> pa.Table:
        return pa.table([pa.array(self.columns[f.name], f.type) for f in _ROW], schema=_ROW)


def _pick(t: pa.Table, kind: int) -> list[dict]:
    return t.filter(pa.array(np.asarray(t.column("kind").to_numpy()) == kind)).to_pylist()


def _packed(v: np.ndarray, dtype) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(v.astype(dtype).tobytes())


def _unpacked(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype)


def _add_words(t: pa.Table) -> pa.Table:
    """Totals of words over all blocks, in each block's order."""
    rows, out = t.to_pylist(), Rows()
    keys = [np.frombuffer(r["x"], np.uint64) for r in rows]
    at = np.cumsum([0] + [len(k) for k in keys])
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(where, weights=np.concatenate([np.frombuffer(r["y"], np.uint32) for r in rows]), minlength=len(distinct)).astype(np.int64)
    back = total[where]
    for i, r in enumerate(rows):
        stats = (float(total.sum()), float((total > 0).sum()), float((total == 1).sum()), float((total == 2).sum())) if i == 0 else ()
        out.add(WORDS, r["bucket"], r["sender"], _packed(back[at[i] : at[i + 1]], np.int64), stats=stats)
    return out.table()


def _start_range(root_ranges: int, hot: np.ndarray):
    def start(t: pa.Table) -> pa.Table:
        """A range's restaurants from what the blocks sent, where each block's pairs are among them, and the first seating: a table a dish."""
        rows, out = t.to_pylist(), Rows()
        u = np.concatenate([np.repeat(from_short(r["x"]), _unpacked(r["n"], np.uint32)) for r in rows])
        w, c = np.concatenate([from_short(r["y"]) for r in rows]), np.concatenate([_unpacked(r["z"], np.uint32) for r in rows])
        order = np.lexsort((w, u))
        us, ws = u[order], w[order]
        new = np.concatenate([[True], (us[1:] != us[:-1]) | (ws[1:] != ws[:-1])])
        number = np.cumsum(new) - 1
        where = np.empty(len(u), dtype=np.int64)
        where[order] = number
        us, ws = us[new], ws[new]
        count = np.bincount(where, weights=c, minlength=len(us)).astype(np.int64)
        at, bucket = 0, rows[0]["bucket"]
        for r in rows:
            size = len(r["y"]) // 6
            out.add(MAP, bucket, r["sender"], _packed(np.diff(where[at : at + size], prepend=0), np.int32))
            at += size
        contexts, sizes = np.unique(us, return_counts=True)
        words, word_at = np.unique(ws, return_inverse=True)
        spread = np.flatnonzero(np.isin(contexts, from_short(short(hot))))
        stats = (float(count.sum()), float((count > 0).sum()), float((count == 1).sum()), float((count == 2).sum()))
        out.add(STATE, bucket, -1, _packed(sizes, np.uint32), _packed(word_at, np.uint32), _packed(count, np.uint32), _packed(np.stack([contexts[spread].view(np.int64), spread]), np.int64), stats)
        restaurants = Restaurants(out.columns["x"][-1], out.columns["y"][-1], out.columns["z"][-1], out.columns["n"][-1])
        _tell(out, restaurants, np.minimum(count, 1), bucket, words, root_ranges)
        return out.table()

    return start


class Restaurants:
    """Contexts of a range: dishes (context, word, customers) in order, and the contexts that other ranges hold too."""

    def __init__(self, x: bytes, y: bytes, z: bytes, n: bytes):
        sizes = _unpacked(x, np.uint32).astype(np.int64)
        self.context, self.word, self.c = np.repeat(np.arange(len(sizes)), sizes), _unpacked(y, np.uint32).astype(np.int64), _unpacked(z, np.uint32).astype(np.int64)
        self.shared = _unpacked(n, np.int64).reshape(2, -1)
        self.size, self.words = len(sizes), int(self.word.max(initial=-1)) + 1
        self.place = np.arange(len(self.c)) - np.repeat(np.cumsum(sizes) - sizes, sizes)

    def sums(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.context, weights=v, minlength=self.size)

    def elsewhere(self, own: np.ndarray, totals: dict[int, float]) -> np.ndarray:
        """What the other ranges hold of each context: total less own."""
        out = np.zeros(self.size)
        for u, k in self.shared.T.tolist():
            out[k] = totals.get(u, own[k]) - own[k]
        return out


def _tell(out: Rows, r: Restaurants, t: np.ndarray, bucket: int, words: np.ndarray | None, root_ranges: int) -> None:
    """A range's tables by word, to the root (``words``: fingerprints, or None to go by the order told before), and its part of shared contexts."""
    tables = np.bincount(r.word, weights=t, minlength=r.words)
    cut = _parts(range_of(words, root_ranges))
    for to, s in cut:
        out.add(ROOT, to, bucket, short(words[s]), _packed(tables[s], np.uint32))
    own_t, own_c = r.sums(t), r.sums(r.c)
    for u, k in r.shared.T.tolist():
        out.add(TOTAL, u, bucket, stats=(own_t[k], own_c[k]))


def _root_of(m: dict, answers: list[dict]) -> np.ndarray:
    """P(w) of a range's words, from the root ranges' answers in order."""
    net = np.concatenate([np.frombuffer(a["x"], np.float32) for a in sorted(answers, key=lambda a: a["sender"])]).astype(np.float64)
    return net / (m["theta"] + m["C0"]) + (m["theta"] + m["d0"] * m["T0"]) / (m["theta"] + m["C0"]) / (m["V"] + 1)


def _root_step(d0: float, theta: float, base: float, tables: float, sweep: int):
    def step(t: pa.Table) -> pa.Table:
        """The root's seating of the words of a root range: customers are the contexts' tables. Answers c - d t to each range."""
        rows, out = t.to_pylist(), Rows()
        keys = [from_short(r["x"]) for r in rows]
        at = np.cumsum([0] + [len(k) for k in keys])
        distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
        c = np.bincount(where, weights=np.concatenate([_unpacked(r["y"], np.uint32) for r in rows]), minlength=len(distinct)).astype(np.int64)
        n = len(c)
        t0 = seat(uniforms(distinct, 10_000 + sweep), c, np.full(n, theta / d0 + tables), np.full(n, math.log(d0 * base)), d0) if sweep else np.minimum(c, 1)
        net = (c - d0 * t0).astype(np.float32)[where]
        for i, r in enumerate(rows):
            out.add(ROOT, r["sender"], r["bucket"], net[at[i] : at[i + 1]].tobytes(), stats=(float(c.sum()), float(t0.sum())) if i == 0 else ())
        return out.table()

    return step


def _context_step(m: dict, totals: dict, sweep: int, root_ranges: int):
    def step(_, held: pa.Table, answers: pa.Table) -> pa.Table:
        """A sweep over a range's restaurants; keeps the seating and tells the root its tables."""
        out = Rows()
        if not held.num_rows:
            return out.table()
        state = held.to_pylist()[0]
        told = sorted(answers.to_pylist(), key=lambda a: a["sender"])
        r, p0 = Restaurants(state["x"], state["y"], state["z"], state["n"]), _root_of(m, told)
        words = np.concatenate([from_short(a["y"]) for a in told])
        t = _unpacked(state["t"], np.uint32).astype(np.int64) if state["t"] else np.minimum(r.c, 1)
        log_p = np.log(m["d"] * p0)
        tables = r.sums(t)
        other = r.elsewhere(tables, {u: v[0] for u, v in totals.items()})
        draw = np.flatnonzero(r.c > 1)
        with np.errstate(over="ignore"):
            u = uniforms(np.arange(len(draw), dtype=np.uint64) + np.uint64(state["bucket"]) * _GOLD, sweep)
        turn = r.place[draw] % TURNS
        for k in range(TURNS):
            now = draw[turn == k]
            if len(now):
                at = r.context[now]
                # the turn's dishes of one context are taken out together; with up to TURNS dishes that is one
                mine = np.bincount(at, weights=t[now], minlength=r.size)
                several = mine[at] - t[now]
                alpha = m["theta"] / m["d"] + tables[at] + other[at] - mine[at] + several
                new = seat(u[turn == k], r.c[now], alpha, log_p[r.word[now]], m["d"])
                tables += np.bincount(at, weights=new - t[now], minlength=r.size)
                t[now] = new
        out.add(STATE, state["bucket"], sweep, _packed(t, np.uint32))
        _tell(out, r, t, state["bucket"], words, root_ranges)
        return out.table()

    return step


def blocks_of(docs: DataFrame, block_bytes: int, id_col: str, text_col: str, fold: int) -> DataFrame:
    def cut(batches):
        from pyspark import TaskContext

        schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("learn", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("bytes", pa.int64()), ("data", pa.binary())])
        number, ids, learn, texts, held = TaskContext.get().partitionId() << 32, [], [], [], 0

        def row():
            b = as_block(ids, learn, texts)
            return _rows({"block": [number], "ids": [b["ids"]], "learn": [b["learn"]], "sizes": [b["sizes"]], "bytes": [held], "data": [b["data"]]}, schema).to_batches()[0]

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(name)
                learn.append(name is None or zlib.crc32(str(name).encode()) % fold != 0)
                texts.append((text.as_py() or "").encode("utf-8", "surrogatepass").translate(LOWER))
                held += len(texts[-1])
                if held >= block_bytes:
                    yield row()
                    number, ids, learn, texts, held = number + 1, [], [], [], 0
        if ids:
            yield row()

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(cut, "block bigint, ids array<bigint>, learn array<boolean>, sizes array<bigint>, bytes bigint, data binary")


def frequent_words(blocks: DataFrame, share: float, most: int = 1024, sample_bytes: int = 1 << 16) -> np.ndarray:
    """Fingerprints of at most ``most`` words that are frequent in the first ``sample_bytes`` of the blocks' texts, and the start."""

    def count(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                h, _, _ = word_hashes(zstandard.ZstdDecompressor().decompress(data)[:sample_bytes])
                k, n = np.unique(np.concatenate([h, [END]]), return_counts=True)
                top = n >= max(2, share / 4 * len(h))
                yield pa.RecordBatch.from_arrays([pa.array(k[top].view(np.int64)), pa.array(n[top] / max(1, len(h)))], names=["k", "s"])

    n = blocks.count()
    top = blocks.select("data").mapInArrow(count, "k bigint, s double").groupBy("k").agg((F.sum("s") / max(1, n)).alias("s")).where(F.col("s") > share).orderBy(F.desc("s"), "k").limit(most).collect()
    return np.unique(np.concatenate([np.array([r["k"] for r in top], dtype=np.int64).view(np.uint64), [START, END]]))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 10, theta: float = 1.0, sweeps: int = 3, burn_in: int = 1, block_bytes: int = 12 << 20, range_bytes: int = 24 << 20, max_ranges: int = 65_536) -> DataFrame:
    """Per row: id, n_tokens, n_known, train_tokens, base_score, score."""
    store = Scratch(docs.sparkSession)
    blocks = store.table(blocks_of(docs, block_bytes, id_col, text_col, fold))
    size = blocks.agg(F.sum("bytes")).first()[0] or 0
    ranges = min(max_ranges, max(16, -(-size // range_bytes)))
    word_ranges = root_ranges = max(4, ranges // 4)
    hot = frequent_words(blocks, 0.25 / ranges)
    take = lambda b: [{"ids": i, "learn": l, "sizes": s, "data": d} for i, l, s, d in zip(*(b.column(c).to_pylist() for c in ("ids", "learn", "sizes", "data")))]

    def send(batches):
        for batch in batches:
            for name, row in zip(batch.column("block").to_pylist(), take(batch)):
                b, out = Block(row), Rows()
                for to, s in _parts(range_of(b.words, word_ranges)):
                    out.add(WORDS, to, name, b.words[s].tobytes(), b.word_n[s].astype(np.uint32).tobytes())
                yield from out.table().to_batches()
                order, r = b.dealt(ranges, hot)
                u, w, c, out = b.pair_u[order], b.words[b.pair_w[order]], b.pair_n[order].astype(np.uint32), Rows()
                for to, s in _parts(r):
                    first = np.flatnonzero(np.concatenate([[True], u[s][1:] != u[s][:-1]]))
                    out.add(PAIRS, to, name, short(b.words[u[s][first]]), short(w[s]), _packed(c[s], np.uint32), _packed(np.diff(np.concatenate([first, [s.stop - s.start]])), np.uint32))
                yield from out.table().to_batches()

    start = _start_range(root_ranges, hot)
    gather = lambda t: _add_words(t) if t.column("kind")[0].as_py() == WORDS else start(t)
    begun = store.table(blocks.mapInArrow(send, _ROW_SQL).groupBy("kind", "bucket").applyInArrow(gather, _ROW_SQL))
    stats = {r["kind"]: [r[f"s{i}"] or 0.0 for i in range(4)] for r in begun.where(f"kind IN ({WORDS}, {STATE})").groupBy("kind").agg(*(F.sum(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(4))).collect()}
    of_words, of_pairs = stats.get(WORDS, [0.0] * 4), stats.get(STATE, [0.0] * 4)
    m = {"N": int(of_words[0]), "V": int(of_words[1]), "theta": theta, "d": discount(*of_pairs[2:]), "d0": discount(*of_words[2:]), "T0": of_words[1]}
    store.tidy()
    state = begun.where(f"kind = {STATE}").select("bucket", "x", "y", "z", "n")

    def shared(told: DataFrame) -> dict[int, tuple[float, float]]:
        """Tables and customers of the contexts that several ranges hold; as many rows as there are frequent words."""
        rows = told.where(f"kind = {TOTAL}").groupBy("bucket").agg(F.sum(F.get("stats", F.lit(0))).alias("t"), F.sum(F.get("stats", F.lit(1))).alias("c")).collect()
        return {r["bucket"]: (r["t"], r["c"]) for r in rows}

    def root(told: DataFrame, sweep: int) -> DataFrame:
        out = store.table(told.where(f"kind = {ROOT}").groupBy("bucket").applyInArrow(_root_step(m["d0"], theta, 1 / (m["V"] + 1), m["T0"], sweep), _ROW_SQL))
        found = out.agg(F.sum(F.get("stats", F.lit(0))), F.sum(F.get("stats", F.lit(1)))).first()
        m.update(C0=found[0] or 0.0, T0=found[1] or 0.0)
        return out

    told, kept, seats = begun, [], None
    answers = root(begun, 0)
    # a range's words as it told them at the start; the answers come in the same order
    names = begun.where(f"kind = {ROOT}").select(F.col("sender").alias("bucket"), F.col("bucket").alias("sender"), F.col("x").alias("y"))
    for sweep in range(1, sweeps + 1):
        now = state.withColumn("t", F.lit(None).cast("binary")) if seats is None else state.join(seats, "bucket")
        named = answers.drop("y").join(names, ["bucket", "sender"])
        totals = shared(told)
        old, old_answers, told = told, answers, store.table(now.groupBy("bucket").cogroup(named.groupBy("bucket")).applyInArrow(_context_step(dict(m), totals, sweep, root_ranges), _ROW_SQL))
        seats = told.where(f"kind = {STATE}").select("bucket", F.col("x").alias("t"))
        answers = root(told, sweep)
        if sweep - 1 <= burn_in:  # not averaged
            store.release(old_answers)
            if sweep > 1:
                store.release(old)
        store.tidy()
        if sweep > burn_in or sweep == sweeps:
            kept.append((seats, answers, dict(m), shared(told), told))

    def predict(models: list[tuple[dict, dict]]):
        def run(_, held: pa.Table, answers: pa.Table) -> pa.Table:
            """Averaged probabilities of a range's pairs, to each block in its order."""
            out = Rows()
            if not held.num_rows:
                return out.table()
            rows = held.to_pylist()
            s = next(r for r in rows if r["kind"] == STATE and r["sender"] < 0)
            r, told = Restaurants(s["x"], s["y"], s["z"], s["n"]), answers.to_pylist()
            customers, mean = r.sums(r.c), 0.0
            for k, (m, totals) in enumerate(models):
                t = _unpacked(next(x["x"] for x in rows if x["kind"] == STATE and x["sender"] == k), np.uint32).astype(np.float64)
                p0 = _root_of(m, [a for a in told if a["kind"] == k])
                tables = r.sums(t)
                all_t = tables + r.elsewhere(tables, {u: v[0] for u, v in totals.items()})
                all_c = customers + r.elsewhere(customers, {u: v[1] for u, v in totals.items()})
                mean = mean + (r.c - m["d"] * t + (m["theta"] + m["d"] * all_t[r.context]) * p0[r.word]) / (m["theta"] + all_c[r.context])
            logs = np.log10(mean / len(models)).astype(np.float32)
            for x in rows:
                if x["kind"] == MAP:
                    out.add(PAIRS, s["bucket"], x["sender"], logs[np.cumsum(_unpacked(x["x"], np.int32))].tobytes())
            return out.table()

        return run

    base = begun.where(f"kind IN ({STATE}, {MAP})").select("kind", "bucket", "sender", "x", "y", "z", "n")
    none = F.lit(None).cast("binary")
    for k, (seats, *_) in enumerate(kept):
        base = base.unionByName(seats.select(F.lit(STATE).alias("kind"), "bucket", F.lit(k).cast("long").alias("sender"), F.col("t").alias("x"), none.alias("y"), none.alias("z"), none.alias("n")))
    replies = None
    for k, (_, a, *_) in enumerate(kept):
        own = a.select(F.lit(k).alias("kind"), "bucket", "sender", "x")
        replies = own if replies is None else replies.unionByName(own)
    told_pairs = base.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(predict([(x[2], x[3]) for x in kept]), _ROW_SQL)
    # with the words' totals, so that the blocks' answers are all that the last stage reads of this
    found = store.table(begun.where(f"kind = {WORDS}").unionByName(told_pairs).select("kind", "bucket", F.col("sender").alias("block"), "x"))
    store.release(begun)
    for _, a, _, _, t in kept:
        store.release(a)
        store.release(t)
    store.tidy()

    def finish(_, mine: pa.Table, answers: pa.Table) -> pa.Table:
        out = {k: [] for k in ("id", "n_tokens", "n_known", "base_score", "score")}
        told = sorted(answers.to_pylist(), key=lambda a: a["bucket"])
        for row in take(mine):
            b = Block(row)
            word_c = np.concatenate([_unpacked(a["x"], np.int64) for a in told if a["kind"] == WORDS])
            order, _ = b.dealt(ranges, hot)
            p = np.empty(len(order))
            p[order] = np.concatenate([np.frombuffer(a["x"], np.float32) for a in told if a["kind"] == PAIRS])
            base = np.log10((word_c + 0.1) / (m["N"] + 0.1 * (m["V"] + 1)))
            cut = lambda v: np.add.reduceat(v, b.starts) if len(b.starts) else v[:0]
            out["id"] += b.ids
            out["n_tokens"] += b.count.tolist()
            out["n_known"] += cut((word_c[b.word_at] > 0).astype(np.int64)).tolist()
            out["base_score"] += cut(base[b.word_at]).tolist()
            out["score"] += cut(p[b.pair_at]).tolist()
        return pa.table({k: pa.array(v, pa.int64() if k in ("id", "n_tokens", "n_known") else pa.float64()) for k, v in out.items()})

    scored = blocks.drop("bytes").groupBy("block").cogroup(found.groupBy("block")).applyInArrow(finish, "id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(m["N"]).cast("long").alias("train_tokens"), "base_score", "score")


def op7_pitman_yor_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(read(spark, sf_dir, "documents"))
    out = scored.select("doc_id", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
    return out
