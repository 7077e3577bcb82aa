"""Toxicity by compression distance with two zstandard dictionaries.

A text is lower-cased and cut into windows of ``words`` words. Every window is compressed twice: with the
dictionary of ordinary text, and with that plus the dictionary of toxic text. Windows of ordinary text
come out alike; strings that only toxic text has cost literals with the first dictionary and one match
with the second, so the difference in length (the margin) marks them. A document's margins over 1, 2, ...
bytes are counted over all its windows, and a logistic curve calibrated on training rows kept out of the
dictionaries turns the counts into a score.

Training. Ordinary dictionary: zstandard's trainer over windows of ordinary rows. Toxic dictionary: the
spans of toxic rows' words whose byte 5-grams are over-represented by number of distinct texts
(``min_ratio``), frequent ones last, which is where matches are cheapest; ``spans="trained"`` leaves the
choice to zstandard's trainer instead. Labelled rows are drawn by a hash of their id, at most about ``max_toxic``
and ``max_ordinary`` of them (and never more than twice the two bounds); of a text of more than ``max_chars`` characters a stretch of that length is
read, at a place that the id's hash gives. The ordinary dictionary is trained on at most ``max_windows`` windows; either
dictionary has at most ``size`` bytes. So the driver's share of the work is bounded. Everything
else runs over all rows and whole texts, without a shuffle, in groups of ``GROUP`` windows however long a text is.

Null and empty texts have no window and get the score of no evidence. Rows with a null label teach
nothing; of several labels of a document the larger counts. Without toxic training rows all scores are 0.
Labels of ids that the documents lack are ignored, and so are other columns. Repeated rows are scored each; of an
id's rows the least text teaches. A null id is scored and not held out.
"""

from __future__ import annotations

import functools
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as z
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: A run that text hardly holds; before each window and at the dictionaries' end, so that no window is stored raw.
PAD = b"~#~#~~##~~#~#~## "
GRAM, LEVELS, GROUP = 5, 4, 20_000


def windows_of(w: list[bytes], words: int) -> list[bytes]:
    return [PAD + b" ".join(w[i : i + words]) + b" " for i in range(0, len(w), words)]


def windows(text: str | None, words: int = 4) -> list[bytes]:
    return windows_of((text or "").lower().encode("utf-8", "surrogatepass").split(), words)


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    words: int = 4


@functools.lru_cache(4)
def _compressors(ordinary: bytes, toxic: bytes):
    made = []
    for content in (ordinary + PAD, toxic + ordinary + PAD):
        p = z.ZstdCompressionParameters(format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, strategy=z.STRATEGY_BTLAZY2, min_match=5, hash_log=17, chain_log=18, search_log=8, target_length=999, window_log=18)
        made.append(z.ZstdCompressor(dict_data=z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=p))
    return made


def margins(model: Model, flat: list[bytes]) -> np.ndarray:
    """Bytes that the toxic dictionary saves on each window."""
    a, b = (np.fromiter(map(len, c.multi_compress_to_buffer(flat, threads=0)), dtype=np.int32, count=len(flat)) if flat else np.empty(0, dtype=np.int32) for c in _compressors(model.ordinary, model.toxic))
    return a - b


def features(model: Model, texts) -> np.ndarray:
    """Per text: 1, log of 1 + windows with a margin of at least 1, 2, ..., log of 1 + windows."""
    counts, flat, parts = np.zeros((len(texts), LEVELS + 1)), [], []

    def flush():
        m, at = margins(model, flat), 0
        for i, n in parts:
            own = m[at : at + n]
            counts[i] += (*((own >= t).sum() for t in range(1, LEVELS + 1)), n)
            at += n
        flat.clear()
        parts.clear()

    for i, t in enumerate(texts):
        words = (t or "").lower().encode("utf-8", "surrogatepass").split()
        for at in range(0, len(words), model.words * GROUP):
            own = windows_of(words[at : at + model.words * GROUP], model.words)
            flat += own
            parts.append((i, len(own)))
            if len(flat) >= GROUP:
                flush()
    flush()
    return np.concatenate([np.ones((len(texts), 1)), np.log1p(counts)], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the first column is the constant."""
    w, keep = np.zeros(x.shape[1]), np.diag([0.0] + [ridge] * (x.shape[1] - 1)) + 1e-6 * np.eye(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + keep, x.T @ (weight * (y - p)) - keep @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def grams(text: bytes) -> set[bytes]:
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


def contrast_spans(toxic: list[bytes], ordinary: list[bytes], min_ratio: float, min_share: float) -> list[bytes]:
    """Spans of toxic texts' words that ordinary texts lack, the most frequent last."""
    pos, neg, words = Counter(), Counter(), Counter()
    for t in toxic:
        pos.update(grams(t))
        words.update(set(t.split()))
    for t in ordinary:
        neg.update(grams(t))
    least = max(3, min_share * len(toxic))
    strong = {g for g, n in pos.items() if n >= least and n / len(toxic) >= min_ratio * (neg[g] + 0.5) / max(1, len(ordinary))}
    spans: Counter = Counter()
    for w, n in words.items():
        w = b" " + w + b" "
        count = [pos[g] if (g := w[k : k + GRAM]) in strong else 0 for k in range(len(w) - GRAM + 1)]
        if top := max(count, default=0):
            on = [k for k, v in enumerate(count) if 2 * v >= top]
            spans[w[on[0] : on[-1] + GRAM]] += n
    return [s for s, _ in sorted(spans.items(), key=lambda x: (x[1], x[0]))]


def _trained(samples: list[bytes], size: int) -> bytes:
    try:
        return z.train_dictionary(size, samples).as_bytes()
    except z.ZstdError:  # the trainer needs more samples; then the text itself is the dictionary
        return b"".join(samples)[-size:]


def fit(rows: list[tuple[str, int]], prior: float | None = None, words: int = 4, min_ratio: float = 15, min_share: float = 0.02, size: int = 32_768, max_windows: int = 60_000, spans: str = "contrast") -> Model:
    """Fit on (text, label) rows: two thirds make the dictionaries, one third the calibration. ``prior``: the share of toxic rows."""
    rows = sorted({(t or "", int(y)) for t, y in rows})
    rng = np.random.default_rng(7)
    order = rng.permutation(len(rows))
    rows = [rows[i] for i in order]
    toxic, ordinary = [t for t, y in rows if y], [t for t, y in rows if not y]
    if not toxic or not ordinary:
        return Model(b"", b"", (-50.0 if not toxic else 50.0, *[0.0] * (LEVELS + 1)), words)
    made = [x[: max(1, 2 * len(x) // 3)] for x in (toxic, ordinary)]
    low = [[b" " + b" ".join(t.lower().encode("utf-8", "surrogatepass").split()) + b" " for t in x] for x in made]
    flat = [w[len(PAD) - 1 :] for t in made[1] for w in windows(t, words)]
    base = _trained([flat[i] for i in rng.permutation(len(flat))[:max_windows]], size)
    if spans == "trained":
        bad = [w[len(PAD) - 1 :] for t in made[0] for w in windows(t, words)]
        toxic_dict = _trained([bad[i] for i in rng.permutation(len(bad))[:max_windows]], size)
    else:
        toxic_dict = b"\n".join(contrast_spans(*low, min_ratio, min_share))[-size // 2 :] + b"\n"
    model = Model(base, toxic_dict, (), words)
    rest = [x[len(m) :] or m for x, m in zip((toxic, ordinary), made)]
    y = np.array([1] * len(rest[0]) + [0] * len(rest[1]))
    share = prior if prior is not None else len(toxic) / len(rows)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return Model(base, toxic_dict, tuple(logistic(features(model, rest[0] + rest[1]), y, weight).tolist()), words)


def score(model: Model, texts) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features(model, texts) @ np.array(model.weights), -30, 30)))


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = 2000, max_ordinary: int = 4000, max_chars: int = 30_000, **fit_options) -> Model:
    """Fit on a bounded hash sample of the labelled rows that aren't held out."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~F.coalesce(held_out(), F.lit(False)))
    n = {r["t"]: r["n"] for r in usable.groupBy((F.col("toxic") > 0).alias("t")).agg(F.count("*").alias("n")).collect()}
    cut = F.when(F.col("toxic") > 0, min(1.0, max_toxic / max(1, n.get(True, 0)))).otherwise(min(1.0, max_ordinary / max(1, n.get(False, 0))))
    drawn = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < cut * (1 << 20)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * (max_toxic + max_ordinary))
    start = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - max_chars, F.lit(0)) + 1).cast("int") + 1
    few = docs.select("doc_id", F.substring("text", start, F.lit(max_chars)).alias("text")).join(F.broadcast(drawn), "doc_id")  # drawn: at most twice the bounds
    few = few.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))  # an id's repeated rows count once
    rows = [(r["text"], int(r["toxic"] > 0)) for r in few.select("text", "toxic").collect()]
    return fit(rows, n.get(True, 0) / max(1, sum(n.values())), **fit_options)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score, predicted. No shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for part in (b.slice(i, 500) for i in range(0, b.num_rows, 500)):
                s = score(sent.value, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def reject_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic, all columns kept. No shuffle, no join."""
    sent, schema = docs.sparkSession.sparkContext.broadcast(model), docs.schema
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            for part in (b.slice(i, 500) for i in range(0, b.num_rows, 500)):
                yield part.filter(pa.array(score(sent.value, part.column(at).to_pylist()) < 0.5))

    return docs.mapInArrow(run, schema)
