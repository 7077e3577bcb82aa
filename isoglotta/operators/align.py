"""Alignment of polyphonic characters across datasets.

Datasets name readings of the same glyph by ids of their own. Glyphs with one reading everywhere train a
shared low-rank space; readings of polyphones are embedded in it, compared across datasets, clustered glyph by
glyph, and clusters become labels. Only matrices over (locality, element, token) features reach the driver;
their number is checked. Readings stay distributed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .geo import upgma
from .impute import token_weights
from .lookup import concat_numbered, fill_from, halves, lookup, numbered

MAX_FEATURES = 6000


#: Rows of one spelling that ``align_chars`` keeps in one piece.
PIECE = 1000


def _pieces(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """(keys, name): lists of at most PIECE rows of the same keys, made by partition first so that none gets long."""
    rest = F.struct(*(c for c in rows.columns if c not in keys))
    lists = rows.select(*keys, rest.alias("x"), F.spark_partition_id().alias("part")).groupBy(*keys, "part").agg(F.collect_list("x").alias("x"))
    cut = F.transform(F.sequence(F.lit(0), ((F.size("x") - 1) / PIECE).cast("int")), lambda i: F.slice("x", i * PIECE + 1, PIECE))
    return lists.select(*keys, F.explode(cut).alias(name))


def align_chars(*chars: DataFrame) -> DataFrame:
    """Chained full outer join of (idx, simplified, traditional) lists: glyph, idx1, idx2, ... (-1 where absent).

    Joins on both spellings where both sides have them, else on what they share; null spellings match each other.
    Pieces of a spelling's rows meet and are dealt out, and only then become pairs: a frequent spelling is no single task's work.
    """
    spark = chars[0].sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    out = chars[0].withColumnRenamed("idx", "idx1")
    for i, c in enumerate(chars[1:], 2):
        c = c.withColumnRenamed("idx", f"idx{i}")
        keys = [k for k in ("simplified", "traditional") if k in out.columns and k in c.columns]
        if not keys:
            raise ValueError("the lists share no spelling")
        a, b = _pieces(out, keys, "a"), _pieces(c, keys, "b").withColumnsRenamed({k: f"_{k}" for k in keys})
        on = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
        pairs = a.join(b, on, "full").select(*(F.coalesce(k, f"_{k}").alias(k) for k in keys), "a", "b").repartition(tasks)
        pairs = pairs.select(*keys, F.explode_outer("a").alias("a"), "b").select(*keys, "a", F.explode_outer("b").alias("b"))
        spell = [F.col(k) if k in keys else F.col(f"{'a' if k in out.columns else 'b'}.{k}") for k in ("simplified", "traditional") if k in out.columns or k in c.columns]
        out = pairs.select(*spell, *(f"a.{x}" for x in out.columns if x.startswith("idx")), f"b.idx{i}")
    glyph = F.coalesce(*(k for k in ("simplified", "traditional") if k in out.columns), F.lit(""))
    return out.select(glyph.alias("glyph"), *(F.coalesce(x, F.lit(-1)).alias(x) for x in out.columns if x.startswith("idx")))


def embed(weights: Sequence[DataFrame], train: DataFrame, size: int = 10) -> list[DataFrame]:
    """Per dataset (cid, e0..): projections of its readings into the space that all datasets' training rows share.

    ``weights``: token weights (cid, col, token, w). ``train``: glyph, idx1, idx2, ... of glyphs with one reading in all.
    """
    spark, parts = train.sparkSession, []
    for i, w in enumerate(weights, 1):
        parts.append(train.select("glyph", F.col(f"idx{i}").alias("cid")).join(w, "cid").select("glyph", F.lit(i).alias("ds"), "col", "token", "w"))
    rows = reduce(DataFrame.unionByName, parts)
    features = rows.select("ds", "col", "token").distinct().limit(MAX_FEATURES + 1).toPandas().sort_values(["ds", "col", "token"]).reset_index(drop=True)
    if not len(features):
        raise ValueError("no glyph has one reading in all datasets")
    if len(features) > MAX_FEATURES:
        raise ValueError(f"more than {MAX_FEATURES} features")
    other = rows.select("glyph", *(F.col(c).alias(f"_{c}") for c in ("ds", "col", "token", "w")))
    gram = rows.join(other, "glyph").groupBy("ds", "col", "token", "_ds", "_col", "_token").agg(F.sum(F.col("w") * F.col("_w")).alias("g")).toPandas()
    number = {k: i for i, k in enumerate(features.itertuples(index=False, name=None))}
    g = np.zeros((len(features), len(features)))
    for a, b, c, d, e, f, v in gram.itertuples(index=False, name=None):
        g[number[a, b, c], number[d, e, f]] = v
    value, vector = np.linalg.eigh(g)
    keep = [k for k in np.argsort(-value)[:size] if value[k] > 1e-10 * max(1.0, value[-1])]
    v, out = vector[:, keep], []
    for i, w in enumerate(weights, 1):
        own = features[features.ds == i]
        p = np.linalg.pinv(v[own.index].T)
        table = pd.DataFrame(p, columns=[f"p{k}" for k in range(p.shape[1])]).assign(col=own.col.to_numpy(), token=own.token.to_numpy())
        joined = w.join(F.broadcast(spark.createDataFrame(table)), ["col", "token"])  # at most MAX_FEATURES rows
        out.append(joined.groupBy("cid").agg(*(F.sum(F.col("w") * F.col(f"p{k}")).alias(f"e{k}") for k in range(p.shape[1]))))
    return out


def base_embeddings(cells: DataFrame, na_threshold: float = 0.5, size: int = 10) -> DataFrame:
    """(cid, e0..) of every character: its readings projected on the first singular vectors (not centred) of the characters of
    which a share below ``na_threshold`` of the columns is missing."""
    w = token_weights(cells)
    all_columns = cells.select("col").distinct().count()
    known = cells.where(F.coalesce("value", F.lit("")) != "").groupBy("cid").agg(F.countDistinct("col").alias("n"))
    train = w.join(known.where((1 - F.col("n") / all_columns) < na_threshold).select("cid"), "cid", "left_semi")
    features = train.select("col", "token").distinct().limit(MAX_FEATURES + 1).toPandas().sort_values(["col", "token"]).reset_index(drop=True)
    if not 0 < len(features) <= MAX_FEATURES:
        raise ValueError(f"{len(features)} features; 1 to {MAX_FEATURES} are possible")
    number = {k: i for i, k in enumerate(features.itertuples(index=False, name=None))}
    other = train.select("cid", *(F.col(c).alias(f"_{c}") for c in ("col", "token", "w")))
    gram = train.join(other, "cid").groupBy("col", "token", "_col", "_token").agg(F.sum(F.col("w") * F.col("_w")).alias("g")).toPandas()
    g = np.zeros((len(features), len(features)))
    for a, b, c, d, v in gram.itertuples(index=False, name=None):
        g[number[a, b], number[c, d]] = v
    value, vector = np.linalg.eigh(g)
    v = vector[:, np.argsort(-value)[:size]]
    table = pd.DataFrame(v, columns=[f"p{k}" for k in range(v.shape[1])]).assign(col=features.col, token=features.token)
    joined = w.join(F.broadcast(cells.sparkSession.createDataFrame(table)), ["col", "token"])  # at most MAX_FEATURES rows
    found = joined.groupBy("cid").agg(*(F.sum(F.col("w") * F.col(f"p{k}")).alias(f"e{k}") for k in range(v.shape[1])))
    return cells.select("cid").distinct().join(found, "cid", "left").fillna(0.0)


def align_no_cid(cells: DataFrame, chars: DataFrame, data: DataFrame, to_simplified, to_traditional, na_threshold: float = 0.5, size: int = 10) -> DataFrame:
    """(did, seq, label, simplified, traditional): the base character of every reading of localities without character ids.

    ``cells``: base cells (cid, col, value). ``chars``: cid (integer), simplified, traditional (or none: then simplified forms decide).
    ``data``: did, seq, character, initial, final, tone; did and seq name a reading. A locality in which fewer than three
    characters change when simplified is written in simplified characters. Null labels: the base lacks the character.
    """
    e = base_embeddings(cells, na_threshold, size).persist()
    vectors = e.select(F.col("cid").cast("long").alias("position"), F.array(*(c for c in e.columns if c != "cid")).alias("v"))
    simple = to_simplified(F.col("character"))
    script = data.groupBy("did").agg((F.count_if(F.col("character") != simple) < 3).alias("is_simple"))
    d = data.join(script, "did").withColumn("simplified", F.when(F.col("is_simple"), F.col("character")).otherwise(simple)).withColumn("traditional", F.when(F.col("is_simple"), to_traditional(F.col("character"))).otherwise(F.col("character")))
    both = "traditional" in chars.columns
    by_trad = ~F.col("is_simple") if both else F.lit(False)
    # spellings of the two scripts are kept apart by a mark
    d = d.withColumn("glyph", F.when(by_trad, F.concat(F.lit("t"), "traditional")).otherwise(F.concat(F.lit("s"), "simplified")))
    spell = lambda m, c: chars.where(F.col(c).isNotNull()).select(F.col("cid").cast("long").alias("position"), F.concat(F.lit(m), c).alias("glyph"))
    listed = spell("s", "simplified").unionByName(spell("t", "traditional")) if both else spell("s", "simplified")
    tokens = F.filter(F.array(*(F.concat(F.lit(c + "="), F.col(c)) for c in ("initial", "final", "tone"))), lambda t: t.isNotNull() & ~t.endswith("="))
    found = annotate(vectors, listed, d.select("did", F.col("seq").alias("cid"), F.coalesce("glyph", F.lit("")).alias("glyph"), tokens.alias("tokens")))
    found = found.select("did", F.col("cid").alias("seq"), F.when(F.col("position") >= 0, F.col("position")).alias("label"))
    return d.select("did", "seq", "simplified", "traditional").join(found, ["did", "seq"]).select("did", "seq", "label", "simplified", "traditional")


def extend_characters(chars: DataFrame, labels: DataFrame, start: int) -> tuple[DataFrame, DataFrame]:
    """(characters, labels): spellings without a label become new characters from ``start`` on, in order, and label their readings."""
    new = labels.where("label IS NULL AND simplified IS NOT NULL AND traditional IS NOT NULL").select("simplified", "traditional").distinct()
    new = numbered(new, ["simplified", "traditional"], "label", start)
    return chars.unionByName(new.withColumnRenamed("label", "cid"), allowMissingColumns=True), fill_from(labels, new, ["simplified", "traditional"], "label")


def unify(with_ids: dict[str, DataFrame], without_ids: dict[str, DataFrame], glyphs: dict[str, DataFrame], to_simplified, to_traditional, size: int = 10) -> dict[str, DataFrame]:
    """The tables of an alignment job: charmap, characters, dialects, readings.

    Readings: did, cid (if the dataset has ids), character, initial, final, tone, seq. ``glyphs``: cid, character of the datasets with ids.
    charmap: dataset, cid, label. characters: cid (new), simplified, traditional, character. dialects: dataset, original_did, did.
    readings: dataset, did (new), cid (new), initial, final, tone.
    """
    names = list(with_ids)
    melted = [cells_of(d).persist() for d in with_ids.values()]  # read at every step
    listed = reduce(DataFrame.unionByName, (glyphs[n].select(F.lit(i).alias("ds"), "cid", to_simplified(F.col("character")).alias("glyph")) for i, n in enumerate(names, 1)))
    found = align([m.select("cid", "col", "value") for m in melted], listed, size).persist()
    charmap = reduce(DataFrame.unionByName, (found.where(F.col("ds") == i).join(glyphs[n].select("cid", "character"), "cid").select(F.lit(n).alias("dataset"), "cid", "label", F.col("glyph").alias("simplified"), F.col("character").alias("traditional")) for i, n in enumerate(names, 1)))
    chars = charmap.groupBy(F.col("label").alias("cid")).agg(F.min("simplified").alias("simplified"), F.min("traditional").alias("traditional"))
    dialects = concat_numbered(["original_did"], **{n: d.select(F.col("did").alias("original_did")).distinct() for n, d in (with_ids | without_ids).items()})
    out = []
    for n, d in with_ids.items():
        own = charmap.where(F.col("dataset") == n).select("cid", F.col("label").alias("new"))
        out.append(d.join(own, "cid").select(F.lit(n).alias("dataset"), "did", F.col("new").alias("cid"), "initial", "final", "tone"))
    if without_ids:
        base = reduce(DataFrame.unionByName, (m.join(charmap.where(F.col("dataset") == n).select("cid", "label"), "cid").select(F.col("label").alias("cid"), F.concat_ws("/", F.lit(n), "col").alias("col"), "value") for n, m in zip(names, melted)))
        base = base.groupBy("cid", "col").agg(F.concat_ws(" ", F.array_sort(F.collect_set("value"))).alias("value"))
        rows = reduce(DataFrame.unionByName, (d.select(F.struct(F.lit(n).alias("dataset"), "did").alias("did"), "seq", "character", "initial", "final", "tone") for n, d in without_ids.items()))
        keyed = rows.withColumn("did", F.to_json("did"))
        labels = align_no_cid(base.persist(), chars, keyed, to_simplified, to_traditional, size=size).persist()
        top = chars.agg(F.max("cid")).first()[0]
        chars, labels = extend_characters(chars, labels, 0 if top is None else top + 1)
        told = keyed.join(labels.select("did", "seq", "label"), ["did", "seq"]).where("label IS NOT NULL").withColumn("at", F.from_json("did", "dataset string, did string"))
        out.append(told.select("at.dataset", F.col("at.did").alias("did"), F.col("label").alias("cid"), "initial", "final", "tone"))
    key = dialects.select("dataset", F.col("original_did").alias("did"), F.col("did").alias("new"))
    readings = lookup(reduce(DataFrame.unionByName, out), key, ["dataset", "did"], "new", "_new").withColumn("did", F.col("_new")).drop("_new")
    # persisted frames are the caller's to free: they back all four tables
    return {"charmap": charmap, "characters": chars.withColumn("character", F.coalesce("traditional", "simplified")), "dialects": dialects, "readings": readings}


def cells_of(readings: DataFrame) -> DataFrame:
    """(cid, col, value): a column for each locality and element; a cell's distinct readings in order."""
    x = F.explode(F.array(*(F.struct(F.lit(e).alias("e"), F.col(e).alias("v")) for e in ("initial", "final", "tone"))))
    d = readings.where("did IS NOT NULL AND cid IS NOT NULL").select("did", "cid", x.alias("x")).where("x.v IS NOT NULL")
    return d.groupBy("cid", F.concat_ws("/", "did", "x.e").alias("col")).agg(F.concat_ws(" ", F.array_sort(F.collect_set("x.v"))).alias("value"))


def evaluate(readings: DataFrame, chars: DataFrame, seed: int = 0, size: int = 10) -> DataFrame:
    """One row: accuracy, correct, total of polyphones if the localities, in two random halves, are aligned as if ids were unknown.

    ``readings``: did, cid, initial, final, tone. ``chars``: cid, character. A reading counts if its character has
    several ids and both halves have this one.
    """
    half = halves(readings, "did", seed)
    parts = [readings.join(half.where(F.col("half") == i), "did", "left_semi") for i in (1, 2)]
    listed = reduce(DataFrame.unionByName, (chars.join(d.select("cid").distinct(), "cid", "left_semi").select(F.lit(i).alias("ds"), "cid", F.col("character").alias("glyph")) for i, d in enumerate(parts, 1)))
    labels = align([cells_of(d).persist() for d in parts], listed, size).persist()
    several = chars.join(chars.groupBy("character").agg(F.count("*").alias("n")).where("n > 1"), "character", "left_semi").select("cid")
    a, b = (labels.where(F.col("ds") == i).join(several, "cid", "left_semi").select("cid", "label") for i in (1, 2))
    return accuracy(a, b, ["cid"])


def unit(e: DataFrame) -> DataFrame:
    """(cid, v): embeddings of length one (zero ones stay zero)."""
    cols = [c for c in e.columns if c != "cid"]
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0)))
    return e.select("cid", F.array(*(F.coalesce(F.try_divide(F.col(c), norm), F.lit(0.0)) for c in cols)).alias("v"))


def half_square(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / 2


#: Distances of two vectors by name; embeddings are made unit vectors for the first.
METRICS = {
    "cosine": half_square,
    "euclidean": lambda a, b: F.sqrt(2 * half_square(a, b)),
    "sqeuclidean": lambda a, b: 2 * half_square(a, b),
    "cityblock": lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x),
    "chebyshev": lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))),
}


def polyphone_distance(glyphs: DataFrame, embeddings: Sequence[DataFrame], metric: str = "cosine") -> DataFrame:
    """(glyph, ds1, cid1, ds2, cid2, distance): readings of the same glyph in two datasets, ds1 < ds2.

    ``glyphs``: glyph, ds, cid. Cosine distance is half the squared distance of unit embeddings (0.5 if one is zero).
    """
    whole = lambda e: e.select("cid", F.array(*(c for c in e.columns if c != "cid")).alias("v"))
    all_ = reduce(DataFrame.unionByName, ((unit if metric == "cosine" else whole)(e).withColumn("ds", F.lit(i)) for i, e in enumerate(embeddings, 1)))
    r = glyphs.join(all_, ["ds", "cid"])
    a = r.select("glyph", F.col("ds").alias("ds1"), F.col("cid").alias("cid1"), F.col("v").alias("v1"))
    b = r.select(F.col("glyph").alias("g2"), F.col("ds").alias("ds2"), F.col("cid").alias("cid2"), F.col("v").alias("v2"))
    return a.join(b, (F.col("glyph") == F.col("g2")) & (F.col("ds1") < F.col("ds2"))).select("glyph", "ds1", "cid1", "ds2", "cid2", METRICS[metric]("v1", "v2").alias("distance"))


def cut_tree(d: np.ndarray, threshold: float) -> np.ndarray:
    """Clusters of average linkage while the distance stays below the threshold, numbered by first member."""
    n = len(d)
    member = {i: [i] for i in range(n)}
    for k, (a, b, h) in enumerate(upgma(d)):
        if h >= threshold:
            break
        member[n + k] = member.pop(a) + member.pop(b)
    label = np.zeros(n, dtype=int)
    for k, m in enumerate(sorted(member.values(), key=min)):
        label[m] = k
    return label


def cluster(distances: DataFrame, max_distance: float = 10.0, threshold: float = 0.3) -> DataFrame:
    """(glyph, ds, cid, label): average-linkage clusters of each glyph's readings; readings of one dataset are far apart.

    A glyph's readings are few (its pronunciations in each dataset), so a glyph is one group.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        keys = sorted({*zip(f.ds1, f.cid1), *zip(f.ds2, f.cid2)})
        at = {k: i for i, k in enumerate(keys)}
        d = np.full((len(keys), len(keys)), max_distance)
        for a, b, c, e, x in zip(f.ds1, f.cid1, f.ds2, f.cid2, f.distance):
            d[at[a, b], at[c, e]] = d[at[c, e], at[a, b]] = x
        return pd.DataFrame({"glyph": f.glyph.iloc[0], "ds": [k[0] for k in keys], "cid": [k[1] for k in keys], "label": cut_tree(d, threshold)})

    kind = distances.schema["cid1"].dataType.simpleString()
    return distances.groupBy("glyph").applyInPandas(run, f"glyph string, ds int, cid {kind}, label int")


def align(datasets: Sequence[DataFrame], glyphs: DataFrame, size: int = 10, threshold: float = 0.3, metric: str = "cosine") -> DataFrame:
    """(ds, cid, glyph, label): equal labels mean the same reading of the same glyph.

    ``datasets``: cells (cid, col, value) of each. ``glyphs``: ds (from 1), cid, glyph. A glyph with one reading in every
    dataset that has it is one label; one that only one dataset has keeps that dataset's own split; others are clustered.
    """
    n = F.count("*").over(Window.partitionBy("ds", "glyph"))
    g = glyphs.withColumn("n", n)
    per = g.groupBy("glyph").agg(F.max("n").alias("most"), F.countDistinct("ds").alias("sets"), F.first("cid").alias("any"))
    g = g.join(per, "glyph")
    weights = [token_weights(d) for d in datasets]
    mono = g.where((F.col("most") == 1) & (F.col("sets") == len(datasets)))
    train = reduce(lambda a, b: a.join(b, "glyph"), (mono.where(F.col("ds") == i).select("glyph", F.col("cid").alias(f"idx{i}")) for i in range(1, len(datasets) + 1)))
    poly = g.where((F.col("most") > 1) & (F.col("sets") > 1)).select("glyph", "ds", "cid")
    labels = cluster(polyphone_distance(poly, [e.persist() for e in embed(weights, train, size)], metric), threshold=threshold)
    own = F.row_number().over(Window.partitionBy("ds", "glyph").orderBy("cid")) - 1
    out = g.join(labels.withColumnRenamed("label", "c"), ["glyph", "ds", "cid"], "left")
    split = F.when(F.col("most") == 1, 0).when(F.col("sets") == 1, own).otherwise(F.coalesce("c", F.lit(1_000_000) + F.col("ds") * 1000 + own))
    text = out.select("ds", "cid", "glyph", F.concat("glyph", F.lit("\0"), split.cast("string")).alias("text")).persist()  # numbered and joined
    rank = numbered(text.select("text").distinct(), ["text"], "label")
    return text.join(rank, "text").select("ds", "cid", "glyph", "label")


def annotate(embeddings: DataFrame, chars: DataFrame, data: DataFrame) -> DataFrame:
    """(did, cid, position): positions in ``chars`` (position, glyph) for a locality's readings without ids.

    ``embeddings``: position, v. ``data``: did, cid, glyph, tokens (array). A glyph with one position takes it; else a
    least-squares map from one-hot tokens to embeddings, fitted on the locality's glyphs with one position, predicts, and the
    nearest embedding (cosine) of the same glyph is taken; unknown glyphs get -1. One locality is a group: its rows are its characters.
    """
    known = chars.join(embeddings, "position").groupBy("glyph").agg(F.sort_array(F.collect_list(F.struct("position", "v"))).alias("at"))
    joined = data.join(known, "glyph", "left")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        vocabulary = {t: i for i, t in enumerate(sorted({t for ts in f.tokens for t in ts}))}
        x = np.zeros((len(f), len(vocabulary) + 1))
        x[:, -1] = 1
        for i, ts in enumerate(f.tokens):
            for t in ts:
                x[i, vocabulary[t]] = 1
        options = [[] if a is None else list(a) for a in f["at"]]
        one = [i for i, a in enumerate(options) if len(a) == 1]
        many = [i for i, a in enumerate(options) if len(a) > 1]
        out = np.array([a[0]["position"] if len(a) == 1 else -1 for a in options], dtype=np.int64)
        if many:
            w = np.linalg.lstsq(x[one], np.array([options[i][0]["v"] for i in one]), rcond=None)[0] if one else None
            for i in many:
                v = np.array([o["v"] for o in options[i]])
                p = x[i] @ w if w is not None else np.zeros(v.shape[1])
                score = v @ p / np.maximum(np.linalg.norm(v, axis=1) * max(np.linalg.norm(p), 1e-12), 1e-12)
                out[i] = options[i][int(np.argmax(score))]["position"]
        return pd.DataFrame({"did": f.did, "cid": f.cid, "position": out})

    kinds = {c: data.schema[c].dataType.simpleString() for c in ("did", "cid")}
    return joined.groupBy("did").applyInPandas(run, f"did {kinds['did']}, cid {kinds['cid']}, position bigint")


def accuracy(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: share, number and total of equal labels."""
    j = a.join(b.withColumnRenamed("label", "other"), list(keys))
    ok = F.when(F.col("label") == F.col("other"), 1.0).otherwise(0.0)
    return j.agg(F.avg(ok).alias("accuracy"), F.sum(ok).cast("long").alias("correct"), F.count("*").alias("total"))
