import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isoglotta.operators import aggregates as A
from isoglotta.operators import align as AL
from isoglotta.operators import cells as C
from isoglotta.operators import encode as E
from isoglotta.operators import geo as G
from isoglotta.operators import impute as I
from isoglotta.operators import models as M
from isoglotta.operators import rbf as R
from isoglotta.operators import recon as X
from isoglotta.operators import rules as RU
from isoglotta.operators import similarity as S
from isoglotta.plans import catalogue as Q
from isoglotta.sources import datasets as D

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def readings(spark):
    rng = np.random.default_rng(3)
    rows = []
    for d in range(4):
        for c in range(40):
            for _ in range(1 + (rng.random() < 0.2)):
                if rng.random() < 0.9:
                    rows.append((f"d{d}", f"c{c}", "ptk"[(c + (rng.random() < 0.1)) % 3], "aiu"[(c // 3 + (rng.random() < 0.2)) % 3], str(1 + (c + d) % 4), len(rows)))
    rows.append((None, "c0", "p", "a", "1", len(rows)))
    rows.append(("d0", None, "p", "a", "1", len(rows)))
    return spark.createDataFrame(rows, "did string, cid string, initial string, final string, tone string, seq bigint").cache()


def test_first_and_joined_cells(spark):
    d = spark.createDataFrame([("23C57", "0028", None, "ɛ", "31", 1), ("23C57", "0028", "ɓ", "uɛ", None, 2), (None, "0028", "x", "x", "x", 0)], "did string, cid string, initial string, final string, tone string, seq int")
    assert tuple(C.transform(d, "cid", "did", C.ELEMENTS).first()) == ("0028", "23C57", "ɓ", "ɛ", "31")
    assert tuple(C.transform(d, "cid", "did", C.ELEMENTS, "join").first()) == ("0028", "23C57", "ɓ", "ɛ uɛ", "31")


def chi2_numpy(wide, a, b):
    out = []
    for i in range(3):
        x = wide[a]["initial final tone".split()[i]] + wide[a]["initial final tone".split()[(i + 1) % 3]]
        y = wide[b]["initial final tone".split()[i]] + wide[b]["initial final tone".split()[(i + 1) % 3]]
        vx, vy = sorted(set(x) - {""}), sorted(set(y) - {""})
        o = np.array([[((x == p) & (y == q)).sum() for q in vy] for p in vx], dtype=float)
        px, py = np.array([(x == p).sum() for p in vx]) / (x != "").sum(), np.array([(y == q).sum() for q in vy]) / (y != "").sum()
        n, dof = o.sum(), (len(vx) - 1) * (len(vy) - 1)
        e = n * np.outer(px, py)
        out.append(((o**2 / np.outer(px, py)).sum() / n - n - dof) / np.sqrt(2 * dof))
        del e
    return np.mean(out)


def test_chi2_matches_numpy(readings):
    c = C.transform(readings, "did", "cid", C.ELEMENTS)
    got = {(r["a"], r["b"]): r["value"] for r in S.chi2(c).collect()}
    f = c.toPandas().fillna("")
    ids = sorted(f.cid.unique())
    wide = {d: g.set_index("cid").reindex(ids).fillna("") for d, g in f.groupby("did")}
    assert len(got) == 16
    for (a, b), v in got.items():
        assert v == pytest.approx(chi2_numpy(wide, a, b), abs=1e-8)


def test_entropy_is_zero_only_where_determined(readings):
    c = C.transform(readings, "did", "cid", C.ELEMENTS)
    got = {(r["a"], r["b"]): r["value"] for r in S.entropy(c).collect()}
    assert len(got) == 16 and all(np.isfinite(v) for v in got.values())
    assert all(abs(got[d, d]) < 1e-9 for d in ("d0", "d1", "d2", "d3"))


def test_pairs_without_overlap_keep_a_null_row(spark):
    d = spark.createDataFrame([("a", "1", "p", "a", "1"), ("b", "2", "t", "i", "2")], "did string, cid string, initial string, final string, tone string")
    for m in (S.chi2(d), S.entropy(d)):
        got = {(r["a"], r["b"]): r["value"] for r in m.collect()}
        assert len(got) == 4 and got["a", "b"] is None


def test_normalised_similarity_has_a_unit_diagonal(readings):
    m = S.chi2(C.transform(readings, "did", "cid", C.ELEMENTS))
    n = {(r["a"], r["b"]): r["value"] for r in S.normalize_sim(m).collect()}
    assert all(n[d, d] == pytest.approx(1) for d in ("d0", "d1")) and n["d0", "d1"] == pytest.approx(n["d1", "d0"])
    assert all(r["value"] == pytest.approx(0, abs=1e-6) for r in S.sim2dist(m).where("a = b").collect())


def test_compliance_by_hand(spark):
    c = spark.createDataFrame([("d", "1", "p p", "a", "1"), ("d", "2", "p t", "a", "1"), ("e", "1", "k", "a", "1")], "did string, cid string, initial string, final string, tone string")
    r = spark.createDataFrame([(1, "initial", ["1"], ["2", "9"])], "rule_id int, element string, cid1 array<string>, cid2 array<string>")
    got = {x["did"]: x["value"] for x in RU.compliance(c, r).collect()}
    assert got == {"d": pytest.approx(2 * 1 / (2 * np.sqrt(2))), "e": 0.0}


def test_impute_fills_every_cell_with_a_known_token(readings):
    c = C.melt(C.transform(readings, "did", "cid", C.ELEMENTS)).select("cid", F.concat_ws("/", "did", "element").alias("col"), "value")
    out = I.impute(c)
    n_cid, n_col = c.select("cid").distinct().count(), c.select("col").distinct().count()
    assert out.count() == n_cid * n_col == out.where("value <> ''").count()
    assert out.where("imputed").join(c.select("col", "value").distinct(), ["col", "value"], "left_anti").count() == 0


@pytest.mark.parametrize("block", [2000, 7])
def test_imputation_and_distances_are_brute_force(spark, block):
    rng = np.random.default_rng(3)
    rows = [(f"c{c:02d}", f"d{d}/x", " ".join(rng.choice(list("pqrs"), 1 + (c + d) % 2))) for c in range(30) for d in range(5) if rng.random() < 0.6 and (c, d) != (4, 0)]
    rows += [("c04", "d0/x", "p"), ("z0", "d1/x", None), ("z1", "d4/x", "t")]
    cells = spark.createDataFrame(rows, "cid string, col string, value string")
    vec = {}
    for c, col, v in rows:
        own = sorted(set((v or "").split()))
        vec.setdefault(c, {}).update({(col, t): 1 / np.sqrt(len(own)) for t in own})
    value = {(c, col): v for c, col, v in rows if v}

    def dist(a, b):
        n = [np.sqrt(len({k[0] for k in vec[i]}) or 1) for i in (a, b)]
        return 0.0 if a == b else 1 - sum(w * vec[b].get(k, 0) for k, w in vec[a].items()) / n[0] / n[1]

    got = {(r["a"], r["b"]): r["distance"] for r in I.character_distances(cells, block=block).collect()}
    assert got.keys() == {(a, b) for a in vec for b in vec} and all(d == pytest.approx(dist(*k), abs=1e-9) for k, d in got.items())
    want = {}
    for c in vec:
        for col in {col for _, col, _ in rows}:
            if (c, col) in value:
                want[c, col] = (value[c, col], False)
                continue
            near = sorted((round(dist(c, b), 6), b) for b, k in value if k == col)[:3]
            score: dict = {}
            for d, b in near:
                for t in set(value[b, col].split()):
                    score[t] = score.get(t, 0) + 1 / (d + 1e-4)
            want[c, col] = (min(score, key=lambda t: (-round(score[t], 6), t)), True)
    assert {(r["cid"], r["col"]): (r["value"], r["imputed"]) for r in I.impute(cells, block=block).collect()} == want


def test_whole_table_queries_cover_all_parts_and_localities(spark):
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    parts, dids = {str(r["p_partkey"]) for r in spark.read.parquet(f"{SF}/part.parquet").collect()}, {str(k) for k in range(25)}
    r = Q.readings(spark, SF).select("did", "cid").distinct().toPandas()
    got = Q.QUERIES["impute_cells_all"](spark, SF).toPandas()
    assert set(r.cid) == set(got.cid) <= parts and set(r.did) == {c.split("/")[0] for c in got["col"]} <= dids
    assert len(got) == r.cid.nunique() * r.did.nunique() * 3 and not got.duplicated(["cid", "col"]).any()
    assert set(Q.QUERIES["recon_tree"](spark, SF).toPandas().cid) == set(r.cid)
    assert Q.QUERIES["character_distances_all"](spark, SF).count() == r.cid.nunique() ** 2


def test_alignment_covers_all_parts_and_localities(spark):
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    r = Q.readings(spark, SF).select("did", "cid").distinct().toPandas()
    got = Q.QUERIES["align_datasets"](spark, SF).toPandas()
    want = {(1 + int(d) % 2, c) for d, c in zip(r.did, r.cid)}
    assert set(zip(got.ds, got.cid)) == want and len(got) == len(want)
    cells, _ = Q._halves(spark, SF)
    assert {x["col"].split("/")[0] for c in cells for x in c.select("col").distinct().collect()} == set(r.did)


def test_make_dict_and_codes(spark):
    d = spark.createDataFrame([("b",), ("b",), ("a",), ("",), (None,), ("c",), ("c",), ("c",)], "v string")
    assert [tuple(r) for r in E.make_dict(d, "v", 2, sort="frequency").orderBy("code").collect()] == [("c", 3, 0), ("b", 2, 1)]
    assert sorted(r["code"] for r in E.ordinal(d, "v").collect()) == [-1, -1, 0, 1, 1, 2, 2, 2]


def test_value_disjoint_split(spark):
    d = spark.range(1000).select((F.col("id") % 37).alias("v"), "id")
    s = E.value_disjoint_split(d, "v", 0.8, 5)
    assert s.groupBy("v").agg(F.countDistinct("train").alias("k")).where("k > 1").count() == 0
    assert {r["train"] for r in s.select("train").distinct().collect()} == {True, False}
    assert s.exceptAll(E.value_disjoint_split(d, "v", 0.8, 5)).count() == 0


def test_upgma_and_leaf_order():
    x = np.array([0.0, 0.1, 5.0, 5.2, 20.0])
    d = np.abs(x[:, None] - x[None, :])
    assert [m[:2] for m in G.upgma(d)][:2] == [(0, 1), (2, 3)]
    assert sorted(G.leaf_order(d)) == [0, 1, 2, 3, 4] and G.leaf_order(d)[0] in (0, 4)
    assert AL.cut_tree(d, 1.0).tolist() == [0, 0, 1, 1, 2]


def test_rbf_interpolates_its_points(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 0.0, 2.0, 1.0), (3, 2.0, 0.0, 1.0), (4, 2.0, 2.0, 0.0)], "did int, lat double, lon double, value double")
    at = p.select(F.lit(0).cast("bigint").alias("row"), F.col("did").cast("bigint").alias("col"), "lat", "lon")
    got = {r["col"]: r["value"] for r in G.isogloss(p, at).collect()}
    assert got == {1: pytest.approx(0, abs=1e-6), 2: pytest.approx(1), 3: pytest.approx(1), 4: pytest.approx(0, abs=1e-6)}
    area = G.area(p.withColumn("label", F.col("value").cast("string")), at).collect()
    assert {r["col"]: r["value"] for r in area} == {1: "0.0", 2: "1.0", 3: "1.0", 4: "0.0"}


def test_rbf_takes_more_points_than_a_dense_matrix(spark, monkeypatch):
    rng = np.random.default_rng(0)
    near = np.stack([np.repeat(np.arange(5.0), 10), np.tile(np.arange(10) * 1e-4, 5)], axis=1)
    x = np.vstack([near, rng.random((149, 2)) * 5, near[:1]])  # the last one is where another is
    y = np.stack([np.arange(200) % 2, np.arange(200) % 3], axis=1).astype(float)
    at = rng.random((50, 2)) * 5
    want = {c: R.weights(spark, x, y, c) for c in (True, False)}
    monkeypatch.setattr(R, "DENSE", 20)
    monkeypatch.setattr(R, "BLOCK", 10_000)
    for limit in (R.LOCAL, 0):  # in the driver, on executors
        monkeypatch.setattr(R, "LOCAL", limit)
        for c, (px, w, k) in want.items():
            qx, v, m = R.weights(spark, x, y, c)
            assert R.values(at, qx, v) * (1 - 2 * c) + m == pytest.approx(R.values(at, px, w) * (1 - 2 * c) + k, abs=1e-6)


def test_rbf_of_places_far_apart(spark, monkeypatch):
    x = np.stack([np.repeat(np.arange(10) * 1e5, 20), np.tile(np.arange(20) * 1e-4, 10)], axis=1)
    y = np.stack([np.arange(200) % 2, np.arange(200) % 3], axis=1).astype(float)
    monkeypatch.setattr(R, "DENSE", 20)
    for limit in (R.LOCAL, 0):  # in the driver, on executors
        monkeypatch.setattr(R, "LOCAL", limit)
        for c in (True, False):
            px, w, k = R.weights(spark, x, y, c)
            assert (R.values(x, px, w) * (1 - 2 * c) + k).astype(float) == pytest.approx(y, abs=2e-6)


def test_rbf_of_over_5000_points(spark):
    p = spark.range(5_050).select("id", (F.col("id") % 71).cast("double").alias("lat"), F.floor(F.col("id") / 71).cast("double").alias("lon"), (F.col("id") % 2).cast("double").alias("value"))
    at = p.where("id % 101 = 0").select(F.col("id").alias("row"), F.col("id").alias("col"), "lat", "lon")
    for r in G.isogloss(p, at, key="id").collect():
        assert r["value"] == pytest.approx(r["row"] % 2, abs=1e-6)


def test_area_of_over_5000_points(spark):
    p = spark.range(5_050).select("id", (F.col("id") % 71).cast("double").alias("lat"), F.floor(F.col("id") / 71).cast("double").alias("lon"), (F.col("id") % 3).cast("string").alias("label"))
    at = p.where("id % 101 = 0").select(F.col("id").alias("row"), F.col("id").alias("col"), "lat", "lon")
    assert all(r["value"] == str(r["row"] % 3) for r in G.area(p, at, key="id").collect())


def test_align_shares_labels_of_equal_readings(spark):
    rng = np.random.default_rng(0)
    cells, glyphs = [[], []], []
    for g in range(60):
        for ds in (0, 1):
            for k in range(2 if g < 5 else 1):
                cid = f"{g}-{k}"
                glyphs.append((ds + 1, cid, f"g{g}"))
                sound = "ab"[k] if g < 5 else rng.choice(list("abcd"))
                for col in ("x", "y"):
                    cells[ds].append((cid, f"{ds}{col}", (sound if g < 5 else "abcd"[g % 4]) + col))
    frames = [spark.createDataFrame(c, "cid string, col string, value string") for c in cells]
    out = AL.align(frames, spark.createDataFrame(glyphs, "ds int, cid string, glyph string"), size=4).toPandas()
    for ds in (1, 2):
        assert out[out.ds == ds].label.is_unique
    assert out.groupby("label").glyph.nunique().max() == 1
    both = out[out.ds == 1].merge(out[out.ds == 2], on="cid")
    assert (both.label_x == both.label_y).all()


def test_bilinear_model_learns(spark):
    rows = [(f"d{d}", f"c{c}", "xy"[(d + c) % 2]) for d in range(4) for c in range(8)] + [(None, None, None)]
    data = spark.createDataFrame(rows, "did string, cid string, final string").repartition(2)
    p = M.Processor.build(data, ["did"], ["cid"], ["final"])
    e = M.known_rows(p.encode(data))
    assert e.count() == 32 and p.sizes() == {"dialects": [5], "chars": [9], "targets": [3]}
    m = M.BilinearEncoder(p.sizes(), 4, 4, 4, seed=1)
    losses = m.fit(e, epochs=60)
    assert losses[-1] < 0.5 * losses[0]
    r = m.evaluate(e)
    assert r["accuracy"][0] > 0.9 and m.predict(e, ["did", "cid"]).count() == 32


def test_vocabularies_have_no_cap(spark):
    data = spark.range(100_003).select(F.lit("d").alias("did"), F.col("id").cast("string").alias("cid"), F.lit("x").alias("final"))
    p = M.Processor.build(data, ["did"], ["cid"], ["final"])
    assert p.sizes()["chars"] == [100_004] and M.known_rows(p.encode(data)).count() == 100_003


def test_gradients_match_differences():
    sizes = {"dialects": [4], "chars": [5], "targets": [3, 4]}
    m = M.BilinearEncoder(sizes, 3, 4, 4, residual=True, seed=2)
    rng = np.random.default_rng(1)
    d, c, t = rng.integers(1, 4, (6, 1)), rng.integers(1, 5, (6, 1)), rng.integers(0, 3, (6, 2))
    g, loss, _, _ = m.gradients(d, c, t)
    for k in m.p:
        i = tuple(rng.integers(0, n) for n in m.p[k].shape)
        m.p[k][i] += 1e-6
        assert (m.gradients(d, c, t)[1] - loss) / 1e-6 == pytest.approx(g[k][i], abs=1e-3)
        m.p[k][i] -= 1e-6


def test_viterbi_prefers_allowed_paths():
    t = M.LinearChain(["A", "B"], {("x", "A"): 1.0, ("y", "B"): 1.0}, {("A", "A"): -9.0})
    assert t.decode([["x"], ["y"], ["x"]]) == ["A", "B", "A"] and t.decode([["x"], ["x"]]) in (["A", "B"], ["B", "A"])


def test_recon_tree_separates_classes(spark):
    rows = [(f"c{c}", f"d{d}", "pt"[c % 2]) for c in range(12) for d in range(3) if (c, d) != (0, 0)]
    got = X.reconstruct(spark.createDataFrame(rows, "cid string, col string, value string")).toPandas()
    assert got.proto.nunique() == 2 and len(got) == 12


def test_recon_grows_a_tree_for_each_element(spark):
    value = {"initial": lambda c: "pt"[c % 2], "final": lambda c: "aiu"[c // 4], "tone": lambda c: "1"}
    rows = [(f"c{c:02d}", f"d{d}/{e}", v(c)) for c in range(12) for d in range(3) for e, v in value.items()]
    got = X.reconstruct_elements(spark.createDataFrame(rows, "cid string, col string, value string")).toPandas()
    assert {e: got[e].nunique() for e in value} == {"initial": 2, "final": 3, "tone": 1}


def test_file_dataset_and_catalog(spark, tmp_path):
    for did, n in (("08533", 2), ("23C57", 3)):
        (tmp_path / f"{did}.csv").write_text("character,cid,initial,final,tone\n" + "".join(f"火,{i:04d},h,u,{i}\n" for i in range(n)))
    (tmp_path / ".dialects").write_text("did,name\n08533,x\n")
    d = D.Catalog(spark).get(str(tmp_path))
    assert len(d) == 2 and d.data.count() == 5 and {r["cid"] for r in d.data.collect()} >= {"0000", "0002"}
    assert d.filter(["23C57"]).data.count() == 3
    with pytest.raises(KeyError):
        d.filter(["none"])
    c = D.cached(d, spark, str(tmp_path / "cache"))
    assert c.data.count() == 5 and c.filter(["08533"]).count() == 2
    with pytest.warns(UserWarning):
        assert D.Catalog(spark).get(str(tmp_path / "missing")) is None
    assert len(D.Dataset(None)) == 0 and D.Dataset(None).filter(["a"]).data is None


def test_dictionary_info_json(spark, tmp_path):
    p = tmp_path / "info.json"
    p.write_text('{"1935南昌": {"文件格式": "x", "地圖集二分區": "贛語-昌都片", "簡稱": "南昌", "語言": "南昌話", "經緯度": "115.9,28.7", "聲調": "{\\"1\\": [\\"42\\", \\"\\", \\"\\", \\"陰平\\"]}"}, "1800老": {"文件格式": "x", "簡稱": "老"}, "普通話": {"簡稱": "普"}, "甲": {"文件格式": "漢典", "簡稱": "甲"}}')
    info = D.modern_entries(D.read_dictionary_info(spark, str(p)))
    row = D.dictionary_dialects(info).first()
    assert info.count() == 1 and (row["did"], row["group"], row["cluster"], row["latitude"], row["longitude"]) == ("南昌", "贛語", "昌都片", 28.7, 115.9)
    tones = D.dictionary_tones(info.withColumn("did", F.col("簡稱"))).first()
    assert tuple(tones) == ("南昌", "1", "42", "陰平")


def test_survey_json(spark):
    t = spark.createDataFrame([('{"dialectObj": [{"provinceCode": "11", "cityList": [{"_id": "a"}, {"_id": "b"}]}], "minorityObj": []}',)], "value string")
    assert sorted(tuple(r) for r in D.parse_survey_sites(t).collect()) == [("dialectObj", "11", "a"), ("dialectObj", "11", "b")]
    t = spark.createDataFrame([('{"resourceList": [{"sounder": "m", "type": "z", "items": [{"iid": "1", "name": "火", "oid": "o", "records": ["r"]}]}]}',)], "value string")
    assert D.parse_survey_items(t).first()["records"] == '["r"]'


def test_extent_ignores_what_is_not_finite(spark):
    d = spark.createDataFrame([(0.0, 0.0), (10.0, 20.0), (None, 5.0), (float("nan"), 5.0), (float("inf"), 1.0)], "lat double, lon double")
    assert tuple(A.extent(d).first()) == (pytest.approx(-0.1), pytest.approx(10.1), pytest.approx(-0.2), pytest.approx(20.2))
    assert isinstance(d.toPandas(), pd.DataFrame)


def test_trees_are_those_of_one_table_and_have_no_limit_of_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    kind = rng.integers(0, 6, 300)
    table = {f"d{d}/{e}": np.where(rng.random(300) < 0.8, (kind + d) % m, rng.integers(0, m, 300)) for d in range(4) for e, m in (("initial", 3), ("final", 5), ("tone", 2))}
    rows = [(c, col, f"v{v}") for col, vs in table.items() for c, v in enumerate(vs.tolist()) if rng.random() < 0.8] + [(300, "d0/tone", None)]
    cells = spark.createDataFrame(rows, "cid int, col string, value string").repartition(5)
    monkeypatch.setattr(X, "MAX_ROWS", 50)
    f = X.impute_frequent(cells).toPandas().pivot(index="cid", columns="col", values="value").sort_index()
    x, _, blocks = X.one_hot(f)
    assert len(f) == 301 > X.MAX_ROWS
    for counts in (X.COUNTS, 40_000):  # all at once, and some features of a node at a time
        monkeypatch.setattr(X, "COUNTS", counts)
        got = X.reconstruct(cells, 3, 0.002).toPandas().sort_values("cid")
        want = X.grow(x, x, blocks, 3, 0.002)
        assert want.max() > 5 and got.proto.tolist() == want.tolist()
        got = X.reconstruct_elements(cells).toPandas().sort_values("cid")
        for e, least in (("initial", 0.002), ("final", 0.002), ("tone", 0.01)):
            y, _, own = X.one_hot(f[[c for c in f.columns if c.endswith(e)]])
            assert got[e].tolist() == X.grow(x, y, own, 3, least).tolist()


def test_characters_kept_with_their_rows_learn_as_one_model(spark):
    rng = np.random.default_rng(4)
    rows = [(f"d{d}", f"c{c}", "xyz"[(d + c) % 3] if rng.random() < 0.8 else None, "uv"[c % 2] if rng.random() < 0.8 else "") for d in range(4) for c in range(9)]
    rows += [(None, "c1", "x", "u"), ("", "c2", "y", "v"), ("d1", None, "z", "u"), ("d2", "only", None, None)]
    data = spark.createDataFrame(rows, "did string, cid string, t string, u string").repartition(3)
    p = M.Processor.build(data, ["did"], ["cid"], ["t", "u"])
    e, m = p.encode(data), M.BilinearEncoder(p.sizes(), 5, 5, 5)
    rng = np.random.default_rng(7)
    m.p |= {"d0": rng.normal(0, 0.1, (5, 5)), "t0": rng.normal(0, 0.1, (4, 5)), "t1": rng.normal(0, 0.1, (3, 5)), "w": rng.normal(0, 0.1, (5, 5, 5))}
    names = spark.createDataFrame([(k, v) for k, v in enumerate([None, *p.chars["cid"]])], "k int, cid string").select("k", F.xxhash64("cid", F.lit(7)).alias("key")).orderBy("k").toPandas()
    m.p["c0"] = M.draws(names.key.to_numpy(), 5)
    want = m.fit(M.known_rows(e), epochs=30)
    out, losses = M.fit_characters(data, "did", "cid", ["t", "u"], 5, 30, seed=7)
    assert losses == pytest.approx(want, rel=1e-6) and losses[-1] < 0.8 * losses[0]
    key = lambda r: (r["did"] or repr(r["did"]), r["cid"] or "", list(r["predicted"]))
    assert sorted(map(key, out.collect())) == sorted(map(key, m.predict(e, ["did", "cid"]).collect()))
    assert 0.08 < M.draws(np.arange(1000), 20).std() < 0.12


def test_glyphs_of_many_rows_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(AL, "PIECE", 7)
    a = [(i, "s" if i % 9 else None, "t" if i % 2 else None) for i in range(60)]
    b = [(100 + i, "s" if i % 5 else None) for i in range(40)]
    c = [(200 + i, "s", "tu"[i % 2]) for i in range(10)] + [(300, None, None)]
    one, two, three = (spark.createDataFrame(x, k).repartition(3) for x, k in ((a, "idx long, simplified string, traditional string"), (b, "idx long, simplified string"), (c, "idx long, simplified string, traditional string")))
    ab = [(s, t, i, j) for i, s, t in a for j, u in b if s == u]
    want = [(s or t or "", i, j, k) for s, t, i, j in ab for k, u, v in c if (s, t) == (u, v)]
    want += [(s or t or "", i, j, -1) for s, t, i, j in ab if (s, t) not in {x[1:] for x in c}]
    want += [(u or v or "", -1, -1, k) for k, u, v in c if (u, v) not in {x[:2] for x in ab}]
    found = AL.align_chars(one, two, three)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    # one spelling of 300 x 300 rows: no task makes them all
    same = lambda n: spark.range(n).select(F.col("id").alias("idx"), F.lit("s").alias("simplified"))
    sizes = AL.align_chars(same(300), same(300)).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 90_000 and max(r["count"] for r in sizes) < 30_000


def test_a_task_goes_through_many_blocks_and_keeps_the_nearest(spark):
    rng = np.random.default_rng(9)
    rows = [(c, f"d{d}", str(rng.choice(list("pq")))) for c in range(90) for d in range(4) if rng.random() < 0.7] + [(c, "rare", "r") for c in (3, 50)]
    cells = spark.createDataFrame(rows, "cid int, col string, value string")
    key = lambda f: sorted((r["cid"], r["col"], r["b"], r["value"], round(r["d"], 6)) for r in f.collect())
    want = key(I.nearest_known(cells))
    assert {x[2] for x in want if x[1] == "rare"} == {3, 50} and len(want) > 88 * 2
    for turns in (1, 3, 32):
        assert key(I.nearest_known(cells, block=10, turns=turns)) == want
    # blocks travel packed: 53 known cells of a character are some hundred bytes
    wide = I._profiles(spark.range(500).select(F.col("id").cast("string").alias("cid"), F.explode(F.sequence(F.lit(1), F.lit(53)).cast("array<string>")).alias("col"), F.lit("v").alias("value")))
    assert len(I._pack(wide.toArrow())) < 500 * 400


def test_distances_leave_python_as_a_row_a_character_and_block(spark):
    rows = [(c, f"d{d}", "pqr"[(c * d) % 3]) for c in range(25) for d in range(3) if (c + d) % 4]
    cells = spark.createDataFrame(rows, "cid int, col string, value string")
    exact = {(r["a"], r["b"]): r["distance"] for r in I.character_distances(cells, block=10).collect()}
    rounded = I.character_distances(cells, block=10, digits=6)
    got = {(r["a"], r["b"]): r["distance"] for r in rounded.collect()}
    assert len(got) == 25 * 25 == rounded.count() and got == {k: pytest.approx(round(v, 6), abs=1e-12) for k, v in exact.items()}
    assert "posexplode" in rounded._jdf.queryExecution().toString()


def test_distances_compare_two_blocks_once_and_leave_python_as_tiles(spark):
    rows = [(c, f"d{d}", " ".join("pqrs"[(c * d + k) % 4] for k in range(1 + c % 3))) for c in range(30) for d in range(4) if (c + d) % 4]
    cells = spark.createDataFrame(rows, "cid int, col string, value string")
    met = I._pairs(cells, None, lambda x, ys: pa.table({"a": [sorted(x[0])] * len(ys), "b": [sorted(y[0]) for y in ys]}), "a array<bigint>, b array<bigint>", 10).collect()
    blocks = {tuple(r[k]) for r in met for k in "ab"}
    assert sorted(c for x in blocks for c in x) == list(range(30)) and len(blocks) > 1
    assert len(met) == len(blocks) * (len(blocks) + 1) // 2 == len({frozenset((tuple(r["a"]), tuple(r["b"]))) for r in met})
    # another table as the other side compares all blocks; both ways give the same pairs
    for digits in (None, 6, 12):
        frame = I.character_distances(cells, block=10, digits=digits)
        once = {(r["a"], r["b"]): r["distance"] for r in frame.collect()}
        both = {(r["a"], r["b"]): r["distance"] for r in I.character_distances(cells, cells, block=10, digits=digits).collect()}
        assert len(once) == 900 == frame.count() and once.keys() == both.keys()
        assert all(once[k] == pytest.approx(0.0 if k[0] == k[1] else d, abs=1e-12) and once[k] == once[k[::-1]] for k, d in both.items())


def test_imputation_compares_characters_with_the_same_cells_once(spark):
    rng = np.random.default_rng(12)
    kinds = [[(f"d{d}", " ".join(rng.choice(list("pqr"), 1 + d % 2))) for d in range(5) if rng.random() < 0.6] for _ in range(8)] + [[("d0", " "), ("d1", "p")]]
    kind = {f"c{k:02d}": kinds[k * 7 % 9] for k in range(60)} | {"none0": [], "none1": []}
    cells = spark.createDataFrame([(c, col, v) for c, own in kind.items() for col, v in own or [("d0", None)]], "cid string, col string, value string")
    every, sets = I._alike(cells, 3)
    assert every.count() == 62 and sets.count() == len({tuple(k) for k in kind.values()}) < 11
    assert all(r["members"] == sorted(r["members"])[:3] and r["cid"] == r["members"][0] for r in sets.collect())
    run = lambda x, ys: pa.table({"n": pa.array([len(x[0]) * sum(len(y[0]) for y in ys)], pa.int64())})
    met = sum(r["n"] for r in I._pairs(sets, sets, run, "n bigint", 4, 2, I._set_profiles).collect())
    assert met == sets.count() ** 2  # not 62 * 62 pairs
    vec = {c: {(col, t): 1 / np.sqrt(len(set(v.split()))) for col, v in own for t in set(v.split())} for c, own in kind.items()}
    dist = lambda a, b: 1 - sum(w * vec[b].get(k, 0) for k, w in vec[a].items()) / np.sqrt(len({k[0] for k in vec[a]}) or 1) / np.sqrt(len({k[0] for k in vec[b]}) or 1)
    want = {(c, col, b) for c in kind for col in sorted({x for own in kind.values() for x, _ in own} - {x for x, _ in kind[c]}) for _, b in sorted((round(dist(c, b), 6), b) for b in kind if col in dict(kind[b]))[:3]}
    for block, turns in ((2000, 32), (2, 1), (2, 3)):
        got = I.nearest_known(cells, block=block, turns=turns).collect()
        assert {(r["cid"], r["col"], r["b"]) for r in got} == want and len(got) == len(want)
        assert all(dict(kind[r["b"]])[r["col"]] == r["value"] for r in got)


def test_distances_read_the_cells_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for x in batches:
            read.add(x.num_rows)
            yield x

    rows = [(c, f"d{d}", "pq rs"[(c * d) % 4 :]) for c in range(30) for d in range(4)]
    cells = spark.createDataFrame(rows, "cid int, col string, value string").mapInArrow(count, "cid int, col string, value string")
    frame = I.character_distances(cells, block=10, digits=6)
    assert len(frame.collect()) == 900 == len({(r["a"], r["b"]) for r in frame.collect()})
    assert read.value == len(rows)
    I.impute(cells).collect()
    assert read.value == 2 * len(rows)
