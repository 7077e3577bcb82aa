import itertools
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoglotta.functions import phonetics as P
from isoglotta.operators import align as AL
from isoglotta.operators import geo as G
from isoglotta.operators import lookup as L
from isoglotta.operators import models as M
from isoglotta.operators import recon as X
from isoglotta.sources import corpora as K

RNG = np.random.default_rng(3)


def test_lookups_and_numbers(spark):
    d = spark.createDataFrame([(1, "a", None), (2, None, None), (3, "b", 7), (4, "zz", None)], "id int, k string, label int")
    t = spark.createDataFrame([("a", 5), ("b", 6)], "k string, label int")
    assert {r["id"]: r["label"] for r in L.fill_from(d, t, ["k"], "label").collect()} == {1: 5, 2: None, 3: 7, 4: None}
    assert {r["id"]: r["label"] for r in L.attach(d, t, "k", ["label"]).collect()} == {1: 5, 2: None, 3: 6, 4: None}
    x = spark.createDataFrame([(f"w{i % 97}", i) for i in range(500)] + [(None, 1000)], "w string, i int")
    for ranges in (1, 7, 256):
        got = [(r["w"], r["i"]) for r in L.numbered(x, ["w", "i"], ranges=ranges).orderBy("number").collect()]
        assert got == sorted(got, key=lambda r: (r[0] is not None, r[0] or "", r[1])) and len(got) == 501
    assert L.numbered(x.limit(0), ["w", "i"]).count() == 0
    first = {(r["w"]): r["i"] for r in L.keep_first(x, ["w"], ["i"]).collect()}
    assert first == {None: 1000} | {f"w{k}": k for k in range(97)}
    parts = [r["part"] for r in L.split_counts(x, "i", "w", 40, 31).collect()]
    assert (parts.count("test"), parts.count("val"), len(parts)) == (40, 31, 501)
    h = [r["half"] for r in L.halves(x, "i").collect()]
    assert (h.count(1), h.count(2)) == (250, 251)


def test_script_conversion_takes_phrases_first(spark):
    d = spark.createDataFrame([("乾坤乾杯干",), (None,), ("",)], "t string")
    chars, phrases = {"乾": "干", "後": "后"}, {"乾坤": "乾坤", "乾坤乾": "X"}
    assert [r[0] for r in d.select(P.convert_script(F.col("t"), chars)).collect()] == ["干坤干杯干", None, ""]
    assert [r[0] for r in d.select(P.convert_script(F.col("t"), chars, {"乾坤": "乾坤"})).collect()] == ["乾坤干杯干", None, ""]
    assert d.select(P.convert_script(F.col("t"), chars, phrases)).first()[0] == "X杯干"


def workbook(path, rows, shared=True):
    strings = sorted({v for r in rows for v in r if v})
    cell = lambda c, n, v: f'<c r="{c}{n}" t="s"><v>{strings.index(v)}</v></c>' if shared else f'<c r="{c}{n}" t="inlineStr"><is><t>{v}</t></is></c>'
    body = "".join(f"<row r='{n}'>" + "".join(cell("ABCDEFGH"[k], n, v) for k, v in enumerate(r) if v) + "</row>" for n, r in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">' + "".join(f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r></si>" for s in strings) + "</sst>")


@pytest.fixture
def homes(tmp_path):
    a = tmp_path / "archive"
    a.mkdir()
    workbook(a / "001.xlsx", [["字號", "字", "聲母", "韻母", "調值", "調類", "備註"], ["1", "東", "t", "uŋ", "55", "陰平", ""], ["1", "東", "", "oŋ", "33", "", ""], ["2", "好", "0", "ao", "0", "上", "x"]])
    workbook(a / "178.xlsx", [["Order", "Char", "ShengMu", "YunMu", "DiaoZhi", "DiaoLei", "Comment"], ["1", "東", "ȷ", "uŋ", "55", "陰平", ""]], shared=False)
    (a / "characters.csv").write_text("字號,字,x\n1,東,q\n2,好,q\n", encoding="utf-8")
    (a / "dialects.csv").write_text("編號,方言,區,片／小區,小片,方言點,緯度,經度\n001,官話,北京官話,,,北京,39.9,116.4\n178,吳語,太湖,,,上海,31.2,121.4\n", encoding="utf-8")
    s = tmp_path / "survey" / "csv" / "dialect"
    s.mkdir(parents=True)
    (s / "06K06mb01dz.csv").write_text("iid,initial,finals,tone,memo,name\n1,t,uŋ,55,,东\n2,x,au,,m,好\n", encoding="utf-8")
    (s / "06K10mb01dz.csv").write_text("iid,initial,finals,tone,memo,name\n1,d,oŋ,11,,东\n", encoding="utf-8")
    (s / "location.csv").write_text("did,province,city,country,village,area,slice,slices,latitude,longitude\n06K06,山东,菏泽市,曹县,,中原官话,兖菏片,,34.8,115.5\n", encoding="utf-8")
    (s.parent / "words.csv").write_text("cid,item,memo\n1,东,m\n2,好,\n", encoding="utf-8")
    m = tmp_path / "dictionary"
    (m / "tables").mkdir(parents=True)
    (m / "tables" / "北京.tsv").write_text("# head\n東\ttuŋ1\t方位\n□\tpia1\t\n好\txau2\t\n", encoding="utf-8")
    entry = {"文件格式": "音典", "地圖集二分區": "官話-北京", "簡稱": "北京", "語言": "北京話", "經緯度": "116.4,39.9", "聲調": json.dumps({"1": ["55", "a", "b", "陰平"], "2": ["214", "a", "b", "上"]}, ensure_ascii=False)}
    (m / "info.json").write_text(json.dumps({"北京": entry, "1800老北京": entry | {"簡稱": "老"}}, ensure_ascii=False), encoding="utf-8")
    return {"CCR": str(a), "yubao": str(tmp_path / "survey"), "mcpdict": str(m)}


def test_corpora_by_name_filter_and_cache(spark, homes, tmp_path):
    c = K.default_catalog(spark, homes, str(tmp_path / "cache"))
    archive, survey, dictionary = c.get("xiaoxue"), c.get("zhongguoyuyan"), c.get("MCPDict")
    got = {(r["did"], r["cid"], r["initial"], r["final"], r["tone"]) for r in archive.data.collect()}
    assert got == {("001", "1", "t", "uŋ", "55"), ("001", "1", "t", "oŋ", "33"), ("001", "2", "∅", "ao", "∅"), ("178", "1", "ɕ", "uŋ", "55")}
    assert {(r["cid"], r["character"]) for r in archive.characters.collect()} == {("1", "東"), ("2", "好")}
    assert {r["did"] for r in archive.dialect_info.collect()} == {"001", "178"}
    one = archive.filter(["178", "none"])
    assert isinstance(one, K.Archive) and {r["did"] for r in one.data.collect()} == {"178"} and one.dialect_info.count() == 1
    assert {(r["did"], r["character"], r["initial"]) for r in survey.data.collect()} == {("06K06", "东", "t"), ("06K06", "好", "x"), ("06K10", "东", "d")}
    assert survey.characters.columns == ["cid", "character", "note"] and survey.dialect_info.first()["subgroup"] == "中原官话"
    assert {(r["did"], r["character"], r["initial"], r["final"], r["tone"], r["tone_category"]) for r in dictionary.data.collect()} == {("北京", "東", "t", "uŋ", "55", "陰平"), ("北京", None, "p", "ia", "55", "陰平"), ("北京", "好", "x", "au", "214", "上")}
    assert [r["did"] for r in dictionary.dialect_info.collect()] == ["北京"]
    plain = K.Survey(spark, homes["yubao"])
    assert {r["did"] for r in plain.filter(["06K10"]).data.collect()} == {"06K10"}
    # the cache answers until it is refreshed
    path = tmp_path / "survey" / "csv" / "words.csv"
    path.write_text("cid,item,memo\n9,新,\n", encoding="utf-8")
    assert survey.characters.count() == 2
    survey.refresh("characters")
    assert [r["character"] for r in survey.characters.collect()] == ["新"] and c.get("nowhere") is None


def test_survey_json(spark):
    data = {"mapLocation": {"point": {"latitude": "1", "longitude": "2"}, "location": {"province": "p", "city": "c"}}, "resourceList": [{"sounder": "s", "type": "t", "items": [{"iid": "1", "name": "n", "oid": "o", "records": [{"initial": "a"}, {"initial": "b"}]}, {"iid": "2", "name": "m", "oid": "x", "records": [{"initial": "c"}]}]}, {"sounder": "z", "type": "t", "items": []}]}
    places, records = K.parse_survey_data(spark.createDataFrame([("S1", json.dumps(data))], "site string, value string"))
    assert (places.first()["site"], places.first()["longitude"], places.first()["city"]) == ("S1", "2", "c")
    assert {(r["oid"], r["iid"], r["record"]["initial"]) for r in records.collect()} == {("o", "1", "a"), ("o", "1", "b"), ("o", "2", "c")}
    tables = K.parse_standards(spark.createDataFrame([(json.dumps({"words": [{"iid": "1", "item": "x"}], "other": []}),)], "value string"), {"words": "iid:string,item:string", "other": "a:string"})
    assert [tuple(r) for r in tables["words"].collect()] == [("1", "x")] and tables["other"].count() == 0


def polyphonic(spark, n=60, dids=8):
    """Readings of n characters at some localities; the last ten glyphs have two readings each that differ everywhere."""
    rows, chars = [], []
    for c in range(n):
        glyph = f"g{c}" if c < n - 20 else f"p{(c - n) // 2}"
        chars.append((c, glyph))
        a, b, t = (int(x) for x in RNG.integers(0, (8, 8, 4)))
        rows += [(f"d{d}", c, glyph, f"i{(a + d * 3) % 8}", f"f{(b * 3 + d) % 8}", f"t{(t + d) % 4}", c) for d in range(dids)]
    return spark.createDataFrame(rows, "did string, cid long, character string, initial string, final string, tone string, seq long"), spark.createDataFrame(chars, "cid long, character string")


def test_alignment_of_halves_and_of_readings_without_ids(spark):
    r, chars = polyphonic(spark)
    e = AL.evaluate(r, chars).first()
    assert e["total"] == 20 and e["accuracy"] >= 0.8
    same = lambda c: c
    known = r.where("did < 'd5'")
    lost = r.where("did >= 'd5'").drop("cid").unionByName(spark.createDataFrame([("d5", "new", "i1", "f1", "t1", 999)], "did string, character string, initial string, final string, tone string, seq long"))
    labels = AL.align_no_cid(AL.cells_of(known), chars.withColumnRenamed("character", "simplified"), lost, same, same)
    got = {(x["did"], x["seq"]): x["label"] for x in labels.collect()}
    assert got["d5", 999] is None and len(got) == 181
    assert np.mean([got[d, c] == c for d in ("d5", "d6", "d7") for c in range(60)]) > 0.9
    out = AL.unify({"a": known, "b": r.where("did >= 'd5'").drop("x")}, {"z": lost.where("did = 'd5'")}, {"a": chars, "b": chars}, same, same)
    assert out["dialects"].count() == 9 and {x["did"] for x in out["dialects"].collect()} == set(range(9))
    readings = out["readings"].toPandas()
    assert len(readings) == 60 * 8 + 61 and set(readings.did) == set(range(9))
    labels = out["charmap"].toPandas()
    assert len(labels) == 120 and (labels.groupby("cid").label.nunique() == 1).mean() > 0.9
    assert "new" in set(out["characters"].toPandas().character)


def test_metrics_of_polyphones(spark):
    g = spark.createDataFrame([("x", 1, 1), ("x", 2, 5)], "glyph string, ds int, cid long")
    e = [spark.createDataFrame([(1, 3.0, 0.0)], "cid long, e0 double, e1 double"), spark.createDataFrame([(5, 0.0, 4.0)], "cid long, e0 double, e1 double")]
    got = {m: AL.polyphone_distance(g, e, m).first()["distance"] for m in AL.METRICS}
    assert got == pytest.approx({"cosine": 1.0, "euclidean": 5.0, "sqeuclidean": 25.0, "cityblock": 7.0, "chebyshev": 4.0})


def test_logistic_imputation_finds_what_other_columns_tell(spark):
    rows, truth = [], {}
    for c in range(120):
        k = int(RNG.integers(0, 4))
        for j in range(5):
            value = f"v{(k * (j + 1)) % 5}" if j != 2 else f"w{k}"
            if RNG.random() < 0.15:
                truth[c, f"c{j}"] = value
                value = None
            rows.append((c, f"c{j}", value))
    d = spark.createDataFrame(rows, "cid int, col string, value string")
    got = {(r["cid"], r["col"]): r["value"] for r in X.impute_logistic(d).collect()}
    assert len(got) == 600 and all(got[c, k] == v for c, k, v in rows if v is not None)
    assert np.mean([got[k] == v for k, v in truth.items()]) > 0.9


def test_l1_logistic_meets_its_conditions():
    x, y = RNG.normal(size=(80, 6)), RNG.integers(0, 3, 80)
    w = X.l1_logistic(x, y, 3, steps=4000)
    z = np.hstack([x, np.ones((80, 1))]) @ w
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    g = np.hstack([x, np.ones((80, 1))]).T @ (p - np.eye(3)[y])
    assert np.abs(g[-1]).max() < 1e-3 and np.abs(g[:-1]).max() < 1 + 1e-3 and np.allclose(g[:-1][w[:-1] != 0], -np.sign(w[:-1][w[:-1] != 0]), atol=1e-2)


def test_denoise_gives_classes_back(spark):
    rows = [(c, f"c{j}", f"v{(c % 3) * (j + 1) % 4}") for c in range(30) for j in range(4)]
    rows[0] = (0, "c0", "odd")
    cells, leaf = X.denoise(spark.createDataFrame(rows, "cid int, col string, value string"), min_leaf=3, min_decrease=0.02)
    assert len({r["proto"] for r in leaf.collect()}) == 3
    back = {(r["cid"], r["col"]): r["value"] for r in cells.collect()}
    assert back[0, "c0"] == "v0" and all(back[c, k] == v for c, k, v in rows[1:])


def test_leaf_order_is_the_best_of_all_turns():
    for n in (2, 3, 6, 7):
        x = RNG.random((n, 2))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=-1))
        merges = G.upgma(d)

        def turns(node):
            if node < n:
                return [[node]]
            a, b, _ = merges[node - n]
            return [p + q for u, v in ((a, b), (b, a)) for p, q in itertools.product(turns(u), turns(v))]

        cost = lambda o: sum(d[a, b] for a, b in zip(o, o[1:]))  # noqa: E731, B023
        order = G.leaf_order(d)
        assert order in turns(2 * n - 2) and cost(order) == pytest.approx(min(map(cost, turns(2 * n - 2))))
        joints = G.dendrogram(d, order)
        assert len(joints) == n - 1 and all(x1 < x2 and h >= max(y1, y2) for _, x1, y1, x2, y2, h in joints)
    assert G.leaf_order(np.zeros((1, 1))) == [0] and G.leaf_order(np.zeros((0, 0))) == []


def test_dendro_heat(spark):
    d = {("a", "a"): 0.0, ("a", "b"): 5.0, ("a", "c"): 1.0, ("b", "b"): 0.0, ("b", "c"): 4.0, ("c", "c"): 0.0}
    m = spark.createDataFrame([(x, y, v) for (p, q), v in d.items() for x, y in {(p, q), (q, p)}], "a string, b string, value double")
    joints, heat = G.dendro_heat(m)
    assert [r["height"] for r in joints.orderBy("merge").collect()] == [1.0, 4.5]
    place = {r["a"]: r["x"] for r in heat.collect()}
    assert place["c"] == 1 and heat.count() == 9


def test_mini_batches_resume_and_weigh(spark, tmp_path):
    rows = [(f"d{d}", f"c{c}", f"t{(d + c) % 3}", f"u{c % 2}") for d in range(4) for c in range(12)] * 3
    data = spark.createDataFrame(rows, "did string, cid string, t string, u string").coalesce(1)
    p = M.Processor.build(data, ["did"], ["cid"], ["t", "u"])
    e = p.encode(data).coalesce(1).persist()
    make = lambda: M.BilinearEncoder(p.sizes(), 6, 6, 6, seed=1)
    whole, half = make(), make()
    log = whole.fit_batches(e, e, epochs=6, batch_size=20, rate=0.5, path=str(tmp_path / "a"))
    assert len(log) == 6 and log[-1]["loss"] < log[0]["loss"] and log[-1]["validation_loss"] < log[0]["validation_loss"] and len(log[-1]["validation_accuracy"]) == 2
    half.fit_batches(e, epochs=3, batch_size=20, rate=0.5, path=str(tmp_path / "b"))
    again = make()
    rest = again.fit_batches(e, epochs=6, batch_size=20, rate=0.5, path=str(tmp_path / "b"))
    assert [x["epoch"] for x in rest] == [1, 2, 3, 4, 5, 6] and all(np.allclose(again.p[k], whole.p[k]) for k in whole.p)
    only = make()
    only.fit_batches(e, target_weights=[0.0, 1.0], epochs=1, batch_size=20)
    assert np.allclose(only.p["t0"], make().p["t0"]) and not np.allclose(only.p["t1"], make().p["t1"])
    proba = whole.predict_proba(e, ["did", "cid"]).first()["probabilities"]
    assert [len(x) for x in proba] == [4, 3] and all(sum(x) == pytest.approx(1) for x in proba)


def test_tagger_learns(spark):
    words = [("ta", ["B-I", "B-F"]), ("tsa", ["B-I", "I-I", "B-F"]), ("ma", ["B-I", "B-F"]), ("au", ["B-F", "I-F"]), ("tau", ["B-I", "B-F", "I-F"]), ("ŋ", ["B-F"])] * 5
    d = spark.createDataFrame(words, "w string, tags array<string>")
    tagger = M.train_tagger(d, "w", "tags", epochs=8)
    got = M.tag_syllables(d.withColumnRenamed("tags", "right").repartition(2), "w", tagger).collect()
    assert all(r["tags"] == r["right"] for r in got)
