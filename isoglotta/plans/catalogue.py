"""Registered queries and the SQL that gives the same rows.

Readings come from the benchmark tables: a locality is a supplier's nation, a character is a part, and the
three elements are return flag, order priority and order status, in the order of order lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoglotta.functions import phonetics as P
from isoglotta.functions import regions as R
from isoglotta.operators import aggregates as A
from isoglotta.operators import align as AL
from isoglotta.operators import cells as C
from isoglotta.operators import encode as E
from isoglotta.operators import geo as G
from isoglotta.operators import impute as I
from isoglotta.operators import lookup as L
from isoglotta.operators import models as M
from isoglotta.operators import recon as X
from isoglotta.operators import rules as RU
from isoglotta.operators import similarity as S
from isoglotta.sources import datasets as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def readings(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    d = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return d.select(
        F.col("s_nationkey").cast("string").alias("did"), F.col("l_partkey").cast("string").alias("cid"), F.col("l_returnflag").alias("initial"),
        F.col("o_orderpriority").alias("final"), F.col("o_orderstatus").alias("tone"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_suppkey")).alias("seq"),
    )


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return C.transform(readings(spark, sf), "did", "cid", C.ELEMENTS)


READ = """r AS (
  SELECT CAST(s_nationkey AS VARCHAR) AS did, CAST(l_partkey AS VARCHAR) AS cid, l_returnflag AS initial, o_orderpriority AS final, o_orderstatus AS tone,
    (l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey AS seq
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
)"""
CELLS = READ + """, c AS (
  SELECT did, cid, arg_min(initial, seq) FILTER (initial IS NOT NULL) AS initial, arg_min(final, seq) FILTER (final IS NOT NULL) AS final, arg_min(tone, seq) FILTER (tone IS NOT NULL) AS tone
  FROM r WHERE did IS NOT NULL AND cid IS NOT NULL GROUP BY did, cid
)"""


# cells


@query(f"WITH {CELLS} SELECT did, cid, initial, final, tone FROM c")
def long_cells_first(spark, sf):
    return cells(spark, sf)


@query(f"WITH {READ} SELECT did, cid, string_agg(initial, ' ' ORDER BY seq, initial) AS initial, string_agg(final, ' ' ORDER BY seq, final) AS final, string_agg(tone, ' ' ORDER BY seq, tone) AS tone FROM r GROUP BY did, cid")
def long_cells_join(spark, sf):
    return C.transform(readings(spark, sf), "did", "cid", C.ELEMENTS, "join")


_DIDS = [str(i) for i in range(25)]


@query("WITH " + CELLS + " SELECT cid, " + ", ".join(f"min({e}) FILTER (did = '{d}') AS \"{d}_{e}\"" for d in _DIDS for e in C.ELEMENTS) + " FROM c GROUP BY cid")
def wide_pivot_did(spark, sf):
    return C.wide(cells(spark, sf), "cid", "did", C.ELEMENTS, _DIDS)


@query(f"WITH {CELLS} SELECT did, cid, element, value FROM (SELECT did, cid, unnest(['initial', 'final', 'tone']) AS element, unnest([initial, final, tone]) AS value FROM c) WHERE coalesce(value, '') <> ''")
def melted_cells(spark, sf):
    return C.melt(cells(spark, sf))


@query(f"WITH {READ} SELECT DISTINCT did FROM r WHERE did IS NOT NULL")
def dataset_dialects(spark, sf):
    return D.Dataset(readings(spark, sf)).dialects


_PART = "p AS (SELECT CAST(p_partkey AS VARCHAR) AS cid, p_name AS character FROM part)"


def part_chars(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("cid"), F.col("p_name").alias("character"))


@query(f"WITH {_PART} SELECT DISTINCT cid, character FROM p WHERE cid IS NOT NULL OR character IS NOT NULL")
def dataset_characters(spark, sf):
    return A.characters(part_chars(spark, sf))


@query("SELECT p_brand AS cid, min(p_name) AS character FROM part GROUP BY p_brand")
def dataset_characters_min(spark, sf):
    return A.character_of(table(spark, sf, "part").select(F.col("p_brand").alias("cid"), F.col("p_name").alias("character")))


@query(f"WITH {READ} SELECT did, cid, initial, final, tone, seq FROM r WHERE did IN ('3', '7', '11', 'none')")
def filter_dids(spark, sf):
    return D.Dataset(readings(spark, sf)).filter(["3", "7", "11", "none"]).data


_HOLED = READ + ", h AS (SELECT did, cid, nullif(initial, 'N') AS initial, nullif(final, '5-LOW') AS final, nullif(tone, 'O') AS tone, seq FROM r)"


def holed(spark, sf):
    n = lambda c, v: F.nullif(F.col(c), F.lit(v))
    return readings(spark, sf).withColumns({"initial": n("initial", "N"), "final": n("final", "5-LOW"), "tone": n("tone", "O")})


@query(f"WITH {_HOLED} SELECT * FROM h WHERE initial IS NOT NULL OR final IS NOT NULL OR tone IS NOT NULL")
def drop_all_missing(spark, sf):
    return C.drop_empty(holed(spark, sf))


@query(f"WITH {_HOLED} SELECT * FROM h WHERE initial IS NOT NULL AND final IS NOT NULL")
def drop_any_missing(spark, sf):
    return holed(spark, sf).na.drop("any", subset=["initial", "final"])


@query(f"""WITH {CELLS}, d AS (SELECT did FROM c GROUP BY did HAVING count(DISTINCT cid) >= 0.35 * (SELECT count(DISTINCT cid) FROM c)),
k AS (SELECT * FROM c SEMI JOIN d USING (did)), ch AS (SELECT cid FROM k GROUP BY cid HAVING count(DISTINCT did) >= 0.5 * (SELECT count(*) FROM d))
SELECT did, cid, initial, final, tone FROM k SEMI JOIN ch USING (cid)""")
def drop_sparse(spark, sf):
    return C.drop_sparse(cells(spark, sf), 0.35, 0.5).select("did", "cid", *C.ELEMENTS)


@query("SELECT doc_id, lang FROM documents WHERE coalesce(contains(text, 'idiot'), FALSE) = FALSE")
def note_filter(spark, sf):
    return C.without_note(table(spark, sf, "documents"), "text", "idiot").select("doc_id", "lang")


@query("SELECT s_suppkey, s_acctbal, CASE WHEN s_acctbal BETWEEN 0 AND 55 THEN s_acctbal END AS lat, CASE WHEN s_acctbal BETWEEN 70 AND 140 THEN s_acctbal END AS lon FROM supplier")
def coordinate_sanity(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", "s_acctbal", R.sane_latitude(F.col("s_acctbal")).alias("lat"), R.sane_longitude(F.col("s_acctbal")).alias("lon"))


@query("SELECT c_custkey, c_name, CAST(NULL AS VARCHAR) AS village FROM customer")
def conform_schema(spark, sf):
    return C.conform(table(spark, sf, "customer"), ["c_custkey", "c_name", "village"])


@query("SELECT p_partkey, CASE p_brand WHEN 'Brand#11' THEN 'first' WHEN 'Brand#12' THEN 'second' ELSE p_brand END AS brand FROM part")
def replace_values(spark, sf):
    return table(spark, sf, "part").na.replace({"Brand#11": "first", "Brand#12": "second"}, subset=["p_brand"]).select("p_partkey", F.col("p_brand").alias("brand"))


# sets and joins


@query(f"WITH {READ}, a AS (SELECT * FROM r WHERE did < '2'), b AS (SELECT * FROM r WHERE did >= '5') SELECT * FROM a UNION ALL SELECT * FROM b")
def append_datasets(spark, sf):
    r = readings(spark, sf)
    return (D.Dataset(r.where("did < '2'")) + D.Dataset(r.where("did >= '5'"))).data


@query("SELECT 'nation' AS dataset, n_name AS name, n_regionkey AS extra FROM nation UNION ALL SELECT 'region', r_name, NULL FROM region")
def concat_with_source(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("extra"))
    return A.concat_sources(nation=n, region=table(spark, sf, "region").select(F.col("r_name").alias("name")))


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def key_intersection(spark, sf):
    return table(spark, sf, "documents").select("doc_id").intersect(table(spark, sf, "labels").select("doc_id"))


@query("SELECT doc_id FROM documents UNION SELECT doc_id FROM labels")
def key_union(spark, sf):
    return table(spark, sf, "documents").select("doc_id").union(table(spark, sf, "labels").select("doc_id")).distinct()


@query("SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)")
def unlabelled_anti(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query("""WITH a AS (SELECT p_partkey AS idx, p_type AS simplified, p_brand AS traditional FROM part WHERE p_partkey % 3 <> 0),
b AS (SELECT p_partkey AS idx, p_type AS simplified, CASE WHEN p_size % 2 = 0 THEN p_brand END AS traditional FROM part WHERE p_partkey % 3 <> 1)
SELECT coalesce(coalesce(a.simplified, b.simplified), coalesce(a.traditional, b.traditional), '') AS glyph, coalesce(a.idx, -1) AS idx1, coalesce(b.idx, -1) AS idx2
FROM a FULL JOIN b ON a.simplified IS NOT DISTINCT FROM b.simplified AND a.traditional IS NOT DISTINCT FROM b.traditional""")
def align_glyphs_full_outer(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("idx"), F.col("p_type").alias("simplified"), F.col("p_brand").alias("traditional"), "p_size")
    b = p.where("idx % 3 <> 1").withColumn("traditional", F.when(F.col("p_size") % 2 == 0, F.col("traditional"))).drop("p_size")
    return AL.align_chars(p.where("idx % 3 <> 0").drop("p_size"), b)


@query("SELECT count(*) FILTER (text <> replace(text, 'the', 'ye')) < 3 AS simplified FROM documents")
def script_heuristic(spark, sf):
    return A.script_is_simplified(table(spark, sf, "documents"), "text", lambda c: F.replace(c, F.lit("the"), F.lit("ye")))


# windows


@query(f"WITH {_HOLED} SELECT did, cid, seq, coalesce(initial, first_value(initial IGNORE NULLS) OVER w) AS initial, coalesce(final, first_value(final IGNORE NULLS) OVER w) AS final, tone FROM h WINDOW w AS (PARTITION BY cid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def fill_first_in_group(spark, sf):
    return C.fill_first(holed(spark, sf), "cid", ["initial", "final"]).select("did", "cid", "seq", "initial", "final", "tone")


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_name) = 1 AS monophone FROM part")
def monophone_mask(spark, sf):
    return A.monophones(table(spark, sf, "part"), "p_name").select("p_partkey", "monophone")


_PLACES = "g AS (SELECT s_suppkey AS id, CAST(s_nationkey AS DOUBLE) AS lat, CAST(s_nationkey % 7 + 100 AS DOUBLE) AS lon FROM supplier)"


def places(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("double").alias("lat"), (F.col("s_nationkey") % 7 + 100).cast("double").alias("lon"))


@query(f"WITH {_PLACES} SELECT id, lat, round(lon + (row_number() OVER (PARTITION BY lat, lon ORDER BY id) - 1) * 1e-4, 6) AS lon FROM g")
def jitter_duplicates(spark, sf):
    return A.jitter(places(spark, sf), "id").select("id", "lat", F.round("lon", 6).alias("lon"))


@query(f"WITH {_PLACES}, a AS (SELECT min(lat) l0, max(lat) l1, min(lon) o0, max(lon) o1, avg(lat) m, stddev_pop(lat) s, avg(lon) n, stddev_pop(lon) t FROM g), b AS (SELECT greatest(l0, m - 1.5 * s) l0, least(l1, m + 1.5 * s) l1, greatest(o0, n - 1.5 * t) o0, least(o1, n + 1.5 * t) o1 FROM a) SELECT round(l0 - 0.01 * (l1 - l0), 6) AS lat0, round(l1 + 0.01 * (l1 - l0), 6) AS lat1, round(o0 - 0.01 * (o1 - o0), 6) AS lon0, round(o1 + 0.01 * (o1 - o0), 6) AS lon1 FROM b")
def map_extent(spark, sf):
    return A.extent(places(spark, sf), 1.5).select(*(F.round(c, 6).alias(c) for c in ("lat0", "lat1", "lon0", "lon1")))


@query(f"WITH {_PLACES} SELECT id FROM g WHERE lat > 3 AND lat < 20 AND lon > 100 AND lon < 105")
def points_in_box(spark, sf):
    return G.inside(places(spark, sf), 3, 100, 20, 105).select("id")


@query(f"WITH {CELLS} SELECT did, cid, dense_rank() OVER (ORDER BY final) - 1 AS code FROM c WHERE final IS NOT NULL UNION ALL SELECT did, cid, -1 FROM c WHERE final IS NULL")
def ordinal_codes(spark, sf):
    return E.ordinal(cells(spark, sf), "final").select("did", "cid", "code")


@query("SELECT p_brand, n, CAST(sum(n) OVER (ORDER BY p_brand ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS start FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand)")
def cum_offsets(spark, sf):
    return E.offsets(table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n")), "p_brand", "n").select("p_brand", "n", "start")


# aggregates


@query(f"WITH {READ}, k AS (SELECT cid AS value, count(*) AS count FROM r WHERE cid <> '' GROUP BY cid ORDER BY count DESC, value LIMIT 50) SELECT value, count, row_number() OVER (ORDER BY count DESC, value) - 1 AS code FROM k")
def top_categories(spark, sf):
    return E.make_dict(readings(spark, sf), "cid", None, 50, "frequency")


@query(f"WITH {READ}, k AS (SELECT cid AS value, count(*) AS count FROM r WHERE cid <> '' GROUP BY cid), l AS (SELECT floor(0.0005 * count(*)) AS least FROM r) SELECT value, count, row_number() OVER (ORDER BY value) - 1 AS code FROM k, l WHERE least <= 1 OR count >= least")
def freq_dict_min(spark, sf):
    return E.make_dict(readings(spark, sf), "cid", 0.0005)


@query(f"""WITH {READ}, x AS (SELECT did AS cluster, unnest(['final', 'tone']) AS element, unnest([final, tone]) AS value FROM r),
k AS (SELECT cluster, element, value, count(*) AS n FROM x WHERE value IS NOT NULL GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY cluster, element ORDER BY n DESC, value) AS i FROM k)
SELECT cluster, element, string_agg(value || ':' || n, ',' ORDER BY i) AS frequencies FROM t WHERE i <= 10 GROUP BY cluster, element""")
def top10_per_cluster(spark, sf):
    return A.top_values(readings(spark, sf), "did", ["final", "tone"])


@query(f"""WITH {READ}, k AS (SELECT tone, did, final, count(*) AS n FROM r GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY tone, did) AS p FROM k),
e AS (SELECT tone, did, -sum(p * ln(p)) AS h FROM p GROUP BY tone, did) SELECT tone, round(avg(h), 6) AS entropy FROM e GROUP BY tone""")
def cluster_entropy(spark, sf):
    return A.cluster_entropy(readings(spark, sf), "tone", "did", "final").select("tone", F.round("entropy", 6).alias("entropy"))


@query(f"WITH {READ}, k AS (SELECT did, final, count(*) AS n FROM r GROUP BY ALL) SELECT did, final, round(n / sum(n) OVER (PARTITION BY did), 6) AS p FROM k")
def relative_frequency(spark, sf):
    return A.relative_frequency(readings(spark, sf), ["did"], "final").select("did", "final", F.round("p", 6).alias("p"))


@query(f"WITH {READ}, k AS (SELECT did, final, count(*) AS n FROM r GROUP BY ALL) SELECT did, final FROM k QUALIFY row_number() OVER (PARTITION BY did ORDER BY n DESC, final) = 1")
def group_mode(spark, sf):
    return A.mode(readings(spark, sf), "did", "final")


@query(f"WITH {_HOLED} SELECT cid, round(avg((CAST(initial IS NULL AS INT) + CAST(final IS NULL AS INT) + CAST(tone IS NULL AS INT)) / 3.0), 6) AS missing FROM h GROUP BY cid")
def missing_share(spark, sf):
    return A.missing_share(holed(spark, sf), C.ELEMENTS).select("cid", F.round("missing", 6).alias("missing"))


# similarity

_CROSS = """x AS (
  SELECT did, cid, k, v FROM (SELECT did, cid, unnest([0, 1, 2]) AS k, unnest([coalesce(initial, '') || coalesce(final, ''), coalesce(final, '') || coalesce(tone, ''), coalesce(tone, '') || coalesce(initial, '')]) AS v FROM c) WHERE v <> ''
)"""
_RAW = """y AS (SELECT did, cid, k, v FROM (SELECT did, cid, unnest([0, 1, 2]) AS k, unnest([coalesce(initial, ''), coalesce(final, ''), coalesce(tone, '')]) AS v FROM c) WHERE v <> '')"""


def _chi2_sql(features: int = 3) -> str:
    return f"""m AS (SELECT did, k, v, count(*) AS c FROM x GROUP BY ALL),
p AS (SELECT did, k, v, c / sum(c) OVER (PARTITION BY did, k) AS p, count(*) OVER (PARTITION BY did, k) AS nc FROM m),
o AS (SELECT a.did AS a, b.did AS b, a.k, a.v AS va, b.v AS vb, count(*) AS o FROM x a JOIN x b ON a.cid = b.cid AND a.k = b.k GROUP BY ALL),
z AS (SELECT a, b, o.k, sum(o * o / pa.p / pb.p) / sum(o) - sum(o) AS chi, CAST((max(pa.nc) - 1) * (max(pb.nc) - 1) AS DOUBLE) AS dof
  FROM o JOIN p pa ON pa.did = a AND pa.k = o.k AND pa.v = va JOIN p pb ON pb.did = b AND pb.k = o.k AND pb.v = vb GROUP BY a, b, o.k),
s AS (SELECT a, b, CASE WHEN count(CASE WHEN dof > 0 THEN 1 END) = {features} THEN avg((chi - dof) / sqrt(2 * nullif(dof, 0))) END AS value FROM z GROUP BY a, b),
chi AS (SELECT a.did AS a, b.did AS b, value FROM (SELECT DISTINCT did FROM x) a CROSS JOIN (SELECT DISTINCT did FROM x) b LEFT JOIN s ON s.a = a.did AND s.b = b.did)"""


def rounded(m: DataFrame) -> DataFrame:
    return m.select("a", "b", F.round("value", 6).alias("value"))


@query(f"WITH {CELLS}, {_CROSS}, {_chi2_sql()} SELECT a, b, round(value, 6) AS value FROM chi")
def chi2_similarity(spark, sf):
    return rounded(S.chi2(cells(spark, sf)))


@query(f"WITH {CELLS}, x AS (SELECT did, cid, 0 AS k, final AS v FROM c WHERE coalesce(final, '') <> ''), {_chi2_sql(1)} SELECT a, b, round(value, 6) AS value FROM chi")
def chi2_single_feature(spark, sf):
    return rounded(S.chi2(cells(spark, sf), elements=["final"]))


@query(f"""WITH {CELLS}, {_CROSS}, {_RAW},
o AS (SELECT a.did AS a, b.did AS b, a.k, b.k AS q, a.v AS va, b.v AS vb, count(*) AS o FROM x a JOIN y b ON a.cid = b.cid GROUP BY ALL),
r2 AS (SELECT a, b, k, q, va, sum(o) AS n, sum(o * ln(o)) AS e FROM o GROUP BY ALL), h AS (SELECT a, b, k, q, sum(n * ln(n) - e) / sum(n) AS h FROM r2 GROUP BY ALL),
m AS (SELECT a, b, q, min(h) AS h FROM h GROUP BY ALL), s AS (SELECT a, b, CASE WHEN count(*) = 3 THEN sum(h) END AS value FROM m GROUP BY a, b)
SELECT a.did AS a, b.did AS b, round(value, 6) + 0.0 AS value FROM (SELECT DISTINCT did FROM x) a CROSS JOIN (SELECT DISTINCT did FROM y) b LEFT JOIN s ON s.a = a.did AND s.b = b.did""")
def entropy_similarity(spark, sf):
    return S.entropy(cells(spark, sf)).select("a", "b", (F.round("value", 6) + 0.0).alias("value"))


_DIAG = "d AS (SELECT a, value AS v FROM chi WHERE a = b)"


@query(f"WITH {CELLS}, {_CROSS}, {_chi2_sql()}, {_DIAG} SELECT x.a, x.b, round(greatest(-1, least(1, (x.value + y.value) / 2 / (sqrt(da.v) * sqrt(db.v)))), 6) AS value FROM chi x JOIN chi y ON y.a = x.b AND y.b = x.a JOIN d da ON da.a = x.a JOIN d db ON db.a = x.b")
def normalized_similarity(spark, sf):
    return rounded(S.normalize_sim(S.chi2(cells(spark, sf))))


@query(f"WITH {CELLS}, {_CROSS}, {_chi2_sql()}, {_DIAG} SELECT x.a, x.b, round(sqrt(greatest(0, round(da.v + db.v - 2 * x.value, 9))), 5) + 0.0 AS value FROM chi x JOIN d da ON da.a = x.a JOIN d db ON db.a = x.b")
def similarity_to_distance(spark, sf):
    chi = S.chi2(cells(spark, sf))
    return S.sim2dist(chi).select("a", "b", (F.round(F.when(F.col("value") < 1e-4, 0.0).otherwise(F.col("value")), 5) + 0.0).alias("value"))


@query(f"WITH {CELLS}, {_CROSS}, {_chi2_sql()}, t AS (SELECT b, max(value) AS v FROM chi GROUP BY b) SELECT x.a, x.b, round(1 - value / (sqrt(ta.v) * sqrt(tb.v)), 6) + 0.0 AS value FROM chi x JOIN t ta ON ta.b = x.a JOIN t tb ON tb.b = x.b")
def distance_to_similarity(spark, sf):
    return S.dist2sim(S.chi2(cells(spark, sf))).select("a", "b", (F.round("value", 6) + 0.0).alias("value"))


# rules

_RULES = "ru AS (SELECT p_size AS rule_id, 'final' AS element, coalesce(list(CAST(p_partkey AS VARCHAR)) FILTER (p_partkey % 2 = 0), CAST([] AS VARCHAR[])) AS cid1, coalesce(list(CAST(p_partkey AS VARCHAR)) FILTER (p_partkey % 2 = 1), CAST([] AS VARCHAR[])) AS cid2 FROM part GROUP BY p_size)"


def rules(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_size").alias("rule_id"), F.col("p_partkey").cast("string").alias("cid"), (F.col("p_partkey") % 2 == 0).alias("even"))
    return p.groupBy("rule_id").agg(F.lit("final").alias("element"), F.collect_list(F.when(F.col("even"), F.col("cid"))).alias("cid1"), F.collect_list(F.when(~F.col("even"), F.col("cid"))).alias("cid2"))


def _compliance_sql(size: str) -> str:
    return f"""WITH {READ}, {_RULES}, jc AS (SELECT did, cid, string_agg(final, ' ' ORDER BY seq, final) AS final FROM r GROUP BY did, cid),
t AS (SELECT did, cid, unnest(string_split(final, ' ')) AS token FROM jc), sd AS (SELECT rule_id, 1 AS side, unnest(cid1) AS cid FROM ru UNION ALL SELECT rule_id, 2, unnest(cid2) FROM ru),
k AS (SELECT did, rule_id, token, CAST(count(*) FILTER (side = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (side = 2) AS DOUBLE) AS n2 FROM t JOIN sd USING (cid) WHERE token <> '' GROUP BY ALL),
v AS (SELECT did, rule_id, coalesce(sum(n1 * n2) / nullif({size}, 0), 0) AS value FROM k GROUP BY ALL)
SELECT d.did, ru.rule_id, round(coalesce(value, 0), 6) AS value FROM (SELECT DISTINCT did FROM r) d CROSS JOIN ru LEFT JOIN v ON v.did = d.did AND v.rule_id = ru.rule_id"""


def _compliance(spark, sf, norm):
    c = C.transform(readings(spark, sf), "did", "cid", C.ELEMENTS, "join")
    return RU.compliance(c, rules(spark, sf), norm).select("did", "rule_id", F.round("value", 6).alias("value"))


@query(_compliance_sql("(sqrt(sum(n1 * n1)) * sqrt(sum(n2 * n2)))"))
def rule_compliance_l2(spark, sf):
    return _compliance(spark, sf, "l2")


@query(_compliance_sql("(sum(n1) * sum(n2))"))
def rule_compliance_l1(spark, sf):
    return _compliance(spark, sf, "l1")


@query(_compliance_sql("1"))
def rule_compliance_raw(spark, sf):
    return _compliance(spark, sf, None)


@query(f"WITH {_RULES} SELECT rule_id, element || ':' || array_to_string(list_sort(cid1), ',') || '=' || array_to_string(list_sort(cid2), ',') AS name FROM ru")
def rule_names(spark, sf):
    r = rules(spark, sf)
    return RU.named_rules(r.withColumns({c: F.array_sort(c) for c in ("cid1", "cid2")})).select("rule_id", "name")


# strings: distinct words of all documents, some letters replaced by phonetic ones

_FROM, _TO = "aehngrsvtupwbkACEG.,!", "ɑəʰŋɡɾʂᵛʦɷʱʷ∅ʔACEG451"


def words(spark, sf):
    w = table(spark, sf, "documents").select(F.explode(P.tokens(F.coalesce("text", F.lit("")))).alias("word")).distinct()
    return w.select("word", F.translate("word", _FROM, _TO).alias("s"))


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


WORDS = f"w AS (SELECT word, translate(word, {_q(_FROM)}, {_q(_TO)}) AS s FROM (SELECT DISTINCT unnest(string_split_regex(coalesce(text, ''), '\\s+')) AS word FROM documents) WHERE word <> '')"


def _keep(x: str, chars: str) -> str:
    return f"regexp_replace({x}, {_q(P.char_class(chars, True))}, '', 'g')"


def _ipa(x: str, force: bool = False) -> str:
    out = f"translate(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), {_q(P.CHAR_FROM)}, {_q(P.CHAR_TO)})"
    for a, b in P.STRING_MAP:
        out = f"replace({out}, {_q(a)}, {_q(b)})"
    return _keep(out, P.ALPHABET) if force else out


def _unless(x: str, chars: str) -> str:
    return f"CASE WHEN {x} = '∅' THEN {x} ELSE {_keep(x, chars)} END"


def _rewrite(x: str, rules) -> str:
    for pattern, new in rules:
        x = f"regexp_replace({x}, {_q(pattern)}, {_q(new.replace('$', chr(92)))}, 'g')"
    return x


def _initial(x: str) -> str:
    out = f"translate({x}, {_q(P.INITIAL_VARIANTS[0])}, {_q(P.INITIAL_VARIANTS[1])})"
    for a, b in P.LIGATURES:
        out = f"replace({out}, {_q(a)}, {_q(b)})"
    return _rewrite(out, P.INITIAL_REWRITES)


def _of_words(name: str, expression, sql: str) -> None:
    query(f"WITH {WORDS} SELECT word, {sql} AS out FROM w", name)(lambda spark, sf: words(spark, sf).select("word", expression(F.col("s")).alias("out")))


_of_words("clean_ipa", P.clean_ipa, _ipa("s"))
_of_words("clean_ipa_force", lambda c: P.clean_ipa(c, True), _ipa("s", True))
_of_words("clean_initial", P.clean_initial, _unless("s", P.CONSONANTS + P.DIACRITICS))
_of_words("clean_final", P.clean_final, _keep("s", P.LETTERS + P.DIACRITICS + P.SUPRASEGMENTALS))
_of_words("clean_tone", P.clean_tone, _unless("s", P.TONES))
_of_words("normalize_initial", P.normalize_initial, _initial("s"))
_of_words("tone_super", P.tone_to_superscript, f"translate(s, {_q(P.PLAIN_DIGITS)}, {_q(P.SUPERSCRIPT_DIGITS)})")
_of_words("tone_plain", lambda c: P.tone_to_plain(P.tone_to_superscript(c)), "s")
_of_words("first_alternative", P.first_alternative, "split_part(s, '.', 1)")
_of_words("pronunciation", lambda c: P.pronunciation(c, F.lit(P.EMPTY), F.lit(None).cast("string"), c), "CASE WHEN s = '∅' THEN '' ELSE s || s END")


@query(f"WITH {WORDS} SELECT word, " + ", ".join(f"CASE WHEN regexp_matches(s, {_q(P.SYLLABLE)}) THEN regexp_extract(s, {_q(P.SYLLABLE)}, {i}) END AS {n}" for i, n in enumerate(C.ELEMENTS, 1)) + " FROM w")
def parse_syllable(spark, sf):
    return words(spark, sf).select("word", P.parse_syllable(F.col("s")).alias("p")).select("word", "p.*")


@query("WITH w AS (SELECT DISTINCT unnest(string_split_regex(coalesce(text, ''), '\\s+')) AS word FROM documents) SELECT word, " + f"regexp_extract(word, {_q(P.SYLLABLE_TONE)}, 1) AS segment, nullif(regexp_extract(word, {_q(P.SYLLABLE_TONE)}, 2), '') AS tone_number FROM w WHERE word <> ''")
def syllable_tone_split(spark, sf):
    return words(spark, sf).select("word", P.split_tone(F.col("word")).alias("p")).select("word", "p.*")


_LOOK = lambda t: "MAP {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in t.items()) + "}"


@query(f"""WITH {WORDS}, ch AS (SELECT word, s, unnest(range(1, length(s) + 1)) AS i FROM w), f AS (
  SELECT word, i - 1 AS pos, CASE WHEN i = 1 THEN 'BOS' ELSE s[i - 1] END AS before_char, s[i] AS own_char, CASE WHEN i = length(s) THEN 'EOS' ELSE s[i + 1] END AS after_char FROM ch)
SELECT word, CAST(pos AS INT) AS pos, before_char, own_char, after_char, coalesce({_LOOK(P.TYPE_OF)}[own_char], 'other') AS own_type, {_LOOK(P.MANNERS)}[own_char] AS own_manner,
  CASE WHEN length(after_char) = 1 THEN coalesce({_LOOK(P.TYPE_OF)}[after_char], 'other') END AS after_type FROM f""")
def char_features(spark, sf):
    f = words(spark, sf).select("word", F.explode(P.char_features(F.col("s"))).alias("f")).select("word", "f.*")
    return f.select("word", "pos", "before_char", "own_char", "after_char", "own_type", "own_manner", "after_type")


@query(f"WITH {WORDS} SELECT word, CASE WHEN length(s) > 1 THEN s[1] END AS initial, CASE WHEN length(s) = 1 THEN s WHEN length(s) = 2 THEN s[2] ELSE s[2:length(s) - 1] END AS final, CASE WHEN length(s) > 2 THEN s[length(s)] END AS tone FROM w")
def segment_tags(spark, sf):
    chars, n = F.filter(F.split("s", ""), lambda c: c != ""), F.length("s")
    tags = F.transform(chars, lambda c, i: F.when(n == 1, "S-F").when(i == 0, "S-I").when((n > 2) & (i == n - 1), "S-T").when(i == 1, "B-F").otherwise("I-F"))
    return words(spark, sf).select("word", P.segment_tags(chars, tags).alias("p")).select("word", "p.*")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS number, CASE WHEN json_extract_string(props, '$.k') IN ('1', '2', '3') THEN 'low' END AS category FROM events")
def json_map_lookup(spark, sf):
    m = F.from_json("props", "map<string,string>")
    low = F.create_map(*(F.lit(x) for k in "123" for x in (k, "low")))
    return table(spark, sf, "events").select("event_id", m["k"].alias("number"), F.try_element_at(low, m["k"]).alias("category"))


_PICK = lambda key, items: "CASE " + f"{key} % {len(items)} " + " ".join(f"WHEN {i} THEN {_q(x) if x is not None else 'NULL'}" for i, x in enumerate(items)) + " END"
_AREAS = ("官话", "中原官话区", "吴语区", "闽南语", "客家话区", "平话和土话", "土话区", "湘南土话", None, "粤语 桂南片", "不明")
_SLICES = ("中原官话", "兖菏片", "太湖片苏沪嘉小片", "桂南片", "冀鲁官话石济片", "雷琼", "韶州片", None, "西南官话区成渝片", "成渝", "系属不明", "泉漳小片", "湘南片")
_SLICES2 = ("兖菏片", "系属不明", "聊泰小片", "石济片赵深小片", None, "苏沪嘉小片", "语")
_SPOTS = ("菏泽市", "曹县（城关）", "张家界市永定区", "大理白族自治州", "（旧）上海市区", "新疆生产建设兵团农八师石河子市", "市辖区", "开发新区", "枣庄县城", None, "无", " 伊犁哈萨克自治州 ", "锡林郭勒盟")


def _pick(key, items):
    return F.get(F.array(*(F.lit(x).cast("string") for x in items)), F.col(key) % len(items))


def _first(x: str, rules) -> str:
    return "nullif(CASE " + " ".join(f"WHEN regexp_matches({x}, {_q(a)}) THEN {_rewrite(x, [(b.replace('(?s)', ''), c)])}" for a, b, c in rules) + " END, '')"


_LOC = f"l AS (SELECT p_partkey AS k, {_PICK('p_partkey', _AREAS)} AS area, {_PICK('p_partkey', _SLICES)} AS slice, {_PICK('p_partkey', _SLICES2)} AS slices, {_PICK('p_partkey', _SPOTS)} AS city, {_PICK('(p_partkey + p_size)', _SPOTS)} AS county FROM part)"


def locations(spark, sf):
    p = table(spark, sf, "part").withColumn("n", F.col("p_partkey") + F.col("p_size"))
    return p.select(F.col("p_partkey").alias("k"), _pick("p_partkey", _AREAS).alias("area"), _pick("p_partkey", _SLICES).alias("slice"), _pick("p_partkey", _SLICES2).alias("slices"), _pick("p_partkey", _SPOTS).alias("city"), _pick("n", _SPOTS).alias("county"))


def _part_sql(x: str, rule) -> str:
    return f"CASE WHEN regexp_matches({x}, {_q(rule[0])}) THEN {_rewrite(x, [(rule[1], '$1')])} END"


_CLEAR = lambda x: f"CASE WHEN NOT regexp_matches({x}, {_q(R.UNCLEAR)}) THEN {x} END"


@query(f"""WITH {_LOC}, g AS (SELECT *, coalesce({_first('area', R.GROUP_RULES)}, {_first('slice', R.GROUP_RULES)}) AS g0, coalesce({_first('slice', R.SUBGROUP_RULES)}, {_first('area', R.SUBGROUP_RULES)}) AS s0 FROM l),
h AS (SELECT *, CASE WHEN g0 = '土话' AND coalesce(regexp_matches(slice, '桂南|桂北'), FALSE) THEN '平话' ELSE g0 END AS g1 FROM g),
o AS (SELECT *, coalesce(g1 = '官话' AND NOT coalesce(suffix(s0, '官话'), FALSE), FALSE) AS odd FROM h)
SELECT k, CASE WHEN NOT odd THEN g1 END AS group_name, CASE WHEN NOT odd THEN s0 END AS subgroup,
  coalesce({_part_sql('slice', R.CLUSTER)}, {_part_sql('slices', R.CLUSTER)}, {_part_sql('area', R.CLUSTER)}, CASE WHEN {_CLEAR('slice')} IS NOT NULL THEN CASE WHEN length(slice) = 2 THEN slice || '片' ELSE slice END END) AS cluster,
  coalesce({_part_sql('slices', R.SUBCLUSTER)}, {_part_sql('slice', R.SUBCLUSTER)}, {_CLEAR('slices')}) AS subcluster FROM o""")
def subgroup_classify(spark, sf):
    a, s, ss = F.col("area"), F.col("slice"), F.col("slices")
    group, subgroup = R.consistent(R.group_of(a, s), R.subgroup_of(a, s))
    return locations(spark, sf).select("k", group.alias("group_name"), subgroup.alias("subgroup"), R.cluster_of(a, s, ss).alias("cluster"), R.subcluster_of(s, ss).alias("subcluster"))


def _place(x: str) -> str:
    return _rewrite(f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')", R.PLACE_REWRITES)


_NONE = "(" + ", ".join(map(_q, R.NONE_MARKS)) + ")"


@query(f"WITH {_LOC} SELECT k, {_place('city')} AS place FROM l")
def location_clean(spark, sf):
    return locations(spark, sf).select("k", R.clean_place(F.col("city")).alias("place"))


@query(f"""WITH {_LOC}, n AS (SELECT k, area, CASE WHEN city NOT IN {_NONE} THEN city END AS city, CASE WHEN county NOT IN {_NONE} THEN county END AS county FROM l),
p AS (SELECT k, area, {_place('city')} AS a, {_place('county')} AS b FROM n), j AS (SELECT *, CASE WHEN a = b THEN a ELSE coalesce(a, '') || coalesce(b, '') END AS s FROM p)
SELECT k, CASE WHEN s <> '' THEN s ELSE area END AS spot FROM j""")
def spot_name(spark, sf):
    return locations(spark, sf).select("k", R.spot_name(R.drop_none_marks(F.col("city")), R.drop_none_marks(F.col("county")), F.col("area")).alias("spot"))


_RAW_GROUPS = ("北京官話區", "閩東區侯官片", "桂北平話", "廣西桂北", "湘南", "粵北土話", "其他", None, "西南官話")


@query(f"WITH l AS (SELECT p_partkey AS k, {_PICK('p_partkey', _RAW_GROUPS)} AS g FROM part) SELECT k, {_first('g', R.SUBGROUP_RULES_RAW)} AS subgroup FROM l")
def subgroup_clean(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), _pick("p_partkey", _RAW_GROUPS).alias("g")).select("k", R.clean_subgroup(F.col("g")).alias("subgroup"))


_LABELS = ("中原官話-兗菏片-甲小片", "鄕話-沅陵片", "平話和土話-桂南片", "平話和土話-粵北片", None, "吳語", "西南官话-成渝片")


@query(f"""WITH l AS (SELECT p_partkey AS k, string_split({_PICK('p_partkey', _LABELS)}, '-') AS p FROM part), h AS (SELECT k, p, CASE p[1] WHEN '鄕話' THEN '鄉話' ELSE p[1] END AS h FROM l)
SELECT k, CASE WHEN suffix(h, '官話') OR suffix(h, '官话') THEN '官話' WHEN h = '平話和土話' THEN CASE WHEN p[2] IN ('桂南片', '桂北片') THEN '平話' ELSE '土話' END ELSE h END AS group_name,
  CASE WHEN suffix(h, '官話') OR suffix(h, '官话') THEN h END AS subgroup, p[2] AS cluster, p[3] AS subcluster FROM h""")
def area_split(spark, sf):
    a = R.split_area(F.col("g"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), _pick("p_partkey", _LABELS).alias("g")).select("k", a["group"].alias("group_name"), *(a[c].alias(c) for c in ("subgroup", "cluster", "subcluster")))


@query("SELECT p_partkey AS k, CAST(p_size AS DOUBLE) AS latitude, round(p_retailprice, 2) AS longitude FROM part")
def coord_parse(spark, sf):
    c = R.split_coordinates(F.col("x"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.concat(F.round("p_retailprice", 2).cast("string"), F.lit(","), F.col("p_size").cast("string")).alias("x"))
    return p.select("k", *(c[n].alias(n) for n in ("latitude", "longitude")))


@query("SELECT o_orderkey AS k, CAST(dayofyear(o_orderdate) AS VARCHAR) AS tone FROM orders")
def date_repair(spark, sf):
    text = F.date_format("o_orderdate", "y年M月d日")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), P.day_of_year_repair(text).alias("tone"))


@query(f"WITH {WORDS} SELECT word, regexp_replace(split_part(word, '.', 1), '[^上中下變陰陽平去入輕聲]', '', 'g') AS out FROM w")
def tone_category_clean(spark, sf):
    return words(spark, sf).select("word", P.clean_tone_category(F.col("word")).alias("out"))


# loaders: raw layouts made from the tables

_RAW_INI, _RAW_FIN = ("tsh", "ŋ", "∅", "ph", "", "Tw", None, "kʋ"), ("iɒ", "uə", "ã", "", "m", None, "e1", "ai")


@query(f"""WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, {_PICK('l_partkey', _RAW_INI)} AS i, {_PICK('l_orderkey', _RAW_FIN)} AS f, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_linenumber || '.0' END AS t FROM lineitem),
x AS (SELECT CAST(l_orderkey AS VARCHAR) AS did, CAST(l_partkey AS VARCHAR) AS cid, nullif({_unless("translate(" + _ipa('i') + ", '¤ø', 'ɲ∅')", P.CONSONANTS + P.DIACRITICS)}, '') AS initial,
  nullif({_keep(_ipa('f'), P.LETTERS + P.DIACRITICS + P.SUPRASEGMENTALS)}, '') AS final, nullif({_unless("regexp_replace(t, '\\.0$', '')", P.TONES)}, '') AS tone FROM q)
SELECT did, cid, 'x' AS character, initial, final, translate(tone, '12345', '¹²³⁴⁵') AS tone, CAST(NULL AS VARCHAR) AS note FROM x WHERE initial IS NOT NULL OR final IS NOT NULL OR tone IS NOT NULL""")
def load_survey(spark, sf):
    raw = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("did"), F.col("l_partkey").cast("string").alias("iid"), F.lit("x").alias("name"), F.lit("").alias("memo"), _pick("l_partkey", _RAW_INI).alias("initial"),
        _pick("l_orderkey", _RAW_FIN).alias("finals"), F.when(F.col("l_linenumber") != 2, F.concat(F.col("l_linenumber").cast("string"), F.lit(".0"))).alias("tone"),
    )
    return D.load_survey(raw, superscript_tone=True)


_SOUNDS = ("ma1", "tsh2a", "ŋ3", "a", "phŋ2", "123", None)


@query(f"""WITH q AS (SELECT l_orderkey, {_PICK('l_partkey', _SOUNDS)} AS y FROM lineitem), s AS (SELECT l_orderkey, regexp_extract(y, '{P.SYLLABLE_TONE}', 1) AS g, nullif(regexp_extract(y, '{P.SYLLABLE_TONE}', 2), '') AS n, y FROM q),
c AS (SELECT *, {_ipa('g', True)} AS z FROM s), x AS (SELECT CAST(l_orderkey % 3 AS VARCHAR) AS did, CASE WHEN y IS NOT NULL AND regexp_matches(z, {_q(P.SYLLABLE)}) THEN regexp_extract(z, {_q(P.SYLLABLE)}, 1) END AS initial,
  CASE WHEN y IS NOT NULL AND regexp_matches(z, {_q(P.SYLLABLE)}) THEN regexp_extract(z, {_q(P.SYLLABLE)}, 2) END AS final, CASE n WHEN '1' THEN '55' WHEN '2' THEN '21' END AS tone, CASE n WHEN '1' THEN '陰平' WHEN '2' THEN '上聲' END AS tone_category FROM c)
SELECT did, CAST(NULL AS VARCHAR) AS cid, 'x' AS character, CASE WHEN initial = '' THEN '∅' ELSE initial END AS initial, final, tone, tone_category, CAST(NULL AS VARCHAR) AS note FROM x WHERE initial IS NOT NULL OR final IS NOT NULL OR tone IS NOT NULL""")
def load_dictionary(spark, sf):
    raw = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 3).cast("string").alias("did"), F.lit("x").alias("漢字"), _pick("l_partkey", _SOUNDS).alias("音標"), F.lit("").alias("解釋"))
    tones = spark.createDataFrame([(str(d), '{"1": ["55a", "", "", "陰平"], "2": ["21", "", "", "上聲"]}') for d in range(3)], "did string, `聲調` string")
    return D.load_dictionary(raw, D.dictionary_tones(tones))


_CATS = ("陰平.x", "上聲", "a去", "")


@query(f"""WITH q AS (SELECT l_orderkey, l_partkey, (l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey AS seq, {_PICK('l_orderkey', _RAW_INI)} AS i, {_PICK('l_partkey', _RAW_FIN)} AS f, {_PICK('l_linenumber', _CATS)} AS k, l_linenumber || '.9' AS t FROM lineitem),
w AS (SELECT l_partkey, coalesce(i, first_value(i IGNORE NULLS) OVER p) AS i, coalesce(f, first_value(f IGNORE NULLS) OVER p) AS f, k, t FROM q WINDOW p AS (PARTITION BY l_partkey ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
x AS (SELECT nullif({_unless('split_part(' + _ipa('i') + ", '.', 1)", P.CONSONANTS + P.DIACRITICS)}, '') AS initial, nullif({_keep('split_part(' + _ipa('f') + ", '.', 1)", P.LETTERS + P.DIACRITICS + P.SUPRASEGMENTALS)}, '') AS final,
  nullif({_unless("split_part(translate(t, '0', '∅'), '.', 1)", P.TONES)}, '') AS tone, nullif(regexp_replace(split_part(k, '.', 1), '[^上中下變陰陽平去入輕聲]', '', 'g'), '') AS tone_category, CAST(l_partkey AS VARCHAR) AS cid FROM w)
SELECT '9' AS did, cid, 'x' AS character, coalesce(initial, '-') AS initial, coalesce(final, '-') AS final, coalesce(tone, '-') AS tone, coalesce(tone_category, '-') AS tone_category, CAST(NULL AS VARCHAR) AS note FROM x WHERE initial IS NOT NULL OR final IS NOT NULL OR tone IS NOT NULL""")
def load_archive(spark, sf):
    seq = ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_suppkey")).alias("seq")
    raw = table(spark, sf, "lineitem").select(
        F.lit("9").alias("did"), seq, F.col("l_partkey").cast("string").alias("Order"), F.lit("x").alias("Char"), _pick("l_orderkey", _RAW_INI).alias("ShengMu"), _pick("l_partkey", _RAW_FIN).alias("YunMu"),
        F.concat(F.col("l_linenumber").cast("string"), F.lit(".9")).alias("DiaoZhi"), _pick("l_linenumber", _CATS).alias("DiaoLei"), F.lit(None).cast("string").alias("Comment"),
    )
    return D.load_archive(raw, na="-")


# imputation, neighbours, vectors

_SMALL = f"{CELLS}, m AS (SELECT cid, unnest(['0_f', '1_f', '2_t', '3_t']) AS col, unnest([max(final) FILTER (did = '0'), max(final) FILTER (did = '1'), max(tone) FILTER (did = '2'), max(tone) FILTER (did = '3')]) AS value FROM c GROUP BY cid), n AS (SELECT p_partkey FROM part WHERE p_size = 7), s AS (SELECT m.* FROM m JOIN n ON m.cid = CAST(p_partkey AS VARCHAR))"


def small_cells(spark, sf):
    """Cells of parts of one size and four columns: the table of the two queries that have SQL (``all_cells`` is the whole)."""
    c, pick = cells(spark, sf), lambda e, d: F.max(F.when(F.col("did") == d, F.col(e)))
    ids = table(spark, sf, "part").where("p_size = 7").select(F.col("p_partkey").cast("string").alias("cid"))
    pairs = F.explode(F.array(*(F.struct(F.lit(f"{d}_{e[0]}").alias("col"), F.col(f"{d}_{e}").alias("value")) for d, e in (("0", "final"), ("1", "final"), ("2", "tone"), ("3", "tone")))))
    w = c.join(ids, "cid", "left_semi").groupBy("cid").agg(*(pick(e, d).alias(f"{d}_{e}") for d, e in (("0", "final"), ("1", "final"), ("2", "tone"), ("3", "tone"))))
    return w.select("cid", pairs.alias("x")).select("cid", "x.col", "x.value")


def all_cells(spark, sf):
    """Filled cells of all parts and localities, a column for each locality and element."""
    return C.melt(cells(spark, sf)).select("cid", F.concat_ws("/", "did", "element").alias("col"), "value")


_DIST = """t AS (SELECT cid, col, unnest(tk) AS token, 1 / sqrt(len(tk)) AS w FROM (SELECT cid, col, list_distinct(list_filter(string_split_regex(coalesce(value, ''), '\\s+'), lambda x: x <> '')) AS tk FROM s) WHERE len(tk) > 0),
nn AS (SELECT cid, sqrt(count(DISTINCT col)) AS n FROM t GROUP BY cid), dot AS (SELECT a.cid AS a, b.cid AS b, sum(a.w * b.w) AS dot FROM t a JOIN t b USING (col, token) GROUP BY ALL),
i AS (SELECT DISTINCT cid FROM s), dist AS (SELECT a.cid AS a, b.cid AS b, CASE WHEN a.cid = b.cid THEN 0.0 ELSE greatest(0, least(2, 1 - coalesce(dot / na.n / nb.n, 0))) END AS distance
  FROM i a CROSS JOIN i b LEFT JOIN dot ON dot.a = a.cid AND dot.b = b.cid LEFT JOIN nn na ON na.cid = a.cid LEFT JOIN nn nb ON nb.cid = b.cid)"""


@query(f"WITH {_SMALL}, {_DIST} SELECT a, b, round(distance, 6) + 0.0 AS distance FROM dist")
def character_distances(spark, sf):
    return I.character_distances(small_cells(spark, sf)).select("a", "b", (F.round("distance", 6) + 0.0).alias("distance"))


@query(f"""WITH {_SMALL}, {_DIST}, k AS (SELECT * FROM s WHERE coalesce(value, '') <> ''), g AS (SELECT i.cid, c.col FROM i CROSS JOIN (SELECT DISTINCT col FROM s) c ANTI JOIN k ON k.cid = i.cid AND k.col = c.col),
nb AS (SELECT g.cid, g.col, k.value, row_number() OVER (PARTITION BY g.cid, g.col ORDER BY round(distance, 6), k.cid) AS r, greatest(round(distance, 6), 0) AS d FROM g JOIN k USING (col) JOIN dist ON dist.a = g.cid AND dist.b = k.cid),
v AS (SELECT cid, col, token, round(sum(1 / (d + 1e-4)), 6) AS w FROM (SELECT cid, col, d, unnest(list_distinct(list_filter(string_split_regex(value, '\\s+'), lambda x: x <> ''))) AS token FROM nb WHERE r <= 3) GROUP BY ALL)
SELECT cid, col, value, FALSE AS imputed FROM k UNION ALL SELECT cid, col, token, TRUE FROM v QUALIFY row_number() OVER (PARTITION BY cid, col ORDER BY w DESC, token) = 1""")
def impute_cells(spark, sf):
    return I.impute(small_cells(spark, sf)).select("cid", "col", "value", "imputed")


@query()
def character_distances_all(spark, sf):
    return I.character_distances(all_cells(spark, sf), digits=6)


@query()
def impute_cells_all(spark, sf):
    return I.impute(all_cells(spark, sf)).select("cid", "col", "value", "imputed")


@query("""WITH e AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS lat, CAST(embedding[2] AS DOUBLE) AS lon, label FROM embeddings),
d AS (SELECT q.id, r.label, row_number() OVER (PARTITION BY q.id ORDER BY round((q.lat - r.lat) ** 2 + (q.lon - r.lon) ** 2, 9), r.id) AS k FROM e q CROSS JOIN e r WHERE q.id % 50 = 0 AND r.id % 50 <> 0),
v AS (SELECT id, label, count(*) AS n FROM d WHERE k <= 5 GROUP BY ALL) SELECT id, label FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1""")
def knn_predict_group(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("lat"), F.col("embedding")[1].cast("double").alias("lon"), "label")
    return I.predict_group(e.where("id % 50 = 0").drop("label"), e.where("id % 50 <> 0"))


_VEC = f"WITH {READ}, j AS (SELECT did, cid, string_agg(final, ' ' ORDER BY seq, final) AS final, string_agg(tone, ' ' ORDER BY seq, tone) AS tone FROM r GROUP BY did, cid), v AS (SELECT did || '/' || cid AS \"row\", unnest(['final', 'tone']) AS col, unnest([final, tone]) AS cell FROM j), u AS (SELECT \"row\", col, unnest(string_split(cell, ' ')) AS token FROM v), k AS (SELECT \"row\", col, token, CAST(count(*) AS DOUBLE) AS weight FROM u WHERE token <> '' GROUP BY ALL) "


def _vector_cells(spark, sf):
    return C.transform(readings(spark, sf), "did", "cid", ["final", "tone"], "join").withColumn("key", F.concat_ws("/", "did", "cid"))


@query(_VEC + "SELECT * FROM k")
def vectorize_counts(spark, sf):
    return E.vectorize(_vector_cells(spark, sf), "key", ["final", "tone"])


@query(_VEC + "SELECT \"row\", col, token, round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY \"row\", col)), 6) AS weight FROM k")
def vectorize_l2(spark, sf):
    return E.vectorize(_vector_cells(spark, sf), "key", ["final", "tone"], norm="l2").select("row", "col", "token", F.round("weight", 6).alias("weight"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS id FROM events")
def encode_unknown_zero(spark, sf):
    return E.with_vocabulary(table(spark, sf, "events"), "event_type", ["click", "view"]).select("event_id", "id")


@query("""WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), s AS (SELECT avg(x) mx, stddev_pop(x) sx, avg(y) my, stddev_pop(y) sy FROM e)
SELECT vec_id, round(greatest(0, least(1, (x - mx) / sx / 6 + 0.5)), 6) AS r, round(greatest(0, least(1, (y - my) / sy / 6 + 0.5)), 6) AS g, 0.5::DOUBLE AS b FROM e, s""")
def pc_to_color(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return E.pc2color(e, ["x", "y"]).select("vec_id", F.round("r", 6).alias("r"), F.round("g", 6).alias("g"), "b")


@query("""WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), k AS (SELECT user_id, n, -ln((CAST('0x' || substr(md5(CAST(user_id AS VARCHAR) || '#0'), 1, 8) AS BIGINT) + 0.5) / 4294967296.0) / (n * n) AS key FROM c),
o AS (SELECT user_id, row_number() OVER (ORDER BY key, user_id) AS i, sum(n) OVER (ORDER BY key, user_id ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER () AS total, count(*) OVER () AS k FROM k)
SELECT event_id, CASE WHEN i = 1 THEN TRUE WHEN i = k THEN FALSE ELSE cum < 0.9 * total END AS train FROM events LEFT JOIN o USING (user_id)""")
def value_disjoint_split(spark, sf):
    return E.value_disjoint_split(table(spark, sf, "events"), "user_id").select("event_id", "train")


@query("""WITH u AS (SELECT doc_id, source, (CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '#0'), 1, 8) AS BIGINT) + 0.5) / 4294967296.0 AS u, CASE WHEN count(*) OVER (PARTITION BY source) >= 2 THEN source ELSE '' END AS s FROM documents),
r AS (SELECT doc_id, (row_number() OVER (PARTITION BY s ORDER BY u, doc_id) - 0.5) / count(*) OVER (PARTITION BY s) AS r FROM u) SELECT doc_id, CASE WHEN r < 0.1 THEN 'test' WHEN r < 0.2 THEN 'val' ELSE 'train' END AS part FROM r""")
def stratified_split(spark, sf):
    return E.stratified_split(table(spark, sf, "documents"), "doc_id", "source").select("doc_id", "part")


@query(f"WITH {READ}, k AS (SELECT did FROM (SELECT DISTINCT did FROM r) ORDER BY CAST('0x' || substr(md5(did || '#1'), 1, 8) AS BIGINT), did LIMIT 6) SELECT did, cid, initial, final, tone, seq FROM r SEMI JOIN k USING (did)")
def sample_dialects(spark, sf):
    return D.Dataset(readings(spark, sf)).sample(6, seed=1).data


# lookups, numbering and splits by count


@query("SELECT ps.l_orderkey, ps.l_linenumber, CAST(o.event_id AS VARCHAR) AS event_id FROM (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem) ps LEFT JOIN (SELECT user_id, event_id % 100 AS k, min(event_id) AS event_id FROM events GROUP BY ALL) o ON o.user_id = ps.l_suppkey AND o.k = ps.l_partkey % 100")
def composite_lookup(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("user_id"), (F.col("l_partkey") % 100).alias("k"))
    known = table(spark, sf, "events").groupBy("user_id", (F.col("event_id") % 100).alias("k")).agg(F.min("event_id").alias("v"))
    return L.lookup(lines, known, ["user_id", "k"], "v", "event_id").select("l_orderkey", "l_linenumber", F.col("event_id").cast("string").alias("event_id"))


@query("""WITH d AS (SELECT p_partkey, p_brand, p_type, CASE WHEN p_partkey % 3 = 0 THEN p_partkey END AS label FROM part), t AS (SELECT p_brand, p_type, min(p_partkey) AS label FROM part WHERE p_size < 20 GROUP BY ALL)
SELECT p_partkey, CAST(coalesce(d.label, t.label) AS VARCHAR) AS label FROM d LEFT JOIN t USING (p_brand, p_type)""")
def fill_labels(spark, sf):
    p = table(spark, sf, "part")
    t = p.where("p_size < 20").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("label"))
    return L.fill_from(p.select("p_partkey", "p_brand", "p_type", F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey")).alias("label")), t, ["p_brand", "p_type"], "label").select("p_partkey", F.col("label").cast("string").alias("label"))


@query(f"WITH {READ} SELECT did, cid, seq, n_name FROM r LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) n ON CAST(n.n_nationkey AS VARCHAR) = did")
def attach_info(spark, sf):
    info = table(spark, sf, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").cast("string").alias("did"), "n_name", "n_regionkey")
    return L.attach(readings(spark, sf), info, "did", ["n_name", "n_regionkey"]).select("did", "cid", "seq", "n_name")


@query("SELECT 'nation' AS dataset, n_name AS name, row_number() OVER (ORDER BY n_name) - 1 AS did FROM nation UNION ALL SELECT 'supplier', s_name, row_number() OVER (ORDER BY s_name) - 1 + (SELECT count(*) FROM nation) FROM supplier")
def concat_numbered(spark, sf):
    n, s = table(spark, sf, "nation").select(F.col("n_name").alias("name")), table(spark, sf, "supplier").select(F.col("s_name").alias("name"))
    return L.concat_numbered(["name"], nation=n, supplier=s).select("dataset", "name", "did")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_name, c_custkey) - 1 AS number FROM customer")
def number_rows(spark, sf):
    return L.numbered(table(spark, sf, "customer").select("c_custkey", "c_name"), ["c_name", "c_custkey"], ranges=16).select("c_custkey", "number")


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def keep_first(spark, sf):
    return L.keep_first(table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


_HASH = "CAST('0x' || substr(md5(CAST({} AS VARCHAR) || '#0'), 1, 8) AS BIGINT)"


@query(f"""WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source), e AS (SELECT source, n * 50 / sum(n) OVER () AS t, n * 30 / sum(n) OVER () AS v FROM n),
s AS (SELECT source, floor(t) + CASE WHEN row_number() OVER (ORDER BY round(t - floor(t), 9) DESC, source) <= 50 - sum(floor(t)) OVER () THEN 1 ELSE 0 END AS t, floor(v) + CASE WHEN row_number() OVER (ORDER BY round(v - floor(v), 9) DESC, source) <= 30 - sum(floor(v)) OVER () THEN 1 ELSE 0 END AS v FROM e),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_HASH.format('doc_id')}, doc_id) AS r FROM documents)
SELECT doc_id, CASE WHEN r <= t THEN 'test' WHEN r <= t + v THEN 'val' ELSE 'train' END AS part FROM r JOIN s USING (source)""")
def split_counts(spark, sf):
    return L.split_counts(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", "source", 50, 30).select("doc_id", "part")


@query(f"WITH d AS (SELECT DISTINCT c_custkey FROM customer) SELECT c_custkey, CAST(CASE WHEN row_number() OVER (ORDER BY {_HASH.format('c_custkey')}, c_custkey) <= (SELECT count(*) FROM d) // 2 THEN 1 ELSE 2 END AS INTEGER) AS half FROM d")
def random_halves(spark, sf):
    return L.halves(table(spark, sf, "customer"), "c_custkey")


# numerics without SQL: tests hold them against numpy


def _halves(spark, sf):
    """Two datasets over the same glyphs, readings of the localities of even and of odd number.

    A glyph is a name and a brand among 2,000 parts: the names alone are so few that in larger tables no glyph has one reading.
    """
    c = cells(spark, sf).persist()  # read for each step of the alignment
    name = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("cid"), F.concat_ws(" ", "p_name", "p_brand", F.floor(F.col("p_partkey") / 2000).cast("string")).alias("glyph"))
    out = []
    for i in (1, 2):
        long = C.melt(c.where(F.col("did").cast("int") % 2 == i - 1)).join(name, "cid").select("cid", "glyph", F.concat_ws("/", "did", "element").alias("col"), "value")
        out.append((long.select("cid", "col", "value"), long.select(F.lit(i).alias("ds"), "cid", "glyph").distinct()))
    return [a for a, _ in out], out[0][1].unionByName(out[1][1])


@query()
def align_datasets(spark, sf):
    return AL.align(*_halves(spark, sf))


@query()
def bilinear_predict(spark, sf):
    return M.fit_characters(cells(spark, sf), "did", "cid", ["final"])[0]


@query()
def rbf_area(spark, sf):
    g = places(spark, sf).withColumn("label", (F.col("id") % 3).cast("string"))
    return G.area(g, G.grid(spark, 0, 100, 24, 106, 40), "label", "id")


@query()
def rbf_isogloss(spark, sf):
    g = places(spark, sf).withColumn("value", (F.col("id") % 2).cast("double"))
    return G.isogloss(g, G.grid(spark, 0, 100, 24, 106, 40), "value", "id")


@query()
def heatmap_order(spark, sf):
    return G.heatmap_order(S.sim2dist(S.chi2(cells(spark, sf))))


@query()
def recon_tree(spark, sf):
    return X.reconstruct_elements(all_cells(spark, sf))
