"""Exact deduplication by content-defined chunk recipes, in DataFrame operations only.

A text (A-Z lower-cased) is cut where its own content says so: after a vowel and a space, tab or line end
that end a run of at least ``low`` characters, and after ``high`` characters at the latest. Cuts follow the
content, so texts that share a passage share its chunks.

Every distinct chunk crosses the network once, keyed by its 64-bit hash and compared byte by byte there:
chunks that share a hash get ordinals, and a chunk's verified identifier is (hash, ordinal). Where hashes
collide (at 100 TB some hundred do), the chunks with such a hash, and no others, look their ordinals up; they go
back to their texts as (position, ordinal), so no text is moved for it. A document's recipe is the ordered list of
its identifiers; documents are equal when recipes are. Only recipes, about a hundredth of the text, are grouped
(with partial aggregation, so a hot group is one row a task) and joined back, which adaptive execution
splits where a recipe is hot.

Null texts count as empty, and all empty texts are one group (an empty recipe). The largest id of a group
stays; rows with a null id stay only if the group has no other. Rows that repeat the kept id (or, in a group
without ids, all its rows) count as kept each in ``exact_groups``; ``keep_one`` keeps one of them. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, read

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def chunks(text: Column, low: int = 512, high: int = 4096) -> Column:
    """Content-defined chunks of a text, in order; joined they give the text back."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{low},{high - 2}}}?[aeiou][ \t\n]|.{{1,{high}}}"), F.lit(0))


def collided(hashed: DataFrame, store: Scratch) -> DataFrame | None:
    """Ordinals above 0 of chunks whose hash other chunks share: hash, chunk, ordinal, written. None, as a rule, if there are none.

    Which hashes these are is written first: a join planned without that would send every chunk a second time, by its hash.
    """
    distinct = hashed.groupBy("hash", "chunk").agg(F.lit(1).alias("one"))
    several = store.table(distinct.groupBy("hash").agg(F.count("one").alias("n")).where("n > 1").select("hash"))
    if several.isEmpty():
        return None
    order = Window.partitionBy("hash").orderBy("chunk")
    concerned = hashed.join(several, "hash", "left_semi").distinct()
    return store.table(concerned.select("hash", "chunk", (F.row_number().over(order) - 1).alias("ordinal")).where("ordinal > 0"))


def recipes(docs: DataFrame, store: Scratch, id_col: str = "doc_id", text_col: str = "text", hash_of=F.xxhash64) -> DataFrame:
    """id, recipe (array of hash and ordinal), text_sha256 of every row, written. ``hash_of``: for tests."""
    cut = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("t"))
    pieces = cut.select(F.explode(chunks(F.col("t"))).alias("chunk")).select(hash_of("chunk").alias("hash"), "chunk")
    odd = collided(pieces, store)
    sha = F.sha2(F.col("t"), 256).alias("text_sha256")
    own = store.table(cut.select("id", F.transform(chunks(F.col("t")), lambda c: F.struct(hash_of(c).alias("hash"), F.lit(0).alias("ordinal"))).alias("recipe"), sha))
    if odd is None:
        return own
    places = cut.select(sha, F.posexplode(chunks(F.col("t"))).alias("pos", "chunk")).withColumn("hash", hash_of("chunk"))
    found = places.join(odd.select("hash").distinct(), "hash", "left_semi").join(odd, ["hash", "chunk"]).select("text_sha256", "pos", "ordinal").distinct()
    ordinals = found.groupBy("text_sha256").agg(F.map_from_entries(F.collect_list(F.struct("pos", "ordinal"))).alias("at"))  # at most a text's chunks
    mended = F.transform("recipe", lambda x, i: F.struct(x["hash"].alias("hash"), F.coalesce(F.try_element_at("at", i), F.lit(0)).alias("ordinal")))
    return store.table(own.join(ordinals, "text_sha256", "left").select("id", F.when(F.col("at").isNull(), F.col("recipe")).otherwise(mended).alias("recipe"), "text_sha256"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=F.xxhash64) -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256."""
    store = Scratch(docs.sparkSession)
    own = recipes(docs, store, id_col, text_col, hash_of)
    # written, so that the join reads two plain exchanges and adaptive execution can split a hot recipe
    groups = store.table(own.groupBy("recipe").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"))
    joined = own.join(groups, "recipe", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), keep.eqNullSafe(F.col("id")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, all columns kept."""
    store = Scratch(docs.sparkSession)
    groups = store.table(exact_groups(docs, id_col, text_col).where("group_size > 1").select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_sha"), "kept"))
    again = groups.where("kept").groupBy("_id", "_sha").agg(F.count("*").alias("n")).where("n > 1").select("_id", "_sha")
    on = lambda side: docs[id_col].eqNullSafe(side["_id"]) & (F.sha2(normalised(docs[text_col]), 256) == side["_sha"])
    gone = groups.where(~F.col("kept")).select("_id", "_sha")
    if again.isEmpty():
        return docs.join(gone, on(gone), "left_anti")
    gone = gone.unionByName(again)
    rest, repeated = docs.join(gone, on(gone), "left_anti"), docs.join(again, on(again), "left_semi")
    plain = [c for c in docs.columns if c not in (id_col, text_col)]
    one = repeated.groupBy(id_col, F.sha2(normalised(F.col(text_col)), 256).alias("_sha")).agg(F.first(F.struct(text_col, *plain)).alias("_row"))
    return rest.unionByName(one.select(id_col, "_row.*").select(docs.columns))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM t WINDOW w AS (PARTITION BY t)
"""
