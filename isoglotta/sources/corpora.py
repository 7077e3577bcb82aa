"""The three corpora as datasets over folders: readers of their files, locality and character tables, a cache, and the catalog.

A corpus is lazy: no file is read before a table is asked for. ``filter`` gives the same corpus with fewer localities,
and prunes the files that are read.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import datasets as D

Simplify = Callable


class Corpus(D.Dataset):
    """A dataset whose tables come from methods; ``cache`` names a folder for read-through copies of all three."""

    corpus_name = ""

    def __init__(self, spark: SparkSession, home: str, cache: str | None = None, dids: list[str] | None = None, simplify: Simplify = lambda c: c, **options):
        super().__init__(name=self.corpus_name)
        self.spark, self.home, self.cache, self.dids, self.simplify, self.options = spark, home.rstrip("/"), cache, dids, simplify, options

    def load_info(self) -> DataFrame:
        raise NotImplementedError

    def load_characters(self) -> DataFrame | None:
        return None

    def load_readings(self, dids: list[str] | None) -> DataFrame:
        raise NotImplementedError

    def _through(self, part: str, make: Callable[[], DataFrame], folders: bool = False) -> DataFrame:
        """The cached table ``part``, written first if it isn't there; with ``folders`` one for each locality (``_at``: "d" and its id, so
        that it stays a string)."""
        if self.cache is None:
            return make()
        path = f"{self.cache}/{part}"
        if not _exists(self.spark, path):
            if folders:
                make().withColumn("_at", F.concat(F.lit("d"), "did")).write.mode("ignore").partitionBy("_at").parquet(path)
            else:
                make().write.mode("ignore").parquet(path)
        return self.spark.read.parquet(path)

    def _some(self, d: DataFrame) -> DataFrame:
        return d if self.dids is None else d.where(F.col("did").isin(self.dids) if self.dids else F.lit(False))

    @property
    def data(self) -> DataFrame:
        if self.cache is None:
            return self._some(self.load_readings(self.dids))
        kept = self._through("readings", lambda: self.load_readings(None), True)
        return (kept if self.dids is None else kept.where(F.col("_at").isin([f"d{d}" for d in self.dids]) if self.dids else F.lit(False))).drop("_at")

    @property
    def dialect_info(self) -> DataFrame:
        return self._some(self._through("dialects", self.load_info))

    @property
    def characters(self) -> DataFrame:
        def make() -> DataFrame:
            own = self.load_characters()
            return super(Corpus, self).characters if own is None else own

        return self._through("characters", make)

    def filter(self, dids: Iterable[str]) -> "Corpus":
        """The same corpus with these localities only; unknown ones are ignored."""
        dids = [d for d in dict.fromkeys(dids) if self.dids is None or d in self.dids]
        return type(self)(self.spark, self.home, self.cache, dids, self.simplify, **self.options)

    def clear_cache(self, *parts: str) -> None:
        """Delete cached tables: readings, dialects, characters (all if none is named)."""
        if self.cache is not None:
            for part in parts or ("readings", "dialects", "characters"):
                D.clear_cache(self.spark, f"{self.cache}/{part}")

    def refresh(self, *parts: str) -> None:
        """Write cached tables anew."""
        self.clear_cache(*parts)
        for part in parts or ("readings", "dialects", "characters"):
            {"readings": lambda: self.data, "dialects": lambda: self.dialect_info, "characters": lambda: self.characters}[part]()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_dictionary(spark: SparkSession, path: str, dids: list[str] | None = None) -> DataFrame:
    """(did, 漢字, 音標, 解釋) of tab-separated tables without a header, one file for each locality (<did>.tsv); ``#`` starts a comment."""
    files = f"{path}/*.tsv" if dids is None else [f"{path}/{d}.tsv" for d in dids]
    raw = spark.read.option("sep", "\t").option("comment", "#").option("quote", "").csv(files, schema="`漢字` string, `音標` string, `解釋` string")
    return raw.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.tsv$", 1).alias("did"), "漢字", "音標", "解釋")


def sheet_rows(content: bytes) -> Iterator[dict[str, str | None]]:
    """Rows of a workbook's first sheet as strings by the header's names; empty cells are None.

    A workbook is a zip of XML: shared strings, and cells that name their column and refer to them.
    """
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    text = lambda e: "".join(t.text or "" for t in e.iter() if local(t) == "t")
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = [text(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        sheet = min((n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)), key=lambda n: (len(n), n))
        header: dict[str, str] | None = None
        for row in (e for e in ElementTree.fromstring(z.read(sheet)).iter() if local(e) == "row"):
            cells: dict[str, str] = {}
            for k, c in enumerate(e for e in row if local(e) == "c"):
                column = re.sub(r"\d", "", c.get("r") or "") or str(k)
                value = next((e.text for e in c if local(e) == "v"), None)
                if c.get("t") == "s" and value is not None:
                    value = shared[int(value)]
                elif c.get("t") == "inlineStr":
                    value = text(c)
                if value:
                    cells[column] = value
            if header is None:
                header = cells
            elif cells:
                yield {name: cells.get(k) for k, name in header.items()}


def read_sheets(files: DataFrame) -> DataFrame:
    """Archive readings of workbooks (did, content): the sheets' columns by the usual names, did and seq."""

    def run(frames):
        import pandas as pd

        for f in frames:
            for did, content in zip(f.did, f.content):
                rows = [{D.ARCHIVE_ALIASES.get(k, k): v for k, v in r.items()} for r in sheet_rows(content)]
                yield pd.DataFrame(rows, dtype=object).reindex(columns=list(D.ARCHIVE_NAMES)).assign(did=did, seq=range(len(rows)))

    return files.select("did", "content").mapInPandas(run, ", ".join(f"`{n}` string" for n in D.ARCHIVE_NAMES) + ", did string, seq bigint")


def archive_characters(table: DataFrame) -> DataFrame:
    """(cid, character) of the archive's character table (字號, 字)."""
    return table.select(F.col("字號").alias("cid"), F.col("字").alias("character"))


def survey_characters(words: DataFrame) -> DataFrame:
    """The survey's item table with ``item`` as character and ``memo`` as note."""
    return words.withColumnsRenamed({"item": "character", "memo": "note"})


class Dictionary(Corpus):
    """Home: info.json and tables <did>.tsv in ``tables`` (or the paths in the options ``info`` and ``tables``)."""

    corpus_name = "MCPDict"

    @property
    def tables(self) -> str:
        return self.options.get("tables", f"{self.home}/tables")

    def entries(self) -> DataFrame:
        return D.modern_entries(D.read_dictionary_info(self.spark, self.options.get("info", f"{self.home}/info.json")))

    def load_info(self) -> DataFrame:
        return D.dictionary_dialects(self.entries(), self.simplify)

    def load_readings(self, dids: list[str] | None) -> DataFrame:
        tones = D.dictionary_tones(self.entries().withColumn("did", F.col("簡稱")))
        load = {k: v for k, v in self.options.items() if k in ("superscript_tone", "na", "empty")}
        return D.load_dictionary(read_dictionary(self.spark, self.tables, dids), tones, **load)


class Archive(Corpus):
    """Home: workbooks <did>.xlsx, dialects.csv and characters.csv."""

    corpus_name = "CCR"

    def load_info(self) -> DataFrame:
        return D.archive_dialects(self.spark.read.csv(f"{self.home}/dialects.csv", header=True), self.simplify)

    def load_characters(self) -> DataFrame:
        return archive_characters(self.spark.read.csv(f"{self.home}/characters.csv", header=True))

    def load_readings(self, dids: list[str] | None) -> DataFrame:
        files = f"{self.home}/*.xlsx" if dids is None else [f"{self.home}/{d}.xlsx" for d in dids]
        raw = self.spark.read.format("binaryFile").load(files).select(F.regexp_extract("path", r"([^/]*)\.xlsx$", 1).alias("did"), "content")
        return D.load_archive(read_sheets(raw), **self.options)


class Survey(Corpus):
    """Home: csv/dialect/<did>mb01dz.csv, csv/dialect/location.csv and csv/words.csv."""

    corpus_name = "zhongguoyuyan"

    def load_info(self) -> DataFrame:
        return D.survey_dialects(self.spark.read.csv(f"{self.home}/csv/dialect/location.csv", header=True))

    def load_characters(self) -> DataFrame:
        return survey_characters(self.spark.read.csv(f"{self.home}/csv/words.csv", header=True))

    def load_readings(self, dids: list[str] | None) -> DataFrame:
        raw = D.read_survey(self.spark, self.home)
        raw = raw if dids is None else raw.where(F.col("did").isin(dids))  # on the file's name, so other files aren't opened
        return D.load_survey(raw, **self.options)


CORPORA = {"MCPDict": Dictionary, "CCR": Archive, "zhongguoyuyan": Survey}


def default_catalog(spark: SparkSession, homes: dict[str, str], cache: str | None = None, simplify: Simplify = lambda c: c) -> D.Catalog:
    """A catalog of the corpora whose home folders are given, by name (aliases work too)."""
    catalog = D.Catalog(spark)
    for name, home in homes.items():
        key = D.Catalog.aliases.get(name, name)
        catalog.register(key, lambda s, k=key, h=home: CORPORA[k](s, h, cache and f"{cache}/{k}", simplify=simplify))
    return catalog


def parse_standards(text: DataFrame, columns: dict[str, str]) -> dict[str, DataFrame]:
    """A table for each list of a survey's standard ({name: [{...}]}); ``columns``: schema of each."""
    parsed = text.select(F.from_json("value", "struct<" + ",".join(f"`{n}`:array<struct<{c}>>" for n, c in columns.items()) + ">").alias("j"))
    return {n: parsed.select(F.explode(f"j.`{n}`").alias("r")).select("r.*") for n in columns}


def parse_survey_data(text: DataFrame, point: str = "latitude:string,longitude:string", location: str = "province:string,city:string,country:string,area:string,slice:string,slices:string,village:string") -> tuple[DataFrame, DataFrame]:
    """(locations, records) of site files (site, value): {mapLocation: {point, location}, resourceList: [{sounder, type, items: [{iid, name, oid, records: [{...}]}]}]}.

    A resource's oid is its first item's; resources without items have no records.
    """
    item = "struct<iid:string,name:string,oid:string,records:array<map<string,string>>>"
    j = F.from_json("value", f"struct<mapLocation:struct<point:struct<{point}>,location:struct<{location}>>,resourceList:array<struct<sounder:string,type:string,items:array<{item}>>>>")
    parsed = text.select("site", j.alias("j"))
    places = parsed.select("site", "j.mapLocation.point.*", "j.mapLocation.location.*")
    r = parsed.select("site", F.explode("j.resourceList").alias("r")).where("size(r.items) > 0")
    r = r.select("site", F.col("r.sounder").alias("sounder"), F.col("r.type").alias("type"), F.col("r.items")[0]["oid"].alias("oid"), F.explode("r.items").alias("i"))
    return places, r.select("site", "sounder", "type", "oid", "i.iid", "i.name", F.explode("i.records").alias("record"))
