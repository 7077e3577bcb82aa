"""Datasets of readings: lazy tables of readings, localities and characters, and loaders of raw layouts."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoglotta.functions import phonetics as P
from isoglotta.functions import regions as R
from isoglotta.operators import aggregates
from isoglotta.operators.cells import conform, drop_empty, fill_first
from isoglotta.operators.encode import hash_uniform, sample_keys

# Column names and marks of the raw layouts.
READINGS = ("did", "cid", "character", "initial", "final", "tone", "tone_category", "note")
INFO = ("name", "province", "city", "county", "town", "village", "group", "subgroup", "cluster", "subcluster", "spot", "latitude", "longitude")
ARCHIVE_ALIASES = {"Order": "字號", "Char": "字", "ShengMu": "聲母", "YunMu": "韻母", "DiaoZhi": "調值", "DiaoLei": "調類", "Comment": "備註"}
ARCHIVE_NAMES = {"字號": "cid", "字": "character", "聲母": "initial", "韻母": "final", "調值": "tone", "調類": "tone_category", "備註": "note"}
ARCHIVE_FILES = {
    "官話": "ccr04_guanhua_data_xlsx.zip", "晉語": "ccr05_jinyu_data_xlsx.zip", "吳語": "ccr06_wuyu_data_xlsx.zip", "徽語": "ccr07_huiyu_data_xlsx.zip",
    "贛語": "ccr08_ganyu_data_xlsx.zip", "湘語": "ccr09_xiangyu_data_xlsx.zip", "閩語": "ccr10_minyu_data_xlsx.zip", "粵語": "ccr11_yueyu_data_xlsx.zip",
    "平話": "ccr12_pinghua_data_xlsx.zip", "客語": "ccr13_keyu_data_xlsx.zip", "其他土話": "ccr14_otherdialects_data_xlsx.zip",
}
NO_GLYPH = "□"
DICTIONARY_FIXES = ("\u008f\u0090", "ɿʅ")
DICTIONARY_NOT_MODERN = ("歷史音", "民族語", "域外方音", "戲劇")
DICTIONARY_KEPT_OLD = ("1935永明", "1935南昌", "1935醴陵", "1935長沙")
DICTIONARY_DROPPED = ("普通話", "鄕音字類", "淸末寧波", "淸末溫州", "訓詁諧音", "湘音檢字", "香港", "臺灣")
DICTIONARY_COPIED = "漢典"
SURVEY_SUFFIX = "mb01dz"
# End of the fixed values.


class Dataset:
    """A lazy table of readings; columns and DataFrame methods are reached through it."""

    def __init__(self, data: DataFrame | None = None, name: str | None = None, dialects: DataFrame | None = None, characters: DataFrame | None = None):
        self._data, self.name, self._dialects, self._characters = data, name, dialects, characters

    @property
    def data(self) -> DataFrame | None:
        return self._data

    @property
    def dialect_info(self) -> DataFrame | None:
        return self._dialects

    @property
    def dialects(self) -> DataFrame | None:
        return None if self.data is None else aggregates.dialects(self.data)

    @property
    def characters(self) -> DataFrame | None:
        if self._characters is not None:
            return self._characters
        return None if self.data is None else aggregates.characters(self.data)

    @property
    def character_of(self) -> DataFrame | None:
        return None if self.characters is None else aggregates.character_of(self.characters)

    def filter(self, dids: Iterable[str]) -> "Dataset":
        """Readings of these localities; unknown ones are ignored."""
        dids = list(dids)
        return Dataset(self.data if self.data is None else self.data.where(F.col("did").isin(dids) if dids else F.lit(False)), self.name, self._dialects, self._characters)

    def items(self, fn: Callable, schema: str) -> DataFrame | None:
        """A pandas function over each locality's readings."""
        return None if self.data is None else self.data.groupBy("did").applyInPandas(fn, schema)

    def iterrows(self):
        return iter(()) if self.data is None else self.data.toLocalIterator()

    def append(self, other: "Dataset") -> "Dataset":
        if self.data is None or other.data is None:
            return Dataset(self.data if other.data is None else other.data, self.name)
        return Dataset(self.data.unionByName(other.data, allowMissingColumns=True), self.name)

    __add__ = append

    def sample(self, n: int, seed: int = 0) -> "Dataset":
        return Dataset(None if self.data is None else sample_keys(self.data, "did", n, seed).drop("draw"), self.name, self._dialects, self._characters)

    def shuffle(self, seed: int = 0) -> "Dataset":
        """Localities in a random order, readings of each together."""
        return Dataset(None if self.data is None else self.data.orderBy(hash_uniform(F.col("did"), seed), "did"), self.name, self._dialects, self._characters)

    def __getitem__(self, key):
        return self.data[key]

    def __getattr__(self, key):
        if key.startswith("_") or self.data is None:
            raise AttributeError(key)
        return getattr(self.data, key)

    def __len__(self) -> int:
        return 0 if self.data is None else self.dialects.count()


class FileDataset(Dataset):
    """A folder of CSV files, one for each locality; the file's stem is the locality. Filters prune files."""

    def __init__(self, spark: SparkSession, path: str, dialects: str | None = None, characters: str | None = None, name: str | None = None, dids: list[str] | None = None):
        read = lambda p: None if p is None else spark.read.csv(p, header=True)
        super().__init__(None, name, read(dialects), read(characters))
        self.spark, self.path, self.dids = spark, path.rstrip("/"), dids

    @property
    def data(self) -> DataFrame:
        files = self.path if self.dids is None else [f"{self.path}/{d}.csv" for d in self.dids]
        raw = self.spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "[!.]*.csv").csv(files, header=True, enforceSchema=False, inferSchema=False)
        did = F.regexp_extract("_metadata.file_name", r"^(.*)\.[^.]*$", 1)
        rest = [c for c in raw.columns if c != "did"]
        return raw.select(did.alias("did"), *rest, F.monotonically_increasing_id().alias("seq"))

    def filter(self, dids: Iterable[str]) -> "FileDataset":
        """Files of these localities only; an unknown one is an error."""
        dids = list(dids)
        known = {r["did"] for r in FileDataset(self.spark, self.path, dids=self.dids).files().collect()}
        if lost := [d for d in dids if d not in known]:
            raise KeyError(lost)
        out = FileDataset(self.spark, self.path, name=self.name, dids=dids)
        out._dialects, out._characters = self._dialects, self._characters
        return out

    def files(self) -> DataFrame:
        """Localities by file name; no file is opened."""
        names = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "[!.]*.csv").load(self.path)
        out = names.select(F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("did"))
        return out if self.dids is None else out.where(F.col("did").isin(self.dids))


def cached(dataset: Dataset, spark: SparkSession, path: str) -> Dataset:
    """Read-through cache: readings are written once, partitioned by locality, so later filters read only their folders."""
    dataset.data.write.mode("ignore").partitionBy("did").parquet(path)
    return Dataset(spark.read.schema(dataset.data.schema).parquet(path), dataset.name, dataset.dialect_info, dataset.characters)


def clear_cache(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    spark.catalog.clearCache()


def options(data: DataFrame, superscript_tone: bool = False, na: str | None = None, empty: str | None = None, zero: str = P.EMPTY) -> DataFrame:
    """Load-time options, in this order: superscript tones, a string for null, a string for the zero sign."""
    if superscript_tone:
        data = data.withColumn("tone", P.tone_to_superscript(F.col("tone")))
    if na is not None:
        data = data.fillna(na, [c for c in ("initial", "final", "tone", "tone_category") if c in data.columns])
    if empty is not None:
        data = data.withColumns({c: F.when(F.col(c) == zero, F.lit(empty)).otherwise(F.col(c)) for c in ("initial", "final", "tone")})
    return data


def blank_to_null(data: DataFrame, columns: Iterable[str]) -> DataFrame:
    return data.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in columns})


def load_dictionary(raw: DataFrame, tones: DataFrame, **kw) -> DataFrame:
    """Readings of dictionary tables. ``raw``: did, 漢字, 音標, 解釋. ``tones``: did, number, value, category."""
    sound = F.translate("音標", *DICTIONARY_FIXES)
    d = raw.select("did", F.when(F.col("漢字") != NO_GLYPH, F.nullif("漢字", F.lit(""))).alias("character"), P.split_tone(sound).alias("s"), F.nullif("解釋", F.lit("")).alias("note"))
    d = d.select("did", "character", "note", P.parse_syllable(P.clean_ipa(F.col("s.segment"), force=True)).alias("p"), F.col("s.tone_number").alias("number")).join(tones, ["did", "number"], "left")
    d = d.select("did", "character", "p.initial", "p.final", P.keep_only(F.col("value"), P.TONES).alias("tone"), F.col("category").alias("tone_category"), "note")
    kw = {"empty": P.EMPTY} | kw
    return options(conform(drop_empty(d), READINGS), zero="", **kw)


def dictionary_tones(info: DataFrame) -> DataFrame:
    """(did, number, value, category) of JSON tone tables. ``info``: did, 聲調 ('{"1": [value, ..., ..., category]}')."""
    m = info.select("did", F.explode(F.from_json("聲調", "map<string,array<string>>")).alias("number", "v"))
    return m.select("did", "number", F.get("v", F.lit(0)).alias("value"), F.get("v", F.lit(3)).alias("category"))


def read_dictionary_info(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an object keyed by name, as rows with the key in ``key``; nested objects stay JSON strings."""
    text = spark.read.text(path, wholetext=True)
    entry = F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("key", "v")
    fields = ("文件格式", "地圖集二分區", "簡稱", "語言", "省", "市", "縣", "鎮", "村", "經緯度", "聲調")
    return text.select(entry).select("key", *(F.col("v")[f].alias(f) for f in fields))


def modern_entries(info: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Entries of present-day dialects; ``files`` (key): those that have a table."""
    old = F.rlike("key", F.lit("^1[0-9]{3}")) & ~F.col("key").isin(*DICTIONARY_KEPT_OLD)
    part = F.coalesce(F.col("地圖集二分區").isin(*DICTIONARY_NOT_MODERN), F.lit(False))
    out = info.where(~F.col("文件格式").eqNullSafe(DICTIONARY_COPIED) & ~part & ~old & ~F.col("key").isin(*DICTIONARY_DROPPED))
    return out if files is None else out.join(files, "key", "left_semi")


def dictionary_dialects(info: DataFrame, simplify: Callable = lambda c: c) -> DataFrame:
    """Locality table of dictionary entries. ``simplify``: a Column function to simplified characters."""
    a, c = R.split_area(F.col("地圖集二分區")), R.split_coordinates(F.col("經緯度"))
    own = {"name": F.col("語言"), "province": F.col("省"), "city": F.col("市"), "county": F.col("縣"), "town": F.col("鎮"), "village": F.col("村"), "spot": F.col("簡稱"), **a}
    return info.select(F.col("簡稱").alias("did"), *((own[k] if k == "name" else simplify(own[k])).alias(k) if k in own else c[k].alias(k) for k in INFO))


def load_archive(raw: DataFrame, **kw) -> DataFrame:
    """Readings of archive sheets (did, seq and the sheets' columns, by either set of names)."""
    d = raw.withColumnsRenamed({k: v for k, v in ARCHIVE_ALIASES.items() if k in raw.columns}).withColumnsRenamed(ARCHIVE_NAMES)
    d = d.withColumn("_k", F.concat_ws("\0", "did", "cid"))
    d = fill_first(d, "_k", ("initial", "final", "tone", "tone_category")).drop("_k")
    final = F.when(F.col("did") == "118", F.translate("final", "?", "ʏ")).otherwise(F.col("final"))
    initial = F.when(F.col("did") == "178", F.translate("initial", "ȷ", "ɕ")).otherwise(F.col("initial"))
    first = P.first_alternative
    d = d.withColumns({
        "initial": P.clean_initial(first(P.clean_ipa(initial))), "final": P.clean_final(first(P.clean_ipa(final))),
        "tone": P.clean_tone(first(F.translate("tone", "0", P.EMPTY))), "tone_category": P.clean_tone_category(F.col("tone_category")),
    })
    return options(conform(drop_empty(blank_to_null(d, ("initial", "final", "tone", "tone_category"))), READINGS), **kw)


def archive_sources(info: DataFrame, base: str, folder: str) -> DataFrame:
    """Add url and path of each locality's sheet. ``info``: 編號, 方言, 區, 方言點."""
    table = F.create_map(*(F.lit(x) for kv in ARCHIVE_FILES.items() for x in kv))
    kind = F.when(F.col("方言") != "官話", F.col("方言")).otherwise(F.col("區"))
    path = F.concat(F.lit(folder + "/"), "編號", F.lit(" "), kind, F.lit("_"), "方言點", F.lit(".xlsx"))
    return info.where(F.col("編號").isNotNull()).withColumn("url", F.concat(F.lit(base), F.try_element_at(table, F.col("方言")))).withColumn("path", path)


def archive_dialects(info: DataFrame, simplify: Callable = lambda c: c) -> DataFrame:
    """Locality table of archive entries (編號, 方言, 區, 片／小區, 小片, 方言點, 緯度, 經度)."""
    group = F.col("方言")
    for old, new in R.GROUP_NAMES_RAW.items():
        group = F.when(F.col("方言") == old, F.lit(new)).otherwise(group)
    own = {"group": simplify(group), "subgroup": simplify(R.clean_subgroup(F.col("區"))), "cluster": simplify(F.col("片／小區")), "subcluster": simplify(F.col("小片")), "spot": simplify(F.col("方言點"))}
    own |= {"name": F.regexp_replace("方言點", R.SOURCE_NOTES, ""), "latitude": F.col("緯度").cast("double"), "longitude": F.col("經度").cast("double")}
    return info.where(F.col("編號").isNotNull()).select(F.col("編號").alias("did"), *((own[k] if k in own else F.lit(None).cast("string")).alias(k) for k in INFO))


def load_survey(raw: DataFrame, **kw) -> DataFrame:
    """Readings of field-survey tables (did, iid, initial, finals, tone, memo, name)."""
    finals = F.when(F.col("did") == "02135", F.translate("finals", "", "̃̃")).otherwise(F.col("finals"))
    d = raw.select(
        "did", F.col("iid").alias("cid"), F.col("name").alias("character"),
        P.clean_initial(F.translate(P.clean_ipa(F.col("initial")), "¤ø", "ɲ∅")).alias("initial"),
        P.clean_final(F.translate(P.clean_ipa(finals), "", "ɤ")).alias("final"),
        P.clean_tone(P.day_of_year_repair(F.col("tone"))).alias("tone"), F.nullif("memo", F.lit("")).alias("note"),
    )
    return options(drop_empty(blank_to_null(d, ("initial", "final", "tone"))), **kw).select("did", "cid", "character", "initial", "final", "tone", "note")


def read_survey(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(f"{path}/csv/dialect/*{SURVEY_SUFFIX}.csv", header=True, inferSchema=False)
    return raw.withColumn("did", F.regexp_extract("_metadata.file_name", rf"^(.*){SURVEY_SUFFIX}\.csv$", 1))


def survey_dialects(location: DataFrame) -> DataFrame:
    """Locality table of the survey (did, province, city, country, village, area, slice, slices, latitude, longitude)."""
    c = {k: R.drop_none_marks(F.col(v)) for k, v in (("city", "city"), ("county", "country"), ("village", "village"))}
    d = location.withColumns({"_city": c["city"], "_county": c["county"], "_village": c["village"]})
    area, s, ss = F.col("area"), F.col("slice"), F.col("slices")
    group, subgroup = R.consistent(R.group_of(area, s), R.subgroup_of(area, s))
    spot = R.spot_name(F.col("_city"), F.col("_county"), F.col("province"))
    own = {"name": spot, "province": F.col("province"), "city": F.col("_city"), "county": F.col("_county"), "village": F.col("_village"), "group": group, "subgroup": subgroup, "cluster": R.cluster_of(area, s, ss), "subcluster": R.subcluster_of(s, ss), "spot": spot}
    own |= {"latitude": R.sane_latitude(F.col("latitude").cast("double")), "longitude": R.sane_longitude(F.col("longitude").cast("double"))}
    return d.select("did", *((own[k] if k in own else F.lit(None).cast("string")).alias(k) for k in INFO))


def parse_survey_sites(text: DataFrame) -> DataFrame:
    """(kind, province, site) of survey listings in JSON: {dialectObj, minorityObj: [{provinceCode, cityList: [{_id, ...}]}]}."""
    lists = "array<struct<provinceCode:string,cityList:array<map<string,string>>>>"
    j = F.from_json("value", f"struct<dialectObj:{lists},minorityObj:{lists}>")
    rows = text.select(j.alias("j"))
    out = None
    for kind in ("dialectObj", "minorityObj"):
        d = rows.select(F.lit(kind).alias("kind"), F.explode(f"j.{kind}").alias("p")).select("kind", F.col("p.provinceCode").alias("province"), F.explode("p.cityList").alias("city"))
        d = d.select("kind", "province", F.col("city")["_id"].alias("site"))
        out = d if out is None else out.unionByName(d)
    return out


def parse_survey_items(text: DataFrame) -> DataFrame:
    """(sounder, type, iid, name, oid, records) of survey resources in JSON: {resourceList: [{sounder, type, items: [...]}]}."""
    j = F.from_json("value", "struct<resourceList:array<struct<sounder:string,type:string,items:array<struct<iid:string,name:string,oid:string,records:array<string>>>>>>")
    r = text.select(F.explode(j["resourceList"]).alias("r")).select("r.sounder", "r.type", F.explode("r.items").alias("i"))
    return r.select("sounder", "type", "i.iid", "i.name", "i.oid", F.to_json("i.records").alias("records"))


class Catalog:
    """Datasets by name. ``register`` takes a function of the session; a folder path is a FileDataset."""

    aliases = {"ccr": "CCR", "xiaoxue": "CCR", "mcpdict": "MCPDict", "yubao": "zhongguoyuyan"}

    def __init__(self, spark: SparkSession):
        self.spark, self.makers = spark, {}

    def register(self, name: str, make: Callable[[SparkSession], Dataset]) -> None:
        self.makers[name] = make

    def get(self, name: str) -> Dataset | None:
        """The dataset of a name, alias, folder or CSV file; None (with a warning) if there is none."""
        key = self.aliases.get(name, name)
        if key in self.makers:
            return self.makers[key](self.spark)
        p = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if fs.exists(p):
            if fs.getFileStatus(p).isDirectory():
                return FileDataset(self.spark, name)
            return Dataset(self.spark.read.csv(name, header=True), name)
        import warnings

        warnings.warn(f"no dataset named {name}", stacklevel=2)
        return None


def write_csv(data: DataFrame, path: str, by: str | None = None) -> None:
    """CSV sink, one folder for each value of ``by`` if given."""
    w = data.write.mode("overwrite").option("header", True)
    (w.partitionBy(by) if by else w).csv(path)


def write_json_vocabulary(spark: SparkSession, processor, path: str) -> None:
    spark.createDataFrame([(processor.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)
