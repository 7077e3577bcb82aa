import pytest
from pyspark.sql import functions as F

from isoglotta.functions import phonetics as P
from isoglotta.functions import regions as R


def values(spark, fn, xs):
    d = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string").select("i", fn(F.col("x")).alias("y")).orderBy("i")
    return [r["y"] for r in d.collect()]


def test_tables_have_their_sizes():
    assert [len(x) for x in (P.CONSONANTS, P.VOWELS, P.DIACRITICS, P.SUPRASEGMENTALS, P.TONES, P.CHAR_FROM, P.STRING_MAP)] == [106, 41, 119, 8, 19, 55, 12]
    assert len(set(P.ALPHABET)) == len(P.ALPHABET) and len(P.MANNERS) == 103
    assert set(P.CONSONANTS) - set(P.MANNERS) == set("ȡȵȶ")


def test_clean_ipa_maps_once(spark):
    assert values(spark, P.clean_ipa, [" G0 ", "ts·", None, ""]) == ["g∅", "ts∅", None, ""]
    assert values(spark, lambda c: P.clean_ipa(c, True), ["t#s%"]) == ["ts"]


MAPPED = {
    "zero and marks": ("0０·○\ufffb:：", "∅∅∅∅∅ːː"),
    "capitals with letters of their own": ("AEIY", "ᴀᴇɪʏ"),
    "other capitals": ("BCDFGHJKLMNOPQRSTUVWXZ", "bcdfghjklmnopqrstuvwxz"),
    "look-alike letters": ("gｋıƞƲǝεᴂɁØǾǿ", "ɡkiŋʋəɛæʔøøø"),
    "aspiration": ("ʻ‘", "ʰʰ"),
    "marks": ("~˜\u034a\u0307\u030d\u0323\u0311\u0331", "\u0303\u0303\u0303\u0329\u0329\u0329\u032f\u0320"),
}
MANNER_CASES = {
    "plosive": "bcdkpqtɖɟɡɢʈʔʡ", "nasal": "mnŋɱɲɳɴ", "trill": "rʀʙʜʢ", "flap": "ɽɾⱱⱳ", "lateral-flap": "ɺ", "approximant": "jwɥɰɹɻʋʍ", "lateral-approximant": "lȴɫɭʎʟ",
    "sibilant-fricative": "szɕɧʂʃʐʑʒ", "non-sibilant-fricative": "fhvxçðħɣɦɸʁʕʝΦβθχ", "lateral-fricative": "ɬɮꞎ", "sibilant-affricate": "ʣʤʥʦʧʨ", "lateral-affricate": "ƛλ",
    "implosive": "ƈƙƥƭɓɗɠʄʛʠᶑ", "click": "ǀǂǃʇʗʘʞ‼", "lateral-click": "ǁʖ",
}


def test_every_mapped_character(spark):
    pairs = [(a, b) for x, y in MAPPED.values() for a, b in zip(x, y, strict=True)]
    assert sorted(a for a, _ in pairs) == sorted(P.CHAR_MAP)
    assert values(spark, P.clean_ipa, ["t" + a + "s" for a, _ in pairs]) == ["t" + b + "s" for _, b in pairs]
    strings = {"ø\u0301": "ø", "ã": "a\u0303", "õ": "o\u0303", "ĕ": "e\u0306", "ĩ": "i\u0303", "ũ": "u\u0303", "ḷ": "l\u0329", "ṃ": "m\u0329", "ẽ": "e\u0303", "ỹ": "y\u0303", "ǫ": "o\u031c", "ṇ": "n\u0329"}
    assert values(spark, P.clean_ipa, list(strings)) == list(strings.values())


def test_every_manner(spark):
    want = {c: m for m, cs in MANNER_CASES.items() for c in cs}
    got = values(spark, P.char_features, list(want))
    assert [f[0]["own_manner"] for f in got] == list(want.values()) and set(want) == set(P.MANNERS)


def test_clean_elements(spark):
    assert values(spark, P.clean_initial, ["∅", "∅t", None]) == ["∅", "t", None]
    assert values(spark, P.clean_tone, ["∅", "21a", "0"]) == ["∅", "21", ""]


@pytest.mark.parametrize(
    ("syllable", "want"),
    [("tɕhiɒ45", ("tɕh", "iɒ", "45")), ("ŋ21", ("", "ŋ", "21")), ("a", ("", "a", "")), ("ma", ("m", "a", "")), ("mŋ55", ("m", "ŋ", "55")), ("uə213", ("", "uə", "213")), ("phŋ", ("ph", "ŋ", "")), ("t", ("", "t", "")), ("tsʰl̩", ("tsʰ", "l̩", "")), ("123", (None, None, None)), ("", (None, None, None))],
)
def test_parse_syllable(spark, syllable, want):
    assert tuple(values(spark, P.parse_syllable, [syllable])[0]) == want


def test_normalize_initial(spark):
    assert values(spark, P.normalize_initial, ["ph", "tɕh", "ʦh", "kw", "khw", "ʔh", "bɦ", "ⁿd"]) == ["pʰ", "tɕʰ", "tsʰ", "kʷ", "kʷʰ", "ʔh", "bʰ", "nd"]


def test_segment_tags(spark):
    d = spark.sql("SELECT array('t', 's', 'a', '5') AS c, array('B-I', 'E-I', 'S-F', 'O') AS t").select(P.segment_tags(F.col("c"), F.col("t")).alias("p"))
    assert tuple(d.first()["p"]) == ("ts", "a", None)


def test_char_features_mark_the_ends(spark):
    f = values(spark, P.char_features, ["ma"])[0]
    assert [r["before_char"] for r in f] == ["BOS", "m"] and [r["after_char"] for r in f] == ["a", "EOS"]
    assert f[0]["own_type"] == "consonant" and f[0]["own_manner"] == "nasal" and f[1]["own_manner"] is None


def test_day_of_year_repair(spark):
    assert values(spark, P.day_of_year_repair, ["1900年2月13日", "44.0", "5", None, "1900年13月45日"]) == ["44", "44", "5", None, None]


def test_classification_of_fixture_localities(spark):
    rows = [("06K06", "官话", "中原官话", "兖菏片", "菏泽市", "曹县", "山东"), ("06K10", "中原官话区", "兖菏片", "系属不明", "枣庄市", "薛城区", "山东")]
    d = spark.createDataFrame(rows, "did string, area string, slice string, slices string, city string, county string, province string")
    a, s, ss = F.col("area"), F.col("slice"), F.col("slices")
    group, sub = R.consistent(R.group_of(a, s), R.subgroup_of(a, s))
    got = d.select("did", group.alias("g"), sub.alias("s"), R.cluster_of(a, s, ss).alias("c"), R.subcluster_of(s, ss).alias("k"), R.spot_name(F.col("city"), F.col("county"), F.col("province")).alias("p")).orderBy("did").collect()
    assert [tuple(r)[1:] for r in got] == [("官话", "中原官话", "兖菏片", None, "菏泽曹县"), ("官话", "中原官话", "兖菏片", None, "枣庄薛城")]
