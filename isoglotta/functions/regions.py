"""Classification and place-name cleaning of localities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .phonetics import strip

# Names and patterns that decide the classification.
MANDARIN = "北京|东北|冀鲁|胶辽|中原|兰银|江淮|西南"
MIN = "闽东|闽南|闽北|闽中|莆仙|邵将|琼文"
MANDARIN_RAW = "北京|東北|冀鲁|胶遼|中原|蘭銀|江淮|西南"
MIN_RAW = "閩東|閩南|閩北|閩中|莆仙|邵將|瓊文"
SUBGROUP_RULES_RAW = (
    (MANDARIN_RAW, f".*({MANDARIN_RAW}).*", "$1官話"),
    (MIN_RAW, f".*({MIN_RAW}).*", "$1區"),
    ("^桂南|桂北", "^(桂南|桂北).*", "$1平話"),
    ("湘南|粵北", ".*(湘南|粵北).*", "$1土話"),
)
GROUP_RULES = (("客", "(?s)^.*$", "客家话"), ("[官平土]", ".*([官平土]).*", "$1话"), ("[吴闽赣粤湘晋徽]", ".*([吴闽赣粤湘晋徽]).*", "$1语"))
SUBGROUP_RULES = (
    (MANDARIN, f".*({MANDARIN}).*", "$1官话"),
    (MIN, f".*({MIN}).*", "$1区"),
    ("雷琼|琼雷", "(?s)^.*$", "琼文区"),
    ("桂南|桂北", ".*(桂南|桂北).*", "$1平话"),
    ("湘南|粤北", ".*(湘南|粤北).*", "$1土话"),
    ("韶州|邵州", "(?s)^.*$", "粤北土话"),
)
CLUSTER = ("^.+[^小]片.*$", "^(?:.*[语话]区?)?([^语话片]*[^小片]片).*$")
SUBCLUSTER = ("^.+小片.*$", "^(?:.*[语话]区?)?(?:[^语话片]*[^小片]片)?([^语话片]+小片).*$")
UNCLEAR = "[不未]明|[语话片]$"
PLACE_REWRITES = (
    ("(.)（.*）$", "$1"),
    ("[（）]", ""),
    ("(?:(?:土家|布依|蒙古|朝鲜|哈尼|.)族|蒙古|哈萨克|苗蔟|少数民族)*自治[州县]+$", ""),
    ("新疆生产建设兵团.+师", ""),
    ("^(?:.*市区.*|市[内辖].+区)$", "市区"),
    ("^(.{2,})(?:地|新|特|林|综合实验)区$", "$1"),
    ("(.)县城$", "$1"),
    ("^(.{2,6})[市州盟县区旗]$", "$1"),
)
NONE_MARKS = ("(无)", "(无）", "无", "（无)", "（无）")
GROUP_NAMES_RAW = {"客語": "客家話", "其他土話": "土話"}
SOURCE_NOTES = r"\(安徽省志\)|\(珠江三角洲\)|\(客贛方言調查報告\)|\(廣西漢語方言\)|\(平話音韻研究\)|\(廣東閩方言\)|\(漢語方音字匯\)|\(當代吳語\)"
# End of the fixed values.


def first_rule(x: Column, rules) -> Column:
    """The rewrite of the first rule whose pattern is found; null if none is."""
    out = F.lit(None).cast("string")
    for found, pattern, new in reversed(rules):
        out = F.when(F.rlike(x, F.lit(found)), F.regexp_replace(x, pattern, new)).otherwise(out)
    return F.nullif(out, F.lit(""))


def clean_subgroup(x: Column) -> Column:
    return first_rule(x, SUBGROUP_RULES_RAW)


def clean_place(x: Column) -> Column:
    x = strip(x)
    for pattern, new in PLACE_REWRITES:
        x = F.regexp_replace(x, pattern, new)
    return x


def group_of(area: Column, slice_: Column) -> Column:
    g = F.coalesce(first_rule(area, GROUP_RULES), first_rule(slice_, GROUP_RULES))
    return F.when((g == "土话") & F.coalesce(F.rlike(slice_, F.lit("桂南|桂北")), F.lit(False)), F.lit("平话")).otherwise(g)


def subgroup_of(area: Column, slice_: Column) -> Column:
    return F.coalesce(first_rule(slice_, SUBGROUP_RULES), first_rule(area, SUBGROUP_RULES))


def _part(x: Column, rule: tuple[str, str]) -> Column:
    return F.when(F.rlike(x, F.lit(rule[0])), F.regexp_replace(x, rule[1], "$1"))


def _clear(x: Column) -> Column:
    return F.when(~F.rlike(x, F.lit(UNCLEAR)), x)


def cluster_of(area: Column, slice_: Column, slices: Column) -> Column:
    plain = F.when(F.length(slice_) == 2, F.concat(slice_, F.lit("片"))).otherwise(slice_)
    return F.coalesce(_part(slice_, CLUSTER), _part(slices, CLUSTER), _part(area, CLUSTER), F.when(_clear(slice_).isNotNull(), plain))


def subcluster_of(slice_: Column, slices: Column) -> Column:
    return F.coalesce(_part(slices, SUBCLUSTER), _part(slice_, SUBCLUSTER), _clear(slices))


def consistent(group: Column, subgroup: Column) -> tuple[Column, Column]:
    """Both null where a Mandarin group has a subgroup of another kind."""
    odd = (group == "官话") & ~F.coalesce(F.endswith(subgroup, F.lit("官话")), F.lit(False))
    odd = F.coalesce(odd, F.lit(False))
    return F.when(~odd, group), F.when(~odd, subgroup)


def drop_none_marks(x: Column) -> Column:
    return F.when(~x.isin(*NONE_MARKS), x)


def spot_name(city: Column, county: Column, province: Column) -> Column:
    """City and county names without their suffixes, once if equal; else the province."""
    a, b = clean_place(city), clean_place(county)
    joined = F.when(a == b, a).otherwise(F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
    return F.when(joined != "", joined).otherwise(province)


def sane_latitude(x: Column) -> Column:
    return F.when(x.between(0, 55), x)


def sane_longitude(x: Column) -> Column:
    return F.when(x.between(70, 140), x)


def split_area(x: Column) -> dict[str, Column]:
    """group, subgroup, cluster, subcluster of a 'group-cluster-subcluster' label."""
    part = F.split(x, "-")
    cluster = F.get(part, F.lit(1))
    head = F.when(F.get(part, F.lit(0)) == "鄕話", F.lit("鄉話")).otherwise(F.get(part, F.lit(0)))
    mandarin = F.endswith(head, F.lit("官話")) | F.endswith(head, F.lit("官话"))
    local = F.when(F.coalesce(cluster.isin("桂南片", "桂北片"), F.lit(False)), F.lit("平話")).otherwise(F.lit("土話"))
    group = F.when(mandarin, F.lit("官話")).when(head == "平話和土話", local).otherwise(head)
    return {"group": group, "subgroup": F.when(mandarin, head), "cluster": cluster, "subcluster": F.get(part, F.lit(2))}


def split_coordinates(x: Column) -> dict[str, Column]:
    """latitude and longitude of 'longitude,latitude'."""
    return {"latitude": F.split_part(x, F.lit(","), F.lit(2)).try_cast("double"), "longitude": F.split_part(x, F.lit(","), F.lit(1)).try_cast("double")}
