"""Phonetic alphabet tables and string functions on columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on exactly these characters and rewrites.
CONSONANTS = (
    "bcdfhjklmnpqrstvwxzçðħŋƈƙƛƥƭǀǁǂǃȡȴȵȶɓɕɖɗɟɠɡɢɣɥɦɧɫɬɭɮɰɱɲɳɴɸɹɺɻɽɾʀʁʂʃʄʇʈʋʍʎʐʑʒʔʕʖʗʘʙʛʜʝʞʟʠʡʢʣʤʥʦʧʨΦβθλχᶑ‼ⱱⱳꞎ"
)
VOWELS = (
    "aeiouyæøüœɐɑɒɔɘəɚɛɜɝɞɤɨɪɯɵɶɷɿʅʉʊʌʏʮʯωᴀᴇᵻᵿ"
)
DIACRITICS = (
    "ʰʱʲʳʴʵʶʷʼˀ˔˕˚˞ˠˡˣˤ˺\u0300\u0301\u0302\u0303\u0304\u0308\u030a\u030b\u030c\u030f\u0318\u0319\u031a\u031c\u031d\u031e\u031f\u0320\u0322\u0324\u0325"
    "\u0329\u032a\u032b\u032c\u032e\u032f\u0330\u0333\u0334\u0335\u0339\u033a\u033b\u033c\u033d\u0347\u035c\u0361ᵃᵄᵅᵇᵈᵉᵊᵋᵏᵐᵑᵒᵓᵖᵗᵘᵚᵛᵝᵡᶛᶜᶝᶞᶟᶠᶡᶢᶣᶤᶦᶨᶩ"
    "ᶬᶭᶮᶯᶰᶲᶳᶴᶶᶷᶹᶺᶻᶼᶽᶾᶿ\u1dc4\u1dc5\u1dc6\u1dc7\u1dc8\u1dc9\u2009’ⁱⁿ↓"
)
SUPRASEGMENTALS = (
    ".|ˈˌːˑ\u0306‿"
)
TONES = (
    "12345²³¹⁴⁵˥˦˧˨˩↗↘ꜛꜜ"
)
# non-standard character: standard character
CHAR_MAP = {
    "0": "∅", ":": "ː", "A": "ᴀ", "B": "b", "C": "c", "D": "d", "E": "ᴇ", "F": "f",
    "G": "g", "H": "h", "I": "ɪ", "J": "j", "K": "k", "L": "l", "M": "m", "N": "n",
    "O": "o", "P": "p", "Q": "q", "R": "r", "S": "s", "T": "t", "U": "u", "V": "v",
    "W": "w", "X": "x", "Y": "ʏ", "Z": "z", "g": "ɡ", "~": "\u0303", "·": "∅", "Ø": "ø",
    "ı": "i", "ƞ": "ŋ", "Ʋ": "ʋ", "ǝ": "ə", "Ǿ": "ø", "ǿ": "ø", "Ɂ": "ʔ", "ʻ": "ʰ",
    "˜": "\u0303", "\u0307": "\u0329", "\u030d": "\u0329", "\u0311": "\u032f", "\u0323": "\u0329", "\u0331": "\u0320", "\u034a": "\u0303", "ε": "ɛ",
    "ᴂ": "æ", "‘": "ʰ", "○": "∅", "０": "∅", "：": "ː", "ｋ": "k", "\ufffb": "∅",
}
# precomposed or variant string, standard string; replaced in this order after CHAR_MAP
STRING_MAP = (
    ("ø\u0301", "ø"),
    ("ã", "a\u0303"),
    ("õ", "o\u0303"),
    ("ĕ", "e\u0306"),
    ("ĩ", "i\u0303"),
    ("ũ", "u\u0303"),
    ("ḷ", "l\u0329"),
    ("ṃ", "m\u0329"),
    ("ẽ", "e\u0303"),
    ("ỹ", "y\u0303"),
    ("ǫ", "o\u031c"),
    ("ṇ", "n\u0329"),
)
# consonant: manner of articulation
MANNERS = {
    "b": "plosive", "c": "plosive", "d": "plosive", "f": "non-sibilant-fricative",
    "h": "non-sibilant-fricative", "j": "approximant", "k": "plosive", "l": "lateral-approximant",
    "m": "nasal", "n": "nasal", "p": "plosive", "q": "plosive",
    "r": "trill", "s": "sibilant-fricative", "t": "plosive", "v": "non-sibilant-fricative",
    "w": "approximant", "x": "non-sibilant-fricative", "z": "sibilant-fricative", "ç": "non-sibilant-fricative",
    "ð": "non-sibilant-fricative", "ħ": "non-sibilant-fricative", "ŋ": "nasal", "ƈ": "implosive",
    "ƙ": "implosive", "ƛ": "lateral-affricate", "ƥ": "implosive", "ƭ": "implosive",
    "ǀ": "click", "ǁ": "lateral-click", "ǂ": "click", "ǃ": "click",
    "ȴ": "lateral-approximant", "ɓ": "implosive", "ɕ": "sibilant-fricative", "ɖ": "plosive",
    "ɗ": "implosive", "ɟ": "plosive", "ɠ": "implosive", "ɡ": "plosive",
    "ɢ": "plosive", "ɣ": "non-sibilant-fricative", "ɥ": "approximant", "ɦ": "non-sibilant-fricative",
    "ɧ": "sibilant-fricative", "ɫ": "lateral-approximant", "ɬ": "lateral-fricative", "ɭ": "lateral-approximant",
    "ɮ": "lateral-fricative", "ɰ": "approximant", "ɱ": "nasal", "ɲ": "nasal",
    "ɳ": "nasal", "ɴ": "nasal", "ɸ": "non-sibilant-fricative", "ɹ": "approximant",
    "ɺ": "lateral-flap", "ɻ": "approximant", "ɽ": "flap", "ɾ": "flap",
    "ʀ": "trill", "ʁ": "non-sibilant-fricative", "ʂ": "sibilant-fricative", "ʃ": "sibilant-fricative",
    "ʄ": "implosive", "ʇ": "click", "ʈ": "plosive", "ʋ": "approximant",
    "ʍ": "approximant", "ʎ": "lateral-approximant", "ʐ": "sibilant-fricative", "ʑ": "sibilant-fricative",
    "ʒ": "sibilant-fricative", "ʔ": "plosive", "ʕ": "non-sibilant-fricative", "ʖ": "lateral-click",
    "ʗ": "click", "ʘ": "click", "ʙ": "trill", "ʛ": "implosive",
    "ʜ": "trill", "ʝ": "non-sibilant-fricative", "ʞ": "click", "ʟ": "lateral-approximant",
    "ʠ": "implosive", "ʡ": "plosive", "ʢ": "trill", "ʣ": "sibilant-affricate",
    "ʤ": "sibilant-affricate", "ʥ": "sibilant-affricate", "ʦ": "sibilant-affricate", "ʧ": "sibilant-affricate",
    "ʨ": "sibilant-affricate", "Φ": "non-sibilant-fricative", "β": "non-sibilant-fricative", "θ": "non-sibilant-fricative",
    "λ": "lateral-affricate", "χ": "non-sibilant-fricative", "ᶑ": "implosive", "‼": "click",
    "ⱱ": "flap", "ⱳ": "flap", "ꞎ": "lateral-fricative",
}
INITIAL_VARIANTS = ("ᵐᵑᵛⁿ", "mŋᶹn")
LIGATURES = (("ʣ", "dz"), ("ʤ", "dʒ"), ("ʥ", "dʑ"), ("ʦ", "ts"), ("ʧ", "tʃ"), ("ʨ", "tɕ"))
INITIAL_REWRITES = (
    ("([kɡŋhɦ].?)w", "$1ʷ"),
    ("([kɡŋhɦ].?)[vʋ]", "$1ᶹ"),
    ("([^ʔ∅])h", "$1ʰ"),
    ("([^ʔ∅])ɦ", "$1ʱ"),
    ("([bdɡvzʐʑʒɾ])ʱ", "$1ʰ"),
    ("([ʰʱ])([ʷᶹ])", "$2$1"),
)
PLAIN_DIGITS, SUPERSCRIPT_DIGITS = "12345", "¹²³⁴⁵"
TONE_CATEGORY = "上中下變陰陽平去入輕聲"
EMPTY = "∅"
# End of the fixed values.

LETTERS = CONSONANTS + VOWELS
ALPHABET = LETTERS + DIACRITICS + SUPRASEGMENTALS + TONES
CHAR_FROM, CHAR_TO = "".join(CHAR_MAP), "".join(CHAR_MAP.values())
TYPE_OF = {c: t for s, t in ((CONSONANTS, "consonant"), (VOWELS, "vowel"), (DIACRITICS, "diacritic"), (SUPRASEGMENTALS, "suprasegmental"), (TONES, "tone")) for c in s}


def char_class(chars: str, negate: bool = False) -> str:
    """A regular-expression class of literal characters."""
    return "[" + "^" * negate + "".join("\\" + c if c in "\\]^-[&|.~" else c for c in chars) + "]"


_D, _C, _L = char_class(DIACRITICS), char_class(CONSONANTS), char_class(LETTERS)
#: Initial, final, tone of a syllable.
SYLLABLE = f"({_D}*{_C}{char_class(CONSONANTS + DIACRITICS)}*|)({_D}*{_L}{char_class(LETTERS + DIACRITICS + SUPRASEGMENTALS)}*)({char_class(TONES)}*)"
SYLLABLE_TONE = "([^0-9]*)([0-9][0-9a-z]*)?"


def strip(x: Column) -> Column:
    """Trim all Unicode white space."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def tokens(x: Column) -> Column:
    """White-space separated tokens, none of them empty."""
    return F.filter(F.split(x, r"(?U)\s+"), lambda t: t != "")


def keep_only(x: Column, chars: str) -> Column:
    return F.regexp_replace(x, char_class(chars, negate=True), "")


def clean_ipa(x: Column, force: bool = False) -> Column:
    """Standard phonetic characters; ``force`` deletes all others."""
    x = F.translate(strip(x), CHAR_FROM, CHAR_TO)
    for old, new in STRING_MAP:
        x = F.replace(x, F.lit(old), F.lit(new))
    return keep_only(x, ALPHABET) if force else x


def _unless_empty(x: Column, chars: str) -> Column:
    return F.when(x == EMPTY, x).otherwise(keep_only(x, chars))


def clean_initial(x: Column) -> Column:
    return _unless_empty(x, CONSONANTS + DIACRITICS)


def clean_final(x: Column) -> Column:
    return keep_only(x, LETTERS + DIACRITICS + SUPRASEGMENTALS)


def clean_tone(x: Column) -> Column:
    return _unless_empty(x, TONES)


def normalize_initial(x: Column) -> Column:
    """One spelling for aspiration, labialisation and affricates."""
    x = F.translate(x, *INITIAL_VARIANTS)
    for old, new in LIGATURES:
        x = F.replace(x, F.lit(old), F.lit(new))
    for pattern, new in INITIAL_REWRITES:
        x = F.regexp_replace(x, pattern, new)
    return x


def tone_to_superscript(x: Column) -> Column:
    return F.translate(x, PLAIN_DIGITS, SUPERSCRIPT_DIGITS)


def tone_to_plain(x: Column) -> Column:
    return F.translate(x, SUPERSCRIPT_DIGITS, PLAIN_DIGITS)


def groups(x: Column, pattern: str, names: tuple[str, ...]) -> Column:
    """A struct of a pattern's groups; all null where it isn't found. A group that takes no part is ''."""
    found = F.rlike(x, F.lit(pattern))
    return F.struct(*(F.when(found, F.regexp_extract(x, pattern, i)).alias(n) for i, n in enumerate(names, 1)))


def parse_syllable(x: Column, pattern: str = SYLLABLE) -> Column:
    """struct(initial, final, tone)."""
    return groups(x, pattern, ("initial", "final", "tone"))


def split_tone(x: Column) -> Column:
    """struct(segment, tone_number); no number: null."""
    g = groups(x, SYLLABLE_TONE, ("segment", "number"))
    return F.struct(g["segment"].alias("segment"), F.nullif(g["number"], F.lit("")).alias("tone_number"))


def first_alternative(x: Column) -> Column:
    return F.split_part(x, F.lit("."), F.lit(1))


def clean_tone_category(x: Column) -> Column:
    return keep_only(first_alternative(x), TONE_CATEGORY)


def _at(chars: str, values: list[str], c: Column) -> Column:
    """The value at a character's place in ``chars``; null for others. One search in a constant, no map."""
    return F.get(F.array(*map(F.lit, values)), F.nullif(F.instr(F.lit(chars), c), F.lit(0)) - 1)


def char_features(x: Column) -> Column:
    """Per character: char, type and manner of it and its two neighbours, BOS and EOS beyond the ends."""

    def at(chars: Column, i: Column, p: int, tag: str) -> list[Column]:
        k, n = i + p, F.size(chars)
        c = F.when(k < 0, F.lit("BOS")).when(k >= n, F.lit("EOS")).otherwise(F.get(chars, k))
        real = (k >= 0) & (k < n)
        kind = F.when(real, F.coalesce(_at("".join(TYPE_OF), list(TYPE_OF.values()), c), F.lit("other")))
        return [c.alias(f"{tag}_char"), kind.alias(f"{tag}_type"), F.when(real, _at("".join(MANNERS), list(MANNERS.values()), c)).alias(f"{tag}_manner")]

    each = lambda chars: F.transform(chars, lambda c, i: F.struct(i.alias("pos"), *at(chars, i, -1, "before"), *at(chars, i, 0, "own"), *at(chars, i, 1, "after")))
    # the split is bound once: as a plain expression it would be made again for every character
    return F.get(F.transform(F.array(F.filter(F.split(x, ""), lambda c: c != "")), each), F.lit(0))


def segment_tags(chars: Column, tags: Column) -> Column:
    """struct(initial, final, tone) of characters tagged B-, I-, E-, S- with I, F or T, or O."""

    def element(name: str) -> Column:
        def step(acc, z):
            pos, kind = F.split_part(z["t"], F.lit("-"), F.lit(1)), F.split_part(z["t"], F.lit("-"), F.lit(2))
            return F.when((kind == name) & pos.isin("B", "S"), z["c"]).when((kind == name) & pos.isin("I", "E"), F.concat(F.coalesce(acc, F.lit("")), z["c"])).otherwise(acc)

        return F.aggregate(F.arrays_zip(chars.alias("c"), tags.alias("t")), F.lit(None).cast("string"), step)

    return F.struct(element("I").alias("initial"), element("F").alias("final"), element("T").alias("tone"))


def pronunciation(*parts: Column) -> Column:
    """Parts joined without a separator; null and the zero sign count as ''."""
    return F.concat(*(F.coalesce(F.nullif(p, F.lit(EMPTY)), F.lit("")) for p in parts))


def day_of_year_repair(x: Column) -> Column:
    """A tone that was turned into a date (y年m月d日) is its day of the year; '.0' at the end goes."""
    day = F.dayofyear(F.try_to_timestamp(x, F.lit("y年M月d日")))
    return F.regexp_replace(F.when(F.rlike(x, F.lit(r"^\d+年\d+月\d+日$")), day.cast("string")).otherwise(x), r"\.0$", "")


def convert_script(x: Column, chars: dict[str, str], phrases: dict[str, str] | None = None) -> Column:
    """Script conversion by dictionaries that the caller brings: phrases first (the longest one at each place), then single characters.

    Without phrases it is one translation in the JVM; with them one pattern finds all phrases and each match is looked up.
    """
    single = {k: v for k, v in chars.items() if len(k) == 1 and len(v) == 1}
    one = F.translate(x, "".join(single), "".join(single.values())) if single else x
    if not phrases:
        return one
    pattern = re.compile("|".join(re.escape(p) for p in sorted(phrases, key=lambda p: (-len(p), p))) + "|.", re.S)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        swap = lambda m: phrases.get(m[0]) or chars.get(m[0], m[0])
        return texts.map(lambda t: None if t is None else pattern.sub(swap, t))

    return run(x)
