"""Weighted URL vocabulary: an Aho-Corasick automaton counts strict and soft terms.

A term counts where it stands between characters that are not letters or digits. One strict term, or
``soft_limit`` distinct soft terms, reject the url. Explicit host/path rules go before the vocabulary;
a rule fits its host and every subdomain if the url's path starts with the rule's path, and the longest
fitting rule wins (of equal length, the one with the longer host).

A null or empty url, or one without "://", has an empty host and path; terms are still looked for in
what text there is. Repeated rows are judged alike. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import LOWER, read

STRICT = ("porn", "xxx", "casino", "viagra", "escort", "spam", "adult", "gambling", "warez", "malware", "phishing")
SOFT = ("free", "cheap", "bet", "bets", "pill", "pills", "win", "ads", "track", "farm", "loan", "loans", "bonus", "poker", "slots", "click", "popup", "crack", "deal", "deals", "dating")
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def lower(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty without "://"."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return lower(rest[:end]), tail[:stop]


def build(strict: Iterable[str], soft: Iterable[str]):
    a = ahocorasick.Automaton()
    for kind, terms in ((1, soft), (0, strict)):
        for t in terms:
            a.add_word(lower(t), (kind, lower(t)))
    if len(a):
        a.make_automaton()
    return a


def count_terms(automaton, url: str | None) -> tuple[int, int]:
    """Distinct strict and soft terms with boundaries on both sides."""
    if not url or not len(automaton):
        return 0, 0
    s, found = lower(url), (set(), set())
    for end, (kind, term) in automaton.iter(s):
        start = end - len(term) + 1
        if (start == 0 or not s[start - 1].isalnum()) and (end + 1 == len(s) or not s[end + 1].isalnum()):
            found[kind].add(term)
    return len(found[0]), len(found[1])


def find_rule(rules: dict[str, list[tuple[str, str]]], host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits."""
    best, labels = None, host.split(".") if host else []
    for i in range(len(labels)):
        h = ".".join(labels[i:])
        for p, verdict in rules.get(h, ()):
            if path.startswith(p) and (best is None or (len(h) + len(p), len(h)) > best[0]):
                best = ((len(h) + len(p), len(h)), h + p, verdict)
    return best and best[1:]


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", strict=STRICT, soft=SOFT, soft_limit: int = 2, rules=RULES) -> DataFrame:
    """Judge every url: id, host, path, rule, verdict, strict_hits, soft_hits. No shuffle."""
    strict, soft, table = tuple(strict), tuple(soft), {}
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        table.setdefault(lower(host), []).append((slash + path, verdict))

    def judge(batches):
        automaton = build(strict, soft)
        for b in batches:
            rows = []
            for u in b.column(1).to_pylist():
                host, path = split_url(u)
                s, f = count_terms(automaton, u)
                rule, verdict = find_rule(table, host, path) or (None, "block" if s or f >= soft_limit else "allow")
                rows.append((host, path, rule, verdict, s, f))
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = (pa.string(),) * 4 + (pa.int64(),) * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), t) for c, t in zip(cols, kinds))], names=[id_col, "host", "path", "rule", "verdict", "strict_hits", "soft_hits"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url_col).mapInArrow(judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, strict_hits bigint, soft_hits bigint")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(read(spark, sf_dir, "pages"))


def _term_sql(term: str) -> str:
    return f"CAST(regexp_matches(u, '(^|[^a-z0-9]){term}([^a-z0-9]|$)') AS INTEGER)"


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
#: ASCII urls only: DuckDB's classes see no other letters as parts of a word.
ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id, translate(coalesce(url, ''), {_AZ}) AS u,
    CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), {_AZ}) AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM p
), r AS (
  SELECT *, {" + ".join(map(_term_sql, STRICT))} AS strict_hits, {" + ".join(map(_term_sql, SOFT))} AS soft_hits,
    regexp_matches(host, '(^|\\.)org$') AS org, regexp_matches(host, '(^|\\.)com$') AS com, regexp_matches(host, '(^|\\.)example\\.org$') AS ex FROM q
), s AS (
  SELECT *, CASE WHEN ex AND starts_with(path, '/en/1') THEN 'example.org/en/1' WHEN ex AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN com AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN com AND starts_with(path, '/de/') THEN 'com/de/' WHEN org AND starts_with(path, '/') THEN 'org/' END AS rule FROM r
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN strict_hits > 0 OR soft_hits >= 2 THEN 'block' ELSE 'allow' END AS verdict,
  CAST(strict_hits AS BIGINT) AS strict_hits, CAST(soft_hits AS BIGINT) AS soft_hits
FROM s
"""
