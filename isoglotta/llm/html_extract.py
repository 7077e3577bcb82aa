"""Main text of web pages: a suffix array over each host's pages, bounded by page structure.

A page is read as a stream of tags and text. Block elements bound blocks, character references are decoded,
white space inside a block becomes one space. Scripts, styles, forms and hidden parts are no text at all. Every other
block is

* body: in the page's marked article (``article``, else ``main`` or role=main) and not chrome;
* chrome: a menu, page header, footer or sidebar, or a part whose class or id names an advert, notice, cookie
  bar, comment list and so on; on a page with a marked article also whatever stands outside it;
* open: the rest, that is all other blocks of a page without a marked article, and parts of an article whose class only
  hints at chrome (``share-price``).

A page with several articles and more text outside them (teasers around a story) counts as unmarked.

The token streams of a host's chrome and open blocks are concatenated, with a separator between pages that occurs
once, and sorted into a suffix array (prefix doubling; longest common prefixes from the doubling's ranks). Each place's
longest substring that another page of the host has too follows from its neighbours in the array; substrings of at
least ``run`` tokens are boilerplate and all they cover is removed. Unique runs of open blocks stay and join the body
in page order; what the array leaves of chrome goes too, since the contract wants no menu or advert, repeated or
not. Body is kept whole: real articles of a host share passages (quotes, copies). ``protect=False`` is the array alone: every block is open.

Pages with equal html are one page here, so copies don't make their text boilerplate. Hosts with many or long pages are dealt
into shards. Each distinct run of ``run`` tokens of a shard is sent as a 64-bit fingerprint with the least and the
largest page that hold it; if these differ over all shards, two pages share the run, and it returns to the
shards that hold it. A substring of at least ``run`` tokens is a chain of such runs, so shards don't change the result.

Null or empty html, and pages without text, give an empty text; a null or odd url is the host "". Repeated rows, and
rows with a null id, are rows each. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, mix, read

#: Possessive, so a tag that doesn't end fails in one pass.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_TELLS = re.compile(r"class|id|role|hidden|style", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_MAIN = re.compile(r"role\s*=\s*[\"']?main\b", re.I)
#: Their content is text, not markup, up to their end tag.
RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "xmp")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul video audio xmp".split()
)
NO_TEXT = frozenset("form script style head noscript template iframe noembed noframes button select option textarea object svg canvas title dialog".split())
CHROME = frozenset("nav aside footer menu".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
#: Any part of a class or id.
CHROME_NAMES = frozenset("ad ads adv advert adverts advertisement sponsor sponsored promo sidebar menu nav navbar breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr newsletter popup modal comments disqus pagination pager".split())
#: The whole of a class or id; as a part of one they are a hint.
CHROME_HINTS = frozenset("banner promotion navigation notice notices subscribe subscription signup login share sharing social comment respond reply replies related recommended toolbar widget".split())
ENDED_BY_LIKE = frozenset(("li", "dd", "dt", "option", "tr", "td", "th"))
CHROME_ZONE, OPEN_ZONE, BODY_ZONE = 0, 1, 2


def _standing(tag: str, attrs: str, inside: bool) -> int:
    """0 text, 1 hint of chrome, 2 chrome, 3 no text; of an element."""
    if tag in NO_TEXT:
        return 3
    if tag in CHROME or tag == "header" and not inside:
        return 2
    if not attrs or tag in ("html", "body") or not _TELLS.search(attrs):
        return 0
    found = 0
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _UNSEEN.search(value):
            return 3
        if name == "role" and value in CHROME_ROLES:
            found = 2
        if name in ("class", "id"):
            for whole in value.split():
                parts = re.split(r"[^a-z0-9]+", whole)
                if whole in CHROME_HINTS or not CHROME_NAMES.isdisjoint(parts):
                    found = 2
                elif not CHROME_HINTS.isdisjoint(parts):
                    found = max(found, 1)
    return found


def parse(html: str | None) -> list[tuple[int, str]]:
    """(zone, text) of a page's blocks, in page order. Linear in the page's length."""
    html = html or ""
    size, last = len(html), html.rfind(">")
    blocks: list[tuple[int, int, str]] = []  # kind of the container (0, 1 main, 2 article), standing, text
    run: list[str] = []
    stack: list[tuple[str, int, int]] = []  # tag, standing, kind outside of it
    open_: dict[str, int] = {}
    standing, kind, articles, at, pattern = [0, 0, 0, 0], 0, 0, 0, _TAG

    def flush():
        if run:
            if text := " ".join("".join(run).split()):
                blocks.append((kind, 2 if standing[2] else 1 if standing[1] else 0, text))
            run.clear()

    def pop():
        nonlocal kind
        tag, bad, outside = stack[-1]
        if tag in BLOCK or bad:
            flush()
        stack.pop()
        open_[tag] -= 1
        standing[bad] -= 1
        kind = outside

    while at < size:
        i = html.find("<", at)
        end = size if i < 0 else i
        if end > at and not standing[3]:
            text = html[at:end]
            run.append(entities.unescape(text) if "&" in text else text)
        if i < 0:
            break
        if html.startswith("<!--", i):
            close = html.find("-->", i + 2)
            at = close + 3 if close >= 0 else size
            continue
        m = pattern.match(html, i) if i < last else None
        if not m:
            if i < last and html[i + 1 : i + 2] in ("!", "?"):
                at = html.find(">", i) + 1
                continue
            if i < last and pattern is _TAG and re.match(r"</?[a-zA-Z]", html[i : i + 3]):
                pattern = _LOOSE_TAG  # a quote never ends: from here on quotes don't hide a tag's end
                at = i
                continue
            if not standing[3]:
                run.append("<")
            at = i + 1
            continue
        at, tag, attrs = m.end(), m[2].lower(), m[3]
        if m[1]:
            if tag == "br" or tag == "p" and not open_.get("p"):
                flush()
            elif open_.get(tag):
                while True:
                    top = stack[-1][0]
                    pop()
                    if top == tag:
                        break
            continue
        if tag in BLOCK:
            flush()
            while tag != "br" and stack and stack[-1][0] == "p":
                pop()
        if tag in ENDED_BY_LIKE and stack and stack[-1][0] == tag:
            pop()
        if tag in VOID:
            continue
        if tag in RAW:
            close = RAW[tag].search(html, at)
            stop = close.start() if close else size
            flush()
            if tag == "xmp" and not standing[3]:
                run.append(html[at:stop])
                flush()
            at = html.find(">", stop) + 1 or size
            continue
        if attrs.rstrip().endswith("/") and tag not in BLOCK:
            continue
        bad = _standing(tag, attrs, kind > 0)
        if bad:
            flush()
        stack.append((tag, bad, kind))
        open_[tag] = open_.get(tag, 0) + 1
        standing[bad] += 1
        if tag == "article":
            articles += kind < 2
            kind = 2
        elif tag == "main" or attrs and _MAIN.search(attrs):
            kind = max(kind, 1)
    flush()
    weight = [0, 0, 0]
    for k, s, t in blocks:
        if s < 2:
            weight[k] += len(t)
    level = max((k for k in range(3) if weight[k]), default=0)
    if level == 2 and articles > 1 and weight[0] + weight[1] > weight[2]:
        level = 1 if weight[1] else 0
    return [(CHROME_ZONE if s == 2 or k < level else OPEN_ZONE if not level or s else BODY_ZONE, t) for k, s, t in blocks]


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the order of their suffixes, longest common prefix of each with the one before).

    Prefix doubling. The last token must occur nowhere else.
    """
    n = len(tokens)
    ranks = [np.unique(tokens, return_inverse=True)[1].astype(np.int64).reshape(-1)]
    while (k := 1 << (len(ranks) - 1)) < n and int(ranks[-1].max(initial=0)) < n - 1:
        after = np.full(n, -1, dtype=np.int64)
        after[:-k] = ranks[-1][k:]
        ranks.append(np.unique(ranks[-1] * (n + 1) + after + 1, return_inverse=True)[1].astype(np.int64).reshape(-1))
    order = np.empty(n, dtype=np.int64)
    order[ranks[-1]] = np.arange(n)
    common = np.zeros(n, dtype=np.int64)
    a, b = order[:-1], order[1:]
    for j in range(len(ranks) - 1, -1, -1):
        x, y = a + common[1:], b + common[1:]
        common[1:] += np.where((x < n) & (y < n) & (ranks[j][np.minimum(x, n - 1)] == ranks[j][np.minimum(y, n - 1)]), 1 << j, 0)
    return order, common


def shared_lengths(order: np.ndarray, common: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """By place, the length of the longest substring from there that a place of another owner starts too.

    That is the common prefix with the next suffix of another owner, before or after in the array: running
    minima over the stretch of suffixes of one owner in between.
    """
    n, own = len(order), owner[order]
    best = np.zeros(n, dtype=np.int64)
    if n < 2:
        return best
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    last = np.concatenate([first[1:], [n]]) - 1
    after = np.concatenate([common[1:], [0]])
    for at, step, edge in ((first, 1, common), (last, -1, after)):
        at, ends = at.copy(), (last if step > 0 else first)
        low = edge[at]
        while len(at):
            best[at] = np.maximum(best[at], low)
            going = at != ends
            at, ends, low = at[going] + step, ends[going], low[going]
            low = np.minimum(low, edge[at])
    out = np.empty(n, dtype=np.int64)
    out[order] = best
    return out


class Host:
    """The streams of a host's (or a shard's) pages, as (page, texts of its blocks), and their suffix array."""

    def __init__(self, pages: list[tuple[int, list[str]]], run: int = 8):
        words: dict[str, int] = {}
        number: dict[int, int] = {}
        ids, owner, self.spans = [], [], []
        for page, blocks in pages:
            p, own = number.setdefault(page, len(number)), []
            for b in blocks:
                w = [words.setdefault(x, len(words)) for x in b.split(" ")]
                own.append((len(ids), len(ids) + len(w)))
                ids += w
            self.spans.append(own)
            ids.append(-1 - len(self.spans))  # a separator that occurs once
            owner.append((p, len(ids)))
        self.run, self.words, self.pages = run, list(words), np.array(list(number), dtype=np.int64)
        self.tokens = np.array(ids, dtype=np.int64)
        self.owner = np.repeat([p for p, _ in owner], np.diff([0] + [e for _, e in owner])).astype(np.int64)
        self.order, self.common = suffix_array(self.tokens)
        self.shared = shared_lengths(self.order, self.common, self.owner)

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """(places, fingerprints) of the runs that lie within a page."""
        hashes = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in self.words] or [0], dtype=np.uint64)
        n = max(0, len(self.tokens) - self.run + 1)
        breaks = np.concatenate([[0], np.cumsum(self.tokens < 0)])
        at = np.flatnonzero(breaks[self.run : self.run + n] == breaks[:n])
        out = np.zeros(len(at), dtype=np.uint64)
        for j in range(self.run):
            out = mix(out + hashes[self.tokens[at + j]])
        return at, out.view(np.int64)

    def held(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fingerprint, least page, largest page) of each distinct run."""
        at, prints = self.runs()
        distinct, where = np.unique(prints, return_inverse=True)
        pages = self.pages[self.owner[at]] if len(at) else np.empty(0, dtype=np.int64)
        low, high = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min)
        np.minimum.at(low, where, pages)
        np.maximum.at(high, where, pages)
        return distinct, low, high

    def covered(self, elsewhere: np.ndarray | None = None) -> np.ndarray:
        """Which tokens shared substrings cover; ``elsewhere``: fingerprints of runs that other shards share."""
        here = np.arange(len(self.tokens))
        ends = np.where(self.shared >= self.run, here + self.shared, 0)
        if elsewhere is not None and len(elsewhere):
            at, prints = self.runs()
            at = at[np.isin(prints, elsewhere)]
            ends[at] = np.maximum(ends[at], at + self.run)
        return np.maximum.accumulate(ends) > here if len(ends) else ends.astype(bool)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard_pages: int = 256, shard_bytes: int = 4 << 20, broadcast_hosts: int = 10_000, run: int = 8, protect: bool = True) -> DataFrame:
    """Per row: id, url, text, n_chars, n_repeated (tokens outside the body that the array removed), n_chrome (tokens it left to the rules)."""
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType.simpleString()
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[^:]*://([^/?#]*)", 1))
    keyed = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    shards = F.ceil(F.greatest(F.count("*") / shard_pages, F.sum(F.coalesce(F.octet_length("html"), F.lit(0))) / shard_bytes)).cast("int")
    large = keyed.groupBy("host").agg(shards.alias("shards")).where("shards > 1")
    found = large.limit(broadcast_hosts + 1).collect()
    if len(found) <= broadcast_hosts:  # else a shuffled join, which adaptive execution splits at hot hosts
        large = F.broadcast(spark.createDataFrame(found, large.schema))
    # any deal of rows will do; the partition is in it so that a row with thousands of repeats is spread
    dealt = keyed.withColumn("part", F.spark_partition_id()).join(large, "host", "left").select("id", "url", "html", "host", F.pmod(F.xxhash64("id", "url", "part"), F.coalesce("shards", F.lit(1))).cast("int").alias("shard"), F.col("shards").isNotNull().alias("wide"))
    names = ["id", "url", "host", "shard", "page", "zones", "blocks"]

    def parse_all(d: DataFrame, whole: bool = True) -> DataFrame:
        """``whole``: with the body; else only what the array reads."""

        def run_on(batches):
            for b in batches:
                htmls = [x.as_py() or "" for x in b.column(2)]
                parsed = [parse(x) if protect else [(OPEN_ZONE, t) for _, t in parse(x)] for x in htmls]
                page = pa.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x in htmls], pa.int64())
                zones, texts = ([[x[k] for x in p if whole or x[0] != BODY_ZONE] for p in parsed] for k in (0, 1))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), b.column(4), page, pa.array(zones, pa.list_(pa.int8())), pa.array(texts, pa.list_(pa.string()))], names=names)

        return d.select("id", "url", "html", "host", "shard").mapInArrow(run_on, f"id {kind}, url string, host string, shard int, page bigint, zones array<tinyint>, blocks array<string>")

    def streams(table: pa.Table) -> tuple[list, list, Host]:
        zones, texts = table.column("zones").to_pylist(), table.column("blocks").to_pylist()
        outside = [[t for z, t in zip(zs, ts) if z != BODY_ZONE] for zs, ts in zip(zones, texts)]
        return zones, texts, Host(list(zip(table.column("page").to_pylist(), outside)), run)

    def clean(table: pa.Table, elsewhere: pa.Table | None = None) -> pa.Table:
        zones, texts, h = streams(table)
        covered = h.covered(None if elsewhere is None else elsewhere.column("run").to_numpy())
        out, repeated, chrome = [], [], []
        for zs, ts, spans in zip(zones, texts, h.spans):
            kept, gone, left, k = [], 0, 0, 0
            for z, t in zip(zs, ts):
                if z == BODY_ZONE:
                    kept.append(t)
                    continue
                s, e = spans[k]
                k += 1
                n = int(covered[s:e].sum())
                gone += n
                if z == CHROME_ZONE:
                    left += e - s - n
                elif n < e - s:
                    kept.append(t if not n else " ".join(w for w, c in zip(t.split(" "), covered[s:e]) if not c))
            out.append(" ".join(kept))
            repeated.append(gone)
            chrome.append(left)
        counts = {"n_chars": [len(t) for t in out], "n_repeated": repeated, "n_chrome": chrome}
        return pa.table({id_col: table.column("id"), "url": table.column("url"), "text": pa.array(out, pa.string())} | {k: pa.array(v, pa.int64()) for k, v in counts.items()})

    schema = f"`{id_col}` {kind}, url string, text string, n_chars bigint, n_repeated bigint, n_chrome bigint"
    parsed = parse_all(dealt)
    if not found:
        return parsed.groupBy("host", "shard").applyInArrow(lambda table: clean(table), schema)

    def hold(table: pa.Table) -> pa.Table:
        prints, low, high = streams(table)[2].held()
        n = len(prints)
        return pa.table({"host": pa.array([table.column("host")[0].as_py()] * n, pa.string()), "shard": pa.array([table.column("shard")[0].as_py()] * n, pa.int32()), "run": prints, "low": low, "high": high})

    held = Scratch(spark).table(parse_all(dealt.where("wide"), False).drop("id", "url").groupBy("host", "shard").applyInArrow(hold, "host string, shard int, run bigint, low bigint, high bigint"))
    shared = held.groupBy("host", "run").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("host", "run")
    elsewhere = held.select("host", "run", "shard").join(shared, ["host", "run"], "left_semi")
    return parsed.groupBy("host", "shard").cogroup(elsewhere.groupBy("host", "shard")).applyInArrow(lambda table, runs: clean(table, runs), schema)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
