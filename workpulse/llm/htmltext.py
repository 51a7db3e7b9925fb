"""Main text of web pages: a suffix array of each host's pages finds what pages share, markup hints at the rest.

1. A map reads a page's blocks: all text between block-level tags but scripts, styles and the like, each with where it
   stands (in an article, in the main element, elsewhere) and whether a tag or class hints that it isn't the article's
   (menu, header, footer, sidebar, notice, advert, form, comments).
2. Pages of a host, all blocks of them, are concatenated as a token stream and its suffixes sorted. Neighbours with a
   common prefix of ``LEAST`` tokens or more are occurrences of one run; a run that occurs in several pages of different
   content is boilerplate. Copies of a page are not: pages with the same blocks count once.
3. What such runs cover is removed and unique runs are kept. Articles quote each other, so inside an article or main
   element only blocks that runs on a large share of the host's pages cover from end to end go.
4. What repetition can't know, since it is on one page only, goes by markup: hinted blocks such as reader comments, and
   blocks outside the article where there is one.

A host with many pages is split into groups by a hash of their content, each with a stream of its own. The limits are
for the whole host: a run on so many of its pages is on several pages of some group, so the groups name the runs that
they repeat. Those that can reach a limit by what the groups counted are then counted on all pages. Words are split,
numbered and hashed by Arrow and NumPy for many pages at a time, each different word once.
"""

from __future__ import annotations

import functools
import hashlib
import html as entities
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pandas.util import hash_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

#: Tokens of the shortest substring that counts, different pages it must occur in, and its share of a group's pages.
LEAST, PAGES, SHARE = 6, 3, 0.02
#: The same inside an article or main element, whose text may quote what others hold. There a block goes only as a whole:
#: a quotation stands among words of the page's own, or on few pages.
ROOTED_PAGES, ROOTED_SHARE = 3, 0.4
#: Distinct pages of a group, about, and over half of it. A run on SHARE of a host's pages is on two of some group as long
#: as SHARE * GROUP_PAGES > 2.
GROUP_PAGES = 160
#: Hosts, or runs of all hosts, up to which they are broadcast rather than joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Characters of a tag's attributes, up to which what they mean is kept for the next such tag.
LONGEST_KEPT = 200

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "template", "xmp", "noframes"}
_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
    "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br",
}
_HINTS = {"nav", "footer", "aside", "form", "head", "menu", "dialog", "button", "select", "svg", "canvas", "object", "audio", "video", "map"}
#: Parts of class, id and role values that mark what isn't the article.
_MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notices?|alerts?|popup|modal|overlay|"
    r"side-?bar|widget\w*|menu\w*|nav|navbar|navigation|breadcrumbs?|pagination|pager|header|masthead|footer|copyright|"
    r"comments?|comment-?list|replies|disqus|respond|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|"
    r"search|toolbar|skip-?link|contentinfo|complementary|search-?form)(?:$|[\s_-])", re.I,
)
#: Words that such a class may have beside a mark inside an article. One with any other word names the article's own
#: matter: "related-work" is a section of it, "related-posts" is not.
_FURNITURE = {
    "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "container", "content", "form", "icons", "inner", "item", "items", "left", "link", "links", "list", "module",
    "panel", "post", "posts", "right", "section", "slot", "stories", "thread", "title", "top", "unit", "user", "wrap", "wrapper",
}
#: An open paragraph or list item ends where one of these begins.
_CLOSED_BY = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}


@functools.lru_cache(maxsize=1 << 14)  # pages of a site share their classes
def is_marked(values: str, in_article: bool) -> bool:
    """Whether class, id and role values say that an element isn't the article's. Inside an article a value does only if
    all its words are marks or ``_FURNITURE``."""
    if not values or not _MARKS.search(values):
        return False
    if not in_article:
        return True
    marked = (v for v in values.split() if _MARKS.search(v))
    return any(all(w.lower() in _FURNITURE or _MARKS.search(w) for w in re.split("[_-]+", v) if w) for v in marked)


@functools.lru_cache(maxsize=1 << 14)
def _marks_of(attributes: str) -> str:
    """The class, id and role values of a tag."""
    return " ".join(a[2] or a[3] or a[4] or "" for a in _ATTRIBUTE.finditer(attributes))


def blocks(page: str | None) -> tuple[list[str], str]:
    """The blocks in page order, and a character for each: ``h`` where markup hints that it isn't the article's, else 2
    in an article, 1 in the main element, 0 elsewhere."""
    page = page or ""
    found: list[str] = []
    kinds: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # tag, hinted, level
    hinted, level, at = False, 0, 0
    buffer: list[str] = []

    def flush() -> None:
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            if text:
                found.append(text)
                kinds.append("h" if hinted else str(level))
            buffer.clear()

    while at < len(page):
        m = _TAG.search(page, at)
        buffer.append(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        block = tag not in _INLINE
        if block:
            flush()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    hinted, level = stack[-1][1:] if stack else (False, 0)
                    break
            continue
        if tag in _RAW:
            end = _ENDS[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in _VOID or m[3].endswith("/"):
            continue
        if block and stack and stack[-1][0] in _CLOSED_BY and ((by := _CLOSED_BY[stack[-1][0]]) is None or tag in by):
            stack.pop()
            hinted, level = stack[-1][1:] if stack else (False, 0)
        marks = (_marks_of if len(m[3]) <= LONGEST_KEPT else _marks_of.__wrapped__)(m[3]) if m[3] else ""
        out = hinted or tag in _HINTS or (tag == "header" and level < 2) or (tag not in ("html", "body", "article", "main") and (is_marked if len(marks) <= LONGEST_KEPT else is_marked.__wrapped__)(marks, level == 2))
        out = out or (tag == "article" and "comment" in marks.lower())
        if out and not hinted:
            flush()
        inside = 2 if tag == "article" else 1 if tag == "main" or "main" in marks.split() else 0
        hinted, level = out, max(level, inside)
        stack.append((tag, hinted, level))
    flush()
    return found, "".join(kinds)


def suffix_order(tokens: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by their next ``order`` tokens, and for each place in that order the number of those tokens: the
    same for neighbours that share them all. Keys of as many tokens as a word of the machine holds are sorted first; two
    ranks that overlap or meet make the next key, so widths double up to ``order``."""
    n = len(tokens)
    rank = tokens - tokens.min() + 1  # 0 stands past the end
    bits = int(rank.max()).bit_length()
    width, key = 1, rank
    while width < order and (width + 1) * bits < 64:
        key = (key << bits) | np.concatenate([rank[width:], np.zeros(min(width, n), dtype=np.int64)])
        width += 1
    while True:
        place = np.argsort(key)
        ordered = key[place]
        number = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]]))
        if width >= order:
            return place, number
        rank = np.empty(n, dtype=np.int64)
        rank[place] = number
        step = min(width, order - width)
        key = rank * (n + 1)
        key[: max(n - step, 0)] += rank[step:]
        width += step


def repetition(tokens: np.ndarray, owner: np.ndarray, least: int) -> np.ndarray:
    """For each position, how many different owners have the substring of ``least`` tokens that begins there.
    ``tokens`` end each page with a token of its own, so none crosses a page's end. Longer repeats are made of these."""
    n = len(tokens)
    if not n:
        return np.zeros(0, dtype=np.int64)
    place, run = suffix_order(tokens, least)
    owners = int(owner.max()) + 1
    pairs = np.sort(run * owners + owner[place])
    new = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
    out = np.empty(n, dtype=np.int64)
    out[place] = np.bincount(new // owners)[run]
    return out


def covered(width: int, often: np.ndarray) -> np.ndarray:
    """Which tokens lie in one of the substrings of ``width`` tokens that begin where ``often`` is true."""
    n = len(often)
    at = np.nonzero(often)[0]
    marks = np.bincount(at, minlength=n + 1) - np.bincount(np.minimum(at + width, n), minlength=n + 1)
    return np.cumsum(marks[:n]) > 0


def words_in(found: list[str]) -> list[str]:
    return [w for b in found for w in b.split(" ")]


def hash64(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts (none of them empty) as numbers, a hash for each number that is the same in every process, and
    how many words each text has. Each different word is hashed once."""
    words = pc.split_pattern(texts, " ")
    coded = words.flatten().dictionary_encode()
    hashes = hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)
    return coded.indices.to_numpy(), hashes, pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)


def run_hashes(tokens: np.ndarray) -> np.ndarray:
    """Hashes of the runs of ``LEAST`` tokens, from the tokens' own."""
    n = len(tokens) - LEAST + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64)
    sums = np.zeros(n, dtype=np.uint64)
    for k in range(LEAST):
        sums = (sums ^ (sums >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + tokens[k : k + n]
    return sums.view(np.int64)


def repeated_runs(pages: pa.Array, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs that at least ``least`` of the pages (the words of each; no two alike) have, and how many have them."""
    pages = pages.filter(pc.not_equal(pages, ""))
    if len(pages) < least:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    numbers, hashes, sizes = words_of(pages)
    owner = np.repeat(np.arange(len(pages)), sizes + 1)
    ends = np.cumsum(sizes + 1) - 1  # each page ends with a token of its own
    is_word = np.ones(len(owner), dtype=bool)
    is_word[ends] = False
    stream = np.empty(len(owner), dtype=np.int64)
    stream[is_word] = numbers
    stream[ends] = len(hashes) + np.arange(len(pages))
    times = repetition(stream, owner, LEAST)
    runs = run_hashes(np.append(hashes, np.zeros(len(pages), dtype=np.uint64))[stream])  # those across an end are on one page only
    often = times[: len(runs)] >= least
    distinct, at = np.unique(runs[often], return_index=True)
    return distinct, times[: len(runs)][often][at]


class Words:
    """The words of pages, given as lists of blocks: all blocks, how many each page has, how many words each block has, and
    a hash for each run of ``LEAST`` words, which no page's end interrupts."""

    def __init__(self, found: pa.Array) -> None:
        self.blocks = found.flatten()
        self.n_blocks = pc.list_value_length(found).to_numpy(zero_copy_only=False).astype(np.int64)
        numbers, hashes, self.n_words = words_of(self.blocks)
        ends = np.concatenate([[0], np.cumsum(self.n_words)])[np.cumsum(self.n_blocks)]
        self.bounds = np.concatenate([[0], ends])
        self.runs = run_hashes(hashes[numbers])

    def runs_on(self, page: int) -> slice:
        """Where the runs of a page are."""
        first, end = self.bounds[page : page + 2]
        return slice(first, max(first, end - LEAST + 1))


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are ``known`` (sorted, one at least)."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def without(found: pa.Array, kinds: list[str], boiler: list[np.ndarray], shared: list[np.ndarray]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The texts of pages without what the runs ``boiler`` of each cover, or inside an article the runs ``shared`` (both
    sorted hashes), and without what markup rules out of the rest; words that went by runs, and by markup alone."""
    words = Words(found)
    n_pages, n_words = len(found), int(words.bounds[-1])
    often, often_inside = np.zeros(n_words, dtype=bool), np.zeros(n_words, dtype=bool)
    for page in range(n_pages):
        own = words.runs_on(page)
        for mask, known in ((often, boiler[page]), (often_inside, shared[page])):
            if len(known):
                mask[own] = among(words.runs[own], known)
    page_of = np.repeat(np.arange(n_pages), words.n_blocks)
    kind = np.frombuffer("".join(kinds).encode(), dtype=np.uint8)
    place = np.full(n_pages, ord("0"), dtype=np.uint8)
    np.maximum.at(place, page_of, np.where(kind == ord("h"), 0, kind).astype(np.uint8))
    main = kind == place[page_of]
    inside = main & (kind > ord("0"))
    gone = np.where(np.repeat(inside, words.n_words), covered(LEAST, often_inside), covered(LEAST, often))
    starts = np.cumsum(words.n_words) - words.n_words
    went = np.add.reduceat(gone, starts, dtype=np.int64) if len(starts) else np.zeros(0, dtype=np.int64)
    went[inside & (went < words.n_words)] = 0  # inside an article a block goes only as a whole
    left = words.n_words - went
    stays = main & (left > 0)
    texts = words.blocks.filter(pa.array(stays))
    if (cut := np.flatnonzero(stays & (went > 0))).size:
        at, texts = np.cumsum(stays) - 1, texts.to_pylist()
        for b in cut.tolist():
            texts[at[b]] = " ".join(w for w, g in zip(texts[at[b]].split(" "), gone[starts[b] :]) if not g)
        texts = pa.array(texts, pa.string())
    per_page = lambda counts: np.bincount(page_of, counts, n_pages).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(per_page(stays))]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(ends, texts), "\n\n"), per_page(went), per_page(np.where(main, 0, left))


def on_pages(pages: DataFrame, runs: DataFrame, parts: DataFrame, each: Callable, schema: str) -> DataFrame:
    """``each(pages, runs_of)`` over the pages (Arrow tables); runs_of(host, rooted) are the sorted hashes of ``runs``
    (host, run, rooted). Few runs are broadcast; many go to the groups of their host, with which pages are cogrouped."""

    def lookup(found: pa.Table) -> Callable[[str, bool], np.ndarray]:
        hosts, run, rooted = (found.column(c).to_numpy(zero_copy_only=False) for c in ("host", "run", "rooted"))
        by = np.argsort(hosts.astype(str), kind="stable")
        names, first = np.unique(hosts[by].astype(str), return_index=True)
        spans = dict(zip(names.tolist(), np.split(by, first[1:])))
        sets = {(h, r): np.sort(run[at[rooted[at]] if r else at]) for h, at in spans.items() for r in (False, True)}
        none = np.zeros(0, dtype=np.int64)
        return lambda host, is_rooted: sets.get((host, is_rooted), none)

    if runs.count() <= BROADCAST_ROWS:
        shared = pages.sparkSession.sparkContext.broadcast(runs.select("host", "run", "rooted").toArrow())

        def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            runs_of = lookup(shared.value)
            for batch in batches:
                for part in common.byte_slices(batch, 2048, 8 << 20):
                    yield from each(pa.Table.from_batches([part]), runs_of).to_batches()

        return pages.mapInArrow(mapped, schema)
    spread = runs.join(parts, "host").select("host", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), "run", "rooted")
    return pages.groupBy("host", "part").cogroup(spread.groupBy("host", "part")).applyInArrow(lambda left, right: each(left, lookup(right)), schema)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, text, n_chars (code points), and how many words went as repeated (n_repeated) and by markup
    alone (n_marked).

    A null html is empty and has an empty text. Very long pages are read whole. A null url belongs to the host "". A repeated row gives a row each and
    counts as one page where repetition is counted. An empty table gives no rows.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("host", host)
    id_type = rows.schema["id"].dataType
    id_arrow, id_sql = to_arrow_type(id_type), id_type.simpleString()
    parsed = pa.schema([("id", id_arrow), ("url", pa.string()), ("host", pa.string()), ("content", pa.int64()), ("blocks", pa.list_(pa.string())), ("kinds", pa.string())])

    def start():
        def each(row_id, url, page, host):
            found, kinds = blocks(page)
            return row_id, url, host, hash64("\n".join(found)), found, kinds

        return each

    read = common.map_rows(rows, f"id {id_sql}, url string, host string, content long, blocks array<string>, kinds string", start, parsed)
    read = common.written(read, "blocks", compression="zstd")
    parts = read.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("n")).withColumn("groups", F.ceil(F.col("n") / GROUP_PAGES))
    limit = F.greatest(F.lit(float(PAGES)), F.lit(SHARE) * F.col("n"))
    parts = parts.withColumn("few", F.greatest(F.lit(1), F.ceil(limit / F.col("groups")) - 2))
    parts = common.written(parts, "hosts")
    if parts.count() <= BROADCAST_ROWS:
        parts = F.broadcast(parts)
    read = read.join(parts.select("host", "groups", "few"), "host").withColumn("part", F.pmod("content", "groups"))

    def first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One copy of each content a task, compressed: many copies of one page don't all go to the task of its group."""
        seen: set[tuple[str, int]] = set()
        press = zstandard.ZstdCompressor()
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()))
            new = [k not in seen and not seen.add(k) for k in keys]
            first = batch.filter(pa.array(new, pa.bool_()))
            packed = [press.compress(text) for text in pc.binary_join(first.column(3), " ").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*first.columns[:3], pa.array(packed, pa.binary()), *first.columns[4:]], names=["host", "part", "content", "packed", "few"])

    def named(group: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        distinct = dict(zip(group.column("content").to_pylist(), group.column("packed")))
        texts = pa.array([unpack.decompress(p.as_py()) for p in distinct.values()], pa.large_binary()).cast(pa.large_string())
        runs, times = repeated_runs(texts, group.column("few")[0].as_py() + 1)
        return pa.table([pa.repeat(group.column("host")[0], len(runs)), pa.array(runs), pa.array(times)], names=["host", "run", "count"])

    def counted(pages: pa.Table, runs_of) -> pa.Table:
        words = Words(pages.column("blocks").combine_chunks())
        hits = [np.zeros(0, dtype=np.int64)]
        for page, host in enumerate(pages.column("host").to_pylist()):
            own, known = words.runs[words.runs_on(page)], runs_of(host, False)
            hits.append(np.unique(own[among(own, known)]) if len(known) else hits[0])
        page_of = pa.array(np.repeat(np.arange(len(pages)), np.array([len(h) for h in hits[1:]], dtype=np.int64)))
        return pa.table([pages.column("host").take(page_of), pa.array(np.concatenate(hits)), pages.column("content").take(page_of)], names=["host", "run", "content"])

    final = pa.schema([("id", id_arrow), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_repeated", pa.int64()), ("n_marked", pa.int64())])

    def kept(pages: pa.Table, runs_of) -> pa.Table:
        hosts = pages.column("host").to_pylist()
        known = ([runs_of(host, rooted) for host in hosts] for rooted in (False, True))
        texts, by_runs, by_marks = without(pages.column("blocks").combine_chunks(), pages.column("kinds").to_pylist(), *known)
        counts = [pc.utf8_length(texts).cast(pa.int64()), pa.array(by_runs), pa.array(by_marks)]
        return pa.table([pages.column("id").cast(id_arrow), pages.column("url"), texts, *counts], schema=final)

    streams = read.select("host", "part", "content", "blocks", "few")
    streams = streams.mapInArrow(first_copies, "host string, part long, content long, packed binary, few long")
    found = common.written(streams.groupBy("host", "part").applyInArrow(named, "host string, run long, count long"), "found")
    # Groups name the runs on more than ``few`` of their pages; elsewhere a run is on ``few`` at most, so one that reaches
    # the limit on the whole host must make up for that where it is named. With one group, its count is the host's.
    found = found.groupBy("host", "run").agg(F.sum("count").alias("count"), F.count("*").alias("named")).join(parts, "host")
    found = found.where(F.col("count") + F.col("few") * (F.col("groups") - F.col("named")) >= limit).select("host", "run", "count", "groups")
    candidates = common.written(found, "candidates")
    asked = candidates.where("groups > 1").select("host", "run", F.lit(False).alias("rooted"))
    counts = on_pages(read.where("groups > 1"), asked, parts, counted, "host string, run long, content long").distinct().groupBy("host", "run").count()
    counts = counts.unionByName(candidates.where("groups = 1").select("host", "run", "count")).join(parts, "host")
    least = lambda least, share: F.col("count") >= F.greatest(F.lit(float(least)), F.lit(share) * F.col("n"))
    boiler = counts.where(least(PAGES, SHARE)).select("host", "run", least(ROOTED_PAGES, ROOTED_SHARE).alias("rooted"))
    out = on_pages(read, common.written(boiler, "boilerplate"), parts, kept, f"id {id_sql}, url string, text string, n_chars long, n_repeated long, n_marked long")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
