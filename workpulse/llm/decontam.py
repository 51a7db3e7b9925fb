"""Benchmark decontamination: one Aho-Corasick automaton over the test items, one scan of each text.

Normalisation works on UTF-8 bytes: A-Z are lowered and every ASCII byte that isn't a letter or digit becomes a space
(bytes from 0x80 belong to words). Words with a space on either side are then a plain substring. The automaton holds all
blocks of half a window's words. At most one such block ends at a word, and a window is told by its first and its last
block, so a window is found by looking up the pair of blocks that end at a word and half a window before it: the work is
linear in the text, whatever repeats in it or in the items. An item of fewer words than a window is a block of its own.
Original offsets come from the words' places in the text, and are needed only in texts with a hit.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 10
#: Item text in one automaton, some 300 bytes of memory each. A larger benchmark is split, each part is scanned in its own
#: pass, and the rows are written between passes, so that a worker has one automaton at a time.
AUTOMATON_BYTES = 1 << 19

#: Bytes of text that are cut into words together.
TEXT_BYTES = 1 << 20
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

_RUN = pa.struct([("first", pa.int32()), ("last", pa.int32())])
_RUN_SQL = "array<struct<first:int,last:int>>"


def word_lists(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in order, those of about ``TEXT_BYTES`` bytes of it at a time; no word is cut."""
    body, at = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE), 0
    while len(body) - at > TEXT_BYTES:
        gap = body.find(b" ", at + TEXT_BYTES)
        stop = len(body) if gap < 0 else gap
        yield body[at:stop].split()
        at = stop
    yield body[at:].split()


def normalised(text: str | None) -> bytes:
    """The words, each between single spaces; a single space if there are none."""
    parts = [b" ".join(words) for words in word_lists(text) if words]
    return b" " + b" ".join(parts) + b" " if parts else b" "


class Items:
    """The automaton of some items' blocks, and which items own which windows."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        import ahocorasick

        self.width, self.half = width, (width + 1) // 2
        self.gap = width - self.half  # words from the end of a window's first block to the end of its last
        self.names = [name for name, _ in items]
        blocks: dict[bytes, int] = {}
        pairs: dict[int, list[int]] = {}
        wholes: dict[int, list[int]] = {}
        for i, (_, text) in enumerate(items):
            words = [w for part in word_lists(text) for w in part]
            size = self.half if len(words) >= width else len(words)
            numbers = [blocks.setdefault(b" " + b" ".join(words[at : at + size]) + b" ", len(blocks)) for at in range(len(words) - size + 1)] if words else []
            if len(words) >= width:
                for first, last in zip(numbers, numbers[self.gap :]):
                    owners = pairs.setdefault(first << 32 | last, [])
                    if owners[-1:] != [i]:
                        owners.append(i)
            elif words:
                wholes.setdefault(numbers[0], []).append(i)
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        listed = [pairs[k] for k in self.keys.tolist()] + list(wholes.values())
        self.owners = np.array([i for owners in listed for i in owners], dtype=np.int64)
        self.first_owner = np.cumsum([0] + [len(owners) for owners in listed])
        self.in_pair = np.zeros(len(blocks), dtype=bool)
        self.in_pair[self.keys >> 32] = self.in_pair[self.keys & 0xFFFFFFFF] = True
        self.whole = np.full(len(blocks), -1)
        self.whole[list(wholes)] = len(self.keys) + np.arange(len(wholes))
        self.words = np.array([block.count(b" ") - 1 for block in blocks], dtype=np.int64)
        self.found = ahocorasick.Automaton()
        for block, number in blocks.items():
            self.found.add_word(block.decode("latin-1"), number)
        if blocks:
            self.found.make_automaton()

    def windows(self, norm: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, last word, window) of all occurrences of windows."""
        ends, blocks = array("q"), array("q")
        for end, block in self.found.iter(norm.decode("latin-1")) if len(self.words) else ():
            ends.append(end)
            blocks.append(block)
        if not ends:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        block = np.frombuffer(blocks, dtype=np.int64)
        spaces = np.flatnonzero(np.frombuffer(norm, dtype=np.uint8) == 32)
        last = np.searchsorted(spaces, np.frombuffer(ends, dtype=np.int64)) - 1
        whole = np.flatnonzero(self.whole[block] >= 0)
        found = [(last[whole] - self.words[block[whole]] + 1, last[whole], self.whole[block[whole]])]
        in_pair = self.in_pair[block] & (self.words[block] == self.half)
        at, of = last[in_pair], block[in_pair]
        if len(at):
            before = np.searchsorted(at, at - self.gap)  # not beyond the end: at itself is as large
            key = of[before] << 32 | of
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (at[before] == at - self.gap) & (self.keys[place] == key)
            found.append((at[hit] - self.width + 1, at[hit], place[hit]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def items_of(self, windows: np.ndarray) -> list[str]:
        """The names of the items that own some windows."""
        windows = np.unique(windows)
        owners = self.owners[common.ranges(self.first_owner[windows], self.first_owner[windows + 1])]
        return [self.names[i] for i in np.unique(owners).tolist()]

    def scan(self, norm: bytes) -> Iterator[tuple[int, int, str]]:
        """(first word, last word, item) of every occurrence of a window, for each item that owns it."""
        for first, last, window in zip(*(x.tolist() for x in self.windows(norm))):
            for name in self.items_of(np.array([window])):
                yield first, last, name


def covered(firsts: np.ndarray, lasts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive words that some ranges of words cover."""
    if not len(firsts):
        return []
    change = np.zeros(int(lasts.max()) + 3, dtype=np.int64)
    np.add.at(change, firsts + 1, 1)
    np.add.at(change, lasts + 2, -1)
    edges = np.flatnonzero(np.diff(np.cumsum(change) > 0))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2])]


def test_items(benchmark: DataFrame, item_col: str, text_col: str, automaton_bytes: int) -> tuple[DataFrame, int]:
    """Items (item, text) with an id and a text, and into how many automata they go."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return items, -(-total // automaton_bytes) or 1


def part_of(items: DataFrame, part: int, parts: int) -> list[tuple[str, str]]:
    """The items of one automaton, about ``automaton_bytes`` of text."""
    mine = items if parts == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part)
    return [(r["item"], r["text"]) for r in mine.collect()]


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", width: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """Per document: id, n_words, n_hit, item_ids (array of strings, sorted as strings) and spans (start, end: code
    points of the original text, end exclusive), runs of words that lie in an occurrence of a window.

    Null texts and texts of separators have no words and no hits; so have items, which then match nothing. An item
    with a null id is left out, as it can't be named; items that repeat count once. Very long texts are scanned whole. A
    repeated document row gives a row each. Empty tables give no rows or no hits. The scan is a map: no shuffle, and no text leaves its task.
    """
    spark = docs.sparkSession
    items, parts = test_items(benchmark, item_col, item_text_col, automaton_bytes)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_sql = rows.schema["id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    id_arrow = to_arrow_type(rows.schema["id"].dataType)
    strings = pa.list_(pa.string())
    between = pa.schema([("id", id_arrow), ("text", pa.string()), ("runs", pa.list_(_RUN)), ("items", strings)])
    final = pa.schema([
        ("id", id_arrow), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", strings),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ])

    rows = rows.withColumns({"runs": F.lit(None).cast(_RUN_SQL), "items": F.lit(None).cast("array<string>")})
    for part in range(parts):
        shared = spark.sparkContext.broadcast(part_of(items, part, parts))
        last = part == parts - 1

        def start(shared=shared, last=last, token=uuid.uuid4().hex):
            found = common.once(token, lambda: Items(shared.value, width))

            def each(row_id, text, runs, names):
                norm = normalised(text)
                firsts, lasts, windows = found.windows(norm)
                before = np.array([(r["first"], r["last"]) for r in runs or []], dtype=np.int64).reshape(-1, 2)
                runs = covered(np.concatenate([before[:, 0], firsts]), np.concatenate([before[:, 1], lasts]))
                names = sorted({*(names or []), *found.items_of(windows)})
                if not last:
                    return row_id, text, [{"first": a, "last": b} for a, b in runs], names
                at = [m.span() for m in _WORD.finditer(text)] if runs else []
                return row_id, norm.count(b" ") - 1, sum(b - a + 1 for a, b in runs), names, [{"start": at[a][0], "end": at[b][1]} for a, b in runs]

            return each

        sql = f"id {id_sql}, n_words long, n_hit long, item_ids array<string>, spans array<struct<start:long,end:long>>" if last else f"id {id_sql}, text string, runs {_RUN_SQL}, items array<string>"
        rows = common.map_rows(rows, sql, start, final if last else between)
        if not last:
            rows = common.written(rows, "hits")
    return rows.withColumnRenamed("id", id_col)


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    width: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no window of an item; one pass for each automaton.

    Null and empty texts hold none and stay. Very long texts are scanned whole. Items with a null id or text are left
    out. A repeated row stays as often as it is given; an empty table gives no rows, an empty benchmark all of them.
    """
    items, parts = test_items(benchmark, item_col, item_text_col, automaton_bytes)
    for part in range(parts):
        shared = docs.sparkSession.sparkContext.broadcast(part_of(items, part, parts))

        def start(shared=shared, token=uuid.uuid4().hex):
            found = common.once(token, lambda: Items(shared.value, width))
            return lambda texts: ([not len(found.windows(normalised(t))[0]) for t in texts], {})

        docs = common.map_whole_rows(docs, text_col, start)
        if part < parts - 1:
            docs = common.written(docs, "clean")
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
