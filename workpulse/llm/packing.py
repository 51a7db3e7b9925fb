"""Best-fit packing of tokenised documents by exact-complement hashing.

Only *lengths* decide a packing, and a length is at most ``size``. So the plan is made from a histogram of at most
``size`` numbers, whatever the number of documents; Spark then deals the pieces out to the places the plan made.

1. Tokenise and cut (one pass, no shuffle). A task numbers its pieces of each length and writes them.
2. Count pieces by (task, length); running sums by length turn a task's numbers into global ranks.
3. The driver plans over the histogram: combinations that fill a sequence exactly (a length with one, two or three
   others) are consumed as often as counts allow; what is left goes best-fit into the smallest gap.
4. A piece's length and rank give its sequence and offset by a search in the plan (bounded: at most a few runs for
   each length and step).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SIZE = 2048
#: Words kept with their ids in a worker, some 350 bytes each, and characters of them: past either the store becomes the
#: older one, which words that recur are taken from, and a new one begins.
WORDS_KEPT, CHARS_KEPT = 350_000, 8 << 20
_OTHER = re.compile("[^\x00-\u012f\u0131-\u024f]")

PIECES = "id {id}, piece int, start long, length int, ids_crc32 long, block int, slot long"


class WordEncoder:
    """Token ids of texts, word by word.

    The tokenizer splits at white space and none of its units crosses a space, so a text's ids are those of its
    space-separated words, one after another; words recur, and each is encoded once while it is kept. Words of letters
    alone are single units, whose last token carries the vocabulary's word-end mark: many of them are encoded as one
    text and told apart by the marks. A full stop or comma after letters is a unit of its own.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[number for token, number in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.chars = 0
        self.stops = {c: self._ids(self.tokenizer.encode(c, add_special_tokens=False).ids) for c in ".,"}

    @staticmethod
    def _ids(ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        known, stops = self.known, self.stops
        stopped = [w for w in words if w[-1:] in stops and w[:-1].isalpha()]
        bare = dict.fromkeys(w[:-1] for w in stopped)
        bare.update(dict.fromkeys(w for w in words if w.isalpha()))
        letters = [w for w in bare if w not in known]
        if letters:
            ids = np.array(self.tokenizer.encode(" ".join(letters), add_special_tokens=False).ids, dtype="<u4")
            edges = (4 * (np.nonzero(self.ends[ids])[0] + 1)).tolist()
            if len(edges) == len(letters):
                raw = ids.tobytes()
                known.update((w, raw[a:b]) for w, a, b in zip(letters, [0, *edges], edges))
            else:  # some letter is normalised to something else
                known.update((w, self._ids(e.ids)) for w, e in zip(letters, self.tokenizer.encode_batch_fast(letters, add_special_tokens=False)))
        known.update((w, known[w[:-1]] + stops[w[-1]]) for w in stopped)
        rest = [w for w in words if w not in known]
        known.update((w, self._ids(e.ids)) for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not _OTHER.search(text):  # the tokenizer lowers letters too, here by the same rules as Python
            text = text.lower()
        words = text.replace("\n", " ").split(" ")
        known = self.known
        new = [w for w in set(words) if w not in known]
        if new:
            if len(known) > WORDS_KEPT or self.chars > CHARS_KEPT:
                self.older, self.chars = known, 0
                known = self.known = {}
                new = list(set(words))
            self.chars += sum(map(len, new))
            older = self.older
            known.update((w, older[w]) for w in new if w in older)
            self._learn([w for w in new if w not in older])
        return b"".join([known[w] for w in words])


def encoder(path: str) -> WordEncoder:
    return common.once(f"encoder {path}", lambda: WordEncoder(path))


def cut_pieces(docs: DataFrame, id_col: str, text_col: str, size: int, tokenizer: str | None) -> DataFrame:
    """A row for each piece. ``block`` is the task that made it and ``slot`` its number among that task's pieces of
    its length; write the result before use, as both belong to one run of the task."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType
    id_arrow = pa.int64() if id_type.simpleString() == "bigint" else None
    schema = PIECES.format(id=id_type.simpleString())

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(common.tokenizer_path(tokenizer)).encode
        block = TaskContext.get().partitionId()
        used = np.zeros(size + 1, dtype=np.int64)
        end = np.zeros(1, dtype="<u4").tobytes()
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            take = []
            for at, text in enumerate(common.texts_of(batch, 1)):
                ids = encode(text or "") + end
                for number, start in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[start : start + 4 * size]
                    length = len(part) // 4
                    take.append(at)
                    for column, value in zip(out, (number, start // 4, length, zlib.crc32(part), block, int(used[length]))):
                        column.append(value)
                    used[length] += 1
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            ids = batch.column(0).take(pa.array(take, type=pa.int64()))
            ids = ids.cast(id_arrow) if id_arrow else ids
            arrays = [ids] + [pa.array(c, type=k) for c, k in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "piece", "start", "length", "ids_crc32", "block", "slot"])

    return rows.mapInArrow(pieces, schema)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, offset): the pieces of that length with these ranks go to
    successive sequences at that offset. Its work depends on ``size`` alone, not on the counts.
    """
    left = np.zeros(size + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] += n
    taken = np.zeros(size + 1, dtype=np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def place(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, int(taken[length]), n, first, offset))
        taken[length] += n
        left[length] -= n

    def consume(lengths: list[int]) -> int:
        """As many sequences of just these lengths as the counts allow."""
        nonlocal sequences
        n = min(int(left[x]) // lengths.count(x) for x in lengths)
        if n:
            offset = 0
            for x in lengths:
                place(x, n, sequences, offset)
                offset += x
            sequences += n
        return n

    def pair_for(gap: int, top: int) -> tuple[int, int] | None:
        """The pair with the longest first length up to ``top`` that sums to ``gap``."""
        first = np.arange(min(top, gap - 1), (gap + 1) // 2 - 1, -1)
        if not len(first):
            return None
        fits = np.nonzero((left[first] > 0) & (left[gap - first] > np.where(2 * first == gap, 1, 0)))[0]
        return (int(first[fits[0]]), gap - int(first[fits[0]])) if len(fits) else None

    consume([size])
    for a in range(size - 1, (size - 1) // 2, -1):  # one complement
        if left[a] and (2 * a != size or left[a] > 1):
            consume([a, size - a])
    for a in range(size - 2, 0, -1):  # two complements
        while left[a] and (found := pair_for(size - a, a)):
            if not consume([a, *found]):
                break
    for a in range(size - 3, 0, -1):  # three complements
        b = min(a, size - a - 2)
        while left[a] and b > 0:
            if left[b] and (found := pair_for(size - a - b, b)) and consume([a, b, *found]):
                continue
            b -= 1

    # Best fit: gaps[r] has groups (first sequence, sequences) that all have r tokens free.
    gaps: dict[int, list[tuple[int, int]]] = {}
    for length in range(size, 0, -1):
        while left[length]:
            fits = [r for r in gaps if r >= length]
            if fits:
                gap = min(fits)
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
            else:
                gap, first, n = size, sequences, -(-int(left[length]) // max(1, size // length))
                sequences += n
            here = min(n, int(left[length]))
            place(length, here, first, size - gap)
            if gap > length:
                gaps.setdefault(gap - length, []).append((first, here))
            if n > here:
                gaps.setdefault(gap, []).append((first + here, n - here))
    return runs


def pack(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
    tokenizer: str | None = None,
) -> DataFrame:
    """Every document's pieces with the sequence and offset they are placed at.

    A null text is empty; every document ends with id 0, so an empty one has length 1. Documents of over ``size``
    tokens are cut into pieces of ``size``, the last of which may be shorter. A repeated row is a document of its
    own. An empty table gives no rows. A null id is kept as it is. Which of several pieces of one length gets which
    place is arbitrary, but fixed once the pieces are written.
    """
    pieces = common.written(cut_pieces(docs, id_col, text_col, size, tokenizer), "pieces")
    counts = pieces.groupBy("block", "length").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("block"), F.col("length"), before.alias("before"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    runs = sorted(plan(totals, size))
    shift = 48
    keys = np.array([(r[0] << shift) + r[1] for r in runs], dtype=np.int64)
    first_rank, first_sequence, offset = (np.array([r[i] for r in runs], dtype=np.int64) for i in (1, 3, 4))

    ranked = pieces.join(starts, ["block", "length"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("slot")).alias("rank")
    )
    schema = f"{id_col} {pieces.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            run = np.searchsorted(keys, (length << shift) + rank, side="right") - 1
            arrays = [batch.column(i) for i in (0, 1, 2)] + [pa.array(length), batch.column("ids_crc32")]
            arrays += [pa.array(first_sequence[run] + rank - first_rank[run]), pa.array(offset[run])]
            yield pa.RecordBatch.from_arrays(arrays, [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(placed, schema)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, common.table(spark, sf_dir, "documents"))
