"""Secret scans: fixed patterns, and strings that a dictionary-primed compressor finds new.

A candidate is a token, runs of key characters joined by dots, that begins near a word such as "password" or "bearer";
it has no upper length, and is judged by its long runs. Novelty is the number of bytes that a string adds to a zstandard
frame primed with an identifier dictionary and the text around it: names, paths and repeated strings add few bytes,
random ones nearly their entropy. Candidates of high novelty per character are reported, whole, beside the matches of
the fixed patterns.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

_ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_HINT = re.compile(r"passw|secret|token|api_?key")
_CONTEXT = re.compile(r"passw|secret|token|api[_ -]?key|credential|bearer|private[_ -]?key|access[_ -]?key|auth", re.I)
_KEY = re.compile(r"[A-Za-z0-9+/_=-]+")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]+)*")
_ALNUM = re.compile(r"[A-Za-z0-9]")
#: Characters of the shortest run that is judged, and of the pieces, overlapping by half, that longer runs are judged in.
#: From 64 characters on zstandard codes single characters by their frequency, and random strings of few different
#: characters shrink below any limit that suits short ones; in pieces, a long key is judged as a short one is.
SHORTEST, PIECE = 16, 60

#: What code and configuration name things; primes the compressor, so that such names are not new to it.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key public_key credential authorization bearer "
    "username user_id account client_id client_secret session_id config configuration settings environment default "
    "example placeholder changeme undefined null true false function return import export const class interface "
    "request response header content-type application/json charset=utf-8 https://www.example.com/index.html "
    "localhost:8080 /usr/local/bin /etc/ssl/certs ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 0123456789 "
)
ORDER = {"assign": 0, "access": 1, "hex": 2, "novel": 3}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns as (kind, start, end)."""
    found = []
    if _ASSIGN_HINT.search(text.lower()):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    return found + [("hex", *m.span()) for m in _HEX.finditer(text)]


#: About how many of a hundred letters are this one, over English, German, French and Spanish.
LETTERS = {
    "a": 8, "b": 1.5, "c": 3.5, "d": 4.5, "e": 15, "f": 1.5, "g": 2, "h": 3.5, "i": 8, "j": 0.4, "k": 0.8, "l": 4.5, "m": 2.8,
    "n": 8, "o": 6, "p": 2.3, "q": 0.5, "r": 7, "s": 7, "t": 7, "u": 5, "v": 1.3, "w": 1, "x": 0.3, "y": 0.8, "z": 0.6,
}
_LIKE_WORDS = {c: math.log(n * len(LETTERS) / 100) for c, n in LETTERS.items()}


_PIECE = re.compile(r"[0-9]{1,8}|[A-Za-z]+[0-9]{0,4}")


def is_plain(run: str) -> bool:
    """Whether a run is made of short numbers and of words, which may end in a few digits: its case hardly changes, and
    its letters are likelier in a language than by chance. Long words are as new to a compressor as keys are, so they are
    held to this too. Longer numbers are no words and are measured, but those that only count or repeat a digit."""
    if not all(_PIECE.fullmatch(p) or (p.isdigit() and len({(int(b) - int(a)) % 10 for a, b in zip(p, p[1:])}) == 1) for p in re.split("[^A-Za-z0-9]+", run) if p):
        return False
    letters = [c for c in run if c.isalpha()]
    if not letters:
        return True
    changes = sum(a.isupper() != b.isupper() for a, b in zip(letters, letters[1:]))
    return changes < 0.3 * len(letters) and sum(_LIKE_WORDS[c.lower()] for c in letters) >= 0


class Novelty:
    """Marginal compressed bytes per character of a string among its surroundings."""

    def __init__(self, around: int = 256, level: int = 3):
        import zstandard

        self.zstd, self.around, self.level = zstandard, around, level

    def __call__(self, text: str, start: int, end: int) -> float:
        """Bytes that text[start:end] adds to a frame primed with the identifiers and what stands around it, a character."""
        near = text[max(0, start - self.around) : start] + " " + text[end : end + self.around]
        primer = self.zstd.ZstdCompressionDict((IDENTIFIERS + near).encode("utf-8", "replace"), dict_type=self.zstd.DICT_TYPE_RAWCONTENT)
        press = self.zstd.ZstdCompressor(level=self.level, dict_data=primer, write_checksum=False, write_content_size=False)
        candidate = text[start:end].encode()
        return (len(press.compress(candidate)) - len(press.compress(b""))) / len(candidate)


def novel_spans(text: str, taken: list[tuple[str, int, int]], novelty: Novelty, at_least: float, reach: int) -> list[tuple[str, int, int]]:
    """Tokens that begin in a sensitive context (such a word ends within ``reach`` characters before them) and hold a
    run, or a piece of a long run, that no fixed pattern covers, isn't a number or like a word, and is novel."""
    found: list[tuple[str, int, int]] = []
    edges = sorted((a, b) for _, a, b in taken)
    ends = list(itertools.accumulate((b for _, b in edges), max))
    begun: list[int] = []
    tokens: list[tuple[int, list[tuple[int, int]], bool]] = []

    def is_taken(start: int, end: int) -> bool:
        """Whether the fixed patterns cover all letters and digits of text[start:end]."""
        at = start
        for i in range(bisect.bisect_right(ends, start), bisect.bisect_left(edges, (end,))):
            if edges[i][0] > at and _ALNUM.search(text, at, edges[i][0]):
                return False
            at = max(at, edges[i][1])
        return at > start and not _ALNUM.search(text, at, end)

    def is_secret(start: int, end: int) -> bool:
        return not is_plain(text[start:end]) and novelty(text, start, end) >= at_least

    def any_secret(start: int, end: int) -> bool:
        """Whether a piece of the run text[start:end] is a secret."""
        if end - start < SHORTEST or is_taken(start, end):
            return False
        if end - start <= PIECE:
            return is_secret(start, end)
        return any(is_secret(a, a + PIECE) for a in [*range(start, end - PIECE, PIECE // 2), end - PIECE])

    for word in _CONTEXT.finditer(text):
        at, last = word.end(), min(len(text), word.end() + reach + 1)
        while first := _KEY.search(text, at, last):
            start = first.start()
            i = bisect.bisect_right(begun, start) - 1
            if i >= 0 and start < tokens[i][0]:
                end, runs, secret = tokens[i]
                if start > begun[i] and not secret:
                    # the word is inside a token: all but what directly follows it has been judged
                    stop = runs[bisect.bisect_right(runs, (start, len(text))) - 1][1]
                    if any_secret(start, min(stop, start + PIECE)):
                        found.append(("novel", start, end))
                        tokens[i] = (end, runs, True)
            else:
                end = _TOKEN.match(text, start).end()
                runs = [m.span() for m in _KEY.finditer(text, start, end)]
                secret = any(any_secret(a, b) for a, b in runs)
                if secret:
                    found.append(("novel", start, end))
                begun.append(start)
                tokens.append((end, runs, secret))
            at = end
    return found


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_least: float = 0.72, reach: int = 40, keep_text: bool = False,
) -> DataFrame:
    """Per document: id and ``found``, an array of (kind, start, end, text), by start and then kind; offsets are code
    points, end exclusive. With ``keep_text``, also ``redacted``: the text with every span replaced by ``[SECRET]``.

    A null text is empty and has no spans (``redacted`` stays null). A repeated row gives a row each; an empty table
    none. The scan is a map over whole texts, with nothing shuffled.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_sql = rows.schema["id"].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])
    arrow = pa.schema([("id", to_arrow_type(rows.schema["id"].dataType)), ("found", pa.list_(span))] + [("redacted", pa.string())] * keep_text)

    def start():
        common.forget()
        novelty = Novelty()

        def each(row_id, text):
            body = text or ""
            found = base_spans(body)
            found += novel_spans(body, found, novelty, at_least, reach)
            found.sort(key=lambda s: (s[1], ORDER[s[0]]))
            spans = [{"kind": k, "start": a, "end": b, "text": body[a:b]} for k, a, b in found]
            return (row_id, spans, redact(text, found)) if keep_text else (row_id, spans)

        return each

    sql = f"id {id_sql}, found array<struct<kind:string,start:long,end:long,text:string>>" + ", redacted string" * keep_text
    return common.map_rows(rows, sql, start, arrow).withColumnRenamed("id", id_col)


def redact(text: str | None, found: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str | None:
    """``text`` with the union of the spans replaced, span by span."""
    if not found:
        return text
    out, at = [], 0
    for _, a, b in sorted(found, key=lambda s: s[1:]):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", at_least: float = 0.72, reach: int = 40) -> DataFrame:
    """All rows and columns of ``docs``, with every span replaced in the text and its length, if kept, put right.

    Null and empty texts stay as they are; very long texts are scanned whole. Spans that overlap are replaced together.
    A repeated row stays as often as it is given; an empty table gives no rows.
    """
    with_length = length_col in docs.columns

    def start():
        common.forget()
        novelty = Novelty()

        def judge(texts):
            out = []
            for text in texts:
                found = base_spans(text or "")
                found += novel_spans(text or "", found, novelty, at_least, reach)
                out.append(redact(text, found))
            if out == texts:
                return [True] * len(texts), {}
            lengths = {length_col: [None if t is None else len(t) for t in out]} if with_length else {}
            return [True] * len(texts), {text_col: out} | lengths

        return judge

    return common.map_whole_rows(docs, text_col, start)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(common.table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["kind"] != "novel")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
    )
