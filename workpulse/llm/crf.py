"""A linear-chain conditional random field over words, in NumPy.

A word's label scores are a sum of hashed weights of its features: the word itself (the learned lexicon), its affixes
and the three-byte pieces of it. They are worked out once for each different word; sequences are then looked up, and
many sequences go through forward-backward together, one position at a time.

Sequences are laid out by position: all first tokens, then all second ones, and so on, the longest sequences first. The
layout is cut into blocks of positions; the scaled state is carried from block to block, so results are exact while only
a block's arrays are held, however long a sequence is.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterable, Iterator

import numpy as np

#: Characters that count among a word's in Python but aren't letters: Roman numeral signs, fractions, superscripts.
_SIGNS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha())
WORD = re.compile(rf"[^\W\d_{re.escape(_SIGNS)}]+")
_FAST_WORD = re.compile(r"[^\W\d_]+")
_GAP = re.compile(rf"[\W\d_{re.escape(_SIGNS)}]")
BITS = 17
MASK = (1 << BITS) - 1
#: Different words whose scores a worker keeps; past it the store is emptied and filled anew.
WORDS_KEPT = 400_000
#: Characters of a text whose words are numbered together, and bytes of words whose features are worked out together.
TEXT_CHARS, FEATURE_BYTES = 1 << 19, 1 << 20
#: Tokens of a block of positions, and tokens of sequences that go through the recursions together.
BLOCK_TOKENS, SLICE_TOKENS = 1 << 17, 1 << 19


def lowered(text: str) -> str:
    """Lower case, with characters whose lower case is longer left alone, so that offsets hold."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def word_lists(text: str | None) -> Iterator[list[str]]:
    """The words of a text in lower case, about ``TEXT_CHARS`` characters of it at a time; no word is cut."""
    low, at = lowered(text or ""), 0
    while at < len(low):
        gap = _GAP.search(low, at + TEXT_CHARS)
        stop = gap.start() if gap else len(low)
        words = _FAST_WORD.findall(low, at, stop)  # the same but for the signs, and much faster
        yield words if "".join(words).isalpha() or not words else WORD.findall(low, at, stop)
        at = stop


def words_of(text: str | None) -> list[str]:
    return [w for part in word_lists(text) for w in part]


def affixes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of the words as wholes, of their first one to five and their last one to four letters (words by ten),
    and which of them there are: a word has its affixes of fewer letters than its own."""
    n = len(words)
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    ends = np.cumsum(lengths)
    found, there = np.empty((n, 10), dtype=np.int64), np.ones((n, 10), dtype=bool)
    found[:, 0] = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass"), 1) & MASK for w in words), dtype=np.int64, count=n)
    for slots, kind, place in ((range(1, 6), 2, lambda k: ends - lengths + k - 1), (range(6, 10), 3, lambda k: ends - k)):
        total = np.full(n, kind, dtype=np.uint32)
        for k, slot in enumerate(slots, 1):
            total = total * np.uint32(0x01000193) + letters[np.clip(place(k), 0, max(0, len(letters) - 1))]
            found[:, slot] = (total * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
            there[:, slot] = lengths > k
    return found, there


def pieces(blob: bytes) -> np.ndarray:
    """Hashes of all three bytes in a row."""
    b = np.frombuffer(blob, dtype=np.uint8).astype(np.uint32)
    h = (b[:-2] * np.uint32(0x10001) + b[1:-1] * np.uint32(0x101) + b[2:]) * np.uint32(0x9E3779B1)
    return (h >> np.uint32(32 - BITS)).astype(np.int64)


def word_pieces(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of three bytes of each word between two marks, one word after another, and where each word's begin."""
    marked = [b"\x02" + w.encode("utf-8", "surrogatepass") + b"\x03" for w in words]
    lengths = np.fromiter(map(len, marked), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths)
    inside = np.ones(int(ends[-1]), dtype=bool)
    inside[ends - 1] = False
    inside[ends - 2] = False
    return pieces(b"".join(marked))[inside[:-2]], np.cumsum(lengths - 2) - (lengths - 2)


class Layout:
    """Sequences (lengths over 0, concatenated) by position, in blocks."""

    def __init__(self, lengths: np.ndarray, limit: int = BLOCK_TOKENS):
        self.order = np.argsort(-lengths, kind="stable")
        ordered = lengths[self.order]
        self.first = (np.cumsum(lengths) - lengths)[self.order]
        longest = int(ordered[0]) if len(lengths) else 0
        self.running = np.searchsorted(-ordered, -np.arange(longest), side="left")
        cuts = np.nonzero(np.diff(np.cumsum(self.running) // limit))[0] + 1
        self.edges = [0, *cuts.tolist(), longest] if longest else [0]

    def __len__(self) -> int:
        return len(self.edges) - 1

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a block: sequences at each of its positions, where each position begins, and each token's sequence (by
        falling length) and place among all tokens."""
        a, b = self.edges[i : i + 2]
        running = self.running[a:b]
        begins = np.cumsum(running) - running
        sequence = np.arange(int(running.sum())) - np.repeat(begins, running)
        return running, begins, sequence, self.first[sequence] + np.repeat(np.arange(a, b), running)


def forward(emit: np.ndarray, running: np.ndarray, begins: np.ndarray, move: np.ndarray, held: np.ndarray | None, begin: np.ndarray):
    """Scaled forward values (labels by tokens) and scales over a block; ``held`` are the values before it."""
    alpha, scale = emit.copy(), np.empty(emit.shape[1], dtype=emit.dtype)
    back = move.T.copy()
    for n, o in zip(running.tolist(), begins.tolist()):
        now = alpha[:, o : o + n]
        now *= begin[:, None] if held is None else back @ held[:, :n]
        total = np.add.reduce(now, axis=0, out=scale[o : o + n])
        now /= total
        held = now
    return alpha, scale, held


def emissions(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores (rows by labels) out of log space, as labels by rows, the largest of each row as 1, and the logarithms
    that this takes out."""
    top = scores.max(axis=1)
    return np.exp(scores - top[:, None]).T.copy(), top


def log_totals(emit: np.ndarray, top: np.ndarray, rows: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The log partition function of each sequence; ``emit`` and ``top`` are ``emissions``, ``rows`` each token's row."""
    layout = Layout(lengths)
    out, held = np.zeros(len(lengths)), None
    move, begin = np.exp(transitions), np.exp(begin)
    for i in range(len(layout)):
        running, begins, sequence, at = layout.block(i)
        own = rows[at]
        _, scale, held = forward(emit.take(own, axis=1), running, begins, move, held, begin)
        held = held.copy()
        out += np.bincount(layout.order[sequence], np.log(scale) + top[own], len(out))
    return out


def marginal_blocks(emit: np.ndarray, rows: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, begin: np.ndarray, totals: list[float] | None = None) -> Iterator[tuple]:
    """For each block, the last one first: places of its tokens, their marginals (labels by tokens), and summed pair
    marginals. ``totals`` gets each block's sum of log scales, the likelihood but for what ``emissions`` took out.

    The forward pass keeps the state before each block; a block's values are worked out again on the way back."""
    layout = Layout(lengths)
    move, begin = np.exp(transitions), np.exp(begin)
    held: list[np.ndarray | None] = [None]
    last: tuple = ()
    for i in range(len(layout)):
        running, begins, _, at = layout.block(i)
        now = emit.take(rows[at], axis=1)
        last = (now, *forward(now, running, begins, move, held[-1], begin))
        held.append(last[3].copy())
        if totals is not None:
            totals.append(float(np.log(last[2]).sum(dtype=np.float64)))
    back = None
    for i in range(len(layout) - 1, -1, -1):
        running, begins, sequence, at = layout.block(i)
        if i < len(layout) - 1:
            now = emit.take(rows[at], axis=1)
            last = (now, *forward(now, running, begins, move, held[i], begin))
        ahead, alpha, scale, _ = last
        ahead /= scale
        beta = np.ones_like(ahead)
        for n, o in zip(running[::-1].tolist(), begins[::-1].tolist()):
            if back is not None:
                m = back.shape[1]
                beta[:, o : o + m] = move @ back
                ahead[:, o : o + m] *= beta[:, o : o + m]
            back = ahead[:, o : o + n]
        back = back.copy()
        pairs = np.zeros_like(move, dtype=np.float64)
        if len(running) > 1:
            later = int(begins[1])
            before = np.repeat(begins[:-1], running[1:]) + sequence[later:]
            pairs += alpha.take(before, axis=1) @ ahead[:, later:].T
        if held[i] is not None:
            pairs += held[i][:, : running[0]] @ ahead[:, : running[0]].T
        alpha *= beta
        alpha /= alpha.sum(axis=0)
        yield at, alpha, pairs * move


def marginals(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's label marginals (tokens by labels), and the summed pair marginals."""
    out, pairs = np.empty_like(scores), np.zeros(transitions.shape)
    for at, found, both in marginal_blocks(emissions(scores)[0], np.arange(len(scores)), lengths, transitions, begin):
        out[at] = found.T
        pairs += both
    return out, pairs


class Numbers(dict):
    """Numbers of words in the order in which they were first asked for."""

    def __init__(self):
        self.pending: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.pending.append(word)
        return n


class Crf:
    """Weights (features by labels), transitions (labels by labels) and begin scores."""

    def __init__(self, labels: list, weights: np.ndarray, transitions: np.ndarray, begin: np.ndarray):
        self.labels, self.weights, self.transitions, self.begin = labels, weights, transitions, begin
        self.forget()

    def __getstate__(self):
        return {"labels": self.labels, "weights": self.weights, "transitions": self.transitions, "begin": self.begin}

    def __setstate__(self, state):
        self.__init__(**state)

    def forget(self) -> None:
        self.numbers, self.scores, self.scored = Numbers(), np.empty((1024, len(self.labels)), dtype=np.float32), 0

    def word_scores(self, words: list[str]) -> np.ndarray:
        found, there = affixes(words)
        grams, starts = word_pieces(words)
        out = np.add.reduceat(self.weights[grams], starts, axis=0)
        for slot in range(found.shape[1]):
            out += self.weights[found[:, slot]] * there[:, slot, None]
        return out

    def long_word_scores(self, word: str) -> np.ndarray:
        found, there = affixes([word])
        total = self.weights[found[there]].sum(axis=0)
        blob = b"\x02" + word.encode("utf-8", "surrogatepass") + b"\x03"
        for i in range(0, len(blob) - 2, FEATURE_BYTES):
            total += self.weights[pieces(blob[i : i + FEATURE_BYTES + 2])].sum(axis=0)
        return total[None]

    def settle(self) -> None:
        """Scores the words that have a number but no scores."""
        pending, self.numbers.pending = self.numbers.pending, []
        part, size = [], 0
        for i, w in enumerate(pending, 1):
            if 4 * len(w) > FEATURE_BYTES:
                found = [self.word_scores(part)] * bool(part) + [self.long_word_scores(w)]
                part, size = [], 0
            else:
                part.append(w)
                size += 4 * len(w) + 40
                if size < FEATURE_BYTES and i < len(pending):
                    continue
                found, part, size = [self.word_scores(part)], [], 0
            for rows in found:
                end = self.scored + len(rows)
                if end > len(self.scores):
                    self.scores = np.concatenate([self.scores[: self.scored], np.empty((end, len(self.labels)), dtype=np.float32)])
                self.scores[self.scored : end] = rows
                self.scored = end

    def tagged(self, texts: Iterable[str | None], limit: int = SLICE_TOKENS) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """For some texts at a time: their numbers among ``texts``, the label marginals of their words one after another,
        and where each text's begin. Texts without a word are left out."""
        held: list[np.ndarray] = []  # numbers of words, or scores of words that are forgotten
        which, lengths = [], []

        def looked_up() -> list[np.ndarray]:
            self.settle()
            return [x if x.ndim == 2 else self.scores[x] for x in held]

        def found() -> tuple[list[int], np.ndarray, np.ndarray]:
            n = np.array(lengths, dtype=np.int64)
            if all(x.ndim == 1 for x in held):
                self.settle()
                table, rows = self.scores[: self.scored], np.concatenate(held)
            else:
                table = np.concatenate(looked_up())
                rows = np.arange(len(table))
            out = np.empty((len(rows), len(self.labels)), dtype=np.float32)
            for at, p, _ in marginal_blocks(emissions(table)[0], rows, n, self.transitions, self.begin):
                out[at] = p.T
            return which, out, np.cumsum(n) - n

        tokens = 0
        for i, text in enumerate(texts):
            n = 0
            for words in word_lists(text):
                if words:
                    held.append(np.fromiter(map(self.numbers.__getitem__, words), dtype=np.int32, count=len(words)))
                    n += len(words)
                    if len(self.numbers) > WORDS_KEPT:
                        held = looked_up()
                        self.forget()
            if n:
                which.append(i)
                lengths.append(n)
                tokens += n
            if tokens >= limit:
                yield found()
                held, which, lengths, tokens = [], [], [], 0
        if which:
            yield found()


def fit(sequences: list[tuple[list[str], list[int]]], labels: list, steps: int = 60, rate: float = 0.15, decay: float = 1e-6, weight: list[float] | None = None) -> Crf:
    """Maximum conditional likelihood by Adam over all the given sequences (words, label numbers; none empty), each
    counted as often as its weight says."""
    k = len(labels)
    weight = weight or [1.0] * len(sequences)
    by_weight = sorted(range(len(sequences)), key=lambda i: weight[i])
    sequences, weight = [sequences[i] for i in by_weight], np.array([weight[i] for i in by_weight])
    number = {w: i for i, w in enumerate(dict.fromkeys(w for ws, _ in sequences for w in ws))}
    found, there = affixes(list(number))
    grams, starts = word_pieces(list(number))
    flat = np.concatenate([found[there], grams])
    owner = np.concatenate([np.nonzero(there)[0], np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(grams))))])
    del found, there
    tokens = np.array([number[w] for ws, _ in sequences for w in ws], dtype=np.int64)
    gold = np.array([y for _, ys in sequences for y in ys], dtype=np.int64)
    lengths = np.array([len(ws) for ws, _ in sequences], dtype=np.int64)
    each = np.repeat(weight, lengths)  # by token
    truth = np.zeros((len(tokens), k), dtype=np.float32)
    truth[np.arange(len(tokens)), gold] = 1
    firsts = np.cumsum(lengths) - lengths
    inner = np.ones(len(tokens), dtype=bool)
    inner[firsts] = False
    gold_pairs = np.zeros((k, k))
    np.add.at(gold_pairs, (gold[:-1][inner[1:]], gold[1:][inner[1:]]), each[1:][inner[1:]])
    n, n_first = each.sum(), weight.sum()
    cuts = [0, *(np.nonzero(np.diff(weight))[0] + 1).tolist(), len(weight)]  # sequences of one weight go together
    token_cuts = np.append(firsts, len(tokens))[cuts]

    weights, transitions, begin = (np.zeros(s, dtype=np.float32) for s in ((1 << BITS, k), (k, k), (k,)))
    parameters = [weights, transitions, begin]
    mean, spread = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    for step in range(1, steps + 1):
        model = Crf(labels, weights, transitions, begin)
        word_scores = model.word_scores(list(number))
        gap, pairs = truth.copy(), np.zeros((k, k))
        for i, (a, b) in enumerate(zip(token_cuts, token_cuts[1:])):
            found, both = marginals(word_scores[tokens[a:b]], lengths[cuts[i] : cuts[i + 1]], transitions, begin)
            gap[a:b] -= found
            pairs += weight[cuts[i]] * both
        gap *= each[:, None]
        by_word = np.stack([np.bincount(tokens, gap[:, j], len(number)) for j in range(k)], axis=1)
        gradient = np.stack([np.bincount(flat, by_word[owner, j], 1 << BITS) for j in range(k)], axis=1)
        gradients = [gradient / n - decay * weights, (gold_pairs - pairs) / n - decay * transitions, gap[firsts].sum(axis=0) / n_first - decay * begin]
        for p, g, m, v in zip(parameters, gradients, mean, spread):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Crf(labels, weights, transitions, begin)
