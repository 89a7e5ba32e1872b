"""Problem 1: statistics of each document's own text, and prose told from lists, tables, junk.

Method: gradient-boosted trees on document statistics. The statistics are taken over the
page without its furniture (problem 5), garbled lines read as restored (problem 9): counts,
word lengths, symbol ratio, line endings, common words, repetition, columns, and the share
of neighbouring words that are usual neighbours. Labelling rules that only speak where they
are sure give weak labels to a sample of the documents (at most ``sample_rows``, drawn by a
hash of the id; a documented bound); the trees are fitted on these, and their probabilities
are calibrated by a temperature on a holdout that was checked by hand (every second text of
``holdout.jsonl``; the others are fitted with the weak labels).
Which words are usual neighbours is counted over all documents (``neighbours``): a pair is
usual where at least two different texts have it and it is seen more often than its words
would meet by chance, a measure that does not change with the size of the corpus.

A first pass counts the pairs (a table of fixed size leaves each task), the sample is drawn
by id and written once, and a last pass takes every page apart and judges it. The driver
receives the sample's statistics and the counts of ``2**NEIGHBOUR_BITS`` hashed pairs.

Defined results: null, empty and blank texts, and pages of nothing but furniture, have no
kind and zero counts; a text whose loss cannot be restored is prose when its shape is; tables
that give no weak labels for a class are left with the checked texts; repeated rows
come out as often as they went in; an empty table gives an empty table; further columns and
``lang`` do not change the kind.
"""

from __future__ import annotations

import json
import math
import re
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.arrow import map_batches
from weirflow.llm.boosting import BoostedTrees
from weirflow.llm.garbled import Garbled, finder, read_samples
from weirflow.llm.page_body import furniture, page_lines
from weirflow.session import keep_table, ship

KINDS = ("prose", "list", "table", "junk")
NEIGHBOUR_BITS = 21
WORD_BITS = 16
CHUNK_BITS = 15
BY_CHANCE = 1.5
SAMPLE_ROWS = 4_000
FEATURES = (
    "n_chars", "n_lines", "n_words", "mean_word", "max_word", "mean_line", "long_lines", "symbol_ratio", "digit_ratio", "upper_ratio", "space_ratio",
    "ends_stop", "ends_comma", "stop_density", "marked_lines", "short_lines", "cell_lines", "same_cells", "cells_mean", "number_cells", "segment_words", "long_segments",
    "sentences", "common_words", "usual_pairs", "pairs", "distinct_words", "distinct_pairs", "rare_han", "odd_words", "vowel_words", "lost_ratio", "code_ratio", "hex_ratio", "leader_lines", "same_lines", "inner_symbols", "stamp_lines", "shape_share", "mixed_words", "segments", "shape_numbers", "garbled",
)
USUAL = FEATURES.index("usual_pairs")

_CJK = re.compile("[぀-ヿ㐀-鿿]")
_HAN = re.compile("[㐀-鿿]")
_MARK = re.compile(r"(?:[-•*»→›▸·–‣◦■□▪]\s|\(?\d{1,3}[.)）、]|[①-⑳]|\[[ x]\]|[(（]?[a-zA-Z][.)]\s)")
_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()\-–—。，；：！？、“”‘’«»（）…·]")
_HEX = re.compile(r"\b(?:0x)?(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{2,8}\b")
_CODE = re.compile(r"[{}=;\[\]<>_\\|^~#*@]")
_INNER = re.compile(r"[^\W\d_][{}~^#*\\|<>=_`§¬¦;:/@$%&+](?=[^\W\d_])")
_STAMP = re.compile(r"\[?\d{4}-\d\d-\d\d[ T]\d\d:\d\d")
_MIXED = re.compile(r"(?:[a-z][A-Z0-9]|[0-9][a-zA-Z]|[A-Z]{2}[a-z])")
_VOWEL = re.compile("[aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýœаеёиоуыэюя]")


LETTER, CJK, DIGIT, UPPER, SYMBOL, CODE, SPACE, RARE, HAN, STOP, SEPARATOR, VOWEL, QUOTE, COMMA, CELL = (1 << i for i in range(15))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Classes and small letters of the code points below 65536."""
    flags, small = np.zeros(65536, np.uint16), np.arange(65536, dtype=np.int64)
    usual = _usual()
    for i in range(65536):
        if 0xD800 <= i < 0xE000:
            continue
        c = chr(i)
        f = 0
        if _CJK.match(c):
            f |= CJK | (HAN if _HAN.match(c) else 0) | (RARE if _HAN.match(c) and c not in usual else 0)
        elif c.isalpha():
            f |= LETTER | (UPPER if c.isupper() else 0) | (VOWEL if _VOWEL.match(c.lower()) else 0)
            if len(c.lower()) == 1:
                small[i] = ord(c.lower())
        elif c.isdigit():
            f |= DIGIT
        elif c.isspace():
            f |= SPACE
        f |= (SYMBOL if _SYMBOL.match(c) else 0) | (CODE if _CODE.match(c) else 0) | (STOP if c in ".!?。！？…" else 0)
        f |= (SEPARATOR if c in "\n\t,;:|/、，；：·•()（）" else 0) | (QUOTE if c in "”\"』」»)）’" else 0) | (COMMA if c in ",，;；、:：" else 0) | (CELL if c in "\t|;，；\n" else 0)
        flags[i] = f
    return flags, small


def _runs(values: np.ndarray) -> np.ndarray:
    """Sizes of the groups of equal values."""
    v = np.sort(values)
    edges = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1], [True]))) if len(v) else np.zeros(1, np.int64)
    return edges[1:] - edges[:-1]


class _Page:
    """A text as arrays: code points, their classes, and where words start."""

    def __init__(self, text: str):
        table, small = _tables()
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.codes = np.minimum(codes, 65535)
        self.flags = f = table[self.codes]
        letter = (f & LETTER) != 0
        self.cjk = (f & CJK) != 0
        begin = self.cjk | letter
        begin[1:] &= self.cjk[1:] | ~letter[:-1]
        self.starts = np.flatnonzero(begin)
        # hash of a word: the sum over its letters of a mix of letter and place
        inside = self.cjk | letter
        place = np.arange(len(codes))
        if len(self.starts):
            sizes = np.empty_like(self.starts)
            sizes[:-1] = self.starts[1:] - self.starts[:-1]
            sizes[-1] = len(codes) - self.starts[-1]
            place[self.starts[0]:] -= np.repeat(self.starts, sizes)
        mixed = (small[self.codes] + 1 + 65_537 * place.astype(np.int64)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed = np.where(inside, mixed ^ (mixed >> np.uint64(31)), np.uint64(0))
        if len(self.starts):
            self.words = np.add.reduceat(mixed, self.starts)
            self.lengths = np.add.reduceat(inside.astype(np.int64), self.starts)
        else:
            self.words, self.lengths = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def pairs(self) -> np.ndarray:
        """Neighbouring words as one number each, stable across processes: the hash of the
        pair, and of its first and its second word."""
        h = self.words
        if len(h) < 2:
            return np.zeros(0, np.int64)
        pair = (h[:-1] * np.uint64(1_000_003) + h[1:]) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - NEIGHBOUR_BITS)
        word = h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - WORD_BITS)
        return ((pair << np.uint64(2 * WORD_BITS)) | (word[:-1] << np.uint64(WORD_BITS)) | word[1:]).astype(np.int64)


def body_lines(text: str | None, g: Garbled) -> tuple[list[str], int]:
    """The page's own non-blank lines, restored, and how many lines were garbled."""
    if not text or not text.strip():
        return [], 0
    lines, hit = page_lines(text, g)
    bad = furniture(lines)
    own = [(x, h) for x, b, h in zip(lines, bad, hit) if x and not b]
    return [x for x, _ in own], sum(h for _, h in own)


class Neighbours:
    """How often words stand next to each other: for each hashed pair the number of texts
    that have it, for each hashed word how often it is the first or the second of a pair,
    as logarithms in eighths (a byte each)."""

    def __init__(self, pairs: np.ndarray, first: np.ndarray, second: np.ndarray):
        n = np.concatenate((pairs, first, second)).astype(np.float64)
        n = np.where(n > 0, np.rint(8 * np.log2(np.maximum(1, n))), 0).astype(np.uint8)
        self.pairs, self.first, self.second = np.split(n, [len(pairs), len(pairs) + len(first)])
        self.level = 8 * math.log2(BY_CHANCE / max(1.0, float(first.sum())))

    def share(self, pairs: np.ndarray) -> float:
        """Share of the pairs of a page that are usual."""
        if not len(pairs):
            return 0.0
        n = self.pairs[pairs >> 2 * WORD_BITS].astype(np.int32)
        by_chance = self.first[pairs >> WORD_BITS & (1 << WORD_BITS) - 1].astype(np.int32) + self.second[pairs & (1 << WORD_BITS) - 1]
        return float(np.count_nonzero((n >= 8) & (n >= by_chance + self.level))) / len(pairs)


def statistics(body: list[str], known: Neighbours, garbled: int = 0) -> list[float]:
    """The values of FEATURES over a page's own lines; ``garbled``: how many of the lines
    were garbled."""
    values, pairs = measured(body, garbled)
    values[USUAL] = known.share(pairs)
    return values


def measured(body: list[str], garbled: int = 0) -> tuple[list[float], np.ndarray]:
    """The values of FEATURES, without the share of usual pairs, and the pairs of the page."""
    text = "\n".join(body)
    page = _Page(text)
    f, codes, starts = page.flags, page.codes, page.starts
    size = len(f)
    n, lines, n_words = max(1, size), max(1, len(body)), max(1, len(starts))
    share = lambda hits, of: float(hits) / max(1, of)
    count = lambda bit: int(np.count_nonzero(f & bit))
    spelt = ~page.cjk[starts] if size else np.zeros(0, bool)
    lengths = page.lengths[spelt]
    latin = len(lengths)
    vowels = int(np.count_nonzero(np.add.reduceat((f & VOWEL).astype(np.int64), starts)[spelt])) if latin else 0
    counts = np.sort(_runs(page.words))
    pairs = page.pairs()
    boxes = text.count("[ ]") + text.count("[x]")
    # lines
    widths = np.array([len(x) for x in body], dtype=np.int64)
    ends = np.cumsum(widths + 1) - 1
    stop = (f & STOP) != 0
    last = np.maximum(ends - 1, 0)
    for _ in range(3):
        if not size:
            break
        closing = (f[last] & (QUOTE | SPACE)) != 0
        if not closing.any():
            break
        last = np.maximum(last - closing, 0)
    tail = last
    digit = (f & DIGIT) != 0
    stops = int(np.count_nonzero(stop[tail] & ~digit[np.maximum(tail - 1, 0)])) if size else 0
    commas = int(np.count_nonzero(f[tail] & COMMA)) if size else 0
    marks = sum(_MARK.match(x) is not None for x in body)
    leaders = sum("...." in x for x in body)
    stamps = sum(x[:5].strip("[").isdigit() and _STAMP.match(x) is not None for x in body)
    # cells of the lines that are no paragraphs
    space = codes == 32
    following, wide = np.zeros_like(f), np.zeros_like(space)
    following[:-1] = f[1:]
    wide[:-1] = space[:-1] & space[1:]
    cut = ((f & CELL) != 0) | wide | (codes == 44) & ((following & SPACE) == 0) if size else np.zeros(0, bool)
    cuts = np.flatnonzero(cut)
    filled = ((f & SPACE) == 0) & ~cut if size else np.zeros(0, bool)
    total = lambda mask: np.diff(np.concatenate(([0], np.concatenate(([0], np.cumsum(mask)))[np.append(cuts, size)])))
    used = total(filled) > 0
    wordy = total((f & (LETTER | CJK)) != 0) > 0
    row_of = np.searchsorted(ends, np.append(cuts, size) - 1) if size else np.zeros(0, np.int64)
    row_of = np.minimum(row_of, lines - 1)
    cells = np.bincount(row_of[used], minlength=lines) if size else np.zeros(lines, np.int64)
    # A long line is a row only if sentences do not end in it.
    full = stop & (((following & (SPACE | QUOTE)) != 0) | (codes > 0x2000))
    if size:
        full[-1] = stop[-1]
    open_rows = np.ones(lines, bool)
    if len(body):
        open_rows = (widths < 200) | (4 * np.bincount(np.searchsorted(ends, np.flatnonzero(full)), minlength=lines)[:lines] <= cells)
    cells = np.where(open_rows, cells, 1) if len(body) else cells
    tabled = (cells >= 2) & open_rows
    in_table = used & tabled[row_of] if size else used
    numbers = int(np.count_nonzero(in_table & ~wordy))
    alike = np.bincount(cells[tabled]).max(initial=0) if tabled.any() else 0
    # numbers in the lines
    began = digit & ~np.concatenate(([False], digit[:-1])) if size else digit
    per_line = np.bincount(np.searchsorted(ends, np.flatnonzero(began)), minlength=lines)[:lines]
    per_line = per_line[open_rows]
    kinds = np.bincount(per_line[per_line > 0]) if (per_line > 0).any() else np.zeros(1, np.int64)
    usual_numbers = int(kinds.argmax())
    # pieces between separators, and sentences
    dots = np.zeros_like(space)
    dots[1:] = (codes[1:] == 46) & (codes[:-1] == 46)
    gaps = np.zeros_like(space)
    gaps[1:-1] = space[1:-1] & page.cjk[:-2] & page.cjk[2:]
    # words up to each word; two characters of Chinese or Japanese are one
    upto = np.concatenate(([0.0], np.cumsum(np.where(page.cjk[starts], 0.5, 1.0))))

    def pieces(cuts: np.ndarray) -> np.ndarray:
        at = upto[np.searchsorted(starts, np.append(cuts, size))]
        at[1:] -= at[:-1].copy()
        return at

    apart = np.flatnonzero(((f & SEPARATOR) != 0) | full | dots | gaps | wide)
    segments = pieces(apart)
    segments = segments[segments > 0]
    parts = np.flatnonzero(full)
    told = pieces(parts)[:-1]
    sentences = int(np.count_nonzero((told >= 3) & (told <= 120)))
    of_segments = float(segments.sum())
    digits, symbols, code, capitals = count(DIGIT), count(SYMBOL) - 2 * boxes, count(CODE) - 2 * boxes, count(UPPER)
    return [
        math.log1p(size), math.log1p(len(body)), math.log1p(len(starts)), share(lengths.sum(), latin), math.log1p(int(lengths.max(initial=0))), math.log1p(n / lines), share(np.count_nonzero(widths > 60), lines),
        share(symbols, n), share(digits, n), share(capitals, n), share(np.count_nonzero(space), n),
        share(stops, lines), share(commas, lines), share(len(parts), n_words), share(marks, lines), share(np.count_nonzero(widths < 40), lines),
        share(np.count_nonzero(tabled), lines), share(alike, lines), share(cells.sum(), lines), share(numbers, np.count_nonzero(in_table)), share(of_segments, len(segments)), share(segments[segments >= 9].sum(), of_segments),
        share(sentences * 12, n_words), share(counts[-8:].sum(), n_words), 0.0, math.log1p(len(pairs)), share(len(counts), n_words), share(len(_runs(pairs)), len(pairs)),
        share(count(RARE), n), share(np.count_nonzero(lengths > 14), latin), share(vowels, latin), share(sum(map(text.count, "�锟斤拷")), n), share(code, n), share(sum(map(len, _HEX.findall(text))), n) if digits * 8 > n else 0.0,
        share(leaders, lines), share(lines - len(set(body)), lines),
        share(len(_INNER.findall(text)), n_words) if code * 50 > n else 0.0, share(stamps, lines), share(kinds.max(initial=0) if usual_numbers else 0, lines), share(len(_MIXED.findall(text)), n_words) if capitals * 20 > n else 0.0, math.log1p(len(segments)), float(usual_numbers), share(garbled, lines),
    ], pairs


def _usual() -> frozenset[str]:
    from weirflow.llm.garbled import usual_han

    return usual_han()


def weak_label(s: dict[str, float], prose: float = 1.0) -> int:
    """Index in KINDS, or -1 where no rule is sure. ``prose``: the share of usual pairs that
    plain sentences have in this corpus, which is less in a small one."""
    usual = s["usual_pairs"] / max(prose, 1e-6)
    few = s["ends_stop"] < 0.1 and s["sentences"] < 0.1
    if s["lost_ratio"] > 0.02 or s["garbled"] > 0.3:
        return 0 if s["ends_stop"] > 0.3 or s["mean_line"] > math.log1p(40) else -1
    if s["shape_share"] > 0.6 and s["shape_numbers"] >= 3 and s["ends_stop"] < 0.1 and s["stamp_lines"] < 0.5 and s["hex_ratio"] <= 0.1 and s["n_lines"] >= math.log1p(3):
        return 2
    if s["stamp_lines"] > 0.5 or s["hex_ratio"] > 0.1:
        return 3
    if s["n_words"] < math.log1p(2) and s["n_chars"] > math.log1p(20) or s["symbol_ratio"] > 0.25 and few and s["same_cells"] < 0.5:
        return 3
    if s["code_ratio"] > 0.05 and s["inner_symbols"] > 0.05 and s["cell_lines"] < 0.5 or s["code_ratio"] > 0.08 and s["cell_lines"] < 0.5 and few:
        return 3
    if s["rare_han"] > 0.3 or s["mixed_words"] > 0.5 and s["space_ratio"] < 0.03 and s["rare_han"] == 0 and s["upper_ratio"] > 0.2:
        return 3
    if s["distinct_pairs"] < 0.15 and s["n_chars"] > math.log1p(200) and s["distinct_words"] < 0.15 and s["number_cells"] < 0.2 and s["leader_lines"] < 0.3 and s["ends_stop"] < 0.3:
        return 3
    if s["vowel_words"] < 0.75 and s["n_words"] > math.log1p(15) and usual < 0.5 and s["digit_ratio"] < 0.1 and s["mean_word"] > 2:
        return 3
    if s["pairs"] > math.log1p(25) and usual < 0.65 and s["digit_ratio"] < 0.1 and s["long_segments"] > 0.8 and s["mean_line"] > math.log1p(40) and s["ends_stop"] < 0.5:
        return 3
    if s["n_lines"] >= math.log1p(3) and few and s["leader_lines"] < 0.3 and (s["same_cells"] > 0.75 and s["number_cells"] > 0.3 and s["cells_mean"] >= 2):
        return 2
    if usual > 0.85 and (s["ends_stop"] > 0.5 and s["sentences"] > 0.4 or s["long_segments"] > 0.8 and usual > 0.9 and s["distinct_words"] > 0.2 or s["sentences"] > 0.5):
        return 0
    if few and s["leader_lines"] > 0.6 or few and s["marked_lines"] > 0.7 and s["short_lines"] > 0.7:
        return 1
    if few and s["digit_ratio"] < 0.2 and s["number_cells"] < 0.3 and s["same_lines"] < 0.5 and s["code_ratio"] < 0.05 and s["segments"] >= math.log1p(5) and s["segment_words"] < 6 and s["distinct_pairs"] > 0.2 and s["vowel_words"] * (s["mean_word"] > 0) >= 0.75 * (s["mean_word"] > 0):
        return 1
    return -1


def holdout() -> list[dict]:
    """Texts and kinds that were checked by hand."""
    lines = (Path(__file__).parent / "holdout.jsonl").read_text(encoding="utf-8").splitlines()
    return [json.loads(x) for x in lines if x.strip()]


class ProseModel:
    """The fitted trees and the usual neighbours."""

    def __init__(self, trees: BoostedTrees, known: Neighbours):
        self.trees, self.known = trees, known

    def kinds(self, bodies: list[tuple[list[str], int]]) -> tuple[np.ndarray, np.ndarray]:
        """Statistics and class probabilities of pages given by ``body_lines``."""
        x = np.array([statistics(b, self.known, n) for b, n in bodies], dtype=np.float64).reshape(len(bodies), len(FEATURES))
        return x, self.trees.probabilities(x) if len(bodies) else np.zeros((0, len(KINDS)))


def distinct_pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of words of each text, once a text, and the text they are of."""
    page = _Page("\n".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    of = np.searchsorted(ends, page.starts, side="right")
    pairs = page.pairs()
    inside = of[:-1] == of[1:] if len(of) else np.zeros(0, bool)
    bits = NEIGHBOUR_BITS + 2 * WORD_BITS
    key = (of[:-1][inside].astype(np.int64) << bits) | pairs[inside]
    key.sort()
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    return key & ((1 << bits) - 1), key >> bits


def neighbours(documents: DataFrame) -> Neighbours:
    """The usual neighbours of all documents' texts. Copies of one text make no pair usual:
    the least and the greatest hash of the texts that have a pair have to differ. Each task
    gives one table of fixed size, in chunks, and the chunks are summed on the executors."""
    slots, words, chunk = 1 << NEIGHBOUR_BITS, 1 << WORD_BITS, 1 << CHUNK_BITS
    size = slots + 2 * words

    def count(batches):
        n, lo, hi = np.zeros(size, np.int64), np.full(slots, np.iinfo(np.int32).max, np.int32), np.full(slots, np.iinfo(np.int32).min, np.int32)
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                fresh = {h: t for h, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if h not in seen}
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.update(fresh)
                pairs, of = distinct_pairs(list(fresh.values()))
                p = pairs >> 2 * WORD_BITS
                h = np.fromiter(fresh, dtype=np.int64, count=len(fresh)).astype(np.int32)[of]
                np.add.at(n, p, 1)
                np.add.at(n, slots + (pairs >> WORD_BITS & words - 1), 1)
                np.add.at(n, slots + words + (pairs & words - 1), 1)
                np.minimum.at(lo, p, h)
                np.maximum.at(hi, p, h)
        if not n.any():
            return
        for c in range(size >> CHUNK_BITS):
            at = slice(c << CHUNK_BITS, (c + 1) << CHUNK_BITS)
            bounds = lo[at].tobytes() + hi[at].tobytes() if c < slots >> CHUNK_BITS else b""
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([n[at].tobytes() + bounds], pa.binary())], ["chunk", "data"])

    def add(batches):
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for c, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, rest = np.frombuffer(data[:8 * chunk], np.int64), np.frombuffer(data[8 * chunk:], np.int32)
                if c not in sums:
                    sums[c] = [n.copy(), rest[:chunk].copy(), rest[chunk:].copy()]
                    continue
                sums[c][0] += n
                np.minimum(sums[c][1], rest[:chunk], out=sums[c][1])
                np.maximum(sums[c][2], rest[chunk:], out=sums[c][2])
        for c, (n, lo, hi) in sums.items():
            n = np.where(lo != hi, n, 0) if len(lo) else n
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([n.astype(np.float32).tobytes()], pa.binary())], ["chunk", "data"])

    ship(documents.sparkSession)
    tables = documents.where("text is not null").select(F.xxhash64("text").alias("h"), "text").mapInArrow(count, "chunk int, data binary")
    counts = np.zeros(size, np.float32)
    for row in tables.repartition(16, "chunk").mapInArrow(add, "chunk int, data binary").collect():
        counts[row["chunk"] << CHUNK_BITS:(row["chunk"] + 1) << CHUNK_BITS] = np.frombuffer(row["data"], np.float32)
    return Neighbours(*np.split(counts, [slots, slots + words]))


def drawn(documents: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, lang, text`` of at most ``rows`` documents, drawn by a hash of the id and
    written once. The ids are drawn first, so that no text is sorted or gathered."""
    ids = documents.select(F.col("doc_id").alias("__id"), F.xxhash64("doc_id", F.lit(17)).alias("__k")).orderBy("__k", "__id").limit(rows).select("__id").distinct()
    texts = documents.join(F.broadcast(ids), documents["doc_id"] == F.col("__id"), "left_semi").select("doc_id", "lang", "text")
    return keep_table(texts.repartition(16), "drawn-documents")


def fit(documents: DataFrame, samples: tuple[str, ...], sample_rows: int = SAMPLE_ROWS) -> ProseModel:
    """Fits the model on weak labels of at most ``sample_rows`` documents; the usual pairs of
    words are those of all documents."""
    known = neighbours(documents)
    sent = documents.sparkSession.sparkContext.broadcast(known)

    def describe(batch: pa.RecordBatch):
        g = finder(samples)
        bodies = [b for t in batch.column(0).to_pylist() if (b := body_lines(t, g))[0]]
        yield pa.RecordBatch.from_arrays([pa.array([statistics(b, sent.value, n) for b, n in bodies], type=pa.list_(pa.float64()))], ["s"])

    told = map_batches(drawn(documents, sample_rows).select("text"), describe, "s array<double>").toArrow()
    return fit_trees(told.column("s").to_pylist(), known, samples)


def fit_trees(rows: list[list[float]], known: Neighbours, samples: tuple[str, ...]) -> ProseModel:
    """The trees, fitted on the statistics of sample pages; equal rows count once."""
    x = np.unique(np.array(rows, dtype=np.float64).reshape(-1, len(FEATURES)), axis=0)
    plain = x[(x[:, FEATURES.index("ends_stop")] > 0.5) & (x[:, FEATURES.index("sentences")] > 0.4), USUAL]
    level = float(np.median(plain)) if len(plain) else 1.0
    y = np.array([weak_label(dict(zip(FEATURES, v)), level) for v in x.tolist()], dtype=np.int64)
    x, y = x[y >= 0], y[y >= 0]
    order = np.lexsort((*x.T[::-1], y))
    x, y = x[order], y[order]
    g = finder(samples)
    checked = [(statistics(b[0], known, b[1]), KINDS.index(r["kind"])) for r in holdout() if (b := body_lines(r["text"], g))[0]]
    hx, hy = np.array([s for s, _ in checked]), np.array([k for _, k in checked])
    # Every second checked document calibrates; the others are fitted with the weak labels.
    extra = np.flatnonzero(np.arange(len(hy)) % 2 == 1)
    x, y = np.concatenate([x, hx[extra]]), np.concatenate([y, hy[extra]])
    each = np.maximum(1, np.bincount(y, minlength=len(KINDS)))
    weights = np.sqrt(len(y) / (len(KINDS) * each))[y]
    trees = BoostedTrees(len(KINDS)).fit(x, y, weights)
    own = np.arange(len(hy)) % 2 == 0
    return ProseModel(trees.calibrate(hx[own], hy[own]), known)


def text_statistics(documents: DataFrame, lang_samples: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: ``doc_id, lang``, the statistics, ``kind, confidence``."""
    samples = read_samples(lang_samples)
    model = fit(documents, samples, sample_rows)
    sent = documents.sparkSession.sparkContext.broadcast(model)
    shown = ("n_chars", "n_lines", "n_words", "mean_word", "symbol_ratio", "digit_ratio", "ends_stop", "common_words", "usual_pairs", "distinct_words", "marked_lines", "cell_lines")
    exact = {"n_chars", "n_lines", "n_words"}

    def describe(batch: pa.RecordBatch):
        g = finder(samples)
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            bodies = [body_lines(t, g) for t in part.column(2).to_pylist()]
            x, p = sent.value.kinds(bodies)
            full = np.array([bool(b) for b, _ in bodies])
            columns = []
            for name in shown:
                v = x[:, FEATURES.index(name)]
                v = np.where(full, v, 0.0)
                columns.append(pa.array(np.rint(np.expm1(v)).astype(np.int64)) if name in exact else pa.array(v))
            kind = [KINDS[k] if ok else None for k, ok in zip(p.argmax(axis=1), full)]
            sure = [float(c) if ok else None for c, ok in zip(p.max(axis=1), full)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns, pa.array(kind, type=pa.string()), pa.array(sure, type=pa.float64())], ["doc_id", "lang", *shown, "kind", "confidence"])

    schema = "doc_id bigint, lang string, " + ", ".join(f"{n} {'bigint' if n in exact else 'double'}" for n in shown) + ", kind string, confidence double"
    return map_batches(documents.select("doc_id", "lang", "text"), describe, schema)


def not_prose(documents: DataFrame, lang_samples: DataFrame) -> DataFrame:
    """``doc_id, kind`` of the documents whose own content is a list, a table or junk."""
    return text_statistics(documents, lang_samples).where("kind <> 'prose'").select("doc_id", "kind")
