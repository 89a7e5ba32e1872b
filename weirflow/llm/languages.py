"""Problem 3: the language of each document and of each segment in another language.

Method: string-kernel classification. Sentences are compared by the blended-spectrum
presence kernel, the number of character n-grams (n = 2..4) they share, normalised by the
sizes of both sets. The classifier is fitted on the sample sentences of each language (a
fixed table) and on sentences of a bounded sample of labelled documents (at most
``SAMPLE_ROWS``, drawn by a hash of the id, ``PER_PAGE`` sentences of each): a sentence that
several of them hold belongs to the language that most of their labels name, one that stands
alone to its document's language; a first classifier, fitted on the samples only, weighs in
on the former and has to agree to the latter. Of these, ``LANDMARKS`` a language are drawn so that they cover the usual
n-grams, and with them ``TRAINED`` are fitted on, the commonest first; the Nyström map
over the landmarks and one-versus-rest kernel ridge regression give a weight matrix over
landmarks, which the landmarks' own n-grams turn into one weight row per n-gram. Scoring a
batch of sentences is then one product of their sparse presence matrix with that weight
matrix; softmax with a temperature found by cross-validation gives the confidence. Han
characters are folded into one sign, and runs of more than four of them into four, which
leaves the presence sets as they are.

Documents are read as problem 9 restores them and without the furniture problem 5 finds.
Titles, list items and bracketed terms are no sentences. Adjoining sentences of one language
form a segment.

Defined results: null, empty and blank texts, texts without a whole sentence, and all texts
where there are no sample sentences, have no segment and a null language; a label that is null or not in the table of labels names none;
repeated rows come out as often as they went in; empty tables give empty results.
"""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.arrow import map_batches
from weirflow.llm.garbled import finder, read_samples
from weirflow.llm.page_body import _BULLET, _LOST, _lost_lines, below, page_lines, paths
from weirflow.llm.text_stats import KINDS, SAMPLE_ROWS, ProseModel, drawn, fit_trees, neighbours, statistics

ORDERS = (2, 3, 4)
LANDMARKS, TRAINED, PER_PAGE = 60, 250, 10
TABLE_BITS = 16
HASH_BITS = 40
BATCH, PRODUCT = 10_000, 4_000
SURE = 0.9
_BRACKETS = re.compile(r"\([^()]{0,80}\)|（[^（）]{0,80}）|\[[^\[\]]{0,40}\]")
_SPLIT = re.compile(r"[。！？][”」』）]*|[.!?…][”\"»’)]*\s+")
_HAN = re.compile("[㐀-鿿々]")
#: Runs of Han characters, longest first, and what they become until all are replaced.
_HANS = tuple((re.compile("[㐀-鿿々]{%s}" % n), "\ue000" * k) for n, k in (("4,", 4), ("3", 3), ("2", 2), ("1", 1)))
#: What is no small letter of ASCII, as a blank.
_BLANKS = {i: " " for i in range(128) if chr(i) != "\n" and not chr(i).islower()}
_RUNS = re.compile("  +")
_DIGITS = re.compile(r"[\d_]+")
_OTHER = re.compile(r"[^\w\n]+")
_MORE_THAN_ONE = (1).__lt__
_SIGNS = re.compile("[汉\u3040-\u30ff]")
_CLOSED = re.compile("[.!?。！？…][”\"』」»)）’]*\\s*[»”]?\\s*$")
_ENDS_COMMA = re.compile("[,，;；、:：]$")


def normalise(sentence: str) -> str:
    """What the kernel sees: small letters, one blank for anything else, folded Han. Lines
    stay apart."""
    s = sentence.lower()
    if not s.isascii():
        s = unicodedata.normalize("NFC", s)
        if _HAN.search(s):
            for run, signs in _HANS:
                s = run.sub(signs, s)
            s = s.replace("\ue000", "汉")
        return " " + _OTHER.sub(" ", _DIGITS.sub(" ", s)).strip(" ") + " "
    return " " + _RUNS.sub(" ", s.translate(_BLANKS)).strip(" ") + " "


def whole_sentences(found: list[str]) -> list[tuple[str, int]]:
    """(normalised sentence, characters) of those that are whole sentences and not lost: at
    least three words of two letters or more, or four Chinese or Japanese signs."""
    out = []
    text = "\n".join(found)
    lost = _LOST.search(text) is not None
    for s, normal in zip(found, normalise(text).split("\n")):
        if sum(map(_MORE_THAN_ONE, map(len, normal.split(" ")))) < 3 and (s.isascii() or sum(len(w) for w in normal.split(" ") if _SIGNS.search(w)) < 4):
            continue
        if not lost or len(_LOST.findall(s)) * 6 < len(s):
            out.append((f" {normal.strip(' ')} ", len(s)))
    return out


class KernelClassifier:
    """Nyström map over landmarks, one-versus-rest kernel ridge regression. ``rows``: language
    and normalised sentence; the first ``per_language`` of each language are its landmarks."""

    def __init__(self, rows: list[tuple[str, str]], per_language: int = LANDMARKS, ridge: float = 0.05):
        self.langs = sorted({lang for lang, _ in rows})
        y = np.array([self.langs.index(lang) for lang, _ in rows], dtype=np.int64)
        grams = [spectrum(t) for _, t in rows]
        marks = [i for k in range(len(self.langs)) for i in np.flatnonzero(y == k)[:per_language].tolist()]
        vocabulary = {g: i for i, g in enumerate(sorted(set().union(*(grams[i] for i in marks))))}
        presence = np.zeros((len(rows), len(vocabulary)), dtype=np.float32)
        for i, gs in enumerate(grams):
            presence[i, [vocabulary[g] for g in gs if g in vocabulary]] = 1 / math.sqrt(max(1, len(gs)))
        base = presence[marks]
        # The kernel of every sentence with every landmark: all that fitting needs.
        kernel = (presence @ base.T).astype(np.float64)
        own = np.array(marks, dtype=np.int64)
        self.temperature = self._temperature(kernel, own, y, ridge) if rows else 1.0
        found = base.T @ self._solve(kernel, own, y, ridge).astype(np.float32) if rows else np.zeros((0, 0), np.float32)
        self.weights = np.vstack([np.zeros((1, len(self.langs)), np.float32), found])
        self.bits = max(TABLE_BITS, (3 * len(vocabulary)).bit_length())
        # n-gram -> row of the weights: an open table over its hash, probed place by place
        size = 1 << self.bits
        self.keys = np.full(size, -1, dtype=np.int64)
        self.slots = np.zeros(size, dtype=np.int32)
        self.probes = 1
        for g, i in vocabulary.items():
            h = int(self._hashes(np.array([ord(c) for c in g], dtype=np.uint64), len(g))[-1][0])
            at, step = h >> HASH_BITS - self.bits, 1
            while self.keys[at] >= 0:
                at, step = (at + 1) & size - 1, step + 1
            self.keys[at], self.slots[at] = h, i + 1
            self.probes = max(self.probes, step)

    @staticmethod
    def _hashes(codes: np.ndarray, most: int) -> list[np.ndarray]:
        """Hashes of all n-grams of the code points, n = 1..``most``."""
        out, h = [], np.zeros(len(codes), dtype=np.uint64)
        for n in range(1, most + 1):
            h = (h[:len(codes) - n + 1] ^ codes[n - 1:]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            out.append((h >> np.uint64(64 - HASH_BITS)).astype(np.int64))
        return out

    def _solve(self, kernel: np.ndarray, marks: np.ndarray, y: np.ndarray, ridge: float, rows: np.ndarray | None = None, among: np.ndarray | None = None) -> np.ndarray:
        """Weights of the landmarks (those in ``among``) for each language, fitted on ``rows``."""
        rows = np.arange(len(y)) if rows is None else rows
        among = np.arange(len(marks)) if among is None else among
        values, vectors = np.linalg.eigh(kernel[np.ix_(marks[among], among)])
        keep = values > 1e-6
        root = vectors[:, keep] / np.sqrt(values[keep])
        features = kernel[np.ix_(rows, among)] @ root
        targets = np.where(np.arange(len(self.langs)) == y[rows][:, None], 1.0, -1.0 / max(1, len(self.langs) - 1))
        return root @ np.linalg.solve(features.T @ features + ridge * np.eye(features.shape[1]), features.T @ targets)

    def _temperature(self, kernel: np.ndarray, marks: np.ndarray, y: np.ndarray, ridge: float) -> float:
        """Scale of the scores that gives held-out sentences (two folds) the least log loss."""
        z = np.zeros((len(y), len(self.langs)))
        for fold in range(2):
            out = np.arange(len(y)) % 2 == fold
            among = np.flatnonzero(~out[marks])
            if len(among) and (~out).any():
                z[out] = kernel[np.ix_(out, among)] @ self._solve(kernel, marks, y, ridge, np.flatnonzero(~out), among)
        self.held_out_accuracy = float((z.argmax(axis=1) == y).mean()) if len(y) else 0.0
        best = (np.inf, 10.0)
        for b in np.geomspace(2, 60, 30):
            s = z * b - (z * b).max(axis=1, keepdims=True)
            best = min(best, (float(-(s[np.arange(len(y)), y] - np.log(np.exp(s).sum(axis=1))).mean()), float(b)))
        return best[1]

    def classify(self, sentences: list[str]) -> np.ndarray:
        """Probabilities of the languages, a row for each normalised sentence. Equal sentences
        are scored once."""
        known = {s: i for i, s in enumerate(dict.fromkeys(sentences))}
        if not known:
            return np.zeros((0, len(self.langs)))
        every = list(known)
        p = np.concatenate([self._score(every[at:at + PRODUCT]) for at in range(0, len(every), PRODUCT)])
        return p[[known[s] for s in sentences]]

    def _score(self, known: list[str]) -> np.ndarray:
        lengths = np.array([len(s) for s in known])
        codes = np.frombuffer("".join(known).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        owner = np.repeat(np.arange(len(known)) << HASH_BITS, lengths)
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
        # owner and hash in one number: a plain sort brings equal n-grams together
        key = np.concatenate([(owner[:len(h)] | h)[left[:len(h)] >= n] for n, h in enumerate(self._hashes(codes, min(len(codes), ORDERS[-1])), 1) if n in ORDERS])
        key.sort()
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
        o, h = key >> HASH_BITS, key & ((1 << HASH_BITS) - 1)
        total = np.bincount(o, minlength=len(known))
        at = h >> (HASH_BITS - self.bits)
        there = self.keys[at]
        slot = np.where(there == h, self.slots[at], 0)
        rest = np.flatnonzero((there != h) & (there >= 0))
        for step in range(1, self.probes):
            if not len(rest):
                break
            place = (at[rest] + step) & (1 << self.bits) - 1
            there = self.keys[place]
            same = there == h[rest]
            slot[rest[same]] = self.slots[place[same]]
            rest = rest[~same & (there >= 0)]
        # presence matrix (sentences x n-grams, rows in order) times the weights
        starts = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1])))
        z = np.add.reduceat(self.weights[slot], starts, axis=0).astype(np.float64) / np.sqrt(total)[:, None] * self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def spectrum(s: str) -> set[str]:
    """The n-grams of a normalised sentence."""
    return {s[i:i + n] for n in ORDERS for i in range(len(s) - n + 1)}


def covering(counted: Counter, most: int, landmarks: int) -> list[str]:
    """At most ``most`` of the sentences: first ``landmarks``, each next one adding the most
    of the usual n-grams for its length, then the commonest of the others."""
    items = sorted(counted.items(), key=lambda x: (-x[1], hash_of(x[0]), x[0]))[:2 * most]
    seen: Counter = Counter()
    grams = [spectrum(s) for s, _ in items]
    for g, (_, n) in zip(grams, items):
        for x in g:
            seen[x] += n
    worth = {x: math.log(n) for x, n in seen.items() if n > 1}
    size = [math.sqrt(max(1, len(g))) for g in grams]
    grams = [g & worth.keys() for g in grams]
    have: set[str] = set()
    gain = lambda i: sum(worth[x] for x in grams[i] - have) / size[i]
    heap = [(-gain(i), i) for i in range(len(items))]
    heapq.heapify(heap)
    out = []
    while heap and len(out) < landmarks:
        _, i = heapq.heappop(heap)
        now = gain(i)
        if heap and now < -heap[0][0] - 1e-12:
            heapq.heappush(heap, (-now, i))
            continue
        out.append(items[i][0])
        have |= grams[i]
    taken = set(out)
    return (out + [s for s, _ in items if s not in taken])[:most]


def trained_on(rows: list[tuple[str, str]], labelled: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Language and normalised sentence to fit on, landmarks first. ``rows``: the sample
    sentences; ``labelled``: language of the document's label and normalised sentence."""
    first = [(lang, normalise(t)) for lang, t in rows]
    langs = sorted({lang for lang, _ in first})
    if not langs:
        return []
    per: dict[str, Counter] = {}
    for lang, s in labelled:
        if lang in langs:
            per.setdefault(s, Counter())[lang] += 1
    base = KernelClassifier(first, max(1, max(Counter(lang for lang, _ in first).values()) * 4 // 5))
    found: dict[str, Counter] = {lang: Counter() for lang in langs}
    for (s, c), p in zip(per.items(), base.classify(list(per))):
        lang = max(sorted(c), key=lambda k: c[k] * (0.3 + p[langs.index(k)]))
        if c.total() >= 3 or p[langs.index(lang)] >= min(0.2, p.max()):
            found[lang][s] += c.total()
    for lang, s in first:
        found[lang][s] += 1
    return [(lang, s) for lang in langs for s in covering(found[lang], TRAINED, LANDMARKS)]


def sentences(lines: list[str], own: list[tuple[str, str] | None], bad: list[bool]) -> list[str]:
    """The whole sentences of a page's running text."""
    blocks: list[str] = []
    open_line = False
    for x, p, b in zip(lines, own, bad):
        if not x or b:
            open_line = False if b is False or not x else open_line
            continue
        m = _BULLET.match(x)
        if m and m.group(0).strip():
            x = x[m.end():]
            open_line = False
            if not _CLOSED.search(x[-16:]):
                continue
        if "(" in x or "（" in x or "[" in x:
            x = _BRACKETS.sub(" ", x).strip()
        closed = _CLOSED.search(x[-16:]) is not None
        if p[1] == "short" and not closed and not open_line:
            # a title, unless the text goes on in the next line
            if not _ENDS_COMMA.search(x):
                continue
        if open_line and blocks:
            blocks[-1] += (" " if blocks[-1][-1:].isascii() else "") + x
        else:
            blocks.append(x)
        open_line = not closed
    out = []
    for t in blocks:
        at = 0
        for m in _SPLIT.finditer(t):
            out.append(t[at:m.end()])
            at = m.end()
        if t[at:].strip() and (at == 0 or len(t) - at > 40):
            out.append(t[at:])
    return [s for s in (s.strip() for s in out) if s]


def page_sentences(text: str | None, g) -> tuple[list[tuple[str, int]], list[str], int]:
    """(normalised sentence, characters) of a page's running text; the page's own lines; how
    many of them were garbled."""
    if not text or not text.strip():
        return [], [], 0
    lines, hit = page_lines(text, g)
    own = paths(lines)
    _lost_lines(lines, own)
    bad = below(lines, own)
    body = [x for x, b in zip(lines, bad) if x and not b]
    garbled = sum(h for x, b, h in zip(lines, bad, hit) if x and not b)
    return whole_sentences(sentences(lines, own, bad)), body, garbled


def runs_of(told: list[tuple[str, int]], best: list[int], sure: list[float], langs: list[str]) -> list[tuple[str, float, int]]:
    """(language, confidence, characters) of each run of sentences of one language. ``best``
    and ``sure``: the likeliest language of each sentence and its probability."""
    runs: list[list] = []
    for (_, n), k, c in zip(told, best, sure):
        if runs and runs[-1][0] == k:
            runs[-1][1] += c * n
            runs[-1][2] += n
        else:
            runs.append([k, c * n, n])
    return [(langs[k], c / n, n) for k, c, n in runs]


def segments(texts: list[str | None], model: KernelClassifier, g) -> list[tuple[list[tuple[str, float, int]], list[str], int]]:
    """For each text its runs, its own lines and how many of them were garbled. The
    sentences of all texts are scored in one batch."""
    pages = [page_sentences(t, g) for t in texts]
    if not model.langs:
        return [([], body, garbled) for _, body, garbled in pages]
    p = model.classify([n for told, _, _ in pages for n, _ in told])
    best, sure = p.argmax(axis=1).tolist(), p.max(axis=1).tolist()
    out, at = [], 0
    for told, body, garbled in pages:
        end = at + len(told)
        if told and min(sure[at:end]) < SURE:
            q = in_context(p[at:end])
            best[at:end], sure[at:end] = q.argmax(axis=1).tolist(), q.max(axis=1).tolist()
        out.append((runs_of(told, best[at:end], sure[at:end], model.langs), body, garbled))
        at = end
    return out


def in_context(p: np.ndarray, floor: float = 0.03) -> np.ndarray:
    """Probabilities of a document's sentences: an unsure sentence, one below ``SURE``, is weighed
    between its two likeliest languages by the languages of the document's sure ones. A sure
    sentence stays as it is, however long the document."""
    sure = p.max(axis=1) >= SURE
    if not sure.any() or sure.all():
        return p
    second = np.sort(p, axis=1)[:, -2:-1]
    share = np.where(p >= second, floor + p[sure].mean(axis=0), 0.0)
    q = np.where(sure[:, None], p, p * share)
    return q / q.sum(axis=1, keepdims=True)


def _read_model(lang_samples: DataFrame, limit: int = 20_000) -> list[tuple[str, str]]:
    rows = lang_samples.where("text is not null and lang is not null").select("sample_id", "lang", "text").orderBy("sample_id", "lang", "text").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} sample sentences")
    return [(r["lang"], r["text"]) for r in rows]


def _read_labels(lang_labels: DataFrame, limit: int = 10_000) -> dict[str, str]:
    rows = lang_labels.where("label is not null").select("label", "lang").distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} labels")
    return {r["label"]: r["lang"] for r in rows}


def page_told(text: str | None, g) -> list[str]:
    """At most ``PER_PAGE`` of the page's sentences, drawn by a hash."""
    return sorted({n for n, _ in page_sentences(text, g)[0]}, key=lambda n: (hash_of(n), n))[:PER_PAGE]


def fit_languages(documents: DataFrame, lang_samples: DataFrame, lang_labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> KernelClassifier:
    """The classifier, fitted on the sample sentences and on at most ``PER_PAGE`` sentences
    of each of at most ``sample_rows`` labelled documents. The sentences are taken out on
    the executors."""
    samples, named = read_samples(lang_samples), _read_labels(lang_labels)

    def take(batch: pa.RecordBatch):
        g = finder(samples)
        found = [(named[label], n) for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if named.get(label) is not None for n in page_told(text, g)]
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], type=pa.string()) for k in (0, 1)], ["lang", "sentence"])

    told = map_batches(drawn(documents, sample_rows).select("lang", "text"), take, "lang string, sentence string").toArrow()
    return KernelClassifier(trained_on(_read_model(lang_samples), sorted(zip(told.column("lang").to_pylist(), told.column("sentence").to_pylist()))))


def fit_both(documents: DataFrame, lang_samples: DataFrame, lang_labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[KernelClassifier, ProseModel]:
    """This classifier and problem 1's model, fitted on one sample that is taken apart once."""
    samples, named = read_samples(lang_samples), _read_labels(lang_labels)
    known = neighbours(documents)
    sent = documents.sparkSession.sparkContext.broadcast(known)

    def take(batch: pa.RecordBatch):
        g = finder(samples)
        langs, found, stats = [], [], []
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            told, body, garbled = page_sentences(text, g)
            stats.append(statistics(body, sent.value, garbled) if body else None)
            langs.append(named.get(label))
            found.append(sorted({n for n, _ in told}, key=lambda n: (hash_of(n), n))[:PER_PAGE] if langs[-1] is not None else [])
        yield pa.RecordBatch.from_arrays([pa.array(langs, type=pa.string()), pa.array(found, type=pa.list_(pa.string())), pa.array(stats, type=pa.list_(pa.float64()))], ["lang", "found", "s"])

    told = map_batches(drawn(documents, sample_rows).select("lang", "text"), take, "lang string, found array<string>, s array<double>").toArrow()
    labelled = sorted((lang, n) for lang, found in zip(told.column("lang").to_pylist(), told.column("found").to_pylist()) for n in found)
    kernel = KernelClassifier(trained_on(_read_model(lang_samples), labelled))
    return kernel, fit_trees([s for s in told.column("s").to_pylist() if s is not None], known, samples)


def hash_of(s: str) -> int:
    """A hash of a text that is the same in every process."""
    return zlib.crc32(s.encode("utf-8", "surrogatepass"))


SEGMENTS = "doc_id bigint, label string, segment int, lang string, confidence double, chars int"


def document_segments(documents: DataFrame, lang_samples: DataFrame, lang_labels: DataFrame) -> DataFrame:
    """One row per segment: ``doc_id, label, segment, lang, confidence, chars``. A document
    without any whole sentence has one row with null lang."""
    samples = read_samples(lang_samples)
    sent = documents.sparkSession.sparkContext.broadcast(fit_languages(documents, lang_samples, lang_labels))

    def tell(batch: pa.RecordBatch):
        g, model = finder(samples), sent.value
        out = []
        for at in range(0, batch.num_rows, BATCH):
            keys, labels, texts = (c.to_pylist() for c in batch.slice(at, BATCH).columns)
            for key, label, (found, _, _) in zip(keys, labels, segments(texts, model, g)):
                out += [(key, label, no, lang, sure, n) for no, (lang, sure, n) in enumerate(found)] or [(key, label, 0, None, None, 0)]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.int32()))], ["doc_id", "label", "segment", "lang", "confidence", "chars"])

    return map_batches(documents.select("doc_id", "lang", "text"), tell, SEGMENTS)


def document_languages(documents: DataFrame, lang_samples: DataFrame, lang_labels: DataFrame) -> DataFrame:
    """One row per document: its label, the language of most of its text, the confidence,
    the share of that language and the number of its languages."""
    per = document_segments(documents, lang_samples, lang_labels).groupBy("doc_id", "label", "lang").agg(F.sum("chars").alias("chars"), F.max("confidence").alias("confidence"))
    most = F.max(F.struct("chars", F.col("confidence"), "lang"))
    return per.groupBy("doc_id", "label").agg(most.alias("m"), F.sum("chars").alias("all"), F.count("lang").cast("int").alias("languages")).select(
        "doc_id", "label", F.col("m.lang").alias("lang"), F.col("m.confidence").alias("confidence"), F.when(F.col("all") > 0, F.col("m.chars") / F.col("all")).alias("share"), "languages")


def unnamed_languages(documents: DataFrame, lang_samples: DataFrame, lang_labels: DataFrame, sure: float = 0.8, model: ProseModel | None = None) -> DataFrame:
    """``doc_id, lang``: languages of whole sentences that the document's label does not
    name. Only documents with such a language are held against problem 1's model, which
    leaves out those that are no prose. Both models are fitted on one sample."""
    samples, named = read_samples(lang_samples), _read_labels(lang_labels)
    context = documents.sparkSession.sparkContext
    kernel, prose = (fit_languages(documents, lang_samples, lang_labels), model) if model else fit_both(documents, lang_samples, lang_labels)
    told_by, sent = context.broadcast(kernel), context.broadcast(prose)

    def tell(batch: pa.RecordBatch):
        g = finder(samples)
        found = []
        for at in range(0, batch.num_rows, BATCH):
            keys, labels, texts = (c.to_pylist() for c in batch.slice(at, BATCH).columns)
            for key, label, (runs, body, garbled) in zip(keys, labels, segments(texts, told_by.value, g)):
                other = sorted({lang for lang, c, _ in runs if c >= sure and lang != named.get(label)})
                if other:
                    found.append((key, other, statistics(body, sent.value.known, garbled)))
        keep = []
        if found:
            kinds = sent.value.trees.probabilities(np.array([s for _, _, s in found])).argmax(axis=1)
            keep = [(key, lang) for (key, other, _), k in zip(found, kinds) if KINDS[k] == "prose" for lang in other]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keep], type=pa.int64()), pa.array([v for _, v in keep], type=pa.string())], ["doc_id", "lang"])

    return map_batches(documents.select("doc_id", "lang", "text"), tell, "doc_id bigint, lang string")
