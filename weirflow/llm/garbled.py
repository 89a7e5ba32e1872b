"""Problem 9: lines garbled by a wrong character decoding, found and restored.

Method: the garbled sequences of every encoding pair (what a character looks like when its
bytes in one encoding are read in another) are computed beforehand; a multi-pattern
automaton finds them; only matched spans are replaced, correct text in between stays.

* Multi-byte text read in a single-byte encoding (UTF-8, GBK, Shift-JIS, EUC-JP as Latin-1,
  Windows-1252, code page 437, ...): each character of the repertoire gives one sequence of
  two or more characters. Once restored, a text is searched again, as text may have gone
  wrong twice.
* Multi-byte text read in another multi-byte encoding (UTF-8 as GBK, Shift-JIS, Big5, ...):
  the characters do not align, so the automaton runs over the bytes of the suspected run.
* Single-byte text read in another single-byte encoding gives one character for one, so the
  pattern is the word: its letters must be odd as they stand (mixed scripts, symbols inside
  a word, a capital after a small letter) and make a word of one script once restored; of
  several restorations the one whose letter pairs are usual in the sample sentences wins.
* The replacement character U+FFFD and what becomes of it in GBK are garbled and cannot be
  restored.

Each text is first searched for characters that occur in any of these sequences; lines
without them are not looked at further. The sample sentences (a fixed table) are the only
thing sent to the workers.

Defined results: null, empty and blank texts have no garbled lines; lines are those between
U+000A, counted from 0; repeated rows come out as often as they went in; an empty table
gives an empty table; further columns are ignored. Rare but correct characters, composed or
decomposed, emoji and symbols stay as they are.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from weirflow.llm.arrow import map_batches

#: Encodings by their kind.
SINGLE = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "koi8-r", "cp866")
MULTI_READ = ("utf-8", "gbk", "cp932", "euc_jp", "big5")
MULTI_WRONG = ("gb18030", "cp932", "big5", "cp949", "euc_jp")
LATIN_LETTERS = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœßÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŒ"
MARKS = "‘’‚“”„†•…–—›‹«»·°©®™€£¥§±²³´µ¶¹º¿¡½¼¾ª×÷▸→※★☆№℃　、。「」『』《》【】〈〉（）！？，：；～・ー①②③④⑤⑥⑦⑧⑨⑩\xa0\xad​‑﻿"
CYRILLIC = "".join(chr(c) for c in range(0x410, 0x450)) + "Ёё"
KANA = "".join(chr(c) for c in range(0x3041, 0x3097)) + "".join(chr(c) for c in range(0x30A1, 0x30FB))


def read_as(data: bytes, wrong: str) -> str | None:
    """``data`` read in ``wrong``; bytes that Windows-1252 leaves open stay as controls."""
    if wrong == "cp1252":
        return "".join(_CP1252[b] for b in data)
    try:
        return data.decode(wrong)
    except UnicodeDecodeError:
        return None


def bytes_in(text: str, wrong: str) -> bytes | None:
    """The bytes of ``text`` in ``wrong``, the inverse of ``read_as``."""
    if wrong == "cp1252":
        try:
            return bytes(_CP1252_BYTE[c] for c in text)
        except KeyError:
            return None
    try:
        return text.encode(wrong)
    except UnicodeEncodeError:
        return None


_CP1252 = [bytes([b]).decode("cp1252", errors="ignore") or chr(b) for b in range(256)]
_CP1252_BYTE = {c: b for b, c in enumerate(_CP1252)}


@lru_cache(maxsize=1)
def han_repertoire() -> tuple[str, ...]:
    """Han characters of GB 2312, Big5's first plane and JIS X 0208, from the codecs."""
    chars = {}
    for codec, leads, trails in (("gb2312", range(0xB0, 0xF8), range(0xA1, 0xFF)), ("big5", range(0xA4, 0xC7), [*range(0x40, 0x7F), *range(0xA1, 0xFF)]), ("euc_jp", range(0xB0, 0xF5), range(0xA1, 0xFF))):
        for a in leads:
            for b in trails:
                try:
                    chars[bytes((a, b)).decode(codec)] = None
                except UnicodeDecodeError:
                    pass
    return tuple(chars)


@lru_cache(maxsize=1)
def first_level() -> frozenset[str]:
    """The frequent Han characters: the first level of GB 2312."""
    return frozenset(c for a in range(0xB0, 0xD8) for b in range(0xA1, 0xFF) if (c := bytes((a, b)).decode("gb2312", errors="ignore")))


@lru_cache(maxsize=1)
def automata():
    """Per right encoding an automaton over characters, and one over bytes of UTF-8:
    garbled sequence -> (wrong, character, length). A sequence that several wrong encodings
    produce keeps the first of them."""
    import ahocorasick

    units = LATIN_LETTERS + MARKS + CYRILLIC + KANA
    over_chars = {}
    for right in MULTI_READ:
        found = ahocorasick.Automaton()
        for wrong in SINGLE if right == "utf-8" else ("cp1252", "latin-1"):
            if right != "utf-8":
                repertoire = (*MARKS, *KANA, *first_level())
            elif wrong in ("latin-1", "cp1252", "cp437", "mac_roman", "cp1251"):
                repertoire = (*units, *han_repertoire())
            else:
                repertoire = (*LATIN_LETTERS, *MARKS)
            for c in repertoire:
                try:
                    data = c.encode(right)
                except UnicodeEncodeError:
                    continue
                if len(data) > 1 and (seq := read_as(data, wrong)) and seq not in found:
                    found.add_word(seq, (wrong, c, len(seq)))
        found.make_automaton()
        over_chars[right] = found
    over_bytes = ahocorasick.Automaton()
    for c in (*MARKS, *KANA, *han_repertoire()):
        data = c.encode("utf-8")
        if len(data) > 2:
            over_bytes.add_word(data.decode("latin-1"), (c, len(data)))
    over_bytes.make_automaton()
    return over_chars, over_bytes


@lru_cache(maxsize=1)
def usual_han() -> frozenset[str]:
    """Frequent Han characters of the three national sets: what correct text is made of."""
    chars = set(first_level())
    for codec, leads, trails in (("big5", range(0xA4, 0xC7), [*range(0x40, 0x7F), *range(0xA1, 0xFF)]), ("euc_jp", range(0xB0, 0xD0), range(0xA1, 0xFF))):
        chars |= {c for a in leads for b in trails if len(c := bytes((a, b)).decode(codec, errors="ignore")) == 1}
    return frozenset(chars)


@lru_cache(maxsize=1)
def rare_readings() -> dict[str, tuple[str, ...]]:
    """Unusual characters that the first two bytes of a UTF-8 character become when read in
    a multi-byte encoding -> those encodings."""
    out: dict[str, list[str]] = {}
    plain = usual_han() | set(MARKS) | set(KANA) | set(CYRILLIC)
    for codec in MULTI_WRONG:
        for a in (*range(0xE2, 0xEA), 0xEF):
            for b in range(0x80, 0xC0):
                c = bytes((a, b)).decode(codec, errors="ignore")
                if len(c) == 1 and c not in plain:
                    out.setdefault(c, []).append(codec)
    return {c: tuple(v) for c, v in out.items()}


@lru_cache(maxsize=1)
def _suspects():
    """Pattern of the characters or pairs without which a line cannot be garbled."""
    odd = "".join(re.escape(c) for c in sorted(set(rare_readings()) | set("锟拷")))
    second = "\x80-¿ŒœŠšŸŽžƒˆ˜–-…‰‹›€™"
    return re.compile(
        f"[{odd}\x80-\x84\x86-\x9f\ue000-\uf8ff�─-╬▀-▟｡-ﾟ]"
        f"|[Â-ô][{second}]|[¡-ÿŒœŠšŸŽžƒˆ˜–-…‰‹›€™]{{3}}"
        "|[ÐÑРСЂ-Џђ-џҐґ][^\x00-\x7fа-яё»”…]|[Γ√‚¬]\\S|[a-zа-я][A-Z]?[À-Þ°-¶¸¹¼-¿¨÷‗ýþα-ω≈-≥]"
        "|[а-я][А-Я]{2}|[А-Я]{4}"
    )


@lru_cache(maxsize=1)
def openings():
    """Pattern of the characters one of which every match of ``_suspects`` holds."""
    odd = "".join(re.escape(c) for c in sorted(set(rare_readings()) | set("锟拷")))
    return re.compile(f"[{odd}\x80-\x84\x86-\x9f\ue000-\uf8ff�─-╬▀-▟｡-ﾟÂ-ô¡-ÿŒœŠšŸŽžƒˆ˜–-…‰‹›€™ÐÑРСЂ-Џђ-џҐґΓ√‚¬À-Þ°-¿¨÷‗ýþα-ω≈-≥А-Я]")


def suspect(text: str) -> bool:
    """Whether a text holds anything without which it cannot be garbled."""
    return not text.isascii() and openings().search(text) is not None and _suspects().search(text) is not None


@lru_cache(maxsize=1)
def _rare():
    return re.compile("[" + "".join(re.escape(c) for c in sorted(rare_readings())) + "\ue000-\uf8ff]")


def han_runs(text: str) -> list[tuple[int, int, str, str, str]]:
    """Spans of multi-byte text read in another multi-byte encoding: at least two (for GBK)
    or three characters in a row, most of them usual ones."""
    readings = rare_readings()
    codecs = Counter(w for c in _rare().findall(text) for w in readings.get(c, ("gb18030",)))
    out = []
    if not codecs:
        return out
    usual, marks = usual_han(), set(MARKS) | set(KANA)
    for m in _NON_ASCII.finditer(text):
        run = m.group()
        best: tuple[int, list] | None = None
        for wrong, _ in codecs.most_common():
            pieces, owner = bytearray(), []
            for i, c in enumerate(run):
                try:
                    data = c.encode(wrong)
                except UnicodeEncodeError:
                    data = b"\xff"
                pieces += data
                owner += [i] * len(data)
            spans: list[list] = []
            for end, (c, n) in automata()[1].iter(pieces.decode("latin-1")):
                start = end + 1 - n
                if spans and 0 <= start - spans[-1][1] <= 3:
                    spans[-1][1] = end + 1
                    spans[-1][2].append(c)
                else:
                    spans.append([start, end + 1, [c]])
            least = 2 if wrong == "gb18030" else 3
            good = [(m.start() + owner[a], m.start() + owner[b - 1] + 1, "".join(cs)) for a, b, cs in spans
                    if len(cs) >= least and 3 * len(cs) >= 0.6 * (b - a) and sum(c in usual or c in marks for c in cs) >= 0.75 * len(cs)]
            size = sum(len(r) for _, _, r in good)
            if good and (best is None or size > best[0]):
                best = (size, [(a, b, r, "utf-8", wrong) for a, b, r in good])
        if best:
            out += best[1]
    return out


_NON_ASCII = re.compile("[^\x00-\x7f]{2,}[^\n]?")
_LOST = re.compile("(?:锟斤|斤拷|锟�|锟)[锟斤拷�]*|�+")
_NOISE = re.compile(r"[{}~^#*\\<=_`]|(?<=\S)[|>]|[|>](?=\S)|(?<![^\x00-\x7f])[§¬¦](?![^\x00-\x7f])")
_HIGH = re.compile("[\x80-ÿŒœŠšŸŽžƒˆ˜‚-‡‰‹›€™Γ√┬├Р-С]")
_HIGH2 = re.compile("[\x80-ÿŒœŠšŸŽžƒˆ˜–-…‰‹›€™].?[\x80-ÿŒœŠšŸŽžƒˆ˜–-…‰‹›€™]")
_HAN = re.compile("[⺀-\uffff]{2}")
_WORD = re.compile(r"[^\s.,;:!?()\"'/|<>\[\]{}=+*#~@0-9\\\-]+")


class Garbled:
    """Finds and restores garbled spans. ``samples``: clean sentences of the languages."""

    def __init__(self, samples: list[str]):
        self.pairs: Counter = Counter()
        self.letters: Counter = Counter()
        for s in samples:
            for w in re.findall(r"[^\W\d_]+", unicodedata.normalize("NFC", s).lower()):
                if not re.search("[぀-鿿]", w):
                    self.pairs.update(a + b for a, b in zip("^" + w, w + "$"))
                    self.letters.update(w)
        self.total = sum(self.pairs.values()) or 1

    def usual(self, word: str) -> float:
        """Mean log frequency of the word's letter pairs."""
        w = word.lower()
        return sum(math.log((self.pairs[a + b] + 0.05) / self.total) for a, b in zip("^" + w, w + "$")) / (len(w) + 1)

    def spans(self, text: str) -> list[tuple[int, int, str | None, str, str]]:
        """Garbled spans of one line: start, end, restored text (None: lost), right, wrong."""
        if not suspect(text):
            return []
        out = [(m.start(), m.end(), None, "lost", "lost") for m in _LOST.finditer(text)]
        taken = bytearray(len(text))
        for a, b, *_ in out:
            taken[a:b] = b"\x01" * (b - a)
        if _HIGH.search(text):
            out += self._sequences(text, taken)
        if _HAN.search(text):
            for span in han_runs(text):
                if not any(s[2] for s in out if s[0] < span[1] and span[0] < s[1]):
                    out = [s for s in out if not (span[0] <= s[0] and s[1] <= span[1])] + [span]
                    taken[span[0]:span[1]] = b"\x01" * (span[1] - span[0])
        if not _noisy(text, taken):
            out += self._words(text, taken)
        return sorted(out, key=lambda s: s[:2])

    def _sequences(self, text: str, taken: bytearray) -> list[tuple]:
        """Matches of the automata over characters, merged where they adjoin. The right
        encoding that covers most of the line comes first. In a line of noise a
        reading other than UTF-8 counts only if it covers most of the line."""
        by_right = []
        for right, automaton in automata()[0].items():
            if right != "utf-8" and not _HIGH2.search(text):
                continue
            runs: list[list] = []
            for end, (wrong, c, n) in automaton.iter_long(text):
                start = end + 1 - n
                if runs and start == runs[-1][1]:
                    runs[-1][1] = end + 1
                    runs[-1][2].append((wrong, c))
                else:
                    runs.append([start, end + 1, [(wrong, c)]])
            sure = [r for r in runs if self._counts(text, right, r)]
            covered = sum(r[1] - r[0] for r in sure)
            most = 2 * covered >= sum(map(len, text.split()))
            # Where most of the line is sure, its short words are of the same encoding.
            runs = [r for r in runs if r[1] - r[0] >= 4 or r in sure] if most and right != "utf-8" else sure
            if runs and right != "utf-8" and not most:
                inside = bytearray(len(text))
                for r in runs:
                    inside[r[0]:r[1]] = b"\x01" * (r[1] - r[0])
                if _noisy(text, inside):
                    continue
            if runs:
                by_right.append((covered, right, runs))
        # A line that is mostly UTF-8 has no other reading; what is left over may be garbled twice.
        if any(right == "utf-8" and 2 * n >= sum(map(len, text.split())) for n, right, _ in by_right):
            by_right = [r for r in by_right if r[1] == "utf-8"]
        out = []
        for _, right, runs in sorted(by_right, key=lambda x: (-x[0], MULTI_READ.index(x[1]))):
            for a, b, found in runs:
                if any(taken[a:b]):
                    continue
                seq, restored = text[a:b], None
                for w in dict.fromkeys((*(w for w, _ in Counter(w for w, _ in found).most_common()), "cp1252", "latin-1")):
                    data = bytes_in(seq, w)
                    if data is not None:
                        try:
                            restored = data.decode(right)
                            break
                        except UnicodeDecodeError:
                            continue
                out.append((a, b, restored if restored is not None else "".join(c for _, c in found), right, found[0][0]))
                taken[a:b] = b"\x01" * (b - a)
        return out

    @staticmethod
    def _counts(text: str, right: str, run: list) -> bool:
        """Whether a run of matches is long or odd enough to be garbled text."""
        a, b, found = run
        seq = text[a:b]
        if right == "utf-8":
            if all(w in ("cp1251", "koi8-r", "cp866") for w, _ in found):
                return len(found) >= 2 or bool(re.search("[^\u0410-\u044f\u0401\u0451]", seq[1:]))
            return len(found) > 1 or found[0][1] not in "\xa0\xad" or bool(re.search("[\x80-\x9f]|Ã|Â", seq))
        whole = seq == text.strip()
        plain = all("À" <= ch <= "ÿ" and ch not in "×÷" for ch in seq)
        return len(seq) >= 4 and (whole or len(found) >= (3 if plain else 2))

    def _words(self, text: str, taken: bytearray) -> list[tuple]:
        """Words of one single-byte encoding read in another."""
        out, cyr = [], []
        lone = _LONE_BOX.findall(text)
        if len(lone) == 1 and "│" not in text and "|" not in text:
            at = text.index(lone[0])
            data = bytes_in(lone[0], "cp437")
            if data and not taken[at]:
                out.append((at, at + 1, read_as(data, "cp1252"), "cp1252", "cp437"))
                taken[at] = 1
        for m in _WORD.finditer(text):
            a, b = m.span()
            if any(taken[a:b]):
                continue
            word = m.group()
            if word.isascii():
                continue
            odd = _oddness(word)
            if odd:
                best = None
                for wrong in SINGLE:
                    data = bytes_in(word, wrong)
                    if data is None:
                        continue
                    for right in ("cp1252", "cp1251", "koi8-r", "cp866"):
                        if right == wrong or {right, wrong} == {"cp1252", "latin-1"}:
                            continue
                        fixed = read_as(data, right)
                        if fixed is None or fixed == word or _oddness(fixed) or not _plain_word(fixed):
                            continue
                        score = self.usual(_core(fixed))
                        if best is None or score > best[0]:
                            best = (score, fixed, right, wrong)
                if best and best[0] > self.usual(word) + 0.3 and best[0] > -9.6:
                    out.append((a, b, best[1], best[2], best[3]))
            elif _CYR_WORD.fullmatch(word):
                cyr.append((a, b, word))
        if cyr and not out:
            for wrong, right in (("cp1251", "koi8-r"), ("koi8-r", "cp1251")):
                fixed = [read_as(d, right) if (d := bytes_in(w, wrong)) is not None else None for _, _, w in cyr]
                if any(f is None or not _CYR_WORD.fullmatch(f) for f in fixed):
                    continue
                n = sum(len(w) for _, _, w in cyr)
                swapped = sum(self.usual(f) * len(f) for f in fixed) / n
                straight = sum(self.usual(w) * len(w) for _, _, w in cyr) / n
                if n >= 4 and swapped > straight + 1.0:
                    out += [(a, b, f, right, wrong) for (a, b, _), f in zip(cyr, fixed)]
                    break
        return out

    def restore(self, text: str, rounds: int = 3) -> tuple[str, bool, bool]:
        """The line restored as far as it can be; whether it was garbled; whether fully restored."""
        hit, full = False, True
        for _ in range(rounds):
            found = self.spans(text)
            if not found:
                break
            hit, at, parts = True, 0, []
            changed = False
            for a, b, fixed, _, _ in found:
                if a < at:
                    continue
                parts.append(text[at:a])
                parts.append(text[a:b] if fixed is None else fixed)
                changed |= fixed is not None
                full &= fixed is not None
                at = b
            text = "".join(parts) + text[at:]
            if not changed:
                break
        return text, hit, hit and full


_LONE_BOX = re.compile("[╒-╬┤-┼┐-┘]")
_CYR_WORD = re.compile("[А-яЁё]{2,}")
_SYMBOL_IN = re.compile("[^\\W\\d_][°-¹»-¿¢-©¬®¯×÷‗─-■†-•‰™≈-≥√∂∆∏∑∫ˆ-˝]")


def _noisy(text: str, inside: bytearray) -> bool:
    """Whether scattered signs, outside what is explained by a reading, are so many for a
    line's length (one in 25 characters, and four at least) that it is noise. Bars and angles
    between blanks separate menus; § ¬ ¦ beside other characters beyond ASCII are what bytes
    of several encodings become."""
    return sum(not inside[m.start()] for m in _NOISE.finditer(text)) >= max(4, len(text) / 25)


def _core(word: str) -> str:
    return re.sub(r"[^\w]", "", word)


def _oddness(word: str) -> bool:
    """True for a word that no language here writes: letters of two alphabets, a capital
    after a small letter, a symbol inside it, or three accented letters in a row."""
    latin = any("a" <= c.lower() <= "z" or "À" <= c <= "ɏ" for c in word)
    cyrillic = any("Ѐ" <= c <= "ӿ" for c in word)
    if any("一" <= c <= "鿿" or "぀" <= c <= "ヿ" for c in word):
        return False
    if latin and cyrillic:
        return True
    if cyrillic and re.search("[─-■ -¿•]", word):
        return True
    if re.search("[a-zß-öø-ÿ][À-ÖØ-Þ](?![a-z]*['’])", word) or re.search("[À-ÖØ-öø-ÿ]{3}", word):
        return True
    return bool(_SYMBOL_IN.search(word)) and latin or bool(re.search("[─-▟]", word))


def _plain_word(word: str) -> bool:
    return bool(re.fullmatch("[«“„‘’”»…—–]*[^\\W\\d_]+(?:[’'][^\\W\\d_]+)*[«“„‘’”»…—–]*", word)) and all(c.isascii() or c in LATIN_LETTERS or c in CYRILLIC or c in "«“„‘’”»…—–" for c in word)


@lru_cache(maxsize=2)
def finder(samples: tuple[str, ...]) -> Garbled:
    """The finder of this worker."""
    return Garbled(list(samples))


def read_samples(lang_samples: DataFrame, limit: int = 20_000) -> tuple[str, ...]:
    """The sample sentences: a fixed table, refused beyond ``limit`` rows."""
    rows = lang_samples.where("text is not null").select("sample_id", "text").orderBy("sample_id", "text").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} sample sentences")
    return tuple(r["text"] for r in rows)


def garbled_lines(documents: DataFrame, lang_samples: DataFrame, keep_text: bool = True) -> DataFrame:
    """``doc_id, line_no`` of each garbled line; with ``keep_text`` also ``garbled,
    restored, complete``."""
    samples = read_samples(lang_samples)
    fields = [("doc_id", pa.int64()), ("line_no", pa.int32())] + ([("garbled", pa.string()), ("restored", pa.string()), ("complete", pa.bool_())] if keep_text else [])

    def find(batch: pa.RecordBatch):
        g = finder(samples)
        rows = []
        texts = batch.column(1)
        for i in range(batch.num_rows):
            text = texts[i].as_py()
            if not text or text.isascii():
                continue
            for no, line in enumerate(text.split("\n")):
                if keep_text:
                    fixed, hit, full = g.restore(line)
                    if hit:
                        rows.append((batch.column(0)[i].as_py(), no, line, fixed, full))
                elif g.spans(line):
                    rows.append((batch.column(0)[i].as_py(), no))
        columns = list(zip(*rows)) if rows else [[] for _ in fields]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])

    return map_batches(documents.select("doc_id", "text"), find, "doc_id bigint, line_no int" + (", garbled string, restored string, complete boolean" if keep_text else ""))
