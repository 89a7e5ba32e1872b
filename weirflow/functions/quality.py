"""Quality predicates: Column -> Column[double] or Column[boolean]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weirflow.functions.text import WS

#: The classes that are counted.
CHINESE = r"[\x{4e00}-\x{9fff}]"
ENGLISH = "[a-zA-Z]"
PUNCT = rf"[^\p{{L}}\p{{N}}_{WS}]"
DIGIT = r"\p{Nd}"
UNPRINTABLE = r"[\p{Cc}\p{Cf}\p{Co}\p{Zl}\p{Zp}\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"


def share(c: Column, pattern: str) -> Column:
    """Matches of a one-character pattern by code points; 0 for null or empty text."""
    n = F.length(c)
    return F.when(F.coalesce(n, F.lit(0)) > 0, F.regexp_count(c, F.lit(pattern)) / n).otherwise(F.lit(0.0))


def distinct_chars(c: Column) -> Column:
    """Distinct characters, case apart."""
    return F.when(F.length(c) > 0, F.size(F.array_distinct(F.split(F.lower(c), "")))).otherwise(F.lit(0))


def line_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit("\n")) + 1


def counts(c: Column) -> Column:
    """What the filters look at, counted once a text: a struct. Bound by ``once`` (or a lambda)
    it serves any number of predicates."""
    count = lambda p: F.regexp_count(c, F.lit(p))
    return F.struct(
        F.length(c).alias("n"), count(CHINESE).alias("zh"), count(ENGLISH).alias("en"), count(PUNCT).alias("punct"), count(DIGIT).alias("digit"),
        count(UNPRINTABLE).alias("unprintable"), line_count(c).alias("lines"), distinct_chars(c).alias("distinct"))


def garbage_of(k: Column) -> Column:
    """``is_garbage`` over the struct of ``counts``."""
    n = F.greatest(k["n"], F.lit(1))
    return (k["n"] < 10) | (1 - k["unprintable"] / n < 0.8) | ((k["lines"] > 100) & (n / k["lines"] < 20)) | (k["distinct"] < 10)


def keeps_of(k: Column, lang: str, least: float | None = None) -> Column:
    """``keeps`` over the struct of ``counts``."""
    name, bound = ("zh", 0.3) if lang == "chinese" else ("en", 0.5)
    n = F.greatest(k["n"], F.lit(1))
    ok = (k[name] / n >= (bound if least is None else least)) & (k["punct"] / n <= 0.5) & (k["digit"] / n <= 0.5) & ~garbage_of(k)
    return F.coalesce((k["n"] > 0) & ok, F.lit(False))


def is_garbage(c: Column) -> Column:
    """Too short, too little that prints, many short lines, or hardly any different character."""
    return F.element_at(F.transform(F.array(counts(c)), garbage_of), 1)


def keeps(c: Column, lang: str, least: float | None = None) -> Column:
    """Whether a text passes the filter of ``chinese`` or ``english``. Null does not."""
    return F.element_at(F.transform(F.array(counts(c)), lambda k: keeps_of(k, lang, least)), 1)


def is_valid(c: Column, least: int = 100, most: int = 100_000) -> Column:
    """Length within bounds and at most a line feed for every ten characters."""
    n = F.length(c)
    return F.coalesce((n > 0) & (n >= least) & (n <= most) & (F.regexp_count(c, F.lit("\n")) <= n / 10), F.lit(False))


def detect(c: Column) -> Column:
    """``chinese``, ``english`` or, where neither has more characters, ``mixed``."""
    zh, en = F.regexp_count(c, F.lit(CHINESE)), F.regexp_count(c, F.lit(ENGLISH))
    return F.when(zh > en, F.lit("chinese")).when(en > zh, F.lit("english")).otherwise(F.lit("mixed"))


def not_blank(c: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(c, f"[{WS}]+", "")) > 0, F.lit(False))
