"""Text cleaning as Column -> Column functions.

Patterns name white space, letters and line breaks explicitly, so that they mean the same
in Spark and in an SQL oracle. Null texts stay null in the single steps; the composed
cleaners give '' for null, as a missing text is an empty one to them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode white space as the inside of a character class.
WS = r"\t-\r\x1c-\x20\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: What the cleaners remove or replace, in order. The rule that removes all of a
#: line up to a phrase is anchored, so a line without it is scanned once.
TAGS = (("(?s)<script[^>]*>.*?</script>", ""), ("(?s)<style[^>]*>.*?</style>", ""), ("<[^>]+>", " "))
ENTITIES = (("&nbsp;", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
OTHER_ENTITIES = ((r"&#[0-9]+;", ""), ("&[a-zA-Z]+;", ""))
_URL_CHARS = "[^" + WS + r'<>"{}|\\^`\[\]]+'
URLS = f"(?i)https?://{_URL_CHARS}|www\\.{_URL_CHARS}|ftp://{_URL_CHARS}"
EMAIL = f"[^{WS}]+@[^{WS}]+\\.[^{WS}]+"
ADS = (
    r"点击[^\n]*?(?:查看|下载|购买)", r"(?:扫码|扫描)[^\n]*?(?:二维码|关注)", r"(?:微信|微博|抖音|快手)[^\n]*?关注",
    r"限时[^\n]*?优惠", r"(?m)^[^\n]*专享价", r"点击关注[^\n]*?公众号",
)
CONTROLS = r"[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f-\x9f]"
REPEATS = ((r"\.{3,}", "..."), ("-{3,}", "---"), ("_{3,}", "___"), ("!{3,}", "!!"), (r"\?{3,}", "??"))


def _replace(c: Column, rules) -> Column:
    return reduce(lambda x, rule: F.regexp_replace(x, *rule), rules, c)


def collapse_space(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{WS}]+", " "))


def strip(c: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def strip_tags(c: Column) -> Column:
    return _replace(c, TAGS)


def decode_entities(c: Column) -> Column:
    """Named entities in their order (so an escaped ampersand decodes twice), others removed."""
    named = reduce(lambda x, rule: F.replace(x, F.lit(rule[0]), F.lit(rule[1])), ENTITIES, c)
    return _replace(named, OTHER_ENTITIES)


def clean_html(c: Column) -> Column:
    """Tags out, then entities decoded, then white space collapsed."""
    return collapse_space(decode_entities(strip_tags(F.coalesce(c, F.lit("")))))


def remove_ads(c: Column) -> Column:
    return _replace(c, tuple((p, "") for p in ADS))


def clean_urls(c: Column) -> Column:
    """Links, then addresses, then advertising phrases out; white space collapsed."""
    links = F.regexp_replace(F.coalesce(c, F.lit("")), URLS, "")
    # Without the sign there is no address, and the pattern would try every place of a long run.
    rest = F.when(F.contains(links, F.lit("@")), F.regexp_replace(links, EMAIL, "")).otherwise(links)
    return collapse_space(remove_ads(rest))


#: A class that holds every character that composition can change.
UNCOMPOSED = (r"[\p{M}\x{0340}-\x{0387}\x{0958}-\x{0fff}\x{1100}-\x{11ff}\x{1b00}-\x{1bff}\x{1f00}-\x{1fff}\x{2000}\x{2001}\x{2126}\x{212a}\x{212b}\x{2329}\x{232a}\x{2adc}"
              r"\x{f900}-\x{faff}\x{fb1d}-\x{fb4f}\x{105d0}-\x{10600}\x{11000}-\x{16fff}\x{1d15e}-\x{1d1c0}\x{2f800}-\x{2fa1d}]")


def nfc(c: Column) -> Column:
    """Canonical composition. Spark has no such function: an Arrow UDF, which gets only the
    texts that hold a character composition can change and null for the others."""
    import pandas as pd

    def compose(s):
        import unicodedata

        return s.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))

    compose.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.coalesce(F.pandas_udf(compose, "string")(F.when(F.regexp_like(c, F.lit(UNCOMPOSED)), c)), c)


def once(df: DataFrame, column: str, c: Column) -> DataFrame:
    """``df`` with ``column``, computed once a row however often it is used later: a filter on
    it stays behind the generator and does not repeat the expression below."""
    rest = [x for x in df.columns if x != column]
    return df.select(*rest, F.explode(F.array(c)).alias(column))


def remove_controls(c: Column) -> Column:
    return F.regexp_replace(c, CONTROLS, "")


def normalize_lines(c: Column) -> Column:
    """Runs of breaks and tabs as one line feed, runs of blanks as one, ends stripped."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"[\t\n\r\f\x0b]+", "\n"), " +", " "))


def squeeze_repeats(c: Column) -> Column:
    return _replace(c, REPEATS)


def length_gate(c: Column, least: int = 100, most: int = 100_000) -> Column:
    """The text if its code points lie within the bounds, both included; else ''."""
    return F.when(F.length(c).between(least, most), c).otherwise(F.lit(""))


def clean_text(c: Column, least: int = 100, most: int = 100_000, compose: bool = True) -> Column:
    """Composition, control characters, lines, repeats, then the length gate."""
    text = F.coalesce(c, F.lit(""))
    return length_gate(squeeze_repeats(normalize_lines(remove_controls(nfc(text) if compose else text))), least, most)


def clean_all(c: Column, least: int = 10, most: int = 100_000) -> Column:
    """The whole chain: html, links, text."""
    return clean_text(clean_urls(clean_html(c)), least, most)


def dedup_key(c: Column) -> Column:
    """md5 of the lower-cased stripped text."""
    return F.md5(F.lower(strip(F.coalesce(c, F.lit("")))))


def split_words(c: Column) -> Column:
    """Words between white space; none for blank or null text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), f"[{WS}]+"), lambda w: w != "")


def estimate_tokens(c: Column) -> Column:
    """Code points by four, rounded down."""
    return F.floor(F.length(c) / 4).cast("bigint")


def format_count(c: Column) -> Column:
    """1.2K, 3.4M, 5.6B; smaller numbers as they are."""
    return (F.when(c >= 1e9, F.format_string("%.1fB", c / 1e9)).when(c >= 1e6, F.format_string("%.1fM", c / 1e6))
            .when(c >= 1e3, F.format_string("%.1fK", c / 1e3)).otherwise(c.cast("string")))


def format_clock(seconds: Column) -> Column:
    """MM:SS."""
    whole = F.floor(seconds).cast("bigint")
    return F.format_string("%02d:%02d", F.floor(whole / 60).cast("bigint"), F.pmod(whole, F.lit(60)))
