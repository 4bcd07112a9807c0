"""Requests to rewrite a text: validation, settings, and the message that a model gets."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What a request may ask for, its limits, blocks that data must not close, and words that switch references off.
LOCALES, STRENGTHS, STANDARD = ("en", "fr"), ("light", "standard", "thorough"), "standard"
MAX_CHARS, MAX_VOICE = 5000, 1500
BLOCKS = ("text", "reference", "style_references", "author_voice", "intensity")
OFF = ("off", "false", "0", "no")
_SPACE = r"[\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, as a browser counts it."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("bigint")


@F.pandas_udf(StringType())
def composed(text: pd.Series) -> pd.Series:
    """Text in Unicode's composed form (NFC), as a page sends what was typed."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{_SPACE}+|{_SPACE}+$", "")


def validated(requests: DataFrame, locale: str = "locale", strength: str = "strength", voice: str = "voice", text: str = "text") -> DataFrame:
    """requests with defaults for what is missing, and `accepted`: known settings, a text that is not blank, and lengths within limits."""
    known = F.coalesce(locale, F.lit(LOCALES[0])).isin(*LOCALES) & F.coalesce(strength, F.lit(STANDARD)).isin(*STRENGTHS)
    written = F.coalesce((trimmed(F.col(text)) != "") & (utf16_length(F.col(text)) <= MAX_CHARS), F.lit(False))
    voiced = F.coalesce(utf16_length(F.col(voice)) <= MAX_VOICE, F.lit(True))
    return requests.withColumn("accepted", known & written & voiced).withColumn(locale, F.coalesce(locale, F.lit(LOCALES[0]))).withColumn(strength, F.coalesce(strength, F.lit(STANDARD)))


def references_on(setting: Column) -> Column:
    """Whether references are used: yes, unless a setting says no."""
    return ~F.lower(trimmed(F.coalesce(setting, F.lit("")))).isin(*OFF)


def opened(data: Column) -> Column:
    """Data in which no closing tag ends its block early."""
    return F.regexp_replace(data, rf"(?i)</({'|'.join(BLOCKS)})", "</ $1")


def attribute(value: Column) -> Column:
    return F.regexp_replace(value, r'["<>&]', " ")


def reference(kind: Column, author: Column, body: Column) -> Column:
    return F.concat(F.lit('<reference kind="'), kind, F.lit('" source="'), attribute(author), F.lit('">\n'), opened(body), F.lit("\n</reference>"))


def message(text: Column, references: Column, strength: Column, voice: Column) -> Column:
    """The user's turn: what differs from the standard first, then the text. references: an array of `reference`."""
    block = lambda name, data: F.concat(F.lit(f"<{name}>\n"), data, F.lit(f"\n</{name}>\n"))
    intensity = F.when(strength != STANDARD, F.concat(F.lit("<intensity>"), strength, F.lit("</intensity>\n")))
    own = F.when(trimmed(voice) != "", block("author_voice", opened(trimmed(voice))))
    refs = F.when(F.size(references) > 0, block("style_references", F.array_join(references, "\n")))
    return F.concat_ws("", intensity, own, refs, F.lit("<text>\n"), opened(text), F.lit("\n</text>"))
