"""Functions over catalogue and web metadata, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.text import squeezed

# Cut-offs, licences, languages, kinds and labels.
LATEST_DEATH_YEAR, LATEST_YEAR, LATEST_CRAWL_YEAR = 1955, 1950, 2022
MIN_DOC_WORDS, MIN_ARTICLE_WORDS, MAX_ARTICLE_WORDS = 500, 250, 6000
LANGUAGES = {"English": "en", "French": "fr"}
PUBLIC_DOMAIN = ("Public Domain", "Publc Domain")
KIND_BY_COLLECTION = {
    "English-PD": "book",
    "US-PD-Books": "book",
    "LoC-PD-Books": "book",
    "French-PD-Books": "book",
    "French-PD-diverse": "book",
    "Wikisource": "book",
    "Europeana": "book",
    "US-PD-Newspapers": "news",
    "French-PD-Newspapers": "news",
    "NewZealand-PD-Newspapers": "news",
}
NEWS_LABEL = {"US-PD-Newspapers": "US newspaper", "NewZealand-PD-Newspapers": "New Zealand newspaper", "French-PD-Newspapers": "Presse française"}
SECOND_LEVEL = ("co", "com", "org", "gov", "ac")
DATES = r"([0-9]{4})\s*-\s*([0-9]{4})"


def lookup(value: Column, table: dict[str, str]) -> Column:
    """The table's entry for a value, or null."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[value]


def parse_author(raw: Column) -> Column:
    """struct(name, death): the first credited author, given name first, and the year of death."""
    first = F.trim(F.regexp_replace(F.split(raw, ";")[0], r"\[[^\]]+\]", ""))
    death = F.nullif(F.regexp_extract(first, DATES, 2), F.lit("")).cast("int")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(first, DATES, ""), r"\([^)]*\)", ""), r"^[ ,]+|[ ,]+$", "")
    last, given = F.regexp_extract(bare, r"(?s)^([^,]*),", 1), F.regexp_extract(bare, r"(?s)^[^,]*,(.*)$", 1)
    return F.struct(squeezed(F.when(bare.contains(","), F.concat_ws(" ", F.trim(given), F.trim(last))).otherwise(bare)).alias("name"), death.alias("death"))


def short_title(raw: Column) -> Column:
    """The first line up to a colon or a spaced dash."""
    return F.trim(F.split(F.split(raw, "\n")[0], ":| — ")[0])


def public_domain(death_year: Column) -> Column:
    return F.coalesce(death_year <= LATEST_DEATH_YEAR, F.lit(False))


def host(url: Column) -> Column:
    """A URL's host in lower case without "www."; empty where there is none."""
    return F.regexp_replace(F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit("")), r"^www\.", "")


def registered_domain(url: Column) -> Column:
    """The last two labels of the host, or three under a two-letter country's second level."""
    parts = F.split(host(url), r"\.")
    n = F.size(parts)
    three = (n >= 3) & F.get(parts, n - 2).isin(*SECOND_LEVEL) & (F.length(F.get(parts, n - 1)) == 2)
    take = F.when(three, 3).otherwise(2)
    return F.array_join(F.slice(parts, F.greatest(n - take, F.lit(0)) + 1, take), ".")


def suffixes(name: Column) -> Column:
    """A host and all its parent domains."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def host_suffixes(url: Column) -> Column:
    """A URL's host and all its parent domains, so that a list of sites can be joined by equality."""
    return suffixes(host(url))


def matching_site(url: Column, sites: Sequence[str]) -> Column:
    """The listed site that a URL belongs to, itself or a subdomain; null where none. For short lists: see operators.web for joins."""
    return F.get(F.filter(host_suffixes(url), lambda s: s.isin(*sites)), F.lit(0))


def crawl_year(dump: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(dump, F.lit("")), r"([0-9]{4})", 1), F.lit("")).cast("int")


_CP1252 = str.maketrans({"\x91": "‘", "\x92": "’", "\x93": "“", "\x94": "”", "\x96": "–", "\x97": "—", "\x85": "…", "\xa0": " "})


def fix_mojibake(text: Column) -> Column:
    """UTF-8 that was read as Latin-1 is read again; invisible Windows-1252 punctuation becomes visible."""
    latin = text.rlike(r"[ÃÂ]") & text.rlike(r"\A[\x{00}-\x{FF}]*\z")
    raw = F.encode(F.when(latin, text), "ISO-8859-1")
    again = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    return F.translate(F.coalesce(again, text), "".join(map(chr, _CP1252)), "".join(_CP1252.values()))


def clean_value(value: Column) -> Column:
    """Trimmed; null, blank and "None" are empty."""
    text = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    return F.when(text.isin("", "None", "NaN"), F.lit("")).otherwise(fix_mojibake(text))


def credit_for(title: Column, creator: Column, collection: Column, year: Column) -> Column:
    """struct(credit, title): the author, else the title, else where and when a document comes from."""
    name, head = parse_author(F.split(clean_value(creator), r"\|")[0])["name"], clean_value(title)
    label = F.coalesce(lookup(collection, NEWS_LABEL), F.lit("Book"))
    when = F.floor(year).cast("bigint").cast("string")
    return (
        F.when(name != "", F.struct(name.alias("credit"), F.coalesce(F.nullif(head, F.lit("")), name).alias("title")))
        .when(head != "", F.struct(head.alias("credit"), head.alias("title")))
        .otherwise(F.struct(F.concat(label, F.lit(" ("), when, F.lit(")")).alias("credit"), F.concat(label, F.lit(", "), when).alias("title")))
    )


def selected(open_type: Column, language: Column, license: Column, collection: Column, date: Column, n_words: Column) -> Column:
    """Open-licence books and papers in a known language, dated and old enough, of some length."""
    return (
        (open_type == "Open Culture")
        & language.isin(*LANGUAGES)
        & license.isin(*PUBLIC_DOMAIN)
        & collection.isin(*KIND_BY_COLLECTION)
        & date.isNotNull()
        & (date <= LATEST_YEAR)
        & (n_words >= MIN_DOC_WORDS)
    )
