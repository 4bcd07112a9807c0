"""Text functions over prose, as Column expressions that stay inside the JVM.

Character classes are spelled out with Unicode properties, because Java's bare word and space classes are ASCII.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits and patterns that results depend on.
MIN_WORDS, MAX_WORDS = 45, 150
SENTENCE_BREAK = r"""(?<=[.!?…»"”’])(?U:\s+)(?=["“«‘'—\-]?[A-ZÀ-Ý])"""
HEADING = r"(?i)^(chapter|book|part|volume|livre|chapitre|partie|tome|section)(?![\p{L}\p{N}_])"
LINK = r"https?://|www\.|@[\p{L}\p{N}_]+\."
MARKUP = r"[_\[\]{}*^]|(?<![\p{L}\p{N}_])[A-ZÀ-Ý]{4,}(?![\p{L}\p{N}_])"
JUNK = r"""[^\p{L}\p{N}_\s\x{A0}.,;:!?'’"“”«»()\-—–…%$&/]"""
#: A word with a capital after a small letter; what is read is never given back, so a long word costs its length.
ODD_CASE = r"(?<![\p{L}\p{N}_])(?:[a-zà-ÿ](?![A-ZÀ-Ý])|[\p{L}\p{N}_&&[^a-zà-ÿ]])*+[a-zà-ÿ][A-ZÀ-Ý][\p{L}\p{N}_]*+"
SAME_FOUR = r"(.)\1{3,}"
SENTENCE_TAIL = r"""[.!?…]+["”»’)]*(?U:\s+)"""
STRANGE_ACCENT = r"[áíóúñãõýåøščřž]"
WORD = r"\p{L}+(?:['’-]\p{L}+)*"
SPACES = r"(?U)[\s\x1c-\x1f]+"

#: Accented Latin letters and what is left of each without its marks, by Unicode's own decomposition.
_MARKED = [c for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if len(unicodedata.normalize("NFD", c)) > 1]
ACCENTED = "".join(_MARKED)
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in _MARKED)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def tokens(text: Column) -> Column:
    """What white space separates."""
    return F.array_remove(F.split(text, SPACES), "")


def word_count(text: Column) -> Column:
    return F.size(tokens(text))


def words(text: Column) -> Column:
    """Words of letters, with inner apostrophes and hyphens."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def fold(text: Column) -> Column:
    """Lower case without accents; marks that follow their letter are dropped too."""
    return F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), r"\p{Mn}+", "")


def clean_book(text: Column) -> Column:
    """Editors' notes, page marks and the underscores of italics go."""
    lines = F.regexp_replace(text, r"\r\n?", "\n")
    notes = F.regexp_replace(lines, r"(?is)\[(?:Illustration|Footnote|Transcriber|Note)[^\]]*\]", " ")
    pages = F.regexp_replace(notes, r"(?i)\[(?:Pg|Page)?\s*\d+\]", "")
    return F.regexp_replace(pages, r"(?<![\p{L}\p{N}_])_([^_\n]+)_(?![\p{L}\p{N}_])", "$1")


def squeezed(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def paragraphs(text: Column, separator: str = r"\n(?U:\s*)\n") -> Column:
    """Blocks between separators, each on one line; blank ones go."""
    return F.array_remove(F.transform(F.split(text, separator), squeezed), "")


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_BREAK)


def _counted(squeezed_text: Column) -> Column:
    """Words of a text whose words single spaces divide."""
    return F.length(squeezed_text) - F.length(F.translate(squeezed_text, " ", "")) + 1


def split_long(paragraph: Column, most: int = MAX_WORDS) -> Column:
    """A squeezed paragraph, or, when it has more words, its sentences packed into pieces of at most `most` words; a longer sentence stays whole.

    Pieces are structs of `passage` and `n_words`. Every sentence is counted once; packing adds numbers.
    """
    piece = lambda text, n: F.struct(text.alias("passage"), n.cast("int").alias("n_words"))
    empty = F.struct(F.array().cast("array<struct<passage:string,n_words:int>>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def add(state: Column, sentence: Column) -> Column:
        def step(full: Column) -> Column:
            return F.struct(
                F.when(full, F.concat(state["done"], F.array(piece(state["open"], state["n"])))).otherwise(state["done"]).alias("done"),
                F.when(full | (state["n"] == 0), sentence["passage"]).otherwise(F.concat_ws(" ", state["open"], sentence["passage"])).alias("open"),
                (F.when(full, 0).otherwise(state["n"]) + sentence["n_words"]).alias("n"),
            )

        return step((state["n"] > 0) & (state["n"] + sentence["n_words"] > most))

    parts = F.transform(sentences(paragraph), lambda s: piece(s, _counted(s)))
    packed = F.aggregate(parts, empty, add, lambda s: F.concat(s["done"], F.array(piece(s["open"], s["n"]))))
    return let(_counted(paragraph), lambda n: F.when(n <= most, F.array(piece(paragraph, n))).otherwise(packed))


def pieces(blocks: Column, least: int = MIN_WORDS, most: int = MAX_WORDS) -> Column:
    """Usable passages of paragraphs with their numbers of words, in reading order."""
    return F.filter(F.flatten(F.transform(blocks, lambda p: split_long(p, most))), lambda p: p["n_words"].between(least, most))


def windows(text: Column, least: int = MIN_WORDS, most: int = MAX_WORDS, separator: str = r"\n(?U:\s*)\n") -> Column:
    return pieces(paragraphs(clean_book(text), separator), least, most)


def trimmed_edges(blocks: Column) -> Column:
    """Paragraphs without the first and last twentieth, one at least, where front and back matter stand."""
    cut = F.greatest(F.floor(F.size(blocks) / 20).cast("int"), F.lit(1))
    return F.slice(blocks, cut + 1, F.greatest(F.size(blocks) - 2 * cut, F.lit(0)))


def letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{L}"))


def capitals(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{Lu}"))


def _share(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.greatest(whole, F.lit(1))


def is_prose(passage: Column) -> Column:
    """No heading, link, markup, verse or string of quotations."""
    n_letters = letters(passage)
    return (
        ~passage.rlike(LINK)
        & ~passage.rlike(MARKUP)
        & ~passage.rlike(HEADING)
        & (_share(n_letters, F.length(passage)) >= 0.78)
        & (_share(capitals(passage), n_letters) <= 0.12)
        & passage.rlike(r"""[.!?…"”»’]\z""")
        & (_share(F.regexp_count(passage, F.lit(r'["“«—]')), word_count(passage)) < 0.06)
    )


def sentence_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), SENTENCE_TAIL), lambda s: s.rlike(r"(?U)\S")))


def is_running_prose(text: Column) -> Column:
    """Sentences of 6 to 45 words, few digits, few capitalised words."""
    n, parts = F.size(words(text)), sentence_count(text)
    rest = F.slice(tokens(text), F.lit(2), F.greatest(word_count(text), F.lit(1)))
    capital = F.size(F.filter(rest, lambda t: t.rlike(r"^\p{Lu}")))
    return (
        (parts >= 2)
        & (n >= parts * 6)
        & (n <= parts * 45)
        & (_share(F.regexp_count(text, F.lit(r"\p{Nd}")), F.length(text)) <= 0.02)
        & (_share(capital, word_count(text) - 1) <= 0.30)
    )


def has_strange_accents(text: Column) -> Column:
    return F.regexp_count(text, F.lit(STRANGE_ACCENT)) >= 2


def char_noise(text: Column) -> Column:
    """The part of the noise report that needs no vocabulary."""
    return F.struct(
        (100 * F.regexp_count(text, F.lit(JUNK)).cast("double") / F.greatest(F.length(text), F.lit(1))).alias("junk_per_100"),
        F.regexp_count(text, F.lit(ODD_CASE)).cast("bigint").alias("bad_case_words"),
        F.regexp_count(text, F.lit(SAME_FOUR)).cast("bigint").alias("repeats"),
    )


def signature(text: Column) -> Column:
    """The first 160 letters and digits, lower case: equal for passages that begin alike."""
    return F.substring(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", ""), 1, 160)


def strip_boilerplate(raw: Column) -> Column:
    """What stands between the start line and the end marker of an e-book; an error without both in order."""
    marker = r"(?i)\*\*\*\s*{} OF (?:THE|THIS) PROJECT GUTENBERG EBOOK"
    start = r"(?is)\A.*?" + marker.format("START")[4:] + r"[^\n]*"
    between = F.regexp_extract(raw, start + "(.*?)" + marker.format("END")[4:], 1)
    first = F.regexp_instr(raw, F.lit(marker.format("START")))
    last = F.regexp_instr(raw, F.lit(marker.format("END")))
    return F.when((first > 0) & (last > first), between).otherwise(F.raise_error(F.lit("start and end markers not found")).cast("string"))


# Lines that belong to a page and not to its article, and lines after which the article is over.
PAGE_LINE = (
    r"(?iu)(?<![\p{L}\p{N}_])(subscribe|newsletter|sign up|sign in|log in|cookies?|privacy policy|terms of (use|service)|all rights reserved|copyright|"
    r"follow us|read more|related (articles|stories)|advertisement|click here|abonnez|abonnement|s'abonner|inscrivez|connectez|cookies|mentions l[ée]gales|"
    r"tous droits|lire aussi|à lire aussi|partager|suivez|publicit[ée]|reproduction interdite|newsletters?|cliquez)(?![\p{L}\p{N}_])"
)
FOOTER = r"(?iu)^(related|read more|more from|you may also|lire aussi|à lire aussi)"
PAGE_LINE_WORDS = 12


def clean_article(text: Column) -> Column:
    """An article's lines up to a footer, without short lines that name a page element, joined by blank lines."""
    lines = F.filter(F.transform(F.split(F.regexp_replace(text, "\r", ""), "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")

    def body(all_lines: Column) -> Column:
        ends = F.filter(F.transform(all_lines, lambda x, i: F.when(x.rlike(FOOTER), i)), lambda i: i.isNotNull())
        before = F.slice(all_lines, F.lit(1), F.coalesce(F.get(ends, F.lit(0)), F.size(all_lines)))
        return F.array_join(F.filter(before, lambda x: (word_count(x) >= PAGE_LINE_WORDS) | ~x.rlike(PAGE_LINE)), "\n\n")

    return let(lines, body)


def plain_html(html: Column) -> Column:
    """A page's text: scripts and tags go, block tags become line ends, the commonest entities are read."""
    bare = F.regexp_replace(html, r"(?is)<script(?:\s[^>]*)?>.*?</script>|<style(?:\s[^>]*)?>.*?</style>|<head(?:\s[^>]*)?>.*?</head>|<!--.*?-->", "")
    lines = F.regexp_replace(bare, r"(?i)<(?:/?(?:p|div|li|ul|ol|tr|table|h[1-6]|article|section|nav|header|footer|br)(?:\s[^>]*)?/?)>", "\n")
    text = F.regexp_replace(lines, r"<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text
