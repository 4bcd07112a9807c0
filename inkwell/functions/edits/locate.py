"""Where an edit's quote stands in a text, and what the edit takes along. Offsets are code points."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import regex

from inkwell.functions.edits.figures import same_numbers
from inkwell.functions.edits.units import same_units

# Typography that is retyped, and the marks that decide about spaces and figures.
RETYPED = {"‘": "'", "’": "'", "“": '"', "”": '"', " ": " ", " ": " ", "‑": "-"}
_RETYPED = str.maketrans(RETYPED)
_MARK = {
    "figure": r"[\p{Pd}\p{Sc}−,.:/%‰'’]",
    "unit": r"[\p{Sc}%‰]",
    "closes word": r"[)\]}”’»%‰\p{Sc}?!]",
    "opens word": r"[(\[{“‘«¿¡\p{Sc}]",
    "opens": r"""[(\[{«“‘"'¿¡–—*]""",
    "closes": r"""[.,;:!?…)\]}»”’"'–—*]""",
    "french": r"[:;!?»]",
    "no space after": r"[(\[{¿¡“‘]",
    "no space before": r"[.,…)\]}]",
}
_IS = {name: regex.compile(pattern) for name, pattern in _MARK.items()}
_SETS_LEFT = regex.compile(r"[\s\p{Pd}−'’.,;:!?…)\]}”»]")
_SETS_RIGHT = regex.compile(r"[\s\p{Pd}−'’(\[{¿¡“‘]$")
_WORD_END = regex.compile(r"(?![️⃣])[\p{L}\p{N}\p{M}]")
_WORD_START = regex.compile(r"[\p{L}\p{N}\p{M}]")


class Span(NamedTuple):
    start: int
    end: int

    def meets(self, other: Span) -> bool:
        return self.start < other.end and other.start < self.end


class Located(NamedTuple):
    original: str
    replacement: str
    start: int
    end: int


def plain_typography(text: str) -> str:
    return text.translate(_RETYPED)


class Text:
    """A text with the tests that are asked about its positions."""

    def __init__(self, text: str) -> None:
        self.text = text
        self._folded: tuple[str, list[int]] | None = None

    def at(self, i: int) -> str:
        return self.text[i] if 0 <= i < len(self.text) else ""

    def is_(self, kind: str, i: int) -> bool:
        return bool(_IS[kind].match(self.at(i)))

    def digit(self, i: int) -> bool:
        return self.at(i) != "" and self.at(i) in "0123456789"

    def blank(self, i: int) -> bool:
        return self.at(i).isspace()

    def word_ends(self, i: int) -> bool:
        return bool(_WORD_END.match(self.at(i - 1)))

    def word_starts(self, i: int) -> bool:
        return bool(_WORD_START.match(self.at(i)))

    def ends_like_word(self, i: int) -> bool:
        return self.word_ends(i) or self.is_("closes word", i - 1)

    def starts_like_word(self, i: int) -> bool:
        return self.word_starts(i) or self.is_("opens word", i)

    def cuts_word(self, span: Span) -> bool:
        return any(self.word_ends(i) and self.word_starts(i) for i in span)

    def cuts_figure(self, span: Span) -> bool:
        """Whether digits and their mark are parted: an apostrophe counts between digits, a dash not after a letter."""
        last, first = span.end - 1, span.start
        if self.digit(span.end) and self.is_("figure", last):
            groups = self.at(last) not in "'’" or self.digit(last - 1)
            parts = regex.match(r"\p{Pd}", self.at(last)) and regex.match(r"\p{L}", self.at(last - 1))
            if groups and not parts:
                return True
        return self.digit(first - 1) and (self.is_("unit", first) or (self.is_("figure", first) and self.digit(first + 1)))

    def usable(self, span: Span, taken: list[Span]) -> bool:
        return not (self.cuts_word(span) or self.cuts_figure(span) or any(span.meets(t) for t in taken))

    def folded(self) -> tuple[str, list[int]]:
        """Plain typography with single spaces and no outer ones, and where each character stands."""
        if self._folded is None:
            self._folded = fold(self.text)
        return self._folded


def fold(text: str) -> tuple[str, list[int]]:
    out, places = [], []
    for m in regex.finditer(r"\s+|\S", plain_typography(text)):
        if m[0].isspace() and (not out or m.end() == len(text)):
            continue
        out.append(" " if m[0].isspace() else m[0])
        places.append(m.start())
    return "".join(out), places


def _occurrences(text: str, quote: str) -> Iterator[int]:
    at = text.find(quote)
    while at != -1:
        yield at
        at = text.find(quote, at + 1)


def find(text: Text, quote: str, taken: list[Span]) -> tuple[Span, bool] | None:
    """(span, exact?) of the first usable place: as written, or else in plain typography."""
    for at in _occurrences(text.text, quote):
        if text.usable(span := Span(at, at + len(quote)), taken):
            return span, True
    needle = fold(quote)[0]
    if needle:
        flat, places = text.folded()
        for at in _occurrences(flat, needle):
            if text.usable(span := Span(places[at], places[at + len(needle) - 1] + 1), taken):
                return span, False
    return None


def _fitted(text: Text, span: Span, original: str, replacement: str) -> str:
    """A loosely found quote leaves its outer spaces out, so its replacement does too, unless a word follows directly."""
    if original[:1].isspace() and not text.ends_like_word(span.start):
        replacement = replacement.lstrip()
    if original[-1:].isspace() and not text.starts_like_word(span.end):
        replacement = replacement.rstrip()
    return replacement


def _deletion(text: Text, span: Span, taken: list[Span]) -> Span:
    """What a deletion takes along so that no double space, blank line or stray space stays behind."""
    whole = text.text
    body = whole[span.start : span.end]
    if not body.strip():
        return span
    first = span.start + len(body) - len(body.lstrip())
    last = span.end - (len(body) - len(body.rstrip()))
    left_edge, right_edge = len(whole[:first].rstrip()), len(whole) - len(whole[last:].lstrip())
    left, right = whole[left_edge:first], whole[last:right_edge]
    to_right, to_left = Span(first, right_edge), Span(left_edge, last)
    free = lambda s: not any(s.meets(t) for t in taken)

    def wanted() -> Span:
        if left_edge == 0 and (right_edge == len(whole) or "\n" not in right):
            return Span(span.start, right_edge)
        if right_edge == len(whole):
            return Span(left_edge, span.end)
        if left_edge > 0 and right.count("\n") > left.count("\n"):
            return Span(left_edge, whole.index("\n", last))
        if "\n" in right:  # a word alone on its lines
            return Span(left_edge + left.rfind("\n") + 1, last + right.rfind("\n") + 1)
        if left and "\n" not in left and text.is_("french", right_edge) and free(to_left):
            return to_left
        if left and (right or "\n" in left):
            return to_right
        if left and text.is_("closes", right_edge):
            return to_left
        if right and text.is_("opens", left_edge - 1):
            return to_right
        return Span(first, last)

    if free(wide := wanted()):
        return wide
    return to_left if free(to_left) and "\n" not in left else Span(first, last)


def _outer_space_kept(text: Text, span: Span, original: str, replacement: str) -> Span:
    """A quote's outer space stays in the text where the replacement lost it and words would join."""
    if not original.strip():
        return span
    before, after = original[: len(original) - len(original.lstrip())], original[len(original.rstrip()) :]

    def stays(outer: str, beside: int, barred: str, decides: bool) -> bool:
        return bool(outer) and not decides and text.at(beside) != "" and (not text.blank(beside) or "\n" in outer) and not text.is_(barred, beside)

    start = span.start + len(before) * stays(before, span.start - 1, "no space after", bool(_SETS_LEFT.match(replacement)))
    end = span.end - len(after) * stays(after, span.end, "no space before", bool(_SETS_RIGHT.search(replacement)))
    return Span(start, end)


def locate_one(text: Text, original: str, replacement: str, taken: list[Span]) -> Located | None:
    """The edit at its place, which is added to taken; None where the quote is absent or taken, or a figure or unit of the text would change."""
    if not original or original == replacement:
        return None
    found = find(text, original, taken)
    if found is None:
        return None
    span, exact = found
    written = replacement if exact else _fitted(text, span, original, replacement)
    if original.strip() and "\n" not in written and not written.strip():
        written = ""
    if not written:
        span = _deletion(text, span, taken)
        spaced = any(c.isspace() and c != "\n" for c in replacement)
        if spaced and text.ends_like_word(span.start) and text.starts_like_word(span.end):
            written = " "
    elif exact:
        span = _outer_space_kept(text, span, original, replacement)
    after = text.text[: span.start] + written + text.text[span.end :]
    if not same_numbers(text.text, after) or not same_units(text.text, after):
        return None
    taken.append(span)
    return Located(text.text[span.start : span.end], written, *span)


def locate_all(text: str, edits: Iterable[tuple[str, str]]) -> list[tuple[int, Located]]:
    """(number of the edit, its place) in the order of the text, for edits in the order of arrival."""
    whole, taken = Text(text), []
    found = [(k, at) for k, (original, replacement) in enumerate(edits) if (at := locate_one(whole, original, replacement, taken))]
    return sorted(found, key=lambda x: x[1].start)


def segments(text: str, spans: Iterable[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """("text" or "edit", start, end) that cover the text, for spans in order."""
    out, at = [], 0
    for start, end in spans:
        out += [("text", at, start)] * (start > at) + [("edit", start, end)]
        at = end
    return out + [("text", at, len(text))] * (at < len(text))
