"""Why an edit is dropped: rules in a fixed order, of which the first that applies is the reason."""

from __future__ import annotations

from typing import NamedTuple

import regex

from inkwell.functions.edits import locate
from inkwell.functions.edits.figures import same_numbers
from inkwell.functions.edits.names import same_attribution
from inkwell.functions.edits.negation import flips_negation
from inkwell.functions.edits.units import same_units

# The limits of an answer and of one edit.
MAX_EDITS, MAX_GROWTH, LEAST_ROOM, MAX_SPAN = 40, 3, 200, 600
MARKUP = r"</?[a-z][^>]*>|\]\(|^\s*#{1,6}\s"
_MARKUP = regex.compile(MARKUP, regex.I)


def squash(text: str) -> str:
    return regex.sub(r"\s+", " ", locate.plain_typography(text)).strip().lower()


RULES = (
    ("unchanged", lambda a, b: squash(a) == squash(b)),
    ("span_too_long", lambda a, b: len(a) > MAX_SPAN),
    ("too_long", lambda a, b: len(b) > max(LEAST_ROOM, MAX_GROWTH * len(a))),
    ("markup", lambda a, b: bool(_MARKUP.search(b))),
    ("numbers_changed", lambda a, b: not same_numbers(a, b)),
    ("units_changed", lambda a, b: not same_units(a, b)),
    ("figures_swapped", lambda a, b: not same_attribution(a, b)),
    ("negation_changed", flips_negation),
)


def why_drop(original: str, replacement: str) -> str | None:
    return next((name for name, applies in RULES if applies(original, replacement)), None)


def guard_all(edits: list[tuple[str, str]]) -> list[str | None]:
    """The reason for each edit of one answer; what is kept beyond MAX_EDITS is too_many."""
    out, kept = [], 0
    for original, replacement in edits:
        reason = why_drop(original, replacement) or ("too_many" if kept >= MAX_EDITS else None)
        kept += reason is None
        out.append(reason)
    return out


class Outcome(NamedTuple):
    """id and place of a kept edit, or the reason it was dropped."""

    id: str | None
    reason: str | None
    original: str
    replacement: str
    start: int
    end: int


class Collector:
    """The same rules one edit at a time, as a stream brings them: the cap counts located edits, and refused ones too."""

    def __init__(self, text: str, taken: list[tuple[int, int]] | None = None, seen: int = 0, refused: int = 0) -> None:
        self.text, self.taken, self.seen, self.refused = locate.Text(text), [locate.Span(*t) for t in taken or []], seen, refused

    def add(self, original: str, replacement: str) -> Outcome:
        reason = why_drop(original, replacement)
        if reason is None and max(self.seen, self.refused) >= MAX_EDITS:
            reason = "too_many"
        at = None if reason else locate.locate_one(self.text, original, replacement, self.taken)
        if at is None:
            self.refused += reason is None
            return Outcome(None, reason or "not_found", original, replacement, -1, -1)
        self.seen += 1
        return Outcome(f"edit-{self.seen - 1}", None, *at)
