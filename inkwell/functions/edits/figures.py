"""Figures: written numbers, found whole and brought to one spelling."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import regex

# The grammar of a written number.
WHOLE = r"[0-9]{1,3}(?:[,.\p{Zs}'’][0-9]{3})+(?![0-9])|[0-9]+"
PART = rf"(?:(?:{WHOLE})(?:[.,][0-9]+)?|(?<![\p{{L}}\p{{N}}])[.,][0-9]+)"
SIGN = r"(?<![\p{L}\p{N})\]])(?<!\p{N}\s?[%‰°\p{Sc}'’\"])[\p{Pd}−](?:\p{Sc}\s?)?"
PERCENT_WORD = r"[\s\p{Pd}]?(?:p(?:er|our)[\s\p{Pd}]?cents?|pct)(?!\p{L})"
DATE = r"(?<![\p{L}\p{N}])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4})(?!\p{N})"

_NUMBER = regex.compile(rf"{DATE}|(?P<sign>{SIGN})?(?P<body>{PART}(?:[/:]{PART})*)(?P<per>\s?[%‰]|{PERCENT_WORD})?", regex.I)
_DIGIT = re.compile(r"[0-9]")
_MARK, _JOINT = re.compile(r"[^0-9]"), re.compile(r"([/:])")
_PART = regex.compile(rf"(?P<whole>{WHOLE})(?:[.,](?P<rest>[0-9]+))?")


class Figure(NamedTuple):
    """value: one spelling for all ways to write the same number; written, start, end: as it stands."""

    value: str
    written: str
    start: int
    end: int


def _one_spelling(part: str) -> str:
    """A part without separators of thousands and with a point for decimals; parts that read two ways stay as they are."""
    if part.isascii() and part.isdigit():
        return part
    if part[0] in ",.":
        return "0." + part[1:]
    found = _PART.fullmatch(part)
    if found is None:
        return part
    groups = _MARK.split(found["whole"])
    marks = "".join(c if c in ",." else " " for c in found["whole"] if c not in "0123456789")
    tail = [found["rest"]] if found["rest"] is not None else []
    if len(set(marks)) > 1:  # a last mark unlike the others before it is the decimal one
        if tail or marks[-1] == " " or len(set(marks[:-1])) > 1:
            return part
        groups, tail = groups[:-1], groups[-1:]
    elif not tail and marks in (",", "."):  # 1,200 is twelve hundred or one point two
        return part
    return ".".join(["".join(groups), *tail])


def _numbers(text: str) -> Iterator[regex.Match]:
    """The matches of _NUMBER, looked for only where a digit is: a sign, a currency, a space and a mark may stand before it."""
    at = 0
    while digit := _DIGIT.search(text, at):
        m = _NUMBER.search(text, max(at, digit.start() - 4))
        yield m
        at = m.end()


def figures_in(text: str) -> list[Figure]:
    return list(_figures(text))


@lru_cache(maxsize=4)  # the checks of an edit ask for the same two texts in turn
def _figures(text: str) -> tuple[Figure, ...]:
    found = []
    for m in _numbers(text):
        if m["body"] is None:  # a date
            value = "-".join(_one_spelling(p) for p in m[0].split("-"))
        else:
            joined = "".join(p if p in "/:" else _one_spelling(p) for p in _JOINT.split(m["body"]))
            per = (m["per"] or "").strip()
            value = ("-" if m["sign"] else "") + joined + ("" if not per else per if per in "%‰" else "%")
        found.append(Figure(value, m[0], m.start(), m.end()))
    return tuple(found)


def same_numbers(a: str, b: str) -> bool:
    """The same figures, in any order."""
    return sorted(f.value for f in figures_in(a)) == sorted(f.value for f in figures_in(b))
