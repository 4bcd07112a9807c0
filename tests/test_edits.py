"""Edit checks: figures, units, names, denials, places."""

from __future__ import annotations

import pytest
import regex
from hypothesis import given
from hypothesis import strategies as st

from inkwell.functions.edits import figures, guard, locate, units
from inkwell.streaming.chunks import EventLines, Parser
from test_literals import CASES


@pytest.mark.parametrize(("original", "replacement", "reason"), CASES)
def test_verdicts(original, replacement, reason):
    assert guard.why_drop(original, replacement) == reason


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("12%", "12 percent", True), ("12%", "12-per-cent", True), ("12%", "12", False), ("3.5", "35", False), ("-5", "5", False), ("1,200", "1200", False), ("1,234,567", "1 234 567", True),
        ("1,234.567", "1234.567", True), ("12/03", "03/12", False), ("2019-2021", "2021 and 2019", True), ("2024-03-12", "2024 03 12", False), (".5", "0.5", True), ("10:30", "10.30", False),
    ],
)
def test_numbers(a, b, same):
    assert figures.same_numbers(a, b) is same


@given(st.text(alphabet="0123456789.,-/:% ab€\n", max_size=40))
def test_figures_are_where_they_say(text):
    for f in figures.figures_in(text):
        assert text[f.start : f.end] == f.written
    assert figures.same_numbers(text, text) and units.same_units(text, text)


def test_no_pattern_is_looked_up_for_a_figure(monkeypatch):
    """A call of the module takes longer than the match itself, at several calls a figure."""
    for name in ("search", "match", "fullmatch", "split", "sub"):
        monkeypatch.setattr(regex, name, lambda *a, **b: pytest.fail("a pattern that is not compiled"))
    text = "En 1999, 1 200,5 € payés, 12/03, $40 million, 5 US$ et 2500 million de dollars par mois"
    read = [units.read_figure(text, f) for f in figures.figures_in(text)]
    assert [r.scale for r in read] == ["", "", "", "million", "", "million"] and [r.units for r in read][3:] == [("dollar",), ("dollar",), ("dollar", "/month")]


def test_forty_edits_are_kept():
    words = ["".join(chr(97 + (i // 26**k) % 26) for k in range(3)) for i in range(45)]
    reasons = guard.guard_all([(w, w + "x") for w in words])
    assert reasons.count(None) == 40 and reasons.count("too_many") == 5


def test_places():
    assert [x[1].start for x in locate.locate_all("go go go", [("go", "a"), ("go", "b")])] == [0, 3]
    assert locate.locate_all("monkey", [("key", "x")]) == []
    assert locate.locate_all("It costs 1,200 now", [("1,", "x")]) == []
    (found,) = locate.locate_all("He said “it’s  fine” twice", [("it's fine", "all is well")])
    assert found[1].original == "it’s  fine"


def test_collector_numbers_by_arrival():
    keep = guard.Collector("crucial, truly crucial")
    assert [(o.id, o.start) for o in (keep.add("crucial", "key") for _ in range(3))] == [("edit-0", 0), ("edit-1", 15), (None, -1)]


@given(st.text(alphabet="ab c.\n", max_size=60), st.text(alphabet="ab c.", min_size=1, max_size=8), st.sampled_from(["", " ", "x"]))
def test_segments_cover_the_text(text, quote, replacement):
    spans = [(at.start, at.end) for _, at in locate.locate_all(text, [(quote, replacement), (quote, replacement)])]
    assert "".join(text[a:b] for _, a, b in locate.segments(text, spans)) == text


ANSWER = '{"edits":[{"original":"a {x}","replacement":"b \\"q\\" \\\\","reason":"r"},{"original":"only"},5,{"original":"c","replacement":"d","reason":""}]}'


@pytest.mark.parametrize("size", range(1, 13))
def test_any_cut_gives_the_same_edits(size):
    parser = Parser()
    found = [e["original"] for i in range(0, len(ANSWER), size) for e in parser.push(ANSWER[i : i + size])]
    assert found == ["a {x}", "c"]


def test_a_cut_answer_keeps_whole_edits():
    assert [e["original"] for e in Parser().push(ANSWER[:90])] == ["a {x}"]
    assert Parser().push("garbage } ] {") == []


def test_event_lines():
    reader = EventLines()
    assert reader.push('{"type":"start"}\nnoise\n{"ty') == [{"type": "start"}]
    assert reader.push('pe":"done","dropped":1}\n\n{"type":"x"}\n') == [{"type": "done", "dropped": 1}]


@pytest.mark.parametrize(
    ("a", "b", "flips"),
    [
        ("We don't sell software, we sell trust.", "We sell trust.", False),
        ("Not a cent was paid. The firm closed.", "The firm closed.", True),
        ("People don't buy products. They buy stories.", "People buy stories.", False),
        ("It's a marathon, not a sprint.", "It's a marathon.", False),
        ("It was not a bug. It was a choice.", "It was a choice.", False),
        ("It's not the price that matters, it's the timing.", "The timing matters.", False),
        ("It's not him who paid, it's Smith.", "He paid.", True),
        ("This isn't about speed. It's about trust.", "This is about trust.", False),
        ("Il n'a pas payé.", "Il a payé.", True),
        ("did not pass", "failed", False),
        ("did not fail", "failed", True),
        ("not available", "unavailable", False),
    ],
)
def test_denials(a, b, flips):
    from inkwell.functions.edits.negation import flips_negation

    assert flips_negation(a, b) is flips
