"""Denials, unit and name checks: pairs with the verdict each rule gives."""

from __future__ import annotations

import pytest

from inkwell.functions.edits.guard import why_drop
from inkwell.functions.edits.negation import PHRASES, flips_negation
from inkwell.functions.edits.units import read_figure, reads_as_unit
from inkwell.functions.edits.figures import figures_in

FLIPPED = [
    ("The bridge is not open.", "The bridge is open."),
    ("The bridge is open.", "The bridge is not open."),
    ("Le pont n'est pas ouvert.", "Le pont est ouvert."),
    ("Il ne viendra pas demain, c'est trop tard.", "Il viendra, c'est trop tard."),
    ("Acme is not the sole owner in Ohio. It is a tenant.", "Acme is the owner. It is a tenant."),
    ("No more than 12 seats are left.", "More than 12 seats are left."),
    ("No doubt remains about the tests.", "Doubt remains about the tests."),
    ("Ce n'est un secret pour personne.", "C'est un secret."),
    ("The rail line was not rebuilt in June. It was slow.", "The rail line was rebuilt. It was slow."),
    ("It is not true that rents rose, it is a rumour.", "It is true that rents rose, it is a rumour."),
    ("The council did not fail.", "The council failed."),
    ("Not a seat was sold. The hall closed.", "The hall closed."),
    ("Nobody signed the letter.", "They signed the letter."),
    ("Elle ne peut accepter ce prix.", "Elle accepte ce prix."),
    ("Personne n'a voté.", "On a voté."),
    ("He can't just leave.", "He can leave."),
    ("The harbour has never been better than last year.", "The harbour has been better than last year."),
    ("The boat is safe.", "The boat is not approved. It is safe."),
    ("She sold the shop without a receipt.", "She sold the shop with a receipt."),
    ("The mill isn't so much old as noisy and old.", "The mill is noisy and old."),
]
KEPT = [
    ("It is no exaggeration to say it works.", "It works."),
    ("Needless to say, not to mention the cost, it works.", "It works."),
    ("This isn't about tools. It's about habits.", "This is about habits."),
    ("It's not just a shop, it's a school.", "It's a school."),
    ("We don't rent rooms, we host people.", "We host people."),
    ("Farmers don't sell land. They sell time.", "Farmers sell time."),
    ("It's a walk, not a race.", "It's a walk."),
    ("Not a tool. A method.", "A method."),
    ("Ce n'est pas seulement un outil, c'est une méthode.", "C'est une méthode."),
    ("Il ne s'agit pas de vitesse, mais de soin.", "Il s'agit de soin."),
    ("It was not a mistake. It was a choice.", "It was a choice."),
    ("It's not the colour that counts, it's the shape.", "The shape counts."),
    ("The key is not available.", "The key is unavailable."),
    ("The pump did not start.", "The pump failed to start."),
    ("They do not often write.", "They rarely write."),
    ("Un pas en avant, il marche.", "Il marche."),
    ("The No. 7 tram is late.", "The tram number 7 is late."),
    ("Cette personne n'a que 3 ans.", "Cette personne a 3 ans."),
    ("Not only fast, but also cheap.", "Fast and cheap."),
    ("Nothing but a habit.", "Only a habit."),
    ("Sans aucun doute, le pont tient.", "Le pont tient."),
    ("La ville n'a jamais été aussi calme.", "La ville est calme."),
    ("The door is not open.", "The door isn't open."),
]
OTHER = [
    ("units_changed", "It costs $40.", "It costs 40 euros."),
    ("units_changed", "a debt of 3 million", "a debt of 3"),
    ("units_changed", "between 3 and 5 million", "between 3 thousand and 5 million"),
    ("units_changed", "500 €/mois", "500 € par an"),
    ("units_changed", "$5B of sales", "$5M of sales"),
    (None, "It costs $40.", "It costs 40, in dollars."),
    (None, "39 degrés Celsius", "39 °C"),
    (None, "50 km/h in town", "50 kph in town"),
    ("figures_swapped", "Orion sold 40 and Vega 50.", "Orion sold 50 and Vega 40."),
    (None, "Orion sold 40 and Vega 50.", "Vega sold 50 and Orion 40."),
    ("numbers_changed", "It took 3 days.", "It took 4 days."),
]


@pytest.mark.parametrize(("a", "b"), FLIPPED)
def test_flipped(a, b):
    assert why_drop(a, b) == "negation_changed"


@pytest.mark.parametrize(("a", "b"), KEPT)
def test_kept(a, b):
    assert not flips_negation(a, b) and why_drop(a, b) is None


@pytest.mark.parametrize(("reason", "a", "b"), OTHER)
def test_other_rules(reason, a, b):
    assert why_drop(a, b) == reason


def test_a_phrase_denies_nothing_by_itself():
    """Every plain phrase of the list can go without a verdict."""
    plain = [p for p in PHRASES if not set(p) & set("(?[\\^$")]
    assert len(plain) > 40 and not any(flips_negation(f"They came, {p}, by train.", "They came, by train.") for p in plain if p != "un rien")


def test_readings():
    read = lambda text: read_figure(text, figures_in(text)[0])
    assert read("3 millions d'euros")[:] == ("million", "", ("euro",))
    assert read("In 2018 millions left")[:] == ("", "million", ())
    assert read("5 US$").units == ("dollar",) and read("USD 5").units == ("dollar",)
    assert read("40 € par an").units == ("euro", "/year") and read("5 kilowatt-hours").units == ("kwh",)
    assert reads_as_unit("GB") and reads_as_unit("Md") and not reads_as_unit("Orion")
