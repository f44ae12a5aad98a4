"""Scrubbers and name functions on hand-made texts."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import names, scrub


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("they saw Max in 2003 and owed $7", "they saw [NAME] in [NUMBER] and owed [NUMBER]"),
        ("The hills. Nobody came.", "The hills. Nobody came."),
        ("Anna Lee left", "[NAME] left"),
        ("near Mr. Brown, who", "near [NAME], who"),
        ("we like U.S. Steel and I'm glad", "we like [NAME] and I'm glad"),
        ('then "Egypt, said I', 'then "[NAME], said I'),
        ("only 5 of 10% or 9/11", "only 5 of [NUMBER] or [NUMBER]"),
        ("", ""),
        (None, ""),
    ],
)
def test_entities(text, expected):
    assert scrub.strip_entities(text) == expected
    assert scrub.strip_entities(expected) == expected, "doing it twice changes nothing"


def test_entity_density():
    assert scrub.density("they saw Max in 2003 and owed $7") == 3 / 8 and scrub.density("") == 0.0


@pytest.mark.parametrize(
    ("prompt", "expected", "removed"),
    [
        ("HOST: With GUEST, director of plays, tonight.", "HOST: With GUEST, [DESCRIPTION REMOVED], tonight.", 1),
        ("HOST: GUEST, who was U.S. envoy and ambassador there, now with the Garden Society, what did you see?", "HOST: GUEST, [DESCRIPTION REMOVED], what did you see?", 1),
        ("GUEST is Jo.\nGUEST: GUEST is an economist from here.", "GUEST is Jo.\nGUEST: GUEST is [DESCRIPTION REMOVED].", 1),
        ("HOST: GUEST, a friend of mine, came.", "HOST: GUEST, a friend of mine, came.", 0),
        (None, "", 0),
    ],
)
def test_affiliations(prompt, expected, removed):
    assert scrub.scrub_affiliations(prompt) == (expected, removed)


def test_address():
    forms = scrub.host_forms(["AL STONE, HOST", "J. Q. Vane", "42, HOST"])
    assert forms == ["J. Q. Vane", "AL STONE", "STONE", "Vane"]
    assert scrub.strip_address("Oh, well, Al Stone, you know, it rains.", forms) == "It rains."
    assert scrub.strip_address("It rains, as you said, a lot.", forms) == "It rains, a lot."
    long = "Well, we all think that it will rain a lot more than it did."
    assert scrub.strip_set([long, "It is dry here."], forms) == (["We all think that it will rain a lot more than it did.", "It is dry here."], True)
    assert scrub.strip_set([long, "Sure, Stone."], forms) == ([long, "Sure, Stone."], False), "one that would lose too much keeps them all"


def test_guards(spark):
    d = spark.createDataFrame([("Ask.\n\nA. yes\nB. no",), ("Give a probability for each option",), ("Say it.",), (None,)], "p string")
    got = d.select(scrub.choice_residue(F.col("p")).alias("r"), scrub.tail(F.col("p")).alias("t")).collect()
    assert [list(x["r"]) for x in got] == [["option_line"], ["distribution_instruction"], [], []]
    assert [x["t"] for x in got] == ["A. yes\nB. no", "Give a probability for each option", "Say it.", None]


def test_names(spark):
    d = spark.createDataFrame([("J. Doe",), ("De Niro",), ("Robert St. John",), ("",), (None,), ("Dr. Matthew Oz",)], "n string")
    n = F.col("n")
    got = d.select(names.initial_form(n).alias("i"), names.particle_only(n).alias("p"), F.array_join(names.nickname_forms(n, ["DR"]), ";").alias("f"), names.punct_key(n).alias("k"), names.generic(n, ["ROBERT"], ["JOHN"]).alias("g")).collect()
    assert [r["i"] for r in got] == [True, False, False, False, False, False]
    assert [r["p"] for r in got] == [False, True, False, False, False, False]
    assert got[2]["f"] == "Bob St. John;Bobby St. John;Rob St. John;Robbie St. John" and got[5]["f"] == "Dr. Matt Oz;Dr. Matty Oz" and got[4]["f"] == ""
    assert got[0]["k"] == "JDOE" and got[2]["g"]
    s = spark.createDataFrame([("One came. Two  saw it!\nNo.",), ("nothing",)], "t string").select(names.sentence_around(F.col("t"), "saw").alias("s")).collect()
    assert [r["s"] for r in s] == ["Two saw it!", None]
