"""Text, parsing, date and distribution functions on golden values."""

import math

import pytest
from pyspark.sql import functions as F

from tessella.functions import dates, dist, parse
from tessella.functions import text as tx


@pytest.fixture(scope="module")
def value(spark):
    """The value of a Column over one row."""
    one = spark.range(1)
    return lambda column: one.select(column.alias("v")).first()["v"]


def test_words(value):
    assert value(tx.word_count(F.lit("  a  b\nc "))) == 3
    assert value(tx.word_count(F.lit(""))) == 0 and value(tx.word_count(F.lit(None).cast("string"))) == 0
    assert value(tx.squeeze(F.lit(" a \n b "))) == "a b"
    assert value(tx.first_word(F.lit("(laughs) [aside] “Well, then"))) == "well"
    assert value(tx.first_word(F.lit(""))) == ""
    assert value(tx.word_set(F.lit("The the, THE cat."))) == ["the", "cat"]
    assert value(tx.first_words(F.lit("a b c"), 2)) == "a b ..." and value(tx.last_words(F.lit("a b c"), 2)) == "... b c"


@pytest.mark.parametrize(("a", "b", "expected"), [([], [], 1.0), (["a"], [], 0.0), (["a", "b"], ["b", "c"], 1 / 3)])
def test_jaccard(value, a, b, expected):
    lit = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    assert value(tx.jaccard(lit(a), lit(b))) == pytest.approx(expected)


def test_grams(value):
    w = tx.words(F.lit("a b c d"))
    assert value(tx.ngrams(w, 3)) == ["a b c", "b c d"] and value(tx.ngrams(w, 5)) == []
    assert len(value(tx.shingles(w, 5))) == 1 and value(tx.shingles(tx.words(F.lit("")), 5)) == []
    assert value(tx.tokens(F.lit("Été a bb, naïve"))) == ["été", "bb", "naïve"]


def test_names(value):
    assert value(tx.title_case(F.lit("O'BRIEN mary-ann"))) == "O'Brien Mary-Ann"
    assert value(tx.name_key(F.lit("Sen. John  Q. Public"))) == "john q public"
    assert tuple(value(tx.speaker(F.lit("JOHN DOE, HOST")))) == ("host", "John Doe")
    assert value(tx.redact(F.lit("Senator Smith met Smithsonian staff and Smith."), ["Smith"])) == "[NAME] met Smithsonian staff and [NAME]."
    assert value(tx.contains_run(tx.words(F.lit("b c")), tx.words(F.lit("a b c")))) and not value(tx.contains_run(tx.words(F.lit("a c")), tx.words(F.lit("a b c"))))


def test_cells_and_pairs(value):
    got = value(tx.transcript_cells(F.lit("NPR-1|2001-02-03|A; B|cl1|S;CNN-22|2002-03-04|C|cl2|-")))
    assert [(r["transcript_id"], r["program"], r["substantive"]) for r in got] == [("NPR-1", "A; B", True), ("CNN-22", "C", False)]
    assert value(tx.decode_pairs(F.lit("1=Male, 2=Female, or other, 3=Other"))) == {1: "Male", 2: "Female, or other", 3: "Other"}
    assert value(tx.era_violations(F.lit("in 1999 and 2030, not 12030"), F.lit(2001))) == ["2030"]


def test_density(value):
    assert value(tx.entity_density(F.lit("we met Rex in 1997 and paid $5"))) == pytest.approx(3 / 8)
    assert [value(tx.density_bucket(F.lit(x))) for x in (0.02, 0.08, 0.081)] == ["Z", "L", "H"]


def test_question_type(value):
    cues = {"factual": ["when", "how many"], "opinion": ["think", "do you think"]}
    kind = lambda t: value(tx.question_type(F.lit(t), cues))
    assert (kind("Do you think so?"), kind("When, and how many?"), kind("Hm."), kind("when do you think")) == ("opinion", "factual", "unclear", "factual")


@pytest.mark.parametrize(("text", "expected"), [("5", 5), ("5 or 6", None), ("9", None), ("", None), ("10", None)])
def test_strict_digit(value, text, expected):
    assert value(parse.strict_digit(F.lit(text))) == expected


@pytest.mark.parametrize(("text", "expected"), [("sentence\n6", 6), ("3 then 4", 4), ("10", None), ("88", None), ("", None), (None, None)])
def test_last_digit(value, text, expected):
    assert value(parse.last_digit(F.lit(text).cast("string"))) == expected


def test_scale_distribution(value):
    d = parse.scale_distribution(F.lit("1:0.05 2:0.10 3:0.15 4:0.30 5:0.20 6:0.15 7:0.05"))
    assert value(dist.argmax(d)) == 4 and value(dist.expected_value(d)) == pytest.approx(4.15)
    for bad in ("1:0.5 2:0.5", "1:1 1:1 2:1 3:1 4:1 5:1 6:1", "1:0 2:0 3:0 4:0 5:0 6:0 7:0", "1:-1 2:1 3:1 4:1 5:1 6:1 7:1", ""):
        assert value(parse.scale_distribution(F.lit(bad))) is None
    assert value(dist.argmax(parse.scale_distribution(F.lit("1:0.2 2:0.2 3:0 4:0 5:0 6:0 7:0")))) == 1


def test_options(value):
    assert value(parse.option_distribution(F.lit("A: 0.7 B: 0.1 C: 0.1 D: 0.1"))) == pytest.approx([0.7, 0.1, 0.1, 0.1])
    assert value(parse.option_distribution(F.lit("D: 10% C: 20% B: 30% A: 40%"))) == pytest.approx([0.4, 0.3, 0.2, 0.1])
    for bad in ("A: 0.7 B: 0.1", "A: 2 B: 1 C: 1 D: 1", "A: 40% B: 0.3 C: 20% D: 10%"):
        assert value(parse.option_distribution(F.lit(bad))) is None


def test_labels_blocks_and_times(value):
    assert value(parse.label_line(F.lit("well\n new-topic \n"), ["NEW-TOPIC", "FOLLOW-UP"])) == "NEW-TOPIC"
    assert value(parse.label_line(F.lit("NEW-TOPIC\nFOLLOW-UP"), ["NEW-TOPIC", "FOLLOW-UP"])) is None
    got = value(parse.numbered_blocks(F.lit("x <<<1>>> one\n<<<2>>> two <<<1>>> again")))
    assert [(r["k"], r["text"]) for r in got] == [(1, "one"), (2, "two")]
    assert value(parse.elapsed_seconds(F.lit("1-02:03:04"))) == 93784 and value(parse.elapsed_seconds(F.lit("2:03"))) is None


@pytest.mark.parametrize(("text", "quality"), [("2001-02-03", "ok"), ("2001-2-3", "ok_padding_fixed"), ("0012-01-02", "implausible_year"), ("2001-13-01", "invalid_calendar"), ("June", "unparseable"), ("", "missing"), (None, "missing")])
def test_dates(value, text, quality):
    got = value(dates.tolerant_date(F.lit(text).cast("string")))
    assert got["quality"] == quality and (got["date"] is not None) == quality.startswith("ok")


def test_day_bins(value):
    assert [value(dates.day_bin(F.lit(d))) for d in (0, 182, 183, 364, 365, 730, 1094, 1095)] == ["<6m", "<6m", "6-12m", "6-12m", "12-24m", "24-36m", "24-36m", "36m+"]


def test_distances(value):
    half = F.create_map(F.lit(1), F.lit(0.5), F.lit(2), F.lit(0.5))
    assert value(dist.entropy(half)) == pytest.approx(math.log(2))
    assert value(dist.entropy(F.lit(None).cast("map<int,double>"))) == -1.0
    assert value(dist.total_variation(half, F.create_map(F.lit(2), F.lit(1.0)))) == 0.5
    assert value(dist.variance(half)) == 0.25
    assert value(dist.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    assert [value(dist.round_half_up(F.lit(x))) for x in (0.2, 2.5, 7.9)] == [1, 3, 7]
    assert value(dist.margin(F.array(*map(F.lit, (0.1, 0.6, 0.3))), F.lit(2))) == pytest.approx(-0.3)


def test_truncation(value):
    cut = lambda t: tuple(value(tx.truncate_answer(F.lit(t), most=8, target=5)))
    assert cut("one two three.") == ("one two three.", False)
    assert cut("a b c d. e f g! h i j k.") == ("a b c d.", True)
    assert cut("a b c d e f g h i j") == ("a b c d e", True)
    assert cut("a b c d e f g h i. j") == ("a b c d e", True)
    assert cut('x. a "b c d." e f g h i j') == ('x. a "b c d."', True)


def test_widened_options(value):
    wide = lambda t: value(parse.widened_options(F.lit(t)))
    good = "A: 0.7 B: 0.1 C: 0.1 D: 0.1"
    assert wide(good) == pytest.approx([0.7, 0.1, 0.1, 0.1])
    assert wide("A: 0.1 B: 0.1 so rather " + good) == pytest.approx([0.7, 0.1, 0.1, 0.1])
    assert wide("B: 0.2 A: 0.1 C: 0.6 D: 0.1") == pytest.approx([0.1, 0.2, 0.6, 0.1])
    assert wide("no idea") is None


def test_many_distributions(value):
    line = "1:1 2:0 3:0 4:0 5:0 6:0 7:0"
    many = lambda t: value(parse.many_distributions(F.lit(t), ["T1", "T10"]))
    got = many(f"T1 and T10 are below\n- **T10**: {line}\n2. T1 - 1:0 2:2 3:0 4:0 5:0 6:0 7:2\n")
    assert got["T10"][1] == 1.0 and got["T1"][2] == 0.5
    assert many(f"T1: {line}") is None and many(f"T1: {line}\nT10: {line}\nT1: {line}") is None and many(f"T1: {line}\nT10: 1:1 2:0") is None


def test_information_gain(value):
    d = F.create_map(*[F.lit(x) for x in (1, 0.2, 2, 0.2, 3, 0.6)])
    weights = dist.hypothetical_weights(d)
    assert value(weights) == pytest.approx({1: 0.25, 3: 0.75, 5: 0.0})
    assert value(dist.hypothetical_weights(F.lit(None).cast("map<int,double>"))) == pytest.approx({1: 1 / 3, 3: 1 / 3, 5: 1 / 3})
    assert value(dist.expected_shift(F.create_map(F.lit(1), F.lit(0.4), F.lit(3), F.lit(0.2)), weights)) == pytest.approx(0.25)
