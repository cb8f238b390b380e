"""Published examples of the sentiment rules, and odd texts."""

import pytest

from listenlab.operators import sentiment

#: Valences of the published lexicon.
WORDS = {"smart": 1.7, "handsome": 2.2, "funny": 1.9, "good": 1.9, "horrible": -2.5, "great": 3.1, "sucks": -1.5, "no": -1.2, "lol": 1.8, "well": 1.1, "kind": 2.4}
#: Texts and their published scores.
EXAMPLES = [
    ("VADER is smart, handsome, and funny.", 0.8316),
    ("VADER is smart, handsome, and funny!", 0.8439),
    ("VADER is very smart, handsome, and funny.", 0.8545),
    ("VADER is VERY SMART, handsome, and FUNNY.", 0.9227),
    ("VADER is VERY SMART, handsome, and FUNNY!!!", 0.9342),
    ("VADER is not smart, handsome, nor funny.", -0.7424),
    ("The book was good.", 0.4404),
    ("At least it isn't a horrible book.", 0.431),
    ("The book was only kind of good.", 0.3832),
    ("Today sucks", -0.3612),
    ("", 0.0),
    (None, 0.0),
    ("nothing of it", 0.0),
    ("!!! ???", 0.0),
]


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(list(WORDS.items()), "word string, valence double")


def test_published_examples(spark, lexicon):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(EXAMPLES)], "track_id long, text string").repartition(3)
    got = {r.track_id: r.compound for r in sentiment.compound(df, lexicon).collect()}
    for i, (text, want) in enumerate(EXAMPLES):
        assert got[i] == pytest.approx(want, abs=6e-5), text
    assert sentiment.compound(df.limit(0), lexicon).count() == 0
    assert all(r.compound == 0 for r in sentiment.compound(df, lexicon.limit(0)).collect())


def test_single_rules(spark, lexicon):
    cases = [
        ("good", 1.9), ("GOOD day", 1.9 + 0.733), ("GOOD", 1.9), ("really good", 1.9 + 0.293), ("really x good", 1.9 + 0.293 * 0.95), ("really x y good", 1.9 + 0.293 * 0.9), ("slightly good", 1.9 - 0.293),
        ("REALLY good", 1.9 + 0.293 + 0.733), ("very horrible", -2.5 - 0.293), ("not good", -0.74 * 1.9), ("not x good", -0.74 * 1.9), ("not x y good", -0.74 * 1.9), ("not x y z good", 1.9), ("didn't good", -0.74 * 1.9),
        ("not very good", (1.9 + 0.293) * -0.74), ("never so good", (1.9 + 0.293) * 1.25), ("without a doubt good", 1.9), ("no good", -0.74 * 1.9), ("least good", -0.74 * 1.9), ("at least good", 1.9), ("good but", 0.95), ("but good", 2.85),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "track_id long, text string")
    got = {}
    for r in sentiment.scored_tokens(df, lexicon).collect():
        got[r.track_id] = got.get(r.track_id, 0) + r.valence
    for i, (text, want) in enumerate(cases):
        assert got[i] == pytest.approx(want), text


def test_long_text(spark, lexicon):
    df = spark.createDataFrame([(1, "not good word " * 20_000)], "track_id long, text string")
    assert -1 <= sentiment.compound(df, lexicon).first().compound < -0.999
