"""Every declared language is told, and a language that nothing declares is rejected."""

import random

from wattline.llm import langid

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def words_in(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(n))


def test_rare_languages_and_undeclared_ones(spark):
    rng = random.Random(6)
    rows = [(i, words_in(rng, "abcde", 20), "en", "h.example.com") for i in range(3000)]
    rows += [(3000 + i, words_in(rng, "vwxyz", 60), "fi", "h.example.com") for i in range(2)]  # below 0.1% of rows
    rows += [(4000 + i, words_in(rng, "\u0431\u0432\u0433\u0434\u0436", 40), None, None) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, t string, tag string, host string")
    got = {r["id"]: r for r in langid.identify(df).collect()}
    assert all(got[i]["language"] == "en" and got[i]["kept"] for i in range(3000))
    assert all(got[3000 + i]["language"] == "fi" and got[3000 + i]["kept"] for i in range(2))
    assert all(got[4000 + i]["language"] is None and not got[4000 + i]["kept"] for i in range(3))


def test_more_than_64_languages(spark):
    rng = random.Random(7)
    tags = [a + b for a in "abcdefg" for b in "abcdefghij"]
    alphabets = [rng.sample(LETTERS, 5) for _ in tags]
    rows = [(100 * k + i, words_in(rng, alphabets[k], 40), t, None) for k, t in enumerate(tags) for i in range(4)]
    df = spark.createDataFrame(rows, "id long, t string, tag string, host string")
    got = {r["id"]: r for r in langid.identify(df).collect()}
    assert all(got[100 * k + i]["language"] == t for k, t in enumerate(tags) for i in range(4))
