import math

from crowdlens.functions import rules

LEXICON = {"good": 1.9, "bad": -2.5, "great": 3.1, ":)": 2.0}
norm = lambda x: round(x / math.sqrt(x * x + 15), 4)


def test_rules():
    score = lambda t: rules.compound(t, LEXICON)
    assert score(None) == score("") == score("nothing here") == 0
    assert score("good.") == norm(1.9) and score(":)") == norm(2.0)
    assert score("very good") == norm(1.9 + 0.293) and score("really quite good") == norm(1.9 + 0.293 * 1.95)
    assert score("slightly bad") == norm(-2.5 + 0.293)
    assert score("not good") == norm(1.9 * -0.74) and score("isn't very good") == norm((1.9 + 0.293) * -0.74)
    assert score("this is GOOD") == norm(1.9 + 0.733) and score("GOOD") == norm(1.9)
    assert score("good!!!!!") == norm(1.9 + 4 * 0.292) and score("good??") == norm(1.9 + 0.36) and score("bad????") == norm(-2.5 - 0.96)
    assert score("good but bad") == norm(1.9 * 0.5 - 2.5 * 1.5)


def test_signs_of_posts(spark):
    base = rules.read_lexicon(["good\t1.9\t0.9\t[1]", "bad\t-2.5", "broken", "x\ty"])
    assert base == {"good": 1.9, "bad": -2.5}
    rows = [(1, "to the moon, tendies and lambo"), (2, "bagholder of a worthless scam"), (3, "the table is made of wood"), (4, None), (5, "a" * 400 + " moon")]
    got = {r.i: r.s for r in spark.createDataFrame(rows, "i int, t string").select("i", rules.scorer(base)(rules.F.col("t")).alias("s")).collect()}
    assert got[1] > 0.3 and got[2] < -0.3 and abs(got[3]) < 0.3 and got[4] == got[5] == 0
