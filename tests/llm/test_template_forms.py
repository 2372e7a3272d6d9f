"""Cases of one item each: names that open sentences, slots that become equal, exact copies."""

import pytest

from logdistill.llm import templates
from tests.llm.test_templates import verdicts

TOM = "Tom has 3 apples and 5 pears. Tom gives 2 apples to Mary. How many are left?"
WAY = "on the way to the old market the red train went 3 km within 5 minutes and then stopped for good"
RAN = "Tom ran off. Tom came back to the house with some red apples"
DENSE = "1 2 3 and 4 5 6 make 7 8 9 or 10 11 12 13 14"
YEAR = "In which year did the king leave 3 castles behind?"


@pytest.fixture(scope="module")
def hits(spark):
    """Pairs of document and item that match, all cases in one run."""
    items = [(1, TOM), (2, WAY), (3, DENSE), (4, "Who is Zorblax Quent"), (5, YEAR), (6, "A lonely vilqua"), (7, WAY.replace("5 min", "3 min")), (8, RAN)]
    docs = [
        (10, "Some text. " + TOM.replace("Tom", "Anna").replace("Mary", "Eve") + " And more."),
        (11, RAN.replace("Tom came", "Anna came")),  # equal in the item, different here
        (12, RAN.replace("Tom", "Anna")),
        (20, WAY.replace("3 km", "4 km").replace("5 min", "4 min")),
        (21, WAY.replace("5 minutes", "5 km")),
        (22, WAY.replace("3 km", "8 km").replace("5 min", "9 min")),
        (30, "Look: " + DENSE + " there"),
        (31, DENSE.replace("7", "70")),
        (40, "they asked: who is Zorblax Quent?"),
        (41, "they asked: who is the Zorblax Quent?"),
        (50, "Question 12. " + YEAR.replace("3", "4") + " Answer"),
        (51, "(12) " + YEAR.replace("3", "4")),
        (52, "Question 12: " + YEAR),
        (60, "on page 7 a lonely vilqua"),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in templates.matches(d, b).collect()}


def test_names_that_open_sentences(hits):
    assert {(10, 1), (12, 8)} <= hits and (11, 8) not in hits


def test_different_slots_may_become_equal(hits):
    assert {(20, 2), (21, 2), (22, 2)} <= hits
    assert (20, 7) in hits


def test_equal_slots_stay_equal(spark):
    item = "the red train went 3 km and the old man went 3 km to market"
    got, _, _ = verdicts(spark, [(1, item.replace("3 km to", "4 km to"), "", ""), (2, item.replace("3", "9"), "", "")], [(1, item)])
    assert got == {2}


def test_exact_copies(hits):
    assert (30, 3) in hits and (31, 3) not in hits
    assert (40, 4) in hits and (41, 4) not in hits
    assert (60, 6) in hits


def test_no_unit_across_a_stop(hits):
    assert {(50, 5), (51, 5), (52, 5)} <= hits
