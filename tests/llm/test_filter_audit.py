"""Filter audit: diagrams against direct counting, swaps, and edge rows."""

from itertools import permutations
from math import factorial

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from martspark.llm.filter_audit import FILTERS, Diagram, adjacent_swaps, audited, filter_audit

DOCS = "doc_id long, text string, source string, mask string"
LABELS = "doc_id long, quality int, toxic int"


def direct(weights):
    """Each order by going through the masks, without any diagram."""
    n = len(FILTERS)
    rows, shares = {}, dict.fromkeys(range(n), 0)
    for order in permutations(range(n)):
        alive = dict(weights)
        for at, k in enumerate(order):
            gone = {m: w for m, w in alive.items() if m >> k & 1}
            alive = {m: w for m, w in alive.items() if m not in gone}
            removed = [sum(w[i] for w in gone.values()) for i in range(3)]
            shares[k] += removed[0]
            failing = sum(w[0] for m, w in weights.items() if m >> k & 1)
            rows["".join(FILTERS[x] for x in order), at + 1] = (
                k, sum(w[0] for w in alive.values()), removed[0], failing - removed[0],
                weights.get(1 << k, (0,))[0], removed[1], removed[2])
    return {key: (*row[1:], shares[row[0]]) for key, row in rows.items()}


@given(st.dictionaries(st.integers(0, 31), st.tuples(st.integers(0, 9), st.integers(0, 9), st.integers(0, 9)), min_size=1))
@settings(max_examples=40, deadline=None)
def test_diagram_against_counting(weights):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    found = {(r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in audited(weights)}
    assert found == direct(weights)


def test_swaps_meet_every_order_once():
    for n in range(6):
        order, seen = list(range(n)), {tuple(range(n))}
        for level in adjacent_swaps(n):
            order[level], order[level + 1] = order[level + 1], order[level]
            seen.add(tuple(order))
        assert len(seen) == factorial(n) == len(adjacent_swaps(n)) + 1


def test_swap_keeps_sums_and_shares_leaves():
    diagram = Diagram(3, {0: (4,), 1: (4,), 6: (2,)})
    assert sum(c is None for c in diagram.children) == 3  # the empty node and two leaves
    before = diagram.weights[diagram.root]
    diagram.swap(1)
    assert diagram.weights[diagram.root] == before == (10,)
    assert diagram.order == [0, 2, 1]


def audit(spark, docs, labels=()):
    rows = filter_audit(spark.createDataFrame(list(docs), DOCS), spark.createDataFrame(list(labels), LABELS)).collect()
    return {(r["part"], r["filter_order"], r["step"]): r for r in rows}


def test_edge_rows(spark):
    good = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(250))
    rows = audit(spark, [
        (1, good, None, "x"), (2, good, "", "y"),  # one part; 2 is a copy of 1
        (1, good, "s", "z"),  # the same id again is not a copy of a smaller one
        (None, good, "s", "z"), (None, good, "s", "z"),  # no id: never a copy
        (3, None, "s", None), (4, "", "s", None), (5, "a " * 300_000, "long", None),
    ], [(2, 1, 0), (2, 0, 1), (5, None, 1), (None, 1, 1), (77, 1, 1)])
    assert len(rows) == 3 * 120 * 5
    step = rows["", "EABCD", 1]
    assert (step["kept"], step["removed"], step["good_lost"], step["toxic_lost"], step["unique_fails"]) == (1, 1, 1, 1, 1)
    assert rows["s", "EABCD", 1]["removed"] == 1  # the second empty text
    assert rows["s", "AEBCD", 1]["removed"] == 2 and rows["s", "AEBCD", 2]["removed"] == 0
    assert rows["s", "AEBCD", 2]["redundant"] == 1 and rows["s", "AEBCD", 5]["kept"] == 3
    assert rows["long", "BACDE", 1]["removed"] == 1 and rows["long", "ABCDE", 1]["removed"] == 0
    assert sum(rows["s", "AEBCD", k]["shapley"] for k in range(1, 6)) == 120 * 2


def test_empty_tables(spark):
    assert audit(spark, []) == {}


def test_hot_group_of_copies(spark):
    docs = [(k, "the same text", f"s{k % 3}", None) for k in range(5000)]
    rows = audit(spark, docs)
    removed = np.array([rows[f"s{k}", "EABCD", 1]["removed"] for k in range(3)])
    assert removed.sum() == 4999 and rows["s0", "EABCD", 1]["kept"] == 1
