"""Filter audit against plain loops over documents, orders and steps."""

import itertools
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cuelake.llm import audit

from .conftest import SCHEMA

LABELS = "doc_id LONG, quality INT, toxic INT"
WORD = re.compile("[^\x20\x09-\x0D]+")


def plain(rows, labels):
    found = []
    for d, text, _, source, _ in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = set()
        fails |= {"A"} if len(words) < 50 else set()
        fails |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text) else set()
        fails |= {"D"} if any(c in "#$%&*|" for c in text) else set()
        smaller = d is not None and any(o[0] is not None and o[0] < d and (o[1] or "") == text for o in rows)
        fails |= {"E"} if smaller else set()
        mine = [x for x in labels if x[0] is not None and x[0] == d]
        found.append((source or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = []
    for part in {f[0] for f in found}:
        docs = [f for f in found if f[0] == part]
        made = {}
        for order in itertools.permutations("ABCDE"):
            for step, x in enumerate(order):
                gone = [d for d in docs if x in d[1] and not d[1] & set(order[:step])]
                made["".join(order), step + 1] = (
                    sum(not d[1] & set(order[:step + 1]) for d in docs), len(gone), sum(x in d[1] and bool(d[1] & set(order[:step])) for d in docs),
                    sum(d[1] == {x} for d in docs), sum(d[2] for d in gone), sum(d[3] for d in gone))
        for (order, step), numbers in made.items():
            all_orders = sum(n[1] for (o, s), n in made.items() if o[s - 1] == order[step - 1])
            out.append((part, order, step, *numbers, all_orders))
    return sorted(out)


def audited(docs, labels):
    return sorted(map(tuple, audit.filter_audit(docs, labels).collect()))


def test_odd_rows(spark, odd, odd_rows, clashing, nothing):
    more = [(200, odd_rows[20][1], "en", "s", 1), (0, odd_rows[21][1], "en", None, 1), (None, odd_rows[22][1], "en", "s", 1),
            (300, "SHOUTED words " * 40, "en", "a", 1), (301, "", "en", "", 1), (302, " ".join(f"w{i}" for i in range(60)) + " 100%", "en", "a", 1)]
    rows = [*odd_rows, *more]
    docs = odd.union(spark.createDataFrame(more, SCHEMA))
    labels = [(1, 1, 0), (2, 0, 1), (7, 1, 1), (7, 0, None), (None, 1, 1), (8, None, 1), (100, 1, 0), (100, 1, 0), (200, 1, 1), (300, 1, 0), (999, 1, 1)]
    table = spark.createDataFrame(labels, LABELS)
    assert audited(docs, table) == plain(rows, labels)
    assert audited(clashing, table) == plain(odd_rows, labels)
    none = spark.createDataFrame([], LABELS)
    assert audited(docs, none) == plain(rows, [])
    assert audited(nothing, table) == []


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 31), st.integers(0, 9)), max_size=12))
def test_states_of_all_subsets(cells):
    masks, counts = np.array([c[0] for c in cells], np.int64), np.array([[c[1]] for c in cells], np.int64).reshape(-1, 1)
    states = audit.walk(masks, counts, 5)
    assert [int(x) for x in states[:, 0]] == [sum(n for m, n in cells if not m & s) for s in range(32)]
