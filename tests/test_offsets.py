"""Offsets by votes against plain Python, with series dealt into many blocks and counted in small parts."""

import random
from collections import Counter

import pytest

from tidemark.operators import offsets


def given():
    """Series of few marks, so that offsets tie, one long one, one that shares nothing, and marks that fall together often."""
    draw = random.Random(11)
    rows = Counter((who, draw.randrange(6), draw.randrange(-30, 30)) for who in range(60) for _ in range(8))
    rows.update((60 + i, draw.randrange(6), at) for i in (0, 1) for at in range(-200, 200))
    rows.update({(62, 99, 5): 3, (63, 98, 5): 3})
    return rows


@pytest.mark.parametrize("often", [1, 50])
def test_offsets_of_all_pairs_through_many_blocks(spark, monkeypatch, often):
    for name, value in (("HELD", 70), ("MEETINGS", 500), ("CHUNK", 90)):
        monkeypatch.setattr(offsets, name, value)
    rows = given()
    for mark in ((3, 1, 0), (8, 1, 4)):
        rows[mark] += often - 1 or 1
    h = spark.createDataFrame([(*mark, n) for mark, n in rows.items()], "who long, key long, at long, n long")
    votes: dict[tuple[int, int], Counter] = {}
    for (m, key, a), n in rows.items():
        for (r, other, b), k in rows.items():
            if m % 2 == 0 and r % 2 == 1 and key == other:
                votes.setdefault((m, r), Counter())[b - a] += n * k
    want = set()
    for pair, own in votes.items():
        order = sorted((-n, at) for at, n in own.items())
        want.add((*pair, order[0][1], -order[0][0], -order[1][0] if len(order) > 1 else 0))
    got = [tuple(r) for r in offsets.best_offsets(h.filter("who % 2 = 0"), h.filter("who % 2 = 1")).collect()]
    assert len(got) == len(want) and set(got) == want


def test_nothing_to_meet_gives_no_rows(spark):
    h = spark.createDataFrame([(2, 1, 5, 1)], "who long, key long, at long, n long")
    assert offsets.best_offsets(h, h.filter("who < 0")).count() == 0 and offsets.best_offsets(h.filter("who < 0"), h.filter("who < 0")).count() == 0


def test_no_meeting_of_landmarks_is_a_row_of_a_table(spark, sf_dir):
    """They grow with the square of the users; only the rows a pair, which are the result, may."""
    from tidemark.plans import evidence as plans

    own = plans.offset_votes(spark, sf_dir)
    own.collect()
    assert "Join" not in own._jdf.queryExecution().executedPlan().toString()
