"""Searches by cosine against plain Python, with queries and rows dealt into several blocks."""

import math
import random
from decimal import ROUND_HALF_UP, Decimal

from tidemark.operators import nearest


def cosine(a, b):
    length = lambda v: math.sqrt(sum(x * x for x in v))
    return sum(x * y for x, y in zip(a, b, strict=True)) / (length(a) * length(b)) if a and b and any(a) and any(b) else None


def given():
    draw = random.Random(7)
    rows = [(i, i % 3 if i % 11 else None, [draw.choice((-1.0, 0.5, 2.0)) for _ in range(4)]) for i in range(120)]
    return [*rows, (120, 1, None), (121, 2, [0.0] * 4), (122, 1, [])]


def test_cosines_through_many_blocks(spark, monkeypatch):
    for name, value in (("BLOCK", 7), ("SLICE", 16), ("PAIRS", 200)):
        monkeypatch.setattr(nearest, name, value)
    rows = given()
    e = spark.createDataFrame(rows, "id long, mark int, vector array<float>")
    got = {(r["q"], r["place"]): (r["id"], r["cosine"]) for r in nearest.top_cosines(e.filter("id % 4 = 0"), e, 5).collect()}
    want = {}
    for q, _, a in rows[::4]:
        of = [(i, cosine(a, b)) for i, _, b in rows if i != q]
        of = [(i, None if c is None else float(Decimal(repr(c)).quantize(Decimal("0.00001"), ROUND_HALF_UP))) for i, c in of]
        of.sort(key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
        want |= {(q, k + 1): x for k, x in enumerate(of[:5])}
    assert got == want
    best = {(r["q"], r["own"], r["mark"]): r["best"] for r in nearest.highest_cosines(e.filter("id % 4 = 0"), e).collect()}
    assert set(best) == {(q, own, m) for q, own, _ in rows[::4] if own is not None for m in range(3) if m != own}
    for (q, _, m), x in best.items():
        of = [c for c in (cosine(rows[q][2], b) for _, mark, b in rows if mark == m) if c is not None]
        assert (x is None) == (not of) and (not of or abs(x - max(of)) < 1e-12)
