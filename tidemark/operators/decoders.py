"""Sequence decoders: dynamic programming within a group, groups in parallel.

Those built on `decoded` read a group frame by frame, whatever the batches, and hold the states of one frame
only; the way back is a table of its own, read from the last frame on. The others hold a group as one Arrow batch.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from math import inf

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import written
from .streams import tasks_of

Step = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
"""From the states of a frame and their totals to the best total that leads to each state of the next, and the place of where it comes from."""


def decoded(emissions: DataFrame, keys: list[str], frame: str, state: str, score: str, step: Step) -> DataFrame:
    """keys, frame, state, total: the path of the highest summed score through the frames of each key, one state a frame.

    States are numbers; of rows with one frame and state the highest score counts. The totals forward and where each
    comes from are written; the path is then followed from the best state of the last frame (of equals, the least).
    A null score or state, or a score that is not finite, is no row; a key whose frames can't be connected has no path.
    """
    kinds = dict(emissions.dtypes)
    own = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    n = len(keys)
    tasks = tasks_of(emissions)
    given = emissions.filter(F.col(score).isNotNull() & F.col(state).isNotNull()).select(*keys, frame, F.col(state).cast("double").alias("__state"), F.col(score).cast("double").alias("__score"))
    best = given.repartition(tasks, *keys).groupBy(*keys, frame, "__state").agg(F.max("__score").alias("__score"))
    best = best.filter(F.col("__score").between(-1e300, 1e300))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int], list[bool]]]:
        """Sorted rows in pieces of whole frames, with where each frame begins (and the last ends) and whether it is the first of its key."""
        codes = lambda c: c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        held, last = [], None

        def piece() -> tuple[pa.RecordBatch, list[int], list[bool]]:
            nonlocal last
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            key, new = np.zeros(rows.num_rows, dtype=bool), np.zeros(rows.num_rows, dtype=bool)
            for i, c in enumerate(rows.columns[: n + 1]):
                code = codes(c)
                (key if i < n else new)[1:] |= code[1:] != code[:-1]
            key[0] = last != tuple(c[0].as_py() for c in rows.columns[:n])
            new |= key
            new[0] = True
            last = tuple(c[-1].as_py() for c in rows.columns[:n])
            first = np.flatnonzero(new)
            return rows, [*first.tolist(), rows.num_rows], key[first].tolist()

        for batch in batches:
            if not batch.num_rows:
                continue
            end = tuple(c[-1].as_py() for c in batch.columns[: n + 1])
            of = [np.zeros(1, dtype=bool)]
            for c in batch.columns[: n + 1]:
                code = codes(c)
                of.append(code != code[-1])
            other = np.flatnonzero(np.logical_or.reduce([np.broadcast_to(x, batch.num_rows) for x in of]))
            cut = int(other[-1]) + 1 if len(other) else 0  # the last frame may go on in the next batch
            if held and (cut or tuple(c[-1].as_py() for c in held[-1].columns[: n + 1]) != end):
                if cut:
                    held.append(batch.slice(0, cut))
                yield piece()
                held = []
            elif cut:
                held.append(batch.slice(0, cut))
                yield piece()
                held = []
            held.append(batch.slice(cut))
        if held:
            yield piece()

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, totals = np.zeros(0), np.zeros(0)
        for batch, at, starts in frames(batches):
            now, scores = (batch.column(n + 1 + i).to_numpy() for i in range(2))
            froms, sums = np.full(len(now), -np.inf), np.empty(len(now))
            for a, b, new in zip(at, at[1:], starts, strict=False):
                own = now[a:b]
                if new:
                    totals = scores[a:b]
                else:
                    lead, source = step(states, totals, own)
                    froms[a:b] = np.where(np.isfinite(lead), states[np.maximum(source, 0)], np.nan)
                    totals = lead + scores[a:b]
                states = own
                sums[a:b] = totals
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 2], pa.array(froms), pa.array(sums)], [*keys, frame, "__state", "__from", "__total"])

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = 0.0, 0.0
        for batch, at, starts in frames(batches):
            states, came, totals = (batch.column(n + 1 + i).to_numpy() for i in range(3))
            kept, told = [], []
            for a, b, new in zip(at, at[1:], starts, strict=False):
                if new:
                    i = a + int(totals[a:b].argmax())
                    total = totals[i]
                else:
                    i = a + int(np.searchsorted(states[a:b], wanted))
                wanted = came[i]
                if np.isfinite(total):
                    kept.append(i)
                    told.append(total)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(kept, pa.int64())) for c in batch.columns[: n + 2]), pa.array(told, pa.float64())], [*keys, frame, "__state", "__total"])

    there = f"{own}{', ' if own else ''}`{frame}` {kinds[frame]}"
    told = best.sortWithinPartitions(*keys, frame, "__state").mapInArrow(forward, f"{there}, __state double, __from double, __total double")
    told = written(told)
    path = told.repartition(tasks, *keys).sortWithinPartitions(*keys, F.desc(frame), "__state").mapInArrow(backward, f"{there}, __state double, __total double")
    return path.select(*keys, frame, F.col("__state").alias(state), F.col("__total").alias("total"))


SMALL = 32
"""Pairs of states of two frames up to which arrays cost more than they save."""


def _leading(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running maximum and where it is; the last of equals."""
    top = np.maximum.accumulate(values)
    return top, np.maximum.accumulate(np.where(values >= top, np.arange(len(values)), -1))


def directional_path(emissions: DataFrame, keys: list[str], frame: str, state: str, score: str, forward: float, backward: float | None = None, forward_slope: float = 0.0, backward_slope: float = 0.0, early: float = 0.0) -> DataFrame:
    """The best path where staying is free, going up from state j to k costs forward + forward_slope * (k - j), going down backward + backward_slope * (j - k).

    `early` lowers every score by that much a state, so that of alike states the lower wins. Staying wins ties, then
    going up, then the nearest. Two running maxima, of totals plus slope times state from below and from above, find the best source of
    every state at once, so a frame takes time in proportion to its states.
    """
    down = forward if backward is None else backward

    def few(states: list[float], totals: list[float], now: list[float]) -> tuple[np.ndarray, np.ndarray]:
        """The same choice pair by pair, which small frames are faster by."""
        rising = [t + forward_slope * x for x, t in zip(states, totals, strict=True)]
        falling = [t - backward_slope * x for x, t in zip(states, totals, strict=True)]
        lead, source = [], []
        for x in now:
            stay, up, fall, at, low, high = -inf, -inf, -inf, 0, 0, 0
            for j, y in enumerate(states):
                if y < x:
                    if rising[j] >= up:
                        up, low = rising[j], j
                elif y > x:
                    if falling[j] > fall:
                        fall, high = falling[j], j
                else:
                    stay, at = totals[j], j
            up, fall = up - forward_slope * x - forward, fall + backward_slope * x - down
            best = max(stay, up, fall)
            lead.append(best)
            source.append(at if stay == best else low if up == best else high)
        return np.array(lead), np.array(source)

    def step(states: np.ndarray, totals: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(states) * len(now) <= SMALL:
            return few(states.tolist(), totals.tolist(), now.tolist())
        same = np.searchsorted(states, now)
        here = (same < len(states)) & (states[np.minimum(same, len(states) - 1)] == now)
        stay = np.where(here, totals[np.minimum(same, len(states) - 1)], -np.inf)
        top, at = _leading(totals + forward_slope * states)
        below = same - 1
        up = np.where(below >= 0, top[np.maximum(below, 0)] - forward_slope * now - forward, -np.inf)
        back, back_at = _leading((totals - backward_slope * states)[::-1])
        back, back_at = back[::-1], (len(states) - 1 - back_at)[::-1]
        above = np.searchsorted(states, now, side="right")
        fall = np.where(above < len(states), back[np.minimum(above, len(states) - 1)] + backward_slope * now - down, -np.inf)
        every = np.stack([stay, up, fall])
        source = np.stack([np.minimum(same, len(states) - 1), at[np.maximum(below, 0)], back_at[np.minimum(above, len(states) - 1)]])
        chosen = every.argmax(axis=0)
        return every[chosen, np.arange(len(now))], source[chosen, np.arange(len(now))]

    given = emissions.withColumn(score, F.col(score) - early * F.col(state)) if early else emissions
    return decoded(given, keys, frame, state, score, step)


def path_segments(emissions: DataFrame, keys: list[str], stretch: str, at: str, state: str, score: str, end: str, **costs: float) -> DataFrame:
    """keys, mix_start, ref_start, ref_end, stretch, total: the pieces of the best directional path over all stretches of each key.

    emissions: the score of the window at `at` for every place `state` in the reference where a line of slope
    `stretch` that goes through the window would begin; `end`: the last place of the span. Windows that
    stay on one line are one piece, which ends where the next begins, the last at `end`. Of equal totals the least stretch wins.
    """
    path = directional_path(emissions, [*keys, stretch], at, state, score, **costs)
    most = path.groupBy(*keys, stretch).agg(F.first("total").alias("__of")).groupBy(*keys).agg(F.min_by(stretch, F.struct(-F.col("__of"), F.col(stretch))).alias(stretch))
    path = path.join(most, [*keys, stretch])
    order = Window.partitionBy(*keys).orderBy(at)
    starts = path.withColumn("__new", F.coalesce(F.lag(state).over(order) != F.col(state), F.lit(True))).filter("__new").drop("__new")
    ends = emissions.groupBy(*keys).agg(F.max(end).alias("__end"))
    starts = starts.join(ends, keys).withColumn("__to", F.coalesce(F.lead(at).over(order), F.col("__end")))
    line = lambda x: F.col(state) + F.col(x) * F.col(stretch)
    return starts.select(*keys, F.col(at).alias("mix_start"), line(at).alias("ref_start"), line("__to").alias("ref_end"), stretch, "total")


ABSTAIN = float("inf")


def monotone_choice(candidates: DataFrame, keys: list[str], span: str, place: str, score: str, expected: Column, sigma: float = 150.0, slack: float = 5.0, abstain: float = 0.6) -> DataFrame:
    """keys, span, place (null: abstained), total: one candidate or none a span, so that a place lies at most `slack` before that of the span before it.

    Scores are weighted by a Gaussian of their distance from the expected place (null: not weighted);
    abstaining counts `abstain`, and sets the next span free. Rows with a null place only name a span. The
    best source of a candidate is a running maximum over the places of the span before, up to its place plus slack; of equals the least place, a candidate before an abstention.
    """
    weight = F.coalesce(F.exp(-0.5 * F.pow((F.col(place) - expected) / sigma, 2)), F.lit(1.0))
    given = candidates.select(*keys, span, F.col(place).cast("double").alias(place), (F.col(score) * weight).alias(score)).filter(F.col(place).isNotNull())
    given = given.unionByName(candidates.select(*keys, span).distinct().withColumns({place: F.lit(ABSTAIN), score: F.lit(abstain)}))

    def step(states: np.ndarray, totals: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = np.maximum.accumulate(totals)
        at = np.maximum.accumulate(np.where(np.r_[True, totals[1:] > top[:-1]], np.arange(len(totals)), 0))
        last = np.searchsorted(states, np.where(np.isinf(now), now, now + slack), side="right") - 1  # an abstention may follow anything
        none = len(states) - 1 if np.isinf(states[-1]) else -1
        lead = np.where(last >= 0, top[np.maximum(last, 0)], -np.inf)
        source = at[np.maximum(last, 0)]
        free = (none >= 0) & ((last < 0) | (totals[none] > lead))
        return np.where(free, totals[none], lead), np.where(free, none, source)

    path = decoded(given, keys, span, place, score, step)
    return path.withColumn(place, F.when(F.col(place) != ABSTAIN, F.col(place)))


def uniform_probes(lo: Column, hi: Column, key: Column, n: int) -> Column:
    """n places between lo and hi, drawn by hashes of the key: an array."""
    draw = lambda i: F.pmod(F.xxhash64(F.lit("probe"), key, i), F.lit(1 << 30)) / F.lit(1 << 30)
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: lo + draw(i) * (hi - lo))


def support(points: DataFrame, lines: DataFrame, keys: list[str], line: list[str], grid: float, tolerance: float, sigma: float) -> DataFrame:
    """keys, line columns, step, support: at every grid step near it, the weight of the points on a line, spread by a Gaussian.

    points: keys, at, offset, weight; lines: keys, columns of `line`, intercept. A point is on a line if its offset is within tolerance of the
    intercept: both go to cells of that width, so points meet lines by equality. Beyond five sigma nothing is added.
    """
    cell = lambda c: F.floor(c / tolerance).cast("long")
    dealt = lines.withColumn("__cell", F.explode(F.array(*(cell(F.col("intercept")) + i for i in (-1, 0, 1)))))
    on = points.withColumn("__cell", cell(F.col("offset"))).join(dealt, [*keys, "__cell"]).filter(F.abs(F.col("offset") - F.col("intercept")) <= tolerance)
    near = F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col("at") - 5 * sigma) / grid)).cast("long"), F.greatest(F.lit(0), F.floor((F.col("at") + 5 * sigma) / grid)).cast("long")))
    kernel = F.col("weight") * F.exp(-0.5 * F.pow((F.col("step") * grid - F.col("at")) / sigma, 2))
    return on.withColumn("step", near).groupBy(*keys, *line, "step").agg(F.sum(kernel).alias("support"))


def segment_cover(
    points: DataFrame, lines: DataFrame, keys: list[str], span: str, slope: Column,
    jump: float = 1.0, null_level: float = 0.35, grid: float = 0.5, tolerance: float = 0.6, sigma: float = 1.5, separation: float = 1.5, shortest: float = 2.0, probes: int = 8,
) -> DataFrame:
    """keys, run, line, at, until, ref_at, ref_until, evidence: stretches of a span that lines explain, with gaps where none does.

    points: keys, at, offset, weight (offset = reference - slope * at) and `span`, how long the span is; lines: keys, line (whole numbers from 0) and intercept.
    States are the lines and NULL. A line's emission at a grid step is its support above a floor, the median support of `probes`
    lines drawn by hashes between the least and the greatest offset and at least `separation` away from every candidate (no floor where that range is under four separations, or
    none was drawn); NULL has `null_level`; shares of their sum make a jump mean the same everywhere. The best path with a cost
    for every jump is cut into runs; runs of NULL are gaps, and runs under `shortest` are left out. `evidence` is the support above the floor along the run. A key without lines has no runs.
    """
    spread = points.groupBy(*keys).agg(F.min("offset").alias("__lo"), F.max("offset").alias("__hi"), F.max(span).alias("__span"))
    at = F.posexplode(uniform_probes(F.col("__lo"), F.col("__hi"), F.concat_ws("/", *keys), 8 * probes)).alias("__try", "intercept")
    drawn = spread.filter(F.col("__hi") - F.col("__lo") >= 4 * separation).select(*keys, at)
    taken = drawn.join(lines.select(*keys, F.col("intercept").alias("__of")), keys).groupBy(*keys, "__try", "intercept").agg(F.min(F.abs(F.col("intercept") - F.col("__of"))).alias("__away"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("__try"))
    drawn = written(taken.filter(F.col("__away") >= separation).withColumn("__n", place).filter(F.col("__n") <= probes).select(*keys, "__n", "intercept"))
    background = support(points, drawn, keys, ["__n"], grid, tolerance, sigma)
    counted = drawn.groupBy(*keys).agg(F.count(F.lit(1)).alias("__probes"))
    # The median over all probes, those with nothing near a step counting 0.
    ranked = F.sort_array(F.concat(F.collect_list("support"), F.array_repeat(F.lit(0.0), (F.col("__probes") - F.count(F.lit(1))).cast("int"))))
    floor = background.join(counted, keys).groupBy(*keys, "step", "__probes").agg(ranked.alias("__all"))
    middle = lambda i: F.get(F.col("__all"), F.floor(i).cast("int"))
    floor = floor.select(*keys, "step", ((middle((F.col("__probes") - 1) / 2) + middle(F.col("__probes") / 2)) / 2).alias("floor"))
    steps = spread.join(lines.select(*keys).distinct(), keys).select(*keys, F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.greatest(F.col("__span"), F.lit(grid)) / grid) - 1).cast("long"))).alias("step"))
    raw = steps.join(lines.select(*keys, "line", "intercept"), keys).join(support(points, lines, keys, ["line"], grid, tolerance, sigma), [*keys, "line", "step"], "left")
    raw = raw.join(floor, [*keys, "step"], "left").select(*keys, "step", F.col("line").cast("double").alias("line"), F.greatest(F.coalesce("support", F.lit(0.0)) - F.coalesce("floor", F.lit(0.0)), F.lit(0.0)).alias("raw"))
    raw = written(raw.unionByName(steps.withColumns({"line": F.lit(ABSTAIN), "raw": F.lit(0.0)})))
    level = F.when(F.col("line") == ABSTAIN, null_level).otherwise(F.col("raw"))
    shares = raw.repartition(tasks_of(raw), *keys).withColumn("share", level / (F.sum(level).over(Window.partitionBy(*keys, "step")) + 1e-9))

    def step(states: np.ndarray, totals: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = int(totals.argmax())
        stay = totals >= totals[top] - jump
        return np.where(stay, totals, totals[top] - jump), np.where(stay, np.arange(len(totals)), top)

    path = decoded(shares, keys, "step", "line", "share", step).join(raw.filter("raw > 0"), [*keys, "step", "line"], "left")
    order = Window.partitionBy(*keys).orderBy("step")
    path = path.withColumn("__new", F.coalesce((F.lag("line").over(order) != F.col("line")).cast("int"), F.lit(1))).withColumn("run", F.sum("__new").over(order))
    found = path.groupBy(*keys, "run", "line").agg(F.min("step").alias("__a"), F.max("step").alias("__b"), F.sum(F.coalesce("raw", F.lit(0.0))).alias("evidence"))
    found = found.filter((F.col("line") != ABSTAIN) & ((F.col("__b") - F.col("__a") + 1) * grid >= shortest))
    found = found.join(lines.select(*keys, F.col("line").cast("double").alias("line"), "intercept"), [*keys, "line"]).join(spread.select(*keys, "__span"), keys)
    begins, ends = F.col("__a") * grid, F.least((F.col("__b") + 1) * grid, F.greatest(F.col("__span"), F.lit(grid)))
    ref = lambda x: F.col("intercept") + slope * x
    return found.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("run")).alias("run"), F.col("line").cast("int").alias("line"), begins.alias("at"), ends.alias("until"), ref(begins).alias("ref_at"), ref(ends).alias("ref_until"), "evidence")


def monotone_chain(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The rows of a longest strictly rising chain of `value` in the order of `order`; of equal ones that with the least ends."""

    def chain(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values([order, value]).reset_index(drop=True)
        tails: list[float] = []
        at: list[int] = []
        back = [-1] * len(own)
        for i, x in enumerate(own[value].tolist()):
            k = bisect.bisect_left(tails, x)
            back[i] = at[k - 1] if k else -1
            if k == len(tails):
                tails.append(x)
                at.append(i)
            else:
                tails[k], at[k] = x, i
        i, kept = at[-1] if at else -1, []
        while i >= 0:
            kept.append(i)
            i = back[i]
        return own.iloc[kept[::-1]]

    return df.groupBy(*keys).applyInPandas(chain, df.schema)


def monotone_placement(scores: DataFrame, keys: list[str], row: str, start: str, score: str, min_step: int) -> DataFrame:
    """The starts that maximise the summed score, one a row, each at least min_step after the one before; the earliest on ties.

    scores: one row per (row, start) of a dense grid. Adds nothing but picks rows.
    """

    def decode(own: pd.DataFrame) -> pd.DataFrame:
        grid = own.pivot_table(index=row, columns=start, values=score, fill_value=-np.inf)
        s, starts = grid.to_numpy(), grid.columns.to_numpy()
        n, t = s.shape
        best, back = s[0].copy(), np.full((n, t), -1)
        for i in range(1, n):
            last = np.searchsorted(starts, starts - min_step, side="right") - 1
            top, arg = np.full(t, -np.inf), np.full(t, -1)
            lead, where = -np.inf, -1
            for j in range(t):
                if best[j] > lead:
                    lead, where = best[j], j
                top[j], arg[j] = lead, where
            ok = last >= 0
            best = np.where(ok, s[i] + top[np.maximum(last, 0)], -np.inf)
            back[i] = np.where(ok, arg[np.maximum(last, 0)], -1)
        path = [int(best.argmax())]
        if not np.isfinite(best[path[0]]):
            return own.iloc[:0]
        for i in range(n - 1, 0, -1):
            path.append(int(back[i][path[-1]]))
        chosen = pd.DataFrame({row: grid.index, start: starts[path[::-1]]})
        return own.merge(chosen, on=[row, start])[own.columns]

    return scores.groupBy(*keys).applyInPandas(decode, scores.schema)


def viterbi(emissions: DataFrame, keys: list[str], frame: str, state: str, score: str, jump: float) -> DataFrame:
    """The best state of each frame where changing state costs `jump`; staying wins ties."""

    def decode(own: pd.DataFrame) -> pd.DataFrame:
        grid = own.pivot_table(index=frame, columns=state, values=score, fill_value=-np.inf)
        s = grid.to_numpy()
        best, back = s[0].copy(), np.zeros(s.shape, dtype=int)
        for i in range(1, len(s)):
            top = int(best.argmax())
            stay = best >= best[top] - jump
            back[i] = np.where(stay, np.arange(s.shape[1]), top)
            best = s[i] + np.where(stay, best, best[top] - jump)
        path = [int(best.argmax())]
        for i in range(len(s) - 1, 0, -1):
            path.append(int(back[i][path[-1]]))
        chosen = pd.DataFrame({frame: grid.index, state: grid.columns.to_numpy()[path[::-1]]})
        return own.merge(chosen, on=[frame, state])[own.columns]

    return emissions.groupBy(*keys).applyInPandas(decode, emissions.schema)
