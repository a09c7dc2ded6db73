"""Choice of stored fragments for a read: exactly one for each goal interval, at the least cost of encoding and decoding.

Costs of whole GOPs and of encoding add up over fragments. A GOP that fragments cover only in part costs what its latest chosen
fragment needs, once. Going through goal intervals in time, a later fragment of an open GOP adds the difference to what was paid
for the GOP before, so the state is what was last paid for each open GOP, and the best way to each state is all that is kept.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.functions.expressions import HEVC_FACTOR, INTER_FACTOR

RAW = "rgb"


@dataclass(frozen=True)
class Format:
    codec: str
    height: int
    width: int

    @property
    def pixels(self) -> int:
        return self.height * self.width

    @property
    def factor(self) -> float:
        return HEVC_FACTOR if self.codec == "hevc" else 1.0

    def keyframe(self) -> float:
        return self.pixels * self.factor

    def inter_frame(self) -> float:
        return int(self.pixels * INTER_FACTOR) * self.factor

    def encode(self) -> float:
        return self.pixels * INTER_FACTOR * self.factor


@dataclass(frozen=True)
class Fragment:
    """An inclusive interval of frames of a stored video, with the GOPs it touches: (id, first frame, last frame)."""

    video: int
    start: int
    end: int
    format: Format
    gops: tuple[tuple[int, int, int], ...]

    def base_cost(self, goal: Format) -> float:
        """Encoding, and decoding of the GOPs within the fragment."""
        if self.format == goal:
            return 0.0
        cost = (self.end - self.start + 1) * goal.encode()
        if self.format.codec != RAW:
            for _, low, high in self.gops:
                if self.start <= low and high <= self.end:
                    cost += goal.keyframe() + (high - low) * goal.inter_frame()
        return cost

    def partial_costs(self, goal: Format) -> dict[tuple[int, int], float]:
        """What each GOP costs that is covered in part, if this is the last fragment chosen in it."""
        out = {}
        for name, low, high in self.gops:
            if self.format.codec == RAW or (self.start <= low and high <= self.end):
                continue
            if self.format.codec != goal.codec:
                out[self.video, name] = (min(self.end, high) - low) * goal.inter_frame() + goal.keyframe()
            elif self.start > low:
                out[self.video, name] = (self.start - low) * goal.inter_frame() + goal.keyframe()
            else:
                out[self.video, name] = None  # no cost, and what an earlier fragment in the GOP needed stays
        return out


def best_plan(choices: list[list[Fragment]], goal: Format) -> tuple[float, list[Fragment]]:
    """Cost and fragments, in order of time, of the cheapest plan. Of equal ones the lower videos.

    A state that costs no less than another one, even after that has paid for all that this one has, cannot be better and goes; all others
    are kept, so the plan is exact. Where no GOP is open there is one state.
    """
    states: list[tuple[float, tuple[int, ...], dict, tuple]] = [(0.0, (), {}, ())]
    for options in choices:
        known = [(x, x.base_cost(goal), x.partial_costs(goal), {(x.video, name) for name, _, high in x.gops if high <= x.end}) for x in options]
        following: dict[tuple, tuple[float, tuple[int, ...], dict, tuple]] = {}
        for cost, videos, paid, plan in states:
            for fragment, base, partial, ends in known:
                own, total = dict(paid), cost + base
                for gop, needed in partial.items():
                    if needed is not None:
                        total += needed - own.get(gop, 0.0)
                        own[gop] = needed
                for gop in ends:
                    own.pop(gop, None)
                new = (total, (*videos, fragment.video), own, (plan, fragment))
                key = tuple(sorted(own.items()))
                if key not in following or new[:2] < following[key][:2]:
                    following[key] = new
        states = []
        for new in sorted(following.values(), key=lambda x: x[:2]):
            if not any(old[0] + sum(max(0.0, needed - old[2].get(gop, 0.0)) for gop, needed in new[2].items()) <= new[0] for old in states):
                states.append(new)
    if not states:
        return float("inf"), []
    cost, _, _, linked = min(states, key=lambda x: x[:2])
    plan: list[Fragment] = []
    while linked:
        linked, fragment = linked
        plan.append(fragment)
    return cost, plan[::-1]


def plan_cost(plan: list[Fragment], goal: Format) -> float:
    """The cost of a plan by definition."""
    total, last = sum(x.base_cost(goal) for x in plan), {}
    for fragment in sorted(plan, key=lambda x: x.start):
        last |= {gop: needed for gop, needed in fragment.partial_costs(goal).items() if needed is not None}
    return total + sum(last.values())


def brute_force(choices: list[list[Fragment]], goal: Format) -> float:
    return min((plan_cost(list(plan), goal) for plan in itertools.product(*choices)), default=float("inf"))


def plan_all(fragments: DataFrame, gops: DataFrame, goal: Format) -> DataFrame:
    """Plans for all logical videos at once: logical_id, start, end, physical_id, cost (of the whole plan).

    ``fragments`` as ``intervals.split_fragments`` gives them; ``gops`` has physical_id, gop_id, g_start, g_end in frames. Each
    logical video is planned by itself, in a task that holds its fragments only.
    """
    g = gops.where("g_end >= g_start")
    touched = fragments.join(g, "physical_id", "left").where("g_start is null or (start <= g_end and g_start <= end)")
    rows = touched.groupBy("logical_id", "physical_id", "codec", "height", "width", "start", "end").agg(F.collect_list(F.struct("gop_id", "g_start", "g_end")).alias("gops"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        by_goal: dict[tuple[int, int], list[Fragment]] = {}
        for row in pdf.itertuples():
            own = tuple(sorted((int(x["gop_id"]), int(x["g_start"]), int(x["g_end"])) for x in row.gops if x["gop_id"] is not None))
            by_goal.setdefault((row.start, row.end), []).append(Fragment(row.physical_id, row.start, row.end, Format(row.codec, row.height, row.width), own))
        choices = [sorted(by_goal[key], key=lambda x: x.video) for key in sorted(by_goal)]
        cost, plan = best_plan(choices, goal)
        return pd.DataFrame({"logical_id": np.full(len(plan), pdf["logical_id"].iloc[0]), "start": [x.start for x in plan], "end": [x.end for x in plan], "physical_id": [x.video for x in plan], "cost": np.full(len(plan), cost)})

    return rows.groupBy("logical_id").applyInPandas(run, "logical_id long, start long, end long, physical_id long, cost double")
