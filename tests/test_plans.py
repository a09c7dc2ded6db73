import random
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cinelake.functions.units import Quantity, clock_name, frames, seconds, spacing_name
from cinelake.plans.arrayview import VideoArray
from cinelake.plans.planner import Format, Fragment, best_plan, brute_force, plan_cost


@pytest.fixture
def clip():
    return VideoArray.of("v", 6, 540, 960)


def test_shape(clip):
    assert clip.shape == (6, 540, 960)


def test_time(clip):
    assert clip[5:].shape[0] == 1 and clip[5:][:10].shape[0] == 1


def test_resolution(clip):
    assert clip.at("1K").shape[1:] == (540, 960) and clip.at("2K").shape[1:] == (1080, 1920) and clip.at("4K").shape[1:] == (2160, 3840)


def test_crop(clip):
    a = clip[:, 100:200, :]
    b = a[:, 0:50, :]
    c = b[:, :, 100:200]
    assert (a.shape[1:], b.shape[1:], c.shape[1:], c[:, :, 0:50].shape[1:]) == ((100, 960), (50, 960), (50, 100), (50, 50))
    assert (int(c.y.start), int(c.x.start)) == (100, 100)


def test_names_and_sections(clip):
    assert str(clip) == "v(540x960@30fps)[:, :, :]" and str(clip[1:3, 2:4]) == "v(540x960@30fps)[1:3, 2:4, :]"
    assert [str(x).split("[")[1].split(",")[0] for x in clip.array_split(3)] == [":2", "2:4", "4:"] and [str(x.y) for x in clip.array_split([100], axis=1)] == [":100", "100:"]
    assert clip[:: Fraction(1, 10)].fps == 10 and clip[2:5].duration_name() == "3s"
    with pytest.raises(IndexError):
        clip[:, :, :, :]


@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), max_size=4))
def test_slices_are_those_of_a_list(parts):
    view, plain = VideoArray.of("v", 8, 8, 8), list(range(8))
    for a, b in parts:
        low, high = min(a, b), max(a, b)
        view, plain = view[:, low:high], plain[low:high]
    assert int(view.y.length) == len(plain) and (not plain or int(view.y.start) == plain[0])


def test_units():
    a = seconds(Fraction(3, 2))
    assert str(a) == "3/2s" and (a + 1).unit == "s" and a * 2 == seconds(3) and 1 + a == Fraction(5, 2) and -a == -Fraction(3, 2) and abs(-a) == a
    assert a != frames(Fraction(3, 2)) and a // 1 == 1 and a % 1 == Fraction(1, 2) and (a**2).unit == "s" and 3 / a == 2 and 2 - a == Fraction(1, 2)
    with pytest.raises(ValueError):
        a + frames(1)
    assert isinstance(a / 3, Quantity) and spacing_name(Fraction(1, 30)) == "30fps"
    assert [clock_name(x) for x in (0, 59, 60, 3600, 3723)] == ["0s", "59s", "1m", "1h", "1h2m3s"]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9))
def test_plan_is_optimal(seed):
    r = random.Random(seed)
    n = r.randint(1, 5)
    cuts = [0]
    for _ in range(n):
        cuts.append(cuts[-1] + r.randint(1, 20))
    goal = Format(r.choice(["h264", "hevc", "rgb"]), 4, r.choice([4, 8]))
    choices = [[] for _ in range(n)]
    for v in range(r.randint(1, 6)):
        own, gops, at = Format(r.choice(["h264", "hevc", "rgb"]), 4, r.choice([4, 8])), [], 0
        while at < cuts[-1]:
            end = min(at + r.randint(1, 15), cuts[-1])
            gops.append((len(gops), at, end - 1))
            at = end
        for k in range(n):
            if v == 0 or r.random() < 0.8:
                low, high = cuts[k], cuts[k + 1] - 1
                choices[k].append(Fragment(v, low, high, own, tuple(g for g in gops if g[1] <= high and low <= g[2])))
    cost, plan = best_plan(choices, goal)
    assert cost == pytest.approx(brute_force(choices, goal)) and plan_cost(plan, goal) == pytest.approx(cost) and [x.start for x in plan] == cuts[:-1]
