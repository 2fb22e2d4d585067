import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemark.functions import intervals as iv
from tidemark.functions.intervals import TimeRange

ranges = st.lists(st.tuples(st.integers(0, 60), st.integers(0, 20)).map(lambda p: TimeRange(p[0], p[0] + p[1])), max_size=6)


def points(rs):
    return {x for r in rs for x in range(r.start, r.end)}


@given(ranges, ranges)
def test_algebra_is_that_of_sets_of_seconds(a, b):
    assert points(iv.subtract(a, b)) == points(a) - points(b)
    assert points(iv.intersect(a, b)) == points(a) & points(b)
    merged = iv.merge(a)
    assert points(merged) == points(a)
    assert all(x.end < y.start for x, y in zip(merged, merged[1:]))


@given(st.integers(-100, 100), st.integers(1, 30), st.integers(0, 29))
def test_floor_and_ceil(t, width, offset):
    lo, hi = iv.floor_to(t, width, offset), iv.ceil_to(t, width, offset)
    assert lo <= t <= hi and (lo - offset) % width == (hi - offset) % width == 0
    assert hi - lo in (0, width) and (hi == lo) == ((t - offset) % width == 0)


def test_aligned_range_gets_no_further_bucket():
    assert iv.align_out(TimeRange(3600, 7200), 3600) == TimeRange(3600, 7200)
    assert iv.align_out(TimeRange(5400, 9000), 3600) == TimeRange(3600, 10800)
    assert iv.align_in(TimeRange(5400, 9000), 3600) == TimeRange(3600, 7200)
    assert iv.align_within(TimeRange(5400, 9000), 3600) is None


def test_touching_ranges_share_nothing():
    assert TimeRange(0, 7200).intersect(TimeRange(7200, 14400)) is None


def test_range_must_not_end_before_it_starts():
    with pytest.raises(ValueError):
        TimeRange(2, 1)


@pytest.mark.parametrize(
    ("taken", "left"),
    [
        ((0, 5), [(10, 20)]),
        ((5, 15), [(15, 20)]),
        ((12, 15), [(10, 12), (15, 20)]),
        ((5, 25), []),
        ((15, 25), [(10, 15)]),
        ((25, 30), [(10, 20)]),
    ],
)
def test_the_six_overlaps(taken, left):
    assert iv.subtract([TimeRange(10, 20)], [TimeRange(*taken)]) == [TimeRange(*p) for p in left]
