import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quantafold.operators.spikes import flag_implausible, implausible


def series(values, start=2005):
    return [(start + i, v, 1) for i, v in enumerate(values)]


def test_spike_among_quiet_values():
    assert implausible(series([7291, 7221, 7401, 1927, 7829, 7620, 7324])) == [None, None, None, "spike", None, None, None]


def test_lasting_change_and_trend_are_none():
    assert not any(implausible(series([100, 103, 98, 101, 310, 305, 298, 311])))
    assert not any(implausible(series([100 * 1.3**k for k in range(10)])))


def test_mistake_of_units_at_the_end_and_twice():
    assert implausible(series([19.8, 19.9, 20.0, 19.4, 20.1, 0.1972, 0.1918]))[-2:] == ["spike", "spike"]
    assert implausible(series([22000, 21500, 20500, 21600, 21900000]))[-1] == "spike"


def test_negative_limit_and_stuck_runs():
    assert implausible(series([5, 6, -5, 6]))[2] == "negative"
    assert implausible(series([50, 51, 130, 52]), most=100)[2] == "above limit"
    assert implausible(series([5.0, 6.0, 6.0, 6.0, 6.0, 7.0])) == [None, "stuck", "stuck", "stuck", "stuck", None]
    assert not any(implausible(series([6.0, 6.0, 6.0, 5.0])))
    two = [(2000, 6.0, 1), (2001, 6.0, 1), (2001, 6.5, 1), (2002, 6.0, 1), (2003, 6.0, 1)]
    assert not any(implausible(two))


def test_short_series_have_no_spikes():
    assert implausible(series([1.0, 1000.0])) == [None, None]
    assert implausible([]) == []


def test_against_planted_spikes():
    rng = random.Random(7)
    hits = false = 0
    for _ in range(300):
        noise = rng.choice([0.02, 0.05, 0.08])
        values = [1000 * 2.718 ** rng.gauss(0, noise) for _ in range(12)]
        at = rng.randrange(1, 11)
        values[at] *= rng.choice([3.5, 0.2, 10, 1000, 0.001])
        why = implausible(series(values))
        hits += why[at] == "spike"
        false += sum(w is not None for k, w in enumerate(why) if k != at)
    assert hits >= 294 and false <= 6


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1990, 2030), st.floats(-1e12, 1e12), st.integers(1, 5)), max_size=30))
def test_any_series_is_judged(points):
    ordered = sorted(set(points))
    assert len(implausible(ordered)) == len(ordered)


def test_table_with_nulls_repeats_and_clashing_names(spark):
    data = [("a", y, v, "x") for y, v in zip(range(2000, 2008), [5.0, 5.1, 5.2, 50.0, 5.0, 5.1, 5.3, 5.2])] * 2
    data += [("a", None, 1.0, "x"), (None, 2000, 1.0, "x"), ("a", 2001, None, "x"), ("a", 2002, float("nan"), "x"), ("b", 2000, -1.0, "x")]
    df = spark.createDataFrame(data, "who string, year int, v double, _n string")
    got = sorted(map(tuple, flag_implausible(df, ["who"], "year", "v").collect()))
    assert got == [("a", 2003, 50.0, "spike"), ("b", 2000, -1.0, "negative")]
    assert flag_implausible(df.limit(0), ["who"], "year", "v").count() == 0


def test_long_series_cost_n_log_n():
    import random
    import time

    rng = random.Random(2)
    series = [(i, math.exp(rng.gauss(5, 0.2)), 1) for i in range(10_000)]
    series[5000] = (5000, 1e9, 1)
    began = time.process_time()
    found = [k for k, why in enumerate(implausible(series)) if why]
    assert 5000 in found and time.process_time() - began < 5
