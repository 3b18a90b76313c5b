"""Implausible values in yearly series (problem 6).

Robust exponentially weighted control charts per series, run-length counters and physical limits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChartRules:
    """How a chart works; logarithms are natural.

    weight: of a new year in mean and scale. trend_weight: in the yearly trend. width: limits in
    scales. floor: least limit, the log of the factor up to which a change is never a spike;
    short_floor: the same for series of fewer than *long* years, end_floor: for the first and the last
    year, where a lasting change can't be told from a spike. clip: scales to which a suspect is drawn
    before the update. steady: successive suspect years in agreement that make a new level. recent: of a longer
    run of suspects, the years whose median the next one is held against. stuck:
    successive reported years of one value that make a stuck run. most_change: the log of the factor
    from which another level is a mistake of units however long it lasts. most_trend: the steepest
    yearly trend.
    """

    weight: float = 0.4
    trend_weight: float = 0.1
    width: float = 5.0
    floor: float = 0.8
    short_floor: float = 1.1
    long: int = 6
    end_floor: float = 1.8
    clip: float = 3.0
    steady: int = 3
    recent: int = 32
    least_scale: float = 0.03
    most_scale: float = 0.5
    stuck: int = 4
    most_change: float = 3.0
    most_trend: float = 0.6


def chart(times: list[int], years: list[list[tuple[float, int]]], rules: ChartRules = ChartRules(), least: float = 0.0) -> list[set[int]]:
    """One pass over the years of a series, each a list of (log value, count): the suspects' places by year.

    The trend begins at the median slope between years that lie 1, 2, 4, 8, ... points apart (in short series,
    successive ones), so that a series of n points costs n log n, the scale at the median deviation of the steps
    from it, the mean at the median of the first three years without trend, so that spikes among them
    don't count; then each year moves them by its unsuspected median, or by the suspects drawn to the
    limit. Suspect years in a row that agree become the new level and aren't suspects. *least*: a limit
    to use at least.
    """
    centres = [_centre(y) for y in years]
    gaps = [abs(b - a) or 1 for a, b in zip(times[:-1], times[1:], strict=True)]
    steps = [b - a for a, b in zip(centres[:-1], centres[1:], strict=True)]
    ages = [abs(t - times[0]) for t in times]
    strides, most = [1], len(times) if len(times) >= rules.long else 2
    while strides[-1] * 2 < most:
        strides.append(strides[-1] * 2)
    slopes = [(centres[i + h] - centres[i]) / max(ages[i + h] - ages[i], 1) for h in strides for i in range(len(times) - h)]
    trend = max(-rules.most_trend, min(rules.most_trend, median(slopes)))
    spread = median(abs(d - trend * g) for d, g in zip(steps, gaps, strict=True))
    scale = min(rules.most_scale, max(rules.least_scale, 1.4826 * spread / math.sqrt(2)))
    plain = [c - trend * a for c, a in zip(centres, ages, strict=True)]
    level, overall = median(plain[:3]), median(plain)
    if abs(level - overall) > rules.most_change:
        level = overall
    before = 0
    flagged: list[set[int]] = []
    run: list[int] = []
    usual = rules.floor if len(years) >= rules.long else rules.short_floor
    for t, values in enumerate(years):
        gap, before = ages[t] - before, ages[t]
        level += trend * gap
        floor = rules.end_floor if t in (0, len(years) - 1) else usual
        limit = max(floor, rules.width * scale, least)
        out = {k for k, (x, _) in enumerate(values) if abs(x - level) > limit}
        flagged.append(out)
        kept = [v for k, v in enumerate(values) if k not in out]
        if kept:
            run = []
            step = _centre(kept) - level
        else:
            if run and abs(centres[t] - median(centres[r] + trend * (ages[t] - ages[r]) for r in run[-rules.recent :])) > limit:
                run = []
            run.append(t)
            if len(run) >= rules.steady and abs(centres[t] - level) <= rules.most_change:
                level = median(centres[r] + trend * (ages[t] - ages[r]) for r in run[-rules.recent :])
                for r in run:
                    at = level + trend * (ages[r] - ages[t])
                    flagged[r] = {k for k, (x, _) in enumerate(years[r]) if abs(x - at) > limit}
                run = []
                continue
            step = centres[t] - level
        bound = rules.clip * scale
        step = max(-bound, min(bound, step))
        level += rules.weight * step
        trend += rules.trend_weight * rules.weight * step / max(gap, 1)
        scale = min(rules.most_scale, max(rules.least_scale, (1 - rules.weight / 4) * scale + rules.weight / 4 * 1.25 * abs(step)))
    return flagged


def _centre(values: list[tuple[float, int]]) -> float:
    """The median, each value as often as it's counted."""
    ordered = sorted(values)
    half, seen = sum(n for _, n in ordered) / 2, 0
    for x, n in ordered:
        seen += n
        if seen >= half:
            return x
    return ordered[-1][0]


def implausible(series: list[tuple[int, float, int]], most: float | None = None, rules: ChartRules = ChartRules()) -> list[str | None]:
    """For each (year, value, count) of a series in order of year: why it's implausible, or None.

    'negative', 'above limit' (over *most*), 'stuck' or 'spike'. A spike is a suspect of the charts
    run forward and backward over time, so that a lasting change of level, which only one of them
    suspects, isn't one. Series of fewer than three years have no usual movement and no spikes.
    """
    why: list[str | None] = [None] * len(series)
    for k, (_, v, _) in enumerate(series):
        if v < 0:
            why[k] = "negative"
        elif most is not None and v > most:
            why[k] = "above limit"
    by_year: dict[int, list[int]] = {}
    for k, (y, _, _) in enumerate(series):
        by_year.setdefault(y, []).append(k)
    ordered = [by_year[y] for y in sorted(by_year)]
    start = 0
    for end in range(1, len(ordered) + 1):  # run lengths of single-valued years
        same = end < len(ordered) and len(ordered[end]) == len(ordered[start]) == 1 and series[ordered[end][0]][1] == series[ordered[start][0]][1]
        if not same:
            if end - start >= rules.stuck and len(ordered[start]) == 1:
                for years in ordered[start:end]:
                    why[years[0]] = why[years[0]] or "stuck"
            start = end
    places = [[k for k in years if series[k][1] > 0] for years in ordered]
    places = [p for p in places if p]
    if len(places) >= 3:
        lows = [math.log(min(series[k][1] for k in p)) for p in places]
        for least in (rules.most_change, 0.0):  # mistakes of units first, as they hide the usual movement
            if len(places) < 3:
                break
            times = [series[p[0]][0] for p in places]
            logs = [[(math.log(series[k][1]), series[k][2]) for k in p] for p in places]
            ahead = chart(times, logs, rules, least)
            back = chart(times[::-1], logs[::-1], rules, least)[::-1]
            out = {p[j] for p, a, b in zip(places, ahead, back, strict=True) for j in a & b}
            for k in out:
                why[k] = why[k] or "spike"
            places = [q for p in places if (q := [k for k in p if k not in out])]
        if min(lows) > math.log(10):  # a zero among values that are never small
            for k, (_, v, _) in enumerate(series):
                if v == 0:
                    why[k] = why[k] or "spike"
    return why


def flag_implausible(rows: DataFrame, source: list[str], time: str, value: str, limits: dict[str, float] | None = None, limit_key: str | None = None, rules: ChartRules = ChartRules()) -> DataFrame:
    """The distinct points (*source*, *time*, *value*) that are implausible, with `why`.

    limits: the physical maximum by the value of *limit_key*, one of *source*. Rows are reduced to
    distinct points with counts by partial aggregates before each series goes to one task in order, so
    a source that holds a third of all rows weighs what its distinct values do; a task reads its series
    one after the other and holds one at a time.

    Cases: rows with a null in *source*, *time* or *value*, and NaN or infinite values, aren't judged;
    repeated rows only count; an empty table gives no rows; ties of value are one point.
    """
    points = rows.select(*source, time, value).dropna().filter(~F.isnan(value) & (F.abs(value) < float("inf"))).groupBy(*source, time, value).agg(F.count("*").alias("_n"))
    ordered = points.repartition(*source).sortWithinPartitions(*source, time, value)
    most_of, key_at = dict(limits or {}), source.index(limit_key) if limit_key else None
    names = [*source, time, value, "why"]
    types = dict(points.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in names[:-1]), "why string"])

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def series() -> Iterator[tuple[tuple, list]]:
            key, held = None, []
            for part in parts:
                columns = [part[c].tolist() for c in (*source, time, value, "_n")]
                for row in zip(*columns, strict=True):
                    if row[: len(source)] != key:
                        if held:
                            yield key, held
                        key, held = row[: len(source)], []
                    held.append(row[len(source) :])
            if held:
                yield key, held

        found: list[tuple] = []
        for key, held in series():
            most = most_of.get(key[key_at]) if key_at is not None else None
            for (t, v, _), why in zip(held, implausible(held, most, rules), strict=True):
                if why:
                    found.append((*key, t, v, why))
            if len(found) >= 10_000:
                yield pd.DataFrame(found, columns=names)
                found = []
        yield pd.DataFrame(found, columns=names)

    return ordered.mapInPandas(judge, schema)
