"""Plain-Python restatement of the feature rules, one subject at a time, for small fixtures."""

from __future__ import annotations

import datetime as dt
import math
from collections import defaultdict

EPOCH = dt.datetime(1970, 1, 1)


def _bin(ts, cadence):
    return math.floor((ts - EPOCH).total_seconds() / cadence)


def _grid(glucose, cadence, limit):
    by_ts = {}
    for ts, value, pos in sorted(glucose, key=lambda g: g[2]):
        by_ts.setdefault(ts, value)
    bins = defaultdict(list)
    for ts, value in by_ts.items():
        bins[_bin(ts, cadence)].append(value)
    observed = sorted((b, sum(v) / len(v)) for b, v in bins.items())
    grid = []
    for i, (b, value) in enumerate(observed):
        grid.append((b, value))
        if i + 1 < len(observed):
            nb, nvalue = observed[i + 1]
            for k in range(1, min(nb - b - 1, limit) + 1):
                grid.append((b + k, (nvalue - value) / (nb - b) * k + value))
    return grid


def features(events, cadence=300, limit=3, rows=12):
    """events: (subject, stream, ts, value, pos). Returns {(subject, ts): dict}."""
    result = {}
    for subject in {e[0] for e in events}:
        own = [e for e in events if e[0] == subject and e[3] is not None]
        grid = _grid([e[2:] for e in own if e[1] == "glucose"], cadence, limit)
        bolus, carbs, basal = defaultdict(float), defaultdict(float), {}
        for _, stream, ts, value, pos in sorted(own, key=lambda e: (e[2], e[4])):
            b = _bin(ts, cadence)
            if stream == "bolus":
                bolus[b] += value
            elif stream == "meal":
                carbs[b] += value
            elif stream == "basal":
                basal[b] = value
        rate = 0.0
        for i, (b, value) in enumerate(grid):
            ts = EPOCH + dt.timedelta(seconds=b * cadence)
            rate = basal.get(b, rate)
            recent = [g[0] for g in grid[max(0, i - rows + 1) : i + 1]]
            hour, day = 2 * math.pi * ts.hour / 24, 2 * math.pi * ts.weekday() / 7
            result[subject, ts] = {
                "glucose_mg_dl": value,
                "glucose_delta_1": value - grid[i - 1][1] if i >= 1 else None,
                "glucose_delta_3": value - grid[i - 3][1] if i >= 3 else None,
                "bolus_last_1h": sum(bolus.get(r, 0.0) for r in recent),
                "basal_rate": rate,
                "carbs_last_1h": sum(carbs.get(r, 0.0) for r in recent),
                "hour_sin": math.sin(hour),
                "hour_cos": math.cos(hour),
                "dow_sin": math.sin(day),
                "dow_cos": math.cos(day),
                "is_hypo": int(value < 70),
                "is_hyper": int(value > 180),
            }
    return result
