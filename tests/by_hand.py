"""The forecast of one cycle in plain Python, day by day, to compare with."""

import datetime as dt
import statistics
from collections import defaultdict

Z = statistics.NormalDist().inv_cdf(0.95)


def dow(day):
    return day.isoweekday() % 7 + 1


def days(first, last):
    return [first + dt.timedelta(i) for i in range((last - first).days + 1)]


class Cycle:
    def __init__(self, demand, cal, cycle_id, warehouses):
        """``demand`` maps (warehouse, day) to a number."""
        self.demand, self.cal, self.id, self.warehouses = demand, cal, cycle_id, warehouses
        delivery = cal.start_date + dt.timedelta((cycle_id - 1) * cal.cadence_days)
        self.delivery = delivery
        self.window = {
            role: days(*(delivery + dt.timedelta(o) for o in cal.offsets(role)))
            for role in ("target", "comp_target", "pre", "pre_prev", "span")
        }

    def rows(self, role):
        inside = set(self.window[role])
        return {k: v for k, v in self.demand.items() if k[1] in inside}

    def total(self, role):
        return sum(self.rows(role).values())

    @property
    def growth(self):
        base = self.total("pre_prev")
        return (self.total("pre") - base) / base if base else None

    def volumes(self):
        pre = self.rows("pre")
        by_wh, by_dow = defaultdict(float), defaultdict(float)
        for (w, d), v in pre.items():
            by_wh[w] += v
            by_dow[w, dow(d)] += v
        everything = sum(by_wh.values())
        expected = None if self.growth is None else self.total("comp_target") * (1 + self.growth)
        out = {}
        for (w, k), v in by_dow.items():
            defined = expected is not None and everything and by_wh[w]
            out[w, k] = by_wh[w] / everything * expected / self.cal.f_horizon_weeks * v / by_wh[w] if defined else None
        return out

    def forecast(self):
        """{(warehouse, day or None, dow): volume}, as a full join of volumes and target days."""
        volumes = self.volumes()
        out = {(w, d, dow(d)): volumes.get((w, dow(d))) or 0.0 for w in self.warehouses for d in self.window["target"]}
        out |= {(w, None, k): v or 0.0 for (w, k), v in volumes.items() if w not in self.warehouses}
        return out

    def spreads(self):
        """Spread of this cycle's own error: {(warehouse, dow or None): sd or None}."""
        volumes, errors = self.volumes(), defaultdict(list)
        for (w, d), actual in self.rows("target").items():
            nobody = w is None and dow(d) not in {k for _, k in volumes}
            known = (w, dow(d)) in volumes or nobody
            forecast = volumes.get((w, dow(d)))
            errors[w, dow(d) if known else None].append(None if forecast is None else forecast - actual)
        return {
            k: statistics.stdev(e) if len(e) > 1 and None not in e else None for k, e in errors.items()
        }

    def calibration(self):
        steps, rest = divmod(7 * self.cal.p_horizon_weeks, self.cal.cadence_days)
        earlier = self.id - steps
        return Cycle(self.demand, self.cal, earlier, self.warehouses) if not rest and earlier >= 1 else None

    def with_interval(self):
        """{(warehouse, day, dow): (volume, lower, upper)}."""
        calibration = self.calibration()
        spreads = calibration.spreads() if calibration else {}
        forecast = self.forecast()
        out = {}
        for (w, d, k), f in forecast.items():
            sd = spreads.get((w, k))
            out[w, d, k] = (f, None, None) if sd is None else (f, max(f - Z * sd, 0.0), f + Z * sd)
        present = {(w, k) for w, _, k in forecast}
        return out | {(w, None, k): (None, None, None) for w, k in spreads if (w, k) not in present}
