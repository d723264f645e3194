"""Unit commitment against prices: an exact on/off dynamic programme, for all generators of a region at once."""

from __future__ import annotations

import numpy as np


def best_schedules(price: np.ndarray, reserve: np.ndarray, units: dict[str, np.ndarray], banned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, p, value): the cheapest schedule of each unit for given prices of energy and reserve.

    The state is how long a unit has been on (up to its minimum up time) or off.  Output follows the
    price: all of it where the price covers the fuel cost, else the least that the unit can run at.
    Units that share their minimum times share the states and are solved side by side.
    """
    p_on = np.where(price > units["cost"][:, None], units["mw"][:, None], units["p_min"][:, None])
    run = (units["cost"][:, None] - price) * p_on + units["fixed"][:, None] - reserve * units["mw"][:, None]
    run = np.where(banned, np.inf, run)
    u, value = np.zeros(run.shape, int), np.zeros(len(run))
    times = np.maximum(np.c_[units["min_up"], units["min_down"]].astype(int), 1)
    for up, down in np.unique(times, axis=0).tolist():
        at = np.flatnonzero((times == (up, down)).all(axis=1))
        u[at], value[at] = _side_by_side(run[at], banned[at], units["startup"][at], units["shutdown"][at], up, down)
    return u, np.where(u == 1, p_on, 0.0), value


def _side_by_side(run: np.ndarray, banned: np.ndarray, startup: np.ndarray, shutdown: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
    g, n = run.shape
    states = up + down  # 0..up-1: on for that long and more; up..: off
    cost, back = np.full((states, g), np.inf), np.zeros((n, states, g), np.int16)
    cost[states - 1] = 0.0
    # where a state leads: (from, to, what it costs); those of one aim in order of their source
    moves = [(s, min(s + 1, up - 1), "run") for s in range(up)] + [(s, up, "stop") for s in range(up)]
    moves += [(up + off, up + min(off + 1, down - 1), "rest") for off in range(down)] + [(states - 1, 0, "start")]
    for t in range(n):
        new = np.full((states, g), np.inf)
        price = {"run": run[:, t], "rest": np.zeros(g), "start": run[:, t] + startup}
        for s, to, kind in sorted(moves):
            c = np.where((s == up - 1) | banned[:, t], shutdown, np.inf) if kind == "stop" else price[kind]
            better = cost[s] + c < new[to]
            new[to] = np.where(better, cost[s] + c, new[to])
            back[t, to][better] = s
        cost = new
    s = np.argmin(cost, axis=0)
    value, u, every = cost[s, np.arange(g)], np.zeros((g, n), int), np.arange(g)
    for t in range(n - 1, -1, -1):
        u[:, t] = s < up
        s = back[t, s, every].astype(int)
    return u, value


def dispatch(demand: np.ndarray, u: np.ndarray, p_min: np.ndarray, mw: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Output of committed units (units x periods): the least each runs at, then by merit order."""
    p = u * p_min[:, None]
    left = np.maximum(demand - p.sum(0), 0)
    for g in np.argsort(cost, kind="stable"):
        more = np.minimum(left, u[g] * (mw[g] - p_min[g]))
        p[g] += more
        left -= more
    return p


def schedule(demand: np.ndarray, reserve: float, units: list[dict], banned: np.ndarray, rounds: int = 40) -> dict:
    """Lagrangian relaxation with repair: a feasible schedule, its cost, and a lower bound.

    ``status`` is Optimal only within a relative gap of 1 %, Feasible beyond, Infeasible where even
    all units together cannot meet demand and reserve.
    """
    g, n = len(units), len(demand)
    columns = {k: np.array([x[k] for x in units], float) for k in ("mw", "p_min", "cost", "fixed", "startup", "shutdown", "min_up", "min_down")}
    mw, p_min, cost = (columns[k] for k in ("mw", "p_min", "cost"))
    need = demand * (1 + reserve)
    can = ((~banned) * mw[:, None]).sum(0) if g else np.zeros(n)
    if g == 0 or (can < need - 1e-9).any():
        return {"status": "Infeasible", "u": np.zeros((g, n), int), "p": np.zeros((g, n)), "cost": float("nan"), "bound": float("nan")}
    price, mu, best, bound = np.full(n, float(np.median(cost))), np.zeros(n), None, -np.inf
    full = fullest(units, banned)
    for k in range(rounds):
        u, p, value = best_schedules(price, mu, columns, banned)
        bound = max(bound, float(value.sum()) + float(price @ demand + mu @ need))
        fixed = repair(need, u, mw, full, cost)
        if fixed is not None:
            out = dispatch(demand, fixed, p_min, mw, cost)
            total = price_of(fixed, out, units)
            if (out.sum(0) >= demand - 1e-6).all() and (best is None or total < best[0]):
                best = (total, fixed, out)
        step = 1.0 / (1 + k)
        price = np.maximum(price + step * (demand - p.sum(0)) / max(demand.max(), 1) * cost.max(initial=1), 0)
        mu = np.maximum(mu + step * (need - (u * mw[:, None]).sum(0)) / max(need.max(), 1) * cost.max(initial=1) * 0.1, 0)
    if best is None:
        return {"status": "Not Solved", "u": np.zeros((g, n), int), "p": np.zeros((g, n)), "cost": float("nan"), "bound": bound}
    gap = (best[0] - bound) / max(abs(best[0]), 1e-9)
    return {"status": "Optimal" if gap <= 0.01 else "Feasible", "u": best[1], "p": best[2], "cost": best[0], "bound": bound}


def fullest(units: list[dict], banned: np.ndarray) -> np.ndarray:
    """On whenever it is allowed, less runs that a ban would end before their minimum up time."""
    full = (~banned).astype(int)
    for g in np.flatnonzero(banned.any(axis=1)):
        up, down, since, n = int(units[g]["min_up"]), int(units[g]["min_down"]), int(units[g]["min_down"]), banned.shape[1]
        for t in range(n):  # a ban shorter than the minimum down time delays the next start
            if full[g, t] and since and since < down:
                full[g, t] = 0
            since = 0 if full[g, t] else since + 1
        cuts = np.r_[0, np.flatnonzero(np.diff(full[g])) + 1, n]
        for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if stop < n and stop - start < up:
                full[g, start:stop] = 0
    return full


def repair(need: np.ndarray, u: np.ndarray, mw: np.ndarray, full: np.ndarray, cost: np.ndarray) -> np.ndarray | None:
    """Commit further units, cheapest first, over all periods of ``full`` until every period's need is covered."""
    u = u.copy()
    online = (u * mw[:, None]).sum(0)
    for g in np.argsort(cost, kind="stable"):
        if not (online < need - 1e-9).any():
            break
        if (full[g] >= u[g]).all():
            online = online + (full[g] - u[g]) * mw[g]
            u[g] = full[g]
    return u if ((u * mw[:, None]).sum(0) >= need - 1e-9).all() else None


def price_of(u: np.ndarray, p: np.ndarray, units: list[dict]) -> float:
    before = np.c_[np.zeros(len(units), int), u[:, :-1]]
    return float(sum(x["cost"] * p[i].sum() + x["fixed"] * u[i].sum() + x["startup"] * ((u[i] == 1) & (before[i] == 0)).sum() + x["shutdown"] * ((u[i] == 0) & (before[i] == 1)).sum() for i, x in enumerate(units)))
