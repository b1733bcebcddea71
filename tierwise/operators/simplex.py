"""Weights on the simplex that tell a target: whole groups in a task up to a bound of rows, larger ones by grouped sums a step."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import written
from .metrics import correlation
from .ordered import matched, order_statistics, ranked

#: Different rows of a group that one task fits, those of a block of a larger group, and steps between two tables of its weights.
WHOLE, BLOCK_ROWS, BETWEEN = 1 << 16, 4096, 8


@dataclass(frozen=True)
class Descent:
    """Steps, their rate, the slope of the score, folds, regularisations to try, the one without folds, and the correlation of a used feature."""

    steps: int = 800
    rate: float = 0.05
    slope: float = 8.0
    folds: int = 3
    grid: tuple[float, ...] = (1e-3, 1e-2, 0.1, 0.3)
    base: float = 1e-2
    least: float = 0.03

    def chosen(self, low: np.ndarray, high: np.ndarray, r: np.ndarray, share: float) -> tuple[list[int], float]:
        """Features that are used, and the least regularisation: rare targets raise it. r: correlations with the target, 0 where one hardly varies."""
        varies = high - low >= 1e-9
        usable = np.flatnonzero(varies) if varies.any() else np.arange(len(low))
        active = [int(k) for k in usable if abs(r[k]) >= self.least]
        if len(active) < 2:
            active = [int(k) for k in sorted(usable, key=lambda k: -abs(r[k]))[:2]]
        return active, 0.1 if share < 0.1 else 0.03 if share < 0.2 else 0.0

    def tried(self, floor: float) -> list[float]:
        return [e for e in self.grid if e >= floor] or [max(floor, 1e-3)]

    def likelihood(self, z: np.ndarray, w: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (z @ w - 0.5), -35, 35)))

    def gradient(self, z: np.ndarray, t: np.ndarray, w: np.ndarray, n: float, positive: float, times: np.ndarray | float = 1.0) -> np.ndarray:
        """Of the rows' share of the loss, each as often as ``times`` tells; both kinds of targets count alike among the n rows, of which ``positive`` are over a half."""
        weight = times * np.where(t > 0.5, n / (2 * max(1, positive)), n / (2 * max(1, n - positive)))
        return self.slope * ((self.likelihood(z, w) - t) * weight) @ z / n

    def step(self, w: np.ndarray, g: np.ndarray, ent: float) -> np.ndarray:
        """Down the gradient, less ``ent`` times (1 + log w), and back onto the simplex."""
        g = g - ent * (np.log(np.maximum(w, 1e-9)) + 1)
        w = np.maximum(np.maximum(w, 1e-9) - self.rate * g, 0)
        w = np.full(len(w), 1 / len(w)) if w.sum() <= 0 else np.maximum(w / w.sum(), 1e-9)
        return w / w.sum()


def log_losses(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return -(t * np.log(p) + (1 - t) * np.log(1 - p))


def normal(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Between the bounds, from 0 to 1; a feature without a range is as if its bounds were 1 apart."""
    return np.clip((rows - low) / (np.where(high <= low, low + 1.0, high) - low), 0, 1)


def simplex_weights(x: np.ndarray, y: np.ndarray, **options) -> tuple[np.ndarray, float]:
    """Weights that sum to 1 of features whose weighted, normalised sum tells the targets (0 to 1), and the regularisation chosen.

    Features are bounded by their 5th and 95th percentiles; rows are weighted so that both kinds of targets count alike. The regularisation is the one
    with the least loss over folds by rank of the target. Options are those of Descent. Features that never vary or hardly correlate get almost nothing.
    """
    descent, (n, d) = Descent(**options), x.shape
    y = np.clip(y, 0, 1)

    def bounds(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v, m = np.sort(rows, axis=0), len(rows)
        return v[int(0.05 * m)], v[min(m - 1, int(0.95 * m))]

    def descend(z: np.ndarray, t: np.ndarray, ent: float) -> np.ndarray:
        w = np.full(z.shape[1], 1 / z.shape[1])
        for _ in range(descent.steps):
            w = descent.step(w, descent.gradient(z, t, w, len(t), (t > 0.5).sum()), ent)
        return w

    sd, r = x.std(axis=0), np.zeros(d)
    if y.std() >= 1e-9:
        ok = sd >= 1e-9
        r[ok] = ((x - x.mean(axis=0)) * (y - y.mean())[:, None]).mean(axis=0)[ok] / (sd[ok] * y.std())
    active, floor = descent.chosen(x.min(axis=0), x.max(axis=0), r, (y > 0.5).mean())
    xs, best, chosen = x[:, active], np.inf, max(floor, descent.base)
    if n >= 8:
        k = max(2, min(descent.folds, n))
        fold = np.empty(n, int)
        fold[np.argsort(y, kind="stable")] = np.arange(n) % k
        for ent in descent.tried(floor):
            losses = []
            for f in range(k):
                a, b = fold != f, fold == f
                lim = bounds(xs[a])
                w = descend(normal(xs[a], *lim), y[a], ent)
                losses.append(log_losses(descent.likelihood(normal(xs[b], *lim), w), y[b]).mean())
            if np.mean(losses) < best:
                best, chosen = np.mean(losses), ent
    chosen = max(floor, chosen)
    out = np.full(d, 1e-9)
    out[active] = descend(normal(xs, *bounds(xs[: max(1, int(0.8 * n))])), y, chosen)
    return out / out.sum(), float(chosen)


def learn_weights(df: DataFrame, by: list[str], features: list[str], target: str, order_by: list[str], descent: Descent = Descent(), whole: int = WHOLE) -> DataFrame:
    """(by, weights, entropy_reg) by group; order_by must tell a group's rows apart. Missing values count as 0.

    A group of up to ``whole`` rows is fitted by simplex_weights in one task. Larger ones take the same steps with the same result but for the order of sums: ranks,
    bounds and moments come from slices, and equal rows are counted by fold. Up to ``whole`` different rows are fitted in one task; of more, each step is one pass
    over sums of blocks of all such groups.
    """
    value = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = df.select(*by, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_by)], F.array(*[value(f) for f in features]).alias("_x"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), value(target))).alias("_y"))
    kinds, order = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by), [f"_o{i}" for i in range(len(order_by))]
    schema = f"{kinds}, weights array<double>, entropy_reg double"
    sizes = written(rows.groupBy(*by).agg(F.count("*").alias("_n")))

    def fit(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order)
        w, ent = simplex_weights(np.stack(g["_x"].to_list()), g["_y"].to_numpy(float), **vars(descent))
        return pd.DataFrame([[*key, w.tolist(), ent]], columns=[*by, "weights", "entropy_reg"])

    bound = max(whole, 7, descent.folds)  # smaller groups have no folds
    small = matched(rows, sizes.where(F.col("_n") <= bound).select(*by), by, "left_semi").select(*rows.columns).groupBy(*by).applyInPandas(fit, schema)
    if sizes.where(F.col("_n") > bound).isEmpty():
        return small
    large = matched(rows, sizes.where(F.col("_n") > bound), by)
    return small.unionByName(_by_sums(large, by, kinds, len(features), order, descent, bound))


def _by_sums(rows: DataFrame, by: list[str], kinds: str, d: int, order: list[str], descent: Descent, bound: int) -> DataFrame:
    """learn_weights of groups whose rows lie in many tasks; up to ``bound`` different ones are fitted in one. rows: by, order, _x, _y and the group's size _n."""
    k, tries = descent.folds, len(descent.grid)
    by_target = ranked(ranked(rows, by, order[0], order[1:], "_at"), by, "_y", order, "_r")
    placed = written(by_target.select(*by, "_x", "_y", "_r", (F.col("_r") % k).cast("int").alias("_fold"), (F.col("_at") < F.greatest(F.lit(1), F.floor(F.lit(0.8) * F.col("_n")))).alias("_early")))

    # A set of rows for each fold left out, and one (k) of the first four fifths, which bounds the last fit.
    each, y = range(d), F.col("_y")
    one = lambda i: F.col("_x")[i]
    count = lambda s: F.count_if(F.col("_fold") != s) if s < k else F.count("*")
    above = lambda s: F.count_if((y > 0.5) & (F.col("_fold") != s)) if s < k else F.count_if(y > 0.5)
    facts = placed.groupBy(*by).agg(
        F.array(*[F.min(one(i)) for i in each]).alias("_low"), F.array(*[F.max(one(i)) for i in each]).alias("_high"), F.avg((y > 0.5).cast("double")).alias("_share"),
        F.array(*[correlation(one(i), y) for i in each]).alias("_corr"), F.array(*[count(s).cast("double") for s in range(k + 1)]).alias("_size"), F.array(*[above(s).cast("double") for s in range(k + 1)]).alias("_above"),
    )
    sets = F.array_compact(F.array(*[F.when(F.col("_fold") != s, F.lit(s)) for s in range(k)], F.when(F.col("_early"), F.lit(k))))
    long = placed.select(*by, F.explode(sets).alias("_set"), "_x").select(*by, "_set", F.posexplode("_x").alias("_f", "_v"))
    at = order_statistics(long, [*by, "_set", "_f"], "_v", {"lo": F.floor(F.lit(0.05) * F.col("n")), "hi": F.least(F.col("n") - 1, F.floor(F.lit(0.95) * F.col("n")))})
    limits = at.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_set", "_f", "lo", "hi"))), lambda e: F.array(e["lo"], e["hi"])).alias("_limits"))
    state = matched(facts, limits.withColumn("_limits", F.flatten("_limits")), by)

    counts = F.array(*[F.count_if(F.col("_fold") == s).cast("double") for s in range(k)])
    packed = written(placed.groupBy(*by, "_x", "_y").agg(counts.alias("_c")))
    state = matched(state, packed.groupBy(*by).agg(F.count("*").alias("_m")), by)

    fixed = f"{kinds}, _size array<double>, _above array<double>, _limits array<double>, _active array<int>, _floor double, _ents array<double>, _m long"
    kept, fixed_names = f"{fixed}, _w array<double>", ["_size", "_above", "_limits", "_active", "_floor", "_ents", "_m"]
    carried = [*by, *fixed_names, "_w"]
    used = ["_active", "_ys", "_cs", "_xs", "_limits", "_w", "_size", "_above"]
    # (set, place of its regularisation): with each fold left out, and the last fit of each regularisation, of which the chosen one's is kept.
    folded = [(s, e) for e in range(tries) for s in range(k)]
    problems = [*folded, *[(k, e) for e in range(tries)]]

    def begin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in frames:
            found = [descent.chosen(np.array(a), np.array(b), np.array(r), s) for a, b, r, s in zip(g["_low"], g["_high"], g["_corr"], g["_share"], strict=True)]
            g["_active"], g["_floor"] = [a for a, _ in found], [f for _, f in found]
            # Unused places of the grid repeat its last value.
            g["_ents"] = [(e := descent.tried(f)) + [e[-1]] * (tries - len(e)) for _, f in found]
            g["_w"] = [np.full(len(problems) * len(a), 1 / len(a)) for a, _ in found]
            yield g[carried]

    def sets_of(x: np.ndarray, c: np.ndarray, limits: np.ndarray, active: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The rows as each set bounds them, and how often they are in it."""
        lim, every = np.asarray(limits).reshape(k + 1, d, 2)[:, active], c.sum(axis=1)
        return [(normal(x[:, active], lim[s, :, 0], lim[s, :, 1]), every - c[:, s] if s < k else every) for s in range(k + 1)]

    def slopes(sets: list, t: np.ndarray, w: np.ndarray, size: np.ndarray, above: np.ndarray) -> np.ndarray:
        return np.stack([descent.gradient(sets[s][0], t, w[i], size[s], above[s], sets[s][1]) for i, (s, _) in enumerate(problems)])

    def losses(sets: list, t: np.ndarray, c: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.array([(log_losses(descent.likelihood(sets[s][0], w[i]), t) * c[:, s]).sum() for i, (s, _) in enumerate(folded)])

    def stepped(w: np.ndarray, total: np.ndarray, ents: np.ndarray) -> np.ndarray:
        return np.stack([descent.step(w[i], total[i], ents[e]) for i, (_, e) in enumerate(problems)])

    def chosen(total: np.ndarray, size: np.ndarray) -> int:
        return int(np.argmin((np.asarray(total).reshape(tries, k) / (size[k] - np.asarray(size)[:k])).mean(axis=1)))

    def fit(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        r = g.iloc[0]
        x, t, c, active = np.stack(g["_x"].to_list()), g["_y"].to_numpy(float), np.stack(g["_c"].to_list()), np.asarray(r["_active"], int)
        sets, w = sets_of(x, c, r["_limits"], active), np.full((len(problems), len(active)), 1 / len(active))
        for _ in range(descent.steps):
            w = stepped(w, slopes(sets, t, w, r["_size"], r["_above"]), r["_ents"])
        e = chosen(losses(sets, t, c, w), r["_size"])
        full = np.full(d, 1e-9)
        full[active] = w[len(folded) + e]
        return pd.DataFrame([[*key, (full / full.sum()).tolist(), float(r["_ents"][e])]], columns=[*by, "weights", "entropy_reg"])

    state = written(state.mapInPandas(begin, kept))
    few = matched(packed, state.where(F.col("_m") <= bound).drop("_w"), by).groupBy(*by).applyInPandas(fit, f"{kinds}, weights array<double>, entropy_reg double")
    state = state.where(F.col("_m") > bound)
    if state.isEmpty():
        return few

    # The number of blocks follows from that of the different rows.
    put = F.pmod(F.xxhash64("_x", "_y"), F.ceil(F.col("_m") / BLOCK_ROWS))
    blocks = matched(packed, state.select(*by, "_m"), by).groupBy(*by, put.alias("_block")).agg(F.collect_list(F.struct("_x", "_y", "_c")).alias("_rows"))
    blocks = written(blocks.select(*by, F.flatten(F.col("_rows._x")).alias("_xs"), F.col("_rows._y").alias("_ys"), F.flatten(F.col("_rows._c")).alias("_cs")))

    def per_block(held_out: bool):
        """Each block's part of every problem's gradient, or of its loss on the rows held out; gradients have d places a problem, of which the first are used."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for g in frames:
                out = []
                for r in g.rename(columns={c: f"{c[1:]}_" for c in used}).itertuples(index=False):
                    active, t, c = np.asarray(r.active_, int), np.asarray(r.ys_), np.asarray(r.cs_).reshape(-1, k)
                    sets, w = sets_of(np.asarray(r.xs_).reshape(len(t), d), c, r.limits_, active), np.asarray(r.w_).reshape(-1, len(active))
                    if held_out:
                        out.append(losses(sets, t, c, w))
                    else:
                        parts = np.zeros((len(w), d))
                        parts[:, : len(active)] = slopes(sets, t, w, r.size_, r.above_)
                        out.append(parts.ravel())
                g["_part"] = out
                yield g[[*carried, "_part"]]

        return run

    def sums(state: DataFrame, held_out: bool = False) -> DataFrame:
        width = len(folded) if held_out else len(problems) * d
        parts = matched(blocks, state, by).mapInPandas(per_block(held_out), f"{kept}, _part array<double>")
        # The state comes along with the sums, so that it is read once a step.
        return parts.groupBy(*by).agg(F.array(*[F.sum(F.col("_part")[i]) for i in range(width)]).alias("_sum"), *[F.first(c).alias(c) for c in carried[len(by) :]])

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in frames:
            new = []
            for active, ents, w, total in zip(g["_active"], g["_ents"], g["_w"], g["_sum"], strict=True):
                n = len(active)
                new.append(stepped(np.asarray(w).reshape(-1, n), np.asarray(total).reshape(-1, d)[:, :n], ents).ravel())
            g["_w"] = new
            yield g[carried]

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in frames:
            out, ents = [], []
            for active, w, total, size, tried in zip(g["_active"], g["_w"], g["_sum"], g["_size"], g["_ents"], strict=True):
                e, full = chosen(total, size), np.full(d, 1e-9)
                full[np.asarray(active, int)] = np.asarray(w).reshape(len(problems), -1)[len(folded) + e]
                out.append(full / full.sum())
                ents.append(float(tried[e]))
            g["weights"], g["entropy_reg"] = out, ents
            yield g[[*by, "weights", "entropy_reg"]]

    for i in range(descent.steps):
        state = sums(state).mapInPandas(step, kept)
        if i % BETWEEN == BETWEEN - 1:
            state = written(state)
    state = state if descent.steps % BETWEEN == 0 else written(state)
    return few.unionByName(sums(state, True).mapInPandas(finish, f"{kinds}, weights array<double>, entropy_reg double"))
