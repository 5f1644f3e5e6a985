"""Discrete power laws: kernels of the fit, goodness of fit and model comparison, one unit (``by``) a Spark group. ``xmin_scan`` fits the units themselves.

A sample is its histogram of frequencies (``freq``, ``types``), which is as small as the number of distinct frequencies.
Bootstrap replicates are rows of their own, dealt in blocks with a seed for each replicate, so results don't depend on partitions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALPHA_MAX = 4.0
BOUNDARY = 1e-6
MODELS = ("full_range_power_law", "lower_bounded_power_law", "doubly_bounded_power_law")
EXCLUDE_HEAD = (0, 1, 2, 3, 5, 10)
ALTERNATIVES = ("lognormal", "exponential", "stretched_exponential", "truncated_power_law")
_B = (1 / 12, -1 / 720, 1 / 30240, -1 / 1209600)


def power_sum(alpha, low, high=None, head: int = 12) -> np.ndarray:
    """Sum of x^-alpha for x from ``low`` to ``high`` (no ``high``: to infinity, alpha > 1), by Euler-Maclaurin after ``head`` direct terms."""
    alpha, low = np.broadcast_arrays(np.asarray(alpha, float), np.asarray(low, float))
    top = np.full(alpha.shape, np.inf) if high is None else np.broadcast_to(np.asarray(high, float), alpha.shape)
    total = np.zeros(alpha.shape)
    for i in range(head):
        x = low + i
        total += np.where(x <= top, x**-alpha, 0.0)
    a = low + head
    more = a <= top
    b = np.where(np.isfinite(top), top, 1.0)

    def corrections(x):
        out, factor, power = np.zeros(alpha.shape), alpha, x ** (-alpha - 1)
        for i, c in enumerate(_B):
            out += c * factor * power
            factor = factor * (alpha + 2 * i + 1) * (alpha + 2 * i + 2)
            power = power / (x * x)
        return out

    near_one = np.abs(alpha - 1) < 1e-9
    safe = np.where(near_one, 2.0, alpha)
    with np.errstate(over="ignore", invalid="ignore"):
        integral_to = np.where(near_one, np.log(np.maximum(b, 1)) - np.log(a), (b ** (1 - safe) - a ** (1 - safe)) / (1 - safe))
        endless = np.where(alpha > 1, a ** (1 - safe) / (safe - 1), np.inf)
        tail = np.where(np.isfinite(top), integral_to + (a**-alpha + b**-alpha) / 2 + corrections(a) - corrections(b), endless + a**-alpha / 2 + corrections(a))
    return total + np.where(more, tail, 0.0)


def _golden(cost, low: np.ndarray, high: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Minimisers of independent unimodal functions, all at once."""
    g = (math.sqrt(5) - 1) / 2
    c, d = high - g * (high - low), low + g * (high - low)
    fc, fd = cost(c), cost(d)
    for _ in range(rounds):
        left = fc < fd
        high, low = np.where(left, d, high), np.where(left, low, c)
        c, d = high - g * (high - low), low + g * (high - low)
        fc, fd = cost(c), cost(d)
    return (low + high) / 2


#: Digits of a KS distance that count where fits are compared, and the distance below which a fit is perfect: beyond them lies the noise of sums and searches.
DIGITS, PERFECT = 11, 1e-6


def comparable(ks: np.ndarray) -> np.ndarray:
    return np.where(ks < PERFECT, 0.0, np.round(ks, DIGITS))


def exponents(count, total, xmin, top) -> np.ndarray:
    """Maximum-likelihood exponents of samples of ``count`` values from ``xmin`` to ``top`` (infinite: no bound) whose logarithms sum to ``total``."""
    cost = lambda a: a * total + count * np.log(power_sum(a, xmin, top))
    bounded = np.isfinite(np.broadcast_to(top, np.shape(xmin)))
    alpha = _golden(cost, np.where(bounded, 0.0, 1.0 + 1e-9), np.full(len(xmin), ALPHA_MAX))
    return np.where(ALPHA_MAX - alpha < BOUNDARY, ALPHA_MAX, np.where(bounded & (alpha < BOUNDARY), 0.0, alpha))


#: Pairs of a candidate and a value whose model probabilities are held at once.
PAIRS = 1 << 18


def _distances(x, cum, alpha, top, count, z, before, at, end) -> np.ndarray:
    """KS distance of each candidate: its values are ``x[at:end]``, ``cum`` the counts before each value, ``before`` those before the candidate's first. A bounded number of pairs at a time."""
    size = end - at
    upto = np.r_[0, np.cumsum(size)]
    out = np.empty(len(at))
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PAIRS, "right")) - 1)
        who = np.repeat(np.arange(lo, hi), size[lo:hi])
        j = np.arange(len(who)) - np.repeat(upto[lo:hi] - upto[lo], size[lo:hi]) + at[who]
        survive = power_sum(alpha[who], x[j], top[who], head=6) / z[who]
        apart = np.abs((cum[j] - before[who]) / count[who] - (1 - survive))
        out[lo:hi] = np.maximum.reduceat(apart, upto[lo:hi] - upto[lo])
        lo = hi
    return out


#: Values of a problem that bound its candidates' distances, and candidates of least bound that are measured first.
EDGES, FIRST = 64, 8


def _least(x, cum, alpha, top, count, z, at, end, of, base, known) -> np.ndarray:
    """Distances of the candidates that can be their problem's best; infinite for the others, whose gap at some of the values is already larger than a distance found.

    ``base`` are the problems' first values, ``known`` the least distance of each problem that is given without a look at values.
    """
    picks = [np.unique(np.r_[np.linspace(i, j - 1, EDGES // 2).astype(np.int64), np.minimum(np.searchsorted(cum[i:j], np.linspace(cum[i], cum[j], EDGES // 2)) + i, j - 1)]) for i, j in zip(base[:-1], base[1:], strict=True) if j > i]
    pick = np.concatenate(picks)
    # the last value of each problem is one of them, so no candidate is without
    from_, upto = np.searchsorted(pick, at), np.searchsorted(pick, end)
    bound = _distances(x[pick], cum[pick], alpha, top, count, z, cum[at], from_, upto)
    out, best = np.full(len(at), np.inf), known.copy()
    order = np.lexsort((bound, of))
    place = np.empty(len(at), np.int64)
    place[order] = np.arange(len(at)) - np.searchsorted(of[order], of[order])
    taken, take = np.zeros(len(at), bool), FIRST
    while True:
        live = ~taken & (bound <= np.maximum(best[of] + 2 * 10.0**-DIGITS, PERFECT))
        if not live.any():
            return out
        now = np.flatnonzero(live & (place < take))
        out[now] = _distances(x, cum, alpha[now], top[now], count[now], z[now], cum[at[now]], at[now], end[now])
        np.minimum.at(best, of[now], out[now])
        taken[now], take = True, 4 * take


def fit_problems(problems: list[tuple[np.ndarray, np.ndarray, np.ndarray, float | None]], least: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """Maximum-likelihood alpha and KS distance for each candidate xmin of each problem: values ``x`` (ascending), their counts, candidates, xmax.

    All candidates of all problems are solved together. A problem with d distinct values has at most d * d / 2 pairs to look at, and d distinct frequencies
    stand for at least d * d / 2 occurrences. ``least``: distances are only found for candidates that can be the best of their problem, others are infinite.
    """
    if not problems:
        return []
    cut = [x <= (np.inf if xmax is None else xmax) for x, _, _, xmax in problems]
    xs, ns = [p[0][c] for p, c in zip(problems, cut, strict=True)], [p[1][c] for p, c in zip(problems, cut, strict=True)]
    base = np.r_[0, np.cumsum([len(x) for x in xs])]
    x, n = np.concatenate(xs), np.concatenate(ns).astype(float)
    many = [len(p[2]) for p in problems]
    of = np.repeat(np.arange(len(problems)), many)
    xmin = np.concatenate([p[2] for p in problems]).astype(float)
    top = np.array([np.inf if p[3] is None else p[3] for p in problems])[of]
    at = np.concatenate([b + np.searchsorted(v, p[2]) for b, v, p in zip(base, xs, problems, strict=False)])
    end = base[1:][of]
    cum = np.r_[0, np.cumsum(n)]
    # sums of logarithms run from the end of each problem, so that a fit doesn't depend on what lies beside it
    logs = np.concatenate([np.cumsum((k * np.log(v))[::-1])[::-1] for v, k in zip(xs, ns, strict=True)])
    count, total = cum[end] - cum[at], logs[at]
    alpha = exponents(count, total, xmin, top)
    ks = 1 - 1 / np.maximum(count, 1)
    use = np.flatnonzero(ALPHA_MAX - alpha > BOUNDARY)
    if len(use):
        z = power_sum(alpha[use], xmin[use], top[use])
        if least:
            known = np.full(len(problems), np.inf)
            np.minimum.at(known, np.delete(of, use), np.delete(ks, use))
            ks[use] = _least(x, cum, alpha[use], top[use], count[use], z, at[use], end[use], of[use], base, known)
        else:
            ks[use] = _distances(x, cum, alpha[use], top[use], count[use], z, cum[at[use]], at[use], end[use])
    edges = np.r_[0, np.cumsum(many)]
    return [(alpha[i:j], ks[i:j]) for i, j in zip(edges[:-1], edges[1:], strict=True)]


def fit_alpha(x: np.ndarray, n: np.ndarray, xmin: np.ndarray, xmax: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood alpha and KS distance for each xmin, on values ``x`` (ascending) that occur ``n`` times."""
    return fit_problems([(x, n, xmin, xmax)])[0]


def _choices(x: np.ndarray, n: np.ndarray, model: str, fixed_xmin: int | None) -> list[tuple[np.ndarray, float | None, int | None]]:
    """Candidate xmins for each xmax that the model allows, with the size of the head that the xmax leaves out."""
    bounds: list[tuple[float | None, int | None]] = [(None, None)]
    if model == "doubly_bounded_power_law":
        rank, bounds, seen = np.cumsum(n[::-1]), [], set()
        for k in EXCLUDE_HEAD:
            if k < n.sum():
                v = float(x[::-1][np.searchsorted(rank, k + 1)])
                if v not in seen:
                    seen.add(v)
                    bounds.append((v, k))
    out = []
    for xmax, k in bounds:
        last = x[-1] if xmax is None else xmax
        if model == "full_range_power_law":
            lows = np.array([1.0 if fixed_xmin is None else fixed_xmin])
        else:
            lows = x[x < last].astype(float) if fixed_xmin is None else np.array([float(fixed_xmin)])
        # a candidate needs a value from it up to xmax
        lows = lows[lows <= x[np.searchsorted(x, last, "right") - 1]]
        if len(lows):
            out.append((lows, xmax, k))
    return out


def fit_many(samples: list[tuple[np.ndarray, np.ndarray]], model: str, fixed_xmin: int | None = None) -> list[dict | None]:
    """Each sample's best fit (least KS over the free bounds), all solved together; None where nothing can be fitted."""
    problems, owner = [], []
    for i, (x, n) in enumerate(samples):
        if len(x) and n.sum() >= 2:
            for lows, xmax, k in _choices(x, n, model, fixed_xmin):
                problems.append((x, n, lows, xmax))
                owner.append((i, k))
    out: list[dict | None] = [None] * len(samples)
    # a head of 0 sorts last among equal distances, then more fitted types win
    rank_of = lambda f: (float(comparable(f["ks"])), (f["exclude_k"] or 10**9), -f["n_fitted"])
    for (x, n, lows, xmax), (s, k), (alpha, ks) in zip(problems, owner, fit_problems(problems, least=True), strict=True):
        i = int(np.argmin(comparable(ks)))
        tail = (x >= lows[i]) & (x <= (xmax or np.inf))
        found = {"xmin": float(lows[i]), "xmax": xmax, "exclude_k": k, "alpha": float(alpha[i]), "ks": float(ks[i]), "n_fitted": int(n[tail].sum()), "excluded": int(n[x > xmax].sum()) if xmax else 0, "top": float(x[tail].max())}
        if np.isfinite(found["ks"]) and (out[s] is None or rank_of(found) < rank_of(out[s])):
            out[s] = found
    for (x, n), best in zip(samples, out, strict=True):
        if best:
            tail = (x >= best["xmin"]) & (x <= (best["xmax"] or np.inf))
            best |= {"type_share": best["n_fitted"] / n.sum(), "occurrence_share": float((x * n)[tail].sum() / (x * n).sum()), "log_range": math.log10(best["top"] / best["xmin"]), "fit_valid": bool(ALPHA_MAX - best["alpha"] > BOUNDARY)}
    return out


def fit(x: np.ndarray, n: np.ndarray, model: str, fixed_xmin: int | None = None) -> dict | None:
    """The model's best fit: least KS over the free bounds; None where nothing can be fitted."""
    return fit_many([(x, n)], model, fixed_xmin)[0]


#: Values whose probabilities are tabled, and draws of the far tail that are held at once.
TABLE, FAR = 4096, 1 << 18


def draw(size: int, alpha: float, xmin: float, xmax: float | None, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A sample of the fitted law as values and counts: a multinomial over a table of masses, and the far tail by inversion, piece by piece."""
    z = float(power_sum(alpha, xmin, xmax))
    width = int(min(TABLE, (xmax - xmin + 1) if xmax else TABLE))
    grid = xmin + np.arange(width + 1)
    survive = power_sum(np.full(width + 1, alpha), grid, xmax) / z  # P(X >= x)
    survive[grid > (xmax or np.inf)] = 0
    survive[0] = 1.0
    masses = np.r_[np.maximum(-np.diff(survive), 0), survive[-1]]
    counts = rng.multinomial(size, masses / masses.sum())
    values, numbers = [grid[:-1][counts[:-1] > 0]], [counts[:-1][counts[:-1] > 0]]
    above = lambda x: power_sum(np.full(len(x), alpha), x, xmax) / z
    left = int(counts[-1])
    while left:
        many = min(left, FAR)
        left -= many
        want = survive[-1] * (1 - rng.random(many))
        low, high = np.full(many, grid[-1]), np.full(many, 2 * grid[-1])
        for _ in range(60):
            open_ = above(high) > want
            if not open_.any() or high.max() > 1e15:
                break
            low, high = np.where(open_, high, low), np.where(open_, high * 2, high)
        for _ in range(60):
            mid = np.floor((low + high) / 2)
            if (mid == low).all():
                break
            up = above(mid) >= want
            low, high = np.where(up, mid, low), np.where(up, high, mid)
        v, c = np.unique(np.minimum(low, xmax) if xmax else low, return_counts=True)
        values.append(v), numbers.append(c)
    return _summed(np.concatenate(values), np.concatenate(numbers))


def _summed(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values ascending, with the sums of their counts."""
    v, at = np.unique(values, return_inverse=True)
    return v, np.bincount(at, weights=counts, minlength=len(v)).astype(np.int64)


def resample(x: np.ndarray, n: np.ndarray, best: dict, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A semiparametric sample as a histogram: the fitted law inside its bounds, the observed values outside."""
    top = best["xmax"] or np.inf
    tail = (x >= best["xmin"]) & (x <= top)
    below, above = x < best["xmin"], x > top
    sizes = rng.multinomial(int(n.sum()), [n[below].sum() / n.sum(), n[tail].sum() / n.sum(), n[above].sum() / n.sum()])
    parts = [draw(int(sizes[1]), best["alpha"], best["xmin"], best["xmax"], rng)] if sizes[1] else []
    for mask, size in ((below, sizes[0]), (above, sizes[2])):
        if size:
            counts = rng.multinomial(size, n[mask] / n[mask].sum())
            parts.append((x[mask][counts > 0], counts[counts > 0]))
    return _summed(np.concatenate([v for v, _ in parts]), np.concatenate([c for _, c in parts]))


def replicates_of(x: np.ndarray, n: np.ndarray, best: dict, model: str, rngs: list[np.random.Generator], fixed_xmin: int | None = None) -> list[float | None]:
    """KS distances of samples, each refitted; None where one can't be fitted."""
    fitted = fit_many([resample(x, n, best, rng) for rng in rngs], model, fixed_xmin)
    return [got["ks"] if got and got["fit_valid"] and got["n_fitted"] >= 2 else None for got in fitted]


def _normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(-z / math.sqrt(2))


def _log_masses(name: str, p: np.ndarray, x: np.ndarray, xmin: float, xmax: float | None) -> np.ndarray:
    """Log probabilities of a discretised family on the support; -inf columns for parameters out of range."""
    top = np.inf if xmax is None else xmax
    if name == "exponential":
        rate = math.exp(p[0])
        whole = -math.expm1(-rate * (top - xmin + 1)) if np.isfinite(top) else 1.0
        return np.log(-math.expm1(-rate)) - rate * (x - xmin) - math.log(whole)
    if name == "stretched_exponential":
        rate, beta = math.exp(p[0]), math.exp(p[1])
        surv = lambda v: np.exp(-((rate * np.maximum(v, 1e-12)) ** beta))
        low, high = surv(np.array([xmin - 0.5]))[0], (surv(np.array([top + 0.5]))[0] if np.isfinite(top) else 0.0)
        return np.log(np.maximum(surv(x - 0.5) - surv(x + 0.5), 1e-300)) - math.log(max(low - high, 1e-300))
    if name == "lognormal":
        mu, sigma = p[0], math.exp(p[1])
        cdf = lambda v: _normal_cdf((np.log(np.maximum(v, 1e-12)) - mu) / sigma)
        low, high = cdf(np.array([xmin - 0.5]))[0], (cdf(np.array([top + 0.5]))[0] if np.isfinite(top) else 1.0)
        return np.log(np.maximum(cdf(x + 0.5) - cdf(x - 0.5), 1e-300)) - math.log(max(high - low, 1e-300))
    alpha, rate = p[0], math.exp(p[1])
    far = min(top, xmin + max(2000.0, 60 / rate))
    grid = np.unique(np.r_[np.arange(xmin, min(far, xmin + 2000) + 1), np.floor(np.geomspace(min(far, xmin + 2000), far, 400))])
    width = np.diff(np.r_[grid, grid[-1] + 1])
    z = (np.exp(-alpha * np.log(grid) - rate * (grid - xmin)) * width).sum()
    return -alpha * np.log(x) - rate * (x - xmin) - math.log(max(z, 1e-300))


def _simplex(cost, start: list[float], rounds: int = 240) -> np.ndarray:
    """Nelder-Mead in a few dimensions."""
    dim = len(start)
    pts = np.array([start, *[[v + (0.5 if i == j else 0.0) for j, v in enumerate(start)] for i in range(dim)]])
    val = np.array([cost(p) for p in pts])
    for _ in range(rounds):
        order = np.argsort(val)
        pts, val = pts[order], val[order]
        if abs(val[-1] - val[0]) < 1e-10 * (1 + abs(val[0])):
            break
        mid = pts[:-1].mean(axis=0)
        step = lambda f: mid + f * (pts[-1] - mid)  # noqa: B023, E731
        p, fp = (q := step(-1.0)), cost(q)
        if fp < val[0]:
            q = step(-2.0)
            p, fp = (q, fq) if (fq := cost(q)) < fp else (p, fp)
        elif fp >= val[-2]:
            q = step(0.5)
            fq = cost(q)
            if fq < val[-1]:
                p, fp = q, fq
            else:
                pts[1:] = (pts[1:] + pts[0]) / 2
                val[1:] = [cost(v) for v in pts[1:]]
                continue
        pts[-1], val[-1] = p, fp
    return pts[np.argmin(val)]


def compare(x: np.ndarray, n: np.ndarray, best: dict) -> list[dict]:
    """Vuong likelihood-ratio tests of the power law against each alternative on the fitted range; truncated is nested."""
    tail = (x >= best["xmin"]) & (x <= (best["xmax"] or np.inf))
    v, c = x[tail].astype(float), n[tail].astype(float)
    size, xmin, xmax = c.sum(), best["xmin"], best["xmax"]
    own = -best["alpha"] * np.log(v) - math.log(float(power_sum(best["alpha"], xmin, xmax)))
    mean_log = (c * np.log(v)).sum() / size
    spread = math.log(max(math.sqrt((c * (np.log(v) - mean_log) ** 2).sum() / size), 0.3))
    rate = -math.log(max((c * v).sum() / size - xmin + 1, 1e-9))
    starts = {"lognormal": [mean_log, spread], "exponential": [rate], "stretched_exponential": [rate, math.log(0.6)], "truncated_power_law": [min(best["alpha"], 2.0), rate - 2]}
    rows = []
    for name in ALTERNATIVES:
        try:
            cost = lambda p: float(-(c * _log_masses(name, p, v, xmin, xmax)).sum()) if np.all(np.abs(p) < 60) else 1e300  # noqa: B023, E731
            with np.errstate(all="ignore"):
                other = _log_masses(name, _simplex(cost, starts[name]), v, xmin, xmax)
            d = own - other
            if name == "truncated_power_law" and (c * d).sum() > 0:  # it contains the power law, so it is at least as likely
                d = np.zeros(len(v))
            r = float((c * d).sum())
            sd = math.sqrt(max(float((c * (d - r / size) ** 2).sum() / size), 0.0))
            p = math.erfc(math.sqrt(max(-r, 0.0))) if name == "truncated_power_law" else (math.erfc(abs(r) / (math.sqrt(2 * size) * sd)) if sd > 0 else 1.0)
            rows.append({"model_2": name, "R": r, "p": p})
        except (ValueError, OverflowError, ZeroDivisionError):
            rows.append({"model_2": name, "R": None, "p": None})
    return rows


def frequency_counts(freqs: DataFrame, by: list[str]) -> DataFrame:
    """``by, freq, types``: how many types have each frequency. Missing, infinite, fractional and non-positive frequencies raise."""
    number = F.col("freq").cast("double")
    ok = number.isNotNull() & ~F.isnan(number) & (number > 0) & (number < float("inf")) & (F.abs(number - F.rint(number)) <= 1e-8 + 1e-5 * number)
    checked = freqs.withColumn("freq", F.when(ok, F.rint(number).cast("long")).otherwise(F.raise_error(F.lit("frequencies must be positive whole numbers"))))
    return checked.groupBy(*by, "freq").agg(F.count("*").alias("types"))


def histograms(freqs: DataFrame, by: list[str]) -> DataFrame:
    """``by, values, counts``: a unit's distinct frequencies, ascending, as arrays."""
    counts = frequency_counts(freqs, by)
    cells = F.array_sort(F.collect_list(F.struct("freq", "types")))
    return counts.groupBy(*by).agg(cells.alias("c")).select(*by, F.col("c.freq").cast("array<double>").alias("values"), F.col("c.types").alias("counts"))


def _schema_of(df: DataFrame, by: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)


def goodness_of_fit(freqs: DataFrame, fitted: DataFrame, by: list[str], replicates: int = 1000, block: int = 25, seed: int = 42, fixed_xmin: int | None = None) -> DataFrame:
    """``by, model, gof_p, n_success, n_failed``: the share of replicates whose distance is at least the fit's; failed ones don't count."""
    units = fitted.where("fit_valid AND n_fitted >= 2").join(histograms(freqs, by), by)
    blocks = -(-replicates // block)
    # a number of partitions is given, since blocks are few bytes and long work: without one they would be put together in one task
    dealt = units.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(4 * blocks, *by, "model", "block")
    name = F.concat_ws("\u0001", *(F.col(c).cast("string") for c in by), F.col("model"))
    dealt = dealt.withColumn("unit", F.xxhash64(name))

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                best = {"xmin": r.xmin, "xmax": None if pd.isna(r.xmax) else r.xmax, "alpha": r.alpha, "exclude_k": None}
                x, n = np.asarray(r.values, float), np.asarray(r.counts, np.int64)
                mine = range(r.block * block, min((r.block + 1) * block, replicates))
                rngs = [np.random.default_rng([seed, r.unit & 0x7FFFFFFFFFFFFFFF, i]) for i in mine]
                for d in replicates_of(x, n, best, r.model, rngs, fixed_xmin):
                    rows.append([*(getattr(r, c) for c in by), r.model, None if d is None else bool(d >= r.ks)])
            yield pd.DataFrame(rows, columns=[*by, "model", "hit"]).astype({"hit": "boolean"})

    hits = dealt.select(*by, "model", "values", "counts", "xmin", "xmax", "alpha", "ks", "block", "unit").mapInPandas(run, f"{_schema_of(freqs, by)}, model string, hit boolean")
    return hits.groupBy(*by, "model").agg((F.count_if("hit") / F.nullif(F.count("hit"), F.lit(0))).alias("gof_p"), F.count("hit").alias("n_success"), F.count_if(F.col("hit").isNull()).alias("n_failed"))


def comparisons(freqs: DataFrame, fitted: DataFrame, by: list[str], significance: float = 0.1) -> DataFrame:
    """``by, model, model_2, R, p, preferred``: a row for each alternative of each valid fit."""
    units = fitted.where("fit_valid AND n_fitted >= 2").join(histograms(freqs, by), by).select(*by, "model", "values", "counts", "xmin", "xmax", "alpha")

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                best = {"xmin": r.xmin, "xmax": None if pd.isna(r.xmax) else r.xmax, "alpha": r.alpha}
                rows += [[*(getattr(r, c) for c in by), r.model, x["model_2"], x["R"], x["p"]] for x in compare(np.asarray(r.values, float), np.asarray(r.counts, np.int64), best)]
            yield pd.DataFrame(rows, columns=[*by, "model", "model_2", "R", "p"])

    out = units.mapInPandas(run, f"{_schema_of(freqs, by)}, model string, model_2 string, R double, p double")
    sure = F.col("p") < significance
    return out.withColumn("preferred", F.when(F.col("R").isNull(), "unavailable").when(sure & (F.col("R") > 0), "power_law").when(sure & (F.col("R") < 0), F.col("model_2")).otherwise("inconclusive"))
