"""Ridge ladders and projections from sums of products: one pass over rows, small matrices on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry

PENALTIES = (0.001, 0.01, 0.1, 1.0, 10.0)
KINDS = {"no_change": 0, "own": 1, "news": 2, "network": 3}


@dataclass(frozen=True)
class Ridge:
    features: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float
    alpha: float

    def column(self) -> Column:
        out = F.lit(self.intercept)
        for f, m, s, w in zip(self.features, self.mean, self.scale, self.weights, strict=True):
            out = out + F.lit(w) * (F.col(f) - F.lit(m)) / F.lit(s)
        return out


def gram(df: DataFrame, features: list[str], target: str, weight: Column | None = None, by: list[str] = ()) -> dict[tuple, tuple[np.ndarray, float, int]]:
    """For each group: the matrix of weighted sums of products of [1, features, target], the sum of weights and the rows."""
    w = weight if weight is not None else F.lit(1.0)
    terms = [F.lit(1.0), *map(F.col, features), F.col(target)]
    sums = [F.sum(w * terms[i] * terms[j]).alias(f"s{i}_{j}") for i in range(len(terms)) for j in range(i, len(terms))]
    out = {}
    for r in df.groupBy(*by).agg(F.count("*").alias("n"), *sums).collect():  # one row for each group that is fitted
        m = np.zeros((len(terms), len(terms)))
        for i in range(len(terms)):
            for j in range(i, len(terms)):
                m[i, j] = m[j, i] = r[f"s{i}_{j}"] if r[f"s{i}_{j}"] is not None else np.nan
        out[tuple(r[b] for b in by)] = m, m[0, 0], r["n"]
    return out


def solve(m: np.ndarray, features: list[str], alpha: float) -> Ridge:
    """Centred, scaled by the population deviation (1 where it is nil), penalty on the slopes alone and not divided by the rows."""
    n, k = m[0, 0], len(features)
    mean = m[0, 1 : k + 1] / n
    cov = m[1 : k + 1, 1 : k + 1] - n * np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov) / n, 0))
    sd[sd <= 1e-12] = 1.0
    y = m[0, k + 1] / n
    cross = (m[1 : k + 1, k + 1] - n * mean * y) / sd
    weights = np.linalg.lstsq(cov / np.outer(sd, sd) + alpha * np.eye(k), cross, rcond=None)[0] if k else np.array([])
    return Ridge(tuple(features), tuple(mean), tuple(sd), tuple(weights), float(y), alpha)


def fit_ladder(train: DataFrame, validation: DataFrame, rungs: dict[str, list[str]], target: str) -> dict[str, Ridge]:
    """Each rung's ridge; alpha by the smallest mean absolute validation error, to nine decimals, the first of equals. Rows must be complete for every rung, so
    that all rungs see the same ones. One pass sums the whole ladder's matrix, of which each rung's is a part, and one scores every rung at every alpha."""
    every = sorted({f for fs in rungs.values() for f in fs})
    complete = F.lit(True)
    for c in [*every, target]:
        complete = complete & F.col(c).isNotNull()
    train, validation = train.where(complete), validation.where(complete)
    whole = gram(train, every, target)[()][0]
    place = {f: i + 1 for i, f in enumerate(every)}
    fits: dict[str, list[Ridge]] = {}
    for name, features in rungs.items():
        at = [0, *(place[f] for f in features), len(every) + 1]
        fits[name] = [solve(whole[np.ix_(at, at)], features, a) for a in PENALTIES] if features else [Ridge((), (), (), (), 0.0, 0.0)]
    scored = validation.agg(*[F.avg(F.abs(m.column() - F.col(target))).alias(f"{name}|{i}") for name, ms in fits.items() for i, m in enumerate(ms)]).first()
    loss = {name: [round(scored[f"{name}|{i}"], 9) if scored[f"{name}|{i}"] is not None else math.inf for i in range(len(ms))] for name, ms in fits.items()}
    return {name: ms[min(range(len(ms)), key=lambda i: (loss[name][i], i))] for name, ms in fits.items()}


def projection(df: DataFrame, features: list[str], target: str, cluster: str, by: list[str]) -> list[dict]:
    """Least squares of target on [1, features] in each group, with errors robust to clusters, G/(G-1) (n-1)/(n-k) corrected. Groups of deficient rank say so."""
    fits, out = gram(df, features, target, by=by), []
    coefficients = {}
    for key, (m, _, n) in fits.items():
        a, b = m[:-1, :-1], m[:-1, -1]
        if not np.isfinite(m).all() or np.linalg.matrix_rank(a) < len(a):
            out.append({"key": key, "status": "rank_deficient", "n": n})
            continue
        coefficients[key] = (np.linalg.solve(a, b), np.linalg.inv(a), n)
    if not coefficients:
        return out
    spark = df.sparkSession
    rows = [(*key, *map(float, beta)) for key, (beta, _, _) in coefficients.items()]
    names = [f"_b{i}" for i in range(len(features) + 1)]
    fitted = spark.createDataFrame(rows, ", ".join([*(f"{b} {df.schema[b].dataType.simpleString()}" for b in by), *(f"{x} double" for x in names)]))
    joined = df.join(F.broadcast(fitted), list(by)) if by else df.crossJoin(F.broadcast(fitted))  # one row for each group
    terms = [F.lit(1.0), *map(F.col, features)]
    predicted = sum((F.col(x) * t for x, t in zip(names, terms, strict=True)), F.lit(0.0))
    e = F.col(target) - predicted
    scores = joined.groupBy(*by, cluster).agg(*[F.sum(t * e).alias(f"_g{i}") for i, t in enumerate(terms)])
    meat = scores.groupBy(*by).agg(F.count("*").alias("g"), *[F.sum(F.col(f"_g{i}") * F.col(f"_g{j}")).alias(f"_m{i}_{j}") for i in range(len(terms)) for j in range(len(terms))])
    for r in meat.collect():
        key = tuple(r[b] for b in by)
        beta, inverse, n = coefficients[key]
        k, g = len(beta), r["g"]
        m = np.array([[r[f"_m{i}_{j}"] for j in range(k)] for i in range(k)])
        if g < 2 or n <= k:
            out.append({"key": key, "status": "too_few_clusters", "n": n})
            continue
        cov = inverse @ m @ inverse * (g / (g - 1)) * ((n - 1) / (n - k))
        out.append({"key": key, "status": "estimated", "n": n, "clusters": g, "coefficients": beta.tolist(), "errors": np.sqrt(np.maximum(np.diag(cov), 0)).tolist(), "covariance": cov.tolist()})
    return out


def chi_square_tail(x: float, df: int) -> float:
    """Probability that a chi-square variable of df degrees exceeds x: a series for small x, a continued fraction for large."""
    if x <= 0:
        return 1.0
    a, h = df / 2, x / 2
    scale = math.exp(a * math.log(h) - h - math.lgamma(a))
    if h < a + 1:
        term = total = 1 / a
        for n in range(1, 1000):
            term *= h / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1 - total * scale)
    b, c = h + 1 - a, 1e300
    d = 1 / b
    f = d
    for n in range(1, 1000):
        an = -n * (n - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        f *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return min(1.0, scale * f)


def wald(cell: dict, at: list[int]) -> dict:
    """Joint test that the coefficients at those places of an estimated cell are nil, from its covariance robust to clusters."""
    b, v = np.array(cell["coefficients"])[at], np.array(cell["covariance"])[np.ix_(at, at)]
    if not len(at) or np.linalg.matrix_rank(v) < len(at):
        return {"statistic": None, "df": len(at), "p": None}
    statistic = float(b @ np.linalg.solve(v, b))
    return {"statistic": statistic, "df": len(at), "p": chi_square_tail(statistic, len(at))}


def interacted_projection(df: DataFrame, shock: str, covariates: list[str], liquidity: list[str], target: str, cluster: str, by: list[str]) -> list[dict]:
    """projection() of target on the shock, covariates, liquidity and the shock's product with each liquidity, with the joint test of the products and the shock's
    marginal effect, with its error, at the cell's mean liquidity. Rows that lack any of them are left out."""
    products = [f"_{shock}_x_{c}" for c in liquidity]
    whole = F.lit(True)
    for c in (shock, *covariates, *liquidity, target):
        whole = whole & F.col(c).isNotNull()
    rows = df.where(whole).withColumns({p: F.col(shock) * F.col(c) for p, c in zip(products, liquidity, strict=True)})
    features = [shock, *covariates, *liquidity, *products]
    means = {tuple(r[b] for b in by): [r[f"_m{i}"] for i in range(len(liquidity))] for r in rows.groupBy(*by).agg(F.count("*").alias("_n"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(liquidity)]).collect()}  # one row a cell
    out = []
    for cell in projection(rows, features, target, cluster, by):
        if cell["status"] == "estimated":
            at = list(range(len(features) - len(products) + 1, len(features) + 1))
            weights = np.zeros(len(features) + 1)
            weights[1], weights[at] = 1.0, means[cell["key"]]
            beta, v = np.array(cell["coefficients"]), np.array(cell["covariance"])
            cell = cell | {"names": ["intercept", *features], "interactions": wald(cell, at), "marginal": float(weights @ beta), "marginal_error": math.sqrt(max(0.0, float(weights @ v @ weights)))}
        out.append(cell)
    return out


def frozen_scores(model: Ridge, test: DataFrame, price: str, target: str, event: str) -> DataFrame:
    """(event, rows, mae, bias) of a frozen model on rows that it never saw: its change is mapped into the bounds of a price, and each event's errors are averaged.
    Rows that lack a feature, the price or the target are left out."""
    whole = F.col(price).isNotNull() & F.col(target).isNotNull()
    for f in model.features:
        whole = whole & F.col(f).isNotNull()
    predicted = geometry.bounded_level(F.col(price), model.column()) - F.col(price)
    error = predicted - F.col(target)
    return test.where(whole).groupBy(event).agg(F.count("*").alias("rows"), F.avg(F.abs(error)).alias("mae"), F.avg(error).alias("bias"))


def box_distance(payouts: np.ndarray, bids: np.ndarray, asks: np.ndarray, steps: int = 20_000) -> float:
    """How far quotes lie from any coherent prices: the least t with a distribution pi over outcomes so that bids - t <= A pi <= asks + t."""
    return coherent_prices(payouts, bids, asks, steps)[0]


def coherent_prices(payouts: np.ndarray, bids: np.ndarray, asks: np.ndarray, steps: int = 20_000) -> tuple[float, np.ndarray]:
    """(distance, pi): see box_distance. The distance is checked against the violation that pi in fact has; one that disagrees raises.

    A linear programme, solved by a dense simplex on its standard form with Bland's rule."""
    a, (n, k) = np.asarray(payouts, float), np.shape(payouts)
    # Variables: pi (k), t, slacks (2n). Rows: A pi - t + s = ask; -A pi - t + s = -bid; sum pi = 1.
    rows = np.zeros((2 * n + 1, k + 1 + 2 * n))
    rows[:n, :k], rows[n : 2 * n, :k], rows[: 2 * n, k] = a, -a, -1
    rows[: 2 * n, k + 1 :] = np.eye(2 * n)
    rows[2 * n, :k] = 1
    rhs = np.concatenate([asks, -np.asarray(bids, float), [1.0]])
    flip = rhs < 0
    rows[flip], rhs[flip] = -rows[flip], -rhs[flip]
    m, v = rows.shape
    table = np.hstack([rows, np.eye(m), rhs[:, None]])
    basis = list(range(v, v + m))

    def run(cost: np.ndarray, allowed: int) -> float:
        for _ in range(steps):
            reduced = cost[:allowed] - cost[basis] @ table[:, :allowed]
            enter = next((j for j in range(allowed) if reduced[j] < -1e-10), None)
            if enter is None:
                break
            column = table[:, enter]
            ratio = [(table[i, -1] / column[i], basis[i], i) for i in range(m) if column[i] > 1e-10]
            if not ratio:
                break
            least = min(r[0] for r in ratio)
            leave = min((b, i) for r, b, i in ratio if r <= least + 1e-12)[1]
            table[leave] /= table[leave, enter]
            for i in range(m):
                if i != leave:
                    table[i] -= table[i, enter] * table[leave]
            basis[leave] = enter
        return float(cost[basis] @ table[:, -1])

    if run(np.concatenate([np.zeros(v), np.ones(m)]), v + m) > 1e-7:
        raise ValueError("the programme has no feasible point")
    cost = np.zeros(v + m)
    cost[k], cost[v:] = 1.0, 1e6
    distance = max(0.0, run(cost, v))
    pi = np.zeros(k)
    for i, j in enumerate(basis):
        if j < k:
            pi[j] = max(0.0, table[i, -1])
    pi /= pi.sum()
    price = a @ pi
    worst = float(max(np.max(np.asarray(bids, float) - price, initial=0.0), np.max(price - np.asarray(asks, float), initial=0.0)))
    if abs(worst - distance) > 1e-7 * max(1.0, abs(distance)):
        raise ValueError(f"distance {distance} disagrees with the violation {worst}")
    return distance, pi


def coherence(quotes: DataFrame, by: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(by, distance, feasible, midpoint_distance, midpoint_feasible, refusal) of each family's rows (payouts array<double>, bid, ask): how far its boxes, and
    their midpoints alone, are from any coherent prices. A missing or crossed box refuses its family. A family is one contract ladder: a few rows."""

    def one(pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        key = {b: [pdf[b].iloc[0]] for b in by}
        none = {"distance": [None], "feasible": [None], "midpoint_distance": [None], "midpoint_feasible": [None]}
        if pdf[["bid", "ask"]].isna().any(axis=None) or pdf["payouts"].isna().any():
            return pd.DataFrame({**key, **none, "refusal": ["missing_box"]})
        bid, ask = pdf["bid"].to_numpy(float), pdf["ask"].to_numpy(float)
        if (bid > ask).any():
            return pd.DataFrame({**key, **none, "refusal": ["crossed_box"]})
        payouts, middle = np.array(pdf["payouts"].tolist(), float), (bid + ask) / 2
        d, m = box_distance(payouts, bid, ask), box_distance(payouts, middle, middle)
        return pd.DataFrame({**key, "distance": [d], "feasible": [d <= tolerance], "midpoint_distance": [m], "midpoint_feasible": [m <= tolerance], "refusal": [None]})

    kinds = ", ".join(f"{b} {quotes.schema[b].dataType.simpleString()}" for b in by)
    return quotes.groupBy(*by).applyInPandas(one, f"{kinds}, distance double, feasible boolean, midpoint_distance double, midpoint_feasible boolean, refusal string")


def release_weights(df: DataFrame, release: str) -> DataFrame:
    """Adds weight: one divided by the rows of the row's release, so that every release weighs one however many rows it has."""
    rows = df.groupBy(release).agg((1.0 / F.count("*")).alias("weight"))
    return df.join(rows, release)


def fit_weighted_ladder(train: DataFrame, validation: DataFrame, rungs: dict[str, tuple[list[str], list[str]]], target: str, release: str, alphas: tuple[float, ...] = PENALTIES) -> dict[str, Ridge]:
    """Each rung's release-weighted ridge. rungs: name -> (level terms, covariates); without level terms the rung has an intercept.

    Covariates are centred and scaled by weighted moments of the training rows and penalised; level terms (indicators, say) keep mean
    zero, scale one and no penalty. Alpha has the least release-weighted absolute error on validation, the smaller of equals. All rungs see
    the rows complete for every rung, and share one pass over them: a rung's matrix is part of the whole ladder's. One more pass scores
    every rung at every alpha.
    """
    every = sorted({f for level, covariates in rungs.values() for f in (*level, *covariates)})
    complete = F.col(release).isNotNull()
    for c in [*every, target]:
        complete = complete & F.col(c).isNotNull()
    train, validation = release_weights(train.where(complete), release), release_weights(validation.where(complete), release)
    g = gram(train, every, target, F.col("weight"))[()][0]
    if not np.isfinite(g).all():
        raise ValueError("no complete training rows")
    total, place = g[0, 0], {f: i + 1 for i, f in enumerate(every)}
    fits = {name: [_weighted(g, total, place, *rung, alpha) for alpha in sorted(alphas)] for name, rung in rungs.items()}
    error, w = lambda m: F.abs(m.column() - F.col(target)), F.col("weight")
    scored = validation.agg(*[(F.sum(w * error(m)) / F.sum(w)).alias(f"{name}|{i}") for name, ms in fits.items() for i, m in enumerate(ms)]).first()
    loss = {name: [math.inf if scored[f"{name}|{i}"] is None else scored[f"{name}|{i}"] for i in range(len(ms))] for name, ms in fits.items()}
    return {name: ms[int(np.argmin(loss[name]))] for name, ms in fits.items()}


def _weighted(g: np.ndarray, total: float, place: dict[str, int], level: list[str], covariates: list[str], alpha: float) -> Ridge:
    """One fit from the moments of [1, features, target]: each design column is a combination of them."""
    columns, mean, scale = [], [], []
    for f in [*level, *covariates]:
        e, m, s = np.zeros(len(g)), 0.0, 1.0
        if f in covariates:
            m = g[0, place[f]] / total
            sd = math.sqrt(max(g[place[f], place[f]] / total - m * m, 0.0))
            s = sd if sd > 1e-12 else 1.0
        e[place[f]], e[0] = 1 / s, -m / s
        columns.append(e)
        mean.append(m)
        scale.append(s)
    if not level:
        columns.append(np.eye(len(g))[0])
    a = np.stack(columns, axis=1)
    free = [0.0] * len(level) + [alpha] * len(covariates) + [0.0] * (not level)
    w = np.linalg.lstsq(a.T @ g @ a + np.diag(free), a.T @ g[:, -1], rcond=None)[0]
    names = (*level, *covariates)
    return Ridge(names, tuple(mean), tuple(scale), tuple(w[: len(names)]), 0.0 if level else float(w[-1]), alpha)
