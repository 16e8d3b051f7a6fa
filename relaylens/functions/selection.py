"""Choosing one candidate of a pool. A pool is ``ARRAY<STRUCT<model, score, ...>>`` in list order.

A pool is written as one array in one rule's configuration, so these run per row without any
shuffle. Draws come from ``hashing.uniform`` and are repeatable.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SCORE_FLOOR = 0.01

# Cost per 1k output tokens by keyword, first match wins.
COST_TIERS = [(("opus", "gpt-4o"), 15.0), (("sonnet", "gpt-4"), 3.0),
              (("haiku", "gpt-3.5", "mini"), 0.25)]
DEFAULT_COST = 1.0
SMALLEST_COST = 1e-6


def estimated_cost(model: Column) -> Column:
    name = F.lower(model)
    cost = F.lit(DEFAULT_COST)
    for words, price in reversed(COST_TIERS):
        hit = F.lit(False)
        for word in words:
            hit = hit | name.contains(word)
        cost = F.when(hit, F.lit(price)).otherwise(cost)
    return cost


def floored(score: Column) -> Column:
    return F.greatest(F.coalesce(score, F.lit(SCORE_FLOOR)), F.lit(SCORE_FLOOR))


def _pick(models: Column, u: Column) -> Column:
    """A uniform element; null for an empty list."""
    size = F.size(models)
    index = F.least(F.floor(u * size).cast("int"), size - 1)
    return F.when(size > 0, F.get(models, index))


def _steps(pool: Column, weight) -> Column:
    """The candidates with their cumulative weights, and the total."""
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast(
        "ARRAY<STRUCT<through: DOUBLE, model: STRING>>").alias("steps"))

    def step(acc, c):
        through = acc["sum"] + weight(c)
        return F.struct(through.alias("sum"), F.concat(acc["steps"], F.array(F.struct(
            through.alias("through"), c["model"].alias("model")))).alias("steps"))

    return F.aggregate(pool, start, step)


def _drawn(steps: Column, u: Column) -> Column:
    """The first candidate whose cumulative weight exceeds ``u`` times the total.

    ``u`` is used once per candidate, so it should be a plain column.
    """
    reached = F.filter(steps["steps"], lambda s: s["through"] > u * steps["sum"])
    last = F.get(steps["steps"], F.size(steps["steps"]) - 1)
    return F.coalesce(F.get(reached, 0), last)["model"]


def _models(pool: Column) -> Column:
    return F.transform(pool, lambda c: c["model"])


def _ranked(pool: Column) -> Column:
    """Models from the highest score on; equal scores keep list order."""
    return _models(F.array_sort(F.transform(pool, lambda c, i: F.struct(
        (-floored(c["score"])).alias("key"), i.alias("pos"), c["model"].alias("model")))))


def _by_score(pool: Column) -> Column:
    return _steps(pool, lambda c: floored(c["score"]))


def _by_cost(pool: Column) -> Column:
    return _steps(pool, lambda c: F.lit(1.0) / F.greatest(c["cost"], F.lit(SMALLEST_COST)))


def prepared(pool: Column) -> Column:
    """What the strategies need of a pool, so that it is summed and ranked once per rule and a
    request only looks its choice up."""
    return F.struct(_models(pool).alias("models"), _ranked(pool).alias("ranked"),
                    _by_score(pool).alias("by_score"), _by_cost(pool).alias("by_cost"))


def _best(ranked: Column, k: Column, u: Column) -> Column:
    return _pick(F.slice(ranked, F.lit(1), F.greatest(F.lit(1), F.least(k, F.size(ranked)))), u)


def weighted(pool: Column, u: Column) -> Column:
    return _drawn(_by_score(pool), u)


def top_k(pool: Column, k: Column, u: Column) -> Column:
    """Uniform among the ``k`` best; equal scores keep list order, ``k`` is clamped to 1..n."""
    return _best(_ranked(pool), k, u)


def epsilon_greedy(pool: Column, epsilon: Column, u_explore: Column, u_pick: Column) -> Column:
    """Uniform with probability ``epsilon``, else the first candidate with the highest score."""
    return F.when(u_explore < epsilon, _pick(_models(pool), u_pick)).otherwise(
        F.get(_ranked(pool), 0))


def cold_start(pool: Column, strategy: Column, u: Column) -> Column:
    """Inverse cost weights, or uniform for any other strategy; ``cost`` is a pool field."""
    return F.when(strategy == "cost_weighted", _drawn(_by_cost(pool), u)).otherwise(
        _pick(_models(pool), u))


def by_strategy(ready: Column, strategy: Column, k: Column, epsilon: Column,
                u: Column, u_explore: Column) -> Column:
    """Strategy by name over a ``prepared`` pool; an unknown name falls back to the weighted
    draw."""
    greedy = F.when(u_explore < epsilon, _pick(ready["models"], u)).otherwise(
        F.get(ready["ranked"], 0))
    return (F.when(strategy == "top_k", _best(ready["ranked"], k, u))
            .when(strategy == "epsilon_greedy", greedy)
            .otherwise(_drawn(ready["by_score"], u)))


def start_cold(ready: Column, strategy: Column, u: Column) -> Column:
    """``cold_start`` over a ``prepared`` pool."""
    return F.when(strategy == "cost_weighted", _drawn(ready["by_cost"], u)).otherwise(
        _pick(ready["models"], u))


def filter_candidates(candidates: Column, keep=(), order=None) -> Column:
    """Each predicate may narrow the array, and ``order`` (a sort key) may reorder it."""
    for predicate in keep:
        candidates = F.filter(candidates, predicate)
    if order is not None:
        keyed = F.array_sort(F.transform(candidates, lambda c, i: F.struct(
            order(c).alias("key"), i.alias("pos"), c.alias("candidate"))))
        candidates = F.transform(keyed, lambda k: k["candidate"])
    return candidates
