"""Prices, legal actions and rewards of a test-ordering episode, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .panels import N_PANELS, NEGATIVE, POSITIVE, PRICES

PENALTY = 99
ILL_FACTOR = 15


def price_array() -> Column:
    return F.array(*[F.lit(float(p)) for p in PRICES])


def personal_costs(groups: str | Column) -> Column:
    """Cost of every panel: a done panel's share of the done total times their number, others keep the price."""
    groups = F.col(groups) if isinstance(groups, str) else groups
    prices = price_array()
    total = F.aggregate(groups, F.lit(0.0), lambda acc, g: acc + F.element_at(prices, g.cast("int") + 1))
    return F.transform(
        prices,
        lambda price, g: F.when(
            F.array_contains(groups.cast("array<int>"), g), price / total * F.size(groups)
        ).otherwise(price),
    )


def pending_panels(groups: str | Column) -> Column:
    """Panels that are not done for this patient."""
    groups = F.col(groups) if isinstance(groups, str) else groups
    return F.array_except(F.sequence(F.lit(0), F.lit(N_PANELS - 1)), groups.cast("array<int>"))


def legal_actions(groups: str | Column, ordered: str | Column | None = None) -> Column:
    """14 booleans: the patient's own panels that were not ordered yet, and both diagnoses."""
    groups = F.col(groups) if isinstance(groups, str) else groups
    open_ = groups.cast("array<int>")
    if ordered is not None:
        ordered = F.col(ordered) if isinstance(ordered, str) else ordered
        open_ = F.array_except(open_, ordered.cast("array<int>"))
    panels = F.sequence(F.lit(0), F.lit(POSITIVE))
    return F.transform(panels, lambda a: (a >= N_PANELS) | F.array_contains(open_, a))


def step_reward(action: Column, ill: Column, costs: Column, penalty: float = PENALTY, ill_factor: float = ILL_FACTOR) -> Column:
    """A test costs its personal price; a wrong diagnosis costs the penalty, more when an ill patient is missed."""
    wrong_ill = F.when(action == NEGATIVE, F.lit(-float(penalty * ill_factor))).otherwise(0.0)
    wrong_healthy = F.when(action == POSITIVE, F.lit(-float(penalty))).otherwise(0.0)
    return F.when(action < N_PANELS, -F.get(costs, action)).when(ill, wrong_ill).otherwise(wrong_healthy)


def masked_probabilities(probabilities: str, mask: str) -> Column:
    """Action probabilities with the illegal ones set to 0 and the rest scaled to sum 1."""
    kept = F.zip_with(probabilities, mask, lambda p, ok: F.when(ok, p).otherwise(0.0))
    total = F.aggregate(kept, F.lit(0.0), lambda acc, p: acc + p)
    return F.transform(kept, lambda p: p / total)


def ill_probability(probabilities: str | Column) -> Column:
    """Probability of the positive diagnosis among the two diagnoses."""
    negative, positive = F.get(probabilities, F.lit(NEGATIVE)), F.get(probabilities, F.lit(POSITIVE))
    return F.try_divide(positive, negative + positive)
