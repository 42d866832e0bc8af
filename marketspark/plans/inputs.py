"""Inputs that several queries derive from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import orders as O
from ..operators import subscriptions as H
from ..sources import loaders as L


def live(t) -> DataFrame:
    """When each vendor's subscription was live, from the event ledger."""
    return H.live_intervals(H.classify_events(t.subscription_events()))


def intake(t) -> O.Intake:
    """The order requests, priced from what each caller could read just then."""
    return O.intake(t.order_requests(), L.normalize_products(t.products()), live(t))
