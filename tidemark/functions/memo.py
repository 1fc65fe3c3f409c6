"""Share one lazy DataFrame per session between the parts of a plan that ask for the same thing."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def per_session(build: Callable[..., Any]) -> Callable[..., Any]:
    """Build each plan once per session and plain arguments. No data is held, only the plan (and `panel.last_day`, one date).

    Plans are kept on the session itself, so they go when it goes. A call that is given a DataFrame builds
    anew: such plans belong to one run.
    """

    @wraps(build)
    def shared(spark: SparkSession, *args, **kwargs):
        if any(isinstance(x, DataFrame) for x in (*args, *kwargs.values())):
            return build(spark, *args, **kwargs)
        known = vars(spark).setdefault("_shared_plans", {})
        key = (build.__module__, build.__qualname__, args, tuple(sorted(kwargs.items())))
        if key not in known:
            known[key] = build(spark, *args, **kwargs)
        return known[key]

    return shared
