"""Score transforms, combiners, distances and losses as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def identity(x: Column) -> Column:
    return x


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log_sigmoid(x: Column) -> Column:
    return -F.log1p(F.exp(-x))


def lp_hinge(p: int) -> Callable[[Column], Column]:
    return lambda x: F.exp(-F.pow(F.greatest(1 - x, F.lit(0.0)), F.lit(float(p))))


def log_lp_hinge(p: int) -> Callable[[Column], Column]:
    return lambda x: 0 - F.pow(F.greatest(1 - x, F.lit(0.0)), F.lit(float(p)))  # not -0.0


def plus(a: Column, b: Column) -> Column:
    return a + b


def times(a: Column, b: Column) -> Column:
    return a * b


def larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def keep(a: Column, b: Column) -> Column:
    return a


class PostProcessor:
    """A transform of a layer's scores and the way they meet their parents' scores."""

    def __init__(self, transform: Callable[[Column], Column], combine: Callable[[Column, Column], Column], arrays: tuple[Callable, Callable] | None = None):
        """``arrays``: both as functions of numpy arrays."""
        self.transform, self.combine, self.arrays = transform, combine, arrays

    @staticmethod
    def get(name: str | bool | None | PostProcessor) -> PostProcessor:
        """``noop`` (also False, None), ``sigmoid``, ``log-sigmoid``, ``l{p}-hinge`` (True: p = 3), ``log-l{p}-hinge``, or a PostProcessor."""
        if isinstance(name, PostProcessor):
            return name
        if name is True:
            name = "l3-hinge"
        if name in (None, False, "noop"):
            return PostProcessor(identity, keep, (lambda s: s, lambda v, parent: v))
        if name == "sigmoid":
            return PostProcessor(sigmoid, times, (lambda s: 1 / (1 + np.exp(-s)), np.multiply))
        if name == "log-sigmoid":
            return PostProcessor(log_sigmoid, plus, (lambda s: -np.logaddexp(0, -s), np.add))
        if m := re.fullmatch(r"(log-)?l(\d+)-hinge", name):
            p = int(m[2])
            log = lambda s: -(np.maximum(1 - s, 0) ** p)
            return PostProcessor(log_lp_hinge(p), plus, (log, np.add)) if m[1] else PostProcessor(lp_hinge(p), times, (lambda s: np.exp(log(s)), np.multiply))
        raise ValueError(f"unknown post-processor: {name}")

    @staticmethod
    def names() -> list[str]:
        return ["noop", "sigmoid", "log-sigmoid", *(f"l{p}-hinge" for p in range(1, 5)), *(f"log-l{p}-hinge" for p in range(1, 5))]


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def ip_distance(a: Column | str, b: Column | str) -> Column:
    return 1 - dot(a, b)


def l2_distance(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def axpy(alpha: Column | float, x: Column, y: Column) -> Column:
    return y + alpha * x


def squared_hinge_loss(score: Column, positive: Column, cost: Column | float = 1.0) -> Column:
    """Margin one, power two; ``positive`` is true for +1."""
    gap = F.greatest(1 - F.when(positive, score).otherwise(-score), F.lit(0.0))
    return cost * gap * gap


def margin_ranking_loss(better: Column, worse: Column, margin: float = 0.1) -> Column:
    return F.greatest(F.lit(0.0), worse - better + margin)


def blended_pair_loss(better: Column, worse: Column, better_target: Column, worse_target: Column, alpha: float, margin: float = 0.1) -> Column:
    """``alpha`` of the margin loss and the rest of the mean squared error."""
    mse = ((better - better_target) * (better - better_target) + (worse - worse_target) * (worse - worse_target)) / 2
    return alpha * margin_ranking_loss(better, worse, margin) + (1 - alpha) * mse


def listwise_loss(scores: Column | str) -> Column:
    """Cross-entropy of a list of scores whose first is the right one."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.log(total) + top - F.element_at(scores, 1)


def inverse_propensity(frequency: Column, n_rows: int | Column, a: float = 0.6, b: float = 2.6) -> Column:
    n = F.lit(float(n_rows)) if isinstance(n_rows, int) else n_rows
    c = (F.log(n) - 1) * F.pow(F.lit(b + 1), F.lit(a))
    return 1 + c * F.exp(-a * F.log(frequency + b))
