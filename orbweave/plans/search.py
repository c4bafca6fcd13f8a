"""Grid search of plan settings, and tables of run times (sinks of the benchmark tools)."""

from __future__ import annotations

import time
from itertools import product

from pyspark.sql import DataFrame, SparkSession

from orbweave.functions import kernels
from orbweave.operators.interactions import direct, l2_error
from orbweave.plans import translations as X
from orbweave.plans.engine import Builder
from orbweave.schemas import charges as checked
from orbweave.schemas import points


def grid_search(spark: SparkSession, sources: DataFrame, targets: DataFrame, charges: DataFrame, kernel=None, orders=(4, 6), depths=(2, 3), fields=(X.Fft(),)) -> DataFrame:
    """order, depth, field, seconds, l2_error for each combination, against the direct sum."""
    kernel = kernel or kernels.Laplace()
    exact = direct(targets, sources, checked(charges), kernel).persist()
    rows = []
    for order, depth, m2l in product(orders, depths, fields):
        plan = Builder(spark).tree(sources, targets, depth=depth).parameters(charges, order, kernel, "Value", m2l).build()
        started = time.perf_counter()
        error = l2_error(plan.evaluate(), exact).first()[0]
        rows.append((order, depth, repr(m2l), time.perf_counter() - started, error))
    exact.unpersist()
    return spark.createDataFrame(rows, "order int, depth int, field string, seconds double, l2_error double")


#: Pairs of points up to which the direct sum is the faster query: below, a fast sum is bound by the number of its stages.
DIRECT_PAIRS = 30_000**2


def potentials(spark: SparkSession, sources: DataFrame, targets: DataFrame, charges: DataFrame, kernel=None, order: int = 6, n_crit: int = 150, eval_type: str = "Value", m2l=None, direct_pairs: int = DIRECT_PAIRS) -> DataFrame:
    """The sums at all targets, directly up to ``direct_pairs`` pairs of points and by a fast sum beyond."""
    kernel = kernel or kernels.Laplace()
    if sources.count() * targets.count() <= direct_pairs:
        return direct(points(targets), points(sources), checked(charges), kernel, eval_type == "ValueDeriv")
    return Builder(spark).tree(sources, targets, n_crit=n_crit).parameters(charges, order, kernel, eval_type, m2l).build().evaluate()


def timings(plan) -> DataFrame:
    """stage, seconds of a plan's stages so far."""
    return plan.spark.createDataFrame([(k, float(v)) for k, v in plan.times.items()], "stage string, seconds double")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
