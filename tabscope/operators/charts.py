"""Chart-ready tables: bars with intervals, histograms, density curves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.functions.binning import step_bin
from tabscope.operators.clean import columns_of_class

# First edge, step and number of bins of the credit table's histograms.
CREDIT_STEPS: dict[str, tuple[float, float, int]] = {
    "uso_de_credito": (0, 0.1, 10),
    "radio_deuda": (0, 0.1, 10),
    "ingreso_mensual": (0, 5000, 10),
    "num_otros_prestamos": (0, 1, 5),
    "cuentas_abiertas": (0, 1, 30),
}
Z_95 = 1.96
GRID_POINTS = 200
# exp(-r*r/2) is below 1e-17 of the peak beyond this many bandwidths
KERNEL_REACH = 9.0


def category_bars(
    df: DataFrame, categories: Sequence[str] | None = None, numbers: Sequence[str] | None = None, below: int = 10
) -> DataFrame:
    """Mean of every numeric column per value of every category with fewer than ``below`` values.

    The interval is mean ± 1.96 standard errors.
    """
    categories = columns_of_class(df, "text") if categories is None else list(categories)
    numbers = columns_of_class(df, "number") if numbers is None else list(numbers)
    # distinct values are counted exactly, in one pass for all columns
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).cast("string").alias("value")) for c in categories])).alias("p")
    sizes = df.select(each).select("p.category", "p.value").filter(F.col("value").isNotNull()).distinct().groupBy("category").count()
    few = {r["category"] for r in sizes.filter(F.col("count") < below).collect()} if categories else set()
    kept = [c for c in categories if c in few]
    if not kept:
        return df.sparkSession.createDataFrame(
            [], "category string, value string, number string, n bigint, mean double, low double, high double"
        )
    pairs = [F.struct(F.lit(c).alias("category"), F.col(c).cast("string").alias("value")) for c in kept]
    stats = [
        F.struct(F.lit(n).alias("number"), F.count(n).alias("n"), F.avg(n).alias("mean"), F.stddev_samp(n).alias("s")).alias(n)
        for n in numbers
    ]
    grouped = (
        df.select(F.explode(F.array(*pairs)).alias("p"), *numbers)
        .filter(F.col("p.value").isNotNull())
        .groupBy(F.col("p.category").alias("category"), F.col("p.value").alias("value"))
        .agg(*stats)
    )
    half = Z_95 * F.col("s") / F.sqrt(F.col("n"))
    return grouped.select("category", "value", F.inline(F.array(*numbers))).select(
        "category", "value", "number", "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high")
    )


def _ends(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float, int, float]]:
    """Minimum, maximum, count and deviation of each column: one pass, a few numbers to the driver."""
    row = df.agg(*[
        F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"), F.count(c).alias("n"),
                 F.stddev_samp(c).alias("s")).alias(c)
        for c in columns
    ]).first()
    return {c: (row[c]["lo"], row[c]["hi"], row[c]["n"], row[c]["s"]) for c in columns if row[c]["n"]}


def _densify(df: DataFrame, counts: DataFrame, edges: Mapping[str, tuple[float, float, int]]) -> DataFrame:
    """All bins of every column with their edges; empty ones count 0."""
    spans = df.sparkSession.createDataFrame(
        [(c, float(a), float(w), k) for c, (a, w, k) in edges.items()], "column string, start double, width double, bins int"
    )
    all_bins = spans.select("column", "start", "width", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    return all_bins.join(counts, ["column", "bin"], "left").select(
        "column", "bin",
        (F.col("start") + F.col("bin") * F.col("width")).alias("left"),
        (F.col("start") + (F.col("bin") + 1) * F.col("width")).alias("right"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def _count_bins(df: DataFrame, bins: Mapping[str, Column]) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("column"), b.cast("int").alias("bin")) for c, b in bins.items()]
    return (
        df.select(F.explode(F.array(*pairs)).alias("p"))
        .filter(F.col("p.bin").isNotNull())
        .groupBy(F.col("p.column").alias("column"), F.col("p.bin").alias("bin"))
        .agg(F.count("*").alias("n"))
    )


def _even_bin(column: str, lo: float, hi: float, bins: int) -> Column:
    """Bin between the edges lo + i * width; the quotient proposes one, the edges decide."""
    x, width = F.col(column).cast("double"), (hi - lo) / bins
    # least() skips NULLs, so missing values have to stay out explicitly
    guess = F.when(x.isNotNull(), F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)))

    def edge(i: Column) -> Column:
        return F.lit(lo) + i.cast("double") * F.lit(width)

    up = (guess < bins - 1) & (x >= edge(guess + 1))
    return F.when((guess > 0) & (x < edge(guess)), guess - 1).when(up, guess + 1).otherwise(guess)


_HISTOGRAM = "column string, bin int, left double, right double, n bigint"


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 30) -> DataFrame:
    """Equal-width bins over each column's range, the last bin closed; empty bins are kept.

    A column with a single value gets a range of one around it.
    """
    ends = _ends(df, columns)
    if not ends:
        return df.sparkSession.createDataFrame([], _HISTOGRAM)
    edges, index = {}, {}
    for c, (lo, hi, _, _) in ends.items():
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        edges[c] = (lo, (hi - lo) / bins, bins)
        index[c] = _even_bin(c, lo, hi, bins)
    return _densify(df, _count_bins(df, index), edges)


def step_histogram(df: DataFrame, steps: Mapping[str, tuple[float, float, int]] = CREDIT_STEPS) -> DataFrame:
    """Bins with fixed edges ``start + i*step``; rows outside the edges are ignored."""
    counts = _count_bins(df, {c: step_bin(c, *s) for c, s in steps.items()})
    return _densify(df, counts, steps)


def density_curve(df: DataFrame, column: str, points: int = GRID_POINTS, bin_width: float | None = None) -> DataFrame:
    """Gaussian kernel density on an even grid over the column's range, Scott's bandwidth.

    Equal values are counted first, and a value only meets the grid points its kernel reaches, so
    the work shrinks with the bandwidth as the table grows. ``bin_width`` adds the curve scaled to
    a histogram's counts.
    """
    ends = _ends(df, [column])
    lo, hi, n, s = ends.get(column, (0.0, 0.0, 0, None))
    if n < 2 or not s:
        return df.sparkSession.createDataFrame([], "point int, x double, density double, scaled double")
    width = s * n ** (-1 / 5)
    gap = (hi - lo) / (points - 1)
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("c"))
    first = F.greatest(F.ceil((F.col("v") - lo - KERNEL_REACH * width) / F.lit(gap)), F.lit(0))
    last = F.least(F.floor((F.col("v") - lo + KERNEL_REACH * width) / F.lit(gap)), F.lit(points - 1))
    z = (F.col("v") - (F.lit(lo) + F.col("point") * F.lit(gap))) / F.lit(width)
    reached = counts.filter(first <= last).select("v", "c", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("point"))
    sums = reached.groupBy("point").agg(F.sum(F.col("c") * F.exp(z * z * -0.5)).alias("k"))
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("point"))
    density = F.coalesce("k", F.lit(0.0)) / F.lit(n * width * (2 * 3.141592653589793) ** 0.5)
    return grid.join(sums, "point", "left").select(
        "point", (F.lit(lo) + F.col("point") * F.lit(gap)).alias("x"), density.alias("density"),
        (density * (n * (bin_width if bin_width is not None else 1.0))).alias("scaled"),
    )
