"""Descriptive statistics: summaries, quantiles, histograms and kernel densities."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T


def length_columns(df: DataFrame, original: str, paraphrase: str) -> DataFrame:
    o, p = F.col(original), F.col(paraphrase)
    out = df.withColumns({
        "orig_chars": T.letter_count(o), "orig_words": T.letter_word_count(o), "orig_sents": T.sentence_count(o),
        "para_chars": T.letter_count(p), "para_words": T.letter_word_count(p), "para_sents": T.sentence_count(p),
    })
    return out.withColumn("char_ratio", T.ratio(F.col("para_chars"), F.col("orig_chars")))


def described(df: DataFrame, columns: Sequence[str], by: str | None = None) -> DataFrame:
    """count, sum, mean and sample standard deviation, one row per column (and group), in one aggregation."""
    stats = [f(c).alias(f"{c}__{n}") for c in columns for n, f in (("count", F.count), ("sum", F.sum), ("mean", F.avg), ("std", F.stddev_samp))]
    wide = df.groupBy(*([by] if by else [])).agg(*stats)
    rows = ", ".join(f"'{c}', `{c}__count`, cast(`{c}__sum` as double), `{c}__mean`, `{c}__std`" for c in columns)
    return wide.selectExpr(*([f"`{by}`"] if by else []), f"stack({len(columns)}, {rows}) as (metric, n, total, mean, std)")


def means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.avg(c).alias(c) for c in columns])


def safe_mean(c: Column) -> Column:
    """Mean of what can be read as a number; null if nothing can."""
    return F.avg(F.nanvl(c.try_cast("double"), F.lit(None).cast("double")))


#: Values that one buffer may hold, and runs that a larger range is cut into.
HELD, RUNS = 200_000, 200


def order_statistics(df: DataFrame, column: str, ranks: Sequence[int]) -> dict[int, float]:
    """The values at 0-based ranks of the sorted non-null numbers, exactly.

    A range of many values is cut into runs at approximate quantiles and the runs are counted; only those that hold a
    wanted rank are looked into, until one has few values or a single one. So no buffer grows with the table.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    found: dict[int, float] = {}
    todo: list[tuple[float | None, float | None, int, list[int]]] = [(None, None, 0, sorted(set(ranks)))]
    while todo:
        low, high, before, wanted = todo.pop()
        part = values if low is None else values.filter(F.col("v") > low)
        part = part if high is None else part.filter(F.col("v") <= high)
        x = part.agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.percentile_approx("v", [i / RUNS for i in range(1, RUNS)], 50 * RUNS).alias("cuts")).first()
        if x.low == x.high:
            found.update(dict.fromkeys(wanted, x.low))
        elif x.n <= HELD:
            every = part.agg(F.sort_array(F.collect_list("v")).alias("v"))
            got = every.select(F.transform(F.array(*[F.lit(r - before) for r in wanted]), lambda i: F.get("v", i)).alias("v")).first()[0]
            found.update(zip(wanted, got, strict=True))
        else:  # the greatest value is a run of its own, so that each step leaves fewer values
            cuts = sorted({c for c in x.cuts if c < x.high} | {math.nextafter(x.high, -math.inf)})
            run = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("v")))
            counts = {r.run: r["count"] for r in part.groupBy(run.alias("run")).count().collect()}
            for i in range(len(cuts) + 1):
                inside = [r for r in wanted if before <= r < before + counts.get(i, 0)]
                if inside:
                    todo.append((cuts[i - 1] if i else low, cuts[i] if i < len(cuts) else high, before, inside))
                before += counts.get(i, 0)
    return found


def exact_quantiles(df: DataFrame, column: str, at: Sequence[float]) -> list[float | None]:
    """Quantiles with linear interpolation; null of no values. Spark jobs find them when this is called, and what is built of
    them (quantiles, spread, bandwidth, challenge_sets) has their values as constants."""
    n = df.filter(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).count()
    if not n:
        return [None] * len(at)
    place = [q * (n - 1) for q in at]
    ranks = {r for x in place for r in (math.floor(x), math.ceil(x))}
    v = order_statistics(df, column, sorted(ranks))
    return [v[math.floor(x)] + (v[math.ceil(x)] - v[math.floor(x)]) * (x - math.floor(x)) for x in place]


def quantiles(df: DataFrame, column: str, at: Sequence[float] = (0.1, 0.9)) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per quantile."""
    rows = list(zip(map(float, at), exact_quantiles(df, column, at), strict=True))
    return df.sparkSession.createDataFrame(rows, "quantile double, value double")


def spread(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    q25, median, q75 = (F.lit(x).cast("double") for x in exact_quantiles(df, column, (0.25, 0.5, 0.75)))
    return df.agg(F.avg(c).alias("mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("std")).select("mean", median.alias("median"), "std", q25.alias("q25"), q75.alias("q75"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Bins of equal width over [low, high], the last one closed: bin, center, n, density. Empty bins are there."""
    width = (high - low) / bins
    inside = df.filter(F.col(column).between(low, high))
    at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
    counted = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    total = inside.agg(F.count("*").alias("_t"))
    out = spine.join(F.broadcast(counted), "bin", "left").crossJoin(F.broadcast(total))  # at most `bins` rows, and one
    n = F.coalesce("n", F.lit(0))
    return out.select("bin", (F.lit(low) + (F.col("bin") + 0.5) * width).alias("center"), n.cast("long").alias("n"), F.try_divide(n, F.col("_t") * width).alias("density"))


#: Bins of a bandwidth, and bins of a grid at most; a kernel ends at REACH bandwidths.
FINE, MOST_BINS, REACH = 4096, 1 << 18, 9


def bandwidth(df: DataFrame, column: str, rule: str = "silverman") -> tuple[int, float]:
    """Number of values and bandwidth: by silverman max(0.9 * min(std, IQR / 1.349) * n ** -0.2, 0.001), by scott std * n ** -0.2;
    0.05 without spread."""
    c = F.col(column)
    s = df.filter(c.isNotNull() & ~F.isnan(c.cast("double"))).agg(F.count(c).alias("n"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("std")).first()
    if rule == "scott":
        return s.n, s.std * s.n**-0.2 if s.n > 1 and s.std > 0 else 0.05
    if rule != "silverman":
        raise ValueError("the rule is `silverman` or `scott`")
    if s.n < 2:
        return s.n, 0.05
    low, high = exact_quantiles(df, column, (0.25, 0.75))
    sigma = min(s.std, (high - low) / 1.349)
    return s.n, max(0.9 * sigma * s.n**-0.2, 1e-3) if sigma > 0 else 0.05


def kernel_density(df: DataFrame, column: str, low: float, high: float, points: int, rule: str = "silverman") -> DataFrame:
    """Gaussian density on an even grid: point, x, density. Fewer than two values give 0.

    Linear binning: one scan deals each value over the two bins beside it, and the weights of the bins, a vector of at most
    MOST_BINS, are convolved with the kernel. A bin is a FINE-th of the bandwidth h, or wider where the grid would have more.
    With bins of width b the binned values and the straight lines between bins differ from the direct sum by at most
    (b / h) ** 2 / 4 of the kernel's height 1 / (h * sqrt(2 * pi)): 1.5e-8 of it at FINE. Spark jobs run when this is made.
    """
    spark, grid = df.sparkSession, [low + i * (high - low) / max(points - 1, 1) for i in range(points)]
    n, h = bandwidth(df, column, rule)
    if n < 2:
        return spark.createDataFrame([(i, float(x), 0.0) for i, x in enumerate(grid)], "point int, x double, density double")
    start, span = low - REACH * h, high - low + 2 * REACH * h
    bin_width = max(h / FINE, span / (MOST_BINS - 2))
    place = (F.col(column).cast("double") - start) / bin_width
    bins = int(span / bin_width) + 2
    inside = df.select(place.alias("p")).filter((F.col("p") >= 0) & (F.col("p") < bins - 1)).withColumn("i", F.floor("p").cast("int"))
    shares = F.explode(F.array(F.struct(F.col("i"), (F.col("i") + 1 - F.col("p")).alias("w")), F.struct((F.col("i") + 1).alias("i"), (F.col("p") - F.col("i")).alias("w"))))
    found = inside.select(shares.alias("s")).groupBy("s.i").agg(F.sum("s.w").alias("w")).toPandas()
    weights = np.zeros(bins)
    weights[found["i"].to_numpy()] = found["w"].to_numpy()
    size = 1 << (2 * bins - 1).bit_length()
    away = np.minimum(np.arange(size), size - np.arange(size)) * (bin_width / h)
    kernel = np.where(away <= REACH, np.exp(-0.5 * away**2), 0.0)
    summed = np.fft.irfft(np.fft.rfft(weights, size) * np.fft.rfft(kernel), size)[:bins]
    at = (np.array(grid) - start) / bin_width
    density = np.maximum(np.interp(at, np.arange(bins), summed), 0.0) / (n * h * math.sqrt(2 * math.pi))
    return spark.createDataFrame([(i, float(x), float(d)) for i, (x, d) in enumerate(zip(grid, density, strict=True))], "point int, x double, density double")


def length_range(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("low"), F.avg(column).alias("mean"), F.max(column).alias("high"))


def within_length(df: DataFrame, column: str, most: int = 8193) -> tuple[DataFrame, DataFrame]:
    """Rows of at most this length, and one row with how many are kept and their per cent (null of none)."""
    kept = df.agg(F.count("*").alias("n_total"), F.count_if(F.col(column) <= most).alias("n_kept"))
    return df.filter(F.col(column) <= most), kept.withColumn("percent", F.try_divide(F.col("n_kept") * 100.0, F.col("n_total")))
