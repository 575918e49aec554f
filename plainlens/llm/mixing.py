"""Mixing sources to target weights by entropy balancing.

Document i of source s gets a rate of 2 / (1 + exp(-(b + l * size_i / mean size of s))) copies: of all rates between 0 and 2
whose words sum to the source's target, those nearest in (binary) relative entropy to one prior rate for all sources, that
of the whole mix; b is the logit of half the prior rate, l the dual variable of the source's token constraint: a source that
is to give more than the prior draws on its large documents more, one that is to give less draws on them less. The dual is
convex, and documents enter it only by source and size, so they are counted first (map-side combined). Each Newton
iteration is one aggregation over these counts: gradient and curvature of every source are summed on the cluster, and a table
with one row for each source takes the step, kept between bounds that the signs of the gradients narrow.

Rounding walks a source's sizes from the largest, and each size's copies absorb the words that the ones before were off
by. Copies are dealt inside a size by hash: every document gets the whole part, the remainder goes to the first by hash, with
size classes cut into hash buckets so that a size that a third of all documents share is no single group.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import id_key, partitions, prepare, unused
from .graph import joined_per_key

#: Source weights by code-point order, repeating; words of the mix for each word of the input; most copies of a document.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Documents of one size and source that share one hash bucket (expected).
BUCKET = 500
#: Newton iterations at most, and the part of a target by which they may miss it; rounding absorbs what is left.
ROUNDS, MISS = 60, 1e-10
_WORD = "[^\\x20\\x09-\\x0D]+"


def duals(classes: DataFrame, most: int = MOST, prior: float = SHARE / MOST, rounds: int = ROUNDS) -> tuple[DataFrame, int]:
    """(src, dual) and the iterations made, from rows (src, size, count, source_size, target).

    The dual is null where no tilt is asked for: a target of 0, or of all words `most` times.
    """
    offset = float(np.log(prior / (1 - prior)))
    mean, never = F.col("source_size") / F.col("n"), F.lit(float("inf"))
    per = classes.filter("size > 0").groupBy("src").agg(F.sum("count").alias("n"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    per = per.filter((F.col("target") > 0) & (F.col("target") < most * F.col("source_size") * (1 - 1e-12)))
    state = per.select("src", mean.alias("mean"), (F.col("target") / most / mean).alias("goal"), F.lit(0.0).alias("dual"), (-never).alias("low"), never.alias("high"))
    x = F.col("size") / F.col("mean")
    p = 1 / (1 + F.exp(-(F.lit(offset) + F.col("dual") * F.col("x"))))
    carried, settled, made = ("mean", "goal", "dual", "low", "high"), [], 0
    # kept by source, so that an iteration moves only the table of sources; a lost part is made again from the checkpoint
    here = classes.filter("size > 0").select("src", "size", "count").repartition(partitions(classes.sparkSession), "src").persist()
    while True:
        at = here.join(state, "src").select("src", "count", x.alias("x"), *carried).withColumn("p", p)
        sums = (F.sum(F.col("count") * F.col("x") * F.col("p")) - F.first("goal")).alias("miss"), F.sum(F.col("count") * F.col("x") * F.col("x") * F.col("p") * (1 - F.col("p"))).alias("slope")
        now = at.groupBy("src").agg(*sums, *[F.first(c).alias(c) for c in carried])
        now = now.withColumns({"low": F.when(F.col("miss") < 0, F.col("dual")).otherwise(F.col("low")), "high": F.when(F.col("miss") > 0, F.col("dual")).otherwise(F.col("high"))})
        newton = F.try_divide(F.col("miss"), F.col("slope"))
        inside = F.coalesce((F.col("dual") - newton > F.col("low")) & (F.col("dual") - newton < F.col("high")), F.lit(False))
        narrow = (F.col("low") > -never) & (F.col("high") < never)
        step = F.when(inside, F.col("dual") - newton).when(narrow, (F.col("low") + F.col("high")) / 2).otherwise(F.col("dual") - F.signum("miss") * F.greatest(F.lit(1.0), F.abs("dual")))
        now = now.withColumn("step", step)
        now = now.withColumn("done", (F.abs("miss") <= MISS * F.col("goal")) | (F.col("step") == F.col("dual")) | F.lit(made >= rounds)).checkpoint()
        settled.append(now.filter("done").select("src", "dual"))
        state = now.filter("NOT done").select("src", "mean", "goal", F.col("step").alias("dual"), "low", "high")
        if state.isEmpty():
            break
        made += 1
    here.unpersist()
    # sums of a rerun may differ in their last digits; ten decimals of the dual do not show it
    return reduce(DataFrame.unionByName, settled).select("src", F.round("dual", 10).alias("dual")), made


def balanced_copies(size: np.ndarray, count: np.ndarray, target: float, dual: float | None, most: int = MOST, prior: float = SHARE / MOST) -> np.ndarray:
    """Copies of all documents of each size (sizes ascending): the tilted rates, then rounding that carries the error."""
    total = float((size * count).sum())
    if total <= 0 or target <= 0:
        return np.zeros(len(size), np.int64)
    if dual is None or np.isnan(dual):
        return np.where(size > 0, most * count, 0)
    mean = total / count[size > 0].sum()
    rate = most / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + dual * size / mean, -700, 700)))
    out, owed = np.zeros(len(size), np.int64), 0.0
    for i in range(len(size) - 1, -1, -1):
        if size[i] == 0:
            continue
        owed += float(rate[i] * count[i] * size[i])
        out[i] = min(max(int(np.floor(owed / size[i] + 0.5)), 0), most * int(count[i]))
        owed -= float(out[i] * size[i])
    return out


def _round(most: int, prior: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", kind="stable").reset_index(drop=True)
        copies = balanced_copies(pdf["size"].to_numpy(float), pdf["count"].to_numpy(), float(pdf["target"].iloc[0]), pdf["dual"].iloc[0], most, prior)
        return pdf[["src", "size", "count", "source_size", "target"]].assign(copies=copies)

    return run


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds number, the 0-based place of each row in a total order: rows are sorted in ranges, the ranges counted (one row
    each), and their counts summed up."""
    width = partitions(rows.sparkSession)
    ranged = rows.repartitionByRange(width, *order).sortWithinPartitions(*order)
    placed = ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}).checkpoint()
    counts = {r["_part"]: r["count"] for r in placed.groupBy("_part").count().collect()}
    before, total = [], 0
    for i in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(i, 0)
    first = F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in before or [0]]), F.col("_part") + 1)
    return placed.withColumn("number", F.col("_at") + first).drop("_part", "_at")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """src, is_null, source_size, target from rows (src, is_null, source_size), one per source.

    Sources in code-point order, null last, weigh as `weights`, repeating; targets share `share` of all words by weight and
    stop at `most` times a source's words, the excess being reshared until none is above. Each round of that is one
    aggregation: with the words per unit of weight as level, sources above their cap are set to it and leave.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    rows = numbered(sizes, "is_null", "src").withColumn("w", w).withColumn("cap", (most * F.col("source_size")).cast("double"))
    rows = rows.select("src", "is_null", "source_size", "w", "cap")
    level, free = 0.0, None
    while True:
        capped = F.col("cap") <= F.col("w") * F.lit(level)
        x = rows.agg(F.sum("source_size").alias("total"), F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0.0)).alias("full"), F.coalesce(F.sum(F.when(~capped, F.col("w"))), F.lit(0.0)).alias("w"), F.count_if(~capped).alias("free")).first()
        if x.free == free or not x.free:
            break
        free, level = x.free, max(level, (share * x.total - x.full) / x.w)
    return rows.select("src", "is_null", "source_size", F.least(F.col("cap"), F.col("w") * F.lit(level)).alias("target"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, bucket: int = BUCKET) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's), copies, taken (copies times size), k, x.

    A null text has size 0 and, like every text without a word, no copies. A null source is a source of its own. Rows with
    equal doc_id, or all columns equal, are documents of their own; which of fully equal rows gets a further copy does not
    show. Reruns agree: order comes from hashes of doc_id and text. An empty table gives an empty result; other columns are
    ignored.
    """
    prepare(docs.sparkSession)
    text = F.col("text").cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), id_key("doc_id").alias("k"), F.xxhash64(text).alias("x"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src"), F.col("source").isNull().alias("is_null"), word_count(text).alias("size"))
    base = base.checkpoint()
    classes = base.groupBy("src", "is_null", "size").agg(F.count("*").alias("count"))
    targets = source_targets(classes.groupBy("src", "is_null").agg(F.sum(F.col("size") * F.col("count")).alias("source_size")), weights, share, most)
    key = F.when(F.col("is_null"), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("src")))
    targets = targets.withColumn("src", key).drop("is_null")
    classes = classes.withColumn("src", key).join(targets, "src").select("src", "size", "count", "source_size", "target").checkpoint()
    tilted = classes.join(duals(classes, most, share / most)[0], "src", "left")
    solved = tilted.groupBy("src").applyInPandas(_round(most, share / most), "src string, size long, count long, source_size long, target double, copies long").checkpoint()
    buckets = F.ceil(F.col("count") / F.lit(bucket)).cast("int")
    placed = joined_per_key(base.withColumn("src", key), solved.withColumn("n", F.col("count")), ["src", "size"], base.count()).withColumn("h", F.xxhash64("k", "x", F.lit(17)))
    placed = placed.withColumn("b", F.pmod(F.xxhash64("h"), buckets).cast("int"))
    whole = F.floor(F.col("copies") / F.col("count")).cast("long")
    placed = placed.select("doc_id", "k", "x", "src", "size", "source_size", "target", "h", "b", whole.alias("whole"), (F.col("copies") - whole * F.col("count")).alias("rest"), "count")
    own = placed.groupBy("src", "size", "b").agg(F.count("*").alias("own"))
    upto = Window.partitionBy("src", "size").orderBy("b")  # one row for each bucket
    own = own.select("src", "size", "b", "own", F.sum("own").over(upto).alias("upto"))
    placed = placed.join(own, ["src", "size", "b"])
    dealt = lambda c: F.floor(F.col("rest") * c / F.col("count"))
    part = dealt(F.col("upto")) - dealt(F.col("upto") - F.col("own"))
    first = Window.partitionBy("src", "size", "b").orderBy("h", "k", "x")
    copies = F.col("whole") + F.when(F.row_number().over(first) <= part, 1).otherwise(0)
    out = placed.withColumn("copies", copies.cast("long"))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "k", "x", "src")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    return mixed(docs, **options).select("doc_id", "size", "source_size", "target", "taken", "copies")


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The documents as often as the mix takes them (0 to `most` times), all columns.

    Of rows equal in doc_id, text and source, those first by a hash of all columns get the further copies.
    """
    k, x, s, copies, n, m, times, i = unused(docs, 8)
    own = [k, x, s]
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    keyed = docs.withColumns({k: id_key("doc_id"), x: F.xxhash64(F.col("text").cast("string")), s: key})
    whole = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
    verdict = mixed(docs, **options).filter("copies > 0").select(F.col("k").alias(k), F.col("x").alias(x), F.col("src").alias(s), "copies")
    total = verdict.groupBy(*own).agg(F.sum("copies").alias(copies))
    alike = Window.partitionBy(*own)
    joined = keyed.join(total, own).withColumns({n: F.row_number().over(alike.orderBy(whole)), m: F.count("*").over(alike)})
    part = F.floor(F.col(copies) / F.col(m)) + F.when(F.col(n) <= F.col(copies) % F.col(m), 1).otherwise(0)
    taken = joined.withColumn(times, part.cast("int")).filter(F.col(times) > 0)
    return taken.withColumn(i, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])
