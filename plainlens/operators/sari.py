"""Document-level SARI: n-gram additions, deletions and keeps, with length penalties."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T

#: Scores run from 0 to this.
SCALE = 100.0
#: The public 13a tokenisation, in order (pattern, replacement).
TOKENISATION = (("<skipped>", ""), ("-\\n", ""), ("\\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "), (r"([^0-9])([\.,])", "$1 $2 "), (r"([\.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 "))


def sari_tokens(c: Column) -> Column:
    s = F.concat(F.lit(" "), F.lower(F.coalesce(c, F.lit(""))), F.lit(" "))
    for pattern, to in TOKENISATION:
        s = F.regexp_replace(s, pattern, to)
    return T.tokens(s)


def _operations(most: int) -> Callable[..., Column]:
    """f_add, f_keep, f_del of the token arrays of source, output and reference; null where no text has a token."""

    def counts(tokens: list[str], n: int) -> Counter:
        return Counter(zip(*[tokens[i:] for i in range(n)], strict=False))

    def f1(hit: int, sys: int, ref: int) -> float:
        p, q = hit / sys if sys else 0.0, hit / ref if ref else 0.0
        return 2 * p * q / (p + q) if p + q else 0.0

    def score(source: list[str], output: list[str], reference: list[str]) -> tuple[float, float, float]:
        add = keep = gone = 0.0
        for n in range(1, most + 1):
            s, o, r = counts(source, n), counts(output, n), counts(reference, n)
            new_o, new_r, so, sr = o.keys() - s.keys(), r.keys() - s.keys(), s - o, s - r
            add += f1(len(new_o & new_r), len(new_o), len(new_r))
            keep += f1((o & s & r).total(), (o & s).total(), (r & s).total())
            gone += f1((so & sr).total(), so.total(), sr.total())
        return add / most * SCALE, keep / most * SCALE, gone / most * SCALE  # an n without n-grams counts 0

    @F.arrow_udf("struct<f_add:double,f_keep:double,f_del:double>")
    def scored(source: pa.Array, output: pa.Array, reference: pa.Array) -> pa.Array:
        rows = ([x or [] for x in row] for row in zip(source.to_pylist(), output.to_pylist(), reference.to_pylist(), strict=True))
        found = [dict(zip(("f_add", "f_keep", "f_del"), score(*row), strict=True)) if any(row) else None for row in rows]
        return pa.array(found, pa.struct([(c, pa.float64()) for c in ("f_add", "f_keep", "f_del")]))

    return scored


def penalties(df: DataFrame, source: str, output: str, reference: str) -> DataFrame:
    """Adds n_in, n_out, n_ref, s_out, s_ref, lp1, lp2, slp, valid."""
    i, o, r = (T.token_count(F.col(c)) for c in (source, output, reference))
    out = df.withColumns({"n_in": i, "n_out": o, "n_ref": r, "s_out": T.sentence_count(F.col(output)), "s_ref": T.sentence_count(F.col(reference))})
    n_in, n_out, n_ref = F.col("n_in"), F.col("n_out"), F.col("n_ref")
    return out.withColumns({
        "lp1": F.when(n_out >= n_ref, 1.0).otherwise(F.exp(F.try_divide(n_out - n_ref, n_out))),
        "lp2": F.when(n_out <= n_ref, 1.0).otherwise(F.exp((n_ref - n_out) / F.greatest(n_in - n_ref, F.lit(1)))),
        "slp": F.exp(F.try_divide(-F.abs(F.col("s_ref") - F.col("s_out")), F.greatest("s_ref", "s_out"))),
        "valid": (n_in > 0) & (n_out > 0) & (n_ref > 0),
    })


def operations(source: str, output: str, reference: str, most: int = 4) -> Column:
    """f_add, f_keep, f_del as a struct: F1 per n-gram length, averaged, on the SCALE; null where no text has a token.

    N-grams are those of one row, so they are counted in its task: none becomes a row, is sorted or shuffled.
    """
    return _operations(most)(*[sari_tokens(F.col(f"`{c}`")) for c in (source, output, reference)])


def operation_scores(df: DataFrame, key: str, source: str, output: str, reference: str, most: int = 4) -> DataFrame:
    """key, f_add, f_keep, f_del of the rows where a text has a token."""
    return df.select(key, operations(source, output, reference, most).alias("_f")).filter("_f IS NOT NULL").select(key, "_f.*")


def d_sari(df: DataFrame, key: str, source: str, output: str, reference: str) -> DataFrame:
    """Adds d_sari, d_sari_add, d_sari_keep, d_sari_del; null where a text has no word."""
    rated = penalties(df, source, output, reference).withColumn("_f", operations(source, output, reference))
    f = lambda c: F.when(F.col("valid"), F.col(f"_f.{c}"))
    add, keep, gone = f("f_add") * F.col("lp1"), f("f_keep") * F.col("lp2") * F.col("slp"), f("f_del") * F.col("lp2")
    return rated.withColumns({"d_sari": (keep + gone + add) / 3, "d_sari_add": add, "d_sari_keep": keep, "d_sari_del": gone}).drop("_f", "n_in", "n_out", "n_ref", "s_out", "s_ref", "lp1", "lp2", "slp", "valid")
