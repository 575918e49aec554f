"""Sentence boundaries learned from the texts themselves, after Kiss and Strunk (Unsupervised Multilingual Sentence Boundary
Detection, 2006): abbreviations, words that begin sentences, and pairs held together by a dot come from log-likelihood ratios.

Training is aggregations of tokens by type, and what it learns are tables; applying it joins the places where a sentence may
end, and nothing else, with these tables. A place is a dot, `!`, `?` or ellipsis with closing marks and white space after it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rows import exploded
from ..functions.text import BLANKS, strip_ws
from .kept import kept

#: Fixed values of the method: thresholds of abbreviations, sentence starters and collocations.
ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88
_NUMBER = "##number##"
#: A word with the dots in it and after it, or a mark of its own; a-z, which are letters too, are told without a look-up.
TOKEN = r"[a-z\p{L}\p{N}]++(?:[.'’-]++[a-z\p{L}\p{N}]++)*+\.*+|[.!?…]+|[^\p{L}\p{N}.!?…" + BLANKS + "]"
_PLACE = rf"([.!?…][\"'”’»)\]]*)[{BLANKS}]+"


def type_of(token: Column) -> Column:
    """A token's type: lower case without the dots after it; numbers are one type."""
    bare = F.rtrim(F.lower(token), F.lit("."))
    return F.when((bare < ":") & bare.rlike(r"^[+-]?[0-9][0-9.,-]*$"), _NUMBER).otherwise(bare)  # digits and signs are below `:`


def _ll(k: Column, n: Column, p: Column) -> Column:
    """Log-likelihood of k of n at a rate p; what does not occur adds nothing."""
    part = lambda c, r: F.when(c > 0, c * F.log(F.greatest(r, F.lit(1e-300)))).otherwise(0.0)
    return part(k, p) + part(n - k, 1 - p)


def ratio_to_independence(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """-2 log of the likelihoods: b occurs beside a as often as elsewhere, against at rates of its own."""
    a, b, ab, n = (c.cast("double") for c in (a, b, ab, n))
    p, p1, p2 = b / n, ab / a, F.when(n > a, (b - ab) / F.greatest(n - a, F.lit(1.0))).otherwise(1.0)
    return -2 * (_ll(ab, a, p) + _ll(b - ab, n - a, p) - _ll(ab, a, p1) - _ll(b - ab, n - a, p2))


def abbreviation_score(kind: Column, with_dot: Column, without: Column, dots: Column, n: Column) -> Column:
    """How much a type is an abbreviation: the ratio of a dot nearly always against by chance, less for long types and for
    each time it stands without a dot, more for dots inside."""
    letters = F.length(F.replace(kind, F.lit("."), F.lit(""))).cast("double")
    inside = F.length(kind) - letters
    ratio = -2 * (_ll(with_dot, with_dot + without, dots / n) - _ll(with_dot, with_dot + without, F.lit(0.99)))
    return ratio * F.exp(-letters) * (inside + 1) * F.pow(F.greatest(letters, F.lit(1.0)), -without.cast("double"))


def _cut(text: str) -> Column:
    """A text's fragments, the empty ones too."""
    return F.split(F.regexp_replace(strip_ws(F.col(f"`{text}`")), _PLACE, "$1\u0001"), "\u0001")


def fragments(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, at, fragment, words (its tokens), last (the token that the place follows, null where the text just ends), next
    (the first word of the next fragment): the parts of a text between places where a sentence may end."""
    rows = exploded(df.select(F.col(f"`{key}`").alias("key"), _cut(text).alias("_f")).withColumn("_n", F.transform("_f", lambda x: F.regexp_extract(x, TOKEN, 0))), ["key", "_n"], "_f", "fragment", "at")
    rows = rows.filter("fragment <> ''").withColumn("words", F.regexp_extract_all("fragment", F.lit(TOKEN), F.lit(0)))
    # no token holds white space, so the tokens after the last white space nearly always have the one that is asked
    tail = F.regexp_extract_all(F.regexp_replace("fragment", f"(?s)^.*[{BLANKS}]", ""), F.lit(TOKEN), F.lit(0))
    last_of = lambda words: F.get(F.filter(F.reverse(words), lambda w: ~w.isin(*"\"'”’»)]")), F.lit(0))
    last = F.coalesce(last_of(tail), last_of("words"))
    following = F.nullif(F.get("_n", F.col("at") + 1), F.lit(""))
    return rows.select("key", "at", "fragment", "words", F.when(following.isNotNull(), last).alias("last"), following.alias("next"))


@dataclass(frozen=True)
class Punkt:
    """What was learned: abbreviations (type), starters (type), collocations (first, second), cases (type and whether it was
    seen upper or lower, inside, at the beginning or anywhere)."""

    abbreviations: DataFrame
    starters: DataFrame
    collocations: DataFrame
    cases: DataFrame


def type_counts(parts: DataFrame) -> DataFrame:
    """type, with_dot, without, upper_inside, lower_inside over all tokens; tokens that only are marks have no type.

    Tokens are counted as they are written first, so types are told for different ones only.
    """
    rows = exploded(parts, [], "words", "w", "i").groupBy("w", (F.col("i") > 0).alias("inside")).agg(F.count("*").alias("n"))
    dot = F.col("w").endswith(".")
    seen = lambda c: F.max(F.coalesce(c, F.lit(False)))
    # whether a type is of words is told after counting: a filter on the token would run for each of all tokens
    typed = rows.groupBy(type_of(F.col("w")).alias("type")).agg(
        F.sum(F.when(dot, F.col("n")).otherwise(0)).alias("with_dot"), F.sum(F.when(dot, 0).otherwise(F.col("n"))).alias("without"),
        seen(F.col("inside") & F.col("w").rlike(r"^\p{Lu}")).alias("upper_inside"), seen(F.col("inside") & F.col("w").rlike(r"^\p{Ll}")).alias("lower_inside"), F.max(F.col("w").rlike(r"^[\p{L}\p{N}]")).alias("_word"),
    )
    return typed.filter("_word").drop("_word")


def abbreviations(counts: DataFrame) -> DataFrame:
    """type, with_dot, without, score of the types that are abbreviations."""
    total = counts.agg(F.sum("with_dot").cast("double").alias("_dots"), F.sum(F.col("with_dot") + F.col("without")).cast("double").alias("_n"))
    rated = counts.filter(F.col("with_dot") > 0).filter(F.col("type").rlike(r"\p{L}") & (F.col("type") != _NUMBER)).crossJoin(F.broadcast(total))  # one row
    rated = rated.withColumn("score", abbreviation_score(F.col("type"), F.col("with_dot"), F.col("without"), F.col("_dots"), F.col("_n")))
    return rated.filter(F.col("score") >= ABBREVIATION).select("type", "with_dot", "without", "score")


def _places(parts: DataFrame) -> DataFrame:
    """Fragments that a place follows, with the types beside it, the case of the next word, and the kind of the last token."""
    ends = parts.filter("next IS NOT NULL").withColumns({"before": type_of(F.col("last")), "after": type_of(F.col("next")), "upper": F.col("next").rlike(r"^\p{Lu}"), "lower": F.col("next").rlike(r"^\p{Ll}")})
    has = lambda pattern: F.coalesce(F.col("last").rlike(pattern), F.lit(False))
    return ends.withColumns({"dotted": has(r"^[\p{L}\p{N}].*\.$"), "ellipsis": has(r"^(\.\.+|…)$")})


def _judged(places: DataFrame, known: DataFrame) -> DataFrame:
    """Places with whether an abbreviation is before them, and the break that this alone makes (first)."""
    named = places.join(known.select(F.col("type").alias("before"), F.lit(True).alias("_a")), "before", "left")
    named = named.withColumn("is_abbreviation", F.col("dotted") & F.coalesce("_a", F.lit(False))).drop("_a")
    return named.withColumn("first", ~F.col("is_abbreviation") & ~F.col("ellipsis"))


def trained(df: DataFrame, key: str, text: str) -> Punkt:
    """Learn from all texts, which are read twice: for the counts of types, and for those of places by what is beside them.

    These two tables are kept when the model is made; they grow with the different words of the texts.
    """
    parts = fragments(df, key, text)
    counts = kept(type_counts(parts))
    beside = ["before", "after", "upper", "lower", "dotted", "ellipsis"]
    known = abbreviations(counts)
    ends = _judged(kept(_places(parts).groupBy(*beside).agg(F.count("*").alias("n"))), known)
    seen = lambda c: F.max(F.coalesce(c, F.lit(False)))
    firsts = ends.groupBy(F.col("after").alias("type")).agg(
        F.sum(F.when(F.col("first"), F.col("n")).otherwise(0)).alias("at_break"), seen(F.col("first") & F.col("upper")).alias("upper_first"), seen(F.col("first") & F.col("lower")).alias("lower_first"),
        seen(~F.col("first") & F.col("upper")).alias("upper_unknown"), seen(~F.col("first") & F.col("lower")).alias("lower_unknown"),
    )
    totals = counts.agg(F.sum(F.col("with_dot") + F.col("without")).alias("_n"))
    breaks = ends.agg(F.coalesce(F.sum(F.when(F.col("first"), F.col("n"))), F.lit(0)).alias("_breaks"))
    every = counts.join(firsts, "type", "left").na.fill(0, ["at_break"]).na.fill(False, ["upper_first", "lower_first", "upper_unknown", "lower_unknown"])
    both = every.crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(breaks))  # one row each
    count = F.col("with_dot") + F.col("without")
    ratio = ratio_to_independence(F.col("_breaks"), count, F.col("at_break"), F.col("_n"))
    more = F.col("_n") * F.col("at_break") > count * F.col("_breaks")
    starters = both.filter((F.col("at_break") > 0) & F.col("type").rlike(r"^\p{L}") & (ratio >= STARTER) & more).select("type", "at_break", ratio.alias("score"))
    cases = every.select("type", (F.col("upper_first") | F.col("upper_inside") | F.col("upper_unknown")).alias("upper"), (F.col("lower_first") | F.col("lower_inside") | F.col("lower_unknown")).alias("lower"), "upper_inside", "lower_first")
    held = F.col("is_abbreviation") | (F.col("dotted") & ((F.col("before") == _NUMBER) | F.col("before").rlike(r"^\p{L}$")))
    pairs = ends.filter(held).groupBy(F.col("before").alias("first"), F.col("after").alias("second")).agg(F.sum("n").alias("n_both"))
    of = lambda name, c: counts.select(F.col("type").alias(name), count.alias(c))
    rated = pairs.join(of("first", "n_first"), "first").join(of("second", "n_second"), "second").crossJoin(F.broadcast(totals))
    tie = ratio_to_independence(F.col("n_first"), F.col("n_second"), F.col("n_both"), F.col("_n"))
    strong = (tie >= COLLOCATION) & (F.col("_n") * F.col("n_both") > F.col("n_first") * F.col("n_second")) & (F.col("n_both") > 1)
    unstarted = rated.join(starters.select(F.col("type").alias("second")), "second", "left_anti")
    return Punkt(known, starters, unstarted.filter(strong).select("first", "second", "n_both", tie.alias("score")), cases)


def breaks(parts: DataFrame, model: Punkt) -> DataFrame:
    """key, at, is_break for every fragment that a place follows.

    A dot ends a sentence but after an abbreviation, inside a pair held together, and after an initial or a number before a
    word that does not begin sentences; an abbreviation ends one before a word that is in upper case only where one begins,
    or a known starter in upper case. `!` and `?` always do.
    """
    ends = _judged(_places(parts), model.abbreviations)
    start = model.starters.select(F.col("type").alias("after"), F.lit(True).alias("starts"))
    pair = model.collocations.select(F.col("first").alias("before"), F.col("second").alias("after"), F.lit(True).alias("held"))
    cases = model.cases.select(F.col("type").alias("after"), F.col("upper").alias("ever_upper"), F.col("lower").alias("ever_lower"), "upper_inside", "lower_first")
    known = ends.join(start, "after", "left").join(pair, ["before", "after"], "left").join(cases, "after", "left").na.fill(False, ["starts", "held", "ever_upper", "ever_lower", "upper_inside", "lower_first", "is_abbreviation"])
    word = F.col("next").rlike(r"^[\p{L}\p{N}]")
    begins = word & F.col("upper") & F.col("ever_lower") & ~F.col("upper_inside")
    goes_on = ~word | (F.col("lower") & (F.col("ever_upper") | ~F.col("lower_first")))
    initial = F.col("dotted") & F.col("before").rlike(r"^\p{L}$")
    number = F.col("dotted") & (F.col("before") == _NUMBER)
    after_name = initial & ~begins & F.col("upper") & ~F.col("ever_lower")
    verdict = (
        F.when(~F.col("dotted") & ~F.col("ellipsis"), True).when(F.col("held"), False)
        .when(F.col("is_abbreviation") & ~initial | F.col("ellipsis"), begins | (F.col("upper") & F.col("starts")))
        .when(initial | number, ~(goes_on | after_name) & ~(F.col("is_abbreviation") & ~begins & ~F.col("starts")))
        .otherwise(True)
    )
    return known.select("key", "at", verdict.alias("is_break"))


def sentences(df: DataFrame, key: str, text: str, model: Punkt) -> DataFrame:
    """key and sentences, an array, for each text that has one; white space between joined fragments becomes one space. Keys
    are unique and not null.

    Texts are cut again where they lie; only the numbers of the places that end no sentence are shuffled, and meet them.
    """
    held = breaks(fragments(df, key, text), model).filter("NOT is_break").groupBy("key").agg(F.collect_list("at").alias("_held"))
    cut = df.select(F.col(f"`{key}`").alias("key"), _cut(text).alias("_f")).filter(F.exists("_f", lambda x: x != "")).join(held, "key", "left")
    # a place that does not end a sentence lies after its fragment, so the neighbour tells what joins it to the next one
    row = lambda at, place, t: F.struct(at.cast("int").alias("at"), F.lit(place).alias("place"), t.alias("t"))
    places = F.transform(F.coalesce("_held", F.array().cast("array<int>")), lambda i: row(i, True, F.lit("")))
    mixed = cut.withColumn("_m", F.sort_array(F.concat(F.transform("_f", lambda x, i: row(i, False, x)), places)))
    mark = lambda i: F.when(F.coalesce(F.get("_m", i + 1)["place"], F.lit(False)), " ").otherwise("\u0001")
    pieces = F.transform("_m", lambda x, i: F.when(x["place"] | (x["t"] == ""), "").otherwise(F.concat(x["t"], mark(i))))
    whole = mixed.select("key", F.split(F.array_join(pieces, ""), "\u0001").alias("_s"))
    return whole.select(F.col("key").alias(key), F.filter(F.transform("_s", strip_ws), lambda x: x != "").alias("sentences"))
