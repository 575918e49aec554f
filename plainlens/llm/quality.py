"""Quality rules whose cutoffs carry a guarantee against rejecting good documents.

Every rule compares one rate of a text with a cutoff. The good documents fall into PARTS parts. All bad documents and one part
of the good ones give one path of cutoffs for all rules together, from rejecting nothing to rejecting more and more, the best
exchange of bad for good documents first. All good documents of the other parts, the holdout, which did not shape the path,
decide how far each stratum may follow it: step by step, while the exact (Clopper-Pearson) upper bound of the share of the
stratum's good documents that the rules reject together is at most `risk`. Steps are tried in a fixed order up to the first
failure, which needs no correction along the path; across strata the error probability is divided by their number
(Bonferroni), counting strata that are large enough to pass at all, which their size alone decides.

The parts take turns, so every good document shapes a path and decides on all others. Of the cutoffs that the paths give a
stratum, each rule takes the loosest. These reject nothing that those of any one path would not, so they exceed the risk only
if all paths do, and the turns need no correction either. So with probability 1 - error at once for all strata, the rules
reject at most `risk` of a stratum's good documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Generator, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import batch, id_key, prepare, tidy, unused

#: Largest share of a stratum's good documents that all rules together may reject, and the probability of more.
RISK, ERROR = 0.02, 0.05
#: Rates, each in [0, 1] or cut there, and the grid of cutoffs: a text is rejected if its rate is above.
RULES = ("symbol_rate", "shout_rate", "dup_line_rate", "repeat_rate", "upper_rate")
GRID = 50
#: Parts of the good documents, by hash: each shapes a path of its own, for which all others are the holdout.
PARTS = 4
#: What rejecting a share of the good documents costs against the gain of rejecting an equal share of the bad ones; the part
#: of the best gain that a looser cutoff must have to be preferred; the least gain of a step; stops between two cutoffs.
PRICE, SHARE, LEAST_GAIN, STOPS = 20.0, 0.99, 0.005, 4
#: The base filter: fewest words, and the most per cent of words in repeated 3-word windows.
MIN_WORDS, MAX_REPEAT = 50, 50
#: More strata than this are an error, as cutoffs are held on the driver.
MAX_STRATA = 10_000
_SYMBOLS = "#*$%&|<>"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts", "n_upper", "n_ascii_letters")
_ARROW = pa.schema([(c, pa.int64()) for c in _COUNTS])


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in this text, first occurrences included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    count, mark = Counter(windows), bytearray(len(words))
    for i, w in enumerate(windows):
        if count[w] > 1:
            mark[i : i + 3] = b"\1\1\1"
    return sum(mark)


def text_counts(text: str) -> tuple:
    """The counts of one text, in the order of _COUNTS; a word is a run of other characters than six white-space ones."""
    raw = text.encode()
    words = raw.split()
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.encode().split():
            lines += 1
            dup += line in seen
            seen.add(line)
    data = np.frombuffer(raw, np.uint8)
    upper = int(np.count_nonzero((data >= 65) & (data <= 90)))
    lower = int(np.count_nonzero((data >= 97) & (data <= 122)))
    blank = sum(text.count(c) for c in "\t\n\x0b\x0c\r ")
    return len(words), len(text) - blank, sum(text.count(c) for c in _SYMBOLS), dup, repeated_words(words), lines, text.count("!"), upper, upper + lower


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [text_counts(t.as_py() or "") for t in b.column("text")]
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _COUNTS]
        keep = b.schema.names[:-1]
        made = batch(columns, _ARROW)
        yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + made.columns, names=keep + list(_COUNTS))


def measured(docs: DataFrame) -> DataFrame:
    """k, doc_id, stratum, x (a hash of the text) and the counts of each document."""
    lean = docs.select(id_key("doc_id").alias("k"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), F.xxhash64(F.col("text").cast("string")).alias("x"), F.col("text").cast("string").alias("text"))
    return lean.mapInArrow(tidy(_count), "k long, doc_id long, stratum string, x long, " + ", ".join(f"{c} long" for c in _COUNTS))


def _rates() -> dict:
    per = lambda a, b: F.least(F.lit(1.0), F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return {"symbol_rate": per("n_symbols", "n_words"), "shout_rate": per("n_shouts", "n_words"), "dup_line_rate": per("n_dup_lines", "n_lines"), "repeat_rate": per("n_repeat_words", "n_words"), "upper_rate": per("n_upper", "n_ascii_letters")}


def binomial_tail(x: int, n: int, p: float) -> float:
    """P(X <= x) of n trials with probability p: the incomplete beta function I(1 - p; n - x, x + 1), by its continued fraction."""
    a, b, at = n - x, x + 1, 1 - p
    swap = at > (a + 1) / (a + b + 2)  # the fraction converges fast on one side
    if swap:
        a, b, at = b, a, 1 - at
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(at) + b * math.log1p(-at)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * at / (a + 1), 1e-300)
    value = d
    for m in range(1, 200_000):
        for t in (m * (b - m) * at / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * at / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + t * d or 1e-300), 1 + t / c or 1e-300
            value *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * value if swap else front * value


def upper_bound(rejected: int, n: int, error: float) -> float:
    """Clopper-Pearson: the rate p at which `rejected` or fewer of n happen with probability `error`."""
    if n == 0 or rejected >= n:
        return 1.0
    low, high = rejected / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if not 0 < mid < 1:
            break
        low, high = (mid, high) if binomial_tail(rejected, n, mid) > error else (low, mid)
    return high


def _path() -> Generator[list[int], tuple[np.ndarray, np.ndarray], list[tuple[int, ...]]]:
    """Cutoffs of all rules (in GRID parts) at each step. Yields the cutoffs so far and is sent histograms: of the good and of
    the bad documents that no rule rejects at these, how many have each bin of each rule (RULES x bins).

    A text of bin b is rejected by a cutoff under b. Each move lowers one rule's cutoff to where the share of bad documents
    newly rejected exceeds PRICE times that of good ones the most (the loosest such cutoff), and is made in STOPS steps.
    """
    now, out = [GRID] * len(RULES), []
    good, bad = yield now
    n_good, n_bad = max(1, int(good[0].sum())), max(1, int(bad[0].sum()))
    while True:
        best = (LEAST_GAIN, None, None)
        for r in range(len(RULES)):
            over = lambda h: np.append(np.cumsum(h[r][::-1])[::-1][1:], 0)  # noqa: B023, E731
            gain = (over(bad) / n_bad - PRICE * over(good) / n_good)[: now[r]]
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), r, int(np.flatnonzero(gain >= SHARE * gain.max())[-1]))
        if best[1] is None:
            return list(dict.fromkeys(out))
        _, r, to = best
        for stop in sorted({now[r] - round((now[r] - to) * i / STOPS) for i in range(1, STOPS + 1)}, reverse=True):
            out.append((*now[:r], stop, *now[r + 1 :]))
        now[r] = to
        good, bad = yield now


def _greedy(n: int, histograms: Callable[[dict[int, list[int]]], dict[int, tuple[np.ndarray, np.ndarray]]]) -> list[list[tuple[int, ...]]]:
    """n paths, a move of all that are unfinished at a time. histograms: those of each of these, by its number and cutoffs."""
    paths, out = [_path() for _ in range(n)], [[] for _ in range(n)]
    now = {i: next(p) for i, p in enumerate(paths)}
    while now:
        found = histograms(now)
        for i in list(now):
            try:
                now[i] = paths[i].send(found[i])
            except StopIteration as end:
                out[i] = end.value
                del now[i]
    return out


def cutoff_path(bins: np.ndarray, good: np.ndarray) -> list[tuple[int, ...]]:
    """The path from documents' bins (rows x RULES) and labels in memory."""
    def histograms(now: dict[int, list[int]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        left = (bins <= now[0]).all(axis=1)
        return {0: tuple(np.array([np.bincount(bins[left & which, r], minlength=GRID + 1) for r in range(len(RULES))]) for which in (good, ~good))}

    return _greedy(1, histograms)[0]


def counted_paths(counts: DataFrame, parts: int) -> list[list[tuple[int, ...]]]:
    """The path of each part, from a table of good, part, the bins (RULES) and n, how many documents have them: bad documents
    count in all paths, good ones in that of their part. One aggregation makes a move of all paths.

    What comes together on the driver are the histograms, 2 x RULES x bins numbers a path however many documents there are.
    """
    rule = F.explode(F.array(*[F.struct(F.lit(j).alias("rule"), F.col(r).alias("bin")) for j, r in enumerate(RULES)])).alias("b")

    def histograms(now: dict[int, list[int]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        out = {i: np.zeros((2, len(RULES), GRID + 1), np.int64) for i in now}
        left = {i: reduce(lambda a, b: a & b, [F.col(r) <= c for r, c in zip(RULES, cut, strict=True)]) for i, cut in now.items()}
        path = F.explode(F.array_compact(F.array(*[F.when(left[i] & (~F.col("good") | (F.col("part") == i)), F.lit(i)) for i in now]))).alias("path")
        for x in counts.select("good", "n", path, *RULES).select("good", "n", "path", rule).groupBy("path", "good", "b.rule", "b.bin").agg(F.sum("n").alias("n")).collect():
            out[x.path][0 if x.good else 1, x.rule, x.bin] = x.n
        return {i: (h[0], h[1]) for i, h in out.items()}

    return _greedy(parts, histograms)


def counted_path(counts: DataFrame) -> list[tuple[int, ...]]:
    """The one path from a table of good, the bins (RULES) and n."""
    return counted_paths(counts.withColumn("part", F.lit(0)), 1)[0]


def large_enough(sizes: dict[str, int], risk: float, error: float) -> dict[str, float]:
    """The error probability of each stratum that could pass a step with it: the most strata that can, the largest first."""
    out: list[str] = []
    for s in sorted(sizes, key=lambda s: (-sizes[s], s)):
        if (1 - risk) ** sizes[s] > error / (len(out) + 1):
            break
        out.append(s)
    return {s: error / len(out) for s in out}


def _followed(rejected: np.ndarray, size: int, risk: float, error: float) -> int:
    """How many steps a stratum of so many good documents follows."""
    for i, total in enumerate(np.cumsum(rejected).tolist()):
        if total > risk * size or upper_bound(int(total), size, error) > risk:
            return i
    return len(rejected)


def steps_followed(rejected: dict[str, np.ndarray], sizes: dict[str, int], risk: float = RISK, error: float = ERROR) -> dict[str, int]:
    """How many steps of the path each stratum follows; rejected: good documents of the holdout rejected first at each step."""
    shares = large_enough(sizes, risk, error)
    return {s: _followed(rejected[s], n, risk, shares[s]) if s in shares else 0 for s, n in sizes.items()}


def loosest_cutoffs(paths: list[list[tuple[int, ...]]], rejected: dict[str, list[np.ndarray]], risk: float = RISK, error: float = ERROR) -> dict[str, tuple[float, ...]]:
    """Of each stratum that rejects anything, each rule's loosest cutoff among those of the paths, as far as it follows them.

    rejected: by stratum and path, good documents of the path's holdout that are rejected first at each step, and those at none.
    A path whose holdout is too small to pass has no say; sizes alone decide that.
    """
    out = {}
    for s, share in large_enough({s: max(int(x.sum()) for x in of) for s, of in rejected.items()}, risk, error).items():
        cuts = []
        for path, x in zip(paths, rejected[s], strict=True):
            size = int(x.sum())
            if (1 - risk) ** size <= share:
                n = _followed(x[:-1], size, risk, share)
                cuts.append(path[n - 1] if n else (GRID,) * len(RULES))
        cut = tuple(max(c) / GRID for c in zip(*cuts, strict=True))
        if min(cut) < 1:
            out[s] = cut
    return out


def _bin(rate: str):
    return F.ceil(F.col(rate) * GRID - 1e-9).cast("int")


def fitted_cutoffs(measures: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> dict[str, tuple[float, ...]]:
    """Cutoffs of each stratum, in the order of RULES, from all labelled documents that pass the base filter.

    Every one of them counts: the bad ones in each path, the good ones in the path of their part and in the holdouts of all
    others. They are counted once by stratum, label, part and bins; paths and holdouts read these counts.
    """
    prepare(measures.sparkSession)
    judged = F.min((F.col("quality") == 1).cast("int"))  # of several labels of a document the worst counts
    known = labels.filter("quality IS NOT NULL").groupBy(id_key("doc_id").alias("k")).agg((judged == 1).alias("good"))
    held = measures.filter(~base_failed()).join(known, "k").dropDuplicates(["k", "x"]).withColumns(_rates())
    held = held.select("stratum", "good", *[_bin(r).alias(r) for r in RULES], F.pmod(F.xxhash64("k", F.lit(23)), F.lit(PARTS)).cast("int").alias("part"))
    held = held.groupBy("stratum", "good", "part", *RULES).agg(F.count("*").alias("n")).checkpoint()
    paths = counted_paths(held, PARTS)

    def first(path: list[tuple[int, ...]]) -> Column:
        """The first step that rejects a document: the least, over the rules, of the first step whose cutoff is under its bin."""
        return F.least(*[F.element_at(F.array(*[F.lit(next((t for t, c in enumerate(path) if c[j] < b), len(path))) for b in range(GRID + 1)]), F.col(r) + 1) for j, r in enumerate(RULES)])

    steps = F.explode(F.array_compact(F.array(*[F.when(F.col("part") != i, F.struct(F.lit(i).alias("path"), first(p).alias("step"))) for i, p in enumerate(paths)]))).alias("b")
    counted = held.filter("good").select("stratum", "n", steps).groupBy("stratum", "b.path", "b.step").agg(F.sum("n").alias("n"))
    found: dict[str, list[np.ndarray]] = {}
    for row in counted.limit(MAX_STRATA * sum(len(p) + 1 for p in paths) + 1).collect():
        found.setdefault(row.stratum, [np.zeros(len(p) + 1, np.int64) for p in paths])[row.path][row.step] += row.n
    if len(found) > MAX_STRATA:
        raise ValueError(f"more than {MAX_STRATA} strata")
    return loosest_cutoffs(paths, found, risk, error)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def judged(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, broken rules.

    The stratum is `lang` (null: a stratum of its own); strata without enough labelled good documents only have the base
    filter. A null text has no words and fails the base filter. Rows with equal doc_id are judged each by its own text; a
    label of a doc_id counts for each of them. Labels that are null, or absent as a table's rows, count for nothing. Empty
    tables give empty results; other columns are ignored. More than MAX_STRATA strata with labelled documents are an error.
    """
    spark = prepare(docs.sparkSession)
    measures = measured(docs).checkpoint()
    cutoffs = fitted_cutoffs(measures, labels, risk, error)
    limits = spark.createDataFrame([(s, *c) for s, c in cutoffs.items()], "stratum string, " + ", ".join(f"cut_{r} double" for r in RULES))
    rated = measures.join(F.broadcast(limits), "stratum", "left").withColumns(_rates())
    broken = F.array_compact(F.array(*[F.when(F.col(r) > F.coalesce(F.col(f"cut_{r}"), F.lit(1.0)) + 1e-9, F.lit(r)) for r in RULES]))
    failed = rated.withColumns({"base_failed": base_failed(), "broken": broken})
    return failed.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def quality_report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return judged(docs, labels, **options).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "broken")


def good_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are kept, all columns and repeated rows."""
    k, x, s = own = unused(docs, 3)
    keep = judged(docs, labels, **options).filter("kept").select(F.col("k").alias(k), F.col("x").alias(x), F.col("stratum").alias(s))
    keyed = docs.withColumns({k: id_key("doc_id"), x: F.xxhash64(F.col("text").cast("string")), s: F.coalesce(F.col("lang").cast("string"), F.lit(""))})
    return keyed.join(keep, own, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
