"""Dependency-annotated corpora: CoNLL-U parsing, links between tokens, the syntactic profile, and writing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.rows import exploded

FIELDS = ("id", "word", "lemma", "upos", "xpos", "feats", "dephead", "deprel", "deps", "misc")


def parse_sentences(df: DataFrame, entry: str | Column, text: str) -> DataFrame:
    """entry_id, sent_no, sent_key, metadata (map), lines (token lines), raw. An empty line ends a sentence.

    The key is sent_id, else id, else text of the `# key = value` comments; the last of equal comment keys counts, and a
    sentence without any of them is left out.
    """
    cut = F.transform(F.split(F.regexp_replace(F.col(text), "\r\n", "\n"), "\\n[ \\t]*\\n+"), lambda b: F.btrim(b, F.lit("\n")))
    blocks = F.filter(cut, lambda b: F.trim(b) != "")
    raw = exploded(df, [(F.col(entry) if isinstance(entry, str) else entry).alias("entry_id")], blocks, "raw", "sent_no")
    lines = F.filter(F.split("raw", "\n"), lambda x: F.trim(x) != "")
    comments = F.filter(lines, lambda x: x.startswith("# ") & x.contains(" = "))
    pairs = F.transform(comments, lambda x: F.struct(F.regexp_extract(x, "^# (.*?) = ", 1).alias("key"), F.regexp_extract(x, "^# .*? = (.*)$", 1).alias("value")))
    meta = F.map_from_entries(_last_of_each(pairs))
    out = raw.withColumns({"metadata": meta, "lines": F.filter(lines, lambda x: ~x.startswith("# ") & x.contains("\t"))})
    name = F.coalesce(*[F.try_element_at("metadata", F.lit(k)) for k in ("sent_id", "id", "text")])
    return out.withColumn("sent_key", name).filter("sent_key <> ''")


def _last_of_each(pairs: Column) -> Column:
    return F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.lit(0), F.size(pairs) - i - 1)), lambda q: q["key"] == p["key"]))


def last_of_each_sentence(sentences: DataFrame) -> DataFrame:
    """Of an entry's sentences with equal keys the last content, at the place of the first."""
    by = Window.partitionBy("entry_id", "sent_key")
    out = sentences.withColumns({"_last": F.max("sent_no").over(by), "_first": F.min("sent_no").over(by)}).filter("sent_no = _last")
    return out.withColumn("sent_no", F.col("_first")).drop("_first", "_last")


def sentence(sentences: DataFrame, sent_id: str) -> DataFrame:
    """The sentence of this id."""
    return sentences.filter(F.col("sent_key") == sent_id)


def matching(sentences: DataFrame, raw: str, keywords: list[str] | None = None, any_of: list[str] | None = None) -> DataFrame:
    """Adds built: whether the sentence matches. With keywords: a literal of any_of, or all keyword patterns; without: any
    pattern of any_of. No list at all matches everything. Sentences that do not match stay, unbuilt."""
    c = F.col(raw)
    if keywords:
        literal = F.lit(False)
        for k in any_of or ():
            literal = literal | c.contains(k)
        every = F.lit(True)
        for k in keywords:
            every = every & c.rlike(k)
        return sentences.withColumn("built", literal | every)
    built = F.lit(not any_of)
    for k in any_of or ():
        built = built | c.rlike(k)
    return sentences.withColumn("built", built)


def tokens(sentences: DataFrame) -> DataFrame:
    """entry_id, sent_key, sent_no, pos and the ten fields of each token line; missing fields are `_`."""
    rows = exploded(sentences, ["entry_id", "sent_key", "sent_no"], "lines", "_l", "pos")
    parts = F.split("_l", "\t")
    return rows.select("entry_id", "sent_key", "sent_no", "pos", *[F.coalesce(F.get(parts, F.lit(i)), F.lit("_")).alias(f) for i, f in enumerate(FIELDS)])


def attributes(c: Column) -> Column:
    """`k=v|k=v` as a map with lower-case keys; the value is what stands between the first and a second `=`."""
    parts = F.filter(F.split(c, "\\|"), lambda p: p.contains("="))
    pairs = F.transform(parts, lambda p: F.struct(F.lower(F.split(p, "=")[0]).alias("key"), F.split(p, "=")[1].alias("value")))
    return F.map_from_entries(_last_of_each(pairs))


def with_head(tok: DataFrame, keys: list[str]) -> DataFrame:
    """Adds head_id and head_upos; a missing or root head is id 0 and `_`. Marks in <> do not count in ids; (keys, id) is unique."""
    plain = lambda c: F.regexp_replace(F.col(c).cast("string"), "<.*?>", "")
    head = tok.select(*keys, plain("id").alias("_h"), F.col("upos").alias("head_upos"))
    out = tok.withColumn("_h", plain("dephead")).join(head, [*keys, "_h"], "left")
    return out.withColumns({"head_id": F.when(F.col("head_upos").isNotNull(), F.col("_h")).otherwise("0"), "head_upos": F.coalesce("head_upos", F.lit("_"))}).drop("_h")


def with_neighbours(tok: DataFrame, keys: list[str]) -> DataFrame:
    """Adds next_word and previous_word: of the token whose id is one more or less; ranges like 3-4 are no neighbours."""
    number = F.when(F.col("id").cast("string").rlike("^[0-9]+$"), F.col("id").cast("int"))
    there = tok.withColumn("_n", number)
    by = Window.partitionBy(*keys, F.col("_n").isNull()).orderBy("_n")
    pick = lambda f, step: F.when(f("_n").over(by) == F.col("_n") + step, f("word").over(by))
    return there.withColumns({"next_word": pick(F.lead, 1), "previous_word": pick(F.lag, -1)}).drop("_n")


def inverted_index(tok: DataFrame, keys: list[str], block: int = 10_000, salts: int = 64, fields: Sequence[str] = FIELDS) -> DataFrame:
    """field, value, block, n and places (keys, pos, in order) for the values of these fields of integer-id tokens.

    A value's places are dealt by a hash of their sentence and cut into blocks of at most `block`, so no row and no task
    holds all places of a frequent value.
    """
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields if f in tok.columns]))
    rows = tok.filter(F.col("id").cast("string").rlike("^[0-9]+$")).select(F.struct(*keys, "pos").alias("place"), F.pmod(F.xxhash64(*keys), F.lit(salts)).alias("salt"), fields.alias("f"))
    rows = rows.select("place", "salt", "f.field", "f.value")
    at = F.row_number().over(Window.partitionBy("field", "value", "salt").orderBy("place")) - 1
    cut = rows.withColumn("part", F.floor(at / block))
    # salt and part are keys of their own: the places already lie together by field, value and salt, so they are not dealt again
    blocks = cut.groupBy("field", "value", "salt", "part").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("place")).alias("places"))
    return blocks.select("field", "value", F.concat_ws("-", F.col("salt").cast("string"), F.col("part").cast("string")).alias("block"), "n", "places")


def profile(tok: DataFrame, entries: int | Column, keys: list[str]) -> DataFrame:
    """The 21 measures in one row, from tokens with head_id and head_upos; one aggregation.

    Tokens of range ids (3-4) do not count. A denominator that is missing counts as 1 where the published formulas say so.
    """
    t = tok.filter(~F.col("id").cast("string").contains("-"))
    n = F.count_if
    up, rel, head = F.col("upos"), F.col("deprel"), F.col("head_upos")
    at, head_at = F.col("id").cast("int"), F.col("head_id").cast("int")
    counts = {
        "tokens": F.count("*"), "sentences": F.countDistinct(F.struct(*keys)), "types": F.countDistinct(F.lower("word")), "lemmas": F.countDistinct(F.lower("lemma")),
        "commas": n(F.col("lemma") == ","), "clauses": n((up == "VERB") | ((up == "AUX") & (head != "VERB"))),
        "verb": n(up == "VERB"), "noun": n(up == "NOUN"), "adj": n(up == "ADJ"), "adv": n(up == "ADV"),
        "post": n((rel == "nsubj") & (at > head_at)), "pre": n((rel == "nsubj") & (at < head_at)),
        "passive": n(F.col("feats").contains("Voice=Pass")), "xcomp": n((rel == "xcomp") & (head == "VERB")),
        "advcl": n(rel == "advcl"), "advcl_left": n((rel == "advcl") & (at < head_at)), "advcl_right": n((rel == "advcl") & (at > head_at)),
        "relcl": n(rel == "acl:relcl"), "acl": n(rel == "acl"), "ccomp": n(rel == "ccomp"),
        "conj_verb": n((rel == "conj") & (head == "VERB")), "conj_other": n((rel == "conj") & (head != "VERB")),
    }
    c = t.agg(*[v.alias(k) for k, v in counts.items()]).withColumn("entries", entries if isinstance(entries, Column) else F.lit(entries))
    or_one = lambda k: F.when(F.col(k) == 0, 1).otherwise(F.col(k))
    per = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b) if isinstance(b, str) else b)
    return c.select(
        F.col("tokens").alias("m01_tokens"), F.col("sentences").alias("m02_sentences"), F.col("entries").cast("long").alias("m03_entries"),
        per("tokens", "sentences").alias("m04_tokens_per_sentence"), per("types", "tokens").alias("m05_type_token_ratio"), per("lemmas", "tokens").alias("m06_lemma_token_ratio"),
        per("commas", "tokens").alias("m07_commas_per_token"), per("clauses", "sentences").alias("m08_clauses_per_sentence"), per("sentences", "entries").alias("m09_sentences_per_entry"),
        per("verb", or_one("noun")).alias("m10_verb_noun"), per("adj", or_one("noun")).alias("m11_adj_noun"), per("adv", or_one("verb")).alias("m12_adv_verb"),
        per("post", or_one("pre")).alias("m13_post_pre_subjects"), per("passive", F.col("tokens") - F.col("passive")).alias("m14_passive_active"), per("xcomp", F.col("verb") - F.col("xcomp")).alias("m15_xcomp_simple_verbs"),
        per("advcl", "clauses").alias("m16_advcl_per_clause"), per("advcl_left", or_one("advcl_right")).alias("m17_advcl_left_right"), per("relcl", or_one("acl")).alias("m18_developed_reduced_relatives"),
        per("ccomp", "clauses").alias("m19_ccomp_per_clause"), per("conj_verb", "clauses").alias("m20_clausal_coordination"), per("conj_other", "clauses").alias("m21_nominal_coordination"),
    )


def token_line() -> Column:
    return F.concat_ws("\t", *[F.col(f).cast("string") for f in FIELDS])


def renumbered(sentences: DataFrame, order: list[str], block: int = 10_000) -> DataFrame:
    """Adds new_sent_id = 1, 2, ... over all entries, in the order of entry and number: the last column of order is a whole
    number, and sentences are numbered inside blocks of so many numbers.

    Blocks are counted and added up inside an entry, and entries over all, so neither an entry nor the table is ever in one
    task: what is summed has a row for each block of an entry, or for each entry.
    """
    entry, rest = order[0], order[1:]
    places = sentences.withColumn("_k", F.floor(F.col(rest[-1]) / block))
    so_far = lambda w: F.coalesce(F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = places.groupBy(entry, "_k").count()
    entries = blocks.groupBy(entry).agg(F.sum("count").alias("count")).select(F.col(entry), so_far(Window.orderBy(entry)).alias("_e"))
    starts = blocks.select(entry, "_k", so_far(Window.partitionBy(entry).orderBy("_k")).alias("_b")).join(entries, entry)
    starts = starts.select(F.col(entry).alias("_entry"), F.col("_k").alias("_block"), (F.col("_b") + F.col("_e")).alias("_b"))
    inside = Window.partitionBy(entry, "_k").orderBy(*rest)
    numbered = places.withColumn("_n", F.row_number().over(inside))
    joined = numbered.join(starts, numbered[entry].eqNullSafe(F.col("_entry")) & numbered["_k"].eqNullSafe(F.col("_block")))
    return joined.withColumn("new_sent_id", (F.col("_n") + F.col("_b")).cast("long")).drop("_n", "_b", "_k", "_entry", "_block")


def serialised(sentences: DataFrame, corpus: str) -> DataFrame:
    """entry_id, new_sent_id, value: each sentence as CoNLL-U text with its new id and the corpus named."""
    rest = F.filter(F.transform(F.map_entries("metadata"), lambda e: F.when(~e["key"].isin("sent_id", "corpus"), F.concat(F.lit("# "), e["key"], F.lit(" = "), e["value"]))), lambda x: x.isNotNull())
    head = F.array(F.concat(F.lit("# sent_id = "), F.col("new_sent_id")), F.lit(f"# corpus = {corpus}"))
    return sentences.select("entry_id", "new_sent_id", F.concat(F.array_join(F.concat(head, rest, F.col("lines")), "\n"), F.lit("\n")).alias("value"))
