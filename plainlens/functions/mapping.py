"""Normalised text that remembers where it came from: spans found in it slice the original exactly.

A mapped text is a struct of the text and of its maps, the last step's first. A map is an array of pieces in order, each with
its length in the new text, its length in the old one, and whether it is mapped as a whole (`ß` to `SS`, a letter with its
combining marks, a phrase that was replaced) or character by character. Steps compose: a span goes through the maps one after
another. Plain stretches are one piece, so a map is about as long as there are such places, not as the text.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .rows import bound
from .text import accent_table

_PIECE = "struct<new:int,old:int,whole:boolean>"


def _forms() -> tuple[str, str, dict[str, str]]:
    """Characters with a normal form (compatibility-decomposed, without marks, upper case): those with one character, as pairs
    for translate, and the others. Letters and signs below U+2200 and the Latin ligatures decompose; others only change case."""
    old, new, several = accent_table("NFKD")
    single, many = dict(zip(old, new, strict=True)), dict(several)
    many |= {chr(i): unicodedata.normalize("NFKD", chr(i)) for i in range(0xFB00, 0xFB07)}
    for i in range(0x80, 0x10000):
        c = chr(i)
        if 0xD800 <= i < 0xE000 or unicodedata.category(c) == "Mn":
            continue
        upper = many.get(c, single.get(c, c)).upper()
        if len(upper) != 1:
            many[c] = upper
    return old, new, {c: b.upper() for c, b in many.items()}


_OLD, _NEW, _MANY = _forms()
_SPECIAL = "".join(f"\\x{{{ord(c):x}}}" for c in sorted(_MANY))
#: A special character with its marks; a stretch without either; a letter with marks; marks with no letter before them.
_PIECES = rf"[{_SPECIAL}]\p{{Mn}}*|[^{_SPECIAL}\p{{Mn}}]+(?!\p{{Mn}})|[^{_SPECIAL}\p{{Mn}}]\p{{Mn}}+|\p{{Mn}}+"


def _piece(new: Column, old: Column, whole: Column) -> Column:
    return F.struct(F.length(new).alias("new"), F.length(old).alias("old"), whole.alias("whole"))


def plain(c: Column) -> Column:
    """A text as it is, mapped by no step; null is empty."""
    return F.struct(F.coalesce(c, F.lit("")).alias("text"), F.array().cast(f"array<array<{_PIECE}>>").alias("maps"))


def _stepped(mapped: Column, pattern: str, new_of, whole_of) -> Column:
    """One more step: the text is cut by a pattern that matches everywhere, and each piece replaced."""

    def make(m: Column) -> Column:
        pieces = F.transform(F.regexp_extract_all(m["text"], F.lit(pattern), F.lit(0)), lambda p: F.struct(new_of(p).alias("n"), p.alias("o"), whole_of(p).alias("w")))
        cut = lambda x: F.transform(x, lambda p: _piece(p["n"], p["o"], p["w"]))
        return bound(pieces, lambda x: F.struct(F.array_join(F.transform(x, lambda p: p["n"]), "").alias("text"), F.concat(F.array(cut(x)), m["maps"]).alias("maps")))

    return bound(mapped, make)


def upper_without_accents(mapped: Column) -> Column:
    """The normal form: compatibility-decomposed, marks out, upper case, however many characters each of them becomes."""
    forms = F.from_json(F.lit(json.dumps(_MANY)), "map<string,string>")
    bare = lambda p: F.regexp_replace(p, r"\p{Mn}", "")
    special = lambda p: p.rlike(rf"^[{_SPECIAL}]")
    new = lambda p: F.when(special(p), F.try_element_at(forms, bare(p))).otherwise(F.upper(F.translate(bare(p), _OLD, _NEW)))
    return _stepped(mapped, _PIECES, new, lambda p: special(p) | p.rlike(r"\p{Mn}"))


def replacing(mapped: Column, phrases: Sequence[str], to: str) -> Column:
    """Every occurrence of a phrase replaced, from the left, earlier phrases first; its span maps to the phrase as a whole."""
    words = "|".join("\\Q" + p.replace("\\E", "\\E\\\\E\\Q") + "\\E" for p in phrases)
    is_phrase = lambda p: p.isin(*phrases)
    # a stretch ends before the next phrase: lazily, so that no step of the search is a call of its own
    return _stepped(mapped, rf"(?s){words}|.+?(?={words}|\z)", lambda p: F.when(is_phrase(p), F.lit(to)).otherwise(p), is_phrase)


def original_span(maps: Column, start: Column, stop: Column) -> Column:
    """(start, stop) in the original of a span of the last text; 1-based, stop exclusive. Null for an empty span.

    A span that takes part of a piece mapped as a whole takes all of it.
    """

    def through(span: Column, pieces: Column) -> Column:
        zero = F.struct(F.lit(1).alias("n"), F.lit(1).alias("o"), F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b"))

        def step(acc: Column, p: Column) -> Column:
            holds = lambda at: (acc["n"] <= at) & (at < acc["n"] + p["new"])
            a = F.when(holds(span["start"]), F.when(p["whole"], acc["o"]).otherwise(acc["o"] + span["start"] - acc["n"])).otherwise(acc["a"])
            b = F.when(holds(span["stop"] - 1), F.when(p["whole"], acc["o"] + p["old"]).otherwise(acc["o"] + span["stop"] - acc["n"])).otherwise(acc["b"])
            return F.struct((acc["n"] + p["new"]).alias("n"), (acc["o"] + p["old"]).alias("o"), a.alias("a"), b.alias("b"))

        return F.aggregate(pieces, zero, step, lambda acc: F.struct(acc["a"].alias("start"), acc["b"].alias("stop")))

    first = F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"))
    return F.when(start < stop, F.aggregate(maps, first, through))


def first_match(text: Column, pattern: str) -> Column:
    """(start, stop) of a pattern's first match in characters, which regexp_instr does not count where there are pairs of
    surrogates; null if there is none."""
    parts = F.split(text, pattern, 2)
    return bound(parts, lambda p: F.when(F.size(p) == 2, F.struct((F.length(p[0]) + 1).alias("start"), (F.length(text) - F.length(p[1]) + 1).alias("stop"))))
