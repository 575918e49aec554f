"""Column expressions for text statistics, cleaning and leaflet slicing.

Everything is built-in Spark functions, so it stays in code generation. Unicode white space, letters and accents are
spelled out, because the JVM's `\\s`, `\\w` and trim() are ASCII only. Null in gives null out unless said otherwise.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .rows import bound

#: What strips and splits as white space (no brackets), and the class of word characters.
BLANKS = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS = f"[{BLANKS}]"
WORD = r"[\p{L}\p{N}_]"
#: The characters of BLANKS one by one.
BLANK_CHARACTERS = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Vowels of a syllable, readability constants and bands.
VOWELS = "[aeiouáéíóúâêôãõàü]"
FLESCH = (248.835, 1.015, 84.6)
BANDS = ((75, "Muito fácil (nível fundamental)"), (50, "Médio (nível médio)"), (25, "Difícil (nível superior)"))
LAST_BAND = "Muito difícil (pós-graduação / textos técnicos)"
#: Abbreviations whose dot ends no sentence.
ABBREVIATIONS = ("Art", "art", "Dr", "Dra", "Inc", "Par", "n", "nº", "n.º", "al")


def accent_table(form: str) -> tuple[str, str, list[tuple[str, str]]]:
    """Characters below U+2200 that lose a mark: one-to-one pairs for translate, and the ones that become several."""
    single, several = [], []
    for i in range(0xA0, 0x2200):
        c = chr(i)
        bare = "".join(x for x in unicodedata.normalize(form, c) if unicodedata.category(x) != "Mn")
        if bare != c and len(bare) == 1:
            single.append((c, bare))
        elif bare != c and len(bare) > 1:
            several.append((c, bare))
    return "".join(a for a, _ in single), "".join(b for _, b in single), several


def strip_ws(c: Column) -> Column:
    """White space off both ends; looks at the ends only."""
    return F.btrim(c, F.lit(BLANK_CHARACTERS))


def strip_start(c: Column) -> Column:
    return F.ltrim(c, F.lit(BLANK_CHARACTERS))


def strip_end(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANK_CHARACTERS))


def blank(c: Column) -> Column:
    """Null or only white space."""
    return F.coalesce(strip_ws(c) == "", F.lit(True))


def filled(c: Column) -> Column:
    return ~blank(c)


def clean(c: Column) -> Column:
    """A stripped string; null is empty."""
    return F.coalesce(strip_ws(c.cast("string")), F.lit(""))


def tokens(c: Column) -> Column:
    """White-space tokens with their punctuation."""
    return F.filter(F.split(c, f"{WS}+"), lambda t: t != "")


def token_count(c: Column) -> Column:
    return F.size(tokens(F.coalesce(c, F.lit(""))))


def syllables(c: Column) -> Column:
    return F.regexp_count(F.lower(c), F.lit(VOWELS))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"{WORD}+"))


def sentences(c: Column, abbreviations: tuple[str, ...] = ABBREVIATIONS) -> Column:
    """Sentences: a break follows `.`, `!` or `?`, at most one closing mark, and white space, but no abbreviation's dot."""
    s = strip_ws(c)
    if abbreviations:
        names = "|".join(a.replace(".", r"\.") for a in abbreviations)
        s = F.regexp_replace(s, rf"(^|[^\p{{L}}\p{{N}}_])({names})\.", "$1$2\u0002")
    s = F.regexp_replace(s, rf"([.!?][”’)\]\"]?){WS}+", "$1\u0001")
    return F.filter(F.transform(F.split(s, "\u0001"), lambda x: strip_ws(F.translate(x, "\u0002", "."))), lambda x: x != "")


def sentence_count(c: Column, abbreviations: tuple[str, ...] = ABBREVIATIONS) -> Column:
    """How many sentences there are: breaks that more than white space follows, and one; no array is built."""
    names = "|".join(a.replace(".", r"\.") for a in abbreviations)
    s = F.regexp_replace(c, rf"(^|[^\p{{L}}\p{{N}}_])({names})\.", "$1$2\u0002") if abbreviations else c
    breaks = F.regexp_count(s, F.lit(rf"[.!?][”’)\]\"]?{WS}++(?!\z)"))
    return F.when(c.rlike(f"[^{BLANKS}]"), breaks + 1).otherwise(0)


def flesch(c: Column, digits: int | None = 2) -> Column:
    """Portuguese reading ease; digits None leaves it unrounded."""
    score = flesch_of(word_count(c), syllables(c), sentence_count(c))
    return score if digits is None else F.round(score, digits)


def flesch_of(words: Column, n_syllables: Column, n_sentences: Column) -> Column:
    a, b, d = FLESCH
    return F.lit(a) - F.lit(b) * (words / F.greatest(F.lit(1), n_sentences)) - F.lit(d) * (n_syllables / F.greatest(F.lit(1), words))


def with_flesch(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the unrounded reading ease; the counts are columns of their own, so each is made once for a row."""
    c = F.col(f"`{column}`")
    counted = df.withColumns({"_w": word_count(c), "_y": syllables(c), "_s": sentence_count(c)})
    return counted.withColumn(name, flesch_of(F.col("_w"), F.col("_y"), F.col("_s"))).drop("_w", "_y", "_s")


def flesch_band(score: Column) -> Column:
    return reduce(lambda w, b: w.when(score >= b[0], b[1]), BANDS[1:], F.when(score >= BANDS[0][0], BANDS[0][1])).otherwise(LAST_BAND)


def strip_accents(c: Column, form: str = "NFD") -> Column:
    """Marks removed: of composed letters by table (form NFD or NFKD), of others by class."""
    old, new, several = accent_table(form)
    c = F.translate(c, old, new)
    for a, b in several if form == "NFKD" else ():
        if ord(a) < 0x180 or 0x2000 <= ord(a):  # Latin and signs; the rest has no accents in these texts
            c = F.replace(c, F.lit(a), F.lit(b))
    if form == "NFKD":
        for a, b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
            c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(c, r"\p{Mn}", "")


def lexical_diversity(c: Column) -> Column:
    """How many different words of a-z remain after lower case and accent removal."""
    bare = F.regexp_replace(strip_accents(F.lower(F.coalesce(c, F.lit("")))), "[^a-z]+", " ")
    return F.size(F.array_distinct(F.filter(F.split(bare, " "), lambda w: w != "")))


def letter_word_count(c: Column) -> Column:
    """Words of Latin letters and hyphens; a hyphen alone is none. Null and blank give 0."""
    s = F.translate(F.coalesce(c, F.lit("")), "–—−‑", "----")
    return F.size(F.filter(F.split(F.regexp_replace(s, "[^A-Za-zÀ-ÿ-]+", " "), " "), lambda w: (w != "") & (w != "-")))


def letter_count(c: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-zÀ-ÿ]", ""))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(a.cast("double"), b)


def medicine_name(c: Column) -> Column:
    """The part before `__`, stripped, in upper case, without accents."""
    return strip_accents(F.upper(strip_ws(F.split_part(c, F.lit("__"), F.lit(1)))), "NFKD")


def normalize_for_match(c: Column, nbsp: bool = False) -> Column:
    """Soft hyphens and accents out, upper case, blanks collapsed; nbsp: no-break spaces count as blanks."""
    s = F.upper(strip_accents(F.replace(c, F.lit("­"), F.lit(""))))
    s = F.translate(s, " ", " ") if nbsp else s
    return F.regexp_replace(s, "[ \\t]+", " ")


def normalize_text_for_match(c: Column) -> Column:
    """Upper case without accents, with one name for product and medicine. Null gives an empty string."""
    s = F.upper(strip_accents(F.coalesce(c, F.lit("")), "NFKD"))
    for a in ("ESSE MEDICAMENTO", "ESSE PRODUTO", "ESTE PRODUTO"):
        s = F.replace(s, F.lit(a), F.lit("ESTE MEDICAMENTO"))
    return F.regexp_replace(s, "[ \\t]+", " ")


def join_lines(c: Column, nbsp: bool = False) -> Column:
    """Words hyphenated at a line end joined, blanks before line ends and surplus empty lines out, stripped."""
    s = F.replace(c, F.lit("­"), F.lit(""))
    s = F.translate(s, " ", " ") if nbsp else s
    s = F.regexp_replace(s, rf"({WORD})-\n({WORD})", "$1$2")
    s = F.regexp_replace(s, "[ \\t]+\\n", "\n")
    return strip_ws(F.regexp_replace(s, "\\n{3,}", "\n\n"))


#: Borders of the patient section; E stands for E or É.
START_1 = r"1{WS}*[.\-–—)]?{WS}*PARA{WS}+QUE{WS}+ESTE{WS}+MEDICAMENTO{WS}+{E}{WS}+INDICADO{WS}*\??"
END_1 = r"III{WS}*[-–—]{WS}*DIZERES{WS}+LEGAIS"
END_1_FALLBACK = r"EM{WS}+CASO{WS}+DE{WS}+USO{WS}+DE{WS}+GRANDE{WS}+QUANTIDADE"
START_2 = r"(?:1{WS}*[.\-–—)]?{WS}*)?PARA{WS}+QUE{WS}+(?:ESTE|ESSE){WS}+(?:MEDICAMENTO|PRODUTO){WS}+(?:{E}|FOI){WS}+INDICADO{WS}*\??"
END_2 = r"DIZERES{WS}+LEGAIS"


def _border(pattern: str, accent: bool) -> str:
    return pattern.replace("{WS}", WS).replace("{E}", "[EÉeé]" if accent else "E")


def _find(c: Column, pattern: str, line_start: bool) -> Column:
    """1-based position of the first match (of the line break before it), 0 if there is none."""
    before = f"(^|[\\n\\r]){WS}*" if line_start else r"(^|[^\p{L}\p{N}_])"
    after = "" if line_start else r"($|[^\p{L}\p{N}_])"
    whole = F.regexp_instr(c, F.lit(f"(?i){before}{pattern}{after}"))
    if line_start:
        return whole
    lead = F.length(F.regexp_extract(c, f"(?i){before}{pattern}{after}", 1))
    return F.when(whole > 0, whole + lead).otherwise(0)


def patient_section(c: Column, version: int = 1, min_chars: int = 500) -> Column:
    """The patient section of a leaflet's text, cleaned; null if its borders are missing or it is shorter than min_chars.

    Whether the borders are there is decided on the normalised text (the end after the start), where they are on the
    original. Version 1: numbered start, end at the legal notice or else the overdose phrase; version 2: number optional.
    """
    start, ends = (START_1, (END_1, END_1_FALLBACK)) if version == 1 else (START_2, (END_2,))
    norm = normalize_for_match(c, nbsp=version == 2)
    first = F.regexp_instr(norm, F.lit(f"(?i)(^|[\\n\\r]){WS}*{_border(start, False)}"))
    head = F.regexp_extract(norm, f"(?i)(^|[\\n\\r]){WS}*{_border(start, False)}", 0)
    tail = F.substr(norm, first + F.length(head))
    ends_there = reduce(lambda a, b: a | b, [_find(tail, _border(e, False), False) > 0 for e in ends])
    found = _find(c, _border(start, True), True)
    cut = F.substr(c, F.when(found > 0, found).otherwise(first if version == 1 else F.lit(1)))
    stop = reduce(lambda a, b: F.when(a > 0, a).otherwise(b), [_find(cut, _border(e, False), False) for e in ends])
    text = F.when(stop > 0, F.substr(cut, F.lit(1), stop - 1))
    section = join_lines(text.otherwise(cut) if version == 1 else text, nbsp=version == 2)
    fits = (F.length(strip_ws(c)) >= 50) & (first > 0) & ends_there & (F.length(section) >= min_chars)
    return F.when(fits, section)


#: Section headings on accent-free upper-case text, and section weights.
SECTION_HEADINGS = {
    "sec_1": r"(?:1\s*[.\-–—)]?\s*)?PARA\s+QUE\s+(?:(?:ESTE\s+(?:MEDICAMENTO|PRODUTO)\s+(?:E|FOI)\s+INDICADO)|(?:SERVE\s+ESTE\s+(?:MEDICAMENTO|PRODUTO)))\??",
    "sec_2": r"(?:2\s*[.\-–—)]?\s*)?COMO\s+ESTE\s+(?:MEDICAMENTO|PRODUTO)\s+FUNCIONA\??",
    "sec_3": r"(?:3\s*[.\-–—)]?\s*)?QUANDO\s+NAO\s+DEVO\s+(?:USAR|UTILIZAR)\s+ESTE\s+(?:MEDICAMENTO|PRODUTO)\??",
    "sec_4": r"(?:4\s*[.\-–—)]?\s*)?O\s+QUE\s+DEVO\s+SABER\s+ANTES\s+DE\s+USAR\s+ESTE\s+(?:MEDICAMENTO|PRODUTO)\??",
    "sec_5": r"(?:5\s*[.\-–—)]?\s*)?(?:(?:ONDE,\s*COMO\s+E\s+POR\s+QUANTO\s+TEMPO\s+POSSO\s+GUARDAR)|(?:COMO\s+GUARDAR))\s+ESTE\s+(?:MEDICAMENTO|PRODUTO)\??",
    "sec_6": r"(?:6\s*[.\-–—)]?\s*)?COMO\s+DEVO\s+USAR\s+ESTE\s+(?:MEDICAMENTO|PRODUTO)\??",
    "sec_7": r"(?:7\s*[.\-–—)]?\s*)?O\s+QUE\s+(?:DEVO\s+)?FAZER\s+(QUANDO|SE)\s+(?:EU\s+)?ME\s+ESQUECER\s+DE\s+USAR\s+ESTE\s+(?:MEDICAMENTO|PRODUTO)\??",
    "sec_8": r"(?:8\s*[.\-–—)]?\s*)?QUAIS\s+OS\s+MALES\s+QUE\s+ESTE\s+(?:MEDICAMENTO|PRODUTO)\s+PODE\s+(?:ME\s+)?CAUSAR\??",
    "sec_9": r"(?:9\s*[.\-–—)]?\s*)?O\s+QUE\s+FAZER\s+SE\s+ALGUEM\s+USAR\s+UMA\s+QUANTIDADE\s+MAIOR\s+DO\s+QUE\s+A\s+INDICADA(?:\s+DESTE\s+(?:MEDICAMENTO|PRODUTO))?\??",
}
SECTION_WEIGHTS = {"sec_1": 0.08, "sec_2": 0.07, "sec_3": 0.16, "sec_4": 0.16, "sec_5": 0.06, "sec_6": 0.18, "sec_7": 0.09, "sec_8": 0.15, "sec_9": 0.05}
def leaflet_form(c: Column) -> Column:
    """The text for heading search, mapped: upper case without accents, with one name for product and medicine."""
    from . import mapping as M

    return M.replacing(M.upper_without_accents(M.plain(c)), ("ESSE MEDICAMENTO", "ESSE PRODUTO", "ESTE PRODUTO"), "ESTE MEDICAMENTO")


def section_spans(c: Column) -> Column:
    """Sections found, by start: array of (start, stop, sec) with 1-based start and end-exclusive stop of the heading.

    Headings are searched in the normalised text; the spans are those of the original, whatever lengths the normal form
    changed before or inside them.
    """
    from . import mapping as M

    def named(sec: str, m: Column) -> Column:
        found = M.first_match(m["text"], SECTION_HEADINGS[sec].replace("\\s", WS))
        return bound(found, lambda a: F.when(a.isNotNull(), F.struct(a["start"].alias("start"), a["stop"].alias("stop"), F.lit(sec).alias("sec"))))

    def spans(m: Column) -> Column:
        there = F.array_compact(F.array(*[named(sec, m) for sec in SECTION_HEADINGS]))
        back = lambda f: bound(M.original_span(m["maps"], f["start"], f["stop"]), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), f["sec"].alias("sec")))
        return F.array_sort(F.transform(there, back))

    return bound(leaflet_form(c), spans)


def with_sections(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds a map of all nine sections to their stripped text; one that is missing is empty. Null and blank texts have none.

    The headings are searched once, in a column of their own that later expressions read.
    """
    staged = df.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).withColumn("_p", section_spans(F.col("_t")))
    after = F.transform("_p", lambda s, i: F.coalesce(F.get("_p", i + 1)["start"], F.length("_t") + 1))
    found = F.zip_with("_p", after, lambda s, e: F.struct(s["sec"].alias("sec"), strip_ws(F.substr(F.col("_t"), s["stop"], e - s["stop"])).alias("text")))
    staged = staged.withColumn("_f", F.map_from_entries(found))
    whole = F.create_map(*[x for sec in SECTION_HEADINGS for x in (F.lit(sec), F.coalesce(F.try_element_at("_f", F.lit(sec)), F.lit("")))])
    return staged.withColumn(out, whole).drop("_t", "_p", "_f")


def _header(words: str, names: str, reach: int) -> str:
    """The first line that only names the simplified text, with an empty line and a rule after it."""
    inside = rf"[^)]{{0,{reach}}}?(?:{names})[^)]{{0,{reach}}}?"
    return rf"(?i)^{WS}*(?:\*{{1,3}}{WS}*)?(?:{words})(?:{WS}+(?:{names})|{WS}*\({inside}\))[^\n]*(?:{WS}*\*{{1,3}})?{WS}*(?:\n[ \t]*\n)?(?:\n[ \t]*[-–—]{{3,}}[ \t]*\n)?{WS}*"


#: Words of the header line in the two forms.
HEADER_A = _header("BULA", "SIMPLIFICADA|SIMPLES|SIMPLIFICADO", 60)
HEADER_B = _header("BULA|TEXTO", "SIMPLIFICADA|SIMPLIFICADO|SIMPLES", 80)


def clean_llm_output(c: Column, form: str = "A") -> Column:
    """Reasoning blocks and tags, the header line and surplus empty lines out; null stays null (A) or is empty (B)."""
    s = F.regexp_replace(c, r"(?is)<think(?:[^A-Za-z0-9_>][^>]*)?>.*?</think>", "")
    s = F.regexp_replace(s, r"(?i)</?think(?:[^A-Za-z0-9_>][^>]*)?>", "")
    s = F.regexp_replace(s, HEADER_A if form == "A" else HEADER_B, "")
    s = strip_ws(F.regexp_replace(s, "\\n{3,}", "\n\n"))
    return s if form == "A" else F.coalesce(s, F.lit(""))


def strip_empty_think(c: Column) -> Column:
    """Without the fixed empty reasoning prefix."""
    prefix = "<think>\n\n</think>\n"
    return F.when(c.startswith(prefix), strip_ws(F.substr(c, F.lit(len(prefix))))).otherwise(c)


def model_file_name(c: Column, most: int = 80) -> Column:
    s = F.regexp_replace(F.regexp_replace(strip_ws(c), r"[^\p{L}\p{N}_\-.]+", "_"), "_+", "_")
    s = F.regexp_replace(F.substr(s, F.lit(1), F.lit(most)), "^_+|_+$", "")
    return F.when(s == "", "model").otherwise(s)


def file_name(c: Column) -> Column:
    """Each character that file systems forbid becomes `_`."""
    return strip_ws(F.translate(c, '<>:"/\\|?*', "_" * 9))


def safe_file_name(c: Column, most: int = 180) -> Column:
    """Runs of forbidden characters become one `_`, blanks one space; null, empty or blank: `sem_nome`."""
    s = strip_ws(F.when(c.isNull() | (c == ""), "sem_nome").otherwise(c))
    s = F.regexp_replace(F.regexp_replace(s, r'[<>:"/\\|?*\n\r\t]+', "_"), f"{WS}+", " ")
    s = strip_ws(F.substr(s, F.lit(1), F.lit(most)))
    return F.when(s == "", "sem_nome").otherwise(s)


def shorten(c: Column, most: int = 800) -> Column:
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.substr(s, F.lit(1), F.lit(most)), F.lit("... [truncado, len="), F.length(s), F.lit("]")))


def parse_cookies(c: Column) -> Column:
    """`k=v; k=v` to a map; parts without `=` are left out, a value keeps later `=`, the last of equal keys counts."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), strip_ws), lambda p: p.contains("="))
    pairs = F.transform(parts, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), F.substr(p, F.instr(p, "=") + 1).alias("v")))
    # equal keys lie side by side, the last of them at the end; what stays goes back to its order
    last = bound(F.sort_array(pairs), lambda s: F.filter(s, lambda p, i: F.coalesce(F.get(s, i + 1)["k"] != p["k"], F.lit(True))))
    ordered = F.sort_array(F.transform(last, lambda p: F.struct(p["i"].alias("i"), p["k"].alias("k"), p["v"].alias("v"))))
    return F.map_from_entries(F.transform(ordered, lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v"))))


def prompt(template: str, **values: Column) -> Column:
    """The template with each {name} replaced by a column."""
    out = F.lit(template)
    for name, c in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c, F.lit("")))
    return out


def windows(items: Column, size: int, overlap: int) -> Column:
    """Arrays of consecutive items; stops with the first window that reaches the end; no items, no windows."""
    if overlap >= size:
        raise ValueError("overlap must be less than size")
    step, n = size - overlap, F.size(items)
    count = F.when(n <= 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / F.lit(step)) + 1).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), count - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(items, i * step + 1, F.lit(size)))


def with_chunks(df: DataFrame, items: Column, out: str, size: int, overlap: int) -> DataFrame:
    """Adds the windows of an array of strings, each joined by spaces; the array is computed once."""
    return df.withColumn("_i", items).withColumn(out, F.transform(windows(F.col("_i"), size, overlap), lambda w: F.array_join(w, " "))).drop("_i")


def with_sentence_chunks(df: DataFrame, text: str, out: str, size: int = 5, overlap: int = 2, abbreviations: tuple[str, ...] = ()) -> DataFrame:
    return with_chunks(df, sentences(F.coalesce(F.col(text), F.lit("")), abbreviations), out, size, overlap)


def with_word_chunks(df: DataFrame, text: str, out: str, size: int = 120, overlap: int = 30) -> DataFrame:
    return with_chunks(df, tokens(F.coalesce(F.col(text), F.lit(""))), out, size, overlap)
