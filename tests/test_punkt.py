import math
import random
from collections import Counter, defaultdict

import regex
from pyspark.sql import functions as F

from plainlens.functions.text import BLANK_CHARACTERS
from plainlens.operators import punkt

WS = "[" + regex.escape(BLANK_CHARACTERS) + "]"
TOKEN = regex.compile(r"[\p{L}\p{N}](?:[\p{L}\p{N}.'’-]*[\p{L}\p{N}])?\.*|[.!?…]+|[^\p{L}\p{N}.!?…" + regex.escape(BLANK_CHARACTERS) + "]")


def kind(token):
    bare = token.lower().rstrip(".")
    return "##number##" if regex.match(r"^[+-]?[0-9][0-9.,-]*$", bare) else bare


def ll(k, n, p):
    return (k * math.log(max(p, 1e-300)) if k else 0) + ((n - k) * math.log(max(1 - p, 1e-300)) if n - k else 0)


def dunning(a, b, ab, n):
    p, p1, p2 = b / n, ab / a, (b - ab) / (n - a) if n > a else 1.0
    return -2 * (ll(ab, a, p) + ll(b - ab, n - a, p) - ll(ab, a, p1) - ll(b - ab, n - a, p2))


class Small:
    """The method over lists, one pass after another."""

    def __init__(self, texts):
        self.docs = [self.cut(t) for t in texts]
        dot, bare, self.inside = Counter(), Counter(), defaultdict(set)
        for doc in self.docs:
            for f in doc:
                for i, w in enumerate(TOKEN.findall(f)):
                    if regex.match(r"[\p{L}\p{N}]", w):
                        (dot if w.endswith(".") else bare)[kind(w)] += 1
                        if i:
                            self.inside[kind(w)] |= {"U"} if regex.match(r"\p{Lu}", w) else {"L"} if regex.match(r"\p{Ll}", w) else set()
        self.count = dot + bare
        n, dots = sum(self.count.values()), sum(dot.values())
        self.abbreviations = set()
        for t, k in dot.items():
            letters = len(t.replace(".", ""))
            score = -2 * (ll(k, self.count[t], dots / n) - ll(k, self.count[t], 0.99)) * math.exp(-letters) * (len(t) - letters + 1) * max(letters, 1) ** -bare[t]
            if score >= 0.3 and regex.search(r"\p{L}", t) and t != "##number##":
                self.abbreviations.add(t)
        at_break, pairs, self.first, self.unknown, breaks = Counter(), Counter(), defaultdict(set), defaultdict(set), 0
        for doc in self.docs:
            for before, after, f in self.places(doc):
                case = "U" if regex.match(r"\p{Lu}", after) else "L" if regex.match(r"\p{Ll}", after) else ""
                (self.first if f["first"] else self.unknown)[kind(after)].add(case)
                if f["first"]:
                    breaks += 1
                    at_break[kind(after)] += 1
                if f["abbreviation"] or f["dotted"] and (kind(before) == "##number##" or regex.fullmatch(r"\p{L}", kind(before))):
                    pairs[kind(before), kind(after)] += 1
        self.starters = {t for t, k in at_break.items() if regex.match(r"\p{L}", t) and self.count[t] and dunning(breaks, self.count[t], k, n) >= 30 and n * k > self.count[t] * breaks}
        self.pairs = {(a, b) for (a, b), k in pairs.items() if k > 1 and self.count[a] and self.count[b] and dunning(self.count[a], self.count[b], k, n) >= 7.88 and n * k > self.count[a] * self.count[b] and b not in self.starters}

    def cut(self, text):
        s = regex.sub(rf"([.!?…][\"'”’»)\]]*){WS}+", "\\1\u0001", text.strip(BLANK_CHARACTERS))
        return [f for f in s.split("\u0001")]

    def places(self, doc):
        for f, g in zip(doc, doc[1:]):
            nxt = TOKEN.search(g)
            if not f or not nxt:
                continue
            end = regex.sub(r"[\"'”’»)\]]+$", "", f)
            last = [m.group() for m in TOKEN.finditer(end) if m.end() == len(end)]
            last = last[-1] if last else ""
            dotted = bool(regex.match(r"[\p{L}\p{N}].*\.$", last, regex.S))
            abbreviation, ellipsis = dotted and kind(last) in self.abbreviations, bool(regex.fullmatch(r"\.\.+|…", last))
            yield last, nxt.group(), {"dotted": dotted, "abbreviation": abbreviation, "ellipsis": ellipsis, "first": not abbreviation and not ellipsis}

    def is_break(self, before, after, f):
        b, a = kind(before), kind(after)
        if not f["dotted"] and not f["ellipsis"]:
            return True
        if (b, a) in self.pairs:
            return False
        upper, lower, word = bool(regex.match(r"\p{Lu}", after)), bool(regex.match(r"\p{Ll}", after)), bool(regex.match(r"[\p{L}\p{N}]", after))
        known = a in self.count
        ever = self.inside[a] | self.first[a] | self.unknown[a] if known else set()
        begins = word and upper and "L" in ever and not ("U" in self.inside[a] and known)
        goes_on = not word or lower and ("U" in ever or not (known and "L" in self.first[a]))
        initial, number = f["dotted"] and bool(regex.fullmatch(r"\p{L}", b)), f["dotted"] and b == "##number##"
        if f["abbreviation"] and not initial or f["ellipsis"]:
            return begins or upper and a in self.starters
        if initial or number:
            name = initial and not begins and upper and "L" not in ever
            return not (goes_on or name) and not (f["abbreviation"] and not begins and a not in self.starters)
        return True

    def sentences(self):
        for doc in self.docs:
            verdicts = {i: self.is_break(*p) for i, p in self.indexed(doc)}
            out = "".join(f + ("\u0001" if verdicts.get(i, True) else " ") for i, f in enumerate(doc) if f)
            yield [s for s in (x.strip(BLANK_CHARACTERS) for x in out.split("\u0001")) if s]

    def indexed(self, doc):
        for i in range(len(doc) - 1):
            for p in self.places(doc[i : i + 2]):
                yield i, p


def corpus(n=150, seed=3):
    r = random.Random(seed)
    names = ["Silva", "Costa", "Rocha", "Souza"]
    verbs = ["toma", "usa", "guarda", "evita", "relata"]
    nouns = ["remédio", "dose", "água", "leite", "comprimido", "efeito", "médico", "caso"]
    out = []
    for _ in range(n):
        text = []
        for _ in range(r.randint(1, 12)):
            words = [r.choice(["O", "A", "Um", "Esse"]), r.choice(nouns), r.choice(verbs)]
            words += r.choices(nouns, k=r.randint(0, 4))
            if r.random() < 0.4:
                words += [r.choice(["Dr.", "dr."]), r.choice(names)]
            if r.random() < 0.3:
                words += ["aprox.", str(r.randint(1, 90)), "mg"]
            if r.random() < 0.2:
                words += ["no", "art.", f"{r.randint(1, 20)}."] if r.random() < 0.5 else ["de", f"{r.choice('ABJM')}.", r.choice(names)]
            if r.random() < 0.1:
                words += ["p.ex.", r.choice(nouns)]
            text.append(" ".join(words) + r.choice([".", ".", ".", "!", "?", "...", '."', " …", ".)"]))
        out.append(r.choice([" ", "\n", "  "]).join(text))
    return out + ["", "   ", "Sem fim", "fim. ", "a. b. c.", "É isso.\u00a0Sim.", "x.  \n y"]


def test_against_a_small_implementation(spark):
    texts = corpus()
    small = Small(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").repartition(3).cache()
    model = punkt.trained(df, "k", "t")
    assert {r.type for r in model.abbreviations.collect()} == small.abbreviations
    assert {"dr", "aprox", "p.ex"} <= small.abbreviations and not {"caso", "dose", "silva"} & small.abbreviations
    assert {r.type for r in model.starters.collect()} == small.starters and {"o", "a"} <= small.starters
    assert {(r.first, r.second) for r in model.collocations.collect()} == small.pairs
    want = {i: s for i, s in enumerate(small.sentences()) if s}
    got = {r.k: r.sentences for r in punkt.sentences(df, "k", "t", model).collect()}
    assert got == want
    joined = [s for x in got.values() for s in x]
    assert not any(s.endswith((" Dr.", " aprox.")) for s in joined) and len(joined) > 500


def test_nulls_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, None), (None, "Oi. Tudo bem? Sim."), (2, "")], "k long, t string")
    model = punkt.trained(df, "k", "t")
    got = {r.k: r.sentences for r in punkt.sentences(df.filter("k IS NOT NULL OR t IS NOT NULL"), "k", "t", model).collect()}
    assert got.get(1) is None and got.get(2) is None
    assert punkt.sentences(df.limit(0), "k", "t", punkt.trained(df.limit(0), "k", "t")).count() == 0


def test_places_only_are_joined(spark):
    df = spark.createDataFrame([(1, "a b c. D")], "k long, t string")
    parts = punkt.fragments(df, "k", "t")
    assert [(r.at, r.fragment, r.last, r.next) for r in parts.orderBy("at").collect()] == [(0, "a b c.", "c.", "D"), (1, "D", None, None)]
    assert punkt.breaks(parts, punkt.trained(df, "k", "t")).select(F.count("*")).first()[0] == 1
