"""Labelled pages for the extraction's classifier: made-up sites of several layouts, each text marked as content or not."""

import random

WORDS = "the a of and to in is was river market letter engine garden policy winter music report signal harbour school theory bread window doctor paper travel forest number table mountain question answer history".split()


#: Names of paragraphs that sound like furniture, and are the text's own.
NAMES = [' class="notice-period"', ' class="share-price"', ' class="consent"']


class Page:
    def __init__(self, r):
        self.r, self.html, self.content, self.n = r, [], set(), 0

    def text(self, low, high, content):
        """A text that no other block of the page has; sentences if it is long."""
        self.n += 1
        words, out = [self.r.choice(WORDS) for _ in range(self.r.randint(low, high))], []
        for i, w in enumerate(words):
            out.append(w.capitalize() if i % 11 == 0 else w)
            if len(words) > 8 and i % 11 == 10:
                out[-1] += self.r.choice(".,.?!,.")
        whole = " ".join(out) + f" {self.n}" + ("." if len(words) > 8 else "")
        if content:
            self.content.add(whole)
        return whole

    def put(self, name, low, high, content=False, attributes="", link=False):
        t = self.text(low, high, content)
        t = f'<a href="/{self.n}">{t}</a>' if link else t
        self.html.append(f"<{name}{attributes}>{t}</{name}>")

    def within(self, name, attributes="", inside=()):
        self.html.append(f"<{name}{attributes}>")
        for f in inside:
            f()
        self.html.append(f"</{name}>")

    def links(self, count, low=1, high=3):
        return [lambda: self.put("li", low, high, link=True) for _ in range(count)]

    def prose(self, count):
        out = [lambda: self.put("h1", 3, 9, True)]
        for i in range(count):
            out.append(lambda: self.put("p", self.r.choice([3, 12, 30]), 90, True, self.r.choice([""] * 9 + NAMES)))
            if i % 3 == 2:
                out.append(lambda: self.put("h2", 2, 6, True))
            if i % 4 == 3:
                out.append(lambda: self.within("ul", "", [lambda: self.put("li", 2, 14, True)] * 3))
        if count > 3:
            out.append(lambda: self.put("blockquote", 10, 40, True))
        return out


def page(seed):
    """(html, texts of the content blocks)."""
    r = random.Random(seed)
    p = Page(r)
    menu = lambda: p.within("nav", "", [lambda: p.within("ul", "", p.links(r.randint(3, 7)))])
    prose, kind = p.prose(r.randint(2, 8)), seed % 6
    ad = lambda: p.within("div", ' class="ad"', [lambda: p.put("p", 4, 20)])
    comments = lambda: p.within("div", ' class="comments"', [lambda: p.put("p", 5, 40)] * r.randint(1, 4))
    related = lambda: p.within("div", ' class="related"', p.links(4, 4, 10))
    if kind == 0:
        parts = [menu, ad, lambda: p.within("article", "", prose), lambda: p.within("footer", "", [lambda: p.put("p", 3, 12, False, ' class="copyright"')])]
    elif kind == 1:
        parts = [lambda: p.within("header", "", [lambda: p.put("h1", 1, 3), menu]), lambda: p.within("div", ' class="content"', prose), lambda: p.within("aside", "", [lambda: p.put("p", 8, 30), *p.links(3)]), comments, lambda: p.within("footer", "", p.links(3))]
    elif kind == 2:
        parts = [lambda: p.within("div", ' class="cookie-notice"', [lambda: p.put("p", 12, 30)]), menu, lambda: p.within("main", "", [lambda: p.within("article", "", [*prose, ad, lambda: p.within("div", ' class="share"', p.links(3))]), comments]), lambda: p.within("form", "", [lambda: p.put("label", 2, 6)])]
    elif kind == 3:
        parts = [lambda: p.within("div", ' id="menu"', [lambda: p.within("ul", "", p.links(5))]), lambda: p.within("div", ' class="post"', prose), related, lambda: p.within("div", ' class="page-footer"', [lambda: p.put("p", 6, 20)])]
    elif kind == 4:
        parts = [lambda: p.within("div", ' class="breadcrumb"', p.links(3)), lambda: p.within("div", "", prose), lambda: p.within("div", "", p.links(r.randint(4, 9), 2, 7)), lambda: p.within("div", ' style="display:none"', [lambda: p.put("p", 10, 40)])]
    else:
        parts = [lambda: p.within("header", "", [menu]), lambda: p.within("article", "", [lambda: p.within("header", "", prose[:1]), *prose[1:], lambda: p.within("aside", "", [lambda: p.put("p", 8, 30)])]), lambda: p.within("section", ' class="newsletter"', [lambda: p.put("p", 6, 25)]), related, lambda: p.within("footer", "", [lambda: p.put("p", 2, 10)])]
    p.html.append("<html><body>")
    for part in parts:
        part()
    p.html.append("</body></html>")
    return "".join(p.html), p.content
