"""Main text of web pages by the maximum-scoring subsequence of their words and tags.

A page becomes a sequence of tags and blocks (the text between two block tags). Words score positive, by how likely
their block is content; tags score negative, by how seldom they stand in content. One linear scan finds the contiguous
region with the largest sum; inside it the blocks that are likelier boilerplate than not (an advert between two
paragraphs) are left out. Inside elements that are surely boilerplate tags score nothing, so that a long menu
amid an article doesn't cut it in two.

All weights are learned from labelled pages, pairs of html and main text: a logistic regression on a block's tag,
length, share of links and final mark, on the elements around it and the words of their class, id, role and label
names; the shares of tags in content; and the scale of tags against words, which is the one that reads the labelled
pages best. No table of labelled pages is given, so labelled_pages() lays some out: a bounded number (a parameter)
of pages of invented words, in many layouts, each with the text it was made from.

Rules: a null html is an empty one and gives an empty text, as does a page without words or without content. Broken,
cut-off and very long pages are read to their end. Repeated rows come out each; a null page_id or url is passed on;
an empty table gives an empty one. Extra columns of any name are passed through by with_main_text(), whose own two are
renamed if a column has their name. A line break tag is white space; cells of a table are blocks.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.common import fresh, table

TAG = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+(?=>)|[^>]*+)(?:>|\Z)""", re.S)
#: Their content is no text of the page.
RAW = frozenset("script style noscript template textarea title iframe svg object canvas select option math audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split()
)
AROUND = frozenset("article aside button dialog fieldset footer form header label legend main menu nav search".split())
#: An opening tag ends open elements of these kinds at the top of the stack.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}}
NAMED = re.compile(r"""\b(class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Names that web pages give their parts.
NAMES = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topnav subnav tabs pager pagination sitemap skip toc links dropdown".split(),
    "header": "header masthead banner branding logo topbar toolbar top site-header page-header".split(),
    "footer": "footer colophon copyright legal bottom imprint credits contentinfo site-info foot".split(),
    "sidebar": "sidebar side aside rail widget widgets related recommended popular trending teasers archive archives tags tagcloud categories secondary complementary author-box more-stories latest".split(),
    "notice": "cookie cookies consent gdpr notice notices alert paywall popup modal overlay toast warning dialog announcement disclaimer notification privacy".split(),
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion adsense adslot commercial partner outbrain taboola".split(),
    "form": "form search login newsletter signup subscribe subscription contact poll survey register".split(),
    "social": "share sharing social follow likes buttons".split(),
    "comments": "comment comments commentlist respond reply replies discussion disqus responses feedback thread guestbook".split(),
    "content": "content article post entry story main text body article-body post-content entry-content story-text single blog hentry prose articleBody maincontent".split(),
}
SEMANTIC = {"menu": ["nav", "menu"], "header": ["header"], "footer": ["footer"], "sidebar": ["aside"], "notice": ["dialog"], "advert": ["aside"], "form": ["form"], "content": ["article", "main"]}
KNOWN = frozenset(x.lower() for names in NAMES.values() for n in names for x in NAME_WORD.findall(n))


@lru_cache(maxsize=10_000)
def marks(attributes: str) -> frozenset[str]:
    """What the names of an element say about it."""
    out = set()
    for m in NAMED.finditer(attributes):
        for word in NAME_WORD.findall(m[2] or m[3] or m[4] or ""):
            w = word.lower()
            if w not in KNOWN:
                # run together: commentlist2, sidebarleft
                w = next((w[:k] for k in range(len(w) - 1, 4, -1) if w[:k] in KNOWN), "")
            if w:
                out.add(f"name {w}")
    if HIDDEN.search(attributes):
        out.add("hidden")
    return frozenset(out)


@dataclass(slots=True)
class Block:
    text: str
    words: int
    inner: list[str]
    own: list[str]
    around: frozenset[str]


def read(html: str) -> list[Block | tuple[str, frozenset[str]]]:
    """The sequence of blocks and of block tags (name, what is around)."""
    out: list = []
    stack: list[tuple[str, frozenset[str]]] = [("", frozenset())]
    text: list[str] = []
    inner: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        said = "".join(text).split()
        if said:
            n = len(said)
            share, line = linked / n, " ".join(said)
            own = [f"in {stack[-1][0]}", f"words {min(n.bit_length(), 6)}", f"links {0 if share == 0 else 1 if share < 0.35 else 2 if share < 0.7 else 3}", f"stop {line[-1] in '.!?…:;,'}"]
            out.append(Block(line, n, inner.copy(), own, stack[-1][1]))
        elif inner:
            out.extend((t, stack[-1][1]) for t in inner)
        text.clear()
        inner.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        said = entities.unescape(raw) if "&" in raw else raw
        text.append(said)
        if links:
            linked += len(said.split())

    at = 0
    while m := TAG.search(html, at):
        if m.start() > at:
            say(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name, attributes = m[2].lower(), m[3]
        if not m[1] and name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name not in BLOCK:
            inner.append(name)
            if name == "a":
                links = 0 if m[1] else 1
            elif name == "br":
                text.append(" ")
            continue
        flush()
        if name in ("html", "body", "head"):
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    out.append((name, stack[k][1]))
                    del stack[k:]
                    links = 0
                    break
            continue
        if stack[-1][0] == "p":
            stack.pop()
        if stack[-1][0] in ENDS.get(name, ()):
            stack.pop()
            if name == "tr" and stack[-1][0] == "tr":
                stack.pop()
        around = stack[-1][1]
        found = marks(attributes) if attributes.strip() else frozenset()
        if name in AROUND:
            inside = name in ("header", "footer") and ("around article" in around or "around main" in around)
            found = found | {f"around {name}{' of article' if inside else ''}"}
        around = around if found <= around else around | found
        out.append((name, around))
        if name not in VOID and not attributes.endswith("/"):
            stack.append((name, around))
    if at < len(html):
        say(html[at:])
    flush()
    return out


@dataclass
class Model:
    bias: float
    weights: dict[str, float]
    tags: dict[str, float]
    scale: float

    def likely(self, block: Block) -> float:
        z = self.bias + sum(self.weights.get(f, 0.0) for f in block.own) + sum(self.weights.get(f, 0.0) for f in block.around)
        return 1 / (1 + np.exp(-z))

    def sure(self, around: frozenset[str]) -> bool:
        """Whether what is around can only be boilerplate."""
        return sum(self.weights.get(f, 0.0) for f in around) < -2.5

    def main_text(self, html: str | None, scale: float | None = None) -> str:
        scale = self.scale if scale is None else scale
        items = read(html or "")

        def tag(name: str) -> float:
            return -scale * self.tags.get(name, 0.5)

        likely = {i: self.likely(x) for i, x in enumerate(items) if isinstance(x, Block)}
        scores = []
        for i, x in enumerate(items):
            if i in likely:
                scores.append(likely[i] * x.words + (sum(map(tag, x.inner)) if likely[i] >= 0.5 else 0.0))
            else:
                scores.append(0.0 if self.sure(x[1]) else tag(x[0]))
        return "\n".join(items[i].text for i in range(*best_region(scores)) if likely.get(i, 0) >= 0.5)


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous part with the largest positive sum, as start and end; (0, 0) without one."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        total += score
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, region = total, (start, i + 1)
    return region


def labels(items: list, text: str) -> list[bool]:
    """Which blocks make up the text, in order."""
    wanted, at, out = text.split("\n"), 0, []
    for x in items:
        if isinstance(x, Block):
            hit = at < len(wanted) and x.text == wanted[at]
            at += hit
            out.append(hit)
    return out


def f1(got: str, want: str) -> float:
    """Agreement of two texts on words."""
    a, b = Counter(got.split()), Counter(want.split())
    shared = (a & b).total()
    return 1.0 if not a and not b else 2 * shared / (a.total() + b.total())


def fit(pages: list[tuple[str, str]], rounds: int = 12, decay: float = 0.1) -> Model:
    """A model of labelled pages (html, main text)."""
    parsed = [(read(h), t) for h, t in pages]
    blocks, y, tags = [], [], defaultdict(lambda: [1.0, 1.0])
    for items, text in parsed:
        known = iter(labels(items, text))
        content = {i: next(known) for i, x in enumerate(items) if isinstance(x, Block)}
        inside = False
        for i, x in enumerate(items):
            if i in content:
                blocks.append(x)
                y.append(content[i])
                inside = content[i]
                for t in x.inner:
                    tags[t][inside] += 1
            else:
                # a tag is of the content if what follows it is
                follows = next((content[j] for j in range(i + 1, min(i + 4, len(items))) if j in content), False)
                tags[x[0]][inside and follows] += 1
    names = sorted({f for b in blocks for f in (*b.own, *b.around)})
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(blocks), len(names) + 1))
    x[:, -1] = 1
    for i, b in enumerate(blocks):
        x[i, [at[f] for f in (*b.own, *b.around)]] = 1
    target, w = np.array(y, dtype=float), np.zeros(len(names) + 1)
    for _ in range(rounds):
        # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - target) + decay * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + decay * np.eye(len(w)), slope)
        w = w - step
    model = Model(float(w[-1]), {f: float(w[i]) for f, i in at.items()}, {t: off / (off + on) for t, (off, on) in tags.items()}, 1.0)
    some = pages[:100]
    model.scale = max((0.1, 0.2, 0.3, 0.4, 0.5), key=lambda s: sum(f1(model.main_text(h, s), t) for h, t in some))
    return model


class Layout:
    """Lays out one labelled page."""

    def __init__(self, rng: np.random.Generator) -> None:
        self.rng = rng
        self.named, self.semantic = rng.random() < 0.85, rng.random() < 0.6
        self.body: list[str] = []

    def one(self, of: list):
        return of[int(self.rng.integers(len(of)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def words(self, least: int, most: int) -> str:
        n = int(self.rng.integers(least, most + 1))
        return " ".join("".join(self.one(["ka", "lo", "mi", "ren", "to", "su", "é", "vi", "& ", "an"]) for _ in range(int(self.rng.integers(1, 4)))) for _ in range(n)).capitalize()

    def sentence(self, least: int = 6, most: int = 20) -> str:
        return self.words(least, most) + self.one([".", ".", ".", "!", "?", "", ":"])

    def element(self, kind: str, inside: str) -> str:
        """inside, in an element that may say what it is."""
        semantic = SEMANTIC.get(kind) if self.semantic and self.chance(0.8) else None
        tag = self.one(semantic) if semantic else self.one(["div", "div", "div", "section", "td"])
        if semantic and self.chance(0.5) or not self.named or kind == "content" and self.chance(0.3):
            return f"<{tag}>{inside}</{tag}>"
        name = self.one(NAMES[kind])
        name = self.one(["{}", "{}", "{}", "{}-box", "site-{}", "{} clearfix", "block {}", "main_{}", "{}Wrap", "js-{}", "page-{}"]).format(name)
        how = self.one(["class", "class", "id", "role" if kind != "content" else "itemprop"])
        return f'<{tag} {how}="{name}">{inside}</{tag}>' if self.chance(0.9) else f"<{tag} {how}='{name}' data-x=\"a>b\">{inside}</{tag}>"

    def link(self, text: str) -> str:
        return f'<a href="/{int(self.rng.integers(99))}">{entities.escape(text)}</a>'

    def links(self) -> str:
        items = [self.link(self.words(1, 4)) for _ in range(int(self.rng.integers(2, 12)))]
        return f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>" if self.chance(0.7) else " | ".join(items)

    def prose(self, least: int, most: int) -> str:
        return "".join(f"<p>{entities.escape(' '.join(self.sentence() for _ in range(int(self.rng.integers(1, 4)))))}</p>" for _ in range(int(self.rng.integers(least, most + 1))))

    def part(self, kind: str) -> str:
        line, title = entities.escape(self.sentence(3, 14)), f"<h3>{entities.escape(self.words(1, 4))}</h3>"
        if kind in ("menu", "social"):
            inside = self.links()
        elif kind == "header":
            inside = f"{self.one(['<h1>{}</h1>', '<div>{}</div>', '<p>{}</p>']).format(self.link(self.words(1, 3)))}{line if self.chance(0.3) else ''}{self.links() if self.chance(0.6) else ''}"
        elif kind == "footer":
            inside = f"{self.one(['<p>{}</p>', '{}', '<div>{}</div>']).format('&copy; 2024 ' + line)}{self.links() if self.chance(0.6) else ''}"
        elif kind == "sidebar":
            inside = f"{title}{self.links() if self.chance(0.7) else ''}{self.prose(0, 3)}"
        elif kind == "notice":
            inside = f"{self.one(['<p>{}</p>', '{}']).format(line)}<button>{self.words(1, 2)}</button>" if self.chance(0.6) else self.prose(1, 2)
        elif kind == "advert":
            inside = self.one([line, f"<p>{line}</p>", f"{title}<p>{line}</p>", self.link(self.words(3, 10)), self.prose(1, 2)])
        elif kind == "form":
            inside = f"{title}<label>{self.words(1, 3)}</label><input name=q>{self.one(['', f'<p>{line}</p>'])}<button>{self.words(1, 2)}</button>"
        else:
            inside = title + "".join(self.one(["<li>{}</li>", "<div>{}</div>", "<article>{}</article>", '<div class="comment">{}</div>']).format(f"<b>{self.words(1, 2)}</b> {self.one(['<p>{}</p>', '{}']).format(self.sentence(4, 40))}") for _ in range(int(self.rng.integers(1, 6))))
        if not self.named and kind in ("comments", "advert", "notice"):
            return ""
        return self.element(kind, inside)

    def say(self, tag: str, text: str, html: str | None = None) -> str:
        text = " ".join(text.split())
        self.body.append(text)
        return f"<{tag}>{entities.escape(text) if html is None else html}</{tag}>"

    def content(self) -> str:
        out = [self.say("h1", self.words(3, 12))]
        for _ in range(int(self.rng.integers(1, 14))):
            kind = self.rng.random()
            if kind < 0.6:
                text = self.sentence(1, 4) if self.chance(0.25) else " ".join(self.sentence() for _ in range(int(self.rng.integers(1, 6))))
                text = " ".join(text.split())
                first, _, rest = text.partition(" ")
                html = f"{self.one(['<b>{}</b>', '<i>{}</i>', '{}', '{}', '<a href=x>{}</a>']).format(entities.escape(first))} {entities.escape(rest)}"
                out.append(self.say(self.one(["p", "p", "p", "p", "div"]), text, html).replace("</p>", "" if self.chance(0.05) else "</p>"))
            elif kind < 0.7:
                out.append(self.say(self.one(["h2", "h3"]), self.words(2, 8)))
            elif kind < 0.78:
                out.append(f"<ul>{''.join(self.say('li', self.sentence(3, 15)) for _ in range(int(self.rng.integers(2, 6))))}</ul>")
            elif kind < 0.82:
                out.append(f"<blockquote>{self.say('p', self.sentence(5, 30))}</blockquote>")
            elif kind < 0.85:
                out.append(f"<table>{''.join('<tr>' + ''.join(self.say('td', self.words(1, 4)) for _ in range(3)) + '</tr>' for _ in range(3))}</table>")
            elif kind < 0.88:
                out.append(f"<figure><img src=x>{self.say('figcaption', self.sentence(4, 12))}</figure>")
            elif kind < 0.89:
                out.append(self.say("pre", self.words(4, 12)))
            else:
                out.append(self.part(self.one(["advert", "advert", "social", "form", "sidebar", "notice", "notice"])))
        return "".join(out)

    def page(self) -> tuple[str, str]:
        some = lambda *kinds: "".join(self.part(k) for k in kinds if self.chance(0.5))
        before = some("notice", "header", "menu", "advert", "sidebar", "form")
        main = self.content()
        if self.semantic and self.chance(0.2):
            main = f"<header>{main.replace('</h1>', '</h1></header>', 1)}"
        main += some("social", "form")
        if self.chance(0.3):
            main += self.part("comments")
        for _ in range(int(self.rng.integers(1, 4))):
            main = self.element("content", main)
        after = some("social", "comments", "sidebar", "advert", "form", "menu") + self.part("footer")
        head = f"<head><title>{self.words(2, 6)}</title><style>p{{}}</style><script>var a='</p>'</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{before}{main}{after}</body></html>", "\n".join(self.body)


def labelled_pages(n: int = 500, seed: int = 7) -> list[tuple[str, str]]:
    """So many labelled pages (html, main text) of invented words."""
    rng = np.random.default_rng(seed)
    return [Layout(rng).page() for _ in range(n)]


def with_main_text(pages: DataFrame, model: Model, html: str = "html") -> DataFrame:
    """pages with text and n_chars, its number of code points."""
    added = fresh([c for c in pages.columns], "text", "n_chars")

    @F.pandas_udf("text string, n_chars long")
    def extract(column: pd.Series) -> pd.DataFrame:
        found = [model.main_text(h) for h in column]
        return pd.DataFrame({"text": found, "n_chars": [len(t) for t in found]})

    (found,) = fresh([*pages.columns, *added], "found")
    out = pages.withColumn(found, extract(F.col(f"`{html}`")))
    return out.select(*[F.col(f"`{c}`") for c in pages.columns], F.col(f"{found}.text").alias(added[0]), F.col(f"{found}.n_chars").alias(added[1]))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"), fit(labelled_pages())).drop("html")


QUERIES = {"op13_main_text": op13_main_text}
ORACLES: dict[str, str] = {}
