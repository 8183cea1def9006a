"""Main text of HTML pages from flat text blocks.

A tolerant scan cuts a page into blocks, the runs of text between block-level tags. Each block has its words and link density, those
of its neighbours, and what the open elements say (kind of element, class and id words, the text under its article). A decision tree, trained on the
blocks of the labelled pages below, tells content from the rest.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)|<[!?/][^>]*(?:>|$)""", re.S | re.I)
#: Elements without text of the page; the first run to the end of the page if they aren't closed, the others hold nothing then.
_RAW = frozenset("script style textarea title".split())
_SKIPPED = _RAW | frozenset("template noscript svg math iframe object canvas select".split())
_CLOSERS = {t: re.compile(rf"</{t}\s*>", re.I) for t in _SKIPPED}
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base basefont br col embed frame hr img input link meta param source track wbr".split())
_OUT = frozenset("head nav footer aside menu dialog button option search".split())
_FORM = frozenset("form fieldset label legend".split())
#: Words of class, id and role that name what isn't the article, and some that articles' parts are called by as well.
_STRONG = frozenset("ad ads adv advert advertisement adverts advertising sponsor sponsored cookie cookies consent gdpr sidebar rail nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar toolbar comment comments reply replies respond disqus share sharing social related recommended recommendations widget widgets popup modal overlay newsletter subscribe subscription signup login pagination pager skip skiplink paywall outbrain taboola taglist".split())
_WEAK = frozenset("promo promoted promotion banner notice notices notification alert discussion search legal copyright teaser trending tags byline feedback header top".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_LEGAL = re.compile(r"©|\(c\)|copyright|all rights reserved|imprint|privacy", re.I)
_SPLIT = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z0-9])(?=[A-Z])")


class Block:
    __slots__ = ("text", "words", "linked", "out", "form", "strong", "weak", "article", "heading", "item", "label")

    def __init__(self, text: str, linked: int, state: tuple, label: str | None) -> None:
        self.text, self.words, self.linked, self.label = text, text.count(" ") + 1, linked, label
        self.out, self.form, self.strong, self.weak, self.article, self.heading, self.item = state


def blocks(page: str) -> list[Block]:
    """Blocks in page order. Unclosed or stray tags are tolerated; markup that the page's end cuts off is dropped."""
    out: list[Block] = []
    # open elements: (tag, out, form, strong, weak, number of the nearest article, heading, item, label)
    stack: list[tuple] = [("", False, False, 0.0, 0.0, 0, False, False, None)]
    open_: Counter = Counter()  # how many of each tag are open, so that stray closing tags cost nothing
    unclosed: set[str] = set()
    parts: list[str] = []
    links: list[str] = []
    anchor, articles = False, 0

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                linked = len(html.unescape(" ".join(links)).split()) if links else 0
                out.append(Block(text, linked, stack[-1][1:8], stack[-1][8]))
            parts.clear()
            links.clear()

    def text_run(s: str) -> None:
        if s:
            parts.append(s)
            if anchor:
                links.append(s)

    def close(k: int) -> None:
        open_.subtract(s[0] for s in stack[k:])
        del stack[k:]

    at = 0
    while m := _TOKEN.search(page, at):
        text_run(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing, attrs = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in _SKIPPED:
            parts.append(" ")
            if not closing and tag not in unclosed and not (attrs.endswith("/") and tag not in _RAW):
                if end := _CLOSERS[tag].search(page, at):
                    at = end.end()
                else:
                    unclosed.add(tag)
                    at = len(page) if tag in _RAW else at
            continue
        if tag in _BLOCK:
            flush()
        elif tag == "br" or tag == "img":
            parts.append(" ")
        if tag == "a":
            anchor = not closing
            if closing:
                links.append(" ")
        if tag in _VOID:
            continue
        if closing:
            if open_[tag] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        close(k)
                        break
                    if tag not in _BLOCK and stack[k][0] in _BLOCK:
                        break
            continue
        if tag in _BLOCK:
            anchor = anchor and tag not in ("p", "li", "td")
            while len(stack) > 1 and (stack[-1][0] == "p" or stack[-1][0] not in _BLOCK):  # a block ends an open paragraph and its inline elements
                if stack[-1][0] not in _BLOCK and not any(s[0] == "p" for s in stack[-4:]):
                    break
                close(len(stack) - 1)
            closes = _CLOSES.get(tag)
            if closes:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in closes:
                        close(k)
                        break
                    if stack[k][0] in _BLOCK:
                        break
        got = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTR.findall(attrs)} if attrs.strip(" /\r\n\t") else {}
        if attrs.endswith("/") and tag not in _BLOCK:
            continue
        _, o, f, strong, weak, art, head, item, label = stack[-1]
        for c in ("class", "id", "role"):
            if c in got and tag not in ("body", "html"):
                for one in got[c].split():
                    words = [t.lower() for t in _SPLIT.split(one) if t]
                    if words:
                        strong = max(strong, sum(w in _STRONG for w in words) / len(words))
                        weak = max(weak, sum(w in _WEAK or w in _STRONG for w in words) / len(words))
        if "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", "").lower():
            strong = 1.0
        if tag in ("article", "main") or got.get("role") == "main":
            articles += 1
            art, f = articles, False
        if tag == "header" and not art or tag in _OUT or got.get("role") in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert"):
            o = True
        if tag == "body":
            o = False
        stack.append((tag, o, f or tag in _FORM, strong, weak, art, head or tag in ("h1", "h2", "h3", "h4", "h5", "h6"), item or tag in ("li", "td", "th", "dt", "dd"), got.get("data-keep", label)))
        open_[tag] += 1
    text_run(page[at:])
    flush()
    return out


FEATURES = ["words", "link_density", "words_before", "density_before", "words_after", "density_after", "near", "share", "told", "weak", "article", "heading", "item", "legal"]


def features(found: list[Block]) -> np.ndarray:
    """One row a block; the neighbours of the ends are empty. near: unlinked words of the block and two on each side; share: unlinked words under the block's nearest article (or
    under none) against those of the article that has most; told: how far an open element's kind or class words name what isn't the article."""
    words = [0, *(b.words for b in found), 0]
    density = [0.0, *(min(1.0, b.linked / b.words) for b in found), 0.0]
    plain = [0.0 if b.out or b.form or b.strong > 0.5 else b.words * (1 - density[k]) for k, b in enumerate(found, 1)]
    total: dict[int, float] = {}
    for b, w in zip(found, plain):
        total[b.article] = total.get(b.article, 0) + w
    most = max(total.values(), default=0) or 1
    padded = [0.0, 0.0, *plain, 0.0, 0.0]
    return np.array([
        (b.words, density[k], words[k - 1], density[k - 1], words[k + 1], density[k + 1], sum(padded[k - 1 : k + 4]), total[b.article] / most, max(b.strong, b.out, b.form), b.weak, b.article > 0, b.heading, b.item,
         b.words <= 20 and bool(_LEGAL.search(b.text))) for k, b in enumerate(found, 1)], float).reshape(-1, len(FEATURES))


# Labelled pages: data-keep="y" marks content, anything else is to go. They are written from parts by a fixed draw, in many layouts: with and without article elements and telling
# classes, with stories in plain or misleading containers, and with what surrounds them told by its text alone, by its tag or by its class.
_TERMS = """harbour ferry dawn town captain winter market river bread council bridge engine letter garden school storm price river teacher village court report music glass window season hill field
paper train doctor island border number history museum coast kitchen worker painter forest league summer street union valley lamp stone harvest winter bank factory festival minister office""".split()
_GLUE = "the a of and to in that was for on with as by at from had were his her their which after before over between until where could not more than when since also while".split()
N_PAGES = 1500


class _Draw(random.Random):
    def text(self, low: int, high: int) -> str:
        words = [self.choice(_TERMS) if self.random() < 0.45 else self.choice(_GLUE) for _ in range(self.randint(low, high))]
        for k in range(0, len(words), 13):
            words[k] = words[k].capitalize()
        return " ".join(words) + self.choice([".", ".", ".", "", "?"])

    def link(self, low: int, high: int) -> str:
        return f"<a href=/{self.randint(1, 99)}>{self.text(low, high)}</a>"

    def story(self, legal: float = 0.03) -> list[str]:
        """Blocks of content; legal: how often a line reads like a notice of rights."""
        if self.random() < 0.12:  # very short
            few = self.randint(1, 12)
            return [f"<h1>{self.text(1, 6)}</h1>"] * (self.random() < 0.7) + [f"<p>{self.text(1, few)}</p>" for _ in range(self.randint(1, 3))]
        out = [f"<h{self.choice('12')}>{self.text(1, 9)}</h1>"] if self.random() < 0.8 else []
        if self.random() < 0.12:  # verse
            few = self.randint(1, 4)
            out += [f"<p>{self.text(20, 200)}</p>"] * (self.random() < 0.4) + [f"<p>{self.text(few, few + 2)}</p>" for _ in range(self.randint(4, 40))]
        if self.random() < legal:
            out.append(f"<p>{self.choice(['All rights reserved.', 'Copyright law is old.', '&copy; 1900', 'On privacy.', 'Imprint.'])}</p>")
        for _ in range(self.choice([1, 1, 2, 3, 4, 6, 9])):
            kind = self.random()
            out.append(f"<p>{self.text(18, 120)}</p>" if kind < 0.45 else f"<p>{self.text(1, self.choice([1, 4, 12]))}</p>" if kind < 0.63 else f"<p>{self.text(5, 30)} {self.link(1, 5)} {self.text(3, 30)}</p>" if kind < 0.76
                       else f"<h3>{self.text(1, 6)}</h3><p>{self.text(12, 60)}</p>" if kind < 0.84 else f"<ul><li>{self.text(1, 12)}<li>{self.text(2, 20)} {self.link(1, 2)}</ul>" if kind < 0.9
                       else f"<blockquote>{self.text(6, 40)}</blockquote>" if kind < 0.94 else f"<table><tr><td>{self.text(1, 4)}<td>{self.text(1, 6)}</table>" if kind < 0.97 else f"<p>{self.link(3, 14)}</p>")
        return out

    def told_by_text(self) -> str:
        """Surroundings whose text gives them away."""
        kind = self.randrange(6)
        if kind == 0:
            return "<ul>" + "".join(f"<li>{self.link(1, 4)}</li>" for _ in range(self.randint(2, 8))) + "</ul>"
        if kind == 1:
            return "<p>" + self.choice([" | ", " ", " &middot; "]).join(self.link(1, 3) for _ in range(self.randint(2, 7))) + "</p>"
        if kind == 2:
            return f"<p>{self.choice(['&copy; 2001 ', 'Copyright ', 'All rights reserved ', 'Imprint, privacy '])}{self.text(1, 8)}</p>"
        if kind == 3:
            return f"<h3>{self.text(1, 3)}</h3><p>{self.link(3, 12)}</p><p>{self.link(3, 12)}</p>"
        if kind == 4:
            return f"<div>{self.link(1, 2)}</div>"
        return f"<p>{self.text(1, 2)} {self.link(1, 3)} {self.link(1, 3)}</p>"

    def told_by_markup(self, inside: bool) -> str:
        """Surroundings that read like content: their tag or class tells."""
        body = "".join(f"<p>{self.text(*self.choice([(2, 8), (8, 30), (30, 80)]))}</p>" for _ in range(self.randint(1, 3)))
        if self.random() < 0.4:
            tag = self.choice(["aside", "footer", "nav"] if inside else ["aside", "footer", "nav", "header"])
            return f"<{tag} data-keep=n>{body}</{tag}>"
        if self.random() < 0.35:
            return f"<form data-keep=n><label>{self.text(1, 4)}</label>{body}<button>{self.text(1, 2)}</button></form>"
        names = self.choice(["ad", "ads top", "advert-box", "sponsored", "cookie-notice", "consent", "sidebar", "sidebar-left", "comments", "comment-list", "related", "share social", "newsletter-signup", "popup", "menu main", "site-footer", "widget", "nav-bar"])
        flat = self.text(2, 25) if self.random() < 0.5 else body
        tag = self.choice(["div", "div", "section"])
        return f"<{tag} {self.choice(['class', 'class', 'id'])}='{names}' data-keep=n>{flat}</{tag}>"

    def page(self) -> str:
        kind = self.random()
        parts = self.story(0.2 if kind < 0.38 else 0.03)
        many = self.random() < 0.85
        if self.random() < 0.06:
            return f"<body data-keep=y><{self.choice(['p', 'article', 'div'])}>{self.text(*self.choice([(1, 3), (2, 9), (20, 50)]))}</body>"
        inside = [self.told_by_markup(True) if self.random() < 0.7 else f"<p data-keep=n>{self.link(1, 3)} {self.link(1, 3)}</p>" for _ in range(self.choice([0, 0, 0, 1, 2]))] if many else []
        for x in inside:
            parts.insert(self.randint(min(1, len(parts)), len(parts)), x)
        if kind < 0.3:
            body = f"<article data-keep=y>{''.join(parts)}</article>"
        elif kind < 0.38:
            body = f"<main data-keep=y>{''.join(parts)}</main>"
        elif kind < 0.66:
            body = f"<div class='{self.choice(['content', 'post', 'story', 'c1', 'x-7 b', 'entry text', 'col-8', 'body-copy'])}' data-keep=y>{''.join(parts)}</div>"
        elif kind < 0.78:  # classes that mislead
            names = self.choice(["legal", "notice-board-history", "discussion", "top-story", "promo-history", "header-story", "menu-of-the-week-story", "search-for-meaning", "banner", "ad-libitum-music-notes"])
            parts += self.story() + [f"<p>{self.text(30, 90)}</p>"]
            tag = self.choice(["article", "div"])
            body = f"<{tag} data-keep=y><section class='{names}'>{''.join(parts)}</section></{tag}>"
        else:
            body = f"<div data-keep=y>{''.join(parts)}</div>"
        if (0.38 < kind < 0.66 or kind > 0.78) and self.random() < 0.4:  # articles beside the story that only lead elsewhere
            long = f"<p data-keep=y>{self.text(40, 90)}</p><p data-keep=y>{self.text(40, 90)}</p>"
            beside = "".join(f"<article><h3>{self.text(1, 6)}</h3><p>{self.text(3, 14)}</p>{self.link(1, 2)}</article>" for _ in range(self.randint(1, 3)))
            body = body + long + beside if self.random() < 0.5 else beside + long + body
        elif kind < 0.3 and self.random() < 0.3:  # loose text beside an article
            body += f"<p data-keep=y>{self.text(30, 60)}</p>".replace("data-keep=y", "data-keep=n") if len(parts) > 5 else ""
        around = [self.told_by_text() if self.random() < 0.6 else self.told_by_markup(False) if self.random() < 0.8 else
                  f"<div class='{self.choice(['notice', 'legal', 'banner', 'promo', 'alert', 'top'])}'>{self.text(2, 14)}</div>" for _ in range(self.randint(1, 5))] if many else []
        cut = self.randint(0, len(around))
        return f"<head><title>{self.text(2, 6)}</title></head><body>{''.join(around[:cut])}{body}{''.join(around[cut:])}</body>"


@cache
def pages() -> list[str]:
    return [_Draw(k).page() for k in range(N_PAGES)]


@cache
def labelled() -> tuple[np.ndarray, np.ndarray]:
    """The labelled table: features and 1 for content."""
    x, y = [], []
    for page in pages():
        found = blocks(page)
        x.append(features(found))
        y += [b.label == "y" for b in found]
    return np.concatenate([p for p in x if len(p)]), np.array(y, int)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 14, least: int = 4) -> tuple | float:
    """Tree of (feature, threshold, at most it, above it), by Gini gain (ties: the first feature, the lower threshold); leaves are shares of content, of at
    least `least` rows."""
    n, share = len(y), float(y.mean()) if len(y) else 0.0
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, hit = x[order, f], np.cumsum(y[order])
        k = np.arange(1, n)
        ok = (v[1:] > v[:-1]) & (k >= least) & (n - k >= least)
        if not ok.any():
            continue
        low, high = hit[:-1] / k, (hit[-1] - hit[:-1]) / (n - k)
        cost = np.where(ok, low * (1 - low) * k + high * (1 - high) * (n - k), np.inf)
        at = int(cost.argmin())
        if best is None or cost[at] < best[0] - 1e-9:
            best = (cost[at], f, float(v[at] + v[at + 1]) / 2)
    if best is None or best[0] > share * (1 - share) * n - 1e-9:
        return share
    _, f, t = best
    low = x[:, f] <= t
    return f, t, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


@cache
def tree() -> tuple | float:
    return grow(*labelled())


def is_content(row: np.ndarray, node: tuple | float) -> bool:
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node >= 0.5


def main_text(page: str | None, model: tuple | float | None = None) -> str:
    """Content blocks joined by line feeds; empty for null, empty or contentless pages."""
    found = blocks(page) if page else []
    if not found:
        return ""
    model = tree() if model is None else model
    return "\n".join(b.text for b, row in zip(found, features(found)) if is_content(row, model))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, kept columns, text, n_chars) of every row. Null html counts as empty; repeated rows give repeated rows; an empty table gives no rows; kept columns that are called
    like an output column are left out. No shuffle."""
    others = [c for c in keep if c in pages.columns and c not in (id_col, "text", "n_chars")]
    names = [id_col, *others, html_col]
    narrow = pages.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(names)))

    model = tree()  # grown once, on the driver

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(t, model) for t in b.column(len(names) - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*b.schema.names[:-1], "text", "n_chars"])

    schema = ", ".join([*(f"c{k} {narrow.schema[f'c{k}'].dataType.simpleString()}" for k in range(len(names) - 1)), "text string, n_chars long"])
    out = narrow.mapInArrow(run, schema)
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(names[:-1])), "text", "n_chars")
