"""HTML extraction by tag-path ratios.

A page is a sequence of text blocks, each with its root-to-leaf tag path, kept as a node of a trie. For every path the
lengths and the punctuation of its blocks are added up and divided by its number of nodes; the two ratios are smoothed
over neighbouring blocks and fused with what the path's parent holds in total. Paths that reach a threshold are content.
The deepest element that holds most of the content is the article's, or one around it that holds hardly anything else; all
of it is kept, short parts too, but lists of links without a heading of their own. Outside it, paths that reach the
threshold are kept. Where only the page as a whole holds most of the content, its parts are judged by their own ratios.

Elements that are never article text (navigation, scripts, what is not shown, ...) are left out by their tag, role or style
before that, and so is an element whose class or id speaks of what is around an article, however large it is, unless the
page has no other text, or it holds most of the page and the title or an article element in it. An article element raises
the score. A page is read in one pass: the work grows with its length, not with its depth.

Defined results: null or empty html and pages without a content path have an empty text; a quote that is never closed
ends its attribute at the tag's end; a tag that is cut off is left out up to the next tag; repeated rows are extracted
each; null page_id and url are kept; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from attesta.llm._common import prepare

#: A tag whose attributes are well formed; anything else goes through odd_tag().
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/><"'=]*+)((?:\s++[^\s"'<>/=]++(?:\s*+=\s*+(?:"[^"<>]*+"|'[^'<>]*+'|[^\s"'=<>`]++))?+)*+)\s*+(/?)>""")
NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
STEP = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)?+(\s*+=\s*+)?+")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
BODY = re.compile(r"</head\s*>|<body\b", re.I)
#: Elements whose content is no text, elements without content, and elements that open no block.
RAW = {"script", "style", "noscript", "template", "svg", "textarea", "iframe", "object", "canvas", "title", "head", "select", "audio", "video"}
VOID = set("area base col embed img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mover mrow msqrt msub msubsup msup mtext munder q rp rt ruby s samp semantics small span strike strong sub sup time tt u var".split())
#: Elements and roles that mark what is around an article.
AROUND = {"nav", "footer", "aside", "button", "menu", "dialog", "fieldset"}
AROUND_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "form"}
UNSHOWN = re.compile(r"(?i)(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)")
#: Words in class or id that speak of what is around an article whatever stands beside them, and words that do so only beside words of the second and third kind.
NAMED = set("nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead gdpr popup modal disqus newsletter pagination pager toolbar advert adverts advertisement advertising sponsored commentlist".split())
NAMED_BESIDE = set(
    "ad ads sponsor banner menu side widget widgets foot notice consent cookie cookies overlay comment comments respond reply replies share sharing social related recommended recommendations promo promos"
    " teaser teasers trending popular subscribe signup login search copyright legal disclaimer hidden".split()
)
BESIDE = set(
    "area bar block body bottom box btn button buttons center col column container content form group icon icons inner item items large left link links list main more outer page pane panel primary read right row"
    " secondary section site slot small sticky text top unit wrap wrapper article articles blog entry news post posts reader readers story stories thread user users global js".split()
)
HEADS = {"header", "head"}
ARTICLE = {"article", "main"}
#: Beginnings of class names that tell of a layout; the weight of articles; the share of a page that a wrapper holds, the share of the content that the article's element holds, the share of content in an element that hardly holds anything else, and that of links in a list of links.
LAYOUT = {"has", "no", "with", "without", "is", "not", "layout"}
ARTICLE_WEIGHT, MOST, HOLDS, PURE, LINKED = 1.25, 0.75, 0.6, 0.85, 0.8
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = set("article aside body div section main table ul ol dl nav footer header form blockquote td th figure html".split())
#: Elements that part a page, and the heads of sections.
PARTS = {"", "html", "body", "article", "main", "section", "div", "center", "form", "header"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words of headings over what is not the article, and words that stand beside them.
OFF_HEADINGS = set("more also next latest related recommended popular trending share comments follow subscribe newsletter".split())
OFF_BESIDE = set("read see you may might like us our from on in this the and to stories articles posts links reading topics news".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、؛؟]")
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Marks:
    """Where the characters stand that end tags and values, looked up by bisection; made for pages with odd tags only."""

    def __init__(self, html: str):
        self.at: dict[str, list[int]] = {c: [] for c in "<>\"'"}
        for m in re.finditer("[<>\"']", html):
            self.at[m[0]].append(m.start())

    def next(self, char: str, at: int) -> int | None:
        places = self.at[char]
        k = bisect_left(places, at)
        return places[k] if k < len(places) else None


def odd_tag(html: str, at: int, marks: Marks) -> tuple[int, str] | None:
    """The end of a tag whose name ends at `at`, and its attributes written plainly; None for a tag that is cut off.

    A quoted value that holds the end of a tag counts as one only if what follows it is the rest of a tag.
    """
    end, found = marks.next(">", at), []
    if end is None:
        return None
    while True:
        m = STEP.match(html, at)
        at = m.end()
        if at >= len(html):
            return None
        name = m[1] or ""
        if m[2] is None:
            if name:
                found.append(name)
            if html[at] == ">":
                return at + 1, " ".join(found)
            if not name:
                at += 1
            continue
        quote = html[at]
        if quote in "\"'":
            close, end = marks.next(quote, at + 1), marks.next(">", at)
            if close is not None and (end is None or close < end):
                fits = True
            elif close is not None:
                after, begin = marks.next(">", close), marks.next("<", close)
                fits = after is not None and (begin is None or after < begin) and html[close + 1 : close + 2] in (" ", "\t", "\n", "\r", "\f", "/", ">")
            else:
                fits = False
            if not fits:
                return None if end is None else (end + 1, " ".join(found))
            value, at = html[at + 1 : close], close + 1
        else:
            stop = at
            while stop < len(html) and html[stop] not in " \t\n\r\f>":
                stop += 1
            value, at = html[at:stop], stop
        if name and '"' not in value:
            found.append(f'{name}="{value}"')


def values_of(attributes: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(attributes):
        out.setdefault(name.lower(), value.strip("\"'"))
    return out


def around(tag: str, values: dict[str, str]) -> bool:
    """Whether an element holds what stands around an article."""
    if tag in AROUND:
        return True
    if not values or tag in ("body", "html"):
        return False
    return "hidden" in values or values.get("aria-hidden", "").lower() == "true" or values.get("role", "").lower() in AROUND_ROLES or "style" in values and UNSHOWN.search(values["style"]) is not None


def speaks_of_around(name: str) -> bool:
    """Whether one class or id speaks of what is around an article; a word of a subject beside it (social-science) or of a layout (has-sidebar) takes that back."""
    words = [w.lower() for w in WORDS.findall(name)]
    if not words or words[0] in LAYOUT:
        return False
    if NAMED & set(words):
        return True
    others = [w for w in words if w not in NAMED_BESIDE]
    if len(others) < len(words):
        return all(w in BESIDE or w in HEADS for w in others)
    return bool(HEADS & set(words)) and all(w in HEADS or w in {"page", "site", "main", "top", "global", "wrap", "wrapper", "container"} for w in words)


def heads_around(text: str) -> bool:
    """Whether a heading stands over what is around an article."""
    words = [w.lower() for w in WORDS.findall(text)] if len(text) < 60 else []
    return bool(OFF_HEADINGS & set(words)) and all(w in OFF_HEADINGS or w in OFF_BESIDE for w in words) or bool(words) and speaks_of_around(text)


def named_around(tag: str, values: dict[str, str]) -> bool:
    if tag in ("body", "html"):
        return False
    return tag == "form" or bool(values) and any(speaks_of_around(n) for kind in ("class", "id") for n in values.get(kind, "").split())


class Page:
    """The blocks of a page in order, the trie of their paths and the tree of elements named as around."""

    def __init__(self, html: str):
        self.steps, self.tags, self.parent, self.children = [""], [""], [0], {}  # the trie; node 0 is the page
        self.named_parent = [0]  # the tree of named elements; node 0 stands for none
        self.titled: set[int] = set()  # named elements with the page's title or an article element in them
        self.last_inside = [0]  # of each element that parts the page, in their order, the last one inside it
        self.blocks: list[tuple[int, str, int, int, int]] = []  # path, text, characters inside links, named element, part
        self.read(html)

    def node(self, parent: int, tag: str, step: str) -> int:
        key = (parent, step)
        if (at := self.children.get(key)) is None:
            at = self.children[key] = len(self.steps)
            self.steps.append(step)
            self.tags.append(tag)
            self.parent.append(parent)
        return at

    def read(self, html: str) -> None:
        # Open elements: tag, path, named element, whether around, whether in an article, the places below of the last block element and the last scope, and the part.
        stack: list[tuple[str, int, int, bool, bool, int, int, int]] = []
        open_at: dict[str, list[int]] = defaultdict(list)
        held: list[str] = []
        linked, links, at, size = 0, 0, 0, len(html)
        marks: Marks | None = None
        unended: set[str] = set()

        def close() -> None:
            nonlocal held, linked
            if held:
                text = SPACE.sub(" ", entities.unescape("".join(held))).strip()
                if text:
                    _, path, named, _, _, _, _, part = stack[-1] if stack else ("", 0, 0, False, False, -1, -1, 0)
                    self.blocks.append((path, text, min(linked, len(text)), named, part))
            held, linked = [], 0

        def add(text: str) -> None:
            nonlocal linked
            if text and not (stack and stack[-1][3]):
                held.append(text)
                if links:
                    linked += len(text)

        def cut(depth: int) -> None:
            nonlocal links
            while len(stack) > depth:
                tag, *_, part = stack.pop()
                open_at[tag].pop()
                if tag in PARTS:
                    self.last_inside[part] = len(self.last_inside) - 1
                links -= tag == "a"

        while at < size:
            begin = html.find("<", at)
            if begin < 0:
                add(html[at:])
                break
            if begin > at:
                add(html[at:begin])
            m = TAG.match(html, begin)
            if m:
                at, ends, tag, attributes, alone = m.end(), m[1], m[2].lower(), m[3], bool(m[4])
            else:
                after = html[begin + 1 : begin + 2]
                if after == "!" or after == "?":
                    mark = "-->" if html.startswith("<!--", begin) else "]]>" if html.startswith("<![CDATA[", begin) else ">"
                    end = html.find(mark, begin + 2)
                    at = size if end < 0 else end + len(mark)
                    continue
                m = NAME.match(html, begin)
                if not m:
                    add("<")
                    at = begin + 1
                    continue
                marks = marks or Marks(html)
                got = odd_tag(html, m.end(), marks)
                if got is None:
                    at = marks.next("<", begin + 1) or size
                    continue
                at, ends, tag, attributes, alone = got[0], m[1], m[2].lower(), got[1], html[got[0] - 2] == "/"
            if tag == "br":
                add(" ")
                continue
            if tag == "hr":
                close()
                continue
            if tag in VOID:
                continue
            inline = tag in INLINE
            if ends:
                places = open_at.get(tag)
                if not places:
                    if tag == "p":
                        close()
                    continue  # an end tag without its start
                depth = places[-1]
                if inline and stack[-1][6] >= depth:
                    continue  # its start stands outside the element
                if stack[-1][5] >= depth:
                    close()
                cut(depth)
                continue
            if tag in RAW:
                if tag == "head":
                    close()
                    end = None if tag in unended else BODY.search(html, at)
                    if end is None:
                        unended.add(tag)
                    else:
                        at = end.start() if end[0].lower().startswith("<body") else end.end()
                elif tag not in unended:
                    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                    if end is None:
                        unended.add(tag)
                        at = size if tag in ("script", "style") else at
                    else:
                        at = end.end()
                continue
            values = values_of(attributes) if attributes else {}
            if not inline:
                last = max((open_at[t][-1] for t in CLOSES.get(tag, {"p"}) if open_at.get(t)), default=-1)
                close()
                if stack and last >= 0 and last >= stack[-1][6]:
                    cut(last)
                while stack and stack[-1][0] in INLINE and stack[-1][0] != "a":
                    cut(len(stack) - 1)  # an inline element left open ends with its block
            elif tag == "a":
                if "href" not in values:
                    continue
                if open_at["a"] and open_at["a"][-1] > stack[-1][6]:
                    cut(open_at["a"][-1])
            if alone and tag not in ("p", "div", "article", "section"):
                continue
            _, path, named, under, article, block, scope, part = stack[-1] if stack else ("", 0, 0, False, False, -1, -1, 0)
            place = len(stack)
            if inline:
                under = under or bool(values) and around(tag, values)
            else:
                step = tag
                if tag in ("div", "section", "td"):
                    kind = values.get("class") or values.get("id") or values.get("role") or ""
                    step = f"{tag}.{'.'.join(kind.split())}" if kind else tag
                path, block = self.node(path, tag, step), place
                under = under or tag == "header" and not article or around(tag, values)
                article = article or tag in ARTICLE
                scope = place if tag in SCOPES else scope
                if tag in PARTS:
                    part = len(self.last_inside)
                    self.last_inside.append(1 << 60)  # until it ends
                if not under and named_around(tag, values):
                    self.named_parent.append(named)
                    named = len(self.named_parent) - 1
                elif not under and (tag == "h1" or tag in ARTICLE):
                    self.titled.add(named)
            stack.append((tag, path, named, under, article, block, scope, part))
            open_at[tag].append(place)
            links += tag == "a"
        close()


def path_ratio(length: np.ndarray, points: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Characters for each node of a path, weighted by the punctuation marks for each node."""
    n = np.maximum(nodes, 1)
    return length / n * np.log1p(1 + points / n)


def smoothed(ratio: np.ndarray) -> np.ndarray:
    """Over two neighbouring blocks on each side."""
    kernel = np.array([1, 2, 4, 2, 1], dtype=float)
    padded = lambda x: np.concatenate([np.zeros(2), x, np.zeros(2)])
    return np.convolve(padded(ratio), kernel, "valid") / np.convolve(padded(np.ones(len(ratio))), kernel, "valid")


def main_text(html: str | None, threshold: float = 0.25) -> str:
    """The content blocks joined by a blank line."""
    page = Page(html or "")
    if not page.blocks:
        return ""
    paths, parents, tags = len(page.steps), page.parent, page.tags
    at = np.array([b[0] for b in page.blocks])
    chars, linked = np.array([len(b[1]) for b in page.blocks], dtype=float), np.array([b[2] for b in page.blocks], dtype=float)
    named = np.array([b[3] for b in page.blocks])
    # Named elements are sides, but for wrappers: they hold most of the page and its title or article.
    inside_named, titled = np.bincount(named, chars, len(page.named_parent)), page.titled
    for k in range(len(inside_named) - 1, 0, -1):
        inside_named[page.named_parent[k]] += inside_named[k]
        if k in titled:
            titled.add(page.named_parent[k])
    sides = np.zeros(len(inside_named), dtype=int)
    for k in range(1, len(sides)):
        sides[k] = sides[page.named_parent[k]] + (k not in titled or inside_named[k] < MOST * chars.sum())
    sides = sides[named]
    weight = (sides == sides.min()).astype(float)
    own = np.maximum(0, chars - linked) * weight
    points = np.array([len(PUNCTUATION.findall(b[1])) for b in page.blocks], dtype=float)
    length, marks, nodes = np.bincount(at, own, paths), np.bincount(at, points, paths), np.bincount(at, minlength=paths).astype(float)
    in_links, all_chars = np.bincount(at, linked, paths), np.bincount(at, chars, paths)
    # What each element of the trie holds with all below it: children come after their parents.
    below = [length.copy(), marks.copy(), nodes.copy()]
    for x in below:
        for k in range(paths - 1, 0, -1):
            x[parents[k]] += x[k]
    total, whole = below[0], max(1.0, length.sum())
    ratio = path_ratio(length, marks, nodes)[at]
    top = ("", "html", "body")
    share = np.array([0.0 if tags[parents[k]] in top else total[parents[k]] / whole for k in range(paths)])
    article, depth, part = [False] * paths, [0] * paths, [0] * paths
    for k in range(1, paths):
        article[k] = article[parents[k]] or tags[k] in ARTICLE
        depth[k] = depth[parents[k]] + 1
        part[k] = k if tags[k] in PARTS else part[parents[k]]
    fused = smoothed(ratio) * (0.5 + share[at]) * weight * np.where(np.array(article)[at], ARTICLE_WEIGHT, 1.0)
    best = np.zeros(paths)
    np.maximum.at(best, at, fused)
    bar = threshold * best.max()
    if bar <= 0:
        return ""
    # The article's element: the deepest part that holds most of the content, or one around it that holds hardly anything else.
    content, every = np.bincount(at, own * (fused >= bar), paths), np.bincount(at, chars * weight, paths)
    for x in (content, every):
        for k in range(paths - 1, 0, -1):
            x[parents[k]] += x[k]
    holder = max((k for k in range(paths) if tags[k] in PARTS and content[k] >= HOLDS * content[0]), key=lambda k: depth[k], default=0)
    outer = holder
    while tags[outer := parents[outer]] not in top:
        if tags[outer] == "article" or tags[outer] in PARTS and content[outer] >= PURE * every[outer]:
            holder = outer
    good = [False] * paths
    good[holder] = True
    if tags[holder] in top:
        part_ratio = path_ratio(*below)
        for k in range(holder + 1, paths):
            good[k] = good[parents[k]] and (tags[k] not in PARTS or part_ratio[k] >= threshold * part_ratio[holder])
    else:
        for k in range(holder + 1, paths):
            good[k] = good[parents[k]]
    keep = (weight > 0) & (np.array(good)[at] | (fused >= bar))
    of_links = in_links >= LINKED * np.maximum(all_chars, 1)
    heading, off = None, None  # the heading right before a list of links; the part with a heading over what is not the article
    for i, (path, text, _, _, part) in enumerate(page.blocks):
        if not keep[i]:
            continue
        tag = tags[path]
        if off is not None and off <= part <= page.last_inside[off] and not (tag in HEADINGS and not heads_around(text)):
            keep[i] = False
        elif tag in HEADINGS and tag != "h1":
            heading, off = i, part if heads_around(text) and tags[parents[path]] in PARTS and parents[path] != holder and tags[parents[path]] not in (*top, *ARTICLE) else None
            keep[i] = off is None
        elif of_links[path] and tag != "p":
            if heading is None or heads_around(page.blocks[heading][1]):
                keep[i] = False
                if heading is not None:
                    keep[heading] = False
        else:
            heading = off = None
    return "\n\n".join(b[1] for b, yes in zip(page.blocks, keep) if yes)


def extract_main_text(pages: DataFrame, threshold: float = 0.25) -> DataFrame:
    """pages (page_id, url, html, ...): page_id, url, text, n_chars."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, threshold) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
