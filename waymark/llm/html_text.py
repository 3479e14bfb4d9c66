"""Main text of web pages by tag-path ratios.

A page is read once into blocks of text. Blocks are grouped by the path of containers from the root to them (a paragraph, a heading or a list
item counts with the container that it stands in). For every path the length of its text outside links and its punctuation are set
against its number of blocks; both ratios are smoothed along the page, so that a short paragraph among long ones doesn't fall out, and fused by
their product. A path inside a container of text has the container's value at least, as nothing of an article may be dropped for being short. It is
weighed by the share of the path's text outside links, but for a path in a container of text that has no more blocks of links than the container has blocks of text, and a path
inside an article has the best value of the article, unless it is a list in a div of its own that holds links only, more of them than the article has blocks of text: so references and tables of links stay and farms of links fall. Paths that reach a share of the best one are content.
Elements that are never the article (menus, page headers and footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) are left
out before, and where the page marks its article or main part, only paths inside are weighed. Time is linear in the page, whatever it holds.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from waymark.llm.common import map_texts

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""")
#: The same where quotes aren't closed.
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
#: A name, whole, and its value.
ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s"'>][^\s>]*)))?|"[^"]*"|'[^']*'""")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")

RAW = {"script", "style", "textarea", "title", "xmp", "noframes"}
VOID = {"area", "base", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "br", "keygen", "frame", "basefont"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Blocks that count with the container they stand in.
LEAVES = set("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption address details summary center hgroup picture".split())
#: Those among them that have a path of their own, as links come in lists.
LISTS = {"ul", "ol", "dl", "table"}
NEVER = set("nav footer aside script style noscript template button select option datalist textarea iframe object embed svg canvas video audio dialog menu head frameset noframes".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
#: Outside an article, words in a container's class or id that mark what isn't the article.
MARKS = set(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox sponsor sponsored promo promotion menu menus nav navbar navigation breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar"
    " cookie cookies consent gdpr notice notices alert banner popup modal overlay newsletter subscribe signup login paywall disclaimer comment comments commentlist reply replies respond disqus discussion"
    " share sharing social related recommended pagination pager widget".split()
)
#: Containers that a class can mark inside an article, and the whole classes that mark them there; ids, which are often made from headings, only of a div and only these.
CONTAINERS, IDS = {"div", "section", "ul", "ol"}, {"comments", "respond", "disqus_thread"}
CLASSES = set(
    "ad ads advert advertisement adsense adslot ad-slot adbox sponsored promo menu nav navbar navigation breadcrumb breadcrumbs sidebar toolbar cookie-notice cookie-banner cookies gdpr consent popup modal overlay"
    " newsletter newsletter-signup subscribe signup paywall comments comment-list commentlist comments-area respond disqus disqus_thread share sharing share-buttons social social-share social-links social-media"
    " related related-posts related-articles recommended pagination pager widget".split()
)
#: Words that make such a class together with words for a box, and words for one that goes if a block in it counts comments.
PARTS = set("ad ads advert adverts advertisement advertising adsense sponsor sponsors sponsored promo promos promotion promotions comment comments reply replies discussion discussions disqus share sharing subscribe newsletter paywall".split())
BOXES = set("box boxes container block blocks slot slots unit units wrapper wrap outer inner area section banner thread threads list panel widget form footer header bar wall stream zone frame holder article post entry page site user reader".split())
WEAK = set("feedback reactions responses reviews opinions".split())
COUNTED = re.compile(r"\(?\d[\d.,]*\)?\s*(?:comments?|replies|responses|reactions|kommentare?|antworten|commentaires?|réponses?|comentarios?|respuestas?)\b", re.IGNORECASE)
#: What a class can say before that the part belongs to the article.
OWNER = re.compile(r"^(?:article|post|entry|page|site|user|reader)[-_]+")
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SHARE = 0.15


def named(attributes: str) -> dict[str, str]:
    """The attributes of a tag by their whole names, in lower case; the first of a name counts."""
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        if name:
            out.setdefault(name.lower(), html.unescape(a or b or c).lower())
    return out


def never(tag: str, attributes: str, inside: bool) -> bool:
    """True if an element is left out with all it holds; inside: it stands in an article or main part."""
    if tag in NEVER or tag == "header" and not inside:
        return True
    if not attributes.strip():
        return False
    has = named(attributes)
    if "hidden" in has or has.get("aria-hidden", "").strip() == "true" or re.search(r"display\s*:\s*none", has.get("style", "")):
        return True
    if has.get("role", "").strip() in ROLES:
        return True
    classes, name = has.get("class", "").split(), has.get("id", "")
    whole = {OWNER.sub("", c) for c in classes}
    if tag in ("html", "body", "article", "main"):
        return tag == "article" and inside and not {"comment", "comment-body"}.isdisjoint(classes)
    if inside:
        return tag in CONTAINERS and (not CLASSES.isdisjoint(whole) or any(boxed(c) for c in classes) or tag == "div" and name in IDS)
    if tag in INLINE or tag in LEAVES and tag not in CONTAINERS:
        return not CLASSES.isdisjoint(whole)
    words = set(re.split(r"[^a-z]+", " ".join([*classes, name if tag != "section" or name in CLASSES else ""])))
    return not words.isdisjoint(MARKS) or "header" in words and tag not in LEAVES


def boxed(name: str) -> bool:
    """Whether a class is made of words for what isn't the article and for boxes only."""
    parts = set(re.split("[-_]+", name))
    return not parts.isdisjoint(PARTS) and parts <= PARTS | BOXES


def weak(attributes: str) -> bool:
    return bool(attributes) and not WEAK.isdisjoint(re.split(r"[-_\s]+", named(attributes).get("class", "")))


def signature(attributes: str) -> str:
    """The class and id of an element without digits, which tells apart containers of one tag."""
    return "".join(f".{re.sub('[0-9]+', '', value)}" for name, value in named(attributes).items() if name in ("class", "id")) if attributes else ""


def tokens(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(text, opening or closing tag or "", tag's name, attributes) of a page in order: text up to a tag, then the tag.

    Each tag is looked for once. Past the last `>` all is text; once a tag's quotes turned out not to be closed to the end, tags end at the next `>`.
    """
    at, n, last, cdata, pattern = 0, len(page), page.rfind(">"), page.rfind("]]>"), TAG
    while at < n:
        begin = page.find("<", at)
        if begin >= 0 and page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            yield page[at:begin], "", "", ""
            at = end + 3 if end >= 0 else n
            continue
        if begin < 0 or begin > last:
            break
        if page[begin + 1 : begin + 2] in ("!", "?"):
            text = page[at:begin]
            if page.startswith("<![CDATA[", begin) and begin < cdata:
                at = page.find("]]>", begin)
                yield text, "", "", ""
                text = html.escape(page[begin + 9 : at], quote=False)
                at += 3
            else:
                at = page.find(">", begin) + 1
            yield text, "", "", ""
            continue
        m = pattern.match(page, begin)
        if m is None and pattern is TAG and (m := LOOSE_TAG.match(page, begin)):
            pattern = LOOSE_TAG
        if m is None:
            yield page[at : begin + 1], "", "", ""
            at = begin + 1
            continue
        tag = m[2].lower()
        yield page[at:begin], m[1] or "<", tag, m[3]
        at = m.end()
        if tag in RAW and not m[1]:
            end = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else n
    yield page[at:], "", "", ""


class Block:
    __slots__ = ("path", "parts", "linked", "inside")

    def __init__(self, path: int, inside: bool):
        self.path, self.parts, self.linked, self.inside = path, [], 0, inside


def blocks(page: str) -> tuple[list[tuple[int, str, int, bool]], list[int], list[str]]:
    """(number of the path, text, characters in links, in an article) of every block of a page that isn't left out, in order; by number, the path's parent and its last tag, `?` before it if its class is weak."""
    out: list[tuple[int, str, int, bool]] = []
    numbers: dict[tuple[int, str], int] = {(-1, ""): 0}
    parents, tags = [-1], [""]
    # of every open element: tag, left out, inside an article, number of the path of containers
    stack: list[tuple[str, bool, bool, int]] = [("", False, False, 0)]
    open_: Counter[str] = Counter()
    block, links = None, 0

    def flush():
        nonlocal block, links
        if block is not None:
            text = " ".join("".join(block.parts).split())
            if text:
                out.append((block.path, text, min(block.linked, len(text)), block.inside))
        block, links = None, 0

    def text(s: str):
        nonlocal block
        top = stack[-1]
        if top[1] or not s:
            return
        if block is None:
            if s.isspace():
                return
            block = Block(top[3], top[2])
        s = html.unescape(s) if "&" in s else s
        block.parts.append(s)
        if links:
            block.linked += len(s.strip())

    def pop():
        open_[stack.pop()[0]] -= 1

    for before, kind, tag, attributes in tokens(page):
        text(before)
        if not kind:
            continue
        if tag == "br":
            text(" ")
        elif kind == "/":
            if tag == "a":
                links = max(0, links - 1)
            if tag not in INLINE:
                flush()
            if open_[tag] and tag in INLINE:
                k = len(stack) - 1
                while stack[k][0] in INLINE and stack[k][0] != tag:
                    k -= 1
                while stack[k][0] == tag and len(stack) > k + 1:
                    pop()
                if stack[k][0] == tag:
                    pop()
            elif open_[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
        else:
            out_of, inside = stack[-1][1], stack[-1][2]
            if tag in INLINE:
                if not out_of and attributes and tag not in VOID and never(tag, attributes, inside):
                    stack.append((tag, True, inside, stack[-1][3]))
                    open_[tag] += 1
                elif tag == "a" and not attributes.rstrip().endswith("/"):
                    links += 1
                continue
            flush()
            while stack[-1][0] == "p" or stack[-1][0] in CLOSES.get(tag, ()) or stack[-1][0] in INLINE and open_["p"]:
                pop()
            if tag in VOID or tag in RAW:
                continue
            out_of, inside, path = stack[-1][1:]
            marks = tag in ("article", "main") or "role" in attributes.lower() and named(attributes).get("role", "").strip() == "main"
            if marks and out_of and next(x[0] for x in stack if x[1]) == "form":
                out_of = False  # a form around the whole page
            out_of = out_of or tag == "form" or never(tag, attributes, inside or marks and tag != "article")
            if attributes.rstrip().endswith("/") and tag in ("svg", "path"):
                continue
            if tag not in LEAVES or tag in LISTS:
                key = path, tag + signature(attributes)
                if key not in numbers:
                    numbers[key] = len(parents)
                    parents.append(path)
                    tags.append("?" + tag if weak(attributes) else tag)
                path = numbers[key]
            stack.append((tag, out_of, inside or marks, path))
            open_[tag] += 1
    flush()
    return out, parents, tags


def smoothed(values: list[float]) -> list[float]:
    last = len(values) - 1
    return [(values[max(0, i - 1)] + 6 * v + values[min(last, i + 1)]) / 8 for i, v in enumerate(values)]


def reader_parts(found: list[tuple[int, str, int, bool]], parents: list[int], tags: list[str]) -> list[bool]:
    """By number whether a path is in a container with a weak name that holds a block which counts comments."""
    counts = [False] * len(parents)
    for path, text, _, _ in found:
        if COUNTED.match(text):
            counts[path] = True
    for p in range(len(parents) - 1, 0, -1):  # a parent's number is under its children's
        counts[parents[p]] |= counts[p]
    gone = [False] * len(parents)
    for p in range(1, len(parents)):
        gone[p] = gone[parents[p]] or tags[p][0] == "?" and counts[p]
    return gone


def content(found: list[tuple[int, str, int, bool]], parents: list[int], tags: list[str]) -> set[int]:
    """The numbers of the paths that are content."""
    sums: dict[int, list[float]] = {}
    for path, text, linked, _ in found:
        s = sums.setdefault(path, [0.0, 0.0, 0.0, 0.0, 0.0])
        for i, x in enumerate((len(text), linked, len(PUNCTUATION.findall(text)), 1, linked == len(text))):
            s[i] += x
    lengths = smoothed([(s[0] - s[1]) / s[3] for s in sums.values()])
    marks = smoothed([s[2] / s[3] for s in sums.values()])
    fused = {p: a * (1 + b) for p, a, b in zip(sums, lengths, marks, strict=True)}
    # what stands in the body itself isn't a container of text; of the nearest one that is, the blocks of text
    reached, texts = [0.0] * len(parents), [0.0] * len(parents)
    inside = {path for path, *_, i in found if i}
    for p in range(1, len(parents)):
        up = parents[p]
        holds = up in inside or tags[up].lstrip("?") not in ("", "html", "body")
        reached[p] = max(fused.get(p, 0.0), reached[up] if holds else 0.0)
        mine = sums[p][3] - sums[p][4] if p in sums else 0.0
        texts[p] = max(mine, texts[up] if holds else 0.0)
    all_texts = sum(s[3] - s[4] for s in sums.values())

    def farm(p: int) -> bool:
        return tags[p] in ("ul", "ol") and tags[parents[p]] == "div" and sums[p][4] == sums[p][3] > all_texts

    own = {p for p in inside if not farm(p)}
    article = max((fused[p] for p in own), default=0.0)
    weighed = {}
    for p, s in sums.items():
        share = 1.0 if reached[p] > fused[p] and s[4] <= texts[p] else ((s[0] - s[1]) / s[0]) ** 2
        weighed[p] = article if p in own else max(reached[p], fused[p]) * share
    best = max(weighed.values(), default=0.0)
    return {p for p, w in weighed.items() if w >= SHARE * best}


def main_text(page: str | None) -> str:
    """The blocks of the content paths, each with its white space folded, one a line; empty if there are none."""
    found, parents, tags = blocks(page or "")
    if any(inside for *_, inside in found):
        found = [b for b in found if b[3]]
    gone = reader_parts(found, parents, tags)
    found = [b for b in found if not gone[b[0]]]
    paths = content(found, parents, tags)
    return "\n".join(text for path, text, _, _ in found if path in paths)


ADDED = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with text and n_chars (its code points). A null or empty page has an empty text. Whole pages; narrow, no shuffle."""

    def made(batch: list[str | None]) -> dict[str, list]:
        texts = [main_text(t) for t in batch]
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    return map_texts(pages, column, made, ADDED)
