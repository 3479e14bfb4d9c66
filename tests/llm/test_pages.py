"""What of a page is its article: cases of the contract, and the ratios against a plain version of them on whole tables."""

import random

import pytest

from waymark.llm import html_text
from waymark.llm import queries as llm

R = random.Random(2)
PROSE = "A long sentence of an article, with some commas, and with a full stop. And another one, that is as long as the first."


def article(more):
    return f"<html><body><nav><a href=/>home</a></nav><article><h1>Title</h1><p>{PROSE}</p>{more}<p>{PROSE}</p></article><footer>foot</footer></body></html>"


@pytest.mark.parametrize(("markup", "text"), [
    ("<ul><li><a href=1>First reference title</a></li><li><a href=2>Second title</a></li></ul>", "First reference title\nSecond title"),
    ("<table><tr><td><a href=1>Berlin</a></td><td><a href=2>Paris</a></td></tr><tr><td><a href=3>Rome</a></td><td>12</td></tr></table>", "Berlin\nParis\nRome\n12"),
    ("<section><p><a href=1>One link only</a></p></section>", "One link only"),
    ('<section id="related-work"><h2 id="social-history">Related work</h2><p id="promotion">Short.</p></section>', "Related work\nShort."),
    ('<div class="comment-on-method"><p>Kept.</p></div>', "Kept."), ('<div class="user-feedback"><p>Users told us about it.</p></div>', "Users told us about it."),
    *[(f"<div class={c}>" + "".join(f"<p><a href={i}>Link {i}</a></p>" for i in range(30)) + "</div>", "\n".join(f"Link {i}" for i in range(30))) for c in ("index", "refs")],
])
def test_nothing_of_an_article_is_lost(markup, text):
    assert html_text.main_text(article(markup)) == f"Title\n{PROSE}\n{text}\n{PROSE}"


@pytest.mark.parametrize("markup", [
    '<div class="advert-box">Buy this now, it is good.</div>', '<div class="ad-container"><p>Buy.</p></div>', '<section class="promo-block"><p>Half price!</p></section>', '<ol class="comment-thread"><li>Nice.</li></ol>',
    '<section class="user-feedback"><h3>3 Comments</h3><p>I liked it a lot, thanks, really.</p></section>', '<div class="post-comments-section"><p>Me too.</p></div>', '<div class="sponsored_content-box ad_slot">x</div>',
    '<div class="reactions"><div><h4>12 Antworten</h4></div><ul><li>Gut!</li></ul></div>', '<form><p>Your name</p></form>',
])
def test_what_goes(markup):
    assert html_text.main_text(article(markup)) == f"Title\n{PROSE}\n{PROSE}"


@pytest.mark.parametrize("head", ["<html><body>", "<body>", ""])
def test_optional_tags(head):
    page = f"{head}<div id=content><p>{PROSE}</p><div class=quote><p>Short.</p></div><p>{PROSE}</p><ul><li><a href=1>See also</a></li></ul></div><div class=list>" + "".join(f"<p><a href={i}>Page {i}</a></p>" for i in range(20)) + "</div>"
    assert html_text.main_text(page) == f"{PROSE}\nShort.\n{PROSE}\nSee also"


def plain_text(page):
    """The same from the blocks of a page, with every quantity worked out from its definition."""
    found, parents, tags = html_text.blocks(page)
    if any(b[3] for b in found):
        found = [b for b in found if b[3]]

    def under(path, top):
        while path != -1:
            if path == top:
                return True
            path = parents[path]
        return False

    weak = [p for p in range(1, len(parents)) if tags[p].startswith("?") and any(under(b[0], p) and html_text.COUNTED.match(b[1]) for b in found)]
    found = [b for b in found if not any(under(b[0], p) for p in weak)]
    order = list(dict.fromkeys(b[0] for b in found))
    mine = {p: [b for b in found if b[0] == p] for p in order}
    inside = {b[0] for b in found if b[3]}
    marked = set(inside)

    def ratio(p, measure):
        return sum(map(measure, mine[p])) / len(mine[p])

    def smooth(p, measure):
        i = order.index(p)
        around = order[max(0, i - 1)], p, order[min(len(order) - 1, i + 1)]
        return (ratio(around[0], measure) + 6 * ratio(p, measure) + ratio(around[2], measure)) / 8

    fused = {p: smooth(p, lambda b: len(b[1]) - b[2]) * (1 + smooth(p, lambda b: len(html_text.PUNCTUATION.findall(b[1])))) for p in order}

    def chain(p):
        yield p
        while (up := parents[p]) > -1 and p > 0 and (up in marked or tags[up].lstrip("?") not in ("", "html", "body")):
            yield up
            p = up

    def weight(p):
        best = max(fused.get(c, 0.0) for c in chain(p))
        links = sum(b[2] == len(b[1]) for b in mine[p])
        texts = max(sum(b[2] < len(b[1]) for b in mine.get(c, ())) for c in chain(p))
        if p in inside:
            return max(fused[q] for q in inside)
        if best > fused[p] and links <= texts:
            return best
        size = sum(len(b[1]) for b in mine[p])
        return best * ((size - sum(b[2] for b in mine[p])) / size) ** 2

    texts = sum(b[2] < len(b[1]) for b in found)
    farms = {p for p in order if tags[p] in ("ul", "ol") and tags[parents[p]] == "div" and all(b[2] == len(b[1]) for b in mine[p]) and len(mine[p]) > texts}
    inside -= farms
    weights = {p: weight(p) for p in order}
    return "\n".join(b[1] for b in found if weights[b[0]] >= html_text.SHARE * max(weights.values()))


def farm(k):
    """A page without a marked article: text, farms of links, short and long containers, in any order and depth."""
    def part(depth):
        kind = R.randint(0, 4)
        if kind == 0 and depth < 4:
            return f"<div class=c{R.choice('abc')}>{''.join(part(depth + 1) for _ in range(R.randint(1, 4)))}</div>"
        if kind == 1:
            return "<ul>" + "".join(f"<li><a href={i}>Link number {i}</a></li>" for i in range(R.randint(1, 9))) + "</ul>"
        if kind == 2:
            return "<p>Short.</p>"
        return f"<p>{' '.join(PROSE.split()[: R.randint(2, 24)])} <a href=x>{R.choice(['', 'a link'])}</a></p>"

    return f"{R.choice(['<html><body>', '<body>', '', '<body><article>'])}{''.join(part(0) for _ in range(R.randint(2, 9)))}"


def test_ratios_decide_on_pages_with_farms(monkeypatch):
    pages = [farm(k) for k in range(200)]
    texts = [html_text.main_text(p) for p in pages]
    assert texts == [plain_text(p) for p in pages]
    monkeypatch.setattr(html_text, "SHARE", 0.0)
    assert sum(html_text.main_text(p) != t for p, t in zip(pages, texts, strict=True)) > 50


def test_registered_query(spark, sf):
    rows = {r.page_id: r for r in llm.op10_html_text(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        assert (rows[p.page_id].url, rows[p.page_id].text, rows[p.page_id].n_chars) == (p.url, plain_text(p.html or ""), len(plain_text(p.html or "")))
