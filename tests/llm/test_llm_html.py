"""Operator 7 on pages whose text stands in what often is furniture, on endless tags, and against an independent tree."""

import math
import random
import time
import xml.etree.ElementTree as ET

import pytest

from tidewindow.llm.html_text import main_text

NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/b">More of it</a></li></ul></nav>'
FOOT = "<footer>Copyright of the makers of this page</footer>"


def prose(k, n=60):
    r = random.Random(k)
    return " ".join(r.choice("harbour quiet lantern under the old bridge of rivers and meadows where people came".split()) for _ in range(n)) + "."


def paragraphs(*ks):
    return "".join(f"<p>{prose(k)}</p>" for k in ks)


def told(*ks):
    return "\n".join(prose(k) for k in ks)


@pytest.mark.parametrize(
    "page",
    [
        f'<body><form id="aspnetForm" action="x"><input type="hidden" name="state" value="1">{NAV}<div>{paragraphs(1, 2, 3)}</div>{FOOT}</form></body>',
        f"<body>{NAV}<form><article>{paragraphs(1, 2, 3)}</article><input name=q><button>Go</button></form>{FOOT}</body>",
        f"<body>{NAV}<article>{paragraphs(1)}<form><input type=hidden>{paragraphs(2)}</form>{paragraphs(3)}</article>{FOOT}</body>",
        f"<body>{NAV}<div role=dialog><article>{paragraphs(1, 2, 3)}</article></div>{FOOT}</body>",
        f"<body>{NAV}<dialog open><div>{paragraphs(1, 2, 3)}</div></dialog>{FOOT}</body>",
        f'<body>{NAV}<article>{paragraphs(1)}<section id="cookie-recipes">{paragraphs(2)}</section>{paragraphs(3)}</article>{FOOT}</body>',
        f'<body>{NAV}<article>{paragraphs(1)}<div class="ad-hoc">{paragraphs(2)}</div>{paragraphs(3)}</article>{FOOT}</body>',
        f'<body>{NAV}<article>{paragraphs(1)}<section class="notice-period">{paragraphs(2)}</section>{paragraphs(3)}</article>{FOOT}</body>',
        f'<body>{NAV}<article>{paragraphs(1)}<section id="share">{paragraphs(2)}</section>{paragraphs(3)}</article>{FOOT}</body>',
        f"<body>{NAV}<article>{paragraphs(1, 2)}</article><article>{paragraphs(3)}</article>{FOOT}</body>",
        f"<body>{NAV}<div><article>{paragraphs(1)}</article><article>{paragraphs(2, 3)}</article></div>{FOOT}</body>",
    ],
)
def test_text_within_what_may_be_furniture_stays(page):
    assert main_text(page) == told(1, 2, 3)


@pytest.mark.parametrize("n", [3, 5])
def test_a_short_second_article_stays(n):
    page = f"<body>{NAV}<article>{paragraphs(*range(n))}</article><article>{paragraphs(90)}</article>{FOOT}</body>"
    assert main_text(page) == told(*range(n), 90)


@pytest.mark.parametrize(
    "furniture",
    [
        '<form><label>Your name and where to write to you</label><input><label>Mail</label><input><textarea></textarea><button>Send it to us now</button></form>',
        f"<form><p>{prose(5, 20)}</p><input name=mail><input name=name><button>Subscribe</button></form>",
        '<section id="share"><a href="x">On this</a> <a href="y">On that</a></section>',
        '<div class="related"><a href="x">' + prose(6, 30) + "</a></div>",
        f'<div class="cookie-banner"><p>{prose(7, 40)}</p></div>',
        f'<section class="comments"><article class="comment"><p>{prose(8)}</p></article></section>',
        f'<div class="ad">{prose(9, 30)}</div>',
        f"<aside><p>{prose(10)}</p></aside>",
        f'<div hidden><p>{prose(11)}</p></div>',
        '<article class="teaser"><a href="z">' + prose(12, 30) + "</a></article>",
    ],
)
def test_furniture_goes(furniture):
    for page in (f"<body>{NAV}<article>{paragraphs(1, 2, 3)}</article>{furniture}{FOOT}</body>", f"<body>{NAV}<article>{paragraphs(1, 2)}{furniture}{paragraphs(3)}</article>{FOOT}</body>"):
        if "teaser" not in furniture or page.index("teaser") > page.index("</article>"):
            assert main_text(page) == told(1, 2, 3)


@pytest.mark.parametrize("part", ["<a ", "<!--", '<a b="', "<a/", "<a <", "</a", "</a ", "<?", "<![CDATA[", "<!", "<!-- -- "])
def test_endless_tags_take_linear_time(part):
    start = time.process_time()
    text = main_text(f"<body><p>{prose(1)}</p>" + part * 100_000)
    assert time.process_time() - start < 4
    assert text.startswith(prose(1)[:50])


def test_what_comes_before_an_open_end_stays():
    assert main_text(f"<p>{prose(1)}</p><p>{prose(2)}</p><a href='x") == told(1, 2)
    assert main_text(f"<p>{prose(1)}</p><!-- {prose(2)}") == prose(1)
    assert main_text(f"<p>{prose(1)} if a < b and 3 <4</p>") == f"{prose(1)} if a < b and 3 <4"


def random_page(r):
    def node(depth):
        if depth == 0 or r.random() < 0.3:
            text = prose(r.random(), r.choice([2, 8, 40, 90]))
            return f"<a>{text}</a>" if r.random() < 0.3 else f"<p>{text}</p>"
        return f"<{(t := r.choice(['div', 'section', 'ul']))}>" + "".join(node(depth - 1) for _ in range(r.randint(1, 4))) + f"</{t}>"

    return "<html><body>" + "".join(node(3) for _ in range(r.randint(1, 4))) + "</body></html>"


def independent(page):
    """The text by the densities of an ElementTree."""
    body = ET.fromstring(page).find("body")
    size = lambda e: len("".join("".join(e.itertext()).split()))
    links = lambda e: size(e) if e.tag == "a" else sum(size(a) for a in e.iter("a"))
    share = links(body) / max(1, size(body))

    def density(e):
        c, lc, t, lt = size(e), links(e), len(list(e.iter())) - 1, len(list(e.iter("a"))) - (e.tag == "a")
        if not c:
            return 0.0
        base = math.log(max(c / max(1, c - lc) * lc + share * c + math.e, math.e))
        return c / max(1, t) * max(0.0, math.log(max(c / max(1, lc) * max(1, t) / max(1, lt), 1.0)) / base)

    order, parent = [body], {}
    for e in order:
        order += list(e)
        parent |= dict.fromkeys(e, e)
    best = max(order, key=lambda e: sum(map(density, e)) or density(e))
    path = [best]
    while path[-1] is not body:
        path.append(parent[path[-1]])
    least = min(map(density, path))
    at = best
    while at is not body and parent[at] is not body and all(c is at or not size(c) or c.tag in ("p", "ul") and links(c) <= 0.3 * size(c) for c in parent[at]):
        at = parent[at]
    kept = {at}
    while at is not body:
        kept |= {c for c in parent[at] if c is not at and density(c) >= least > 0}
        at = parent[at]
    lines = []

    def walk(e, taken):
        taken = taken or e in kept
        block = e.tag != "a"
        if block:
            lines.append([])
        if taken and e.text:
            lines[-1].append(e.text)
        for c in e:
            walk(c, taken)
        if block:
            lines.append([])

    lines.append([])
    walk(body, False)
    return [t for line in lines if (t := "".join(line).strip())]


def test_an_independent_tree_finds_the_same_text():
    r = random.Random(8)
    for _ in range(400):
        page = random_page(r)
        assert "".join(main_text(page).split()) == "".join("".join(independent(page)).split())
