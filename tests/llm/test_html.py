"""Main text against a second implementation over the standard library's parser, and the time of odd pages."""

import random
import time
from html.parser import HTMLParser

import pytest

from fuzzscan.llm import html

STOPS = sorted(html.STOP_WORDS)


class Plain(HTMLParser):
    """Blocks by events of another parser, of pages whose tags are well formed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.text, self.linked, self.link, self.leaf, self.head, self.up, self.raw = [], "", 0, False, False, False, [], 0

    def flush(self):
        if self.text.split():
            bad = any(b for _, b, _ in self.up) or self.leaf
            self.found.append(html.Block(" ".join(self.text.split()), self.linked, bad, any(i for *_, i in self.up), self.head))
        self.text, self.linked = "", 0

    def handle_starttag(self, tag, attrs):
        marked = any(w in html.BAD_WORDS for k, v in attrs if k in ("class", "id", "role") for w in html._PART.findall((v or "").lower()))
        if tag in html.RAW:
            self.raw += 1
            self.flush() if tag == "title" else None
        elif tag == "a":
            self.link = True
        elif tag == "br":
            self.text += " "
        elif tag in html.BLOCKS | html.BAD_TAGS:
            self.flush()
            self.link, self.leaf, self.head = False, tag in html.LEAVES and marked, len(tag) == 2 and tag[0] == "h" and tag != "hr"
            if tag not in html.LEAVES:
                inside = tag in html.ARTICLE_TAGS or any(i for *_, i in self.up)
                self.up.append((tag, tag in html.BAD_TAGS or tag == "header" and not inside or marked and tag not in {"html", "body"} | html.ARTICLE_TAGS, inside))

    def handle_endtag(self, tag):
        if tag in html.RAW:
            self.raw -= 1
        elif tag == "a":
            self.link = False
        elif tag in html.BLOCKS | html.BAD_TAGS and tag != "br":
            self.flush()
            self.link = self.leaf = self.head = False
            names = [t for t, *_ in self.up]
            if tag not in html.LEAVES and tag in names:
                del self.up[len(names) - 1 - names[::-1].index(tag) :]

    def handle_data(self, data):
        if not self.raw:
            self.text += data
            self.linked += len("".join(data.split())) if self.link else 0


def brute(page):
    """Blocks of Plain; every ambiguous one looks at all others."""
    parser = Plain()
    parser.feed(page)
    parser.close()
    parser.flush()
    found, first = parser.found, []
    for b in found:
        words = html._WORD.findall(b.text.lower())
        share = sum(w in html.STOP_WORDS for w in words) / max(1, len(words))
        b.near = len(b.text) >= html.SHORT and not b.heading and share >= html.LOW_STOPS
        if b.bad or b.linked > html.MOST_LINKED * len("".join(b.text.split())):
            first.append("bad")
        elif len(b.text) < html.SHORT or b.heading:
            first.append("")
        elif share >= html.HIGH_STOPS and len(b.text) >= html.LONG or b.inside and b.near:
            first.append("good")
        else:
            first.append("" if b.near or b.inside else "bad")
    n, out = len(found), []
    for i, b in enumerate(found):
        label = first[i]
        if not label:
            if b.inside:
                ends = [j for j in range(-1, n + 1) if j != i and (j in (-1, n) or not found[j].inside or first[j] == "good")]
                known = [(max(j for j in ends if j < i), "good"), (min(j for j in ends if j > i), "good")]
            else:
                some = [j for j in range(n) if first[j]]
                known = [(j, first[j]) for j in ([max((j for j in some if j < i), default=None)] if not b.heading else []) + [min((j for j in some if j > i), default=None)] if j is not None]
            least = min((abs(j - i) for j, _ in known), default=0)
            near = {x for j, x in known if abs(j - i) == least}
            label = "good" if near == {"good"} or near == {"good", "bad"} and (b.near or b.inside) else "bad"
        out += [b.text] if label == "good" else []
    return "\n".join(out)


def page(rng):
    word = lambda: rng.choice(STOPS) if rng.random() < 0.4 else rng.choice(["plain", "Words", "caf&eacute;", "x&amp;y", "12", "&#8364;5", "thing."])
    text = lambda n: " ".join(word() for _ in range(n))

    def piece(depth):
        kind = rng.randrange(9)
        mark = rng.choice(["", "", "", ' class="a b"', ' class="ad-box"', " id=comments", ' role="navigation"', ' data-x="a > b"'])
        if kind < 4 or depth > 4:
            inner = text(rng.choice([1, 3, 8, 25, 60]))
            if rng.random() < 0.3:
                inner += f' <a href="/x?a=1&amp;b=2">{text(rng.choice([1, 6, 30]))}</a> <b>{text(2)}</b>'
            tag = rng.choice(["p", "p", "h2", "li", "td"])
            return f"<{tag}{mark}>{inner}</{tag}>\n"
        if kind == 4:
            return rng.choice(["<script>var a = '<p>no</p>';</script>", "<style>p{}</style>", "<!-- <p>gone</p> -->", "<hr>", "<br>"])
        tag = rng.choice(["div", "div", "section", "article", "nav", "aside", "ul", "table", "footer", "header", "form"])
        return f"<{tag}{mark}>{''.join(piece(depth + 1) for _ in range(rng.randrange(5)))}</{tag}>"

    return f"<!DOCTYPE html><html><head><title>T</title></head><body>{''.join(piece(0) for _ in range(rng.randrange(1, 9)))}</body></html>"


def test_brute():
    rng = random.Random(4)
    some = 0
    for _ in range(2000):
        made = page(rng)
        want = brute(made)
        assert html.main_text(made) == want, made
        some += bool(want)
    assert some > 500


ODD = {
    "items": lambda n: "<ul>" + "<li>x y</li>" * n + "</ul>", "unclosed": lambda n: "<div>" * n + "</p></span></nav>" * n, "no end": lambda n: "<a " * n, "quotes": lambda n: '<a "' * n,
    "quoted ends": lambda n: '<a ">" ' * n, "both quotes": lambda n: "<a '>\" " * n, "names": lambda n: "<a<a" * n + ' ">', "declarations": lambda n: "<!" * n, "comments": lambda n: "<!--" * n,
    "scripts": lambda n: "<script>x" * n, "references": lambda n: "&amp" * n + "&#" * n, "paragraphs": lambda n: "<p>It is the one of all that has it.</p>" * n,
}


@pytest.mark.parametrize("kind", ODD)
def test_time(kind):
    """A page eight times as long takes about eight times as long, at a megabyte too."""
    def took(n):
        began = time.perf_counter()
        html.main_text(ODD[kind](n))
        return time.perf_counter() - began

    took(1000)
    small = min(took(4000) for _ in range(3))
    assert took(32000) < 30 * max(small, 0.004)
