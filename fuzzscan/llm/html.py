"""Main text of web pages by two-pass block rules: stop-word density, length and link density classify blocks; ambiguous
ones inherit the label of the nearest decided neighbour."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

# Element names, words in class, id and role that mark parts which are no article, and stop words.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Blocks that end where the next begins; they are not kept open.
LEAVES = frozenset("p li h1 h2 h3 h4 h5 h6 hr dt dd td th tr caption option".split())
#: Elements whose content is no markup, and those whose text is never part of a page's text.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BAD_TAGS = frozenset("nav footer aside form head noscript template select button object svg canvas menu dialog".split())
ARTICLE_TAGS = frozenset("article main".split())
BAD_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disclaimer discussion footer gdpr login menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription teaser toolbar widget".split())
STOP_WORDS = frozenset(
    "a about after all also an and are as at be been but by can for from had has have he her his if in into is it its more no not of on one or our out she so than that the their them then there they this to up was we were what when which who will with would you your "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die ein eine einem einen einer er es für hat ich ihr im in ist ja man mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war wenn wie wir zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou où par pas plus pour qu que qui sa se ses son sont sur un une vous y "
    "al algo como con cual cuando de del desde donde el ella en entre era es esta este ha han hasta la las le les lo los más me mi muy no o para pero por que se sin sobre son su sus también un una uno y ya".split()
)
#: Below SHORT characters a block is ambiguous; from LONG on a block with many stop words is decided.
SHORT, LONG = 70, 200
LOW_STOPS, HIGH_STOPS, MOST_LINKED = 0.15, 0.25, 0.33

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_STOP = re.compile(r"""[>"']""")
_MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PART = re.compile(r"[a-z]+")
_WORD = re.compile(r"[^\W\d_]+")
RESULT = "page_id long, url string, text string, n_chars long"


@dataclass
class Block:
    text: str
    linked: int
    bad: bool
    inside: bool
    heading: bool = False
    label: str = ""
    near: bool = False


def _marked(attributes: str) -> bool:
    """Whether class, id or role has a word of BAD_WORDS."""
    return any(w in BAD_WORDS for m in _MARK.finditer(attributes) for w in _PART.findall(m[1].lower()))


class Tags:
    """The tags of a page, in time proportional to its length whatever it holds. A tag ends at the first > outside of
    quotes, or if there is none at the first >; comments end at --> or with the page."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.dead: set[int] = set()  # quotes from which no > outside of quotes follows

    def _end(self, at: int) -> int:
        """Where a tag whose attributes begin at `at` ends."""
        opened, seek = [], at
        while m := _STOP.search(self.page, seek):
            if m[0] == ">":
                return m.start()
            if m.start() in self.dead:
                break
            opened.append(m.start())
            seek = self.page.find(m[0], m.end()) + 1
            if not seek:
                break
        self.dead.update(opened)
        return self.page.find(">", at)

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """Begin, end, name (empty for comments and declarations), whether it is an end tag, and attributes."""
        page, at = self.page, 0
        while 0 <= (begin := page.find("<", at)) <= self.last or page.startswith("<!--", begin) and begin >= 0:
            if page.startswith("<!--", begin):
                stop = page.find("-->", begin + 4)
                at = stop + 3 if stop >= 0 else len(page)
                moved = yield begin, at, "", False, ""
            elif page[begin + 1 : begin + 2] in ("!", "?"):
                at = page.find(">", begin) + 1
                moved = yield begin, at, "", False, ""
            elif m := _NAME.match(page, begin + 1):
                end = self._end(m.end())
                at = end + 1
                moved = yield begin, at, m[2].lower(), bool(m[1]), page[m.end() : end]
            else:
                at, moved = begin + 1, None
            if moved is not None:
                at = moved
                yield 0, 0, "", False, ""  # what send() returns


def blocks(page: str) -> list[Block]:
    """The blocks of text in page order, with the number of characters inside links, whether they stand in a part that
    is no article by its tag, class, id or role, and whether inside an article element."""
    out: list[Block] = []
    words: list[str] = []
    linked, in_link, leaf_bad, heading = 0, False, False, False
    open_: list[tuple[str, bool, bool]] = []  # name, bad, inside an article
    held: Counter[str] = Counter()  # names in open_
    at = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            t = html.unescape(raw) if "&" in raw else raw
            words.append(t)
            if in_link:
                linked += len("".join(t.split()))

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(words).split())
        if text:
            top = open_[-1] if open_ else ("", False, False)
            out.append(Block(text, linked, top[1] or leaf_bad, top[2], heading))
        words.clear()
        linked = 0

    tags = iter(Tags(page))
    for begin, stop, name, ending, attributes in tags:
        add(page[at:begin])
        at = stop
        if not name:
            continue
        if name in RAW and not ending:
            end = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            at = page.find(">", end.start()) + 1 or len(page) if end else len(page)
            tags.send(at)
            if name == "title":
                close()
            continue
        if name == "a":
            in_link = not ending
        elif name == "br":
            words.append(" ")
        elif name in BLOCKS or name in BAD_TAGS:
            close()
            in_link = leaf_bad = False
            heading = not ending and len(name) == 2 and name[0] == "h" and name != "hr"
            if name in LEAVES:
                leaf_bad = not ending and _marked(attributes)
            elif not ending:
                bad, inside = open_[-1][1:] if open_ else (False, False)
                inside = inside or name in ARTICLE_TAGS
                bad = bad or name in BAD_TAGS or name == "header" and not inside or name not in ("html", "body") and name not in ARTICLE_TAGS and _marked(attributes)
                open_.append((name, bad, inside))
                held[name] += 1
            elif held[name]:
                while True:
                    closed = open_.pop()[0]
                    held[closed] -= 1
                    if closed == name:
                        break
    add(page[at:])
    close()
    return out


def _sides(found: list[Block], order: range) -> dict[int, tuple[int, str]]:
    """For each ambiguous block the distance and label of the nearest decided one before it in this order; inside an
    article those that are bad do not count and its edge is a good one."""
    out, last, anchor = {}, None, order.start - order.step
    for i in order:
        b = found[i]
        if b.inside and not b.label:
            out[i] = abs(i - anchor), "good"
        elif not b.label and last is not None:
            out[i] = abs(i - last), found[last].label
        if not b.inside or b.label == "good":
            anchor = i
        if b.label:
            last = i
    return out


def classify(found: list[Block]) -> None:
    """First pass: parts that are no article and blocks of links are bad; long blocks with many stop words are good;
    short ones, and inside an article those with few stop words, are ambiguous. Second pass: an ambiguous block takes
    the label of the nearest decided block; an article's own edges count as decided good blocks next to its first and
    last one, bad parts inside it do not count. With neighbours as near on both sides, good wins for blocks that
    have some stop words or stand inside an article. A heading outside an article goes with what follows it."""
    for b in found:
        solid = len("".join(b.text.split()))
        if b.bad or b.linked > MOST_LINKED * solid:
            b.label = "bad"
            continue
        if len(b.text) < SHORT or b.heading:
            continue
        words = _WORD.findall(b.text.lower())
        density = sum(w in STOP_WORDS for w in words) / max(1, len(words))
        b.near = density >= LOW_STOPS
        if density >= HIGH_STOPS and len(b.text) >= LONG or b.inside and b.near:
            b.label = "good"
        elif not b.near and not b.inside:
            b.label = "bad"
    n = len(found)
    before, behind = _sides(found, range(n)), _sides(found, range(n - 1, -1, -1))
    for i in [i for i, b in enumerate(found) if not b.label]:
        b, distance = found[i], {"good": n + 1, "bad": n + 1}
        for side in (behind,) if b.heading and not b.inside else (before, behind):
            if i in side:
                d, label = side[i]
                distance[label] = min(distance[label], d)
        good, bad = distance["good"], distance["bad"]
        b.label = "good" if good < bad or good == bad <= n and (b.near or b.inside) else "bad"


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    classify(found)
    return "\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page, in one pass without a shuffle.

    Null and empty pages, and those without an article, give an empty text. A page takes time in proportion to its length,
    however long it is and whatever its tags; a block as near to a good as to a bad one is decided as classify() says. Repeated rows each get a row; null ids and
    urls are kept; an empty table gives none; other columns are ignored. Character references are decoded, white space
    inside a block is one space, blocks are joined by one newline."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = common.arrow_schema(RESULT)
        for batch in batches:
            for part in common.slices(batch, "html"):
                made = [main_text(t) for t in common.texts(part, "html")]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(made, pa.string()), pa.array([len(t) for t in made], pa.int64())], schema=schema)

    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "html").mapInArrow(run, RESULT)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(common.table(spark, sf_dir, "pages"))
