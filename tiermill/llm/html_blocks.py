"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one labels a block from its stop-word density, its length and its link
density, and from the containers around it. Pass two gives every undecided block the label of its nearest decided
neighbours. Containers are known by their tags or by words in their class, id and role; such a word does not count where the
container holds most of the page, and a marked article does not where it is a teaser beside the text. In a language without
known stop words a long block with sentences is undecided, not bad.

Defined cases: null, empty or text-free html gives an empty text; a page may be cut off anywhere; comments, scripts, styles,
form fields, embedded objects and hidden parts carry no text; very long pages are read whole; repeated pages give repeated
rows; of two neighbours at one distance the good one decides; extra columns of whatever name are kept.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermill.llm.common import carried, own, restored

# Common function words of the languages that pages are expected in.
STOP_WORDS = frozenset(
    """
    a an and are as at be but by for from had has have he her his i in is it not of on or she that the their they this
    to was we were which with you
    au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas pour qui
    que sa se ses son sont sur un une vous
    als am auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im ist mit nach
    nicht oder sich sie sind und von war wie wird zu zum zur
    al como con del el ella en era es ese esta este la las lo los más me no o para pero por se sin su sus también te
    una uno y ya
    """.split()
)
# Tags that never end a block; tags whose content is never text; tags that hold no article text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr br".split()
)
SKIPPED = frozenset(
    "script style noscript template textarea select svg math iframe object canvas audio video title button".split()
)
BOILERPLATE = frozenset("nav footer aside form dialog menu".split())
ARTICLE = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words in class, id or role that mark a container as no part of the article.
MARKERS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted banner nav navbar navigation "
    "menu menubar breadcrumb breadcrumbs sidebar widget widgets footer comment comments commentlist disqus reply "
    "replies cookie cookies consent notice notices gdpr alert popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social related recommended recommendations search pagination pager contentinfo "
    "complementary".split()
)
PAGE_MARKERS = frozenset("header masthead topbar".split())

_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDES = re.compile(r"\bstyle\s*=\s*[\"']?[^\"'>]*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_BARE = re.compile(r"(?:^|\s)hidden(?=[\s/=]|\Z)", re.I)
_SENTENCE = re.compile(r"[.,;:!?](?=\s|\Z)|[\u3001\u3002\uff01\uff0c\uff1b\uff1f\u0964\u061f\u060c]")
# Tags that may stay open, and the tags that end one of the same kind.
ITEMS = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table tbody thead tfoot", "td": "tr table", "th": "tr table", "option": "select"}
_SPLIT = re.compile(r"[^a-z0-9]+")
_CLOSING = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in SKIPPED}


@dataclass(frozen=True)
class Rules:
    """Limits of the first pass."""

    short: int = 70
    long: int = 140
    stop_low: float = 0.15
    stop_high: float = 0.25
    link_density: float = 0.5
    sentence_marks: int = 2  # that make a long block without stop words undecided
    teaser: int = 300  # an article of less text without a title, and of less than ``teaser_share`` of all, marks nothing
    teaser_share: float = 0.25


@dataclass
class Block:
    text: str
    linked: int
    boilerplate: bool
    article: int
    heading: bool
    title: bool = False  # a heading of the first level
    suspects: tuple[int, ...] = ()  # containers around it that class, id or role speak against
    label: str = field(default="")


def _marked(attributes: str, in_article: bool) -> bool:
    for groups in _NAMED.findall(attributes):
        words = set(_SPLIT.split(max(groups).lower()))
        if words & MARKERS or (not in_article and words & PAGE_MARKERS):
            return True
    return False


def _hidden(attributes: str) -> bool:
    return bool(_HIDES.search(attributes) or _BARE.search(_QUOTED.sub('""', attributes)))


def blocks(html: str) -> list[Block]:
    """The page's text blocks in order, each with what its containers say about it."""
    found: list[Block] = []
    parts: list[str] = []
    # Container, boilerplate, number of the article around it, containers that their names speak against.
    stack: list[tuple[str, bool, int, tuple[int, ...]]] = []
    boilerplate, article, articles, suspects, suspected = False, 0, 0, (), 0
    linked, in_link, heading, title, breaks = 0, False, False, False, 0
    paragraph_out = False  # the paragraph or heading itself is marked or hidden
    mute, muted = "", 0  # an inline tag that is, and how many of its name are open
    at, size = 0, len(html)

    def end_block() -> None:
        nonlocal linked, breaks
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                found.append(Block(text, min(linked, len(text)), boilerplate or paragraph_out, article, heading, title, suspects))
            parts.clear()
        linked, breaks = 0, 0

    def add(text: str) -> None:
        nonlocal linked, breaks
        if text and not mute:
            parts.append(text)
            if not text.isspace():
                breaks = 0
                if in_link:
                    linked += len(" ".join(entities.unescape(text).split()))

    while at < size:
        tag = _TAG.search(html, at)
        if tag is None:
            # What follows an opened but never closed tag at a cut-off end is markup, not text.
            rest = html[at:]
            broken = re.search(r"<[a-zA-Z/!][^<>]*\Z", rest)
            add(rest[: broken.start()] if broken else rest)
            break
        add(html[at : tag.start()])
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        closing = bool(tag[1] or tag[4])
        if name in SKIPPED:
            if not closing and not (tag[3] or tag[6] or "").endswith("/"):
                end = _CLOSING[name].search(html, at)
                at = end.end() if end else size
            continue
        attributes = tag[3] or tag[6] or ""
        if name in INLINE:
            if name == mute:
                muted += -1 if closing else 1
                mute = mute if muted > 0 else ""
            elif not mute and not closing and attributes and name not in VOID and (_hidden(attributes) or _marked(attributes, True)):
                mute, muted = name, 1
            if name == "a":
                in_link = not closing
            elif name == "br":
                parts.append(" ")
                breaks += 1
                if breaks == 2:
                    end_block()
            continue
        end_block()
        mute, paragraph_out = "", False
        if name in HEADINGS:
            heading, title = not closing, name == "h1" and not closing
        if name in VOID or name == "p" or name in HEADINGS:
            if not closing:
                in_link = False
                paragraph_out = bool(attributes) and (_hidden(attributes) or _marked(attributes, True))
            continue
        if name in ITEMS and not closing:
            in_link = False
            # An item before it that is still open ends here.
            ends, kin = set(ITEMS[name].split()), {n for n, e in ITEMS.items() if e == ITEMS[name]}
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in ends:
                    break
                if stack[depth][0] in kin:
                    _, boilerplate, article, suspects = stack[depth - 1] if depth else ("", False, 0, ())
                    del stack[depth:]
                    break
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    del stack[depth:]
                    _, boilerplate, article, suspects = stack[-1] if stack else ("", False, 0, ())
                    break
            continue
        if name in ARTICLE and not boilerplate:
            articles += 1
            article = articles
        if name in BOILERPLATE or (name == "header" and not article):
            boilerplate = True
        elif not boilerplate and attributes and name not in ("html", "body"):
            if _hidden(attributes):
                boilerplate = True
            elif name != "main" and _marked(attributes, article > 0):
                suspected += 1
                suspects += (suspected,)
        stack.append((name, boilerplate, article, suspects))
    end_block()
    return found


def _judge_suspects(found: list[Block], rules: Rules) -> None:
    """Blocks in a container that its name speaks against are boilerplate, unless it holds most of the page: then the name is
    that of a layout, if the article or main part is in it, or next to nothing is left without it."""
    total, mass, marks = 0, Counter(), set()
    for block in found:
        if not block.boilerplate:
            own = len(block.text) - block.linked
            total += own
            for suspect in block.suspects:
                mass[suspect] += own
                if block.article:
                    marks.add(suspect)
    layout = {s for s, own in mass.items() if 2 * own > total and (s in marks or total - own < rules.long)}
    for block in found:
        if any(s not in layout for s in block.suspects):
            block.boilerplate = True


def first_pass(found: list[Block], rules: Rules) -> None:
    """Label blocks good, bad, near (undecided, of some length) or short (undecided).

    Where the page marks its article or main part, what stands outside is bad.
    """
    _judge_suspects(found, rules)
    mass = [(len(b.text) - b.linked) * (not b.boilerplate) for b in found]
    inside = sum(m for m, b in zip(mass, found) if b.article)
    titled = any(b.article and b.title and not b.boilerplate for b in found)
    marked = inside > 0 and (titled or inside >= rules.teaser or inside >= rules.teaser_share * sum(mass))
    if not marked:
        for block in found:
            block.article = 0
    for block in found:
        size = len(block.text)
        if block.boilerplate or (marked and not block.article) or block.linked > rules.link_density * size:
            block.label = "bad"
            continue
        words = block.text.lower().split()
        density = sum(w.strip(".,;:!?\"'()[]«»") in STOP_WORDS for w in words) / len(words)
        if size >= rules.long and density >= rules.stop_high:
            block.label = "good"
        elif size < rules.short:
            block.label = "bad" if block.linked and not block.article else "short"
        elif density >= rules.stop_low or block.article:
            block.label = "near"
        elif size >= rules.long and len(_SENTENCE.findall(block.text)) >= rules.sentence_marks:
            block.label = "near"
        else:
            block.label = "bad"
    # Where nothing is surely text, what reads like it is.
    if not any(block.label == "good" for block in found):
        for block in found:
            if block.label == "near":
                block.label = "good"


def second_pass(found: list[Block]) -> list[Block]:
    """The good blocks, after undecided ones took the labels of their nearest decided neighbours.

    Inside an article or main element only its own blocks count as neighbours and its borders as good ones. Elsewhere all
    blocks count. Between unlike neighbours a block of some length is good, a heading follows the block after it, and
    another short block follows the nearer neighbour, the good one if both are as near. Without any decided neighbour
    nothing speaks against the block and it stays.
    """
    count = len(found)
    sides: list[list[tuple[str, int] | None]] = [[None] * count, [None] * count]
    for side, order in enumerate((range(count), range(count - 1, -1, -1))):
        seen: tuple[str, int] | None = None
        region: int | None = None
        for i in order:
            block = found[i]
            if block.article and block.boilerplate:
                continue
            if block.article != region:
                region = block.article
                if block.article:
                    seen = ("good", i - 1 if side == 0 else i + 1)
            if block.label in ("good", "bad"):
                seen = (block.label, i)
            else:
                sides[side][i] = seen
    kept = []
    for i, block in enumerate(found):
        good = block.label == "good"
        if block.label in ("near", "short"):
            left, right = sides[0][i], sides[1][i]
            known = [x for x in (left, right) if x]
            labels = {x[0] for x in known}
            if len(labels) < 2:
                good = labels != {"bad"}
            elif block.label == "near":
                good = True
            elif block.heading:
                good = right[0] == "good"
            else:
                nearest = min(abs(x[1] - i) for x in known)
                good = any(x[0] == "good" and abs(x[1] - i) == nearest for x in known)
        if good:
            kept.append(block)
    return kept


def main_text(html: str | None, rules: Rules = Rules()) -> str:
    """The kept blocks joined by line feeds."""
    if not html:
        return ""
    found = blocks(html)
    first_pass(found, rules)
    return "\n".join(block.text for block in second_pass(found))


def extract(pages: DataFrame, html: str = "html", rules: Rules = Rules()) -> DataFrame:
    """``pages`` without the html column, with ``text`` and ``n_chars`` (these replace columns of the same names)."""

    @F.pandas_udf("string")
    def text_of(source: pd.Series) -> pd.Series:
        return pd.Series([main_text(x, rules) for x in source], dtype="object")

    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    texts = carried(pages).withColumn("found", text_of(own(html)))
    return texts.select(*restored(kept), F.col("found").alias("text"), F.length("found").cast("long").alias("n_chars"))
