"""Main-text extraction from HTML by two passes of block rules.

Pass 1 decides each block by where it stands (menus, footers, adverts and the
like are out; an article's own blocks are in unless they are mostly links) and,
where the page says nothing, by length, link density and stop-word density.
Pass 2 gives each block that stayed ambiguous the label of its nearest decided
neighbours.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tracelight.llm.common import slices, table, with_ids

#: Frequent function words of the languages that pages come in.
STOP_WORDS = frozenset(
    """
    a an and are as at be but by for from had has have he her his i in is it its not of on one or she that the their there they this to
    was we were what when which who will with would you
    aber als am an auch auf aus bei bin bis das dass dem den der des die dies durch ein eine einen einer er es für hat ich ihr im in ist
    mit nach nicht noch nur oder sein sich sie sind so um und uns von vor war was wenn wie wir wird zu zum zur
    au aux avec ce ces cette dans de des du elle en est et eu il ils je la le les leur lui ma mais me même mes moi mon ne nos notre nous
    on ou où par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous
    al como con de del donde el ella ellos en entre era es esa ese eso esta este esto hay la las le lo los más me mi muy no nos o para
    pero por que se si sin sobre son su sus también te tiene todo tu un una uno y ya
    """.split()
)
#: Elements whose content is never text.
SILENT = "script style noscript template svg math iframe object select textarea title canvas audio video map".split()
#: Elements that never hold an article's text.
OUTSIDE = frozenset("nav footer aside form menu dialog datalist".split())
#: Elements whose text is a link's; a block of little else is no text, but their words inside a sentence are.
LINKS = frozenset("a button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3
    h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul
    caption""".split()
)
#: Elements that the start of the element before the colon ends, up to the nearest container.
IMPLIED_END = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Parts of class names, ids and roles that mark what is around an article.
AROUND = frozenset(
    """ad ads advert adverts advertisement advertising adbox adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie
    cookies copyright disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices overlay pagination
    pager popup promo promoted recommended related replies respond search share sharing shoutbox sidebar signup skip social sponsor
    sponsored subscribe subscription tagcloud toolbar topbar widget navigation contentinfo complementary alert""".split()
)

#: Parts of class names and ids of what holds an article where no element says so.
WITHIN = frozenset("article articlebody content entry maincontent post story".split())

#: First words of a class name that say what its element hasn't, or only has besides.
BESIDES = frozenset("has have is no non not with without hide show".split())
#: Last words of a class name that don't change what its first one says.
BOXES = frozenset(
    """area bar block body bottom box center column container content desktop fixed form group inner item items left link links list main menu mobile
    outer panel primary right row rows secondary section slot small sticky text title top unit wrap wrapper zone""".split()
)
TAG = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][\w:-]*))")
TAG_END = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
SILENT_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in SILENT}
#: Elements that an end tag looks through for its start, as far as browsers nest elements.
DEPTH = 512
#: Tags whose quotes don't close that are looked at with their quotes; in a page with more, tags end at the next >.
BROKEN = 64
#: Containers named as around the text that are found, one in the other, to hold it after all.
WRAPPERS = 64
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
WORDS = re.compile(r"[^\W\d_]+")

MAX_LINK_DENSITY, LENGTH_LOW, LENGTH_HIGH = 0.2, 70, 200
STOPS_LOW, STOPS_HIGH = 0.06, 0.12
#: Of an article's own block; a paragraph may well hold a few links.
ARTICLE_LINK_DENSITY = 0.8


@dataclass
class Block:
    text: str
    linked: int
    heading: bool
    #: out (what is around the text), in (an article's or main's own) or open
    place: str
    #: the outermost element that a class, id or role puts around the text: where its tag begins, -1 without one or in what is never text
    cause: int = -1
    #: the outermost element that holds an article, by where its tag begins
    holder: int = -1


def hidden(attributes: str) -> bool:
    """Whether an element's attributes say that it isn't shown."""
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def says_around(name: str) -> bool:
    """Whether a class name, id or role says that its element is around the text.

    What it is stands last (``site-header``) or before words for boxes and numbers
    (``sidebar-left``, ``ad-slot-2``); ``has-sidebar`` and ``search-term`` say something else, and
    the header of an entry or article is its own.
    """
    words = [w.lower() for w in PART.findall(name)]
    if not words or words[0] in BESIDES:
        return False
    if words[-1] == "header" and any(w in WITHIN for w in words):
        return False
    while len(words) > 1 and words[-1] in BOXES and words[-1] not in AROUND:
        words.pop()
    return words[-1] in AROUND


def around(attributes: str) -> bool:
    """Whether an element's class, id or role says that it isn't part of the text."""
    found = ATTRIBUTE.findall(attributes)
    return any(says_around(w) for n, v in found if n.lower() in ("class", "id", "role") for w in v.strip("\"'").split())


def within(attributes: str) -> bool:
    """Whether an element's attributes say that it holds an article."""
    found = ATTRIBUTE.findall(attributes)
    named = [w for n, v in found if n.lower() in ("class", "id") for w in v.strip("\"'").split()]
    return any(n.lower() == "role" and v.strip("\"'").lower() == "main" for n, v in found) or any(
        p.lower() in WITHIN for v in named for p in PART.findall(v)
    )


def tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """Where each tag, comment or element without text begins and ends, ``/`` if it is an end tag, its name (empty if it only separates) and attributes.

    Each is read once: a tag whose quotes don't close ends at the next ``>``; where none follows, what is left is text.
    """
    at, broken, last = 0, 0, page.rfind(">")
    while m := TAG.search(page, at):
        start, at = m.start(), m.end()
        if m[0] == "<!--":
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
            yield start, at, "", "", ""
            continue
        if start > last:
            if not m[2]:
                yield start, len(page), "", "", ""
            return
        if not m[2]:
            at = page.find(">", at) + 1
            yield start, at, "", "", ""
            continue
        whole = TAG_END.match(page, at) if broken < BROKEN else None
        broken += whole is None
        end = whole.end() if whole else page.find(">", at) + 1
        name, attributes, at = m[2].lower(), page[at : end - 1], end
        if not m[1] and name in SILENT_END:
            if not (name in ("svg", "math") and attributes.endswith("/")):
                closed = SILENT_END[name].search(page, at)
                at = closed.end() if closed else len(page)
            name = ""
        yield start, at, m[1] or "", name, attributes


@dataclass(slots=True)
class Open:
    """An element that is open, and what it and the ones around it say together."""

    name: str
    at: int
    outside: bool
    named: bool
    holds: bool
    out: bool = False
    never: bool = False
    cause: int = -1
    holder: int = -1

    def under(self, above: "Open | None") -> None:
        self.out = self.outside or above is not None and above.out
        self.never = self.outside and not self.named or above is not None and above.never
        self.cause = above.cause if above is not None and above.cause >= 0 else self.at if self.named else -1
        self.holder = above.holder if above is not None and above.holder >= 0 else self.at if self.holds else -1


def blocks(page: str, trusted: frozenset[int] = frozenset()) -> list[Block]:
    """The page's blocks of text in order, white space inside each turned into one space, references decoded.

    Elements whose tags begin at ``trusted`` are part of the text whatever their class, id or role says.
    The time is in proportion to the page, whatever it holds: an end tag looks for its start among the innermost 512 open elements.
    """
    out: list[Block] = []
    stack: list[Open] = []
    open_names: Counter[str] = Counter()
    parts: list[str] = []
    state = {"links": 0, "linked": [], "heading": False}

    def flush() -> None:
        text = " ".join(htmllib.unescape("".join(parts)).split())
        if text:
            linked = len(" ".join(htmllib.unescape(" ".join(state["linked"])).split()))
            top = stack[-1] if stack else Open("", -1, False, False, False)
            place = "out" if top.out else "in" if top.holder >= 0 else "open"
            out.append(Block(text, linked, state["heading"], place, -1 if top.never else top.cause, top.holder))
        parts.clear()
        state["linked"] = []

    def text(piece: str) -> None:
        if piece:
            parts.append(piece)
            if state["links"]:
                state["linked"].append(piece)

    def close(at: int) -> None:
        for x in stack[at:]:
            open_names[x.name] -= 1
            state["links"] -= x.name in LINKS
        del stack[at:]

    at, breaks = 0, 0
    for start, end, ending, name, attributes in tags(page):
        piece, at = page[at:start], end
        text(piece)
        if piece.strip():
            breaks = 0
        if not name:
            continue
        if name == "br":
            breaks += 1
            if breaks >= 2:
                flush()
            parts.append(" ")
            continue
        block = name in BLOCK
        if block:
            flush()
        lowest = max(0, len(stack) - DEPTH) - 1
        if ending:
            if open_names[name] > 0:
                inner = False
                for i in range(len(stack) - 1, lowest, -1):
                    if stack[i].name == name:
                        if inner and not block:
                            # the end of inline markup doesn't end the blocks that began in it
                            gone = stack.pop(i)
                            open_names[name] -= 1
                            state["links"] -= name in LINKS
                            if gone.outside or gone.holds:
                                for j in range(i, len(stack)):
                                    stack[j].under(stack[j - 1] if j else None)
                        else:
                            close(i)
                        break
                    inner = inner or stack[i].name in BLOCK
            if block:
                state["heading"] = False
            continue
        if block:
            ends = IMPLIED_END.get(name, set())
            for i in range(len(stack) - 1, lowest, -1):
                if stack[i].name == "p" or stack[i].name in ends:
                    close(i)
                    break
                if stack[i].name in BLOCK:
                    break
            state["heading"] = len(name) == 2 and name[0] == "h" and name[1].isdigit()
        if name not in VOID and not attributes.endswith("/"):
            above = stack[-1] if stack else None
            inside = above is not None and above.holder >= 0
            outside = name in OUTSIDE or name == "header" and not inside or hidden(attributes)
            named = not outside and bool(attributes) and name not in ("html", "body") and start not in trusted and around(attributes)
            # a heading's class says what the heading is, not what holds the article
            holds = bool(attributes) and block and name != "body" and not state["heading"] and within(attributes)
            stack.append(Open(name, start, outside or named, named, name in ("article", "main") or holds))
            stack[-1].under(above)
            open_names[name] += 1
            state["links"] += name in LINKS
    text(page[at:])
    flush()
    return out


def first_pass(b: Block, page_has_article: bool) -> str:
    """good, bad, or what pass 2 settles: near (likely good), short, and head for a heading."""
    length, density = len(b.text), b.linked / max(1, len(b.text))
    if b.place == "out":
        return "bad"
    if b.place == "in":
        return "good" if density <= ARTICLE_LINK_DENSITY else "head" if b.heading else "bad"
    if page_has_article or density > MAX_LINK_DENSITY or length < LENGTH_LOW and "©" in b.text:
        return "bad"
    if b.heading and length < LENGTH_HIGH:
        return "head"
    if length < LENGTH_LOW:
        return "bad" if b.linked else "short"
    words = WORDS.findall(b.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if stops >= STOPS_HIGH:
        return "good" if length > LENGTH_HIGH else "near"
    return "near" if stops >= STOPS_LOW or length > LENGTH_HIGH else "short"


def second_pass(labels: list[str]) -> list[bool]:
    """Which blocks stay: an ambiguous one goes with its nearest decided neighbour.

    Two neighbours as near that disagree leave a likely good block in and a
    short one out; a heading goes with the block that it stands over. Where no block is decided, all stay.
    """
    n = len(labels)
    if "head" in labels:
        others = [i for i in range(n) if labels[i] != "head"]
        found = dict(zip(others, second_pass([labels[i] for i in others])))
        for i in range(n - 1, -1, -1):
            # the last block's heading has nothing to stand over
            found.setdefault(i, found.get(i + 1, not others))
        return [found[i] for i in range(n)]
    before, after = [None] * n, [None] * n
    for near, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last = None
        for i in order:
            if labels[i] in ("good", "bad"):
                last = i
            near[i] = last
    keep = []
    for i, label in enumerate(labels):
        if label in ("good", "bad"):
            keep.append(label == "good")
            continue
        a, b = before[i], after[i]
        if a is None and b is None:
            keep.append(True)
        elif a is None or b is None:
            keep.append(labels[a if b is None else b] == "good")
        elif labels[a] == labels[b] or i - a != b - i:
            keep.append(labels[a if i - a <= b - i else b] == "good")
        else:
            keep.append(label == "near")
    return keep


def dense(b: Block) -> bool:
    """Whether length, link density and stop-word density by themselves make it text."""
    return first_pass(replace(b, place="open"), False) == "good"


def main_text(page: str | None) -> str:
    """The page's main text: its blocks in order, joined by two newlines; empty for null, empty and text-free pages."""
    trusted: frozenset[int] = frozenset()
    for turn in range(WRAPPERS):
        found = blocks(page or "", trusted)
        has_article = any(b.place == "in" and first_pass(b, True) == "good" and not b.heading for b in found)
        if has_article or any(b.place == "open" and dense(b) for b in found):
            break
        # nothing is left but what is named as around the text: what holds most of the page is its text
        sizes: dict[int, int] = {}
        for b in found:
            if b.cause >= 0:
                sizes[b.cause] = sizes.get(b.cause, 0) + len(b.text)
        largest = max(sizes, key=sizes.get, default=-1)
        total = sum(len(b.text) for b in found if b.place != "out" or b.cause >= 0)
        if largest < 0 or sizes[largest] * 2 <= total or not any(b.cause == largest and (b.holder >= 0 or dense(b)) for b in found):
            break
        trusted |= {largest}
    inside = [b for b in found if b.place == "in"]
    if not has_article or len({b.holder for b in inside}) > 1 and sum(len(b.text) for b in inside) < sum(
        len(b.text) for b in found if b.place == "open" and dense(b)
    ):
        # headings alone, or several teasers beside a longer text, are no article
        has_article = False
        found = [replace(b, place="open") if b.place == "in" and (b.heading or not dense(b)) else b for b in found]
    labels = [first_pass(b, has_article) for b in found]
    if "good" not in labels:
        # a page of little text: the likely blocks are what there is
        labels = ["good" if x == "near" else x for x in labels]
    keep = second_pass(labels)
    return "\n\n".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id``, ``url``, ``text``, ``n_chars``.

    A null page counts as empty and gives an empty text; markup that is cut
    off or not closed is read as far as it goes, in time in proportion to the page; rows that repeat are each
    extracted; no rows give no rows; extra columns are ignored. The pages are
    read once and never shuffled.
    """

    def batches(it):
        for batch in slices(it):
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return with_ids(pages, "page_id", "url", "html").mapInArrow(batches, "page_id long, url string, text string, n_chars long")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
