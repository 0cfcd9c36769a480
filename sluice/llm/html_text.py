"""HTML extraction by two passes over the blocks of a page.

A page is cut into text blocks at block-level tags. Pass one classifies blocks by their density of stop words, their length and
their density of links: mostly links is boilerplate; long and dense in stop words is content; what no container speaks against and is long
is content as well. The containers that a block stands in (menus, headers, footers, sidebars, forms, adverts, notices, comments; articles) shift these
rules: a block inside boilerplate can't become content, one inside an article needs no length. Pass two gives each undecided block (short, or
long without stop words) the label of its nearest decided neighbour of its own container, else of the page, the earlier one's on a tie; with no decided block on the
page all are content but those of boilerplate containers.

A container is boilerplate by its tag, its role or a whole word of its class or id; not one that holds an article, a heading of the first level or most of the page's
prose. An article inside boilerplate that never closed ends it.

Scripts, styles, comments, buttons, drawings and the head never make blocks; one that is never closed ends at the next block tag. Links end at their end tag, at the next
link and at the end of their block. Character references are decoded, white space in a block becomes one space, blocks are joined in page order
by two newlines.

Null or empty html: empty text. Null urls and ids pass through; repeated rows are extracted each. Columns other than
those three are ignored. A page is read once from left to right, with lists of what is open, so work is linear in its length whatever its markup.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import table

NAME = re.compile(r"[A-Za-z][^\s/>]*")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*))")
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
BLOCK_START = re.compile(rf"<(?:{'|'.join(sorted(BLOCK_TAGS))})[\s/>]", re.I)
#: Elements whose content is no text of the page, those among them whose content is not markup either, and inline controls.
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes".split())
LOWER = {c: c + 32 for c in range(65, 91)}
#: Controls and drawings, left out with what is in them; one that never closes before the next of its kind opens is no more than its tag.
CONTROL_TAGS = frozenset("button svg".split())
HIDDEN_TAGS = frozenset("noscript template select object canvas video audio head".split())
BAD_TAGS = frozenset("nav footer aside form menu dialog".split())
GOOD_TAGS = frozenset("article main".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Blocks that close themselves; only what they are in is followed.
LEAF_TAGS = frozenset("p li dt dd option tr td th h1 h2 h3 h4 h5 h6 tbody thead tfoot caption figcaption legend summary".split())
#: Words of a class, id or role that mark a container as boilerplate: alone, or joined to a word of the second list.
BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies discussion disqus footer "
    "gdpr masthead menu nav navbar navigation newsletter notice notices pagination pager popup promo promotion related replies reply responses search sharing "
    "sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget".split()
)
PLAIN_NAMES = frozenset("area bar block body box container content cta footer form head header inner item left link links list main menu nav note outer page panel post primary right secondary section site slot text top unit widget wrap wrapper".split())
#: Common function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be been but by can for from had has have he her his i if in is it its more not of on one or our she so that the their them there they this to was we were what when which who will with would you your "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die du durch ein eine einen einer er es für hat ich ihr im in ist ja kann man mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war wenn wie wir zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et être eux il ils je la le les leur lui mais me même ne nous on ou où par pas plus pour qu que qui sa sans se ses son sont sur un une vous "
    "al algo como con cuando de del desde donde el ella ellos en entre era es esta este fue ha hay la las lo los más me mi muy no o para pero por porque que se sin sobre su sus también un una y ya".split()
)
#: Shares and lengths of the block rules.
LINKS, ARTICLE_LINKS, SHORT, LONG, DENSE, MOST = 0.33, 0.8, 70, 200, 0.12, 0.5
GOOD, BAD, OPEN = "good", "bad", ""


class Block:
    """Text, number of its characters inside links, and the containers that it stands in, innermost last."""

    __slots__ = ("text", "linked", "inside", "heading")

    def __init__(self, text: str, linked: int, inside: tuple, heading: bool):
        self.text, self.linked, self.inside, self.heading = text, linked, inside, heading


class Container:
    """A block element with what its tag and names say, the one around it, and what pass one adds up over its blocks."""

    __slots__ = ("tag", "label", "weak", "parent", "prose", "holds", "depth", "bad", "menu")

    def __init__(self, tag: str, label: str, weak: bool, parent):
        self.tag, self.label, self.weak, self.parent = tag, label, weak, parent
        self.prose, self.holds, self.depth = 0, False, parent.depth + 1 if parent else 0
        self.bad = label == BAD or parent is not None and parent.bad  # boilerplate here or around
        self.menu = self if tag in BAD_TAGS else parent.menu if parent else None  # the innermost container that is boilerplate by its tag


def named_label(tag: str, attributes: str) -> tuple[str, bool]:
    """(label, whether only a class or id says so) of a container."""
    if tag in BAD_TAGS:
        return BAD, False
    if tag in GOOD_TAGS:
        return GOOD, False
    for key, *values in ATTRIBUTE.findall(attributes):
        if key.lower() in ("class", "id", "role"):
            for name in "".join(values).lower().split():
                words = [w for w in re.split(r"[^a-z]+", re.sub(r"[0-9]+$", "", name)) if w]
                if words and (set(words) & BAD_NAMES) and all(w in BAD_NAMES or w in PLAIN_NAMES for w in words):
                    return BAD, key.lower() != "role"
    return (BAD, True) if tag == "header" else (OPEN, False)


def _tag_end(page: str, at: int) -> int:
    """Place after the `>` of the tag whose attributes start at `at`; quotes that never close count as characters."""
    while True:
        close = page.find(">", at)
        if close < 0:
            return len(page)
        value = re.compile(r"=\s*[\"']").search(page, at, close)
        if not value:
            return close + 1
        quote = page.find(page[value.end() - 1], value.end())
        # A value reaches over a `>` only where its quote closes before the next tag opens.
        if 0 <= quote < close:
            at = quote + 1
            continue
        opens = page.find("<", close)
        if quote < 0 or 0 <= opens < quote:
            return close + 1
        at = quote + 1


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in order."""
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    here: Container | None = None
    open_tags: Counter = Counter()  # of the containers around, so that an end tag without a start costs nothing
    in_link = heading = False
    hidden: list[str] = []
    at, end = 0, len(page)
    raw_ends: dict[str, int] = {}
    lower = page.translate(LOWER)  # as long as the page, whatever its characters

    def close():
        nonlocal in_link, heading
        text = " ".join(_html.unescape("".join(p for p, _ in parts)).split())
        if text:
            linked = sum(len(" ".join(_html.unescape(p).split())) for p, link in parts if link)
            out.append(Block(text, min(linked, len(text)), here, heading))
        parts.clear()
        in_link = heading = False

    while at < end:
        start = page.find("<", at)
        if start < 0:
            start = end
        if start > at and not hidden:
            parts.append((page[at:start], in_link))
        if start == end:
            break
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 4) if raw_ends.get("-->", 0) >= 0 else -1
            raw_ends["-->"] = stop
            if stop < 0:  # an open comment ends with its tag
                stop = page.find(">", start)
                at = end if stop < 0 else stop + 1
            else:
                at = stop + 3
            continue
        closing = page.startswith("</", start)
        m = NAME.match(page, start + 1 + closing)
        if not m:
            if page.startswith(("<!", "<?", "</"), start):
                stop = page.find(">", start)
                at = end if stop < 0 else stop + 1
            else:  # a lone <
                if not hidden:
                    parts.append(("&lt;", in_link))
                at = start + 1
            continue
        name, at = m[0].lower(), _tag_end(page, m.end())
        attributes = page[m.end() : at - 1]
        if closing:
            if name in hidden:
                while hidden.pop() != name:
                    pass
            elif hidden:
                pass
            elif name == "a":
                in_link = False
            elif name in BLOCK_TAGS:
                close()
                if open_tags[name]:
                    while here.tag != name:
                        open_tags[here.tag] -= 1
                        here = here.parent
                    open_tags[name] -= 1
                    here = here.parent
            continue
        if name in RAW_TAGS:
            if not attributes.endswith("/"):
                known = raw_ends.get(name, 0)
                stop = known if known < 0 or known >= at else lower.find(f"</{name}", at)
                raw_ends[name] = stop
                if stop >= 0:
                    after = page.find(">", stop)
                    at = end if after < 0 else after + 1
                else:
                    after = BLOCK_START.search(page, at)
                    at = after.start() if after else end
            continue
        if name in CONTROL_TAGS:
            if not attributes.endswith("/"):
                known = raw_ends.get(name, 0)
                stop = raw_ends[name] = known if known < 0 or known >= at else lower.find(f"</{name}", at)
                if stop >= 0 and lower.find(f"<{name}", at, stop) < 0:
                    after = page.find(">", stop)
                    at = end if after < 0 else after + 1
            continue
        if name in BLOCK_TAGS and hidden and (name == "body" or not any(lower.find(f"</{h}", at) >= 0 if raw_ends.get("/" + h, 0) >= 0 else False for h in hidden[:1])):
            for h in hidden[:1]:
                raw_ends["/" + h] = -1  # it never closes: it ends here
            hidden.clear()
        if name in HIDDEN_TAGS and not attributes.endswith("/") and raw_ends.get("/" + name, 0) >= 0:
            hidden.append(name)
            continue
        if hidden:
            continue
        if name == "a":
            in_link = "href" in attributes.lower()
        elif name == "br":
            parts.append(("\n", in_link))
        elif name in BLOCK_TAGS:
            close()
            if name in VOID_TAGS:
                continue
            heading = name in ("h1", "h2", "h3", "h4", "h5", "h6")
            label, weak = named_label(name, attributes) if name not in ("body", "html") else (OPEN, False)
            if name in GOOD_TAGS:
                box = here.menu if here else None
                if box and not (box.parent and box.parent.bad):  # an unclosed menu ends where the article starts
                    while here is not box.parent:
                        open_tags[here.tag] -= 1
                        here = here.parent
            if name not in LEAF_TAGS or label == BAD:
                here = Container(name, label, weak, here)
                open_tags[name] += 1
            if name == "h1" or name in GOOD_TAGS:
                box = here.parent if name in GOOD_TAGS else here
                while box and not box.holds:
                    box.holds = True
                    box = box.parent
    close()
    return out


def dense(text: str) -> bool:
    """Whether stop words are frequent."""
    words = text.lower().split()
    return sum(w.strip(".,;:!?") in STOP_WORDS for w in words) >= DENSE * len(words)


def labels(found: list[Block]) -> list[str]:
    """The label of each block after both passes."""
    prose = [len(b.text) if len(b.text) >= SHORT and b.linked <= LINKS * len(b.text) and dense(b.text) else 0 for b in found]
    places: dict[int, str] = {}
    # A page without an article may have its text in a container that only sounds like boilerplate.
    text = sum(len(b.text) for b in found)
    article = False

    # Prose per container, then how each is judged, outermost first.
    for b, p in zip(found, prose, strict=True):
        if b.inside is not None and p:
            b.inside.prose += p
    boxes = {id(b.inside): b.inside for b in found if b.inside is not None}
    pending = list(boxes.values())
    while pending:
        box = pending.pop()
        if box.parent is not None and id(box.parent) not in boxes:
            boxes[id(box.parent)] = box.parent
            pending.append(box.parent)
    for box in sorted(boxes.values(), key=lambda c: -c.depth):
        article |= box.label == GOOD
        if box.parent is not None:
            box.parent.prose += box.prose
    for box in sorted(boxes.values(), key=lambda c: c.depth):
        above = places[id(box.parent)] if box.parent is not None else OPEN
        own = box.label
        if own == BAD and box.weak and (box.holds or not article and box.prose > MOST * text):
            own = OPEN
        places[id(box)] = BAD if above == BAD else own or above

    first = []
    for b, p in zip(found, prose, strict=True):
        place = places[id(b.inside)] if b.inside is not None else OPEN
        n = len(b.text)
        if place == BAD or b.linked > (ARTICLE_LINKS if place == GOOD and (b.heading or n >= SHORT) else LINKS) * n and not (place == GOOD and b.heading):
            first.append(BAD)
        elif p or place == GOOD and (n >= SHORT or b.linked == 0) or place == OPEN and n >= LONG and b.linked == 0:
            first.append(GOOD)
        else:
            first.append(OPEN)
    decided = [i for i, x in enumerate(first) if x]
    if not decided:
        return [GOOD] * len(first)
    if not any(x == GOOD for x in first):
        return [x or GOOD for x in first]
    out, k = [], 0
    for i, x in enumerate(first):
        while k + 1 < len(decided) and decided[k + 1] - i < abs(i - decided[k]):
            k += 1
        if x:
            out.append(x)
            continue
        # Neighbours of the block's own container come before others at the same distance or one further.
        near = [j for j in decided[max(0, k - 1) : k + 3] if found[j].inside is found[i].inside]
        out.append(first[min(near, key=lambda j: (abs(j - i), j))] if near else first[decided[k]])
    return out


def main_text(page: str | None) -> str:
    """The main text of a page."""
    found = blocks(page or "")
    return "\n\n".join(b.text for b, label in zip(found, labels(found), strict=True) if label == GOOD)


def _extract(batches):
    for batch in batches:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Id, url, main text and its number of code points for every page."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long").withColumnsRenamed({"page_id": id_col, "url": url_col})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`op7_html_extraction`: all pages."""
    return extract(table(spark, sf_dir, "pages"))
