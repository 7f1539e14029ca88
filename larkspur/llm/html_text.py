"""Main text of web pages by two passes over their blocks.

The first pass decides each block by its link density, its length and the share of stop
words in it, within what the markup says: menus, forms, notices and the like are left out
as elements, and where a page marks an article fewer stop words are asked for within it and
more, of long blocks only, outside. Short blocks, and blocks of an article with too few stop
words, stay ambiguous. In the second pass they take the label of the nearest decided block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

#: Characters under which a block is ambiguous, and over which it is long.
SHORT, LONG = 70, 200
#: Shares of stop words from which a block of middle length, or a long one, is text.
STOP_MIDDLE, STOP_LONG = 0.30, 0.25
#: Share of a block's characters in links above which it is a menu; within an article more is allowed.
LINKS, LINKS_INSIDE = 0.2, 0.6

#: What the mark of an article takes off these shares within it.
MARKED = 0.10

# Common function words of several languages.
STOP_WORDS = frozenset(
    """a about after all also an and any are as at be because been but by can could did do for from had has have he her his
    how if in into is it its more no not of on one only or other our out she so some than that the their them then there
    these they this to up was we were what when which who will with would you your
    aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich
    ihr im in ist kann man mit nach nicht noch nur oder sein sich sie sind so um und uns von vor war was wenn wie wir
    wird zu zum zur über
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou où par pas
    plus pour qu que qui sa se ses son sont sur un une vous à été être
    al como con cuando de del desde donde el ella en entre era es esta este ha hay la las lo los más muy no o para pero
    por porque que se ser si sin sobre son su sus también un una y ya
    che di il non per una della del nel sono con come più anche ma
    da do em não uma os as dos na no ao mais foi
    het een van de en dat niet zijn op te met voor""".split()
)
# Element names.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg math".split())
LEFT_OUT = frozenset("head nav footer aside button select datalist object canvas video audio dialog menu".split())
FORMS = frozenset("form fieldset".split())
# Words of class, id and role that name what is not the article.
NOT_TEXT = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos
    promotion sidebar sidebars cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter
    subscribe subscription signup login share sharing social related recommended recommendations comment comments
    commentlist disqus reply replies respond discussion breadcrumb breadcrumbs pagination pager widget widgets toolbar
    copyright navigation navbar banner contentinfo complementary search dialog""".split()
)
NOT_TEXT_UNLESS = frozenset("header masthead footer foot nav menu menus side aside top topbar links toc form".split())
TEXT = frozenset("article post entry content story main text body".split())
# Words that may stand beside those in a name that still names what is not the article.
BESIDE = frozenset(
    """post posts entry entries article articles page site blog news story stories reader readers user users box boxes list
    lists bar bars block blocks section sections container wrapper wrap area areas form forms button buttons link links
    item items icon icons tool tools inner outer title heading content contents main body unit units slot slots top bottom
    left right center middle small large mobile desktop js the this us our your for and by more most also see latest
    popular thread threads count counts number panel region group row col column grid card cards text info message
    messages header footer nav menu follow media free offer offers teaser teasers print email""".split()
)
# Words that name readers' comments alone.
COMMENTS = frozenset("comments commentlist disqus replies respond".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[^\W_]+")


@dataclass
class Block:
    text: str
    linked: int
    inside: bool
    label: str = field(default="")


def is_left_out(name: str, attributes: str, inside: bool, prose: bool = False) -> bool:
    """Whether an element is no part of an article, by its name and attributes. prose: it holds
    a long block of plain text; then a name that says more than what is left out (such as
    share-policy) doesn't count within an article, nor does a form."""
    if name in LEFT_OUT or (name == "header" and not inside) or (name in FORMS and not prose):
        return True
    if not attributes or name in ("html", "body", "main", "article"):
        return False
    if _HIDDEN.search(attributes):
        return True
    return named_out(attributes, inside and prose)


def named_out(attributes: str, strictly: bool = False) -> bool:
    """Whether class, id or role name what is not the article; strictly: by names that say
    nothing else besides."""
    words: set[str] = set()
    for m in _NAMED.finditer(attributes):
        for token in (m[2] or m[3] or m[4] or "").split():
            own = {w.lower() for w in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", token))}
            known = NOT_TEXT | NOT_TEXT_UNLESS | BESIDE
            if not strictly or own & COMMENTS or all(w in known or len(w) < 2 or w[0].isdigit() for w in own):
                words |= own
    return bool(words & NOT_TEXT) or bool(words & NOT_TEXT_UNLESS and not words & TEXT)


def comments_only(attributes: str) -> bool:
    for m in _NAMED.finditer(attributes):
        for token in (m[2] or m[3] or m[4] or "").split():
            own = {w.lower() for w in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", token))}
            if own & COMMENTS and own <= COMMENTS | BESIDE:
                return True
    return False


def tags(html: str) -> list[tuple[int, int, str, bool, bool, str]]:
    """(start, end, name, closing, alone, attributes) of the tags, outside raw elements; a raw
    element that ends, and a comment or the like, is one nameless tag."""
    out = []
    unclosed: set[str] = set()
    pos = 0
    while m := _TAG.search(html, pos):
        pos = m.end()
        name = (m[2] or m[5] or "").lower()
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        alone = name in VOID or attributes.endswith("/")
        if name in RAW and not closing and not alone:
            stop = None if name in unclosed else re.compile(rf"</{re.escape(name)}[\s>/]", re.I).search(html, pos)
            if stop:
                gt = html.find(">", stop.start())
                pos = len(html) if gt < 0 else gt + 1
            else:
                unclosed.add(name)
            name = ""
        out.append((m.start(), pos, name, closing, alone, attributes))
    return out


def _ends(found: list[tuple[int, int, str, bool, bool, str]]) -> tuple[dict[int, int], list[int], list[int], list[int]]:
    """Where elements end: of each opening tag the closing one of its name, if there is one;
    and the next tag from each place on that ends a p, that ends a li, that begins an article."""
    n = len(found)
    open_tags: dict[str, list[int]] = {}
    ends: dict[int, int] = {}
    for k, (_, _, name, closing, alone, _) in enumerate(found):
        if name and not alone:
            if not closing:
                open_tags.setdefault(name, []).append(k)
            elif open_tags.get(name):
                ends[open_tags[name].pop()] = k
    block, item, article = [n] * (n + 1), [n] * (n + 1), [n] * (n + 1)
    for k in range(n - 1, -1, -1):
        _, _, name, closing, _, _ = found[k]
        block[k] = k if name and name not in INLINE and name != "br" else block[k + 1]
        item[k] = k if name == "li" or closing and name in ("ul", "ol") else item[k + 1]
        article[k] = k if name in ("article", "main") and not closing else article[k + 1]
    return ends, block, item, article


def _prose(html: str, found: list[tuple[int, int, str, bool, bool, str]]) -> list[int]:
    """Characters in plain paragraphs that end before each tag: what stands between two tags of
    blocks and isn't short, without its links."""
    n = len(found)
    upto = [0] * (n + 1)
    size = linked = links = pos = 0
    for k in range(n + 1):
        start, end, name, closing, _, _ = found[k] if k < n else (len(html), len(html), "p", True, False, "")
        part = len(" ".join(html[pos:start].split()))
        size += part
        linked += part if links else 0
        pos = end
        gained = 0
        if name and name not in INLINE and name != "br":
            if size >= SHORT and linked <= LINKS * size:
                gained = size - linked
            size = linked = links = 0
        elif name == "a":
            links = max(0, links - 1) if closing else links + 1
        upto[k] = (upto[k - 1] if k else 0) + gained
    return upto


def blocks(html: str) -> list[Block]:
    """The blocks of a page outside the elements that are left out, in page order. An element
    to leave out that never ends goes on to the next article, or to the end of the page.

    What the names of an element say doesn't leave out what frames the page: an element with
    an article in it, or, where no article is marked, with half of all plain text and little of
    it before; what names readers' comments alone never frames. A form is left out unless it
    holds plain text or frames the page."""
    out: list[Block] = []
    held: list[str] = []
    linked = articles = links = 0
    found = tags(html)
    ends, block, item, article = _ends(found)
    prose = _prose(html, found)
    marks = [0]
    for _, _, name, closing, _, attributes in found:
        marks.append(marks[-1] + (name in ("article", "main") and not closing and not named_out(attributes)))

    def frames(k: int) -> bool:
        last = ends.get(k, len(found))
        if marks[-1]:
            return marks[last] > marks[k]
        own = prose[last] - prose[k]
        return 2 * own >= prose[-1] > 0 and 4 * prose[k] <= own and not comments_only(found[k][5])

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        if text:
            out.append(Block(text, linked, articles > 0))
        held.clear()
        linked = 0

    def text(start: int, end: int) -> None:
        nonlocal linked
        if end > start:
            part = unescape(html[start:end])
            held.append(part)
            if links:
                linked += len(" ".join(part.split()))

    pos, k, n = 0, 0, len(found)
    while k < n:
        start, end, name, closing, alone, attributes = found[k]
        text(pos, start)
        pos, k = end, k + 1
        if not name:
            continue
        if name == "br":
            held.append(" ")
            continue
        if name not in INLINE:
            close()
            links = 0
        mine = k - 1
        plain = not closing and not alone and prose[min(ends.get(mine, len(found)), len(found))] > prose[mine]
        spared = name not in LEFT_OUT and name != "header" and not closing and not _HIDDEN.search(attributes) and not articles and frames(mine)
        if not closing and not alone and not spared and is_left_out(name, attributes, articles > 0, plain):
            if name in ("p", "li"):  # their end tags may be missing
                last = (block if name == "p" else item)[k]
                own = last < n and found[last][2] == name and found[last][3]
            else:
                last = ends.get(k - 1, -1)
                own = last >= 0
                last = last if own else article[k]
            k = last + own
            pos = len(html) if last >= n else found[last][int(own)]
            continue
        if name == "a":
            links = max(0, links - 1) if closing else links + 1
        elif name in ("article", "main"):
            articles = max(0, articles - 1) if closing else articles + 1
    text(pos, len(html))
    close()
    return out


def stop_share(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


_SENTENCE = re.compile(r"[.!?…](?=\s|[\"'»”’)]|$)|[。！？।؟۔]")


def reads_as_prose(text: str) -> bool:
    """Whether a long block has sentences of letters, in whatever language: an end of one in
    400 characters at least, and few digits and signs."""
    letters = sum(c.isalpha() or c.isspace() or "\u0300" <= c <= "\u0dff" for c in text)
    return letters >= 0.85 * len(text) and 400 * len(_SENTENCE.findall(text)) >= len(text)


def label_blocks(found: list[Block]) -> list[Block]:
    """Both passes: sets every label to text or not. Where no article is marked, a long block
    without enough of the stop words known here, but of sentences, is text by its length and
    link density; and where that makes less than half of the plain blocks text, all of them are
    but short ones."""
    marked = any(b.inside for b in found)
    for b in found:
        n = len(b.text)
        density = b.linked / n
        share = stop_share(b.text) if n >= SHORT else 0.0
        if density > (LINKS_INSIDE if b.inside else LINKS) or "©" in b.text and n < LONG and not b.inside:
            b.label = "not"
        elif n < SHORT:
            b.label = "ambiguous" if b.inside or not marked else "not"
        elif marked and not b.inside:
            b.label = "text" if n >= LONG and share >= STOP_MIDDLE else "not"
        elif share >= (STOP_LONG if n >= LONG else STOP_MIDDLE) - (MARKED if b.inside else 0):
            b.label = "text"
        elif not b.inside and n >= (LONG if share else SHORT) and share < STOP_MIDDLE / 2 and reads_as_prose(b.text):
            b.label = "text"
        else:
            b.label = "ambiguous"
    plain = [b for b in found if b.linked <= LINKS * len(b.text) and "©" not in b.text]
    size = sum(len(b.text) for b in plain if len(b.text) >= SHORT)
    if not marked and 2 * sum(len(b.text) for b in found if b.label == "text") < size:  # the words say little here
        for b in plain:
            b.label = "text" if len(b.text) >= SHORT else "ambiguous"
    decided = [k for k, b in enumerate(found) if b.label != "ambiguous"]
    fallback = "text" if marked or not any(b.label == "text" for b in found) else "not"
    before: list[int] = []
    last = -1
    for k, b in enumerate(found):
        if b.label != "ambiguous":
            last = k
        before.append(last)
    after, nxt = [0] * len(found), -1
    for k in range(len(found) - 1, -1, -1):
        if found[k].label != "ambiguous":
            nxt = k
        after[k] = nxt
    labels = [b.label for b in found]
    for k, b in enumerate(found):
        if labels[k] != "ambiguous":
            continue
        if not decided:
            b.label = fallback
            continue
        p, q = before[k], after[k]
        if p < 0 or q < 0:
            b.label = labels[max(p, q)]
        elif labels[p] == labels[q]:
            b.label = labels[p]
        else:  # a tie is text; within a marked article so is a block next to any text
            near = p if k - p < q - k else q
            b.label = "text" if k - p == q - k or found[k].inside else labels[near]
        if b.inside and b.label == "not" and not any(labels[j] == "text" for j in (p, q) if j >= 0) and fallback == "text" and (b.linked == 0 or len(b.text) >= SHORT):
            b.label = "text"
    return found


def main_text(html: str | None) -> str:
    """The text blocks of a page, joined by one space."""
    return " ".join(b.text for b in label_blocks(blocks(html or "")) if b.label == "text")


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with text and n_chars (code points) in place of html_col.

    A null or empty page, and one without main text, has the empty text. Pages are read
    whole; nothing is cut. Repeated rows give a row each, an empty table none. Columns
    named text or n_chars are replaced.
    """
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(0).to_pylist()]
            made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], [*keep, "text", "n_chars"])

    schema = pages.select(*keep).schema.add("text", "string").add("n_chars", "long")
    return pages.select(F.col(html_col), *keep).mapInArrow(lean(run), schema)
