"""Main text of web pages by line-block distribution.

Markup is stripped into lines at the edges of block elements. Sizes of text are summed over sliding windows of lines.
Where the sum surges from nothing a stretch of text begins, where it dives to nothing it ends. The main text is the
stretches whose sum somewhere comes near the page's largest one, and nothing else.

Tags and names only set sizes and places. Lines of menus, footers, sidebars, forms, adverts, notices and reader comments
have size 0 and never stay; within one article, or between lines of one kind in one element, they are no gap. A line
that is mostly links has size 0, or a quarter within an article. Lines of an article or main element count twice, and
windows end at its edges, but for a headline before it. Within an article most names say little: a block that is named
like boilerplate is text if its windows, too, come near the largest of the others.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import small_batches

#: Lines in a window; the share of the page's largest window sum that a stretch of text reaches somewhere.
WINDOW, SURGE = 3, 0.25

#: Elements whose content is no text of the page. A head holds no other text, so it needs no closing tag; the last ones
#: are empty if their tag ends in ``/>``.
RAW = frozenset("script style title".split())
HELD = frozenset("noscript template svg iframe object canvas video audio".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mrow ms msqrt msub msup mtext "
    "q s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE = frozenset(["article", "main"])
#: Elements that hold no main text wherever they stand; a header inside an article holds its headline.
BOILERPLATE = frozenset("nav footer aside form menu button dialog select textarea option fieldset".split())
#: Names that a class, id or role has as a whole word between spaces, alone or before the name of a container; longer
#: names that contain one mean nothing.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar masthead topbar site-header page-header site-footer page-footer footer cookie cookies cookie-consent consent gdpr notice notices "
    "popup modal newsletter subscribe signup recommended related-posts related-articles widget skip-link search-form comment comments "
    "disqus_thread replies pagination pager complementary contentinfo banner".split()
)
_CONTAINER = re.compile(r"(?:[-_](?:area|banner|bar|block|box|container|list|notice|panel|section|slot|unit|widget|wrap|wrapper|\d+))+$")
#: Names that hold no main text inside an article either.
NEVER = frozenset(
    "ad ads advert adverts advertisement advertising sponsored cookie cookies cookie-consent consent gdpr comment comments disqus_thread "
    "replies".split()
)
#: What an element that is named for the whole article or page must be called to hold none; names that end so mean it too,
#: unless they begin with one of the words that tell of a setting.
READERS = frozenset("comment comments replies".split())
SETTINGS = frozenset("no has with without show hide enable disable".split())

_PART = re.compile("[-_]")
_NAME = re.compile(r"/?[a-zA-Z][\w:-]*")
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_QUOTE = re.compile(r"[\"'>]")
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW | HELD}


@dataclass
class Line:
    text: str
    article: int  # number of the innermost article or main element, 0 outside
    boilerplate: bool
    linked: int  # characters inside links
    heading: bool
    named: int  # number of the outermost element in an article that is named like boilerplate, 0 if there is none
    kind: tuple[int, str]  # number of the element that holds its block, and the block's name


def tokens(page: str) -> Iterator[tuple[str, str]]:
    """Texts as ``("", text)`` and tags as ``(name, attributes)``, ``(/name, "")``, in time linear in the page.

    A tag ends at the first ``>`` outside quotes. Once a tag has none, quotes in the rest of the page don't match and
    are ignored; a tag without any ``>`` ends the page.
    """
    at, quoted = 0, True
    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            yield "", page[at:]
            return
        if start > at:
            yield "", page[at:start]
        name = _NAME.match(page, start + 1)
        if name is None:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = len(page) if end < 0 else end + 3
            elif page.startswith("<![CDATA[", start):
                end = page.find("]]>", start)
                at = len(page) if end < 0 else end + 3
            elif page[start + 1 : start + 2] in ("!", "?"):
                end = page.find(">", start)
                at = len(page) if end < 0 else end + 1
            else:
                yield "", "<"
                at = start + 1
            continue
        end = _tag_end(page, name.end()) if quoted else -1
        if end < 0:
            quoted, end = False, page.find(">", name.end())
            if end < 0:
                return
        tag, rest = name[0].lower(), page[name.end() : end]
        at = end + 1
        if tag in RAW or (tag in HELD and not rest.endswith("/")):
            close = _CLOSE[tag].search(page, at)
            at = len(page) if close is None else close.end()
            yield tag, "/"
        else:
            yield tag, rest


def _tag_end(page: str, at: int) -> int:
    """Place of the first ``>`` outside quotes; -1 if there is none."""
    while found := _QUOTE.search(page, at):
        if found[0] == ">":
            return found.start()
        at = page.find(found[0], found.end()) + 1
        if not at:
            return -1
    return -1


def _marks(attributes: str) -> set[str]:
    """The names that class, id and role give, without the name of a container at their end."""
    names = {x for found in _ATTRIBUTE.findall(attributes) for x in (found[0] or found[1] or found[2]).lower().split()}
    names |= {_CONTAINER.sub("", x) for x in names}
    parts = (_PART.split(x) for x in names)
    return names | {x[-1] for x in parts if x[-1] in READERS and x[0] not in SETTINGS}


@dataclass
class _Open:
    name: str
    boilerplate: bool
    article: int
    links: int
    heading: bool
    named: int
    block: int  # number of the innermost block element
    kind: tuple[int, str]
    edge: bool  # an inline element that begins and ends lines


def page_lines(page: str) -> list[Line]:
    """Text of each block in page order, with decoded references and single spaces."""
    lines: list[Line] = []
    buffer: list[str] = []
    linked = articles = number = 0
    stack = [_Open("", False, 0, 0, False, 0, 0, (0, ""), False)]
    counts: dict[str, int] = {}

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(buffer)).split())
        if text:
            top = stack[-1]
            lines.append(Line(text, top.article, top.boilerplate, linked, top.heading, top.named, top.kind))
        buffer.clear()
        linked = 0

    def close(name: str) -> None:
        if counts.get(name):
            while True:
                gone = stack.pop()
                counts[gone.name] -= 1
                if gone.name == name:
                    return

    for name, rest in tokens(page):
        if not name:
            buffer.append(rest)
            if stack[-1].links:
                linked += len(rest.strip())
            continue
        bare = name.lstrip("/")
        if bare in RAW or bare in HELD:
            continue
        if bare not in INLINE:
            flush()
        if name != bare:
            if stack[-1].edge and stack[-1].name == bare:
                flush()
            close(bare)
        elif bare not in VOID and not rest.rstrip().endswith("/"):
            if bare == "p":  # a paragraph ends the one before it
                close_p = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name not in INLINE), 0)
                if stack[close_p].name == "p":
                    close("p")
            over = stack[-1]
            marks = _marks(rest) if "=" in rest else set()
            articles += bare in ARTICLE
            bad = bare in BOILERPLATE or ((bare == "header" or "header" in marks) and not over.article and bare not in ARTICLE)
            whole = bare in ARTICLE or bare in ("html", "body")
            bad = bad or bool(marks & (READERS if whole else NEVER if over.article else NAMES))
            number += 1
            named = over.named or (number if over.article and not whole and marks & NAMES else 0)
            inline = bare in INLINE
            edge = inline and (bad or named == number)
            if edge:
                flush()
            stack.append(
                _Open(
                    bare, over.boilerplate or bad, articles if bare in ARTICLE else over.article, over.links + (bare == "a"), over.heading or bare in HEADINGS,
                    named, over.block if inline else number, over.kind if inline else (over.block, bare), edge,
                )
            )
            counts[bare] = counts.get(bare, 0) + 1
    flush()
    return lines


def stretches(sizes: list[int]) -> list[tuple[int, int]]:
    """Places (first line, line after the last) of the stretches of text among lines of these sizes.

    A stretch goes from where the sum of WINDOW lines surges from 0 to where it dives to 0, without lines of size 0 at
    its ends, and counts if its largest sum is at least SURGE of the largest of all.
    """
    blocks = [sum(sizes[i : i + WINDOW]) for i in range(len(sizes))]
    most = max(blocks, default=0)
    found, begin = [], None
    for i, block in enumerate([*blocks, 0]):
        if block and begin is None:
            begin = i
        elif not block and begin is not None:
            if max(blocks[begin:i]) >= SURGE * most:
                inside = [k for k in range(begin, i) if sizes[k]]
                found.append((inside[0], inside[-1] + 1))
            begin = None
    return found


def largest(sizes: list[int]) -> int:
    return max((sum(sizes[i : i + WINDOW]) for i in range(len(sizes))), default=0)


def line_size(line: Line) -> int:
    """What a line adds to the windows it is in."""
    if line.boilerplate:
        return 0
    size = len(line.text)
    if not line.heading and 2 * line.linked > size:
        size = (size + 3) // 4 if line.article else 0
    return 2 * size if line.article else size


def text_lines(lines: list[Line]) -> list[Line]:
    """The lines, those of named blocks as boilerplate that don't come near the largest of the others."""
    blocks: dict[int, list[int]] = {}
    for line in lines:
        blocks.setdefault(line.named, []).append(line_size(line))
    most = largest(blocks.get(0, []))
    small = {k for k, sizes in blocks.items() if k and largest(sizes) < SURGE * most}
    return [replace(x, boilerplate=True) if x.named in small else x for x in lines]


def in_windows(lines: list[Line]) -> list[int | None]:
    """Numbers of the lines as the windows run over them; None is a gap at an article's edge."""
    order: list[int | None] = []
    last: Line | None = None  # the last line with a size, and boilerplate after it
    waiting: list[int] = []
    for i, line in enumerate(lines):
        if line.boilerplate:
            waiting.append(i)
            continue
        if line_size(line):
            one = last is not None and ((line.article and line.article == last.article) or line.kind == last.kind)
            if not one:
                order.extend(waiting)
            if last is not None and bool(line.article) != bool(last.article) and not last.heading:
                order.extend([None] * WINDOW)
            last, waiting = line, []
        order.append(i)
    return order + waiting


def main_text(page: str | None) -> str:
    """The page's main text: its blocks in page order, joined by one space."""
    if not isinstance(page, str):
        return ""
    lines = text_lines(page_lines(page))
    order = in_windows(lines)
    kept: list[int] = []
    for begin, end in stretches([0 if i is None else line_size(lines[i]) for i in order]):
        kept += [i for i in order[begin:end] if i is not None and not lines[i].boilerplate]
    return " ".join(lines[i].text for i in kept)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (code points) of its main text instead of the markup column.

    Null and empty pages have an empty text. A page that breaks off keeps what came before; nothing is cut.
    Repeated rows get equal texts. Columns named as the new ones are replaced; tables may be empty.
    """
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(x) for x in batch], dtype=object)

    own = [c for c in pages.columns if c not in ("text", "n_chars", html_col)]
    found = pages.select(*own, text_of(F.col(html_col)).alias("text"))
    return found.select("*", F.length("text").cast("bigint").alias("n_chars"))
