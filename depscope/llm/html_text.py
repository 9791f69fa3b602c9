"""Main text of web pages by consensus of the pages of a host.

Each page is cut into blocks of text, each with its path of elements. Elements that can hold
the main text, its containers, are scored by the text of their paragraphs outside links and
boilerplate. A container's path is generalised: tags with their classes, digits taken out, from
the root down. In Spark, the pages of a host vote: each page gives its best container a vote and
every other up to a quarter of one, by its score; votes are summed per host and path, and the
path with the most wins; paths that are best on half of the pages that have them are the host's
other templates. Then every page is read again: of its host's paths, the one with the best score on the page
leads to its main text, that of the article or main around it; pages without such an element use their own
best container. Votes are combined before they are
shuffled, and the winners are a small table (host, path): a host with a third of all pages is no
hot key.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depscope.llm.common import ship, written
from depscope.llm.components import join_hot

# Elements of HTML by how they are read.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe".split())
#: Not read either, but they hold elements; the first ones end where a block of the page begins.
FOREIGN, FALLBACK = set("svg math select".split()), set("canvas object audio video".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SELF_NESTING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tfoot", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
BOILERPLATE_TAGS = set("nav header footer aside button dialog menu head".split())
BOILERPLATE_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
# Words of class and id values that mark what is not the article. The first ones do so as the first or the last
# word of a value, such as in footer-top or main-nav.
BOILERPLATE_WORDS = set(
    "ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promotion banners "
    "cookie cookies consent gdpr notices modal popup overlay newsletter subscribe subscription signup paywall "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc topbar toolbar "
    "masthead footer sidebar sidebars aside widget widgets recommended recommendations "
    "comment comments commentlist disqus".split()
)
#: These have other meanings too (ad-hoc, share-worthy, header-fixed): as the last word, or before a word for a part of a page.
WEAK_WORDS = set("ad adv promo banner notice notification alert disclaimer header related trending popular share sharing social respond reply replies discussion feedback form search login".split())
PART_WORDS = set("area articles bar block box button buttons column container content form group holder icon icons inner item items label left link links list media menu message nav outer panel post posts region right row section slot space stories text title top unit widget wrap wrapper zone".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)(?:>|$)""", re.S)
#: Any attribute with its value, so that no word inside a value is taken for an attribute.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"|'[^']*'""")
#: Words of what readers write; a part so named stays boilerplate however long it is.
COMMENT_WORDS = set("comment comments commentlist respond reply replies disqus discussion feedback".split())
#: Share of a page's text from which an element is no boilerplate, whatever its class or id.
MOST = 0.8
#: Paths that a host has besides its winner.
TEMPLATES = 64
_WORD = re.compile(r"[a-z][a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: A class such as has-sidebar says something about an element's surroundings.
_ABOUT_OTHERS = ("has-", "with-", "no-", "without-")
_DIGITS = re.compile(r"[0-9]+")
_SPACE = re.compile(r"\s+")


class Element:
    """An open element: tag, generalised step of its path, parent, and whether it is boilerplate.

    ``clutter`` is what tags, roles and hiding say. ``words`` are words of its class and id (or its tag form) that
    would make it boilerplate; ``_settle`` decides when the whole page is known whether it is ``marked`` so. Marks
    are not inherited: a container inside a marked element can win, and its ancestors are then no boilerplate.
    """

    __slots__ = ("clutter", "foreign", "inside_link", "marked", "number", "parent", "path", "step", "tag", "words")

    def __init__(self, tag: str, step: str, parent, clutter: bool, number: int, words: frozenset = frozenset()):
        self.tag, self.step, self.parent, self.number, self.words = tag, step, parent, number, words
        self.clutter = clutter or (parent is not None and parent.clutter)
        self.marked = False
        self.foreign = tag in FOREIGN or (parent is not None and parent.foreign)
        self.inside_link = tag == "a" or (parent is not None and parent.inside_link)
        self.path = step if parent is None else parent.path if tag in INLINE else f"{parent.path}>{step}"


class Block:
    """A run of text without a block boundary in it: the text, its length in links, its element."""

    __slots__ = ("element", "linked", "text")

    def __init__(self, text: str, linked: int, element: Element):
        self.text, self.linked, self.element = text, linked, element


def _marks(value: str) -> set[str]:
    """The words of a class or id value that speak of boilerplate."""
    found = set()
    for part in value.split():
        words = _WORD.findall(_CAMEL.sub(" ", part).lower())
        if not words or part.lower().startswith(_ABOUT_OTHERS):
            continue
        found |= {words[0], words[-1]} & BOILERPLATE_WORDS
        found |= {words[-1]} & WEAK_WORDS
        if words[-1] in PART_WORDS:
            found |= {words[0]} & WEAK_WORDS
    return found


def _element(tag: str, attributes: str, parent: Element, number: int) -> Element:
    step, clutter, marks = tag, tag in BOILERPLATE_TAGS or tag in FOREIGN or tag in FALLBACK, frozenset(("form",)) if tag == "form" else frozenset()
    if attributes and not attributes.isspace():
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = (m[1] or "").lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id"):
                if tag not in ("html", "body", "article", "main"):
                    marks |= _marks(value)
                if name == "class" and value:
                    step += "." + ".".join(sorted(_DIGITS.sub("#", v) for v in value.split()))
            elif name == "role":
                clutter |= value.lower() in BOILERPLATE_ROLES
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
                clutter = True
    return Element(tag, step, parent, clutter, number, marks)


def _settle(found: list[Block], elements: list[Element], mains: list[Element]) -> None:
    """Decide which elements are boilerplate by the words of their class and id.

    Those are not that hold main, every article of the page or most of its text, since they are the page's
    layout; nor are paragraphs and headings in an article, for any word that is not about comments.
    """
    marked = {e.number for e in elements if e.words}
    if not marked:
        return
    held, articles, total = dict.fromkeys(marked, 0), dict.fromkeys(marked, 0), 0
    layout, n_articles = set(), sum(e.tag == "article" for e in mains)
    for e in mains:
        up = e.parent
        while up is not None:
            if up.number in marked:
                articles[up.number] += e.tag == "article"
                if e.tag == "main":
                    layout.add(up.number)
            up = up.parent
    for b in found:
        if b.element.clutter:
            continue
        weight = len(b.text) - min(b.linked, len(b.text))
        total += weight
        up = b.element
        while up is not None:
            if up.number in marked:
                held[up.number] += weight
            up = up.parent
    for e in elements:
        if e.words and not e.words & COMMENT_WORDS and e.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre") and _has(e, ("article", "main")):
            layout.add(e.number)
        if e.words and not e.words & COMMENT_WORDS and ((n_articles and articles[e.number] == n_articles) or held[e.number] > MOST * total):
            layout.add(e.number)
    for e in elements:
        e.marked = e.number in marked - layout


def _kept(b: Block, path: str | None = None) -> bool:
    """Whether a block is no boilerplate. Elements around the container path that won are not marked."""
    if b.element.clutter:
        return False
    up = b.element
    while up is not None:
        if up.marked and (path is None or not (path == up.path or path.startswith(f"{up.path}>"))):
            return False
        up = up.parent
    return True


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, without scripts, styles and other elements that are not text."""
    root = Element("", "", None, False, 0)
    out: list[Block] = []
    at, place, n, number = root, 0, len(page), 0
    text: list[str] = []
    linked = 0
    holder = root
    elements: list[Element] = []
    mains: list[Element] = []

    def flush():
        nonlocal linked
        if text:
            whole = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if whole:
                out.append(Block(whole, linked, holder))
            text.clear()
        linked = 0

    while place < n:
        m = _TOKEN.search(page, place)
        upto = m.start() if m else n
        if upto > place:
            if not text:
                holder = at
                while holder.tag in INLINE:
                    holder = holder.parent
            text.append(page[place:upto])
            if at.inside_link:
                linked += upto - place
        if not m:
            break
        place = m.end()
        if m[0].startswith("<![CDATA["):
            text.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            up = at
            while up is not root and up.tag != tag:
                up = up.parent
            if tag not in INLINE:
                flush()
            if up is not root:
                at = up.parent
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        if tag in RAW:
            flush()
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, place)
                # Without an end, scripts and styles go on to the end of the page; others are taken as empty.
                place = end.end() if end else n if tag in ("script", "style") else place
            continue
        if at.foreign and (tag in CLOSES_P or tag in SELF_NESTING or tag in ("body", "section", "article")) and tag != "option":
            while at.foreign:
                at = at.parent
        if (tag in FOREIGN or at.foreign) and m[3].rstrip().endswith("/"):
            continue
        if tag in FOREIGN or tag in FALLBACK:
            flush()
        elif tag not in INLINE and not at.foreign:
            flush()
            close = SELF_NESTING.get(tag)
            if close:
                up, last = at, None
                while up is not root and up.tag not in SCOPE[tag]:
                    if up.tag in close:
                        last = up
                    up = up.parent
                if last is not None:
                    at = last.parent
            if tag in CLOSES_P:
                up = at
                while up is not root and (up.tag in INLINE):
                    up = up.parent
                if up.tag == "p" or (up.tag in ("h1", "h2", "h3", "h4", "h5", "h6") and tag in ("h1", "h2", "h3", "h4", "h5", "h6")):
                    at = up.parent
        number += 1
        at = _element(tag, m[3], at, number)
        elements.append(at)
        if tag in ("article", "main") and not at.clutter:
            mains.append(at)
    flush()
    _settle(found=out, elements=elements, mains=mains)
    return out


def _owner(element: Element) -> Element:
    """The container of a block: the element that holds its paragraph, list or table cell."""
    while element.parent is not None and element.tag in ("p", "li", "ul", "ol", "dl", "dt", "dd", "blockquote", "pre", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "figure", "figcaption"):
        element = element.parent
    return element


def container_scores(found: list[Block]) -> dict[str, float]:
    """Score of each generalised container path: text outside links in its blocks, commas counting more;
    half of it counts for the parent, a quarter for the grandparent. Text that words of classes mark counts for a
    fifth, so that many pages can outvote such a word, and for nothing if the words are about comments."""
    scores: dict[str, float] = {}
    for b in found:
        element = b.element
        if element.clutter or b.linked * 2 > len(b.text):
            continue
        weight = len(b.text) - b.linked + 20 * b.text.count(",")
        up = element
        while up is not None:
            if up.marked:
                weight *= 0.0 if up.words & COMMENT_WORDS else 0.2
                break
            up = up.parent
        if not weight:
            continue
        element = _owner(element)
        share = 1.0
        for _ in range(3):
            if element is None:
                break
            favour = 1.5 if element.tag in ("article", "main") else 1.0
            scores[element.path] = scores.get(element.path, 0.0) + weight * share * favour
            element, share = element.parent, share * 0.5
    return scores


def _lifted(path: str, found: list[Block]) -> set[int]:
    """Numbers of the elements whose text is the article, for the container path that won.

    From the elements on the path up to their nearest article, else their nearest main. Without either, up to
    the smallest element below body with an h1 that is not yet inside, if three quarters of its text are.
    """
    inside = f"{path}>"
    on = [b for b in found if _kept(b, path) and (b.element.path == path or b.element.path.startswith(inside))]
    out: set[int] = set()
    for b in on:
        own = b.element
        while own.parent is not None and (own.tag in INLINE or own.path != path):
            own = own.parent
        up, hit = own, None
        while up is not None:
            if up.tag == "article":
                hit = up
                break
            if up.tag == "main" and hit is None:
                hit = up
            up = up.parent
        out.add((hit or own).number)
    held = sum(len(b.text) for b in on)
    if on and not any(_has(b.element, ("article", "main", "h1")) for b in on):
        for title in found:
            if not _kept(title, path) or not _has(title.element, ("h1",)):
                continue
            above, up = set(), title.element
            while up is not None:
                above.add(up.number)
                up = up.parent
            up = on[0].element
            while up is not None and up.number not in above:
                up = up.parent
            if up is not None and up.parent is not None and up.tag not in ("html", "body"):
                text = sum(len(b.text) for b in found if _kept(b, path) and _within(b.element, {up.number}))
                if held >= 0.75 * text:
                    out.add(up.number)
                    break
    return out


def _has(element: Element, tags: tuple[str, ...]) -> bool:
    while element is not None:
        if element.tag in tags:
            return True
        element = element.parent
    return False


def _within(element: Element, numbers: set[int]) -> bool:
    while element is not None:
        if element.number in numbers:
            return True
        element = element.parent
    return False


def main_text(found: list[Block], path: str | list[str] | None) -> str:
    """Text of the article around the elements on ``path``, without boilerplate in it.

    Of several paths, the one with the best score on the page counts; of none that the page has, its best container.
    """
    paths = [path] if isinstance(path, str) else path or []
    paths = [p for p in paths if any((b.element.path == p or b.element.path.startswith(f"{p}>")) and _kept(b, p) for b in found)]
    if len(paths) != 1:
        scores = container_scores(found)
        paths = paths or list(scores)
        paths = [max(paths, key=lambda p: (scores.get(p, 0.0), p))] if paths else []
    if not paths:
        return ""
    numbers = _lifted(paths[0], found)
    return " ".join(b.text for b in found if _kept(b, paths[0]) and _within(b.element, numbers))


def _votes(batches):
    for batch in batches:
        hosts, paths, shares = [], [], []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            scores = container_scores(blocks(page or ""))
            best = max(scores, key=lambda p: (scores[p], p), default=None)
            for path, score in scores.items():
                hosts.append(host)
                paths.append(path)
                shares.append(1.0 if path == best else 0.25 * score / scores[best])
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(shares, pa.float64())], ["host", "path", "share"])


def _texts(batches, rows: int = 256):
    for whole in batches:
        for i in range(0, whole.num_rows, rows):
            batch = whole.slice(i, rows)
            out = [main_text(blocks(page or ""), path) for page, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["id", "url", "text"])


def host_of(url):
    """Lower-cased host of a URL, without user and port; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def consensus_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, paths): the winning container path of every host, and with it the paths of its templates.

    A template's path is the best of two pages or more, and of half of the pages that have it; a host has up to
    ``TEMPLATES`` of them. Pages without text do not vote.
    """
    ship(pages.sparkSession)
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string"))
    votes = rows.mapInArrow(_votes, "host string, path string, share double")
    # Rounded, so that sums do not depend on their order.
    won = F.sum((F.col("share") == 1.0).cast("long"))
    # Written, as both kinds of winners come from it and pages are to be read once.
    sums = written(votes.groupBy("host", "path").agg(F.sum(F.round(F.col("share") * 1_000_000).cast("long")).alias("votes"), won.alias("won"), F.count(F.lit(1)).alias("pages")))
    best = F.max(F.struct("votes", "path")).alias("best")
    # Spark limits each task's rows of a host before the shuffle, as it combines the maximum.
    steady = (F.col("won") >= 2) & (F.col("won") * 2 >= F.col("pages"))
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("won"), "path"))
    others = sums.filter(steady).withColumn("place", place).filter(F.col("place") <= TEMPLATES)
    others = others.groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("others"))
    out = sums.groupBy("host").agg(best).join(others, "host", "left")
    return out.select("host", F.col("best.path").alias("path"), F.array_union(F.array("best.path"), F.coalesce("others", F.array().cast("array<string>"))).alias("paths"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, broadcast_hosts: int = 100_000) -> DataFrame:
    """(id, url, text) for every page: its main text.

    Character references are decoded, white space inside a block becomes one space, blocks are
    trimmed and joined by one space in page order. A null or empty page, or one without text
    outside boilerplate, has an empty text. Pages whose URL has no host vote together. Rows
    that repeat an id have a row each. Pages are read whole, however long; ties between paths go to the last by name.
    Other columns are not read. An empty table gives no rows.

    The winners are broadcast up to ``broadcast_hosts`` hosts; beyond that, pages are dealt by
    host, those of the largest hosts evenly.
    """
    spark = pages.sparkSession
    paths = written(consensus_paths(pages, url_col, html_col).select("host", "paths"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), host_of(F.col(url_col)).alias("host"))
    if paths.limit(broadcast_hosts + 1).count() <= broadcast_hosts:
        rows = rows.join(F.broadcast(paths), "host", "left").select("id", "url", "html", "paths")
    else:
        sizes = written(rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages")))
        lookup = sizes.join(paths, "host", "left")
        total = sizes.agg(F.sum("pages")).first()[0]
        rows = join_hot(rows, lookup, "host", "pages", F.struct("id", "url"), total).select("id", "url", "html", "paths")
    ship(spark)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_texts, f"id {kind}, url string, text string")
