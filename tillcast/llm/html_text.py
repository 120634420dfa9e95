"""Main text of web pages by removal of what their site repeats.

Every element's subtree is hashed from its tag, its names and its contents. How many different pages of a
host hold a hash is counted in Spark (copies of a page count once); subtrees found on many of them are the host's
template and are deleted. What holds paragraphs or headings is template only if half of the host's pages have it, and never if it
is most of the page's text: a text that several pages carry is no template. Text blocks of an article stay
even if other pages have them too. What no page repeats word for word (a footer with a date, an
advert of the day) is told by the landmarks of HTML: navigation, headers, footers, asides, forms, and names such as
"ad" or "comments". A name counts as a whole: "has-sidebar" is none of them. Articles inside of an element with
such a name are taken if the page has no others, and such an element stays if it holds the main heading.

The hashes that recur are few: each is on at least ``MIN_SHARE`` of the pages of its host, so a host has at most
elements-per-page / ``MIN_SHARE`` of them. They reach the pages by a join on the host, broadcast only when counted
to be below ``BROADCAST_NODES``. Pages are parsed twice and not shuffled then. Parsing takes time and memory in proportion to a
page's length, however broken it is: each character is looked at a fixed number of times.

Null pages and pages without text give an empty text. Pages whose url is null or has no host are a host of
their own. Repeated rows have a text each.
"""

from __future__ import annotations

import functools
import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.llm.common import workspace, written

MIN_PAGES = 5
MIN_SHARE = 0.02
#: The same for what holds paragraphs or headings.
TEXT_SHARE = 0.5
BROADCAST_NODES = 100_000

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary"
    " table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset(
    "head script style noscript template iframe object embed svg canvas audio video nav footer aside form"
    " button select option textarea input label dialog menu title".split()
)
TEXT_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dl dt dd ul ol table tbody thead tr td th figure figcaption".split())
#: Open elements of some kinds end where another begins, unless a bound lies between: kinds, bounds, and what ends them.
HOLDS_P = frozenset("button td th caption object html body article section div main table".split())
P_ENDS = BLOCK - {"body", "html", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "summary", "figcaption", "li", "dd", "dt"} | {"p"}
SCOPES = (
    ({"p"}, HOLDS_P, P_ENDS),
    ({"li"}, {"ul", "ol", "menu"}, {"li"}),
    ({"dt", "dd"}, {"dl"}, {"dt", "dd"}),
    ({"tr"}, {"table"}, {"tr"}),
    ({"td", "th"}, {"tr", "table"}, {"td", "th"}),
    ({"option"}, {"select"}, {"option"}),
)
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())

#: Words in a class, id or role that tell what is no article.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies"
    " consent gdpr notice notices popup modal overlay newsletter subscribe subscription sidebar menu nav navbar"
    " navigation breadcrumb breadcrumbs footer masthead comment comments respond disqus share sharing social related"
    " recommended widget pagination pager search login signup toolbar contentinfo complementary alert dialog".split()
)
#: Words that may stand beside them in a name.
BESIDE = frozenset(
    "box boxes wrap wrapper container block bar slot item items link links list area section site top bottom left"
    " right primary secondary inner outer post posts unit zone icon icons button buttons form main global".split()
)
COMMENT = frozenset(("comment", "comments"))

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
#: As far as a tag goes that does not end, and a tag without regard to quotes.
OPEN_TAG = re.compile(r"</?[a-zA-Z][^\s/>]*(?:[^>\"']|\"[^\"]*\"|'[^']*')*+")
SHORT_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>")
NAMES = re.compile(r"(?:^|\s)(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
WORD = re.compile(r"[a-z]+")


class Element:
    __slots__ = ("tag", "names", "noise", "comment", "hidden", "inside", "open", "parts", "hash", "text", "heading")

    def __init__(self, tag: str, inside: bool, open_: tuple):
        self.tag, self.inside, self.open = tag, inside, open_
        self.names: frozenset = frozenset()
        self.noise = self.comment = self.hidden = False
        self.parts: list = []
        self.hash = 0
        self.text = tag in TEXT  # is or holds a paragraph, a heading and the like
        self.heading = tag == "h1"

    def attributes(self, written_: str) -> None:
        named = NAMES.findall(written_)
        values = [f"{n[1]} {n[2]} {n[3]}".lower() for n in named]
        self.names = frozenset(w for v in values for w in WORD.findall(v))
        self.hidden = any(n[0].lower() == "hidden" for n in named)
        for name in (x for v in values for x in v.split()):
            self.noise |= is_noise_name(name) or not self.inside and name in ("header", "site-header", "page-header")
            self.comment |= name in COMMENT


@functools.lru_cache(4096)
def is_noise_name(name: str) -> bool:
    """Whether a name is made of words for what is no article, and such as may stand beside them."""
    found = set(WORD.findall(name))
    return bool(found & NOISE) and found <= NOISE | BESIDE


def parse(page: str) -> Element:
    """The tree of a page. Ends that were left out are put in, stray ones ignored.

    Where a tag does not end, the signs up to there are read without regard to quotes, or as text.
    """
    root = Element("", False, (0,) * len(SCOPES))
    stack, at, size = [root], 0, len(page)
    opened: Counter = Counter()
    last_end, stuck = page.rfind(">"), 0

    def close(depth: int) -> None:
        while len(stack) > depth:
            element = stack.pop()
            opened[element.tag] -= 1
            _finish(element)

    while at < size:
        begin = page.find("<", at)
        if begin < 0 or begin > last_end and not page.startswith("<!--", begin):
            stack[-1].parts.append(page[at:])
            break
        sign, found = page[begin + 1 : begin + 2], None
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            end = size if end < 0 else end + 3
        elif sign.isascii() and (sign.isalpha() or sign == "/" and page[begin + 2 : begin + 3].isalpha()):
            if begin >= stuck:
                found = TAG.match(page, begin)
                if found is None:
                    open_ = OPEN_TAG.match(page, begin)
                    stuck = open_.end() if open_ else begin
            found = found or SHORT_TAG.match(page, begin)
            end = found.end() if found else begin + 1
        elif sign and sign in "!?/":
            end = page.find(">", begin) + 1
        else:
            end = begin + 1
        is_text = end == begin + 1
        text = page[at : end if is_text else begin]
        if text:
            stack[-1].parts.append(text)
        at = end
        if found is None:
            continue
        tag = found[2].lower()
        if found[1]:
            if opened[tag] > 0:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        for k, (_, _, ends) in enumerate(SCOPES):
            if tag in ends and stack[-1].open[k]:
                close(stack[-1].open[k])
        above = stack[-1]
        element = Element(tag, above.inside or tag in ("article", "main"), above.open)
        if found[3].strip():
            element.attributes(found[3])
        above.parts.append(element)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            element.parts.append(page[at : end.start() if end else size])
            at = end.end() if end else size
            _finish(element)
        elif tag in VOID or found[3].endswith("/"):
            _finish(element)
        else:
            for k, (kinds, bounds, _) in enumerate(SCOPES):
                if tag in kinds or tag in bounds:
                    now = len(stack) if tag in kinds else 0
                    element.open = (*element.open[:k], now, *element.open[k + 1 :])
            opened[tag] += 1
            stack.append(element)
    close(0)
    return root


def _finish(element: Element) -> None:
    _hash(element)
    for part in element.parts:
        if not isinstance(part, str):
            element.text |= part.text
            element.heading |= part.heading


def _hash(element: Element) -> None:
    made = hashlib.blake2b(f"{element.tag} {sorted(element.names)}".encode(), digest_size=8)
    for part in element.parts:
        if isinstance(part, str):
            made.update(" ".join(part.split()).encode("utf-8", "surrogatepass"))
        else:
            made.update(part.hash.to_bytes(8, "little", signed=True))
    element.hash = int.from_bytes(made.digest(), "little", signed=True)


def may_go(element: Element) -> bool:
    """Whether recurring makes the element a piece of template."""
    if element.tag in ("", "html", "body", "head", "article", "main", "br", "hr"):
        return False
    return not element.inside or element.tag in BLOCK - TEXT_BLOCK


def nodes(root: Element) -> dict[int, bool]:
    """Hashes of the subtrees of a page that could be template, and whether they hold text."""
    found, left = {}, [root]
    while left:
        element = left.pop()
        if may_go(element) and element.parts:
            found[element.hash] = element.text
        left += [p for p in element.parts if not isinstance(p, str) and p.tag != "head"]
    return found


def is_noise(element: Element, by_name: bool = True) -> bool:
    """Whether an element is none of the main text by its tag or, if asked, by its names."""
    if element.tag == "form" and element.heading:  # round the whole page
        return False
    if element.tag in NEVER or element.hidden:
        return True
    if element.tag == "header":
        return not element.inside
    if element.tag in ("html", "body", "main") or not by_name:
        return False
    if element.tag == "article":
        return element.comment
    return element.noise and not element.heading


def main_text(root: Element, template: set[int]) -> str:
    """The text of the articles, or of the page if it has none, in blocks."""
    found = _articles(root) or _articles(root, by_name=False) or [root]
    texts = _blocks(found, template, True)
    if template:
        plain = _blocks(found, template, False)
        if 2 * sum(map(len, texts)) < sum(map(len, plain)):  # that is no template
            texts = plain
    return "\n\n".join(texts)


def _blocks(found: list[Element], template: set[int], with_text: bool) -> list[str]:
    """Text blocks without noise and template; of the template's elements ``with_text`` or only the others."""
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        words = html.unescape("".join(line)).split()
        line.clear()
        if words:
            blocks.append(" ".join(words))

    def walk(start: Element) -> None:
        left: list = [start]
        while left:
            part = left.pop()
            if isinstance(part, str):
                line.append(part)
            elif part is None:
                end()
            elif part is not start and is_noise(part) or (
                part.hash in template and (with_text or not part.text) and may_go(part)
            ):
                line.append(" ")
                if part.tag in BLOCK:
                    end()
            else:
                if part.tag in BLOCK:
                    end()
                    left.append(None)
                elif part.tag in ("br", "wbr", "img"):
                    line.append(" " if part.tag != "wbr" else "")
                left += reversed(part.parts)
        end()

    for element in found:
        walk(element)
    return blocks


def _articles(root: Element, by_name: bool = True) -> list[Element]:
    """Outermost articles outside of noise; a main element counts if it has none itself."""
    found: list[Element] = []
    mains: list[Element] = []
    left = [root]
    while left:
        element = left.pop()
        if is_noise(element, by_name) and not (element.tag == "form" and element is not root):
            continue
        if element.tag == "article":
            if not element.comment:
                found.append(element)
            continue
        if element.tag == "main":
            mains.append(element)
        left += [p for p in reversed(element.parts) if not isinstance(p, str)]
    return found or mains[:1]


# --- in Spark -------------------------------------------------------------------------


def site_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("node", pa.int64()), ("text", pa.bool_())]))
    for batch in batches:
        found = [
            [{"node": n, "text": t} for n, t in sorted(nodes(parse(page.as_py() or "")).items())]
            for page in batch.column(2)
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(found, kind)], names=["site", "page", "nodes"]
        )


def recurring(
    pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, text_share: float = TEXT_SHARE
) -> DataFrame:
    """``site`` and ``node`` for the subtrees on many different pages of their host, of (site, html)."""
    named = pages.select("site", F.xxhash64("html").alias("page"), "html")
    sizes = named.groupBy("site").agg(F.count_distinct("page").alias("pages"))
    counts = (
        named.mapInArrow(_nodes, "site string, page bigint, nodes array<struct<node: bigint, text: boolean>>")
        .select("site", "page", F.inline("nodes"))
        .groupBy("site", "node", "text")
        .agg(F.count_distinct("page").alias("found"))
        .where(F.col("found") >= min_pages)
    )
    share = F.when(F.col("text"), text_share).otherwise(min_share)
    return (
        counts.join(sizes, "site").where(F.col("found") >= share * F.col("pages")).select("site", "node").distinct()
    )


def _texts(html_at: int, template_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                main_text(parse(page.as_py() or ""), set(template.as_py() or ()))
                for page, template in zip(batch.column(html_at), batch.column(template_at))
            ]
            kept = [i for i in range(batch.num_columns) if i not in (html_at, template_at)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(texts, pa.string())],
                names=[*(batch.schema.field(i).name for i in kept), "text"],
            )

    return run


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url`` and ``text`` of every row of ``pages`` (page_id, url, html)."""
    own = pages.select(
        "page_id", "url", F.col("html").cast("string").alias("html"), site_of(F.col("url")).alias("site")
    )
    template = recurring(own.select("site", "html")).groupBy("site").agg(F.collect_list("node").alias("template"))
    template = written(template, workspace(pages.sparkSession, "template"))
    few = (template.agg(F.sum(F.size("template"))).first()[0] or 0) <= BROADCAST_NODES
    met = own.join(F.broadcast(template) if few else template, "site", "left").select(
        "page_id", "url", "html", "template"
    )
    schema = own.select("page_id", "url").schema.add("text", "string")
    return met.mapInArrow(_texts(2, 3), schema)
