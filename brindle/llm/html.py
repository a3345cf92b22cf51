"""Main text of web pages by site style trees (operator 7).

Pages of one host share templates.  Merging their element trees by path gives the host's style
tree; for each branch (a chain of container elements with their first class or id) it counts the
pages that hold it and, for every content found there, the pages that hold that content.  Pages of
a host with the same main text count as one, so copies make nothing a template.  A
content on k of a branch's m pages has entropy log k / log m: near 0 for what is told once, near 1
for what every page repeats.  A branch's content importance is one minus the mean entropy of its
contents; its presentation importance is the entropy of its looks (the sequences of child tags).
The composite is content + DAMP x presentation x (1 - content).  In a branch below ``threshold`` the
contents whose own composite (from their own entropy) is below it too are removed from each page of
the host; what few pages hold stays, and branches under it answer for themselves.

Some elements say themselves what they are.  Navigation, footers, asides, forms and the like, and
elements so named by class, id or role, have importance zero and are not counted; paragraphs, headings and the article
element itself are never removed for being repeated.  A name counts when a whole class or id says it
("sidebar", or "share-links" where all parts are of that kind; not "has-sidebar").  It does not count
on main elements, on the page's largest article and on what holds one of these; an article is noise
by its own name only if that is a whole class.  A form counts like such a name, and on a page without
main element and article neither counts on what holds more than half of the text; a name of which one part says comments counts whatever its other
parts.  Inline elements that are hidden, adverts or share links go.  An article with less than a quarter of the
largest one's text tells of another page and goes, with the section around it.  The text is what stands in the
main element or, on a page without one where articles hold most of the text, in the articles; else what the
style tree leaves.

Defined results: null and empty pages give an empty text; the longest pages are read whole; a null url
is the host ''; repeated rows give repeated rows, each with the text that one of them would have; pages
of equal main text have equal contents, of which none counts as repeated; an empty table gives an empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from . import kernels
from .components import SALTS, copied
from .storage import materialize

THRESHOLD, DAMP = 0.5, 0.1

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(script|style|noscript|template|textarea|iframe|title|svg)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# Elements by role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section "
    "summary table tbody td tfoot th thead tr ul".split()
)
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot pre figcaption caption summary legend hgroup".split())
NOISE = frozenset("nav footer aside form button select dialog menu search head object embed applet map audio video canvas".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent "
    "gdpr notice notices alert popup modal overlay newsletter subscribe signup login sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead topbar toolbar pager pagination share sharing social related recommended "
    "comment comments reply replies disqus respond widget form skip adsbygoogle".split()
)
#: Parts that make a name say reader comments whatever stands beside them, but for those that speak of another element's.
COMMENT_PARTS = frozenset("comment comments discussion discussions disqus replies respond responses".split())
ABOUT_PARTS = frozenset("has have with without no not hide show enable enabled disable disabled open closed allow count".split())
#: Names that take inline elements away too.
INLINE_NAMES = frozenset("ad ads adv advert advertisement advertising adsense adsbygoogle sponsor sponsored promo promotion share sharing".split())
OUTER_NAMES = frozenset("header head".split())
#: Parts that may stand beside a name in one class or id without changing what it says.
PLAIN_PARTS = frozenset(
    "site page post article entry blog story news global primary secondary main left right top bottom inner outer wrap wrapper "
    "container box block bar area section list links link items item group row col column panel button buttons icon icons text "
    "title heading posts articles stories products topics more read tags tag field input email message info policy slot unit zone "
    "sticky fixed mobile desktop google image media".split()
)
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "tbody": frozenset(["thead", "tbody", "tr", "td", "th"]),
    "option": frozenset(["option"]),
}
FENCE = {"li": frozenset("ul ol menu".split()), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table"]), "th": frozenset(["table"]), "tbody": frozenset(["table"]), "option": frozenset(["select"])}


class Node:
    """An open element: its tag, branch, whether it is noise whatever it holds, its kind of main content (1 main,
    2 article, 3 article in main), the elements down to it that are noise by name, and its outermost article."""

    __slots__ = ("tag", "branch", "noise", "main", "named", "article", "number")

    def __init__(self, tag, branch, noise, main, named, article, number=0):
        self.tag, self.branch, self.noise, self.main, self.named, self.article, self.number = tag, branch, noise, main, named, article, number


def _names(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)}


_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


@lru_cache(1 << 16)
def _named(classes: str) -> tuple[bool, bool, bool, bool]:
    """Whether class and id names say noise, a page's head, noise by a whole name, or reader comments by a part."""
    noise = outer = whole = said = False
    for name in classes.split():
        parts = [x for x in re.split(r"[^a-z0-9]+", _CAMEL.sub("-", name).lower()) if x and not x.isdigit()]
        if all(x in NOISE_NAMES or x in OUTER_NAMES or x in PLAIN_PARTS for x in parts):
            noise = noise or not NOISE_NAMES.isdisjoint(parts)
            outer = outer or not OUTER_NAMES.isdisjoint(parts)
        said = said or not COMMENT_PARTS.isdisjoint(parts) and ABOUT_PARTS.isdisjoint(parts)
        whole = whole or name.lower() in NOISE_NAMES
    return noise, outer, whole, said


def _hidden(names: dict[str, str]) -> bool:
    return "hidden" in names or names.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none", names.get("style", ""), re.I))


def _muted(raw: str) -> bool:
    """Whether an inline element is hidden, an advert or a share link."""
    names = _names(raw)
    classes = f"{names.get('class', '')} {names.get('id', '')}"
    parts = re.split(r"[^a-z0-9]+", _CAMEL.sub("-", classes).lower())
    return _hidden(names) or _named(classes)[0] and not INLINE_NAMES.isdisjoint(parts)


def _open(tag: str, raw: str, above: Node, n: int) -> Node:
    """The element that is the page's ``n``-th."""
    noise, main, branch, named, article = above.noise, above.main, above.branch, above.named, above.article
    names = _names(raw) if raw.strip(" /\n\t\r") else {}
    own_article = tag == "article" or names.get("itemprop") == "articleBody"
    own_main = tag == "main" or names.get("role", "").lower() == "main"
    if tag == "form":
        named = (*named, n)  # whole sites stand in a form
    elif tag in NOISE or (tag == "header" and not main):
        noise = True
    elif names and tag not in ("html", "body"):
        if names.get("role", "").lower() in NOISE_ROLES or _hidden(names):
            noise = True
        told, outer, whole, said = _named(f"{names.get('class', '')} {names.get('id', '')}")
        if not own_main and (whole if own_article else told or said or outer and not main):
            named = (*named, n)
    if own_article:
        article = article or n
        main = 3 if main in (1, 3) else 2
    elif own_main:
        main = 3 if main >= 2 else 1
    if tag in BLOCK and tag not in LEAF and tag not in ("html", "body"):
        own = (names.get("class", "").split() or [""])[0] or names.get("id", "")
        branch = f"{branch}/{tag}.{own}" if own else f"{branch}/{tag}"
    return Node(tag, branch, noise, main, named, article, n)


#: An article beside the page's own that has less than this share of its text tells of another page.
TEASER = 0.25


def _articles(found: list[tuple[str, Node]], opened: dict[int, tuple[int, ...]]) -> tuple[int | None, dict[int, int]]:
    """The page's largest article, and the size of every outermost article."""
    sizes: dict[int, int] = {}
    for text, top in found:
        if top.article and not top.noise and len(top.named) <= len(opened[top.article]):
            sizes[top.article] = sizes.get(top.article, 0) + len(text)
    own = lambda n: n in opened[n]
    return max(sizes, key=lambda n: (not own(n), sizes[n], -n), default=None), sizes


def _unnamed(found: list[tuple[str, Node]], opened: dict[int, tuple[int, ...]], mains: set[int], best: int | None) -> set[int]:
    """The elements whose names do not count: those that hold a main element or the largest article, that article, and
    on a page without either those that hold more than half of its text."""
    free = set(mains)
    if best is not None:
        free.update(opened[best])
    held: dict[int, int] = {}
    every = 0
    for text, top in found if best is None and not mains else ():
        if not top.noise:
            every += len(text)
            for n in top.named:
                held[n] = held.get(n, 0) + len(text)
    free.update(n for n, size in held.items() if 2 * size > every)
    return free


def _teasers(best: int | None, sizes: dict[int, int], above: dict[int, int], plain: set[int]) -> set[int]:
    """Articles that only tell of other pages, with the element around them where it holds nothing of the page's own."""
    if best is None:
        return set()
    own, n = {best}, best
    while n in above:
        n = above[n]
        own.add(n)
    small = {n for n, size in sizes.items() if n != best and size < TEASER * sizes[best]}
    return small | {above[n] for n in small if above.get(n) in plain and above[n] not in own}


def blocks(page: str) -> tuple[list[tuple[str, str, bool, int]], dict[str, str]]:
    """A page's text blocks in order, as (text, branch, noise, main), and each branch's look.

    main: 0 outside, 1 in the main element, 2 in an article, 3 in both, 4 the heading (h1) of the main element.
    """
    stack = [Node("", "", False, 0, (), 0)]
    out: list[tuple[str, Node]] = []
    opened: dict[int, tuple[int, ...]] = {}
    mains: set[int] = set()
    above: dict[int, int] = {}
    plain: set[int] = set()
    mute = ["", 0]
    count = 0
    looks: dict[str, list[str]] = {}
    text: list[str] = []

    def flush() -> None:
        if text:
            words = _html.unescape("".join(text)).split()
            text.clear()
            if words:
                out.append((" ".join(words), stack[-1]))

    def close(names: frozenset[str], fence: frozenset[str]) -> None:
        for n in range(len(stack) - 1, 0, -1):
            if stack[n].tag in names:
                flush()
                del stack[n:]
                return
            if stack[n].tag in fence:
                return

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at and not mute[1]:
            text.append(page[at : m.start()])
        at = m.end()
        if m[3] is None:
            continue
        tag = m[3].lower()
        if mute[1] and tag == mute[0]:
            mute[1] += -1 if m[2] else 1
            continue
        if tag == "br":
            text.append(" ")
        if tag not in BLOCK and tag not in NOISE:
            if not mute[1] and not m[2] and tag not in VOID and len(m[4] or "") > 5 and _muted(m[4]):
                mute[:] = [tag, 1]
            continue
        mute[1] = 0  # an inline element ends where a block begins or ends
        if m[2]:
            flush()
            close(frozenset([tag]), frozenset())
            continue
        flush()
        if tag in CLOSES:
            close(CLOSES[tag], FENCE[tag])
        for n in range(len(stack) - 1, 0, -1):  # a paragraph ends where another block begins
            if stack[n].tag == "p":
                del stack[n:]
                break
            if stack[n].tag not in ("h1", "h2", "h3", "h4", "h5", "h6"):
                break
            if tag in LEAF:
                del stack[n:]
                break
        parent = stack[-1]
        seen = looks.setdefault(parent.branch, [])
        if not seen or seen[-1] != tag:
            seen.append(tag)
        if tag not in VOID:
            count += 1
            new = _open(tag, m[4] or "", parent, count)
            stack.append(new)
            above[count] = parent.number
            if tag in ("section", "div", "ul", "ol", "li", "aside"):
                plain.add(count)
            if new.article == count:
                opened[count] = new.named
            if new.main in (1, 3) and parent.main not in (1, 3) and not new.noise:
                mains.update(new.named)
    if at < len(page) and not mute[1]:
        rest = page[at:]
        text.append(rest[: rest.find("<")] if "<" in rest and re.match(r"[a-zA-Z/!?]", rest[rest.find("<") + 1 :]) else rest)
    flush()
    best, sizes = _articles(out, opened)
    free = _unnamed(out, opened, mains, best)
    others = _teasers(best, sizes, above, plain)

    def elsewhere(n: int) -> bool:
        while n:
            if n in others:
                return True
            n = above.get(n, 0)
        return False

    kind = lambda top: 4 if top.main == 1 and top.tag == "h1" else top.main
    told = [(text, top.branch, top.noise or not free.issuperset(top.named) or bool(others) and elsewhere(top.number), kind(top)) for text, top in out]
    return told, {branch: ">".join(tags) for branch, tags in looks.items()}


def _place(block: tuple[str, str, bool, int]) -> int:
    """A content and its branch as one hash."""
    return xxhash.xxh64_intdigest(f"{block[1]}\0{block[0]}") >> 1


def _chosen(found: list[tuple[str, str, bool, int]]) -> str:
    """The main text among blocks that are not noise."""
    sizes = [0, 0, 0, 0, 0]
    for b in found:
        sizes[b[3]] += len(b[0])
    rest, main, outside, inside, head = sizes
    main += head
    if main or inside:  # a main element, with what stands around its articles
        kinds = (1, 2, 3, 4) if outside > main + inside else (1, 3, 4)  # articles beside it that hold more do not go
    else:
        kinds = (2,) if outside >= rest and outside else (0, 2)
    return "\n\n".join(b[0] for b in found if b[3] in kinds)


def main_text(page: str, low: frozenset[int] | set[int] = frozenset()) -> str:
    """The page's main text, without the contents in ``low`` (hashes of ``_place``)."""
    return _chosen([b for b in blocks(page)[0] if not b[2] and not (low and _place(b) in low)])


def _hosted(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), F.col(html_col).cast("string").alias("html"))


def style_tree(rows: DataFrame) -> DataFrame:
    """host, branch, pages and importance of every branch of every host's tree, with the place (hash of
    ``_place``) and own importance of each content there (rows as of ``_hosted``)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.small_batches(batches, "html"):
            hosts, votes, names, kinds, hashes = [], [], [], [], []
            for host, page in zip(batch.column("host").to_pylist(), kernels.text_bytes(batch.column("html"))):
                found, looks = blocks(page.decode())
                found = [b for b in found if not b[2]]
                vote = xxhash.xxh64_intdigest(_chosen(found)) >> 1
                held = {(b[1], 1, _place(b)) for b in found}
                held |= {(b[1], 0, 0) for b in found}
                held |= {(b, 2, xxhash.xxh64_intdigest(look) >> 1) for b, look in looks.items()}
                for branch, kind, h in held:
                    hosts.append(host), votes.append(vote), names.append(branch), kinds.append(kind), hashes.append(h)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(votes, pa.int64()), pa.array(names, pa.string()), pa.array(kinds, pa.int32()), pa.array(hashes, pa.int64())],
                ["host", "vote", "branch", "kind", "hash"],
            )

    told = map_arrow(rows.select("host", "html"), run, "host string, vote long, branch string, kind int, hash long").distinct()
    counts = materialize(told.groupBy("host", "branch", "kind", "hash").agg(F.count("*").alias("k")), "contents")
    on = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x).otherwise(0.0))
    k = F.col("k").cast("double")
    tree = counts.groupBy("host", "branch").agg(
        on(0, k).alias("pages"), on(1, k).alias("held"), on(1, k * F.log(k)).alias("repeated"),
        on(2, k).alias("looked"), on(2, k * F.log(k)).alias("alike"),
    )
    size = F.log(F.col("pages"))
    content = F.when(F.col("pages") > 1, 1 - F.col("repeated") / F.col("held") / size).otherwise(1.0)
    look = F.when((F.col("pages") > 1) & (F.col("looked") > 0), (F.log("looked") - F.col("alike") / F.col("looked")) / size).otherwise(0.0)
    tree = tree.filter("pages > 0").withColumn("content", content).withColumn("look", F.greatest(F.lit(0.0), F.least(F.lit(1.0), look)))
    with_look = lambda x: x + F.lit(DAMP) * F.col("look") * (1 - x)
    tree = tree.select("host", "branch", F.col("pages").cast("long").alias("pages"), "look", with_look(F.col("content")).alias("importance"))
    own = F.when(F.col("pages") > 1, 1 - F.log("k") / F.log("pages")).otherwise(1.0)
    # a host's repeated contents only: what a single page holds has importance 1
    many = counts.filter("kind = 1 and k > 1").select("host", "branch", F.col("hash").alias("place"), "k")
    return tree.join(many, ["host", "branch"], "left").select("host", "branch", "pages", "importance", "place", with_look(own).alias("own"))


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    threshold: float = THRESHOLD, most_broadcast: int = 200_000,
) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    rows = _hosted(pages, id_col, url_col, html_col)
    low = style_tree(rows).filter((F.col("importance") < threshold) & (F.col("own") < threshold)).filter("branch <> '' and place is not null")
    low = materialize(low.filter(~F.element_at(F.split("branch", "/"), -1).rlike(r"^(article|main)(\.|$)")).select("host", "place"), "places")
    spark = pages.sparkSession
    if low.count() <= most_broadcast:
        known: dict[str, set[int]] = {}
        for r in low.toLocalIterator():
            known.setdefault(r.host, set()).add(r.place)
        shared = spark.sparkContext.broadcast(known)
        given = rows.withColumn("low", F.lit(None).cast("array<long>"))
    else:  # beyond the bound each page meets its host's contents by a join, a large host in several tasks
        shared = None
        by_host = copied(low.groupBy("host").agg(F.collect_set("place").alias("low")))
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        given = salted.join(by_host, ["host", "salt"], "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.small_batches(batches, "html"):
            lows = [shared.value.get(h, ()) for h in batch.column("host").to_pylist()] if shared else batch.column("low").to_pylist()
            texts = [main_text(p.decode(), set(x or ())) for p, x in zip(kernels.text_bytes(batch.column("html")), lows)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_arrow(given.select("page_id", "url", "host", "html", "low"), run, "page_id long, url string, text string, n_chars long")
