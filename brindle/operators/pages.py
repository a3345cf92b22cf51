"""Text blocks of HTML pages, in document order, from the standard parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..shipping import map_pandas

_ENDS_PARAGRAPH = frozenset("p div ul ol li h1 h2 h3 h4 h5 h6 table section article main footer header nav aside blockquote form dl".split())
_VOID = frozenset("br hr img input link meta wbr area base col embed source track".split())


class _Blocks(HTMLParser):
    """Collects (tag, text, inside main, inside article); a block's text includes what it nests."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.done, self.open, self.skip = [], [], [], 0
        self.has = set()

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            self.handle_data(" ")
            return
        if tag in _ENDS_PARAGRAPH and "p" in self.stack:
            self._close("p")
        if tag == "li" and "li" in self.stack and not {"ul", "ol"} & set(self.stack[len(self.stack) - self.stack[::-1].index("li") :]):
            self._close("li")
        self.stack.append(tag)
        self.skip += tag in V.STRIP_TAGS
        if tag in ("main", "article", "body"):
            self.has.add(tag)
        if tag in V.BLOCK_TAGS and not self.skip:
            block = [tag, [], "main" in self.stack, "article" in self.stack]
            self.open.append(block)
            self.done.append(block)

    def _close(self, tag):
        while self.stack:
            top = self.stack.pop()
            self.skip -= top in V.STRIP_TAGS
            if top in V.BLOCK_TAGS and self.open and self.open[-1][0] == top and not self.skip:
                self.open.pop()
            if top == tag:
                return

    def handle_endtag(self, tag):
        if tag in self.stack:
            self._close(tag)

    def handle_data(self, data):
        if not self.skip:
            for block in self.open:
                block[1].append(data)


def parse(html: str) -> list[tuple[str, str]]:
    """(tag, text) of the blocks in the main element, else the article, else the whole page."""
    p = _Blocks()
    p.feed(html)
    p.close()
    place = 2 if "main" in p.has else 3 if "article" in p.has else None
    out = []
    for tag, parts, *inside in p.done:
        text = " ".join("".join(parts).replace("​", "").split())
        if len(text) < 3 or (place and not inside[place - 2]):
            continue
        if tag in ("button", "summary"):
            if len(text) < V.MIN_BUTTON_CHARS or text.lower().strip(" .:->") in V.UI_PHRASES:
                continue
            tag = "h4"
        out.append((tag, text))
    return out


def blocks(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, n, tag, text and key of every block."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [[{"tag": t, "text": x} for t, x in parse(h)] for h in pdf["html"].fillna("")]
            yield pd.DataFrame({"page_id": pdf["page_id"], "made": made})

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(html).cast("string").alias("html"))
    found = map_pandas(rows, run, "page_id long, made array<struct<tag: string, text: string>>")
    flat = found.select("page_id", F.posexplode("made").alias("n", "b"))
    return flat.select("page_id", "n", "b.tag", "b.text", T.block_key(F.col("b.text")).alias("key"))
