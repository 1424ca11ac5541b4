"""Main text of web pages: structure, and a style tree of each site that shows which branches repeat."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperledger.llm.common import text_of, written

#: Elements and name parts (of class, id and role) that are never main text. Fixed lists.
DROPPED = frozenset("script style template noscript svg iframe object canvas head nav footer aside form button select textarea input dialog menu".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner sidebar nav navbar navigation menu breadcrumb breadcrumbs "
    "footer cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup login comment comments disqus respond reply "
    "share sharing social related recommended pagination pager skip toolbar widget search contentinfo complementary alert".split()
)
#: Dropped too, but not inside the article, where they hold its title.
HEADERS = frozenset(["header", "masthead"])
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their own end tag.
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template")
#: Elements that may be removed as a branch of the style tree; single paragraphs and headings of an article may not.
BRANCHES = frozenset("div section ul ol dl table figure details center fieldset span td".split())

#: Pages of a site that must share a branch, importance below which it goes, weight of content against presentation.
MIN_PAGES, LEAST, GAMMA = 5, 0.1, 0.9
#: Branches up to which the table of removed ones is broadcast; above, it is joined by host.
BROADCAST_ROWS = 100_000

# A tag up to its end, as long as no other tag opens inside it: what fails here stops at the next "<", so a scan is linear.
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/<>]*+)((?:[^<>\"']|\"[^<\"]*+\"|'[^<']*+')*+)>")
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[a-z]+")
_END = {tag: re.compile(rf"</{tag}\b", re.I) for tag in RAW}
_NAME_END, _MARK, _ANGLE = re.compile(r"[\s/>]"), re.compile("[>\"']"), re.compile("[<>]")
_LONG = re.compile(r"&#([0-9]{9,})")

#: Texts below a branch are hashed in order by a polynomial of this base, modulo a prime.
_BASE, _PRIME = 0x5BD1E9955BD1E995 % ((1 << 61) - 1), (1 << 61) - 1


def unescape(text: str) -> str:
    """Character references decoded; a number beyond all characters is U+FFFD however long it is."""
    if "&#" in text:
        text = _LONG.sub(lambda m: "&#" + (number if len(number := m[1].lstrip("0") or "0") < 8 else "1114112"), text)
    return html.unescape(text)


class _Next:
    """The next place of a pattern at or after a position, asked for in ascending order; each character is searched once."""

    def __init__(self, pattern: re.Pattern, source: str):
        self.pattern, self.source, self.asked, self.found = pattern, source, 0, -1

    def __call__(self, at: int) -> int:
        if not self.asked <= at <= self.found:
            m = self.pattern.search(self.source, at)
            self.asked, self.found = at, m.start() if m else len(self.source)
        return self.found


class _BrokenTags:
    """Tags that other tags seem to open inside, in time linear over all of a page.

    A quote that led to no end of a tag before leads to none again.
    """

    def __init__(self, source: str):
        self.source, self.dead = source, set()
        self.name_end, self.mark, self.angle = (_Next(x, source) for x in (_NAME_END, _MARK, _ANGLE))

    def _quoted_end(self, at: int) -> int:
        """Where the first ``>`` outside of quotes is; -1 if there is none."""
        source, passed, at = self.source, [], self.mark(at)
        while at < len(source) and source[at] != ">":
            close = -1 if at in self.dead else source.find(source[at], at + 1)
            passed.append(at)
            if close < 0:
                at = len(source)
            elif m := _MARK.search(source, close + 1):
                at = m.start()
            else:
                at = len(source)
        if at < len(source):
            return at
        self.dead.update(passed)
        return -1

    def __call__(self, at: int) -> tuple[str, str, str, int] | None:
        """Slash, name, attributes and end of the tag at this ``<``; None if it is text."""
        source = self.source
        first = at + 1 + source.startswith("/", at + 1)
        if not ("a" <= source[first : first + 1].lower() <= "z"):
            return None
        stop = self.name_end(first)
        end = self._quoted_end(stop)
        if end < 0:
            end = self.angle(stop)
            if source[end : end + 1] != ">":
                return None
        return source[at + 1 : first], source[first:stop], source[stop:end], end + 1


class _Element:
    __slots__ = ("tag", "key", "skip", "article", "main", "first", "children")

    def __init__(self, tag, key, skip, article, main, first):
        self.tag, self.key, self.skip, self.article, self.main, self.first, self.children = tag, key, skip, article, main, first, []


class Page:
    """One page, read once and in linear time: text blocks in order, each with the place it stands in, and its branches.

    ``blocks``: ``[text, in_article, in_main]``. By key of each element in
    ``BRANCHES``: ``looks``, its child tags; ``texts``, the hash of the texts
    below; ``spans``, the blocks below. ``removed``: keys to leave out.
    """

    def __init__(self, source: str, removed: frozenset[int] = frozenset()):
        self.blocks: list[tuple[str, bool, bool]] = []
        self.looks: dict[int, list[str]] = {}
        self.texts: dict[int, int] = {}
        self.spans: dict[int, list[range]] = {}
        self.removed = removed
        self.parts: list[str] = []
        self.stack = [_Element("", 0, False, False, False, 0)]
        self.opened: Counter[str] = Counter()  # how often each tag is on the stack
        self.block_at: list[int] = []  # where block elements are on the stack
        self.hashes, self.powers = [0], [1]  # of the first k texts; of the base
        self._read(source)

    def _read(self, source: str) -> None:
        broken, at, last = _BrokenTags(source), 0, source.rfind(">")
        done = 0
        while (at := source.find("<", at)) >= 0:
            if source.startswith("<!--", at):
                end = source.find("-->", at + 4)
                tag, found = None, (len(source) if end < 0 else end + 3)
            elif source[at + 1 : at + 2] in ("!", "?") and at < last:
                tag, found = None, source.find(">", at + 2) + 1
            elif m := _TAG.match(source, at):
                close, tag, attributes, found = m[1], m[2], m[3], m.end()
            elif at < last and (one := broken(at)):
                close, tag, attributes, found = one
            else:
                at += 1
                continue
            if at > done:
                self._text(source[done:at])
            at = done = found
            if not tag:
                continue
            tag = tag.lower()
            if close:
                self._close(tag)
                continue
            self._open(tag, attributes)
            if tag in _END and not attributes.endswith("/"):
                end = _END[tag].search(source, at)
                stop = source.find(">", end.end()) if end else -1
                at = done = stop + 1 if stop >= 0 else len(source)
                self._close(tag)
        if done < len(source):
            self._text(source[done:])
        self._flush()
        while len(self.stack) > 1:
            self._leave()

    def _hash(self, span: range) -> int:
        """Of the texts of these blocks, in order."""
        return (self.hashes[span.stop] - self.hashes[span.start] * self.powers[len(span)]) % _PRIME

    def _text(self, text: str) -> None:
        if not self.stack[-1].skip:
            self.parts.append(unescape(text))

    def _flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                top = self.stack[-1]
                self.blocks.append((text, top.article, top.main))
                self.hashes.append((self.hashes[-1] * _BASE + xxhash.xxh64_intdigest(text)) % _PRIME)
                self.powers.append(self.powers[-1] * _BASE % _PRIME)

    def _open(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self._flush()
            self._imply_end(tag)
        elif tag == "br":
            self._text(" ")
        top = self.stack[-1]
        if tag not in top.children[-1:]:
            top.children.append(tag)
        if tag in VOID:
            return
        names = " ".join(a or b or c for a, b, c in _NAMED.findall(attributes)).lower() if attributes else ""
        parts = set(_PARTS.findall(names))
        article, main = top.article or tag == "article", top.main or tag == "main"
        key = xxhash.xxh64_intdigest(f"{top.key}/{tag}.{' '.join(sorted(parts))}") - (1 << 63)
        skip = top.skip or tag in DROPPED or key in self.removed or (bool(parts & NAMES) and tag not in ("html", "body", "article", "main"))
        skip = skip or (not article and (tag in HEADERS or bool(parts & HEADERS) and tag not in ("html", "body", "main")))
        self.opened[tag] += 1
        if tag in BLOCKS:
            self.block_at.append(len(self.stack))
        self.stack.append(_Element(tag, key, skip, article, main, len(self.blocks)))

    def _imply_end(self, tag: str) -> None:
        """An open paragraph ends at a block; an item, cell or row at the next of its kind."""
        if self.block_at:
            k = self.block_at[-1]
            open_tag = self.stack[k].tag
            if open_tag == "p" or open_tag == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                while len(self.stack) > k:
                    self._leave()

    def _close(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        if self.opened[tag]:
            while self.stack[-1].tag != tag:
                self._leave()
            self._leave()

    def _leave(self) -> None:
        element = self.stack[-1]
        if element.tag in BLOCKS:
            self._flush()
            self.block_at.pop()
        self.stack.pop()
        self.opened[element.tag] -= 1
        if element.tag in BRANCHES and not element.skip:
            span = range(element.first, len(self.blocks))
            self.looks.setdefault(element.key, []).extend(element.children)
            self.texts[element.key] = (self.texts.get(element.key, 0) * self.powers[len(span)] + self._hash(span)) % _PRIME
            self.spans.setdefault(element.key, []).append(span)

    @property
    def branches(self) -> dict[int, tuple[list[str], list[str]]]:
        """Child tags and texts below each branch, to look at: nested branches repeat their texts."""
        return {key: (look, [self.blocks[k][0] for span in self.spans[key] for k in span]) for key, look in self.looks.items()}

    def _main(self) -> list[int]:
        """The blocks of the articles; of the main part if there is no article; of the page if there is neither."""
        for place in (1, 2):
            inside = [k for k, block in enumerate(self.blocks) if block[place]]
            if inside:
                return inside
        return list(range(len(self.blocks)))

    def text(self) -> str:
        return "\n".join(self.blocks[k][0] for k in self._main())

    def spare(self, keys: frozenset[int]) -> frozenset[int]:
        """Those of the branches that may go, smallest first: one with over half of the words still there stays, and so do all larger ones."""
        words = np.zeros(len(self.blocks), np.int64)
        for k in self._main():
            words[k] = len(self.blocks[k][0].split())
        sums = np.concatenate(([0], np.cumsum(words)))
        sizes = {key: sum(int(sums[span.stop] - sums[span.start]) for span in self.spans.get(key, ())) for key in keys}
        left, gone, taken = int(sums[-1]), [], _Taken(words)
        for key in sorted(keys, key=lambda key: (sizes[key], key)):
            spans = self.spans.get(key, ())
            size = sizes[key] - sum(taken.inside(span) for span in spans)
            if size * 2 > left:
                break
            gone.append(key)
            left -= size
            for span in spans:
                taken.take(span)
        return frozenset(gone)


class _Taken:
    """Words of the blocks that were taken out: sums over ranges in logarithmic time, each block is taken once."""

    def __init__(self, words: np.ndarray):
        self.words, self.tree, self.next = words.tolist(), [0] * (len(words) + 1), list(range(len(words) + 1))

    def _before(self, k: int) -> int:
        total = 0
        while k:
            total += self.tree[k]
            k &= k - 1
        return total

    def inside(self, span: range) -> int:
        return self._before(span.stop) - self._before(span.start)

    def _free(self, k: int) -> int:
        """The first block from ``k`` on that was not taken."""
        while self.next[k] != k:
            self.next[k] = k = self.next[self.next[k]]
        return k

    def take(self, span: range) -> None:
        while (k := self._free(span.start)) < span.stop:
            self.next[k] = k + 1
            at = k + 1
            while at < len(self.tree):
                self.tree[at] += self.words[k]
                at += at & -at


def host_of(url: Column | str) -> Column:
    """The host in lower case; empty where there is none."""
    return F.regexp_extract(F.lower(text_of(url)), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)


def style_tree(pages: DataFrame) -> DataFrame:
    """``host, key, pages, importance`` of each branch of each site, from ``host, html``.

    Pages of one host are laid over each other by the path of element names.
    A branch's importance is the entropy, over the pages that have it, of what
    it looks like (its child elements) and of what it says (all text below it),
    each divided by its largest value: 1 if every page differs, 0 if all agree.
    Pages are pre-aggregated by equal values, so a host with a third of all
    pages is a sum like any other.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for host, source in zip(batch["host"], batch["html"]):
                page = Page(source)
                for key, look in page.looks.items():
                    rows.append((host, key, "look", xxhash.xxh64_intdigest(" ".join(look)) - (1 << 63)))
                    rows.append((host, key, "text", page.texts[key]))
            yield pd.DataFrame(rows, columns=["host", "key", "kind", "value"])

    values = pages.where("host <> ''").select("host", "html").mapInPandas(read, "host string, key long, kind string, value long")
    counts = values.groupBy("host", "key", "kind", "value").agg(F.count(F.lit(1)).cast("double").alias("c"))
    sums = counts.groupBy("host", "key", "kind").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("s"))
    entropy = F.when(F.col("n") > 1, F.greatest(F.lit(0.0), F.log("n") - F.col("s") / F.col("n")) / F.log("n")).otherwise(1.0)
    parts = sums.select("host", "key", "n", (entropy * F.when(F.col("kind") == "text", GAMMA).otherwise(1 - GAMMA)).alias("part"))
    return parts.groupBy("host", "key").agg(F.max("n").cast("long").alias("pages"), F.sum("part").alias("importance"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, least: float = LEAST) -> DataFrame:
    """``page_id, url, text`` of each page.

    Scripts, forms, menus and the like go by their names; then branches that
    look and read the same on most of the ``min_pages`` or more pages of a site
    go, unless all branches of that site do, which means that its pages are
    copies. A branch with most of a page's remaining words stays on that page:
    on a site of copies that differ in a date it is the article. Paragraphs and headings are never branches. Null and empty html
    give an empty text; pages with a null or broken url are read without a
    site. Repeated rows are read each time; a page's copies count as pages.
    Empty tables give no row; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_of(html_col).alias("html"), host_of(url_col).alias("host"))
    tree = style_tree(rows).groupBy("host").agg(
        F.collect_list(F.when((F.col("pages") >= min_pages) & (F.col("importance") < least), F.col("key"))).alias("removed"),
        F.max("importance").alias("most"),
    )
    tree = written(tree.where((F.size("removed") > 0) & (F.col("most") >= least)).select("host", "removed"))
    size = tree.agg(F.coalesce(F.sum(F.size("removed")), F.lit(0)).alias("n")).head()["n"]
    joined = rows.join(F.broadcast(tree) if size <= BROADCAST_ROWS else tree, "host", "left").select("page_id", "url", "html", "removed")

    @F.pandas_udf("string")
    def main_text(sources: pd.Series, removed: pd.Series) -> pd.Series:
        out = []
        for source, keys in zip(sources, removed):
            page = Page(source)
            gone = frozenset() if keys is None else page.spare(frozenset(keys))
            out.append((Page(source, gone) if gone else page).text())
        return pd.Series(out, dtype=object)

    return joined.select("page_id", "url", main_text("html", "removed").alias("text"))
