"""Main text of web pages, with site templates removed.

Every block element's subtree is hashed (tags and text). Spark counts, per host, the different pages that hold each
hash; a subtree that recurs on several pages of a host is part of its template and is deleted from all of them,
however small a share of a large host they are. Copies of one page count once: they are no sign of a template.
Paragraphs and headings inside an article are never taken for template: many pages of a host may tell the same.
Hashes meet counts as rows, so each page is sent its own recurring hashes only; there is no list of a host.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from functools import lru_cache
from hashlib import blake2b

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, saved, table

#: A subtree is template if it is on so many different pages of a host.
LEAST_PAGES = 5

#: What a tag has up to its end. A quote opens a value only after "="; its partner, however far away, ends it, unless that is
#: plainly the start of another value: then, or without a partner, the first quote was never closed and ends nothing.
#: No quote is looked for twice, so the reading is linear.
ATTRIBUTES = r"""(?:[^>=]++|=\s*+"[^"]*+(?:(?<!=)"|"(?=[\s/>]))|=\s*+'[^']*+(?:(?<!=)'|'(?=[\s/>]))|=)*+"""
TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/><]*)({ATTRIBUTES})(>?)|<[!?/][^>]*+>""", re.S)
MARKED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)

#: Element names of HTML by what they do here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp svg".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
TEXT_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dt dd td th tr tbody thead figcaption address".split())
DROPPED = frozenset("head nav aside footer dialog menu select button object audio video canvas map datalist".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}}
LISTS = frozenset("ul ol dl table menu select".split())
#: Words in class, id or role that name parts which are not the article, and words that say nothing beside them.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside widget related"
    " footer contentinfo header masthead cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription signup login share sharing social"
    " comment comments commentlist disqus replies reply respond search complementary".split()
)
BESIDE = frozenset(
    "site page top bottom left right upper lower main primary secondary global local box bar block container wrapper wrap inner outer list item items links link section area slot unit panel"
    " zone region row col column group holder content body buttons button icons form posts articles stories tags bg fixed sticky mobile desktop small large js is has the my our".split()
)
IN_ARTICLE = frozenset(["header"])
#: What a form holds that is the page and not a part of it.
WHOLE = re.compile(r"<(?:article|main|h1)[\s>]")
UPPER = re.compile(r"[A-Z]+")


@lru_cache(4096)
def names_of(value: str) -> frozenset[str]:
    """The boilerplate words of a class, id or role: of each name (between blanks) that has no words but these and ones that
    say nothing. "share-buttons" and "siteHeader" are such names, "share-price" is not."""
    out: set[str] = set()
    for name in value.split():
        words = {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", name)}
        if words & BOILERPLATE and words <= BOILERPLATE | BESIDE:
            out |= words & BOILERPLATE
    return frozenset(out)


def boilerplate(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in DROPPED or tag == "header" and not in_main:
        return True
    if not attributes or tag in ("html", "body", "article", "main", "form"):
        return False
    if HIDDEN.search(attributes):
        return True
    for m in MARKED.finditer(attributes):
        names = names_of(m[2] or m[3] or m[4] or "")
        if names and not (in_main and names <= IN_ARTICLE):
            return True
    return False


class Page:
    """Walks a page once: ``blocks`` [(text, in article)] without boilerplate, ``hashes`` of subtrees that may be template.
    Subtrees whose hash is in ``recurring`` leave no blocks."""

    def __init__(self, source: str, recurring: frozenset[int] = frozenset()):
        self.source, self._low = source, ""
        self.blocks: list[tuple[str, bool]] = []
        self.n_main = 0  # blocks in the article
        self.hashes: set[int] = set()
        self.recurring = recurring
        # [tag, what its hash is of, first block, dropped, in article, blocks in the article before]
        self.stack: list[list] = [["", [], 0, False, False, 0]]
        self.open: Counter = Counter()
        self.inline: dict[str, dict[int, int]] = {}
        self.line: list[str] = []
        self.any_main = False
        self._walk(source)
        self._flush()
        while len(self.stack) > 1:
            self._close()

    def low(self) -> str:
        """The page with A-Z in lower case; places stay."""
        self._low = self._low or (self.source.lower() if self.source.isascii() else UPPER.sub(lambda m: m[0].lower(), self.source))
        return self._low

    def _flush(self) -> None:
        if self.line:
            text = " ".join("".join(self.line).split())
            self.line = []
            if text:
                top = self.stack[-1]
                top[1].append(text)
                if not top[3]:
                    self.blocks.append((text, top[4]))
                    self.n_main += top[4]

    def _close(self) -> None:
        tag, parts, first, dropped, in_main, mains = self.stack.pop()
        self.open[tag] -= 1
        if not parts:
            return
        h = blake2b(("\x1f".join([tag, *parts])).encode("utf-8", "surrogatepass"), digest_size=8).digest()
        self.stack[-1][1].append(h.hex())
        if tag in ("html", "body", "article", "main", "head") or in_main and tag in TEXT_BLOCK:
            return
        name = int.from_bytes(h, "little", signed=True)
        if name:
            self.hashes.add(name)
        if name in self.recurring and (in_main or self.n_main == mains):
            del self.blocks[first:]
            self.n_main = mains

    def _end(self, tag: str) -> None:
        if self.open[tag]:
            while self.stack[-1][0] != tag:
                self._close()
            self._close()

    def _begin(self, tag: str, attributes: str, drop: bool) -> None:
        if any(f[0] == "p" for f in self.stack[-3:]):
            self._end("p")
        if any(self.open[c] for c in CLOSES.get(tag, ())):
            for k in range(len(self.stack) - 1, 0, -1):  # an item ends the one before it in the same list
                if self.stack[k][0] in LISTS:
                    break
                if self.stack[k][0] in CLOSES[tag]:
                    while len(self.stack) > k:
                        self._close()
        top = self.stack[-1]
        main = top[4] or (not top[3] and (tag in ("article", "main") or "role" in attributes and re.search(r"role\s*=\s*[\"']?main\b", attributes) is not None))
        self.any_main |= main
        self.open[tag] += 1
        self.stack.append([tag, [], len(self.blocks), top[3] or drop or boilerplate(tag, attributes, top[4]), main, self.n_main])

    def _walk(self, source: str) -> None:
        at, last, form_end, whole = 0, source.rfind(">") + 1, -1, -1
        while True:
            m = TOKEN.search(source, at) if at < last else None
            if m is None:
                rest = source[at:]
                cut = re.search(r"<[a-zA-Z!/?]", rest)  # a tag that the page ends within
                self._text(rest[: cut.start()] if cut else rest)
                return
            if m.start() > at:
                self._text(source[at : m.start()])
            if m[2] and not m[4]:  # a tag that the page ends within
                return
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag in BLOCK or tag in DROPPED:
                    self._flush()
                    self._end(tag)
            elif tag in RAW:
                if not m[3].rstrip().endswith("/"):
                    end = self.low().find("</" + tag, at)
                    close = source.find(">", end) if end >= 0 else -1
                    at = close + 1 if close >= 0 else len(source)
            elif tag == "br":
                self.line.append(" ")
            elif tag in VOID:
                if tag == "hr":
                    self._flush()
            elif tag in BLOCK or tag in DROPPED:
                self._flush()
                drop = False
                if tag == "form":  # dropped unless the whole page is in it
                    if form_end < at:
                        form_end = self.low().find("</form", at)
                        form_end = len(source) if form_end < 0 else form_end
                    if whole < at:
                        found = WHOLE.search(self.low(), at)
                        whole = found.start() if found else len(source)
                    drop = whole >= form_end
                self._begin(tag, m[3], drop)
            elif m[3] and not m[3].rstrip().endswith("/") and boilerplate(tag, m[3], self.stack[-1][4]):
                self.line.append(" ")
                at = self._skip(tag, m.start(), at)

    def _skip(self, tag: str, start: int, at: int) -> int:
        """Past the end of an inline element that is dropped; where it does not end, past its start."""
        if tag not in self.inline:  # all elements of this name are matched at once
            ends, begun = {}, []
            for m in re.finditer(rf"<(/?){re.escape(tag)}\b", self.low()):
                if not m[1]:
                    begun.append(m.start())
                elif begun:
                    ends[begun.pop()] = m.end()
            self.inline[tag] = ends
        end = self.inline[tag].get(start)
        if end is None:
            return at
        close = self.source.find(">", end)
        return close + 1 if close >= 0 else len(self.source)

    def _text(self, text: str) -> None:
        self.line.append(entities.unescape(text) if "&" in text else text)

    def text(self) -> str:
        """Blocks of the article, or of the whole page where there is none, in page order."""
        return "\n".join(t for t, main in self.blocks if main or not self.any_main)


def host(url: F.Column) -> F.Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


def templates(pages: DataFrame, least: int = LEAST_PAGES) -> DataFrame:
    """(host, page, recurring) of ``pages`` (host, page, html; ``page`` is a hash of the html): the page's subtrees that are on
    ``least`` different pages of its host. Pages without any are left out."""

    def make():
        def work(batch):
            return [batch.column(0), batch.column(1), [list(Page(t.as_py() or "").hashes) for t in batch.column(2)]]

        return work

    rows = map_rows(pages.select("host", "page", "html").filter("host <> ''"), make, "host string, page long, hashes array<long>")
    once = saved(rows.filter("size(hashes) > 0").groupBy("host", "page").agg(F.first("hashes").alias("hashes")), "subtrees")
    each = once.select("host", "page", F.explode("hashes").alias("hash"))
    often = each.groupBy("host", "hash").count().filter(F.col("count") >= least).select("host", "hash")
    return each.join(often, ["host", "hash"], "left_semi").groupBy("host", "page").agg(F.collect_list("hash").alias("recurring"))


def main_text(df: DataFrame, keep: list[str], url: str = "url", html: str = "html") -> DataFrame:
    """``keep`` columns of every page with text (blocks joined by line feeds; empty if there is none).

    A null or empty page has an empty text; a page of any length is read whole. Pages without a readable host are not compared with
    each other; pages of one host with the same html count as one. A column of ``keep`` named text gives way. An empty table gives an
    empty one.
    """
    keep = [c for c in keep if c.lower() != "text"]
    own = [f"_c{k}" for k in range(len(keep))]
    pages = df.select(*[F.col(c).alias(o) for c, o in zip(keep, own)], host(F.col(url)).alias("host"), F.col(html).alias("html"), F.xxhash64(html).alias("page"))
    rows = pages.join(templates(pages), ["host", "page"], "left").select("html", "recurring", *own)

    def make():
        def work(batch):
            out = []
            for t, hashes in zip(batch.column(0), batch.column(1)):
                names = frozenset(hashes.as_py()) if hashes.is_valid else frozenset()
                out.append(Page(t.as_py() or "", names).text())
            return [*batch.columns[2:], out]

        return work

    fields = rows.select(*own).schema
    out = map_rows(rows, make, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "text string"]))
    return out.select(*[F.col(o).alias(c) for o, c in zip(own, keep)], "text")


def op5_pages(spark, sf_dir):
    """The main text of every page."""
    return main_text(table(spark, sf_dir, "pages"), ["page_id", "url"]).withColumn("n_chars", F.char_length("text").cast("long"))
