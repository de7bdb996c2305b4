"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: each start tag with its path of open elements (the path tells roles of one tag
apart) and each block of text. Over the pages of a host every token has an occurrence vector (the pages on which it
stands once); tokens of equal vectors form an equivalence class. Vectors are folded to 64 bits by an exclusive or
of hashes of the pages, so a class is found by aggregates with partial sums, however many pages a host has. A class
is valid if it has ``LEAST_TOKENS`` tokens on ``LEAST_PAGES`` different pages; its order is that of one of its pages.

The template of a page. The host's valid classes that stand on the page whole and in order are taken from those of
most pages to those of fewest; each must lie within one gap of every class taken before it, and so nests below it.
The text tokens of the nested classes are template, and what remains are the slots. Of these go those whose path
leads through menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or comments (``DROP_TAGS``,
class and id names made of ``DROP_NAMES``, fewer inside articles), and, where an article or main element is among the page's tags, all
outside such elements. Texts of articles are no tokens: a line that the articles of a host share, or a whole article
that stands on several pages, is their text by contract, not template. If all blocks of a page are template, those
of its innermost class are its text.

The pages' templates are broadcast by host if they are small (``BROADCAST_TOKENS``); otherwise the tokens are joined
with the classes, and each page meets its own classes by its hash, so that no host is gathered anywhere.

Defined results: a null or empty page has an empty text; pages without a url share one unnamed host; unclosed and
misnested elements are closed as browsers do in the common cases; repeated rows are extracted each; an empty table
gives an empty result; further columns do not matter.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm._util import id_text, materialise, table

LEAST_PAGES, LEAST_TOKENS = 3, 3
#: Tokens of all templates together up to which these are broadcast, 16 bytes each.
BROADCAST_TOKENS = 1 << 19

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template iframe svg annotation annotation-xml".split())
INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr "
    "munder munderover semantics".split()
)
DROP_TAGS = frozenset("nav header footer aside form dialog menu head button select option fieldset".split()) | RAW
#: A class or id name is dropped if one of its parts is one of these and all other parts are neutral.
DROP_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu sidebar "
    "footer header masthead cookie cookies consent notice notices popup modal overlay share sharing social related recommended "
    "comment comments replies reply disqus breadcrumb breadcrumbs newsletter subscribe subscription signup login widget widgets "
    "pagination pager skip toolbar copyright disclaimer alert".split()
)
NEUTRAL = frozenset(
    "site page main top bottom left right global inner outer wrapper wrap container box area block section content list item items bar "
    "link links button buttons btn slot unit zone row col primary secondary mobile desktop sticky fixed post posts article articles entry "
    "reader user form thread media text to the".split()
)
#: Inside an article or main element names decide less: paragraphs and the like stay whatever they are called, generic
#: holders go by their class as elsewhere, and an id, or a section's class, counts only if it is one of these as a whole.
DROP_INSIDE = frozenset("ad ads advert adverts advertisement advertisements comments sidebar navbar".split())
GENERIC = frozenset("div ul ol dl table center".split())
SECTIONS = frozenset("section figure details".split())
WHOLE = frozenset("html body".split())  # their class names say nothing about what they hold
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("article main section div body html nav header footer aside ul ol dl table form blockquote td th".split())
MAIN_TAGS = ("article", "main")

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'][^>\"']*)*)>?", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
HOST = r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def host_key() -> Column:
    """A hash of the url's host."""
    return F.xxhash64(F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit(""))))


def named(value: str) -> bool:
    """Whether a class or id name says that its element is no main text (``ad-slot-2`` does, ``ad-hoc`` does not)."""
    parts = {x for x in re.split(r"[_-]+|\d+", value) if x}
    return bool(parts & DROP_NAMES) and parts <= DROP_NAMES | NEUTRAL


def named_inside(tag: str, kind: str, value: str) -> bool:
    """The same inside an article, of an element's class or id."""
    if tag in GENERIC and kind == "class":
        return named(value)
    return tag in GENERIC | SECTIONS and value in DROP_INSIDE


def dropped(tag: str, attributes: str, inside: bool = False) -> bool:
    """Whether an element and all it holds is no main text; ``inside``: it lies in an article or main element."""
    if tag in DROP_TAGS:
        return True
    if not attributes.strip() or tag in WHOLE:
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id") and any(named_inside(tag, name, v) if inside else named(v) for v in value.split()):
            return True
        if name == "role" and value in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert"):
            return True
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


class Page:
    """A page's tags (path and place) and its text blocks: (path, whether in a main element, dropped, text, place)."""

    def __init__(self, source: str):
        self.tags: list[tuple[str, int]] = []
        self.blocks: list[tuple[str, bool, bool, str, int]] = []
        self._open: list[tuple[str, bool]] = []
        self._text: list[str] = []
        self._read(source)

    def _place(self) -> int:
        return len(self.tags) + len(self.blocks)

    def _flush(self) -> None:
        text = " ".join(entities.unescape("".join(self._text)).split())
        self._text = []
        if text:
            path = [t for t, _ in self._open if t not in INLINE]
            self.blocks.append(("/".join(path), any(m in path for m in MAIN_TAGS), any(d for _, d in self._open), text, self._place()))

    def _close(self, tag: str) -> None:
        for i in range(len(self._open) - 1, -1, -1):
            if self._open[i][0] == tag:
                del self._open[i:]
                return
            if tag in INLINE and self._open[i][0] in SCOPES:
                return

    def _imply(self, tag: str) -> None:
        ends = CLOSES.get(tag, () if tag in INLINE else ("p",))
        for i in range(len(self._open) - 1, -1, -1):
            if self._open[i][0] in ends:
                del self._open[i:]
                return
            if self._open[i][0] in SCOPES:
                return

    def _read(self, source: str) -> None:
        at = 0
        while m := TOKEN.search(source, at):
            self._text.append(source[at : m.start()])
            at = m.end()
            end, start, attributes = m[1], m[2], m[3]
            if start is None and end is None:
                continue  # a comment or declaration
            tag = (start or end).lower()
            if tag == "br":
                self._text.append(" ")
                continue
            if tag not in INLINE:
                self._flush()
            if end:
                self._close(tag)
                continue
            if tag in RAW:
                self.tags.append((tag, self._place()))
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                at = close.end() if close else len(source)
                continue
            if tag in VOID or attributes.endswith("/") and tag in INLINE:
                continue
            self._imply(tag)
            inside = tag in MAIN_TAGS or any(t in MAIN_TAGS for t, _ in self._open)
            self._open.append((tag, dropped(tag, attributes, inside)))
            if tag not in INLINE:
                self.tags.append(("/".join(t for t, _ in self._open if t not in INLINE), self._place()))
        self._text.append(source[at:])
        self._flush()

    def tokens(self) -> dict[int, int]:
        """Hash and place of the tokens that stand on the page once (text tokens are odd, tags even); texts of main
        elements are left out."""
        every = [(xxhash.xxh64_intdigest(t) & ~1, at) for t, at in self.tags]
        every += [(text_token(path, text), at) for path, main, _, text, at in self.blocks if not main]
        found = Counter(t for t, _ in every)
        return {t: at for t, at in every if found[t] == 1}

    def nested(self, classes: list[tuple[int, list[int]]]) -> dict[int, int]:
        """The tokens of the valid classes (pages, tokens in order) that nest on this page, with their pages."""
        places, taken, out = self.tokens(), [], {}
        for pages, tokens in sorted(classes, key=lambda c: (-c[0], c[1])):
            at = [places.get(t, -1) for t in tokens]
            if at[0] < 0 or any(x >= y for x, y in zip(at, at[1:])):
                continue
            if all(bisect(above, at[0]) == bisect(above, at[-1]) or bisect(at, above[0]) == bisect(at, above[-1]) == 0 for above in taken):
                taken.append(at)
                out.update(dict.fromkeys(tokens, pages))
        return out

    def slots(self, template: dict[int, int]) -> list[str]:
        """Texts of the blocks that are neither template (tokens of the nested classes) nor dropped."""
        if any(main and not drop for _, main, drop, _, _ in self.blocks):
            return [text for _, main, drop, text, _ in self.blocks if main and not drop]
        rest = [(text, template.get(text_token(path, text))) for path, _, drop, text, _ in self.blocks if not drop]
        least = None if any(pages is None for _, pages in rest) else min((pages for _, pages in rest), default=None)
        return [text for text, pages in rest if pages == least]


def text_token(path: str, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{path}\0{text}") | 1


def portions(batches: Iterator[pd.DataFrame], rows: int = 256) -> Iterator[pd.DataFrame]:
    """Few rows at a time: pages grow many times over while they are taken apart."""
    for batch in batches:
        for lo in range(0, len(batch), rows):
            yield batch.iloc[lo : lo + rows]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def sources(pages: DataFrame) -> DataFrame:
    """page_id, url, html, host (hashed), page (hash of the whole page)."""
    rows = pages.select(id_text("page_id").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host_key().alias("host"))
    return rows.withColumn("page", F.xxhash64("html"))


def occurrences(rows: DataFrame) -> DataFrame:
    """host, page, token, place. Map-only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in portions(batches):
            found = [Page(source).tokens() for source in batch["html"]]
            sizes = [len(f) for f in found]
            yield pd.DataFrame(
                {
                    "host": batch["host"].repeat(sizes).to_numpy(),
                    "page": batch["page"].repeat(sizes).to_numpy(),
                    "token": [signed(t) for f in found for t in f],
                    "place": [at for f in found for at in f.values()],
                }
            )

    return rows.select("host", "page", "html").mapInPandas(run, "host long, page long, token long, place int")


def valid_classes(found: DataFrame) -> DataFrame:
    """host, pages, tokens (in order), vector: the valid equivalence classes."""
    once = found.groupBy("host", "page", "token").agg(F.min("place").alias("place"))  # copies of a page count once
    vectors = once.groupBy("host", "token").agg(
        F.bit_xor(F.xxhash64("page")).alias("vector"), F.count(F.lit(1)).alias("pages"), F.min(F.struct("page", "place")).alias("_on")
    )
    # Tokens of one class stand on the same pages, so there are no more of them than on one page, and all ``_on`` are one page's.
    of = vectors.where(F.col("pages") >= LEAST_PAGES).groupBy("host", "vector", "pages")
    of = of.agg(F.array_sort(F.collect_list(F.struct("_on.place", "token"))).alias("_t")).where(F.size("_t") >= LEAST_TOKENS)
    return of.select("host", "pages", F.transform("_t", lambda x: x["token"]).alias("tokens"), "vector")


def packed(*key: str):
    """Classes as one array of numbers: of each its pages, its size and its tokens."""
    one = F.concat(F.array(F.col("pages"), F.size("tokens").cast("long")), F.col("tokens"))
    return lambda classes: classes.groupBy(*key).agg(F.flatten(F.collect_list(one)).alias("template"))


def unpacked(template) -> list[tuple[int, list[int]]]:
    out, at, plain = [], 0, [] if template is None else [int(x) for x in template]
    while at < len(plain):
        pages, n = plain[at : at + 2]
        out.append((pages, [t & ((1 << 64) - 1) for t in plain[at + 2 : at + 2 + n]]))
        at += 2 + n
    return out


def extract(pages: DataFrame, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """page_id, url, text, n_chars, template_size (tokens of the page's nested classes) of every page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in portions(batches):
            texts, sizes = [], []
            for source, template in zip(batch["html"], batch["template"], strict=True):
                page = Page(source)
                nested = page.nested(unpacked(template))
                texts.append("\n\n".join(page.slots(nested)))
                sizes.append(len(nested))
            yield batch.assign(text=texts, n_chars=[len(t) for t in texts], template_size=sizes)[["page_id", "url", "text", "n_chars", "template_size"]]

    rows = sources(pages)
    found = materialise(occurrences(rows), "html-tokens")
    classes = materialise(valid_classes(found), "html-classes")
    if (classes.agg(F.sum(F.size("tokens"))).first()[0] or 0) <= broadcast_tokens:
        joined = rows.join(F.broadcast(packed("host")(classes)), "host", "left")
    else:
        members = classes.select("host", "vector", "pages", F.size("tokens").alias("_n"), F.posexplode("tokens").alias("_nth", "token"))
        here = found.select("host", "page", "token").distinct().join(members, ["host", "token"]).groupBy("host", "page", "vector", "pages", "_n")
        here = here.agg(F.array_sort(F.collect_list(F.struct("_nth", "token"))).alias("_t")).where(F.size("_t") == F.col("_n"))
        here = here.withColumn("tokens", F.transform("_t", lambda x: x["token"]))
        joined = rows.join(packed("host", "page")(here), ["host", "page"], "left")
    out = joined.select("page_id", "url", "html", "template").mapInPandas(run, "page_id string, url string, text string, n_chars long, template_size long")
    return out.withColumn("page_id", F.col("page_id").cast("long"))


def op3_html_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
