"""Main text of web pages by a site style tree: branches that a host repeats, or that are boilerplate by role, go."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atelier.llm.common import parts_of, stored
from atelier.llm.urlfilter import host_of

# Names of elements and of roles.
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^\s/>]*(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>|</?[a-zA-Z][^>]*(?:>|\Z)", re.S
)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"\s(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe noembed noframes object svg math canvas audio video textarea".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BOILERPLATE = frozenset("head title nav footer aside form button select dialog menu noscript".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comments comment disqus respond replies share sharing social related widget".split()
)
CENTRE = frozenset(("article", "main"))
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCE = frozenset("ul ol dl table tbody thead tfoot select article main body html".split())
#: Base and prime modulus of the digests of texts in a row, which can be put together from those of their parts.
BASE, PRIME = 0x9E3779B97F4A7C1, (1 << 61) - 1
#: Characters of pages that a worker handles at once.
AT_ONCE = 4_000_000


def _joined(first: tuple[int, int], second: tuple[int, int]) -> tuple[int, int]:
    """Digest of two runs of texts, one after the other; a digest is a polynomial in BASE and BASE to the number of texts."""
    return (first[0] * second[1] + second[0]) % PRIME, first[1] * second[1] % PRIME


def _words(value: str) -> set[str]:
    return set(re.split(r"[^a-z0-9]+", value.lower()))


class Page:
    """One pass over a page: its text chunks, and of each node the digests of its style and content."""

    def __init__(self, html: str | None, low: frozenset[int] = frozenset(), nodes: bool = False):
        self.chunks: list[tuple[str, bool]] = []  # text, inside an article
        self.low, self.count = low, nodes
        self.style: dict[int, int] = {}
        self.content: dict[int, tuple[int, int]] = {}
        self.last: dict[int, str] = {}
        # name, node, dropped, inside an article
        self.stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
        self.open: Counter[str] = Counter()
        # digest of the texts so far in each open element
        self.held = [(0, 1)]
        self._run(html or "")
        while len(self.stack) > 1:
            self._pop()
        self.content[0] = self.held[0]

    def _run(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            m = TAG.search(html, at)
            self._text(html[at : m.start() if m else n])
            if not m:
                break
            at, tag = m.end(), m.group()
            if tag[1] in "!?":
                if tag.startswith("<![CDATA["):
                    self._text(tag[9:].removesuffix("]]>"))
                continue
            name = NAME.match(tag).group(1).lower()
            if tag[1] == "/":
                self._close(name)
            elif name in RAW:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else n
                self._break()
            else:
                self._start(name, tag)

    def _text(self, raw: str) -> None:
        if not raw:
            return
        _, _, dropped, inside = self.stack[-1]
        if not dropped:
            self.chunks.append((entities.unescape(raw) if "&" in raw else raw, inside))
        if self.count and (plain := raw.strip()):
            self.held[-1] = _joined(self.held[-1], (xxhash.xxh64_intdigest(plain) % PRIME, BASE))

    def _break(self) -> None:
        if not self.stack[-1][2]:
            self.chunks.append((" ", self.stack[-1][3]))

    def _pop(self) -> str:
        """Closes an element: its texts are its node's and, in one step, also its parent's, so that depth costs nothing."""
        name, node, _, _ = self.stack.pop()
        own = self.held.pop()
        self.open[name] -= 1
        if self.count and own[1] != 1:
            self.held[-1] = _joined(self.held[-1], own)
            if node != self.stack[-1][1]:
                self.content[node] = _joined(self.content.get(node, (0, 1)), own)
        return name

    def _pop_to(self, name: str) -> None:
        while self._pop() != name:
            pass

    def _close(self, name: str) -> None:
        if name not in INLINE:
            self._break()
        if self.open[name] > 0:
            self._pop_to(name)
            if name not in INLINE:
                self._break()

    def _start(self, name: str, tag: str) -> None:
        if name not in INLINE:
            self._break()
        if name in VOID:
            return
        if name in ENDS_P and self.open["p"] > 0:
            self._pop_to("p")
        if name in SIBLINGS:
            for above in reversed(self.stack):
                if above[0] in FENCE:
                    break
                if above[0] in SIBLINGS[name]:
                    self._pop_to(above[0])
                    break
        _, parent, dropped, inside = self.stack[-1]
        names, role = "", ""
        if "=" in tag:
            for kind, *values in ATTRIBUTE.findall(tag):
                value = next((v for v in values if v), "")
                if kind.lower() == "role":
                    role = value.lower().strip()
                else:
                    names += " " + value
        signature = f"{name}.{' '.join(sorted(_words(names) - {''}))}" if names else name
        node = xxhash.xxh64_intdigest(signature, parent) if name not in INLINE else parent
        centre = name in CENTRE
        named = name not in ("html", "body", *CENTRE) and names and not NAMES.isdisjoint(_words(names))
        # what a host repeats within an article or in place of one may still be its text
        useless = name in BOILERPLATE or role in ROLES or (name == "header" and not inside) or named or (not (inside or centre) and node in self.low)
        if self.count and node != parent:
            if self.last.get(parent) != signature:
                self.style[parent] = crc32(signature.encode(), self.style.get(parent, 0))
                self.last[parent] = signature
            self.style.setdefault(node, 0)
        self.stack.append((name, node, dropped or bool(useless), inside or centre))
        self.held.append((0, 1))
        self.open[name] += 1

    def text(self) -> str:
        """Text of the page's articles, or of all that wasn't dropped if they have none."""
        own = " ".join("".join(t for t, inside in self.chunks if inside).split())
        return own or " ".join("".join(t for t, _ in self.chunks).split())

    def nodes(self) -> list[dict[str, int]]:
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        return [{"node": signed(k), "style": v, "content": self.content.get(k, (0, 1))[0]} for k, v in self.style.items() if k]


def style_tree(pages: DataFrame) -> DataFrame:
    """Importance of every node of every host's merged tree: host, node, pages, importance.

    pages: host and html. Copies of a page count once, so that only what differing pages share
    looks like boilerplate. A node's presentations and contents over the host's pages have entropies;
    as shares of the greatest possible they are weighted 1 to 9 and added, so a branch that looks and
    reads the same on all pages has importance 0. Sums are combined before each shuffle, and a host
    with any number of pages is one row a node and distinct value.
    """

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("node", pa.int64()), ("style", pa.int64()), ("content", pa.int64())]))
        for batch in batches:
            for part in parts_of(batch, AT_ONCE):
                parsed = [Page(h, nodes=True) for h in part.column(1).to_pylist()]
                whole = [crc32(repr(sorted(p.content.items())).encode()) for p in parsed]
                columns = [part.column(0), pa.array(whole, pa.int64()), pa.array([p.nodes() for p in parsed], kind)]
                yield pa.RecordBatch.from_arrays(columns, names=["host", "whole", "nodes"])

    seen = pages.select("host", "html").mapInArrow(nodes, "host string, whole long, nodes array<struct<node:long,style:long,content:long>>")
    each = (
        seen.select("host", "whole", F.inline("nodes"))
        .dropDuplicates(["host", "whole", "node"])
        .select("host", "node", F.explode(F.array(F.struct(F.lit("s").alias("kind"), F.col("style").alias("value")), F.struct(F.lit("c").alias("kind"), F.col("content").alias("value")))).alias("v"))
    )
    counts = each.groupBy("host", "node", "v.kind", "v.value").agg(F.count(F.lit(1)).alias("n"))
    m = F.sum("n")
    entropy = (F.log(m) - F.sum(F.col("n") * F.log("n")) / m) / F.log(m)
    kinds = counts.groupBy("host", "node", "kind").agg(m.alias("pages"), F.when(m > 1, entropy).otherwise(1.0).alias("h"))
    return kinds.groupBy("host", "node").agg(F.max("pages").alias("pages"), F.sum(F.col("h") * F.when(F.col("kind") == "c", 0.9).otherwise(0.1)).alias("importance"))


def extract(pages: DataFrame, threshold: float = 0.2, least_pages: int = 10) -> DataFrame:
    """Main text of every page: page_id, url, text and n_chars (code points).

    pages: page_id, url and html; other columns are ignored. Removed are branches whose importance in
    their host's tree is under ``threshold`` where ``least_pages`` differing pages show it, unless they are
    an article or main element or lie in one, and those that an element, role, class or id names as
    boilerplate; a class or id never removes an article or main element. Inline elements are part of
    the branch around them. If an article or main element has text left,
    that is the page's text, else what is left of the page. Blocks are joined by one space, and so is
    white space in them. Null and empty pages have an empty text; a null url belongs to the host
    without name; repeated rows give the same; an empty table gives an empty result.
    """
    hosted = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    tree = style_tree(hosted)
    low = tree.where((F.col("importance") < threshold) & (F.col("pages") >= least_pages)).groupBy("host").agg(F.sort_array(F.collect_set("node")).alias("low"))
    joined = hosted.join(stored(low, "low"), "host", "left").select("page_id", "html", "url", "low")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[tuple[int, ...], frozenset[int]] = {}
        for batch in batches:
            for part in parts_of(batch, AT_ONCE):
                out = []
                for html, nodes in zip(part.column(1).to_pylist(), part.column(3).to_pylist(), strict=True):
                    key = tuple(nodes or ())
                    if key not in sets:
                        sets.clear()
                        sets[key] = frozenset(x % (1 << 64) for x in key)
                    out.append(Page(html, sets[key]).text())
                columns = [part.column(0), part.column(2), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(texts, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")
