"""HTML extraction with a site style tree.

The DOMs of one host's pages are merged to a style tree. An element node of it stands for the elements of one tag, class and
id (numbers made alike) at one place: below one node, the n-th of its kind; paragraphs, list items and the like
below one parent are one node. Wherever it occurs, the node shows a presentation (the sequence of its children,
runs made one) and a content (all text below it). Its evidence is the entropy of both over its occurrences:

    H = PRESENTATION * H(presentations) / ln N + (1 - PRESENTATION) * H(contents) / ln N
    evidence = (PRIOR_PAGES + (N - 1) * H) / (PRIOR_PAGES + N - 1)

with N the number of different pages, exp of the entropy of the texts of the pages where it occurs. Pages that are copies of each other tell
nothing, and one page tells nothing; then the evidence is 1, and what is known beforehand decides. There is no switch by
the number of pages. A node's importance is its evidence times its prior:

* 0 for elements made for other things (``nav``, ``footer``, ``form`` ..., a ``header`` outside an article, such a role, hidden);
* ``NAMED`` for branches whose whole class or id is made of words for such things (``ad``, ``cookie-notice``; not ``notice-board``), and
  for lists of ``LINKS`` links and more outside of articles with hardly any other text;
* 2 in ``article`` or ``main``, 1 elsewhere.

Branches of an importance below ``LOW`` are removed with all below them. ``html``, ``body``, ``article`` and ``main`` are never judged
themselves. Then, if the articles of a page hold at least half of the text that is left, only they are its main text, or else all that is left.
If names and link lists would leave nothing of a page without an article, they don't count there.

Pages are parsed once, to tables of nodes and pieces of text in the shared folder. Nodes are counted by shuffles on (host,
node, value), so a host with a third of all pages is spread; a page's text meets its host's removed nodes in a join, by broadcast
of a checked size or by a shuffle that cuts large hosts.

Cases: null, empty or broken HTML gives the text that is found, often none. A null or odd url counts as the host ''. Repeated
pages are extracted each. What lies before or after a removed element in one block stays, also where that one is inline. Elements
that HTML lets authors leave open are closed by what follows. Further columns are ignored. Depth and length have no limit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import read_table
from .scratch import BROADCAST_ROWS, materialize, slices, spread_join

LOW, NAMED, PRESENTATION, PRIOR_PAGES = 0.5, 0.4, 0.1, 4.0
LINKS, LINK_SHARE = 3, 0.9

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements of running text, which lie side by side in any number.
_FLOW = frozenset("p li dt dd tr td th h1 h2 h3 h4 h5 h6 blockquote pre".split())
_BLOCK = _FLOW | frozenset("address article aside body caption center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr html legend main menu nav ol search section summary table tbody tfoot thead ul".split())
_HEAD = frozenset("title meta link base script style noscript template".split())
_DROPPED = frozenset("head title script style noscript template iframe object svg math canvas select button textarea audio video map datalist".split())
_NOISE = frozenset("nav footer aside form menu dialog search".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_MAIN = frozenset(("article", "main"))
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPE = frozenset("html body table ul ol dl td th article section main div nav".split())
#: Words for what is no main text, and words for places and boxes that may go with them in a class or id.
_TELLS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored sponsors promo promotion nav navbar navigation menu menus submenu sidebar foot footer masthead breadcrumb breadcrumbs crumbs cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter subscribe subscription signup social share sharing related recommended recommendations comment comments commentlist respond reply replies disqus discussion widget widgets pagination pager toolbar login search copyright disclaimer".split()
)
_PLACES = frozenset("top bottom left right main site page global primary secondary inner outer bar box block area container wrapper wrap section slot unit panel item items link links text body form".split())
_HEADER = frozenset("header topbar".split())
_NUMBER = re.compile(r"\d+")
_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")


def _names_noise(name: str, main: bool) -> bool:
    """Whether a class or id is made of words for what is no main text."""
    parts = [p.lower().strip("0123456789") for p in _PARTS.split(name)]
    parts = [p for p in parts if p]
    tells = _TELLS if main else _TELLS | _HEADER
    return any(p in tells for p in parts) and all(p in tells or p in _PLACES for p in parts)


class Page(HTMLParser):
    """The nodes of a page, parents first, and the pieces of text below them in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        #: Open elements: tag, node, whether it is dropped.
        self.open: list[tuple[str, int, bool]] = []
        self.ids: list[int] = [0]
        self.parents: list[int] = [-1]
        self.priors: list[float] = [1.0]
        self.mains: list[bool] = [False]
        self.judged: list[bool] = [False]
        #: Of each node: keys of its children, and digests of the texts and numbers of the nodes below it in order.
        self.keys: list[list[str]] = [[]]
        self.below: list[list[bytes | int]] = [[]]
        self.links: list[list[int]] = [[0, 0, 0]]  # links, characters in links, characters
        self.seen: dict[tuple[int, str], int] = {}
        #: Pieces: text, node, block.
        self.pieces: list[tuple[str, int, int]] = []
        self.block = 0
        self.anchors = 0

    def _top(self) -> tuple[int, bool]:
        return self.open[-1][1:] if self.open else (0, False)

    def _pop(self, to: int) -> None:
        """Close the elements from that place on."""
        for tag, _, dropped in self.open[to:]:
            self.block += tag in _BLOCK and not dropped
            self.anchors -= tag == "a"
        del self.open[to:]

    def _close(self, tags: set[str]) -> None:
        """Close the innermost open one of the tags, unless it lies outside the present container."""
        for i in range(len(self.open) - 1, -1, -1):
            tag, _, dropped = self.open[i]
            if tag in tags:
                self._pop(i)
                return
            if tag in _SCOPE or dropped:
                return

    def _node(self, key: str, ordinal: bool, prior: float, main: bool, judged: bool) -> int:
        parent = self._top()[0]
        nth = self.seen[parent, key] = self.seen.get((parent, key), -1) + 1
        self.keys[parent].append(key)
        self.below[parent].append(len(self.ids))
        self.ids.append(xxhash.xxh64_intdigest(f"{self.ids[parent]} {key} {nth if ordinal else 0}") >> 1)
        self.parents.append(parent)
        self.priors.append(prior)
        self.mains.append(main)
        self.judged.append(judged)
        self.keys.append([])
        self.below.append([])
        self.links.append([0, 0, 0])
        return len(self.ids) - 1

    def _leave_head(self) -> None:
        if self.open and self.open[-1][0] == "head":
            self._pop(len(self.open) - 1)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in _HEAD:
            self._leave_head()  # its end may be left out
        node, dropped = self._top()
        block = tag in _BLOCK
        if dropped:
            if tag not in _VOID:
                self.open.append((tag, node, True))
            return
        if block:
            self._close({"p"})
            if tag in _CLOSES:
                self._close(_CLOSES[tag])
            self.block += 1
            node, _ = self._top()
        elif tag == "br":
            self.pieces.append((" ", node, self.block))
        if tag in _VOID:
            return
        if tag in _DROPPED:
            self.open.append((tag, node, True))
            return
        self.anchors += tag == "a"
        if tag == "a":
            self.links[node][0] += 1
        names: list[str] = []
        hidden = False
        for k, v in attrs:
            if k in ("class", "id"):
                names += (v or "").split()
            elif k == "hidden" or (k == "role" and (v or "").lower() in _ROLES):
                hidden = True
        main = self.mains[node]
        fixed = tag in _MAIN or tag in ("html", "body")
        named = not fixed and any(_names_noise(n, main) for n in names)
        if block or named or hidden:
            key = f"{tag}.{' '.join(sorted({_NUMBER.sub('#', n.lower()) for n in names}))}" if names else tag
            noise = hidden or tag in _NOISE or (tag == "header" and not main)
            prior = 0.0 if noise else NAMED if named else 2.0 if main else 1.0
            node = self._node(key, tag not in _FLOW, prior, (main or tag in _MAIN) and not noise, not fixed)
        self.open.append((tag, node, False))

    def handle_endtag(self, tag: str) -> None:
        if tag == "br" and not self._top()[1]:
            self.pieces.append((" ", self._top()[0], self.block))
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if tag in _BLOCK or self.open[i][2]:
                    self._pop(i)
                else:  # an inline element ends alone; what began in it goes on
                    own, above = self.open[i][1], self.open[i - 1][1] if i else 0
                    self.open[i:] = [(t, above if n == own else n, d) for t, n, d in self.open[i + 1 :]]
                    self.anchors -= tag == "a"
                return
            if self.open[i][0] in ("article", "main", "body") and tag not in ("body", "html", "main", "article"):
                return

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and data.strip():
            self._leave_head()
        node, dropped = self._top()
        if dropped or not data:
            return
        self.pieces.append((data, node, self.block))
        if text := " ".join(data.split()):
            self.below[node].append(xxhash.xxh64_digest(text))
            n = len(text) - text.count(" ")
            self.links[node][2] += n
            self.links[node][1] += n if self.anchors > 0 else 0

    def run(self, html: str) -> Page:
        self.feed(html)
        self.close()
        self._pop(0)
        for i in range(len(self.ids) - 1, 0, -1):
            count, inside, total = self.links[i]
            up = self.links[self.parents[i]]
            up[0], up[1], up[2] = up[0] + count, up[1] + inside, up[2] + total
            if self.priors[i] == 1 and self.judged[i] and count >= LINKS and inside >= LINK_SHARE * total:
                self.priors[i] = NAMED
        return self

    def contents(self) -> list[int]:
        """A digest of all text below each node, 0 if there is none; children have higher numbers than parents."""
        out = [0] * len(self.ids)
        for i in range(len(out) - 1, -1, -1):
            if parts := [x if isinstance(x, bytes) else out[x].to_bytes(8, "little") for x in self.below[i] if isinstance(x, bytes) or out[x]]:
                out[i] = (xxhash.xxh64_intdigest(b"".join(parts)) >> 1) or 1
        return out

    def shapes(self) -> list[int]:
        return [xxhash.xxh64_intdigest("\n".join(k for n, k in enumerate(keys) if not n or keys[n - 1] != k)) >> 1 for keys in self.keys]


def main_text(texts: list[str], nodes: list[int], blocks: list[int], parents: list[int], mains: list[bool], gone: list[bool], soft: list[bool]) -> str:
    """The main text of a page's pieces without the nodes that are ``gone``; ``soft`` are those that names alone remove."""
    for last in (False, True):
        off = [False] * len(parents)
        for i, up in enumerate(parents):  # parents come first
            off[i] = (up >= 0 and off[up]) or (gone[i] and not (last and soft[i]))
        out: list[tuple[str, bool]] = []
        part: list[str] = []
        sizes, now, inside = [0, 0], None, False
        for text, node, block in [*zip(texts, nodes, blocks, strict=True), ("", 0, -1)]:
            if block != now:
                if part and (whole := " ".join("".join(part).split())):
                    out.append((whole, inside))
                    sizes[inside] += len(whole)
                part, now, inside = [], block, False
            if block >= 0 and not off[node]:
                part.append(text)
                inside = inside or mains[node]
        if out or any(mains):
            break
    articles = sizes[1] > 0 and sizes[1] >= sizes[0]
    return "\n\n".join(t for t, inside in out if inside or not articles)


def host(url: str) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


_LISTS = {"texts": pa.string(), "nodes": pa.int32(), "blocks": pa.int32(), "ids": pa.int64(), "parents": pa.int32(), "mains": pa.bool_(), "priors": pa.float64(), "judged": pa.bool_(), "contents": pa.int64(), "shapes": pa.int64()}
_TYPES = {"texts": "string", "nodes": "int", "blocks": "int", "ids": "long", "parents": "int", "mains": "boolean", "priors": "double", "judged": "boolean", "contents": "long", "shapes": "long"}


def parse(pages: DataFrame, page_id: str, url: str, html: str, priors: bool = True) -> DataFrame:
    """``page_id``, ``url``, ``host``, lists of the page's pieces (``texts``, ``nodes``, ``blocks``) and nodes (the others of ``_TYPES``), and ``main``, a digest of its main text by priors."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            columns: dict[str, list] = {k: [] for k in _LISTS}
            counts: dict[str, list[int]] = {k: [] for k in _LISTS}
            mains: list[int] = []
            for text in batch.column(3).to_pylist():
                p = Page().run(text or "")
                weights = p.priors if priors else [2.0 if m else 1.0 for m in p.mains]
                texts, nodes, blocks = (list(x) for x in zip(*p.pieces, strict=True)) if p.pieces else ([], [], [])
                gone = [w < LOW for w in weights]
                mains.append(xxhash.xxh64_intdigest(main_text(texts, nodes, blocks, p.parents, p.mains, gone, [w == NAMED for w in weights])) >> 1)
                for k, values in zip(_LISTS, (texts, nodes, blocks, p.ids, p.parents, p.mains, weights, p.judged, p.contents(), p.shapes()), strict=True):
                    columns[k] += values
                    counts[k].append(len(values))
            found = [_list(columns[k], counts[k], kind) for k, kind in _LISTS.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *found, pa.array(mains, pa.int64())], names=["page_id", "url", "host", *_LISTS, "main"])

    given = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host(url).alias("host"), F.col(html).alias("html"))
    schema = ", ".join(f"{k} array<{t}>" for k, t in _TYPES.items())
    return given.mapInArrow(scan, f"page_id {pages.schema[page_id].dataType.simpleString()}, url string, host string, {schema}, main long")


def _list(values: list, counts: list[int], kind: pa.DataType) -> pa.ListArray:
    places = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(places), pa.array(values, kind))


def importance(parsed: DataFrame) -> DataFrame:
    """``host``, ``node``, ``pages``, ``prior``, ``evidence`` and ``importance`` of each judged node of the hosts' trees that holds text."""
    each = parsed.select("host", "main", F.explode(F.arrays_zip("ids", "contents", "shapes", "priors", "judged")).alias("n"))
    each = each.filter("n.judged AND n.contents <> 0 AND n.priors > 0").select("host", F.col("n.ids").alias("node"), "n.priors", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in enumerate(("n.shapes", "n.contents", "main"))))).alias("x"))
    counts = each.groupBy("host", "node", "x").agg(F.count(F.lit(1)).alias("c"), F.min("priors").alias("prior"))
    c = F.col("c").cast("double")
    by_kind = counts.groupBy("host", "node", F.col("x.k").alias("k")).agg(F.sum("c").alias("n"), F.sum(c * F.log(c)).alias("s"), F.min("prior").alias("prior"))
    entropy = F.log(F.col("n").cast("double")) - F.col("s") / F.col("n")
    of = lambda k: F.max(F.when(F.col("k") == k, entropy))
    nodes = by_kind.groupBy("host", "node").agg(F.max("n").alias("pages"), F.min("prior").alias("prior"), of(0).alias("h_shape"), of(1).alias("h_content"), of(2).alias("h_page"))
    more = F.greatest(F.exp("h_page") - 1, F.lit(0.0))
    share = lambda h: F.when(F.col("h_page") > 1e-9, F.least(F.col(h) / F.col("h_page"), F.lit(1.0))).otherwise(F.lit(1.0))
    evidence = (PRIOR_PAGES + more * (PRESENTATION * share("h_shape") + (1 - PRESENTATION) * share("h_content"))) / (PRIOR_PAGES + more)
    return nodes.select("host", "node", "pages", "prior", evidence.alias("evidence"), (F.col("prior") * evidence).alias("importance"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", priors: bool = True, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``page_id``, ``url`` and ``text``, the main text of each page. Without ``priors`` the tree alone decides, but for what is never text.

    At most ``broadcast_rows`` nodes that go are broadcast; of more, the pages meet theirs in a shuffle that cuts large hosts.
    """
    parsed = materialize(parse(pages, page_id, url, html, priors))
    # What its prior alone removes needs no row here.
    low = materialize(importance(parsed).filter((F.col("importance") < LOW) & (F.col("prior") >= LOW)).select("host", "node"))
    by_host = low.groupBy(F.col("host").alias("_host")).agg(F.collect_set("node").alias("low"))
    if low.count() <= broadcast_rows:  # pairs of a long and a host's name
        joined = parsed.join(F.broadcast(by_host), F.col("host") == F.col("_host"), "left")
    else:
        sizes = materialize(parsed.groupBy("host").agg(F.count(F.lit(1)).alias("n")))
        joined = spread_join(parsed, by_host, "host", "_host", sizes, F.xxhash64("page_id", "url"))
    columns = ["texts", "nodes", "blocks", "ids", "parents", "mains", "priors"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            found = []
            for texts, nodes, blocks, ids, parents, mains, weights, low in zip(*(batch.column(k).to_pylist() for k in range(2, 10)), strict=True):
                low = frozenset(low or ())
                gone = [w < LOW or i in low for w, i in zip(weights, ids, strict=True)]
                found.append(main_text(texts, nodes, blocks, parents, mains, gone, [w == NAMED for w in weights]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["page_id", "url", "text"])

    return joined.select("page_id", "url", *columns, "low").mapInArrow(scan, f"page_id {pages.schema[page_id].dataType.simpleString()}, url string, text string")


def op7_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(read_table(spark, f"{sf_dir}/pages.parquet", "page_id"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
