"""Main text of web pages by site style trees.

The pages of a host are merged into one tree of element paths, furniture included.  Each path has the distribution, over the host's
different pages, of its content and of its children's layout; normalised entropies of the two are its content and presentation importance.  A
branch that looks and reads the same on most pages of a host is unimportant and is cut from every page.  What markup itself
names as a menu, header, footer, sidebar, notice, advert, form or reader comment has its importance lowered below the limit, whatever its entropy, unless
the page's article is in it: furniture may read differently on each page.  Entropies come from counts that Spark sums before they meet, so a hot
host is no hot task.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import small_batches

#: Different pages of a host that show a path before its entropy says anything, and the importance below which a branch is cut.
LEAST_PAGES, LEAST_IMPORTANCE = 8, 0.2
#: Tasks that the pages of one host go to.
SALTS = 32

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Elements that are furniture by their meaning.
DROPPED = set("nav footer aside menu dialog head button select option optgroup datalist label object canvas audio video map search fieldset".split())
#: Elements whose content is no markup or no text; of the last three something is seen in their place.
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in "script style noscript template title iframe svg textarea".split()}
SEEN = set("iframe svg textarea".split())
#: Words of class names and ids that name furniture, words that say nothing beside them, and beginnings of names that speak of something else.
NOISE = set(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox sponsor sponsored promo promotion promoted banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside widget widgets footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations subscribe subscription newsletter signup login search pagination pager skip toolbar tooltip copyright hidden".split()
)
NEUTRAL = set("a area article articles bar block bottom box boxes button buttons container content count float fixed form global group header head heading icon icons inner item items js left link links list main media menu outer page panel post posts primary right row secondary section site slot sticky text thread title top unit wrap wrapper".split())
OTHER = set("has with without no not is".split())
SITE_HEADER = re.compile(r"(?:(?:site|page|top|main|global)[-_]?)?(?:header|masthead|topbar)", re.I)
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Elements on whose class names and ids words of furniture count: headings and paragraphs are named after what they tell.
NAMED = set("div section span ul ol dl table td li figure center article main".split())
IN_TAG = re.compile(r">|=\s*([\"'])")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/\"'>]+)")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@lru_cache(100_000)
def names_furniture(token: str, tag: str) -> bool:
    """Whether a class name or id is made of words of furniture: cookie-notice is, notice-period and with-sidebar are not."""
    parts = [p.lower() for p in PART.findall(token)]
    if not parts or parts[0] in OTHER:
        return False
    if tag not in NAMED:
        return len(parts) == 1 and parts[0] in NOISE
    core = [p for p in parts if p not in NEUTRAL or (p == "menu")]
    return bool(core) and all(p in NOISE for p in core)


@lru_cache(100_000)
def hash_of(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def joined_hash(values: list[int]) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(v.to_bytes(8, "little") for v in values), digest_size=8).digest(), "little")


def scan(page: str):
    """(text before, tag, is an end, attributes) of each tag in order, and the rest with an empty tag; linear in the page.

    Without any later > a < is text.  A quoted value that never ends is no quoted value, and none is looked for after it."""
    at, start, last, quotes, before = 0, 0, page.rfind(">"), True, []
    while True:
        lt = page.find("<", at)
        if lt < 0 or lt > last:
            before.append(page[start:])
            yield "".join(before), "", False, ""
            return
        after = page[lt + 1 : lt + 2]
        ending = after == "/"
        name = NAME.match(page, lt + 1 + ending)
        if not name:
            if after in ("!", "?", "/") and after:
                before.append(page[start:lt])
                if page.startswith("<!--", lt):
                    end = page.find("-->", lt + 2)
                    at = start = len(page) if end < 0 else end + 3
                else:
                    at = start = page.find(">", lt) + 1
            else:
                at = lt + 1
            continue
        before.append(page[start:lt])
        end, p = -1, name.end()
        while quotes:
            m = IN_TAG.search(page, p)
            if m is None:
                break
            if not m[1]:
                end = m.start()
                break
            p = page.find(m[1], m.end()) + 1
            if not p:
                quotes = False
        if end < 0:
            end = page.find(">", name.end())
        tag = name[0].lower()
        yield "".join(before), tag, ending, page[name.end() : end]
        before, at, start = [], end + 1, end + 1
        if tag in RAW and not ending and page[end - 1] != "/":
            shut = RAW[tag].search(page, end + 1)
            at = start = len(page) if shut is None else shut.start()


class Node:
    __slots__ = ("tag", "name", "parent", "path", "meant", "hinted", "main", "header", "heading", "holds_main", "kids", "contents")

    def __init__(self, tag: str, name: str, parent: Node | None):
        self.tag, self.name, self.parent = tag, name, parent
        self.path = (parent.path * 0x9E3779B97F4A7C15 + hash_of(name) + 1) & 0xFFFFFFFFFFFFFFFF if parent else 0
        self.meant = self.hinted = self.main = self.header = self.heading = self.holds_main = False
        self.kids, self.contents = [], []


def tree_of(page: str):
    """(blocks in page order as (node, text), nodes in the order they end)."""
    root = Node("", "", None)
    top, blocks, nodes, text, count = root, [], [], [], {}

    def flush():
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if joined:
                blocks.append((top, joined))
                top.contents.append(hash_of(joined))

    def pop():
        nonlocal top
        node = top
        top, count[node.tag] = node.parent, count[node.tag] - 1
        nodes.append(node)
        content = node.contents[0] if len(node.contents) == 1 else joined_hash(node.contents)
        node.contents = [content] if node.contents else []
        top.contents += node.contents

    def close(tags, stops):
        if not any(count.get(t) for t in tags):
            return
        node = top
        while node is not root:
            if node.tag in tags:
                while top is not node.parent:
                    pop()
                return
            if node.tag in stops:
                return
            node = node.parent

    for before, tag, ending, attributes in scan(page):
        if before:
            text.append(before)
        if not tag:
            break
        if tag == "br" or tag == "hr":
            flush()
            continue
        if tag in RAW:
            if tag in SEEN:
                text.append(" ")
            continue
        if ending:
            if tag in BLOCK or count.get(tag):
                flush()
            close({tag}, ())
            continue
        found = {}
        if "=" in attributes or "hidden" in attributes.lower():
            found = {(a or e).lower(): b or c or d or "" for a, b, c, d, e in ATTRIBUTE.findall(attributes)}
        role, tokens = found.get("role", "").lower(), f"{found.get('class', '')} {found.get('id', '')}".split()
        shut = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        meant = tag in DROPPED or shut or role in ROLES
        hinted = any(names_furniture(t, tag) for t in tokens)
        if tag in VOID or (tag not in BLOCK and not meant and not hinted):
            continue
        flush()
        if tag in BLOCK:
            if tag != "p" or count.get("p"):
                close({"p"}, {"article", "section", "div", "table", "blockquote", "li", "td"})
            if tag in CLOSES:
                close(*CLOSES[tag])
        name = tag + "".join("." + re.sub(r"\d+", "#", t) for t in sorted(tokens))
        node = Node(tag, name, top)
        node.main = top.main or tag in ("article", "main") or role == "main" or found.get("itemprop", "").lower() == "articlebody"
        node.meant = tag not in ("html", "body") and meant
        node.hinted = tag not in ("html", "body") and (hinted or tag == "form" or (not top.main and tag in NAMED and any(SITE_HEADER.fullmatch(t) for t in tokens)))
        node.header, node.heading = top.header or tag == "header", top.heading or tag in HEADINGS
        top.kids.append(hash_of(name))
        top, count[tag] = node, count.get(tag, 0) + 1
        if node.main and not node.parent.main:
            while node.parent and not node.parent.holds_main:
                node = node.parent
                node.holds_main = True
    flush()
    while top is not root:
        pop()
    return blocks, nodes


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def merged(batches):
    """A row for each element path of a page: what it holds and how it is laid out."""
    for batch in batches:
        out = ([], [], [], [], [])
        for host, print_, page in zip(*(batch.column(k).to_pylist() for k in range(3))):
            held: dict[int, tuple[list, list]] = {}
            for node in tree_of(page or "")[1]:
                if node.contents:
                    content, layout = held.setdefault(node.path, ([], []))
                    content += node.contents
                    layout.append(joined_hash(node.kids))
            for path, (content, layout) in held.items():
                for o, v in zip(out, (host, print_, signed(path), signed(joined_hash(content)), signed(joined_hash(layout)))):
                    o.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), *(pa.array(o, pa.int64()) for o in out[1:])], names=["host", "page", "path", "content", "layout"])


def text_of(page: str, low: set[int], hints: bool = True) -> str:
    blocks, _ = tree_of(page)
    cut: dict[int, int] = {}

    def lost(node: Node) -> int:
        """Bits of what cuts a node: 1 its meaning, 2 its names, 4 its site's tree."""
        chain = []
        while node is not None and id(node) not in cut:
            chain.append(node)
            node = node.parent
        bits = cut[id(node)] if node is not None else 0
        for node in reversed(chain):
            if not node.holds_main:
                article = node.main and not node.parent.main
                bits |= (1 if node.meant else 0) | (2 if node.hinted and (hints or node.tag == "form") and not article else 0) | (4 if signed(node.path) in low and not article else 0)
                if node.header and not node.heading and node.tag != "header":
                    bits |= 1
            cut[id(node)] = bits
        return bits

    def shown(mask: int) -> list[str]:
        left = [(n, t) for n, t in blocks if not lost(n) & mask and not (n.header and not n.heading)]
        return [t for n, t in left if n.main] or [t for _, t in left]

    # a page that would lose all its text to its site's tree, or to names that wrap the whole page, keeps it
    return " ".join(shown(7) or shown(3) or shown(1))


def extracted(hints: bool):
    def run(batches):
        for batch in batches:
            texts = [text_of(page or "", set(low or ()), hints) for page, low in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def importances(hosted: DataFrame, least_pages: int) -> DataFrame:
    """(host, path, n, content, layout): different pages that show a branch, and normalised entropies of what it holds and of its layout over them."""
    rows = hosted.select("host", "page", "html").mapInArrow(merged, "host string, page long, path long, content long, layout long").distinct()
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("content", "layout"))))
    each = rows.select("host", "path", kinds.alias("k")).groupBy("host", "path", "k.kind", "k.value").agg(F.count("*").alias("c"))
    total = each.groupBy("host", "path", "kind").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("s")).where(F.col("n") >= least_pages)
    entropy = F.greatest((F.log("n") - F.col("s") / F.col("n")) / F.log("n"), F.lit(0.0))
    of = lambda kind: F.max(F.when(F.col("kind") == kind, entropy)).alias(kind)
    return total.groupBy("host", "path").agg(F.max("n").alias("n"), of("content"), of("layout"))


def with_hosts(pages: DataFrame) -> DataFrame:
    host = F.lower(F.coalesce(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1), F.lit("")))
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host.alias("host")).withColumn("page", F.xxhash64("html"))


def low_branches(hosted: DataFrame, least_pages: int, least_importance: float) -> DataFrame:
    """(host, path) of branches whose content and layout hardly differ over the host's pages."""
    return importances(hosted, least_pages).where((F.col("content") < least_importance) & (F.col("layout") < least_importance)).select("host", "path")


def main_text(pages: DataFrame, least_pages: int = LEAST_PAGES, least_importance: float = LEAST_IMPORTANCE, hints: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) for each page.

    The article (article, main, or else the whole body) without what its markup means or names as furniture and without branches of low
    importance on its host; `hints` off leaves names of classes and ids out.  Neither cuts the article itself or what holds it.  An article's header keeps its
    headings.  Blocks are joined by one space.  Null or empty html gives an empty text; pages without a host in their url are one site.  Copies of a page count
    once for their site.  A page that would lose all its text keeps what only its site or names would cut.  Repeated rows are reported each.  Other
    columns are ignored.  An empty table gives an empty result."""
    small_batches(pages.sparkSession, 300)
    hosted = with_hosts(pages)
    low = low_branches(hosted, least_pages, least_importance).groupBy("host").agg(F.collect_set("path").alias("low"))
    # a hot host's pages go to many tasks
    salted = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = hosted.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    types = dict(pages.dtypes)
    return dealt.join(salted, ["host", "salt"], "left").select("page_id", "url", "html", "low").mapInArrow(extracted(hints), f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
