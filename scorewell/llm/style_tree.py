"""Main text of web pages by a site style tree.

The pages of a host are merged by the paths of their elements (names with classes and ids). Over the pages that
have a path, two entropies say how much it differs from page to page: that of the child sequences (presentation)
and that of the text directly in it (content), as shares of the most they could be; copies of a page
count once. A branch none of whose paths is important is noise of the site's template and goes. What
names alone tell (navigation, forms, scripts, adverts, comments) goes on every page, also
where a host has too few pages to compare. Where to look is a prior: text inside an article stays unless its branch is
noise, text beside one goes unless its path is clearly important. An article of which nothing would be left is kept,
so a host of near copies keeps its articles.
"""

from __future__ import annotations

import html as html_lib
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewell.llm.batches import slices
from scorewell.session import materialize

#: Importance below which a branch is noise, and pages (other than copies) a host needs for that.
LEAST_IMPORTANCE = 0.3
LEAST_PAGES = 8
#: Importance of its own from which a path beside an article is content.
BESIDE_IMPORTANCE = 0.9
#: The table of noise branches is sent to every task up to so many rows; beyond, pages are joined with it.
BROADCAST_ROWS = 100_000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][^\s=/>"']*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
RAW = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSED_BY = {
    "p": set("p div ul ol dl table section article aside nav header footer main form blockquote pre h1 h2 h3 h4 h5 h6 hr figure address fieldset details".split()),
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
    "option": {"option", "optgroup"}, "head": {"body"},
}
KEEPS_LIST_ITEM = {"ul", "ol", "dl", "table"}
NOISE_TAGS = set("head nav footer aside form button select option input textarea script style noscript template iframe svg canvas object dialog menu title".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NOISE_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense adslot adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices popup modal overlay newsletter subscribe subscription signup sidebar widget widgets menu menus nav navbar navigation breadcrumb "
    "breadcrumbs footer comment comments disqus reply replies respond share sharing social related recommended pagination pager toolbar login "
    "search alert announcement".split()
)
#: Only outside an article: there these may hold its title or its notes.
NOISE_OUTSIDE = {"header", "masthead", "topbar"}
ARTICLE = {"article", "main"}
WITHIN = r"/(article|main)([./]|$)"


class Node:
    __slots__ = ("tag", "path", "noise", "inside")

    def __init__(self, tag, path, noise, inside):
        self.tag, self.path, self.noise, self.inside = tag, path, noise, inside


def _node(parent: Node, tag: str, attributes: str) -> Node:
    """The element below ``parent``: its path, whether names say it is noise, whether it is inside an article."""
    label, noise, inside = tag, parent.noise or tag in NOISE_TAGS, parent.inside or tag in ARTICLE
    if not parent.inside and tag == "header":
        noise = True
    if attributes and not noise:
        found = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
        names = f"{found.get('class', '')} {found.get('id', '')}".strip()
        role = found.get("role", "").lower()
        hidden = "hidden" in found or found.get("aria-hidden") == "true"
        if role == "main" or role == "article":
            inside = True
        if tag not in ("body", "html") and tag not in ARTICLE or (names and tag == "article" and "comment" in names.lower()):
            words = {x.lower() for x in NAME_PARTS.findall(names)}
            noise = bool(words & NOISE_WORDS) or (not inside and bool(words & NOISE_OUTSIDE))
        noise = noise or role in NOISE_ROLES or hidden or re.search(r"display\s*:\s*none", found.get("style", "")) is not None
        if names:
            label += "." + re.sub(r"[0-9]+", "#", re.sub(r"\s+", ".", names))
    return Node(tag, f"{parent.path}/{label}", noise, inside)


def parse(page: str):
    """Blocks (path, noise by name, inside an article, text) in page order, and the child names of each path."""
    root = Node("", "", False, False)
    stack, blocks, text, children, at = [root], [], [], {}, 0

    def flush():
        if text:
            joined = re.sub(r"\s+", " ", html_lib.unescape("".join(text))).strip()
            if joined:
                owner = next(n for n in reversed(stack) if n.tag not in INLINE)
                top = stack[-1] if stack[-1].noise else owner
                blocks.append((owner.path, top.noise, owner.inside, joined))
            text.clear()

    end = len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            text.append(page[at:])
            break
        text.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                text.append(html_lib.escape(m[0][9:].removesuffix("]]>")))
            continue
        if tag == "br":
            flush()
            continue
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if depth:
                if tag not in INLINE or any(n.tag not in INLINE for n in stack[depth:]) or stack[depth].noise:
                    flush()
                del stack[depth:]
            continue
        if tag not in INLINE:
            flush()
            for i in range(len(stack) - 1, 0, -1):
                if tag in CLOSED_BY.get(stack[i].tag, ()):
                    del stack[i:]
                    break
                if stack[i].tag in KEEPS_LIST_ITEM or (stack[i].tag not in INLINE and stack[i].tag not in CLOSED_BY):
                    break
        node = _node(stack[-1], tag, m[3])
        if tag in INLINE and node.noise and not stack[-1].noise:
            flush()
        if tag not in INLINE:
            children.setdefault(stack[-1].path, []).append(node.path.rpartition("/")[2])
        if tag in RAW:
            close = RAW[tag].search(page, at)
            at = close.end() if close else end
            continue
        if tag not in VOID and not m[3].rstrip().endswith("/"):
            stack.append(node)
    flush()
    return blocks, children


def main_text(page: str | None, noise: set[str], beside: set[str] = frozenset()) -> str:
    """Blocks of the article and of the paths ``beside`` it, or of the page where it has none, without noise; joined by newlines."""
    blocks, _ = parse(page or "")
    named = [b for b in blocks if not b[1]]
    cut = tuple(f"{x}/" for x in noise)
    rest = [b for b in named if not (f"{b[0]}/").startswith(cut)] if cut else named
    if any(b[2] for b in named):
        inside = rest if any(b[2] for b in rest) else named
        return "\n".join(b[3] for b in inside if b[2] or b[0] in beside)
    return "\n".join(b[3] for b in rest)


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def style_facts(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, kind, value, page): per page and path, hashes of its child sequence and of its direct text.

    ``page`` is a hash of all the text that names do not settle, so that copies are one. Only paths that names do not settle.
    """

    def run(batches):
        for batch in slices(batches):
            out: list[tuple] = []
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                blocks, children = parse(page or "")
                host = host_of(url)
                own = xxhash.xxh64_intdigest("\n".join(b[3] for b in blocks if not b[1])) >> 1
                direct: dict[str, list[str]] = {}
                for path, noise, _, text in blocks:
                    if not noise:
                        direct.setdefault(path, []).append(text)
                for path, texts in direct.items():
                    out.append((host, path, "content", xxhash.xxh64_intdigest("\n".join(texts)) >> 1, own))
                for path, names in children.items():
                    out.append((host, path, "style", xxhash.xxh64_intdigest(" ".join(names)) >> 1, own))
            columns = list(zip(*out)) if out else [[]] * 5
            types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(columns, types)], ["host", "path", "kind", "value", "page"]
            )

    rows = pages.select(F.col(f"`{url_col}`").cast("string"), F.col(f"`{html_col}`").cast("string"))
    return rows.mapInArrow(run, "host string, path string, kind string, value long, page long")


def branch_importance(facts: DataFrame) -> DataFrame:
    """(host, path, pages, importance, own): the greatest importance of a path and all paths below it, and its own."""
    values = facts.where("path <> ''").distinct().groupBy("host", "path", "kind", "value").agg(F.count("*").alias("n"))
    spread = F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")
    own = values.groupBy("host", "path", "kind").agg(F.sum("n").alias("pages"), F.try_divide(spread, F.log(F.sum("n"))).alias("e"))
    # A path seen on one page differs as much as can be; content decides where there is any.
    own = own.select("host", "path", "kind", "pages", F.coalesce("e", F.lit(1.0)).alias("e"))
    per_path = own.groupBy("host", "path").agg(
        F.max("pages").alias("pages"), F.coalesce(F.max(F.when(F.col("kind") == "content", F.col("e"))), F.lit(0.0)).alias("e")
    )
    above = "transform(sequence(2, size(parts)), i -> array_join(slice(parts, 1, i), '/'))"
    lifted = per_path.withColumn("parts", F.split("path", "/")).select("host", "pages", "e", F.col("path").alias("of"), F.explode(F.expr(above)).alias("path"))
    own = F.coalesce(F.max(F.when(F.col("of") == F.col("path"), F.col("e"))), F.lit(0.0)).alias("own")
    return lifted.groupBy("host", "path").agg(F.max("pages").alias("pages"), F.max("e").alias("importance"), own)


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with ``main_text`` (empty if there is none). A null html is empty; a null url is a host of its own.

    Repeated rows give repeated results; a column of the input named ``main_text`` is replaced.
    """
    importance = branch_importance(style_facts(pages, url_col, html_col))
    low = F.when(F.col("importance") < LEAST_IMPORTANCE, F.col("path"))
    high = F.when((F.col("own") >= BESIDE_IMPORTANCE) & ~F.col("path").rlike(WITHIN), F.col("path"))
    told = importance.where(F.col("pages") >= LEAST_PAGES).withColumn("low", low).withColumn("high", high).where("low IS NOT NULL OR high IS NOT NULL")
    noise = materialize(told.groupBy("host").agg(F.collect_list("low").alias("__noise"), F.collect_list("high").alias("__beside")), "noise")
    noise = noise.withColumnRenamed("host", "__host")
    if (noise.agg(F.sum(F.size("__noise") + F.size("__beside"))).first()[0] or 0) <= BROADCAST_ROWS:
        noise = F.broadcast(noise)
    own = [x for x in pages.columns if x not in ("main_text", "__noise", "__beside", "__host")]
    rows = pages.select(*[F.col(f"`{x}`") for x in own])
    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url_col}`"), F.lit("")), HOST.pattern, 1))
    joined = rows.withColumn("__host", host).join(noise, "__host", "left").select(*[F.col(f"`{x}`") for x in own], "__noise", "__beside")
    at = own.index(html_col)

    def run(batches):
        for batch in slices(batches):
            lists = zip(*[batch.column(i).to_pylist() for i in (at, len(own), len(own) + 1)])
            texts = [main_text(h, set(n or ()), set(b or ())) for h, n, b in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(texts, pa.string())], [*own, "main_text"])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", main_text string"
    return joined.mapInArrow(run, schema)
