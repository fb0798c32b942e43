"""Main text of web pages: style trees of sites, and the branches that matter."""

from __future__ import annotations

import html
import re
from collections.abc import Container, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

# A branch counts as noise if its importance is below LOW, its site has at least
# LEAST_PAGES pages with it, and the pages themselves differ.
LOW, LEAST_PAGES, DIFFERENT = 0.1, 8, 0.5
# Low-importance branches that are sent to the tasks at most; more are joined.
SENT = 50_000

_RAW = "script|style|noscript|template|textarea|title|iframe|svg|math|select"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?"
    rf"|<(?P<raw>{_RAW})(?:/>|(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">])*+"
    rf"(?:(?<=[\s\"']/)>|>(?:.*?</(?P=raw)\s*+>|.*\Z)))"
    rf"|<(?P<close>/)?(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_PART = re.compile(r"[^a-z0-9]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "html head body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre "
    "table thead tbody tfoot tr td th figure figcaption header footer nav aside form fieldset "
    "address details summary dialog hr br center".split()
)
# An open element of the first kind ends where one of the second kind starts.
_ENDS = {
    "p": _BLOCK - {"br", "html", "head", "body"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
    "head": {"body"}, "option": {"option"},
}
# Elements that are noise whatever the site, unless stated otherwise by their content.
_NOISE_TAGS = frozenset("head nav footer aside form dialog button menu".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login comment comments disqus reply replies respond sidebar aside widget menu "
    "nav navbar navigation breadcrumb breadcrumbs pagination pager share sharing social related "
    "recommended footer masthead topbar toolbar skip copyright".split()
)
# Words that say what a branch has or lacks, and not what it is: `with-sidebar`, `no-ads`.
_STATES = frozenset("with has no without not hide hides show shows".split())
# Words that leave a noise word its meaning inside a main part, where `share-box` is noise
# and `share-price` is not.
_PLAIN = frozenset(
    "area bar block body bottom box button buttons container content footer form header icon icons "
    "inline inner item items left link links list main outer panel post posts right row section "
    "slot text title top unit wrap wrapper".split()
)
# Inside a main part, noise words count in the classes of containers only.
_CONTAINERS = _BLOCK - frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote hr br center".split())


@dataclass(slots=True)
class Node:
    """An element of a page with the blocks of text under it, in order."""

    tag: str
    path: str
    noise: bool = False
    soft: bool = False  # noise by its names or as a form, which a main part in it refutes
    main: bool = False
    inside: bool = False  # a main part
    children: list = field(default_factory=list)  # of Node and str


class _NotIn:
    """The names that are not in a set."""

    def __init__(self, names: frozenset):
        self.names = names

    def __contains__(self, name: str) -> bool:
        return name not in self.names


def _says_noise(name: str, inside: bool) -> bool:
    """Does a class or an id mark noise? Inside a main part, its other words must say nothing else."""
    parts = {w for w in _PART.split(name) if w}
    if parts & _STATES or not parts & _NOISE_WORDS:
        return False
    others = parts - _NOISE_WORDS - _PLAIN
    return not inside or all(w.isdigit() or len(w) == 1 for w in others)


def _node(parent: Node, tag: str, attrs: str, rare: Container[str]) -> Node:
    names, ids, noise, main = [], [], tag in _NOISE_TAGS - {"form"}, tag in ("article", "main")
    inside = parent.inside or parent.main
    for name, value in _ATTR.findall(attrs) if attrs.strip("/ \n\t\r") else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            noise = True
        elif name == "role":
            noise |= value in _NOISE_ROLES
            main |= value in ("main", "article")
        elif name == "itemprop":
            main |= value == "articlebody"
        elif name == "class":
            names += value.split()
        elif name == "id":
            ids += value.split()
    soft = tag == "form"
    telling = names if inside else names + ids
    names = names + ids
    if tag not in ("html", "body", "article", "main") and (not inside or tag in _CONTAINERS):
        soft |= any(_says_noise(n, inside) for n in telling)
    if tag == "header" and not inside:
        noise = True
    # Rare names are one name, so that they merge with each other and not with none.
    shown = {"*" if n in rare else n for n in names} if rare else names
    mark = f"{tag}.{'.'.join(sorted(shown))}" if shown else tag
    main = main and not noise and not soft
    return Node(tag, f"{parent.path}/{mark}", noise or soft, soft and not noise, main, inside)


def parsed(page: str, rare: Container[str] = ()) -> Node:
    """The tree of a page. Wrong nesting and missing end tags are mended as they come.

    Classes and ids that are in `rare` are left out of the paths. What holds a main
    part is its wrapper, and not noise, whatever its names say.
    """
    root = Node("", "")
    stack = [root]
    at = 0
    for token in _TOKEN.finditer(page):
        if token.start() > at:
            stack[-1].children.append(page[at : token.start()])
        at = token.end()
        tag = token["tag"]
        if tag is None:
            if token["raw"] is None and token[0].startswith("<![CDATA["):
                stack[-1].children.append(html.escape(token[0][9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if token["close"]:
            if tag in _VOID:
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                if tag not in _BLOCK and stack[depth].tag in _BLOCK:
                    break
            continue
        if tag in _BLOCK:
            for depth in range(len(stack) - 1, 0, -1):
                open_tag = stack[depth].tag
                if tag in _ENDS.get(open_tag, ()):
                    del stack[depth:]
                elif open_tag in _BLOCK:
                    break
        node = _node(stack[-1], tag, token["attrs"], rare)
        if node.main:
            for above in stack:
                if above.soft and (node.tag != "article" or above.tag == "form"):
                    above.noise = above.soft = False
        stack[-1].children.append(node)
        if tag not in _VOID and not token["attrs"].endswith("/"):
            stack.append(node)
    stack[-1].children.append(page[at:])
    return root


def _blocks(node: Node, low: frozenset | set) -> list[str]:
    """Texts of the blocks under `node` in order, without noise and low branches."""
    blocks, run = [], []

    def flush() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            blocks.append(text)
        run.clear()

    todo = [iter([node])]
    ends = []
    while todo:
        child = next(todo[-1], None)
        if child is None:
            todo.pop()
            if ends and ends.pop():
                flush()
        elif isinstance(child, str):
            run.append(child)
        else:
            block = child.tag in _BLOCK
            if block:
                flush()
            if child is not node and (child.noise or child.path in low):
                continue
            ends.append(block)
            todo.append(iter(child.children))
    flush()
    return blocks


def _all(root: Node) -> Iterator[tuple[Node, bool, bool]]:
    """Nodes in order, and whether they stand inside noise or inside a main part."""
    todo = [(root, False, False)]
    while todo:
        node, noise, inside = todo.pop()
        yield node, noise, inside
        noise |= node.noise
        inside |= node.main
        todo.extend((c, noise, inside) for c in reversed(node.children) if isinstance(c, Node))


def main_text(
    page: str, low: frozenset | set = frozenset(), rare: Container[str] = ()
) -> str:
    """The main text of a page; `low` holds the paths of branches without importance."""
    root = parsed(page, rare)
    found = [n for n, noise, inside in _all(root) if n.main and not noise and not inside]
    return "\n".join(b for n in found or [root] for b in _blocks(n, low))


def style_nodes(page: str, rare: Container[str] = ()) -> Iterator[tuple[str, int, int]]:
    """Of every branch of a page: its path, and hashes of its style and of its content."""
    nodes = [
        (node, noise or node.noise) for node, noise, _ in _all(parsed(page, rare)) if node.path
    ]
    contents: dict[int, int] = {}
    seen: dict[str, list[int]] = {}
    # Children come before their parents here, so every text is hashed once.
    for node, noise in reversed(nodes):
        if noise:
            continue
        styles, parts = [], []
        for child in node.children:
            if isinstance(child, str):
                if not child.isspace():
                    parts.append(child)
            elif not child.noise:
                styles.append(child.path)
                parts.append(str(contents.get(id(child), 0)))
        content = contents[id(node)] = xxhash.xxh3_64_intdigest("\x00".join(parts)) >> 1
        if node.tag in _BLOCK:
            style = xxhash.xxh3_64_intdigest(",".join(styles)) >> 1
            entry = seen.setdefault(node.path, [0, 0])
            # Sums that depend on the order: a path may have many nodes in a page.
            entry[0] = (entry[0] * 31 + style) & (2**63 - 1)
            entry[1] = (entry[1] * 31 + content) & (2**63 - 1)
    for path, (style, content) in seen.items():
        yield path, style, content


def host_of(url: str | None) -> str:
    rest = (url or "").partition("://")[2]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].lower()


def names_of(page: str) -> set[str]:
    """The classes and ids of a page."""
    return {
        part
        for token in _TOKEN.finditer(page)
        if token["tag"] and not token["close"]
        for name, value in _ATTR.findall(token["attrs"])
        if name.lower() in ("class", "id")
        for part in value.strip("\"'").lower().split()
    }


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [
            (page, host_of(url), name)
            for page, url, text in zip(*(c.to_pylist() for c in batch.columns))
            for name in names_of(text or "")
        ]
        columns = list(zip(*rows)) or [[]] * 3
        kinds = (pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["page", "host", "name"]
        )


def _marked(pages: DataFrame) -> tuple[DataFrame, dict[str, frozenset] | None]:
    """`pages` (`url`, `html`) with their `rare` names, or the names of each host that are not.

    A class or an id is rare if fewer than LEAST_PAGES pages of its host have it.
    """
    page = F.xxhash64("url", "html")
    names = pages.select(page.alias("page"), "url", "html").mapInArrow(
        _names, "page bigint, host string, name string"
    )
    counts = names.groupBy("host", "name").agg(F.count(F.lit(1)).alias("n"))
    common = saved(counts.filter(F.col("n") >= LEAST_PAGES).select("host", "name"), "style-names")
    if common.count() <= SENT:
        found: dict[str, set] = {}
        for row in common.collect():
            found.setdefault(row["host"], set()).add(row["name"])
        return pages.withColumn("rare", F.lit(None).cast("array<string>")), {
            host: frozenset(names) for host, names in found.items()
        }
    rare = names.join(common, ["host", "name"], "left_anti")
    rare = saved(
        rare.groupBy(F.col("page").alias("_page")).agg(F.collect_set("name").alias("rare")),
        "style-rare",
    )
    return pages.withColumn("_of", page).join(rare, F.col("_of") == F.col("_page"), "left").drop(
        "_of", "_page"
    ), None


def _rare(host: str, names: list[str] | None, common: dict[str, frozenset] | None) -> Container[str]:
    return frozenset(names or ()) if common is None else _NotIn(common.get(host, frozenset()))


def _styles(common: dict[str, frozenset] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (host_of(url), *node)
                for url, page, names in zip(*(c.to_pylist() for c in batch.columns))
                for node in style_nodes(page or "", _rare(host_of(url), names, common))
            ]
            columns = list(zip(*rows)) or [[]] * 4
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["host", "path", "style", "content"],
            )

    return run


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The merged trees of all sites: per `host` and `path`, `pages` and `importance`.

    A branch is merged over the pages of a host by its path of elements, classes
    and ids; those that fewer than LEAST_PAGES pages of the host have are merged
    with each other. Presentation and content each have an entropy over the pages, in
    units of the most that so many pages can have: 1 if all differ, 0 if all are
    the same. The importance of a branch is the larger one. Counts combine before
    the shuffle, so a host may have most of the pages.
    """
    named = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return _merged(*_marked(named))


def _merged(pages: DataFrame, common: dict[str, frozenset] | None) -> DataFrame:
    nodes = pages.select("url", "html", "rare").mapInArrow(
        _styles(common), "host string, path string, style bigint, content bigint"
    )
    counts = (
        nodes.select(
            "host", "path",
            F.explode(
                F.array(
                    F.struct(F.lit("style").alias("kind"), F.col("style").alias("value")),
                    F.struct(F.lit("content").alias("kind"), F.col("content").alias("value")),
                )
            ).alias("f"),
        )
        .groupBy("host", "path", "f.kind", "f.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    n = F.col("n").cast("double")
    kinds = (
        counts.groupBy("host", "path", "kind")
        .agg(F.sum("n").alias("pages"), F.sum(n * F.log(n)).alias("s"))
        .withColumn(
            "entropy",
            F.when(F.col("pages") > 1, 1 - F.col("s") / (F.col("pages") * F.log("pages"))).otherwise(1.0),
        )
    )
    return kinds.groupBy("host", "path").agg(
        F.max("pages").alias("pages"), F.max("entropy").alias("importance")
    )


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """The main text of every page: the id, the url, `text` and `n_chars`.

    The pages of a host are merged into a style tree. A branch that looks the same
    and says the same on nearly all pages that have it, while those pages differ
    otherwise, has no importance and is removed from each page, unless it is all
    of the page's main part. Elements that HTML or their class names mark as
    navigation, headers, footers, asides, adverts, notices, forms or comments have
    no importance from the start, and articles have it whatever their entropy:
    copied articles stay. Where a page has no article or main part, all else in
    its body is its text.

    Character references are decoded, white space inside a block becomes one
    space, and blocks are joined by a line feed in page order. Null and empty
    pages give an empty text. Pages without a host are merged like one site. Rows
    are passed through one by one, repeated ones too; other columns are dropped.
    """
    named, common = _marked(
        pages.select(
            F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")
        )
    )
    tree = saved(_merged(named, common), "style-tree")
    # Pages of a host differ if one of the branches that most of them have does; a
    # header that is on all of them is as frequent as the body, and says nothing.
    bodies = tree.groupBy(F.col("host").alias("h")).agg(
        F.max(F.struct("pages", "importance"))["importance"].alias("differ")
    )
    low = (
        tree.filter((F.col("importance") < LOW) & (F.col("pages") >= LEAST_PAGES))
        .filter(~F.col("path").rlike(r"/(article|main|body|html|p|h[1-6])(\.[^/]*)?$"))
        .join(bodies, F.col("host") == F.col("h"))
        .filter(F.col("differ") >= DIFFERENT)
        .groupBy("host")
        .agg(F.collect_set("path").alias("paths"))
    )
    low = saved(low, "style-tree-low")
    id_type = pages.schema[id_col].dataType.simpleString()
    n_paths = low.agg(F.coalesce(F.sum(F.size("paths")), F.lit(0))).first()[0]
    sent: dict[str, frozenset] | None = None
    if n_paths <= SENT:
        sent = {row["host"]: frozenset(row["paths"]) for row in low.collect()}
        source = named.withColumn("low", F.lit(None).cast("array<string>"))
    else:
        host = F.lower(F.regexp_extract("url", r"^.*?://([^/?#]*)", 1))
        source = named.withColumn("_h", F.coalesce(host, F.lit(""))).join(
            low.withColumnsRenamed({"host": "_h", "paths": "low"}), "_h", "left"
        ).select("id", "url", "html", "rare", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, html, rare, lows = (c.to_pylist() for c in batch.columns[1:])
            texts = [
                main_text(
                    page or "",
                    sent.get(host_of(url), frozenset()) if sent is not None else set(paths or ()),
                    _rare(host_of(url), names, common),
                )
                for url, page, names, paths in zip(urls, html, rare, lows)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                ["id", "url", "text", "n_chars"],
            )

    found = source.mapInArrow(run, f"id {id_type}, url string, text string, n_chars bigint")
    return found.withColumnsRenamed({"id": id_col, "url": url_col})
