"""Main-text extraction with a site style tree.

The pages of a host are merged into one tree: pages' elements with the same chain of names (tag, class words)
from the root are one node. ``style_tree`` computes for every node, over all pages of the host,

* presentation importance: the entropy, to the base of the number of pages that have the node, of
  the sequences of child elements it occurs with;
* content importance: one less the mean entropy of its text features over the pages (a text that is on
  every page says nothing, one that is on one page only says most);
* composite importance: both, folded upwards from the leaves.

A branch is noise if its node and all nodes below it are low, on a host of enough pages: one node with text of its own
keeps the branch, and only the low branches beside it go. ``html``, ``body``, ``main``, ``article`` and what holds the latter two
are never noise as such; where nothing in one of these stands out (copies of one page or article), the tree says nothing about what is in it. Nodes without text count for nothing. Elements that are
no main text by their own name or role (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles, reader comments) have importance 0 whatever their text: their wording may differ on each page, and entropy
alone would keep them; their texts stay out of the tree. A class or id says so only as a whole token (``share-box``, not
``related-work`` or ``with-sidebar``), and only of containers, not of headings, paragraphs or cells. A container that holds
``main``, or most of the text of the page's articles or of all its text if its words can also name a layout, stays; the tree decides on it.

The tree decides on the blocks of every page, in ``main`` and ``article`` and outside. Where it says nothing (a node on too few pages of
its host, or copies), the names do: the text in ``main`` and ``article`` is kept, and if it is at least half of the page's text, the rest is dropped.

The tree's counts are aggregated by (host, node, value), with partial aggregation, so a host that holds a
third of all pages is spread over all tasks; pages are never grouped by host, and texts are never shuffled: pages are parsed into
stored files, a file's distinct nodes are joined to what the trees say of them, and each file is read once more with the verdicts
on its own nodes. Only the nodes of one host's tree (its distinct chains of names, not its pages) meet in one task, to be folded.

Cases: null or empty html gives an empty text; a null url has the host ''; markup that never closes is closed at
the end; ``<`` without a tag name is text. Character references are decoded, white space inside a
block (also ``<br>``) becomes one space, blocks are joined by a blank line. Page ids may be null or repeat: each
row is extracted by itself. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as _html
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored, table
from .warc import _open_fs as open_fs

#: Names of elements by what they are.
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset("nav aside footer form head svg canvas object button select dialog menu fieldset datalist audio video map math".split()) | RAW
NOT_MAIN_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login sidebar widget widgets menu nav navbar navigation navigator breadcrumb breadcrumbs masthead footer comment comments disqus respond replies reply share sharing social related recommended recommendations pagination pager toolbar".split()
)
#: Words that change nothing about what a token says.
PLAIN_WORDS = frozenset(
    "area bar block body bottom box button buttons container content entry footer form global google header inner item items leaderboard left link links list outer page panel post posts primary region right row secondary section site skyscraper slot sticky text title top unit wrap wrapper".split()
)
#: Words that never name a layout around the main text.
SURE_WORDS = frozenset("ad ads adsense advert adverts advertisement advertising cookie cookies consent gdpr newsletter subscribe subscription signup login breadcrumb breadcrumbs comment comments disqus respond replies reply share sharing pagination pager".split())
NOT_MAIN_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Blocks whose class and id say nothing about their text.
NO_CONTAINER = HEADING | frozenset("address blockquote body caption dd dt figcaption html legend main p pre summary table tbody td tfoot th thead tr".split())
#: An open element on the left ends where one on the right begins.
ENDS = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
}
SCOPE = frozenset("html body table ul ol dl article main section div td th".split())

GAMMA = 0.9
#: Never noise as such.
MAIN = frozenset(["main", "article"])
TOP = MAIN | {"html", "body"}
#: Branches all below this composite importance go, on hosts with so many pages or more.
LEAST, LEAST_PAGES = 0.2, 4

_TOKEN = re.compile(r"<!--(.*?)(?:-->|\Z)|<([/]?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*>|<([/]?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")


@lru_cache(65_536)
def _attributes(text: str) -> tuple[str, bool, int]:
    """Class words in order (they name the node), whether role or state say that it is no main text, and whether class or id
    do: 0 no, 1 by words that may also name a layout, 2 surely."""
    found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(text)} if text else {}
    classes = re.findall(r"[a-z]+", found.get("class", ""))
    off = found.get("role") in NOT_MAIN_ROLES or "hidden" in found or found.get("aria-hidden") == "true"
    said = 0
    for token in f"{found.get('class', '')} {found.get('id', '')}".split():
        words = {w for w in re.findall(r"[a-z]+", token) if len(w) > 1}
        if words & NOT_MAIN_WORDS and words <= NOT_MAIN_WORDS | PLAIN_WORDS:
            said = max(said, 2 if words & SURE_WORDS else 1)
    return ".".join(classes), off, said


@lru_cache(65_536)
def node_id(parent: int, name: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{parent}/{name}".encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


@lru_cache(65_536)
def _tag(token: str) -> tuple | None:
    """(ends, tag, name of the node, removed by itself, a block, empty, what class and id say) of a tag; None for comments and declarations."""
    m = _TOKEN.match(token)
    tag = m[3] or m[6]
    if tag is None:
        return None
    tag, attributes = tag.lower(), (m[4] or m[7] or "")
    classes, off, said = _attributes(attributes)
    gone = off and tag not in ("html", "body", "main") or tag in NEVER
    empty = tag in VOID or attributes.endswith("/") and tag not in BLOCK and tag not in RAW
    block = tag in BLOCK
    if said == 2 and not block:  # an inline advert or the like
        gone = True
    return bool(m[2] or m[5]), tag, f"{tag}.{classes}" if classes else tag, gone, block, empty, said if block and tag not in NO_CONTAINER else 0


def parsed(page: str | None) -> tuple[list[tuple[int, int, list[str], str]], list[tuple[int, str, bool, bool]]]:
    """Elements (node, parent, names of children, tag) and text blocks (node or 0, text, removed by name, in main text)."""
    source = page or ""
    stack: list[tuple] = []  # tag, node, removed here or above, in main or article, children, in a header, a block, an inline element removed by itself, suspects
    elements, texts, buffer = [], [], []
    suspects: list[list] = []  # containers of a telling class or id: what it says, holds main
    root = ("", 0, False, False, [], False, False, False, ())

    def flush():
        text = " ".join(buffer[0].split() if len(buffer) == 1 else "".join(buffer).split())
        buffer.clear()
        if text:
            if "&" in text:
                text = " ".join(_html.unescape(text).split())
            top = stack[-1] if stack else root
            texts.append((top[1], text, top[2], top[3], top[8]))

    def close(to: int):
        while len(stack) > to:
            top = stack.pop()
            elements.append((top[1], stack[-1][1] if stack else 0, top[4], top[0]))

    at, end = 0, len(source)
    while at < end:
        lt = source.find("<", at)
        if lt < 0:
            buffer.append(source[at:])
            break
        if lt > at and not (stack and stack[-1][7]):
            buffer.append(source[at:lt])
        m = _TOKEN.match(source, lt)
        if m is None:  # a sign in the text
            buffer.append("<")
            at = lt + 1
            continue
        at = m.end()
        if source.startswith("<!--", lt) or (said := _tag(m[0])) is None:
            continue
        ends, tag, name, off, block, empty, doubt = said
        if ends:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if buffer and any([s[6] for s in stack[i:]]):
                        flush()
                    close(i)
                    break
                if not block and stack[i][0] in SCOPE:
                    break
            continue
        if block:
            if buffer:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                other = stack[i][0]
                if other == "p" or tag in ENDS.get(other, ()):
                    close(i)
                elif other in SCOPE:
                    break
        elif tag == "br":
            buffer.append("\n")
        above = stack[-1] if stack else root
        above[4].append(tag)
        if empty:
            continue
        main = above[3] or (tag in ("main", "article") and not off and not above[2])
        header = above[5] or tag == "header"
        # of a header, only the one of the article itself stays, and of that only the headings
        gone = above[2] or off or (header and not main)
        if above[5] and main and tag not in HEADING and block:
            gone = True
        inline = not block and gone and (above[7] or not above[2])
        if main and tag == "main":
            for i in above[8]:
                suspects[i][1] = True
        inside = above[8]
        if doubt and not gone:
            inside = (*inside, len(suspects))
            suspects.append([doubt, False])
        stack.append((tag, node_id(above[1], name), gone, main, [], header, block, inline, inside))
        if tag in RAW:
            over = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(source, at)
            at = over.end() if over else end
            close(len(stack) - 1)
    if buffer:
        flush()
    close(0)
    if not suspects:
        return elements, [t[:4] for t in texts]
    held, total = [[0, 0] for _ in suspects], [0, 0]  # characters in main or article, and of all
    for _, text, gone, main, inside in texts:
        if not gone:
            for counts in (total, *[held[i] for i in inside]):
                counts[0] += len(text) * main
                counts[1] += len(text)
    most = [any([2 * x > y for x, y in zip(h, total, strict=True)]) for h in held]
    out = [not holds and (doubt == 2 or not most[i]) for i, (doubt, holds) in enumerate(suspects)]
    return elements, [(node, text, gone or any([out[i] for i in inside]), main) for node, text, gone, main, inside in texts]


def host_of(url: str | None) -> str:
    rest = (url or "").partition("://")[2] or (url or "")
    return re.split(r"[/?#]", rest, maxsplit=1)[0].rpartition("@")[2].partition(":")[0].lower()


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


SEEN = pa.list_(pa.struct([("node", pa.int64()), ("parent", pa.int64()), ("kind", pa.string()), ("value", pa.int64())]))
PAGE = "page_id long, url string, host string, nodes array<long>, priors array<boolean>, texts array<string>, seen array<struct<node:long,parent:long,kind:string,value:long>>"
_PAGE = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("nodes", pa.list_(pa.int64())), ("priors", pa.list_(pa.bool_())), ("texts", pa.list_(pa.string())), ("seen", SEEN)]
)


def observed(page: str | None) -> tuple[list[int], list[bool], list[str], list[dict]]:
    """Blocks (nodes, what names alone say of them, texts); and once each: nodes, their sequences of children, their texts."""
    elements, rows = parsed(page)
    parents = {node: parent for node, parent, _, _ in elements}
    seen = {(n, p, "page", (tag in TOP) + (tag in MAIN)) for n, p, _, tag in elements}
    seen |= {(n, p, "style", _hash(" ".join(children))) for n, p, children, _ in elements if children}
    kept = [r for r in rows if not r[2]]
    seen |= {(node, parents.get(node, 0), "text", _hash(text)) for node, text, _, _ in kept if node}
    main = sum(len(r[1]) for r in kept if r[3])
    alone = main and 2 * main >= sum(len(r[1]) for r in kept)
    return [r[0] for r in kept], [r[3] or not alone for r in kept], [r[1] for r in kept], [dict(zip(("node", "parent", "kind", "value"), s, strict=True)) for s in seen]


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _PAGE.types, strict=True)], schema=_PAGE)

    for b in batches:
        out, size = [], 0
        for page_id, url, page in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
            out.append((page_id, url, host_of(url), *observed(page)))
            size += len(page or "")
            if size > 4_000_000:
                yield batch(out)
                out, size = [], 0
        if out:
            yield batch(out)


def observe(pages: DataFrame) -> DataFrame:
    """Every page parsed once, stored: what the trees count, and the blocks of text."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return stored(rows.mapInArrow(_observe, PAGE), "pages-parsed")


def _composite(nodes: pd.DataFrame, least: float, least_pages: int) -> pd.DataFrame:
    """Composite importance of one host's nodes, children before parents, and which are noise (null: the tree does not say), parents before children."""
    own = {r.node: r for r in nodes.itertuples()}
    children: dict[int, list[int]] = {}
    for r in own.values():
        if r.parent in own and r.parent != r.node:
            children.setdefault(r.parent, []).append(r.node)
    roots = [n for n, r in own.items() if r.parent not in own]
    value: dict[int, float | None] = {}
    highest: dict[int, float] = {}  # in the branch; below 0 without text
    todo = list(roots)
    while todo:
        n = todo[-1]
        open_ = [c for c in children.get(n, ()) if c not in value]
        if open_:
            todo.extend(open_)
            continue
        todo.pop()
        if n in value:
            continue
        r, parts, below = own[n], [], children.get(n, ())
        if not math.isnan(r.content):
            parts.append((r.content, r.pages))
        parts += [(value[c], own[c].pages) for c in below if value[c] is not None]
        if not parts:
            value[n], highest[n] = None, -1.0
            continue
        mean = sum(v * w for v, w in parts) / sum(w for _, w in parts)
        share = GAMMA ** max(1, len(below))
        value[n] = (1 - share) * r.presentation + share * mean if below else mean
        highest[n] = max([value[n], -1.0 if math.isnan(r.content) else r.content, *(highest[c] for c in below)])
    holds = {n for n, r in own.items() if r.top > 1}  # main or article
    for n in list(holds):
        while (n := own[n].parent) in own and n not in holds:
            holds.add(n)
    noise: dict[int, bool | None] = {}
    stands_out = max((highest[n] for n in roots), default=-1.0) >= least
    visit = [(n, False, stands_out) for n in roots]
    while visit:
        n, above, judged = visit.pop()
        r = own[n]
        if r.top and not above:
            judged = judged and highest[n] >= least
        low = above or judged and not r.top and n not in holds and r.pages >= least_pages and 0 <= highest[n] < least
        noise[n] = bool(low) if low or judged and r.pages >= least_pages else None
        visit.extend((c, low, judged) for c in children.get(n, ()))
    return pd.DataFrame({"host": nodes["host"].iloc[:1].repeat(len(value)).to_numpy(), "node": list(value), "importance": [math.nan if v is None else v for v in value.values()], "noise": pd.array([noise[n] for n in value], "boolean")})


def style_tree(parsed_pages: DataFrame, least: float = LEAST, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host, node, parent, pages, top, presentation, content, importance (NaN without text), noise (null: not known) of every node of every host's tree."""
    counts = parsed_pages.select("host", F.inline("seen")).groupBy("host", "node", "parent", "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    here = lambda kind, x: F.when(F.col("kind") == kind, x)
    n = F.col("n").cast("double")
    sums = counts.groupBy("host", "node", "parent").agg(
        F.max(here("page", n)).alias("pages"),
        F.max(here("page", F.col("value"))).alias("top"),
        F.sum(here("style", n)).alias("styles"),
        F.sum(here("style", n * F.log(n))).alias("style_nlog"),
        F.count(here("text", n)).alias("texts"),
        F.sum(here("text", F.log(n))).alias("text_log"),
    )
    base = F.log("pages")
    many = F.col("pages") > 1
    measured = sums.select(
        "host",
        "node",
        "parent",
        F.col("pages").cast("long").alias("pages"),
        "top",
        F.when(many, F.greatest(F.lit(0.0), (F.log("styles") - F.col("style_nlog") / F.col("styles")) / base)).otherwise(1.0).alias("presentation"),
        F.when(F.col("texts") > 0, F.when(many, F.greatest(F.lit(0.0), 1 - F.col("text_log") / F.col("texts") / base)).otherwise(1.0)).otherwise(float("nan")).alias("content"),
    )
    measured = stored(measured, "style-tree")
    composite = measured.groupBy("host").applyInPandas(lambda nodes: _composite(nodes, least, least_pages), "host string, node long, importance double, noise boolean")
    return measured.join(composite, ["host", "node"])


def main_text(page: str | None, noise: dict[int, bool] | None = None) -> str:
    """The text of one page, given what its host's tree says of its nodes."""
    nodes, priors, texts, _ = observed(page)
    return "\n\n".join(t for n, prior, t in zip(nodes, priors, texts, strict=True) if not (noise or {}).get(n, not prior))


RESULT = "page_id long, url string, text string, n_chars long"


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of RESULT from the files of parsed pages that the rows name, with the verdicts (host, noise, nodes) on their nodes."""
    for b in batches:
        for path, verdicts in zip(b.column("path").to_pylist(), b.column("verdicts").to_pylist(), strict=True):
            says: dict[str, dict[int, bool]] = {}
            for v in verdicts or ():
                says.setdefault(v["host"], {}).update(dict.fromkeys(v["nodes"], v["noise"]))
            store, place = open_fs(path)
            with store.open_input_file(place) as f:
                for part in pq.ParquetFile(f).iter_batches(128, columns=["page_id", "url", "host", "nodes", "priors", "texts"]):
                    counts, keep = [], []
                    for host, nodes, priors in zip(*(part.column(c).to_pylist() for c in ("host", "nodes", "priors")), strict=True):
                        noise = says.get(host, {})
                        mine = [not noise.get(n, not prior) for n, prior in zip(nodes, priors, strict=True)]
                        counts.append(sum(mine))
                        keep += mine
                    kept = part.column("texts").flatten().filter(pa.array(keep, pa.bool_()))
                    ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                    text = pc.binary_join(pa.ListArray.from_arrays(ends, kept), "\n\n")
                    yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), text, pc.utf8_length(text).cast(pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, least: float = LEAST, least_pages: int = LEAST_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    one = observe(pages)
    judged = style_tree(one, least, least_pages).where("noise is not null and importance is not null and not isnan(importance)")
    files = one.select(F.col("_metadata.file_path").alias("path"), "host", "nodes")
    inside = files.select("path", "host", F.explode("nodes").alias("node")).distinct()
    said = inside.join(judged.select("host", "node", "noise"), ["host", "node"]).groupBy("path", "host", "noise").agg(F.collect_list("node").alias("nodes"))
    by_file = said.groupBy("path").agg(F.collect_list(F.struct("host", "noise", "nodes")).alias("verdicts"))
    wanted = files.select("path").distinct().join(by_file, "path", "left").repartition(partitions(pages.sparkSession), "path")
    return wanted.mapInArrow(_decide, RESULT)


def op3(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


#: On pages with one plain ``article`` of headings and paragraphs, as in the tables; references may lack their semicolon.
ORACLE_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS m FROM pages),
b AS (
  SELECT page_id, url, list_filter([
    trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(x, '<br>', ' '), '</?b>', '', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))
    FOR x IN string_split_regex(m, '</?(?:p|h1)>')
  ], lambda x: x <> '') AS parts FROM a
)
SELECT page_id, url, coalesce(array_to_string(parts, E'\n\n'), '') AS text, length(coalesce(array_to_string(parts, E'\n\n'), '')) AS n_chars FROM b
"""
