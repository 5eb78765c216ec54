"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: a node is the path of tags and classes down to an element. Over the
pages, the entropy of a node's styles (the sequence of elements below it) tells how much its presentation
varies, and the entropy of the texts below it how far its content is the same everywhere. Branches that are
neither varied nor new are of low importance and go, inside an article too; what holds an article's root or a first
heading below it stays. Elements that are noise by their meaning (navigation, forms, adverts, comments of readers) go on
every page, also on hosts with few pages. A name that means noise on an element around the article says nothing
of the article itself.

The tree is counted in Spark by (host, path); only branches of low importance are looked up again.
Equal pages of a host count once, wherever they stand: pages travel as hashes of what they hold, one row for each
digest of the whole page.

Defined results: NULL html counts as empty, with text ''; a NULL or malformed address has no host and its page only
follows the rules; repeated rows get equal results; an empty table gives no rows; other columns are not read;
a page without article or main element keeps its whole body less the noise; a page of which the tree would leave nothing
but headings keeps what the rules leave.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkassay.llm.common import settled


#: A branch goes if its importance is below LOW over at least PAGES pages of its host.
LOW, PAGES = 0.25, 8
#: Weight of the content below a node against its own presentation.
BELOW = 0.9
#: Branches of low importance are broadcast up to so many rows (a path has at most DEEP elements).
BROADCAST_ROWS, DEEP = 50_000, 24

BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tfoot tr td th blockquote pre "
    "figure figcaption header footer nav aside form fieldset details summary address center hr dialog menu".split()
)
NOISE_TAGS = frozenset("nav footer aside form menu dialog button select head label input".split())
RAW = "script|style|noscript|template|textarea|title|svg|iframe|object|canvas|math|select|button|audio|video"
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "notification alert popup modal overlay newsletter subscribe subscription signup login menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar side rail widget widgets related recommended share sharing social comment comments disqus reply replies discussion respond footer "
    "header masthead topbar toolbar pagination pager search skip legal copyright".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
#: Elements that their next sibling of the same kind ends.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}}
_HOLDERS = frozenset("ul ol dl table tbody thead tfoot".split())
_EMPTY = frozenset(["hr", "input"])

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<![^>]*>|<\?[^>]*>"
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*|[^>]*)>""",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PART = re.compile(r"[a-z]+")
#: Names that say what an element has or lacks, not what it is.
_ABOUT = re.compile(r"(?<![a-z])(?:has|with|no|without)[-_]+[a-z]+")
#: Levels of names that mean noise above an article are accepted until so much of a page's article text is reached.
ENOUGH = 0.1
_ROOT = r"(^|/)(article|main|h1)(\.[^/]*)?$"
_HEADING = re.compile(r"(?:^|/)h[1-6](?:\.[^/]*)?$")


def _described(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """(label of an element, whether it is noise by tag or role, whether by name)."""
    label, noise, named = tag, tag in NOISE_TAGS, False
    if attributes and "=" in attributes:
        for kind, value in _NAMES.findall(attributes):
            value = value.strip("\"'").lower()
            if kind.lower() == "role":
                noise = noise or value in NOISE_ROLES
            else:
                label += "." + re.sub(r"[0-9]+", "0", value.replace("/", " "))[:40]
                # main containers may bear any name; inside names, words count as a whole
                own = tag not in ("html", "body", "main", "article")
                named = named or own and not NOISE_NAMES.isdisjoint(_PART.findall(_ABOUT.sub(" ", value)))
    return label, noise, named


def blocks(html: str | None) -> list[tuple[str, str, bool, bool]]:
    """(path, text, inside an article, inside noise) of every block, in page order; blocks without text stand for elements."""
    out: list[tuple[str, str, int, bool, int, int]] = []
    if not html:
        return []
    # tag, path, root (1 in main, 2 in an article), in noise, names that mean noise above, those above the root
    stack: list[tuple[str, str, int, bool, int, int]] = []
    outside = ("", "", 0, False, 0, 0)
    buffer: list[str] = []

    def flush() -> None:
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                top = stack[-1] if stack else outside
                out.append((top[1], text, *top[2:]))

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            buffer.append(html[at : m.start()])
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            buffer.append(" ")
            continue
        if tag not in BLOCKS and tag not in NOISE_TAGS:
            continue
        flush()
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in _EMPTY:
            continue
        if tag in _CLOSES:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in _CLOSES[tag]:
                    del stack[k:]
                    break
                if stack[k][0] in _HOLDERS and tag != "p" or stack[k][0] == "div":
                    break
        elif stack and stack[-1][0] == "p":
            stack.pop()
        _, path, root, noise, names, above = stack[-1] if stack else outside
        label, own, named = _described(tag, m[4])
        if tag == "header":
            own = own or not root  # a page's header, not an article's
        kind = {"article": 2, "main": 1}.get(tag, 0)
        path = f"{path}/{label}" if path.count("/") < DEEP or kind > root else path
        if kind > root:
            root, above = kind, names
        stack.append((tag, path, root, noise or own, names + named, above))
        out.append((path, "", *stack[-1][2:]))
    if at < len(html):
        buffer.append(html[at:])
    flush()
    # articles inside something named as noise (teasers, comments) count only where there is hardly any other
    found: dict[int, int] = {}
    for path, text, root, noise, names, above in out:
        if text and root and not noise and names == above and not _HEADING.search(path):
            found[above] = found.get(above, 0) + len(text)
    level, reached = 0, 0
    for level in sorted(found):
        reached += found[level]
        if reached >= ENOUGH * sum(found.values()):
            break
    return [
        (path, text, root > 0, noise or names > above or root > 0 and above > level)
        for path, text, root, noise, names, above in out
    ]


def main_text(html: str | None, low: frozenset[str] = frozenset()) -> str:
    """The blocks that stay, joined by empty lines. `low` holds paths of branches that go."""
    found = [b for b in blocks(html) if b[1] and not b[3]]
    if any(b[2] for b in found):
        found = [b for b in found if b[2]]
    if low:
        left = [b for b in found if not any(b[0] == p or b[0].startswith(p + "/") for p in low)]
        if not all(_HEADING.search(b[0]) for b in left):
            found = left
    return "\n\n".join(b[1] for b in found)


def host_of(url: str | None) -> str | None:
    try:
        return urlsplit(url or "").hostname or None
    except ValueError:
        return None


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, n_pages, presentation, content, importance, holds_article) of every node of every host."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen: set[tuple[str, bytes]] = set()
        for rows in batches:
            hosts, digests, ends, out = [], [], [0], []
            for url, html in zip(rows["url"].to_pylist(), rows["html"], strict=True):
                host, html = host_of(url), html.as_py()
                if host is None or not html or (key := (host, xxhash.xxh3_128_digest(html.encode()))) in seen:
                    continue
                seen.add(key)
                below: dict[str, list[str]] = {}
                for path, text, _, noise in blocks(html):
                    if noise or not path:
                        continue
                    if text:
                        out.append((path, 1, text))
                    else:
                        below.setdefault(path, [])
                        parent = path.rpartition("/")[0]
                        kids = below.setdefault(parent, [])
                        if path not in kids[-1:]:  # equal neighbours count once
                            kids.append(path)
                out += [(path, 0, " ".join(kids)) for path, kids in below.items() if path]
                hosts.append(host)
                digests.append(key[1])
                ends.append(len(out))
            path, kind, what = zip(*out, strict=True) if out else [()] * 3
            whats = [xxhash.xxh64_intdigest(w.encode()) - (1 << 63) for w in what]
            node = pa.StructArray.from_arrays([pa.array(path, pa.string()), pa.array(kind, pa.int32()), pa.array(whats, pa.int64())], ["path", "kind", "what"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), node)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(digests, pa.binary()), lists], ["host", "page", "nodes"])

    shape = "host string, page binary, nodes array<struct<path:string,kind:int,what:long>>"
    rows = pages.select("url", "html").mapInArrow(nodes, shape).dropDuplicates(["host", "page"]).select("host", F.inline("nodes"))
    counts = settled(rows.groupBy("host", "path", "kind", "what").agg(F.count("*").alias("n")), "style-counts")
    n, m = F.col("n"), F.col("n_pages")
    size = counts.where("kind = 0").groupBy("host", "path").agg(F.sum("n").alias("n_pages"), F.sum(n * F.ln(n)).alias("_s"))
    # entropy of styles to the base of the pages: (ln m - sum(n ln n) / m) / ln m
    size = size.withColumn("presentation", F.when(m > 1, 1 - F.col("_s") / (m * F.ln(m))).otherwise(F.lit(1.0)))
    texts = counts.where("kind = 1").groupBy("host", "path").agg(F.sum("n").alias("_t"), F.sum(n * F.ln(n)).alias("_l"))
    # a text counts for every node above it
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    spread = texts.select("host", F.explode(above).alias("path"), "_t", "_l").groupBy("host", "path").agg(F.sum("_t").alias("_t"), F.sum("_l").alias("_l"))
    holds = counts.where("kind = 0").select("host", F.explode(above).alias("_p"), "path").groupBy("host", F.col("_p").alias("path"))
    holds = holds.agg(F.max(F.col("path").rlike(_ROOT)).alias("holds_article"))
    tree = size.join(spread, ["host", "path"], "left").join(holds, ["host", "path"], "left")
    same = F.col("_l") / (F.col("_t") * F.ln(m))
    content = F.when((m > 1) & F.col("_t").isNotNull(), F.greatest(F.lit(0.0), 1 - same)).otherwise(F.lit(1.0))
    tree = tree.withColumn("content", content)
    return tree.select(
        "host", "path", "n_pages", "presentation", "content",
        ((1 - BELOW) * F.col("presentation") + BELOW * F.col("content")).alias("importance"), "holds_article",
    )


def extract(pages: DataFrame) -> DataFrame:
    """One row per page row: page_id, url, text, n_chars."""
    low = style_tree(pages).where((F.col("importance") < LOW) & (F.col("n_pages") >= PAGES) & ~F.col("holds_article"))
    low = settled(low.select("host", "path"), "low-branches")
    per_host = low.groupBy(F.col("host").alias("_host")).agg(F.collect_set("path").alias("_low"))
    host = F.pandas_udf(lambda urls: urls.map(host_of), "string")
    kept = pages.select(F.col("page_id"), F.col("url"), F.col("html"))
    if (rows := low.count()) and rows <= BROADCAST_ROWS:
        kept = kept.withColumn("_host", host("url")).join(F.broadcast(per_host), "_host", "left")
    elif rows:
        kept = kept.withColumn("_host", host("url")).join(per_host, "_host", "left")
    else:
        kept = kept.withColumn("_low", F.lit(None).cast("array<string>"))

    @F.pandas_udf("string")
    def text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for htmls, lists in batches:
            yield pd.Series([main_text(h, frozenset(x) if x is not None else frozenset()) for h, x in zip(htmls, lists, strict=True)])

    out = kept.select("page_id", "url", text("html", "_low").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
