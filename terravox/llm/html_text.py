"""HTML extraction with site style trees.

The DOMs of one host are merged by element path. For every path the tree knows how varied its presentation is over the
host's pages (the entropy of the sequences of child elements) and how varied its content (how evenly the same text
features occur on all pages); branches that look and read alike on many pages are of low importance and are cut from
each page. What a page's own markup says beyond doubt (menus, headers, footers, scripts, forms, hidden parts, class names
of adverts and comments) is cut as well, and where a page marks its article, only that is kept. Class names that may mean
anything (notice, share, related, ...) decide alone only outside the article; inside it such a branch goes only if the
tree says that it is repeated, though less evenly than others have to be.

Copies of a page (same text by their own markup, on the same host) count as one page of the tree together, or an
article that a host shows under many addresses would look like its furniture.

Trees are sums of (host, path, feature) counts, made before the shuffle; only the paths of low importance go back to
the pages: as a broadcast where they are few, else by a join on the host that Spark may split.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravox.llm.words import free_name, give_back
from terravox.plans.storage import bound_batches, cut

#: Pages a host must have of a path before its importance counts, and the importance below which the branch goes.
LEAST_PAGES, LEAST_IMPORTANCE = 5, 0.2
#: The same for a branch inside the article whose class name may mean furniture.
LIKELY_IMPORTANCE = 0.5
#: Characters of a path; of a longer one the parent's part is a hash.
PATH_CHARS = 1_000
#: Weight of an element's own presentation against its content.
PRESENTATION = 0.1
#: Paths of low importance, and pages that have copies, that are broadcast at most.
BROADCAST_PATHS = 200_000

# Names in HTML and in the usual class names.
RAW = frozenset("script style noscript template iframe svg object canvas audio video textarea select title noembed noframes annotation annotation-xml".split())
NOISE_TAGS = frozenset("nav footer aside form button dialog menu head datalist label input option fieldset".split())
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SURE_WORDS = frozenset("ad ads advert adverts advertisement advertisements advertising adsense adsbygoogle comment comments disqus reply replies respond cookie cookies consent gdpr newsletter popup modal nav navbar breadcrumb breadcrumbs pagination pager sidebar".split())
LIKELY_WORDS = SURE_WORDS | frozenset("sponsor sponsored promo promotion banner notice notices overlay subscribe subscription signup widget widgets menu navigation footer masthead topbar share sharing social related recommended recommendations login search copyright disclaimer toolbar alert skip".split())
COMMENT_WORDS = frozenset("comment comments reply replies".split())
#: Words beside them in a class name that leave its meaning alone.
NEUTRAL_WORDS = frozenset("box bar block container wrapper wrap section area list item items link links button buttons form panel row col inner outer top bottom left right global site page header slot unit posts articles stories icon icons".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: An open element of the first kind ends where one of the second begins.
CLOSED_BY = {"p": BLOCKS - {"br"}, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "tbody", "tfoot"}), "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}), "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}), "option": frozenset({"option", "optgroup"}), "head": frozenset({"body"})}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|</([a-zA-Z][^\s>]*)[^>]*>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Attributes without one of these names (id is in hidden) say nothing here.
_TELLING = re.compile(r"class|id|role|style|itemprop", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PLAIN = HEADINGS | frozenset("p blockquote pre li".split())
#: Numbers in class names and ids that name one page, not a place in all of them.
_NUMBER = re.compile(r"[0-9]{3,}|(?<=[-_])[0-9]+$")
#: Before a path whose branch goes only where its class name may mean furniture.
_WEAK = "~"


class Block(NamedTuple):
    text: str
    paths: tuple[str, ...]  #: of the elements around it, outermost first
    noise: bool  #: the page's own markup says so
    main: bool  #: inside the page's article
    likely: tuple[str, ...]  #: those of the paths whose class names may mean furniture


class Element(NamedTuple):
    tag: str
    path: str
    noise: bool
    main: bool
    marked: bool  #: has a class or an id, or isn't a plain text element
    likely: bool  #: its class name may mean furniture
    children: list


def _digest(value: str) -> str:
    return "#" + hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(raw)} if raw.strip(" /\n\t\r") else {}


def _names(tokens: list[str], words: frozenset[str]) -> bool:
    """Whether one of the class names or ids is made of these words and neutral ones alone."""
    for token in tokens:
        parts = set(re.split(r"[^a-z]+", token)) - {""}
        if parts & words and parts <= words | NEUTRAL_WORDS:
            return True
    return False


def parse(page: str) -> tuple[list[Block], list[Element]]:
    """The text blocks of a page in order, and all its elements with the sequence of their children."""
    root = Element("", "", False, False, False, False, [])
    stack, elements, blocks, held = [root], [], [], []
    open_tags: Counter = Counter()

    def close(k: int) -> None:
        for e in stack[k:]:
            open_tags[e.tag] -= 1
        del stack[k:]

    def flush() -> None:
        if not held:
            return
        text = "".join(held)
        text = " ".join((html.unescape(text) if "&" in text else text).split())
        held.clear()
        if text:
            top = stack[-1]
            blocks.append(Block(text, tuple(e.path for e in stack[1:]), top.noise, top.main, tuple(e.path for e in stack[1:] if e.likely)))

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag in BLOCKS:
                flush()
            while len(stack) > 1 and tag in CLOSED_BY.get(stack[-1].tag, ()):
                close(len(stack) - 1)
            if open_tags["p"] and (tag == "p" or tag in BLOCKS and tag != "br"):  # an open paragraph ends, with the inline elements in it
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        close(k)
                        break
                    if stack[k].tag in BLOCKS:
                        break
            if tag in VOID:
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}[\s>/]", re.I).search(page, at)
                at = n if end is None else page.find(">", end.start()) + 1 or n
                continue
            up = stack[-1]
            base = up.path if len(up.path) <= PATH_CHARS else _digest(up.path)
            if m[2] and _TELLING.search(m[2]):
                a = _attributes(m[2])
                tokens = a.get("class", "").lower().split() + ([] if tag in HEADINGS else a.get("id", "").lower().split())
                hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
                named = tokens and tag not in ("html", "body", "article", "main")
                likely = bool(named) and _names(tokens, LIKELY_WORDS)
                noise = up.noise or tag in NOISE_TAGS or hidden or a.get("role") in NOISE_ROLES or (likely and not up.main) or (likely and _names(tokens, SURE_WORDS)) or (tag == "article" and _names(tokens, COMMENT_WORDS)) or (tag == "header" and not up.main)
                starts_main = tag in ("article", "main") or a.get("role") == "main" or a.get("itemprop") == "articleBody"
                mark = ".".join(sorted({_NUMBER.sub("", t) for t in tokens} - {""}))
                e = Element(tag, f"{base}/{tag}{'.' + mark if mark else ''}", noise, up.main or (starts_main and not noise), bool(mark) or tag not in _PLAIN, likely, [])
            else:
                noise = up.noise or tag in NOISE_TAGS or (tag == "header" and not up.main)
                e = Element(tag, f"{base}/{tag}", noise, up.main or (not noise and tag in ("article", "main")), tag not in _PLAIN, False, [])
            up.children.append(e.path)
            stack.append(e)
            open_tags[tag] += 1
            elements.append(e)
            if m[2].endswith("/") and tag in ("svg", "path"):
                close(len(stack) - 1)
        elif m[3]:
            tag = m[3].lower()
            if tag in BLOCKS:
                flush()
            for k in range(len(stack) - 1, 0, -1) if open_tags[tag] else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in ("article", "main", "body") and tag not in BLOCKS:
                    break
    flush()
    return blocks, elements


def page_text(page: str, low: frozenset[str] = frozenset()) -> str:
    """The main text of a page whose host has paths ``low`` of low importance; those that begin with ``~`` are low enough
    only for branches inside the article whose class names may mean furniture."""
    blocks, elements = parse(page)
    kept = [b for b in blocks if not b.noise]
    marked = {e.path for e in elements if e.marked}
    if any(b.main for b in kept):
        kept = [b for b in kept if b.main]
    if low:
        kept = [b for b in kept if not any(p in low and (p in marked or not b.main) for p in b.paths if not p.endswith(("/html", "/body", "/article", "/main"))) and not any(_WEAK + p in low for p in b.likely)]
    return "\n".join(b.text for b in kept)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, path, kind, value, weight): each page's presentations (kind 0) and content features (kind 1), once each, the
    path itself (kind 2), and (kind 3) that its class name may mean furniture, with the page's weight."""
    for b in batches:
        out: tuple[list, list, list, list, list] = ([], [], [], [], [])
        for host, page, weight in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            blocks, elements = parse(page or "")
            seen = {(e.path, 0, _digest("|".join(e.children))) for e in elements}
            seen |= {(e.path, 2, "") for e in elements}
            seen |= {(p, 1, x.text) for x in blocks for p in x.paths}
            seen |= {(e.path, 3, "") for e in elements if e.likely and not e.noise}
            for path, kind, value in seen:
                out[0].append(host)
                out[1].append(path)
                out[2].append(kind)
                out[3].append(value)
                out[4].append(weight)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.string()), pa.array(out[4], pa.float64())], ["host", "path", "kind", "value", "weight"])
        give_back()


def host_of(url):
    """The host of a URL, in lower case; null without one."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _own_texts(pages: pa.Array) -> pa.Array:
    out = pa.array([_digest(page_text(page or "")) for page in pages.to_pylist()], pa.string())
    give_back()
    return out


def _weighted(pages: DataFrame) -> DataFrame:
    """Pages with ``weight``, one over the number of pages of their host with the same text by their own markup."""
    same = pages.select("host", F.xxhash64("html").alias("look"), F.arrow_udf(_own_texts, "string")("html").alias("own"))
    looks = same.groupBy("host", "own", "look").agg(F.count("*").alias("n"))
    copies = looks.groupBy("host", "own").agg(F.sum("n").alias("copies"), F.collect_set("look").alias("looks")).where("copies > 1")
    copies = cut(copies.select("host", F.explode("looks").alias("look"), "copies"))
    few = F.broadcast(copies) if copies.count() <= BROADCAST_PATHS else copies
    return pages.withColumn("look", F.xxhash64("html")).join(few, ["host", "look"], "left").select("host", "html", (1.0 / F.coalesce("copies", F.lit(1))).alias("weight"))


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, n_pages, likely, importance) of pages (host, html), of which copies count as one: 0.1 of the
    presentation's entropy and 0.9 of one less the mean evenness of the content features, both to the base of the number
    of pages; ``likely`` where a class name may mean furniture. Pages without a host have no tree."""
    features = _weighted(pages.where("host is not null").select("host", "html")).mapInArrow(_features, "host string, path string, kind int, value string, weight double")
    counts = features.groupBy("host", "path", "kind", F.xxhash64("value").alias("v")).agg(F.round(F.sum("weight"), 6).alias("n"))
    log = F.log("n")
    sums = counts.groupBy("host", "path").agg(
        F.max(F.when(F.col("kind") == 2, F.col("n"))).alias("n_pages"),
        F.sum(F.when(F.col("kind") == 0, F.col("n") * log)).alias("looks"),
        F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("all_looks"),
        F.avg(F.when(F.col("kind") == 1, F.greatest(log, F.lit(0.0)))).alias("evenness"),
        F.coalesce(F.max(F.col("kind") == 3), F.lit(False)).alias("likely"),
    )
    m = F.log(F.col("n_pages").cast("double"))
    presentation = F.log(F.col("all_looks").cast("double")) - F.col("looks") / F.col("all_looks")
    importance = F.when(F.col("n_pages") > 1, (PRESENTATION * presentation + (1 - PRESENTATION) * (m - F.coalesce("evenness", m))) / m).otherwise(1.0)
    return sums.select("host", "path", "n_pages", "likely", importance.alias("importance"))


def _texts(pages: pa.Array, low: pa.Array) -> pa.Array:
    known: dict = {}
    out = []
    for page, paths in zip(pages.to_pylist(), low.to_pylist(), strict=True):
        key = tuple(paths or ())
        if key not in known:
            known[key] = frozenset(key)
        out.append(page_text(page or "", known[key]))
    give_back()
    return pa.array(out, pa.string())


def main_text(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``pages`` with ``text``: the blocks of the main text joined by one line break; the html column goes.

    Null and empty html, and pages without main text, give the empty text. Pages without a host are read by their own
    markup alone. A text column that is there already is replaced, all other columns stay, whatever their names;
    repeated rows count as one page of their host and get the same text; a page of any length or depth is read whole; an
    empty table gives no rows.
    """
    bound_batches(pages.sparkSession)
    names = [c for c in pages.columns if c not in ("text", html_column)]
    own = free_name(pages.columns, "_tree")
    host, source, low_paths = f"{own}_host", f"{own}_html", f"{own}_low"
    keyed = pages.withColumn(host, host_of(F.col(f"`{url_column}`"))).withColumn(source, F.col(f"`{html_column}`").cast("string"))
    tree = style_tree(keyed.select(F.col(host).alias("host"), F.col(source).alias("html")))
    least = F.when(F.col("likely"), LIKELY_IMPORTANCE).otherwise(LEAST_IMPORTANCE)
    found = tree.where((F.col("n_pages") >= LEAST_PAGES) & (F.col("importance") < least))
    path = F.when(F.col("importance") < LEAST_IMPORTANCE, F.col("path")).otherwise(F.concat(F.lit(_WEAK), F.col("path")))
    also = F.when(F.col("likely") & (F.col("importance") < LEAST_IMPORTANCE), F.array(path, F.concat(F.lit(_WEAK), F.col("path")))).otherwise(F.array(path))
    low = cut(found.select(F.col("host").alias(host), F.explode(also).alias("path")).groupBy(host).agg(F.sort_array(F.collect_list("path")).alias(low_paths)))
    size = low.agg(F.sum(F.size(low_paths))).first()[0] or 0
    joined = keyed.join(F.broadcast(low) if size <= BROADCAST_PATHS else low, host, "left")
    return joined.select(*[F.col(f"`{c}`") for c in names], F.arrow_udf(_texts, "string")(source, low_paths).alias("text"))
