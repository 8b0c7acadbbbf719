"""Main text of web pages by union-free wrappers.

A wrapper is a regular expression without unions over a page's tokens: tags, text slots, optional and repeated groups.
A page is its own first wrapper. Two wrappers of a host are aligned level by level: where the tokens agree the parts
are merged, text that differs becomes a slot, what only one has becomes optional, and equal neighbours (single tokens
or groups of up to four) become one repeated group. A part also counts the signs it had, those in links, and the
distinct pages it stood on, up to ``DISTINCT``; pages whose
longest texts, most of the page, are the same are one page. Pages fold into
wrappers within tasks, then in two more levels by host, so a host with a third of all pages never gathers in one task;
a wrapper's size follows the host's design.

A page is then read along its host's wrapper, part by part. The wrapper decides what the article is and what in it is
not the article:

* The article is the page's ``article`` or ``main`` elements. Where a host has none, it is the smallest part of the
  wrapper that holds most of the host's changing text outside links.
* Parts whose class or id is a sure name of adverts, sidebars, reader comments and the like go. Of names that a part of
  an article may also have (discussion, related, notice, tags), the name is a hint: such a part of a marked article
  goes only if the wrapper shows that it always says the same or that it is mostly links; where no article is marked,
  also if it stands on several distinct pages, or if the host has too few pages to tell.
* On hosts without ``article`` and ``main``, text that is the same on several distinct pages goes, and so do recurring
  parts that are mostly links.

Elements that are by definition something else (nav, aside, footer, form, script and the like, or such a role) go
everywhere, a page's header outside its article.

Defined results: null html is empty; unclosed, misnested and cut-off markup is read as browsers do in the main; pages
with a null url share one wrapper; repeated rows each get a row; elements below ``DEEP`` levels count as one level; a
column ``text`` of the pages gives way to the result.
"""

from __future__ import annotations

import html as entities
import json
import re
from difflib import SequenceMatcher
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, sliced

DEEP = 100
#: Distinct pages from which a wrapper is evidence.
DISTINCT = 3
#: The share of a part's signs in links from which it counts as links, and of a host's changing text that marks its article.
LINKS, MOST = 0.5, 0.7
_SALTS = 16

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<", re.S)
_ATTR = re.compile(r"""([^\s=/"']+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+)))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript iframe template svg math object canvas audio video".split())
_SKIP = _RAW | frozenset("head nav aside footer form button select option label dialog menu input".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
_CLOSES_P = _BLOCK - {"body", "html", "tr", "tbody", "thead", "tfoot", "caption"}
_SCOPE = frozenset("article section div main body html table td th ul ol dl aside footer header nav form blockquote figure".split())
_WITHIN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_PEERS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Usual names (whole classes or ids) of parts that are not the article: those that say so surely, and those that a part
# of an article may also have.
_FIRM = frozenset(
    "ad ads advert adverts advertisement advertising ad-box adbox ad-slot adslot ad-container adsbygoogle sponsor sponsored sponsored-content promo-box "
    "navbar main-menu breadcrumb breadcrumbs pagination site-header page-header site-footer page-footer sidebar side-bar "
    "cookie cookies cookie-banner cookie-notice cookie-consent consent gdpr popup newsletter newsletter-signup subscribe search-form searchbox "
    "comment comments comment-list commentlist comments-area disqus disqus_thread share sharing share-buttons social-share social-links related-posts related-articles".split()
)
_NAMES = _FIRM | frozenset(
    "promo banner nav navigation menu pager toolbar masthead header footer aside widget widgets notice alert modal overlay disclaimer "
    "subscription signup login search respond replies discussion social related recommended tags copyright".split()
)
# Names of parts that hold the article, on hosts too small for a wrapper to tell.
_CONTENT = frozenset("main article article-body article-content post post-body post-content entry entry-content story story-body content content-main main-content".split())


# What is never taken for something else by its name.
_OWN = frozenset("body html main article h1 h2 h3 h4 h5 h6 a b i em strong code td tr".split())


class Node:
    __slots__ = ("tag", "label", "skip", "kids", "main", "named", "firm", "content")

    def __init__(self, tag: str, label: str = "", skip: bool = False, main: bool = False, named: bool = False, firm: bool = False, content: bool = False):
        self.tag, self.label, self.skip, self.main, self.named, self.firm, self.content, self.kids = tag, label or tag, skip, main, named, firm, content, []


def _opened(tag: str, rest: str) -> Node:
    attrs = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(rest)} if rest.strip(" \t\r\n/") else {}
    if not attrs:
        return Node(tag, tag, tag in _SKIP, tag in ("article", "main"))
    names = {re.sub(r"(?<=[a-z])(?=[A-Z])", "-", x).lower() for x in f"{attrs.get('class', '')} {attrs.get('id', '')}".split()}
    role = attrs.get("role", "").lower()
    skip = tag in _SKIP or role in _ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true"
    # Numbers in names belong to a page and not to the design; two classes tell parts apart.
    key = re.sub(r"\d+", "0", " ".join(x for x in (tag, *attrs.get("class", "").split()[:2], attrs.get("id", ""), role and f"role={role}") if x))
    main = (tag in ("article", "main") or role in ("main", "article")) and not skip
    named = tag not in _OWN and not _NAMES.isdisjoint(names)
    return Node(tag, key, skip, main, named, named and not _FIRM.isdisjoint(names), tag in ("div", "section", "td") and not named and not _CONTENT.isdisjoint(names))


def parse(html: str | None) -> Node:
    """A page's tree; text is a string among a node's kids."""
    root = Node("")
    # Open elements and the nodes that hold what they contain: below DEEP, the last node of all.
    stack: list[tuple[str, Node]] = [("", root)]
    text, i, n = html or "", 0, len(html or "")

    def close_to(depth: int) -> None:
        del stack[max(1, depth) :]

    while i < n:
        m = _TOKEN.match(text, i)
        i = m.end()
        tag = m[2]
        if tag is None:
            if not m[0].startswith(("<!", "<?", "</")):
                stack[-1][1].kids.append(m[0])
            continue
        tag = tag.lower()
        if m[1]:
            depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d][0] == tag), 0)
            if depth and (tag in _SCOPE or not any(s in _SCOPE for s, _ in stack[depth + 1 :])):
                if depth > DEEP:
                    stack[depth][1].kids.append(Node(tag))
                close_to(depth)
            elif tag in ("p", "br"):
                stack[-1][1].kids.append(Node(tag))
            continue
        if tag in _CLOSES_P:
            for d in range(len(stack) - 1, 0, -1):
                if stack[d][0] == "p":
                    close_to(d)
                    break
                if stack[d][0] in _SCOPE:
                    break
        if tag in _PEERS:
            for d in range(len(stack) - 1, 0, -1):
                if stack[d][0] in _PEERS[tag]:
                    close_to(d)
                    if tag != "tr" or stack[-1][0] in ("table", "tbody", "thead", "tfoot"):
                        break
                elif stack[d][0] in _WITHIN[tag]:
                    break
        node = _opened(tag, m[3])
        above = stack[-1][1]
        above.kids.append(node)
        if tag in _VOID or m[3].endswith("/") and tag in ("svg", "math"):
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(text, i)
            i = end.end() if end else n
            continue
        # What is skipped keeps a node of its own at any depth, so that its text never counts as its parent's.
        stack.append((tag, node if len(stack) < DEEP or node.skip and not above.skip else above))
    return root


# A wrapper part: [label, flags, text, kids, pages, signs, linked]. flags hold "?" (optional) and "+" (repeated); text
# is the hash of a text that all pages share, "" for a slot and None for tags; a group has the label "("; pages are the
# marks of up to DISTINCT distinct pages; signs count the text of all pages, linked what of it stands in links.
def wrapper(root: Node) -> list:
    """A page as a wrapper."""
    every: list[str] = []

    def texts(node: Node):
        for k in node.kids:
            if isinstance(k, str):
                every.append(k)
            elif not k.skip:
                texts(k)

    texts(root)
    every.sort(key=lambda t: (-len(t), t))
    ends = list(accumulate(map(len, every)))
    longest = every[: next((i + 1 for i, n in enumerate(ends) if n >= MOST * ends[-1]), 0)]
    page = [xxhash.xxh32_intdigest("\n".join(longest).encode("utf-8", "surrogatepass"))]

    def part(node: Node, link: bool) -> list:
        kids, link = [], link or node.tag == "a"
        for k in node.kids:
            if isinstance(k, str):
                if words := k.split():
                    flat = " ".join(words)
                    kids.append(["#", "", xxhash.xxh64_hexdigest(flat.encode("utf-8", "surrogatepass")), [], page, len(flat), len(flat) * link])
            elif not k.skip:
                kids.append(part(k, link))
        return [node.label, "", None, squash(kids), page, sum(k[5] for k in kids), sum(k[6] for k in kids)]

    return part(root, False)


def _flags(*parts: list) -> str:
    return "".join(f for f in "?+" if any(f in p[1] for p in parts))


def merge(a: list, b: list) -> list:
    """The union-free generalisation of two parts of one label."""
    pages = a[4] if len(a[4]) >= DISTINCT or a[4] == b[4] else sorted({*a[4], *b[4]})[:DISTINCT]
    if a[0] == "#":
        return ["#", _flags(a, b), a[2] if a[2] == b[2] else "", [], pages, a[5] + b[5], a[6] + b[6]]
    return [a[0], _flags(a, b), None, align(a[3], b[3]), pages, a[5] + b[5], a[6] + b[6]]


# Tags that say nothing of what they hold: by their labels alone all of a page's blocks would be one repeated part.
_BARE = frozenset("div section span td tr table tbody ul center".split())


def _key(p: list) -> str:
    return "(" + "|".join(_key(k) for k in p[3]) if p[0] == "(" else p[0]


def _shape(kids) -> frozenset:
    """The labels below a bare part."""
    return frozenset(x[0] if isinstance(x, list) else "#" if isinstance(x, str) else x.label for x in kids if not isinstance(x, str) or x.strip())


def _close(p: list) -> str:
    """A key that also tells bare parts apart by what they hold."""
    if p[0] == "(":
        return "(" + "|".join(map(_close, p[3]))
    return f"{p[0]}<{'|'.join(sorted(_shape(_parts(p[3]))))}>" if p[0] in _BARE else p[0]


def squash(kids: list) -> list:
    """Equal neighbours, single or in groups of up to four, as one repeated part."""
    for width in (1, 2, 3, 4):
        out, i, keys = [], 0, [_close(k) for k in kids]
        while i < len(kids):
            j = i + width
            if width == 1 and keys[i] == "#" or keys[i : i + width] != keys[j : j + width] or len(keys[i : i + width]) < width:
                out.append(kids[i])
                i += 1
                continue
            group = kids[i:j]
            while keys[j : j + width] == keys[i : i + width]:
                group = [merge(x, y) for x, y in zip(group, kids[j : j + width])]
                j += width
            if width == 1:
                out.append([group[0][0], _flags(group[0], ["", "+"]), *group[0][2:]])
            else:
                out.append(["(", "+", None, group, group[0][4], sum(g[5] for g in group), sum(g[6] for g in group)])
            i = j
        kids = out
    return kids


def align(a: list, b: list, key=_close) -> list:
    """Two rows of parts as one; what only one of them has is optional. Parts of one shape are aligned first."""
    ka, kb = [key(k) for k in a], [key(k) for k in b]
    if ka == kb:
        return [merge(x, y) for x, y in zip(a, b)]
    out = []
    for op, i, i2, j, j2 in SequenceMatcher(None, ka, kb, autojunk=False).get_opcodes():
        if op == "equal":
            out += [merge(x, y) for x, y in zip(a[i:i2], b[j:j2])]
        elif op == "replace" and key is _close:
            out += align(a[i:i2], b[j:j2], _key)
        else:
            out += [[p[0], _flags(p, ["", "?"]), *p[2:]] for p in (*a[i:i2], *b[j:j2])]
    return squash(out)


def expression(part: list) -> str:
    """A wrapper as text: tags in <>, slots as #, constant text as =, groups in () with ? and +."""
    if part[0] == "#":
        return ("#" if part[2] == "" else "=") + part[1]
    inner = "".join(expression(k) for k in part[3])
    body = inner if part[0] in ("", "(") else f"<{part[0]}>{inner}</>"
    return f"({body}){part[1]}" if part[1] or part[0] == "(" else body


class Design:
    """What a host's wrapper tells of its parts."""

    def __init__(self, root: list):
        self.root = root
        self.known = len(root[4]) >= DISTINCT
        self.text: dict[int, int] = {}
        self._measure(root)
        # The top-most parts that are articles by their tags, or else the part with most of the changing text.
        tagged = self._tagged(root) if self.known else []
        self.tagged = bool(tagged)
        self.article = {id(p) for p in tagged} or ({id(p)} if self.known and (p := self._article()) else set())

    def recurs(self, part: list | None) -> bool:
        return part is not None and len(part[4]) >= DISTINCT

    def same(self, part: list | None) -> bool:
        """Whether a part says the same on all of several distinct pages."""
        return self.recurs(part) and part[5] > 0 and self.text[id(part)] == 0

    def links(self, part: list | None) -> bool:
        return self.recurs(part) and part[6] > LINKS * part[5]

    def _measure(self, part: list) -> int:
        """Signs of changing text outside links."""
        n = part[5] - part[6] if part[0] == "#" and not (part[2] and self.recurs(part)) else 0
        n = sum(map(self._measure, part[3])) if part[0] != "#" else n
        self.text[id(part)] = n
        return n

    def _tagged(self, part: list) -> list:
        out = []
        for k in part[3]:
            out += [k] if re.match(r"(article|main)( |$)|.* role=(main|article)$", k[0]) else self._tagged(k)
        return out

    def _article(self) -> list | None:
        """The smallest part with most of the changing text, from the root down; None if the whole page has no smaller one."""
        part, found = self.root, None
        while True:
            kids = [k for k in _parts(part[3]) if k[0] != "#"]
            best = max(kids, key=lambda k: self.text[id(k)], default=None)
            if best is None or self.text[id(best)] < MOST * self.text[id(part)] or not self.text[id(best)] or "+" in best[1] or best[0].split()[0] in ("p", "ul", "ol", "dl", "table", "pre", "blockquote", "h1", "h2", "a", "span", "b", "i", "em", "strong"):
                return found
            part = found = best


def _parts(kids: list) -> list:
    """Parts in order; groups are looked into."""
    return [x for k in kids for x in (_parts(k[3]) if k[0] == "(" else [k])]


def matched(kids: list, part: list | None) -> list:
    """For each of a node's kids the wrapper's part that it follows, or None: parts in order, repeated ones again and again."""
    if part is None:
        return [None] * len(kids)
    parts, out, at = _parts(part[3]), [], 0
    where: dict[str, list[int]] = {}
    shapes: dict[int, frozenset] = {}
    for i, p in enumerate(parts):
        where.setdefault(p[0], []).append(i)
    for k in kids:
        text = isinstance(k, str)
        label = "#" if text else k.label
        if label not in where or text and not k.strip():
            out.append(None)
            continue
        places = [i for i in where[label] if i >= at] or where[label][-1:]
        if len(places) > 1 and not text:
            shape = _shape(k.kids)
            like = lambda i: len(shape & shapes[i]) / max(1, len(shape | shapes[i]))
            for i in places:
                if i not in shapes:
                    shapes[i] = _shape(_parts(parts[i][3]))
            at = max(places, key=lambda i: (like(i), -i))
        else:
            at = places[0]
        out.append(parts[at])
        at += "+" not in parts[at][1]
    return out


def host(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def main_text(root: Node, design: Design | None = None) -> str:
    """The article's blocks, one a line."""
    blocks: list[str] = []
    line: list[str] = []

    def has(node: Node, kind: str) -> bool:
        return any(not isinstance(k, str) and not k.skip and (getattr(k, kind) or has(k, kind)) for k in node.kids)

    def holds(node: Node, part: list | None) -> bool:
        """Whether the page has the part that the wrapper takes for the article."""
        return any(p is not None and p[0] != "#" and (id(p) in design.article or holds(k, p)) for k, p in zip(node.kids, matched(node.kids, part)))

    def end() -> None:
        if text := " ".join(entities.unescape("".join(line)).split()):
            blocks.append(text)
        line.clear()

    known = design if design is not None and design.known else None
    kind = "wrapper" if known and known.article and holds(root, known.root) else "main" if has(root, "main") else "content" if not known and has(root, "content") else None
    marked = kind == "main" or kind == "wrapper" and known.tagged  # then an article's own text is never taken for the design's

    def linked(node: Node, link: bool = False) -> tuple[int, int]:
        a = b = 0
        for k in node.kids:
            x, y = (len(k.strip()), len(k.strip()) * link) if isinstance(k, str) else linked(k, link or k.tag == "a")
            a, b = a + x, b + y
        return a, b

    def furniture(node: Node, part: list | None, article: bool) -> bool:
        if node.firm:
            return True
        if node.named:
            if known is not None and (known.same(part) or known.links(part)) or not marked and (known is None or known.recurs(part)):
                return True
            signs, in_links = linked(node)
            return in_links > LINKS * signs
        return known is not None and not marked and not article and known.links(part) and node.tag not in ("p", "a", "body", "html")

    def walk(node: Node, inside: bool, part: list | None, article: bool = False) -> None:
        for k, p in zip(node.kids, matched(node.kids, part)):
            if isinstance(k, str):
                same = not marked and known is not None and known.same(p) and "+" not in p[1] and p[2] == xxhash.xxh64_hexdigest(" ".join(k.split()).encode("utf-8", "surrogatepass"))
                if inside and not same:
                    line.append(k)
                continue
            starts = k.main if kind == "main" else k.content if kind == "content" else kind == "wrapper" and p is not None and id(p) in known.article
            if k.skip or not article and not starts and k.tag == "header" or not starts and furniture(k, p, article):
                if k.tag in _BLOCK:
                    end()
                continue
            mark = k.tag == "br" or k.tag in ("td", "th", "img")
            if mark:
                line.append(" ")
            elif k.tag in _BLOCK:
                end()
            walk(k, inside or starts, p, article or starts)
            if mark:
                line.append(" ")
            elif k.tag in _BLOCK:
                end()

    walk(root, kind is None, known.root if known else None)
    end()
    return "\n".join(blocks)


def _infer(batches):
    """(host, html) to one wrapper for each host of a task."""
    known: dict[str, tuple[list, int]] = {}
    for batch in batches:
        for h, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            w = wrapper(parse(page))
            known[h] = (merge(known[h][0], w), known[h][1] + 1) if h in known else (w, 1)
    if known:
        salt = xxhash.xxh32_intdigest(json.dumps(sorted(known)) + str(sum(n for _, n in known.values()))) % _SALTS
        yield pa.RecordBatch.from_arrays([pa.array(list(known)), pa.array([salt] * len(known), pa.int32()), pa.array([json.dumps(w) for w, _ in known.values()]), pa.array([n for _, n in known.values()], pa.int64())], names=["host", "salt", "wrapper", "pages"])


def _join(batches):
    """Wrappers of a host and salt, in order, to one."""
    known: dict[tuple, tuple[list, int]] = {}
    for batch in batches:
        for h, s, w, n in zip(*(c.to_pylist() for c in batch.columns)):
            w = json.loads(w)
            known[h, s] = (merge(known[h, s][0], w), known[h, s][1] + n) if (h, s) in known else (w, n)
    if known:
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in known]), pa.array([k[1] for k in known], pa.int32()), pa.array([json.dumps(w) for w, _ in known.values()]), pa.array([n for _, n in known.values()], pa.int64())], names=["host", "salt", "wrapper", "pages"])


def _host_column(url):
    # The same as host(), before Python.
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per host: host, wrapper (JSON), pages."""
    schema = "host string, salt int, wrapper string, pages long"
    first = pages.select(_host_column(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).mapInArrow(sliced(_infer), schema)
    order = ["host", "salt", "wrapper"]
    salted = first.repartition("host", "salt").sortWithinPartitions(*order).mapInArrow(_join, schema)
    return salted.withColumn("salt", F.lit(0)).repartition("host").sortWithinPartitions("host", "pages", "wrapper").mapInArrow(_join, schema).select("host", "wrapper", "pages")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The pages' columns ``keep`` (or all but the html) and text."""
    spark = pages.sparkSession
    stash = Stash(spark)
    known = stash(infer(pages, url_col, html_col)).select(F.col("host").alias("__host"), F.col("wrapper").alias("__wrapper"))
    import pandas as pd

    @F.pandas_udf("string")
    def text(html, wrappers):
        loaded: dict[str, Design] = {}
        out = []
        for h, w in zip(html, wrappers):
            if w is not None and w not in loaded:
                loaded[w] = Design(json.loads(w))
            out.append(main_text(parse(h), loaded.get(w)))
        return pd.Series(out, dtype=object)

    keep = [c for c in (keep if keep is not None else pages.columns) if c not in (html_col, "text")]
    both = pages.join(known, _host_column(F.col(url_col)) == F.col("__host"), "left")
    return both.select(*keep, text(F.col(html_col), F.col("__wrapper")).alias("text"))
