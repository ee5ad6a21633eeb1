"""Main text of web pages by consensus host paths.

1. Every page is tokenised once into a tree of containers.  A container's *path* is generalised:
   tag names from the body down, each with its classes and ids where digits become ``#``.
   Containers are scored by their own readable text (length less link text, more for paragraphs
   and sentence marks), damped by each step away from the text and by links; holding the
   heading (h1, h2) itself counts for a container, being one of several on the same path and a name that
   says boilerplate (``UNLIKELY``) against it.
2. Pages vote: a page gives the paths of all its scored containers their shares of its best score, and Spark adds votes per
   host and path (map-side first, so a host with a third of all pages is no hot key).
3. Each host's winning path goes back to its pages, which are read again: every container on
   the winning path (articles split in parts have several) gives its text; a page without the
   path uses its own best container, and one without any scored container its body.

Extraction leaves out what is not the article inside the chosen container as well: by element navigation, headers,
footers, asides, forms, scripts and styles, by attribute what is hidden, and blocks whose class, id or role names a menu,
sidebar, notice, advert, share bar or reader comments.  The name of the chosen container itself, or of what is around it,
does not matter.  A name counts as a whole or, on elements that group others, by its first or last
word; classes that file a page ("category-legal", "tag-search") never count, beside a class that says article only whole names do; ids of
headings and other text never count, and inside an article only those that are hardly a title's slug.  A wrapper with an
unlucky name that holds the page's h1 and half of its text is read.  Character references are decoded, white
space inside a block becomes one space, blocks are trimmed and joined by one newline.

Edge cases: null, empty and tagless html (a text without markup is one block) never fail; unclosed
and stray tags are closed as browsers do for the elements concerned; elements deeper than ``MOST_DEPTH`` hang at that depth, as
in browsers; reading is linear in the page's length whatever its markup; a missing or unusable url
puts the page on the host ""; repeated rows each get a row; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import map_rows, materialise

#: Bytes of winning paths that are broadcast at most.
MOST_BROADCAST = 8 << 20
#: Elements whose content is never read as markup.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that start and end a block of text.
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol",
    "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption",
}
#: Containers that can be a page's main part.
CONTAINER = {"article", "body", "div", "main", "section", "td"}
#: Elements left out with all they hold.
SKIPPED = {"nav", "header", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "button", "select", "option", "textarea", "title", "head", "dialog", "menu", "input", "label", "fieldset", "xmp", "noembed", "noframes", "audio", "video", "math"}
#: Words of class, id and role that mark what is not the article.
BOILERPLATE_WORDS = (
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot", "banner", "sponsor", "sponsored", "promo", "promotion",
    "promoted", "nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "sidebar", "side", "aside", "rail", "widget", "widgets",
    "footer", "foot", "masthead", "topbar", "toolbar", "comment", "comments", "commentlist", "responses", "disqus", "respond", "reply", "replies",
    "discussion", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay",
    "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "recommendations", "popular",
    "trending", "pagination", "pager", "copyright", "legal", "disclaimer", "search", "tags", "contentinfo", "complementary", "hidden", "feedback",
    "paywall", "outbrain", "taboola", "skip",
)
_WORDS = frozenset(BOILERPLATE_WORDS)
#: Of these, words that count only as a whole name ("overflow-hidden", "side-note" and "legal-basis" are no marks).
_WHOLE_ONLY = frozenset({"discussion", "hidden", "legal", "side"})
#: Words that count as an id inside an article, where ids are mostly slugs of titles.
_SURE_IDS = frozenset({"ad", "ads", "adsense", "adslot", "breadcrumb", "breadcrumbs", "comments", "commentlist", "disqus", "menubar", "navbar", "newsletter", "outbrain", "pager", "pagination", "paywall", "popup", "respond", "sidebar", "subscribe", "taboola", "toolbar", "widget", "widgets"})
#: Elements that group others; the rest are text, on which only whole classes and roles count.
_GROUPS = {"address", "center", "dd", "details", "div", "dl", "dt", "figure", "header", "li", "main", "ol", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: Further words that count only on containers outside an article ("header" may be an article's own).
_TOP_WORDS = frozenset({"header", "head", "top", "bottom", "meta", "site"})
#: First words of classes that file a page under something: what follows is data.
FILING = {"author", "cat", "category", "format", "label", "lang", "page", "parent", "post", "postid", "status", "tag", "tax", "term", "topic", "type"}
#: Classes that say article: beside them only whole names count as boilerplate.
ARTICLE_NAMES = {"article", "content", "entry", "hentry", "main", "post", "story"}
#: What a name that says boilerplate leaves of a container's score.
UNLIKELY = 0.1
#: Elements nested deeper are siblings.
MOST_DEPTH = 512
#: Tags that an opening tag of the key closes when open just above it.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "thead": {"tbody"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
#: Inline elements that a new block closes when left open (as in <p><b>...<p>).
INLINE_LIMIT = {"table", "td", "th", "ul", "ol", "dl", *CONTAINER, "blockquote", "nav", "header", "footer", "aside", "form", "figure", "main", "html", "details"}

_OPENS = re.compile(r"<(?=[A-Za-z!?]|/[A-Za-z])")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_MARK = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")
_SENTENCE = re.compile(r"[.,;:!?。、]")


class Node:
    """An element: its generalised step, parent, and children and texts in page order."""

    __slots__ = ("tag", "step", "parent", "items", "skipped", "named")

    def __init__(self, tag: str, step: str, parent: Node | None, skipped: bool, named: bool = False):
        self.tag, self.step, self.parent, self.items, self.skipped = tag, step, parent, [], skipped
        self.named = named  # skipped for its class, id or role alone


def _says(name: str, marks: frozenset[str], parts: bool) -> bool:
    """Whether a class, id or role is one of ``marks``, or with ``parts`` begins or ends with one."""
    words = [w.lower() for w in _SPLIT.split(name) if w]
    if "".join(words) in marks:
        return name.lower() == "hidden" or "".join(words) != "hidden"
    if not parts or not words:
        return False
    first = next((w for w in words if len(w) > 2 or w in marks), "")  # behind prefixes as in "c-share-bar"
    return any(w in marks and w not in _WHOLE_ONLY for w in (first, words[-1]))


def _files(name: str) -> bool:
    """Whether a class files the page ("category-legal") rather than names the element ("post-comments" names comments)."""
    words = [w.lower() for w in _SPLIT.split(name) if w]
    return len(words) > 1 and words[0] in FILING and (words[0] not in {"page", "post"} or words[-1] in {"format", "type", "status"})


def _boilerplate(tag: str, named: list[tuple[str, str]], above: Node | None) -> bool:
    """Whether the (attribute, name) pairs of a tag below ``above`` mark what is not the article."""
    group = tag in _GROUPS
    classes = [name for kind, name in named if kind != "id"]
    if any(_says(name, _WORDS, False) for name in classes):
        return True
    if group and not any(name.lower() in ARTICLE_NAMES for name in classes) and any(_says(name, _WORDS, not _files(name)) for name in classes):
        return True
    ids = [name for kind, name in named if kind == "id" and group]
    if not any(_says(name, _WORDS, True) for name in ids):
        return False
    while above is not None and above.tag not in {"article", "main"}:
        above = above.parent
    return above is None or any(_says(name, _SURE_IDS, tag != "section") for name in ids)


def _marks(tag: str, attributes: str) -> tuple[str, set[str], bool, list[tuple[str, str]]]:
    """(generalised step, words of class, id and role, hidden, (attribute, name) pairs) of a tag."""
    if not attributes or attributes.isspace():
        return tag, set(), False, []
    names, words, hidden, named = [], set(), False, []
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(a or b or c)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        elif name != "aria-hidden":
            words.update(w.lower() for w in _SPLIT.split(value) if w)
            named += [(name, v) for v in value.split()]
            if name != "role":
                names += [("." if name == "class" else "#") + _DIGITS.sub("#", v) for v in value.split()]
    return tag + "".join(sorted(set(names))), words, hidden, named


def _tokens(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, tag, attributes) of the tags in a page; comments and declarations have no tag.

    Each place is looked at a bounded number of times: where no ``>`` follows there are no more tags, and once
    quotes hide every ``>`` that is left they are read as plain characters.
    """
    at, last, quotes = 0, page.rfind(">"), True
    while found := _OPENS.search(page, at):
        start = found.start()
        if page.startswith(("<!--", "<![CDATA["), start):
            mark = "-->" if page[start + 2] == "-" else "]]>"
            end = page.find(mark, start + 4)
            at = len(page) if end < 0 else end + 3
            yield start, at, False, "", ""
            continue
        if page[start + 1] in "!?":
            end = page.find(">", start)
            at = len(page) if end < 0 else end + 1
            yield start, at, False, "", ""
            continue
        closing = page[start + 1] == "/"
        name = _NAME.match(page, start + 1 + closing)
        end = name.end()
        if last < end:  # nothing closes a tag any more
            return
        while quotes:
            mark = _MARK.search(page, end)
            if not mark:
                quotes = False
            elif mark[0] == ">":
                end = mark.start()
                break
            else:
                end = page.find(mark[0], mark.end()) + 1
                if not end:
                    quotes = False
        if not quotes:
            end = page.find(">", name.end())
        at = end + 1
        yield start, at, closing, name[0].lower(), page[name.end() : end]


def parse(page: str | None) -> Node:
    """The tree of a page; the root is a ``body`` step that holds everything outside the head."""
    page = page or ""
    root = Node("body", "body", None, False)
    at, node, named, depth = 0, root, False, 0
    open_tags: Counter[str] = Counter()

    def close(tag: str, limit: set[str]) -> bool:
        nonlocal node, depth
        up = node if open_tags[tag] else root
        while up is not root:
            if up.tag == tag:
                while node is not up.parent:
                    open_tags[node.tag] -= 1
                    node, depth = node.parent, depth - 1
                return True
            if up.tag in limit:
                return False
            up = up.parent
        return False

    for start, end, closing, tag, attributes in _tokens(page):
        if start < at:  # inside an element that is not read as markup
            continue
        if start > at:
            node.items.append(page[at:start])
        at = end
        if not tag:
            continue
        if closing:
            if tag == "p" and not close("p", INLINE_LIMIT) or tag == "br":
                continue
            if tag not in {"p", "body", "html", "br"}:
                close(tag, set() if tag in INLINE_LIMIT else INLINE_LIMIT)
            continue
        if tag in {"html", "body"}:
            continue
        if tag in BLOCK and tag != "li":  # a paragraph ends where a block begins, with what is open inside it
            close("p", INLINE_LIMIT)
        for other in CLOSES.get(tag, ()):
            close(other, {"ul", "ol", "dl", "table", "nav", "select"})
        if tag == "br" or tag == "hr" or tag in VOID:
            node.items.append(Node(tag, tag, node, tag == "input"))
            continue
        step, words, hidden, names = _marks(tag, attributes)
        bad = tag in SKIPPED or hidden
        if words and not bad and tag != "article":
            bad = _boilerplate(tag, names, node) or tag in CONTAINER and node is root and bool(words & _TOP_WORDS)
        if tag == "header" and not hidden and not _boilerplate(tag, names, node):
            bad = not open_tags["article"]
        child = Node(tag, step, node, bad, bad and tag not in SKIPPED and not hidden)
        named |= child.named
        node.items.append(child)
        if tag in RAW:
            stop = re.compile(rf"</{tag}\s*/?>", re.I).search(page, at)
            at = stop.end() if stop else len(page)
        elif depth < MOST_DEPTH and (not attributes.endswith("/") or tag not in {"svg", "path"}):
            node, depth = child, depth + 1
            open_tags[tag] += 1
    if at < len(page):
        node.items.append(page[at:])
    if named:
        _readmit(root)
    return root


def _readmit(root: Node) -> None:
    """Take back wrappers skipped for their names that hold the h1 and half of the page's text."""
    order = _in_order(root)
    length, head = {}, {}
    for node in reversed(order):
        n, h = sum(len(i.strip()) for i in node.items if isinstance(i, str)), node.tag == "h1"
        for child in node.items:
            if not isinstance(child, str) and (not child.skipped or child.named):
                n, h = n + length[id(child)], h or head[id(child)]
        length[id(node)], head[id(node)] = n, h
    for node in order:
        if node.named and head[id(node)] and 2 * length[id(node)] >= length[id(root)]:
            node.skipped = False


def blocks(node: Node) -> list[str]:
    """Texts of the blocks of ``node`` in page order, cleaned; empty ones left out."""
    out, run = [], []

    def flush() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text:
            out.append(text)

    stack: list = [iter(node.items)]
    ends: list[bool] = [True]
    while stack:
        item = next(stack[-1], None)
        if item is None:
            stack.pop()
            if ends.pop():
                flush()
        elif isinstance(item, str):
            run.append(item)
        elif item.skipped:
            if item.tag in BLOCK or item.tag in SKIPPED:
                flush()
        elif item.tag == "br":
            run.append(" ")
        else:
            block = item.tag in BLOCK
            if block:
                flush()
            stack.append(iter(item.items))
            ends.append(block)
    flush()
    return out


def _path_key(above: int, step: str) -> int:
    return xxhash.xxh64_intdigest(step.encode("utf-8", "surrogatepass"), above) >> 1


def path_of(node: Node) -> str:
    """The generalised path of a container, spelled out."""
    steps = []
    while node is not None:
        if node.parent is None or node.tag in CONTAINER:
            steps.append(node.step)
        node = node.parent
    return ">".join(reversed(steps))


def candidates(root: Node) -> dict[int, tuple[float, list[Node]]]:
    """Score and containers by the key of their generalised path; those inside elements that are never read are none.

    What only its name marks as boilerplate is a candidate, but an unlikely one, and its text does not count for what is around it.
    """
    own: dict[int, list] = {}
    order: list[tuple[Node, int]] = []
    stack: list[tuple[Node, int, Node | None, bool, float]] = [(root, _path_key(0, "body"), None, False, 1.0)]
    while stack:
        node, path, holder, link, likely = stack.pop()
        if node.skipped:
            if not node.named:
                continue
            likely, holder = UNLIKELY, None
        if node.tag in CONTAINER or node is root:
            own[id(node)] = [0.0, 0.0, holder, False, likely]
            order.append((node, path))
            holder = node
        tally = own[id(holder)] if holder is not None else [0.0, 0.0, None, False, likely]
        tally[3] |= node.tag in {"h1", "h2"}
        for item in node.items:
            if isinstance(item, str):
                n = len(item.strip())
                if n:
                    marks = len(_SENTENCE.findall(item))
                    tally[1 if link else 0] += n + (0 if link else 8 * marks) + (25 if node.tag == "p" and n > 20 else 0)
            else:
                stack.append((item, _path_key(path, item.step) if item.tag in CONTAINER else path, holder, link or item.tag == "a", likely))
    total: dict[int, list[float]] = {}
    for node, _ in reversed(order):  # children come after their parents
        text, links, holder, _, _ = own[id(node)]
        t = total.setdefault(id(node), [0.0, 0.0, 0.0])
        t[0] += text
        t[1] += links
        t[2] += text  # damped: a container's text counts less for each one around it
        if holder is not None:
            up = total.setdefault(id(holder), [0.0, 0.0, 0.0])
            up[0] += t[0]
            up[1] += t[1]
            up[2] += 0.8 * t[2]
    out: dict[int, tuple[float, list[Node]]] = {}
    for node, path in order:
        text, links, damped = total[id(node)]
        bonus = 1.5 if node.tag in {"article", "main"} else 0.7 if node is root else 1.0
        bonus *= 1.4 if own[id(node)][3] else 1.0
        score = own[id(node)][4] * bonus * damped * (1 - links / (text + links)) if text else 0.0
        if score > 0:
            held = out.get(path, (0.0, []))
            # several parts weigh less than the container around them, which holds what is between them
            out[path] = (max(held[0], score) + 0.5 * min(held[0], score), held[1])
            held[1].append(node)
    return out


def _outermost(nodes: list[Node]) -> list[Node]:
    """Without those inside another of them."""
    held, out = {id(n) for n in nodes}, []
    for n in nodes:
        up = n.parent
        while up is not None and id(up) not in held:
            up = up.parent
        if up is None:
            out.append(n)
    return out


def votes(page: str | None) -> list[tuple[int, float, str | None]]:
    """(key, share of the best score, path) of all scored paths of a page, the best first; only that is spelled out."""
    found = sorted(((s, p, nodes) for p, (s, nodes) in candidates(parse(page)).items()), key=lambda x: (-x[0], x[1]))
    return [(p, s / found[0][0], path_of(nodes[0]) if i == 0 else None) for i, (s, p, nodes) in enumerate(found)]


def extract(page: str | None, path: int | None = None) -> str:
    """Main text of one page, from the containers on ``path`` (a key) if the page has it, else from its own best container."""
    root = parse(page)
    found = candidates(root)
    if path not in found:
        path = min(found, key=lambda p: (-found[p][0], p)) if found else None
    nodes = _outermost(found[path][1]) if path is not None else [root]
    order = {id(n): i for i, n in enumerate(_in_order(root))}
    return "\n".join(b for n in sorted(nodes, key=lambda n: order[id(n)]) for b in blocks(n))


def _in_order(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [i for i in reversed(node.items) if not isinstance(i, str)]
    return out


def host() -> F.Column:
    raw = F.coalesce(F.col("url").cast("string"), F.lit(""))
    return F.lower(F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def winning_paths(pages: DataFrame) -> DataFrame:
    """host, key, path, votes, pages: the path of each host with most votes (the least key if equal).

    ``path`` spells it out as the first page that has it as its best; null if none has.
    """

    def one(batch: pa.RecordBatch) -> dict:
        got = [(h, p, round(s * 1000), path) for h, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for p, s, path in votes(page)]
        return {n: [g[i] for g in got] for i, n in enumerate(("host", "key", "vote", "path"))}

    cast = map_rows(pages.select(host().alias("host"), F.col("html").cast("string")), "host string, key long, vote long, path string", one, [pa.string(), pa.int64(), pa.int64(), pa.string()])
    summed = cast.groupBy("host", "key").agg(F.sum("vote").alias("votes"), F.count(F.lit(1)).alias("pages"), F.min("path").alias("path"))
    first = F.min(F.struct((-F.col("votes")).alias("less"), "key", "path", "votes", "pages")).alias("w")
    return summed.groupBy("host").agg(first).select("host", "w.key", "w.path", "w.votes", "w.pages")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, path (the consensus path of the page's host) for every row of ``pages``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host().alias("host"))
    # written, so that a join by shuffle can split a hot host; broadcast while the table is small
    winners = materialise(winning_paths(pages).select("host", "key", "path"), "host-paths")
    size = winners.agg(F.coalesce(F.sum(F.octet_length("host") + F.coalesce(F.octet_length("path"), F.lit(0)) + 64), F.lit(0))).first()[0]
    joined = rows.join(F.broadcast(winners) if size <= MOST_BROADCAST else winners, "host", "left")

    def one(batch: pa.RecordBatch) -> dict:
        texts = [extract(page, key) for page, key in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts], "path": batch.column(4)}

    return map_rows(joined.select("page_id", "url", "html", "key", "path"), "page_id long, url string, text string, n_chars long, path string", one, [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()])
