"""Main text of web pages by wrappers inferred from the pages of a host.

A page is a stream of tags and texts. A wrapper is a union-free regular expression over such streams, held as a tree:
a node is an element (its tag with class, id and role) or a text slot, in the order of the page, and may be
repeated or optional. Inference folds one page after another into the wrapper of its host: neighbouring
elements that align with each other become one repeated group, elements that only one side has become optional, and
texts that differ become slots. Wrappers fold into each other by the same alignment, so every task folds its own
pages and sixteen wrappers of a host at a time are folded until one is left; no host is gathered.

Numbers of two digits and more inside classes and ids (``post-123``) count as one sign, so pages whose elements carry numbers of their own
align, and the wrapper of a host stays the size of its template.

In a finished wrapper the main element is the first of ``article``, ``main`` or a body of an article that holds text, or
else the element whose own paragraphs hold most text that is no link and differs between pages. Menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and comments inside it are left out. Some are told by their
tag or by a whole class (``comments``). Where such a word is only part of a class (``social-history``, ``share-bar``) the
wrapper decides: the element is left out if at least half of its text is links or slots that the pages of the host
have in common word for word, while other slots differ. A page without the wrapper's main element, or with nothing
in it, is judged by its own tree.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.jobs import cut, folded

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|textarea|title|iframe|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>|([^<]+|<)""",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
DIGITS = re.compile("[0-9]{2,}")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd mark q s samp small span strong sub sup time tt u var wbr".split())
#: Elements that end an open paragraph, and what an element of each kind ends, up to a limit.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dd dt", ("dl",)), "dd": ("dd dt", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
BOILERPLATE_TAGS = frozenset("nav header footer aside form button select menu dialog head".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer "
    "header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted related replies reply respond share "
    "sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that tell an element even as a part of a class; of the other ones the wrapper decides then.
PART_WORDS = frozenset("ad ads advert advertisement adverts breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer nav navbar newsletter promo sidebar sponsor sponsored subscribe".split())
MAIN_WORDS = frozenset("articlebody article-body entry-content post-content story-body main-content".split())
#: Elements nested deeper than this count as part of the last one that is not.
DEEPEST = 200
#: Up to so many hosts their paths go to all tasks; beyond, they are joined, a host in so many copies.
HOSTS_TO_SEND, COPIES = 20_000, 64


def key_of(tag: str, attributes: str) -> str:
    """Tag, and class, id and role where given; longer numbers are one sign."""
    if not attributes or "=" not in attributes:
        return tag
    found = {name.lower(): DIGITS.sub("#", value.strip("\"'").lower()) for name, value in NAMED.findall(attributes)}
    return "".join([tag, *(f"|{name}={found[name]}" for name in ("class", "id", "role") if found.get(name))])


@lru_cache(maxsize=100_000)
def _told(key: str) -> tuple[bool, bool]:
    """Whether a key is boilerplate, and whether the wrapper has to decide."""
    tag, _, rest = key.partition("|")
    if tag in BOILERPLATE_TAGS:
        return True, False
    if not rest or tag in ("body", "html", "article", "main"):
        return False, False
    words = set(re.split(r"[^a-z0-9#-]+", re.sub(r"(^|\|)(class|id|role)=", " ", rest)))
    if words & MAIN_WORDS:
        return False, False
    parts = {part for word in words for part in word.split("-")}
    if words & BOILERPLATE_WORDS or parts & PART_WORDS:
        return True, False
    return False, bool(parts & BOILERPLATE_WORDS)


def boilerplate(key: str, dropped: frozenset[str] = frozenset()) -> bool:
    return key in dropped or _told(key)[0]


def is_main(key: str) -> bool:
    tag, _, rest = key.partition("|")
    return tag in ("article", "main") or "role=main" in rest or bool(rest and set(re.split(r"[^a-z0-9-]+", rest)) & MAIN_WORDS)


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """("open", tag, key), ("close", tag, ""), ("void", tag, ""), ("text", text, "") with all elements closed in order."""
    open_: list[str] = []

    def closed() -> tuple[str, str, str]:
        tag = open_.pop()
        return ("close" if len(open_) < DEEPEST else "void", tag, "")

    for match in TOKEN.finditer(page):
        text = match[5]
        if text is not None:
            yield "text", text, ""
            continue
        tag = match[3]
        if tag is None:
            continue
        tag = tag.lower()
        if match[2]:
            if tag in open_:
                last = None
                while last != tag:
                    last = open_[-1]
                    yield closed()
            continue
        if tag in VOID:
            yield "void", tag, ""
            continue
        ended, limits = ("p", ("button", "td", "th", "table")) if tag in ENDS_P else ENDS.get(tag, ("", ()))
        ended = ended.split()
        if ended and any(e in open_ for e in ended):
            at = len(open_)
            while at and open_[at - 1] not in limits:
                at -= 1
            inside = [k for k in range(at, len(open_)) if open_[k] in ended]
            if inside:
                while len(open_) > inside[0]:
                    yield closed()
        open_.append(tag)
        yield ("open", tag, key_of(tag, match[4])) if len(open_) <= DEEPEST else ("void", tag, "")
        if match[4].endswith("/") and tag not in INLINE and tag not in ENDS_P and tag not in ENDS:
            yield closed()
    while open_:
        yield closed()


@dataclass
class Node:
    """A wrapper's element, or the text slot ``#``: the pages that have it, the characters of text right in it and of that in
    links, the one text that all pages have there (a long one's digest; None once they differ), whether it repeats, and its children."""

    key: str
    seen: int = 1
    chars: int = 0
    links: int = 0
    text: str | None = None
    repeated: bool = False
    kids: list[Node] = field(default_factory=list)

    def packed(self) -> list:
        return [self.key, self.seen, self.chars, self.links, self.text, int(self.repeated), [k.packed() for k in self.kids]]

    @staticmethod
    def unpacked(row: list) -> Node:
        return Node(row[0], row[1], row[2], row[3], row[4], bool(row[5]), [Node.unpacked(k) for k in row[6]])


def fold(wrapper: Node, other: Node, same_page: bool = False) -> None:
    """Align ``other`` with ``wrapper`` and make the wrapper match both."""
    wrapper.chars += other.chars
    wrapper.links += other.links
    if same_page:
        wrapper.repeated = True
    else:
        wrapper.seen += other.seen
        wrapper.repeated |= other.repeated
    if wrapper.text != other.text:
        wrapper.text = None
    a, b = wrapper.kids, other.kids
    if not b:
        return
    if not a:
        wrapper.kids = b
        return
    if len(a) == len(b) and all(x.key == y.key for x, y in zip(a, b, strict=True)):
        for x, y in zip(a, b, strict=True):
            fold(x, y, same_page and False)
        return
    # Longest common subsequence of the children's keys; what one side lacks is optional.
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i].key == b[j].key else max(best[i + 1][j], best[i][j + 1])
    merged, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i].key == b[j].key:
            fold(a[i], b[j])
            merged.append(a[i])
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and best[i + 1][j] >= best[i][j + 1]:
            merged.append(a[i])
            i += 1
        else:
            merged.append(b[j])
            j += 1
    wrapper.kids = merged


def grouped(kids: list[Node]) -> list[Node]:
    """Runs of a pattern of one to three neighbours become one repeated group of it."""
    for size in (1, 2, 3):
        found: list[Node] = []
        for kid in kids:
            found.append(kid)
            if len(found) > size and all(found[-k].key == found[-k - size].key for k in range(1, size + 1) if len(found) >= k + size) and len(found) >= 2 * size:
                for k in range(size):
                    earlier, later = found[-2 * size + k], found[-size + k]
                    fold(earlier, later, same_page=True)
                del found[-size:]
        kids = found
    return kids


def page_tree(page: str) -> Node:
    """The tree of one page, repeated neighbours already folded."""
    root = Node("")
    path, links = [root], 0
    for kind, value, key in events(page):
        top = path[-1]
        if kind == "text":
            size = len(value) - value.count(" ")
            if size and not value.isspace():
                if top.kids and top.kids[-1].key == "#":
                    slot = top.kids[-1]
                    slot.text, slot.repeated = None, True
                else:
                    slot = Node("#", text=value if size <= 200 else hashlib.md5(value.encode("utf-8", "replace")).hexdigest())
                    top.kids.append(slot)
                slot.chars += size
                slot.links += size * (links > 0)
        elif kind == "open":
            node = Node(key)
            top.kids.append(node)
            path.append(node)
            links += value == "a"
        elif kind == "close":
            top.kids = grouped(top.kids) if len(top.kids) > 1 else top.kids
            path.pop()
            links -= value == "a"
    root.kids = grouped(root.kids)
    return root


def _mass(node: Node, pages: int) -> int:
    """Text outside boilerplate and links below a node; what many pages share word for word does not count."""
    if node.key == "#":
        return 0 if node.text and pages >= 5 and node.seen >= 0.9 * pages else node.chars - node.links
    return 0 if boilerplate(node.key) else sum(_mass(k, pages) for k in node.kids)


def dropped_keys(root: Node) -> list[str]:
    """The keys left to the wrapper whose elements are mostly links or text that the pages have in common."""
    totals: dict[str, list[int]] = {}
    differ = False

    def walk(node: Node, inside: tuple[str, ...]) -> None:
        nonlocal differ
        if node.key == "#":
            shared = node.text is not None and node.seen > 1
            differ |= node.text is None and not inside
            for key in inside:
                chars = totals.setdefault(key, [0, 0, 0])
                chars[0] += node.chars
                chars[1] += node.links
                chars[2] += node.chars - node.links if shared else 0
            return
        if _told(node.key)[0]:
            return
        if _told(node.key)[1] and node.key not in inside:
            inside = (*inside, node.key)
        for kid in node.kids:
            walk(kid, inside)

    walk(root, ())
    # Where the pages are one text throughout, what they share says nothing.
    return sorted(key for key, (all_, links, shared) in totals.items() if all_ and 2 * (links + (shared if differ else 0)) >= all_)


def main_path(root: Node) -> list[str]:
    """Keys from the root to the main element, [""] if that is the whole page; empty if the tree holds no text that counts."""
    pages, named, best = root.seen, None, (0, [])

    def walk(node: Node, path: list[str]) -> None:
        nonlocal named, best
        if node.key == "#" or boilerplate(node.key):
            return
        own = sum(k.chars - k.links for k in node.kids if k.key == "#") if node.key else 0
        inline = sum(_mass(k, pages) for k in node.kids if k.key.partition("|")[0] in INLINE or k.key.partition("|")[0] in ("p", "h1", "h2", "h3", "pre", "blockquote", "ul", "ol", "#"))
        score = max(inline, own if _mass(node, pages) else 0)
        if is_main(node.key) and _mass(node, pages) and named is None and 2 * node.seen >= pages:
            named = path
        if score > best[0] and node.key.partition("|")[0] not in INLINE and node.key.partition("|")[0] not in ("p", "li", "h1", "h2", "h3", "td"):
            best = (score, path or [""])
        for kid in node.kids:
            walk(kid, [*path, kid.key])

    walk(root, [])
    return named if named is not None else best[1]


def main_text(page: str, path: list[str], dropped: frozenset[str] = frozenset()) -> str | None:
    """Text of the elements at ``path``, boilerplate and dropped keys left out; None if the page has no such element."""
    keys: list[str] = []
    found, inside, skip = path == [""], -int(path == [""]), 0
    blocks: list[str] = []
    current: list[str] = []

    def flush() -> None:
        text = " ".join("".join(current).split())
        if text:
            blocks.append(text)
        current.clear()

    depth = len(path)
    for kind, value, key in events(page):
        if kind == "text":
            if inside and not skip:
                current.append(html.unescape(value) if "&" in value else value)
        elif kind == "open":
            keys.append(key)
            if inside:
                if skip or boilerplate(key, dropped):
                    if not skip:
                        flush()
                    skip += 1
                elif value not in INLINE:
                    flush()
            elif len(keys) == depth and keys == path:
                found, inside = True, depth
        elif kind == "close":
            keys.pop()
            if skip:
                skip -= 1
            elif inside:
                if value not in INLINE:
                    flush()
                if len(keys) < inside:
                    inside = 0
        elif inside and not skip:
            flush()
    flush()
    return " ".join(blocks) if found else None


def extract(page: str, path: list[str], dropped: frozenset[str] = frozenset()) -> str:
    text = main_text(page, path, dropped) if path else None
    if not text:
        tree = page_tree(page)
        own = main_path(tree)
        text = main_text(page, own, dropped or frozenset(dropped_keys(tree))) if own else None
    return text or ""


HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)"


def wrappers(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, wrapper, path, dropped): the wrapper of each host as JSON, the keys that lead to its main element, and those left out in it."""

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Node] = {}
        for batch in batches:
            for host, text in zip(batch.column("host").to_pylist(), batch.column("page").to_pylist(), strict=True):
                tree = page_tree(text)
                if host in known:
                    fold(known[host], tree)
                else:
                    known[host] = tree
        part = TaskContext.get().partitionId()
        rows = [json.dumps(known[h].packed(), ensure_ascii=False) for h in known]
        yield pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()), pa.array([part] * len(rows), pa.int64()), pa.array(rows, pa.string())], ["host", "part", "wrapper"])

    def merge(table: pa.Table) -> pa.Table:
        trees = [Node.unpacked(json.loads(w)) for w in table.sort_by("part").column("wrapper").to_pylist()]
        for tree in trees[1:]:
            fold(trees[0], tree)
        return pa.table({"host": table.column("host").slice(0, 1), "part": table.column("part").slice(0, 1), "wrapper": pa.array([json.dumps(trees[0].packed(), ensure_ascii=False)], pa.string())})

    def point(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [Node.unpacked(json.loads(w)) for w in batch.column("wrapper").to_pylist()]
            found = [pa.array([judge(t) for t in trees], pa.list_(pa.string())) for judge in (main_path, dropped_keys)]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("wrapper"), *found], ["host", "wrapper", "path", "dropped"])

    shape = "host string, part long, wrapper string"
    texts = pages.where(F.col(page).isNotNull()).select(_host(url).alias("host"), F.col(page).alias("page"))
    found = folded(texts.mapInArrow(infer, shape), ("host",), merge, shape, texts.rdd.getNumPartitions())
    return found.select("host", "wrapper").mapInArrow(point, "host string, wrapper string, path array<string>, dropped array<string>")


def _host(url: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), HOST, 1), F.lit("")))


def main_texts(pages: DataFrame, id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row of ``pages``.

    A null or empty page gives an empty text. Pages without a host (null or relative url) share a wrapper. Repeated
    rows each give their text. White space is what Unicode calls so; comments and markup that is never closed end
    with the page. Other columns are not read. An empty table gives an empty result.
    """
    found = cut(wrappers(pages, url, page).select("host", "path", "dropped"))
    rows = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(page), F.lit("")).alias("page"), _host(url).alias("of"))
    if found.count() <= HOSTS_TO_SEND:
        rows = rows.join(F.broadcast(found), F.col("of") == F.col("host"), "left")
    else:
        # A host's pages are spread over several tasks, each with a copy of its path.
        copies = found.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
        rows = rows.withColumn("at", F.pmod(F.xxhash64("id", "url", "page"), F.lit(COPIES)))
        rows = rows.join(copies, (F.col("of") == F.col("host")) & (F.col("at") == F.col("copy")), "left")
    rows = rows.select("id", "url", "page", *(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("path", "dropped")))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                columns = (part.column(c).to_pylist() for c in ("page", "path", "dropped"))
                out = [extract(p, k, frozenset(d)) if p else "" for p, k, d in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["id", "url", "text", "n_chars"])

    kind = pages.schema[id].dataType.simpleString()
    return rows.mapInArrow(texts, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id).withColumnRenamed("url", url)
