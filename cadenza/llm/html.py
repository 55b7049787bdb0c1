"""Main text of web pages by wrappers inferred from the pages of a host.

A page's token stream is read into nested groups. Pages of one host are aligned
one after another into a union-free regular expression: equal tags match, a
group that stands in some pages only becomes optional, texts that differ become
a slot, and neighbours of one kind fold into a repeated group, as does every
stretch between two of a kind: ``h2 p h2 p p`` is ``(h2? p+)+``. So a label
stands once in a row, and a wrapper grows with the kinds of groups of a host,
not with its pages. Tasks infer wrappers of their own rows and a second and
third step align those; no host's pages meet in one task.

The wrapper decides: the article is the group that holds the slots (the tags
``article`` and ``main`` name it where they hold any), and containers in it with
one text on most pages are template. Names of classes come last: they tell
comments and adverts, which vary as the article does, and the article of a host
with a single page. A page that lacks the host's group is read by itself.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import spread, table, written

#: A comment, a declaration, a whole tag, or the beginning of a tag whose quotes never close.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)(?:((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>)?", re.S)
_LOOSE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

#: Elements by what HTML makes of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object".split())
BLOCK = frozenset("address article blockquote body caption center dd details dialog div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody tfoot thead tr ul".split())
APART = frozenset("td th br".split())
LEFT_OUT = frozenset("head nav header footer aside form button select option input label script style noscript template textarea title svg math iframe object dialog menu".split())
NAMED_OUT = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner menu nav navbar navigation breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended notice notices cookie cookies consent alert popup modal newsletter subscribe signup share sharing social comment comments respond replies disqus pagination pager toolbar".split())
#: Only these give way to a name; headings, paragraphs, cells and inline elements never do.
NAMEABLE = frozenset("div section ul ol dl table details center".split())
#: A compound name counts by its head word: what follows it may be one of TAIL, and none of WITH stands in it.
TAIL = frozenset("area bar block box button buttons container form inner item items left link links list outer posts right row section wrap wrapper".split())
WITH = frozenset("with without has have no".split())
ENDS_P = BLOCK - {"body", "html", "caption", "dd", "dt", "li", "tbody", "tfoot", "thead", "tr"} | {"nav", "header", "footer", "aside", "form", "menu"}
CLOSES = {"li": ("li", frozenset(("ul", "ol", "menu"))), "dt": ("dt dd", frozenset(("dl",))), "dd": ("dt dd", frozenset(("dl",))), "tr": ("tr td th", frozenset(("table",))), "td": ("td th", frozenset(("tr", "table"))), "th": ("td th", frozenset(("tr", "table"))), "option": ("option", frozenset(("select",)))}
MAIN = frozenset("article main".split())
NAMED_MAIN = frozenset("article main content post entry story".split())
_RAW_END = {tag: re.compile(rf"</{tag}(?![^\s/>])[^>]*>?", re.I) for tag in RAW}
_OPENING = BLOCK | LEFT_OUT | APART | {""}
_INLINE_TOP = frozenset(("article", "section", "div", "main", "body", "td", "table", "blockquote", "nav", "header", "footer", "aside", "form"))


class Node:
    """label: tag and the names of its class, id and role, words of a name joined by '-'. text: of a text node."""

    __slots__ = ("children", "label", "tag", "text")

    def __init__(self, tag: str, label: str, text: str | None = None):
        self.tag, self.label, self.text, self.children = tag, label, text, []


def _label(tag: str, attributes: str) -> str:
    if not attributes:
        return tag
    names = []
    for m in _ATTRIBUTE.finditer(attributes):
        if m[2] and m[1].lower() in ("class", "id", "role"):
            for name in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", m[2].strip("\"'")).lower().split():
                names.append("-".join(re.findall(r"[a-z]+", name)))
    return ".".join([tag, *dict.fromkeys(filter(None, names))])



def parse(html: str) -> Node:
    """Nested groups of a page; end tags may be missing, misplaced or left over, and after a quote that never closes tags end at the next ``>``."""
    root = Node("", "")
    stack, at, token = [root], 0, _TOKEN

    def say(text: str) -> None:
        if text and not text.isspace():
            stack[-1].children.append(Node("#", "#", text))
        elif text and (stack[-1].children or stack[-1].tag not in _OPENING):  # white space parts words wherever no block begins
            stack[-1].children.append(Node(" ", " ", " "))

    last = len(html)
    while at < last and (m := token.search(html, at)):
        if m[2] and m[3] is None:
            # In loose reading every tag ends up to the last >, and no tag begins behind it.
            token, last = _LOOSE, html.rfind(">") + 1
            continue
        say(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in _INLINE_TOP and tag not in BLOCK and tag not in LEFT_OUT:
                    break  # a stray inline end tag ends no block
            continue
        if tag in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in _INLINE_TOP:
                    break
        if tag in CLOSES:
            ends, bar = CLOSES[tag][0].split(), CLOSES[tag][1]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in bar:
                    break
                if stack[k].tag in ends:
                    del stack[k:]
                    break
        node, closed = Node(tag, _label(tag, m[3])), m[3].endswith("/")
        stack[-1].children.append(node)
        if tag in RAW and not closed:
            # What a raw element holds is no markup: its own end tag comes next, or none does.
            end = _RAW_END[tag].search(html, at)
            at = end.end() if end else len(html)
        elif tag not in VOID and not closed:
            stack.append(node)
    say(html[at:])
    return root


# A wrapper node: [label, optional, repeated, letters, letters in links, text (of an element and a long text its digest)
# that all have or None, children, pages, shared]. shared: whether anything varies over the pages, then the texts that
# every page with the group has in it. A node labelled + is a repeated stretch of different groups.

#: Labels a row may tell apart; where a host has more, its groups go by their tags alone.
_LABELS = 64
#: Texts of the repeated groups of one page that are kept for comparison; where there are more, they count as varying.
_VALUES = 16


def _members(row: list[list]) -> list[list]:
    """The groups of a row, those of its stretches too."""
    return [m for n in row for m in (n[6] if n[0] == "+" else (n,))]


def _plain(row: list[list]) -> list[list]:
    """The row with labels cut to their tags."""
    return [[*n[:6], _plain(n[6]), *n[7:]] if n[0] == "+" else [n[0].split(".")[0] + (".*" if n[0] not in ("#", "+") else ""), *n[1:]] for n in row]


def _row(items: list[list], marks: list[tuple], within: bool) -> list[list]:
    """A row in which each label stands once: stretches between two of a label, or held together by a mark, become one group."""
    last: dict = {}
    for k, (n, own) in enumerate(zip(items, marks, strict=True)):
        for x in (n[0], *own):
            last[x] = k
    if len(last) == len(items) and not any(marks):
        return items
    out: list[list] = []
    lo = 0
    while lo < len(items):
        hi, k = lo, lo
        while k <= hi:
            hi = max(hi, *(last[x] for x in (items[k][0], *marks[k])))
            k += 1
        kinds: dict[str, list] = {}
        for n in items[lo : hi + 1]:
            kinds[n[0]] = _meet(kinds[n[0]], n, within, within) if n[0] in kinds else n
        nodes = list(kinds.values())
        if len(nodes) == 1:
            out += nodes
        else:
            nodes = [[n[0], True, *n[2:]] for n in nodes]
            out.append(["+", False, True, sum(n[3] for n in nodes), sum(n[4] for n in nodes), None, nodes, max(n[7] for n in nodes), [any(n[8][0] for n in nodes)]])
        lo = hi + 1
    return out


def _meet(a: list, b: list, within: bool = False, again: bool = False) -> list:
    """Two groups of one page (``within``), or of different pages, as one; ``again``: they stand beside each other."""
    x, y = set(a[8][1:]), set(b[8][1:])
    if x == y:
        shared = [a[8][0] or b[8][0], *a[8][1:]]
    elif not within:
        shared = [True, *sorted(x & y)]
    else:
        shared = [a[8][0] or b[8][0], *sorted(x | y)] if len(x | y) <= _VALUES else [True]
    return [a[0], a[1] or b[1], again or a[2] or b[2], a[3] + b[3], a[4] + b[4], a[5] if a[5] == b[5] else None, align(a[6], b[6], within), max(a[7], b[7]) if within else a[7] + b[7], shared]


def _marked(row: list[list], side: str) -> tuple[list[list], list[tuple]]:
    items, marks = [], []
    for k, n in enumerate(row):
        own = n[6] if n[0] == "+" else [n]
        items += own
        marks += [((side, k),) if n[0] == "+" else ()] * len(own)
    return items, marks


def align(a: list[list], b: list[list], within: bool = False) -> list[list]:
    """Common expression of two rows: the longest common row of groups matches, all others become optional."""
    if [n[0] for n in a] == [n[0] for n in b] and not any(n[0] == "+" for n in a):
        return [_meet(x, y, within) for x, y in zip(a, b, strict=True)]
    labels = {n[0] for row in (a, b) for n in _members(row)}
    if len(labels) > _LABELS or any(x.endswith(".*") for x in labels):
        a, b = (_row(*_marked(_plain(row), "p"), within=True) for row in (a, b))
    (x, mx), (y, my) = _marked(a, "a"), _marked(b, "b")
    n, m = len(x), len(y)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i][0] == y[j][0] else max(best[i + 1][j], best[i][j + 1])
    items, marks, i, j = [], [], 0, 0
    while i < n or j < m:
        if i < n and j < m and x[i][0] == y[j][0]:
            items.append(_meet(x[i], y[j], within))
            marks.append(mx[i] + my[j])
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            items.append([x[i][0], True, *x[i][2:]])
            marks.append(mx[i])
            i += 1
        else:
            items.append([y[j][0], True, *y[j][2:]])
            marks.append(my[j])
            j += 1
    return _row(items, marks, within)


def _digest(shared: str) -> str:
    return "\0" + hashlib.blake2b(shared.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def expression(node: Node, link: bool = False) -> list:
    """A single page's expression."""
    if node.text is not None:
        size = len(node.text.strip())
        text = node.text if size <= 80 else _digest(node.text)
        return [node.label, False, False, size, size if link else 0, text, [], 1, [False, text]]
    link = link or node.tag == "a"
    kids = [expression(c, link) for c in node.children if c.label != " "]
    own = _digest("\1".join(f"{k[0]}\2{k[5]}" for k in kids))
    kids = _row(kids, [()] * len(kids), within=True)
    return [node.label, False, False, sum(k[3] for k in kids), sum(k[4] for k in kids), own, kids, 1, [False, own]]


def pattern(wrapper: list) -> str:
    """The expression as text: ``(...)?`` optional, ``(...)+`` repeated, ``#`` a slot, shared texts as they are."""
    label, optional, repeated, _, _, shared, kids, *_ = wrapper
    inner = "".join(map(pattern, kids))
    own = (shared or "#") if label == "#" else f"<{label}>{inner}</{label}>" if label not in ("", "+") else inner
    return f"({own})" + ("*" if optional and repeated else "+" if repeated else "?") if optional or repeated else own


def _named_out(name: str) -> bool:
    if name in NAMED_OUT:
        return True
    words = name.split("-")
    if len(words) == 1 or not WITH.isdisjoint(words):
        return False
    while len(words) > 1 and words[-1] in TAIL:
        words.pop()
    # The header of a part may hold its title.
    return words[-1] in NAMED_OUT and words[-1] != "header"


def _words(label: str) -> set[str]:
    return {w for name in label.split(".")[1:] for w in name.split("-")}


@lru_cache(1 << 16)
def _out(label: str) -> bool:
    tag, *names = label.split(".")
    return tag in LEFT_OUT or ((tag in NAMEABLE or "-" in tag) and any(map(_named_out, names)))


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Tree:
    """What the search for the article asks of a host's wrapper or of one page.

    slots: letters of a group outside links that vary over the pages, all where
    there is one page; ``named`` without those in containers whose names tell
    them apart, ``slots`` with them. headed: groups that hold a heading.
    """

    def __init__(self, root, kids, label, own, several: bool):
        self.root, self.kids, self.label, self.several = root, kids, label, several
        self.slots: dict[int, int] = {}
        self.named: dict[int, int] = {}
        self.headed: set[int] = set()
        order, work = [], [(root, True, True)]
        while work:
            n, counts, well = work.pop()
            counts = counts and self.tag(n) != "a" and self.tag(n) not in LEFT_OUT
            well = well and counts and not _out(label(n))
            order.append(n)
            self.slots[id(n)] = own(n) if counts else 0
            self.named[id(n)] = own(n) if well else 0
            work += [(k, counts, well) for k in kids(n)]
        for n in reversed(order):
            for k in kids(n):
                for sums in (self.slots, self.named):
                    sums[id(n)] += sums[id(k)]
                if id(k) in self.headed or (self.tag(k) in _HEADINGS and self.named[id(k)]):
                    self.headed.add(id(n))

    @classmethod
    def of(cls, wrapper: list) -> Tree:
        several = wrapper[7] > 1
        return cls(wrapper, lambda n: _members(n[6]), lambda n: n[0], lambda n: n[3] if n[0] == "#" and (n[8][0] or not several) else 0, several)

    @classmethod
    def page(cls, root: Node) -> Tree:
        return cls(root, lambda n: n.children, lambda n: n.label, lambda n: len(n.text.strip()) if n.text else 0, False)

    def tag(self, n) -> str:
        return self.label(n).split(".")[0]

    def search(self, wanted, out) -> list[str] | None:
        """Labels that lead to the first group that is wanted, level by level."""
        level: list[tuple] = [(self.root, None)]
        while level:
            after = []
            for n, path in level:
                for k in self.kids(n):
                    if self.tag(k) not in ("#", " ") and not out(self.label(k)):
                        if wanted(k):
                            return _labels((path, self.label(k)))
                        after.append((k, (path, self.label(k))))
            level = after
        return None

    def descend(self) -> list[str] | None:
        """Down to the smallest single group that holds most slots, as long as no heading or paragraph stands beside it."""
        node, path, named = self.root, None, self.named
        while True:
            kids = [k for k in self.kids(node) if named[id(k)]]
            top = max((k for k in kids if self.tag(k) in _HOLDS), key=lambda k: named[id(k)], default=None)
            if top is None or (isinstance(top, list) and top[2]) or sum(self.label(k) == self.label(top) for k in kids) > 1:
                break
            if named[id(top)] < (0.7 if NAMED_MAIN.isdisjoint(_words(self.label(top))) else 0.5) * named[id(node)]:
                break
            if any(k is not top and (self.tag(k) == "p" or self.tag(k) in _HEADINGS or id(k) in self.headed) for k in kids):
                break
            node, path = top, (path, self.label(top))
        return _labels(path) or None


#: Groups an article may be the inside of.
_HOLDS = BLOCK - _HEADINGS - frozenset("p ul ol li dl table".split()) | {"td"}


def _labels(path: tuple | None) -> list[str]:
    out = []
    while path:
        path, label = path
        out.append(label)
    return out[::-1]


def article_path(tree: Tree) -> list[str] | None:
    """Labels from the root to the group that holds the article."""
    whole = tree.slots[id(tree.root)]
    for tag in ("article", "main"):
        # Where the pages are one and the same nothing varies, and the tag alone tells.
        if path := tree.search(lambda n, t=tag: tree.tag(n) == t and (tree.named[id(n)] or not whole), _out):
            return path
    # A container of any name stays if it holds the article, which is more than a teaser.
    for tag in ("article", "main"):
        if path := tree.search(lambda n, t=tag: tree.tag(n) == t and 2 * tree.slots[id(n)] >= whole, lambda label: label.split(".")[0] in LEFT_OUT):
            return path
    if not tree.several:  # nothing shows what varies: a name tells
        if path := tree.search(lambda n: tree.tag(n) in ("div", "section", "td") and not NAMED_MAIN.isdisjoint(_words(tree.label(n))) and 2 * tree.named[id(n)] > tree.named[id(tree.root)], _out):
            return path
    return tree.descend()


def constants(wrapper: list, path: list[str] | None) -> frozenset[tuple[str, str]]:
    """Label and digest of the containers in the article that most pages of the host have with one text.

    None where the article itself is the same on all pages, and none that holds
    half of its letters: pages that repeat each other lose no text by this.
    """
    level = [wrapper]
    for label in path or []:
        level = [k for n in level for k in _members(n[6]) if k[0] == label]
    found = set()
    for top in level:
        work = top[6][:] if top[8][0] else []
        while work:
            n = work.pop()
            if n[7] > 1 and 2 * n[7] > top[7] and 2 * n[3] < top[3] and n[3] and n[0].split(".")[0] in NAMEABLE:
                found |= {(n[0], text) for text in n[8][1:]}
            if n[8][0]:
                work += n[6]
    return frozenset(found)


def _at(root: Node, path: list[str]) -> list[Node]:
    level = [root]
    for label in path:
        level = [c for n in level for c in n.children if label in (c.label, c.tag + ".*")]
    return level


def blocks(nodes: list[Node], same: frozenset[tuple[str, str]] = frozenset()) -> list[str]:
    """Texts of the blocks below, in order, without what is left out and containers that are the ``same`` on a host."""
    labels = {label for label, _ in same}

    def constant(n: Node) -> bool:
        own = labels.intersection((n.label, n.tag + ".*"))
        return bool(own) and not same.isdisjoint((label, _bounded(n)[5]) for label in own)

    out: list[str] = []
    held: list[str] = []

    def close() -> None:
        if text := " ".join(unescape("".join(held)).split()):
            out.append(text)
        held.clear()

    # A stack instead of recursion: pages may nest deeply.
    stack: list = [n for n in reversed(nodes)]
    while stack:
        n = stack.pop()
        if n is None:
            close()
        elif n.text is not None:
            held.append(n.text)
        elif _out(n.label) or (labels and constant(n)):
            continue
        elif n.tag in BLOCK:
            close()
            stack += [None, *reversed(n.children)]
        else:
            if n.tag in APART:
                held.append(" ")
            stack += reversed(n.children)
    close()
    return out


def main_text(html: str | None, path: list[str] | None, same: frozenset[tuple[str, str]] = frozenset()) -> str:
    """The article's blocks joined by line feeds; ``path`` is the host's, tried first; ``same`` its constant containers."""
    if not html:
        return ""
    root = parse(html)
    found = _at(root, path) if path else []
    if not found:
        own = article_path(Tree.page(root))
        found = _at(root, own) if own else [root]
    return "\n".join(blocks(found, same))


def _bounded(root: Node, depth: int = 200) -> list:
    """Expression of a page for its host's wrapper, down to ``depth``; a page whose article is deeper is read by itself, whole."""
    return expression(root if _depth(root) <= depth else _shallow(root, depth))


def _depth(root: Node) -> int:
    most, work = 0, [(root, 1)]
    while work:
        n, d = work.pop()
        most = max(most, d)
        work += [(c, d + 1) for c in n.children]
    return most


def _shallow(root: Node, depth: int) -> Node:
    def copy(n: Node, d: int) -> Node:
        out = Node(n.tag, n.label, n.text)
        if d < depth:
            out.children = [copy(c, d + 1) for c in n.children]
        return out

    return copy(root, 1)


def host(url: Column) -> Column:
    """Lower-case host of a URL, empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _infer(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId() % 64
    own: dict[str, list] = {}
    for batch in it:
        for h, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if html:
                x = _bounded(parse(html))
                own[h] = _meet(own[h], x) if h in own else x
        if len(own) > 20_000:
            yield _rows(own, part)
            own = {}
    if own:
        yield _rows(own, part)


def _rows(own: dict[str, list], part: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array([part] * len(own), pa.int32()), pa.array([json.dumps(w) for w in own.values()], pa.string())], names=["host", "part", "wrapper"])


def _joined(key: tuple, t: pa.Table) -> pa.Table:
    out = None
    for x in sorted(t.column("wrapper").to_pylist()):
        w = json.loads(x)
        out = w if out is None else _meet(out, w)
    return pa.table({"host": [key[0].as_py()], "part": pa.array([0], pa.int32()), "wrapper": [json.dumps(out)]})


def wrappers(pages: DataFrame) -> DataFrame:
    """``host, wrapper`` (JSON) inferred from all ``pages`` (``url, html``)."""
    schema = "host string, part int, wrapper string"
    parts = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(_infer, schema)
    for keys in (("host", "part"), ("host",)):
        parts = parts.groupBy(*keys).applyInArrow(_joined, schema)
    return parts.select("host", "wrapper")


def _extract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    read: dict[str | None, tuple] = {None: (None, frozenset())}
    for batch in it:
        texts = []
        for html, w in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
            if w not in read:
                if len(read) > 10_000:
                    read = {None: (None, frozenset())}
                path = article_path(Tree.of(x := json.loads(w)))
                read[w] = path, constants(x, path)
            texts.append(main_text(html, *read[w]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of ``pages`` (``page_id, url, html``).

    A null or empty html has an empty text, as has one of which nothing is left
    without menus and the like; a page without an article is one as a whole.
    Null urls, and those without a host, are read as pages of one host. Repeated rows and null ids give a row each, an
    empty table an empty result; other columns are ignored.
    """
    pages = spread(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host(F.col("url")).alias("host"))
    known = written(wrappers(pages), "wrappers")  # its size is known then: Spark sends it to all tasks only if it is small
    return pages.join(known, "host", "left").select("page_id", "url", "html", "wrapper").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op6_html_text(spark, sf_dir: str) -> DataFrame:
    """Main text of the whole ``pages`` table."""
    return extract(table(spark, sf_dir, "pages"))
