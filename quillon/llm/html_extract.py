"""Main text of web pages through wrappers: union-free regular expressions inferred per host.

A page is read leniently into a tree of labels (tag and telling class, id or role words) with text slots.
A wrapper is such a tree whose children form a union-free expression: each child is there once,
optionally (?), repeatedly (+) or both (*), and runs of several labels that repeat form a group. Wrappers
of the same host are aligned child list by child list along their longest common subsequence (of lists too
long for that, a common subsequence found in one pass); what matches is merged, a mismatch becomes an optional child, and neighbours that repeat fold into repeated groups. The
order of merging is a tree: distinct page skeletons per host, then per host and salt, then per host, so a host
with a third of all pages never meets in one task.

Evidence of the slots: every page is matched to its host's wrapper, and each text slot keeps what it holds
on a page, all its repeats together. A slot that holds the same on all pages that have it, at least two
that differ, is template; what varies is content. Copies of one page are no evidence.

Main text lies below the article (article, main or a telling word) and not in menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles or reader comments. Below an article the labels decide,
and all text is kept: a heading or passage that a host's pages share there is content still. On a page
without an article the wrapper decides: template slots are left out, unless nothing else is left. A node
that the wrapper lacks is marked by its own label.

Text: character references decoded, white space within a block as one space, trimmed, blocks joined by \\n.
Tags are read as HTML reads them: a quote is one only where an attribute's value begins; one that is
never closed ends with its tag. Nesting may be as deep as memory allows: what recurs does so in Python frames.

Defined results: null, empty and text-free pages give an empty text; a null or odd URL is a host of its
own (the empty one); repeated rows and null page identifiers each get a row; an empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import json
import re
import sys
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._common import written

# HTML element kinds and the words that tell what a part of a page is for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe xmp svg math object".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("html body td th tr tbody thead tfoot caption legend".split())
ENDS_P_CLOSING = tuple("article section div td th li blockquote body main".split())
ENDS_P = (*ENDS_P_CLOSING, *"aside nav header footer form button".split())
SIBLINGS = {  # what an opening tag closes, and where the search for it ends
    tag: (tuple(closed.split()), tuple(ends.split()))
    for tags, closed, ends in (("li", "li", "ul ol menu"), ("dt dd", "dt dd", "dl"), ("td th", "td th", "tr table"), ("tr", "tr", "table"), ("tbody thead tfoot", "tbody thead tfoot", "table"), ("option", "option", "select"))
    for tag in tags.split()
}
NOT_MAIN = frozenset("head title nav menu footer aside form button select input label dialog script style noscript template iframe textarea svg math object".split())
MAIN = frozenset("article main".split())
MAIN_WORDS = frozenset("article main content post entry story".split())
NOT_MAIN_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs footer sidebar aside widget cookie cookies consent gdpr notice notices alert popup modal overlay "
    "comment comments commentlist disqus reply replies respond discussion share sharing social related recommended newsletter subscribe signup login search form pagination pager skip toolbar copyright masthead topbar".split()
)
TELLING = MAIN_WORDS | NOT_MAIN_WORDS | {"header", "complementary", "contentinfo"}
LONGEST_GROUP = 4  # labels that a run is looked for; longer groups stay unfolded, which costs length, not text
CELLS = 100_000  # of the table for a longest common subsequence

_VALUE = r"""(?:"([^"]*+)"|'([^']*+)'|((?:[^\s>"'][^\s>]*+|["'][^>]*+)?+))"""
_ATTRIBUTE = rf"(=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+{_VALUE})?+"
_TAG = rf"<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[\s/]++|{_ATTRIBUTE})*+)(?:>|\Z)"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|{_TAG}", re.S)
_ATTRIBUTES = re.compile(_ATTRIBUTE)


def deep() -> None:
    """Lets Python functions call themselves as deeply as pages are nested; frames of Python code live on the heap."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 4_000_000))


class Node:
    __slots__ = ("tag", "label", "kids")

    def __init__(self, tag: str, label: str):
        self.tag, self.label, self.kids = tag, label, []


def _label(tag: str, attributes: str) -> str:
    if "=" not in attributes:
        return tag
    words = {w for m in _ATTRIBUTES.finditer(attributes) if m[1].lower() in ("class", "id", "role") for w in re.split(r"[\s_-]+", (m[2] or m[3] or m[4] or "").lower())}
    if "hidden" in words:
        words.add("notice")
    return ".".join([tag, *sorted(words & TELLING)])


class _Open:
    """The open nodes, and where each tag is open, so that closing never searches through them."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def last(self, tags: tuple[str, ...] | frozenset[str]) -> int:
        return max([p[-1] for t in tags if (p := self.places.get(t))], default=0)

    def pop_to(self, tags: tuple[str, ...], barriers: tuple[str, ...] | frozenset[str] = ()) -> None:
        """Closes the innermost of tags and all within, if no barrier stands before it."""
        if (at := self.last(tags)) and at >= self.last(barriers):
            for node in self.nodes[at:]:
                self.places[node.tag].pop()
            del self.nodes[at:]


def parse(page: str) -> Node:
    """A tree of nodes and texts; never fails, whatever the page holds."""
    root = Node("", "")
    stack = _Open(root)
    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None or m.start() > at:
            stack.nodes[-1].kids.append(page[at : m.start() if m else len(page)])
        if m is None:
            break
        at, tag = m.end(), (m["tag"] or "").lower()
        if not tag:
            continue
        if m["close"]:
            if tag in BLOCK and tag != "p":
                stack.pop_to((tag,))
            elif tag == "p":
                stack.pop_to(("p",), ENDS_P_CLOSING)
            else:
                stack.pop_to((tag,), BLOCK)
            continue
        if tag in CLOSES_P:
            stack.pop_to(("p",), ENDS_P)
        if tag in SIBLINGS:
            closed, ends = SIBLINGS[tag]
            stack.pop_to(closed, ends)
        if tag == "body" or tag == "html":
            stack.pop_to(("head",))
        node = Node(tag, _label(tag, m["rest"] or ""))
        stack.nodes[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not (m["rest"] or "").rstrip().endswith("/"):
            stack.push(node)
    return root


# A wrapper: [label, how often, children]; how often is "", "?", "+" or "*"; a group's label is "()"; a text slot's is "#".


def _often(a: str, b: str, optional: bool = False) -> str:
    many = a in ("+", "*") or b in ("+", "*")
    optional = optional or a in ("?", "*") or b in ("?", "*")
    return "*" if many and optional else "+" if many else "?" if optional else ""


def _key(w: list) -> str:
    return w[0] if w[0] != "()" else "(" + " ".join(_key(x) for x in w[2]) + ")"


def _aligned(a: list[str], b: list[str]) -> list[tuple[int | None, int | None]]:
    """Pairs of places along a longest common subsequence, and the places left over, in order."""
    pre = 0
    while pre < min(len(a), len(b)) and a[pre] == b[pre]:
        pre += 1
    end = 0
    while end < min(len(a), len(b)) - pre and a[-1 - end] == b[-1 - end]:
        end += 1
    x, y = a[pre : len(a) - end], b[pre : len(b) - end]
    if len(x) * len(y) > CELLS:
        return [(k, k) for k in range(pre)] + _in_one_pass(x, y, pre) + [(len(a) - end + k, len(b) - end + k) for k in range(end)]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    out: list[tuple[int | None, int | None]] = [(k, k) for k in range(pre)]
    i = j = 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            out.append((pre + i, pre + j))
            i, j = i + 1, j + 1
        elif j == len(y) or (i < len(x) and best[i + 1][j] >= best[i][j + 1]):
            out.append((pre + i, None))
            i += 1
        else:
            out.append((None, pre + j))
            j += 1
    return out + [(len(a) - end + k, len(b) - end + k) for k in range(end)]


def _in_one_pass(x: list[str], y: list[str], pre: int) -> list[tuple[int | None, int | None]]:
    """The same along a common subsequence that takes the next match there is, if it isn't far ahead."""
    places: dict[str, list[int]] = {}
    for j, w in enumerate(y):
        places.setdefault(w, []).append(j)
    out: list[tuple[int | None, int | None]] = []
    upto = 0
    for i, w in enumerate(x):
        own = places.get(w, ())
        k = bisect_left(own, upto)
        if k < len(own) and own[k] - upto <= 64:
            out += [(None, pre + j) for j in range(upto, own[k])]
            out.append((pre + i, pre + own[k]))
            upto = own[k] + 1
        else:
            out.append((pre + i, None))
    return out + [(None, pre + j) for j in range(upto, len(y))]


def _same(a: list, b: list) -> bool:
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        if x is not y:
            if len(x) != len(y):
                return False
            for u, v in zip(x, y, strict=True):
                if u[:2] != v[:2]:
                    return False
                todo.append((u[2], v[2]))
    return True


def dumps(w: list) -> str:
    """A wrapper as flat JSON: label, how often and number of children of each node, parents first."""
    out, todo = [], [w]
    while todo:
        x = todo.pop()
        out += [x[0], x[1], len(x[2])]
        todo.extend(reversed(x[2]))
    return json.dumps(out, separators=(",", ":"))


def loads(text: str) -> list:
    flat, above = json.loads(text), []
    root = [flat[0], flat[1], []]
    open_ = [(root, flat[2])]
    for k in range(3, len(flat), 3):
        while not open_[-1][1]:
            open_.pop()
        above, left = open_[-1]
        open_[-1] = (above, left - 1)
        node = [flat[k], flat[k + 1], []]
        above[2].append(node)
        open_.append((node, flat[k + 2]))
    return root


def merge(a: list, b: list) -> list:
    """The wrapper of two that share a label."""
    return [a[0], _often(a[1], b[1]), merge_lists(a[2], b[2])]


def merge_lists(a: list, b: list) -> list:
    if _same(a, b):
        return a
    out = []
    for i, j in _aligned([_key(x) for x in a], [_key(x) for x in b]):
        if i is not None and j is not None:
            out.append(merge(a[i], b[j]))
        else:
            w = a[i] if i is not None else b[j]
            out.append([w[0], _often(w[1], "", True), w[2]])
    return fold(out)


def fold(row: list) -> list:
    """Repeated groups in place of runs that repeat: of one label first, then of up to LONGEST_GROUP."""
    out: list = []
    for w in row:
        if out and _key(out[-1]) == _key(w):
            must = out[-1][1] in ("", "+") or w[1] in ("", "+")
            out[-1] = [w[0], "+" if must else "*", merge_lists(out[-1][2], w[2])]
        else:
            out.append(w)
    for size in range(2, LONGEST_GROUP + 1):
        i = 0
        while i + 2 * size <= len(out):
            keys = [_key(x) for x in out[i : i + 2 * size]]
            if keys[:size] == keys[size:] and "#" not in keys:
                group, k = out[i : i + size], i + size
                while k + size <= len(out) and [_key(x) for x in out[k : k + size]] == keys[:size]:
                    group = [merge(x, y) for x, y in zip(group, out[k : k + size], strict=True)]
                    k += size
                out[i:k] = [["()", "+", group]]
            i += 1
    return out


def skeleton(node: Node) -> list:
    """The wrapper of one page."""
    kids = []
    for x in node.kids:
        if isinstance(x, Node):
            kids.append(skeleton(x))
        elif x.strip():
            kids.append(["#", "", []])
    return [node.label, "", fold(kids)]


def _marks(label: str, inside: bool, main: bool) -> tuple[bool, bool]:
    """If a node's texts can be main text, and if it lies below the article, given the same of its parent."""
    tag, *words = label.split(".")
    bad = tag in NOT_MAIN or bool(NOT_MAIN_WORDS.intersection(words)) and tag not in ("html", "body") or bool({"complementary", "contentinfo"}.intersection(words))
    bad = bad or not main and (tag == "header" or "header" in words)
    good = tag in MAIN or bool(MAIN_WORDS.intersection(words)) and tag not in ("html", "body", "a", "span", "li", "h1", "h2", "h3")
    return inside and not bad, main or good and inside and not bad


def _flat(kids: list) -> list:
    """Children with the members of groups in the place of groups."""
    return [x for w in kids for x in (_flat(w[2]) if w[0] == "()" else [w])]


class Wrapper:
    """A host's wrapper ready to match pages; template: the numbers, in document order, of its slots that hold template text."""

    def __init__(self, tree: list, template: list[int] | None = None):
        deep()
        self.tree = tree
        self.memo: dict[tuple, list] = {}
        self.slots: dict[int, int] = {}
        self._number(tree)
        self.template = frozenset(template or [])

    def _number(self, w: list) -> None:
        if w[0] == "#":
            self.slots.setdefault(id(w), len(self.slots))
        for x in w[2]:
            self._number(x)

    def _places(self, kids: list, labels: tuple[str, ...]) -> list:
        """Of each label in a row, the wrapper's child that it matches, or None; repeated children take a run."""
        key = (id(kids), labels)
        if (got := self.memo.get(key)) is None:
            flat = _flat(kids)
            by: dict[str, list] = {}
            for x in flat:
                by.setdefault(x[0], []).append(x)
            runs = [k for k, x in enumerate(labels) if k == 0 or labels[k - 1] != x]
            pairs = dict((j, i) for i, j in _aligned([x[0] for x in flat], [labels[k] for k in runs]) if i is not None and j is not None)
            got = []
            for r, k in enumerate(runs):
                w = flat[pairs[r]] if r in pairs else next(iter(by.get(labels[k], [])), None)
                got += [w] * ((runs[r + 1] if r + 1 < len(runs) else len(labels)) - k)
            if len(self.memo) < 10_000:
                self.memo[key] = got
        return got

    def _texts(self, page: str) -> tuple[list[tuple[str | None, int | None, bool, bool]], bool]:
        """A page's texts in order, with slot, if they can be main text and if they lie below the article; None as text ends a block. And if the page has an article."""
        own, out = parse(page), []

        def walk(node: Node, w: list | None, inside: bool, main: bool) -> bool:
            if node.label:
                inside, main = _marks(node.label, inside, main)
            found = main
            if node.tag in BLOCK:
                out.append((None, None, False, False))
            if node.tag == "br":
                out.append((" ", None, inside, main))
            labels = tuple([x.label if isinstance(x, Node) else "#" for x in node.kids if isinstance(x, Node) or x.strip()])
            places = iter(self._places(w[2], labels) if w else [None] * len(labels))
            for x in node.kids:
                if isinstance(x, Node):
                    found = walk(x, next(places), inside, main) or found
                else:
                    slot = next(places) if x.strip() else None
                    out.append((x, self.slots[id(slot)] if slot else None, inside, main))
            if node.tag in BLOCK:
                out.append((None, None, False, False))
            return found

        return out, walk(own, self.tree, True, False)

    def held(self, page: str) -> dict[int, list[str]]:
        """What each slot holds on a page."""
        found: dict[int, list[str]] = {}
        for x, slot, _, _ in self._texts(page)[0]:
            if slot is not None:
                found.setdefault(slot, []).append(x.strip())
        return found

    def text(self, page: str) -> str:
        texts, anchored = self._texts(page)

        def joined(left_out: frozenset[int]) -> str:
            blocks: list[list[str]] = [[]]
            for x, slot, inside, main in texts:
                if x is None:
                    blocks.append([])
                elif inside and (main or not anchored) and slot not in left_out:
                    blocks[-1].append(x)
            lines = (" ".join(htmllib.unescape("".join(b)).split()) for b in blocks)
            return "\n".join(x for x in lines if x)

        return joined(frozenset()) if anchored else joined(self.template) or joined(frozenset())


def _fold_hosts(parsed: bool):
    """Folds the wrappers of each host in a partition to one. parsed: the rows hold pages still."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deep()
        found: dict[str, list] = {}
        seen: dict[str, set[int]] = {}
        for batch in batches:
            for host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = loads(text) if parsed else skeleton(parse(text or ""))
                if not parsed:
                    known = seen.setdefault(host, set())
                    if (h := hash(dumps(w))) in known:
                        continue
                    if len(known) < 1000:
                        known.add(h)
                found[host] = merge(found[host], w) if host in found else w
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array([dumps(w) for w in found.values()])], names=["host", "wrapper"])

    return run


def _rows(pages: DataFrame, page_col: str, url_col: str, html_col: str) -> DataFrame:
    url = F.col(url_col).cast("string")
    host = F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    return pages.select(F.col(page_col).cast("bigint").alias("page_id"), url.alias("url"), host.alias("host"), F.col(html_col).cast("string").alias("html"))


def _with_wrappers(rows: DataFrame, wrappers: DataFrame, broadcast_bytes: int) -> DataFrame:
    """Pages with their host's wrapper, broadcast if all hold at most broadcast_bytes, which is counted first, else joined by host."""
    size = wrappers.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    side = wrappers.withColumnRenamed("host", "w_host")
    return rows.join(F.broadcast(side) if size <= broadcast_bytes else side, F.col("host") == F.col("w_host")).drop("w_host")


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each host and slot in a partition, the least and greatest digest of what it held and of the pages that had it."""
    ready: dict[str, Wrapper] = {}
    found: dict[tuple[str, int], list[str]] = {}
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            for host, page, wrapper in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                if wrapper not in ready:
                    if len(ready) >= 256:
                        ready.clear()
                    ready[wrapper] = Wrapper(loads(wrapper))
                whole = None
                for slot, texts in ready[wrapper].held(page or "").items():
                    e = found.get((host, slot))
                    if e is not None and e[0] != e[1]:
                        continue  # varies
                    whole, own = whole or _digest(page), _digest("\0".join(texts))
                    if e is None:
                        found[host, slot] = [own, own, whole, whole]
                    else:
                        e[:] = min(e[0], own), max(e[1], own), min(e[2], whole), max(e[3], whole)
    if found:
        columns = [pa.array([h for h, _ in found]), pa.array([k for _, k in found], pa.int32()), *[pa.array([e[k] for e in found.values()]) for k in range(4)]]
        yield pa.RecordBatch.from_arrays(columns, names=["host", "slot", "low", "high", "low_page", "high_page"])


def infer_wrappers(pages: DataFrame, *, salts: int = 16, broadcast_bytes: int = 16 << 20, page_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, wrapper (JSON) and template (numbers of its template slots) of each host, written to the shared folder."""
    schema = "host string, wrapper string"
    rows = _rows(pages, page_col, url_col, html_col).select("host", "html")
    own = rows.mapInArrow(_fold_hosts(False), schema).distinct()
    salted = own.repartition("host", F.pmod(F.xxhash64("wrapper"), F.lit(salts))).mapInArrow(_fold_hosts(True), schema)
    ordered = written(salted.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(_fold_hosts(True), schema), "wrappers")
    seen = _with_wrappers(rows, ordered, broadcast_bytes).select("host", "html", "wrapper").mapInArrow(_evidence, "host string, slot int, low string, high string, low_page string, high_page string")
    slots = seen.groupBy("host", "slot").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("low_page").alias("low_page"), F.max("high_page").alias("high_page"))
    template = slots.where("low = high AND low_page <> high_page").groupBy("host").agg(F.sort_array(F.collect_list("slot")).alias("template"))
    return written(ordered.join(template, "host", "left"), "wrappers")


def _extract():
    schema = "page_id bigint, url string, text string, n_chars bigint, host string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[tuple, Wrapper] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, texts = batch.slice(lo, 256), []
                for page, wrapper, template in zip(*(part.column(k).to_pylist() for k in (3, 4, 5)), strict=True):
                    key = (wrapper, tuple(template or ()))
                    if key not in ready:
                        if len(ready) >= 256:
                            ready.clear()
                        ready[key] = Wrapper(loads(wrapper), template)
                    texts.append(ready[key].text(page or ""))
                if texts:
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts), pa.array([len(x) for x in texts], pa.int64()), part.column(2)], names=["page_id", "url", "text", "n_chars", "host"])

    return run, schema


def extract(pages: DataFrame, wrappers: DataFrame | None = None, *, broadcast_bytes: int = 16 << 20, page_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """page_id, url, text, n_chars and host of every page.

    wrappers: of all hosts in pages, by default inferred from them. They are broadcast if they hold at most
    broadcast_bytes in all, which is counted first, else joined by host.
    """
    columns = {"page_col": page_col, "url_col": url_col, "html_col": html_col}
    wrappers = infer_wrappers(pages, broadcast_bytes=broadcast_bytes, **columns, **options) if wrappers is None else wrappers
    run, schema = _extract()
    joined = _with_wrappers(_rows(pages, **columns), wrappers.select("host", "wrapper", "template"), broadcast_bytes)
    return joined.select("page_id", "url", "host", "html", "wrapper", "template").mapInArrow(run, schema)
