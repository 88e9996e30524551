"""HTML extraction: wrappers as union-free regular expressions, inferred per host.

A page is read as a tree of block elements (``tag.class#id``) and text blocks. Runs of
siblings of equal structure are folded into repeated groups. The wrapper of a host starts as
its first page and is aligned with the next ones: matching elements are merged, differing
texts become slots, and what has no partner becomes optional. Every page is matched with its
host's wrapper, and the texts in slots and groups are its content: a text that was the same
in at least two different pages, and in all that have its place, is a constant and goes. The
main container is the page's ``article`` or ``main`` element or else the wrapper's container
with the most slot text outside menus, headers, footers, sidebars, notices, adverts, forms
and comments.

Wrappers are inferred from all pages of a host: tasks merge pages of equal structure (copies
change nothing), the structures of a host meet in a tree of partial alignments, and a host
with many pages is one small group in each step. The pages meet their wrapper in a join that
splits a host with many pages.

Defined cases: null and empty html give an empty text; a page without any markup is one
block; a null url belongs to the host ''; pages whose structure the wrapper does not know
are read by their own; equal rows give equal results; an empty table gives an empty result;
extra columns are ignored. Broken markup is read as far as it goes: a paragraph ends where
the next block begins, end tags without a start are skipped.
"""

from __future__ import annotations

import difflib
import html
import itertools
import pickle
import re
import sys

import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from stocklens.llm.common import map_batches, staged, text_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FAN = 64                   # structures of a host that are merged at once
HELD = 4_096               # structures that a task holds before it passes them on
PERIOD = 3                 # longest repeated group of siblings, in elements
MANY = 3                   # different pages that must share a text of a repeated group to make it a constant
DEPTH = 100                # nesting of elements that a wrapper follows
WIDE = 1 << 20             # product of two lists' lengths from which they are aligned by their longest blocks

# Element and name lists (fixed values)
BLOCKS = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol
p pre section summary table tbody td tfoot th thead title tr ul""".split())
RAW = set("script style noscript template svg iframe object textarea select button math canvas audio video".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
AROUND = set("aside dialog footer form head header menu nav title".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "td": {"td", "th", "p"},
          "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "tbody": {"tr", "td", "th", "thead", "tbody", "p"}}
NAMES = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|side-?bar|menu|nav\w*|breadcrumbs?"
                   r"|footer|header|masthead|cookies?|consent|notice|popup|modal|overlay|social|share|sharing"
                   r"|related|recommend\w*|comments?|respond|repl(?:y|ies)|disqus|discussion|newsletter"
                   r"|subscri\w+|login|toolbar|paginat\w+|pager|widget)(?:$|[\s_-])", re.I)
HEAD_NAMES = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|[^<]+|<", re.S)
_ATTR = re.compile(r"(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)


def label_of(tag: str, attrs: str) -> str:
    """tag, class names and id: what tells one element of a template from another. Numbers
    are left out, as they often count pages."""
    found = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)} if attrs else {}
    out = ""
    if found.get("class"):
        out += "." + " ".join(found["class"].split())
    if found.get("id"):
        out += "#" + found["id"]
    if found.get("role"):
        out += "@" + found["role"]
    return tag + re.sub(r"\d+", "0", out)


def parse(page: str) -> tuple[list, list[tuple[tuple[str, ...], str]]]:
    """The page as a tree (nested lists [label, children], texts as strings) and its text
    blocks with the path of open block elements."""
    root: list = ["", []]
    stack = [root]
    blocks: list[tuple[tuple[str, ...], str]] = []
    buffer: list[str] = []
    skip = None

    def flush():
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            stack[-1][1].append(text)
            blocks.append((tuple(n[0] for n in stack[1:]), text))

    tag_of = lambda node: re.split(r"[.#@]", node[0], maxsplit=1)[0]
    for m in _TOKEN.finditer(page):
        token, tag = m.group(0), m.group(2)
        if tag is None:
            if skip is None and not token.startswith(("<!", "<?")):
                buffer.append(html.unescape(token))
            continue
        tag = tag.lower()
        closing = bool(m.group(1))
        if skip is not None:                 # inside an element that holds no text of the page
            if closing and tag == skip:
                skip = None
            continue
        if tag in RAW:
            if not closing and not m.group(3).endswith("/"):
                skip = tag
            buffer.append(" ")
        elif tag == "br":
            buffer.append(" ")
        elif tag in BLOCKS or (tag not in VOID and not closing and _ATTR.search(m.group(3)) and NAMES.search(label_of("", m.group(3)))):
            flush()
            if closing:
                if any(tag_of(n) == tag for n in stack[1:]):
                    while tag_of(stack.pop()) != tag:
                        pass
            elif tag not in VOID:
                over = CLOSES.get(tag, {"p"} if tag in BLOCKS else set())
                while len(stack) > 1 and tag_of(stack[-1]) in over:
                    stack.pop()
                node = [label_of(tag, m.group(3)), []]
                stack[-1][1].append(node)
                stack.append(node)
        elif closing and any(tag_of(n) == tag for n in stack[1:]):
            flush()                          # an inline element that was kept for its name
            while tag_of(stack.pop()) != tag:
                pass
    flush()
    return root, blocks


def raw_script_safe(page: str) -> str:
    """Scripts and styles blanked before tokens are read: their text may look like markup."""
    return re.sub(r"(<(script|style)\b[^>]*>).*?(?=</\2\s*>|$)", r"\1", page, flags=re.S | re.I)


# Wrapper nodes: ("t", label, children) | ("x", texts, pages) | ("+", nodes) | ("?", node). texts are the digests
# of the texts that every page has at this place, pages the digests of up to MANY of those pages; a place
# without a text that is common to all is the slot ("x", None).
def digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def wrapper_of(children: list, page: int = 0, numbers: bool = False) -> list:
    """The union-free expression of one page's children, repeats folded. ``page`` is the page's
    digest. What lies deeper than DEPTH elements counts as texts of the element there. With
    ``numbers`` a text is ("x", [numbers of its blocks])."""
    count = itertools.count()
    leaf = (lambda t: ("x", [next(count)])) if numbers else (lambda t: ("x", frozenset([digest(t)]), (page,)))

    def texts(nodes):
        stack = list(reversed(nodes))
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                yield leaf(n)
            else:
                stack.extend(reversed(n[1]))

    def inner(nodes, depth):
        return fold([leaf(n) if isinstance(n, str) else
                     ("t", n[0], inner(n[1], depth + 1) if depth < DEPTH else list(texts(n[1]))) for n in nodes])

    return inner(children, 0)


def key(node) -> str:
    """What must agree for two nodes to be aligned."""
    kind = node[0]
    if kind == "t":
        return "<" + node[1]
    if kind == "x":
        return "#"
    return "|".join(key(n) for n in (node[1] if kind == "+" else [node[1]]))


def shape(node) -> str:
    """Structure of a node without its texts."""
    kind = node[0]
    if kind == "t":
        return f"<{node[1]}({','.join(map(shape, node[2]))})"
    if kind == "x":
        return "#"
    return kind + ("".join(map(shape, node[1])) if kind == "+" else shape(node[1]))


def fold(nodes: list) -> list:
    """Consecutive groups of equal keys become one repeated group."""
    for size in range(1, PERIOD + 1):
        out, i = [], 0
        keys = [key(n) for n in nodes]
        while i < len(nodes):
            j = i + size
            if "#" not in keys[i:j]:
                while j + size <= len(nodes) and keys[j:j + size] == keys[i:i + size]:
                    j += size
            if j > i + size:
                group = list(nodes[i:i + size])
                for k in range(i + size, j, size):
                    group = [merge(a, b, True) for a, b in zip(group, nodes[k:k + size])]
                out.append(("+", group))
                i = j
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def merge(a, b, one: bool = False):
    """One node that matches whatever either of two nodes of equal key matches. Texts that are
    common to two pages stay known; of ``one`` page's repeated groups all are."""
    if "?" in (a[0], b[0]):
        return ("?", merge(a[1] if a[0] == "?" else a, b[1] if b[0] == "?" else b, one))
    if "+" in (a[0], b[0]):
        xs = a[1] if a[0] == "+" else [a]
        ys = b[1] if b[0] == "+" else [b]
        return ("+", [merge(x, y, one) for x, y in zip(xs, ys)])
    if a[0] == "x":
        if isinstance(a[1], list):
            a[1].extend(b[1])
            return a
        both = (a[1] | b[1] if one else a[1] & b[1]) if a[1] and b[1] else None
        return ("x", both, tuple(sorted({*a[2], *b[2]})[:MANY])) if both else ("x", None)
    return ("t", a[1], align(a[2], b[2], one))


def pairing(kx: list[str], ky: list[str]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence of two lists of keys (of long and very
    different lists: of a long one)."""
    n, head, tail = min(len(kx), len(ky)), 0, 0
    while head < n and kx[head] == ky[head]:
        head += 1
    while tail < n - head and kx[-1 - tail] == ky[-1 - tail]:
        tail += 1
    x, y = kx[head:len(kx) - tail], ky[head:len(ky) - tail]
    out = [(i, i) for i in range(head)]
    if len(x) * len(y) > WIDE:
        for m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks():
            out += [(head + m.a + k, head + m.b + k) for k in range(m.size)]
    elif x and y:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < len(x) and j < len(y):
            if x[i] == y[j]:
                out.append((head + i, head + j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    return out + [(len(kx) - k, len(ky) - k) for k in range(tail, 0, -1)]


def align(xs: list, ys: list, one: bool = False) -> list:
    """Longest common subsequence of keys; matches are merged, the rest is optional."""
    opt = lambda n: n if n[0] == "?" else ("?", n)
    out, i, j = [], 0, 0
    for a, b in [*pairing([key(n) for n in xs], [key(n) for n in ys]), (len(xs), len(ys))]:
        out += [opt(n) for n in xs[i:a]] + [opt(n) for n in ys[j:b]]
        if a < len(xs):
            out.append(merge(xs[a], ys[b], one))
        i, j = a + 1, b + 1
    return out


def settled(nodes: list, least: int = 2) -> list:
    """The wrapper with what its texts are: a set of constants, None for a slot, or 0 if fewer than
    two different pages (of a repeated group: MANY, as near copies share such texts) tell."""
    out = []
    for n in nodes:
        if n[0] == "t":
            out.append(("t", n[1], settled(n[2], least)))
        elif n[0] == "x":
            out.append(("x", None if n[1] is None else n[1] if len(n[2]) >= least else 0))
        else:
            inner = settled(n[1] if n[0] == "+" else [n[1]], MANY if n[0] == "+" else least)
            out.append(("+", inner) if n[0] == "+" else ("?", inner[0]))
    return out


def match(own: list, wrapper: list, found: dict[int, object]) -> None:
    """Match a page's numbered expression with a settled wrapper: what the wrapper has at the
    place of each block that it knows."""
    for i, j in pairing([key(n) for n in own], [key(n) for n in wrapper]):
        todo = [(own[i], wrapper[j])]
        while todo:
            a, b = todo.pop()
            if "?" in (a[0], b[0]):
                todo.append((a[1] if a[0] == "?" else a, b[1] if b[0] == "?" else b))
            elif "+" in (a[0], b[0]):
                todo += zip(a[1] if a[0] == "+" else [a], b[1] if b[0] == "+" else [b])
            elif a[0] == "x":
                for n in a[1]:
                    found[n] = b[1]
            else:
                match(a[2], b[2], found)


def tag_in(label: str) -> str:
    return re.split(r"[.#@]", label, maxsplit=1)[0]


def around(path: tuple[str, ...], home: tuple[str, ...] = ()) -> bool:
    """Whether a path leads through a region that is no main text. Headers inside an article
    belong to it. Names tell nothing of what contains the whole page, or the main container
    ``home``."""
    inside, whole = False, path[:len(home)] == home
    for i, label in enumerate(path):
        tag = tag_in(label)
        if tag in ("html", "body") or (whole and i < len(home)):
            if tag in AROUND:
                return True
            inside = inside or tag in ("article", "main")
            continue
        names = label[len(tag):].replace(".", " ").replace("#", " ").replace("@", " ")
        if tag in ("article", "main"):
            inside = True
            if names and NAMES.search(names):
                return True
            continue
        if inside and (tag == "header" or (HEAD_NAMES.search(names) and tag != "nav")):
            continue
        if tag in AROUND or (names and NAMES.search(names)):
            return True
    return False


def semantic(path: tuple[str, ...]) -> int | None:
    """Depth of the article, main or main role that a path leads through."""
    for tags in (("article",), ("main",)):
        for i, label in enumerate(path):
            if tag_in(label) in tags or (tags == ("main",) and label.endswith("@main")):
                return i
    return None


def home_of(path: tuple[str, ...]) -> tuple[str, ...]:
    """The container that a block counts for: its element, or the parent of a heading or the like."""
    return path[:-1] if path and tag_in(path[-1]) not in ("body", "div", "section", "td", "html") else path


def container(weights: list[tuple[tuple[str, ...], int]]) -> list[str]:
    """The container path with the most text: a block's weight counts for its element's
    parent. The shallowest of the paths that hold most of the total wins ties."""
    mass: dict[tuple[str, ...], int] = {}
    for path, n in weights:
        mass[home_of(path)] = mass.get(home_of(path), 0) + n
    return list(max(mass, key=lambda p: (mass[p], -len(p), p))) if mass else []


def main_container(blocks: list[tuple[tuple[str, ...], str]]) -> tuple[str, ...]:
    """The article or main element whose names, or those of what contains it, would wrongly leave
    it out: the one with the most text, if that is more than all text that stays; else ()."""
    stays, mass = 0, {}
    for path, text in blocks:
        depth = semantic(path)
        if not around(path):
            if depth is not None:
                return ()
            stays += len(text)
        elif depth is not None and not any(tag_in(x) in AROUND for x in path[:depth]):
            mass[path[:depth + 1]] = mass.get(path[:depth + 1], 0) + len(text)
    best = max(mass, key=lambda p: (mass[p], -len(p), p), default=())
    return best if best and mass[best] > stays else ()


def read(page: str, wrapper: list | None) -> list[tuple[tuple[str, ...], str, bool]]:
    """(path, text, whether it is in a slot that differs between pages) of the blocks of a page
    outside menus and the like, without the constants of the settled wrapper."""
    root, blocks = parse(raw_script_safe(page))
    found: dict[int, object] = {}
    if wrapper:
        match(wrapper_of(root[1], numbers=True), wrapper, found)
    home = main_container(blocks)
    out = []
    for n, (path, text) in enumerate(blocks):
        known = found.get(n, 0)
        if not around(path, home) and not (known and digest(text) in known):
            out.append((path, text, known is None))
    return out


def masses(blocks: list[tuple[tuple[str, ...], str, bool]]) -> list[tuple[tuple[str, ...], int]]:
    """(path, characters) of the blocks of a page without an article or main element."""
    return [] if any(semantic(p) is not None for p, _, _ in blocks) else [(p, len(t)) for p, t, _ in blocks]


def infer(pages: list[str]) -> dict:
    """The wrapper of a host: its settled expression, and the main container of the pages without
    an article or main element. What ``wrappers`` does for all hosts, in one place."""
    pages = sorted(set(pages))
    own = [wrapper_of(parse(raw_script_safe(page))[0][1], digest(page)) for page in pages]
    wrapper = settled(merged([(expression(w), pickle.dumps(w)) for w in own]))
    return {"wrapper": wrapper, "root": container([m for page in pages for m in masses(read(page, wrapper))]) or None}


def expression(nodes: list) -> int:
    """Digest of the structure of a list of nodes, as a signed number."""
    h = digest(",".join(map(shape, nodes)))
    return h - (1 << 64) if h >> 63 else h


def merged(parts: list[tuple[int, bytes]]) -> list:
    """One expression for pickled ones: first those of equal structure, whose order does not
    matter, then the structures in the order of their digests."""
    out = None
    for _, same in itertools.groupby(sorted(parts, key=lambda x: x[0]), key=lambda x: x[0]):
        own = None
        for _, p in same:
            own = pickle.loads(p) if own is None else align(own, pickle.loads(p))
        out = own if out is None else align(out, own)
    return out or []


def extract(page: str, wrapper: dict | None) -> str:
    """The main text of a page: the blocks of its main container that its host's wrapper does not
    hold as constants, in order, one per line. The container is the article or main element, or
    the wrapper's, or else the page's own; a title (h1) before it counts if it differs from page
    to page."""
    def main(blocks):
        inside = [semantic(p) is not None for p, _, _ in blocks]
        if not any(inside) and wrapper and wrapper["root"] is not None:
            root = tuple(wrapper["root"])
            inside = [p[:len(root)] == root for p, _, _ in blocks]
        if not any(inside):
            root = tuple(container([(p, len(t)) for p, t, _ in blocks]))
            inside = [p[:len(root)] == root for p, _, _ in blocks]
        first = inside.index(True) if True in inside else 0
        return "\n".join(t for n, ((p, t, differs), ok) in enumerate(zip(blocks, inside))
                         if ok or (n < first and differs and p and tag_in(p[-1]) == "h1"))

    return main(read(page, wrapper and wrapper["wrapper"])) or main(read(page, None))


def host_of(url: str):
    """Host of a url column, '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"://([^/?#]*)", 1))


def structures(rows: DataFrame) -> DataFrame:
    """(host, shape, part, bare) of the structures of every host's pages, merged inside each task;
    bare counts the pages without an article or main element."""
    def run(batches):
        held: dict[tuple[str, int], list] = {}
        bare: dict[tuple[str, int], int] = {}

        def emit():
            return pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in held], pa.string()), pa.array([x for _, x in held], pa.int64()),
                 pa.array([pickle.dumps(w) for w in held.values()], pa.binary()),
                 pa.array([bare.get(at, 0) for at in held], pa.int64())], names=["host", "shape", "part", "bare"])

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                root, blocks = parse(raw_script_safe(page))
                own = wrapper_of(root[1], digest(page))
                at = (host, expression(own))
                held[at] = align(held[at], own) if at in held else own
                if not any(semantic(path) is not None for path, _ in blocks):
                    bare[at] = bare.get(at, 0) + 1
                if len(held) >= HELD:
                    yield emit()
                    held.clear()
                    bare.clear()
        if held:
            yield emit()

    return rows.mapInArrow(run, "host string, shape long, part binary, bare long")


def combine(parts: DataFrame, *group: str) -> DataFrame:
    """(host, shape, part, bare): the parts of each group as one."""
    rows = parts.groupBy(*group).agg(F.min("shape").alias("shape"), F.collect_list(F.struct("shape", "part")).alias("parts"), F.sum("bare").alias("bare"))

    def step(cols):
        own = [merged([(p["shape"], p["part"]) for p in ps]) for ps in cols["parts"]]
        return {"host": cols["host"], "shape": [expression(w) for w in own], "part": [pickle.dumps(w) for w in own], "bare": cols["bare"]}

    return map_batches(rows.select("host", "parts", "bare"), lambda: step, "host string, shape long, part binary, bare long")


def wrappers(df: DataFrame, url: str = "url", page: str = "html", fan: int = FAN) -> DataFrame:
    """(host, wrapper): one inferred wrapper per host, pickled. All pages of a host count: tasks
    merge pages of equal structure, then structures are merged in a tree, ``fan`` at a time."""
    rows = df.select(host_of(url).alias("host"), text_of(page).alias("html"))
    dealt = structures(rows).withColumn("deal", F.floor(F.spark_partition_id() / fan))
    parts = staged(combine(combine(dealt, "host", "shape", "deal"), "host", "shape"), "structures")
    while True:
        sizes = staged(parts.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / fan).alias("n")), "sizes")
        most = sizes.agg(F.max("n")).first()[0] or 0
        spread = parts.join(sizes, "host").withColumn("deal", F.pmod(F.xxhash64("shape"), F.col("n")))
        parts = staged(combine(spread, "host", "deal"), "structures")
        if most <= 1:
            break

    def settle(cols):
        return {"host": cols["host"], "wrapper": [pickle.dumps(settled(pickle.loads(p))) for p in cols["part"]], "bare": cols["bare"]}

    known = staged(map_batches(parts.select("host", "part", "bare"), lambda: settle, "host string, wrapper binary, bare long"), "wrappers")

    def weigh():
        load = Loader()

        def step(cols):
            sums: dict[tuple[str, tuple[str, ...]], int] = {}
            for h, p, w in zip(cols["host"], cols["html"], cols["wrapper"]):
                for path, n in masses(read(p, load(w))):
                    sums[h, home_of(path)] = sums.get((h, home_of(path)), 0) + n
            return {"host": [h for h, _ in sums], "path": [list(p) for _, p in sums], "n": list(sums.values())}
        return step

    # only hosts with a page that has no article or main element need a container of their own
    mass = map_batches(rows.join(known.filter("bare > 0"), "host").select("host", "html", "wrapper"), weigh, "host string, path array<string>, n long")
    home = mass.groupBy("host", "path").agg(F.sum("n").alias("n"))
    best = home.groupBy("host").agg(F.max(F.struct("n", -F.size("path"), "path"))["path"].alias("root"))
    return known.drop("bare").join(best, "host", "left")


class Loader(dict):
    """Unpickled wrappers, remembered for up to 1,000."""

    def __call__(self, wrapper: bytes | None):
        if wrapper is None:
            return None
        if wrapper not in self:
            if len(self) >= 1_000:
                self.clear()
            self[wrapper] = pickle.loads(wrapper)
        return self[wrapper]


def main_text(df: DataFrame, url: str = "url", page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns plus text and n_chars of every page."""
    types = dict(df.dtypes)
    known = staged(wrappers(df, url, page), "wrappers")
    rows = df.select(*keep, host_of(url).alias("__host"), text_of(page).alias("__html"))
    rows = rows.join(known.select(F.col("host").alias("__host"), F.col("wrapper").alias("__wrapper"),
                                  F.col("root").alias("__root")), "__host", "left")

    def reader():
        load = Loader()

        def step(cols):
            out = [extract(h, w and {"wrapper": load(w), "root": r})
                   for h, w, r in zip(cols.pop("__html"), cols.pop("__wrapper"), cols.pop("__root"))]
            return cols | {"text": out, "n_chars": [len(t) for t in out]}
        return step

    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), "text string, n_chars long"])
    return map_batches(rows.select(*keep, "__html", "__wrapper", "__root"), reader, schema)
