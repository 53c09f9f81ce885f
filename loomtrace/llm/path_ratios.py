"""Main text of HTML pages by tag-path ratios.

Each run of text is a node with a root-to-leaf tag path.  For a page, the nodes of one path are
aggregated: characters of text a node (text ratio) and punctuation marks a node (punctuation
ratio).  Every node takes its path's ratios; in document order both series are smoothed with
a Gaussian kernel weighted by the likeness of the paths, so a short path inside an article is
lifted by its surroundings and a menu beside it is not.  The two are fused (``text * (1 + punctuation)``), averaged over each
path, and paths at or above ``cut`` standard deviations of the fused node values are content
(at least the best path is).  The nodes of content paths, in order, are the page's text.

Inline formatting (``b``, ``em``, ``span``, ...) is no part of a path, so emphasis does not tear a
paragraph; links are, since they mark menus.  A page is one row in and one row out: a map, no shuffle.

Paths are entries of a tree, each with its parent and its last tag, so markup of any depth takes memory and time
in proportion to the page; ``paths`` in the result is that tree, cut to content paths and their ancestors.

Defined results
  * null or empty html, and pages without visible text: empty text, no nodes, no paths.
  * unclosed and crossed tags close with their parent; a comment, script or style without end hides the rest.
  * a ``<`` after which no tag can end is text.  Where a quoted value never ends, tags of the rest of that page end at
    the next ``>``, quoted or not.
  * white space is folded, character references are resolved, nodes are joined by a newline.
  * ties: every path at the threshold is kept, so equal paths are kept or dropped alike.
  * repeated rows: one equal result each; null page_id, or one that is no whole number: extracted like any other row, under null.
  * empty table: empty result.  Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What may open a token; everything up to the next such place is text.
_OPEN = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*+)|[!?])")
#: The rest of a tag with its quoted values, and what is no such rest up to its unclosed quote.
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
HIDDEN = frozenset("script style noscript template title textarea iframe svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("abbr b bdi bdo big cite code data dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: A tag that opens closes these where they are the innermost open one.
_CLOSES = {t: frozenset({"p"}) for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()}
_CLOSES |= {"li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}), "option": frozenset({"option"})}
_MARKS = re.compile(r"[.,;:!?…、。！，：；？]")
#: Where hidden elements end.
_END_OF = {t: re.compile(rf"</{t}\s*+>", re.I) for t in HIDDEN}


class Paths:
    """Tag paths of one page.  Path 0 is the empty one; every other is its parent's path and one more tag."""

    def __init__(self) -> None:
        self.parent, self.tag, self.depth, self.jump = [0], [""], [0], [0]
        self._known: dict[tuple[int, str], int] = {}

    def below(self, path: int, tag: str) -> int:
        got = self._known.get((path, tag))
        if got is None:
            got = self._known[(path, tag)] = len(self.parent)
            # ancestors at skipping distances, so that any of them is a logarithmic number of steps away
            j = self.jump[path]
            far = self.jump[j] if self.depth[path] - self.depth[j] == self.depth[j] - self.depth[self.jump[j]] else path
            for col, v in ((self.parent, path), (self.tag, tag), (self.depth, self.depth[path] + 1), (self.jump, far)):
                col.append(v)
        return got

    def shared(self, a: int, b: int) -> int:
        """Length of what two paths have in common from the root."""
        depth, jump, parent = self.depth, self.jump, self.parent
        if depth[a] < depth[b]:
            a, b = b, a
        while depth[a] > depth[b]:
            a = jump[a] if depth[jump[a]] >= depth[b] else parent[a]
        while a != b:
            a, b = (jump[a], jump[b]) if jump[a] != jump[b] else (parent[a], parent[b])
        return depth[a]

    def name(self, path: int) -> str:
        out = []
        while path:
            out.append(self.tag[path])
            path = self.parent[path]
        return "/".join(reversed(out))

    def tree(self, kept: list[int]) -> list[dict]:
        """The kept paths and their ancestors: each entry has its parent's place in the list (-1: none), its tag and whether it is kept."""
        need, marked = set(), set(kept)
        for p in kept:
            while p and p not in need:
                need.add(p)
                p = self.parent[p]
        place = {p: i for i, p in enumerate(sorted(need))}
        return [{"parent": place.get(self.parent[p], -1), "tag": self.tag[p], "content": p in marked} for p in place] + ([{"parent": -1, "tag": "", "content": True}] if 0 in marked else [])


def path_names(tree: list) -> list[str]:
    """The content paths of a result's ``paths``, written out."""
    names: list[str] = []
    for e in tree:
        names.append(e["tag"] if e["parent"] < 0 else f"{names[e['parent']]}/{e['tag']}")
    return [n for n, e in zip(names, tree) if e["content"]]


def text_nodes(html: str, paths: Paths) -> list[tuple[int, str]]:
    """``(path, text)`` of every run of visible text, in document order.  Each character is read a fixed number of times."""
    stack: list[tuple[str, int]] = []
    open_tags: Counter = Counter()
    nodes: list[tuple[int, str]] = []
    parts: list[str] = []
    at, n, last, quoted = 0, len(html), html.rfind(">"), True

    def flush() -> None:
        if parts:
            text = " ".join(references.unescape("".join(parts)).split())
            if text:
                nodes.append((stack[-1][1] if stack else 0, text))
            parts.clear()

    def shut() -> None:
        open_tags[stack.pop()[0]] -= 1

    while at < n:
        m = _OPEN.search(html, at)
        if m is not None and m[0] != "<!--" and m.end() > last:  # no tag can end any more; a comment may still hide the rest
            hide = html.find("<!--", m.start())
            parts.append(html[at : hide if hide >= 0 else n])
            break
        if m is None:
            parts.append(html[at:])
            break
        if m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        if m[0] == "<!--":
            end = html.find("-->", at)
            at = n if end < 0 else end + 3
            continue
        rest = _REST.match(html, at) if m[2] and quoted else None
        if m[2] and quoted and rest is None:
            quoted = False
        at = rest.end() if rest else html.index(">", at) + 1
        closing, name = m[1], (m[2] or "").lower()
        if not name or name in INLINE:
            continue
        if name in HIDDEN:
            if not closing:
                end = _END_OF[name].search(html, at)
                at = end.end() if end else n
            continue
        flush()
        if closing:
            if open_tags[name]:
                while stack[-1][0] != name:
                    shut()
                shut()
        elif name not in VOID:
            ends = _CLOSES.get(name, ())
            while stack and stack[-1][0] in ends:
                shut()
            stack.append((name, paths.below(stack[-1][1] if stack else 0, name)))
            open_tags[name] += 1
    flush()
    return nodes


def content_paths(nodes: list[tuple[int, str]], paths: Paths, sigma: float, cut: float) -> tuple[np.ndarray, list[int]]:
    """(whether each node is content, the content paths in order of their first node).

    Likeness of two paths is the squared share of the longer one that both have from the root.
    """
    index: dict[int, int] = {}
    path = np.array([index.setdefault(p, len(index)) for p, _ in nodes])
    per = np.bincount(path)
    text = np.bincount(path, [len(t) for _, t in nodes]) / per
    marks = np.bincount(path, [len(_MARKS.findall(t)) for _, t in nodes]) / per
    text_sum, mark_sum, weight = text[path], marks[path], np.ones(len(path))
    own_path = list(index)
    for d in range(1, min(len(path) - 1, int(np.ceil(3 * sigma))) + 1):
        pairs, back = np.unique(path[:-d] * len(per) + path[d:], return_inverse=True)
        alike = [(paths.shared(a, b) / max(paths.depth[a], paths.depth[b], 1)) ** 2 if a != b else 1.0 for a, b in ((own_path[x // len(per)], own_path[x % len(per)]) for x in pairs.tolist())]
        near = np.array(alike)[back] * np.exp(-0.5 * (d / sigma) ** 2)
        for own, other in ((slice(None, -d), slice(d, None)), (slice(d, None), slice(None, -d))):
            weight[own] += near
            text_sum[own] += near * text[path[other]]
            mark_sum[own] += near * marks[path[other]]
    fused = text_sum / weight * (1 + mark_sum / weight)
    score = np.bincount(path, fused) / per
    least = min(cut * float(fused.std()), float(score.max()))
    good = score >= least - 1e-9
    return good[path], [p for p, k in index.items() if good[k]]


def extract(html: str, sigma: float = 1.0, cut: float = 1.0) -> tuple[str, int, int, list[dict]]:
    """(text, nodes, content nodes, tree of the content paths) of one page."""
    paths = Paths()
    nodes = text_nodes(html, paths)
    if not nodes:
        return "", 0, 0, []
    good, kept = content_paths(nodes, paths, sigma, cut)
    return "\n".join(t for (_, t), g in zip(nodes, good.tolist()) if g), len(nodes), int(good.sum()), paths.tree(kept)


def main_text(pages: DataFrame, sigma: float = 1.0, cut: float = 1.0) -> DataFrame:
    """``(page_id, url, text, nodes, content_nodes, paths)`` of every page; ``path_names`` writes ``paths`` out."""
    if sigma <= 0 or cut < 0:
        raise ValueError("sigma must be positive and cut not negative")

    @F.arrow_udf("text string, nodes int, content_nodes int, paths array<struct<parent: int, tag: string, content: boolean>>")
    def job(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.struct([("parent", pa.int32()), ("tag", pa.string()), ("content", pa.bool_())]))]
        for column in columns:
            rows = [extract(v.as_py() or "", sigma, cut) for v in column]
            cols = zip(*rows) if rows else ((), (), (), ())
            yield pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["text", "nodes", "content_nodes", "paths"])

    got = pages.select(F.col("page_id").try_cast("bigint").alias("page_id"), "url", job("html").alias("r"))
    return got.select("page_id", "url", "r.text", "r.nodes", "r.content_nodes", "r.paths")
