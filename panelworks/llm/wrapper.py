"""Main text of web pages by wrapper induction: same-host pages are aligned, what they have in common is template."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelworks.llm.dom import TEXTUAL, Shape, blocks, parse, path_of, skeleton
from panelworks.llm.matching import REFERENCE_NODES, REFERENCES, Aligner, tree_of
from panelworks.llm.staging import stored

#: A node is constant if this share of the host's pages that have it agree on its text, two different pages at least.
CONSTANT = 0.8
#: The content slot holds this share of the varying text of what encloses it; an article needs only the smaller share.
SLOT, ARTICLE = 0.75, 0.3
#: What holds more than this share of the varying text is content whatever its name.
MOST = 0.5
#: Stands for the text of a node that is in none of its children.
OWN = "~"
_VOTE = "host string, path long, text long, parent long, label string, unwanted boolean, marked boolean, pages long, own long, low long, high long"


def host_of(url: Column) -> Column:
    """The host of a URL in lower case without user and port; null or something else: the empty one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


def _listed(shape: Shape) -> list[Shape]:
    out, work = [], [shape]
    while work:
        node = work.pop()
        out.append(node)
        work.extend(reversed(node.children))
    return out


class Wrapper:
    """The template of a host: its reference trees, the constant texts by path, and the paths of the content slot."""

    def __init__(self, trees: list[list], votes: list[dict]) -> None:
        self.aligner = Aligner.of(trees)
        self.constant: dict[int, int] = {}
        self.slot: set[int] = set()
        self.mates = bool(votes)
        shapes = {}
        for v in votes:
            shape = shapes[v["path"]] = Shape(v["label"], v["path"], own=v["own"], unwanted=v["unwanted"], marked=v["marked"])
            if v["several"] and v["equal"] >= CONSTANT * v["pages"] and shape.tag not in ("article", "main"):
                self.constant[v["path"]] = shape.text = v["text"]
        top = None
        for v in votes:
            shape = shapes[v["path"]]
            if v["label"] == OWN:
                if v["parent"] in shapes:
                    shapes[v["parent"]].own_text = shape.text
            elif v["parent"] in shapes:
                shapes[v["parent"]].children.append(shape)
            elif not v["label"]:
                top = shape
        if top is not None:
            varying = self._varying(top)
            if varying[top.path]:
                self.slot = {shape.path for shape in _slot(top, varying)}
            else:
                self.constant = {}

    def _same(self, shape: Shape) -> bool:
        return shape.path in self.constant and self.constant[shape.path] == shape.text

    def _own_same(self, shape: Shape) -> bool:
        path = path_of(shape.path, OWN)
        return path in self.constant and self.constant[path] == shape.own_text

    def _varying(self, root: Shape) -> dict[int, int]:
        """Length of the text by path that is neither template nor in unwanted elements."""
        varying: dict[int, int] = {}
        for shape in reversed(_listed(root)):
            own = 0 if self._own_same(shape) else shape.own
            none = shape.unwanted or self._same(shape)
            varying[shape.path] = 0 if none else own + sum(varying[c.path] for c in shape.children)
        return varying

    def text(self, html: str) -> str:
        page = skeleton(parse(html))
        self.aligner.align(page)
        varying = self._varying(page)
        slots = {s.path for s in _listed(page) if s.path in self.slot and varying[s.path]}
        slots = slots or {s.path for s in _slot(page, varying)}
        holds: set[int] = set()

        def find(shape: Shape) -> bool:
            below = [find(child) for child in shape.children]
            if any(below):
                holds.add(shape.path)
            return any(below) or shape.path in slots

        find(page)
        article = any(s.tag in ("article", "main") for s in _listed(page) if s.path in slots)
        gone: set[int] = set()
        dropped: set[int] = set()
        work = [(page, False, False)]
        while work:
            shape, inside, proper = work.pop()
            if shape.path in slots:
                inside, proper = True, proper or shape.tag not in ("", "html", "body")
            for child in shape.children:
                kept = child.path in slots or child.path in holds
                if not kept and self._same(child) and not (inside and child.tag in TEXTUAL):
                    drop = True
                else:
                    drop = not kept and child.marked and self._named(child, varying, inside, proper, varying[page.path], article)
                if drop:
                    gone.update(id(node) for node in child.nodes)
                    dropped.add(child.path)
                else:
                    work.append((child, inside, proper))
        start = page
        while not start.own or self._own_same(start):
            left = [c for c in start.children if c.size and not c.unwanted and c.path not in dropped]
            if len(left) != 1 or start.path in slots:
                break
            start = left[0]
        return "\n".join(line for node in start.nodes for line in blocks(node, lambda child: id(child) in gone))

    def _named(self, shape: Shape, varying: dict[int, int], inside: bool, proper: bool, total: int, article: bool) -> bool:
        """Whether the name of an element that is not constant and holds no slot has it dropped.

        It does outside the slot. Inside, it does not: what varies there is content. Only where no host mates show what
        varies, or the slot is the whole body, elements other than sections and blocks of text are dropped by name.
        """
        if varying[shape.path] > MOST * total and not article:
            return False
        return not (inside and ((proper and self.mates) or shape.tag in TEXTUAL or shape.tag == "section"))


def _slot(root: Shape, varying: dict[int, int]) -> list[Shape]:
    """The articles with their share of the varying text, or else the innermost node with most of it.

    An article outside marked elements comes first, however long they are (comments may be longer than the article),
    unless one of them holds most of the text and articles of its own.
    """
    total = varying[root.path]
    plain = dict(varying)
    for node in reversed(_listed(root)):
        if plain[node.path]:
            plain[node.path] -= sum(varying[c.path] - (0 if c.marked else plain[c.path]) for c in node.children)
    large = [c for c in _reachable(root, lambda c: not c.marked or varying[c.path] > MOST * total) if c.marked]
    if not any(c.tag in ("article", "main") and varying[c.path] for node in large for c in _listed(node)):
        if found := _articles(_reachable(root, lambda c: not c.marked), plain, plain[root.path]):
            return found
    if found := _articles(_reachable(root, lambda c: not c.marked or varying[c.path] > MOST * total), varying, total):
        return found
    slot = root
    while True:
        inner = [c for c in slot.children if c.tag not in TEXTUAL]
        best = max(inner, key=lambda c: varying[c.path], default=None)
        if best is None or varying[best.path] < SLOT * varying[slot.path] or not varying[best.path]:
            return [slot]
        slot = best


def _reachable(root: Shape, through) -> list[Shape]:
    out, work = [], [root]
    while work:
        node = work.pop()
        out.append(node)
        work.extend(c for c in reversed(node.children) if not c.unwanted and through(c))
    return out


def _articles(nodes: list[Shape], varying: dict[int, int], total: int) -> list[Shape]:
    for tag in ("article", "main"):
        if found := [node for node in nodes if node.tag == tag and varying[node.path] and varying[node.path] >= ARTICLE * total]:
            return found
    return []


def references(pages: DataFrame) -> DataFrame:
    """``host, trees``: the most frequent trees of labels of each host's pages that have text, as JSON."""

    def structures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, int], list] = {}
            for host, html in zip(*(batch.column(i).to_pylist() for i in range(2))):
                page = skeleton(parse(html or ""))
                if not page.size:
                    continue
                tree = tree_of(page)
                if tree.count <= REFERENCE_NODES:
                    key = (host, tree.structure)
                    if key not in seen:
                        seen[key] = [json.dumps(tree.plain()), 0]
                    seen[key][1] += 1
            rows = [(*key, *v) for key, v in seen.items()]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["host", "structure", "tree", "pages"])

    found = pages.select("host", "html").mapInArrow(structures, "host string, structure long, tree string, pages long")
    counted = found.groupBy("host", "structure").agg(F.sum("pages").alias("pages"), F.min("tree").alias("tree"))
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("pages"), "structure"))
    most = counted.withColumn("place", place).where(F.col("place") <= REFERENCES)
    trees = F.transform(F.sort_array(F.collect_list(F.struct("place", "tree"))), lambda t: t["tree"])
    return stored(most.groupBy("host").agg(F.to_json(trees).alias("trees")), "references")


def trees_from(column: str | None) -> list[list]:
    return [json.loads(tree) for tree in json.loads(column)] if column else []


def induce(pages: DataFrame, trees: DataFrame) -> DataFrame:
    """``host, trees, votes``: what all pages of a host say of the nodes that at least two different pages have.

    Each page is aligned with the reference tree of its host that it matches best; a node's path is that of its mate.
    Pages without text and repeated pages say nothing about what is constant: a text counts once two pages that differ
    elsewhere agree on it.
    """

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: dict[tuple[str, int, int], list] = {}
            known: dict[str, Aligner] = {}
            for host, html, trees in zip(*(batch.column(i).to_pylist() for i in range(3))):
                page = skeleton(parse(html or ""))
                if not page.size:
                    continue
                if host not in known:
                    known[host] = Aligner.of(trees_from(trees))
                known[host].align(page)
                work = [(0, page)]
                while work:
                    parent, shape = work.pop()
                    said = [(shape.path, shape.text, parent, shape.label, shape.unwanted, shape.marked, shape.own)]
                    if shape.own and shape.children:
                        said.append((path_of(shape.path, OWN), shape.own_text, shape.path, OWN, False, False, 0))
                    for path, text, above, label, unwanted, marked, own in said:
                        v = votes.setdefault((host, path, text), [above, label, unwanted, marked, 0, 0, page.text, page.text])
                        v[4] += 1
                        v[5] += own
                        v[6], v[7] = min(v[6], page.text), max(v[7], page.text)
                    if not shape.unwanted:
                        work.extend((shape.path, child) for child in shape.children)
            rows = [(*key, *v) for key, v in votes.items()]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), *[pa.int64()] * 4)
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _VOTE.split(", ")])

    said = [F.min(c).alias(c) for c in ("parent", "label", "unwanted", "marked", "low")] + [F.max("high").alias("high")]
    sums = [F.sum(c).alias(c) for c in ("pages", "own")]
    aligned = pages.join(trees.withColumnRenamed("host", "_host"), F.col("host") == F.col("_host"), "left")
    texts = aligned.select("host", "html", "trees").mapInArrow(vote, _VOTE).groupBy("host", "path", "text").agg(*said, *sums)
    best = F.max(F.struct(F.col("pages").alias("equal"), "text", (F.col("low") != F.col("high")).alias("several"))).alias("best")
    paths = texts.groupBy("host", "path").agg(*said, *sums, best).where("low != high")
    columns = ["path", "parent", "label", "unwanted", "marked", "pages", "own", "best.equal", "best.text", "best.several"]
    per_host = paths.groupBy("host").agg(F.collect_list(F.struct(*columns)).alias("votes"))
    made = per_host.select(F.col("host").alias("_host"), F.to_json("votes").alias("votes"))
    joined = trees.join(made, F.col("host") == F.col("_host"), "left")
    return stored(joined.select("host", "trees", "votes"), "wrappers")


def main_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``page_id, url, text`` of every row.

    The pages of a host are aligned by simple tree matching with the host's most frequent trees; the nodes of all its
    pages that are matched with the same node are brought together. Nodes whose text agrees on most of the pages that have them are template; the content slot is the articles, or else the
    innermost node with most of the varying text. Every block outside the template is taken, also beside the slot,
    without elements for menus, headers, footers, forms and scripts. A class, id or role that names a sidebar, notice,
    advert or the like is a hint: it drops an element outside the slot that does not hold most of the varying text. A
    page without its host's slot, or without host mates, is judged by its own text.

    White space in a block becomes one space; blocks are joined by a line feed. A null or empty page has the text "".
    A page without a proper URL belongs to the host "". Repeated rows get equal texts; an empty table gives no rows.
    """
    rows = pages.select(
        F.col(id_column).cast("long").alias("id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"), host_of(F.col(url_column)).alias("host")
    )
    wrappers = induce(rows, references(rows)).withColumnRenamed("host", "_host")
    joined = rows.join(wrappers, F.col("host") == F.col("_host"), "left").select("id", "url", "html", "host", "trees", "votes")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, Wrapper] = {}
            texts = []
            for html, host, trees, votes in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                if not html:
                    texts.append("")
                    continue
                if host not in known:
                    known[host] = Wrapper(trees_from(trees), json.loads(votes) if votes else [])
                texts.append(known[host].text(html))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return joined.mapInArrow(extract, "page_id long, url string, text string")
