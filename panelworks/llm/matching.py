"""Simple tree matching: pages of a host are aligned with reference trees, whose nodes give the paths of theirs."""

from __future__ import annotations

from dataclasses import dataclass, field

from panelworks.llm.dom import Shape, digest, path_of

#: Nodes of a tree that may be a reference. Larger pages are aligned with references all the same.
REFERENCE_NODES = 2_000
#: Reference trees of a host, its most frequent ones.
REFERENCES = 3
#: Pairs of subtrees whose matching is remembered.
_REMEMBERED = 100_000


@dataclass(slots=True)
class Tree:
    """Labels of a page in order. ``structure`` is equal for equal trees, ``count`` the number of nodes."""

    label: str
    children: list[Tree]
    structure: int = 0
    count: int = 1
    path: int = 0
    shape: Shape | None = None

    def __post_init__(self) -> None:
        below = b"".join(child.structure.to_bytes(8, "big", signed=True) for child in self.children)
        self.structure = digest(below + self.label.encode("utf-8", "surrogatepass"))
        self.count = 1 + sum(child.count for child in self.children)

    def plain(self) -> list:
        return [self.label, [child.plain() for child in self.children]]


def tree_of(shape: Shape) -> Tree:
    made = Tree(shape.label, [tree_of(child) for child in shape.children])
    made.shape = shape
    return made


def tree_from(plain: list) -> Tree:
    return Tree(plain[0], [tree_from(child) for child in plain[1]])


def place(tree: Tree, parent: int = 0, mates: dict[int, Tree] | None = None) -> None:
    """Give every node its path: that of the reference node it is matched with, else one of its own.

    Without ``mates`` (a reference, or a page of a host without any) the path is that of the labels from the root on,
    each with its number among the siblings of that label.
    """
    mate = mates.get(id(tree)) if mates is not None else None
    if tree.path == 0:
        tree.path = mate.path if mate else path_of(parent, tree.label)
    seen: dict[str, int] = {}
    for child in tree.children:
        other = mates.get(id(child)) if mates is not None else None
        if other is not None:
            child.path = other.path
        else:
            seen[child.label] = seen.get(child.label, -1) + 1
            own = "" if mates is None else "?"
            child.path = path_of(tree.path, f"{own}{child.label}:{seen[child.label]}")
        place(child, tree.path, mates)
    if tree.shape is not None:
        tree.shape.path = tree.path


@dataclass
class Aligner:
    """The reference trees of a host, with what is known of the matching of their parts."""

    references: list[Tree]
    known: dict[tuple[int, int], int] = field(default_factory=dict)

    @staticmethod
    def of(plain: list[list]) -> Aligner:
        made = Aligner([tree_from(p) for p in plain])
        for tree in made.references:
            place(tree)
        return made

    def align(self, page: Shape) -> None:
        """Set the paths of ``page`` by the reference that it matches best, the first of equals."""
        tree = tree_of(page)
        if not self.references:
            return place(tree)
        if len(self.known) > _REMEMBERED:
            self.known.clear()
        share = [2 * self.matched(tree, r) / (tree.count + r.count) for r in self.references]
        mates: dict[int, Tree] = {}
        self._pair(tree, self.references[share.index(max(share))], mates)
        place(tree, 0, mates)

    def matched(self, a: Tree, b: Tree) -> int:
        """The most nodes in an ordered matching of two trees that keeps parents; equal labels match only."""
        if a.label != b.label:
            return 0
        if a.structure == b.structure:
            return a.count
        key = (a.structure, b.structure)
        if key not in self.known:
            low, a_end, b_end = _ends(a, b)
            same = sum(c.count for c in a.children[:low]) + sum(c.count for c in a.children[a_end:])
            self.known[key] = 1 + same + self._table(a.children[low:a_end], b.children[low:b_end])[-1][-1]
        return self.known[key]

    def _table(self, a: list[Tree], b: list[Tree]) -> list[list[int]]:
        rows = [[0] * (len(b) + 1)]
        for x in a:
            above, row = rows[-1], [0]
            for j, y in enumerate(b):
                both = above[j] + self.matched(x, y) if x.label == y.label else 0
                row.append(max(above[j + 1], row[j], both))
            rows.append(row)
        return rows

    def _pair(self, a: Tree, b: Tree, mates: dict[int, Tree]) -> None:
        mates[id(a)] = b
        low, a_end, b_end = _ends(a, b)
        for x, y in [*zip(a.children[:low], b.children), *zip(a.children[a_end:], b.children[b_end:])]:
            self._pair(x, y, mates)
        left, right = a.children[low:a_end], b.children[low:b_end]
        rows = self._table(left, right)
        i, j = len(left), len(right)
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                self._pair(left[i], right[j], mates)


def _ends(a: Tree, b: Tree) -> tuple[int, int, int]:
    """Where equal children at the start end, and where those at the end begin in both.

    Pairing equal subtrees there is never worse than another pairing, so only what is between them needs a table.
    """
    low, a_end, b_end = 0, len(a.children), len(b.children)
    while low < min(a_end, b_end) and a.children[low].structure == b.children[low].structure:
        low += 1
    while min(a_end, b_end) > low and a.children[a_end - 1].structure == b.children[b_end - 1].structure:
        a_end, b_end = a_end - 1, b_end - 1
    return low, a_end, b_end
