"""Many globs as one trie of path segments, through which a path is walked once.

Edges are literal names, names with wildcards, and '**', which stays where it is. Names with wildcards are looked up by their
longer literal end, so that thousands of them at one node cost a few lookups. Where a glob's wildcard may stand for a slash, the
trie ends in an edge that takes all the rest. What the walk gives are candidates: every glob that matches a path, and few others.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

from corpusloom.plans import globs as G

#: Directories whose nodes a task remembers.
REMEMBERED = 1 << 14
LOOSE = re.compile(r"[?\[]|[?*+@!]\(|\\")


class Node:
    __slots__ = ("ends", "every", "loops", "names", "prefixes", "rest", "suffixes")

    def __init__(self, loops: bool = False):
        self.names: dict[str, Node] = {}
        self.prefixes: dict[int, dict[str, list]] = {}  # by their length: literal start of a name -> (its literal end, check, node)
        self.suffixes: dict[int, dict[str, list]] = {}
        self.every: list = []
        self.loops = loops  # for '**': any name leads here again
        self.ends: set[int] = set()
        self.rest: set[int] = set()  # globs that may match whatever follows


def _ends(segment: str) -> tuple[str, str, str]:
    """The literal start and end of a name with wildcards, and what is between them."""
    if LOOSE.search(segment):
        end = re.search(r"[^*?\[\](){}|@+!\\/-]*$", segment)[0]
        return "", end if ")" not in segment or segment.rindex(")") < len(segment) - len(end) else "", segment
    first, _, last = segment.partition("*")[0], None, segment.rpartition("*")[2]
    return first, last, segment[len(first) : len(segment) - len(last)]


class Trie:
    def __init__(self, globs: Iterable[str]):
        self.root = Node()
        for number, glob in enumerate(globs):
            low = glob.lower()
            for plain in G.expand_braces(low) if "/" in low else [low]:
                self._add(plain, number)
        self.homes: dict[str, tuple[frozenset[int], list[Node]]] = {}

    def _add(self, glob: str, number: int) -> None:
        node, segments = self.root, glob.split("/")
        strict = "**" in segments  # then no wildcard stands for a slash, but a class that names it
        for segment in segments:
            if segment == "**":
                nxt = node.names.get("\0**")
                if nxt is None:
                    nxt = node.names["\0**"] = Node(loops=True)
            elif "{" in segment or LOOSE.search(segment) and not (strict and "[" not in segment and "(" not in segment and "\\" not in segment):
                node.rest.add(number)
                return
            elif "*" not in segment and "?" not in segment:
                nxt = node.names.setdefault(segment, Node())
            else:
                nxt = self._wild(node, segment)
            node = nxt
        node.ends.add(number)

    @staticmethod
    def _wild(node: Node, segment: str) -> Node:
        first, last, middle = _ends(segment)
        by, end, other = (node.suffixes, last, first) if len(last) >= len(first) else (node.prefixes, first, last)
        held = by.setdefault(len(end), {}).setdefault(end, []) if end else node.every
        for known, _, nxt in held:
            if known == segment:
                return nxt
        nxt = Node()
        check = None if middle == "*" and not other else re.compile(G._segment(segment, True), re.S).fullmatch
        held.append((segment, check, nxt))
        return nxt

    def _step(self, nodes: list[Node], name: str) -> list[Node]:
        out: dict[int, Node] = {}

        def reach(node: Node) -> None:
            out[id(node)] = node
            if (more := node.names.get("\0**")) is not None and id(more) not in out:
                reach(more)

        for node in nodes:
            if node.loops:
                reach(node)
            if (nxt := node.names.get(name)) is not None:
                reach(nxt)
            for size, held in node.suffixes.items():
                for _, check, nxt in held.get(name[-size:], ()) if len(name) >= size else ():
                    if check is None or check(name):
                        reach(nxt)
            for size, held in node.prefixes.items():
                for _, check, nxt in held.get(name[:size], ()):
                    if check is None or check(name):
                        reach(nxt)
            for _, check, nxt in node.every:
                if check is None or check(name):
                    reach(nxt)
        return list(out.values())

    def _start(self) -> list[Node]:
        nodes, node = [self.root], self.root
        while (node := node.names.get("\0**")) is not None:
            nodes.append(node)
        return nodes

    def _home(self, home: str) -> tuple[frozenset[int], list[Node]]:
        """The globs that take whatever lies below a directory, and the nodes that it leads to; of directories above, remembered."""
        new, at = [], home
        while at not in self.homes and at is not None:
            new.append(at)
            at = at.rpartition("/")[0] if "/" in at else None
        taken, nodes = (frozenset(), self._start()) if at is None else self.homes[at]
        if len(self.homes) >= REMEMBERED:
            self.homes.clear()
        for at in reversed(new):
            taken = taken.union(*(n.rest for n in nodes))
            nodes = self._step(nodes, at.rpartition("/")[2])
            self.homes[at] = taken, nodes
        return taken, nodes

    def candidates(self, path: str) -> set[int]:
        """Numbers of the globs that may match a path in lower case."""
        home, slash, name = path.rpartition("/")
        taken, nodes = self._home(home) if slash else (frozenset(), self._start())
        out = set(taken).union(*(n.rest for n in nodes))
        for n in self._step(nodes, name):
            out |= n.ends | n.rest
        return out


@lru_cache(4)
def trie(globs: tuple[str, ...]) -> Trie:
    """One for each Python worker."""
    return Trie(globs)
