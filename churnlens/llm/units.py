"""Units: pieces of a text whose token ids do not depend on what stands around them.

A single space between two non-space characters always starts a new pre-token in byte-level
BPE (the space joins the word after it), and any space separates words where white space is
dropped. So a text is cut before such spaces and encoded unit by unit; a bounded cache keeps
the result of units that come again. Added tokens without white space lie inside one unit.
A text in which a space has another space character beside it is cut by a regular expression
at its safe spaces only.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

#: Units kept by one Python worker, and their characters, in two generations of half of it each.
CACHE_UNITS = 400_000
CACHE_CHARS = 8 << 20
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_UNSAFE = ...   # cached for a unit with a space character at an edge


class UnitCache:
    """Results of ``compute(list of units)`` for the units seen lately.

    With ``edges`` a unit that is empty or has a space character at an edge is marked unsafe.
    """

    def __init__(self, compute: Callable[[list[str]], list], limit: int = CACHE_UNITS, edges: bool = True):
        self.compute, self.half, self.edges = compute, limit // 2, edges
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}
        self.chars = 0      # of the young keys

    def room(self, keys: int, chars: int) -> bool:
        """True if so many more keys may stand beside the young ones."""
        return not self.young or (len(self.young) + keys <= self.half and self.chars + chars <= CACHE_CHARS // 2)

    def age(self) -> None:
        self.old, self.young, self.chars = self.young, {}, 0

    def fill(self, keys: set[str]) -> dict[str, object]:
        """A dict that has every unit of ``keys``."""
        new = keys - self.young.keys()
        chars = len("".join(new))
        if not self.room(len(new), chars):
            self.age()
            new, chars = keys, len("".join(keys))
        self.chars += chars
        young, old = self.young, self.old
        for k in new & old.keys():
            young[k] = old[k]
        miss = list(new - old.keys())
        if self.edges:
            unsafe = {k for k in miss if not k or k.strip() is not k}
            if unsafe:
                young.update(dict.fromkeys(unsafe, _UNSAFE))
                miss = [k for k in miss if k not in unsafe]
        if miss:
            young.update(zip(miss, self.compute(miss)))
        return young


def added_tokens_are_local(path: str) -> bool:
    """False if an added token holds white space or takes it in; texts must not be cut then."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens") or []
    return not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"]
                   or t["normalized"] for t in added)


def combined_units(texts: list[str], cache: UnitCache, raw: Callable[[list[str]], list],
                   combine: Callable[[list], object]) -> Iterator:
    """For each text ``combine`` of the values of its units, in order.

    ``cache`` computes units that follow a space (which belongs to them), ``raw`` strings as
    they are: first units, and last ones that may end in white space. ``combine`` (a sum or a
    join) raises TypeError on the mark of an unsafe unit.
    """
    parts = [t.split(" ") for t in texts]
    heads = raw([p[0] for p in parts])
    edges = [cache.edges and len(p) > 1 and p[0][-1:].isspace() for p in parts]
    for p in parts:
        del p[0]
    got = cache.fill(set().union(*parts)).__getitem__
    for text, head, edge, rest in zip(texts, heads, edges, parts):
        try:
            if edge:
                raise TypeError
            values = list(map(got, rest))
            values.insert(0, head)
            yield combine(values)
        except TypeError:
            yield combine(_safe_values(text, cache, raw))


def _safe_values(text: str, cache: UnitCache, raw: Callable[[list[str]], list]) -> list:
    part = _SAFE.split(text)
    if len(part) == 1:
        return raw(part)
    head, tail = raw([part[0], " " + part[-1]])
    # A second dict: the caller still reads the cache's.
    inner = list(dict.fromkeys(part[1:-1]))
    got = dict(zip(inner, cache.compute(inner))) if inner else {}
    return [head, *map(got.__getitem__, part[1:-1]), tail]
