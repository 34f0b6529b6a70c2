"""The names most like a mention, by an inverted index that is read only as far as the answer needs."""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Collection, Iterator

#: Names of a list that are looked at together.
BLOCK = 128


class NameIndex:
    """Names of canonicals, each list in the order that breaks ties: by canonical.

    lists has each character's names, pairs those of two neighbouring characters; a name's characters are a bit mask. A canonical
    is as like a mention as its best name: first those of which one holds the other, then by the number of characters that
    both have, then by canonical.

    A name that shares t of a mention's n characters stands in one of the lists of its n - t + 1 rarest characters. So
    the lists are opened one by one, the shortest first, and after the j-th all names that share more than n - j are known.
    What has k better ones is never looked at, and of equal ones only the first.
    """

    def __init__(self) -> None:
        self.bit: dict[str, int] = {}
        self.lists: dict[str, list[tuple[str, str, int]]] = {}
        self.pairs: dict[str, list[tuple[str, str]]] = {}
        self.canonicals: list[str] = []
        self.masks: dict[str, list[int]] = {}
        self.of_name: dict[str, list[str]] = {}
        self.longest = self.size = 0
        self.looked_at = 0  # names, over all calls

    def add(self, canonical: str, name: str) -> None:
        """A name of a canonical; one that's there already changes nothing."""
        own = self.of_name.setdefault(name, [])
        if (at := bisect_left(own, canonical)) < len(own) and own[at] == canonical:
            return
        own.insert(at, canonical)
        self.longest, self.size = max(self.longest, len(name)), self.size + 1
        mask = 0
        for c in set(name):
            mask |= self.bit.setdefault(c, 1 << len(self.bit))
        self.masks.setdefault(canonical, []).append(mask)
        for c in set(name):
            insort(self.lists.setdefault(c, []), (canonical, name, mask))
        for g in {name[i : i + 2] for i in range(len(name) - 1)}:
            insort(self.pairs.setdefault(g, []), (canonical, name))
        if (at := bisect_left(self.canonicals, canonical)) == len(self.canonicals) or self.canonicals[at] != canonical:
            self.canonicals.insert(at, canonical)

    def mask(self, mention: str) -> int:
        return sum(self.bit.get(c, 0) for c in set(mention))

    def holding(self, mention: str) -> Iterator[str]:
        """Canonicals by order with a name that the mention is part of, all of which share all its characters. They stand in the list of its rarest pair, or of its only character."""
        if len(mention) < 2:
            yield from (c for c, _, _ in self.lists.get(mention, ()))
            return
        rarest = min((self.pairs.get(mention[i : i + 2], ()) for i in range(len(mention) - 1)), key=len)
        for c, name in rarest:
            self.looked_at += 1
            if mention in name:
                yield c

    def held(self, mention: str) -> set[str]:
        """Canonicals with a name that is part of the mention."""
        n = len(mention)
        return {c for i in range(n) for j in range(i + 1, min(n, i + self.longest) + 1) for c in self.of_name.get(mention[i:j], ())}

    def by_shared(self, mention: str) -> Iterator[tuple[str, int]]:
        """Canonicals with the characters that a name shares with the mention, the most first, then by canonical; a canonical may come again with fewer."""
        letters, mask = set(mention), self.mask(mention)
        if self.size <= BLOCK:  # all names are looked at together
            self.looked_at += self.size
            best = {c: max([(m & mask).bit_count() for m in masks]) for c, masks in self.masks.items()}
            yield from sorted(best.items(), key=lambda x: (-x[1], x[0]))
            return
        lists = sorted((self.lists[c] for c in letters if c in self.lists), key=len)
        known: list[list[str]] = [[] for _ in range(len(lists) + 1)]  # by what they share
        read = 0  # bits of the characters whose lists are read
        for level in range(len(lists), 0, -1):  # all that share `level` or more are in the lists opened up to here
            new = lists[len(lists) - level]
            own = next(c for c in letters if self.lists.get(c) is new)

            def opened(new: list = new, read: int = read, level: int = level) -> Iterator[str]:
                for at in range(0, len(new), BLOCK):
                    fresh = [((m & mask).bit_count(), c) for c, _, m in new[at : at + BLOCK] if not m & read]  # others were met in an earlier list
                    self.looked_at += len(fresh)
                    for n, c in fresh:
                        if n == level:
                            yield c
                        else:
                            known[n].append(c)

            yield from ((c, level) for c in heapq.merge(sorted(known[level]), opened()))
            read |= self.bit[own]
        yield from ((c, 0) for c in self.canonicals)

    def most_alike(self, mention: str, k: int, passed_over: Collection[str] = ()) -> list[tuple[str, bool, int]]:
        """The k canonicals most like the mention without those passed over and the mention itself: each with whether a name and the mention hold each other, and the characters shared."""
        if k <= 0:
            return []
        if not mention:  # part of every name
            return [(c, True, 0) for c in sorted(self.first(iter(self.canonicals), k, mention, passed_over))]
        part = self.first(self.holding(mention), k, mention, passed_over) | self.first(iter(self.held(mention)), len(self.canonicals), mention, passed_over)
        mask = self.mask(mention)
        best = {c: max((m & mask).bit_count() for m in self.masks[c]) for c in part}
        out = {c: (True, best[c]) for c in sorted(part, key=lambda c: (-best[c], c))[:k]}
        if len(out) < k:
            for c, n in self.by_shared(mention):
                if c not in out and c != mention and c not in passed_over:
                    out[c] = False, n
                    if len(out) == k:
                        break
        return [(c, *x) for c, x in out.items()]

    @staticmethod
    def first(found: Iterator[str], k: int, mention: str, passed_over: Collection[str]) -> set[str]:
        """The first k different ones that count."""
        out: set[str] = set()
        for c in found:
            if c != mention and c not in passed_over:
                out.add(c)
                if len(out) == k:
                    break
        return out
