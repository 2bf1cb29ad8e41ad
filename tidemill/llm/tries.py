"""Double-array tries over words, built and walked with numpy.

A word is two digits of its code in the trie's alphabet, so a node's children lie within one radix. From
state s, digit c leads to t = base[s] + c if check[t] == s.
"""

from __future__ import annotations

import numpy as np

ROOT = 0


def _place(parent: np.ndarray, digit: np.ndarray, radix: int, rng) -> tuple[np.ndarray, np.ndarray, int]:
    """(base of each parent, slot of each child, number of slots); children stand by parent. Parents with
    many children go first, while there is room; only children fill what is left."""
    first = np.flatnonzero(np.append(True, parent[1:] != parent[:-1])) if len(parent) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(parent)))
    base, slot = np.zeros(int(parent.max(initial=0)) + 1, np.int64), np.zeros(len(parent), np.int64)
    used = np.zeros(2 * len(parent) + 2 * radix + 2, bool)
    used[ROOT] = True
    order, top = np.argsort(-size, kind="stable"), 1
    wide = order[size[order] > 8]
    for g in wide:  # one after another: the first place that fits
        digits = digit[first[g] : first[g] + size[g]]
        while True:
            if top + 64 + radix >= len(used):
                used = np.append(used, np.zeros(len(used), bool))
            tries = np.arange(top, top + 64)
            free = np.flatnonzero(~used[tries[:, None] + digits].any(axis=1))
            if len(free):
                break
            top += 64
        base[parent[first[g]]] = tries[free[0]]
        slot[first[g] : first[g] + size[g]] = tries[free[0]] + digits
        used[slot[first[g] : first[g] + size[g]]] = True
        top = max(top, int(tries[free[0]]) - 2 * radix)
    for k in range(8, 1, -1):  # all of a size at once, at random; those that collide try again
        left = first[size == k]
        while len(left):
            if int(used.sum()) * 5 > 2 * len(used):
                used = np.append(used, np.zeros(len(used) // 2, bool))
            at = left[:, None] + np.arange(k)
            start = rng.integers(1, len(used) - radix - 1, len(left))
            want = start[:, None] + digit[at]
            flat = want.ravel()
            seen, where = np.unique(flat, return_index=True)
            alone = np.zeros(len(flat), bool)
            alone[where] = True
            fits = (alone & ~used[flat]).reshape(want.shape).all(axis=1)
            base[parent[left[fits]]] = start[fits]
            slot[at[fits].ravel()] = want[fits].ravel()
            used[want[fits].ravel()] = True
            left = left[~fits]
    single = first[size == 1]
    room = np.flatnonzero(~used)
    if len(room) < len(single):
        room = np.append(room, len(used) + np.arange(len(single) - len(room)))
    slot[single] = room[: len(single)]
    base[parent[single]] = slot[single] - digit[single]
    return base, slot, int(slot.max(initial=ROOT)) + 2


class Trie:
    """base and check of a set of phrases; ``ends`` has each phrase's last state, in the order given."""

    def __init__(self, codes: np.ndarray, radix: int):
        """codes: (phrases, longest) symbols below radix * radix of distinct phrases, -1 after a shorter one's end."""
        self.radix = radix
        n, depth = codes.shape
        digits = np.stack([np.where(codes >= 0, codes // self.radix, -1), np.where(codes >= 0, codes % self.radix, -1)], axis=2).reshape(n, 2 * depth)
        order = np.lexsort(digits.T[::-1])
        digits = digits[order]
        node, above, known = np.zeros(n, np.int64), [], 1
        own = np.zeros(n, np.int64)
        differs = np.zeros(n, bool)
        differs[:1] = True
        for d in range(2 * depth):
            differs[1:] |= digits[1:, d] != digits[:-1, d]
            live = digits[:, d] >= 0
            new = np.flatnonzero(differs & live)
            if not len(new):
                break
            above.append(np.stack([node[new], digits[new, d]]))
            number = known + np.cumsum(differs & live) - 1
            node = np.where(live, number, node)
            own = np.where(live, node, own)
            known += len(new)
        parent, digit = np.concatenate(above, axis=1) if above else np.zeros((2, 0), np.int64)
        by = np.lexsort((digit, parent))
        base, slot, size = _place(parent[by], digit[by], self.radix, np.random.default_rng(0))
        state = np.zeros(known, np.int64)
        state[by + 1] = slot
        self.base, self.check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        inner = np.unique(parent)
        self.base[state[inner]] = base[inner]
        self.check[state[1:]] = state[parent]
        self.ends = np.zeros(n, np.int64)
        self.ends[order] = state[own]

    @classmethod
    def together(cls, tries: list, radix: int) -> tuple[Trie, np.ndarray]:
        """Several tries in one pair of arrays, and the root of each; each is called for its (base, check) twice."""
        trie, size = cls.__new__(cls), [len(x()[0]) for x in tries]
        roots = np.cumsum([0, *size[:-1]])
        trie.base, trie.check, trie.radix = np.empty(sum(size), np.int32), np.empty(sum(size), np.int32), radix
        for x, root, n in zip(tries, roots, size):
            base, check = x()
            trie.base[root : root + n] = base + root
            trie.check[root : root + n] = np.where(check >= 0, check + root, -1)
        return trie, roots

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The states after one more symbol each; -1 where there is none, or the symbol is -1."""
        for digit in (symbols // self.radix, symbols % self.radix):
            t = np.clip(self.base[states] + digit, 0, len(self.check) - 1)
            states = np.where((self.check[t] == states) & (symbols >= 0) & (states >= 0), t, -1)
        return states
