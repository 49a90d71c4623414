"""Deep-shallow suffix sorting of many suffixes at once, in numpy.

Shallow: a multikey sort whose characters are 8-byte words; each round splits the groups of equal prefixes by the next
word, to SHALLOW words. Deep: each remaining group gets a blind trie. A member is its leader; the others are compared
with the leader only, which gives the depth where they branch off and the byte there, the trie's branching node. Those
that branch below the leader stand before it, the shallow branches first; the others after it, the deep branches first.
Members that share a branch form the next group, whose common prefix is known and not read again.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 2


def words_at(data: np.ndarray) -> np.ndarray:
    """A view of the 8 bytes at each place as a big-endian number; data ends with 8 bytes of padding."""
    return np.ndarray(len(data) - 7, dtype=">u8", buffer=data, strides=(1,))


def _heads(same: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], ~same])) if len(same) or True else same


def suffix_order(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at starts by their first depth bytes (a multiple of 8), and the common prefix of each with
    the one before it in that order (0 for the first, depth at most). data holds depth + 8 bytes from each start."""
    n = len(starts)
    order, lcp = np.arange(n), np.zeros(n, np.int32)
    if n < 2:
        return order, lcp
    view = words_at(data)
    # shallow: all suffixes, then only groups of more than one
    word = view[starts].astype(np.uint64)
    order = np.argsort(word, kind="stable")
    places = np.arange(n)  # places in the order that are still to be sorted
    group = np.zeros(n, np.int64)
    known = 0
    for level in range(1, SHALLOW + 1):
        cut = group[1:] != group[:-1]
        differ = word[order[places]][1:] != word[order[places]][:-1] if level == 1 else sorted_word[1:] != sorted_word[:-1]
        here = level == 1
        w = word[order[places]] if here else sorted_word
        new = differ & ~cut
        lcp[places[1:][new]] = known + common_bytes(w[1:][new], w[:-1][new])
        head = np.concatenate([[True], cut | differ])
        group = np.cumsum(head)
        known += 8
        size = np.bincount(group)
        live = size[group] > 1
        places, group = places[live], group[live]
        if level == SHALLOW or not len(places):
            break
        w = view[starts[order[places]] + known].astype(np.uint64)
        again = np.lexsort((w, group))
        order[places] = order[places][again]
        sorted_word = w[again]
    if len(places):
        _blind(view, starts, depth, order, lcp, places, group, np.full(len(places), known, np.int32))
    return order, lcp


def common_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bytes that two different words share."""
    x = a ^ b
    n = np.zeros(len(x), np.int32)
    for shift in (32, 16, 8):
        zero = x >> np.uint64(64 - shift) == 0
        n[zero] += shift // 8
        x = np.where(zero, x << np.uint64(shift), x)
    return n


def _blind(view, starts, depth, order, lcp, places, group, known) -> None:
    """Sorts the groups (runs of places with one group number) by blind tries. known: the common prefix within the group."""
    while len(places):
        head = np.concatenate([[True], group[1:] != group[:-1]])
        first = np.flatnonzero(head)
        of = np.cumsum(head) - 1
        who = order[places]
        leader = who[first][of]
        # depth where each member leaves its leader, and on which side
        branch = np.full(len(places), depth, np.int32)
        side = np.zeros(len(places), np.int8)
        byte = np.zeros(len(places), np.int16)
        at = known - known % 8
        open_ = np.flatnonzero(~head)
        while len(open_):
            a = view[starts[who[open_]] + at[open_]].astype(np.uint64)
            b = view[starts[leader[open_]] + at[open_]].astype(np.uint64)
            differ = a != b
            if differ.any():
                o, x, y = open_[differ], a[differ], b[differ]
                c = common_bytes(x, y)
                branch[o] = at[o] + c
                side[o] = np.where(x < y, -1, 1)
                byte[o] = x >> (56 - 8 * c).astype(np.uint64) & np.uint64(255)
            at[open_] += 8
            open_ = open_[~differ & (at[open_] < depth)]
        key = np.where(side < 0, branch, np.where(side > 0, 2 * depth + 2 - branch, depth))  # less: shallow first; greater: deep first
        again = np.lexsort((byte, key, of))
        order[places] = who[again]
        of, branch, side, byte, key = of[again], branch[again], side[again], byte[again], key[again]
        same_group = of[1:] == of[:-1]
        # between neighbours: within the equals depth; else the lesser of both branches, unless they share a node
        shared = same_group & (key[1:] == key[:-1]) & (byte[1:] == byte[:-1])
        between = np.minimum(branch[1:], branch[:-1])
        lcp[places[1:][same_group]] = between[same_group]
        sub = np.cumsum(np.concatenate([[True], ~shared]))
        size = np.bincount(sub)
        live = (size[sub] > 1) & (side != 0)
        places, group, known = places[live], sub[live], branch[live] + 1
