"""Suffix order of one shard by induced sorting, with queues that go to disk."""

from __future__ import annotations

import tempfile

import numpy as np

#: Bytes of waiting tuples that a shard's queues hold in memory; what is over goes to disk.
IN_MEMORY = 96_000_000
_TUPLE = np.dtype([("at", "<i4"), ("lcp", "u1")])


class DiskQueues:
    """A priority queue of (suffix, common prefix) tuples: lowest first character first, then by arrival.

    Induction adds tuples of a character in their final order, so that order of arrival is order
    within a character. Over ``limit`` bytes, all waiting tuples go to a temporary file.
    """

    def __init__(self, size: int, limit: int):
        self.parts: list[list] = [[] for _ in range(size)]
        self.limit, self.held = limit, 0
        self.file = tempfile.TemporaryFile()

    def push(self, char: int, at: np.ndarray, lcp: np.ndarray) -> None:
        part = np.empty(len(at), _TUPLE)
        part["at"], part["lcp"] = at, lcp
        self.parts[char].append(part)
        self.held += part.nbytes
        if self.held > self.limit:
            for parts in self.parts:
                for k, x in enumerate(parts):
                    if isinstance(x, np.ndarray):
                        parts[k] = (self.file.seek(0, 2), len(x))
                        self.file.write(x.tobytes())
            self.held = 0

    def pop(self, char: int) -> np.ndarray:
        """All waiting tuples of a character, which leave the queue."""
        out = [np.zeros(0, _TUPLE)]
        for x in self.parts[char]:
            if isinstance(x, tuple):
                self.file.seek(x[0])
                x = np.frombuffer(self.file.read(x[1] * _TUPLE.itemsize), _TUPLE)
            else:
                self.held -= x.nbytes
            out.append(x)
        self.parts[char] = []
        return np.concatenate(out)

    def close(self) -> None:
        self.file.close()


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix lengths of pairs of suffixes, up to ``depth``; text is padded by as much."""
    out = np.full(len(a), depth, np.uint8)
    left = np.arange(len(a))
    for k in range(depth):
        same = text[a[left] + k] == text[b[left] + k]
        out[left[~same]] = k
        left = left[same]
        if not len(left):
            break
    return out


def _refine(rank: np.ndarray, some: np.ndarray, key: np.ndarray) -> None:
    """Order members of equal rank among ``some`` by key; a rank is the place of its first member."""
    by_key = np.argsort(key)
    packed = (rank[some][by_key] << 32) | np.arange(len(some))
    packed.sort()
    order = some[by_key[packed & (2**32 - 1)]]
    back = np.empty(len(rank), key.dtype)
    back[some] = key
    r, k = rank[order], back[order]
    group = np.concatenate(([True], r[1:] != r[:-1]))
    part = group | np.concatenate(([True], k[1:] != k[:-1]))
    place = np.arange(len(order))
    rank[order] = r + place[np.maximum.accumulate(np.where(part, place, 0))] - place[np.maximum.accumulate(np.where(group, place, 0))]


def _tied(rank: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)


def _sample_ranks(text: np.ndarray, sample: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the sample suffixes by their first ``depth`` characters.

    Substrings between sample positions get names in their order; the string of names, at most half
    as long, is ordered by doubling. A name that ends where another goes on comes after it, since its
    last character begins a rise and the other's does not.
    """
    length = np.minimum(np.append(np.diff(sample) + 1, 1), depth)
    rank = np.zeros(len(sample), np.int64)
    for at in range(0, int(length.max()), 7):
        some = _tied(rank)
        if at:
            longer = np.zeros(len(sample), bool)
            longer[rank[length > at]] = True
            some = some[longer[rank[some]]]
        word = np.zeros(len(some), np.int64)
        for k in range(at, at + 7):
            word = word << 9 | np.where(length[some] > k, text[sample[some] + k], 511)
        _refine(rank, some, word)
    step = 1
    while 2 * step <= depth:
        some = _tied(rank)
        if not len(some):
            break
        after = some + step
        _refine(rank, some, np.where(after < len(rank), rank[np.minimum(after, len(rank) - 1)], -1))
        step *= 2
    return rank


class _Inducer:
    """Pushes the left neighbours of a sorted run of suffixes, with their common prefixes."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, queues: DiskQueues, size: int, depth: int):
        self.text, self.wanted, self.queues, self.depth = text, wanted, queues, depth
        self.since = np.zeros(size, np.int64)  # least common prefix since the last push, by character
        self.begun = np.zeros(size, bool)

    def feed(self, at: np.ndarray, lcp: np.ndarray) -> None:
        if not len(at):
            return
        chosen = np.flatnonzero((at > 0) & self.wanted[at - 1])
        char = self.text[at[chosen] - 1].astype(np.int64)
        order = np.argsort(char, kind="stable")
        chosen, char = chosen[order], char[order]
        least = int(lcp.min())
        last = np.full(len(self.since), -1)
        if len(chosen):
            heads = np.concatenate(([True], char[1:] != char[:-1]))
            before = np.where(heads, -1, np.concatenate(([-1], chosen[:-1])))
            width = chosen - before
            level = np.frexp(width.astype(np.float64))[1] - 1
            low = np.empty(len(chosen), np.int64)
            table = lcp
            for k in range(int(level.max()) + 1):
                if k:
                    table = np.minimum(table[: -(1 << k - 1)], table[1 << k - 1 :])
                now = np.flatnonzero(level == k)
                low[now] = np.minimum(table[before[now] + 1], table[chosen[now] - (1 << k) + 1])
            first = np.flatnonzero(heads)
            low[first] = np.where(self.begun[char[first]], np.minimum(low[first], self.since[char[first]]), -1)
            value = np.minimum(low + 1, self.depth).astype(np.uint8)
            for a, z in zip(first.tolist(), [*first[1:].tolist(), len(chosen)]):
                self.queues.push(int(char[a]), at[chosen[a:z]] - 1, value[a:z])
                last[char[a]] = chosen[z - 1]
            self.begun[char[first]] = True
        # what lies behind each character's last push
        tail = np.append(np.minimum.accumulate(lcp[::-1])[::-1], self.depth)
        self.since = np.where(last >= 0, tail[last + 1], np.minimum(self.since, least))


def suffix_order(text: np.ndarray, size: int, depth: int, limit: int = IN_MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` characters, and common prefixes with the one before.

    ``text`` holds characters from 0 to ``size`` - 1 and ends with 0. The suffixes that begin a rise
    after a fall are ordered first; those that fall are induced from them in ascending order, those
    that rise from these in descending order. Each induced tuple carries its common prefix: one more
    than the least between the two suffixes that induced it and its forerunner.
    """
    n = len(text)
    padded = np.concatenate((text, np.zeros(depth + 8, text.dtype)))
    change = np.flatnonzero(text[:-1] != text[1:])
    rises = np.concatenate((text[change] < text[change + 1], [True]))
    rises = rises[np.searchsorted(change, np.arange(n))]
    sample = np.flatnonzero(rises[1:] & ~rises[:-1]) + 1
    ranked = sample[np.argsort(_sample_ranks(padded, sample, depth), kind="stable")].astype(np.int32)
    shared = np.concatenate((np.zeros(1, np.uint8), common_prefix(padded, ranked[1:], ranked[:-1], depth)))
    cuts = np.searchsorted(text[ranked], np.arange(size + 1))

    def seam(a: np.ndarray, b: np.ndarray) -> int:
        return int(common_prefix(padded, a[-1:], b[:1], depth)[0]) if len(a) and len(b) else 0

    falls: list[np.ndarray] = []
    queues = DiskQueues(size, limit)
    inducer = _Inducer(text, ~rises, queues, size, depth)
    for c in range(size):
        inducer.since[:] = 0
        found = [np.zeros(0, _TUPLE)]
        while len(part := queues.pop(c)):
            found.append(part)
            inducer.feed(part["at"], part["lcp"])
        found = np.concatenate(found)
        falls.append(found)
        at, lcp = ranked[cuts[c] : cuts[c + 1]], shared[cuts[c] : cuts[c + 1]].copy()
        if len(at):
            lcp[0] = seam(found["at"], at)
            inducer.feed(at, lcp)
    queues.close()

    queues = DiskQueues(size, limit)
    inducer = _Inducer(text, rises, queues, size, depth)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for c in range(size - 1, -1, -1):
        inducer.since[:] = 0
        found = [np.zeros(0, _TUPLE)]
        while len(part := queues.pop(c)):
            found.append(part)
            inducer.feed(part["at"], part["lcp"])
        if c == 0:  # the end of the text comes before all else
            found.append(np.array([(n - 1, 0)], _TUPLE))
        found = np.concatenate(found)
        fall = falls[c]
        joint = seam(fall["at"], found["at"][::-1])
        if len(fall):
            inducer.feed(fall["at"][::-1], np.concatenate(([joint], fall["lcp"][:0:-1])).astype(np.uint8))
        lcp = np.concatenate((fall["lcp"], [joint], found["lcp"][:0:-1]) if len(found) else (fall["lcp"],)).astype(np.uint8)
        out.append((np.concatenate((fall["at"], found["at"][::-1])), lcp))
    queues.close()
    out.reverse()
    lcp = np.concatenate([x for _, x in out])
    starts = np.cumsum([0, *(len(x) for x, _ in out[:-1])])
    lcp[starts[starts < len(lcp)]] = 0
    return np.concatenate([x for x, _ in out]), lcp
