"""Bounds of the Ratcliff-Obershelp ratio 2 M / T (M matched letters, T both lengths) that spare nearly all ratios, in numpy.

Matched letters are a common subsequence, so M is at most the longest one (LCS), and at most the letters that both share. They stand in
k runs, between two of which at least one letter is unmatched, so k <= T - 2 M + 1; a run of l letters holds l - 1 adjacent pairs
that both texts have. A ratio of at least r therefore needs, with M = ceil(r T / 2), 3 M - T - 1 common pairs of letters.

An index of names finds those that have enough pairs by counting over the lists of names that hold each of a text's pairs, without
the longest lists: a name may lack so many fewer. Windows of a text are chosen by running sums of the same pairs."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import repeat

import numpy as np

EPS = 1e-9
WORD = 63  # letters that fit a 64-bit row of the LCS
CELLS = 1 << 20  # of windows that are counted at once


def letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def least_matched(total: np.ndarray | int, threshold: float) -> np.ndarray:
    """Letters that must match for the ratio to reach the threshold."""
    return np.ceil(threshold * np.asarray(total) / 2 - EPS).astype(np.int64)


def least_pairs(total: np.ndarray | int, threshold: float) -> np.ndarray:
    """Adjacent pairs of letters that must be common; 0 or less: any number."""
    return 3 * least_matched(total, threshold) - total - 1


def _numbered(owner: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Which repeat of its token each token of an owner is, from 0."""
    order = np.lexsort((token, owner))
    o, t = owner[order], token[order]
    new = np.append(True, (o[1:] != o[:-1]) | (t[1:] != t[:-1]))
    start = np.flatnonzero(new)
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return out


def pairs_of(text: np.ndarray) -> np.ndarray:
    return (text[:-1] << 21) | text[1:]


def common_subsequence(text: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """LCS of a text of at most WORD letters with each row of a matrix of letters (-1: none), a letter of all rows at a time."""
    alphabet, code = np.unique(text, return_inverse=True)
    masks = np.zeros(len(alphabet) + 1, np.uint64)
    np.bitwise_or.at(masks, code, np.uint64(1) << np.arange(len(text), dtype=np.uint64))
    at = np.searchsorted(alphabet, rows)
    at[(at == len(alphabet)) | (alphabet[np.minimum(at, len(alphabet) - 1)] != rows)] = len(alphabet)
    matched = masks[at]
    v = np.full(len(rows), np.uint64((1 << len(text)) - 1))
    for j in range(rows.shape[1]):
        u = v & matched[:, j]
        v = (v + u) | (v - u)
    return len(text) - np.bitwise_count(v & np.uint64((1 << len(text)) - 1)).astype(np.int64)


def places_of(a: str) -> dict[str, int]:
    """For each letter the places that it has in a text, as bits."""
    masks: dict[str, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    return masks


def long_subsequence(a: str, b: str, places: dict[str, int] | None = None) -> int:
    """LCS of two texts, by Python's long integers; places: places_of(a), if they are known."""
    masks, full = places_of(a) if places is None else places, (1 << len(a)) - 1
    v = full
    for m in map(masks.get, b, repeat(0)):
        u = v & m
        if u:
            v = (v + u) | (v - u)  # what is carried beyond the text's bits touches none of them
    return len(a) - (v & full).bit_count()


class NameIndex:
    """Names that a text can reach the threshold with. Counts of pairs that were looked at, by step, are in seen."""

    def __init__(self, names: list[str], threshold: float):
        order = sorted(range(len(names)), key=lambda i: len(names[i]))
        self.number, self.names, self.threshold = np.array(order, np.int64), [names[i] for i in order], threshold
        self.sizes = np.array([len(n) for n in self.names], np.int64)
        flat, at = letters("".join(self.names)), np.concatenate([[0], np.cumsum(self.sizes)])
        owner = np.repeat(np.arange(len(self.names)), self.sizes)
        inner = np.flatnonzero(owner[:-1] == owner[1:]) if len(flat) else np.zeros(0, np.int64)
        token, of = (flat[inner] << 21) | flat[inner + 1], owner[inner]
        repeat = _numbered(of, token)
        key = token * 64 + np.minimum(repeat, 63)  # a pair that a name has 64 times and more counts 64 times
        unique = np.unique(np.stack([key, of]), axis=1) if len(key) else np.zeros((2, 0), np.int64)
        self.keys, first = np.unique(unique[0], return_index=True)
        self.starts, self.posted = np.append(first, unique.shape[1]), unique[1].astype(np.int32)
        self.letters = np.full((len(self.names), int(self.sizes.max(initial=0))), -1, np.int64)
        self.letters[owner, np.arange(len(flat)) - at[:-1][owner]] = flat
        self.seen = {"pairs": 0, "length": 0, "letter pairs": 0, "subsequence": 0, "ratios": 0}

    def candidates(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Places in the index, and the most letters that can match."""
        size, r = len(text), self.threshold
        lo = int(np.searchsorted(self.sizes, np.ceil(size * r / (2 - r) - EPS)))
        hi = int(np.searchsorted(self.sizes, np.floor(size * (2 - r) / r + EPS), "right"))
        self.seen["pairs"] += len(self.names)
        self.seen["length"] += hi - lo
        if hi <= lo:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        total = self.sizes[lo:hi] + size
        need, own = least_pairs(total, r), letters(text)
        token = pairs_of(own)
        key = np.unique(token * 64 + np.minimum(_numbered(np.zeros(len(token), np.int64), token), 63))
        at = np.searchsorted(self.keys, key)
        at = at[(at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == key)] if len(self.keys) else at[:0]
        if need.max(initial=0) < 64 and need.min() > 0:
            spared = int(need.min()) // 2  # the longest lists are not read; a name can have all of these pairs
            at = at[np.argsort(self.starts[at] - self.starts[at + 1], kind="stable")][spared:] if spared else at
            lists = [self.posted[self.starts[i] : self.starts[i + 1]] for i in at]
            count = np.bincount(np.concatenate(lists), minlength=len(self.names))[lo:hi] if lists else np.zeros(hi - lo, np.int64)
            found = np.flatnonzero(count + spared >= need) + lo
        else:
            found = np.arange(lo, hi)
        self.seen["letter pairs"] += len(found)
        least = least_matched(self.sizes[found] + size, r)
        if size <= WORD:
            most = np.concatenate([common_subsequence(own, self.letters[part, : int(self.sizes[part].max())]) for part in np.array_split(found, max(1, len(found) // 4096))]) if len(found) else found
        else:
            most = np.array([long_subsequence(self.names[i], text) for i in found], np.int64)
        keep = most >= least
        self.seen["subsequence"] += int(keep.sum())
        return found[keep], most[keep]

    def matches(self, text: str) -> Iterator[tuple[int, float]]:
        """(number of the name, ratio) of all names whose ratio with the text reaches the threshold."""
        for i in self.candidates(text)[0].tolist():
            score = self._ratio(i, text)
            if score >= self.threshold:
                yield int(self.number[i]), score

    def best(self, text: str, rank: list) -> tuple[int, float] | None:
        """Of these names the one of the greatest (rank[0], ratio, length, rank[1:]); rank: a tuple for each name. Names that can't be it
        by their first rank and bound are passed over."""
        places, most = self.candidates(text)
        bound = 2.0 * most / (self.sizes[places] + len(text))
        first = [rank[self.number[i]][0] for i in places.tolist()]
        winner, out = None, None
        for j in sorted(range(len(first)), key=lambda j: (first[j], bound[j]), reverse=True):
            if winner is not None and (first[j] < winner[0] or first[j] == winner[0] and bound[j] < winner[1] - EPS):
                continue
            number = int(self.number[places[j]])
            score = self._ratio(int(places[j]), text)
            mine = (first[j], score, len(self.names[places[j]]), *rank[number][1:])
            if score >= self.threshold and (winner is None or mine > winner):
                winner, out = mine, (number, score)
        return out

    def _ratio(self, place: int, text: str) -> float:
        self.seen["ratios"] += 1
        name = self.names[place]
        return 1.0 if name == text else SequenceMatcher(None, name, text).ratio()


def _coded(tokens: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each token among the distinct ones of another array (how many there are: it isn't there), and how often each stands there."""
    distinct, counts = np.unique(of, return_counts=True)
    if not len(distinct):
        return np.zeros(len(tokens), np.int64), counts
    at = np.minimum(np.searchsorted(distinct, tokens), len(distinct) - 1)
    return np.where(distinct[at] == tokens, at, len(distinct)), counts


def _shared(codes: np.ndarray, counts: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Of codes and counts (_coded) the tokens that each window has in common with the other array, repeats as often as both have them."""
    kinds, out = len(counts) + 1, np.zeros(len(starts), np.int64)
    codes = np.append(codes, np.full(width, len(counts)))
    some = max(1, CELLS // (width + kinds))
    for lo in range(0, len(starts), some):
        inside = codes[starts[lo : lo + some, None] + np.arange(width)]
        n = len(inside)
        cells = np.bincount((inside + np.arange(n)[:, None] * kinds).ravel(), minlength=n * kinds).reshape(n, kinds)
        out[lo : lo + some] = np.minimum(cells[:, :-1], counts).sum(1)
    return out


def hopeful_windows(needle: str, text: str, threshold: float, step: int) -> np.ndarray:
    """Starts of windows (of the needle's length and a step more, a step apart) that the ratio can reach the threshold in, by the
    pairs of letters that they have in common with the needle, then by the letters and by the pairs, repeats counted."""
    a, m = letters(needle), letters(text)
    starts = np.arange(0, len(m) - len(a) + 1, step)
    width = len(a) + step
    ends = np.minimum(starts + width, len(m))
    total = len(a) + ends - starts
    need = least_pairs(total, threshold)
    paired = need.max(initial=0) > 0
    if paired:
        codes, counts = _coded(pairs_of(m), pairs_of(a))
        seeds = np.concatenate([[0], np.cumsum(codes < len(counts))])
        some = seeds[ends - 1] - seeds[starts] >= need
        starts, total, need = starts[some], total[some], need[some]
    if len(starts):
        some = _shared(*_coded(m, a), starts, width) >= least_matched(total, threshold)
        starts, need = starts[some], need[some]
    if paired and len(starts):
        starts = starts[_shared(codes, counts, starts, width - 1) >= need]
    return starts


def reachable(a: str, b: str, threshold: float) -> bool:
    """Whether the ratio of two texts can reach the threshold, by their lengths, then by their longest common subsequence."""
    least = int(least_matched(len(a) + len(b), threshold))
    return min(len(a), len(b)) >= least and long_subsequence(a, b) >= least


def best_window(needle: str, text: str, threshold: float, parts: int) -> float:
    """The ratio of the first window of text that reaches the threshold with the needle; 1 if the needle stands in it. Below the threshold
    the result is some window's ratio or 0, a lower bound. A text shorter than the needle is one window."""
    if not needle or not text:
        return 0.0
    if needle in text:
        return 1.0
    n = len(needle)
    if len(text) < n:
        return SequenceMatcher(None, needle, text).ratio() if reachable(needle, text, threshold) else 0.0
    step, best = max(1, n // parts), 0.0
    at = hopeful_windows(needle, text, threshold, step)
    width = n + step
    if n <= WORD and len(at):
        m = np.append(letters(text), np.full(width, -1))
        lcs = np.concatenate([common_subsequence(letters(needle), m[part[:, None] + np.arange(width)]) for part in np.array_split(at, max(1, len(at) // 1024))])
        at = at[lcs >= least_matched(n + np.minimum(at + width, len(text)) - at, threshold)]
    places = places_of(needle) if n > WORD and len(at) else {}
    for i in at.tolist():
        window = text[i : i + width]
        if n > WORD and long_subsequence(needle, window, places) < least_matched(n + len(window), threshold):
            continue
        best = max(best, SequenceMatcher(None, needle, window).ratio())
        if best >= threshold:
            break
    return best
