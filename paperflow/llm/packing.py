"""Hierarchical multi-length packing of tokenised documents into context windows.

Documents are tokenised where they are read and packed in the same task, in groups of bounded token count: nothing is
shuffled. In each group a document longer than the longest window is cut into whole windows, and what is left of it, like
any shorter document, is routed to the smallest window that holds it. Each tier is packed from its own documents; the gap of
a long window is filled with whole documents of the shorter tiers (the longest that fits) and at the end with a cut piece,
so windows come out full. The remainder of a group is decomposed into shorter full windows, down to tail windows of powers of
two. Step groups take a fixed token budget of one tier, windows dealt in serpentine order of attention cost.

Nulls and odd input: a null or empty text is a document of the end token alone; a null id stays null; repeated rows are
documents of their own; other columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import json
import os
import zlib
from array import array
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy

TIERS = (256, 512, 1024, 2048)
END_ID = 1
GROUP_TOKENS = 2_000_000
STEP_WINDOWS = 32
CACHE_BYTES = 48 << 20
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_BYTE_LETTERS = {byte: 290 + k for k, byte in enumerate(range(128, 161))} | {173: 323}  # ByteLevel's letters for bytes that don't print
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, step_group long"


# How a tokenizer file must cut texts for its words never to span white space.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class WordTokenizer:
    """Ids of whole texts by a tokenizer file. If the file cuts texts as WORDWISE says, a word met before costs one look-up;
    any other tokenizer encodes whole texts.

    Words of Latin letters are encoded by the model itself, other words by the whole tokenizer. Texts with control white
    space or letters whose lower case depends on their place are left to the tokenizer whole. What is remembered is kept in
    two generations of cache_bytes each: words that come up again move to the younger one, the older one is dropped."""

    _odd = regex.compile(r"[\x1c-\x1f\x85]")
    _plain = regex.compile(r"[a-zß-öø-ÿ]+")

    def __init__(self, path: str, end_id: int = END_ID, cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        added = self.tokenizer.get_added_tokens_decoder()
        stated = {k: part and json.loads(part.__getstate__()) for k in ("normalizer", "pre_tokenizer") if (part := getattr(self.tokenizer, k)) or True}
        whole = self.tokenizer.post_processor is None and self.tokenizer.truncation is None
        self.wordwise = whole and stated == WORDWISE and all(x.content.startswith("<|") for x in added.values())
        largest = max(end_id, self.tokenizer.get_vocab_size(), *added)  # ids beyond 16 bits would raise an error, not wrap
        self.kind, self.code = ("<u2", "H") if largest < 1 << 16 else ("<u4", "I")
        self.cache_bytes, self.held = cache_bytes, 0
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def _unknown(self, words: set[str]) -> list[str]:
        """Those that the younger generation lacks, once it has taken what it can from the older one."""
        new = words.difference(self.cache)  # difference alone looks up the words; - and & go through all that is remembered
        lacking = new.difference(self.older)
        found = new - lacking
        self.cache.update((w, self.older[w]) for w in found)
        self._count(found)
        return list(lacking)

    def _count(self, words: Collection[str]) -> None:
        self.held += 170 * len(words) + 2 * sum(map(len, words)) + sum(map(len, map(self.cache.__getitem__, words)))

    def _letters(self, words: list[str]) -> None:
        """Remembers words of letters alone, encoded by the model itself; other letters than ASCII are spelled in its byte alphabet."""
        cache, code, tokenize = self.cache, self.code, self.model.tokenize
        for w in words:
            spelled = w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_LETTERS)
            cache[w] = array(code, [x.id for x in tokenize(spelled)]).tobytes()

    def _whole(self, words: list[str]) -> None:
        for w, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self.cache[w] = array(self.code, e.ids).tobytes()

    def _learn(self, words: list[str]) -> None:
        """Remembers new words (lower case, without white space). A word of letters with a tail of ASCII punctuation is its
        letters, then its tail."""
        cache, plain, cores, tailed, other = self.cache, [], set(), [], []
        for w in words:
            core = w if w.isalpha() else w.rstrip(_TAIL)
            if not (core.isalpha() and (core.isascii() or self._plain.fullmatch(core))):
                other.append(w)
            elif core is w:
                plain.append(w)
            else:
                cores.add(core)
                tailed.append((w, core, w[len(core) :]))
        new = self._unknown(cores.difference(plain))
        self._letters(plain + new)
        more = self._unknown({t for _, _, t in tailed}.difference(other))
        self._whole(other + more)
        for w, core, tail in tailed:
            cache[w] = cache[core] + cache[tail]
        self._count([*words, *new, *more])

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        split: list = [None] * len(texts)
        met: set[str] = set()
        for i, t in enumerate(texts):
            if not t:
                out[i] = np.zeros(0, self.kind)
            elif not self.wordwise or self._odd.search(t) or "<|" in t or "Σ" in t or "İ" in t:
                out[i] = self._encode(t)
            else:
                split[i] = t.lower().split()
                met.update(split[i])
        if self.held > self.cache_bytes:
            self.cache, self.older, self.held = {}, self.cache, 0
        self._learn(self._unknown(met))
        get = self.cache.__getitem__
        for i, words in enumerate(split):
            if words is not None:
                out[i] = np.frombuffer(b"".join(map(get, words)), self.kind)
        return out


class Packer:
    """Packs one group of documents, given by their lengths; windows are lists of (document, start, length)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tuple(sorted(tiers))

    def pack(self, lengths: list[int]) -> list[tuple[int, list[tuple[int, int, int]]]]:
        longest, windows = self.tiers[-1], []
        piles: dict[int, list[tuple[int, int, int]]] = {t: [] for t in self.tiers}  # sorted (length, document, start)
        for d, n in enumerate(lengths):
            at = 0
            while n - at >= longest:
                windows.append((longest, [(d, at, longest)]))
                at += longest
            if n - at:
                piles[next(t for t in self.tiers if t >= n - at)].append((n - at, d, at))
        for pile in piles.values():
            pile.sort()
        for k in range(len(self.tiers) - 1, -1, -1):
            tier, pile = self.tiers[k], piles[self.tiers[k]]
            left: list[tuple[int, int, int]] = []
            while pile:
                if k == 0 and sum(x[0] for x in pile[-tier:]) < tier and sum(x[0] for x in pile) < tier:
                    left = pile
                    break
                n, d, at = pile.pop()
                window, gap = [(d, at, n)], tier - n
                while gap and (best := self._fitting(piles, k, gap)):
                    n, d, at = best
                    window.append((d, at, n))
                    gap -= n
                if gap and (cut := self._shortest(piles, k)):
                    n, d, at = cut
                    window.append((d, at, gap))
                    rest = (n - gap, d, at + gap)
                    bisect.insort(piles[next(t for t in self.tiers if t >= n - gap)], rest)
                    gap = 0
                if gap:  # nothing is left to fill it
                    left = sorted((n, d, at) for d, at, n in window)
                else:
                    windows.append((tier, window))
            if left:
                windows += self._tail(left)
        return windows

    def _fitting(self, piles: dict, k: int, gap: int) -> tuple[int, int, int] | None:
        """The longest document of this tier or a shorter one that fits the gap."""
        for tier in self.tiers[k::-1]:
            if (i := bisect.bisect_right(piles[tier], (gap, float("inf"), 0))) and i <= len(piles[tier]):
                return piles[tier].pop(i - 1)
        return None

    def _shortest(self, piles: dict, k: int) -> tuple[int, int, int] | None:
        for tier in self.tiers[: k + 1]:
            if piles[tier]:
                return piles[tier].pop(0)
        return None

    def _tail(self, left: list[tuple[int, int, int]]) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """Full windows of decreasing powers of two."""
        total, out, queue = sum(x[0] for x in left), [], [list(x) for x in left]
        size = self.tiers[-1]
        while total:
            if size > total:
                size //= 2
                continue
            window, gap = [], size
            while gap:
                n, d, at = queue[-1]
                take = min(n, gap)
                window.append((d, at, take))
                gap -= take
                queue[-1] = [n - take, d, at + take]
                if not queue[-1][0]:
                    queue.pop()
            out.append((size, window))
            total -= size
        return out


def step_groups(windows: list[tuple[int, list]], per_step: int = STEP_WINDOWS) -> list[int]:
    """A step number for each window: steps hold windows of one length, of equal token count, dealt in serpentine order of
    attention cost (the sum of squared piece lengths)."""
    out, base = [0] * len(windows), 0
    for size in sorted({w for w, _ in windows}, reverse=True):
        mine = sorted((i for i, (w, _) in enumerate(windows) if w == size), key=lambda i: (-sum(n * n for _, _, n in windows[i][1]), i))
        steps = max(1, -(-len(mine) // per_step))
        for r, i in enumerate(mine):
            lap, x = divmod(r, steps)
            out[i] = base + (x if lap % 2 == 0 else steps - 1 - x)
        base += steps
    return out


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, group_tokens: int = GROUP_TOKENS, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window (the sequence's length),
    step_group. Sequence ids and step groups are unique across the table: the partition's number stands in the upper bits. cache_bytes bounds
    what a worker remembers of words (twice over), not what it returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize, packer = WordTokenizer(tokenizer_path, end_id, cache_bytes), Packer(tiers)
        base = TaskContext.get().partitionId() << 36
        state = {"sequence": base, "step": base}
        ids: list = []
        tokens: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            windows = packer.pack([len(t) for t in tokens])
            steps = step_groups(windows)
            rows: list[tuple] = []
            for (size, window), step in zip(windows, steps, strict=True):
                offset = 0
                for d, start, n in window:
                    crc = zlib.crc32(tokens[d][start : start + n].astype("<u4").tobytes())
                    rows.append((ids[d], start, n, crc, len(tokens[d]), state["sequence"], offset, size, state["step"] + step))
                    offset += n
                state["sequence"] += 1
            state["step"] += max(steps, default=-1) + 1
            ids.clear()
            tokens.clear()
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], names)

        held = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 250):
                part = batch.slice(lo, 250)
                for i, t in zip(part.column(0).to_pylist(), tokenize(part.column(1).to_pylist()), strict=True):
                    ids.append(i)
                    tokens.append(np.append(t, np.array(end_id, t.dtype)))
                    held += len(tokens[-1])
                    if held >= group_tokens:
                        yield flush()
                        held = 0
        if ids:
            yield flush()
        del tokenize

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return small_batches(rows).mapInArrow(tidy(run), SCHEMA)
