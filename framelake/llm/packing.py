"""Best-fit packing by bin completion.

``pieces`` tokenises whole texts inside the scan's tasks and cuts only documents longer than the
sequence. ``pack`` deals pieces to groups by hash (about ``GROUP`` pieces each, so a group's size
doesn't grow with the data) and packs every group on its own; only ids and lengths are shuffled.

Within a group, pieces of full length are sequences of their own. For the rest best-fit decreasing
gives the first solution. While it needs more sequences than its tokens demand, bin completion
searches for fewer: take the largest piece left, list the undominated fillings of the room around
it, follow them depth first, and leave a branch once the room it has wasted exceeds what a better
solution may waste. A solution with fewer sequences becomes the new bound. The search of a group ends after
``NODES`` nodes; the best solution so far holds, so every piece is always placed.

Tokenising: white space never lies inside a token and no rule looks across it, so a word's ids are
looked up in a bounded cache that lives with the Python worker; a missed word is encoded by the
tokenizer, without its trailing mark if the rest are Latin letters (letters and marks are split
anyway). Words that hold ``<|`` are encoded on their own, as they may be special tokens.

Nulls and ties: a null text is empty, that is one token, the end id. Repeated rows are packed one by one;
their pieces are told apart by ``sequence_id`` and ``offset``. Empty input gives an empty result.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm import text as T

LENGTH = 4_096
END = 1
GROUP = 8_192
NODES = 3_000
WIDTH = 8
CACHE = 700_000
_APART, _WORD_END = "<|endoftext|>", "</w>"
_MARKS = frozenset(b"%c" % c for c in b".,;:!?")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        self.path = path

    def _state(self) -> dict:
        state = T.worker_state(f"tokenizer:{self.path}")
        if not state:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(self.path)
            last = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), dtype=bool)
            last[[i for t, i in tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith(_WORD_END)]] = True
            state.update(tokenizer=tokenizer, apart=tokenizer.token_to_id(_APART), last=last, new={}, old={})
        return state

    def encode(self, texts: list[str | None]) -> list[bytes]:
        state = self._state()
        cache = state["new"]
        split = [T.words(t) for t in texts]
        found = [list(map(cache.get, words)) for words in split]  # one look-up a word
        holes = [[i for i, ids in enumerate(ids_of) if ids is None] if None in ids_of else () for ids_of in found]
        missed = {words[i] for words, places in zip(split, holes) for i in places}
        if missed:
            self._learn(missed, state)
            for words, ids_of, places in zip(split, found, holes):
                for i in places:
                    ids_of[i] = cache[words[i]]
        out = [b"".join(ids_of) for ids_of in found]
        if len(cache) > CACHE:
            state["old"], state["new"] = cache, {}
        return out

    def _learn(self, missed: set[bytes], state: dict) -> None:
        cache, old, parted, letters, others = state["new"], state["old"], [], set(), set()
        for word in missed:
            if (hit := old.get(word)) is not None:
                cache[word] = hit
                continue
            stem, mark = (word[:-1], word[-1:]) if word[-1:] in _MARKS else (word, b"")
            if (lower := _letters(stem)) is not None:
                letters.add(lower)
                parted.append((word, lower, mark))
            elif b"<|" in word:
                ids = state["tokenizer"].encode(word.decode("utf-8"), add_special_tokens=False).ids
                cache[word] = np.array(ids, dtype="<u4").tobytes()
            else:
                others.add(word)
        for found, joint in ((letters, " "), (others | _MARKS, _APART)):
            group = [s for s in found if s not in cache]
            if not group:
                continue
            joined = joint.join([s.decode("utf-8") for s in group])
            ids = np.array(state["tokenizer"].encode(joined, add_special_tokens=False).ids, dtype="<u4")
            if joint == " ":  # a run of letters ends with the one token that closes a word
                ends = np.flatnonzero(state["last"][ids]) + 1
                starts = np.append(0, ends[:-1])
            else:
                ends = np.append(np.flatnonzero(ids == state["apart"]), len(ids))
                starts = np.append(0, ends[:-1] + 1)
            raw = ids.tobytes()
            for stem, start, end in zip(group, (starts * 4).tolist(), (ends * 4).tolist(), strict=True):
                cache[stem] = raw[start:end]
        for word, stem, mark in parted:
            cache[word] = cache[stem] + cache[mark] if mark else cache[stem]


def _letters(word: bytes) -> bytes | None:
    """The word in lower case if it holds letters of the Latin blocks below U+0130 alone, else None."""
    if word.isalpha():
        return word.lower()
    text = word.decode("utf-8")
    return text.lower().encode() if text.isalpha() and max(text) < "\u0130" else None


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids): the ids of every document and its end, cut at ``length``."""
    encoder, stop = Encoder(tokenizer), np.array([end], dtype="<u4").tobytes()

    def make(texts):
        out = []
        for raw in encoder.encode(texts):
            raw += stop
            out.append([raw[i : i + 4 * length] for i in range(0, len(raw), 4 * length)])
        return [out]

    cut = T.map_texts(docs, ["doc_id"], make, "parts array<binary>").select("doc_id", F.posexplode("parts").alias("piece", "ids"))
    tokens = (F.length("ids") / 4).cast("long")
    return cut.select("doc_id", "piece", (F.col("piece").cast("long") * length).alias("start"), tokens.alias("length"), "ids")


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Best-fit decreasing: every piece goes where the least room stays."""
    rooms: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for n in sorted(lengths, reverse=True):
        at = bisect_left(rooms, (n, -1))
        if at < len(rooms):
            room, which = rooms.pop(at)
            bins[which].append(n)
        else:
            room, which = size, len(bins)
            bins.append([n])
        if room > n:
            insort(rooms, (room - n, which))
    return bins


def dominates(better: tuple[int, ...], worse: tuple[int, ...]) -> bool:
    """Whether the pieces of ``worse`` fit into spaces the size of the pieces of ``better``."""

    def place(i: int, spaces: tuple[int, ...]) -> bool:
        if i == len(worse):
            return True
        tried = set()
        for j, space in enumerate(spaces):
            if space >= worse[i] and space not in tried:
                tried.add(space)
                if place(i + 1, (*spaces[:j], space - worse[i], *spaces[j + 1 :])):
                    return True
        return False

    return sum(better) >= sum(worse) and place(0, better)


def fillings(room: int, left: list[int], counts: dict[int, int], width: int = WIDTH) -> list[tuple[int, ...]]:
    """Undominated sets of pieces for ``room``, fullest first; ``left`` holds the lengths in rising order.

    At most ``width`` first pieces are tried, the largest, then a third as many (at least one) at each deeper level,
    and ``4 * width`` sets are looked at in all; ``width`` of them come back. A set is filled up until nothing more fits.
    """
    found: list[tuple[int, ...]] = []

    def extend(space: int, highest: int, chosen: tuple[int, ...], used: dict[int, int], limit: int) -> None:
        at = bisect_left(left, min(space, highest) + 1) - 1
        steps = 0
        while at >= 0 and steps < limit and len(found) < 4 * width:
            n = left[at]
            if counts[n] > used.get(n, 0):
                steps += 1
                extend(space - n, n, (*chosen, n), {**used, n: used.get(n, 0) + 1}, max(1, limit // 3))
            at -= 1
        if not steps and len(found) < 4 * width:
            found.append(chosen)

    extend(room, room, (), {}, width)
    found.sort(key=lambda s: (-sum(s), len(s)))
    kept: list[tuple[int, ...]] = []
    for one in found:
        if not any(one == k or (len(k) <= 6 and dominates(k, one)) for k in kept):
            kept.append(one)
    return kept[:width] or [()]


def complete(lengths: list[int], size: int, nodes: int = NODES) -> list[list[int]]:
    """Bin completion; never worse than best-fit decreasing."""
    best = best_fit(lengths, size)
    total = sum(lengths)
    fewest = math.ceil(total / size)
    if len(best) <= fewest:
        return best
    counts: dict[int, int] = {}
    for n in lengths:
        counts[n] = counts.get(n, 0) + 1
    left = sorted(counts)
    bins: list[list[int]] = []

    def take(items) -> None:
        for n in items:
            counts[n] -= 1
            if not counts[n]:
                del left[bisect_left(left, n)]

    def give(items) -> None:
        for n in items:
            if not counts[n]:
                insort(left, n)
            counts[n] += 1

    # An explicit stack: (fillings still to try, the filling that is placed, room wasted before it).
    spent, wasted = 0, 0
    stack: list[list] = []

    def open_node() -> None:
        largest = left[-1]
        take([largest])
        stack.append([largest, fillings(size - largest, left, counts), None, wasted])
        give([largest])

    if left:
        open_node()
    while stack and spent < nodes + len(best) and len(best) > fewest:
        largest, ways, placed, before = stack[-1]
        if placed is not None:
            give(placed)
            bins.pop()
            stack[-1][2] = None
        wasted = before
        allowed = (len(best) - 1) * size - total
        if ways and size - largest - sum(ways[0]) + before <= allowed:
            filling = [largest, *ways.pop(0)]
            spent += 1
            take(filling)
            bins.append(filling)
            stack[-1][2] = filling
            wasted = before + size - sum(filling)
            if not left:
                if len(bins) < len(best):
                    best = [list(b) for b in bins]
            else:
                open_node()
        else:
            stack.pop()
    return best


def pack(cut: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """The rows of ``cut`` (doc_id, piece, length and others) with sequence_id and offset."""
    count = cut.count()
    groups = max(1, math.ceil(count / group))
    spread = cut.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(groups)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        waiting: dict[int, list[int]] = {}
        for i, n in zip(range(len(rows) - 1, -1, -1), rows["length"].tolist()[::-1]):
            waiting.setdefault(n, []).append(i)
        small = [n for n in rows["length"].tolist() if n < length]
        bins = [[length]] * len(waiting.get(length, [])) + complete(small, length)
        sequence, offset = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        base = int(rows["_group"].iloc[0]) << 32
        for b, items in enumerate(bins):
            at = 0
            for n in items:
                i = waiting[n].pop()
                sequence[i], offset[i] = base + b, at
                at += n
        return rows.drop(columns="_group").assign(sequence_id=sequence, offset=offset)

    schema = cut.schema.add("sequence_id", "long").add("offset", "long")
    return spread.groupBy("_group").applyInPandas(run, schema)
