"""Phrase collocations by stripes: every prefix keys an associative counter of the words that follow it.

Texts (A-Z lowered) are split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into words at spaces and
tabs. A stripe belongs to a language and a prefix of 0 to 4 words; it counts the next words, and under
``OTHER`` whatever else follows: the end of a piece, or a word that cannot make a frequent phrase. So one
structure holds all that is asked for:

* an entry is the frequency of prefix and next word as a phrase (a), and longer prefixes are its extensions;
* the sum of a stripe is the frequency of its prefix (l and r; of the empty prefix: all words of the language, n);
* the largest entry of a stripe, and the largest entry among the stripes whose prefix starts one word
  earlier, are the maxima by which a longer phrase subsumes a shorter one.

A phrase is no more frequent than its parts, so stripes of prefix length k are only kept for prefixes that
are frequent themselves, and their entries for words whose phrase without its first word is frequent. One
pass counts one length, and passes the frequent phrases on as a bitmap of fixed size: where
it errs it lets an infrequent phrase through, which the next count drops. No count is estimated. Texts are split
into words once; the passes read numbered words, about three bytes a word, from the shared folder. Subsumption
needs only phrases one word longer: a phrase between two others is at least as frequent as the longer one.

Scale: a task merges the stripes of up to ``TOKENS`` tokens before it sends anything. What it sends is packed by
segment, a hash of language and prefix and, so that no stripe lies in one place, of the next word: all of it for the
empty prefix, whose stripe is the vocabulary, and ``SPREAD`` classes of it for the others. Sums and maxima of the parts
of a stripe add up as rows. Segments follow the bytes of text; many of them are reached in two steps of
about the square root of their number, so packed rows do not grow with tasks times segments. Texts are not shuffled.

Nulls: a null text has no words, a null language is ``und``. Repeated rows count each. Ties in score go to the more
frequent phrase, then by UTF-8 order. Texts without words, languages without candidates and empty tables give no
rows. Other columns are left out. Scores are whole-number divisions of 38-digit decimals, so nothing is rounded.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm import exchange as X
from framelake.llm import text as T

LONGEST = 5
LEAST = 100
TOP = 2_000
SUBSUMED = 100
TOKENS, CHUNK = 2_000_000, 200_000
SPREAD = 8
SEGMENT_BYTES = 64 << 20
ONE_STEP = 256
BITS = 1 << 26
#: Next word of everything that is not counted by name. No word holds a space.
OTHER = b" "
_MARK = b"\xff"  # no byte of UTF-8: stands for the end of a piece
_TABLE = bytes(0xFF if chr(c) in ".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
STRIPES = "segment long, prefixes binary, sizes binary, words binary, next binary, counts binary"


def tokens(text: str | None) -> list[bytes]:
    """Words and, after every piece, the mark."""
    raw = (text or "").encode("utf-8", "replace").translate(_TABLE)
    return raw.replace(_MARK, b" \xff ").split(b" ") if b"\t" not in raw else raw.replace(b"\t", b" ").replace(_MARK, b" \xff ").split(b" ")


class Numbers(dict):
    """Numbers words as they come; the mark is 0."""

    def __init__(self):
        super().__init__({_MARK: 0, b"": -1})
        self.words = [_MARK]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        return number


def phrase_hashes(hashes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of the ``width`` words from each place; ``seed`` tells languages apart."""
    out = np.full(max(len(hashes) - width + 1, 0), seed, dtype=np.uint64)
    for i in range(width):
        out = T.mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + len(out)])
    return out


def _seed(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode("utf-8", "replace"))


def _held(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bitmap has both bits of each hash."""
    size = np.uint64(len(bitmap) * 8)
    out = np.ones(len(hashes), dtype=bool)
    for part in (hashes % size, (hashes >> np.uint64(32)) * np.uint64(0x9E3779B1) % size):
        at = part.astype(np.int64)
        out &= (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return out


def _named(prefix: np.ndarray, at: np.ndarray, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the ``width`` words from each of the places ``at``, and a place of each number: by hash, then compared."""
    if width == 1:
        used = np.flatnonzero(np.bincount(ids[at])) if len(at) else at
        number = np.zeros(int(used.max(initial=0)) + 1, dtype=np.int64)
        number[used] = np.arange(len(used))
        name, heads = number[ids[at]], np.empty(len(used), dtype=np.int64)
        heads[name] = at
        return name, heads
    order = np.argsort(prefix)
    new = np.append(True, prefix[order[1:]] != prefix[order[:-1]]) if len(order) else np.empty(0, dtype=bool)
    name = np.empty(len(order), dtype=np.int64)
    name[order] = np.cumsum(new) - 1
    heads = at[order[new]]
    if all((ids[at + i] == ids[heads[name] + i]).all() for i in range(width)):
        return name, heads
    name = ids[at].astype(np.int64)
    for i in range(1, width):  # two different phrases share a hash: number them word by word
        name = np.unique(name << 32 | ids[at + i], return_inverse=True)[1].astype(np.int64)
    found, first, name = np.unique(name, return_index=True, return_inverse=True)
    return name.astype(np.int64), at[first]


def stripes_of(lang: str, ids: np.ndarray, words: list[bytes], length: int, bitmap: np.ndarray | None):
    """(prefixes, prefix, next, count, hash of the segment) of one language's tokens; an entry a row, in order.

    ``ids`` are word numbers with 0 behind every piece. Prefixes have ``length`` - 1 words, joined by spaces
    behind the language and a tab, which no word holds.
    """
    seed, hashes, start = _seed(lang), T.hashed(words), lang.encode("utf-8", "replace") + b"\t"
    width = length - 1
    if not width:
        counts = np.bincount(ids, minlength=len(words))
        nexts = np.flatnonzero(counts[1:]) + 1
        return [start], np.zeros(len(nexts), dtype=np.int64), nexts, counts[nexts], T.mixed(hashes[nexts] + np.uint64(seed))
    at = np.arange(max(len(ids) - width, 0))
    for i in range(width):
        at = at[ids[at + i] > 0]
    prefix = phrase_hashes(hashes[ids], width, seed)
    fits = _held(bitmap, prefix)
    at = at[fits[at]]
    follows = np.append(fits, False)[at + 1] & (ids[at + width] > 0)
    name, heads = _named(prefix[at], at, ids, width)
    keys = np.sort(name << 32 | np.where(follows, ids[at + width], 0))
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, dtype=np.int64)
    counts, keys = np.diff(np.append(new, len(keys))), keys[new]
    prefixes = [start + b" ".join([words[w] for w in p]) for p in np.array([ids[heads + i] for i in range(width)]).T.tolist()]
    name, nexts = keys >> 32, keys & 0xFFFFFFFF
    part = np.where(nexts > 0, hashes[nexts] % np.uint64(SPREAD), np.uint64(0))
    return prefixes, name, nexts, counts, T.mixed(prefix[heads][name] + part)


def _planes(numbers: np.ndarray) -> bytes:
    """Small whole numbers as planes of bytes, the high ones of which compress to nothing."""
    return X._zip(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(X._unzip(raw), dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def packed(segments: list, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], prefixes: list, words: list) -> pa.RecordBatch:
    """One row of ``STRIPES`` per segment from its entries (prefix, next, count), which are in order."""
    rows = []
    for prefix, nexts, counts in parts:
        head = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1]))
        used = np.flatnonzero(np.bincount(nexts))
        renumber = np.zeros(int(used[-1]) + 1, dtype=np.int64)
        renumber[used] = np.arange(len(used))
        names = _MARK.join([prefixes[p] for p in prefix[head].tolist()]), _MARK.join([words[w] for w in used.tolist()])
        number = renumber[nexts]
        gaps = np.diff(number, prepend=0)
        gaps[head] = number[head]  # words of a prefix rise
        rows.append((X._zip(names[0]), _planes(np.diff(np.append(head, len(prefix)))), X._zip(names[1]), _planes(gaps), X.squeezed(counts)))
    columns = [pa.array(c, pa.binary()) for c in zip(*rows)] if rows else [pa.array([], pa.binary())] * 5
    return pa.RecordBatch.from_arrays([pa.array(segments, pa.int64()), *columns], ["segment", "prefixes", "sizes", "words", "next", "counts"])


def united(rows: pa.Table):
    """The merged entries (prefix, next, count) of packed rows in order, and the names; equal entries are added up."""
    prefixes, words, keys, given = {}, {}, [], []
    for names, sizes, nexts, number, counts in zip(*(rows.column(c).to_pylist() for c in ("prefixes", "sizes", "words", "next", "counts"))):
        own = np.array([prefixes.setdefault(p, len(prefixes)) for p in X._unzip(names).split(_MARK)], dtype=np.int64)
        word = np.array([words.setdefault(w, len(words)) for w in X._unzip(nexts).split(_MARK)], dtype=np.int64)
        gaps, sizes = np.cumsum(_numbers(number)), _numbers(sizes)
        head = np.cumsum(sizes) - sizes
        gaps -= np.repeat(np.append(0, gaps)[head], sizes)
        keys.append(np.repeat(own, sizes) << 32 | word[gaps])
        given.append(X.spread(counts, len(keys[-1])))
    keys, given = np.concatenate(keys), np.concatenate(given)
    order = np.argsort(keys)
    keys = keys[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    keys = keys[new]
    return keys >> 32, keys & 0xFFFFFFFF, np.add.reduceat(given[order], new), list(prefixes), list(words)


def numbered(docs: DataFrame) -> DataFrame:
    """The tokens of ``docs`` (lang, text) as rows (lang, words, ids) of up to ``CHUNK`` tokens, so texts are split once."""
    T.bounded_batches(docs.sparkSession)

    def run(batches):
        langs: dict[str, tuple[Numbers, list, int]] = {}

        def row(lang, numbers, lists):
            return pa.RecordBatch.from_arrays(
                [pa.array([lang], pa.string()), pa.array([X._zip(_MARK.join(numbers.words[1:]))], pa.binary()), pa.array([_planes(np.concatenate(lists))], pa.binary())],
                ["lang", "words", "ids"],
            )

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                numbers, lists, size = langs.get(lang) or (Numbers(), [], 0)
                made = tokens(text)
                ids = np.fromiter(map(numbers.__getitem__, made), dtype=np.int64, count=len(made))
                lists.append(np.append(ids[ids >= 0], 0))
                langs[lang] = numbers, lists, size + len(made)
                if size + len(made) >= CHUNK:
                    yield row(lang, numbers, lists)
                    del langs[lang]
        for lang, (numbers, lists, _) in langs.items():
            yield row(lang, numbers, lists)

    return docs.select("lang", "text").mapInArrow(run, "lang string, words binary, ids binary")


def stripes(chunks: DataFrame, length: int, bitmap: bytes | None, segments: int) -> DataFrame:
    """``STRIPES`` of prefixes of ``length`` - 1 words in rows of ``numbered``, merged within a task."""

    def run(batches):
        held = np.frombuffer(bitmap, dtype=np.uint8) if bitmap is not None else None
        langs: dict[str, tuple[dict, list]] = {}
        seen = 0

        def send():
            for lang, (numbers, lists) in langs.items():
                prefixes, prefix, nexts, counts, keys = stripes_of(lang, np.concatenate(lists), list(numbers), length, held)
                segment = (keys % np.uint64(segments)).astype(np.int64)
                order = np.argsort(segment.astype(np.uint16) if segments < 1 << 16 else segment, kind="stable")
                cut = np.searchsorted(segment[order], np.arange(segments + 1))
                full = np.flatnonzero(np.diff(cut)).tolist()
                parts = [tuple(x[order[cut[b] : cut[b + 1]]] for x in (prefix, nexts, counts)) for b in full]
                yield packed(full, parts, prefixes, [OTHER, *list(numbers)[1:]])
            langs.clear()

        for batch in batches:
            for lang, words, ids in zip(*(batch.column(c).to_pylist() for c in range(3))):
                numbers, lists = langs.setdefault(lang, ({_MARK: 0}, []))
                raw = X._unzip(words)
                own = [0, *[numbers.setdefault(w, len(numbers)) for w in (raw.split(_MARK) if raw else ())]]
                lists.append(np.array(own, dtype=np.int64)[_numbers(ids)])
                seen += len(lists[-1])
                if seen >= TOKENS:
                    yield from send()
                    seen = 0
        yield from send()

    return chunks.select("lang", "words", "ids").mapInArrow(run, STRIPES)


def merged(sent: DataFrame, segments: int, least: int) -> DataFrame:
    """(prefix, total, largest, entries) per segment of a stripe, with the entries of ``least`` or more.

    Beyond ``ONE_STEP`` segments rows meet by groups of tasks and of segments first, and by segment then, each
    about the square root of ``segments`` in number.
    """

    def gather(rows: pa.Table) -> pa.Table:
        numbers, parts = rows.column("segment").to_numpy(), []
        for number in np.unique(numbers).tolist():
            prefix, word, counts, prefixes, words = united(rows.filter(pa.array(numbers == number)))
            parts.append(packed([number], [(prefix, word, counts)], prefixes, words))
        return pa.Table.from_batches(parts)

    def settle(rows: pa.Table) -> pa.Table:
        prefix, word, counts, prefixes, words = united(rows)
        head = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1]))
        named = np.array([w != OTHER for w in words])[word]
        keep = (counts >= least) & named
        largest = np.maximum.reduceat(np.where(named, counts, 0), head)
        ends = np.append(0, np.cumsum(np.add.reduceat(keep.astype(np.int32), head))).astype(np.int32)
        text = lambda names: pa.array(names, pa.binary()).cast(pa.string())
        entries = pa.StructArray.from_arrays([text([words[w] for w in word[keep].tolist()]), pa.array(counts[keep])], ["next", "a"])
        return pa.table({
            "prefix": text([prefixes[p] for p in prefix[head].tolist()]), "total": np.add.reduceat(counts, head),
            "largest": largest, "entries": pa.ListArray.from_arrays(pa.array(ends), entries),
        })

    if segments > ONE_STEP:
        groups = math.isqrt(segments)
        keyed = sent.withColumns({"_task": F.pmod(F.spark_partition_id(), F.lit(groups)), "_part": F.floor(F.col("segment") / groups)})
        sent = keyed.groupBy("_task", "_part").applyInArrow(gather, STRIPES)
    return sent.groupBy("segment").applyInArrow(settle, "prefix string, total long, largest long, entries array<struct<next: string, a: long>>")


def bitmap_of(phrases: DataFrame, bits: int = BITS) -> bytes:
    """Two bits of every phrase (lang, words joined by spaces) in ``bits`` bits: tasks send pages, Spark unites them."""
    page = min(bits // 8, 1 << 14)

    def run(batches):
        held = np.zeros(bits // 8, dtype=np.uint8)
        for batch in batches:
            hashes = np.array([_phrase_hash(x, y) for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], dtype=np.uint64)
            for part in (hashes % np.uint64(bits), (hashes >> np.uint64(32)) * np.uint64(0x9E3779B1) % np.uint64(bits)):
                at = part.astype(np.int64)
                np.bitwise_or.at(held, at >> 3, (1 << (at & 7)).astype(np.uint8))
        pages = held.reshape(-1, page)
        full = np.flatnonzero(pages.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array([pages[i].tobytes() for i in full], pa.binary())], ["page", "body"])

    def unite(rows: pa.Table) -> pa.Table:
        bodies = [np.frombuffer(b, dtype=np.uint8) for b in rows.column("body").to_pylist()]
        return pa.table({"page": rows.column("page")[:1], "body": pa.array([np.bitwise_or.reduce(bodies).tobytes()], pa.binary())})

    schema = "page long, body binary"
    out = np.zeros((bits // 8 // page, page), dtype=np.uint8)
    for row in phrases.mapInArrow(run, schema).groupBy("page").applyInArrow(unite, schema).toLocalIterator():
        out[row.page] = np.frombuffer(row.body, dtype=np.uint8)
    return out.tobytes()


def _phrase_hash(lang: str, phrase: str) -> int:
    words = T.hashed([w.encode("utf-8", "replace") for w in phrase.split(" ")])
    return int(phrase_hashes(words, len(words), _seed(lang))[0])


def frequent(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, segment_bytes: int = SEGMENT_BYTES) -> tuple[DataFrame, DataFrame]:
    """(stripes, phrases): the sums and maxima of the stripes (lang, prefix, width, total, largest), and the phrases
    (lang, phrase, width, prefix, a) that occur ``least`` times or more. ``docs``: lang, text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    segments = max(1, math.ceil(size / segment_bytes))
    chunks, bitmap, sums, phrases = T.stored(numbered(docs), "numbered-words"), None, [], []
    for length in range(1, longest + 1):
        found = T.stored(merged(stripes(chunks, length, bitmap, segments), segments, least), f"stripes-{length}")
        words = F.substring_index("prefix", "\t", -1)
        lang = F.expr("left(prefix, length(prefix) - length(substring_index(prefix, '\\t', -1)) - 1)")
        named = found.select(lang.alias("lang"), words.alias("prefix"), F.lit(length - 1).alias("width"), "total", "largest", "entries")
        sums.append(named.groupBy("lang", "prefix", "width").agg(F.sum("total").alias("total"), F.max("largest").alias("largest")))
        flat = named.select("lang", "prefix", F.explode("entries").alias("e"))
        phrase = F.concat_ws(" ", F.when(F.col("prefix") != "", F.col("prefix")), "e.next")
        flat = flat.select("lang", phrase.alias("phrase"), F.lit(length).alias("width"), "prefix", F.col("e.a").alias("a"))
        phrases.append(T.stored(flat, f"phrases-{length}"))
        if length < longest:
            bitmap = bitmap_of(phrases[-1].select("lang", "phrase"))
    return reduce(DataFrame.unionAll, sums), reduce(DataFrame.unionAll, phrases)


def mine(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, subsumed: int = SUBSUMED, segment_bytes: int = SEGMENT_BYTES
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to ``longest`` words."""
    named = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    sums, phrases = frequent(named, longest, least, segment_bytes)
    totals = T.stored(sums.where(f"total >= {least} or width = 0"), "phrase-totals")
    several = phrases.where("width > 1")
    tail = F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)")
    left = several.groupBy("lang", tail.alias("phrase")).agg(F.max("a").alias("longer"))
    right = totals.where("width > 1").select("lang", F.col("prefix").alias("phrase"), F.col("largest").alias("longer"))
    longer = left.unionAll(right).groupBy(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase")).agg(F.max("longer").alias("longer"))
    kept = several.join(longer, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")), "left")
    kept = kept.where(f"longer is null or longer < {least} or 100 * longer < {subsumed} * a").select("lang", "phrase", "width", "a")
    split = kept.select("*", F.explode(F.sequence(F.lit(1), F.col("width") - 1)).alias("k"))
    split = split.withColumns({"head": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - width)")})
    of = lambda name: totals.where("width > 0").select(F.col("lang").alias(f"_l{name}"), F.col("prefix").alias(f"_p{name}"), F.col("total").alias(name))
    split = split.join(of("l"), (F.col("lang") == F.col("_ll")) & (F.col("head") == F.col("_pl")))
    split = split.join(of("r"), (F.col("lang") == F.col("_lr")) & (F.col("rest") == F.col("_pr")))
    words = totals.where("width = 0").select(F.col("lang").alias("_n"), F.col("total").alias("n"))
    split = split.join(words, F.col("lang") == F.col("_n"))
    exact = F.expr("(1000BD * cast(a as decimal(17, 0)) * cast(n as decimal(17, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    lowest = split.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(exact.cast("long").alias("score"), "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
