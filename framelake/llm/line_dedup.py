"""Line dedup: SimHashes of normalised lines, joined on pigeonhole blocks, verified by edit similarity.

A line's normal form is its words with A-Z lowered and ASCII punctuation removed; lines without a normal
form (blank or marks only) are always kept. Lines with equal normal forms are one line. Two lines are
similar if the edit similarity of their normal forms, 1 - distance / longer length, is ``SIMILAR`` or more.

* Each line has three independent 64-bit SimHashes, over its distinct words if it has ``COARSE`` or more, over
  its distinct pairs of neighbouring characters if it has up to ``FINE`` words or long ones (scripts without
  spaces), and in between over both. Fewer than ``MIN_CHARS`` characters: similar only if equal.
* The 192 bits are cut into blocks. A key is two equal blocks, so two lines whose differing bits leave some
  pair of blocks intact meet for certain; which others meet is a matter of chance with a fixed seed. Blocks grow with the
  logarithm of the number of lines, so that a key is shared by few lines at any size, and the number of keys
  with them, so that a pair that differs in ``USUAL`` bits of 64 (more for short lines) misses all keys with a chance of ``MISS`` (until
  all pairs of blocks are used). README has the measured recall by size.
* Pairs that meet are candidates if the shorter has ``SIMILAR`` of the other's length, without which they cannot be
  similar, and their SimHashes differ in few bits (``GATES``, ``ALL_BITS``). All candidates are decided by their texts.

Of a key's lines a forest of the candidates is verified first. Where a verified pair is missing to unite what
the forest unites, a second pass forms every remaining candidate between different components of those lines and verifies it.
Components are taken over verified pairs only. Of each group one occurrence stays: the one with the smallest (doc_id, text hash, line number).

Scale: occurrences are reduced map-side to one row per distinct line, so a line in a third of all documents is
one row. Keys are dealt to buckets in packed arrays. Before anything is sent, a task joins lines of one key that differ
in ``TIGHT`` bits or fewer to one of them, which alone is sent: a key that holds a third of all lines because they
vary one line is a few rows a task. A line that is near such a line and not near the one it stands for can still meet it in
the other keys. Texts of candidates are fetched from the documents that hold them. Whole texts are never part of a shuffle but
in the last join, which removes the lines.

Nulls and ties: a null text stays null. A null id sorts first. Rows that repeat both id and text are one
document and keep the same lines. Line ends are ``\\n``; what is kept is joined by it again. Empty input
gives an empty result. Output names that the table already has are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm import exchange as X
from framelake.llm import text as T
from framelake.llm.graph import connected_components, forest

SIMILAR = 0.8
MIN_WORDS = 1
#: Lines of fewer characters are similar only if equal: one edit is more than a fifth of four characters, but not of five.
MIN_CHARS = 4
COARSE, FINE, LONG_WORD = 8, 10, 12
SIMHASHES, MISS = 3, 0.03
#: Bits of 64 in which similar lines are taken to differ.
USUAL = {"coarse": 8, "fine": 11}
#: How many of the three SimHashes decide whether a pair is a candidate, and the bits they may differ in. Few words leave
#: few bits to chance, so all lines over words are told apart by one; short lines of one language share most pairs of characters.
GATES = {"coarse": (1, 14), "fine": (3, 37)}
#: Bits of all 192 in which a candidate may differ.
ALL_BITS = 40
TIGHT = 4
#: Lines that share a key by chance, at most; rows of a key that are linked before they are sent.
CROWD, LOCAL_RUN = 64, 32
#: Runs of one key up to this size are compared shift by shift, larger ones row by row.
SHORT_RUN = 256
BUCKET_ROWS = 500_000
#: Normal forms that a task remembers as measured, at most; forgotten ones are measured again.
MOST_SEEN = 200_000
#: Characters of the texts that are measured at once; a longer text is alone.
HELD_CHARS = 1 << 17
FEW = 200_000
#: Words that two lines are looked ahead for the next equal ones.
AHEAD = 10
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
LINE = "doc_id long, text_hash long, line int, h1 long, h2 long, words int, chars int, coarse binary, fine binary"


def normal(line: bytes) -> bytes:
    """Normal form of one line in UTF-8."""
    return b" ".join(line.lower().translate(None, _MARKS).split())


_SEEDS = T.mixed(np.arange(1, SIMHASHES + 1, dtype=np.uint64))
#: A byte as eight counters of 16 bits each: bit i of the byte is counter i. Its unpacked bits are counters of 8 bits.
_COUNTERS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.uint16).view(np.uint64)


def simhashes(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(lines, 3) SimHashes; line i has the next ``sizes[i]`` > 0 of the feature hashes ``flat``.

    Bit i is set if it is set in the hashes of more than half of the line's features. A feature counts
    once: otherwise the few most frequent words of a language would decide the hash of every long line.
    """
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), SIMHASHES), dtype=np.uint64)
    for kind, few, many in ((np.uint8, 1, 1 << 8), (np.uint16, 1 << 8, 1 << 16)):
        mine = np.flatnonzero((sizes >= few) & (sizes < many))
        if not len(mine):
            continue
        own = flat if len(mine) == len(sizes) else np.concatenate([flat[s : s + n] for s, n in zip(starts[mine].tolist(), sizes[mine].tolist())])
        begin = np.cumsum(sizes[mine]) - sizes[mine]
        half = (sizes[mine] // 2).astype(kind)[:, None]
        for k, seed in enumerate(_SEEDS):
            raw = T.mixed(own + seed).view(np.uint8)
            counters = (np.unpackbits(raw).view(np.uint64) if kind is np.uint8 else _COUNTERS[raw]).reshape(len(own), -1)
            ones = np.add.reduceat(counters, begin, axis=0).view(kind).reshape(-1, 64)
            out[mine, k] = np.packbits(ones > half, axis=1).view(np.uint64).ravel()
    for i in np.flatnonzero(sizes >= 1 << 16).tolist():  # too many for the counters
        for k, seed in enumerate(_SEEDS):
            bits = np.unpackbits(T.mixed(flat[starts[i] : starts[i] + sizes[i]] + seed).view(np.uint8).reshape(-1, 8), axis=1)
            out[i, k] = np.packbits(bits.sum(axis=0, dtype=np.int64) > sizes[i] // 2).view(np.uint64)[0]
    return out


#: A random number for each byte, and the base of the polynomial that tells the places of a word's bytes.
_BYTES, _BASE = T.mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.uint64(0xD1342543DE82EF95)
_BYTES[[10, 32]] = 0


def _ends(forms: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The forms as bytes, each followed by a line end; where their words end; how many words each has."""
    raw = np.frombuffer(b"\n".join([*forms, b""]), dtype=np.uint8)
    ends = np.flatnonzero((raw == 32) | (raw == 10))
    return raw, ends, np.diff(np.flatnonzero(raw[ends] == 10), prepend=-1)


def word_hashes(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words that end at ``ends``, all at once."""
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = ends + 1 - starts
    powers = np.full(int(sizes.max()), _BASE)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    place = np.arange(len(raw)) - np.repeat(starts, sizes)
    return T.mixed(np.add.reduceat(_BYTES[raw] * powers[place], starts))


def _kinds(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of lines, and how many each line has; a key is the line's number over ``bits`` bits of feature."""
    keys = np.sort(keys)
    keys = keys[np.append(True, keys[1:] != keys[:-1])]
    return keys & np.uint64((1 << bits) - 1), np.bincount((keys >> np.uint64(bits)).astype(np.int64))


def _numbered(sizes: np.ndarray, bits: int) -> np.ndarray:
    return np.repeat(np.arange(len(sizes), dtype=np.uint64) << np.uint64(bits), sizes)


def _coarse(forms: list[bytes]) -> np.ndarray:
    """SimHashes over distinct words. Of a word's hash 48 bits are used, next to the number of its line."""
    raw, ends, words = _ends(forms)
    features, sizes = _kinds(_numbered(words, 48) | word_hashes(raw, ends) >> np.uint64(16), 48)
    return simhashes(T.mixed(features), sizes)


def _fine(forms: list[bytes]) -> np.ndarray:
    """SimHashes over distinct pairs of neighbouring characters; the ends count as characters."""
    runs = [_pairs_of(f.decode("utf-8", "replace")) for f in forms]
    features, sizes = _kinds(_numbered(np.array([len(r) for r in runs]), 42) | np.concatenate(runs), 42)
    return simhashes(T.mixed(features), sizes)


def _pairs_of(form: str) -> np.ndarray:
    """Pairs of neighbouring characters as numbers; the ends count as characters."""
    codes = np.frombuffer(f"\n{form}\n".encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    return (codes[:-1] << np.uint64(21)) | codes[1:]


def signatures(forms: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes | None], list[bytes | None]]:
    """Numbers of words and characters, and the SimHashes over words and over characters of normal forms; none where not used."""
    raw, ends, words = _ends(forms)
    last = ends[np.cumsum(words) - 1]
    chars = np.add.reduceat((raw & 0xC0) != 0x80, np.concatenate([[0], last[:-1] + 1]), dtype=np.int64) - 1
    out = []
    for chosen, make in ((words >= COARSE, _coarse), ((words <= FINE) | (chars > LONG_WORD * words), _fine)):
        at = np.flatnonzero(chosen & (chars >= MIN_CHARS)).tolist()
        out.append([None] * len(forms))
        for start in range(0, len(at), 1 << 16):
            part = at[start : start + (1 << 16)]
            for i, sims in zip(part, make([forms[i] for i in part])):
                out[-1][i] = sims.tobytes()
    return words, chars, *out


def _lines(texts: list[str | None]) -> tuple[list[int], list[int], list[bytes]]:
    """Text number, line number and normal form of all lines that have one."""
    which, number, forms = [], [], []
    for i, text in enumerate(texts):
        plain = (text or "").encode("utf-8", "replace").lower().translate(None, _MARKS)  # the marks don't include line ends
        for j, line in enumerate(plain.split(b"\n")):
            if form := b" ".join(line.split()):
                which.append(i), number.append(j), forms.append(form)
    return which, number, forms


def lines(docs: DataFrame) -> DataFrame:
    """``LINE`` of every line with a normal form, from the scan's own tasks. ``docs``: doc_id, text_hash, text.

    A task measures a normal form where it first meets it; in repeated lines, words, chars and SimHashes are null.
    """
    T.bounded_batches(docs.sparkSession)

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            held = np.cumsum([len(t or "") for t in texts]) // HELD_CHARS
            cuts = [0, *(np.flatnonzero(np.diff(held)) + 1).tolist(), len(texts)]
            for start, end in zip(cuts, cuts[1:]):
                which, number, forms = _lines(texts[start:end])
                if not forms:
                    continue
                digests = list(map(xxhash.xxh3_128_digest, forms))
                if len(seen) > MOST_SEEN:
                    seen.clear()
                new = np.array([d not in seen and not seen.add(d) for d in digests])
                words, chars, coarse, fine = signatures([f for f, n in zip(forms, new) if n]) if new.any() else ([], [], [], [])
                keys = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
                at, place = pa.array(np.array(which) + start), pa.array(np.cumsum(new) - 1, pa.int64(), mask=~new)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(number, pa.int32()), pa.array(keys[:, 0].copy()),
                     pa.array(keys[:, 1].copy()), pa.array(words, pa.int32()).take(place), pa.array(chars, pa.int32()).take(place),
                     pa.array(coarse, pa.binary()).take(place), pa.array(fine, pa.binary()).take(place)],
                    ["doc_id", "text_hash", "line", "h1", "h2", "words", "chars", "coarse", "fine"],
                )

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, LINE)


def blocks(count: int, kind: str = "coarse") -> tuple[int, list[tuple[int, int]]]:
    """Bits of a block, and the pairs of blocks that are the keys, for ``count`` lines."""
    width = max(8, math.ceil((math.log2(max(count, 2)) - math.log2(CROWD)) / 2))
    number = 64 * SIMHASHES // width
    wanted = math.ceil(math.log(MISS) / math.log(1 - (1 - USUAL[kind] / 64) ** (2 * width)))
    rng, chosen = np.random.default_rng(width), {}
    while len(chosen) < min(wanted, number * (number - 1) // 2):
        for a, b in rng.permutation(number)[: number // 2 * 2].reshape(-1, 2).tolist():  # each block in about as many keys
            chosen[min(a, b), max(a, b)] = None
    return width, list(chosen)[:wanted]


def block(sims: np.ndarray, width: int, number: int) -> np.ndarray:
    """Block ``number`` of each row's 192 bits."""
    word, at = divmod(number * width, 64)
    out = sims[:, word] >> np.uint64(at)
    if at + width > 64:
        out = out | sims[:, word + 1] << np.uint64(64 - at)
    return out & np.uint64((1 << width) - 1)


def close(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Whether rows of SimHashes differ in ``bits`` or fewer, all together."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64) <= bits


def _few_bits(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """``close`` for rows of one SimHash, given as numbers, too."""
    return np.bitwise_count(a ^ b) <= bits if a.ndim == 1 else close(a, b, bits)


def _order(keys: np.ndarray) -> np.ndarray:
    """The order of keys below 2**32; equal ones keep theirs."""
    return (np.sort(keys << np.uint64(32) | np.arange(len(keys), dtype=np.uint64)) & np.uint64((1 << 32) - 1)).astype(np.int64)


def fit_length(shorter: np.ndarray, longer: np.ndarray, least: float) -> np.ndarray:
    return longer - shorter <= np.floor((1 - least) * longer + 1e-9)


def tight_links(key: np.ndarray, sim: np.ndarray, chars: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which rows are still to be sent, and links from a row that is sent to one that isn't) for rows in order of ``key``."""
    stays = np.ones(len(key), dtype=bool)
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, dtype=np.int64)
    sizes, left, right = np.diff(np.append(edge, len(key))), [], []
    for start, n in zip(edge[sizes >= LOCAL_RUN].tolist(), sizes[sizes >= LOCAL_RUN].tolist()):
        rest = np.arange(start, start + n)
        while len(rest) >= LOCAL_RUN:
            near = close(sim[rest], sim[rest[0]], TIGHT * sim.shape[1]) & fit_length(np.minimum(chars[rest], chars[rest[0]]), np.maximum(chars[rest], chars[rest[0]]), least)
            near[0] = False
            stays[rest[near]] = False
            left.append(np.full(int(near.sum()), rest[0])), right.append(rest[near])
            rest = rest[1:][~near[1:]]
    none = np.empty(0, dtype=np.int64)
    return stays, np.concatenate([none, *left]), np.concatenate([none, *right])


def near_pairs(key: np.ndarray, sim: np.ndarray, chars: np.ndarray, group: np.ndarray | None, bits: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Candidates among rows in order of (key, chars): of each key a forest, or, with ``group``, all between two groups."""
    left, right = [], []

    def add(a: np.ndarray, b: np.ndarray) -> None:
        if group is not None:  # at once: a large group of near copies has most of its pairs inside one component
            apart = group[a] != group[b]
            a, b = a[apart], b[apart]
        left.append(a), right.append(b)

    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(edge, len(key)))
    # How many of the next rows have the key and may have the length; the length is decided for those that are close.
    most = np.minimum(np.floor(chars / least + 1), (1 << 32) - 1).astype(np.uint64)
    at = key.astype(np.uint64) << np.uint64(32)
    ahead = np.searchsorted(at | chars.astype(np.uint64), at | most, side="right") - 1 - np.arange(len(key))
    ahead[np.repeat(sizes > SHORT_RUN, sizes)] = 0
    sim_or_sims = sim[:, 0] if sim.shape[1] == 1 else sim
    live = None
    for step in range(1, int(ahead.max(initial=0)) + 1):
        if live is None and 4 * np.count_nonzero(ahead >= step) < len(key):
            live = np.flatnonzero(ahead >= step)
        if live is None:
            hit = np.flatnonzero(_few_bits(sim_or_sims[:-step], sim_or_sims[step:], bits) & (ahead[:-step] >= step))
        else:
            live = live[ahead[live] >= step]
            hit = live[_few_bits(sim_or_sims[live], sim_or_sims[live + step], bits)]
        hit = hit[fit_length(chars[hit], chars[hit + step], least)]
        add(hit, hit + step)
    for start, n in zip(edge[sizes > SHORT_RUN].tolist(), sizes[sizes > SHORT_RUN].tolist()):
        for a, found in _row_by_row(sim[start : start + n], chars[start : start + n], group is None, bits, least):
            add(np.full(len(found), start + a), start + found)
    none = np.empty(0, dtype=np.int64)
    left, right = np.concatenate([none, *left]), np.concatenate([none, *right])
    if group is not None:
        return left, right
    busy = np.repeat(np.bincount(np.searchsorted(edge, left, side="right") - 1, minlength=len(edge)) > 2, sizes)[left]
    kept = np.array(forest(zip(left[busy].tolist(), right[busy].tolist()), len(key)), dtype=np.int64).reshape(-1, 2)
    return np.concatenate([left[~busy], kept[:, 0]]), np.concatenate([right[~busy], kept[:, 1]])


def _row_by_row(sim: np.ndarray, chars: np.ndarray, tree: bool, bits: int, least: float):
    """Each row of a long run with its candidates; for a tree, what is reached leaves the rest, so near copies need few looks."""
    reach = np.searchsorted(chars, np.floor(chars / least + 1e-9), side="right")
    if not tree:
        for a in range(len(sim)):
            found = a + 1 + np.flatnonzero(close(sim[a + 1 : reach[a]], sim[a], bits))
            if len(found):
                yield a, found
        return
    rest = np.arange(len(sim))
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            a = queue.pop()
            low, high = np.searchsorted(rest, np.searchsorted(chars, np.ceil(chars[a] * least - 1e-9))), np.searchsorted(rest, reach[a])
            hit = low + np.flatnonzero(close(sim[rest[low:high]], sim[a], bits))
            if len(hit):
                found = rest[hit]
                yield a, found
                queue += found.tolist()
                rest = np.delete(rest, hit)


def planes(values: np.ndarray) -> bytes:
    """Numbers zipped byte by byte of all, the high bytes apart from the low ones, which packs numbers of few bits tightly."""
    return X._zip(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def numbers(raw: bytes, kind) -> np.ndarray:
    """The numbers of ``planes``."""
    return np.frombuffer(X._unzip(raw), dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def alike(distinct: DataFrame, kind: str, count: int, least: float = SIMILAR, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Candidates (a, b) among ``distinct`` (node, chars, ``kind``); ``count`` lines decide the keys.

    With a column ``component``: all candidates between different components. Without: a forest of each key's.
    """
    rows = distinct.where(F.col(kind).isNotNull())
    grouped = "component" in distinct.columns
    width, keys = blocks(count, kind)
    sketches, bits = GATES[kind]
    parts = max(1, math.ceil(rows.count() / bucket_rows))  # buckets of one pair of blocks

    def send(batches):
        held, size = [], 0
        for batch in batches:
            sims = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint64).reshape(-1, SIMHASHES)
            group = batch.column(3).to_numpy() if grouped else np.zeros(len(batch), dtype=np.int64)
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), sims, group))
            size += len(batch)
            if size >= 200_000:
                yield from parcels(held)
                held, size = [], 0
        if held:
            yield from parcels(held)

    def parcels(held):
        node, chars, sims, group = (np.concatenate(x) for x in zip(*held))
        for number, (one, two) in enumerate(keys):
            key = T.mixed(block(sims, width, one) << np.uint64(width) | block(sims, width, two)) >> np.uint64(32)
            order = _order(key)
            key = key[order]
            short, bucket = key.astype(np.uint32), (key * np.uint64(parts) >> np.uint64(32)).astype(np.int64)  # ranges of keys
            sim = np.ascontiguousarray(sims[order, :sketches])
            left = right = np.empty(0, dtype=np.int64)
            if not grouped:
                stays, left, right = tight_links(key, sim, chars[order], least)
                left, right, order, sim, short, bucket = node[order[left]], node[order[right]], order[stays], sim[stays], short[stays], bucket[stays]
            cut = np.searchsorted(bucket, np.arange(parts + 1))
            full = np.flatnonzero(np.diff(cut))
            pieces = [slice(cut[b], cut[b + 1]) for b in full]
            rising = lambda x: planes(np.diff(x, prepend=x.dtype.type(0)))
            plain = lambda x: X._zip(x.tobytes())
            columns = [(node[order], planes), (short, rising), (sim, plain), (chars[order].astype(np.int32), planes)]
            columns += [(group[order], planes)] if grouped else []
            last = [[planes(left)], [planes(right)]] + [[None]] * 3 if len(left) else [[]] * 5
            packed = [pa.array([make(c[p]) for p in pieces] + end, pa.binary()) for (c, make), end in zip(columns, last)]
            packed += [] if grouped else [pa.nulls(len(packed[0]), pa.binary())]
            where = number * parts + (np.append(full, 0) if len(left) else full)
            yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int64)), *packed], ["bucket", "nodes", "keys", "sims", "chars", "groups"])

    def match(bucket: pa.Table) -> pa.Table:
        linked = bucket.filter(bucket.column("sims").is_null())
        plain = bucket.filter(bucket.column("sims").is_valid())
        read = lambda rows, c, t: np.concatenate([np.empty(0, dtype=t), *[numbers(x, t) for x in rows.column(c).to_pylist()]])
        known = read(linked, "nodes", np.int64), read(linked, "keys", np.int64)
        node, chars = read(plain, "nodes", np.int64), read(plain, "chars", np.int32)
        key = np.concatenate([np.empty(0, dtype=np.uint32), *[np.cumsum(numbers(x, np.uint32), dtype=np.uint32) for x in plain.column("keys").to_pylist()]])
        sim = np.frombuffer(b"".join(map(X._unzip, plain.column("sims").to_pylist())), dtype=np.uint64)
        sim = sim.reshape(-1, sketches)
        order = np.argsort(key.astype(np.uint64) << np.uint64(32) | chars.astype(np.uint64))
        node, key, sim, chars = node[order], key[order], sim[order], chars[order].astype(np.int64)
        left = right = np.empty(0, dtype=np.int64)
        if len(key):
            left, right = near_pairs(key, sim, chars, read(plain, "groups", np.int64)[order] if grouped else None, bits, least)
        return pa.table({"a": np.concatenate([node[left], known[0]]), "b": np.concatenate([node[right], known[1]])})

    sent = rows.select("node", "chars", kind, *(["component"] if grouped else []))
    sent = sent.mapInArrow(send, "bucket long, nodes binary, keys binary, sims binary, chars binary, groups binary")
    edges = sent.groupBy("bucket").applyInArrow(match, "a long, b long").where("a <> b")
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return edges if sketches == SIMHASHES else _near_in_all(edges.distinct(), rows.select("node", F.col(kind).alias("sims")))


def _near_in_all(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``lines`` (node, sims) that differ in ``ALL_BITS`` bits or fewer of all their SimHashes."""
    side = lambda n: lines.select(F.col("node").alias(f"_{n}"), F.col("sims").alias(f"sims_{n}"))
    both = pairs.join(side("a"), F.col("a") == F.col("_a")).join(side("b"), F.col("b") == F.col("_b")).select("a", "b", "sims_a", "sims_b")

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint64).reshape(-1, SIMHASHES) for c in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array(close(x, y, ALL_BITS)))

    return both.mapInArrow(run, "a long, b long")


def distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or a larger number than ``most``: bit-parallel over the characters of ``a``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | (1 << i)
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    for j, c in enumerate(b):
        eq = places.get(c, 0)
        zero = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (full & ~(zero | plus)), plus & zero
        score += bool(up & top) - bool(down & top)
        if score - (len(b) - 1 - j) > most:
            return most + 1
        up, down = ((up << 1) | 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(zero | up)), up & zero
    return score


def common(a: str, b: str) -> int:
    """Length of the common start, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def aligned(x: list[str], y: list[str], most: int, exact: bool = False) -> int:
    """An upper bound of the edit distance of two lines of words, each followed by a space; larger than ``most`` where it gives up.

    Equal words are matched in order; where they part, the nearest equal words ahead end the gap, and a gap costs
    its longer side, or, if ``exact``, its own distance.
    """
    i = j = cost = 0
    n, m = len(x), len(y)
    while i < n and j < m:
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        p, q = n - i, m - j
        for d in range(1, AHEAD):
            ways = [k for k in range(d + 1) if i + k < n and j + d - k < m and x[i + k] == y[j + d - k]]
            if ways:
                p = min(ways, key=lambda k: abs(2 * k - d))
                q = d - p
                break
        else:
            d = min(p, q, 1)
            p = q = d
        left, right = "".join([w + " " for w in x[i : i + p]]), "".join([w + " " for w in y[j : j + q]])
        cost += distance(left, right, most) if exact else max(len(left), len(right))
        if cost > most:
            return cost
        i, j = i + p, j + q
    return cost + sum(map(len, x[i:])) + n - i + sum(map(len, y[j:])) + m - j


def surely(a: str, b: str, least: float = SIMILAR) -> bool:
    """True where words in order show that the edit similarity is ``least`` or more; False leaves it open."""
    most = math.floor((1 - least) * max(len(a), len(b)) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    x, y = a.split(" "), b.split(" ")
    return aligned(x, y, most) <= most or aligned(x, y, most, exact=True) <= most


def similar(a: str, b: str, least: float = SIMILAR) -> bool:
    """Edit similarity of ``least`` or more; a common start and end need no distance."""
    most = math.floor((1 - least) * max(len(a), len(b)) + 1e-9)
    start = common(a, b)
    a, b = a[start:], b[start:]
    end = common(a[::-1], b[::-1])
    a, b = a[: len(a) - end], b[: len(b) - end]
    if abs(len(a) - len(b)) > most or len(set(zip(a, a[1:])) - set(zip(b, b[1:]))) > 2 * most:
        return False  # an edit takes away two neighbours at most
    return distance(a, b, most) <= most


def profiles(forms: list[str]) -> np.ndarray:
    """How often each of 128 kinds of two neighbouring characters occurs in each form."""
    sizes = np.array([max(len(f) - 1, 0) for f in forms])
    runs = [_pairs_of(f)[1:-1] for f in forms]
    kind = (T.mixed(np.concatenate(runs)) % np.uint64(128)).astype(np.int64)
    return np.bincount(np.repeat(np.arange(len(forms)), sizes) * 128 + kind, minlength=128 * len(forms)).reshape(-1, 128).astype(np.int32)


def possible(a: np.ndarray, b: np.ndarray, longer: np.ndarray, least: float) -> np.ndarray:
    """False where two profiles rule the similarity out: an edit takes away two neighbours at most, and adds two at most."""
    gap = a - b
    most = np.floor((1 - least) * longer + 1e-9)
    return np.maximum(np.maximum(gap, 0).sum(axis=1), np.maximum(-gap, 0).sum(axis=1)) <= 2 * most


def forms(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, form) for ``wanted`` (node, doc_id, text_hash, line), from the documents that hold the lines."""
    asked = wanted.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_list(F.struct("line", "node")).alias("asked"))
    if wanted.count() <= FEW:
        asked = F.broadcast(asked)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("text_hash").eqNullSafe(F.col("_hash"))
    held = docs.join(asked, same).select("text", F.col("asked.line").alias("line"), F.col("asked.node").alias("node"))
    T.bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            nodes, made = [], []
            for text, line, node in zip(*(c.to_pylist() for c in batch.columns)):
                parts = (text or "").encode("utf-8", "replace").split(b"\n")
                nodes += node
                made += [normal(parts[i]).decode("utf-8") for i in line]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(made, pa.string())], ["node", "form"])

    return held.mapInArrow(run, "node long, form string").dropDuplicates(["node"])


def verified(candidates: DataFrame, placed: DataFrame, least: float) -> DataFrame:
    """Those of the candidates (a, b) whose normal forms are similar enough."""
    side = lambda n: placed.select(F.col("node").alias(f"_{n}"), F.col("form").alias(f"form_{n}"))
    pairs = candidates.join(side("a"), F.col("a") == F.col("_a")).join(side("b"), F.col("b") == F.col("_b")).select("a", "b", "form_a", "form_b")

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            fit = [surely(x, y, least) for x, y in zip(left, right)]
            if open_ := [i for i, f in enumerate(fit) if not f]:
                x, y = [left[i] for i in open_], [right[i] for i in open_]
                may = possible(profiles(x), profiles(y), np.array([max(len(v), len(w)) for v, w in zip(x, y)]), least)
                for i, m, v, w in zip(open_, may.tolist(), x, y):
                    fit[i] = m and similar(v, w, least)
            yield batch.select(["a", "b"]).filter(pa.array(fit, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def _firsts(h1, h2, known, doc, text, line, times, words, chars, has, coarse, fine) -> list[np.ndarray]:
    """Of the occurrences of each line the first, with the number of all and what any of them has measured."""
    order = np.lexsort((line, text, doc, known, h2, h1))
    new = np.append(True, (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1]))
    at, measured = order[new], np.flatnonzero(words[order] >= 0)
    group = (np.cumsum(new) - 1)[measured]
    once = np.append(True, group[1:] != group[:-1])[: len(group)]
    group, source = group[once], order[measured[once]]
    out = [x[at] for x in (h1, h2, known, doc, text, line)] + [np.add.reduceat(times[order], np.flatnonzero(new))]
    for x, none in ((words, -1), (chars, -1), (has, 0), (coarse, 0), (fine, 0)):
        made = np.full((len(at), *x.shape[1:]), none, dtype=x.dtype)
        made[group] = x[source]
        out.append(made)
    return out


def distinct_lines(every: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per line (h1, h2): its first place, how often it occurs, its measures. A task sends each of its lines once a parcel."""
    buckets = max(1, math.ceil(every.count() / bucket_rows))
    kinds = (np.uint64, np.uint64, np.uint8, np.int64, np.int64, np.int32, np.int64, np.int32, np.int32, np.uint8)

    def send(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= 200_000:
                yield parcel(held)
                held, size = [], 0
        if size:
            yield parcel(held)

    def sims_of(column) -> tuple[np.ndarray, np.ndarray]:
        there = np.array(column.is_valid())
        out = np.zeros((len(there), SIMHASHES), dtype=np.uint64)
        out[there] = np.frombuffer(b"".join(column.drop_null().to_pylist()), dtype=np.uint64).reshape(-1, SIMHASHES)
        return there, out

    def parcel(held):
        rows = pa.Table.from_batches(held)
        whole = lambda c, none: np.array(rows.column(c).fill_null(none))
        (is_coarse, coarse), (is_fine, fine) = sims_of(rows.column("coarse")), sims_of(rows.column("fine"))
        columns = _firsts(
            whole("h1", 0).view(np.uint64), whole("h2", 0).view(np.uint64), np.array(rows.column("doc_id").is_valid()).astype(np.uint8),
            whole("doc_id", 0), whole("text_hash", 0), whole("line", 0), np.ones(len(rows), dtype=np.int64),
            whole("words", -1), whole("chars", -1), (is_coarse + 2 * is_fine).astype(np.uint8), coarse, fine,
        )
        bucket = ((columns[0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # ranges of h1
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(cut))
        packed = [pa.array([planes(c[cut[b] : cut[b + 1]]) for b in full], pa.binary()) for c in columns[:-2]]
        for bit, sims in zip((1, 2), columns[-2:]):
            mine = [sims[cut[b] : cut[b + 1]][columns[-3][cut[b] : cut[b + 1]] & bit > 0] for b in full]
            packed.append(pa.array([X._zip(m.tobytes()) for m in mine], pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int64)), *packed], ["bucket", *names])

    def merge(bucket: pa.Table) -> pa.Table:
        columns = [np.concatenate([numbers(x, k) for x in bucket.column(n).to_pylist()]) for n, k in zip(names, kinds)]
        for bit, name in ((1, "c10"), (2, "c11")):
            sims = np.zeros((len(columns[0]), SIMHASHES), dtype=np.uint64)
            sims[columns[9] & bit > 0] = np.frombuffer(b"".join(map(X._unzip, bucket.column(name).to_pylist())), dtype=np.uint64).reshape(-1, SIMHASHES)
            columns.append(sims)
        h1, h2, known, doc, text, line, times, words, chars, has, coarse, fine = _firsts(*columns)
        place = [pa.array(doc, mask=known == 0), pa.array(text), pa.array(line)]
        out = {"h1": h1.view(np.int64), "h2": h2.view(np.int64), "place": pa.StructArray.from_arrays(place, ["doc_id", "text_hash", "line"]), "times": times}
        out |= {"words": pa.array(words, mask=words < 0), "chars": pa.array(chars, mask=chars < 0)}
        for bit, name, sims in ((1, "coarse", coarse), (2, "fine", fine)):
            raw, size = sims.tobytes(), 8 * SIMHASHES
            out[name] = pa.array([raw[i * size : (i + 1) * size] if h else None for i, h in enumerate((has & bit > 0).tolist())], pa.binary())
        return pa.table(out)

    names = [f"c{i}" for i in range(12)]
    sent = every.mapInArrow(send, "bucket long, " + ", ".join(f"{n} binary" for n in names))
    shape = "h1 long, h2 long, place struct<doc_id: long, text_hash: long, line: int>, times long, words int, chars int, coarse binary, fine binary"
    return sent.groupBy("bucket").applyInArrow(merge, shape)


def similar_lines(docs: DataFrame, distinct: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(node, component) of the lines of ``distinct`` that are similar to another, directly or through others."""
    count = distinct.count()

    def decided(candidates: DataFrame, among: DataFrame) -> DataFrame:
        named = candidates.select(F.explode(F.array("a", "b")).alias("_node")).distinct()
        wanted = T.stored(among.join(named, F.col("node") == F.col("_node")).select("node", "place.*"), "wanted-lines")
        return T.stored(verified(candidates, T.stored(forms(docs, wanted), "line-forms"), least), "line-links")

    first = T.stored(alike(distinct, "coarse", count, least).unionAll(alike(distinct, "fine", count, least)).distinct(), "near-lines")
    links = decided(first, distinct)
    found = T.stored(connected_components(links), "line-groups")

    # Lines that candidates unite and verified pairs don't: what else is between them is decided too.
    cluster = T.stored(connected_components(first.join(links, ["a", "b"], "left_anti").unionAll(found.select(F.col("node").alias("a"), F.col("component").alias("b")))), "line-clusters")
    state = cluster.join(found.select(F.col("node").alias("_n"), F.col("component").alias("_found")), F.col("node") == F.col("_n"), "left")
    state = state.select(F.col("node").alias("_node"), F.col("component").alias("_cluster"), F.coalesce("_found", "node").alias("component"))
    parted = state.groupBy(F.col("_cluster").alias("_open")).agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    state = state.join(parted.where("n > 2 and low <> high").select("_open"), F.col("_cluster") == F.col("_open"))
    still = T.stored(distinct.join(state, F.col("node") == F.col("_node")).select("node", "place", "chars", "coarse", "fine", "component"), "open-lines")
    more = alike(still, "coarse", count, least).unionAll(alike(still, "fine", count, least)).distinct().join(first, ["a", "b"], "left_anti")
    return connected_components(links.unionAll(decided(T.stored(more, "more-near-lines"), still)))


def removals(docs: DataFrame, least: float = SIMILAR, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_hash, gone): the line numbers to remove. ``docs``: doc_id, text_hash, text."""
    every = T.stored(lines(docs), "lines")
    place = F.struct("doc_id", "text_hash", "line")
    distinct = T.stored(distinct_lines(every).withColumn("node", F.monotonically_increasing_id()), "distinct-lines")
    found = T.stored(similar_lines(docs, distinct.where((F.col("words") >= min_words) & (F.col("chars") >= MIN_CHARS)), least), "line-components")
    grouped = distinct.join(found.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n")).select("node", "component", "place")
    keeper = grouped.groupBy(F.col("component").alias("_c")).agg(F.min("place").alias("keeper"))
    grouped = grouped.join(keeper, F.col("component") == F.col("_c")).select(F.col("node").alias("_n"), "keeper")
    distinct = distinct.select("h1", "h2", "node", "place", "times").join(grouped, F.col("node") == F.col("_n"), "left").withColumn("keeper", F.coalesce("keeper", "place"))
    several = distinct.where((F.col("times") > 1) | (F.col("keeper") != F.col("place"))).select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "keeper")
    gone = every.join(several, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).where(~place.eqNullSafe(F.col("keeper")))
    return gone.groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("gone"))


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def dedup(docs: DataFrame, least: float = SIMILAR, min_words: int = MIN_WORDS) -> DataFrame:
    """All documents; ``text`` without the lines removed, with n_lines and n_removed."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), "text")
    gone = T.stored(removals(keyed, least, min_words), "removals").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "gone")
    rest = docs.select(*[c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")])
    joined = rest.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (text_hash() == F.col("_hash")), "left")
    parts = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("gone", i)), "\n")
    joined = joined.withColumn("n_lines", F.coalesce(F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1, F.lit(0))).withColumn("n_removed", F.coalesce(F.size("gone"), F.lit(0)))
    joined = joined.withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept))
    return joined.drop("_id", "_hash", "gone")
