"""Line dedup and the Jaccard join against brute force, small blocks included, and the pipeline's stages."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framelake.llm import graph, jaccard, line_dedup, mixing, quality, toxicity
from framelake.llm import text as T

DOCS = "doc_id long, text string"
SF = "/root/testdata/sf0.001"


def roots(n, pairs):
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    return [top(i) for i in range(n)]


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(5, 3), (3, 9), (9, 5), (None, 3), (7, 8)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)]])
def test_components(spark, edges):
    got = graph.connected_components(spark.createDataFrame(edges, "a long, b long"))
    real = [(a, b) for a, b in edges if a is not None and a != b]
    nodes = sorted(set(itertools.chain(*real)))
    at = {n: i for i, n in enumerate(nodes)}
    want = roots(len(nodes), [(at[a], at[b]) for a, b in real])
    assert sorted(map(tuple, got.collect())) == [(n, nodes[r]) for n, r in zip(nodes, want)]


def corpus(seed, words=40, families=6, size=14):
    """Families of edited copies, chains, exact copies, shared passages and odd texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    passage = " ".join(word() for _ in range(25))
    texts = []
    for _ in range(families):
        now = [word() for _ in range(words)]
        for k in range(size):
            copy = list(now)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
            if k % 3 == 0:
                now = copy  # a chain: late members are far from early ones
    texts += [texts[0]] * 5 + [texts[3].upper()] + [passage + " " + " ".join(word() for _ in range(30)) for _ in range(15)]
    return texts + [passage, "", None, "one", "one", "two words", " \n ", "x" * 50_000]


def plain_sets(texts, width):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append(frozenset([tuple(w)]) if 0 < len(w) < width else frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)))
    return out


@pytest.mark.parametrize("width, least, block", [(4, 85, 512), (5, 80, 4), (3, 50, 3), (2, 30, 7)])
def test_jaccard_components_equal_brute_force(spark, monkeypatch, width, least, block):
    monkeypatch.setattr(jaccard.components, "__defaults__", (block,))
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    monkeypatch.setattr(jaccard, "HEAVY", 5)
    texts = corpus(width)
    sets = plain_sets(texts, width)
    links = [
        (a, b) for a, b in itertools.combinations(range(len(texts)), 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])
    ]
    want = roots(len(texts), links)
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumns({"sig": F.lit(1), "chunk": F.lit("x"), "n_shingles": F.lit("y")})
    got = jaccard.join(docs.repartition(4), width, least, (3, 4))
    assert sorted(map(tuple, got.collect())) == [(i, len(sets[i]), want[i]) for i in range(len(texts))]
    assert len(links) > 50


def test_jaccard_edges(spark):
    text = "a b c d e f g h"
    rows = spark.createDataFrame([(4, text), (4, text), (2, text), (None, text), (7, None)], DOCS)
    assert sorted(map(tuple, jaccard.join(rows).collect()), key=repr) == sorted([(4, 4, 2), (4, 4, 2), (2, 4, 2), (None, 4, None), (7, 0, 7)], key=repr)
    assert sorted(repr(r.doc_id) for r in jaccard.representatives(rows).collect()) == ["2", "7", "None"]
    assert jaccard.join(rows.limit(0)).count() == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distance_equals_the_table():
    rng = random.Random(7)
    for _ in range(300):
        a, b = ("".join(rng.choice("abé") for _ in range(rng.randrange(12))) for _ in range(2))
        true = levenshtein(a, b)
        for most in (0, 2, 5, 20):
            assert (line_dedup.distance(a, b, most) == true) if true <= most else (line_dedup.distance(a, b, most) > most)
        assert line_dedup.similar(a, b, 0.8) == (true <= 0.2 * max(len(a), len(b)) + 1e-9)
        assert line_dedup.common(a, b) == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("count", [2, 1 << 21, 1 << 30])
def test_keys_are_pairs_of_equal_blocks(count):
    rng = np.random.default_rng(count % 97)
    width, keys = line_dedup.blocks(count)
    number = 192 // width
    assert len(set(keys)) == len(keys) and all(0 <= a < b < number for a, b in keys) and count / 2 ** (2 * width) <= line_dedup.CROWD
    sims = rng.integers(0, 2**63, (50, 3), dtype=np.uint64)
    for row in sims:
        whole = sum(int(x) << 64 * i for i, x in enumerate(row))
        assert [int(line_dedup.block(row[None], width, i)[0]) for i in range(number)] == [whole >> i * width & (1 << width) - 1 for i in range(number)]


def test_simhash_is_the_majority_of_the_feature_hashes(monkeypatch):
    rng = np.random.default_rng(1)
    sizes = np.array([1, 2, 7, 300, 70_000])
    flat = rng.integers(0, 2**63, sizes.sum(), dtype=np.uint64)
    got, at = line_dedup.simhashes(flat, sizes), 0
    for row, n in zip(got, sizes.tolist()):
        for k, seed in enumerate(line_dedup._SEEDS):
            hashes = T.mixed(flat[at : at + n] + seed)
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            assert np.packbits(2 * bits > n).view(np.uint64)[0] == row[k]
        at += n


def plain_links(forms):
    """All pairs that share a key and are near in one SimHash, then similar by their texts."""
    _, chars, *kinds = line_dedup.signatures(forms)
    links = set()
    for raw, (kind, (sketches, bits)) in zip(kinds, line_dedup.GATES.items()):
        width, keys = line_dedup.blocks(int((chars >= line_dedup.MIN_CHARS).sum()), kind)
        at = [i for i, r in enumerate(raw) if r is not None]
        if not at:
            continue
        sims = np.frombuffer(b"".join(raw[i] for i in at), dtype=np.uint64).reshape(-1, 3)
        cells = [line_dedup.block(sims, width, i) for i in range(192 // width)]
        for x in range(len(at)):
            met = np.any([(cells[a] == cells[a][x]) & (cells[b] == cells[b][x]) for a, b in keys], axis=0)
            met &= np.bitwise_count(sims ^ sims[x])[:, :sketches].sum(axis=1) <= bits
            met &= np.bitwise_count(sims ^ sims[x]).sum(axis=1) <= line_dedup.ALL_BITS
            links |= {(at[x], at[y]) for y in np.flatnonzero(met).tolist() if y > x and line_dedup.similar(forms[at[x]].decode(), forms[at[y]].decode())}
    return sorted(links)


def plain_dedup(rows):
    """What dedup keeps: occurrences by id, groups by equal form or by SimHash and edit similarity."""
    places = sorted((i, j, line_dedup.normal(x.encode())) for i, t in rows for j, x in enumerate((t or "").split("\n")))
    places = [p for p in places if p[2]]
    forms = sorted({p[2] for p in places})
    links = plain_links(forms)
    group = dict(zip(forms, roots(len(forms), links)))
    seen, gone = set(), set()
    for i, j, f in places:
        if group[f] in seen:
            gone.add((i, j))
        seen.add(group[f])
    kept = {i: None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) not in gone) for i, t in rows}
    return kept, gone, links


@pytest.mark.parametrize("short_run, gate", [(256, 14), (3, 30)])
def test_line_dedup_equals_brute_force(spark, monkeypatch, short_run, gate):
    monkeypatch.setattr(line_dedup, "SHORT_RUN", short_run)
    monkeypatch.setitem(line_dedup.GATES, "coarse", (1, gate))
    monkeypatch.setattr(line_dedup, "ALL_BITS", 40 if gate < 20 else 90)
    rng = random.Random(short_run)
    long = " ".join(f"w{i}" for i in range(120))
    variants = [long.replace(f"w{i} ", f"v{i} ", 1) for i in range(0, 100, 2)]
    pool = [" ".join(f"u{rng.randrange(90)}" for _ in range(rng.randrange(1, 9))) for _ in range(40)] + variants + ["", "***", "A, b!", "a b"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(8)))) for i in range(60)] + [(60, None), (61, ""), (62, "\n\n"), (63, long + " x" * 20_000)]
    kept, gone, links = plain_dedup(rows)
    docs = spark.createDataFrame(rows, DOCS).withColumns({"n_lines": F.lit("mine"), "line": F.lit(1), "gone": F.lit("z")}).drop("gone")
    got = {r.doc_id: r for r in line_dedup.dedup(docs.repartition(3)).collect()}
    assert {i: r.text for i, r in got.items()} == kept
    assert {i: r.n_removed for i, r in got.items() if r.n_removed} == {i: sum(g[0] == i for g in gone) for i in {g[0] for g in gone}}
    assert len(links) > 20 and line_dedup.dedup(docs.limit(0)).count() == 0


def test_line_dedup_of_repeated_and_null_ids(spark):
    rows = spark.createDataFrame([(None, "same line"), (1, "same line"), (1, "same line"), (2, "Same, LINE!\nother")], DOCS)
    got = sorted(((r.doc_id, r.text) for r in line_dedup.dedup(rows).collect()), key=repr)
    assert got == sorted([(None, "same line"), (1, ""), (1, ""), (2, "other")], key=repr)


def edited_pairs(seed, low, high, n=150):
    """Pairs of lines of ``low`` to ``high`` words of which some are replaced, at an edit similarity of 0.8 or more."""
    rng, pairs = random.Random(seed), []
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.choice((2, 3, 3, 4, 5, 6, 7, 8, 9)))) for _ in range(5000)]
    while len(pairs) < n:
        words = [vocabulary[min(int(rng.paretovariate(0.7)) - 1, 4999)] for _ in range(rng.randint(low, high))]
        other = list(words)
        for i in rng.sample(range(len(words)), max(1, round(len(words) * rng.uniform(0.02, 0.22)))):
            other[i] = rng.choice(vocabulary)
        a, b = " ".join(words), " ".join(other)
        if a != b and line_dedup.similar(a, b):
            pairs.append((a, b))
    return pairs


@pytest.mark.parametrize("low, high, share", [(8, 20, 0.6), (20, 60, 0.5)])
def test_line_dedup_finds_edited_lines_by_edit_similarity_alone(spark, low, high, share):
    """Up to a fifth of a line edited: SimHash meets a part of such pairs (README), unlike those of the documents below."""
    pairs = edited_pairs(low, low, high)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(t for p in pairs for t in p)], DOCS)
    gone = line_dedup.dedup(docs).where("n_removed = 1").count()
    assert gone >= share * len(pairs)


def test_line_dedup_finds_the_similar_lines_of_documents(spark):
    """Brute force by edit similarity alone over the lines of the smallest table."""
    texts = [r.text for r in T.documents(spark, SF).collect()]
    forms = sorted({f.decode() for f in line_dedup._lines(texts)[2]}, key=len)
    sizes = np.array([len(f) for f in forms])
    profile = line_dedup.profiles(forms)
    links = []
    for i in range(len(forms)):
        near = np.arange(i + 1, np.searchsorted(sizes, sizes[i] / line_dedup.SIMILAR + 1e-9, side="right"))
        near = near[line_dedup.possible(profile[near], profile[i], sizes[near], line_dedup.SIMILAR)] if sizes[i] >= line_dedup.MIN_CHARS else near[:0]
        links += [(i, int(j)) for j in near if line_dedup.similar(forms[i], forms[j])]
    docs = spark.createDataFrame(list(enumerate(forms)), DOCS)
    kept = docs.count() - line_dedup.dedup(docs).where("n_removed = 1").count()
    groups = len(set(roots(len(forms), links)))
    assert len(links) > 20 and kept >= groups and len(forms) - kept >= 0.9 * (len(forms) - groups)


def test_line_dedup_of_few_words_and_scripts_without_spaces(spark):
    rng = random.Random(3)
    han = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(300)) for _ in range(20)]
    short = ["click here to subscribe", "all rights reserved worldwide", "photograph by staff"]
    texts = [t for h in han for t in (h, h[:150] + "x" + h[151:])] + [t for s in short for t in (s, s[:-1] + "z")]
    kept = line_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), DOCS)).where("n_removed = 0")
    assert {r.doc_id for r in kept.collect()} == set(range(0, len(texts), 2))


def test_pipeline_stages_do_what_they_say(spark, tmp_path):
    docs = T.documents(spark, SF).withColumn("extra", F.lit(1))
    labels = T.table(spark, SF, "labels")
    for name in ("documents", "labels"):
        (docs if name == "documents" else labels).write.parquet(str(tmp_path / f"{name}.parquet"))
    now, before = docs, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = T.stored(stage(spark, now, str(tmp_path)), "test-stage")
        rows = out.collect()
        if name != "packing":
            assert out.columns == docs.columns
        if name == "toxicity":
            model = toxicity.fit(now, labels)
            assert {r.doc_id for r in rows} == {i for i, t in before.items() if model.score(t) < 0.5}
        elif name == "line_dedup":
            kept, _, _ = plain_dedup(sorted(before.items()))
            assert {r.doc_id: r.text for r in rows} == {i: t for i, t in kept.items() if t.split() or t == before[i]}
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "jaccard_join":
            ids = sorted(before)
            sets = plain_sets([before[i] for i in ids], 5)
            links = [(a, b) for a, b in itertools.combinations(range(len(ids)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            assert {r.doc_id for r in rows} == {ids[i] for i in set(roots(len(ids), links))}
        elif name == "mixing":
            sizes = {i: len(t.split()) for i, t in before.items()}
            assert abs(sum(sizes[r.doc_id] for r in rows) - 1.5 * sum(sizes.values())) <= max(sizes.values()) / 2
            source = {r.doc_id: r.source for r in rows} | {r.doc_id: r.source for r in now.select("doc_id", "source").collect()}
            wanted = {r.source: r.target for r in mixing.plan(now).collect()}
            for name, target in wanted.items():  # within the largest document of the source
                taken = sum(sizes[r.doc_id] for r in rows if r.source == name)
                assert abs(taken - target) <= max(n for i, n in sizes.items() if source[i] == name)
        else:
            assert sum(r.length for r in rows) > 0 and {r.doc_id for r in rows} == set(before)
        now, before = out, {r.doc_id: getattr(r, "text", None) for r in rows}
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity"
    assert quality.MIN_WORDS == 50


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls everywhere, repeats, a very long text, and extra columns named like the stages' own results."""
    long = " ".join(f"w{i}" for i in range(60_000))
    fine = "one two three four five six seven eight nine ten"
    rows = [(1, fine, "en", "a", 1), (1, fine, "en", "a", 1), (2, None, None, None, None), (None, "some other words that are kept here", None, None, None), (3, "", "en", "a", 0), (4, " \n\t", "en", "b", 3), (5, long, "en", "b", None)]
    names = {c: F.lit("mine") for c in ("score", "predicted", "size", "taken", "copies", "cuts", "target", "n_lines", "n_removed", "gone", "component", "component_id", "n_shingles", "cell", "key", "sequence_id", "ids")}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns(names)
    spark.createDataFrame([(1, 0), (5, 0), (None, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        docs = T.stored(stage(spark, docs, str(tmp_path)), "test-odd")
        if name != "packing":
            assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and set(names) <= set(docs.columns)
            assert {r.score for r in docs.select("score").collect()} <= {"mine"}
            got = docs.collect()
            assert sum(r.text == long for r in got) >= 1 and sum(r.text is None for r in got) == (name != "mixing")
        else:
            assert docs.agg(F.sum("length")).first()[0] > 60_000


def test_pairs_inside_one_component_are_not_held():
    """A large group of near copies under one key, all but one row of it in one component already."""
    import tracemalloc

    n = 4_000
    sims = np.zeros((n, 1), dtype=np.uint64)
    group = np.where(np.arange(n) == n - 1, 1, 0)
    tracemalloc.start()
    left, right = line_dedup.near_pairs(np.zeros(n, dtype=np.uint32), sims, np.full(n, 50, dtype=np.int64), group, 14, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(zip(left.tolist(), right.tolist())) == [(i, n - 1) for i in range(n - 1)]
    assert peak < 20e6


def test_repeated_lines_are_measured_once_a_task(spark, monkeypatch):
    text = "the quick brown fox jumps over the lazy dog today\nab cd\nThe quick brown fox, jumps over the lazy dog today!"
    docs = spark.createDataFrame([(i, i, text) for i in range(40)], "doc_id long, text_hash long, text string").coalesce(1)
    got = line_dedup.lines(docs).collect()
    assert len(got) == 120 and sum(r.words is not None for r in got) == 2 and sum(r.coarse is not None for r in got) == 1
    gone = line_dedup.removals(docs).collect()
    assert sorted((r.doc_id, sorted(r.gone)) for r in gone) == [(0, [2])] + [(i, [0, 1, 2]) for i in range(1, 40)]


def test_numbers_of_planes_are_the_same_and_packed_tightly():
    rng = np.random.default_rng(1)
    for kind in (np.int64, np.uint32, np.int32):
        for n in (0, 1, 5_000):
            values = rng.integers(0, 1 << 20, n).astype(kind)
            packed = line_dedup.planes(values)
            assert line_dedup.numbers(packed, kind).tolist() == values.tolist()
            assert n < 5_000 or len(packed) < 0.95 * len(line_dedup.X._zip(values.tobytes()))


def test_words_of_all_lines_are_hashed_at_once():
    """A word has one hash wherever it stands, and others have others; repeats in a line count once."""
    rng = random.Random(5)
    words = list({"".join(rng.choice("abé中") for _ in range(rng.randrange(1, 9))).encode() for _ in range(3000)})
    forms = [b" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    raw, ends, counts = line_dedup._ends(forms)
    flat = [w for f in forms for w in f.split()]
    assert counts.tolist() == [len(f.split()) for f in forms]
    hashes = dict(zip(flat, line_dedup.word_hashes(raw, ends).tolist()))
    assert len(set(hashes.values())) == len(hashes) and [hashes[w] for w in flat] == line_dedup.word_hashes(raw, ends).tolist()
    assert line_dedup._coarse([b"x y x z", b"z y x"]).tolist()[0] == line_dedup._coarse([b"z y x"]).tolist()[0]


def test_edited_lines_need_no_full_distance():
    """Words in order accept most similar lines, and never one that isn't similar."""
    pairs = edited_pairs(3, 20, 60)
    sure = [line_dedup.surely(a, b) for a, b in pairs]
    assert sum(sure) >= 0.7 * len(pairs)
    for (a, _), (b, _) in itertools.pairwise(pairs):
        assert not line_dedup.surely(a, b) or line_dedup.similar(a, b)
    rng = random.Random(4)
    for _ in range(300):
        a, b = (" ".join(rng.choice(("ab", "abc", "é", "xyz", "abd")) for _ in range(rng.randrange(1, 12))) for _ in range(2))
        assert line_dedup.similar(a, b) or not line_dedup.surely(a, b)


def test_distinct_lines_keep_the_first_place_and_all_measures(spark):
    text = "the quick brown fox jumps over the lazy dog today\nab cd\nab cd"
    docs = spark.createDataFrame([(i, (i or 0) % 7, text) for i in (None, *range(60))], "doc_id long, text_hash long, text string").where("doc_id is null or doc_id > 3")
    every = T.stored(line_dedup.lines(docs.repartition(5)), "test-lines")
    got = {r.words: r for r in line_dedup.distinct_lines(every, bucket_rows=1).collect()}
    assert sorted(got) == [2, 10] and got[10].times == 57 and got[2].times == 114
    assert tuple(got[10].place)[0] is None and got[10].place.line == 0 and got[2].place.line == 1
    assert got[10].coarse is not None and got[2].coarse is None and got[2].fine is not None and got[10].chars == 49
