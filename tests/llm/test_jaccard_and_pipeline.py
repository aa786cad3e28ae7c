"""The Jaccard join and the pipeline against brute force."""

import pathlib
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

import corpus_pipeline
from kifuframe.llm import jaccard, quality
from kifuframe.session import shared_dir

SF = "/root/testdata/sf0.001"


def word_sets(text, size):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return set()
    size = min(size, len(words))
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


def brute(rows, size, percent):
    """``(n, component)`` of each row, by comparing all pairs."""
    sets = [word_sets(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (ident, _) in enumerate(rows):
        least[find(i)].append(ident)
    smallest = {r: min((x for x in ids if x is not None), default=None) for r, ids in least.items()}
    return [(rows[i][0], len(sets[i]), smallest[find(i)]) for i in range(len(rows))]


def planted(seed=1):
    """Near copies at and around the threshold, chains, equal sets, a shared passage, and odd texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3_000)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows, ident = [], 1_000
    for length in (5, 9, 14, 30, 60, 120, 250):
        for _ in range(3):
            words = [rng.choice(vocabulary) for _ in range(length)]
            chain = list(words)
            for step in range(6):
                rows.append((ident, " ".join(chain)))
                ident -= 1
                chain[rng.randrange(len(chain))] = f"new{ident}"
                if step % 3 == 2:
                    chain.append(f"more{ident}")
    for _ in range(60):
        own = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 20, 60])))
        rows.append((ident, f"{own} {passage}" if rng.random() < 0.5 else f"{passage} {own}"))
        ident -= 1
    rows += [(2_000, "Equal Set"), (1_999, "equal  SET"), (1_998, None), (1_997, ""), (1_996, " \n"), (1_995, "lonely"),
             (None, "lonely"), (None, "nobody else"), (1_994, rows[0][1]), (1_994, rows[0][1]), (1_993, "é " * 5_000)]
    rng.shuffle(rows)
    return rows


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("size, percent, partners", [(4, 85, 16), (5, 80, 16), (4, 85, 0.001), (3, 60, 0.001)])
def test_components_of_planted_copies(spark, monkeypatch, size, percent, partners):
    monkeypatch.setattr(jaccard, "PARTNERS", partners)
    rows = planted()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, root string").repartition(4)
    got = [tuple(r) for r in jaccard.similar_components(docs, words=size, percent=percent).collect()]
    assert ordered(got) == ordered(brute(rows, size, percent))


def crowd(seed, count, own_words, passages=1):
    """Texts around shared passages, most of them just out of reach of each other, with some links among them."""
    rng = random.Random(seed)
    shared = [" ".join(f"p{i}x{j}" for j in range(60)) for i in range(passages)]
    rows = []
    for ident in range(count):
        own = [f"o{rng.randrange(own_words)}" if own_words else f"o{ident}x{i}" for i in range(9)]
        rows.append((ident, f"{rng.choice(shared)} {' '.join(own)}"))
        if ident % 11 == 0:
            own[rng.randrange(9)] = f"n{ident}"
            rows.append((ident + 10_000, f"{rows[-1][1].split(' o')[0]} {' '.join(own)}"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("own_words, passages, partners", [(0, 1, 4), (30, 1, 4), (30, 3, 0.5)])
def test_components_of_crowds(spark, monkeypatch, own_words, passages, partners):
    monkeypatch.setattr(jaccard, "PARTNERS", partners)
    made, verify = [], jaccard._Search.verify

    def counted(self, pairs):
        made.append(pairs.count())
        return verify(self, pairs)

    monkeypatch.setattr(jaccard._Search, "verify", counted)
    rows = crowd(3, 220, own_words, passages)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = [tuple(r) for r in jaccard.similar_components(docs).collect()]
    want = brute(rows, 4, 85)
    assert ordered(got) == ordered(want)
    assert 5 < sum(r[0] != r[2] for r in want) < 120
    assert sum(made) < 12 * len(rows)  # of 28,000 pairs


def test_sets_that_differ_from_a_lead_meet():
    """Two sets in reach, not both linked to a lead of any size, share a first difference in any order."""
    rng, tried = np.random.default_rng(7), 0
    for percent in (60, 80, 85):
        for _ in range(600):
            lead = np.unique(rng.integers(0, 1 << 63, int(rng.integers(45, 75)), dtype=np.uint64))
            base = altered(rng, lead, int(rng.integers(1, 60)))
            a, b = altered(rng, base, int(rng.integers(0, 14))), altered(rng, base, int(rng.integers(0, 14)))
            if not jaccard.in_reach(a, b, percent):
                continue
            (la, da, fa, ma), (lb, db, fb, mb) = (jaccard.differences(x, lead, percent) for x in (a, b))
            assert la == jaccard.in_reach(a, lead, percent) and fa <= ma and fb <= mb
            if la and lb:
                continue
            tried += 1
            for order in (np.sort, lambda x: np.sort(x)[::-1], lambda x: x[np.argsort(jaccard.mixed(x))]):
                first, second = (order(da)[:fa], order(db)[:mb]) if len(da) <= len(db) else (order(da)[:ma], order(db)[:fb])
                assert set(first.tolist()) & set(second.tolist())
    assert tried > 200


def test_little_is_left_in_the_shared_folder(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    folder = pathlib.Path(shared_dir(spark)) / "kifuframe" / "llm"
    before = set(folder.glob("jaccard-*")) | set(folder.glob("components-*"))
    jaccard.similar_components(docs).count()
    jaccard.keep_one_of_each(docs).count()
    left = (set(folder.glob("jaccard-*")) | set(folder.glob("components-*"))) - before
    assert sorted(p.name.rsplit("-", 1)[0] for p in left) == ["jaccard-found", "jaccard-kept"]


def test_components_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [tuple(r) for r in jaccard.similar_components(docs).collect()]
    assert sorted(got) == sorted(brute(rows, 4, 85))
    assert any(r[0] != r[2] for r in got)


def test_empty_and_wordless_tables(spark):
    schema = "doc_id bigint, text string"
    assert jaccard.similar_components(spark.createDataFrame([], schema)).count() == 0
    lone = jaccard.similar_components(spark.createDataFrame([(1, None), (2, " "), (2, " ")], schema)).collect()
    assert sorted(map(tuple, lone)) == [(1, 0, 1), (2, 0, 2), (2, 0, 2)]


def altered(rng, elements, changes):
    out = elements.copy()
    keep = rng.permutation(len(out))[changes // 2:]
    fresh = rng.integers(0, 1 << 63, changes - changes // 2, dtype=np.uint64)
    return np.unique(np.concatenate((out[keep], fresh)))


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
def test_bands_reach_the_largest_sets(percent):
    bands = jaccard.Bands(percent)
    for size in (17_903_974, 17_903_975, 40_000_000, 1 << 31):  # a text is below 2 GB
        at = bands.at(size)
        assert at in bands.of(size) and bands.differ[at] > 0 and bands.low[at] <= size < bands.low[at + 1]
        assert at in bands.of(-(-size * percent // 100))
    assert len(bands.low) <= 1 << jaccard.BAND_BITS


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
def test_pairs_in_reach_always_share_signatures(percent):
    """More equal segments than the slack at the first level, a subset or deletion at the second."""
    rng = np.random.default_rng(percent)
    bands = jaccard.Bands(percent)
    tried = 0
    for size in (3, 7, 12, 20, 33, 60, 150, 400, 1_500):
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            most = bands.differ[int(np.searchsorted(bands.low, size, side="right")) - 1]
            b = altered(rng, a, int(rng.integers(0, most + 1)))
            if not len(b) or not jaccard.in_reach(a, b, percent) or len(a) == len(b) and (a == b).all():
                continue
            tried += 1
            first, second = (set(jaccard.subset_signatures(x, bands).tolist()) for x in (a, b))
            assert first & second
            band = int(np.searchsorted(bands.low, max(len(a), len(b)), side="right")) - 1
            assert band in bands.of(len(a)) and band in bands.of(len(b))
            mask = (1 << jaccard.BAND_BITS) - 1
            prints = [jaccard.subsets(x, bands)[1][bands.of(len(x)).index(band)] for x in (a, b)]
            equal = int((prints[0] == prints[1]).sum())
            assert equal >= bands.segments[band] - (len(a) + len(b)) * (100 - percent) // (100 + percent)
            assert equal > bands.slack[band]
            shared = sum(s & mask == band for s in first & second)
            both_empty = int(((prints[0] == 0) & (prints[1] == 0)).sum())
            unnamed = min((n for n in (int((p == 0).sum()) for p in prints) if n <= bands.slack[band]), default=0)
            assert both_empty <= min(int((p == 0).sum()) for p in prints) and shared > bands.slack[band] - unnamed
            first, second = (set(jaccard.deletion_signatures(x, band, bands).tolist()) for x in (a, b))
            assert first & second
    assert tried > 60


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.root for r in jaccard.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_one_of_each_group_stays(spark):
    rows = [(5, "a b c d e f g", "p"), (3, "a b c d e f g", "q"), (3, "a b c d e f g", "q"), (9, None, "r"), (9, None, "r"), (8, "x y", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, Row string")
    kept = jaccard.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.where("row = 's' or row = 'r'").collect() + docs.where("row = 'q'").limit(1).collect()))
    assert jaccard.keep_one_of_each(docs.limit(0)).count() == 0


def lines_left(rows):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for ident, text in rows:
        for line in text.split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(ident)
    return [(ident, "\n".join(
        line for line in text.split("\n") if len(holders.get(key(line), ())) < 3 or ident == max(holders[key(line)])))
        for ident, text in rows]


def test_pipeline_equals_the_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    squeeze = zstandard.ZstdCompressor(level=quality.LEVEL)
    rows = [(r.doc_id, r.text) for r in docs.collect() if quality.measure(r.text, squeeze)[6]]
    assert 0 < len(rows) < docs.count()
    rows = lines_left(rows)
    rows = [r for r, (ident, _, least) in zip(rows, brute(rows, 5, 80)) if ident == least]
    packed = corpus_pipeline.run(spark, SF).collect()
    tokens = defaultdict(int)
    for r in packed:
        tokens[r.doc_id] += r.length
    assert set(tokens) == {ident for ident, _ in rows}
    assert all(tokens[r.doc_id] == r.doc_tokens for r in packed)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert tokens == {ident: len(library.encode(text, add_special_tokens=False).ids) + 1 for ident, text in rows}


def test_stages_pass_on_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "packing"]


def test_links_within_a_block(monkeypatch):
    monkeypatch.setattr(jaccard, "SLAB", 7)
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 63, 60, dtype=np.uint64))
    sets = [altered(rng, base, int(rng.integers(0, 9))) for _ in range(50)] + [altered(rng, base, 60)]
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if jaccard.in_reach(sets[a], sets[b], 85):
                root = [root[b] if r == root[a] else r for r in root]
    got = list(range(len(sets)))
    links = jaccard.links_within(sets, 85)
    for a, b in links:
        got = [got[b] if r == got[a] else r for r in got]
    pairs = {(a, b) for a in range(len(sets)) for b in range(a)}
    assert all((root[a] == root[b]) == (got[a] == got[b]) for a, b in pairs)
    assert len(links) == len(sets) - len(set(root)) and 1 < len(set(root)) < 45


def test_components_of_many_links_take_rounds(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "IN_ONE_TASK", 0)
    test_components_of_a_long_path(spark)


@pytest.mark.parametrize("block", [jaccard.BLOCK, (0, 0, 0)])
def test_crowds_of_few_small_sets_are_not_parted(spark, monkeypatch, block):
    """A set of whom nothing is left but rare elements meets nobody; a crowd is one block, or is parted by leads if blocks are ruled out."""
    parted, found = jaccard._Search.parted, []
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "PARTNERS", 0.01)
    monkeypatch.setattr(jaccard._Search, "parted", lambda self, crowded: found.append(1) or parted(self, crowded))
    rows = crowd(4, 80, 12, 1)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    assert ordered([tuple(r) for r in jaccard.similar_components(docs).collect()]) == ordered(brute(rows, 4, 85))
    assert not (found and block[0])


def test_signatures_texts_and_elements_are_shuffled_in_slices(spark, monkeypatch):
    """No step shuffles all signatures, texts or elements at once, nor holds texts and signatures in one table."""
    parts, tables = defaultdict(list), {}
    in_parts, stored = jaccard.Scratch.stored_in_parts, jaccard.Scratch.stored

    def counted(self, frames, name):
        def each():
            for frame in frames:
                parts[name].append(frame.count())
                yield frame

        return in_parts(self, each(), name)

    monkeypatch.setattr(jaccard.Scratch, "stored_in_parts", counted)
    monkeypatch.setattr(jaccard.Scratch, "stored", lambda self, df, name, small=False: tables.setdefault(name, df.columns) and stored(self, df, name, small))
    monkeypatch.setattr(jaccard, "IN_ONE_SLICE", 0)
    monkeypatch.setattr(jaccard, "PARTNERS", 0.01)
    rows = crowd(4, 80, 12, 1)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    assert ordered([tuple(r) for r in jaccard.similar_components(docs).collect()]) == ordered(brute(rows, 4, 85))
    assert set(parts) == {"jaccard-members", "jaccard-texts", "jaccard-parts"}
    for counts in parts.values():
        assert len(counts) == jaccard.SLICES and 0 < max(counts) < 0.5 * sum(counts)
    assert "signatures" in tables["jaccard-sets"] and "c1" not in tables["jaccard-sets"]
