"""Lexical search, whitening and URL filter against plain loops and numpy."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kifuframe.llm import lexical, queries, url_filter, whitening

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- lexical search ------------------------------------------------------------------------------

def ranked(docs, items, top=20):
    """Scores of all pairs, in whole numbers."""
    counts = [(i, Counter(TERM.findall((t or "").translate(LOWERED)))) for i, t in docs]
    documents = sum(1 for _, c in counts if c)
    total = sum(sum(c.values()) for _, c in counts)
    holding = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        asked, scored = Counter(TERM.findall((text or "").translate(LOWERED))), []
        for ident, c in counts:
            n = sum(c.values())
            m = 75 + 25 * n * documents // total if total else 0
            score = sum(
                times * math.floor(1000 * math.log((2 * documents + 2) / (2 * holding[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                for t, times in asked.items() if t in c)
            if score > 0:
                scored.append((-score, ident is None, ident or 0, ident))
        out += [(item, rank, ident, -score) for rank, (score, _, _, ident) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.mark.parametrize("lead", [lexical.LEAD, 16])
def test_search_equals_all_pairs(spark, monkeypatch, lead):
    monkeypatch.setattr(lexical, "LEAD", lead)
    monkeypatch.setattr(lexical, "BUCKET", 64)
    monkeypatch.setattr(lexical, "ROUND_GROWTH", 2)
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = ranked([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 5)
    assert found(lexical.best_documents(docs, items, top=5)) == want


def test_search_of_odd_tables(spark):
    docs = [(1, None), (2, ""), (3, " .,;"), (4, "Ärger ÄRGER ärger x9"), (5, "tie word"), (6, "tie word"), (7, "tie word"), (7, "tie word"),
            (None, "tie word"), (8, "word " * 400_000), (9, "日本 word😀tail"), (10, "_under_score a\x00b")]
    items = [(1, "tie WORD word"), (2, None), (3, "  "), (4, "absent"), (5, "ärger 日本 score under b"), (6, "word😀tail"), (6, "tie"), (None, "tie")]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, TERMS int")
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, score string")
    for top in (3, 20):
        assert found(lexical.best_documents(d, q, top=top)) == ranked(docs, items, top)
    assert lexical.best_documents(d.limit(0), q).count() == lexical.best_documents(d, q.limit(0)).count() == 0
    assert lexical.best_documents(d.where("doc_id <= 3"), q).count() == 0


def test_search_in_blocks_is_the_same(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet").limit(12)
    whole = found(lexical.best_documents(docs, items))
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 5)
    assert found(lexical.best_documents(docs, items)) == whole


def test_bounds_keep_all_that_reach(monkeypatch):
    draw = np.random.default_rng(5)
    items = lexical.Items([" ".join(f"t{i}" for i in draw.integers(0, 60, 9)).encode() for _ in range(20)])
    terms = len(items.number)
    items.weigh(draw.integers(0, 3_000, terms))
    held = [np.sort(draw.choice(terms, draw.integers(1, terms), replace=False)) for _ in range(200)]
    offsets = np.concatenate(([0], np.cumsum([len(h) for h in held])))
    flat, impacts = np.concatenate(held), draw.integers(1, 900_000, int(offsets[-1]))
    roots = np.sqrt(items.weights.astype(float))
    norms = np.sqrt(np.maximum(1e-9, np.add.reduceat(items.weights[flat] * impacts.astype(float) ** 2, offsets[:-1])))
    bucket, pruned = lexical.Bucket(offsets, flat, impacts, norms, roots), 0
    gain = np.zeros(terms, np.int64)
    for i in range(20):
        gain[items.terms[i]] = items.gains[i]
        scores = bucket.exact(np.arange(200), gain)
        assert (bucket.exact(np.array([3, 90, 91]), gain) == scores[[3, 90, 91]]).all()
        gain[:] = 0
        for least in np.sort(scores)[[-1, -5, -50]]:
            alive = bucket.survivors(items.norms[i], items.focus[i], items.coordinates[i], int(least))
            assert set(np.flatnonzero(scores >= least)) <= set(alive.tolist())
            pruned += 200 - len(alive)
    assert pruned > 1_000


def test_length_factors_beyond_long():
    lengths = np.array([1 << 40, 5, 1 << 40], np.int64)
    assert lexical.length_factors(lengths, 1 << 40, 1 << 44).tolist() == [
        75 + 25 * int(n) * (1 << 40) // (1 << 44) for n in lengths]


# --- whitening -----------------------------------------------------------------------------------

def whitened(vectors, components=32):
    """Whitening by the singular values of the whole centred matrix, from exact whole numbers."""
    x = np.floor(64 * np.asarray(vectors, np.float64)).astype(np.int64) + 1_000_000
    n = len(x)
    lifted = n * x - x.sum(axis=0)
    rows = lifted / n
    _, sizes, directions = np.linalg.svd(rows, full_matrices=False)
    keep = int((sizes[:components] > 1e-12 * sizes.max()).sum())
    values = sizes ** 2 / n
    return rows @ directions[:keep].T / np.sqrt(values[:keep]), values[:keep] / values.sum(), [sum(int(v) ** 2 for v in r) for r in lifted]


def compare(rows, vectors, components=32):
    want, explained, deviation = whitened(vectors, components)
    got = np.array([r.whitened for r in rows])
    assert got.shape == want.shape
    assert [r.deviation for r in rows] == [d if d < 1 << 63 else None for d in deviation]
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got - want * signs).max() < 1e-8
    assert np.allclose(rows[0].explained, explained, rtol=1e-9) and rows[0].identity_error < 1e-9
    assert {r.n for r in rows} == {len(vectors)}


def test_whitening_equals_eigenvectors(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = whitening.whiten(table.repartition(5)).orderBy("vec_id").collect()
    compare(rows, [r.embedding for r in table.orderBy("vec_id").collect()])
    long = queries.op12_whitening(spark, SF)
    assert long.count() == 32 * len(rows) and long.columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whitening_of_dependent_and_badly_scaled_columns(spark):
    draw = np.random.default_rng(2)
    base = draw.normal(size=(400, 3)) * [1e6, 50.0, 0.5]
    vectors = np.column_stack([base, base[:, 1], np.full(400, 7.0)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    compare(whitening.whiten(df.repartition(3)).orderBy("vec_id").collect(), vectors)


def test_whitening_of_odd_tables(spark):
    rows = [(1, [1.0, 2.0], "a"), (1, [1.0, 2.0], "a"), (None, [3.0, -4.5], "b"), (2, None, "c"), (3, [1.0, None], "d"), (4, [1.0, float("nan")], "e"),
            (5, [float("inf"), 1.0], "f"), (6, [], "g"), (7, [1.0], "h"), (8, [1e300, 1.0], "i"), (9, [0.25, 0.0], "j")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, Whitened string")
    made = whitening.whiten(df)
    assert made.columns == ["vec_id", "embedding", "n", "deviation", "whitened", "explained", "identity_error"]
    got = sorted(made.collect(), key=lambda r: r.embedding)
    compare(got, [r.embedding for r in got])
    assert len(got) == 4
    assert whitening.whiten(df.limit(0)).count() == 0
    same = whitening.whiten(df.where("vec_id = 1")).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(2, 0, [], [], 0.0)] * 2


def test_deviations_beyond_machine_words():
    x = np.array([[1_000_000], [1_000_000 + (1 << 40)]])
    assert whitening.deviations(x, 2, x.sum(axis=0)) == [None, None]
    assert whitening.deviations(x[:, :1] // (1 << 20), 2, (x // (1 << 20)).sum(axis=0)) == [(1 << 20) ** 2] * 2
    big = whitening.deviations(np.array([[1_000_001]]), 10 ** 14, np.array([10 ** 20 + 10 ** 14 - 7], object))
    assert big == [49]


# --- URL filter ----------------------------------------------------------------------------------

def judged(pages, labels, rules, levels=4):
    """Plain loops over the same tree."""
    said = defaultdict(int)
    for ident, bad in labels:
        if bad is not None and ident is not None:
            said[ident] = max(said[ident], int(bad))
    parts = []
    for ident, url in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        parts.append((ident, host.translate(LOWERED), re.match(r"[^?#]*", rest[len(host):])[0]))
    tree = {(h, p): "" for _, h, p in parts}
    count = Counter((h, p) for _, h, p in parts)
    labelled = Counter((h, p) for i, h, p in parts if i in said)
    bad = Counter()
    for i, h, p in parts:
        bad[h, p] += said.get(i, 0)
    segments = {key: key[1].split("/")[1:] for key in tree}
    for level in range(levels):
        nodes = defaultdict(lambda: defaultdict(lambda: [0, 0, 0]))
        for key, template in tree.items():
            if len(segments[key]) > level:
                kid = nodes[key[0], template][segments[key][level]]
                for i, c in enumerate((count, labelled, bad)):
                    kid[i] += c[key]
        names = {}
        for node, kids in nodes.items():
            whole = sum(k[0] for k in kids.values())
            kept = sorted((k[2] / k[1], s, k) for s, k in kids.items() if k[1] >= 5 and k[0] * 20 >= whole)
            groups = []
            for at, (share, segment, kid) in enumerate(kept):
                if at:
                    last, _, before = kept[at - 1]
                    pooled = (kid[2] + before[2]) / (kid[1] + before[1])
                    apart = share - last > 1.96 * math.sqrt(pooled * (1 - pooled) * (1 / kid[1] + 1 / before[1]))
                if not at or apart:
                    groups.append([])
                groups[-1].append(segment)
            for group in groups:
                for segment in group:
                    names[node, segment] = "|".join(sorted(group))
        for key, template in list(tree.items()):
            if len(segments[key]) > level:
                tree[key] = template + "/" + names.get(((key[0], template), segments[key][level]), "*")
    for key in tree:
        tree[key] += "/**" if len(segments[key]) > levels else ""
    own, of_host = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for key, template in tree.items():
        for tally in (own[key[0], template], of_host[key[0]]):
            tally[0] += labelled[key]
            tally[1] += bad[key]
    overall = (sum(bad.values()) + 1) / (sum(labelled.values()) + 3)
    out = []
    for ident, host, path in parts:
        fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        rule = max(fits, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r), default=None)
        (n, b), (hn, hb) = own[host, tree[host, path]], of_host[host]
        share = (b + 4 * ((hb + 4 * overall) / (hn + 4))) / (n + 4)
        out.append((ident, host, path, rule and rule[1] + rule[2], rule[0] if rule else "block" if share >= 0.5 else "allow",
                    tree[host, path], round(share, 9)))
    return sorted(out, key=str)


def as_rows(df):
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict, r.template, round(r.bad_share, 9)) for r in df.collect()), key=str)


def test_urls_equal_the_loops(spark):
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    labels = [(r.doc_id, r.quality == 0 or r.toxic == 1) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    assert as_rows(queries.op13_url_filter(spark, SF)) == judged(pages, labels, queries.URL_RULES)


def test_bad_sections_and_wildcards(spark):
    rng = random.Random(4)
    pages, labels = [], []
    for i in range(3_000):
        section, bad = rng.choice([("news", 0.05), ("news", 0.05), ("blog", 0.07), ("spam", 0.95), ("ads", 0.93)])
        pages.append((i, f"https://Site.example/{section}/{rng.choice(['a', 'b'])}{i}/page/{i % 3}/x/y?q={i}"))
        if rng.random() < 0.6:
            labels.append((i, rng.random() < bad))
    pages += [(i, f"https://other.example/{i}") for i in range(5_000, 5_050)]
    made = url_filter.judge_urls(
        spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(labels, "page_id bigint, bad boolean"))
    rows = as_rows(made)
    assert rows == judged(pages, labels, [])
    verdicts = {(r[1], r[5]): r[4] for r in rows}
    assert verdicts["site.example", "/blog|news/*/page/0|1|2/**"] == "allow"
    assert verdicts["site.example", "/ads|spam/*/page/0|1|2/**"] == "block"
    assert verdicts["other.example", "/*"] == "allow"


def test_odd_urls_and_tables(spark):
    pages = [(1, None), (2, ""), (3, "no scheme/x"), (4, "http://"), (5, "http://A.NET"), (5, "http://a.net/"), (None, "x://b.org/fr/1"), (6, "a://b://c/d"),
             (7, "http://É.Example.net/en/é\n/2?x://y"), (8, "http://example.net/en/" + "s/" * 50_000), (9, "http://xexample.com/de/"),
             (10, "http://h#://f/"), (11, "http://h?a/b"), (12, "http://u.example.com//de/")]
    labels = [(1, True), (1, False), (5, None), (None, True), (2, False)]
    df = spark.createDataFrame([(i, u, 1, 2) for i, u in pages], "page_id bigint, url string, HOST int, label int")
    known = spark.createDataFrame(labels, "page_id bigint, bad boolean")
    made = url_filter.judge_urls(df, known, queries.URL_RULES)
    assert made.columns == ["page_id", "url", "label", "host", "path", "rule", "verdict", "template", "bad_share"]
    assert as_rows(made) == judged(pages, labels, queries.URL_RULES)
    assert url_filter.judge_urls(df.limit(0), known).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(df, known.limit(0)).collect()} == {"allow"}


def test_url_filter_runs_no_python(spark):
    plan = queries.op13_url_filter(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
