"""Quality rules, line dedup, main text and fingerprints against plain loops."""

import hashlib
import html as entities
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from kifuframe.llm import html_text, line_dedup, quality, winnowing

SF = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"
ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "\n\n"), (6, "a\x00b ퟿ 😀 é x"), (None, "no id " * 30),
    (7, "same text " * 40), (7, "same text " * 40), (8, "x" * 60_000), (9, "word " * 30_000),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "kept", 1) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, Kept string, n_lines int")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base_counts(text):
    text = text or ""
    words = words_of(text)
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i:i + 8])].append(i)
    covered = {i + j for places in windows.values() if len(places) > 1 for i in places for j in range(8)}
    lines = [x for x in text.split("\n") if words_of(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered), failed)


def verdict(text):
    raw = (text or "").encode()
    if not raw:
        return False
    size = lambda b: len(zstandard.ZstdCompressor(level=quality.LEVEL).compress(b)) / len(b)
    low, high = next((lo, hi) for most, lo, hi in quality.BANDS if len(raw) <= most)
    step = quality.CHUNK_BYTES
    parts = [size(raw[i:i + step]) for i in range(0, len(raw) - step + 1, step)]
    outside = sum(not quality.CHUNK_BAND[0] <= p <= quality.CHUNK_BAND[1] for p in parts)
    return low <= size(raw) <= high and outside <= quality.CHUNKS_OUTSIDE * len(parts)


def test_quality_equals_the_loop(documents, odd):
    for docs in (documents, odd):
        for r in quality.judge(docs.select("doc_id", "text")).collect():
            want = base_counts(r.text)
            got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
            assert got == want, (r.doc_id, got, want)
            assert r.kept == (not want[5] and verdict(r.text))


def test_quality_tells_noise_from_prose(spark, documents):
    rng = random.Random(5)
    prose = max((r.text for r in documents.collect()), key=len)[:3_000]
    noise = "".join(chr(rng.randrange(33, 600)) + (" " if i % 7 == 0 else "") for i in range(3_000))
    table = " | ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(500))
    rows = spark.createDataFrame([(1, prose), (2, noise), (3, table)], "doc_id int, text string")
    assert {r.doc_id: r.kept for r in quality.judge(rows).collect()} == {1: True, 2: False, 3: False}


def labelled(spark, quality_label, folder="/root/testdata/sf0.1"):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels.where(F.col("quality") == quality_label), "doc_id").select("doc_id", "lang", "text").dropDuplicates(["text"])
    return sorted((r.doc_id, r.lang, r.text) for r in rows.collect())


def alphabet(lower, upper):
    return {ord("a") + i: lower + i for i in range(26)} | {ord("A") + i: upper + i for i in range(26)}


def without_near_copies(texts):
    seen = set()
    for text in texts:
        words = text.split()
        runs = {tuple(words[i:i + 8]) for i in range(len(words) - 7)}
        if not runs & seen:
            yield text
        seen |= runs


def test_quality_keeps_long_documents(spark):
    good, squeeze = labelled(spark, 1), zstandard.ZstdCompressor(level=quality.LEVEL)
    random.Random(1).shuffle(good)
    for lang in ("de", "en", "es", "fr"):
        text = "\n".join(without_near_copies(t for _, x, t in good if x == lang))
        for n in (20_000, 60_000, 150_000, 300_000, 500_000, len(text)):
            assert all(quality.measure(text[i:i + n], squeeze)[6] for i in range(0, len(text) - n + 1, n)), (lang, n)
    assert len(text) > 500_000 and not quality.measure(text[:5_000] * 100, squeeze)[6]


@pytest.mark.parametrize("lower, upper", [(0x430, 0x410), (0x3B1, 0x391), (0x621, 0x641), (0x905, 0x925), (0x10D0, 0x10A0)])
def test_quality_does_not_depend_on_the_script(spark, lower, upper):
    squeeze, table = zstandard.ZstdCompressor(level=quality.LEVEL), alphabet(lower, upper)
    good, bad = ([t for _, _, t in labelled(spark, label)] for label in (1, 0))
    for text in good[:600] + ["\n".join(good)[:1_200_000]]:
        assert quality.measure(text.translate(table), squeeze)[6] == quality.measure(text, squeeze)[6]
    assert sum(quality.measure(t.translate(table), squeeze)[6] for t in bad) <= 1.02 * sum(quality.measure(t, squeeze)[6] for t in bad)
    rng = random.Random(2)
    noise = " ".join("".join(chr(lower + rng.randrange(26)) for _ in range(6)) for _ in range(500))
    assert not quality.measure(noise, squeeze)[6] and not quality.measure("слово за слово " * 400, squeeze)[6]


def test_quality_of_ideographs():
    rng, squeeze = np.random.default_rng(1), zstandard.ZstdCompressor(level=quality.LEVEL)
    signs = rng.permutation(np.arange(0x4E00, 0x9FA5))[:3_500]
    law = lambda n, k: 1 / (np.arange(n) + k) / (1 / (np.arange(n) + k)).sum()
    words = ["".join(map(chr, rng.choice(signs, k, p=law(3_500, 8)))) for k in rng.choice([1, 2, 3], 20_000)]
    for n in (500, 2_000, 8_000):
        prose = "，\n".join("".join(words[i] for i in rng.choice(20_000, 20, p=law(20_000, 3))) for _ in range(n // 20))
        noise = "，\n".join("".join(map(chr, rng.integers(0x4E00, 0x9FA5, 40))) for _ in range(n // 20))
        assert quality.measure(prose, squeeze)[6] and not quality.measure(noise, squeeze)[6]
        assert not quality.measure(prose[:200] * (n // 100), squeeze)[6]


def test_quality_keeps_columns_and_empty_tables(odd):
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and kept.collect() == []
    assert quality.judge(odd.limit(0)).count() == 0
    assert [c.lower() for c in quality.judge(odd).columns].count("kept") == 1


def lines_without_repeats(rows, min_chars=20, min_docs=3):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(BLANKS))
    holders = defaultdict(list)
    for i, (_, text) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].append(i)
    out = []
    for i, (ident, text) in enumerate(rows):
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            held = holders.get(key(line), [])
            top = max((rows[j][0] for j in held if rows[j][0] is not None), default=None)
            if len({rows[j][0] for j in held}) < min_docs or ident == top:
                kept.append(line)
        out.append((ident, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup_equals_the_loop(spark, documents, odd):
    common = "  This Line is long enough to COUNT \t"
    made = [(i, f"{common}\nown {i}\n{common.upper()}\n" + "short\n" * 3) for i in range(40)] + [
        (None, common.strip()), (39, common), (50, "Ünlong line that stays ÄÖ as it is"), (51, "ünlong line that stays äö as it is"),
        (52, "ünlong line that stays ÄÖ as it is")]
    for docs in (documents.select("doc_id", "text"), odd.select("doc_id", "text"),
                 spark.createDataFrame(made, "doc_id bigint, text string").repartition(5)):
        rows = [tuple(r) for r in docs.collect()]
        got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(docs).collect()]
        assert sorted(got, key=str) == lines_without_repeats(rows)


def test_line_dedup_counts_documents(spark):
    line = "a line that is long enough"
    rows = [(1, line), (1, line + "\nmore"), (2, line), (3, "other line, long enough\n" * 3), (3, "other line, long enough"),
            (4, "third line, long enough"), (5, "third line, long enough"), (None, "third line, long enough"), (None, "third line, long enough")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, N_LINES int").repartition(3)
    made = line_dedup.dedup_lines(docs)
    assert made.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in made.collect()), key=str)
    assert got == lines_without_repeats(rows) and sum(r[2] for r in got) == 3


def test_line_dedup_columns_and_empty_tables(odd):
    out = line_dedup.dedup_lines(odd)
    assert out.columns == ["doc_id", "text", "Kept", "n_lines", "n_dropped"] and out.count() == len(ODD)
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


def article(page):
    inner = page[page.index("<article>") + 9:page.index("</article>")]
    parts = (entities.unescape(re.sub(r"<[^>]+>", "", p)) for p in re.split(r"<(?:/?p|/?h1|br)>", inner))
    return "\n".join(x for x in (" ".join(p.split()) for p in parts) if x)


def test_main_text_of_the_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in html_text.extract_text(pages).collect():
        assert r.text == article(r.html), r.page_id


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<nav>Menu</nav>", ""), ("plain  text\n only", "plain text only"),
    ("<p>a &amp; b<br>c&nbsp;&lt;d&gt;</p>", "a & b\nc <d>"),
    ("<p>one<p>two<b>half</b><div>three", "one\ntwohalf\nthree"),
    ("<script>if (a < b) document.write('<p>no</p>')</script><p>yes</p><style>p{}</style>", "yes"),
    ("<body><div class='menu'>Home</div><div id=story><p>Long story text.</p><p>End.</p></div>"
     "<section class='comments'><p>me too</p></section><form>Name<input></form><aside>more</aside></body>", "Long story text.\nEnd."),
    ("<div role=navigation>x</div><main><h1>T</h1>body<ul><li>i</ul></main><footer>f</footer>", "T\nbody\ni"),
    ("<article>x<!-- <p>hidden</p> --><div class=ad>buy</div><p>y</article>", "x\ny"),
    ("<div style='display:none'>secret</div><p>seen</p>", "seen"), ("<p>a < b and un<closed <i", "a < b and un<closed <i"),
])
def test_main_text_of_odd_pages(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("page, text", [
    ("<script>if(a<b){c()}</script><p>Article</p>", "Article"),
    ("<p>x</p><script>for(i=0;i<n;i++){s='<!--'}</script><p>Article</p>", "x\nArticle"),
    ("<script>i<n;s=\"it's</p>\"</script><p>Article</p><p class='a'>it's</p>", "Article\nit's"),
    ("<SCRIPT type='a/b'>a<b</sCript\n><p>Article</p>", "Article"), ("<script>a<b</scripts></script ><p>Article", "Article"),
    ("<style>a::after{content:'<b'}</style>one<style>/*<!--*/</style> two", "one two"),
    ("a<svg><style>p<q{}</style><path/></svg>b<noscript><img alt='<!--'></noscript>c", "abc"),
    ("<head><script>a<b</script><title>t</title></head><body><p>Article</body>", "Article"),
    ("<p>Article<textarea>a<b</textarea> goes on", "Article goes on"), ("<p>Article<script>a<b", "Article"),
])
def test_main_text_after_raw_content(page, text):
    assert html_text.main_text(page) == text


LONG = "A long paragraph of the story, which goes on and on for a while. " * 12


@pytest.mark.parametrize("page, text", [
    (f"<section><p>{LONG}</section><section><p>A short one.</section>", f"{LONG.strip()}\nA short one."),
    (f"<p>{LONG}<table><tr><td>1<td>2</table><p>The end.", f"{LONG.strip()}\n1\n2\nThe end."),
    (f"<div><p>{LONG}<table><tr><td>1<td>2</table></div>", f"{LONG.strip()}\n1\n2"),
    (f"<div class='content has-sidebar'><p>{LONG}</div>", LONG.strip()), (f"<div class=with-comments><p>{LONG}</div>", LONG.strip()),
    (f"<div class='content has-sidebar'><article><p>{LONG}</article></div>", LONG.strip()),
    (f"<div class='sidebar'><article><p>{LONG}<div class=ad>Buy this now.</div></article></div>", LONG.strip()),
    (f"<article><p>{LONG}</article><div class=comments><article>First!</article></div>", LONG.strip()),
    (f"<div id=main-menu><div class=widget>Buy.</div><p>{LONG}</div><div>Home</div>", LONG.strip()),
    (f"<div><a href=/>Home</a> <a href=/a>About us</a></div><div><h1>Title</h1></div><div><p>{LONG}</div><div>Contact</div>",
     f"Title\n{LONG.strip()}"),
    (f"<div><p>{LONG}</div><div><p>Short.</div><div>&copy; 2024 The Site.</div>", f"{LONG.strip()}\nShort."),
    (f"<div><p>{LONG}</div><div class='cookie-banner'>We use cookies.</div><div class='site-nav top'>Go. On.</div>", LONG.strip()),
])
def test_main_text_without_article_tags(page, text):
    assert html_text.main_text(page) == text


EMPTY = ["<!DOCTYPE html>", "   ", "<p></p>", "<br>", "<img src=x>", "<script>x</script>", "&nbsp;", "<!-- only -->", "<article></article>",
         "<div class=ad>Buy.</div>", "\n\t\x0b", "<nav>Menu</nav><main> </main>"]
BESIDE = ["user-comments", "post-comments", "article-comments", "wp-comments", "responses", "ad-slot", "adsbygoogle", "cookie-policy-banner",
          "page-header", "site-header", "header", "related-posts", "signup-form", "relatedPosts", "userComments"]


def test_pages_without_text(spark):
    pages = spark.createDataFrame(list(enumerate(EMPTY)), "page_id int, html string")
    assert [r.text for r in html_text.extract_text(pages).orderBy("page_id").collect()] == [
        "Buy." if "Buy" in page else "" for page in EMPTY[:9]] + [html_text.main_text(p) for p in EMPTY[9:]]
    assert html_text.main_text(EMPTY[10]) == html_text.main_text(EMPTY[11]) == ""


@pytest.mark.parametrize("name", BESIDE)
def test_blocks_beside_and_in_the_article(name):
    other = f"<div class='{name} x1'><p>Some words of another kind. They are not few, and they go on for a while.</div>"
    body = f"<header><h1>Title</h1></header><p>{LONG}<p>End."
    want = f"Title\n{LONG.strip()}\nEnd."
    assert html_text.main_text(f"{other}<article>{body}</article>{other}") == want
    plain = body.replace("<header>", "").replace("</header>", "")
    assert html_text.main_text(f"{other}<div class=story>{plain}</div>{other}") == want
    if "header" not in name:
        assert html_text.main_text(f"<article><header><h1>Title</h1></header><p>{LONG}{other}<p>End.</article>") == want
    wrapped = f"<div class='{name}'><article>{body}</article></div>"
    assert html_text.main_text(wrapped) == want


@pytest.mark.parametrize("page, text", [
    (f"<article><p title=\"x>broken</p><p>{LONG}</p></article><p>end \" q</p>", f"broken\n{LONG.strip()}"),
    (f"<article><p title='a > b' data-x=\"<b>c</b>\">{LONG}</p></article>", LONG.strip()),
    (f"<article><p>{LONG}</p><a href=\"x\"\">more</a></article>", f"{LONG.strip()}\nmore"),
    (f"<article><p>{LONG}</p></article><article><a href=/b>Other story</a><p>Read on.</article>", LONG.strip()),
    (f"<article><p>{LONG}</p></article><article><p>{LONG}</article>", f"{LONG.strip()}\n{LONG.strip()}"),
    (f"<article><p>{LONG}</p><article><p>First! Nice story, thank you.</article></article>", LONG.strip()),
    (f"<div><p>We use cookies. Accept them?</div><div><p>{LONG}</div><div>This site sets cookies; see our policy.</div>", LONG.strip()),
    (f"<article><div class='article-ad-body'><p>{LONG}</div></article>", LONG.strip()),
    (f"<button>Go<div><p>{LONG}</div>", LONG.strip()), (f"<div class=entry-header><h1>T</h1></div><p>{LONG}", f"T\n{LONG.strip()}"),
])
def test_main_text_of_broken_and_crowded_pages(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("page", [
    "<p>x " + "<a " * 200_000, "<a \"" * 150_000, "<x" * 300_000, "<a b=\"" * 100_000 + ">", "<a b=\">" * 100_000, "<br b='\">" * 100_000,
    "<div>" * 100_000 + "</p>" * 100_000, "<div class=ad>" * 50_000 + "x" + "</div>" * 50_000, "<article>" * 50_000 + "<p>x", "</a>" * 200_000,
    "<!--" * 200_000, "<script>" * 100_000, "<select>" * 100_000, "<table><tr><td>x" * 50_000, "<div class=menu><p>Some words, a sentence.</div>" * 20_000,
])
def test_main_text_takes_time_in_proportion(page):
    start = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - start < 6


def test_main_text_of_the_pages_without_their_article_tags(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        for tag in ("div", "section"):
            bare = r.html.replace("<article>", f"<{tag}>").replace("</article>", f"</{tag}>")
            assert html_text.main_text(bare) == article(r.html), r.page_id


def test_main_text_columns(spark):
    pages = spark.createDataFrame([(1, "<p>a</p>", "old"), (1, None, "old")], "page_id int, html string, Text string")
    out = html_text.extract_text(pages)
    assert out.columns == ["page_id", "html", "text"] and sorted(r.text for r in out.collect()) == ["", "a"]
    assert html_text.extract_text(pages.limit(0)).count() == 0


def slow_winnow(codes, gram=winnowing.GRAM, window=winnowing.WINDOW):
    if not len(codes):
        return []
    hashes = winnowing.gram_hashes(codes, min(gram, len(codes))).tolist()
    window, found = min(window, len(hashes)), set()
    for i in range(len(hashes) - window + 1):
        part = hashes[i:i + window]
        low = min(part)
        found.add(i + max(j for j, h in enumerate(part) if h == low))
    return sorted((p, hashes[p]) for p in found)


@pytest.mark.parametrize("text", ["", "a", "short", "x" * 400, "ab" * 300, "".join(map(chr, range(300, 900))), "é😀 " * 200])
def test_winnowing_equals_the_loop(text):
    codes = winnowing.codes_of(text)
    places, hashes = winnowing.winnow(codes)
    assert list(zip(places.tolist(), hashes.tolist())) == slow_winnow(codes)


def test_gram_hashes_roll():
    codes = winnowing.codes_of("abcdefghijklmnopqrstuvwxyz" * 2)
    for gram in (1, 2, 3, 7, 16, 21):
        all_at_once = winnowing.gram_hashes(codes, gram)
        assert all(all_at_once[i] == winnowing.gram_hashes(codes[i:i + gram], gram)[0] for i in range(len(all_at_once)))
        assert len(set(all_at_once.tolist())) == 26


def test_long_texts_go_through_in_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    codes = rng.integers(97, 100, 5_000).astype(np.uint32)
    whole = winnowing.winnow(codes)
    keep = winnowing.HASH_BITS
    monkeypatch.setattr(winnowing, "_PLACES", (1 << 10) - 1)  # pieces of 1,023 positions
    pieces = winnowing.winnow(codes)
    assert keep == winnowing.HASH_BITS and whole[0].tolist() == pieces[0].tolist()


def test_a_shared_run_shares_a_fingerprint():
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    for _ in range(50):
        shared = word(winnowing.WINDOW + winnowing.GRAM - 1)
        a, b = (set(winnowing.winnow(winnowing.codes_of(word(rng.randrange(200)) + shared + word(rng.randrange(200))))[1].tolist())
                for _ in range(2))
        assert a & b


def slow_successors(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for (ident, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        n = len(text)
        edited = text[:n - n // 4] + after[:n // 4]
        marks = [{h for _, h in slow_winnow(winnowing.codes_of(t))} for t in (text, edited, after)]
        near = [1.0 if not marks[0] and not m else len(marks[0] & m) / len(marks[0] | m) for m in marks[1:]]
        out.append((ident, n, hashlib.sha256(edited.encode()).hexdigest(), *map(lambda x: round(x, 9), near)))
    return Counter(out)


def test_successors_equal_the_loop(spark, documents, odd):
    few = spark.createDataFrame([(5, "only one text here")], "doc_id bigint, text string")
    small = odd.where(F.coalesce(F.length("text"), F.lit(0)) < 1_000)
    for docs in (documents.limit(60), small, few, small.limit(0), documents.where("doc_id < 3")):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        got = winnowing.compare_with_next(docs.repartition(3)).collect()
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == (
            slow_successors(rows) if rows else Counter())
    prints = winnowing.fingerprint(odd).collect()
    same = [r.fingerprints for r in prints if r.doc_id == 7]
    assert same[0] == same[1] and len(prints) == len(ODD)
