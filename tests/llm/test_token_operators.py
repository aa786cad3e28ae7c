"""SentencePiece, packing, sharding, WARC and preference formatting against the libraries and plain loops."""

import base64
import gzip
import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kifuframe.llm import chat, oracles, packing, pieces, queries, sharding, warc
from kifuframe.session import shared_dir

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [(1, None), (2, ""), (3, " "), (4, "  two  spaces "), (5, "日本語 😀 é\x00\n▁ mark"), (6, "x" * 20_000), (7, "same"), (7, "same"),
       (None, "no id"), (8, "word " * 20_000), (9, "<|endoftext|> </s> <0x41>")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", 0.5) for i, t in ODD], "doc_id bigint, text string, IDS string, start double")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_pieces_equal_the_library(spark, documents, odd, library):
    for docs in (documents.select("doc_id", "text"), odd.select("doc_id", "text")):
        rows = pieces.decode(pieces.encode(docs, MODEL), MODEL).collect()
        assert len(rows) == docs.count()
        for r in rows:
            want = library.encode(r.text or "") + [2]
            assert r.ids == want and r.decoded == library.decode(want) and r.n_differing == 0
    assert pieces.encode(odd.drop("IDS").limit(0), MODEL).count() == 0


def test_agendas_agree():
    words, rng = pieces.vocabulary(MODEL), random.Random(3)
    parts = ["▁" + "".join(rng.choice("abcdeéthing▁\n日🙂") for _ in range(rng.randint(1, 40))) for _ in range(500)]
    assert words.merge_side_by_side(parts) == [words.merge_on_heap(p) for p in parts]


def test_decoding_any_ids_equals_the_library(spark, library):
    rng = random.Random(4)
    lists = [[rng.choice([rng.randrange(32_000), rng.randrange(3, 259), rng.randrange(3)]) for _ in range(rng.randint(0, 12))]
             for _ in range(500)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)] + [(-1, None)], "i int, ids array<int>")
    got = {r.i: r.decoded for r in pieces.decode(rows, MODEL).collect()}
    assert got.pop(-1) == "" and got == {i: library.decode(x) for i, x in enumerate(lists)}


def check_packing(rows, texts, window):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    want = Counter()
    for ident, text in texts:
        want[ident, tuple(tok.encode(text or "", add_special_tokens=False).ids + [0])] += 1
    sequences = defaultdict(list)
    found = defaultdict(lambda: defaultdict(list))
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        found[r.doc_id, r.doc_tokens][r.start].append(ids)
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= window
    fills = Counter(sum(n for _, n in v) == window for v in sequences.values())
    assert fills[False] <= 1  # only the last sequence is short
    assert sum(len(v) for d in found.values() for p in d.values() for v in p) == sum(len(k[1]) * n for k, n in want.items())
    for (ident, ids), times in want.items():
        if times == 1 and sum(k[0] == ident for k in want) == 1:
            parts = found[ident, len(ids)]
            assert sum((p[0] for _, p in sorted(parts.items())), []) == list(ids) and all(len(p) == 1 for p in parts.values())


@pytest.mark.parametrize("window", [1_024, 96])
def test_packing_keeps_every_token(spark, documents, odd, window):
    for docs in (documents.select("doc_id", "text"), odd):
        rows = packing.pack_documents(docs.repartition(3), window=window).collect()
        check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()], window)
    assert packing.pack_documents(odd.limit(0)).count() == 0


MARKS = ["before <|endoftext|> after", "<|endoftext|>", "<|endoftext|><|endoftext|>", "a<|endoftext|>b", "end <|endoftext|>",
         "<|endoftext|> x", "  <|endoftext|>\n\n<|endoftext|>  ", "<|endoftext|", "<|<|endoftext|>|>", "<|ENDOFTEXT|>", "é😀<|endoftext|>日本",
         "word " * 3_000 + "<|endoftext|>" + " tail" * 3_000]


def test_packing_reads_added_tokens_like_the_unmodified_library(spark, tmp_path):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert tok.encode(MARKS[0], add_special_tokens=False).ids == [19052, 220, 50256, 706]
    want = {i: tok.encode(t, add_special_tokens=False).ids + [0] for i, t in enumerate(MARKS)}
    docs = spark.createDataFrame(list(enumerate(MARKS)), "doc_id bigint, text string")
    found = defaultdict(list)
    for r in packing.pack_documents(docs, added_tokens=True).collect():
        assert r.doc_tokens == len(want[r.doc_id])
        found[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    assert {i: sum((x for _, x in sorted(v)), []) for i, v in found.items()} == want
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op5_packing(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.doc_tokens for r in rows} == {i: len(v) for i, v in want.items()}
    whole = {r.doc_id: r.ids_crc32 for r in rows if r.length == r.doc_tokens}
    assert len(whole) > 8 and all(c == zlib.crc32(np.array(want[i], "<u4").tobytes()) for i, c in whole.items())


def test_packing_a_length_that_fits_nowhere(spark):
    docs = spark.createDataFrame([(i, "the " * 69) for i in range(200)], "doc_id bigint, text string")
    rows = packing.pack_documents(docs, window=128).collect()
    check_packing(rows, [(i, "the " * 69) for i in range(200)], 128)


def test_fit_solves_what_has_a_solution():
    histogram = np.zeros(100, np.int64)
    for combination, repeat in (((30, 70), 400), ((20, 25, 55), 300), ((50, 50), 150)):
        for n in combination:
            histogram[n] += repeat
    fitted = packing.fitted_repeats(histogram, 100)
    assert all(sum(c) == 100 for c, _ in fitted)
    used = Counter()
    for combination, repeat in fitted:
        for n in combination:
            used[n] += repeat
    assert all(used[n] <= histogram[n] for n in used) and sum(used.values()) >= 0.97 * histogram.sum()


def test_combinations_are_all_of_them():
    lengths = np.array([2, 3, 5, 7, 8, 10])
    got = {tuple(x for x in c if x) for c in packing.combinations(lengths, 15).tolist()}
    want = {(a, b) for a in lengths for b in lengths if a <= b and a + b == 15} | {
        (a, b, c) for a in lengths for b in lengths for c in lengths if a <= b <= c and a + b + c == 15}
    assert got == {tuple(map(int, w)) for w in want}


def test_shards_are_even_whole_and_repeatable(spark, documents, odd):
    for docs in (documents.select("doc_id", "text"), odd):
        rows = sharding.uniform_shards(docs, 16).collect()
        by_shard = defaultdict(list)
        for r in rows:
            by_shard[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
        sizes = [len(by_shard[i]) for i in range(16)]
        assert max(sizes) - min(sizes) <= 1 and sum(sizes) == docs.count()
        assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in docs.collect())
    assert sharding.uniform_shards(odd.limit(0)).count() == 0
    clash = sharding.uniform_shards(odd.withColumnRenamed("IDS", "Shard"), 4)
    assert clash.columns == ["doc_id", "text", "start", "shard", "slot"]


def test_matrix_has_exact_margins_and_the_right_mean():
    starts = np.array([0, 5, 5, 40, 100, 130])
    sizes = sharding.even_sizes(130, 7)
    rows = np.array([sharding.row_of_matrix(i, sizes, starts, 3) for i in range(5)])
    assert rows.sum(axis=0).tolist() == sizes.tolist() and rows.sum(axis=1).tolist() == np.diff(starts).tolist()
    many = np.array([sharding.row_of_matrix(3, sizes, starts, seed) for seed in range(400)])
    assert many.mean(axis=0) == pytest.approx(60 * sizes / 130, rel=0.05)
    share = sizes / 130
    assert many.var(axis=0) == pytest.approx(60 * share * (1 - share) * 70 / 129, rel=0.35)


@pytest.mark.parametrize("rows", [1_000_000_000, 10_000_000_007, 3 * 10 ** 13])
def test_matrix_of_many_rows(rows):
    starts = np.array([0, rows // 9, rows // 9, rows // 2, rows - 7, rows])
    for sizes in (sharding.even_sizes(rows, 7), np.array([rows]), np.array([0, rows - 5, 5])):
        matrix = np.array([sharding.row_of_matrix(i, sizes, starts, 3) for i in range(5)])
        assert (matrix >= 0).all() and matrix.sum(axis=0).tolist() == sizes.tolist()
        assert matrix.sum(axis=1).tolist() == np.diff(starts).tolist()
    sizes, share = sharding.even_sizes(rows, 7), 1 / 7
    own = int(starts[4] - starts[3])
    many = np.array([sharding.row_of_matrix(3, sizes, starts, seed) for seed in range(400)])
    spread = (own * share * (1 - share) * (rows - own) / (rows - 1)) ** 0.5
    far = (many - own * share) / spread
    assert abs(far.mean(axis=0)).max() < 0.2 and far.var(axis=0) == pytest.approx(np.ones(7), rel=0.35)


def test_large_draws_have_the_law_of_small_ones(monkeypatch):
    draw = np.random.default_rng(5)
    monkeypatch.setattr(sharding, "NUMPY_ROWS", 4)
    for good, bad, sample in ((5, 9, 6), (9, 5, 10), (1, 12, 3), (30, 20, 25), (3, 2, 5), (6, 0, 2)):
        got = Counter(sharding.hypergeometric(draw, good, bad, sample) for _ in range(20_000))
        for x in range(sample + 1):
            p = math.comb(good, x) * math.comb(bad, sample - x) / math.comb(good + bad, sample)
            assert abs(got[x] / 20_000 - p) < 0.016, (good, bad, sample, x)


def test_every_row_reaches_every_shard_alike(spark):
    rows = spark.range(64).repartition(4)
    seen = Counter()
    for seed in range(12):
        seen.update((r.id % 2, r.shard) for r in sharding.uniform_shards(rows, 2, seed).collect())
    assert all(130 <= seen[a, b] <= 254 for a in (0, 1) for b in (0, 1))


PAGES = [(5, "http://a/ x\r\n", "same page"), (3, "http://b/", "same page"), (9, None, "same page"), (3, "http://c/", "same page"),
         (7, "http://d/é", None), (1, "http://e/", ""), (2, "http://f/", "alone 😀"), (None, "http://g/", "same page"),
         (4, "http://h/", "long " * 50_000)]


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id bigint, url string, html string, digest string")
    manifest = warc.write_warc(pages.repartition(3), f"file://{tmp_path}/out", shards=3).collect()
    rows = warc.read_warc(spark, f"file://{tmp_path}/out").collect()
    assert len(rows) == len(PAGES) == sum(m.records for m in manifest)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    got = Counter((warc.ident_of(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, warc.ident_of(r.refers_to_id))
                  for r in rows)
    first = {"same page": 3, "": 1}
    want, answered = Counter(), set()
    for ident, _, html in sorted(PAGES, key=lambda p: (p[0] is None, p[0] or 0)):
        text = html or ""
        key = (len(text.encode()), digest(text))
        if text in answered:
            want[(ident, *key, "revisit", first[text])] += 1
        else:
            want[(ident, *key, "response", None)] += 1
            answered.add(text)
    assert got == want
    assert {r.payload.decode() for r in rows if r.record_type == "response"} == {h or "" for _, _, h in PAGES}
    names = sorted(n for n in os.listdir(tmp_path / "out") if n.endswith(".gz"))
    assert names == sorted(m.name for m in manifest) and not (tmp_path / "out" / "_temporary").exists()
    for m in manifest:
        raw = (tmp_path / "out" / m.name).read_bytes()
        assert (len(raw), hashlib.sha256(raw).hexdigest()) == (m.bytes, m.sha256)
        assert gzip.decompress(raw).count(b"WARC/1.1\r\n") == m.records


def test_archives_are_the_same_bytes_however_the_input_lies(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    sums = []
    for i, layout in enumerate((pages, pages.repartition(5), pages.orderBy(F.desc("page_id")))):
        rows = warc.write_warc(layout, f"{tmp_path}/{i}", shards=4, roll_bytes=20_000).collect()
        sums.append(sorted((r.name, r.sha256) for r in rows))
        assert all(r.bytes <= 20_000 or r.records == 1 for r in rows) and len(rows) > 4
    assert sums[0] == sums[1] == sums[2]


def test_small_payloads_are_never_revisits_and_tables_may_be_empty(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")],
                                  "page_id int, url string, html string")
    warc.write_warc(pages, f"{tmp_path}/a", least_bytes=3)
    kinds = {warc.ident_of(r.record_id): r.record_type for r in warc.read_warc(spark, f"{tmp_path}/a").collect()}
    assert kinds == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    assert warc.write_warc(pages.limit(0), f"{tmp_path}/b").count() == 0
    assert warc.read_warc(spark, f"{tmp_path}/b").count() == 0


def test_damage_is_noticed():
    record = zlib.decompress(warc.record_bytes(1, 0, "u", b"payload", warc.digest32(b"payload"), None), 31)
    assert warc.parse_record(record)[4:6] == (7, warc.digest32(b"payload"))
    for bad in (record.replace(b"payload", b"paYload"), record[:-5]):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def said(*turns):
    return [("p", i, role, text) for i, (role, text) in enumerate(turns)]


@pytest.mark.parametrize("chosen, rejected, prompt, tails", [
    (said(("user", "q"), ("assistant", "good")), said(("user", "q"), ("assistant", "bad")), 1, ("good", "bad")),
    (said(("user", "q")), said(("user", "q")), 1, ("", "")),
    (said(("user", "q"), ("assistant", "a")), said(("user", "q")), 1, ("a", "")),
    (said(("user", "q"), ("assistant", "a")), [], 0, ("qa", "")),
    (said((None, None), ("assistant", "a")), said((None, None), ("user", "a")), 1, ("a", "a")),
    (said(("user", "q"), ("assistant", "a"), ("user", "r"), ("assistant", "b")),
     said(("user", "q"), ("assistant", "a"), ("user", "s"), ("assistant", "b")), 2, ("rb", "sb")),
])
def test_preference_pairs(spark, chosen, rejected, prompt, tails):
    schema = "conv_id string, turn int, role string, text string"
    frames = [spark.createDataFrame([(*r, "x") for r in side], schema + ", prompt string").repartition(2) for side in (chosen, rejected)]
    row = chat.preference_pairs(*frames).first()
    render = lambda turns: "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for _, _, r, t in turns)
    assert row.prompt_turns == prompt and row.prompt == render(chosen[:prompt])
    for parts, turns, tail in ((row.chosen, chosen, tails[0]), (row.rejected, rejected, tails[1])):
        assert "".join(p.text for p in parts) == render(turns[prompt:])
        trained = [t for _, _, r, t in turns[prompt:] if r == "assistant"]
        assert [p.text for p in parts if p.train] == [t + "<|im_end|>\n" for t in trained]
        assert "".join(t for _, _, _, t in turns[prompt:] if t) == tail


def test_preference_pairs_of_empty_tables_and_null_ids(spark):
    schema = "conv_id string, turn int, role string, text string"
    some = spark.createDataFrame([(None, 1, "user", "q"), ("a", None, "user", "q"), ("a", 1, "assistant", "r"), ("a", 1, "assistant", "r")], schema)
    assert chat.preference_pairs(some.limit(0), some.limit(0)).count() == 0
    rows = {r.conv_id: r for r in chat.preference_pairs(some, some.limit(0)).collect()}
    assert set(rows) == {None, "a"} and len(rows["a"].chosen) == 6 and rows["a"].rejected == []


def test_swapped_answers_end_with_the_answer_and_agree_with_the_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = [(2, None, "user", "n"), (2, 0, "user", "q"), (2, 1, "assistant", "a"), (2, 2, "user", "after"),
            (3, 0, "user", "r"), (3, 1, "assistant", "b"), (4, None, "user", "n"), (4, 0, "user", "q"),
            (6, 0, "user", "q"), (6, 1, "assistant", "c"), (6, 2, "user", "after")]
    talks = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    got = {tuple(r) for r in chat.swapped_answers(talks).collect()}
    assert got == {(2, 0, "user", "q"), (2, 1, "assistant", "b"), (3, 0, "user", "r"), (3, 1, "assistant", "a"),
                   (4, None, "user", "n"), (4, 0, "user", "q"), (6, 0, "user", "q")}
    base = duckdb.connect()
    base.execute("CREATE TABLE conversations (conv_id BIGINT, turn INT, role VARCHAR, text VARCHAR)")
    base.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r for r in rows if r[1] is not None])
    want = {r[0]: r[5] for r in base.execute(oracles.PREFERENCE_PAIRS).fetchall()}
    known = talks.where("turn is not null")
    pairs = chat.preference_pairs(known, chat.swapped_answers(known))
    assert {r.conv_id: r.text for r in pairs.select("conv_id", chat.text_of(F.col("rejected")).alias("text")).collect()} == want


def test_masks_count_characters(spark):
    row = spark.createDataFrame([("a", 1, "assistant", "é😀")], "conv_id string, turn int, role string, text string")
    pair = chat.preference_pairs(row, row.limit(0)).select(
        chat.mask_of(F.col("chosen")).alias("mask"), chat.text_of(F.col("chosen")).alias("text")).first()
    assert pair.mask == "0:22,1:13" and len(pair.text) == 35


@pytest.mark.parametrize("run", [" ", "\n", "\t", "a", "7", "é", " \n", "ab ", "!"])
def test_very_long_runs_equal_the_library(spark, run):
    text = "before " + run * (2_000_000 // len(run)) + " after"
    model, ranks = (public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken"))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text, "short"])], names=["_id", "_text"])
    (made,) = packing.tokens_of([batch], "_text", model, ranks, 0, True)
    library = Tokenizer.from_file(model)
    assert np.frombuffer(made.column("_ids")[0].as_py(), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids + [0]
    assert np.frombuffer(made.column("_ids")[1].as_py(), "<u2").tolist() == library.encode("short", add_special_tokens=False).ids + [0]


def test_shards_equal_the_whole_matrix(spark):
    """Every label of every stored partition, written out from the whole matrix."""
    folder = shared_dir(spark) + "/shards-by-hand"
    spark.range(0, 997, 1, 7).write.mode("overwrite").parquet(folder)
    table, shards, seed = spark.read.parquet(folder), 6, 11
    mark = F.monotonically_increasing_id()
    where = {r.id: (r.p, r.i) for r in table.select("id", F.shiftright(mark, 33).alias("p"), mark.bitwiseAND(F.lit((1 << 33) - 1)).alias("i")).collect()}
    counts = Counter(p for p, _ in where.values())
    parts = sorted(counts)
    per = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    sizes = np.concatenate([sharding.even_sizes(int(n), per) for n in sharding.even_sizes(997, shards)])
    starts = np.concatenate(([0], np.cumsum([counts[p] for p in parts])))
    matrix = np.stack([sharding.row_of_matrix(i, sizes, starts, seed) for i in range(len(parts))])
    assert (matrix.sum(axis=0) == sizes).all() and (matrix.sum(axis=1) == [counts[p] for p in parts]).all() and (matrix >= 0).all()
    want = {}
    for i, p in enumerate(parts):
        label = np.repeat(np.arange(len(sizes)), matrix[i])
        np.random.default_rng([seed, 1, i]).shuffle(label)
        want |= {(p, place): int(cell) // per for place, cell in enumerate(label)}
    rows = sharding.uniform_shards(table, shards, seed).collect()
    assert {r.id: r.shard for r in rows} == {ident: want[place] for ident, place in where.items()}
    for shard in range(shards):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(int(sharding.even_sizes(997, shards)[shard])))
