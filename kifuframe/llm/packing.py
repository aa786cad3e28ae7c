"""Packing of token sequences into windows by non-negative least squares.

Full windows of long documents stand alone. For the lengths that remain, all combinations of two
or three that fill a window are enumerated, their repeat counts are fitted to the histogram of
lengths, rounded to whole numbers, and what they leave is packed greedily, cutting a piece where
no other fits. The plan is made from the histogram alone, whose size is the window.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kifuframe.llm.common import batches_of, kept_in_worker, stored

WINDOW = 1_024
ROUNDS = 400
MOST_COMBINATIONS = 2_048
#: Ids are kept in so many bytes while they travel; the vocabularies here have fewer than 65,536 ids.
ID_TYPE = np.dtype("<u2")
DOCS_AT_ONCE = 500
#: The fast encoder's pattern runs out of stack on very long runs; texts with a run of so many blanks, or of anything else, go to ``tokenizers``.
LONG_RUN = 50_000


# --- tokens ------------------------------------------------------------------------------------

def _tokenizers(model: str, ranks: str, added: bool):
    return kept_in_worker(f"tokenizers {model} {ranks} {added}", lambda: _load(model, ranks, added))


def _load(model: str, ranks: str, added: bool):
    """Fast and exact encoder, and a pattern of the added tokens; both files must hold the same merges in the same order."""
    import base64
    import json
    import re

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    with open(model, encoding="utf-8") as file:
        content = json.load(file)
    special = {}
    for token in content["added_tokens"]:
        if any(token[k] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"added token {token['content']!r} is not matched as it stands")
        special[token["content"]] = token["id"]
    # byte-level tokens spell the bytes below 256 as printable signs
    signs = sorted(ByteLevel.alphabet())
    plain = [c for c in signs if ord(c) < 256]
    missing = iter(sorted(c for c in signs if ord(c) >= 256))
    byte_of = {c: ord(c) for c in plain} | dict(zip(missing, sorted(set(range(256)) - {ord(c) for c in plain}), strict=False))
    spelt = lambda token: bytes(byte_of[c] for c in token)
    vocabulary = content["model"]["vocab"]
    if {spelt(t): i for t, i in vocabulary.items() if t not in special} != {t: i for t, i in table.items() if i not in special.values()}:
        raise ValueError("the two vocabularies differ")
    order = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in content["model"]["merges"]]
    if order != sorted(order):
        raise ValueError("the merges are not in the order of the ids")
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special if added else {})
    exact = Tokenizer.from_file(model)
    exact.encode_special_tokens = not added
    marks = re.compile("|".join(map(re.escape, special))) if special else None
    return fast, exact, marks


def has_long_run(text: str) -> bool:
    import re

    return len(text) >= LONG_RUN and any(m.end() - m.start() >= LONG_RUN for m in re.finditer(r"\s+|\S+", text))


def tokens_of(batches: Iterable[pa.RecordBatch], text: str, model: str, ranks: str, end: int,
              added: bool = False) -> Iterator[pa.RecordBatch]:
    """Batches with ``ids`` (binary) in place of the text.

    One text of each slice and every text with an added token are compared with ``tokenizers``; texts with very long runs
    are encoded by it.
    """
    fast, exact, marks = _tokenizers(model, ranks, added)
    allowed = fast.special_tokens_set
    last = np.array([end], ID_TYPE).tobytes()
    for batch in batches:
        for at in range(0, batch.num_rows, DOCS_AT_ONCE):
            part = batch.slice(at, DOCS_AT_ONCE)
            texts = [t or "" for t in part.column(text).to_pylist()]
            long = [has_long_run(t) for t in texts]
            coded = [np.array(exact.encode(t, add_special_tokens=False).ids, np.uint32) if slow else
                     fast.encode_to_numpy(t, allowed_special=allowed, disallowed_special=()) for t, slow in zip(texts, long, strict=True)]
            probe = (at // DOCS_AT_ONCE) % len(texts)
            for i, t in enumerate(texts):
                if not long[i] and (i == probe or marks and marks.search(t)) and (
                        exact.encode(t, add_special_tokens=False).ids != coded[i].tolist()):
                    raise ValueError("the two tokenizers disagree")
            ids = pa.array([c.astype(ID_TYPE).tobytes() + last for c in coded], pa.binary())
            kept = part.drop_columns([text])
            yield pa.RecordBatch.from_arrays([*kept.columns, ids], names=[*kept.schema.names, "_ids"])


# --- plan --------------------------------------------------------------------------------------

def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """All pairs and triples of the given lengths with the sum ``window``; unused places hold 0."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    found = []
    pairs = lengths[(lengths * 2 <= window) & have[window - lengths]]
    found.append(np.stack([np.zeros_like(pairs), pairs, window - pairs], axis=1))
    for a in lengths[lengths * 3 <= window]:
        b = lengths[(lengths >= a) & (lengths <= (window - a) // 2)]
        b = b[have[window - a - b]]
        found.append(np.stack([np.full_like(b, a), b, window - a - b], axis=1))
    return np.concatenate(found)


def _fit(combos: np.ndarray, target: np.ndarray, rounds: int) -> np.ndarray:
    """Non-negative repeat counts x that minimise |A x - target|^2, by accelerated projected gradients.

    Column j of A counts the lengths of combination j, so both products are lookups and sums.
    """
    flat, size, n = combos.ravel(), len(target), len(combos)

    def use(x: np.ndarray) -> np.ndarray:
        total = np.bincount(flat, np.repeat(x, 3), size)
        total[0] = 0
        return total

    def price(r: np.ndarray) -> np.ndarray:
        return r[combos].sum(axis=1)

    probe = np.ones(n)
    for _ in range(12):
        probe = price(use(probe))
        norm = np.linalg.norm(probe)
        probe /= norm
    step = 1 / (1.05 * norm)
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * price(use(y) - target))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def fitted_repeats(histogram: np.ndarray, window: int, rounds: int = ROUNDS,
                   most: int = MOST_COMBINATIONS) -> list[tuple[tuple[int, ...], int]]:
    """Combinations and their whole repeat counts, within what the histogram holds.

    The fit over all combinations is repeated over the ``most`` heaviest ones, then rounded so
    that the rounding errors of neighbours cancel. The bound is on kinds of windows, not on documents.
    """
    lengths = np.flatnonzero(histogram)
    lengths = lengths[lengths > 0]
    combos = combinations(lengths, window)
    if not len(combos):
        return []
    target = histogram.astype(float)
    target[0] = 0
    x = _fit(combos, target, rounds)
    if len(combos) > most:
        heavy = np.sort(np.argsort(-x, kind="stable")[:most])
        combos = combos[heavy]
        x = _fit(combos, target, rounds)
    whole = np.diff(np.floor(np.concatenate(([0.0], np.cumsum(x))) + 0.5)).astype(np.int64)
    left = histogram.copy()
    out = []
    for j in np.argsort(-whole, kind="stable"):
        kinds, times = np.unique(combos[j][combos[j] > 0], return_counts=True)
        repeat = min(int(whole[j]), int((left[kinds] // times).min()))
        if repeat > 0:
            left[kinds] -= times * repeat
            out.append((tuple(int(k) for k in combos[j] if k), repeat))
    return out


class Plan:
    """Where the i-th remainder of each length goes, as ranges of i.

    A range ``(low, high, length, base, offset, times, first)`` of the key (whole, start) sends the part
    that begins at ``start``: with t = first + i - low, to window base + t // times, at offset + t % times * length.
    """

    def __init__(self, histogram: np.ndarray, window: int = WINDOW):
        self.window, self.windows = window, 0
        self.ranges: dict[tuple[int, int], list[tuple[int, ...]]] = defaultdict(list)
        self.stock: dict[int, list[tuple[int, int, int, int]]] = {
            n: [(n, 0, int(histogram[n]), 0)] for n in range(1, window) if histogram[n]}
        self.left = np.zeros(window + 1, np.int64)
        self.left[1:window] = histogram[1:window]
        for combination, repeat in fitted_repeats(self.left[:window], window):
            self._place([(n, combination.count(n)) for n in dict.fromkeys(combination)], repeat)
        self._pack_rest()
        for key in self.ranges:
            self.ranges[key].sort()
        del self.stock

    def _take(self, length: int, count: int) -> list[tuple[int, int, int, int]]:
        """The next ``count`` pieces of a length, as ranges of remainders."""
        out, ranges = [], self.stock[length]
        self.left[length] -= count
        while count:
            whole, low, high, start = ranges.pop()
            used = min(count, high - low)
            out.append((whole, low, low + used, start))
            if low + used < high:
                ranges.append((whole, low + used, high, start))
            count -= used
        return out

    def _send(self, pieces: list[tuple[int, int, int, int]], length: int, offset: int, times: int) -> None:
        first = 0
        for whole, low, high, start in pieces:
            self.ranges[whole, start].append((low, high, length, self.windows, offset, times, first))
            first += high - low

    def _place(self, content: list[tuple[int, int]], repeat: int, cut: tuple[int, int] | None = None) -> None:
        """``repeat`` equal windows: (length, times) of whole pieces, then the first ``cut[1]`` of pieces of ``cut[0]``."""
        offset = 0
        for length, times in content:
            self._send(self._take(length, times * repeat), length, offset, times)
            offset += length * times
        if cut:
            length, head = cut
            pieces = self._take(length, repeat)
            self._send(pieces, head, offset, 1)
            rest = self.stock.setdefault(length - head, [])
            rest.extend((whole, low, high, start + head) for whole, low, high, start in pieces)
            self.left[length - head] += repeat
        self.windows += repeat

    def _pack_rest(self) -> None:
        """Longest first, then the longest that still fits; where none does, the shortest of the longer ones is cut."""
        while self.left.any():
            content, spare = [], self.left.copy()
            room = self.window
            while room:
                fits = np.flatnonzero(spare[:room + 1])
                if not len(fits):
                    break
                length = int(fits[-1])
                times = min(room // length, int(spare[length]))
                content.append((length, times))
                spare[length] -= times
                room -= times * length
            longer = np.flatnonzero(spare)
            cut = (int(longer[0]), room) if room and len(longer) else None
            repeat = min(int(self.left[length]) // times for length, times in content)
            if cut:
                used = dict(content).get(cut[0], 0)
                repeat = min(repeat, int(self.left[cut[0]]) // (used + 1))
            self._place(content, max(1, repeat), cut)

    def pieces(self, length: int, index: int) -> Iterator[tuple[int, int, int, int]]:
        """``start, length, window, offset`` of the parts of remainder ``index`` of its length."""
        start = 0
        while start < length:
            ranges = self.ranges[length, start]
            low, _, size, base, offset, times, first = ranges[bisect_right(ranges, (index, 1 << 62)) - 1]
            t = first + index - low
            yield start, size, base + t // times, offset + t % times * size
            start += size


# --- operator ----------------------------------------------------------------------------------

def _numbered(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Adds length, remainder, and running numbers within the partition: of the remainder's length and of full windows."""
    ranks, full = np.zeros(window, np.int64), 0
    for batch in batches:
        sizes = np.array([len(v) // ID_TYPE.itemsize for v in batch.column("_ids").to_pylist()], np.int64)
        rest = sizes % window
        order = np.argsort(rest, kind="stable")
        sorted_rest = rest[order]
        first = np.searchsorted(sorted_rest, sorted_rest, side="left")
        rank = np.empty(len(sizes), np.int64)
        rank[order] = np.arange(len(sizes)) - first
        rank += ranks[rest]
        ranks += np.bincount(rest, minlength=window)
        windows = sizes // window
        before = full + np.cumsum(windows) - windows
        full += int(windows.sum())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(sizes), pa.array(rest), pa.array(rank), pa.array(before)],
            names=[*batch.schema.names, "_size", "_rest", "_rank", "_full"])


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
                   model: str | None = None, ranks: str | None = None, end: int = 0,
                   added_tokens: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are the piece's token ids as little-endian unsigned 32-bit numbers. Every id of every document, the
    end id included, lies in one piece; pieces fill each sequence from offset 0 without gaps, and all sequences but
    the last are full.

    * With ``added_tokens`` the added tokens of ``model`` that stand in a text, such as ``<|endoftext|>``, become their own
      ids, as ``tokenizers`` reads them by default; without it they are encoded like any other text.
    * A null text is empty: its document is the end id alone. Long texts are taken whole.
    * Documents are packed by row, so repeated rows and null or repeated ids each get places of their own.
    * An empty table gives no pieces. Other columns are dropped.

    Tokens are made once and stored; the driver sees the histogram of at most ``window`` lengths. Remainders are
    numbered within stored partitions, and the numbers at which partitions begin are joined by (partition,
    length), so a length that a third of all documents share is spread over all partitions.
    """
    import public_tokenizers

    model = model or public_tokenizers.path("byte_bpe_50k.json")
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def tokenise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _numbered(tokens_of(batches, "_text", model, ranks, end, added_tokens), window)

    id_type = docs.schema[doc_id].dataType.simpleString()
    tokens = stored(
        docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
        .mapInArrow(tokenise, f"_id {id_type}, _ids binary, _size bigint, _rest bigint, _rank bigint, _full bigint")
        .withColumn("_part", F.spark_partition_id()), "packing")
    return _assigned(tokens, doc_id, id_type, window)


def _assigned(tokens: DataFrame, doc_id: str, id_type: str, window: int) -> DataFrame:
    counts = tokens.groupBy("_part", "_rest").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.call_function("div", F.col("_size"), F.lit(window))).alias("f"))
    counted = stored(counts, "packing-counts")
    histogram = np.zeros(window, np.int64)
    full = 0
    for r in counted.groupBy("_rest").agg(F.sum("n").alias("n"), F.sum("f").alias("f")).collect():
        histogram[r["_rest"]] = r["n"]
        full += r["f"]
    plan = Plan(histogram, window)
    ranges = dict(plan.ranges)
    shared = tokens.sparkSession.sparkContext.broadcast(ranges)  # bounded by the window

    # where each partition's numbers begin: remainders by length, full windows over all
    by_length = Window.partitionBy("_rest").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counted.select(F.col("_part").alias("p"), F.col("_rest").alias("r"),
                            F.coalesce(F.sum("n").over(by_length), F.lit(0)).alias("rank_from"))
    per_part = counted.groupBy(F.col("_part").alias("q")).agg(F.sum("f").alias("f"))
    # one row per stored partition: cut into blocks, so that no single task sums them all
    block = F.shiftright("q", 10)
    inside = Window.partitionBy("b").orderBy("q").rowsBetween(Window.unboundedPreceding, -1)
    blocks = per_part.groupBy(block.alias("b")).agg(F.sum("f").alias("f"))
    earlier = blocks.select("b", F.lit(0).alias("one"), "f").alias("x")
    over_blocks = Window.partitionBy("one").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    block_from = earlier.select(F.col("b").alias("bb"), F.coalesce(F.sum("f").over(over_blocks), F.lit(0)).alias("s"))
    starts = per_part.withColumn("b", block).withColumn(
        "s0", F.coalesce(F.sum("f").over(inside), F.lit(0))).join(block_from, F.col("b") == F.col("bb")).select(
        "q", (F.col("s0") + F.col("s")).alias("full_from"))
    offsets = firsts.join(starts, F.col("p") == F.col("q")).select("p", "r", "rank_from", "full_from")
    placed = tokens.join(offsets, (F.col("_part") == F.col("p")) & (F.col("_rest") == F.col("r"))).select(
        "_id", "_ids", "_size", "_rest", (F.col("_rank") + F.col("rank_from")).alias("rank"),
        (F.col("_full") + F.col("full_from")).alias("first"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = Plan.__new__(Plan)
        where.ranges = shared.value
        schema = None

        def rows() -> Iterator[tuple]:
            for batch in batches:
                nonlocal schema
                for ident, raw, size, rest, rank, first in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    ids = np.frombuffer(raw, ID_TYPE).astype("<u4")
                    for k in range(size // window):
                        yield (ident, k * window, window, ids[k * window:(k + 1) * window].tobytes(), size, first + k, 0)
                    begin = size - rest
                    for start, length, seq, offset in where.pieces(rest, rank):
                        at = begin + start
                        yield (ident, at, length, ids[at:at + length].tobytes(), size, full + seq, offset)

        yield from batches_of(rows(), out_schema)

    import pyspark.sql.pandas.types as kinds

    ddl = (f"`{doc_id}` {id_type}, start bigint, length bigint, ids binary, doc_tokens bigint, "
           "sequence_id bigint, offset bigint")
    id_kind = kinds.to_arrow_type(tokens.schema["_id"].dataType)
    out_schema = pa.schema([(doc_id, id_kind), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                            ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
    return placed.mapInArrow(run, ddl)
