"""Exact join of documents on the Jaccard index of their word n-grams, and its components.

The universe of n-gram hashes is cut into segments, as many per band of set sizes as a pair in reach
can have differences, plus some slack. Two sets in reach then agree on more segments than the slack, so
they share the signature of a segment's subset (pigeonhole). Subsets that too many documents
share are skipped at the cost of slack; documents that have no slack left are indexed again by their own
elements that are rarest among them (prefix filter), where two sets in reach must meet too. Every candidate is
verified on the whole sets.

Only pairs that can still join two components are verified: first each document with one leader
per signature, then what is left between components. A signature of the second index that has too many open pairs
is solved whole in one task if its sets are few and small, else it is parted by a lead: two members that do not both link to it can be in reach only if they differ from it in common
elements, so they meet again under one of their rarest differences.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kifuframe.llm.common import Scratch, fresh, kept_in_worker, release, with_columns

WORDS = 4
PERCENT = 85
#: Ratio of the sizes at the two ends of a band.
GROWTH = 1.3
#: A signature is skipped when its members have more unverified partners than this on average.
PARTNERS = 4
STAR_ROUNDS = 2
#: Ratio of the set sizes at the two ends of a class of the second index.
CLASS_GROWTH = 1.05
#: Most members, elements and bytes of text of a crowded signature that one task compares whole.
BLOCK = (1_500, 1_000_000, 64 << 20)
#: Elements of a block that are counted at once.
SLAB = 16_384
#: Up to so many links their components are found in one task.
IN_ONE_TASK = 100_000
#: Signatures, texts and elements are shuffled in so many slices, one after the other, which bounds the shuffle files on disk; up to
#: so many signatures take one slice, as each is a few jobs.
SLICES, IN_ONE_SLICE = 4, 1_000_000
KNOWN_WORDS = 500_000
BAND_BITS = 7
ROWS = "count(1)"
_M1, _M2, _STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), 0x9E3779B97F4A7C15
_33 = np.uint64(33)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _33)
    x = x * _M1
    x ^= x >> _33
    x *= _M2
    return x ^ (x >> _33)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; a shorter text is one n-gram, no words give none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = kept_in_worker("words", _Words)
    if len(known) > KNOWN_WORDS:
        known.clear()
    codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(size, len(codes))
    n = len(codes) - size + 1
    total = codes[:n].copy()
    for i in range(1, size):
        total *= np.uint64(_STEP)
        total += codes[i:i + n]
    return np.unique(mixed(total + np.uint64(size)))


class Bands:
    """Bands of set sizes. A pair is looked for in the band of its larger set."""

    def __init__(self, percent: int):
        self.percent = percent
        self.low = [1]
        while self.low[-1] < 1 << 40 and len(self.low) < 1 << BAND_BITS:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * GROWTH)))
        #: most elements in which a pair in reach can differ
        self.differ = [2 * (high - 1) * (100 - percent) // (100 + percent) for high in self.low[1:]]
        self.slack = [min(3, 1 + d // 3) + d // 16 for d in self.differ]
        self.segments = [d + 1 + s for d, s in zip(self.differ, self.slack, strict=True)]
        self.halves = [d // 2 + 1 for d in self.differ]

    def at(self, size: int) -> int:
        return int(np.searchsorted(self.low, size, side="right")) - 1

    def of(self, size: int) -> list[int]:
        """The band of a size and the next ones whose sets it can be in reach of.

        Bands without differences are left out: there only equal sets are in reach.
        """
        at = self.at(size)
        out = []
        while at < len(self.differ) and (self.low[at] <= size or 100 * size >= self.percent * self.low[at]):
            if self.differ[at]:
                out.append(at)
            at += 1
        return out


def bands_for(percent: int) -> Bands:
    return kept_in_worker(f"bands {percent} {GROWTH}", lambda: Bands(percent))


def _segments(elements: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segment of each element, the segments that hold any, their sums of mixed elements, and these."""
    place = ((elements >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
    parts = mixed(elements + np.uint64(_STEP))
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return place, place[first], np.add.reduceat(parts, first), parts


def _named(sums: np.ndarray, place: np.ndarray, band: int, level: int) -> np.ndarray:
    salt = np.uint64((_STEP * (2 * band + level + 1)) & 0xFFFFFFFFFFFFFFFF)
    named = mixed(sums + mixed(place + salt))
    return ((named << np.uint64(BAND_BITS)) | np.uint64(band)).view(np.int64)


def subsets(elements: np.ndarray, bands: Bands) -> tuple[np.ndarray, list[np.ndarray]]:
    """Signature of each segment's subset, and a print of one byte (0 if empty), for each band of the set.

    Empty subsets say nothing, and the slack covers them; with more empty ones than slack they are named too.
    """
    names, prints = [], []
    for band in bands.of(len(elements)):
        count = bands.segments[band]
        _, held, sums, _ = _segments(elements, count)
        at = held.astype(np.int64)
        marks = np.zeros(count, np.uint8)
        marks[at] = 1 + mixed(sums) % np.uint64(255)
        prints.append(marks)
        if count - len(held) > bands.slack[band]:
            full = np.zeros(count, np.uint64)
            full[at] = sums
            held, sums = np.arange(count, dtype=np.uint64), full
        names.append(_named(sums, held, band, 0))
    return np.concatenate(names) if names else np.zeros(0, np.int64), prints


def subset_signatures(elements: np.ndarray, bands: Bands) -> np.ndarray:
    return subsets(elements, bands)[0]


def deletion_signatures(elements: np.ndarray, band: int, bands: Bands) -> np.ndarray:
    """Signatures of each subset over half as many segments, whole and short of each one element."""
    count = bands.halves[band]
    place, held, sums, parts = _segments(elements, count)
    full = np.zeros(count, np.uint64)
    full[held.astype(np.int64)] = sums
    short = full[place.astype(np.int64)] - parts
    return np.unique(np.concatenate((
        _named(full, np.arange(count, dtype=np.uint64), band, 1), _named(short, place, band, 1))))


def in_reach(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def differences(a: np.ndarray, lead: np.ndarray, percent: int) -> tuple[bool, np.ndarray, int, int]:
    """Whether a set links to a lead, the elements in which the two differ, and how many of these name it as the set of fewer and of
    more differences.

    Sets a and b with differences D and E from a lead differ in |D| + |E| - 2 |D & E| elements, and are in reach when these are at most
    the share (100 - percent) / (100 + percent) of |a| + |b|. If D and E have nothing in common, then by the same rule both link to the
    lead. Else they share at least |D| - |a| (100 - percent) / (2 percent) elements if D is the smaller one, and
    |E| - |b| (100 - percent) / percent if E is the larger; so they have one in common among the first ones of each in any fixed order.
    Of a set that links to the lead only partners count that do not, and with these it shares about half of its differences.
    """
    apart = np.setxor1d(a, lead, assume_unique=True)
    linked = in_reach(a, lead, percent)
    least = 1
    if linked:
        least = max(1, (len(apart) * (100 + percent) - (len(a) - len(lead)) * (100 - percent)) // (2 * (100 + percent)) + 1)
    fewer = len(apart) - len(a) * (100 - percent) // (2 * percent)
    more = len(apart) - len(a) * (100 - percent) // percent
    return linked, apart, len(apart) - max(least, fewer) + 1, len(apart) - max(least, more) + 1


def links_within(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (by place in the list) that make the components of all pairs in reach among a few sets."""
    sizes = np.array([len(s) for s in sets], np.int64)
    elements, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = np.cumsum(times > 1) - 1
    keep = times[code] > 1
    owner, code = owner[keep], shared[code[keep]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(np.count_nonzero(times > 1)), SLAB):
        here = (code >= low) & (code < low + SLAB)
        held = np.zeros((len(sets), SLAB), np.float32)
        held[owner[here], code[here] - low] = 1
        both += held @ held.T
    common = both.astype(np.int64)
    np.fill_diagonal(common, sizes)
    linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    out, left = [], np.ones(len(sets), bool)
    for first in range(len(sets)):
        if left[first]:
            left[first] = False
            ahead = [first]
            while ahead:
                at = ahead.pop()
                found = np.flatnonzero(linked[at] & left)
                left[found] = False
                out += [(at, int(f)) for f in found]
                ahead += found.tolist()
    return out


def _lists(parts: list, kind: type) -> pa.ListArray:
    """Arrays (or list arrays) as the rows of one list array."""
    offsets = pa.array(np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32))
    if parts and isinstance(parts[0], pa.Array):
        return pa.ListArray.from_arrays(offsets, pa.concat_arrays(parts))
    flat = np.concatenate(parts) if parts else np.zeros(0, kind)
    return pa.ListArray.from_arrays(offsets, pa.array(flat.view(kind) if flat.dtype == np.uint8 else flat.astype(kind)))


# --- stages ------------------------------------------------------------------------------------

def _sets(scratch: Scratch, numbered: DataFrame, text: str, size: int, percent: int) -> tuple[DataFrame, int]:
    """The rows of ``numbered`` without their text, with the set's size and 128-bit name, and its signatures; the number of these."""
    others = [c for c in numbered.columns if c != text]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema if f.name != text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = bands_for(percent)
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                batch = whole.slice(at, 1_000)
                sets = [shingles(t.as_py(), size) for t in batch.column(text)]
                names = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets]).reshape(-1, 2)
                found = [subsets(s, bands) for s in sets]
                yield with_columns(batch.select(others), {
                    "n": pa.array([len(s) for s in sets], pa.int64()), "name1": pa.array(names[:, 0].copy()),
                    "name2": pa.array(names[:, 1].copy()), "band": pa.array([bands.at(len(s)) for s in sets], pa.int32()),
                    "first": pa.array([next(iter(bands.of(len(s))), 0) for s in sets], pa.int32()),
                    "signatures": _lists([f for f, _ in found], np.int64),
                    "prints": _lists([_lists(p, np.int8) for _, p in found], np.int8)})

    made = numbered.mapInArrow(run, f"{fields}, n bigint, name1 bigint, name2 bigint, band int, first int, signatures array<bigint>, "
        "prints array<array<tinyint>>")
    sets, seen = scratch.stored_with(made, "jaccard-sets", signatures="coalesce(sum(size(signatures)), 0)")
    return sets, seen["signatures"]


def _slice(df: DataFrame, key: Column, at: int, slices: int) -> DataFrame:
    return df if slices == 1 else df.where(F.pmod(key, F.lit(slices)) == at)


def _members(scratch: Scratch, sets: DataFrame, copies: DataFrame, slices: int) -> Iterator[DataFrame]:
    """``signature, node`` of the signatures that several rows have, a slice of the signatures at a time.

    Copies take part under the number of the first of them, once per signature.
    """
    named = sets.select(F.explode("signatures").alias("signature"), "row")
    for at in range(slices):
        here = _slice(named, F.shiftright("signature", BAND_BITS), at, slices)
        shared = scratch.stored(
            here.groupBy(F.col("signature").alias("s")).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("s"), "jaccard-shared")
        yield (here.join(shared, F.col("signature") == F.col("s")).join(copies, F.col("row") == F.col("copy"), "left")
               .select("signature", F.coalesce("first", "row").alias("node")).distinct())
        scratch.drop(shared)


def _texts(numbered: DataFrame, marks: DataFrame, wanted: DataFrame, text: str, slices: int) -> Iterator[DataFrame]:
    """``row, n, band, first, prints, text`` of the wanted rows, a slice of the rows at a time."""
    for at in range(slices):
        held = _slice(marks, F.col("row"), at, slices).join(
            _slice(wanted, F.col("node"), at, slices), F.col("row") == F.col("node"), "left_semi")
        body = _slice(numbered, F.col("row"), at, slices).select(F.col("row").alias("numbered"), F.col(text).alias("text"))
        yield held.join(body, F.col("row") == F.col("numbered")).drop("numbered")


def _promising(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs that agree on as many segments as two sets of their sizes in reach must.

    In the band of the larger set, each differing element spoils one segment at most. The segments are compared by
    their prints, which can only overstate how many agree.
    """
    side = lambda x: texts.select(*[F.col(c).alias(f"{c}_{x}") for c in ("row", "n", "band", "first", "prints")])
    both = pairs.join(side("a"), F.col("a") == F.col("row_a")).join(side("b"), F.col("b") == F.col("row_b"))
    band = F.greatest("band_a", "band_b")
    print_of = lambda x: F.get(F.col(f"prints_{x}"), band - F.col(f"first_{x}"))
    equal = F.size(F.filter(F.zip_with(print_of("a"), print_of("b"), lambda x, y: x == y), lambda same: same))
    differ = F.floor((F.col("n_a") + F.col("n_b")) * F.lit(100 - percent) / F.lit(100 + percent))
    in_size = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return both.where(in_size & (equal >= F.size(print_of("a")) - differ)).select("a", "b")


class _Known(dict):
    """Sets of the texts seen last."""

    def of(self, row: int, text: str | None, size: int) -> np.ndarray:
        if row not in self:
            if len(self) >= 512:
                self.clear()
            self[row] = shingles(text, size)
        return self[row]


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    left = texts.select(F.col("row").alias("ra"), F.col("text").alias("ta"))
    right = texts.select(F.col("row").alias("rb"), F.col("text").alias("tb"))
    return pairs.join(right, F.col("b") == F.col("rb")).join(left, F.col("a") == F.col("ra")).select("a", "b", "ta", "tb")


def _verified(scratch: Scratch, pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> tuple[DataFrame, int]:
    """The pairs ``a, b`` whose sets are in reach, stored, and their number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known()
        for batch in batches:
            keep = [in_reach(known.of(a, s, size), known.of(b, t, size), percent) for a, b, s, t in zip(
                *[batch.column(i).to_pylist() for i in range(4)], strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = _with_texts(_promising(pairs, texts, percent), texts)
    links, seen = scratch.stored_with(both.mapInArrow(run, "a bigint, b bigint"), "jaccard-links", n=ROWS)
    return links, seen["n"]


def _apart(scratch: Scratch, pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> tuple[DataFrame, int]:
    """``a, b, linked, fewer, more, elements`` of the pairs of a lead ``a`` and another member ``b`` of its signature, stored; the links."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known()
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                batch = whole.slice(at, 1_000)
                found = [differences(known.of(b, t, size), known.of(a, s, size), percent) for a, b, s, t in zip(
                    *[batch.column(i).to_pylist() for i in range(4)], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("a"), batch.column("b"), pa.array([f[0] for f in found], pa.bool_()),
                     pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.int32()),
                     _lists([f[1].view(np.int64) for f in found], np.int64)], names=["a", "b", "linked", "fewer", "more", "elements"])

    found, seen = scratch.stored_with(_with_texts(pairs, texts).mapInArrow(
        run, "a bigint, b bigint, linked boolean, fewer int, more int, elements array<bigint>"), "jaccard-apart", links="count_if(linked)")
    release(pairs.sparkSession)
    return found, seen["links"]


def _parts(found: DataFrame) -> DataFrame:
    """``signature, node, size, small, large`` of the first differences of each set, rarest in its lead's signatures first.

    A part needs a set for which it is among the first as the one of fewer differences.
    """
    single = found.select("a", "b", "fewer", "more", F.size("elements").alias("differing"), F.explode("elements").alias("e"))
    often = single.groupBy(F.col("a").alias("l"), F.col("e").alias("f")).agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    counted = single.join(often.repartition(F.xxhash64("l", "f")), (F.col("a") == F.col("l")) & (F.col("e") == F.col("f")))
    # elements of one set alone come first and meet nothing
    shared = Window.partitionBy("a", "b")
    placed = counted.withColumn("place", F.col("differing") - F.count(F.lit(1)).over(shared)
                                + F.row_number().over(shared.orderBy("times", "e"))).where("place <= more")
    return placed.select(F.xxhash64("a", "e").alias("signature"), F.col("b").alias("node"), F.col("differing").alias("size"),
                         (F.col("place") <= F.col("fewer")).alias("small"), F.lit(True).alias("large"))


def _components_in_one_task(edges: DataFrame) -> DataFrame:
    """``node, root`` of few ``u, v``, by union and find."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := above.setdefault(x, x)) != x:
                above[x] = x = above[up]
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low, high = sorted((root(u), root(v)))
                above[high] = low
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(above), pa.int64()), pa.array([root(x) for x in list(above)], pa.int64())], names=["node", "root"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "node bigint, root bigint")


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``node, root`` (smallest node of its component) for the nodes of ``links`` (``a, b``).

    Large-star and small-star steps in turn, stored after each round, until nothing changes; up to ``IN_ONE_TASK``
    links in one task instead, as the rounds would be many small jobs.
    """
    scratch = scratch or Scratch(links.sparkSession)
    state = {"n": ROWS, "sum": "sum(cast(xxhash64(u, v) as decimal(38, 0)))"}
    edges, seen = scratch.stored_with(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(),
        "components", **state)
    if seen["n"] <= IN_ONE_TASK:
        found = scratch.stored(_components_in_one_task(edges), "components", small=True)
        scratch.drop(edges)
        return found
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("c")).agg(F.least(F.min("v"), F.col("c")).alias("m")).repartition(F.xxhash64("c"))
        large = both.where("v > u").join(least, F.col("u") == F.col("c")).select(
            F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).repartition(F.xxhash64("c"))
        small = large.join(least, F.col("u") == F.col("c"))
        before, last = seen, edges
        edges, seen = scratch.stored_with(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct(), "components", **state)
        scratch.drop(last)
        if seen == before:
            found = scratch.stored(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "components", small=True)
            scratch.drop(edges)
            return found


def _grouped(scratch: Scratch, members: DataFrame, groups: DataFrame | None) -> tuple[DataFrame, int]:
    """``signature, node, root`` of the signatures whose members are in more than one component, stored; their rows."""
    members = members.drop("root")
    if groups is None:
        rooted = members.withColumn("root", F.col("node"))
    else:
        rooted = members.join(groups.withColumnRenamed("node", "g"), F.col("node") == F.col("g"), "left").select(
            *members.columns, F.coalesce("root", "node").alias("root"))
    mixed_ones = rooted.groupBy(F.col("signature").alias("s")).agg(F.min("root").alias("lo"), F.max("root").alias("hi")) \
        .where("lo <> hi").select("s", "lo").repartition(F.xxhash64("s"))
    open_ones, seen = scratch.stored_with(
        rooted.join(mixed_ones, F.col("signature") == F.col("s")).select(*rooted.columns), "jaccard-open", n=ROWS)
    release(members.sparkSession)
    return open_ones, seen["n"]


def _star_pairs(members: DataFrame, turn: int) -> DataFrame:
    """Each member of another component than its signature's leader, with the leader.

    The leader is the member that meets the most others over all its signatures: the text that a group of
    near copies was made from is closer to all of them than they are to each other. Later turns draw by hash.
    """
    if turn == 0:
        sizes = members.groupBy(F.col("signature").alias("z")).agg(F.count(F.lit(1)).alias("k")).repartition(F.xxhash64("z"))
        met = members.join(sizes, F.col("signature") == F.col("z")).groupBy(F.col("node").alias("c")).agg(F.sum("k").alias("met"))
        ties = F.pmod(F.xxhash64("node"), F.lit(1 << 20))
        drawn = members.join(met, F.col("node") == F.col("c")).select(
            "signature", "node", "root", (ties - F.col("met") * F.lit(1 << 20)).alias("draw"))
    else:
        drawn = members.withColumn("draw", F.xxhash64(F.lit(turn), "node"))
    leaders = drawn.groupBy(F.col("signature").alias("s")).agg(F.min("draw").alias("lead")).repartition(F.xxhash64("s"))
    led = drawn.join(leaders, F.col("signature") == F.col("s"))
    heads = led.where("draw = lead").select(F.col("signature").alias("s2"), F.col("node").alias("a"), F.col("root").alias("r"))
    rest = members.join(heads, F.col("signature") == F.col("s2")).where("root <> r")
    return rest.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()


def _costs(scratch: Scratch, members: DataFrame, partners: float) -> tuple[DataFrame, int]:
    """``s, size, top`` (largest component), ``costly`` (more open pairs than ``partners`` per member) of each signature,
    stored; the number of costly ones."""
    sizes = members.groupBy("signature", "root").agg(F.count(F.lit(1)).alias("k"))
    sums = sizes.groupBy(F.col("signature").alias("s")).agg(
        F.sum("k").alias("size"), F.sum(F.col("k").cast("double") * F.col("k")).alias("squares"),
        F.max(F.struct("k", "root")).alias("top"))
    costs = sums.select("s", "size", F.col("top.root").alias("top"), (
        F.col("size") * F.col("size") - F.col("squares") > F.lit(2.0 * partners) * F.col("size")).alias("costly"))
    kept, seen = scratch.stored_with(costs, "jaccard-costs", n="count_if(costly)")
    return kept, seen["n"]


def _open_pairs(members: DataFrame, costs: DataFrame) -> DataFrame:
    """All pairs between components, for the signatures in ``costs``.

    Members outside the largest component meet all others, so no pair inside that component is made.
    """
    held = members.join(costs.select("s", "top").repartition(F.xxhash64("s")), F.col("signature") == F.col("s"))
    held = held.select("signature", "node", "root", (F.col("root") == F.col("top")).alias("major"))
    minor = held.where(~F.col("major")).select(
        F.col("signature").alias("s2"), F.col("node").alias("m"), F.col("root").alias("mr"))
    met = held.join(minor, (F.col("signature") == F.col("s2")) & (F.col("root") != F.col("mr"))
                    & (F.col("major") | (F.col("node") < F.col("m"))))
    return met.select(F.least("node", "m").alias("a"), F.greatest("node", "m").alias("b")).distinct()


class _Search:
    """Links found so far, and the components they make."""

    def __init__(self, scratch: Scratch, texts: DataFrame, size: int, percent: int):
        self.scratch, self.texts, self.size, self.percent = scratch, texts, size, percent
        self.groups: DataFrame | None = None

    def join(self, links: DataFrame) -> None:
        """Takes in links ``a, b``; they may be dropped then."""
        before = self.groups
        if before is not None:
            links = links.unionByName(before.select(F.col("node").alias("a"), F.col("root").alias("b")))
        self.groups = components(links, self.scratch)
        self.scratch.drop(before)

    def verify(self, pairs: DataFrame) -> None:
        pairs, seen = self.scratch.stored_with(pairs, "jaccard-pairs", n=ROWS)
        if seen["n"]:
            links, found = _verified(self.scratch, pairs, self.texts, self.size, self.percent)
            release(pairs.sparkSession)
            if found:
                self.join(links)
            self.scratch.drop(links)
        self.scratch.drop(pairs)

    def regrouped(self, held: DataFrame) -> DataFrame:
        again, _ = _grouped(self.scratch, held, self.groups)
        self.scratch.drop(held)
        return again

    def lead(self, held: DataFrame) -> DataFrame:
        """Verifies each member with one or two leaders of its signature; returns what still joins components."""
        self.verify(_star_pairs(held, 0))
        for turn in range(1, STAR_ROUNDS):
            held = self.regrouped(held)
            costs, costly = _costs(self.scratch, held, PARTNERS)
            if costly:
                # other leaders may join what is left of a large group of near copies
                led = held.join(costs.where("costly").select("s", "size").repartition(F.xxhash64("s")), F.col("signature") == F.col("s"))
                self.verify(_star_pairs(led.select("signature", "node", "root"), turn))
            self.scratch.drop(costs)
            if not costly:
                return held
        return self.regrouped(held)

    def settle(self, held: DataFrame) -> DataFrame | None:
        """Verifies all open pairs but those of signatures with too many; returns the members of these, stored."""
        costs, costly = _costs(self.scratch, held, PARTNERS)
        self.verify(_open_pairs(held, costs.where("not costly")))
        skipped = None
        if costly:
            skipped = self.scratch.stored(held.join(
                costs.where("costly").select("s", "size").repartition(F.xxhash64("s")), F.col("signature") == F.col("s")).select(
                "signature", "node"), "jaccard-skipped", small=True)
        self.scratch.drop(held, costs)
        return skipped

    def blocks(self, crowded: DataFrame) -> DataFrame | None:
        """Finds all links within crowded signatures of few and small sets, each in one task; returns the members of the others.

        Signatures with the same members are compared once.
        """
        size, percent = self.size, self.percent

        def run(block: pa.Table) -> pa.Table:
            nodes = block.column("node").to_pylist()
            links = links_within([shingles(t.as_py(), size) for t in block.column("text")], percent)
            return pa.table({"a": pa.array([nodes[a] for a, _ in links], pa.int64()), "b": pa.array([nodes[b] for _, b in links], pa.int64())})

        sizes = self.texts.select("row", "n", F.octet_length("text").alias("bytes"))
        totals = crowded.join(sizes, F.col("node") == F.col("row")).groupBy(F.col("signature").alias("s")).agg(
            F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"),
            F.sum(F.xxhash64("node").cast("decimal(38, 0)")).alias("members"))
        few = (F.col("k") <= BLOCK[0]) & (F.col("n") <= BLOCK[1]) & (F.col("bytes") <= BLOCK[2])
        totals, seen = self.scratch.stored_with(
            totals.select("s", "k", "members", few.alias("few")), "jaccard-costs", few="count_if(few)", many="count_if(not few)")
        if seen["few"]:
            once = totals.where("few").groupBy("k", "members").agg(F.min("s").alias("s")).select("s").repartition(F.xxhash64("s"))
            held = crowded.join(once, F.col("signature") == F.col("s")).join(
                self.texts.select("row", "text"), F.col("node") == F.col("row")).select("signature", "node", "text")
            links, found = self.scratch.stored_with(
                held.groupBy("signature").applyInArrow(run, "a bigint, b bigint"), "jaccard-links", n=ROWS)
            if found["n"]:
                self.join(links)
            self.scratch.drop(links)
        others = None
        if seen["many"]:
            others = self.scratch.stored(crowded.join(
                totals.where("not few").select("s").repartition(F.xxhash64("s")), F.col("signature") == F.col("s")).select(
                "signature", "node"), "jaccard-skipped", small=True)
        self.scratch.drop(crowded, totals)
        return others

    def parted(self, crowded: DataFrame) -> DataFrame | None:
        """Parts crowded signatures by leads and verifies the pairs of the parts; returns the members of parts that are crowded again.

        The lead is the set with the most crowded signatures. A part is named by the lead and the element, so signatures with the same lead
        are parted once.
        """
        met = crowded.groupBy(F.col("node").alias("c")).agg(F.count(F.lit(1)).alias("met"))
        leads = crowded.join(met, F.col("node") == F.col("c")).groupBy(F.col("signature").alias("s")).agg(
            F.max(F.struct("met", "node")).alias("first")).select("s", F.col("first.node").alias("a")).repartition(F.xxhash64("s"))
        pairs = self.scratch.stored(crowded.join(leads, F.col("signature") == F.col("s")).where("a <> node").select(
            "a", F.col("node").alias("b")).distinct(), "jaccard-pairs", small=True)
        found, links = _apart(self.scratch, pairs, self.texts, self.size, self.percent)
        self.scratch.drop(crowded, pairs)
        if links:
            self.join(found.where("linked").select("a", "b"))
        parts = self.scratch.stored(_parts(found), "jaccard-parts")
        self.scratch.drop(found)
        return self.meet(parts)

    def meet(self, parts: DataFrame) -> DataFrame | None:
        """Verifies the open pairs of ``parts`` (``signature, node, size, small, large``), dropped then; returns the members of crowded ones.

        In a pair the set of less (size, node) is there as ``small`` and the other as ``large``. A part is crowded if many of its sets
        can be the small one, and many pairs are open for each member.
        """
        held, rows = _grouped(self.scratch, parts, self.groups)
        self.scratch.drop(parts)
        if not rows:
            self.scratch.drop(held)
            return None
        per_root = held.groupBy("signature", "root").agg(F.count(F.lit(1)).alias("k"), F.count_if("small").alias("smalls"))
        pairs_open = F.sum("k") * F.sum("k") - F.sum(F.col("k").cast("double") * F.col("k"))  # twice the open ones
        smalls = self.scratch.stored(per_root.groupBy(F.col("signature").alias("s")).agg(
            F.sum("smalls").alias("smalls"), ((F.sum("smalls") > 2 * PARTNERS) & (pairs_open > 8.0 * PARTNERS * F.sum("k"))).alias("costly"))
            .where("smalls > 0"), "jaccard-costs", small=True)
        costly = F.col("costly")
        busy = held.join(smalls.drop("smalls").repartition(F.xxhash64("s")), F.col("signature") == F.col("s"))
        cheap = busy.where(~costly)
        one = cheap.where("small").select(F.col("signature").alias("s2"), F.col("node").alias("m"), F.col("root").alias("mr"), F.col("size").alias("ms"))
        met = cheap.where("large").join(one, (F.col("signature") == F.col("s2")) & (F.col("root") != F.col("mr")) & (
            F.struct("ms", "m") < F.struct("size", "node")))
        self.verify(met.select(F.least("node", "m").alias("a"), F.greatest("node", "m").alias("b")).distinct())
        left, seen = self.scratch.stored_with(busy.where(costly).select("signature", "node"), "jaccard-skipped", n=ROWS)
        self.scratch.drop(held, smalls)
        if seen["n"]:
            return left
        self.scratch.drop(left)
        return None


def _again(skipped: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """``node, band`` of the documents whose skipped and empty subsets exceed the slack."""
    bands = bands_for(percent)
    lost = skipped.groupBy("node", F.col("signature").bitwiseAND(F.lit((1 << BAND_BITS) - 1)).cast("int").alias("band")) \
        .agg(F.count(F.lit(1)).alias("lost"))
    empty = F.size(F.filter(F.get("prints", F.col("band") - F.col("first")), lambda x: x == 0))
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("band"))
    return lost.join(texts.select("row", "first", "prints"), F.col("node") == F.col("row")).where(
        F.col("lost") + empty > pick(bands.slack)).select("node", "band")


def _elements(nodes: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """``e, node, n``: each element of the sets of ``nodes``, and the set's size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(*[batch.column(i).to_pylist() for i in range(2)], strict=True):
                found = shingles(text, size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), pa.array(np.full(len(found), node, np.int64)),
                     pa.array(np.full(len(found), len(found), np.int64))], names=["e", "node", "n"])

    joined = nodes.join(texts.select("row", "text"), F.col("node") == F.col("row")).select("node", "text")
    return joined.mapInArrow(run, "e bigint, node bigint, n bigint")


def _rarest(single: DataFrame, often: DataFrame, percent: int) -> DataFrame:
    """``signature, node, size, small, large`` of the rarest elements of each set of ``e, node, n``; ``often`` counts the
    elements of several sets, as ``f, times``.

    Sets a and b, a the smaller, in reach have at least percent (|a| + |b|) / (100 + percent) elements in common. In any order of
    all elements they meet at their first common one: it is among the first |a| (1 - 2 percent / (100 + percent)) of a and the first
    |b| (1 - percent / 100) of b, and b has all the others after it, which bounds the size of a. Elements of one set alone come
    first and meet nothing. A signature is an element and a class of sizes: a is in its own, b in each where an a can be.
    """
    counted = single.join(often, F.col("e") == F.col("f"))
    own = Window.partitionBy("node")
    placed = counted.withColumn("place", F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("times", "e")))
    ends = placed.withColumns({
        "fewest": F.expr(f"({percent} * n + 99) div 100"), "fewer": F.expr(f"n - (2 * {percent} * n + 99 + {percent}) div (100 + {percent}) + 1"),
        "most": F.expr(f"least(n, (n - place + 1) * (100 + {percent}) div {percent} - n)")}).where("place <= fewer or fewest <= most")
    of = lambda size: F.floor(F.log(F.greatest(F.col(size), F.lit(1))) / F.lit(float(np.log(CLASS_GROWTH))))
    spread = ends.withColumn("class", F.explode(F.sequence(of("fewest"), of("n"))))
    return spread.select(
        F.xxhash64("e", "class").alias("signature"), "node", F.col("n").alias("size"),
        ((F.col("class") == of("n")) & (F.col("place") <= F.col("fewer"))).alias("small"),
        ((F.col("fewest") <= F.col("most")) & (F.col("class") <= of("most"))).alias("large")).where("small or large")


def _roots(scratch: Scratch, docs: DataFrame, doc_id: str, text: str, size: int, percent: int) -> DataFrame:
    """The rows of ``docs`` without their text, with ``row``, ``n``, ``root`` and ``component_id``, stored."""
    others = [c for c in docs.columns if c != text]
    numbered = scratch.stored(docs.withColumn("row", F.monotonically_increasing_id()), "jaccard-numbered")
    sets, signatures = _sets(scratch, numbered, text, size, percent)
    slices = SLICES if signatures > IN_ONE_SLICE else 1
    light = scratch.stored(sets.select(*others, "row", "n", "name1", "name2"), "jaccard-light", small=True)
    marks = scratch.stored(sets.select("row", "n", "band", "first", "prints"), "jaccard-marks", small=True)
    classes = scratch.stored(light.where("n > 0").groupBy("name1", "name2").agg(
        F.min("row").alias("node"), F.min(doc_id).alias("least")), "jaccard-classes", small=True)
    copies = light.where("n > 0").join(classes, ["name1", "name2"]).where("row <> node").select(
        F.col("row").alias("copy"), F.col("node").alias("first"))
    members = scratch.stored_in_parts(_members(scratch, sets, copies, slices), "jaccard-members")
    scratch.drop(sets)
    held, rows = _grouped(scratch, members, None)
    scratch.drop(members)
    wanted = scratch.stored(held.select("node").distinct(), "jaccard-wanted", small=True)
    texts = scratch.stored_in_parts(_texts(numbered, marks, wanted, text, slices), "jaccard-texts")
    scratch.drop(numbered, marks, wanted)
    search = _Search(scratch, texts, size, percent)
    crowded = search.settle(search.lead(held)) if rows else None
    if crowded is not None:
        nodes = _again(crowded, texts, percent).select("node").distinct()
        single = scratch.stored(_elements(nodes, texts, size), "jaccard-elements", small=True)
        scratch.drop(crowded)
        often = scratch.stored(
            single.groupBy(F.col("e").alias("f")).agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "jaccard-often")
        parts = scratch.stored_in_parts(
            (_rarest(_slice(single, F.col("node"), at, slices), often, percent) for at in range(slices)), "jaccard-parts")
        scratch.drop(single, often)
        crowded = search.meet(parts)
        while crowded is not None and (crowded := search.blocks(crowded)) is not None:
            crowded = search.parted(crowded)
    scratch.drop(texts)
    if search.groups is None:
        rooted = classes.withColumn("root", F.col("node"))
    else:
        rooted = classes.join(search.groups.select(F.col("node").alias("g"), "root"), F.col("node") == F.col("g"), "left") \
            .withColumn("root", F.coalesce("root", "node"))
    rooted = scratch.stored(rooted.select("name1", "name2", "root", "least"), "jaccard-rooted", small=True)
    least = rooted.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id")).repartition(F.xxhash64("r"))
    named_roots = scratch.stored(rooted.join(least, F.col("root") == F.col("r")).select("name1", "name2", "root", "component_id"),
                                 "jaccard-components", small=True)
    whole = light.join(named_roots, ["name1", "name2"], "left")
    return scratch.stored(whole.select(
        *others, "row", "n", F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("row")).alias("root"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col(doc_id)).alias("component_id")), "jaccard-found", small=True)


def similar_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS,
                       percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row: the size of its set of word n-grams and the smallest
    id that links reach, its own included. Rows link when ``100 * intersection >= percent * union``.

    * A text of fewer words than an n-gram is one n-gram; null and wordless texts are linked with nothing.
    * Equal sets are one node of the search and never compared with each other; repeated rows are found so.
    * A null id is never the smallest, unless all of a component are null. Other columns are ignored.
    * An empty table gives an empty table.

    Of the run nothing stays in the shared folder but the three columns of the result.
    """
    scratch = Scratch(docs.sparkSession)
    found = _roots(scratch, docs.select(F.col(doc_id).alias("c0"), F.col(text).alias("c1")), "c0", "c1", words, percent)
    scratch.close(found)
    return found.select(F.col("c0").alias(doc_id), F.col("n").alias("n_shingles"), "component_id")


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5,
                     percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest id stays.

    Of rows with that same id one stays. Rows without words all stay. Columns are those of ``docs``.

    The search keeps no other columns: what stays is joined back to ``docs``, which is read twice and so should be a stored
    table, by the id and 128 bits of the text.
    """
    scratch = Scratch(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    prints = [F.xxhash64(F.lit(1), body), F.xxhash64(F.lit(2), body)]
    found = _roots(scratch, docs.select(
        F.col(doc_id).alias("c0"), F.col(text).alias("c1"), prints[0].alias("c2"), prints[1].alias("c3")), "c0", "c1", words, percent)
    stays = found.where(F.col("c0").eqNullSafe(F.col("component_id"))).groupBy(F.col("root").alias("r")).agg(F.min("row").alias("stay"))
    marked = found.join(stays.select("stay"), F.col("row") == F.col("stay"), "left")
    # rows that share id and text share a component: all of them stay, or one
    keys, seen = scratch.stored_with(
        marked.groupBy("c0", "c2", "c3").agg(F.count("stay").alias("kept"), F.count(F.lit(1)).alias("rows")).where("kept > 0")
        .select("c0", "c2", "c3", (F.col("kept") < F.col("rows")).alias("once")), "jaccard-kept", n="count_if(once)")
    scratch.close(keys)
    id_, first, second = fresh(docs, "id", "first", "second")
    named = keys.select(F.col("c0").alias(id_), F.col("c2").alias(first), F.col("c3").alias(second), "once")
    match = F.col(doc_id).eqNullSafe(F.col(id_)) & (prints[0] == F.col(first)) & (prints[1] == F.col(second))
    whole = docs.join(named.where("not once").drop("once"), match, "left_semi")
    if not seen["n"]:
        return whole
    single = docs.join(named.where("once").drop("once"), match).dropDuplicates([id_, first, second]).select(*docs.columns)
    return whole.unionByName(single)
