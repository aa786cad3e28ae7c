"""Ranked lexical search: the best documents of each item, by norm buckets of impact vectors.

A document is a sparse vector of impacts over the terms of the items, an item is a vector of term counts; both are
scaled by the root of a term's weight, so that their product is the score. Vectors are ordered by length and
cut into buckets. With the score that an item's list has to reach so far, the Cauchy-Schwarz inequality
prunes whole buckets and the shorter vectors of a bucket, and bounds on single coordinates and on a few of them together prune
vectors inside. What survives is scored again exactly, in integers.

Items are taken in blocks of bounded size, each against all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kifuframe.llm.common import forget, stored

TOP = 20
#: Shares of 100 of a score's length correction.
LENGTH_SHARE = 25
SATURATION = 12
#: A block of items has at most about so many items and bytes.
BLOCK_ITEMS, BLOCK_BYTES = 2_048, 4 << 20
#: Rows of a bucket, of the first round, and by how much later rounds grow.
BUCKET, LEAD, ROUND_GROWTH = 1_024, 4_096, 16
#: Classes of vector length: so many for each doubling.
CLASSES = 4
#: Coordinates of an item, largest first, whose bounds are tested.
FOCUS = 8
CHUNK = 1 << 20
#: Room for rounding in bounds, relative.
ROOM = 1e-9

#: Separators become blanks, A-Z are lowered; bytes from 0x80 on belong to terms.
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def count_terms(text: bytes | None) -> Counter:
    """Terms of a text in UTF-8 with their counts; long texts are cut between terms."""
    counts: Counter = Counter()
    plain = (text or b"").translate(TERM_BYTES)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + CHUNK)
        end = len(plain) if end < 0 else end
        counts.update(plain[at:end].split())
        at = end
    return counts


def weight(holding: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def length_factors(lengths: np.ndarray, documents: int, total: int) -> np.ndarray:
    """The factor m of each document length, in whole numbers of any size."""
    distinct, which = np.unique(lengths, return_inverse=True)
    base = 100 - LENGTH_SHARE
    return np.array([base + LENGTH_SHARE * int(n) * documents // total for n in distinct], np.int64)[which]


class Items:
    """The items of a block as sparse vectors over the block's terms."""

    def __init__(self, texts: list[bytes | None]):
        counted = [count_terms(t) for t in texts]
        self.number = {term: i for i, term in enumerate(sorted(set().union(*counted) if counted else ()))}
        self.terms = [np.array([self.number[t] for t in c], np.int64) for c in counted]
        self.counts = [np.array(list(c.values()), np.int64) for c in counted]

    def weigh(self, weights: np.ndarray) -> None:
        """Gains (count times weight), unit vectors with their largest coordinates first, and lengths."""
        self.weights, roots = weights, np.sqrt(weights.astype(np.float64))
        self.gains = [c * weights[t] for t, c in zip(self.terms, self.counts, strict=True)]
        self.norms, self.focus, self.coordinates = [], [], []
        for t, c in zip(self.terms, self.counts, strict=True):
            vector = c * roots[t]
            norm = math.sqrt(float(vector @ vector))
            first = np.argsort(-vector, kind="stable")[:FOCUS]
            self.norms.append(norm)
            self.focus.append(t[first])
            self.coordinates.append(vector[first] / norm if norm else vector[first])


class Best:
    """The best rows of one item seen so far."""

    def __init__(self, top: int, least: int):
        self.top, self.least, self.rows = top, least, []

    def add(self, scores: np.ndarray, idents: list) -> None:
        self.rows += zip(scores.tolist(), idents, strict=True)
        if len(self.rows) > self.top:
            self.rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0))
            del self.rows[self.top:]
        if len(self.rows) == self.top:
            self.least = max(self.least, min(r[0] for r in self.rows))


class Bucket:
    """Vectors of similar length: their entries by row, and by term as unit coordinates."""

    def __init__(self, offsets: np.ndarray, terms: np.ndarray, impacts: np.ndarray, norms: np.ndarray, roots: np.ndarray):
        self.offsets, self.terms, self.impacts, self.norms = offsets, terms, impacts, norms
        self.rows = np.repeat(np.arange(len(norms)), np.diff(offsets))
        order = np.argsort(terms, kind="stable")
        self.by_term, self.rows_by_term = terms[order], self.rows[order]
        self.units = (impacts * roots[terms] / norms[self.rows])[order]

    def column(self, term: int) -> np.ndarray:
        out = np.zeros(len(self.norms))
        low, high = np.searchsorted(self.by_term, (term, term + 1))
        out[self.rows_by_term[low:high]] = self.units[low:high]
        return out

    def survivors(self, norm: float, focus: np.ndarray, coordinates: np.ndarray, least: int) -> np.ndarray:
        """Rows whose product with an item of that length and those largest coordinates may reach ``least``.

        A unit vector with cosine c to another can differ from it in one coordinate only within an interval; and
        the products of some coordinates plus the lengths of the rest bound the whole.
        """
        cosine = least / (norm * self.norms)
        alive = np.flatnonzero(cosine <= 1 + ROOM)
        if not len(alive) or least <= 0:
            return alive
        cosine = np.minimum(cosine[alive], 1.0)
        part, mass, item_mass = np.zeros(len(alive)), np.zeros(len(alive)), 0.0
        for term, q in zip(focus.tolist(), coordinates.tolist(), strict=True):
            unit = self.column(term)[alive]
            reach = np.sqrt(np.maximum(0.0, (1 - cosine * cosine) * (1 - q * q)))
            upper = np.where(cosine <= q, 1.0, q * cosine + reach)
            part += q * unit
            mass += unit * unit
            item_mass += q * q
            rest = np.sqrt(max(0.0, 1 - item_mass) * np.maximum(0.0, 1 - mass)) + ROOM
            keep = (unit >= q * cosine - reach - ROOM) & (unit <= upper + ROOM) & (part + rest >= cosine - ROOM)
            if not keep.all():
                alive, cosine, part, mass = alive[keep], cosine[keep], part[keep], mass[keep]
                if not len(alive):
                    break
        return alive

    def exact(self, alive: np.ndarray, gain_of: np.ndarray) -> np.ndarray:
        """Whole scores of some rows; every row has entries."""
        if len(alive) == len(self.norms):
            return np.add.reduceat(gain_of[self.terms] * self.impacts, self.offsets[:-1])
        sizes = self.offsets[alive + 1] - self.offsets[alive]
        starts = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) + np.repeat(self.offsets[alive] - starts, sizes)
        return np.add.reduceat(gain_of[self.terms[at]] * self.impacts[at], starts)


def _listed(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat).cast(kind))


def _sparse(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(name)
    offsets = column.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], column.flatten().to_numpy().astype(np.int64)


def _vectors(docs: DataFrame, items: Items) -> DataFrame:
    """``id, n, docs, terms, counts``: of each document that holds terms of the items its length and their counts; of each
    task one row (``docs`` set) with its documents, all their terms, and how many documents hold each term."""
    number, kind = items.number, docs.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, total, ident = 0, 0, None
        holding = np.zeros(len(number), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                batch = whole.slice(at, 1_000)
                ident = batch.schema.field("id").type
                where, lengths, terms, counts = [], [], [], []
                for i, text in enumerate(batch.column("text")):
                    found = count_terms(text.as_py())
                    n = found.total()
                    documents += n > 0
                    total += n
                    held = sorted((number[t], c) for t, c in found.items() if t in number)
                    if held:
                        row = np.array(held, np.int64)
                        holding[row[:, 0]] += 1
                        where.append(i)
                        lengths.append(n)
                        terms.append(row[:, 0])
                        counts.append(row[:, 1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(where, pa.int64())), pa.array(lengths, pa.int64()), pa.nulls(len(where), pa.int64()),
                     _listed(terms, pa.int32()), _listed(counts, pa.int64())], names=["id", "n", "docs", "terms", "counts"])
        if ident is not None:
            held = np.flatnonzero(holding)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, ident), pa.array([total], pa.int64()), pa.array([documents], pa.int64()),
                 _listed([held], pa.int32()), _listed([holding[held]], pa.int64())], names=["id", "n", "docs", "terms", "counts"])

    return stored(docs.mapInArrow(run, f"id {kind}, n bigint, docs bigint, terms array<int>, counts array<bigint>"), "search-terms")


def _impacts(vectors: DataFrame, items: Items, documents: int, total: int) -> DataFrame:
    """``id, terms, impacts, norm`` of the vectors, each stored file by falling length."""
    weights, kind = items.weights, vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            offsets, terms = _sparse(batch, "terms")
            _, counts = _sparse(batch, "counts")
            factor = length_factors(batch.column("n").to_numpy(), documents, total)
            rows = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            impacts = 1_000_000_000 * counts // (1000 * counts + SATURATION * factor[rows])
            squares = np.add.reduceat(weights[terms] * impacts.astype(np.float64) ** 2, offsets[:-1])
            made = pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(terms.astype(np.int32))),
                 pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(impacts)), pa.array(np.sqrt(squares))],
                names=["id", "terms", "impacts", "norm"])
            yield made.filter(pa.array(squares > 0))

    made = vectors.where("docs is null").select("id", "n", "terms", "counts").mapInArrow(
        run, f"id {kind}, terms array<int>, impacts array<bigint>, norm double")
    return stored(made.sortWithinPartitions(F.desc("norm")), "search-impacts")


def _candidates(impacts: DataFrame, items: Items, least: np.ndarray, top: int) -> DataFrame:
    """``item, score, id``: each task's best rows for the items that its buckets can still serve."""
    kind = impacts.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = np.sqrt(items.weights.astype(np.float64))
        best, gain_of, ident = {}, np.zeros(len(items.number), np.int64), pa.int64()
        for whole in batches:
            for at in range(0, whole.num_rows, BUCKET):
                batch = whole.slice(at, BUCKET)
                ident = batch.schema.field("id").type
                offsets, terms = _sparse(batch, "terms")
                _, values = _sparse(batch, "impacts")
                norms = batch.column("norm").to_numpy()
                longest = float(norms.max())
                bucket, idents = None, batch.column("id")
                for i, norm in enumerate(items.norms):
                    floor = best[i].least if i in best else int(least[i])
                    if not norm or floor > norm * longest * (1 + ROOM):
                        continue
                    if bucket is None:
                        bucket = Bucket(offsets, terms, values, norms, roots)
                    alive = bucket.survivors(norm, items.focus[i], items.coordinates[i], floor)
                    if not len(alive):
                        continue
                    gain_of[items.terms[i]] = items.gains[i]
                    scores = bucket.exact(alive, gain_of)
                    gain_of[items.terms[i]] = 0
                    good = scores >= max(1, floor)
                    if not good.any():
                        continue
                    alive, scores = alive[good], scores[good]
                    if len(scores) > top:  # ties with the last stay until their ids are compared
                        good = scores >= np.partition(scores, -top)[-top]
                        alive, scores = alive[good], scores[good]
                    best.setdefault(i, Best(top, int(least[i]))).add(scores, idents.take(pa.array(alive)).to_pylist())
        for i, found in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([i] * len(found.rows), pa.int32()), pa.array([s for s, _ in found.rows], pa.int64()),
                 pa.array([d for _, d in found.rows], ident)], names=["item", "score", "id"])

    return impacts.mapInArrow(run, f"item int, score bigint, id {kind}")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _rounds(impacts: DataFrame) -> list[tuple[float, float]]:
    """Ranges of length, longest first, that hold ever more rows; read off a count per class of length."""
    made = impacts.groupBy(F.floor(F.log2("norm") * CLASSES).alias("k")).count().collect()  # a class per factor 2 ** (1 / CLASSES)
    out, high, rows, wanted = [], math.inf, 0, LEAD
    for k, count in sorted(((r["k"], r["count"]) for r in made), reverse=True):
        rows += count
        if rows >= wanted:
            low = 2.0 ** (k / CLASSES)
            out.append((low, high))
            high, rows, wanted = low, 0, wanted * ROUND_GROWTH
    return [*out, (0.0, high)] if rows else out


def _search_block(docs: DataFrame, idents: list, texts: list[bytes | None], top: int, ident_type: str) -> DataFrame | None:
    spark = docs.sparkSession
    items = Items(texts)
    if not items.number:
        return None
    vectors = _vectors(docs, items)
    documents, total = vectors.where("docs is not null").agg(F.sum("docs"), F.sum("n")).first()
    if not total:
        return None
    held = vectors.where("docs is not null").select(F.explode(F.arrays_zip("terms", "counts")).alias("x")) \
        .groupBy(F.col("x.terms").alias("t")).agg(F.sum("x.counts").alias("c")).collect()  # the block's terms
    holding = np.zeros(len(items.number), np.int64)
    for r in held:
        holding[r["t"]] = r["c"]
    items.weigh(np.array([weight(int(h), documents) for h in holding], np.int64))
    impacts = _impacts(vectors, items, documents, total)
    forget(vectors)
    least, found = np.zeros(len(texts), np.int64), None
    for low, high in _rounds(impacts):
        if high < math.inf and all(least[i] > norm * high * (1 + ROOM) for i, norm in enumerate(items.norms) if norm):
            break
        rows = impacts.where((F.col("norm") >= low) & (F.col("norm") < high))
        more = _candidates(rows, items, least, top)
        found = stored(_ranked(more if found is None else found.drop("rank").unionByName(more), top), "search-found", small=True)
        for r in found.where(F.col("rank") == top).select("item", "score").collect():  # one row for each item of the block
            least[r["item"]] = max(least[r["item"]], r["score"])
    forget(impacts)
    if found is None:
        return None
    named = spark.createDataFrame(list(enumerate(idents)), f"item int, item_id {ident_type}")
    return found.join(named, "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def _as_bytes(text: Column) -> Column:
    return text.cast("binary")


def best_documents(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   item_id: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each item with the highest scores above 0.

    * Equal scores go by ascending ``doc_id``, null last. Fewer documents give fewer rows.
    * A null or empty text has no terms: such a document is never found and not counted, such an item has no rows.
    * A row is a document, and a row is an item: repeated rows are found, and answered, each for itself.
    * An empty table on either side gives an empty table. Other columns are ignored.

    The driver holds one block of items, with a number for each of their terms, and a score for each item.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(doc_id).alias("id"), _as_bytes(F.col(text)).alias("text"))
    asked = stored(queries.select(F.col(item_id).alias("id"), _as_bytes(F.col(item_text)).alias("text"))
                   .withColumn("row", F.monotonically_increasing_id()), "search-items", small=True)
    rows, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(-(-rows // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    kind, found_kind = asked.schema["id"].dataType.simpleString(), plain.schema["id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {found_kind}, score bigint")
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).orderBy("row").collect()  # bounded by the block
        texts = [bytes(r["text"]) if r["text"] is not None else None for r in mine]
        found = _search_block(plain, [r["id"] for r in mine], texts, top, kind)
        if found is not None:
            out = out.unionByName(found)
    return out
