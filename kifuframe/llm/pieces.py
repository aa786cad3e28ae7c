"""Encoding and decoding with merge-type SentencePiece vocabularies.

Encoding keeps an agenda of adjacent symbol pairs whose union is a piece; the pair with the
highest score, the leftmost of equal ones, is merged first. Text is cut before a space mark that follows
another character, where no piece of the vocabulary reaches across (this is checked when the
vocabulary is loaded): the agendas of the parts cannot touch each other. Agendas of short parts run
side by side in arrays, those of long parts on a heap.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from kifuframe.llm.common import kept_in_worker, schema_with, with_columns

SPACE = "▁"
#: What an unknown id decodes to. Fixed value.
UNKNOWN = " ⁇ "
SIDE_BY_SIDE = 48
CACHED_PARTS = 500_000
DOCS_AT_ONCE = 500
_PARTS = re.compile(f"{SPACE}+[^{SPACE}]*")
_NONE = np.int64(1 << 30)


class Vocabulary:
    """Pieces, scores and mergeable pairs of one model."""

    def __init__(self, model: str):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model)
        size = lib.vocab_size()
        pieces = [lib.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        if any(lib.is_unused(i) for i in plain) or sum(lib.is_byte(i) for i in range(size)) != 256:
            raise ValueError("only vocabularies with byte fallback and without unused pieces are supported")
        if lib.normalize(" \t aﬁ Å") != f"{SPACE}{SPACE}\t{SPACE}aﬁ{SPACE}Å":
            raise ValueError("only models that leave the text as it is and put a space mark before it are supported")
        if any(SPACE in pieces[i].lstrip(SPACE) for i in plain):
            raise ValueError("a piece holds a space mark inside; the text cannot be cut there")
        self.size, self.end = size, lib.eos_id()
        self.symbol = {pieces[i]: i for i in plain}
        self.byte = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        order = sorted(plain, key=lambda i: -lib.get_score(i))
        rank, last = {}, None
        for i in order:  # equal scores share a rank
            last = last if last is not None and lib.get_score(i) == last[0] else (lib.get_score(i), len(rank))
            rank[i] = last[1]
        for i in plain:  # characters that only occur inside pieces
            for ch in pieces[i]:
                self.symbol.setdefault(ch, size + len(self.symbol))
        self.width = size + len(self.symbol) + 1
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for i in plain:
            piece = pieces[i]
            for at in range(1, len(piece)):
                left, right = self.symbol.get(piece[:at]), self.symbol.get(piece[at:])
                if left is not None and right is not None:
                    self.pairs[left, right] = rank[i], i
        keys = np.array([a * self.width + b for a, b in self.pairs], np.int64)
        by_key = np.argsort(keys)
        made = np.array(list(self.pairs.values()), np.int64)[by_key]
        self.keys, self.ranks, self.made = keys[by_key], made[:, 0], made[:, 1]
        self.bytes_of = [b"" if lib.is_control(i) else bytes([self.byte.index(i)]) if lib.is_byte(i)
                         else UNKNOWN.encode() if lib.is_unknown(i) else pieces[i].replace(SPACE, " ").encode()
                         for i in range(size)]
        self.controls = [i for i in range(size) if lib.is_control(i)]
        self.keeps_space = [lib.is_byte(i) or lib.is_unknown(i) for i in range(size)]
        #: ids travel as bytes inside the worker: small to keep and quick to string together
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.known: dict[str, bytes] = {}

    def ids_of(self, symbols: Iterable[int], chars: Iterable[str]) -> bytes:
        """Symbols as ids; a character outside the vocabulary becomes its bytes."""
        out: list[int] = []
        for s, c in zip(symbols, chars, strict=True):
            if s < self.size:
                out.append(s)
            else:
                out.extend(self.byte[b] for b in c.encode("utf-8", "replace"))
        return np.array(out, self.kind).tobytes()

    def merge_on_heap(self, part: str) -> bytes:
        """One agenda; for long parts."""
        outside = self.width - 1
        symbols = [self.symbol.get(c, outside) for c in part]
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[int, int, int, int]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right < n:
                found = self.pairs.get((symbols[left], symbols[right]))
                if found:
                    heapq.heappush(agenda, (found[0], left, symbols[left], symbols[right]))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, left, a, b = heapq.heappop(agenda)
            right = after[left]
            if symbols[left] != a or right >= n or symbols[right] != b:
                continue
            symbols[left] = self.pairs[a, b][1]
            symbols[right] = -1
            after[left] = after[right]
            if after[right] < n:
                before[after[right]] = left
            if before[left] >= 0:
                offer(before[left])
            offer(left)
        return self.ids_of(*zip(*[(s, part[i]) for i, s in enumerate(symbols) if s >= 0], strict=True))

    def _offers(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        fits = self.keys[at] == key
        return np.where(fits, self.ranks[at], _NONE), self.made[at]

    def merge_side_by_side(self, parts: list[str]) -> list[bytes]:
        """One merge per part and round, each the best of its agenda."""
        outside = self.width - 1
        chars = "".join(parts)
        symbols = np.fromiter(map(self.symbol.get, chars, [outside] * len(chars)), np.int64, len(chars))
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        owner = np.repeat(np.arange(len(parts)), lengths)
        char_at = np.arange(len(chars))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rank = np.full(len(symbols), _NONE)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self._offers(symbols[inner], symbols[inner + 1])[0]
        while len(symbols):
            start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            best = np.minimum.reduceat((rank << 32) | np.arange(len(rank)), start)
            over = (best >> 32) >= _NONE
            if over.any():
                count = np.diff(np.concatenate((start, [len(symbols)])))
                ended = np.repeat(over, count)
                done.append((owner[ended], symbols[ended], char_at[ended]))
                keep = ~ended
                shift = np.cumsum(keep) - 1
                symbols, owner, char_at, rank = symbols[keep], owner[keep], char_at[keep], rank[keep]
                best = best[~over]
                at = shift[best & 0xFFFFFFFF]
            else:
                at = best & 0xFFFFFFFF
            if not len(symbols):
                break
            symbols[at] = self._offers(symbols[at], symbols[at + 1])[1]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            shift = np.cumsum(keep) - 1
            symbols, owner, char_at, rank = symbols[keep], owner[keep], char_at[keep], rank[keep]
            at = shift[at]
            changed = np.concatenate((at, at[at > 0] - 1))
            rank[changed] = _NONE
            paired = changed[changed + 1 < len(symbols)]
            paired = paired[owner[paired] == owner[paired + 1]]
            rank[paired] = self._offers(symbols[paired], symbols[paired + 1])[0]
        owner = np.concatenate([d[0] for d in done])
        order = np.argsort(owner, kind="stable")
        flat = np.concatenate([d[1] for d in done])[order]
        places = np.concatenate([d[2] for d in done])[order]
        ends = np.cumsum(np.bincount(owner, minlength=len(parts)))
        out = self._cut(flat, ends)
        for i in np.unique(owner[order][flat >= self.size]).tolist():  # parts with characters outside the vocabulary
            low, high = int(ends[i - 1]) if i else 0, int(ends[i])
            out[i] = self.ids_of(flat[low:high].tolist(), [chars[p] for p in places[low:high]])
        return out

    def _cut(self, flat: np.ndarray, ends: np.ndarray) -> list[bytes]:
        raw = flat.astype(self.kind).tobytes()
        marks = [0, *(ends * self.kind.itemsize).tolist()]
        return [raw[a:b] for a, b in zip(marks, marks[1:])]

    def learn(self, keys: Iterable[str]) -> int:
        """Encode the parts not met before and compare each with the library's ids.

        Returns how many differed; for those the library's ids are taken.
        """
        new = [k for k in keys if k not in self.known]
        if not new:
            return 0
        parts = [SPACE + k for k in new]
        short = [i for i, p in enumerate(parts) if len(p) <= SIDE_BY_SIDE]
        for i, ids in zip(short, self.merge_side_by_side([parts[i] for i in short]) if short else (), strict=True):
            self.known[new[i]] = ids
        for i, p in enumerate(parts):
            if len(p) > SIDE_BY_SIDE:
                self.known[new[i]] = self.merge_on_heap(p)
        checked = [k for k in new if k]  # the library has no ids for an empty text
        theirs = self.library.encode([k.replace(SPACE, " ") for k in checked], num_threads=1)
        theirs = self._cut(np.fromiter(chain.from_iterable(theirs), np.int64), np.cumsum([len(t) for t in theirs], dtype=np.int64))
        wrong = [(k, ids) for k, ids in zip(checked, theirs, strict=True) if self.known[k] != ids]
        self.known.update(wrong)
        return len(wrong)

    def parts_of(self, text: str) -> list[str]:
        """The text cut before space marks, each part without its first mark."""
        if not text:
            return []
        text = text.replace(SPACE, " ")
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [p[1:] for p in _PARTS.findall(SPACE + text.replace(" ", SPACE))]

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids of all texts in a row, the end id after each, their offsets, and the number of differing parts."""
        cut = [self.parts_of(t) for t in texts]
        needed = set(chain.from_iterable(cut))
        if len(self.known) > CACHED_PARTS:  # what this slice needs is what is frequent
            self.known = {k: self.known[k] for k in needed if k in self.known}
        differing = self.learn(needed)
        end = np.array([self.end], self.kind).tobytes()
        coded = [b"".join(map(self.known.__getitem__, parts)) + end for parts in cut]
        offsets = np.cumsum([0, *(len(c) // self.kind.itemsize for c in coded)]).astype(np.int32)
        return np.frombuffer(b"".join(coded), self.kind).astype(np.int32), offsets, differing

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control ids vanish, one leading space goes, invalid bytes become U+FFFD."""
        if any(c in ids[:-1] for c in self.controls):
            raws = [b""]  # a control id ends a run of bytes
            for i in ids:
                raws[-1] += self.bytes_of[i]
                if i in self.controls:
                    raws.append(b"")
        else:
            raws = [b"".join(map(self.bytes_of.__getitem__, ids))]
        first = next((i for i in ids if self.bytes_of[i]), None)
        if first is not None and not self.keeps_space[first]:
            raws = _without_space(raws)
        return "".join(map(_text_of, raws))


def _without_space(raws: list[bytes]) -> list[bytes]:
    """The first space, if the text begins with one, goes."""
    at = next(i for i, r in enumerate(raws) if r)
    return [*raws[:at], raws[at].removeprefix(b" "), *raws[at + 1:]]


def _text_of(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return _lenient(raw)


def _lenient(raw: bytes) -> str:
    """Valid characters as they are, each other byte as U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        for size in range(1, 5):
            try:
                out.append(raw[at:at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def vocabulary(model: str) -> Vocabulary:
    return kept_in_worker(f"vocabulary {model}", lambda: Vocabulary(model))


def encode(docs: DataFrame, model: str, text: str = "text", out: str = "ids", drop_text: bool = False) -> DataFrame:
    """Adds ``ids`` (array of int, the end id last) and ``n_differing`` to each row.

    Every distinct part of a batch is compared with the library's ids, and one whole text per
    slice of 500 rows too; ``n_differing`` counts the parts of the slice that had to be taken from the
    library, on its first row (0 everywhere unless the two disagree).

    * A null text is empty and gets the end id alone. Any text is taken whole, however long.
    * Rows are encoded alone; an empty table stays empty. Columns of the same names are replaced.

    ``model`` is a path that every executor can open. No shuffle.
    """
    base = docs.drop(text) if drop_text else docs

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model)
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(at, DOCS_AT_ONCE)
                texts = [t or "" for t in part.column(text).to_pylist()]
                ids, offsets, differing = words.encode_batch(texts)
                probe = (at // DOCS_AT_ONCE) % len(texts)
                if ids[offsets[probe]:offsets[probe + 1] - 1].tolist() != words.library.encode(texts[probe]):
                    raise ValueError("the library encodes a whole text unlike its parts")
                if drop_text:
                    part = part.drop_columns([text])
                flags = np.zeros(len(texts), np.int64)
                flags[0] = differing
                yield with_columns(part, {
                    out: pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), "n_differing": pa.array(flags)})

    return docs.mapInArrow(run, schema_with(base, f"{out} array<int>, n_differing bigint"))


def decode(rows: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of an array of ids; null or empty ids give an empty text. No shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model)
        for batch in batches:
            held = batch.column(ids)
            # one row at a time: numbers of a whole batch as Python objects would fill the worker
            texts = [words.decode(held[i].values.to_numpy().tolist() if held[i].is_valid else []) for i in range(len(held))]
            yield with_columns(batch, {out: pa.array(texts, pa.string())})

    return rows.mapInArrow(run, schema_with(rows, f"{out} string"))
