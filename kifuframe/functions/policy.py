"""Prediction arrays: soft-max, masks, choices and losses, row by row inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kifuframe.functions.arrays import argmax_index, let, total


def as_double(values: Column) -> Column:
    return values.cast("array<double>")


def softmax(logits: Column, temperature: float | Column = 1.0) -> Column:
    t = F.lit(temperature) if isinstance(temperature, (int, float)) else temperature
    return let(logits, lambda raw: let(F.array_max(raw), lambda top: let(
        F.transform(raw, lambda x: F.exp((x - top) / t)),
        lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)),
    )))


def log_softmax(logits: Column) -> Column:
    return let(logits, lambda raw: let(F.array_max(raw), lambda top: let(
        F.log(total(F.transform(raw, lambda x: F.exp(x - top)))),
        lambda log_sum: F.transform(raw, lambda x: x - top - log_sum),
    )))


def distribution(logits: Column, temperature: float | Column = 1.0) -> Column:
    """Soft-max, or the uniform distribution when it does not sum to a positive number."""
    def normalised(p: Column) -> Column:
        return let(total(p), lambda s: F.when(
            s > 0, F.transform(p, lambda x: x / s)
        ).otherwise(F.transform(p, lambda _: F.lit(1.0) / F.size(p))))

    return let(softmax(logits, temperature), normalised)


def _with_legal_sum(logits: Column, legal: Column, temperature, body) -> Column:
    """Bind the soft-max, the legal cells and their total probability."""
    return let(softmax(logits, temperature), lambda p: let(legal, lambda cells: let(
        total(F.transform(cells, lambda c: F.get(p, c))), lambda s: body(p, cells, s))))


def legal_probabilities(logits: Column, legal: Column, temperature: float | Column = 1.0) -> Column:
    """``array<struct<cell,prob>>`` of the legal cells, renormalised.

    Works on the legal cells alone, so it stays linear in the board size.
    """
    return _with_legal_sum(logits, legal, temperature, lambda p, cells, s: F.transform(
        cells, lambda c: F.struct(c.alias("cell"), (F.get(p, c) / s).alias("prob"))))


def masked_policy(logits: Column, legal: Column, temperature: float | Column = 1.0) -> Column:
    """Full-length policy: zero on illegal cells, renormalised over the legal ones.

    Legal and illegal cells are tagged with their probability and sorted, which stays near linear.
    """
    def full(p: Column, cells: Column, s: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(p) - 1)
        tagged = F.concat(
            F.transform(F.array_intersect(every, cells), lambda c: F.struct(c.alias("cell"), (F.get(p, c) / s).alias("prob"))),
            F.transform(F.array_except(every, cells), lambda c: F.struct(c.alias("cell"), F.lit(0.0).alias("prob"))))
        return F.transform(F.sort_array(tagged), lambda x: x["prob"])

    return _with_legal_sum(logits, legal, temperature, full)


def greedy_cell(logits: Column, legal: Column) -> Column:
    """Legal cell with the largest logit, lowest cell on ties; null without a legal cell."""
    best = let(logits, lambda x: F.array_max(F.transform(
        legal, lambda c: F.struct(F.get(x, c).alias("logit"), (-c).alias("neg")))))
    return (-best["neg"]).cast("int")


def sampled_cell(logits: Column, legal: Column, u: Column, temperature: float | Column = 1.0) -> Column:
    """Inverse-CDF draw from the masked policy with a given uniform ``u``."""
    start = F.struct(F.lit(0.0).alias("cum"), F.lit(None).cast("int").alias("cell"))

    def walk(p: Column, draw: Column) -> Column:
        def step(acc: Column, item: Column) -> Column:
            cum = acc["cum"] + item["prob"]
            return F.struct(
                cum.alias("cum"),
                F.coalesce(acc["cell"], F.when(cum > draw, item["cell"])).alias("cell"),
            )
        # rounding may leave the last cumulative value below the draw
        return F.coalesce(F.aggregate(p, start, step, lambda acc: acc["cell"]), F.element_at(p, -1)["cell"])

    return F.when(F.size(legal) > 0, let(u, lambda draw: let(
        legal_probabilities(logits, legal, temperature), lambda p: walk(p, draw))))


def ranked(items: Column, k: int) -> Column:
    """First ``k`` of ``array<struct<cell,prob>>`` by probability, lowest cell on ties."""
    keyed = F.transform(items, lambda x: F.struct(
        (-x["prob"]).alias("key"), x["cell"].alias("cell"), x["prob"].alias("prob")))
    return F.transform(
        F.slice(F.sort_array(keyed), 1, k),
        lambda x: F.struct(x["cell"].alias("cell"), x["prob"].alias("prob")),
    )


def indexed(probabilities: Column) -> Column:
    """A full-length policy as ``array<struct<cell,prob>>``."""
    return F.transform(probabilities, lambda p, i: F.struct(i.alias("cell"), p.alias("prob")))


def best_cell(probabilities: Column) -> Column:
    return argmax_index(probabilities)


def one_hot(action: Column, size: int) -> Column:
    """Vector with a one at ``action``; null when the action is missing or out of range."""
    return F.when((action >= 0) & (action < size), F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i == action, 1.0).otherwise(0.0)))


def cross_entropy(logits: Column, target: Column) -> Column:
    """``-sum(target * log_softmax(logits))`` with soft targets."""
    return let(log_softmax(logits), lambda q: -total(F.zip_with(target, q, lambda t, x: t * x)))


def kl_divergence(target_logits: Column, logits: Column) -> Column:
    """KL(softmax(target_logits) || softmax(logits))."""
    return let(log_softmax(target_logits), lambda lp: let(
        log_softmax(logits),
        lambda lq: total(F.zip_with(lp, lq, lambda a, b: F.exp(a) * (a - b))),
    ))
