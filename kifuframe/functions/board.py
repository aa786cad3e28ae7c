"""Board geometry as column expressions.

A position is two ascending cell arrays, ``own_cells`` and ``opp_cells``, seen from
the player to move. Dense planes are built last and only on request.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kifuframe.functions.arrays import cell_range, int_div, let

N_PLANES = 19
N_TRANSFORMS = 8
# Inverse of each transform: the two quarter turns undo each other.
INVERSE_TRANSFORM = [0, 3, 2, 1, 4, 5, 6, 7]
# Black, white and empty point in rendered boards, then the separator.
STONE_MARKS = {1: "● ", -1: "○ ", 0: ". "}


def in_bounds(row: Column, col: Column, n: int | Column) -> Column:
    return (row >= 0) & (row < n) & (col >= 0) & (col < n)


def cell_of(row: Column, col: Column, n: int | Column) -> Column:
    return (row * n + col).cast("int")


def row_of(cell: Column, n: int) -> Column:
    return int_div(cell, n)


def col_of(cell: Column, n: int) -> Column:
    return (cell % n).cast("int")


def legal_cells(own: Column, opp: Column, n: int) -> Column:
    """Empty cells, ascending."""
    return F.array_except(cell_range(n), F.concat(own, opp))


def signs(own: Column, opp: Column, n: int) -> Column:
    """One number per cell: 1 own, -1 opponent, 0 empty.

    The cells are tagged and sorted once, so the cost grows with the cells and not with their square.
    """
    def tagged(cells: Column, mark: int) -> Column:
        return F.transform(cells, lambda c: F.struct(c.alias("cell"), F.lit(mark).alias("mark")))

    every = let(own, lambda mine: let(opp, lambda theirs: F.concat(
        tagged(mine, 1), tagged(theirs, -1), tagged(legal_cells(mine, theirs, n), 0))))
    return F.transform(F.sort_array(every), lambda c: c["mark"])


def state_planes(own: Column, opp: Column, player: Column, n: int, legal_plane: bool = True) -> Column:
    """19 planes, flattened in (plane, row, col) order.

    Plane 0 holds the mover's stones, 8 the opponent's, 16 the side to move and
    17 the empty points; all others are zero.
    """
    size = n * n
    zero = F.lit(0.0).cast("float")
    one = F.lit(1.0).cast("float")
    empty = F.array_repeat(zero, size)

    def marks(cells: Column, mark: int) -> Column:
        return F.transform(cells, lambda m: F.when(m == mark, one).otherwise(zero))

    return let(signs(own, opp, n), lambda cells: F.concat(
        marks(cells, 1),
        F.array_repeat(zero, 7 * size),
        marks(cells, -1),
        F.array_repeat(zero, 7 * size),
        F.array_repeat(player.cast("float"), size),
        marks(cells, 0) if legal_plane else empty,
        empty,
    ))


def transform_coefficients(n: int) -> list[tuple[int, int, int]]:
    """Each symmetry as ``to_cell = base + by_row * row + by_col * col``.

    Ids: 0 identity, 1-3 quarter turns counter-clockwise, 4 left-right flip,
    5 up-down flip, 6 transpose, 7 anti-transpose.
    """
    last = n - 1
    # (row', col') of each transform as (base, by_row, by_col) pairs
    images = [
        ((0, 1, 0), (0, 0, 1)),
        ((last, 0, -1), (0, 1, 0)),
        ((last, -1, 0), (last, 0, -1)),
        ((0, 0, 1), (last, -1, 0)),
        ((0, 1, 0), (last, 0, -1)),
        ((last, -1, 0), (0, 0, 1)),
        ((0, 0, 1), (0, 1, 0)),
        ((last, 0, -1), (last, -1, 0)),
    ]
    return [tuple(n * r + c for r, c in zip(to_row, to_col)) for to_row, to_col in images]


def canonical_transform(transform_id: int, convention: str = "canonical") -> int:
    """Map an id of another numbering; ``"loader"`` swaps the two flips."""
    if convention == "loader":
        return {4: 5, 5: 4}.get(transform_id, transform_id)
    return transform_id


def image_cells(transform_id: int, n: int, convention: str = "canonical") -> list[int]:
    """Image of every cell under one symmetry."""
    base, by_row, by_col = transform_coefficients(n)[canonical_transform(transform_id, convention)]
    return [base + by_row * row + by_col * col for row in range(n) for col in range(n)]


def transforms_literal(n: int, convention: str = "canonical") -> Column:
    """The eight symmetries as an array of ``struct<transform_id,images>``, to explode into rows."""
    return F.array(*[
        F.struct(F.lit(tid).alias("transform_id"), F.lit(image_cells(tid, n, convention)).alias("images"))
        for tid in range(N_TRANSFORMS)])


def apply_transform(cell: Column, transform: Column) -> Column:
    """Image of a cell under a struct of :func:`transforms_literal`."""
    return F.get(transform["images"], cell)


def transform_cells(cells: Column, transform: Column) -> Column:
    """Image of a cell array, ascending."""
    return let(transform["images"], lambda images: F.sort_array(
        F.transform(cells, lambda c: F.get(images, c))))


def _sources(transform_id: Column, n: int, convention: str) -> Column:
    """For every cell of the new board the cell of the old one it is read from."""
    inverse = F.array(*[F.lit(image_cells(i, n, convention)) for i in INVERSE_TRANSFORM])
    return F.get(inverse, transform_id)


def transform_vector(vector: Column, transform_id: Column, n: int, convention: str = "canonical") -> Column:
    """Permute one value per cell."""
    return let(vector, lambda old: F.transform(
        _sources(transform_id, n, convention), lambda source: F.get(old, source)))


def transform_planes(planes: Column, transform_id: Column, n: int, convention: str = "canonical") -> Column:
    """Permute the cells inside each plane; the plane order stays."""
    size = n * n
    return let(planes, lambda old: let(_sources(transform_id, n, convention), lambda sources: F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size(old) - 1, F.lit(size)),
            lambda start: F.transform(sources, lambda source: F.get(old, start + source))))))


def liberties(cell: Column, marks: Column, n: int) -> Column:
    """Empty orthogonal neighbours of one stone, read off the marks of all cells (:func:`signs`)."""
    row, col = row_of(cell, n), col_of(cell, n)

    def free(on_board: Column, near: Column) -> Column:
        return F.when(on_board & (F.get(marks, near) == 0), 1).otherwise(0)

    return (
        free(row > 0, cell - n) + free(row < n - 1, cell + n)
        + free(col > 0, cell - 1) + free(col < n - 1, cell + 1)
    )


def render(black: Column, white: Column, n: int) -> Column:
    """Text picture: a header row, then one line per board row."""
    header = "  " + " ".join(str(i) for i in range(n))

    marks = F.transform(signs(black, white, n), lambda m: (
        F.when(m == 1, STONE_MARKS[1]).when(m == -1, STONE_MARKS[-1]).otherwise(STONE_MARKS[0])))
    lines = let(marks, lambda held: F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda r: F.concat(r.cast("string"), F.lit(" "), F.array_join(F.slice(held, r * n + 1, F.lit(n)), ""))))
    return F.concat_ws("\n", F.lit(header), F.array_join(lines, "\n"))
