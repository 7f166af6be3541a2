"""The model of a whole batch of programs from one shuffle of its tables.

``checked_model`` deals all rows of a program's tables by problem, once, and folds
whole problems in numpy: the findings of ``check_program`` that the engine does not
support, and for sound problems the row of ``prepare_model``.  Very large tables are
dealt in slices of the problems, so shuffle files of one slice are on disk at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.nodes import ROUND_EPS, root_multipliers, sizes
from lattica.session import Tables
from lattica.sources.program import PID, Program

ROWS_PER_PART = 1_000_000    # rows of the program that one task folds, about
LEAST_PER_PART = 20_000      # and that are worth a task of their own
ROWS_PER_SLICE = 150_000_000  # rows of the program that are dealt at a time, about
ROWS_PER_FOLD = 100_000      # rows that a worker folds at once, and those of the last problem

CON, VAR, COEF, SENSE = 0, 1, 2, 3   # kinds of rows
LE, GE, EQ, OTHER = 0, 1, 2, 3       # signs of constraint rows
MODEL = ("problem_id bigint, bad boolean, sign double, names array<string>, c array<double>, vlb array<double>, vub array<double>, a array<double>, "
         "b array<double>, int_obj boolean, lam array<double>, single boolean, several boolean, cells bigint")
_FIELDS = pa.schema([("problem_id", pa.int64()), ("bad", pa.bool_()), ("sign", pa.float64()), ("names", pa.list_(pa.string())),
                     *[(name, pa.list_(pa.float64())) for name in ("c", "vlb", "vub", "a", "b")], ("int_obj", pa.bool_()), ("lam", pa.list_(pa.float64())),
                     ("single", pa.bool_()), ("several", pa.bool_()), ("cells", pa.int64())])


def rows_of(program: Program) -> int:
    """Rows of the large tables."""
    return program.vars.count() + program.coefs.count()


def parts_for(program: Program, rows: int) -> int:
    """Parts that the problems are dealt to: enough for all cores, and for the memory of a task."""
    cores = program.vars.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-rows // ROWS_PER_PART), min(cores, -(-rows // LEAST_PER_PART)))


def long_rows(program: Program) -> DataFrame:
    """All rows that name a problem, under one schema: (problem_id, var, con, kind, code, x, y, z)."""
    null, none = F.lit(None).cast("string"), F.lit(None).cast("double")
    code = lambda column, words: reduce(lambda out, w: out.when(F.col(column) == w[0], w[1]), words, F.when(F.col(column).isNull(), -1)).otherwise(OTHER)
    row = lambda t, kind, var, con, code, x, y=none, z=none: t.where(F.col(PID).isNotNull()).select(
        PID, var.alias("var"), con.alias("con"), F.lit(kind).cast("tinyint").alias("kind"), code.cast("tinyint").alias("code"), x.alias("x"), y.alias("y"), z.alias("z"))
    # Rows of a problem are sorted by "con#" as those of ``normalized_rows`` by "con#ge" and "con#le".
    con = F.concat("con", F.lit("#"))
    parts = [row(program.vars, VAR, F.col("var"), null, F.coalesce(F.col("is_int"), F.lit(True)), F.col("lb"), F.col("ub"), F.col("obj")),
             row(program.cons, CON, null, con, code("sense", (("<=", LE), (">=", GE), ("=", EQ))), F.col("rhs")),
             row(program.coefs, COEF, F.col("var"), con, F.lit(0), F.col("coef"))]
    if not isinstance(program.sense, str):
        parts.append(row(program.sense, SENSE, null, null, code("sense", (("min", 0), ("max", 1))), none))
    return reduce(DataFrame.unionByName, parts)


def checked_model(program: Program, tables: Tables, rows: int, method: str = "lagrangian") -> tuple[DataFrame, int, int]:
    """One row per problem that has variables, dealt by ``tables``: ``bad`` where ``unsupported_problems``
    has it (all else is null then), or the row of ``prepare_model``; the number of sound problems, and of bad ones."""
    if method not in ("box", "lagrangian"):
        raise ValueError(f"method must be 'box' or 'lagrangian', not {method!r}")
    fold = folding(method, program.sense if isinstance(program.sense, str) else None)
    long, n = long_rows(program), -(-rows // ROWS_PER_SLICE)
    slices = [long] if n < 2 else [long.where(F.pmod(F.xxhash64(PID), F.lit(n)) == i) for i in range(n)]
    folded = [x.repartition(tables.parts, PID).sortWithinPartitions(PID).mapInArrow(fold, MODEL) for x in slices]
    model = tables.put(*folded)
    seen = model.agg(F.count_if(~F.col("bad")), F.count_if("bad"), F.coalesce(F.max("cells"), F.lit(1))).first()
    tables.widest(seen[2])
    return model.drop("cells"), seen[0], seen[1]


def folding(method: str, sense: str | None):
    """The function of ``mapInArrow``: whole problems at a time, as the rows come sorted."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= ROWS_PER_FOLD:
                table = pa.Table.from_batches(held).combine_chunks()
                pid = table.column(0).to_numpy()
                end = int(np.searchsorted(pid, pid[-1]))  # the last problem may go on
                if end:
                    yield from folded(table.slice(0, end), method, sense).to_batches()
                rest = table.slice(end)
                held, n = rest.to_batches(), rest.num_rows if end else 0
        if held:
            yield from folded(pa.Table.from_batches(held).combine_chunks(), method, sense).to_batches()

    return stream


def _ranks(column: pa.ChunkedArray) -> np.ndarray:
    """The rank of each text among the distinct ones, -1 for null."""
    found = column.combine_chunks().dictionary_encode()
    rank = np.full(len(found.dictionary) + 1, -1)
    rank[np.asarray(pc.sort_indices(found.dictionary))] = np.arange(len(found.dictionary))
    return rank[np.asarray(found.indices.fill_null(len(found.dictionary)))]


def _lists(values: np.ndarray | pa.Array, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(values))


def _whole(x: np.ndarray) -> np.ndarray:
    """Numbers of a BIGINT, as Spark's ceil and floor give them, without a negative zero."""
    return np.clip(x, -(2.0 ** 63), 2.0 ** 63) + 0.0


def folded(table: pa.Table, method: str, sense: str | None) -> pa.Table:
    """MODEL of whole problems, whose rows come sorted by problem."""
    pid, kind = table.column("problem_id").to_numpy(), table.column("kind").to_numpy().astype(np.int64)
    var, con = _ranks(table.column("var")), _ranks(table.column("con"))
    first = np.r_[True, pid[1:] != pid[:-1]]
    # From here on by problem, variable (null first), kind and constraint.
    order = np.lexsort((con, kind, var, np.cumsum(first)))
    table = table.take(pa.array(order))
    pid, kind, var, con, code = pid[order], kind[order], var[order], con[order], table.column("code").to_numpy()
    x, y, z = (table.column(k).to_numpy() for k in "xyz")  # null is NaN ...
    null = {k: table.column(k).is_null().to_numpy() for k in "xyz"}  # ... but told apart here
    of = np.cumsum(first) - 1
    ids = pid[first]
    n = len(ids)
    is_con, is_var, is_coef = kind == CON, kind == VAR, kind == COEF
    bad = np.zeros(n, bool)

    def mark(rows: np.ndarray) -> None:
        bad[of[rows]] = True

    mark((is_var & ((var < 0) | null["x"] | null["y"] | null["z"])) | (is_con & ((con < 0) | null["x"] | (code < 0)))
         | (is_coef & ((var < 0) | (con < 0) | null["x"])))
    mark(~np.isfinite(x) & ~is_var & (kind != SENSE))
    mark(is_var & (~np.isfinite(x) | ~np.isfinite(y) | ~np.isfinite(z) | (code == 0)))  # not finite, infinite bound, continuous
    mark(is_con & (code == OTHER))
    same = lambda *keys: np.r_[False, np.all([k[1:] == k[:-1] for k in (of, kind, *keys)], axis=0)]
    mark((is_var & same(var)) | (is_con & same(con)) | (is_coef & same(var, con)))
    # Entries of variables that have no row of their own: the variable's row comes first in its group.
    group = np.cumsum(first | np.r_[True, var[1:] != var[:-1]]) - 1
    mark(is_coef & ~(np.bincount(group[is_var], minlength=group[-1] + 1) > 0)[group])
    # Entries of constraints that have no row.
    wide = int(con.max()) + 2
    at_con = np.flatnonzero(is_con)
    key = of[at_con] * wide + con[at_con] + 1
    order = np.argsort(key, kind="stable")
    at_coef = np.flatnonzero(is_coef)
    wanted = of[at_coef] * wide + con[at_coef] + 1
    place = np.minimum(np.searchsorted(key[order], wanted), max(len(key) - 1, 0))
    mark(at_coef[key[order][place] != wanted] if len(key) else at_coef)
    owner = at_con[order][place] if len(key) else at_coef  # the constraint's row of each entry
    if sense is None:
        told = kind == SENSE
        mark(told & ((code < 0) | (code == OTHER)))
        bad |= np.bincount(of[told], minlength=n) != 1
        sign = np.ones(n)
        sign[of[told]] = np.where(code[told] == 1, -1.0, 1.0)
    else:
        sign = np.full(n, 1.0 if sense == "min" else -1.0)

    n_vars = np.bincount(of[is_var], minlength=n)
    there = n_vars > 0
    sound = there & ~bad
    # Sound problems only from here on; their numbers of variables and of rows ``a·x <= b``.
    at_var, at_con = np.flatnonzero(is_var & sound[of]), np.flatnonzero(is_con & sound[of])
    n_vars = np.where(sound, n_vars, 0)
    before = np.r_[0, np.cumsum(n_vars)]
    each = np.where(code[at_con] == EQ, 2, 1)
    n_rows = np.bincount(of[at_con], weights=each, minlength=n).astype(np.int64)
    first_row = np.r_[0, np.cumsum(n_rows)]
    row = np.zeros(len(pid), np.int64)
    row[at_con] = np.cumsum(each) - each - first_row[of[at_con]]  # a constraint's first row in its problem
    cells = n_vars * n_rows
    first_cell = np.r_[0, np.cumsum(cells)]
    a, b = np.zeros(first_cell[-1]), np.zeros(first_row[-1])
    number = np.cumsum(is_var & sound[of]) - 1  # of the variable whose group a row is in
    kept = sound[of[at_coef]]
    at_coef, its = at_coef[kept], owner[kept]
    p = of[at_coef]
    for second in (False, True):  # "<=" and ">=" have one row; "=" has ">=" and then "<="
        rows = at_con[code[at_con] == EQ] if second else at_con
        up = np.where((code[rows] == LE) | second, 1.0, -1.0)
        b[first_row[of[rows]] + row[rows] + second] = up * x[rows]
        use = code[its] == EQ if second else np.ones(len(its), bool)
        up = np.where((code[its[use]] == LE) | second, 1.0, -1.0)
        a[first_cell[p[use]] + (row[its[use]] + second) * n_vars[p[use]] + number[at_coef[use]] - before[p[use]]] = up * x[at_coef[use]]
    c = sign[of[at_var]] * z[at_var]
    lists = {"names": _lists(table.column("var").combine_chunks().take(pa.array(at_var)), n_vars), "c": _lists(c, n_vars),
             "vlb": _lists(_whole(np.ceil(x[at_var] - ROUND_EPS)), n_vars), "vub": _lists(_whole(np.floor(y[at_var] + ROUND_EPS)), n_vars),
             "a": _lists(a, cells), "b": _lists(b, n_rows)}
    lam = root_multipliers(*(lists[k] for k in ("c", "vlb", "vub", "a", "b"))) if method == "lagrangian" else _lists(np.zeros(first_row[-1]), n_rows)
    integral = np.bincount(of[at_var], weights=c != np.floor(c), minlength=n) == 0
    several = np.full(n, method == "lagrangian")
    out = pa.table({"problem_id": pa.array(ids), "bad": pa.array(bad), "sign": pa.array(sign), **lists, "int_obj": pa.array(integral), "lam": lam,
                    "single": pa.array(several & (n_rows == 1)), "several": pa.array(several & (n_rows > 1)),
                    "cells": pa.array(cells + 8 * n_vars + 3 * n_rows)}).cast(_FIELDS)
    return out.filter(pa.array(there))

