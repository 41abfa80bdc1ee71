"""Models of every entity at once: least squares, rising effects, quantiles and cross-validation.

All fits rest on cross products of standardised inputs, which tasks add up for their own rows and Spark adds up element by element. So one pass over
the table serves all entities, an entity of any size is never gathered, and what is solved has a fixed size per entity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window as W

from wardcast.functions.fixed import literal
from wardcast.operators.ordering import group_cuts, tie_key
from wardcast.session import via_table

#: Numbers of partial sums a task holds at once, before they leave for the shuffle.
HELD_NUMBERS = 4_000_000
#: Numbers of a block of packed rows, and blocks taken at once.
BLOCK_NUMBERS, AT_ONCE = 2048, 200
#: A column counts as a combination of earlier ones if less than this part of its square is left without them.
INDEPENDENT = 1e-9
#: Quantile fits: smoothing at the start, its factor per pass and its end, and the distance that counts as on the fit, in deviations of the target; passes at most.
SMOOTH, SHARPEN, SHARP, ON_FIT, PASSES = 1e-2, 0.6, 1e-5, 2e-4, 60


def _double(c: str) -> Column:
    return F.col(c).cast("double")


def scales(df: DataFrame, inputs: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each input over the table, 0 and 1 for columns without values or spread."""
    cells = []
    for c in inputs:
        x = F.when(~F.isnan(_double(c)), _double(c))
        # the deviation of a constant is not always exactly 0 when tasks add up
        cells += [F.avg(x), F.when(F.min(x) < F.max(x), F.stddev_pop(x))]
    row = df.agg(*cells).first()
    mean = np.array([v if v is not None and np.isfinite(v) else 0.0 for v in row[::2]])
    std = np.array([v if v and np.isfinite(v) else 1.0 for v in row[1::2]])
    return mean, std


def summed(df: DataFrame, by: Sequence[str], numbers: Sequence[str], each: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> DataFrame:
    """``by, j, c0, c1, ...``: the sums, per group, of the matrices (``shape``) that ``each`` makes of the group's rows in one batch (columns ``numbers``, nulls as NaN).

    Each task holds the sums of the groups it has met; they leave when they are many, since sums of sums are sums.
    """
    by, held, out = list(by), max(1, HELD_NUMBERS // (shape[0] * shape[1])), _partial_sums(df, by, shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            keys = list(zip(*(batch.column(b).to_pylist() for b in by)))
            codes, found = pd.factorize(np.fromiter(keys, object, len(keys)))
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in numbers]).astype(float)
            order = np.argsort(codes, kind="stable")
            edges = np.searchsorted(codes[order], np.arange(len(found) + 1))
            for i, key in enumerate(found):
                part = each(x[order[edges[i]:edges[i + 1]]])
                sums[key] = sums[key] + part if key in sums else part
            if len(sums) > held:
                yield out(sums)
                sums = {}
        if sums:
            yield out(sums)

    rows = df.select(*by, *[_double(c).alias(c) for c in numbers]).mapInArrow(run, _sum_schema(df, by, shape))
    return _added(rows, by, shape)


def _partial_sums(df: DataFrame, by: list[str], shape: tuple[int, int]) -> Callable[[dict[tuple, np.ndarray]], pa.RecordBatch]:
    """A function that makes rows ``by, j, c0, c1, ...`` of a task's sums."""
    kinds = [to_arrow_type(df.schema[b].dataType) for b in by]

    def out(sums: dict[tuple, np.ndarray]) -> pa.RecordBatch:
        keys = [pa.array([k[i] for k in sums for _ in range(shape[0])], kind) for i, kind in enumerate(kinds)]
        values = np.concatenate(list(sums.values()))
        place = pa.array(np.tile(np.arange(shape[0], dtype=np.int32), len(sums)))
        return pa.record_batch([*keys, place, *(pa.array(values[:, i]) for i in range(shape[1]))], names=[*by, "j", *(f"c{i}" for i in range(shape[1]))])

    return out


def _sum_schema(df: DataFrame, by: list[str], shape: tuple[int, int]) -> T.StructType:
    return T.StructType([T.StructField(b, df.schema[b].dataType) for b in by] + [T.StructField("j", T.IntegerType())] + [T.StructField(f"c{i}", T.DoubleType()) for i in range(shape[1])])


def _added(rows: DataFrame, by: list[str], shape: tuple[int, int]) -> DataFrame:
    return rows.groupBy(*by, "j").agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(shape[1])))


def packed(df: DataFrame, by: str, numbers: Sequence[str], mean: np.ndarray, std: np.ndarray) -> DataFrame:
    """``by, rows``: all complete rows of a group, standardised, as stored blocks of ``BLOCK_NUMBERS`` doubles. Passes then move and convert blocks, not cells."""
    kind, size = to_arrow_type(df.schema[by].dataType), max(1, BLOCK_NUMBERS // len(numbers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict[object, np.ndarray] = {}

        def out(parts: list[tuple[object, np.ndarray]]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([k for k, _ in parts], kind), pa.array([z.tobytes() for _, z in parts], pa.binary())], names=[by, "rows"])

        for batch in batches:
            codes, found = pd.factorize(np.fromiter(((k,) for k in batch.column(by).to_pylist()), object, batch.num_rows))
            x = (np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in numbers]).astype(float) - mean) / std
            parts, own = [], np.flatnonzero(~np.isnan(x).any(1))
            own = own[np.argsort(codes[own], kind="stable")]
            edges = np.searchsorted(codes[own], np.arange(len(found) + 1))
            for i, (key,) in enumerate(found):
                z = x[own[edges[i]:edges[i + 1]]]
                z = np.concatenate((rest.pop(key), z)) if key in rest else z
                full = len(z) // size * size
                parts += [(key, z[j:j + size]) for j in range(0, full, size)]
                if full < len(z):
                    rest[key] = z[full:]
            if sum(map(len, rest.values())) * len(numbers) > HELD_NUMBERS:
                parts += rest.items()
                rest = {}
            if parts:
                yield out(parts)
        if rest:
            yield out(list(rest.items()))

    rows = df.select(by, *[_double(c).alias(c) for c in numbers]).mapInArrow(run, T.StructType([T.StructField(by, df.schema[by].dataType), T.StructField("rows", T.BinaryType())]))
    return via_table(rows, "packed")


def summed_blocks(df: DataFrame, by: str, columns: int, beside: str, each: Callable[[np.ndarray, dict], np.ndarray], shape: tuple[int, int]) -> DataFrame:
    """As ``summed``, of ``packed`` rows: ``each`` gets many blocks of one group at once and the struct ``beside`` of that group."""
    held, out = max(1, HELD_NUMBERS // (shape[0] * shape[1])), _partial_sums(df, [by], shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            places: dict[object, list[int]] = {}
            for i, key in enumerate(batch.column(by).to_pylist()):
                places.setdefault(key, []).append(i)
            blocks, states = batch.column("rows"), batch.column(beside)
            for key, own in places.items():
                state = states[own[0]].as_py()
                for i in range(0, len(own), AT_ONCE):
                    part = each(np.frombuffer(b"".join(blocks[j].as_py() for j in own[i:i + AT_ONCE])).reshape(-1, columns), state)
                    sums[key,] = sums[key,] + part if (key,) in sums else part
            if len(sums) > held:
                yield out(sums)
                sums = {}
        if sums:
            yield out(sums)

    return _added(df.select(by, "rows", beside).mapInArrow(run, _sum_schema(df, [by], shape)), [by], shape)


def _as_matrix(df: DataFrame, by: Sequence[str], width: int) -> DataFrame:
    """One row per group: ``m``, the rows of its matrix in order."""
    cells = F.array(*(F.col(f"c{i}") for i in range(width)))
    return df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", cells.alias("v")))), lambda r: r["v"]).alias("m"))


def _cross(mean: np.ndarray, std: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Cross products of (1, inputs, target), standardised; one more row counts those rows left out for a missing value."""
    def each(x: np.ndarray) -> np.ndarray:
        whole = ~np.isnan(x).any(1)
        z = np.column_stack([np.ones(int(whole.sum())), (x[whole] - mean) / std])
        last = np.zeros((1, z.shape[1]))
        last[0, 0] = (~whole).sum()
        return np.vstack([z.T @ z, last])

    return each


def independent(gram: np.ndarray, order: Sequence[int]) -> list[int]:
    """Of the columns in the given order, those that are no combination of the ones before."""
    kept: list[int] = []
    factor = np.zeros((0, 0))
    for j in order:
        own = gram[j, j]
        if own <= 0:
            continue
        row = np.linalg.solve(factor, gram[kept, j]) if kept else np.zeros(0)
        left = own - row @ row
        if left > INDEPENDENT * own:
            grown = np.zeros((len(kept) + 1,) * 2)
            grown[:-1, :-1], grown[-1, :-1], grown[-1, -1] = factor, row, np.sqrt(left)
            factor = grown
            kept.append(j)
    return kept


def solved(gram: np.ndarray, moment: np.ndarray, rising: Sequence[int] = ()) -> np.ndarray:
    """Least squares from cross products; columns that are combinations of earlier ones get 0.

    Coefficients of ``rising`` columns are at least 0: an active set of them enters one by one, that of the largest gradient first, and leaves
    where a step would take it below 0.
    """
    bound = set(rising)
    free = [j for j in range(len(moment)) if j not in bound]
    inside: list[int] = independent(gram, free)
    b = np.zeros(len(moment))

    def best(columns: list[int]) -> np.ndarray:
        out = np.zeros(len(moment))
        if columns:
            part = gram[np.ix_(columns, columns)]
            out[columns] = np.linalg.solve(part, moment[columns])
            out[columns] += np.linalg.solve(part, moment[columns] - part @ out[columns])
        return out

    b = best(inside)
    tolerance = 1e-10 * np.sqrt(np.maximum(np.diag(gram), 1e-300)) * max(1.0, float(np.sqrt(np.abs(moment).max(initial=0.0))))
    refused: set[int] = set()
    for _ in range(10 * len(bound) + 1):
        gradient = moment - gram @ b
        waiting = [j for j in bound if j not in inside and j not in refused and gradient[j] > tolerance[j]]
        if not waiting:
            break
        enter = max(waiting, key=lambda j: gradient[j] / np.sqrt(gram[j, j]))
        if enter not in independent(gram, [*inside, enter]):
            refused.add(enter)
            continue
        inside.append(enter)
        while True:
            goal = best(inside)
            low = [j for j in inside if j in bound and goal[j] <= 0]
            if not low:
                b = goal
                break
            part, leave = min((b[j] / (b[j] - goal[j]) if b[j] > goal[j] else 0.0, j) for j in low)
            b = b + part * (goal - b)
            b[leave] = 0.0
            inside.remove(leave)
            refused = set()
    return b


SOLUTION = "n_rows bigint, n_left_out bigint, status string, error string, intercept double, coefficients array<double>"


def _solver(mean: np.ndarray, std: np.ndarray, least: int, rising: Sequence[int], ridge: float = 0.0):
    """A function from standardised cross products to the solution in the inputs' own units."""
    def one(rows) -> tuple:
        m = np.array([list(r) for r in rows], float)
        cross, left = m[:-1], int(m[-1, 0])
        n = int(round(cross[0, 0]))
        if n < least:
            return n, left, "error", f"needs {least} rows", None, None
        b = solved(cross[:-1, :-1] + ridge * np.eye(len(cross) - 1), cross[:-1, -1], rising)
        own = b[1:] / std[:-1] * std[-1]
        return n, left, "ok", None, float(b[0] * std[-1] + mean[-1] - own @ mean[:-1]), own.tolist()

    @F.pandas_udf(SOLUTION)
    def solve(crosses: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(rows) for rows in crosses], columns=["n_rows", "n_left_out", "status", "error", "intercept", "coefficients"])

    return solve


def least_squares(df: DataFrame, features: Sequence[str], label: str, by: str = "city", rising: Sequence[str] = (), minimum: int | None = None, ridge: float = 0.0) -> DataFrame:
    """Least squares per entity: ``by, n_rows, n_left_out, status, error, intercept, coefficients``.

    Effects of the features named in ``rising`` never fall below 0. Features that are combinations of earlier ones (constants too) get 0, which changes
    no prediction; of a rising and another one that are equal the other is used. An entity with fewer than ``minimum`` complete rows (by default one more than there are features) keeps a row with its error. ``n_left_out``
    counts rows with a missing value. Rows without an entity form one of their own; an empty table gives an empty result. The result is stored in
    the shared folder.
    """
    inputs = [*features, label]
    mean, std = scales(df, inputs)
    sums = summed(df, [by], inputs, _cross(mean, std), (len(inputs) + 2, len(inputs) + 1))
    places = [1 + features.index(c) for c in rising]
    least = len(features) + 1 if minimum is None else minimum
    solve = _solver(mean, std, least, places, ridge)
    # stored, the few rows have a known size: rows beside their fit then need no shuffle by entity, which would put a large entity in one task
    return via_table(_as_matrix(sums, [by], len(inputs) + 1).select(by, solve("m").alias("fit")).select(by, "fit.*"), "fits")


def _with_fits(df: DataFrame, fits: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows beside the fit of their entity; an entity that is null has its own."""
    renamed = fits.select(*(F.col(b).alias(f"__{b}") for b in by), *(c for c in fits.columns if c not in by))
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__{b}"))
    return df.join(renamed, same, "left").drop(*(f"__{b}" for b in by))


def _value(features: Sequence[str], intercept: str = "__intercept", coefficients: str = "__coefficients") -> Column:
    value = F.col(intercept)
    for i, c in enumerate(features):
        value = value + F.col(coefficients)[i] * _double(c)
    return value


def predict(df: DataFrame, fits: DataFrame, features: Sequence[str], by: str | Sequence[str] = "city", prediction: str = "median") -> DataFrame:
    """Score rows with the coefficients of their entity; entities without a fit get null."""
    by = [by] if isinstance(by, str) else list(by)
    few = fits.select(*by, F.col("intercept").alias("__intercept"), F.col("coefficients").alias("__coefficients"))
    return _with_fits(df, few, by).withColumn(prediction, _value(features)).drop("__intercept", "__coefficients")


def cross_validate(df: DataFrame, features: Sequence[str], label: str, by: str = "city", folds: int = 3, rising: Sequence[str] = (), entity: str = "hospital_id", time: str = "date") -> DataFrame:
    """Expanding time folds per entity: ``by, fold, n_train, n_validation, status, error, mae``.

    Of an entity's n rows in time order (ties by the md5 of ``entity``), fold i trains on all rows before its part and validates on the ``n // (folds + 1)`` rows of
    part i. Cross products are taken once per part; the training sums of a fold are those of the parts before it. So the inputs are read twice,
    for the sums and for the errors; finding the cuts reads the keys only. Rows with a missing value count in n, but neither train nor validate.
    """
    size = F.floor(F.col("n") / F.lit(folds + 1))
    cuts = via_table(group_cuts(df, by, [F.col("n") - F.lit(folds - i) * size for i in range(folds)], entity, time), "cuts")
    key = F.struct(F.col(time).alias("day"), tie_key(entity).alias("tie"), F.col(entity).alias("who"))
    part = F.size(F.filter(F.coalesce("__cuts", F.array().cast(cuts.schema["cuts"].dataType)), lambda c: c < key))
    parts = _with_fits(df, cuts.withColumnRenamed("cuts", "__cuts"), [by]).withColumn("__part", part.cast("int")).drop("__cuts")
    inputs = [*features, label]
    width = len(inputs) + 1
    mean, std = scales(df, inputs)
    sums = summed(parts, [by, "__part"], inputs, _cross(mean, std), (width + 1, width))
    before = W.partitionBy(by, "j").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    # parts that an entity has no rows in would be missing from the prefix
    full = sums.select(by, "j").distinct().withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(folds)))).alias("all")
    same = F.col(f"all.{by}").eqNullSafe(F.col(f"s.{by}")) & (F.col("all.j") == F.col("s.j")) & (F.col("all.__part") == F.col("s.__part"))
    dense = full.join(sums.alias("s"), same, "left").select(f"all.{by}", "all.j", "all.__part", *(F.coalesce(f"s.c{i}", F.lit(0.0)).alias(f"c{i}") for i in range(width)))
    train = dense.select(by, "j", "__part", *(F.sum(f"c{i}").over(before).alias(f"c{i}") for i in range(width))).where("__part > 0")
    solve = _solver(mean, std, len(features) + 1, [1 + list(features).index(c) for c in rising])
    fits = via_table(_as_matrix(train, [by, "__part"], width).select(by, "__part", solve("m").alias("fit")).select(by, "__part", "fit.*"), "fold-fits")
    scored = predict(parts.where("__part > 0"), fits, features, [by, "__part"], "__value")
    gap = F.abs(_double(label) - F.col("__value"))
    whole = F.lit(True)
    for c in inputs:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(_double(c))
    errors = scored.where(whole).groupBy(by, "__part").agg(F.count("*").alias("n_validation"), F.avg(gap).alias("mae"))
    out = _with_fits(fits, errors, [by, "__part"])
    return out.select(by, F.col("__part").alias("fold"), F.col("n_rows").alias("n_train"), F.coalesce("n_validation", F.lit(0).cast("bigint")).alias("n_validation"), "status", "error", "mae")


# Quantiles

STATE = ("n_rows bigint, n_left_out bigint, status string, error string, b array<double>, kept array<int>, ones array<double>, "
         "smooth double, loss double, gap double, passes int, done boolean")
STATE_NAMES = [c.split()[0] for c in STATE.split(", ")]


def quantile_fits(
    df: DataFrame, features: Sequence[str], label: str, by: str = "city", levels: Sequence[float] = (0.1, 0.5, 0.9), minimum: int | None = None, passes: int = PASSES
) -> DataFrame:
    """Linear quantile regression per entity and level: ``by, level, n_rows, n_left_out, status, error, intercept, coefficients, loss, gap, passes``.

    Iteratively reweighted least squares: a row weighs 1 / (smoothing + distance from the last fit), and the smoothing shrinks from pass to pass. A pass over the
    table, whose complete rows are stored once in blocks (``packed``), serves all entities and levels that have not converged; others leave it. ``gap`` is the largest amount, per row and in deviations, by
    which a subgradient condition is violated: for each input, its sum over rows, weighted level above the fit and level - 1 below, lies within what the
    rows on the fit (closer than ``ON_FIT`` deviations of the target) can bring. Converged fits have gap 0; those that have not after ``passes`` keep status
    ``slow`` and their last coefficients. ``loss`` is the mean pinball loss. Missing values, small entities and dependent features are treated as by ``least_squares``.
    """
    features, levels = list(features), [float(x) for x in levels]
    inputs = [*features, label]
    k = len(features) + 1
    mean, std = scales(df, inputs)
    least = k if minimum is None else minimum
    sums = summed(df, [by], inputs, _cross(mean, std), (k + 2, k + 1))
    kind = df.schema[by].dataType.simpleString()

    def first(rows) -> tuple:
        m = np.array([list(r) for r in rows], float)
        cross, left, n = m[:-1], int(m[-1, 0]), int(round(m[0, 0]))
        if n < least:
            return n, left, "error", f"needs {least} rows", None, None, None, None, None, None, 0, True
        gram, moment = cross[:-1, :-1], cross[:-1, -1]
        spread = float(np.sqrt(max(0.0, cross[-1, -1] / n - (moment[0] / n) ** 2)))
        if spread < 1e-9:  # a constant target
            return n, left, "ok", None, [moment[0] / n] + [0.0] * (k - 1), [0], gram[0].tolist(), 0.0, 0.0, 0.0, 0, True
        return n, left, "ok", None, solved(gram, moment).tolist(), independent(gram, range(k)), gram[0].tolist(), SMOOTH * spread, None, None, 0, False

    @F.pandas_udf(STATE)
    def begin(crosses: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([first(rows) for rows in crosses], columns=STATE_NAMES)

    start = _as_matrix(sums, [by], k + 1).select(by, begin("m").alias("s")).select(by, "s.*")
    state = via_table(start.withColumn("level", F.explode(F.array(*map(F.lit, levels)))), "quantile-state")

    def each(z: np.ndarray, state: dict) -> np.ndarray:
        """Per open level k + 1 rows: weighted cross products with the target, and per input the subgradient sum and what rows on the fit can bring; last the loss."""
        out = np.zeros((len(levels) * (k + 1), k + 3))
        inner, y = np.column_stack([np.ones(len(z)), z[:, :-1]]), z[:, -1]
        for i, level in enumerate(levels):
            own = state[f"s{i}"]
            if own is None:
                continue
            r = y - inner @ np.array(own["b"])
            # the target has deviation ``smooth / SMOOTH`` at the start; on the fit is what lies closer than ON_FIT of it
            near = np.abs(r) <= state["first_smooth"] * (ON_FIT / SMOOTH)
            w = 1 / (own["smooth"] + np.abs(r))
            block = out[i * (k + 1):(i + 1) * (k + 1)]
            block[:k, :k] = inner.T @ (inner * w[:, None])
            block[:k, k] = inner.T @ (w * y)
            block[:k, k + 1] = inner.T @ np.where(near, 0, np.where(r < 0, level - 1, level))
            block[:k, k + 2] = np.abs(inner[near]).sum(0) * max(level, 1 - level)
            block[k, 0] = np.maximum(level * r, (level - 1) * r).sum()
        return out

    def step(row) -> tuple:
        m = np.array([list(r) for r in row.m], float)
        b, kept, ones = np.array(row.b), list(row.kept), np.array(row.ones)
        gap = float(np.maximum(0.0, np.abs(m[kept, k + 1]) - m[kept, k + 2]).max() / row.n_rows)
        loss = float(m[k, 0] / row.n_rows)
        sharp = SHARP / SMOOTH * row.first_smooth
        done = gap <= 1e-9 and row.smooth <= 16 * sharp
        if not done:
            gram = m[:k, :k][np.ix_(kept, kept)]
            b = np.zeros(k)
            b[kept] = np.linalg.solve(gram, m[kept, k] + (2 * row.level - 1) * ones[kept])
        return b.tolist(), max(sharp, SHARPEN * row.smooth), loss, gap, row.passes + 1, done

    @F.pandas_udf("b array<double>, smooth double, loss double, gap double, passes int, done boolean")
    def advance(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([step(r) for r in rows.itertuples()], columns=["b", "smooth", "loss", "gap", "passes", "done"])

    spread = start.select(by, F.col("smooth").alias("first_smooth"))
    spread = via_table(spread, "quantile-spread")
    blocks = packed(df, by, inputs, mean, std)
    level = F.element_at(F.array(*map(F.lit, levels)), (F.floor(F.col("j") / (k + 1)) + 1).cast("int"))
    for _ in range(passes):
        if state.where("NOT done").isEmpty():
            break
        open_ = state.where("NOT done")
        per = open_.groupBy(by).agg(*(
            F.first(F.when(F.col("level") == F.lit(x), F.struct("b", "smooth")), ignorenulls=True).alias(f"s{i}") for i, x in enumerate(levels)))
        per = _with_fits(per, spread, [by])
        per = per.select(by, F.struct(*(c for c in per.columns if c != by)).alias("__state"))
        found = summed_blocks(_with_fits_inner(blocks, per, by), by, len(inputs), "__state", each, (len(levels) * (k + 1), k + 3))
        found = _as_matrix(found.withColumn("level", level), [by, "level"], k + 3)
        ready = _with_fits(_with_fits(open_, found, [by, "level"]), spread, [by])
        moved = ready.select(by, "level", *(c for c in STATE_NAMES if c not in ("b", "smooth", "loss", "gap", "passes", "done")),
                             advance(F.struct("m", "b", "kept", "ones", "n_rows", "first_smooth", "smooth", "level", "passes")).alias("next"))
        moved = moved.select(by, "level", *(F.col(f"next.{c}") if c in ("b", "smooth", "loss", "gap", "passes", "done") else F.col(c) for c in STATE_NAMES))
        state = via_table(state.where("done").select(by, "level", *STATE_NAMES).unionByName(moved), "quantile-state")
    own = F.transform(F.sequence(F.lit(1), F.lit(k - 1)), lambda j: F.get("b", j) * std[-1] / F.get(literal([float(x) for x in std], T.ArrayType(T.DoubleType())), j - 1))
    centre = F.aggregate(F.arrays_zip(F.col("coefficients").alias("c"), literal([float(x) for x in mean[:-1]], T.ArrayType(T.DoubleType())).alias("m")), F.lit(0.0), lambda t, x: t + x["c"] * x["m"])
    own = own if k > 1 else F.array().cast("array<double>")
    out = state.withColumn("coefficients", F.when(F.col("b").isNotNull(), own)).withColumn("intercept", F.get("b", F.lit(0)) * float(std[-1]) + float(mean[-1]) - centre)
    status = F.when((F.col("status") == "ok") & ~F.col("done"), "slow").otherwise(F.col("status"))
    return out.select(by, "level", "n_rows", "n_left_out", status.alias("status"), "error", "intercept", "coefficients", (F.col("loss") * float(std[-1])).alias("loss"), "gap", "passes")


def _with_fits_inner(df: DataFrame, fits: DataFrame, by: str) -> DataFrame:
    renamed = fits.withColumnRenamed(by, "__by")
    return df.join(renamed, F.col(by).eqNullSafe(F.col("__by")), "inner").drop("__by")
