"""Linear text classifiers as keyed tables: naive Bayes, logistic regression and a squared-hinge SVM.

A model is a table ``term, idf, w`` with one weight per label, and one
intercept per label. Nothing as long as the vocabulary passes through the driver
or one task: texts are counted in blocks, the terms are dealt over parts, and a pass
takes numbers of the rows to the terms of each part and back (:mod:`tiles`). The
driver holds what there is per label. The two models without a closed form are fitted
until they converge, or with a given number of plain steps.

Cross-validation fits the models of all folds at once. They differ in the rows
they learn from, so a term has one idf for each of them, and a row one length
for each; arrays hold the values of all folds side by side, and every pass
serves all of them. Document frequencies are counted once by
fold: those of a model are the total less its own fold's.

Input frames have an id, ``text`` and ``label``; ids must be unique.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.functions.constants import FOLDS
from colloquy.operators import evaluate, split, tiles
from colloquy.operators.models import BAYES, LOGREG, MAX_ITER, MODELS, SVM, TOLERANCE
from colloquy.session import emptied, materialize

MIN_DF = 2
#: Full-gradient steps with momentum, for callers that do not ask for convergence.
STEPS = 8
#: No fold: the rows are learned from by every model.
ALL = -1


@dataclass(frozen=True)
class LinearModel:
    """``terms``: term, idf, w (one weight per label); ``bias``: one intercept per label."""

    terms: DataFrame
    labels: tuple[str, ...]
    bias: tuple[float, ...]
    #: What the weights are made from, where the model was just fitted.
    sums: tiles.Sums | None = field(default=None, compare=False, repr=False)


@dataclass(frozen=True)
class _Prepared:
    """Ids, labels and folds of the rows by block, the tiles of the terms and one row of numbers for each block."""

    heads: DataFrame
    tiled: tiles.Tiled
    state: DataFrame
    labels: tuple[str, ...]
    label_rows: dict[tuple[int, int], int]
    models: int

    @property
    def cells(self) -> list[tuple[int, int]]:
        """(model, label) in the order of all weight arrays."""
        return [(g, k) for g in range(self.models) for k in range(len(self.labels))]

    def rows(self, g: int, k: int | None = None) -> int:
        """Rows that model ``g`` learns from, of one label or all."""
        return sum(n for (fold, label), n in self.label_rows.items() if fold != g and k in (None, label))


# --- Texts as vectors ------------------------------------------------------------------------

def term_counts(df: DataFrame, text: str, *keep: Column) -> DataFrame:
    """The kept columns and ``terms``, an array of (term, tf): counted within the row, so nothing is shuffled."""
    tokens = F.sort_array(T.ngrams_1_2(T.model_tokens(F.coalesce(F.col(text), F.lit("")))))
    sorted_rows = df.select(*keep, tokens.alias("_t"))
    place = F.when(F.size("_t") > 0, F.sequence(F.lit(1), F.size("_t"))).otherwise(F.array().cast("array<int>"))
    first = F.filter(place, lambda i: (i == 1) | (F.element_at("_t", i) != F.get("_t", i - 2)))
    found = sorted_rows.withColumn("_first", first)
    terms = F.transform("_first", lambda i, n: F.struct(
        F.element_at("_t", i).alias("term"), (F.coalesce(F.get("_first", n + 1), F.size("_t") + 1) - i).alias("tf"),
    ))
    return found.withColumn("terms", terms).drop("_t", "_first")


def _prepare(rows: DataFrame, row_id: str, text: str, label: str, fold: Column, models: int, min_df: int, parts: int) -> _Prepared:
    learned = rows.where(F.col(label).isNotNull()).select(
        F.col(row_id).alias("row"), F.col(label).cast("string").alias("label"), fold.cast("int").alias("fold"), F.col(text).alias("text"))
    found = tiles.counted(learned, "text", "row", "label", "fold", parts, models, packed=True)
    stored = materialize(tiles.tiles(found, parts, models, min_df), "tiles", tiles.AT_ONCE)
    heads = stored.where("rows IS NOT NULL").select("block", "n", "rows", "labels", "folds", "copies")
    sizes = heads.select(F.inline(F.arrays_zip("labels", "folds", "copies"))).groupBy("folds", "labels").agg(F.sum("copies").alias("n")).collect()
    total = heads.agg(F.sum("n")).first()[0] or 0
    labels = tuple(sorted({r.labels for r in sizes}))
    label_rows = {(r.folds, labels.index(r.labels)): r.n for r in sizes}
    learning = [sum(n for (f, _), n in label_rows.items() if f != g) for g in range(models)]
    tiled = tiles.Tiled(stored.where("rows IS NULL"), parts, tuple(learning), total, min_df)
    state = materialize(tiles.rows_state(heads, tiled, labels, models), "rows", tiles.AT_ONCE)
    return _Prepared(heads, tiled, state, labels, label_rows, models)


# --- Fitting ---------------------------------------------------------------------------------

@dataclass(frozen=True)
class _Fitted:
    """What the rows of each block send to the terms in the end; the sums are weights, or, with ``mass``, class sums.

    Models that are fitted together share ``sent``: of the ``width`` numbers for
    each row and fold's model, those of this one begin at ``start``.
    """

    sent: DataFrame
    bias: list[float]
    width: int
    start: int = 0
    mass: list[float] | None = None


def _bayes(p: _Prepared) -> _Fitted:
    """Class sums in closed form, one added to each: log-probabilities are weights, log-priors intercepts."""
    models, labels, ddl = p.models, len(p.labels), "block long, n int, send binary"
    schema = tiles.schema_of(p.state.sparkSession, ddl)

    def send(head):
        b = tiles.Block(head, models, labels)
        return b.keep(schema, send=(b.learned * b.inverse)[:, :, None] * b.one_hot())

    sent = materialize(tiles.mapped(p.state, send, ddl), "class-rows", tiles.AT_ONCE)
    totals = materialize(tiles.class_sums(p.tiled, sent, labels), "class-sums", tiles.AT_ONCE)
    row = totals.agg(*[F.sum(F.col("total")[i]) for i in range(len(p.cells))]).first()
    sizes = [x or 0 for x in p.tiled.frame.agg(*[F.sum(F.col("sizes")[g]) for g in range(models)]).first()]
    mass, bias = [], []
    for i, (g, k) in enumerate(p.cells):
        mass.append(math.log((row[i] or 0.0) + sizes[g]) if sizes[g] else 0.0)
        own, every = p.rows(g, k), p.rows(g)
        bias.append(math.log(own / every) if own else -math.inf)
    return _Fitted(sent, bias, labels, mass=mass)


def _pulls(kind: str, b: tiles.Block, z: np.ndarray) -> np.ndarray:
    """How far each margin of a row is from what its label asks for; 0 where a model does not learn from the row."""
    right = b.one_hot()
    if kind == LOGREG:
        e = np.exp(z - z.max(axis=2, keepdims=True))
        pull = e / e.sum(axis=2, keepdims=True) - right
    else:
        side = 2.0 * right - 1.0
        pull = -2.0 * side * np.maximum(0.0, 1.0 - side * z)
    return pull * b.learned[:, :, None]


def _curvature(p: _Prepared) -> list[float]:
    """For each model, a bound on the largest eigenvalue of its rows' mean outer product.

    Components are not negative, so no eigenvalue exceeds the largest row sum of the mean
    products between rows: the largest product of a row with the mean row.
    """
    models, labels = p.models, len(p.labels)
    n = np.array([max(p.rows(g), 1) for g in range(models)])
    ddl, most_ddl = "block long, n int, send binary", "most array<double>"
    schema, most_schema = (tiles.schema_of(p.state.sparkSession, x) for x in (ddl, most_ddl))

    def send(head):
        b = tiles.Block(head, models, labels)
        return b.keep(schema, send=b.learned * b.inverse / n)

    def most(head, total):
        b = tiles.Block(head, models, labels)
        return b.keep(most_schema, most=pa.array([b.shared(b.unit(total, 1)[:, :, 0] * b.learned).max(axis=0)]))

    partial = tiles.margins(p.tiled, tiles.mapped(p.state, send, ddl), 1)
    products = materialize(tiles.per_block(p.state, partial, most, most_ddl), "products", tiles.AT_ONCE)
    emptied(p.state.sparkSession, partial)
    found = products.agg(*[F.max(F.col("most")[g]) for g in range(models)]).first()
    return [x or 1.0 for x in found]


def _descend(kinds: Sequence[str], p: _Prepared, steps: int, curvature: Sequence[float]) -> list[_Fitted]:
    """Full-gradient steps of fixed length with momentum on the mean loss plus ``|w|^2 / 2n``, which is unit cost.

    The logistic loss bends by a half at most, the squared hinge by 2. Twice that, for weights and
    intercepts move together, times the ``curvature`` bounds the step of the weights, times 1 that
    of the intercepts. The intercept of the SVM is penalized like a weight, the other's is free.
    All weights begin at 0, so they are sums of rows: a number for each row and cell is all that is
    kept between the steps, and weights exist only within a pass. The ``kinds`` take their steps
    side by side, so a pass over the tiles serves all of them.
    """
    models, labels = p.models, len(p.labels)
    width = len(kinds) * labels
    grid = (models, width)
    cells = [(g, kind) for g in range(models) for kind in kinds for _ in range(labels)]
    n = [max(p.rows(g), 1) for g, _ in cells]
    bend = [1.0 if kind == LOGREG else 4.0 for _, kind in cells]
    length = [1.0 / (b * curvature[g] + 1.0 / rows) for (g, _), b, rows in zip(cells, bend, n)]
    bias_length = [1.0 / (b + 1.0 / rows) for b, rows in zip(bend, n)]
    bias_shrink = [1.0 if kind == LOGREG else 1.0 - step / rows for (_, kind), step, rows in zip(cells, bias_length, n)]
    pace = np.array([step / rows for step, rows in zip(length, n)]).reshape(grid)
    size = len(cells)
    bias, ahead = [0.0] * size, [0.0] * size
    ddl = "block long, n int, y binary, fold binary, run binary, norm binary, w binary, v binary, send binary, sums array<double>"
    schema = tiles.schema_of(p.state.sparkSession, ddl)
    none = F.lit(None).cast("binary")
    state = p.state.select("*", none.alias("w"), none.alias("v"), none.alias("send"), F.lit(None).cast("array<double>").alias("sums"))
    partial = tiles.Partial([])
    for step in range(steps):
        keep, start = step / (step + 3.0), np.array(ahead).reshape(grid)

        def move(head, total, keep=keep, start=start, last=step == steps - 1):
            b = tiles.Block(head, models, labels)
            z = b.unit(total, width) + start
            pull = np.concatenate([_pulls(kind, b, z[:, :, i * labels:(i + 1) * labels]) for i, kind in enumerate(kinds)], axis=2)
            old, v = b.cells("w", width), b.cells("v", width)
            new = v * (1.0 - pace) - b.shared(pull) * pace
            v = new + keep * (new - old)
            send = (new if last else v) * b.inverse[:, :, None]
            return b.keep(schema, w=new, v=v, send=send, sums=pa.array([pull.sum(axis=0).ravel()]))

        before, state = state, materialize(tiles.per_block(state.drop("send", "sums"), partial, move, ddl), "steps", tiles.AT_ONCE)
        emptied(p.state.sparkSession, before, partial)
        sums = state.agg(*[F.sum(F.col("sums")[i]) for i in range(size)]).first()
        partial = tiles.margins(p.tiled, state, width)
        new = [b * bias_shrink[i] - (sums[i] or 0.0) * bias_length[i] / n[i] for i, b in enumerate(ahead)]
        ahead = [b + keep * (b - old) for b, old in zip(new, bias)]
        bias = new
    sent, final = state.select("block", "n", "send"), np.array(bias).reshape(grid)
    return [_Fitted(sent, final[:, i:i + labels].ravel().tolist(), width, i) for i in range(0, width, labels)]


def _converge(kinds: Sequence[str], p: _Prepared, tolerance: float = TOLERANCE, most: int = MAX_ITER) -> list[_Fitted]:
    """Conjugate gradients on the summed loss plus ``|w|^2 / 2``, until each gradient is ``tolerance`` of what it was at 0.

    The loss and the treatment of the intercepts are those of :func:`_descend`. A logistic model is
    one problem, for the SVM each label is one. As there, weights are sums of rows: a point ``a``,
    a direction ``d`` and a gradient ``r`` are a number for each row and cell, ``z``, ``u`` and
    ``q`` their products with all rows. A pass gives ``q``; scalar products, and with them the length
    of a move, need the rows alone. The directions are Polak and Ribiere's, a move is a Newton step along
    the direction, shortened where the slope at its end is steeper than at its start.
    """
    models, labels = p.models, len(p.labels)
    width = len(kinds) * labels
    grid, size = (models, width), models * width
    penal = np.tile(np.repeat([0.0 if kind == LOGREG else 1.0 for kind in kinds], labels), models)
    problem = np.array([(g * len(kinds) + i) * labels + (0 if kind == LOGREG else k)
                        for g in range(models) for i, kind in enumerate(kinds) for k in range(labels)])
    ddl = "block long, n int, y binary, fold binary, run binary, norm binary, a binary, z binary, d binary, u binary, q binary, sums array<double>"
    schema, spark = tiles.schema_of(p.state.sparkSession, ddl), p.state.sparkSession
    send_ddl, slope_ddl = "block long, n int, send binary", "sums array<double>"
    send_schema, slope_schema = tiles.schema_of(spark, send_ddl), tiles.schema_of(spark, slope_ddl)
    none = [F.lit(None).cast("binary").alias(c) for c in "azduq"]
    state = p.state.select("*", *none, F.lit(None).cast("array<double>").alias("sums"))
    bias, turn, mixed, pace = (np.zeros(size) for _ in range(4))

    def whole(values: np.ndarray) -> np.ndarray:
        """Sums of the cells of each problem, for each of its cells."""
        return np.bincount(problem, values, size)[problem]

    def point(b: tiles.Block, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which rows the models learn from, the margins there, the pull of the loss and the gradient."""
        learned = (b.learned & (b.run >= 0)[:, None])[:, :, None]
        z = b.cells("z", width) + bias.reshape(grid)
        pull = learned * np.concatenate([_pulls(kind, b, z[:, :, i * labels:(i + 1) * labels]) for i, kind in enumerate(kinds)], axis=2)
        return learned, z, pull, b.cells("a", width) + pull

    def moved(head: pa.RecordBatch, bias: np.ndarray, mixed: np.ndarray, pace: np.ndarray) -> tuple[tiles.Block, np.ndarray, np.ndarray]:
        b = tiles.Block(head, models, labels)
        d = mixed.reshape(grid) * b.cells("d", width) - point(b, bias)[3]
        u = mixed.reshape(grid) * b.cells("u", width) - b.cells("q", width)
        return b, d, u

    def after(head: pa.RecordBatch, bias, mixed, pace) -> tuple[tiles.Block, np.ndarray, np.ndarray]:
        """The block at the end of the move, with the direction."""
        b, d, u = moved(head, bias, mixed, pace)
        far = pace.reshape(grid)
        return tiles.Block(b.keep(schema, a=b.cells("a", width) + far * d, z=b.cells("z", width) + far * u, q=b.cells("q", width)), models, labels), d, u

    def slopes(far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and second derivative along the direction, ``far`` along it."""
        def work(head, bias=bias, mixed=mixed, turn=turn, far=far):
            b, d, u = moved(head, bias, mixed, far)
            learned, z, _, _ = point(b, bias)
            a, s, at = b.cells("a", width), learned * (u + turn.reshape(grid)), far.reshape(grid)
            z = z + at * s
            first, second = (a + at * d) * u, d * u
            for i, kind in enumerate(kinds):
                own = slice(i * labels, (i + 1) * labels)
                first[:, :, own] += learned * _pulls(kind, b, z[:, :, own]) * s[:, :, own]
                if kind == LOGREG:
                    e = np.exp(z[:, :, own] - z[:, :, own].max(axis=2, keepdims=True))
                    share = e / e.sum(axis=2, keepdims=True) * s[:, :, own]
                    second[:, :, own] += share * (s[:, :, own] - share.sum(axis=2, keepdims=True))
                else:
                    inside = (2.0 * b.one_hot() - 1.0) * z[:, :, own] < 1.0
                    second[:, :, own] += 2.0 * inside * s[:, :, own] ** 2
            return b.keep(slope_schema, sums=pa.array([np.concatenate([x.sum(axis=0).ravel() for x in (first, second)])]))

        first, second = _added(tiles.mapped(state, work, slope_ddl), 2, size)
        return whole(first + penal * (bias + far * turn) * turn), whole(second + penal * turn ** 2)

    for step in range(most):
        def send(head, bias=bias, ahead=bias + pace * turn, mixed=mixed, pace=pace):
            b = after(head, bias, mixed, pace)[0]
            return b.keep(send_schema, send=point(b, ahead)[3] * b.inverse[:, :, None])

        def arrive(head, total, bias=bias, ahead=bias + pace * turn, mixed=mixed, pace=pace):
            b, d, u = after(head, bias, mixed, pace)
            learned, _, pull, r = point(b, ahead)
            q = learned * b.unit(total, width)
            sums = [(x).sum(axis=0).ravel() for x in (r * q, r * b.cells("q", width), pull)]
            return b.keep(schema, d=d, u=learned * u, q=q, sums=pa.array([np.concatenate(sums)]))

        partial = tiles.margins(p.tiled, tiles.mapped(state, send, send_ddl), width)
        before, state = state, materialize(tiles.per_block(state.drop("sums"), partial, arrive, ddl), "steps", tiles.AT_ONCE)
        emptied(spark, before, partial)
        bias = bias + pace * turn
        own, cross, pull = _added(state, 3, size)
        slope = pull + penal * bias
        squares = whole(own + slope ** 2)
        if not step:
            aim = tolerance ** 2 * squares
        live = squares > aim
        if not live.any():
            break
        mixed = np.maximum(0.0, (squares - whole(cross + slope * gone)) / last) if step else np.zeros(size)
        turn = mixed * turn - slope
        down, bend = slopes(np.zeros(size))
        if (live & (down >= 0)).any():  # not downhill: begin anew with the gradient
            mixed = np.where(down < 0, mixed, 0.0)
            turn = np.where(down < 0, turn, -slope)
            down, bend = slopes(np.zeros(size))
        pace = np.where(live, -down / np.where(live, bend, 1.0), 0.0)
        end = slopes(pace)[0]
        steep = live & (end > -down)
        pace = np.where(steep, pace * down / np.where(steep, down - end, 1.0), pace)
        gone, last = slope, np.where(squares > 0, squares, 1.0)
    sent = materialize(tiles.mapped(state, lambda head: _sent(head, models, labels, width, send_schema), send_ddl), "sent", tiles.AT_ONCE)
    emptied(spark, state)
    final = bias.reshape(grid)
    return [_Fitted(sent, final[:, i:i + labels].ravel().tolist(), width, i) for i in range(0, width, labels)]


def _sent(head: pa.RecordBatch, models: int, labels: int, width: int, schema: pa.Schema) -> pa.RecordBatch:
    b = tiles.Block(head, models, labels)
    return b.keep(schema, send=b.cells("a", width) * b.inverse[:, :, None])


def _added(blocks: DataFrame, kinds: int, size: int) -> np.ndarray:
    """The ``sums`` of all blocks, ``size`` of each kind."""
    row = blocks.agg(*[F.sum(F.col("sums")[i]) for i in range(kinds * size)]).first()
    return np.array([x or 0.0 for x in row]).reshape(kinds, size)


def _checked(names: Sequence[str]) -> None:
    if unknown := set(names) - set(MODELS):
        raise ValueError(f"unknown models {sorted(unknown)}")


def _fitted(names: Sequence[str], p: _Prepared, steps: int | None) -> list[tuple[tuple[str, ...], list[_Fitted]]]:
    """The models by name, those that share what their rows send together."""
    stepped = tuple(name for name in dict.fromkeys(names) if name != BAYES)
    groups = []
    if stepped:
        groups.append((stepped, _converge(stepped, p) if steps is None else _descend(stepped, p, steps, _curvature(p))))
    return groups + ([((BAYES,), [_bayes(p)])] if BAYES in names else [])


def fit_models(
    train: DataFrame, names: Sequence[str] = MODELS, steps: int | None = None, min_df: int = MIN_DF,
    row_id: str = "doc_id", text: str = "text", label: str = "label",
) -> dict[str, LinearModel]:
    """The named models, fitted on the same vectors of all labelled rows until they converge, or with so many ``steps``.

    Terms of fewer than ``min_df`` rows are left out. Rows without a known term
    count in the priors and sizes and move no weight.
    """
    _checked(names)
    p = _prepare(train, row_id, text, label, F.lit(ALL), 1, min_df, tiles.parts_of(train, text))
    fitted = {}
    if not p.labels:
        none = train.sparkSession.createDataFrame([], "term string, idf double, w array<double>")
        return {name: LinearModel(none, (), ()) for name in names}
    for group, found in _fitted(names, p, steps):
        for name, one in zip(group, found):
            sums = tiles.Sums(p.tiled, one.sent, one.width, one.start, len(p.labels), None if one.mass is None else tuple(one.mass))
            fitted[name] = LinearModel(tiles.weights(sums), p.labels, tuple(one.bias), sums)
    return {name: fitted[name] for name in names}


def fit(train: DataFrame, name: str = BAYES, **settings) -> LinearModel:
    return fit_models(train, [name], **settings)[name]


# --- Scoring ---------------------------------------------------------------------------------

def _decided(labels: Sequence[str], margins: list[Column]) -> tuple[Column, Column]:
    """Best label (the first on ties, after rounding to ten digits) and its share of the softmax of all margins."""
    scores = F.array(*margins)
    rounded = F.transform(scores, lambda m: F.round(m, 10))
    pred = F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position(rounded, F.array_max(rounded)).cast("int"))
    top = F.array_max(scores)
    return pred, 1.0 / F.aggregate(scores, F.lit(0.0), lambda acc, m: acc + F.exp(m - top))


def predict(model: LinearModel, df: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add ``pred`` and ``confidence`` to the rows.

    The confidence is the largest softmax of the margins: the probability for Bayes and
    the logistic model, a measure of uncertainty for the SVM. Texts without a
    known term are decided by the intercepts; a model without labels gives nulls.
    """
    if not model.labels:
        return df.withColumns({"pred": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    rows = df.select(F.col(row_id).alias("row"), F.col(text).alias("text"), F.lit("").alias("label"), F.lit(ALL).alias("fold"))
    if model.sums is not None:
        found = tiles.counted(rows, "text", "row", "label", "fold", model.sums.tiled.parts, packed=True)
        products = materialize(tiles.model_products(found, model.sums), "scores", tiles.AT_ONCE)
    else:
        parts = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        products = tiles.products(tiles.counted(rows, "text", "row", "label", "fold", parts), model.terms, parts, len(model.labels))
    sums = products.where(F.col("norm") > 0).select(
        F.col("row").alias("_row"), F.col("norm").alias("_norm"), *[F.col("m")[k].alias(f"_m{k}") for k in range(len(model.labels))]
    )
    margins = [F.coalesce(F.col(f"_m{k}") / F.col("_norm"), F.lit(0.0)) + F.lit(b) for k, b in enumerate(model.bias)]
    pred, confidence = _decided(model.labels, margins)
    columns = [df[c] for c in df.columns if c not in ("pred", "confidence")]
    return df.join(sums, df[row_id] == sums["_row"], "left").select(*columns, pred.alias("pred"), confidence.alias("confidence"))


def scorer(model: LinearModel, row_id: str = "message_id", text: str = "message") -> Callable[[DataFrame], DataFrame]:
    """A function that adds ``emotion`` and ``confidence`` to message rows."""
    def apply(df: DataFrame) -> DataFrame:
        keep = [c for c in df.columns if c not in ("emotion", "confidence")]
        return predict(model, df.select(*keep), row_id, text).withColumnRenamed("pred", "emotion")

    return apply


# --- Cross-validation ------------------------------------------------------------------------

def cross_predict(
    train: DataFrame, names: Sequence[str] = MODELS, folds: int = FOLDS, steps: int | None = None, min_df: int = MIN_DF,
) -> DataFrame:
    """``model, fold, row, label, pred``: each row judged by the models that have not seen its fold.

    Vocabulary and weights of a fold's model come from the other folds alone.
    """
    _checked(names)
    dealt = split.stratified_folds(train, folds=folds)
    p = _prepare(dealt, "doc_id", "text", "label", F.col("fold"), folds, min_df, tiles.parts_of(train, "text"))
    size, models = len(p.labels), p.models
    heads = p.heads.drop("n")
    if not size:
        none = heads.select(F.inline(F.arrays_zip("rows", "labels", "folds")))
        return none.select(F.lit(None).cast("string").alias("model"), F.col("folds").alias("fold"), F.col("rows").alias("row"),
                           F.col("labels").alias("label"), F.col("labels").alias("pred"))
    row_type = heads.schema["rows"].dataType.elementType.simpleString()
    ddl = f"fold int, row {row_type}, label string, copies int, m array<double>"
    schema = tiles.schema_of(train.sparkSession, ddl)

    parts = []
    for group, found in _fitted(names, p, steps):
        width = len(group) * size

        def judge(head, total, width=width):
            b = tiles.Block(head, models, size)
            own = b.shared(b.unit(total, width)[np.arange(b.n), b.fold])
            flat = {k: head.column(f"{k}s" if k != "copies" else k).flatten() for k in ("row", "label", "fold", "copies")}
            return tiles.listed(schema, own, "m", **flat)

        partial = tiles.margins(p.tiled, found[0].sent, width, found[0].mass)
        judged = tiles.per_block(heads.join(p.state, "block"), partial, judge, ddl)
        judged = judged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        preds = []
        for name, one in zip(group, found):
            starts = F.array(*[F.lit(b) for b in one.bias])
            margins = [F.col("m")[one.start + k] + F.get(starts, F.col("fold") * size + k) for k in range(size)]
            preds.append(F.struct(F.lit(name).alias("model"), _decided(p.labels, margins)[0].alias("pred")))
        parts.append(judged.select("fold", "row", "label", F.inline(F.array(*preds))).select("model", "fold", "row", "label", "pred"))
    return reduce(DataFrame.unionByName, parts)


def cross_validate(train: DataFrame, names: Sequence[str] = MODELS, folds: int = FOLDS, steps: int | None = None) -> DataFrame:
    """Unrounded metrics per model and fold."""
    preds = materialize(cross_predict(train, names, folds, steps), "fold-predictions")
    return materialize(evaluate.overall_metrics(preds, ["model", "fold"], digits=None), "fold-metrics")
