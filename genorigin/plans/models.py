"""Model jobs: one network per group in parallel tasks, and prediction. (One network over many tasks is in ``wide``.)

Training tables have a row per sample: keys, sampleid, x (array of dosages), cx and cy (coordinates, null if unknown), role (train, val, pred, holdout) and, if
wanted, weight. Coordinates are normalised by the group's training rows inside the task and predictions are given in the original units.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genorigin.operators.ranks import ranked
from genorigin.operators.weights import first_weight

from .network import Fitted, Loss, Options, elu, fit, forward, loss_and_gradient, predict

Score = Callable[[np.ndarray], np.ndarray]
#: From the keys of a group and the number of sites, the sites (from 0, in any order, with repetitions) that its network sees.
Picks = Callable[[tuple, int], np.ndarray]
ROLES_PREDICTED = ("pred", "val", "holdout")


def training_table(features: DataFrame, samples: DataFrame, roles: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """features (keys..., sampleid, x) with coordinates and roles (sampleid, role and possibly some of the keys)."""
    shared = [c for c in roles.columns if c in features.columns]
    rows = features.join(roles, shared).join(samples.select("sampleid", F.col("x").alias("cx"), F.col("y").alias("cy")), "sampleid")
    if weights is None:
        return rows.withColumn("weight", F.lit(1.0))
    if roles.where("role = 'train'").join(weights, "sampleid", "left_anti").limit(1).count():
        raise ValueError("Some training samples have no weight")
    return rows.join(first_weight(weights).select("sampleid", F.col("sample_weight").alias("weight")), "sampleid", "left")


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack(rows.to_numpy()).astype(np.int8) if len(rows) else np.zeros((0, 0), np.int8)


class Rows:
    """Rows of a job as they come to its task, in batches: a byte for each site, coordinates (nan if unknown) and weights (0 if none)."""

    def __init__(self, many: int):
        self.many, self.n, self.x = many, 0, np.zeros((0, 0), np.int8)
        self.y, self.w = np.empty((many, 2)), np.empty(many)

    def add(self, batch: pa.RecordBatch) -> None:
        if not len(batch):
            return
        x = batch.column("x")
        x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
        if not self.n:
            self.x = np.empty((self.many, x.shape[1]), np.int8)
        at = slice(self.n, self.n + len(batch))
        self.x[at] = x
        for k, c in enumerate(("cx", "cy")):
            self.y[at, k] = batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
        w = batch.column("weight").cast(pa.float64()).to_numpy(zero_copy_only=False)
        self.w[at] = np.where(np.isnan(w), 0, w)
        self.n += len(batch)


def _moments(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sd = y.std(axis=0)
    return y.mean(axis=0), np.where(sd > 0, sd, 1.0)


def _fit_rows(train: Rows, val: Rows, o: Options, moments_from: str, score: Score | None, loss: Loss, at: np.ndarray | None) -> tuple[Fitted, np.ndarray, np.ndarray]:
    if not train.n:
        raise ValueError("A group has no training samples")
    known = np.concatenate([train.y, val.y])
    mean, sd = _moments(train.y if moments_from == "train" else known[~np.isnan(known[:, 0])])
    norm = lambda y: ((y - mean) / sd).astype(np.float32)
    xt, xv = train.x, val.x if val.n else np.zeros((0, train.x.shape[1]), np.int8)
    xt, xv = (xt, xv) if at is None else (xt[:, at], xv[:, at])
    return fit(xt, norm(train.y), xv, norm(val.y), o, None if (train.w == 1).all() else train.w, score=score and (lambda p: score(p * sd + mean)), loss=loss), mean, sd


def fit_predict_groups(
    table: DataFrame, keys: list[str], options: Options = Options(), moments_from: str = "train", score: Score | None = None, loss: Loss = loss_and_gradient, picks: Picks | None = None
) -> DataFrame:
    """Fit a network for every group and predict all its rows that are not training rows: keys, sampleid, role, x, y. Only training and validation rows meet in the group's task. The table is read several
    times: it should be a stored one, or unfold one."""
    models = fit_groups(table.where(F.col("role").isin("train", "val")), keys, options, moments_from, score, loss, picks)
    return predict_with(table.where(F.col("role").isin(*ROLES_PREDICTED)).select(*keys, "sampleid", "role", "x"), models, keys, options)


def one_task_each(table: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with __job, the number of their keys, and __train and __val, how many rows of these roles have them, dealt so that each number has a partition of its own, however few bytes they are: what is
    done with them is long."""
    counts = table.groupBy(*keys).agg(*[F.count_if(F.col("role") == r).alias(f"__{r}") for r in ("train", "val")])
    jobs = ranked(counts, *map(F.col, keys)).withColumnRenamed("r", "__job").drop("n")
    n = jobs.count()
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    rows = table.join(F.broadcast(jobs.withColumnsRenamed({k: f"__{k}" for k in keys})), same).drop(*[f"__{k}" for k in keys])  # a row for each job
    return rows.repartitionById(max(1, n), F.col("__job").cast("int"))


HISTORY = pa.list_(pa.struct([("epoch", pa.int32()), *[(c, pa.float64()) for c in ("loss", "val_loss", "lr")]]))


def fit_groups(
    table: DataFrame, keys: list[str], options: Options = Options(), moments_from: str = "train", score: Score | None = None, loss: Loss = loss_and_gradient, picks: Picks | None = None
) -> DataFrame:
    """The fitted models: keys, model (binary) and history, an array of (epoch, loss, val_loss, lr). score: a term of the validation loss by predicted places, such as
    ``ranges.range_score``; loss: the training loss, see ``network.Loss``; picks: the sites that a group's network sees, by default all.

    Spark sorts the rows of a job by sample; its task takes them in batches and holds them once, a byte a site."""
    fields = [table.schema[k] for k in keys]
    step = T.StructType([T.StructField("epoch", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in ("loss", "val_loss", "lr")]])
    schema = T.StructType([*fields, T.StructField("model", T.BinaryType()), T.StructField("history", T.ArrayType(step))])

    def fitted(own: list[pa.Array], train: Rows, val: Rows) -> pa.RecordBatch:
        at = picks and picks(tuple(k[0].as_py() for k in own), (train if train.n else val).x.shape[1])
        model, mean, sd = _fit_rows(train, val, options, moments_from, score, loss, at)
        history = [{"epoch": e, "loss": float(a), "val_loss": float(b), "lr": float(r)} for e, a, b, r in model.history]
        data = pickle.dumps((model.weights, model.mean, model.spread, mean, sd, at))
        return pa.RecordBatch.from_arrays([*own, pa.array([data], pa.binary()), pa.array([history], HISTORY)], [*keys, "model", "history"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, train, val = None, [], Rows(0), Rows(0)
        for batch in batches:
            jobs = batch.column("__job").to_numpy()
            for a in np.flatnonzero(np.r_[True, jobs[1:] != jobs[:-1]]) if len(jobs) else ():
                some = batch.slice(a, np.searchsorted(jobs, jobs[a], "right") - a)
                if jobs[a] != now:
                    if now is not None:
                        yield fitted(own, train, val)
                    now, own = jobs[a], [pa.array(some.column(k).slice(0, 1).to_pylist(), some.column(k).type) for k in keys]
                    train, val = (Rows(some.column(f"__{r}")[0].as_py()) for r in ("train", "val"))
                for role, rows in (("train", train), ("val", val)):
                    rows.add(some.filter(pc.equal(some.column("role"), role)))
        if now is not None:
            yield fitted(own, train, val)

    rows = one_task_each(table.where(F.col("role").isin("train", "val")), keys).sortWithinPartitions("__job", "sampleid")
    return rows.select("__job", "__train", "__val", *keys, "role", "x", "cx", "cy", "weight").mapInArrow(run, schema)


def split_roles(ids: list[str], held: np.ndarray, chunk: int, seed: int, train_split: float) -> np.ndarray:
    """The rows that validate the model of a chunk, as ``analyses.holdout_roles`` has them: round-half-even((1 - train_split) n) of the n rows that are not held, drawn by digest. ids: in order."""
    others = np.flatnonzero(~held)
    first = f"{seed}|{chunk}|"
    drawn = sorted(others, key=lambda k: (hashlib.md5(f"{first}{ids[k]}".encode()).hexdigest(), ids[k]))
    out = np.zeros(len(ids), bool)
    out[drawn[: round((1 - float(train_split)) * len(others))]] = True
    return out


def fit_predict_chunks(table: DataFrame, keys: list[str], options: Options, seed: int = 0, train_split: float = 0.9) -> DataFrame:
    """A network for every chunk of every key, trained and validated on the rows of the key's other chunks, and its predictions of the chunk: keys, holdout_id, sampleid, x, y.

    table: keys, sampleid, x, cx, cy, weight, holdout_id; a row once for each key, best a stored table. The chunks of a key are dealt to so many tasks that all cores have work, however many chunks there are;
    a task holds the key's rows once, a byte a site, draws the roles of each of its chunks there (``split_roles``) and trains one network after the other. So no table has a row for each sample and chunk.
    """
    many = table.select(*keys).distinct().count() if keys else 1
    shares = max(1, -(-2 * table.sparkSession.sparkContext.defaultParallelism // max(1, many)))
    chunks = table.agg(F.max("holdout_id")).first()[0]
    shares = min(shares, 1 if chunks is None else chunks + 1)
    every = table.withColumn("role", F.lit("train")).withColumn("__share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    schema = T.StructType([*[table.schema[k] for k in keys], table.schema["holdout_id"], table.schema["sampleid"], *[T.StructField(c, T.DoubleType()) for c in "xy"]])

    def trained(own: list[pa.Array], share: int, rows: Rows, ids: list[str], chunk: np.ndarray, kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        for c in np.unique(chunk)[share::shares]:
            held = chunk == c
            val = split_roles(ids, held, int(c), seed, train_split)
            sides = []
            for some in (~held & ~val, val):
                side = Rows(int(some.sum()))
                side.n, side.x, side.y, side.w = side.many, rows.x[some], rows.y[some], rows.w[some]
                sides.append(side)
            model, mean, sd = _fit_rows(*sides, options, "train", None, loss_and_gradient, None)
            del sides, side
            xy = predict(model, rows.x[held], options) * sd + mean
            at = np.flatnonzero(held)
            same = [pa.array([k[0].as_py()] * len(at), k.type) for k in own]
            found = [pa.array([int(c)] * len(at), kinds[0]), pa.array([ids[k] for k in at], kinds[1]), *[pa.array(xy[:, k].astype(float)) for k in (0, 1)]]
            yield pa.RecordBatch.from_arrays([*same, *found], [*keys, "holdout_id", "sampleid", "x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            jobs = batch.column("__job").to_numpy()
            for a in np.flatnonzero(np.r_[True, jobs[1:] != jobs[:-1]]) if len(jobs) else ():
                some = batch.slice(a, np.searchsorted(jobs, jobs[a], "right") - a)
                if jobs[a] != now:
                    if now is not None:
                        yield from trained(*held[:4], np.concatenate(held[4]), held[5])
                    own = [pa.array(some.column(k).slice(0, 1).to_pylist(), some.column(k).type) for k in keys]
                    kinds = [some.column(c).type for c in ("holdout_id", "sampleid")]
                    now, held = jobs[a], (own, some.column("__share")[0].as_py(), Rows(some.column("__train")[0].as_py()), [], [], kinds)
                held[2].add(some)
                held[3].extend(some.column("sampleid").to_pylist())
                held[4].append(some.column("holdout_id").to_numpy())
        if now is not None:
            yield from trained(*held[:4], np.concatenate(held[4]), held[5])

    rows = one_task_each(every, [*keys, "__share"]).sortWithinPartitions("__job", "sampleid")
    return rows.select("__job", "__share", "__train", *keys, "holdout_id", "sampleid", "x", "cx", "cy", "weight").mapInArrow(run, schema)


def history(models: DataFrame, keys: list[str]) -> DataFrame:
    return models.select(*keys, F.explode("history").alias("h")).select(*keys, "h.*")


def predict_with(rows: DataFrame, models: DataFrame, keys: list[str], options: Options, part_rows: int = 4096) -> DataFrame:
    """Predictions of rows (keys..., others, sampleid, x) by the model of their keys: others, x, y. Rows without a model are left out.

    The rows of each key are dealt into parts of a bounded number of rows, and a part meets its model once.
    """
    extra = [c for c in rows.columns if c != "x"]
    most = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    parts = max(1, -(-most // part_rows))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(*extra), F.lit(parts)).cast("int"))
    sent = models.select(*keys, "model", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    schema = T.StructType([rows.schema[c] for c in extra] + [T.StructField(c, T.DoubleType()) for c in "xy"])

    def run(key, part: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(model):
            return pd.DataFrame([], columns=[*extra, "x", "y"])
        weights, mean_x, spread, mean, sd, at = pickle.loads(model["model"].iloc[0])  # noqa: S301  written by fit_groups
        x = _matrix(part["x"])
        xy = predict(Fitted(weights, mean_x, spread), x if at is None else x[:, at], options) * sd + mean
        out = part[extra].copy()
        out["x"], out["y"] = xy[:, 0].astype(float), xy[:, 1].astype(float)
        return out

    by = [*keys, "part"]
    return dealt.groupBy(*by).cogroup(sent.groupBy(*by)).applyInPandas(run, schema)


def predict_overlays(rows: DataFrame, changes: DataFrame, models: DataFrame, options: Options, part_rows: int = 4096) -> DataFrame:
    """Predictions (replicate, sampleid, x, y) of rows (sampleid, x) under replicates that change some sites of all rows.

    changes: replicate, places (array of sites from 0, of each replicate) and, by sample, sampleid and draws (the new dosages there). models: one row. Vectors stay as they are: the sums of the first
    layer are worked out once for each row, and a replicate adds what its sites change. Rows are dealt into parts of a bounded number, which meet their changes and the model.
    """
    parts = max(1, -(-rows.count() // part_rows))
    part = F.pmod(F.xxhash64("sampleid"), F.lit(parts)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    told = models.select(every.alias("part"), "model").unionByName(changes.where("sampleid is null").select("replicate", "places", every.alias("part")), allowMissingColumns=True)
    told = told.unionByName(changes.where("sampleid is not null").select("replicate", "sampleid", "draws", part.alias("part")), allowMissingColumns=True)

    def run(mine: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return pd.DataFrame([], columns=["replicate", "sampleid", "x", "y"])
        weights, mean_x, spread, mean, sd, _ = pickle.loads(told[told["model"].notna()]["model"].iloc[0])  # noqa: S301  written by fit_groups
        mine = mine.sort_values("sampleid", kind="stable")
        x, first = _matrix(mine["x"]), weights[0]
        place = {i: k for k, i in enumerate(mine["sampleid"])}
        base = ((x.astype(np.float32) - mean_x) / spread) @ first + weights[1]
        lists = told[told["places"].notna()]
        drawn, out = told[told["draws"].notna()], []
        for replicate, at in zip(lists["replicate"], lists["places"], strict=True):
            some = drawn[drawn["replicate"] == replicate]
            who = np.array([place[i] for i in some["sampleid"]], int)
            at = np.asarray(at, int)
            new = _matrix(some["draws"])
            z = base[who] + ((new.astype(np.float32) - x[np.ix_(who, at)]) / spread[at]) @ first[at]
            xy = forward(weights[2:], elu(z) if options.layers else z, options, None, 1)[0] * sd + mean
            out.append(pd.DataFrame({"replicate": int(replicate), "sampleid": some["sampleid"].to_numpy(), "x": xy[:, 0].astype(float), "y": xy[:, 1].astype(float)}))
        return pd.concat(out) if out else pd.DataFrame([], columns=["replicate", "sampleid", "x", "y"])

    dealt = rows.select("sampleid", "x", part.alias("part"))
    return dealt.groupBy("part").cogroup(told.groupBy("part")).applyInPandas(run, "replicate int, sampleid string, x double, y double")


def require_models(models: DataFrame) -> DataFrame:
    if not models.limit(1).count():
        raise ValueError("The model has not been trained")
    return models
