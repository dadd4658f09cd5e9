"""One network over many tasks: its first layer split by blocks of sites, its training rows by parts.

The first layer has sites times width weights, nearly all of the network, so it is dealt by blocks of sites and no task holds more than one. A step is two Spark jobs:

1. each (part of rows, block) gives its share of the first layer's sums, shares meet by slices of the rows and are added, and the rest of the network, which is small, gives the loss, its own gradient and the
   gradient of the sums of every row;
2. these go back to the blocks, each (part, block) gives a gradient of its weights, gradients are added in two levels, and each block takes its own step of Adam.

All sums are of exact shares and all draws are keyed by sample, so the weights are those of one network trained in one place on the same batches, whatever the numbers of blocks and tasks are. The state
of each step is a table in the shared folder. The driver sees the loss of an epoch, by which it keeps the best state, halves the rate and stops.
"""

from __future__ import annotations

import zlib
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genorigin.shared import stored

from .network import Adam, Control, Loss, Options, backward, elu, elu_slope, forward, loss_and_gradient, shapes

STATE = "kind string, block int, data binary"
SUMS = "part int, sub int, block int, data binary"
OUT = "kind string, part int, sub int, n double, value double, data binary"
#: Names of what the first job hands on: losses, gradients of the head, gradients of the first layer's sums.
LOSS_TRAIN, LOSS_VAL, HEAD, ROWS = "loss train", "loss val", "head", "rows"


def _numbers(data: bytes, kind=np.float32) -> np.ndarray:
    return np.frombuffer(data, kind).copy()


def _split(flat: np.ndarray, shaped: list[tuple[int, ...]]) -> list[np.ndarray]:
    ends = np.cumsum([int(np.prod(s)) for s in shaped])
    return [x.reshape(s) for x, s in zip(np.split(flat, ends[:-1]), shaped, strict=True)]


def _joined(arrays: list[np.ndarray]) -> bytes:
    return np.concatenate([a.ravel() for a in arrays]).astype(np.float32).tobytes()


def head_shapes(o: Options) -> list[tuple[int, ...]]:
    """All but the weights of the first layer: its biases, then weights and biases of the others."""
    return [s for a, b in shapes(1, o) for s in ((a, b), (b,))][1:]


def initial_head(o: Options) -> list[np.ndarray]:
    rng, out = np.random.default_rng([o.seed, 1]), []
    for s in head_shapes(o):
        out.append(rng.uniform(-1, 1, s).astype(np.float32) * np.float32(np.sqrt(6 / sum(s))) if len(s) == 2 else np.zeros(s, np.float32))
    return out


def initial_block(first: int, sites: int, n_sites: int, o: Options) -> np.ndarray:
    """The first layer's weights of some sites; each site's are drawn by its number."""
    edge = np.float32(np.sqrt(6 / (n_sites + o.width)))
    return np.stack([np.random.default_rng([o.seed, 0, first + k]).uniform(-1, 1, o.width).astype(np.float32) * edge for k in range(sites)])


class _Keyed:
    """Draws for dropout, a row of them for each sample, by its id and the step."""

    def __init__(self, o: Options, step: int, ids: list[str]):
        self.keys = [[o.seed, 2, step, zlib.crc32(i.encode())] for i in ids]

    def random(self, shape: tuple[int, int]) -> np.ndarray:
        return np.stack([np.random.default_rng(k).random(shape[1]) for k in self.keys])


def _flipped(x: np.ndarray, ids: list[str], o: Options, step: int, block: int) -> np.ndarray:
    if not o.flip_rate:
        return x
    draws = np.stack([np.random.default_rng([o.seed, 3, step, block, zlib.crc32(i.encode())]).random(x.shape[1]) for i in ids])
    return np.where(draws < o.flip_rate, 1 - x, x)


class Blocks:
    """Rows dealt into parts and blocks. sites: (part, block, ids, data: int8 rows x sites of the block); labels: (part, sub, train, ids, data: float64 rows x (x, y, weight))."""

    def __init__(self, rows: DataFrame, n_sites: int, block: int, part_rows: int, parts: int, val_parts: int, batches: int = 1):
        n_blocks = -(-n_sites // block)
        self.n_sites, self.block, self.n_blocks, self.parts, self.all_parts, self.batches = n_sites, block, n_blocks, parts, parts + val_parts, batches
        self.slice = slice_ = max(1, part_rows // n_blocks)
        place = lambda n: F.pmod(F.xxhash64("sampleid"), F.lit(max(1, n))).cast("int")
        dealt = rows.withColumn("part", F.when(F.col("role") == "train", place(parts)).otherwise(place(val_parts) + parts))
        cut = dealt.select("part", "sampleid", "x", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
        cut = cut.select("part", "block", "sampleid", F.slice("x", F.col("block") * block + 1, F.lit(block)).alias("x"))

        def matrix(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("sampleid", kind="stable")
            return pd.DataFrame([[part["part"].iloc[0], part["block"].iloc[0], part["sampleid"].tolist(), np.stack(part["x"].to_numpy()).astype(np.int8).tobytes()]], columns=["part", "block", "ids", "data"])

        def label(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("sampleid", kind="stable").reset_index(drop=True)
            on = bool(part["part"].iloc[0] < parts)
            out = [[k // slice_, on, p["sampleid"].tolist(), p[["cx", "cy", "weight"]].to_numpy(float).tobytes()] for k in range(0, len(part), slice_) for p in [part.iloc[k : k + slice_]]]
            return pd.DataFrame([[part["part"].iloc[0], *r] for r in out], columns=["part", "sub", "train", "ids", "data"])

        self.sites = stored(cut.groupBy("part", "block").applyInPandas(matrix, "part int, block int, ids array<string>, data binary"), "sites")
        some = dealt.select("part", "sampleid", F.col("cx").cast("double"), F.col("cy").cast("double"), F.col("weight").cast("double"))
        self.labels = stored(some.groupBy("part").applyInPandas(label, "part int, sub int, train boolean, ids array<string>, data binary"), "labels")

    def asked(self, batch: int) -> F.Column:
        """Of the column part: the training parts of a batch; the first has those of the validation rows as well."""
        mine = (F.col("part") < self.parts) & (F.col("part") % self.batches == batch)
        return mine | (F.col("part") >= self.parts) if batch == 0 else mine

    def sent(self, state: DataFrame, what: list[str], o: Options, batch: int) -> DataFrame:
        """(part, block, data): of each block's state the weights, or the inputs' mean and spread, once for every part of a batch."""
        cells = F.octet_length("data") / F.lit(3 * o.width + 2)
        places = {"weights": (0, o.width), "mean": (3 * o.width, 1), "spread": (3 * o.width + 1, 1)}
        cut = [F.substring("data", (cells * at).cast("int") + 1, (cells * n).cast("int")) for at, n in (places[w] for w in what)]
        every = state.where("kind = 'block'").select("block", F.concat(*cut).alias("data"), F.explode(F.sequence(F.lit(0), F.lit(self.all_parts - 1))).alias("part"))
        return every.where(self.asked(batch))


def _values(part: pd.Series) -> np.ndarray:
    return np.frombuffer(part["data"], np.int8).reshape(len(part["ids"]), -1)


def _sum_of(kind=np.float32):
    def add(rows: pd.DataFrame) -> pd.DataFrame:
        out = rows.iloc[:1].copy()
        out["data"] = [sum(np.frombuffer(d, kind).astype(np.float64) for d in rows["data"]).astype(kind).tobytes()]
        return out

    return add


def _added(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The sums of data (float64) by keys, in two levels, so a task holds no more than the square root of all that a key has."""
    schema = rows.schema
    some = rows.withColumn("some", F.pmod(F.spark_partition_id(), F.lit(16))).groupBy(*keys, "some").applyInPandas(lambda r: _sum_of(np.float64)(r.drop(columns="some")), schema)
    return some.groupBy(*keys).applyInPandas(_sum_of(np.float64), schema)


class WideModel:
    """The stored state of a network, the mean and deviation of its coordinates, and its history of (epoch, training loss, validation loss, rate)."""

    def __init__(self, state: DataFrame, n_sites: int, block: int, mean: np.ndarray, sd: np.ndarray, history: list[tuple[int, float, float, float]]):
        self.state, self.n_sites, self.block, self.mean, self.sd, self.history = state, n_sites, block, mean, sd, history


def _block_state(o: Options, data: bytes) -> list[np.ndarray]:
    """Weights, both moments of Adam, and mean and deviation of the inputs of a block."""
    flat = _numbers(data)
    sites = len(flat) // (3 * o.width + 2)
    return _split(flat, [(sites, o.width)] * 3 + [(sites,)] * 2)


def _start(blocks: Blocks, o: Options) -> DataFrame:
    """The first state: drawn weights, and the moments of the inputs over the training rows."""
    block, n_sites = blocks.block, blocks.n_sites

    def moments(rows: pd.DataFrame) -> pd.DataFrame:
        x = _values(rows.iloc[0]).astype(np.float64)
        return pd.DataFrame({"kind": ["block"], "block": [rows["block"].iloc[0]], "data": [np.concatenate([[len(x)], x.sum(axis=0), (x**2).sum(axis=0)]).tobytes()]})

    def begin(rows: pd.DataFrame) -> pd.DataFrame:
        flat, k = _numbers(rows["data"].iloc[0], np.float64), int(rows["block"].iloc[0])
        n, sites = flat[0], (len(flat) - 1) // 2
        mean = flat[1 : sites + 1] / n
        spread = np.sqrt(np.maximum(flat[sites + 1 :] / n - mean**2, 0) + 1e-3)
        w = initial_block(k * block, sites, n_sites, o)
        return pd.DataFrame({"kind": ["block"], "block": [k], "data": [_joined([w, np.zeros_like(w), np.zeros_like(w), mean, spread])]})

    sums = blocks.sites.where(F.col("part") < blocks.parts).groupBy("part", "block").applyInPandas(moments, STATE)
    first = _added(sums, ["block"]).groupBy("block").applyInPandas(begin, STATE)
    head = initial_head(o)
    zero = [np.zeros_like(w) for w in head]
    return stored(first.union(first.sparkSession.createDataFrame([("head", -1, _joined(head + zero + zero))], STATE)), "state")


def _first_sums(blocks: Blocks, state: DataFrame, o: Options, batch: int, step: int | None) -> DataFrame:
    """For each slice of the rows of a batch and each block, its share of the first layer's sums."""
    weights, parts, slice_ = blocks.sent(state, ["weights", "mean", "spread"], o, batch), blocks.parts, blocks.slice

    def work(rows: pd.DataFrame, now: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(now):
            return pd.DataFrame([], columns=["part", "sub", "block", "data"])
        r = rows.iloc[0]
        flat = _numbers(now["data"].iloc[0])
        sites = len(flat) // (o.width + 2)
        w, mean, spread = _split(flat, [(sites, o.width), (sites,), (sites,)])
        x = _values(r)
        if step is not None and r["part"] < parts:
            x = _flipped(x, r["ids"], o, step, int(r["block"]))
        sums = ((x.astype(np.float32) - mean) / spread) @ w
        cut = [(k // slice_, sums[k : k + slice_].astype(np.float64).tobytes()) for k in range(0, len(sums), slice_)]
        return pd.DataFrame([(r["part"], sub, r["block"], data) for sub, data in cut], columns=["part", "sub", "block", "data"])

    rows = blocks.sites.where(blocks.asked(batch))
    return rows.groupBy("part", "block").cogroup(weights.groupBy("part", "block")).applyInPandas(work, SUMS)


def _with_head(sums: DataFrame, blocks: Blocks, state: DataFrame, batch: int, work, schema: str) -> DataFrame:
    """work(sums of a slice (rows x width), its labels (ids, train, values), head) for every slice of a batch."""
    labels = blocks.labels.where(blocks.asked(batch))
    head = labels.select("part", "sub").crossJoin(F.broadcast(state.where("kind = 'head'").select("data")))  # one row, of a size set by the options
    told = labels.select("part", "sub", "train", "ids", "data").unionByName(head, allowMissingColumns=True)

    def run(shares: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        mine, head = told[told["ids"].notna()].iloc[0], told[told["ids"].isna()].iloc[0]
        ids = list(mine["ids"])
        z = sum(np.frombuffer(d, np.float64) for d in shares["data"]).reshape(len(ids), -1).astype(np.float32)
        values = np.frombuffer(mine["data"], np.float64).reshape(len(ids), 3)
        return work(int(mine["part"]), int(mine["sub"]), bool(mine["train"]), ids, values, z, _numbers(head["data"]))

    return sums.groupBy("part", "sub").cogroup(told.groupBy("part", "sub")).applyInPandas(run, schema)


def head_pass(head: list[np.ndarray], z: np.ndarray, o: Options, rng=None):
    """Outputs from the first layer's sums, and what the way back needs."""
    z = z + head[0]
    if not o.layers:
        return forward(head[1:], z, o, rng, 1), z
    return forward(head[1:], elu(z), o, rng, 1), z


def head_gradient(head: list[np.ndarray], kept, z: np.ndarray, grad: np.ndarray, o: Options) -> tuple[list[np.ndarray], np.ndarray]:
    grads, rows = backward(head[1:], kept, grad, o, 1)
    rows = rows * elu_slope(z) if o.layers else rows
    return [rows.sum(axis=0), *grads], rows


def _gradients(blocks: Blocks, state: DataFrame, o: Options, batch: int, step: int, mean: np.ndarray, sd: np.ndarray, total: float, score, loss: Loss) -> DataFrame:
    """The first job: losses, gradients of the head, and of the first layer's sums. total: the weights of the batch."""

    def work(part: int, sub: int, train: bool, ids: list[str], values: np.ndarray, z: np.ndarray, flat: np.ndarray) -> pd.DataFrame:
        head = _split(flat[: len(flat) // 3], head_shapes(o))
        y = ((values[:, :2] - mean) / sd).astype(np.float32)
        (pred, kept), z0 = head_pass(head, z, o, _Keyed(o, step, ids) if train else None)
        w = values[:, 2] if train else np.ones(len(ids))
        value, grad = loss(pred, y, w.astype(np.float32))
        value += 0.0 if train or not score else float(np.sum(score(pred * sd + mean)))
        out = [(LOSS_TRAIN if train else LOSS_VAL, part, sub, float(w.sum()), float(value), b"")]
        if train:
            grads, rows = head_gradient(head, kept, z0, (grad / total).astype(np.float32), o)
            out += [(HEAD, part, sub, 0.0, 0.0, np.concatenate([g.ravel() for g in grads]).astype(np.float64).tobytes()), (ROWS, part, sub, 0.0, 0.0, rows.astype(np.float32).tobytes())]
        return pd.DataFrame(out, columns=["kind", "part", "sub", "n", "value", "data"])

    return stored(_with_head(_first_sums(blocks, state, o, batch, step), blocks, state, batch, work, OUT), "gradients")


def _stepped(blocks: Blocks, state: DataFrame, found: DataFrame, o: Options, batch: int, step: int, rate: float) -> DataFrame:
    """The second job: the state after a step of Adam in every block and in the head."""
    back = found.where(F.col("kind") == ROWS).groupBy("part").agg(F.array_sort(F.collect_list(F.struct("sub", "data"))).alias("subs"))
    back = back.select("part", F.col("subs.data").alias("subs"), F.explode(F.sequence(F.lit(0), F.lit(blocks.n_blocks - 1))).alias("block"))
    sent = blocks.sent(state, ["mean", "spread"], o, batch)
    given = back.join(sent, ["part", "block"])

    def gradient(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(told):
            return pd.DataFrame([], columns=["kind", "block", "data"])
        r, t = rows.iloc[0], told.iloc[0]
        mean, spread = np.split(_numbers(t["data"]), 2)
        dz = np.concatenate([np.frombuffer(d, np.float32) for d in t["subs"]]).reshape(len(r["ids"]), o.width)
        x = _flipped(_values(r), r["ids"], o, step, int(r["block"]))
        return pd.DataFrame([["block", r["block"], (((x.astype(np.float32) - mean) / spread).T @ dz).astype(np.float64).tobytes()]], columns=["kind", "block", "data"])

    def adam(weights: list[np.ndarray], m: list[np.ndarray], v: list[np.ndarray], grads: list[np.ndarray]) -> None:
        a = Adam(weights, o)
        a.m, a.v, a.t = m, v, step - 1
        a.step(weights, grads, rate)

    def update(now: pd.DataFrame, grad: pd.DataFrame) -> pd.DataFrame:
        s, g = now.iloc[0], _numbers(grad["data"].iloc[0], np.float64).astype(np.float32)
        if s["kind"] == "block":
            w, m, v, mean, spread = _block_state(o, s["data"])
            adam([w], [m], [v], [g.reshape(w.shape)])
            data = _joined([w, m, v, mean, spread])
        else:
            shaped = head_shapes(o)
            w, m, v = (_split(x, shaped) for x in np.split(_numbers(s["data"]), 3))
            adam(w, m, v, _split(g, shaped))
            data = _joined(w + m + v)
        return pd.DataFrame([[s["kind"], s["block"], data]], columns=["kind", "block", "data"])

    ahead = blocks.sites.where(blocks.asked(batch))
    by_block = ahead.groupBy("part", "block").cogroup(given.groupBy("part", "block")).applyInPandas(gradient, STATE)
    by_head = found.where(F.col("kind") == HEAD).select("kind", F.lit(-1).alias("block"), "data")
    grads = _added(by_block.union(by_head), ["kind", "block"])
    return stored(state.groupBy("kind", "block").cogroup(grads.groupBy("kind", "block")).applyInPandas(update, STATE), "state")


def fit_wide(
    table: DataFrame, options: Options = Options(), block: int = 4096, part_rows: int = 1024, batches: int = 1, moments_from: str = "train", score=None, loss: Loss = loss_and_gradient
) -> WideModel:
    """Fit one network to the train rows of a training table (sampleid, x, cx, cy, role, weight), watched on its val rows (on the train rows without any).

    block: sites a block. part_rows: rows a part on average, which bounds what a task holds (part_rows x block bytes of dosages). batches: steps an epoch, each on a share of the parts, that
    samples are dealt into by a hash of their id; with one, a step sees all rows. There are options.epochs epochs. score: a term of the validation loss by predicted places; loss: as
    ``network.Loss``. A ValueError without training rows.
    """
    known = table.where("cx is not null")
    train = table.where("role = 'train'")
    m = (train if moments_from == "train" else known).agg(*[f(c) for f in (F.avg, F.stddev_pop) for c in ("cx", "cy")]).first()
    counts = table.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("sites")).collect()  # a row for each role
    sizes = {r["role"]: r["n"] for r in counts}
    if not sizes.get("train"):
        raise ValueError("There are no training samples")
    mean, sd = np.array(m[:2], float), np.array([x or 1.0 for x in m[2:]], float)
    parts, val_parts = max(batches, -(-sizes["train"] // part_rows)), -(-sizes.get("val", 0) // part_rows)
    rows = table.where(F.col("role").isin("train", "val")).select("sampleid", "x", "cx", "cy", "role", "weight")
    blocks = Blocks(rows, max(r["sites"] for r in counts), block, part_rows, parts, val_parts, batches)
    dealt = train.withColumn("batch", F.pmod(F.xxhash64("sampleid"), F.lit(parts)) % batches)
    totals = {r["batch"]: r["w"] for r in dealt.groupBy("batch").agg(F.sum("weight").alias("w")).collect()}  # a number for each batch
    state, best, control, history, step = _start(blocks, options), None, Control(options), [], 0
    for epoch in range(options.epochs + 1):
        seen = {LOSS_TRAIN: [0.0, 0.0], LOSS_VAL: [0.0, 0.0]}
        before = state
        for b in range(batches):
            step += 1
            found = _gradients(blocks, state, options, b, step, mean, sd, totals.get(b) or 1.0, score, loss)
            for r in found.where(F.col("kind").startswith("loss")).groupBy("kind").agg(F.sum("n").alias("n"), F.sum("value").alias("value")).collect():
                seen[r["kind"]][0] += r["value"]
                seen[r["kind"]][1] += r["n"]
            if epoch < options.epochs and b in totals:
                state = _stepped(blocks, state, found, options, b, step, control.rate)
        told = {k: a / n for k, (a, n) in seen.items() if n}
        watched = told.get(LOSS_VAL, told.get(LOSS_TRAIN))
        history.append((epoch, told[LOSS_TRAIN], watched, control.rate))
        best = before if watched < control.best or best is None else best
        if not control.seen(watched, []):
            break
    return WideModel(best, blocks.n_sites, block, mean, sd, history)


def predict_wide(rows: DataFrame, model: WideModel, options: Options, part_rows: int = 1024) -> DataFrame:
    """Predictions (sampleid, x, y) of rows (sampleid, x; one for each id) by the blocks of the model."""
    n = rows.count()
    asked = rows.select("sampleid", "x", *[F.lit(0.0).alias(c) for c in ("cx", "cy", "weight")], F.lit("pred").alias("role"))
    blocks = Blocks(asked, model.n_sites, model.block, part_rows, 0, max(1, -(-n // part_rows)))
    o, mean, sd = replace(options, dropout=0.0), model.mean, model.sd

    def work(part: int, sub: int, train: bool, ids: list[str], values: np.ndarray, z: np.ndarray, flat: np.ndarray) -> pd.DataFrame:
        (pred, _), _ = head_pass(_split(flat[: len(flat) // 3], head_shapes(o)), z, o)
        xy = pred * sd + mean
        return pd.DataFrame({"sampleid": ids, "x": xy[:, 0].astype(float), "y": xy[:, 1].astype(float)})

    return _with_head(_first_sums(blocks, model.state, o, 0, None), blocks, model.state, 0, work, "sampleid string, x double, y double")
