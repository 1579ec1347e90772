"""Training of the linear classifiers with all vectors of features in blocks.

Spark's own training keeps some thirty vectors of all features on the driver. Here weights, gradients and the optimiser's history are files of a block of
features each, beside the block's cells, in the folder that driver and executors share; tasks map them into memory. The driver keeps one number a document,
and the dot products of the history, from which the two loops of L-BFGS make coefficients of the next direction. Steps are those of Spark's classifiers
(Breeze's L-BFGS with strong Wolfe conditions, and OWL-QN without a penalty for the SVM), over features of deviation one, centred by the intercept.
"""

from __future__ import annotations

import functools
import math
import os
import shutil
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

from redpen.operators.repair import _each, _local, _package_of_workers, _parts
from redpen.operators.tables import shared_folder

#: Cells of a block; vectors of each kind in the history.
CELLS, HISTORY = 1 << 20, 10
TOLERANCE = 1e-6


def possible(spark: SparkSession) -> bool:
    folder = shared_folder(spark)
    return bool(folder and _local(folder))


class NoDescent(ArithmeticError):
    """The line search found no step."""


def _open(path: str) -> np.ndarray:
    return np.asarray(np.load(path, mmap_mode="r"))


def _save(path: str, x: np.ndarray) -> None:
    with open(f"{path}.tmp", "wb") as f:
        np.save(f, x)
    os.replace(f"{path}.tmp", path)


def _scatter(folder: str, part: int, path: str, first: int, width: int, n_blocks: int) -> None:
    """The cells of one part of the documents, ordered by feature, and where each block begins."""
    rows, docs, slots, values = first, [], [], []
    for b in pq.ParquetFile(path).iter_batches(4096, columns=["features"]):
        x = b.column(0)
        indices, weights = (x.field(x.type.get_field_index(c)) for c in ("indices", "values"))
        n = indices.value_lengths().to_numpy(zero_copy_only=False)
        docs.append(np.repeat(np.arange(rows, rows + len(n), dtype=np.int32), n))
        slots.append(indices.flatten().to_numpy().astype(np.int32))
        values.append(weights.flatten().to_numpy())
        rows += len(n)
    docs, slots, values = (np.concatenate([np.zeros(0, kind), *x]) for x, kind in ((docs, np.int32), (slots, np.int32), (values, np.float64)))
    order = np.argsort(slots, kind="stable")
    for name, x in (("docs", docs), ("slots", slots), ("values", values)):
        _save(f"{folder}/part-{part}.{name}", x[order])
    _save(f"{folder}/part-{part}.cuts", np.searchsorted(slots[order], np.arange(n_blocks + 1) * width))


def _gather(folder: str, block: int, n_parts: int, width: int, size: int) -> None:
    """One block's cells by feature: docs, values, and the first cell of each feature."""
    cuts = [_open(f"{folder}/part-{k}.cuts")[block : block + 2] for k in range(n_parts)]
    docs, slots, values = (np.concatenate([_open(f"{folder}/part-{k}.{name}")[a:b] for k, (a, b) in enumerate(cuts)]) for name in ("docs", "slots", "values"))
    order = np.argsort(slots, kind="stable")
    features = min(width, size - block * width)
    at = f"{folder}/{block}"
    os.makedirs(at, exist_ok=True)
    _save(f"{at}/docs", docs[order])
    _save(f"{at}/values", values[order])
    _save(f"{at}/first", np.searchsorted(slots[order], block * width + np.arange(features + 1)))


class Block:
    """A block of features. Vectors are files; each step writes new ones, so a task that is run again makes the same."""

    def __init__(self, folder: str, block: int, n: int):
        self.folder, self.at, self.k, self.n = folder, f"{folder}/{block}", block, n
        self.docs, self.values, self.first = (_open(f"{self.at}/{x}") for x in ("docs", "values", "first"))

    def get(self, name: str) -> np.ndarray:
        return _open(f"{self.at}/{name}")

    def put(self, **vectors: np.ndarray) -> None:
        for name, x in vectors.items():
            _save(f"{self.at}/{name}", x)

    def tell(self, *numbers, **by_document: np.ndarray) -> None:
        """What the driver adds up."""
        self.put(told=np.concatenate([np.ravel(x) for x in numbers]), **by_document)

    def sums(self, by_cell: np.ndarray) -> np.ndarray:
        """Of cells, by feature."""
        return np.where(np.diff(self.first) > 0, np.add.reduceat(np.append(by_cell, 0.0), self.first[:-1]), 0.0)

    def margins(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.docs, self.values * np.repeat(x * self.get("inverse"), np.diff(self.first)), self.n)

    def begin(self) -> None:
        """Deviations and means for the documents' weights, and a start from zero."""
        w = _open(f"{self.folder}/weight")
        total = w.sum()
        mean = self.sums(self.values * w[self.docs]) / total
        square = self.sums(self.values**2 * w[self.docs])
        spread = np.sqrt(np.maximum((square - total * mean**2) / (total - (w**2).sum() / total), 0.0))
        inverse = np.where(spread > 0, 1 / np.where(spread > 0, spread, 1), 0.0)
        self.put(inverse=inverse, mean=mean * inverse, x=np.zeros(len(mean)))

    def gradient(self, step: int, penalty: float, plain: bool, x: str) -> None:
        """The gradient at x, the last step and change, and the dot products of all that is kept."""
        r = _open(f"{self.folder}/slope")
        x, inverse = self.get(x), self.get("inverse")
        g = self.sums(self.values * r[self.docs]) * inverse - r.sum() * self.get("mean") + penalty * x * (inverse**2 if plain else 1)
        if step:
            self.put(**{f"s{step}": x - self.get(f"x{step - 1}"), f"y{step}": g - self.get(f"g{step - 1}")})
        self.put(**{f"g{step}": g, f"x{step}": x})

    def products(self, step: int, kept: list[int]) -> None:
        v = np.stack([*[self.get(f"s{k}") for k in kept], *[self.get(f"y{k}") for k in kept], self.get(f"g{step}")])
        self.tell(v @ v.T)

    def direction(self, step: int, kept: list[int], weights: np.ndarray, penalty: float, plain: bool, signed: bool) -> None:
        v = [*[f"s{k}" for k in kept], *[f"y{k}" for k in kept], f"g{step}"]
        g, x, inverse, mean = self.get(f"g{step}"), self.get(f"x{step}"), self.get("inverse"), self.get("mean")
        d = np.zeros(len(g))
        for c, name in zip(weights, v, strict=True):
            d += c * self.get(name)
        if signed:
            d = np.where(d * g < 0, d, 0.0)
        cost = penalty * (inverse**2 if plain else 1)
        self.put(d=d)
        self.tell([d @ d, d @ g, (cost * x) @ x, (cost * x) @ d, (cost * d) @ d, mean @ d], z=self.margins(d))

    def move(self, step: int, far: float, penalty: float, plain: bool, signed: bool) -> None:
        """A trial: x moved by the direction; signed, it stops where a weight would change its sign."""
        x, d, mean = self.get(f"x{step}"), self.get("d"), self.get("mean")
        new = x + far * d
        if signed:
            sign = np.where(x != 0, np.sign(x), np.sign(-self.get(f"g{step}")))
            new = np.where(np.sign(new) == sign, new, 0.0)
            cost = penalty * (self.get("inverse") ** 2 if plain else 1)
            self.tell([(cost * new) @ new, (cost * new) @ d, mean @ new], z=self.margins(new))
        self.put(trial=new)


class Matrix:
    """The cells of a frame (doc_id, label, features, class_weight) in blocks of features; label, class_weight and the columns named ``more`` by document."""

    def __init__(self, frame: DataFrame, *more: str):
        self.spark = frame.sparkSession
        self.folder = _local(f"{shared_folder(self.spark)}/descent-{uuid.uuid4().hex}")
        _package_of_workers(self.spark)
        frame.select("label", "class_weight", "features", *more).write.parquet(f"file:{self.folder}/frame")
        parts = [x for x in _parts(f"{self.folder}/frame") if pq.ParquetFile(x).metadata.num_rows]
        columns = pq.ParquetFile(parts[0]).schema_arrow.names if parts else []
        by_document = [pq.ParquetFile(x).read(columns=[c for c in columns if c != "features"]) for x in parts]
        column = lambda c: np.concatenate([t.column(c).to_numpy() for t in by_document]) if parts else np.zeros(0)
        self.label, self.class_weight, self.more = column("label"), column("class_weight"), {c: column(c) for c in more}
        self.n = len(self.label)
        if not parts:
            return
        head = next(pq.ParquetFile(parts[0]).iter_batches(1, columns=["features"])).column(0)
        self.size = head.field(head.type.get_field_index("size"))[0].as_py()
        cells = sum(os.path.getsize(x) for x in parts) // 8  # about; a cell takes some ten bytes
        self.n_blocks = max(1, min(self.size, max(self.spark.sparkContext.defaultParallelism, cells // CELLS)))
        self.width = -(-self.size // self.n_blocks)
        self.n_blocks = -(-self.size // self.width)
        starts = np.cumsum([0, *[t.num_rows for t in by_document]])
        folder, width, n_blocks, size, n_parts = self.folder, self.width, self.n_blocks, self.size, len(parts)
        _each(self.spark, n_parts, lambda k: _scatter(folder, k, parts[k], int(starts[k]), width, n_blocks))
        shutil.rmtree(f"{folder}/frame")
        _each(self.spark, n_blocks, lambda k: _gather(folder, k, n_parts, width, size))
        for k in range(n_parts):
            for name in ("docs", "slots", "values", "cuts"):
                os.truncate(path := f"{folder}/part-{k}.{name}", 0)  # a waiting worker may have it mapped
                os.remove(path)

    def table(self, **columns: np.ndarray) -> str:
        """A small table for Spark, in the matrix's folder."""
        os.makedirs(path := f"{self.folder}/{uuid.uuid4().hex}.parquet")
        pq.write_table(pa.table(columns), f"{path}/part-0.parquet")
        return f"file:{path}"

    def remove(self) -> None:
        for name, _, files in os.walk(self.folder):
            for x in files:
                os.truncate(f"{name}/{x}", 0)
        shutil.rmtree(self.folder, ignore_errors=True)

    def all(self, *steps: tuple) -> np.ndarray | None:
        """Do steps in all blocks; the sum of what they told."""
        folder, n, n_blocks = self.folder, self.n, self.n_blocks
        tasks = min(n_blocks, self.spark.sparkContext.defaultParallelism)

        def work(task):
            for k in range(task, n_blocks, tasks):
                block = Block(folder, k, n)
                for name, *args in steps:
                    getattr(block, name)(*args)

        for k in range(n_blocks):
            if os.path.exists(path := f"{folder}/{k}/told"):
                os.remove(path)
        self.spark.sparkContext.parallelize(range(tasks), tasks).foreach(work)
        told = [_open(f"{folder}/{k}/told") for k in range(n_blocks) if os.path.exists(f"{folder}/{k}/told")]
        return functools.reduce(np.add, told) if told else None

    def by_document(self) -> np.ndarray:
        return functools.reduce(np.add, (_open(f"{self.folder}/{k}/z") for k in range(self.n_blocks)))

    def forget(self, *names: str) -> None:
        for k in range(self.n_blocks):
            for name in names:
                if os.path.exists(path := f"{self.folder}/{k}/{name}"):
                    os.truncate(path, 0)
                    os.remove(path)


def _logistic_loss(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.logaddexp(0, margin) - y * margin, 1 / (1 + np.exp(-np.clip(margin, -700, 700))) - y


def _hinge_loss(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sign = 2 * y - 1
    return np.maximum(0.0, 1 - sign * margin), np.where(sign * margin < 1, -sign, 0.0)


def strong_wolfe(phi, far: float, c1: float = 1e-4, c2: float = 0.9, tries: int = 10) -> float:
    """A step that meets the strong Wolfe conditions; phi gives value and slope."""
    start = low = (0.0, *phi(0.0))
    _, f0, d0 = start
    if d0 > 0:
        raise NoDescent

    def between(a, b):
        (ta, fa, da), (tb, fb, db) = (a, b) if a[0] <= b[0] else (b, a)
        d1 = da + db - 3 * (fa - fb) / (ta - tb)
        root = d1 * d1 - da * db
        t = tb - (tb - ta) * (db + math.sqrt(root) - d1) / (db - da + 2 * math.sqrt(root)) if root >= 0 else math.nan
        return max(ta + 0.1 * (tb - ta), min(ta + 0.9 * (tb - ta), t)) if t == t else t

    def zoom(low, high):
        for _ in range(tries):
            c = (t := between(low, high), *phi(t))
            if c[1] > f0 + c1 * t * d0 or c[1] >= low[1]:
                high = c
            else:
                if abs(c[2]) <= c2 * abs(d0):
                    return t
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise NoDescent

    for i in range(tries):
        c = (far, *phi(far))
        if not math.isfinite(c[1]):
            far /= 2
            continue
        if c[1] > f0 + c1 * far * d0 or (c[1] >= low[1] and i > 0):
            return zoom(low, c)
        if abs(c[2]) <= c2 * abs(d0):
            return far
        if c[2] >= 0:
            return zoom(c, low)
        low, far = c, far * 1.5
    raise NoDescent


def backtracking(phi, f0: float, d0: float, far: float, shrink: float, grow: float = 2.1, c1: float = 1e-4, c2: float = 0.9, tries: int = 20) -> float:
    """A step that meets the strong Wolfe conditions, by shrinking and growing. As in Breeze, the first one has the value of no step, so it is shrunk unseen."""
    f, d = f0, phi(far)[1] if d0 >= 0 else 0.0
    for _ in range(tries):
        times = shrink if f > f0 + far * d0 * c1 else grow if d < c2 * d0 else shrink if d > -c2 * d0 else 1
        if times == 1:
            break
        if not 1e-10 <= far * times <= 1e10:
            raise NoDescent
        last, far = far, far * times
        f, d = phi(far)
    else:
        far = last
    return far


def train(m: Matrix, weight: np.ndarray, penalty: float, steps: int, hinge: bool) -> np.ndarray:
    """The margins of all documents under the model that is trained on those of positive weight; logistic (the penalty is on the weights as they are) or hinge loss (on those of features of deviation one)."""
    loss, plain, signed = (_hinge_loss, False, True) if hinge else (_logistic_loss, True, False)
    total, y, trained = weight.sum(), m.label, weight > 0
    ones = weight[trained & (y == 1)].sum()
    _save(f"{m.folder}/weight", weight)
    m.all(("begin",))
    margin, offset, cost = np.zeros(m.n), 0.0, 0.0  # offset: of the centred margin; cost: of the weights
    b = 0.0 if hinge else math.log(ones / (total - ones))

    def value(z: np.ndarray) -> tuple[float, np.ndarray]:
        each, slope = loss(z, y)
        return float((weight * each).sum() / total), weight * slope / total

    f, r = value(margin + b)
    _save(f"{m.folder}/slope", r)
    kept: list[int] = []
    told = m.all(("gradient", 0, penalty, plain, "x"), ("products", 0, kept))
    gb, values, fresh = float(r.sum()), [math.inf], False
    sb, yb, f_first, step = {}, {}, f, 0
    while True:
        size = 2 * len(kept) + 1
        dots = told.reshape(size, size)
        own = np.array([*[sb[k] for k in kept], *[yb[k] for k in kept], gb])
        dots = dots + np.outer(own, own)
        slope = math.sqrt(dots[-1, -1])
        if step >= steps or (len(values) > 1 and abs(f - max(values)) <= TOLERANCE * f_first) or slope <= max(TOLERANCE * f, 1e-8):
            break
        try:
            w = _two_loops(dots, len(kept))
            db = float(w @ own)
            db = db if not signed or db * gb < 0 else 0.0
            dd, dg, xx, xd, d2, shift = m.all(("direction", step, kept, w, penalty, plain, signed))
            zd, dg = m.by_document(), dg + db * gb
            if signed:
                trials: dict[float, tuple] = {}

                def phi(t):
                    new_cost, along, new_offset = m.all(("move", step, t, penalty, plain, True))  # noqa: B023
                    nb = b + t * db  # noqa: B023
                    sign = np.sign(b) if b != 0 else np.sign(-gb)  # noqa: B023
                    nb = nb if np.sign(nb) == sign else 0.0
                    z = m.by_document()
                    v, s = value(z - new_offset + nb)
                    trials[t] = (z, nb, new_cost, new_offset, v + new_cost / 2, s)
                    return v + new_cost / 2, float(s @ zd) - s.sum() * shift + s.sum() * db + along  # noqa: B023

                far = backtracking(phi, f, dg, 0.5 / slope if step < 1 else 1.0, 0.1 if step < 1 else 0.5)
                if far != next(reversed(trials)):
                    phi(far)  # the weights of the step are those of the last trial
                new_margin, nb, cost, new_offset, f_new, r = trials[far]
            else:

                def phi(t):
                    v, s = value(margin + t * zd - offset - t * shift + b + t * db)  # noqa: B023
                    return v + (xx + 2 * t * xd + t * t * d2) / 2, float(s @ zd) + s.sum() * (db - shift) + xd + t * d2  # noqa: B023

                far = strong_wolfe(phi, 1 / math.sqrt(dd + db * db) if step < 1 else 1.0)
                if far * slope < 1e-10:
                    raise NoDescent
                new_margin, nb, new_offset = margin + far * zd, b + far * db, offset + far * shift
                f_new = phi(far)[0]
                r = value(new_margin - new_offset + nb)[1]
            fresh = False
        except NoDescent:
            if fresh:
                break
            m.forget(*[f"{c}{k}" for k in kept for c in "sy"])
            fresh, kept = True, []
            told = m.all(("products", step, kept))
            continue
        _save(f"{m.folder}/slope", r)
        step += 1
        new_kept = [step, *kept][:HISTORY]
        todo = [("gradient", step, penalty, plain, "trial"), ("products", step, new_kept)]
        told = m.all(*([] if signed else [("move", step - 1, far, penalty, plain, False)]), *todo)
        sb[step], yb[step] = nb - b, float(r.sum()) - gb
        m.forget(f"x{step - 1}", f"g{step - 1}", *[f"{c}{k}" for k in kept if k not in new_kept for c in "sy"])
        kept, margin, b, offset, gb = new_kept, new_margin, nb, new_offset, float(r.sum())
        values, f = [*values, f_new][-20:], f_new
    m.forget("d", "trial", "z", "x", f"x{step}", f"g{step}", *[f"{c}{k}" for k in kept for c in "sy"])
    return margin - offset + b


def _two_loops(dots: np.ndarray, h: int) -> np.ndarray:
    """Coefficients of the L-BFGS direction over the steps, the changes (newest first) and the gradient, from their dot products."""
    c, a = np.zeros(2 * h + 1), np.zeros(h)
    c[-1] = 1.0
    for i in range(h):
        a[i] = dots[i] @ c / dots[i, h + i]
        c[h + i] -= a[i]
    if h:
        if not dots[0, h] >= 0:
            raise NoDescent
        c *= dots[0, h] / dots[h, h]
    for i in reversed(range(h)):
        c[i] += a[i] - dots[h + i] @ c / dots[i, h + i]
    if not np.isfinite(c).all():
        raise NoDescent
    return -c
