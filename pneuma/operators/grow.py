"""Growth of random forests on binned rows (H10, H11, I3, I4): Spark ML's algorithm with trees dealt to tasks.

Spark ML adds up dense statistics of every node in every task and sends them at each pass: 15 KB for a node, also for one of ten rows, so
200 deep trees send tens of GB whatever the rows. Here the rows are binned once (a byte a value) and a task grows
whole trees, level by level, over all rows in blocks of bounded size; nothing but the grown nodes leaves it.

The growth is that of Spark ML's ``RandomForestClassifier``: at most ``BINS`` bins per feature with edges from about ``EDGE_ROWS`` rows
(all rows are trained on), Poisson(1) bags, the square root of the features drawn anew for each node, weighted Gini gain,
``min_leaf`` rows on each side, children of one prediction merged. Draws are hashes of (seed, tree, place), so a
task that is run again grows the same trees. Weights are those of the classes. One way for every number of rows: blocks are kept in
memory up to ``HELD_BYTES`` and read again for each level above that.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from ..tables import FEATURE_NAMES, RF_MIN_LEAF

BINS = 128
EDGE_ROWS = 1 << 14
PER_NODE = math.ceil(math.sqrt(len(FEATURE_NAMES)))
BLOCK_ROWS = 1 << 17
#: Bytes of binned rows that a task keeps; (row, tree) pairs that it grows at the same time, one tree at least.
HELD_BYTES = 192 << 20
PAIRS = 1 << 18
FLAT = ("tree int, node int, prediction double, impurity double, w0 double, w1 double, n long, gain double, left int, right int, "
        "feature int, threshold double")


def edges(x, weight) -> list:
    """Per feature the thresholds between its bins: all midpoints, or those nearest to equal shares of the weight."""
    import numpy as np
    out = []
    for column in x.T:
        value, which = np.unique(column, return_inverse=True)
        middle = (value[1:] + value[:-1]) / 2.0
        if len(middle) >= BINS:
            share = np.bincount(which, weights=weight).tolist()
            stride = sum(share) / BINS
            seen, target, kept = share[0], stride, []
            for i in range(1, len(share)):
                before, seen = seen, seen + share[i]
                if abs(before - target) < abs(seen - target):
                    kept.append(i - 1)
                    target += stride
            middle = middle[kept[:BINS - 1]]
        out.append(middle)
    return out


def binned(x, thresholds: list):
    """Bins (feature, row) as bytes: the number of thresholds below the value."""
    import numpy as np
    return np.stack([np.searchsorted(t, c, side="left") for t, c in zip(thresholds, x.T)]).astype(np.uint8)


def _hash(x):
    import numpy as np
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _bag(seed: int, trees, start: int, n: int):
    """Poisson(1) counts (tree, row) of the rows from ``start`` on."""
    import numpy as np
    below = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(16)])
    row = _hash(np.arange(start, start + n, dtype=np.uint64))
    key = _hash(trees.astype(np.uint64) * np.uint64(2) + _hash(np.uint64(seed)))
    return np.stack([np.searchsorted(below, (_hash(row ^ k) >> np.uint64(11)) * 2.0 ** -53, side="right") for k in key]).astype(np.uint8)


def _drawn(seed: int, tree, place):
    """For each node the ``PER_NODE`` features that its test may take."""
    import numpy as np
    with np.errstate(over="ignore"):
        node = _hash(_hash(tree.astype(np.uint64) * np.uint64(2) + np.uint64(1) + _hash(np.uint64(seed))) ^ _hash(place))
        draw = _hash(node[:, None] + np.arange(len(FEATURE_NAMES), dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93))
    return np.argsort(draw, axis=1)[:, :PER_NODE]


def _best(cell, n0, n1, t0, t1, weight, min_leaf: int):
    """(slots, cells) of the best test of each slot that has one with a gain, and the gains; cells are sorted (slot, draw, bin)."""
    import numpy as np
    group = cell // BINS
    slot = group // PER_NODE
    first = np.flatnonzero(np.diff(group, prepend=-1))
    size = np.diff(np.append(first, len(group)))
    c0, c1 = np.cumsum(n0), np.cumsum(n1)
    l0, l1 = c0 - np.repeat(c0[first] - n0[first], size), c1 - np.repeat(c1[first] - n1[first], size)
    at = np.flatnonzero((l0 + l1 >= min_leaf) & ((t0 + t1)[slot] - l0 - l1 >= min_leaf))
    slot, l0, l1 = slot[at], l0[at] * weight[0], l1[at] * weight[1]
    if not len(at):
        return slot, at, l0
    w0, w1 = (t0 * weight[0])[slot], (t1 * weight[1])[slot]
    r0, r1 = w0 - l0, w1 - l1
    # Gini: the weight of a node times its impurity is w - (w0^2 + w1^2) / w
    gain = ((l0 * l0 + l1 * l1) / (l0 + l1) + (r0 * r0 + r1 * r1) / (r0 + r1) - (w0 * w0 + w1 * w1) / (w0 + w1)) / (w0 + w1)
    begin = np.flatnonzero(np.diff(slot, prepend=-1))
    top = np.repeat(np.maximum.reduceat(gain, begin), np.diff(np.append(begin, len(slot))))
    hit = np.flatnonzero(gain == top)
    slots, one = np.unique(slot[hit], return_index=True)
    hit = hit[one]
    some = gain[hit] > 1e-12
    return slots[some], at[hit[some]], gain[hit[some]]


def grow(blocks: Callable[[], Iterable], rows: int, trees, seed: int, weight, thresholds: list, max_depth: int,
         min_leaf: int = RF_MIN_LEAF) -> dict:
    """Nodes of the trees (numbers) over the blocks (bins, labels) of ``rows`` rows: arrays by the names of ``FLAT``.

    Nodes of a tree are numbered level by level from its root, 0.
    """
    import numpy as np
    trees, k = np.asarray(trees, dtype=np.int64), len(trees)
    wide = max(len(t) for t in thresholds) + 1
    table = np.full((len(thresholds), wide), np.nan)
    for f, t in enumerate(thresholds):
        table[f, :len(t)] = t
    bag = np.empty((k, rows), dtype=np.uint8)
    slot = np.full((k, rows), -1, dtype=np.int32)
    total = np.zeros((2, k))
    at = 0
    for _, y in blocks():
        n = len(y)
        bag[:, at:at + n] = _bag(seed, trees, at, n)
        for c in (0, 1):
            total[c] += bag[:, at:at + n][:, y == c].sum(axis=1)
        at += n
    slot[bag > 0] = 0
    slot += np.where(slot == 0, np.arange(k, dtype=np.int32)[:, None], 0)
    levels = []
    tree, place, t0, t1 = np.arange(k), np.ones(k, dtype=np.uint64), total[0], total[1]
    node = np.arange(k)  # of each slot
    made = k
    level = {"tree": tree, "t0": t0, "t1": t1}
    route = None
    for depth in range(max_depth + 1):
        s = len(node)
        count = len(level["tree"])
        level |= {"left": np.full(count, -1), "right": np.full(count, -1), "feature": np.full(count, -1),
                  "threshold": np.full(count, np.nan), "gain": np.full(count, -1.0)}
        levels.append(level)
        if depth == max_depth or not s:
            break
        drawn = _drawn(seed, trees[tree], place)
        cells, at, found = None, 0, None
        for bins, y in blocks():
            n = len(y)
            flat = bins.reshape(-1)
            own = slot[:, at:at + n]
            live = np.flatnonzero(own >= 0)
            of = own.reshape(-1)[live] if k > 1 else own[0][live]
            r = live % n if k > 1 else live
            if route is not None:
                feature, cut, to_left, to_right = route
                of = np.where(flat[feature[of] * n + r] <= cut[of], to_left[of], to_right[of])
                if k > 1:
                    own[live // n, r] = of
                else:
                    own[0][live] = of
                stay = of >= 0
                live, of, r = live[stay], of[stay], r[stay]
            c = bag[:, at:at + n].reshape(-1)[live].astype(np.float64) if k > 1 else bag[0, at:at + n][live].astype(np.float64)
            up = y[r]
            sparse = n == rows and s * PER_NODE * BINS > 20 * len(of)
            if not sparse and cells is None:
                cells = np.zeros(s * PER_NODE * BINS * 2)
            keys = []
            base = of.astype(np.int64) * PER_NODE
            for j in range(PER_NODE):
                key = (base + j) * BINS + flat[drawn[of, j] * n + r]
                if sparse:
                    keys.append(key)
                else:
                    cells += np.bincount(key * 2 + up, weights=c, minlength=len(cells))
            if sparse:
                name, which = np.unique(np.concatenate(keys), return_inverse=True)
                both = np.tile(c, PER_NODE)
                n1 = np.bincount(which, weights=both * np.tile(up, PER_NODE), minlength=len(name))
                found = name, np.bincount(which, weights=both, minlength=len(name)) - n1, n1
            at += n
        if found is None:
            pair = cells.reshape(-1, 2)
            name = np.flatnonzero(pair.any(axis=1))
            found = name, pair[name, 0], pair[name, 1]
            del cells, pair
        name, n0, n1 = found
        split, hit, gain = _best(name, n0, n1, t0, t1, weight, min_leaf)
        cell = name[hit]
        group, cut = cell // BINS, cell % BINS
        feature = drawn[split, group % PER_NODE]
        # the counts left of a test are those of its bins up to the cut
        start = np.searchsorted(name, group * BINS)
        c0, c1 = np.append(0.0, np.cumsum(n0)), np.append(0.0, np.cumsum(n1))
        l0, l1 = c0[hit + 1] - c0[start], c1[hit + 1] - c1[start]
        r0, r1 = t0[split] - l0, t1[split] - l1
        m = len(split)
        level["feature"][node[split] - (made - count)] = feature
        level["threshold"][node[split] - (made - count)] = table[feature, cut]
        level["gain"][node[split] - (made - count)] = gain
        level["left"][node[split] - (made - count)] = made + 2 * np.arange(m)
        level["right"][node[split] - (made - count)] = made + 2 * np.arange(m) + 1
        child = made + np.arange(2 * m)
        below = tree[split]
        t0, t1 = np.stack([l0, r0], 1).reshape(-1), np.stack([l1, r1], 1).reshape(-1)
        level = {"tree": np.repeat(below, 2), "t0": t0, "t1": t1}
        under = np.stack([place[split] * np.uint64(2), place[split] * np.uint64(2) + np.uint64(1)], 1).reshape(-1)
        goes_on = (t0 > 0) & (t1 > 0) & (t0 + t1 >= 2 * min_leaf) & (depth + 1 < max_depth)
        number = np.where(goes_on, np.cumsum(goes_on) - 1, -1).astype(np.int32)
        route = (np.zeros(s, dtype=np.int64), np.zeros(s, dtype=np.int64), np.full(s, -1, np.int32), np.full(s, -1, np.int32))
        route[0][split], route[1][split] = feature, cut
        route[2][split], route[3][split] = number[0::2], number[1::2]
        node, tree, place, t0, t1 = child[goes_on], level["tree"][goes_on], under[goes_on], t0[goes_on], t1[goes_on]
        made += 2 * m
    return _finished(levels, trees, weight)


def _finished(levels: list, trees, weight) -> dict:
    """Levels as node arrays: leaves of one prediction below a node are merged, and nodes numbered per tree."""
    import numpy as np
    x = {c: np.concatenate([v[c] for v in levels]) for c in levels[0]}
    ends = np.cumsum([len(v["tree"]) for v in levels])
    spans = list(zip(np.append(0, ends[:-1]).tolist(), ends.tolist()))
    w0, w1 = x["t0"] * weight[0], x["t1"] * weight[1]
    says = (w1 > w0).astype(np.float64)
    inner = x["left"] >= 0
    for a, b in reversed(spans):
        i = a + np.flatnonzero(inner[a:b])
        lo, hi = x["left"][i], x["right"][i]
        same = ~inner[lo] & ~inner[hi] & (says[lo] == says[hi])
        inner[i[same]] = False
        says[i[same]] = says[lo[same]]
    keep = np.zeros(len(w0), dtype=bool)
    keep[slice(*spans[0])] = True
    for a, b in spans:
        i = a + np.flatnonzero(inner[a:b] & keep[a:b])
        keep[x["left"][i]] = keep[x["right"][i]] = True
    # numbers within the tree, level by level
    kept = np.flatnonzero(keep)
    order = kept[np.argsort(x["tree"][kept], kind="stable")]
    first = np.flatnonzero(np.diff(x["tree"][order], prepend=-1))
    number = np.full(len(w0), -1)
    number[order] = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    i, on = order, inner[order]
    w = w0[i] + w1[i]
    safe = np.where(w > 0, w, 1.0)
    return {"tree": trees[x["tree"][i]], "node": number[i], "prediction": says[i],
            "impurity": np.where(w > 0, 1.0 - (w0[i] ** 2 + w1[i] ** 2) / safe ** 2, 0.0), "w0": w0[i], "w1": w1[i],
            "n": (x["t0"] + x["t1"])[i].astype(np.int64), "gain": np.where(on, x["gain"][i], -1.0),
            "left": np.where(on, number[x["left"][i]], -1), "right": np.where(on, number[x["right"][i]], -1),
            "feature": np.where(on, x["feature"][i], -1), "threshold": np.where(on, x["threshold"][i], np.nan)}


def as_batch(nodes: dict, **more):
    """Arrow batch of node arrays in the columns of ``FLAT``; a leaf has no threshold."""
    import numpy as np
    import pyarrow as pa
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    cols, names = [], []
    for field in FLAT.split(", "):
        name, kind = field.split(" ")
        mask = np.isnan(nodes[name]) if name == "threshold" else None
        cols.append(pa.array(nodes[name].astype(kinds[kind].to_pandas_dtype()), kinds[kind], mask=mask))
        names.append(name)
    return pa.RecordBatch.from_arrays([*more.values(), *cols], names=[*more, *names])


def grow_all(blocks: Callable[[], Iterable], rows: int, trees: list[int], seed: int, weight, thresholds: list, max_depth: int):
    """Node arrays of the trees, as many trees at a time as ``PAIRS`` allows."""
    at_once = max(1, PAIRS // max(rows, 1))
    for i in range(0, len(trees), at_once):
        yield grow(blocks, rows, trees[i:i + at_once], seed, weight, thresholds, max_depth)


def _read(fs, base: str, file: str, n: int):
    import numpy as np
    with fs.open_input_stream(f"{base}/{file}") as f:
        raw = np.frombuffer(f.read(), dtype=np.uint8)
    return raw[:-n].reshape(-1, n), raw[-n:]


def _joined(parts: Iterable) -> list:
    """Blocks of about ``BLOCK_ROWS`` rows from smaller ones, in their order."""
    import numpy as np
    out, held, n = [], [], 0
    for bins, y in parts:
        held.append((bins, y))
        n += len(y)
        if n >= BLOCK_ROWS:
            out.append(held)
            held, n = [], 0
    if held:
        out.append(held)
    return [(np.ascontiguousarray(np.concatenate([b for b, _ in g], axis=1)), np.concatenate([y for _, y in g])) for g in out]


def numbers(table, columns: list[str]):
    """Arrow columns as a matrix of doubles (row, column); null is NaN."""
    import numpy as np
    import pyarrow.compute as pc
    return np.stack([pc.cast(table.column(table.schema.get_field_index(c)), "float64").to_numpy(zero_copy_only=False) for c in columns], axis=1)


def labels(values):
    import numpy as np
    y = np.asarray(values, dtype=np.float64)
    if not np.isin(y, (0.0, 1.0)).all():
        raise ValueError("labels of a forest are 0 and 1")
    return y.astype(np.uint8)


def class_weights(y, weight) -> list[float]:
    """The weight of each class; rows of a class have the same weight."""
    out = []
    for c in (0, 1):
        w = weight[y == c]
        if len(w) and abs(w.max() - w.min()) > 1e-9 * abs(w.max()):
            raise ValueError("weights differ inside a class")
        out.append(float(w[0]) if len(w) else 0.0)
    return out


def forest_nodes(df, rows: int, path: str, num_trees: int, max_depth: int, seed: int, at_once: int = 1):
    """Nodes (``FLAT``) of a forest grown on ``df`` (features, symptom_label, weight) of ``rows`` rows; binned rows go to ``path``."""
    from pyspark.sql import functions as F

    from ..session import ship
    spark = df.sparkSession
    ship(spark)
    x = df.select(*FEATURE_NAMES, F.col("symptom_label").cast("int").alias("symptom_label"), F.col("weight").cast("double").alias("weight"),
                  F.xxhash64(*[c for c in (*FEATURE_NAMES, "event_id") if c in df.columns]).alias("_h"))
    some = x.where(F.pmod("_h", F.lit(1 << 30)) < int((1 << 30) * min(1.0, EDGE_ROWS / max(rows, 1)))) if rows > EDGE_ROWS else x
    some = some.drop("_h").toArrow()
    thresholds = edges(numbers(some, FEATURE_NAMES), numbers(some, ["weight"])[:, 0])
    width = len(FEATURE_NAMES)

    def write(it):
        import uuid

        import numpy as np
        import pyarrow as pa
        import pyarrow.fs as pfs
        from pyspark import TaskContext
        fs, base = pfs.FileSystem.from_uri(path)
        part, attempt, out, held, n = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], [], [], 0

        def close():
            nonlocal held, n
            bins = np.concatenate([b for b, _, _ in held], axis=1)
            y, w = (np.concatenate([h[i] for h in held]) for i in (1, 2))
            fs.create_dir(base, recursive=True)
            file = f"rows-{part:06d}-{len(out):06d}-{attempt}.bins"
            with fs.open_output_stream(f"{base}/{file}") as f:
                f.write(np.ascontiguousarray(bins).tobytes())
                f.write(y.tobytes())
            by = [w[y == c] for c in (0, 1)]
            out.append((part, len(out), file, len(y), *(float(v.min()) if len(v) else None for v in by),
                        *(float(v.max()) if len(v) else None for v in by)))
            held, n = [], 0

        for batch in it:
            if not batch.num_rows:
                continue
            held.append((binned(numbers(batch, FEATURE_NAMES), thresholds), labels(batch.column(width)), np.asarray(batch.column(width + 1))))
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                close()
        if held:
            close()
        if out:
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64()] + [pa.float64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                             names=["part", "seq", "file", "n", "lo0", "lo1", "hi0", "hi1"])

    rows_in = x.drop("_h")
    parts = max(1, -(-rows // BLOCK_ROWS))
    if rows_in.rdd.getNumPartitions() > parts:
        rows_in = rows_in.coalesce(parts)
    files = sorted(tuple(r) for r in rows_in.mapInArrow(
        write, "part int, seq int, file string, n long, lo0 double, lo1 double, hi0 double, hi1 double").collect())  # a row per block
    weight = []
    for c in (0, 1):
        seen = [(r[4 + c], r[6 + c]) for r in files if r[4 + c] is not None]
        lo, hi = min((a for a, _ in seen), default=0.0), max((b for _, b in seen), default=0.0)
        if hi - lo > 1e-9 * abs(hi):
            raise ValueError("weights differ inside a class")
        weight.append(hi)
    names, rows = [(r[2], r[3]) for r in files], sum(r[3] for r in files)
    tasks = max(1, min(num_trees, 4 * spark.sparkContext.defaultParallelism // at_once))

    def run(it):
        import pyarrow.fs as pfs
        fs, base = pfs.FileSystem.from_uri(path)
        if rows * (width + 1) <= HELD_BYTES:
            held = _joined(_read(fs, base, f, n) for f, n in names)
            blocks = lambda: held
        else:
            blocks = lambda: (_read(fs, base, f, n) for f, n in names)
        for batch in it:
            for t in batch.column(0).to_pylist():
                mine = list(range(num_trees * t // tasks, num_trees * (t + 1) // tasks))
                for nodes in grow_all(blocks, rows, mine, seed, weight, thresholds, max_depth):
                    yield as_batch(nodes)

    return spark.range(0, tasks, 1, tasks).mapInArrow(run, FLAT)


def user_schema(kind: str) -> str:
    """Columns of ``fit_user``: grown nodes (is_node), and the user's test rows with their scores."""
    return f"user_id {kind}, is_node boolean, {FLAT}, label int, score double"


def fit_user(table, user, num_trees: int, max_depth: int, seed: int):
    """One user's forest: an Arrow table of its nodes, and of its test rows' labels and scores.

    ``table``: the user's rows (event_id, features, symptom_label, weight, is_test); their order does not matter.
    """
    import numpy as np
    import pyarrow as pa

    from .forest_table import arrays, walk
    x, y = numbers(table, FEATURE_NAMES), labels(table.column("symptom_label"))
    key = numbers(table, ["event_id"])[:, 0]
    by = np.lexsort((y, *x.T, key))
    x, y, test, weight = x[by], y[by], np.asarray(table.column("is_test"))[by].astype(bool), np.asarray(table.column("weight"))[by]
    xt, yt, wt = x[~test], y[~test], weight[~test]
    n = len(yt)
    some = _hash(np.arange(n, dtype=np.uint64)) % np.uint64(1 << 30) < (1 << 30) * min(1.0, EDGE_ROWS / max(n, 1))
    thresholds = edges(xt[some], wt[some])
    bins = binned(xt, thresholds)
    held = [(np.ascontiguousarray(bins[:, i:i + BLOCK_ROWS]), yt[i:i + BLOCK_ROWS]) for i in range(0, n, BLOCK_ROWS)]
    parts = [as_batch(g) for g in grow_all(lambda: held, n, list(range(num_trees)), seed, class_weights(yt, wt), thresholds, max_depth)]
    nodes = pa.Table.from_batches(parts)
    whole = pa.array(np.asarray(nodes.column("w1")) / (np.asarray(nodes.column("w0")) + np.asarray(nodes.column("w1"))))
    p = walk(arrays(nodes.append_column("p", whole)), x[test], max_depth)
    kind = table.schema.field("user_id").type
    tests = len(p)
    out = nodes.append_column("label", pa.nulls(len(nodes), pa.int32())).append_column("score", pa.nulls(len(nodes), pa.float64()))
    out = out.add_column(0, "is_node", pa.array(np.ones(len(nodes), dtype=bool)))
    more = pa.table({f.name: pa.nulls(tests, f.type) for f in out.schema} | {
        "is_node": pa.array(np.zeros(tests, dtype=bool)), "label": pa.array(y[test], pa.int32()), "score": pa.array(p, pa.float64())})
    out = pa.concat_tables([out, more])
    return out.add_column(0, "user_id", pa.array([user] * len(out), kind))


def write_model(nodes, path: str, estimator, num_trees: int) -> None:
    """The forest of ``nodes`` (``FLAT``) in Spark ML's stored form of what ``estimator`` (a RandomForestClassifier) would fit."""
    import json
    import time

    from pyspark.sql import functions as F
    spark = nodes.sparkSession
    own = {p.name: v for p, v in estimator._paramMap.items()}
    default = {p.name: v for p, v in estimator._defaultParamMap.items()}
    kind = "org.apache.spark.ml.classification."
    base = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
    forest = {"class": f"{kind}RandomForestClassificationModel", **base, "uid": estimator.uid, "paramMap": own, "defaultParamMap": default,
              "numFeatures": len(FEATURE_NAMES), "numClasses": 2, "numTrees": num_trees}
    of_tree = ("featuresCol", "labelCol", "maxBins", "maxDepth", "maxMemoryInMB", "minInstancesPerNode", "weightCol", "cacheNodeIds",
               "checkpointInterval", "impurity", "leafCol", "minInfoGain", "minWeightFractionPerNode", "predictionCol", "probabilityCol",
               "rawPredictionCol", "seed")
    one = {"class": f"{kind}DecisionTreeClassificationModel", **base, "paramMap": {k: v for k, v in own.items() if k in of_tree},
           "defaultParamMap": {k: v for k, v in default.items() if k in of_tree}}
    spark.createDataFrame([(json.dumps(forest),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame([(t, json.dumps({**one, "uid": f"dtc_{estimator.uid[-12:]}_{t}"}), 1.0) for t in range(num_trees)],
                          "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    split = F.struct(F.col("feature").alias("featureIndex"), F.when(F.col("feature") >= 0, F.array("threshold")).otherwise(
        F.array().cast("array<double>")).alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    data = F.struct(F.col("node").alias("id"), "prediction", "impurity", F.array("w0", "w1").alias("impurityStats"), F.col("n").alias("rawCount"),
                    "gain", F.col("left").alias("leftChild"), F.col("right").alias("rightChild"), split.alias("split"))
    nodes.select(F.col("tree").alias("treeID"), data.alias("nodeData")).write.parquet(f"{path}/data")
