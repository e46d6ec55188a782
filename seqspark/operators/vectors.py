"""Distances and weights of vectors, for tables of rows with equal-length arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def distance(a: Column, b: Column, metric: str = "euclid", weight: Column | None = None) -> Column:
    """Distance of two arrays under per-place weights; places with a null on either side are left out.

    euclid and cityblock are weighted means over the places used; correlation metrics are 1 - r, the
    absolute ones 1 - |r|, uncentred ones take means as zero; spearman is 1 - r of the ranks (equal values
    share their mean rank), kendall 1 - tau, both without weights."""
    w = weight if weight is not None else F.transform(a, lambda _: F.lit(1.0))
    rows = F.filter(F.arrays_zip(a.alias("a"), b.alias("b"), w.alias("w")), lambda t: t["a"].isNotNull() & t["b"].isNotNull())
    rows = F.transform(rows, lambda t: F.struct(t["a"].cast("double").alias("a"), t["b"].cast("double").alias("b"), t["w"].cast("double").alias("w")))
    return _let(rows, lambda own: _distance(own, metric))


def _distance(rows: Column, metric: str) -> Column:
    of = lambda f: _sum(F.transform(rows, lambda t: f(t["a"], t["b"]) * t["w"]))
    if metric in ("euclid", "cityblock"):
        return F.try_divide(of((lambda x, y: (x - y) * (x - y)) if metric == "euclid" else (lambda x, y: F.abs(x - y))), of(lambda x, y: F.lit(1.0)))
    if metric == "kendall":
        return 1 - kendall_tau(rows)
    if metric == "spearman":
        ranked = _let(F.transform(rows, lambda t: t["a"]), lambda x: _let(F.transform(rows, lambda t: t["b"]), lambda y: F.arrays_zip(ranks(x).alias("a"), ranks(y).alias("b"))))
        return _let(F.transform(ranked, lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), F.lit(1.0).alias("w"))), lambda own: _distance(own, "correlation"))
    mean = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    if "uncentred" not in metric:
        total = of(lambda x, y: F.lit(1.0))
        mean = F.struct((of(lambda x, y: x) / total).alias("a"), (of(lambda x, y: y) / total).alias("b"))
    r = _let(mean, lambda m: of(lambda x, y: (x - m["a"]) * (y - m["b"])) / F.sqrt(of(lambda x, y: (x - m["a"]) * (x - m["a"])) * of(lambda x, y: (y - m["b"]) * (y - m["b"]))))
    return 1 - (F.abs(r) if "absolute" in metric else r)


def ranks(values: Column) -> Column:
    """Ranks from 1 on; equal values share their mean rank."""
    below = lambda v: F.size(F.filter(values, lambda w: w < v))
    same = lambda v: F.size(F.filter(values, lambda w: w == v))
    return F.transform(values, lambda v: (below(v) + (same(v) + 1) / 2).cast("double"))


def kendall_tau(rows: Column) -> Column:
    """Concordant less discordant pairs of rows(a, b) over the root of the pairs untied on either side."""
    of = lambda f: _sum(F.transform(rows, lambda s, i: _sum(F.transform(F.slice(rows, F.lit(1), i), lambda t: f(F.signum(s["a"] - t["a"]), F.signum(s["b"] - t["b"]))))))
    return F.try_divide(of(lambda u, v: u * v), F.sqrt(of(lambda u, v: F.abs(u)) * of(lambda u, v: F.abs(v))))


def kmeans(df: DataFrame, key: str, vec: str, k: int, seed: int = 1, rounds: int = 50) -> tuple[DataFrame, DataFrame]:
    """((key, cluster, dist), (cluster, centre)): k-means under Euclidean distance, clusters from 1 on; vectors
    that are null or hold nulls are left out."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.where(F.col(vec).isNotNull() & ~F.exists(vec, lambda x: x.isNull())).select(key, vec, array_to_vector(F.col(vec).cast("array<double>")).alias("__v"))
    model = KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="__v", predictionCol="__c").fit(rows)
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters(), 1)]
    table = df.sparkSession.createDataFrame(centres, "cluster int, centre array<double>")
    placed = model.transform(rows).select(key, vec, (F.col("__c") + 1).alias("cluster")).join(F.broadcast(table), "cluster")  # k rows
    return placed.select(key, "cluster", distance(F.col(vec), F.col("centre")).alias("dist")), table


def singular_values(df: DataFrame, vec: str) -> DataFrame:
    """(k, value, direction): singular values of the matrix of vectors, largest first, with their right directions.

    Products of columns are summed over all rows, map-side first; only that square table, whose side is the
    vectors' length, reaches the driver."""
    import numpy as np

    def products(batches):
        import pandas as pd

        total = None
        for pdf in batches:
            x = np.stack(pdf["v"].to_list()).astype(float)
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": total.ravel()}).astype({"i": "int32", "j": "int32"})

    rows = df.where(F.col(vec).isNotNull() & ~F.exists(vec, lambda x: x.isNull())).select(F.col(vec).cast("array<double>").alias("v"))
    sums = rows.mapInPandas(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    n = 1 + max((r["i"] for r in sums), default=-1)
    gram = np.zeros((n, n))
    for r in sums:
        gram[r["i"], r["j"]] = r["s"]
    value, direction = np.linalg.eigh(gram)
    out = [(k + 1, float(np.sqrt(max(0.0, value[n - 1 - k]))), [float(x) for x in direction[:, n - 1 - k]]) for k in range(n)]
    return df.sparkSession.createDataFrame(out, "k int, value double, direction array<double>")


def cluster_means(df: DataFrame, label: str, vec: str) -> DataFrame:
    """(label, mean array, n): place by place, summed map-side."""
    rows = df.select(label, F.posexplode(vec).alias("k", "x")).groupBy(label, "k").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    return rows.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("p"), F.max("n").alias("n")).select(label, F.transform("p", lambda p: p["m"]).alias("mean"), "n")


def mean_distances(means: DataFrame, label: str, metric: str = "euclid") -> DataFrame:
    """(a, b, dist) between cluster means; one row per cluster on either side."""
    left, right = means.select(F.col(label).alias("a"), F.col("mean").alias("x")), means.select(F.col(label).alias("b"), F.col("mean").alias("y"))
    return left.join(right, F.col("a") < F.col("b")).select("a", "b", distance(F.col("x"), F.col("y"), metric).alias("dist"))


#: Vectors of a tile; numbers of pairs worked on at once.
TILE, CELLS = 512, 1 << 20


def _pairwise(x, y, metric: str):
    """Matrix of distances of the rows of two arrays without nulls."""
    import numpy as np

    if metric == "euclid":
        d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T
        # The product loses digits of small distances: those are worked out from differences.
        close = np.argwhere(d < 1e-6 * ((x * x).sum(1)[:, None] + (y * y).sum(1)[None]))
        for at in range(0, len(close), 4096):
            i, j = close[at : at + 4096].T
            d[i, j] = ((x[i] - y[j]) ** 2).sum(1)
        return np.maximum(d, 0) / x.shape[1]
    if metric == "cityblock":
        out = np.empty((len(x), len(y)))
        step = max(1, CELLS // max(1, y.size))
        for at in range(0, len(x), step):
            out[at : at + step] = np.abs(x[at : at + step, None] - y[None]).mean(2)
        return out
    if metric == "kendall":
        sign = lambda a: np.sign(a[:, :, None] - a[:, None, :]).reshape(len(a), -1)
        return 1 - _cosine(sign(x), sign(y))
    if metric == "spearman":
        x, y = _rank_rows(x), _rank_rows(y)
    if "uncentred" not in metric:
        x, y = x - x.mean(1, keepdims=True), y - y.mean(1, keepdims=True)
    r = _cosine(x, y)
    return 1 - (np.abs(r) if "absolute" in metric else r)


def _cosine(x, y):
    import numpy as np

    return x @ y.T / np.sqrt((x * x).sum(1)[:, None] * (y * y).sum(1)[None])


def _rank_rows(x):
    import numpy as np

    out = np.empty(x.shape)
    for i, row in enumerate(x):
        _, slot, count = np.unique(row, return_inverse=True, return_counts=True)
        out[i] = (np.cumsum(count) - (count - 1) / 2)[slot]
    return out


def _whole(df: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, x) of vectors without nulls."""
    rows = df.where(F.col(vec).isNotNull() & ~F.exists(vec, lambda x: x.isNull()))
    return rows.select(F.col(key).alias("key"), F.col(vec).cast("array<double>").alias("x"))


def _tiled(rows: DataFrame, name: str, *by: str) -> DataFrame:
    """rows(by, key, x) as rows (by, tile, name) of about TILE vectors, dealt by a hash of the key."""
    n = rows.count()
    tile = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-n // TILE)))).cast("int")
    return rows.groupBy(*by, tile.alias("tile")).agg(F.collect_list(F.struct("key", "x")).alias(name))


def _matrix(items):
    import numpy as np

    keys = np.array([r["key"] for r in items])
    return keys, np.array([r["x"] for r in items], dtype=float)


def nearest(df: DataFrame, queries: DataFrame, key: str, vec: str, k: int, metric: str = "euclid") -> DataFrame:
    """(a, rank, b, dist): for each row a of queries its k nearest rows b of df with another key, equal distances by key.

    A stated set of queries meets all rows in blocks: tiles of queries go to every tile of rows, a product of two
    tiles is one matrix, and k rows a query leave it. Vectors that are null or hold nulls are left out; weights
    and places that are missing on one side are those of distance()."""
    import numpy as np
    import pandas as pd

    left = _tiled(_whole(queries, key, vec), "left").withColumnRenamed("tile", "i")
    right = _tiled(_whole(df, key, vec), "right")

    def best(batches):
        for pdf in batches:
            for one, two in zip(pdf["left"], pdf["right"], strict=True):
                (a, x), (b, y) = _matrix(one), _matrix(two)
                d = np.round(_pairwise(x, y, metric), 12)
                d[a[:, None] == b[None]] = np.inf
                order = np.lexsort((np.broadcast_to(b, d.shape), d), axis=1)[:, :k]
                own = np.take_along_axis(d, order, 1)
                p, q = np.nonzero(np.isfinite(own))
                yield pd.DataFrame({"a": a[p], "b": b[order[p, q]], "dist": own[p, q]})

    kind = dict(df.dtypes)[key]
    pairs = left.crossJoin(right).select("left", "right").mapInPandas(best, f"a {kind}, b {kind}, dist double")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("a").orderBy("dist", "b"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("a", "rank", "b", "dist")


def within(df: DataFrame, key: str, vec: str, cutoff: float) -> DataFrame:
    """(a, b, dist): ordered pairs of rows of different keys whose mean squared difference is below cutoff.

    A similarity join that prunes by pivot distance: by the triangle inequality two vectors closer than
    r = sqrt(cutoff x length) have norms that differ by less than r, and so have their distances to any fixed pivot.
    Rows are dealt into cells of width r by norm and by distance to two pivots; a row meets the cells around its
    own, and pairs of a cell are compared exactly. No pair is lost. Cells with many vectors are cut
    into tiles."""
    import numpy as np
    import pandas as pd

    rows = _whole(df, key, vec)
    size = rows.agg(F.max(F.size("x"))).first()[0] or 0
    r = float(np.sqrt(cutoff * size)) or 1.0
    rng = np.random.default_rng(3)
    pivots = [np.zeros(size), *(rng.normal(size=size) for _ in range(2))]
    far = lambda p: F.sqrt(_sum(F.transform(F.arrays_zip(F.col("x").alias("u"), F.lit(p.tolist()).alias("v")), lambda t: (t["u"] - t["v"]) * (t["u"] - t["v"]))))
    cell = F.array(*(F.floor(far(p) / (r * (1 + 1e-9))) for p in pivots))
    rows = rows.withColumn("cell", cell)
    counts = rows.groupBy("cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    rows = rows.join(counts, "cell").withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    tiles = rows.groupBy("cell", "tile").agg(F.collect_list(F.struct("key", "x")).alias("items"))
    steps = F.array(*(F.array(*(F.lit(v) for v in s)) for s in np.ndindex(3, 3, 3)))
    near = tiles.select(F.col("items").alias("left"), F.explode(F.transform(steps, lambda s: F.zip_with("cell", s, lambda c, x: c + x - 1))).alias("cell"))
    pairs = near.join(tiles.select("cell", F.col("items").alias("right")), "cell").select("left", "right")

    def close(batches):
        for pdf in batches:
            for one, two in zip(pdf["left"], pdf["right"], strict=True):
                (a, x), (b, y) = _matrix(one), _matrix(two)
                d = _pairwise(x, y, "euclid")
                i, j = np.nonzero((d < cutoff) & (a[:, None] != b[None]))
                yield pd.DataFrame({"a": a[i], "b": b[j], "dist": d[i, j]})

    kind = dict(df.dtypes)[key]
    return pairs.mapInPandas(close, f"a {kind}, b {kind}, dist double")


#: Bytes of the vectors of a block, as doubles; rows of the tiles that a pair of blocks is worked out in.
BLOCK_BYTES, STEP = 32 << 20, 512


def _block_pairs(rows: DataFrame, work, schema: str) -> DataFrame:
    """work(keys, x, keys, y) over rows(key, x) against themselves, as a table of its record batches.

    Vectors are dealt to blocks by a hash of their key and packed as bytes; every two blocks, and every block with itself (then the second
    keys and y are None), are one task, which holds these two. The number of blocks grows with the bytes, and so
    does what is shuffled: a vector goes to every block. Equal keys are in one block."""
    import numpy as np
    import pyarrow as pa

    rows = rows.where(F.size("x") > 0)
    seen = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("size")).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-seen["n"] * (seen["size"] or 0) * 8 // BLOCK_BYTES), min(-(-seen["n"] // STEP), int(np.ceil(np.sqrt(6 * cores)))))
    kind, item = (rows.schema[c].dataType.simpleString() for c in ("key", "x"))
    dtype = np.float32 if item == "array<float>" else np.float64
    own = rows.select("key", "x" if dtype is np.float32 else F.col("x").cast("array<double>").alias("x"), F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"))

    def pack(batches):
        for batch in batches:
            if not len(batch):
                continue
            x, block = batch.column("x"), batch.column("block").to_numpy()
            if len(np.unique(x.value_lengths().to_numpy())) > 1:
                raise ValueError("vectors must have one length")
            values = x.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(batch), -1)
            order = np.argsort(block, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(block[order]) > 0))
            bounds = np.append(starts, len(batch))
            keys = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), batch.column("key").take(pa.array(order)))
            data = [values[order[i:j]].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(block[order[starts]]), keys, pa.array(data, pa.binary())], names=["block", "keys", "data"])

    packed = own.mapInArrow(pack, f"block int, keys array<{kind}>, data binary")
    side = lambda o: F.struct((F.least("block", o) * blocks + F.greatest("block", o)).alias("pair"), (F.col("block") <= o).alias("left"))
    dealt = packed.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), side)).alias("to"), "keys", "data").select("to.pair", "to.left", "keys", "data")
    dealt = dealt.repartitionByRange(blocks * (blocks + 1) // 2, "pair").sortWithinPartitions("pair")

    def run(batches):
        held, last = [], None

        def done():
            (a, x), (b, y) = (joined(held, left) for left in (True, False))
            held.clear()
            if a is not None and (b is not None or last % (blocks + 1) == 0):
                yield from work(a, x, b, y)

        for batch in batches:
            for k, (pair, left) in enumerate(zip(batch.column("pair").to_pylist(), batch.column("left").to_pylist(), strict=True)):
                if pair != last and held:
                    yield from done()
                last = pair
                held.append((left, batch.column("keys").slice(k, 1).flatten(), batch.column("data")[k].as_py()))
        if held:
            yield from done()

    def joined(held, left):
        own = [(k, d) for side, k, d in held if side == left]
        if not own:
            return None, None
        keys = pa.concat_arrays([k for k, _ in own])
        return keys, np.frombuffer(b"".join(d for _, d in own), dtype).reshape(len(keys), -1).astype(float)

    return dealt.mapInArrow(run, schema)


def density_weights(df: DataFrame, key: str, vec: str, cutoff: float, exponent: float) -> DataFrame:
    """(key, weight): 1 over the sum of (1 - d / cutoff) ** exponent over all vectors closer than cutoff, itself included.

    Every pair is worked out once, in tiles of one product each; of two blocks a number for each vector leaves the task."""
    import numpy as np
    import pyarrow as pa

    def work(a, x, b, y):
        same = b is None
        scale = cutoff * x.shape[1]
        one = [np.unique(np.array(a.to_pylist()), return_inverse=True)[1]] if same else []
        y = x if same else y
        u, v = (x * x).sum(1), (y * y).sum(1)
        # 1 - d / cutoff of two rows as one product; norms far above the cutoff would cost it its digits.
        left = np.column_stack([x * (2 / scale), 1 - u / scale, np.ones(len(x))])
        right = np.ascontiguousarray(np.column_stack([y, np.ones(len(y)), -v / scale]).T)
        exact = u[np.isfinite(u)].max(initial=0) + v[np.isfinite(v)].max(initial=0) > 1e5 * scale
        # Vectors with values that are not finite are near none.
        left[~np.isfinite(u)], right[:, ~np.isfinite(v)] = 0, 0
        left[~np.isfinite(u), -2], right[-1, ~np.isfinite(v)] = -1, -1
        rows, columns = np.zeros(len(x)), np.zeros(len(y))
        space = np.empty((STEP, STEP))
        for i in range(0, len(x), STEP):
            for j in range(i if same else 0, len(y), STEP):
                p, q = slice(i, i + STEP), slice(j, j + STEP)
                t = space[: len(x[p]), : len(y[q])]
                if exact:
                    t[:] = np.nan_to_num(1 - _pairwise(x[p], y[q], "euclid") / cutoff, nan=0)
                else:
                    np.matmul(left[p], right[:, q], out=t)
                np.maximum(t, 0, out=t)
                if same:
                    t[one[0][p][:, None] == one[0][q][None]] = 0
                if exponent == 2:
                    np.multiply(t, t, out=t)
                else:
                    np.power(t, exponent, out=t, where=t > 0)
                rows[p] += t @ np.ones(t.shape[1])
                if not same or i < j:
                    columns[q] += np.ones(t.shape[0]) @ t
        for keys, sums in ((a, rows + columns),) if same else ((a, rows), (b, columns)):
            yield pa.RecordBatch.from_arrays([keys, pa.array(sums)], names=["key", "s"])

    rows = df.where(F.col(vec).isNotNull() & ~F.exists(vec, lambda x: x.isNull())).select(F.col(key).alias("key"), F.col(vec).alias("x"))
    kind = dict(df.dtypes)[key]
    sums = _block_pairs(rows.where("key IS NOT NULL"), work, f"key {kind}, s double").groupBy(F.col("key").alias(key)).agg(F.sum("s").alias("__s"))
    return rows.select(F.col("key").alias(key)).join(sums, key, "left").select(key, (1 / (1 + F.coalesce("__s", F.lit(0.0)))).alias("weight"))


def linkage(df: DataFrame, label: str, vec: str, metric: str = "euclid") -> DataFrame:
    """(a, b, smallest, largest, average, means, medians) of every two labels.

    Every pair of vectors is worked out once, in tiles of one product each; of a row of tiles four numbers for every two labels leave the
    task, and no pair is written. Medians are exact, place by place."""
    import numpy as np
    import pyarrow as pa

    rows = df.where(F.col(vec).isNotNull() & ~F.exists(vec, lambda x: x.isNull())).select(F.col(label).alias("label"), F.col(vec).alias("x"))
    kind = dict(df.dtypes)[label]

    def work(a, x, b, y):
        same = b is None
        a, x, at = by_label(a, x)
        b, y, bt = (a, x, at) if same else by_label(b, y)
        if metric == "euclid":
            u, v = (x * x).sum(1), (y * y).sum(1)
            left = np.column_stack([x * -2, u, np.ones(len(x))]) / x.shape[1]
            right = np.ascontiguousarray(np.column_stack([y, np.ones(len(y)), v]).T)
        space = np.empty((STEP, STEP))
        for i in range(0, len(x), STEP):
            p = slice(i, i + STEP)
            here, first = np.unique(at[p], return_index=True)
            out = [np.full((len(here), len(b)), z) for z in (np.inf, -np.inf, 0.0, 0)]
            for j in range(i if same else 0, len(y), STEP):
                q = slice(j, j + STEP)
                there, begin = np.unique(bt[q], return_index=True)
                if len(here) == len(there) == 1 and a[here[0]] == b[there[0]]:
                    continue
                if metric == "euclid":
                    d = np.matmul(left[p], right[:, q], out=space[: len(x[p]), : len(y[q])])
                    # The product loses digits of small distances: those are worked out again.
                    if d.min() < 1e-6 * (u[p].max() + v[q].max()) / x.shape[1]:
                        d = _pairwise(x[p], y[q], metric)
                else:
                    d = _pairwise(x[p], y[q], metric)
                at_once = len(here) == len(there) == 1
                of = lambda f: f.reduce(d, axis=None).reshape(1, 1) if at_once else f.reduceat(f.reduceat(d, begin, axis=1), first, axis=0)  # noqa: B023, E731
                n = np.diff(np.append(first, len(x[p])))[:, None] * np.diff(np.append(begin, len(y[q])))[None]
                if same and i == j:  # both orders of each pair are in this tile
                    n[here[:, None] >= there[None]] = 0
                for own, f, new in zip(out, (np.minimum, np.maximum, np.add, np.add), (of(np.minimum), of(np.maximum), of(np.add), n), strict=True):
                    own[:, there] = np.where(n > 0, f(own[:, there], new), own[:, there])
            r, c = np.nonzero(out[3])
            r, c = (z[a[here[r]] != b[c]] for z in (r, c))
            one, two, turned = a[here[r]], b[c], a[here[r]] > b[c]
            pair = np.where(turned, two, one), np.where(turned, one, two)
            yield pa.RecordBatch.from_arrays([*(pa.array(z.tolist(), kinds) for z in pair), *(pa.array(o[r, c]) for o in out[:3]), pa.array(out[3][r, c].astype(np.int64))], names=["a", "b", "lo", "hi", "total", "n"])

    def by_label(labels, x):
        """(labels in order, rows in their order, number of each row's label)."""
        values, at = np.unique(np.array(labels.field("label").to_pylist()), return_inverse=True)
        order = np.argsort(at, kind="stable")
        return values, x[order], at[order]

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = to_arrow_type(df.schema[label].dataType)
    keyed = rows.where("label IS NOT NULL").select(F.struct("label", F.monotonically_increasing_id().alias("row")).alias("key"), "x")
    sums = _block_pairs(keyed, work, f"a {kind}, b {kind}, lo double, hi double, total double, n long")
    sums = sums.groupBy("a", "b").agg(F.min("lo").alias("smallest"), F.max("hi").alias("largest"), (F.sum("total") / F.sum("n")).alias("average"))
    for name, middle in (("means", F.avg("v")), ("medians", F.expr("percentile(v, 0.5)"))):
        centres = rows.select("label", F.posexplode(F.col("x").cast("array<double>")).alias("k", "v")).groupBy("label", "k").agg(middle.alias("m"))
        centres = centres.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda p: p["m"]).alias("mean"))
        sums = sums.join(mean_distances(centres, "label", metric).withColumnRenamed("dist", name), ["a", "b"])
    return sums


def kmedians(df: DataFrame, key: str, vec: str, k: int, seed: int = 1, rounds: int = 50) -> tuple[DataFrame, DataFrame, bool]:
    """((key, cluster, dist), (cluster, centre), converged): clusters around medians, place by place, under city-block distance.

    It begins with k vectors drawn by a hash of the key and goes on until no centre moves. A round is one pass: each
    vector goes to its nearest centre (k centres travel), and medians are selected exactly by value counts of
    (cluster, place), which combine map-side. An empty cluster keeps its centre."""
    rows = _whole(df, key, vec)
    spark = df.sparkSession
    drawn = rows.orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(k).collect()  # k rows
    centres = {i: list(r["x"]) for i, r in enumerate(drawn, 1)}

    def place(rows: DataFrame) -> DataFrame:
        table = F.array(*(F.struct(F.lit(i).alias("cluster"), F.lit(c).alias("c")) for i, c in centres.items()))
        found = F.array_min(F.transform(table, lambda t: F.struct(distance(F.col("x"), t["c"], "cityblock").alias("dist"), t["cluster"].alias("cluster"))))
        return rows.withColumn("found", found).select("key", "x", "found.cluster", "found.dist")

    converged = not centres
    for _ in range(rounds if centres else 0):
        medians = place(rows).select("cluster", F.posexplode("x").alias("k", "v")).groupBy("cluster", "k").agg(F.expr("percentile(v, 0.5)").alias("m"))
        new = {i: list(c) for i, c in centres.items()}
        for r in medians.collect():  # k times the length of a vector
            new[r["cluster"]][r["k"]] = r["m"]
        converged, centres = new == centres, new
        if converged:
            break
    table = spark.createDataFrame(list(centres.items()), "cluster int, centre array<double>")
    if not centres:
        return rows.select(F.col("key").alias(key), F.lit(0).alias("cluster"), F.lit(0.0).alias("dist")), table, True
    return place(rows).select(F.col("key").alias(key), "cluster", "dist"), table, converged
