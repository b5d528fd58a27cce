"""Near duplicates among embeddings by iterative quantisation and multi-index Hamming tables.

Equal vectors are one class. Each length of vectors is planned by itself; of a rare one all are compared.
Rotations turn each class's vector into a code of balanced bits: the first is learned on a bounded sample
(``SAMPLE``) of its length, the others are random. The code is cut into windows that share no bit, each the key
of a table. Two classes are candidates if their codes agree in a window and lie within the plan's Hamming
``radius`` on the whole. Windows are as wide as the number of classes asks for; how many there are, and the
radius, come from pairs at the threshold that are made from the sample and coded: pairs that part in any
direction, as the data do, along their chief axes, towards the common mean, and around it as far as such pairs can.
Tables are added until each kind are candidates with probability ``RECALL``. (A window could be probed a bit
away too; each class would then go out once more for each bit, where a further window costs one row.) Where that
takes more than ``MANY_TABLES``, windows are narrower and buckets larger instead. Where even so more than ``DENSE`` of
random pairs were candidates, because vectors lie as close to a common mean as the threshold lets two be apart,
codes tell nothing: then all are compared, in blocks. So recall doesn't fall as a table grows or as vectors crowd.

Only codes and numbers travel to the tables. What has a candidate partner in a bucket that it has not met in an
earlier table meets there again with its original components, and is compared in double precision. A bucket
larger than a block is dealt out as pairs of blocks, all of which are compared.

A bucket's work yields a number of links a vector and one edge a vector to the smallest number that it reaches
there, never the pairs. Vectors that are null, empty, zero or hold null or non-finite components, and rows
with a null id, link with nothing and are kept, each its own component; so do vectors of different lengths
among each other. A repeated row counts as another vector, and rows of one id may have different vectors. Ids
are of any type that sorts. Other columns are left behind.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import by_group, by_part, components, discard, kept, lookup, spread_join, stored, table
from siltstone.llm.topk import usable

THRESHOLD = 0.95
SAMPLE = 4_096
ROUNDS = 40
BITS = 64
RECALL = 0.995
#: Tables from which windows are made narrower instead.
MANY_TABLES = 128
#: Bits up to which a window may be wide: its key is one unsigned number of 32 bits.
WIDEST = 32
#: Pairs at the threshold, of each kind, that tables are planned with.
TRIALS = 2_048
#: Share of random pairs that may be candidates; beyond it all vectors are compared, without tables.
DENSE = 0.2
#: Codes, and vectors, of a large bucket that are compared at a time with as many others; and vectors where all are compared.
CODES, BLOCK, DENSE_BLOCK = 512, 128, 1_024
#: The data's chief axes that such pairs part along.
CHIEF = 8
#: Vectors of one length up to which all of them are compared.
FEW = 256


def rotations(x: np.ndarray, rounds: int = ROUNDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Projections and thresholds for bits of unit vectors: principal axes, turned, cut at the medians.

    The first turn is such that signs lose least (iterative quantisation), the others are random, so that no two
    of them give the same bits.
    """
    x = x - (mean := x.mean(axis=0))
    values, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, np.argsort(-values)][:, :BITS]
    v = x @ axes
    random = np.random.default_rng(7)
    while True:
        turn = np.linalg.qr(random.standard_normal((axes.shape[1],) * 2))[0]
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
            turn = (left @ right).T
        rounds = 0
        projection = axes @ turn
        yield projection, np.median(x @ projection, axis=0) + mean @ projection


def window_width(classes: int) -> int:
    return min(WIDEST, max(8, math.ceil(math.log2(max(2, classes))) - 3))


def pairs_at(x: np.ndarray, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unit vectors at the threshold, of several kinds, ``TRIALS`` each.

    They part in any direction, as two of the data do, or along one of the data's chief axes; the second of them
    freely, or as far from the common mean as the first, or nearer to it: straight towards it, and as far around
    it as a vector at the threshold can be. Where the sample itself has pairs at the threshold or just over, these too.
    """
    random = np.random.default_rng(11)
    axis = x.mean(axis=0)
    axis = axis / max(float(np.linalg.norm(axis)), 1e-12)
    chief = np.linalg.eigh((x - x.mean(axis=0)).T @ (x - x.mean(axis=0)))[1][:, ::-1][:, :CHIEF]
    kinds = []
    for about_mean in (False, True):
        for way in ("any", "data", "chief")[: 2 if about_mean else 3]:
            left = x[random.integers(len(x), size=TRIALS)]
            if way == "data":
                apart = x[random.integers(len(x), size=TRIALS)] - x[random.integers(len(x), size=TRIALS)]
            elif way == "chief":
                apart = chief.T[random.integers(chief.shape[1], size=TRIALS)] * random.choice((-1.0, 1.0), (TRIALS, 1))
            else:
                apart = random.standard_normal((TRIALS, x.shape[1]))
            fixed = (left @ axis)[:, None] * axis if about_mean else np.zeros_like(left)
            own = left - fixed
            if about_mean:
                apart = apart - (apart @ axis)[:, None] * axis
            size = (own * own).sum(axis=1, keepdims=True)
            apart = apart - (apart * own).sum(axis=1, keepdims=True) / np.maximum(size, 1e-18) * own
            apart = apart * np.sqrt(size) / np.maximum(np.linalg.norm(apart, axis=1, keepdims=True), 1e-12)
            cosine = np.clip((threshold - 1 + size) / np.maximum(size, 1e-18), -1, 1)
            kinds.append((left, fixed + cosine * own + np.sqrt(1 - cosine * cosine) * apart))
    kinds += _towards_mean(x[random.integers(len(x), size=TRIALS)], axis, math.acos(max(-1.0, min(1.0, threshold))), random)
    found = [np.empty((3, 0))]
    for k in range(0, len(x), 256):
        cosines = np.triu(x[k : k + 256] @ x.T, k + 1)
        a, b = np.nonzero((cosines >= threshold) & (cosines < threshold + (1 - threshold) / 2))
        found.append(np.stack([cosines[a, b], a + k, b]))
        found = [np.concatenate(found, axis=1)]
        found[0] = found[0][:, np.argsort(found[0][0], kind="stable")[:TRIALS]]
    if found[0].shape[1] >= TRIALS // 8:
        kinds.append((x[found[0][1].astype(int)], x[found[0][2].astype(int)]))
    return kinds


def _towards_mean(left: np.ndarray, axis: np.ndarray, angle: float, random: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """Partners at the angle, nearer to the mean's direction: straight towards it, and where they are farthest around it."""
    if not axis.any():
        return []
    along = left @ axis
    out = left - along[:, None] * axis
    off = np.linalg.norm(out, axis=1)
    ahead = out / np.maximum(off, 1e-12)[:, None]
    aside = random.standard_normal(left.shape)
    aside -= (aside @ axis)[:, None] * axis
    aside -= (aside * ahead).sum(axis=1, keepdims=True) * ahead
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-12)
    far = np.arctan2(off, along)  # from the mean's direction
    near = far - angle
    straight = np.cos(near)[:, None] * axis + np.sin(near)[:, None] * ahead
    around = np.where(far > angle, np.sin(angle) / np.maximum(np.sin(far), 1e-12), 1.0).clip(0, 1)
    height = np.where(far > angle, np.cos(far) / max(np.cos(angle), 1e-12), 1.0).clip(-1, 1)
    turned = np.sqrt(1 - around**2)[:, None] * ahead + around[:, None] * aside
    return [(left, straight), (left, height[:, None] * axis + np.sqrt(1 - height**2)[:, None] * turned)]


@dataclass(frozen=True)
class Plan:
    """``tables`` windows of ``width`` bits each: bit k is whether x @ projection[:, k] exceeds cut[k]. ``radius``: of the whole code."""

    width: int
    tables: int
    radius: int
    projection: np.ndarray
    cut: np.ndarray
    dense: bool = False

    def bits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.projection > self.cut

    def keys(self, x: np.ndarray) -> np.ndarray:
        """A row a vector, a key a table."""
        bits = self.bits(x).reshape(len(x), self.tables, self.width)
        return (bits.astype(np.uint64) << np.arange(self.width, dtype=np.uint64)).sum(axis=2, dtype=np.uint64).astype(np.int64)

    def keys_of(self, codes: np.ndarray) -> np.ndarray:
        """The same from codes: windows are bits of them."""
        bits = np.unpackbits(codes.view(np.uint8), axis=1, count=self.tables * self.width).reshape(len(codes), self.tables, self.width)
        return (bits.astype(np.uint64) << np.arange(self.width, dtype=np.uint64)).sum(axis=2, dtype=np.uint64).astype(np.int64)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """A row a vector: its bits in words of 64."""
        packed = np.packbits(self.bits(x), axis=1)
        return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view("<u8")


def plan_tables(x: np.ndarray, classes: int, threshold: float, recall: float = RECALL) -> Plan:
    """Of a sample's unit vectors: windows for so many classes, as many as pairs at the threshold need to be candidates.

    Such pairs differ in a bit with probability angle / pi if it is cut through the origin; cut at the medians they
    may differ more often, so they are made and coded. At least as many windows are made as angle / pi asks for.
    The radius leaves out a quarter of the pairs that may be missed.
    """
    kinds = pairs_at(x, threshold)
    random = np.random.default_rng(13)
    kinds.append(tuple(x[random.integers(len(x), size=TRIALS)] for _ in range(2)))  # the last: random pairs
    left, right = (np.concatenate(side) for side in zip(*kinds))
    ends = np.cumsum([len(k[0]) for k in kinds])[:-1]

    def worst(values: np.ndarray, of: Callable[[np.ndarray], float], pick: Callable) -> float:
        return pick(of(part) for part in np.split(values, ends)[:-1])

    turned, models = rotations(x), []
    differ = np.empty((len(left), 0), bool)
    for width in range(window_width(classes), 0, -1):
        same = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** width
        least = math.ceil(math.log(1 - recall) / math.log(1 - same)) if 0 < same < 1 else 1
        met, distance = np.zeros(len(left), bool), np.zeros(len(left), np.int64)
        for k in range(MANY_TABLES if least <= MANY_TABLES else 0):
            while differ.shape[1] < (k + 1) * width:
                models.append(next(turned))
                more = [(y @ models[-1][0] > models[-1][1]) for y in (left, right)]
                differ = np.concatenate([differ, more[0] != more[1]], axis=1)
            apart = differ[:, k * width : (k + 1) * width].sum(axis=1)
            met |= apart == 0
            distance += apart
            if k + 1 < least or worst(met, np.mean, min) < recall:
                continue
            radius = int(worst(distance, lambda d: np.quantile(d, 1 - (1 - recall) / 4, method="higher"), max))
            if worst(met & (distance <= radius), np.mean, min) >= recall:
                n = (k + 1) * width
                if (met & (distance <= radius))[ends[-1] :].mean() > DENSE:
                    return everything(x.shape[1])
                return Plan(width, k + 1, radius, np.concatenate([m[0] for m in models], axis=1)[:, :n], np.concatenate([m[1] for m in models])[:n])
    return everything(x.shape[1])


def everything(length: int) -> Plan:
    """One bucket for all vectors, all of them candidates."""
    return Plan(1, 1, 1, np.zeros((length, 1)), np.zeros(1), True)


def _vectors(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """(id, digest, x): usable vectors, floats as they are and all else as doubles, with the digest of their bytes."""
    single = isinstance(df.schema[vec].dataType.elementType, T.FloatType)
    kind = "<f4" if single else "<f8"
    rows = df.where(usable(vec) & F.col(id_col).isNotNull() & F.exists(vec, lambda x: x != 0))
    rows = rows.select(F.col(id_col).alias("id"), F.col(vec).cast("array<float>" if single else "array<double>").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [(np.array(v, kind) + np.array(0, kind)).tobytes() for v in batch.column(1).to_pylist()]
            digest = [hashlib.blake2b(v, digest_size=16).digest() for v in x]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.binary()), pa.array(x, pa.binary())], names=["id", "digest", "x"])

    return rows.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, digest binary, x binary")


def _unit(blobs: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _keep_new(a: np.ndarray, b: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of rows (a, b) those that no column of ``before``, the keys in earlier tables, brings together."""
    for key in before.T:
        if not len(a):
            break
        new = key[a] != key[b]
        a, b = a[new], b[new]
    return a, b


def _candidates(group: np.ndarray, left: np.ndarray, codes: np.ndarray, before: np.ndarray, radius: int) -> np.ndarray:
    """Of rows sorted by ``group``: which have a new partner of their group within the radius.

    ``left`` is the block of a row whose group is a pair of blocks, where partners are of the other; otherwise -1.
    """
    found = np.zeros(len(codes), bool)
    a = np.arange(len(codes))
    for apart in range(1, len(codes)):  # rows so many places apart, of all groups at once
        a = a[: np.searchsorted(a, len(codes) - apart)]
        a = a[group[a] == group[a + apart]]
        if not len(a):
            break
        near = np.bitwise_count(codes[a] ^ codes[a + apart]).sum(axis=1, dtype=np.int64) <= radius
        near &= (left[a] < 0) | (left[a] != left[a + apart])
        x, y = _keep_new(a[near], a[near] + apart, before)
        found[x] = found[y] = True
    return found


def _bucket(left: np.ndarray, ids: np.ndarray, copies: np.ndarray, before: np.ndarray, x: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """Of one bucket or pair of blocks, as above: ids, links, smallest id reached."""
    linked = x @ x.T >= threshold
    np.fill_diagonal(linked, False)
    if left[0] >= 0:
        linked &= left[:, None] != left[None, :]
    a, b = np.nonzero(np.triu(linked))
    a, b = _keep_new(a, b, before)
    linked[:] = False
    linked[a, b] = linked[b, a] = True
    links = linked @ copies
    label = ids.copy()
    some = np.flatnonzero(links)
    part = linked[np.ix_(some, some)]
    while len(some):
        near = np.where(part, label[some][None, :], np.iinfo(np.int64).max).min(axis=1)
        lower = np.minimum(label[some], near)
        if (lower == label[some]).all():
            break
        label[some] = lower
    return ids[some], links[some], label[some]


BUCKET = ["size", "t", "key"]
GROUP = [*BUCKET, "i", "j"]


def _dealt(rows: DataFrame, block: F.Column) -> DataFrame:
    """``rows`` of buckets as groups (size, t, key, i, j), sorted: a large bucket is dealt out as pairs of blocks, ``own`` the row's."""
    sizes = rows.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("n"), F.max(block).alias("block"))
    large = stored(sizes.where(F.col("n") > F.col("block")).select(*BUCKET, "n", F.ceil(F.col("n") / F.col("block")).cast("int").alias("blocks")))
    rows = lookup(rows, large, BUCKET, "n", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "blocks")
    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP, "cid")


def _array(part: pa.Table, name: str, kind: str) -> np.ndarray:
    """A column of binary values of one length as rows of an array."""
    return np.frombuffer(b"".join(part.column(name).to_pylist()), kind).reshape(part.num_rows, -1)


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec: str = "embedding", recall: float = RECALL) -> DataFrame:
    """A row a vector: id, n_links, component_id, kept."""
    members = stored(_vectors(df, id_col, vec))
    kind = "<f4" if isinstance(df.schema[vec].dataType.elementType, T.FloatType) else "<f8"
    width = np.dtype(kind).itemsize
    classes = members.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("x").alias("x"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("cid"), "*"))
    counts = classes.groupBy(F.length("x").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    plans: dict[int, Plan] = {}
    for size, count in counts.where(F.col("n") > FEW).collect():  # lengths that vectors have, not vectors
        sample = classes.where(F.length("x") == size).orderBy(F.xxhash64("digest")).limit(SAMPLE).select("x").collect()
        plans[size] = plan_tables(_unit([r["x"] for r in sample], kind), count, threshold, recall)

    plans = {size: plan for size, plan in plans.items() if not plan.dense}

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column("x").to_pylist()
            sizes = np.array([len(b) for b in blobs], np.int64)
            keys: list = [[0]] * len(blobs)
            codes: list = [None] * len(blobs)
            for size in np.unique(sizes):
                if (plan := plans.get(int(size))) is None:  # all are compared, so there is one key and no code
                    continue
                rows = np.flatnonzero(sizes == size)
                x = _unit([blobs[r] for r in rows], kind)
                for row, key, code in zip(rows, plan.keys(x), plan.codes(x)):
                    keys[row], codes[row] = key, code.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(sizes), pa.array(keys, pa.list_(pa.int64())), pa.array(codes, pa.binary())], names=["cid", "size", "keys", "code"])

    codes, codes_at = kept(classes.select("cid", "x").mapInArrow(coded, "cid long, size long, keys array<long>, code binary"))
    entries = codes.where("code is not null").select("cid", "size", "code", F.posexplode("keys").alias("t", "key"))

    def earlier(part: pa.Table) -> np.ndarray:
        """The keys in earlier tables of rows of one table."""
        size, t = part.column("size")[0].as_py(), part.column("t")[0].as_py()
        return plans[size].keys_of(_array(part, "code", "<u8"))[:, :t] if t else np.empty((part.num_rows, 0), np.int64)

    def left_of(part: pa.Table) -> np.ndarray:
        own, i, j = (part.column(n).to_numpy() for n in ("own", "i", "j"))
        return np.where(i == j, -1, own)

    def near(part: pa.Table, starts: list[int]) -> list:
        group = np.zeros(part.num_rows, np.int64)
        group[starts[1:]] = 1
        group, left, cid = group.cumsum(), left_of(part), part.column("cid").to_numpy()
        size, t = (part.column(n).to_numpy() for n in ("size", "t"))
        new = (np.flatnonzero((np.diff(size) != 0) | (np.diff(t) != 0)) + 1).tolist()
        found = []
        for a, b in zip([0, *new], [*new, part.num_rows]):  # codes of one length and keys of one table
            rows = part.slice(a, b - a)
            found.append(_candidates(group[a:b], left[a:b], _array(rows, "code", "<u8"), earlier(rows), plans[int(size[a])].radius))
        some = np.concatenate(found)
        return [*(part.column(n).to_numpy()[some] for n in BUCKET), cid[some]]

    close = by_part(_dealt(entries, F.lit(CODES)), GROUP, near, "size long, t long, key long, cid long").distinct()
    every = codes.where("code is null").select("size", F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("key"), "cid")
    close, close_at = kept(close.unionByName(every))

    def compared(part: pa.Table) -> list:
        if part.num_rows < 2:
            return []
        cid, copies = (part.column(n).to_numpy() for n in ("cid", "copies"))
        return list(_bucket(left_of(part), cid, copies, earlier(part), _unit(part.column("x").to_pylist(), kind), threshold))

    full, full_at = kept(close.join(codes.select("cid", "code"), "cid").join(classes.select("cid", "copies", "x"), "cid"))
    found = stored(by_group(_dealt(full, F.when(F.col("code").isNull(), DENSE_BLOCK).otherwise(BLOCK)), GROUP, compared, "cid long, links long, reached long"))
    discard(codes_at, close_at, full_at)
    sums = found.groupBy("cid").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("cid").alias("a"), F.col("reached").alias("b"))).withColumnRenamed("id", "cid")
    linked = stored(classes.select("cid", "digest", "rep", "copies").join(sums, "cid").join(labels, "cid"))
    least = stored(linked.groupBy("label").agg(F.min("rep").alias("component"), F.count(F.lit(1)).alias("n")))
    joined = spread_join(linked, least, "label", "n").select("digest", "copies", "links", "component")
    alone = classes.join(linked.select("cid"), "cid", "left_anti").select("digest", "copies", F.lit(0).cast("long").alias("links"), F.col("rep").alias("component"))
    known = stored(joined.unionByName(alone).withColumn("n_links", F.col("links") + F.col("copies") - 1).drop("links"))
    judged = spread_join(members.select("id", "digest"), known, "digest", "copies").select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"))
    rest = df.where(~(usable(vec) & F.col(id_col).isNotNull() & F.coalesce(F.exists(vec, lambda x: x != 0), F.lit(False))))
    rest = rest.select(id_col, F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"))
    return judged.unionByName(rest).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def op6_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
