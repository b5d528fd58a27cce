"""Near duplicates among texts by a chosen-path set similarity join.

A text's set holds its distinct shingles of ``words`` words, hashed to 64 bits; with fewer words the whole
sequence is one. Equal sets are one class from the start. Each tree sends every class down one path: at
each node the set's minwise token, under a hash that the path chooses, leads to the next node, so two sets
go the same way with the probability of their similarity. Small nodes are compared exhaustively. A large
node compares all its members with two pivots, one drawn and one that meets most others, and branches on, as far as ``DEPTH``. The trees are
independent and repeated to the target recall: a pair at similarity 0.8 that needs the whole depth is
missed by all ten with a probability under 0.006, one that meets in the first nodes with under 1e-6.

A bit of a set's sketch is set if a shingle of the set falls to it, so each bit that one sketch has and another
lacks is a shingle that the other set lacks. Candidates whose sketches show that they can't be similar enough are
dropped by that bound, which is exact, before any full set is made or sent. The others are confirmed on full sets, in rounds: the links of the first trees give components, and of the
rest only pairs that join two components are looked at, as links inside one change nothing. At last, of a
node still large at the last depth, members outside its largest component are compared with all members of
other components. So nothing grows with the square of a group of copies, and no group meets in one task.

Texts that are null or have no words have no set and link with nothing, nor do rows with a null id (their
component is null and they are kept). Rows that repeat an id are judged each by its text: classes have numbers
of their own. Ids are of any type that sorts. Other columns are left behind; ``deduplicate`` keeps all of a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import by_group, components, discard, kept, small, spread_join, stored, table, take_turn

SHINGLE, PERCENT = 5, 80
TREES, DEPTH = 10, 4
#: Trees whose links are confirmed first.
FIRST_TREES = 2
#: Members up to which a node is compared exhaustively.
SMALL_NODE = 12
#: Members that one copy of a hub's set is compared with.
STAR = 256
#: Copies of a hub's set that one task makes.
COPIES = 64
#: Members of a large node in a block, and shingles looked at at a time.
BLOCK, COLUMNS = 256, 8_192
WORDS_KEPT = 200_000
SLICE = 256
#: Bits of a set's sketch.
SKETCH = 1_024
#: Shingles from which a set's trees are hashed one by one, to bound memory.
LONG = 100_000

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_S = np.uint64(31)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _WordHashes()


def _begin() -> None:
    take_turn("near_dedup", _hashes.clear)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _M[0]
    x = (x ^ (x >> _S)) * _M[1]
    return x ^ (x >> _S)


def shingles(text: str | None, words: int) -> np.ndarray:
    """The set as rising 64-bit hashes. Bytes split and lower-case as asked for: ASCII white space, A-Z only."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    if len(h) < words:
        h, words = np.concatenate([h, np.array([len(h)], np.uint64)]), len(h) + 1
    total = np.zeros(len(h) - words + 1, np.uint64)
    for k in range(words):
        total = (total ^ h[k : len(h) - words + 1 + k]) * _M[2] + _M[3]
        total ^= total >> _S
    return np.unique(_mixed(total))


def paths(s: np.ndarray) -> np.ndarray:
    """TREES x DEPTH node ids: where the set goes in each tree."""
    out = np.empty((TREES, DEPTH), np.uint64)
    path = _mixed(np.arange(1, TREES + 1, dtype=np.uint64) * _M[3])
    for level in range(DEPTH):
        turn = path | np.uint64(1)
        if len(s) > LONG:
            at = np.array([_turned(s, t).argmin() for t in turn])
        else:
            at = _turned(s[None, :], turn[:, None]).argmin(axis=1)
        path = _mixed(path ^ _mixed(s[at] + _M[level]))
        out[:, level] = path
    return out


def sketch(s: np.ndarray) -> np.ndarray:
    bits = np.zeros(SKETCH, bool)
    bits[(s % np.uint64(SKETCH)).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64)


def _turned(s: np.ndarray, turn: np.ndarray) -> np.ndarray:
    x = s * turn
    x ^= x >> _S
    return x * turn


def _sets(docs: DataFrame, words: int, full: bool) -> DataFrame:
    """Of (id, source, text): id, source, n, digest, and either the nodes of all trees and the sketch or the full set."""
    rest_type = "rest binary" if full else "rest array<long>, sketch array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                batch = whole.slice(k, SLICE)
                sets = [shingles(x, words) for x in batch.column(2).to_pylist()]
                blobs = [s.astype("<u8").tobytes() for s in sets]
                if full:
                    rest = [pa.array(blobs, pa.binary())]
                else:
                    rest = [pa.array([f(s).view(np.int64).ravel() if len(s) else [] for s in sets], pa.list_(pa.int64())) for f in (paths, sketch)]
                digests = pa.array([xxhash.xxh3_128_digest(b) for b in blobs], pa.binary())
                columns = [batch.column(0), batch.column(1), pa.array(map(len, sets), pa.int64()), digests, *rest]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "source", "n", "digest", "rest", "sketch"][: len(columns)])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, source binary, n long, digest binary, {rest_type}")


def _alike(a: str, b: str, percent: int) -> F.Column:
    """Whether sets of these sizes can be similar enough."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _candidates(classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (hub, member, tree); members (node, cid, n) of nodes that are still large at the last depth.

    A class is a hub of any number of pairs, but a member of a number of pairs that ``TREES``, ``DEPTH`` and
    ``SMALL_NODE`` bound.
    """
    trees = F.sequence(F.lit(0), F.lit((TREES - 1) * DEPTH), F.lit(DEPTH))
    rows = classes.select("cid", "n", F.posexplode(F.transform(trees, lambda t: F.col("rest")[t])).alias("tree", "node"))
    pairs, read = None, []
    for level in range(DEPTH):
        if level:
            rows = rows.withColumn("node", F.col("chain")[level])
        nodes, nodes_at = kept(rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
        met, met_at = kept(spread_join(rows, nodes.withColumn("held", F.col("size")), "node", "held"))
        few = met.where(F.col("size") <= SMALL_NODE).groupBy("node").agg(F.first("tree").alias("tree"), F.sort_array(F.collect_list(F.struct("cid", "n"))).alias("m"))
        both = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: (y["cid"] > x["cid"]) & _alike(x["n"], y["n"], percent)), lambda y: F.struct(x["cid"].alias("hub"), y["cid"].alias("member")))))
        few = few.select("tree", F.explode(both).alias("p")).select("p.hub", "p.member", "tree")
        many = met.where(F.col("size") > SMALL_NODE)
        if level == 0:  # what most copies are made from meets most of them, in most trees
            weights, weights_at = kept(many.groupBy("cid").agg(F.sum("size").alias("weight")))
            ways = classes.select("cid", "rest").join(small(weights), "cid")
            chain = F.slice("rest", F.col("tree") * DEPTH + 1, DEPTH).alias("chain")
            many, many_at = kept(many.join(ways, "cid").select(*met.columns, "weight", chain))
            read += [weights_at, many_at]
        chance = F.xxhash64("cid", "node")
        picks = many.groupBy("node").agg(F.count(F.lit(1)).alias("held"), F.max(F.struct("weight", chance.alias("h"), "cid", "n")).alias("central"), F.min(F.struct(chance.alias("h"), "cid", "n")).alias("drawn"))
        picks, picks_at = kept(picks.select("node", "held", F.array(*(F.struct(f"{p}.cid", f"{p}.n") for p in ("central", "drawn"))).alias("picked")))
        star = spread_join(many, picks, "node", "held").withColumn("p", F.explode("picked")).where((F.col("cid") != F.col("p.cid")) & _alike("n", "p.n", percent))
        star = star.select(F.col("p.cid").alias("hub"), F.col("cid").alias("member"), "tree")
        found = few.unionByName(star)
        pairs = found if pairs is None else pairs.unionByName(found)
        rows = many.select("cid", "n", "tree", "chain", "node", "weight")
        read += [nodes_at, met_at, picks_at]
    one = pairs.groupBy("hub", "member").agg(F.min("tree").alias("tree"))
    deep = stored(rows.select("node", "cid", "n"))
    found = stored(one)
    discard(*read)
    return found, deep


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that the sketches of ``classes`` (cid, n, sketch) leave: none is dropped whose sets are similar enough."""

    def lacking(a: str, b: str) -> F.Column:
        """Shingles of the one set that the other lacks, at least."""
        bits = F.zip_with(f"{a}_sketch", f"{b}_sketch", lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y))))
        return F.aggregate(bits, F.lit(0), lambda total, x: total + x)

    def of(s: str) -> DataFrame:
        return classes.select(F.col("cid").alias(s), F.col("n").alias(f"{s}_n"), F.col("sketch").alias(f"{s}_sketch"))

    hubs, hubs_at = kept(pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("held")).join(of("hub"), "hub"))
    both = spread_join(pairs, hubs, "hub", "held").join(of("member"), "member")
    common = F.least(F.col("hub_n") - lacking("hub", "member"), F.col("member_n") - lacking("member", "hub"))
    left = stored(both.where((100 + percent) * common >= percent * (F.col("hub_n") + F.col("member_n"))).select(*pairs.columns))
    discard(hubs_at)
    return left


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs as (a, b) whose full sets are similar enough.

    A hub's members come to it in parts of about ``STAR``, each with its own copy of the hub's set, in front. A
    large hub's set is copied in steps, so that not one task makes all its copies.
    """
    hubs, hubs_at = kept(pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("parts")))
    sent = spread_join(pairs.select("hub", "member"), hubs, "hub", "n").select("hub", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("side"), F.col("member").alias("cid"))
    first = F.sequence(F.lit(0), F.col("parts") - 1, F.lit(COPIES))
    steps = hubs.select("hub", "parts", F.explode(first).alias("first"), F.lit(0).alias("side"), F.col("hub").alias("cid")).join(sets, "cid")
    large = steps.where(F.col("parts") > COPIES).repartition("hub", "first")
    own = steps.where(F.col("parts") <= COPIES).unionByName(large)
    own = own.withColumn("part", F.explode(F.sequence("first", F.least(F.col("first") + COPIES, "parts") - 1)))
    dealt = sent.join(sets, "cid").select("hub", "part", "side", "cid", "rest").unionByName(own.select("hub", "part", "side", "cid", "rest"))
    dealt = dealt.repartition("hub", "part").sortWithinPartitions("hub", "part", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center, center_set = None, np.empty(0, np.uint64)
        for batch in batches:
            found: list[tuple[int, int]] = []
            rows = zip(*(batch.column(c).to_numpy().tolist() for c in ("hub", "side", "cid")), batch.column("rest"))
            for hub, side, cid, blob in rows:
                one = np.frombuffer(blob.as_buffer(), "<u8")
                if side == 0:
                    center, center_set = hub, one.copy()
                elif center == hub:
                    common = len(np.intersect1d(center_set, one, assume_unique=True))
                    if 100 * common >= percent * (len(center_set) + len(one) - common):
                        found.append((hub, cid))
            columns = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    links = stored(dealt.mapInArrow(run, "a long, b long"))
    discard(hubs_at)
    return links


def _incidence(sets: list[np.ndarray], every: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(every)), np.float32)
    for row, s in zip(out, sets):
        at = np.searchsorted(every, s)
        row[at[at < len(every)][every[at[at < len(every)]] == s[at < len(every)]]] = 1
    return out


def _alike_across(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of the left are similar enough to which of the right."""
    shared = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    common = np.zeros((len(left), len(right)), np.int64)
    for k in range(0, len(shared), COLUMNS):
        part = shared[k : k + COLUMNS]
        common += (_incidence(left, part) @ _incidence(right, part).T).astype(np.int64)
    sizes = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])
    return 100 * common >= percent * (sizes - common)


def _confirm_large(within: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components within large nodes.

    ``within``: (node, cid, n, label). A node's members outside its largest component meet all its members,
    block by block; a block's work yields one link for each member and component that it reaches.
    """
    largest = within.groupBy("node", "label").count().groupBy("node").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.sum("count").alias("members"), (F.sum("count") - F.max("count")).alias("outside"))
    held = F.col("members").alias("held")
    shape, shape_at = kept(largest.where("outside > 0").select("node", "main", held, *(F.ceil(F.col(c) / BLOCK).cast("int").alias(c) for c in ("members", "outside"))))
    rows, rows_at = kept(spread_join(within, shape, "node", "held"))
    own = F.xxhash64("cid")
    left = rows.where(F.col("label") != F.col("main")).select("node", F.pmod(own, F.col("outside")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("members") - 1)).alias("j"), F.lit(0).alias("side"), "cid", "label")
    right = rows.select("node", F.explode(F.sequence(F.lit(0), F.col("outside") - 1)).alias("i"), F.pmod(own, F.col("members")).cast("int").alias("j"), F.lit(1).alias("side"), "cid", "label")
    dealt = left.unionByName(right).join(sets, "cid").select("node", "i", "j", "side", "cid", "label", "rest")
    dealt = dealt.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j", "side")

    def across(part: pa.Table) -> list:
        side, ids, label = (part.column(c).to_numpy() for c in ("side", "cid", "label"))
        cut = int((side == 0).sum())
        if not 0 < cut < len(ids):
            return []
        sets = [np.frombuffer(x, "<u8") for x in part.column("rest").to_pylist()]
        alike = _alike_across(sets[:cut], sets[cut:], percent) & (label[:cut, None] != label[None, cut:])
        out: list[tuple[int, int]] = []
        for row in np.flatnonzero(alike.any(axis=1)):
            reached = cut + np.flatnonzero(alike[row])
            out += [(int(ids[row]), int(ids[k])) for k in reached[np.unique(label[reached], return_index=True)[1]]]
        return list(zip(*out))

    links = stored(by_group(dealt, ["node", "i", "j"], across, "a long, b long"))
    discard(shape_at, rows_at)
    return links


def _labelled(rows: DataFrame, labels: DataFrame, column: str, out: str) -> DataFrame:
    found = labels.select(F.col("id").alias(column), F.col("label").alias("__label"))
    return rows.join(found, column, "left").withColumn(out, F.coalesce("__label", column)).drop("__label")


def _source(text: str) -> F.Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def _judged(docs: DataFrame, words: int, percent: int, id_col: str, text: str) -> DataFrame:
    """A row a document: id, source (the text's digest), n, first: the least (id, source) of the documents reachable; null without a set."""
    texts = docs.select(F.col(id_col).alias("id"), _source(text).alias("source"), F.col(text).alias("text"))
    every = stored(_sets(texts, words, full=False))
    # One class for equal sets, with a number of its own: ids may come with several texts.
    least = F.min(F.struct("id", "source")).alias("first")
    classes = every.where("n > 0 and id is not null").groupBy("digest").agg(least, F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("rest").alias("rest"), F.first("sketch").alias("sketch"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("cid"), "*"))
    pairs, deep = _candidates(classes.select("cid", "n", "rest"), percent)
    pairs = _possible(pairs, classes.select("cid", "n", "sketch"), percent)
    ids = pairs.select(F.col("hub").alias("cid")).union(pairs.select("member")).union(deep.select("cid")).distinct()
    wanted = stored(classes.join(ids, "cid", "left_semi").select("cid", "digest", "first.id", "first.source"))
    needed = texts.join(small(wanted.select("id", "source")), ["id", "source"], "left_semi")
    sets = _sets(needed, words, full=True).join(small(wanted.select("cid", "id", "source")), ["id", "source"])
    again = every.select("id", "source").join(small(wanted.select("cid", "id", "source")), ["id", "source"]).groupBy("cid").count().where("count > 1")
    if again.isEmpty():  # otherwise rows repeat an id and text
        sets = stored(sets.select("cid", "rest"))
    else:
        sets = stored(sets.select("cid", "rest").dropDuplicates(["cid"]))
    links = _confirm(pairs.where(F.col("tree") < FIRST_TREES), sets, percent)
    labels = components(links)
    apart = _labelled(_labelled(pairs.where(F.col("tree") >= FIRST_TREES), labels, "hub", "la"), labels, "member", "lb").where("la <> lb").select("hub", "member")
    links = links.unionByName(_confirm(stored(apart), sets, percent))
    labels = components(links)
    links = links.unionByName(_confirm_large(stored(_labelled(deep, labels, "cid", "label")), sets, percent))
    labels = components(links)
    linked = stored(classes.select("cid", "first", "digest", "copies").join(labels.withColumnRenamed("id", "cid"), "cid"))
    leasts = stored(linked.groupBy("label").agg(F.min("first").alias("reached"), F.count(F.lit(1)).alias("n")))
    joined = spread_join(linked.select("label", "digest", "copies"), leasts, "label", "n").select("digest", "copies", F.col("reached").alias("first"))
    alone = classes.join(labels.select(F.col("id").alias("cid")), "cid", "left_anti").select("digest", "copies", "first")
    named = stored(joined.unionByName(alone))
    known = every.select("id", "source", "n", "digest")
    has_set = (F.col("n") > 0) & F.col("id").isNotNull()
    none = known.where(~has_set).select("id", "source", "n", F.lit(None).cast(named.schema["first"].dataType).alias("first"))
    return spread_join(known.where(has_set), named, "digest", "copies").select("id", "source", "n", "first").unionByName(none)


def near_duplicates(docs: DataFrame, words: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a document: id, n_shingles, component_id (smallest id reachable by links), kept (is that id)."""
    judged = _judged(docs, words, percent, id_col, text)
    result = judged.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("first.id", "id").alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, words: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` of which one of each group stays: that of the smallest id, of that the text of the least digest, once.

    Of rows that repeat an id and text, which one stays is undefined. Rows without a set or an id all stay.
    """
    judged = stored(_judged(docs, words, percent, id_col, text).where("first is not null").groupBy("id", "source", "first").agg(F.count(F.lit(1)).alias("times")))
    stays = (F.col("id") == F.col("first.id")) & (F.col("source") == F.col("first.source"))
    gone = stored(judged.where(~stays).select(F.col("id").alias("__siltstone_id"), F.col("source").alias("__siltstone_source")))
    again = stored(judged.where(stays & (F.col("times") > 1)).select(F.col("id").alias("__siltstone_id"), F.col("source").alias("__siltstone_source")))
    own = docs.withColumns({"__siltstone_id": F.col(id_col), "__siltstone_source": _source(text)})
    kept_rows = own.join(small(gone), ["__siltstone_id", "__siltstone_source"], "left_anti")
    if not again.isEmpty():
        repeated = kept_rows.join(small(again), ["__siltstone_id", "__siltstone_source"], "left_semi").dropDuplicates(["__siltstone_id", "__siltstone_source"])
        kept_rows = kept_rows.join(small(again), ["__siltstone_id", "__siltstone_source"], "left_anti").unionByName(repeated)
    return kept_rows.select(*docs.columns)


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)
