"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard.

Signatures. A first permutation shuffles a document's shingles; a second one,
circularly shifted by k, gives the k-th coordinate as its minimum over them. So
two permutations make all 100 coordinates. They are cut into bands of as many rows
as leave a pair at the threshold without a common band once in 100,000 at most: 20
bands of five for 0.85, 25 of four for 0.8.

Classes. Documents with one shingle set are one class; only its first row goes on.

Candidates. Documents with an equal band form a bucket. First every member is
compared with the bucket's leader, the member whose buckets hold most documents: the
least edited of near copies, which unites most. Then the members outside the leader's
component, the guests, meet all members of the bucket: both are dealt into blocks, and
every pair of different components is verified in the block pair of the first band
that it shares. So no pair that shares a band is left out, no bucket lies in one task,
and only links leave a task. A group of copies has no guests.

Bounds. Of the documents in buckets with guests, shingles that one document alone holds
lie in no intersection. So an intersection is at most the smaller number of the others.
Pairs, and whole documents, which cannot reach the threshold even so are not verified:
most guests among near copies, by edits of their own. The cost of the second step grows
with the remaining guests times members.

Links. The whole texts of a candidate pair come together, and the pair is linked if
100 * intersection >= percent * union of the full sets. Intersections of a block pair
are products of its sets' incidence matrices, cut by columns.

A set's identity is two 64-bit sums of its shingles' hashes, a row's is its number in
the table as first written.

Edge cases. Null, empty and blank texts have no shingles and link with nothing.
Texts of fewer than five words are one shingle. Null doc_id: the row takes part,
its component has the smallest doc_id that isn't null, kept is false. Repeated
rows are copies: of rows with the component's doc_id, all are kept. Empty table:
no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.llm import encoding
from probity.operators.graph import connected_components, forest
from probity.llm.shared import materialize, parallelism, runs
from probity.llm.shingles import mix64, overlap, shingle_sets

COORDINATES = 100
BAND_MISS = 1e-5
BLOCK, BLOCK_SHINGLES = 256, 1 << 22  # of a block: documents, and their shingles
COLUMNS = 1 << 14  # of incidence matrices that are multiplied at once
_SLICE = 1 << 15  # shingles hashed at once: they stay in the processor's cache
_ROW_SCHEMA = "node long, doc_id long, text binary, n_shingles long, set1 long, set2 long, bands array<long>"


def _permute32(x: np.ndarray) -> np.ndarray:
    """The second permutation, of 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """[set, coordinate] minima; sets are not empty."""
    out = np.empty((len(sets), COORDINATES), np.uint32)
    at = 0
    while at < len(sets):
        to, size = at, 0
        while to < len(sets) and (to == at or size + len(sets[to]) <= _SLICE):
            size += len(sets[to])
            to += 1
        first = (mix64(np.concatenate(sets[at:to])) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *[len(s) for s in sets[at : to - 1]]])
        for k in range(COORDINATES):
            out[at:to, k] = np.minimum.reduceat(_permute32(first + np.uint32(k)), starts)
        at = to
    return out


def band_rows(percent: int) -> int:
    """The most rows of a band at which a pair at the threshold has a common band, but for BAND_MISS."""
    fit = [r for r in (20, 10, 5, 4, 2) if (1 - (percent / 100) ** r) ** (COORDINATES // r) <= BAND_MISS]
    return fit[0] if fit else 1


def _describe(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """A row of _ROW_SCHEMA for each document."""
    encoding.forget()
    height = band_rows(percent)
    width = COORDINATES // height
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            sets = shingle_sets(part.column("text").to_pylist())
            n = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(n)
            set1, set2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            keys = np.zeros((len(n), width), np.uint64)
            if len(full):
                own = [sets[i] for i in full]
                flat, starts = np.concatenate(own), np.cumsum([0, *n[full][:-1]])
                set1[full] = np.add.reduceat(mix64(flat + np.uint64(1)), starts)
                set2[full] = np.add.reduceat(mix64(flat + np.uint64(2)), starts)
                sig = signatures(own)
                key = np.zeros((len(own), width), np.uint64)
                for r in range(height):
                    key = mix64(key + sig[:, r::height].astype(np.uint64) + np.uint64(r + 1))
                keys[full] = mix64(key + np.arange(width, dtype=np.uint64))
            bands = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(([0], np.where(n > 0, width, 0)))), pa.int32()), pa.array(keys[full].reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("node", "doc_id", "text")), pa.array(n), *(pa.array(x.view(np.int64)) for x in (set1, set2)), bands],
                names=[c.split()[0] for c in _ROW_SCHEMA.split(", ")],
            )


_TILE = pa.schema([*((c, pa.int64()) for c in ("key", "i", "j", "side", "node", "comp", "guest", "n", "shared")), ("bands", pa.list_(pa.int64()))])
_TILE_SCHEMA = "key long, i long, j long, side long, node long, comp long, guest long, n long, shared long, bands array<long>"


def _open_pairs(tile: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of side 0, rows of side 1, and for which pairs of them the tile's bucket
    is the first that they share, with components and sizes that allow a link."""
    side, node, comp, guest, n, shared = (np.asarray(tile.column(c)) for c in ("side", "node", "comp", "guest", "n", "shared"))
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    ok = comp[left][:, None] != comp[right][None, :]
    # two guests meet twice
    ok &= (guest[right] == 0)[None, :] | (node[left][:, None] < node[right][None, :])
    most = np.minimum(shared[left][:, None], shared[right][None, :])
    ok &= 100 * most >= percent * (n[left][:, None] + n[right][None, :] - most)
    if ok.any():
        bands = np.asarray(tile.column("bands").combine_chunks().flatten()).reshape(len(node), -1)
        for band in bands.T[: int(np.flatnonzero(bands[0] == tile.column("key")[0].as_py())[0])]:
            ok &= band[left][:, None] != band[right][None, :]
    return left, right, ok


def _open_rows(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows of tiles that are in an open pair."""
    for tile in runs(batches, ("key", "i", "j")):
        left, right, ok = _open_pairs(tile, percent)
        if ok.any():
            yield from tile.take(np.sort(np.concatenate([left[ok.any(1)], right[ok.any(0)]]))).cast(_TILE).combine_chunks().to_batches()


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left and every right set."""
    place, code = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    here = owner < len(left)
    both = (np.bincount(code[here], minlength=len(place)) > 0) & (np.bincount(code[~here], minlength=len(place)) > 0)
    column = np.cumsum(both) - 1
    owner, code = owner[both[code]], column[code[both[code]]]
    out = np.zeros((len(left), len(right)))
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    for at in range(0, int(both.sum()), COLUMNS):
        a, b = np.searchsorted(code, (at, at + COLUMNS))
        m = np.zeros((len(left) + len(right), COLUMNS if at + COLUMNS <= both.sum() else int(both.sum()) - at), np.float32)
        m[owner[a:b], code[a:b] - at] = 1  # counts of a cut stay below 2 ** 24: exact
        out += m[: len(left)] @ m[len(left) :].T
    return out


def _verify_tiles(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links between components among all open pairs of each tile."""
    for tile in runs(batches, ("key", "i", "j")):
        left, right, ok = _open_pairs(tile, percent)
        sets = shingle_sets(tile.column("text").to_pylist())
        n, comp = np.array([len(s) for s in sets]), np.asarray(tile.column("comp"))
        if ok.sum() <= len(sets):
            pairs = [(comp[left[i]], comp[right[j]]) for i, j in zip(*np.nonzero(ok), strict=True) if _linked(sets[left[i]], sets[right[j]], percent)]
        else:
            common = common_counts([sets[i] for i in left], [sets[j] for j in right])
            ok &= 100 * common >= percent * (n[left][:, None] + n[right][None, :] - common)
            i, j = np.nonzero(ok)
            pairs = list(zip(comp[left[i]].tolist(), comp[right[j]].tolist(), strict=True))
        tree = forest(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(tree.values(), pa.int64()), pa.array(tree.keys(), pa.int64())], names=["a", "b"])


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = overlap(x, y)
    return 100 * common >= percent * (len(x) + len(y) - common)


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, text) that come in twos, the pairs that are linked."""
    sets: OrderedDict[int, np.ndarray] = OrderedDict()
    other: tuple | None = None
    for batch in batches:
        a, b = [], []
        for x, y, node, text in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "node", "text")), strict=True):
            if node not in sets:
                sets[node] = shingle_sets([text])[0]
                if len(sets) > 512:
                    sets.popitem(last=False)
            own = sets[node]
            if other is None or other[:2] != (x, y):
                other = (x, y, own)
                continue
            if _linked(other[2], own, percent):
                a.append(x)
                b.append(y)
            other = None
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document and shingle."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = shingle_sets(part.column("text").to_pylist())
            node = np.repeat(np.asarray(part.column("node")), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate(sets).view(np.int64))], names=["node", "shingle"])


def lone_shingles(texts: DataFrame) -> DataFrame:
    """Of rows (node, text): node, lone, the number of its shingles that no other row holds, if any."""
    held = texts.mapInArrow(_shingle_rows, "node long, shingle long").groupBy("shingle").agg(F.count("*").alias("holders"), F.min("node").alias("node"))
    return held.where("holders = 1").groupBy("node").agg(F.count("*").alias("lone"))


def _classes(numbered: DataFrame, percent: int) -> DataFrame:
    """Of rows (node, doc_id, text): node, doc_id, n_shingles, component_id and
    comp, the component's smallest class (null without words)."""
    n = parallelism(numbered.sparkSession)
    rows = materialize(numbered.mapInArrow(partial(_describe, percent=percent), _ROW_SCHEMA), "minhash-rows")
    classes = rows.where("n_shingles > 0").groupBy("set1", "set2").agg(F.min("node").alias("node"), F.min("doc_id").alias("first_doc"))
    classes = materialize(classes, "minhash-classes")
    # merge: what grows with the documents is joined alike at every size
    ahead = rows.select("node", F.col("n_shingles").alias("n"), "bands").join(classes.select("node").hint("merge"), "node", "left_semi")
    buckets = materialize(ahead.select("node", "n", F.explode("bands").alias("key")), "minhash-bands")
    sizes = buckets.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    # written first: a join of tables alone is dealt anew where a key is hot
    members = materialize(buckets.join(materialize(sizes, "minhash-sizes").hint("merge"), "key"), "minhash-members")
    reach = materialize(members.groupBy("node").agg(F.sum("members").alias("reach")), "minhash-reach")
    # the node that most documents meet, of such ones the smallest
    leaders = members.join(reach.hint("merge"), "node").groupBy("key").agg(F.max(F.struct("reach", (-F.col("node")).alias("least"), "node", "n")).alias("leader"))
    members = materialize(members.join(materialize(leaders, "minhash-leaders").hint("merge"), "key"), "minhash-led")

    texts = rows.select("node", "text").join(members.select("node").distinct().hint("merge"), "node", "left_semi")
    texts = materialize(texts, "minhash-texts")
    led = members.where(F.col("node") != F.col("leader.node")).where(100 * F.least("n", "leader.n") >= percent * F.greatest("n", "leader.n"))
    pairs = led.select(F.least("node", "leader.node").alias("a"), F.greatest("node", "leader.node").alias("b")).distinct()
    asked = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("node"))
    both = asked.join(texts.hint("merge"), "node").repartition(n, "a", "b").sortWithinPartitions("a", "b").select("a", "b", "node", "text")
    links = materialize(both.mapInArrow(partial(_verify, percent=percent), "a long, b long"), "minhash-links")
    labels = connected_components(links)

    # the rest: members outside their leader's component, guests, meet all members of the bucket
    led_by = labels.select(F.col("node").alias("leader_node"), F.col("root").alias("leader_comp"))
    state = (
        members.where("members > 2")
        .select("key", "node", "n", F.col("leader.node").alias("leader_node"))
        .join(labels, "node", "left")
        .join(led_by, "leader_node", "left")
        .withColumn("comp", F.coalesce("root", "node"))
        .withColumn("guest", (F.col("comp") != F.coalesce("leader_comp", "leader_node")).cast("long"))
        .select("key", "node", "comp", "guest", "n")
    )
    state = materialize(state, "minhash-state")
    blocks = lambda count, weight: F.ceil(F.greatest(F.col(count) / BLOCK, F.col(weight) / BLOCK_SHINGLES))
    mixed = materialize(state.where("guest = 1").select("key").distinct(), "minhash-mixed")
    state = materialize(state.join(mixed.hint("merge"), "key", "left_semi"), "minhash-unsettled")
    lone = lone_shingles(texts.join(state.select("node").distinct().hint("merge"), "node", "left_semi"))
    state = state.join(materialize(lone, "minhash-lone").hint("merge"), "node", "left").withColumn("shared", F.col("n") - F.coalesce("lone", F.lit(0)))
    state = materialize(state.where(100 * F.col("shared") >= percent * F.col("n")).drop("lone"), "minhash-hopeful")
    sizes = state.groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("weight"), F.sum("guest").alias("guests"), F.sum(F.col("n") * F.col("guest")).alias("guest_weight")).where("guests > 0")
    sizes = sizes.select("key", blocks("members", "weight").alias("blocks"), blocks("guests", "guest_weight").alias("guest_blocks"))
    state = state.join(materialize(sizes, "minhash-blocks"), "key").join(ahead.select("node", "bands"), "node")
    home = lambda count, seed: F.pmod(F.xxhash64("node", "key", F.lit(seed)), count)
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    shown = ["node", "comp", "guest", "n", "shared", "bands"]
    guests = state.where("guest = 1").select("key", home(F.col("guest_blocks"), 1).alias("i"), every("blocks").alias("j"), F.lit(0).cast("long").alias("side"), *shown)
    others = state.select("key", every("guest_blocks").alias("i"), home(F.col("blocks"), 2).alias("j"), F.lit(1).cast("long").alias("side"), *shown)
    tiled = lambda df: df.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    open_rows = materialize(tiled(guests.union(others)).mapInArrow(partial(_open_rows, percent=percent), _TILE_SCHEMA), "minhash-open")
    more = tiled(open_rows.join(texts.hint("merge"), "node")).mapInArrow(partial(_verify_tiles, percent=percent), "a long, b long")
    more = materialize(more, "minhash-more")
    if not more.isEmpty():
        labels = connected_components(links.union(more))

    # back to all rows: class -> component -> its smallest doc_id
    comps = classes.join(labels, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root", "node")
    comps = materialize(comps, "minhash-comps")
    smallest = materialize(comps.groupBy("comp").agg(F.min("first_doc").alias("smallest")), "minhash-smallest")
    verdict = materialize(comps.drop("first_doc").join(smallest, "comp"), "minhash-verdict")
    lone = rows.where("n_shingles = 0").select("node", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("comp"))
    worded = rows.where("n_shingles > 0").join(verdict.hint("merge"), ["set1", "set2"])
    return worded.select("node", "doc_id", "n_shingles", F.col("smallest").alias("component_id"), "comp").union(lone)


def _kept() -> Column:
    return F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")


def minhash_classes(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Documents linked at a Jaccard of percent / 100. Per row of docs: doc_id,
    n_shingles, component_id, kept."""
    numbered = docs.select(F.monotonically_increasing_id().alias("node"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return _classes(numbered, percent).select("doc_id", "n_shingles", "component_id", _kept())


def deduplicate(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of docs, one of each group of near duplicates: the first one, as
    docs come, of the smallest doc_id. Rows without words all stay. Same columns."""
    numbered = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("node"))
    numbered = materialize(numbered, "dedup-rows")
    found = _classes(numbered.select("node", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("binary").alias("text")), percent)
    found = materialize(found, "dedup-classes")
    first = found.where("comp is not null").groupBy("comp").agg(F.min(F.struct(~_kept(), "node")).alias("first")).select(F.col("first.node").alias("node"))
    stay = first.union(found.where("comp is null").select("node"))
    return numbered.join(stay, "node", "left_semi").select("row.*")
