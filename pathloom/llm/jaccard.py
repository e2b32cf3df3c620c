"""Similarity self-join of documents on sets of word shingles, with a count-vector R-tree.

Two documents link if the Jaccard similarity of their sets is at least ``PERCENT`` percent. The steps, none of which loses a link:

1. Equal sets form a class; from here on one document stands for each.
2. A document of which more than 20 % of the shingles occur nowhere else cannot link. To know which do, hashes of all shingles meet in
   packed arrays, each distinct one of a chunk of documents once, so that a very common shingle is a few entries.
3. The rest meets in blocks of documents with the same least shingle under two hash functions. In a block an R-tree over
   count vectors (how many shingles fall into each of ``GROUPS`` groups) bounds overlaps by the sum of coordinate minima; pairs
   that survive are verified, unless other links already connect them.
4. To miss nothing, documents are then compared by every shingle of their prefixes: of two linked documents the 20 % rarest
   shingles have one in common. How rare a shingle is, is counted over all sets by ranges of hashes; ties go by hash. Only shingles whose documents are not all connected yet are left, and only pairs from
   different components are verified.

Only connections are needed, so a group of m near copies costs about m verifications, not m * m.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.components import components
from pathloom.llm.text import mix, plain, release_memory, releasing, row_groups, shingle_sets
from pathloom.llm.joins import bytes_of, left_join, partitions_for, semi_join
from pathloom.scale import cut_lineage

PERCENT = 80
GROUPS = 512
LEAF = 32
# A block or half of a pair of blocks holds at most about this many documents.
BLOCK = 512
PARTS_PER_PARTITION = 4
PART_BYTES = 4 << 20
# Shingles are counted by this many upper bits of their hash.
SLOT_BITS = 20
_SLOTS_PER_ROW = 1 << 10
_CHUNK_BYTES = 2 << 20
_ALL = -1


# ---------------------------------------------------------------- shingles that occur only once

_PACKED = "part long, chunk long, doc_ids binary, sizes binary, first_hash binary, second_hash binary, keys binary, owners binary"
_COUNTED = "chunk long, doc_ids binary, sizes binary, first_hash binary, second_hash binary, owners binary, counts binary"
_SLOTS = "place long, counts binary"
_INFO = "doc_id long, n_shingles long, first_hash long, second_hash long, may_link boolean"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def _rows(ddl: str, rows: list[tuple]) -> pa.RecordBatch:
    schema = _schema(ddl)
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _dicts(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch one by one, so that only one is held twice."""
    for i in range(len(batch)):
        yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def _pack(parts: int, read: Callable) -> Callable:
    """Chunks of documents as one row with their ids and set hashes and one per part with the hashes of their shingles.

    A shingle of several documents of a chunk is one key without an owner."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_ids, sets in read(batch):
                sizes = np.array([len(s) for s in sets], np.int64)
                keys = np.concatenate([np.empty(0, np.uint64), *sets])
                owner = np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
                sums = np.zeros((2, len(keys) + 1), np.uint64)
                for row, salt in zip(sums, (0x5851F42D4C957F2D, 0x14057B7EF767814F)):
                    np.cumsum(mix(keys ^ np.uint64(salt)), out=row[1:])
                ends = np.append(0, np.cumsum(sizes))
                first_hash, second_hash = sums[:, ends[1:]] - sums[:, ends[:-1]]
                yield _rows(_PACKED, [(_ALL, chunk, doc_ids.tobytes(), sizes.tobytes(), first_hash.tobytes(), second_hash.tobytes(), b"", b"")])
                order = np.argsort(keys)
                ordered = keys[order]
                new = np.append(True, ordered[1:] != ordered[:-1]) if len(keys) else np.empty(0, bool)
                starts = np.flatnonzero(new)
                alone = np.diff(np.append(starts, len(keys))) == 1
                owners = np.where(alone, owner[order[starts]], np.uint32(2**32 - 1))
                keys = ordered[starts]
                part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)  # ascending like the keys
                bounds = np.searchsorted(part, np.arange(parts + 1))
                low = keys.astype(np.uint32)
                out = []
                for p in np.flatnonzero(np.diff(bounds)):
                    a, b = bounds[p], bounds[p + 1]
                    by_owner = np.argsort(owners[a:b], kind="stable")  # equal owners together compress well
                    out.append((int(p), chunk, b"", b"", b"", b"", low[a:b][by_owner].tobytes(), owners[a:b][by_owner].tobytes()))
                for i in range(0, len(out), 64):
                    yield _rows(_PACKED, out[i:i + 64])
                chunk += 1

    return work


def _count_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk and document how many of its shingles of one part occur in no other document. Rows come by part."""
    part: int | None = None
    held: list[tuple[int, np.ndarray, np.ndarray]] = []

    def counted() -> pa.RecordBatch:
        keys = np.concatenate([k for _, k, _ in held])
        order = np.argsort(keys)
        ordered = keys[order]
        edge = np.append(np.append(True, ordered[1:] != ordered[:-1]), True)
        alone = np.zeros(len(keys), bool)
        alone[order] = edge[:-1] & edge[1:]
        out, at = [], 0
        for chunk, k, owners in held:
            own = owners[alone[at:at + len(k)]]
            at += len(k)
            names, counts = np.unique(own[own != 2**32 - 1], return_counts=True)
            if len(names):
                out.append((chunk, b"", b"", b"", b"", names.tobytes(), counts.astype(np.uint32).tobytes()))
        return _rows(_COUNTED, out)

    for batch in batches:
        for row in _dicts(batch):
            if row["part"] == _ALL:
                yield _rows(_COUNTED, [(row["chunk"], row["doc_ids"], row["sizes"], row["first_hash"], row["second_hash"], b"", b"")])
                continue
            if row["part"] != part and held:
                yield counted()
                held = []
            part = row["part"]
            held.append((row["chunk"], np.frombuffer(row["keys"], np.uint32), np.frombuffer(row["owners"], np.uint32)))
    if held:
        yield counted()


def _judge(percent: int) -> Callable:
    """One row per document: its set's size and hashes, and whether enough of its shingles occur elsewhere. Rows come by chunk."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: int | None = None
        info: dict | None = None
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def judged() -> pa.RecordBatch:
            sizes = np.frombuffer(info["sizes"], np.int64)
            alone = np.zeros(len(sizes), np.int64)
            for names, counts in held:
                alone[names] += counts
            columns = [np.frombuffer(info["doc_ids"], np.int64), sizes, np.frombuffer(info["first_hash"], np.int64),
                       np.frombuffer(info["second_hash"], np.int64), (sizes > 0) & (100 * (sizes - alone) >= percent * sizes)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_schema(_INFO))

        for batch in batches:
            for row in _dicts(batch):
                if row["chunk"] != chunk:
                    if info is not None:
                        yield judged()
                    chunk, info, held = row["chunk"], None, []
                if row["doc_ids"] or not row["owners"]:
                    info = row
                else:
                    held.append((np.frombuffer(row["owners"], np.uint32), np.frombuffer(row["counts"], np.uint32)))
        if info is not None:
            yield judged()

    return work


def _from_texts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    ids, texts = batch.column(0).to_numpy(zero_copy_only=False), plain(batch.column(1))
    for start, stop in row_groups(texts, _CHUNK_BYTES):
        yield ids[start:stop], list(shingle_sets(texts.slice(start, stop - start)))


def _from_sets(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    for start in range(0, len(batch), 1024):
        part = batch.slice(start, 1024)
        yield part.column(0).to_numpy(), [np.frombuffer(s, np.uint64) for s in part.column(1).to_pylist()]


def _occurrence(rows: DataFrame, read: Callable, percent: int) -> DataFrame:
    """``_INFO`` of ``rows (doc_id, text or set)``."""
    size = bytes_of(rows, rows.columns[1])
    partitions = partitions_for(rows.sparkSession, size)
    # A task holds one part at a time, so parts stay small where partitions grow.
    parts = max(PARTS_PER_PARTITION * partitions, -(-size // PART_BYTES))
    packed = rows.mapInArrow(releasing(_pack(parts, read)), _PACKED)
    # The rows with the ids of a chunk are spread like a part of their own each.
    place = F.when(F.col("part") == _ALL, F.xxhash64("chunk")).otherwise(F.col("part"))
    counted = packed.withColumn("place", place).repartition(partitions, "place").sortWithinPartitions("part").drop("place").mapInArrow(releasing(_count_alone), _COUNTED)
    return counted.repartition(partitions, "chunk").sortWithinPartitions("chunk").mapInArrow(releasing(_judge(percent)), _INFO)


# ---------------------------------------------------------------- the R-tree


def links(a: int, b: int, overlap, percent: int):
    """Whether sets of these sizes with this overlap are similar enough, in whole numbers."""
    return 100 * overlap >= percent * (a + b - overlap)


def count_vectors(sets: list[np.ndarray], groups: int = GROUPS) -> np.ndarray:
    """How many members of each set fall into each group of hashes."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    group = (np.concatenate([np.empty(0, np.uint64), *sets]) % np.uint64(groups)).astype(np.int64)
    return np.bincount(owner * groups + group, minlength=len(sets) * groups).reshape(len(sets), groups).astype(np.uint16 if max(map(len, sets), default=0) < 2**16 else np.int32)


class CountTree:
    """An R-tree over count vectors. Points are ordered so that each node covers a range; a node keeps the largest count of each
    group and the sizes of the smallest and largest set below."""

    def __init__(self, counts: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(counts))
        self.leaf = leaf
        self.nodes: list[tuple] = []  # start, stop, largest counts, least size, largest size, children
        self._counts, self._sizes = counts, counts.sum(axis=1, dtype=np.int64)
        self.root = self._build(0, len(counts)) if len(counts) else None
        self.counts, self.sizes = counts[self.order], self._sizes[self.order]

    def _build(self, start: int, stop: int) -> int:
        rows = self.order[start:stop]
        points, sizes = self._counts[rows], self._sizes[rows]
        children = ()
        if stop - start > self.leaf:
            spread = np.append(points.max(axis=0).astype(np.int64) - points.min(axis=0), sizes.max() - sizes.min())
            widest = int(spread.argmax())
            along = sizes if widest == points.shape[1] else points[:, widest]
            self.order[start:stop] = rows[np.argsort(along, kind="stable")]
            middle = (start + stop) // 2
            children = (self._build(start, middle), self._build(middle, stop))
        self.nodes.append((start, stop, points.max(axis=0), int(sizes.min()), int(sizes.max()), children))
        return len(self.nodes) - 1

    def candidates(self, counts: np.ndarray, percent: int, skip: Callable[[int, int], bool]) -> Iterator[np.ndarray]:
        """Places (in ``order``) of sets that may be similar enough to one with these counts; ranges with ``skip(start, stop)`` are left out."""
        size = int(counts.sum(dtype=np.int64))
        stack = [self.root] if self.root is not None else []
        while stack:
            start, stop, largest, least, most, children = self.nodes[stack.pop()]
            bound = int(np.minimum(counts, largest).sum(dtype=np.int64))
            # The overlap that a set of the least fitting size would need.
            near = max(least, -(-percent * size // 100))
            if near > min(most, size * 100 // percent) or not links(size, near, min(bound, size, near), percent) or skip(start, stop):
                continue
            if children:
                stack += children
                continue
            bounds = np.minimum(self.counts[start:stop], counts).sum(axis=1, dtype=np.int64)
            yield start + np.flatnonzero(links(size, self.sizes[start:stop], bounds, percent))


class _Labels:
    """Components of the points of a tree, as one label per place."""

    def __init__(self, labels: np.ndarray):
        self.labels = labels

    def same(self, start: int, stop: int, place: int) -> bool:
        return bool((self.labels[start:stop] == self.labels[place]).all())

    def join(self, a: int, b: int) -> None:
        self.labels[self.labels == self.labels[b]] = self.labels[a]


def link_block(nodes: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect what is connected within a block."""
    tree = CountTree(count_vectors(sets))
    labels = _Labels(np.arange(len(nodes)))
    order, found = tree.order, []
    for place in range(len(nodes)):
        own = sets[order[place]]
        for near in tree.candidates(tree.counts[place], percent, lambda a, b: b <= place or labels.same(a, b, place)):
            for other in near:
                if other > place and labels.labels[other] != labels.labels[place]:
                    theirs = sets[order[other]]
                    overlap = len(np.intersect1d(own, theirs, assume_unique=True))
                    if links(len(own), len(theirs), overlap, percent):
                        labels.join(place, other)
                        found.append((int(nodes[order[place]]), int(nodes[order[other]])))
    return found


def pair_block(nodes: np.ndarray, counts: np.ndarray, roots: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs from different components that the count vectors don't rule out. ``side`` 0 or 1: only pairs between both sides; 2: all."""
    tree = CountTree(counts)
    labels, side = _Labels(roots[tree.order]), side[tree.order]
    found = []
    for place in range(len(nodes)):
        for near in tree.candidates(tree.counts[place], percent, lambda a, b: b <= place or labels.same(a, b, place)):
            fits = (near > place) & (labels.labels[near] != labels.labels[place]) & ((side[near] != side[place]) | (side[near] == 2))
            found += [(int(nodes[tree.order[place]]), int(nodes[tree.order[other]])) for other in near[fits]]
    return found


# ---------------------------------------------------------------- blocks and prefixes

_PAIRS = "a long, b long"


def _by_block(work: Callable[[pa.Table], list[tuple[int, int]]]) -> Callable:
    """Applies ``work`` to the rows of each block; rows come by block, whose name is the first column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []

        def done() -> pa.RecordBatch:
            return _rows(_PAIRS, work(pa.Table.from_batches(held)))

        for batch in batches:
            names = batch.column(0).to_pylist()
            start = 0
            while start < len(names):
                stop = start
                while stop < len(names) and names[stop] == names[start]:
                    stop += 1
                if names[start] != name:
                    if held and sum(map(len, held)) > 1:
                        yield done()
                    name, held = names[start], []
                held.append(batch.slice(start, stop - start))
                start = stop
        if held and sum(map(len, held)) > 1:
            yield done()

    return run


def _sets_of(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(value, np.uint64) for value in column.to_pylist()]


def _slices(column: pa.Array, rows: int = 256) -> Iterator[list[np.ndarray]]:
    """The sets of a batch, few at a time."""
    for start in range(0, len(column), rows):
        yield _sets_of(column.slice(start, rows))


def _least_shingles(column: Column) -> Column:
    """The least shingle of a set under two hash functions."""
    salts = np.array([0x2545F4914F6CDD1D, 0x369DEA0F31A53F85], np.uint64)

    @F.arrow_udf("array<long>")
    def work(column: pa.Array) -> pa.Array:
        return pa.array([[int(mix(s ^ salt).min().view(np.int64)) for salt in salts] for sets in _slices(column) for s in sets], pa.list_(pa.int64()))

    return work(column)


def _count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of a task's sets fall into each slot, as rows of neighbouring slots."""
    counts = np.zeros(1 << SLOT_BITS, np.int64)
    for batch in batches:
        for sets in _slices(batch.column(0)):
            counts += np.bincount(_slots_of(np.concatenate(sets)), minlength=len(counts))
    rows = [(place, row.tobytes()) for place, row in enumerate(counts.reshape(-1, _SLOTS_PER_ROW)) if row.any()]
    yield _rows(_SLOTS, rows)


def _add_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the rows of the same slots, which come one after another."""
    place, total = None, None
    for batch in batches:
        for row in _dicts(batch):
            counts = np.frombuffer(row["counts"], np.int64)
            if row["place"] == place:
                total += counts
                continue
            if place is not None:
                yield _rows(_SLOTS, [(place, total.tobytes())])
            place, total = row["place"], counts.copy()
    if place is not None:
        yield _rows(_SLOTS, [(place, total.tobytes())])


def frequency_classes(sets: DataFrame) -> np.ndarray:
    """The class of each slot: the number of binary digits of the count of all its shingles in all ``sets``.

    A slot is a range of hashes. There are always ``2 ** SLOT_BITS`` of them, so a task, a row of the shuffle and the result (1 MB) do not grow with the data. A
    shingle of many documents makes its slot's class high; rare shingles that share the slot are taken for frequent, too.
    """
    counted = sets.select("set").mapInArrow(releasing(_count_slots), _SLOTS)
    added = counted.repartition("place").sortWithinPartitions("place").mapInArrow(_add_slots, _SLOTS).toArrow()
    counts = np.zeros(1 << SLOT_BITS, np.int64).reshape(-1, _SLOTS_PER_ROW)
    for place, row in zip(added["place"].to_pylist(), added["counts"].to_pylist()):
        counts[place] = np.frombuffer(row, np.int64)
    return np.ceil(np.log2(counts.ravel() + 1.0)).astype(np.uint8)


def _slots_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def prefix(ordered: np.ndarray, classes: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles of a set, as many as it can lose and still link, and one more. One order of all shingles, by class and then by hash,
    serves all sets, so two sets that link have a shingle of their prefixes in common, whatever the classes are."""
    rarest = np.argsort(classes[_slots_of(ordered)], kind="stable")
    return ordered[rarest[:len(ordered) - -(-percent * len(ordered) // 100) + 1]]


def _prefix(column: Column, classes: Broadcast, percent: int) -> Column:
    @F.arrow_udf("array<long>")
    def work(column: pa.Array) -> pa.Array:
        return pa.array([prefix(s, classes.value, percent).view(np.int64) for sets in _slices(column) for s in sets], pa.list_(pa.int64()))

    return work(column)


def _packed_counts(column: Column) -> Column:
    @F.arrow_udf("binary")
    def work(column: pa.Array) -> pa.Array:
        rows = (row for sets in _slices(column) for row in count_vectors(sets))
        return pa.array([row.astype(np.int32 if row.max() >= 2**15 else np.uint16).tobytes() for row in rows], pa.binary())

    return work(column)


def _dealt(members: DataFrame, key: list[str]) -> DataFrame:
    """``members`` with at least two of a key, with the number of groups of about ``BLOCK`` that they make and the ``group`` of each."""
    sizes = members.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    groups = sizes.select(*key, F.ceil(F.col("rows") / BLOCK).alias("groups"))
    return members.join(groups, key).withColumn("group", F.pmod(F.xxhash64("node", *key), F.col("groups")))


def _link_in_blocks(sets: DataFrame, percent: int) -> DataFrame:
    least = sets.select("node", F.posexplode(_least_shingles(F.col("set"))).alias("turn", "key"))
    dealt = _dealt(cut_lineage(least), ["turn", "key"])
    blocks = cut_lineage(dealt.select("node", F.concat_ws(":", "turn", "key", "group").alias("block")))

    def work(table: pa.Table) -> list[tuple[int, int]]:
        return link_block(table["node"].to_numpy(), _sets_of(table["set"]), percent)

    rows = blocks.join(sets, "node").select("block", "node", "set")
    partitions = partitions_for(sets.sparkSession, 2 * bytes_of(sets, "set"))
    return rows.repartition(partitions, "block").sortWithinPartitions("block", "node").mapInArrow(releasing(_by_block(work)), _PAIRS)


def _pairs_left(sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a prefix shingle and that count vectors don't rule out."""
    labelled = sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = sets.sparkSession.sparkContext.broadcast(frequency_classes(sets))
    prefixes = cut_lineage(labelled.select("node", "root", F.explode(_prefix(F.col("set"), classes, percent)).alias("key")))
    # A shingle all of whose documents are connected is done; of shingles with the same documents one is enough.
    left = prefixes.groupBy("key").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("rows"),
        F.sum(F.xxhash64("node").bitwiseAND(F.lit((1 << 40) - 1))).alias("one"), F.sum(F.xxhash64(F.col("node"), F.lit(3)).bitwiseAND(F.lit((1 << 40) - 1))).alias("two"),
    ).filter("low != high")
    once = left.groupBy("rows", "one", "two").agg(F.min("key").alias("key")).select("key")
    members = cut_lineage(prefixes.join(once, "key", "left_semi"))
    dealt = cut_lineage(_dealt(members, ["key"]))
    # Every two groups of a large key meet in one block, as does each group with itself.
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("other")
    met = dealt.select("key", "node", "root", "group", "groups", other).select(
        F.concat_ws(":", "key", F.least("group", "other"), F.greatest("group", "other")).alias("block"), "node", "root",
        F.when(F.col("group") == F.col("other"), 2).when(F.col("group") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    # The block of a group with itself takes its rows as side 2; in the block of two groups they are 0 and 1.
    counts = sets.select("node", _packed_counts(F.col("set")).alias("counts"))

    def work(table: pa.Table) -> list[tuple[int, int]]:
        # Two bytes for each count or, in vectors of very large sets, four.
        packed = table["counts"].to_pylist()
        vectors = np.array([np.frombuffer(row, np.uint16 if len(row) == 2 * GROUPS else np.int32) for row in packed])
        return pair_block(table["node"].to_numpy(), vectors, table["root"].to_numpy(), table["side"].to_numpy(), percent)

    rows = met.join(counts, "node").select("block", "node", "root", "side", "counts")
    met_rows = dealt.agg(F.coalesce(F.sum("groups"), F.lit(0))).first()[0]
    partitions = partitions_for(sets.sparkSession, met_rows * 2 * GROUPS)
    pairs = rows.repartition(partitions, "block").sortWithinPartitions("block").mapInArrow(releasing(_by_block(work)), _PAIRS)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    @F.arrow_udf("boolean")
    def similar(left: pa.Array, right: pa.Array) -> pa.Array:
        both = ((x, y) for xs, ys in zip(_slices(left), _slices(right)) for x, y in zip(xs, ys))
        return pa.array([bool(links(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)), percent)) for x, y in both], pa.bool_())

    first = sets.select(F.col("node").alias("a"), F.col("set").alias("left"))
    second = sets.select(F.col("node").alias("b"), F.col("set").alias("right"))
    return pairs.join(first, "a").join(second, "b").filter(similar("left", "right")).select("a", "b")


# ---------------------------------------------------------------- the join


def similar_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The components of documents that link.

    Reads ``doc_id, text`` of ``docs``; other columns are ignored. A set holds the distinct shingles of five words; a text of fewer words is one
    shingle; a text without words and a null text have none and link with nothing. Returns one row per row of ``docs``: ``doc_id, n_shingles,
    component_id`` (smallest ``doc_id`` reached by links). Rows that repeat are linked, as equal sets are; rows that
    repeat only the id count as one document of the component. A row with a null id is returned with a null component
    and links nothing. An empty table gives an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = rows.filter("doc_id is not null")
    info = cut_lineage(_occurrence(known, _from_texts, percent))
    same_set = ["n_shingles", "first_hash", "second_hash"]
    classes = info.filter("n_shingles > 0").groupBy(*same_set).agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("rows"), F.max("may_link").alias("may_link"))
    classes = cut_lineage(classes)

    wanted = classes.filter("may_link").select(F.col("node").alias("doc_id"))

    @F.arrow_udf("binary")
    def as_set(column: pa.Array) -> pa.Array:
        found = pa.array([s.tobytes() for s in shingle_sets(plain(column))], pa.binary())
        release_memory()
        return found

    sets = cut_lineage(semi_join(known, wanted, "doc_id").select(F.col("doc_id").alias("node"), as_set("text").alias("set")).filter("octet_length(set) > 0"))
    # Now that copies are gone, fewer shingles occur elsewhere.
    again = cut_lineage(_occurrence(sets, _from_sets, percent).filter("may_link").select(F.col("doc_id").alias("node")))
    sets = cut_lineage(semi_join(sets, again, "node"))

    found = cut_lineage(_link_in_blocks(sets, percent))
    roots = components(found)
    more = cut_lineage(_verified(cut_lineage(_pairs_left(sets, roots, percent)), sets, percent))
    if more.limit(1).count():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

    # Rows of a set of their own are their own class; the others look theirs up.
    linked = classes.join(roots, "node", "left").select(*same_set, "node", "rows", F.coalesce("root", "node").alias("component_id"))
    looked_up = cut_lineage(linked.filter("rows > 1 or component_id != node").drop("node", "rows"))
    key = F.concat_ws(":", *same_set)
    named = looked_up.select(key.alias("class"), "component_id")
    out = left_join(info.withColumn("class", key), named, "class").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    lost = rows.filter("doc_id is null").select("doc_id", _set_size(F.col("text")).alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(lost)


def _set_size(text: Column) -> Column:
    @F.arrow_udf("long")
    def work(column: pa.Array) -> pa.Array:
        return pa.array([len(s) for s in shingle_sets(plain(column))], pa.int64())

    return work(text)


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each component of ``docs``, the one with the smallest id, with all columns. Rows without id stay. Of several rows with one id,
    the one with the smallest text stays (a null one first), then that with the smallest hash of all columns."""
    found = cut_lineage(similar_documents(docs, percent).filter("doc_id is not null"))
    kept = semi_join(docs, found.filter("doc_id != component_id"), "doc_id", "left_anti")
    repeated = cut_lineage(found.groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if not repeated.limit(1).count():
        return kept.select(*docs.columns)
    single = semi_join(kept, repeated, "doc_id", "left_anti").select(*docs.columns)
    row = F.struct(*docs.columns)
    first = semi_join(kept, repeated, "doc_id").groupBy("doc_id").agg(F.min_by(row, F.struct("text", F.xxhash64(*docs.columns))).alias("_row"))
    return single.unionByName(first.select("_row.*"))
