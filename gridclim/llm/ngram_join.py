"""N-gram Jaccard join by parity sketches.

Each shingle flips one bit of a sketch, so the bits in which two sketches differ are no more than
the shingles in which two sets differ. Sets of similarity 0.8 differ in at most a quarter of the
smaller one. Two sketches serve:

* A wide sparse one, cut into blocks. Only the flipped bits of a block are kept, folded by XOR into
  one 64-bit signature. With more blocks than shingles that may differ, linked sets agree in
  whole blocks (pigeonhole). Blocks are compared within bands of set sizes. Of its blocks a set
  need offer only as many as may differ, plus one, if all sets choose by one order; the rarest
  come first, so common passages do not meet.
* A dense one of about two bits a shingle for the Hamming bound, checked before the sets are.

Sets that meet are compared with the smallest of their block first; linked ones become one
component. After that only sets of different components are compared, first each with its nearest
by the sketches, then all that are left. Every link between components is found; links within a
component that is known already add nothing to it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shingles import WordHasher, runs, shingle_sets
from .tables import (
    bytes_and_offsets, chosen, in_files, mix, released, released_group, stored, text_bytes,
)

#: Least similarity in percent. The quarter and the ninth below follow from it.
PERCENT = 80
#: Sets below this size are linked with equal sets only: one shingle more or less is too much.
SMALLEST = 4
#: Blocks per shingle that may differ; what exceeds 1 lets a set leave out its commonest blocks.
SPARE = 1.33
#: Members of a block that are compared in one task, and members of all blocks that a task gets.
BLOCK_ROWS = 2000
TASK_ROWS = 20_000
NODES = "doc_id long, n_shingles long, node long, sketch binary"


@dataclass(frozen=True)
class Band:
    """Sets of ``low`` to ``high`` - 1 shingles, and larger ones that can be linked with them."""

    low: int
    high: int

    @property
    def differing(self) -> int:
        return (self.high - 1) // 4

    @property
    def blocks(self) -> int:
        return int(np.ceil(SPARE * (self.differing + 1))) + 1


def bands(largest: int = 1 << 40) -> list[Band]:
    found, low = [], SMALLEST
    while low < largest:
        found.append(Band(low, -(-low * 3 // 2)))
        low = found[-1].high
    return found


BANDS = bands()
LOWS = np.array([band.low for band in BANDS])


def sketch_bits(n_shingles: np.ndarray) -> np.ndarray:
    """A power of two, at least twice the size; two sketches are compared at the smaller size."""
    return 1 << np.maximum(np.ceil(np.log2(np.maximum(2 * n_shingles, 1))), 6).astype(np.int64)


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    """A sketch at a smaller size: its halves, one flipped onto the other."""
    while len(bits) > size:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


def hamming(left: bytes, right: bytes) -> int:
    a, b = np.frombuffer(left, np.uint8), np.frombuffer(right, np.uint8)
    size = min(len(a), len(b))
    return int(np.bitwise_count(fold(a, size) ^ fold(b, size)).sum())


def sets_of(batches: Iterator[pa.RecordBatch]):
    """For runs of texts: the rows of the batch, the text of each shingle, its hash, set sizes."""
    hasher = WordHasher()
    for batch in batches:
        data, starts = bytes_and_offsets(batch.column(1))
        for low, high in runs(starts):
            base = starts[low]
            owner, value = shingle_sets(
                hasher, data[base : starts[high]], starts[low : high + 1] - base
            )
            yield batch.slice(low, high - low), owner, value, np.bincount(
                owner, minlength=high - low
            )


def node_ids(owner: np.ndarray, value: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A number that equal sets share: two sums over the set and its size, mixed."""
    starts = np.cumsum(sizes) - sizes
    node = np.zeros(len(sizes), np.uint64)
    filled = sizes > 0
    if filled.any():
        at = starts[filled]
        total = np.add.reduceat(mix(value), at)
        flipped = np.bitwise_xor.reduceat(value, at)
        node[filled] = mix(mix(total ^ sizes[filled].astype(np.uint64)) + flipped)
    return node.view(np.int64)


def nodes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node (shared by equal sets) and the dense sketch of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, owner, value, sizes in sets_of(batches):
            bits = sketch_bits(sizes)
            first = np.cumsum(bits) - bits
            low = mix(value ^ np.uint64(0x5BD1E995)) & (bits[owner] - 1).astype(np.uint64)
            flips = np.bincount(first[owner] + low.astype(np.int64), minlength=int(bits.sum()))
            packed = np.packbits((flips & 1).astype(np.uint8)).tobytes()
            edges = np.concatenate([first, [int(bits.sum())]]) // 8
            sketches = [
                packed[a:b] if n else None for a, b, n in zip(edges[:-1], edges[1:], sizes)
            ]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(sizes), pa.array(node_ids(owner, value, sizes)),
                 pa.array(sketches, pa.binary())],
                ["doc_id", "n_shingles", "node", "sketch"],
            )

    return text_bytes(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(released(run), NODES)


def block_signatures(owner, value, sizes, band_of: np.ndarray):
    """(row, token, spare) of the blocks of each row in the band given for it (-1: none).

    ``spare`` is how many of its commonest blocks a row may leave out. Empty blocks come last in
    the order, so they are left out first; a row that has too few others offers some of them."""
    chosen = band_of >= 0
    blocks = np.array([band.blocks for band in BANDS])[band_of] * chosen
    allowed = np.minimum(sizes // 4, np.array([band.differing for band in BANDS])[band_of])
    first = np.cumsum(blocks) - blocks
    own = chosen[owner]
    rows, hashes = owner[own], mix(value[own])
    at = ((hashes >> np.uint64(32)) * blocks[rows].astype(np.uint64)) >> np.uint64(32)
    cell = first[rows] + at.astype(np.int64)
    order = np.argsort(cell, kind="stable")
    cell, hashes = cell[order], mix(hashes[order] + np.uint64(1))
    heads = np.flatnonzero(np.diff(cell, prepend=-1))
    filled = cell[heads]
    signature = np.bitwise_xor.reduceat(hashes, heads) if len(heads) else hashes
    row = np.searchsorted(first + blocks, filled, side="right")
    band = band_of[row].astype(np.uint64) << np.uint64(40)
    number = (filled - first[row]).astype(np.uint64) + band
    token = mix(signature ^ mix(number + np.uint64(1)))
    spare = np.bincount(row, minlength=len(sizes)) - (allowed + 1)
    short = np.flatnonzero(chosen & (spare < 0))
    rows_out, tokens_out = [row], [token]
    for r in short:
        is_empty = np.ones(blocks[r], bool)
        is_empty[filled[row == r] - first[r]] = False
        empty = np.flatnonzero(is_empty)[: -spare[r]].astype(np.uint64)
        rows_out.append(np.full(len(empty), r))
        tokens_out.append(mix(empty + (np.uint64(band_of[r]) << np.uint64(40)) + np.uint64(1)))
    row = np.concatenate(rows_out)
    return row, np.concatenate(tokens_out), np.maximum(spare, 0)[row]


def by_run(token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of tokens, where each begins in it, and how often each occurs."""
    order = np.argsort(token, kind="stable")
    ordered = token[order]
    heads = np.flatnonzero(np.diff(ordered, prepend=ordered[:1] + np.uint64(1)))
    return order, heads, np.diff(np.append(heads, len(ordered)))


def summed(token, node, about) -> list[np.ndarray]:
    """Columns token, node, most, about: a row for each token of a run of texts. If one set has it,
    they are its node, 0 and what is said about it; if several have it, their least and largest node
    and minus their number."""
    order, heads, counts = by_run(token)
    token, node, about = token[order], node[order], about[order]
    several = counts > 1
    if not len(heads):
        return [token, node, node, about]
    return [
        token[heads], np.minimum.reduceat(node, heads),
        np.where(several, np.maximum.reduceat(node, heads), 0),
        np.where(several, -counts, about[heads]),
    ]


def members(token, node, about) -> list[np.ndarray]:
    """Columns token, node, about of the tokens that several sets of a run of texts have."""
    order, _, counts = by_run(token)
    of_several = order[np.repeat(counts > 1, counts)]
    return [token[of_several], node[of_several], about[of_several]]


def tokens(docs: DataFrame, rows_of: Callable[..., list[np.ndarray]], *names: str) -> DataFrame:
    """The rows that ``rows_of`` makes of the filled blocks of each run of texts. ``about`` holds the
    band and, in its lower half, ``spare``. Equal sets of a task are taken once; rows without doc_id
    have no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for rows, owner, value, sizes in sets_of(batches):
            node = node_ids(owner, value, sizes)
            fresh = np.zeros(len(node), bool)
            for n, number in enumerate(node.tolist()):
                if number not in seen:
                    seen.add(number)
                    fresh[n] = True
            own = np.searchsorted(LOWS, sizes, side="right") - 1
            # With the band below, if a set of it can be linked with one of this size.
            lower = np.where(
                (own > 0) & (4 * sizes <= 5 * (LOWS[np.maximum(own, 0)] - 1)), own - 1, -1
            )
            found = []
            for band_of in (np.where(fresh, own, -1), np.where(fresh, lower, -1)):
                row, token, spare = block_signatures(owner, value, sizes, band_of)
                found.append((token, node[row], (band_of[row] << 32) + spare))
            columns = rows_of(*(np.concatenate(column) for column in zip(*found)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(column.view(np.int64)) for column in columns], list(names)
            )

    known = docs.where(F.col("doc_id").isNotNull())
    return text_bytes(known, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(
        released(run), ", ".join(f"{name} long" for name in names)
    )


def meetings(docs: DataFrame) -> DataFrame:
    """(token, node): blocks that sets of different content share and offer by the common order.

    A token's number of sets and its extremes come from one row for each run of texts, so a token
    that a third of all documents have is one row for some 2 MB of text. Its members, which the runs
    have told to be such, are sent in a second pass and get the number by a join, which adaptive
    execution can split."""
    by_token = Window.partitionBy("token")
    several = F.col("about") < 0
    shared = (
        tokens(docs, summed, "token", "node", "most", "about")
        .withColumns({
            "n": F.sum(F.when(several, -F.col("about")).otherwise(1)).over(by_token),
            "least": F.min("node").over(by_token),
            "largest": F.max(F.when(several, F.col("most")).otherwise(F.col("node"))).over(by_token),
        })
        # A block of one set alone comes first in the order and meets nothing.
        .where(F.col("least") < F.col("largest"))
        .select("token", "node", "about", "n")
    )
    rows = 16 * docs.count()
    shared = stored(shared, "ngram-shared", 2 * rows)
    numbers = shared.where(several).groupBy("token").agg(F.max("n").alias("n"))
    # A set that several tasks hold comes several times.
    counted = (
        tokens(docs, members, "token", "node", "about").join(numbers, "token")
        .unionByName(shared.where(~several))
        .groupBy("token", "node", "about").agg(F.max("n").alias("n"))
    )
    # About names the band, and spare is the same for all blocks of a set in it.
    commonest = Window.partitionBy("node", "about").orderBy(F.desc("n"), F.desc("token"))
    spare = F.col("about").bitwiseAND(F.lit((1 << 32) - 1))
    offered = counted.withColumn("place", F.row_number().over(commonest)).where(
        F.col("place") > spare
    )
    return stored(offered.select("token", "node"), "ngram-meetings", rows)


def near(pairs: DataFrame, node_table: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link."""
    sides = [
        node_table.select(
            F.col("node").alias(side), F.col("sketch").alias(f"sketch_{side}"),
            F.col("n_shingles").alias(f"n_{side}"),
        )
        for side in "ab"
    ]
    return pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(released(_near), "a long, b long")


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("right"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(released(_linked), "a long, b long")


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
        keep = 5 * np.minimum(n_a, n_b) >= 4 * np.maximum(n_a, n_b)
        pairs = zip(batch.column("sketch_a"), batch.column("sketch_b"))
        for n, (left, right) in enumerate(pairs):
            if keep[n]:
                keep[n] = 9 * hamming(left.as_py(), right.as_py()) <= n_a[n] + n_b[n]
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for left, right in zip(batch.column("left"), batch.column("right")):
            a, b = (np.frombuffer(x.as_py(), np.uint64) for x in (left, right))
            common = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(100 * common >= PERCENT * (len(a) + len(b) - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def shingle_table(docs: DataFrame, node_table: DataFrame, needed: DataFrame) -> DataFrame:
    """(node, hashes) of the nodes in ``needed``, each from its smallest document."""
    first = (
        node_table.join(needed, "node", "left_semi").where(F.col("doc_id").isNotNull())
        .groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    )
    first = first.select("doc_id", F.col("node").alias("needed"))
    first = stored(first, "ngram-needed", needed.count())
    texts = text_bytes(
        chosen(docs, first, "left_semi"), F.col("doc_id").cast("long").alias("doc_id")
    ).join(first, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, owner, value, sizes in sets_of(batches):
            own = node_ids(owner, value, sizes)
            wanted = rows.column("needed").to_numpy()
            edges = np.concatenate([[0], np.cumsum(sizes)])
            # A repeated doc_id may bring another text, which is another node.
            hits = np.flatnonzero(own == wanted)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[hits]),
                 pa.array([value[edges[n] : edges[n + 1]].tobytes() for n in hits], pa.binary())],
                ["node", "hashes"],
            )

    made = texts.select("doc_id", "text", "needed").mapInArrow(
        released(run), "node long, hashes binary"
    )
    return stored(made.dropDuplicates(["node"]), "ngram-sets", 100 * needed.count())


def split_blocks(wide: DataFrame) -> DataFrame:
    """(token, node, label, own, i, j) for blocks of too many members for one task: a row for each
    two splits i and j that a member is compared in, ``own`` being its split. A component that fills
    a task is split for itself and its splits are not paired with each other; all smaller
    components of a block are split together."""
    large = (
        wide.groupBy("token", "label").agg(F.count("*").alias("size"))
        .where(F.col("size") > BLOCK_ROWS)
    )
    dealt = wide.join(large, ["token", "label"], "left").withColumn(
        "part", F.when(F.col("size").isNotNull(), F.col("label"))
    )
    splits = F.ceil(F.coalesce("size", "members") / BLOCK_ROWS)
    dealt = dealt.withColumn("number", F.pmod(F.xxhash64("node"), splits)).select(
        "token", "node", "label", F.struct("part", "number").alias("split")
    )
    in_block = Window.partitionBy("token").orderBy("split")
    numbered = dealt.select("token", "split").distinct().withColumn(
        "own", F.row_number().over(in_block)
    )
    first = numbered.select("token", F.col("own").alias("i"), F.col("split.part").alias("p"))
    second = numbered.select("token", F.col("own").alias("j"), F.col("split.part").alias("q"))
    pairs = first.join(second, "token").where(
        (F.col("i") <= F.col("j"))
        & (F.col("p").isNull() | F.col("q").isNull() | (F.col("p") != F.col("q")))
    )
    places = pairs.select("token", F.col("i").alias("own"), "i", "j").unionByName(
        pairs.where(F.col("i") < F.col("j")).select("token", F.col("j").alias("own"), "i", "j")
    )
    return (
        dealt.alias("d")
        .join(
            numbered.alias("s"),
            (F.col("d.token") == F.col("s.token")) & F.col("d.split").eqNullSafe(F.col("s.split")),
        )
        .select("d.token", "d.node", "d.label", "s.own")
        .join(places, ["token", "own"])
        .select("token", "node", "label", "own", "i", "j")
    )


def mixed_blocks(meeting: DataFrame, labels: DataFrame, node_table: DataFrame) -> DataFrame:
    """Members of the blocks in which components meet, dealt to tasks: (task, token, i, j, own).
    A block of many members is split; each two of its splits are compared in a task of their own."""
    rows = meeting.count()
    labelled = meeting.join(labels, "node", "left").select(
        "token", "node", F.coalesce("least", "node").alias("label")
    )
    labelled = stored(labelled, "ngram-labelled", rows)
    blocks = (
        labelled.groupBy("token")
        .agg(
            F.min("label").alias("low"), F.max("label").alias("high"),
            F.count("*").alias("members"),
        )
        .where(F.col("low") < F.col("high"))
        .select("token", "members")
    )
    mixed = stored(labelled.join(blocks, "token"), "ngram-mixed", rows)
    whole = mixed.where(F.col("members") <= BLOCK_ROWS).select(
        "token", "node", "label",
        *[F.lit(1).alias(name) for name in ("own", "i", "j")],
    )
    split = split_blocks(mixed.where(F.col("members") > BLOCK_ROWS))
    spread = stored(whole.unionByName(split), "ngram-spread", rows)
    tasks = 1 + spread.count() // TASK_ROWS
    task = F.pmod(F.xxhash64("token", "i", "j"), F.lit(tasks))
    return spread.withColumn("task", task).join(node_table, "node")


def near_pairs(blocks: DataFrame, best: bool) -> DataFrame:
    """(a, b) of different components in a block whose sketches allow a link; with ``best`` only
    the nearest such partner of each member. Pairs are compared within the task and not passed on
    before."""

    def run(table: pa.Table) -> pa.Table:
        names = ("token", "i", "j", "own", "node", "label")
        columns = {name: table.column(name).to_numpy() for name in names}
        sizes, sketches = table.column("n_shingles").to_numpy(), table.column("sketch").to_pylist()
        order = np.lexsort([columns["j"], columns["i"], columns["token"]])
        key = np.stack([columns[n][order] for n in ("token", "i", "j")])
        edges = np.flatnonzero((np.diff(key, prepend=key[:, :1] - 1) != 0).any(axis=0))
        found = [np.zeros((0, 2), np.int64)]
        for rows in np.split(order, edges[1:]):
            i, j = columns["i"][rows[0]], columns["j"][rows[0]]
            left, right = rows[columns["own"][rows] == i], rows[columns["own"][rows] == j]
            x, y = compared(left, right, sizes, sketches, columns["label"], best)
            found.append(np.stack([columns["node"][x], columns["node"][y]], axis=1))
        pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    grouped = blocks.groupBy("task")
    return grouped.applyInArrow(released_group(run), "a long, b long").distinct()


def compared(left, right, sizes, sketches, label, best: bool) -> tuple[list[int], list[int]]:
    """Pairs of rows of ``left`` and ``right`` that differ in label and may be linked. Both are
    ordered by their distance from one sketch; as distances obey the triangle inequality, only rows
    about as far from it are compared."""
    width = min(len(sketches[n]) for n in (*left, *right)) if len(left) and len(right) else 0
    if not width:
        return [], []

    def folded(rows):
        bits = [fold(np.frombuffer(sketches[n], np.uint8), width) for n in rows]
        return np.stack(bits).view(np.uint64)

    a, b = folded(left), folded(right)
    from_first = np.bitwise_count(b ^ b[0]).sum(axis=1).astype(np.int64)
    order = np.argsort(from_first, kind="stable")
    b, right, from_first = b[order], right[order], from_first[order]
    x, y = [], []
    for row, bits in zip(left, a):
        # The bound below is at most a quarter of the smaller set.
        reach = sizes[row] // 4
        distance = int(np.bitwise_count(bits ^ b[0]).sum())
        low = int(np.searchsorted(from_first, distance - reach, side="left"))
        high = int(np.searchsorted(from_first, distance + reach, side="right"))
        apart = np.bitwise_count(b[low:high] ^ bits).sum(axis=1).astype(np.int64)
        other = right[low:high]
        allowed = (9 * apart <= sizes[row] + sizes[other]) & (label[other] != label[row])
        hits = np.flatnonzero(allowed)
        if best and len(hits):
            hits = hits[[np.argmin(apart[hits])]]
        x.extend([row] * len(hits))
        y.extend(other[hits].tolist())
    return x, y


def ngram_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``docs`` (doc_id, text).

    Two rows are linked when they share at least 80 percent of their distinct five-word shingles.
    A null text, or one without words, has no shingles and is linked with nothing; fewer than five
    words are one shingle. component_id is the smallest doc_id of the component. Rows without
    doc_id get no component and link nothing. Repeated rows have equal sets. An empty table gives
    an empty one. Sets are told apart by 64-bit hashes of their shingles."""
    node_table = stored(nodes(docs), "ngram-nodes")
    n = node_table.count()
    meeting = meetings(docs)
    one_each = stored(
        node_table.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
        .join(meeting.select("node").distinct(), "node", "left_semi")
        .groupBy("node")
        .agg(F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles")),
        "ngram-classes",
        10 * n,
    )
    sets = shingle_table(docs, node_table, one_each)
    first = meeting.groupBy("token").agg(F.min("node").alias("a"))
    stars = (
        meeting.join(first, "token").where(F.col("a") != F.col("node"))
        .select("a", F.col("node").alias("b")).distinct()
    )
    links = stored(linked(near(stars, one_each), sets), "ngram-links", 20 * n)
    for best in (True, False):
        blocks = mixed_blocks(meeting, components(links), one_each)
        more = linked(near_pairs(blocks, best), sets)
        links = stored(links.unionByName(more), "ngram-links", 20 * n)
    return in_files(with_components(node_table, components(links)), 4 * n)


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component. Rows without doc_id
    stay."""
    found = ngram_components(docs).where(F.col("doc_id") != F.col("component_id"))
    found = found.select("doc_id").distinct()
    return chosen(docs, stored(found, "ngram-dropped", docs.count()), "left_anti")


def with_components(node_table: DataFrame, labels: DataFrame) -> DataFrame:
    label: Column = F.coalesce("least", "node")
    linked = (
        node_table.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
        .join(labels, "node", "left")
        .select("doc_id", "n_shingles", label.alias("label"))
    )
    smallest = linked.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    alone = node_table.where((F.col("n_shingles") == 0) | F.col("doc_id").isNull())
    return (
        linked.join(smallest, "label")
        .select("doc_id", "n_shingles", "component_id")
        .unionByName(alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    )
