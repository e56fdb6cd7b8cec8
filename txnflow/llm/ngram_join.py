"""Exact Jaccard join of documents on word n-grams, with prefix trees, and the groups it links.

A document is the set of its distinct n-grams. Two documents are linked if 100 * common >= percent * united.

1. One global order of n-grams: rare ones first. How frequent an n-gram is comes from counts of hash buckets over all
   documents, a table of fixed size; the hash decides ties. Any order gives the same links.
2. Equal sets become one, the smallest id; only distinct sets are joined.
3. Two linked sets share one of the first n - ceil(t n) + 1 n-grams of each. These n-grams are shuffled once, as (n-gram, id), and sorted;
   equal ones are runs of neighbours, and most have no neighbour and go no further. Sets that share such an n-gram, and that bit
   sketches and sizes don't rule out, form families. A rare n-gram's sets are compared by sketch in one task; those of a
   frequent one are put into one family straight away, each linked to the one before, so no list of them meets in a task. n-grams whose bucket stands out
   are spread over several tasks by a salt, whose first sets are linked afterwards.
4. Each family's sets are joined with a prefix tree of the n-grams in global order, frequent ones at the root: sets with
   a common beginning share a path, a set walks the tree once carrying its overlap, and a subtree is left as soon as what
   remains can't reach the threshold. A family larger than a block is cut into bands of size and blocks of these: each block is joined with itself
   and with a few pivots first, then only the sets that aren't yet linked to their family's largest
   component meet the other blocks, those of their own band and its neighbours.
5. Links, at most a forest in each task, give components.

Documents with fewer words than n have their whole sequence as one n-gram; missing texts and those without a word have the
empty set, which links with nothing. Ids must be unique; rows with equal ids count as documents of one set each and share a
component. Null ids give a null component. Ids that aren't whole numbers are known by a 64-bit hash while they are linked.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from txnflow.llm.components import connected_components
from txnflow.llm.rows import ROWS, map_texts
from txnflow.llm.text import mixed, whole, windows, words
from txnflow.operators.sizing import broadcast_if_small
from txnflow.workspace import job_scope, materialize, release

#: Buckets of the frequency table: 2^18 counts, 2 MB at the driver and in each task.
BUCKET_BITS = 18
#: Bits of a set's sketch, powers of two: as many as it has n-grams, within these bounds. Beyond the upper one sketches rule out less and families grow.
SKETCH_BITS = (1 << 9, 1 << 14)
#: Sets sharing an n-gram that meet in one task; beyond it they are put into one family unseen.
RARE = 1024
#: 64-bit words of sketches compared at once.
TILE_WORDS = 1 << 21
#: A bucket with more than so many times the mean count, and ``SALTED`` besides, is spread by a salt.
STANDS_OUT, SALTED = 4, 1 << 20
#: Sets of a family that a task joins at once, and their n-grams.
BLOCK = 1536
BLOCK_GRAMS = 1 << 20
#: Sets of each large family that all its blocks meet first.
PIVOTS = 8


def gram_set(text: str | None, n: int = 4) -> np.ndarray:
    """The distinct n-grams of a text as sorted hashes."""
    found, _, _ = words(text)
    if not len(found):
        return found
    return np.unique(windows(found, n) if len(found) >= n else whole(found))


def prefix_length(size: np.ndarray | int, percent: int) -> np.ndarray | int:
    return size + (-percent * size // 100) + 1


def _buckets(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def bucket_counts(docs: DataFrame, n: int) -> np.ndarray:
    """How many documents' n-grams fall into each bucket; every task adds up its own first."""
    def counted(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in (whole.slice(k, ROWS) for whole in stream for k in range(0, whole.num_rows, ROWS)):
            for text in batch.column(0).to_pylist():
                np.add.at(total, _buckets(gram_set(text, n)), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(counted, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n")).collect()
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    for bucket, count in rows:
        out[bucket] = count
    return out


def in_order(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The n-grams, rare ones first."""
    return grams[np.lexsort((mixed(grams), counts[_buckets(grams)]))]


def _sketch(grams: np.ndarray) -> np.ndarray:
    """Bits flipped by each n-gram: sets differ in at least as many n-grams as their sketches in bits."""
    least, most = SKETCH_BITS
    bits = min(most, max(least, 1 << (len(grams) - 1).bit_length())) if len(grams) else least
    flipped = np.bincount((mixed(grams ^ np.uint64(0x5BD1E995)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flipped.astype(bool))


def _folded(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches of at least ``width`` bytes brought to it; an n-gram's bit is its hash modulo the length, so the parts of a longer one add up."""
    out = np.empty((len(sketches), width // 8), np.uint64)
    widths = np.array([len(s) for s in sketches])
    for own in np.unique(widths):
        some = np.flatnonzero(widths == own)
        parts = np.frombuffer(b"".join(sketches[k] for k in some), np.uint64).reshape(len(some), own // width, width // 8)
        out[some] = np.bitwise_xor.reduce(parts, axis=1)
    return out


def _signature(grams: np.ndarray) -> bytes:
    """128 bits that stand for the set."""
    return np.array([grams.sum(dtype=np.uint64), mixed(grams + np.uint64(11)).sum(dtype=np.uint64)]).tobytes()


def described(docs: DataFrame, counts: np.ndarray, n: int, percent: int) -> DataFrame:
    """doc_id, own, size, signature, sketch and the first n-grams of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def made(texts: list[str | None]) -> Iterator:
        sets = [gram_set(t, n) for t in texts]
        yield None, {
            "size": [len(s) for s in sets],
            "signature": [_signature(s) for s in sets],
            "sketch": [_sketch(s).tobytes() for s in sets],
            "firsts": [in_order(s, shared.value)[:prefix_length(len(s), percent) if len(s) else 0].astype(np.int64) for s in sets],
        }

    fields = {"size": "bigint", "signature": "binary", "sketch": "binary", "firsts": "array<bigint>"}
    return map_texts(docs, "text", made, fields, ("doc_id", "own")).select("row.*", *fields)


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _forest(n: int, pairs: Iterator[tuple[int, int]]) -> np.ndarray:
    """The least index each of 0 .. n-1 is linked to."""
    parent = np.arange(n)
    for a, b in pairs:
        a, b = _find(parent, a), _find(parent, b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return np.array([_find(parent, i) for i in range(n)])


def _alike(ids: np.ndarray, size: np.ndarray, sketches: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the sets of one n-gram that sizes and sketches allow, as a forest."""
    order = np.argsort(ids, kind="stable")
    ids, size, sketches = ids[order], size[order], [sketches[k] for k in order]
    near = np.eye(len(ids), dtype=bool)
    widths = np.array([len(s) for s in sketches])
    for width in np.unique(widths):
        # Sets with a sketch of this width meet those with a longer one too, each pair at the shorter width.
        here, others = np.flatnonzero(widths == width), np.flatnonzero(widths >= width)
        folded = _folded([sketches[k] for k in others], width)
        step = max(1, TILE_WORDS // folded.size)
        for k in range(0, len(here), step):
            tile = here[k:k + step]
            own, other = size[tile, None], size[others]
            both = own + other
            apart = np.bitwise_count(folded[np.searchsorted(others, tile), None] ^ folded).sum(2, dtype=np.int64)
            common = (both - apart) // 2
            found = (100 * np.minimum(own, other) >= percent * np.maximum(own, other)) & (100 * common >= percent * (both - common))
            near[np.ix_(tile, others)] |= found
            near[np.ix_(others, tile)] |= found.T
    roots, before = np.arange(len(ids)), None
    while before is None or (roots != before).any():
        before = roots
        roots = np.where(near, roots, len(ids)).min(1)
        roots = roots[roots]
    kept = roots != np.arange(len(ids))
    return ids[kept], ids[roots[kept]]


def _sketched_links(percent: int):
    """Over rows (list, doc_id, size, sketch) sorted by list."""
    def compared(rows: pa.Table) -> pa.RecordBatch:
        of, ids, sizes = (rows.column(k).to_numpy() for k in range(3))
        sketches = rows.column(3).to_pylist()
        cuts = [*np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of)]
        found = [_alike(ids[s:e], sizes[s:e], sketches[s:e], percent) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
        u, v = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = None  # those of the list that may go on in the next batch
        for batch in (whole.slice(k, 4 * ROWS) for whole in stream for k in range(0, whole.num_rows, 4 * ROWS)):
            rows = pa.Table.from_batches([batch] if rows is None else [*rows.to_batches(), batch])
            of = rows.column(0).to_numpy()
            last = int(np.searchsorted(of, of[-1]))
            if last:
                yield compared(rows.slice(0, last))
            rows = rows.slice(last)
        if rows is not None:
            yield compared(rows)

    return batches


def _salts(counts: np.ndarray, stands_out: int) -> dict[int, int]:
    """Over how many tasks the n-grams of a bucket are spread, where that is more than one."""
    usual = stands_out * counts.mean() + SALTED
    return {int(k): int(-(-counts[k] // usual)) for k in np.flatnonzero(counts > usual)}


def _runs(rare: int):
    """Over rows (gram, salt, doc_id) sorted by these: of each run of equal (gram, salt) the holders as ``docs`` if they are ``rare`` at most and not
    salted; else each holder with the one before, ``unseen``. The first holder of a salted run also comes with its ``gram``."""
    names = ["docs", "unseen", "gram"]

    def made(docs: list[np.ndarray], unseen: bool, grams: list) -> pa.RecordBatch:
        flat = np.concatenate([np.zeros(0, np.int64), *docs])
        ends = np.cumsum([0, *map(len, docs)]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(np.full(len(docs), unseen)), pa.array(grams, pa.int64())], names)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of the run that may go on in the next batch: its key, its holders while it may be a rare one, then its last holder.
        key, held, long = None, np.zeros(0, np.int64), False
        for batch in stream:
            gram, salt, ids = (batch.column(k).to_numpy() for k in range(3))
            if not len(gram):
                continue
            starts = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1])))
            ends = np.append(starts[1:], len(gram))
            goes_on = key == (gram[0], salt[0])
            lists, pairs, firsts = [], [], []
            if key is not None and not goes_on and not long and len(held) > 1:
                lists.append(held)
            # Alone in their run, and not at either end of the batch or salted: nothing to say.
            lengths = ends - starts
            worth = (lengths > 1) | (salt[starts] >= 0)
            worth[0] = worth[-1] = True
            for k in np.flatnonzero(worth):
                s, e = starts[k], ends[k]
                own, before_long = ids[s:e], False
                if k == 0 and goes_on:
                    own, before_long = np.concatenate([held, own]), long
                elif salt[s] >= 0:
                    firsts.append((gram[s], ids[s]))
                now_long = before_long or salt[s] >= 0 or len(own) > rare
                if now_long:
                    pairs.append(np.column_stack([own[1:], own[:-1]]))
                    own = own[-1:]
                if k == len(starts) - 1:
                    key, held, long = (gram[s], salt[s]), own, now_long
                elif not now_long and len(own) > 1:
                    lists.append(own)
            if lists:
                yield made(lists, False, [None] * len(lists))
            linked = np.concatenate([np.zeros((0, 2), np.int64), *pairs])
            if len(linked):
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array(np.arange(0, linked.size + 1, 2, dtype=np.int32)), pa.array(linked.ravel())),
                     pa.array(np.full(len(linked), True)), pa.nulls(len(linked), pa.int64())], names)
            if firsts:
                yield made([np.array([d]) for _, d in firsts], True, [int(g) for g, _ in firsts])
        if key is not None and not long and len(held) > 1:
            yield made([held], False, [None])

    return batches


def families(sets: DataFrame, percent: int, counts: np.ndarray, rare: int = RARE, stands_out: int = STANDS_OUT) -> DataFrame:
    """doc_id, family: sets of which any two that may be linked are in one family; sets alone aren't listed."""
    salts = _salts(counts, stands_out)
    postings = sets.select(F.explode("firsts").alias("gram"), "doc_id")
    salt = F.lit(-1)
    if salts:
        bucket = F.shiftrightunsigned("gram", 64 - BUCKET_BITS).cast("int")
        many = F.create_map(*(F.lit(x) for pair in salts.items() for x in pair))[bucket]
        salt = F.coalesce(F.pmod(F.xxhash64("doc_id"), many).cast("int"), salt)
    sorted_ = (postings.withColumn("salt", salt).select("gram", "salt", "doc_id").repartition("gram", "salt")
               .sortWithinPartitions("gram", "salt", "doc_id"))
    runs = materialize(sorted_.mapInArrow(_runs(rare), "docs array<bigint>, unseen boolean, gram bigint"), "runs")
    frequent = runs.where("unseen and gram is null").select(F.col("docs")[0].alias("u"), F.col("docs")[1].alias("v"))
    if salts:
        firsts = runs.where("gram is not null").select("gram", F.col("docs")[0].alias("u"))
        frequent = frequent.union(firsts.join(firsts.groupBy("gram").agg(F.min("u").alias("v")), "gram").select("u", "v"))
    # n-grams held by the very same sets say the same; one of them is enough.
    lists = materialize(runs.where("not unseen").select("docs").distinct().select(F.monotonically_increasing_id().alias("list"), "docs"), "lists")
    listed = lists.select("list", F.explode("docs").alias("doc_id"))
    members = listed.join(sets.select("doc_id", "size", "sketch"), "doc_id").select("list", "doc_id", "size", "sketch")
    tasks = members.repartition("list").sortWithinPartitions("list")
    near = materialize(frequent.union(tasks.mapInArrow(_sketched_links(percent), "u bigint, v bigint")), "near")
    release(runs, lists)
    found = connected_components(near).select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
    release(near)
    return found


class _Node:
    """A stretch of a path: terms ``first`` to ``last`` (exclusive) of set ``source``."""

    __slots__ = ("source", "first", "last", "children", "ends", "longest")

    def __init__(self, source: int, first: int, last: int):
        self.source, self.first, self.last = source, first, last
        self.children: list[_Node] = []
        self.ends: list[int] = []
        self.longest = last


class PrefixTree:
    """Sets of term numbers, each in rising order, as paths of one tree; a node without a branch is part of its parent.

    A node knows the sets that end with it and the size of the longest set below it.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.root = _Node(0, 0, 0)
        path, before = [self.root], np.zeros(0, np.int64)
        for k in sorted(range(len(sets)), key=lambda k: sets[k].astype(">u4").tobytes()):
            own = sets[k]
            n = min(len(own), len(before))
            differ = own[:n] != before[:n]
            common = int(differ.argmax()) if differ.any() else n
            below = None
            while path[-1].last > common:
                below = path.pop()
            if path[-1].last < common:
                branch = _Node(below.source, below.first, common)
                path[-1].children[-1] = branch
                branch.children.append(below)
                below.first = common
                path.append(branch)
            if len(own) > common:
                leaf = _Node(k, common, len(own))
                path[-1].children.append(leaf)
                path.append(leaf)
            path[-1].ends.append(k)
            before = own
        down = [self.root]
        for node in down:
            down += node.children
        for node in reversed(down):
            node.longest = max([node.last, *(c.longest for c in node.children)])

    def search(self, query: np.ndarray, percent: int, vocabulary: int) -> list[int]:
        """The sets linked to ``query`` (rising term numbers)."""
        member = np.zeros(vocabulary, bool)
        member[query] = True
        size = len(query)
        beyond = size - np.cumsum(member)  # the query's terms after each term number
        found, waiting = [], [(self.root, 0)]
        while waiting:
            node, before = waiting.pop()
            for child in node.children:
                terms = self.sets[child.source][child.first:child.last]
                overlap = before + int(np.count_nonzero(member[terms]))
                if child.ends and 100 * overlap >= percent * (child.last + size - overlap):
                    found += child.ends
                # However the path goes on, no more than this can be common, and at least this is united.
                most = overlap + min(child.longest - child.last, int(beyond[terms[-1]]))
                if child.children and 100 * most >= percent * (child.last - overlap + size):
                    waiting.append((child, overlap))
        return found


def _joined(task: pa.Table, percent: int) -> pa.Table:
    """Links between the probing and the indexed sets of a task, as a forest; ids may come twice with the same set."""
    ids, first = np.unique(task.column("doc_id").to_numpy(), return_index=True)
    task = task.take(pa.array(first))
    raw = [np.frombuffer(b.as_buffer(), np.uint64) for b in task.column("grams")]
    vocabulary, inverse = np.unique(np.concatenate(raw), return_inverse=True)
    # In the tree frequent terms come first, so that sets share the longest paths; the order of rare ones first served the prefixes.
    popular = np.empty(len(vocabulary), np.int32)
    popular[np.lexsort((vocabulary, -np.bincount(inverse)))] = np.arange(len(vocabulary), dtype=np.int32)
    cuts = np.cumsum([len(r) for r in raw])[:-1]
    sets = [np.sort(s) for s in np.split(popular[inverse], cuts)]
    probes = task.column("probe").to_numpy()
    indexed = np.flatnonzero(task.column("indexed").to_numpy())
    tree = PrefixTree([sets[k] for k in indexed])
    pairs = ((int(k), int(j)) for k in np.flatnonzero(probes)
             for j in indexed[tree.search(sets[k], percent, len(vocabulary))] if j != k)
    roots = _forest(len(ids), pairs)
    kept = roots != np.arange(len(ids))
    return pa.table({"u": ids[kept], "v": ids[roots[kept]]})


def _links(tasks: DataFrame, percent: int) -> DataFrame:
    """tasks: key columns family, a, b, then doc_id, grams, probe, indexed."""
    return tasks.groupBy("family", "a", "b").applyInArrow(lambda t: _joined(t, percent), "u bigint, v bigint")


def family_links(members: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Links among the members (family, doc_id, grams, n_grams) of each family that connect all that is linked.

    The n-grams are stored once and stay in place; what is found out about members on the way are tables of ids, which are sent to them where they are
    measured to be small. A large family is cut into bands of size and these into blocks, so that a set meets no block whose sizes its own rules out.
    """
    # Linked sets have sizes in one band or in neighbouring ones; the slack keeps rounding from setting them two bands apart.
    band = F.col("n_grams") if percent >= 100 else F.floor(F.log(F.col("n_grams").cast("double")) / (1.001 * math.log(100 / percent)))
    banded = members.withColumn("band", band)
    sizes = (banded.groupBy("family", "band").agg(F.count(F.lit(1)).alias("n"), F.sum("n_grams").alias("all_grams"))
             .withColumn("blocks", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("all_grams") / BLOCK_GRAMS))))
    whole_family = sizes.groupBy("family").agg((F.greatest(F.ceil(F.sum("n") / block), F.ceil(F.sum("all_grams") / BLOCK_GRAMS)) > 1).alias("is_large"))
    cells = materialize(sizes.join(whole_family, "family"), "cells")
    placed = banded.join(broadcast_if_small(cells.select("family", "band", "n", "blocks", "is_large")), ["family", "band"])
    small = placed.where("not is_large")
    first = _links(small.select("family", F.lit(0).alias("a"), F.lit(0).alias("b"), "doc_id", "grams", F.lit(True).alias("probe"), F.lit(True).alias("indexed")), percent)
    large = placed.where("is_large")
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    ids = materialize(large.select("family", "band", "doc_id", "n", "blocks", spread.alias("spread")).dropDuplicates(["doc_id"])
                      .withColumn("own", F.col("spread") % F.col("blocks")), "ids")
    if ids.isEmpty():
        return first

    def numbers(end):
        """0 up to ``end``, exclusive; nothing below 1."""
        return F.when(end > 0, F.sequence(F.lit(0).cast("bigint"), end.cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>"))

    def place(band, number):
        """A block or group of a band as one number."""
        return band.cast("bigint") * F.lit(1 << 32) + number

    # Pivots: the members of a band with the smallest spread values meet all its blocks.
    pivot = ids.withColumn("rank", F.row_number().over(Window.partitionBy("family", "band").orderBy("spread", "doc_id"))).where(F.col("rank") <= PIVOTS)
    meets = ids.join(broadcast_if_small(pivot.select("doc_id", F.lit(True).alias("is_pivot"))), "doc_id", "left").select(
        "doc_id", F.explode(F.when(F.col("is_pivot"), numbers(F.col("blocks"))).otherwise(F.array("own"))).alias("number"), F.col("band").alias("of"))
    meets = materialize(meets.select("doc_id", place(F.col("of"), F.col("number")).alias("a")), "meets")
    grams = large.select("family", "doc_id", "grams")
    inside = materialize(_links(grams.join(broadcast_if_small(meets), "doc_id").select(
        "family", "a", F.lit(0).alias("b"), "doc_id", "grams", F.lit(True).alias("probe"), F.lit(True).alias("indexed")), percent), "inside")
    component = connected_components(inside)
    labelled = (ids.join(broadcast_if_small(component), ids.doc_id == component.node, "left")
                .withColumn("label", F.coalesce("component", "doc_id")).drop("node", "component"))
    labels = labelled.groupBy("family", "label").agg(F.count(F.lit(1)).alias("n_label"))
    largest = labels.groupBy("family").agg(F.max_by("label", F.struct("n_label", "label")).alias("giant"))
    # Members of the largest component are linked already; all others meet the blocks of their band and of its neighbours, in groups as large as a block.
    state = materialize(labelled.join(broadcast_if_small(largest), "family").withColumn("loose", F.col("label") != F.col("giant")), "labelled")
    counted = materialize(state.groupBy("family", "band").agg(F.first("blocks").alias("blocks"), F.ceil(
        F.count_if("loose") * F.first("blocks") / F.first("n")).alias("groups")), "groups")
    around = None
    for step in (-1, 0, 1):
        found = counted.select("family", (F.col("band") - step).alias("band"), F.struct(
            F.lit(step).alias("step"), "blocks", "groups").alias("there"))
        around = found if around is None else around.union(found)
    around = around.groupBy("family", "band").agg(F.collect_list("there").alias("around"))  # three at most
    groups = counted.select("family", "band", "groups")
    state = state.join(broadcast_if_small(groups), ["family", "band"]).join(broadcast_if_small(materialize(
        around.select("family", "band", F.transform("around", lambda x: F.array(x["step"].cast("bigint"), x["blocks"], x["groups"])).alias("around")), "around")),
        ["family", "band"])
    group = F.when(F.col("loose"), F.col("spread") % F.col("groups"))
    here, own = F.col("band"), F.col("own")

    def task(a, b, probe, indexed):
        return F.struct(a.alias("a"), b.alias("b"), probe.alias("probe"), indexed.alias("indexed"))

    # A loose member probes the blocks around; every member is indexed for the groups around, where it isn't that already.
    probing = F.flatten(F.transform("around", lambda x: F.transform(numbers(x[1]), lambda k: task(
        place(here + x[0], k), place(here, group), F.lit(True), (x[0] == 0) & (k == own)))))
    indexed = F.flatten(F.transform("around", lambda x: F.transform(
        F.filter(numbers(x[2]), lambda k: ~(F.col("loose") & (x[0] == 0) & (k == group))),
        lambda k: task(place(here, own), place(here + x[0], k), F.lit(False), F.lit(True)))))
    tasks = materialize(state.select("doc_id", F.explode(F.when(F.col("loose"), F.concat(probing, indexed)).otherwise(indexed)).alias("x"))
                        .select("doc_id", "x.*"), "tasks")
    return first.union(inside).union(_links(grams.join(broadcast_if_small(tasks), "doc_id"), percent))


def link(docs: DataFrame, n: int = 4, percent: int = 85, rare: int = RARE, block: int = BLOCK, stands_out: int = STANDS_OUT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id."""
    kind = docs.schema["doc_id"].dataType
    own = F.col("doc_id")
    number = own.cast("bigint") if isinstance(kind, IntegralType) else F.when(own.isNotNull(), F.xxhash64(own))
    docs = docs.select(number.alias("doc_id"), own.alias("own"), "text")
    with job_scope(docs.sparkSession) as scope:
        linked = _linked(docs, n, percent, rare, block, stands_out)
        if isinstance(kind, IntegralType):
            return scope.keep(linked.select(F.col("own").alias("doc_id"), "n_shingles", F.col("component").cast(kind).alias("component_id")), "linked")
        linked = materialize(linked, "linked")
        least = linked.where("component is not null").groupBy("component").agg(F.min("own").alias("component_id"))
        return scope.keep(linked.join(least, "component", "left").select(F.col("own").alias("doc_id"), "n_shingles", "component_id"), "linked")


def _linked(docs: DataFrame, n: int, percent: int, rare: int, block: int, stands_out: int) -> DataFrame:
    """own, n_shingles, component for each row of ``docs`` (doc_id as a number, own, text)."""
    counts = bucket_counts(docs, n)
    sets = materialize(described(docs, counts, n, percent), "sets")
    whose = sets.where("size > 0 and doc_id is not null").groupBy("signature").agg(F.min("doc_id").alias("rep"))
    named = materialize(sets.select("doc_id", "own", "size", "signature").join(whose, "signature", "left")
                        .select("doc_id", "own", "size", F.coalesce("rep", "doc_id").alias("rep")), "named")
    chosen = materialize(sets.where("size > 0").join(named.where("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi")
                         .dropDuplicates(["doc_id"]).select("doc_id", "size", "sketch", "firsts"), "distinct")
    release(sets)
    family = materialize(families(chosen, percent, counts, rare, stands_out), "families")
    release(chosen)

    # The members' sets are made anew from their texts, which stay where they are if the list of members is small enough to send.
    def made(texts: list[str | None]) -> Iterator:
        own = [gram_set(t, n) for t in texts]
        yield None, {"grams": [s.tobytes() for s in own], "n_grams": [len(s) for s in own]}

    members = map_texts(docs.join(broadcast_if_small(family), "doc_id"), "text", made, {"grams": "binary", "n_grams": "bigint"}, ["family", "doc_id"])
    stored = materialize(members.select("row.*", "grams", "n_grams"), "grams")
    component = connected_components(family_links(stored, percent, block))
    return (named.join(broadcast_if_small(component), named.rep == component.node, "left")
            .select("own", F.col("size").alias("n_shingles"), F.coalesce("component", "rep").alias("component")))


def one_of_each(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """Of the documents of each component the one with the smallest id, all columns as they were."""
    groups = link(docs, n, percent)
    kept = groups.where("doc_id <=> component_id").select("doc_id").distinct()
    return docs.join(kept, docs.doc_id.eqNullSafe(kept.doc_id), "left_semi")
