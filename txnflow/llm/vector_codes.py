"""Vector codes: each part of a vector replaced by the number of the nearest entry of that part's codebook.

Components are whole numbers, floor(scale * x), so every distance and mean is exact. Codebooks start as the parts of the vectors with
the smallest ids; each round assigns all parts and replaces every entry by the mean of its parts, rounded down.

The nearest entry is found by equal-average search: entries are sorted by the sum of their components. By Cauchy-Schwarz the squared
distance of two parts is at least the squared gap of their sums over the number of components. The search starts at a part's
own sum, looks at the entry with the nearer sum on either side, and ends as soon as that bound strictly exceeds the best
distance. Entries of an equal distance are therefore still seen, and the lower index wins.

Vectors that are null, or hold a null or non-finite component, are left out. Those whose length isn't the commonest one that can be cut
into equal parts (the smaller of two as common) are left out too, since one codebook can't serve two lengths. Rows count one by one,
also with equal or null ids (these come last); equal starting ids are ordered by their vectors. With fewer vectors than entries the codebooks
are smaller; without vectors there are none. Vectors stay where they are: tasks send sums of their entries, at most entries x length.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnflow.llm.vectors import slices, usable, whole_numbers
from txnflow.operators.sizing import broadcast_if_small
from txnflow.workspace import materialize

PARTS = 16
#: Entries of a codebook.
ENTRIES = 64
ROUNDS = 2
#: Components are taken in steps of 1 / SCALE.
SCALE = 256
#: A label's rows are spread over so many keys where sums by label are too many to send to every task.
SALTS = 64


def _largest(width: int) -> int:
    """Components beyond it could take the squared gap of two sums of ``width`` beyond 64 bits."""
    return int(1.5e9) // width


def kept(vectors: DataFrame, column: str = "embedding", parts: int = PARTS) -> tuple[DataFrame, int]:
    """The vectors that can be coded, and their length; 0 without any."""
    length = F.size(column)
    lengths = (vectors.where(usable(column, length) & (length > 0) & (length % parts == 0))
               .groupBy(length.alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dims").first())
    dims = lengths["dims"] if lengths else 0
    return vectors.where(usable(column, dims) & F.lit(dims > 0)), dims


class Codebooks:
    """The codebooks of all parts, entries x parts x width, with their entries in the order of component sums."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        sums = entries.sum(2)
        self.order = np.argsort(sums, axis=0, kind="stable")
        self.sums = np.take_along_axis(sums, self.order, 0)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry of, and squared distance to, each part of each vector: two tables of vectors x parts."""
        n, parts, width = len(vectors), *self.entries.shape[1:]
        points = vectors.reshape(n * parts, width)
        part = np.tile(np.arange(parts), n)
        own = points.sum(1)
        count = len(self.entries)
        above = np.empty(n * parts, np.int64)  # the next entry with a sum of at least the part's own, in the order of sums
        for p in range(parts):
            above[p::parts] = np.searchsorted(self.sums[:, p], own[p::parts])
        below = above - 1
        best = np.full(n * parts, np.iinfo(np.int64).max)
        entry = np.full(n * parts, count)
        open_ = np.arange(n * parts)
        far = np.iinfo(np.int64).max
        while len(open_):
            up, down, p, s = above[open_], below[open_], part[open_], own[open_]
            gap_up = np.where(up < count, self.sums[np.minimum(up, count - 1), p] - s, far)
            gap_down = np.where(down >= 0, s - self.sums[np.maximum(down, 0), p], far)
            rising = gap_up <= gap_down
            gap = np.minimum(gap_up, gap_down)
            # With best still open nothing is beyond it; later best * width has room for 64 bits, as a distance is at most width times a squared gap.
            unseen = entry[open_] == count
            goes_on = (gap < far) & (unseen | (np.where(gap < far, gap, 0) ** 2 <= np.where(unseen, 0, best[open_]) * width))
            open_, p, rising = open_[goes_on], p[goes_on], rising[goes_on]
            at = np.where(rising, up[goes_on], down[goes_on])
            found = self.order[at, p]
            apart = points[open_] - self.entries[found, p]
            distance = (apart * apart).sum(1)
            better = (distance < best[open_]) | ((distance == best[open_]) & (found < entry[open_]))
            best[open_[better]], entry[open_[better]] = distance[better], found[better]
            above[open_[rising]] += 1
            below[open_[~rising]] -= 1
        return entry.reshape(n, parts), best.reshape(n, parts)

    def digest(self) -> str:
        """sha256 of all components by part, entry and place."""
        flat = self.entries.transpose(1, 0, 2).ravel().tolist()
        return hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()


def _sums(vectors: DataFrame, column: str, dims: int, books: Codebooks, scale: int) -> Iterator[tuple]:
    """(part, entry, place, sum, count) over all vectors for every used entry; each task adds up its own first."""
    count, parts, width = books.entries.shape

    def added(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts * count, width), np.int64)
        number = np.zeros(parts * count, np.int64)
        for batch in slices(stream, dims):
            values = whole_numbers(batch.column(0), dims, scale, _largest(width))
            entry, _ = books.nearest(values)
            slot = (entry + np.arange(parts) * count).ravel()
            number += np.bincount(slot, minlength=len(number))
            np.add.at(total, slot, values.reshape(-1, width))
        used = np.repeat(np.flatnonzero(number), width)
        place = np.tile(np.arange(width), len(used) // width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x.astype(np.int64)) for x in (used // count, used % count, place, total[used, place], number[used])],
            ["part", "entry", "place", "total", "n"])

    tasks = vectors.select(column).mapInArrow(added, "part bigint, entry bigint, place bigint, total bigint, n bigint")
    return tasks.groupBy("part", "entry", "place").agg(F.sum("total"), F.sum("n")).collect()


def fit(vectors: DataFrame, dims: int, column: str = "embedding", key: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES,
        rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks of vectors that :func:`kept` has let through; None without any."""
    first = vectors.orderBy(F.col(key).asc_nulls_last(), column).select(column).limit(entries).collect()
    if not first:
        return None
    width = dims // parts
    start = whole_numbers(pa.array([list(r[0]) for r in first], pa.list_(pa.float64())), dims, scale, _largest(width))
    books = Codebooks(start.reshape(len(first), parts, width))
    for _ in range(rounds):
        moved = books.entries.copy()
        for part, entry, place, total, n in _sums(vectors, column, dims, books, scale):
            moved[entry, part, place] = total // n
        books = Codebooks(moved)
    return books


def encode(vectors: DataFrame, dims: int, books: Codebooks, column: str = "embedding", keep=("vec_id",), scale: int = SCALE) -> DataFrame:
    """``row`` (a struct of the ``keep`` columns), ``code`` (two hex digits for each part) and ``error``."""
    parts, width = books.entries.shape[1:]
    source = vectors.select(F.struct(*keep).alias("row"), F.col(column).alias("vector"))

    def coded(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(stream, dims):
            entry, distance = books.nearest(whole_numbers(batch.column(1), dims, scale, _largest(width)))
            text = entry.astype(np.uint8).tobytes().hex()
            codes = [text[k:k + 2 * parts] for k in range(0, len(text), 2 * parts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.string()), pa.array(distance.sum(1))], ["row", "code", "error"])

    return source.mapInArrow(coded, f"row {source.schema['row'].dataType.simpleString()}, code string, error bigint")


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with the sum of ``error`` over the rows of an equal ``label``, nulls together.

    The sums are sent to every task where they are measured to be small. Otherwise each label's rows are spread over ``SALTS``
    keys, to which its sum is repeated.
    """
    sums = materialize(coded.groupBy(F.col("label").alias("own")).agg(F.sum("error").alias("label_error")), "label_errors")
    hinted = broadcast_if_small(sums)
    if hinted is not sums:
        return coded.join(hinted, F.col("label").eqNullSafe(F.col("own"))).drop("own")
    salted = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = coded.withColumn("own_salt", F.pmod(F.xxhash64("code", "vec_id"), F.lit(SALTS)).cast("int"))
    return spread.join(salted, F.col("label").eqNullSafe(F.col("own")) & (F.col("own_salt") == F.col("salt"))).drop("own", "salt", "own_salt")


def compressed(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector kept."""
    rows, dims = kept(embeddings.select("vec_id", "embedding", "label"), "embedding", parts)
    books = fit(rows, dims, parts=parts, entries=entries, rounds=rounds, scale=scale)
    if books is None:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"),
                           F.lit(0).cast("bigint").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = materialize(encode(rows, dims, books, keep=("vec_id", "label"), scale=scale).select("row.*", "code", "error"), "codes")
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same by comparing every part with every entry."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
near{r} as materialized (
  select vec_id, label, part, arg_min(entry, distance * {entries} + entry) as entry, min(distance) as distance
  from (select v.vec_id, v.label, v.part, b.entry,
          list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as distance
        from cut v join book{r} b on v.part = b.part)
  group by all)""".replace("group by all", "group by vec_id, label, part"))
        if r < rounds:
            steps.append(f"""
book{r + 1} as materialized (
  select b.part, b.entry, coalesce(m.x, b.x) as x
  from book{r} b left join (
    select part, entry, list((total - ((total % n) + n) % n) // n order by place) as x
    from (select part, entry, place, sum(c)::bigint as total, count(*) as n
          from (select n.part, n.entry, unnest(v.x) as c, unnest(range(1, len(v.x) + 1)) as place
                from near{r} n join cut v on n.vec_id = v.vec_id and n.part = v.part)
          group by part, entry, place)
    group by part, entry) m on m.part = b.part and m.entry = b.entry)""")
    return f"""
with usable as (
  select vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v
  from embeddings
  where embedding is not null and len(embedding) > 0 and len(embedding) % {parts} = 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
kept as materialized (
  select * from usable where len(v) = (
    select len(v) from usable group by len(v) order by count(*) desc, len(v) limit 1)),
cut as materialized (
  select vec_id, label, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] as x
  from kept, (select unnest(range(0, {parts})) as part)),
firsts as (select vec_id, row_number() over (order by vec_id) - 1 as entry from kept order by vec_id limit {entries}),
book0 as materialized (select part, entry, x from cut join firsts using (vec_id)),{",".join(steps)},
codes as materialized (
  select vec_id, label, string_agg(printf('%02x', entry::integer), '' order by part) as code, sum(distance)::bigint as error
  from near{rounds} group by vec_id, label),
digest as (
  select sha256(string_agg(c::varchar, ',' order by part, entry, place)) as codebooks_sha256
  from (select part, entry, unnest(x) as c, unnest(range(1, len(x) + 1)) as place from book{rounds}))
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
from codes, digest"""


ORACLE_SQL = _oracle()
