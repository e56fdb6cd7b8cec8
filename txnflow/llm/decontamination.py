"""Benchmark decontamination with a positional inverted index sharded by document.

Every task indexes its documents: for each benchmark term the positions at which its documents hold it. A window
(ten consecutive words of a test item) is looked up from the term with the shortest list in that shard; the positions,
moved back by the term's offset, are candidate starts, and the lists of the other terms, moved likewise, are
intersected with them from rare to frequent. What survives all of them is an exact match. With ``near`` below the
window's length, candidates at which so many terms hold their place are reported as proximity matches.

The test windows are sent out in blocks of bounded size, as many as there are; a document passes through all blocks in one
stage. Nothing is shuffled, and no list of the corpus leaves its task.

Words are runs of characters other than ASCII non-alphanumerics, A-Z in lower case. An item of fewer than ten words
is one window; an item or document that is missing or has no words matches nothing. Repeated items count each
by its id, equal ids once; a missing id is written ``null``. Repeated documents are reported each by itself.
"""

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnflow.llm.rows import map_texts
from txnflow.llm.text import is_ascii_break, words

WORDS = 10
#: Words of a window that stand in place in a proximity match of the report.
NEAR = 9
#: Windows sent to the tasks at once: at most 8 * WORDS bytes each, 80 MB.
BLOCK_WINDOWS = 1_000_000
#: Words of documents indexed at once by a task.
_SHARD_WORDS = 400_000


def item_windows(text: str | None, size: int = WORDS) -> np.ndarray:
    """The windows of one item, one row of word hashes each; the row's width is the window's length."""
    found, _, _ = words(text, breaks=is_ascii_break)
    n = min(size, len(found))
    return np.lib.stride_tricks.sliding_window_view(found, n) if n else np.zeros((0, 1), np.uint64)


def _blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[str, np.ndarray]]]:
    block, size = [], 0
    for item_id, text in items.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        found = item_windows(text)
        if block and size + len(found) > limit:
            yield block
            block, size = [], 0
        block.append(("null" if item_id is None else item_id, found))
        size += len(found)
    yield block


class TestWindows:
    """A block of items: for each window length the windows as term numbers, and the item of each."""

    __test__ = False

    def __init__(self, items: list[tuple[str, np.ndarray]]):
        self.terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *(w.ravel() for _, w in items)]))
        self.groups = []
        for width in sorted({w.shape[1] for _, w in items if len(w)}):
            own = [(i, w) for i, w in items if len(w) and w.shape[1] == width]
            ids = np.repeat(np.array([i for i, _ in own], object), [len(w) for _, w in own])
            self.groups.append((np.searchsorted(self.terms, np.concatenate([w for _, w in own])), ids))

    def search(self, shard: np.ndarray, owner: np.ndarray, near: int = WORDS) -> Iterator[tuple[np.ndarray, np.ndarray, int, bool]]:
        """Starts in the shard, item of each, window length, and whether the matches are exact.

        ``shard`` holds the word hashes of several documents one after another, ``owner`` the document of each.
        """
        if not len(self.terms) or not len(shard):
            return
        term = np.searchsorted(self.terms, shard)
        term[np.append(self.terms, 0)[term] != shard] = len(self.terms)
        held = np.flatnonzero(term < len(self.terms))
        postings = held[np.argsort(term[held], kind="stable")]
        first = np.searchsorted(term[postings], np.arange(len(self.terms) + 1))
        length = np.diff(first)
        for windows, ids in self.groups:
            width = windows.shape[1]
            order = np.argsort(length[windows], axis=1, kind="stable")
            # An exact match holds its rarest term; a proximity match may lack it, then the next rarest leads.
            for rank in range(width - min(near, width) + 1):
                lead = order[:, rank]
                terms = windows[np.arange(len(windows)), lead]
                counts = length[terms]
                if not counts.any():
                    continue
                for part in _pieces(counts):
                    w = np.repeat(np.arange(len(windows))[part], counts[part])
                    step = np.arange(len(w)) - np.repeat(np.cumsum(counts[part]) - counts[part], counts[part])
                    start = postings[first[terms[w]] + step] - lead[w]
                    fits = (start >= 0) & (start + width <= len(shard))
                    w, start = w[fits], start[fits]
                    fits = owner[start] == owner[start + width - 1]
                    w, start = w[fits], start[fits]
                    missing = np.zeros(len(w), np.int64)
                    for k in range(width):
                        offset = order[w, k]
                        missing += term[start + offset] != windows[w, offset]
                        alive = missing <= width - min(near, width)
                        w, start, missing = w[alive], start[alive], missing[alive]
                    exact = missing == 0
                    if rank == 0 and exact.any():
                        yield start[exact], ids[w[exact]], width, True
                    if len(w):
                        yield start, ids[w], width, False


def _pieces(counts: np.ndarray, most: int = 1 << 20) -> Iterator[slice]:
    """Slices of windows with about ``most`` candidates each; a window with more makes a slice of its own."""
    at = 0
    total = np.cumsum(counts)
    while at < len(counts):
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + most, side="right")))
        yield slice(at, end)
        at = end


def _shards(texts: Iterable[str | None]) -> Iterator[list[np.ndarray]]:
    shard, size = [], 0
    for t in texts:
        shard.append(words(t, breaks=is_ascii_break)[0])
        size += len(shard[-1])
        if size > _SHARD_WORDS:
            yield shard
            shard, size = [], 0
    if shard:
        yield shard


def matches(docs: DataFrame, items: DataFrame, keep=("doc_id",), text: str = "text",
            block_windows: int = BLOCK_WINDOWS, near: int = WORDS) -> DataFrame:
    """``row`` and, for each document, n_words, n_hit, n_near (words in exact and in proximity matches) and the
    matched item ids, sorted as strings.

    ``near`` is the number of a window's words that must stand in place; with all of them, n_near equals n_hit.
    """
    context = docs.sparkSession.sparkContext
    sent: list[Broadcast] = [context.broadcast(TestWindows(b)) for b in _blocks(items, block_windows)]

    def made(texts: list[str | None]) -> Iterator:
        out = {"n_words": [], "n_hit": [], "n_near": [], "items": []}
        for shard in _shards(texts):
            sizes = np.array([len(x) for x in shard])
            ends = np.cumsum(sizes)
            flat, owner = np.concatenate(shard), np.repeat(np.arange(len(shard)), sizes)
            marks = {True: np.zeros(len(flat) + 1, np.int64), False: np.zeros(len(flat) + 1, np.int64)}
            found: list[set[str]] = [set() for _ in shard]
            for block in sent:
                for starts, ids, width, exact in block.value.search(flat, owner, near):
                    np.add.at(marks[exact], starts, 1)
                    np.add.at(marks[exact], starts + width, -1)
                    if exact:
                        for d, i in set(zip(owner[starts].tolist(), ids, strict=True)):
                            found[d].add(i)
            covered = {k: np.append(0, np.cumsum(np.cumsum(m[:-1]) > 0)) for k, m in marks.items()}
            out["n_words"] += sizes.tolist()
            out["n_hit"] += (covered[True][ends] - covered[True][ends - sizes]).tolist()
            out["n_near"] += (covered[False][ends] - covered[False][ends - sizes]).tolist()
            out["items"] += [sorted(s) for s in found]
        yield None, out

    return map_texts(docs, text, made, {"n_words": "bigint", "n_hit": "bigint", "n_near": "bigint", "items": "array<string>"}, keep)


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document: its words, those hit, the items hit and a digest of their ids, and the words in proximity matches.

    Proximity matches don't make a document contaminated.
    """
    found = matches(docs, items, near=NEAR)
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"), "n_near")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without an exact match, all columns as they were."""
    return matches(docs, items, keep=docs.columns).where("n_hit = 0").select("row.*")
