"""Token ids of many texts, each distinct piece encoded once.

The public tokenizer cuts a normalised text into pieces (a run of letters, one number character, a run of other
characters, an English contraction) and encodes each piece by itself. Texts share most pieces, so a batch is cut by
array operations, and only pieces not seen before go to the tokenizer. Texts outside the plain case (rare
scripts, characters whose lower case isn't one character, special tokens spelt out) go to it whole. Ids are those of
``Tokenizer.encode(text, add_special_tokens=False)``; the tests hold both against each other.
"""

import os
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer

from txnflow.llm.text import code_points, span_hashes

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

#: Code points below this take the array path; beyond, class and case come from the tokenizer itself.
_PLAIN = 0x2000
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
#: Pieces kept between batches, and between the tasks of one Python worker.
CACHE_PIECES = 1 << 20
#: Characters cut into pieces at once, and new pieces encoded at once: what is made of either takes a worker some hundred times as many bytes.
BLOCK_CHARS, LEARN_PIECES = 500_000, 1 << 12
# A task has one core; threads beside it would each keep memory of their own in every worker.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of each plain code point; class -1 where the text must go to the tokenizer whole."""
    kinds, lower = np.full(_PLAIN, _OTHER, np.int8), np.arange(_PLAIN, dtype=np.uint32)
    for i in range(_PLAIN):
        c, small = chr(i), chr(i).lower()
        if len(small) != 1 or ord(small) >= _PLAIN or unicodedata.category(c) == "Cn" or c == "Σ":
            kinds[i] = -1
            continue
        lower[i] = ord(small)
        if regex.fullmatch(r"\p{L}", small):
            kinds[i] = _LETTER
        elif regex.fullmatch(r"\p{N}", small):
            kinds[i] = _NUMBER
    kinds[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680]] = _SPACE
    return kinds, lower


class PieceTokenizer:
    """Encodes texts with the tokenizer file ``path``, keeping a bounded table of pieces; ``shared`` gives a worker's own."""

    _kinds, _lower = _tables()

    def __init__(self, path: str = WORD_BPE):
        self._tokenizer = Tokenizer.from_file(path)
        self._specials = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self._hashes = np.zeros(0, np.uint64)
        self._starts, self._counts = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self._pool = np.zeros(0, np.uint32)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _cut(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Lower-cased code points, starts and ends of the pieces, or None for the slow path."""
        if any(s in text for s in self._specials):
            return None
        points = code_points(text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text))
        if len(points) and points.max() >= _PLAIN:
            return None
        kinds, points = self._kinds[points], self._lower[points]
        if len(kinds) and kinds.min() < 0:
            return None
        first = np.ones(len(kinds), bool)
        first[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == _NUMBER)
        for i in np.flatnonzero(first & (points == 39)):
            tail = "".join(map(chr, points[i + 1:i + 3]))
            size = 2 if tail[:1] in ("s", "t", "m", "d") else 3 if tail in ("re", "ve", "ll") else 0
            if size:
                first[i + 1:i + size] = False
                if i + size < len(first):
                    first[i + size] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(points))
        solid = kinds[starts] != _SPACE
        return points, starts[solid], ends[solid]

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        counts, flat = [], []
        for k in range(0, len(pieces), LEARN_PIECES):
            ids = [e.ids for e in self._tokenizer.encode_batch_fast(pieces[k:k + LEARN_PIECES], add_special_tokens=False)]
            counts.append(np.fromiter(map(len, ids), np.int32, len(ids)))
            flat.append(np.fromiter((x for one in ids for x in one), np.uint32, int(counts[-1].sum())))
        counts, flat = np.concatenate(counts), np.concatenate(flat)
        starts = (len(self._pool) + np.cumsum(counts) - counts).astype(np.int32)
        order = np.argsort(all_hashes := np.concatenate([self._hashes, hashes]), kind="stable")
        self._hashes = all_hashes[order]
        self._starts = np.concatenate([self._starts, starts])[order]
        self._counts = np.concatenate([self._counts, counts])[order]
        self._pool = np.concatenate([self._pool, flat])

    def _find(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray | None, np.ndarray | None]]:
        """For each text its ids if encoded whole, else the places of its pieces in the table."""
        cuts = [self._cut(t or "") for t in texts]
        hashes = [None if c is None else span_hashes(*c) for c in cuts]
        bounds = np.cumsum([0, *(0 if h is None else len(h) for h in hashes)])
        known = np.concatenate([np.zeros(0, np.uint64), *(h for h in hashes if h is not None)])
        needed, at, which = np.unique(known, return_index=True, return_inverse=True)
        if len(self._hashes) > CACHE_PIECES:
            self._forget()
        place = np.searchsorted(self._hashes, needed)
        new = np.flatnonzero(np.append(self._hashes, 0)[place] != needed) if len(self._hashes) else np.arange(len(needed))
        if len(new):
            owner = np.searchsorted(bounds, at[new], side="right") - 1
            pieces = []
            for k, i in zip(owner.tolist(), (at[new] - bounds[owner]).tolist(), strict=True):
                points, starts, ends = cuts[k]
                pieces.append(points[starts[i]:ends[i]].tobytes().decode("utf-32-le", "surrogatepass"))
            self._learn(needed[new], pieces)
            place = np.searchsorted(self._hashes, needed)
        places = place[which]
        for k, h in enumerate(hashes):
            yield k, self._whole(texts[k]) if h is None else None, None if h is None else places[bounds[k]:bounds[k + 1]]

    def _blocks(self, texts: list[str | None]) -> Iterator[list[str | None]]:
        """Runs of texts of about ``BLOCK_CHARS`` characters together, so that the arrays stay small."""
        block, size = [], 0
        for t in texts:
            block.append(t)
            size += len(t or "")
            if size > BLOCK_CHARS:
                yield block
                block, size = [], 0
        if block:
            yield block

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers; none for a missing or empty text."""
        for block in self._blocks(texts):
            for _, ids, places in self._find(block):
                if ids is None:
                    counts = self._counts[places]
                    before = np.cumsum(counts) - counts
                    ids = self._pool[np.repeat(self._starts[places] - before, counts) + np.arange(counts.sum())]
                yield ids

    def lengths(self, texts: Iterable[str | None]) -> list[int]:
        """The number of ids of each text."""
        return [int(len(ids) if ids is not None else self._counts[places].sum())
                for block in self._blocks(texts) for _, ids, places in self._find(block)]


@cache
def shared(path: str = WORD_BPE) -> PieceTokenizer:
    """One tokenizer for each file and Python worker, so that a later task finds the pieces of earlier ones."""
    return PieceTokenizer(path)
