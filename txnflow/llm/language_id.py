"""Language identification by rank-order profiles.

A profile lists the most frequent character n-grams of one to three characters, most frequent first, of the labelled
training texts of a language. A document's own list is compared with each profile by out-of-place distance: the sum, over the
document's n-grams, of how far each stands from its place in the profile, or of the profile's length if it
isn't there. The nearest language wins; ties go to the first name in order.

Words are runs of letters in lower case with a space before and after; everything else is ignored. A text without a letter,
an empty one or a missing one has the language ``und`` and score 0. The score is 1 - distance / greatest distance.
Only the text is looked at. Without any labelled text every language is ``und``.
"""

from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnflow.llm.rows import map_texts
from txnflow.llm.text import code_points

UNKNOWN = "und"
#: Places in a profile, and of a document's list.
PROFILE = 300
#: Training texts taken per language, about so many by the hash of the text; a bound on the fit alone.
TRAIN_TEXTS = 2000
_BITS = 21


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point whether it is a letter, and its lower case where that is one character."""
    # Character by character: a list of all of them would take each worker ten times what the two arrays do.
    every = range(0x110000)
    return (np.fromiter((chr(i).isalpha() for i in every), bool, len(every)),
            np.fromiter((ord(s) if len(s := chr(i).lower()) == 1 else i for i in every), np.uint32, len(every)))


def grams(text: str | None) -> np.ndarray:
    """The text's n-grams as numbers, in no order, repeats included; a space alone is none."""
    letter, lower = _letters()
    points = code_points(text)
    solid = letter[points]
    if not solid.any():
        return np.zeros(0, np.uint64)
    line = np.full(len(points) + 2, 32, np.uint64)
    line[1:-1] = np.where(solid, lower[points], np.uint32(32))
    keep = (line != 32) | np.append(True, line[:-1] != 32)
    line = line[keep]
    two = (line[:-1] << np.uint64(_BITS)) | line[1:]
    three = (two[:-1] << np.uint64(_BITS)) | line[2:]
    return np.concatenate([line[line != 32], two, three[line[1:-1] != 32]])


def ranked(text: str | None, places: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, by falling count, then by number."""
    found, counts = np.unique(grams(text), return_counts=True)
    return found[np.lexsort((found, -counts))][:places]


def fit(docs: DataFrame, label: str = "lang", text: str = "text", key: str = "doc_id",
        places: int = PROFILE, per_language: int = TRAIN_TEXTS) -> dict[str, list[int]]:
    """The profile of each label; what reaches the driver is ``places`` numbers for each."""
    labelled = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.col(label).alias("label"), F.col(text), (F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(1 << 30)) / (1 << 30)).alias("spread"))
    # Texts stay where they are: a label's share follows from its number of texts, a text's draw from its hash.
    share = {r["label"]: per_language / r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not share:
        return {}
    shares = F.create_map(*(F.lit(x) for pair in share.items() for x in pair))
    chosen = labelled.where(F.col("spread") < shares[F.col("label")])

    def counted(texts: list[str | None]) -> Iterator:
        for k, t in enumerate(texts):
            found, counts = np.unique(grams(t), return_counts=True)
            yield np.full(len(found), k), {"gram": found.astype(np.int64), "n": counts}

    counts = (map_texts(chosen, text, counted, {"gram": "bigint", "n": "bigint"}, ["label"])
              .groupBy("row.label", "gram").agg(F.sum("n").alias("n")))
    top = Window.partitionBy("label").orderBy(F.desc("n"), "gram")
    rows = counts.withColumn("place", F.row_number().over(top)).where(F.col("place") <= places).collect()
    profiles: dict[str, list[int]] = {}
    for row in sorted(rows, key=lambda r: (r["label"], r["place"])):
        profiles.setdefault(row["label"], []).append(row["gram"])
    return profiles


class Profiles:
    """The profiles as one table of n-grams and their place in each language."""

    def __init__(self, profiles: dict[str, list[int]], places: int = PROFILE):
        self.names = sorted(profiles)
        self.places = places
        self.known = np.unique(np.array([g for p in profiles.values() for g in p], np.uint64))
        self.place = np.full((len(self.known) + 1, len(self.names)), places, np.int64)
        self.absent = np.ones((len(self.known) + 1, len(self.names)), bool)
        for j, name in enumerate(self.names):
            at = np.searchsorted(self.known, np.array(profiles[name], np.uint64))
            self.place[at, j], self.absent[at, j] = np.arange(len(at)), False

    def predict(self, text: str | None) -> tuple[str, float]:
        own = ranked(text, self.places)
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.known, own)
        at[np.append(self.known, 0)[at] != own] = len(self.known)
        out_of_place = np.abs(self.place[at] - np.arange(len(own))[:, None])
        distance = np.where(self.absent[at], self.places, out_of_place).sum(0)
        best = int(distance.argmin())
        return self.names[best], 1.0 - float(distance[best]) / (len(own) * self.places)


def predict(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", keep=("doc_id",)) -> DataFrame:
    """``row`` (the ``keep`` columns), ``lang_pred`` and ``score``; one pass, no shuffle."""
    def made(texts: list[str | None]) -> Iterator:
        if "model" not in held:
            held["model"] = Profiles(profiles)
        found = [held["model"].predict(t) for t in texts]
        yield None, {"lang_pred": [x for x, _ in found], "score": [s for _, s in found]}

    held: dict[str, Profiles] = {}
    return map_texts(docs, text, made, {"lang_pred": "string", "score": "double"}, keep)


def held_out() -> F.Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 1 modulo 3; a missing id doesn't."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Per document: whether held out, the language and a score, learnt from those not held out."""
    columns = docs.select("doc_id", "text", "lang")
    profiles = fit(columns.where(~held_out()))
    return (predict(columns, profiles).select("row.*", "lang_pred", "score")
            .select("doc_id", held_out().alias("held_out"), "lang_pred", "score"))
