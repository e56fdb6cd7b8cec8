"""Quality rules from a threshold table, compiled into projections of built-in functions.

Words are runs without white space; lines are cut at newlines. Each rule bounds a ratio of counts from below and above; a document is
kept if no base rule fails and every ratio lies within its bounds. Nothing is shuffled, and no user function runs.

Base rules: fewer than 20 words, or more than 30 of 100 words in 8-word windows that the text holds twice or more. A missing
or empty text has no words and fails. Repeated rows are judged each by itself; other columns aren't read.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
WINDOW = 8

_WHITE = r"[ \t-\r]+"
_SYMBOLS = "[#*$%&|<>]"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = tuple(
    "a an and are as at be by for from in is it of on or that the this to was with "
    "als auch auf das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "au dans de du en est et il la le les ne par pas plus pour que qui sur un une "
    "al con del el es las lo los no para por se su y".split())


@dataclass(frozen=True)
class Rule:
    """``least <= 1.0 * part / whole <= most``; a whole of 0 counts as 1."""

    name: str
    part: str
    whole: str
    least: float
    most: float


RULES = (
    Rule("word_length", "word_chars", "n_words", 2.5, 12.0),
    Rule("symbols", "n_symbols", "n_words", 0.0, 0.1),
    Rule("stop_words", "n_stop_words", "n_words", 0.06, 1.0),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", 0.0, 0.5),
)


def _paired(hashes: str, apart: int) -> Column:
    """A hash of each two entries of the array column that stand ``apart``; none if the array is shorter."""
    left = F.greatest(F.size(hashes) - apart, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), left), F.slice(hashes, F.lit(apart + 1), left), lambda x, y: F.xxhash64(x, y))


def _sorted_if_repeated(windows: str) -> Column:
    """The windows with their places (from 1), sorted, where at least two are equal; most texts have none and aren't sorted."""
    placed = F.transform(windows, lambda h, i: F.struct(h.alias("hash"), (i + 1).alias("place")))
    none = F.array().cast("array<struct<hash:bigint,place:int>>")
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.sort_array(placed)).otherwise(none)


def _equal_neighbour(windows: str) -> Column:
    """Places of entries whose hash equals that of an entry beside them in the sorted array column ``windows``."""
    def twice(x: Column, i: Column) -> Column:
        before, after = F.get(windows, i - 1)["hash"], F.get(windows, i + 1)["hash"]
        return F.coalesce(x["hash"] == before, F.lit(False)) | F.coalesce(x["hash"] == after, F.lit(False))

    return F.sort_array(F.transform(F.filter(windows, twice), lambda x: x["place"]))


def _covered(places: str) -> Column:
    """Words in windows that start at the rising places."""
    steps = F.zip_with(F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(0))), F.slice(places, 1, F.greatest(F.size(places) - 1, F.lit(0))),
                       lambda b, a: F.least(b - a, F.lit(WINDOW)))
    return F.when(F.size(places) > 0, F.aggregate(steps, F.lit(WINDOW), lambda total, x: total + x)).otherwise(0)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the counts that rules speak of; one projection on another, so that each array is made once."""
    body = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("body"))
    trimmed = F.btrim("body", F.lit(" \t\n\x0b\x0c\r"))
    split = body.select(
        "doc_id", "body", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _WHITE)).alias("words"),
        F.filter(F.split("body", "\n"), lambda line: line.rlike(r"[^ \t-\r]")).alias("lines"))
    sized = split.withColumn("n_words", F.size("words")).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    # Hashes of two, four and eight consecutive words, each made of the ones before.
    hashed = sized
    for apart in (1, 2, 4):
        hashed = hashed.withColumn("hashes", _paired("hashes", apart))
    sorted_windows = hashed.withColumn("windows", _sorted_if_repeated("hashes"))
    places = sorted_windows.withColumn("places", _equal_neighbour("windows"))
    long = lambda c: c.cast("bigint")
    return places.select(
        "doc_id", long(F.col("n_words")).alias("n_words"),
        long(F.length(F.array_join("words", ""))).alias("word_chars"),
        long(F.regexp_count("body", F.lit(_SYMBOLS))).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        long(F.coalesce(_covered("places"), F.lit(0))).alias("n_repeat_words"),
        long(F.size("lines")).alias("n_lines"),
        long(F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS)))).alias("n_stop_words"))


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one condition."""
    verdict = F.lit(True)
    for rule in rules:
        ratio = F.col(rule.part).cast("double") / F.greatest(F.col(rule.whole), F.lit(1)).cast("double")
        verdict = verdict & ratio.between(rule.least, rule.most)
    return verdict


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document the counts, whether a base rule fails, and whether it is kept."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return measured(docs).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compiled(rules))


ORACLE_SQL = f"""
with texts as (select doc_id, coalesce(text, '') as body from documents),
split as (
  select doc_id, body, regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+') as words,
    list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
  from texts),
windows as (
  select doc_id, unnest(range(1, len(words) - {WINDOW - 2})) as place, words from split where len(words) >= {WINDOW}),
grams as (select doc_id, place, array_to_string(words[place:place + {WINDOW - 1}], ' ') as gram from windows),
twice as (select doc_id, place from grams qualify count(*) over (partition by doc_id, gram) > 1),
covered as (
  select doc_id, count(distinct place + step) as n from twice, (select unnest(range({WINDOW})) as step) group by doc_id),
counts as (
  select doc_id, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
    length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n, 0) as n_repeat_words, len(lines) as n_lines,
    len(list_filter(words, lambda x: lower(x) in ({", ".join(f"'{w}'" for w in STOP_WORDS)}))) as n_stop_words
  from split left join covered using (doc_id)),
failed as (
  select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words as base_failed from counts)
select *, not base_failed {"".join(f"and cast({r.part} as double) / greatest({r.whole}, 1) between {r.least} and {r.most} " for r in RULES)} as kept
from failed
"""
