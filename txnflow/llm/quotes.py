"""Conversations by quotation linking, in built-in functions only.

1. Every line of a message has a quote level, the number of ``>`` before it. Lines of level 0, without attributions such as
   ``On Monday Ann wrote:``, are its body; consecutive lines of one level above 0 are a quoted passage.
2. Passages, and the lines of a body, are normalised (lower case, white space as one space) and hashed. For each conversation
   and hash the first turn whose body holds it is its original; an aggregate, so that a frequent line stays one row.
3. A passage is joined to its original by the hash of the whole, or else by those of its lines. A message answers the latest
   earlier turn that its level-1 passages come from, and without any the turn before it in its conversation.
4. Messages are given in reply order, ``reply_to`` then ``turn``: an answered message precedes its answers, and answers to one message
   stand together. ``rendered`` strung together in that order is the conversation.

Equal rows are one message (``n_copies``). Several messages of one turn are all kept. A missing text has an empty body. Rows
without a conversation or turn answer nothing and are answered by none. Other columns aren't read.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnflow.workspace import materialize

_QUOTED = r"^[ \t]*(?:>[ \t]?)+"
_ATTRIBUTION = r"^[ \t]*(On|Am|Le|El)[ \t].*(wrote|schrieb|a écrit|escribió)[ \t]*:[ \t]*$"
_WHITE = r"[ \t-\r]+"
_KEYS = ["conv_id", "turn", "role", "text"]


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_substr(line, F.lit(_QUOTED)), "[^>]", ""))


def normalised(text: Column) -> Column:
    """Lower case, each white space one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), _WHITE, " "))


def _messages(conversations: DataFrame) -> DataFrame:
    """One row per distinct message, with its number and its lines' levels."""
    found = (conversations.select(*_KEYS).groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n_copies"))
             .withColumn("lines", F.transform(F.split(F.coalesce("text", F.lit("")), "\r?\n"), lambda line: F.struct(
                 line.alias("line"), F.coalesce(_level(line), F.lit(0)).alias("level")))))
    body = F.filter("lines", lambda x: (x["level"] == 0) & ~x["line"].rlike(_ATTRIBUTION))
    return (found.withColumn("body", F.btrim(F.array_join(F.transform(body, lambda x: x["line"]), "\n"), F.lit(" \t\n\x0b\x0c\r")))
            .withColumn("message", F.md5(F.to_json(F.struct(*_KEYS)))))


def _passages(messages: DataFrame) -> DataFrame:
    """message, conv_id, turn, level, number, and the hashes of the whole and of each line, of each quoted passage."""
    lines = (messages.where(F.exists("lines", lambda x: x["level"] > 0))
             .select("message", "conv_id", "turn", F.posexplode("lines").alias("at", "x"))
             .select("message", "conv_id", "turn", "at", "x.level", F.regexp_replace("x.line", _QUOTED, "").alias("content")))
    down = Window.partitionBy("message").orderBy("at")
    change = (F.col("level") != F.lag("level", 1, -1).over(down)).cast("int")
    numbered = lines.withColumn("change", change).withColumn("number", F.sum("change").over(down))
    content = F.transform(F.array_sort(F.collect_list(F.struct("at", "content"))), lambda x: x["content"])
    kept = F.filter(F.transform("contents", normalised), lambda c: c != "")
    return (numbered.where("level > 0").groupBy("message", "conv_id", "turn", "level", "number").agg(content.alias("contents"))
            .select("message", "conv_id", "turn", "level", "number", kept.alias("kept")).where(F.size("kept") > 0)
            .select("message", "conv_id", "turn", "level", "number", F.md5(F.array_join("kept", " ")).alias("whole"),
                    F.transform("kept", lambda c: F.md5(c)).alias("hashes")))


def _originals(messages: DataFrame, quoting: DataFrame) -> DataFrame:
    """conv_id, hash, original: the first turn whose body is, or has a line, of that hash; of conversations with quotes."""
    lines = F.transform(F.split("body", "\r?\n"), normalised)
    units = F.array_distinct(F.array_append(lines, normalised(F.col("body"))))
    return (messages.join(quoting.select("conv_id").distinct(), "conv_id", "left_semi")
            .select("conv_id", "turn", F.explode(F.filter(units, lambda u: u != "")).alias("unit"))
            .groupBy("conv_id", F.md5("unit").alias("hash")).agg(F.min("turn").alias("original")))


def _turn_before(messages: DataFrame) -> DataFrame:
    """conv_id, turn, before: the turn before it in its conversation.

    Turns are sorted over all partitions, so a conversation of any length spreads over them; the last row of each partition is handed
    to the one after.
    """
    turns = messages.select("conv_id", "turn").distinct().repartitionByRange("conv_id", "turn")
    placed = materialize(turns.withColumn("part", F.spark_partition_id()), "turns")
    last = placed.groupBy("part").agg(F.max(F.struct("conv_id", "turn")).alias("own"))
    handed = last.select("part", F.lag("own").over(Window.orderBy("part")).alias("handed"))
    within = Window.partitionBy("part").orderBy("conv_id", "turn")
    own = F.lag(F.struct("conv_id", "turn")).over(within)
    found = placed.withColumn("own", own).join(handed, "part").withColumn("prior", F.coalesce("own", "handed"))
    return found.select("conv_id", "turn", F.when(F.col("prior.conv_id") == F.col("conv_id"), F.col("prior.turn")).alias("before"))


def linked(conversations: DataFrame) -> DataFrame:
    """Per message: conv_id, turn, role, body, n_copies, n_quotes, n_linked, reply_to, by_quote, rendered."""
    messages = materialize(_messages(conversations).drop("text"), "messages")
    whole = messages.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    passages = materialize(_passages(whole), "passages")
    originals = materialize(_originals(whole, passages), "originals")
    asked = (passages.select("message", "conv_id", "turn", "level", "number", F.col("whole").alias("hash"), F.lit(0).alias("part"))
             .union(passages.select("message", "conv_id", "turn", "level", "number", F.explode("hashes").alias("hash"), F.lit(1).alias("part"))))
    answers = (asked.join(originals, ["conv_id", "hash"]).where(F.col("original") < F.col("turn"))
               .groupBy("message", "level", "number")
               .agg(F.max(F.when(F.col("part") == 0, F.col("original"))).alias("by_whole"), F.max("original").alias("by_line"))
               .select("message", "level", "number", F.coalesce("by_whole", "by_line").alias("original")))
    quotes = (passages.join(answers, ["message", "level", "number"], "left").groupBy("message").agg(
        F.count(F.lit(1)).alias("n_quotes"), F.count("original").alias("n_linked"),
        F.max(F.when(F.col("level") == 1, F.col("original"))).alias("quoted")))
    before = _turn_before(whole)
    joined = messages.join(quotes, "message", "left").join(before, ["conv_id", "turn"], "left")
    role = F.coalesce("role", F.lit("user"))
    return joined.select(
        "conv_id", "turn", "role", "body", "n_copies", F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.coalesce("quoted", "before").alias("reply_to"),
        F.col("quoted").isNotNull().alias("by_quote"), F.concat(F.lit("<|"), role, F.lit("|>\n"), "body", F.lit("\n<|end|>\n")).alias("rendered"))


def in_reply_order(messages: DataFrame) -> DataFrame:
    """Sorted over all partitions by conversation, answered turn and turn."""
    return messages.repartitionByRange("conv_id", "reply_to", "turn", "role").sortWithinPartitions(
        "conv_id", F.col("reply_to").asc_nulls_first(), "turn", "role", "body")


_NORM = "trim(regexp_replace(lower({0}), '[ \\t-\\r]+', ' ', 'g'))"
ORACLE_SQL = f"""
with messages as (
  select conv_id, turn, role, text, count(*) as n_copies, row_number() over () as message from conversations group by all),
cut as (select *, unnest(regexp_split_to_array(coalesce(text, ''), '\\r?\\n')) as line,
    generate_subscripts(regexp_split_to_array(coalesce(text, ''), '\\r?\\n'), 1) as pos from messages),
lines as (
  select *, length(regexp_replace(regexp_extract(line, '^[ \\t]*(?:>[ \\t]?)+'), '[^>]', '', 'g')) as level,
    regexp_replace(line, '^[ \\t]*(?:>[ \\t]?)+', '') as content from cut),
bodies as (
  select message, trim(string_agg(line, chr(10) order by pos) filter (where level = 0 and not regexp_matches(line, '{_ATTRIBUTION}')),
    ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body from lines group by message),
changes as (select *, case when level is distinct from lag(level) over (partition by message order by pos) then 1 else 0 end as change from lines),
numbered as (select *, sum(change) over (partition by message order by pos) as number from changes),
contents as (select *, {_NORM.format("content")} as norm from numbered where level > 0 and conv_id is not null and turn is not null),
passages as (
  select message, conv_id, turn, level, number, string_agg(norm, ' ' order by pos) as whole, list(norm) as parts
  from contents where norm <> '' group by all),
units as (
  select distinct conv_id, turn, unnest(list_append(list_transform(regexp_split_to_array(coalesce(body, ''), '\\r?\\n'), lambda x: {_NORM.format("x")}),
    {_NORM.format("coalesce(body, '')")})) as unit
  from messages join bodies using (message) where turn is not null),
originals as (select conv_id, unit, min(turn) as original from units where unit <> '' group by all),
asked as (
  select message, conv_id, turn, level, number, whole as unit, 0 as part from passages
  union all select message, conv_id, turn, level, number, unnest(parts), 1 from passages),
answers as (
  select message, level, number, coalesce(max(original) filter (where part = 0), max(original)) as original
  from asked join originals using (conv_id, unit) where original < turn group by all),
quotes as (
  select message, count(*) as n_quotes, count(original) as n_linked, max(original) filter (where level = 1) as quoted
  from passages left join answers using (message, level, number) group by message),
turns as (select distinct conv_id, turn from messages where conv_id is not null and turn is not null),
befores as (select conv_id, turn, lag(turn) over (partition by conv_id order by turn) as before from turns)
select conv_id, turn, role, coalesce(body, '') as body, n_copies, coalesce(n_quotes, 0) as n_quotes, coalesce(n_linked, 0) as n_linked,
  coalesce(quoted, before) as reply_to, quoted is not null as by_quote,
  '<|' || coalesce(role, 'user') || '|>' || chr(10) || coalesce(body, '') || chr(10) || '<|end|>' || chr(10) as rendered
from messages join bodies using (message) left join quotes using (message) left join befores using (conv_id, turn)
"""
