"""Operator 8: chat formatting by quotation linking, in DataFrame functions only.

Each line's quote level is its number of leading ``>`` marks. Adjoining lines of one level are a passage; passages and
their single lines are normalised and hashed. Unquoted messages give the same hashes of their whole, their paragraphs and
their lines, each with the first message that has it. Joining the two on (conversation, hash) tells which
earlier message a message quotes: the one of its shallowest and then longest match is the message it replies to. Pointer
doubling over these links finds each message's thread, the first message it leads to, and depth. A conversation is its
threads, one after the other, each with its messages in reply order (a message comes after the one it answers, as it has a later turn), without
quotes, in chat format. So that no task holds an unbounded conversation, a row has ``PART`` messages at most: messages are
numbered in that order by ranges, and a longer conversation is its parts, in their order, put together.

Hashes are grouped before they are joined, so that a passage that everyone quotes is one row for
each conversation, and a conversation with a third of all rows is many keys.

Defined cases: a null text is an empty message; a null role is "unknown"; messages with a null conversation or turn
quote nothing and are quoted by nothing, and each is a row of its own; equal rows are one message that counts as often as
it occurs, other rows that share conversation and turn are messages of one turn; a quote without an original is removed all the
same; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.rows import number_rows
from .common import join_groups, materialize

#: Messages in one row, at most.
PART = 256
_MARKS = r"^\s*>[\s>]*"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), r"[^>]", ""))


def _normal(text: Column) -> Column:
    """Lower case, single spaces, no punctuation at either end."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"\s+", " "), r"^[\s\p{Punct}]+|[\s\p{Punct}]+$", "")


def _hash(normal: Column) -> Column:
    return F.when(normal != "", F.struct(F.xxhash64(normal).alias("h"), F.hash(normal).alias("g")))


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda s: F.struct(_level(s).alias("level"), F.regexp_replace(s, _MARKS, "").alias("s"), s.rlike(r":\s*$").alias("introduces")))


def unquoted(lines: Column) -> Column:
    """The lines of level 0, without a line that ends in a colon right before a quote, joined again."""
    last = F.size(lines)
    kept = F.filter(lines, lambda x, i: (x["level"] == 0) & ~(x["introduces"] & (i + 1 < last) & (F.coalesce(F.try_element_at(lines, i + 2)["level"], F.lit(0)) > 0)))
    return F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["s"]), "\n"), r"^\s+|\s+$", "")


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, lines (level, s), body: the message without quotes."""
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    quotes = F.col("text").rlike(r"(?m)^\s*>")
    # Most messages quote nothing: their lines are not looked at one by one.
    with_lines = rows.withColumn("lines", F.when(quotes, _lines(F.col("text"))))
    plain = F.regexp_replace("text", r"^\s+|\s+$", "")
    return with_lines.withColumn("body", F.when(F.col("lines").isNull(), plain).otherwise(unquoted(F.col("lines"))))


def passages(messages: DataFrame) -> DataFrame:
    """Quoted passages and their lines: conv_id, turn, level, chars, key (hash)."""
    quoting = messages.where("lines IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "role", "text").distinct()
    lines = quoting.select("conv_id", "turn", F.xxhash64("text", "role").alias("m"), F.posexplode(_lines(F.col("text"))).alias("n", "line"))
    lines = lines.select("conv_id", "turn", "m", "n", "line.level", "line.s")
    w = Window.partitionBy("conv_id", "turn", "m").orderBy("n")  # one message
    lines = lines.withColumn("passage", F.sum((F.col("level") != F.lag("level", 1, -1).over(w)).cast("int")).over(w)).where("level > 0")
    whole = lines.groupBy("conv_id", "turn", "m", "passage", "level").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "s"))), lambda x: x["s"]), " ").alias("s"))
    units = whole.select("conv_id", "turn", "level", "s").unionByName(lines.select("conv_id", "turn", "level", "s"))
    normal = units.withColumn("s", _normal(F.col("s")))
    return normal.select("conv_id", "turn", "level", F.length("s").alias("chars"), _hash(F.col("s")).alias("key")).where("key IS NOT NULL")


def originals(messages: DataFrame) -> DataFrame:
    """Hashes of unquoted text with the first turn that has it: conv_id, key, original, size."""
    body = F.col("body")
    units = F.concat(F.array(body), F.split(body, r"\n\s*\n"), F.split(body, "\n"))
    rows = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.explode(F.array_distinct(F.transform(units, _normal))).alias("s"))
    keyed = rows.select("conv_id", "turn", _hash(F.col("s")).alias("key")).where("key IS NOT NULL")
    return keyed.groupBy("conv_id", "key").agg(F.min("turn").alias("original"), F.count(F.lit(1)).alias("size"))


def replies(messages: DataFrame) -> DataFrame:
    """For each turn that quotes an earlier one: conv_id, turn, reply_to, thread, depth."""
    quoted = materialize(passages(messages).select("conv_id", "turn", "level", "chars", "key"), "passages")
    # Only what somebody quotes is worth keeping of the originals.
    asked = quoted.df.groupBy("conv_id", "key").agg(F.count(F.lit(1)).alias("size"))
    found = materialize(originals(messages).drop("size").join(asked, ["conv_id", "key"]), "originals")
    links = join_groups(quoted.df, found.df, ["conv_id", "key"], "size", quoted.df.count()).where("original < turn")
    best = links.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("level"), "chars", "original")).alias("best"))
    now = materialize(best.select("conv_id", "turn", F.col("best.original").alias("reply_to"), F.col("best.original").alias("thread"), F.lit(1).cast("long").alias("depth")), "links")
    quoted.drop()
    found.drop()
    while True:  # each round doubles how far a pointer reaches; a link leads to a smaller turn, so there is an end
        up = now.df.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("up"), F.col("depth").alias("more"), F.lit(1).alias("hit"))
        sizes = now.df.groupBy("conv_id", "thread").agg(F.count(F.lit(1)).alias("size"))
        joined = materialize(sizes.join(up, ["conv_id", "thread"]), "pointers")
        moves = joined.df.count()
        if not moves:
            joined.drop()
            return now.df
        moved = join_groups(now.df, joined.df, ["conv_id", "thread"], "size", now.df.count())
        moved = moved.select("conv_id", "turn", "reply_to", F.col("up").alias("thread"), (F.col("depth") + F.col("more")).alias("depth"))
        still = now.df.join(joined.df.select("conv_id", "thread"), ["conv_id", "thread"], "left_anti").select("conv_id", "turn", "reply_to", "thread", "depth")
        after = materialize(moved.unionByName(still), "links")
        now.drop()
        joined.drop()
        now = after


def linked_messages(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` to distinct messages: conv_id, thread, turn, reply_to, depth, role, body, copies.

    ``thread`` is the turn of the message that a chain of replies leads to, or the own turn.
    """
    messages = parsed(conversations)
    links = replies(messages)
    distinct = messages.groupBy("conv_id", "turn", "role", "text").agg(F.first("body").alias("body"), F.count(F.lit(1)).alias("copies"))
    joined = distinct.join(links, ["conv_id", "turn"], "left")
    return joined.select("conv_id", F.coalesce("thread", "turn").alias("thread"), "turn", "reply_to", F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), "role", "body", "copies")


def chat_conversations(conversations: DataFrame) -> DataFrame:
    """Conversations in reply order, without quotes, in chat format.

    One row for each conversation, or for each ``PART`` messages of a longer one: conv_id, part, n_messages
    (copies included), n_replies, max_depth, text. In ``text`` a message follows its thread's first one, by turn.
    """
    linked = materialize(linked_messages(conversations), "linked").df
    loose = F.col("conv_id").isNull() | F.col("turn").isNull()
    numbered = number_rows(linked.where(~loose), ["conv_id", "thread", "turn", "role", "body", "copies"])
    first = materialize(numbered.groupBy("conv_id").agg(F.min("_n").alias("first"), F.count(F.lit(1)).alias("size")), "first").df
    parted = join_groups(numbered, first, ["conv_id"], "size", linked.count()).withColumn("part", F.floor((F.col("_n") - F.col("first")) / PART))
    parted = parted.drop("size", "first", "_n").withColumn("own", F.lit(0).cast("long"))
    alone = linked.where(loose).withColumn("part", F.lit(0).cast("long")).withColumn("own", F.monotonically_increasing_id())
    grouped = parted.unionByName(alone).groupBy("conv_id", "part", "own").agg(
        F.sum("copies").alias("n_messages"), F.sum(F.col("reply_to").isNotNull().cast("long")).alias("n_replies"), F.max("depth").alias("max_depth"), F.array_sort(F.collect_list(F.struct("thread", "turn", "role", "body"))).alias("m")
    )
    text = F.array_join(F.transform("m", lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), x["body"], F.lit("\n<|end|>\n"))), "")
    return grouped.select("conv_id", "part", "n_messages", "n_replies", "max_depth", text.alias("text"))


#: The same rows in SQL for DuckDB, over a table ``conversations``.
ORACLE_SQL = r"""
WITH RECURSIVE m AS (
  SELECT row_number() OVER () AS id, conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), l AS (
  SELECT id, conv_id, turn, i AS n, regexp_extract(s, '^\s*>[\s>]*', 0) AS mark, s,
         length(regexp_replace(regexp_extract(s, '^\s*>[\s>]*', 0), '[^>]', '', 'g')) AS level
  FROM (SELECT id, conv_id, turn, string_split(text, chr(10)) AS a, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, string_split(text, chr(10))[i] AS s FROM m)
), b AS (
  SELECT *, coalesce(lead(level) OVER w, 0) AS following, sum(CASE WHEN level IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER w AS passage
  FROM (SELECT *, lag(level) OVER (PARTITION BY id ORDER BY n) AS before FROM l) WINDOW w AS (PARTITION BY id ORDER BY n)
), body AS (
  SELECT id, regexp_replace(string_agg(s, chr(10) ORDER BY n), '^\s+|\s+$', '', 'g') AS body FROM b
  WHERE level = 0 AND NOT (regexp_matches(s, ':\s*$') AND following > 0) GROUP BY id
), mb AS (SELECT m.*, coalesce(body.body, '') AS body FROM m LEFT JOIN body USING (id)
), q AS (
  SELECT conv_id, turn, level, string_agg(substr(s, length(mark) + 1), ' ' ORDER BY n) AS s FROM b WHERE level > 0 GROUP BY id, conv_id, turn, passage, level
  UNION ALL SELECT conv_id, turn, level, substr(s, length(mark) + 1) FROM b WHERE level > 0
), qn AS (
  SELECT conv_id, turn, level, regexp_replace(regexp_replace(lower(s), '\s+', ' ', 'g'), '^[\s[:punct:]]+|[\s[:punct:]]+$', '', 'g') AS s FROM q WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), o AS (
  SELECT conv_id, min(turn) AS original, s FROM (
    SELECT conv_id, turn, regexp_replace(regexp_replace(lower(u), '\s+', ' ', 'g'), '^[\s[:punct:]]+|[\s[:punct:]]+$', '', 'g') AS s
    FROM (SELECT conv_id, turn, unnest([body] || regexp_split_to_array(body, '\n\s*\n') || string_split(body, chr(10))) AS u FROM mb WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
  ) WHERE s <> '' GROUP BY conv_id, s
), best AS (
  SELECT qn.conv_id, qn.turn, o.original AS reply_to FROM qn JOIN o ON qn.conv_id = o.conv_id AND qn.s = o.s AND o.original < qn.turn WHERE qn.s <> ''
  QUALIFY row_number() OVER (PARTITION BY qn.conv_id, qn.turn ORDER BY level, length(qn.s) DESC, original DESC) = 1
), chain AS (
  SELECT conv_id, turn, reply_to, reply_to AS thread, 1 AS depth FROM best
  UNION ALL SELECT c.conv_id, c.turn, c.reply_to, best.reply_to, c.depth + 1 FROM chain c JOIN best ON best.conv_id = c.conv_id AND best.turn = c.thread
), links AS (
  SELECT * FROM chain QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY depth DESC) = 1
), done AS (
  SELECT d.*, coalesce(thread, turn) AS root, reply_to, coalesce(depth, 0) AS depth
  FROM (SELECT conv_id, turn, role, body, text, count(*) AS copies FROM mb GROUP BY ALL) d LEFT JOIN links USING (conv_id, turn)
)
SELECT conv_id, part, sum(copies)::BIGINT AS n_messages, count(reply_to) AS n_replies, max(depth)::BIGINT AS max_depth,
       string_agg('<|' || role || '|>' || chr(10) || body || chr(10) || '<|end|>' || chr(10), '' ORDER BY root, turn, role, body) AS text
FROM (
  SELECT *, ((row_number() OVER (PARTITION BY conv_id ORDER BY root, turn, role, body, copies) - 1) // 256)::BIGINT AS part, 0 AS own FROM done WHERE conv_id IS NOT NULL AND turn IS NOT NULL
  UNION ALL SELECT *, 0, row_number() OVER () FROM done WHERE conv_id IS NULL OR turn IS NULL
) GROUP BY conv_id, part, own
"""
