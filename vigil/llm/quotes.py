"""Quotation linking of conversations (operator 10), in DataFrame functions.

A message's lines begin with any number of ``>`` marks: its quote level.
Consecutive lines of one level are a passage (blank lines and attribution lines
``On ... wrote:`` do not count). A passage, its lines trimmed, in lower case
and with single spaces, is hashed; so is each of its lines. Unquoted passages
and lines are originals: the earliest message of the conversation that has one
owns it. Quoted passages meet the originals by conversation and hash, those
that match nothing as a whole line by line. A message replies to the owner of
its outermost linked quote (the latest such owner). Following these replies,
by pointer doubling, gives each message its thread (the first message), depth
and place; the text returned has no quotes.

Originals are reduced to one row per (conversation, hash) before any join, so
common first turns or lines never multiply; places within a thread are running
counts over buckets of turns, so a conversation that holds a third of all rows
is not gathered anywhere.

Null text is empty; messages without quotes start a thread. A null conv_id is
one conversation of its own, a null turn comes before all others. Rows equal in
conv_id, turn, role and text count once; of different messages with one turn,
each comes back, and they share the turn's thread. An empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bucketing import bucketed_cumsum
from .common import write_table

MARK = r"^((?:[ \t]{0,3}>)+)[ \t]?"
BUCKET = 4096
_NO_TURN = -(2 ** 62)


def parsed_lines(text: Column) -> Column:
    """Array of (level, line) of the lines that are not blank."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r?\n")
    rows = F.transform(lines, lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, MARK, 1), "[^>]", "")).alias("level"),
        F.regexp_replace(x, MARK, "").alias("line")))
    return F.filter(rows, lambda x: ~x["line"].rlike(r"^\s*$") & ~x["line"].rlike(r"^\s*On .+ wrote:\s*$"))


def passages(lines: Column) -> Column:
    """Array of (level, lines) for the runs of equal level."""
    first = F.filter(F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1))),
                     lambda i: (F.size(lines) >= i) & ((i == 1) | (F.get(lines, i - 1)["level"] != F.get(lines, i - 2)["level"])))
    return F.transform(first, lambda i, n: F.struct(
        F.get(lines, i - 1)["level"].alias("level"),
        F.transform(F.slice(lines, i, F.coalesce(F.get(first, n + 1), F.size(lines) + 1) - i), lambda x: x["line"]).alias("lines")))


def normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"\s+", " ")))


def link_quotes(messages: DataFrame) -> DataFrame:
    """Per message: conv_id, turn, role, text without quotes, n_quotes,
    n_linked, reply_to, thread, depth, position (in the thread, from 1)."""
    conv = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("null"))
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("raw")).distinct()
    rows = rows.select(conv.alias("k"), F.coalesce("turn", F.lit(_NO_TURN)).alias("at"), "conv_id", "turn", "role", parsed_lines(F.col("raw")).alias("lines"))
    rows = rows.select("k", "at", "conv_id", "turn", "role", passages(F.col("lines")).alias("passages"),
                       F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["line"]), "\n").alias("text"))
    rows = write_table(rows, "messages")

    units = rows.select("k", "at", F.posexplode("passages").alias("n", "p")).select(
        "k", "at", "n", "p.level", F.transform("p.lines", normal).alias("lines"))
    whole = F.sha2(F.array_join("lines", " "), 256)
    unquoted = units.where("level = 0")
    owners = (unquoted.select("k", "at", whole.alias("hash"))
              .unionByName(unquoted.select("k", "at", F.explode("lines").alias("line")).select("k", "at", F.sha2("line", 256).alias("hash")))
              .groupBy("k", "hash").agg(F.min("at").alias("owner")))
    owners = write_table(owners, "quote-owners")
    quoted = units.where("level > 0").withColumn("hash", whole)
    met = write_table(quoted.join(owners, ["k", "hash"], "left").select(
        "k", "at", "n", "level", "lines", F.when(F.col("owner") < F.col("at"), F.col("owner")).alias("owner")), "quotes")
    by_line = (met.where("owner IS NULL").select("k", "at", "n", "level", F.explode("lines").alias("line"))
               .withColumn("hash", F.sha2("line", 256)).join(owners, ["k", "hash"]).where("owner < at")
               .groupBy("k", "at", "n", "level").agg(F.max("owner").alias("owner")))
    linked = met.where("owner IS NOT NULL").select("k", "at", "n", "level", "owner").unionByName(by_line)
    quotes = met.groupBy("k", "at").agg(F.count(F.lit(1)).alias("n_quotes"))
    replies = linked.groupBy("k", "at").agg(F.count(F.lit(1)).alias("n_linked"),
                                            F.max_by("owner", F.struct(-F.col("level"), F.col("owner"))).alias("reply"))
    turns = rows.select("k", "at").distinct().join(quotes, ["k", "at"], "left").join(replies, ["k", "at"], "left")
    turns = write_table(turns.select("k", "at", F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "reply"), "turns")
    threads = follow(turns.select("k", "at", F.coalesce("reply", "at").alias("top"), F.col("reply").isNotNull().cast("long").alias("depth")))
    found = rows.select("k", "at", "conv_id", "turn", "role", "text").join(turns, ["k", "at"]).join(threads, ["k", "at"])
    found = found.withColumn("_one", F.lit(1).cast("long")).withColumn("_bucket", F.floor(F.col("at") / BUCKET))
    # equal turns are told apart by role and text
    found = bucketed_cumsum(found.withColumn("_order", F.struct("at", "role", "text")), ["k", "top"], "_order", "_one", "position", "_bucket")
    shown = lambda c: F.when(F.col(c) != _NO_TURN, F.col(c))
    return found.select("conv_id", "turn", "role", "text", "n_quotes", "n_linked", shown("reply").alias("reply_to"),
                        shown("top").alias("thread"), "depth", "position")


def follow(links: DataFrame) -> DataFrame:
    """(k, at, top, depth) with ``top`` the end of each chain of replies. Each
    round doubles the distance of the messages that have not reached theirs;
    replies point backwards, so chains end."""
    now = write_table(links.withColumn("open", F.col("depth") > 0), "threads")
    while not (ahead := now.where("open")).isEmpty():
        up = now.select("k", F.col("at").alias("top"), F.col("top").alias("next"), F.col("depth").alias("more"))
        moved = ahead.join(up, ["k", "top"]).select("k", "at", F.col("next").alias("top"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("open"))
        now = write_table(now.where("NOT open").unionByName(moved), "threads")
    return now.drop("open")


def mailbox(conversations: DataFrame) -> DataFrame:
    """The conversations as mail: each message quotes the one before it, and,
    one level deeper, the one before that."""
    said = conversations.groupBy("conv_id", "turn").agg(F.min("text").alias("said"))
    before = lambda n: said.select("conv_id", (F.col("turn") + n).alias("turn"), F.col("said").alias(f"said{n}"))
    quote = lambda c, mark: F.when(F.trim(F.col(c)) != "", F.concat(F.regexp_replace(F.col(c), "(?m)^", mark), F.lit("\n"))).otherwise("")
    rows = conversations.select("conv_id", "turn", "role", "text").join(before(1), ["conv_id", "turn"], "left").join(before(2), ["conv_id", "turn"], "left")
    return rows.select("conv_id", "turn", "role", F.concat(quote("said2", ">> "), quote("said1", "> "), F.coalesce("text", F.lit(""))).alias("text"))


def op10_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of the conversations as mail, linked and without quotes."""
    return link_quotes(mailbox(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OP10_SQL = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, text,
   array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), chr(10)) AS body,
   lower(array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), ' ')) AS norm
   FROM conversations),
o AS (SELECT conv_id, norm, min(turn) AS owner FROM m GROUP BY 1, 2),
l AS (SELECT m.conv_id, m.turn, m.role, m.body, p1.norm AS n1, p2.norm AS n2, o1.owner AS reply, o2.owner AS deeper FROM m
   LEFT JOIN m p1 ON p1.conv_id = m.conv_id AND p1.turn = m.turn - 1 LEFT JOIN o o1 ON o1.conv_id = m.conv_id AND o1.norm = p1.norm
   LEFT JOIN m p2 ON p2.conv_id = m.conv_id AND p2.turn = m.turn - 2 LEFT JOIN o o2 ON o2.conv_id = m.conv_id AND o2.norm = p2.norm),
t AS (SELECT conv_id, turn, turn AS thread, 0 AS depth FROM l WHERE reply IS NULL
   UNION ALL SELECT l.conv_id, l.turn, t.thread, t.depth + 1 FROM l JOIN t ON t.conv_id = l.conv_id AND t.turn = l.reply)
SELECT l.conv_id, l.turn, role, body AS text, (n1 IS NOT NULL)::BIGINT + (n2 IS NOT NULL)::BIGINT AS n_quotes,
  (n1 IS NOT NULL)::BIGINT + (n2 IS NOT NULL)::BIGINT AS n_linked, reply AS reply_to, thread, depth::BIGINT AS depth,
  row_number() OVER (PARTITION BY l.conv_id, thread ORDER BY l.turn) AS position
FROM l JOIN t USING (conv_id, turn)
"""
