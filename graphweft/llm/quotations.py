"""Chat conversations from messages that quote each other.

A line's quote level is the number of `>` at its start; a passage is a run of lines of one level without
blank lines between. Passages are normalised (lower case, white space as single spaces) and hashed. A
quoted passage belongs to the earliest message of its conversation whose own text, level 0, has it; a
message replies to the latest message that its quotes of level 1 lead to; deeper quotes are counted only,
also where no quote of level 1 leads anywhere. Replies follow the message they answer, and quotes are left out.

Plan: all in DataFrame functions. Passages are cut inside each row. Own passages are reduced to one row
per (conversation, hash) before the join, so the join key is unique on that side and a passage that many
messages quote stays a plain skewed join, which adaptive execution splits. Threads are found by doubling
pointers, unique on both sides. Positions come from ranges of the order and one prefix sum over ranges,
so a conversation of any size needs no task of its own.

Defined results: a null or empty text has no passages and an empty body; null roles are `user`; quotes of
unknown text are dropped and link to nothing; a message that quotes itself or a later one is no reply to
it; messages with the same (conv_id, turn) are one node of the thread and each gives its own row; null
conv_id or turn links with nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SharedTables, shuffle_partitions

_MARK = r"^((?:[ \t]*>)*)"


def quote_level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARK, 1), r"[^>]", ""))


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once; a plain expression would be computed anew for each element of a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def passages(text: Column) -> Column:
    """array<struct<level, text>>: normalised passages of a message in their order, empty ones left out."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(quote_level(x).alias("level"), normal(F.regexp_replace(x, _MARK, "")).alias("text")))

    def first_lines(ls: Column) -> Column:
        # a blank line parts passages as a change of level does
        new = lambda x, i: (i == 0) | (x["text"] == "") | (F.get(ls, i - 1)["text"] == "") | (F.get(ls, i - 1)["level"] != x["level"])
        return F.filter(F.transform(ls, lambda x, i: F.when(new(x, i), i).otherwise(-1)), lambda i: i >= 0)

    def cut(ls: Column, starts: Column) -> Column:
        return F.transform(
            starts,
            lambda s, k: F.struct(
                F.get(ls, s)["level"].alias("level"),
                F.array_join(F.transform(F.slice(ls, s + 1, F.coalesce(F.get(starts, k + 1), F.size(ls)) - s), lambda x: x["text"]), " ").alias("text"),
            ),
        )

    found = _bound(lines, lambda ls: _bound(first_lines(ls), lambda starts: cut(ls, starts)))
    return F.filter(found, lambda p: p["text"] != "")


def own_text(text: Column) -> Column:
    """The lines of level 0, outer white space cut."""
    return F.regexp_replace(F.array_join(F.filter(F.split(text, "\n"), lambda x: quote_level(x) == 0), "\n"), r"^\s+|\s+$", "")


def link_quotations(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, parent): one row for each message that replies to an earlier one, by (conv_id, turn)."""
    cut = messages.where("text is not null and conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(passages(F.col("text"))).alias("p")).select("conv_id", "turn", "p.level", F.sha2("p.text", 256).alias("hash"))
    origins = cut.where("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    quoted = cut.where("level = 1").select("conv_id", "turn", "hash").distinct()
    linked = quoted.join(origins, ["conv_id", "hash"]).where("origin < turn")
    return linked.groupBy("conv_id", "turn").agg(F.max("origin").alias("parent"))


def thread_roots(links: DataFrame, tables: SharedTables) -> DataFrame:
    """(conv_id, turn, root, depth) of every reply: each round doubles the distance that a pointer spans."""
    state = tables.save(links.select("conv_id", "turn", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), "pointers-0")
    step = 0
    while True:
        step += 1
        above = state.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("far"), F.col("depth").alias("more"))
        joined = state.join(above, ["conv_id", "root"], "left")
        after = tables.save(joined.select("conv_id", "turn", F.coalesce("far", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("far").isNotNull().alias("moved")), f"pointers-{step}")
        moved = not after.where("moved").isEmpty()
        state = after.drop("moved")
        if not moved:
            return state


def build_conversations(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, body, formatted, parent, root, depth, n_quotes, position) of every message; parent -1 for none.

    ``position`` counts from 0 within a conversation, by thread (the root's turn), then turn, so a reply
    comes after what it answers. ``formatted`` is the body in a chat template.
    """
    spark = messages.sparkSession
    tables = SharedTables(spark)
    links = tables.save(link_quotations(messages), "links")
    roots = thread_roots(links, tables)
    threads = links.join(roots, ["conv_id", "turn"])
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), own_text(text).alias("body"), F.size(F.filter(passages(text), lambda p: p["level"] > 0)).cast("long").alias("n_quotes"))
    joined = rows.join(threads, ["conv_id", "turn"], "left").withColumn("root", F.coalesce("root", "turn")).withColumn("depth", F.coalesce("depth", F.lit(0).cast("long"))).withColumn("parent", F.coalesce("parent", F.lit(-1).cast("long")))
    placed = _positions(joined, ["root", "turn", "role", "body"], tables)
    formatted = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("body"), F.lit("\n"))
    return placed.select("conv_id", "turn", "role", "body", formatted.alias("formatted"), "parent", "root", "depth", "n_quotes", "position")


def _positions(rows: DataFrame, order: list[str], tables: SharedTables) -> DataFrame:
    """Adds the row's place in its conversation, from ranges of the whole order."""
    parts = shuffle_partitions(rows.sparkSession)
    keyed = tables.save(tables.save(rows, "joined").withColumn("__tie", F.monotonically_increasing_id()), "tied")
    dealt = tables.save(keyed.repartitionByRange(parts, "conv_id", *order, "__tie").withColumn("__range", F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy("__range", "conv_id").agg(F.count(F.lit(1)).alias("n"))
    # a conversation has one row for each range it reaches into
    before = sizes.select("__range", "conv_id", F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("__range", "conv_id").orderBy(*order, "__tie")) - 1
    numbered = dealt.withColumn("__in", within)
    right = before.select(F.col("__range").alias("__r"), F.col("conv_id").alias("__c"), "base")
    return numbered.join(right, (F.col("__range") == F.col("__r")) & F.col("conv_id").eqNullSafe(F.col("__c"))).withColumn("position", (F.col("base") + F.col("__in")).cast("long"))
