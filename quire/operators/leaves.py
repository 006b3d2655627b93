"""Values as a relation of their leaves: what stands at each path of an array or dictionary, to be replaced by joins and spelled again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.kernels.syntax import leaves as kernel
from quire.kernels.syntax import parse
from quire.plans.rounds import settled

LEAVES = "array<struct<seq: int, path: array<string>, kind: string, before: string, text: string, num: long>>"
#: References that may lead on from one another, and leaves that a value may have: what is beyond is null.
ROUNDS, MOST = 16, 4096


def _leaves(spelled: str | None) -> list[dict] | None:
    if spelled is None:
        return None
    try:
        return kernel(parse(spelled.encode("latin-1"))[0])
    except ValueError:
        return [{"seq": 0, "path": [], "kind": "unread", "before": "", "text": spelled, "num": None}]


def leaves_of(spelled: Column) -> Column:
    """The leaves of a spelled value in order, the closing brackets last."""
    return F.udf(_leaves, LEAVES, useArrow=True)(spelled)


def leaves(values: DataFrame) -> DataFrame:
    """The columns of values but `spelled`, and seq (an array, ordered as spelled), path, kind, before, text and to (where a reference leads)
    of each leaf."""
    keep = [c for c in values.columns if c != "spelled"]
    rows = values.select(*keep, F.explode(leaves_of(F.col("spelled"))).alias("l"))
    return rows.select(*keep, F.array("l.seq").alias("seq"), "l.path", "l.kind", "l.before", "l.text", F.col("l.num").alias("to"))


def spelled(rows: DataFrame, *keys: str) -> DataFrame:
    """keys and spelled: leaves put together again."""
    whole = F.array_sort(F.collect_list(F.struct("seq", "before", "text")))
    made = rows.groupBy(*keys).agg(whole.alias("l"))
    return made.select(*keys, F.array_join(F.transform("l", lambda x: F.concat(x["before"], x["text"])), "").alias("spelled"))


def followed(rows: DataFrame, objects: DataFrame, *keys: str) -> DataFrame:
    """rows (leaves with file_id and keys) in which references give way to the leaves of what they lead to, round after round.

    References to streams stay, as only these can name one. A reference to nothing, to what it stands in itself, or beyond ROUNDS is null,
    and so are those of a value that has come to more than MOST leaves; a round only touches values that still have references.
    """
    columns = [*keys, "seq", "path", "kind", "before", "text", "to", "via"]
    live = settled(rows.withColumn("via", F.array().cast("array<long>")).select(*columns))
    done = live.where("kind != 'ref'")
    live = live.where("kind = 'ref'")
    nothing = F.lit("null")
    for turn in range(ROUNDS + 1):
        wide = live.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > MOST).select(*keys, F.lit(True).alias("wide"))
        wanted = live.select("file_id", F.col("to").alias("num")).distinct()
        found = objects.join(wanted, ["file_id", "num"], "left_semi").select("file_id", F.col("num").alias("to"), (F.col("kind") == "stream").alias("is_stream"), leaves_of(F.when(F.col("kind") != "stream", F.decode("body", "ISO-8859-1"))).alias("new"))
        step = live.join(found, ["file_id", "to"], "left").join(wide, list(keys), "left")
        lost = F.array_contains("via", F.col("to")) | F.col("wide").isNotNull() | F.lit(turn == ROUNDS) | F.col("is_stream").isNull()
        step = settled(step.withColumn("fate", F.when(F.col("is_stream"), "stays").when(lost, "lost").otherwise("goes on")).select(*columns, "fate", "new"))
        ended = step.where("fate != 'goes on'").withColumns({"text": F.when(F.col("fate") == "lost", nothing).otherwise(F.col("text")), "kind": F.when(F.col("fate") == "lost", nothing).otherwise(F.col("kind"))})
        done = done.unionByName(ended.select(*columns))
        more = step.where("fate = 'goes on'").select(*keys, "seq", "path", "before", F.concat("via", F.array("to")).alias("via"), F.explode("new").alias("l"))
        first = F.when(F.col("l.seq") == 0, F.concat("before", F.col("l.before"))).otherwise(F.col("l.before"))
        more = settled(more.select(*keys, F.concat("seq", F.array("l.seq")).alias("seq"), F.concat("path", F.col("l.path")).alias("path"), "l.kind", first.alias("before"), "l.text", F.col("l.num").alias("to"), "via").select(*columns))
        done = done.unionByName(more.where("kind != 'ref'"))
        live = more.where("kind = 'ref'")
        if not live.limit(1).count():
            break
    return done


def inlined_deep(objects: DataFrame, *keys: str) -> DataFrame:
    """objects whose entries under the given keys have no references inside but those to streams."""
    asked = objects.select("file_id", F.col("num").alias("of"), F.explode(F.map_filter("entries", lambda k, v: k.isin(*keys) & v.rlike(r"\d \d+ R"))).alias("key", "spelled"))
    asked = settled(asked)
    if not asked.limit(1).count():
        return objects
    told = spelled(followed(leaves(asked), objects, "file_id", "of", "key"), "file_id", "of", "key")
    told = told.groupBy("file_id", F.col("of").alias("num")).agg(F.map_from_entries(F.collect_list(F.struct("key", "spelled"))).alias("told"))
    both = objects.join(told, ["file_id", "num"], "left")
    swapped = F.transform_values("entries", lambda k, v: F.coalesce(F.col("told")[k], v))
    return both.withColumn("entries", F.when(F.col("told").isNull(), F.col("entries")).otherwise(swapped)).select(*objects.columns)
