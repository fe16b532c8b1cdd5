"""The shared session in batch form: activity log, saved set, signals, debounce, progress (O-31, O-37 to O-39, O-46, O-47, O-66 to O-68, O-77, O-81 to O-85)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brevia.functions.text import trim

from . import fusion

LOG = 40
LOGGED = ("search", "open", "save", "unsave", "sort")


def effective(commands: DataFrame) -> DataFrame:
    """commands(session, at, who, action, arg) that change something, with `query`: the session's search text after each.

    A save of what is saved changes nothing, an unsave of what is not is refused; whether it is
    saved hangs on the last save or unsave of the same id alone. Opens always take effect, so
    what no document answers to must be left out before (see resolved).
    """
    rows = commands.where(F.col("action").isin(*LOGGED)).withColumn("arg", F.when(F.col("action") == "search", trim(F.coalesce("arg", F.lit("")))).otherwise(F.col("arg")))
    kind = F.col("action").isin("save", "unsave")
    before = F.lag("action").over(Window.partitionBy("session", "arg", kind).orderBy("at"))
    saved = F.coalesce(before == "save", F.lit(False))
    rows = rows.withColumn("_saved", F.when(kind, saved)).where(~kind | ((F.col("action") == "save") != F.col("_saved"))).drop("_saved")
    sofar = Window.partitionBy("session").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("query", F.coalesce(F.last(F.when(F.col("action") == "search", F.col("arg")), ignorenulls=True).over(sofar), F.lit("")))


def activity(commands: DataFrame, log: int = LOG) -> DataFrame:
    """(session, seq, who, action, detail): the last `log` entries of each session.

    Only what takes effect is logged; a blank search is not, and a sort searches again first,
    which is an entry of its own when the session has a query.
    """
    again = F.when((F.col("action") == "sort") & (F.col("query") != ""), F.array(F.struct(F.lit("search").alias("action"), F.col("query").alias("detail")))).otherwise(F.array().cast("array<struct<action:string,detail:string>>"))
    own = F.array(F.struct("action", F.col("arg").alias("detail")))
    rows = effective(commands).where("action != 'search' or arg != ''").select("session", "at", "who", F.posexplode(F.concat(again, own)).alias("n", "e"))
    rows = rows.withColumn("seq", F.row_number().over(Window.partitionBy("session").orderBy("at", "n")))
    last = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("seq")))
    return rows.withColumn("_n", last).where(F.col("_n") <= log).select("session", "seq", "who", "e.action", "e.detail")


def resolved(commands: DataFrame, docs: DataFrame) -> DataFrame:
    """commands whose open, save and unsave name a document by its id; those that no document answers to are left out."""
    kind = F.col("action").isin("open", "save", "unsave")
    needles = commands.where(kind & F.col("arg").isNotNull()).select(F.col("arg").alias("needle")).distinct()
    ids = fusion.resolve(docs, needles).join(docs.select("doc", F.col("id").alias("_id")), "doc").select("needle", "_id")
    return commands.join(ids, (F.col("arg") == F.col("needle")) & kind, "left").where(~kind | F.col("_id").isNotNull()).withColumn("arg", F.coalesce("_id", "arg")).drop("needle", "_id")


def named(entries: DataFrame, roster: DataFrame) -> DataFrame:
    """entries with the actor's name: from the roster(who, name), else the id; null who is the human."""
    return entries.join(roster, "who", "left").withColumn("actor", F.coalesce("name", F.col("who").cast("string"), F.lit("you"))).drop("name")


def saved_set(commands: DataFrame) -> DataFrame:
    """(session, id, pos): ids whose last save or unsave is a save, in the order of their saving."""
    events = commands.where(F.col("action").isin("save", "unsave")).select("session", "at", "action", F.col("arg").alias("id"))
    own = Window.partitionBy("session", "id").orderBy("at")
    runs = events.withColumn("_new", F.coalesce(F.lag("action").over(own) != F.col("action"), F.lit(True)))
    last = runs.groupBy("session", "id").agg(F.max_by("action", "at").alias("action"), F.max(F.when(F.col("_new") & (F.col("action") == "save"), F.col("at"))).alias("at"))
    return last.where("action = 'save'").select("session", "id", F.row_number().over(Window.partitionBy("session").orderBy("at", "id")).alias("pos"))


def saved_docs(saved: DataFrame, docs: DataFrame) -> DataFrame:
    """(session, pos, ...) of the saved ids that are in the corpus, with the columns of docs; others are left out."""
    return saved.join(docs, "id")


def signals(commands: DataFrame) -> DataFrame:
    """(session, at, signal, detail): only a human's open, save and unsave are signalled, and only if they take effect."""
    kind = F.when(F.col("action") == "open", "doc.opened").otherwise("saved.changed")
    return effective(commands).where(F.col("who").isNull() & F.col("action").isin("open", "save", "unsave")).select("session", "at", kind.alias("signal"), F.col("arg").alias("detail"))


def debounced(keys: DataFrame, gap: str = "220 milliseconds") -> DataFrame:
    """(session, fired, query): the last text typed before each pause, when the pause is over.

    keys(session, at, query[, key]); key `enter` fires at once, `escape` types the empty text.
    """
    own = Window.partitionBy("session").orderBy("at")
    key = F.col("key") if "key" in keys.columns else F.lit(None).cast("string")
    rows = keys.select("session", "at", F.when(key == "escape", "").otherwise(F.col("query")).alias("query"), F.coalesce(key == "enter", F.lit(False)).alias("enter"))
    over = F.col("at") + F.expr(f"interval {gap}")
    rows = rows.withColumn("next", F.lead("at").over(own)).where(F.col("enter") | F.col("next").isNull() | (F.col("next") >= over))
    return rows.select("session", F.when(F.col("enter"), F.col("at")).otherwise(over).alias("fired"), "query")


def debounced_stream(keys: DataFrame, gap: str = "220 milliseconds") -> DataFrame:
    """debounced() of a watermarked stream, without keys: a window fires when the watermark passes its end."""
    grouped = keys.groupBy("session", F.session_window("at", gap).alias("w")).agg(F.max_by("query", "at").alias("query"))
    return grouped.select("session", F.col("w.end").alias("fired"), "query")


def progress_changes(steps: DataFrame) -> DataFrame:
    """steps(job, seq, done, size) where the whole percent differs from the step before."""
    percent = F.floor(100 * F.col("done") / F.col("size"))
    rows = steps.withColumn("percent", percent)
    before = F.lag("percent").over(Window.partitionBy("job").orderBy("seq"))
    return rows.where(F.col("size") > 0).withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") != F.col("percent"))).drop("_b")


def weighted_progress(files: DataFrame) -> DataFrame:
    """files(job, seq, size) with the percent of all bytes that are done when the file begins."""
    own = Window.partitionBy("job").orderBy("seq")
    before = F.coalesce(F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("size").over(Window.partitionBy("job"))
    return files.withColumn("percent", F.floor(100 * before / F.greatest(total, F.lit(1))))
