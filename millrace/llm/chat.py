"""Chat formatting in budgeted windows, in DataFrame functions only.

Prefix sums of turn tokens cut a conversation into spans of whole turns. Each window
repeats the system turn and a limited stretch of history; only turns that are new in it
are targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The template's control strings, and the stand-ins for what would read as one.
START, END = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY = 1024, 128
#: Tokens that the template adds to a turn: both control strings and the role.
TEMPLATE_TOKENS = 3


def escape(text: Column) -> Column:
    """No control string is left; ``unescape`` gives the text back."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    for mark, plain in (("&#10;", "\n"), ("&lt;", "<"), ("&amp;", "&")):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, text, loss, n_repeated, n_turns) of each window.

    ``loss`` lists the (start, stop) code points of assistant texts that are new in the
    window; its first ``n_repeated`` turns are repeats and never targets. Tokens are words
    plus TEMPLATE_TOKENS a turn. A leading system turn opens every window; history is the
    longest run of whole turns before the window within ``history`` tokens. New turns fill
    at most what is left of ``budget`` (a quarter of it at least, if the system turn is
    long); a turn of more than half of that stands alone, and only such a window can exceed
    the budget. Turns are ordered by turn, then role, then text; a null turn comes first,
    null role or text counts as empty, a null conv_id is one conversation. Repeated rows
    are turns of their own. Extra columns are ignored.
    """
    conv = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = conv.rowsBetween(Window.unboundedPreceding, -1)
    so_far = conv.rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("long")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    body = ~F.col("system")
    turns = (
        conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", blank("role"), blank("text"))
        .withColumn("ord", F.row_number().over(conv))
        .withColumn("tokens", (F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) + TEMPLATE_TOKENS).cast("long"))
        .withColumn("system", (F.col("ord") == 1) & (F.col("role") == "system"))
        .withColumn("head", F.max(F.when(F.col("system"), F.col("tokens"))).over(so_far))
        .withColumn("half", F.floor(F.greatest(F.lit(budget) - history - F.coalesce("head", zero), F.lit(budget // 4)) / 2))
        .withColumn("at", F.coalesce(F.sum(F.when(body, F.col("tokens"))).over(before), zero))
        .withColumn("large", (body & (F.col("tokens") > F.col("half"))).cast("long"))
        .withColumn("larges", F.coalesce(F.sum("large").over(before), zero))
        .withColumn("cell", F.when(body, F.struct(F.floor(F.col("at") / F.col("half")), "larges", "large")))
        .withColumn("opens", (F.lag("cell").over(conv).isNull() | (F.lag("cell").over(conv) != F.col("cell"))) & body)
        .withColumn("window", F.greatest(F.sum(F.col("opens").cast("long")).over(so_far), F.lit(1)))
    )
    span = Window.partitionBy("conv_id").orderBy("at").rangeBetween(-history, -1)
    turns = turns.withColumn("had", F.min(F.when(body, F.col("ord"))).over(span)).select(
        "conv_id", "window", "ord", "role", "text", "opens", "had", F.col("head").isNotNull().alias("led")
    )
    none = F.array().cast("array<int>")
    past = F.when(F.col("had").isNotNull(), F.sequence("had", F.col("ord") - 1)).otherwise(none)
    repeats = turns.where(F.col("opens") & (F.col("window") > 1)).select(
        "conv_id", "window", F.explode(F.concat(F.when(F.col("led"), F.array(F.lit(1))).otherwise(none), past)).alias("ord")
    )
    said = turns.select(F.col("conv_id").alias("of"), F.col("ord").alias("at"), "role", "text")
    again = repeats.join(said, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("ord") == F.col("at"))).drop("of", "at")
    shown = turns.select("conv_id", "window", "ord", "role", "text", F.lit(True).alias("new")).unionByName(again.withColumn("new", F.lit(False)))
    opening = F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n"))
    inside = Window.partitionBy("conv_id", "window").orderBy("ord")
    placed = (
        shown.withColumn("opening", opening)
        .withColumn("said", escape(F.col("text")))
        .withColumn("whole", F.concat("opening", "said", F.lit(END + "\n")))
        .withColumn("end", F.sum(F.length("whole")).over(inside))
        .withColumn("start", F.col("end") - F.length("whole") + F.length("opening"))
        .withColumn("target", F.when(F.col("new") & (F.col("role") == "assistant"), F.struct("start", (F.col("start") + F.length("said")).alias("stop"))))
    )
    return (
        placed.groupBy("conv_id", "window")
        .agg(
            F.array_sort(F.collect_list(F.struct("ord", "whole"))).alias("turns"),
            F.array_sort(F.collect_list("target")).alias("loss"),
            F.sum((~F.col("new")).cast("int")).cast("int").alias("n_repeated"),
        )
        .select("conv_id", "window", F.array_join(F.transform("turns", lambda t: t.whole), "").alias("text"), "loss", "n_repeated", F.size("turns").alias("n_turns"))
    )


def read_turns(text: Column, n_repeated: Column) -> Column:
    """The new turns of a window's text, as structs of role and text."""
    parts = F.split(text, r"<\|im_start\|>")
    new = F.slice(parts, n_repeated + 2, F.size(parts))
    cut = lambda p: F.instr(p, "\n")
    said = lambda p: F.substr(p, cut(p) + 1, F.length(p) - cut(p) - len(END) - 1)
    return F.transform(new, lambda p: F.struct(unescape(F.substring_index(p, "\n", 1)).alias("role"), unescape(said(p)).alias("text")))


def read_targets(text: Column, loss: Column) -> Column:
    """The texts under a window's loss mask."""
    return F.transform(loss, lambda s: unescape(F.substr(text, (s.start + 1).cast("int"), (s.stop - s.start).cast("int"))))


def op6_chat_windows(spark, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = F.lit(END + START + "assistant ok")
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text")
    )
    out = windows(given.unionByName(more))
    turns = read_turns(F.col("text"), F.col("n_repeated"))
    back = out.select(
        "conv_id",
        "window",
        F.size(turns).alias("n"),
        F.array_join(F.transform(turns, lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "").alias("turns"),
        F.array_join(read_targets(F.col("text"), F.col("loss")), "").alias("loss"),
        F.length("text").alias("chars"),
    )
    whole = back.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars")
    )
    joined = lambda name: F.array_join(F.transform("w", lambda x: x[name]), "")
    return whole.select(
        "conv_id",
        F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2(joined("turns"), 256).alias("turns_sha256"),
        F.length(joined("loss")).cast("long").alias("loss_chars"),
        F.sha2(joined("loss"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
