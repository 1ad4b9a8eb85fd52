"""Chat formatting in budgeted windows, with DataFrame functions only.

Turn tokens are summed along each conversation.  With ``budget`` tokens a window,
``history`` of them for repeats and the system turn's own tokens set aside, a turn
belongs to the window ``sum before it // share``, where the share is half of what
is left: so a window fits its budget unless one turn alone is larger than a share.
Each window starts with the leading system turn, then repeats the whole turns of
the window before that begin within ``history`` tokens of its start, then holds
its own turns.  Loss counts for assistant texts in their own window only.

A turn is written ``<s>role\\ntext</s>``.  Within roles and texts ``~`` and the
control strings are escaped, and in roles line ends too, so the template's marks
occur nowhere else and reading is exact.

There is one shuffle, by conversation; the windows of a conversation, and what is
read back from them, are grouped where it put them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUDGET, HISTORY, LEAST_SHARE = 512, 128, 32
TURN_TOKENS = 4
START, END = "<s>", "</s>"
#: What is escaped, in the order of escaping; reading goes backwards.
ESCAPES = (("~", "~0"), ("</s>", "~1"), ("<s>", "~2"), ("[INST]", "~3"), ("[/INST]", "~4"), ("\n", "~n"))


def _replace(column: Column, pairs) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, column)


def escape(text: Column, line_ends: bool = False) -> Column:
    return _replace(text, ESCAPES if line_ends else ESCAPES[:-1])


def unescape(text: Column, line_ends: bool = False) -> Column:
    return _replace(text, [(b, a) for a, b in reversed(ESCAPES if line_ends else ESCAPES[:-1])])


def turn_tokens(text: Column) -> Column:
    """Tokens of a turn, estimated at four characters a token and four for the marks."""
    return F.floor((F.length(text) + 3) / 4).cast("long") + TURN_TOKENS


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """A row per window: ``conv_id, window, formatted, n_repeated, loss``.

    ``n_repeated`` turns at the head of ``formatted`` are repeats; ``loss`` lists
    the character spans (start, length) that are targets, ascending.  Turns are
    taken by ``turn, role, text``; null roles and texts are empty, a null turn is
    first, null ids make one conversation, and repeated rows are turns of their
    own.  Only ``conv_id, turn, role, text`` are read.  ``history`` above a
    window's share is held at the share.
    """
    conv = Window.partitionBy("conv_id")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = conversations.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    rows = rows.withColumn("k", F.row_number().over(conv.orderBy(*order)) - 1)
    leads = (F.col("k") == 0) & (F.col("role") == "system")
    by_turn = conv.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("tokens", F.when(leads, F.lit(0)).otherwise(turn_tokens(F.col("text"))))
    rows = rows.withColumns({
        "before": F.sum("tokens").over(by_turn) - F.col("tokens"),
        "system": F.first(F.when(leads, F.col("text"))).over(by_turn),
        "share": F.greatest(
            F.lit(LEAST_SHARE),
            F.floor((F.lit(budget - history) - F.coalesce(F.first(F.when(leads, turn_tokens(F.col("text")))).over(by_turn), F.lit(0))) / 2)
        ).cast("long"),
    })
    rows = rows.withColumn("window", F.floor(F.col("before") / F.col("share")).cast("long"))
    opens = F.row_number().over(Window.partitionBy("conv_id", "window").orderBy("k")) == 1
    # a window's own first turn knows the next window's: among first turns, the one that follows
    firsts = F.lead(F.struct("window", "before")).over(Window.partitionBy("conv_id", "opens").orderBy("k"))
    rows = rows.withColumn("opens", opens).withColumn("_next", F.when(F.col("opens"), firsts))
    rows = rows.withColumn(
        "_next",
        F.first("_next", ignorenulls=True).over(Window.partitionBy("conv_id", "window").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    rows = rows.withColumns({"next": F.col("_next.window"), "next_start": F.col("_next.before")})
    reach = F.least(F.lit(history), F.col("share"))
    turn = lambda window, kind, role, text, k: F.struct(window.alias("window"), F.lit(kind).alias("kind"), k.alias("k"), role.alias("role"), text.alias("text"))
    role, text, k = F.col("role"), F.col("text"), F.col("k")
    placed = F.array(
        turn(F.col("window"), 2, role, text, k),
        F.when(F.col("next").isNotNull() & (F.col("before") >= F.col("next_start") - reach) & ~leads, turn(F.col("next"), 1, role, text, k)),
        F.when(F.col("opens") & (F.col("window") > 0) & F.col("system").isNotNull(), turn(F.col("window"), 0, F.lit("system"), F.col("system"), F.lit(-1))),
    )
    rows = rows.select("conv_id", F.explode(F.filter(placed, lambda x: x.isNotNull())).alias("t")).select("conv_id", "t.*")
    mark = F.concat(F.lit(START), escape(F.col("role"), True), F.lit("\n"))
    rows = rows.withColumns({"mark": mark, "body": escape(F.col("text"))}).withColumn("written", F.concat("mark", "body", F.lit(END)))
    within = Window.partitionBy("conv_id", "window").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("start", F.sum(F.length("written")).over(within) - F.length("written") + F.length("mark"))
    target = F.when((F.col("kind") == 2) & (F.col("role") == "assistant"), F.struct(F.col("start").alias("start"), F.length("body").cast("long").alias("length")))
    return rows.groupBy("conv_id", "window").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "written"))), lambda x: x["written"]), "").alias("formatted"),
        F.count_if(F.col("kind") < 2).alias("n_repeated"),
        F.array_sort(F.collect_list(target)).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests by conversation of what the windows hold, read from ``formatted`` and ``loss`` alone."""
    starts = F.split("formatted", END)
    kept = F.slice(starts, F.col("n_repeated") + 1, F.size(starts) - 1 - F.col("n_repeated"))
    head = lambda p: F.substring_index(F.substring(p, F.lit(len(START) + 1), F.length(p)), "\n", 1)
    said = lambda p: F.concat(unescape(head(p), True), F.lit("\n"), unescape(F.substring(p, F.length(head(p)) + len(START) + 2, F.length(p))), F.lit("\n"))
    lost = lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))
    each = formatted.select(
        "conv_id", "window", F.size(kept).cast("long").alias("turns"), F.array_join(F.transform(kept, said), "").alias("said"),
        F.array_join(F.transform("loss", lost), "").alias("lost"), F.length("formatted").cast("long").alias("chars")
    )
    joined = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("window", name))), lambda x: x[name]), "")
    whole = each.groupBy("conv_id").agg(F.sum("turns").alias("n_turns"), joined("said").alias("said"), joined("lost").alias("lost"), F.sum("chars").alias("formatted_chars"))
    return whole.select(
        "conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("lost").cast("long").alias("loss_chars"),
        F.sha2("lost", 256).alias("loss_sha256"), "formatted_chars"
    )
