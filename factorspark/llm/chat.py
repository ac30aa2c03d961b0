"""Chat formatting into budgeted windows (DataFrame functions only).

Prefix sums of turn tokens choose turn-aligned spans: the system turn's tokens and the history
budget are set aside, and a turn goes to the window in whose stride its prefix sum ends. A stride
is half of what is left, so a window of turns no longer than a stride keeps the budget; a longer
turn gets a window to itself or shares it with what precedes it, for turns are never cut. Every
window repeats the system turn and up to ``history`` earlier turns that fit the history budget;
repeated turns carry no loss.

Template: ``<|im_start|>role`` newline text ``<|im_end|>`` newline. Inside texts and roles a
backslash becomes two and ``<|`` becomes ``<\\|``, so a control string can't come from a text and
the change is undone by dropping one backslash of each pair; a role's newline gets one in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.llm.common import n_words

START, END = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY, HISTORY_BUDGET = 1024, 4, 192
#: Tokens that the template itself adds to a turn.
OVERHEAD = 4


def escape(text: Column) -> Column:
    slashed = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(slashed, F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.when(F.instr(text, "\\") > 0, F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def windows(turns: DataFrame, *, budget: int = BUDGET, history: int = HISTORY, history_budget: int = HISTORY_BUDGET) -> DataFrame:
    """(conv_id, window, formatted, loss, n_repeated, n_new, tokens), a row per window.

    ``loss`` is an array of (start, length) in code points of ``formatted``: the texts of new
    assistant turns. ``n_repeated`` turns at the front were in an earlier window.
    Defined cases: null text or role: empty; turns are ordered by turn (null first), then role,
    then text, so repeated rows are turns of their own; a null conv_id is a conversation; other
    columns are ignored; an empty table gives no windows.
    """
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select(
        F.col("conv_id"), F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    rows = rows.withColumn("tok", n_words(F.col("text")) + OVERHEAD)
    rows = rows.withColumn("i", F.row_number().over(by).cast("long"))
    rows = rows.withColumn("cum", F.sum("tok").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("sys_tok", F.first(F.when(F.col("role") == "system", F.col("tok")).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    stride = F.greatest(F.lit(1), F.floor((F.lit(budget - history_budget) - F.col("sys_tok")) / 2))
    rows = rows.withColumn("w", F.floor((F.col("cum") - 1) / stride).cast("long"))
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    rows = rows.withColumn("head", head).withColumn("body", escape(F.col("text")))
    piece = F.struct(F.col("i"), F.concat("head", "body", F.lit(END + "\n")).alias("s"), F.length("head").alias("at"), F.length("body").alias("n"),
                     (F.col("role") == "assistant").alias("loss"), F.col("cum"), F.col("tok"))
    rows = rows.withColumn("piece", piece)
    # a window's first turn brings along the system turn and the last turns before it that fit
    back = by.rowsBetween(-history, -1)
    rows = rows.withColumn("first", F.coalesce(F.lag("w").over(by) != F.col("w"), F.lit(True)))
    rows = rows.withColumn("past", F.when(F.col("first") & (F.col("i") > 1), F.collect_list("piece").over(back)))
    sys_piece = F.first(F.when(F.col("role") == "system", F.col("piece"))).over(by.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("sys", F.when(F.col("first") & (F.col("i") > 1), sys_piece))
    start = F.col("cum") - F.col("tok")
    fits = F.filter("past", lambda p: (start - p["cum"] + p["tok"] <= history_budget) & (F.col("sys").isNull() | (p["i"] > 1)))
    repeated = F.coalesce(F.concat(F.when(F.col("sys").isNotNull(), F.array("sys")).otherwise(F.expr("filter(array(sys), x -> false)")), fits), F.expr("filter(array(piece), x -> false)"))
    rows = rows.select("conv_id", "w", F.transform(repeated, lambda p: p.withField("loss", F.lit(False)).withField("i", p["i"] - F.lit(1 << 40))).alias("old"), "piece")
    packed = rows.groupBy("conv_id", "w").agg(F.sort_array(F.flatten(F.collect_list(F.concat("old", F.array("piece"))))).alias("p"))
    # where each text of the loss begins: a running sum of the pieces' lengths
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))
    spans = F.aggregate("p", zero, lambda a, p: F.struct(
        (a["at"] + F.length(p["s"])).alias("at"),
        F.when(p["loss"], F.concat(a["loss"], F.array(F.struct((a["at"] + p["at"]).alias("start"), p["n"].alias("length"))))).otherwise(a["loss"]).alias("loss"),
    ), lambda a: a["loss"])
    n_old = F.size(F.filter("p", lambda p: p["i"] < 0))
    return packed.select(
        "conv_id", F.col("w").alias("window"), F.array_join(F.col("p")["s"], "").alias("formatted"), spans.alias("loss"),
        n_old.alias("n_repeated"), (F.size("p") - n_old).alias("n_new"), F.aggregate("p", F.lit(0).cast("long"), lambda a, p: a + p["tok"]).alias("tokens"),
    )


def read_back(wins: DataFrame) -> DataFrame:
    """What a reader gets out of the windows: (conv_id, window, turns, loss_text, formatted_chars).

    ``turns`` holds the (role, text) of the new turns, parsed from the formatted string.
    """
    body = F.substring("formatted", 1, F.length("formatted") - F.lit(len(END) + 1))
    parts = F.split(body, F.lit(r"<\|im_end\|>\n"), -1)
    new = F.slice(parts, F.col("n_repeated") + 1, F.col("n_new"))
    first = r"(?s)^<\|im_start\|>((?:[^\\\n]|\\.)*)\n"
    parsed = F.transform(new, lambda t: F.struct(
        unescape(F.regexp_extract(t, first, 1)).alias("role"),
        unescape(F.substring(t, F.length(F.regexp_extract(t, first, 0)) + 1, F.length(t))).alias("text"),
    ))
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return wins.select("conv_id", "window", parsed.alias("turns"), loss.alias("loss_text"), F.length("formatted").alias("formatted_chars"))


def digests(wins: DataFrame) -> DataFrame:
    """One row per conversation with hashes of what was read back from its windows."""
    back = read_back(wins)
    turns_text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    per = back.select("conv_id", "window", F.size("turns").alias("n"), turns_text.alias("tt"), "loss_text", "formatted_chars")
    conv = per.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"), F.sort_array(F.collect_list(F.struct("window", "tt", "loss_text"))).alias("ws"), F.sum("formatted_chars").cast("long").alias("formatted_chars")
    )
    whole = F.array_join(F.col("ws")["loss_text"], "")
    return conv.select(
        "conv_id", "n_turns", F.sha2(F.array_join(F.col("ws")["tt"], ""), 256).alias("turns_sha256"), F.length(whole).cast("long").alias("loss_chars"),
        F.sha2(whole, 256).alias("loss_sha256"), "formatted_chars",
    )
