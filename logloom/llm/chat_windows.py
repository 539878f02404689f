"""Chat formatting in budgeted windows. DataFrame functions only.

A conversation becomes windows of whole turns. Prefix sums of turn tokens choose the spans: turns that begin in the same stretch of `stride` tokens share a window, and a turn longer
than a stride has one of its own, so new turns of a window fit twice the stride (or are a single longer turn). Turns are never cut: a longer turn, or a system turn above its
third of the budget, makes its windows longer, and `over_budget` says so. Every window begins with the system turn, then repeats the turns before it that lie within `history` tokens, then
has its new turns. Only assistant turns that are new are under the loss mask; each is so exactly once.

A turn is written `<|im_start|>role`, a line end, the text, `<|im_end|>`, a line end. Control strings inside texts and roles (of this and other common templates) get a backslash after
their first character; strings that look escaped get one more, so `unescape` gives back every text. Line ends and backslashes in roles are escaped too.

Prefix sums are made in two levels, blocks of turn numbers and then turns in a block, so a conversation of any length is spread over tasks; a window is bounded by the budget.

Defined cases: null text or role counts as empty. Turns are ordered by turn (null last), then role and text, so repeated rows are turns of their own in a fixed order. A null conv_id is one
conversation. The system turn is a first turn with role `system`; later ones are ordinary turns. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 1024        # tokens of a window
HISTORY = 256        # tokens of repeated turns
OVERHEAD = 4         # tokens of a turn's marks
BLOCK_TURNS = 256    # turn numbers of a block of prefix sums
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
# First character, backslashes that are there already, rest: control strings of common chat templates.
CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\]|<SYS>>|</SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(CONTROL), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(CONTROL.replace(r"(\\*)", r"\\(\\*)")), F.lit("$1$2$3"))


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def tokens(text: Column) -> Column:
    """Words and other signs, the budget's unit."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]")) + OVERHEAD


def numbered(chats: DataFrame) -> DataFrame:
    """conv_id, role, text, n (tokens), at (tokens of all turns before)."""
    turns = chats.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumns({"n": tokens(F.col("text")).cast("bigint"), "block": F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(2**62)).cast("bigint")})
    sums = turns.groupBy("conv_id", "block").agg(F.sum("n").alias("block_n"))
    sums = sums.withColumn("base", F.sum("block_n").over(Window.partitionBy("conv_id").orderBy("block")) - F.col("block_n")).drop("block_n")
    sums = sums.withColumnRenamed("conv_id", "base_conv").withColumnRenamed("block", "base_block")
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_last(), "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    turns = turns.withColumn("within", F.sum("n").over(inside) - F.col("n"))
    joined = turns.join(sums, turns["conv_id"].eqNullSafe(sums["base_conv"]) & (turns["block"] == sums["base_block"]))
    return joined.select("conv_id", "role", "text", "n", (F.col("base") + F.col("within")).alias("at"))


def windows(chats: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window (its first new turn's place in tokens), formatted, loss_spans (start, length in code points), n_repeated, n_new, n_tokens, over_budget."""
    turns = numbered(chats)
    first = (F.col("at") == 0) & (F.col("role") == "system")
    system = turns.filter(first).select(F.col("conv_id").alias("sys_conv"), F.col("n").alias("sys_n"), F.col("role").alias("sys_role"), F.col("text").alias("sys_text"))
    stride = max((budget - history) // 3, 1)  # two thirds for new turns, one for the system turn
    long = F.col("n") > stride
    new = turns.withColumns({"stretch": F.floor(F.col("at") / stride), "long": long})
    spans = new.groupBy("conv_id", "stretch", "long").agg(F.min("at").alias("window"))
    spans = spans.select(F.col("conv_id").alias("w_conv"), F.col("stretch").alias("w_stretch"), F.col("long").alias("w_long"), "window")
    placed = new.join(spans, new["conv_id"].eqNullSafe(spans["w_conv"]) & (new["stretch"] == spans["w_stretch"]) & (new["long"] == spans["w_long"]))
    placed = placed.select("conv_id", "window", F.lit(2).alias("part"), "at", "n", "role", "text")
    reach = F.explode(F.sequence(F.floor(F.col("at") / stride), F.floor((F.col("at") + history) / stride)))  # stretches whose windows may look back to the turn
    back = turns.filter(~first).select("conv_id", "at", "n", "role", "text", reach.alias("stretch"))
    back = back.join(spans, back["conv_id"].eqNullSafe(spans["w_conv"]) & (back["stretch"] == spans["w_stretch"])).filter(f"at < window and at >= window - {history}")
    back = back.select("conv_id", "window", F.lit(1).alias("part"), "at", "n", "role", "text")
    head = system.join(spans.filter("window > 0"), F.col("sys_conv").eqNullSafe(F.col("w_conv")))
    head = head.select(F.col("w_conv").alias("conv_id"), "window", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("at"), F.col("sys_n").alias("n"), F.col("sys_role").alias("role"), F.col("sys_text").alias("text"))
    rows = placed.unionByName(back).unionByName(head)
    rows = rows.withColumns({"lead": F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n")), "body": escape(F.col("text"))})
    whole = rows.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(F.struct("part", "at", "role", "lead", "body", "n"))).alias("turns"))  # a window's turns: bounded by the budget
    piece = lambda t: F.concat(t["lead"], t["body"], F.lit(CLOSE))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        span = F.struct((acc["at"] + F.length(t["lead"])).alias("start"), F.length(t["body"]).alias("length"))
        under = (t["part"] == 2) & (t["role"] == "assistant")
        return F.struct((acc["at"] + F.length(piece(t))).alias("at"), F.when(under, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    total = F.aggregate("turns", F.lit(0).cast("bigint"), lambda a, t: a + t["n"])
    repeated = F.size(F.filter("turns", lambda t: t["part"] < 2))
    return whole.select("conv_id", "window", F.array_join(F.transform("turns", piece), "").alias("formatted"), F.aggregate("turns", start, step, lambda a: a["out"]).alias("loss_spans"),
                        repeated.alias("n_repeated"), (F.size("turns") - repeated).alias("n_new"), total.alias("n_tokens"), (total > budget).alias("over_budget"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Each window with `turns` (role and text of its new turns) and `loss` (unescaped texts under the mask), all from the formatted text."""
    pieces = F.split("formatted", r"<\|im_end\|>\n", -1)
    new = F.slice(pieces, F.col("n_repeated") + 1, F.col("n_new"))

    def turn(p: Column) -> Column:
        line = F.substring_index(F.substring(p, F.lit(len(OPEN) + 1), F.length(p)), "\n", 1)
        return F.struct(unescape_role(line).alias("role"), unescape(F.substring(p, len(OPEN) + F.length(line) + 2, F.length(p))).alias("text"))

    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.withColumns({"turns": F.transform(new, turn), "loss": loss})
