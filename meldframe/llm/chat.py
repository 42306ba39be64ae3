"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example: all turns before it as context, and its text, the only trainable part.
A turn is written <|im_start|>role\\n text <|im_end|>\\n. In roles and texts a backslash is doubled and one is put after the
first character of each control string, so that no control string is left in them and unescape() gives them back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
# Control strings of common chat templates.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_QUOTED = "|".join([r"\\"] + [f"{c[0] if c[0] != '[' else chr(92) + '['}(?={chr(92)}Q{c[1:]}{chr(92)}E)" for c in CONTROL])


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _QUOTED, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def _role(role: Column) -> Column:
    """A role has no raw line break: it is escaped too."""
    return F.regexp_replace(escape(role), "\n", "\\\\\n")


def expanded(turns: DataFrame) -> DataFrame:
    """Per assistant turn of turns (conv_id, turn, role, text) one example; per conversation that doesn't end with one, also an
    example of all turns with nothing to train on, so that no turn is lost.

    Gives conv_id, example (from 1), n_turns, trainable, formatted, loss_start and loss_chars (code points from 0).
    Null roles and texts are empty; a null conv_id is a conversation of its own; rows of one turn number follow one another by
    role and text, nulls first, and repeated rows are repeated turns. Other columns are ignored. No rows give no rows.
    Texts are taken whole; each conversation must fit in one string.
    """
    row = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    block = F.transform(
        "turns",
        lambda t: F.struct(
            (t["role"] == "assistant").alias("target"),
            F.concat(F.lit(OPEN), _role(t["role"]), F.lit("\n")).alias("head"),
            escape(t["text"]).alias("body"),
        ),
    )
    convs = convs.select("conv_id", block.alias("blocks"))
    ends = F.filter(F.sequence(F.lit(1), F.size("blocks")), lambda i: F.element_at("blocks", i)["target"] | (i == F.size("blocks")))
    one = convs.select("conv_id", "blocks", F.posexplode(ends).alias("k", "n_turns"))
    before = F.array_join(F.transform(F.slice("blocks", 1, F.col("n_turns") - 1), lambda b: F.concat(b["head"], b["body"], F.lit(CLOSE))), "")
    last = F.element_at("blocks", F.col("n_turns"))
    one = one.select("conv_id", (F.col("k") + 1).alias("example"), "n_turns", last["target"].alias("trainable"), F.concat(before, last["head"]).alias("prompt"), last["body"].alias("reply"))
    return one.select(
        "conv_id", "example", F.col("n_turns").cast("long").alias("n_turns"), "trainable",
        F.concat("prompt", "reply", F.lit(CLOSE)).alias("formatted"),
        F.length("prompt").cast("long").alias("loss_start"),
        F.when(F.col("trainable"), F.length("reply")).otherwise(0).cast("long").alias("loss_chars"),
    )


def parsed(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    head = r"^<\|im_start\|>((?:[^\\\n]++|\\[\s\S])*+)\n"  # possessive: a role of any length takes no stack
    return F.transform(parts, lambda p: F.struct(unescape(F.regexp_extract(p, head, 1)).alias("role"), unescape(F.regexp_replace(p, head, "")).alias("text")))


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation what its examples say, read back from them: the turns from the longest, the trained text from the masks.

    A null conv_id is a conversation; without a trainable example the trained text is empty; an example that occurs twice counts twice. Roles and texts
    may be of any length that a string can have. No examples give no rows.
    """
    reply = unescape(F.substring(F.col("formatted"), (F.col("loss_start") + 1).cast("int"), F.col("loss_chars").cast("int")))
    ex = examples.select(
        "conv_id", F.length("formatted").cast("long").alias("chars"),
        F.struct("n_turns", "formatted").alias("whole"),
        F.when(F.col("trainable"), F.struct("example", reply.alias("reply"))).alias("loss"),
    )
    ex = ex.groupBy("conv_id").agg(F.max("whole").alias("whole"), F.array_join(F.transform(F.sort_array(F.collect_list("loss")), lambda x: x["reply"]), "").alias("loss"), F.sum("chars").alias("formatted_chars"))
    turns = parsed(F.col("whole.formatted"))
    ex = ex.select("conv_id", turns.alias("turns"), "loss", "formatted_chars")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return ex.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
