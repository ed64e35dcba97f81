"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own.

An example holds all turns up to its target, formatted by one template; only the target's text may be trained on
(``loss_start``, ``loss_end``: code points of ``formatted``). As every example of a conversation is a beginning of
the formatted conversation, that is built once, and examples are cut from it at their ends. Turns after the last
reply end in one more example without a target, so that no turn is lost.

Template: ``<s>[role]`` line break, text, ``</s>`` line break. Roles and texts are escaped so that neither ``<`` nor
``[`` nor ``]`` is left in them: ``&`` becomes ``&amp;``, ``<`` ``&lt;``, ``[`` ``&#91;``, ``]`` ``&#93;``. So no
text can open or close a turn, and :func:`turns_of` reads back what was written.

Only DataFrame and SQL functions are used. A conversation is one row while it is formatted, as its last example is.

Cases: null text: empty. Null role: empty role, never a target. Null turn: first. Turns with one number: by role,
then text. Null conv_id: rows of one conversation. A conversation without a reply: one example without a target.
Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TARGET_ROLE = "assistant"
#: Control characters and what stands for them, in the order of escaping.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("]", "&#93;"))
_CLOSE = "</s>\n"
_TURN = r"<s>\[([^\]]*)\]\n([^<]*)</s>"


def escaped(text: Column) -> Column:
    for plain, stands in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(stands))
    return text


def unescaped(text: Column) -> Column:
    for plain, stands in reversed(ESCAPES):
        text = F.replace(text, F.lit(stands), F.lit(plain))
    return text


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0), formatted, loss_start, loss_end, is_last: one row for each example.

    Without a target ``loss_start`` and ``loss_end`` are null. ``is_last`` marks the example with all turns.
    """
    turns = conversations.selectExpr("conv_id", "turn", "coalesce(role, '') AS role", "coalesce(text, '') AS text")
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    parts = whole.select("conv_id", F.transform("turns", _formatted_turn).alias("parts"))
    placed = parts.select(
        "conv_id", F.array_join("parts.formatted", "").alias("whole"),
        F.transform("parts", lambda p: p["role"] == TARGET_ROLE).alias("target"),
        F.transform("parts", lambda p: F.length(p["text"])).alias("text_length"),
        F.aggregate(
            F.transform("parts", lambda p: F.length(p["formatted"])), F.array(F.lit(0)),
            lambda ends, n: F.concat(ends, F.array(F.element_at(ends, -1) + n)),
        ).alias("ends"),
    )
    ends = placed.select("conv_id", "whole", F.inline(_example_ends()))
    return ends.selectExpr(
        "conv_id", "row_number() OVER (PARTITION BY conv_id ORDER BY end) - 1 AS example",
        "substring(whole, 1, end) AS formatted", "loss_start", "loss_end", "is_last",
    )


def _formatted_turn(turn: Column) -> Column:
    role, text = escaped(turn["role"]), escaped(turn["text"])
    formatted = F.concat(F.lit("<s>["), role, F.lit("]\n"), text, F.lit(_CLOSE))
    return F.struct(turn["role"].alias("role"), text.alias("text"), formatted.alias("formatted"))


def _example_ends() -> Column:
    last = F.size("target") - 1
    chosen = F.filter(F.sequence(F.lit(0), last), lambda i: F.get("target", i) | (i == last))

    def example(i: Column) -> Column:
        end = F.get("ends", i + 1)
        loss_end = F.when(F.get("target", i), end - len(_CLOSE))
        return F.struct(
            end.alias("end"), (loss_end - F.get("text_length", i)).alias("loss_start"), loss_end.alias("loss_end"),
            (i == last).alias("is_last"),
        )

    return F.transform(chosen, example)


def turns_of(formatted: Column) -> Column:
    """The (role, text) pairs of a formatted example, unescaped."""
    roles, texts = F.regexp_extract_all(formatted, F.lit(_TURN), 1), F.regexp_extract_all(formatted, F.lit(_TURN), 2)
    return F.transform(F.arrays_zip(roles.alias("role"), texts.alias("text")), lambda t: F.struct(
        unescaped(t["role"]).alias("role"), unescaped(t["text"]).alias("text")))


def digests(formatted: DataFrame) -> DataFrame:
    """What reading the examples back gives, for each conversation; see the columns below."""
    target = unescaped(F.expr("substring(formatted, loss_start + 1, loss_end - loss_start)"))
    rows = formatted.select(
        "conv_id", "example", target.alias("target"), F.length("formatted").alias("chars"),
        F.when(F.col("is_last"), F.struct(turns_of(F.col("formatted")).alias("turns"))).alias("all"),
    )
    summed = rows.groupBy("conv_id").agg(
        F.first("all", ignorenulls=True).alias("all"), F.sum("chars").alias("formatted_chars"),
        F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("example", F.coalesce("target", F.lit("")).alias("target")))), lambda t: t["target"]
        ), "").alias("loss"),
    )
    line = F.array_join(F.transform("all.turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return summed.select(
        "conv_id", F.size("all.turns").cast("bigint").alias("n_turns"),
        F.sha2(line.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("bigint").alias("formatted_chars"),
    )
