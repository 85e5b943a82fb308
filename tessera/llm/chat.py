"""Chat formatting as a grammar round trip, in DataFrame functions only.

The grammar: a conversation is a row of turns, and a turn is
``<s>[INST]`` role ``[/INST]`` text ``</s>``, where role and text hold no
control string (``<s>``, ``</s>``, ``[INST]``, ``[/INST]``).  A turn is first
rendered as it is; the deterministic parser reads it back, and where that does
not give the source the content is escaped: a backslash goes behind the
bracket of every control string (and of every string that is one but for
backslashes there), which the parser takes out again.  So no control string
inside a role or a text is ever handed out as it stands.  Whole conversations
are parsed once more and compared with their source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_OPEN, _MID, _CLOSE = "<s>[INST]", "[/INST]", "</s>"
_CONTROL = r"/?(?:s>|INST\])"
_STRICT = rf"[<\[]{_CONTROL}"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*{_CONTROL})", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*{_CONTROL})", "$1$2")


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(_OPEN), role, F.lit(_MID), text, F.lit(_CLOSE))


def parse(formatted: Column) -> Column:
    """array<struct<role, text, rendered>> of a formatted string; what does
    not follow the grammar (a control string within role or text breaks it)
    comes back as a turn with a null role."""
    pieces = F.split(formatted, _CLOSE, -1)

    def turn(piece: Column) -> Column:
        rest = F.substr(piece, F.lit(len(_OPEN) + 1))
        role = F.substring_index(rest, _MID, 1)
        text = F.substr(rest, F.length(role) + F.lit(len(_MID) + 1))
        good = piece.startswith(_OPEN) & rest.contains(_MID) & ~role.rlike(_STRICT) & ~text.rlike(_STRICT)
        return F.struct(F.when(good, unescape(role)).alias("role"), F.when(good, unescape(text)).otherwise(piece).alias("text"), F.concat(piece, F.lit(_CLOSE)).alias("rendered"))

    # what follows the last close must be empty: else it is no turn at all
    whole = F.element_at(pieces, -1) == ""
    return F.transform(F.when(whole, F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces), turn)


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv``, ``formatted string``, ``turns
    array<struct<start, stop, loss_start, loss_stop>>`` (code points in
    ``formatted``; loss bounds are null but for turns of ``learn``) and
    ``identical boolean``, the result of the last round trip.

    Null texts and roles read as empty.  Turns go by ``turn`` (null first),
    then role, then text, so ties have one order; repeated rows stay.  A null
    conversation id is a conversation.  Other columns are not looked at.
    """
    rows = df.select(F.col(f"`{conv}`").alias("__c"), F.col(f"`{turn}`").alias("__t"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("__r"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__x"))
    # Round one, turn by turn: plain, and escaped where plain does not parse back.
    plain = render_turn(F.col("__r"), F.col("__x"))
    back = parse(plain)
    same = (F.size(back) == 1) & (back[0]["role"].eqNullSafe(F.col("__r"))) & (back[0]["text"].eqNullSafe(F.col("__x")))
    # Only content with a bracket can conflict; the others are not parsed.
    risky = F.concat("__r", "__x").rlike(r"[<\[]")
    keep = ~risky | same
    rows = rows.withColumn("__er", F.when(keep, F.col("__r")).otherwise(escape(F.col("__r")))).withColumn("__ex", F.when(keep, F.col("__x")).otherwise(escape(F.col("__x"))))
    rows = rows.withColumn("__s", render_turn(F.col("__er"), F.col("__ex")))
    order = Window.partitionBy("__c").orderBy("__t", "__r", "__x")
    stop = F.sum(F.length("__s")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("__n", F.row_number().over(order)).withColumn("__stop", stop.cast("bigint"))
    tail = F.col("__stop") - len(_CLOSE)
    learned = F.col("__r") == learn
    rows = rows.withColumn("__m", F.struct((F.col("__stop") - F.length("__s")).cast("bigint").alias("start"), F.col("__stop").alias("stop"), F.when(learned, tail - F.length("__ex")).alias("loss_start"), F.when(learned, tail).alias("loss_stop")))
    grouped = rows.groupBy("__c").agg(F.sort_array(F.collect_list(F.struct("__n", "__s", "__m", F.struct("__r", "__x").alias("src")))).alias("all"))
    out = grouped.select(F.col("__c").alias(conv), F.array_join(F.col("all.__s"), "").alias("formatted"), F.col("all.__m").alias("turns"), F.col("all.src").alias("__src"))
    # Round two, on what is handed out.
    again = F.transform(parse(F.col("formatted")), lambda p: F.struct(p["role"].alias("__r"), p["text"].alias("__x")))
    return out.select(conv, "formatted", "turns", (again == F.col("__src")).alias("identical"))


def read_back(df: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The digest of ``format_conversations``, from its output alone: turns
    by the parser, learned text by the loss bounds."""
    parsed = df.select(conv, "formatted", "turns", parse(F.col("formatted")).alias("p"))
    turn_text = F.array_join(F.transform("p", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")

    def learned(t: Column) -> Column:
        at = t["turns"]
        return F.when(at["loss_start"].isNotNull(), unescape(F.substr(t["p"]["rendered"], (at["loss_start"] - at["start"] + 1).cast("int"), (at["loss_stop"] - at["loss_start"]).cast("int")))).otherwise(F.lit(""))

    loss = F.array_join(F.transform(F.arrays_zip(F.col("p"), F.col("turns")), learned), "")
    out = parsed.select(conv, F.size("p").cast("bigint").alias("n_turns"), F.sha2(turn_text.cast("binary"), 256).alias("turns_sha256"), loss.alias("loss"), F.length("formatted").cast("bigint").alias("formatted_chars"))
    return out.select(conv, "n_turns", "turns_sha256", F.length("loss").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
