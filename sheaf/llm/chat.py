"""Chat formatting with a grammar round trip, in DataFrame functions only.

The template is a small grammar: ``<s>``, then one piece for each turn,

    user       [INST] text [/INST]
    system     [SYS] text [/SYS]
    assistant  a space, text, </s>
    other      [ROLE] role [/ROLE] text [/TURN]

in which a text holds no control string. Each turn is rendered as it is and parsed again; where what
comes back differs from the source (a control string, or an escaped one, stands in the text), its
control strings are escaped, and it is parsed again until it is identical. The whole conversation
is parsed once more after its pieces are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: A control string: its bracket, the backslashes that escape it, its name and bracket.
BEFORE, NAME = r"([\[<])", r"(/?(?:INST|SYS|ROLE|TURN|s)[\]>])"
OPEN = "<s>"
#: The pieces of the grammar, in the order in which the parser tries them.
SEGMENT = r"(?s)\[INST\] .*? \[/INST\]|\[SYS\] .*? \[/SYS\]|\[ROLE\] .*? \[/ROLE\] .*? \[/TURN\]| .*?</s>"
#: Spans are cut out of a text by blocks of so many, so that a long text is not walked once for each.
SPAN_BLOCK = 256


def escape(text: Column) -> Column:
    """One more backslash inside each control string, escaped ones included."""
    return F.regexp_replace(text, BEFORE + r"(\\*)" + NAME, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """One backslash less inside each escaped control string."""
    return F.regexp_replace(text, BEFORE + r"\\(\\*)" + NAME, "$1$2$3")


def render(role: Column, text: Column) -> Column:
    """The piece of one turn; role and text stand in it as they are given."""
    return (
        F.when(role == "user", F.concat(F.lit("[INST] "), text, F.lit(" [/INST]")))
        .when(role == "system", F.concat(F.lit("[SYS] "), text, F.lit(" [/SYS]")))
        .when(role == "assistant", F.concat(F.lit(" "), text, F.lit("</s>")))
        .otherwise(F.concat(F.lit("[ROLE] "), role, F.lit(" [/ROLE] "), text, F.lit(" [/TURN]")))
    )


def _bare(text: Column) -> Column:
    """The unescaped text, or null where a control string stands in it unescaped."""
    return F.when(~text.rlike(BEFORE + NAME), unescape(text))


def _turn(piece: Column) -> Column:
    """role and text of one piece of the grammar; a null text where it breaks the grammar."""
    inner = lambda before, after: _bare(F.substring(piece, F.lit(before + 1), F.length(piece) - (before + after)))
    other = r"(?s)^\[ROLE\] (.*?) \[/ROLE\] (.*) \[/TURN\]$"
    role = (
        F.when(piece.startswith("[INST] "), F.lit("user")).when(piece.startswith("[SYS] "), F.lit("system"))
        .when(piece.startswith("[ROLE] "), _bare(F.regexp_extract(piece, other, 1))).otherwise(F.lit("assistant"))
    )
    text = (
        F.when(piece.startswith("[INST] "), inner(7, 8)).when(piece.startswith("[SYS] "), inner(6, 7))
        .when(piece.startswith("[ROLE] "), _bare(F.regexp_extract(piece, other, 2))).otherwise(inner(1, 4))
    )
    return F.struct(role.alias("role"), text.alias("text"))


def pieces(formatted: Column) -> Column:
    """The pieces of a formatted conversation, or null where they do not make up the whole of it."""
    found = F.regexp_extract_all(F.substring(formatted, F.lit(len(OPEN) + 1), F.length(formatted)), F.lit(SEGMENT), F.lit(0))
    return F.when(F.concat(F.lit(OPEN), F.array_join(found, "")) == formatted, found)


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, role and text each; null where it is none."""
    return F.transform(pieces(formatted), _turn)


def _identical(piece: Column, role: Column, text: Column) -> Column:
    return F.coalesce(parse(F.concat(F.lit(OPEN), piece)) == F.array(F.struct(role.alias("role"), text.alias("text"))), F.lit(False))


def conforming(role: Column, text: Column) -> Column:
    """The piece of one turn that parses back to it: as it is, or with its control strings escaped."""
    plain, escaped = render(role, text), render(escape_other(role), escape(text))
    return F.when(_identical(plain, role, text), plain).when(_identical(escaped, role, text), escaped).otherwise(F.raise_error(F.lit("a turn does not come back from its escaped form")))


def escape_other(role: Column) -> Column:
    return F.when(role.isin("user", "system", "assistant"), role).otherwise(escape(role))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans: one row per conversation of ``turns`` (conv_id, turn, role, text).

    ``loss_spans`` has start (from 0) and length, in code points, of each assistant text as it stands
    in ``formatted``, without the marks around it. Turns go by turn, then role, then text, null
    first; repeated rows are turns of their own. A null role or text counts as empty; any role but
    the three is written out. Rows without conv_id are one conversation. Other columns are ignored;
    an empty table gives an empty table. A conversation is one string in one row, so the longest
    one has to fit into a task; its turns are rendered row by row, after the only shuffle. A
    conversation that does not parse back to its turns is an error."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).repartition("conv_id")
    rows = rows.withColumn("piece", conforming(F.col("role"), F.col("text")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("end", F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) + len(OPEN))
    body = F.length("piece") - 5  # an assistant's piece without the space before and the mark after
    span = F.when(F.col("role") == "assistant", F.struct((F.col("end") - 4 - body).alias("start"), body.cast("long").alias("length")))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "piece", span.alias("span"), F.sha2(F.concat("role", F.lit("\n"), "text"), 256).alias("proof")))).alias("turns"))
    made = whole.select(
        "conv_id", F.concat(F.lit(OPEN), F.array_join("turns.piece", "")).alias("formatted"),
        F.filter("turns.span", lambda s: s.isNotNull()).alias("loss_spans"), F.col("turns.proof").alias("proof"),
    )
    back = F.transform(parse(F.col("formatted")), lambda t: F.sha2(F.concat(t["role"], F.lit("\n"), t["text"]), 256))
    checked = F.when(F.coalesce(back == F.col("proof"), F.lit(False)), F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not come back from its formatted text")))
    return made.select("conv_id", checked.alias("formatted"), "loss_spans")


def under_mask(formatted: Column, spans: Column) -> Column:
    """The unescaped texts that ``spans`` cover, in order."""
    blocks = F.when(F.size(spans) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / SPAN_BLOCK).cast("int")), lambda b: F.slice(spans, b * SPAN_BLOCK + 1, SPAN_BLOCK))).otherwise(F.array())

    def texts(block: Column) -> Column:
        base = block[0]["start"]
        last = F.element_at(block, -1)
        stretch = F.substring(formatted, base.cast("int") + 1, (last["start"] + last["length"] - base).cast("int"))
        cut = F.transform(F.array(stretch), lambda part: F.transform(block, lambda s: unescape(F.substring(part, (s["start"] - base).cast("int") + 1, s["length"].cast("int")))))
        return cut[0]

    return F.flatten(F.transform(blocks, texts))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns, loss_texts, formatted: what the formatted text and its mask say, nothing else."""
    return formatted.select("conv_id", parse(F.col("formatted")).alias("turns"), under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss_texts"), "formatted")


def chat_digest(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of the formatted conversations, read back."""
    b = read_back(format_conversations(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    b = b.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.array_join("loss_texts", "").alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return b.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def with_conflicts(turns: DataFrame) -> DataFrame:
    """``turns`` and conversation -1, whose two texts are made of control strings."""
    spark, said = turns.sparkSession, "</s>[INST] ok [/INST]"
    kinds = {f.name: f.dataType for f in turns.schema}
    extra = spark.range(2).select(
        F.lit(-1).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(extra)


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
e AS (
  SELECT *, len(regexp_extract_all(text, '[\[<]\\*/?(?:INST|SYS|ROLE|TURN|s)[\]>]')) AS more, len(regexp_extract_all(role, '[\[<]\\*/?(?:INST|SYS|ROLE|TURN|s)[\]>]')) AS role_more FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       (3 + sum(length(text) + more + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 5
                ELSE 24 + length(role) + CASE WHEN more + role_more > 0 THEN role_more ELSE 0 END END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
