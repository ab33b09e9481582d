"""Chat formatting: a declarative template and a finite-state machine over roles, in built-in column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What marks a turn, and how control strings inside texts are written. The escape sequences are a backslash and one letter;
#: escaped texts have no other backslash and no character that a mark begins with, so reading back is unambiguous.
TEMPLATE = {
    "open": "### ",
    "after_role": ": ",
    "close": "</turn>\n",
    "escapes": [("\\", "\\b"), ("#", "\\h"), ("<", "\\l")],
    "role_escapes": [(":", "\\c")],
    "loss_roles": ["assistant"],
}

#: (state, role) -> state. Anything else leads to DEAD. A conversation is in order if it ends in one of ACCEPT.
STATES = ["start", "system", "user", "assistant", "dead"]
MOVES = {
    ("start", "system"): "system",
    ("start", "user"): "user",
    ("system", "user"): "user",
    ("user", "assistant"): "assistant",
    ("assistant", "user"): "user",
}
ACCEPT = ["user", "assistant"]

#: Turns of a conversation are put together in blocks of so many first, then the blocks, so that a very long
#: conversation is formatted by many tasks.
BLOCK = 64


def _swap(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape(text: Column, template: dict = TEMPLATE) -> Column:
    return _swap(text, template["escapes"])


def unescape(text: Column, template: dict = TEMPLATE) -> Column:
    """The inverse of escape(): the backslash itself last."""
    return _swap(text, [(b, a) for a, b in reversed(template["escapes"])])


def _step(state: Column, role: Column) -> Column:
    """The number of the state after a turn of that role."""
    out = None
    for (s, r), to in MOVES.items():
        hit = (state == STATES.index(s)) & (role == r)
        out = F.when(hit, STATES.index(to)) if out is None else out.when(hit, STATES.index(to))
    return out.otherwise(STATES.index("dead"))


def format_conversations(turns: DataFrame, template: dict = TEMPLATE, block: int = BLOCK) -> DataFrame:
    """(conv_id, n_turns long, in_order boolean, segments array<struct<text string, loss boolean>>) per conversation.

    turns has conv_id, turn, role and text; other columns are ignored. Turns follow by turn, then role and text where it ties, and all
    rows count, repeated ones too. A null turn comes first, a null role or text is empty, rows without conv_id form one
    conversation. Segments alternate: a mark with the role, the escaped text, a closing mark; only texts of loss roles carry loss. The text of
    a conversation is its segments joined. Turn order is checked by composing, per block, what each state becomes, so blocks are
    checked apart. An empty table gives an empty one.
    """
    t = template
    rows = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = rows.withColumn("block", F.expr(f"turn div {block}"))
    name = lambda r: _swap(escape(r, t), t["role_escapes"])
    mark = lambda r: F.concat(F.lit(t["open"]), name(r), F.lit(t["after_role"]))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    of_turn = lambda x: F.array(
        segment(mark(x["role"]), F.lit(False)),
        segment(escape(x["text"], t), x["role"].isin(*t["loss_roles"])),
        segment(F.lit(t["close"]), F.lit(False)),
    )
    blocks = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    start = F.array(*[F.lit(k) for k in range(len(STATES))])
    becomes = F.aggregate("turns", start, lambda acc, x: F.transform(acc, lambda s: _step(s, x["role"])))
    blocks = blocks.select(
        "conv_id", F.struct("block", F.size("turns").cast("long").alias("n"), becomes.alias("becomes"), F.flatten(F.transform("turns", of_turn)).alias("segments")).alias("part")
    )
    whole = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    last = F.aggregate("parts", F.lit(STATES.index("start")), lambda s, p: F.get(p["becomes"], s))
    return whole.select(
        "conv_id",
        F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["n"]).alias("n_turns"),
        last.isin(*[STATES.index(s) for s in ACCEPT]).alias("in_order"),
        F.flatten(F.transform("parts", lambda p: p["segments"])).alias("segments"),
    )


def read_turns(formatted: Column, template: dict = TEMPLATE) -> Column:
    """The turns of a formatted text as array<struct<role, text>>, escapes undone."""
    t = template
    parts = F.split(formatted, "\\Q" + t["close"] + "\\E")
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def one(p: Column) -> Column:
        body = F.substring(p, len(t["open"]) + 1, 2**31 - 1)
        at = F.instr(body, t["after_role"])
        role = unescape(_swap(F.substring(body, F.lit(1), at - 1), [(b, a) for a, b in t["role_escapes"]]), t)
        text = F.substring(body, at + len(t["after_role"]), F.lit(2**31 - 1))
        return F.struct(role.alias("role"), unescape(text, t).alias("text"))

    return F.transform(parts, one)


def digests(formatted: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, in_order, all read back from the segments."""
    df = formatted.withColumn("whole", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    df = df.withColumn("turns", read_turns(F.col("whole"), template))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
    df = df.withColumn("loss", loss)
    return df.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("whole").cast("long").alias("formatted_chars"),
        "in_order",
    )


#: DuckDB SQL for digests() of all conversations and conversation -7, computed from the turns themselves.
ORACLE = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    length(text) + length(text) - length(replace(replace(replace(text, '\\', ''), '#', ''), '<', ''))
    + length(role) + length(role) - length(replace(replace(replace(replace(role, '\\', ''), '#', ''), '<', ''), ':', '')) + 14 AS marked_chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(marked_chars) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before IN ('system', 'assistant') THEN role = 'user'
    WHEN before = 'user' THEN role = 'assistant' ELSE false END)
    AND max_by(role, struct_pack(a := coalesce(turn, -1), b := role, c := text)) <> 'system' AS in_order
FROM marked GROUP BY conv_id
"""
