"""Chat formatting: turns to one training string with a loss mask, natively.

``format_conversations`` sorts the collected turn structs of a conversation,
merges adjacent turns of one role into a block by array expressions, and
concatenates. Everything is a Spark expression.

Template: ``[INST] .. [/INST]`` (user), ``<<SYS>> .. <</SYS>>`` (system),
``<s> .. </s>`` (assistant) and ``<<ROLE>> r <<TEXT>> .. <</ROLE>>`` (any other
role r); turns inside a block are divided by `` <<TURN>> ``. A control string
inside a text gets a backslash after its first character, and a backslash is
doubled, so that ``read_back`` returns exactly the turns that went in.

Defined cases: null role and null text count as empty; rows without conv_id
form one conversation; rows tie on turn by role, then text; a repeated row is
a turn of its own; an empty table gives an empty result; further columns of
the input, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: role -> (opening, closing) of a block; control strings are all that can open, close or divide.
BLOCKS = {"user": ("[INST] ", " [/INST]\n"), "system": ("<<SYS>> ", " <</SYS>>\n"), "assistant": ("<s> ", " </s>\n")}
OTHER = ("<<ROLE>> ", " <<TEXT>> ", " <</ROLE>>\n")
TURN = " <<TURN>> "
CONTROL = ("[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>", "<<ROLE>>", "<</ROLE>>", "<<TEXT>>", "<<TURN>>")

_CONTROL_RE = r"(<|\[)(?=/?s>|</?SYS>>|</?ROLE>>|<TEXT>>|<TURN>>|/?INST\])"
_OPEN_RE = r"(?=\[INST\] |<<SYS>> |<s> |<<ROLE>> )"
_BODY_RE = r"(?s)\A(?:\[INST\] |<<SYS>> |<s> |<<ROLE>> .*? <<TEXT>> )(.*) (?:\[/INST\]|<</SYS>>|</s>|<</ROLE>>)\n\z"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL_RE, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _by_role(role: Column, at: int) -> Column:
    out = F.when(role == "user", BLOCKS["user"][at]).when(role == "system", BLOCKS["system"][at]).when(role == "assistant", BLOCKS["assistant"][at])
    return out.otherwise(F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1])) if at == 0 else F.lit(OTHER[2]))


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, segments: array of (text, loss) whose texts join to ``formatted``."""
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    sorted_turns = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    turns, starts = F.col("turns"), F.col("starts")
    indexed = sorted_turns.withColumn(
        "starts",
        F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"])),
    )
    blocks = indexed.select(
        "conv_id",
        F.transform(
            starts,
            lambda s, j: F.struct(
                F.get(turns, s)["role"].alias("role"),
                F.transform(F.slice(turns, s + 1, F.coalesce(F.get(starts, j + 1), F.size(turns)) - s), lambda t: t["text"]).alias("texts"),
            ),
        ).alias("blocks"),
    )

    def render(block: Column) -> Column:
        body = F.flatten(
            F.transform(
                block["texts"],
                lambda x, i: F.array(
                    _segment(F.when(i > 0, TURN).otherwise(""), F.lit(False)),
                    _segment(escape(x), block["role"] == "assistant"),
                ),
            )
        )
        edge = lambda at: F.array(_segment(_by_role(block["role"], at), F.lit(False)))
        return F.concat(edge(0), body, edge(1))

    segments = blocks.select("conv_id", F.flatten(F.transform("blocks", render)).alias("segments"))
    return segments.select("conv_id", F.array_join(F.col("segments")["text"], "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string: array of (role, text)."""

    def turns_of(piece: Column) -> Column:
        other = unescape(F.regexp_extract(piece, r"(?s)\A<<ROLE>> (.*?) <<TEXT>> ", 1))
        role = F.when(piece.startswith("[INST] "), "user").when(piece.startswith("<<SYS>> "), "system").when(piece.startswith("<s> "), "assistant").otherwise(other)
        body = F.regexp_extract(piece, _BODY_RE, 1)
        return F.transform(F.split(body, TURN, -1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(F.split(formatted, _OPEN_RE, -1), turns_of))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, and of conversation -7 of control strings only, read back from the formatted strings."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = F.lit("</s>[INST] ok [/INST]")
    roles = F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role")))
    extra = spark.range(1).select(F.explode(roles).alias("r")).select(F.lit(-7).cast("long").alias("conv_id"), F.col("r.turn").cast("long").alias("turn"), "r.role", odd.alias("text"))
    out = format_conversations(rows.unionByName(extra))
    masked = F.filter("segments", lambda s: s["loss"])
    read = out.select(
        "conv_id",
        read_back(F.col("formatted")).alias("turns"),
        F.array_join(F.transform(masked, lambda s: unescape(s["text"])), "").alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def _escaped_sql(x: str) -> str:
    x = f"replace({x}, '\\', '\\\\')"
    for c in CONTROL:
        x = f"replace({x}, '{c}', '{c[0]}\\{c[1:]}')"
    return x


def _edges_sql(role: str) -> str:
    known = " ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b) in BLOCKS.items())
    return f"CASE {role} {known} ELSE {sum(map(len, OTHER))} + length({_escaped_sql(role)}) END"


SQL_CHAT = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_escaped_sql('text')}) + CASE WHEN before = role THEN {len(TURN)} ELSE {_edges_sql('role')} END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""
