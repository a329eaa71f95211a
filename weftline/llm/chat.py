"""Chat formatting with a grammar round trip.

    formatted := OPEN[level] turn*          turn := "[INST]" role "[/INST]" text "</s>"

Level 0 writes texts as they are; only conversations without any control string in a text or role are rendered so. Level 1
replaces every opening character of a control string and the escape character itself, so that the only control strings of
a formatted text are the template's. A deterministic parser reads the result back; where level 0 gives anything but what
went in, level 1 is taken, and a level 1 that does not read back identically is an error. The opening names the level, so
that reading needs nothing else. Offsets are prefix sums in blocks, and texts are cut by chunks: time is linear in a text.

Defined results: a null text or role is empty; turns go by turn (null first), then role, then text, and repeated rows
stay; rows without conv_id form one conversation; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cutter, let, plain_columns, prefix_sums, table

OPEN = ("<s>", "<s+>")
HEAD, HEAD_END, TURN_END = "[INST]", "[/INST]", "</s>"
CONTROLS = (*OPEN, HEAD, HEAD_END, TURN_END)
#: Escapes: no control string can stand in a text without "<" and "[".
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))


def escape(x: Column) -> Column:
    for a, b in ESCAPES:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def unescape(x: Column) -> Column:
    for a, b in reversed(ESCAPES):
        x = F.replace(x, F.lit(b), F.lit(a))
    return x


def render(turns: Column, level: int) -> Column:
    """The formatted text of an array of (role, text)."""
    put = escape if level else (lambda x: x)
    return F.concat(
        F.lit(OPEN[level]),
        F.array_join(F.transform(turns, lambda t: F.concat(F.lit(HEAD), put(t["role"]), F.lit(HEAD_END), put(t["text"]), F.lit(TURN_END))), ""),
    )


def parse(formatted: Column) -> Column:
    """What the parser reads: an array of (role, text, start, length); start and length are the text's span in the formatted
    text, in characters. Null where the grammar doesn't hold."""
    escaped = formatted.startswith(OPEN[1])
    opening = F.when(escaped, len(OPEN[1])).otherwise(len(OPEN[0]))
    pieces = F.split(F.substring(formatted, opening + 1, F.length(formatted)), TURN_END)

    def read(ps: Column) -> Column:
        bodies = F.slice(ps, F.lit(1), F.size(ps) - 1)
        starts = prefix_sums(F.transform(bodies, lambda p: F.length(p) + len(TURN_END)), opening)

        def turn(p: Column, at: Column) -> Column:
            end = F.instr(p, HEAD_END)
            text = F.substring(p, end + len(HEAD_END), F.length(p))
            back = lambda x: F.when(escaped, unescape(x)).otherwise(x)
            return F.struct(
                back(F.substring(p, F.lit(len(HEAD) + 1), end - 1 - len(HEAD))).alias("role"),
                back(text).alias("text"),
                (at + end - 1 + len(HEAD_END)).cast("long").alias("start"),
                F.length(text).cast("long").alias("length"),
            )

        good = (F.get(ps, F.size(ps) - 1) == "") & F.forall(bodies, lambda p: p.startswith(HEAD) & (F.instr(p, HEAD_END) > len(HEAD)))
        return F.when(good, F.zip_with(bodies, starts, turn))

    return F.when(escaped | formatted.startswith(OPEN[0]), let(pieces, read))


def format_chats(rows: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, turns (as given), formatted, level, and parsed (as read back from formatted)."""
    rows = plain_columns(rows, ["conv_id", "turn", "role", "text"])
    filled = rows.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    chats = filled.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    plain = chats.withColumn("plain", render(F.col("turns"), 0))
    controlled = lambda x: reduce(or_, [F.contains(x, F.lit(c)) for c in CONTROLS])
    hard = F.exists("turns", lambda t: controlled(t["text"]) | controlled(t["role"]))
    same = lambda parsed: F.transform(parsed, lambda p: F.struct(p["role"], p["text"])).eqNullSafe(F.transform(F.col("turns"), lambda t: F.struct(t["role"], t["text"])))
    level = F.when(~hard & same(parse(F.col("plain"))), 0).otherwise(1)
    done = plain.withColumn("level", level).withColumn("formatted", F.when(F.col("level") == 0, F.col("plain")).otherwise(render(F.col("turns"), 1)))
    done = done.withColumn("parsed", parse(F.col("formatted")))
    bad = F.raise_error(F.lit("a formatted conversation does not read back as it was")).cast("string")
    return done.withColumn("formatted", F.when(same(F.col("parsed")), F.col("formatted")).otherwise(bad)).drop("plain")


def loss_text(formatted: Column, parsed: Column) -> Column:
    """All text under the loss mask (assistant turns), cut from the formatted text by span and unescaped."""
    spans = F.filter(parsed, lambda p: p["role"] == "assistant")
    back = lambda x: F.when(formatted.startswith(OPEN[1]), unescape(x)).otherwise(x)
    return cutter(formatted, lambda cut: F.array_join(F.transform(spans, lambda p: back(cut(p["start"], p["length"]))), ""))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    hard = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    rows = plain_columns(table(spark, sf_dir, "conversations"), ["conv_id", "turn", "role", "text"]).unionByName(hard)
    out = format_chats(rows)
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    loss = loss_text(F.col("formatted"), F.col("parsed"))
    return out.withColumn("__loss", loss).select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        digest(F.array_join(F.transform("parsed", lambda p: F.concat(p["role"], F.lit("\n"), p["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"),
        digest(F.col("__loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def sql() -> str:
    def put(x: str) -> str:
        for a, b in ESCAPES:
            x = f"replace({x}, '{a}', '{b}')"
        return x

    return rf"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
g AS (SELECT conv_id, count(*)::BIGINT AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
  bool_or({' OR '.join(f"contains({x}, '{c}')" for x in ('text', 'role') for c in CONTROLS)}) AS hard,
  sum(length(role) + length(text) + {len(HEAD + HEAD_END + TURN_END)})::BIGINT AS plain_chars,
  sum(length({put('role')}) + length({put('text')}) + {len(HEAD + HEAD_END + TURN_END)})::BIGINT AS escaped_chars
  FROM r GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  CASE WHEN hard THEN {len(OPEN[1])} + escaped_chars ELSE {len(OPEN[0])} + plain_chars END AS formatted_chars FROM g"""
