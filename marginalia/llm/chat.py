"""Chat formatting with Spark expressions only.

Template: each run of adjacent turns of one role becomes one block
    <|start|>role<|text|>first<|and|>second<|end|>\\n
Control strings are the only places where `<|` stands unescaped: in roles and texts a backslash
goes before each backslash and between `<` and `|`, so every output can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, TEXT, AND, END = "<|start|>", "<|text|>", "<|and|>", "<|end|>\n"
TRAINED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv, formatted string, loss_spans array<struct<start,length>>.

    loss_spans are code point ranges (from 0) of formatted: one for each turn of the trained role,
    without the marks around it. Turns are ordered by number, then role, then text; nulls come first, so
    ties and repeated rows have a fixed order and each stays. Null role or text: empty. A null
    conv is a conversation of its own. No rows: no conversations. Other columns are not read.
    """
    raw = turns.select(
        F.col(conv).alias("__conv"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("__t"),
    )
    ordered = raw.groupBy("__conv").agg(F.sort_array(F.collect_list("__t")).alias("__ts"))

    def piece(t: Column, i: Column) -> Column:
        ts = F.col("__ts")
        opens = (i == 0) | (F.get(ts, i - 1)["role"] != t["role"])
        closes = (i == F.size(ts) - 1) | (F.get(ts, i + 1)["role"] != t["role"])
        return F.struct(
            F.when(opens, F.concat(F.lit(START), escaped(t["role"]), F.lit(TEXT))).otherwise(F.lit(AND)).alias("head"),
            escaped(t["text"]).alias("body"),
            F.when(closes, F.lit(END)).otherwise(F.lit("")).alias("tail"),
            (t["role"] == TRAINED_ROLE).alias("loss"),
        )

    pieces = ordered.select("__conv", F.posexplode(F.transform("__ts", piece)).alias("__i", "__p"))
    whole = F.concat("__p.head", "__p.body", "__p.tail")
    ahead = Window.partitionBy("__conv").orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length(whole)).over(ahead), F.lit(0)) + F.char_length("__p.head")
    placed = pieces.select(
        "__conv",
        F.struct(F.col("__i").alias("i"), whole.alias("whole"), F.col("__p.loss").alias("loss"), F.struct(start.cast("long").alias("start"), F.char_length("__p.body").cast("long").alias("length")).alias("span")).alias("__x"),
    )
    done = placed.groupBy("__conv").agg(F.sort_array(F.collect_list("__x")).alias("__xs"))
    return done.select(
        F.col("__conv").alias(conv),
        F.array_join(F.transform("__xs", lambda x: x["whole"]), "").alias("formatted"),
        F.transform(F.filter("__xs", lambda x: x["loss"]), lambda x: x["span"]).alias("loss_spans"),
    )


def parse_chats(formatted: Column) -> Column:
    """array<struct<role,text>> of the turns in a formatted string: the inverse of format_chats."""
    blocks = F.filter(F.split(formatted, r"<\|start\|>"), lambda b: b != "")

    def block(b: Column) -> Column:
        inside = F.substring(b, F.lit(1), F.char_length(b) - len(END))
        parts = F.split(inside, r"<\|text\|>", 2)
        return F.transform(F.split(F.element_at(parts, 2), r"<\|and\|>"), lambda t: F.struct(unescaped(F.element_at(parts, 1)).alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, block))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def op4_chat_formatting(conversations: DataFrame) -> DataFrame:
    """Digests read back from the formatted conversations and from conversation -1, whose texts hold control strings."""
    spark = conversations.sparkSession
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("t"))
    every = conversations.select("conv_id", "turn", "role", "text").unionByName(extra.select("conv_id", "t.turn", "t.role", "t.text"))
    read = format_chats(every).withColumns({"turns": parse_chats(F.col("formatted")), "loss": masked_text(F.col("formatted"), F.col("loss_spans"))})
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql() -> str:
    esc = "replace(replace({}, '\\', '\\\\'), '<|', '<\\|')"
    return f"""
    WITH every AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
    runs AS (
      SELECT *, coalesce(lag(role) OVER w <> role, true) AS opens FROM every
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::bigint AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
      sum(length({esc.format('text')}) + CASE WHEN opens THEN {len(START + TEXT + END)} + length({esc.format('role')}) ELSE {len(AND)} END)::bigint AS formatted_chars
    FROM runs GROUP BY conv_id"""


OP4_SQL = _sql()
