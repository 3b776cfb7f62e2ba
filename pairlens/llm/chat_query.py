"""op3: every conversation in one template, read back from the formatted text."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from .chat import Template, format_chats, masked_text
from .registry import query, table

MESSAGES = "array<struct<role:string,content:string>>"
VALUES = "array<struct<`from`:string,value:string>>"

SQL = r"""
WITH lines AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
  SELECT *, length(role) + length(text) + length('<s>[INST][/INST]</s>')
    + (length(role || text) - length(replace(role || text, '\', '')))
    - 1 * ((length(role || text) - length(replace(role || text, '<s>', ''))) // 3)
    - 2 * ((length(role || text) - length(replace(role || text, '</s>', ''))) // 4)
    - 4 * ((length(role || text) - length(replace(role || text, '[INST]', ''))) // 6)
    - 5 * ((length(role || text) - length(replace(role || text, '[/INST]', ''))) // 7) AS chars
  FROM lines)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


def as_records(lines: DataFrame) -> DataFrame:
    """One nested record per conversation, in the layout that its kind of conversation is usually published in.

    Exchanges of one prompt and one answer become prompt and response fields, with their system
    text if they have one; chats between only a user and an assistant that go on longer become
    from / value lists in every second conversation; all others are message lists.  Rows of a
    conversation are ordered by turn, ties by role and text.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = lines.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    roles = F.col("t.role")
    with_system = roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    single = (roles == F.array(F.lit("user"), F.lit("assistant"))) | with_system
    plain = F.forall(roles, lambda r: r.isin("user", "assistant"))
    values = ~single & plain & (F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(2)) == 1)
    n = F.size("t")
    record = F.struct(
        F.when(with_system, F.col("t")[0]["text"]).alias("system"),
        F.when(single, F.element_at("t", n - 1)["text"]).alias("prompt"),
        F.when(single, F.element_at("t", n)["text"]).alias("response"),
        F.when(values, F.transform("t", lambda x: F.struct(F.when(x["role"] == "user", F.lit("human")).otherwise(F.lit("gpt")), x["text"])).cast(VALUES)).alias("conversations"),
        F.when(~single & ~values, F.transform("t", lambda x: F.struct(x["role"], x["text"])).cast(MESSAGES)).alias("messages"),
    )
    return chats.select("conv_id", record.alias("record"))


@query("op3_chat_format", SQL)
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    lines = lines.union(spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], lines.schema))
    template = Template()
    made = format_chats(as_records(lines), ["conv_id"], template=template)
    read = made.select(
        "conv_id",
        template.parse(F.col("formatted")).alias("turns"),
        masked_text(F.col("formatted"), F.col("loss_spans"), template).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
