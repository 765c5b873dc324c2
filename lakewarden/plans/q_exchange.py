"""Queries over chats, tools, uploads and agents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.operators import obligations as O
from lakewarden.operators import redact, scan
from lakewarden.plans import derived
from lakewarden.plans.registry import query
from lakewarden.sources import exchange

#: One tool per part: names of several shapes, annotations of every kind.
_TOOLS = """select p_partkey,
  case p_partkey % 10 when 0 then 'list_and_delete_rows' when 1 then concat('getItem', cast(p_partkey as string)) when 2 then 'Update-Row'
    when 3 then 'frobnicate' when 4 then ' ' when 5 then 'arxiv-get_paper' when 6 then 'git_reset' when 7 then 'SHELL run' when 8 then 'researcher' else 'post_message' end as name,
  p_name as description,
  case p_partkey % 7 when 0 then '{{"readOnlyHint":true}}' when 1 then '{{"readOnlyHint":false,"openWorldHint":true}}' when 2 then '{{"destructiveHint":true,"readOnlyHint":true}}'
    when 3 then '{{"destructiveHint":false,"idempotentHint":true}}' when 4 then '{{"action":"Write"}}' when 5 then '{{}}' end as notes,
  case when p_partkey % 2 = 0 then '{{"type":"object","properties":{{"path":{{}},"a":{{"type":"string"}}}}}}' end as input_schema
  from {part}"""
_GUESS = "case p_partkey % 10 when 0 then 'delete' when 1 then 'read' when 2 then 'write' when 3 then 'execute' when 4 then 'execute' when 5 then 'read' when 6 then 'execute' when 7 then 'execute' when 8 then 'execute' else 'write' end"
_SAID = "case p_partkey % 7 when 0 then 'read' when 1 then 'write' when 2 then 'delete' when 4 then 'Write' end"


def _tools(spark: SparkSession, sf: str) -> DataFrame:
    rows = derived.run(spark, sf, _TOOLS)
    return rows.withColumn("annotations", F.try_parse_json("notes")).withColumn("input_schema", F.try_parse_json("input_schema"))


@query("infer_action", f"select p_partkey, {_GUESS} as by_name, coalesce(case p_partkey % 5 when 0 then 'delete' when 1 then null when 2 then null else null end, {_GUESS}) as with_declared from {{part}}")
def infer_action(spark: SparkSession, sf: str) -> DataFrame:
    """The first known prefix any word of a tool name starts with; a known declared action wins."""
    said = F.when(F.col("p_partkey") % 5 == 0, " Delete ").when(F.col("p_partkey") % 5 == 1, "maybe")
    rows = _tools(spark, sf)
    return rows.select(
        "p_partkey",
        exchange.infer_action(F.col("name")).alias("by_name"),
        exchange.infer_action(F.col("name"), said).alias("with_declared"),
    )


@query("declared_action", f"select p_partkey, {_SAID} as declared from {{part}}")
def declared_action(spark: SparkSession, sf: str) -> DataFrame:
    """What annotations say, the restrictive reading first."""
    return _tools(spark, sf).select("p_partkey", exchange.declared_action(F.col("annotations")).alias("declared"))


@query(
    "tool_assets",
    f"with t as (select p_partkey, p_partkey % 7 as k, {_GUESS} as guess, {_SAID} as said from {{part}} where p_partkey % 10 <> 4), a as (select *, coalesce(lower(said), guess) as action from t)"
    " select p_partkey, action, case when said is null then 'inferred' else 'declared' end as action_source, case k when 2 then true when 3 then false else action in ('write', 'delete', 'execute') end as destructive,"
    " case k when 0 then true when 1 then false when 2 then true end as read_only, case when k = 1 then true end as open_world, case when k = 3 then true end as idempotent,"
    " k in (0, 1, 2, 3, 4) as annotated, case when p_partkey % 2 = 0 then 'a,path' else '' end as parameters from a",
)
def tool_assets(spark: SparkSession, sf: str) -> DataFrame:
    """A tool listing as assets: nameless tools dropped, guesses told from declarations."""
    rows = _tools(spark, sf).withColumn("description", F.col("p_partkey").cast("string"))
    out = exchange.tool_assets(rows, F.lit("srv"))
    return out.select(
        F.col("description").cast("bigint").alias("p_partkey"),
        "action",
        "action_source",
        "destructive",
        "read_only",
        "open_world",
        "idempotent",
        "annotated",
        F.array_join("parameters", ",").alias("parameters"),
    )


@query(
    "tool_requests",
    "select event_id || '/invoke' as request_id, 'agent:' || user_id as principal_id, case event_type when 'view' then 'execute' when 'purchase' then 'execute' else 'execute' end as action, 'mcp://srv/' || event_type as urn, 'invoke' as direction, props as payload from {events}"
    " union all select event_id || '/result', 'agent:' || user_id, 'return', 'mcp://srv/' || event_type, 'result', cast(value as varchar) from {events}",
)
def tool_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every tool call as two requests: the call, and the return of its result."""
    calls = derived.table(spark, sf, "events").select(
        F.col("event_id").alias("call_id"),
        F.lit("srv").alias("server"),
        F.col("event_type").alias("tool"),
        F.concat(F.lit("agent:"), F.col("user_id").cast("string")).alias("agent_id"),
        F.lit(None).cast("string").alias("declared"),
        F.lit("c1").alias("conversation_id"),
        F.col("props").alias("arguments"),
        F.col("value").cast("string").alias("result"),
    )
    out = exchange.tool_requests(calls)
    direction = F.try_variant_get(F.try_element_at("context", F.lit("direction")), "$", "string")
    return out.select(
        "request_id", F.col("principal.id").alias("principal_id"), "action", F.col("resource.urn").alias("urn"), direction.alias("direction"), "payload"
    )


_ENDPOINT = "case conv_id % 4 when 0 then 'OpenAI' when 1 then 'local' when 2 then 'bedrock' else 'custom' end"


@query(
    "chat_requests",
    f"select conv_id || '/' || turn as request_id, case when role = 'assistant' then 'agent:a' || conv_id else 'user:' || conv_id end as principal_id, case when role = 'assistant' then 'agent' else 'user' end as type,"
    f" 'model://' || {_ENDPOINT} || '/m1' as urn, case when conv_id % 4 in (0, 2) then 'external' else 'internal' end as destination, length(text) as size from {{conversations}}",
)
def chat_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Chat turns as inference requests; known vendors count as external."""
    turns = derived.run(spark, sf, f"select conv_id, turn, role, text, {_ENDPOINT} as endpoint from {{conversations}}").select(
        "conv_id",
        "turn",
        F.col("conv_id").cast("string").alias("user_id"),
        F.when(F.col("role") == "assistant", F.concat(F.lit("a"), F.col("conv_id").cast("string"))).alias("agent_id"),
        F.col("conv_id").cast("string").alias("conversation_id"),
        "endpoint",
        F.lit("m1").alias("model"),
        "text",
        F.array(F.lit("f1")).alias("attachments"),
    )
    out = exchange.chat_requests(turns, F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return out.select(
        "request_id",
        F.col("principal.id").alias("principal_id"),
        "principal.type",
        F.col("resource.urn").alias("urn"),
        F.try_variant_get(F.try_element_at("context", F.lit("destination")), "$", "string").alias("destination"),
        F.length("payload").alias("size"),
    )


@query(
    "upload_assets",
    "select 'librechat://main/files/' || doc_id as urn, source || '.txt' as name, 'user' || doc_id % 7 as owner, 'Uploaded to LibreChat by user' || doc_id % 7 || '.' as description, n_chars as size_bytes, false as classified from {documents}",
)
def upload_assets(spark: SparkSession, sf: str) -> DataFrame:
    files = derived.table(spark, sf, "documents").select(
        F.col("doc_id").alias("file_id"),
        F.concat("source", F.lit(".txt")).alias("filename"),
        F.concat(F.lit("user"), (F.col("doc_id") % 7).cast("string")).alias("uploaded_by"),
        F.lit("text/plain").alias("content_type"),
        F.col("n_chars").alias("size_bytes"),
    )
    return exchange.upload_assets(files, "main").select("urn", "name", "owner", "description", "size_bytes", "classified")


@query(
    "agent_assets",
    "with a as (select s_suppkey, case s_suppkey % 3 when 0 then 'a' || s_suppkey when 1 then 'b' || s_suppkey else '' end as agent_id, case when s_suppkey % 2 = 0 then s_name end as n from {supplier})"
    " select 'librechat://main/agents/' || agent_id as urn, coalesce(n, agent_id) as name from a where agent_id <> ''",
)
def agent_assets(spark: SparkSession, sf: str) -> DataFrame:
    """Agents under either id field; without one, no asset."""
    k = F.col("s_suppkey")
    agents = derived.table(spark, sf, "supplier").select(
        F.when(k % 3 == 0, F.concat(F.lit("a"), k.cast("string"))).alias("id"),
        F.when(k % 3 == 1, F.concat(F.lit("b"), k.cast("string"))).otherwise(" ").alias("_id"),
        F.when(k % 2 == 0, F.col("s_name")).alias("name"),
        F.lit("me").alias("author"),
        F.lit("p").alias("provider"),
        F.lit("m").alias("model"),
        F.lit(None).cast("array<string>").alias("tools"),
    )
    return exchange.agent_assets(agents, "main").select("urn", "name")


@query(
    "flatten_messages",
    "select conv_id, string_agg(text, chr(10) || chr(10) order by turn) as text, count(*) as messages from {conversations} where text <> '' group by 1",
)
def flatten_messages(spark: SparkSession, sf: str) -> DataFrame:
    """One text per conversation, a blank line between messages."""
    flat = exchange.flatten_messages(derived.table(spark, sf, "conversations"), "conv_id", "turn", "text")
    return flat.select("conv_id", "text", F.size("turns").cast("bigint").alias("messages"))


#: Three messages a conversation, with blank lines and line ends of their own, an address in most.
_LETTERS = (
    "select cast(floor(c_custkey / 3) as bigint) as conv_id, c_custkey % 3 as turn, concat(lower(c_mktsegment), case c_custkey % 4 when 0 then '\n' when 1 then '\n\n' else '' end,"
    " ' write to user', cast(c_custkey as string), case when c_custkey % 5 = 0 then ' at home' else '@mail.example.com' end, case when c_custkey % 2 = 0 then '\n\nbye\n' else '' end) as text from {customer}"
)


@query(
    "split_messages",
    "select conv_id, turn, replace(text, 'user' || c_custkey || '@mail.example.com', '[REDACTED:pii.email]') as text from (select c_custkey, "
    + _LETTERS.removeprefix("select ").replace("\n\nbye\n", "' || chr(10) || chr(10) || 'bye' || chr(10) || '").replace("\n\n", "' || chr(10) || chr(10) || '").replace("\n", "' || chr(10) || '")
    + ") t",
)
def split_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations governed as one text and put back into their turns, blank lines and all."""
    flat = exchange.flatten_messages(derived.run(spark, sf, _LETTERS), "conv_id", "turn", "text")
    found = scan.with_findings(flat, "text").withColumn("obligations", O.literal([{"type": "redact", "labels": ["pii.email"], "strategy": "mask"}]))
    return exchange.split_messages(redact.with_redaction(found, "text"), "conv_id", "turn")


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Tool results of three text blocks around an image, one of them empty."""

    def block(kind: str, text):
        return F.struct(F.lit(kind).alias("type"), text.alias("text"))

    docs = derived.table(spark, sf, "customer")
    blocks = F.array(
        block("text", F.col("c_name")),
        block("image", F.lit("raw").cast("string")),
        block("text", F.when(F.col("c_custkey") % 2 == 0, "").otherwise("middle")),
        block("text", F.col("c_mktsegment")),
    )
    return docs.select("c_custkey", blocks.alias("content"))


@query("content_text", "select c_custkey, c_name || chr(10) || case when c_custkey % 2 = 0 then '' else 'middle' || chr(10) end || c_mktsegment as text from {customer}")
def content_text(spark: SparkSession, sf: str) -> DataFrame:
    return _blocks(spark, sf).select("c_custkey", exchange.content_text(F.col("content")).alias("text"))


@query(
    "rewrite_content",
    "select c_custkey, case when c_custkey % 3 = 0 then 'one|raw|two|three|four' || chr(10) || 'five' when c_custkey % 3 = 1 then 'one|raw|two|three' else 'one|raw||' end as texts from {customer}",
)
def rewrite_content(spark: SparkSession, sf: str) -> DataFrame:
    """Governed lines put back into the text blocks; surplus lines are appended."""
    k = F.col("c_custkey") % 3
    governed = F.when(k == 0, "one\ntwo\nthree\nfour\nfive").when(k == 1, "one\ntwo\nthree").otherwise("one")
    out = _blocks(spark, sf).select("c_custkey", exchange.rewrite_content(F.col("content"), governed).alias("b"))
    return out.select("c_custkey", F.array_join(F.transform("b", lambda x: x["text"]), "|").alias("texts"))


@query(
    "delta_text",
    "select event_id, case event_id % 5 when 0 then event_type || '!' when 1 then 'a' || event_type when 2 then '' when 3 then event_type || event_type else event_type end as text from {events}",
)
def delta_text(spark: SparkSession, sf: str) -> DataFrame:
    """Text of streamed chunks in both content shapes and without content."""
    k, t = F.col("event_id") % 5, F.col("event_type")
    event = (
        F.when(k == 0, F.concat(F.lit('{"choices":[{"delta":{"content":"'), t, F.lit('"}},{"delta":{"content":"!"}}]}')))
        .when(k == 1, F.concat(F.lit('{"choices":[{"delta":{"content":[{"type":"text","text":"a"},{"type":"image"},{"type":"text","text":"'), t, F.lit('"}]}}]}')))
        .when(k == 2, F.lit('{"choices":[{"delta":{"role":"assistant"}}],"usage":{"n":1}}'))
        .when(k == 3, F.concat(F.lit('{"choices":[{"message":{"content":"'), t, t, F.lit('"}}]}')))
        .otherwise(F.concat(F.lit('{"id":7,"choices":[{"delta":{"content":"'), t, F.lit('"}}]}')))
    )
    return derived.table(spark, sf, "events").select("event_id", exchange.delta_text(event).alias("text"))
