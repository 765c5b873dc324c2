"""Chats, tools, uploads and agents as access requests and catalog assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.operators.catalog import ATTRIBUTES, as_variant, facts

# Tool-name beginnings and the action each one tells, in order of precedence.
ACTION_PREFIXES: tuple[tuple[str, str], ...] = (
    ("delete", "delete"),
    ("remove", "delete"),
    ("drop", "delete"),
    ("truncate", "delete"),
    ("create", "write"),
    ("update", "write"),
    ("insert", "write"),
    ("write", "write"),
    ("append", "write"),
    ("edit", "write"),
    ("patch", "write"),
    ("upload", "write"),
    ("send", "write"),
    ("post", "write"),
    ("publish", "write"),
    ("execute", "execute"),
    ("run", "execute"),
    ("exec", "execute"),
    ("shell", "execute"),
    ("eval", "execute"),
    ("call", "execute"),
    ("invoke", "execute"),
    ("read", "read"),
    ("get", "read"),
    ("list", "read"),
    ("search", "read"),
    ("query", "read"),
    ("fetch", "read"),
    ("find", "read"),
    ("describe", "read"),
)
ACTIONS = ("read", "write", "execute", "delete")
UNSAFE_ACTIONS = ("write", "delete", "execute")
# Endpoints outside the organisation.
EXTERNAL_ENDPOINTS = ("openai", "anthropic", "google", "azureopenai", "bedrock", "vertexai", "groq", "mistral")


def infer_action(tool: Column, declared: Column | None = None) -> Column:
    """The declared action if it is a known one, else the first prefix some word starts with."""
    words = F.regexp_extract_all(F.lower(tool), F.lit("([a-z]+)"))

    def told(prefix: str, action: str) -> Column:
        return F.when(F.exists(words, lambda word: F.startswith(word, F.lit(prefix))), F.lit(action))

    guess = F.coalesce(*[told(p, a) for p, a in ACTION_PREFIXES], F.lit("execute"))
    if declared is None:
        return guess
    said = F.lower(F.trim(declared))
    return F.when(said.isin(*ACTIONS), said).otherwise(guess)


def declared_action(annotations: Column) -> Column:
    """What a server's annotations (VARIANT) say a tool does, or null."""

    def flag(name: str) -> Column:
        is_flag = F.schema_of_variant(F.try_variant_get(annotations, f"$.{name}", "variant")) == "BOOLEAN"
        return F.when(is_flag, F.try_variant_get(annotations, f"$.{name}", "boolean"))

    override = F.nullif(F.try_variant_get(annotations, "$.action", "string"), F.lit(""))
    read_only = flag("readOnlyHint")
    return (
        F.when(override.isNotNull(), override)
        .when(flag("destructiveHint"), F.lit("delete"))
        .when(read_only, F.lit("read"))
        .when(~read_only, F.lit("write"))
    )


def tool_assets(listing: DataFrame, server: Column) -> DataFrame:
    """A tool listing ``(name, description, annotations variant, input_schema variant)`` as assets."""
    name = F.trim(F.coalesce("name", F.lit("")))
    step = listing.withColumn("name", name).where(F.col("name") != "")
    step = step.withColumn("_declared", declared_action(F.col("annotations"))).withColumn(
        "action", infer_action(F.col("name"), F.col("_declared"))
    )

    def hint(key: str) -> Column:
        return F.try_variant_get("annotations", f"$.{key}", "boolean")

    properties = F.try_variant_get("input_schema", "$.properties", "map<string,variant>")
    notes = F.try_variant_get("annotations", "$", "map<string,variant>")
    return step.select(
        F.concat(F.lit("mcp://"), server, F.lit("/"), F.col("name")).alias("urn"),
        "name",
        F.lit("tool").alias("kind"),
        F.coalesce("description", F.lit("")).alias("description"),
        server.alias("server"),
        "action",
        F.when(F.col("_declared").isNotNull(), "declared").otherwise("inferred").alias("action_source"),
        F.coalesce(hint("destructiveHint"), F.col("action").isin(*UNSAFE_ACTIONS)).alias("destructive"),
        hint("readOnlyHint").alias("read_only"),
        hint("openWorldHint").alias("open_world"),
        hint("idempotentHint").alias("idempotent"),
        (F.coalesce(F.size(notes), F.lit(0)) > 0).alias("annotated"),
        F.coalesce(F.array_sort(F.map_keys(properties)), F.array().cast("array<string>")).alias("parameters"),
    )


def _request(
    principal_id: Column,
    principal_type: Column,
    action: Column,
    urn: Column,
    kind: Column,
    context: Column,
    payload: Column,
    correlation: Column,
    attributes: Column | None = None,
) -> list[Column]:
    none = F.create_map().cast(ATTRIBUTES)
    return [
        F.struct(principal_id.alias("id"), principal_type.alias("type"), none.alias("attributes")).alias("principal"),
        action.alias("action"),
        F.struct(
            urn.alias("urn"),
            kind.alias("kind"),
            F.array().cast("array<string>").alias("classifications"),
            (none if attributes is None else attributes).alias("attributes"),
        ).alias("resource"),
        context.alias("context"),
        payload.alias("payload"),
        correlation.alias("correlation_id"),
    ]


def tool_requests(calls: DataFrame) -> DataFrame:
    """Both directions of tool calls ``(call_id, server, tool, agent_id, declared, conversation_id,
    arguments, result)`` as requests: the call itself and the return of its result.
    """
    urn = F.concat(F.lit("mcp://"), F.col("server"), F.lit("/"), F.col("tool"))

    def side(direction: str, action: Column, payload: Column) -> DataFrame:
        context = facts(
            channel=F.lit("mcp"),
            server=F.col("server"),
            tool=F.col("tool"),
            direction=F.lit(direction),
            conversation_id=F.col("conversation_id"),
        )
        return calls.select(
            F.concat(F.col("call_id").cast("string"), F.lit("/" + direction)).alias("request_id"),
            *_request(
                F.col("agent_id"), F.lit("agent"), action, urn, F.lit("tool"), context, payload, F.col("conversation_id")
            ),
        )

    return side("invoke", infer_action(F.col("tool"), F.col("declared")), F.col("arguments")).unionByName(
        side("result", F.lit("return"), F.col("result"))
    )


def destination(endpoint: Column) -> Column:
    return F.when(F.lower(endpoint).isin(*EXTERNAL_ENDPOINTS), "external").otherwise("internal")


def chat_requests(turns: DataFrame, ids: Column) -> DataFrame:
    """Chat turns ``(user_id, agent_id, conversation_id, endpoint, model, text, attachments)`` as requests."""
    by_agent = F.coalesce(F.col("agent_id"), F.lit("")) != ""
    principal = F.when(by_agent, F.concat(F.lit("agent:"), F.col("agent_id"))).otherwise(
        F.concat(F.lit("user:"), F.col("user_id"))
    )
    context = facts(
        channel=F.lit("librechat"),
        destination=destination(F.col("endpoint")),
        endpoint=F.col("endpoint"),
        model=F.col("model"),
        conversation_id=F.col("conversation_id"),
    )
    attached = F.create_map(F.lit("attachments"), as_variant(F.col("attachments")))
    return turns.select(
        ids.alias("request_id"),
        *_request(
            principal,
            F.when(by_agent, "agent").otherwise("user"),
            F.lit("infer"),
            F.concat(F.lit("model://"), F.col("endpoint"), F.lit("/"), F.col("model")),
            F.lit("model"),
            context,
            F.col("text"),
            F.col("conversation_id"),
            attached,
        ),
    )


def upload_assets(files: DataFrame, instance: str) -> DataFrame:
    """Uploads ``(file_id, filename, uploaded_by, content_type, size_bytes)`` as unclassified assets."""
    return files.select(
        F.concat(F.lit(f"librechat://{instance}/files/"), F.col("file_id").cast("string")).alias("urn"),
        F.col("filename").alias("name"),
        F.lit("file").alias("kind"),
        F.col("uploaded_by").alias("owner"),
        F.concat(F.lit("Uploaded to LibreChat by "), F.col("uploaded_by"), F.lit(".")).alias("description"),
        F.coalesce("content_type", F.lit("")).alias("content_type"),
        F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"),
        F.lit(False).alias("classified"),
    )


def agent_assets(agents: DataFrame, instance: str) -> DataFrame:
    """Agents ``(id, _id, name, author, provider, model, tools)`` as assets; no id, no asset."""
    agent = F.trim(F.coalesce(F.nullif(F.col("id"), F.lit("")), F.nullif(F.col("_id"), F.lit("")), F.lit("")))
    step = agents.withColumn("agent_id", agent).where(F.col("agent_id") != "")
    return step.select(
        F.concat(F.lit(f"librechat://{instance}/agents/"), F.col("agent_id")).alias("urn"),
        F.coalesce("name", "agent_id").alias("name"),
        F.lit("agent").alias("kind"),
        F.coalesce("author", F.lit("")).alias("owner"),
        "provider",
        "model",
        F.coalesce("tools", F.array().cast("array<string>")).alias("tools"),
    )


# --------------------------------------------------------------------------- message text


def flatten_messages(turns: DataFrame, conversation: str, order: str, text: str) -> DataFrame:
    """One text per conversation: its non-empty messages in order, a blank line between.

    ``spans`` keeps the turn, start and end of each message in the text, so that ``split_messages``
    puts governed text back even where a message holds blank lines itself.
    """
    filled = turns.where(F.coalesce(F.col(text), F.lit("")) != "")
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(text).alias("text"))))
    sizes = F.transform("messages", lambda m: F.length(m["text"]))
    starts = F.transform("messages", lambda m, i: F.aggregate(F.slice(sizes, 1, i), i * 2, lambda a, n: a + n))
    spans = F.transform(
        "messages", lambda m, i: F.struct(m["at"].alias("at"), starts[i].alias("start"), (starts[i] + F.length(m["text"])).alias("end"))
    )
    return filled.groupBy(conversation).agg(listed.alias("messages")).select(
        conversation,
        F.array_join(F.transform("messages", lambda m: m["text"]), "\n\n").alias("text"),
        F.transform("messages", lambda m: m["at"]).alias("turns"),
        spans.alias("spans"),
    )


def split_messages(governed: DataFrame, conversation: str, order: str, text: str = "text", edits: str = "edits") -> DataFrame:
    """Governed conversations back as turns ``(conversation, order, text)``.

    ``governed`` is the table of ``flatten_messages`` with the ``edits`` made in its text (start, end
    and replacement at offsets of the original, in text order). Each message is cut out by its
    offsets and gets its own edits, whatever it holds. An edit that reaches into the next message
    leaves its replacement where it starts.
    """
    one = governed.select(conversation, F.col(text).alias("_text"), F.col(edits).alias("_edits"), F.explode("spans").alias("_span"))
    start, end = F.col("_span.start"), F.col("_span.end")
    reach = F.array_max(F.transform(F.filter("_edits", lambda e: e["start"] < start), lambda e: e["end"]))
    own = F.filter("_edits", lambda e: (e["start"] >= start) & (e["start"] < end))
    first = F.least(end, F.greatest(start, F.coalesce(reach, start)))
    part = lambda low, high: F.substring(F.col("_text"), low + 1, F.greatest(high - low, F.lit(0)))
    done = F.aggregate(
        own,
        F.struct(F.lit("").alias("t"), first.alias("at")),
        lambda a, e: F.struct(
            F.concat(a["t"], part(a["at"], e["start"]), F.coalesce(e["replacement"], F.lit(""))).alias("t"), F.least(end, e["end"]).alias("at")
        ),
    )
    return one.withColumn("_done", done).select(
        conversation, F.col("_span.at").alias(order), F.concat(F.col("_done.t"), part(F.col("_done.at"), end)).alias("text")
    )


def content_text(blocks: Column, separator: str = "\n") -> Column:
    """Text of the text blocks of a tool result ``array<struct<type,text,...>>``."""
    texts = F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit("")))
    return F.array_join(F.filter(texts, lambda t: t != ""), separator)


def rewrite_content(blocks: Column, replacement: Column) -> Column:
    """Governed text put back line by line into the text blocks; a surplus is appended."""
    lines = F.split(replacement, "\n")
    slots = F.size(F.filter(blocks, lambda b: b["type"] == "text"))

    def put(block: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(blocks, 1, i), lambda b: b["type"] == "text"))
        text = F.coalesce(F.get(lines, before), F.lit(""))
        return F.when(block["type"] == "text", block.withField("text", text)).otherwise(block)

    surplus = F.array_join(F.slice(lines, slots + 1, F.greatest(F.size(lines), F.lit(1))), "\n")
    extra = F.struct(F.lit("text").alias("type"), surplus.alias("text"))
    rewritten = F.transform(blocks, put)
    return F.when((F.size(lines) > slots) & (surplus != ""), F.array_append(rewritten, extra)).otherwise(rewritten)


DELTA_EVENT = (
    "struct<choices:array<struct<delta:struct<content:variant>,message:struct<content:variant>>>>"
)


def delta_text(event: Column) -> Column:
    """The text a streamed chunk carries, in either content shape; JSON text in."""
    parsed = F.from_json(event, DELTA_EVENT)

    def of_choice(choice: Column) -> Column:
        delta = F.when(choice["delta"]["content"].isNotNull(), choice["delta"]["content"]).otherwise(
            F.when(choice["delta"].isNull(), choice["message"]["content"])
        )
        blocks = F.try_variant_get(delta, "$", "array<variant>")
        texts = F.transform(
            F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string") == "text"),
            lambda b: F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit("")),
        )
        plain = F.when(F.schema_of_variant(delta) == "STRING", F.try_variant_get(delta, "$", "string"))
        return F.coalesce(plain, F.array_join(texts, ""), F.lit(""))

    return F.coalesce(F.array_join(F.transform(parsed["choices"], of_choice), ""), F.lit(""))
