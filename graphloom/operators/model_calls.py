"""Calls of language models: sites by plain patterns, and calls traced through imports, clients and arguments."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from .services import EXCLUDED_FILES, either

#: Call sites by name, provider and patterns, in order.
CALL_SITES = (
    ("anthropic-messages", "anthropic", (r"anthropic\.messages\.create\s*\(", r"client\.messages\.create\s*\(", r"claude\.messages\.create\s*\(", r"Anthropic\s*\(\s*\)\.messages\.create")),
    ("anthropic-completions", "anthropic", (r"anthropic\.completions\.create\s*\(", r"client\.completions\.create\s*\(")),
    ("openai-chat", "openai", (r"openai\.chat\.completions\.create\s*\(", r"client\.chat\.completions\.create\s*\(", r"ChatCompletion\.create\s*\(")),
    ("openai-completions", "openai", (r"openai\.completions\.create\s*\(", r"Completion\.create\s*\(")),
    ("azure-openai", "azure", (r"AzureOpenAI\s*\(", r"azure_endpoint")),
    ("google-gemini", "google", (r"genai\.GenerativeModel", r"model\.generate_content", r"gemini-pro")),
)
#: SDKs: provider, packages, classes of clients, whether an import stands in for a client, whether the
#: default import is a client, and methods with the kind of call; a method without a dot in front is a function.
SDKS = (
    ("openai", ("openai",), ("OpenAI", "OpenAIApi"), False, False, ((".chat.completions.create", "chat"), (".completions.create", "completion"), (".embeddings.create", "embedding"), (".images.generate", "image"), (".audio.transcriptions.create", "audio"))),
    ("anthropic", ("@anthropic-ai/sdk",), ("Anthropic",), False, False, ((".messages.create", "chat"), (".messages.stream", "chat"), (".messages.countTokens", "chat"), (".completions.create", "completion"), (".beta.messages.create", "chat"), (".beta.messages.stream", "chat"), (".beta.messages.countTokens", "chat"))),
    ("groq", ("groq-sdk",), ("Groq",), False, False, ((".chat.completions.create", "chat"),)),
    ("cohere", ("cohere-ai", "cohere"), ("CohereClient", "Cohere"), False, False, ((".generate", "completion"), (".chat", "chat"), (".embed", "embedding"))),
    ("mistral", ("@mistralai/mistralai",), ("MistralClient", "Mistral"), False, False, ((".chat.complete", "chat"), (".chat.stream", "chat"), (".chat", "chat"), (".chatStream", "chat"))),
    ("google", ("@google/genai",), ("GoogleGenAI",), False, False, ((".models.generateContent", "chat"), (".models.generateContentStream", "chat"), (".models.embedContent", "embedding"))),
    ("google", ("@google/generative-ai",), ("GoogleGenerativeAI",), True, False, ((".generateContent", "chat"), (".generateContentStream", "chat"), (".embedContent", "embedding"))),
    ("ollama", ("ollama",), ("Ollama",), False, True, ((".chat", "chat"), (".generate", "completion"), (".embed", "embedding"))),
    ("bedrock", ("@aws-sdk/client-bedrock-runtime",), ("BedrockRuntimeClient", "BedrockRuntime"), False, False, tuple((f".send(new {c}Command", "chat") for c in ("InvokeModel", "InvokeModelWithResponseStream", "InvokeModelWithBidirectionalStream", "Converse", "ConverseStream"))),
    ("vercel-ai-sdk", ("ai", "@ai-sdk/openai", "@ai-sdk/anthropic", "@ai-sdk/google", "@ai-sdk/groq", "@ai-sdk/mistral", "@ai-sdk/amazon-bedrock", "@ai-sdk/google-vertex", "@ai-sdk/cohere", "@ai-sdk/xai", "@ai-sdk/deepseek"), (), False, False, (("generateText", "completion"), ("streamText", "chat"), ("generateObject", "function-call"), ("streamObject", "function-call"), ("embed", "embedding"), ("embedMany", "embedding"))),
    ("langchain", ("@langchain/openai", "@langchain/anthropic", "@langchain/groq", "@langchain/core", "@langchain/community", "langchain"), ("ChatOpenAI", "ChatAnthropic", "ChatGroq", "ChatGoogleGenerativeAI"), True, False, ((".invoke", "chat"), (".call", "chat"), (".stream", "chat"), (".batch", "chat"))),
)
UNTRACED_FILES = EXCLUDED_FILES + r"|\.(d\.ts|map|min\.js)$|(^|/)(dist|build|generated)/"
#: Lines of a call that are read for its arguments: up to the one that closes it, at most this many.
CALL_LINES = 40


def call_sites(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Lines that call a model by a common name of its client: key, line, name, provider, the first pattern that holds."""
    every = either(p for _, _, patterns in CALL_SITES for p in patterns)
    site = None
    for name, provider, patterns in CALL_SITES:
        v, c = F.struct(F.lit(name).alias("name"), F.lit(provider).alias("provider")), F.col("t").rlike(either(patterns))
        site = F.when(c, v) if site is None else site.when(c, v)
    lines = rows.where(F.col(text).rlike(every)).select(key, F.posexplode(F.split(text, "\n")).alias("line", "t"))
    return lines.select(key, (F.col("line") + 1).alias("line"), site.alias("s")).where("s is not null").select(key, "line", "s.name", "s.provider")


def _method(method: str) -> str:
    """A method as a pattern up to its opening parenthesis; a receiver is captured in front of the dot."""
    if method.startswith("."):
        call = re.escape(method).replace(r"\(new\ ", r"\s*\(\s*new\s+").replace(r"\.", r"\s*\.")
        return rf"([A-Za-z_$][\w$]*){call}\s*\("
    return rf"(?:^|[^\w$.])()({method})\s*\("


def _argument(pattern: str) -> Column:
    return F.nullif(F.regexp_extract("call", pattern, 1), F.lit(""))


def _made_by(clients: str, receiver: Column, classes: tuple[str, ...]) -> Column:
    return F.exists(clients, lambda c: (c["name"] == receiver) & c["kind"].isin(*classes)) if classes else F.lit(False)


def traced_calls(files: DataFrame, key: str = "file_id") -> DataFrame:
    """Calls of models in source files: key, line, provider, method, call_type, client, model, temperature, max_tokens,
    confidence.

    A call counts if what it is called on was made by the SDK's class in the same file, is the SDK's default import where
    that is a client, or, for a few SDKs, if the file imports the SDK at all; functions count if it does. Confidence is
    0.6, and 0.15 more for the import, 0.1 for a stated model, 0.1 for a prompt, 0.05 for a setting. Arguments are read
    up to the line that closes the call. ``files``: key, file, content; tests, mocks and build output are left out.
    """
    path = F.coalesce("file", F.lit(""))
    quoted = lambda packages: rf"(?:from\s*|require\(\s*|import\s*\(?\s*)['\"](?:{'|'.join(map(re.escape, packages))})(?:/[^'\"]*)?['\"]"
    imported = F.array(*[F.col("content").rlike(quoted(packages)) for _, packages, *_ in SDKS])
    made = r"([A-Za-z_$][\w$]*)\s*(?::[^=\n;]+)?=\s*(?:await\s+)?new\s+(?:[A-Za-z_$][\w$]*\.)?([A-Za-z]+)\s*\("
    clients = F.arrays_zip(F.regexp_extract_all("content", F.lit(made), F.lit(1)).alias("name"), F.regexp_extract_all("content", F.lit(made), F.lit(2)).alias("kind"))
    singles = F.flatten(F.array(*[F.regexp_extract_all("content", F.lit(rf"import\s+([A-Za-z_$][\w$]*)\s+from\s+['\"]{p}['\"]"), F.lit(1)) if single else F.array().cast("array<string>") for _, packages, _, _, single, _ in SDKS for p in packages[:1]]))
    names = sorted({c for _, _, classes, *_ in SDKS for c in classes} | {p for _, packages, *_ in SDKS for p in packages})
    maybe = F.lit(False)
    for n in names:
        maybe |= F.contains("content", F.lit(n))
    every = either(_method(m) for *_, methods in SDKS for m, _ in methods)
    f = files.where(maybe & ~path.rlike(UNTRACED_FILES)).select(key, imported.alias("imported"), clients.alias("clients"), singles.alias("singles"), F.split("content", "\r?\n").alias("ls"))
    lines = f.select(key, "imported", "clients", "singles", "ls", F.posexplode("ls").alias("at", "t")).where(F.col("t").rlike(every))
    later = F.slice("ls", F.col("at") + 1, CALL_LINES)
    closing = F.array_position(F.transform(later, lambda x: x.rlike(r"^\s*\}?\s*\)|\)\s*;?\s*$")), True).cast("int")
    lines = lines.withColumn("call", F.array_join(F.slice(later, 1, F.when(closing > 0, closing).otherwise(CALL_LINES)), "\n")).drop("ls")
    hits = []
    for i, (provider, _, classes, fallback, single, methods) in enumerate(SDKS):
        here = F.get("imported", F.lit(i))
        for method, kind in methods:
            receiver = F.regexp_extract("t", _method(method), 1)
            own = _made_by("clients", receiver, classes)
            known = here if not method.startswith(".") else own | (here if fallback else F.lit(False)) | (F.array_contains("singles", receiver) if single else F.lit(False))
            row = F.struct(F.lit(provider).alias("provider"), F.lit(method.lstrip(".")).alias("method"), F.lit(kind).alias("call_type"), F.nullif(receiver, F.lit("")).alias("client"), here.alias("imported"))
            hits.append(F.when(F.col("t").rlike(_method(method)) & known, row))
    found = lines.select(key, (F.col("at") + 1).alias("line"), "call", F.explode(F.array_compact(F.array(*hits))).alias("h"))
    # of several methods of one provider on a line the longest holds, as .beta.messages.create is also .messages.create
    one = found.groupBy(key, "line", "call", F.col("h.provider").alias("provider")).agg(F.max_by("h", F.length("h.method")).alias("h"))
    model, heat, most = _argument(r"model\s*[:=]\s*(?:[A-Za-z_$][\w$.]*\(\s*)?['\"`]([^'\"`]+)['\"`]"), _argument(r"temperature\s*[:=]\s*([0-9.]+)").try_cast("double"), _argument(r"max_?[tT]okens\s*[:=]\s*([0-9]+)").try_cast("int")
    prompt = F.col("call").rlike(r"(?:content|prompt|system|input|instructions)\s*[:=]\s*[\"'`]")
    score = F.lit(0.6) + F.when(F.col("h.imported"), 0.15).otherwise(0.0) + F.when(model.isNotNull(), 0.1).otherwise(0.0) + F.when(prompt, 0.1).otherwise(0.0) + F.when(heat.isNotNull() | most.isNotNull() | F.col("call").rlike(r"stream\s*[:=]\s*[tT]rue|tools\s*[:=]"), 0.05).otherwise(0.0)
    return one.select(key, "line", "provider", "h.method", "h.call_type", "h.client", model.alias("model"), heat.alias("temperature"), most.alias("max_tokens"), F.round(F.least(F.lit(1.0), score), 2).alias("confidence"))
