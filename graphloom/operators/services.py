"""Calls of known services in source files, with a confidence that place, file and imports of the file lower."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

#: Services with the type of their component, how code calls them, and what imports corroborate it.
SERVICES = (
    ("Claude (Anthropic)", "llm", (r"anthropic\.messages\.create", r"anthropic\.completions\.create", r"anthropic\.beta\.", r"new Anthropic\(", r"AnthropicAI\("), (r"@anthropic-ai/sdk", r"anthropic")),
    ("OpenAI", "llm", (r"openai\.chat\.completions\.create", r"openai\.completions\.create", r"openai\.embeddings\.create", r"openai\.images\.generate", r"openai\.audio\.transcriptions", r"new OpenAI\(", r"OpenAIApi\(", r"from\s+['\"]openai['\"]"), (r"['\"]openai['\"]", r"@langchain/openai")),
    ("Groq", "llm", (r"new Groq\(", r"groq\.chat\.completions\.create", r"groqClient\.chat\.completions\.create", r"from\s+['\"]groq-sdk['\"]", r"import\s+Groq\s+from\s+['\"]groq-sdk['\"]"), (r"groq-sdk", r"@langchain/groq")),
    ("Cohere", "llm", (r"new Cohere\(", r"cohere\.generate", r"cohere\.chat", r"from cohere import"), (r"['\"]cohere['\"]",)),
    ("Gemini (Google)", "llm", (r"GenerativeModel\(", r"gemini-pro", r"from google\.generativeai", r"ChatGoogleGenerativeAI\(", r"from\s+['\"]@langchain/google-genai['\"]"), (r"google\.generativeai", r"@langchain/google")),
    ("Vercel AI SDK", "llm", (r"from\s+['\"]ai['\"]", r"from\s+['\"]@ai-sdk/", r"import\s+\{[^}]*generateText[^}]*\}", r"import\s+\{[^}]*streamText[^}]*\}", r"import\s+\{[^}]*generateObject[^}]*\}", r"import\s+\{[^}]*useChat[^}]*\}", r"import\s+\{[^}]*useCompletion[^}]*\}"), (r"['\"]ai['\"]", r"@ai-sdk/")),
    ("LangChain", "llm", (r"ChatPromptTemplate\.", r"StructuredOutputParser\.", r"RunnableSequence\.", r"ChatOpenAI\(", r"ChatAnthropic\(", r"ChatGoogleGenerativeAI\(", r"ChatGroq\(", r"wrapOpenAI\("), (r"langchain", r"@langchain/")),
    ("LangSmith", "llm", (r"from\s+['\"]langsmith", r"require\(['\"]langsmith", r"traceable\(", r"LANGCHAIN_TRACING"), (r"langsmith",)),
    ("Mistral", "llm", (r"new MistralClient\(", r"import\s+.*from\s+['\"]@mistralai", r"from mistralai import"), (r"@mistralai",)),
    ("Replicate", "llm", (r"new Replicate\(", r"import\s+Replicate\s+from\s+['\"]replicate['\"]", r"replicate\.run\("), (r"['\"]replicate['\"]",)),
    ("HuggingFace", "llm", (r"HfInference\(", r"from\s+['\"]@huggingface/inference['\"]", r"huggingface\.co/api"), (r"@huggingface/",)),
    ("Ollama", "llm", (r"from\s+['\"]ollama['\"]", r"import\s+ollama\b", r"\bnew\s+Ollama\(", r"\bollama\.chat\(", r"\bollama\.generate\(", r"OLLAMA_BASE_URL", r"OLLAMA_MODEL", r"OLLAMA_HOST", r":11434\b", r"localhost:11434", r"127\.0\.0\.1:11434"), ()),
    ("Stripe", "service", (r"stripe\.customers\.", r"stripe\.paymentIntents\.", r"stripe\.subscriptions\.", r"stripe\.invoices\.", r"stripe\.checkout\.", r"new Stripe\("), (r"['\"]stripe['\"]",)),
    ("Supabase", "database", (r"supabase\.from\(", r"createClient\(\s*process\.env\.SUPABASE", r"supabase\.auth\.", r"supabase\.storage\."), (r"@supabase/supabase-js",)),
    ("Firebase", "database", (r"firebase\.firestore\(", r"firebase\.auth\(", r"initializeApp\(", r"getFirestore\("), (r"firebase/",)),
    ("BullMQ", "queue", (r"new Queue\(", r"new Worker\(", r"Queue\.add\(", r"from 'bullmq'"), (r"['\"]bullmq['\"]",)),
    ("Celery", "queue", (r"@celery\.task", r"celery\.send_task", r"delay\(\)", r"apply_async\("), (r"from celery", r"import celery")),
    ("Twilio", "service", (r"twilio\.messages\.create", r"new Twilio\(", r"twilio\.calls\."), (r"['\"]twilio['\"]",)),
    ("SendGrid", "service", (r"sgMail\.send", r"@sendgrid/mail", r"sendgrid\.send"), (r"@sendgrid/",)),
    ("AWS S3", "service", (r"s3\.putObject", r"s3\.getObject", r"S3Client\(", r"PutObjectCommand"), (r"@aws-sdk/client-s3",)),
)
#: Lines that only show code, files that are not looked at, and files that count for less.
EXAMPLES = (
    r"code:\s*[\"'`].*[\"'`]", r"example:\s*[\"'`]", r"snippet:\s*[\"'`]", r"sample:\s*[\"'`]", r"mock:\s*[\"'`]", r"[\"'`]await\s+\w+\.\w+\.\w+\([^)]*\)[\"'`]", r"[\"'`][^\"'`]*\.\.\.[^\"'`]*[\"'`]",
)
EXCLUDED_FILES = r"(^|/)__tests__/|(^|/)tests?/|(^|/)mocks?/|(^|/)fixtures?/|\.(test|spec|mock)\.(ts|tsx|js|jsx)$"
FILE_MODIFIERS = ((r"\.(md|mdx|txt|rst|adoc)$|(?i)README|CHANGELOG|LICENSE", -0.4), (r"\.(d\.ts|map|min\.js)$|/dist/|/build/|/generated/", -0.3), (r"\.(json|ya?ml|toml|ini)$", -0.1))
SCANNED_FILES = r"\.(ts|tsx|js|jsx|mjs|cjs|py)$"
MIN_CONFIDENCE = 0.5
#: Whole strings of a line, whose removal leaves a quote only where one is open.
CLOSED_STRINGS = r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'"


def either(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def literals_of(pattern: str) -> set[str]:
    """Texts of which every match of a pattern of this module holds one, to be looked for before the pattern is tried: its
    longest run without a class, the last of equal ones, in either kind of quotes."""
    out = set()
    for quote in "'\"":
        kept = re.sub(r"\\([^sSwWdDb])", lambda m: f"\1{ord(m[1]):x}\2", pattern.replace(r"['\"]", quote))
        plain = re.sub(r"\[[^\]]*\][*+?]?|\\[sSwWdDb][*+?]?|\.[*+?]|\(\?:|[\^$*+?]", "\0", kept)
        parts = [re.sub("\1([0-9a-f]+)\2", lambda m: chr(int(m[1], 16)), x) for x in plain.split("\0")]
        out.add(max(enumerate(parts), key=lambda x: (len(x[1]), x[0]))[1])
    return out


def service_calls(files: DataFrame, key: str = "file_id") -> DataFrame:
    """Calls of services in source files: key, line, service, component_type, confidence (0.5 and more).

    Starts at 0.9. A line whose first match stands in a comment or that shows an example has none; 0.3 less inside a
    string; less by the kind of file; 0.2 less if nowhere in the whole file the service is imported (or no import of
    it is known). Test, mock and fixture files are not looked at. ``files``: key, file, content; a file is looked
    through for the patterns' plain texts first, so that only lines of files that hold one are taken apart.
    """
    path = F.coalesce(F.col("file"), F.lit(""))
    modifier = F.lit(0.0)
    for pattern, value in reversed(FILE_MODIFIERS):
        modifier = F.when(path.rlike(pattern), value).otherwise(modifier)
    texts = sorted({t for _, _, patterns, _ in SERVICES for p in patterns for t in literals_of(p)})

    def may(column: str) -> Column:
        out = F.lit(False)
        for t in texts:
            out |= F.contains(column, F.lit(t))
        return out

    found = files.where(may("content") & path.rlike(SCANNED_FILES) & ~path.rlike(EXCLUDED_FILES))
    proofs = F.array(*[F.col("content").rlike(either(proof)) if proof else F.lit(False) for _, _, _, proof in SERVICES])
    lines = found.select(key, modifier.alias("m"), proofs.alias("proofs"), F.posexplode(F.split("content", "\n")).alias("line", "text")).where(may("text"))
    bare = F.ltrim("text")
    note = F.startswith(bare, F.lit("//")) | F.startswith(bare, F.lit("#")) | F.startswith(bare, F.lit("*")) | F.col("text").rlike(either(EXAMPLES))
    hits = []
    for i, (name, kind, patterns, _) in enumerate(SERVICES):
        before = F.regexp_extract("text", rf"^(.*?)(?:{either(patterns)})", 1)
        confidence = F.lit(0.9) - F.when(F.regexp_replace(before, CLOSED_STRINGS, "").rlike("[\"']"), 0.3).otherwise(0.0) + F.col("m") - F.when(F.get("proofs", F.lit(i)), 0.0).otherwise(0.2)
        row = F.struct(F.lit(name).alias("service"), F.lit(kind).alias("component_type"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)), 2).alias("confidence"))
        hits.append(F.when(F.col("text").rlike(either(patterns)) & ~F.contains(before, F.lit("//")), row))
    rows = lines.where(~note).select(key, (F.col("line") + 1).alias("line"), F.explode(F.array_compact(F.array(*hits))).alias("h"))
    return rows.select(key, "line", "h.service", "h.component_type", "h.confidence").where(F.col("confidence") >= MIN_CONFIDENCE)
