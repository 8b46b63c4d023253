"""Context, prompt and answer for retrieved rows; the answering model is pluggable."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHARS, SOURCES = 1800, 8
#: What a model is told first, what an answer without sources says, what the prompt asks for and its labels.
SYSTEM = """You are a clinical documentation assistant.
Answer ONLY from the provided context. If not present, say 'Not found in chart.'
Use concise, neutral language. Include bracketed numeric citations like [1], [2]
that map to the Sources list. This is not medical advice."""
MISSING = "Not found in chart."
ASK = "- A direct answer in 2\u20136 sentences.\n- Use bracketed numeric citations like [1], [2] that map to Sources.\n- If information is not present, say 'Not found in chart.'\n"
QUESTION, PATIENT_ID, CONTEXT, RETURN, SOURCE_LIST = "Question: ", "Patient ID: ", "\nContext:\n", "\n\nReturn:\n", "\nSources:\n"
INSIDE, FIRST = r"(?s)Context:\s*(.*?)(?=\n\nReturn:|\z)", r"(?s)\[1\]\s*(.*?)(?=\n\n\[2\]|\z)"
CITED = "\n\n[Citation: see Sources [1]]"
TEMPERATURE, TOKENS = 0.1, 600
#: A backend: from the columns (system prompt, prompt) to the answer's column.
Backend = Callable[[Column, Column], Column]


def contexts(results: DataFrame) -> DataFrame:
    """Per query: numbered blocks of the best chunks (1,800 characters each, 8 at most) and the list of their sources."""
    r = results.filter(F.col("rank") <= SOURCES)
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.substring("chunk_text_full", 1, CHARS))
    source = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("chunk_id"))
    g = r.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b"), source.alias("s")))).alias("x"))
    return g.select("query_id", F.array_join(F.transform("x", lambda v: v["b"]), "\n\n").alias("context"), F.array_join(F.transform("x", lambda v: v["s"]), "\n").alias("sources"))


def prompt(question: Column, patient: Column, context: Column, sources: Column) -> Column:
    """The user's prompt: question, patient if known, context, instructions, sources."""
    who = F.when(patient.isNotNull() & (patient != ""), F.concat(F.lit(PATIENT_ID), patient, F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(F.lit(QUESTION), question, F.lit("\n"), who, F.lit(CONTEXT), context, F.lit(RETURN + ASK + SOURCE_LIST), sources)


def stub(system: Column, prompt_text: Column) -> Column:
    """What follows the first [1] after `Context:`, up to [2] or the end, with a citation; without one, the fixed refusal.

    With an empty context that is the instruction's own [1], as the definition has it. The system prompt is not read.
    """
    inside = F.regexp_extract(prompt_text, INSIDE, 1)
    first = F.regexp_extract(F.regexp_replace(inside, r"(?U)^\s+|\s+\z", ""), FIRST, 1)
    found = F.regexp_replace(first, r"(?U)^\s+|\s+\z", "")
    return F.when(inside.rlike(r"\[1\]"), F.concat(found, F.lit(CITED))).otherwise(F.lit(MISSING))


def chat_service(base_url: str, model: str, key: str = "", at_once: int = 8, timeout: float = 120.0) -> Backend:
    """A backend that asks a chat-completions service, some prompts of a batch at once. An error becomes the answer's text.

    Nothing is sent before a query that uses it runs: prompts hold the chunks' texts, so the service must be trusted.
    """

    @F.pandas_udf(T.StringType())
    def ask(system: pd.Series, prompt_text: pd.Series) -> pd.Series:
        def one(pair: tuple[str, str]) -> str:
            body = {"model": model, "messages": [{"role": "system", "content": pair[0]}, {"role": "user", "content": pair[1]}], "temperature": TEMPERATURE, "max_tokens": TOKENS}
            request = Request(f"{base_url.rstrip('/')}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", **({"Authorization": f"Bearer {key}"} if key else {})})
            try:
                with urlopen(request, timeout=timeout) as reply:
                    return json.load(reply)["choices"][0]["message"]["content"].strip()
            except Exception as error:  # of one prompt, not of the job
                return f"Error calling the chat service: {error}"

        with ThreadPoolExecutor(at_once) as pool:
            return pd.Series(list(pool.map(one, zip(system, prompt_text))), dtype=object)

    return ask


def local_model(load: Callable[[], Callable[[str], str]]) -> Backend:
    """A backend around a model that runs in the workers: `load` gives a function from system and user prompt, joined by an
    empty line, to the new text. It is called once for each task; empty answers become the fixed refusal."""

    @F.pandas_udf(T.StringType())
    def generate(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        run = load()
        for system, prompt_text in batches:
            yield pd.Series([run(f"{a}\n\n{b}").strip() or MISSING for a, b in zip(system, prompt_text)], dtype=object)

    return generate


def transformers_model(name: str) -> Callable[[], Callable[[str], str]]:
    """For local_model: a causal model of the transformers package, which must be installed where tasks run."""

    def load() -> Callable[[str], str]:
        import torch
        from transformers import AutoModelForCausalLM, AutoTokenizer

        tokenizer, model = AutoTokenizer.from_pretrained(name), AutoModelForCausalLM.from_pretrained(name, torch_dtype="auto")

        def run(text: str) -> str:
            given = tokenizer(text, return_tensors="pt", truncation=True, max_length=2048).to(model.device)
            with torch.no_grad():
                out = model.generate(**given, max_new_tokens=TOKENS, temperature=TEMPERATURE, do_sample=True, pad_token_id=tokenizer.eos_token_id)
            return tokenizer.decode(out[0][given["input_ids"].shape[1] :], skip_special_tokens=True)

        return run

    return load


BACKENDS: dict[str, Backend] = {"stub": stub}


def register_backend(name: str, backend: Backend) -> None:
    """Adds a backend under a name, such as chat_service(...) as "openai" or local_model(...) as "hf"."""
    BACKENDS[name] = backend


def answers(results: DataFrame, queries: DataFrame, backend: str = "stub", system: str = SYSTEM) -> DataFrame:
    """query_id, prompt, answer, sources (array) and chunks (array, in the order of ranks) of each query.

    Queries without results get an empty context and no chunks. ValueError for a backend that isn't registered.
    """
    if backend not in BACKENDS:
        raise ValueError(f"unknown backend: {backend}; register it with register_backend")
    rows = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in results.columns if c not in ("query_id", "rank")]))).alias("chunks"))  # topk a query
    q = queries.join(contexts(results), "query_id", "left").join(rows, "query_id", "left").fillna("", ["context", "sources"])
    who = F.col("want_patient_id") if "want_patient_id" in q.columns else F.lit(None).cast("string")
    q = q.withColumn("prompt", prompt(F.coalesce("query", F.lit("")), who, F.col("context"), F.col("sources")))
    none = F.array().cast(dict(rows.dtypes)["chunks"])
    return q.select("query_id", "prompt", BACKENDS[backend](F.lit(system), F.col("prompt")).alias("answer"), F.filter(F.split("sources", "\n"), lambda s: s != "").alias("sources"), F.coalesce("chunks", none).alias("chunks"))
