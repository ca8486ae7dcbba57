"""Prompts, result envelopes and the pluggable embedder and generator."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.functions import span

INSTRUCTION = "You answer questions about a code base. Use only the given context. If the context does not hold the answer, say that you do not know."
#: New tokens of an answer.
MOST_TOKENS = 2048


def context_text(hits: DataFrame, separator: str = "\n\n") -> DataFrame:
    """(question_id, context): the contents of (question_id, rank, content) joined in rank order; nulls are left out."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "content")))
    texts = F.filter(F.transform(listed, lambda x: x["content"]), lambda x: x.isNotNull())
    return hits.groupBy("question_id").agg(F.array_join(texts, separator).alias("context"))


def chat_prompt(question: Column, context: Column, instruction: str = INSTRUCTION) -> Column:
    """Two messages: the instruction, then the context with the question. Null where there is no context."""
    user = F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question)
    messages = F.array(F.struct(F.lit("system").alias("role"), F.lit(instruction).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))
    return F.when(F.length(context) > 0, messages)


def envelopes(questions: DataFrame, hits: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """One result row per question with its ranked sources; questions without hits keep an empty list."""
    nested = F.array_sort(F.collect_list(F.struct(F.col("rank"), span().alias("source"))))
    ranked = hits.groupBy("question_id").agg(F.transform(nested, lambda x: x["source"]).alias("retrieved_sources"))
    empty = F.array().cast("array<struct<file_path:string,first_character_index:bigint,last_character_index:bigint>>")
    rows = questions.select(F.col("question_id").cast("string").alias("question_id"), "question", F.col("question").alias("question_str"))
    out = rows.join(ranked, "question_id", "left").withColumn("retrieved_sources", F.coalesce("retrieved_sources", empty))
    return out if answers is None else out.join(answers.select(F.col("question_id").cast("string").alias("question_id"), "answer"), "question_id", "left")


def after_last_marker(items: Column, marker: Column | int | str) -> Column:
    """The tail of an array after the last place of marker; the whole array where it does not occur."""
    mark = marker if isinstance(marker, Column) else F.lit(marker)
    from_end = F.array_position(F.reverse(items), mark)
    start = F.when(from_end > 0, F.size(items) - from_end + 2).otherwise(F.lit(1)).cast("int")
    return F.slice(items, start, F.size(items) + 1)


def embed_column(load: Callable[[], Callable[[Sequence[str]], object]], text: Column) -> Column:
    """Vectors from a model that each worker loads once. load() returns a function from texts to float rows."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(list(model(batch.fillna("").tolist())), dtype=object)

    return run(text)


def generate_column(load: Callable[[], Callable[[Sequence[str]], Sequence[str]]], prompt: Column, end_of_thought: str = "</think>") -> Column:
    """Answers from a model that each worker loads once; text up to the last end_of_thought is dropped, then
    trimmed. A null prompt has no answer."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            asked = batch.notna()
            answers = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            if asked.any():
                answers[asked] = [a.rpartition(end_of_thought)[2].strip() for a in model(batch[asked].tolist())]
            yield answers

    return run(prompt)


def hashing_embedder(dim: int = 64) -> Callable[[], Callable[[Sequence[str]], object]]:
    """A deterministic stand-in for a model: signed hashed word counts of unit length."""
    return functools.partial(_load_hashing, dim)


def _load_hashing(dim: int) -> Callable[[Sequence[str]], object]:
    import re
    import zlib

    import numpy as np

    def encode(texts: Sequence[str]) -> list:
        rows = np.zeros((len(texts), dim), "f4")
        for i, text in enumerate(texts):
            for word in re.findall(r"\w\w+", text.lower()):
                h = zlib.crc32(word.encode())
                rows[i, h % dim] += 1.0 if h >> 16 & 1 else -1.0
            norm = np.linalg.norm(rows[i])
            rows[i] = rows[i] / norm if norm else rows[i]
        return list(rows)

    return encode


def sentence_embedder(name: str, cache_dir: str | None = None) -> Callable[[], Callable[[Sequence[str]], object]]:
    """A sentence embedding model by name, with unit vectors; needs the library of that kind on the workers."""
    return functools.partial(_load_sentences, name, cache_dir)


def _load_sentences(name: str, cache_dir: str | None) -> Callable[[Sequence[str]], object]:
    from sentence_transformers import SentenceTransformer

    model = SentenceTransformer(name, cache_folder=cache_dir)
    return lambda texts: list(model.encode(list(texts), normalize_embeddings=True))


def chat_generator(name: str, cache_dir: str | None = None, most_tokens: int = MOST_TOKENS) -> Callable[[], Callable[[Sequence[str]], Sequence[str]]]:
    """A chat model by name; prompts are JSON lists of messages. Needs the library of that kind on the workers."""
    return functools.partial(_load_chat, name, cache_dir, most_tokens)


def _load_chat(name: str, cache_dir: str | None, most_tokens: int) -> Callable[[Sequence[str]], Sequence[str]]:
    import json

    from transformers import AutoModelForCausalLM, AutoTokenizer

    tokens = AutoTokenizer.from_pretrained(name, cache_dir=cache_dir)
    model = AutoModelForCausalLM.from_pretrained(name, cache_dir=cache_dir)

    def answer(prompts: Sequence[str]) -> list[str]:
        out = []
        for prompt in prompts:
            ids = tokens.apply_chat_template(json.loads(prompt), add_generation_prompt=True, return_tensors="pt")
            made = model.generate(ids, max_new_tokens=most_tokens)
            out.append(tokens.decode(made[0][ids.shape[1] :], skip_special_tokens=True))  # without the prompt's own tokens
        return out

    return answer
