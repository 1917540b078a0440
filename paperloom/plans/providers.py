"""Models behind an interface, and stand-ins that need none.

A provider is whatever has the methods of its protocol. The stand-ins are deterministic and offline; what they return
says nothing about a real model's quality."""

from __future__ import annotations

import hashlib
import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class Generator(Protocol):
    def generate(self, prompt: str, schema: dict | None = None) -> str: ...


@lru_cache(maxsize=1 << 16)
def _hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")


@dataclass(frozen=True)
class HashedEmbedder:
    """Stand-in: signed word hashes summed up and brought to length one."""

    size: int = 64

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = _hash(word)
                out[i, h % self.size] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


@dataclass(frozen=True)
class EchoGenerator:
    """Stand-in: the prompt's first characters, or with a schema the least object that fits it."""

    most: int = 200

    def generate(self, prompt: str, schema: dict | None = None) -> str:
        if schema is None:
            return prompt[: self.most].strip()
        least = {"boolean": False, "string": ""}
        return json.dumps({k: (v["enum"][-1] if "enum" in v else least.get(v["type"], "")) for k, v in schema["properties"].items()})


@dataclass(frozen=True)
class HttpGenerator:
    """A model server that takes a prompt as JSON at /api/generate. Thinking is off; a schema binds the answer."""

    model: str
    # The server's defaults.
    base_url: str = "http://localhost:11434"
    timeout: int = 1000
    temperature: float = 0.1
    context: int = 4096
    keep: str = "30m"
    stop: tuple[str, ...] = ("\nObservation:", "\nContext:", "\nQuestion:")

    def request(self, prompt: str, schema: dict | None = None) -> dict:
        options = {"temperature": self.temperature, "num_ctx": self.context, "stop": list(self.stop)}
        return {"model": self.model, "prompt": prompt, "stream": False, "think": False, "options": options, "keep_alive": self.keep} | ({"format": schema} if schema is not None else {})

    def generate(self, prompt: str, schema: dict | None = None) -> str:
        ask = urllib.request.Request(f"{self.base_url}/api/generate", json.dumps(self.request(prompt, schema)).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(ask, timeout=self.timeout) as answer:
                return (json.load(answer).get("response") or "").strip()
        except (urllib.error.URLError, OSError, ValueError) as e:
            raise RuntimeError(f"Could not reach model '{self.model}': {e}") from e


@dataclass(frozen=True)
class ChatGenerator:
    """A model server that takes messages as JSON at /chat/completions, with a key."""

    model: str
    key: str
    base_url: str
    timeout: int
    temperature: float
    most_tokens: int

    def request(self, prompt: str, schema: dict | None = None) -> dict:
        form = {"response_format": {"type": "json_schema", "json_schema": {"name": "answer", "schema": schema}}} if schema is not None else {}
        return {"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": self.temperature, "max_tokens": self.most_tokens} | form

    def generate(self, prompt: str, schema: dict | None = None) -> str:
        if not self.key:
            raise ValueError("the provider needs a key")
        ask = urllib.request.Request(f"{self.base_url}/chat/completions", json.dumps(self.request(prompt, schema)).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        try:
            with urllib.request.urlopen(ask, timeout=self.timeout) as answer:
                return (json.load(answer)["choices"][0]["message"]["content"] or "").strip()
        except (urllib.error.URLError, OSError, ValueError, LookupError) as e:
            raise RuntimeError(f"Could not reach model '{self.model}': {e}") from e


PROVIDERS: dict[str, Callable[..., Generator]] = {"http": HttpGenerator, "chat": ChatGenerator, "echo": EchoGenerator}


def generator(name: str, **settings) -> Generator:
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}; there are {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[name](**settings)


def embedded(chunks: DataFrame, embedder: Embedder, text: str = "page_content") -> DataFrame:
    """chunks with embedding: array<float>. The embedder goes to each worker once."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(embedder.embed(batch.fillna("").tolist()).astype(np.float32)))

    return chunks.withColumn("embedding", run(F.col(text)))


def generated(rows: DataFrame, model: Generator, prompt: str = "prompt", schema: str | None = None) -> DataFrame:
    """rows with answer and error. A prompt that fails gets an error; the others go on."""

    @F.pandas_udf("answer string, error string")
    def run(prompts: pd.Series, schemas: pd.Series) -> pd.DataFrame:
        out = []
        for p, s in zip(prompts, schemas, strict=True):
            try:
                out.append((model.generate(p, json.loads(s) if s else None), None))
            except Exception as e:  # noqa: BLE001  one prompt's failure is its row's
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["answer", "error"])

    # Not deterministic: the plan may not write the call out again for each use of its result.
    made = rows.withColumn("__made", run.asNondeterministic()(F.col(prompt), F.col(schema) if schema else F.lit(None).cast("string")))
    return made.withColumn("answer", F.col("__made.answer")).withColumn("error", F.col("__made.error")).drop("__made")
