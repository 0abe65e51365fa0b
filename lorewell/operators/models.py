"""What models the engine needs, and deterministic stand-ins that work offline.

A model is a small picklable object. The stand-ins make the relational and
graph semantics checkable; they say nothing about answer quality.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from lorewell.functions.prompts import instruction
from lorewell.functions.vectors import mean_pooling


class Embedder(Protocol):
    """Texts to vectors; unit vectors unless the model says otherwise."""

    def encode(self, texts: Sequence[str], instruction: str = "") -> np.ndarray: ...


class ChatModel(Protocol):
    """Lists of messages to (text, metadata)."""

    def infer(self, messages: list[dict[str, str]], **options: Any) -> tuple[str, dict[str, Any]]: ...


class Extractor(Protocol):
    """A passage to its entities and raw triples."""

    def extract(self, passage: str) -> tuple[list[str], list[list[str]]]: ...


class FactFilter(Protocol):
    """The candidate facts that matter for a question, best first."""

    def keep(self, question: str, facts: list[list[str]]) -> list[list[str]]: ...


class Reader(Protocol):
    """A response to a question with its passages and kept facts."""

    def answer(self, question: str, passages: list[str], facts: list[list[str]]) -> str: ...


def process(text: str) -> str:
    """Python's counterpart of ``functions.text.text_processing``."""
    return re.sub("[^A-Za-z0-9 ]", " ", text.lower()).strip(" ")


@dataclass(frozen=True)
class HashedWords:
    """Bag of words by hashed buckets: the first seven hex digits of the MD5 of each token, modulo the size."""

    size: int = 64
    normalise: bool = True

    def encode(self, texts: Sequence[str], instruction: str = "") -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for i, text in enumerate(texts):
            for t in process(text).split(" "):
                if t:
                    out[i, int(hashlib.md5(t.encode()).hexdigest()[:7], 16) % self.size] += 1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0) if self.normalise else out


@dataclass(frozen=True)
class SentenceTriples:
    """A sentence of three words or more gives the triple of its first, second and last word."""

    def extract(self, passage: str) -> tuple[list[str], list[list[str]]]:
        triples = []
        for sentence in re.split(r"[.\n]", passage):
            words = [w for w in process(sentence).split(" ") if w]
            if len(words) >= 3:
                triples.append([words[0], words[1], words[-1]])
        return list(dict.fromkeys(x for s, _, o in triples for x in (s, o))), triples


@dataclass(frozen=True)
class SharedWord:
    """Keeps candidates that share a word with the question."""

    limit: int = 4

    def keep(self, question: str, facts: list[list[str]]) -> list[list[str]]:
        words = set(process(question).split(" ")) - {""}
        return [f for f in facts if words & set(" ".join(f).split(" "))][: self.limit]


@dataclass(frozen=True)
class FirstFact:
    """The object (else the subject) of the best fact; without facts the first sentence of the first passage."""

    def answer(self, question: str, passages: list[str], facts: list[list[str]]) -> str:
        if facts:
            return f"Answer: {facts[0][2] or facts[0][0]}"
        return f"Answer: {re.split(r'[.\n]', passages[0])[0] if passages else ''}"


def post(url: str, body: dict[str, Any], headers: dict[str, str], timeout: float, retries: int, backoff: float, exponential: bool = False) -> dict[str, Any]:
    """POST JSON and read JSON; network errors and busy servers are tried again."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | headers)
    for attempt in range(retries + 1):
        try:
            with urllib.request.urlopen(request, timeout=timeout) as r:
                return json.load(r)
        except OSError as e:
            refused = isinstance(e, urllib.error.HTTPError) and e.code < 500 and e.code not in (408, 429)
            if refused or attempt == retries:
                raise
            time.sleep(backoff * (2**attempt if exponential else 1))
    raise AssertionError("unreachable")


@dataclass(frozen=True)
class HttpChat:
    """A chat model behind an OpenAI-compatible endpoint; ``parallel`` calls at once in a task, with retries.

    ``query`` goes behind the path, as gateways with versioned deployments need.
    """

    model: str
    url: str
    headers: dict[str, str] = field(default_factory=dict)
    retries: int = 2
    backoff: float = 1.0
    exponential: bool = False
    timeout: float = 300.0
    max_tokens: int = 2048
    temperature: float = 0.0
    seed: int | None = None
    parallel: int = 8
    guided: bool = False
    query: str = ""

    def infer(self, messages: list[dict[str, str]], schema: dict[str, Any] | None = None, **options: Any) -> tuple[str, dict[str, Any]]:
        limit = "max_completion_tokens" if self.model.startswith("gpt") else "max_tokens"
        body = {"model": self.model, "messages": messages, "temperature": self.temperature, "seed": self.seed, limit: self.max_tokens} | options
        if schema:
            body["response_format"] = {"type": "json_schema", "json_schema": {"name": "response", "schema": schema}}
        reply = post(f"{self.url}/chat/completions{self.query}", body, self.headers, self.timeout, self.retries, self.backoff, self.exponential)
        choice, usage = reply["choices"][0], reply.get("usage", {})
        meta = {k: usage.get(k) for k in ("prompt_tokens", "completion_tokens")} | {"finish_reason": choice.get("finish_reason")}
        return choice["message"]["content"], meta


@dataclass
class BedrockChat:
    """A chat model of Amazon Bedrock by its Converse call; needs the library boto3."""

    model: str
    region: str | None = None
    max_tokens: int = 2048
    temperature: float = 0.0
    parallel: int = 4

    def infer(self, messages: list[dict[str, str]], **options: Any) -> tuple[str, dict[str, Any]]:
        if not hasattr(self, "_client"):
            self._client = _local("boto3", lambda lib: lib.client("bedrock-runtime", region_name=self.region))()
        turns = [{"role": m["role"], "content": [{"text": m["content"]}]} for m in messages if m["role"] != "system"]
        told = [{"text": m["content"]} for m in messages if m["role"] == "system"]
        reply = self._client.converse(modelId=self.model, messages=turns, system=told, inferenceConfig={"maxTokens": self.max_tokens, "temperature": self.temperature})
        usage, stop = reply.get("usage", {}), reply.get("stopReason")
        meta = {"prompt_tokens": usage.get("inputTokens"), "completion_tokens": usage.get("outputTokens"), "finish_reason": "length" if stop == "max_tokens" else "stop"}
        return "".join(part.get("text", "") for part in reply["output"]["message"]["content"]), meta


@dataclass(frozen=True)
class HttpEmbedder:
    """An embedding model behind an OpenAI-compatible endpoint."""

    model: str
    url: str
    headers: dict[str, str] = field(default_factory=dict)
    batch: int = 16
    normalise: bool = True
    send_instruction: str = ""  # a format with {instruction}, put before each text
    query: str = ""
    timeout: float = 300.0
    retries: int = 2
    backoff: float = 1.0

    def encode(self, texts: Sequence[str], instruction: str = "") -> np.ndarray:
        prefix = self.send_instruction.format(instruction=instruction) if instruction and self.send_instruction else ""
        clean, rows = [prefix + (t.replace("\n", " ") or " ") for t in texts], []
        for k in range(0, len(clean), self.batch):
            reply = post(f"{self.url}/embeddings{self.query}", {"model": self.model, "input": clean[k : k + self.batch]}, self.headers, self.timeout, self.retries, self.backoff)
            rows += [x["embedding"] for x in reply["data"]]
        return _units(np.array(rows, np.float64)) if self.normalise else np.array(rows, np.float64)


@dataclass(frozen=True)
class CohereEmbedder:
    """An embedding model that is told whether a text is a query or a document; an instruction means a query."""

    model: str
    url: str = "https://api.cohere.com/v1"
    headers: dict[str, str] = field(default_factory=dict)
    batch: int = 96
    timeout: float = 300.0
    retries: int = 2
    backoff: float = 1.0

    def encode(self, texts: Sequence[str], instruction: str = "") -> np.ndarray:
        rows = []
        for k in range(0, len(texts), self.batch):
            body = {"model": self.model, "texts": [t or " " for t in texts[k : k + self.batch]], "input_type": "search_query" if instruction else "search_document"}
            rows += post(f"{self.url}/embed", body, self.headers, self.timeout, self.retries, self.backoff)["embeddings"]
        return np.array(rows, np.float64)


def _units(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _local(module: str, build):
    """A model of an optional library, loaded in the worker on first use."""

    def load():
        try:
            library = __import__(module)
        except ImportError as e:
            raise ImportError(f"this model needs the library {module}, which isn't installed") from e
        return build(library)

    return load


@dataclass
class LocalEmbedder:
    """A sentence-embedding model of an optional local library."""

    model: str
    library: str = "sentence_transformers"
    normalise: bool = True

    def encode(self, texts: Sequence[str], instruction: str = "") -> np.ndarray:
        if not hasattr(self, "_model"):
            self._model = _local(self.library, lambda lib: lib.SentenceTransformer(self.model))()
        out = np.asarray(self._model.encode(list(texts)), np.float64)
        return _units(out) if self.normalise else out


@dataclass
class PooledEmbedder:
    """An encoder without a pooling of its own: the mean of the vectors of a text's tokens; needs transformers and torch."""

    model: str
    normalise: bool = True
    batch: int = 16

    def encode(self, texts: Sequence[str], instruction: str = "") -> np.ndarray:
        if not hasattr(self, "_model"):
            self._tokens = _local("transformers", lambda lib: lib.AutoTokenizer.from_pretrained(self.model))()
            self._model = _local("transformers", lambda lib: lib.AutoModel.from_pretrained(self.model))()
        rows = []
        for k in range(0, len(texts), self.batch):
            given = self._tokens(list(texts[k : k + self.batch]), padding=True, truncation=True, return_tensors="pt")
            rows.append(mean_pooling(self._model(**given).last_hidden_state.detach().numpy(), given["attention_mask"].numpy()))
        out = np.concatenate(rows) if rows else np.zeros((0, 0))
        return _units(out) if self.normalise and len(out) else out


@dataclass
class LocalChat:
    """A text-generation model of an optional local library; all prompts of a batch at once."""

    model: str
    library: str = "transformers"
    max_tokens: int = 200
    batch: int = 8

    def infer(self, messages: list[dict[str, str]], **options: Any) -> tuple[str, dict[str, Any]]:
        return self.infer_batch([messages], **options)[0]

    def infer_batch(self, prompts: list[list[dict[str, str]]], **options: Any) -> list[tuple[str, dict[str, Any]]]:
        if not hasattr(self, "_pipe"):
            self._pipe = _local(self.library, lambda lib: lib.pipeline("text-generation", model=self.model))()
        out = self._pipe(prompts, max_new_tokens=options.get("max_tokens", self.max_tokens), batch_size=self.batch)
        return [(x[0]["generated_text"][-1]["content"], {"finish_reason": "stop"}) for x in out]


@dataclass
class OfflineBatchChat:
    """A model that runs in the task itself, on whole batches, and can be held to a JSON schema; needs the library vllm."""

    model: str
    max_tokens: int = 2048
    temperature: float = 0.0
    seed: int | None = None
    guided: bool = True
    settings: dict[str, Any] = field(default_factory=dict)

    def infer(self, messages: list[dict[str, str]], **options: Any) -> tuple[str, dict[str, Any]]:
        return self.infer_batch([messages], **options)[0]

    def infer_batch(self, prompts: list[list[dict[str, str]]], schema: dict[str, Any] | None = None, **options: Any) -> list[tuple[str, dict[str, Any]]]:
        if not hasattr(self, "_engine"):
            self._library = _local("vllm", lambda lib: lib)()
            self._engine = self._library.LLM(model=self.model, **self.settings)
        told: dict[str, Any] = {"max_tokens": self.max_tokens, "temperature": self.temperature, "seed": self.seed}
        if schema:
            from vllm.sampling_params import GuidedDecodingParams

            told["guided_decoding"] = GuidedDecodingParams(json=schema)
        found = self._engine.chat(prompts, self._library.SamplingParams(**told))
        return [
            (x.outputs[0].text, {"prompt_tokens": len(x.prompt_token_ids), "completion_tokens": len(x.outputs[0].token_ids), "finish_reason": x.outputs[0].finish_reason})
            for x in found
        ]


def chat_model(name: str, url: str = "https://api.openai.com/v1", **settings: Any) -> ChatModel:
    """A chat model by the form of its name.

    ``bedrock/...``, ``Transformers/...``, ``offline/...`` (whole batches in the
    task), ``azure/deployment`` (``url``: the resource; key and version in
    ``api_key`` and ``api_version``), or else an OpenAI-compatible endpoint, with
    the key of ``api_key`` if there is one.
    """
    if name.startswith("Transformers/"):
        return LocalChat(name.removeprefix("Transformers/"), **settings)
    if name.startswith("offline/"):
        return OfflineBatchChat(name.removeprefix("offline/"), **settings)
    if name.startswith("bedrock"):
        return BedrockChat(name.removeprefix("bedrock/"), **settings)
    return HttpChat(*_endpoint(name, url, settings), **settings)


def _endpoint(name: str, url: str, settings: dict[str, Any]) -> tuple[str, str]:
    """Name and URL of a model, with what its gateway wants put into ``settings``."""
    key, version = settings.pop("api_key", None), settings.pop("api_version", "2024-10-21")
    if name.startswith("azure/"):
        name = name.removeprefix("azure/")
        settings["headers"] = {"api-key": key or ""} | settings.get("headers", {})
        settings["query"] = f"?api-version={version}"
        return name, f"{url.rstrip('/')}/openai/deployments/{name}"
    if key:
        settings["headers"] = {"Authorization": f"Bearer {key}"} | settings.get("headers", {})
    return name, url


def embedder(name: str, url: str = "https://api.openai.com/v1", **settings: Any) -> Embedder:
    """An embedding model by the form of its name."""
    if name == "hashed-words":
        return HashedWords(**settings)
    if "NV-Embed-v2" in name:
        return HttpEmbedder(name, url, send_instruction="Instruct: {instruction}\nQuery: ", **settings)
    if "GritLM" in name:
        return HttpEmbedder(name, url, send_instruction="<|user|>\n{instruction}\n<|embed|>\n", **settings)
    if "contriever" in name:
        return PooledEmbedder(name, **settings)
    if "text-embedding" in name:
        return HttpEmbedder(*_endpoint(name, url, settings), **settings)
    if "cohere" in name:
        key = settings.pop("api_key", None)
        return CohereEmbedder(name.removeprefix("cohere/"), **({"headers": {"Authorization": f"Bearer {key}"}} if key else {}), **settings)
    if name.startswith("Transformers/"):
        return LocalEmbedder(name.removeprefix("Transformers/"), normalise=False, **settings)
    if name.startswith("VLLM/"):
        return HttpEmbedder(name.removeprefix("VLLM/"), url, normalise=False, **settings)
    raise ValueError(f"unknown embedding model {name}")


def closest_facts(made: list[list[str]], candidates: list[list[str]], cutoff: float = 0.0) -> list[list[str]]:
    """For each made fact the candidate whose text is closest; each candidate once, ties to the first."""
    from difflib import SequenceMatcher

    out: list[list[str]] = []
    for fact in made:
        ratios = [SequenceMatcher(None, str(tuple(c)), str(tuple(fact))).ratio() for c in candidates]
        best = max(range(len(candidates)), key=lambda i: ratios[i], default=None)
        if best is not None and ratios[best] >= cutoff and candidates[best] not in out:
            out.append(candidates[best])
    return out


def embed(text: Column, model: Embedder, linking: str | None = None) -> Column:
    """The embedding of a text column as ``array<float>``; a null text counts as empty."""
    told = instruction(linking) if linking else ""

    @F.arrow_udf("array<float>")
    def vectors(texts: pa.Array) -> pa.Array:
        found = [x or "" for x in texts.to_pylist()]
        if not found:
            return pa.array([], pa.list_(pa.float32()))
        m = np.asarray(model.encode(found, told), np.float32)
        offsets = np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(m.ravel()))

    return vectors(text)
