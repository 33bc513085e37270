"""Embedding providers: functions from texts to vectors, with a name and a dimension, that pickle to executors."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np

from docmill.operators.knn import Provider, hashing_provider

#: Texts of a request, and requests under way at once, for each task.
BATCH, AT_ONCE = 100, 4


class HttpProvider:
    """A remote embedding service that takes {model, input} and answers {data: [{index, embedding}]}.

    The key is read from an environment variable on the executor, not pickled. send(request bytes) -> answer can
    replace the HTTP call.
    """

    def __init__(self, url: str, model: str, dim: int, key_variable: str = "EMBEDDING_API_KEY", batch: int = BATCH, send: Callable[[bytes], bytes] | None = None):
        self.url, self.model, self.dim, self.key_variable, self.batch, self.send = url, model, dim, key_variable, batch, send
        self.name = f"http-{model}"

    def _call(self, body: bytes) -> bytes:
        if self.send:
            return self.send(body)
        head = {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ.get(self.key_variable, '')}"}
        with urllib.request.urlopen(urllib.request.Request(self.url, body, head), timeout=60) as answer:
            return answer.read()

    def _embed(self, texts: list[str]) -> list[list[float]]:
        answer = json.loads(self._call(json.dumps({"model": self.model, "input": [t if t.strip() else " " for t in texts]}).encode()))
        rows = sorted(answer["data"], key=lambda r: r["index"])
        if len(rows) != len(texts):
            raise ValueError(f"{len(texts)} texts were sent, {len(rows)} vectors came back")
        return [r["embedding"] for r in rows]

    def __call__(self, texts: list[str]) -> np.ndarray:
        parts = [texts[i : i + self.batch] for i in range(0, len(texts), self.batch)]
        with ThreadPoolExecutor(AT_ONCE) as pool:
            found = [v for part in pool.map(self._embed, parts) for v in part]
        return np.array(found, np.float32).reshape(len(texts), self.dim)


class LocalProvider:
    """A sentence-transformers model, loaded once in each worker."""

    def __init__(self, model: str = "all-MiniLM-L6-v2", dim: int = 384):
        self.model, self.dim, self.name, self._loaded = model, dim, f"local-{model}", None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_loaded": None}

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self._loaded is None:
            from sentence_transformers import SentenceTransformer  # optional

            self._loaded = SentenceTransformer(self.model)
        return np.asarray(self._loaded.encode(texts), np.float32)


def provider(kind: str = "hashing", **options) -> Provider:
    """A provider by kind: hashing, http or local; auto is http if its key is set, else local if it can be loaded, else hashing."""
    if kind == "auto":
        import importlib.util

        kind = "http" if os.environ.get(options.get("key_variable", "EMBEDDING_API_KEY")) and "url" in options else "local" if importlib.util.find_spec("sentence_transformers") else "hashing"
        options = options if kind == "http" else {}
    kinds = {"hashing": hashing_provider, "http": HttpProvider, "local": LocalProvider}
    if kind not in kinds:
        raise ValueError(f"unknown provider {kind!r}; there are {', '.join(kinds)} and auto")
    return kinds[kind](**options)
