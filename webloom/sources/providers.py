"""Providers of vectors and answers: interfaces, and deterministic ones for tests and dry runs."""

from __future__ import annotations

import hashlib
import json
import math
import urllib.error
import urllib.request
from typing import Protocol


class EmbeddingProvider(Protocol):
    model: str
    version: str
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class GenerationProvider(Protocol):
    def generate(self, system: str, user: str) -> str: ...


class HashingEmbedding:
    """Unit vectors from hashed words; equal texts get equal vectors, texts that share words near ones."""

    model, version = "hashing", "1"

    def __init__(self, dimension: int = 384):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            vector = [0.0] * self.dimension
            for word in text.lower().split() or [""]:
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                vector[h % self.dimension] += 1.0 if h >> 63 else -1.0
            size = math.sqrt(sum(x * x for x in vector)) or 1.0
            out.append([x / size for x in vector] if any(vector) else [1.0] + [0.0] * (self.dimension - 1))
        return out


class EchoGeneration:
    """Answers with the first words of the first source."""

    def generate(self, system: str, user: str) -> str:
        body = user.split("Content:\n", 1)
        return (" ".join(body[1].split()[:20]) + " [1].") if len(body) == 2 else ""


class GenerationError(RuntimeError):
    """A model that gave no answer: ``code`` is TIMEOUT, UNAVAILABLE or INVALID_RESPONSE."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


class ChatGeneration:
    """Answers from a chat endpoint of the common ``/chat/completions`` form.

    Called by tasks, once a question; an object holds settings only and can be shipped.
    """

    def __init__(self, base_url: str, model: str, key: str = "", max_tokens: int = 800, timeout: float = 60.0, temperature: float = 0.1):
        self.url, self.model, self.key = base_url.rstrip("/") + "/chat/completions", model, key
        self.max_tokens, self.timeout, self.temperature = max_tokens, timeout, temperature

    def generate(self, system: str, user: str) -> str:
        messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        body = {"model": self.model, "messages": messages, "temperature": self.temperature, "max_tokens": self.max_tokens}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url, json.dumps(body).encode(), headers), timeout=self.timeout) as response:
                answer = json.load(response)["choices"][0]["message"]["content"]
        except TimeoutError as error:
            raise GenerationError("TIMEOUT") from error
        except urllib.error.URLError as error:  # of a refused status as well
            raise GenerationError("TIMEOUT" if isinstance(error.reason, TimeoutError) else "UNAVAILABLE") from error
        except (ValueError, KeyError, IndexError, TypeError) as error:
            raise GenerationError("INVALID_RESPONSE") from error
        if not isinstance(answer, str) or not answer.strip():
            raise GenerationError("INVALID_RESPONSE")
        return answer.strip()
