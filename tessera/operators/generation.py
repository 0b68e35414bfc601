"""Generators: functions from a prompt to a text, and whether one can be used.

`extractive` is the stand-in that needs nothing. `HttpModel` asks a language-model server over HTTP (JSON: GET /api/tags lists
the models, POST /api/generate answers a prompt). A name is resolved by `named`.
"""

from __future__ import annotations

import importlib
import json
import urllib.request
from collections.abc import Callable

Model = Callable[[str], str | None]


# The white space that is stripped from a sentence (any other is text), and what the first chunk begins with.
WHITE, FIRST = " \t\n\v\f\r", "\n[1] "


def extractive(prompt_text: str) -> str | None:
    """The first sentence of the first chunk, 500 characters at most; None if there is no such chunk. A stand-in, not a language model."""
    _, mark, rest = prompt_text.partition(FIRST)
    return first_sentence(rest) if mark else None


def extractive_to_mark(prompt_text: str) -> str | None:
    """The same, but a chunk ends before a line of it that begins as the chunk does, with [1] and a space."""
    parts = prompt_text.split(FIRST, 2)
    return first_sentence(parts[1]) if len(parts) > 1 else None


def first_sentence(chunk: str) -> str:
    """The first sentence after a chunk's heading, or of the heading if nothing follows."""
    heading, line, body = chunk.partition("\n")
    return (body if line else heading).partition(". ")[0].strip(WHITE)[:500]


# What a server is asked for beside the temperature. num_predict -1 sets no limit; summaries have one.
OPTIONS = {"num_predict": -1, "top_k": 40, "top_p": 0.9}
SUMMARY_TOKENS = 500


class HttpModel:
    """A model of a server; instances travel to the executors. `options` replace those of OPTIONS; None leaves one out."""

    def __init__(self, url: str, name: str, temperature: float = 0.3, timeout: float = 60, **options):
        self.url, self.name, self.timeout = url.rstrip("/"), name, timeout
        self.options = {k: v for k, v in ({"temperature": temperature} | OPTIONS | options).items() if v is not None}

    def for_summaries(self) -> HttpModel:
        """The same model as summaries are asked for: a limited length, no other choices than the temperature."""
        return HttpModel(self.url, self.name, self.options.get("temperature"), self.timeout, num_predict=SUMMARY_TOKENS, top_k=None, top_p=None)

    def __call__(self, prompt_text: str) -> str:
        body = {"model": self.name, "prompt": prompt_text, "stream": False, "options": self.options}
        request = urllib.request.Request(f"{self.url}/api/generate", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer).get("response", "").strip()

    def available(self) -> tuple[bool, str]:
        try:
            with urllib.request.urlopen(f"{self.url}/api/tags", timeout=5) as answer:
                names = [m.get("name", "") for m in json.load(answer).get("models", [])]
        except Exception as e:
            return False, f"Cannot reach {self.url}: {e}"
        if not any(self.name in n for n in names):
            return False, f"Model {self.name} not found"
        return True, f"Model {self.name} is there"


def available(model: Model) -> tuple[bool, str]:
    """Whether the model can be asked, and what to say about it."""
    return model.available() if hasattr(model, "available") else (True, f"{getattr(model, '__name__', 'model')} needs no service")


def named(name: str, temperature: float = 0.3) -> Model:
    """extractive; http://host:port#model; or module:function."""
    if name == "extractive":
        return extractive
    if name.startswith(("http://", "https://")):
        url, _, model = name.partition("#")
        return HttpModel(url, model, temperature)
    module, _, function = name.partition(":")
    if not function:
        raise ValueError(f"no such model: {name}")
    return getattr(importlib.import_module(module), function)
