"""Language models behind one small interface: one method that completes a prompt. Nothing here needs one; whoever has one can put it in the
place of the offline rules (mapping, personas, questions, explanations)."""

from __future__ import annotations

import json
import re
import time
import urllib.request
from collections.abc import Callable
from functools import lru_cache
from typing import Protocol

from pyspark.sql import SparkSession

from ..session import setting

ATTEMPTS, PAUSE = 3, 1.5


class Provider(Protocol):
    def complete(self, prompt: str, temperature: float = 0.2) -> str: ...


class HttpProvider:
    """A chat-completions endpoint: POST <url>/chat/completions with model, messages and temperature."""

    def __init__(self, url: str, key: str, model: str, timeout: float = 60.0):
        self.url, self.key, self.model, self.timeout = url.rstrip("/"), key, model, timeout

    def complete(self, prompt: str, temperature: float = 0.2) -> str:
        body = json.dumps({"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": temperature}).encode()
        request = urllib.request.Request(f"{self.url}/chat/completions", body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)["choices"][0]["message"]["content"] or ""


@lru_cache(maxsize=8)
def _http(url: str, key: str, model: str) -> HttpProvider:
    return HttpProvider(url, key, model)


def get_provider(spark: SparkSession) -> HttpProvider:
    """The provider of the settings model_url, model_key and model_name, one for the same settings; RuntimeError without an address and key."""
    url, key, name = (setting(spark, f"model_{x}") for x in ("url", "key", "name"))
    if not url or not key:
        raise RuntimeError("no language model: set spark.segmill.model_url and SEGMILL_MODEL_KEY")
    return _http(url, key, name)


def _asked(ask: Callable[[], object], attempts: int, pause: float):
    """The first usable answer. Failures of the connection wait longer each time, unreadable answers are asked again at once."""
    last: Exception | None = None
    for n in range(attempts):
        try:
            return ask()
        except OSError as e:
            last = e
            time.sleep(pause * (n + 1))
        except (ValueError, KeyError, TypeError, IndexError) as e:
            last = e
    raise RuntimeError(f"no usable answer after {attempts} attempts: {last}") from last


def strip_fences(text: str) -> str:
    return re.sub(r"^```\w*\n?|```$", "", text.strip()).strip()


def structured(provider: Provider, prompt: str, check: Callable[[dict], dict], attempts: int = ATTEMPTS, pause: float = PAUSE) -> dict:
    """The provider's answer as checked JSON."""
    return _asked(lambda: check(json.loads(strip_fences(provider.complete(f"{prompt}\n\nAnswer with one JSON value and nothing else.", 0.0)))), attempts, pause)


def text(provider: Provider, prompt: str, temperature: float = 0.2, attempts: int = ATTEMPTS, pause: float = PAUSE) -> str:
    return _asked(lambda: provider.complete(prompt, temperature).strip(), attempts, pause)
