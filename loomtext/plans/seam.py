"""The model seam: prompts go out and answers come back as columns, behind one pluggable function.

A model is a function from a list of prompts to a list of answers in the same order, built once per task by a
factory, so that clients are never shared between tasks. Failed calls answer with an empty text, or with JSON
{"error": ...} where JSON is asked for. Answers are written out at once, so no later step and no lost executor asks
for them again.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import backoff_seconds
from ..functions.text import clean_completion
from ..storage import materialized

Model = Callable[[list[str]], list[str]]


@dataclass(frozen=True)
class Provider:
    name: str
    base_url: str | None
    key_variable: str | None
    timeout: int = 120
    retries: int = 3
    concurrent: int = 128


#: Found by what a model's name contains, in this order; the last is used for all others.
PROVIDERS: dict[str, Provider] = {
    "local": Provider("local", "http://localhost:8000/v1", None, 600, 2, 12),
    "": Provider("default", None, "MODEL_API_KEY"),
}


def add_provider(pattern: str, provider: Provider) -> None:
    rest = dict(PROVIDERS)
    PROVIDERS.clear()
    PROVIDERS.update({pattern: provider} | rest)


def provider_of(model: str, server: str | None = None) -> Provider:
    if server:
        return Provider("server", server, None, 600, 2, 12)
    return next(p for k, p in PROVIDERS.items() if k in model)


def is_reasoning(model: str) -> bool:
    name = model.rsplit("/", 1)[-1]
    return name[:2] in ("o1", "o3", "o4") or "gpt-5" in name


def request_options(model: str, temperature: float, max_tokens: int, json_mode: bool = False) -> dict:
    """What a request carries: reasoning models take a larger budget under another name, and no temperature."""
    if is_reasoning(model):
        out = {"max_completion_tokens": max(max_tokens, 4096, 4 * max_tokens)}
    else:
        out = {"max_tokens": max_tokens, "temperature": temperature}
    if json_mode and provider_of(model).name == "default":
        out["response_format"] = {"type": "json_object"}
    return out


class Retryable(Exception):
    """A failure worth another try: connection, time-out, too many requests, server errors."""


@dataclass
class Client:
    """Sends prompts through `send`, several at once, with retries; answers keep the prompts' order."""

    send: Callable[[str], str]
    concurrent: int = 12
    tries: int = 5
    json_mode: bool = False
    sleep: Callable[[float], None] = time.sleep
    counts: dict = field(default_factory=lambda: {"sent": 0, "failed": 0})

    def one(self, prompt: str) -> str:
        for attempt in range(self.tries):
            self.counts["sent"] += 1
            try:
                return self.send(prompt)
            except Retryable as e:
                error = e
                if attempt + 1 < self.tries:
                    self.sleep(backoff_seconds(attempt))
            except Exception as e:  # noqa: BLE001  other errors are answers at once
                error = e
                break
        self.counts["failed"] += 1
        return json.dumps({"error": str(error)}) if self.json_mode else ""

    def __call__(self, prompts: list[str]) -> list[str]:
        with ThreadPoolExecutor(self.concurrent) as pool:
            return list(pool.map(self.one, prompts))


def http_sender(url: str, model: str, key: str = "EMPTY", timeout: int = 120, **options) -> Callable[[str], str]:
    """A sender for servers that speak the chat-completions protocol."""
    import urllib.error
    import urllib.request

    def send(prompt: str) -> str:
        body = json.dumps({"model": model, "messages": [{"role": "user", "content": prompt}], **options}).encode()
        ask = urllib.request.Request(f"{url}/chat/completions", body, {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
        try:
            with urllib.request.urlopen(ask, timeout=timeout) as r:
                return json.load(r)["choices"][0]["message"]["content"] or ""
        except urllib.error.HTTPError as e:
            if e.code == 429 or e.code >= 500:
                raise Retryable(str(e)) from e
            raise
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            raise Retryable(str(e)) from e

    return send


@dataclass(frozen=True)
class Stub:
    """A deterministic model: scripted answers by the prompt's SHA-256, else by a word it contains, else its hash."""

    scripted: tuple[tuple[str, str], ...] = ()
    words: tuple[tuple[str, str], ...] = ()

    def __call__(self, prompts: list[str]) -> list[str]:
        by = dict(self.scripted)

        def answer(p: str) -> str:
            h = hashlib.sha256(p.encode()).hexdigest()
            return by.get(h) or next((a for w, a in self.words if w in p), f"answer {h[:16]}")

        return [answer(p) for p in prompts]


def complete(df: DataFrame, prompt: str, out: str, factory: Callable[[], Model], batch: int = 256, clean: bool = True) -> DataFrame:
    """Add the answers to a column of prompts; null prompts are not sent and answer null."""
    names, shape = df.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    at = names.index(prompt)

    def run(batches: Iterator[pa.RecordBatch]):
        model = factory()
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                asked = part.column(at).to_pylist()
                got = iter(model([p for p in asked if p is not None]))
                answers = [None if p is None else next(got) for p in asked]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(answers, pa.string())], names=[*names, out])

    done = materialized(df.mapInArrow(run, f"{shape}, `{out}` string"), "answers")
    return done.withColumn(out, F.when(F.col(out).isNotNull(), clean_completion(F.col(out)))) if clean else done


def failed(answer: Column) -> Column:
    """Answers that hold nothing: a failed call must not be taken for an empty span."""
    return answer.isNull() | (F.trim(answer) == "")
