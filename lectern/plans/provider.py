"""Where model replies come from. A provider turns rows with a ``prompt`` into rows with a ``reply``."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.plans.session import cut


class Retryable(Exception):
    """Raised by a call that may succeed later: rate limit, time-out, lost connection."""


class Provider(Protocol):
    def ask(self, rows: DataFrame, prompt: Column) -> DataFrame:
        """``rows`` with ``reply``, null where there was none, and ``call_error``."""


def request_key(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


class TableProvider:
    """Replies from a table of (request_key, reply): offline runs, and runs that must not ask twice."""

    def __init__(self, replies: DataFrame):
        self.replies = replies.groupBy("request_key").agg(F.max("reply").alias("reply"))

    def ask(self, rows: DataFrame, prompt: Column) -> DataFrame:
        out = rows.withColumn("request_key", request_key(prompt)).join(self.replies, "request_key", "left")
        return out.withColumn("call_error", F.when(F.col("reply").isNull(), "no reply")).drop("request_key")


def retry_delays(attempts: int, base: float = 1.0) -> list[float]:
    return [base * 2**k for k in range(attempts - 1)]


class CallProvider:
    """Replies from a function of a prompt. Each task asks at most ``at_once`` prompts at a time, ``tasks`` tasks run at all;
    Retryable errors are tried again with doubling delays, others are not. Replies are written to the shared folder at once, so
    that a later step that runs again doesn't ask again."""

    def __init__(self, call: Callable[[str], str | None], at_once: int = 5, tasks: int = 8, attempts: int = 3, delay: float = 1.0):
        self.call, self.at_once, self.tasks, self.attempts, self.delay = call, at_once, tasks, attempts, delay

    def _one(self, prompt: str | None) -> tuple[str | None, str | None]:
        if prompt is None:
            return None, "no prompt"
        waits = [*retry_delays(self.attempts, self.delay), None]
        for wait in waits:
            try:
                reply = self.call(prompt)
                return reply, None if reply is not None else "no reply"
            except Retryable as e:
                if wait is None:
                    return None, str(e) or "gave up"
                time.sleep(wait)
            except Exception as e:  # one bad row must not end the run
                return None, f"Exception: {e}"
        return None, "gave up"

    def ask(self, rows: DataFrame, prompt: Column) -> DataFrame:
        schema = T.StructType([*rows.schema.fields, T.StructField("reply", T.StringType()), T.StructField("call_error", T.StringType())])
        one, at_once = self._one, self.at_once

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with ThreadPoolExecutor(at_once) as pool:
                for pdf in batches:
                    got = list(pool.map(one, pdf.pop("prompt_")))
                    pdf["reply"], pdf["call_error"] = [g[0] for g in got], [g[1] for g in got]
                    yield pdf

        return cut(rows.withColumn("prompt_", prompt).repartition(self.tasks).mapInPandas(run, schema))


def chat_call(config) -> Callable[[str], str | None]:
    """A call of a chat-completions endpoint by a :class:`lectern.plans.config.ModelConfig`. Too many requests, faults of the server,
    time-outs and lost connections are Retryable; other faults are not."""

    def call(prompt: str) -> str | None:
        import json
        from urllib import error, request

        body = {"model": config.model, "messages": [{"role": "user", "content": prompt}], "temperature": config.temperature, "top_p": config.top_p, "max_tokens": config.max_tokens}
        req = request.Request(f"{config.base_url.rstrip('/')}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {config.api_key}"})
        try:
            with request.urlopen(req, timeout=config.timeout) as r:
                return json.loads(r.read())["choices"][0]["message"].get("content")
        except error.HTTPError as e:
            if e.code == 429 or e.code >= 500:
                raise Retryable(f"status {e.code}") from e
            raise
        except (error.URLError, TimeoutError, ConnectionError) as e:
            raise Retryable(str(e)) from e

    return call


def with_thinking(content: Column, thinking: Column, keep: bool) -> Column:
    """The reply with the model's reasoning before it, when that is kept."""
    wrapped = F.concat(F.lit("<thinking>"), thinking, F.lit("</thinking>\n"), content)
    return F.when(thinking.isNotNull() & (thinking != ""), wrapped).otherwise(content) if keep else content


def probe(call: Callable[[str], str | None], count: Callable[[str], int], prompt: str = "Say one sentence.") -> dict:
    """One request: how long it took and tokens a second."""
    start = time.time()
    reply = call(prompt)
    took = max(time.time() - start, 1e-9)
    n = count(reply or "")
    return {"ok": reply is not None, "seconds": took, "tokens": n, "tokens_per_second": n / took}


def probe_all(configs: dict[str, object], make: Callable = chat_call, count: Callable[[str], int] = lambda t: len(t.split())) -> list[dict]:
    """One request for each named configuration, in order of name; one that fails is reported and the others still run."""
    out = []
    for name in sorted(configs):
        try:
            out.append({"name": name, **probe(make(configs[name]), count), "error": None})
        except Exception as e:  # whatever a call raises is its result
            out.append({"name": name, "ok": False, "seconds": None, "tokens": 0, "tokens_per_second": None, "error": str(e)})
    return out
