"""Hooks, middleware and routes around DataFrame transformations, and adapters for a language model."""

from __future__ import annotations

import json
import logging
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.urls import route_matches

log = logging.getLogger(__name__)
EVENTS = ("before", "after", "error", "start", "finish")


class Hooks:
    """Ordered lists of callbacks. A callback that fails is counted and logged, and the others run.

    ``before`` and request middleware return updates of the request (a dict); ``after`` and response middleware return what
    replaces the response (a DataFrame), or None to leave it.
    """

    def __init__(self) -> None:
        self.callbacks: dict[str, list[Callable]] = {e: [] for e in (*EVENTS, "request", "response")}
        self.routes: list[tuple[str, Callable[[DataFrame], DataFrame]]] = []
        self.ok = self.bad = self.failed_hooks = 0
        self.seconds = 0.0

    def on(self, event: str, f: Callable | None = None) -> Callable:
        if f is None:
            return lambda g: self.on(event, g)
        self.callbacks[event].append(f)
        return f

    def route(self, pattern: str, f: Callable | None = None) -> Callable:
        if f is None:
            return lambda g: self.route(pattern, g)
        self.routes.append((pattern, f))
        return f

    def _each(self, event: str, *args) -> Iterator:
        for f in self.callbacks[event]:
            try:
                yield f(*args)
            except Exception as e:
                self.failed_hooks += 1
                log.warning("hook %s failed: %s", event, e)

    def run(self, transform: Callable[[DataFrame, dict], DataFrame], df: DataFrame, request: dict | None = None) -> DataFrame | None:
        """One call of a transformation with everything around it; None, and the error hooks, where it fails."""
        request = dict(request or {})
        began = time.time()
        list(self._each("start", request))
        try:
            for event in ("before", "request"):
                for update in self._each(event, request):
                    request |= update or {}
            out = transform(df, request)
            for event in ("response", "after"):
                for f in self.callbacks[event]:
                    try:
                        replaced = f(out)
                        out = out if replaced is None else replaced
                    except Exception as e:
                        self.failed_hooks += 1
                        log.warning("hook %s failed: %s", event, e)
            self.ok += 1
            self.seconds += time.time() - began
            return out
        except Exception as e:
            self.bad += 1
            list(self._each("error", request, e))
            return None
        finally:
            list(self._each("finish", request))

    def dispatch(self, df: DataFrame, url: str = "url") -> dict[str, DataFrame]:
        """All routes that match a URL run, in order, each over its own rows."""
        return {pattern: f(df.where(route_matches(F.col(url), pattern))) for pattern, f in self.routes}

    def stats(self) -> dict:
        n = self.ok + self.bad
        return {"total": n, "success": self.ok, "failed": self.bad, "success_rate": self.ok / n if n else 0.0, "avg_time": self.seconds / self.ok if self.ok else 0.0}


FENCE = re.compile(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$")


def parse_answer(answer: str | None) -> dict:
    """A model's answer without its fence, as JSON; what is no JSON object comes under ``raw_extraction``."""
    bare = FENCE.sub("", answer or "").strip()
    try:
        got = json.loads(bare)
        return got if isinstance(got, dict) else {"raw_extraction": bare}
    except ValueError:
        return {"raw_extraction": bare}


def extract_with_model(df: DataFrame, ask: Callable[[str], str], fields: list[str], text: str = "text", most: int = 8000, prompt: str = "Extract {fields} as a JSON object from:\n{text}") -> DataFrame:
    """Columns ``ai_<field>`` from an injected client, called once a row on the first ``most`` characters.

    A column that is there already stays as it is, and ``url`` is never asked for. An answer that fails gives nulls.
    """
    new = [f for f in fields if f"ai_{f}" not in df.columns and f != "url"]
    schema = T.StructType([*df.schema.fields, *(T.StructField(f"ai_{f}", T.StringType()) for f in new)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = []
            for t in frame[text]:
                try:
                    got.append(parse_answer(ask(prompt.format(fields=", ".join(fields), text=(t or "")[:most]))))
                except Exception as e:
                    log.warning("model failed: %s", e)
                    got.append({})
            for f in new:
                values = [g.get(f) for g in got]
                frame[f"ai_{f}"] = pd.Series([None if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for v in values], index=frame.index, dtype=object)
            yield frame

    return df.mapInPandas(run, schema)


CLEANED = ("ai_main_content", "ai_summary", "ai_title", "content", "summary", "text", "title")


def clean_with_model(df: DataFrame, ask: Callable[[str], str], batch: int = 10, most: int = 8000, prompt: str = "Clean these records; answer with a JSON array of the same length:\n{data}") -> DataFrame:
    """Records sent in batches; of the answer only text fields that aren't empty replace what was there.

    Records that the answer leaves out, and batches whose answer is no list, stay as they are.
    """
    fields = [c for c in CLEANED if c in df.columns and isinstance(df.schema[c].dataType, T.StringType)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            columns = {f: frame[f].tolist() for f in fields}
            for a in range(0, len(frame), batch):
                sent = [{f: columns[f][i] for f in fields} for i in range(a, min(a + batch, len(frame)))]
                try:
                    got = json.loads(FENCE.sub("", ask(prompt.format(data=json.dumps(sent, ensure_ascii=False)[:most])) or ""))
                except Exception as e:
                    log.warning("model failed: %s", e)
                    continue
                for i, answer in enumerate(got if isinstance(got, list) else ()):
                    if isinstance(answer, dict) and a + i < len(frame) and i < batch:
                        for f in fields:
                            if answer.get(f):
                                columns[f][a + i] = str(answer[f])
            for f in fields:
                frame[f] = pd.Series(columns[f], index=frame.index, dtype=object)
            yield frame

    return df.mapInPandas(run, df.schema)


def analyze_with_model(df: DataFrame, ask: Callable[[str], str], html: str = "html", most: int = 15000, prompt: str = "Describe the structure of this page as a JSON object:\n{html}") -> DataFrame:
    """A column ``structure``: the model's JSON on each page, or that of an unknown page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for h in frame[html]:
                try:
                    got = parse_answer(ask(prompt.format(html=(h or "")[:most])))
                except Exception as e:
                    log.warning("model failed: %s", e)
                    got = {"page_type": "unknown"}
                out.append(json.dumps(got, ensure_ascii=False))
            frame["structure"] = pd.Series(out, index=frame.index, dtype=object)
            yield frame

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("structure", T.StringType())]))


def client_config(config: dict, env: dict[str, str]) -> dict:
    """Options of a client: the environment over the file; no secret goes into a plan."""
    out = {"provider": "openai", "temperature": 0.1, "max_tokens": 4000} | {k: v for k, v in config.items() if v not in (None, "")}
    for name in ("provider", "model", "api_key", "base_url"):
        if value := env.get(f"AI_{name.upper()}"):
            out[name] = value
    return out
