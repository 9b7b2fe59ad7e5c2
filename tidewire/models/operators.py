"""Scoring, summaries, reviews and verdicts by a model client, in batches of rows."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Client(Protocol):
    """Answers one prompt; raises on a failure of the service."""

    def ask(self, prompt: str) -> str: ...


class Stub:
    """A deterministic client: scores follow from the length of each line."""

    def ask(self, prompt: str) -> str:
        lines = [x for x in prompt.split("\n")[1:] if x]
        kind = prompt.split("\n")[0]
        if kind == "score":
            return "```json\n" + json.dumps({"scores": [{"index": i, "impact": len(x) % 41, "facts": len(x) % 31, "novelty": len(x) % 29, "event": x[:12]} for i, x in enumerate(lines)]}) + "\n```"
        if kind == "summary":
            return json.dumps({"items": [{"index": i, "takeaway": x[:40], "category": "technology"} for i, x in enumerate(lines)]})
        return json.dumps({"verdicts": [{"index": i, "verdict": "new"} for i, _ in enumerate(lines)]})


def loose_json(text: str) -> dict | list | None:
    """The first JSON object or list in an answer, with fences, prefixes and unquoted keys allowed; None without one."""
    bare = re.sub(r"```(?:json)?", "", text or "")
    for found in (re.search(r"(?s)\{.*\}", bare), re.search(r"(?s)\[.*\]", bare)):
        if found:
            for t in (found[0], re.sub(r"([{,]\s*)([A-Za-z_]\w*)\s*:", r'\1"\2":', found[0]), re.sub(r",\s*([}\]])", r"\1", found[0])):
                try:
                    return json.loads(t)
                except ValueError:
                    continue
    return None


def duplicate_indexes(text: str) -> list[int]:
    """Indexes under ``dup``, with or without a letter before them; from a list anywhere in the text if broken."""
    got = loose_json(text)
    items = got.get("dup", []) if isinstance(got, dict) else got if isinstance(got, list) else re.findall(r"\d+", (re.search(r"dup\D*\[([^\]]*)", text or "") or ["", ""])[1])
    return [int(m[0]) for x in items if (m := re.search(r"\d+", str(x)))]


def duplicate_pairs(text: str) -> list[tuple[int, int]]:
    """(b, a) pairs under ``pairs``; unreadable ones are left out."""
    got = loose_json(text)
    items = got.get("pairs", []) if isinstance(got, dict) else []
    if not items:
        items = [{"b": b, "a": a} for b, a in re.findall(r"b\W*B?(\d+)\W+a\W*A?(\d+)", text or "")]
    num = lambda x: int(m[0]) if (m := re.search(r"\d+", str(x))) else None
    out = [(num(p.get("b")), num(p.get("a"))) if isinstance(p, dict) else (num(p[0]), num(p[1])) for p in items if isinstance(p, dict) or (isinstance(p, list) and len(p) > 1)]
    return [(b, a) for b, a in out if b is not None and a is not None]


def ask_rows(rows: DataFrame, text: str, kind: str, answer: str, fields: dict[str, str], client: Callable[[], Client], size: int = 40, attempts: int = 3) -> DataFrame:
    """``rows`` with a model's fields, ``size`` rows a prompt; fields are null where all attempts fail (fail-open).

    ``fields`` maps names to SQL types. The client is made in the worker.
    """
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + [f"{k} {t}" for k, t in fields.items()])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = client()
        for frame in frames:
            for a in range(0, len(frame), size):
                part = frame.iloc[a : a + size].copy()
                got: dict[int, dict] = {}
                prompt = "\n".join([kind, *part[text].fillna("").str.replace("\n", " ").map(lambda x: x or "-")])
                for _ in range(attempts):
                    try:
                        parsed = loose_json(asked.ask(prompt))
                    except Exception:  # a service failure is what attempts are for
                        continue
                    if isinstance(parsed, dict) and isinstance(parsed.get(answer), list):
                        got = {x["index"]: x for x in parsed[answer] if isinstance(x, dict) and isinstance(x.get("index"), int)}
                        break
                for k in fields:
                    part[k] = [got.get(i, {}).get(k) for i in range(len(part))]
                yield part

    return rows.mapInPandas(run, schema)


def score(candidates: DataFrame, client: Callable[[], Client] = Stub) -> DataFrame:
    """Sub-scores of candidates by title; rows of batches that failed keep nulls and are scored by their source."""
    return ask_rows(candidates, "title", "score", "scores", {"impact": "double", "facts": "double", "novelty": "double", "event": "string"}, client)


def summarise(articles: DataFrame, client: Callable[[], Client] = Stub) -> DataFrame:
    """Takeaway and category; a row that fails is to be quarantined (takeaway null)."""
    return ask_rows(articles, "text", "summary", "items", {"takeaway": "string", "category": "string"}, client, size=1, attempts=2)


def verdicts(candidates: DataFrame, client: Callable[[], Client] = Stub) -> DataFrame:
    """new, same_event or followup; a failure is new."""
    out = ask_rows(candidates, "title", "verdict", "verdicts", {"verdict": "string", "related_id": "long", "reason": "string"}, client, size=15)
    return out.withColumn("verdict", F.coalesce("verdict", F.lit("new")))
