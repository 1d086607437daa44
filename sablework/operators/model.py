"""Entities that a model finds: the one detector that needs Python on the executors."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sablework.functions.spans import MATCH, drop_contained, let, no_matches
from sablework.operators.detectors import as_spans
from sablework.plans.policy import Block

THRESHOLD = 0.5


@dataclass(frozen=True)
class Entity:
    start: int
    end: int
    label: str
    score: float
    text: str


class Client(Protocol):
    """A model; it travels to the executors, where load() runs once per worker process and the model stays. Offsets of what
    predict() finds are bytes. A client whose buffer holds only so many entities a call says so in ``span_limit``."""

    def load(self) -> None: ...

    def predict(self, text: str, labels: list[str], threshold: float) -> list[Entity]: ...


def split_labels(labels: str) -> list[str]:
    return [x.strip() for x in labels.split(",") if x.strip()]


#: Fixed value: what the buffer of a native model holds.
SPAN_LIMIT = 1024
#: The loaded models of this worker process.
_LOADED: dict[str, Client] = {}


def loaded(key: str, client: Client) -> Client:
    """The client that this process has under ``key``; the first one is loaded and kept."""
    if key not in _LOADED:
        client.load()
        _LOADED[key] = client
    return _LOADED[key]


def predict_all(client: Client, text: str, labels: list[str], threshold: float) -> list[Entity]:
    """What the model finds, also where its buffer is too small: a text that fills it is asked about in two halves, parted at
    the white space next to its middle. (The model then sees less around the cut; a text without white space keeps what there is.)"""
    found, limit = client.predict(text, labels, threshold), getattr(client, "span_limit", None)
    if limit is None or len(found) < limit:
        return found
    spaces = [m.start() for m in re.finditer(r"(?<=\S)\s", text)]
    if not spaces:
        return found
    at = min(spaces, key=lambda i: abs(i - len(text) // 2))
    left, right = text[:at], text[at:]
    if not right.strip():
        return found
    shift = len(left.encode())
    moved = [replace(e, start=e.start + shift, end=e.end + shift) for e in predict_all(client, right, labels, threshold)]
    return predict_all(client, left, labels, threshold) + moved


class ModelDetector:
    filter_type = "pheye"

    def __init__(self, block: Block, client: Client | None) -> None:
        self.block, self.client = block, client
        self.key = uuid.uuid4().hex
        self.labels = split_labels(block.options.get("pheyeConfiguration", {}).get("labels") or "Person")

    def matches(self, text: str) -> Column:
        """Without a client nothing is found. Offsets are the model's own; with removePunctuation they are those in the
        text that the model saw."""
        client, labels, key = self.client, self.labels, self.key
        if client is None:
            return no_matches()

        def of(model: Client, text: str | None) -> list[dict]:
            found = predict_all(model, text, labels, THRESHOLD) if text is not None else []
            return [{"start": e.start, "end": e.end, "token": e.text, "confidence": e.score} for e in found]

        @F.pandas_udf(MATCH)
        def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = loaded(key, client)
            for texts in batches:
                yield pd.Series([of(model, t) for t in texts])

        seen = F.regexp_replace(F.expr(text), r"\p{P}", "") if self.block.options.get("removePunctuation") else F.expr(text)
        return F.coalesce(predict(seen), no_matches())

    def spans(self, matches: Column, context: Column) -> Column:
        """Only ignored terms count for this detector, ignored patterns don't."""
        block = Block(self.block.key, self.block.enabled, self.block.ignored, (), self.block.strategies, self.block.options)
        return as_spans(let(matches, lambda m: drop_contained(m)), block, self.filter_type, context)
