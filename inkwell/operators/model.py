"""What a language model is asked and answers: the model itself is a callable of the caller's."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.sources.records import CARD

Inference = Callable[[str, str | None], str]


def repaired_json(text: str | None) -> str | None:
    """An answer as JSON: fences and what stands before it left out, and what it lacks at its end put there; null if that is none."""
    if not text:
        return None
    body = re.sub("(?i)```json|```", "", text).strip()
    body = body[body.find("{") :] if "{" in body else "{" + body
    end = body.rfind("}")
    for candidate in ([body[: end + 1]] if end >= 0 else []) + [_closed(re.sub(r",\s*([}\]])", r"\1", body))]:
        try:
            return json.dumps(json.loads(candidate), ensure_ascii=False)
        except ValueError:
            continue
    return None


def _closed(body: str) -> str:
    """body with its open string, brackets and braces closed: all brackets, then all braces."""
    inside, opened = False, {"[": 0, "{": 0}
    for at, c in enumerate(body):
        if c == '"' and (not at or body[at - 1] != "\\"):
            inside = not inside
        elif not inside and c in "[]{}":
            opened["[" if c in "[]" else "{"] += 1 if c in "[{" else -1
    return body + '"' * inside + "]" * opened["["] + "}" * opened["{"]


def _texts(value: object) -> list[str]:
    """An element or a list of them as texts; of an object its first text counts."""
    if value in (None, "", "null"):
        return []
    out = []
    for x in value if isinstance(value, list) else [value]:
        if isinstance(x, dict):
            x = next((v for v in x.values() if isinstance(v, str) and v), None)
        if x not in (None, "", "null"):
            out.append(str(x).strip())
    return out


def coerced(text: str | None) -> dict | None:
    """A repaired answer in the shape of CARD, whether its elements are texts or objects."""
    found = json.loads(text) if text else None
    if not isinstance(found, dict):
        return None
    people = found.get("contactPersons") or []
    persons = [{"name": p.get("name"), "role": p.get("role")} if isinstance(p, dict) else {"name": str(p), "role": None} for p in (people if isinstance(people, list) else [people])]
    single = {k: next(iter(_texts(found.get(k))), None) for k in ("companyName", "tagline", "pincode", "gstin")}
    return single | {k: _texts(found.get(k)) for k in ("providedServices", "phoneNumbers", "emails", "websites", "addressLines")} | {"contactPersons": [p for p in persons if p["name"]]}


def prompt(system: str, user: Column) -> Column:
    """C17: a chat of two turns, open for the answer."""
    return F.concat(F.lit(f"<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n"), user, F.lit("<|im_end|>\n<|im_start|>assistant\n"))


def with_answers(df: DataFrame, infer: Inference | None, question: str = "prompt", grammar: str | None = None) -> DataFrame:
    """Df with ``card``, what a model answers to a prompt; null where there is no model, it fails, or answers no JSON.

    The model is called in the tasks, prompt by prompt; rules take the place of a null (``coalesce``).
    """
    kind = T._parse_datatype_string(CARD)
    schema = T.StructType([*(f for f in df.schema if f.name != "card"), T.StructField("card", kind)])
    names = [f.name for f in schema if f.name != "card"]

    def ask(text: str | None) -> dict | None:
        if infer is None or text is None:
            return None
        try:
            return coerced(repaired_json(infer(text, grammar)))
        except Exception:  # noqa: BLE001  the model is the caller's; its failure means that rules decide
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b[n] for n in names), pa.array([ask(t) for t in b[question].to_pylist()], to_arrow_type(kind))], [*names, "card"])

    return df.select(*names).mapInArrow(run, schema)


def predictions(gold: DataFrame, how: str, given: DataFrame | None = None, infer: Inference | None = None, rules: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, prediction) of gold rows: 'pred' as given, 'model' by asking one, 'rules' by a function of gold."""
    if how == "pred":
        return given.select("id", "prediction")
    if how == "model":
        return with_answers(gold, infer).select("id", F.col("card").alias("prediction"))
    if how == "rules":
        return rules(gold).select("id", "prediction")
    raise ValueError(f"no such source of predictions: {how}")
