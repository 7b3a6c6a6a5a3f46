"""Replies of a text model: fences, JSON inside prose, envelopes, and the short form of errors."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import strip

STRICT = {"allowSingleQuotes": "false"}
VERDICTS = "array<struct<faithful:int,missing:boolean,hallucinated:boolean>>"
ENVELOPES = "array<struct<type:string,result:string>>"


def strip_fences(text: Column) -> Column:
    """A reply without the code fence around it."""
    t = strip(text)
    inner = F.regexp_replace(F.regexp_replace(t, r"^```[a-zA-Z]*\n?", ""), r"\n?```$", "")
    return strip(F.when(t.startswith("```"), inner).otherwise(t))


def parse_object(raw: Column, schema: str = "map<string,string>") -> Column:
    """One JSON object: the whole reply, else what stands from the first brace to the last; null if neither can be read."""
    t = strip_fences(raw)
    inner = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    whole = lambda j: F.when(F.get_json_object(j, "$").isNotNull() & j.startswith("{"), j)
    return F.from_json(F.coalesce(whole(t), whole(inner)), schema, STRICT)


def parse_verdicts(raw: Column) -> Column:
    return F.from_json(strip_fences(raw), VERDICTS, STRICT)


def parse_envelope(stdout: Column) -> Column:
    """The text in a model's envelope: of a list the last event of type ``result``, of an object its ``result``."""
    events = F.from_json(stdout, ENVELOPES, STRICT)
    results = F.filter(events, lambda e: e["type"] == "result")
    of_list = F.when(F.size(results) > 0, F.coalesce(F.element_at(results, -1)["result"], F.lit("")))
    of_object = F.coalesce(F.get_json_object(stdout, "$.result"), F.when(F.get_json_object(stdout, "$").isNotNull(), F.lit("")))
    return F.when(strip(stdout).startswith("["), of_list).otherwise(of_object)


def short_error(error: BaseException, limit: int = 300) -> str:
    """One line that says what went wrong: the end of the message, never the command."""
    if isinstance(error, subprocess.TimeoutExpired):
        return f"timed out after {error.timeout}s"
    if isinstance(error, subprocess.CalledProcessError):
        said = (error.stderr or error.output or "").strip()
        return f"exited {error.returncode}" + (f": {said[-limit:]}" if said else "")
    said = str(error).strip()
    return type(error).__name__ + (f": {said[-limit:]}" if said else "")
