"""Readers of what an audit writes: finding files with a head of fields, ledgers, tables in Markdown, and records of usage."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELD = re.compile(r"([\w-]+):(?:\s+(.*))?$", re.ASCII)
HEAD = "fields map<string,string>, remediation map<string,string>, body string, errors array<string>"


def without_comment(text: str) -> str:
    """text up to a # at its beginning or behind white space, outside quotes; a backslash in quotes takes the next letter along."""
    quote, at = "", 0
    while at < len(text):
        letter = text[at]
        if quote:
            at += letter == "\\"
            quote = "" if letter == quote else quote
        elif letter in "\"'":
            quote = letter
        elif letter == "#" and (at == 0 or text[at - 1].isspace()):
            return text[:at].strip()
        at += 1
    return text.strip()


def scalar(text: str) -> str | None:
    """A field's value: a flow list as JSON, a quoted text without its quotes and with its escapes read, a plain one as it is; nothing is None."""
    if text[:1] == "[":
        try:
            return json.dumps(json.loads(text))
        except ValueError:
            return json.dumps([x for part in text[1:-1].split(",") if (x := re.sub(r"^[\"']|[\"']$", "", part.strip()))])
    if text[:1] == '"':
        try:
            return str(json.loads(text))
        except ValueError:
            return text[1:-1]
    if text[:1] == "'":
        return text[1:-1].replace("''", "'")
    return text or None


def head(text: str | None) -> tuple[dict[str, str], dict[str, str] | None, str, list[str]]:
    """(fields, fields of the remediation block, body, errors) of a text that begins with a head between lines of ---.

    A head has fields, one level of fields below a field without a value, and lists of dashes; lists are kept as JSON. Texts over several lines
    (| and >), lines that are no field and lines that are set in below a field with a value are errors, and change nothing else; so is a head
    that is missing or doesn't end.
    """
    lines = (text or "").replace("\r\n", "\n").split("\n")
    if lines[0].strip() != "---" or "---" not in [x.rstrip() for x in lines[1:]]:
        return {}, None, text or "", ["no head"]
    end = next(n for n, x in enumerate(lines[1:], 1) if x.rstrip() == "---")
    top: dict[str, str | None] = {}
    blocks: dict[str, dict[str, str]] = {}
    lists: dict[tuple[str, str], list[str]] = {}
    errors, last, parent = [], None, ""
    for line in lines[1:end]:
        plain = line.strip()
        if not plain or plain.startswith("#"):
            continue
        if plain.startswith("- ") and last:
            lists.setdefault(last, []).append(scalar(without_comment(plain[2:])) or "")
            parent = parent if last[1] else ""
            continue
        found = FIELD.match(plain)
        if not found:
            errors.append(f"not a field: {plain[:40]}")
            continue
        key, value = found[1], without_comment(found[2] or "")
        if re.fullmatch(r"[|>][-+]?", value):
            errors.append(f"text over several lines: {key}")
        if not line.startswith(" "):
            top[key], last, parent = scalar(value), (key, ""), "" if value else key
        elif parent:
            blocks.setdefault(parent, {})[key] = scalar(value)
            last = parent, key
        else:
            errors.append(f"unexpected indentation: {plain[:40]}")
    for (field, below), items in lists.items():
        (blocks.setdefault(field, {}) if below else top)[below or field] = json.dumps(items)
    own = blocks.get("remediation")
    known = lambda d: {k: v for k, v in d.items() if v is not None}
    return known({k: v for k, v in top.items() if k not in blocks}), None if own is None else known(own), "\n".join(lines[end + 1 :]), errors


def findings(files: DataFrame) -> DataFrame:
    """files (name, text) with the head of each: fields, remediation (null without the block), body, errors. Null texts have no head."""

    @F.pandas_udf(HEAD)
    def parsed(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([head(t) for t in batch], columns=["fields", "remediation", "body", "errors"])

    return files.select("*", parsed("text").alias("_h")).select("*", "_h.*").drop("_h")


def ledgers(files: DataFrame) -> DataFrame:
    """files (name, text) of coverage ledgers with entries, or with an error where the text is no JSON of that shape."""
    entry = "class:string,target:string,status:string,auditor:string,evidence:array<string>,reason:string,carried_from:string"
    parsed = files.withColumn("_d", F.from_json("text", f"entries array<struct<{entry}>>, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("_d._corrupt_record").isNotNull() | F.col("_d.entries").isNull()
    return parsed.select(*files.columns, F.when(~bad, F.col("_d.entries")).alias("entries"), F.when(bad, "not valid JSON").alias("error"))


def markdown_rows(files: DataFrame) -> DataFrame:
    """(name, class, check, why) of the rows of tables in texts; heads and rulers don't count, and what stands in further cells belongs to why."""
    lines = files.select("name", F.explode(F.split("text", "\n")).alias("line"))
    rows = lines.where(F.col("line").rlike(r"^\|") & ~F.col("line").rlike(r"^\|\s*-") & ~F.col("line").rlike(r"(?i)^\|\s*category\s*\|"))
    cells = F.transform(F.split("line", r"\|"), lambda c: F.trim(c))
    cells = F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 2, F.lit(0)))
    why = F.array_join(F.filter(F.slice("c", F.lit(3), F.size("c")), lambda w: w != ""), " · ")
    return rows.select("name", cells.alias("c")).select("name", F.get("c", F.lit(0)).alias("class"), F.get("c", F.lit(1)).alias("check"), why.alias("why"))


def usage(lines: DataFrame) -> DataFrame:
    """(response, ord, at, input, cache_5m, cache_1h, cache_read, output) of lines (ord, text) of a session; lines without a message's usage give none."""
    counts = "input_tokens:long,output_tokens:long,cache_read_input_tokens:long,cache_creation_input_tokens:long,cache_creation:struct<ephemeral_5m_input_tokens:long,ephemeral_1h_input_tokens:long>"
    r = lines.select("ord", F.from_json("text", f"requestId string, timestamp string, message struct<id:string,usage:struct<{counts}>>").alias("r")).where("r.message.usage IS NOT NULL")
    u, zero = "r.message.usage.", F.lit(0).cast("long")
    five = F.coalesce(f"{u}cache_creation.ephemeral_5m_input_tokens", F.when(F.col(f"{u}cache_creation").isNull(), F.col(f"{u}cache_creation_input_tokens")), zero)
    shown = {"input": F.coalesce(f"{u}input_tokens", zero), "cache_5m": five, "cache_1h": F.coalesce(f"{u}cache_creation.ephemeral_1h_input_tokens", zero), "cache_read": F.coalesce(f"{u}cache_read_input_tokens", zero), "output": F.coalesce(f"{u}output_tokens", zero)}
    return r.select(F.concat_ws("/", "r.message.id", "r.requestId").alias("response"), "ord", F.to_timestamp("r.timestamp").alias("at"), *(v.alias(k) for k, v in shown.items()))
