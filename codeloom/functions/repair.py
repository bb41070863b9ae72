"""Functions over model output and sensitive texts that need a program for each text: Arrow batches of them."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _repaired(text: str | None) -> str | None:
    """The JSON object in a text, its comments, trailing commas and missing ends mended; null if there is none."""
    if not text:
        return None
    start = text.find("{")
    if start < 0:
        return None
    out, stack, quoted, i = [], [], False, start
    while i < len(text):
        c = text[i]
        if quoted:
            if c == "\\":
                out.append(text[i : i + 2])
                i += 2
                continue
            quoted = c != '"'
            out.append(c)
        elif c == '"':
            quoted = True
            out.append(c)
        elif text.startswith("//", i):
            i = text.find("\n", i)
            if i < 0:
                break
            continue
        elif text.startswith("/*", i):
            i = text.find("*/", i) + 2
            if i < 2:
                break
            continue
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
            out.append(c)
        elif c in "}]":
            if not stack or stack[-1] != c:
                return None
            while out and out[-1].isspace():
                out.pop()
            if out[-1] == ",":
                out.pop()
            out.append(stack.pop())
            if not stack:
                break
        else:
            out.append(c)
        i += 1
    if quoted:
        out.append('"')
    joined = re.sub(r",\s*$", "", "".join(out)) + "".join(reversed(stack))
    try:
        return json.dumps(json.loads(joined), ensure_ascii=False)
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def repair_json(s: pd.Series) -> pd.Series:
    return s.map(_repaired)


def structured_output(text: Column) -> Column:
    """The JSON object of a model's answer: in a fenced block, else the whole text, else from the first brace, mended."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull() & c.startswith("{"), c)
    return F.coalesce(valid(fenced), valid(F.trim(text)), repair_json(text))


@F.pandas_udf(T.StringType())
def cut_repetition(s: pd.Series) -> pd.Series:
    """A text whose end repeats a phrase of 15 to 99 characters four times or more, cut after the first."""

    def one(text: str | None) -> str | None:
        if not text:
            return text
        tail = text[-2000:]
        for n in range(15, 100):
            phrase = tail[-n:]
            if len(phrase) == n and tail.endswith(phrase * 4):
                k = len(text)
                while text[:k].endswith(phrase):
                    k -= n
                return text[: k + n]
        return text

    return s.map(one)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("vault", T.MapType(T.StringType(), T.StringType()))]))
def anonymise(s: pd.Series) -> pd.DataFrame:
    """E-mail addresses, IP addresses and telephone numbers replaced by numbered names, which the vault maps back."""
    kinds = [("EMAIL", re.compile(r"[\w.+-]+@[\w-]+\.[\w.]*\w")), ("IP", re.compile(r"\b\d{1,3}(?:\.\d{1,3}){3}\b")), ("PHONE", re.compile(r"\+?\d[\d\s().-]{8,}\d"))]

    def one(text: str | None) -> tuple[str | None, dict[str, str]]:
        vault: dict[str, str] = {}
        names: dict[str, str] = {}
        if text is None:
            return None, vault
        for kind, pattern in kinds:

            def name(m: re.Match[str], kind: str = kind) -> str:
                if m[0] not in names:
                    names[m[0]] = f"<{kind}_{sum(k.startswith(f'<{kind}_') for k in vault) + 1}>"
                    vault[names[m[0]]] = m[0]
                return names[m[0]]

            text = pattern.sub(name, text)
        return text, vault

    return pd.DataFrame([one(t) for t in s], columns=["text", "vault"])


def restore(text: Column, vault: Column) -> Column:
    return F.aggregate(F.map_entries(vault), text, lambda t, e: F.replace(t, e.key, e.value))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("arguments", T.StringType())])))
def tool_calls(s: pd.Series) -> pd.Series:
    """The calls in a model's answer: objects with a name (or tool, or function) and arguments (or parameters, or input), one or in a list."""

    def one(text: str | None) -> list[dict[str, str]]:
        out: list[dict[str, str]] = []
        decoder = json.JSONDecoder()
        at = 0
        while text and (at := min((i for i in (text.find("{", at), text.find("[", at)) if i >= 0), default=-1)) >= 0:
            try:
                value, end = decoder.raw_decode(text, at)
            except ValueError:
                at += 1
                continue
            for x in value if isinstance(value, list) else [value]:
                inner = x.get("function") if isinstance(x, dict) and isinstance(x.get("function"), dict) else x
                if isinstance(inner, dict):
                    name = next((inner[k] for k in ("name", "tool", "function") if isinstance(inner.get(k), str)), None)
                    given = next((inner[k] for k in ("arguments", "parameters", "input") if k in inner), None)
                    if name and given is not None:
                        out.append({"name": name, "arguments": given if isinstance(given, str) else json.dumps(given, ensure_ascii=False)})
            at = end
        return out

    return s.map(one)
