"""Parsing of model answers and JSON payloads."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .codes import SHAPE, norm


def selected_codes(answer: Column) -> Column:
    """Codes of the outermost JSON object's "selected" list; without one, all code shapes in the answer."""
    body = F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)\{.*\}", 0)
    parsed = F.from_json(F.nullif(body, F.lit("")), "selected array<string>")["selected"]
    listed = F.filter(F.transform(parsed, norm), lambda x: x != "")
    scraped = F.transform(F.regexp_extract_all(F.upper(F.coalesce(answer, F.lit(""))), F.lit(rf"(?<![A-Z0-9]){SHAPE}(?![A-Z0-9])"), F.lit(0)), F.upper)
    return F.coalesce(listed, scraped)


def confidence(value: Column) -> Column:
    """A confidence in 0 to 1: values over 10 are percent, over 1 tenths; unreadable is null."""
    v = value.try_cast("double")
    v = F.when(v > 10, v / 100).when(v > 1, v / 10).otherwise(v)
    return F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def candidate_codes(answer: Column) -> Column:
    """Array of (code, confidence) of "candidate_codes" (objects), else of "selected"."""
    body = F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)\{.*\}", 0)
    objects = F.from_json(F.nullif(body, F.lit("")), "candidate_codes array<struct<code:string,confidence:string>>")["candidate_codes"]
    rich = F.transform(F.filter(objects, lambda x: x["code"].isNotNull()), lambda x: F.struct(norm(x["code"]).alias("code"), confidence(x["confidence"]).alias("confidence")))
    plain = F.transform(selected_codes(answer), lambda c: F.struct(c.alias("code"), F.lit(None).cast("double").alias("confidence")))
    return F.coalesce(F.when(F.size(rich) > 0, rich), plain)


def verdict(answer: Column, length: int = 300) -> Column:
    """Struct (verdict, rationale) of a judge's answer; unreadable is PARSE_ERROR with the answer's beginning."""
    body = F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)\{.*\}", 0)
    p = F.from_json(F.nullif(body, F.lit("")), "verdict string, rationale string")
    return F.when(p["verdict"].isNotNull(), F.struct(F.upper(F.trim(p["verdict"])).alias("verdict"), F.coalesce(p["rationale"], F.lit("")).alias("rationale"))).otherwise(
        F.struct(F.lit("PARSE_ERROR").alias("verdict"), F.substring(F.coalesce(answer, F.lit("")), 1, length).alias("rationale"))
    )


def dig(payload: Column, path: str) -> Column:
    return F.get_json_object(payload, "$." + path)


def header_payload(payload: Column, taxonomy: list[str]) -> Column:
    """Map of sections of the taxonomy to their distinct, trimmed headers."""
    m = F.from_json(payload, "map<string,array<string>>")
    kept = F.map_filter(m, lambda k, v: k.isin(*taxonomy) & v.isNotNull())
    return F.transform_values(kept, lambda k, v: F.array_distinct(F.filter(F.transform(v, lambda x: F.trim(x)), lambda x: x != "")))


def lenient_json(text: str):
    """The first balanced JSON object of a text, fences stripped; None if there is none."""
    t = re.sub(r"```(?:json)?", "", text or "")
    start = t.find("{")
    while start >= 0:
        depth, quoted, escaped = 0, False, False
        for i in range(start, len(t)):
            c = t[i]
            if quoted:
                quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if depth == 0:
                    try:
                        return json.loads(t[start : i + 1])
                    except ValueError:
                        break
        start = t.find("{", start + 1)
    return None


def concepts(text: str) -> list[dict]:
    """Concepts of an answer, one entry per search phrase; blanks collapsed, repeats in any case dropped, the first kept."""
    data = lenient_json(text) or {}
    out, seen = [], set()
    for item in data.get("concepts") or data.get("procedures") or []:
        item = item if isinstance(item, dict) else {"concept": str(item)}
        phrases = item.get("search_phrases") or [item.get("concept") or item.get("name") or ""]
        for p in [phrases] if isinstance(phrases, str) else phrases:
            phrase = " ".join(str(p).split())
            if phrase and phrase.lower() not in seen:
                seen.add(phrase.lower())
                out.append({"phrase": phrase, "evidence": " ".join(str(item.get("evidence") or item.get("supporting_phrase") or "").split())})
    return out


def concept_list(answer: Column) -> Column:
    """``concepts`` of a column of answers: array of (phrase, evidence)."""
    @F.pandas_udf("array<struct<phrase:string,evidence:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([concepts(t) for t in texts], dtype=object)

    return run(answer)


def first_object(answer: Column) -> Column:
    """``lenient_json`` of a column of answers, as JSON with sorted keys; null where there is none."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if (o := lenient_json(t)) is None else json.dumps(o, sort_keys=True) for t in texts], dtype=object)

    return run(answer)
