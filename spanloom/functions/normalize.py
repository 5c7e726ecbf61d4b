"""Message content of several provider formats as one form of blocks (type, text, id, name, data)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = "array<struct<type: string, text: string, id: string, name: string, data: string>>"
_TEXT = {"text", "input_text", "output_text"}


def _block(kind: str, text: str | None = None, id: str | None = None, name: str | None = None, data: object = None) -> dict:
    return {"type": kind, "text": text, "id": id, "name": name, "data": None if data is None else json.dumps(data, sort_keys=True)}


def _tool_use(x: dict) -> dict | None:
    if x.get("type") in ("tool_use", "tool-call", "tool_call"):
        return _block("tool_use", id=x.get("id") or x.get("toolCallId"), name=x.get("name") or x.get("toolName"), data=x.get("input", x.get("args", x.get("arguments"))))
    for key in ("toolUse", "functionCall", "function"):
        if isinstance(x.get(key), dict):
            y = x[key]
            return _block("tool_use", id=y.get("toolUseId") or x.get("id") or y.get("id"), name=y.get("name"), data=y.get("input", y.get("args", y.get("arguments"))))
    return None


def _tool_result(x: dict) -> dict | None:
    if x.get("type") in ("tool_result", "tool-result", "tool_call_response"):
        return _block("tool_result", id=x.get("tool_use_id") or x.get("toolCallId") or x.get("id"), data=x.get("content", x.get("result", x.get("output"))))
    for key in ("toolResult", "functionResponse"):
        if isinstance(x.get(key), dict):
            y = x[key]
            return _block("tool_result", id=y.get("toolUseId") or y.get("id"), name=y.get("name"), data=y.get("content", y.get("response")))
    return None


def _media(x: dict) -> dict | None:
    kind = x.get("type")
    if kind in ("image_url", "input_image"):
        url = x.get("image_url")
        return _block("image", data=url.get("url") if isinstance(url, dict) else url)
    if kind in ("image", "document", "audio", "video", "file", "input_audio", "input_file"):
        return _block(kind.removeprefix("input_"), data=x.get("source", x.get("data", x.get("file", x.get("input_audio")))))
    for key in ("inline_data", "inlineData", "file_data", "fileData"):
        if isinstance(x.get(key), dict):
            mime = str(x[key].get("mime_type") or x[key].get("mimeType") or "")
            return _block(mime.split("/")[0] if mime.split("/")[0] in ("image", "audio", "video") else "file", data=x[key])
    return None


def blocks(value: object) -> list[dict]:
    """Blocks of a parsed JSON value; what no format claims becomes json or unknown, never nothing."""
    if value is None:
        return []
    if isinstance(value, str):
        text = value.strip()
        if text[:1] in "[{" and text:
            try:
                return blocks(json.loads(text))
            except ValueError:
                pass
        return [_block("text", value)] if text else []
    if isinstance(value, list):
        return [b for x in value if x != {} for b in blocks(x)]
    if not isinstance(value, dict):
        return []
    kind = value.get("type")
    if kind in _TEXT and isinstance(value.get("text"), str):
        return [_block("text", value["text"])]
    if kind in ("thinking", "reasoning"):
        return [_block("thinking", value.get("thinking") or value.get("text"))]
    if kind == "redacted_thinking":
        return [_block("redacted_thinking", data=value.get("data"))]
    if kind == "refusal" or isinstance(value.get("refusal"), str):
        return [_block("refusal", value.get("refusal"))]
    for parse in (_tool_use, _tool_result, _media):
        if found := parse(value):
            return [found]
    if value.get("thought") and isinstance(value.get("text"), str):
        return [_block("thinking", value["text"])]
    if set(value) == {"text"} and isinstance(value["text"], str):
        return [_block("text", value["text"])]
    for wrapper in ("message_content", "value", "parts", "content"):
        if wrapper in value and not isinstance(kind, str):
            return blocks(value[wrapper])
    return [_block("unknown", data=value)] if isinstance(kind, str) else [_block("json", data=value)]


def normalized(content: Column) -> Column:
    """Blocks of a column of JSON or plain text, in Arrow batches."""

    @F.pandas_udf(BLOCK)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([blocks(x) for x in texts])

    return run(content)
