"""The engine's tools for clients that speak JSON-RPC 2.0 over lines of standard input and output, as the Model Context Protocol has it."""

from __future__ import annotations

import inspect
import json
import sys
from collections.abc import Iterable
from typing import Any, TextIO

from docmill.plans.tools import Engine

PROTOCOL = "2025-06-18"
TOOLS = (
    "search get_context list_sources reload search_components get_component_info list_component_categories explore_category find_related_components "
    "search_source get_component_source find_component_usage"
).split()
_KINDS = {"str": "string", "int": "integer", "bool": "boolean"}


def described(name: str) -> dict[str, Any]:
    """A tool's name, text and input schema, from its method."""
    method = getattr(Engine, name)
    parameters = [p for p in inspect.signature(method).parameters.values() if p.name != "self"]
    properties = {p.name: {"type": _KINDS[str(p.annotation).split(" | ")[0]]} for p in parameters}
    required = [p.name for p in parameters if p.default is inspect.Parameter.empty]
    return {"name": name, "description": inspect.getdoc(method) or name.replace("_", " "), "inputSchema": {"type": "object", "properties": properties, "required": required}}


def answer(engine: Engine, request: dict[str, Any]) -> dict[str, Any] | None:
    """The reply to a request; None to a notification. What a tool raises is the tool's result, marked as an error."""
    method, params = request.get("method"), request.get("params") or {}
    if "id" not in request:
        return None
    reply: dict[str, Any] = {"jsonrpc": "2.0", "id": request["id"]}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "docmill", "version": "1"}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": [described(t) for t in TOOLS]}}
    if method != "tools/call":
        return reply | {"error": {"code": -32601, "message": f"unknown method {method}"}}
    if params.get("name") not in TOOLS:
        return reply | {"error": {"code": -32602, "message": f"unknown tool {params.get('name')}"}}
    try:
        rows = [r.asDict(recursive=True) for r in getattr(engine, params["name"])(**params.get("arguments") or {}).collect()]
        return reply | {"result": {"content": [{"type": "text", "text": json.dumps(rows, default=str, ensure_ascii=False)}], "isError": False}}
    except Exception as e:  # noqa: BLE001  told to the client
        return reply | {"result": {"content": [{"type": "text", "text": f"{type(e).__name__}: {e}"}], "isError": True}}


def serve(engine: Engine, lines: Iterable[str] = sys.stdin, out: TextIO = sys.stdout) -> None:
    """Answers every line until the input ends."""
    for line in lines:
        if not line.strip():
            continue
        try:
            reply = answer(engine, json.loads(line))
        except json.JSONDecodeError as e:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
        if reply is not None:
            print(json.dumps(reply, ensure_ascii=False), file=out, flush=True)
