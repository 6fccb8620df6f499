"""The tools by name, over a graph; a server with a store behind them, JSON requests and a command line in front."""

from __future__ import annotations

import datetime
import inspect
import json
import sys
from collections.abc import Callable
from typing import IO, Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import __version__
from loomgraph.extract.udf import extract_text
from loomgraph.functions.scalars import language_for
from loomgraph.graph import SCHEMA_VERSION, Graph, current_version, kv_get, load, save
from loomgraph.operators import calls, context, fields, listing, maintain, text, traverse
from loomgraph.operators.paging import page_meta
from loomgraph.plans.indexing import index
from loomgraph.schema import GraphError, InvalidInput
from loomgraph.sources import disk
from loomgraph.sources.scan import changed_files, git_branch, git_head, text_of
from loomgraph.streaming.watch import Reindexer, freshen, index_version, is_stale

TOOLS: dict[str, tuple[Callable[..., Any], str]] = {}
#: JSON schemas of the tools' parameters.
SCHEMAS: dict[str, dict] = {}
#: Tools that change what a server stores: functions of the server.
SERVER_TOOLS: set[str] = set()
LARGE = 512 * 1024
_KINDS = {"int": "integer", "float": "number", "str": "string", "bool": "boolean"}
_BY_NAME = {"path": "string", "pattern": "string", "query": "string", "symbol": "string", "file": "string", "name": "string", "kind": "string", "language": "string", "scope": "string", "group_by": "string", "file_pattern": "string", "node_id": "integer", "node_ids": "array", "seed_symbols": "array", "src_node_id": "integer", "dst_node_id": "integer", "edge_kinds": "array", "relation_types": "array", "start_line": "integer", "end_line": "integer"}


def schema_of(f: Callable, like: Callable | None = None, skip: tuple[str, ...] = ()) -> dict:
    """The JSON schema of a function's parameters behind the first; those of ``like`` stand for its ``**``."""
    params = [p for p in list(inspect.signature(f).parameters.values())[1:] if p.kind is not p.VAR_KEYWORD]
    if like is not None:
        params += [p for p in list(inspect.signature(like).parameters.values())[1:] if p.name not in {q.name for q in params}]
    found, required = {}, []
    for p in params:
        if p.name in skip or p.kind is p.VAR_KEYWORD:
            continue
        hint = str(p.annotation) if p.annotation is not p.empty else ""
        kinds = ["array"] if hint.startswith("list") else [_KINDS[k] for k in hint.replace(" ", "").split("|") if k in _KINDS] + ["array"] * ("|list[" in hint.replace(" ", ""))
        if not kinds and p.default not in (p.empty, None):
            kinds = [_KINDS[type(p.default).__name__]]
        kinds = kinds or [_BY_NAME.get(p.name, "string")]
        found[p.name] = {"type": kinds[0] if len(kinds) == 1 else kinds}
        if p.default is p.empty:
            required.append(p.name)
        elif p.default is not None:
            found[p.name]["default"] = p.default
    return {"type": "object", "properties": found, "required": required, "additionalProperties": False}


def tool(name: str, doc: str = "", like: Callable | None = None, server: bool = False, skip: tuple[str, ...] = ("sources",)) -> Callable:
    """Register a tool: a function of a graph (or a server) and named parameters."""

    def add(f: Callable) -> Callable:
        TOOLS[name] = (f, doc or (f.__doc__ or "").strip().split("\n")[0] or (like.__doc__ or "").strip().split("\n")[0] if like or f.__doc__ or doc else name.replace("_", " "))
        SCHEMAS[name] = schema_of(f, like, skip)
        if server:
            SERVER_TOOLS.add(name)
        return f

    return add


_IS = {"integer": lambda v: isinstance(v, int) and not isinstance(v, bool), "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool), "string": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool), "array": lambda v: isinstance(v, list)}


def check(name: str, params: dict) -> None:
    """Raise InvalidInput for parameters that are missing, unknown or of another type; null stands for a default."""
    schema = SCHEMAS[name]
    if missing := [p for p in schema["required"] if params.get(p) is None]:
        raise InvalidInput(f"{name} needs {', '.join(missing)}")
    if unknown := [p for p in params if p not in schema["properties"]]:
        raise InvalidInput(f"{name} has no parameter {', '.join(unknown)}")
    for p, value in params.items():
        kinds = schema["properties"][p]["type"]
        if value is not None and not any(_IS[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
            raise InvalidInput(f"{p} must be of type {kinds}")


@tool("server_info")
def server_info(g: Graph, root: str = "") -> dict:
    """Versions, and whether the graph is older than its tree."""
    last, head = kv_get(g.kv, "last_index_time"), git_head(root) if root else ""
    age = None
    if last:
        then = datetime.datetime.fromisoformat(last.replace("Z", "+00:00"))
        age = int((datetime.datetime.now(datetime.timezone.utc) - then).total_seconds())
    return {
        "protocol_version": "2024-11-05", "schema_version": SCHEMA_VERSION, "indexer_version": __version__, "capabilities": sorted(TOOLS), "repo_root": kv_get(g.kv, "repo_root"), "db_status": "ok",
        "indexed_branch": kv_get(g.kv, "git_branch"), "indexed_commit": kv_get(g.kv, "git_head"), "current_branch": git_branch(root) if root else "", "current_commit": head, "stale": bool(head) and head != kv_get(g.kv, "git_head"), "index_age_seconds": age,
    }


def _paged(rows: DataFrame, order: list, limit: int, offset: int) -> dict:
    return {"results": rows.orderBy(*order).offset(offset).limit(limit), "meta": page_meta(rows, limit, offset)}


tool("repo_stats")(lambda g: {"counts": listing.repo_stats(g), "roots": listing.root_stats(g)})
tool("file_search")(lambda g, pattern, language=None, limit=50, offset=0: _paged(listing.file_search(g, pattern, language), ["path"], limit, offset))
tool("dir_list")(lambda g, path=".", limit=200, offset=0: _paged(listing.dir_list_or_roots(g, path), ["path"], limit, offset))
tool("dir_tree")(lambda g, path=".", depth=1, max_files=500: {"tree": listing.cap_tree(listing.dir_tree(g, path, depth), max_files)})
tool("symbol_search", like=listing.symbol_search)(lambda g, query, **o: {"results": listing.symbol_search(g, query, **o)})


@tool("symbol_list")
def symbol_list(g: Graph, kind: str | None = None, file_path: str | None = None, name_glob: str | None = None, min_span_lines: int = 0, limit: int = 200, offset: int = 0, max_bytes: int = 16_000, compact: bool = False, include_handles: bool = False) -> dict:
    """Symbols under filters, within a page and a byte budget."""
    rows = listing.candidates_of(g, [kind] if kind else None, file_path, name_glob)
    return {"results": listing.symbol_list(rows, min_span_lines, limit, offset, max_bytes, compact, include_handles), "meta": listing.symbol_list_meta(rows, min_span_lines)}


@tool("symbols_in_path")
def symbols_in_path(g: Graph, path: str, kind: str | list[str] | None = None, recursive: bool = True, min_span_lines: int = 0, limit: int = 200, offset: int = 0, max_bytes: int = 16_000, compact: bool = False, include_handles: bool = False) -> dict:
    """Symbols of a file or below a directory."""
    rows = listing.symbols_in_path(g, path, [kind] if isinstance(kind, str) else kind, recursive)
    return {"results": listing.symbol_list(rows, min_span_lines, limit, offset, max_bytes, compact, include_handles), "meta": listing.symbol_list_meta(rows, min_span_lines)}


def _rows(df: DataFrame) -> list[dict]:
    return [json.loads(r["j"]) for r in df.select(F.to_json(F.struct("*")).alias("j")).collect()]


@tool("symbol_get")
def symbol_get(g: Graph, node_id: int | None = None, symbol: str | None = None, file: str | None = None, include_source: bool = True, max_source_lines: int = 0) -> dict:
    """A symbol with its source as it is on disk, and whether the file changed since it was indexed."""
    found = _rows(context.symbol_get(g, [listing.resolve_node(g, node_id, symbol, file)]))
    return {"symbol": disk.with_sources(g, found, max_source_lines) if include_source else found}


@tool("symbol_get_batch")
def symbol_get_batch(g: Graph, node_ids: list[int], include_source: bool = False, max_source_lines: int = 0) -> dict:
    """Symbols by id, in the order asked for."""
    found = _rows(context.symbol_get(g, node_ids).orderBy("pos"))
    return {"results": disk.with_sources(g, found, max_source_lines) if include_source else found}


@tool("callers_approx")
def callers_approx(g: Graph, node_id: int | None = None, symbol: str | None = None, file: str | None = None, limit: int = 50, min_confidence: float = 0.0, group_by: str | None = None, mode: str = "exact_then_candidates", include_candidates: bool | None = None, receiver: str | None = None, response_mode: str | None = None, top_n: int = 10, max_bytes: int = 16_000) -> dict:
    """Callers of a symbol, exact ones and scored candidates."""
    node_id = listing.resolve_node(g, node_id, symbol, file)
    if include_candidates is not None:
        mode = "exact_plus_candidates" if include_candidates else "exact"
    if group_by:
        return {"groups": calls.grouped(calls.callers(g, node_id, min_confidence), group_by)}
    if response_mode == "lean":
        return {"results": calls.callers_lean(g, node_id, top_n, min_confidence, min(max_bytes, 4096))}
    return calls.callers_approx(g, node_id, limit, min_confidence, mode, receiver, max_bytes)


tool("callees_approx")(lambda g, node_id=None, symbol=None, file=None, limit=50, group_by=None: {"groups": calls.grouped(calls.callees(g, listing.resolve_node(g, node_id, symbol, file)), group_by, "callee_name")} if group_by else {"results": calls.callees_page(g, listing.resolve_node(g, node_id, symbol, file), limit)})
tool("references")(lambda g, node_id=None, symbol=None, file=None, limit=50: {"results": calls.references(g, listing.resolve_node(g, node_id, symbol, file), limit)})
tool("file_summary")(lambda g, path, limit=200, offset=0: _paged(listing.file_summary(g, listing.resolve_file(g, path)), ["start_line", "node_id"], limit, offset))
tool("file_overview")(lambda g, path: {"symbols": listing.file_overview(g, listing.resolve_file(g, path)).orderBy("start_line", "name")})


@tool("context_for")
def context_for(g: Graph, node_id: int | None = None, symbol: str | None = None, file: str | None = None, include_source: bool = False, max_source_lines: int = 0, max_callers: int = 10, max_callees: int = 10) -> dict:
    """A symbol, its callers, callees, container, siblings and base types."""
    out = context.context_for(g, node_id, symbol, file, None, max_callers, max_callees)
    return {**out, "symbol": disk.with_sources(g, _rows(out["symbol"]), max_source_lines)} if include_source else out


tool("context_by_name", "The context of the only symbol of a name, or the candidates.")(lambda g, name, file_pattern=None, max_callers=10, max_callees=10: context.context_by_name(g, name, file_pattern, max_callers=max_callers, max_callees=max_callees))
tool("entrypoints")(lambda g, scope=None, limit=20: {"results": listing.entrypoints(g, scope, limit)})


@tool("impact_of")
def impact_of(g: Graph, node_id: int | None = None, symbol: str | None = None, file: str | None = None, depth: int = 2, max_nodes: int = 50) -> dict:
    """What depends on a symbol."""
    rows = traverse.impact_of(g, listing.resolve_node(g, node_id, symbol, file), depth, max_nodes)
    return {"impacted": rows, "impacted_files": traverse.impacted_files(rows)}


@tool("detect_changes")
def detect_changes(g: Graph, repo_root: str | None = None, since: str | None = None, file_pattern: str | None = None, depth: int = 2, min_confidence: float = 0.5, paths: list[str] | None = None) -> dict:
    """Symbols in files that differ from a revision (or in given paths), and their callers."""
    if paths is None and not (repo_root and since):
        raise InvalidInput("repo_root and since, or paths, are needed")
    changed = changed_files(g.spark, repo_root, since) if paths is None else g.spark.createDataFrame([(p,) for p in paths], "path string")
    symbols, hit = traverse.changed_symbols(g, changed, file_pattern), traverse.detect_changes(g, changed, file_pattern, depth, min_confidence)
    return {"changed_files": changed, "changed_symbols": symbols, "impacted_symbols": hit, "summary": traverse.change_summary(changed, symbols, hit)}


tool("file_deps")(lambda g, path: {"deps": traverse.file_deps(g, path)})
tool("subgraph", like=traverse.subgraph, skip=("seeds",))(lambda g, seed_symbols, **o: traverse.subgraph(g, seed_symbols, **o))
tool("shortest_path", like=traverse.shortest_path, skip=("src", "dst"))(lambda g, src_node_id, dst_node_id, **o: {"path": traverse.shortest_path(g, src_node_id, dst_node_id, **o)})
tool("find_implementations")(lambda g, symbol, limit=50: {"results": listing.find_implementations(g, symbol, limit)})
tool("method_fields")(lambda g, node_id: {"fields": fields.field_use(g, node_id), "calls": fields.method_calls(g, node_id)})
tool("dependency_cluster")(lambda g, path: {"clusters": fields.dependency_clusters(g, only=g.files.where(F.col("path") == listing.resolve_file(g, path)).first()["id"])})
tool("code_search", like=text.code_search)(lambda g, query, **o: {"results": text.code_search(g, query, **o)})
tool("workspace_list")(lambda g: {"roots": maintain.workspace_list(g)})
tool("doctor")(lambda g: dict(zip(("violations", "counts", "exit_code"), maintain.doctor(g))))
tool("source_at", "Lines of an indexed file, as they are on disk.")(lambda g, path, start_line, end_line: {"source": disk.source_at(g, path, start_line, end_line)})


class Server:
    """A stored graph and what keeps it up to date; tools run on its latest version.

    ``policy`` says what happens to a graph that is older than its tree before
    a query: eager (index first), normal (index in the background), lazy, off.
    """

    def __init__(self, spark: SparkSession, store: str, root: str = "", policy: str = "lazy") -> None:
        self.spark, self.store, self.root, self.policy = spark, store, root, policy
        self.version, self._graph = 0, None
        self.reindexer = Reindexer(self.reindex_now)

    @property
    def graph(self) -> Graph:
        latest = current_version(self.spark, self.store)
        if latest != self.version or self._graph is None:
            self._graph, self.version = load(self.spark, self.store), latest
        return self._graph

    def reindex_now(self) -> int:
        return index_version(self.spark, self.root or kv_get(self.graph.kv, "repo_root"), self.store)

    def put(self, g: Graph) -> int:
        return save(g, self.store)

    def call(self, name: str, params: dict | None = None) -> dict:
        if name in SERVER_TOOLS:
            return call(self, name, params)
        if self.policy in ("eager", "normal") and self.root:
            freshen(self.policy, is_stale(self.graph, self.root), self.reindex_now, self.reindexer)
        return call(self.graph, name, params)


@tool("reindex", server=True)
def reindex(server: Server, wait: bool = False) -> dict:
    """Index what changed, in the background unless waited for; requests during a run are served by one more run."""
    if not wait:
        return {"status": server.reindexer.request()}
    return {"status": "done", "version": server.reindex_now()}


@tool("workspace_add", server=True)
def workspace_add(server: Server, path: str) -> dict:
    """Add another tree to the workspace: from its own store, if it has one, else indexed now."""
    warnings = _rows(maintain.overlap_warnings(server.graph.roots, path))
    own = f"{path.rstrip('/')}/.loomgraph"
    other = load(server.spark, own) if current_version(server.spark, own) else index(server.spark, path)
    version = server.put(maintain.workspace_add(server.graph, other, path))
    return {"version": version, "warnings": warnings, "roots": maintain.workspace_list(server.graph)}


@tool("workspace_remove", server=True)
def workspace_remove(server: Server, path: str) -> dict:
    """Take a tree out of the workspace."""
    version = server.put(maintain.workspace_remove(server.graph, path))
    return {"version": version, "roots": maintain.workspace_list(server.graph)}


def plain(value: Any) -> Any:
    """DataFrames as lists of objects, whatever holds them."""
    if isinstance(value, DataFrame):
        return _rows(value)
    return {k: plain(v) for k, v in value.items()} if isinstance(value, dict) else value


def call(g: Graph | Server, name: str, params: dict | None = None) -> dict:
    """A tool's answer as JSON values; large answers that have no pages say so."""
    if name not in TOOLS:
        raise InvalidInput(f"unknown tool: {name}")
    params = params or {}
    check(name, params)
    if name in SERVER_TOOLS and not isinstance(g, Server):
        raise InvalidInput(f"{name} needs a server with a store")
    out = plain(TOOLS[name][0](g, **{k: v for k, v in params.items() if v is not None}))
    if len(json.dumps(out)) > LARGE and "meta" not in out:
        out["_truncated"] = True
    return out


def answer(g: Graph | Server, line: str) -> str | None:
    """The JSON-RPC answer to one line; None for notifications."""
    err = lambda i, code, message, data=None: json.dumps({"jsonrpc": "2.0", "id": i, "error": {"code": code, "message": message} | ({"data": data} if data else {})})
    try:
        msg = json.loads(line)
    except ValueError:
        return err(None, -32700, "parse error")
    if not isinstance(msg, dict) or "method" not in msg:
        return err(msg.get("id") if isinstance(msg, dict) else None, -32600, "invalid request")
    i, method, params = msg.get("id"), msg["method"], msg.get("params") or {}
    if i is None:
        return None
    if method == "initialize":
        result: Any = {"protocolVersion": "2024-11-05", "serverInfo": {"name": "loomgraph", "version": __version__}, "capabilities": {"tools": {}}}
    elif method == "tools/list":
        result = {"tools": [{"name": n, "description": d, "inputSchema": SCHEMAS[n]} for n, (_, d) in sorted(TOOLS.items())]}
    elif method == "tools/call":
        try:
            result = {"content": [{"type": "text", "text": json.dumps((g.call if isinstance(g, Server) else lambda *a: call(g, *a))(params.get("name", ""), params.get("arguments")))}]}
        except GraphError as e:
            return err(i, e.code, str(e), {"error_code": e.error_code})
        except Exception as e:  # whatever fails in one request must not end the server
            return err(i, GraphError.code, f"{type(e).__name__}: {e}"[:2000], {"error_code": GraphError.error_code})
    else:
        return err(i, -32601, f"no method {method}")
    return json.dumps({"jsonrpc": "2.0", "id": i, "result": result})


def serve(g: Graph | Server, source: IO[str], sink: IO[str], log: IO[str] | None = None) -> None:
    """Answer lines until the source ends; calls may be logged, one JSON object a line."""
    for line in source:
        if line.strip() and (out := answer(g, line)):
            sink.write(out + "\n")
            sink.flush()
            if log:
                log.write(json.dumps({"request": line.strip(), "answer": out}) + "\n")


def parse_file(path: str) -> dict:
    """What the extractor finds in one file."""
    language = language_for("." + path.rsplit(".", 1)[-1])
    if not language:
        raise InvalidInput(f"no known language: {path}")
    with open(path, "rb") as f:
        body, fault = text_of(f.read())
    return {**extract_text(path, language, body), "language": language, "read_error": fault}


def main(args: list[str], out: IO[str] | None = None) -> int:
    """Commands: query STORE TOOL [PARAMS] | index ROOT STORE | serve STORE [ROOT [POLICY]] | doctor STORE | parse-file PATH. The exit code is 0, 1 on an error, 2 for an unknown tool, 3 for a schema that is too new."""
    out = out or sys.stdout
    least = {"query": 3, "index": 3, "serve": 2, "doctor": 2, "parse-file": 2}
    if not args or len(args) < least.get(args[0], 99):
        out.write(main.__doc__ + "\n")
        return 1
    if args[0] == "query" and args[2] not in TOOLS:
        return 2
    try:
        if args[0] == "parse-file":
            found: Any = parse_file(args[1])
        else:
            spark = SparkSession.builder.getOrCreate()
            if args[0] == "query":
                found = Server(spark, args[1]).call(args[2], json.loads(args[3]) if len(args) > 3 else {})
            elif args[0] == "index":
                found = {"version": index_version(spark, args[1], args[2])}
            elif args[0] == "doctor":
                found = call(load(spark, args[1]), "doctor")
                out.write(json.dumps(found) + "\n")
                return int(found["exit_code"])
            else:
                serve(Server(spark, args[1], *args[2:4]), sys.stdin, out)
                return 0
        out.write(json.dumps(found) + "\n")
        return 0
    except (GraphError, OSError) as e:
        out.write(json.dumps({"error": str(e), "error_code": getattr(e, "error_code", "internal")}) + "\n")
        return 3 if "schema version" in str(e) else 1
