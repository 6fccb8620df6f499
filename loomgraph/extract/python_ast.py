"""Python files, by the standard parser."""

from __future__ import annotations

import ast

from loomgraph.extract.base import MAX_DEPTH, Found
from loomgraph.functions.signatures import argument_shape


def extract(text: str, found: Found) -> None:
    """Functions, classes and assigned names; calls by their full callee text; imports by their statement."""
    tree = ast.parse(text)
    lines = text.splitlines()

    def comment_above(line: int) -> str | None:
        out, i = [], line - 2
        while i >= 0 and lines[i].strip().startswith("#"):
            out.append(lines[i].strip().lstrip("#").strip())
            i -= 1
        return "\n".join(reversed(out))[:500] or None

    def visit(node: ast.AST, holder: int, depth: int) -> None:
        if depth > MAX_DEPTH:
            found.truncated = True
            return
        inner = holder
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            start, end = (node.lineno, node.col_offset), (node.end_lineno, node.end_col_offset)
            is_class = isinstance(node, ast.ClassDef)
            signature = None if is_class else f"def {node.name}({ast.unparse(node.args)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")
            inner = found.symbol("class" if is_class else "function", node.name, start, end, signature and signature[:512], comment_above(min([node.lineno, *(d.lineno for d in node.decorator_list)])))
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if isinstance(target, ast.Name):
                    found.symbol("variable", target.id, (target.lineno, target.col_offset), (node.end_lineno, node.end_col_offset))
        elif isinstance(node, ast.Call):
            shapes = [argument_shape(ast.get_source_segment(text, a) or "") for a in node.args] + [argument_shape(ast.get_source_segment(text, k.value) or "") for k in node.keywords]
            found.ref("call", ast.get_source_segment(text, node.func) or "", (node.lineno, node.col_offset), (node.end_lineno, node.end_col_offset), holder, "call_expression", len(shapes), ",".join(shapes)[:128])
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            found.ref("include", ast.get_source_segment(text, node) or "", (node.lineno, node.col_offset), (node.end_lineno, node.end_col_offset), holder, "import")
        for child in ast.iter_child_nodes(node):
            visit(child, inner if inner >= 0 else holder, depth + 1)

    visit(tree, -1, 0)
