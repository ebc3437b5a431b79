"""Facts of the functions in a Python file, from the syntax tree: a helper for one row."""

from __future__ import annotations

import ast
import io
import re
import tokenize

NESTED = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)
LOOPS = (ast.For, ast.AsyncFor, ast.While)


def _body(function) -> list:
    """The statements of a def, or a lambda's expression; decorators and defaults do not belong to it."""
    return function.body if isinstance(function.body, list) else [function.body]


def _given(function) -> list:
    """Decorators and default values, which are evaluated outside of the function."""
    return [*getattr(function, "decorator_list", []), *function.args.defaults, *(d for d in function.args.kw_defaults if d is not None)]


def _parameters(node) -> int:
    a = node.args
    return len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg)


def _is_elif(node: ast.If, lines: list[str]) -> bool:
    """An else that holds nothing but an if which the source writes as elif."""
    only = node.orelse[0] if len(node.orelse) == 1 and isinstance(node.orelse[0], ast.If) else None
    return only is not None and lines[only.lineno - 1][only.col_offset :].startswith("elif")


def _children(node) -> list:
    return [] if isinstance(node, ast.JoinedStr) else list(ast.iter_child_nodes(node))


def _is_default(case: ast.match_case) -> bool:
    return isinstance(case.pattern, ast.MatchAs) and case.pattern.pattern is None and case.guard is None


def cyclomatic(function) -> int:
    """1, and 1 for each if, loop, handler, conditional, case but the default, comprehension clause and logical operator."""
    total, left = 1, _body(function)
    left = list(left)
    while left:
        node = left.pop()
        if isinstance(node, NESTED):
            continue
        total += isinstance(node, (ast.If, ast.IfExp, ast.ExceptHandler, *LOOPS))
        total += isinstance(node, ast.match_case) and not _is_default(node)
        if isinstance(node, ast.comprehension):
            total += 1 + len(node.ifs)
        if isinstance(node, ast.BoolOp):
            total += len(node.values) - 1
        left += _children(node)
    return total


def _sequence(node: ast.BoolOp) -> list[str]:
    """The operators of a logical expression from left to right, nested ones included."""
    out: list[str] = []
    for i, value in enumerate(node.values):
        if i:
            out.append(type(node.op).__name__)
        if isinstance(value, ast.BoolOp):
            out += _sequence(value)
    return out


def cognitive(function, lines: list[str]) -> int:
    """1 and the nesting for what breaks the flow; 1 for elif, else and each change of a logical operator."""

    def many(nodes, depth):
        return sum(one(n, depth) for n in nodes)

    def branch(node: ast.If, depth: int, is_elif: bool) -> int:
        total = (1 if is_elif else 1 + depth) + one(node.test, depth) + many(node.body, depth + 1)
        if _is_elif(node, lines):
            return total + branch(node.orelse[0], depth, True)
        return total + (1 + many(node.orelse, depth + 1) if node.orelse else 0)

    def one(node, depth):
        if isinstance(node, ast.If):
            return branch(node, depth, False)
        if isinstance(node, LOOPS):
            head = [node.test] if isinstance(node, ast.While) else [node.target, node.iter]
            return 1 + depth + many(head, depth) + many(node.body, depth + 1) + (1 + many(node.orelse, depth + 1) if node.orelse else 0)
        if isinstance(node, ast.ExceptHandler):
            return 1 + depth + many(node.body, depth + 1)
        if isinstance(node, ast.IfExp):
            return 1 + depth + one(node.test, depth) + one(node.body, depth + 1) + one(node.orelse, depth + 1)
        if isinstance(node, ast.Match):
            return 1 + depth + one(node.subject, depth) + sum(many(_children(c), depth + 1) for c in node.cases)
        if isinstance(node, ast.BoolOp):
            ops = _sequence(node)
            own = 1 + sum(a != b for a, b in zip(ops, ops[1:]))
            leaves, left = [], list(node.values)
            while left:
                v = left.pop()
                if isinstance(v, ast.BoolOp):
                    left += v.values
                else:
                    leaves.append(v)
            return own + many(leaves, depth)
        if isinstance(node, NESTED):
            return many(_given(node), depth) + many(_body(node), depth + 1)
        return many(_children(node), depth)

    return many(_body(function), 0)


def nesting(function) -> int:
    """The most breaks of the flow inside each other; an elif is inside its if."""

    def deepest(nodes, depth):
        return max((inside(n, depth) for n in nodes), default=depth)

    def inside(node, depth):
        if isinstance(node, NESTED):
            return depth
        if isinstance(node, (ast.If, ast.IfExp, ast.ExceptHandler, ast.Match, *LOOPS)):
            depth += 1
        return deepest(_children(node), depth)

    return deepest(_body(function), 0)


def _comments(code: str) -> dict[int, int]:
    """line -> the column where its comment begins; a # inside a string is none."""
    try:
        return {t.start[0]: t.start[1] for t in tokenize.generate_tokens(io.StringIO(code, newline=None).readline) if t.type == tokenize.COMMENT}
    except (tokenize.TokenError, SyntaxError):
        return {}


def _source_lines(lines: list[str], comments: dict[int, int], start: int, end: int) -> int:
    """Lines that are neither blank nor a comment alone."""
    return sum(1 for no in range(start, end + 1) if lines[no - 1][: comments.get(no)].strip())


def _dynamic(call: ast.Call) -> str | None:
    """The literal name that __import__ or importlib.import_module loads."""
    called = ast.unparse(call.func)
    named = called in ("__import__", "importlib.import_module") and call.args and isinstance(call.args[0], ast.Constant)
    return call.args[0].value if named and isinstance(call.args[0].value, str) else None


def facts(code: str) -> dict:
    """functions, imports, the lines of import statements, and the error, if the file cannot be parsed (then the others are empty)."""
    try:
        code = code.lstrip("﻿")
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError) as e:
        return {"functions": [], "imports": [], "spans": [], "error": f"{getattr(e, 'lineno', None) or 1}: {e}"[:300]}
    lines, comments = re.split("\r\n|\r|\n", code), _comments(code)
    functions, imports, spans = [], [], []

    def visit(node, class_name, enclosing):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, NESTED):
                name = getattr(child, "name", "<lambda>")
                symbol = ".".join(x for x in (class_name, enclosing, name) if x)
                functions.append((symbol, child.lineno, child.end_lineno, float(cyclomatic(child)), float(cognitive(child, lines)), float(nesting(child)), float(_source_lines(lines, comments, child.lineno, child.end_lineno)), float(_parameters(child))))
                visit(child, class_name, name)
            elif isinstance(child, ast.ClassDef):
                visit(child, child.name, enclosing)
            else:
                if isinstance(child, (ast.Import, ast.ImportFrom)):
                    spans.append((child.lineno, child.end_lineno))
                if isinstance(child, ast.Import):
                    imports.extend((a.name, child.lineno, "static") for a in child.names)
                elif isinstance(child, ast.ImportFrom):
                    base = "." * child.level + (child.module or "")
                    imports.extend((f"{base}{'' if base.endswith('.') else '.'}{a.name}", child.lineno, "static") for a in child.names)
                elif isinstance(child, ast.Call) and (name := _dynamic(child)):
                    imports.append((name, child.lineno, "dynamic"))
                visit(child, class_name, enclosing)

    visit(tree, None, None)
    return {"functions": functions, "imports": imports, "spans": spans, "error": None}
