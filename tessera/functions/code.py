"""Python programs: their assertions, statistics, snippets, slices, and their execution."""

from __future__ import annotations

import ast
import json
import os
import resource
import subprocess
import sys
import tempfile
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tessera.functions.vectorised import vectorised

# Comparison nodes and their operators.
OPERATORS = {ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Is: "is", ast.IsNot: "is not", ast.In: "in", ast.NotIn: "not in"}
PAIRS = "array<struct<input:string,op:string,output:string>>"
STATS = "struct<valid:boolean,lines:int,branches:int,loops:int,comprehensions:int,subscripts:int,functions:int,imports:array<string>,unused:array<string>,redefined:array<string>>"
SNIPPETS = "array<struct<context:string,code:string,result:string,start_char_idx:int>>"


def valid_syntax(code: str | None) -> bool:
    try:
        ast.parse(code or "")
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return False
    return bool(code)


@vectorised("boolean")
def is_valid(code: pd.Series) -> pd.Series:
    return code.map(valid_syntax)


def assertion_pairs(source: str | None) -> list[tuple[str, str, str]]:
    """(input, op, output) of every assertion that compares two things once; others are left out."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError):
        return []
    found = []
    for node in ast.walk(tree):
        test = node.test if isinstance(node, ast.Assert) else None
        if isinstance(test, ast.Compare) and len(test.ops) == 1:
            found.append((node.lineno, node.col_offset, ast.unparse(test.left), OPERATORS[type(test.ops[0])], ast.unparse(test.comparators[0])))
    return [x[2:] for x in sorted(found)]


@vectorised(PAIRS)
def io_pairs(source: pd.Series) -> pd.Series:
    return source.map(lambda s: [{"input": a, "op": o, "output": b} for a, o, b in assertion_pairs(s)])


def program_stats(code: str | None) -> dict:
    """Counts of control flow and the names that are imported, never read, or bound more than once."""
    out = {"valid": False, "lines": 0, "branches": 0, "loops": 0, "comprehensions": 0, "subscripts": 0, "functions": 0, "imports": [], "unused": [], "redefined": []}
    out["lines"] = sum(bool(x.strip()) for x in (code or "").split("\n"))
    try:
        tree = ast.parse(code or "")
    except (SyntaxError, ValueError):
        return out
    kinds = {"branches": (ast.If, ast.IfExp, ast.Try, ast.Match), "loops": (ast.For, ast.While, ast.AsyncFor), "comprehensions": (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp), "subscripts": (ast.Subscript,), "functions": (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)}
    stored, loaded, imports = Counter(), set(), set()
    for node in ast.walk(tree):
        for name, classes in kinds.items():
            out[name] += isinstance(node, classes)
        if isinstance(node, ast.Name):
            if isinstance(node.ctx, ast.Store):
                stored[node.id] += 1
            else:
                loaded.add(node.id)
        elif isinstance(node, ast.Import):
            imports |= {a.name for a in node.names}
        elif isinstance(node, ast.ImportFrom):
            imports.add(node.module or ".")
    return out | {"valid": bool(code), "imports": sorted(imports), "unused": sorted(set(stored) - loaded), "redefined": sorted(n for n, c in stored.items() if c > 1)}


@vectorised(STATS)
def code_stats(code: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(list(code.map(program_stats)), index=code.index)


FUNCTIONS = "array<struct<name:string,args:array<string>,nested:array<string>,unused:array<string>,overwritten:array<string>,lines:int>>"


def function_traces(code: str | None) -> list[dict]:
    """Of each top-level function: its arguments, the functions within, names never read after their last binding, and names bound again before they were read."""
    if not valid_syntax(code):
        return []
    out = []
    for node in ast.parse(code).body:
        if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        a = node.args
        args = [x.arg for x in [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]]
        events = []
        for n in ast.walk(node):
            if isinstance(n, ast.Name):
                events.append((n.lineno, isinstance(n.ctx, ast.Store), n.col_offset, n.id))
            if isinstance(n, ast.AugAssign) and isinstance(n.target, ast.Name):
                events.append((n.lineno, False, n.col_offset, n.target.id))
        unread, overwritten = set(args), []
        for _, bound, _, name in sorted(events):  # within a line what is read comes first
            if bound:
                if name in unread and name not in overwritten:
                    overwritten.append(name)
                unread.add(name)
            else:
                unread.discard(name)
        nested = [n.name for n in ast.walk(node) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and n is not node]
        out.append({"name": node.name, "args": args, "nested": nested, "unused": sorted(unread), "overwritten": overwritten, "lines": node.end_lineno - node.lineno + 1})
    return out


@vectorised(FUNCTIONS)
def code_functions(code: pd.Series) -> pd.Series:
    return code.map(function_traces)


class _Shown(ast.NodeTransformer):
    """print(x) within a loop appends x to a list, elsewhere it sets a variable."""

    def __init__(self, name: str, listed: bool):
        self.name, self.listed, self.found = name, listed, 0

    def visit_Expr(self, node: ast.Expr) -> ast.AST:
        call = node.value
        if not (isinstance(call, ast.Call) and isinstance(call.func, ast.Name) and call.func.id == "print" and len(call.args) == 1 and not call.keywords):
            return node
        self.found += 1
        place = ast.Name(self.name, ast.Load())
        if self.listed:
            return ast.Expr(ast.Call(ast.Attribute(place, "append", ast.Load()), call.args, []))
        return ast.Assign([ast.Name(self.name, ast.Store())], call.args[0], lineno=node.lineno)


def accumulated(source: str, name: str) -> tuple[list[str], str] | None:
    """(statements, expression): a loop or condition whose prints are gathered in ``name``; None if it is neither or prints nothing."""
    try:
        tree = ast.parse(source)
    except SyntaxError:
        return None
    if len(tree.body) != 1 or not isinstance(tree.body[0], (ast.For, ast.While, ast.If)):
        return None
    listed = not isinstance(tree.body[0], ast.If)
    shown = _Shown(name, listed)
    node = ast.fix_missing_locations(shown.visit(tree.body[0]))
    return ([f"{name} = {'[]' if listed else 'None'}", ast.unparse(node)], name) if shown.found else None


def doctest_snippets(text: str | None) -> list[dict]:
    """Prompts of an interactive session: what ran before, the code, and the result that is shown.

    print(x) becomes x; a loop or condition that prints becomes statements of the context that gather what it prints in
    out_0, out_1 ..., and that name becomes the code.
    """
    out, context, code, result, start, at = [], [], [], [], 0, 0

    def end():
        if code:
            source = "\n".join(code)
            shown = "\n".join(result)
            if shown:
                if gathered := accumulated(source, f"out_{len(out)}"):
                    context.extend(gathered[0])
                    source = gathered[1]
                try:
                    tree = ast.parse(source)
                    last = tree.body[-1].value if tree.body and isinstance(tree.body[-1], ast.Expr) else None
                    if len(tree.body) == 1 and isinstance(last, ast.Call) and isinstance(last.func, ast.Name) and last.func.id == "print" and len(last.args) == 1 and not last.keywords:
                        source = ast.unparse(last.args[0])
                except SyntaxError:
                    pass
                out.append({"context": "\n".join(context), "code": source, "result": shown, "start_char_idx": start})
            else:
                context.append(source)
        code.clear()
        result.clear()

    for line in (text or "").split("\n"):
        bare = line.strip()
        if bare.startswith(">>>"):
            end()
            start = at
            code.append(bare[4:])
        elif bare.startswith("...") and code and not result:
            code.append(bare[4:] if len(bare) > 3 else "")
        elif bare and code:
            result.append(bare)
        elif not bare:
            end()
        at += len(line) + 1
    end()
    return out


@vectorised(SNIPPETS)
def snippets(text: pd.Series) -> pd.Series:
    return text.map(doctest_snippets)


def _names(node: ast.AST, kind: type) -> set[str]:
    return {n.id for n in ast.walk(node) if isinstance(n, ast.Name) and isinstance(n.ctx, kind)}


def definitions_and_uses(code: str) -> list[dict]:
    """For each top-level statement, its line, the names that it binds and those that it reads."""
    rows = []
    for node in ast.parse(code).body:
        bound = _names(node, ast.Store)
        if isinstance(node, (ast.FunctionDef, ast.ClassDef, ast.AsyncFunctionDef)):
            bound = {node.name}
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            bound = {(a.asname or a.name).split(".")[0] for a in node.names}
        read = _names(node, ast.Load) | (_names(node.target, ast.Store) if isinstance(node, ast.AugAssign) else set())
        rows.append({"line": node.lineno, "defines": sorted(bound), "uses": sorted(read), "code": ast.unparse(node)})
    return rows


USES = "array<struct<line:int,defines:array<string>,uses:array<string>,code:string>>"


@vectorised(USES)
def variable_trace(code: pd.Series) -> pd.Series:
    """The definitions and uses of each statement; none for a program that can't be parsed."""
    return code.map(lambda c: definitions_and_uses(c) if valid_syntax(c) else [])


@vectorised("string")
def sliced(code: pd.Series, name: pd.Series) -> pd.Series:
    """The statements on which a variable's final value depends; null for a program that can't be parsed."""
    return pd.Series([backward_slice(c, {n}) if valid_syntax(c) else None for c, n in zip(code, name, strict=True)], index=code.index, dtype=object)


def backward_slice(code: str, names: set[str]) -> str:
    """The top-level statements on which the final values of ``names`` depend."""
    wanted, kept = set(names), []
    for row in reversed(definitions_and_uses(code)):
        changes = set(row["defines"]) & wanted or any(row["code"].startswith(f"{n}.") for n in wanted)
        if changes:
            kept.append(row["code"])
            wanted |= set(row["uses"])
    return "\n".join(reversed(kept))


def sample_functions(context: str, body: str, returns: list[str]) -> dict:
    """A sample as two functions: get_inputs_from_context() gives the inputs as a dict, solution(...) takes them.

    Inputs are the names that the body and the returned expressions read and the context binds, in order of their
    binding; imports of the context stand apart.
    """
    rows = definitions_and_uses(context) if context.strip() else []
    imports = [r["code"] for r in rows if r["code"].startswith(("import ", "from "))]
    given = [r for r in rows if r["code"] not in imports]
    read = {n.id for n in ast.walk(ast.parse("\n".join([body, *returns]))) if isinstance(n, ast.Name)}
    inputs = list(dict.fromkeys(n for r in given for n in r["defines"] if n in read))
    inside = lambda code: ["    " + line for line in code.split("\n") if line.strip()]
    lines = [x for r in given for x in inside(r["code"])]
    before = ["def get_inputs_from_context():", *lines, f"    return dict({', '.join(f'{n}={n}' for n in inputs)})"]
    target = [f"def solution({', '.join(inputs)}):", *inside(body), f"    return {', '.join(returns)}"]
    return {"target": "\n".join(target), "inputs": inputs, "context": "\n".join(before), "imports": imports}


def harness(program: str, statement: str) -> str:
    """A program followed by a check that its test holds."""
    return f"{program}\nassert {statement}\n"


def _limits(seconds: float, megabytes: int):
    def apply():
        resource.setrlimit(resource.RLIMIT_CPU, (int(seconds) + 1, int(seconds) + 2))
        resource.setrlimit(resource.RLIMIT_AS, (megabytes << 20, megabytes << 20))
        resource.setrlimit(resource.RLIMIT_FSIZE, (1 << 20, 1 << 20))
        resource.setrlimit(resource.RLIMIT_NOFILE, (32, 32))

    return apply


RUNNER = """
import sys
try:
    exec(compile(sys.stdin.read(), "program", "exec"), {"__name__": "__main__"})
except AssertionError:
    print("\\x1eFailed Tests", file=sys.stderr)
except BaseException as e:
    print("\\x1e" + type(e).__name__ + ": " + str(e)[:500], file=sys.stderr)
else:
    print("\\x1ePassed", file=sys.stderr)
"""


VALUES = """
import contextlib, io, json, sys
given = json.loads(sys.stdin.read())
out, err, found, scope = io.StringIO(), io.StringIO(), {}, {"__name__": "__main__"}
with contextlib.redirect_stdout(out), contextlib.redirect_stderr(err):
    try:
        for line in given["context"]:
            exec(line, scope)
        for k, line in enumerate(given["code"]):
            value = eval(line, scope)
            found["OUT_%d" % k] = {"val": repr(value), "type": type(value).__name__}
    except BaseException as e:
        found["ERROR"] = type(e).__name__ + ": " + str(e)[:500]
print("\\x1e" + json.dumps(found | {"STDOUT": out.getvalue()[:10000], "STDERR": err.getvalue()[:10000]}), file=sys.__stderr__)
"""


def returned_values(code: list[str], context: list[str], seconds: float = 3.0, megabytes: int = 512) -> dict:
    """What expressions give after the statements of a context: OUT_0 ... with val (its repr) and type, STDOUT, STDERR, and ERROR if one failed.

    Runs in a child process with the limits of ``execute``.
    """
    with tempfile.TemporaryDirectory() as folder:
        try:
            done = subprocess.run(
                [sys.executable, "-I", "-c", VALUES], input=json.dumps({"code": code, "context": context}), capture_output=True, text=True, timeout=seconds, cwd=folder, env={"PATH": os.defpath}, preexec_fn=_limits(seconds, megabytes)
            )
        except subprocess.TimeoutExpired:
            return {"ERROR": "Timed Out", "STDOUT": "", "STDERR": ""}
    says = done.stderr.rpartition("\x1e")[2]
    return json.loads(says) if "\x1e" in done.stderr else {"ERROR": "Killed", "STDOUT": "", "STDERR": ""}


def sample_passes(context: list[str], code: list[str], expected: list[str]) -> bool:
    """Whether every expression gives what is expected, by its repr or, for strings, its text."""
    got = returned_values(code, context)
    if "ERROR" in got or len(code) != len(expected):
        return False
    return all(want in (got[f"OUT_{k}"]["val"], got[f"OUT_{k}"]["val"][1:-1] if got[f"OUT_{k}"]["type"] == "str" else None) for k, want in enumerate(expected))


SAMPLES = "section_id int, idx int, snippet_idx int, context array<string>, code string, expected string, passed boolean, error string"


def section_samples(rows: list[dict], global_context: list[str], overrides: dict[int, set[int]] | None = None, enabled: bool = False) -> list[dict]:
    """Code samples of a page's sections: each snippet with the context of its section so far.

    ``rows`` are section rows in order; a section's context starts with ``global_context`` and takes the statements of its
    code blocks one after another. If ``enabled``, each sample runs: one that fails has its error, unless
    ``overrides`` lists its block (section to idx), and its code still joins nothing.
    """
    contexts: dict[int, list[str]] = {}
    out = []
    for row in rows:
        if row["tag"] != "code":
            continue
        context = contexts.setdefault(row["section_id"], list(global_context))
        done: list[str] = []
        for k, snippet in enumerate(doctest_snippets(row["text"] + "\n")):
            before = [x for x in [snippet["context"]] if x]
            own = context + [x for x in before if x not in done]
            error, passed = None, None
            if enabled:
                got = returned_values([snippet["code"]], own)
                error = got.get("ERROR")
                passed = error is None and sample_passes(own, [snippet["code"]], [snippet["result"]])
                if row["idx"] in (overrides or {}).get(row["section_id"], ()):
                    error = None
            done += before
            out.append({"section_id": row["section_id"], "idx": row["idx"], "snippet_idx": k, "context": own, "code": snippet["code"], "expected": snippet["result"], "passed": passed, "error": error})
        context += statements(row["text"])
    return out


def statements(session: str) -> list[str]:
    """The inputs of an interactive session that bind or import; a text without prompts is taken whole."""
    lines = session.split("\n")
    if not any(x.strip().startswith(">>>") for x in lines):
        return [session] if valid_syntax(session) else []
    inputs: list[str] = []
    for line in map(str.strip, lines):
        if line.startswith(">>>"):
            inputs.append(line[4:])
        elif line.startswith("...") and inputs:
            inputs[-1] += "\n" + line[4:]
    keep = (ast.Assign, ast.AugAssign, ast.AnnAssign, ast.Import, ast.ImportFrom, ast.FunctionDef, ast.ClassDef, ast.For, ast.While, ast.With)
    called = lambda n: isinstance(n, ast.Expr) and isinstance(n.value, ast.Call) and isinstance(n.value.func, ast.Attribute)  # noqa: E731  a method may change its object
    return [x for x in inputs if valid_syntax(x) and all(isinstance(n, keep) or called(n) for n in ast.parse(x).body)]


def code_samples(sections: DataFrame, doc: str, *, global_context: list[str] | None = None, enabled: bool = False) -> DataFrame:
    """(doc, section_id, idx, snippet_idx, context, code, expected, passed, error) of section rows with a column ``doc``.

    The rows of a document meet in one task; a document's own sections are needed together, and no more.
    """
    kind = sections.schema[doc].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("idx").to_dict("records")
        found = section_samples(rows, global_context or [], enabled=enabled)
        names = ["section_id", "idx", "snippet_idx", "context", "code", "expected", "passed", "error"]
        return pd.DataFrame([{doc: pdf[doc].iloc[0], **f} for f in found], columns=[doc, *names])

    return sections.select(doc, "section_id", "idx", "tag", "text").groupBy(doc).applyInPandas(run, f"`{doc}` {kind}, {SAMPLES}")


def execute(program: str, seconds: float = 3.0, megabytes: int = 512) -> dict:
    """Run a program in a child process: Passed, Failed Tests, Timed Out, or the exception's name.

    The child has limits of time, memory, files and output, an empty folder and a bare environment. That
    guards against accidents; it is not a prison, so programs that nobody trusts need a container around.
    """
    with tempfile.TemporaryDirectory() as folder:
        try:
            done = subprocess.run([sys.executable, "-I", "-c", RUNNER], input=program, capture_output=True, text=True, timeout=seconds, cwd=folder, env={"PATH": os.defpath}, preexec_fn=_limits(seconds, megabytes))
        except subprocess.TimeoutExpired:
            return {"passed": False, "result": "Timed Out", "error": None}
    says = done.stderr.rpartition("\x1e")[2].strip() if "\x1e" in done.stderr else "Killed"
    name, _, message = says.partition(": ")
    return {"passed": name == "Passed", "result": name, "error": message or None}


def timed(program: str, statement: str, runs: int = 100, seconds: float = 3.0) -> dict:
    """Seconds that a statement takes over some runs after its program, or why it has none; as ``execute``, in a child process."""
    loop = f"import time as _t\n{program}\n_began = _t.perf_counter()\nfor _ in range({runs}):\n    {statement}\n_took = _t.perf_counter() - _began\nraise RuntimeError('%.9f' % _took)"
    done = execute(loop, seconds)
    took = float(done["error"]) if done["result"] == "RuntimeError" and done["error"] else None
    return {"seconds": took, "result": "Passed" if took is not None else done["result"]}


def executed(programs: DataFrame, *, code: str = "code", enabled: bool = False, seconds: float = 3.0) -> DataFrame:
    """``programs`` with passed, result and error of each; off unless ``enabled``, for it runs what the rows say."""
    if not enabled:
        raise PermissionError("execution of programs is off; pass enabled=True")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [execute(c, seconds) for c in pdf[code]]
            yield pdf.assign(**{k: [r[k] for r in rows] for k in ("passed", "result", "error")})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in programs.schema)
    return programs.mapInPandas(run, f"{kinds}, passed boolean, result string, error string")
