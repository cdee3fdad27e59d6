"""Code benchmarks brought to one form, with a quarantine for what can't be read."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.code import OPERATORS
from tessera.functions.vectorised import vectorised
from tessera.registry import Registry

READ = "struct<error:string,function:string,task_id:string,description:string,code:string,context:string,input_output_pairs:array<struct<input:string,ops:string,output:string>>>"
NAMES = ["error", "function", "task_id", "description", "code", "context", "input_output_pairs"]
# Fixed value: a program whose tests don't compare.
SKIPPED = ("HumanEval/38",)
normalisers = Registry("normaliser")


class _Comparisons(ast.NodeVisitor):
    """Every comparison in order of reading, and the plain name that was called last."""

    def __init__(self):
        self.pairs: list[dict] = []
        self.function: str | None = None

    def visit_Call(self, node: ast.Call) -> None:
        if isinstance(node.func, ast.Name):
            self.function = node.func.id
        self.generic_visit(node)

    def visit_Compare(self, node: ast.Compare) -> None:
        if len(node.ops) != 1:
            raise ValueError("chained comparison")
        output = ast.unparse(node.comparators[0]).replace('"""', "'")
        self.pairs.append({"input": ast.unparse(node.left), "ops": OPERATORS[type(node.ops[0])], "output": output})
        self.generic_visit(node)


def compared(tests: str) -> _Comparisons:
    """The comparisons of some tests; ValueError if there are none, or one is chained."""
    found = _Comparisons()
    found.visit(ast.parse(tests))
    if not found.pairs:
        raise ValueError("No IO Pairs")
    return found


def parted(source: str) -> tuple[str, str]:
    """What stands before the first "class " or "def ", and the rest."""
    m = re.search(r"class |def ", source)
    if not m:
        raise ValueError("no class or function")
    return source[: m.start()], source[m.start() :]


def _checked(row: dict) -> dict:
    ast.parse(row["code"])
    return row


@normalisers.register("mbpp")
def mbpp_program(row: dict) -> dict:
    """A row with text, code, task_id, test_setup_code, test_list and challenge_test_list."""
    tests = compared("\n".join([*(row.get("test_list") if row.get("test_list") is not None else ()), *(row.get("challenge_test_list") if row.get("challenge_test_list") is not None else ())]))
    before, program = parted((row["code"] or "").replace("\r", ""))
    context = f"{before.strip()}\n{(row.get('test_setup_code') or '').replace(chr(13), '')}".strip()
    return _checked({"function": tests.function, "task_id": row["task_id"], "description": (row["text"] or "").replace("\r", ""), "code": program.strip(), "context": context, "input_output_pairs": tests.pairs})


@normalisers.register("human_eval")
def human_eval_program(row: dict) -> dict:
    """A row with task_id, prompt, canonical_solution, test and entry_point; the docstring becomes the description."""
    if row["task_id"] in SKIPPED:
        raise ValueError("Skipped program")
    tests = compared(row["test"])
    prompt = row["prompt"]
    if "FIX" in prompt:
        prompt = prompt.split('"""', 2)[2]
    parts = prompt.split('"""')
    if len(parts) < 2:
        parts = prompt.replace("'''", '"""').split('"""')
    if len(parts) < 2:
        raise ValueError("no docstring")
    description = "\n".join(x.strip() for x in parts[1].split("\n")).strip()
    context, head = parted(parts[0])
    solution = row["canonical_solution"]
    program = head.strip() + ("" if solution.startswith("\n") else "\n") + solution
    pairs = [p | {"input": p["input"].replace("candidate", row["entry_point"])} for p in tests.pairs]
    return _checked({"function": row["entry_point"], "task_id": row["task_id"], "description": description, "code": program.strip(), "context": context.strip(), "input_output_pairs": pairs})


def normalised(rows: DataFrame, task: str) -> tuple[DataFrame, DataFrame]:
    """(programs, failures): rows of a benchmark as programs (task, function, task_id, description, code, context,
    input_output_pairs), and the rows as they came, with task and exception, that could not be read."""
    read = normalisers[task]

    def one(row: dict) -> dict:
        try:
            out = read(row)
            return {"error": None, **out, "task_id": str(out["task_id"])}
        except Exception as e:  # whatever a row holds, it goes to quarantine, not the job to its end
            return {**dict.fromkeys(NAMES), "error": str(e) or type(e).__name__}

    @vectorised(READ)
    def each(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([one(r) for r in rows.to_dict("records")], columns=NAMES, index=rows.index)

    own = rows.withColumn("__read", each(F.struct(*(F.col(f"`{c}`") for c in rows.columns))))
    name = F.lit(task.upper()).alias("task")
    kept = ["source_file"] if "source_file" in rows.columns else []
    good = own.where("__read.error is null").select(*kept, name, *(f"__read.{c}" for c in NAMES[1:]))
    return good, own.where("__read.error is not null").select(*rows.columns, name, F.col("__read.error").alias("exception"))


def attach_generated(programs: DataFrame, generated: DataFrame) -> DataFrame:
    """Programs with the generated tests of their function added to input_output_pairs, each pair marked by is_generated.

    ``generated`` has (name, input, ops, output), name being the group of a test; the function is inferred from a group's calls, and
    groups without a common name attach to nothing.
    """
    from tessera.functions.strings import function_name

    pair = F.struct("input", "ops", "output", F.lit(True).alias("is_generated"))
    groups = generated.groupBy("name").agg(F.collect_list("input").alias("calls"), F.sort_array(F.collect_list(pair)).alias("more"))
    found = groups.withColumn("function", function_name(F.col("calls"))).where("function is not null").groupBy("function").agg(F.flatten(F.sort_array(F.collect_list("more"))).alias("more"))
    own = F.transform("input_output_pairs", lambda p: F.struct(p["input"].alias("input"), p["ops"].alias("ops"), p["output"].alias("output"), F.lit(False).alias("is_generated")))
    both = programs.withColumn("input_output_pairs", own).join(found, "function", "left")
    return both.withColumn("input_output_pairs", F.concat("input_output_pairs", F.coalesce("more", F.array().cast(found.schema["more"].dataType)))).drop("more")


def without_listed_inputs(programs: DataFrame, *marks: str) -> DataFrame:
    """Programs none of whose inputs holds one of ``marks``."""
    bad = lambda p: F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(p["input"], m))
    return programs.where(~F.exists("input_output_pairs", bad)) if marks else programs
