"""Named DataFrame functions with parameter schemas, plans of them, and a store of solved cases."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.functions import text as T
from peakloom.operators import pools, retrieval

_TYPES = {int: "integer", float: "number", bool: "boolean", dict: "object", list: "array", "int": "integer", "float": "number", "bool": "boolean", "dict": "object", "list": "array"}
#: Other names of the peaks' parameters.
ALIASES = {"h_shifts": ("hnmr", "H_nmr", "H_shifts", "h_nmr"), "c_shifts": ("cnmr", "C_nmr", "C_shifts", "c_nmr")}

#: What a judge may say.
VERDICTS = ("accept", "need_opt", "need_bigger_pool", "need_retry")


@dataclass
class Tool:
    name: str
    description: str
    run: Callable
    parameters: dict = field(default_factory=dict)


class Engine:
    """A registry; tools take the session first, then named parameters."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tools = spark, {}

    def tool(self, name: str | None = None, description: str | None = None):
        def keep(function: Callable) -> Callable:
            given = list(inspect.signature(function).parameters.values())[1:]
            kinds = {p.name: {"type": _TYPES.get(p.annotation, "string"), "required": p.default is p.empty} for p in given}
            label = name or function.__name__
            self.tools[label] = Tool(label, description or inspect.getdoc(function) or "", function, kinds)
            return function

        return keep

    def schema(self) -> list[dict]:
        return [{"name": t.name, "description": t.description, "parameters": t.parameters} for t in self.tools.values()]

    def run(self, name: str, state: dict | None = None, **given) -> DataFrame:
        """Runs a tool; other names of parameters are put right, and what is missing comes from the state."""
        t = self.tools[name]
        return t.run(self.spark, **arguments(given, state or {}, set(t.parameters)))


def arguments(given: dict, state: dict, wanted: set[str]) -> dict:
    filled = dict(given)
    for name, others in ALIASES.items():
        for other in others:
            if other in filled:
                value = filled.pop(other)
                filled.setdefault(name, value)
    for name in wanted - set(filled):
        if state.get(name) not in (None, "", []):
            filled[name] = state[name]
    return {k: v for k, v in filled.items() if k in wanted}


def planned(plan: dict, verdict: str | None) -> dict:
    """A plan after the last verdict: a bigger pool asks both sources for more, optimisation follows generation."""
    out = dict(plan)
    if verdict == "need_bigger_pool":
        out |= {"need_large_pool": True, "use_retrieval": True, "use_denovo": True, "save_pool_file": True}
        out["retrieval_top_k"] = max(int(out.get("retrieval_top_k") or 0), 100)
        out["denovo_top_k"] = max(int(out.get("denovo_top_k") or 0), 20)
    if verdict == "need_opt":
        out |= {"need_opt_after_generation": True, "save_pool_file": True}
    return out


def looped(plan: dict, act: Callable[[dict], object], judge: Callable[[object], dict], most: int = 4) -> dict:
    """Turns of planning, acting and judging until the judge accepts or the limit is reached, whatever comes first.

    Returns verdict, answer (the judge's top_candidate, if it accepts), result and iteration. A verdict that isn't known asks for
    another turn; at least one turn is taken.
    """
    verdict, turn = None, 0
    while True:
        plan = planned(plan, verdict)
        result = act(plan)
        said, turn = judge(result), turn + 1
        verdict = said.get("verdict") if said.get("verdict") in VERDICTS else "need_retry"
        if verdict == "accept" or turn >= most:
            return {"verdict": verdict, "answer": said.get("top_candidate") if verdict == "accept" else None, "result": result, "iteration": turn}


def executed(plan: dict, asked: DataFrame, library: DataFrame, generated: DataFrame | None = None) -> DataFrame:
    """Candidates (query_id, vec_id, score, source) of a plan: retrieval by mode, generated ones if given, merged by best row."""
    parts = []
    if plan.get("use_retrieval", True):
        found = retrieval.by_mode(asked, library, plan.get("retrieval_top_k") or 20, plan.get("retrieval_mode", "auto"))
        parts.append(found.select("query_id", "vec_id", "score", F.lit("retrieval").alias("source")))
    if plan.get("use_denovo") and generated is not None:
        parts.append(generated.select("query_id", "vec_id", "score", F.lit("denovo").alias("source")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    merged = rows.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("source")).alias("sources"))
    return pools.ranked(merged, [F.desc("score"), F.col("vec_id")], ["query_id"])


def expanded_query(formula: str, h: list[float], c: list[float], task: str = "") -> str:
    """Search words for a case, by the regions of its peaks."""
    parts = [formula, task]
    parts += ["13C downfield carbonyl lactone ester ketone"] if any(x >= 160 for x in c) else []
    parts += ["13C alkene aromatic vinylic"] if any(100 <= x <= 160 for x in c) else []
    parts += ["13C oxygenated sp3 carbon"] if any(50 <= x <= 90 for x in c) else []
    parts += ["1H chemical shift integration coupling"] if h else []
    return " ".join(p for p in parts if p)


def remembered(memory: DataFrame, records: DataFrame) -> DataFrame:
    """The store with new cases (formula, h, c, canonical, source, created_at); the first of a structure and formula stays."""
    keyed = records.withColumn("key", T.keyed("case", F.col("canonical"), F.col("formula")))
    rows = memory.withColumn("_late", F.lit(0)).unionByName(keyed.withColumn("_late", F.lit(1)), allowMissingColumns=True)
    return pools.first_wins(rows, ["key"], [F.col("_late"), F.col("created_at")]).drop("_late")


def searched(query: str, providers: list[Callable[[str], list[dict]]], k: int = 5) -> tuple[list[dict], list[str]]:
    """Evidence from the first outside provider that finds any, and the errors of those before it."""
    errors = []
    for p in providers:
        try:
            if found := p(query):
                return [{"source_type": "web", "claim": r.get("title", ""), "evidence": (r.get("text") or "")[:900], "confidence": "low", "provenance": r.get("url")} for r in found[:k]], errors
        except Exception as e:  # a provider may fail in any way; the next one is asked
            errors.append(f"{getattr(p, '__name__', 'provider')}: {e}")
    return [], errors


def settings(text: str) -> dict:
    """Indented keys, lists and plain values, as a configuration file holds them."""

    def value(s: str):
        low = s.lower()
        for kind in (int, float):
            try:
                return kind(s)
            except ValueError:
                pass
        return low == "true" if low in ("true", "false") else s.strip("\"'")

    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]

    def block(i: int, indent: int):
        out = [] if i < len(lines) and lines[i][1].startswith("- ") else {}
        while i < len(lines) and lines[i][0] >= indent:
            depth, line = lines[i]
            if isinstance(out, list):
                if not line.startswith("- "):
                    break
                out.append(value(line[2:].strip()))
                i += 1
                continue
            key, _, rest = line.partition(":")
            if rest.strip():
                out[key.strip()] = value(rest.strip())
                i += 1
            elif i + 1 < len(lines) and (lines[i + 1][0] > depth or lines[i + 1][1].startswith("- ")):
                out[key.strip()], i = block(i + 1, lines[i + 1][0])
            else:
                out[key.strip()], i = {}, i + 1
        return out, i

    return block(0, 0)[0]
