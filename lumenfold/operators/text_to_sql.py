"""Questions to SQL: schema context, and a validator that lets single read-only queries through."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

MAX_TABLES = 512
_FENCE = re.compile(r"```(?:sql)?\s*(.*?)```", re.S | re.I)


def schema_context(spark: SparkSession, tables: list[str] | None = None) -> str:
    """One line per table or view of the session: name(column type, ..), in order of name."""
    names = sorted(t.name for t in spark.catalog.listTables()) if tables is None else tables
    lines = []
    for name in names[:MAX_TABLES]:
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
            raise ValueError(f"{name!r} is no identifier")
        lines.append(f"{name}({', '.join(f'{c} {t}' for c, t in spark.table(name).dtypes)})")
    return "\n".join(lines)


def extract_sql(response: str) -> str:
    """The SQL of a response: its first fenced block, else all of it; without a closing semicolon."""
    m = _FENCE.search(response)
    return (m.group(1) if m else response).strip().rstrip(";").strip()


def validate(spark: SparkSession, sql: str, allowed: str = "select") -> str | None:
    """None for one read-only query that the session can analyse, else what is wrong with it.

    With allowed="select_insert_update" an INSERT or UPDATE that parses passes too; it is not analysed.
    """
    word = re.match(r"\s*\(*\s*([A-Za-z]+)", sql)
    write = allowed == "select_insert_update" and word is not None and word.group(1).upper() in ("INSERT", "UPDATE")
    if not word or not write and word.group(1).upper() not in ("SELECT", "WITH", "VALUES"):
        return "not a query"
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        return f"does not parse: {str(e).splitlines()[0][:200]}"
    if write:
        kind = plan.getClass().getSimpleName()
        return None if kind in ("InsertIntoStatement", "UpdateTable") else f"{kind} is not allowed"
    text = plan.toString()
    if any(x.getClass().getName().split(".")[-1].endswith("Command") for x in _nodes(plan)) or re.search(r"InsertInto|CreateTable|DropTable|Delete|Update|Merge", text.split("\n", 1)[0]):
        return "not read-only"
    try:
        spark.sql(sql)  # a query is only analysed here, not run
    except Exception as e:
        return f"does not analyse: {str(e).splitlines()[0][:200]}"
    return None


def _nodes(plan) -> list:
    out, todo = [], [plan]
    while todo:
        p = todo.pop()
        out.append(p)
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return out


@dataclass
class SqlAnswer:
    generated_sql: str | None
    execution_status: str
    retry_count: int
    result: DataFrame | None = None


def text_to_sql(session, question: str, tables: list[str] | None = None, attempts: int | None = None) -> SqlAnswer:
    """SQL for a question, validated (and on request reviewed by the reasoner) and never run; a rejected draft is tried again with the reason."""
    context, problem = schema_context(session.spark, tables), ""
    tries = attempts or int(session.config_get("text_to_sql_max_attempts"))
    allowed = str(session.config_get("text_to_sql_allowed_statements"))
    for k in range(tries):
        draft = extract_sql(session.reason(f"Write one SELECT statement. Question: {question}" + (f"\nThe last try failed: {problem}" if problem else ""), context))
        problem = validate(session.spark, draft, allowed)
        if problem is None and session.config_get("text_to_sql_use_review"):
            said = session.reason(f"Review this statement for the question below. Answer OK, or what is wrong.\n{draft}\nQuestion: {question}", context).strip()
            problem = None if said.upper().startswith("OK") else f"review: {said[:200]}"
        if problem is None:
            return SqlAnswer(draft, "validated", k)
    return SqlAnswer(None, f"rejected: {problem}", tries - 1)


def sql_agent(session, question: str, tables: list[str] | None = None, retries: int = 2, auto_execute: bool = False) -> SqlAnswer:
    """text_to_sql, and on request the query's first rows (a limited DataFrame)."""
    answer = text_to_sql(session, question, tables, retries + 1)
    if answer.generated_sql and auto_execute and validate(session.spark, answer.generated_sql) is None:  # statements that write are never run here
        answer.result = session.spark.sql(answer.generated_sql).limit(int(session.config_get("max_result_rows")))
        answer.execution_status = "executed"
    return answer
