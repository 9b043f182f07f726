"""Read-only SQL over the published view."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklore import fixed_values as fx
from tracklore.functions.sql_text import audit_sql, clean_sql
from tracklore.session import configure


_REFLECTION = "expressions.CallMethodViaReflection"


def query_session(
    spark: SparkSession,
    publish: Callable[[SparkSession], object],
    version: Callable[[], object] | None = None,
) -> SparkSession:
    """A session of its own in which ``publish`` registers the view and nothing else.

    Temporary views of the caller are out of reach, and so are files named in FROM. With
    ``version`` (Warehouse.version, say) the view is published again before a statement
    whenever that has changed, so statements see what was loaded meanwhile.
    """
    isolated = configure(spark.newSession())
    isolated.conf.set("spark.sql.runSQLOnFiles", "false")
    seen = version() if version else None
    publish(isolated)
    if version:
        isolated._tracklore_view = [version, seen, publish]
    return isolated


def _follow(spark: SparkSession) -> None:
    view = getattr(spark, "_tracklore_view", None)
    if view and (now := view[0]()) != view[1]:
        view[2](spark)
        view[1] = now


def checked_statement(spark: SparkSession, sql: str) -> str:
    """The cleaned statement, or ValueError with the reason it may not run."""
    cleaned = clean_sql(F.lit(sql))
    row = spark.sql("SELECT 1").select(cleaned.alias("sql"), audit_sql(cleaned).alias("reason")).first()
    if row["reason"] is not None:
        raise ValueError(row["reason"])
    return row["sql"]


def _sequence(items) -> list:
    return [items.apply(i) for i in range(items.length())]


def other_relations(spark: SparkSession, sql: str, allowed: str = fx.HISTORY_VIEW) -> list[str]:
    """What a statement reads besides the view and its own WITH queries, sorted.

    The parsed plan is walked with its subqueries, and every name is looked up where it
    stands, so neither a qualified name nor a WITH query of another part hides a table. A
    WITH query may not take the view's name.
    """
    found = set()

    def walk(plan, known: frozenset) -> None:
        kind = plan.nodeName()
        if kind == "UnresolvedRelation":
            parts = _sequence(plan.multipartIdentifier())
            if len(parts) > 1 or parts[0].lower() not in known:
                found.add(".".join(parts))
        elif "UnresolvedIdentifier" in kind:
            found.add("IDENTIFIER")  # a name worked out later
        elif kind == "UnresolvedWith":
            inside = known
            for entry in _sequence(plan.cteRelations()):
                name = entry._1().lower()
                if name == allowed:
                    found.add(name)
                own = inside | {name} if plan.allowRecursion() else inside
                walk(entry._2(), own)
                inside = inside | {name}
            known = inside
        for child in _sequence(plan.children()) + _sequence(plan.subqueries()):
            walk(child, known)

    walk(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql), frozenset({allowed}))
    return sorted(found)


def structured_query(
    spark: SparkSession, sql: str, max_rows: int = fx.QUERY_MAX_ROWS
) -> DataFrame:
    """A checked statement as a DataFrame of at most ``max_rows`` rows.

    Other relations than the view are refused on the parsed plan, calls of Java methods on
    the analysed one, whatever their spelling.
    """
    _follow(spark)
    statement = checked_statement(spark, sql)
    result = spark.sql(statement)  # analysed, not run: names that are not there fail here
    others = other_relations(spark, statement)
    if others:
        raise ValueError(fx.REASON_RAW_TABLES.format(", ".join(others)))
    if _REFLECTION in result._jdf.queryExecution().analyzed().toJSON():
        raise ValueError("calls of Java methods are not allowed")
    return result.limit(max_rows)


def run_structured_query(
    spark: SparkSession,
    sql: str,
    max_rows: int = fx.QUERY_MAX_ROWS,
    timeout_ms: int = fx.QUERY_TIMEOUT_MS,
) -> list[dict]:
    """Run a checked statement and return plain rows; TimeoutError past the limit."""
    result = structured_query(spark, sql, max_rows)
    context = spark.sparkContext
    tag = f"tracklore-{uuid.uuid4().hex}"
    done, expired = threading.Event(), threading.Event()

    def watch():
        if done.wait(timeout_ms / 1000.0):
            return
        expired.set()
        # A query may start further jobs after the first was cancelled.
        while not done.wait(0.1):
            context.cancelJobsWithTag(tag)

    context.addJobTag(tag)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    rows, failure = [], None
    try:
        rows = [row.asDict(recursive=True) for row in result.collect()]
    except Exception as error:
        failure = error
    finally:
        done.set()
        watcher.join()
        context.removeJobTag(tag)
    if expired.is_set():
        raise TimeoutError(f"query exceeded {timeout_ms} ms") from failure
    if failure is not None:
        raise failure
    return rows


def rows_as_json(rows: list[dict]) -> str:
    return json.dumps(rows, default=str, separators=(",", ":"))
