"""Read-only SQL over the dataset's views."""

import json
import re

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ..functions import rows_as_json
from ..schema import PREVIEW_ROWS
from .views import Dataset

# What a query's structure does not consist of: raw and plain literals, quoted names, line comments, block comments.
# A hint's text is part of the query.
_ASIDE = re.compile(
    r"""(?<![A-Za-z0-9_])[rR]'[^']*'|(?<![A-Za-z0-9_])[rR]"[^"]*"|'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"
    |(?P<name>`(?:[^`]|``)*`)|--(?:\\\n|[^\r\n])*|(?P<block>/\*(?!\+))""",
    re.DOTALL | re.VERBOSE,
)
_BLOCK_MARK = re.compile(r"/\*|\*/")
_QUERY = re.compile(r"[\s(]*(with|select)\b", re.IGNORECASE)
# Functions that run arbitrary JVM code, the clause that builds names from text, and a join that Spark
# would silently read as a plain join with an alias.
_REFUSED = re.compile(r"\b((reflect|try_reflect|java_method|identifier)\s*\(|asof\s+join)", re.IGNORECASE)
# How an explained query names a table of a catalog; the dataset's views are temporary and have no catalog.
_CATALOG = re.compile(r"^[\s:+|-]*SubqueryAlias (\w+\.\S+)$", re.MULTILINE)


def _structure(text: str) -> str:
    """The text with literals and comments blanked and quotes taken from names; block comments nest."""
    out, at = [], 0
    while aside := _ASIDE.search(text, at):
        out += [text[at : aside.start()], aside["name"].strip("`") if aside["name"] else " "]
        at = aside.end()
        depth = 1 if aside["block"] else 0
        while depth:
            mark = _BLOCK_MARK.search(text, at)
            if not mark:
                return "".join(out)
            depth += 1 if mark[0] == "/*" else -1
            at = mark.end()
    return "".join([*out, text[at:]])


class RefusedQuery(ValueError):
    """The text is not a single read-only query."""


def read_only(session: SparkSession, sql: str) -> DataFrame:
    """DataFrame of one SELECT or WITH query over the dataset's views; anything else raises RefusedQuery.

    Spark's own parser decides: the text must parse as a subquery, a place where the grammar has no room for
    commands, inserts or a second statement. Calls are looked for outside literals and comments, tables of a
    catalog in Spark's explanation of the query.
    """
    text = sql.strip().rstrip("; \t\r\n")
    bare = _structure(text)
    if not _QUERY.match(bare):
        raise RefusedQuery("A query starts with SELECT or WITH; nothing else is run")
    refused = _REFUSED.search(bare)
    if refused:
        raise RefusedQuery(f"Not allowed in a query: {refused.group(2) or refused.group(1)}")
    try:
        query = session.sql(f"SELECT * FROM (\n{text}\n) AS q")
        explained = session.sql(f"EXPLAIN EXTENDED SELECT * FROM (\n{text}\n) AS q").first()[0]
    except PySparkException as error:
        raise RefusedQuery(str(error).split("\n")[0]) from error
    table = _CATALOG.search(explained.partition("== Analyzed Logical Plan ==")[2].partition("== Optimized Logical Plan ==")[0])
    if table:
        raise RefusedQuery(f"Not a view of the dataset: {table.group(1)}")
    return query


def preview(df: DataFrame, limit: int = PREVIEW_ROWS) -> dict:
    """At most ``limit`` rows and the full row count, which is only computed when rows were left out."""
    rows = [json.loads(r[0]) for r in df.limit(limit + 1).select(rows_as_json()).collect()]
    if len(rows) <= limit:
        return {"row_count": len(rows), "rows": rows}
    total = df.count()
    return {"row_count": total, "rows": rows[:limit], "note": f"truncated to first {limit} of {total} rows"}


def run_tool(dataset: Dataset, name: str, arguments: dict) -> str:
    """JSON answer of the query tool; problems come back as an error entry."""
    if name != "query_results":
        return json.dumps({"error": f"unknown tool {name!r}"})
    try:
        return json.dumps(preview(read_only(dataset.session, arguments.get("sql", ""))), default=str)
    except (RefusedQuery, PySparkException) as error:
        return json.dumps({"error": str(error)})
