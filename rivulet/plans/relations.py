"""Which relations a SQL text reads, and where it names them, as Spark's parser sees it."""

from __future__ import annotations

import re

from pyspark.errors import ParseException
from pyspark.sql import SparkSession

LITERAL = r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\""


def relations(sql: str, session: SparkSession | None = None) -> list[tuple[str, int, int]]:
    """(name, start, end) of each relation that a query reads, in order; those that it defines itself (WITH) are left out.

    Without a session, or for a text that is no query by itself, what follows FROM and JOIN counts.
    """
    session = session or SparkSession.getActiveSession() or getattr(SparkSession, "_instantiatedSession", None)
    if session is not None:
        try:
            return sorted(_walk(session._jsparkSession.sessionState().sqlParser().parsePlan(sql), frozenset()), key=lambda x: x[1])
        except ParseException:
            pass
    return _by_keywords(sql)


def _walk(plan, hidden: frozenset[str]) -> list[tuple[str, int, int]]:
    kind, found = plan.getClass().getSimpleName(), []
    if kind == "UnresolvedWith":  # a definition may read an outer relation of its own name
        definitions = plan.cteRelations()
        for i in range(definitions.size()):
            name = definitions.apply(i)._1().lower()
            found += _walk(definitions.apply(i)._2(), hidden)
            hidden = hidden | {name}
        return found + _walk(plan.child(), hidden)
    if kind == "UnresolvedRelation":
        parts, at = plan.multipartIdentifier(), plan.origin()
        name = ".".join(parts.apply(i) for i in range(parts.size()))
        if name.lower() not in hidden:
            found.append((name, at.startIndex().get(), at.stopIndex().get() + 1))
    for below in (plan.children(), plan.subqueries()):
        for i in range(below.size()):
            found += _walk(below.apply(i), hidden)
    return found


def _by_keywords(sql: str) -> list[tuple[str, int, int]]:
    blank = lambda m: " " * len(m[0])
    text = re.sub(rf"{LITERAL}|--[^\n]*|/\*.*?\*/", blank, sql, flags=re.S)
    own = {x.lower() for x in re.findall(r"(\w+)\s+as\s*\(", text, re.I)} | {"select", "lateral", "values"}
    found = []
    for m in re.finditer(r"\b(?:from|join)\s+((?:[\w.`]+(?:\s+(?:as\s+)?\w+)?\s*,\s*)*[\w.`]+)", text, re.I):
        at = m.start(1)
        for part in m[1].split(","):
            word = re.match(r"\s*([\w.`]+)", part)
            if word and word[1].strip("`").lower() not in own:
                found.append((word[1].strip("`"), at + word.start(1), at + word.end(1)))
            at += len(part) + 1
    return found


def with_frames(sql: str, names: dict[str, str], session: SparkSession | None = None) -> str:
    """The text with placeholders for those relations that ``names`` has a word for; other braces stay braces."""
    out, at = [], 0
    known = {n.lower(): word for n, word in names.items()}
    for name, start, end in relations(sql, session):
        if name.lower() in known:
            out += [_braces(sql[at:start]), "{" + known[name.lower()] + "}"]
            at = end
    return "".join(out) + _braces(sql[at:])


def _braces(text: str) -> str:
    return text.replace("{", "{{").replace("}", "}}")


def outside_literals(sql: str, word: str, text: str) -> str:
    """The SQL with each whole ``word`` replaced that is neither in a string nor qualified."""
    parts = re.split(f"({LITERAL})", sql)
    return "".join(p if i % 2 else re.sub(rf"(?<![\w.]){re.escape(word)}(?!\w)", lambda _: text, p) for i, p in enumerate(parts))
