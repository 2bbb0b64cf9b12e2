"""Routing of natural-language queries, as a column and for one query on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.text import STOPWORDS, query_terms

# The patterns of each route, routes in order of precedence.
PATTERNS = {
    "evolution": [r"\bversion\b", r"\bversions\b", r"\bhistory\b", r"\bchanged\b", r"\bchange(s|d)? between\b", r"\bprevious implementation\b", r"\bolder implementation\b", r"\bevolved\b", r"\bwhen was\b"],
    "structural": [r"\b(before|after)\b", r"\brecursive\b", r"\brecursion\b", r"\bnested loops?\b", r"\bcontains?\b.*\bloop\b", r"\bclass(es)?\b.*\bwith\b", r"\bfunctions?\b.*\bwith\b", r"\bcall graph\b", r"\bdependency graph\b", r"\bsequence of calls\b"],
    "exact_usage": [r"\bwhere is\b.*\bused\b", r"\bfind usages?\b", r"\bfind references?\b", r"\bwhich files import\b", r"\bwhich functions call\b", r"\bwhich methods call\b", r"\buses? [`'\"]?[A-Za-z_][A-Za-z0-9_.]*", r"\bcall(s|ing)? [`'\"]?[A-Za-z_][A-Za-z0-9_.]*", r"\bimport(s|ing)? [`'\"]?[A-Za-z_][A-Za-z0-9_.]*"],
}
CONFIDENCE = {"evolution": 0.95, "structural": 0.9, "exact_usage": 0.9, "semantic": 0.9}
REASON = {
    "evolution": "the query asks for versions, history or changes",
    "structural": "the query constrains structure, control flow or call order",
    "exact_usage": "the query asks where an identifier is used, called or imported",
    "semantic": "the query describes behaviour",
}


@dataclass(frozen=True)
class Plan:
    route: str
    confidence: float
    reason: str
    terms: tuple[str, ...]


def route(text: Column) -> Column:
    """The first family with a pattern that the text holds, in any case; else semantic."""
    chosen = None
    for name, patterns in PATTERNS.items():
        hit = text.rlike("(?iu)(?:" + "|".join(f"(?:{p})" for p in patterns) + ")")
        chosen = F.when(hit, name) if chosen is None else chosen.when(hit, name)
    return chosen.otherwise("semantic")


def plan_column(text: Column) -> Column:
    """struct<route, confidence, reason, terms>; a null text is semantic without terms."""
    text = F.trim(F.coalesce(text, F.lit("")))
    by_route = lambda values: F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), route(text))
    return F.struct(route(text).alias("route"), by_route(CONFIDENCE).alias("confidence"), by_route(REASON).alias("reason"), query_terms(text).alias("terms"))


def plan_query(query: str, scope: str | None = None) -> Plan:
    """The plan of one query, as plan_column() has it but without a job; an explicit version scope decides for evolution."""
    if scope is not None:
        return Plan("evolution", 1.0, "a version scope was given", ())
    text = query.strip()
    name = next((k for k, patterns in PATTERNS.items() if any(re.search(p, text, re.I) for p in patterns)), "semantic")
    words = dict.fromkeys(w for w in re.findall(r"\b[A-Za-z_][A-Za-z0-9_.]*\b", text) if w.lower() not in STOPWORDS)
    return Plan(name, CONFIDENCE[name], REASON[name], tuple(words)[:12])
