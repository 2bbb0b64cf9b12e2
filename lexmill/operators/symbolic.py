"""Symbol search over structural records: exact usage, call order, recursion and loops."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CATEGORIES = ("functions", "classes", "imports", "calls")
MOST_EVIDENCE, PER_TERM = 12, 4


class Unsupported(ValueError):
    """The query asks for a structure that can't be searched."""


#: Identifiers stand behind the categories.
IDENTIFIER = 9


def symbols(records: DataFrame) -> DataFrame:
    """id, category_order, category, pos, name, line, function, class of every symbol and identifier; built once an index, in one pass."""
    kind = "array<struct<category_order:int,category:string,pos:int,name:string,line:int,function:string,class:string>>"
    parts = []
    for order, category in enumerate(CATEGORIES):
        has = {f.name for f in records.schema[category].dataType.elementType.fields}
        parts.append(F.transform(category, _symbol(order, category, has)).cast(kind))
    none = F.lit(None).cast("string")
    parts.append(F.transform("identifiers", lambda n, i: F.struct(F.lit(IDENTIFIER).alias("category_order"), F.lit("identifiers").alias("category"), i.alias("pos"), n.alias("name"), F.lit(None).cast("int").alias("line"), none.alias("function"), none.alias("class"))).cast(kind))
    return records.select("id", F.inline(F.concat(*(F.coalesce(p, F.array().cast(kind)) for p in parts))))


def _symbol(order: int, category: str, has: set[str]):
    text = lambda s, c: s[c] if c in has else F.lit(None).cast("string")
    return lambda s, i: F.struct(F.lit(order).alias("category_order"), F.lit(category).alias("category"), i.alias("pos"), s["name"].alias("name"), s["line"].alias("line"), text(s, "function").alias("function"), text(s, "class").alias("class"))


def matches(name: Column, term: str) -> Column:
    """The whole name, or what follows a dot, case-sensitively; never for null."""
    return F.coalesce((name == term) | name.endswith("." + term), F.lit(False))


def symbol_matches(name: Column, category: Column, term: str) -> Column:
    return matches(name, term) | ((category == "imports") & name.startswith(term + "."))


def category_of(query: str) -> tuple[list[str] | None, bool]:
    """Which symbols a usage query means (None: all), and whether they must stand in a function."""
    wanted = ["imports"] if re.search(r"\bimports?\b", query, re.I) else ["calls"] if re.search(r"\bcalls?\b", query, re.I) else None
    return wanted, bool(wanted == ["calls"] and re.search(r"\b(functions?|methods?)\b", query, re.I))


def _term_rows(table: DataFrame, terms: list[str]) -> DataFrame:
    """Symbols with the number of each term that they match, in one pass."""
    hits = [F.when(symbol_matches(F.col("name"), F.col("category"), t), F.lit(i)) for i, t in enumerate(terms)]
    return table.withColumn("term", F.explode(F.array_compact(F.array(*hits))))


def exact_usage(table: DataFrame, terms: list[str], k: int = 20, categories: list[str] | None = None, require_function: bool = False) -> DataFrame:
    """id, score, evidence of the k records with the largest share of terms, equal shares by id as text.

    table: structural records, or the stored symbols() of them, which need no parsing and filter while they are read. With categories every
    term must match; without, any may, and a term that no symbol matches can match one of the identifiers instead.
    """
    table = table if "category_order" in table.columns else symbols(table)
    none = F.lit(None).cast("string")
    if not terms:
        return table.select("id", F.lit(0.0).alias("score"), F.array().cast("array<struct<type:string,name:string,line:int,function:string,class:string>>").alias("evidence")).limit(0)
    wanted = F.col("category") != "identifiers" if categories is not None else F.lit(True)
    if categories is not None:
        wanted = F.col("category").isin(categories)
    if require_function:
        wanted = wanted & (F.col("function").isNotNull() | (F.col("category") == "identifiers"))
    found = _term_rows(table.where(wanted), terms)
    named = F.element_at(F.array(*(F.lit(t) for t in terms)), F.col("term") + 1)
    is_word = F.col("category") == "identifiers"
    e = F.struct(F.expr("substring(category, 1, length(category) - 1)").alias("type"), F.when(is_word, named).otherwise(F.col("name")).alias("name"), "line", F.when(is_word, none).otherwise(F.col("function")).alias("function"), F.when(is_word, none).otherwise(F.col("class")).alias("class"))
    items = F.array_sort(F.collect_list(F.struct("term", "category_order", F.when(is_word, F.lit(0)).otherwise(F.col("pos")).alias("pos"), e.alias("e"))))
    # a record's matches are a part of its symbols; identifiers only count for terms that no symbol has
    hits = found.groupBy("id").agg(items.alias("items"), F.collect_set(F.when(~is_word, F.col("term"))).alias("seen"))
    kept = F.array_distinct(F.filter("items", lambda x: (x["category_order"] != IDENTIFIER) | ~F.array_contains("seen", x["term"])))
    out = hits.select("id", kept.alias("items"))
    matched = F.size(F.array_distinct(F.transform("items", lambda x: x["term"])))
    if categories is not None:
        out = out.where(matched == len(terms))
    evidence = F.transform(F.slice("items", 1, MOST_EVIDENCE), lambda x: x["e"])
    return out.select("id", (matched / F.lit(float(len(terms)))).alias("score"), evidence.alias("evidence")).orderBy(F.desc("score"), F.col("id").cast("string")).limit(k)


def ordered_pairs(events: DataFrame, first: Column, second: Column, scope: list[str], line: str, order: str, by: str = "id") -> DataFrame:
    """The first pair of each `by`: rows a and b of one scope (nulls alike) with a's line below b's.

    First means by a's place in `order`, then b's. No pairs are made to find it: the greatest line of the b in a scope tells which a have a
    partner, the least such a is taken, and then its least b. Each step is an aggregate with one row a key and task, or a join with one row a key.
    """
    columns = list(dict.fromkeys([*scope, line, order]))
    both = events.where(first | second).select(by, *columns, F.coalesce(first, F.lit(False)).alias("_a"), F.coalesce(second, F.lit(False)).alias("_b"))
    last = both.where("_b").groupBy(by, *scope).agg(F.max(line).alias("_last"))
    last = last.select(F.col(by).alias("_by"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(scope)), "_last")
    same = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(scope)]
    a = both.where("_a").join(last, reduce(lambda x, y: x & y, same, F.col(by) == F.col("_by"))).where(F.col(line) < F.col("_last"))
    least = a.groupBy(by).agg(F.min(F.struct(order, *(c for c in columns if c != order))).alias("a")).select(F.col(by).alias("_by"), "a")
    partner = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"a.{c}")) for c in scope], F.col(by) == F.col("_by"))
    b = both.where("_b").join(least, partner).where(F.col(line) > F.col(f"a.{line}"))
    best = b.groupBy(by).agg(F.first("a").alias("a"), F.min(F.struct(order, *(c for c in columns if c != order))).alias("b"))
    return best.select(by, *(F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in ("a", "b") for c in columns))


def call_order(records: DataFrame, first: str, second: str, k: int = 20, require_function: bool = False) -> DataFrame:
    """id, function, class and lines of the first ordered pair of calls; the first k records by pos, or by id without one.

    A record has all its calls in one array, so the pair is found where the record lies; see ordered_pairs() for events in rows.
    """
    usable = lambda c: c["line"].isNotNull() & (c["function"].isNotNull() if require_function else F.lit(True))
    partner = lambda a: lambda b: matches(b["name"], second) & usable(b) & a["function"].eqNullSafe(b["function"]) & a["class"].eqNullSafe(b["class"]) & (a["line"] < b["line"])
    leads = F.filter("calls", lambda a: matches(a["name"], first) & usable(a) & F.exists("calls", partner(a)))
    place = ["pos"] if "pos" in records.columns else []
    found = records.select("id", *place, F.get(leads, F.lit(0)).alias("a"), "calls").where("a IS NOT NULL")
    found = found.withColumn("b", F.get(F.filter("calls", partner(F.col("a"))), F.lit(0)))
    out = found.select("id", *place, F.lit(1.0).alias("score"), F.col("a.function").alias("function"), F.col("a.class").alias("class"), F.col("a.line").alias("first_line"), F.col("b.line").alias("second_line"))
    return out.orderBy(*place or ["id"]).limit(k).drop(*place)


def _keeper(category: str, term: str):
    return lambda s: symbol_matches(s["name"], F.lit(category), term)


def _shaper(category: str, has: set[str]):
    """A symbol as evidence; its type is the category without its last letter."""
    text = lambda s, c: s[c] if c in has else F.lit(None).cast("string")
    return lambda s: F.struct(F.lit(category[:-1]).alias("type"), s["name"].alias("name"), s["line"].alias("line"), text(s, "function").alias("function"), text(s, "class").alias("class"), F.lit(None).cast("int").alias("depth"))


def structural(records: DataFrame, query: str, terms: list[str], k: int = 20) -> DataFrame:
    """Call order, recursion and nested loops, as the query's words ask; see Unsupported."""
    text = query.lower()
    if (" before " in text or " after " in text) and len(terms) >= 2:
        pair = terms[:2] if " before " in text else terms[1::-1]
        return call_order(records, *pair, k=k, require_function="function" in text or "method" in text)
    recursion, nested = "recursive" in text or "recursion" in text, "nested loop" in text
    if not (recursion or nested):
        raise Unsupported("structural queries cover recursion, nested loops, or two named calls before or after each other")
    score, evidence, rows = F.lit(0.0), [], records
    item = "array<struct<type:string,name:string,line:int,function:string,class:string,depth:int>>"
    make = lambda kind, name, line=None, cls=None, depth=None: F.struct(F.lit(kind).alias("type"), name.alias("name"), (F.lit(None).cast("int") if line is None else line).alias("line"), F.lit(None).cast("string").alias("function"), (F.lit(None).cast("string") if cls is None else cls).alias("class"), (F.lit(None).cast("int") if depth is None else depth).alias("depth"))
    if recursion:
        rows = rows.where(F.size("recursive_functions") > 0)
        score = score + 2.0
        of = lambda n: F.get(F.filter("functions", lambda f: f["name"] == n), 0)
        evidence.append(F.transform("recursive_functions", lambda n: make("recursive_function", n, of(n)["line"], of(n)["class"])))
    if nested:
        scope = "class" if "class" in text else "function" if "function" in text or "method" in text else None
        if scope:
            deep = F.map_filter(f"{scope}_loop_depths", lambda _, d: d >= 2)
            rows = rows.where(F.size(deep) > 0)
            score = score + F.array_max(F.map_values(deep))
            evidence.append(F.transform(F.map_entries(deep), lambda e: make(f"nested_loops_in_{scope}", e["key"], depth=e["value"])))
        else:
            rows = rows.where("max_loop_depth >= 2")
            score = score + F.col("max_loop_depth")
            evidence.append(F.array(make("loop_structure", F.lit("nested loops"), depth=F.col("max_loop_depth"))))
    for term in terms:
        found = []
        for category in CATEGORIES:
            has = {f.name for f in records.schema[category].dataType.elementType.fields}
            found.append(F.transform(F.filter(category, _keeper(category, term)), _shaper(category, has)))
        all_found = F.concat(*found)
        score = score + F.when(F.size(all_found) > 0, 0.25).otherwise(0.0)
        evidence.append(F.slice(all_found, 1, PER_TERM))
    listed = F.slice(F.concat(*(e.cast(item) for e in evidence)), 1, MOST_EVIDENCE)
    return rows.select("id", score.cast("double").alias("score"), listed.alias("evidence")).where("score > 0").orderBy(F.desc("score"), F.col("id").cast("string")).limit(k)
