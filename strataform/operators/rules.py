"""Rules and templates as rows: conditions and values are expressions in text, checked and compiled into columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The order of severities.
SEVERITIES = {"critical": 3, "warn": 2, "info": 1}
#: The types that a template's parameters may have, and what a value must be.
PARAMETERS: dict[str, Callable[[object], bool]] = {
    "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and x == x and abs(x) != float("inf"), "integer": lambda x: isinstance(x, int) and not isinstance(x, bool),
    "boolean": lambda x: isinstance(x, bool), "string": lambda x: isinstance(x, str),
}


class RuleError(ValueError):
    """A rule or template that can't be compiled."""


def checked(df: DataFrame, text: str, kinds: tuple[type, ...]) -> Column:
    """The expression as a column of df, if it can be resolved there and has one of the types."""
    try:
        kind = df.limit(0).select(F.expr(text).alias("x")).schema["x"].dataType
    except Exception as e:
        raise RuleError(f"{text!r}: {str(e).splitlines()[0]}") from None
    if not isinstance(kind, kinds):
        raise RuleError(f"{text!r} is {kind.simpleString()}")
    return F.expr(text).cast("double") if isinstance(kind, T.DecimalType) else F.expr(text)  # so that 0.5 and 0.50 are one value


def fired(df: DataFrame, rules: Iterable[dict], enabled: dict[str, bool] | None = None, most: int | None = None) -> DataFrame:
    """df's columns with rank, rule_id, agent, severity, confidence, title, patch and tool of each action that its row leads to, best first.

    A rule has id, agent, when (a boolean expression), severity, confidence (an expression or a number) and title, and a
    patch (names with expressions, in order) or a tool (text). Rules are tried in order; of actions with the same patch
    (names and values), the same tool or, if they have neither, the same title, the first stands; then they go by
    severity, confidence and order. A condition or confidence that is null doesn't fire, or counts as 0. All rules are
    one expression over a row: no row is shuffled. enabled: agents that are off; most: actions a row.
    """
    live = [r for r in rules if (enabled or {}).get(r["agent"], True)]
    for r in live:
        if r["severity"] not in SEVERITIES:
            raise RuleError(f"{r['id']}: severity {r['severity']!r}")
    action = "struct<order:int,rule_id:string,agent:string,severity:string,confidence:double,title:string,patch:map<string,string>,tool:string,mark:string>"

    def one(k: int, r: dict) -> Column:
        values = {n: checked(df, str(e), (T.NumericType, T.StringType, T.BooleanType)).cast("string") for n, e in (r.get("patch") or {}).items()}
        patch = F.create_map(*(x for n, v in values.items() for x in (F.lit(n), v))) if values else F.lit(None)
        mark = F.concat(F.lit("p:"), F.to_json(F.struct(*(v.alias(n) for n, v in values.items())), {"ignoreNullFields": "false"})) if values else F.lit(f"t:{r['tool']}" if r.get("tool") else f"x:{r['title']}")
        sure = F.coalesce(checked(df, str(r.get("confidence", 0)), (T.NumericType,)).cast("double"), F.lit(0.0))
        made = F.struct(F.lit(k).alias("order"), F.lit(r["id"]).alias("rule_id"), F.lit(r["agent"]).alias("agent"), F.lit(r["severity"]).alias("severity"), sure.alias("confidence"), F.lit(r["title"]).alias("title"), patch.cast("map<string,string>").alias("patch"), F.lit(r.get("tool")).cast("string").alias("tool"), mark.alias("mark"))
        return F.when(checked(df, r["when"], (T.BooleanType,)), made.cast(action))

    if not live:
        return df.select("*", F.explode(F.array().cast(f"array<{action}>")).alias("a")).select(*df.columns, F.lit(0).alias("rank"), *(F.col(f"a.{c}") for c in ("rule_id", "agent", "severity", "confidence", "title", "patch", "tool")))
    all_ = F.array_compact(F.array(*(one(k, r) for k, r in enumerate(live))))
    marks = F.transform("_all", lambda a: a["mark"])
    first = F.filter("_all", lambda a, i: F.array_position(F.col("_marks"), a["mark"]) == i + 1)
    level = lambda a: F.coalesce(*(F.when(a["severity"] == s, -n) for s, n in SEVERITIES.items()))
    keyed = F.transform(first, lambda a: F.struct(level(a).alias("level"), (-a["confidence"]).alias("sure"), a["order"].alias("order"), a.alias("a")))
    best = F.array_sort(keyed, lambda x, y: F.when(x["level"] != y["level"], x["level"] - y["level"]).when(x["sure"] < y["sure"], -1).when(x["sure"] > y["sure"], 1).otherwise(x["order"] - y["order"]))
    best = F.slice(best, 1, most) if most else best
    out = df.withColumn("_all", all_).withColumn("_marks", marks).select(*df.columns, F.posexplode(best).alias("_at", "_x"))
    return out.select(*df.columns, (F.col("_at") + 1).alias("rank"), *(F.col(f"_x.a.{c}").alias(c) for c in ("rule_id", "agent", "severity", "confidence", "title", "patch", "tool")))


def compiled(template: dict, values: dict | None = None) -> dict[str, str]:
    """The outputs of a template as expressions in text, with its parameters' values in place.

    A template has parameters (name: {type, default, least, most, choices}), outputs (name: an expression with {name} for
    a parameter, or an earlier output's name in braces), and may extend another one, whose parameters and outputs it
    overrides. A value that is missing, unknown, of another type, out of range or no choice is a RuleError, as is an
    output that uses what isn't there.
    """
    chain, at = [], template
    while at is not None:
        if any(at is x for x in chain):
            raise RuleError("a template that extends itself")
        chain.insert(0, at)
        at = at.get("extends")
    parameters = {k: v for t in chain for k, v in t.get("parameters", {}).items()}
    outputs = {k: v for t in chain for k, v in t.get("outputs", {}).items()}
    if unknown := set(values or {}) - set(parameters):
        raise RuleError(f"unknown parameter {sorted(unknown)[0]}")
    text: dict[str, str] = {}
    for name, p in parameters.items():
        value = (values or {}).get(name, p.get("default"))
        if value is None or p["type"] not in PARAMETERS or not PARAMETERS[p["type"]](value):
            raise RuleError(f"{name}: {value!r} is no {p['type']}")
        if ("least" in p and value < p["least"]) or ("most" in p and value > p["most"]) or ("choices" in p and value not in p["choices"]):
            raise RuleError(f"{name}: {value!r} isn't allowed")
        text[name] = "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else f"({value!r}{'D' if isinstance(value, float) else ''})"
    made: dict[str, str] = {}
    for name, expression in outputs.items():
        try:
            made[name] = text[name] = f"({expression.format(**text)})"
        except (KeyError, IndexError) as e:
            raise RuleError(f"{name}: {e} isn't there") from None
    return made


def filled(df: DataFrame, template: dict, values: dict | None = None) -> DataFrame:
    """df with a column for each output of the template, checked against df's columns."""
    kinds = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType)
    return df.select("*", *(checked(df, e, kinds).alias(n) for n, e in compiled(template, values).items()))


def variants(df: DataFrame, template: dict, table: Iterable[dict], name: str = "variant") -> DataFrame:
    """df's rows, once for each row of a parameter table (with its name), with the template's outputs: one pass over df."""
    rows = list(table)
    outputs = [compiled(template, {k: v for k, v in r.items() if k != name}) for r in rows]
    kinds = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType)
    each = [F.struct(F.lit(str(r[name])).alias(name), *(checked(df, e, kinds).alias(n) for n, e in o.items())) for r, o in zip(rows, outputs)]
    return df.select("*", F.explode(F.array(*each)).alias("_v")).select(*df.columns, "_v.*")
