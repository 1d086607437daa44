"""Policies as data: any number of policies in one scan, each row under the one it names.

A policy becomes a row: its name, and by block what a detector has to know (which form, what is ignored, what goes in the
place). Requests join that table, which Spark broadcasts by its measured size, and each detector works on a row only if
the row's policy has its block. Blocks that need more than a row can carry (dictionaries, models) are not for this table.
"""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from sablework.functions.dialect import to_java
from sablework.functions.replacements import replacement_by_row, resolve
from sablework.functions.spans import SPAN, drop_contained, let, no_matches, sorted_spans, sql_name
from sablework.operators.detectors import RegexDetector, span_structs
from sablework.operators.patterns import KINDS, Kind
from sablework.plans.policy import Block, Policy, PolicyError, parse_policy

#: What a detector has to know of a row's policy.
BLOCK = (
    "struct<strict:boolean,ignored:array<string>,patterns:array<string>,mode:string,replacement:string,days:int,months:int,years:int>"
)
PLAN = f"error string, blocks map<string,{BLOCK}>"
#: The error of a policy that is fine but doesn't fit the table.
OWN_ENGINE = "dictionaries and models need an engine of their own"
#: The one option of a block that changes what is found.
STRICT = {"creditCard": "onlyValidCreditCardNumbers", "url": "requireHttpWwwPrefix", "zipCode": "requireDelimiter"}


def fits_table(policy: Policy) -> bool:
    return not any(b.enabled for b in policy.models + policy.dictionaries)


def block_row(kind: Kind, block: Block) -> dict:
    how = resolve(block.strategy, kind.filter_type)
    return {
        "strict": bool(block.options.get(STRICT.get(kind.key, ""))), "ignored": sorted({t.lower() for t in block.ignored}),
        "patterns": [to_java(p.pattern, not p.case_sensitive) for p in block.ignored_patterns],
        "mode": how.mode, "replacement": how.text, "days": how.days, "months": how.months, "years": how.years,
    }


def plan_of(policy: str | Mapping | Policy | None) -> dict:
    """A policy's row; one that can't be read, or that needs an engine of its own, has an error and no blocks."""
    try:
        if policy is None:
            raise PolicyError("no policy text")
        parsed = parse_policy(policy)
        if not fits_table(parsed):
            raise PolicyError(OWN_ENGINE)
        return {"error": None, "blocks": {k.key: block_row(k, b) for k in KINDS if (b := parsed.blocks.get(k.key)) and b.enabled}}
    except PolicyError as e:
        return {"error": str(e), "blocks": {}}


def policy_plans(policies: DataFrame) -> DataFrame:
    """name, plan of a table of policies (name, policy as JSON), worked out where the rows are."""
    kind = to_arrow_type(StructType.fromDDL(PLAN))

    @F.arrow_udf(f"struct<{PLAN.replace('error string', 'error:string').replace('blocks map', 'blocks:map')}>")
    def plan(texts: pa.Array) -> pa.Array:
        made = [plan_of(t) for t in texts.to_pylist()]
        return pa.array([{"error": p["error"], "blocks": list(p["blocks"].items())} for p in made], kind)

    return policies.select("name", plan("policy").alias("plan"))


#: Of a block: its name, how it replaces, whether it is strict and whether it ignores anything.
Use = tuple[str, str, bool, bool]


def uses_of(plans: list[dict]) -> set[Use]:
    return {(k, b["mode"], b["strict"], bool(b["ignored"] or b["patterns"])) for p in plans for k, b in p["blocks"].items()}


def uses_in(plans: DataFrame) -> set[Use]:
    """The same of a table: a few rows, as there are few blocks and modes."""
    rows = plans.select(F.explode("plan.blocks").alias("key", "b"))
    ignores = (F.size("b.ignored") > 0) | (F.size("b.patterns") > 0)
    return {tuple(r) for r in rows.select("key", "b.mode", "b.strict", ignores).distinct().collect()}


def explain_by_policy(
    df: DataFrame, plans: DataFrame, policy: str = "policy", text: str = "text", context: str | Column | None = None, spans: str = "spans", overlap: str = "keep",
    uses: set[Use] | None = None,
) -> DataFrame:
    """``df`` with the spans of each row under the policy that it names, and ``policy_error`` where that is missing or can't be used.

    ``plans`` (name, plan) is unique by name, as policy_plans() or plan_of() make it. ``uses`` says which blocks its policies have;
    only for these there are detectors in the plan. Without it, the table is looked through.
    """
    uses = uses_in(plans) if uses is None else uses
    kinds = [k for k in KINDS if any(u[0] == k.key for u in uses)]
    where = context if isinstance(context, Column) else F.coalesce(F.col(context), F.lit("")) if context else F.lit("")
    free = "__"
    while any(c.startswith(free) for c in df.columns):
        free += "_"
    name, plan, digit = f"{free}name", f"{free}plan", f"{free}digit"
    given = df.join(plans.select(F.col("name").alias(name), F.col("plan").alias(plan)), F.col(policy) == F.col(name), "left")
    unknown = F.when(F.col(policy).isNull() | (F.col(policy) == ""), F.lit("policy is required")).when(F.col(name).isNull(), F.concat(F.lit("no policy "), F.col(policy)))
    error = F.coalesce(unknown, F.concat(F.lit("policy "), F.col(policy), F.lit(": "), F.col(f"{plan}.error")))
    facts = given.withColumns({"policy_error": error, digit: F.rlike(F.col(text), F.lit("[0-9]"))})
    block = lambda k: F.try_element_at(F.col(f"{plan}.blocks"), F.lit(k.key))

    def found(kind: Kind) -> Column:
        usual = RegexDetector(kind, Block(kind.key)).matches(sql_name(text), digit)
        out = F.when(block(kind).isNull(), no_matches())
        if any(u[0] == kind.key and u[2] for u in uses):
            strict = RegexDetector(kind, Block(kind.key, options={STRICT[kind.key]: True})).matches(sql_name(text), digit)
            out = out.when(block(kind)["strict"], strict)
        return F.coalesce(out.otherwise(usual), no_matches())

    def as_spans(kind: Kind, matches: Column) -> Column:
        b, own = block(kind), [u for u in uses if u[0] == kind.key]
        found_in = lambda t: F.array_contains(b["ignored"], F.lower(t)) | F.exists(b["patterns"], lambda p: F.rlike(t, p))
        ignored = found_in if any(u[3] for u in own) else lambda t: F.lit(False)
        instead = lambda t: replacement_by_row(b, kind.filter_type, t, where, {u[1] for u in own})
        return span_structs(matches, kind.filter_type, where, ignored, instead).cast(f"array<{SPAN}>")

    names = {f"{free}{i}": k for i, k in enumerate(kinds)}
    searched = facts.withColumns({n: found(k) for n, k in names.items()})
    parts = [F.when(F.size(n) > 0, as_spans(k, F.col(n))).otherwise(F.array().cast(f"array<{SPAN}>")) for n, k in names.items()]
    none = F.array().cast(f"array<{SPAN}>")
    out = let(F.concat(none, *parts), lambda s: F.when(F.size(s) < 2, s).otherwise(sorted_spans(s)))
    if overlap == "drop":
        out = let(out, lambda s: drop_contained(s, f"array<{SPAN}>", "character_start", "character_end"))
    return searched.withColumn(spans, F.coalesce(out, F.array().cast(f"array<{SPAN}>"))).drop(*names, name, plan, digit)
