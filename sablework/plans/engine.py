"""Redaction and explanation of text columns under a policy.

A policy compiles once, on the driver, to column expressions: one column of
matches per detector, then the sorted spans, then the spliced text. The plan is
narrow (no shuffle) and works on batch and streaming DataFrames alike. Null text
gives null text and no spans.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sablework.functions.spans import SPAN, drop_contained, let, sorted_spans, splice, sql_name
from sablework.operators.detectors import Detector, RegexDetector, compile_detectors
from sablework.plans.policy import Policy, PolicyError, parse_policy, parse_policy_yaml
from sablework.plans.policy_table import OWN_ENGINE, PLAN, explain_by_policy, fits_table, plan_of, policy_plans, uses_of

#: Offsets of spans in the output of explain_rows().
SPAN_FIELDS = ("character_start", "character_end", "filter_type", "context", "confidence", "text", "replacement", "ignored", "applied")


class Engine:
    """``overlap``: "keep" (spans of different detectors may overlap, each is applied) or "drop" (contained ones go).
    ``word_lists``: tables (word, position) that dictionaries name among their files."""

    def __init__(
        self,
        policy: str | Mapping | Policy,
        *,
        models: list | None = None,
        detectors: list[Detector] | None = None,
        overlap: str = "keep",
        read_lines: Callable[[str], list[str]] | None = None,
        word_lists: Mapping[str, DataFrame] | None = None,
    ) -> None:
        if overlap not in ("keep", "drop"):
            raise ValueError(f"overlap is keep or drop, not {overlap!r}")
        self.policy, self.overlap = parse_policy(policy), overlap
        self.detectors = compile_detectors(self.policy, models, read_lines, word_lists) + list(detectors or [])

    @classmethod
    def from_yaml(cls, source: str, **more) -> Engine:
        return cls(parse_policy_yaml(source), **more)

    def spans_column(self, matches: list[Column], context: Column) -> Column:
        if not matches:
            return F.array().cast(f"array<{SPAN}>")
        parts = [d.spans(m, context).cast(f"array<{SPAN}>") for d, m in zip(self.detectors, matches, strict=True)]
        spans = let(F.concat(*parts), lambda s: F.when(F.size(s) < 2, s).otherwise(sorted_spans(s)))
        return let(spans, lambda s: drop_contained(s, f"array<{SPAN}>", "character_start", "character_end")) if self.overlap == "drop" else spans

    def explain(self, df: DataFrame, text: str = "text", context: str | Column | None = None, spans: str = "spans") -> DataFrame:
        """``df`` with a column of spans in order of their start."""
        where = context if isinstance(context, Column) else F.coalesce(F.col(context), F.lit("")) if context else F.lit("")
        # Names that no column of the input has.
        free = "__"
        while any(c.startswith(free) for c in df.columns):
            free += "_"
        digit, names = f"{free}digit", [f"{free}m{i}" for i in range(len(self.detectors))]
        # Matches are columns of a projection of their own, so that what follows reads them and doesn't search again.
        # Detectors that need more than an expression of the text go first: they may have to write the rows.
        given = df
        for n, d in zip(names, self.detectors, strict=True):
            if hasattr(d, "attach"):
                given = d.attach(given, text, n)
        facts = given.withColumn(digit, F.rlike(F.col(text), F.lit("[0-9]"))) if names else given
        of = lambda d: d.matches(sql_name(text), digit) if isinstance(d, RegexDetector) else d.matches(sql_name(text))
        columns = {n: of(d) for n, d in zip(names, self.detectors, strict=True) if not hasattr(d, "attach")}
        found = facts.withColumns(columns).drop(digit) if names else given
        out = self.spans_column([F.col(n) for n in names], where)
        return found.withColumn(spans, F.coalesce(out, F.array().cast(f"array<{SPAN}>"))).drop(*names)

    def redact(self, df: DataFrame, text: str = "text", context: str | Column | None = None, out: str = "filtered_text", spans: str = "spans") -> DataFrame:
        """``df`` with its spans and the text in which they are replaced."""
        return self.explain(df, text, context, spans).withColumn(out, splice(F.col(text), F.col(spans)))

    def explain_rows(self, df: DataFrame, text: str = "text", context: str | Column | None = None) -> DataFrame:
        """One row per span: the columns of ``df`` but the text, ``position`` and the span's fields (its text as ``token``).
        A column of ``df`` with the name of one of these gets ``input_`` before its name."""
        # The outer form: the plain one would have the spans worked out once more, for a filter on their number.
        keep = [c for c in df.columns if c not in (text, "context")]
        fields = {"position": "position"} | {"token" if f == "text" else f: f"span.{f}" for f in SPAN_FIELDS}
        own = {c: f"input_{c}" if c in fields or c in ("spans", "span") else c for c in keep}
        given = df.withColumnsRenamed(own)
        rows = self.explain(given, text, context).select(*own.values(), F.posexplode_outer("spans").alias("position", "span")).where("position is not null")
        return rows.select(*own.values(), *[F.col(c).alias(name) for name, c in fields.items()])


def redact(df: DataFrame, policy: str | Mapping | Policy | None = None, policy_yaml: str | None = None, **more) -> DataFrame:
    """One-shot redaction under a policy in JSON (or a dict), or in YAML."""
    engine = Engine(parse_policy_yaml(policy_yaml) if policy is None else policy)
    return engine.redact(df, **more)


class PolicyNotFound(KeyError):
    pass


def redact_requests(requests: DataFrame, policies: Mapping[str, str | Mapping | Policy] | DataFrame, explain_only: bool = False, **engine) -> DataFrame:
    """Requests (text, context, policy, document_id, file_name; text and policy required) under the policies they name.

    ``policies``: by name, or a table (name, policy as JSON; unique by name), as PolicyStore keeps it. All rows are searched in one scan,
    joined to the policies; only policies that have dictionaries or models and that some request names, or all where ``engine`` adds
    detectors to policies by name, take a branch of the plan each. A request without text or policy, or with a policy that isn't there or (in a table) can't be used, gets an
    ``error`` and no result. A missing document_id becomes a new one.
    """
    own: dict[str, Policy] = {}
    if isinstance(policies, DataFrame):
        if "detectors" in engine or "models" in engine:
            raise ValueError("detectors and models go with policies by name")
        plans, uses = policy_plans(policies), None
        apart_names = plans.where(F.col("plan.error") == OWN_ENGINE).select("name")
        if not requests.isStreaming and not apart_names.isEmpty():
            asked = apart_names.join(requests.select(F.col("policy").alias("name")), "name", "left_semi")
            own = {r.name: parse_policy(r.policy) for r in policies.join(asked, "name", "left_semi").collect()}
    else:
        parsed = {name: parse_policy(p) for name, p in policies.items()}
        own = {name: p for name, p in parsed.items() if engine.get("detectors") or not fits_table(p)}
        rows = [(name, {"error": None, "blocks": {}} if name in own else plan_of(p)) for name, p in parsed.items()]
        uses = uses_of([plan for _, plan in rows])
        kind = PLAN.replace("error string", "error:string").replace("blocks map", "blocks:map")
        plans = requests.sparkSession.createDataFrame(rows, f"name string, plan struct<{kind}>")
    base = requests.withColumn("document_id", F.coalesce(F.nullif(F.col("document_id"), F.lit("")), F.uuid()))
    apart = F.col("policy").isin(list(own)) if own else F.lit(False)
    # Without text nothing is searched, whatever the policy.
    found = explain_by_policy(base.where(~F.coalesce(apart, F.lit(False))), plans, context="context", overlap=engine.get("overlap", "keep"), uses=uses)
    bad = lambda other: F.when(F.coalesce(F.col("text"), F.lit("")) == "", F.lit("text is required")).otherwise(other)
    found = found.withColumn("error", bad(F.col("policy_error"))).drop("policy_error")
    text = F.when(F.col("error").isNull(), splice(F.col("text"), F.col("spans")))
    result = found.withColumn("filtered_text", text).select(*base.columns, "error", "spans", "filtered_text")
    for name, policy in own.items():
        rows = Engine(policy, **engine).redact(base.where(F.col("policy") == name).withColumn("error", bad(F.lit(None).cast("string"))), context="context")
        result = result.unionByName(rows.withColumn("filtered_text", F.when(F.col("error").isNull(), F.col("filtered_text"))))
    return result.drop("filtered_text") if explain_only else result


__all__ = ["Engine", "PolicyError", "PolicyNotFound", "redact", "redact_requests"]
