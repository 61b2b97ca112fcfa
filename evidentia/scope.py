"""Tenant scope: every read of a tenant-owned table passes through it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SETTING = "evidentia.tenant"
# Operators that keep a row's tenant as it is; a filter above any other one comes too late.
KEEPS_ROWS = {"Project", "Filter", "Join", "Sort", "RepartitionByExpression", "Repartition", "SubqueryAlias", "Generate", "ResolvedHint", "View"}


class ScopeError(ValueError):
    """A plan that reads a tenant's table without the tenant's predicate."""


def _children(x) -> list:
    c = x.children()
    return [c.apply(i) for i in range(c.size())]


def _kind(x) -> str:
    return x.getClass().getSimpleName()


def _fixed(condition, value: str) -> set[int]:
    """Ids of the attributes that a condition's conjuncts hold equal to a value."""
    if _kind(condition) == "And":
        return _fixed(condition.left(), value) | _fixed(condition.right(), value)
    if _kind(condition) in ("EqualTo", "EqualNullSafe"):
        sides = (condition.left(), condition.right())
        for a, b in (sides, sides[::-1]):
            if _kind(a) == "AttributeReference" and _kind(b) == "Literal" and str(b.value()) == value:
                return {a.exprId().id()}
    return set()


def check_scope(df: DataFrame, tenant_id, column: str = "tenant_id") -> DataFrame:
    """The frame itself, if each table with a tenant column that its plan reads is filtered by this tenant; else ScopeError.

    The optimised plan is walked from the top: a filter counts for the tables below it as long as only joins, projections and the like stand
    between, so a window, an aggregate or a limit over all tenants that is filtered afterwards is refused too.
    """

    def walk(node, fixed: set[int]) -> None:
        if _kind(node) == "Filter":
            fixed = fixed | _fixed(node.condition(), str(tenant_id))
        below = _children(node)
        if not below:
            out = node.output()
            for a in (out.apply(i) for i in range(out.size())):
                if a.name() == column and a.exprId().id() not in fixed:
                    raise ScopeError(f"a table is read without {column} = {tenant_id}: {node.simpleStringWithNodeId()[:200]}")
        for child in below:
            walk(child, fixed if _kind(node) in KEEPS_ROWS else set())

    walk(df._jdf.queryExecution().optimizedPlan(), set())
    return df


class TenantScope:
    """Injects tenant (and coverage) predicates, so they reach the scan as pushed filters."""

    def __init__(self, tenant_id, coverage_id=None):
        if tenant_id is None or tenant_id == "":
            raise ValueError("a tenant is required")
        self.tenant_id, self.coverage_id = tenant_id, coverage_id

    @classmethod
    def of_session(cls, spark: SparkSession, coverage_id=None) -> TenantScope:
        """The tenant that the session is set to. Without one, or with an empty one, the scope holds no rows."""
        scope = cls.__new__(cls)
        scope.tenant_id, scope.coverage_id = spark.conf.get(SETTING, "") or None, coverage_id
        return scope

    def table(self, df: DataFrame, column: str = "tenant_id") -> DataFrame:
        return df.filter(F.lit(False) if self.tenant_id is None else F.col(column) == F.lit(self.tenant_id).cast(df.schema[column].dataType))

    def through(self, df: DataFrame, coverages: DataFrame, key: str = "coverage_id") -> DataFrame:
        """Tables without a tenant column are scoped by a semi join with the tenant's coverages."""
        return df.join(self.table(coverages).select(key), key, "left_semi")

    def searchable(self, chunks: DataFrame, *more: Column) -> DataFrame:
        """Tenant, coverage and searchable type must hold; further conditions are added, never replace them."""
        if self.coverage_id is None or self.coverage_id == "" or self.tenant_id is None:
            raise ValueError("a search needs a coverage")
        must = [F.col("tenant_id") == self.tenant_id, F.col("coverage_id") == self.coverage_id, F.col("chunk_type").isin("child", "table"), *more]
        return check_scope(chunks.filter(reduce(Column.__and__, must)), self.tenant_id)
