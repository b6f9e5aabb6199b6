"""Boolean filters, access rules and request checks as Column builders."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Condition:
    """A key equal to, or any of, the values; on an array column: contains or overlaps."""

    key: str
    values: tuple

    def column(self, frame: DataFrame) -> Column:
        kind = frame.schema[self.key].dataType.typeName()
        c = F.col(self.key)
        if kind == "array":
            return F.arrays_overlap(c, F.array(*map(F.lit, self.values)))
        return c == F.lit(self.values[0]) if len(self.values) == 1 else c.isin(*self.values)


@dataclass(frozen=True)
class Filter:
    """All of ``must``, any of ``should`` if there are some, none of ``must_not``."""

    must: tuple[Condition, ...] = ()
    should: tuple[Condition, ...] = ()
    must_not: tuple[Condition, ...] = ()

    def merge(self, other: Filter) -> Filter:
        return Filter(self.must + other.must, self.should + other.should, self.must_not + other.must_not)

    def column(self, frame: DataFrame) -> Column:
        parts = [c.column(frame) for c in self.must]
        if self.should:
            parts.append(reduce(or_, [c.column(frame) for c in self.should]))
        if self.must_not:
            parts.append(~reduce(or_, [F.coalesce(c.column(frame), F.lit(False)) for c in self.must_not]))
        return reduce(and_, parts) if parts else F.lit(True)

    def apply(self, frame: DataFrame) -> DataFrame:
        return frame.filter(self.column(frame))


def parse_request(raw: dict) -> Filter:
    """``{key: value or list}`` or ``{"must": [...]}``; the tenant is never the caller's choice."""
    if "should" in raw or "must_not" in raw:
        raise ValueError("only must conditions are accepted")
    pairs = [(m["key"], m["value"]) for m in raw["must"]] if "must" in raw else list(raw.items())
    found = []
    for key, value in pairs:
        if key == "tenant_id":
            continue
        values = tuple(value) if isinstance(value, list) else (value,)
        if not values or not all(isinstance(v, str) for v in values):
            raise ValueError(f"{key}: strings are needed")
        found.append(Condition(key, values))
    return Filter(must=tuple(found))


@dataclass(frozen=True)
class User:
    user_id: str
    tenant_id: str
    groups: tuple[str, ...] = ()
    is_admin: bool = False


def _any(column: str, values: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.col(column), F.array(*map(F.lit, values))) if values else F.lit(False)


def acl_prefilter(frame: DataFrame, user: User, super_tenants: tuple[str, ...] = ()) -> Column:
    """What a scan may return at all: active rows of the tenant, reachable one way, on no deny list."""
    must = [Condition("status", ("active",))]
    if user.tenant_id not in super_tenants:
        must.append(Condition("tenant_id", (user.tenant_id,)))
    base = Filter(must=tuple(must)).column(frame)
    reach = (
        (F.col("visibility") == "public")
        | (F.col("visibility") == "tenant")
        | _any("allowed_groups", user.groups)
        | F.array_contains("allowed_users", user.user_id)
        | (F.col("owner_id") == user.user_id)
    )
    return base & reach & ~F.array_contains("denied_users", user.user_id) & ~_any("denied_groups", user.groups)


def acl_can_access(user: User, enabled: bool = True, check_tenant: bool = True) -> Column:
    """The full rule: admin, then tenant, then denials, then visibility."""
    if not enabled or user.is_admin:
        return F.lit(True)
    own = F.col("owner_id") == user.user_id
    named = F.array_contains("allowed_users", user.user_id)
    grouped = _any("allowed_groups", user.groups)
    by_kind = (
        F.when(F.col("visibility").isin("public", "tenant"), True)
        .when(F.col("visibility") == "group", grouped | named | own)
        .when(F.col("visibility") == "private", own | named)
        .otherwise(False)
    )
    denied = F.array_contains("denied_users", user.user_id) | _any("denied_groups", user.groups)
    verdict = F.when(denied, False).otherwise(by_kind)
    return F.when(F.col("tenant_id") != user.tenant_id, False).otherwise(verdict) if check_tenant else verdict


def acl_simple(groups: tuple[str, ...]) -> Column:
    """Visibility and groups only; private rows are never shown."""
    return F.when(F.col("visibility").isin("public", "tenant"), True).when(F.col("visibility") == "group", _any("allowed_groups", groups)).otherwise(False)


def acl_store(tenant_id: str, groups: tuple[str, ...], include_public: bool = True) -> Column:
    reach = _any("allowed_groups", groups)
    return (F.col("tenant_id") == tenant_id) & ((F.col("visibility") == "public") | reach if include_public else reach)


def group_access(groups: tuple[str, ...]) -> Column:
    return (F.col("visibility") == "public") | _any("allowed_groups", groups)


def bounds(field_: str, gte: object = None, lte: object = None, gt: object = None, lt: object = None) -> Column:
    c, parts = F.col(field_), []
    for value, test in ((gte, c.__ge__), (lte, c.__le__), (gt, c.__gt__), (lt, c.__lt__)):
        if value is not None:
            parts.append(test(F.lit(value)))
    return reduce(and_, parts) if parts else F.lit(True)


def any_of(field_: str, values: list[str]) -> Column:
    return F.col(field_).isin(*values) if values else F.lit(True)


def exclude(field_: str, value: object) -> Column:
    return ~F.col(field_).eqNullSafe(F.lit(value))


def exists(frame: DataFrame, field_: str) -> Column:
    return F.size(field_) > 0 if frame.schema[field_].dataType.typeName() == "array" else F.col(field_).isNotNull()


def contains_ignoring_case(field_: str, part: str) -> Column:
    """A literal substring: wildcards in it stand for themselves."""
    return F.contains(F.lower(F.col(field_)), F.lit(part.lower()))


@dataclass(frozen=True)
class Request:
    """A retrieval request within its bounds."""

    query: str
    top_k: int = 10
    rerank_top_k: int | None = None
    min_score: float = 0.0
    semantic_weight: float | None = None
    keyword_weight: float | None = None
    filters: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not 1 <= len(self.query.encode()) <= 2000:
            raise ValueError("query: 1 to 2000 bytes")
        for name in ("top_k", "rerank_top_k"):
            value = getattr(self, name)
            if value is not None and not 1 <= value <= 100:
                raise ValueError(f"{name}: 1 to 100")
        for name in ("min_score", "semantic_weight", "keyword_weight"):
            value = getattr(self, name)
            if value is not None and not 0 <= value <= 1:
                raise ValueError(f"{name}: 0 to 1")


def within_bounds(query: Column, top_k: Column, rerank_top_k: Column, min_score: Column) -> Column:
    """The bounds of ``Request`` for rows of requests; absent options are within them."""
    share = F.coalesce(min_score.between(0, 1), F.lit(True))
    return F.coalesce(F.octet_length(query).between(1, 2000), F.lit(False)) & F.coalesce(top_k.between(1, 100), F.lit(True)) & F.coalesce(rerank_top_k.between(1, 100), F.lit(True)) & share


#: What a frame needs to stand under the access rules.
ACL_COLUMNS = {
    "tenant_id": "string",
    "visibility": "string",
    "owner_id": "string",
    "allowed_groups": "array<string>",
    "allowed_users": "array<string>",
    "denied_users": "array<string>",
    "denied_groups": "array<string>",
    "status": "string",
}


def acl_rows(frame: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The extension point for rows of any kind: ``columns`` says where each access column comes from.

    Lists that a source does not have are empty, other columns null, status is
    active; a name that is no access column is an error.
    """
    odd = set(columns) - set(ACL_COLUMNS)
    if odd:
        raise ValueError(f"no access columns: {sorted(odd)}")
    absent = {"status": F.lit("active")}
    added = {}
    for name, kind in ACL_COLUMNS.items():
        default = F.array().cast(kind) if kind.startswith("array") else absent.get(name, F.lit(None))
        added[name] = F.coalesce(columns[name].cast(kind), default.cast(kind)) if name in columns else default.cast(kind)
    return frame.withColumns(added)
