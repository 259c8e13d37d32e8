"""Feature declarations: templates, instances, their validation, leakage checks, and snapshots of what was agreed.

A template is a Python function from a frame of trades and parameters to a column; nothing is rendered as text,
so there is nothing to escape.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime
from functools import cached_property
from types import MappingProxyType
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fill policies and kinds of features.
POLICIES = ("zero", "causal_ffill", "null", "derived")
KINDS = ("time_based", "event_based", "time_point", "target")
_HORIZONS = ("own_lookback_ms", "own_lookforward_ms")
#: The names of a tape's columns, which parameters of the same name replace.
COLUMNS = MappingProxyType({"time_column": "ms", "id_column": "trade_id", "symbol_column": "symbol", "price_column": "price", "quantity_column": "quantity", "side_column": "side"})
NO_POLICY = MappingProxyType({"special_value": None, "onehot": False})


@dataclass(frozen=True)
class Template:
    """How a feature is computed: ``build(trades, params)`` gives the rows with a column named after the feature.

    ``defaults`` are parameters that an instance need not give. Templates of one ``group`` compute each other's columns
    as well, given the same parameters.
    """

    name: str
    build: Callable[[DataFrame, dict], DataFrame]
    required: frozenset[str] = frozenset()
    causal: bool = True
    target: bool = False
    defaults: MappingProxyType = MappingProxyType({})
    group: str = ""

    def __post_init__(self):
        if not self.name:
            raise ValueError("a template needs a name")
        if not callable(self.build):
            raise ValueError(f"{self.name}: a template needs a function")
        if self.target and self.causal:
            raise ValueError(f"{self.name}: a target can't be causal")


@dataclass(frozen=True)
class Declaration:
    """A feature by name, with its horizons, parents and defaults."""

    name: str
    template: Template
    own_lookback_ms: int = 0
    own_lookforward_ms: int = 0
    parents: tuple[str, ...] = ()
    params: dict[str, Any] = field(default_factory=dict)
    ml_policy: dict[str, Any] = field(default_factory=lambda: dict(NO_POLICY))
    enabled: bool = True


@dataclass(frozen=True)
class Instance:
    """A declaration bound to parameters and parent instances; invalid ones can't be made."""

    name: str
    template: Template
    own_lookback_ms: int
    own_lookforward_ms: int
    params: MappingProxyType
    parents: tuple[Instance, ...] = ()
    parent_names: tuple[str, ...] = ()
    ml_policy: MappingProxyType = NO_POLICY

    def __post_init__(self):
        if not self.name.strip():
            raise ValueError("a feature needs a name")
        object.__setattr__(self, "params", MappingProxyType({**self.template.defaults, **self.params}))
        missing = self.template.required - set(self.params)
        if missing:
            raise ValueError(f"{self.name}: parameters missing: {sorted(missing)}")
        for key in _HORIZONS:
            value = getattr(self, key)
            if isinstance(value, bool) or not isinstance(value, int):
                raise TypeError(f"{self.name}: {key} must be an integer")
            if value < 0:
                raise ValueError(f"{self.name}: {key} must not be negative")
            if self.params.get(key, value) != value:
                raise ValueError(f"{self.name}: {key} differs from its parameter")
        names = [p.name for p in self.parents]
        if self.name in names:
            raise ValueError(f"{self.name} depends on itself")
        if len(set(names)) != len(names):
            raise ValueError(f"{self.name}: a parent is given twice")
        # What a parent sees, its child sees as well.
        if self.template.causal and self.summary_lookforward_ms:
            raise ValueError(f"{self.name}: a causal feature can't look forward, nor can its parents")
        if self.template.target and self.summary_lookback_ms:
            raise ValueError(f"{self.name}: a target can't look back, nor can its parents")
        if set(self.ml_policy) != set(NO_POLICY):
            raise ValueError(f"{self.name}: a policy has special_value and onehot, and nothing else")
        if not isinstance(self.ml_policy["onehot"], bool):
            raise TypeError(f"{self.name}: onehot is a truth value")

    @cached_property
    def summary_lookback_ms(self) -> int:
        """What a scan must reach back for this feature and all it is made of."""
        return self.own_lookback_ms + max((p.summary_lookback_ms for p in self.parents), default=0)

    @cached_property
    def summary_lookforward_ms(self) -> int:
        return self.own_lookforward_ms + max((p.summary_lookforward_ms for p in self.parents), default=0)

    def with_params(self, **params) -> Instance:
        return replace(self, params=MappingProxyType({**self.params, **params}))

    def with_parents(self, parents: Iterable[Instance]) -> Instance:
        parents = tuple(parents)
        missing = set(self.parent_names) - {p.name for p in parents}
        if missing:
            raise ValueError(f"{self.name}: parents missing: {sorted(missing)}")
        return replace(self, parents=parents)

    def rows(self, trades: DataFrame) -> DataFrame:
        return self.template.build(named(trades, self.params), dict(self.params))


def named(trades: DataFrame, params: dict) -> DataFrame:
    """The tape with the engine's own column names, from those that the parameters name. A timestamp becomes ms."""
    given = {own: params[key] for key, own in COLUMNS.items() if params.get(key, own) != own}
    out = trades
    for own, theirs in given.items():
        at = F.col(f"`{theirs}`")
        out = out.withColumn(own, F.unix_millis(at.cast("timestamp")) if own == "ms" and trades.schema[theirs].dataType.typeName().startswith("timestamp") else at)
    return out


def frames_of(rows: DataFrame) -> list[tuple[str, str, str]]:
    """Kind, lower and upper bound of every window frame of a plan."""
    plan = rows._jdf.queryExecution().analyzed().toString()
    return re.findall(r"specifiedwindowframe\((\w+)Frame, ([^,]+), ([^)]+\)?)\)", plan)


def looks_ahead(rows: DataFrame) -> list[tuple[str, str, str]]:
    """Frames along the time axis that hold the row's own instant or later ones."""
    return [f for f in frames_of(rows) if f[0] == "Range" and not re.match(r"-\d|unboundedpreceding", f[2])]


def leaks(feature: Instance, trades: DataFrame, cut_ms: int) -> DataFrame:
    """Rows up to ``cut_ms`` whose value changes if the trades from ``cut_ms`` on are others: none for a causal feature."""
    later = F.col("ms") >= cut_ms
    changed = trades.withColumns({
        "price": F.when(later, F.col("price") * 3 + 7).otherwise(F.col("price")), "quantity": F.when(later, F.col("quantity") + 5).otherwise(F.col("quantity")),
        "side": F.when(later, F.when(F.upper("side") == "BUY", "sell").otherwise("buy")).otherwise(F.col("side")),
    })
    before, after = (feature.rows(t).where(F.col("ms") <= cut_ms).select("symbol", "ms", "trade_id", F.col(feature.name).alias(n)) for t, n in ((trades, "before"), (changed, "after")))
    return before.join(after, ["symbol", "ms", "trade_id"]).where(~F.col("before").eqNullSafe(F.col("after")))


def guarded(feature: Instance, trades: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """The feature for trades in [start, end), from a scan padded by its horizons: batches can't change values."""
    if start_ms is None or end_ms is None or start_ms >= end_ms:
        raise ValueError("a guard needs a start before its end")
    back, ahead = feature.summary_lookback_ms, feature.summary_lookforward_ms
    near = trades.where(f"ms >= {start_ms - back} and ms < {end_ms + ahead}")
    return feature.rows(near).where(f"ms >= {start_ms} and ms < {end_ms}")


def canonical(value: Any) -> str:
    """JSON with sorted keys and no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def iso(ts: datetime) -> str:
    ts = ts.replace(tzinfo=UTC) if ts.tzinfo is None else ts.astimezone(UTC)
    return ts.strftime("%Y-%m-%dT%H:%M:%S.") + f"{ts.microsecond // 1000:03d}Z"


@dataclass(frozen=True)
class Parent:
    """A parent of an agreed feature, of one version or of any."""

    name: str
    version: int | None = None

    def as_dict(self) -> dict[str, Any]:
        return {"feature_name": self.name} | ({} if self.version is None else {"feature_version": self.version})


@dataclass(frozen=True)
class Backfill:
    """How a feature's past is computed: from which table, by which template, and what fills its gaps."""

    source_table: str
    template: str
    fill_policy: str = "null"
    fill_value: Any = None
    chunk_span: str | None = None
    settings: dict[str, Any] = field(default_factory=dict)
    backend: str = "spark_batch"

    def __post_init__(self):
        if not self.source_table:
            raise ValueError("a backfill needs a source table")
        if not self.template.strip():
            raise ValueError("a backfill needs a template")
        if self.backend != "spark_batch":
            raise ValueError(f"unknown backend: {self.backend!r}")
        if self.fill_policy not in POLICIES:
            raise ValueError(f"unknown fill policy: {self.fill_policy!r}")

    def as_dict(self) -> dict[str, Any]:
        out = {"compute_backend": self.backend, "source_table": self.source_table, "template": self.template, "fill_policy": self.fill_policy, "resource_settings": self.settings}
        return out | {k: v for k, v in (("fill_value", self.fill_value), ("chunk_span", self.chunk_span)) if v is not None}

    def as_json(self) -> str:
        return canonical(self.as_dict())


@dataclass(frozen=True)
class Snapshot:
    """What was agreed about a feature: version, defined range, kind, horizons, parents, and how its past is filled."""

    name: str
    version: int
    start: datetime
    end: datetime
    kind: str
    target: bool = False
    causal: bool = True
    own_lookback_ms: int = 0
    own_lookforward_ms: int = 0
    parents: tuple[Parent, ...] = ()
    backfill: Backfill | None = None
    extra: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        if not self.name:
            raise ValueError("a snapshot needs a name")
        if self.version < 1:
            raise ValueError("versions count from 1")
        if iso(self.start) > iso(self.end):
            raise ValueError("a snapshot's range ends before it starts")
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind: {self.kind!r}")
        if self.target != (self.kind == "target"):
            raise ValueError("targets, and only targets, are of the kind target")
        for key in _HORIZONS:
            if not isinstance(getattr(self, key), int):
                raise TypeError(f"{key} must be an integer")
            if getattr(self, key) < 0:
                raise ValueError(f"{key} must not be negative")
        if self.own_lookforward_ms and not self.target:
            raise ValueError("only a target looks forward")
        if self.own_lookback_ms and self.target:
            raise ValueError("a target doesn't look back")

    @classmethod
    def of(cls, feature: Instance, version: int, start: datetime, end: datetime, kind: str = "time_based", **more) -> Snapshot:
        """The snapshot of a bound feature."""
        own = feature.template
        return cls(feature.name, version, start, end, "target" if own.target else kind, own.target, own.causal, feature.own_lookback_ms, feature.own_lookforward_ms, tuple(Parent(p.name) for p in feature.parents), **more)

    def as_dict(self) -> dict[str, Any]:
        out = {
            "feature_name": self.name, "feature_version": self.version, "defined_start_ts": iso(self.start), "defined_end_ts": iso(self.end),
            "feature_type": self.kind, "is_target": self.target, "is_causal": self.causal, "own_lookback_ms": self.own_lookback_ms,
            "own_lookforward_ms": self.own_lookforward_ms, "parent_contracts": [p.as_dict() for p in self.parents],
        }
        return out | ({"backfill": self.backfill.as_dict()} if self.backfill else {}) | ({"extra": self.extra} if self.extra else {})

    def as_json(self) -> str:
        return canonical(self.as_dict())

    @property
    def hash(self) -> str:
        return hashlib.sha256(self.as_json().encode()).hexdigest()
