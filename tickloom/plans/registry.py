"""The graph of declarations: checks, order, selection, binding; and the standard features and targets."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from types import MappingProxyType

from pyspark.sql import DataFrame

from ..operators import features, targets
from .contract import COLUMNS, Declaration, Instance, Template


def check(declarations: Iterable[Declaration]) -> None:
    """Names are unique, nothing depends on itself, every parent is declared."""
    declarations = list(declarations)
    names = [d.name for d in declarations]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"declared twice: {twice}")
    for d in declarations:
        if d.name in d.parents:
            raise ValueError(f"{d.name} depends on itself")
        missing = sorted(set(d.parents) - set(names))
        if missing:
            raise ValueError(f"{d.name}: parents missing: {missing}")


def ordered(declarations: Iterable[Declaration]) -> list[Declaration]:
    """Parents before children; among those that are free, by name."""
    declarations = list(declarations)
    check(declarations)
    left = {d.name: d for d in declarations}
    waiting, out = {n: set(d.parents) for n, d in left.items()}, []
    free = sorted(n for n, parents in waiting.items() if not parents)
    while free:
        name = free.pop(0)
        out.append(left[name])
        del waiting[name]
        opened = []
        for other, parents in waiting.items():
            if name in parents:
                parents.discard(name)
                if not parents:
                    opened.append(other)
        free += sorted(opened)
    if waiting:
        raise ValueError(f"these depend on each other: {sorted(waiting)}")
    return out


@dataclass(frozen=True)
class Registry:
    declarations: tuple[Declaration, ...] = ()

    def register(self, *declarations: Declaration) -> Registry:
        return replace(self, declarations=self.declarations + declarations)

    def select(self, include: Iterable[str] | None = None, targets: bool | None = None, enabled_only: bool = True) -> list[Declaration]:
        """Declarations by name and kind. Parents are not pulled in: a child without its parent fails when bound."""
        wanted = None if include is None else set(include)
        out = [d for d in self.declarations if (d.enabled or not enabled_only) and (wanted is None or d.name in wanted)]
        return [d for d in out if targets is None or d.template.target == targets]


@dataclass(frozen=True)
class Factory:
    """Binds declarations: their own parameters give way to shared ones, these to ones for a feature by name;
    horizons are always the declaration's (``with_horizons`` declares others)."""

    shared: dict = field(default_factory=dict)
    by_feature: dict = field(default_factory=dict)

    def bind(self, d: Declaration) -> Instance:
        params = {**d.params, **self.shared, **self.by_feature.get(d.name, {})}
        params |= {"own_lookback_ms": d.own_lookback_ms, "own_lookforward_ms": d.own_lookforward_ms}
        return Instance(d.name, d.template, d.own_lookback_ms, d.own_lookforward_ms, MappingProxyType(params), (), d.parents, MappingProxyType(d.ml_policy))


def with_horizons(declarations: Iterable[Declaration], back_ms: int | None = None, ahead_ms: int | None = None) -> list[Declaration]:
    """The declarations with another look-back for those that look back, and another look-forward for targets."""
    out = []
    for d in declarations:
        change = {"own_lookback_ms": back_ms} if back_ms is not None and d.own_lookback_ms else {}
        change |= {"own_lookforward_ms": ahead_ms} if ahead_ms is not None and d.own_lookforward_ms else {}
        out.append(replace(d, **change))
    return out


@dataclass(frozen=True)
class Bundle:
    instances: tuple[Instance, ...]

    def __getitem__(self, name: str) -> Instance:
        return {i.name: i for i in self.instances}[name]

    @property
    def features(self) -> tuple[Instance, ...]:
        return tuple(i for i in self.instances if not i.template.target)

    @property
    def targets(self) -> tuple[Instance, ...]:
        return tuple(i for i in self.instances if i.template.target)


def bundle(declarations: Iterable[Declaration], factory: Factory | None = None) -> Bundle:
    """Instances in order, each bound to its parents."""
    factory, made = factory or Factory(), {}
    for d in ordered(declarations):
        made[d.name] = factory.bind(d).with_parents(made[p] for p in d.parents)
    return Bundle(tuple(made.values()))


def _rolling(name: str) -> Template:
    def build(trades: DataFrame, params: dict) -> DataFrame:
        made = features.rolling(trades, params["own_lookback_ms"], momentum=name.startswith("price_momentum"))
        return made.withColumnRenamed("price_momentum", name)

    group = "rolling" if name in features.ROLLING or name == "volume_balance" else ""
    return Template(name, build, frozenset({"own_lookback_ms"}), defaults=COLUMNS, group=group)


def _target(name: str, **scale: str) -> Template:
    def build(trades: DataFrame, params: dict) -> DataFrame:
        given = {to: params[key] for key, to in scale.items() if key in params}
        return targets.forward(trades, missing=params.get("missing", "null"), **given)

    return Template(name, build, frozenset({"own_lookforward_ms"}), causal=False, target=True, defaults=COLUMNS)


def _binned(trades: DataFrame, params: dict) -> DataFrame:
    return targets.binned_delta(trades, params["own_lookforward_ms"], params.get("deadband", targets.DEADBAND))


def standard() -> Registry:
    """The features and targets of the tape. The balance and its momentum are declared but not in the default set."""
    back, policy = features.LOOKBACK_MS, {"special_value": 0.0, "onehot": True}
    out = [Declaration(n, _rolling(n), back, ml_policy=policy) for n in features.ROLLING]
    out += [
        Declaration("price_momentum", _rolling("price_momentum"), back, ml_policy=policy),
        Declaration("price_momentum_for_balance", _rolling("price_momentum_for_balance"), back, ml_policy=policy),
        Declaration("volume_balance", _rolling("volume_balance"), back, parents=("price_momentum_for_balance",), ml_policy=policy),
        Declaration("price_delta", _target("price_delta", own_lookforward_ms="delta_ms", deadband="deadband"), own_lookforward_ms=targets.DELTA_MS),
        Declaration("price_direction", _target("price_direction", own_lookforward_ms="delta_ms", direction="direction"), own_lookforward_ms=targets.DELTA_MS),
        Declaration("sell_rise", _target("sell_rise", own_lookforward_ms="rise_ms", rise="rise"), own_lookforward_ms=targets.RISE_MS),
        Declaration("price_delta_binned", Template("price_delta_binned", _binned, causal=False, target=True, defaults=COLUMNS), own_lookforward_ms=targets.DELTA_MS, enabled=False),
    ]
    return Registry(tuple(out))


def rolling_bundle(factory: Factory | None = None) -> Bundle:
    return bundle(standard().select(include=features.ROLLING), factory)


def target_feature(name: str, factory: Factory | None = None) -> Instance:
    return bundle(standard().select(include=[name], targets=True, enabled_only=False), factory)[name]
