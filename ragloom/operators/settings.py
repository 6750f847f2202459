"""Settings of tenants: layers of nested maps, later ones winning leaf by leaf."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def merged(base, over):
    """``over`` on ``base``: maps key by key (lists by place), anything else replaces what was there."""
    keyed = lambda x: dict(enumerate(x)) if isinstance(x, list) else x
    a, b = keyed(base), keyed(over)
    if not (isinstance(a, dict) and isinstance(b, dict)):
        return over
    out = {k: merged(a[k], v) if isinstance(v, (dict, list)) and isinstance(a.get(k), (dict, list)) else v for k, v in b.items()}
    both = a | out
    return [both[k] for k in sorted(both)] if isinstance(base, list) and isinstance(over, list) else {str(k): v for k, v in both.items()}


def at_paths(base: dict, values: dict) -> dict:
    """``base`` with values set at dotted paths; maps are made where there are none."""
    for path, value in values.items():
        layer = value
        for key in reversed(path.split(".")):
            layer = {key: layer}
        base = merged(base, layer)
    return base


def _read(text: str | None):
    """A map from JSON; none if it is null, no JSON or no map."""
    try:
        got = json.loads(text) if text else None
    except ValueError:
        return None
    return got if isinstance(got, dict) else None


def resolved(tenants: DataFrame, profiles: DataFrame, defaults: dict, *, tenant_defaults: dict | None = None) -> DataFrame:
    """``tenants`` with ``resolved``: their settings as JSON with sorted keys.

    ``tenants``: profile (or null) and settings (JSON or null); ``profiles``:
    profile, overrides (JSON of dotted paths). Layers in order: ``defaults``,
    ``tenant_defaults``, the profile's overrides, the tenant's own. Unknown
    profiles and unreadable JSON add nothing. A map replaces a plain value and
    the other way round. Profiles are joined; if one is there twice, so are its
    tenants.
    """
    base = merged(defaults, tenant_defaults or {})

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for overrides, own in batches:
            yield pd.Series([json.dumps(merged(at_paths(base, _read(o) or {}), _read(s) or {}), sort_keys=True, ensure_ascii=False) for o, s in zip(overrides, own, strict=True)], dtype=object)

    table = profiles.select(F.col("profile").alias("_profile"), F.col("overrides").alias("_overrides"))
    both = tenants.join(table, tenants["profile"] == F.col("_profile"), "left")
    return both.select(*(tenants[c] for c in tenants.columns), run(F.col("_overrides"), tenants["settings"]).alias("resolved"))


def value(settings: Column, path: str) -> Column:
    """What resolved settings hold at a dotted path, as text; null if there is nothing."""
    return F.get_json_object(settings, "$." + path)
