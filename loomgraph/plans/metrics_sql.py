"""DuckDB SQL that several queries share."""

from __future__ import annotations

from loomgraph.operators.metrics import POISSON


def replicates(rows: str, key: str, resamples: int, seed: int = 42) -> str:
    """A CTE `rep`: the rows with replicate and weight, as `metrics.replicates` gives them."""
    weight = " + ".join(f"(u >= {t})::INT" for t in POISSON)
    return f"""blocks AS (SELECT *, unnest(range({-(-resamples // 4)})) AS block FROM {rows}), hashed AS (SELECT *, md5('{seed}|' || {key} || '|' || block) AS h, unnest(range(4)) AS part FROM blocks),
    drawn AS (SELECT *, block * 4 + part AS replicate, ('0x' || substr(h, part * 8 + 1, 8))::BIGINT AS u FROM hashed), rep AS (SELECT *, {weight} AS weight FROM drawn WHERE replicate < {resamples} AND u >= {POISSON[0]})"""
