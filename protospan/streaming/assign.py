"""Assignment of a stream of points to fixed prototypes: stateless, so any trigger and any late row gives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame

from protospan.operators.energies import Energy, assign, cluster_assign
from protospan.operators.pairs import Prototypes


def assign_stream(stream: DataFrame, chosen: Prototypes, energy: str | Energy = "cluster") -> DataFrame:
    """``stream`` (a streaming point table) with near_slot and dist, or dist alone for other energies."""
    return cluster_assign(stream, chosen) if energy == "cluster" else assign(stream, chosen, energy)
