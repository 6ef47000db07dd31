"""Evidence-ledger retrieval analytics on Spark."""

from __future__ import annotations

import os
from pathlib import Path


def reachable(spark) -> None:
    """Lets Python workers import the package where they share the driver's files and nothing else names its place."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parent.parent)
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([*parts, root])
