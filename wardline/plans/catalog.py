"""Named queries and the DuckDB SQL that each must equal, gathered from the plan modules."""

from __future__ import annotations

from wardline.plans import building, cleaning, evaluation, features, files, inventory, scores, text
from wardline.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "building", "cleaning", "evaluation", "features", "files", "inventory", "scores", "text"]
