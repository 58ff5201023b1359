"""Connected components of a link table, and of links within a block."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..operators.linkage import components


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links`` (columns a, b); component: its least node.

    Nulls and links of a node with itself are left out.
    """
    return components(links).withColumnRenamed("id", "node")


def forest_edges(linked: np.ndarray) -> list[tuple[int, int]]:
    """Enough links of a symmetric matrix to connect what it links: a tree for each component."""
    waiting, out = linked.any(axis=1), []
    for start in np.flatnonzero(waiting):
        if waiting[start]:
            waiting[start] = False
            queue = [int(start)]
            while queue:
                near = np.flatnonzero(linked[queue[-1]] & waiting)
                at = queue.pop()
                waiting[near] = False
                out += [(at, int(k)) for k in near]
                queue += near.tolist()
    return out
