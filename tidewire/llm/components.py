"""Connected components by contraction, for the operators of this folder.

Edges and labels stay distributed; a node with very many edges meets only
aggregates with map-side combination and joins that adaptive execution splits.
Every round is stored in the shared folder, so a lost executor costs a round
at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidewire.operators.graph import connected_labels

from .storage import removed, work_folder, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(src, dst) -> (node, label): the smallest node that each can reach.

    Loops, repeated and reversed edges change nothing; no edges give an empty
    result.
    """
    folder, uris = work_folder(edges.sparkSession, "components"), []

    def store(df: DataFrame) -> DataFrame:
        uris.append(f"{folder}/{len(uris)}")
        return written(df, uris[-1])

    labels = connected_labels(edges.select("src", "dst").where("src <> dst"), store=store)
    removed(edges.sparkSession, *uris[:-1])
    return labels
