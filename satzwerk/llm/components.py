"""Connected components of links that may be many."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from satzwerk.llm.shared import forget, saved

#: Rows of a matrix of links that are looked at together.
ROWS = 256


def _state(edges: DataFrame) -> tuple:
    sums = F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(*sums).first())


def roots(edges: DataFrame) -> DataFrame:
    """From links (u, v) to (u, root): the smallest node that each larger node reaches.

    Nodes without a row are their own root. Large and small stars take turns
    (Kiveris et al. 2014): each node hangs its larger, then its smaller neighbours
    under the smallest one, until nothing changes. A node's minimum is summed up
    before the shuffle, so a node with very many links is no single task; each
    round is a table in the shared folder. Only a count and a checksum of the
    links come to the driver.
    """
    edges = saved(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(),
        "links",
    )
    before = None
    while (state := _state(edges)) != before:
        before, old = state, edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # Now every node looks at its smaller neighbours alone.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u <> v")
            .distinct()
        )
        edges = saved(small, "links")
        forget(old)
    return edges.select("u", F.col("v").alias("root"))


def spread(linked: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links the smallest row that each row reaches."""
    label = np.arange(len(linked), dtype=np.int32)
    far = np.int32(len(linked))
    while True:
        some = [np.where(linked[at : at + ROWS], label, far).min(axis=1, initial=far) for at in range(0, len(linked), ROWS)]
        least = np.concatenate([label[:0], *some])
        new = np.minimum(label, least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new
