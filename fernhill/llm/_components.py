"""Connected components of links by minimum labels and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fernhill.llm._shared import materialise


def _stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of each batch's edges, as edges from their least node to each other one."""
    for batch in batches:
        ends = [batch.column(k).to_numpy() for k in (0, 1)]
        nodes, place = np.unique(np.concatenate(ends), return_inverse=True)
        a, b = place[: len(ends[0])], place[len(ends[0]) :]
        least = np.arange(len(nodes))
        while True:
            new = least.copy()
            np.minimum.at(new, a, least[b])
            np.minimum.at(new, b, least[a])
            np.minimum.at(new, least, new)
            new = new[new]
            if (new == least).all():
                break
            least = new
        moved = np.flatnonzero(least != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[least[moved]], pa.int64()), pa.array(nodes[moved], pa.int64())], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over ``edges`` (a, b), for nodes that have one.

    Tasks first replace the edges of each batch by stars, which makes them fewer and paths short. Each
    round then takes the smallest label of the neighbours and the label of that label, so that chains
    halve; rounds are written to the shared folder and end when no label changes.
    """
    stars = edges.where("a <> b").select("a", "b").mapInArrow(_stars, "a long, b long").distinct()
    both = stars.union(stars.select("b", "a")).toDF("node", "other")
    both = materialise(both, "edges")
    labels = materialise(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "other", "label": "theirs"}), "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        lower = labels.join(near, "node").select("node", F.least("label", "theirs").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        # the label's own label of the round before is still a node of the component, and no larger
        new = lower
        for _ in range(2):
            new = new.join(jump, "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label"), "old")
        new = materialise(new, "labels")
        if new.where("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
