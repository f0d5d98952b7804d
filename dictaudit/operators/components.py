"""Connected components ("islands") of a pair graph, and the island roll-up.

Min-label propagation with pointer jumping, as DataFrame joins and group-bys:

* every node starts with the smallest id among itself and its neighbours;
* each round, a node takes the smallest label of its neighbours (join edges × labels, group by
  node — the group key is the node, so a giant island never lands in one task), then jumps to its
  label's label (a join on the label);
* rounds stop when no label changes (a count per round).

Every round's labels are written as a table into the shared checkpoint directory
(:func:`~dictaudit.session.materialize`), so lineage stays short and a lost executor re-reads one
round instead of recomputing all of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import materialize

MAX_ROUNDS = 64


def _undirected(edges: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    e = edges.select(*keys, F.col(a).alias("src"), F.col(b).alias("dst")).filter(F.col("src") != F.col("dst"))
    return e.unionByName(e.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def connected_components(edges: DataFrame, a: str = "id_a", b: str = "id_b", keys: tuple[str, ...] = (),
                         max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Label every node that has an edge with the smallest node id of its component.

    ``keys`` (e.g. ``("threshold",)``) name independent graphs sharing one run: every join and
    group-by carries them, so several graphs converge in the same rounds.
    Output: ``*keys, node long, component long``.
    """
    k = list(keys)
    e = materialize(_undirected(edges, a, b, k), "cc-edges")
    labels = materialize(e.groupBy(*k, "src").agg(F.least(F.min("dst"), F.first("src")).alias("label"))
                         .select(*k, F.col("src").alias("node"), "label"), "cc-labels")
    for _ in range(max_rounds):
        # neighbour minimum
        nb = (e.join(labels.withColumnRenamed("node", "src").withColumnRenamed("label", "nl"), [*k, "src"])
              .groupBy(*k, "dst").agg(F.min("nl").alias("nl")).withColumnRenamed("dst", "node"))
        step = (labels.join(nb, [*k, "node"], "left")
                .select(*k, "node", F.col("label").alias("old"),
                        F.least("label", F.coalesce("nl", "label")).alias("label")))
        # pointer jump: take the label of the label; the previous label rides along, so the
        # convergence test needs no further join
        jumped = (step.join(step.select(*k, F.col("node").alias("label"), F.col("label").alias("ll")), [*k, "label"],
                            "left")
                  .select(*k, "node", "old", F.least("label", F.coalesce("ll", "label")).alias("label")))
        # the number of changed labels is observed by the job that writes the round
        obs = Observation(f"cc-{uuid.uuid4().hex}")
        jumped = materialize(jumped.observe(obs, F.count_if(F.col("label") != F.col("old")).alias("changed")),
                             "cc-labels")
        changed = obs.get["changed"]
        labels = jumped.select(*k, "node", "label")
        if changed == 0:
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not converge in {max_rounds} rounds")


def island_rollup(components: DataFrame) -> DataFrame:
    """A16 for islands: per component its size and member ids (sorted, comma-joined)."""
    return (components.groupBy("component")
            .agg(F.count(F.lit(1)).alias("size"),
                 F.array_join(F.array_sort(F.collect_list("node")).cast("array<string>"), ",").alias("members"))
            .withColumnRenamed("component", "island_id"))
