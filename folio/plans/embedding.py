"""Queries of the topology embedding."""

from __future__ import annotations

from folio.operators import embedding as o
from folio.operators import graph
from folio.plans.registry import query

query("emb04_embed", once=True)(lambda led: o.embed(graph.matrix(led)))
query("emb05_embedding_stats", once=True)(lambda led: o.embedding_stats(o.embed(graph.matrix(led))))


def members(led):  # noqa: ANN001, ANN201
    return o.cluster_members(o.clusters(o.embed(graph.matrix(led)), eps=2.0))


query("emb06_clusters", once=True)(lambda led: o.clusters(o.embed(graph.matrix(led)), eps=2.0).drop("z"))
query("emb07_members", once=True)(members)
query("emb07b_cluster_info", once=True)(lambda led: o.cluster_info(members(led)))
query("emb08_cluster_jumps", once=True)(lambda led: o.cluster_jumps(members(led)))
