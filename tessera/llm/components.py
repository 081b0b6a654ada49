"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import stage

_CHUNK = 400_000


def _contract(batches):
    """Edges of a partition, replaced chunk by chunk by one to the smallest node of each component."""
    import pyarrow as pa

    parent: dict = {}

    def find(node):
        path = []
        while (above := parent[node]) != node:
            path.append(node)
            node = above
        for passed in path:
            parent[passed] = node
        return node

    def flush(schema):
        left = [node for node in parent if find(node) != node]
        right = [parent[node] for node in left]
        parent.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(left, schema.field("u").type), pa.array(right, schema.field("v").type)], ["u", "v"])

    schema = None
    for batch in batches:
        schema = batch.schema
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            if (a := find(u)) != (b := find(v)):
                low, high = (a, b) if a < b else (b, a)
                parent[high] = low
        if len(parent) >= _CHUNK:
            yield flush(schema)
    if parent:
        yield flush(schema)


def _with_roots(pointers: DataFrame) -> DataFrame:
    """(node, root) of the nodes that point to their root, and of the roots."""
    root = pointers.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return root.unionAll(root.select(F.col("root").alias("node"), "root").distinct())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of `edges`(u, v): root is the smallest node reachable.

    Edges are first contracted within their partitions, so that each of these
    holds at most one edge for a node. A round then gathers the ends that a
    node points to, at most one from each partition, ties them to the
    smallest of them, and moves every pointer one step on. A root that very
    many nodes point to is joined with its one row, straight from the shuffle
    of either side, so that adaptive execution can split it. Each round's
    edges are written out. Once the edges that are left fit one chunk of a
    contraction, a single one solves them: rounds over so few would write as many
    small files as there are shuffle partitions, several times. An empty table gives
    no rows; edges from a node to itself are ignored.
    """
    kind = edges.schema["u"].dataType.simpleString()
    described = f"u {kind}, v {kind}"
    current = stage(edges.select("u", "v").where("u <> v").mapInArrow(_contract, described), "edges")
    for _ in range(most_rounds):
        # An edge has two nodes, so that these edges are never flushed halfway.
        if 2 * current.count() <= _CHUNK:
            return _with_roots(stage(current.coalesce(1).mapInArrow(_contract, described), "edges"))
        ends = stage(
            current.groupBy("u").agg(F.collect_set("v").alias("vs")).withColumn("m", F.array_min("vs")), "ends")
        own = F.struct(F.col("u"), F.col("m").alias("v"), (F.size("vs") > 1).alias("moved"))
        others = F.transform(
            F.filter("vs", lambda v: v != F.col("m")),
            lambda v: F.struct(v.alias("u"), F.col("m").alias("v"), F.lit(False).alias("moved")))
        tied = ends.select(F.inline(F.concat(F.array(own), others)))
        ahead = ends.select(F.col("u").alias("_at"), F.col("m").alias("_next"))
        jumped = stage(
            tied.join(ahead, F.col("v") == F.col("_at"), "left")
            .select("u", F.coalesce("_next", "v").alias("v"), (F.col("moved") | F.col("_next").isNotNull()).alias("moved")),
            "edges")
        if jumped.where("moved").isEmpty():
            return _with_roots(jumped)
        current = stage(jumped.select("u", "v").mapInArrow(_contract, described), "edges")
    raise RuntimeError(f"components not stable after {most_rounds} rounds")
