"""Graphs: nodes and directed edges as two frames, either of which may be left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.components import components
from millrace.operators.text import drop_duplicates
from millrace.operators.timeseries import numbered
from millrace.plans.scratch import Scratch
from millrace.plans.stats import fuse
from millrace.schema import q, require


class GraphPrep:
    def __init__(self, nodes: DataFrame | None = None, edges: DataFrame | None = None, node_id: str = "id", source: str = "source", target: str = "target") -> None:
        if nodes is None and edges is None:
            raise ValueError("Nodes or edges are needed")
        if nodes is not None:
            require(nodes, node_id)
        if edges is not None:
            require(edges, source, target)
        self.nodes, self.edges = nodes, edges
        self.original = (nodes, edges)
        self.id, self.source, self.target = node_id, source, target
        self.log: list[dict] = []

    def _set(self, action: str, nodes: DataFrame | None = None, edges: DataFrame | None = None, **details) -> DataFrame:
        if nodes is not None:
            self.nodes = nodes
        if edges is not None:
            self.edges = edges
        self.log.append({"action": action} | details)
        return nodes if nodes is not None else edges

    def _ids(self) -> DataFrame:
        return self.nodes.select(q(self.id).alias("__id")).where("__id IS NOT NULL").distinct()

    def dangling(self) -> int:
        """Distinct endpoints that are no nodes, sources and targets apart."""
        sides = self.edges.select(F.explode(F.array(*[F.struct(F.lit(i).alias("side"), q(c).alias("__id")) for i, c in enumerate((self.source, self.target))])).alias("e")).select("e.*")
        return sides.where("__id IS NOT NULL").distinct().join(self._ids(), "__id", "left_anti").count()

    def detect_issues(self) -> dict:
        found: dict = {}
        if self.nodes is not None:
            x = q(self.id)
            n = fuse(self.nodes, {"total_nodes": F.count(F.lit(1)), "distinct": F.countDistinct(x), "missing_ids": F.count_if(x.isNull())})
            n["duplicate_nodes"] = n["total_nodes"] - n.pop("distinct") - (1 if n["missing_ids"] else 0)
            found |= n
        if self.edges is not None:
            s, t = q(self.source), q(self.target)
            pairs = self.edges.groupBy(s.alias("s"), t.alias("t")).agg(F.count(F.lit(1)).alias("n"))
            found |= fuse(pairs, {
                "total_edges": F.coalesce(F.sum("n"), F.lit(0)),
                "duplicate_edges": F.coalesce(F.sum(F.col("n") - 1), F.lit(0)),
                "self_loops": F.coalesce(F.sum(F.when(F.col("s") == F.col("t"), F.col("n"))), F.lit(0)),
                "missing_endpoints": F.coalesce(F.sum(F.when(F.col("s").isNull() | F.col("t").isNull(), F.col("n"))), F.lit(0)),
            })
        if self.nodes is not None and self.edges is not None:
            found["dangling_edges"] = self.dangling()
        return found

    def validate_node_ids(self, order: list[str] | None = None) -> DataFrame:
        """Nodes with an id, the first of each."""
        return self._set("validate_node_ids", nodes=drop_duplicates(self.nodes.where(q(self.id).isNotNull()), [self.id], "first", order))

    def validate_edges(self, remove_self_loops: bool = True, remove_dangling: bool = True) -> DataFrame:
        s, t = q(self.source), q(self.target)
        out = self.edges.where(s.isNotNull() & t.isNotNull())
        if remove_self_loops:
            out = out.where(s != t)
        if remove_dangling and self.nodes is not None:
            ids = self._ids()
            for side in (self.source, self.target):
                out = out.join(ids, q(side) == F.col("__id"), "left_semi")
        return self._set("validate_edges", edges=out)

    def remove_duplicate_edges(self, keep: str | bool = "first", order: list[str] | None = None) -> DataFrame:
        return self._set("remove_duplicate_edges", edges=drop_duplicates(self.edges, [self.source, self.target], keep, order), keep=keep)

    def _degrees(self) -> DataFrame:
        ends = F.explode(F.array(F.struct(q(self.source).alias("__id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(q(self.target).alias("__id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")
        return self.edges.select(ends).select("e.*").where("__id IS NOT NULL").groupBy("__id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))

    def add_node_features(self) -> DataFrame:
        """out_degree, in_degree, total_degree and is_isolated of every node; parallel edges count."""
        names = [c for c in self.nodes.columns if c not in ("out_degree", "in_degree", "total_degree", "is_isolated")]
        joined = self.nodes.select(*[q(c) for c in names]).join(self._degrees(), q(self.id) == F.col("__id"), "left")
        o, i = F.coalesce("out_degree", F.lit(0)), F.coalesce("in_degree", F.lit(0))
        return self._set("add_node_features", nodes=joined.select(*[q(c) for c in names], o.alias("out_degree"), i.alias("in_degree"), (o + i).alias("total_degree"), (o + i == 0).alias("is_isolated")))

    def add_edge_features(self) -> DataFrame:
        """edge_count: how many edges share both ends; 1 where an end is missing."""
        s, t = q(self.source), q(self.target)
        names = [c for c in self.edges.columns if c != "edge_count"]
        counts = self.edges.groupBy(s.alias("__s"), t.alias("__t")).agg(F.count(F.lit(1)).alias("__n"))
        joined = self.edges.join(counts, (s == F.col("__s")) & (t == F.col("__t")), "left")
        return self._set("add_edge_features", edges=joined.select(*[q(c) for c in names], F.coalesce("__n", F.lit(1)).cast("long").alias("edge_count")))

    def identify_components(self) -> DataFrame:
        """component_id of every node: components without direction, numbered from 0 by their smallest id; -1 without id.

        Whole numbers are their own keys; other ids are numbered by a range sort, so no two of them are taken for one.
        Ids of different types are compared as text if one of them is text, else as Spark compares numbers.
        """
        scratch = Scratch(self.nodes.sparkSession, "graph")
        whole = self.edges.where(q(self.source).isNotNull() & q(self.target).isNotNull())
        sides = [self.nodes.select(q(self.id).alias("__id")), whole.select(q(self.source).alias("__id")), whole.select(q(self.target).alias("__id"))]
        kinds = [side.schema["__id"].dataType for side in sides]
        if all(isinstance(kind, T.IntegralType) for kind in kinds):
            links = whole.select(q(self.source).cast("long").alias("a"), q(self.target).cast("long").alias("b"))
            nodes = self.nodes.withColumn("__k", q(self.id).cast("long"))
        else:
            if any(isinstance(kind, T.StringType) for kind in kinds):
                sides = [side.select(F.col("__id").cast("string").alias("__id")) for side in sides]
            ids = sides[0].union(sides[1]).union(sides[2]).where("__id IS NOT NULL").distinct()
            kind = ids.schema["__id"].dataType
            keys = scratch.save(numbered(ids, [F.col("__id")], scratch, "__n"), "keys")
            links = whole.select(q(self.source).cast(kind).alias("a"), q(self.target).cast(kind).alias("b"))
            for end in ("a", "b"):
                links = links.join(keys.toDF(end, f"__{end}"), end)
            links = links.select(F.col("__a").alias("a"), F.col("__b").alias("b"))
            nodes = self.nodes.withColumn("__id", q(self.id).cast(kind)).join(keys.toDF("__id", "__k"), "__id", "left")
        labels = scratch.save(components(links, scratch), "labels")
        placed = nodes.join(labels.withColumnRenamed("node", "__k"), "__k", "left").withColumn("__c", F.coalesce("component", "__k"))
        least = placed.where("__c IS NOT NULL").groupBy("__c").agg(F.min(q(self.id)).alias("__m"))
        ranks = scratch.save(self._ranked(least), "ranks")
        out = placed.join(ranks.select("__c", "component_id"), "__c", "left").select(*[q(c) for c in self.nodes.columns], F.coalesce("component_id", F.lit(-1)).cast("long").alias("component_id"))
        return self._set("identify_components", nodes=out)

    @staticmethod
    def _ranked(least: DataFrame) -> DataFrame:
        """Consecutive numbers in the order of __m, by a range sort and the sizes of its parts."""
        return numbered(least, [F.col("__m")], Scratch(least.sparkSession, "ranks"), "component_id")

    def filter_isolated_nodes(self) -> DataFrame:
        ends = self.edges.select(F.explode(F.array(q(self.source), q(self.target))).alias("__id")).distinct()
        return self._set("filter_isolated_nodes", nodes=self.nodes.join(ends, q(self.id) == F.col("__id"), "left_semi"))

    def edge_list(self) -> DataFrame:
        return self.edges.select(q(self.source), q(self.target))

    def adjacency(self) -> DataFrame:
        """(node, neighbours): the targets of each source; nodes without outgoing edges are absent."""
        return self.edges.where(q(self.source).isNotNull()).groupBy(q(self.source).alias("node")).agg(F.collect_list(q(self.target)).alias("neighbours"))

    def to_adjacency_dict(self) -> dict:
        return {r["node"]: list(r["neighbours"]) for r in self.adjacency().collect()}

    def to_edge_list(self) -> list[tuple]:
        return [tuple(r) for r in self.edge_list().collect()]

    def get_graph_stats(self) -> dict:
        n = fuse(self.nodes, {"n": F.count(F.lit(1))})["n"] if self.nodes is not None else 0
        m = fuse(self.edges, {"n": F.count(F.lit(1))})["n"] if self.edges is not None else 0
        found = {"num_nodes": n, "num_edges": m, "density": 2 * m / (n * (n - 1)) if n > 1 else 0}
        if self.nodes is not None and "total_degree" in self.nodes.columns:
            found["avg_degree"] = fuse(self.nodes, {"d": F.avg("total_degree")})["d"]
        return found

    def report(self) -> dict:
        return {"issues": self.detect_issues(), "graph_stats": self.get_graph_stats(), "logs": self.log}

    def save_report(self, path: str) -> None:
        from millrace.sources.reports import save_report

        save_report(self.report(), path)


