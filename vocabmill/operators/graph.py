"""Walks and joins over edges (HIE01-HIE07).

edges: (source, destination, kind, is_active).  An is-a edge points from the
child to the parent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.fixed_values import IS_A
from ..functions.staging import staged


def _named(edges: DataFrame, concepts: DataFrame, at: str, other: str) -> DataFrame:
    """Edges seen from ``at``: (code, other_code, other_display, kind)."""
    known = concepts.select(F.col("code").alias("other_code"), F.col("display").alias("other_display"))
    return edges.where("is_active = 1").select(F.col(at).alias("code"), F.col(other).alias("other_code"), "kind").join(known, "other_code")


def _list(rows: DataFrame, name: str) -> DataFrame:
    item = F.struct(F.col("other_code").alias("code"), F.col("other_display").alias("display"))
    return rows.groupBy("code").agg(F.sort_array(F.collect_list(item)).alias(name))


def hierarchy_info(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """HIE01: concepts with parents, children and a map of other relationships; null where there are none."""
    is_a = edges.where(F.col("kind") == IS_A)
    other = edges.where(F.col("kind") != IS_A)
    rows = _named(other, concepts, "source", "destination")
    lists = rows.groupBy("code", "kind").agg(F.sort_array(F.collect_list(F.struct(F.col("other_code").alias("code"), F.col("other_display").alias("display")))).alias("to"))
    related = lists.groupBy("code").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "to")))).alias("relationships"))
    parents = _list(_named(is_a, concepts, "source", "destination"), "parents")
    children = _list(_named(is_a, concepts, "destination", "source"), "children")
    return concepts.join(parents, "code", "left").join(children, "code", "left").join(related, "code", "left")


def reach(starts: DataFrame, edges: DataFrame, max_depth: int = 10, up: bool = True) -> DataFrame:
    """HIE02, HIE03: (code, reached, depth, distance) along is-a edges, each node at its least depth.

    A breadth-first walk of all starts at once: a round is one join and keeps
    only nodes that are new for their start, so cycles end.  distance: how many
    nodes the walk of that start had expanded when it met the node; nodes of a
    depth are expanded in the order of their own distance, then of codes.
    """
    near, far = ("source", "destination") if up else ("destination", "source")
    step = edges.where((F.col("kind") == IS_A) & (F.col("is_active") == 1)).select(F.col(near).alias("at"), F.col(far).alias("next")).distinct()
    seen = starts.select("code", F.col("code").alias("reached"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("distance"), F.lit(1).cast("long").alias("turn"))
    frontier = seen
    in_turn = Window.partitionBy("code").orderBy("distance", "reached")
    for depth in range(1, max_depth + 1):
        upto = frontier.groupBy("code").agg(F.max("turn").alias("upto"))
        met = frontier.join(step, F.col("reached") == F.col("at")).groupBy("code", F.col("next").alias("reached")).agg(F.min("turn").alias("distance"))
        new = met.join(seen, ["code", "reached"], "left_anti").join(upto, "code").withColumn("depth", F.lit(depth))
        fresh = staged(new.withColumn("turn", F.col("upto") + F.row_number().over(in_turn)).select(seen.columns))
        if fresh.isEmpty():
            break
        seen, frontier = seen.unionByName(fresh), fresh
    return seen.where("depth > 0").drop("turn")


def related(concepts: DataFrame, edges: DataFrame, kind: str | None = None) -> DataFrame:
    """HIE04: (code, other_code, other_display, kind, direction) both ways."""
    used = edges.where(F.col("kind") == kind) if kind else edges
    out = _named(used, concepts, "source", "destination").withColumn("direction", F.lit("outgoing"))
    back = _named(used, concepts, "destination", "source").withColumn("direction", F.lit("incoming"))
    return out.unionByName(back)


def panel(concepts: DataFrame, links: DataFrame, kind: str | None = None) -> DataFrame:
    """HIE06: links (parent_code, child_code, hierarchy_type) seen from each end."""
    used = links.where(F.col("hierarchy_type") == kind) if kind else links
    known = concepts.select(F.col("code").alias("other_code"), F.col("display").alias("other_display"))
    ends = [used.select(F.col(a).alias("code"), F.col(b).alias("other_code"), "hierarchy_type", F.lit(tag).alias("relation")) for a, b, tag in (("child_code", "parent_code", "parent"), ("parent_code", "child_code", "child"))]
    return ends[0].unionByName(ends[1]).join(known, "other_code")


def lab_details(concepts: DataFrame, concept_parts: DataFrame, parts: DataFrame, links: DataFrame) -> DataFrame:
    """HIE05: labs with parts, parent_groups and child_items."""
    item = F.struct("part_number", "part_name", "part_type")
    named = concept_parts.join(parts.select("part_number", "part_name"), "part_number").groupBy(F.col("loinc_code").alias("code")).agg(F.sort_array(F.collect_list(item)).alias("parts"))
    rows = panel(concepts, links)
    return concepts.join(named, "code", "left").join(_list(rows.where("relation = 'parent'"), "parent_groups"), "code", "left").join(_list(rows.where("relation = 'child'"), "child_items"), "code", "left")


def drug_details(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """HIE07: drugs with the ingredients they have, and the brands that have them."""
    has = edges.where("kind = 'has_ingredient'")
    ingredients = _list(_named(has, concepts, "source", "destination"), "ingredients")
    brands = _list(_named(has, concepts.where("brand_name IS NOT NULL"), "destination", "source"), "brand_alternatives")
    return concepts.join(ingredients, "code", "left").join(brands, "code", "left")
