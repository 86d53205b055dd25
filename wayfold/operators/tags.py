"""From the tags of ways, nodes and relations to columns, by a profile of road classes, access keys and modifiers.

Tags are arrays in the order of the file, and are folded in that order, since the meaning of some depends on those before.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geo

# What denies and what allows access.
DENIED = ["private", "no", "agricultural", "forestry", "delivery"]
ALLOWED = ["yes", "designated", "official", "permissive"]
# Place types.
PLACES = {"city": "City", "town": "Town", "hamlet": "Hamlet", "suburb": "Suburb", "village": "Village"}
#: Directions of a way.
UNSURE, BOTH, ALONG, AGAINST = 0, 1, 2, 3


@dataclass
class Profile:
    """classes: values of `highway` that are useful, by number. access: keys from the most special to the most general.
    languages: keys of names, the preferred first. Modifiers: (key, value or None, kind, amount), kind being fixed, percent,
    access or oneway for ways, fixed or access for nodes; they apply in the order of the tags, then of this list."""

    classes: list[str]
    access: list[str] = field(default_factory=lambda: ["motorcar", "motor_vehicle", "vehicle", "access"])
    languages: list[str] = field(default_factory=lambda: ["name"])
    way_modifiers: list[tuple[str, str | None, str, int]] = field(default_factory=list)
    node_modifiers: list[tuple[str, str | None, str, int]] = field(default_factory=list)

    def keys(self) -> list[str]:
        """The keys that decoding reads, for a projection at the scan."""
        own = ["oneway", "junction", "highway", "ref", "place_name", "place", "maxspeed", "population", "barrier", "type", "except", "restriction"]
        return list(dict.fromkeys([*own, *self.languages, *self.access, *(m[0] for m in self.way_modifiers + self.node_modifiers)]))


def access_chain(tree: list[tuple[str, str]], kind: str) -> list[str]:
    """The access keys from a kind of traffic up to the root of a tree of (child, parent); the root is its own parent."""
    above, chain = dict(tree), [kind]
    if kind not in above:
        raise ValueError(f"no access type {kind}")
    while above[chain[-1]] != chain[-1]:
        chain.append(above[chain[-1]])
        if chain[-1] not in above or len(chain) > len(above):
            raise ValueError("the access tree has no root")
    return chain


def _position(value: Column, listed: list[str]) -> Column:
    """Place of a value in a list from 0; null if it isn't there."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in listed]).cast("array<string>"), value), F.lit(0)) - 1


def _first_of_best(tags: Column, keys: list[str]) -> Column:
    """Value of the tag whose key comes first in keys; of several with that key the first one."""
    ranked = F.transform(tags, lambda t, i: F.struct(_position(t["k"], keys).alias("rank"), i.alias("at"), t["v"].alias("v")))
    return F.array_min(F.filter(ranked, lambda r: r["rank"].isNotNull()))["v"]


def _last(tags: Column, key: str) -> Column:
    return F.try_element_at(F.filter(tags, lambda t: t["k"] == key), F.lit(-1))["v"]


def _access(tags: Column, profile: Profile, barriers: bool) -> tuple[Column, Column]:
    """Access by the most special key that says anything; of equal keys the first. With barriers, one denies access as long as
    no such key came before it, and a toll booth restores it."""
    start = F.struct(F.lit(True).alias("access"), F.lit(len(profile.access)).cast("bigint").alias("rank"))

    def step(a: Column, t: Column) -> Column:
        rank = _position(t["k"], profile.access)
        says = F.when(t["v"].isin(DENIED), False).when(t["v"].isin(ALLOWED), True)
        better = rank.isNotNull() & (rank < a["rank"]) & says.isNotNull()
        access = F.when(better, says).otherwise(a["access"])
        if barriers:
            access = F.when((t["k"] == "barrier") & (t["v"] == "toll_booth"), True).when((t["k"] == "barrier") & (a["rank"] == len(profile.access)), False).otherwise(access)
        return F.struct(access.alias("access"), F.when(better, rank).otherwise(a["rank"]).alias("rank"))

    return F.aggregate(tags, start, step)["access"], F.lit(None)


def _modified(tags: Column, modifiers: list[tuple[str, str | None, str, int]], start: Column) -> Column:
    """A struct of fixed, percent, access, direction after all modifiers of all tags. A positive percentage never counts."""

    def step(a: Column, t: Column) -> Column:
        fixed, percent, access, direction = (a[c] for c in ("fixed", "percent", "access", "direction"))
        for key, value, kind, amount in modifiers:
            hit = (t["k"] == key) if value is None else (t["k"] == key) & (t["v"] == value)
            if kind == "fixed":
                fixed = F.when(hit, fixed + amount).otherwise(fixed)
            elif kind == "percent":
                percent = F.when(hit, F.least(percent, F.lit(amount))).otherwise(percent)
            elif kind == "access":
                access = F.when(hit, F.lit(bool(amount))).otherwise(access)
            else:
                direction = F.when(hit, F.lit(ALONG if amount else BOTH)).otherwise(direction)
        return F.struct(fixed.alias("fixed"), percent.alias("percent"), access.alias("access"), direction.alias("direction"))

    return F.aggregate(tags, start, step) if modifiers else start


def decode_ways(ways: DataFrame, profile: Profile) -> DataFrame:
    """ways (id, nodes, tags) as id, nodes (in driving direction), class (null: not useful), oneway, roundabout, max_speed,
    name, ref (the name where there is none), access, fixed, percent, place, place_name.

    A roundabout, and a motorway or its link, is a oneway if no tag before it says otherwise; a later `oneway` overrules.
    Null tags and nodes are empty ones.
    """
    tags = F.coalesce("tags", F.array().cast("array<struct<k: string, v: string>>"))
    start = F.struct(F.lit(UNSURE).alias("direction"), F.lit(False).alias("roundabout"))

    def step(a: Column, t: Column) -> Column:
        is_, v, unsure = (lambda k: t["k"] == k), t["v"], a["direction"] == UNSURE
        ring = is_("junction") & (v == "roundabout") & unsure
        direction = (
            F.when(is_("oneway") & v.isin("no", "false", "0"), BOTH)
            .when(is_("oneway") & v.isin("yes", "true", "1"), ALONG)
            .when(is_("oneway") & (v == "-1"), AGAINST)
            .when(ring | (is_("highway") & v.isin("motorway", "motorway_link") & unsure), ALONG)
            .otherwise(a["direction"])
        )
        return F.struct(direction.alias("direction"), (a["roundabout"] | ring).alias("roundabout"))

    useful = F.filter(tags, lambda t: (t["k"] == "highway") & t["v"].isin(profile.classes))
    speeds = F.filter(F.transform(F.filter(tags, lambda t: t["k"] == "maxspeed"), lambda t: geo.max_speed_kmh(t["v"])), lambda s: s.isNotNull())
    access, _ = _access(tags, profile, False)
    rows = ways.select("id", F.coalesce("nodes", F.array().cast("array<long>")).alias("nodes"), tags.alias("tags"))
    rows = rows.withColumns({"fold": F.aggregate(F.col("tags"), start, step), "first_access": access})
    begun = F.struct(F.lit(0).alias("fixed"), F.lit(0).alias("percent"), F.col("first_access").alias("access"), F.col("fold.direction").alias("direction"))
    rows = rows.withColumn("end", _modified(F.col("tags"), profile.way_modifiers, begun))
    squeezed = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    name = F.coalesce(squeezed(_first_of_best(F.col("tags"), profile.languages)), F.lit(""))
    ref = F.coalesce(F.nullif(squeezed(_last(F.col("tags"), "ref")), F.lit("")), name)
    return rows.select(
        "id", F.when(F.col("end.direction") == AGAINST, F.reverse("nodes")).otherwise(F.col("nodes")).alias("nodes"),
        _position(F.try_element_at(useful, F.lit(-1))["v"], profile.classes).cast("int").alias("class"),
        F.col("end.direction").isin(ALONG, AGAINST).alias("oneway"), F.col("fold.roundabout").alias("roundabout"),
        F.try_element_at(speeds, F.lit(-1)).alias("max_speed"), name.alias("name"), ref.alias("ref"), F.col("end.access").alias("access"),
        F.col("end.fixed").alias("fixed"), F.col("end.percent").alias("percent"),
        place_type(_last(F.col("tags"), "place")).alias("place"), _last(F.col("tags"), "place_name").alias("place_name"),
    )


def useful_ways(decoded: DataFrame) -> DataFrame:
    """Ways that carry traffic: of a known class, accessible, of two nodes at least."""
    return decoded.where("class is not null and access and size(nodes) > 1")


def outlines(decoded: DataFrame) -> DataFrame:
    """Closed ways that outline a place: id, place_name, nodes."""
    named = decoded.where("place is not null and coalesce(place_name, '') <> ''")
    return named.where("size(nodes) > 3 and nodes[0] = element_at(nodes, -1)").select("id", "place_name", "nodes")


def place_type(value: Column) -> Column:
    """The type of a place's tag; null for all others."""
    pairs = [F.lit(x) for p in PLACES.items() for x in p]
    return F.try_element_at(F.create_map(*pairs), value)


def decode_nodes(nodes: DataFrame, profile: Profile) -> DataFrame:
    """nodes (id, tags and others) with access, penalty, place, population, name instead of tags. A barrier denies access as
    long as no access key was seen before; a toll booth restores it. Populations that are no whole number don't count."""
    tags = F.coalesce("tags", F.array().cast("array<struct<k: string, v: string>>"))
    rows = nodes.withColumn("tags", tags)
    access, _ = _access(F.col("tags"), profile, True)
    begun = F.struct(F.lit(0).alias("fixed"), F.lit(0).alias("percent"), F.col("first_access").alias("access"), F.lit(UNSURE).alias("direction"))
    rows = rows.withColumn("first_access", access).withColumn("end", _modified(F.col("tags"), profile.node_modifiers, begun))
    numbers = F.filter(F.transform(F.filter(F.col("tags"), lambda t: t["k"] == "population"), lambda t: t["v"].try_cast("int")), lambda n: n.isNotNull())
    others = [c for c in nodes.columns if c != "tags"]
    return rows.select(
        *others, F.col("end.access").alias("access"), F.col("end.fixed").alias("penalty"), place_type(_last(F.col("tags"), "place")).alias("place"),
        F.try_element_at(numbers, F.lit(-1)).alias("population"), F.coalesce(_first_of_best(F.col("tags"), profile.languages), F.lit("")).alias("name"),
    )


def decode_restrictions(relations: DataFrame, profile: Profile) -> DataFrame:
    """relations (id, members, tags) as id, kind (no, only), from_way, via, to_way, of restrictions that hold for the
    profile's traffic and have all three members; of several members of a role the last counts."""
    tags = F.coalesce("tags", F.array().cast("array<struct<k: string, v: string>>"))
    member = lambda kind, role: F.try_element_at(F.filter("members", lambda m: (m["type"] == kind) & (m["role"] == role)), F.lit(-1))["ref"]
    kinds = F.transform(F.filter(tags, lambda t: t["k"] == "restriction"), lambda t: F.when(t["v"].startswith("no"), "no").when(t["v"].startswith("only"), "only"))
    kind = F.try_element_at(F.filter(kinds, lambda k: k.isNotNull()), F.lit(-1))
    spared = F.exists(tags, lambda t: (t["k"] == "except") & F.arrays_overlap(F.split(t["v"], ";"), F.array(*[F.lit(a) for a in profile.access])))
    is_one = F.exists(tags, lambda t: (t["k"] == "type") & (t["v"] == "restriction"))
    rows = relations.where(is_one & ~spared)
    found = rows.select("id", kind.alias("kind"), member("way", "from").alias("from_way"), member("node", "via").alias("via"), member("way", "to").alias("to_way"))
    return found.na.drop()
