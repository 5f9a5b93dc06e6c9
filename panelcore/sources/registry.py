"""Entity names, neighbourhood edges and boundary events."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcore.checks import ContractError
from panelcore.functions.scalars import slug


def registry_table(canonical: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``slug, canonical`` from ``canonical`` names and ``alias, canonical`` pairs."""
    table = canonical.select(slug(F.col("canonical")).alias("slug"), "canonical")
    if aliases is not None:
        stray = aliases.join(canonical, "canonical", "left_anti").take(1)
        if stray:
            raise ContractError(f"alias points to unknown name {stray[0]['canonical']!r}")
        table = table.unionByName(aliases.select(slug(F.col("alias")).alias("slug"), "canonical"))
    return table.distinct()


def unknown_entities(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Distinct names the registry does not know."""
    names = df.select("entity").distinct()
    return names.withColumn("slug", slug(F.col("entity"))).join(registry, "slug", "left_anti")


def normalise_entity(df: DataFrame, registry: DataFrame, strict: bool = True) -> DataFrame:
    """Canonical entity names; an unknown name is fatal when ``strict``.

    Distinct names are mapped first, so a slug is computed once per spelling and the
    mapping that rows are joined to is as small as the list of spellings.
    """
    names = df.select("entity").distinct().withColumn("slug", slug(F.col("entity")))
    mapped = names.join(registry, "slug", "left")
    if strict:
        unknown = mapped.where("canonical is null").select("entity").take(3)
        if unknown:
            raise ContractError(f"unrecognised names, e.g. {[r[0] for r in unknown]}")
    mapping = mapped.where("canonical is not null").select("entity", "canonical")
    others = [c for c in df.columns if c != "entity"]
    return df.join(mapping, "entity").select(F.col("canonical").alias("entity"), *others)


def symmetric_edges(pairs: DataFrame) -> DataFrame:
    """Both directions of ``entity, neighbour``; a loop is an error."""
    loop = pairs.where("entity = neighbour").take(1)
    if loop:
        raise ContractError(f"{loop[0][0]!r} is listed as its own neighbour")
    back = pairs.select(F.col("neighbour").alias("entity"), F.col("entity").alias("neighbour"))
    return pairs.select("entity", "neighbour").unionByName(back).distinct()


def neighbours_of(edges: DataFrame, entity: str) -> DataFrame:
    return edges.where(F.col("entity") == entity).select("neighbour")


def boundary_affected(entities: DataFrame, events: DataFrame, start: date, end: date) -> DataFrame:
    """Entities whose definition changes inside the window.

    ``events`` carries ``effective, parent, children ARRAY<STRING>``.
    """
    involved = (
        events.where(F.col("effective").between(F.lit(start), F.lit(end)))
        .select(F.explode(F.array_union(F.array("parent"), "children")).alias("entity"))
        .distinct()
    )
    return entities.select("entity").distinct().join(involved, "entity", "left_semi")
