"""Stands' compositions: nested lists, shares and fractions of tree categories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import priors as P
from ..functions import scoring as S


def attached(stands: DataFrame, elements: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """stands with the composition of each; one without elements has an empty list, not null."""
    n = nested(elements, key, columns)
    empty = F.array().cast(n.schema["composition"].dataType)
    return stands.drop("composition").join(n, key, "left").withColumn("composition", F.coalesce("composition", empty))


def nested(elements: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per key with its elements as a sorted array of structs."""
    return elements.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("composition"))


def shares(elements: DataFrame, key: str = "id", code: str = "puuliik_kood", share: str = "osakaal") -> DataFrame:
    """Sum of the shares of each tree category, 0 where it has none; NaN and null shares are skipped."""
    v = S.known(F.col(share).cast("double"))
    sums = [F.coalesce(F.sum(F.when(F.col(code) == c, v)), F.lit(0.0)).alias(f"{t}_share") for t, c in P.TREES.items()]
    return elements.groupBy(key).agg(*sums, F.coalesce(F.sum(v), F.lit(0.0)).alias("total_share"))


def fractions(stands: DataFrame, elements: DataFrame, key: str = "id") -> DataFrame:
    """Fractions of all categories per stand: of a total of 0 all are 0.0, of a stand without elements null."""
    s = shares(elements, key)
    t = F.col("total_share")
    part = lambda c: F.when(t > 0, c / t).otherwise(F.when(t.isNotNull(), 0.0))
    trees = [F.col(f"{n}_share") for n in P.TREES]
    other = t - reduce(lambda a, b: a + b, trees)
    return stands.join(s, key, "left").withColumns({**{n: part(c) for n, c in zip(P.TREES, trees)}, "other": part(other)})


def frac(alias: str | None = None) -> list[Column]:
    return [F.col(f"{alias}.{c}" if alias else c) for c in P.CATEGORIES]


def stand_scores(stands: DataFrame) -> DataFrame:
    """Habitat score of every species from fractions and site code; null if either is unknown, or if all fractions are 0."""
    some = reduce(lambda a, b: a + b, frac()) > 0
    by = {c: F.when(some, F.col(c)) for c in P.CATEGORIES}
    return stands.withColumns({f"habitat_{s}": S.host_score(s, by) * S.site_modifier(S.site_score(s, F.col("site"))) for s in P.SPECIES})


def sides(edges: DataFrame, stands: DataFrame) -> DataFrame:
    """edges with the columns of either stand as the structs _a and _b, null for a stand that is missing: one join per side serves all that follows."""
    of = F.struct(*[c for c in stands.columns if c != "id"])
    side = lambda k: stands.select(F.col("id").alias(f"id_{k}"), of.alias(f"_{k}"))
    return edges.join(side("a"), "id_a", "left").join(side("b"), "id_b", "left")


def ecotones(edges: DataFrame, stands: DataFrame) -> DataFrame:
    """Contrasts, exploration bonus and scores of stand pairs; a stand that is missing leaves what needs it null.

    stands: id, site, age, drained, the categories' fractions, habitat_*. Both lookups are equi-joins on the stand id.
    """
    cols = ["id", "site", "age", "drained", *P.CATEGORIES, *(f"habitat_{s}" for s in P.SPECIES)]
    return contrasted(sides(edges, stands.select(*cols))).drop("_a", "_b")


def contrasted(e: DataFrame) -> DataFrame:
    """:func:`ecotones` of edges that have their sides."""
    of = lambda k, c: F.col(f"_{k}.{c}")
    fa, fb = ([of(k, c) for c in P.CATEGORIES] for k in "ab")
    e = e.withColumns(
        {
            "composition_contrast": S.composition_contrast(fa, fb),
            "site_type_changed": S.site_changed(of("a", "site"), of("b", "site")),
            "group_changed": S.group_changed(of("a", "site"), of("b", "site")),
            "moisture_contrast": S.moisture_contrast(of("a", "site"), of("b", "site")),
            "age_contrast": S.age_contrast(of("a", "age"), of("b", "age")),
            "drainage_changed": of("a", "drained") != of("b", "drained"),
        }
    )
    bonus, signal, coverage = S.exploration(
        {
            "composition": F.col("composition_contrast"),
            "site": S.site_dimension(F.col("moisture_contrast"), F.col("group_changed")),
            "age": F.col("age_contrast"),
            "drainage": F.col("drainage_changed").cast("double"),
            "length": F.least(F.lit(1.0), F.col("length") / P.FULL_LENGTH_M),
        }
    )
    e = e.withColumns({"bonus": bonus, "signal": signal, "coverage": coverage})
    return e.withColumns({f"ecotone_{s}": S.ecotone_score(of("a", f"habitat_{s}"), of("b", f"habitat_{s}"), F.col("bonus")) for s in P.SPECIES})
