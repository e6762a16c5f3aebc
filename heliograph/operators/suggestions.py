"""Kept suggestions: a stored table a generation, brought up to date after decisions instead of made anew."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.operators import clusters, people, recognition, vectors
from heliograph.plans.params import DEFAULT, Params
from heliograph.scratch import ship, written

TABLES = {
    "core": "identity_id long, id long, embedding array<float>",
    "matches": "identity_id long, g long, size long, matched long, max_sim double",
    "claims": "identity_id long, name string, g long, photos long, sim double, claimants long",
    "names": "id long, name string",  # written last: a generation without it was never finished
}


@dataclass(frozen=True)
class Kept:
    """What a generation's suggestions were made of, as tables in the shared folder."""

    root: str
    generation: int
    core: DataFrame
    matches: DataFrame
    claims: DataFrame
    names: DataFrame


def load(spark: SparkSession, root: str, generation: int) -> Kept | None:
    """A generation's tables; None if there are none, or the job that wrote them was broken off."""
    at = lambda name: f"{root}/generation={generation}/{name}"
    try:
        spark.read.parquet(at("names"))
    except AnalysisException:
        return None
    return Kept(root, generation, **{name: spark.read.schema(fields).parquet(at(name)) for name, fields in TABLES.items()})


def _keep(df: DataFrame, root: str, generation: int, name: str) -> DataFrame:
    path = f"{root}/generation={generation}/{name}"
    typed = df.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in TABLES[name].split(", ")])
    typed.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(TABLES[name]).parquet(path)


def _core(faces: DataFrame, params: Params, trim: bool) -> DataFrame:
    anchors = vectors.anchors(faces, params.anchor_size)
    return (clusters.anchor_core(anchors, params) if trim else anchors).select("identity_id", "id", "embedding")


def full(faces: DataFrame, identities: DataFrame, root: str, generation: int, params: Params = DEFAULT, trim: bool = True) -> Kept:
    """A generation from nothing, as after a clustering."""
    ship(faces.sparkSession)
    keep = lambda df, name: _keep(df, root, generation, name)
    core = keep(_core(faces, params, trim), "core")
    matches = keep(vectors.anchor_matches(people.pool(faces), core, params), "matches")
    claims = keep(recognition.claims_of(matches, faces, identities, params), "claims")
    return Kept(root, generation, core, matches, claims, keep(identities, "names"))


def touched(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g) of groups that lost or got a face, and (identity_id) of people whose faces or marks changed.

    Vectors aren't read: a face that stays keeps its own.
    """

    def state(faces: DataFrame, name: str) -> DataFrame:
        g = F.when(F.col("cluster_id").isNotNull() & (F.col("ignored") == 0), people.group_key())
        return faces.select("id", F.struct(g.alias("g"), "identity_id", "confirmed", "ignored", "photo_id", "score").alias(name))

    changed = state(before, "was").join(state(after, "now"), "id", "full").filter(~F.col("was").eqNullSafe(F.col("now")))
    either = lambda field: changed.select(F.explode(F.array(f"was.{field}", f"now.{field}")).alias(field)).filter(F.col(field).isNotNull()).distinct()
    return either("g"), either("identity_id")


def refresh(kept: Kept, before: DataFrame, after: DataFrame, identities: DataFrame, params: Params = DEFAULT, trim: bool = True) -> Kept:
    """The next generation after decisions, equal to ``full`` over the faces as they are now.

    Vectors are multiplied only between touched groups and everybody, and between people whose
    faces changed and the other groups. Claims are made anew for groups that were touched, or that
    such people, or people with another name, match or matched; all others are taken over.
    """
    root, generation = kept.root, kept.generation + 1
    keep = lambda df, name: _keep(df, root, generation, name)
    groups, changed = (written(t, "touched") for t in touched(before, after))
    own = after.join(changed, "identity_id", "left_semi").select(*after.columns)
    core = keep(kept.core.join(changed, "identity_id", "left_anti").unionByName(_core(own, params, trim)), "core")
    pool = people.pool(after)
    here = vectors.anchor_matches(pool.join(groups, "g", "left_semi"), core, params)
    there = vectors.anchor_matches(pool.join(groups, "g", "left_anti"), core.join(changed, "identity_id", "left_semi"), params)
    stays = kept.matches.join(groups, "g", "left_anti").join(changed, "identity_id", "left_anti")
    matches = keep(stays.unionByName(here).unionByName(there), "matches")
    names = kept.names.select("id", F.col("name").alias("was")).join(identities.select("id", F.col("name").alias("now")), "id", "full")
    moved = changed.union(names.filter(~F.col("was").eqNullSafe(F.col("now"))).select("id")).distinct()
    met = kept.matches.unionByName(matches).join(moved, "identity_id", "left_semi").select("g")
    again = written(groups.union(met).distinct(), "touched")
    fresh = recognition.claims_of(matches.join(again, "g", "left_semi"), after, identities, params, again)
    claims = keep(kept.claims.join(again, "g", "left_anti").unionByName(fresh), "claims")
    return Kept(root, generation, core, matches, claims, keep(identities, "names"))


def serve(kept: Kept, photos: DataFrame, generation: int, running: bool = False) -> DataFrame:
    """The kept claims, if they are of this generation, no pass runs and the sweep has settled; else none."""
    claims = recognition.settled(photos, kept.claims)
    return claims if generation == kept.generation and not running else claims.limit(0)
