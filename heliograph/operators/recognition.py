"""Decisions about people: folds, growth, contested groups, merges, the review queue, looks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograph.operators import clusters, library, mutations, people, vectors
from heliograph.plans.params import DEFAULT, Params
from heliograph.scratch import written


def matches(faces: DataFrame, params: Params = DEFAULT, trim: bool = True) -> DataFrame:
    """Every confirmed person against every other group, all people in one pass."""
    anchors = vectors.anchors(faces, params.anchor_size)
    core = clusters.anchor_core(anchors, params) if trim else anchors
    return vectors.anchor_matches(people.pool(faces), core, params)


def fold_decisions(faces: DataFrame, params: Params = DEFAULT, trim: bool = True) -> DataFrame:
    """(g, identity_id, sim): clusters that one person matches decisively best.

    The best must clear a bar and the runner-up by a margin, have enough confirmed faces, and
    never be pictured together with the cluster. Ties go to the smaller person id, and fail the margin.
    """
    clean = mutations.clear_tentative(faces)
    order = Window.partitionBy("g").orderBy(F.desc("max_sim"), "identity_id")
    ranked = matches(clean, params, trim).filter("g > 0").withColumn("rank", F.row_number().over(order)).withColumn("second", F.lead("max_sim").over(order))
    best = ranked.filter((F.col("rank") == 1) & (F.col("max_sim") >= params.fold_min))
    clear = best.filter(F.col("second").isNull() | (F.col("max_sim") - F.col("second") >= params.fold_margin))
    able = people.confirmed_counts(clean, params.min_anchor).select("identity_id")
    decided = clear.join(able, "identity_id", "left_semi").join(people.cooccurrence(clean), ["g", "identity_id"], "left_anti")
    return decided.select("g", "identity_id", F.col("max_sim").alias("sim"))


def auto_fold(photos: DataFrame, faces: DataFrame, params: Params = DEFAULT, trim: bool = True) -> DataFrame:
    """Faces with tentative people derived anew; unchanged until the sweep has settled."""
    if not library.is_settled(photos) or not people.confirmed_counts(faces).take(1):
        return faces
    return mutations.assign_clusters(mutations.clear_tentative(faces), fold_decisions(faces, params, trim))


def settled(photos: DataFrame, prompts: DataFrame) -> DataFrame:
    """Prompts, none of them until the sweep has settled: half a library suggests what the rest corrects."""
    ready = library.face_progress(photos).select((F.col("eligible") > 0) & (F.col("scanned") >= F.col("eligible")))
    return prompts.filter(ready.scalar())


def growth_claims(faces: DataFrame, identities: DataFrame, params: Params = DEFAULT, trim: bool = True) -> DataFrame:
    """(identity_id, name, g, photos, sim, claimants): clusters that people with names might own.

    A person needs enough anchors. A cluster pictured with the person, or that another confirmed
    person matches clearly better, is no claim.
    """
    return claims_of(matches(faces, params, trim), faces, identities, params)


def claims_of(every: DataFrame, faces: DataFrame, identities: DataFrame, params: Params = DEFAULT, groups: DataFrame | None = None) -> DataFrame:
    """Claims from everybody's matches, of all groups or of some (g) whose matches are given whole."""
    rival = every.select("g", F.col("identity_id").alias("other"), F.col("max_sim").alias("other_sim"))
    better = every.join(rival, "g").filter((F.col("other") != F.col("identity_id")) & (F.col("other_sim") > F.col("max_sim") + params.fold_margin))
    able = people.confirmed_counts(faces, params.min_anchor).select("identity_id")
    named = identities.filter("name is not null").select(F.col("id").alias("identity_id"), "name").join(able, "identity_id", "left_semi")
    own = every.filter("g > 0").join(named, "identity_id")
    own = own.join(people.cooccurrence(faces, groups), ["g", "identity_id"], "left_anti").join(better.select("g", "identity_id"), ["g", "identity_id"], "left_anti")
    claimants = F.count(F.lit(1)).over(Window.partitionBy("g"))
    return own.select("identity_id", "name", "g", F.col("size").alias("photos"), F.col("max_sim").alias("sim")).withColumn("claimants", claimants)


def growth_cards(claims: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """A row a group of each person's card: strong ones all, maybes by size up to a cap."""
    single = claims.filter("claimants = 1").withColumn("tier", F.when(F.col("sim") >= params.strong, "strong").otherwise("maybe"))
    order = Window.partitionBy("identity_id", "tier").orderBy(F.desc("photos"), F.desc("sim"), "g")
    ranked = single.withColumn("rank", F.row_number().over(order))
    return ranked.filter((F.col("tier") == "strong") | (F.col("rank") <= params.max_maybe)).select("identity_id", "name", "g", "photos", "sim", "tier", "rank")


def who_is_this(claims: DataFrame, limit: int = 3) -> DataFrame:
    """Groups that several people claim, with their best candidates."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("worse"), "identity_id", "name")))
    grouped = claims.filter("claimants >= 2").groupBy("g").agg(F.max("photos").alias("photos"), order.alias("all"))
    return grouped.select("g", "photos", F.transform(F.slice("all", 1, limit), lambda c: c["identity_id"]).alias("candidates"))


def merge_suggestions(photos: DataFrame, faces: DataFrame, identities: DataFrame, cannot_link: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Pairs of groups that might be one person, and twins: such pairs that share a photo.

    The strongest pairs by leverage are taken first and judged then. Two named people, and people
    that were told apart, are never suggested. Pictured together is a question only if very alike.
    """
    pool = people.pool(faces)
    evidence = vectors.merge_evidence(vectors.knn(pool, params.k, params.suggest), pool, params.min_pairs)
    groups = people.overview(faces, identities)
    side = lambda p: groups.select(F.col("g").alias(p), F.col("count").alias(f"{p}_count"), F.col("name").alias(f"{p}_name"))
    ranked = evidence.join(side("a"), "a").join(side("b"), "b")
    ranked = ranked.withColumn("leverage", F.col("max_sim") * F.col("pairs") * F.sqrt(F.col("a_count") + F.col("b_count")))
    top = written(ranked.orderBy(F.desc("leverage"), "a", "b").limit(params.top_merges), "merge-top")
    first = F.col("a_count") >= F.col("b_count")
    pick = lambda c: (F.when(first, F.col(f"a{c}")).otherwise(F.col(f"b{c}")), F.when(first, F.col(f"b{c}")).otherwise(F.col(f"a{c}")))
    (target, source), (target_name, source_name), (_, photos_) = pick(""), pick("_name"), pick("_count")
    sided = top.select(target.alias("target"), source.alias("source"), target_name.alias("target_name"), source_name.alias("source_name"), F.col("max_sim").alias("similarity"), photos_.alias("photos"))
    sided = sided.filter(F.col("target_name").isNull() | F.col("source_name").isNull())
    lo, hi = F.least(-F.col("target"), -F.col("source")), F.greatest(-F.col("target"), -F.col("source"))
    both = (F.col("target") < 0) & (F.col("source") < 0)
    told = people.symmetric(cannot_link)
    sided = sided.withColumn("lo", F.when(both, lo)).withColumn("hi", F.when(both, hi)).join(told, (F.col("lo") == told["a"]) & (F.col("hi") == told["b"]), "left_anti").drop("lo", "hi")
    own = pool.select(F.col("g").alias("target"), "photo_id", F.col("id").alias("fa"))
    other = pool.select(F.col("g").alias("source"), "photo_id", F.col("id").alias("fb"))
    shared = sided.select("target", "source").join(own, "target").join(other, ["source", "photo_id"]).groupBy("target", "source").agg(F.min(F.struct("photo_id", "fa", "fb")).alias("first"))
    marked = sided.join(shared, ["target", "source"], "left")
    taken = people.other_named_person(faces, identities, None).select(F.col("g").alias("source"))
    plain = marked.filter("first is null")
    twins = marked.filter(F.col("first").isNotNull() & (F.col("similarity") >= params.same_photo_ask)).join(taken, "source", "left_anti")
    keep = lambda df, kind: df.select(F.lit(kind).alias("kind"), "target", "source", "target_name", "similarity", "photos", F.col("first.photo_id").alias("photo_id"))
    return settled(photos, keep(plain, "pairwise").unionByName(keep(twins, "twin")))


def review_queue(claims: DataFrame, merges: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """All engines' cards, most photos first; kinds keep their order on ties."""
    cards = growth_cards(claims, params)
    none = F.lit(None).cast("long")
    who = who_is_this(claims).select(F.lit(0).alias("ord"), F.lit("who").alias("kind"), F.col("g").alias("subject"), none.alias("other"), "photos")
    twins = merges.filter("kind = 'twin'").groupBy("photo_id").agg(F.sum("photos").alias("photos"))
    twins = twins.select(F.lit(1).alias("ord"), F.lit("twin").alias("kind"), F.col("photo_id").alias("subject"), none.alias("other"), "photos")
    strong = cards.filter("tier = 'strong'").groupBy("identity_id").agg(F.sum("photos").alias("photos"))
    strong = strong.select(F.lit(2).alias("ord"), F.lit("strong").alias("kind"), (-F.col("identity_id")).alias("subject"), none.alias("other"), "photos")
    maybe = cards.filter("tier = 'maybe'").select(F.lit(3).alias("ord"), F.lit("maybe").alias("kind"), (-F.col("identity_id")).alias("subject"), F.col("g").alias("other"), "photos")
    pairs = merges.filter("kind = 'pairwise'").select(F.lit(4).alias("ord"), F.lit("pairwise").alias("kind"), F.col("target").alias("subject"), F.col("source").alias("other"), "photos")
    every = who.unionByName(twins).unionByName(strong).unionByName(maybe).unionByName(pairs)
    return every.filter(F.col("photos") >= params.review_photos).orderBy(F.desc("photos"), "ord", "subject", "other").limit(params.review_queue)


def queue_summary(queue: DataFrame, groups: DataFrame) -> DataFrame:
    """Cards and photos that wait in the queue, and how many groups have a name."""
    waiting = queue.agg(F.count(F.lit(1)).alias("cards"), F.coalesce(F.sum("photos"), F.lit(0)).cast("long").alias("photos"))
    return waiting.withColumn("named", groups.filter("name is not null").agg(F.count(F.lit(1))).scalar())


def reviewable(cards: DataFrame) -> DataFrame:
    """People with groups that may be theirs: how many, and of how many photos."""
    return cards.filter("tier = 'maybe'").groupBy("identity_id").agg(F.count(F.lit(1)).alias("groups"), F.sum("photos").alias("photos"))


def prune_cards(cards: DataFrame, touched: DataFrame) -> DataFrame:
    """Cards that name none of the groups that a decision touched."""
    gone = touched.select("g")
    return cards.join(gone, cards["subject"] == gone["g"], "left_anti").join(gone, cards["other"] == gone["g"], "left_anti")


def current_cards(cards: DataFrame, generation: int, running: bool) -> DataFrame:
    """Cards of this generation, none while a pass runs."""
    return cards.filter((F.col("generation") == generation) & F.lit(not running))


def person_looks(photos: DataFrame, faces: DataFrame, identities: DataFrame, cannot_link: DataFrame, group: int, params: Params = DEFAULT) -> DataFrame:
    """A person's looks with dates and cover; looks that fit another person better are flagged.

    Fewer faces than the floor give none, and so do fewer than two looks.
    """
    dated = people.pool(faces).filter(F.col("g") == group).join(photos.select(F.col("id").alias("photo_id"), library.S.sort_ts().alias("ts")), "photo_id")
    rows = dated.join(clusters.looks(dated, params.look_tau), ["g", "id"]).cache()
    means = vectors.mean_normalized(rows, "look")
    size = rows.groupBy("look").agg(
        F.count(F.lit(1)).alias("faces"), F.count_distinct("photo_id").alias("photos"), F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"),
        F.max(F.struct("score", (-F.col("ts")).alias("t"), (-F.col("id")).alias("i")))["i"].alias("cover"), F.array_sort(F.collect_set("photo_id")).alias("photo_ids"),
    )
    dominant = size.orderBy(F.desc("faces"), F.desc("look")).limit(1).join(means, "look").select(F.col("mean").alias("own"))
    anchors = vectors.anchors(faces, params.anchor_size)
    core = clusters.anchor_core(anchors.filter(F.col("identity_id") == -group), params)
    reference = vectors.mean_normalized(core, "identity_id").select(F.col("mean").alias("own")) if group < 0 and core.take(1) else dominant
    told = people.symmetric(cannot_link)
    barred = told.filter(F.col("a") == -group).select(F.col("b").alias("identity_id")).union(told.filter(F.col("b") == -group).select("a"))
    others = vectors.anchors(faces, 48).filter(F.col("identity_id") != -group).join(barred, "identity_id", "left_anti")
    able = others.groupBy("identity_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= params.min_anchor)
    others = clusters.anchor_core(others.join(able, "identity_id", "left_semi"), params)
    rivals = vectors.mean_normalized(others, "identity_id").join(identities.filter("name is not null").select(F.col("id").alias("identity_id"), "name"), "identity_id")
    measured = size.join(means, "look").join(F.broadcast(reference)).withColumn("own_sim", vectors.dot(F.col("mean"), F.col("own")))
    flagged = measured.select("look", "own_sim", F.col("mean").alias("m")).join(F.broadcast(rivals)).withColumn("sim", vectors.dot(F.col("m"), F.col("mean")))
    flagged = flagged.filter((F.col("sim") >= params.look_flag) & (F.col("sim") > F.col("own_sim") + params.look_flag_margin))
    flags = flagged.groupBy("look").agg(F.max(F.struct("sim", (-F.col("identity_id")).alias("g"), "name")).alias("flag"))
    every = measured.join(flags, "look", "left").filter(F.col("flag").isNotNull() | (F.col("photos") >= params.look_photos))
    order = Window.partitionBy(F.col("flag").isNull()).orderBy(F.desc("photos"), "look")
    kept = every.withColumn("rank", F.row_number().over(order)).filter(F.col("flag").isNotNull() | (F.col("rank") <= params.max_looks))
    enough = kept.withColumn("shown", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))).filter("shown >= 2")
    out = enough.select("look", "photos", "from_ts", "to_ts", (-F.col("cover")).alias("cover"), "photo_ids", F.col("flag.name").alias("likely_other"), F.col("flag.g").alias("likely_group"), "rank")
    return out.orderBy(F.col("likely_other").isNotNull(), "rank") if rows.count() >= params.look_faces else out.limit(0)
