"""Classification, sparse features, distances, nearest groups and screen matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brineflow.functions import quantity as Q
from brineflow.runtime.session import bounded_rows
from brineflow.schemas import OUT_OF_SCOPE

AXES = ("peg_log_mw", "peg_percent", "salt_rank", "salt_log_molar", "organic_percent", "ph")
#: Weight and scale of each axis.
WEIGHTS = {"peg_log_mw": 1.0, "peg_percent": 0.8, "salt_rank": 0.9, "salt_log_molar": 0.9, "organic_percent": 0.7, "ph": 0.6}
SCALES = {"peg_log_mw": 1.0, "peg_percent": 15.0, "salt_rank": 2.0, "salt_log_molar": 0.5, "organic_percent": 15.0, "ph": 1.0}
NEAR, FAR = 0.5, 1.0
#: Groups that are broadcast; of more the join shuffles.
MAX_GROUPS = 100_000


def families(components: DataFrame, peg_max_mw: float = 600, salt_min_molar: float = 0.2, least_percent: float = 4.0) -> DataFrame:
    """Adds the family a component counts for (organic, peg, salt) under thresholds; null for none."""
    percent, molar = Q.percent(F.col("concentration"), F.col("unit")), Q.molar(F.col("concentration"), F.col("unit"))
    strong = percent >= least_percent
    small = (F.col("chem_class") == "peg") & (F.col("peg_mw") <= peg_max_mw)
    counted = F.coalesce(F.col("cryo_evidence") != "explicit", F.lit(True)) & ~F.coalesce(F.col("role").isin(*OUT_OF_SCOPE, "not_a_component"), F.lit(False))
    family = (
        F.when((F.col("chem_class").isin("organic", "polyol") | small) & strong, "organic")
        .when((F.col("chem_class") == "peg") & strong, "peg")
        .when((F.col("chem_class") == "salt") & (molar >= salt_min_molar), "salt")
        .when((F.col("chem_class") == "buffer") & F.col("hofmeister_rank").isNotNull() & (molar >= salt_min_molar), "salt")
    )
    return components.withColumn("family", F.when(counted, family))


def classes(components: DataFrame, keys: list[str], **thresholds: float) -> DataFrame:
    """(keys, l1_class, n_families): the set of families of each record; a record without any is Unassigned."""
    marked = families(components, **thresholds)
    label = F.array_join(F.array_sort(F.collect_set("family")), "+")
    g = marked.groupBy(*keys).agg(label.alias("l1_class"), F.countDistinct("family").alias("n_families"))
    return g.withColumn("l1_class", F.when(F.col("n_families") == 0, "Unassigned").otherwise(F.col("l1_class")))


def expand_premixes(components: DataFrame, premixes: DataFrame, reagents: DataFrame) -> DataFrame:
    """Components with each premix replaced by what it is made of; (premix, part) in `premixes`, both ids of the list.

    A constituent keeps order, amount and role of its premix and has the class and weight of its own; the premix is
    named in `expanded_from`. A premix of unknown composition stays as it is. The list is a dimension, so the plan
    joins it once for each side and shuffles the components only if it is too large to broadcast.
    """
    own = reagents.select(F.col("canonical_id").alias("part"), F.struct("canonical_id", "chem_class", "peg_mw").alias("_part"))
    made = premixes.join(own, "part").groupBy(F.col("premix").alias("_premix")).agg(F.array_sort(F.collect_list("_part")).alias("_parts"))
    j = components.join(made, F.col("name_canonical") == F.col("_premix"), "left").withColumn("_one", F.explode_outer("_parts"))
    replaced = {"name_canonical": "canonical_id", "chem_class": "chem_class", "peg_mw": "peg_mw"}
    kept = [F.when(F.col("_one").isNull(), F.col(c)).otherwise(F.col(f"_one.{replaced[c]}")).alias(c) if c in replaced else F.col(c) for c in components.columns]
    return j.select(*kept, F.when(F.col("_one").isNotNull(), F.col("_premix")).alias("expanded_from"))


def classify(components: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, class, reason): components are read in order; the first that blocks gives the reason, else the families give the class.

    A premix blocks unless `expand_premixes` has replaced it by its constituents.
    """
    skipped = F.coalesce(F.col("role") == "not_a_component", F.lit(False)) | F.coalesce(F.col("cryo_evidence") == "explicit", F.lit(False)) | F.coalesce(F.col("role").isin(*OUT_OF_SCOPE), F.lit(False))
    precipitant = F.col("chem_class").isin("peg", "organic", "polyol", "salt")
    blocker = (
        F.when(F.col("chem_class") == "premix", "mixture").when(F.col("name_canonical").isNull(), "unidentified_reagent")
        .when(precipitant & F.col("concentration").isNull(), "no_amount")
    )
    family = F.when(F.col("chem_class").isin("organic", "polyol") | ((F.col("chem_class") == "peg") & (F.col("peg_mw") <= 600)), "organic").when(F.col("chem_class") == "peg", "peg").when(F.col("chem_class") == "salt", "salt")
    rows = components.withColumn("_blocker", F.when(~skipped, blocker)).withColumn("_family", F.when(~skipped, family))
    g = rows.groupBy(*keys).agg(
        F.min_by("_blocker", F.when(F.col("_blocker").isNotNull(), F.col(order))).alias("reason"),
        F.array_join(F.array_sort(F.collect_set("_family")), "+").alias("class"),
    )
    reason = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("class") == "", "no_precipitant")
    return g.select(*keys, F.when(reason.isNull(), F.col("class")).alias("class"), reason.alias("reason"))


def threshold_sweep(components: DataFrame, keys: list[str], weights: list[float], molars: list[float]) -> DataFrame:
    """(peg_max_mw, salt_min_molar, l1_class, n): class counts under each pair of thresholds; all pairs in one pass and one shuffle of the records."""
    grid = [(float(w), float(m)) for w in weights for m in molars]
    marked = components
    for i, (w, m) in enumerate(grid):
        marked = families(marked, peg_max_mw=w, salt_min_molar=m).withColumnRenamed("family", f"_f{i}")
    label = lambda i: F.array_join(F.array_sort(F.collect_set(f"_f{i}")), "+").alias(f"_l{i}")
    per_record = marked.groupBy(*keys).agg(*[label(i) for i in range(len(grid))])
    each = F.explode(F.array(*[F.struct(F.lit(w).alias("peg_max_mw"), F.lit(m).alias("salt_min_molar"), F.col(f"_l{i}").alias("l")) for i, (w, m) in enumerate(grid)])).alias("x")
    rows = per_record.select(each).select("x.peg_max_mw", "x.salt_min_molar", F.when(F.col("x.l") == "", "Unassigned").otherwise(F.col("x.l")).alias("l1_class"))
    return rows.groupBy("peg_max_mw", "salt_min_molar", "l1_class").agg(F.count(F.lit(1)).alias("n"))


def features(components: DataFrame, keys: list[str], ph: Column | None = None) -> DataFrame:
    """(keys, six nullable axes): an axis is null where its kind is absent, never zero. Weights of polymers without a percentage are equal."""
    counted = components.where(F.coalesce(F.col("cryo_evidence") != "explicit", F.lit(True)) & ~F.coalesce(F.col("role").isin(*OUT_OF_SCOPE, "not_a_component"), F.lit(False)))
    percent, molar = Q.percent(F.col("concentration"), F.col("unit")), Q.molar(F.col("concentration"), F.col("unit"))
    big = (F.col("chem_class") == "peg") & (F.coalesce("peg_mw", F.lit(601)) > 600)
    organic = F.col("chem_class").isin("organic", "polyol") | ((F.col("chem_class") == "peg") & (F.col("peg_mw") <= 600))
    salt = ((F.col("chem_class") == "salt") | ((F.col("chem_class") == "buffer") & F.col("hofmeister_rank").isNotNull() & (molar >= 0.2))) & (molar > 0)
    w = F.when(big & F.col("peg_mw").isNotNull(), F.coalesce(percent, F.lit(1.0)))
    g = counted.groupBy(*keys).agg(
        (F.sum(w * F.log10("peg_mw")) / F.sum(w)).alias("peg_log_mw"),
        F.sum(F.when(big, percent)).alias("peg_percent"),
        (F.sum(F.when(salt & F.col("hofmeister_rank").isNotNull(), molar * F.col("hofmeister_rank"))) / F.sum(F.when(salt & F.col("hofmeister_rank").isNotNull(), molar))).alias("salt_rank"),
        F.log10(F.sum(F.when(salt, molar))).alias("salt_log_molar"),
        F.sum(F.when(organic, percent)).alias("organic_percent"),
        (F.max(ph) if ph is not None else F.lit(None).cast("double")).alias("ph"),
    )
    return g


def distance(a: str, b: str) -> Column:
    """Weighted distance over the axes both sides have, with weights made up to one; infinite if they share none."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for axis in AXES:
        x, y = F.col(f"{a}.{axis}"), F.col(f"{b}.{axis}")
        both = x.isNotNull() & y.isNotNull()
        total = total + F.when(both, WEIGHTS[axis] * F.pow((x - y) / SCALES[axis], F.lit(2.0))).otherwise(0.0)
        weight = weight + F.when(both, F.lit(WEIGHTS[axis])).otherwise(0.0)
    return F.when(weight > 0, F.sqrt(total / weight)).otherwise(F.lit(float("inf")))


def shares_axis(a: str, b: str) -> Column:
    """Whether both sides have a common axis other than pH."""
    out = F.lit(False)
    for axis in AXES[:-1]:
        out = out | (F.col(f"{a}.{axis}").isNotNull() & F.col(f"{b}.{axis}").isNotNull())
    return out


def nearest(records: DataFrame, key: str, groups: DataFrame, on: str) -> DataFrame:
    """(key, group_id, distance): the closest group of the same class that shares an axis; ties go to the smaller id.

    Groups are a curated dimension: up to MAX_GROUPS they are sent to the records, so a class that holds most records is
    not brought together; beyond it the join shuffles. The argmin is one aggregate, so no pair table is kept.
    """
    a = records.select(key, on, F.struct(*AXES).alias("a"))
    b = groups.select("group_id", on, F.struct(*AXES).alias("b"))
    if bounded_rows(b, MAX_GROUPS) is not None:
        b = F.broadcast(b)
    pairs = a.join(b, on).where(shares_axis("a", "b")).withColumn("distance", distance("a", "b"))
    best = pairs.groupBy(key).agg(F.min(F.struct("distance", "group_id")).alias("m"))
    return best.select(key, F.col("m.group_id").alias("group_id"), F.col("m.distance").alias("distance"))


def assign_groups(records: DataFrame, key: str, level2: DataFrame, level3: DataFrame, on: str) -> DataFrame:
    """(key, level, group_id, distance, band): level 3 under the chosen level 2 if nearer than NEAR, else level 2 if nearer than FAR, else none."""
    second = nearest(records, key, level2, on).select(key, F.col("group_id").alias("parent"), F.col("distance").alias("d2"))
    third = nearest(records.join(second, key), key, level3.withColumnRenamed("parent_id", "parent"), "parent").select(key, F.col("group_id").alias("child"), F.col("distance").alias("d3"))
    j = records.select(key).join(second, key, "left").join(third, key, "left")
    level = F.when(F.col("d3") < NEAR, 3).when(F.col("d2") < FAR, 2)
    d = F.when(level == 3, F.col("d3")).when(level == 2, F.col("d2"))
    return j.select(key, level.alias("level"), F.when(level == 3, F.col("child")).when(level == 2, F.col("parent")).alias("group_id"), d.alias("distance"), Q.band(d, [0.25, 0.5, 1.0], ["exact", "near", "loose", "far"]).alias("band"))


def centroids(records: DataFrame, by: list[str]) -> DataFrame:
    """Mean of each axis over the members that have it."""
    return records.groupBy(*by).agg(*[F.avg(a).alias(a) for a in AXES], F.count(F.lit(1)).alias("n_records"))


def merge_candidates(groups: DataFrame, on: str, below: float = 0.25) -> DataFrame:
    """(a, b, distance): pairs of groups of the same class nearer than `below`. Groups are a curated dimension, so a class has few; every two of a class are compared."""
    side = lambda p: groups.select(F.col("group_id").alias(p), on, F.struct(*AXES).alias(f"{p}x"))
    pairs = side("a").join(side("b"), on).where("a < b").where(shares_axis("ax", "bx")).withColumn("distance", distance("ax", "bx"))
    return pairs.where(F.col("distance") < below).select("a", "b", "distance")


def cell_label(level: int) -> Column:
    """Readable grid cell of a record's axes: polymer weight and salt at level 2, with strengths and pH at level 3."""
    weight = Q.band(F.pow(F.lit(10.0), F.col("peg_log_mw")), [600, 3000, 6000], ["PEG low", "PEG mid", "PEG high", "PEG very high"])
    salt = F.when(F.col("salt_log_molar").isNotNull(), "salt")
    organic = F.when(F.col("organic_percent").isNotNull(), "organic")
    parts = [weight, salt, organic]
    if level == 3:
        parts += [
            Q.band(F.col("peg_percent"), [10, 20, 30], ["to 10 %", "10-20 %", "20-30 %", "over 30 %"]),
            Q.band(F.pow(F.lit(10.0), F.col("salt_log_molar")), [0.5, 1.5], ["to 0.5 M", "0.5-1.5 M", "over 1.5 M"]),
            Q.band(F.col("ph"), [5.5, 7.0, 8.5], ["pH to 5.5", "pH 5.5-7", "pH 7-8.5", "pH over 8.5"]),
        ]
    return F.concat_ws(" · ", *parts)


def fingerprints(components: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fingerprint, n, identified, parts): the set of names without explicit cryoprotectants; unidentified ones keep the start of their raw name."""
    kept = components.where(F.coalesce(F.col("cryo_evidence") != "explicit", F.lit(True)) & ~F.coalesce(F.col("role") == "not_a_component", F.lit(False)))
    name = F.coalesce("name_canonical", F.concat(F.lit("?"), F.substring(F.lower("name_raw"), 1, 24)))
    part = F.struct(name.alias("name"), "concentration", "unit")
    return kept.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_set(name)), "|").alias("fingerprint"), F.count(F.lit(1)).alias("n"), F.min(F.col("name_canonical").isNotNull()).alias("identified"),
        F.array_sort(F.collect_list(part)).alias("parts"),
    )


def match_screens(records: DataFrame, key: str, wells: DataFrame) -> DataFrame:
    """(key, well_id, kind, score): wells with the same set of names; the best agreement wins, ties go to the first well.

    `records` and `wells` are fingerprints (records with ph); only fully identified wells are candidates.
    """
    a = records.select(key, "fingerprint", F.col("parts").alias("x"), "ph")
    b = wells.where("identified").select("well_id", "fingerprint", F.col("parts").alias("y"), F.col("ph").alias("well_ph"))
    agree = F.forall(F.arrays_zip("x", "y"), lambda z: Q.amounts_agree(z["x"]["concentration"], z["x"]["unit"], z["y"]["concentration"], z["y"]["unit"]))
    all_agree = (F.size("x") == F.size("y")) & agree
    ph = Q.ph_agrees(F.col("ph"), F.col("well_ph"))
    score = F.when(all_agree & ph, 2).when(all_agree, 1).otherwise(0)
    pairs = a.join(b, "fingerprint").withColumn("score", score)
    best = pairs.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("well_id"))).alias("m"))
    kind = F.when(F.col("m.s") == -2, "exact").when(F.col("m.s") == -1, "components_and_concentrations").otherwise("components_only")
    return best.select(key, F.col("m.well_id").alias("well_id"), kind.alias("kind"), (-F.col("m.s")).alias("score"))


def centroid_text() -> Column:
    """A centroid of log-scaled axes as people write it; what is absent is left out."""
    power = lambda c: F.pow(F.lit(10.0), F.col(c))
    parts = [
        F.when(F.col("peg_log_mw").isNotNull(), F.concat(F.lit("PEG "), F.format_string("%.0f", power("peg_log_mw")))), F.when(F.col("peg_percent").isNotNull(), F.format_string("%.1f %% PEG", "peg_percent")),
        F.when(F.col("salt_log_molar").isNotNull(), F.format_string("%.2f M salt", power("salt_log_molar"))), F.when(F.col("organic_percent").isNotNull(), F.format_string("%.1f %% organic", "organic_percent")), F.when(F.col("ph").isNotNull(), F.format_string("pH %.1f", "ph")),
    ]
    return F.concat_ws(", ", *parts)
