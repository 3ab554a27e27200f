"""Curation of the lexicon and of groups: questions, answers by bucket, audit worklists, detectors, validation.

Inputs are aggregated tables (names, rules, groups), at most one row per distinct name; nothing here meets record rows
but the aggregations that make them. Null names are left out; ties are broken by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brineflow.functions.quantity import peg_weight
from brineflow.functions.text import canonical_id
from brineflow.operators.lexicon import mode_share, running_coverage
from brineflow.operators.ranks import smallest


def questions(rows: DataFrame, name: str, example: str, least: int = 40, most: int = 40, examples: int = 3) -> DataFrame:
    """(name, n_uses, examples, rank): the most used names, those with at least `least` uses, each with its first examples."""
    named = rows.where(F.col(name).isNotNull())
    counts = named.groupBy(name).agg(F.count(F.lit(1)).alias("n_uses")).where(F.col("n_uses") >= least)
    top = counts.orderBy(F.desc("n_uses"), F.asc(name)).limit(most)
    shown = smallest(named.join(F.broadcast(top.select(name)), name).select(name, example).distinct(), [name], [F.asc(example)], F.col(example), examples)  # at most `most` names
    lists = shown.groupBy(name).agg(F.array_sort(F.collect_list(example)).alias("examples"))
    rank = F.row_number().over(Window.orderBy(F.desc("n_uses"), F.asc(name)))  # at most `most` rows
    return top.join(lists, name, "left").withColumn("rank", rank)


def buckets(queue: DataFrame, decision: Column, chem_class: Column) -> DataFrame:
    """(bucket, n_names, weight): the queue by kind of decision and class."""
    return queue.groupBy(F.concat_ws(":", decision, chem_class).alias("bucket")).agg(F.count(F.lit(1)).alias("n_names"), F.sum("weight").alias("weight"))


#: Units of new entries by class.
NEW_UNIT = {"salt": "molar", "buffer": "molar", "organic": "percent_v_v", "polyol": "percent_v_v", "detergent": "percent_w_v"}


def apply_bucket_answers(queue: DataFrame, answers: DataFrame, aliases: DataFrame, buffers: DataFrame | None = None) -> DataFrame:
    """The queue (name, bucket, target, chem_class, weight) with `outcome`, `why`, and what a new entry would be.

    `answers` (bucket, chosen) hold accept, new or leave per bucket; `aliases` (name, owner) what the lexicon has, in
    lower case; `buffers` (name, pka). Invariants: an alias has one owner; an accepted target exists; a polymer needs
    a weight in its name and a buffer a known pKa. What breaks one is skipped and says why; a bucket without an answer
    is left.
    """
    pkas = buffers if buffers is not None else queue.sparkSession.createDataFrame([], "name string, pka double")
    low = F.lower(F.trim("name"))
    targets = aliases.select(F.col("owner").alias("target")).distinct().withColumn("_exists", F.lit(True))
    j = (
        queue.join(F.broadcast(answers.select("bucket", "chosen")), "bucket", "left")
        .withColumn("_low", low)
        .join(aliases.select(F.col("name").alias("_low"), F.col("owner").alias("_owner")), "_low", "left")
        .join(targets, "target", "left")
        .join(pkas.select(F.col("name").alias("_low"), F.col("pka").alias("_pka")), "_low", "left")
        .withColumn("_mw", peg_weight(F.col("name")))
        .withColumn("_id", F.nullif(canonical_id(F.col("name")), F.lit("")))
    )
    deciding = F.col("chosen").isin("accept", "new")
    new = F.col("chosen") == "new"
    why = (
        F.when(deciding & F.col("_owner").isNotNull(), F.concat(F.lit("already an alias of "), "_owner"))
        .when((F.col("chosen") == "accept") & F.col("_exists").isNull(), "target not in the lexicon")
        .when(new & (F.col("chem_class") == "peg") & F.col("_mw").isNull(), "no weight in the name")
        .when(new & (F.col("chem_class") == "buffer") & F.col("_pka").isNull(), "no known pKa")
        .when(new & F.col("_id").isNull(), "no legal id")
    )
    outcome = F.when(F.coalesce(F.col("chosen"), F.lit("leave")) == "leave", "left").when(F.col("_why").isNotNull(), "skipped").when(new, "new").otherwise("alias")
    units = F.create_map(*[F.lit(x) for kv in NEW_UNIT.items() for x in kv])
    unit = F.when(F.col("chem_class") == "peg", F.when(F.col("_mw") <= 600, "percent_v_v").otherwise("percent_w_v")).otherwise(F.coalesce(F.try_element_at(units, F.col("chem_class")), F.lit("millimolar")))
    done = j.withColumn("_why", why).withColumn("outcome", outcome)
    is_new = F.col("outcome") == "new"
    return done.select(
        *queue.columns, "outcome", F.when(F.col("outcome") == "skipped", F.col("_why")).alias("why"), F.when(is_new, F.col("_id")).alias("new_id"),
        F.when(is_new, unit).alias("default_unit"), F.when(is_new & (F.col("chem_class") == "peg"), F.col("_mw")).alias("peg_mw"), F.when(is_new & (F.col("chem_class") == "buffer"), F.col("_pka")).alias("buffer_pka"),
    )


def audit_worklist(components: DataFrame, name: str, canonical: str, unit: str) -> DataFrame:
    """(kind, subject, decision, n, coverage): every decision once: unit rules, mappings with cumulative coverage by use, and unmapped names."""
    used = components.where(F.col(name).isNotNull())
    mapped = used.where(F.col(canonical).isNotNull()).groupBy(F.col(name).alias("subject"), F.col(canonical).alias("decision")).agg(F.count(F.lit(1)).alias("n"))
    keyed = running_coverage(mapped.withColumn("_key", F.concat_ws("\x1f", "subject", "decision")), "_key", "n").select(F.lit("mapping").alias("kind"), "subject", "decision", "n", "coverage")
    none = F.lit(None).cast("double").alias("coverage")
    unmapped = used.where(F.col(canonical).isNull()).groupBy(F.col(name).alias("subject")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("unmapped").alias("kind"), "subject", F.lit(None).cast("string").alias("decision"), "n", none)
    rules = components.where(F.col(canonical).isNotNull() & F.col(unit).isNotNull()).groupBy(F.col(canonical).alias("subject"), F.col(unit).alias("decision")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("unit").alias("kind"), "subject", "decision", "n", none)
    return keyed.unionByName(unmapped).unionByName(rules)


def anomalies(components: DataFrame, reagents: DataFrame, name: str, canonical: str, unit: str, least: int = 50) -> DataFrame:
    """(anomaly, subject, detail, n): ambiguous names, minority units, contradictory default units, mappings beside the list, reagents without use."""
    lower = F.lower(F.trim(name))
    of_name = components.where(F.col(name).isNotNull() & F.col(canonical).isNotNull()).groupBy(lower.alias("subject"), canonical).agg(F.count(F.lit(1)).alias("k"))
    ambiguous = of_name.groupBy("subject").agg(F.array_join(F.array_sort(F.collect_set(canonical)), "|").alias("detail"), F.count(F.lit(1)).alias("c"), F.sum("k").alias("n")).where("c > 1").select(F.lit("ambiguous_name").alias("anomaly"), "subject", "detail", "n")
    shares = mode_share(components.where(F.col(canonical).isNotNull()), canonical, unit)
    total = Window.partitionBy(canonical)
    minority = shares.withColumn("t", F.sum("n").over(total)).where((F.col("share") > 0.005) & (F.col("share") < 0.15) & (F.col("t") >= least)).select(F.lit("minority_unit").alias("anomaly"), F.col(canonical).alias("subject"), F.col(unit).alias("detail"), "n")
    most_used = shares.where("rank = 1").join(reagents.select(F.col("canonical_id").alias(canonical), "default_unit"), canonical).where(F.col("default_unit") != F.col(unit))
    contradictory = most_used.select(F.lit("contradictory_unit").alias("anomaly"), F.col(canonical).alias("subject"), F.concat_ws("|", "default_unit", unit).alias("detail"), "n")
    uses = components.where(F.col(canonical).isNotNull()).groupBy(F.col(canonical).alias("subject")).agg(F.count(F.lit(1)).alias("n"))
    ids = reagents.select(F.col("canonical_id").alias("subject")).distinct()
    nothing = F.lit(None).cast("string").alias("detail")
    missing = uses.join(ids, "subject", "left_anti").select(F.lit("missing_reagent").alias("anomaly"), "subject", nothing, "n")
    unused = ids.join(uses.select("subject"), "subject", "left_anti").select(F.lit("unused_reagent").alias("anomaly"), "subject", nothing, F.lit(0).cast("bigint").alias("n"))
    return ambiguous.unionByName(minority).unionByName(contradictory).unionByName(missing).unionByName(unused)


def group_violations(groups: DataFrame, classes: list[str], axes: list[str]) -> DataFrame:
    """(rule, id) of every broken rule of groups (id, level, l1_class, parent, axes): id shape, level, class, empty centroid, repeated id, and the parent's being, level and class."""
    broken = lambda cond, rule: groups.where(cond).select(F.lit(rule).alias("rule"), "id")
    own = (
        broken(F.col("id").isNull() | ~F.col("id").rlike("^[A-Z0-9]+(_[A-Z0-9]+)*$"), "id_shape")
        .unionByName(broken(~F.coalesce(F.col("level").isin(2, 3), F.lit(False)), "level"))
        .unionByName(broken(~F.coalesce(F.col("l1_class").isin(*classes), F.lit(False)), "unknown_class"))
        .unionByName(broken(F.coalesce(*axes).isNull(), "empty_centroid"))
        .unionByName(broken((F.col("level") == 3) & F.col("parent").isNull(), "no_parent"))
    )
    repeated = groups.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("repeated_id").alias("rule"), "id")
    up = groups.groupBy(F.col("id").alias("parent")).agg(F.min("level").alias("_l"), F.min("l1_class").alias("_c"))
    tied = groups.where(F.col("parent").isNotNull()).join(up, "parent", "left")
    of_parent = F.when(F.col("_l").isNull(), "parent_missing").when(F.col("_l") != 2, "parent_level").when(~F.col("_c").eqNullSafe(F.col("l1_class")), "parent_class")
    return own.unionByName(repeated).unionByName(tied.select(of_parent.alias("rule"), "id").where("rule IS NOT NULL"))


def select_cells(cells: DataFrame, least: int, most: int) -> DataFrame:
    """Cells (level, cell, parent, n_records) that become groups: at level 2 the `most` largest with at least `least` records, at level 3 the `most` largest such under a parent that was taken."""
    large = cells.where(F.col("n_records") >= least)
    second = large.where("level = 2").orderBy(F.desc("n_records"), "cell").limit(most)
    below = large.where("level = 3").join(second.select(F.col("cell").alias("parent")), "parent", "left_semi").select(*cells.columns)
    return second.unionByName(below.orderBy(F.desc("n_records"), "cell").limit(most))


def group_gaps(cells: DataFrame, groups: DataFrame, anchors: DataFrame, least: int, most: int = 8) -> DataFrame:
    """(gap, subject, n): cells of at least `least` records without a group, and groups without an anchor; at most `most` of each, the largest first."""
    orphans = cells.where(F.col("n_records") >= least).join(groups.select(F.col("group_id").alias("cell")), "cell", "left_anti").orderBy(F.desc("n_records"), "cell").limit(most)
    bare = groups.join(anchors.select("group_id").distinct(), "group_id", "left_anti").orderBy(F.desc("n_records"), "group_id").limit(most)
    return orphans.select(F.lit("orphan").alias("gap"), F.col("cell").alias("subject"), F.col("n_records").alias("n")).unionByName(bare.select(F.lit("anchorless").alias("gap"), F.col("group_id").alias("subject"), F.col("n_records").alias("n")))


def member_names(members: DataFrame, group: str, record: str, name: str, share: float = 0.10, most: int = 5) -> DataFrame:
    """(group, label): the names that at least `share` of a group's records hold, the most frequent first, at most `most`."""
    size = members.groupBy(group).agg(F.countDistinct(record).alias("_size"))
    held = members.where(F.col(name).isNotNull()).groupBy(group, name).agg(F.countDistinct(record).alias("n"))
    kept = held.join(size, group).where(F.col("n") >= F.lit(share) * F.col("_size"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), F.asc(name)))  # at most 1 / share names a group
    top = kept.withColumn("_r", rank).where(F.col("_r") <= most)
    return top.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", name))), lambda x: x[name]), " + ").alias("label"))


def strategy_counts(assigned: DataFrame, components: DataFrame, record: str) -> DataFrame:
    """One row with what a strategy question is weighed by: records by assigned level, those with an anchor, and those with a premix."""
    premix = components.where(F.col("premix_id").isNotNull() | F.coalesce(F.col("chem_class") == "premix", F.lit(False))).agg(F.countDistinct(record).alias("n_premix"))
    levels = assigned.agg(F.count_if(F.col("level") == 2).alias("n_level2"), F.count_if(F.col("level") == 3).alias("n_level3"), F.count_if(F.col("level").isNull()).alias("n_unassigned"), F.count_if("anchored").alias("n_anchored"))
    return levels.join(F.broadcast(premix))  # two single rows
