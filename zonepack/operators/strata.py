"""Strata: snapshot, names, package and bundle paths, collisions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from zonepack.functions import text as T
from zonepack.sources.staging import stage

FULL, UNMATCHED = "<full>", "<unmatched>"


def snapshot(layer: DataFrame, fid: str, keep: Sequence[str] = (), subset: str | None = None, selection: DataFrame | None = None) -> DataFrame:
    """(stratum_id, keep...) of the rows that make strata; a package run refuses an empty selection."""
    rows = layer.where(F.expr(subset)) if subset else layer
    if selection is not None:
        rows = rows.join(selection.select(fid), fid, "left_semi")
    return rows.select(F.col(fid).alias("stratum_id"), *keep)


def named(strata: DataFrame, name_expr: str | None = None) -> DataFrame:
    """With ``raw_name`` (a SQL expression over the stratum's columns, its id if there is none) and ``name``."""
    raw = F.expr(name_expr).cast("string") if name_expr else F.col("stratum_id").cast("string")
    return strata.withColumn("raw_name", raw).withColumn("name", T.sanitize_filename(F.col("raw_name")))


def with_paths(strata: DataFrame, package_expr: str | None = None, bundle_expr: str | None = None) -> DataFrame:
    """With ``package_rel`` (the name by default) and ``bundle_rel`` (the last part of the package path by
    default), and ``path_error`` of the first that is refused. The expressions see the stratum's columns."""
    strata = strata.withColumn("package_rel", F.array_join(T.path_parts(F.expr(package_expr).cast("string") if package_expr else F.col("name")), "/"))
    bundle = F.expr(bundle_expr).cast("string") if bundle_expr else F.substring_index("package_rel", "/", -1)
    strata = strata.withColumn("bundle_rel", F.array_join(T.path_parts(bundle), "/"))
    return strata.withColumn("path_error", F.coalesce(T.path_error(F.col("package_rel")), T.path_error(F.col("bundle_rel"))))


def duplicate_names(names: DataFrame, name: str) -> DataFrame:
    """Names that occur more than once."""
    return names.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n")).where("n > 1")


def collisions(names: DataFrame, name: str, *within: str) -> DataFrame:
    """(within..., folded, spellings): distinct spellings that are one name where case is ignored."""
    return names.groupBy(*within, T.fold(F.col(name)).alias("folded")).agg(F.array_sort(F.collect_set(name)).alias("spellings")).where("size(spellings) > 1")


def bundles(strata: DataFrame) -> DataFrame:
    """(bundle_rel, members): strata that share an output path, in order of their ids."""
    members = F.array_sort(F.collect_list(F.struct("stratum_id", "name")))
    return strata.groupBy("bundle_rel").agg(F.transform(members, lambda m: m["name"]).alias("members"))


def bundle_collisions(strata: DataFrame) -> DataFrame:
    """Package paths that fall on each other inside a bundle, also where case is ignored."""
    return strata.groupBy("bundle_rel", T.fold(F.col("package_rel")).alias("folded")).agg(F.count("*").alias("n")).where("n > 1")


def display_names(strata: DataFrame, layers: DataFrame, expression: str) -> DataFrame:
    """(stratum_id, layer_id, display_name, failed): the expression sees stratum_name,
    stratum_name_sanitized and layer_name. ``layers`` is the catalog: tens of rows, one array."""
    listed = layers.agg(F.collect_list(F.struct("layer_id", "layer_name")).alias("layers"))
    rows = strata.join(listed, how="cross").withColumn("layer", F.explode("layers"))
    rows = rows.select("stratum_id", F.col("raw_name").alias("stratum_name"), F.col("name").alias("stratum_name_sanitized"), "layer.*")
    return rows.select("stratum_id", "layer_id", F.expr(expression).alias("display_name")).withColumn("failed", F.col("display_name").isNull())


SUFFIXED = r"(?s)^(.*)_([2-9]|[1-9][0-9]{1,17})\z"


def running_sum(rows: DataFrame, group: str, order: Sequence[str], amount: str, name: str) -> DataFrame:
    """``rows`` with ``name``, the sum of ``amount`` over the rows of the group up to this one by ``order``, which has no ties.

    Rows are dealt by ranges of (group, order), and summed in order there. So a group that a third of all rows are in is spread over
    many tasks. Only the first group of a range has rows before it: these sums, one a range at most, go to all tasks.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order).withColumn("_part", F.spark_partition_id())
    schema = StructType([*dealt.schema.fields, StructField("_inside", LongType()), StructField("_end", BooleanType())])
    dealt = stage(dealt.mapInArrow(partial(_sums_inside, group=group, amount=amount), schema), "ranges")
    # a group that goes on in the next range has its sum in the last row
    sums = dealt.where("_end").groupBy(F.col(group).alias("_group"), F.col("_part").alias("_range")).agg(F.max("_inside").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("_group").orderBy("_range")) - F.col("_sum")
    sums = stage(sums.select("_group", "_range", before.alias("_before")).where("_before > 0"), "sums")
    found = dealt.join(F.broadcast(sums), (F.col(group) == F.col("_group")) & (F.col("_part") == F.col("_range")), "left")
    return found.select(*rows.columns, (F.coalesce("_before", F.lit(0)) + F.col("_inside")).alias(name))


def _sums_inside(batches: Iterator[pa.RecordBatch], group: str, amount: str) -> Iterator[pa.RecordBatch]:
    """With ``_inside``, the sum over the rows of the group so far, and ``_end``, which marks the first and the last row of the partition."""
    held, last, so_far = None, None, 0
    for batch in (b for b in batches if b.num_rows):
        names = batch.column(group)
        first = np.flatnonzero(np.append(True, pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)))
        sums = np.cumsum(batch.column(amount).to_numpy().astype(np.int64))
        less = np.append(0, sums)[first]
        less[0] = -so_far if names[0].as_py() == last else 0
        inside = sums - np.repeat(less, np.diff(first, append=len(sums)))
        last, so_far = names[-1].as_py(), int(inside[-1])
        end = np.zeros(len(sums), dtype=bool)
        end[0] = held is None
        if held:
            yield pa.RecordBatch.from_arrays([*held[0].columns, *map(pa.array, held[1:])], [*held[0].schema.names, "_inside", "_end"])
        held = batch, inside, end
    if held:
        held[2][-1] = True
        yield pa.RecordBatch.from_arrays([*held[0].columns, *map(pa.array, held[1:])], [*held[0].schema.names, "_inside", "_end"])


CLAIMS = "folded string, parent string, claimed boolean, at long"


def _claims(spelled: DataFrame) -> DataFrame:
    """(folded, parent, claimed, at) of the suffixed spellings of names: is the spelling still free when it comes first?

    A name's q-th later row takes the q-th free number. Number j would be its (j - 1 - claimed below j)-th, so the spelling is in
    time if fewer rows of the name came before it than that asks for. Each depends on those before it: a name's
    spellings go through a task one after the other, of which only their count is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, below = None, 0
        for batch in (b for b in batches if b.num_rows):
            parents = batch.column("parent")
            first = np.flatnonzero(np.append(True, pc.not_equal(parents[1:], parents[:-1]).to_numpy(zero_copy_only=False))).tolist()
            number, rank, shift = (batch.column(c).to_numpy() for c in ("number", "rank", "shift"))
            free, claimed, under = (number - rank - shift).tolist(), [], []
            for begin, end in zip(first, [*first[1:], batch.num_rows]):
                if (parent := parents[begin].as_py()) != name:
                    name, below = parent, 0
                for most in free[begin:end]:
                    under.append(below)
                    claimed.append(below < most)
                    below += below < most
            yield pa.RecordBatch.from_arrays([batch.column("folded"), parents, pa.array(claimed, pa.bool_()), pa.array(number - 1 - np.array(under, dtype=np.int64))], ["folded", "parent", "claimed", "at"])

    rows = spelled.select("folded", "parent", "number", "rank", F.col("shift").cast("long").alias("shift"))
    return rows.repartition("parent").sortWithinPartitions("parent", "number").mapInArrow(run, CLAIMS)


def dedupe_names(rows: DataFrame, order: str, name: str) -> DataFrame:
    """(order, unique_name): later duplicates get ``_2``, ``_3`` and so on in order, ignoring case.

    The rule is sequential: each row takes its name if it is free, else the lowest free number. What a
    name's rows generate can only meet spellings that are that name and a number. So positions among the
    rows of a name decide, and a pre-aggregated table of such spellings corrects them: one that comes
    before the name has reached its number keeps it, and the name skips it; one that comes later is a
    duplicate itself from its first row on. This is settled name by name, from short spellings to longer ones.

    Positions, and the claimed numbers that a row has to skip, are running sums over ranges (``running_sum``), so a name that a
    third of all rows have, or of which a third are spellings, is spread over many tasks, and no array is made of
    either. ``order`` has no ties. Null names stay null.
    """
    nameless = rows.where(F.col(name).isNull()).select(F.col(order).alias("ord"), F.lit(None).cast("string").alias("unique_name"))
    rows = rows.where(F.col(name).isNotNull()).select(F.col(order).alias("ord"), F.col(name).alias("name")).withColumn("folded", T.fold(F.col("name")))
    rows = stage(rows, "named")
    names = rows.groupBy("folded").agg(F.count("*").alias("rows"), F.min("ord").alias("first"))
    parent, number = (F.regexp_extract("folded", SUFFIXED, i) for i in (1, 2))
    spelled = names.where(F.col("folded").rlike(SUFFIXED)).select("folded", parent.alias("parent"), number.cast("long").alias("number"), "first")
    known = names.select(F.col("folded").alias("parent"), F.col("rows").alias("parent_rows"))
    spelled = stage(spelled.join(known, "parent"), "spelled")

    # positions of the rows, and of the first row of each suffixed spelling, among those of the name
    events = rows.select("folded", "ord", "name", F.lit(1).alias("one"), F.lit(None).cast("string").alias("spelling"))
    events = events.unionByName(spelled.select(F.col("parent").alias("folded"), F.col("first").alias("ord"), F.lit(None).cast("string").alias("name"), F.lit(0).alias("one"), F.col("folded").alias("spelling")))
    events = running_sum(events, "folded", ["ord"], "one", "k")

    ranks = stage(spelled.join(events.where("spelling is not null").select(F.col("spelling").alias("folded"), F.col("k").alias("rank")), "folded"), "ranks")
    settled = ranks.sparkSession.createDataFrame([], CLAIMS)
    level = ranks.join(spelled.select(F.col("folded").alias("parent")), "parent", "left_anti").withColumn("shift", F.lit(0))
    while True:
        duplicated = (F.col("parent_rows") > 1) | (F.col("shift") > 0)
        alone = level.where(~duplicated).select("folded", "parent", F.lit(True).alias("claimed"), F.lit(None).cast("long").alias("at"))
        done = stage(_claims(level.where(duplicated)).unionByName(alone), "settled")
        if done.isEmpty():
            break
        settled = settled.unionByName(done)
        level = ranks.join(done.select(F.col("folded").alias("parent"), (~F.col("claimed")).cast("int").alias("shift")), "parent")

    # number of the q-th later row: q + 1, and one more for each spelling that was claimed at or below it
    late = settled.where("not claimed").select("folded", F.lit(1).alias("shift"), F.lit(0).alias("some"))
    claims = settled.where("claimed and at is not null").select(F.col("parent").alias("folded"), F.col("at").alias("q"))
    some = claims.select("folded").distinct().select("folded", F.lit(0).alias("shift"), F.lit(1).alias("some"))
    of_name = late.unionByName(some).groupBy("folded").agg(F.max("shift").alias("shift"), F.max("some").alias("some"))
    out = events.where("spelling is null").join(of_name, "folded", "left")
    out = out.select("folded", "ord", "name", (F.col("k") - 1 + F.coalesce("shift", F.lit(0))).alias("q"), (F.coalesce("some", F.lit(0)) == 1).alias("some"))
    claims = claims.select("folded", F.lit(None).cast(rows.schema["ord"].dataType).alias("ord"), F.lit(None).cast("string").alias("name"), "q", F.lit(1).alias("one"))
    merged = out.where("some").drop("some").withColumn("one", F.lit(0)).unionByName(claims)
    # at one q the claim comes first: null orders first
    skipping = running_sum(merged, "folded", ["q", "ord"], "one", "taken").where("one = 0")
    out = out.where("not some").drop("some").withColumn("taken", F.lit(0).cast("long")).unionByName(skipping.drop("one"))
    return out.select("ord", F.when(F.col("q") == 0, F.col("name")).otherwise(F.concat("name", F.lit("_"), F.col("q") + 1 + F.col("taken"))).alias("unique_name")).unionByName(nameless)
