"""Which rows of a layer belong to which strata, for all strata in one join a hop.

A membership is a table (stratum_id, fid columns). Strata carry ``stratum_id`` and their key columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Hop:
    """``near`` are fields of the table reached so far, ``far`` those of ``table`` that must equal them, in order."""

    near: tuple[str, ...]
    table: DataFrame
    far: tuple[str, ...]


def _named(columns: Sequence[str]) -> list:
    return [F.col(c).alias(f"key{i}") for i, c in enumerate(columns)]


def meet(keys: DataFrame, hop: Hop, wanted: Sequence) -> DataFrame:
    """(stratum_id, wanted...) of the rows of the hop's table that a key of some stratum fits.

    A null in any component fits nothing. The keys of a stratum are distinct and a row has one key, so a
    row comes once a stratum: no ``distinct`` has to follow.
    """
    on = reduce(lambda a, b: a & b, [keys[f"key{i}"] == hop.table[c] for i, c in enumerate(hop.far)])
    return keys.join(hop.table, on).select("stratum_id", *wanted)


def propagate(strata: DataFrame, chain: Sequence[Hop]) -> DataFrame:
    """(stratum_id, key0...) that the last hop of ``chain`` compares; intermediates are reduced to distinct keys."""
    keys = strata.select("stratum_id", *_named(chain[0].near))
    for hop, following in zip(chain, chain[1:]):
        keys = meet(keys, hop, _named(following.near)).distinct()
    return keys


def match_chain(strata: DataFrame, chain: Sequence[Hop], fid: Sequence[str]) -> DataFrame:
    """Membership of the last hop's table along ``chain``; a row is in a stratum once at most."""
    return meet(propagate(strata, chain), chain[-1], [F.col(c) for c in fid])


def key_set_filter(layer: DataFrame, keys: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows of ``layer`` whose ``fields`` are one of the ``keys`` (columns in the same order)."""
    named = keys.select(*_named(keys.columns))
    on = reduce(lambda a, b: a & b, [layer[f] == named[f"key{i}"] for i, f in enumerate(fields)])
    return layer.join(named, on, "left_semi")


def match_self(strata: DataFrame, layer: DataFrame, fid: str) -> DataFrame:
    """The stratification layer itself: each stratum has its own row."""
    return strata.select("stratum_id").join(layer, F.col("stratum_id") == layer[fid]).select("stratum_id", fid)


def match_all(strata: DataFrame, layer: DataFrame, fid: Sequence[str]) -> DataFrame:
    """Whole export: every row in every stratum. A package stores such a table once; this is the logical view."""
    ids = strata.agg(F.collect_set("stratum_id").alias("ids"))  # one row, an array of strata
    return layer.select(*fid).join(ids, how="cross").select(F.explode("ids").alias("stratum_id"), *fid)


def union(*memberships: DataFrame) -> DataFrame:
    """Rows that any of the members matches."""
    return reduce(DataFrame.unionByName, memberships).distinct()


def matched(membership: DataFrame) -> DataFrame:
    """Rows in at least one stratum."""
    return membership.drop("stratum_id").distinct()


def orphans(layer: DataFrame, membership: DataFrame, fid: Sequence[str]) -> DataFrame:
    """Rows in no stratum."""
    return layer.join(matched(membership), list(fid), "left_anti")


def counts(strata: DataFrame, membership: DataFrame) -> DataFrame:
    """(stratum_id, feature_count) of all strata, 0 where nothing matched."""
    found = membership.groupBy("stratum_id").agg(F.count("*").alias("feature_count"))
    return strata.select("stratum_id").join(found, "stratum_id", "left").select("stratum_id", F.coalesce("feature_count", F.lit(0)).alias("feature_count"))


class PrefixMemo:
    """Leading hops that several layers share are joined once: their keys are kept by relation ids and
    fields, and cached when a second layer asks for them."""

    def __init__(self) -> None:
        self._kept: dict[tuple, DataFrame] = {}
        self.built = 0

    def keys(self, strata: DataFrame, chain: Sequence[Hop], relation_ids: Sequence[str]) -> DataFrame:
        at = (tuple(relation_ids[: len(chain) - 1]), chain[-1].near, tuple(chain[0].near))
        if at in self._kept:
            return self._kept[at].persist() if len(chain) > 1 else self._kept[at]
        self.built += 1
        if len(chain) == 1:
            found = propagate(strata, chain)
        else:
            found = meet(self.keys(strata, chain[:-1], relation_ids[:-1]), chain[-2], _named(chain[-1].near)).distinct()
        self._kept[at] = found
        return found

    def match(self, strata: DataFrame, chain: Sequence[Hop], relation_ids: Sequence[str], wanted: Sequence[str]) -> DataFrame:
        return meet(self.keys(strata, chain, relation_ids), chain[-1], [F.col(c) for c in wanted])

    def clear(self) -> None:
        for frame in self._kept.values():
            frame.unpersist()
        self._kept.clear()
