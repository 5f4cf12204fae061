"""Keyed merges as pure functions from tables to tables; sources.store makes them atomic."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import written


def _joined(old: DataFrame, new: DataFrame, key: list[str]):
    left, right = old.select(*key, F.struct(*old.columns).alias("__old")), new.select(*key, F.struct(*new.columns).alias("__new"))
    return left.join(right, key, "full_outer")


def overwrite(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Upsert: a new row replaces the old one in all columns."""
    merged = _joined(old, new.select(old.columns), key)
    return merged.select(F.coalesce("__new", "__old").alias("r")).select("r.*")


def fill(old: DataFrame, new: DataFrame, key: list[str], stamp: str | None = None, now=None) -> DataFrame:
    """Upsert: a null never erases a stored value; stamp is set to now on rows that new touches."""
    merged = _joined(old, new.select(old.columns), key)
    out = []
    for c in old.columns:
        value = F.coalesce(F.col(f"__new.{c}"), F.col(f"__old.{c}"))
        if c == stamp:
            value = F.when(F.col("__new").isNotNull(), now).otherwise(F.col(f"__old.{c}"))
        out.append(value.alias(c))
    return merged.select(*out)


def insert_new(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new whose key is stored already are ignored."""
    return old.unionByName(new.join(old.select(*key), key, "left_anti").select(old.columns))


def without_conflicts(new: DataFrame, stored: DataFrame, number: str = "case_number", key: str = "case_key") -> DataFrame:
    """Rows whose number, in either case, isn't stored under another key."""
    other = stored.select(F.upper(number).alias("__number"), F.col(key).alias("__key"))
    return new.join(other, (F.upper(new[number]) == F.col("__number")) & (new[key] != F.col("__key")), "left_anti")


def unseen(new: DataFrame, stored: DataFrame, number: str = "case_number", key: str = "case_key") -> DataFrame:
    """Rows of which neither key nor number is stored."""
    by_number = stored.select(F.upper(number).alias("__number"))
    return new.join(stored.select(key), key, "left_anti").join(by_number, F.upper(new[number]) == F.col("__number"), "left_anti")


def first_claims(batch: DataFrame, partition: list[str], order: str, key: str = "case_key", number: str = "case_number") -> DataFrame:
    """Greedy dedupe in order: a row is skipped if its key or number was claimed; a skipped row claims nothing.

    Whether a row stays depends on which earlier ones did, so each batch is one fold; a batch is a
    page or a window of a feed, of bounded size.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        keys, numbers, keep = set(), set(), []
        rows = rows.sort_values(order, kind="stable")
        for k, n in zip(rows[key], rows[number], strict=True):
            said = n.upper() if isinstance(n, str) and n else None
            ok = k not in keys and (said is None or said not in numbers)
            keep.append(ok)
            if ok:
                keys.add(k)
                if said:
                    numbers.add(said)
        return rows[keep]

    return batch.groupBy(*partition).applyInPandas(fold, batch.schema)


def claims_in_rounds(batch: DataFrame, order: str, key: str = "case_key", number: str = "case_number", partition: list[str] | None = None) -> tuple[DataFrame, int]:
    """What first_claims keeps, without a group of rows in one task, and the number of rounds it took.

    The rows that stay are the lexicographically first independent set: a row stays if it is the first
    unsettled one at both its key and its number, and its rivals at either go; so on until none is
    unsettled. A round is grouped minima, which combine before rows move, and joins; keys of a third of
    all rows are no hot spot. Only places, keys and numbers take part, written to the shared folder each
    round. Random orders settle in about as many rounds as the logarithm of the rows; a chain in which each row is the
    rival of the next takes as many as it has links. Rows that tie in order are taken by the hash of all
    their columns; of rows that repeat whole one stays. A null key is a key; a null or empty number claims nothing.
    """
    by = partition or []
    placed = batch.withColumn("__place", F.struct(F.col(order).alias("o"), F.xxhash64(*batch.columns).alias("h")))
    left = placed.select(*[F.col(c).alias(f"__p{i}") for i, c in enumerate(by)], F.col(key).alias("__key"), F.upper(F.nullif(F.col(number), F.lit(""))).alias("__number"), "__place").distinct()
    groups = [f"__p{i}" for i in range(len(by))]
    same = lambda a, b, on: [a[c].eqNullSafe(b[c]) for c in on]
    left, stays, rounds = written(left, "claims"), None, 0
    while left.take(1):
        rounds += 1
        at_key = left.groupBy(*groups, "__key").agg(F.min("__place").alias("__first"))
        at_number = left.where("__number is not null").groupBy(*groups, "__number").agg(F.min("__place").alias("__first"))
        first = left.join(at_key, [*same(left, at_key, [*groups, "__key"]), left["__place"] == at_key["__first"]], "left_semi")
        first = first.join(at_number.withColumnsRenamed({c: f"{c}_" for c in [*groups, "__number"]}), [*[F.col(c).eqNullSafe(F.col(f"{c}_")) for c in groups], F.col("__number") == F.col("__number_")], "left")
        first = written(first.where("__first is null or __first = __place").select(*groups, "__key", "__number", "__place"), "stays")
        stays = first if stays is None else stays.unionByName(first)
        rest = left.join(first, same(left, first, [*groups, "__key"]), "left_anti")
        left = written(rest.join(first, [*same(rest, first, groups), rest["__number"] == first["__number"]], "left_anti"), "claims")
    if stays is None:
        return batch.where(F.lit(False)), 0
    wanted = stays.select(*[F.col(c).alias(f"{c}_") for c in groups], F.col("__place").alias("__stays"))
    kept = placed.dropDuplicates([*by, "__place"]).join(wanted, [*[F.col(c).eqNullSafe(F.col(f"__p{i}_")) for i, c in enumerate(by)], F.col("__place") == F.col("__stays")], "left_semi")
    return kept.drop("__place"), rounds


def replace_children(old: DataFrame, new: DataFrame, key: str = "case_key") -> DataFrame:
    """Children of keys that new brings are replaced; keys without new children keep theirs."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(old.columns))


def merge_detail(cases: DataFrame, details: DataFrame, key: str = "case_key") -> DataFrame:
    """cases with the details' values where these aren't empty."""
    merged = cases.alias("o").join(details.select(cases.columns).alias("d"), F.col(f"o.{key}") == F.col(f"d.{key}"), "left")
    out = []
    for name, kind in cases.dtypes:
        o, d = F.col(f"o.{name}"), F.col(f"d.{name}")
        if name == key:
            out.append(o)
        elif kind.startswith("array"):
            out.append(F.when(F.coalesce(F.size(d), F.lit(0)) > 0, d).otherwise(o).alias(name))
        else:
            out.append(F.coalesce(F.nullif(d, F.lit("")) if kind == "string" else d, o).alias(name))
    return merged.select(*out)


def delete_run(tables: dict[str, DataFrame], run_id: str, cascade: tuple[str, ...] = ("runs", "case_runs", "metrics", "feedback"), below: tuple[str, ...] = ("retrieved_items", "context_items")) -> dict[str, DataFrame] | None:
    """All tables without a run and what hangs on it; None if there is no such run, ValueError while it runs."""
    state = tables["runs"].where(F.col("run_id") == run_id).select("status").first()
    if state is None:
        return None
    if state["status"] == "running":
        raise ValueError("Cannot delete a running evaluation.")
    gone = tables["case_runs"].where(F.col("run_id") == run_id).select("case_run_id")
    out = dict(tables)
    for name in cascade:
        if name in out:
            out[name] = out[name].where(~F.col("run_id").eqNullSafe(run_id))
    for name in below:
        if name in out:
            out[name] = out[name].join(gone, "case_run_id", "left_anti")
    return out
