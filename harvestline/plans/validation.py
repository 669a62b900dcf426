"""Train/test splits, folds and row roles."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from harvestline.functions.ranking import null_safe_join, hash_rank, value_rank


def split_random(df: DataFrame, id_cols: Sequence[str], test_share: float = 0.2, seed: int = 42, role: str = "role") -> DataFrame:
    """Exactly round(n*share) rows become ``test``, by the rank of a seeded hash."""
    ranked = hash_rank(df, id_cols, seed, rank="_rank", total="_total")
    is_test = F.col("_rank") <= F.floor(F.col("_total") * F.lit(float(test_share)) + 0.5)
    return ranked.withColumn(role, F.when(is_test, "test").otherwise("train")).drop("_rank", "_total")


def split_nested(df: DataFrame, id_cols: Sequence[str], test_share: float = 0.2, valid_share: float = 0.2, seed: int = 42) -> DataFrame:
    """80/20, then the training part again 80/20 into train and valid."""
    outer = split_random(df, id_cols, test_share, seed)
    ranked = hash_rank(outer, id_cols, f"{seed}v", by=["role"], rank="_rank", total="_total")
    is_valid = (F.col("role") == "train") & (F.col("_rank") <= F.floor(F.col("_total") * F.lit(float(valid_share)) + 0.5))
    return ranked.withColumn("role", F.when(is_valid, "valid").otherwise(F.col("role"))).drop("_rank", "_total")


def folds_kfold(df: DataFrame, id_cols: Sequence[str], k: int, seed: int = 42, fold: str = "fold") -> DataFrame:
    """Shuffled folds whose sizes differ by one at most."""
    ranked = hash_rank(df, id_cols, seed, rank="_rank")
    return ranked.withColumn(fold, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def folds_leave_one_group(df: DataFrame, group: str, fold: str = "fold", role: str = "role", min_rows: int = 1) -> DataFrame:
    """Every row once per fold: ``test`` in the fold of its own group, else ``train``. The
    list of groups (years, countries) is one small array; fits that can tell roles from a
    condition should use the group column itself instead of these copies."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows)
    groups = sizes.agg(F.array_sort(F.collect_set(group))).scalar()
    out = df.withColumn("_groups", groups).withColumn(fold, F.explode("_groups")).drop("_groups")
    return out.withColumn(role, F.when(F.col(group).eqNullSafe(F.col(fold)), "test").otherwise("train"))


def folds_time_series(df: DataFrame, order: str, id_cols: Sequence[str], n_splits: int = 3, seed: int = 42,
                      fold: str = "fold", role: str = "role") -> DataFrame:
    """Expanding windows: fold i tests the i-th of the last ``n_splits`` equal blocks and
    trains on everything before it; later rows are left out of that fold."""
    ranked = value_rank(df, order, id_cols, seed, rank="_rank", total="_total")
    size = F.floor(F.col("_total") / (n_splits + 1))
    out = ranked.withColumn(fold, F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    start = F.col("_total") - size * (n_splits - F.col(fold))
    out = out.withColumn(role, F.when(F.col("_rank") <= start, "train").when(F.col("_rank") <= start + size, "test"))
    return out.where(F.col(role).isNotNull()).drop("_rank", "_total")


def fold_guards(df: DataFrame, minimum: Mapping[str, int], by: Sequence[str] = ("fold",), role: str = "role") -> DataFrame:
    """Only the folds with enough rows of every role."""
    sizes = df.groupBy(*by).agg(*[F.count_if(F.col(role) == r).alias(f"_{r}") for r in minimum])
    for r, n in minimum.items():
        sizes = sizes.where(F.col(f"_{r}") >= n)
    return null_safe_join(df, sizes.select(*by), list(by))


# Fewest rows per role for a fold to be run, per pipeline.
MIN_ROWS = {
    "transfer": {"train": 50, "finetune": 10, "test": 5},
    "boosted_all": {"train": 20, "test": 1},
    "boosted_target": {"train": 5, "test": 1},
    "sequence": {"train": 100, "finetune": 10, "test": 10},
}

MODES = ("transfer", "direct", "direct_all", "target_only", "all")


def role_conditions(mode: str, target: str, test_group, *, country: str = "country", year: str = "c_year",
                    exclude_years: Sequence[int] = (), sources: Sequence[str] | None = None) -> dict[str, Column]:
    """Conditions of the row roles of one training mode and held-out year.

    transfer: other countries train, the target's other years fine-tune; direct: other
    countries train; direct_all / all: every country's other years train; target_only:
    only the target's own other years train. The target's held-out year is the test."""
    is_target = F.col(country) == target
    is_test_year = F.col(year) == test_group
    usable = ~is_test_year
    if exclude_years:
        usable = usable & ~F.col(year).isin(list(exclude_years))
    source = ~is_target if sources is None else F.col(country).isin([s for s in sources if s != target])
    # the same condition for every target, so that fits on it are known to be one
    every = F.col(country).isNotNull() if sources is None else source | is_target
    train = {"transfer": source, "direct": source, "direct_all": every, "all": every, "target_only": is_target}[mode]
    roles = {"train": train & usable, "test": is_target & is_test_year}
    if mode == "transfer":
        roles["finetune"] = is_target & usable
    return roles


def train_roles(df: DataFrame, target: str, mode: str, test_group, exclude_years: Sequence[int] = (), role: str = "role", **kw) -> DataFrame:
    """Adds the role of each row; rows without one drop out."""
    conds = role_conditions(mode, target, test_group, exclude_years=exclude_years, **kw)
    expr = None
    for name in ("test", "finetune", "train"):
        if name in conds:
            expr = F.when(conds[name], name) if expr is None else expr.when(conds[name], name)
    return df.withColumn(role, expr).where(F.col(role).isNotNull())
