"""Temporal splits without leakage, nested user samples, and their invariants."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.schema import Invariants
from .cleaning import KEY
from .order import with_before


@dataclass(frozen=True)
class Cutoffs:
    val: int
    test: int

    def __post_init__(self) -> None:
        if self.val >= self.test:
            raise ValueError(f"cutoffs out of order: {self.val} >= {self.test}")


def read_cutoffs(stats: Mapping) -> Cutoffs:
    """Cutoffs frozen by an earlier stage; missing or misordered ones are errors."""
    try:
        found = stats["temporal_cutoffs"]
        return Cutoffs(int(found["T_val_seconds"]), int(found["T_test_seconds"]))
    except KeyError as e:
        raise ValueError(f"no temporal cutoffs: {e} is missing") from None


def choose_cutoffs(log: DataFrame, val_seconds: int, test_seconds: int, min_rows: int) -> Cutoffs:
    """The last ``test_seconds`` are the test window, the ``val_seconds`` before it validation; each needs ``min_rows``."""
    low, high = log.agg(F.min("timestamp"), F.max("timestamp")).first()
    if low is None:
        raise ValueError("an empty log has no cutoffs")
    cut = Cutoffs(high - test_seconds - val_seconds, high - test_seconds)
    if cut.val <= low:
        raise ValueError("the windows leave no time to train on")
    n_val, n_test = log.agg(F.count_if((F.col("timestamp") >= cut.val) & (F.col("timestamp") < cut.test)), F.count_if(F.col("timestamp") >= cut.test)).first()
    if min(n_val, n_test) < min_rows:
        raise ValueError(f"windows of {n_val} and {n_test} rows; {min_rows} are needed")
    return cut


def with_split(log: DataFrame, cut: Cutoffs) -> DataFrame:
    """``log`` with its split: half-open windows, so every row is in one."""
    t = F.col("timestamp")
    return log.withColumn("split", F.when(t < cut.val, "train").when(t < cut.test, "val").otherwise("test"))


def split(log: DataFrame, cut: Cutoffs) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = F.col("timestamp")
    return log.filter(t < cut.val), log.filter((t >= cut.val) & (t < cut.test)), log.filter(t >= cut.test)


def warm(part: DataFrame, train: DataFrame) -> DataFrame:
    """Rows whose user and item both occur in ``train``: one pass, as train itself stays whole."""
    return part.join(train.select("uid").distinct(), "uid", "left_semi").join(train.select("item_id").distinct(), "item_id", "left_semi").select(*part.columns)


def warm_items(part: DataFrame, train: DataFrame) -> DataFrame:
    return part.join(train.select("item_id").distinct(), "item_id", "left_semi").select(*part.columns)


def leaked(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` whose (uid, timestamp, item_id) is in ``b`` too."""
    return a.join(b.select(*KEY).distinct(), list(KEY), "left_semi")


def strangers(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Values of ``column`` in ``a`` that ``b`` lacks."""
    return a.select(column).distinct().join(b.select(column).distinct(), column, "left_anti")


def split_invariants(train: DataFrame, val: DataFrame, test: DataFrame, cut: Cutoffs, before: int | None = None) -> Invariants:
    """What a split must satisfy; ``before`` is the row count of the log before the cold filter took rows from val and test."""
    t = F.col("timestamp")
    checks = (
        Invariants()
        .empty("train before the validation cutoff", train.filter(t >= cut.val))
        .empty("validation within its window", val.filter((t < cut.val) | (t >= cut.test)))
        .empty("test after its cutoff", test.filter(t < cut.test))
        .empty("validation users in train", strangers(val, train, "uid"))
        .empty("validation items in train", strangers(val, train, "item_id"))
        .empty("test users in train", strangers(test, train, "uid"))
        .empty("test items in train", strangers(test, train, "item_id"))
        .empty("no key in train and validation", leaked(val, train))
        .empty("no key in train and test", leaked(test, train))
        .empty("no key in validation and test", leaked(test, val))
        .at_least("train has rows", train)
        .at_least("validation has rows", val)
        .at_least("test has rows", test)
    )
    if before is not None:
        checks.at_most("no more rows than before", [train, val, test], before)
    return checks


def md5_order(seed: int, *columns: str):
    """A reproducible random order: md5 of the seed and the values, the same in any engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]).cast("binary"))


def sample_size(n: int, fraction: float, least: int) -> int:
    """Rounded half to even, at least ``least``; more than there are is an error."""
    size = max(least, round(fraction * n))
    if size > n:
        raise ValueError(f"a sample of {size} from {n}")
    return size


def first_by_key(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows (key, uid) of least key, by a cut-off found digit by digit.

    Each step counts rows by three more hexadecimal digits, at most 4096 counts; only the rows
    that agree with the cut-off in nine digits are sorted.
    """
    spent, prefix, within = 0, "", rows
    for _ in range(3):
        for digits, count in sorted(map(tuple, within.groupBy(F.substring("key", len(prefix) + 1, 3)).count().collect())):
            if spent + count >= n:
                prefix += digits
                break
            spent += count
        within = within.filter(F.col("key").startswith(prefix))
    key, uid = within.orderBy("key", "uid").limit(n - spent).agg(F.max(F.struct("key", "uid"))).first()[0]
    return rows.filter((F.col("key") < key) | ((F.col("key") == key) & (F.col("uid") <= uid)))


def nested_users(users: DataFrame, fractions: tuple[float, float], least: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Two samples of distinct users, the second inside the first: prefixes of one random order.

    The prefixes are cut by the key of their last user, so no list of users is gathered.
    A sample larger than what it is drawn from is an error.
    """
    users = users.select("uid").distinct()
    n = users.count()
    big, small = (sample_size(n, f, least) for f in fractions)
    if small > big:
        raise ValueError(f"a sample of {small} inside one of {big}")
    ordered = users.withColumn("key", md5_order(seed, "uid"))
    return tuple(first_by_key(ordered, k).select("uid") for k in (big, small))


def subsample(train: DataFrame, val: DataFrame, test: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The users' part of each split; validation and test then lose items their train no longer has."""
    mine = lambda df: df.join(users, "uid", "left_semi").select(*df.columns)
    t = mine(train)
    return t, warm_items(mine(val), t), warm_items(mine(test), t)


def sample_invariants(samples: Mapping[str, tuple[DataFrame, DataFrame, DataFrame]], users: Mapping[str, DataFrame], full_train: DataFrame, least: Mapping[str, int]) -> Invariants:
    """Samples, largest first, with their user lists: nested, large enough, and closed under their own train."""
    checks = Invariants()
    names = list(samples)
    for k, name in enumerate(names):
        train, val, test = samples[name]
        outer = users[names[k - 1]] if k else full_train
        checks.empty(f"{name}: users within the next larger set", strangers(users[name], outer, "uid"))
        checks.empty(f"{name}: validation items in train", strangers(val, train, "item_id"))
        checks.empty(f"{name}: test items in train", strangers(test, train, "item_id"))
        checks.empty(f"{name}: validation users in train", strangers(val, train, "uid"))
        checks.empty(f"{name}: no key in train and test", leaked(test, train))
        checks.at_least(f"{name}: enough users", users[name], least[name])
    return checks


def anchors(items: DataFrame, k: int, seed: int, column: str = "item_id") -> DataFrame:
    """``k`` rows without replacement, by random order."""
    return items.withColumn("key", md5_order(seed, column)).orderBy("key", column).limit(k).drop("key")


def weighted_sample(items: DataFrame, weight, k: int, seed: int, column: str = "item_id") -> DataFrame:
    """``k`` rows without replacement with chances by ``weight``: largest ln(u)/weight, u from md5. All rows if there are no more."""
    u = (F.conv(F.substring(md5_order(seed, column), 1, 12), 16, 10).cast("double") + 1) / float(1 << 48)
    return items.withColumn("key", F.log(u) / weight).orderBy(F.col("key").desc(), column).limit(k).drop("key")


def dense_ids(items: DataFrame, column: str = "item_id") -> DataFrame:
    """(dense_id, raw_id): distinct ids numbered from 0 in ascending order, by ranges of equal size."""
    ids = items.select(F.col(column).cast("long").alias("raw_id")).distinct()
    return with_before(ids, ["raw_id"]).select(F.col("before").alias("dense_id"), "raw_id")


def to_dense(rows: DataFrame, id_map: DataFrame, column: str = "item_id") -> DataFrame:
    """``rows`` with dense_id; an id that the map lacks is an error that names some."""
    unknown = [r[0] for r in rows.select(column).distinct().join(id_map, F.col(column) == F.col("raw_id"), "left_anti").limit(10).collect()]
    if unknown:
        raise KeyError(f"ids not in the map: {unknown}")
    return rows.join(id_map, F.col(column) == F.col("raw_id")).drop("raw_id")


def to_raw(rows: DataFrame, id_map: DataFrame) -> DataFrame:
    return rows.join(id_map, "dense_id")


def check_dense(id_map: DataFrame) -> bool:
    """Dense ids are 0..n-1 and ascend with the raw ids."""
    n, distinct, low, high = id_map.agg(F.count(F.lit(1)), F.count_distinct("raw_id"), F.min("dense_id"), F.max("dense_id")).first()
    a, b = id_map.withColumnsRenamed({"dense_id": "i", "raw_id": "x"}), id_map.withColumnsRenamed({"dense_id": "j", "raw_id": "y"})
    falls = a.join(b, F.col("j") == F.col("i") + 1).filter("y <= x")
    return n == distinct and (n == 0 or (low == 0 and high == n - 1)) and falls.isEmpty()


def leak_check(prefix: DataFrame, cutoff: int, name: str = "prefix") -> DataFrame:
    """``prefix`` if all of it is before the cutoff."""
    last = prefix.agg(F.max("timestamp")).first()[0]
    if last is not None and last >= cutoff:
        raise ValueError(f"Data leak: {name} reaches {last}, cutoff {cutoff}")
    return prefix
