"""Loading tables with constraints: bad rows are set aside with reasons, the rest load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titlesieve.functions.rules import Rule
from titlesieve.operators.dedup import remove_duplicates
from titlesieve.operators.positions import with_positions
from titlesieve.operators.uniqueness import accept_in_order
from titlesieve.sources.schemas import SEEDED_ROLE, user_rules
from titlesieve.sources.storage import materialise


def check_rows(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """``df`` with ``errors``, the reasons of the rules that each row breaks."""
    reasons = [F.when(rule.broken, rule.reason) for rule in rules]
    return df.withColumn("errors", F.array_compact(F.array(*reasons)))


def _add_error(df: DataFrame, broken: Column, reason: str) -> DataFrame:
    return df.withColumn(
        "errors", F.when(broken, F.array_append("errors", F.lit(reason))).otherwise(F.col("errors"))
    )


def check_unique(
    checked: DataFrame,
    key,
    order: str | Column = "row_id",
    row: str = "row_id",
    candidates: DataFrame | None = None,
) -> DataFrame:
    """Flag rows without other errors whose key an earlier such row has.

    Null keys may repeat. ``row`` is the unique id of a row. The first row of each
    key comes out of a map-side combined aggregation and is matched by its own id,
    so a key that a third of all rows share is never brought together in one task.
    Rows refused by one check do not count as earlier rows in the next. If the checks
    since some earlier state of the table looked at the key alone, that state may be
    given as ``candidates`` and spares working them out twice.
    """
    key = [key] if isinstance(key, str) else list(key)
    complete = (F.size("errors") == 0) & F.forall(
        F.array(*[F.col(name).isNotNull() for name in key]), lambda known: known
    )
    first = (
        (checked if candidates is None else candidates)
        .where(complete)
        .groupBy(*key)
        .agg(F.min_by(row, order).alias(row))
        .select(row, F.lit(True).alias("__first"))
    )
    flagged = _add_error(
        checked.join(first, row, "left"),
        complete & F.col("__first").isNull(),
        f"duplicate {', '.join(key)}",
    )
    return flagged.drop("__first")


def flag_orphans(checked: DataFrame, parents: DataFrame, fk: str, reason: str) -> DataFrame:
    """Flag rows whose ``fk`` is no key of ``parents``. As in SQL, null passes.

    A parent listed twice counts once.
    """
    keys = parents.select(fk).where(F.col(fk).isNotNull()).distinct()
    known = keys.withColumn("__known", F.lit(True))
    flagged = _add_error(
        checked.join(known, fk, "left"), F.col(fk).isNotNull() & F.col("__known").isNull(), reason
    )
    return flagged.drop("__known")


def split_checked(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good, bad)``; the bad rows keep their ``errors``."""
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def validate(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """``(good, bad)`` rows by row rules."""
    return split_checked(check_rows(df, rules))


def orphans(child: DataFrame, parent: DataFrame, fk: str, key: str = "id") -> DataFrame:
    """Child rows whose foreign key is set but names no parent."""
    keys = parent.select(F.col(key).alias(fk))
    return child.where(F.col(fk).isNotNull()).join(keys, fk, "left_anti")


def cascade_delete(child: DataFrame, deleted: DataFrame, fk: str, key: str = "id") -> DataFrame:
    """Child rows left when the parents in ``deleted`` are gone."""
    return child.join(deleted.select(F.col(key).alias(fk)), fk, "left_anti")


def insert_if_absent(target: DataFrame, batch: DataFrame, key: str, order: str = "row_id") -> DataFrame:
    """Rows of ``batch`` to append: the first per key, if ``target`` lacks the key."""
    # Duplicates go first: that cuts a hot key before the shuffle, and the anti join
    # then finds the rows already partitioned by key.
    first = remove_duplicates(batch, key, "first", order)
    return first.join(target.select(key), key, "left_anti").select(*batch.columns)


def assign_ids(rows: DataFrame, target: DataFrame, order: str, name: str = "id") -> DataFrame:
    """``rows`` with ``name`` counting on from the largest id of ``target``, in ``order``.

    ``order`` must have no ties. Ids start at 1 in an empty table or one without ids. The
    rows are numbered by a range sort, which runs when this function is called.
    """
    last = target.agg(F.max(name)).head()[0] if name in target.columns else None
    placed = with_positions(rows.drop(name) if order != name else rows, order, name="__place")
    return placed.withColumn(name, F.col("__place") + ((last or 0) + 1)).drop("__place")


def load_users(target: DataFrame, batch: DataFrame) -> DataFrame:
    """The user batch with ``outcome``: created, exists, or error with its ``errors``.

    ``batch`` has the columns of the users table; ``id`` decides who is first and must
    not repeat. The password column holds hashes already. No display name means the
    username. Rows are taken as if inserted one after the other: a username that is stored
    or was created before makes a row ``exists``; otherwise an invite code that is stored
    or was given to a user created before makes it an error. A refused row takes neither.
    ``new_id`` of created users counts on from the ids in ``target``; it is
    null for all others. Numbering runs when this function is called.
    """
    named = batch.withColumn("display_name", F.coalesce("display_name", "username"))
    checked = check_rows(named, user_rules())
    good, _ = split_checked(checked)
    stored = target.select("username").where(F.col("username").isNotNull()).distinct()
    fresh = good.select("id", "username", "invite_code").join(stored, "username", "left_anti")
    if "invite_code" in target.columns:
        taken = target.select("invite_code").where(F.col("invite_code").isNotNull()).distinct()
        fresh = fresh.join(taken, "invite_code", "left_anti")
    accepted = materialise(accept_in_order(fresh, ["username", "invite_code"], "id"), "new-users")
    numbered = assign_ids(accepted.select(F.col("id").alias("__row")), target, "__row").select(
        F.col("__row").alias("id"), F.col("id").alias("new_id")
    )
    before = accepted.select("username", F.col("id").alias("__first")).unionByName(
        stored.select("username", F.lit(None).cast(batch.schema["id"].dataType).alias("__first"))
    )
    marked = checked.join(numbered, "id", "left").join(
        before.withColumn("__named", F.lit(True)), "username", "left"
    )
    known = F.coalesce(F.col("__named"), F.lit(False))
    exists = known & (F.col("__first").isNull() | (F.col("__first") < F.col("id")))
    outcome = (
        F.when(F.size("errors") > 0, "error")
        .when(F.col("new_id").isNotNull(), "created")
        .when(exists, "exists")
        .otherwise("error")
    )
    decided = _add_error(
        marked.withColumn("outcome", outcome),
        (F.col("outcome") == "error") & (F.size("errors") == 0),
        "duplicate invite_code",
    )
    return decided.select(*checked.columns, "new_id", "outcome")


def user_load_report(loaded: DataFrame) -> DataFrame:
    """One row: created, skipped."""
    new = F.col("outcome") == "created"
    return loaded.agg(F.count_if(new).alias("created"), F.count_if(~new).alias("skipped"))


def seed_progress(new_users: DataFrame, progress: DataFrame) -> DataFrame:
    """Zero progress rows for new users of the seeded role that have none.

    ``new_users`` is what :func:`load_users` created; the rows are for their ``new_id``.
    """
    seeded = new_users.where(F.col("role") == SEEDED_ROLE).select(F.col("new_id").alias("user_id"))
    zero = F.lit(0)
    return seeded.join(progress.select("user_id"), "user_id", "left_anti").select(
        "user_id",
        zero.alias("current_paper_index"),
        zero.alias("total_kept"),
        zero.alias("total_rejected"),
    )
