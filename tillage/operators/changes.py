"""Dataset changes as set-based batch jobs.

Each job takes the current table and a change set and returns the new table
(or a report). "Latest change wins" is an aggregate (``max_by`` over the
change order), which combines map-side, so a key that receives a third of
all changes still costs one partial row per task. Jobs that need an
ordered walk through a key's events (M10, M11) use the time-segmented scan
of :mod:`tillage.operators.sequences`, so a hot key is not one task either.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillage.functions.exprs import module_key
from tillage.operators.joins import update_from
from tillage.operators.sequences import prior_values
from tillage.session import cut_lineage


def _latest(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    payload = F.struct(*[F.col(c) for c in cols])
    ordering = F.struct(*[F.col(c) for c in order])
    picked = df.groupBy(*keys).agg(F.max_by(payload, ordering).alias("__v"))
    return picked.select(*keys, *[F.col(f"__v.{c}").alias(c) for c in cols])


# M1 ------------------------------------------------------------------------------------
def upsert(cur: DataFrame, chg: DataFrame, keys: list[str], update_cols: list[str],
           order: list[str]) -> DataFrame:
    """``INSERT … ON CONFLICT (keys) DO UPDATE SET update_cols`` for a batch of changes.

    The last change per key (by ``order``) wins. On conflict only
    ``update_cols`` change; other columns keep the stored value (e.g. a stock
    upsert leaves ``expiry_date`` alone). New keys are inserted with the
    change's values (NULL for columns the change lacks).
    """
    value_cols = [c for c in cur.columns if c not in keys]
    carried = [c for c in value_cols if c in chg.columns]
    latest = _latest(chg, keys, order, carried).withColumn("__in_chg", F.lit(True))
    latest = latest.select(*keys, "__in_chg", *[F.col(c).alias(f"__new_{c}") for c in carried])
    old = cur.withColumn("__in_cur", F.lit(True))
    j = old.join(latest, keys, "full")
    out = []
    for c in value_cols:
        new = F.col(f"__new_{c}") if c in carried else F.lit(None).cast(cur.schema[c].dataType)
        if c in update_cols:
            val = F.when(F.col("__in_chg").isNotNull(), new).otherwise(F.col(c))
        else:
            val = F.when(F.col("__in_cur").isNotNull(), F.col(c)).otherwise(new)
        out.append(val.cast(cur.schema[c].dataType).alias(c))
    return j.select(*keys, *out)


# M2 ------------------------------------------------------------------------------------
def insert_ignore(cur: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """``INSERT … ON CONFLICT DO NOTHING``: the first new row per key, only for absent keys."""
    cols = [c for c in cur.columns if c not in keys and c in new.columns]
    if order:
        firsts = new.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in cols]),
                                                 F.struct(*[F.col(c) for c in order])).alias("__v"))
        firsts = firsts.select(*keys, *[F.col(f"__v.{c}").alias(c) for c in cols])
    else:
        firsts = new.select(*keys, *cols).dropDuplicates(keys)
    fresh = firsts.join(cur.select(*keys), keys, "left_anti")
    return cur.unionByName(fresh, allowMissingColumns=True)


# M3 ------------------------------------------------------------------------------------
def backfill(cur: DataFrame, col: str, value: Column) -> DataFrame:
    """``UPDATE t SET col = value WHERE col IS NULL``."""
    src = F.col(col) if col in cur.columns else F.lit(None)
    return cur.withColumn(col, F.coalesce(src, value))


def backfill_from(cur: DataFrame, lookup: DataFrame, key: str, lookup_key: str,
                  columns: dict[str, str]) -> DataFrame:
    """``UPDATE t SET col = l.src FROM l WHERE t.key = l.key AND t.col IS NULL``."""
    return update_from(cur, lookup, key, lookup_key, columns, only_null=True)


# M4 ------------------------------------------------------------------------------------
def add_missing_dependents(parent: DataFrame, child: DataFrame, parent_key: str, child_fk: str,
                           values: dict[str, Column]) -> DataFrame:
    """Insert a child row for every parent that has none (``NOT EXISTS`` back-fill)."""
    lonely = parent.join(child.select(F.col(child_fk).alias(parent_key)), parent_key, "left_anti")
    new_rows = lonely.select(F.col(parent_key).alias(child_fk), *[v.alias(k) for k, v in values.items()])
    return child.unionByName(new_rows, allowMissingColumns=True)


# M5 ------------------------------------------------------------------------------------
PATCH_MODES = ("exists", "isset", "nonempty")


def _writes(value: Column, field: str, mode: str, kind: T.DataType) -> Column:
    sent = F.array_contains(F.col("present"), F.lit(field))
    if mode == "exists":       # array_key_exists: an explicit NULL is written
        return sent
    if mode == "isset":        # isset: NULL is skipped
        return sent & value.isNotNull()
    # !empty by type: NULL; '' and '0' of texts; zero of numbers. Flags are tested with isset, so FALSE is written.
    if isinstance(kind, T.BooleanType):
        return sent & value.isNotNull()
    if isinstance(kind, T.NumericType):
        return sent & value.isNotNull() & (value != F.lit(0))
    return sent & value.isNotNull() & ~value.cast("string").isin("", "0")


def sparse_patch(cur: DataFrame, patches: DataFrame, key: str, fields: list[str], order: list[str],
                 mode: str = "exists") -> DataFrame:
    """Apply partial updates: each patch row names the fields it sent in ``present``.

    For every field, the latest patch (by ``order``) that writes the field
    under ``mode`` wins; fields no patch writes keep their value. Patches for
    unknown keys are ignored (``UPDATE … WHERE id = ?`` touches nothing).
    """
    if mode not in PATCH_MODES:
        raise ValueError(f"mode must be one of {PATCH_MODES}")
    ordering = F.struct(*[F.col(c) for c in order])
    aggs = []
    for f in fields:
        w = _writes(F.col(f), f, mode, patches.schema[f].dataType)
        aggs.append(F.max_by(F.struct(F.col(f).alias("v")), F.when(w, ordering)).alias(f"__p_{f}"))
    latest = patches.groupBy(F.col(key).alias("__pk")).agg(*aggs)
    j = cur.join(latest, cur[key] == latest["__pk"], "left")
    for f in fields:
        hit = F.col(f"__p_{f}").isNotNull()
        j = j.withColumn(f, F.when(hit, F.col(f"__p_{f}.v")).otherwise(F.col(f)).cast(cur.schema[f].dataType))
    return j.select(*cur.columns)


# M6 ------------------------------------------------------------------------------------
def soft_delete(cur: DataFrame, keys: DataFrame, key: str, flag: str = "is_active",
                owner: str | None = None) -> DataFrame:
    """Flag rows inactive by key (``UPDATE … SET is_active = FALSE WHERE id = ?``).

    With ``owner`` (e.g. ``vendor_id``) a delete request applies only when it
    names the row's owner (``… AND vendor_id = ?``): ``keys`` then carries
    both columns.
    """
    cols = [key] + ([owner] if owner else [])
    marks = keys.select(*[F.col(c).alias(f"__d_{c}") for c in cols]).distinct().withColumn("__del", F.lit(True))
    cond = cur[key] == marks[f"__d_{key}"]
    if owner:
        cond = cond & (cur[owner] == marks[f"__d_{owner}"])
    j = cur.join(marks, cond, "left")
    return j.withColumn(flag, F.when(F.col("__del"), F.lit(False)).otherwise(F.col(flag))).select(*cur.columns)


# M7 ------------------------------------------------------------------------------------
def erase_customers(requested: DataFrame, blockers: dict[str, DataFrame], dependents: dict[str, DataFrame]) -> DataFrame:
    """Erasure report per requested customer id (column ``customer_id``).

    ``blockers`` are the tables that reference customers without ON DELETE
    CASCADE (orders, reviews, coupon usage): a customer with a row in any of
    them cannot be deleted, so the whole erasure is refused for them (the
    reference's transaction fails). For the others every ``dependents`` row
    (cart, wishlist, addresses: cascading tables) goes. The report counts the
    rows each dependent table loses; :func:`erase_apply` produces the new tables.
    """
    req = requested.select("customer_id").distinct()
    rep = req
    for name, df in blockers.items():
        hit = df.select("customer_id").distinct().withColumn(f"__b_{name}", F.lit(True))
        rep = rep.join(hit, "customer_id", "left")
    blocked = [F.coalesce(F.col(f"__b_{n}"), F.lit(False)) for n in blockers]
    rep = rep.withColumn("blocked", reduce(lambda a, b: a | b, blocked) if blocked else F.lit(False))
    rep = rep.drop(*[f"__b_{n}" for n in blockers])
    for name, df in dependents.items():
        cnt = df.groupBy("customer_id").agg(F.count(F.lit(1)).alias(f"{name}_rows"))
        rep = rep.join(cnt, "customer_id", "left").withColumn(
            f"{name}_rows", F.coalesce(F.col(f"{name}_rows"), F.lit(0)).cast("bigint"))
    removed = [F.when(F.col("blocked"), F.lit(0)).otherwise(F.col(f"{n}_rows")) for n in dependents]
    return rep.withColumn("rows_removed", reduce(lambda a, b: a + b, removed).cast("bigint"))


def erase_apply(table: DataFrame, report: DataFrame, fk: str = "customer_id") -> DataFrame:
    gone = report.where(~F.col("blocked")).select(F.col("customer_id").alias(fk))
    return table.join(gone, fk, "left_anti")


# M9 ------------------------------------------------------------------------------------
def stock_ledger(products: DataFrame, movements: DataFrame) -> DataFrame:
    """Net stock and units sold per product from signed movements.

    ``order`` rows carry ``-qty``, ``cancel`` and ``restock`` rows ``+qty``.
    A cancel restores stock but not ``sold_count``. Each movement counts once
    (the reference's trigger applied the inventory change twice).
    """
    net = movements.groupBy("product_id").agg(
        F.sum("delta").alias("__net"),
        F.sum(F.when(F.col("kind") == "order", -F.col("delta")).otherwise(F.lit(0))).alias("__sold"))
    j = products.join(net.withColumnRenamed("product_id", "__mp"), products.id == F.col("__mp"), "left")
    base_sold = F.col("sold_count") if "sold_count" in products.columns else F.lit(0)
    return (j.withColumn("stock_qty", (F.col("stock_qty") + F.coalesce(F.col("__net"), F.lit(0))).cast("bigint"))
            .withColumn("sold_count", (base_sold + F.coalesce(F.col("__sold"), F.lit(0))).cast("bigint"))
            .drop("__mp", "__net", "__sold"))


# M10 -----------------------------------------------------------------------------------
# Order statuses of the schema.
ADMIN_STATUSES = ("confirmed", "packed", "shipped", "out_for_delivery", "delivered", "cancelled")
CANCELLABLE_FROM = ("placed", "confirmed")


def apply_status_events(orders: DataFrame, events: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    """Walk each order's status events in time order and keep the valid ones.

    Admin events set any allowed status (``delivered`` also marks the order
    paid). A customer may only cancel (``actor = 'customer'``; without an
    ``actor`` column every ``cancelled`` event is a customer cancel), and
    only from ``placed`` / ``confirmed``. Returns one row per order with the
    final status, payment status and accepted / rejected event counts.

    The walk needs two facts per event, both "latest earlier value" scans
    (:func:`tillage.operators.sequences.prior_values`, spread over time
    segments so a hot order is not one task): the status set by the latest
    earlier accepted admin event (else the order's stored status), and
    whether the latest earlier admin-or-cancel event was a cancel (then the
    order is already cancelled, or the first cancel was refused and this one
    is refused for the same reason).
    """
    ev = events
    if "actor" not in ev.columns:
        ev = ev.withColumn("actor", F.when(F.col("status") == "cancelled", "customer").otherwise("admin"))
    ev = ev.join(orders.select(F.col("id").alias("order_id"), F.col("order_status").alias("__init")),
                 "order_id")
    admin_ok = (F.col("actor") == "admin") & F.col("status").isin(*ADMIN_STATUSES)
    is_cancel = (F.col("actor") == "customer") & (F.col("status") == "cancelled")
    ev = ev.withColumn("__admin_ok", admin_ok).withColumn("__cancel", is_cancel)
    ev = prior_values(ev, ["order_id"], ["created_at", "id"], {
        "__anchor": F.when(F.col("__admin_ok"), F.col("status")),
        "__prev_kind": F.when(F.col("__admin_ok"), F.lit("A")).when(F.col("__cancel"), F.lit("C")),
    }, bucket_seconds=bucket_seconds)
    anchor = F.coalesce(F.col("__anchor"), F.col("__init"))
    first_in_run = F.coalesce(F.col("__prev_kind"), F.lit("A")) == "A"
    cancel_ok = F.col("__cancel") & first_in_run & anchor.isin(*CANCELLABLE_FROM)
    ev = ev.withColumn("accepted", F.col("__admin_ok") | cancel_ok)
    ordering = F.struct("created_at", "id")
    per = ev.groupBy("order_id").agg(
        F.max_by(F.when(F.col("accepted"), F.col("status")), F.when(F.col("accepted"), ordering)).alias("__last"),
        F.max(F.col("accepted") & (F.col("status") == "delivered")).alias("__paid"),
        F.count_if(F.col("accepted")).alias("accepted_events"),
        F.count_if(~F.col("accepted")).alias("rejected_events"))
    j = orders.join(per.withColumnRenamed("order_id", "__eo"), orders.id == F.col("__eo"), "left")
    return j.select(
        "id",
        F.coalesce(F.col("__last"), F.col("order_status")).alias("order_status"),
        F.when(F.col("__paid"), F.lit("paid")).otherwise(F.col("payment_status")).alias("payment_status"),
        F.coalesce(F.col("accepted_events"), F.lit(0)).cast("bigint").alias("accepted_events"),
        F.coalesce(F.col("rejected_events"), F.lit(0)).cast("bigint").alias("rejected_events"))


def apply_vendor_decisions(vendors: DataFrame, decisions: DataFrame, code_prefix: str = "VND-") -> DataFrame:
    """Approve / reject decisions per vendor (``vendor_id, action, created_at, id``).

    A reject is always applied. An approve applies only to a ``pending``
    vendor, so only the first approve can apply and only if no reject came
    before it; an applied approve also sets ``vendor_code`` (prefix + first 8
    characters of the id, upper case). Everything is a per-vendor aggregate
    (first / last decision), so no window or sort per vendor is needed.
    """
    order = F.struct("created_at", "id")
    per = decisions.groupBy("vendor_id").agg(
        F.min(F.when(F.col("action") == "approve", order)).alias("__first_ok"),
        F.min(F.when(F.col("action") == "reject", order)).alias("__first_no"),
        F.max(F.when(F.col("action") == "reject", order)).alias("__last_no"),
        F.count_if(F.col("action") == "approve").alias("__n_ok"),
        F.count_if(F.col("action") == "reject").alias("__n_no"),
        F.count_if(~F.col("action").isin("approve", "reject")).alias("__n_bad"))
    j = vendors.join(per.withColumnRenamed("vendor_id", "__vid"), vendors.id == F.col("__vid"), "left")
    ok_applies = (F.col("status") == "pending") & F.col("__first_ok").isNotNull() & \
        (F.col("__first_no").isNull() | (F.col("__first_ok") < F.col("__first_no")))
    approved_last = ok_applies & (F.col("__last_no").isNull() | (F.col("__first_ok") > F.col("__last_no")))
    status = (F.when(approved_last, F.lit("approved"))
              .when(F.col("__last_no").isNotNull(), F.lit("rejected")).otherwise(F.col("status")))
    code = F.concat(F.lit(code_prefix), F.upper(F.substring(F.col("id").cast("string"), 1, 8)))
    applied = F.coalesce(F.col("__n_no"), F.lit(0)) + F.when(ok_applies, 1).otherwise(0)
    total = F.coalesce(F.col("__n_ok") + F.col("__n_no") + F.col("__n_bad"), F.lit(0))
    return j.select(*[F.col(c) for c in vendors.columns if c not in ("status", "vendor_code")],
                    status.alias("status"),
                    F.when(ok_applies, code).otherwise(
                        F.col("vendor_code") if "vendor_code" in vendors.columns else F.lit(None).cast("string"))
                    .alias("vendor_code"),
                    applied.cast("bigint").alias("applied_decisions"),
                    (total - applied).cast("bigint").alias("refused_decisions"))


# Supply order statuses of the schema.
SUPPLY_STATUSES = ("pending", "confirmed", "dispatched", "delivered", "cancelled")


def apply_supply_status(orders: DataFrame, updates: DataFrame, allowed: tuple[str, ...] = SUPPLY_STATUSES) -> DataFrame:
    """Manufacturer / depot order status updates: any allowed status may follow any
    other, so the result is the latest allowed update (a ``max_by`` aggregate)."""
    ok = updates.where(F.col("status").isin(*allowed))
    last = ok.groupBy(F.col("order_id").alias("__oid")).agg(
        F.max_by("status", F.struct("created_at", "id")).alias("__new"))
    j = orders.join(last, orders.id == last.__oid, "left")
    return j.withColumn("status", F.coalesce(F.col("__new"), F.col("status"))).select(*orders.columns)


# M11 -----------------------------------------------------------------------------------
def permission_log(changes: DataFrame, current: DataFrame | None = None,
                   bucket_seconds: int = 86_400) -> DataFrame:
    """Audit rows with the value before and after each permission change.

    The module key is sanitised first; the old value is the previous change
    of the same (user, module) in time order (a skew-safe "latest earlier
    value" scan), else the stored permission, else NULL.
    """
    ch = changes.withColumn("module", module_key("module"))
    ch = prior_values(ch, ["target_user", "module"], ["created_at", "id"],
                      {"__prev": F.struct(F.col("new_value").alias("v"))}, bucket_seconds=bucket_seconds)
    prev = F.when(F.col("__prev").isNotNull(), F.col("__prev.v"))
    if current is not None:
        cur = current.select(F.col("user_id").alias("target_user"), module_key("module").alias("module"),
                             F.col("granted").alias("__stored"))
        ch = ch.join(cur, ["target_user", "module"], "left")
        prev = F.when(F.col("__prev").isNotNull(), F.col("__prev.v")).otherwise(F.col("__stored"))
    as_text = lambda c: F.when(c.isNull(), F.lit(None).cast("string")).when(c, "TRUE").otherwise("FALSE")
    return ch.select("id", "changed_by", "target_user", "module", as_text(prev).alias("old_value"),
                     as_text(F.col("new_value")).alias("new_value"), "created_at")


# M14 -----------------------------------------------------------------------------------
def split_duplicates(incoming: DataFrame, cur: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Tag each incoming row ``accepted`` or with the reason it is refused.

    Refused: the key already exists in ``cur``, or an earlier row of the same
    batch (by ``order``) has it.
    """
    first = incoming.groupBy(*keys).agg(F.min(F.struct(*[F.col(c) for c in order])).alias("__first"))
    existing = cur.select(*keys).distinct().withColumn("__exists", F.lit(True))
    j = incoming.join(first, keys, "left").join(existing, keys, "left")
    me = F.struct(*[F.col(c) for c in order])
    decision = (F.when(F.col("__exists"), "exists")
                .when(me != F.col("__first"), "duplicate_in_batch").otherwise("accepted"))
    return j.withColumn("decision", decision).drop("__first", "__exists")


# M16 -----------------------------------------------------------------------------------
def clamp_cart(cart: DataFrame, products: DataFrame) -> DataFrame:
    """Cart quantity clamped to 1..stock of an active product (``max(1, min(q, stock))``; a NULL quantity gives 1)."""
    pr = products.where(F.col("is_active")).select(F.col("id").alias("product_id"), "stock_qty")
    j = cart.join(pr, "product_id")
    return j.withColumn("quantity", F.greatest(F.lit(1), F.least(F.coalesce(F.col("quantity"), F.lit(0)), F.col("stock_qty")))
                        .cast("int")).drop("stock_qty")


# Chained batches -------------------------------------------------------------------------
def apply_batches(cur: DataFrame, batches: Iterable[DataFrame], step: Callable[[DataFrame, DataFrame], DataFrame],
                  checkpoint_every: int = 4) -> DataFrame:
    """Apply change batches in order, cutting lineage into the shared checkpoint
    folder every ``checkpoint_every`` batches so recovery never replays them all."""
    out = cur
    for i, b in enumerate(batches, 1):
        out = step(out, b)
        if checkpoint_every and i % checkpoint_every == 0:
            out = cut_lineage(out)
    return out
