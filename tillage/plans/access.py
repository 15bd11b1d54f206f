"""Staff permissions, permission audit and settings map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.functions.exprs import full_name
from tillage.operators.aggregates import rows_to_map
from tillage.operators.joins import role_join
from tillage.operators.paging import top_k
from tillage.plans.common import Registered
from tillage.sources.fixtures import Catalog, with_fixtures


# R40 ------------------------------------------------------------------------------
def staff_permissions(users: DataFrame, user_permissions: DataFrame, user_id=None) -> DataFrame:
    """Admins and owners, newest first, each with a ``module -> granted`` map (empty when none)."""
    staff = users.where(F.col("role").isin("admin", "owner"))
    if user_id is not None:
        staff = staff.where(F.col("id") == F.lit(user_id))
    staff = staff.select("id", full_name("first_name", "last_name").alias("name"), "role", "is_active",
                         "created_at")
    perms = user_permissions.join(staff.select(F.col("id").alias("user_id")), "user_id", "left_semi")
    maps = rows_to_map(perms, "module", "granted", group=["user_id"], name="permissions")
    j = staff.join(maps, staff.id == maps.user_id, "left").drop("user_id")
    empty = F.create_map().cast("map<string,boolean>")
    return j.withColumn("permissions", F.coalesce(F.col("permissions"), empty)).orderBy(
        F.col("created_at").desc(), F.col("id").desc())


# R41 ------------------------------------------------------------------------------
def permission_audit(audit: DataFrame, users: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` latest permission changes with the names of both users."""
    name = full_name("first_name", "last_name")
    j = role_join(audit, users, "changed_by", "id", {"changed_by_name": name})
    j = role_join(j, users, "target_user", "id", {"target_user_name": name})
    return top_k(j, [F.col("created_at").desc(), F.col("id").desc()], n)


# R42 ------------------------------------------------------------------------------
def settings_map(settings: DataFrame) -> DataFrame:
    """All settings as one ``key -> value`` map (one row)."""
    return rows_to_map(settings, "key", "value", name="settings")


def _r40(c: Catalog, **params) -> DataFrame:
    df = staff_permissions(c.users, c.user_permissions, **params)
    entries = F.transform(F.map_entries("permissions"),
                          lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return df.select("id", "name", "role", "is_active", "created_at",
                     F.size("permissions").cast("bigint").alias("module_count"),
                     F.array_join(F.array_sort(entries), ";").alias("permissions"))


REGISTRY = [
    Registered(
        "r40_staff_permissions",
        _r40,
        with_fixtures("""SELECT u.id, u.first_name || ' ' || u.last_name AS name, u.role, u.is_active, u.created_at,
  (SELECT count(*) FROM fx_user_permissions p WHERE p.user_id=u.id) AS module_count,
  (SELECT coalesce(string_agg(p.module || '=' || CAST(p.granted AS VARCHAR), ';'
     ORDER BY p.module || '=' || CAST(p.granted AS VARCHAR)), '') FROM fx_user_permissions p WHERE p.user_id=u.id)
   AS permissions
FROM fx_users u WHERE u.role IN ('admin','owner')""", "fx_users", "fx_user_permissions")),
    Registered(
        "r40_staff_permissions_one_user",
        lambda c: _r40(c, user_id=11),
        with_fixtures("""SELECT u.id, u.first_name || ' ' || u.last_name AS name, u.role, u.is_active, u.created_at,
  (SELECT count(*) FROM fx_user_permissions p WHERE p.user_id=u.id) AS module_count,
  (SELECT coalesce(string_agg(p.module || '=' || CAST(p.granted AS VARCHAR), ';'
     ORDER BY p.module || '=' || CAST(p.granted AS VARCHAR)), '') FROM fx_user_permissions p WHERE p.user_id=u.id)
   AS permissions
FROM fx_users u WHERE u.role IN ('admin','owner') AND u.id = 11""", "fx_users", "fx_user_permissions")),
    Registered(
        "r41_permission_audit",
        lambda c: permission_audit(c.permission_changes, c.users),
        with_fixtures("""SELECT pa.*, cb.first_name || ' ' || cb.last_name AS changed_by_name,
  tu.first_name || ' ' || tu.last_name AS target_user_name
FROM fx_permission_changes pa JOIN fx_users cb ON pa.changed_by=cb.id JOIN fx_users tu ON pa.target_user=tu.id
ORDER BY pa.created_at DESC, pa.id DESC LIMIT 100""", "fx_permission_changes", "fx_users")),
]
