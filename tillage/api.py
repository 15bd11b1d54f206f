"""One entry point per reference endpoint: the reports bound to a table source.

``Reports(tables)`` takes any object exposing the marketplace tables as
attributes (``orders``, ``order_items``, ``products`` …), e.g. a
:class:`tillage.sources.fixtures.Catalog` or a namespace of DataFrames read
with :func:`tillage.sources.tables.read_table`. Every method forwards its
keyword parameters (the endpoint's query parameters) to the report function
and returns lazy DataFrames; nothing runs until an action.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tillage.operators.changes import stock_ledger
from tillage.plans import access, admin, catalog, customer, depot, orders, sales, vendor
from tillage.sources.literals import seed_settings


class Reports:
    def __init__(self, tables, settings: DataFrame | None = None):
        self.t = tables
        self._settings = settings

    @property
    def settings(self) -> DataFrame:
        return self._settings if self._settings is not None else seed_settings(self.t.spark)

    # admin ------------------------------------------------------------------------------
    def dashboard(self, **p) -> dict[str, DataFrame]:
        t = self.t
        return {"stats": admin.platform_totals(t.spark, t.customers, t.vendors, t.products, t.orders),
                "recentOrders": admin.recent_orders(t.orders, t.customers, t.users),
                "monthlyRevenue": admin.monthly_revenue(t.orders, **p).drop("month_start")}

    def admin_reports(self, **p) -> dict[str, DataFrame]:
        t = self.t
        return {"monthly": admin.monthly_sales(t.orders, **p), "daily": admin.daily_sales(t.orders),
                "topProducts": admin.top_products(t.order_items, t.products, t.orders),
                "summary": admin.revenue_summary(t.orders)}

    def admin_vendors(self, **p) -> DataFrame:
        return admin.vendor_queue(self.t.vendors, self.t.vendor_documents, **p)

    def admin_orders(self, **p) -> DataFrame:
        t = self.t
        return admin.order_search(t.orders, t.customers, t.users, t.addresses, t.order_items, t.products, **p)

    def admin_customers(self, **p) -> DataFrame:
        return admin.customer_search(self.t.customers, self.t.users, self.t.addresses, **p)

    def admin_inventory(self, **p) -> DataFrame:
        return admin.low_stock(self.t.products, self.t.inventory, **p)

    def admin_offers(self) -> DataFrame:
        return admin.banners_newest(self.t.banners)

    def admin_staff(self) -> DataFrame:
        return admin.staff_users(self.t.users)

    # depots -----------------------------------------------------------------------------
    def cnf_companies(self, **p) -> DataFrame:
        return depot.companies(self.t.cnf_companies, self.t.warehouses, **p)

    def cnf_warehouses(self, **p) -> DataFrame:
        return depot.warehouse_list(self.t.warehouses, self.t.cnf_companies, **p)

    def cnf_stock(self, **p) -> DataFrame:
        t = self.t
        return depot.warehouse_stock(t.warehouse_inventory, t.warehouses, t.cnf_companies, t.products,
                                     t.categories, **p)

    def cnf_orders(self, **p) -> DataFrame:
        t = self.t
        return depot.depot_invoices(t.cnf_orders, t.cnf_companies, t.warehouses, t.supply_items, **p)

    def cnf_fast_moving(self, **p) -> DataFrame:
        t = self.t
        return depot.fast_moving(t.order_items, t.products, t.categories, t.orders, **p)

    def cnf_expiry(self, **p) -> DataFrame:
        t = self.t
        return depot.expiry_report(t.warehouse_inventory, t.warehouses, t.cnf_companies, t.products,
                                   t.categories, **p)

    # catalogue ----------------------------------------------------------------------------
    def products(self, **p) -> DataFrame:
        t = self.t
        with_sales = t.products if "sold_count" in t.products.columns else stock_ledger(t.products, t.stock_movements)
        return catalog.catalogue_search(with_sales, t.categories, t.vendors, t.product_images, **p)

    def product(self) -> DataFrame:
        t = self.t
        return catalog.product_detail(t.products, t.categories, t.vendors, t.product_images, t.reviews,
                                      t.customers, t.users)

    def wishlist(self, **p) -> DataFrame:
        t = self.t
        return catalog.wishlist_view(t.wishlist, t.products, t.vendors, t.brands, t.product_images, **p)

    def categories(self, **p) -> DataFrame:
        return catalog.category_list(self.t.categories, **p)

    def brands(self) -> DataFrame:
        return catalog.active_brands(self.t.brands)

    # customers' orders ----------------------------------------------------------------------
    def orders(self, **p) -> DataFrame:
        return orders.order_history(self.t.orders, self.t.order_items, self.t.products, **p)

    def order(self) -> DataFrame:
        t = self.t
        return orders.order_documents(t.orders, t.order_items, t.products, t.payments, t.addresses)

    def cart(self) -> DataFrame:
        t = self.t
        return orders.cart_totals(t.cart, t.products, t.vendors, t.product_images, self.settings)

    # vendors --------------------------------------------------------------------------------
    def vendors(self) -> DataFrame:
        return vendor.newest_vendors(self.t.vendors)

    def vendor_dashboard(self, variant: str = "corrected") -> dict[str, DataFrame]:
        t = self.t
        with_sales = stock_ledger(t.products, t.stock_movements) if "sold_count" not in t.products.columns \
            else t.products
        return {"stats": vendor.vendor_kpis(t.vendors, t.order_items, t.orders, t.products, t.reviews, variant),
                "recentOrders": vendor.latest_vendor_lines(t.order_items, t.orders, t.products),
                "topProducts": vendor.vendor_top_products(with_sales, t.product_images),
                "monthlyRevenue": vendor.vendor_monthly_revenue(t.order_items, t.orders, t.products)}

    # customers -----------------------------------------------------------------------------
    def customer_profile(self, variant: str = "corrected") -> DataFrame:
        t = self.t
        return customer.customer_360(t.customers, t.users, t.orders, t.wishlist, t.reviews, variant,
                                     wishlist_key="id" if "id" in t.wishlist.columns else "product_id")

    def addresses(self) -> DataFrame:
        return customer.address_book(self.t.addresses)

    # sales force and supply -------------------------------------------------------------------
    def salesmen(self, **p) -> DataFrame:
        return sales.salesmen_list(self.t.salesmen, self.t.vendors, **p)

    def salesman_report(self, date_from: str, date_to: str, variant: str = "corrected", **p) -> dict[str, DataFrame]:
        t = self.t
        filters = {k: v for k, v in p.items() if k in ("salesman_id", "distributor_id")}
        return {"summary": sales.salesman_summary(t.salesman_orders, t.salesmen, t.orders, date_from, date_to,
                                                  variant=variant, **filters),
                "data": sales.salesman_report_rows(t.salesman_orders, t.salesmen, t.orders, t.customers, t.users,
                                                   t.vendors, date_from, date_to, **p)}

    def salesman_orders(self, **p) -> DataFrame:
        t = self.t
        return sales.salesman_order_list(t.salesman_orders, t.salesmen, t.orders, t.customers, t.users,
                                         t.vendors, **p)

    def manufacturers(self) -> DataFrame:
        return sales.active_manufacturers(self.t.manufacturers)

    def manufacturer_orders(self, **p) -> DataFrame:
        t = self.t
        return sales.manufacturer_orders(t.manufacturer_orders, t.manufacturers, t.supply_items, **p)

    # access and settings ------------------------------------------------------------------------
    def permission_users(self, **p) -> DataFrame:
        return access.staff_permissions(self.t.users, self.t.user_permissions, **p)

    def permission_audit(self) -> DataFrame:
        return access.permission_audit(self.t.permission_changes, self.t.users)

    def app_settings(self) -> DataFrame:
        return access.settings_map(self.settings)
