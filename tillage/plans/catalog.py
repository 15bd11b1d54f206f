"""Catalogue reports: product search, product detail, wishlist, categories, brands
(R20, R21, R25, R26, R27)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.functions.exprs import URL_PATTERN, full_name, looks_like_url
from tillage.functions.text import ENGLISH_STOP_WORDS
from tillage.operators import filters as flt
from tillage.operators.changes import stock_ledger
from tillage.operators.joins import child_array, primary_image, scalar, with_parent
from tillage.operators.paging import clamp_page, page, top_n_per_key, whitelisted_sort
from tillage.operators.paging import page_meta
from tillage.operators.search import stem_matches
from tillage.plans.common import Registered, digest
from tillage.plans.stem_sql import stem_sql
from tillage.sources.json_io import page_envelope, pg_text
from tillage.sources.fixtures import Catalog, with_fixtures

CATALOGUE_SORTS = {"selling_price": "selling_price", "avg_rating": "avg_rating",
                   "sold_count": "sold_count", "created_at": "created_at"}


def _with_category_names(products: DataFrame, categories: DataFrame) -> DataFrame:
    """p LEFT JOIN categories c (subcategory) LEFT JOIN categories pc (its parent)."""
    c = categories.select(F.col("id").alias("__c"), F.col("name").alias("subcategory_name"),
                          F.col("parent_id").alias("__parent"))
    pc = categories.select(F.col("id").alias("__pc"), F.col("name").alias("category_name"))
    j = products.join(c, products.category_id == c.__c, "left")
    return j.join(pc, F.col("__parent") == F.col("__pc"), "left").drop("__c", "__pc")


# R20 -----------------------------------------------------------------------------
def catalogue_matches(products: DataFrame, categories: DataFrame, category_id=None, vendor_id=None,
                      search: str = "", min_price=None, max_price=None, on_offer=None) -> DataFrame:
    """Active products passing up to six optional predicates, with category names; the search is over stemmed words."""
    active = products.where(F.col("is_active"))
    if flt.php_truthy(search):
        desc = F.coalesce(F.col("description"), F.lit("")) if "description" in products.columns else F.lit("")
        active = active.join(stem_matches(active, "id", F.concat(F.col("name"), F.lit(" "), desc), search), "id", "left_semi")
    j = _with_category_names(active, categories)
    preds = [flt.optional(category_id, lambda v: flt.category_or_parent("category_id", "__parent", v)),
             flt.optional(vendor_id, lambda v: F.col("vendor_id") == F.lit(v)),
             flt.price_range("selling_price", min_price, max_price),
             flt.less_than("selling_price", "mrp") if flt.php_truthy(on_offer) else None]
    return flt.where_all(j, preds)


def catalogue_search(products: DataFrame, categories: DataFrame, vendors: DataFrame, images: DataFrame,
                     category_id=None, vendor_id=None, search: str = "", min_price=None, max_price=None,
                     on_offer=None, sort: str = "sold_count", order: str = "desc", page_no=1,
                     limit=20) -> DataFrame:
    """Active products matching up to six optional predicates, sorted, one page, with ``total``."""
    p, lim = clamp_page(page_no, limit, 50)
    j = catalogue_matches(products, categories, category_id, vendor_id, search, min_price, max_price, on_offer)
    total = scalar(j.agg(F.count(F.lit(1))))
    key = sort if sort in CATALOGUE_SORTS else "sold_count"
    if CATALOGUE_SORTS[key] not in j.columns:
        raise ValueError(f"sort column {CATALOGUE_SORTS[key]!r} is not in the products table")
    sort_col = whitelisted_sort(key, "asc" if order == "asc" else "desc", CATALOGUE_SORTS, "sold_count")
    chosen = page(j, [sort_col, F.col("id").asc()], p, lim)
    v = vendors.select(F.col("id").alias("__v"), F.col("business_name").alias("vendor_name"))
    img = primary_image(images).select(F.col("product_id").alias("__img"), F.col("image_url").alias("primary_image"))
    out = (chosen.join(v, chosen.vendor_id == v.__v, "left")
           .join(img, F.col("id") == F.col("__img"), "left"))
    # The joins lose the page's order; a page is 50 rows at most.
    out = out.orderBy(sort_col, F.col("id").asc())
    extra = [c for c in ("slug", "avg_rating", "review_count", "sold_count", "is_featured", "product_code") if c in products.columns]
    return out.select("id", "name", "mrp", "selling_price", "stock_qty", "unit", "sku", "category_name",
                      "subcategory_name", "vendor_name", "primary_image", *extra, total.alias("total"))


# R21 -----------------------------------------------------------------------------
def product_detail(products: DataFrame, categories: DataFrame, vendors: DataFrame, images: DataFrame,
                   reviews: DataFrame, customers: DataFrame, users: DataFrame, review_limit: int = 10) -> DataFrame:
    """Every active product with category names, vendor, images[] and its latest approved reviews[]."""
    j = _with_category_names(products.where(F.col("is_active")), categories).drop("__parent")
    j = j.withColumn("parent_category_name", F.col("category_name"))
    verified = [F.col("is_verified").alias("vendor_verified")] if "is_verified" in vendors.columns else []
    v = vendors.select(F.col("id").alias("__v"), F.col("business_name").alias("vendor_name"), *verified)
    j = j.join(v, j.vendor_id == v.__v, "left").drop("__v")
    j = child_array(j, images, "id", "product_id", ["id", "image_url", "sort_order", "is_primary"], "images",
                    sort_by=["sort_order", "id"])
    cu = customers.select(F.col("id").alias("customer_id"), F.col("user_id").alias("__uid"))
    u = users.select(F.col("id").alias("__uid"), full_name("first_name", "last_name").alias("customer_name"))
    approved = (reviews.where(F.col("is_approved")).join(cu, "customer_id").join(u, "__uid")
                .select("product_id", "id", "rating", "created_at", "customer_name"))
    latest = top_n_per_key(approved, ["product_id"], [F.col("created_at").desc(), F.col("id").desc()],
                           review_limit)
    return child_array(j, latest, "id", "product_id", ["rating", "created_at", "customer_name", "id"],
                       "reviews", sort_by=["created_at", "id"], newest_first=True)


# R25 -----------------------------------------------------------------------------
def wishlist_view(wishlist: DataFrame, products: DataFrame, vendors: DataFrame, brands: DataFrame,
                  images: DataFrame, brand_on: tuple[str, str] = ("brand_id", "id")) -> DataFrame:
    """Wishlist rows of every customer with product, vendor, brand and primary image, newest first.

    Products without the brand column have no brand; the wishlist's own id is carried where it has one."""
    brand = F.col(brand_on[0]) if brand_on[0] in products.columns else F.lit(None).cast(brands.schema[brand_on[1]].dataType)
    pr = products.where(F.col("is_active")).select(
        F.col("id").alias("product_id"), "name", "selling_price", "mrp", "stock_qty", "vendor_id",
        brand.alias("__bkey"))
    v = vendors.select(F.col("id").alias("vendor_id"), F.col("business_name").alias("vendor_name"))
    b = brands.select(F.col(brand_on[1]).alias("__bkey"), F.col("name").alias("brand_name"))
    img = primary_image(images).withColumnRenamed("image_url", "image")
    j = (wishlist.join(pr, "product_id").join(v, "vendor_id").join(b, "__bkey", "left")
         .join(img, "product_id", "left"))
    own = [c for c in ("id",) if c in wishlist.columns]
    return (j.select(*own, "customer_id", "created_at", "product_id", "name", "selling_price", "mrp", "stock_qty",
                     "image", "vendor_name", "brand_name")
            .orderBy("customer_id", F.col("created_at").desc(), "product_id"))


# R26, R27 --------------------------------------------------------------------------
def category_list(categories: DataFrame, parent_only: bool = False) -> DataFrame:
    active = categories.where(F.col("is_active")) if "is_active" in categories.columns else categories
    shown = [c for c in ("slug", "icon", "image_url", "is_featured") if c in categories.columns]
    if parent_only:
        return active.where(F.col("parent_id").isNull()).select("id", "name", *shown, "sort_order").orderBy("sort_order", "id")
    return (with_parent(active, categories, "parent_id", {"name": "parent_name"})
            .select("id", "name", *shown, "sort_order", "parent_id", "parent_name").orderBy("sort_order", "id"))


def image_slots(images: DataFrame, slots: int = 8) -> DataFrame:
    """Each product's first ``slots`` images (by sort_order, id) with their
    position; position 0 is the primary image; entries whose URL is not valid
    are skipped without renumbering the others (the upload rule)."""
    ranked = top_n_per_key(images, ["product_id"], [F.col("sort_order").asc(), F.col("id").asc()], slots,
                           rank_col="__rn")
    return (ranked.where(looks_like_url("image_url"))
            .select("product_id", (F.col("__rn") - 1).cast("bigint").alias("pos"), "image_url",
                    (F.col("__rn") == 1).alias("is_primary")))


def active_brands(brands: DataFrame) -> DataFrame:
    shown = [c for c in ("logo_url", "description") if c in brands.columns]
    return brands.where(F.col("is_active")).select("id", "name", "slug", *shown).orderBy("name", "id")


# ---------------------------------------------------------------------------------------
STOP = ",".join(f"'{w}'" for w in ENGLISH_STOP_WORDS)


def sql_lexemes(expr: str) -> str:
    return (f"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({expr}, '')), '[^\\p{{L}}\\p{{N}}]+'), "
            f"lambda w: length(w) > 0 AND NOT list_contains([{STOP}], w)))")


def sql_has_stem(expr: str, table: str, stem: str) -> str:
    """Whether the text ``expr`` over a row ``p`` of ``table`` has a word of that stem."""
    words = stem_sql(f"SELECT unnest({sql_lexemes(expr)}) AS word FROM {table} p")
    return f"list_has_any({sql_lexemes(expr)}, (SELECT list(word) FROM {words} WHERE stem = '{stem}'))"


IMG_SQL = ("(SELECT image_url FROM fx_product_images i WHERE i.product_id={pid} AND i.is_primary "
           "ORDER BY i.sort_order, i.id LIMIT 1)")


R20_PARAMS = dict(category_id=2, search="red", sort="selling_price", order="asc", page_no=1, limit=20)
R20_COLS = ["id", "name", "mrp", "selling_price", "stock_qty", "unit", "sku", "category_name", "subcategory_name",
            "vendor_name", "primary_image"]


def _s5(c: Catalog) -> DataFrame:
    """The catalogue page as the endpoint's JSON document ``{success, data, meta}``."""
    pg = catalogue_search(c.products, c.categories, c.vendors, c.product_images, **R20_PARAMS)
    filters = {k: R20_PARAMS[k] for k in ("category_id", "search")}
    total = catalogue_matches(c.products, c.categories, **filters).agg(F.count(F.lit(1)).alias("total"))
    meta = page_meta(total, R20_PARAMS["page_no"], R20_PARAMS["limit"])
    return page_envelope(pg_text(pg.select(*R20_COLS)), meta, [F.col("selling_price").cast("decimal(10,2)"),
                                                               F.col("id")])


def _r21(c: Catalog) -> DataFrame:
    df = product_detail(c.products, c.categories, c.vendors, c.product_images, c.reviews, c.customers, c.users)
    return df.select("id", "name", "sku", "vendor_id", "category_id", "mrp", "selling_price", "stock_qty",
                     "unit", "category_name", "subcategory_name", "parent_category_name", "vendor_name",
                     F.size("images").cast("bigint").alias("image_count"),
                     digest("images", ["sort_order", "id", "image_url", "is_primary"]).alias("images"),
                     F.size("reviews").cast("bigint").alias("review_count"),
                     digest("reviews", ["created_at", "id", "rating", "customer_name"]).alias("reviews"))


REGISTRY = [
    Registered(
        "r20_catalogue_search",
        lambda c: catalogue_search(c.products, c.categories, c.vendors, c.product_images, **R20_PARAMS),
        with_fixtures(f"""WITH j AS (
  SELECT p.*, pc.name AS category_name, c.name AS subcategory_name
  FROM fx_products p LEFT JOIN fx_categories c ON p.category_id=c.id
  LEFT JOIN fx_categories pc ON c.parent_id=pc.id
  WHERE p.is_active AND (p.category_id=2 OR c.parent_id=2)
    AND {sql_has_stem("p.name || ' ' || ''", "fx_products", "red")})
SELECT j.id, j.name, j.mrp, j.selling_price, j.stock_qty, j.unit, j.sku, j.category_name, j.subcategory_name,
  v.business_name AS vendor_name, {IMG_SQL.format(pid='j.id')} AS primary_image,
  (SELECT count(*) FROM j) AS total
FROM j LEFT JOIN fx_vendors v ON j.vendor_id=v.id ORDER BY j.selling_price ASC NULLS LAST, j.id LIMIT 20""",
                      "fx_products", "fx_categories", "fx_vendors", "fx_product_images")),
    Registered(
        "r20_catalogue_default_sort",
        lambda c: catalogue_search(stock_ledger(c.products, c.stock_movements), c.categories, c.vendors,
                                   c.product_images, page_no=2),
        with_fixtures(f"""WITH led AS (SELECT product_id, sum(delta) AS net,
    sum(CASE WHEN kind='order' THEN -delta ELSE 0 END) AS sold FROM fx_stock_movements GROUP BY product_id),
j AS (SELECT p.id, p.name, p.mrp, p.selling_price, CAST(p.stock_qty + coalesce(l.net, 0) AS BIGINT) AS stock_qty,
    p.unit, p.sku, p.vendor_id, CAST(coalesce(l.sold, 0) AS BIGINT) AS sold_count,
    pc.name AS category_name, c.name AS subcategory_name
  FROM fx_products p LEFT JOIN led l ON l.product_id=p.id LEFT JOIN fx_categories c ON p.category_id=c.id
  LEFT JOIN fx_categories pc ON c.parent_id=pc.id WHERE p.is_active)
SELECT j.id, j.name, j.mrp, j.selling_price, j.stock_qty, j.unit, j.sku, j.category_name, j.subcategory_name,
  v.business_name AS vendor_name, {IMG_SQL.format(pid='j.id')} AS primary_image, j.sold_count, (SELECT count(*) FROM j) AS total
FROM j LEFT JOIN fx_vendors v ON j.vendor_id=v.id ORDER BY j.sold_count DESC NULLS FIRST, j.id LIMIT 20 OFFSET 20""",
                      "fx_stock_movements", "fx_products", "fx_categories", "fx_vendors", "fx_product_images")),
    Registered(
        "s5_catalogue_page_json",
        _s5,
        with_fixtures(f"""WITH j AS (
  SELECT p.*, pc.name AS category_name, c.name AS subcategory_name
  FROM fx_products p LEFT JOIN fx_categories c ON p.category_id=c.id
  LEFT JOIN fx_categories pc ON c.parent_id=pc.id
  WHERE p.is_active AND (p.category_id=2 OR c.parent_id=2)
    AND {sql_has_stem("p.name || ' ' || ''", "fx_products", "red")}),
pg AS (SELECT j.id, j.name, j.mrp, j.selling_price, j.stock_qty, j.unit, j.sku, j.category_name, j.subcategory_name,
  v.business_name AS vendor_name, {IMG_SQL.format(pid='j.id')} AS primary_image
  FROM j LEFT JOIN fx_vendors v ON j.vendor_id=v.id ORDER BY j.selling_price ASC NULLS LAST, j.id LIMIT 20)
SELECT CAST(to_json({{'success': true,
  'data': (SELECT list({{'id': id, 'name': name, 'mrp': CAST(mrp AS VARCHAR),
      'selling_price': CAST(selling_price AS VARCHAR), 'stock_qty': stock_qty, 'unit': unit, 'sku': sku,
      'category_name': category_name, 'subcategory_name': subcategory_name, 'vendor_name': vendor_name,
      'primary_image': primary_image}} ORDER BY selling_price, id) FROM pg),
  'meta': {{'total': (SELECT count(*) FROM j), 'page': 1, 'limit': 20,
           'pages': CAST(ceil((SELECT count(*) FROM j) / 20) AS BIGINT)}}}}) AS VARCHAR) AS json""",
                      "fx_products", "fx_categories", "fx_vendors", "fx_product_images")),
    Registered(
        "r21_product_detail",
        _r21,
        with_fixtures("""WITH rv AS (
  SELECT r.product_id, r.id, r.rating, r.created_at, u.first_name || ' ' || u.last_name AS customer_name,
    row_number() OVER (PARTITION BY r.product_id ORDER BY r.created_at DESC, r.id DESC) AS rn
  FROM fx_reviews r JOIN fx_customers c ON r.customer_id=c.id JOIN fx_users u ON c.user_id=u.id
  WHERE r.is_approved),
img AS (SELECT product_id, count(*) AS n,
  string_agg(concat_ws('|', sort_order, id, image_url, is_primary), ';'
    ORDER BY concat_ws('|', sort_order, id, image_url, is_primary)) AS d
  FROM fx_product_images GROUP BY product_id),
rev AS (SELECT product_id, count(*) AS n,
  string_agg(concat_ws('|', created_at, id, rating, customer_name), ';'
    ORDER BY concat_ws('|', created_at, id, rating, customer_name)) AS d
  FROM rv WHERE rn <= 10 GROUP BY product_id)
SELECT p.id, p.name, p.sku, p.vendor_id, p.category_id, p.mrp, p.selling_price, p.stock_qty, p.unit,
  pc.name AS category_name, c.name AS subcategory_name, pc.name AS parent_category_name,
  v.business_name AS vendor_name, coalesce(img.n, 0) AS image_count, coalesce(img.d, '') AS images,
  coalesce(rev.n, 0) AS review_count, coalesce(rev.d, '') AS reviews
FROM fx_products p LEFT JOIN fx_categories c ON p.category_id=c.id LEFT JOIN fx_categories pc ON c.parent_id=pc.id
LEFT JOIN fx_vendors v ON p.vendor_id=v.id LEFT JOIN img ON img.product_id=p.id LEFT JOIN rev ON rev.product_id=p.id
WHERE p.is_active""", "fx_products", "fx_categories", "fx_vendors", "fx_product_images", "fx_reviews",
                      "fx_customers", "fx_users")),
    Registered(
        "r25_wishlist",
        lambda c: wishlist_view(c.wishlist, c.products, c.vendors, c.brands, c.product_images,
                                brand_on=("sku", "name")),
        with_fixtures(f"""SELECT w.customer_id, w.created_at, p.id AS product_id, p.name, p.selling_price, p.mrp,
  p.stock_qty, {IMG_SQL.format(pid='p.id')} AS image, v.business_name AS vendor_name, b.name AS brand_name
FROM fx_wishlist w JOIN fx_products p ON w.product_id=p.id JOIN fx_vendors v ON p.vendor_id=v.id
LEFT JOIN fx_brands b ON p.sku=b.name WHERE p.is_active""",
                      "fx_wishlist", "fx_products", "fx_vendors", "fx_brands", "fx_product_images")),
    Registered(
        "e19_image_slots",
        lambda c: image_slots(c.product_images),
        with_fixtures(f"""SELECT product_id, rn - 1 AS pos, image_url, rn = 1 AS is_primary
FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY sort_order, id) AS rn FROM fx_product_images)
WHERE rn <= 8 AND regexp_matches(image_url, '{URL_PATTERN}')""", "fx_product_images")),
    Registered(
        "r26_categories_flat",
        lambda c: category_list(c.categories),
        with_fixtures("""SELECT c.id, c.name, c.sort_order, c.parent_id, p.name AS parent_name
FROM fx_categories c LEFT JOIN fx_categories p ON c.parent_id=p.id""", "fx_categories")),
    Registered(
        "r26_categories_roots",
        lambda c: category_list(c.categories, parent_only=True),
        with_fixtures("SELECT id, name, sort_order FROM fx_categories WHERE parent_id IS NULL", "fx_categories")),
    Registered(
        "r27_brands",
        lambda c: active_brands(c.brands),
        with_fixtures("SELECT id, name, slug FROM fx_brands WHERE is_active", "fx_brands")),
]
