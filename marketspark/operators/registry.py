"""Vendor and product registry (I1-I9): bulk change logs merged into the
catalogue, staff and user claims.

A change log is applied as the calls would have applied it one by one
(order: ts, seq), but computed in closed form: validation is a row-local
`when` chain, "last accepted change wins" is an arg-max aggregate (partial
aggregation, so a hot id is pre-combined), and the merge is a full outer
join on the unique key. Partial updates use a field mask: a null field in
an update means "not provided", so each field is the last non-null value
after the last full write.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as K
from ..session import scratch_path

# \z, not $: a final line break is no match
VENDOR_ID_RE = r"^[a-z0-9-]{2,50}\z"
EMAIL_RE = r"^[^\s@]+@[^\s@]+[.][^\s@]+\z"
WHATSAPP_RE = r"^[0-9]{10,15}\z"


# vendor columns an upsert sets from its payload, blank meaning none
VENDOR_TEXTS = ("tagline", "description", "logo", "primary_color", "secondary_color", "gradient", "card_gradient",
                "accent_color", "banner_image")


def _with_payload(df: DataFrame) -> DataFrame:
    """df with the optional vendor columns it leaves out, as nulls."""
    for f in (*VENDOR_TEXTS, "rating", "review_count", "page", "categories"):
        if f not in df.columns:
            df = df.withColumn(f, F.lit(None).cast("array<string>" if f == "categories" else "string"))
    return df


def _number(kind: str, field: str) -> Column:
    """A payload text as a number: blank and unreadable texts are null."""
    return F.nullif(F.col(field), F.lit("")).try_cast(kind)


def _not_a(kind: str, field: str) -> Column:
    return F.nullif(F.col(field), F.lit("")).isNotNull() & _number(kind, field).isNull()


def clean_vendor_changes(changes: DataFrame, staff: DataFrame) -> DataFrame:
    """Normalise and validate vendor registry requests.

    Adds vendor_id (lower+trim), email (lower+trim), wa (digits only) and
    `reason` (null = valid), checked in the order the call checks them; a
    rating or review count that is no number fails its own request last, where
    the call would have stored it."""
    admins = (staff.filter(F.col("role") == "admin").select(F.lower(F.col("email")).alias("email"))
              .distinct().withColumn("_admin", F.lit(True)))
    c = (_with_payload(changes).withColumn("vendor_id", F.lower(F.btrim(F.coalesce(F.col("id"), F.lit("")))))
                .withColumn("email", F.lower(F.btrim(F.coalesce(F.col("email"), F.lit("")))))
                .withColumn("wa", K.digits(F.coalesce(F.col("whatsapp"), F.lit("")))))
    op = F.col("op")
    # what does not ask who the admins are is told before they are joined, so
    # that the payload moves only for those who read it
    before = (F.when(~F.col("vendor_id").rlike(VENDOR_ID_RE), F.lit("invalid_vendor_id"))
               .when((op == "delete") & F.col("vendor_id").isin(*K.CORE_VENDORS), F.lit("core_vendor"))
               .when(op == "delete", F.lit(None))
               .when(F.coalesce(op, F.lit("")) != "upsert", F.lit("unsupported_action"))
               .when(~F.col("email").rlike(EMAIL_RE), F.lit("invalid_email"))
               .when(~F.col("wa").rlike(WHATSAPP_RE), F.lit("invalid_whatsapp"))
               .when(K.blank_to_null(F.coalesce(F.col("name"), F.lit(""))).isNull(), F.lit("name_required")))
    number = F.when(_not_a("decimal(3,1)", "rating") | _not_a("int", "review_count"), F.lit("invalid_number"))
    c = c.withColumn("_before", before).withColumn("_number", number).join(admins, "email", "left")
    reason = (F.when(F.col("_before").isNotNull(), F.col("_before"))
               .when(op == "delete", F.lit(None))
               .when(F.col("_admin").isNotNull(), F.lit("admin_email"))
               .otherwise(F.col("_number")))
    return c.withColumn("reason", reason).drop("_admin", "_before", "_number")


def accepted_vendor_changes(cleaned: DataFrame, vendor_orders: DataFrame) -> DataFrame:
    """Valid changes, deletes of vendors with orders rejected (I3: the
    orders' foreign key blocks the delete)."""
    busy = vendor_orders.select("vendor_id").distinct().withColumn("_busy", F.lit(True))
    c = cleaned.join(busy, "vendor_id", "left")
    c = c.withColumn("reason", F.when(F.col("reason").isNull() & (F.col("op") == "delete") & F.col("_busy").isNotNull(),
                                      F.lit("vendor_has_orders")).otherwise(F.col("reason"))).drop("_busy")
    return c


CHANGE_COLS = ("op", "name", *VENDOR_TEXTS, "rating", "review_count", "categories", "page", "email", "wa", "ts", "seq")


def last_vendor_change(accepted: DataFrame, cols: tuple[str, ...] = CHANGE_COLS) -> DataFrame:
    """Last accepted change per vendor id, with those of its columns."""
    ok = accepted.filter(F.col("reason").isNull())
    return ok.groupBy("vendor_id").agg(F.max_by(F.struct(*cols), F.struct("ts", "seq")).alias("_c"))


def keep_staff_changes(accepted: DataFrame) -> DataFrame:
    """What staff and claims read of the accepted changes, stored: they read it
    several times, and each time the order intake that tells which deletes are
    blocked would run anew."""
    spark = accepted.sparkSession
    path = scratch_path(spark, f"staff-changes-{uuid.uuid4().hex}")
    rows = accepted.filter(F.col("reason").isNull()).select("vendor_id", "op", "email", "ts", "seq", "reason")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def merge_vendors(vendors: DataFrame, accepted: DataFrame) -> DataFrame:
    """Upserts replace every column by the payload's (blank texts ->
    null; no rating -> 5, no review count -> 0, no categories -> [], no page
    -> the vendor's default page); deletes remove; last change wins."""
    last = last_vendor_change(accepted)
    v = _with_payload(vendors).select(F.col("id").alias("vendor_id"), "name", *VENDOR_TEXTS, "whatsapp", "rating", "review_count",
                       "categories", "page")
    j = v.join(last, "vendor_id", "full")
    up = F.col("_c.op") == "upsert"

    def text(f):
        return F.when(up, K.blank_to_null(F.coalesce(F.col(f"_c.{f}"), F.lit("")))).otherwise(F.col(f)).alias(f)

    own_page = K.blank_to_null(F.coalesce(F.col("_c.page"), F.lit("")))
    default_page = F.concat(F.lit("store.html?vendor="), F.col("vendor_id"))
    return (j.filter(F.col("_c").isNull() | up)
             .select("vendor_id",
                     F.when(up, F.btrim(F.col("_c.name"))).otherwise(F.col("name")).alias("name"),
                     *[text(f) for f in VENDOR_TEXTS],
                     F.when(up, F.col("_c.wa")).otherwise(F.col("whatsapp")).alias("whatsapp"),
                     F.when(up, F.coalesce(_number("decimal(3,1)", "_c.rating"), F.lit(5)))
                      .otherwise(F.col("rating")).cast("decimal(3,1)").alias("rating"),
                     F.when(up, F.coalesce(_number("int", "_c.review_count"), F.lit(0)))
                      .otherwise(F.col("review_count")).cast("int").alias("review_count"),
                     F.when(up, F.coalesce("_c.categories", F.array().cast("array<string>")))
                      .otherwise(F.col("categories")).alias("categories"),
                     F.when(up, F.coalesce(own_page, default_page)).otherwise(F.col("page")).alias("page"),
                     F.when(up, F.lit("upserted")).otherwise(F.lit("existing")).alias("source")))


def delete_vendors(accepted: DataFrame, products: DataFrame, promotions: DataFrame, subscriptions: DataFrame,
                   payments: DataFrame, staff: DataFrame) -> DataFrame:
    """Vendors whose last accepted change is a delete, with the rows
    the delete cascades to (each dependent table pre-aggregated by vendor,
    then equi-joined)."""
    last = last_vendor_change(accepted).filter(F.col("_c.op") == "delete").select("vendor_id")

    def n(df: DataFrame, col: str, name: str, cond=None) -> DataFrame:
        d = df if cond is None else df.filter(cond)
        return d.groupBy(F.col(col).alias("vendor_id")).agg(F.count(F.lit(1)).alias(name))

    out = last
    for df, col, name, cond in ((products, "vendor", "n_products", None),
                                (promotions, "vendor_id", "n_promotions", None),
                                (subscriptions, "vendor_id", "n_subscriptions", None),
                                (payments, "vendor_id", "n_payments", None),
                                (staff, "vendor_id", "n_staff", F.col("role") == "vendor")):
        out = out.join(n(df, col, name, cond), "vendor_id", "left")
    return out.select("vendor_id", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in
                                     ("n_products", "n_promotions", "n_subscriptions", "n_payments", "n_staff")])


def link_staff_users(staff: DataFrame, users: DataFrame) -> DataFrame:
    """Staff.user_id from users on lower(users.email) = staff.email
    (smallest id when several users share an address); `changed` marks
    rows whose link differs from before."""
    u = users.groupBy(F.lower(F.col("email")).alias("email")).agg(F.min("id").alias("_uid"))
    j = staff.join(u, "email", "left")
    return j.select("email", "role", "vendor_id", F.col("_uid").alias("user_id"),
                    (~F.col("user_id").eqNullSafe(F.col("_uid"))).alias("changed"))


def reassign_vendor_staff(staff: DataFrame, accepted: DataFrame, users: DataFrame) -> DataFrame:
    """I4: staff after the registry changes.

    A vendor whose last accepted change is an upsert with e-mail e has
    exactly the staff row (e, vendor) - unless a later upsert for another
    vendor took e over; a deleted vendor has none; untouched vendors keep
    their rows unless their e-mail was taken over. Admin rows stay."""
    ok = accepted.filter(F.col("reason").isNull())
    last_v = last_vendor_change(accepted, ("op", "email")).select("vendor_id", F.col("_c.op").alias("_op"),
                                                                  F.col("_c.email").alias("_email"))
    ups = ok.filter(F.col("op") == "upsert")
    last_e = ups.groupBy("email").agg(F.max_by("vendor_id", F.struct("ts", "seq")).alias("_owner"))
    new_rows = (last_v.filter(F.col("_op") == "upsert")
                .join(last_e, last_v["_email"] == last_e["email"], "inner")
                .filter(F.col("_owner") == F.col("vendor_id"))
                .select("email", F.lit("vendor").alias("role"), "vendor_id"))
    touched = last_v.select("vendor_id").withColumn("_t", F.lit(True))
    mentioned = last_e.select("email").withColumn("_m", F.lit(True))
    kept = (staff.filter(F.col("role") == "vendor").select("email", "role", "vendor_id")
            .join(touched, "vendor_id", "left").join(mentioned, "email", "left")
            .filter(F.col("_t").isNull() & F.col("_m").isNull()).select("email", "role", "vendor_id"))
    admins = staff.filter(F.col("role") != "vendor").select("email", "role", "vendor_id")
    allrows = admins.unionByName(kept).unionByName(new_rows).withColumn("user_id", F.lit(None).cast("string"))
    return link_staff_users(allrows, users).drop("changed")


def user_claims(users: DataFrame, staff: DataFrame, staff_before: DataFrame | None = None,
                accepted: DataFrame | None = None) -> DataFrame:
    """Claims after the registry log.

    A user whose e-mail has a staff row gets its role (and vendor_id when
    set) on top of the other claims; a user whose staff row was removed
    or replaced (in `staff_before`, or given by an accepted upsert of the
    log, and absent now) loses role and vendor_id; everyone else keeps the claims unchanged. One left join per
    staff table on the lower-cased e-mail."""
    empty = F.create_map().cast("map<string,string>")
    s = staff.select(F.col("email").alias("_semail"), F.col("role").alias("_role"), F.col("vendor_id").alias("_vid"))
    j = users.join(s, F.lower(users["email"]) == s["_semail"], "left")
    if staff_before is not None:
        b = staff_before.select(F.col("email").alias("_bemail"))
        if accepted is not None:
            b = b.unionByName(accepted.filter(F.col("reason").isNull() & (F.col("op") == "upsert"))
                              .select(F.col("email").alias("_bemail")))
        b = b.distinct().withColumn("_was", F.lit(True))
        j = j.join(b, F.lower(j["email"]) == b["_bemail"], "left")
        was = F.col("_was").isNotNull()
    else:
        was = F.lit(False)
    claims = F.coalesce(F.col("claims"), empty)
    base = F.map_filter(claims, lambda k, v: ~k.isin("role", "vendor_id"))
    extra = (F.when(F.col("_vid").isNull(), F.create_map(F.lit("role"), F.col("_role")))
              .otherwise(F.create_map(F.lit("role"), F.col("_role"), F.lit("vendor_id"), F.col("_vid"))))
    out = (F.when(F.col("_role").isNotNull(), F.map_concat(base, extra))
            .when(was, base)
            .otherwise(claims))
    text = F.array_join(F.array_sort(F.transform(F.map_entries(out),
                                                 lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return j.select("id", "email", text.alias("claims"))


def vendor_access_list(vendors: DataFrame, staff: DataFrame) -> DataFrame:
    """Vendors with their vendor-role staff e-mail, ordered by name."""
    s = staff.filter(F.col("role") == "vendor").select("vendor_id", "email", "user_id")
    j = vendors.select(F.col("id").alias("vendor_id"), F.col("name").alias("vendor_name"), "whatsapp").join(
        s, "vendor_id", "left")
    return (j.select("vendor_id", "vendor_name", "email", "whatsapp",
                     F.col("user_id").isNotNull().alias("account_created"))
             .orderBy("vendor_name", "vendor_id", "email"))


# product columns a write sets; of the second line blank means none
PRODUCT_FIELDS = ("name", "description", "price", "original_price", "image", "in_stock", "category", "sizes",
                  "badge", "size", "material", "origin", "notes")
BLANK_IS_NONE = ("badge", "size", "material", "origin", "notes")


def merge_products(products: DataFrame, changes: DataFrame) -> DataFrame:
    """I8: apply a product change log, ordered by (ts if present, seq).

    Changes: id, vendor, seq, op (upsert = full write, update = the fields
    named in array `fields`, which a null value clears; delete) and the
    product columns. An update of a product that is not there does nothing.
    A write saves the whole product with its defaults (in_stock true, sizes
    [], blank texts null); untouched products stay as they are.

    One aggregate per id: an upsert sets every field, an update its own, the
    last setter of each field wins; then one full outer join. A product is
    there after the log if it was upserted after its last delete, or existed
    and was never deleted."""
    o = F.struct("ts", "seq") if "ts" in changes.columns else F.struct(F.col("seq"))
    op = F.col("op")
    c = changes.withColumn("_o", o)

    def last(value, when):
        return F.max_by(F.struct(value), F.when(when, F.col("_o")))

    def sets(f):
        return (op == "upsert") | ((op == "update") & F.array_contains("fields", f))

    log = c.groupBy("id").agg(
        F.max(F.when(op == "delete", F.col("_o"))).alias("_ld"),
        F.max(F.when(op == "upsert", F.col("_o"))).alias("_lu"),
        F.max(F.when((op == "update") & (F.size("fields") > 0), F.col("_o"))).isNotNull().alias("_updated"),
        last(F.col("vendor"), op == "upsert").alias("_s_vendor"),
        *[last(F.col(f), sets(f)).alias("_s_" + f) for f in PRODUCT_FIELDS])
    j = products.select("id", "vendor", *PRODUCT_FIELDS, F.lit(True).alias("_was")).join(log, "id", "full")
    upserted = F.col("_lu").isNotNull() & (F.col("_ld").isNull() | (F.col("_lu") > F.col("_ld")))
    there = upserted | (F.col("_was") & F.col("_ld").isNull())
    updated = F.col("_was") & F.coalesce(F.col("_updated"), F.lit(False))

    def field(f):
        value = F.when(F.col("_s_" + f).isNotNull(), F.col("_s_" + f)[f]).otherwise(F.col(f))
        saved = (F.coalesce(value, F.lit(True)) if f == "in_stock"
                 else F.coalesce(value, F.array().cast("array<string>")) if f == "sizes"
                 else F.nullif(value, F.lit("")) if f in BLANK_IS_NONE else value)
        kind = {"price": "decimal(18,2)", "original_price": "decimal(18,2)"}.get(f)
        out = F.when(upserted | updated, saved).otherwise(F.col(f))
        return (out.cast(kind) if kind else out).alias(f)

    return (j.filter(F.coalesce(there, F.lit(False)))
             .select("id", F.when(upserted, F.col("_s_vendor.vendor")).otherwise(F.col("vendor")).alias("vendor"),
                     *[field(f) for f in PRODUCT_FIELDS],
                     F.when(upserted, F.lit("upserted")).when(updated, F.lit("updated"))
                      .otherwise(F.lit("existing")).alias("source")))


INFO_FIELDS = ("name", "tagline", "description", "logo")


def update_vendor_info(vendors: DataFrame, updates: DataFrame) -> DataFrame:
    """Vendor settings: only name, tagline, description and logo may
    change. An update sets the fields named in array `fields`, and a null
    value clears one; a name cannot be cleared, so an update that tries
    fails as a whole. The last setter of each field wins."""
    o = F.struct("ts", "seq")
    provided = lambda f: F.array_contains("fields", f)
    ok = updates.filter(~(provided("name") & F.col("name").isNull()))
    u = ok.groupBy("vendor_id").agg(
        *[F.max_by(F.struct(f), F.when(provided(f), o)).alias("_u_" + f) for f in INFO_FIELDS])
    j = vendors.withColumnRenamed("id", "vendor_id").join(u, "vendor_id", "left")
    cols = [F.when(F.col("_u_" + f).isNotNull(), F.col("_u_" + f)[f]).otherwise(F.col(f)).alias(f)
            if f in INFO_FIELDS else F.col(f) for f in vendors.columns if f != "id"]
    return j.select("vendor_id", *cols)


# ---- I3: what a delete leaves ---------------------------------------------------

def survivors(rows: DataFrame, vendor_col: str, accepted: DataFrame) -> DataFrame:
    """Rows of a dependent table after the log: a vendor's delete takes all
    its rows along, even if the vendor is created again later."""
    gone = (accepted.filter(F.col("reason").isNull() & (F.col("op") == "delete"))
            .select(F.col("vendor_id").alias("_gone")).distinct())
    return rows.join(gone, rows[vendor_col] == gone["_gone"], "left_anti")


def new_trials(vendors: DataFrame, accepted: DataFrame, trial_days: int) -> DataFrame:
    """Trials that vendor inserts of the log start: a vendor that was not
    there before, or was deleted, is inserted by its first upsert (after the
    last delete). Columns of the subscription table."""
    ok = accepted.filter(F.col("reason").isNull()).select("vendor_id", "op", F.struct("ts", "seq").alias("_o"))
    marks = ok.groupBy("vendor_id").agg(F.max(F.when(F.col("op") == "delete", F.col("_o"))).alias("_ld"))
    first = (ok.filter(F.col("op") == "upsert").join(marks, "vendor_id")
             .filter(F.col("_ld").isNull() | (F.col("_o") > F.col("_ld")))
             .groupBy("vendor_id").agg(F.min("_o").alias("_first"), F.first("_ld").alias("_ld")))
    was = vendors.select(F.col("id").alias("vendor_id"), F.lit(True).alias("_was"))
    ins = first.join(was, "vendor_id", "left").filter(F.col("_was").isNull() | F.col("_ld").isNotNull())
    start = F.col("_first.ts")
    return ins.select("vendor_id", F.lit("trial").alias("plan"), F.lit("trial").alias("status"),
                      start.alias("access_started_at"), start.alias("current_period_start"),
                      (start + F.make_dt_interval(days=F.lit(trial_days))).alias("access_ends_at"))


def subscriptions_after(subscriptions: DataFrame, vendors: DataFrame, accepted: DataFrame, trial_days: int) -> DataFrame:
    """Subscription rows after the log: survivors, and the trials of newly
    inserted vendors that have no row."""
    kept = survivors(subscriptions, "vendor_id", accepted).select(
        "vendor_id", "plan", "status", "access_started_at", "current_period_start", "access_ends_at")
    trials = new_trials(vendors, accepted, trial_days)
    return kept.unionByName(trials.join(kept.select("vendor_id"), "vendor_id", "left_anti"))
