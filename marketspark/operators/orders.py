"""Order intake (D1-D13): validate, merge, re-price, check, build, split.

Shape of the plan (one request = one row until the product lookup):

* D1, D2 and D3 are row-local: the header rules are a `when` chain and
  the item list is parsed once, checked and merged with higher-order
  functions inside the row. No shuffle.
* D4 explodes the merged lines and joins the catalogue on product id
  (AQE broadcasts the catalogue side when its measured size is under the
  threshold, else a sort-merge join with skew splitting). The placement call
  runs with its caller's rights, so a line matches only products the caller
  may read at the time of the request: of vendors whose subscription was
  live just then, the caller's own vendor, or all for an admin (F2). The
  products bring their vendor's live spans along, so the lines move once for
  both; only lines of vendors with very many spans meet those by day.
* D5 counts matched lines per request with a window on request_id. A
  request holds at most 50 distinct lines (D2), so every window group is
  bounded. D6-D9 then group on request_id or (request_id, vendor), which
  the window's hash partitioning already satisfies: no further exchange.
* The customer's details do not travel with the lines: each line holds a
  hash of its request's header, and D7 and D8 send the header itself once
  per request, as a row among the lines of the window's exchange.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as K
from ..session import scratch_path
from .visibility import live_at, live_within, vendor_spans

MAX_ITEMS = 50
MAX_QTY = 99
QTY_PATTERN = r"^[1-9][0-9]?\z"      # \z: a final line break is no match
ORDER_PREFIX = "ORD"

# ---- fixed values: reasons, in the order the reference checks them --------
R_NO_USER = "sign_in_required"
R_MISSING = "missing_customer_details"
R_TOO_LONG = "customer_details_too_long"
R_COUNT = "bad_item_count"
R_ITEM = "invalid_product_or_quantity"
R_UNAVAILABLE = "unavailable"


def header_reason(df: DataFrame) -> Column:
    """First failing header rule, or null."""
    name, phone, addr, email = (F.col(c) for c in
                                ("customer_name", "customer_phone", "customer_address", "customer_email"))
    blank = lambda c: K.blank_to_null(F.coalesce(c, F.lit(""))).isNull()
    return (F.when(F.col("user_id").isNull(), F.lit(R_NO_USER))
             .when(blank(name) | blank(phone) | blank(addr), F.lit(R_MISSING))
             .when((F.char_length(name) > 150) | (F.char_length(F.coalesce(email, F.lit(""))) > 320)
                   | (F.char_length(phone) > 30) | (F.char_length(addr) > 1000), F.lit(R_TOO_LONG)))


def validate_headers(requests: DataFrame) -> DataFrame:
    """Adds `reason` (null when the header passes)."""
    return requests.withColumn("reason", header_reason(requests))


ITEM_SCHEMA = "array<array<struct<id:string,qty:string>>>"


def parse_items(df: DataFrame, items_col: str = "items") -> DataFrame:
    """Parse the JSON item list of each request, row-local.

    Adds `item_reason` (null when the list passes) and `lines`
    array<struct<id:string, qty:int>> of the raw (unmerged) lines.

    * One parse. The JSON functions read one value and ignore what follows,
      so the list is parsed as the first of two elements of an outer array;
      the second is a mark that the text cannot know (its own hash). Only a
      text that is exactly one JSON value leaves two elements, the mark last.
      A list of objects comes out as the first one: its length gives the
      1..50 rule.
    * Elements: struct<id, qty:string>. A string field keeps a number's
      literal text (3.0 stays "3.0"), so the qty text is tested against
      QTY_PATTERN as the reference tests it; VARIANT would turn 3.0 into 3.
    * Any other text (broken JSON, a bare object, a list with an element that
      is no object) gives no such pair; only then is the text read again, to
      tell a list of bad elements from no list at all.
    """
    text = F.col(items_col)
    mark = F.md5(text)
    pair = F.from_json(F.concat(F.lit("["), text, F.lit(',[{"id":"'), mark, F.lit('"}]]')), ITEM_SCHEMA)
    df = df.withColumn("_pair", pair)
    whole = (F.size("_pair") == 2) & (F.col("_pair")[1][0]["id"] == mark)
    df = df.withColumn("_els", F.when(whole, F.col("_pair")[0])).drop("_pair")
    bad_elem = F.exists("_els", lambda x: x.isNull() | F.coalesce(x["id"] == "", F.lit(True))
                        | ~F.coalesce(x["qty"], F.lit("")).rlike(QTY_PATTERN))
    listed = F.col("_els").isNotNull()
    n_bad = K.json_array_size(items_col)
    reason = (F.when(listed & ((F.size("_els") == 0) | (F.size("_els") > MAX_ITEMS)), F.lit(R_COUNT))
               .when(listed, F.when(bad_elem, F.lit(R_ITEM)))
               .otherwise(F.when(n_bad.between(1, MAX_ITEMS), F.lit(R_ITEM)).otherwise(F.lit(R_COUNT))))
    df = df.withColumn("item_reason", reason)
    lines = F.transform("_els", lambda x: F.struct(x["id"].alias("id"), x["qty"].cast("int").alias("qty")))
    return (df.withColumn("lines", F.when(F.col("item_reason").isNull(), lines))
              .drop("_els"))


def merge_lines_col(lines: Column) -> Column:
    """D3 inside the row: one entry per product id with qty summed.
    At most 50 lines per request, so the quadratic filter is tiny; it is left
    to lists that name a product twice."""
    ids = F.array_distinct(F.transform(lines, lambda l: l["id"]))
    merged = F.transform(ids, lambda pid: F.struct(
        pid.alias("product_id"),
        F.aggregate(F.filter(lines, lambda l: l["id"] == pid), F.lit(0).cast("int"),
                    lambda acc, l: acc + l["qty"]).alias("qty")))
    as_they_are = F.transform(lines, lambda l: F.struct(l["id"].alias("product_id"), l["qty"].alias("qty")))
    return F.when(F.size(F.array_compact(ids)) == F.size(lines), as_they_are).otherwise(merged)


def screen_requests(requests: DataFrame) -> DataFrame:
    """D1 + D2 + D3, row-local. Output: request columns, `reason`,
    `merged` array<struct<product_id, qty>>, `n_requested`."""
    df = validate_headers(requests)
    df = parse_items(df)
    df = df.withColumn("reason", F.coalesce(F.col("reason"), F.col("item_reason"))).drop("item_reason")
    merged = merge_lines_col(F.col("lines"))
    return (df.withColumn("merged", F.when(F.col("reason").isNull(), merged))
              .withColumn("n_requested", F.array_size("merged"))
              .drop("lines"))


def merge_lines(lines: DataFrame) -> DataFrame:
    """D3 for relational line input (request_id, product_id, qty).
    Partial aggregation combines map-side, so a hot product or request
    is pre-summed before the shuffle."""
    return (lines.groupBy("request_id", "product_id")
                 .agg(F.sum("qty").cast("int").alias("qty")))


def catalogue_for_orders(products: DataFrame) -> DataFrame:
    """What the intake reads from the catalogue: only in-stock rows, only
    the columns it copies (pushed into the scan)."""
    return (products.filter((F.col("in_stock") == F.lit(True)) & F.col("price").isNotNull())
                    .select(F.col("id").alias("product_id"), "vendor", "name", "price", "image", "size"))


HEADER_COLS = ("user_id", "requested_at", "customer_name", "customer_email", "customer_phone",
               "customer_address")


CALLER_COLS = ("caller_role", "caller_vendor_id")      # claims of the caller's token


def _exploded(screened: DataFrame) -> DataFrame:
    """Merged lines of passing requests, header fields carried along.

    `merged` is null for rejected requests. `inline_outer` plus a filter
    on its output is used instead of `inline`: for `inline` Catalyst infers
    `size(merged) > 0` and pushes it below the projection, which re-runs
    the whole JSON check inside the filter."""
    claims = [F.col(c) if c in screened.columns else F.lit(None).cast("string").alias(c) for c in CALLER_COLS]
    # the hash is taken below the generator, once per request
    return (screened.withColumn("_head", header_hash())
                    .select("request_id", "_head", *header_columns(), "user_id", "requested_at", *claims, "n_requested",
                            F.inline_outer("merged"))
                    .filter(F.col("product_id").isNotNull()))


def matched_lines(screened: DataFrame, products: DataFrame, live: DataFrame | None) -> DataFrame:
    """Merged lines that match a product: in stock, qty 1..99, and, when the
    vendors' live intervals are given, readable by the caller at
    requested_at."""
    asked, catalogue = _exploded(screened).filter(F.col("qty").between(1, MAX_QTY)), catalogue_for_orders(products)
    if live is None:
        return asked.join(catalogue, "product_id", "inner").drop(*CALLER_COLS)
    own = F.coalesce((F.col("caller_role") == "admin") | (F.col("vendor") == F.col("caller_vendor_id")), F.lit(False))
    spans = vendor_spans(live)
    stocked = catalogue.join(spans.withColumnRenamed("vendor_id", "_vendor"), F.col("vendor") == F.col("_vendor"), "left").drop("_vendor")
    busy = F.coalesce(F.col("_busy"), F.lit(False))
    joined = asked.join(stocked.filter(~busy).drop("_busy"), "product_id", "inner")
    seen = joined.filter(own | live_within(F.col("_spans"), F.col("requested_at"))).drop("_spans", *CALLER_COLS)
    if spans.filter("_busy").isEmpty():
        return seen
    # vendors of very many spans: those meet the lines by day
    rest = asked.join(stocked.filter(busy).drop("_busy", "_spans"), "product_id", "inner")
    many = live.join(spans.filter("_busy").select("vendor_id"), "vendor_id", "left_semi")
    rest = live_at(rest, many, "vendor", "requested_at", screened.select("requested_at"))
    return seen.unionByName(rest.filter(own | F.col("live")).drop("live", *CALLER_COLS))


def canonical_lines(screened: DataFrame, products: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """D4 + D5: merged lines re-priced from the catalogue; a request keeps
    its lines only when every requested id matched."""
    return _whole(matched_lines(screened, products, live))


def _whole(matched: DataFrame) -> DataFrame:
    """The lines of the requests of which every id matched."""
    w = Window.partitionBy("request_id")
    return matched.withColumn("_n_ok", F.count(F.lit(1)).over(w)).filter(F.col("_n_ok") == F.col("n_requested")).drop("_n_ok")


def availability_check(screened: DataFrame, products: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """D5 as a per-request table: requested ids, matched ids, ok flag."""
    n = matched_lines(screened, products, live).groupBy("request_id").agg(F.count(F.lit(1)).alias("_n"))
    # filtered behind a generator: below it, the filter would run the whole JSON check anew for each of its uses
    asked = screened.select("request_id", F.inline_outer(F.array(F.struct(F.col("n_requested").cast("bigint").alias("n_requested"))))).filter(F.col("n_requested") > 0)
    return asked.join(n, "request_id", "left").select(
        "request_id", "n_requested", F.coalesce(F.col("_n"), F.lit(0)).alias("n_matched"),
        (F.col("n_requested") == F.coalesce(F.col("_n"), F.lit(0))).alias("available"))


def order_id(request_id: Column, at: Column) -> Column:
    """Repeatable id: prefix, yymmdd and 32 hex digits of sha256(request):
    128 bits, so ids stay distinct at any number of orders."""
    return F.concat(F.lit(f"{ORDER_PREFIX}-"), F.date_format(at, "yyMMdd"), F.lit("-"),
                    F.upper(F.substring(F.sha2(request_id, 256), 1, 32)))


def _items_json(arr: Column) -> Column:
    renamed = F.transform(arr, lambda x: F.struct(
        x["product_id"].alias("id"), x["vendor"].alias("vendor"), x["name"].alias("name"),
        x["price"].alias("price"), x["image"].alias("image"), x["size"].alias("size"), x["qty"].alias("qty")))
    return F.to_json(renamed, {"ignoreNullFields": "false"})


def header_columns() -> list[Column]:
    return [F.btrim("customer_name").alias("customer_name"),
            K.blank_to_null(F.coalesce(F.col("customer_email"), F.lit(""))).alias("customer_email"),
            F.btrim("customer_phone").alias("customer_phone"),
            F.btrim("customer_address").alias("customer_address")]


def header_hash() -> Column:
    """64 bits that tell the headers of one request_id apart (hashes pass over
    nulls, so these are told by their places)."""
    return F.xxhash64(*HEADER_COLS, *(F.col(c).isNull() for c in HEADER_COLS))


# what the lines of an order need of a matched line
LINE_COLS = ("product_id", "vendor", "name", "price", "image", "size", "qty")
MATCHED_COLS = ("request_id", "_head", "n_requested", *LINE_COLS)


@dataclass
class Intake:
    screened: DataFrame      # every request with its reason (null = passed D1-D3)
    matched: DataFrame       # lines that match a product, of accepted requests or not
    requests: DataFrame      # the raw requests
    kept: DataFrame | None = None      # placed(), when it is stored

    @property
    def lines(self) -> DataFrame:
        """Canonical lines of accepted requests."""
        return _whole(self.matched)

    def placed(self) -> DataFrame:
        """`lines` for those who need the headers: these come as one row per
        request through the exchange of the lines, not on every line."""
        if self.kept is not None:
            return self.kept
        header = F.struct("user_id", "requested_at", *header_columns())
        heads = self.screened.filter(header_reason(self.screened).isNull()).select("request_id", header_hash().alias("_head"), header.alias("_header"))
        rows = self.matched.select(*MATCHED_COLS).unionByName(heads, allowMissingColumns=True)
        # a header stands before its lines; only those of accepted requests are copied. _line is a
        # column, as an expression would be another one for each window, with a sort of its own
        rows = rows.withColumn("_line", F.col("product_id").isNotNull())
        request = Window.partitionBy("request_id").orderBy("_head", "_line")
        n_ok, is_line = F.col("_n_ok"), F.col("_line")
        return (rows.withColumn("_n_ok", F.count("product_id").over(request.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
                .filter(F.when(is_line, n_ok == F.col("n_requested")).otherwise(n_ok > 0))
                .withColumn("_header", F.last("_header", ignorenulls=True).over(request.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
                .filter(is_line).select("request_id", "_header", *LINE_COLS))

    def keep(self) -> Intake:
        """The intake with its accepted lines stored, for jobs that build both
        orders and vendor orders: each alone would run the intake anew, as
        they need different columns or are written by jobs of their own."""
        spark = self.matched.sparkSession
        path = scratch_path(spark, f"placed-{uuid.uuid4().hex}")
        rows = self.placed()
        rows.write.parquet(path)
        return replace(self, kept=spark.read.schema(rows.schema).parquet(path))

    def orders(self) -> DataFrame:
        """D6 + D7: one order row per accepted request."""
        # grouping by more than request_id keeps the partitioning from the
        # window (no extra exchange)
        o = (self.placed().groupBy("request_id", "_header")
             .agg(F.sum(F.col("price") * F.col("qty")).cast("decimal(38,2)").alias("total"),
                  F.count(F.lit(1)).alias("n_items"),
                  F.array_sort(F.collect_list(F.struct(
                      "vendor", "name", "product_id", "price", "image", "size", "qty"))).alias("_items"))
             .select("request_id", "_header.*", "total", "n_items", "_items"))
        return o.select(
            order_id(F.col("request_id"), F.col("requested_at")).alias("id"), "request_id", "user_id",
            "customer_name", "customer_email", "customer_phone", "customer_address",
            _items_json(F.col("_items")).alias("items"), "total", "n_items",
            F.lit("pending").alias("status"), F.col("requested_at").alias("created_at"))

    def vendor_orders(self) -> DataFrame:
        """One row per (order, vendor), items by name then id."""
        v = (self.placed().groupBy("request_id", "vendor", "_header")
             .agg(F.sum(F.col("price") * F.col("qty")).cast("decimal(38,2)").alias("subtotal"),
                  F.count(F.lit(1)).alias("n_items"),
                  F.array_sort(F.collect_list(F.struct(
                      "name", "product_id", "vendor", "price", "image", "size", "qty"))).alias("_items"))
             .select("request_id", "vendor", "_header.*", "subtotal", "n_items", "_items"))
        oid = order_id(F.col("request_id"), F.col("requested_at"))
        return v.select(
            F.concat(oid, F.lit("/"), F.col("vendor")).alias("id"), oid.alias("order_id"),
            F.col("vendor").alias("vendor_id"), "request_id", "user_id",
            "customer_name", "customer_email", "customer_phone", "customer_address",
            _items_json(F.col("_items")).alias("items"), "subtotal", "n_items",
            F.lit("pending").alias("status"), F.lit(None).cast("string").alias("status_note"),
            F.col("requested_at").alias("created_at"), F.col("requested_at").alias("updated_at"))

    def outcomes(self) -> DataFrame:
        """Every request with its outcome: (request_id, reason, total).
        reason is null for placed orders; requests that passed D1-D3 but
        not D5 get 'unavailable'. One left join of the screened requests
        with the accepted totals."""
        acc = (self.lines.groupBy("request_id")
               .agg(F.sum(F.col("price") * F.col("qty")).cast("decimal(38,2)").alias("total")))
        j = self.screened.select("request_id", "reason").join(acc, "request_id", "left")
        return j.select("request_id",
                        F.when(F.col("reason").isNotNull(), F.col("reason"))
                         .when(F.col("total").isNull(), F.lit(R_UNAVAILABLE)).alias("reason"),
                        "total")

    def rejected(self) -> DataFrame:
        """Requests with their reason; D5 failures get 'unavailable'."""
        return self.outcomes().filter(F.col("reason").isNotNull()).select("request_id", "reason")


def intake(requests: DataFrame, products: DataFrame, live: DataFrame | None = None) -> Intake:
    """The placement call over many requests. `live` are the vendors' live
    intervals (`subscriptions.live_intervals`): with them, products count as
    readable as of each request's own time; without, all of them."""
    screened = screen_requests(requests)
    return Intake(screened=screened, matched=matched_lines(screened, products, live), requests=requests)


def order_totals(it: Intake) -> DataFrame:
    """Total and line count per accepted request."""
    return (it.lines.groupBy("request_id")
            .agg(F.sum(F.col("price") * F.col("qty")).cast("decimal(38,2)").alias("total"),
                 F.count(F.lit(1)).alias("n_lines"),
                 F.sum("qty").cast("bigint").alias("n_units")))


def order_response(it: Intake) -> DataFrame:
    """The JSON the placement call returns, one per order.

    Built from the vendor orders grouped by request_id - the partitioning
    they already have, so no exchange and no join back to the orders: the
    order total is the sum of its vendor subtotals (exact in decimal). The
    items are JSON already and are put in as they are, not read and written
    again."""
    vo = it.vendor_orders()
    j = (vo.groupBy("request_id")
           .agg(F.first("order_id").alias("order_id"),
                F.sum("subtotal").cast("decimal(38,2)").alias("total"),
                F.array_sort(F.collect_list(F.struct(
                    F.col("vendor_id"), F.col("id"), F.col("items"), F.col("subtotal"), F.col("status")))).alias("_p")))

    def opened(**cols):          # an object's text, without its last brace; no value ends in one
        return F.rtrim(F.to_json(F.struct(*[c.alias(n) for n, c in cols.items()]), {"ignoreNullFields": "false"}), F.lit("}"))
    vendor_orders = F.transform("_p", lambda x: F.concat(
        opened(id=x["id"], vendorId=x["vendor_id"]), F.lit(',"items":'), x["items"],
        F.lit(","), F.substring(opened(total=x["subtotal"], status=x["status"]), 2, 1 << 30), F.lit("}")))
    return j.select("order_id", F.concat(opened(orderId=F.col("order_id"), total=F.col("total")), F.lit(',"vendorOrders":['),
                                         F.array_join(vendor_orders, ","), F.lit("]}")).alias("response"))


def whatsapp_outbox(vendor_orders: DataFrame, vendors: DataFrame) -> DataFrame:
    """Per vendor order, the message text and wa.me link.

    Vendors are looked up with a left join (a missing vendor falls back to
    the store name and number)."""
    v = vendors.select(F.col("id").alias("vendor_id"), F.col("name").alias("_vname"), F.col("whatsapp").alias("_wa"))
    j = vendor_orders.join(v, "vendor_id", "left")
    items = F.from_json("items", "array<struct<id:string,name:string,price:decimal(18,2),qty:int>>")
    item_lines = F.array_join(F.transform(items, lambda i: F.concat(
        F.lit("  • "), i["name"], F.lit(" (×"), i["qty"].cast("string"), F.lit(") — "),
        K.naira(i["price"] * i["qty"]))), "\n")
    vname = F.coalesce(F.nullif(F.col("_vname"), F.lit("")), F.lit(K.STORE_NAME))
    email = F.coalesce(F.col("customer_email"), F.lit("Not provided"))
    msg = F.concat(
        F.lit(f"🛍️ *NEW ORDER — {K.STORE_NAME}*\n"),
        F.lit("\n*Boutique:* "), vname, F.lit("\n"),
        F.lit("\n*Customer Details:*\n👤 Name: "), F.col("customer_name"),
        F.lit("\n📍 Address: "), F.col("customer_address"),
        F.lit("\n📞 Phone: "), F.col("customer_phone"),
        F.lit("\n✉️ Email: "), email,
        F.lit("\n\n*Items Ordered:*\n"), item_lines,
        F.lit("\n\n💰 *Items Total: "), K.naira(F.col("subtotal")), F.lit("*"),
        F.lit("\n🚚 *Delivery: To be discussed with seller*\n\n"
              "Please reply with the delivery cost and bank account details to complete the order.\n"
              "Thank you! 🙏"))
    number = K.wa_digits(F.col("_wa"))
    # behind a generator: else the message would be made anew for the link, and its items be read again
    made = j.select(F.col("id").alias("vendor_order_id"), "vendor_id", number.alias("number"), F.explode(F.array(msg)).alias("message"))
    return made.withColumn("url", F.concat(F.lit("https://wa.me/"), F.col("number"), F.lit("?text="), K.uri_component("message")))


def product_inquiry_link(products: DataFrame, vendors: DataFrame) -> DataFrame:
    """Inquiry text + link for every product (vendor number or store's)."""
    v = vendors.select(F.col("id").alias("vendor"), F.col("name").alias("_vname"), F.col("whatsapp").alias("_wa"))
    j = products.select("id", "vendor", "name", "price").join(v, "vendor", "left")
    msg = F.concat(
        F.lit(f"🛍️ *Product Inquiry — {K.STORE_NAME}*\n\n*Product:* "), F.col("name"),
        F.lit("\n*Price:* "), K.naira(F.col("price")),
        F.lit("\n*Vendor:* "), F.coalesce(F.col("_vname"), F.lit("")),
        F.lit("\n\nI would like to place an order. Please share delivery cost and payment details. Thank you!"))
    number = F.coalesce(F.nullif(F.col("_wa"), F.lit("")), F.lit(K.DEFAULT_WHATSAPP))
    return j.select(F.col("id").alias("product_id"), msg.alias("message"),
                    F.concat(F.lit("https://wa.me/"), number, F.lit("?text="), K.uri_component(msg)).alias("url"))


def checkout_form_clean(forms: DataFrame) -> DataFrame:
    """Checkout form -> customer info, or a reject reason.

    Required (after trim): first, last, phone, address, city, state.
    Email falls back form -> account -> 'Not provided'. Address is
    'address, city, state, Nigeria' plus ' (Landmark: x)' when given."""
    t = lambda c: F.btrim(F.coalesce(F.col(c), F.lit("")))
    missing = (t("first_name") == "") | (t("last_name") == "") | (t("phone") == "") | \
              (t("address") == "") | (t("city") == "") | (t("state") == "")
    landmark = F.when(t("landmark") != "", F.concat(F.lit(" (Landmark: "), t("landmark"), F.lit(")"))).otherwise(F.lit(""))
    return forms.select(
        "form_id",
        F.when(missing, F.lit("missing_required_fields")).alias("reason"),
        F.when(~missing, F.concat_ws(" ", t("first_name"), t("last_name"))).alias("name"),
        F.when(~missing, t("phone")).alias("phone"),
        F.when(~missing, F.coalesce(F.nullif(t("email"), F.lit("")), F.nullif(t("account_email"), F.lit("")),
                                    F.lit("Not provided"))).alias("email"),
        F.when(~missing, F.concat(t("address"), F.lit(", "), t("city"), F.lit(", "), t("state"),
                                  F.lit(", Nigeria"), landmark)).alias("address"))


def intake_report(it: Intake) -> DataFrame:
    """Accepted and rejected request counts by reason, with the value
    of the accepted ones."""
    o = it.outcomes()
    outcome = F.when(F.col("reason").isNull(), F.lit("accepted")).otherwise(F.lit("rejected"))
    return (o.groupBy(outcome.alias("outcome"), "reason")
             .agg(F.count(F.lit(1)).alias("n_requests"),
                  F.sum("total").cast("decimal(38,2)").alias("value")))
