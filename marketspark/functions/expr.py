"""Column helpers (K1-K15). All built-in Spark expressions: no Python UDFs,
so they stay inside whole-stage codegen wherever they are used."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values the reference defines -----------------------------------
# Fallback WhatsApp number used when a vendor has none.
DEFAULT_WHATSAPP = "2340000000000"
# Store name used in message headers and as vendor-name fallback.
STORE_NAME = "Our Store"
# Promo code the cart page accepts.
PROMO_CODE = "SAVE10"
# Order status labels shown to shoppers.
STATUS_LABELS = {
    "pending": "Pending",
    "confirmed": "Confirmed",
    "paid": "Paid",
    "shipped": "Shipped",
    "delivered": "Delivered",
    "cancelled": "Cancelled",
}
ORDER_STATUSES = ("pending", "confirmed", "paid", "shipped", "delivered", "cancelled")
# Core boutiques that cannot be deleted.
CORE_VENDORS = ("perfume", "kitchen", "variety")
# Quiz result labels (score >= 94, else).
QUIZ_STRONG = "Signature (Eau de Parfum)"
QUIZ_LIGHT = "Signature (Concentré de Parfum)"
# Perfume size picker -> product id.
SIZE_TO_PRODUCT = {"30ml": "p2", "50ml": "p1", "100ml": "p7"}
# Newsletter e-mail pattern (applied to the lower-cased address). \z here and
# below: a final line break is part of the text, as in the page's engine.
EMAIL_STRICT_RE = (
    r'^(([^<>()\[\]\\.,;:\s@"]+(\.[^<>()\[\]\\.,;:\s@"]+)*)|(".+"))@'
    r'((\[[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\])|(([a-zA-Z\-0-9]+\.)+[a-zA-Z]{2,}))\z'
)
# Link allow-list for promotion links and images (case-insensitive).
SAFE_URL_RE = r"(?i)^(https?://|[a-z0-9][a-z0-9._/-]*(\?[^\s]*)?\z)"
# Fallbacks for banners.
BANNER_IMAGE_FALLBACK = "images/banner.jpg"
BANNER_SUBTITLE_FALLBACK = f"Discover this promoted offer on {STORE_NAME}."
HOME_STORES_ANCHOR = "index.html#stores-section"
SAFE_URL_DEFAULT = "index.html"
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank_to_null(x) -> Column:
    """nullif(btrim(x), '') - spaces only, as Postgres btrim."""
    return F.nullif(F.btrim(_c(x)), F.lit(""))


def naira(x) -> Column:
    """K1: '₦' + grouped number with up to 3 decimals."""
    return F.concat(F.lit("₦"), F.call_function("format_number", F.round(_c(x), 3), F.lit("#,##0.###")))


def percent_off(price, original) -> Column:
    """K2: Math.round((1 - price/original) * 100); 0 when original is null/0.
    JS numbers are doubles and Math.round rounds half up, hence floor(x+0.5)."""
    p, o = _c(price).cast("double"), _c(original).cast("double")
    return (F.when(o.isNull() | (o == 0), F.lit(0))
             .otherwise(F.floor((F.lit(1.0) - p / o) * 100 + 0.5)).cast("int"))


def star_parts(rating) -> Column:
    """K3: struct(full, half, empty) of a 5-star display."""
    r = _c(rating).cast("double")
    whole = F.floor(r)
    full = F.greatest(F.lit(0), F.least(F.lit(5), whole)).cast("int")
    # the half star sits on the next of the five places, if there is one
    half = ((r - whole) >= 0.5) & whole.between(0, 4)
    empty = F.lit(5) - full - half.cast("int")
    return F.struct(full.alias("full"), half.alias("half"), empty.alias("empty"))


def json_array_size(x) -> Column:
    """Length of a JSON array, null unless the whole text is one array.
    The JSON functions read the first value and ignore what follows it; put
    into an outer array alone (length 1) and before one more value (length
    2), only a text that is exactly one value gives both lengths."""
    x = _c(x)
    alone = F.json_array_length(F.concat(F.lit("["), x, F.lit("]"))) == 1
    followed = F.json_array_length(F.concat(F.lit("["), x, F.lit(",0]"))) == 2
    return F.when(alone & followed, F.json_array_length(x))


def digits(x) -> Column:
    return F.regexp_replace(_c(x), r"[^0-9]", "")


def phone_e164(x) -> Column:
    """K4: Nigerian phone normalisation; null when not a valid number."""
    inp = F.btrim(F.coalesce(_c(x).cast("string"), F.lit("")))
    d0 = digits(inp)
    d1 = F.when(d0.startswith("00"), F.substring(d0, 3, 1 << 30)).otherwise(d0)
    d2 = F.when(d1.startswith("0") & (F.length(d1) == 11),
                F.concat(F.lit("234"), F.substring(d1, 2, 1 << 30))).otherwise(d1)
    return (F.when(d2.startswith("234") & (F.length(d2) == 13), F.concat(F.lit("+"), d2))
             .when(inp.startswith("+") & F.length(d2).between(8, 15), F.concat(F.lit("+"), d2)))


def wa_digits(x) -> Column:
    """K5: digits of a WhatsApp number, the store number when empty."""
    return digits(F.coalesce(F.nullif(_c(x), F.lit("")), F.lit(DEFAULT_WHATSAPP)))


def uri_component(x) -> Column:
    """K6: encodeURIComponent. url_encode is form encoding, so undo its
    differences: space, and the marks ! ' ( ) ~ that JS leaves alone."""
    e = F.url_encode(_c(x))
    for enc, raw in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        e = F.replace(e, F.lit(enc), F.lit(raw))
    return e


def html_escape(x) -> Column:
    """K7: escape & < > " ' (ampersand first); null becomes ''."""
    e = F.coalesce(_c(x).cast("string"), F.lit(""))
    for ch, rep in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        e = F.replace(e, F.lit(ch), F.lit(rep))
    return e


def trim_white(x) -> Column:
    """The page's trim(): all white space and line ends, not spaces alone."""
    return F.regexp_replace(_c(x), r"^[\s\u00a0\ufeff\p{Z}]+|[\s\u00a0\ufeff\p{Z}]+\z", "")


def safe_url(x, fallback=SAFE_URL_DEFAULT) -> Column:
    """K8: trimmed link if it passes the allow-list, else the fallback."""
    u = trim_white(F.coalesce(_c(x), F.lit("")))
    fb = _c(fallback) if not isinstance(fallback, str) else F.lit(fallback)
    return F.when((u != "") & u.rlike(SAFE_URL_RE), u).otherwise(fb)


def badge_slug(x) -> Column:
    """K9: lower-case, first space only becomes '-'."""
    return F.regexp_replace(F.lower(_c(x)), r"^([^ ]*) ", "$1-")


def display_name(display, name, email) -> Column:
    """Display name, else name, else the local part of the e-mail."""
    return F.coalesce(F.nullif(_c(display), F.lit("")), F.nullif(_c(name), F.lit("")),
                      F.split_part(_c(email), F.lit("@"), F.lit(1)))


def first_name(x) -> Column:
    return F.split_part(_c(x), F.lit(" "), F.lit(1))


def avatar(x) -> Column:
    return F.upper(F.left(_c(x), F.lit(1)))


def long_date(x) -> Column:
    """K11: '5 January 2024'."""
    return F.date_format(_c(x), "d MMMM yyyy")


def email_ok(x) -> Column:
    """Strict newsletter pattern on the lower-cased address."""
    return F.coalesce(F.lower(_c(x)).rlike(EMAIL_STRICT_RE), F.lit(False))


def size_to_product(x) -> Column:
    """Perfume size picker -> product id (null for other sizes)."""
    m = F.create_map(*[F.lit(v) for kv in SIZE_TO_PRODUCT.items() for v in kv])
    return F.try_element_at(m, _c(x))


def scent_match(vibe, occasion, intensity) -> Column:
    """Quiz match percentage."""
    v, o, i = _c(vibe), _c(occasion), _c(intensity)
    return (F.when((v == "mystique") & (o == "evening") & (i == "strong"), 99)
             .when((v == "mystique") | (i == "strong"), 94)
             .when((v == "cozy") | (o == "date"), 89)
             .otherwise(85))


def status_label(x) -> Column:
    """Shopper-facing status label; unknown statuses are shown escaped."""
    m = F.create_map(*[F.lit(v) for kv in STATUS_LABELS.items() for v in kv])
    return F.coalesce(F.try_element_at(m, _c(x)), html_escape(_c(x)))

