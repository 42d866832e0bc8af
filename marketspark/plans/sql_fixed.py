"""The fixed output values of functions.expr as DuckDB string literals."""

from ..functions import expr as K


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


STORE = lit(K.STORE_NAME)
WHATSAPP = lit(K.DEFAULT_WHATSAPP)
ORDER_STATUSES = "(" + ", ".join(lit(x) for x in K.ORDER_STATUSES) + ")"
NEW_ORDER = lit(f"🛍️ *NEW ORDER — {K.STORE_NAME}*")
INQUIRY = lit(f"🛍️ *Product Inquiry — {K.STORE_NAME}*")
BANNER_IMG = lit(K.BANNER_IMAGE_FALLBACK)
BANNER_SUB = lit(K.BANNER_SUBTITLE_FALLBACK)
QS = lit(K.QUIZ_STRONG)
QL = lit(K.QUIZ_LIGHT)
HOME_ANCHOR = lit(K.HOME_STORES_ANCHOR)
SAFE_DEFAULT = lit(K.SAFE_URL_DEFAULT)
