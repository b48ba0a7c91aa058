"""What column names say about a column."""

from __future__ import annotations

import re

# Names that mark an identifier or code.
ID_NAME = re.compile(
    r"(^id$|_id$|^id_|row.?id|order.?id|trans(action)?.?id|invoice.?id|"
    r"product.?id|customer.?id|user.?id|employee.?id|item.?id|ticket.?id|"
    r"account.?id|session.?id|record.?id|"
    r"index$|^idx$|^pk$|^fk$|^key$|^sk$|serial|"
    r"postal.?code|zip.?code|^zip$|pin.?code|area.?code|"
    r"phone|fax|^tel$|mobile|"
    r"ssn|^ein$|^tin$|license|passport|"
    r"^code$|_code$|^no$|_no$|^num$|_num$|number$)"
)

# Words that name money in narrative text.
MONEY_WORDS = (
    "revenue", "sales", "amount", "price", "total", "cost", "profit", "income", "value",
)

# Words that pick the source columns of features.
FEATURE_REVENUE_WORDS = ("revenue", "sales", "amount", "total", "price")
FEATURE_QUANTITY_WORDS = ("quantity", "qty", "count", "units")
FEATURE_CUSTOMER_WORDS = ("customer", "client", "user")

# Words that pick the source columns of suggested KPIs.
KPI_REVENUE_WORDS = ("revenue", "sales", "amount", "price", "total", "value")
KPI_CUSTOMER_WORDS = ("customer", "client", "user", "buyer")
KPI_REGION_WORDS = ("region", "country", "city", "state", "location")
KPI_PRODUCT_WORDS = ("product", "item", "sku", "category")


def looks_like_id(name: str) -> bool:
    return ID_NAME.search(name.lower().strip()) is not None


def mentions(name: str, words: tuple[str, ...]) -> bool:
    return any(w in name.lower() for w in words)


def pick(names: list[str], words: tuple[str, ...]) -> list[str]:
    return [n for n in names if mentions(n, words)]


def money_prefix(name: str) -> str:
    return "$" if mentions(name, MONEY_WORDS) else ""


def standard_name(name: str) -> str:
    """Lower case, runs of anything but letters and digits become one underscore."""
    return re.sub(r"[^a-z0-9]+", "_", name.lower().strip()).strip("_")
