"""Declared types and fixed values.

Fixed values (must equal the source system's for right results), stated in
natural order:

* Order status members: Confirmed, Shipped, Manifest Scanned, Cancelled,
  Open, Returned.
* Payment mode members: COD, PrePaid.
* Order type members: B2B, B2C, B2B2C.
* Blank/null category label after cleaning: UNKNOWN.
* SKU prefix removed from canonical SKUs: YCE_.
* History column list (22 columns, order as read by the history routes):
  order_id, order_date, total_amount, item_quantity, suborder_quantity,
  order_quantity, sku, canonical_sku, suborder_sku, suborder_marketplace_sku,
  marketplace_sku, suborder_model_no, order_status, payment_mode, order_type,
  state, marketplace, courier, import_warehouse_name, billing_state, size,
  suborder_size.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values -------------------------------------------------------
ORDER_STATUS_VALUES = ["Confirmed", "Shipped", "Manifest Scanned", "Cancelled", "Open", "Returned"]
PAYMENT_MODE_VALUES = ["COD", "PrePaid"]
ORDER_TYPE_VALUES = ["B2B", "B2C", "B2B2C"]
UNKNOWN = "UNKNOWN"
SKU_PREFIX = "YCE_"

HISTORY_COLUMNS = [
    "order_id", "order_date", "total_amount", "item_quantity", "suborder_quantity",
    "order_quantity", "sku", "canonical_sku", "suborder_sku", "suborder_marketplace_sku",
    "marketplace_sku", "suborder_model_no", "order_status", "payment_mode", "order_type",
    "state", "marketplace", "courier", "import_warehouse_name", "billing_state", "size",
    "suborder_size",
]
# ------------------------------------------------------------------------

MONEY = T.DecimalType(18, 4)

# Declared type of every history column; missing columns are added as typed
# nulls at the source so every operator sees one fixed schema.
HISTORY_TYPES: dict[str, T.DataType] = {
    "order_id": T.LongType(),
    "order_date": T.TimestampNTZType(),
    "total_amount": MONEY,
    "item_quantity": T.LongType(),
    "suborder_quantity": T.LongType(),
    "order_quantity": T.LongType(),
    **{c: T.StringType() for c in HISTORY_COLUMNS if c not in {
        "order_id", "order_date", "total_amount", "item_quantity", "suborder_quantity", "order_quantity"}},
}

# Extra columns kept by the history table (used by SKU profiles and joins).
HISTORY_EXTRA_TYPES: dict[str, T.DataType] = {
    "line_no": T.IntegerType(),
    "invoice_id": T.StringType(),
    "pin_code": T.StringType(),
    "raw_sku": T.StringType(),
    "model_no": T.StringType(),
    "product_name": T.StringType(),
    "brand": T.StringType(),
    "mrp": MONEY,
    "cost": MONEY,
    "selling_price": MONEY,
    "load_ts": T.TimestampNTZType(),
}


def suborder_schema() -> T.StructType:
    """Schema of one element of ``suborders[]`` in a nested order document."""
    history = T.StructType([
        T.StructField("inventory_assigned_datetime", T.StringType()),
        T.StructField("qc_pass_datetime", T.StringType()),
        T.StructField("confirm_datetime", T.StringType()),
        T.StructField("manifest_datetime", T.StringType()),
    ])
    items = T.ArrayType(T.StructType([
        T.StructField("cancelled_quantity", T.LongType()),
        T.StructField("returned_quantity", T.LongType()),
    ]))
    return T.StructType([
        T.StructField("sku", T.StringType()),
        T.StructField("marketplace_sku", T.StringType()),
        T.StructField("model_no", T.StringType()),
        T.StructField("productName", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("selling_price", T.StringType()),
        T.StructField("cost", T.StringType()),
        T.StructField("mrp", T.StringType()),
        T.StructField("item_quantity", T.LongType()),
        T.StructField("suborder_quantity", T.LongType()),
        T.StructField("cancelled_quantity", T.LongType()),
        T.StructField("shipped_quantity", T.LongType()),
        T.StructField("returned_quantity", T.LongType()),
        T.StructField("suborder_history", history),
        T.StructField("items", items),
    ])


#: Order-level fields that take precedence over the first suborder's in C4; read as text, whatever they hold.
ORDER_LEVEL_FIELDS = ("item_quantity", "suborder_model_no", "suborder_quantity", "sku", "suborder_sku",
                      "suborder_marketplace_sku", "marketplace_sku", "size", "suborder_size", "suborder_selling_price",
                      "suborder_cost", "suborder_mrp", "suborder_productName", "canonical_sku")


def order_document_schema() -> T.StructType:
    """Declared schema of a nested order document (money and dates as text in)."""
    return T.StructType([
        T.StructField("invoice_id", T.StringType()),
        T.StructField("order_id", T.StringType()),
        T.StructField("order_date", T.StringType()),
        T.StructField("invoice_date", T.StringType()),
        T.StructField("total_amount", T.StringType()),
        T.StructField("total_tax", T.StringType()),
        T.StructField("total_shipping_charge", T.StringType()),
        T.StructField("total_discount", T.StringType()),
        T.StructField("order_quantity", T.LongType()),
        T.StructField("order_status", T.StringType()),
        T.StructField("shipping_status", T.StringType()),
        T.StructField("payment_mode", T.StringType()),
        T.StructField("order_type", T.StringType()),
        T.StructField("marketplace", T.StringType()),
        T.StructField("courier", T.StringType()),
        T.StructField("import_warehouse_name", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("pin_code", T.StringType()),
        T.StructField("billing_state", T.StringType()),
        *(T.StructField(f, T.StringType()) for f in ORDER_LEVEL_FIELDS),
        T.StructField("suborders", T.ArrayType(suborder_schema())),
    ])
