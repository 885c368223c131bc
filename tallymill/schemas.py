"""Column types of every table, as DDL strings.

Quantities are decimal(20,6); sums and money keep decimal(38,6). Rating narrows
its inputs to decimal(24,6) x decimal(13,6), whose product is exact in 38 digits.
"""

QTY = "decimal(20,6)"
SUM = "decimal(38,6)"
RATED_QTY = "decimal(24,6)"
PRICE = "decimal(13,6)"
MONEY = "decimal(38,2)"

KEY = ["tenant_id", "metric", "customer_ref"]
CKEY = KEY + ["period_start"]

EVENTS = (
    f"tenant_id string, metric string, customer_ref string, resource_id string, quantity {QTY}, "
    "ts timestamp, meta string, idempotency_key string, source string"
)
LEDGER = EVENTS + ", inserted_at timestamp, period_start date"

COUNTERS = (
    "tenant_id string, metric string, customer_ref string, period_start date, period_end date, "
    f"agg_sum {SUM}, agg_max {QTY}, agg_last {QTY}, watermark_ts timestamp"
)
ADJUSTMENTS = (
    "id string, tenant_id string, metric string, customer_ref string, period_start date, "
    f"delta {QTY}, reason string, actor string, status string, approved_by string, reverted_by string, "
    "parent_adjustment_id string, request_id string, note string, approved_at timestamp, "
    "reverted_at timestamp, created_at timestamp"
)
MAPPINGS = (
    "id string, tenant_id string, metric string, aggregation string, stripe_account string, "
    "price_id string, subscription_item_id string, currency string, active boolean, shadow boolean, "
    "shadow_stripe_account string, shadow_price_id string, shadow_subscription_item_id string"
)
WRITE_LOG = (
    "tenant_id string, stripe_account string, subscription_item_id string, period_start date, "
    f"pushed_total {SUM}, last_request_id string, updated_at timestamp"
)
BILLED_USAGE = f"tenant_id string, subscription_item_id string, period_start date, total_usage {SUM}"
ALERT_CONFIGS = (
    f"id string, tenant_id string, customer_ref string, metric string, type string, threshold {QTY}, "
    "action string, config string, enabled boolean"
)
METRIC_SETTINGS = (
    "tenant_id string, metric string, counter_name string, key_fields array<string>, "
    "lateness_seconds bigint, period_kind string"
)

TIER = f"struct<up_to:{RATED_QTY},unit_price:{PRICE},flat_price:{PRICE}>"
PRICE_CONFIG = (
    f"struct<model:string,currency:string,tiers:array<{TIER}>,unit_price:{PRICE},"
    f"package_size:{RATED_QTY},minimum_charge:{RATED_QTY},maximum_charge:{RATED_QTY}>"
)
PRICE_CONFIGS = f"tenant_id string, metric string, price_config {PRICE_CONFIG}"

LINE = f"struct<metric:string,quantity:{RATED_QTY},unit_price:{MONEY},subtotal:{MONEY}>"
SCENARIO_FILE = (
    "metadata struct<name:string,description:string,version:string>, "
    "inputs struct<customerId:string,periodStart:string,periodEnd:string,"
    f"usageItems:array<struct<metric:string,quantity:{RATED_QTY},priceConfig:struct<model:string,currency:string,"
    f"tiers:array<struct<upTo:{RATED_QTY},unitPrice:{PRICE},flatPrice:{PRICE}>>,unitPrice:{PRICE},"
    f"packageSize:{RATED_QTY},minimumCharge:{RATED_QTY},maximumCharge:{RATED_QTY}>>>,"
    f"commitments:array<struct<amount:{RATED_QTY},startDate:string,endDate:string,applied:{RATED_QTY}>>,"
    f"credits:array<struct<amount:{RATED_QTY},reason:string,expiresAt:string>>,taxRate:double>, "
    "expected struct<subtotal:decimal(24,6),tax:decimal(24,6),total:decimal(24,6),currency:string,"
    "lineItems:array<struct<metric:string,quantity:decimal(24,6),unitPrice:decimal(24,6),subtotal:decimal(24,6)>>>, "
    "tolerances struct<absolute:double,relative:double>"
)
EXPECTED_FILE = (
    "subtotal decimal(24,6), tax decimal(24,6), total decimal(24,6), currency string, "
    "lineItems array<struct<metric:string,quantity:decimal(24,6),unitPrice:decimal(24,6),subtotal:decimal(24,6)>>"
)

# The closed sets of the data model.
SOURCES = ["sdk", "http", "etl", "import", "system"]
AGGREGATIONS = ["sum", "max", "last"]
PRICE_MODELS = ["tiered", "volume", "graduated", "flat", "package"]
ADJUSTMENT_REASONS = ["backfill", "correction", "promo", "credit", "manual"]
ALERT_TYPES = ["threshold", "spike", "budget"]
ALERT_ACTIONS = ["email", "webhook", "slack", "hard_cap", "soft_cap"]
OPERATION_STATUSES = ["pending", "processing", "completed", "failed", "cancelled"]
RECON_EPSILON = 0.005
