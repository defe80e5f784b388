"""End-to-end workloads as pipelines of declared systems: report, fulfilment, settlement with a ledger, scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirstone.operators.lookup import mapped
from weirstone.operators.workspace import Workspace
from weirstone.plans.meta import Access
from weirstone.plans.pipeline import Pipeline
from weirstone.plans.retry import Retry
from weirstone.plans.tables import table

#: Exchange rates to dollars, tax by region, stock by product, and the rates and threshold of settlement.
RATES = {"EUR": 1.08, "GBP": 1.27, "JPY": 0.0067, "CAD": 0.74, "USD": 1.0}
TAXES = {"us-east": 0.08, "us-west": 0.095, "eu-west": 0.20, "ap-south": 0.18}
OTHER_TAX = 0.10
STOCK = {f"P{k:03d}": 1000 if k <= 10 else 5 if k <= 15 else 0 for k in range(1, 21)}
SETTLEMENT_RATES = {"EUR": 1.10, "GBP": 1.30, "JPY": 0.0068}
RISK_THRESHOLD = 50_000.0
FRAUD_LIMIT = 0.7


def pick(key: Column, *names: str) -> Column:
    """One of the names by a whole number."""
    return F.element_at(F.array(*map(F.lit, names)), (F.pmod(key, F.lit(len(names))) + 1).cast("int"))


CURRENCIES = ("EUR", "GBP", "JPY", "CAD", "USD", "CHF")
REGIONS = ("us-east", "us-west", "eu-west", "ap-south", "sa-east")


def sql_pick(key: str, names: tuple[str, ...]) -> str:
    return f"([{', '.join(repr(n) for n in names)}])[CAST({key} % {len(names)} AS INTEGER) + 1]"


def sql_map(key: str, values: dict[str, float], default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in values.items()) + f" ELSE {default} END"


# -- report ---------------------------------------------------------------------------------------------------------------


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    amount = F.when(F.col("o_orderkey") % 9 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    return o.select(F.col("o_orderkey").alias("id"), amount.alias("amount"), pick(F.col("o_custkey"), *CURRENCIES).alias("currency"), F.lit(False).alias("valid"), F.lit(0.0).alias("usd_amount"))


def report_pipeline(spark: SparkSession, rows: DataFrame) -> Pipeline:
    """Validation and exchange side by side, then the report over both."""
    ws = Workspace(spark, {"Transaction": rows})
    validate = Access("validate").read("Transaction", "amount").write("Transaction", "valid")
    enrich = Access("enrich").read("Transaction", "amount", "currency").write("Transaction", "usd_amount").read_resource("rates")
    report = Access("report").read("Transaction").write_resource("report")
    ws.insert_resource("rates", RATES)
    p = Pipeline("report", ws)
    p.add_columns(validate, lambda w: {"Transaction": {"valid": F.coalesce(F.col("amount") > 0, F.lit(False))}})
    p.add_columns(enrich, lambda w: {"Transaction": {"usd_amount": F.col("amount") * mapped(F.col("currency"), w.resource("rates"), 1.0)}})

    def total(w: Workspace) -> None:
        good = F.when(F.col("valid"), F.col("usd_amount"))
        n = F.count(good)
        w.insert_resource("report", w["Transaction"].agg(F.count("*").alias("total"), n.alias("valid"), (F.count("*") - n).alias("invalid"), F.round(F.coalesce(F.sum(good), F.lit(0.0)), 2).alias("total_usd"), F.round(F.coalesce(F.avg(good), F.lit(0.0)), 4).alias("avg_usd")))

    return p.add_step(report, total)


def etl_report(spark: SparkSession, folder: str) -> DataFrame:
    p = report_pipeline(spark, transactions(spark, folder))
    p.run()
    return p.workspace.resource("report")


ETL_REPORT = f"""
WITH t AS (SELECT CASE WHEN o_orderkey % 9 = 0 THEN -o_totalprice ELSE o_totalprice END AS amount, {sql_pick('o_custkey', CURRENCIES)} AS currency FROM orders),
u AS (SELECT amount > 0 AS valid, amount * ({sql_map('currency', RATES, '1.0')}) AS usd FROM t)
SELECT count(*) AS total, count(*) FILTER (WHERE valid) AS valid, count(*) - count(*) FILTER (WHERE valid) AS invalid,
       round(coalesce(sum(usd) FILTER (WHERE valid), 0.0), 2) AS total_usd, round(coalesce(avg(usd) FILTER (WHERE valid), 0.0), 4) AS avg_usd FROM u
"""

# -- fulfilment -----------------------------------------------------------------------------------------------------------


def fulfilment_orders(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    empty, zero = F.lit(""), F.lit(0.0)
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.concat(F.lit("C"), F.pmod(F.col("o_custkey"), F.lit(1000)).cast("string")).alias("customer_id"),
        F.concat(F.lit("P"), F.lpad((F.pmod(F.col("o_orderkey"), F.lit(22)) + 1).cast("string"), 3, "0")).alias("product_id"),
        (F.pmod(F.col("o_orderkey"), F.lit(8)) - 1).cast("bigint").alias("quantity"),
        (F.call_function("div", F.round(F.col("o_totalprice") * 100).cast("bigint"), F.lit(50)) / 100).alias("amount_original"),
        pick(F.col("o_custkey"), *CURRENCIES).alias("currency"),
        zero.alias("amount_usd"),
        pick(F.col("o_orderkey"), *REGIONS).alias("region"),
        zero.alias("fraud_score"),
        zero.alias("tax_rate"),
        zero.alias("tax_amount"),
        empty.alias("validation_status"),
        empty.alias("inventory_status"),
        empty.alias("processing_status"),
    )


def fulfilment_pipeline(spark: SparkSession, rows: DataFrame) -> Pipeline:
    """Seven systems: three on the input, stock and tax on their results, approval, invoices."""
    ws = Workspace(spark, {"Order": rows})
    p = Pipeline("fulfilment", ws)

    def columns(name: str, reads: list[str], writes: dict[str, Column]) -> None:
        p.add_columns(Access(name).read("Order", *reads).write("Order", *writes), lambda w: {"Order": writes})

    c = F.col
    number = F.coalesce(F.regexp_replace("customer_id", "^C+", "").try_cast("int"), F.lit(0))
    score = F.when(c("amount_original") > 2000, 0.35).otherwise(0.0) + F.when(number.between(800, 900), 0.40).otherwise(0.0) + F.when(c("amount_original") > 4000, 0.20).otherwise(0.0)
    columns("validate", ["amount_original", "quantity"], {"validation_status": F.when((c("amount_original") > 0) & (c("quantity") > 0), "valid").otherwise("invalid")})
    columns("fraud", ["amount_original", "customer_id"], {"fraud_score": F.least(score, F.lit(1.0))})
    columns("exchange", ["amount_original", "currency"], {"amount_usd": c("amount_original") * mapped(c("currency"), RATES, 1.0)})
    stock = mapped(c("product_id"), STOCK, 0)
    columns("inventory", ["validation_status", "product_id", "quantity"], {"inventory_status": F.when(c("validation_status") != "valid", "pending").when(stock >= c("quantity"), "available").when(stock > 0, "low_stock").otherwise("out_of_stock")})
    good = (c("validation_status") == "valid") & c("inventory_status").isin("available", "low_stock") & (c("fraud_score") < FRAUD_LIMIT)
    columns("approve", ["validation_status", "inventory_status", "fraud_score"], {"processing_status": F.when(good, "approved").otherwise("rejected")})
    tax = mapped(c("region"), TAXES, OTHER_TAX)
    columns("tax", ["region", "amount_usd"], {"tax_rate": tax, "tax_amount": c("amount_usd") * tax})

    def invoices(w: Workspace) -> None:
        done = c("processing_status") == "approved"
        amount = lambda x: F.when(done, x).otherwise(0.0)
        rows = w["Order"].select(
            c("id").alias("order_id"), amount(c("amount_usd")).alias("subtotal"), amount(c("tax_rate")).alias("tax_rate"), amount(c("tax_amount")).alias("tax_amount"),
            amount(c("amount_usd") + c("tax_amount")).alias("total"), F.when(done, "issued").otherwise("skipped").alias("status"),
        )
        w.register("Invoice", rows.schema)
        w.replace("Invoice", rows)

    return p.add_step(Access("invoice").read("Order").write_resource("invoices"), invoices, retry=Retry.fixed(3, 50))


def fulfillment_invoice(spark: SparkSession, folder: str) -> DataFrame:
    p = fulfilment_pipeline(spark, fulfilment_orders(spark, folder))
    p.run()
    return p.workspace["Invoice"]


FULFILLMENT = f"""
WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_custkey % 1000 AS cust, 'P' || lpad(CAST(o_orderkey % 22 + 1 AS VARCHAR), 3, '0') AS product, o_orderkey % 8 - 1 AS quantity,
  CAST(CAST(round(o_totalprice * 100) AS BIGINT) // 50 AS DOUBLE) / 100 AS amount, {sql_pick('o_custkey', CURRENCIES)} AS currency, {sql_pick('o_orderkey', REGIONS)} AS region FROM orders),
s AS (SELECT *, amount > 0 AND quantity > 0 AS valid, least(CASE WHEN amount > 2000 THEN 0.35 ELSE 0.0 END + CASE WHEN cust BETWEEN 800 AND 900 THEN 0.40 ELSE 0.0 END + CASE WHEN amount > 4000 THEN 0.20 ELSE 0.0 END, 1.0) AS fraud,
  amount * ({sql_map('currency', RATES, '1.0')}) AS usd, {sql_map('product', STOCK, '0.0')} AS stock, {sql_map('region', TAXES, str(OTHER_TAX))} AS rate FROM o),
d AS (SELECT *, valid AND (stock >= quantity OR stock > 0) AND fraud < {FRAUD_LIMIT} AS done FROM s)
SELECT id AS order_id, CASE WHEN done THEN usd ELSE 0.0 END AS subtotal, CASE WHEN done THEN rate ELSE 0.0 END AS tax_rate, CASE WHEN done THEN usd * rate ELSE 0.0 END AS tax_amount,
  CASE WHEN done THEN usd + usd * rate ELSE 0.0 END AS total, CASE WHEN done THEN 'issued' ELSE 'skipped' END AS status FROM d
"""

# -- settlement -----------------------------------------------------------------------------------------------------------


def settlement_orders(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        pick(F.col("o_orderkey"), *REGIONS).alias("region"),
        pick(F.col("o_custkey"), "EUR", "GBP", "JPY", "USD").alias("currency"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit(-5.0)).otherwise(F.col("o_totalprice")).alias("amount"),
        F.lit(False).alias("valid"),
        F.lit(0.0).alias("usd_amount"),
        F.lit(0.0).alias("risk_score"),
        F.lit(False).alias("flagged"),
        F.lit("").alias("settlement"),
    )


def settlement_pipeline(spark: SparkSession, rows: DataFrame) -> Pipeline:
    """Validation, exchange, risk, settlement: each on the one before."""
    ws = Workspace(spark, {"Order": rows})
    p, c = Pipeline("settlement", ws), F.col
    usd = F.when(c("valid"), c("amount") * mapped(c("currency"), SETTLEMENT_RATES, 1.0)).otherwise(0.0)
    risk = F.when(c("valid"), c("usd_amount") / RISK_THRESHOLD).otherwise(0.0)
    final = F.when(~c("valid"), "REJECTED").when(c("flagged"), "HOLD").otherwise("SETTLED")
    p.add_columns(Access("validate").read("Order", "amount").write("Order", "valid"), lambda w: {"Order": {"valid": F.coalesce(c("amount") > 0, F.lit(False))}})
    p.add_columns(Access("exchange").read("Order", "valid", "amount", "currency").write("Order", "usd_amount"), lambda w: {"Order": {"usd_amount": usd}})
    p.add_columns(Access("risk").read("Order", "valid", "usd_amount").write("Order", "risk_score", "flagged"), lambda w: {"Order": {"risk_score": risk, "flagged": risk >= 1.0}})
    p.add_columns(Access("settle").read("Order", "valid", "flagged").write("Order", "settlement"), lambda w: {"Order": {"settlement": final}})
    return p


def ledger(orders: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """settled_count and settled_usd of settled orders, on top of an earlier ledger."""
    new = orders.where("settlement = 'SETTLED'").agg(F.count("*").alias("settled_count"), F.coalesce(F.sum("usd_amount"), F.lit(0.0)).alias("settled_usd"))
    return new if prior is None else new.unionByName(prior).agg(F.sum("settled_count").alias("settled_count"), F.sum("settled_usd").alias("settled_usd"))


def order_settlement(spark: SparkSession, folder: str) -> DataFrame:
    p = settlement_pipeline(spark, settlement_orders(spark, folder))
    p.run()
    return p.workspace["Order"]


SETTLED = f"""
WITH o AS (SELECT o_orderkey AS id, {sql_pick('o_orderkey', REGIONS)} AS region, {sql_pick('o_custkey', ('EUR', 'GBP', 'JPY', 'USD'))} AS currency, CASE WHEN o_orderkey % 7 = 0 THEN -5.0 ELSE o_totalprice END AS amount FROM orders),
u AS (SELECT *, amount > 0 AS valid, CASE WHEN amount > 0 THEN amount * ({sql_map('currency', SETTLEMENT_RATES, '1.0')}) ELSE 0.0 END AS usd FROM o),
s AS (SELECT id, region, currency, amount, valid, usd, usd / {RISK_THRESHOLD} AS risk, usd / {RISK_THRESHOLD} >= 1.0 AS flagged FROM u),
f AS (SELECT *, CASE WHEN NOT valid THEN 'REJECTED' WHEN flagged THEN 'HOLD' ELSE 'SETTLED' END AS settlement FROM s)
"""


def ledger_state(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger after two batches, odd orders and then even ones."""
    rows, state = settlement_orders(spark, folder), None
    for half in (1, 0):
        p = settlement_pipeline(spark, rows.where(F.col("id") % 2 == half))
        p.run()
        state = ledger(p.workspace["Order"], state)
    return state.withColumn("settled_usd", F.round("settled_usd", 2))


def scale_round(spark: SparkSession, folder: str) -> DataFrame:
    """Prices times 1.1, rounded half away from zero."""
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * 1.1).alias("price"))
    return rows.select("l_orderkey", "l_linenumber", F.round("price", 6).alias("price"), F.round(F.col("price")).cast("bigint").alias("rounded"))


QUERIES = {"etl_report": etl_report, "fulfillment_invoice": fulfillment_invoice, "order_settlement": order_settlement, "ledger_state": ledger_state, "scale_round": scale_round}
ORACLES = {
    "etl_report": ETL_REPORT,
    "fulfillment_invoice": FULFILLMENT,
    "order_settlement": SETTLED + "SELECT id, region, currency, amount, valid, usd AS usd_amount, risk AS risk_score, flagged, settlement FROM f",
    "ledger_state": SETTLED + "SELECT CAST(count(*) AS BIGINT) AS settled_count, round(sum(usd), 2) AS settled_usd FROM f WHERE settlement = 'SETTLED'",
    "scale_round": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * 1.1::DOUBLE, 6) AS price, CAST(round(l_extendedprice * 1.1::DOUBLE) AS BIGINT) AS rounded FROM lineitem",
}
