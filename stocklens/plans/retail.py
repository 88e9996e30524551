"""The retail job as a lazy DataFrame graph (query lifecycle A of the survey).

``Retail`` wires sources -> cleaning -> analytics; every property is a lazy
DataFrame, so one action plans exactly the part it needs (Catalyst prunes the
rest). ``persist_core`` pins the table most figures share.
"""

from __future__ import annotations

import datetime as _dt
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from stocklens import params
from stocklens.operators import analytics, charts, cleaning, features, flow, forecast, serving, status
from stocklens.sources import tables

# as_of used for the driver's tables (their sales end in 2001).
TPCH_AS_OF = _dt.date(2001, 12, 31)


class Retail:
    def __init__(self, raw: dict[str, DataFrame], as_of, days_mode: str = "floor", holidays: DataFrame | None = None,
                 first_holiday_year: int = features.FIRST_HOLIDAY_YEAR):
        self.raw = raw
        self.as_of = as_of
        self.days_mode = days_mode
        self.holiday_table = holidays
        self.first_holiday_year = first_holiday_year
        self.drops: cleaning.Drops | None = None

    @classmethod
    def from_tpch(cls, spark: SparkSession, sf_dir: str, as_of=TPCH_AS_OF, **kw) -> Retail:
        return cls(tables.tpch_retail_tables(spark, sf_dir), as_of, **kw)

    @classmethod
    def from_source(cls, spark: SparkSession, src: str, as_of, client_ids=None,
                    fmt: str = "parquet", options: dict | None = None, pattern: str = "{table}",
                    **kw) -> Retail:
        return cls(tables.read_tables(spark, src, client_ids, fmt, options, pattern), as_of, **kw)

    # --- cleaned tables ---------------------------------------------------------
    @cached_property
    def products(self) -> DataFrame:
        return cleaning.clean_products(self.raw["products"])

    @cached_property
    def invoices(self) -> DataFrame:
        return cleaning.clean_invoices(self.raw["sale_invoices"], self.drops)

    @cached_property
    def details(self) -> DataFrame:
        scoped = tables.scope_details(self.raw["sale_invoices_details"], self.raw["sale_invoices"])
        return cleaning.clean_details(scoped, self.drops)

    @cached_property
    def deferreds(self) -> DataFrame:
        return cleaning.clean_deferreds(self.raw["invoice_deferreds"])

    # --- analytics --------------------------------------------------------------
    @cached_property
    def product_flow(self) -> DataFrame:
        return flow.product_flow(self.details, self.products, self.as_of, self.days_mode)

    @cached_property
    def pareto(self) -> DataFrame:
        return analytics.pareto(self.product_flow)

    @cached_property
    def revenue_share(self) -> DataFrame:
        return analytics.top_share(self.product_flow, "sales_amount")

    @cached_property
    def profit_share(self) -> DataFrame:
        return analytics.top_share(self.product_flow, "net_profit")

    @cached_property
    def stagnant(self) -> DataFrame:
        return analytics.stagnant(self.product_flow)

    @cached_property
    def outstanding(self) -> DataFrame:
        return analytics.outstanding(self.deferreds)

    @cached_property
    def monthly_avg_invoice(self) -> DataFrame:
        return analytics.monthly_avg_invoice(self.invoices)

    @cached_property
    def daily_sales_actual(self) -> DataFrame:
        return analytics.daily_sales_actual(self.details)

    @cached_property
    def daily_profit(self) -> DataFrame:
        return analytics.daily_profit(self.details)

    @cached_property
    def stock_table(self) -> DataFrame:
        return analytics.stock_table(self.products)

    # --- features -------------------------------------------------------------------
    @cached_property
    def holidays(self):
        """The given ``(holiday_date, name)`` table, else the contract's fixed and movable
        holidays over its year window."""
        if self.holiday_table is not None:
            return self.holiday_table
        return features.HolidayRule(*features.holiday_years(self.as_of, self.first_holiday_year))

    # The feature tables hold one row per client per day/month (bounded by the calendar).
    # Within one query the history and future branches share their exchanges, so they
    # are not persisted: nothing cached outlives the query that used it.
    @cached_property
    def daily_features(self) -> DataFrame:
        return features.daily_features(self.details, self.holidays)

    @cached_property
    def monthly_features(self) -> DataFrame:
        return features.monthly_features(self.monthly_avg_invoice)

    def unpersist(self) -> None:
        for df in self.__dict__.pop("_persisted", []):
            df.unpersist()
        if "product_flow" in self.__dict__:
            self.product_flow.unpersist()

    # --- forecasts ----------------------------------------------------------------
    @cached_property
    def naive_daily(self) -> DataFrame:
        return forecast.seasonal_naive(self.daily_features, "sale_date", "daily_sales",
                                       params.SEASON_DAILY, params.FORECAST_HORIZON_DAILY)

    @cached_property
    def naive_monthly(self) -> DataFrame:
        return forecast.seasonal_naive(self.monthly_features, "month_start", "avg_invoice_value",
                                       params.SEASON_MONTHLY, params.FORECAST_HORIZON_MONTHLY, step="month")

    @cached_property
    def forecast_daily(self) -> DataFrame:
        return forecast.forecast_daily(self.daily_features)

    @cached_property
    def forecast_monthly(self) -> DataFrame:
        return forecast.forecast_monthly(self.monthly_features)

    @cached_property
    def regression_daily(self) -> DataFrame:
        return forecast.regression_daily(self.daily_features, self.holidays)

    @cached_property
    def regression_monthly(self) -> DataFrame:
        return forecast.regression_monthly(self.monthly_features)

    @cached_property
    def fig11_naive(self) -> DataFrame:
        """Chart 11 rows with the seasonal-naive forecast (exactly checkable)."""
        return serving.fig11_rows(self.daily_sales_actual, self.naive_daily)

    @cached_property
    def fig11(self) -> DataFrame:
        return serving.fig11_rows(self.daily_sales_actual, self.forecast_daily)

    @cached_property
    def fig12(self) -> DataFrame:
        return serving.fig12_rows(self.monthly_avg_invoice, self.forecast_monthly)

    # --- eligibility --------------------------------------------------------------
    @cached_property
    def clients(self) -> DataFrame:
        return (self.invoices.select("client_id").union(self.products.select("client_id"))
                .distinct())

    @cached_property
    def chart_status(self) -> DataFrame:
        from stocklens.session import settle
        self.pin("details", "product_flow")
        shares = charts.share_table(self.revenue_share, self.profit_share)
        pareto = analytics.pareto(self.product_flow, carry=())     # only counted
        stats = status.client_stats(self.clients, self.product_flow, pareto, shares, self.details,
                                    self.daily_features, self.monthly_avg_invoice, self.deferreds,
                                    self.outstanding, keep=settle)
        return status.chart_status(stats)

    def pin(self, *names: str) -> Retail:
        """Write tables that one output reads many times as Parquet into the shared
        ``spark.checkpoint.dir``, once per job, and read them back: the source joins and the
        aggregate run once, whichever columns the readers need."""
        from stocklens.session import settle
        for name in names:
            pinned = self.__dict__.setdefault("_pinned", set())
            if name in pinned or "staged_at" in self.__dict__:
                continue
            self.__dict__[name] = settle(getattr(self, name), name)
            pinned.add(name)
        return self

    def stage(self, path: str | None = None) -> Retail:
        """Write the cleaned tables once (Parquet, in the cluster's shared
        ``spark.checkpoint.dir`` unless ``path`` is given), then the tables that several
        outputs read (product flow, features, forecasts), and read them back: every later
        table scans a compact columnar copy instead of re-running the source joins. Cuts
        lineage: a lost executor re-reads files, not the sources."""
        import uuid

        from stocklens.session import ensure_checkpoint_dir
        spark = self.raw["sale_invoices"].sparkSession
        root = (path or ensure_checkpoint_dir(spark)).rstrip("/") + f"/stocklens-stage-{uuid.uuid4().hex[:12]}"
        self.drops = cleaning.Drops()              # counted while the cleaned tables are written
        for name in ("invoices", "details"):       # also if they were read before, without counters
            self.__dict__.pop(name, None)
        for name in ("invoices", "details", "products", "deferreds", "product_flow", "daily_sales_actual",
                     "monthly_avg_invoice", "daily_features", "monthly_features", "forecast_daily", "forecast_monthly"):
            getattr(self, name).write.mode("overwrite").parquet(f"{root}/{name}")
            self.__dict__[name] = spark.read.parquet(f"{root}/{name}")
            if name == "invoices":
                self.drops.check("sale_invoices")  # CLN-09: no valid date is an error, before anything is derived
        self.__dict__["staged_at"] = root
        return self

    def persist_core(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Retail:
        """Pin product_flow (read by most figures). Recomputed from lineage if an
        executor is lost, so it is safe on a cluster."""
        self.__dict__["product_flow"] = self.product_flow.persist(level)
        self.__dict__.setdefault("_persisted", []).append(self.__dict__["product_flow"])
        return self
