"""Fixed parameters of the retail analytics contract.

Fixed values: these must equal the contract's thresholds, labels and groups
for results to match.  They are stated together, in their natural order.
"""

# --- fixed values -----------------------------------------------------------
EFFICIENCY_BINS = [0.0, 0.8, 1.2, float("inf")]
EFFICIENCY_LABELS = ["Undersupplied", "Balanced", "Oversupplied"]
EFFICIENCY_NA = "N/A"
STAGNANT_BINS = [90, 180, 365, float("inf")]
STAGNANT_LABELS = ["3-6 months", "6-12 months", ">1 year"]
NO_SALE_DAYS = 99999
RESTOCK_THRESHOLD = 10
PARETO_THRESHOLD = 80
FORECAST_HORIZON_DAILY = 14
SEASON_DAILY = 7
FORECAST_HORIZON_MONTHLY = 6
SEASON_MONTHLY = 12
MIN_MONTHLY_OBS = 12
MIN_DAILY_OBS = 360
DAILY_LAGS = [1, 2, 3, 7, 14, 21, 28, 30, 60, 90]
MONTHLY_MAX_LAG = 12
TOP_N = 20
TOP_SHARE_N = 10
BOTTOM_N = 10
HISTOGRAM_N = 15
TOP_SUPPLIERS_N = 20
RECENT_DAYS = 90
EPS = 1e-6
BUY_INVOICE_TYPE = "Stocks\\Models\\BuyInvoice"
OPEN_STATUSES = [0.0, 2.0]
UNKNOWN_PRODUCT = "Unknown Product"
NULL_PRODUCT_KEY = "nan"
OTHER_LABEL = "Other"
LANGUAGES = ["en", "ar"]
DEFAULT_LANGUAGE = "en"
# refresh groups: which figures a frequency bundle serves
REFRESH_GROUPS = {
    "daily": ["fig11", "fig17"],
    "weekly": ["fig1", "fig4", "fig9"],
    "monthly": ["fig2", "fig3", "fig5", "fig6", "fig7", "fig10", "fig12", "fig13", "fig15", "fig16"],
    "quarterly": ["fig14"],
}
FIGURES = ["fig1", "fig2", "fig3", "fig4", "fig5", "fig6", "fig7", "fig9", "fig10",
           "fig11", "fig12", "fig13", "fig14", "fig15", "fig16", "fig17"]
REQUIRED_COLUMNS = {
    "products": ["id", "name", "buyPrice", "salePrice", "quantity", "client_id"],
    "sale_invoices": ["id", "created_at", "totalPrice", "client_id"],
    "sale_invoices_details": ["id", "product_id", "invoice_id", "quantity", "totalPrice", "buyPrice", "created_at"],
    "invoice_deferreds": ["invoice_type", "status", "amount", "paid_amount", "user_id", "client_id"],
}
# ---------------------------------------------------------------------------
