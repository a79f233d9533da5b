"""Names, defaults, rates and formats that results depend on."""

from __future__ import annotations

from decimal import Decimal

TENANT = ["restaurant_id", "location_id"]
SALES_KEY = [*TENANT, "date"]

DEFAULT_RESTAURANT_ID = "restaurant_001"
DEFAULT_LOCATION_ID = "location_001"
DEFAULT_SALES_FILE = "upload_sales.csv"

MONEY = "decimal(18,2)"
RATE = "decimal(22,4)"

HORIZON_DAYS = 7
DAILY_GROWTH = Decimal("0.02")
SALES_PER_STAFF = 600
INGREDIENT_RATIO = Decimal("0.45")
MEAL_PRICE = 25
MIN_HISTORY = 2
RECENT_DAYS = 7

# Shape of the prior curve used for tenants without history.
PRIOR_DAYS = 365
PRIOR_BASE = 1200.0
PRIOR_DAILY_STEP = 0.9
PRIOR_WEEK_SWING = 0.2
PRIOR_RIPPLE_RATE = 0.13
PRIOR_RIPPLE_SIZE = 30.0

AVERAGE_MODEL_NAME = "average_daily_sales_model"
AVERAGE_MODEL_VERSION = "1.0"
TREND_MODEL_NAME = "sales_forecast_pro"

INGESTION_STEP = "1_data_ingestion"
PREDICTION_STEP = "5_ml_prediction"
INSIGHT_STEP = "gpt_insight"

# Known step names in run order.
STEP_NAMES = [
    "real_data_ingestion",
    "1_data_ingestion",
    "2_data_warehouse",
    "3_feature_engineering",
    "4_feature_store_sync",
    "model_registry",
    "5_ml_prediction",
    "6_optimization",
    "gpt_insight",
    "7_api_serving",
    "8_dashboard_update",
    "9_model_training",
]

FEATURE_NAMES = [
    "daily_sales_total",
    "hourly_sales_profile",
    "inventory_usage_rate",
    "waste_rate",
    "labor_hours",
]

INSIGHT_KEYS = ["summary", "staffing", "inventory", "waste", "notes", "risk_level", "actions"]

PREVIEW_CHARS = 600
