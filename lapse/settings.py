"""Fixed values and tunables. Everything that was a module global is a field here."""

from __future__ import annotations

from dataclasses import dataclass, field

SEED = 42

# Event types that count as an order.
PURCHASE_TYPES = ("purchase", "transaction", "order")

# Vocabulary maps of the click-stream sources.
REES46_EVENT_TYPES = {
    "view": "view",
    "cart": "cart_add",
    "remove_from_cart": "remove_from_cart",
    "purchase": "purchase",
}
RETAILROCKET_EVENT_TYPES = {
    "view": "view",
    "addtocart": "cart_add",
    "transaction": "purchase",
}
ENGAGEMENT_WEIGHTS = {
    "purchase": 3.0,
    "cart_add": 2.0,
    "view": 1.0,
    "remove_from_cart": 1.0,
}

# Feature groups and the columns each one emits, used by the ablation.
FEATURE_GROUPS = {
    "purchase": ("total_orders", "total_items_purchased", "repeat_purchase_ratio"),
    "monetary": ("total_spent", "avg_order_value", "max_order_value", "min_order_value"),
    "inactivity": ("days_since_last_purchase",),
    "review": (
        "avg_review_score", "min_review_score", "low_review_ratio",
        "positive_review_ratio", "review_variance",
    ),
    "delivery": (
        "avg_delivery_delay_days", "delayed_order_ratio",
        "max_delivery_delay", "on_time_delivery_ratio",
    ),
    "payment": ("avg_payment_installments", "avg_payment_value"),
    "engagement": (
        "total_page_views", "total_cart_adds", "total_sessions",
        "avg_actions_per_session", "total_wishlist_adds",
    ),
    "cadence": ("avg_days_between_orders", "customer_lifetime_days", "avg_orders_per_month"),
}
# The emitted one-hot columns carry a double underscore: prefix, separator, value.
PAYMENT_PREFIX = "pay_type_"

# Sources whose matrix columns differ from the shared groups.
ABLATION_OVERRIDES = {
    "credit_card": {
        "monetization": (
            "Total_Trans_Amt", "Avg_Utilization_Ratio", "Total_Revolving_Bal",
            "Avg_Open_To_Buy", "Credit_Limit", "Total_Trans_Ct",
        ),
        "activity": (
            "Months_Inactive_12_mon", "Contacts_Count_12_mon",
            "Total_Amt_Chng_Q4_Q1", "Total_Ct_Chng_Q4_Q1",
        ),
        "relationship": ("Total_Relationship_Count", "Months_on_book"),
        "demographics": (
            "Gender", "Education_Level_", "Marital_Status_", "Income_Category_", "Card_Category_",
        ),
    },
    "telco": {
        "contract": ("Contract_Month-to-month", "Contract_One year", "Contract_Two year"),
        "usage_charges": ("engagement_signal", "transaction_value", "total_charges"),
        "services": (
            "MultipleLines_", "InternetService_", "OnlineSecurity_", "OnlineBackup_",
            "DeviceProtection_", "TechSupport_", "StreamingTV_", "StreamingMovies_",
            "PhoneService_encoded",
        ),
        "billing": ("PaymentMethod_", "PaperlessBilling_encoded"),
        "demographics": (
            "gender_encoded", "SeniorCitizen", "Partner_encoded", "Dependents_encoded",
        ),
    },
    "olist": {"payment": ("avg_payment_installments", "avg_payment_value", PAYMENT_PREFIX)},
    "retailrocket": {
        "engagement": (
            "total_page_views", "total_cart_adds", "total_sessions", "avg_actions_per_session",
            "total_wishlist_adds", "total_purchases", "total_events",
        ),
    },
}
# Groups the two behavioural sources above really emit.
ABLATION_GROUPS_KEPT = {
    "olist": ("purchase", "monetary", "inactivity", "review", "delivery", "payment", "cadence"),
    "retailrocket": ("purchase", "monetary", "inactivity", "engagement", "cadence"),
}

# Label windows tried by the sensitivity study, in days.
SENSITIVITY_WINDOWS = {
    "olist": (90, 180, 270),
    "rees46": (90, 180, 270),
    "retailrocket": (15, 30, 60),
    "online_retail_ii": (45, 90, 180),
    "instacart": (30, 60, 90),
}

# Warning limits of the validation layers.
THRESHOLDS = {
    "max_lapse_rate": 0.99,
    "min_orders_per_customer": 1.05,
    "max_imbalance_ratio": 100.0,
    "min_repeat_purchase_ratio": 0.01,
    "min_customers": 100,
    "leak_auc": 0.98,
    "min_expected_auc": 0.45,
    "max_calibration_error": 0.25,
}

# Columns of the cross-dataset results table.
MASTER_COLUMNS = (
    "dataset", "ecosystem_type", "model", "roc_auc", "pr_auc", "f1", "precision", "recall",
    "brier_score", "calibration_error", "lapse_rate", "imbalance_ratio", "dominant_feature_group",
)
CRITICAL_METRICS = ("roc_auc", "f1", "lapse_rate")

# Time bounds of the marketplace source.
TIME_MIN = "2016-01-01"
TIME_MAX = "2019-01-01"
OUTLIER_QUANTILE = 0.999


@dataclass(frozen=True)
class ModelSettings:
    """Hyper-parameters of the five classifiers."""

    lr_c: float = 0.1
    lr_max_iter: int = 1000
    rf_trees: int = 200
    rf_depth: int = 10
    rf_min_leaf: int = 20
    gbt_rounds: int = 200
    gbt_depth: int = 5
    gbt_step: float = 0.05
    gbt_subsample: float = 0.8
    gbt_feature_share: float = 0.8
    # Rounds without a better log loss on the validation rows.
    gbt_patience: int = 10
    boost2_rounds: int = 200
    boost2_step: float = 0.1
    boost2_leaves: int = 31
    boost2_min_rows: int = 20
    svm_max_iter: int = 2000
    svm_folds: int = 5
    # Optional row caps for the SVM fit, per source.
    svm_row_caps: dict = field(default_factory=lambda: {"retailrocket": 10_000, "lastfm": 5_000})


@dataclass(frozen=True)
class Settings:
    """Run settings shared by the workflows."""

    seed: int = SEED
    window_days: int = 180
    train_quantile: float = 0.7
    split_ratio: float = 0.7
    validation_share: float = 0.1
    calibration_bins: int = 10
    bootstrap_replicates: int = 200
    # None: every test row is explained, against the means of all of them; a number samples.
    attribution_rows: int | None = None
    attribution_background: int | None = None
    clusters: int = 5
    ablation_folds: int = 3
    ablation_trees: int = 100
    min_train_users: int = 100
    min_test_users: int = 50
    alpha: float = 0.05
    min_group_size: int = 5
    models: ModelSettings = field(default_factory=ModelSettings)
