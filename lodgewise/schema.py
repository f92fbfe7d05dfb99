"""Column roles and the constants that must equal the published behaviour."""

from __future__ import annotations

from dataclasses import dataclass, field

# The canonical projection of the bookings table, in order.
BOOKING_COLUMNS = [
    "booking_id",
    "no_show",
    "branch",
    "booking_month",
    "arrival_month",
    "arrival_day",
    "checkout_month",
    "checkout_day",
    "country",
    "first_time",
    "room",
    "price",
    "platform",
    "num_adults",
    "num_children",
]

BOOKING_DDL = (
    "booking_id bigint, no_show int, branch string, booking_month string, arrival_month string, "
    "arrival_day int, checkout_month string, checkout_day int, country string, first_time string, "
    "room string, price string, platform string, num_adults string, num_children string"
)


@dataclass(frozen=True)
class Roles:
    """Which columns feed the model, by treatment. Fixed values."""

    target: str = "no_show"
    key: str = "booking_id"
    numerical: tuple[str, ...] = (
        "price",
        "num_adults",
        "num_children",
        "stay_length",
        "lead_time_months",
        "total_guests",
        "price_per_guest",
        "arrival_month_sin",
        "arrival_month_cos",
        "booking_month_sin",
        "booking_month_cos",
        "arrival_day_sin",
        "arrival_day_cos",
        "checkout_day_sin",
        "checkout_day_cos",
    )
    categorical: tuple[str, ...] = (
        "branch",
        "country",
        "room",
        "platform",
        "booking_month",
        "arrival_month",
    )
    binary: tuple[str, ...] = ("first_time",)

    @property
    def features(self) -> list[str]:
        return [*self.numerical, *self.categorical, *self.binary]


ROLES = Roles()

# Conversion rate, split sizes, seed, row cap for tuning samples.
USD_TO_SGD = 1.34
TEST_SIZE = 0.15
VALIDATION_SIZE = 0.15
SEED = 42
SAMPLE_ROWS = 30_000
CV_FOLDS = 5

# The metrics that gate a release, and their floors.
THRESHOLDS = {"roc_auc": 0.70, "f1_score": 0.60, "precision": 0.60, "recall": 0.60}
METRIC_ALIASES = {"f1": "f1_score"}
DEGRADATION_TOLERANCE = 0.05

# Drift limits.
DRIFT_P_VALUE = 0.05
DRIFT_DISTANCE = 0.1
DATASET_DRIFT_SHARE = 0.5
CRITICAL_DRIFT_SHARE = 0.3


@dataclass(frozen=True)
class ModelDefaults:
    """Tuned parameters per model name. Fixed values."""

    random_forest: dict = field(
        default_factory=lambda: {
            "class_weight": "balanced",
            "max_depth": 22,
            "max_features": 0.8,
            "min_samples_leaf": 7,
            "min_samples_split": 2,
            "n_estimators": 563,
        }
    )
    xgboost: dict = field(
        default_factory=lambda: {
            "colsample_bytree": 0.5498282415664553,
            "gamma": 0.4074896737265574,
            "learning_rate": 0.006252749709729093,
            "max_depth": 12,
            "min_child_weight": 3,
            "n_estimators": 1322,
            "reg_alpha": 5.73881583521897e-07,
            "reg_lambda": 7.71555135891761e-05,
            "scale_pos_weight": 9.081074856792275,
            "subsample": 0.826968577436646,
        }
    )
    lightgbm: dict = field(
        default_factory=lambda: {
            "colsample_bytree": 0.8955547499620482,
            "learning_rate": 0.008725231172308221,
            "max_depth": 15,
            "min_child_samples": 5,
            "n_estimators": 1488,
            "num_leaves": 282,
            "reg_alpha": 0.06125495231451704,
            "reg_lambda": 0.06433398114835744,
            "subsample": 0.8691899553557091,
        }
    )
    neural_network: dict = field(
        default_factory=lambda: {
            "batch_size": 32,
            "epochs": 100,
            "hidden_layers": [361, 348, 414, 125],
            "learning_rate": 0.00019112050481819872,
        }
    )
