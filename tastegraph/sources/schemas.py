"""Explicit schemas of the input files. The files' field names."""

from tastegraph.config import COMPLIMENTS, INTERACTIONS

PAIRS = "user_id string, business_id string"
RATINGS = PAIRS + ", stars double"

BUSINESS = (
    "business_id string, review_count int, stars double, city string, "
    "is_open int, categories string"
)
PHOTO = "business_id string, photo_id string, label string"
REVIEWS = (
    "user_id string, stars double, useful int, funny int, cool int, business_id string"
)
USERS = ", ".join(
    ["user_id string", "review_count bigint", "average_stars double", "fans bigint",
     "friends string"]
    + [f"{name} bigint" for name in INTERACTIONS]
    + [f"compliment_{name} bigint" for name in COMPLIMENTS]
    + ["yelping_since string"]
)

FILES = {
    "business": "business.json",
    "photo": "photo.json",
    "reviews": "review_train.json",
    "users": "user.json",
}
