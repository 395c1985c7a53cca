"""Values that results depend on, and sizes that only affect speed."""

# Field names, labels, defaults and constants of the data format.
PHOTO_LABELS = ["inside", "outside", "food", "drink"]

COMPLIMENTS = [
    "hot", "more", "profile", "cute", "list", "note",
    "plain", "cool", "funny", "writer", "photos",
]

INTERACTIONS = ["useful", "funny", "cool"]

ITEM_DEFAULTS = {
    "num_photo": 0,
    "bid_num_review": 0,
    "bid_avg_stars": 3.0,
    "bid_var_stars": 0.0,
    "city": "NULL",
    "is_open": 1,
}

USER_DEFAULTS = {
    "uid_num_fans": 0,
    "uid_num_reviews": 0,
    "uid_avg_stars": 3.0,
    "uid_var_stars": 0.0,
    "uid_num_friends": 1,
    **{f"uid_{name}": 0 for name in INTERACTIONS},
    **{f"uid_compliment_{name}": 0 for name in COMPLIMENTS},
    "uid_years_on_site": 4,
}

SIDE_SCORE_DEFAULT = 3.0
AS_OF_YEAR = 2022
HASH_BASE = 131
HASH_MASK = 0x7FFFFFFF
HASH_BUCKETS = 10
USER_SUFFIX = "_uid"
BUSINESS_SUFFIX = "_bid"

LOW_SCORE, HIGH_SCORE = 1.0, 5.0
BLEND_WEIGHTS = (0.4, 0.6)
THREE_WAY_WEIGHTS = (0.8, 0.1, 0.1)
NO_SCORE = -1.0
PROFILE_SIZE = 64              # slots of a profile that neighbours are found by

WALK_LENGTH = 25
NUM_WALKS = 250
RETURN_P = 0.25
IN_OUT_Q = 4.0
VECTOR_SIZE = 200
WINDOW = 15

MODEL1 = {"trees": 400, "depth": 7, "rate": 0.06, "leaves": 100, "l2": 1.0}
MODEL1_FOLDS = 4
MODEL2 = {"trees": 1200, "depth": 7, "rate": 0.06, "symmetric": True, "l2": 3.0}
MODEL2_FOLDS = 10

# Blocks of skip-gram follow these, so they are part of its result.
NODES_PER_BLOCK = 50_000
PAIRS_PER_CELL = 8_000_000    # co-occurrences of two blocks of nodes

# Sizes below change speed and memory only, never a result. A key past the
# MAX_HOT_KEYS heaviest is not sliced (it has under 1/1,024 of the rows), and one of
# more than HOT_ROWS x MAX_SALTS rows has larger slices.
HOT_ROWS = 1_000_000          # rows of one key from which the key is salted
MAX_HOT_KEYS = 1_024          # bound on the broadcast list of salted keys
MAX_SALTS = 4_096             # slices of the hottest key
HOT_SLICES = 1_024            # most ranges in which a hub's neighbours are numbered
LISTED = 64                   # most out-edges of a node that are listed in one row
TRIES_PER_ROUND = 8            # draws a walker makes per round, at most 63
WALKERS_PER_TASK = 1_000_000  # walkers one task starts
EDGES_PER_BUCKET = 4_000_000  # edges in a bucket of the stored edge tables
VECTORS_PER_TASK = 1_000_000  # vectors that a task of the factorisation is sent
VECTORS_PER_BUCKET = 500_000  # vectors in a bucket of a stored vector table
