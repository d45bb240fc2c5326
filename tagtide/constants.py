"""Fixed values of the activity rules.

Everything in this file is a published constant of the domain: changing one
changes the figures. Callers override them through function parameters.
"""

# Report windows, label -> length in seconds.
WINDOWS = {"5m": 300, "1h": 3600, "24h": 86_400}
HOUR = 3600
DAY = 86_400
WEEK = 7 * DAY

# Polling tiers, in priority order, with the interval each one asks for.
TIER_SECONDS = {"hot": 60, "warm": 300, "cold": 1800}
TIER_RANK = {"hot": 0, "warm": 1, "cold": 2}
MAX_HOT = 3
MAX_WARM = 40
QUERY_FRESH_SECONDS = 900

# Tracked set and promotion gates.
MAX_TRACKED = 50
MIN_AUTHORS = 5
MIN_ORIGIN_SERVERS = 3
MAX_AUTHORS_PER_SERVER = 5
TAG_SPAM_MEAN_TAGS = 10
QUEUE_LIMIT = 50
CANDIDATE_LIMIT = 100
LISTED_CANDIDATES = 60

# Retirement.
QUIET_SECONDS = WEEK
GRACE_SECONDS = DAY
MIN_POSTS_TO_JUDGE = 20
QUERY_PROTECTION_SECONDS = DAY

# Coverage and comparability.
GOOD_SHARE = 0.5
PARTIAL_SHARE = 0.2
MIN_COMPARABLE_SHARE = 0.6
MAX_COVERAGE_DRIFT = 0.25

# Direction calls.
FLAT_BAND = 0.1
MIN_AUTHORS_FOR_DIRECTION = 5
TRENDING_DEFAULT = 5
TRENDING_MAX = 10

# Reading a candidate.
FEW_AUTHORS = 10
REPETITIVE_POSTS_PER_AUTHOR = 5
MAX_REQUEST_TAGS = 10
MAX_COMPARED_TAGS = 4
MAX_TAG_LENGTH = 100

# Polling.
REQUEST_BUDGET = 43
TAGS_PER_BATCH = 4
BYTE_BUDGET = 2_000_000
WAVE_SIZE = 6
HEADROOM_FLOOR = 30
PAGE_LIMIT = 40
CRON_SECONDS = 300
CANDIDATE_WRITES = 60

# Server health.
BACKOFF_BASE_SECONDS = 60
BACKOFF_CAP_SECONDS = 3600
REFUSED_STATUSES = (401, 403, 422)
MASK_BITS = 63
REPROBE_SECONDS = WEEK
COUNTER_SOURCES = 2
COUNTER_FRESH_SECONDS = 6 * HOUR

# Retention.
OBSERVATION_HOURS = 25
POOL_HOURS = 48
POLL_LOG_DAYS = 7
ROLLUP_DAYS = 30

# Enumerations.
CLAIMS = ("rising", "falling", "busy", "quiet", "in_use", "unused")
NETWORK_SCOPE = "fediverse"
INDEX_SCOPE = "index"

# Software names known to speak the federation protocol.
FEDERATING_SOFTWARE = (
    "mastodon", "hometown", "glitchsoc", "pleroma", "akkoma", "misskey",
    "sharkey", "firefish", "iceshrimp", "gotosocial", "pixelfed", "peertube",
    "lemmy", "mbin", "kbin", "friendica", "hubzilla", "bookwyrm",
    "writefreely", "funkwhale", "castopod", "wordpress",
)

# Paths a collector needs; a robots file closing either one is an opt-out.
COLLECTION_PATHS = ("/api/v1/timelines/tag/", "/api/v1/tags/")
ROBOTS_MAX_CHARS = 100_000
COLLECTOR_TOKEN = "tagtide"
