"""Parameters of the daily jobs.

Fixed values that must equal the original jobs' for the same results; all of
them can be overridden by keyword argument where they are used.
"""

# --- fixed values -----------------------------------------------------------
NUM_QUERIES = 6            # search queries asked for per event
NUM_URLS = 5               # articles kept per query; search asks for 2 * NUM_URLS
MAX_QUERY_WORDS = 7        # words per query, prompt text only
SAMPLE_TARGET = 210        # events in the daily sample
SAMPLE_SEED = 37           # seed of the stratified pick
MARKET_LIMIT = 6           # events with this many markets or more are skipped
BATCH_SIZE = 70            # events per report workflow slice
ARTICLE_MIN_CHARS = 200    # extracted article length bounds, inclusive
ARTICLE_MAX_CHARS = 100000
LOOKBACK_DAYS = 1          # report look-back of the reconcile, newest first
ACTIVE_MARKET_STATUS = "active"
OPEN_MARKET_STATUSES = ("active", "initialized")
DECIDED_RESULTS = ("yes", "no")
DEFAULT_CATEGORY = "Uncategorized"
REPORT_ID_PREFIX = "ddgs_"
# -----------------------------------------------------------------------------
