"""Schemas of the job inputs and state tables (Spark DDL)."""

API_MARKET_FIELDS = (
    "ticker string, event_ticker string, title string, subtitle string, yes_sub_title string, "
    "no_sub_title string, rules_primary string, rules_secondary string, open_time string, "
    "close_time string, expiration_time string, status string, result string, "
    "response_price_units string, yes_bid int, yes_ask int, no_bid int, no_ask int, "
    "last_price int, volume bigint, liquidity bigint"
)
API_MARKET = f"struct<{API_MARKET_FIELDS.replace(' string', ':string').replace(' int', ':int').replace(' bigint', ':bigint')}>"

# One event of the open-events feed; feed_pos is the position in the day's feed.
API_EVENT = (
    "event_ticker string, series_ticker string, title string, sub_title string, "
    f"mutually_exclusive boolean, category string, status string, feed_pos bigint, markets array<{API_MARKET}>"
)

# Event detail of a single event (fetched for dropped events).
EVENT_DETAIL = f"event_ticker string, title string, category string, markets array<{API_MARKET}>"

# Active-event state. (added_on, feed_pos) is the list order: retained events
# keep theirs, new events get (today, position in today's feed).
ACTIVE_EVENTS = (
    "event_ticker string, series_ticker string, title string, sub_title string, "
    "mutually_exclusive boolean, category string, bing_reports map<string,string>, "
    "ddgs_reports map<string,string>, added_on string, feed_pos bigint"
)

RESOLVED_EVENTS = (
    ACTIVE_EVENTS + ", resolution_date string, latest_close_time string, "
    "earliest_open_time string, is_resolved boolean, has_resolved boolean"
)

# Active-market state; state_pos is the list order (first match wins).
MARKET_STATE_FIELDS = (
    "ticker", "event_ticker", "title", "subtitle", "yes_sub_title", "no_sub_title",
    "rules_primary", "rules_secondary", "open_time", "close_time", "expiration_time", "status",
    "response_price_units", "yes_bid", "yes_ask", "no_bid", "no_ask", "last_price", "volume",
    "liquidity",
)
ACTIVE_MARKETS = (
    "ticker string, event_ticker string, title string, subtitle string, yes_sub_title string, "
    "no_sub_title string, rules_primary string, rules_secondary string, open_time string, "
    "close_time string, expiration_time string, status string, response_price_units string, "
    "yes_bid int, yes_ask int, no_bid int, no_ask int, last_price int, volume bigint, "
    "liquidity bigint, market_price map<string,double>, state_pos bigint"
)
RESOLVED_MARKETS = ACTIVE_MARKETS + ", resolution_date string"

# Fields refreshed on a known market; everything else stays as first seen.
QUOTE_FIELDS = ("yes_bid", "yes_ask", "no_bid", "no_ask", "last_price", "volume", "liquidity")

REPORTS = "timestamp string, event_ticker string, ddgs_report string, doc_seq bigint"
SEARCH_RESULTS = "event_ticker string, query_no bigint, rnk bigint, href string, title string, body string"
WEB_PAGES = "url string, http_status int, html string"
MODEL_OUTPUTS = "event_ticker string, purpose string, query_no bigint, completion string"
SAMPLED_EVENTS = ACTIVE_EVENTS + ", position bigint"
