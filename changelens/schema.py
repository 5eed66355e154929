"""Table schemas, enumerations and constants of the change-record data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the data model.
CHANGE_TYPES = ("added", "removed", "modified", "text_change", "price_change", "feature_change", "headline_change", "product_change", "hiring_signal", "integration_change")
CATEGORIES = ("pricing", "features", "product", "hiring", "integrations", "messaging", "other")
SEVERITY_BANDS = ((30.0, "noise"), (50.0, "low"), (70.0, "medium"), (85.0, "high"))
TOP_SEVERITY = "critical"
SEVERITY_ORDER = ("critical", "high", "medium", "low", "noise")
FREQUENCY_MINUTES = {"hourly": 60, "daily": 1440, "weekly": 10080, "manual": 0}
HEADING_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BOILERPLATE_LOCATIONS = ("navigation", "footer", "cookie_banner", "advertisement", "sidebar")
HIGH_IMPACT = 70.0
NARRATE_MIN_SCORE = 40.0
MAX_SNIPPET = 1200
PAIRING_THRESHOLD = 0.40
SAME_LOCATION_BONUS, SAME_TAG_BONUS = 0.08, 0.04
MIN_MAGNITUDE, MIN_MEANINGFUL_CHARS = 0.12, 12
CATEGORY_THRESHOLD = 0.35
MAX_MODEL_SHIFT = 12.0
SCORE_WEIGHTS = {"business": 0.30, "customer": 0.20, "strategic": 0.20, "magnitude": 0.15, "confidence": 0.15}


_FUNNEL = "raw_changes int, noise_changes int, meaningful_changes int, high_impact_changes int, noise_reduction double"

#: DDL of the eight tables. Behind their own columns: when a snapshot's content was last seen and whether its body is cut, and a change's key that is the same in every replay.
TABLES = {
    "competitors": "id long, name string, website_url string, description string, tracking_frequency string, active boolean, created_at timestamp_ntz, updated_at timestamp_ntz",
    "tracked_urls": "id long, competitor_id long, url string, label string, page_type string, render_js boolean, active boolean, last_checked timestamp_ntz, last_status string, last_error string, created_at timestamp_ntz",
    "snapshots": "id long, tracked_url_id long, competitor_id long, url string, timestamp timestamp_ntz, status_code int, content_hash string, raw_html_path string, raw_html string, normalized_text string, title string, word_count int, fetch_duration_ms int, source string, touched_at timestamp_ntz, body_cut boolean",
    "changes": "id long, snapshot_id long, previous_snapshot_id long, competitor_id long, change_type string, category string, location string, before string, after string, magnitude double, is_noise boolean, noise_reason string, relevance_score double, severity string, classifier_confidence double, detected_at timestamp_ntz, source_url string, change_key string",
    "intelligence": "id long, change_id long, competitor_id long, title string, category string, summary string, before string, after string, business_impact string, recommended_action string, relevance_score double, severity string, confidence double, analysed_by string, llm_status string, llm_error string, llm_model string, tracked_url_id long, snapshot_id long, previous_snapshot_id long, source_url string, created_at timestamp_ntz, change_key string",
    "digests": f"id long, period_start timestamp_ntz, period_end timestamp_ntz, title string, content string, headline string, {_FUNNEL}, generated_by string, created_at timestamp_ntz",
    "scan_runs": f"id long, competitor_id long, started_at timestamp_ntz, finished_at timestamp_ntz, status string, urls_scanned int, urls_failed int, {_FUNNEL}, error string",
    "evaluations": f"id long, kind string, target_url string, snapshot_a string, snapshot_b string, pages_evaluated int, {_FUNNEL}, category_breakdown string, report_path string, status string, error string, created_at timestamp_ntz",
}

BLOCK = "struct<pos:int,text:string,location:string,tag:string,depth:int,attrs:map<string,string>>"


def table_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])
