"""The tables' columns, as DDL."""

CANDIDATE = (
    "ordinal long, source_name string, source_url string, source_trust int, source_is_primary boolean, title string, url string, "
    "summary string, published_at timestamp, source_type string, external_id string, exact_model_id string, "
    "source_last_modified_at timestamp"
)
PROFILE = "profile_id int, slug string, name string, icon string, enabled boolean, class_ids array<int>"
TERM = "profile_id int, kind string, term string, weight string"
ANALYSIS = (
    "subject_name string, subject_type string, summary string, what_happened string, why_it_matters string, what_changed string, "
    "novelty_score int, credibility_score int, confidence double, hype_probability double, "
    "profiles array<struct<profile string, relevance_score int, novelty_score int, actionability_score int, "
    "strategic_impact_score int, alert_score int, reason string, suggested_action string, related_topics array<string>, "
    "related_classes array<int>>>"
)
ALERT = "alert_id string, event_id string, alert_type string, channel string, content_fingerprint string, text string, delivery_status string"
PAGE = "source_id string, url string, body string, http_status int"
PAGE_ITEM = "source_id string, url string, position int, item_url string, title string, summary string, published_at string, error string"
