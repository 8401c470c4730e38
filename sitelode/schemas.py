"""Record schemas of the sources, as DDL."""

SUBMISSION = (
    "idempotency_id string, email string, submitted_at timestamp, answers array<int>, "
    "q12_governance string, personal_use string, next_goal string, landing_url string"
)
SUBMISSION_UPDATE = "idempotency_id string, pain_point_text string, update string, received_at timestamp"
CONSENT_BODY = "analytics string"
CONSENT = "visitor_id string, ts timestamp, raw string"
CLICK = (
    "visitor_id string, ts timestamp, href string, link_text string, is_link boolean, is_primary boolean, "
    "section_id string, page_url string, page_title string"
)
SITEMAP_URL = "loc string, lastmod string, changefreq string, priority double"
