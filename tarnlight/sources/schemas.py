"""Schemas of the stored tables. Keys and uniqueness are kept by the operators that write them."""

from __future__ import annotations

ARTICLES = (
    "id string, url string, url_normalized string, domain string, title string, content string, content_hash string, is_indexed boolean, "
    "crawl_timestamp timestamp, published_date date, last_crawled_at timestamp"
)
SIGNALS = "article_id string, quality_score double, readability_score double, authority_score double, freshness_score double, popularity_score double, computed_at timestamp"
SEED_URLS = "id long, url string, domain string, crawled boolean, crawled_at timestamp, articles_found int, links_discovered int, added_at timestamp"
URL_QUEUE = "id long, url string, domain string, source string, priority int, crawled boolean, crawled_at timestamp, added_at timestamp"
TERMS = "term string, doc_freq long"
POSTINGS = "term string, doc_id string, term_frequency int, title_tf int, content_tf int, positions array<int>"
DOC_LENGTHS = "doc_id string, doc_length int, indexed_at timestamp"
CORPUS_STATS = "total_documents long, avg_document_length double, total_terms long, last_updated timestamp, index_version int"
ROBOTS = "origin string, text string"
TIERS = "profile string, domain string, authority string, primary_domain string, authority_score double, min_quality double"
PROGRESS = "last_id string, found long, none long, skipped long, errors long"
