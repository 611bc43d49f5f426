"""Site enrichment on Spark: from crawled pages and articles to a linked site catalogue."""
