"""newsloom: news-feed ingestion and analytics as Spark DataFrame jobs."""
