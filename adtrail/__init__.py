"""adtrail: ad-campaign analytics over crawl data, as Spark DataFrame operators."""
