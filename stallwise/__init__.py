"""stallwise: shop analytics as Spark jobs (catalogue, pricing, orders, traffic, reviews, edits)."""
